"""Periodic runs in token sequences, by seeds on diagonals.

A run is a stretch of tokens with smallest period q that is at least min_tokens and exponent * q long. Tokens of it are equal
to those q later over a known least length, so two occurrences of a gram of that length lie q apart. Grams of a document
are named exactly by doubling. Lags are taken in classes, each with grams at least as long as its lags: then no other
occurrence can lie between those two (a shorter period would follow), and pairs of neighbouring occurrences are enough. Seeds are extended along their
diagonal, and a table of how far each lag is covered passes over the seeds of a stretch that is known already. All of it takes
n log n steps for n tokens, also where one token fills a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.texts import schema_of, steps, utf8

MIN_TOKENS, EXPONENT = 24, 3
#: Tokens that one look at a diagonal compares; doubled as long as they are equal.
LOOK = 64


def least_overlap(min_tokens: int, exponent: int) -> int:
    """Tokens of a run that are surely equal to those one period later, whatever the period."""
    return min(max(min_tokens - q, (exponent - 1) * q) for q in range(1, min_tokens + 1))


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct key, and whether the key occurs more than once."""
    _, name, times = np.unique(keys, return_inverse=True, return_counts=True)
    return name, times[name] > 1


def _equal_ahead(tokens: np.ndarray, at: int, lag: int, end: int) -> int:
    """How many tokens from at on equal those lag later, before end."""
    here, look = at, LOOK
    while here + lag < end:
        stop = min(here + look, end - lag)
        other = np.flatnonzero(tokens[here:stop] != tokens[here + lag : stop + lag])
        if len(other):
            return here + int(other[0]) - at
        here, look = stop, look * 2
    return here - at


def _equal_behind(tokens: np.ndarray, at: int, lag: int, begin: int) -> int:
    """How many tokens before at equal those lag later, not before begin."""
    here, look = at, LOOK
    while here > begin:
        stop = max(here - look, begin)
        other = np.flatnonzero(tokens[stop:here] != tokens[stop + lag : here + lag])
        if len(other):
            return at - (stop + int(other[-1]) + 1)
        here, look = stop, look * 2
    return at - here


def find_runs(tokens: np.ndarray, doc: np.ndarray, min_tokens: int = MIN_TOKENS, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of documents laid end to end; doc numbers the document of each token, rising."""
    n = len(tokens)
    starts, ends = np.searchsorted(doc, doc, "left"), np.searchsorted(doc, doc, "right")
    name, again = _names(doc.astype(np.int64) << 32 | tokens)
    at, name, size = np.flatnonzero(again), name[again], 1
    gram, below, found = least_overlap(min_tokens, exponent), 0, []
    while len(at):
        while size < gram and len(at):  # grams of size tokens become such of up to twice as many
            step = min(size, gram - size)
            alive = np.full(n + step, -1)
            alive[at] = name
            after = alive[at + step]
            whole = (after >= 0) & (at + step + size <= ends[at])
            at, left, right = at[whole], alive[at[whole]], after[whole]
            name, again = _names(left * (n + 1) + right)
            at, name, size = at[again], name[again], size + step
        if not len(at):
            break
        found += _extended(tokens, at, name, starts, ends, gram, below, min_tokens, exponent)
        gram, below = gram * 2, gram
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = np.array(found, np.int64).T
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _extended(tokens: np.ndarray, at: np.ndarray, name: np.ndarray, starts: np.ndarray, ends: np.ndarray, gram: int, below: int, min_tokens: int, exponent: int) -> list[tuple[int, int, int]]:
    """The runs whose period is more than below and at most gram, from pairs of neighbouring occurrences of a gram."""
    order = np.argsort(name, kind="stable")
    place, kind = at[order], name[order]
    lag = np.diff(place)
    seed = (kind[1:] == kind[:-1]) & (lag > below) & (lag <= gram)
    place, lag = place[:-1][seed], lag[seed]
    order = np.lexsort((place, lag))
    place, lag = place[order], lag[order]
    first = np.flatnonzero(np.diff(lag, prepend=-1))
    found = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(lag)]):
        q, seeds, covered = int(lag[a]), place[a:b], -1
        k = 0
        while k < len(seeds):
            x = int(seeds[k])
            begin = x - _equal_behind(tokens, x, q, max(int(starts[x]), covered))
            covered = x + gram + _equal_ahead(tokens, x + gram, q, int(ends[x]))
            if covered - begin + q >= max(min_tokens, exponent * q):
                found.append((begin, covered - begin + q, q))
            k = int(np.searchsorted(seeds, covered - gram, "right"))
    return found


def _vocabulary(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each text (apart by white space of ASCII), a number for each word, and the text of each."""
    words, known = [x.split() for x in texts], {}
    tokens = np.fromiter((known.setdefault(w, len(known)) for line in words for w in line), np.int64)
    return words, tokens, np.repeat(np.arange(len(words)), [len(x) for x in words])


def _runs_of(min_words: int, exponent: int, schema: pa.Schema):
    item = schema.field("runs").type.value_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                words, tokens, doc = _vocabulary(utf8(step.column("text")))
                start, length, period = find_runs(tokens, doc, min_words, exponent)
                edge = np.zeros(len(tokens) + 1, np.int64)
                np.add.at(edge, start + period, 1)
                np.add.at(edge, start + length, -1)
                dropped = np.cumsum(edge) > 0
                sizes = np.array([len(x) for x in words], np.int64)
                begin = np.cumsum(sizes) - sizes
                owner = doc[start] if len(start) else np.zeros(0, np.int64)
                kept = [b" ".join(w if not dropped[a : a + len(w)].any() else [x for x, d in zip(w, dropped[a : a + len(w)].tolist()) if not d]) for w, a in zip(words, begin.tolist())]
                offsets = pa.array(np.searchsorted(owner, np.arange(len(words) + 1)), pa.int32())
                runs = pa.StructArray.from_arrays([pa.array(start - begin[owner]), pa.array(length), pa.array(period)], fields=list(item))
                columns = [step.column("doc_id"), pa.array(sizes), pa.ListArray.from_arrays(offsets, runs, type=schema.field("runs").type), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def periodic_runs(docs: DataFrame, min_words: int = MIN_TOKENS, exponent: int = EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs (array of start, length, period; by start, then period) and collapsed.

    collapsed is the text without the words that lie in a run after its first period, words joined by one space. exponent is at
    least 3, min_words at least exponent. Null and empty texts have no words and no runs; very long and very repetitive texts take n log n
    steps; rows that repeat are judged each; an empty table gives no rows; other columns of docs, whatever their names, are not read.
    """
    if exponent < 3 or min_words < exponent:
        raise ValueError("exponent must be 3 or more, and min_words no less")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ddl = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return own.mapInArrow(_runs_of(min_words, exponent, schema_of(docs.sparkSession, ddl)), ddl)


def strongest(runs: Column) -> Column:
    """Of runs sorted by start and period, the first with the greatest length / period, compared exactly; null where there is none."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best))


def run_digests(found: DataFrame) -> DataFrame:
    """Of periodic_runs: doc_id, n_runs, the strongest run, and digests of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one document in ten, by the checksum of its id, is made periodic from one of its words on; the rest stay as they are.

    With h = crc32(doc_id), g = h / 10: word i from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8). Rows without an id stay.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    marked = docs.select("doc_id", "text", F.expr("crc32(cast(doc_id as string)) div 10").alias("g"), (h % 10 == 0).alias("planted"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = marked.withColumn("w", F.when(F.col("planted"), words)).withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    again = F.expr("transform(sequence(0, n - 1), i -> w[if(i < a, i, int(a + (i - a) % (1 + (n - a) div (3 + g % 8))))])")
    return cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
