"""Benchmark decontamination by a prefix-filtered set join.

A window of an item is a run of words; a document contains it only if it contains every shingle of it. The
shingles of a window are put in order of rarity over all documents, so its rarest shingle is a prefix that any
document holding the window must hold too. Windows next to each other mostly share their prefix, so an item becomes
a few spans: a prefix shingle with the words of all windows that have it. Documents' occurrences of prefix
shingles are joined with the spans on the shingle; positions bound how far a match may reach to either side, a match of a
window's length or more is hit, and words are compared exactly.

All tables stay in Spark. What executors are sent is a bit map of the shingles asked for, of bounded size; a
document's other shingles never leave its task. A full map lets more rows through and changes no result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.llm.shared import write_once
from lectern.llm.texts import arrow, schema_of, steps, utf8

#: Words of a shingle; shorter items are one shingle.
SHINGLE = 3
_WORD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of a-z (A-Z in lower case), digits and bytes beyond ASCII."""
    return text.translate(_WORD).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit number for every run of size words; equal runs have equal numbers."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(size))
    for i in range(size):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Filter:
    """A bit map of shingles by their leading bits; holds those it was made from and some others."""

    def __init__(self, bits: int, chunks: list[tuple[int, bytes]]):
        self.shift = np.uint64(64 - bits)
        self.flags = np.zeros(max(1, (1 << bits) // 8), np.uint8)
        for number, chunk in chunks:
            at = number * _CHUNK // 8
            self.flags[at : at + _CHUNK // 8] = np.frombuffer(chunk, np.uint8)[: len(self.flags) - at]

    def __call__(self, values: np.ndarray) -> np.ndarray:
        """The places of the values that may be in the map."""
        at = values >> self.shift
        return np.flatnonzero(self.flags[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)


#: Bits of one aggregate of Spark's bitmap functions.
_CHUNK = 32768


def filter_of(grams: DataFrame, most_bits: int, each: int = 256) -> Filter:
    """A filter of the column gram, each bits for each value but 2^most_bits at most; what reaches the driver is that map."""
    count = grams.agg(F.approx_count_distinct("gram")).first()[0]
    bits = min(most_bits, max(15, math.ceil(math.log2(each * count + 1))))
    place = F.shiftrightunsigned("gram", 64 - bits) + 1
    chunks = grams.groupBy((F.bitmap_bucket_number(place) - 1).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("flags"))
    return Filter(bits, [(r["chunk"], bytes(r["flags"])) for r in chunks.collect()])


def _items(schema: pa.Schema):
    """A row for each item that has a word: its words and their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for step in steps(batch, "text"):
                words = [words_of(x) for x in utf8(step.column("text"))]
                sizes = [min(SHINGLE, len(w)) for w in words]
                grams = [shingles(word_hashes(w), n).view(np.int64) for w, n in zip(words, sizes)]
                found = arrow(schema, no=row + np.arange(len(words)), item=step.column("item"), words=[b" ".join(w) for w in words], size=sizes, grams=grams)
                yield found.filter(pa.array(np.array(sizes, np.int32) > 0))
                row += len(words)

    return run


def prefix_spans(counts: np.ndarray, grams: np.ndarray, size: int, window: int) -> Iterator[tuple[int, int, int]]:
    """(prefix position, first window, last window) of an item: each window goes to its rarest shingle, the first of equals."""
    n = len(grams) + size - 1  # words
    order = np.lexsort((np.arange(len(grams)), grams, counts))
    rank = np.empty(len(grams), np.int64)
    rank[order] = np.arange(len(grams))
    inside = min(window, n) - size + 1
    least = order[np.lib.stride_tricks.sliding_window_view(rank, inside).min(axis=1)]
    cuts = np.flatnonzero(np.diff(least)) + 1
    yield from zip(least[np.append(0, cuts)].tolist(), np.append(0, cuts).tolist(), (np.append(cuts, len(least)) - 1).tolist())


def _spans(window: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, joined, size, grams, seen in zip(*(batch.column(c).to_pylist() for c in ("item", "words", "size", "grams", "seen"))):
                words = joined.split(b" ")
                n = min(window, len(words))
                for at, low, high in prefix_spans(np.array(seen, np.int64), np.array(grams, np.int64), size, window):
                    out.append({"item": item, "gram": grams[at], "words": b" ".join(words[low : high + n]), "lead": at - low, "n": n})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _count(wanted: Broadcast, sizes: list[int], schema: pa.Schema):
    """Occurrences of the shingles that may be asked for, added up for each step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                hashes = [word_hashes(words_of(x)) for x in utf8(step.column("text"))]
                met = [found[wanted.value(found)] for h in hashes for size in sizes if len(found := shingles(h, size))]
                grams, n = np.unique(np.concatenate(met), return_counts=True) if met else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield arrow(schema, gram=pa.array(grams.view(np.int64)), n=pa.array(n.astype(np.int64)))

    return run


def _occurrences(wanted: Broadcast, sizes: list[int], window: int, schema: pa.Schema):
    """Each document with the places of prefix shingles and the words around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for step in steps(batch, "text"):
                count, found = [], []
                for text in utf8(step.column("text")):
                    words, own = words_of(text), []
                    hashes = word_hashes(words)
                    for size in sizes:
                        grams = shingles(hashes, size)
                        for at in (wanted.value(grams) if len(grams) else np.zeros(0, np.int64)).tolist():
                            low = max(0, at - window + size)
                            own.append({"gram": int(grams[at].view(np.int64)), "at": at, "lead": at - low, "around": b" ".join(words[low : at + window])})
                    count.append(len(words))
                    found.append(own)
                yield arrow(schema, rid=row + np.arange(len(count)), doc_id=step.column("doc_id"), n_words=count, found=found)
                row += len(count)

    return run


def _reach(one: list[bytes], two: list[bytes]) -> int:
    """How many words two lists begin with alike."""
    n = 0
    for x, y in zip(one, two):
        if x != y:
            break
        n += 1
    return n


def _verify(schema: pa.Schema):
    """Runs of words around a shared shingle that are equal and hold a window at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, at, lead, around, span, words, span_lead, n in zip(*(batch.column(c).to_pylist() for c in ("rid", "at", "lead", "around", "span", "words", "span_lead", "n"))):
                mine, theirs = around.split(b" "), words.split(b" ")
                left = _reach(mine[:lead][::-1], theirs[:span_lead][::-1])
                right = _reach(mine[lead:], theirs[span_lead:])
                if left + right >= n:
                    out.append({"rid": rid, "span": span, "start": at - left, "end": at + right})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def mark_windows(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", most_bits: int = 27) -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs (start, end in words; they may overlap), items (sorted names)."""
    spark = docs.sparkSession
    through = lambda df, make, ddl, *args: df.mapInArrow(make(*args, schema_of(spark, ddl)), ddl)
    named = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    items = write_once(through(named, _items, "no long, item string, words binary, size int, grams array<long>"), "decontam-items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # three at most
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    placed = items.select("no", F.posexplode("grams").alias("at", "gram"))
    grams = placed.select("gram").distinct()
    wanted = spark.sparkContext.broadcast(filter_of(grams, most_bits))
    seen = through(own.select("text"), _count, "gram long, n long", wanted, sizes).groupBy("gram").agg(F.sum("n").alias("n"))
    counted = placed.join(seen, "gram", "left").groupBy("no").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n"))))["n"].alias("seen"))
    prefixes = write_once(through(items.join(counted, "no"), _spans, "item string, gram long, words binary, lead int, n int", window), "decontam-prefixes")
    key = ["gram", "words", "lead", "n"]
    spans = write_once(prefixes.select(*key).distinct().withColumn("span", F.monotonically_increasing_id()), "decontam-spans")
    owners = prefixes.where("item is not null").join(spans, key).select("span", "item").distinct()

    wanted = spark.sparkContext.broadcast(filter_of(spans.select("gram"), most_bits))
    kind = own.schema["doc_id"].dataType.simpleString()
    marks_ddl = f"rid long, doc_id {kind}, n_words long, found array<struct<gram:long,at:int,lead:int,around:binary>>"
    marks = write_once(through(own, _occurrences, marks_ddl, wanted, sizes, window), "decontam-marks")
    met = marks.select("rid", F.explode("found").alias("f")).select("rid", "f.*").join(spans.withColumnRenamed("lead", "span_lead"), "gram")
    hits = write_once(through(met, _verify, "rid long, span long, start int, end int"), "decontam-hits")
    runs = hits.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("runs"))
    names = hits.select("rid", "span").distinct().join(owners, "span").groupBy("rid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    found = runs.join(names, "rid", "left")
    return marks.drop("found").join(found, "rid", "left").select("doc_id", "n_words", none("runs", "array<struct<start:int,end:int>>"), none("items", "array<string>"))


def hit_words():
    """Words inside any of a document's runs, which are in order of their starts."""
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))

    def add(s, run):
        return F.struct((s["n"] + F.greatest(F.lit(0), run["end"] - F.greatest(run["start"], s["to"]))).alias("n"), F.greatest(s["to"], run["end"].cast("long")).alias("to"))

    return F.aggregate("runs", state, add, lambda s: s["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies inside an occurrence of a window: window consecutive words of an item, all of them
    if it has fewer, none if it has no word. contaminated: some word is hit, and one in one_in of all words at least.
    Null and empty texts have no words; very long ones are worked on one at a time, with memory in proportion to their
    words. Repeated items count once by name; items without a name (null) hit words but are not counted
    among the items; repeated documents are judged each; empty tables give no rows and hit nothing; other columns of
    either table are not read, whatever their names. options are those of mark_windows.
    """
    marked = mark_windows(docs, benchmark, window, **options)
    return marked.select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns; equal texts share one judgement."""
    digest = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    texts = docs.select(digest.alias("digest"), F.col(text_col).cast("string").alias("text"))
    bad = decontaminate(texts, benchmark, id_col="digest", text_col="text", **options).where("contaminated").select("doc_id").distinct()
    return docs.join(bad, digest == bad["doc_id"], "left_anti")
