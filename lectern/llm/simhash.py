"""SimHash near-duplicates by anchor-point covering.

Two fingerprints that differ in at most three bits differ in at most one bit of one of their 32-bit halves.
The anchors of a half are the words of the perfect Hamming code over its lower 31 bits: every half lies within
the covering radius one of an anchor (its home), so two halves at distance one or less share the first one's
home when each is sent to every anchor within radius plus threshold, two. Fingerprints are compared with
all others at the same anchor; anchors with many fingerprints are compared block by block in separate tasks.

near_duplicates serves where near copies are told by the Jaccard index of word runs. At an index of 0.8 fingerprints differ in about nine
bits, beyond what anchors can cover, so it finds candidates by bands of least hashes instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.llm.components import components
from lectern.llm.decontam import shingles, word_hashes
from lectern.llm.shared import write_once
from lectern.llm.texts import arrow, schema_of, steps, utf8

#: Bits of a half that the code covers, and its parity bits.
_LENGTH, _PARITY = 31, 5
#: Largest distance at which the covering finds every pair: one bit in one of two halves.
MAX_DISTANCE = 3


def shingle_fingerprint(text: bytes, words: int, seed: int) -> int:
    """The majority bits of the XXH64 of every run of so many words, repeats included; 0 for no word."""
    found = text.lower().split()
    if not found:
        return 0
    joined, ends = b" ".join(found), np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(found) - words + 1)
    last = ends[words - 1 :] if len(found) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), (last - 1).tolist())), np.uint64, n)
    return majority_bits(hashes)


def majority_bits(hashes: np.ndarray) -> int:
    """A 64-bit number whose bit is set if more than half of the hashes have it set."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)]
        count += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int, seed: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                fps = np.array([shingle_fingerprint(x, words, seed) for x in utf8(step.column("text"))], np.uint64)
                yield arrow(schema, doc_id=step.column("doc_id"), fp=pa.array(fps.view(np.int64)))

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each whole text, as a signed long."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = own.select("doc_id", F.lit(0).cast("long").alias("fp")).schema
    return own.mapInArrow(_fingerprints(words, seed, to_arrow_schema(out)), out)


def _near_masks() -> list[list[int]]:
    """For each syndrome, the bit flips of weight two or less that lead to an anchor; the home's comes first."""
    masks: list[list[int]] = [[0]]
    for syndrome in range(1, _LENGTH + 1):
        pairs = [(1 << (i - 1)) | (1 << ((i ^ syndrome) - 1)) for i in range(1, _LENGTH + 1) if i < i ^ syndrome <= _LENGTH]
        masks.append([1 << (syndrome - 1), *pairs])
    return masks


def _anchors(schema: pa.Schema):
    """Rows (anchor, fp, home) for every anchor within radius plus threshold of either half."""
    width = max(map(len, _near_masks()))
    masks = np.array([m + [-1] * (width - len(m)) for m in _near_masks()], np.int64)
    parity = np.array([sum(1 << (i - 1) for i in range(1, _LENGTH + 1) if i >> j & 1) for j in range(_PARITY)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            tables = batch.column("no").to_numpy(zero_copy_only=False).astype(np.int64)
            for half in (0, 1):
                low = (fps >> (32 * half)) & ((1 << _LENGTH) - 1)
                syndrome = sum((np.bitwise_count(low & p).astype(np.int64) & 1) << j for j, p in enumerate(parity))
                near = masks[syndrome]
                row, col = np.nonzero(near >= 0)
                yield arrow(schema, anchor=pa.array((low[row] ^ near[row, col]) | (half << 32) | tables[row] << 33), fp=pa.array(fps[row]), home=pa.array((col == 0).astype(np.int32)))

    return run


def _compare(distance: int, schema: pa.Schema):
    """Rows come sorted by (anchor, i, j). Link each fingerprint of a group to one it can be reached from."""

    def linked(fps: np.ndarray) -> tuple[list[int], list[int]]:
        """Every fingerprint but the first of a group, with a close one that was reached before."""
        fps, a, b = np.unique(fps), [], []
        bits = fps.view(np.uint64)
        close = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= distance
        unseen = np.ones(len(fps), bool)
        for start in np.flatnonzero(close.sum(1) > 1):
            front = [start] if unseen[start] else []
            unseen[start] = False
            while len(front):
                reached = close[front] & unseen
                found = np.flatnonzero(reached.any(0))
                unseen[found] = False
                a += fps[found].tolist()
                b += fps[np.asarray(front)[reached[:, found].argmax(0)]].tolist()
                front = found
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("anchor", "i", "j")])
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [len(fps)]])
            no, a, b = [], [], []
            for s, e in zip(cuts[:-1], cuts[1:]):
                if (key := tuple(keys[:, s])) != group:
                    found = linked(np.concatenate(held)) if held else ((), ())
                    no += [int(group[0]) >> 33] * len(found[0]) if held else []
                    a += found[0]
                    b += found[1]
                    held, group = [], key
                held.append(fps[s:e])
            yield arrow(schema, no=no, a=a, b=b)
        if held:
            a, b = linked(np.concatenate(held))
            yield arrow(schema, no=[int(group[0]) >> 33] * len(a), a=a, b=b)

    return run


def near_links(distinct: DataFrame, distance: int = MAX_DISTANCE, block: int = 1024) -> DataFrame:
    """Links (a, b), each within distance, that connect what all pairs of fingerprints within distance would.

    distinct has (fp), or (no, fp) for fingerprints of several kinds that link only to their own; links then
    have no too. A group at one anchor gives links that span it instead of all its pairs. An anchor with more than block
    fingerprints is compared as pairs of blocks, each pair a task's group of bounded size.
    """
    if not 0 <= distance <= MAX_DISTANCE:
        raise ValueError(f"the covering finds distances up to {MAX_DISTANCE}")
    rows_schema, link_schema = "anchor long, fp long, home int", "no int, a long, b long"
    spark = distinct.sparkSession
    several = "no" in distinct.columns
    keyed = distinct.select("fp", F.col("no").cast("int").alias("no") if several else F.lit(0).alias("no"))
    rows = write_once(keyed.mapInArrow(_anchors(schema_of(spark, rows_schema)), rows_schema), "anchors")
    busy = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("home").alias("homes")).where("n > 1 and homes > 0")
    blocks = F.ceil(F.col("n") / block).cast("int")
    met = rows.join(busy, "anchor").select("anchor", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("k"))
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "anchor", "fp", F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j")
    )
    ordered = dealt.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    links = ordered.mapInArrow(_compare(distance, schema_of(spark, link_schema)), link_schema)
    return links if several else links.drop("no")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = MAX_DISTANCE, seed: int = 42) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of fingerprints within distance bits reach. Null and empty
    texts have fingerprint zero and link like any other; very long texts are hashed whole, a step of shingles at a time; a bit that half of the
    hashes have is 0; repeated rows share a component; an empty table gives no rows; other columns of docs, whatever their names, are
    not read.
    """
    prints = write_once(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    distinct = write_once(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(near_links(distinct, distance))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Least hashes of a band's key and bands: a pair at similarity s shares a key but with probability (1 - s^4)^20, 3e-5 at 0.8.
DEPTH, BANDS = 4, 20


def _hash_factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, DEPTH * BANDS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, DEPTH * BANDS, np.uint64)


def band_keys(grams: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A number for each band: a hash of the least values that its functions take over a set."""
    times, plus = factors
    least = np.full(len(times), np.iinfo(np.uint64).max)
    for at in range(0, len(grams), 2048):  # bounded memory for sets of any size
        values = grams[at : at + 2048, None] * times + plus
        least = np.minimum(least, (values ^ (values >> np.uint64(31))).min(axis=0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(DEPTH, BANDS):
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _shingle_sets(shingle: int, schema: pa.Schema):
    """The set of word runs of a text as sorted 32-bit hashes, its digest and band keys; a text of fewer words is one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _hash_factors()
        for batch in batches:
            for step in steps(batch, "text"):
                sets, keys = [], []
                for text in utf8(step.column("text")):
                    hashes = word_hashes(text.lower().split())
                    found = np.unique(shingles(hashes, min(shingle, len(hashes))) if len(hashes) else np.zeros(1, np.uint64))
                    keys.append(band_keys(found, factors))
                    sets.append(np.unique((found >> np.uint64(32)).astype(np.uint32)).tobytes())
                yield arrow(schema, doc_id=step.column("doc_id"), digest=[hashlib.md5(x).digest() for x in sets], keys=keys, grams=sets)

    return run


def similar(one: np.ndarray, two: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard index of two sorted sets is similarity or more."""
    small, large = (one, two) if len(one) <= len(two) else (two, one)
    if len(small) < similarity * len(large):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return both >= similarity * (len(one) + len(two) - both)


def _verified(schema: pa.Schema, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ([np.frombuffer(x, np.uint32) for x in batch.column(c).to_pylist()] for c in ("x", "y"))
            kept = pa.array([similar(x, y, similarity) for x, y in zip(*sets)], pa.bool_())
            yield batch.select(["a", "b"]).filter(kept).cast(schema)

    return run


def shared_counts(one: list[np.ndarray], two: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many members each set of one shares with each set of two, as products of membership tables of some columns at a time."""
    sides = []
    for sets in (one, two):
        members, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(members, kind="stable")
        sides.append((members[order], rows[order], len(sets)))
    both = np.intersect1d(*(np.unique(members) for members, _, _ in sides), assume_unique=True)
    out = np.zeros((len(one), len(two)), np.float32)
    for k in range(0, len(both), columns):
        part, tables = both[k : k + columns], []
        for members, rows, n in sides:
            low, high = np.searchsorted(members, part[0]), np.searchsorted(members, part[-1], "right")
            at = np.searchsorted(part, members[low:high])
            hit = part[at] == members[low:high]
            tables.append(np.zeros((n, len(part)), np.float32))
            tables[-1][rows[low:high][hit], at[hit]] = 1
        out += tables[0] @ tables[1].T
    return out


def _linked_blocks(schema: pa.Schema, similarity: float):
    """Rows come sorted by (key, i, j), a row for each set of two blocks of a key's group: verified links that span what is similar.

    Sets of one root are not linked again, nor are those that meet in an earlier band.
    """

    def linked(key: int, i: int, j: int, at: tuple, ids: tuple, roots: tuple, bands: tuple, sets: tuple) -> tuple[list, list]:
        top = {r: r for r in roots}

        def find(x):
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        own, other = ([k for k, x in enumerate(at) if x == side] for side in (i, j))
        if not own or not other:
            return [], []
        grams, keys = [np.frombuffer(x, np.uint32) for x in sets], np.array(bands, np.int64)
        both = shared_counts([grams[k] for k in own], [grams[k] for k in other])
        size = np.array([len(x) for x in grams])
        a, b = [], []
        for x, y in zip(*np.nonzero(both >= similarity * (size[own][:, None] + size[other][None, :] - both))):
            m, n = own[x], other[y]
            if (i != j or m < n) and find(roots[m]) != find(roots[n]) and keys[m][np.argmax(keys[m] == keys[n])] == key:
                top[find(roots[m])] = find(roots[n])
                a.append(ids[m])
                b.append(ids[n])
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            a, b = [], []
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "at", "doc_id", "root", "keys", "grams"))):
                if row[:3] != group:
                    if held:
                        x, y = linked(*group, *zip(*held))
                        a += x
                        b += y
                    group, held = row[:3], []
                held.append(row[3:])
            yield arrow(schema, a=a, b=b)
        if held:
            a, b = linked(*group, *zip(*held))
            yield arrow(schema, a=a, b=b)

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, block: int = 256, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, component_id) of the documents that have a near copy: word runs with a Jaccard index of similarity or more.

    component_id is the smallest id that such links reach; documents without a near copy have no row. Documents with equal
    sets are one class, represented by its smallest id. Representatives meet where a band of least hashes is equal.
    Each is compared with the smallest id of its groups first; where these verified links leave a group in
    several parts, its members are compared with each other inside tasks, in pairs of blocks of bounded size, so no link depends on
    one that failed. Sets are compared whole, by 32-bit hashes of their word runs.

    Ids are cast to long: one that is no number raises. Null ids link to nothing; null and empty texts are one class of
    their own; very long texts take memory in proportion to their words; rows that repeat an id count as
    one document; ties do not arise, as the smallest id stands for each class; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    set_ddl, pair_ddl = "doc_id long, digest binary, keys array<long>, grams binary", "a long, b long"
    sets = write_once(own.mapInArrow(_shingle_sets(shingle, schema_of(spark, set_ddl)), set_ddl), "near-sets")
    classes = write_once(sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("high")), "near-classes")
    same = sets.select("doc_id", "digest").join(classes.where("rep <> high"), "digest").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    keyed = sets.select("doc_id", "keys").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    rows = write_once(keyed.select("doc_id", F.explode("keys").alias("key")), "near-keys")
    groups = rows.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").select("key", "low")
    met = write_once(rows.join(groups, "key"), "near-groups")

    pairs = write_once(met.where("doc_id <> low").select(F.col("doc_id").alias("a"), F.col("low").alias("b")).distinct(), "near-pairs")
    joined = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("y")), "b")
    first = write_once(joined.mapInArrow(_verified(schema_of(spark, pair_ddl), similarity), pair_ddl), "near-links")

    roots = components(first).toDF("doc_id", "root")
    placed = met.drop("low").join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    apart = placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count("*").alias("n")).where("r <> s").select("key", "n")
    left = write_once(placed.join(apart, "key"), "near-left")
    whole = left.join(sets.select("doc_id", "keys", "grams"), "doc_id")
    weight = left.join(sets.select("doc_id", F.length("grams").alias("bytes")), "doc_id").groupBy("key").agg(F.sum("bytes").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / block_bytes)).cast("int")
    met_again = whole.join(weight, "key").withColumn("blocks", blocks).withColumn("at", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = met_again.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "doc_id", "root", "keys", "grams"
    )
    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = write_once(ordered.mapInArrow(_linked_blocks(schema_of(spark, pair_ddl), similarity), pair_ddl), "near-links")
    return components(first.union(more).union(same)).toDF("doc_id", "component_id")
