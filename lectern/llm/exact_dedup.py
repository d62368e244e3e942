"""Exact deduplication with an extendible-hash index on shared files.

The index is a log of texts in the shared folder and a directory over the leading bits of their keys, a table beside
it. The directory doubles, and overfull buckets split, until no bucket holds more than its capacity; a key that
is large by itself cannot be split: its rows chain. Owner tasks each take whole buckets, walk them in key order, chain texts whose
keys collide and compare bytes.

Copies inside one step of one task are chained before anything is written. A key that still has many rows is
chained in several tasks first, and what is left of it goes to its owner, so that a text with very many copies reaches that as a few
rows; the copies follow their head by joins on row numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lectern.llm.shared import write_once
from lectern.llm.texts import arrow, schema_of, steps, utf8, with_text

#: Rows of one key from which on they are chained in several tasks first, so many in each.
HOT = 64
#: Rows of a lookup table that is sent to all executors; a larger one is joined by a shuffle.
SENT = 1 << 20
#: With the struct row of all columns where rows are carried.
_LOG = "rid long, doc_id {id}, head long, head_id {id}, first boolean, sha string, key long, size long, copies long, text binary"


def normalised(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space, at the ends too."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return b" " * text[:1].isspace() + b" ".join(words) + b" " * text[-1:].isspace()


def _local_chains(schema: pa.Schema, text_col: str):
    """A row for each document; the smallest doc_id of a step's equal texts is their head and carries the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for step in steps(with_text(batch, text_col), "text"):
                ids, texts = step.column("doc_id").to_pylist(), [normalised(x) for x in utf8(step.column("text"))]
                heads: dict[bytes, int] = {}
                copies: dict[bytes, int] = {}
                for i, text in enumerate(texts):
                    j = heads.setdefault(text, i)
                    copies[text] = copies.get(text, 0) + 1
                    if ids[i] is not None and (ids[j] is None or ids[i] < ids[j]):
                        heads[text] = i
                head = [heads[x] for x in texts]
                first = [i == h for i, h in enumerate(head)]
                sha = {x: hashlib.sha256(x).hexdigest() for x in heads}
                yield arrow(
                    schema,
                    rid=[row + i for i in range(len(ids))], doc_id=step.column("doc_id"), head=[row + h for h in head], head_id=[ids[h] for h in head],
                    first=first, sha=[sha[x] for x in texts],
                    key=[xxhash.xxh64_intdigest(x) - (1 << 63) if f else None for x, f in zip(texts, first)],
                    size=[len(x) if f else None for x, f in zip(texts, first)],
                    copies=[copies[x] if f else None for x, f in zip(texts, first)],
                    text=[x if f else None for x, f in zip(texts, first)],
                    **({"row": step.column("row").take(pa.array([i if f else None for i, f in enumerate(first)], pa.int64()))} if "row" in schema.names else {}),
                )
                row += len(ids)

    return run


def _owner(schema: pa.Schema):
    """Walk rows sorted by key and part: link each head to the first text of equal bytes in its chain; that one's text goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chain = None, []
        for batch in batches:
            keep_ids, keep_rids, goes_on = [], [], []
            rids, ids, keys, parts, texts = (batch.column(c).to_pylist() for c in ("rid", "doc_id", "key", "part", "text"))
            for rid, doc_id, k, part, text in zip(rids, ids, keys, parts, texts):
                if (k, part) != key:
                    key, chain = (k, part), []
                link = next((x for x in chain if x[0] == text), None)
                goes_on.append(text if link is None else None)
                if link is None:
                    chain.append(link := (text, doc_id, rid))
                keep_ids.append(link[1])
                keep_rids.append(link[2])
            more = {"text": goes_on} if "text" in schema.names else {}
            yield arrow(schema, head=batch.column("rid"), keep_id=pa.array(keep_ids, schema.field("keep_id").type), keep_rid=keep_rids, copies=batch.column("copies"), key=batch.column("key"), **more)

    return run


def _owner_rows(text_col: str, schema: pa.Schema):
    """The same walk over carried rows: only the first row of each chain goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chain = None, []
        for batch in batches:
            for step in steps(with_text(batch, text_col), "text"):
                stay = []
                for i, (*k, raw) in enumerate(zip(step.column("key").to_pylist(), step.column("part").to_pylist(), utf8(step.column("text")))):
                    if k != key:
                        key, chain = k, []
                    if (text := normalised(raw)) not in chain:
                        chain.append(text)
                        stay.append(i)
                yield arrow(schema, **{c: step.column(c).take(pa.array(stay, pa.int64())) for c in schema.names})

    return run


def build_directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """((slot, bucket), depth): a bucket for every value that the keys' leading depth bits take, written beside the log.

    keys are (key, bytes). All sums stay in Spark; the driver only learns whether a bucket is overfull, and doubles. The
    first depth is that at which even buckets would be full. Keys that take a quarter of a bucket or more by themselves chain and do not count.
    """
    light = keys.where(F.col("bytes") < capacity / 4)
    total = light.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    start = depth = max(1, (int(total) // capacity).bit_length())
    at = lambda bits: F.shiftright("key", 64 - bits)
    while light.groupBy(at(depth)).agg(F.sum("bytes").alias("n")).where(F.col("n") > capacity).limit(1).count():
        depth += 1
    held = keys.groupBy(at(depth).alias("slot")).agg(F.sum(F.when(F.col("bytes") < capacity / 4, F.col("bytes")).otherwise(0)).alias("n"))
    bucket = F.concat(F.lit(f"{depth}:"), F.col("slot").cast("string"))
    for bits in range(depth - 1, start - 1, -1):  # the last to count is the least depth at which a slot's bucket is not overfull
        prefix = F.shiftright("slot", depth - bits)
        held = held.withColumn(f"n{bits}", F.sum("n").over(Window.partitionBy(prefix)))
        bucket = F.when(F.col(f"n{bits}") <= capacity, F.concat(F.lit(f"{bits}:"), prefix.cast("string"))).otherwise(bucket)
    return write_once(held.select("slot", bucket.alias("bucket")), "exact-directory"), depth


def _sized(table: DataFrame) -> DataFrame:
    """A lookup table, marked to be sent to all executors if it has few rows."""
    return F.broadcast(table) if table.limit(SENT + 1).count() <= SENT else table


def _log(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """The index's log; with carry, the heads hold their row of docs in place of the text."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.struct("*").alias("row") if carry else F.col(text_col).cast("string").alias("text"))
    schema = docs.sparkSession.createDataFrame([], _LOG.format(id=own.schema["doc_id"].dataType.simpleString())).schema
    if carry:
        schema = StructType([f for f in schema if f.name != "text"]).add("row", own.schema["row"].dataType, True)
    return write_once(own.mapInArrow(_local_chains(to_arrow_schema(schema), text_col), schema), "exact-log")


class _Index:
    """The log's heads with the directory, and the keys that have many rows."""

    def __init__(self, log: DataFrame, bucket_bytes: int, content: str):
        self.heads = log.where("first").select("rid", "doc_id", "key", "copies", content)
        keys = write_once(log.where("first").groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "exact-keys")
        self.directory, self.depth = build_directory(keys, bucket_bytes)
        self.crowded = write_once(keys.where(F.col("n") > HOT).select("key", F.ceil(F.col("n") / HOT).alias("parts")), "exact-crowded")

    def split(self) -> tuple[DataFrame, DataFrame]:
        """Heads of keys with few rows, and the others in order of key, part and id, dealt by key and part."""
        crowded = _sized(self.crowded)
        many = self.heads.join(crowded, "key").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts"))).drop("parts")
        ordered = many.repartition("key", "part").sortWithinPartitions("key", "part", F.col("doc_id").asc_nulls_last(), "rid")
        return self.heads.join(crowded, "key", "left_anti"), ordered

    def owned(self, heads: DataFrame) -> DataFrame:
        """Heads dealt to the owners of their buckets, in order of key and id."""
        slot = F.shiftright("key", 64 - self.depth).alias("slot")
        found = heads.select("*", slot, F.lit(0).cast("long").alias("part")).join(_sized(self.directory), "slot")
        return found.repartition("bucket").sortWithinPartitions("key", F.col("doc_id").asc_nulls_last(), "rid").drop("slot", "bucket")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white-space runs become one space; null counts as empty. The row with
    the smallest id stays (a null id last; of rows that repeat an id, one). Very long texts are one row each, held whole by the tasks
    that read and own them. An empty table gives no rows; other columns of docs, whatever their names, are not read.
    """
    spark, log = docs.sparkSession, _log(docs, id_col, text_col, carry=False)
    link = f"head long, keep_id {log.schema['doc_id'].dataType.simpleString()}, keep_rid long, copies long, key long"
    index = _Index(log, bucket_bytes, "text")
    few, many = index.split()
    first = write_once(many.mapInArrow(_owner(schema_of(spark, f"{link}, text binary")), f"{link}, text binary"), "exact-chained")
    ahead = first.where("text is not null").select(F.col("head").alias("rid"), F.col("keep_id").alias("doc_id"), "key", "copies", "text")
    owned = index.owned(few.unionByName(ahead))
    links = write_once(owned.mapInArrow(_owner(schema_of(spark, link)), link).drop("key"), "exact-links")
    behind = first.where("text is null").select("head", F.col("keep_rid").alias("through"), "copies")
    moved = behind.join(links.select(F.col("head").alias("through"), "keep_id", "keep_rid"), "through").select("head", "keep_id", "keep_rid", "copies")
    links = links.unionByName(moved)
    sizes = links.groupBy("keep_rid").agg(F.sum("copies").alias("group_size"))
    named = links.drop("copies").join(sizes, "keep_rid")
    return (
        log.select("rid", "doc_id", "head", "sha")
        .join(named, "head")
        .select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"))
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns, whatever their names.

    Null texts count as empty; of rows that repeat an id and a text one stays; very long texts are carried whole; an empty table gives no rows.
    """
    index = _Index(_log(docs, id_col, text_col, carry=True), bucket_bytes, "row")
    few, many = index.split()
    chained = lambda rows, out: rows.mapInArrow(_owner_rows(text_col, to_arrow_schema(out)), out)
    ahead = chained(many, index.heads.schema)
    owned = index.owned(few.unionByName(ahead.select(few.columns)))
    return chained(owned, owned.select("row").schema).select("row.*")
