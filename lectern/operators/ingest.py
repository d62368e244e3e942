"""Incremental ingest: which documents are new, their chunks with embeddings, and the tables that record it.

Parquet has no update in place, so a table of documents is kept as snapshots, and chunks in folders by version and by a hash of
their source; only folders with changed sources are written anew.
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lectern.functions.vectors import l2_normalize
from lectern.operators.chunking import chunk_documents

BUCKETS = 64


def indexed_sources(documents: DataFrame, any_status: bool = False) -> DataFrame:
    """Distinct sources that count as indexed: with status indexed, or all rows where any_status."""
    rows = documents if any_status else documents.where(F.col("status") == "indexed")
    return rows.where(F.coalesce("source", F.lit("")) != "").select("source").distinct()


def new_documents(found: DataFrame, indexed: DataFrame, *order: str) -> DataFrame:
    """Found documents whose source is not indexed yet, the first in order of every source; before any parsing."""
    fresh = found.join(indexed.select("source"), "source", "left_anti")
    w = Window.partitionBy("source").orderBy(*order)
    return fresh.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").select(found.columns)


def ingest_counters(found: DataFrame, fresh: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents seen, added, skipped, and chunks written."""
    counted = [x.agg(F.count("*").alias(n)) for x, n in ((found, "documents"), (fresh, "added"), (chunks, "chunks"))]
    counts = counted[0].crossJoin(F.broadcast(counted[1])).crossJoin(F.broadcast(counted[2]))  # one row each
    return counts.select("documents", "added", (F.col("documents") - F.col("added")).alias("skipped"), "chunks", F.col("chunks").alias("chunks_added"))


def chunk_rows(chunks: DataFrame, embed: Callable[[Column], Column], dimensions: int | None = None) -> DataFrame:
    """Chunks with ids and unit-length embeddings; embed maps texts to vectors, in batches. A vector of other dimensions raises."""
    key = F.sha2(F.concat_ws(":", "source", F.col("chunk_index").cast("string")), 256)
    made = chunks.select(key.alias("id"), F.sha2("source", 256).alias("document_id"), "*", embed(F.col("content")).alias("embedding"))
    return made.withColumn("embedding", l2_normalize(checked_vector(F.col("embedding"), dimensions)))


def checked_vector(vector: Column, dimensions: int | None) -> Column:
    """The vector if it has these dimensions; another raises, a missing one too."""
    if dimensions is None:
        return vector
    size = F.coalesce(F.size(vector), F.lit(0))
    told = F.concat(F.lit(f"embeddings have {dimensions} dimensions, not "), size.cast("string"))
    return F.when(size == dimensions, vector).otherwise(F.raise_error(told).cast("array<double>"))


def hashed_embedding(dimensions: int = 64) -> Callable[[Column], Column]:
    """A deterministic stand-in for a model: counts of words by hash."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        slots = texts.fillna("").str.lower().str.findall("[a-z0-9]+").map(lambda words: [crc32(w.encode()) % dimensions for w in words])
        return slots.map(lambda x: np.bincount(np.array(x, np.int64), minlength=dimensions).astype(float))

    return embed


def upsert(current: DataFrame, changes: DataFrame, key: str = "source", keep: tuple[str, ...] = ("id", "created_at"), latest: tuple[str, ...] = ()) -> DataFrame:
    """A new snapshot: rows of changes go before current ones of their key, but for the columns that are kept.

    Of several changes of one key the last in the order of latest counts, where that is equal or not given the one with the
    largest values.
    """
    rest = [c for c in changes.columns if c != key and c not in latest]
    one = changes.groupBy(key).agg(F.max(F.struct(*latest, *rest)).alias("c")).select(key, "c.*")
    old = current.select(F.col(key), *[F.col(c).alias(f"_old_{c}") for c in keep])
    merged = one.join(old, key, "left").select(*[F.coalesce(f"_old_{c}", c).alias(c) if c in keep else F.col(c) for c in current.columns])
    return current.join(one.select(key), key, "left_anti").select(current.columns).unionByName(merged)


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """The last version of a chunk table and the version that holds each bucket; (0, {}) before the first write."""
    try:
        rows = spark.read.schema("bucket int, holds int, version int").parquet(f"{path}/manifest")
        last = rows.agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0, {}
    return last or 0, {r["bucket"]: r["holds"] for r in rows.where(F.col("version") == last).collect() if r["bucket"] >= 0}  # BUCKETS rows at most


def _buckets(spark: SparkSession, path: str, held: dict[int, int]) -> DataFrame | None:
    folders = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(held.items())]
    return spark.read.option("basePath", f"{path}/data").parquet(*folders).drop("version", "bucket") if folders else None


def read_chunks(spark: SparkSession, path: str) -> DataFrame | None:
    """The chunks of the last snapshot under path, None if there is none."""
    return _buckets(spark, path, _manifest(spark, path)[1])


def replace_chunks(chunks: DataFrame, path: str, sources: DataFrame | None = None, files: int = 8) -> int:
    """Replace what path holds of some sources by chunks; gives the new version.

    sources (source) are the documents that were ingested, also those that have no chunk any more; without them the
    sources of chunks. Only buckets (by a hash of the source) with such sources are written, to folders of a new version; then one file, the
    manifest, switches readers over, so a run that fails changes nothing. A bucket is written by files tasks.
    """
    spark = chunks.sparkSession
    place = F.pmod(F.xxhash64("source"), F.lit(BUCKETS)).cast("int")
    named = chunks.select("source") if sources is None else sources.select("source").union(chunks.select("source"))
    gone = named.distinct().withColumn("bucket", place)
    before, held = _manifest(spark, path)
    touched = {r["bucket"] for r in gone.select("bucket").distinct().collect()}  # BUCKETS rows at most
    kept = _buckets(spark, path, {b: v for b, v in held.items() if b in touched})
    whole = chunks if kept is None else kept.join(gone.select("source"), "source", "left_anti").select(chunks.columns).unionByName(chunks)
    version, part = before + 1, F.pmod(F.xxhash64(*[c for c in ("source", "chunk_index") if c in chunks.columns]), F.lit(files))
    placed = whole.withColumn("bucket", place).repartition("bucket", part)
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
    written = spark.read.schema(placed.schema).parquet(f"{path}/data/version={version}").select("bucket").distinct().collect()
    rows = [(b, v) for b, v in held.items() if b not in touched] + [(r["bucket"], version) for r in written]
    spark.createDataFrame(rows or [(-1, version)], "bucket int, holds int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    return version


def with_status(documents: DataFrame, statuses: DataFrame) -> DataFrame:
    """Documents with the status of statuses (source, status, details); both replace what was there."""
    new = statuses.select("source", F.col("status").alias("_status"), F.col("details").alias("_details"))
    return documents.join(new, "source", "left").select(
        *[c for c in documents.columns if c not in ("status", "details")], F.coalesce("_status", "status").alias("status"),
        F.when(F.col("_status").isNotNull(), F.col("_details")).otherwise(F.col("details")).alias("details"),
    )


def preview(found: DataFrame, **limits: int) -> DataFrame:
    """Chunks of the found documents, nothing written."""
    return chunk_documents(found, **limits)


def preview_summary(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: the documents of a preview and its chunks."""
    return found.agg(F.count("*").alias("documents")).crossJoin(F.broadcast(chunks.agg(F.count("*").alias("chunks"))))
