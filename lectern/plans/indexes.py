"""The stored indexes that retrieval queries read. They are written once for the tables of a folder and used until those change."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import hybrid
from lectern.operators.text_index import TextIndex
from lectern.operators.vector_index import VectorIndex, build_vector_index
from lectern.sources.scratch import scratch_path


@dataclass(frozen=True)
class Indexes:
    """A table of chunks in the order of their ids, an index of their texts and one of their vectors."""

    chunks: DataFrame
    text: TextIndex
    vectors: VectorIndex


_BUILT: dict[tuple, Indexes] = {}


def write_chunks(chunks: DataFrame, path: str, id_col: str = "id") -> DataFrame:
    """Chunks in ranges of their ids, so that a few ids are read from a few row groups."""
    chunks.repartitionByRange(id_col).sortWithinPartitions(id_col).write.option("compression", "zstd").parquet(path)  # as many files as shuffles have partitions, small ones together
    return chunks.sparkSession.read.parquet(path)


def build(chunks: DataFrame) -> Indexes:
    """Write all three to fresh folders of the shared folder."""
    spark = chunks.sparkSession
    kept = write_chunks(chunks, scratch_path(spark, "chunks"))
    return Indexes(kept, hybrid.indexed_text(kept, scratch_path(spark, "text-index")), build_vector_index(kept, scratch_path(spark, "vector-index")))


def state_of(tables: list[DataFrame]) -> tuple:
    """What tells a change of files: how many there are and a digest of their names, sizes and times."""
    files = reduce(DataFrame.union, (t.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time") for t in tables)).distinct()
    return tuple(files.agg(F.count("*"), F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time"))).first())


def indexes_of(chunks: DataFrame, tables: list[DataFrame], name: str) -> Indexes:
    """The indexes of chunks made from these tables; built where there are none of their present state."""
    key = (chunks.sparkSession.sparkContext.applicationId, name, *state_of(tables))
    if key not in _BUILT:
        _BUILT[key] = build(chunks)
    return _BUILT[key]
