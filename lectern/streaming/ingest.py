"""Extension: ingest as a stream of files. Each run takes the files that came since the last and ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.chunking import chunk_documents
from lectern.operators.ingest import chunk_rows, hashed_embedding, replace_chunks
from lectern.sources.files import EXTENSIONS, documents, parse_files


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder as (path, name, kind, length, content)."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), kind.alias("kind"), "length", "content").where(F.col("kind").isin(*EXTENSIONS))


def start_ingest(spark: SparkSession, path: str, chunks_path: str, checkpoint: str, embed=None) -> StreamingQuery:
    """Chunk and embed what is new under path and write it to chunks_path; a batch that runs again writes the same rows."""

    def write(batch: DataFrame, _: int) -> None:
        chunks = chunk_documents(documents(parse_files(batch)))
        replace_chunks(chunk_rows(chunks, embed or hashed_embedding()), chunks_path, batch.select(F.col("name").alias("source")))

    return file_stream(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window of their time; what is later than the watermark is left out."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")
