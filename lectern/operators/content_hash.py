"""Hash trees of documents: what of a document has changed, found without comparing its texts, and vectors kept for what has not.

A leaf is the hash of a chunk's content with its heading and type; a document's root is the hash of its leaves in order. Documents with
equal roots are alike and are looked at no further; in the others chunks are paired by leaf. Equal chunks of one document are
paired one to one in their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ingest import chunk_rows

#: What a leaf is made of.
LEAF = ("chunk_type", "section_heading", "content")


def leaf_hash(columns: tuple[str, ...] = LEAF) -> Column:
    """The hash of a chunk; lengths stand before the parts, so that no two different chunks read alike."""
    parts = [F.concat(F.coalesce(F.length(c), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(c, F.lit(""))) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def with_leaves(chunks: DataFrame) -> DataFrame:
    """Chunks with their leaf and its number among equal leaves of the document; only columns that are there make up a leaf."""
    leaf = leaf_hash(tuple(c for c in LEAF if c in chunks.columns))
    return chunks.withColumn("leaf", leaf).withColumn("nth", F.row_number().over(Window.partitionBy("source", "leaf").orderBy("chunk_index")))


def roots(leaves: DataFrame) -> DataFrame:
    """(source, root, chunks): a row for each document. A document's leaves, 64 letters each, meet in one row."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "leaf"))), lambda x: x["leaf"])
    return leaves.groupBy("source").agg(F.sha2(F.array_join(ordered, ""), 256).alias("root"), F.count("*").alias("chunks"))


def changed_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source, state): which of the documents of two sets of roots are new, changed, gone or alike."""
    both = old.select("source", F.col("root").alias("was")).join(new.select("source", F.col("root").alias("now")), "source", "full_outer")
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("was") == F.col("now"), "alike").otherwise("changed")
    return both.select("source", state.alias("state"))


def chunk_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source, kept, added, gone): chunks of every document of two versions, paired by leaf where roots differ."""
    old, new = with_leaves(old), with_leaves(new)
    was, now = roots(old), roots(new)
    states = changed_documents(was, now)
    alike = states.where("state = 'alike'").join(now, "source").select("source", F.col("chunks").alias("kept"), F.lit(0).cast("long").alias("added"), F.lit(0).cast("long").alias("gone"))
    differ = states.where("state <> 'alike'").select("source")
    key = ["source", "leaf", "nth"]
    a, b = (x.join(differ, "source", "left_semi").select(*key, F.lit(True).alias(n)) for x, n in ((old, "a"), (new, "b")))
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    pairs = a.join(b, key, "full_outer").groupBy("source").agg(count(F.col("a") & F.col("b"), "kept"), count(F.col("a").isNull(), "added"), count(F.col("b").isNull(), "gone"))
    return alike.unionByName(pairs)


def refreshed_rows(stored_rows: DataFrame, chunks: DataFrame, embed: Callable[[Column], Column], dimensions: int | None = None) -> DataFrame:
    """Chunk rows of chunks: those whose leaf stored_rows has for the document take its vector, and only the others are embedded."""
    key, names = ["source", "leaf", "nth"], chunks.columns
    fresh = with_leaves(chunks)
    known = with_leaves(stored_rows).where("embedding is not null").select(*key, F.col("embedding").alias("_vector"))
    paired = fresh.join(known, key, "left")
    made = chunk_rows(paired.where("_vector is null").select(names), embed, dimensions)
    ids = chunk_rows(paired.where("_vector is not null"), lambda _: F.col("_vector"), dimensions)
    return made.unionByName(ids.select(made.columns))
