"""Hybrid retrieval: exact vector neighbours and full-text matches, fused into one ranking.

Limits come before ranks, so a leg is one scan with a top-n in every task; ranks are given to the few rows that
are left. Both legs are joined by id to make the candidates; their size is bounded by the two limits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.lexical import english_lexeme, lexemes_of, parse_query, rank_of_places, simple_tokens, term_count
from lectern.functions.vectors import cosine_similarity, literal
from lectern.operators.text_index import TextIndex, best_of, build_text_index
from lectern.operators.vector_index import DIGITS, VectorIndex

# The weights, boosts and query words of the fused score.
VECTOR_WEIGHT, TEXT_WEIGHT, RANK_WEIGHT, RANK_OFFSET = 0.70, 0.20, 0.05, 60
SOURCE_BOOST, HEADING_BOOST, FAQ_BOOST, PROCEDURE_BOOST = 0.08, 0.05, 0.03, 0.03
FAQ_WORDS = r"\b(faq|question|answer)\b"
PROCEDURE_WORDS = r"\b(process|procedure|workflow|step|steps|how)\b"


@dataclass(frozen=True)
class Query:
    """A question: its vector, its text, how many hits, equality filters, and candidates per leg."""

    vector: list[float]
    text: str = ""
    top_k: int = 5
    filters: tuple[tuple[str, object], ...] = ()
    vector_candidates: int = 50
    text_candidates: int = 50

    def __post_init__(self) -> None:
        if self.top_k < 1:
            raise ValueError("top_k must be 1 or more")


def filtered(chunks: DataFrame, filters: tuple[tuple[str, object], ...]) -> DataFrame:
    """Conjunction of equalities, also on nested fields; an array field must contain all values of a list."""
    for name, value in filters:
        c = F.col(name)
        chunks = chunks.where(F.size(F.array_except(F.array(*map(F.lit, value)), c)) == 0 if isinstance(value, (list, tuple)) else c == F.lit(value))
    return chunks


def vector_leg(chunks: DataFrame, vector: list[float], limit: int, id_col: str = "id", embedding_col: str = "embedding") -> DataFrame:
    """(id, vector_similarity, vector_rank) of the nearest chunks, ties by id; chunks without a vector have no place in it."""
    scored = chunks.where(F.col(embedding_col).isNotNull()).select(F.col(id_col).alias("id"), cosine_similarity(F.col(embedding_col), literal(vector)).alias("vector_similarity"))
    top = scored.orderBy(F.desc("vector_similarity"), "id").limit(limit)
    return top.withColumn("vector_rank", F.row_number().over(Window.orderBy(F.desc("vector_similarity"), "id")).cast("long"))


def search_text() -> Column:
    return F.concat(F.coalesce("source", F.lit("")), F.lit(" "), F.coalesce("section_heading", F.lit("")), F.lit(" "), F.col("content"))


def simple_score(text: str) -> Callable[[Column], Column]:
    """A tenth of the term's count for one word; several words must all occur and score a tenth."""
    terms = text.lower().split()

    def score(c: Column) -> Column:
        tokens = simple_tokens(c)
        counts = [term_count(tokens, t) for t in terms]
        value = counts[0].cast("double") * 0.1 if len(terms) == 1 else F.lit(0.1)
        found = counts[0] > 0
        for n in counts[1:]:
            found = found & (n > 0)
        return F.when(found, value)

    return score


def english_index(chunks: DataFrame, only: list[str] | None = None, id_col: str = "id") -> DataFrame:
    """An inverted table (lexeme, id, places) under the english analyzer, of the lexemes of only or of all.

    Tokens are found in the JVM. For all lexemes only the vocabulary, a row for each distinct token, goes through the
    stemmer; for some, the tokens that begin like one of them: a stem is a token's beginning but for its last letter.
    """
    tokens = F.transform(simple_tokens(search_text()), lambda t, i: F.struct((i + 1).alias("place"), t.alias("token")))
    if only is not None:
        tokens = F.filter(tokens, lambda x: reduce(or_, (x["token"].startswith(lexeme[: max(1, len(lexeme) - 1)]) for lexeme in only), F.lit(False)))
    rows = chunks.select(F.col(id_col).alias("id"), F.explode(tokens).alias("t")).select("id", "t.place", "t.token")
    if only is not None:
        placed = rows.withColumn("lexeme", english_lexeme("token")).where(F.col("lexeme").isin(only))
    else:
        words = chunks.select(F.explode(F.array_distinct(simple_tokens(search_text()))).alias("token")).distinct()
        placed = rows.join(words.select("token", english_lexeme("token").alias("lexeme")).where("lexeme is not null"), "token")
    return placed.groupBy("lexeme", "id").agg(F.sort_array(F.collect_list("place")).alias("places"))


POSTING_BUCKETS = 64


def write_index(index: DataFrame, path: str) -> None:
    """Write an inverted table by a hash of its lexemes, so that a query reads the folders of its own."""
    index.withColumn("bucket", _bucket(F.col("lexeme"))).write.partitionBy("bucket").parquet(path)


def read_index(index: DataFrame, lexemes: list[str]) -> DataFrame:
    """The rows of some lexemes, of a table that write_index wrote or of one that was just made."""
    if "bucket" in index.columns:
        buckets = index.sparkSession.createDataFrame([(x,) for x in lexemes], "x string").select(_bucket(F.col("x"))).distinct().collect()
        index = index.where(F.col("bucket").isin([r[0] for r in buckets]))
    return index.where(F.col("lexeme").isin(lexemes))


def _bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(POSTING_BUCKETS)).cast("int")


def english_matches(index: DataFrame, text: str, everything: DataFrame) -> DataFrame:
    """(id, text_score) of all chunks that match a query, by the rows of its lexemes alone.

    everything has the id of every chunk; it is read only for a query of which some alternative forbids and asks nothing.
    """
    clauses = parse_query(text)
    found = read_index(index, lexemes_of(clauses)).groupBy("id").agg(F.collect_list(F.struct("lexeme", "places")).alias("found"))
    if any(not c.must for c in clauses):
        found = everything.select("id").join(found, "id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<lexeme:string,places:array<int>>>")))
    return found.select("id", rank_of_places(clauses)("found").alias("text_score")).where("text_score is not null")


def indexed_text(chunks: DataFrame, path: str, id_col: str = "id") -> TextIndex:
    """Write an index of the chunks' search text, for text_leg and hybrid_search."""
    return build_text_index(chunks, search_text(), path, id_col)


def text_leg(
    chunks: DataFrame, text: str, limit: int, analyzer: str = "english", id_col: str = "id", index: DataFrame | TextIndex | None = None, filters: tuple[tuple[str, object], ...] = ()
) -> DataFrame:
    """(id, text_score, text_rank) of the best matches, ties by id; none for a query without a word.

    chunks are filtered by filters already. index is a stored index or inverted table of all chunks, beside which chunks are read
    only where there are filters; without one the lexemes of the query are looked up in the texts.
    """
    none = chunks.select(F.col(id_col).alias("id"), F.lit(0.0).alias("text_score")).where(F.lit(False))
    if not text.strip() or (analyzer == "english" and not parse_query(text)):
        scored = none
    elif isinstance(index, TextIndex):
        allowed = chunks.select(F.col(id_col).alias("id")) if filters else None
        scored = (index.english_top if analyzer == "english" else index.simple_top)(text, limit, allowed)
    elif analyzer == "english":
        ids = chunks.select(F.col(id_col).alias("id"))
        found = english_index(chunks, lexemes_of(parse_query(text)), id_col) if index is None else index.join(ids, "id", "left_semi") if filters else index
        scored = english_matches(found, text, ids)
    else:
        scored = chunks.select(F.col(id_col).alias("id"), simple_score(text)(search_text()).alias("text_score")).where("text_score is not null")
    top = best_of(scored, limit)
    return top.withColumn("text_rank", F.row_number().over(Window.orderBy(F.desc("text_score"), "id")).cast("long"))


def candidates(vector: DataFrame, text: DataFrame) -> DataFrame:
    """Distinct ids of both legs."""
    return vector.select("id").union(text.select("id")).distinct()


def rank_fusion(rank: Column) -> Column:
    return F.coalesce(F.lit(1.0) / (rank.cast("double") + RANK_OFFSET), F.lit(0.0))


def metadata_boost(text: str) -> Column:
    """Boosts for a query that names the source or the heading, and for words that suit the chunk's type."""
    asked, lower = bool(text.strip()), F.lit(text.lower())

    def named(c: Column) -> Column:
        return F.like(lower, F.concat(F.lit("%"), F.replace(F.lower(c), F.lit("\\"), F.lit("\\\\")), F.lit("%")))

    stem = F.regexp_replace("source", r"\.[^.]+$", "")
    source = F.lit(asked) & (F.col("source") != "") & named(stem)
    heading = F.lit(asked) & (F.length("section_heading") >= 4) & named(F.col("section_heading"))
    faq = (F.col("chunk_type") == "faq") & lower.rlike(FAQ_WORDS)
    procedure = (F.col("chunk_type") == "procedure") & lower.rlike(PROCEDURE_WORDS)
    boosts = ((source, SOURCE_BOOST), (heading, HEADING_BOOST), (faq, FAQ_BOOST), (procedure, PROCEDURE_BOOST))
    return sum((F.when(c, F.lit(b)).otherwise(F.lit(0.0)) for c, b in boosts), F.lit(0.0))


def fused_score() -> Column:
    return (
        F.lit(VECTOR_WEIGHT) * F.col("vector_similarity") + F.lit(TEXT_WEIGHT) * F.col("text_score")
        + F.lit(RANK_WEIGHT) * (F.col("vector_rrf") + F.col("text_rrf")) * F.lit(float(RANK_OFFSET)) + F.col("metadata_boost")
    )


def score_candidates(chunks: DataFrame, query: Query, analyzer: str = "english", index: DataFrame | TextIndex | None = None, vectors: VectorIndex | None = None) -> DataFrame:
    """Every candidate of either leg with all parts of its score. index: a stored text index; vectors: one of vectors, read in its exact mode.

    least() passes over nulls here as in the ranking that this follows: a candidate of the vector leg alone
    has a text score of 1, one of the text leg alone a vector similarity of 0.
    """
    kept = filtered(chunks, query.filters)
    vector_limit, text_limit = max(query.top_k, query.vector_candidates), max(query.top_k, query.text_candidates)

    def vector_hits() -> DataFrame:
        if vectors is None:
            return vector_leg(kept, query.vector, vector_limit)
        return vectors.nearest(query.vector, vector_limit, exact=True, allowed=kept if query.filters else None)

    with ThreadPoolExecutor(1) as beside:  # a leg with an index asks it at once; both legs do so side by side
        waiting = beside.submit(vector_hits)
        text = text_leg(kept, query.text, text_limit, analyzer, index=index, filters=query.filters)
        vector = waiting.result()
    legs = vector.join(text, "id", "full_outer")  # the distinct union of both with their scores; each leg runs once
    if vectors is not None or isinstance(index, TextIndex):  # few ids, told to the scan of chunks: stored by id, a few row groups are read
        rows = legs.collect()  # at most the two limits together
        legs, chunks = chunks.sparkSession.createDataFrame(rows, legs.schema), chunks.where(F.col("id").isin([r["id"] for r in rows]))
    bounded = F.broadcast(legs)  # at most the two limits together
    return chunks.join(bounded, "id").select(
        *chunks.columns, F.coalesce("vector_similarity", F.lit(0.0)).alias("vector_similarity"), F.coalesce(F.least("text_score", F.lit(1.0)), F.lit(0.0)).alias("text_score"),
        rank_fusion(F.col("vector_rank")).alias("vector_rrf"), rank_fusion(F.col("text_rank")).alias("text_rrf"), metadata_boost(query.text).alias("metadata_boost"),
    ).withColumn("similarity", fused_score())


def hybrid_search(chunks: DataFrame, query: Query, analyzer: str = "english", index: DataFrame | TextIndex | None = None, vectors: VectorIndex | None = None) -> DataFrame:
    """The top_k chunks by fused score; ties by vector similarity, text score and id. index, vectors: as for score_candidates."""
    scored = score_candidates(chunks, query, analyzer, index, vectors)
    return scored.orderBy(F.desc("similarity"), F.desc("vector_similarity"), F.desc("text_score"), "id").limit(query.top_k)


def contexts(hits: DataFrame) -> DataFrame:
    """Hits as contexts of an answer: content is called text and similarity score."""
    return hits.withColumnRenamed("content", "text").withColumnRenamed("similarity", "score")


def vector_search(chunks: DataFrame, asked: DataFrame, limit: int, id_col: str = "id", embedding_col: str = "embedding", block: int = 1024) -> DataFrame:
    """(query_id, id, vector_similarity, vector_rank): the nearest chunks of every row of asked (query_id, vector).

    Queries go in blocks of block vectors; a task holds one block against its rows and keeps its own best limit of each
    query, so what is shuffled is bounded by tasks, queries and limit. Ties by id.
    """
    spark = chunks.sparkSession
    vectors = chunks.where(F.col(embedding_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(embedding_col).cast("array<double>").alias("v"))
    numbered = asked.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    ddl = "query_id long, id long, vector_similarity double"
    found, held = None, []

    def best(queries: list) -> DataFrame:
        return vectors.mapInPandas(_nearest(spark.sparkContext.broadcast(queries), limit), ddl)

    for row in numbered.toLocalIterator():  # a block of queries at a time, never all of them
        held.append((row["query_id"], row["vector"]))
        if len(held) == block:
            found, held = best(held) if found is None else found.union(best(held)), []
    if held or found is None:
        found = best(held) if found is None else found.union(best(held))
    w = Window.partitionBy("query_id").orderBy(F.desc("vector_similarity"), "id")
    return found.withColumn("vector_rank", F.row_number().over(w).cast("long")).where(F.col("vector_rank") <= limit)


def _nearest(queries: Broadcast, limit: int, rows: int = 1024):
    """Each task's best limit of every query, by products of rows vectors with all queries of the block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not queries.value:
            return
        asked = np.array([v for _, v in queries.value], float)
        names, lengths = np.array([q for q, _ in queries.value], np.int64), np.linalg.norm(asked, axis=1)
        top_id, top = np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0))
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.iloc[at : at + rows]
                v = np.stack(part["v"].to_numpy())
                if v.shape[1] != asked.shape[1]:
                    raise ValueError(f"vectors have {v.shape[1]} and queries {asked.shape[1]} dimensions")
                scale = lengths[:, None] * np.linalg.norm(v, axis=1)[None, :]
                value = np.round(np.maximum(0.0, np.divide(asked @ v.T, scale, out=np.zeros_like(scale), where=scale > 0)), DIGITS)
                top, top_id = np.hstack([top, value]), np.hstack([top_id, np.broadcast_to(part["id"].to_numpy(), value.shape)])
                order = np.lexsort((top_id, -top), axis=1)[:, :limit]
                top, top_id = np.take_along_axis(top, order, 1), np.take_along_axis(top_id, order, 1)
        yield pd.DataFrame({"query_id": np.repeat(names, top.shape[1]), "id": top_id.ravel(), "vector_similarity": top.ravel()})

    return run


#: Characters whose tokens one task of postings groups.
POSTINGS_CHARS = 8 << 20


def postings(chunks: DataFrame, id_col: str = "id", only: list[str] | None = None) -> DataFrame:
    """An inverted table (lexeme, id, tf, positions) of all lexemes or of only, to be written partitioned by a hash of the lexeme.

    Texts are dealt by id to tasks of a bounded size, so their tokens are grouped where they are.
    """
    chars = chunks.agg(F.sum(F.length("content").cast("long"))).first()[0] or 0
    dealt = chunks.select(F.col(id_col).alias("id"), "source", "section_heading", "content").repartition(max(1, -(-chars // POSTINGS_CHARS)), "id")
    tokens = dealt.select("id", F.posexplode(simple_tokens(search_text())).alias("position", "lexeme"))
    if only is not None:
        tokens = tokens.where(F.col("lexeme").isin(only))
    return tokens.groupBy("lexeme", "id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list(F.col("position") + 1)).alias("positions"))


def postings_match(index: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """(id, matched, tf) of the chunks that hold all terms, read from the postings of those terms alone."""
    wanted = sorted(set(terms))
    found = index.where(F.col("lexeme").isin(wanted)).groupBy("id").agg(F.count("*").alias("matched"), F.sum("tf").alias("tf"))
    return found.where(F.col("matched") == len(wanted)).orderBy(F.desc("tf"), "id").limit(limit)
