"""The ranking as a table function of SQL: select * from match_document_chunks(vector, 'words', 5, '{"lang": "en"}').

It reads a view of chunks with the columns of VIEW_COLUMNS and ranks by the simple analyzer: all words of the text must occur.
Ranks are limited before they meet, so each task hands on only as many rows as a leg may have.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from lectern.functions.lexical import TOKEN
from lectern.functions.variants import contains_sql
from lectern.operators.hybrid import FAQ_BOOST, FAQ_WORDS, HEADING_BOOST, PROCEDURE_BOOST, PROCEDURE_WORDS, RANK_OFFSET, RANK_WEIGHT, SOURCE_BOOST, TEXT_WEIGHT, VECTOR_WEIGHT

SHOWN = ("id", "document_id", "source", "chunk_index", "chunk_type", "section_heading", "page_start", "page_end", "content", "metadata")
VIEW_COLUMNS = (*SHOWN, "embedding")


def _dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"


def _named(c: str) -> str:
    return f"lower(query_text) LIKE concat('%', replace(lower({c}), '\\\\', '\\\\\\\\'), '%')"


def register_match_function(spark: SparkSession, view: str = "document_chunks", name: str = "match_document_chunks") -> None:
    """Create the function over a view of chunks, whose metadata is a VARIANT; an id, a vector, the text and so on as VIEW_COLUMNS says.

    Arguments: query_embedding, query_text (''), match_count (5), filter (a JSON text that metadata must contain, '{}'),
    vector_candidate_count (50), text_candidate_count (50). Ties by id. A filter that is nested in more than three levels raises.
    """
    types = {f.name: f.dataType.simpleString() for f in spark.table(view).schema}
    if missing := [c for c in VIEW_COLUMNS if c not in types]:
        raise ValueError(f"{view} has no {', '.join(missing)}")
    score = "try_divide(" + _dot("embedding", "query_embedding") + ", sqrt(" + _dot("embedding", "embedding") + ") * sqrt(" + _dot("query_embedding", "query_embedding") + "))"
    escaped = lambda pattern: pattern.replace("\\", "\\\\")
    asked = "trim(query_text) <> ''"
    body = f"""
      WITH kept AS (SELECT * FROM {view} WHERE {contains_sql("metadata", "parse_json(filter)")}),
      vector_scored AS (SELECT id, greatest(0D, coalesce({score}, 0D)) AS vector_similarity FROM kept WHERE embedding IS NOT NULL),
      vector_matches AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY vector_similarity DESC, id) AS vector_rank FROM vector_scored) WHERE vector_rank <= greatest(match_count, vector_candidate_count)),
      words AS (SELECT id, regexp_extract_all(lower(concat(coalesce(source, ''), ' ', coalesce(section_heading, ''), ' ', content)), '{TOKEN}', 0) AS tokens, split(lower(trim(query_text)), '\\\\s+') AS terms FROM kept WHERE {asked}),
      text_scored AS (SELECT id, CASE WHEN size(terms) = 1 THEN 0.1D * size(filter(tokens, t -> t = terms[0])) ELSE 0.1D END AS text_score FROM words WHERE forall(terms, t -> array_contains(tokens, t))),
      text_matches AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY text_score DESC, id) AS text_rank FROM text_scored) WHERE text_rank <= greatest(match_count, text_candidate_count)),
      legs AS (SELECT * FROM vector_matches FULL JOIN text_matches USING (id)),
      parts AS (SELECT c.*, coalesce(vector_similarity, 0D) AS vector_similarity, coalesce(least(text_score, 1D), 0D) AS text_score,
        coalesce(1D / ({RANK_OFFSET} + vector_rank), 0D) + coalesce(1D / ({RANK_OFFSET} + text_rank), 0D) AS ranks,
        CASE WHEN {asked} AND source <> '' AND {_named("regexp_replace(source, '[.][^.]+$', '')")} THEN {SOURCE_BOOST}D ELSE 0D END
        + CASE WHEN {asked} AND length(section_heading) >= 4 AND {_named("section_heading")} THEN {HEADING_BOOST}D ELSE 0D END
        + CASE WHEN chunk_type = 'faq' AND lower(query_text) RLIKE '{escaped(FAQ_WORDS)}' THEN {FAQ_BOOST}D ELSE 0D END
        + CASE WHEN chunk_type = 'procedure' AND lower(query_text) RLIKE '{escaped(PROCEDURE_WORDS)}' THEN {PROCEDURE_BOOST}D ELSE 0D END AS boost
        FROM {view} c JOIN legs USING (id)),
      fused AS (SELECT *, {VECTOR_WEIGHT}D * vector_similarity + {TEXT_WEIGHT}D * text_score + {RANK_WEIGHT}D * ranks * {RANK_OFFSET}D + boost AS similarity FROM parts)
      SELECT {", ".join(SHOWN)}, similarity FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC, vector_similarity DESC, text_score DESC, id) AS place FROM fused) WHERE place <= match_count"""
    returned = ", ".join(f"{c} {types[c]}" for c in SHOWN)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(query_embedding ARRAY<DOUBLE>, query_text STRING DEFAULT '', match_count INT DEFAULT 5, filter STRING DEFAULT '{{}}',"
        f" vector_candidate_count INT DEFAULT 50, text_candidate_count INT DEFAULT 50) RETURNS TABLE ({returned}, similarity DOUBLE) RETURN {body}"
    )
