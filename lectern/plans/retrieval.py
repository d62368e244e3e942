"""Queries of stored indexes, the table function, nested filters, the document source and hash trees, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.variants import contains
from lectern.operators import content_hash, hybrid
from lectern.operators.table_function import register_match_function
from lectern.operators.vector_index import build_vector_index
from lectern.sources import files, packed
from lectern.sources.scratch import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Cells that the given vectors are dealt into: more than so few rows need, so that bounds are at work.
CELLS = 32


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


def vector_index_exact(spark, sf_dir):
    """L1: the ten nearest of every vector whose id is divisible by 50, by the index and its bounds."""
    vectors = _table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    index = build_vector_index(vectors, scratch_path(spark, "vector-index"), cells=CELLS)
    return index.search(_asked(vectors), 10, exact=True).select("query_id", "id", F.round("vector_similarity", 6).alias("similarity"))


def vector_index_search(spark, sf_dir):
    """L1: the same from the nearest cells alone; recall is held against the exact search in tests."""
    vectors = _table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    index = build_vector_index(vectors, scratch_path(spark, "vector-index"), cells=CELLS)
    return index.search(_asked(vectors), 10).select("query_id", "id", F.round("vector_similarity", 6).alias("similarity"))


def vector_index_cells(spark, sf_dir):
    """L1: every vector is indexed once; the cells' counts add up."""
    vectors = _table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    index = build_vector_index(vectors, scratch_path(spark, "vector-index"), cells=CELLS)
    counted = index.rows.agg(F.count("*").alias("vectors"), F.count_distinct("id").alias("ids"), F.sum("id").alias("id_sum"))
    return counted.join(index.cells.agg(F.sum("rows").alias("cell_rows")))


def text_index_rows(spark, sf_dir):
    """P5, L2: how often each token is stored, in how many chunks, and most in one, read from a fresh index."""
    docs = _table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit("").alias("source"), F.lit("").alias("section_heading"))
    index = hybrid.indexed_text(docs, scratch_path(spark, "text-index"))
    places = F.aggregate("places", F.lit(0).cast("long"), lambda s, p: s + F.size(p))
    rows = index.postings.select("token", F.size("ids").alias("n"), places.alias("tf"), "most")
    return rows.groupBy("token").agg(F.sum("n").alias("chunks"), F.sum("tf").alias("tf"), F.max("most").alias("most"))


def _metadata(c: str) -> str:
    """A nested document for a row of documents."""
    return (
        f"to_json(named_struct('lang', lang, 'origin', named_struct('parts', array(doc_id % 3, doc_id % 5, 7), 'source', source),"
        f" 'tags', array(named_struct('k', 'size', 'v', {c}.n_chars % 4), named_struct('k', lang, 'v', {c}.doc_id % 2))))"
    )


FILTERS = {
    "all": {}, "flat": {"lang": "en"}, "nested": {"origin": {"source": "src3"}}, "array": {"origin": {"parts": [2, 7]}},
    "objects": {"tags": [{"v": 1, "k": "size"}]}, "both": {"lang": "de", "tags": [{"k": "de", "v": 1}]}, "empty": {"origin": {"parts": []}, "tags": [{}]}, "missing": {"origin": {"nothing": 1}},
}


def metadata_contains(spark, sf_dir):
    """Documents whose metadata contains a filter, for objects, arrays and their nestings."""
    docs = _table(spark, sf_dir, "documents").alias("d").select("doc_id", F.parse_json(F.expr(_metadata("d"))).alias("metadata"))
    return docs.select("doc_id", *[contains(F.col("metadata"), f).alias(n) for n, f in FILTERS.items()])


def _chunk_view(spark: SparkSession, sf_dir: str) -> None:
    docs, vectors = _table(spark, sf_dir, "documents").where("text is not null").alias("d"), _table(spark, sf_dir, "embeddings")
    kind = F.element_at(F.array(*map(F.lit, ("section", "faq", "procedure"))), (F.col("doc_id") % 3 + 1).cast("int"))
    docs.join(vectors, docs["doc_id"] == vectors["vec_id"], "left").select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 10).alias("document_id"), F.concat("source", F.lit(".txt")).alias("source"), F.col("doc_id").cast("int").alias("chunk_index"), kind.alias("chunk_type"),
        F.substring_index("text", " ", 2).alias("section_heading"), (F.col("doc_id") % 7).cast("int").alias("page_start"), (F.col("doc_id") % 7 + 1).cast("int").alias("page_end"), F.col("text").alias("content"),
        F.parse_json(F.expr(_metadata("d"))).alias("metadata"), "embedding",
    ).createOrReplaceTempView("document_chunks")


#: What the table function is asked: a word, how many hits, and a filter on nested metadata.
WORD, HITS, NESTED = "that", 7, '{"origin": {"parts": [2]}}'


def match_document_chunks(spark, sf_dir):
    """The ranking as a table function called from SQL with all six arguments."""
    _chunk_view(spark, sf_dir)
    register_match_function(spark)
    asked = _table(spark, sf_dir, "embeddings").where("vec_id = 7").select("embedding").head()[0]
    vector = "array(" + ", ".join(f"{float(x)!r}D" for x in asked) + ")"
    return spark.sql(
        f"SELECT id, document_id, source, chunk_index, chunk_type, section_heading, page_start, page_end, content, to_json(metadata) AS metadata, round(similarity, 6) AS similarity"
        f" FROM match_document_chunks({vector}, '{WORD}', {HITS}, '{NESTED}', 40, 30)"
    )


def packed_documents(spark, sf_dir):
    """Text files that are read as documents by a data source, packed into partitions by size."""
    path = scratch_path(spark, "texts")
    line = F.format_string("%s lies in region %d\r\n\r\n\r\n\r\nnumber\t\t%d ", "n_name", "n_regionkey", "n_nationkey")
    _table(spark, sf_dir, "nation").select(line.alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(f"{path}/deep/er")
    docs = files.documents(packed.read_parsed(spark, path, recursive=True, partitionBytes=200))
    return docs.select("kind", "title", "page_count", F.col("pages")[0]["text"].alias("text"), F.size("pages").alias("pages"))


def streamed_documents(spark, sf_dir):
    """The same files read as a stream by the data source, in several batches."""
    path, out = scratch_path(spark, "texts"), scratch_path(spark, "streamed")
    line = F.format_string("%s lies in region %d\r\n\r\n\r\n\r\nnumber\t\t%d ", "n_name", "n_regionkey", "n_nationkey")
    _table(spark, sf_dir, "nation").select(line.alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(f"{path}/deep/er")
    rows = packed.stream_parsed(spark, path, recursive=True, maxBytes=400, settleSeconds=0)
    query = rows.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "marks")).option("path", out).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    docs = files.documents(spark.read.schema(rows.schema).parquet(out))
    return docs.select("kind", "title", "page_count", F.col("pages")[0]["text"].alias("text"), F.size("pages").alias("pages"))


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two versions of chunks: an order each, its customer the document; some are changed, some are gone, some are new."""
    rows = _table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), "o_custkey", F.col("o_orderkey").alias("chunk_index"), F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("content"))
    old = rows.where("chunk_index % 11 <> 0 and o_custkey % 17 <> 0")
    new = rows.where("o_custkey % 13 <> 0 and (o_custkey % 3 <> 0 or chunk_index % 7 <> 0)").withColumn("content", F.when(F.expr("o_custkey % 3 = 0 and chunk_index % 5 = 0"), F.concat(F.lit("again "), "content")).otherwise(F.col("content")))
    return old.drop("o_custkey"), new.drop("o_custkey")


def changed_chunks(spark, sf_dir):
    """K2, content hash: chunks of every document that are kept, added and gone between two versions, by hash trees."""
    return content_hash.chunk_changes(*_versions(spark, sf_dir))


def refreshed_chunks(spark, sf_dir):
    """K2, content hash: rows of the newer version: vectors of chunks that have not changed are taken over, others are made."""
    old, new = _versions(spark, sf_dir)
    constant = lambda x, y: lambda _: F.array(F.lit(x), F.lit(y))
    held = content_hash.chunk_rows(old, constant(3.0, 4.0))
    rows = content_hash.refreshed_rows(held, new, constant(1.0, 0.0))
    return rows.select("source", "chunk_index", "content", F.round(F.col("embedding")[0], 6).alias("first"))


_VERSIONS = """orders_of AS (SELECT 'c' || o_custkey AS source, o_custkey AS k, o_orderkey AS n, o_orderstatus || o_orderkey AS content FROM orders),
    old AS (SELECT source, n, content FROM orders_of WHERE n % 11 <> 0 AND k % 17 <> 0),
    new AS (SELECT source, n, CASE WHEN k % 3 = 0 AND n % 5 = 0 THEN 'again ' ELSE '' END || content AS content FROM orders_of WHERE k % 13 <> 0 AND (k % 3 <> 0 OR n % 7 <> 0))"""
_NATIONS = "SELECT 'txt' AS kind, n_name || ' lies in region ' || n_regionkey AS title, CAST(NULL AS INT) AS page_count, n_name || ' lies in region ' || n_regionkey || chr(10) || chr(10) || 'number ' || n_nationkey AS text, 1 AS pages FROM nation"
_JSON = """json_object('lang', lang, 'origin', json_object('parts', [doc_id % 3, doc_id % 5, 7], 'source', source), 'tags', [json_object('k', 'size', 'v', n_chars % 4), json_object('k', lang, 'v', doc_id % 2)])"""

QUERIES = {
    f.__name__: f
    for f in (vector_index_exact, vector_index_search, vector_index_cells, text_index_rows, metadata_contains, match_document_chunks, packed_documents, streamed_documents, changed_chunks, refreshed_chunks)
}
ORACLES = {
    "vector_index_exact": """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0),
        s AS (SELECT query_id, vec_id AS id, greatest(0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv)) AS vs FROM embeddings, q)
        SELECT query_id, id, round(vs, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(vs, 9) DESC, id) AS n FROM s) WHERE n <= 10""",
    "vector_index_cells": "SELECT count(*) AS vectors, count(DISTINCT vec_id) AS ids, CAST(sum(vec_id) AS BIGINT) AS id_sum, count(*) AS cell_rows FROM embeddings",
    "text_index_rows": """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents), p AS (SELECT token, doc_id, count(*) AS n FROM t GROUP BY ALL)
        SELECT token, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS tf, CAST(max(n) AS INT) AS most FROM p GROUP BY token""",
    "metadata_contains": f"WITH m AS (SELECT doc_id, {_JSON} AS j, * EXCLUDE (doc_id) FROM documents) SELECT doc_id, "
    + ", ".join(f"json_contains(j, '{text}') AS \"{name}\"" for name, text in {
        "all": "{}", "flat": '{"lang": "en"}', "nested": '{"origin": {"source": "src3"}}', "array": '{"origin": {"parts": [2, 7]}}', "objects": '{"tags": [{"v": 1, "k": "size"}]}',
        "both": '{"lang": "de", "tags": [{"k": "de", "v": 1}]}', "empty": '{"origin": {"parts": []}, "tags": [{}]}', "missing": '{"origin": {"nothing": 1}}',
    }.items()) + " FROM m",
    "match_document_chunks": f"""WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 7),
        chunks AS (SELECT doc_id AS id, doc_id % 10 AS document_id, source || '.txt' AS source, CAST(doc_id AS INT) AS chunk_index, ['section', 'faq', 'procedure'][doc_id % 3 + 1] AS chunk_type,
            array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') AS section_heading, CAST(doc_id % 7 AS INT) AS page_start, CAST(doc_id % 7 + 1 AS INT) AS page_end, text AS content,
            CAST({_JSON} AS VARCHAR) AS metadata, embedding FROM documents LEFT JOIN embeddings ON doc_id = vec_id WHERE text IS NOT NULL),
        kept AS (SELECT * FROM chunks WHERE chunk_index % 3 = 2 OR chunk_index % 5 = 2),
        v AS (SELECT id, greatest(0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[]))) AS vs FROM kept, q WHERE embedding IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 40),
        vm AS (SELECT *, row_number() OVER (ORDER BY vs DESC, id) AS vr FROM v),
        t AS (SELECT id, CAST(len(list_filter(tk, lambda x: x = '{WORD}')) AS DOUBLE) * 0.1::DOUBLE AS ts FROM (SELECT id, regexp_extract_all(lower(coalesce(source, '') || ' ' || coalesce(section_heading, '') || ' ' || content), '[a-z0-9]+') AS tk FROM kept)
            WHERE list_contains(tk, '{WORD}') ORDER BY 2 DESC, 1 LIMIT 30),
        tm AS (SELECT *, row_number() OVER (ORDER BY ts DESC, id) AS tr FROM t),
        f AS (SELECT c.*, coalesce(vs, 0) AS vs, coalesce(least(ts, 1), 0) AS ts, coalesce(1.0::DOUBLE / (60 + vr), 0) + coalesce(1.0::DOUBLE / (60 + tr), 0) AS ranks,
            CASE WHEN '{WORD}' LIKE '%' || lower(regexp_replace(source, '\\.[^.]+$', '')) || '%' THEN 0.08::DOUBLE ELSE 0 END
            + CASE WHEN length(section_heading) >= 4 AND '{WORD}' LIKE '%' || lower(section_heading) || '%' THEN 0.05::DOUBLE ELSE 0 END AS boost
            FROM chunks c JOIN (SELECT id FROM vm UNION SELECT id FROM tm) USING (id) LEFT JOIN vm USING (id) LEFT JOIN tm USING (id))
        SELECT id, document_id, source, chunk_index, chunk_type, section_heading, page_start, page_end, content, metadata, round(0.70::DOUBLE * vs + 0.20::DOUBLE * ts + 0.05::DOUBLE * ranks * 60::DOUBLE + boost, 6) AS similarity
        FROM f ORDER BY 0.70::DOUBLE * vs + 0.20::DOUBLE * ts + 0.05::DOUBLE * ranks * 60::DOUBLE + boost DESC, vs DESC, ts DESC, id LIMIT {HITS}""",
    "packed_documents": _NATIONS,
    "streamed_documents": _NATIONS,
    "changed_chunks": f"""WITH {_VERSIONS} SELECT coalesce(a.source, b.source) AS source, count(CASE WHEN a.content = b.content THEN 1 END) AS kept, count(CASE WHEN b.n IS NOT NULL AND a.content IS DISTINCT FROM b.content THEN 1 END) AS added,
        count(CASE WHEN a.n IS NOT NULL AND a.content IS DISTINCT FROM b.content THEN 1 END) AS gone FROM old a FULL JOIN new b ON a.source = b.source AND a.n = b.n GROUP BY 1""",
    "refreshed_chunks": f"WITH {_VERSIONS} SELECT b.source, b.n AS chunk_index, b.content, CASE WHEN a.n IS NULL THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS first FROM new b LEFT JOIN old a ON a.source = b.source AND a.n = b.n AND a.content = b.content",
}
