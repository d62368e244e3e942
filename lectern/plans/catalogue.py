"""The queries that the engine registers and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.vectors import l2_normalize
from lectern.operators import chunking, conversation, hybrid, ingest, records
from lectern.plans import manuals, retrieval, tables
from lectern.plans.indexes import indexes_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = manuals.QUERIES | tables.QUERIES | retrieval.QUERIES
ORACLES: dict[str, str] = manuals.ORACLES | tables.ORACLES | retrieval.ORACLES


def query(oracle: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The question that the retrieval queries ask, and the row whose vector they ask with.
TERM, QUESTION, ASKED = "that", "how the src3 step faq", 7


def asked_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector, as a caller would pass it: one row, read by its key."""
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == ASKED).select("embedding").head()[0])


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks, with embeddings where there are any; type and heading come from the id and the text. Null texts have no chunk."""
    docs, vectors = table(spark, sf_dir, "documents").where("text is not null"), table(spark, sf_dir, "embeddings")
    kind = F.element_at(F.array(*map(F.lit, ("section", "faq", "procedure"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs.join(vectors, docs["doc_id"] == vectors["vec_id"], "left").select(
        F.col("doc_id").alias("id"), F.concat("source", F.lit(".txt")).alias("source"), kind.alias("chunk_type"), F.substring_index("text", " ", 2).alias("section_heading"),
        F.col("text").alias("content"), "label", "embedding",
    )


def indexed(spark: SparkSession, sf_dir: str):
    """The chunks with stored indexes of their texts and vectors, written once for the tables as they are."""
    return indexes_of(chunks_of(spark, sf_dir), [table(spark, sf_dir, n) for n in ("documents", "embeddings")], sf_dir)


_CHUNKS = f"""
    q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = {ASKED}),
    chunks AS (SELECT doc_id AS id, source || '.txt' AS source, ['section', 'faq', 'procedure'][doc_id % 3 + 1] AS chunk_type,
        array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') AS section_heading, text AS content, label, embedding
        FROM documents LEFT JOIN embeddings ON doc_id = vec_id WHERE text IS NOT NULL)"""
_SIM = "greatest(0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])))"
_TOKENS = "regexp_extract_all(lower(coalesce(source, '') || ' ' || coalesce(section_heading, '') || ' ' || content), '[a-z0-9]+')"


def _legs(match: str, score: str, where: str = "true", k: int = 50) -> str:
    return f"""{_CHUNKS},
    v AS (SELECT id, {_SIM} AS vector_similarity FROM chunks, q WHERE embedding IS NOT NULL AND {where} ORDER BY 2 DESC, 1 LIMIT {k}),
    vm AS (SELECT *, row_number() OVER (ORDER BY vector_similarity DESC, id) AS vector_rank FROM v),
    t AS (SELECT id, {score} AS text_score FROM (SELECT id, {_TOKENS} AS tk FROM chunks WHERE {where}) WHERE {match} ORDER BY 2 DESC, 1 LIMIT {k}),
    tm AS (SELECT *, row_number() OVER (ORDER BY text_score DESC, id) AS text_rank FROM t)"""


_ONE = (f"list_contains(tk, '{TERM}')", f"CAST(len(list_filter(tk, lambda x: x = '{TERM}')) AS DOUBLE) * 0.1::DOUBLE")


def _hybrid(question: str, match: str, score: str, where: str = "true", k: int = 10) -> str:
    lower, asked = question.lower(), "true" if question.strip() else "false"
    return f"""WITH {_legs(match, score, where)},
    cand AS (SELECT id FROM vm UNION SELECT id FROM tm),
    scored AS (SELECT c.*, coalesce(vector_similarity, 0) AS vs, coalesce(least(text_score, 1), 0) AS ts,
        coalesce(1.0::DOUBLE / (60 + vector_rank), 0) AS vr, coalesce(1.0::DOUBLE / (60 + text_rank), 0) AS tr,
        CASE WHEN {asked} AND '{lower}' LIKE '%' || lower(regexp_replace(source, '\\.[^.]+$', '')) || '%' THEN 0.08::DOUBLE ELSE 0::DOUBLE END
        + CASE WHEN {asked} AND length(section_heading) >= 4 AND '{lower}' LIKE '%' || lower(section_heading) || '%' THEN 0.05::DOUBLE ELSE 0::DOUBLE END
        + CASE WHEN chunk_type = 'faq' AND regexp_matches('{lower}', '\\b(faq|question|answer)\\b') THEN 0.03::DOUBLE ELSE 0::DOUBLE END
        + CASE WHEN chunk_type = 'procedure' AND regexp_matches('{lower}', '\\b(process|procedure|workflow|step|steps|how)\\b') THEN 0.03::DOUBLE ELSE 0::DOUBLE END AS boost
        FROM chunks c JOIN cand USING (id) LEFT JOIN vm USING (id) LEFT JOIN tm USING (id)),
    fused AS (SELECT *, 0.70::DOUBLE * vs + 0.20::DOUBLE * ts + 0.05::DOUBLE * (vr + tr) * 60::DOUBLE + boost AS similarity FROM scored)
    SELECT id, source, chunk_type, round(vs, 6) AS vector_similarity, round(ts, 6) AS text_score, round(boost, 6) AS boost, round(similarity, 6) AS similarity
    FROM fused ORDER BY fused.similarity DESC, vs DESC, ts DESC, id LIMIT {k}"""


def _shown(hits: DataFrame) -> DataFrame:
    rounded = [F.round(c, 6).alias(n) for c, n in (("vector_similarity", "vector_similarity"), ("text_score", "text_score"), ("metadata_boost", "boost"), ("similarity", "similarity"))]
    return hits.select("id", "source", "chunk_type", *rounded)


# Vectors and full text


@query(f"WITH {_CHUNKS} SELECT vec_id AS id, round({_SIM}, 6) AS similarity FROM embeddings, q WHERE embedding IS NOT NULL ORDER BY {_SIM} DESC, 1 LIMIT 50")
def vector_topk(spark, sf_dir):
    """V2, V3, L1: the nearest vectors."""
    return hybrid.vector_leg(table(spark, sf_dir, "embeddings"), asked_vector(spark, sf_dir), 50, "vec_id").select("id", F.round("vector_similarity", 6).alias("similarity"))


@query(f"WITH {_CHUNKS}, t AS (SELECT vec_id AS id, {_SIM} AS s FROM embeddings, q ORDER BY 2 DESC, 1 LIMIT 50) SELECT id, row_number() OVER (ORDER BY s DESC, id) AS vector_rank FROM t")
def vector_rank(spark, sf_dir):
    """Ranks of the nearest vectors."""
    return hybrid.vector_leg(table(spark, sf_dir, "embeddings"), asked_vector(spark, sf_dir), 50, "vec_id").select("id", "vector_rank")


@query(f"WITH {_CHUNKS} SELECT vec_id AS id, round({_SIM}, 6) AS similarity FROM embeddings, q WHERE label = 3 ORDER BY {_SIM} DESC, 1 LIMIT 20")
def vector_filtered_topk(spark, sf_dir):
    """The filter goes before the top-n."""
    kept = hybrid.filtered(table(spark, sf_dir, "embeddings"), (("label", 3),))
    return hybrid.vector_leg(kept, asked_vector(spark, sf_dir), 20, "vec_id").select("id", F.round("vector_similarity", 6).alias("similarity"))


@query(
    """SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / n)), 6) AS total, round(sqrt(list_sum(list_transform(e, lambda x: (x / n) * (x / n)))), 6) AS length
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings)"""
)
def l2_normalized(spark, sf_dir):
    """V1: vectors at length one."""
    unit = table(spark, sf_dir, "embeddings").select("vec_id", l2_normalize(F.col("embedding")).alias("e"))
    total = lambda f: F.aggregate(F.transform("e", f), F.lit(0.0), lambda s, x: s + x)
    return unit.select("vec_id", F.round(total(lambda x: x), 6).alias("total"), F.round(F.sqrt(total(lambda x: x * x)), 6).alias("length"))


@query(f"WITH {_legs(*_ONE)} SELECT id, round(text_score, 6) AS text_score, text_rank FROM tm")
def lexical_topk_simple(spark, sf_dir):
    """The best matches of one term."""
    return hybrid.text_leg(chunks_of(spark, sf_dir), TERM, 50, "simple").select("id", F.round("text_score", 6).alias("text_score"), "text_rank")


@query(f"WITH {_legs("list_contains(tk, 'that') AND list_contains(tk, 'with') AND list_contains(tk, 'for')", '0.1::DOUBLE')} SELECT id FROM tm")
def lexical_and_simple(spark, sf_dir):
    """Chunks that hold all terms."""
    return hybrid.text_leg(chunks_of(spark, sf_dir), "that with for", 50, "simple").select("id")


@query(
    f"""WITH {_CHUNKS}, p AS (SELECT id, unnest({_TOKENS}) AS lexeme FROM chunks)
    SELECT lexeme, count(*) AS tf, count(DISTINCT id) AS chunks FROM p GROUP BY lexeme"""
)
def postings_stats(spark, sf_dir):
    """The inverted table's terms with their occurrences and chunks."""
    return hybrid.postings(chunks_of(spark, sf_dir)).groupBy("lexeme").agg(F.sum("tf").alias("tf"), F.count("*").alias("chunks"))


@query(
    f"""WITH {_CHUNKS}, p AS (SELECT id, {_TOKENS} AS tk FROM chunks)
    SELECT id, CAST(2 AS BIGINT) AS matched, len(list_filter(tk, lambda x: x IN ('that', 'with'))) AS tf FROM p
    WHERE list_contains(tk, 'that') AND list_contains(tk, 'with') ORDER BY tf DESC, id LIMIT 50"""
)
def postings_search(spark, sf_dir):
    """P5, L2: chunks that hold all terms, by the stored index."""
    found = indexed(spark, sf_dir).text.count_top(["that", "with"], 50)
    return found.select("id", F.lit(2).cast("long").alias("matched"), F.col("text_score").cast("int").alias("tf"))


@query(f"WITH {_legs(*_ONE)} SELECT id FROM vm UNION SELECT id FROM tm")
def candidate_union(spark, sf_dir):
    """Distinct ids of both legs."""
    chunks = chunks_of(spark, sf_dir)
    return hybrid.candidates(hybrid.vector_leg(chunks, asked_vector(spark, sf_dir), 50), hybrid.text_leg(chunks, TERM, 50, "simple"))


@query(
    f"""WITH {_legs(*_ONE)} SELECT id, round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0), 8) AS vector_rrf, round(coalesce(1.0::DOUBLE / (60 + text_rank), 0), 8) AS text_rrf
    FROM vm FULL JOIN tm USING (id)"""
)
def rrf_scores(spark, sf_dir):
    """Reciprocal ranks of every candidate."""
    scored = hybrid.score_candidates(chunks_of(spark, sf_dir), hybrid.Query(asked_vector(spark, sf_dir), TERM, 10), "simple")
    return scored.select("id", F.round("vector_rrf", 8).alias("vector_rrf"), F.round("text_rrf", 8).alias("text_rrf"))


@query(
    f"""WITH {_CHUNKS} SELECT id, round(CASE WHEN '{QUESTION}' LIKE '%' || lower(regexp_replace(source, '\\.[^.]+$', '')) || '%' THEN 0.08::DOUBLE ELSE 0 END
    + CASE WHEN length(section_heading) >= 4 AND '{QUESTION}' LIKE '%' || lower(section_heading) || '%' THEN 0.05::DOUBLE ELSE 0 END
    + CASE WHEN chunk_type IN ('faq', 'procedure') THEN 0.03::DOUBLE ELSE 0 END, 6) AS boost FROM chunks"""
)
def metadata_boost(spark, sf_dir):
    """Boosts of every chunk for a question that names a source and both types."""
    return chunks_of(spark, sf_dir).select("id", F.round(hybrid.metadata_boost(QUESTION), 6).alias("boost"))


@query(_hybrid(TERM, *_ONE))
def hybrid_search(spark, sf_dir):
    """The fused ranking."""
    return _shown(hybrid.hybrid_search(chunks_of(spark, sf_dir), hybrid.Query(asked_vector(spark, sf_dir), TERM, 10), "simple"))


@query(_hybrid("how src3 faq", "list_contains(tk, 'how') AND list_contains(tk, 'src3') AND list_contains(tk, 'faq')", "0.1::DOUBLE"))
def hybrid_boosted(spark, sf_dir):
    """The fused ranking of a question that boosts a source and types."""
    return _shown(hybrid.hybrid_search(chunks_of(spark, sf_dir), hybrid.Query(asked_vector(spark, sf_dir), "how src3 faq", 10), "simple"))


@query(_hybrid(TERM, *_ONE, where="label = 3"))
def hybrid_filtered(spark, sf_dir):
    """The fused ranking under a filter of both legs."""
    return _shown(hybrid.hybrid_search(chunks_of(spark, sf_dir), hybrid.Query(asked_vector(spark, sf_dir), TERM, 10, (("label", 3),)), "simple"))


@query(_hybrid("", "false", "0.0::DOUBLE"))
def hybrid_blank_query(spark, sf_dir):
    """A blank question has no text leg and no boost of names."""
    return _shown(hybrid.hybrid_search(chunks_of(spark, sf_dir), hybrid.Query(asked_vector(spark, sf_dir), "  ", 10), "simple"))


#: A question for the english analyzer and the tokens of the given tables that its two lexemes stand for.
ENGLISH = "tions esnted"
_ENDINGS = "(s|ed|es|ing|ly|(ed|ing)(ly)?|ly(ed|ing|s)?)?"
_STEMS = f"CASE WHEN regexp_full_match(token, 'tion{_ENDINGS}') THEN 'tion' WHEN regexp_full_match(token, 'esnt{_ENDINGS}') THEN 'esnt' END"
_PLACES = f"""tokens AS (SELECT id, unnest(tk) AS token, unnest(range(1, len(tk) + 1)) AS place FROM (SELECT id, {_TOKENS} AS tk FROM chunks)),
    found AS (SELECT id, {_STEMS} AS lexeme, place FROM tokens WHERE {_STEMS} IS NOT NULL)"""
_COVERS = """steps AS (SELECT id, place - lag(place) OVER w AS gap, lexeme <> lag(lexeme) OVER w AS cover FROM found WINDOW w AS (PARTITION BY id ORDER BY place)),
    ranked AS (SELECT id, round(CAST(CAST(sum(0.1::DOUBLE / gap) AS FLOAT) AS DOUBLE), 6) AS text_score FROM steps WHERE cover GROUP BY id)"""


@query(f"WITH {_CHUNKS}, {_PLACES} SELECT id, lexeme, list(place ORDER BY place) AS places FROM found GROUP BY id, lexeme")
def english_index(spark, sf_dir):
    """Places of a question's lexemes in every chunk."""
    return hybrid.english_index(chunks_of(spark, sf_dir), ["esnt", "tion"]).select("id", "lexeme", F.col("places").cast("array<long>").alias("places"))


@query(f"WITH {_CHUNKS}, {_PLACES}, {_COVERS} SELECT id, text_score FROM ranked")
def english_matches(spark, sf_dir):
    """All chunks that hold both words, ranked by cover density."""
    chunks = chunks_of(spark, sf_dir)
    index = hybrid.english_index(chunks, ["esnt", "tion"])
    return hybrid.english_matches(index, ENGLISH, chunks).select("id", F.round("text_score", 6).alias("text_score"))


@query(
    f"""WITH {_CHUNKS}, {_PLACES} SELECT id FROM found GROUP BY id HAVING bool_or(lexeme = 'tion') AND NOT bool_or(lexeme = 'esnt')
    UNION SELECT id FROM (SELECT id, lexeme, place, lead(lexeme) OVER w AS l, lead(place) OVER w AS p FROM found WINDOW w AS (PARTITION BY id ORDER BY place)) WHERE lexeme = 'esnt' AND l = 'tion' AND p = place + 1"""
)
def english_syntax(spark, sf_dir):
    """A word, one that must not occur, or a phrase."""
    chunks = chunks_of(spark, sf_dir)
    return hybrid.english_matches(hybrid.english_index(chunks, ["esnt", "tion"]), 'tioned -esnting or "esnt tiones"', chunks).select("id")


@query(_hybrid(ENGLISH, "false", "0.0::DOUBLE").replace("t AS (SELECT id, 0.0::DOUBLE AS text_score FROM (SELECT id, " + _TOKENS + " AS tk FROM chunks WHERE true) WHERE false", f"{_PLACES}, {_COVERS}, t AS (SELECT id, text_score FROM ranked"))
def hybrid_english(spark, sf_dir):
    """The fused ranking with stems and cover density, from stored indexes of texts and vectors."""
    i = indexed(spark, sf_dir)
    return _shown(hybrid.hybrid_search(i.chunks, hybrid.Query(asked_vector(spark, sf_dir), ENGLISH, 10), index=i.text, vectors=i.vectors))


@query(
    """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, vec_id AS id, greatest(0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv)) AS vs FROM embeddings, q)
    SELECT query_id, id, round(vs, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(vs, 9) DESC, id) AS n FROM s) WHERE n <= 10"""
)
def vector_search_batch(spark, sf_dir):
    """V2, L1 for many questions: the ten nearest of every vector whose id is divisible by 50, against all rows."""
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    asked = vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    return hybrid.vector_search(vectors, asked, 10).select("query_id", "id", F.round("vector_similarity", 6).alias("similarity"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN source WHEN doc_id % 4 = 1 THEN source || ', page ' || (doc_id % 7 + 1)
    ELSE source || ', pages ' || (doc_id % 7 + 1) || '-' || (doc_id % 7 + doc_id % 4) END AS display_source FROM documents"""
)
def citation_labels(spark, sf_dir):
    """How a source is cited, by its pages."""
    first = F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 7 + 1)
    return table(spark, sf_dir, "documents").select("doc_id", T.citation_label(F.col("source"), first, F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 7 + F.col("doc_id") % 4)).alias("display_source"))


@query(
    _hybrid(TERM, *_ONE).replace(
        "SELECT id, source, chunk_type, round(vs, 6) AS vector_similarity, round(ts, 6) AS text_score, round(boost, 6) AS boost, round(similarity, 6) AS similarity",
        "SELECT id AS chunk_index, source, source AS display_source, round(similarity, 4) AS score, content AS text",
    )
)
def source_payload(spark, sf_dir):
    """Hits as an answer shows them."""
    hits = hybrid.contexts(hybrid.hybrid_search(chunks_of(spark, sf_dir), hybrid.Query(asked_vector(spark, sf_dir), TERM, 10), "simple"))
    none = F.lit(None).cast("int")
    return hits.select(T.source_payload(F.col("score"), F.col("source"), none, none, F.col("id"), F.col("text")).alias("p")).select("p.chunk_index", "p.source", "p.display_source", "p.score", "p.text")


# Text and lines

_LINE = r"""lines AS (SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split_regex(text, '\n') AS l FROM documents))"""
_STRIPPED = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"


def _lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines_of(F.col("text"))).alias("n", "line")).withColumn("n", F.col("n").cast("long"))


_PLATE = r"""(u = '' OR regexp_matches(u, '^\d+$') OR regexp_matches(u, '^CG-[A-Z]+-[A-Z]-\d{8}-\d+$') OR regexp_matches(u, '^\d+\s+GI/\d{4}\s*\(\d+\)$')
    OR contains(u, 'GAZETTE OF INDIA') OR contains(u, 'EXTRAORDINARY') OR contains(u, 'PUBLISHED BY AUTHORITY') OR contains(u, 'REGD. NO.')
    OR contains(u, 'REGISTERED NO.') OR contains(u, 'PART II') OR contains(u, 'SEC. 3'))"""
_MARKED = rf"""{_LINE}, s AS (SELECT doc_id, n, {_STRIPPED} AS line, upper(regexp_replace({_STRIPPED}, '\s+', ' ', 'g')) AS u FROM lines)"""


@query(
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text
    FROM documents"""
)
def normalize_text(spark, sf_dir):
    """F1."""
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("text"))


@query(
    r"""SELECT doc_id, len(p) AS sentences, p[1] AS first FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(regexp_replace(text, '^\s+|\s+$', '', 'g') || ' ', '(?s).*?(?:[.!?;:]\s+|\s$)'),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents)"""
)
def split_sentences(spark, sf_dir):
    """F10."""
    parts = T.split_sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parts).cast("long").alias("sentences"), F.get(parts, F.lit(0)).alias("first"))


@query(rf"WITH {_MARKED} SELECT doc_id, n, {_PLATE} AS boilerplate FROM s")
def boilerplate_lines(spark, sf_dir):
    """F3."""
    return _lines(spark, sf_dir).select("doc_id", "n", T.is_boilerplate(F.col("line")).alias("boilerplate"))


@query(
    rf"""WITH {_MARKED} SELECT doc_id, n, line FROM s WHERE line <> '' AND length(line) <= 140 AND NOT {_PLATE} AND (regexp_matches(line, '^({T.HEADING_WORDS})([^\p{{L}}\p{{N}}_]|$)')
    OR regexp_matches(line, '^\d+(\.\d+)*[\). -]+[A-Z]') OR regexp_matches(line, '^[A-Z][A-Z0-9 &,()/-]{{8,}}$'))"""
)
def heading_lines(spark, sf_dir):
    """F4."""
    return _lines(spark, sf_dir).where(T.is_heading(F.col("line"))).select("doc_id", "n", T.strip(F.col("line")).alias("line"))


@query(rf"WITH {_MARKED} SELECT doc_id, n FROM s WHERE regexp_matches(line, '^(\d+(\.\d+)*|[a-zA-Z]\)|\([a-zA-Z0-9ivx]+\)|[IVX]+\.)\s+')")
def clause_lines(spark, sf_dir):
    """F6."""
    return _lines(spark, sf_dir).where(T.is_clause_start(F.col("line"))).select("doc_id", "n")


@query(
    rf"""WITH {_MARKED}, a AS (SELECT doc_id, n, regexp_replace(line, '^\s*\d+\s*[\).]\s*', '') AS line FROM s),
    b AS (SELECT *, upper(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS u FROM a)
    SELECT doc_id, n FROM b WHERE line <> '' AND NOT {_PLATE} AND (suffix(line, '?') OR regexp_matches(line, '(?i)^({T.QUESTION_WORDS})([^\p{{L}}\p{{N}}_]|$)'))"""
)
def question_lines(spark, sf_dir):
    """F7."""
    return _lines(spark, sf_dir).where(T.is_question(F.col("line"))).select("doc_id", "n")


@query(rf"WITH {_MARKED} SELECT doc_id, count(*) FILTER (regexp_matches(line, '^\s*\d+\s*[\).]\s*\S+')) AS numbered, count(*) FILTER (regexp_matches(line, '(?i)^(ans|answer)\s*[:.：-]')) AS answers FROM s GROUP BY doc_id")
def numbered_and_answer_lines(spark, sf_dir):
    """F8, F9."""
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    return _lines(spark, sf_dir).groupBy("doc_id").agg(count(T.is_numbered_line(F.col("line")), "numbered"), count(T.is_answer_start(F.col("line")), "answers"))


def _pages(c: str = "text"):
    return F.array(F.struct(F.lit(None).cast("int").alias("page"), F.col(c).alias("text"), F.lit(None).cast(chunking_blocks()).alias("blocks")))


def chunking_blocks() -> str:
    from lectern.sources.files import BLOCK

    return f"array<{BLOCK}>"


@query(
    rf"""WITH {_LINE}, f AS (SELECT doc_id, min_by({_STRIPPED}, n) AS title FROM lines WHERE length({_STRIPPED}) BETWEEN 8 AND 180 GROUP BY doc_id)
    SELECT doc_id, coalesce(title, upper(source[1]) || source[2:]) AS title FROM documents LEFT JOIN f USING (doc_id)"""
)
def infer_title(spark, sf_dir):
    """S10."""
    return table(spark, sf_dir, "documents").select("doc_id", T.infer_title(F.col("source"), _pages()).alias("title"))


@query(
    r"""WITH d AS (SELECT doc_id, lower(source || ' ' || source) AS named, lower(substr(text, 1, 1500)) AS start FROM documents)
    SELECT doc_id, CASE WHEN contains(named || ' ' || start, 'frequently asked') OR regexp_matches(named || ' ' || start, '\bfaqs?\b') THEN 'faq'
    WHEN regexp_matches(named, '\b(procedure|process|workflow|step-wise|stepwise)\b') OR regexp_matches(start, '^\s*(process|procedure|workflow|steps)\b') THEN 'procedure' ELSE 'section' END AS profile FROM d"""
)
def doc_profile(spark, sf_dir):
    """F15."""
    return table(spark, sf_dir, "documents").select("doc_id", T.document_profile(F.col("source"), F.col("source"), T.profile_sample(_pages())).alias("profile"))


@query(
    r"""SELECT page_id, CASE WHEN f IN ('', '.', '..') THEN NULL ELSE f END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^.*/', ''), '[^A-Za-z0-9._ -]', '_', 'g'), '\s+', ' ', 'g') AS f FROM pages)"""
)
def safe_filename(spark, sf_dir):
    """S12."""
    return table(spark, sf_dir, "pages").select("page_id", T.safe_filename(F.col("url")).alias("name"))


# Chunks


def _documents(spark, sf_dir) -> DataFrame:
    """Every document as a text file of its own; null texts have no page and so no chunk, and are left out."""
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    text = F.col("text")
    return table(spark, sf_dir, "documents").where("text is not null").select(name.alias("source"), F.lit("txt").alias("kind"), "text").select("source", "kind", T.infer_title(F.col("source"), _pages()).alias("title"), _pages().alias("pages"))


@query()
def chunk_documents(spark, sf_dir):
    """Chunks of all documents."""
    chunks = chunking.chunk_documents(_documents(spark, sf_dir))
    return chunks.select("source", "chunk_index", "chunk_type", "section_heading", "page_start", "page_end", "content", "token_estimate", F.to_json("metadata").alias("metadata"))


@query()
def chunk_stats(spark, sf_dir):
    """Chunks and tokens of every document."""
    return chunking.chunk_stats(chunking.chunk_documents(_documents(spark, sf_dir)))


@query()
def chunk_overlap(spark, sf_dir):
    """Chunks with small limits, and without overlap."""
    docs = _documents(spark, sf_dir)
    with_overlap = chunking.chunk_stats(chunking.chunk_documents(docs, 120, 40)).select("source", F.col("chunks").alias("chunks"), F.col("tokens").alias("tokens"))
    without = chunking.chunk_stats(chunking.chunk_documents(docs, 120, 0)).select("source", F.col("chunks").alias("plain_chunks"), F.col("tokens").alias("plain_tokens"))
    return with_overlap.join(without, "source")


@query()
def embedded_chunks(spark, sf_dir):
    """Chunk rows with ids and unit vectors."""
    rows = ingest.chunk_rows(chunking.chunk_documents(_documents(spark, sf_dir)), ingest.hashed_embedding(16))
    return rows.select("id", "document_id", "source", "chunk_index", "embedding")


# Ingest


@query(
    """WITH i AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), f AS (SELECT doc_id FROM documents)
    SELECT doc_id FROM f WHERE doc_id NOT IN (SELECT doc_id FROM i)"""
)
def incremental_ingest(spark, sf_dir):
    """Documents that are not indexed yet."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("source"))
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("source"), F.when(F.col("quality") == 1, "indexed").otherwise("failed").alias("status"))
    return ingest.new_documents(found, ingest.indexed_sources(marks), "doc_id").select("doc_id")


@query(
    "WITH RECURSIVE" + manuals._CHUNKS_SQL + """, f AS (SELECT count(*) AS d, count(*) FILTER (p_partkey % 4 <> 0) AS k FROM part),
    c AS (SELECT count(*) AS n FROM chunks WHERE source NOT IN (SELECT 'part' || p_partkey || '.txt' FROM part WHERE p_partkey % 4 = 0))
    SELECT d AS documents, k AS added, d - k AS skipped, n AS chunks, n AS chunks_added FROM f, c"""
)
def ingest_counters(spark, sf_dir):
    """A1: manuals seen, added, skipped, and chunks written, where every fourth is indexed already and others have failed before."""
    found = manuals.manuals(spark, sf_dir)
    name = F.concat(F.lit("part"), "p_partkey", F.lit(".txt"))
    marks = table(spark, sf_dir, "part").select(name.alias("source"), F.when(F.col("p_partkey") % 4 == 0, "indexed").otherwise("failed").alias("status"))
    fresh = ingest.new_documents(found, ingest.indexed_sources(marks), "source")
    return ingest.ingest_counters(found, fresh, chunking.chunk_documents(fresh, manuals.MOST, 0))


@query(
    """SELECT doc_id AS source, CASE WHEN l.doc_id IS NULL THEN 'old' ELSE 'new' END AS title, d.doc_id * 10 AS id FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)
    UNION ALL SELECT doc_id + 10000000, 'new', doc_id * 100 FROM (SELECT DISTINCT doc_id FROM labels)"""
)
def upsert_documents(spark, sf_dir):
    """K1: a snapshot after changed and new rows; ids stay."""
    current = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.lit("old").alias("title"), (F.col("doc_id") * 10).alias("id"))
    changed = table(spark, sf_dir, "labels").select("doc_id").distinct()
    changes = changed.select(F.col("doc_id").alias("source"), F.lit("new").alias("title"), F.lit(-1).cast("long").alias("id")).union(
        changed.select(F.col("doc_id") + 10000000, F.lit("new"), F.col("doc_id") * 100)
    )
    return ingest.upsert(current, changes, keep=("id",))


@query("SELECT user_id AS id, event_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def job_current_state(spark, sf_dir):
    """K4: the last row of every job in a log of its states."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), "event_id", F.col("ts").alias("updated_at"))
    return records.current_state(log).select("id", "event_id", "status")


# Conversations

_SESSIONS = "sessions AS (SELECT conv_id AS id, conv_id % 5 AS user_id, max(turn) AS updated_at FROM conversations GROUP BY conv_id)"


def _sessions(spark, sf_dir) -> DataFrame:
    """A session for each conversation, five users, touched at its last turn."""
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("updated_at")).select("id", (F.col("id") % 5).alias("user_id"), "updated_at")


def _messages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("turn").alias("id"), F.col("conv_id").alias("session_id"), "role", F.coalesce("text", F.lit("")).alias("content"), F.col("turn").alias("created_at"))


@query(f"WITH {_SESSIONS} SELECT id, updated_at FROM sessions WHERE user_id = 2 ORDER BY updated_at DESC, id LIMIT 20")
def list_sessions(spark, sf_dir):
    """L4."""
    return conversation.list_sessions(_sessions(spark, sf_dir), 2).select("id", "updated_at")


@query("SELECT turn AS id, role, coalesce(text, '') AS content FROM conversations WHERE conv_id = 7 AND conv_id % 5 = 2 ORDER BY turn LIMIT 3")
def session_messages(spark, sf_dir):
    """The earliest messages."""
    return conversation.session_messages(_messages(spark, sf_dir), _sessions(spark, sf_dir), 7, 2, 3).select("id", "role", "content")


@query("SELECT turn AS id FROM conversations WHERE conv_id = 7 AND conv_id % 5 = 3")
def foreign_session(spark, sf_dir):
    """Another user's session has no messages to read."""
    return conversation.session_messages(_messages(spark, sf_dir), _sessions(spark, sf_dir), 7, 3).select("id")


@query("SELECT conv_id AS session_id, turn AS id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def last_n_messages(spark, sf_dir):
    """W3."""
    return conversation.last_messages(_messages(spark, sf_dir), 3).select("session_id", "id")


@query(
    r"""SELECT conv_id AS session_id, regexp_replace(string_agg(upper(role[1]) || role[2:] || ': ' || coalesce(text, ''), chr(10) ORDER BY turn), '^\s+|\s+$', '', 'g') AS history
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 10 GROUP BY conv_id"""
)
def history_block(spark, sf_dir):
    """F20."""
    return conversation.history_blocks(_messages(spark, sf_dir))


@query(f"WITH {_SESSIONS} SELECT id FROM sessions WHERE user_id = 3")
def owned_sessions(spark, sf_dir):
    """J5."""
    return conversation.owned_session(_sessions(spark, sf_dir), 3).select("id")


@query("SELECT conv_id AS session_id, count(*) AS messages FROM conversations WHERE NOT (conv_id % 5 = 1 AND conv_id % 2 = 0) GROUP BY conv_id")
def delete_session_cascade(spark, sf_dir):
    """Messages go with their session, if its owner deletes it."""
    sessions, messages = _sessions(spark, sf_dir), _messages(spark, sf_dir)
    gone = sessions.where(F.col("id") % 2 == 0).select("id", F.lit(1).cast("long").alias("user_id"))
    return conversation.delete_sessions(sessions, messages, gone)[1].groupBy("session_id").agg(F.count("*").alias("messages"))


@query("SELECT role, count(*) AS n FROM conversations WHERE role IN ('user', 'assistant') GROUP BY role")
def valid_messages(spark, sf_dir):
    """The store's check of roles."""
    return conversation.valid_messages(_messages(spark, sf_dir)).groupBy("role").agg(F.count("*").alias("n"))


@query(
    """SELECT conv_id AS session_id, string_agg('[' || n || '] Source: ' || role || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY n) AS excerpts
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id"""
)
def prompt_excerpts(spark, sf_dir):
    """numbered excerpts."""
    hits = _messages(spark, sf_dir).select("session_id", "id", F.col("role").alias("display_source"), F.col("content").alias("text"))
    return conversation.numbered_excerpts(hits, ["session_id"], [F.col("id")])


# Audit, users and tokens

_TOKENS_SQL = "tokens AS (SELECT event_id AS id, user_id, ts + INTERVAL 30 DAY AS expires_at, CASE WHEN event_id % 3 = 0 THEN ts END AS revoked_at FROM events)"


def _audit(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("actor_user_id"), F.col("event_type").alias("action"), F.col("props").alias("metadata"), F.col("ts").alias("created_at"))


@query("SELECT event_id AS id, user_id AS actor_user_id, event_type AS action FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_list(spark, sf_dir):
    """L6."""
    return records.latest_rows(_audit(spark, sf_dir)).select("id", "actor_user_id", "action")


@query("SELECT event_id AS id, event_type AS action FROM events WHERE user_id = 11 ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_by_actor(spark, sf_dir):
    """L6, P2."""
    return records.latest_rows(_audit(spark, sf_dir).where("actor_user_id = 11")).select("id", "action")


def _tokens(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.expr("ts + INTERVAL 30 DAYS").alias("expires_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("revoked_at"), F.sha2(F.col("event_id").cast("string"), 256).alias("token_hash"))


@query(f"WITH {_TOKENS_SQL} SELECT id, user_id FROM tokens WHERE revoked_at IS NULL AND expires_at > TIMESTAMP '2024-01-20 00:00:00'")
def active_tokens(spark, sf_dir):
    """P3, and the check of expiry."""
    return records.active_tokens(_tokens(spark, sf_dir), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("id", "user_id")


@query(f"WITH {_TOKENS_SQL} SELECT user_id, count(*) AS tokens, count(*) FILTER (revoked_at IS NULL AND user_id <> 11) AS open FROM tokens GROUP BY user_id")
def revoke_tokens(spark, sf_dir):
    """K8: a user's open tokens are marked."""
    after = records.revoke_tokens(_tokens(spark, sf_dir), 11, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return after.groupBy("user_id").agg(F.count("*").alias("tokens"), F.count(F.when(F.col("revoked_at").isNull(), 1)).alias("open"))


@query("SELECT user_id AS id FROM events WHERE event_id = 100 AND event_id % 3 <> 0 AND ts + INTERVAL 30 DAY > TIMESTAMP '2000-01-01'")
def token_owner(spark, sf_dir):
    """The user of a token."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct().withColumn("is_active", F.lit(True))
    return records.token_owner(_tokens(spark, sf_dir), users, "100", F.lit("2000-01-01").cast("timestamp")).select("id")


@query(
    """SELECT doc_id, CASE lang WHEN 'en' THEN true WHEN 'de' THEN true ELSE false END AS allowed FROM documents"""
)
def role_check(spark, sf_dir):
    """Roles at or above the lowest allowed one; unknown roles are refused."""
    role = F.when(F.col("lang") == "en", "admin").when(F.col("lang") == "de", "knowledge_manager").when(F.col("lang") == "fr", "officer").otherwise("guest")
    return table(spark, sf_dir, "documents").select("doc_id", records.has_role(role, "admin", "knowledge_manager").alias("allowed"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """Extension: events by hour and type, the batch form of the stream."""
    from lectern.streaming.ingest import event_counts

    return event_counts(table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))
