"""Queries over manuals that are written from the parts table: documents with headings, clauses, tables, questions and steps.

A third of the parts each give a section document, with a second page of a table, a question-and-answer document and a
procedure. The SQL writes the same texts and folds them by windows over lines, and by a recursion over units.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunking

TEXTS = {
    "section": "Chapter {size} The {name}\n(a) one {type} {name} is kept dry; it rests (i) by day (ii) by night.\nmore of it follows here\n(b) the price is {price}.\n\nPART II\n42\n"
    "Rule {size} - Storage of {brand}\nplain words about {name}\n1.1 the first step\n1. Upper heading {type}\nIV. a roman clause\n\nGENERAL {type} RULES\nthe end of {brand}, for EXTRAORDINARY parts",
    "faq": "Lines that no question owns.\n\nSection {size} Use of {name}\n1. What is a {name}?\nAns: A {type} thing.\nIt is {brand}.\n2) Those who keep it\nANSWER - the keeper.\n\nHow much is it?\n{price} in all.\n"
    "3. Upper heading inside\nRule 3 Next\nlost line\nWill it break?\n\n7) Not asked\nPUBLISHED BY AUTHORITY\nand so on",
    "procedure": "take the {name} from its place\nb) wipe it, all of it.\n\nSteps for {brand}\n1.2 lift the {type} part\n1.3 put it down\nand rest\n\nWorkflow - {size}\n(iv) write {price} into the book",
}
TITLES = {"section": "List of {name}", "faq": "Frequently asked about {name}", "procedure": "Transfer procedure {size}"}
FIELDS = {"size": "p_size", "name": "p_name", "type": "p_type", "brand": "p_brand", "price": "floor(p_retailprice)"}
KINDS = ("section", "faq", "procedure")


def _spoken(text: str) -> str:
    """A template as an SQL expression that Spark and DuckDB read alike."""
    parts, rest = [], text
    while rest:
        at = min((rest.find("{" + f + "}") for f in FIELDS if "{" + f + "}" in rest), default=len(rest))
        if at:
            parts += [x for k, line in enumerate(rest[:at].split("\n")) for x in ([] if not k else ["chr(10)"]) + ([f"'{line}'"] if line else [])]
        name = rest[at:].partition("}")[0][1:]
        if name:
            parts.append(f"CAST(CAST({FIELDS[name]} AS BIGINT) AS STRING)" if name in ("size", "price") else FIELDS[name])
        rest = rest[at + len(name) + 2 :] if name else ""
    return " || ".join(parts)


def _by_kind(templates: dict[str, str]) -> str:
    return "CASE p_partkey % 3 " + " ".join(f"WHEN {k} THEN {_spoken(templates[kind])}" for k, kind in enumerate(KINDS)) + " END"


#: Parts whose manuals one task writes and reads: their rows are short, so a table of very many lies in a few files.
TASK_PARTS = 16384


def _dealt(parts: DataFrame) -> DataFrame:
    """Parts in as many tasks as their number asks for, two for each core at least; the count reads the files' footers alone."""
    tasks = max(-(-parts.count() // TASK_PARTS), 2 * parts.sparkSession.sparkContext.defaultParallelism)
    return parts.repartition(tasks, "p_partkey")


def manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manual for every part: (source, kind, title, pages)."""
    parts = _dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", *sorted({*FIELDS.values()} - {"floor(p_retailprice)"}), "p_retailprice"))
    told = parts.selectExpr("p_partkey", "p_name", "p_brand", "concat('part', p_partkey, '.txt') AS source", f"{_by_kind(TITLES)} AS title", f"{_by_kind(TEXTS)} AS text", f"{_spoken('Annexure {size}')} AS annexure", f"{_spoken('{price}')} AS price")
    block = lambda text: F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("int").alias("table_index"), F.array().cast("array<string>").alias("headers"), F.array().cast("array<array<string>>").alias("rows"))
    cells = F.array(F.array(F.lit("Name"), F.lit(""), F.lit(" Price\n")), F.array(F.lit(""), F.lit(" "), F.lit(None).cast("string")), F.array(F.col("p_name"), F.lit("kept"), F.col("price")), F.array(F.col("p_brand"), F.lit(""), F.lit("")))
    first = F.struct(F.lit(1).alias("page"), F.col("text"), F.lit(None).cast(f"array<{chunking._BLOCK}>").alias("blocks"))
    second = F.struct(F.lit(2).alias("page"), F.col("annexure").alias("text"), F.array(block(F.col("annexure")), T.table_block(cells, F.lit(0))).cast(f"array<{chunking._BLOCK}>").alias("blocks"))
    pages = F.when(F.col("p_partkey") % 3 == 0, F.array(first, second)).otherwise(F.array(first))
    return told.select("source", F.lit("txt").alias("kind"), "title", pages.alias("pages"))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_PLATE = r"""(u = '' OR regexp_matches(u, '^\d+$') OR contains(u, 'GAZETTE OF INDIA') OR contains(u, 'EXTRAORDINARY') OR contains(u, 'PUBLISHED BY AUTHORITY')
    OR contains(u, 'REGD. NO.') OR contains(u, 'REGISTERED NO.') OR contains(u, 'PART II') OR contains(u, 'SEC. 3'))"""
_MANUALS = f"""m AS (SELECT p_partkey AS k, p_name, p_brand, 'part' || p_partkey || '.txt' AS source, ['section', 'faq', 'procedure'][p_partkey % 3 + 1] AS profile,
    {_by_kind(TITLES)} AS title, {_by_kind(TEXTS)} AS text, {_spoken('Annexure {size}')} AS annexure, {_spoken('{price}')} AS price FROM part)"""
_LINES = rf"""{_MANUALS},
    b AS (SELECT source, profile, title, 0 AS page_no, 1 AS page, unnest(range(len(bs))) AS block_no, unnest(bs) AS block
        FROM (SELECT *, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS bs FROM m)),
    raw AS (SELECT source, profile, title, page_no, page, block_no, unnest(range(len(ls))) AS line_no, unnest(ls) AS line, false AS tabular, NULL AS context FROM (SELECT *, string_split(block, chr(10)) AS ls FROM b)
        UNION ALL SELECT source, profile, title, 1, 2, 0, 0, annexure, false, NULL FROM m WHERE profile = 'section'
        UNION ALL SELECT source, profile, title, 1, 2, 1, 0, 'Row 1: Name: ' || p_name || '; Column 2: kept; Price: ' || price, true, 'Table 1' || chr(10) || 'Columns: Name, Price' FROM m WHERE profile = 'section'
        UNION ALL SELECT source, profile, title, 1, 2, 1, 1, 'Row 2: Name: ' || p_brand, true, 'Table 1' || chr(10) || 'Columns: Name, Price' FROM m WHERE profile = 'section'),
    s AS (SELECT * REPLACE ({_STRIP.format('line')} AS line), upper(regexp_replace({_STRIP.format('line')}, '\s+', ' ', 'g')) AS u FROM raw),
    t AS (SELECT *, NOT tabular AND line <> '' AND length(line) <= 140 AND (regexp_matches(line, '^({T.HEADING_WORDS})([^A-Za-z0-9_]|$)')
        OR regexp_matches(line, '^\d+(\.\d+)*[\). -]+[A-Z]') OR regexp_matches(line, '^[A-Z][A-Z0-9 &,()/-]{{8,}}$')) AS heads,
        NOT tabular AND regexp_matches(line, '^(\d+(\.\d+)*|[a-zA-Z]\)|\([a-zA-Z0-9ivx]+\)|[IVX]+\.)\s+') AS clause,
        regexp_replace(line, '^\s*\d+\s*[\).]\s*', '') AS asked FROM s WHERE tabular OR NOT {_PLATE}),
    lines AS (SELECT *, CASE WHEN heads THEN regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(line, '\s+', ' ', 'g'), '\s*\.?-\s*\(?\d+\)?.*$', ''), '\s+[–-]\s+.*$', ''), 1, 140), '^[ .-]+|[ .-]+$', '', 'g') END AS cleaned,
        profile = 'faq' AND (suffix(asked, '?') OR regexp_matches(asked, '(?i)^({T.QUESTION_WORDS})([^A-Za-z0-9_]|$)')) AS question,
        profile = 'faq' AND regexp_matches(line, '^\s*\d+\s*[\).]\s*\S+') AS numbered, profile = 'faq' AND regexp_matches(line, '(?i)^(ans|answer)\s*[:.：-]') AS answer,
        row_number() OVER (PARTITION BY source ORDER BY page_no, block_no, line_no) - 1 AS n FROM t)"""
_UNITS = rf"""{_LINES},
    a AS (SELECT *, lag(heads) OVER blk AS before, lead(clause AND NOT heads) OVER blk AS next_clause, lead(answer) OVER blk AS next_answer FROM lines WINDOW blk AS (PARTITION BY source, page_no, block_no ORDER BY n)),
    plain AS (SELECT *, last_value(cleaned IGNORE NULLS) OVER (PARTITION BY source ORDER BY n) AS above,
        sum(CASE WHEN tabular OR heads OR before IS NULL OR before OR clause THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY n) AS run FROM a WHERE profile <> 'faq'),
    runs AS (SELECT source, run, min(n) AS n, any_value(profile) AS profile, any_value(title) AS title, bool_or(tabular) AS tabular, bool_or(heads) AS heads, any_value(above) AS above, any_value(page) AS page, any_value(context) AS context,
        any_value(block_no) AS block_no, any_value(page_no) AS page_no, arg_max(coalesce(next_clause, false), n) AS clause_next, string_agg(line, ' ' ORDER BY n) AS text FROM plain GROUP BY source, run),
    su AS (SELECT *, coalesce(above, CASE WHEN profile = 'procedure' THEN title END) AS heading, run = max(run) OVER (PARTITION BY source, page_no, block_no) AS ends FROM runs),
    asks AS (SELECT *, question OR (numbered AND coalesce(next_answer, false)) AS asks FROM a WHERE profile = 'faq'),
    closes AS (SELECT *, heads AND NOT asks AND NOT numbered AS closes FROM asks),
    turns AS (SELECT *, sum(CASE WHEN asks OR closes THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY n) AS turn FROM closes),
    opened AS (SELECT *, bool_or(asks) OVER (PARTITION BY source, turn) AS open FROM turns),
    headed AS (SELECT *, last_value(CASE WHEN closes OR (heads AND NOT asks AND NOT open) THEN cleaned END IGNORE NULLS) OVER (PARTITION BY source ORDER BY n) AS above FROM opened),
    fu AS (SELECT source, min(n) AS n, any_value(above) AS above, any_value(page) AS page, arg_min(line, n) AS asked, coalesce(string_agg(CASE WHEN NOT asks THEN line END, chr(10) ORDER BY n), '') AS told FROM headed WHERE open GROUP BY source, turn),
    units AS (SELECT source, n, CASE WHEN tabular THEN 'table' WHEN heads THEN 'heading' WHEN clause_next THEN 'clause' WHEN ends AND regexp_matches(text, '^(\d+(\.\d+)*|[a-zA-Z]\)|\([a-zA-Z0-9ivx]+\)|[IVX]+\.)\s+') THEN 'clause' ELSE 'text' END AS type,
            heading, page, CASE WHEN heads THEN heading ELSE text END AS text, CASE WHEN tabular THEN 0 END AS table_index, CASE WHEN tabular THEN CASE WHEN heading IS NOT NULL THEN 'Section: ' || heading || chr(10) ELSE '' END || context END AS context, profile FROM su
        UNION ALL SELECT source, n, 'faq', coalesce(above, asked), page, CASE WHEN told = '' OR regexp_matches(told, '(?i)^(ans|answer)\s*[:.：-]') THEN told ELSE 'Answer: ' || told END, NULL,
            CASE WHEN above IS NOT NULL THEN 'FAQ section: ' || above || chr(10) ELSE '' END || 'Question: ' || asked, 'faq' FROM fu)"""

MOST = 60
_COUNT = r"len(regexp_extract_all({}, '\w+|[^\w\s]'))"
_CHUNKS_SQL = rf""" {_UNITS},
    pieces AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n) AS i, {_COUNT.format('body')} AS size
        FROM (SELECT *, CASE WHEN context IS NULL THEN text WHEN text = '' THEN context ELSE context || chr(10) || chr(10) || text END AS body FROM units)),
    packed AS (SELECT source, profile, i, 0 AS chunk, CAST(size AS BIGINT) AS used, heading AS over, CAST(NULL AS VARCHAR) AS lead FROM pieces WHERE i = 1
        UNION ALL SELECT source, profile, i, CASE WHEN flush THEN chunk + 1 ELSE chunk END, CASE WHEN NOT flush THEN used + size WHEN fits THEN size + {_COUNT.format('label')} ELSE size END,
            CASE WHEN flush AND NOT fits THEN heading ELSE coalesce(heading, over) END, CASE WHEN NOT flush THEN lead WHEN fits THEN label END
        FROM (SELECT *, flush AND label IS NOT NULL AND {_COUNT.format('label')} <= {MOST} - size AS fits FROM (
            SELECT p.source, p.profile, p.i, p.size, p.heading, k.chunk, k.used, k.over, k.lead, CASE p.profile WHEN 'section' THEN 'Section: ' || k.over WHEN 'procedure' THEN 'Procedure: ' || k.over END AS label,
                k.used + p.size > {MOST} OR coalesce(k.over <> p.heading AND k.used >= {MOST} * CASE p.profile WHEN 'faq' THEN 0.25 ELSE 0.45 END, false) AS flush
            FROM packed k JOIN pieces p ON p.source = k.source AND p.i = k.i + 1))),
    chunks AS (SELECT source, k.profile, k.chunk, max(k.lead) AS lead, arg_max(k.over, i) AS section_heading, min(page) AS page_start, max(page) AS page_end, string_agg(body, chr(10) || chr(10) ORDER BY i) AS body,
        list_sort(list_distinct(list(type))) AS types, list_sort(list_distinct(list(table_index) FILTER (table_index IS NOT NULL))) AS tables FROM packed k JOIN pieces USING (source, i) GROUP BY source, k.profile, k.chunk)"""


def manual_lines(spark, sf_dir):
    """Every line of the manuals that is no boilerplate, and what it is."""
    docs = chunking._classified(manuals(spark, sf_dir))
    lines = docs.select("source", "profile", F.inline(F.transform("lines", lambda x, i: x.withField("n", i))))
    return lines.select("source", "profile", "n", "line", "heading", "clause", "question", "numbered", "answer", "context")


def manual_profiles(spark, sf_dir):
    """what kind of document each manual is."""
    return chunking._classified(manuals(spark, sf_dir)).select("source", "profile")


def manual_units(spark, sf_dir):
    """The units of every manual."""
    return chunking.units_of_documents(manuals(spark, sf_dir)).select("source", "type", "heading", "page", "text", "table_index", "context")


def manual_chunks(spark, sf_dir):
    """Chunks of at most 60 tokens, without overlap."""
    chunks = chunking.chunk_documents(manuals(spark, sf_dir), MOST, 0)
    return chunks.select("source", "chunk_index", "chunk_type", "section_heading", "page_start", "page_end", "content", "token_estimate", F.array_join("metadata.unit_types", ",").alias("unit_types"), F.array_join(F.col("metadata.table_indexes").cast("array<string>"), ",").alias("table_indexes"))


OVERLAP = 25
#: The same packing where a chunk begins with the end of the one before: a chunk is a range of units, begun anew where a tail within the overlap and the room starts.
_FIRST = "list_filter(range({0}, i + 2), lambda k: {1})[1]"
_TAIL = "coalesce(list_sum(sz[k:i]), 0)"
_OVERLAPS_SQL = rf""" {_UNITS},
    pieces AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n) AS i, {_COUNT.format('body')} AS size
        FROM (SELECT *, CASE WHEN context IS NULL THEN text WHEN text = '' THEN context ELSE context || chr(10) || chr(10) || text END AS body FROM units)),
    arr AS (SELECT source, any_value(profile) AS profile, list(size ORDER BY i) AS sz, list(heading ORDER BY i) AS hs, list(body ORDER BY i) AS bs, list(page ORDER BY i) AS ps, count(*) AS m FROM pieces GROUP BY source),
    packed AS (SELECT source, CAST(1 AS BIGINT) AS i, 0 AS chunk, CAST(1 AS BIGINT) AS s, CAST(NULL AS VARCHAR) AS lead, CAST(NULL AS VARCHAR) AS lead_of FROM arr
        UNION ALL SELECT source, i + 1, CASE WHEN flush THEN chunk + 1 ELSE chunk END, CASE WHEN NOT flush THEN s WHEN lined THEN behind ELSE t2 END,
            CASE WHEN NOT flush THEN lead WHEN lined THEN label WHEN kept THEN lead END, CASE WHEN NOT flush THEN lead_of WHEN lined THEN over WHEN kept THEN lead_of END
        FROM (SELECT *, behind IS NOT NULL AND label IS NOT NULL AND NOT coalesce(kept AND lead = label, false) AND NOT coalesce(list_contains(bs[t2:i], label), false) AS lined FROM (
            SELECT *, {_FIRST.format('t2', f"{_COUNT.format('label')} + {_TAIL} <= {MOST} - size")} AS behind FROM (
                SELECT *, whole AND used <= {MOST} - size AS kept, coalesce({_FIRST.format('t1', f'{_TAIL} <= {MOST} - size')}, i + 1) AS t2 FROM (
                    SELECT *, CASE WHEN whole THEN s ELSE least(coalesce({_FIRST.format('s', f'{_TAIL} <= {OVERLAP}')}, i), i) END AS t1,
                        CASE profile WHEN 'section' THEN 'Section: ' || over WHEN 'procedure' THEN 'Procedure: ' || over END AS label,
                        used + size > {MOST} OR coalesce(over <> heading AND used >= {MOST} * CASE profile WHEN 'faq' THEN 0.25 ELSE 0.45 END, false) AS flush FROM (
                        SELECT k.*, a.* EXCLUDE (source), sz[i + 1] AS size, hs[i + 1] AS heading, coalesce(list_filter(hs[s:i], lambda x: x IS NOT NULL)[-1], lead_of) AS over,
                            coalesce({_COUNT.format('lead')}, 0) + list_sum(sz[s:i]) AS used, lead IS NOT NULL AND {_COUNT.format('lead')} + list_sum(sz[s:i]) <= {OVERLAP} AS whole
                        FROM packed k JOIN arr a ON k.source = a.source WHERE i < m)))))),
    ended AS (SELECT source, chunk, max(i) AS i, arg_max(s, i) AS s, arg_max(lead, i) AS lead, arg_max(lead_of, i) AS lead_of FROM packed GROUP BY source, chunk)"""


def manual_overlaps(spark, sf_dir):
    """Chunks of at most 60 tokens that begin with up to 25 tokens of the one before, and with the heading that goes on."""
    chunks = chunking.chunk_documents(manuals(spark, sf_dir), MOST, OVERLAP)
    return chunks.select("source", "chunk_index", "section_heading", "page_start", "page_end", "content", "token_estimate")


def manual_subclauses(spark, sf_dir):
    """the parts of every manual's text at its subclauses."""
    docs = manuals(spark, sf_dir).select("source", F.col("pages")[0]["text"].alias("text"))
    return docs.select("source", F.posexplode(T.split_subclauses(F.col("text"))).alias("n", "part"))


QUERIES = {f.__name__: f for f in (manual_lines, manual_profiles, manual_units, manual_chunks, manual_overlaps, manual_subclauses)}
ORACLES = {
    "manual_lines": f"WITH {_LINES} SELECT source, profile, n, line, cleaned AS heading, clause AND profile <> 'faq' AS clause, question, numbered, answer, context FROM lines",
    "manual_profiles": f"WITH {_MANUALS} SELECT source, profile FROM m",
    "manual_units": f"WITH {_UNITS} SELECT source, type, heading, page, text, table_index, context FROM units",
    "manual_chunks": rf"""WITH RECURSIVE {_CHUNKS_SQL}, told AS (SELECT *, CASE WHEN lead IS NULL THEN body ELSE lead || chr(10) || chr(10) || body END AS content, CASE WHEN lead IS NULL THEN types ELSE list_sort(list_append(types, 'context')) END AS kinds FROM chunks)
        SELECT source, chunk AS chunk_index, CASE WHEN profile <> 'section' THEN profile WHEN kinds = ['heading'] THEN 'heading' WHEN list_contains(kinds, 'table') AND len(list_filter(kinds, lambda x: x NOT IN ('table', 'heading', 'context'))) = 0 THEN 'table' ELSE 'section' END AS chunk_type,
        section_heading, page_start, page_end, content, {_COUNT.format('content')} AS token_estimate, array_to_string(kinds, ',') AS unit_types, coalesce(array_to_string(tables, ','), '') AS table_indexes FROM told""",
    "manual_overlaps": rf"""WITH RECURSIVE {_OVERLAPS_SQL}, told AS (SELECT e.*, a.profile, coalesce(lead || chr(10) || chr(10), '') || array_to_string(bs[s:i], chr(10) || chr(10)) AS content,
            coalesce(list_filter(hs[s:i], lambda x: x IS NOT NULL)[-1], lead_of) AS section_heading, list_min(ps[s:i]) AS page_start, list_max(ps[s:i]) AS page_end FROM ended e JOIN arr a ON e.source = a.source)
        SELECT source, chunk AS chunk_index, section_heading, page_start, page_end, content, {_COUNT.format('content')} AS token_estimate FROM told""",
    "manual_subclauses": rf"""WITH {_MANUALS}, p AS (SELECT source, list_filter(list_transform(string_split(regexp_replace(text, '\s+((?:\([a-zA-Z0-9ivx]+\)|[a-zA-Z]\)|\d+\.)\s)', chr(1) || '\1', 'g'), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS ps FROM m)
        SELECT source, unnest(range(len(ps))) AS n, unnest(ps) AS part FROM p""",
}
