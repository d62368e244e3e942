"""Queries of sources and sinks: files, snapshots of chunks, statuses, sessions, logs, tokens."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.vectors import norm
from lectern.operators import chunking, conversation, ingest, records
from lectern.plans import manuals
from lectern.sources import files
from lectern.sources.scratch import scratch_path
from lectern.streaming import jobs

NOW = "2024-03-01 00:00:00"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scanned_texts(spark, sf_dir):
    """Text files below a folder, a nation in each, as documents."""
    path = scratch_path(spark, "texts")
    line = F.format_string("%s lies in region %d\r\n\r\n\r\n\r\nnumber\t\t%d ", "n_name", "n_regionkey", "n_nationkey")
    _table(spark, sf_dir, "nation").select(line.alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(f"{path}/deep/er")
    docs = files.read_documents(spark, path, recursive=True)
    return docs.select("kind", "title", "page_count", F.col("pages")[0]["text"].alias("text"), F.size("pages").alias("pages"))


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def word_file(paragraph: str, rows: list[list[str]]) -> bytes:
    """A Word file of one paragraph and one table."""
    text = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
    table = "".join("<w:tr>" + "".join(f"<w:tc>{text(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{text(paragraph)}<w:tbl>{table}</w:tbl></w:body></w:document>')
    return out.getvalue()


def _word_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        content = [word_file(f"Supplier list {r.s_suppkey}", [["Name", "Nation"], [r.s_name, str(r.s_nationkey)], ["", " "]]) for r in batch.itertuples()]
        yield pd.DataFrame({"name": [f"s{k}.docx" for k in batch["s_suppkey"]], "kind": "docx", "content": content})


def parsed_word_files(spark, sf_dir):
    """A Word file for every supplier, read as documents with tables."""
    made = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey").mapInPandas(_word_files, "name string, kind string, content binary")
    docs = files.documents(files.parse_files(made))
    block = F.col("pages")[0]["blocks"][1]
    return docs.select("source", "title", "page_count", F.col("pages")[0]["text"].alias("text"), F.array_join(block["headers"], ";").alias("headers"), F.array_join(F.transform(block["rows"], lambda r: F.array_join(r, ";")), "/").alias("rows"))


def accepted_uploads(spark, sf_dir):
    """Uploads of an allowed kind and size whose name is not indexed yet."""
    docs = _table(spark, sf_dir, "documents")
    name = F.concat(F.lit("up?"), (F.col("doc_id") % 700).cast("string"), F.when(F.col("doc_id") % 3 == 0, ".PDF").otherwise(F.when(F.col("doc_id") % 3 == 1, ".txt").otherwise(".exe")))
    uploads = docs.select("doc_id", name.alias("name"), (F.col("n_chars") * 20000).alias("length"))
    indexed = docs.where("doc_id % 7 = 0").select(F.concat(F.lit("up_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source"))
    return files.accepted_uploads(uploads, indexed).select("doc_id", "safe_name")


def _rows(spark, sf_dir) -> DataFrame:
    """A chunk for every order: its customer is the source."""
    return _table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.col("o_orderkey").cast("int").alias("chunk_index"), F.col("o_orderstatus").alias("content"))


def replaced_chunks(spark, sf_dir):
    """K2: a snapshot of chunks after some sources were ingested again; every fourth of these has no chunk any more."""
    path, rows = scratch_path(spark, "chunks"), _rows(spark, sf_dir)
    number = F.substring("source", 2, 20).cast("long")
    ingest.replace_chunks(rows, path)
    again = rows.where(number % 3 == 0)
    ingest.replace_chunks(again.where(number % 4 != 0).where("chunk_index % 2 = 0").withColumn("content", F.lit("new")), path, again.select("source"))
    return ingest.read_chunks(spark, path).select("source", "chunk_index", "content")


def document_status(spark, sf_dir):
    """K3: documents after a run: a status replaces what was there, and its details too."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.lit("indexing").alias("status"), F.lit("started").alias("details"))
    seen = _table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("source")).agg(F.min("quality").alias("q"))
    told = seen.select("source", F.when(F.col("q") == 1, "indexed").otherwise("failed").alias("status"), F.when(F.col("q") == 0, "no text").alias("details"))
    return ingest.with_status(docs, told)


def new_sessions(spark, sf_dir):
    """K5: sessions to append; a missing title reads New chat."""
    turns = _table(spark, sf_dir, "conversations").where("turn = 0")
    now = F.lit(NOW).cast("timestamp")
    return turns.select(*conversation.new_session(F.col("conv_id"), F.col("conv_id") % 5, F.when(F.col("role") == "system", F.substring("text", 1, 20)), now)).select("id", "user_id", "title", "updated_at")


def touched_sessions(spark, sf_dir):
    """K6: sessions are touched by their last message."""
    sessions = _table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.lit(2).cast("long").alias("updated_at"))
    messages = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"))
    return conversation.session_updates(sessions, messages).select("id", "updated_at")


def deleted_messages(spark, sf_dir):
    """K7: messages without those that the owner of their session deletes."""
    turns = _table(spark, sf_dir, "conversations")
    sessions = turns.select(F.col("conv_id").alias("id"), (F.col("conv_id") % 5).alias("user_id")).distinct()
    messages = turns.select(F.col("turn").alias("id"), F.col("conv_id").alias("session_id"))
    gone = messages.where("id % 2 = 1")
    return conversation.delete_messages(messages, sessions, gone, 3).groupBy("session_id").agg(F.count("*").alias("messages"))


def point_read(spark, sf_dir):
    """One row by its values."""
    return records.point_read(_table(spark, sf_dir, "customer"), c_custkey=77).select("c_custkey", "c_name", "c_mktsegment")


def log_lines(spark, sf_dir):
    """Each event as a line of JSON."""
    rows = _table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.lit("INFO").alias("level"), F.lit("audit").alias("logger"), F.col("event_type").alias("message"), "user_id")
    return records.log_lines(rows)


def preview_summary(spark, sf_dir):
    """Documents and chunks of an ingest that writes nothing."""
    found = manuals.manuals(spark, sf_dir)
    return ingest.preview_summary(found, ingest.preview(found, max_tokens=manuals.MOST, overlap=0))


def public_users(spark, sf_dir):
    """What others see of a user, with defaults."""
    c = _table(spark, sf_dir, "customer")
    users = c.select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("@x")).alias("email"), F.col("c_name").alias("full_name"), F.lit("viewer").alias("role"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 4 == 0).alias("is_active"), F.when(F.col("c_custkey") % 3 == 0, F.lit(True)).alias("must_change_password"), F.lit("secret").alias("password_hash"), F.lit(None).cast("timestamp").alias("last_login_at"))
    return records.public_user(users).drop("last_login_at")


def rotated_tokens(spark, sf_dir):
    """K8: each open token that is used is revoked and followed by a new one of its user."""
    tokens = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.expr("ts + INTERVAL 30 DAYS").alias("expires_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("revoked_at"), F.col("event_id").cast("string").alias("token_hash"))
    used = tokens.where("id % 2 = 0").select("token_hash", (F.col("id") + 10_000_000).alias("new_id"), F.concat("token_hash", F.lit("n")).alias("new_hash"), F.lit("2030-01-01 00:00:00").cast("timestamp").alias("expires_at"))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return records.rotate_tokens(tokens, used, now).select("id", "user_id", F.col("revoked_at").isNull().alias("open"))


def audit_rows(spark, sf_dir):
    """K8: rows of the audit log with who acted."""
    users = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("@x")).alias("email"), F.col("c_mktsegment").alias("role"))
    actions = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("actor_user_id"), F.lit("order").alias("action"), F.lit("order").alias("resource_type"), F.col("o_orderkey").cast("string").alias("resource_id"))
    return records.audit_rows(actions, users, F.lit(NOW).cast("timestamp")).select("id", "actor_email", "actor_role", "action", "resource_id")


def chunk_rows(spark, sf_dir):
    """Chunk rows with ids and vectors of length one."""
    rows = ingest.chunk_rows(chunking.chunk_documents(manuals.manuals(spark, sf_dir), manuals.MOST, 0), ingest.hashed_embedding(8), 8)
    return rows.select("id", "document_id", "chunk_index", F.size("embedding").alias("dimensions"), F.round(norm(F.col("embedding")), 6).alias("length"))


def job_transitions(spark, sf_dir):
    """K4: jobs that go from queued to running and to an end."""
    jobs = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("queued").alias("status"), F.col("ts").alias("updated_at"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"))
    running = records.job_transition(jobs, "running", F.expr("updated_at + INTERVAL 1 MINUTE"))
    done = records.job_transition(running.where("id % 3 = 0"), "succeeded", F.expr("updated_at + INTERVAL 1 HOUR"), result=F.lit("ok"))
    failed = records.job_transition(running.where("id % 3 = 1"), "failed", F.expr("updated_at + INTERVAL 2 HOURS"), error=F.lit("lost"))
    log = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), (running.withColumn("result", F.lit(None).cast("string")), done, failed))
    last = records.current_state(log.select("id", "status", "updated_at", "started_at", "finished_at", "result", "error"))
    return last.select("id", "status", (F.col("updated_at") - F.col("started_at")).cast("long").alias("took"), F.col("finished_at").isNotNull().alias("ended"), "result", "error")


def job_state_stream(spark, sf_dir):
    """K4 as a stream: the last change of every job, its log read in several batches and its state kept between them."""
    log = _table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), "event_id", F.col("ts").alias("updated_at"))
    path, out = scratch_path(spark, "log"), scratch_path(spark, "changes")
    log.repartition(3, F.col("event_id") % 3).write.parquet(path)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    jobs.run_job_stream(spark, stream, out, scratch_path(spark, "marks"), late="36500 days")  # batches are in no order of time
    return jobs.last_changes(spark.read.parquet(out)).select("id", "event_id", "status")


QUERIES = {
    f.__name__: f
    for f in (chunk_rows, job_transitions, job_state_stream, scanned_texts, parsed_word_files, accepted_uploads, replaced_chunks, document_status, new_sessions, touched_sessions, deleted_messages, point_read, log_lines, preview_summary, public_users, rotated_tokens, audit_rows)
}
ORACLES = {
    "job_state_stream": "SELECT user_id AS id, event_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "chunk_rows": "WITH RECURSIVE" + manuals._CHUNKS_SQL + " SELECT sha256(source || ':' || chunk) AS id, sha256(source) AS document_id, chunk AS chunk_index, 8 AS dimensions, 1.0::DOUBLE AS length FROM chunks",
    "job_transitions": """SELECT event_id AS id, ['succeeded', 'failed', 'running'][event_id % 3 + 1] AS status, [3600, 7200, 0][event_id % 3 + 1] AS took, event_id % 3 < 2 AS ended,
        CASE event_id % 3 WHEN 0 THEN 'ok' END AS result, CASE event_id % 3 WHEN 1 THEN 'lost' END AS error FROM events""",
    "scanned_texts": "SELECT 'txt' AS kind, n_name || ' lies in region ' || n_regionkey AS title, CAST(NULL AS INT) AS page_count, n_name || ' lies in region ' || n_regionkey || chr(10) || chr(10) || 'number ' || n_nationkey AS text, 1 AS pages FROM nation",
    "parsed_word_files": "SELECT 's' || s_suppkey || '.docx' AS source, 'Supplier list ' || s_suppkey AS title, CAST(NULL AS INT) AS page_count, 'Supplier list ' || s_suppkey || chr(10) || chr(10) || 'Name | Nation' || chr(10) || s_name || ' | ' || s_nationkey AS text, 'Name;Nation' AS headers, s_name || ';' || s_nationkey AS rows FROM supplier",
    "accepted_uploads": """SELECT doc_id, s AS safe_name FROM (SELECT doc_id, n_chars * 20000 AS length, 'up_' || (doc_id % 700) || CASE doc_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.txt' ELSE '.exe' END AS s FROM documents)
        WHERE NOT suffix(s, '.exe') AND length > 0 AND length <= 26214400 AND s NOT IN (SELECT 'up_' || doc_id || '.txt' FROM documents WHERE doc_id % 7 = 0)""",
    "replaced_chunks": """SELECT 'c' || o_custkey AS source, CAST(o_orderkey AS INT) AS chunk_index, CASE WHEN o_custkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS content FROM orders
        WHERE o_custkey % 3 <> 0 OR (o_custkey % 4 <> 0 AND o_orderkey % 2 = 0)""",
    "document_status": """SELECT d.doc_id AS source, CASE WHEN q IS NULL THEN 'indexing' WHEN q = 1 THEN 'indexed' ELSE 'failed' END AS status, CASE WHEN q IS NULL THEN 'started' WHEN q = 0 THEN 'no text' END AS details
        FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS q FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id""",
    "new_sessions": f"SELECT conv_id AS id, conv_id % 5 AS user_id, coalesce(CASE WHEN role = 'system' THEN substr(text, 1, 20) END, 'New chat') AS title, TIMESTAMP '{NOW}' AS updated_at FROM conversations WHERE turn = 0",
    "touched_sessions": "SELECT conv_id AS id, greatest(2, max(turn)) AS updated_at FROM conversations GROUP BY conv_id",
    "deleted_messages": "SELECT conv_id AS session_id, count(*) AS messages FROM conversations WHERE NOT (conv_id % 5 = 3 AND turn % 2 = 1) GROUP BY conv_id",
    "point_read": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 77",
    "log_lines": """SELECT '{"timestamp":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","level":"INFO","logger":"audit","message":"' || event_type || '","user_id":' || user_id || '}' AS value FROM events""",
    "preview_summary": "WITH RECURSIVE" + manuals._CHUNKS_SQL + " SELECT (SELECT count(*) FROM part) AS documents, (SELECT count(*) FROM chunks) AS chunks",
    "public_users": "SELECT c_custkey AS id, c_name || '@x' AS email, c_name AS full_name, 'viewer' AS role, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 4 = 0 END, true) AS is_active, c_custkey % 3 = 0 AS must_change_password FROM customer",
    "rotated_tokens": """WITH o AS (SELECT *, event_id % 3 <> 0 AND ts + INTERVAL 30 DAY > TIMESTAMP '2024-01-01' AS active FROM events)
        SELECT event_id AS id, user_id, event_id % 3 <> 0 AND NOT (active AND event_id % 2 = 0) AS open FROM o UNION ALL SELECT event_id + 10000000, user_id, true FROM o WHERE active AND event_id % 2 = 0""",
    "audit_rows": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 <> 0 THEN c_name || '@x' END AS actor_email, CASE WHEN o_orderkey % 10 <> 0 THEN c_mktsegment END AS actor_role, 'order' AS action, CAST(o_orderkey AS VARCHAR) AS resource_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
}
