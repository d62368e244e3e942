"""Retrieval, ingest, conversations and records on small tables; every query with SQL against DuckDB."""

import datetime as dt
import io
import os
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import lexical
from lectern.operators import conversation, hybrid, ingest, records
from lectern.operators.requests import check_request
from lectern.plans import catalogue
from lectern.sources import files
from lectern.streaming.ingest import event_counts, start_ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda data, names: sorted(repr([plain(dict(zip(names, r))[c]) for c in columns]) for r in data)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


CHUNKS = [
    (1, "a_b.txt", "section", "Tolls", "canal tolls and locks", [1.0, 0.0]),
    (2, "c.txt", "faq", "abc", "question about barges", [0.0, 1.0]),
    (3, "d.txt", "procedure", None, "how to moor barges barges", [0.6, 0.8]),
    (4, ".txt", "section", "abcd", "nothing", [0.0, 0.0]),
    (5, "e.txt", "section", "x", "nothing", [0.6, 0.8]),
]


def chunk_table(spark):
    return spark.createDataFrame(CHUNKS, "id long, source string, chunk_type string, section_heading string, content string, embedding array<double>")


def test_hybrid_ranks(spark):
    hits = hybrid.hybrid_search(chunk_table(spark), hybrid.Query([0.6, 0.8], "barges", 5)).collect()
    # least() passes over nulls, so a chunk without a text match counts as a full one; this is the ranking's rule
    assert [(h.id, round(h.text_score, 6)) for h in hits if h.vector_similarity == 1.0] == [(5, 1.0), (3, 0.2)]
    top = hybrid.hybrid_search(chunk_table(spark), hybrid.Query([0.6, 0.8], "barges", 2)).collect()
    assert [h.id for h in top] == [h.id for h in hits][:2]


def test_text_only_hits_have_no_vector_part(spark):
    hits = hybrid.hybrid_search(chunk_table(spark), hybrid.Query([1.0, 0.0], "barges", 1, vector_candidates=1)).collect()
    scored = {r.id: r for r in hybrid.score_candidates(chunk_table(spark), hybrid.Query([1.0, 0.0], "barges", 1, vector_candidates=1)).collect()}
    assert set(scored) == {1, 2, 3} and scored[3].vector_similarity == 0.0 and scored[3].vector_rrf == 0.0 and len(hits) == 1


def test_boosts(spark):
    boost = {r.id: r.b for r in chunk_table(spark).select("id", hybrid.metadata_boost("How are the axb tolls, abc, a question").alias("b")).collect()}
    # _ in a file name is a wildcard; a stem that is empty fits any text; headings need four letters
    # one-letter stems fit nearly any question
    assert {k: round(v, 2) for k, v in boost.items()} == {1: 0.13, 2: 0.11, 3: 0.03, 4: 0.08, 5: 0.08}
    blank = {r.b for r in chunk_table(spark).select(hybrid.metadata_boost(" ").alias("b")).collect()}
    assert blank == {0.0}


def test_backslash_in_a_source(spark):
    df = chunk_table(spark).withColumn("source", F.lit("a\\b%.txt"))
    assert df.select(hybrid.metadata_boost("see a\\bxx").alias("b")).first().b == pytest.approx(0.08)


def test_filters(spark):
    df = chunk_table(spark).withColumn("metadata", F.struct(F.col("chunk_type").alias("profile"), F.array(F.lit(1), F.lit(2)).alias("tables")))
    kept = hybrid.filtered(df, (("metadata.profile", "faq"), ("metadata.tables", [2])))
    assert [r.id for r in kept.collect()] == [2]
    assert hybrid.filtered(df, (("metadata.tables", [3]),)).count() == 0


def test_ingest(spark):
    found = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "source string, n int")
    marks = spark.createDataFrame([("b", "indexed"), ("c", "failed")], "source string, status string")
    assert [tuple(r) for r in ingest.new_documents(found, ingest.indexed_sources(marks), "n").where("source is not null").collect()] == [("a", 1)]
    assert {r.source for r in ingest.indexed_sources(marks, any_status=True).collect()} == {"b", "c"}


def test_upsert_keeps_ids(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "source string, id int, title string")
    new = spark.createDataFrame([("b", 9, "z"), ("c", 3, "w")], "source string, id int, title string")
    assert sorted(map(tuple, ingest.upsert(old, new, keep=("id",)).collect())) == [("a", 1, "x"), ("b", 2, "z"), ("c", 3, "w")]


def test_upsert_takes_the_last_change(spark):
    old = spark.createDataFrame([("a", 1, 5, "x")], "source string, id int, at int, title string")
    new = spark.createDataFrame([("a", 9, 7, "late"), ("a", 9, 6, "soon"), ("n", 3, 1, "p"), ("n", 4, 1, "p")], "source string, id int, at int, title string")
    assert sorted(map(tuple, ingest.upsert(old, new, keep=("id",), latest=("at",)).collect())) == [("a", 1, 7, "late"), ("n", 4, 1, "p")]


def test_replace_chunks(spark, tmp_path):
    path = str(tmp_path / "chunks")
    frame = lambda rows: spark.createDataFrame(rows, "source string, n int")
    held = lambda: sorted((r.source, r.n) for r in ingest.read_chunks(spark, path).collect())
    assert ingest.read_chunks(spark, path) is None
    assert ingest.replace_chunks(frame([("a", 1), ("a", 2), ("b", 1), ("c", 1)]), path) == 1
    assert ingest.replace_chunks(frame([("a", 7)]), path) == 2
    assert held() == [("a", 7), ("b", 1), ("c", 1)]
    ingest.replace_chunks(frame([]), path, frame([("b", 0)]).select("source"))  # a source that has no chunk any more
    assert held() == [("a", 7), ("c", 1)]
    frame([("c", 9)]).write.parquet(f"{path}/data/version=4/bucket=1")  # a run that stopped before it wrote the manifest
    assert held() == [("a", 7), ("c", 1)]
    ingest.replace_chunks(frame([("c", 2)]), path)
    assert held() == [("a", 7), ("c", 2)]


def test_vectors_of_other_dimensions_raise(spark):
    chunks = spark.createDataFrame([("a", 0, "x y")], "source string, chunk_index int, content string")
    assert len(ingest.chunk_rows(chunks, ingest.hashed_embedding(8), 8).first().embedding) == 8
    with pytest.raises(Exception, match="8 dimensions"):
        ingest.chunk_rows(chunks, ingest.hashed_embedding(9), 8).collect()


def test_requests():
    check_request("why", 20, "t", 500)
    check_request()
    for bad in ({"question": " \n"}, {"top_k": 0}, {"top_k": 21}, {"title": ""}, {"title": "x" * 201}, {"limit": 501}, {"limit": 0}):
        with pytest.raises(ValueError):
            check_request(**bad)
    assert hybrid.Query([1.0], "", 21).top_k == 21  # the service limits requests, the ranking does not
    with pytest.raises(ValueError):
        hybrid.Query([1.0], "", 0)


def test_stored_english_index(spark, tmp_path):
    """A stored index, one made for the question and the texts themselves rank alike."""
    texts = ["the permits were issued quickly", "issue a permit, issue two", "permitting nothing", "", "no such words"]
    chunks = spark.createDataFrame([(k, "s", None, t) for k, t in enumerate(texts)], "id long, source string, section_heading string, content string")
    hybrid.write_index(hybrid.english_index(chunks), str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    for question in ("permit issue", '"issue permit" or nothing', "permit -issued", "-permit", "the", "zebra"):
        clauses = lexical.parse_query(question)
        want = {k: s for k, t in enumerate(texts) if clauses and (s := lexical.cover_density(f"s  {t}", clauses)) is not None}
        for index in (stored, None):
            got = {r.id: r.text_score for r in hybrid.text_leg(chunks, question, 10, index=index).collect()}
            assert got == want, question
    assert [r.bucket for r in hybrid.read_index(stored, ["permit"]).select("bucket").distinct().collect()] == [stored.where("lexeme = 'permit'").first().bucket]


def test_many_questions(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 4)).round(1)
    v[7] = v[21] = v[22]  # ties go by id
    v[9] = 0
    chunks = spark.createDataFrame([(k, x.tolist() if k != 3 else None) for k, x in enumerate(v)], "id long, embedding array<double>").repartition(5)
    asked = chunks.where("id % 5 = 2").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    for block in (1024, 3):
        got = {}
        for r in hybrid.vector_search(chunks, asked, 6, block=block).collect():
            got.setdefault(r.query_id, []).append((r.vector_rank, r.id))
        for q, rows in got.items():
            sim = [0.0 if not x.any() or k == 3 else max(0.0, float(v[q] @ x / np.linalg.norm(v[q]) / np.linalg.norm(x))) for k, x in enumerate(v)]
            want = sorted((k for k in range(60) if k != 3), key=lambda k: (-round(sim[k], 12), k))[:6]
            assert [k for _, k in sorted(rows)] == want
        assert len(got) == 12
    assert hybrid.vector_search(chunks, asked.where("false"), 6).count() == 0


def test_conversations(spark):
    sessions = spark.createDataFrame([(1, 10, 5), (2, 20, 3)], "id long, user_id long, updated_at long")
    messages = spark.createDataFrame([(k, 1, "user" if k % 2 else "assistant", f"m{k}", k) for k in range(1, 15)], "id long, session_id long, role string, content string, created_at long")
    assert [r.id for r in conversation.session_messages(messages, sessions, 1, 10, 2).collect()] == [1, 2]
    assert conversation.session_messages(messages, sessions, 1, 20).count() == 0
    assert conversation.session_messages(messages, sessions, 1, 10, 0).count() == 14
    assert conversation.history_blocks(messages, 2).first().history == "User: m13\nAssistant: m14"
    assert {r.id: r.updated_at for r in conversation.session_updates(sessions, messages).collect()} == {1: 14, 2: 3}
    s, m = conversation.delete_sessions(sessions, messages, spark.createDataFrame([(1, 20), (2, 20)], "id long, user_id long"))
    assert [r.id for r in s.collect()] == [1] and m.count() == 14
    gone = spark.createDataFrame([(3, 1)], "id long, session_id long")
    assert conversation.delete_messages(messages, sessions, gone, 10).count() == 13 and conversation.delete_messages(messages, sessions, gone, 20).count() == 14
    assert conversation.rewritten_query(' "lock tolls" ') == "lock tolls"
    assert "[2] Source: b\ny" in conversation.answer_prompt("q", [("a", "x"), ("b", "y")], "", "Be brief.")


def test_records(spark):
    now = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")
    job = spark.createDataFrame([("j", "queued", None, None)], "id string, status string, started_at timestamp, finished_at timestamp")
    running = records.job_transition(job, "running", now)
    done = records.job_transition(running, "failed", now, error=F.lit("x")).first()
    assert running.first().started_at and done.status == "failed" and done.error == "x" and done.finished_at
    with pytest.raises(ValueError):
        records.job_transition(job, "lost", now)
    ok = spark.createDataFrame([("a1b2c3d4e",), ("onlylettershere",), ("1234567890123",), ("riverbank 77",)], "p string").select(records.valid_password(F.col("p"))).collect()
    assert [r[0] for r in ok] == [False, False, False, True]
    roles = spark.createDataFrame([("viewer",), ("admin",), ("x",), (None,)], "r string").select(records.has_role(F.col("r"), "admin", "officer")).collect()
    assert [r[0] for r in roles] == [False, True, False, False]


def docx(*parts):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = "".join(p(x) if isinstance(x, str) else "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in x) + "</w:tbl>" for x in parts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


TABLE = [["Lane", "Opens", "Lamp"], ["North quay", "06:30", "amber"], ["Mill race", "noon", "none"]]


def test_files(spark, tmp_path):
    (tmp_path / "fees.docx").write_bytes(docx("Fee schedule of the year", TABLE))
    (tmp_path / "U.TXT").write_bytes("First line of text\r\n\r\n\r\n\r\nmore".encode())
    (tmp_path / "empty.txt").write_bytes(b"  ")
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "x.csv").write_bytes(b"a")
    parsed = files.parse_files(files.scan_files(spark, str(tmp_path)), pdf=lambda b: [])
    assert [r.name for r in parsed.where("error is not null").collect()] == ["broken.docx"]
    docs = {r.source: r for r in files.documents(parsed).collect()}
    assert set(docs) == {"fees.docx", "U.TXT"}
    blocks = docs["fees.docx"].pages[0].blocks
    assert blocks[0].text == "Fee schedule of the year" and blocks[1].headers == TABLE[0] and blocks[1].rows == TABLE[1:]
    assert docs["U.TXT"].pages[0].text == "First line of text\n\nmore" and docs["U.TXT"].page_count is None and docs["U.TXT"].title == "First line of text"


def test_pdf_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    parts = [{"page": 1, "text": "Fee schedule", "rows": None}, {"page": 1, "text": None, "rows": TABLE[:2]}, {"page": 2, "text": " ", "rows": None}]
    doc = files.documents(files.parse_files(files.scan_files(spark, str(tmp_path)), pdf=lambda b: parts)).first()
    assert doc.page_count == 1 and doc.pages[0].page == 1 and doc.pages[0].blocks[1].rows == [TABLE[1]]


def test_uploads_and_keys(spark):
    with pytest.raises(ValueError):
        files.storage_path("tape")
    assert files.storage_path("local", local="/in") == "/in" and files.storage_path("r2", bucket="b", prefix="/x/") == "s3a://b/x"
    df = spark.createDataFrame([("a.pdf", 1), ("a.exe", 1), ("a.pdf", 0), ("a.pdf", files.MAX_UPLOAD + 1)], "n string, s long")
    assert [r[0] for r in df.select(files.valid_upload(F.col("n"), F.col("s"))).collect()] == [True, False, False, False]
    assert files.object_key("/in/box/", "a.pdf") == "in/box/a.pdf" and files.object_key("", "a.pdf") == "a.pdf"


def test_stream_of_files(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "ck"))
    inbox = tmp_path / "in"
    inbox.mkdir()
    go = lambda: start_ingest(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    (inbox / "a.txt").write_text("Some words of a file.")
    go()
    (inbox / "b.txt").write_text("Other words of a file.")
    go()
    assert sorted(r.source for r in ingest.read_chunks(spark, str(tmp_path / "out")).collect()) == ["a.txt", "b.txt"]


def test_event_windows(spark):
    rows = [(dt.datetime(2024, 1, 1, h), "x", 1.0) for h in (1, 1, 2)]
    out = event_counts(spark.createDataFrame(rows, "ts timestamp, event_type string, value double")).collect()
    assert sorted(r.n for r in out) == [1, 2]


def test_entry_points():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
