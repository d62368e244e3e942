"""Stored indexes, ranking in the JVM, nested filters, the table function, the document source and hash trees."""

import json
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import lexical
from lectern.functions.variants import contains, contains_sql
from lectern.operators import content_hash, hybrid, text_index, vector_index
from lectern.operators.table_function import register_match_function
from lectern.operators.vector_index import build_vector_index, recall
from lectern.plans import indexes
from lectern.sources import files, packed

# vectors


def _clustered(spark, n=1500, dims=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, dims))
    v = (centres[rng.integers(0, 25, n)] + 0.3 * rng.normal(size=(n, dims))).round(3)
    v[40:60] = v[7]  # ties go by id
    v[9] = 0
    return v, spark.createDataFrame([(k, x.tolist() if k != 3 else None) for k, x in enumerate(v)], "id long, embedding array<float>").repartition(5)


def _hits(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.vector_rank, r.id, round(r.vector_similarity, 6)))
    return {q: sorted(x) for q, x in out.items()}


def test_vector_index_exact_equals_all_pairs(spark, tmp_path, monkeypatch):
    v, chunks = _clustered(spark)
    index = build_vector_index(chunks, str(tmp_path / "v"), cells=30)
    assert index.rows.count() == len(v) - 1 and index.cells.agg(F.sum("rows")).first()[0] == len(v) - 1
    asked = chunks.where("id % 50 = 0 or id in (3, 7, 9)").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    want = _hits(hybrid.vector_search(chunks, asked, 10))
    assert _hits(index.search(asked, 10, exact=True)) == want
    near = index.search(asked, 10)
    found = recall(near, hybrid.vector_search(chunks, asked, 10).where("query_id <> 9")).agg(F.avg("recall")).first()[0]
    assert found >= 0.9
    monkeypatch.setattr(vector_index, "ROW_BLOCK", 16)  # hot cells and many questions are dealt into blocks
    monkeypatch.setattr(vector_index, "ASKED_BLOCK", 3)
    assert _hits(index.search(asked, 10, exact=True)) == want
    allowed = chunks.where("id % 3 = 0").select("id")
    assert _hits(index.search(asked, 10, exact=True, allowed=allowed)) == _hits(hybrid.vector_search(chunks.where("id % 3 = 0"), asked, 10))
    assert _hits(index.search(asked, 2000, exact=True)) == _hits(hybrid.vector_search(chunks, asked, 2000))  # more than there are
    assert index.search(asked.where("query_id = 3"), 5, exact=True).count() == 0 and index.search(asked, 0).count() == 0


def test_vector_groups_are_compared_in_bounded_slices(monkeypatch):
    """A full group of rows and questions is never one matrix, and slices change no result."""
    rng = np.random.default_rng(2)
    n, m = vector_index.ROW_BLOCK, vector_index.ASKED_BLOCK
    v, q = rng.normal(size=(n, 4)), rng.normal(size=(m, 4))
    v[50:5000:7] = v[0]  # ties go by id, over slices too
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 4), pa.int32()), pa.array(x.ravel()))
    rows = pa.table({"id": rng.permutation(n), "residual": np.zeros(n), "vector": lists(v)})
    asked = pa.table({"query_id": np.arange(m), "asked": lists(q), "gap": np.zeros(m), "reach": pa.array([None] * m, pa.float64())})
    tracemalloc.start()
    got = vector_index._best(10)(rows, asked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    monkeypatch.setattr(vector_index, "AT_ONCE", n * m, raising=False)
    assert got.equals(vector_index._best(10)(rows, asked)) and got.num_rows == 10 * m
    assert peak < 60 << 20


def test_vector_index_bounds_pass_over_cells(spark, tmp_path):
    """The exact mode reads few of the cells where vectors lie in clusters."""
    v, chunks = _clustered(spark, 3000, 6)
    index = build_vector_index(chunks, str(tmp_path / "v"), cells=60)
    table = spark.sparkContext.broadcast(index._map)
    q = chunks.where("id % 50 = 0 and id > 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    kth = index.search(q, 10, exact=True).where("vector_rank = 10").select("query_id", F.sqrt(2 - 2 * F.least(F.lit(1.0), "vector_similarity")).alias("reach"))
    ddl = "query_id long, vector array<double>, cell int, gap double, reach double"
    reached = q.withColumn("vector", F.col("vector").cast("array<double>")).join(kth, "query_id")
    sure, likely = (reached.mapInArrow(vector_index._reached_cells(table, 4, s), ddl).count() for s in (None, vector_index.SURE))
    assert likely <= sure < 0.5 * q.count() * index.cells.count()
    one = [(r.id, round(r.vector_similarity, 9)) for r in index.nearest([float(x) for x in v[100]], 10, exact=True).orderBy("vector_rank").collect()]
    assert one == [(r.id, round(r.vector_similarity, 9)) for r in hybrid.vector_leg(chunks, [float(x) for x in v[100]], 10).orderBy("vector_rank").collect()]


def test_vector_index_odd_tables(spark, tmp_path):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert build_vector_index(none, str(tmp_path / "none")).search(asked, 3, exact=True).count() == 0
    named = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [-1.0, 0.0]), ("d", [0.0, 0.0])], "id string, embedding array<double>")
    index = build_vector_index(named, str(tmp_path / "named"))
    assert [r.id for r in index.search(asked, 4, exact=True).orderBy("vector_rank").collect()] == ["a", "b", "c", "d"]
    with pytest.raises(Exception, match="dimensions"):
        index.search(spark.createDataFrame([(1, [1.0, 0.0, 1.0])], "query_id long, vector array<double>"), 3).collect()
    with pytest.raises(Exception, match="dimensions"):
        build_vector_index(spark.createDataFrame([(k, [1.0] * (2 + k % 2)) for k in range(9)], "id long, embedding array<double>"), str(tmp_path / "mixed"))


# texts

WORDS = "permit permits permitting issue issued forest forests rule rules quick quickly table".split()


def _texts(spark, n=400, seed=1):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS if rng.random() < 0.5 else ["the", "zz", "x1", "of"]) for _ in range(rng.choice([0, 3, 8, 30, 120]))) for _ in range(n)]
    return texts, spark.createDataFrame([(k, "s", None, t) for k, t in enumerate(texts)], "id long, source string, section_heading string, content string").repartition(3)


QUESTIONS = ("permit issue", '"issue permit" or table', "permit -issued", "-permit", "the", "zebra", "forest rule quick", '"forest rules" quickly', "permit", "permitted -table or rule issue", 'issue -"forest rule"')


def test_cover_rank_in_the_jvm_equals_the_fold(spark):
    rng = random.Random(6)
    rows = []
    for k in range(200):
        places = {}
        for at in range(1, rng.choice([1, 4, 20, 60])):
            places.setdefault(rng.choice(["permit", "issu", "forest", "rule", "quick"]), []).append(at)
        rows.append((k, [{"lexeme": x, "places": p} for x, p in places.items()]))
    df = spark.createDataFrame(rows, "id long, found array<struct<lexeme:string,places:array<int>>>")
    for question in QUESTIONS:
        clauses = lexical.parse_query(question)
        if not clauses:
            continue
        got = {r.id: r.s for r in df.select("id", lexical.rank_of_places(clauses)("found").alias("s")).collect()}
        assert got == {k: lexical.cover_rank({x["lexeme"]: x["places"] for x in f}, clauses) for k, f in rows}, question


def test_cover_bound_holds(spark):
    rng = random.Random(9)
    clauses = lexical.parse_query("permit issue forest")
    for _ in range(300):
        places = {}
        for at in range(1, 14):
            places.setdefault(rng.choice(["permit", "issu", "forest"]), []).append(at)
        if len(places) == 3:
            times = [len(p) for p in places.values()]
            assert lexical.cover_rank(places, clauses) <= 0.1 * min(3 * min(times), sum(times) - 2) * (1 + 1e-6)


def test_text_index_ranks_like_the_texts(spark, tmp_path, monkeypatch):
    texts, chunks = _texts(spark)
    monkeypatch.setattr(text_index, "BLOCK", 8)
    index = hybrid.indexed_text(chunks, str(tmp_path / "t"))
    assert index.chunks.count() == len(texts)
    for waves in (text_index.WAVES, (1, 2, None)):  # a few blocks at a time, so that most are passed over
        monkeypatch.setattr(text_index, "WAVES", waves)
        for question in QUESTIONS:
            clauses = lexical.parse_query(question)
            want = sorted(((-s, k) for k, t in enumerate(texts) if clauses and (s := lexical.cover_density(f"s  {t}", clauses)) is not None))[:12]
            got = hybrid.text_leg(chunks, question, 12, index=index).orderBy("text_rank").collect()
            assert [(-r.text_score, r.id) for r in got] == want, question
    for text in ("permit", "permit issue", "zz", "nothing", "permit permit"):
        rows = [[(r.id, r.text_score) for r in hybrid.text_leg(chunks, text, 9, "simple", index=i).orderBy("text_rank").collect()] for i in (index, None)]
        assert rows[0] == rows[1], text
    filters = (("source", "s"),)
    even = chunks.where("id % 2 = 0")
    assert [r.id for r in hybrid.text_leg(even, "permit", 9, index=index, filters=filters).orderBy("text_rank").collect()] == [r.id for r in hybrid.text_leg(even, "permit", 9).orderBy("text_rank").collect()]


def test_text_index_passes_over_blocks(spark, tmp_path, monkeypatch):
    """One long text holds the word often; blocks of short texts cannot score as much and their places are not read."""
    rows = [(k, "s", None, "permit rule") for k in range(300)] + [(1000 + k, "s", None, "permit " * 50) for k in range(3)]
    chunks = spark.createDataFrame(rows, "id long, source string, section_heading string, content string")
    monkeypatch.setattr(text_index, "BLOCK", 4)
    monkeypatch.setattr(text_index, "WAVES", (1, 8, None))
    index, read = hybrid.indexed_text(chunks, str(tmp_path / "t")), []
    scored = text_index.TextIndex._scored
    monkeypatch.setattr(text_index.TextIndex, "_scored", lambda self, posted, *a: (read.append(posted.select("block").distinct().count()), scored(self, posted, *a))[1])
    assert [r.id for r in index.english_top("permits", 3).orderBy(F.desc("text_score"), "id").collect()] == [1000, 1001, 1002]
    assert sum(read) == 1
    plan = index.postings.select(lexical.rank_of_places(lexical.parse_query("permit rule"))(F.array().cast("array<struct<lexeme:string,places:array<int>>>")))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def _shuffled_rows(spark, run):
    """Rows that the stages of run wrote to shuffles."""
    store, before = spark.sparkContext._jsc.sc().statusStore(), set()
    stages = lambda: [x for x in (lambda found: [found.apply(k) for k in range(found.size())])(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))]
    before = {s.stageId() for s in stages()}
    run()
    return sum(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before)


def test_text_index_is_built_from_whole_blocks(spark, tmp_path, monkeypatch):
    """Places are grouped where a block's texts meet: a row for each text and each token of a block is shuffled, not one for each place."""
    monkeypatch.setattr(text_index, "BLOCK_CHARS", 6000, raising=False)
    rng = random.Random(5)
    texts = {k: " ".join(rng.choice(["Ab", "cd", "e-f", "x9"]) for _ in range(rng.choice([0, 1, 400]))) for k in range(60)}
    chunks = spark.createDataFrame([*texts.items(), (60, None)], "id long, content string").repartition(3)
    made = []
    shuffled = _shuffled_rows(spark, lambda: made.append(text_index.build_text_index(chunks, F.col("content"), str(tmp_path / "t"))))
    want = {}
    for k, text in texts.items():
        for n, token in enumerate(text.lower().replace("-", " ").split(), 1):
            want.setdefault((token, k), []).append(n)
    rows = made[0].postings.collect()
    assert {(r.token, i): p for r in rows for i, p in zip(r.ids, r.places)} == want
    assert all(r.most == max(map(len, r.places)) and r.ids == sorted(r.ids) for r in rows)
    long_blocks = {r.block for r in rows if r.most > 20}
    assert len(long_blocks) > 1 and shuffled < sum(map(len, want.values())) / 3


def test_postings_are_grouped_where_their_texts_are(spark, monkeypatch):
    monkeypatch.setattr(hybrid, "POSTINGS_CHARS", 2, raising=False)
    chunks = spark.createDataFrame([(1, "s", None, "b a b"), (2, None, "h", "b"), (2, "s", "", "b"), (3, "s", "h", None)], "id long, source string, section_heading string, content string")
    rows = hybrid.postings(chunks)
    assert {(r.lexeme, r.id): (r.tf, r.positions) for r in rows.collect()} == {("s", 1): (1, [1]), ("b", 1): (2, [2, 4]), ("a", 1): (1, [3]), ("h", 2): (1, [1]), ("b", 2): (2, [2, 2]), ("s", 2): (1, [1])}
    stats = rows.groupBy("lexeme").agg(F.sum("tf").alias("tf"), F.count("*").alias("chunks"))
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(lexeme#" in plan and not re.search(r"hashpartitioning\(lexeme#\d+, id#", plan)


def test_hybrid_search_from_indexes(spark, monkeypatch):
    texts, plain = _texts(spark, 200, 4)
    v, vectors = _clustered(spark, 200)
    chunks = plain.join(vectors, "id").withColumns({"chunk_type": F.lit("faq"), "label": F.col("id") % 3})
    made = indexes.build(chunks)
    assert indexes.build(chunks.limit(0)).text.english_top("permit", 3).count() == 0
    for filters in ((), (("label", 1),)):
        for question in ("permit issue", "the faq", '"forest rules" or quick', ""):
            q = hybrid.Query([float(x) for x in v[7]], question, 25, filters)
            a, b = ([(r.id, round(r.similarity, 9)) for r in x.collect()] for x in (hybrid.hybrid_search(chunks, q), hybrid.hybrid_search(made.chunks, q, index=made.text, vectors=made.vectors)))
            assert a == b, (filters, question)


def test_indexes_are_made_anew_when_files_change(spark, tmp_path):
    texts, chunks = _texts(spark, 20)
    v, vectors = _clustered(spark, 20)
    path = str(tmp_path / "chunks")
    chunks.join(vectors, "id").write.parquet(path)
    of = lambda: (t := spark.read.parquet(path), indexes.indexes_of(t, [t], path))[1]
    assert of() is of()
    one = of()
    chunks.limit(1).withColumn("id", F.lit(99).cast("long")).join(vectors.limit(1).drop("id")).write.mode("append").parquet(path)
    assert of() is not one and of().chunks.count() == one.chunks.count() + 1


# nested filters


def _held(a, b, outside=True):
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and _held(a[k], x, False) for k, x in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(_held(x, y, False) for x in a) for y in b)
    if outside and isinstance(a, list):
        return any(_held(x, b, False) for x in a)
    if isinstance(a, (dict, list)):
        return False
    return a == b and isinstance(a, bool) == isinstance(b, bool) and (a is None) == (b is None)


def _value(rng, depth):
    kind = rng.randrange(6 if depth else 4)
    if kind < 4:
        return rng.choice([1, 2, 1.5, "x", "1", True, False, None, "", 10**12])
    if kind == 4:
        return {rng.choice(["a", "b", "it's", 'q"x', "d.e"]): _value(rng, depth - 1) for _ in range(rng.randrange(3))}
    return [_value(rng, depth - 1) for _ in range(rng.randrange(3))]


def test_contains_equals_brute_force(spark):
    rng = random.Random(12)
    documents = [_value(rng, 3) for _ in range(250)]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(documents)], "id long, j string").select("id", F.parse_json("j").alias("v"))
    wanted = [{}, [], [[]], None, 1, "1", True] + [_value(rng, 2) for _ in range(40)]
    got = df.select("id", *[contains(F.col("v"), w).alias(f"w{k}") for k, w in enumerate(wanted)]).collect()
    for r in got:
        for k, w in enumerate(wanted):
            assert r[f"w{k}"] == _held(documents[r.id], w), (documents[r.id], w)
    asked = spark.createDataFrame([(k, json.dumps(w)) for k, w in enumerate(wanted)], "n long, w string").select("n", F.parse_json("w").alias("w"))
    for r in df.join(asked).select("id", "n", F.expr(contains_sql("v", "w")).alias("held")).collect():
        assert r.held == _held(documents[r.id], wanted[r.n]), (documents[r.id], wanted[r.n])
    with pytest.raises(Exception, match="nested too deeply"):
        df.select(F.expr(contains_sql("parse_json('[[[[[1]]]]]')", "parse_json('[[[[[1]]]]]')"))).collect()
    assert df.select(contains(F.lit(None).cast("variant"), {}).alias("x")).distinct().collect()[0].x is False


def test_table_function_equals_hybrid_search(spark):
    texts, plain = _texts(spark, 150, 8)
    v, vectors = _clustered(spark, 150)
    kind = F.element_at(F.array(F.lit("section"), F.lit("faq"), F.lit("procedure")), (F.col("id") % 3 + 1).cast("int"))
    chunks = plain.drop("source", "section_heading").join(vectors, "id").withColumns({
        "source": F.concat(F.lit("rule_"), F.col("id") % 4, F.lit(".txt")), "section_heading": F.when(F.col("id") % 2 == 0, F.lit("forest")), "chunk_type": kind, "label": F.col("id") % 3,
        "document_id": F.lit(1), "chunk_index": F.col("id").cast("int"), "page_start": F.lit(1), "page_end": F.lit(2), "metadata": F.parse_json(F.to_json(F.struct((F.col("id") % 3).alias("label")))),
    })
    chunks.createOrReplaceTempView("document_chunks")
    register_match_function(spark)
    vector = "array(" + ", ".join(f"{float(x)!r}D" for x in v[7]) + ")"
    for question in ("permit", "forest permit", "how rule_1 faq", "  ", "it''s"):
        for label in (None, 2):
            q = hybrid.Query([float(x) for x in v[7]], question.replace("''", "'"), 9, () if label is None else (("label", label),), 20, 15)
            want = [(r.id, round(r.similarity, 9)) for r in hybrid.hybrid_search(chunks, q, "simple").collect()]
            given = "{}" if label is None else f'{{"label": {label}}}'
            got = spark.sql(f"SELECT id, similarity FROM match_document_chunks({vector}, '{question}', 9, '{given}', 20, 15)").collect()
            assert [(r.id, round(r.similarity, 9)) for r in got] == want, (question, label)
    assert len(spark.sql(f"SELECT * FROM match_document_chunks({vector})").columns) == 11 and spark.sql(f"SELECT * FROM match_document_chunks({vector})").count() == 5
    with pytest.raises(ValueError, match="embedding"):
        spark.range(1).createOrReplaceTempView("no_chunks")
        register_match_function(spark, "no_chunks")


# documents


def test_packed_partitions():
    made = [packed.Found(k, f"/d/{k}.txt", s) for k, s in enumerate([70, 10, 20, 90, 300, 5, 5, 100])]
    parts = packed.packed(made, 100)
    assert sorted(f.path for p in parts for f in p.files) == sorted(f.path for f in made)
    sizes = sorted(sum(f.size for f in p.files) for p in parts)
    assert [s for s in sizes if s > 100] == [300] and len(parts) == 4 and packed.packed([], 100) == []


def _write(folder, names):
    folder.mkdir(parents=True, exist_ok=True)
    for n, text in names.items():
        (folder / n).write_bytes(text)


def test_document_source_reads_like_the_scan(spark, tmp_path):
    from lectern.plans.tables import word_file

    _write(tmp_path / "in", {"a one.txt": b"Title of the first\r\n\r\nbody", "b.TXT": "Title é of second".encode(), "c.docx": word_file("A paragraph here", [["H", "I"], ["1", "2"]]), "bad.docx": b"no zip", "_hidden.txt": b"x", "d.csv": b"x"})
    _write(tmp_path / "in" / "deep", {"a one.txt": b"not the first of its name", "e+f.txt": b"deep text file"})
    for recursive in (False, True):
        got = packed.read_parsed(spark, str(tmp_path / "in"), recursive=recursive, partitionBytes=30)
        shown = lambda df: sorted((r.source, r.kind, r.title, r.page_count, json.dumps([p.asDict(True) for p in r.pages])) for r in df.collect())
        assert shown(files.documents(got)) == shown(files.read_documents(spark, str(tmp_path / "in"), recursive=recursive))
        assert [r.name for r in got.where("error is not null").collect()] == ["bad.docx"]
    assert got.rdd.getNumPartitions() > 1
    empty = tmp_path / "empty"
    empty.mkdir()
    assert packed.read_parsed(spark, str(empty)).count() == 0
    with pytest.raises(Exception, match="path"):
        spark.read.format(packed.FORMAT).load().collect()


def test_document_stream_takes_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    _write(folder, {f"f{k}.txt": b"text of file %d" % k for k in range(6)})
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        rows = packed.stream_parsed(spark, str(folder), maxBytes=32, settleSeconds=0)
        query = rows.writeStream.format("parquet").option("checkpointLocation", mark).option("path", out).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.name for r in spark.read.schema(rows.schema).parquet(out).collect())

    assert run() == [f"f{k}.txt" for k in range(6)]
    assert run() == [f"f{k}.txt" for k in range(6)]  # nothing new after a restart
    time.sleep(0.05)
    _write(folder, {"g.txt": b"later"})
    assert run() == [*(f"f{k}.txt" for k in range(6)), "g.txt"]


# hash trees


def test_chunk_changes_and_refreshed_rows(spark):
    ddl = "source string, chunk_index int, chunk_type string, section_heading string, content string"
    old = [("a", 0, "t", None, "x"), ("a", 1, "t", None, "y"), ("a", 2, "t", None, "x"), ("b", 0, "t", None, "p"), ("c", 0, "t", "h", "q")]
    new = [("a", 0, "t", None, "y"), ("a", 1, "t", None, "x"), ("a", 2, "t", None, "z"), ("b", 0, "t", None, "p"), ("d", 0, "t", None, "q"), ("c", 0, "t", None, "q")]
    a, b = spark.createDataFrame(old, ddl), spark.createDataFrame(new, ddl)
    assert {r.source: (r.kept, r.added, r.gone) for r in content_hash.chunk_changes(a, b).collect()} == {"a": (2, 1, 1), "b": (1, 0, 0), "c": (0, 1, 1), "d": (0, 1, 0)}
    states = content_hash.changed_documents(*(content_hash.roots(content_hash.with_leaves(x)) for x in (a, b)))
    assert {r.source: r.state for r in states.collect()} == {"a": "changed", "b": "alike", "c": "changed", "d": "new"}
    asked = spark.sparkContext.accumulator(0)

    def embed(column):
        @F.udf("array<double>")
        def f(text):
            asked.add(1)
            return [float(len(text)), 1.0]

        return f(column)

    held = content_hash.chunk_rows(a, lambda _: F.array(F.lit(3.0), F.lit(4.0)))
    rows = content_hash.refreshed_rows(held, b, embed).collect()
    assert asked.value == 3 and len(rows) == 6
    assert {(r.source, r.content): round(r.embedding[0], 3) for r in rows} == {("a", "y"): 0.6, ("a", "x"): 0.6, ("a", "z"): 0.707, ("b", "p"): 0.6, ("d", "q"): 0.707, ("c", "q"): 0.707}
    fresh = content_hash.chunk_rows(b, lambda _: F.array(F.lit(1.0)))
    assert {r.id for r in rows} == {r.id for r in fresh.collect()}
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-9 for r in rows)
