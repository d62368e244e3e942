"""Line and text functions on their edge cases."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import lexical, vectors
from lectern.functions import text as T


def values(spark, f, *rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


LINES = [
    # line, boilerplate, heading, clause start, question, answer start
    ("Section 1 Introduction", 0, 1, 0, 0, 0),
    ("1. This rule applies", 0, 1, 0, 0, 0),
    ("1.1 the permit", 0, 0, 1, 0, 0),
    ("(a) the owner", 0, 0, 1, 0, 0),
    ("GENERAL CONDITIONS", 0, 1, 0, 0, 0),
    ("PART III", 1, 0, 0, 0, 0),
    ("42", 1, 0, 0, 0, 0),
    ("", 1, 0, 0, 0, 0),
    ("CG-DL-E-12345678-99", 1, 0, 0, 0, 0),
    ("12 GI/2024 (1)", 1, 0, 1, 0, 0),
    ("What is a permit?", 0, 0, 0, 1, 0),
    ("Will be issued by the officer", 0, 0, 0, 1, 0),
    ("Ans: yes", 0, 0, 0, 0, 1),
    ("Answer：yes", 0, 0, 0, 0, 1),
    ("Section 1 " + "x" * 140, 0, 0, 0, 0, 0),
]


def test_line_kinds(spark):
    lines = [r[0] for r in LINES]
    for k, f in enumerate((T.is_boilerplate, T.is_heading, T.is_clause_start, T.is_question, T.is_answer_start), 1):
        assert values(spark, f, *lines) == [bool(r[k]) for r in LINES]


def test_headings_are_cut(spark):
    assert values(spark, T.clean_heading, "Section 5.-(1) Short title", "Rule 3 - Permit for bamboo", "  Part  1 ") == ["Section 5", "Rule 3", "Part 1"]


def test_normalize_and_split(spark):
    assert values(spark, T.normalize_text, " a \t b\r\n\r\n\r\n\nc\r", "", None) == ["a b\n\nc", "", None]
    assert values(spark, T.split_sentences, "One. Two; three?  Four", " ") == [["One.", "Two;", "three?", "Four"], []]
    assert values(spark, T.split_subclauses, "as (a) one (b) two 3. four") == [["as", "(a) one", "(b) two", "3. four"]]


def test_profiles(spark):
    df = spark.createDataFrame(
        [("a.pdf", "FAQs on permits", ""), ("b.pdf", "Transfer procedure", ""), ("transfer_process.pdf", "x", ""), ("c.pdf", "x", "  Steps to follow"), ("d.pdf", "x", "frequently asked")], "s string, t string, x string"
    )
    assert [r[0] for r in df.select(T.document_profile(F.col("s"), F.col("t"), F.col("x"))).collect()] == ["faq", "procedure", "section", "procedure", "faq"]


def test_file_names(spark):
    assert values(spark, T.safe_filename, "../Forest Rules?.pdf", "a\\b  c.txt", "x/", "..") == ["Forest Rules_.pdf", "b c.txt", None, None]


def test_citations(spark):
    df = spark.createDataFrame([(None, None), (3, 3), (3, 5)], "a int, b int")
    assert [r[0] for r in df.select(T.citation_label(F.lit("a.pdf"), F.col("a"), F.col("b"))).collect()] == ["a.pdf", "a.pdf, page 3", "a.pdf, pages 3-5"]


def test_tables(spark):
    rows = F.array(*[F.array(*[F.lit(x) for x in r]) for r in (("A", ""), ("", ""), ("x", "y\nz"))])
    block = spark.range(1).select(T.table_block(rows, F.lit(0)).alias("b")).select("b.*").first()
    assert (block.headers, block.rows, block.text) == (["A", ""], [["x", "y z"]], "A | \nx | y z")
    row = spark.range(1).select(T.table_row_text(F.array(F.lit("A"), F.lit("")), F.array(F.lit("x"), F.lit("y")), F.lit(0))).first()[0]
    assert row == "Row 1: A: x; Column 2: y"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in df.select(vectors.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert [round(r[0], 6) for r in df.select(vectors.cosine_similarity(F.col("v"), vectors.literal([1, 0]))).collect()] == [0.6, 0.0]


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("relational", "relat"), ("adjustable", "adjust"), ("probate", "probat"), ("happy", "happi"), ("sky", "sky")])
def test_stems(word, want):
    assert lexical.stem(word) == want


def test_queries_and_ranks():
    clauses = lexical.parse_query('"mill race" tolls or barges -lock')
    assert [(c.must, c.never) for c in clauses] == [([("mill", "race"), ("toll",)], []), ([("barg",)], [("lock",)])]
    assert lexical.cover_density("no match here", clauses) is None
    assert lexical.cover_density("barges in a lock", clauses) is None
    assert lexical.cover_density("rules and rules", lexical.parse_query("rules")) == pytest.approx(0.2)
    near = lexical.cover_density("mill race", lexical.parse_query("mill race"))
    far = lexical.cover_density("mill one two three race", lexical.parse_query("mill race"))
    assert near > far > 0


# Words with the stems that the Snowball rules for English give them.
STEMS = """consigned consign consignment consign consistency consist consolations consol consolatory consolatori consolidating consolid conspicuously conspicu
conspirators conspir constables constabl constancy constanc knackeries knackeri knavish knavish kneaded knead kneeling kneel knightly knight knocker knocker
generally general communication communic hopping hop hoping hope happy happi cries cri ties tie by by say say national nation relational relat skies sky dying die
agreed agre university univers falling fall beautiful beauti news news proceed proceed inning inning sensational sensat adoption adopt traditional tradit yoyo yoyo
luxuriating luxuri hesitancy hesit gaps gap this this kiwis kiwi activate activ radically radic  analogies analog""".split()


def test_stems():
    from lectern.functions.lexical import stem

    assert {w: stem(w) for w in STEMS[::2]} == dict(zip(STEMS[::2], STEMS[1::2]))


def test_byte_pair_tokens_equal_the_library(tmp_path):
    import base64
    import pickle
    import random

    import public_tokenizers
    import tiktoken

    from lectern.functions.byte_pairs import BytePairTokens

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = pickle.loads(pickle.dumps(BytePairTokens.from_file(path, public_tokenizers.PATTERN)))
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["", " ", "Permit's issued; see §4(b) – naïve café 漢字 😀", "a" * 3000, "ab" * 500 + "\n\n  x", "<|endoftext|>"]
    texts += ["".join(rng.choice("aeiou th sn.,'12é漢\n") for _ in range(rng.randrange(200))) for _ in range(400)]
    for text in texts:
        ids = library.encode_ordinary(text)
        assert own.split(text) == [library.decode_single_token_bytes(i) for i in ids] and own.count(text) == len(ids)
    assert own.join(own.split("漢字")[:1]) == library.decode(library.encode_ordinary("漢字")[:1])
