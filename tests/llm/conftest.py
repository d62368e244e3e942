import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls anywhere, empty and very long texts, repeated rows, other scripts, and columns whose names clash with operators' own."""
    long = " ".join(f"w{k % 977}{k % 13}" for k in range(60_000))
    rows = [
        (1, "The cat sat on the mat, and the dog ate the bone.", "en", "s"), (2, "The cat  sat on\nthe mat, and the dog ate the bone.", "en", "s"), (3, None, None, None), (4, "", "en", "s"),
        (5, "   ", "en", None), (6, long, "en", "s"), (7, long + " end", "en", "s"), (7, long + " end", "en", "s"), (None, "no id here", "en", "s"), (8, "12345 %%% ###", None, "s"),
        (9, "El gato ñoño come pan \U0001f600 漢字", "es", "s"), (10, "A", "de", "s"), (11, " leading and trailing ", "de", "s"), (12, "A", "de", "s"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = {c: "x" for c in ("fp", "key", "head", "rid", "first", "anchor", "score", "ids", "row", "runs", "held_out", "n_tokens", "label", "kept", "size")}
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in clash.items()})
