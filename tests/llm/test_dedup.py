"""Exact and near dedup, repeated passages and decontamination against brute force."""

import random
import re
import time
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from lectern.llm import substring_dedup as sub
from lectern.llm.catalogue import ORACLES, QUERIES
from lectern.llm.components import components
from lectern.llm.decontam import clean_documents, decontaminate
from lectern.llm.exact_dedup import distinct_documents, exact_dedup
from lectern.llm.simhash import near_duplicates, simhash_components


def joined(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want, got = c.sql(ORACLES[name]), QUERIES[name](spark, sf_dir)
    assert sorted(map(repr, want.select(",".join(got.columns)).fetchall())) == sorted(repr(tuple(r)) for r in got.collect())


def test_exact_odd_rows(spark, odd_docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    docs = odd_docs.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in docs:
        groups[norm(r.text)].append(r.doc_id)
    for bucket in (32 << 20, 1000):
        rows = exact_dedup(odd_docs, bucket_bytes=bucket).collect()
        assert len(rows) == len(docs)
        least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
        want = sorted((str(r.doc_id), str(least[norm(r.text)]), len(groups[norm(r.text)])) for r in docs)
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in rows) == want
        assert sum(r.kept for r in rows) == len(groups)
        kept = distinct_documents(odd_docs, bucket_bytes=bucket)
        assert kept.columns == odd_docs.columns and kept.count() == len(groups)
    assert exact_dedup(odd_docs.where("false")).count() == 0


def test_chains_compare_bytes(spark, monkeypatch):
    """Texts whose keys are all the same still stay apart."""
    from lectern.llm import exact_dedup as module

    schema = __import__("pyarrow").schema([("head", "int64"), ("keep_id", "int64"), ("keep_rid", "int64"), ("copies", "int64"), ("key", "int64")])
    pa = __import__("pyarrow")
    batch = pa.RecordBatch.from_pydict({"rid": [1, 2, 3], "doc_id": [1, 2, 3], "key": [9, 9, 9], "part": [0, 0, 0], "text": [b"a", b"b", b"a"], "copies": [1, 1, 1]})
    out = list(module._owner(schema)(iter([batch])))[0].to_pydict()
    assert out["keep_id"] == [1, 2, 1]


@pytest.mark.parametrize("hot, sent", [(2, 1 << 20), (2, 0)])
def test_popular_texts_are_chained_in_several_tasks(spark, monkeypatch, hot, sent):
    from lectern.llm import exact_dedup as module

    monkeypatch.setattr(module, "HOT", hot)
    monkeypatch.setattr(module, "SENT", sent)
    rng = random.Random(8)
    docs = [(k, rng.choice(["popular text", "popular  text", f"own {k}", "second one", None])) for k in range(300)] + [(None, "popular text"), (5, "second one")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(23)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for d, t in docs:
        groups[norm(t)].append(d)
    rows = exact_dedup(frame, bucket_bytes=64).collect()
    want = sorted((str(d), min(x for x in groups[norm(t)] if x is not None), len(groups[norm(t)])) for d, t in docs)
    assert sorted((str(r.doc_id), r.keep_id, r.group_size) for r in rows) == want and sum(r.kept for r in rows) == len(groups)
    kept = distinct_documents(frame, bucket_bytes=64).collect()
    assert sorted(r.doc_id for r in kept) == sorted(min(x for x in v if x is not None) for v in groups.values())


def test_directory_doubles_as_the_data_need(spark):
    from lectern.llm.exact_dedup import build_directory

    rng = random.Random(9)
    rows = [(rng.randrange(-(1 << 63), 1 << 63), 10) for _ in range(900)] + [(7, 10_000), (1 << 62, 400)]
    keys = spark.createDataFrame(rows, "key long, bytes long")
    for capacity in (100_000, 1000, 200):
        directory, depth = build_directory(keys, capacity)
        bucket = {r.slot: r.bucket for r in directory.collect()}
        held = defaultdict(int)
        for k, n in rows:
            held[bucket[k >> (64 - depth)]] += n if n < capacity / 4 else 0
        assert max(held.values()) <= capacity and (len(held) > 1) == (capacity < 100_000) | (len(held) > 1)
    assert build_directory(keys.where("false"), 100)[0].count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = joined(edges, {x for e in edges for x in e})
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_brute_force(spark, sf_dir):
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng = random.Random(1)
    near = [(10_000 + k, " ".join(w if i != rng.randint(0, 3000) else "edit" for i, w in enumerate(t.split()))) for k, (_, t) in enumerate(base[:60])]
    docs = base + near + [(20_000, None), (20_001, ""), (20_002, "Two words"), (20_002, "Two words")]
    prints = {d: fingerprint(t) for d, t in docs}
    ids = sorted(prints)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if bin(prints[a] ^ prints[b]).count("1") <= 3]
    roots = joined(links, ids)
    rows = simhash_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == len(docs) and len(links) > 20
    assert all((r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", roots[r.doc_id]) for r in rows)


def test_simhash_blocks_and_odd_rows(spark, odd_docs):
    from lectern.llm.simhash import near_links

    rng = random.Random(8)
    fps = sorted({0} | {sum(1 << rng.randrange(63) for _ in range(rng.randint(0, 3))) for _ in range(400)})
    edges = [(r.a, r.b) for r in near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), block=16).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in edges)
    want = joined([(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin(a ^ b).count("1") <= 3], fps)
    assert joined(edges, fps) == want
    assert simhash_components(odd_docs).count() == odd_docs.count()
    assert simhash_components(odd_docs.where("false")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    docs, pairs = [], []
    for k in range(30):
        words = [word() for _ in range(250)]
        docs.append((2 * k, " ".join(words)))
        words[rng.randrange(250)] = "edit"
        docs.append((2 * k + 1, " ".join(words)))
        pairs.append((2 * k + 1, 2 * k))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame([*docs, (None, "x"), (99, None)], "doc_id long, text string")).collect()}
    assert got == {x: b for a, b in pairs for x in (a, b)}
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def near_classes(texts):
    grams = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in texts.items()}
    ids = sorted(texts)
    links = [(b, a) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    linked = {x for pair in links for x in pair}
    return {d: r for d, r in joined(links, ids).items() if d in linked}, links


def test_near_duplicates_of_groups(spark):
    """Copies that are near their base and not each other; the base has any place among the ids."""
    rng = random.Random(12)
    texts, k = {}, 0
    for group in range(8):
        base = [f"g{group}w{rng.randrange(10**6)}" for _ in range(300)]
        members = [list(base)]
        for _ in range(30):
            copy = list(base)
            for i in rng.sample(range(5, 295), rng.choice([4, 5, 6, 7])):
                copy[i] = f"e{rng.randrange(10**9)}"
            members.append(copy)
        rng.shuffle(members)
        for words in members:
            texts[k], k = words, k + 1
    want, links = near_classes(texts)
    assert len(links) < 8 * 31 * 30 / 4
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    for block in (128, 5):
        assert {r.doc_id: r.component_id for r in near_duplicates(frame, block=block).collect()} == want


def test_shared_counts():
    from lectern.llm.simhash import shared_counts

    rng = np.random.default_rng(3)
    one, two = ([np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint32)) for _ in range(n)] for n in (7, 12))
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in two] for x in one]
    for columns in (1, 5, 4096):
        assert shared_counts(one, two, columns).tolist() == want


def test_near_duplicates_behind_a_link_that_fails(spark):
    """A document of the same words in another order has the smallest id and shares nothing of the order."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    other, edited = rng.sample(words, 200), [*words[:100], "x", *words[101:]]
    rows = [(1, " ".join(other)), (2, " ".join(words)), (3, " ".join(edited)), (4, " ".join(words).upper())]
    assert {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {2: 2, 3: 2, 4: 2}


def test_near_duplicates_on_the_documents(spark, sf_dir):
    """Recall and precision of links on the given documents against brute force over all pairs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: (r.text or "").lower().split() for r in docs.collect()}
    want, links = near_classes(texts)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert links and got == want


def test_near_duplicates_of_every_kind(spark):
    """Words replaced, and blocks added in front, behind or inside and cut: all pairs at the threshold or above are found."""
    rng = random.Random(13)
    fresh = lambda n: [f"{rng.randrange(10**6)}y" for _ in range(n)]
    texts = {}
    for k in range(120):
        base = fresh(rng.choice([12, 60, 200, 400]))
        n, at = rng.randint(len(base) // 10, len(base) // 4), rng.randrange(len(base))
        copy = [fresh(n) + base, base + fresh(n), base[:at] + fresh(n) + base[at:], base[: len(base) - n], base[n:], [w if rng.random() > 0.03 else "edit" for w in base]][k % 6]
        texts |= {2 * k: base, 2 * k + 1: copy}
    want, links = near_classes(texts)
    assert len(links) > 60
    rows = near_duplicates(spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == want


def test_compact_windows():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n, length = int(rng.integers(0, 60)), int(rng.integers(1, 12))
        h = rng.integers(0, 2**63, n).astype(np.uint64)
        if n and rng.random() < 0.5:
            h = h[rng.integers(0, max(1, n // 3), n)]
        keys = (h & ~sub._POSITION) | np.arange(n, dtype=np.uint64)
        want = []
        for c in range(n):
            left = max([k for k in range(c) if keys[k] < keys[c]], default=-1) + 1
            right = min([k for k in range(c + 1, n) if keys[k] < keys[c]], default=n) - 1
            if right - left + 1 >= length:
                want.append((left, c, right))
        windows = sub.compact_windows(h, length)
        assert list(zip(*(x.tolist() for x in windows))) == want
        if n >= length:
            first, centre = sub.start_intervals(windows, length)
            assert [int(centre[np.searchsorted(first, s, "right") - 1]) for s in range(n - length + 1)] == [s + int(np.argmin(keys[s : s + length])) for s in range(n - length + 1)]


def passages(texts, size):
    own = defaultdict(set)
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        for i in range(len(w) - size + 1):
            own[b" ".join(w[i : i + size])].add(d)
    return set().union(*[v for v in own.values() if len(v) > 1], set())


def test_repeats_brute_force(spark, sf_dir):
    rng = random.Random(9)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fresh = lambda n: [f"{rng.randrange(10**6)}x" for _ in range(n)]
    passage = fresh(51)
    for k in range(5):
        texts[1000 + k] = " ".join(fresh(rng.randint(0, 60)) + passage + fresh(rng.randint(0, 60)))
    short = fresh(45)
    texts |= {2000: " ".join(fresh(40) + short), 2001: " ".join(short + fresh(40)), 2002: None, 2003: "few words"}
    rows = sub.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    found = {r.doc_id for r in rows} | {r.match_doc_id for r in rows}
    assert passages(texts, 50) <= found and not {2000, 2001, 2002, 2003} & found
    for r in rows:
        one, two = (texts[d].lower().split()[s:e] for d, s, e in ((r.doc_id, r.start_word, r.end_word), (r.match_doc_id, r.match_start_word, r.match_end_word)))
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (one, two))
        assert len(one) >= 50 and len(a & b) / len(a | b) == pytest.approx(r.similarity) and r.similarity >= 0.8
    planted = [r for r in rows if r.doc_id >= 1000]
    assert {(r.doc_id, r.end_word - r.start_word) for r in planted if r.match_doc_id == 1000} == {(1000 + k, 51) for k in range(1, 5)}


def test_recall_of_near_repeats(spark):
    """Passages with words replaced, added and cut, near the threshold: nine in ten are found at least, and nothing else is."""
    rng = random.Random(21)
    fresh = lambda n: [f"{rng.randrange(10**7)}r" for _ in range(n)]
    texts, planted = {}, set()
    for k in range(120):
        passage = fresh(rng.randint(60, 160))
        copy = list(passage)
        for _ in range(max(1, len(passage) // 60)):
            at = rng.randrange(5, len(copy) - 5)
            copy[at : at + 1] = [[], ["edit"], [copy[at], "more"]][k % 3]
        grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (passage, copy)]
        if len(grams[0] & grams[1]) >= 0.8 * len(grams[0] | grams[1]):
            planted.add(2 * k)
        texts[2 * k], texts[2 * k + 1] = fresh(rng.randint(0, 90)) + passage + fresh(20), fresh(rng.randint(0, 90)) + copy + fresh(30)
    rows = sub.repeated_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")).collect()
    found = {min(r.doc_id, r.match_doc_id) for r in rows}
    assert all(abs(r.doc_id - r.match_doc_id) == 1 and r.similarity >= 0.8 for r in rows)
    assert len(planted) > 60 and len(found & planted) >= 0.9 * len(planted)


def test_repeats_of_members_that_are_no_heads(spark):
    """A line stands in all documents, so most signatures have them all; pairs of documents share some words more, which those of least and largest id lack."""
    rng = random.Random(23)
    fresh = lambda n: [f"{rng.randrange(10**7)}m" for _ in range(n)]
    line, texts = fresh(45), {}
    for k in range(30):
        more = fresh(8)
        texts |= {1 + 2 * k: fresh(rng.randint(5, 40)) + line + more + fresh(40), 2 + 2 * k: fresh(rng.randint(5, 40)) + line + more + fresh(40)}
    texts |= {0: fresh(20) + line + fresh(40), 99: fresh(9) + line + fresh(50)}
    rows = sub.repeated_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")).collect()
    found = {(min(r.doc_id, r.match_doc_id), max(r.doc_id, r.match_doc_id)) for r in rows if r.end_word - r.start_word == 53}
    assert found == {(1 + 2 * k, 2 + 2 * k) for k in range(30)}
    assert all(abs(r.doc_id - r.match_doc_id) == 1 for r in rows)


def test_repeats_at_the_middle_place_of_a_head(spark):
    rng = random.Random(24)
    fresh = lambda n: [f"{rng.randrange(10**7)}p" for _ in range(n)]
    texts, want = {}, set()
    for k in range(30):
        line, more = fresh(45), [fresh(51) for _ in range(5)]
        texts[2 * k] = sum([line + x + fresh(30) for x in more], fresh(10))
        texts[2 * k + 1] = fresh(20) + line + more[k % 3 + 1] + fresh(20)
        want.add((2 * k + 1, 20, 116))
    rows = sub.repeated_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")).collect()
    assert want <= {(r.doc_id, r.start_word, r.end_word) for r in rows}
    assert all(texts[r.doc_id][r.start_word : r.end_word] == texts[r.match_doc_id][r.match_start_word : r.match_end_word] for r in rows)


def test_near_repeats_of_copies_in_one_document(spark):
    """A passage and its edited form stand in one document, exact copies of the first in others: the edited form repeats those."""
    rng = random.Random(25)
    fresh = lambda n: [f"{rng.randrange(10**7)}s" for _ in range(n)]
    passage = fresh(120)
    edited = passage[:60] + ["edit"] + passage[61:]
    texts = [(0, fresh(30) + passage + fresh(60) + edited + fresh(30))] + [(k, fresh(10) + passage + fresh(10)) for k in range(1, 6)]
    rows = sub.repeated_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in texts], "doc_id long, text string")).collect()
    spans = {(r.doc_id, r.start_word, r.end_word) for r in rows} | {(r.match_doc_id, r.match_start_word, r.match_end_word) for r in rows}
    assert (0, 210, 330) in spans and {(k, 10, 130) for k in range(1, 6)} <= spans


def test_common_signatures_are_joined_in_place(spark):
    rng = random.Random(22)
    line = [f"{rng.randrange(10**7)}c" for _ in range(70)]
    texts = [(k, " ".join([f"{rng.randrange(10**7)}o" for _ in range(rng.randint(0, 40))] + line)) for k in range(90)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    for one_in, most_bits in ((3, 29), (10**9, 29), (10**9, 3)):
        rows = sub.repeated_passages(frame, one_in=one_in, most_bits=most_bits).collect()
        assert {r.doc_id for r in rows if r.match_doc_id == 0 and r.end_word - r.start_word == 70} == set(range(1, 90))


def test_repeats_odd_rows(spark, odd_docs):
    rows = sub.repeated_passages(odd_docs).collect()
    assert {r.doc_id for r in rows} | {r.match_doc_id for r in rows} == {6, 7}
    assert sub.repeated_passages(odd_docs.where("false")).count() == 0


def test_near_passages_are_verified():
    w = [f"w{i}".encode() for i in range(300)]
    edited = list(w[20:90])
    edited[30] = b"X"
    (s, e, x, y, v) = next(sub.verified(w[20:90], edited, 46, 0.8))
    assert (s, e, x, y) == (0, 70, 0, 70) and 0.8 <= v < 1
    assert list(sub.verified(w[20:100] + [b"z"] * 9, [b"q"] * 7 + w[30:90] + [b"y"] * 30, 46, 0.8)) == [(10, 70, 7, 67, 1.0)]
    assert not list(sub.verified(w[:45] + [b"a"] * 20, w[:45] + [b"b"] * 20, 46, 0.8))


def test_passages_with_repeated_lines_are_verified():
    w = [f"w{i}".encode() for i in range(100)]
    once = w[:60]
    assert list(sub.verified(once, w[30:42] + [b"z%d" % i for i in range(20)] + once, 46, 0.8)) == [(0, 60, 32, 92, 1.0)]
    # No diagonal is longer for the first words, which stand far from the passage
    far = [b"q%d" % i for i in range(90)]
    assert (8, 68, 98, 158, 1.0) in list(sub.verified(w[80:88] + once, w[80:88] + far + once, 46, 0.8))


def judged(docs, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for item, text in items:
            v = words(text)
            for s in range(max(1, len(v) - window + 1) if v else 0):
                x = v[s : s + window]
                for p in range(len(w) - len(x) + 1):
                    if w[p : p + len(x)] == x:
                        hit |= set(range(p, p + len(x)))
                        names.add(str(item))
        out.append((str(d), len(w), len(hit), len(names), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("most_bits", [27, 3])  # a filter of 8 bits lets most shingles through
def test_decontamination_brute_force(spark, odd_docs, most_bits):
    rng = random.Random(3)
    vocab = ["aa", "bb", "Cc", "dé", "9"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, say(rng.choice([1, 2, 3, 5, 12, 13, 14, 20]))) for k in range(8)] + [(100, None), (101, "!!"), (7, "dog ate the")]
    docs = [(k, say(rng.randint(0, 60)) + (" " + items[k % 8][1] if k % 3 == 0 else "")) for k in range(40)] + [(None, items[0][1]), (50, None), (51, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = decontaminate(frame, benchmark, most_bits=most_bits).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows) == judged(docs, items)
    assert decontaminate(odd_docs, benchmark, most_bits=most_bits).count() == odd_docs.count()
    assert not decontaminate(frame, benchmark.where("false")).where("contaminated or n_items > 0").count()
    assert decontaminate(frame.where("false"), benchmark).count() == 0


def test_clean_documents(spark, odd_docs):
    benchmark = spark.createDataFrame([(1, "cat sat on the"), (None, "el gato"), (None, None)], "item_id long, text string")
    kept = clean_documents(odd_docs, benchmark)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in odd_docs.collect() if r.doc_id not in (1, 2, 9))
    nameless = decontaminate(odd_docs, benchmark.where("item_id is null and text is not null"))
    assert nameless.where("n_hit > 0 and n_items = 0").count() == nameless.where("n_hit > 0").count()


def test_places_of_repetitive_passages(monkeypatch):
    """The automaton places tokens as the table of runs does, and a word repeated very often costs linear time."""
    rng = np.random.default_rng(4)
    for size in (1, 5, 40, 150):
        for letters in (1, 2, 3, 9):
            a, b = rng.integers(0, letters, size), rng.integers(0, letters, size + 7)
            if size > 20:
                b[5:25] = a[:20]
            monkeypatch.setattr(sub, "MANY", 10**9)
            want = sub.places(a, b)
            monkeypatch.setattr(sub, "MANY", 0)
            assert (sub.places(a, b) == want).all()
    one = np.zeros(60_000, np.int64)
    began = time.perf_counter()
    assert (sub.places(one, one) >= 0).all() and time.perf_counter() - began < 20


def test_segments_of_many_pairs_at_once_equal_those_one_by_one():
    """Intervals of all pairs of a batch are merged together, as one pair after another would be."""

    def one_by_one(found, length):
        found, group = sorted(found, key=lambda x: (x[2], x[0])), []
        for x in [*found, None]:
            if group and (x is None or x[2] - group[-1][2] > sub._SHIFT):
                group.sort()
                a, e, low, high = group[0][0], group[0][1], group[0][0] - group[0][2], group[0][1] - group[0][2]
                for s, t, d in group[1:]:
                    if s > e + length:
                        yield a, e + length, low, high + length
                        a, e, low, high = s, t, s - d, t - d
                    e, low, high = max(e, t), min(low, s - d), max(high, t - d)
                yield a, e + length, low, high + length
                group = []
            group.append(x)

    rng = np.random.default_rng(8)
    n = 3000
    pair, a, d = rng.integers(0, 90, n), rng.integers(0, 900, n), rng.integers(-40, 40, n) * rng.integers(1, 4, n)
    e = a + rng.integers(0, 30, n)
    got = sorted(zip(*(x.tolist() for x in sub.merged(pair, a, e, d, 12))))
    assert got == sorted((k, *x) for k in range(90) for x in one_by_one([y[1:] for y in zip(pair.tolist(), a.tolist(), e.tolist(), d.tolist()) if y[0] == k], 12))
    none = np.zeros(0, np.int64)
    assert all(len(x) == 0 for x in sub.merged(none, none, none, none, 12))


def test_equal_words_are_one_passage_as_verified_finds_them():
    rng = np.random.default_rng(9)
    for words, n in ((3, 40), (1, 60), (500, 90), (2, 11), (5, 3), (9, 0)):
        text = [b"%d" % x for x in rng.integers(0, words, n)]
        assert list(sub.passages(b" ".join(text), b" ".join(text), 8, 0.8)) == list(sub.verified(text, text, 8, 0.8))
