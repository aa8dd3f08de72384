import hashlib
import random
import re

import pytest

from rasterflow.llm import op1_ngram_jaccard
from rasterflow.llm.op1_ngram_jaccard import jaccard_components
from rasterflow.llm.op3_exact_dedup import chunks, exact_groups, normalised
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
DOCS = "doc_id long, text string"


def brute_components(rows, n, num, den):
    sets = {}
    for d, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus(seed, n=160):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ß", "naïve"]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    rows, base = [], []
    for i in range(n):
        if base and rnd.random() < 0.5:
            w = list(rnd.choice(base))
            for _ in range(rnd.randrange(0, 6)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        else:
            w = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 3, 4, 5, 9, 80, 150]))]
            if rnd.random() < 0.4:
                w += passage
        base.append(w)
        rows.append((i * 7 % 1009, rnd.choice([" ", "\n", "\t "]).join(w).replace("w1", "W1") if i % 2 else " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "n", "num"), [(1, 4, 85), (2, 5, 80), (3, 4, 85)])
def test_components_equal_brute_force(spark, seed, n, num):
    rows = corpus(seed) + [(5000, None), (5001, ""), (5002, " \n "), (5003, "One"), (5004, "one"), (5005, "a b b a c"), (5006, "b a a b c")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, DOCS), n, num, 100).collect()}
    assert got == brute_components(rows, n, num, 100)


def test_pairs_at_the_bound_equal_brute_force(spark):
    rnd, rows = random.Random(11), []
    for i in range(60):
        w = [f"p{i}x{rnd.randrange(400)}" for _ in range(rnd.randrange(20, 110))]
        v = list(w)
        for _ in range(rnd.randrange(1, 5)):
            v.insert(rnd.randrange(len(v)), f"new{rnd.randrange(99)}")
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, DOCS), 4, 85, 100).collect()}
    assert got == brute_components(rows, 4, 85, 100)


def test_dense_group_in_many_parts_equals_brute_force(spark, monkeypatch):
    """Copies of copies: links are a part of all pairs, blocks are dealt in small parts over several rounds."""
    monkeypatch.setattr(op1_ngram_jaccard, "PART_DOCS", {"forest": 8, "full": 16})
    rnd, rows = random.Random(12), []
    base = [f"g{i}" for i in range(200)]
    for i in range(120):
        w = list(base)
        for _ in range(rnd.randrange(1, 8)):
            w[rnd.randrange(200)] = f"edit{i}.{rnd.randrange(999)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, DOCS), 4, 85, 100).collect()}
    assert got == brute_components(rows, 4, 85, 100)


@pytest.mark.parametrize(("seed", "n", "num"), [(4, 4, 85), (5, 5, 80)])
def test_all_links_equal_brute_force(spark, seed, n, num):
    rows = corpus(seed, 120) + [(5000, None), (5001, ""), (5003, "One"), (5004, "one")]
    sets = {}
    for d, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    linked = lambda x, y: bool(x & y) and 100 * len(x & y) >= num * len(x | y)
    first = {d: min(e for e in sets if sets[e] == s) if s else d for d, s in sets.items()}
    links, counts = op1_ngram_jaccard.jaccard_links(spark.createDataFrame(rows, DOCS), n, num, 100)
    assert {tuple(sorted(r)) for r in links.collect()} == {(a, b) for a in set(first.values()) for b in set(first.values()) if a < b and linked(sets[a], sets[b])}
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in counts.collect()} == {(d, first[d], sum(linked(s, x) for e, x in sets.items() if e != d)) for d, s in sets.items()}


def test_large_group_of_near_copies_and_a_long_word(spark):
    rnd = random.Random(5)
    base = [f"v{rnd.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rnd.randrange(200)] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000, "x" * 700_000 + " y"), (1001, "x" * 700_000 + " Y"), (1002, "x" * 699_999 + "z y")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(spark.createDataFrame(rows, DOCS), 4, 85, 100).collect()}
    assert {got[i] for i in range(150)} == {0}
    assert (got[1000], got[1001], got[1002]) == (1000, 1000, 1002)


def test_jaccard_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], DOCS)
    assert jaccard_components(empty).count() == 0
    more = spark.createDataFrame([(1, "a b c d e f", 3, "x"), (1, "a b c d e f", 4, "y"), (None, "a", 1, "z")], "doc_id long, text string, n long, root string")
    assert [tuple(r) for r in jaccard_components(more).collect()] == [(1, 2, 1, 1)]


@pytest.mark.parametrize("key_bits", [64, 2])
def test_exact_groups_equal_brute_force(spark, key_bits):
    long = "Sentence one. " * 4000
    rows = [(1, "Abc"), (2, "aBC"), (3, "ÀBC"), (4, "àBC"), (5, None), (6, ""), (7, long), (8, long.upper()), (9, long + "x"), (9, long + "x"), (10, "İI"), (11, "İi"), (None, "only"), (None, "abc")]
    got = sorted(map(tuple, exact_groups(spark.createDataFrame(rows, DOCS), key_bits=key_bits).collect()), key=repr)
    norm = [(d, (t or "").translate(LOWER)) for d, t in rows]
    want = []
    for d, t in norm:
        group = [x for x, y in norm if y == t]
        keep = max((x for x in group if x is not None), default=None)
        want.append((d, keep, len(group), keep is None or d == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_chunks_join_to_the_text(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab. \nÉ𝄞") for _ in range(rnd.choice([0, 1, 60, 5000]))) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", chunks(F.col("text"), 16, 64).alias("c"), normalised(F.col("text")).alias("n"))
    for r in df.collect():
        assert "".join(r["c"]) == r["text"] and all(len(x) <= 64 for x in r["c"])
        assert r["n"] == r["text"].translate(LOWER)


def test_exact_groups_empty(spark):
    assert exact_groups(spark.createDataFrame([], DOCS)).count() == 0
