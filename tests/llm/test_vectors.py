import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterflow.llm import op11_exact_topk
from rasterflow.llm.op11_exact_topk import top_inner_products
from rasterflow.llm.op13_vector_codes import Codebooks, compressed

ROWS = "vec_id long, embedding array<float>, label int"
ODD = [(900, None, 1), (901, [0.5, None, 0.5], 1), (902, [math.nan] * 3, 2), (903, [math.inf, 0.0, 0.0], 2)]


def whole(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [clip(math.floor(256 * float(np.float32(x)))) for x in v]


def clip(n):
    return max(-(1 << 63), min((1 << 63) - 1, n))


def brute_top(rows, every, k):
    kept = [(i, w) for i, v, *_ in rows if i is not None and (w := whole(v)) is not None]
    out = []
    for q in sorted({i for i, _ in kept if i % every == 0}):
        x = min(w for i, w in kept if i == q)
        best = sorted((-clip(sum(a * b for a, b in zip(x, w))), i) for i, w in kept if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


def brute_codes(rows, parts, size, rounds):
    kept = [(i, w, label) for i, v, label, *_ in rows if (w := whole(v)) is not None]
    width = -(-max(len(w) for _, w, _ in kept) // parts) or 1
    kept = [(i, w + [0] * (parts * width - len(w)), label) for i, w, label in kept]
    cut = lambda w, p: w[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:size]
    books = [[cut(w, p) for _, w, _ in first] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(v, e)), n) for n, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(cut(w, p), p)[1] for _, w, _ in kept]
            books[p] = [[sum(c) // len(c) for c in zip(*members)] if (members := [cut(w, p) for (_, w, _), n in zip(kept, own) if n == e]) else entry for e, entry in enumerate(books[p])]
    codes = [[near(cut(w, p), p) for p in range(parts)] for _, w, _ in kept]
    errors = [sum(d for d, _ in c) for c in codes]
    by_label = {label: sum(e for e, (_, _, other) in zip(errors, kept) if other == label) for _, _, label in kept}
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted((repr(i), "".join(f"{n:02x}" for _, n in c), e, by_label[label]) for (i, _, label), c, e in zip(kept, codes, errors)), digest


def table(seed, n=220, d=8, kinds=("wide", "same", "low")):
    rnd = random.Random(seed)
    base = [rnd.gauss(0, 0.2) for _ in range(d)]
    rows = []
    for i in range(n):
        kind = rnd.choice(kinds)
        size = rnd.choice([0.1, 1, 3]) if kind == "wide" else 1
        v = base if kind == "same" else [size * rnd.gauss(0, 0.3) for _ in range(d)]
        if kind == "low":
            v = [x if j < 2 else x / 50 for j, x in enumerate(v)]
        rows.append((i, [float(np.float32(x)) for x in v], rnd.choice([None, 1, 2])))
    return rows


@pytest.mark.parametrize(("seed", "d"), [(1, 8), (2, 1), (3, 16)])
def test_top_products_equal_brute_force(spark, monkeypatch, seed, d):
    """Small blocks and groups, so that bounds between blocks, steps of a task and groups of queries all act."""
    for name, size in (("HEAD", 16), ("BLOCK", 32), ("ASKED", 8), ("STEP", 8)):
        monkeypatch.setattr(op11_exact_topk, name, size)
    rows = table(seed, d=d) + ODD
    rnd = random.Random(seed)
    rnd.shuffle(rows)
    got = top_inner_products(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 10, 5)


def test_top_products_with_ties_repeats_short_and_extreme_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.5], 1), (2, [0.5, 9.0], 1), (2, [0.5, 9.0], 1), (3, [], 1), (4, [0.5, -3.0], 1), (10, [0.0, 0.0], 1), (None, [9.0, 9.0], 1), (5, [-1e12, 1e12], 1), (7, [-3e38, 0.0], 1), (8, [-3e38, 0.0], 1), (6, [1e12, 1e12], 1), (20, [3e30, -1.0], 1)]
    got = top_inner_products(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 10, 5)


def test_top_products_of_few_rows_and_clashing_columns(spark):
    asks = F.col("vec_id") % 50 == 0
    assert top_inner_products(spark.createDataFrame([], ROWS), asks).count() == 0
    assert top_inner_products(spark.createDataFrame([(0, [1.0], 1)], ROWS), asks).count() == 0
    more = spark.createDataFrame([(0, [1.0], "a", 1, 2, 3), (1, [2.0], "b", 1, 2, 3)], "vec_id long, embedding array<float>, x string, h int, g int, length int")
    assert [tuple(r) for r in top_inner_products(more, asks).collect()] == [(0, 1, 1, 256 * 512)]


def test_bounds_leave_pairs_out():
    """On vectors of a few directions, most pairs are never scored exactly."""
    rnd = np.random.default_rng(7)
    x = np.floor(256 * rnd.normal(0, 1, (2000, 3)) @ rnd.normal(0, 1, (3, 32))).astype(np.int64)
    turn = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]
    bounds, scored = op11_exact_topk._Bounds(32, 5, turn, float(abs(x).max())), []
    whole_scores = bounds.scores
    bounds.scores = lambda q, c: (scored.append(len(q)), whole_scores(q, c))[1]
    ids = np.arange(2000)
    who, found, _ = bounds.search(ids[:40], x[:40], np.full(40, -np.inf), ids, x)
    assert sum(scored) < 0.4 * 40 * 2000
    want = [sorted(ids, key=lambda j: (-int(x[i] @ x[j]), j) if i != j else (math.inf, j))[:5] for i in range(40)]
    assert [list(found[who == i]) for i in range(40)] == want


@pytest.mark.parametrize(("seed", "parts", "size"), [(1, 4, 16), (2, 2, 64), (3, 3, 5)])
def test_codes_equal_brute_force(spark, seed, parts, size):
    rows = table(seed) + ODD
    random.Random(seed).shuffle(rows)
    coded, books = compressed(spark.createDataFrame(rows, ROWS), parts, size)
    want, digest = brute_codes(rows, parts, size, 2)
    assert sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in coded.collect()) == want
    assert books.sha256() == digest


def test_codes_with_repeats_nulls_short_and_extreme_vectors(spark):
    rows = [(3, [1.0, 2.0, 3.0], None), (3, [1.0, 2.0, 2.5], None), (3, [1.0, 2.0, 3.0], 7), (None, [0.0], 7), (1, [], 1), (2, [5e6, -5e6, 1.0], 1), (4, [5e6, -4e6, 1.0], 2), *ODD]
    coded, books = compressed(spark.createDataFrame(rows, ROWS), 2, 3)
    want, digest = brute_codes(rows, 2, 3, 2)
    assert sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in coded.collect()) == want
    assert books.sha256() == digest
    huge = compressed(spark.createDataFrame([(i, [x, 0.0], 1) for i, x in enumerate([3e38, -3e38, 1.0])], ROWS), 2, 1)[0]
    assert huge.count() == 3


def test_codes_of_no_rows_and_clashing_columns(spark):
    coded, books = compressed(spark.createDataFrame([], ROWS))
    assert coded.count() == 0 and books is None
    more = spark.createDataFrame([(1, [0.5] * 16, 4, "a", "b", 1)], "vec_id long, embedding array<float>, label int, x string, code string, its int")
    assert [tuple(r) for r in compressed(more)[0].collect()] == [(1, 4, "00" * 16, 0, 0)]


def test_search_scans_short_lists_when_parts_start_near():
    rnd = np.random.default_rng(5)
    entries = rnd.integers(-5000, 5000, (1, 64, 4))
    books = Codebooks(entries)
    x = entries[0, rnd.integers(0, 64, 3000)] + rnd.integers(-40, 41, (3000, 4))
    want = ((x[:, None, :] - entries[0][None]) ** 2).sum(axis=2)
    far = books.assign(x, np.zeros((3000, 1), np.uint8), True)
    near = books.assign(x, far[0], True)
    for codes, d in (far, near):
        assert (codes[:, 0] == want.argmin(axis=1)).all() and (d[:, 0] == want.min(axis=1)).all()
    own = ((x - entries[0, far[0][:, 0]]) ** 2).sum(axis=1)
    scanned = [np.searchsorted(books.gaps[0, e], 4 * u, side="right") for e, u in zip(far[0][:, 0], own)]
    assert np.mean(scanned) < 4


