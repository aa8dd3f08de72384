import hashlib
import random
import zlib
from collections import defaultdict
from decimal import Decimal

import numpy as np
import pytest

from rasterflow.llm import op2_packing
from rasterflow.llm.op2_packing import best_fit, best_fit_counts, certificate, lower_bound, pack, pack_documents
from rasterflow.llm.op7_mixing import mix

DOCS = "doc_id long, text string, source string, sequence_id string"


def test_bound_is_below_every_packing():
    rnd = random.Random(1)
    for _ in range(60):
        sizes = np.array([rnd.randint(1, 100) for _ in range(rnd.randint(1, 40))])
        bins = best_fit(sizes, 100)
        fill = np.bincount(bins, weights=sizes)
        assert fill.max() <= 100 and (fill > 0).all()
        assert -(-sizes.sum() // 100) <= lower_bound(sizes, 100) <= len(fill)


def test_bound_certifies_large_items():
    assert lower_bound(np.array([60] * 7), 100) == 7
    assert lower_bound(np.array([34] * 6), 100) == 3


def test_packed_documents_are_whole(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(2)
    letters = "abcdeÉßÅΣ𝄞 ,.\n\t1x'<|endoftext|>  ́"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.choice([0, 3, 400, 9000]))) for _ in range(60)] + [None, "", "<|endoftext|> a<|startoftext|>b", "don't we're", "a " * 9000]
    rows = [(i, t, "s", "clash") for i, t in enumerate(texts)] + [(3, texts[3], "s", "clash")]
    got = pack_documents(spark.createDataFrame(rows, DOCS)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want = [(k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
        assert sorted(by_doc[d]) == sorted(want * (2 if d == 3 else 1))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in got)
    assert len(by_sequence) <= -(-total // 4096) + 1


def test_groups_exchange_down_to_the_bound(spark):
    rnd = random.Random(3)
    rows = spark.createDataFrame([(i, rnd.randint(1, 4095)) for i in range(1500)], "doc_id long, length long")
    got = pack(rows, group=50).groupBy("sequence_id").sum("length").collect()
    sizes = np.array([r["length"] for r in rows.collect()])
    assert max(r[1] for r in got) <= 4096
    assert len(got) <= lower_bound(sizes, 4096) * 1.03


def test_rounds_go_on_until_all_loose_documents_met(spark):
    rnd = random.Random(5)
    rows = spark.createDataFrame([(i, rnd.randint(1, 2000)) for i in range(3000)], "doc_id long, length long")
    got = pack(rows, group=2).groupBy("sequence_id").sum("length").collect()
    sizes = np.array([r["length"] for r in rows.collect()])
    assert sum(r[1] for r in got) == sizes.sum() and max(r[1] for r in got) <= 4096
    assert len(got) <= lower_bound(sizes, 4096) * 1.01


def test_best_fit_over_counts_equals_best_fit_over_sizes():
    rnd = np.random.default_rng(6)
    for most in (7, 100, 4096):
        for _ in range(60):
            sizes = rnd.integers(1, rnd.integers(2, most), rnd.integers(1, 400))
            values, n = np.unique(sizes, return_counts=True)
            patterns = best_fit_counts(dict(zip(values.tolist(), n.tolist(), strict=True)), most)
            assert sum(k for k, _ in patterns) == int(best_fit(sizes, most).max()) + 1
            got = {}
            for k, items in patterns:
                at = 0
                for size, copies, offset in items:
                    assert offset == at
                    at += size * copies
                    got[size] = got.get(size, 0) + k * copies
                assert at <= most
            assert got == dict(zip(values.tolist(), n.tolist(), strict=True))
    assert len(best_fit_counts({i: 10**9 + i for i in range(1, 4096)}, 4096)) < 3 * 4096


def test_exchange_closes_gaps_and_keeps_any_column(spark, monkeypatch):
    """Many small partitions, each with a gap; ranks are dealt in parts of a few rows."""
    monkeypatch.setattr(op2_packing, "RANKED", 16)
    rnd = np.random.default_rng(3)
    sizes = rnd.integers(1, 4097, 3000).tolist() + [4096] * 3 + [1365] * 900
    rows = spark.createDataFrame([(i, x, -1, "o", "r", x) for i, x in enumerate(sizes)], "doc_id long, length long, sequence_id long, offset string, _row string, its long")
    packed = pack(rows, group=40)
    assert packed.columns == ["doc_id", "length", "_row", "its", "sequence_id", "offset"]
    got = {}
    for r in packed.collect():
        got.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert sizes[r["doc_id"]] == r["length"] == r["its"] and r["_row"] == "r"
    assert sum(map(len, got.values())) == len(sizes)
    for parts in got.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    whole = np.array(sizes)
    assert certificate(packed)[1] <= len(got) <= int(best_fit(whole[whole < 4096], 4096).max()) + 1 + int((whole == 4096).sum())


def test_certificate_of_all_rows(spark):
    rnd = random.Random(9)
    sizes = [rnd.randint(1, 4096) for _ in range(800)]
    packed = pack(spark.createDataFrame([(i, x) for i, x in enumerate(sizes)], "doc_id long, length long"))
    used, least = certificate(packed)
    assert least == lower_bound(np.array(sizes), 4096) <= used == packed.select("sequence_id").distinct().count()
    exact = pack(spark.createDataFrame([(i, 1024) for i in range(400)], "doc_id long, length long"))
    assert certificate(exact) == (100, 100) and certificate(exact.where("false")) == (0, 0)


def test_packing_empty(spark):
    assert pack_documents(spark.createDataFrame([], DOCS)).count() == 0


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, stopped, left = {}, set(), share * sum(sizes.values())
    while True:
        w = sum(weight[s] for s in order if s not in stopped)
        new = {s for s in order if s not in stopped and left * weight[s] / w > most * sizes[s]} if w else set()
        if not new:
            return target | {s: left * weight[s] / w for s in order if s not in stopped}
        for s in new:
            target[s] = most * sizes[s]
            left -= target[s]
        stopped |= new


def test_targets_and_near_samples(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(1200):
        source = rnd.choice(["é", "b", "Z", "big", "big", "big", None, "\U0001d11e", "tiny" if i < 30 else "b"])
        rows.append((i, " ".join(["w"] * rnd.choice([0, 1, 5, 30, 200])), source, "x"))
    rows.append((2000, None, "none", "x"))
    df = spark.createDataFrame(rows, DOCS)
    got = mix(df).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 30 + want[s] / 100
    again = mix(df.repartition(7)).collect()
    assert {(r["doc_id"], r["taken"]) for r in again} == {(r["doc_id"], r["taken"]) for r in got}


def test_weights_shift_inclusion(spark):
    rows = [(i, "a b c d", "s" if i % 2 else "t", "x") for i in range(2000)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "case when doc_id % 4 < 2 then 3.0 else 1.0 end as weight")
    got = mix(df, weights=(1,), share=0.4, weight="weight").collect()
    heavy = sum(r["taken"] for r in got if r["doc_id"] % 4 < 2)
    light = sum(r["taken"] for r in got if r["doc_id"] % 4 >= 2)
    assert 2.2 < heavy / light < 4.2
    assert abs(heavy + light - 0.4 * 8000) <= 8


def brute_mix(rows, weights=(3, 1, 2), share=1.5, most=2, seed=7):
    """taken by doc_id, from rows (doc_id, size, source, weight): Pareto order sampling, one source after the other."""
    sizes = defaultdict(int)
    for _, n, s, _ in rows:
        sizes[s] += n
    taken = {}
    for source, target in brute_targets(sizes, weights, share, most).items():
        mine = [r for r in rows if r[2] == source]
        mass, units, whole, certain = float(sum(n * Decimal(repr(w)) for _, n, _, w in mine)), [], {}, 0
        for d, n, _, w in mine:
            u = (int(hashlib.md5(f"{seed}:{d}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            e = min(float(most), target / mass * w) if mass else 0.0
            whole[d], p = int(e), e - int(e)
            certain += whole[d] * n
            for k in range(1, most - whole[d] + 1):
                odds = u / (1 - u) / (p / (1 - p)) if p else 0
                units.append(((odds / (1 + odds) if p else 1 + u) if k == 1 else k + u, d, n))
        room, got = round(target) - certain, defaultdict(int)
        units = sorted(x for x in units if x[2])
        at = 0
        while at < len(units) and units[at][2] <= room:
            room -= units[at][2]
            got[units[at][1]] += 1
            at += 1
        if rest := [(abs(n - room), z, d) for z, d, n in units[at:] if abs(n - room) < room]:
            got[min(rest)[2]] += 1
        taken |= {d: (whole[d] + got[d]) * n for d, n, _, _ in mine}
    return taken


@pytest.mark.parametrize("share", [0.4, 1.5])
def test_unequal_samples_equal_brute_force(spark, share):
    rnd = random.Random(6)
    rows = [(i, rnd.choice([0, 1, 3, 20, 90]), rnd.choice(["a", "b", "c", "c", "c", None]), rnd.choice([0.25, 1.0, 1.5, 4.125])) for i in range(900)]
    df = spark.createDataFrame([(d, " ".join(["w"] * n), s, w) for d, n, s, w in rows], "doc_id long, text string, source string, weight double")
    got = {r["doc_id"]: r["taken"] for r in mix(df, share=share, weight="weight").collect()}
    assert got == brute_mix(rows, share=share)
    assert len({got[d] / n for d, n, _, _ in rows if n}) > 1


def test_many_sources_equal_brute_force(spark):
    rnd = random.Random(7)
    rows = [(i, " ".join(["w"] * rnd.choice([1, 5, 30])), f"https://host{rnd.randrange(400)}/é", "x") for i in range(1500)]
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len(t.split())
    want = brute_targets(sizes)
    for r in mix(spark.createDataFrame(rows, DOCS)).collect():
        assert r["target"] == pytest.approx(want[r["source"]])


def test_mixing_edges(spark):
    assert mix(spark.createDataFrame([], DOCS)).count() == 0
    nothing = mix(spark.createDataFrame([(1, None, None, None), (None, " ", "a", None)], DOCS)).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in nothing] == [(0, 0, 0.0)] * 2
    ties = mix(spark.createDataFrame([(1, "a b", "s", "x")] * 6, DOCS)).collect()
    assert all(r["taken"] <= 4 for r in ties)
