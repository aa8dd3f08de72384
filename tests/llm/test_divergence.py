import random
import re
from collections import Counter

import pytest

from rasterflow.llm import op12_source_divergence
from rasterflow.llm.op12_source_divergence import divergence

DOCS = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(rows, min_docs, top):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for _, text, lang, source in rows]
    groups, out = {(a, b) for a, b, _ in docs}, []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    utf8 = lambda s: s.encode()
    for lang in {a for a, _ in groups}:
        df, occ = Counter(), Counter()
        for a, _, words in docs:
            if a == lang:
                df.update(set(words))
                occ.update(words)
        kept = {t for t, n in df.items() if n >= min_docs}
        v = len(kept)

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * v) for t in kept}

        q, own = shares(occ), {}
        for source in (b for a, b in groups if a == lang):
            counts = Counter(w for a, b, words in docs if (a, b) == (lang, source) for w in words)
            own[source] = counts, shares(counts)
        for source, (counts, p) in own.items():
            pairs = [(other, sum(f(p[t], r[t]) for t in kept)) for other, (_, r) in own.items() if other != source]
            terms = [(t, f(p[t], q[t])) for t in kept if counts[t] and p[t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], utf8(x[0])))[:most]
                out += [(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def corpus(seed, n=140):
    rnd = random.Random(seed)
    words = [f"{c}{d}" for c in "abcdefghÉß𝄞z" for d in "uvwxyz"]
    rows = []
    for i in range(n):
        source = rnd.choice(["hot", "hot", "b", "c", None, "", "ü", "𝄞", "~"])
        own = words[: 10 + 7 * len(source or "")]
        text = "".join(rnd.choice(own) + rnd.choice([" ", "-", "1", "\x00", "_", "\n", ""]) for _ in range(rnd.choice([0, 1, 5, 60])))
        rows.append((i, rnd.choice([text, text.upper(), text]), rnd.choice(["en", "en", "en", "de", None]), source))
    return rows + [(None, None, "en", "no text"), (1, "", "xx", None), (1, "12 34", "xx", "y"), (1, "12 34", "xx", "y")]


@pytest.mark.parametrize(("seed", "min_docs", "top"), [(1, 10, 10), (2, 2, 3), (3, 1, 1)])
def test_divergence_equals_brute_force(spark, seed, min_docs, top):
    rows = corpus(seed)
    assert sorted(map(tuple, divergence(spark.createDataFrame(rows, DOCS), min_docs, top).collect())) == brute(rows, min_docs, top)


def test_divergence_in_small_pieces_equals_brute_force(spark, monkeypatch):
    """Many hand-outs of sums, index pairs a few at a time."""
    rows = corpus(4)
    monkeypatch.setattr(op12_source_divergence, "AT_ONCE", 3)
    monkeypatch.setattr(op12_source_divergence, "PAIRED", 4)
    monkeypatch.setattr(op12_source_divergence, "HELD", 5)
    assert sorted(map(tuple, divergence(spark.createDataFrame(rows, DOCS), 3, 4).collect())) == brute(rows, 3, 4)


def test_search_goes_beyond_the_first_buckets(spark):
    """The largest counts are frequent everywhere, so leading terms stand in later buckets, with ties at the last rank."""
    rows = [(i, "the " * 500 + "of " * 300 + f"own{chr(97 + i % 5)} " * (3 + i % 2) + "rare " * (i % 3), "en", f"s{i % 5}") for i in range(60)]
    rows += [(100 + i, "".join(f" tie{chr(97 + j)}" for j in range(26)), "en", "s0" if i % 2 else "s9") for i in range(24)]
    for top in (2, 10, 26):
        assert sorted(map(tuple, divergence(spark.createDataFrame(rows, DOCS), 10, top).collect())) == brute(rows, 10, top)


def test_divergence_of_no_rows_and_clashing_columns(spark):
    assert divergence(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(i, "one two Two", "en", "a" if i % 2 else "b", "x", 1, 2, "z") for i in range(30)]
    got = divergence(spark.createDataFrame(rows, DOCS + ", term string, p int, c int, part string"))
    assert sorted(map(tuple, got.collect())) == brute([r[:4] for r in rows], 10, 10)


def test_very_long_text(spark):
    rows = [(0, "word " * 2_000_000 + "x" * 3_000_000, "en", "a"), (1, "word other", "en", "b")]
    assert sorted(map(tuple, divergence(spark.createDataFrame(rows, DOCS), 1, 10).collect())) == brute(rows, 1, 10)
