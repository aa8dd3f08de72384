import random
import re
from collections import Counter

from rasterflow.llm.op8_quality_rules import Condition, RATIOS, labelled, learn, measured, quality, verdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, n_words string"


def brute(text):
    text = text or ""
    w = WORDS.findall(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = [False] * len(w)
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            covered[i : i + 8] = [True] * 8
    lines, seen, dup = [x for x in text.split("\n") if WORDS.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    n, r = len(w), sum(covered)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, r, n < 20 or 100 * r > 30 * n


def test_counts_equal_brute_force(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["a ", "b ", "c\n", "É𝄞 ", "\x0b", "#|<", " ", "\r\n"]) for _ in range(rnd.choice([0, 5, 40, 300]))) for _ in range(120)]
    texts += [None, "", "\n\n", "a b c d e f g h " * 2, "x " * 5000, " ".join(map(str, range(3000))), "a b c d e f g h i j k l m n o p q r s t"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "clash"), (None, "a", None)]
    got = sorted(tuple(r)[:7] for r in quality(spark.createDataFrame(rows, DOCS), []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect() if r["doc_id"] is not None)
    assert got == sorted((d, *brute(t)) for d, t, _ in rows if d is not None)


def test_further_statistics_equal_brute_force(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(30))) for _ in range(60)] + [None, "", "a", "a a", "a\n\na", "É é É"]
    for r in measured(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], DOCS)).select("row.doc_id", "stats.n_adjacent", "stats.n_lines").collect():
        w = WORDS.findall(texts[r["doc_id"]] or "")
        lines = sum(bool(WORDS.search(x)) for x in (texts[r["doc_id"]] or "").split("\n"))
        assert (r["n_adjacent"], r["n_lines"]) == (sum(a == b for a, b in zip(w, w[1:])), lines)


def test_learned_list_on_held_out_rows(spark):
    rnd = random.Random(2)

    def text(bad):
        w = [rnd.choice("lorem ipsum dolor sit amet consectetur elit sed".split()) for _ in range(rnd.randint(40, 90))]
        return " ".join(x + ("***" if rnd.random() < 0.6 else "") for x in w) if bad else " ".join(w)

    rows = [(i, text(i % 5 == 0), "") for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(400)] + [(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    sample = labelled(docs, labels)
    rules = learn(sample)
    assert rules and learn(sample) == rules
    judged = {r["doc_id"]: r["ok"] for r in measured(docs).select("row.doc_id", verdict(rules).alias("ok")).where("doc_id >= 400").collect()}
    assert sum(ok == (d % 5 != 0) for d, ok in judged.items()) / len(judged) > 0.95


def test_bound_of_the_sample(spark):
    docs = spark.createDataFrame([(i, "word " * 30 + str(i) * 9, "") for i in range(200)], DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    assert len(labelled(docs, labels, sample=50)) <= 50


def test_edges(spark):
    assert learn([]) == []
    assert learn([({k: 1.0 for k in RATIOS}, True)] * 5) == []
    empty = spark.createDataFrame([], DOCS)
    assert quality(empty, [(Condition("symbols", True, 0.1), Condition("n_words", False, 5.0))]).count() == 0


def test_rules_go_on_behind_an_imprecise_one():
    """The best first condition covers a mixed lot; a conjunction behind it tells the rest."""
    rnd = random.Random(4)
    row = lambda **k: dict.fromkeys(RATIOS, 0.0) | k
    rows = [(row(symbols=0.5 + rnd.random(), n_words=rnd.random()), i % 10 < 7) for i in range(300)]
    rows += [(row(upper=0.5 + rnd.random() / 2, marks=0.5 + rnd.random() / 2, n_words=rnd.random()), True) for _ in range(90)]
    rows += [(row(upper=0.5 + rnd.random() / 2, n_words=rnd.random()), False) for _ in range(150)] + [(row(marks=0.5 + rnd.random() / 2, n_words=rnd.random()), False) for _ in range(150)]
    rnd.shuffle(rows)
    rules = learn(rows)
    hit = lambda x: any(all(c.holds(x) for c in rule) for rule in rules)
    assert all(hit(x) for x, _ in rows if x["upper"] and x["marks"])
    assert sum(hit(x) for x, bad in rows if not bad) <= 0.02 * len(rows)
    assert any(len(rule) > 1 for rule in rules)


def test_a_conjunction_on_texts_holds_on_held_out_rows(spark):
    """Bad texts are short and full of capitals; short ones alone and capitals alone are good, so no single condition tells them."""
    rnd = random.Random(6)
    words = "lorem ipsum dolor sit amet consectetur elit sed eiusmod tempor".split()

    def text(i):
        short, loud = i % 4 in (0, 1), i % 4 in (0, 2)
        w = [rnd.choice(words) + str(rnd.randrange(9)) for _ in range(rnd.randint(25, 45) if short else rnd.randint(200, 300))]
        return " ".join(x.upper() if loud and rnd.random() < 0.6 else x for x in w)

    docs = spark.createDataFrame([(i, text(i), "") for i in range(800)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    rules = learn(labelled(docs, labels))
    assert any(len(rule) > 1 for rule in rules)
    judged = {r["doc_id"]: r["kept"] for r in quality(docs, rules).collect() if r["doc_id"] >= 400}
    dropped = [d for d, kept in judged.items() if not kept]
    precision, recall = sum(d % 4 == 0 for d in dropped) / len(dropped), sum(d % 4 == 0 for d in dropped) / 100
    assert precision > 0.95 and recall > 0.95
