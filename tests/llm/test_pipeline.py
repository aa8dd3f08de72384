import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from rasterflow.llm import registry
from rasterflow.llm.op8_quality_rules import learn, labelled

SMALL = "/root/testdata/sf0.001"


def test_stages_hold_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SMALL)
        assert out.columns == columns, name
        out.write.parquet(path := f"{tmp_path}/{name}")
        docs = spark.read.parquet(path)
        rows = docs.collect()
        after = {r["doc_id"]: r["text"] for r in rows}
        assert set(after) <= set(before) and all(before[d] == t for d, t in after.items())
        if name == "exact_dedup":
            lower = {d: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for d, t in before.items()}
            assert set(after) == {max(d for d, x in lower.items() if x == t) for t in set(lower.values())}
        if name == "near_dedup":
            import re

            sets = {}
            for d, t in before.items():
                w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
                sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
            kept = sorted(after)
            assert all(100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b]) for i, a in enumerate(kept) for b in kept[i + 1 :] if sets[a] | sets[b])
            assert all(any(100 * len(sets[d] & sets[x]) >= 80 * len(sets[d] | sets[x]) for x in before if x != d) for d in set(before) - set(after))
        if name == "mixing":
            assert 1.3 * sum(len(t.split()) for t in before.values()) < sum(len(r["text"].split()) for r in rows) < 1.6 * sum(len(t.split()) for t in before.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r["doc_id"] for r in packed} == set(after)
    fill = {}
    for r in packed:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 4096 and len(fill) <= -(-sum(fill.values()) // 4096) + 1


def odd_ids(spark):
    """Unique texts, copies, and doc_ids that are null or repeated with other texts."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    near = lambda k: text(k) + " tail"
    rows = [(1, text(1)), (2, text(2)), (3, text(3)), (None, text(2)), (None, text(4)), (None, text(5)), (3, text(1)), (3, text(6)), (7, text(7)), (7, text(7)), (None, text(8)), (None, text(8)), (9, near(4)), (9, near(9)), (10, text(10))]
    rows += [(11, text(11).upper()), (11, text(11))]
    return spark.createDataFrame([(d, t, "en", ("a", "b", None)[k % 3], len(t)) for k, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long"), text, near


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def some(rows):
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=repr)


def test_quality_rules_judge_rows_with_odd_ids_by_themselves(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in stage("quality_rules")(spark, docs, SMALL).collect()}
    odd = docs.selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars").unionByName(docs)
    got = some(stage("quality_rules")(spark, odd, SMALL).collect())
    assert got == sorted([*kept.items(), *((None, t) for t in kept.values())], key=repr)


def test_exact_dedup_keeps_texts_with_odd_ids(spark):
    docs, text, near = odd_ids(spark)
    got = some(stage("exact_dedup")(spark, docs, SMALL).collect())
    want = [(2, text(2)), (3, text(3)), (None, text(4)), (None, text(5)), (3, text(1)), (3, text(6)), (7, text(7)), (None, text(8)), (9, near(4)), (9, near(9)), (10, text(10)), (11, text(11).upper())]
    assert got == sorted(want, key=repr)


def test_near_dedup_judges_texts_with_odd_ids_by_themselves(spark):
    docs, text, near = odd_ids(spark)
    got = some(stage("near_dedup")(spark, docs, SMALL).collect())
    texts = [t.lower() for _, t in got]
    assert {t for t in texts if t not in (text(4), near(4))} == {*map(text, (1, 2, 3, 5, 6, 7, 8, 10, 11)), near(9)}
    assert (text(4) in texts) != (near(4) in texts)
    assert set(got) <= set(some(docs.collect()))


def test_mixing_takes_texts_with_odd_ids_at_most_twice(spark):
    docs, text, near = odd_ids(spark)
    more = docs.unionByName(docs.selectExpr("cast(null as long) as doc_id", "concat(text, ' ', doc_id) as text", "lang", "source", "n_chars").where("text is not null"))
    many = lambda rows: {k: sum(1 for r in rows if (r["doc_id"], r["text"], r["source"]) == k) for k in {(r["doc_id"], r["text"], r["source"]) for r in rows}}
    before, rows = many(more.collect()), stage("mixing")(spark, more, SMALL).collect()
    after = many(rows)
    assert set(after) <= set(before) and all(n <= 2 * before[k] for k, n in after.items())
    words = sum(len(r["text"].split()) for r in more.collect())
    assert 1.2 * words < sum(len(r["text"].split()) for r in rows) < 1.7 * words


CLASH = ["row", "stats", "_stats", "_w", "_l", "_of", "_copy", "_key", "key", "copies", "copy", "from", "of", "sha", "digest", "again", "gone", "kept", "n", "size", "favour", "a.b", "_row", "length"]


@pytest.mark.parametrize("name", [k for k, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_pass_columns_with_clashing_names_and_empty_tables(spark, name):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = docs.selectExpr("*", *[f"doc_id + {k} as `{c}`" for k, c in enumerate(CLASH)])
    plain = some(stage(name)(spark, docs, SMALL).collect())
    out = stage(name)(spark, more, SMALL)
    assert out.columns == more.columns
    rows = out.collect()
    assert some(rows) == plain
    assert all(r[c] == r["doc_id"] + k for r in rows for k, c in enumerate(CLASH))
    assert stage(name)(spark, more.where("false"), SMALL).collect() == []


@pytest.mark.parametrize("name", [k for k, _ in corpus_pipeline.STAGES])
def test_stages_take_null_empty_and_very_long_texts(spark, name):
    long = " ".join(f"word{k}" for k in range(150_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (4, long), (5, None), (None, None), (6, " ".join(f"x{k}" for k in range(30)))]
    docs = spark.createDataFrame([(d, t, None, None if d == 6 else "s", None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = stage(name)(spark, docs, SMALL).collect()
    ids = sorted([r["doc_id"] or 0 for r in got])
    if name == "packing":
        assert sum(r["length"] for r in got) > 300_000 and {0, 1, 2, 3, 4, 5, 6} == set(ids)
        return
    texts = {r["doc_id"]: r["text"] for r in got}
    if name == "quality_rules":
        assert ids == [4, 4, 6]
    if name == "exact_dedup":
        assert ids == [3, 4, 5, 6]
    if name == "near_dedup":
        assert ids == [0, 1, 2, 3, 4, 4, 5, 6]
    if name == "mixing":
        assert set(ids) <= {4, 6}
    assert 4 not in texts or texts[4] == long


def test_stage_tables_are_deleted(spark, tmp_path):
    from rasterflow.llm import _shared

    with _shared.paths_made() as made:
        out = corpus_pipeline.run(spark, SMALL)
    there = [p for p in made if __import__("os").path.exists(p.removeprefix("file:").replace("//", "/"))]
    assert out.count() > 0
    assert not [p for p in there if any(f"/{k}-" in p for k in ("quality_rules", "exact_dedup", "near_dedup", "mixing", "profile", "blocks", "judged"))]


def test_packing_packs_rows_with_odd_ids_each(spark):
    docs, _, _ = odd_ids(spark)
    ids = lambda rows: sorted((r["doc_id"] for r in rows), key=repr)
    assert ids(stage("packing")(spark, docs, SMALL).collect()) == ids(docs.collect())


def test_clean_labelled_documents_stay(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    assert len(labelled(docs, labels)) > 100 and learn(labelled(docs, labels))
    kept = corpus_pipeline.quality_rules(spark, docs, "/root/testdata/sf0.01").select("doc_id")
    long_clean = docs.join(labels.where("quality = 1"), "doc_id").where("n_chars > 400").select("doc_id")
    lost = long_clean.join(kept, "doc_id", "left_anti").count()
    assert lost <= 0.02 * long_clean.count()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    got = registry.queries()[name](spark, SMALL)
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "conversations", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r)) for r in cur.fetchall()]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: repr([r[c] for c in sorted(names)])
    assert sorted(map(key, want)) == sorted(key(r.asDict()) for r in got.collect())


def test_every_query_is_registered():
    found = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in found if k.startswith("op") and k[2].isdigit()}
    assert "pipeline" in found and len(corpus_pipeline.STAGES) == 5
