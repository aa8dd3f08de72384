import random

from pyspark.sql import functions as F

from rasterflow.operators import history, trigrams


def table(spark, rnd, n, start=0):
    parts = ["Click", "view", "_", "7", "É", "ß", "说明", "𝄞", " ", ".bmp", "/in/", "İ", "%"]
    text = lambda: rnd.choice([None, "", "".join(rnd.choice(parts) for _ in range(rnd.randrange(9)))])
    return spark.createDataFrame([(start + i, text(), text(), text()) for i in range(n)], "seq long, input string, output string, message string")


def test_index_equals_the_scan(spark, tmp_path):
    rnd = random.Random(2)
    rows = table(spark, rnd, 400)
    at = str(tmp_path / "index")
    trigrams.build(rows, at, 3)
    texts = [r[0] for r in rows.select(history.searched()).collect()]
    words = ["", " ", "ab", "说明", "k_", "Click", " CLICK ", "nothing like it", "𝄞𝄞𝄞", "ß", "%.b", "i̇"]
    for _ in range(40):
        t = rnd.choice([t for t in texts if t.strip()])
        i = rnd.randrange(len(t))
        words.append(rnd.choice([str.upper, str])(t[i : i + rnd.randrange(1, 9)]))
    for word in words:
        got = [r["seq"] for r in trigrams.search(rows, at, word).collect()]
        assert got == [r["seq"] for r in history.search(rows, word).collect()], word


def test_appended_rows_are_found_and_only_own_grams_read(spark, tmp_path):
    rnd = random.Random(3)
    old, new = table(spark, rnd, 200), table(spark, rnd, 50, 200)
    at = str(tmp_path / "index")
    trigrams.build(old, at, 4)
    trigrams.build(new, at, 1, mode="append")
    both = old.unionByName(new)
    assert [r["seq"] for r in trigrams.search(both, at, "view").collect()] == [r["seq"] for r in history.search(both, "view").collect()]
    index = spark.read.schema("gram string, key long").parquet(at)
    plan = trigrams.candidates(index, ["vie", "iew"])._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [iew,vie])" in plan or "In(gram, [vie,iew])" in plan
    assert index.groupBy("gram", "key").count().where(F.col("count") > 1).count() == 0
    assert trigrams.postings(old.limit(0)).count() == 0 and trigrams.keyword_grams(spark, " ab ") == []


def test_parts_grow_with_the_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "PART", 500)
    rows = table(spark, random.Random(4), 300)
    at = str(tmp_path / "index")
    trigrams.build(rows, at, 2)
    index = spark.read.parquet(at)
    each = [r["count"] for r in index.select(F.input_file_name().alias("file")).groupBy("file").count().collect()]
    assert len(each) > 4 and max(each) < 1000 and sum(each) == trigrams.postings(rows).count()
    trigrams.build(rows.limit(0), at, 2)
    assert spark.read.schema("gram string, key long").parquet(at).count() == 0
