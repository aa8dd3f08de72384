import random

import pytest

from rasterflow.llm import components as C
from rasterflow.llm._shared import Scratch


@pytest.mark.parametrize("part", [1 << 20, 40])
def test_components_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(C, "PART", part)
    rnd = random.Random(part)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7), (None, 1)]
    root = {x: x for l in links if None not in l and l[0] != l[1] for x in l}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    scratch = Scratch(spark)
    got = {r["node"]: r["root"] for r in C.components(df, scratch, "t").collect()}
    assert got == {x: find(x) for x in root}
    assert C.components(df.limit(0), scratch, "e").count() == 0
    scratch.drop_all()
