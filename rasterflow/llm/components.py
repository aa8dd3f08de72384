"""Connected components of a link table, by alternating large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch


#: Links in a part whose spanning forest one task makes.
PART = 1 << 20


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) with v the least node that u reaches by the links of this part, u > v."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = x = root.get(y, y)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    rows = [(x, find(x)) for x in list(root)]
    for k in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + 10_000], strict=True)], ["u", "v"])


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v) with u > v; rows stay (u, v), u > v, distinct."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    out = both.join(low, "u")
    if large:
        new = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = out.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.where("u > m").select("u", F.col("m").alias("v"))
    return new.unionByName(own).where("u > v").distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b); root is the least node reachable.

    Redundant links go first: parts of bounded size are each replaced by stars over what
    they connect. Each round is written to the shared folder, so that a lost executor costs
    one round and no lineage grows. Rounds end when all edges form stars, which takes
    in the order of log(n) of them. Nodes without links are absent; null ends
    and loops are ignored; repeated links count once; no link gives no row.
    """
    pairs = links.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    parts = max(1, -(-pairs.count() // PART))
    edges = pairs.coalesce(parts).mapInArrow(_forest, "u long, v long")
    for k in range(60):
        edges = scratch.cut(_stars(_stars(edges, True), False) if k else edges, f"{name}-{k}")
        if k:
            scratch.drop(f"{name}-{k - 1}")
        # done when every node has one edge down or is the end of some, never both
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        ends = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        if ends.where("down > 1 or down = 1 and up = 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
