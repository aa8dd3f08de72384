"""Compression of vectors to codes: product codebooks, assigned by an Exponion search in exact integers.

A part of a vector starts at the entry that it had before (entry 0 at first), at squared distance u. An entry that is at
least as near lies, by the triangle inequality, within 2 * sqrt(u) of that entry; so only the leading stretch of that
entry's list of neighbours, sorted by distance, with squared distance at most 4 u, is scanned. Distances are integers, ties go
to the lower index.

A round is one pass that writes each vector with its new codes and one pass that sums parts by entry: a row of sums
for each entry and task, then sums of those. Codebooks are parts x entries x components, a fixed size, and are all that the driver holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch
from .vectors import exact, held, matrix, padded, whole_numbers

#: Integers up to this have squared distances of parts within 64 bits (parts of up to 4 components a part and more).
WITHIN = 2.0**28


def _step(n: int, source: str, books: str) -> str:
    """One assignment: the nearest entry of each part, as least (distance, index)."""
    return f"""
a{n} AS (SELECT s.vec_id, s.p, min(struct_pack(d := list_sum(list_transform(list_zip(s.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := b.e)) AS best
  FROM {source} s JOIN {books} b ON s.p = b.p GROUP BY s.vec_id, s.p)"""


def _update(n: int) -> str:
    """Entries replaced by the floor of their parts' means; unused entries stay."""
    return f"""
m{n} AS (SELECT p, e, list(c ORDER BY j) AS v FROM (SELECT s.p, a.best.e AS e, u.j, floor(sum(s.v[u.j])::DOUBLE / count(*))::BIGINT AS c
  FROM s JOIN a{n} a USING (vec_id, p), generate_series(1, len(s.v)) AS u(j) GROUP BY ALL) GROUP BY p, e),
b{n} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{n - 1} b LEFT JOIN m{n} m USING (p, e))"""


ORACLE_SQL = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT vec_id, p, x[p * len(x) // 16 + 1 : (p + 1) * len(x) // 16] AS v FROM k, generate_series(0, 15) AS g(p)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < 64),
b0 AS (SELECT s.p, f.e, s.v FROM s JOIN f USING (vec_id)),
{_step(1, "s", "b0")}, {_update(1)}, {_step(2, "s", "b1")}, {_update(2)}, {_step(3, "s", "b2")},
c AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a3 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(list_aggregate(v, 'string_agg', ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), h
"""


class Codebooks:
    """Entries of every part: an array of parts x entries x components, with each entry's neighbours by distance."""

    def __init__(self, entries: np.ndarray):
        within = max((abs(int(v)) for v in (entries.min(), entries.max())), default=0) <= WITHIN
        self.entries = entries
        gaps = exact(entries, within)
        gaps = ((gaps[:, :, None, :] - gaps[:, None, :, :]) ** 2).sum(axis=3)
        # a stable sort leaves equal distances in order of index
        self.near = np.stack([np.stack([np.argsort(row, kind="stable") for row in part]) for part in gaps])
        self.gaps = np.take_along_axis(gaps, self.near, axis=2)

    def assign(self, x: np.ndarray, start: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
        """(entry of each part, exact squared distance of each part) for rows of vectors; start: the entries that they had."""
        parts, _, width = self.entries.shape
        codes, far = np.empty_like(start), np.empty(start.shape, np.int64 if within else object)
        for p in range(parts):
            codes[:, p], far[:, p] = self._part(exact(x[:, p * width : (p + 1) * width], within), start[:, p], p, exact(self.entries[p], within))
        return codes, far

    def _part(self, x: np.ndarray, start: np.ndarray, p: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, least = start.astype(np.int64), ((x - entries[start]) ** 2).sum(axis=1)
        by_start = np.argsort(start, kind="stable")
        edges = np.searchsorted(start[by_start], np.arange(len(entries) + 1))
        scan = np.zeros(len(x), np.int64)
        for e in np.flatnonzero(np.diff(edges)):
            own = by_start[edges[e] : edges[e + 1]]
            scan[own] = np.searchsorted(self.gaps[p, e], 4 * least[own], side="right")
        order = np.argsort(-scan, kind="stable")
        widths = np.searchsorted(-scan[order], -np.arange(scan.max(initial=0)), side="left")
        for j, n in enumerate(widths):  # the n rows whose stretch is longer than j
            rows = order[:n]
            e = self.near[p, start[rows], j]
            d = ((x[rows] - entries[e]) ** 2).sum(axis=1)
            nearer = (d < least[rows]) | ((d == least[rows]) & (e < best[rows]))
            best[rows[nearer]], least[rows[nearer]] = e[nearer], d[nearer]
        return best, least

    def moved(self, sums: list) -> Codebooks:
        """With each entry that got parts at the floor of their mean; sums: (part, entry, count, sum of each component)."""
        entries = self.entries.copy()
        for p, e, n, *totals in sums:
            entries[p, e] = [int(t) // n for t in totals]
        return Codebooks(entries)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error, label_error) of every vector that takes part, and the final codebooks.

    ``vectors`` needs vec_id, embedding and label; other columns are ignored, whatever their names. Components become
    floor(scale * x); vectors that are null or hold null or components that aren't finite are left out. Codebooks start as
    the parts of the vectors with the ``size`` (at most 256) smallest vec_ids, of equal ids those with smaller vectors; with fewer
    vectors there are fewer entries. A null vec_id stands behind all others. Rows repeated under one vec_id count each time. Shorter
    vectors get zeros behind them, up to the longest one's length and on to a multiple of ``parts``. label_error sums
    error over rows of one label, null labels together. Errors beyond 64 bits are returned at its end. An empty table gives an empty
    result and no codebooks.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select("vec_id", "label", whole_numbers(F.col("embedding"), scale).alias("x")).where("x IS NOT NULL")
    rows = scratch.cut(rows, "vectors")
    about = rows.agg(F.max(F.size("x")).alias("dims"), F.max(F.greatest(F.abs(F.array_max("x").cast("double")), F.abs(F.array_min("x").cast("double")))).alias("largest")).first()
    kept = rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    if about["dims"] is None:
        scratch.drop_all()
        return spark.createDataFrame([], f"vec_id {kept[0]}, label {kept[1]}, code string, error long, label_error long"), None
    width = max(1, -(-about["dims"] // parts))
    dims, within = parts * width, (about["largest"] or 0.0) <= WITHIN and width < 64
    rows = padded(rows, dims)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(size).select("x").toArrow()
    books = Codebooks(matrix(first.column("x"), dims).reshape(-1, parts, width).transpose(1, 0, 2))

    def codes_of(batch) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)

    def assign(books):
        def each(batches):
            for b in batches:
                codes, far = books.assign(matrix(b.column("x"), dims), codes_of(b), within)
                error = held(far.sum(axis=1) if within else np.array([sum(map(int, row)) for row in far], object))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("x"), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(error)], ["vec_id", "label", "x", "code", "error"])

        return each

    def sums(batches):
        count, total = np.zeros((parts, books_size), np.int64), np.zeros((parts, books_size, width), np.int64 if within else object)
        for b in batches:
            x, codes = matrix(b.column("x"), dims), codes_of(b)
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=books_size)
                np.add.at(total[p], codes[:, p], exact(x[:, p * width : (p + 1) * width], within))
        p, e = np.nonzero(count)
        columns = [pa.array([str(v) for v in total[p, e, j]]) for j in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), *columns], ["p", "e", "n", *names])

    books_size, names = books.entries.shape[1], [f"s{j}" for j in range(width)]
    schema = f"vec_id {kept[0]}, label {kept[1]}, x array<long>, code binary, error long"
    rows = rows.select("vec_id", "label", "x", F.lit(bytes(parts)).alias("code"))
    for i in range(rounds):
        rows = scratch.cut(rows.mapInArrow(assign(books), schema), f"assigned{i}")
        scratch.drop("vectors" if i == 0 else f"assigned{i - 1}")
        by_entry = rows.mapInArrow(sums, "p long, e long, n long, " + ", ".join(f"{c} string" for c in names)).groupBy("p", "e")
        books = books.moved(by_entry.agg(F.sum("n"), *[F.sum(F.col(c).cast("decimal(38,0)")) for c in names]).collect())  # parts x size rows at most
    coded = rows.mapInArrow(assign(books), schema).select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error")
    coded = scratch.cut(coded, "coded")
    scratch.drop("vectors", *[f"assigned{i}" for i in range(rounds)])
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    by_label = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error")).withColumnRenamed("label", "its")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("its"))).drop("its"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings in 16 parts of 64 entries after 2 rounds, with errors and a digest of the codebooks."""
    coded, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))
