"""N-gram Jaccard join: a blocked sparse product of the document x n-gram incidence.

The product of the incidence matrix with its transpose holds, for every pair of
documents, the count of n-grams they share. It is never formed whole:

* Rows of equal content (same n-gram set) are one class; only a class's smallest
  doc_id takes part, and the class is expanded again at the end.
* Columns are ordered by how often an n-gram occurs (a count sketch of fixed size
  over all documents) and then by hash, the same order for every document. Two sets
  with sizes x, y and Jaccard of at least t share at least
  ceil(t (x + y) / (1 + t)) n-grams, so they meet in one of the first
  x - ceil(t x) + 1 columns of x. Only these leading columns are multiplied, and
  frequent n-grams (shared passages) lie behind them.
* Columns with the same least document form a block. A task multiplies a block and accumulates
  the overlap count of each pair over its columns; the counts of all blocks are added up. A pair
  whose overlap in the leading columns, and all that can follow behind the last of them,
  is less than the bound is discarded there: with few leading columns in common
  no pair passes, however many columns it meets in.
* What is left is verified exactly on the whole texts.

Components need no link inside what is connected already. So in the first rounds a block with more
pairs than in proportion to its documents gives a spanning forest of them, those with most overlap
first; verified links contract its documents, and what is still in different components
takes part again. Large blocks are multiplied in parts, dealt anew each round. When a round contracts
little, all that is open is multiplied in full. Thousands of near copies cost a few forests,
not a square, and no pair of columns, partners or candidates is capped.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import Scratch, documents
from .components import components
from .shingles import mix, shingles

#: Counters of the frequency sketch; fixed, so what is broadcast does not grow.
SKETCH_BITS = 21
#: Groups of columns that a whole set's n-grams are counted in.
GROUPS = 1024
#: Columns that occur more often than this are found by a partial aggregation instead of meeting in one task.
HOT = 1 << 16
#: Documents and entries of a block in one part: of a forest, and of the full product.
PART_DOCS, PART_ENTRIES = {"forest": 512, "full": 2048}, 1 << 20
#: Forest rounds go on while each links so many of the open documents, and a forest takes the place of more pairs than so many a document.
WORTH, DENSE = 0.05, 2
#: Bits of the filter of candidate ids; fixed as well.
BLOOM_BITS = 23

#: All pairs of classes that share a shingle, counted; needs unique doc_ids.
ORACLE_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
  FROM w WHERE len(w) > 0
), sets AS (
  SELECT doc_id, count(*) AS n, sha256(string_agg(g, chr(10) ORDER BY g)) AS s FROM g GROUP BY doc_id
), classes AS (
  SELECT doc_id, n, min(doc_id) OVER (PARTITION BY s) AS rep FROM sets
), r AS (
  SELECT doc_id, n, g FROM g JOIN classes USING (doc_id) WHERE doc_id = rep
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM r x JOIN r y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS node, a AS root FROM both_ways
  UNION
  SELECT b, root FROM reach JOIN both_ways ON node = a
), roots AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, rep, d.doc_id) AS component_id, coalesce(rep, d.doc_id) AS class_id
FROM w d LEFT JOIN classes USING (doc_id) LEFT JOIN roots ON node = rep
"""


def _sketch(texts: DataFrame, n: int) -> np.ndarray:
    """A byte for each of 2^SKETCH_BITS groups of n-grams that grows with their count."""
    size, shift, rows = 1 << SKETCH_BITS, np.uint64(64 - SKETCH_BITS), 32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, wait, held = np.zeros(size, np.int64), [], 0
        for batch in batches:
            for _, g in shingles(batch.column(0), n):
                wait.append(g >> shift)
                held += len(g)
                if held > 1 << 21:
                    total += np.bincount(np.concatenate(wait).astype(np.int64), minlength=size)
                    wait, held = [], 0
        if wait:
            total += np.bincount(np.concatenate(wait).astype(np.int64), minlength=size)
        if total.any():
            part = np.minimum(255, np.ceil(8 * np.log2(1 + total))).astype(np.uint8).reshape(rows, -1)  # no less than the count
            yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), pa.array([x.tobytes() for x in part], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.exp2(np.frombuffer(counts.as_buffer(), np.uint8) / 8) - 1
                total[block] = total[block] + x if block in total else x
        for block, x in total.items():
            level = np.minimum(255, np.ceil(8 * np.log2(1 + x))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["block", "counts"])

    blocks = texts.mapInArrow(count, "block int, counts binary").repartition(rows, "block").mapInArrow(add, "block int, counts binary")
    out = np.zeros(size, np.uint8).reshape(rows, -1)
    for block, level in blocks.collect():  # 32 rows of 64 KB at any size of the input
        out[block] = np.frombuffer(level, np.uint8)
    return out.reshape(-1)


def _profile(docs: DataFrame, n: int, num: int, den: int, levels: np.ndarray) -> DataFrame:
    """(doc_id, n, sig_a, sig_b, prefix, counts): size, 128-bit content hash, leading columns in order, counts by column group."""
    shared, shift = docs.sparkSession.sparkContext.broadcast(levels), np.uint64(64 - SKETCH_BITS)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64()), ("prefix", pa.list_(pa.int64())), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in batches:
            size, a, b, prefix, counts = [], [], [], [], []
            for _, g in shingles(batch.column(1), n):
                s = np.unique(g)
                m = len(s)
                size.append(m)
                a.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                b.append(int(mix(s ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).view(np.int64)))
                c = np.minimum(15, np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)).astype(np.uint8)
                counts.append((c[0::2] | c[1::2] << 4).tobytes())
                # the least overlap of any partner is that of an equal or smaller one: ceil(t m)
                take = m - -(-num * m // den) + 1 if m else 0
                key = (rank[(s >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(55)) | (s >> np.uint64(9))
                key = np.partition(key, take - 1)[:take] if 0 < take < m else key[:take]
                key.sort()
                prefix.append(key.astype(np.int64))
            if size:
                ends = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix) if ends[-1] else np.empty(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists, pa.array(counts, pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n long, sig_a long, sig_b long, prefix array<long>, counts binary")


def _least(x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least overlap of sets of these sizes that link."""
    return -(-num * (x + y) // (num + den))


def _most(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The largest overlap that counts by column group, two in a byte, allow; a full count allows any."""
    out = np.empty(len(x), np.int64)
    for k in range(0, len(x), 4096):
        both = np.minimum(np.stack([x[k : k + 4096] & 15, x[k : k + 4096] >> 4]), np.stack([y[k : k + 4096] & 15, y[k : k + 4096] >> 4]))
        out[k : k + 4096] = np.where((both == 15).any(axis=(0, 2)), np.iinfo(np.int64).max >> 1, both.sum(axis=(0, 2), dtype=np.int64))
    return out


def _product(rows: DataFrame, num: int, den: int, full: bool) -> DataFrame:
    """(a, b, ra, rb, overlap, least, rest, lead, more): pairs in different components by what blocks of columns accumulate.

    With ``counts`` in the rows, pairs whose counts by column group allow less than the bound are discarded first.
    ``rows`` has lead, part (of the block), side (bits: in the left, the right half of the part), whole (the part is
    all of its block), doc_id, n, last (leading column), root and tokens (its columns of this block); rows of a part are
    next to each other. overlap counts the part's columns that both have; rest is what can follow behind the
    leading columns. Unless ``full``, a part with many pairs gives a spanning forest of components; more
    tells that pairs of the block may be missing. A part that gives nothing has none missing or was cut: then a row without a pair says so.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "ra", "rb", "overlap", "least", "rest", "lead")] + [("more", pa.bool_())])

    def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        code, at = np.unique(np.concatenate(codes), return_inverse=True)
        return code, np.bincount(at, weights=np.concatenate(counts), minlength=len(code)).astype(np.int64)

    def forest(i: np.ndarray, j: np.ndarray, root: np.ndarray) -> list[int]:
        """Places of pairs, best first, that connect components not connected yet."""
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        out = []
        for k, (x, y) in enumerate(zip(root[i].tolist(), root[j].tolist(), strict=True)):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append(k)
        return out

    def multiply(table: pa.Table) -> Iterator[pa.RecordBatch]:
        t = {c: table[c].to_numpy() for c in ("lead", "part", "side", "whole", "doc_id", "n", "last", "root")}
        size = len(t["lead"])
        new = np.r_[True, (t["lead"][1:] != t["lead"][:-1]) | (t["part"][1:] != t["part"][:-1])]
        block = np.cumsum(new) - 1
        lists = table["tokens"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        row = np.repeat(np.arange(size), lists.value_lengths().to_numpy())
        token = lists.flatten().to_numpy()
        order = np.lexsort((row, token, block[row]))
        row, token = row[order], token[order]
        first = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (block[row[1:]] != block[row[:-1]])]) if len(row) else np.empty(0, np.int64)
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        codes, counts, held, merged, left = [], [], 0, 0, np.flatnonzero(place)
        for d in range(1, int(place.max(initial=0)) + 1):
            left = left[place[left] >= d]
            i, j = row[left - d], row[left]
            ok = (t["root"][i] != t["root"][j]) & (t["doc_id"][i] != t["doc_id"][j]) & (t["side"][i] | t["side"][j] == 3) & (np.minimum(t["n"][i], t["n"][j]) >= _least(t["n"][i], t["n"][j], num, den))
            codes.append(i[ok] * size + j[ok])
            counts.append(np.ones(len(codes[-1])))
            held += len(codes[-1])
            if held > max(1 << 20, merged):
                code, count = summed(codes, counts)
                codes, counts, held, merged = [code], [count], 0, len(code)
        code, overlap = summed(codes, counts) if codes else (np.empty(0, np.int64), np.empty(0, np.int64))
        i, j = code // size, code % size
        least = _least(t["n"][i], t["n"][j], num, den)
        most = overlap
        if "counts" in table.column_names and len(i):
            width = GROUPS // 2
            held = table["counts"].combine_chunks()
            held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
            held = np.frombuffer(held.buffers()[2], np.uint8)[held.offset * width :][: size * width].reshape(-1, width)
            most = np.concatenate([_most(held[i[k : k + 4096]], held[j[k : k + 4096]]) for k in range(0, len(i), 4096)])
            ok = most >= least
            i, j, overlap, least, most = i[ok], j[ok], overlap[ok], least[ok], most[ok]
        more = (t["whole"] == 0)[np.flatnonzero(new)] & (not full)
        if not full and len(i):
            documents, pairs = np.bincount(block), np.bincount(block[i], minlength=block[-1] + 1)
            dense = pairs > DENSE * documents
            keep = [np.flatnonzero(~dense[block[i]])]
            for k in np.flatnonzero(dense):
                mine = np.flatnonzero(block[i] == k)
                mine = mine[np.argsort(-most[mine] / least[mine], kind="stable")]
                keep.append(mine[forest(i[mine], j[mine], t["root"])])
                more[k] = True
            keep = np.concatenate(keep)
            i, j, overlap, least = i[keep], j[keep], overlap[keep], least[keep]
        ends = np.where(t["last"][i] < t["last"][j], t["n"][i], np.where(t["last"][i] > t["last"][j], t["n"][j], np.minimum(t["n"][i], t["n"][j])))
        less = t["doc_id"][i] < t["doc_id"][j]
        i, j = np.where(less, i, j), np.where(less, j, i)
        columns = [t["doc_id"][i], t["doc_id"][j], t["root"][i], t["root"][j], overlap, least, -(-num * ends // den) - 1, t["lead"][i]]
        out = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(more[block[i]])], schema=schema)
        for k in range(0, out.num_rows, 1 << 16):
            yield out.slice(k, 1 << 16)
        silent = np.setdiff1d(np.flatnonzero(more), block[i])
        if len(silent):
            leads = t["lead"][np.flatnonzero(new)[silent]]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(leads), pa.int64())] * 7 + [pa.array(leads), pa.array(np.ones(len(leads), bool))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            lead, part = (held[c].to_numpy() for c in ("lead", "part"))
            # the last part may go on in the next batch
            other = np.flatnonzero((lead != lead[-1]) | (part != part[-1]))
            if len(other):
                yield from multiply(held.slice(0, int(other[-1]) + 1))
                held = held.slice(int(other[-1]) + 1)
        if held is not None:
            yield from multiply(held)

    return rows.mapInArrow(run, "a long, b long, ra long, rb long, overlap long, least long, rest long, lead long, more boolean")


def _dealt(rows: DataFrame, full: bool, turn: int) -> DataFrame:
    """rows with part, side and whole, the rows of a part in one task; without blocks of one component.

    A block of many documents or entries is cut in parts by a hash of the document that differs each turn. For
    the full product every two parts, and each alone, are a part of it.
    """
    entries = F.size("tokens")
    sizes = rows.groupBy("lead").agg(F.count("*").alias("k"), F.sum(entries).alias("entries"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    parts = F.ceil(F.greatest(F.col("k") / PART_DOCS["full" if full else "forest"], F.col("entries") / PART_ENTRIES)).cast("int")
    rows = rows.join(sizes.select("lead", parts.alias("parts")), "lead")
    mine = F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.col("parts")).cast("int")
    columns = [c for c in rows.columns if c not in ("parts", "part", "side", "whole")]
    if full:
        n = F.col("parts")
        each = F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.struct((F.least(p, mine).cast("long") * n + F.greatest(p, mine)).alias("part"), F.when(p == mine, 3).when(mine < p, 1).otherwise(2).cast("long").alias("side")))
        rows = rows.select(*columns, F.lit(1).cast("long").alias("whole"), F.explode(each).alias("e")).select(*columns, "whole", "e.part", "e.side")
    else:
        rows = rows.select(*columns, (F.col("parts") == 1).cast("long").alias("whole"), mine.cast("long").alias("part"), F.lit(3).cast("long").alias("side"))
    return rows.repartition("lead", "part").sortWithinPartitions("lead", "part")


def _blocks(columns: DataFrame) -> DataFrame:
    """(lead, doc_id, n, last, tokens): columns (doc_id, n, last, token, hot) of two documents or more, by their least document."""
    token = W.partitionBy("token")
    few = columns.where("not hot").withColumns({"lead": F.min("doc_id").over(token), "k": F.count("*").over(token)}).where("k > 1").drop("k", "hot")
    leads = columns.where("hot").groupBy("token").agg(F.min("doc_id").alias("lead"), F.count("*").alias("k")).where("k > 1").drop("k")
    many = columns.where("hot").drop("hot").join(leads, "token")
    return few.unionByName(many).groupBy("lead", "doc_id", "n", "last").agg(F.collect_list("token").alias("tokens"))


def _only(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """docs without most rows whose id is not in ids, before any shuffle; false positives stay.

    A Bloom filter of fixed size is built on the executors; when ids outgrow it, it lets
    more rows through, and the join after it stays exact.
    """
    size = 1 << BLOOM_BITS

    def places(x: np.ndarray) -> list[np.ndarray]:
        h = mix(x.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        return [((h >> np.uint64(20 * k)) & np.uint64(size - 1)).astype(np.int64) for k in range(3)]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, any_ = np.zeros(size, bool), False
        for batch in batches:
            any_ |= batch.num_rows > 0
            for p in places(batch.column(0).to_numpy(zero_copy_only=False)):
                bits[p] = True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for x in batch.column(0):
                bits |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            ok = np.ones(batch.num_rows, bool)
            for p in places(batch.column(0).to_numpy(zero_copy_only=False)):
                ok &= bits[p]
            if ok.any():
                yield batch.filter(pa.array(ok))

    rows = ids.mapInArrow(build, "bits binary").repartition(4).mapInArrow(either, "bits binary").collect()  # four rows of 1 MB
    merged = np.zeros(size // 8, np.uint8)
    for (x,) in rows:
        merged |= np.frombuffer(x, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(merged)
    return docs.mapInArrow(test, docs.schema)


def _verified(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """(a, b) of the components ra and rb of pairs (a, b, ra, rb) whose n-gram sets have a Jaccard of at least
    num / den, from the whole texts; one row for two components, however many links there are between them."""
    pairs = scratch.cut(pairs, f"{name}-pairs")
    ids = pairs.select(F.col("a").alias("id")).distinct().union(pairs.select(F.col("b").alias("id")).distinct()).distinct()
    ids = scratch.cut(ids, f"{name}-ids")
    if ids.isEmpty():
        return pairs.select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    texts = scratch.cut(_only(docs, ids), f"{name}-texts")  # the joins drop what else came through

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by a, so its set is made once for all its partners in a batch
        for batch in batches:
            a = batch.column(0).to_numpy()
            one = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
            which = np.cumsum(np.r_[0, (a[1:] != a[:-1]).astype(np.int64)]) if len(a) else one
            left = [np.unique(g) for _, g in shingles(batch.column(3).take(pa.array(one)), n)]
            ok = []
            for row, g in shingles(batch.column(4), n):
                x, y = left[which[row]], np.unique(g)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select([1, 2]).filter(pa.array(ok, pa.bool_()))

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "ra", "rb", "text_a", "text_b")
    found = both.sortWithinPartitions("a").mapInArrow(run, "ra long, rb long")
    out = scratch.cut(found.distinct().select(F.col("ra").alias("a"), F.col("rb").alias("b")), f"{name}-links")
    scratch.drop(f"{name}-texts", f"{name}-ids", f"{name}-pairs")
    return out


def _prepared(docs: DataFrame, n: int, num: int, den: int, scratch: Scratch) -> tuple[DataFrame, ...]:
    """(docs, profile, sizes, classes, blocks): texts, what was counted of them, classes of equal sets, blocks of columns."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    levels = _sketch(docs.select("text"), n)
    profile = scratch.cut(_profile(docs, n, num, den, levels), "profile")
    sizes = profile.select("doc_id", "n", "sig_a", "sig_b")
    classes = scratch.cut(sizes.where("n > 0").groupBy("n", "sig_a", "sig_b").agg(F.min("doc_id").alias("rep")), "classes")
    # what is not its class's smallest stays out; few are, so these are what is joined
    copies = scratch.cut(sizes.join(classes, ["n", "sig_a", "sig_b"]).where("doc_id <> rep").select("doc_id"), "copies")
    columns = profile.where("n > 0").join(copies, "doc_id", "left_anti").select("doc_id", "n", F.element_at("prefix", -1).alias("last"), F.explode("prefix").alias("token"))
    hot = F.shiftright("token", 55) >= int(8 * np.log2(HOT))  # the level of its group of n-grams
    blocks = scratch.cut(_blocks(columns.withColumn("hot", hot)), "blocks")
    return docs, profile, sizes, classes, blocks


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) for every row with a doc_id.

    ``docs`` needs doc_id (unique) and text; other columns are ignored, whatever their
    names. Sets are the distinct n-word shingles of the text lower-cased in A-Z; a
    shorter text is one shingle; a null, empty or blank text has none and stays
    alone. Documents link when den * intersection >= num * union. component_id is the
    least doc_id reachable by links, class_id that of the documents with the same set.
    A row repeated under one doc_id counts once; different texts under one doc_id are one
    document whose links are those of either, with the larger size. Rows with a null doc_id have no
    identity and are left out. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs, profile, sizes, classes, blocks = _prepared(docs, n, num, den, scratch)
    comps = scratch.cut(spark.createDataFrame([], "node long, root long"), "cc-none")
    turn, full, open_ = 0, False, None
    while True:
        here = blocks if open_ is None else blocks.join(open_, "doc_id", "left_semi")
        here = here.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        if turn:  # a doc_id with several texts has the counts of each, so none is held against it
            here = here.join(profile.join(open_, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("counts").alias("counts"), F.count("*").alias("rows")).withColumn("counts", F.when(F.col("rows") == 1, F.col("counts")).otherwise(F.lit(bytes([255] * (GROUPS // 2))))).drop("rows"), "doc_id")
        pairs = scratch.cut(_product(_dealt(here, full, turn), num, den, full), "pairs")
        # the counts of all blocks, and what can come behind the leading columns
        over = pairs.where("a is not null").groupBy("a", "b", "least", "rest").agg(F.sum("overlap").alias("overlap"), F.first("ra").alias("ra"), F.first("rb").alias("rb"))
        found = _verified(over.where("overlap + rest >= least").select("a", "b", "ra", "rb"), docs, n, num, den, scratch, f"turn{turn}")
        links = found.unionByName(comps.select(F.col("node").alias("a"), F.col("root").alias("b")))
        old, comps = comps, scratch.cut(components(links, scratch, f"star{turn}"), f"cc{turn}")
        if full:
            break
        again = scratch.cut(here.select("lead", "doc_id").join(pairs.where("more").select("lead").distinct(), "lead", "left_semi").select("doc_id").distinct(), f"open{turn}")
        scratch.drop("pairs", f"turn{turn}-links", f"open{turn - 1}")
        left = again.count()
        if not left:
            break
        if not turn:  # later rounds need no other texts
            docs = scratch.cut(_only(docs, again).join(again, "doc_id", "left_semi"), "open-texts")
        gone = comps.where("node <> root").count() - old.where("node <> root").count()
        turn, full, open_ = turn + 1, gone < WORTH * left, again
    roots = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("n", "sig_a", "sig_b", "rep", F.coalesce("root", "rep").alias("root"))
    roots = scratch.cut(roots, "roots")
    out = sizes.join(roots, ["n", "sig_a", "sig_b"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id"))
    out = out.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"), F.min("class_id").alias("class_id"))
    out = scratch.cut(out, "result")
    scratch.paths.pop("result")
    scratch.drop_all()
    return out


def jaccard_links(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """All links: (a, b) with a < b of class representatives, and (doc_id, class_id, n_links) of every document.

    ``docs`` is as for jaccard_components. Documents of one set are a class, represented by its least
    doc_id; n_links counts the documents that link with this one, those of its own class and of linked classes. Here
    nothing is contracted, so pairs grow with the links that there are.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs, profile, sizes, classes, blocks = _prepared(docs, n, num, den, scratch)
    here = blocks.withColumn("root", F.col("doc_id"))
    pairs = scratch.cut(_product(_dealt(here, True, 0), num, den, True), "pairs")
    over = pairs.groupBy("a", "b", "least", "rest").agg(F.sum("overlap").alias("overlap")).where("overlap + rest >= least")
    links = _verified(over.select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb")), docs, n, num, den, scratch, "all")
    members = sizes.where("n > 0").join(classes, ["n", "sig_a", "sig_b"]).select("doc_id", F.col("rep").alias("class_id")).distinct()
    members = scratch.cut(members, "members")
    size = members.groupBy("class_id").agg(F.count("*").alias("size"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = both.join(size, F.col("b") == F.col("class_id")).groupBy(F.col("a").alias("of")).agg(F.sum("size").alias("more"))
    counts = size.join(more, F.col("class_id") == F.col("of"), "left").select("class_id", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    counts = members.join(counts, "class_id").select("doc_id", "class_id", "n_links")
    alone = sizes.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    out = scratch.cut(counts.unionByName(alone).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links")), "counts")
    for kept in ("counts", "all-links"):
        scratch.paths.pop(kept, None)
    scratch.drop_all()
    return links, out


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of whole documents by 4-word shingles at a Jaccard of 0.85 or more."""
    return jaccard_components(documents(spark, sf_dir), n=4, num=85, den=100)
