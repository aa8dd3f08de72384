"""Best-fit packing with lower-bound certificates.

Documents are tokenised once; what leaves that scan is a row of numbers for each piece.
Full pieces are sequences of their own. The others go to partitions of bounded size by a
hash of the row, and each is packed by best-fit decreasing. A lower bound from dual
feasible functions certifies the partition's count of sequences. Partitions with a gap release all their
sequences but the full ones, the others their sparse ones; what is released meets in one exchange and is packed by
best-fit decreasing again. If a gap to the bound of all documents stays, all of them meet once
more. A result is kept only where it saves sequences.

Best-fit decreasing needs no more than how many documents there are of each length, fewer than ``most`` numbers. So an
exchange collects these counts alone and packs them as patterns with multiplicities; documents find their
places in the patterns by their ranks among those of their length, in parts of bounded size.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Scratch, documents
from .shingles import word_hashes, words

#: Documents of a partition in the first round, documents ranked together, and words remembered by a tokenising worker.
GROUP, RANKED, WORDS = 8192, 1 << 16, 1 << 21


class _Tokens:
    """Ids of words; this vocabulary's pre-tokens never cross white space, nor a stop behind a letter.

    Case does not matter to it, but in its special tokens. A word is encoded when first seen
    and looked up by its 64-bit hash from then on.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def __call__(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, count of ids of each word)."""
        if not len(starts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        keys, first, which = np.unique(word_hashes(b, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == keys[known]
        if not known.all():
            if len(self.keys) > WORDS:
                self.clear()
                known[:] = False
            new = np.flatnonzero(~known)
            raw, parts, size = b.tobytes(), [self.flat], np.zeros(len(new), np.int64)
            for k in range(0, len(new), 4096):
                some = [raw[s:e].decode() for s, e in zip(starts[first[new[k : k + 4096]]].tolist(), ends[first[new[k : k + 4096]]].tolist(), strict=True)]
                done = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
                parts.append(np.array(done.ids, np.uint32))
                size[k : k + 4096] = np.bincount(np.array(done.word_ids, np.int64), minlength=len(some))
            at = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate(parts)
            keys_, at_, size_ = np.concatenate([self.keys, keys[new]]), np.concatenate([self.at, at]), np.concatenate([self.size, size])
            order = np.argsort(keys_, kind="stable")
            self.keys, self.at, self.size = keys_[order], at_[order], size_[order]
            place = np.searchsorted(self.keys, keys)
        n, at = self.size[place][which], self.at[place][which]
        total = np.cumsum(n)
        return self.flat[np.repeat(at - (total - n), n) + np.arange(total[-1])], n


_LOADED: dict[str, _Tokens] = {}


def pieces(docs: DataFrame, path: str, end_id: int = 1, most: int = 4096, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row of ``docs`` (doc_id, text).

    Ids are those of the whole text without special tokens, then ``end_id``, cut at every
    ``most``. A null text counts as empty and gives one piece of one id.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _LOADED.get(path) or _LOADED.setdefault(path, _Tokens(path))
        for batch in batches:
            doc_ids = batch.column(0)
            for first, b, starts, ends, at in words(batch.column(1), lower=b"<|", marks=True):
                flat, n = tokens(b, starts, ends)
                upto = np.concatenate([[0], np.cumsum(n)])
                out: list[tuple] = []
                for row in range(len(at) - 1):
                    ids = np.append(flat[upto[at[row]] : upto[at[row + 1]]], np.uint32(end_id)).astype("<u4")
                    for k, s in enumerate(range(0, len(ids), most)):
                        part = ids[s : s + most]
                        out.append((doc_ids[first + row].as_py(), k, s, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    names = {"int64": "long", "int32": "int", "list<item: int32>": "array<int>"}
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, ", ".join(f"{n} {names[str(t)]}" for n, t in fields))


def lower_bound(sizes: np.ndarray, most: int, counts: np.ndarray | None = None) -> int:
    """The best bound on the count of sequences from three families of dual feasible functions; counts of sizes if they are distinct."""
    if not len(sizes):
        return 0
    values, counts = np.unique(sizes, return_counts=True) if counts is None else (sizes, counts)
    best = -(-int((values * counts).sum()) // most)
    # sizes over most - k fill a sequence, those under k count nothing, the others as they are
    for k in np.unique(np.minimum(values, most - values)):
        if 0 < k <= most // 2:
            x = np.where(values > most - k, most, np.where(values < k, 0, values))
            best = max(best, -(-int((x * counts).sum()) // most))
    # rounding to multiples of 1 / (k + 1), and the count of sizes over half with what fits beside them
    for k in range(1, 101):
        scaled = (k + 1) * values
        x = np.where(scaled % most == 0, k * values, (scaled // most) * most)
        best = max(best, -(-int((x * counts).sum()) // (k * most)))
    for k in np.unique(values[values <= most // 2]):
        c = most // k
        x = np.where(2 * values > most, 2 * (c - (most - values) // k), np.where(2 * values == most, c, 2 * (values // k)))
        best = max(best, -(-int((x * counts).sum()) // (2 * c)))
    return best


def best_fit(sizes: np.ndarray, most: int) -> np.ndarray:
    """The sequence of each size by best-fit decreasing; open ones are found by their room."""
    out = np.empty(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(most + 1)]
    mask, n = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask &= ~(1 << left)
        else:
            left, b, n = most, n, n + 1
        out[i] = b
        if left := left - size:
            room[left].append(b)
            mask |= 1 << left
    return out


def best_fit_counts(counts: dict[int, int], most: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Best-fit decreasing over counts of sizes: (how many sequences, [(size, copies, offset)]) of each pattern.

    Documents of one size fill the tightest sequences one after the other, each as far as it goes, so sequences that look
    alike are handled at once; a size splits at most two patterns.
    """
    open_: dict[int, list[tuple[int, list]]] = {}
    rooms, done = 0, []

    def put(room: int, n: int, items: list) -> None:
        nonlocal rooms
        if not n:
            return
        if room:
            open_.setdefault(room, []).append((n, items))
            rooms |= 1 << room
        else:
            done.append((n, items))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            fits = rooms >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                there, items = open_[room].pop()
                if not open_[room]:
                    rooms &= ~(1 << room)
            else:
                room, there, items = most, left, []
            each = room // size
            used = min(there, left // each)
            put(room - each * size, used, [*items, (size, each, most - room)])
            left -= used * each
            there -= used
            if there and left and left < each:
                put(room - left * size, 1, [*items, (size, left, most - room)])
                left, there = 0, there - 1
            if items:
                put(room, there, items)
    return done + [p for patterns in open_.values() for p in patterns]


def _placed(rows: DataFrame, counts: dict[int, int], patterns: list[tuple[int, list[tuple[int, int, int]]]], turn: int) -> DataFrame:
    """(_row, length, sequence_id, offset, loose): rows (_row, length) at their places in the patterns, by rank within their length."""
    segments: dict[int, list[tuple[int, int, int, int]]] = {}
    upto, sequence = dict.fromkeys(counts, 0), 0
    for n, items in patterns:
        for size, copies, offset in items:
            segments.setdefault(size, []).append((upto[size], sequence, copies, offset))
            upto[size] += n * copies
        sequence += n
    tables = {size: np.array(x, np.int64).T for size, x in segments.items()}
    salts = max(1, -(-sum(counts.values()) // RANKED))
    salted = rows.select("_row", "length", F.pmod(F.xxhash64("_row"), F.lit(salts)).alias("s"))
    within = F.row_number().over(Window.partitionBy("length", "s").orderBy("_row")) - 1
    before = salted.groupBy("length", "s").agg(F.count("*").alias("n"))
    before = before.select("length", "s", (F.sum("n").over(Window.partitionBy("length").orderBy("s")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("within", within).join(before, ["length", "s"]).select("_row", "length", (F.col("within") + F.col("before")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            ids, offsets = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for x in np.unique(size):
                at = np.flatnonzero(size == x)
                first, base, copies, offset = tables[int(x)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                ahead = rank[at] - first[k]
                ids[at], offsets[at] = base[k] + ahead // copies[k], offset[k] + ahead % copies[k] * x
            columns = [batch.column(0), batch.column(1), (np.int64(turn) << np.int64(56)) + ids, offsets, np.ones(len(size), bool)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["_row", "length", "sequence_id", "offset", "loose"])

    return ranked.mapInArrow(run, "_row long, length long, sequence_id long, offset long, loose boolean")


def _counts(rows: DataFrame) -> dict[int, int]:
    """How many rows there are of each length: as many numbers as there are lengths."""
    return {int(r["length"]): int(r["n"]) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}


def _bound(counts: dict[int, int], most: int) -> int:
    values = np.array(sorted(counts), np.int64)
    return lower_bound(values, most, np.array([counts[v] for v in values.tolist()], np.int64)) if counts else 0


def pack(rows: DataFrame, most: int = 4096, group: int = GROUP) -> DataFrame:
    """``rows`` (any columns, one of them length of 1 to ``most``) with sequence_id and offset.

    Rows of a sequence lie gapless from 0. Ties and repeated rows are packed each, rows of any width; columns of
    ``rows`` named sequence_id or offset are replaced, all others stay as they are. An empty table gives none.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    named = [c for c in rows.columns if c.lower() not in ("sequence_id", "offset")]
    # the columns travel as one struct, so that no name of theirs meets one of this function's
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in named]).alias("its"), F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("_row"))
    rows = scratch.cut(rows, "pieces")
    result = lambda df: df.select("its.*", "sequence_id", "offset")
    full = rows.where(F.col("length") == most).select("its", (-F.col("_row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_ = rows.where(F.col("length") < most).select("_row", "length")
    counts = _counts(open_)
    if not counts:
        return result(full)
    groups = max(1, -(-sum(counts.values()) // group))
    dealt = open_.withColumn("g", F.pmod(F.xxhash64("_row"), F.lit(groups)))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        size = table["length"].to_numpy()
        bins = best_fit(size, most)
        count, bound = int(bins.max()) + 1, lower_bound(size, most)
        fill = np.bincount(bins, weights=size, minlength=count).astype(np.int64)
        loose = fill < (most if count > bound else most * 49 // 50)
        order = np.argsort(bins, kind="stable")
        upto = np.cumsum(size[order]) - size[order]
        offset = np.empty(len(size), np.int64)
        offset[order] = upto - (np.cumsum(fill) - fill)[bins[order]]
        ids = (np.int64(key[0].as_py()) << np.int64(24)) + bins
        return pa.table({"_row": table["_row"], "length": table["length"], "sequence_id": ids, "offset": offset, "loose": loose[bins]})

    places = dealt.groupBy("g").applyInArrow(run, "_row long, length long, sequence_id long, offset long, loose boolean")
    places = scratch.cut(places, "round0")
    bound = _bound(counts, most)
    n = places.select("sequence_id").distinct().count()
    for turn, released in ((1, F.col("loose")), (2, F.lit(True))):
        if n <= bound:
            break
        pool = places.where(released).select("_row", "length", "sequence_id")
        sizes, had = _counts(pool), pool.select("sequence_id").distinct().count()
        if not sizes:
            continue
        patterns = best_fit_counts(sizes, most)
        saved = had - sum(k for k, _ in patterns)
        if saved <= 0:
            continue
        places = scratch.cut(places.where(~released).unionByName(_placed(pool, sizes, patterns, turn)), f"round{turn}")
        scratch.drop(f"round{turn - 1}")
        n -= saved
    packed = rows.join(places.select("_row", "sequence_id", "offset"), "_row").select("its", "sequence_id", "offset")
    return result(full.unionByName(packed))


def certificate(packed: DataFrame, most: int = 4096) -> tuple[int, int]:
    """(sequences, the least that any packing needs) of packed rows, over all of them.

    Dual feasible functions need the counts of lengths alone: at most ``most`` rows come to the driver. Equal numbers
    certify that no packing is better; an empty table gives zeros.
    """
    lengths = sorted((r["length"], r["n"]) for r in packed.groupBy("length").agg(F.count("*").alias("n")).collect())
    values, counts = (np.array(x, np.int64) for x in (zip(*lengths, strict=True) if lengths else ((), ())))
    return packed.select("sequence_id").distinct().count(), lower_bound(values, most, counts)


def pack_documents(docs: DataFrame, path: str | None = None, most: int = 4096) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text) in as few sequences as can be; path is the tokenizer's file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return pack(pieces(docs, path, most=most), most)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids."""
    return pack_documents(documents(spark, sf_dir))
