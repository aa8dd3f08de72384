"""Quality rules as a learned decision list, in DataFrame functions alone.

``statistics`` turns a whole text into counts with built-in functions. ``learn`` reads the
statistics of a bounded sample of labelled rows and builds an ordered list of threshold
conjunctions by sequential covering: a rule grows by the condition with the best
information gain on two thirds of the rows still uncovered, is pruned on the other
third, and joins the list when it is precise enough there. ``verdict`` emits the list
as one ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import WORD, documents

#: Windows of so many words count as repeats when found twice in a text.
WINDOW = 8
#: Documented bound of the labelled sample: the rows with the least hash of their id.
SAMPLE = 6000
#: Thresholds tried for a statistic, and the precision that a rule needs on the pruning rows.
QUANTILES, PRECISION, RULES, CONDITIONS = 24, 0.95, 12, 3

#: The statistics that rules may test, as ratios of the counts. None changes with a text's length alone (as the share of
#: distinct words does): a threshold learned on short texts would drop long ones.
RATIOS = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "stutter": "n_adjacent / greatest(n_words, 1)",
}


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(h: Column) -> Column:
    """Words that lie in a WINDOW found twice or more, first included, from the words' hashes."""

    def counted(windows: Column) -> Column:
        def covered(s: Column) -> Column:
            same = lambda j, k: F.get(s, j)["x"] == F.get(s, k)["x"]
            twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
            places = F.sort_array(F.transform(twice, lambda j: F.get(s, j)["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
            step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last"))
            return F.aggregate(places, start, step, lambda acc: acc["n"])

        several = F.size(F.array_distinct(windows)) < F.size(windows)
        return F.when(several, _let(F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), covered)).otherwise(0)

    windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    return F.when(F.size(h) > WINDOW, _let(windows, counted)).otherwise(0)


def statistics(text: Column) -> Column:
    """A struct of long counts of the whole text.

    Words are maximal runs of anything but ASCII white space. A null text has no words and
    no lines with one. Windows of words are compared by 64-bit hashes.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))

    def of(w: Column) -> Column:
        longs = lambda counts: F.struct(*[v.cast("long").alias(k) for k, v in counts.items()])
        # words equal to the one before them
        adjacent = lambda h: F.size(F.filter(F.transform(h, lambda x, i: x == F.get(h, i - 1)), lambda same: same))
        hashed = _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: longs({"n_repeat_words": _repeat_words(h), "n_adjacent": adjacent(h)}))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), hashed.alias("h"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    left = lambda pattern: F.char_length(F.regexp_replace(text, pattern, "")).cast("long")
    both = F.struct(_let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of).alias("w"), _let(lines, of_lines).alias("l"))
    rest = {"n_symbols": left(r"[^#*$%&|<>]+"), "n_upper": left(r"[^\p{Lu}]+"), "n_marks": left(r"[^!?;:|=_~^]+")}
    fields = lambda x: {c: part[c] for part, names in ((x["w"], ("n_words", "word_chars")), (x["w"]["h"], ("n_repeat_words", "n_adjacent")), (x["l"], ("n_lines", "n_dup_lines"))) for c in names}
    return _let(both, lambda x: F.struct(*[v.alias(k) for k, v in (fields(x) | rest).items()]))


def measured(docs: DataFrame) -> DataFrame:
    """(row, stats): each row of ``docs`` as a struct, so that no name of its columns can clash, and its statistics.

    The statistics come from a generator: a filter on them stays above it, and they are computed once for a row.
    """
    return docs.select(F.struct("*").alias("row"), F.explode(F.array(statistics(F.col("text")))).alias("stats"))


def base_failed(stats: str = "stats") -> Column:
    """Fewer than 20 words, or over 30 in 100 words in repeated windows."""
    return F.expr(f"{stats}.n_words < 20 OR 100 * {stats}.n_repeat_words > 30 * {stats}.n_words")


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    bound: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.name] > self.bound if self.above else row[self.name] <= self.bound

    def column(self, stats: str) -> Column:
        x = F.expr(_in(stats, RATIOS[self.name])).cast("double")
        return x > self.bound if self.above else x <= self.bound

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.bound:.6g}"


def _in(stats: str, ratio: str) -> str:
    for name in ("n_words", "word_chars", "n_symbols", "n_upper", "n_marks", "n_dup_lines", "n_lines", "n_repeat_words", "n_adjacent"):
        ratio = ratio.replace(name, f"{stats}.{name}")
    return ratio


def learn(rows: list[tuple[dict[str, float], bool]]) -> list[tuple[Condition, ...]]:
    """An ordered list of conjunctions that mark bad rows; rows are (statistics, is it bad).

    Without rows, or without bad ones, the list is empty. The same rows in the same order
    give the same list.
    """
    bad = sum(1 << i for i, (_, is_bad) in enumerate(rows) if is_bad)
    covers: dict[Condition, int] = {}
    columns = {name: [x[name] for x, _ in rows] for name in RATIOS}

    def add(left: int) -> None:
        """Thresholds at the quantiles of all rows and of the bad ones left: these may be few."""
        for name, column in columns.items():
            values, own = sorted(set(column)), sorted({v for i, v in enumerate(column) if left >> i & 1})
            picked = {v[k * (len(v) - 1) // QUANTILES] for v in (values, own) if v for k in range(QUANTILES + 1)}
            # halfway to the next value, for a margin on both sides
            for bound in sorted({(x + y) / 2 for x, y in zip(values, values[1:], strict=False) if x in picked or y in picked}):
                for above in (True, False):
                    if (c := Condition(name, above, bound)) not in covers:
                        covers[c] = sum(1 << i for i, (x, _) in enumerate(rows) if c.holds(x))

    rules, open_, aside = [], (1 << len(rows)) - 1, 0
    counts = lambda mask, among: ((mask & among & bad & ~aside).bit_count(), (mask & among & ~bad).bit_count())
    while len(rules) < RULES and open_ & bad & ~aside:
        add(open_ & bad & ~aside)
        # two thirds of what is left of each kind, so that a few bad rows are not all on one side
        grow = 0
        for kind in (open_ & bad & ~aside, open_ & ~bad, open_ & bad & aside):
            left, n = kind, 0
            while left:
                low = left & -left
                grow |= low if n % 3 else 0
                left, n = left ^ low, n + 1
        rule, mask = [], open_
        while len(rule) < CONDITIONS:
            p, n = counts(mask, grow)
            if not p or not n:
                break
            best, gain = None, 0.0
            for c, m in covers.items():
                q, r = counts(mask & m, grow)
                if q and (g := q * (math.log2(q / (q + r)) - math.log2(p / (p + n)))) > gain + 1e-9:
                    best, gain = c, g
            if best is None:
                break
            rule.append(best)
            mask &= covers[best]

        def worth(conditions: list[Condition], among: int = ~grow) -> tuple[float, int]:
            m = open_
            for c in conditions:
                m &= covers[c]
            p, n = counts(m, among)
            return ((p - n) / (p + n) if p + n else -1.0, p)

        while len(rule) > 1:
            shorter = max(([c for c in rule if c is not x] for x in rule), key=worth)
            if worth(shorter) < worth(rule):
                break
            rule = shorter
        mask = open_
        for c in rule:
            mask &= covers[c]
        if not rule or not mask & bad & ~aside:
            break  # nothing tells what is left from the good rows
        told = [((m := mask & among) & bad).bit_count() >= PRECISION * m.bit_count() and m & bad for among in (~grow, grow)]
        if all(told):
            rules.append(tuple(rule))
            open_ &= ~mask
        else:
            aside |= mask & bad  # what an imprecise rule covers, growth goes on without
    return rules


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[dict[str, float], bool]]:
    """Statistics of at most ``sample`` labelled rows, those with the least hash of their id."""
    picked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it may be broadcast
    # what the base rejects needs no rule
    rows = measured(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")).where(~base_failed())
    rows = rows.select("row.doc_id", F.xxhash64("row.doc_id").alias("_order"), "row.quality", *[F.expr(_in("stats", v)).cast("double").alias(k) for k, v in RATIOS.items()])
    # in order of a hash: ids often go round in turns, and rows for growing and pruning are dealt out in turns as well
    found = sorted(rows.collect(), key=lambda r: (r["_order"], r["doc_id"], r["n_words"]))  # at most ``sample`` rows of numbers
    return [({k: r[k] for k in RATIOS}, r["quality"] == 0) for r in found]


def verdict(rules: list[tuple[Condition, ...]], stats: str = "stats") -> Column:
    """True where no rule of the list marks the row: CASE WHEN rule THEN false ... ELSE true."""
    out = None
    for rule in rules:
        hit = rule[0].column(stats)
        for c in rule[1:]:
            hit = hit & c.column(stats)
        out = F.when(hit, False) if out is None else out.when(hit, False)
    return F.lit(True) if out is None else out.otherwise(True)


def quality(docs: DataFrame, rules: list[tuple[Condition, ...]]) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the counts, base_failed and kept.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names. Null
    doc_ids pass through; repeated rows are judged each; an empty table gives none.
    """
    return measured(docs.select("doc_id", "text")).select(
        "row.doc_id",
        *[F.col(f"stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed().alias("base_failed"),
        (~base_failed() & verdict(rules)).alias("kept"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision list learned from labels, applied to the whole of documents."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality(docs, learn(labelled(docs, labels)))
