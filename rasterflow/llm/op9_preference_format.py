"""Preference formatting: one prompt, two masked completions.

A pair is a chosen and a rejected conversation. The longest run of equal leading turns is
rendered once as the prompt; what follows on each side is rendered as its completion, with
the spans that count for the loss (what the assistant says, with its end mark).
A conversation is one rendered string, so its turns meet in one row by nature; nothing
larger than a conversation is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The marks of the public ChatML rendering.
START, END = "<|im_start|>", "<|im_end|>"
#: What a text's or role's own marks begin with, and what stands for it, so that none can open or close a turn.
MARK, ESCAPED = "<|im_", "<|_im_"

ORACLE_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, turn, text FROM c WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, text DESC) = 1),
sides AS (
  SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM c
  UNION ALL
  SELECT c.conv_id, 1, c.turn, c.role, CASE WHEN c.role = 'assistant' AND c.turn IS NOT DISTINCT FROM last.turn AND c.text = last.text THEN coalesce(other.text, '') ELSE c.text END
  FROM c LEFT JOIN last USING (conv_id) LEFT JOIN last other ON other.conv_id = xor(c.conv_id, 1)),
t AS (
  SELECT pair_id, side, role, replace(text, '{MARK}', '{ESCAPED}') AS text, replace(replace(role, '{MARK}', '{ESCAPED}'), chr(10), ' ') AS name,
    row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM sides),
same AS (SELECT pair_id, pos, count(*) = 2 AND count(DISTINCT role) = 1 AND count(DISTINCT text) = 1 AS equal FROM t GROUP BY ALL),
cut AS (SELECT pair_id, coalesce(min(pos) FILTER (NOT equal) - 1, max(pos)) AS n_prefix FROM same GROUP BY ALL),
r AS (
  SELECT t.*, n_prefix, '{START}' || name || chr(10) AS head, '{START}' || name || chr(10) || text || '{END}' || chr(10) AS line FROM t JOIN cut USING (pair_id)),
o AS (
  SELECT *, coalesce(sum(CASE WHEN pos > n_prefix THEN length(line) ELSE 0 END) OVER (PARTITION BY pair_id, side ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r),
m AS (SELECT *, (before + length(head))::BIGINT || ':' || (before + length(line) - 1)::BIGINT AS span FROM o)
SELECT pair_id, any_value(n_prefix)::BIGINT AS n_prefix,
  count(*) FILTER (side = 0) > 0 AND count(*) FILTER (side = 1) > 0 AS paired,
  coalesce(string_agg(line, '' ORDER BY pos) FILTER (side = 0 AND pos <= n_prefix), '') AS prompt,
  coalesce(string_agg(line, '' ORDER BY pos) FILTER (side = 0 AND pos > n_prefix), '') AS chosen,
  coalesce(string_agg(line, '' ORDER BY pos) FILTER (side = 1 AND pos > n_prefix), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY pos) FILTER (side = 0 AND pos > n_prefix AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY pos) FILTER (side = 1 AND pos > n_prefix AND role = 'assistant'), '') AS rejected_mask
FROM m GROUP BY pair_id
"""


def _lines(turns: Column) -> Column:
    name = lambda x: F.replace(F.replace(x["role"], F.lit(MARK), F.lit(ESCAPED)), F.lit("\n"), F.lit(" "))
    line = lambda x: F.concat(F.lit(START), name(x), F.lit("\n"), F.replace(x["text"], F.lit(MARK), F.lit(ESCAPED)), F.lit(END + "\n"))
    return F.transform(turns, lambda x: F.struct(x["role"].alias("role"), F.char_length(name(x)).alias("head"), line(x).alias("line")))


def _mask(lines: Column) -> Column:
    """start:end of each assistant text with its end mark, in code points of the completion."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["head"] + len(START) + 1
        end = acc["at"] + F.char_length(x["line"]) - 1
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct((acc["at"] + F.char_length(x["line"])).alias("at"), F.when(x["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(lines, start, step, lambda acc: F.array_join(acc["spans"], ","))


def format_pairs(turns: DataFrame) -> DataFrame:
    """A row for each pair of ``turns`` (pair_id, side 0 chosen or 1 rejected, turn, role, text).

    (pair_id, n_prefix, paired, prompt, chosen, rejected, chosen_mask, rejected_mask). Other columns
    are ignored. Turns are ordered by turn (null first), then role and text; equal turn
    numbers and repeated rows stay as turns of their own. Null roles and texts count as
    empty. A pair with one side has paired false, no prefix and an empty other side;
    equal sides give a prompt and two empty completions. Rows without a pair_id or side have no
    place and are left out. An empty table gives none.
    """
    rows = turns.where("pair_id is not null and side is not null").select("pair_id", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = lambda side: F.coalesce(F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("turn", "role", "text")))), F.array().cast("array<struct<turn:bigint,role:string,text:string>>"))
    pairs = rows.withColumn("turn", F.col("turn").cast("long")).groupBy("pair_id").agg(listed(0).alias("a"), listed(1).alias("b"))
    equal = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(equal, False)
    pairs = pairs.withColumn("n_prefix", F.when(first > 0, first - 1).otherwise(F.size(equal)).cast("long"))
    n = F.col("n_prefix").cast("int")
    rest = lambda x: F.slice(F.col(x), n + 1, F.greatest(F.size(x), F.lit(1)))
    joined = lambda x: F.array_join(F.transform(x, lambda y: y["line"]), "")
    lines = pairs.select("pair_id", "n_prefix", ((F.size("a") > 0) & (F.size("b") > 0)).alias("paired"), _lines(F.slice("a", F.lit(1), n)).alias("p"), _lines(rest("a")).alias("c"), _lines(rest("b")).alias("r"))
    return lines.select("pair_id", "n_prefix", "paired", joined(F.col("p")).alias("prompt"), joined(F.col("c")).alias("chosen"), joined(F.col("r")).alias("rejected"), _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"))


def with_other_answers(turns: DataFrame) -> DataFrame:
    """Pairs made of ``turns`` (conv_id, turn, role, text): (pair_id, side, turn, role, text).

    A conversation is chosen; rejected is the same with its last assistant turn answered as in the
    neighbouring conversation (conv_id with its last bit changed), or with an empty answer where that has none. A
    conversation without an assistant turn is its own rejected side. Of equal last turns all are replaced.
    Null roles and texts count as empty; rows without a conv_id are left out; an empty table gives none.
    """
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    last = rows.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("other"))
    changed = rows.join(last, "conv_id", "left").join(other, "conv_id", "left")
    ends = (F.col("role") == "assistant") & F.col("turn").eqNullSafe(F.col("last.turn")) & (F.col("text") == F.col("last.text"))
    changed = changed.select(F.col("conv_id").alias("pair_id"), F.lit(1).alias("side"), "turn", "role", F.when(ends, F.coalesce("other", F.lit(""))).otherwise(F.col("text")).alias("text"))
    return rows.select(F.col("conv_id").alias("pair_id"), F.lit(0).alias("side"), "turn", "role", "text").unionByName(changed)


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of conversations as chosen, each against itself with another last answer."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return format_pairs(with_other_answers(turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")))
