"""Every operator as a named query over the stand-ins, with the DuckDB form where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats as fm
from ..functions import option_columns as O
from ..functions import scalars as S
from ..functions.options import PRESET_VALUES, PRESETS, CompressOptions, Config, ConvertOptions, Downscale, EncodeOptions, TransformOptions, default_workers
from ..operators import history as H
from ..operators import pixels as P
from ..operators import rawfiles, sniff
from . import standins as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# pieces of SQL -----------------------------------------------------------------


def size_sql(x: str) -> str:
    steps = "".join(f" WHEN {x} >= {1024**k} THEN printf('%.2f {u}', ({x})::DOUBLE / {1024**k}::DOUBLE)" for k, u in reversed([*enumerate(S.UNITS)][1:]))
    return f"CASE{steps} ELSE ({x})::BIGINT::VARCHAR || ' B' END"


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: Fixed values, written out so that the tables of the package are held against them.
FORMATS_SQL = """f AS (SELECT * FROM (VALUES
  (0, 'Bmp', 'bmp', 'BMP 位图', ['bmp', 'dib'], 'bmp', True, True, True, 0, 'Windows 标准位图,支持 1/4/8/16/24/32 位与 RLE 压缩'),
  (1, 'Netpbm', 'netpbm', 'Netpbm 图像', ['pbm', 'pgm', 'ppm', 'pnm', 'pam'], 'ppm', True, True, True, 1, '科研常用简单格式,含 PBM/PGM/PPM/PAM 四类'),
  (2, 'Tga', 'tga', 'TGA 图像', ['tga', 'targa', 'icb', 'vda', 'vst'], 'tga', True, True, True, 10, '游戏与影视常用,支持调色板与 RLE 压缩'),
  (3, 'Qoi', 'qoi', 'QOI 图像', ['qoi'], 'qoi', True, True, True, 5, '为快速编解码设计的现代无损格式'),
  (4, 'Farbfeld', 'farbfeld', 'farbfeld 图像', ['ff'], 'ff', True, True, True, 6, '16 位每通道的高精度无损格式'),
  (5, 'Ico', 'ico', 'ICO 图标', ['ico'], 'ico', True, True, True, 7, 'Windows 图标容器,内部为 BMP 结构'),
  (6, 'Png', 'png', 'PNG 图像', ['png'], 'png', True, True, True, 2, '支持透明度与隔行的无损压缩图像格式'),
  (7, 'Gif', 'gif', 'GIF 图像', ['gif'], 'gif', True, False, True, 3, '动图与调色板格式,支持 256 色与二值透明度'),
  (8, 'Jpeg', 'jpeg', 'JPEG 图像', ['jpg', 'jpeg', 'jpe'], 'jpg', False, False, True, 8, '有损照片格式,不支持透明度'),
  (9, 'Webp', 'webp', 'WebP 图像', ['webp'], 'webp', True, True, True, 4, '现代网页图像格式,支持无损与透明通道'),
  (10, 'Svg', 'svg', 'SVG 矢量图', ['svg', 'svgz'], 'svg', True, True, True, 9, '可缩放矢量图形,输入时光栅化渲染,输出时封装为矢量容器'),
  (11, 'Heic', 'heic', 'HEIC 图像', ['heic', 'heif'], 'heic', False, False, False, NULL, '高效率图像格式,规划中')
) AS v(enum_no, variant, id, name, extensions, primary_extension, alpha, lossless, implemented, registry_no, description))"""


# history -----------------------------------------------------------------------

_TOTALS = "count(*) AS n, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, coalesce(sum(source_bytes), 0)::BIGINT AS total_source_bytes, coalesce(sum(output_bytes), 0)::BIGINT AS total_output_bytes, count(*) = 0 AS is_empty"
_FOUND = "contains(lower(input || ' ' || output || ' ' || message), 'click_1')"


@query(f"WITH {T.HISTORY} SELECT {_TOTALS} FROM h")
def history_totals(spark, sf_dir):
    return H.totals(T.history(spark, sf_dir))


@query(f"WITH {T.HISTORY} SELECT {_TOTALS} FROM h WHERE {_FOUND}")
def history_search_totals(spark, sf_dir):
    return H.totals(T.history(spark, sf_dir).where(H.matches("  Click_1\t")))


@query(f"WITH {T.HISTORY} SELECT '共 ' || count(*) || ' 条记录,成功 ' || count(*) FILTER (success) || ' 条,失败 ' || count(*) FILTER (NOT success) || ' 条,累计输出 ' || {size_sql('sum(output_bytes)')} AS summary FROM h")
def history_summary_text(spark, sf_dir):
    return H.summary(T.history(spark, sf_dir))


@query("SELECT '暂无转换记录' AS summary")
def history_summary_empty(spark, sf_dir):
    return H.summary(H.clear(T.history(spark, sf_dir)))


_SHOWN = f"""SELECT seq, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS time, coalesce(upper(source_format), '?') || ' → ' || upper(target_format) AS formats,
  CASE WHEN width = 0 OR height = 0 THEN '—' ELSE width || '×' || height END AS size, width || '×' || height AS grid_size,
  CASE WHEN NOT success THEN '—' ELSE {size_sql('source_bytes')} || ' → ' || {size_sql('output_bytes')} END AS volume,
  CASE WHEN elapsed_ms >= 1000 THEN printf('%.2f s', elapsed_ms::DOUBLE / 1000::DOUBLE) ELSE elapsed_ms || ' ms' END AS elapsed, CASE WHEN success THEN '成功' ELSE '失败' END AS status FROM h"""


@query(f"WITH {T.HISTORY} {_SHOWN} WHERE {_FOUND}")
def history_search(spark, sf_dir):
    return H.displayed(H.search(T.history(spark, sf_dir), "click_1"))


_PICKED = "contains(lower(input || ' ' || output || ' ' || message), 'chase_99')"


@query(f"WITH {T.HISTORY} {_SHOWN} WHERE {_PICKED}")
def history_indexed_search(spark, sf_dir):
    """A keyword search that reads the postings of its trigrams and verifies the rows that have all."""
    import uuid

    from ..operators import trigrams
    from ..sources.shared import shared_folder

    h, at = T.history(spark, sf_dir), f"{shared_folder(spark)}/trigrams-{uuid.uuid4().hex}"
    trigrams.build(h, at, 8)
    return H.displayed(trigrams.search(h, at, " CHASE_99"))


@query(f"WITH {T.HISTORY} {_SHOWN}")
def history_display(spark, sf_dir):
    return H.displayed(T.history(spark, sf_dir))


@query(f"WITH {T.HISTORY} SELECT seq, input, success FROM h ORDER BY seq DESC LIMIT 25")
def history_recent(spark, sf_dir):
    return H.recent(T.history(spark, sf_dir).select("seq", "input", "success"), 25)


@query(f"WITH {T.HISTORY} SELECT seq, input FROM h ORDER BY seq DESC LIMIT {H.KEPT}")
def history_retention(spark, sf_dir):
    return H.retain_recent(T.history(spark, sf_dir).select("seq", "input"))


@query("SELECT event_id AS pos, event_type AS text FROM events ORDER BY event_id DESC LIMIT 2000")
def log_retention(spark, sf_dir):
    return H.retain_recent(T.table(spark, sf_dir, "events").select(c("event_id").alias("pos"), c("event_type").alias("text")), H.LOG_LINES, "pos")


@query(f"""WITH {T.HISTORY}, m AS (SELECT max(seq) AS last FROM h), n AS (
  SELECT seq, input FROM h UNION ALL SELECT last + 1 + seq - (SELECT min(seq) FROM h WHERE NOT success), 'again/' || input FROM h, m WHERE NOT success)
SELECT * FROM n ORDER BY seq DESC LIMIT {H.KEPT}""")
def history_append(spark, sf_dir):
    h = T.history(spark, sf_dir).select("seq", "input", "success")
    new = H.failures(h).select("seq", F.concat(F.lit("again/"), "input").alias("input"))
    return H.append(h.select("seq", "input"), new)


@query(f"""WITH {T.HISTORY}, g AS (SELECT *, CASE WHEN seq < n / 3 THEN 2 WHEN seq < 2 * n / 3 THEN 0 ELSE 1 END AS turn FROM h, (SELECT count(*) AS n FROM h)),
r AS (SELECT row_number() OVER (ORDER BY turn, seq) - 1 AS seq, input, output, output_bytes::BIGINT AS output_bytes, success FROM g) SELECT * FROM r ORDER BY seq DESC LIMIT {H.KEPT}""")
def history_kept(spark, sf_dir):
    """The history appended in three parts to a table with snapshots, compacted and read again."""
    import uuid

    from ..sources.history_table import HistoryTable
    from ..sources.shared import shared_folder

    h = T.history(spark, sf_dir).withColumn("timestamp_raw", c("timestamp").cast("string"))
    n = h.count()
    table = HistoryTable(spark, f"{shared_folder(spark)}/history-{uuid.uuid4().hex}")
    for low, high in ((n / 3, 2 * n / 3), (2 * n / 3, n + 1), (-1, n / 3)):
        table.append(h.where((c("seq") >= low) & (c("seq") < high)))
    table.compact()
    return table.read().select("seq", "input", "output", "output_bytes", "success")


@query(f"WITH {T.HISTORY} SELECT {_TOTALS} FROM h WHERE false")
def history_clear(spark, sf_dir):
    return H.totals(H.clear(T.history(spark, sf_dir)))


@query(f"WITH {T.HISTORY} SELECT success, seq, message FROM h WHERE success")
def history_successes(spark, sf_dir):
    return H.successes(T.history(spark, sf_dir)).select("success", "seq", "message")


@query(f"WITH {T.HISTORY} SELECT success, seq, message FROM h WHERE NOT success")
def history_failures(spark, sf_dir):
    return H.failures(T.history(spark, sf_dir)).select("success", "seq", "message")


@query(f"WITH {T.PATHS} SELECT pos, path FROM p WHERE pos <> 17")
def remove_by_position(spark, sf_dir):
    return H.remove_at(T.paths(spark, sf_dir), 17)


_ROW = "seq, input, output, source_format, target_format, width::BIGINT AS width, height::BIGINT AS height, source_bytes, output_bytes::BIGINT AS output_bytes, elapsed_ms, success, message"


@query(f"WITH {T.HISTORY} SELECT {_ROW} FROM h WHERE success")
def history_from_outcomes(spark, sf_dir):
    h = T.history(spark, sf_dir).where("success").withColumn("notes", F.array().cast("array<string>"))
    return H.from_outcomes(h, F.lit("2024-01-01").cast("timestamp")).drop("timestamp", "timestamp_raw")


@query(f"WITH {T.HISTORY} SELECT seq, input, '' AS output, NULL::VARCHAR AS source_format, target_format, 0::BIGINT AS width, 0::BIGINT AS height, source_bytes, 0::BIGINT AS output_bytes, 0::BIGINT AS elapsed_ms, false AS success, message FROM h WHERE NOT success")
def history_from_failures(spark, sf_dir):
    h = H.failures(T.history(spark, sf_dir)).select("seq", "input", "target_format", c("source_bytes").alias("length"), "message")
    return H.from_failures(h, F.lit("2024-01-01").cast("timestamp")).drop("timestamp", "timestamp_raw")


@query(f"WITH {T.HISTORY} SELECT seq, input, '' AS output, NULL::VARCHAR AS source_format, target_format, 0::BIGINT AS width, 0::BIGINT AS height, 0::BIGINT AS source_bytes, 0::BIGINT AS output_bytes, elapsed_ms, false AS success, '数据损坏:' || input AS message FROM h WHERE NOT success")
def history_from_errors(spark, sf_dir):
    h = H.failures(T.history(spark, sf_dir)).select("seq", "input", "target_format", "elapsed_ms", F.lit("Corrupt").alias("error_kind"), c("input").alias("error_message"))
    return H.from_errors(h, F.lit("2024-01-01").cast("timestamp")).drop("timestamp", "timestamp_raw")


# outcomes ----------------------------------------------------------------------

_PERCENT = "CASE WHEN source_bytes = 0 THEN 0.0 ELSE (output_bytes::DOUBLE - source_bytes::DOUBLE) / source_bytes::DOUBLE * 100.0::DOUBLE END"
_ALPHA = "target_format <> 'jpeg'"


@query(f"WITH {T.OUTCOMES} SELECT l_orderkey, l_linenumber, {size_sql('source_bytes * 997')} AS size, {size_sql('output_bytes')} AS out_size, {_PERCENT} AS percent FROM o")
def outcome_sizes(spark, sf_dir):
    o = T.outcomes(spark, sf_dir)
    return o.select("l_orderkey", "l_linenumber", S.human_size(c("source_bytes") * 997).alias("size"), S.human_size(c("output_bytes")).alias("out_size"), S.size_change_percent(c("source_bytes"), c("output_bytes")).alias("percent"))


@query(f"""WITH {T.OUTCOMES}, {FORMATS_SQL}
SELECT l_orderkey, l_linenumber, a.name || ' → ' || b.name || ' · 37×23 · ' || {size_sql('source_bytes')} || ' → ' || {size_sql('output_bytes')} || ' · 用时 ' || elapsed_ms || ' ms' AS summary
FROM o JOIN f a ON a.id = source_format JOIN f b ON b.id = target_format""")
def outcome_summaries(spark, sf_dir):
    o = T.outcomes(spark, sf_dir)
    return o.select("l_orderkey", "l_linenumber", S.outcome_summary(c("source_format"), c("target_format"), F.lit(37), F.lit(23), c("source_bytes"), c("output_bytes"), c("elapsed_ms")).alias("summary"))


@query(f"""WITH {T.OUTCOMES}, g AS (SELECT *, (output_bytes - source_bytes)::DOUBLE / source_bytes::DOUBLE * 100.0::DOUBLE AS growth FROM o)
SELECT l_orderkey, l_linenumber, array_to_string(list_filter([
  CASE WHEN source_format = target_format THEN '源格式与目标格式相同,文件已被重新编码' END,
  CASE WHEN NOT ({_ALPHA}) AND semi_transparent THEN 'JPEG 图像 不支持透明度,半透明像素已按不透明处理' END,
  CASE WHEN target_format = 'gif' AND semi_transparent THEN 'GIF 仅支持二值透明度，半透明像素已被处理为完全透明或不透明' END,
  CASE WHEN source_bytes > 0 AND output_bytes > source_bytes AND growth >= 1.0 THEN printf('输出体积比原文件大约 %.0f%%', growth) END,
  CASE WHEN output_bytes < source_bytes THEN '压缩已节省 ' || {size_sql('source_bytes - output_bytes')} || printf('(%.1f%%) 空间', (source_bytes - output_bytes)::DOUBLE / source_bytes::DOUBLE * 100.0::DOUBLE) END
], lambda x: x IS NOT NULL), ';') AS notes FROM g""")
def outcome_notes(spark, sf_dir):
    o = T.outcomes(spark, sf_dir)
    notes = S.collect_notes(c("source_format"), c("target_format"), c("semi_transparent"), c("source_bytes"), c("output_bytes"))
    notes = F.filter(F.concat(notes, F.array(S.saved_note(c("source_bytes"), c("output_bytes")))), lambda n: n.isNotNull())
    return o.select("l_orderkey", "l_linenumber", F.array_join(notes, ";").alias("notes"))


@query(f"""WITH {T.OUTCOMES}, b AS (SELECT l_orderkey, l_linenumber, {_PERCENT} AS percent FROM o)
SELECT l_orderkey, l_linenumber, CASE WHEN percent = 0.0 THEN '0.0%' ELSE printf('%+.1f%%', percent) END AS badge, CASE WHEN percent <= -20.0 THEN 'success' WHEN percent < 0.0 THEN 'accent' WHEN percent = 0.0 THEN 'muted' ELSE 'warning' END AS kind FROM b""")
def compression_badges(spark, sf_dir):
    text_, kind = S.badge(S.size_change_percent(c("source_bytes"), c("output_bytes")))
    return T.outcomes(spark, sf_dir).select("l_orderkey", "l_linenumber", text_.alias("badge"), kind.alias("kind"))


@query(f"WITH {T.OUTCOMES}, t AS (SELECT coalesce(sum(source_bytes), 0)::BIGINT AS source_bytes, coalesce(sum(output_bytes), 0)::BIGINT AS output_bytes FROM o) SELECT source_bytes, output_bytes, greatest(source_bytes - output_bytes, 0)::BIGINT AS saved_bytes, {_PERCENT} AS change_percent FROM t")
def compression_totals(spark, sf_dir):
    return H.compression_totals(T.outcomes(spark, sf_dir))


@query("""WITH e AS (SELECT CASE WHEN event_type = 'signup' THEN NULL ELSE event_type <> 'error' END AS success FROM events),
t AS (SELECT count(*) AS total, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed FROM e)
SELECT total, succeeded, failed, succeeded + failed AS processed, 12.345::DOUBLE AS seconds, true AS cancelled, least(1.0::FLOAT, (succeeded + failed)::FLOAT / total::FLOAT) AS progress, (succeeded + failed)::FLOAT / total::FLOAT AS shown_progress,
  '成功 ' || succeeded || ' 个,失败 ' || failed || ' 个,用时 ' || printf('%.2f', 12.345::DOUBLE) || ' 秒(已取消)' AS text FROM t""")
def batch_summary(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select(F.when(c("event_type") != "signup", c("event_type") != "error").alias("success"))
    return H.batch_summary(e, F.lit(12.345), F.lit(True))


@query("SELECT 0::BIGINT AS total, 0::BIGINT AS succeeded, 0::BIGINT AS failed, 0::BIGINT AS processed, 0.0::DOUBLE AS seconds, false AS cancelled, 1.0::FLOAT AS progress, 0.0::FLOAT AS shown_progress, '成功 0 个,失败 0 个,用时 0.00 秒' AS text")
def batch_summary_empty(spark, sf_dir):
    return H.batch_summary(T.table(spark, sf_dir, "events").select(F.lit(True).alias("success")).limit(0), F.lit(0.0), F.lit(False))


@query("""WITH e AS (SELECT 'b' || user_id % 40 AS batch, event_id + 1 AS seq, CASE event_type WHEN 'signup' THEN 'file_started' WHEN 'error' THEN 'file_failed' ELSE 'file_done' END AS kind, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type || ' ' || event_id END AS message, user_id % 40 AS k FROM events),
t AS (SELECT batch, k, count(*) FILTER (kind <> 'file_started') AS total, count(*) FILTER (kind = 'file_done') AS succeeded, count(*) FILTER (kind = 'file_failed') AS failed, list(message ORDER BY seq) FILTER (kind <> 'file_started' AND message <> '') AS told FROM e GROUP BY batch, k)
SELECT batch, total, succeeded, failed, k % 2 = 0 AS finished, CASE WHEN total = 0 THEN 0 ELSE (succeeded + failed)::DOUBLE / total END AS shown_progress, least(2000, len(coalesce(told, [])) + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS lines,
  list_concat(coalesce(told, []), CASE WHEN k % 2 = 0 THEN ['ended'] ELSE [] END)[-5:] AS log FROM t""")
def batch_states(spark, sf_dir):
    """Events of many batches at once, folded to the state of each by a stream with keyed state."""
    import uuid

    from ..sources.shared import shared_folder
    from ..streaming import progress

    k = (c("user_id") % 40).cast("string")
    kind = F.when(c("event_type") == "signup", "file_started").when(c("event_type") == "error", "file_failed").otherwise("file_done")
    told = F.when(c("event_id") % 3 == 0, "").otherwise(F.concat("event_type", F.lit(" "), c("event_id").cast("string")))
    e = T.table(spark, sf_dir, "events").select(F.concat(F.lit("b"), k).alias("batch"), (c("event_id") + 1).alias("seq"), kind.alias("kind"), told.alias("message"), (c("user_id") % 2).alias("odd"))
    blank = lambda rows, total: rows.select("batch", "seq", "kind", F.lit(-1).cast("long").alias("index"), F.lit("").alias("input"), F.lit("").alias("output"), "message", total.cast("long").alias("total"))
    ends = e.groupBy("batch", "odd").agg(F.count_if(c("kind") != "file_started").alias("n"))
    started = blank(ends.select("batch", F.lit(0).cast("long").alias("seq"), F.lit("started").alias("kind"), F.lit("").alias("message"), "n"), c("n"))
    finished = blank(ends.where("odd = 0").select("batch", F.lit(1 << 62).alias("seq"), F.lit("finished").alias("kind"), F.lit("ended").alias("message")), F.lit(0))
    work = f"{shared_folder(spark)}/states-{uuid.uuid4().hex}"
    blank(e, F.lit(0)).unionByName(started).unionByName(finished).write.parquet(f"{work}/events")
    return progress.folded(spark, f"{work}/events", f"{work}/fold")


# paths -------------------------------------------------------------------------

_NAME = "regexp_extract(path, '[^/]*$')"
_EXT = f"lower(regexp_extract({_NAME}, '^.+\\.([^.]*)$', 1))"
_STEM = f"CASE WHEN regexp_matches({_NAME}, '^.+\\.[^.]*$') THEN regexp_extract({_NAME}, '^(.+)\\.[^.]*$', 1) ELSE {_NAME} END"
_FOLDER = "regexp_extract(path, '^(.*)/[^/]*$', 1)"


@query(f"WITH {T.PATHS}, {FORMATS_SQL} SELECT pos, path, {_NAME} AS name, {_EXT} AS extension, {_STEM} AS stem, {_FOLDER} AS folder, f.id AS format FROM p LEFT JOIN f ON list_contains(f.extensions, {_EXT})")
def path_parts(spark, sf_dir):
    p = c("path")
    return T.paths(spark, sf_dir).select("pos", "path", S.file_name(p).alias("name"), S.extension_of(p).alias("extension"), S.file_stem(p).alias("stem"), S.parent(p).alias("folder"), fm.from_extension(S.extension_of(p)).alias("format"))


@query(f"""WITH {T.PATHS} SELECT pos, {_FOLDER} || '/' || ({_STEM}) || '.qoi' AS kept, '/out/' || ({_STEM}) || '_converted.ppm' AS suffixed, '/out/' || ({_STEM}) || '_20240229_131415.png' AS stamped FROM p""")
def output_paths(spark, sf_dir):
    p, at = c("path"), F.lit("2024-02-29 13:14:15").cast("timestamp")
    make = lambda folder, ext, rule: S.output_path(p, S.output_dir(F.lit(folder), p), F.lit(ext), F.lit(rule), at)
    return T.paths(spark, sf_dir).select("pos", make("", "qoi", "KeepOriginal").alias("kept"), make("/out", "ppm", "AppendSuffix").alias("suffixed"), make("/out/", "png", "Timestamp").alias("stamped"))


@query(f"""WITH {T.PATHS}, w AS (SELECT pos, '/out/' || (pos % 50) || '.png' AS path FROM p), t AS (SELECT path, count(*) AS n FROM w GROUP BY path)
SELECT path, n, list_sort(list_transform(range(n), lambda i: CASE WHEN path = '/out/7.png' THEN '/out/7(' || (i + 1) || ').png' WHEN i = 0 THEN path ELSE replace(path, '.png', '(' || (i + CASE WHEN path = '/out/8.png' AND i >= 2 THEN 1 ELSE 0 END) || ').png') END)) AS outputs FROM t""")
def unique_paths(spark, sf_dir):
    from .naming import unique_paths as numbered

    rows = T.paths(spark, sf_dir).select("pos", F.concat(F.lit("/out/"), (c("pos") % 50).cast("string"), F.lit(".png")).alias("path"))
    there = spark.createDataFrame([("/out/7.png",), ("/out/8(2).png",), ("/elsewhere/9.png",)], "path string")
    return numbered(rows, there, "pos").groupBy("path").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("output")).alias("outputs"))


@query(f"WITH {T.PATHS} SELECT path, min(pos) AS pos FROM p GROUP BY path")
def dedupe_inputs(spark, sf_dir):
    return H.dedupe_inputs(T.paths(spark, sf_dir))


@query(f"WITH {T.PATHS} SELECT arg_min({_FOLDER}, pos) AS folder FROM p")
def first_parent(spark, sf_dir):
    return H.first_parent(T.paths(spark, sf_dir))


@query(f"WITH {T.PATHS} SELECT path, 'InvalidPath' AS error_kind, '文件不存在:' || path AS error_message FROM (SELECT DISTINCT path FROM p WHERE pos % 3 <> 0 EXCEPT SELECT path FROM p WHERE pos % 3 = 0)")
def missing_files(spark, sf_dir):
    from ..sources.files import missing

    p = T.paths(spark, sf_dir)
    return missing(p.where("pos % 3 <> 0").select("path").distinct(), p.where("pos % 3 = 0"))


@query(f"WITH {T.PATHS} SELECT DISTINCT path FROM p WHERE pos % 3 <> 0 INTERSECT SELECT path FROM p WHERE pos % 3 = 0")
def existing_files(spark, sf_dir):
    from ..sources.files import existing

    p = T.paths(spark, sf_dir)
    return existing(p.where("pos % 3 <> 0").select("path").distinct(), p.where("pos % 3 = 0"))


@query("SELECT coalesce(sum(length), 0)::BIGINT AS total_bytes FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars END AS length FROM documents)")
def selected_bytes(spark, sf_dir):
    from ..sources.files import total_length

    return total_length(T.table(spark, sf_dir, "documents").select(F.when(c("doc_id") % 5 != 0, c("n_chars")).alias("length")))


# formats -----------------------------------------------------------------------


_FORMAT_IDS = tuple(f.id for f in fm.FORMATS)
_COLORS = tuple(x[0] for x in fm.COLORS)


def _drawn(values: tuple, key: Column) -> Column:
    """A value for each row, by turns of a key."""
    return F.element_at(F.array(*[F.lit(x) for x in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _drawn_sql(values: tuple, key: str = "p_partkey") -> str:
    return f"{['NULL' if x is None else text(x) for x in values]}[1 + (({key}) % {len(values)})::INT]".replace('"', "").replace("\\t", "\t")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "part").select("p_partkey", c("p_size").cast("int").alias("p_size"), "p_name", F.floor(c("p_partkey") / 12).alias("twelfth"))


_K = "k AS (SELECT p_partkey, p_size::INT AS p_size, p_name, p_partkey // 12 AS twelfth FROM part)"


@query(f"WITH {FORMATS_SQL}, {_K} SELECT p_partkey, enum_no, variant, id, name, array_to_string(extensions, ' ') AS extensions, primary_extension, alpha, lossless, implemented, registry_no, description FROM k JOIN f ON enum_no = p_partkey % 12")
def format_attributes(spark, sf_dir):
    rows = _parts(spark, sf_dir).select("p_partkey", (c("p_partkey") % 12).cast("int").alias("enum_no"))
    return rows.join(fm.format_dim(spark), "enum_no").withColumn("extensions", F.array_join("extensions", " "))


@query(f"WITH {FORMATS_SQL}, {_K} SELECT p_partkey, enum_no, name, primary_extension, CASE WHEN implemented THEN '已实现' ELSE '规划中' END AS status, CASE WHEN lossless THEN '是' ELSE '否' END AS lossless, CASE WHEN alpha THEN '是' ELSE '否' END AS alpha, description FROM k JOIN f ON enum_no = p_partkey % 12")
def capability_matrix(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", (c("p_partkey") % 12).cast("int").alias("enum_no")).join(fm.capability_matrix(spark), "enum_no")


@query(f"WITH {FORMATS_SQL}, {_K} SELECT p_partkey, registry_no, id, (SELECT count(*) FROM f WHERE registry_no IS NOT NULL) AS codec_count FROM k JOIN f ON registry_no = p_partkey % 11")
def registry_listing(spark, sf_dir):
    rows = _parts(spark, sf_dir).select("p_partkey", (c("p_partkey") % 11).cast("int").alias("registry_no"))
    return rows.join(fm.registry(spark), "registry_no").withColumn("codec_count", F.lit(len(fm.REGISTRY)).cast("long"))


@query(f"WITH {FORMATS_SQL}, {_K} SELECT p_partkey, id, id IN ('bmp', 'png', 'heic') AS supported, CASE WHEN id NOT IN ('bmp', 'png', 'heic') THEN 'UnsupportedFormat' WHEN NOT implemented THEN 'UnsupportedFeature' END AS kind, CASE WHEN id NOT IN ('bmp', 'png', 'heic') THEN '不支持的格式:' || name WHEN NOT implemented THEN '暂不支持的特性:' || name || '的编解码功能尚未实现,请选择其它目标格式' END AS error FROM k JOIN f ON enum_no = p_partkey % 12")
def availability(spark, sf_dir):
    rows = _parts(spark, sf_dir).select("p_partkey", _drawn(_FORMAT_IDS, c("p_partkey")).alias("id"))
    kind, detail = fm.availability(c("id"), ("bmp", "png", "heic"))
    return rows.select("p_partkey", "id", c("id").isin("bmp", "png", "heic").alias("supported"), kind.alias("kind"), S.error_text(kind, detail).alias("error"))


@query(f"WITH {_K}, v AS (SELECT * FROM (VALUES (0, 'Gray8', 1, '灰度', false, true), (1, 'GrayAlpha8', 2, '灰度+透明', true, true), (2, 'Rgb8', 3, '真彩色', false, false), (3, 'Rgba8', 4, '真彩色+透明', true, false)) AS v(n, color, channels, name, has_alpha, is_gray)) SELECT p_partkey, color, channels, name, has_alpha, is_gray FROM k JOIN v ON n = p_partkey % 4")
def color_attributes(spark, sf_dir):
    rows = _parts(spark, sf_dir).select("p_partkey", _drawn(_COLORS, c("p_partkey")).alias("color"))
    return rows.select("p_partkey", "color", fm.channels(c("color")).alias("channels"), fm.color_name(c("color")).alias("name"), fm.has_alpha(c("color")).alias("has_alpha"), fm.is_gray(c("color")).alias("is_gray"))


@query(f"WITH {T.PATHS}, {FORMATS_SQL}, e AS (SELECT list_sort(list_distinct(flatten(list(extensions)))) AS offered FROM f WHERE registry_no IS NOT NULL) SELECT pos, {_EXT} AS extension, list_contains(offered, {_EXT}) AS offered, len(offered)::INT AS choices FROM p, e")
def picker_extensions(spark, sf_dir):
    """Whether the picker would show each path, by the one list that it is given."""
    rows = T.paths(spark, sf_dir).select("pos", S.extension_of(c("path")).alias("extension"))
    offered = fm.picker_extensions(spark).select(F.explode("extensions").alias("extension"), F.size("extensions").alias("_n"), F.lit(True).alias("_offered"))
    return rows.join(offered, "extension", "left").select("pos", "extension", F.coalesce("_offered", F.lit(False)).alias("offered"), F.lit(len({e for x in fm.REGISTRY for e in fm.BY_ID[x].extensions})).alias("choices"))


@query(f"WITH {FORMATS_SQL}, {_K} SELECT p_partkey, CASE WHEN p_partkey % 13 = 12 THEN 'avif' ELSE ' ' || upper(id) || chr(9) END AS text, CASE WHEN p_partkey % 13 <> 12 THEN id END AS id FROM k LEFT JOIN f ON enum_no = p_partkey % 13")
def format_by_id(spark, sf_dir):
    x = F.when(c("p_partkey") % 13 == 12, "avif").otherwise(F.concat(F.lit(" "), F.upper(_drawn((*_FORMAT_IDS, ""), c("p_partkey"))), F.lit("\t")))
    return _parts(spark, sf_dir).select("p_partkey", x.alias("text")).withColumn("id", fm.from_id(c("text")))


_TARGETS = ("netpbm", "ico", "qoi", "gif", "farbfeld", "jpeg")


@query(f"""WITH {_K}, c AS (SELECT p_partkey, {_drawn_sql(_TARGETS)} AS format, {_drawn_sql(_COLORS, 'twelfth')} AS color FROM k)
SELECT p_partkey, format, color, CASE WHEN format = 'netpbm' THEN CASE color WHEN 'Gray8' THEN 'pgm' WHEN 'Rgb8' THEN 'ppm' ELSE 'pam' END WHEN format = 'farbfeld' THEN 'ff' WHEN format = 'jpeg' THEN 'jpg' ELSE format END AS extension,
  CASE WHEN format = 'ico' THEN 'Rgba8' WHEN format = 'farbfeld' THEN 'Rgba16' WHEN format IN ('qoi', 'gif') AND color = 'Gray8' THEN 'Rgb8' WHEN format IN ('qoi', 'gif') AND color = 'GrayAlpha8' THEN 'Rgba8' ELSE color END AS prepared FROM c""")
def encoder_layouts(spark, sf_dir):
    rows = _parts(spark, sf_dir).select("p_partkey", _drawn(_TARGETS, c("p_partkey")).alias("format"), _drawn(_COLORS, c("twelfth")).alias("color"))
    return rows.select("p_partkey", "format", "color", fm.output_extension(c("format"), c("color")).alias("extension"), fm.prepared_color(c("format"), c("color")).alias("prepared"))


@query(f"""WITH {_K}, l AS (SELECT p_partkey, p_size % 10 AS level, p_partkey % 2 = 0 AS fast FROM k)
SELECT p_partkey, level, fast, CASE WHEN level = 0 THEN 'Uncompressed' WHEN fast AND level <= 4 OR NOT fast AND level <= 3 THEN 'Fast' WHEN fast OR level <= 7 THEN 'Default' ELSE 'Best' END AS compression,
  CASE WHEN fast THEN 'Sub' WHEN level = 0 THEN 'NoFilter' WHEN level <= 7 THEN 'Sub' ELSE 'Adaptive' END AS filter FROM l""")
def png_settings(spark, sf_dir):
    rows = _parts(spark, sf_dir).select("p_partkey", (c("p_size") % 10).alias("level"), (c("p_partkey") % 2 == 0).alias("fast"))
    return rows.withColumn("p", fm.png_settings(c("level"), c("fast"))).select("p_partkey", "level", "fast", "p.compression", "p.filter")


_PRESETS_SQL = """v AS (SELECT * FROM (VALUES
  (0, 'FastLossless', '极速无损', '零画质损失，最快速度优先，优化无损编码', 100, 1, True, 'Original'),
  (1, 'Balanced', '智能均衡', '推荐！画质与体积的最佳平衡，肉眼几乎无法分辨', 82, 3, True, 'Max2560'),
  (2, 'MaxSaving', '极限压缩', '体积大幅缩小 70%~90%，适合对大小要求严苛的场景', 65, 7, False, 'Max1920'),
  (3, 'Custom', '自定义', '完全自由配置质量、格式、尺寸与压缩算法', 80, 3, True, 'Original')) AS v(n, preset, name, hint, quality, png_level, fast, downscale))"""
_PRESET_IDS = ("FastLossless", "Balanced", "MaxSaving", "Custom")


@query(f"WITH {_K}, {_PRESETS_SQL} SELECT p_partkey, preset, name, hint, quality, png_level, fast, downscale FROM k JOIN v ON n = p_partkey % 4")
def compress_presets(spark, sf_dir):
    preset = c("preset")
    (name, hint), values = O.preset_texts(preset), O.preset_values(preset)
    return _parts(spark, sf_dir).select("p_partkey", _drawn(_PRESET_IDS, c("p_partkey")).alias("preset")).select("p_partkey", "preset", name.alias("name"), hint.alias("hint"), *[v.alias(n) for v, n in zip(values, ("quality", "png_level", "fast", "downscale"), strict=True)])


@query(f"WITH {_K}, {_PRESETS_SQL} SELECT p_partkey, preset, CASE preset WHEN 'Custom' THEN p_size * 2 ELSE quality END AS quality, CASE preset WHEN 'Custom' THEN p_size % 10 ELSE png_level END AS png_level, CASE preset WHEN 'Custom' THEN p_size % 2 = 1 ELSE fast END AS fast, CASE preset WHEN 'Custom' THEN 'Scale50' ELSE downscale END AS downscale FROM k JOIN v ON n = p_partkey % 4")
def applied_presets(spark, sf_dir):
    rows = _parts(spark, sf_dir).select("p_partkey", "p_size", _drawn(_PRESET_IDS, c("p_partkey")).alias("preset"))
    values = O.apply_preset(c("preset"), c("p_size") * 2, c("p_size") % 10, c("p_size") % 2 == 1, F.lit("Scale50"))
    return rows.select("p_partkey", "preset", *[v.alias(n) for v, n in zip(values, ("quality", "png_level", "fast", "downscale"), strict=True)])


@query(f"WITH {_K} SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE p_size END AS quality, CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN p_partkey % 5 >= 2 THEN p_size % 10 ELSE 1 END AS png_level, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE p_partkey % 5 <> 3 END AS fast FROM k")
def option_defaults(spark, sf_dir):
    """Stored encoding options of several ages: what they leave out has its default, what isn't JSON has none."""
    n, size = c("p_partkey") % 5, c("p_size").cast("string")
    level = F.concat(F.lit(', "png_compression_level": '), (c("p_size") % 10).cast("string"))
    body = F.concat(F.lit('{"quality": '), size, F.when(n >= 2, level).otherwise(""), F.when(n == 3, ', "png_fast_mode": false').otherwise(""), F.when(n == 4, "").otherwise("}"))
    rows = _parts(spark, sf_dir).select("p_partkey", F.when(n == 4, "{").otherwise(body).alias("text")).withColumn("o", O.encode_options(c("text")))
    return rows.select("p_partkey", c("o.quality").alias("quality"), c("o.png_compression_level").alias("png_level"), c("o.png_fast_mode").alias("fast"))


@query(f"WITH {_K} SELECT p_partkey, p_size - 20 AS cpus, least(greatest(p_size - 20, 1), 8)::INT AS workers FROM k")
def worker_defaults(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", (c("p_size") - 20).alias("cpus")).withColumn("workers", O.default_workers(c("cpus")))


_STRATEGIES = ("KeepOriginal", "Webp", "Jpeg")


@query(f"WITH {FORMATS_SQL}, {_K} SELECT p_partkey, id, {_drawn_sql(_STRATEGIES, 'twelfth')} AS strategy, CASE {_drawn_sql(_STRATEGIES, 'twelfth')} WHEN 'Webp' THEN 'webp' WHEN 'Jpeg' THEN 'jpeg' ELSE CASE WHEN registry_no IS NOT NULL AND id <> 'svg' THEN id ELSE 'png' END END AS target FROM k JOIN f ON enum_no = p_partkey % 12")
def compress_targets(spark, sf_dir):
    rows = _parts(spark, sf_dir).select("p_partkey", _drawn(_FORMAT_IDS, c("p_partkey")).alias("id"), _drawn(_STRATEGIES, c("twelfth")).alias("strategy"))
    return rows.withColumn("target", S.compress_target(c("strategy"), c("id"), fm.REGISTRY))


@query(f"WITH {FORMATS_SQL}, {_K} SELECT p_partkey, id, CASE WHEN id IN ('png', 'qoi') THEN id ELSE 'png' END AS target FROM k JOIN f ON enum_no = p_partkey % 12")
def effective_targets(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", _drawn(_FORMAT_IDS, c("p_partkey")).alias("id")).withColumn("target", fm.effective_target(c("id"), ("png", "qoi")))


@query("SELECT p_partkey, least(greatest(p_size * 3 - 20, 1), 64)::INT AS workers, least(greatest(p_size * 4 - 30, 1), 100)::INT AS quality, least(p_size, 9)::INT AS level, CASE WHEN p_size % 5 = 0 THEN NULL ELSE least(p_size * 997, 20000) || 'x' || least(p_size * 13, 20000) END AS resize FROM part")
def config_ranges(spark, sf_dir):
    size = O.resize(c("p_size") * 997, F.when(c("p_size") % 5 == 0, 0).otherwise(c("p_size") * 13))
    rows = _parts(spark, sf_dir).withColumn("size", size)
    return rows.select("p_partkey", O.workers(c("p_size") * 3 - 20).alias("workers"), O.quality(c("p_size") * 4 - 30).alias("quality"), O.png_level(c("p_size")).alias("level"), F.concat(c("size.width").cast("string"), F.lit("x"), c("size.height").cast("string")).alias("resize"))


_LEVELS = ("OFF", "Error", "warn", "INFO", "debug", "Trace", "loud", "")


@query(f"WITH {_K}, w AS (SELECT p_partkey, {_drawn_sql(_LEVELS)} AS word FROM k) SELECT p_partkey, word, CASE WHEN lower(word) IN ('off', 'error', 'warn', 'info', 'debug', 'trace') THEN lower(word) ELSE 'warn' END AS level FROM w")
def log_levels(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", _drawn(_LEVELS, c("p_partkey")).alias("word")).withColumn("level", S.log_level(c("word")))


@query(f"WITH {_K}, v AS (SELECT * FROM (VALUES (0, ' Batch ', 'batch'), (1, 'HISTORY', 'history'), (2, '压缩', 'compress'), (3, '设 置', NULL), (4, '', NULL)) AS v(n, word, view)) SELECT p_partkey, word, view FROM k JOIN v ON n = p_partkey % 5")
def view_lookup(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", _drawn((" Batch ", "HISTORY", "压缩", "设 置", ""), c("p_partkey")).alias("word")).withColumn("view", S.view_of(c("word")))


@query(f"""WITH {_K}, o AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size END AS w, p_size + 1 AS h, p_partkey % 2 = 0 AS nearest, p_size % 5 = 0 AS gray, p_size % 7 = 0 AS hor, p_partkey % 11 = 0 AS ver, p_partkey % 4 AS r, twelfth % 5 AS col FROM k)
SELECT p_partkey, w IS NULL AND NOT gray AND NOT hor AND NOT ver AND r = 0 AND col = 4 AS identity, CASE WHEN w IS NULL AND NOT gray AND NOT hor AND NOT ver AND r = 0 AND col = 4 THEN '无变换' ELSE array_to_string(list_filter([
  CASE WHEN w IS NOT NULL THEN '缩放至 ' || w || '×' || h || '(' || CASE WHEN nearest THEN '最近邻' ELSE '双线性' END || ')' END, CASE WHEN gray THEN '灰度' END, CASE WHEN hor THEN '水平镜像' END, CASE WHEN ver THEN '垂直镜像' END,
  CASE r WHEN 1 THEN '顺时针 90°' WHEN 2 THEN '顺时针 180°' WHEN 3 THEN '顺时针 270°' END, '颜色模式 ' || CASE col WHEN 0 THEN '灰度' WHEN 1 THEN '灰度+透明' WHEN 2 THEN '真彩色' WHEN 3 THEN '真彩色+透明' END], lambda x: x IS NOT NULL), '、') END AS summary FROM o""")
def transform_summaries(spark, sf_dir):
    k, size = c("p_partkey"), c("p_size")
    to = F.when(size % 3 == 0, F.struct(size.alias("width"), (size + 1).alias("height")))
    steps = (size % 5 == 0, size % 7 == 0, k % 11 == 0, _drawn(("None", "Deg90", "Deg180", "Deg270"), k), F.when(c("twelfth") % 5 != 4, _drawn((*_COLORS, ""), c("twelfth"))))
    return _parts(spark, sf_dir).select("p_partkey", O.is_identity(to, *steps).alias("identity"), O.transform_summary(to, F.when(k % 2 == 0, "Nearest").otherwise("Bilinear"), *steps).alias("summary"))


_TEXTS_SQL = """v AS (SELECT * FROM (VALUES
  (0, 'UnknownFormat', '无法识别的文件格式', false),
  (1, 'UnsupportedFormat', '不支持的格式:', true),
  (2, 'Corrupt', '数据损坏:', true),
  (3, 'UnsupportedFeature', '暂不支持的特性:', true),
  (4, 'InvalidPath', '路径无效:', true),
  (5, 'Io', '文件读写失败:', true),
  (6, 'Config', '配置错误:', true),
  (7, 'Serialize', '数据序列化失败:', true)) AS v(n, kind, head, told))"""


@query(f"WITH {_K}, {_TEXTS_SQL} SELECT p_partkey, kind, head || CASE WHEN told THEN p_name ELSE '' END AS message FROM k JOIN v ON n = p_partkey % 8")
def error_texts(spark, sf_dir):
    rows = _parts(spark, sf_dir).select("p_partkey", "p_name", _drawn(("UnknownFormat", "UnsupportedFormat", "Corrupt", "UnsupportedFeature", "InvalidPath", "Io", "Config", "Serialize"), c("p_partkey")).alias("kind"))
    return rows.select("p_partkey", "kind", S.error_text(c("kind"), c("p_name")).alias("message"))


_LIMITS = ("Original", "Max1920", "Max2560", "Scale75", "Scale50", "CustomMax")


@query("""WITH l AS (SELECT unnest(['Original', 'Max1920', 'Max2560', 'Scale75', 'Scale50', 'CustomMax']) AS kind),
s AS (SELECT p_partkey, kind, (p_partkey * 37 % 5000)::BIGINT AS w, (p_size * 97)::BIGINT AS h FROM part, l),
r AS (SELECT *, CASE kind WHEN 'Scale75' THEN 0.75::DOUBLE WHEN 'Scale50' THEN 0.5::DOUBLE WHEN 'Original' THEN NULL ELSE CASE WHEN greatest(w, h) > CASE kind WHEN 'Max1920' THEN 1920 WHEN 'Max2560' THEN 2560 ELSE 420 END THEN (CASE kind WHEN 'Max1920' THEN 1920 WHEN 'Max2560' THEN 2560 ELSE 420 END)::DOUBLE / greatest(w, h)::DOUBLE END END AS ratio FROM s)
SELECT p_partkey, kind, w, h, CASE WHEN w = 0 OR h = 0 OR ratio IS NULL THEN w ELSE greatest(round(w::DOUBLE * ratio), 1)::BIGINT END AS to_w, CASE WHEN w = 0 OR h = 0 OR ratio IS NULL THEN h ELSE greatest(round(h::DOUBLE * ratio), 1)::BIGINT END AS to_h FROM r""")
def downscaled_sizes(spark, sf_dir):
    rows = T.table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*[F.lit(x) for x in _LIMITS])).alias("kind"), (c("p_partkey") * 37 % 5000).alias("w"), (c("p_size") * 97).cast("long").alias("h"))
    to = F.when(c("kind") == "CustomMax", S.preview_size(c("w"), c("h"))).otherwise(S.target_size(c("kind"), F.lit(1), c("w"), c("h")))
    return rows.withColumn("to", to).select("p_partkey", "kind", "w", "h", c("to.width").alias("to_w"), c("to.height").alias("to_h"))


@query("SELECT p_partkey, CASE WHEN w IS NULL OR w = 0 OR w = 32768 AND h = 20 THEN 'keep' WHEN w * h > 1073741824 THEN 'too_large' ELSE 'resize' END AS action FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 32768 END::BIGINT AS w, CASE p_size % 3 WHEN 0 THEN 20 WHEN 1 THEN 32768 ELSE 32769 END::BIGINT AS h FROM part)")
def resize_guards(spark, sf_dir):
    w = F.when(c("p_size") % 4 == 0, None).when(c("p_size") % 4 == 1, 0).otherwise(32768).cast("long")
    h = F.when(c("p_size") % 3 == 0, 20).when(c("p_size") % 3 == 1, 32768).otherwise(32769).cast("long")
    return T.table(spark, sf_dir, "part").select("p_partkey", S.resize_guard(F.lit(32768), F.lit(20), w, h).alias("action"))


@query(f"""WITH {FORMATS_SQL}, s AS (SELECT DISTINCT p_size * 10 AS w, 100 AS h FROM part UNION SELECT 65535, 1 UNION SELECT 1, 65536)
SELECT id, w::INT AS w, h::INT AS h, CASE WHEN NOT implemented THEN '暂不支持的特性:' || name || '的编解码功能尚未实现,请选择其它目标格式' WHEN id = 'ico' AND greatest(w, h) > 256 THEN '暂不支持的特性:ICO 图标最大支持 256×256,当前图像为 ' || w || '×' || h || ',请先设置缩放'
  WHEN id = 'gif' AND greatest(w, h) > 65535 THEN '暂不支持的特性:GIF 图像最大支持 65535×65535,当前图像为 ' || w || '×' || h || ',请先设置缩放' END AS error FROM f, s""")
def preflight_checks(spark, sf_dir):
    sizes = T.table(spark, sf_dir, "part").select((c("p_size") * 10).alias("w"), F.lit(100).alias("h")).distinct().unionByName(spark.createDataFrame([(65535, 1), (1, 65536)], "w int, h int"))
    rows = sizes.withColumn("id", F.explode(F.array(*[F.lit(x.id) for x in fm.FORMATS])))
    kind, detail = S.preflight(c("id"), c("w"), c("h"))
    return rows.select("id", "w", "h", S.error_text(kind, detail).alias("error"))


# pixels ------------------------------------------------------------------------


def _placed(x: str, y: str, w: str = "w", h: str = "h") -> str:
    return f"WITH {T.RASTER} SELECT asset_id, ({y})::INT AS y, ({x})::INT AS x, c0 FROM px"


def _flat(px: DataFrame) -> DataFrame:
    return px.select("asset_id", c("y").cast("int").alias("y"), c("x").cast("int").alias("x"), "c0")


@query(_placed("h - 1 - y", "x"))
def rotate_90(spark, sf_dir):
    return _flat(P.rotate(T.raster(spark, sf_dir), "Deg90"))


@query(_placed("w - 1 - x", "h - 1 - y"))
def rotate_180(spark, sf_dir):
    return _flat(P.rotate(T.raster(spark, sf_dir), "Deg180"))


@query(_placed("y", "w - 1 - x"))
def rotate_270(spark, sf_dir):
    return _flat(P.rotate(T.raster(spark, sf_dir), "Deg270"))


@query(_placed("w - 1 - x", "y"))
def flip_horizontal(spark, sf_dir):
    return _flat(P.flip_horizontal(T.raster(spark, sf_dir)))


@query(_placed("x", "h - 1 - y"))
def flip_vertical(spark, sf_dir):
    return _flat(P.flip_vertical(T.raster(spark, sf_dir)))


@query(f"WITH {T.RASTER} SELECT asset_id, ty::INT AS y, tx::INT AS x, c0 FROM px, range(5) AS a(ty), range(11) AS b(tx) WHERE y = (ty * 2 + 1) * 8 // 10 AND x = (tx * 2 + 1) * 8 // 22")
def resize_nearest(spark, sf_dir):
    return _flat(P.resize_nearest(T.raster(spark, sf_dir), 11, 5))


@query(f"WITH {T.RASTER} SELECT asset_id, ((h - 1 - x) // 2)::INT AS y, ((w - 1 - (h - 1 - y)) // 2)::INT AS x, c0 FROM px WHERE (h - 1 - x) % 2 = 1 AND (w - 1 - (h - 1 - y)) % 2 = 1")
def transform_order(spark, sf_dir):
    px = P.flip_vertical(P.flip_horizontal(P.rotate(T.raster(spark, sf_dir), "Deg90")))
    return _flat(P.resize_nearest(px, 4, 4))


@query(f"WITH {T.RASTER}, m AS (SELECT asset_id, w - 1 - x AS x, h - 1 - y AS y, c0 FROM (SELECT asset_id, y AS x, w - 1 - x AS y, w, h, c0 FROM px)) SELECT asset_id, ty::INT AS y, tx::INT AS x, c0 FROM m, range(5) AS a(ty), range(11) AS b(tx) WHERE y = (ty * 2 + 1) * 8 // 10 AND x = (tx * 2 + 1) * 8 // 22")
def fused_transform(spark, sf_dir):
    """Rotation by 270 degrees, both flips and resizing as one projection."""
    return _flat(P.placed(T.raster(spark, sf_dir), "Deg270", True, True, 11, 5))


@query(f"WITH {T.GRADIENT} SELECT asset_id, w, h, y::INT AS y, x::INT AS x, c0, c1, c2 FROM g")
def gradient_pixels(spark, sf_dir):
    return P.gradient(T.sizes(spark, sf_dir))


@query(f"WITH {T.GRADIENT} SELECT asset_id, w, h, y::INT AS y, x::INT AS x, CAST((2126 * c0 + 7152 * c1 + 722 * c2) // 10000 AS INT) AS c0 FROM g")
def grayscale_pixels(spark, sf_dir):
    return P.grayscale(P.gradient(T.sizes(spark, sf_dir)))


@query(f"WITH {T.GRADIENT} SELECT asset_id, w, h, y::INT AS y, x::INT AS x, CAST((2126 * c0 + 7152 * c1 + 722 * c2) // 10000 AS INT) AS c0, 255 AS c1 FROM g")
def color_layouts(spark, sf_dir):
    px = P.to_color(P.gradient(T.sizes(spark, sf_dir)), "Rgb8", "Rgba8")
    return P.to_color(px, "Rgba8", "GrayAlpha8")


# the three above over every part


@query(f"WITH {T.RASTER} SELECT asset_id, bool_or(c0 <> 0 AND c0 <> 255) AS semi_transparent FROM (SELECT asset_id, CASE WHEN asset_id % 3 = 0 THEN CASE WHEN c0 > 127 THEN 255 ELSE 0 END ELSE c0 END AS c0 FROM px) GROUP BY asset_id")
def semi_transparent(spark, sf_dir):
    px = T.raster(spark, sf_dir).withColumn("c0", F.when(c("asset_id") % 3 == 0, F.when(c("c0") > 127, 255).otherwise(0)).otherwise(c("c0")))
    return P.semi_transparent(px, "c0")


@query(f"WITH {T.RASTER} SELECT asset_id, y::INT AS y, x::INT AS x, (CASE WHEN c0 = 0 THEN 0 ELSE (c0 // 2 * 255 + c0 // 2) // c0 END)::INT AS c0, ((c0 * 257 - 60 + 128) // 257)::INT AS c1 FROM px")
def straight_alpha(spark, sf_dir):
    px = T.raster(spark, sf_dir).withColumns({"c3": c("c0"), "c0": F.floor(c("c0") / 2).cast("int"), "c1": F.lit(0), "c2": F.lit(0)})
    out = P.unpremultiply(px)
    return out.select("asset_id", "y", "x", "c0", P.demote(c("c3") * 257 - 60).alias("c1"))


@query(f"WITH {T.RASTER} SELECT a.asset_id, sum(abs(a.c0 - b.c0))::DOUBLE / 1 / count(*) AS mean_error FROM px a JOIN px b ON a.asset_id = b.asset_id AND a.y = b.y AND a.x = b.w - 1 - b.x GROUP BY a.asset_id")
def mean_channel_error(spark, sf_dir):
    px = T.raster(spark, sf_dir)
    return P.mean_error(px, P.flip_horizontal(px))


def _smooth_sql(source: str, channels: str = "c0") -> str:
    """Smooth resizing in one step over both axes: exact fractions of whole numbers, rounded half up."""
    weight = lambda at, size, t, to: f"(2 * greatest({size}, {to}) - abs((2 * {at} + 1) * {to} - (2 * {t} + 1) * {size}))"
    wy, wx = weight("y", "h", "ty", "th"), weight("x", "w", "tx", "tw")
    values = ", ".join(f"((2 * sum({c} * wy * wx) + sum(wy * wx)) // (2 * sum(wy * wx)))::INT AS {c}" for c in channels.split())
    return f"""z AS (SELECT *, {wy} AS wy, {wx} AS wx FROM {source}, LATERAL (SELECT unnest(range(th)) AS ty) AS a, LATERAL (SELECT unnest(range(tw)) AS tx) AS b)
SELECT asset_id, tw::INT AS w, th::INT AS h, ty::INT AS y, tx::INT AS x, {values} FROM z WHERE wy > 0 AND wx > 0 GROUP BY asset_id, tw, th, ty, tx"""


@query(f"WITH {T.RASTER}, t AS (SELECT *, 5 AS tw, 3 AS th FROM px), {_smooth_sql('t')}")
def resize_bilinear(spark, sf_dir):
    return P.resize_bilinear(T.raster(spark, sf_dir), 5, 3)


@query(f"WITH {T.RASTER}, t AS (SELECT *, 16 AS tw, 32 AS th FROM px), {_smooth_sql('t')}")
def resize_bilinear_up(spark, sf_dir):
    return P.resize_bilinear(T.raster(spark, sf_dir), 16, 32)


@query(f"""WITH {T.GRADIENT}, t AS (SELECT *, CASE WHEN asset_id % 2 = 0 THEN 0.75::DOUBLE ELSE least(1, 16::DOUBLE / greatest(w, h)::DOUBLE) END AS k FROM g),
u AS (SELECT *, greatest(round(w::DOUBLE * k), 1)::BIGINT AS tw, greatest(round(h::DOUBLE * k), 1)::BIGINT AS th FROM t), {_smooth_sql('u', 'c0 c1 c2')}""")
def downscaled_pixels(spark, sf_dir):
    """Every gradient made smaller: to three quarters, or to a longest side of 16."""
    return P.downscale(P.gradient(T.sizes(spark, sf_dir)), F.when(c("asset_id") % 2 == 0, "Scale75").otherwise("CustomMax"), F.lit(16))


# raw files ---------------------------------------------------------------------

_RAW_KINDS = ("bmp", "netpbm", "farbfeld")


def _raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gradient as a file, the formats taking turns."""
    kind = F.element_at(F.array(*[F.lit(k) for k in _RAW_KINDS]), (c("asset_id") % 3 + 1).cast("int"))
    return rawfiles.encoded(P.gradient(T.sizes(spark, sf_dir)), kind).withColumn("kind", kind)


_LE = lambda v, n: "".join(f" || printf('%02X', ({v}) // {256**i} % 256)" for i in range(n))[4:]
_BMP_SIZE = "(w * 3 + (4 - w * 3 % 4) % 4) * h"


@query(f"""WITH {T.GRADIENT}, l AS (SELECT asset_id, w, h, y, string_agg(printf('%02X%02X%02X', c2, c1, c0), '' ORDER BY x) || repeat('00', (4 - w * 3 % 4) % 4) AS bmp,
  string_agg(printf('%02X%02X%02X', c0, c1, c2), '' ORDER BY x) AS netpbm, string_agg(printf('%02X%02X%02X%02X%02X%02XFFFF', c0, c0, c1, c1, c2, c2), '' ORDER BY x) AS farbfeld FROM g GROUP BY asset_id, w, h, y),
f AS (SELECT asset_id, w, h, string_agg(bmp, '' ORDER BY y DESC) AS bmp, string_agg(netpbm, '' ORDER BY y) AS netpbm, string_agg(farbfeld, '' ORDER BY y) AS farbfeld FROM l GROUP BY asset_id, w, h),
e AS (SELECT asset_id, CASE asset_id % 3 WHEN 0 THEN '424D' || {_LE(f'{_BMP_SIZE} + 54', 4)} || '000000003600000028000000' || {_LE('w', 4)} || {_LE('h', 4)} || '0100180000000000' || {_LE(_BMP_SIZE, 4)} || '130B0000130B00000000000000000000' || bmp
  WHEN 1 THEN hex('P6' || chr(10) || w || ' ' || h || chr(10) || '255' || chr(10)) || netpbm ELSE '6661726266656C64' || printf('%08X%08X', w, h) || farbfeld END AS content FROM f)
SELECT asset_id, (length(content) // 2)::BIGINT AS bytes, md5(content) AS digest FROM e""")
def raw_files(spark, sf_dir):
    return _raw_files(spark, sf_dir).select("asset_id", F.length("content").cast("long").alias("bytes"), F.md5(F.hex("content")).alias("digest"))


@query(f"WITH {T.GRADIENT} SELECT asset_id, ['bmp', 'netpbm', 'farbfeld'][1 + (asset_id % 3)::INT] AS kind, w, h, y::INT AS y, x::INT AS x, c0, c1, c2, CASE WHEN asset_id % 3 = 2 THEN 255 END AS c3 FROM g")
def raw_pixels(spark, sf_dir):
    """Every gradient's file decoded again by byte offsets."""
    return rawfiles.pixels(_raw_files(spark, sf_dir))


# sniffing and codecs -----------------------------------------------------------

#: The first 1024 bytes must be whole characters: no byte that continues one comes next.
_SVG = "(strlen(html) <= 1024 OR substr(hex(html), 2049, 1) NOT IN ('8', '9', 'A', 'B')) AND (starts_with(ltrim(html), '<svg') OR starts_with(ltrim(html), '<?xml') AND contains(left(html, 1024), '<svg'))"
_MARKS = f"CASE WHEN {_SVG} THEN 'svg' WHEN starts_with(html, 'BM') THEN 'bmp' WHEN starts_with(html, 'GIF89a') THEN 'gif' WHEN starts_with(html, 'qoif') THEN 'qoi' WHEN starts_with(html, 'farbfeld') THEN 'farbfeld' WHEN starts_with(html, 'P6') THEN 'netpbm' WHEN starts_with(html, 'RIFF') AND substring(html, 9, 4) = 'WEBP' THEN 'webp' END"
_HEADS = ("", "  <svg x>", "<?xml?><svg>", "<?xml?>", "BM", "GIF89a", "qoif", "farbfeld", "P6", "RIFFxxxxWEBP", "RIFFxxxxWAVE")


@query(f"WITH p AS (SELECT page_id, {list(_HEADS)}[1 + (page_id % {len(_HEADS)})::INT] || html AS html FROM pages) SELECT page_id, {_MARKS} AS format, CASE WHEN {_MARKS} IN ('svg', 'bmp') THEN {_MARKS} END AS enabled FROM p")
def sniffed_formats(spark, sf_dir):
    head = F.element_at(F.array(*[F.lit(x) for x in _HEADS]), (c("page_id") % len(_HEADS) + 1).cast("int"))
    p = T.table(spark, sf_dir, "pages").select("page_id", F.concat(head, F.col("html")).cast("binary").alias("content"))
    return p.select("page_id", sniff.detect(c("content"), packed=False).alias("format"), sniff.detect(c("content"), ("svg", "bmp"), packed=False).alias("enabled"))


def _page_files(spark: SparkSession, sf_dir: str) -> str:
    """Every page written as a file, its first bytes taking turns; the folder."""
    import uuid

    from ..sources import assets
    from ..sources.shared import shared_folder

    folder = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    head = F.element_at(F.array(*[F.lit(x) for x in _HEADS]), (c("page_id") % len(_HEADS) + 1).cast("int"))
    name = F.format_string(f"{folder}/%d/%d.bin", c("page_id") % 7, c("page_id"))
    failed = assets.write(T.table(spark, sf_dir, "pages").select(name.alias("path"), F.concat(head, c("html")).cast("binary").alias("content"))).where("error_kind IS NOT NULL")
    if not failed.isEmpty():
        raise OSError(failed.first()["error_message"])
    return folder


def _page_of() -> Column:
    return F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("long").alias("page_id")


@query(f"WITH p AS (SELECT page_id, {list(_HEADS)}[1 + (page_id % {len(_HEADS)})::INT] || html AS html FROM pages) SELECT page_id, strlen(html)::BIGINT AS length, md5(substr(hex(html), 1, 2048)) AS head, md5(html) AS body FROM p")
def written_files(spark, sf_dir):
    """Every page written through the data source, all or none, and read again."""
    from ..sources import assets

    rows = assets.scan(spark, _page_files(spark, sf_dir), "path string, length long, head binary, content binary", partition_bytes=16 << 20)
    return rows.select(_page_of(), "length", F.md5(F.hex("head")).alias("head"), F.md5("content").alias("body"))


@query(f"WITH p AS (SELECT page_id, {list(_HEADS)}[1 + (page_id % {len(_HEADS)})::INT] || html AS html FROM pages) SELECT page_id, strlen(html)::BIGINT AS length, {_MARKS} AS format FROM p WHERE strlen(html) > 3000")
def ranged_formats(spark, sf_dir):
    """Detection over files of which the first 1024 bytes alone are read; the condition on length is settled on the listing."""
    from ..sources import assets

    rows = assets.scan(spark, _page_files(spark, sf_dir)).where("length > 3000")
    return rows.select(_page_of(), "length", sniff.detect(c("head"), packed=False).alias("format"))


@query(f"WITH p AS (SELECT page_id, {list(_HEADS[:4])}[1 + (page_id % 4)::INT] || html AS html FROM pages) SELECT page_id, {_SVG} AS svg FROM p")
def svg_in_pages(spark, sf_dir):
    head = F.element_at(F.array(*[F.lit(x) for x in _HEADS[:4]]), (c("page_id") % 4 + 1).cast("int"))
    return T.table(spark, sf_dir, "pages").select("page_id", sniff.is_svg(F.concat(head, F.col("html")).cast("binary")).alias("svg"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding rasters as encoded files, their formats taking turns."""
    import pandas as pd

    from ..sources import codecs

    def run(batches):
        import numpy as np

        for t in batches:
            rows = []
            for i, v in zip(t["vec_id"], t["embedding"], strict=True):
                name = fm.REGISTRY[i % len(fm.REGISTRY)]
                image = np.clip(np.floor((np.asarray(v, float) + 1) * 127.5), 0, 255).astype(np.uint8).reshape(8, 8, 1)
                rows.append((f"/in/{i}.{fm.BY_ID[name].primary}", codecs.encode(image, name)))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return T.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "path string, content binary")


@query("SELECT count(*) AS n, 0::BIGINT AS failed, count(DISTINCT vec_id % 11) AS formats, count(*) AS named FROM embeddings")
def convert_files(spark, sf_dir):
    """Decode, transform, check, encode and name; every raster of every format succeeds."""
    from . import convert

    rows = convert.coded(_images(spark, sf_dir), ConvertOptions("png", "/out", transform=TransformOptions(resize=(16, 4), rotate="Deg90", grayscale=True)))
    done = convert.planned(rows, ConvertOptions("png", "/out"), spark.createDataFrame([], "path string"), F.lit("2024-01-01").cast("timestamp"))
    return done.agg(F.count("*").alias("n"), F.count_if(c("error_kind").isNotNull()).alias("failed"), F.countDistinct("source_format").alias("formats"), F.countDistinct("output").alias("named"))


_RAW = "CASE target_format WHEN 'bmp' THEN 102 WHEN 'netpbm' THEN 27 WHEN 'farbfeld' THEN 144 END"


@query(f"""WITH f AS (SELECT vec_id, 1 + (vec_id % 11)::INT AS k FROM embeddings),
g AS (SELECT vec_id, ['bmp', 'netpbm', 'png', 'gif', 'webp', 'qoi', 'farbfeld', 'ico', 'jpeg', 'svg', 'tga'][k] AS source_format, ['bmp', 'netpbm', 'png', 'gif', 'webp', 'qoi', 'farbfeld', 'ico', 'jpeg', 'png', 'tga'][k] AS target_format,
  ['bmp', 'ppm', 'png', 'gif', 'webp', 'qoi', 'ff', 'ico', 'jpg', 'svg', 'tga'][k] AS e, ['bmp', 'pgm', 'png', 'gif', 'webp', 'qoi', 'ff', 'ico', 'jpg', 'png', 'tga'][k] AS o FROM f)
SELECT '/in/' || vec_id || '.' || e AS input, '/out/' || vec_id || '_converted.' || o AS output, source_format, target_format, 4::BIGINT AS width, 4::BIGINT AS height, true AS sized, {_RAW}::BIGINT AS raw_bytes, source_format = target_format AS same_note, true AS saved_note FROM g""")
def compress_files(spark, sf_dir):
    """Sizes that no encoder may choose are compared as they are; of the others, that the notes follow from them."""
    from . import convert

    options = CompressOptions(downscale=Downscale("Scale50"), output_dir="/out")
    done = convert.planned(convert.coded(_images(spark, sf_dir), options), options, spark.createDataFrame([], "path string"), F.lit("2024-01-01").cast("timestamp"))
    saved = F.exists("notes", lambda n: n.startswith("压缩已节省 "))
    return done.select(
        "input", "output", "source_format", "target_format", "width", "height", ((c("source_bytes") > 0) & (c("output_bytes") == F.octet_length("encoded")) & c("error_kind").isNull()).alias("sized"),
        F.when(c("target_format").isin("bmp", "netpbm", "farbfeld"), c("output_bytes")).alias("raw_bytes"), F.array_contains("notes", "源格式与目标格式相同,文件已被重新编码").alias("same_note"), (saved == (c("output_bytes") < c("source_bytes"))).alias("saved_note"),
    )


@query("SELECT vec_id, ['bmp', 'netpbm', 'png', 'gif', 'webp', 'qoi', 'farbfeld', 'ico', 'jpeg', 'svg', 'tga'][1 + (vec_id % 11)::INT] AS format, CASE WHEN vec_id % 11 = 10 THEN NULL ELSE ['bmp', 'netpbm', 'png', 'gif', 'webp', 'qoi', 'farbfeld', 'ico', 'jpeg', 'svg', 'tga'][1 + (vec_id % 11)::INT] END AS detected FROM embeddings")
def detect_encoded(spark, sf_dir):
    p = _images(spark, sf_dir).select(F.regexp_extract("path", r"(\d+)\.", 1).cast("long").alias("vec_id"), fm.from_extension(S.extension_of(c("path"))).alias("format"), "content")
    return p.select("vec_id", "format", sniff.detect(c("content")).alias("detected"))


@query(f"WITH {T.RASTER} SELECT asset_id AS vec_id, ['bmp', 'netpbm', 'png', 'gif', 'webp', 'qoi', 'farbfeld', 'ico', 'jpeg', 'svg', 'tga'][1 + (asset_id % 11)::INT] AS format, y::INT AS y, x::INT AS x, c0 AS value FROM px")
def decoded_pixels(spark, sf_dir):
    """Every raster encoded and decoded again, pixel by pixel; of the lossy format a value counts as the raster's when it is within 20 of it."""
    import pandas as pd

    from ..sources import codecs

    def run(batches):
        import numpy as np

        for t in batches:
            out = []
            for i, v in zip(t["vec_id"], t["embedding"], strict=True):
                name = fm.REGISTRY[i % len(fm.REGISTRY)]
                image = np.clip(np.floor((np.asarray(v, float) + 1) * 127.5), 0, 255).astype(np.uint8).reshape(8, 8, 1)
                back = codecs.decode_as(codecs.encode(image, name), name).astype(int)
                gray = back[:, :, 0] if (back[:, :, :3].min(axis=2) == back[:, :, :3].max(axis=2)).all() else np.full((8, 8), -1)
                if not fm.BY_ID[name].lossless and name == "jpeg":
                    gray = np.where(np.abs(gray - image[:, :, 0]) <= 20, image[:, :, 0], gray)
                out.append(pd.DataFrame({"vec_id": i, "format": name, "y": np.repeat(np.arange(8), 8), "x": np.tile(np.arange(8), 8), "value": gray.reshape(-1)}))
            yield pd.concat(out)

    return T.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, format string, y int, x int, value int")
