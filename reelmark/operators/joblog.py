"""Job logs: rows from result documents, derived figures, error summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmark.functions import names

# The named errors of each kind; whatever else is counted is another error.
DECODE_ERRORS = ("decode-packet-failed", "h264-pts-mismatch", "h264-unexpected-field")
TIME_ERRORS = ("unknown-pts", "non-continuous-pts")
GLYPH_ERRORS = ("no-drcs-map",)
BUCKETS = ("decode", "time", "glyph", "other")
# What each kind of error is called in a summary.
ERROR_MESSAGES = ("デコードエラー", "時間処理エラー", "DRCSマッピングのない文字", "その他のエラー")

# Names of masks of written outputs, what isn't known, the header of an export.
OUTPUT_TEXTS = {1: "通常", 2: "CMをカット", 3: "通常+CMカット", 4: "CMのみ", 5: "通常+CM", 6: "本編とCMを分離", 7: "通常+本編+CM"}
UNKNOWN = "不明"
CSV_HEADER = (
    "結果 メッセージ 入力ファイル 出力ファイル 出力ファイル数 エンコード開始 エンコード終了 エンコード時間（秒） 入力ファイル時間（秒） 出力ファイル時間（秒） インシデント数 入力ファイルサイズ 中間ファイルサイズ "
    "出力ファイルサイズ 圧縮率（％） 入力音声フレーム 出力音声フレーム ユニーク出力音声フレーム 未出力音声割合(%) 平均音ズレ(ms) 最大音ズレ(ms) 最大音ズレ位置(ms)"
).split()
# The fields of a result document.
RESULT = (
    "srcpath string, outfiles array<struct<path: string, subs: array<string>>>, logofiles array<string>, srcfilesize long, intvideofilesize long, outfilesize long, srcduration double, "
    "outduration double, error map<string, int>, audiodiff struct<totalsrcframes: int, totaloutframes: int, totaloutuniqueframes: int, notincludedper: double, avgdiff: double, maxdiff: double, maxdiffpos: double>, "
    "cmanalyze boolean, nicojk boolean, trimavs boolean"
)


def from_result(results: DataFrame, document: str) -> DataFrame:
    """Log columns read from a result document: output paths each with its subtitles after it, logo files without empty names, and the sum of all error counts."""
    r = F.from_json(document, RESULT)
    paths = F.flatten(F.transform(F.coalesce(F.col("r.outfiles"), F.array()), lambda o: F.concat(F.array(o["path"]), F.coalesce(o["subs"], F.array().cast("array<string>")))))
    return results.withColumn("r", r).select(
        *results.columns,
        paths.alias("out_path"),
        F.filter(F.coalesce("r.logofiles", F.array().cast("array<string>")), lambda x: x != "").alias("logo_files"),
        F.aggregate(F.map_values(F.coalesce("r.error", F.create_map().cast("map<string,int>"))), F.lit(0), lambda t, n: t + n).alias("incident"),
        F.transform(F.map_entries("r.error"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("count"))).alias("error"),
        F.col("r.audiodiff").alias("audio_diff"),
        F.col("r.outfilesize").alias("out_size"),
        F.col("r.srcfilesize").alias("src_size"),
    )


def error_buckets(errors: DataFrame, keys: list[str]) -> DataFrame:
    """errors: keys, name, count. (keys, decode, time, glyph, other): counts by kind, the last what the named kinds leave of the total."""
    of = lambda names: F.sum(F.when(F.col("name").isin(*names), F.col("count")).otherwise(0))
    out = errors.groupBy(*keys).agg(of(DECODE_ERRORS).alias("decode"), of(TIME_ERRORS).alias("time"), of(GLYPH_ERRORS).alias("glyph"), F.sum("count").alias("total"))
    return out.withColumn("other", F.col("total") - F.col("decode") - F.col("time") - F.col("glyph")).drop("total")


def error_summary(counts: list[Column]) -> Column:
    """Names and counts of the kinds that occur, with commas; empty if none does."""
    parts = [F.when(n > 0, F.concat(F.lit(f"{message} "), n.cast("string"), F.lit("件"))) for message, n in zip(ERROR_MESSAGES, counts, strict=True)]
    return F.array_join(F.array_compact(F.array(*parts)), ",")


def result_mark(success: Column, incident: Column) -> Column:
    return F.when(~success, "×").when(incident > 0, "△").otherwise("〇")


def per_cent(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole * 100)


def encode_speed(source_seconds: Column, encode_seconds: Column) -> Column:
    return F.when(encode_seconds > 0, source_seconds / encode_seconds)


def megabits(size: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, size / (seconds * (128 * 1024)))


def mebibytes(size: Column) -> Column:
    return size / 1048576


def output_mask(mask: Column) -> Column:
    """What was written: 1 the whole, 2 without and 4 only the cuts, and their sums; unknown masks read as 1."""
    out = F.lit(OUTPUT_TEXTS[1])
    for value, name in OUTPUT_TEXTS.items():
        out = F.when(mask == value, name).otherwise(out)
    return out


def flag_glyph(flag: Column) -> Column:
    return F.when(flag, "○").otherwise("☓")


def day_text(time: Column) -> Column:
    """Year, month and day without leading zeros; a null time is unknown."""
    return F.coalesce(F.date_format(time, "yyyy年M月d日"), F.lit(UNKNOWN))


def check_text(kind: Column) -> Column:
    return F.when(kind == "CM", "CM解析").when(kind == "DRCS", "DRCSチェック").otherwise(UNKNOWN)


def labelled(log: DataFrame) -> DataFrame:
    """log: src_path, out_path, chapter, nicojk, trim_avs, audio_diff. Adds file columns, the number of outputs, flags and the figures of the sound, null where there are none."""
    c = F.col
    audio = lambda name: c("audio_diff")[name]
    return log.select(
        "*",
        names.directory(c("src_path")).alias("src_dir"),
        names.base_name(c("src_path")).alias("src_name"),
        F.when(F.size("out_path") > 0, names.directory(F.get("out_path", 0))).otherwise("-").alias("out_dir"),
        F.transform("out_path", names.base_name).alias("out_names"),
        F.when(c("out_path").isNull(), "-").otherwise(F.size("out_path").cast("string")).alias("out_num"),
        *[flag_glyph(c(x)).alias(f"{x}_glyph") for x in ("chapter", "nicojk", "trim_avs")],
        audio("totalsrcframes").alias("src_frames"),
        audio("totaloutframes").alias("out_frames"),
        F.round(audio("notincludedper"), 3).alias("sound_not_included"),
        *[F.round(audio(x), 2).alias(y) for x, y in (("avgdiff", "avg_diff"), ("maxdiff", "max_diff"), ("maxdiffpos", "max_diff_pos"))],
    )


def csv_fields(log: DataFrame) -> list[Column]:
    """The 22 fields of an exported row, in the order of CSV_HEADER. log: as in figures() and labelled(), with reason."""
    c = F.col
    gui = lambda x: F.date_format(x, "yyyy/MM/dd HH:mm:ss")
    seconds = (F.unix_micros(c("finish").cast("timestamp")) - F.unix_micros(c("start").cast("timestamp"))) / 1e6
    sound = [F.coalesce(c("audio_diff")[x].cast("string"), F.lit("0")) for x in ("totalsrcframes", "totaloutframes", "totaloutuniqueframes", "notincludedper", "avgdiff", "maxdiff", "maxdiffpos")]
    fields = [
        result_mark(c("success"), c("incident")), F.coalesce("reason", F.lit("")), c("src_path"), F.coalesce(F.array_join("out_path", ":"), F.lit("-")), F.coalesce(F.size("out_path"), F.lit(0)).cast("string"),
        gui("start"), gui("finish"), seconds.cast("string"), c("src_s").cast("string"), c("out_s").cast("string"), c("incident").cast("string"),
        c("src_size").cast("string"), c("int_size").cast("string"), c("out_size").cast("string"), F.format_string("%.2f", per_cent(c("out_size"), c("src_size"))), *sound,
    ]
    return [f.alias(name) for f, name in zip(fields, CSV_HEADER, strict=True)]


def age_text(seconds: Column) -> Column:
    """How long ago in the largest unit that isn't below 1, exact bounds in the smaller one."""
    whole = lambda x: F.floor(x).cast("long").cast("string")
    return (
        F.when(seconds <= 60, F.concat(whole(seconds), F.lit(" s")))
        .when(seconds <= 3600, F.concat(whole(seconds / 60), F.lit(" min")))
        .when(seconds <= 86400, F.concat(whole(seconds / 3600), F.lit(" h")))
        .otherwise(F.concat(whole(seconds / 86400), F.lit(" d")))
    )


def figures(log: DataFrame) -> DataFrame:
    """log: success, incident, start, finish, src_s, out_s, src_size, int_size, out_size, logo_files, output_mask, service_name, service_id, ts_time, tags. Adds the figures that a log list shows."""
    c = F.col
    seconds = (F.unix_micros(c("finish").cast("timestamp")) - F.unix_micros(c("start").cast("timestamp"))) / 1e6
    return log.select(
        "*",
        seconds.alias("encode_s"),
        result_mark(c("success"), c("incident")).alias("result"),
        F.round(per_cent(c("src_s") - c("out_s"), c("src_s")), 2).alias("not_included"),
        F.round(mebibytes(c("src_size")), 2).alias("src_mib"),
        F.round(mebibytes(c("out_size")), 2).alias("out_mib"),
        F.round(per_cent(c("int_size"), c("src_size")), 2).alias("int_rate"),
        F.round(per_cent(c("out_size"), c("src_size")), 2).alias("out_rate"),
        F.round(encode_speed(c("src_s"), seconds), 2).alias("speed"),
        F.round(megabits(c("src_size"), c("src_s")), 3).alias("src_mbps"),
        F.round(megabits(c("out_size"), c("out_s")), 3).alias("out_mbps"),
        F.coalesce(F.try_element_at("logo_files", F.lit(1)), F.lit("なし")).alias("logo"),
        output_mask(c("output_mask")).alias("output"),
        F.concat(c("service_name"), F.lit("("), c("service_id").cast("string"), F.lit(")")).alias("service"),
        day_text(c("ts_time")).alias("recorded"),
        F.array_join("tags", " ").alias("tag_text"),
    )
