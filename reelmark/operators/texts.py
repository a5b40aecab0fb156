"""Structured values out of text: manifests, glyph reports, interval lists, console output, comment logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmark.functions.arrays import bound

DIGEST_CHARS = 128
# The log line of an unmapped glyph, and the line of an interval list.
_GLYPH = r"\[字幕\] 映像時刻([0-9]+)分([0-9]+)秒付近にマッピングのないDRCS外字があります。追加してください -> .*[/\\]([0-9A-F]+)\.bmp"
_SECTION = r"^\s*([0-9]+)\s+(\S)\s+([0-9]+)\s+(\S+)\s+([0-9]+)\s+([0-9]+)"


def manifest_entries(lines: DataFrame, manifest: str, order: str, line: str) -> DataFrame:
    """(manifest, name, digest): lines of 128 hexadecimal digits, two characters and a name. The first line of a name counts.

    A short last line ends the manifest; a short line before it, or one with other digits, is kept with digest null, for the caller to reject.
    """
    # A manifest may hold any part of all lines, so its last line is an aggregate, joined back.
    ends = lines.groupBy(manifest).agg(F.max(order).alias("last_order"))
    text = F.col(line)
    whole = F.length(text) > DIGEST_CHARS + 2
    digest = F.lower(F.substring(text, 1, DIGEST_CHARS))
    rows = lines.join(ends, manifest).filter(whole | (F.col(order) < F.col("last_order")))
    named = rows.select(manifest, order, F.when(whole, F.expr(f"substring({line}, {DIGEST_CHARS + 3})")).otherwise(text).alias("name"), F.when(whole & digest.rlike("^[0-9a-f]+$"), digest).alias("digest"))
    first = named.groupBy(manifest, "name").agg(F.min_by(F.struct("digest"), order).alias("d"))
    return first.select(manifest, "name", "d.digest")


def glyph_reports(logs: DataFrame, path: str, line: str) -> DataFrame:
    """(glyph, path, seconds) for lines of a log that tell of an unmapped glyph."""
    text = F.col(line)
    hits = logs.filter(text.rlike(_GLYPH))
    part = lambda k: F.regexp_extract(text, _GLYPH, k)
    return hits.select(part(3).alias("glyph"), F.col(path).alias("path"), (part(1).cast("long") * 60 + part(2).cast("long")).alias("seconds"))


def glyph_sources(reports: DataFrame) -> DataFrame:
    """(glyph, sources, first_path): how many different places a glyph was reported from."""
    places = reports.select("glyph", "path", "seconds").distinct()
    return places.groupBy("glyph").agg(F.count("*").alias("sources"), F.min("path").alias("first_path"))


def glyph_catalogue(images: DataFrame, mapping: DataFrame, sources: DataFrame) -> DataFrame:
    """(glyph, image, text, sources, unmapped) for every glyph that has an image or a mapping, with what is known of it. images: glyph, image; mapping: glyph, text; sources: glyph, sources."""
    both = images.join(mapping, "glyph", "full_outer").join(sources.select("glyph", "sources"), "glyph", "left")
    return both.select("glyph", "image", "text", F.coalesce("sources", F.lit(0)).alias("sources"), (F.coalesce("text", F.lit("")) == "").alias("unmapped"))


def updated_glyphs(images: DataFrame, reports: DataFrame, update: str, noticed: int) -> DataFrame:
    """(glyph, sources, last_update) of glyphs with an image whose sources changed at the last notice or since. images: glyph; reports: glyph, path, seconds and the number of their update.

    A place counts once, and its first report is what changes its glyph.
    """
    places = reports.groupBy("glyph", "path", "seconds").agg(F.min(update).alias("since"))
    changed = places.groupBy("glyph").agg(F.count("*").alias("sources"), F.max("since").alias("last_update")).filter(F.col("last_update") >= noticed)
    return changed.join(images.select("glyph").distinct(), "glyph", "left_semi")


def section_rows(lines: DataFrame, line: str) -> DataFrame:
    """Adds best, is_start, start and end of lines of an interval list; other lines are left out."""
    part = lambda k: F.regexp_extract(line, _SECTION, k)
    return lines.filter(F.col(line).rlike(_SECTION)).select(
        "*", part(1).cast("long").alias("best"), (F.lower(part(2)) == "s").alias("is_start"), part(5).cast("long").alias("start"), part(6).cast("long").alias("end")
    )


def section_lines(sections: DataFrame) -> DataFrame:
    """(series_id, s_start, part, line): the two lines that an interval is written as."""
    row = lambda kind, best, start, end: F.format_string(f"%6d {kind} 0 ALL %6d %6d", best, start, end)
    both = F.array(row("S", "s_best", "s_start", "s_end"), row("E", "e_best", "e_start", "e_end"))
    return sections.select("series_id", "s_start", F.posexplode(both).alias("part", "line"))


def console_lines(outputs: DataFrame, key: str, text: str, keep: int | None = None) -> DataFrame:
    """(key, number, line): what a console shows of a text: all lines, or those that a rolling one still holds, which drops its first hundred
    when one more comes to more than `keep`.

    A line ends at a line feed, carriage return or backspace; ends without text before them only set how the next one counts: a line that
    follows a carriage return or backspace replaces the one before it.
    """

    def marked(pieces: Column) -> Column:
        # The array is paired with itself moved by one place, so that no element looks its neighbour up in the whole array.
        returned = F.concat(F.array(F.lit(False)), F.transform(pieces, lambda p: F.substring(p, -1, 1).isin("\r", "\b")))
        ends = F.zip_with(pieces, returned, lambda p, r: F.struct(F.translate(F.coalesce(p, F.lit("")), "\n\r\b", "").alias("line"), r.alias("replaces")))
        return F.filter(ends, lambda e: e["line"] != "")

    def surviving(shown: Column) -> Column:
        # A line survives unless the next one replaces it.
        replaced = F.slice(F.transform(shown, lambda e: e["replaces"]), 2, F.greatest(F.size(shown), F.lit(1)))
        both = F.zip_with(shown, replaced, lambda e, r: F.struct(e["line"].alias("line"), F.coalesce(r, F.lit(False)).alias("gone")))
        return F.transform(F.filter(both, lambda e: ~e["gone"]), lambda e: e["line"])

    def held(lines: Column) -> Column:
        gone = F.ceil(F.greatest(F.lit(0), F.size(lines) - (keep + 1)) / 100).cast("int") * 100
        return F.slice(lines, gone + 1, F.greatest(F.size(lines), F.lit(1)))

    lines = bound(bound(F.split(text, "(?<=[\n\r\b])"), marked), surviving)
    return outputs.select(key, F.posexplode(lines if keep is None else bound(lines, held)).alias("number", "line"))


def merged_comments(comments: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """comments: keys, date, thread, no, xml. Those with start <= date < end, numbered by date, thread and no, with line ends written as entities."""
    order = Window.partitionBy(*keys).orderBy("date", "thread", "no", "xml")
    text = F.replace(F.replace("xml", F.lit("\r"), F.lit("&#13;")), F.lit("\n"), F.lit("&#10;"))
    return comments.filter((F.col("date") >= start) & (F.col("date") < end)).select(*keys, F.row_number().over(order).alias("number"), text.alias("line"))
