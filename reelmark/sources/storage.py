"""Readers of folders and logs, and writers of results. Paths are Spark's, so they may lie in any store it reads."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: The folder of sessions without spark.checkpoint.dir, made when first needed.
_temporary: list[str] = []


def _session_folder(spark: SparkSession) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _temporary[:] = _temporary or [tempfile.mkdtemp(prefix="reelmark-")]
        top = _temporary[0]
    return f"{top.rstrip('/')}/reelmark-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Only a local session, as in tests, may lack that setting: it gets a temporary one."""
    return f"{_session_folder(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: it is worked out once, and a lost executor costs no recomputation.

    Such tables lie in one folder of the session. Whoever has written or read a result in full calls forget_stored().
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> bool:
    """A folder or file of any store that Spark writes, taken away; whether there was one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget_stored(spark: SparkSession) -> bool:
    """Takes away all that stored() wrote in this session. Results that still read such tables can't be read any more."""
    return removed(spark, _session_folder(spark))


def folder_files(spark: SparkSession, path: str, suffixes: list[str], prefix: str = "", recursive: bool = False) -> DataFrame:
    """(path, name, length, modified) of files by the ends of their names, compared in lower case, and an optional start. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length", F.col("modificationTime").alias("modified"))
    ends = F.lit(False)
    for suffix in suffixes:
        ends = ends | F.endswith(F.lower("name"), F.lit(suffix))
    return found.filter(ends & F.startswith("name", F.lit(prefix)))


def file_digests(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, length, sha512) of whole files of any size.

    Files are split among tasks at line feeds, as any bytes may be; the pieces come to one task a file in their order, where they stream
    through its digest, which is sequential by nature. Only a stretch of 2 GB without a line feed can't be read; files without contents aren't
    listed by Spark and have no row.
    """
    import hashlib

    options = {"recursiveFileLookup": str(recursive).lower()}
    pieces = spark.read.options(lineSep="\n", **options).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("number"), F.col("value").cast("binary").alias("piece"))
    sizes = spark.read.format("binaryFile").options(**options).load(path).select(_plain_path("path").alias("path"), "length")
    ordered = pieces.withColumn("path", _plain_path("path")).repartition("path").sortWithinPartitions("path", "block", "number")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Whether a file ends with a line feed isn't known here: the digests with and without one both go out, its length tells.
        at, running, length = None, None, 0
        done: list[tuple[str, int, str, str]] = []

        def end() -> None:
            if at is not None:
                ended = running.copy()
                ended.update(b"\n")
                done.append((at, length, running.hexdigest(), ended.hexdigest()))

        for batch in batches:
            for own, piece in zip(batch["path"].to_pylist(), batch["piece"], strict=True):
                data = piece.as_buffer()
                if own != at:
                    end()
                    at, running, length = own, hashlib.sha512(), 0
                else:
                    running.update(b"\n")
                    length += 1
                running.update(data)
                length += data.size
        end()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], ["path", "read", "open_digest", "ended_digest"])

    found = ordered.select("path", "piece").mapInArrow(digest, "path string, read long, open_digest string, ended_digest string")
    own = F.when(F.col("read") == F.col("length"), F.col("open_digest")).when(F.col("read") + 1 == F.col("length"), F.col("ended_digest"))
    return sizes.join(found, "path", "left").select("path", "length", own.alias("sha512"))


def _plain_path(column: str) -> Column:
    """A path written one way: listings and file metadata differ in the slashes behind the scheme and in escapes."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(F.regexp_replace(column, "\\+", "%2B"), "%(?![0-9A-Fa-f]{2})", "%25"), "^file:/+", "file:///"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, number, line): lines of text files in the order of block and number. Files of any size are split among tasks."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("number"), F.col("value").alias("line"))
    return lines.withColumn("line", F.rtrim("line", F.lit("\r")))


def glyph_map(spark: SparkSession, path: str) -> DataFrame:
    """(glyph, text) of lines `32 hexadecimal digits=text`; the first of a glyph counts."""
    lines = text_lines(spark, path).filter(F.col("line").rlike("^[0-9A-Fa-f]{32}="))
    return lines.groupBy(F.substring("line", 1, 32).alias("glyph")).agg(F.min_by(F.expr("substring(line, 34)"), F.struct("path", "block", "number")).alias("text"))


def read_xml_log(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Rows of XML fragments, one element each, whether or not a root stands around them."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def append_xml_log(rows: DataFrame, path: str, row_tag: str) -> None:
    rows.write.format("xml").option("rowTag", row_tag).option("rootTag", "Root").mode("append").save(path)


def write_snapshot(rows: DataFrame, path: str) -> None:
    """Replaces the snapshot at a path in one step once all rows are written; a write that fails leaves the old one.

    Each version is a folder of its own; a small file names the present one and is replaced by renaming another over it. The version
    before stays until the next write, for those who still read it.
    """
    spark = rows.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    before = _present_version(spark, path)
    rows.write.parquet(f"{path}/{version}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    files = at("").getFileSystem(conf)
    out = files.create(at(f"_{version}"))
    out.write(bytearray(version.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at("").toUri(), conf).rename(at(f"_{version}"), at("_present"), over)
    for status in files.listStatus(at("")):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            files.delete(status.getPath(), True)


def _present_version(spark: SparkSession, path: str) -> str | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_present")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return None
    source = files.open(at)
    name = bytes(source.readAllBytes()).decode()
    source.close()
    return name


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The rows that write_snapshot() wrote last."""
    return spark.read.parquet(f"{path}/{_present_version(spark, path)}")


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def first_result(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path): the result file of a folder and all below it, of several the first by its path."""
    return folder_files(spark, path, [suffix], recursive=True).agg(F.min("path").alias("path"))


def existing(spark: SparkSession, candidates: DataFrame, folder: str) -> DataFrame:
    """The candidates whose path, written as in a listing, names a file at any depth of a folder."""
    return candidates.join(folder_files(spark, folder, [""], recursive=True).select("path"), "path", "left_semi")


def dropped_files(spark: SparkSession, folders: list[str], files: DataFrame, suffix: str = "ts") -> DataFrame:
    """(path): of dropped folders the files right in them whose names end so, and dropped files as they are. files: path."""
    out = files.select("path")
    for folder in folders:
        out = out.unionByName(folder_files(spark, folder, [suffix]).select("path"))
    return out


def append_manifest(digests: DataFrame, path: str) -> None:
    """Lines of 128 hexadecimal digits, two blanks and a name, added to a text manifest. digests: path, sha512."""
    digests.select(F.concat("sha512", F.lit("  "), F.regexp_extract("path", r"([^/]*)$", 1)).alias("value")).write.mode("append").text(path)


#: What a mark's table says of it beside its lines: where it comes from, and its place and size in a picture.
MARK_HEADER = ["mark", "service_id", "image_width", "image_height", "left", "top", "width"]


def write_marks(marks: DataFrame, path: str) -> None:
    """A row for each pixel of each plane: (MARK_HEADER, plane, x, y, a, b). marks: MARK_HEADER, plane, a, b, arrays in row order."""
    lines = marks.select(*MARK_HEADER, "plane", F.posexplode(F.arrays_zip("a", "b")).alias("pixel", "line"))
    x, y = F.col("pixel") % F.col("width"), F.floor(F.col("pixel") / F.col("width")).cast("int")
    lines.select(*MARK_HEADER, "plane", x.alias("x"), y.alias("y"), "line.a", "line.b").write.mode("overwrite").parquet(path)


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """Marks as write_marks() takes them. A mark is as large as a picture at most, so its pixels are gathered in one row."""
    rows = spark.read.parquet(path).groupBy(*MARK_HEADER, "plane").agg(F.array_sort(F.collect_list(F.struct("y", "x", "a", "b"))).alias("p"))
    return rows.select(*MARK_HEADER, "plane", F.transform("p", lambda p: p["a"]).alias("a"), F.transform("p", lambda p: p["b"]).alias("b"))


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header, and quotes wherever a value needs them."""
    rows.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_named(rows: DataFrame, name: str, line: str, folder: str, suffix: str) -> None:
    """A text file `name` + suffix in a folder for each name, its lines in the order of `rows`' partitions. There are few names; their files are moved into place one by one."""
    spark = rows.sparkSession
    aside = shared_folder(spark)
    rows.select(F.col(name).alias("name"), F.col(line).alias("value")).repartition("name").write.partitionBy("name").text(aside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(folder))
    for each in files.listStatus(path(aside)):
        if each.isDirectory():
            own = each.getPath().getName().removeprefix("name=")
            parts = [x.getPath() for x in files.listStatus(each.getPath()) if x.getPath().getName().startswith("part-")]
            if len(parts) != 1:
                raise ValueError(f"{own} was written in {len(parts)} parts")
            target = path(f"{folder}/{own}{suffix}")
            files.delete(target, False)
            files.rename(parts[0], target)
    removed(spark, aside)


def write_by_candidate(scores: DataFrame, path: str, candidate: str) -> None:
    """A folder of score files for each candidate."""
    scores.write.mode("overwrite").partitionBy(candidate).csv(path)


def comment_packet(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, packet): a key's comments as one XML document, in order. A packet is a file of its own, so keys must be as small as files may be."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda e: e[line]), "\n")
    head = "<?xml version='1.0' encoding='UTF-8'?>\n<packet>\n"
    return lines.groupBy(key).agg(F.concat(F.lit(head), body, F.lit("\n</packet>")).alias("packet"))
