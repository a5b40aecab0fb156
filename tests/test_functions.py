"""Names, times, texts, streams' files and the string decoder on written-out cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reelmark.functions import arib, genre, names, times
from reelmark.operators import catalogue, changes, joblog, rules, scheduling, texts
from reelmark.sources import storage
from reelmark.streaming import updates


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_names(spark):
    assert one(spark, names.escaped(F.lit('a/b:c*?"<>|\\'), True))[0] == "a／b：c＊？”＜＞｜￥"
    assert one(spark, *[names.suffix(F.lit(n)) for n in (0, 1, 26, 27, 28)]) == ("", "-A", "-Z", "-AA", "-AB")
    assert one(spark, *[names.tail_kind(F.lit(t)) for t in (".mp4", "-1.mp4", "-cm.mp4", ".ass", "-2_div1-cm-nicojk-720S.ass", "none")]) == (1, 8, 2, 4, 32, None)
    assert one(spark, *[names.wanted_kinds(F.lit(t)) for t in ("vcs", "all", "x")]) == (7, 255, 0)
    assert one(spark, *[names.exit_code(F.lit(c)) for c in (5, -5, -1073741819)]) == ("5", "-5", "0xc0000005")
    assert one(spark, names.broadcast_address(F.lit("192.168.1.7"), F.lit("255.255.255.0")))[0] == "192.168.1.255"
    assert one(spark, names.nibbles_swapped(F.lit("1a2b")), names.is_hex(F.lit("12g")))[0] == "a1b2"


def test_values_of_the_service_itself(spark):
    """Each by hand from what the service does."""
    assert one(spark, *[names.suffix(F.lit(n)) for n in (53, 54, 728, 729, 800, 4095)]) == ("-A[", "-BA", "-Z[", "-AAA", "-ACR", "-EQS")
    assert one(spark, *names.snapped(F.lit(1), F.lit(2)), *names.snapped(F.lit(3), F.lit(5))) == (0, 2, 2, 6)
    three = "".join(f"{k}:{k + 1}:{k + 2}\r\n" for k in (1, 4))
    assert one(spark, names.grouped_numbers(F.lit(three), 3, 2))[0] == [[1, 2, 3], [4, 5, 6]]
    assert one(spark, *[names.grouped_numbers(F.lit(t), 3, 2) for t in (three + "7", "1,2,3\n4,5,6", "1:2:x\n4:5:6", " 1 :2:3\r\r4:5:6\n \n")]) == (None, None, None, [[1, 2, 3], [4, 5, 6]])
    time = F.lit("2001-02-03 04:05:00").cast("timestamp_ntz")
    title = lambda t, e, s: names.recording_title(t, F.lit(e), F.lit(s), F.lit("own.ts"))
    assert one(spark, title(time, "a/b", "c:d"), title(time, "", "c"), title(F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), "a", "b"), title(F.lit(None).cast("timestamp_ntz"), "a", "b")) == ("200102030405_a／b _c：d.ts", "own.ts", "own.ts", "own.ts")
    states = ("Queue", "LogoPending", "Encoding", "Canceled", "Complete", "Failed", "PreFailed")
    assert one(spark, *[catalogue.state_bucket(F.lit(s)) for s in states]) == (0, 1, 2, 3, 4, 5, 5)
    assert one(spark, joblog.day_text(F.lit("2001-02-03").cast("timestamp_ntz")), joblog.day_text(F.lit(None).cast("timestamp_ntz"))) == ("2001年2月3日", "不明")
    jobs = spark.createDataFrame([(s,) for s in (*states, "Queue")], "state string").withColumn("by", F.lit(1))
    row = catalogue.progress(jobs, ["by"]).first()
    assert (row.total, row.remaining) == (6, 3) and abs(row.progress - 3.1 / 6.1) < 1e-12
    assert names.mac_bytes and one(spark, names.mac_bytes(F.lit("00:1a-2B:ff:0c:9d")))[0] == [0, 26, 43, 255, 12, 157]


def test_a_view_keeps_what_ran_within_it(spark):
    rows = [(1, "2001-01-01", "2001-01-05"), (2, "2001-01-01", "2001-01-02"), (3, "2001-01-09", "2001-01-20"), (4, "2001-01-12", "2001-01-20"), (5, None, None), (6, "2001-01-05", None)]
    jobs = spark.createDataFrame(rows, "id int, start string, finish string").select("id", *[F.col(c).cast("timestamp_ntz") for c in ("start", "finish")])
    assert [r.id for r in catalogue.view(jobs, catalogue.View(start="2001-01-04", end="2001-01-10")).orderBy("id").collect()] == [1, 3]
    assert [r.id for r in catalogue.view(jobs, catalogue.View(end="2001-01-10")).orderBy("id").collect()] == [1, 2, 3, 5, 6]


def test_moves_beyond_a_list_are_refused(spark):
    jobs = spark.createDataFrame([("g", k, k) for k in range(4)], "g string, item long, position long")
    for to, expected in ((3, [0, 3, 1, 2]), (0, [1, 0, 2, 3]), (4, [0, 1, 2, 3]), (-1, [0, 1, 2, 3])):
        moved = scheduling.moved(jobs, ["g"], spark.createDataFrame([("g", 1, to)], "g string, item long, to long"))
        assert [r.position for r in moved.orderBy("item").collect()] == expected


def test_a_rolling_console_drops_a_hundred(spark):
    for n, first in ((500, 0), (501, 0), (502, 100), (601, 100), (602, 200)):
        rows = spark.createDataFrame([(1, "\n".join(f"line {k}" for k in range(n)))], "id int, t string")
        got = [r.line for r in texts.console_lines(rows, "id", "t", 500).orderBy("number").collect()]
        assert got == [f"line {k}" for k in range(first, n)]


def test_sets_that_grow_by_what_they_lack(spark):
    assert one(spark, catalogue.add_if_absent(F.array(F.lit("a")), F.lit("b")), catalogue.add_if_absent(F.array(F.lit("a")), F.lit("a"))) == (["a", "b"], ["a"])


def test_watching_a_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.ts").write_text("x")
    (folder / "b.ts").write_text("x")
    names_of = lambda rows: sorted((r.path.rsplit("/", 1)[1], r.change) for r in rows.collect())
    assert names_of(updates.watched(spark, str(folder), [".ts"], str(tmp_path / "s1"))) == [("a.ts", "add"), ("b.ts", "add")]
    (folder / "b.ts").rename(folder / "c.ts")
    import os

    os.utime(folder / "a.ts", (1, 1))
    assert names_of(updates.watched(spark, str(folder), [".ts"], str(tmp_path / "s2"), str(tmp_path / "s1"))) == [("a.ts", "change"), ("b.ts", "remove"), ("c.ts", "add")]
    seen = updates.run_to_end(updates.new_files(spark, str(folder)), "append", "seen")
    assert sorted(r.path.rsplit("/", 1)[1] for r in seen.collect()) == ["a.ts", "c.ts"]
    assert storage.first_result(spark, str(tmp_path), ".ts").first().path.endswith("/in/a.ts")
    listed = storage.folder_files(spark, str(folder), ["c.ts"]).select("path")
    assert storage.existing(spark, listed.union(spark.createDataFrame([("file:/gone.ts",)], "path string")), str(tmp_path)).count() == 1
    assert storage.dropped_files(spark, [str(folder)], spark.createDataFrame([("x.txt",)], "path string")).count() == 3
    storage.append_manifest(storage.file_digests(spark, str(folder)), str(tmp_path / "manifest"))
    lines = storage.text_lines(spark, str(tmp_path / "manifest"))
    entries = texts.manifest_entries(lines.select(F.lit("m").alias("m"), F.struct("path", "block", "number").alias("k"), "line"), "m", "k", "line").collect()
    assert sorted(r.name for r in entries) == ["a.ts", "c.ts"] and all(len(r.digest) == 128 for r in entries)


def test_packing_three_numbers_comes_back(spark):
    rows = spark.range(256).select(F.col("id").cast("int").alias("x"))
    packed = scheduling.packed(F.col("x"), 255 - F.col("x"), F.col("x"))
    back = rows.select("x", *scheduling.unpacked(packed)).collect()
    assert all((r[1], r[2], r[3]) == (r[0], 255 - r[0], r[0]) for r in back)


def test_times(spark):
    assert one(spark, times.parsed(F.lit("20240101000007")), times.parsed(F.lit("1704067207"))) == (1704067207, 1704067207)
    requests = one(spark, times.slot_requests(F.lit(0).cast("long"), F.lit(300 * 9 + 1).cast("long")))[0]
    assert [(r.slot, r.n) for r in requests] == [(0, 8), (8, 2)]
    assert one(spark, times.duration_text(F.lit(90061.9)))[0] == "25時間01分01秒"


def test_manifest(spark):
    rows = [("m", 0, "a" * 128 + "  x"), ("m", 1, "b" * 128 + "  x"), ("m", 2, "short"), ("m", 3, "z" * 128 + "  y"), ("m", 4, "end")]
    got = {r.name: r.digest for r in texts.manifest_entries(spark.createDataFrame(rows, "m string, k int, line string"), "m", "k", "line").collect()}
    assert got == {"x": "a" * 128, "short": None, "y": None}


def test_console(spark):
    rows = [(1, "one\ntwo\rthree\r\nfour\bfive"), (2, ""), (3, "\n\n")]
    got = [(r.id, r.line) for r in texts.console_lines(spark.createDataFrame(rows, "id int, t string"), "id", "t", 10).orderBy("id", "number").collect()]
    # A carriage return lets the next text replace its line; a line feed right after it takes that back.
    assert got == [(1, "one"), (1, "three"), (1, "five")]


def test_first_rule_wins(spark):
    base = (False, None, False, None, False, [], False, [], False, [])
    open_rule = ("s", 2, *base, "any", 1)
    tagged = ("s", 1, True, "news", *base[2:], "first", 4)
    table = spark.createDataFrame([open_rule, tagged], rules.RULES)
    items = spark.createDataFrame([(1, "s", ["news"], "f", [], 1, 100), (2, "s", [], "f", [], 1, 100), (3, "gone", [], "f", [], 1, 100)], "id int, rule_set string, tags array<string>, file_name string, genres array<struct<space:int,level1:int,level2:int>>, service_id int, width int")
    got = {r.id: (r.profile, r.priority) for r in rules.assign(items, table).collect()}
    assert got == {1: ("first", 4), 2: ("any", 1), 3: (None, 0)}


def test_genres(spark):
    item = genre.from_nibbles(F.lit(14), F.lit(1), F.lit(3), F.lit(4))
    assert tuple(one(spark, item)[0]) == (2, 3, 4)


def test_changes_mirror(spark):
    old = spark.createDataFrame([("A", 1), ("b", 2), ("c", None)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 3), ("d", 4)], "k string, v int")
    forth = {(r.k, r.change) for r in changes.snapshot_changes(old, new, "k", ["v"], True).collect()}
    back = {(r.k, r.change) for r in changes.snapshot_changes(new, old, "k", ["v"], True).collect()}
    assert forth == {("b", "change"), ("c", "remove"), ("d", "add")} and back == {("b", "change"), ("c", "add"), ("d", "remove")}
    assert changes.snapshot_changes(old, old, "k", ["v"]).count() == 0


def test_usable_bounds_are_inclusive(spark):
    row = spark.sql("select true as e, true as n, timestamp_ntz'2020-01-01' as a, timestamp_ntz'2020-02-01' as b")
    for time, holds in (("2020-01-01", True), ("2020-02-01", True), ("2020-02-02", False), (None, True)):
        t = F.lit(time).cast("timestamp_ntz")
        assert row.select(catalogue.usable(F.col("e"), F.col("n"), F.col("a"), F.col("b"), t)).first()[0] is holds


def test_broadcast_strings(spark):
    assert "".join(r["text"] for r in arib.decode("\x0eAB".encode() + b"\x0f" + "漢字".encode("iso2022_jp")[3:-3])) == "AB漢字"
    assert [(r["text"], r["colour"]) for r in arib.decode(b"\x0eA\x82B")] == [("A", "white"), ("B", "green")]
    assert arib.decode(b"\x1b\x28\x20\x41\x21", glyphs={"121": "☆"})[0]["text"] == "☆"
    assert arib.decode(b"\x1b\x28\x20\x41\x21")[0]["text"] == arib.PLACEHOLDER
    assert arib.decode(b"\x98\x43\x0eA")[0]["text"] == "AAA" and arib.decode(b"\x30") == [] and arib.decode(b"\xa4")[0]["text"] == "い"
    assert [r.text for r in spark.createDataFrame([(bytearray(b"\x0eA"),), (None,)], "b binary").select(F.explode_outer(arib.decoded(F.col("b"))).alias("r")).select("r.text").collect()] == ["A", None]


def test_storage_round_trips(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.TS").write_text("x")
    (tmp_path / "in" / "b.txt").write_text("0123456789abcdef0123456789abcdef=あ\nbad\n")
    assert [r.name for r in storage.folder_files(spark, str(tmp_path / "in"), [".ts", ".m2t"]).collect()] == ["a.TS"]
    assert [tuple(r) for r in storage.glyph_map(spark, str(tmp_path / "in" / "b.txt")).collect()] == [("0123456789abcdef0123456789abcdef", "あ")]
    rows = spark.createDataFrame([(1, 'say "hi", you')], "id long, text string")
    storage.append_xml_log(rows, str(tmp_path / "xml"), "Item")
    storage.append_xml_log(rows, str(tmp_path / "xml"), "Item")
    assert storage.read_xml_log(spark, str(tmp_path / "xml"), "Item", "id long, text string").count() == 2
    storage.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').first().text == 'say "hi", you'


def test_hexadecimal_bytes(spark):
    assert one(spark, names.from_hex(F.lit("00fF")), names.from_hex(F.lit("")), names.from_hex(F.lit(None).cast("string"))) == (bytearray(b"\x00\xff"), bytearray(), None)
    for bad in ("0", "0g", "00 "):
        with pytest.raises(Exception, match="no hexadecimal"):
            one(spark, names.from_hex(F.lit(bad)))
