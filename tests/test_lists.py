"""Documents of open form, client lists and named filters at their edges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reelmark.functions import documents
from reelmark.operators import filters, lists, texts


def test_documents_that_are_no_objects_have_no_members(spark):
    rows = spark.createDataFrame([(0, '{"a":1.50,"b":null,"c":{"d":["x"]}}'), (1, "{}"), (2, "[1]"), (3, "no document"), (4, None)], "k int, d string")
    d = F.col("d")
    out = rows.orderBy("k").select(documents.member_names(d), documents.is_defined(d, "b"), documents.member(d, "$.c.d[0]", "string"), documents.member(d, "$.c", "long"), documents.without(d, "c")).collect()
    assert [tuple(r) for r in out[:2]] == [(["a", "b", "c"], True, "x", None, '{"a":1.5,"b":null}'), ([], False, None, None, "{}")]
    assert [tuple(r)[:4] for r in out[2:]] == [(None, False, None, None)] * 3


def test_a_second_click_turns_the_order(spark):
    rows = spark.createDataFrame([(2, "b"), (1, "c"), (3, "a")], "n int, s string")
    once = lists.toggled(None, "n")
    twice, other = lists.toggled(once, "n"), lists.toggled(once, "s")
    assert [[r["n"] for r in lists.sorted_view(rows, x).collect()] for x in (once, twice, lists.toggled(twice, "n"), other)] == [[1, 2, 3], [3, 2, 1], [1, 2, 3], [3, 2, 1]]


def test_a_question_names_ten_and_counts_the_rest(spark):
    items = spark.createDataFrame([(k, n, f"f{n}") for k, size in ((0, 10), (1, 12)) for n in range(size)], "k int, n int, name string")
    text = dict(lists.confirmation(items, ["k"], "n", "name").collect())
    names = "\r\n".join(f"f{n}" for n in range(10))
    assert text == {0: names, 1: f"{names}\r\n\r\n他2個"}


def test_a_glyph_changes_with_new_places_only(spark):
    reports = spark.createDataFrame([("a", "p", 1, 1), ("a", "p", 1, 9), ("b", "p", 1, 1), ("b", "q", 1, 5), ("c", "p", 1, 9)], "glyph string, path string, seconds int, number int")
    images = spark.createDataFrame([("a",), ("b",), ("b",)], "glyph string")
    assert [tuple(r) for r in texts.updated_glyphs(images, reports, "number", 5).collect()] == [("b", 2, 5)]


def test_filters_run_around_the_erasing(spark):
    known = filters.Filters()
    known.add("メイン_twice", lambda f: f.withColumn("v", F.col("v") * 2))
    known.add("ポスト_minus", lambda f: f.withColumn("v", F.col("v") - 1))
    rows = spark.createDataFrame([(5,)], "v int")
    assert known.run(rows, "メイン_twice", "ポスト_minus", lambda f: f.withColumn("v", F.col("v") + 10)).first()["v"] == 19
    assert known.run(rows, None, None).first()["v"] == 5
    for name, error in (("smooth", ValueError), ("メイン_twice", ValueError)):
        with pytest.raises(error):
            known.add(name, lambda f: f)
    with pytest.raises(KeyError):
        known.run(rows, "メイン_none", None)
