"""Extraction, review and streaming jobs on inline rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomwork.operators import documents as doc
from loomwork.operators import extraction as x
from loomwork.operators import flags as f
from loomwork.operators import metrics as m
from loomwork.plans import base, registry, streams
from loomwork.sources import fixtures as fx

D = dt.date
HEAD = "**Term:** fall semester 2026\nCourse: IS 1\n"
GOOD = HEAD + "## Schedule\n| Week | Date | Topics | Assignments |\n|---|---|---|---|\n| 1 | 8/24 | A; B | |\n| - | 10/10 - 10/18 | Fall Break | |\n"


def lines(spark, *texts):
    return doc.lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_schedule_and_errors(spark):
    bad = [
        GOOD.replace("8/24", "8/41"), GOOD.replace("| 1 |", "| one |"), GOOD.replace("10/10 - 10/18", "10/10"), GOOD.replace("fall semester 2026", "someday"),
        GOOD + "\n| Week | Date | Topics | Assignments |\n|---|---|---|---|\n| 2 | 8/31 | C | |\n",
    ]
    rows = x.schedule(lines(spark, GOOD, *bad)).collect()
    good = sorted((r for r in rows if r.doc_id == 0), key=lambda r: r.row_no)
    assert [(r.week_number, r.day, r.date_start, r.date_end, r.is_break, r.topics, r.error_code) for r in good] == [
        (1, D(2026, 8, 24), None, None, False, ["A", "B"], None),
        (None, None, D(2026, 10, 10), D(2026, 10, 18), True, ["Fall Break"], None),
    ]
    errors = {i: {r.error_code for r in rows if r.doc_id == i} - {None} for i in range(1, 6)}
    assert errors == {1: {"bad_date"}, 2: {"bad_week"}, 3: {"bad_break"}, 4: {"no_term"}, 5: {"several_schedules"}}
    front = {r.doc_id: r for r in x.front_matter(lines(spark, GOOD, "nothing")).collect()}
    assert front[0].term == "Fall 2026" and front[1].error_code == "no_term"


def test_points_and_percent(spark):
    rows = [(1, 0, "a", "250 points"), (1, 1, "b", "150"), (1, 2, "c", "600"), (1, 3, "Total", "1,000".replace(",", "")), (2, 0, "a", "40%"), (2, 1, "b", "60 %"), (3, 0, "a", "1"), (3, 1, "b", "2"), (3, 2, "c", "none")]
    got = x.grading(spark.createDataFrame(rows, "doc_id long, row_no int, name string, value string"))
    assert [r.weight for r in got.orderBy("doc_id", "row_no").collect()] == [0.25, 0.15, 0.6, 0.4, 0.6, 0.3333, 0.6667]


@pytest.mark.parametrize("spring", [False, True])
def test_new_year(spark, spring):
    days = [D(2026, 11, 30), D(2026, 12, 14), D(2026, 1, 4), D(2026, 1, 11)]
    got = x.roll_new_year(spark.createDataFrame([(1, i, d, spring) for i, d in enumerate(days)], "doc_id long, row_no int, day date, is_spring boolean"))
    want = [2025, 2025, 2026, 2026] if spring else [2026, 2026, 2027, 2027]
    assert [r.day.year for r in got.orderBy("row_no").collect()] == want


def test_objectives_stop_at_other_text(spark):
    got = x.section_lines(lines(spark, "# Objectives\n- a\n\n2. b\nplain\n- c"), "(?i)objectives")
    assert [(r.pos, r.text) for r in got.collect()] == [(1, "a"), (2, "b")]


def test_documents_escape(spark):
    course = spark.createDataFrame([(1, "A & <b>", "IS 1", "Fall 2026", None)], "course_id long, title string, number string, term string, meeting_pattern string")
    week = spark.createDataFrame([(1, 10, "Week 1", False, ["x"])], "course_id long, row_no int, label string, is_break boolean, topics array<string>")
    assert x.page(course, week).first().content == "<h1>A &amp; &lt;b&gt;</h1><p>IS 1, Fall 2026</p><table><tr><td>Week 1</td><td>x</td></tr></table>"
    none = spark.createDataFrame([], "course_id long, pos int, event string, day date, date_start date")
    assert x.brief(course, week, none).first().content.endswith("## Schedule\n- Week 1: x\n\n## Dates\nnone")


def test_paragraph_changes(spark):
    table = lambda *t: spark.createDataFrame([(1, i, p) for i, p in enumerate(t)], "doc_id long, para_no int, text string")
    got = f.changed_paragraphs(table("same", "meets on Monday at nine", "a b"), table("same", "meets on Tuesday at nine", "a x b")).orderBy("para_no").collect()
    assert [(r.removed, r.added) for r in got] == [("Monday", "Tuesday"), ("", "x")]
    assert {r.error_code for r in f.changed_paragraphs(table("a"), table("a", "b")).collect()} == {"paragraph_count"}


def test_overrides_and_edits(spark):
    rows = spark.createDataFrame([(1, 10, False, D(2026, 9, 1)), (1, 20, False, D(2026, 9, 8)), (1, 30, True, D(2026, 9, 10))], "course_id long, row_no int, is_break boolean, day date")
    own = spark.createDataFrame([(1, 10, D(2026, 9, 9)), (1, 30, D(2026, 1, 1)), (1, 77, D(2026, 1, 1))], "course_id long, row_no int, own_day date")
    assert [(r.row_no, r.place, r.overridden) for r in f.override(rows, own).orderBy("place").collect()] == [(20, 1, False), (10, 2, True), (30, 3, False)]
    assert f.override_errors(rows, own).first().unknown_rows == 2
    course = spark.createDataFrame([(1, "Old")], "course_id long, title string")
    edit = spark.createDataFrame([(1, " ", "3x")], "course_id long, new_title string, new_credits string")
    assert f.apply_edits(course, edit).first()[1:] == ("Old", None, "bad_credits")


def test_stream_equals_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    batch = {(r.project_id, r.rollovers, r.extraction_errors, r.total_cost_usd) for r in m.summary(fx.eval_events(spark, path)).collect()}
    stream = {(r.project_id, r.rollovers, r.extraction_errors, r.total_cost_usd) for r in base.QUERIES["r2_counters_stream"](spark, path).collect()}
    assert batch == stream
    assert {(r.project_id, r.content_type, r.typical_tokens) for r in streams.typical(spark, path).collect()} == {(r.project_id, r.content_type or "unknown", r.typical_tokens) for r in m.typical_output(fx.eval_events(spark, path).withColumn("content_type", F.coalesce("content_type", F.lit("unknown")))).collect()}


def test_registry():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 60
