"""Draft quality, page and file jobs on inline rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from loomwork.operators import pages as p
from loomwork.operators import quality as q
from loomwork.operators import rollover as r
from loomwork.sources import files, fixtures as fx

D = dt.date


def test_review_and_clean_up(spark):
    drafts = spark.createDataFrame([(1, 1, "# T\nUpload it to the portal.\n\n\n\nEnd."), (2, 2, "# T\n## Submission\nby mail\n## More\nx"), (3, 3, "You must create a diagram.\nYou may write a report."), (4, 9, None)], "draft_id long, request_id long, text string")
    requests = spark.createDataFrame([(1, "Don't ask to submit anything."), (2, "Students hand in a pdf."), (3, None)], "request_id long, text string")
    assert {x.draft_id: x.issues for x in q.review(drafts, requests).collect()} == {1: "submission_logistics", 2: "", 3: "unasked_diagram", 4: ""}
    got = {x.draft_id: (x.text, x.removed_lines) for x in q.clean_up(drafts, requests).collect()}
    assert got[1] == ("# T\n\nEnd.", 1) and got[2][1] == 0 and got[4] == ("", 0)


def test_revision(spark):
    long = "The Essay " + "x" * 150
    rows = [(1, "essay", "old", 2, long, 1), (2, "essay", "old", 1, long, 1), (3, "essay", "old", 2, "essay", 0), (4, "essay", "old", 2, None, 0)]
    got = q.choose_revision(spark.createDataFrame(rows, "draft_id long, name string, text string, n_issues int, revised_text string, revised_issues int"))
    assert [x.revised for x in got.orderBy("draft_id").collect()] == [True, False, False, False]


def test_slides(spark):
    deck = "---\nsubtitle: s\ntitle: kept\n---\n# A\ntext\n<!-- slide 4 -->\n## B"
    got = q.number_slides(spark.createDataFrame([(1, "t", deck)], "deck_id long, title string, text string")).first()
    assert got.slides == 2 and got.text == "---\ntitle: kept\n---\n\n<!-- AI draft -->\n\n<!-- Slide 1 -->\n## A\ntext\n\n<!-- Slide 2 -->\n## B\n"


def test_schedule_tables(spark):
    rows = [(1, 0, 1), (1, 0, 3), (1, 1, 4), (2, 0, 1), (2, 1, 1), (3, 0, 1)]
    got = q.schedule_tables(spark.createDataFrame(rows, "doc_id long, table_no int, week_number int"))
    assert {x.doc_id: x.status for x in got.collect()} == {1: "continued", 2: "ambiguous", 3: "one"}


def test_reflow(spark):
    texts = [("COURSE DESCRIPTION", 72, 170), ("This text runs to the right edge of", 72, 300), ("the page. Done.", 72, 150), ("New one ends short", 72, 160), ("Also new", 72, 120), ("- a bullet that is a long line here", 72, 300), ("see https://example.org/a", 72, 200), ("bc/d", 72, 90)]
    rows = [(1, 1, i, t, float(a), float(b), 20.0 * i, 20.0 * i + 12) for i, (t, a, b) in enumerate(texts)]
    got = p.reflow(spark.createDataFrame(rows, "doc_id long, page int, line_no int, text string, x0 double, x1 double, top double, bottom double"))
    far = [x.text for x in got.orderBy("pos").collect()]
    assert far == [t for t, _, _ in texts]  # all lines are more than a gap apart
    near = [(d, pg, i, t, a, b, 14.0 * i, 14.0 * i + 12) for d, pg, i, t, a, b, _, _ in rows]
    got = p.reflow(spark.createDataFrame(near, "doc_id long, page int, line_no int, text string, x0 double, x1 double, top double, bottom double"))
    assert [x.text for x in got.orderBy("pos").collect()] == ["COURSE DESCRIPTION", "This text runs to the right edge of the page. Done.", "New one ends short", "Also new", "- a bullet that is a long line here see https://example.org/abc/d"]


def test_joined_replies(spark):
    one = {"course": {"title": " ", "term": "Fall"}, "weeks": [{"week": 1, "date": "1/1", "topics": "a"}, {"week": 2, "date": "1/8", "topics": "b"}]}
    two = {"course": {"title": "T", "term": "Spring"}, "weeks": [{"week": 2, "date": "1/8", "topics": "c"}, {"week": 2, "date": "1/9", "topics": "d"}]}
    rows = [(1, 1, json.dumps(one), False), (1, 2, json.dumps(two), False), (2, 1, "nonsense", False), (3, 1, "{}", True)]
    courses, weeks, errors = p.joined_replies(spark.createDataFrame(rows, "doc_id long, part int, text string, cut_off boolean"))
    got = {x.doc_id: x for x in courses.collect()}
    assert (got[1].title, got[1].term, got[1].number) == ("T", "Fall", None)
    assert [(x.week, x.date, x.topics) for x in weeks.orderBy("row_no").collect()] == [(1, "1/1", "a"), (2, "1/8", "b; c"), (2, "1/9", "d")]
    assert {(x.doc_id, x.error_code) for x in errors.collect()} == {(2, "unreadable"), (2, "no_schedule"), (3, "cut_off"), (3, "no_schedule")}


def test_log_files(spark, tmp_path):
    path = f"{tmp_path}/log"
    good, bad = files.read_log(spark, path)
    assert good.count() == bad.count() == 0
    rows = spark.createDataFrame([("rollover", "2026-09-01T10:00:00+00:00", 3), ("generation", None, None)], "event_type string, timestamp string, flag_count int")
    files.append_log(rows, path)
    files.append_log(rows.where("event_type = 'rollover'"), path)
    with open(f"{path}/extra.txt", "w") as f:
        f.write('\n{"event_type": "rollover"}\n\n{"event_type": "half')
    good, bad = files.read_log(spark, path)
    assert good.count() == 4 and bad.count() == 1
    assert good.where("flag_count = 3").first().ts == dt.datetime(2026, 9, 1, 10)
    with pytest.raises(ValueError):
        files.read_log(spark, path, fail=True)


def test_calendar_and_documents(spark, tmp_path):
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"terms": [{"term": "Fall 2026", "start": "2026-08-24", "end": "2026-12-10", "no_class_dates": [{"label": "Labor Day", "date": "2026-09-07"}, {"label": "Fall Break", "date_start": "2026-10-10", "date_end": "2026-10-18"}]}]}, indent=1))
    terms, entries = files.read_calendar(spark, str(file))
    assert terms.first().asDict() == {"term": "Fall 2026", "pos": 0, "start_date": D(2026, 8, 24), "end_date": D(2026, 12, 10)}
    assert [(x.label, x.day, x.date_start) for x in entries.orderBy("pos").collect()] == [("Labor Day", D(2026, 9, 7), None), ("Fall Break", None, D(2026, 10, 10))]
    files.write_documents(spark.createDataFrame([(1, "a"), (2, "b")], "course_id long, content string"), f"{tmp_path}/out", "course_id")
    assert [x.value for x in spark.read.text(f"{tmp_path}/out/course_id=2").collect()] == ["b"]


def test_small_rollover_steps(spark):
    courses = spark.createDataFrame([(1, "Fall 2027")], "course_id long, target_term string")
    dates = spark.createDataFrame([(1, "Labor Day (holiday)")], "course_id long, event string")
    assert {x.label for x in r.unnamed_entries(courses, dates, fx.no_class(spark)).collect()} == {"Fall Break", "Thanksgiving Break"}
    span = "course_id long, label string, date_start date, date_end date"
    skipped = spark.createDataFrame([(1, "B", D(2027, 3, 6), D(2027, 3, 14))] * 2 + [(1, "C", D(2027, 1, 1), D(2027, 1, 2))], span)
    shown = spark.createDataFrame([(1, "x", D(2027, 1, 1), D(2027, 1, 2))], span)
    assert [x.label for x in r.added_break_rows(skipped, shown).collect()] == ["B (3/6 - 3/14)"]
    rows = [(1, "Fall 2026", 5, None), (2, "Fall 2026", 10, 3.0), (3, "Fall 2026", 15, 1.5), (4, "Summer 2027", 9, None), (5, "Fall 2026", 14, 3.0)]
    got = r.guess_session(spark.createDataFrame(rows, "course_id long, term string, week_count int, credits double"))
    assert [(x.session, x.weeks) for x in got.orderBy("course_id").collect()] == [("1", 5), ("1-2", 10), ("1", 5), ("10 weeks", 10), ("1-3", 14)]
    assert got.where(F.col("weeks").isNull()).count() == 0
