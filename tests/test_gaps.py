"""Season changes, grading tables, feedback, labels, rates: small fixed cases, nulls and empty tables."""

import datetime as dt

from pyspark.sql import functions as F

from loomwork.functions import terms as t
from loomwork.operators import extraction as x
from loomwork.operators import grading as g
from loomwork.operators import metrics as m
from loomwork.operators import rollover as r

D = dt.date
NO_CLASS = "term string, pos int, label string, day date, date_start date, date_end date"
COURSES = "course_id long, target_term string, old_start date, week_one date, target_end date, season_change boolean"
DATES = "course_id long, pos int, event string, day date, date_start date, date_end date"


def season_tables(spark):
    no_class = spark.createDataFrame([
        ("Spring", 0, "MLK Day", D(2027, 1, 18), None, None), ("Spring", 1, "Presidents Day", D(2027, 2, 15), None, None), ("Spring", 2, "Spring Break", None, D(2027, 3, 6), D(2027, 3, 14)),
        ("Fall", 0, "Labor Day", D(2026, 9, 7), None, None), ("Fall", 1, "Fall Break", None, D(2026, 10, 10), D(2026, 10, 18)),
    ], NO_CLASS)
    courses = spark.createDataFrame([(1, "Spring", D(2026, 8, 24), D(2027, 1, 11), D(2027, 4, 27), True)], COURSES)
    dates = spark.createDataFrame([
        (1, 0, "Classes begin", D(2026, 8, 24), None, None), (1, 1, "Labor Day (no class)", D(2026, 9, 7), None, None), (1, 2, "Fall Break", None, D(2026, 10, 10), D(2026, 10, 18)),
        (1, 3, "Winter Recess", None, D(2026, 12, 1), D(2026, 12, 4)), (1, 4, "Last day to drop", D(2026, 9, 4), None, None),
    ], DATES)
    return dates, courses, no_class


def test_season_change_takes_over_breaks_and_holidays(spark):
    dates, courses, no_class = season_tables(spark)
    got = {p["pos"]: (p["event"], p["rule"], p["day"] or p["date_start"], p["flag"]) for p in r.roll_university_dates(dates, courses, no_class).collect()}
    assert got[0] == ("Classes begin", "begin", D(2027, 1, 11), None)
    assert got[1] == ("MLK Day", "next_holiday", D(2027, 1, 18), None)
    assert got[2] == ("Spring Break", "next_break", D(2027, 3, 6), None)
    assert got[3] == ("Winter Recess", "moved", D(2027, 4, 20), "unmatched")  # no second break is left
    assert got[4] == ("Last day to drop", "moved", D(2027, 1, 22), "unmatched")
    left = r.missing_holidays(dates, courses, no_class).collect()
    assert [(row["label"], row["nth"]) for row in left] == [("Presidents Day", 1)]


def test_same_season_renames_nothing(spark):
    dates, courses, no_class = season_tables(spark)
    rows = r.roll_university_dates(dates, courses.withColumn("season_change", F.lit(False)), no_class).collect()
    assert {p["event"] for p in rows} == {"Classes begin", "Labor Day (no class)", "Fall Break", "Winter Recess", "Last day to drop"}
    assert all(p["flag"] is None for p in rows)
    assert r.roll_university_dates(dates.limit(0), courses, no_class).count() == 0


def test_grading_tables(spark):
    rows = [
        (1, 1, 1, ["Item", "Points", "Percent"]), (1, 1, 2, ["Labs", "1", "25%"]), (1, 1, 3, ["Exam", "2", "n/a"]),
        (2, 1, 1, ["Item", "Points"]), (2, 1, 2, ["Labs", "250 pts"]), (2, 1, 3, ["Exam", "1,000"]), (2, 1, 4, ["Total", "2,000"]),
        (3, 1, 1, ["Labs", "30 points"]), (3, 1, 2, ["Exam", "60 pts"]), (3, 1, 3, ["Note", "see above"]),
        (4, 1, 1, ["Week", "Topic"]), (4, 1, 2, ["1", "2 of 10%"]), (5, 1, 1, []), (5, 1, 2, [None, None]),
    ]
    got = {(p["doc_id"], p["name"]): p["weight"] for p in x.grading_tables(spark.createDataFrame(rows, "doc_id int, table_no int, row_no int, cells array<string>")).collect()}
    assert got == {(1, "Labs"): 0.25, (2, "Labs"): 0.125, (2, "Exam"): 0.5, (3, "Labs"): 0.3333, (3, "Exam"): 0.6667}


def test_feedback(spark):
    scores = spark.createDataFrame(
        [(1, 7, 1, "Ideas", 4.0, 4.0, "Full 4/4", None, ["my own words"], ""), (1, 7, 2, "Style", 4.0, 2.0, "I give 3/4 here", " ", ["not there"], ""), (2, 7, 1, "Ideas", 4.0, None, None, None, None, "no_reply")],
        "submission_id int, rubric_id int, pos int, criterion string, possible double, earned double, reasoning string, deduction_comment string, evidence array<string>, errors string",
    )
    texts = spark.createDataFrame([(1, "These are My own   words."), (2, None)], "submission_id int, text string")
    rows = {(p["submission_id"], p["pos"]): p for p in g.reviewed(scores, texts).collect()}
    assert rows[1, 1]["evidence_note"] is None and rows[1, 2]["evidence_note"] == "not_found" and rows[2, 1]["evidence_note"] == "no_quote"
    assert not rows[1, 1]["contradicts"] and rows[1, 2]["contradicts"]
    assert rows[1, 2]["deduction_comment"] == f"{g.NO_REASON} {g.CONTRADICTION}" and rows[1, 1]["deduction_comment"] == ""
    reports = {p["submission_id"]: p for p in g.feedback(g.reviewed(scores, texts)).collect()}
    assert reports[1]["percent"] == 75.0 and "Check the evidence for: Style." in reports[1]["notes"] and reports[1]["comment"].startswith("Well done: ideas. Work next on: style.")
    assert reports[2]["error_code"] == "needs_review" and reports[2]["comment"] is None


def test_new_year_and_rolled_dates(spark):
    lines = spark.createDataFrame([(1, i, v) for i, v in enumerate(["Term: Fall 2026", "", "| Event | Date |", "|---|---|", "| Start | 8/24/2026 | x |", "| Break | 10/10 - 10/18 |"])], "doc_id int, line_no int, text string")
    dates = spark.createDataFrame([(1, 5, "start", D(2027, 8, 23), None, None), (1, 6, "other", D(2027, 9, 1), None, None), (1, 7, "Break", None, D(2027, 10, 9), D(2027, 10, 17))], "doc_id int, pos int, event string, day date, date_start date, date_end date")
    got = {p["line_no"]: p["new_text"] for p in x.rolled_dates(lines, dates).collect()}
    assert got == {4: "| start | 8/23/2027 | x |", 5: "| Break | 10/9 - 10/17 |"}  # by name, as the counts differ
    two = {p["line_no"]: p["new_text"] for p in x.rolled_dates(lines, dates.where("pos <> 7")).collect()}
    assert two == {4: "| start | 8/23/2027 | x |", 5: "| other | 9/1/2027 |"}  # by place


def test_rolled_lines_of_odd_syllabi(spark):
    week = "| Week | Date | Topics | Assignments |"
    texts = {
        1: ["term: Fall 2026", "|---|", week, "|:---|---|", "| 1 | 8/24 | A | |", "| 2 | 8/31 | B | |", "x", "Term: again", week, "| 3 | 9/7 | C | |"],  # a separator first; a number left out behind the second header; two term lines
        2: ["| a |", "| Event | Date |", "| End | 12/1/2026 | kept |", "", "| EVENT | Date |", "|---|---|", "| start | 2/30 |", "| |", None],  # "event" isn't the first row's; no schedule; no term
        3: ["Semester: Fall 2026", week],  # a schedule without rows
        None: ["Term: Fall 2026", week, "| 1 | 8/24 | A | |"],
    }
    lines = spark.createDataFrame([(k, 10 * (k == 1 and i > 8) + i, v) for k, rows in texts.items() for i, v in enumerate(rows)], "doc_id int, line_no int, text string")
    plan = spark.createDataFrame([(k, n, n, False, D(2027, 8, 23 + n), None, ["T"], []) for k in (1, 2, 3) for n in (2, 1)], "doc_id int, row_no int, week_number int, is_break boolean, day date, day_end date, topics array<string>, assignments array<string>")
    targets = spark.createDataFrame([(1, "Fall 2027"), (2, "Fall 2027")], "doc_id int, term string")
    dates = spark.createDataFrame([(2, 9, "Start", D(2027, 8, 23), None, None), (2, 8, "start", None, D(2027, 8, 24), D(2027, 8, 25)), (2, 7, "End", D(2027, 12, 9), None, None)], "doc_id int, pos int, event string, day date, date_start date, date_end date")
    got = {k: [] for k in texts}
    for p in sorted(x.rolled_lines(lines, plan, targets, dates).collect(), key=lambda p: p["line_no"]):
        got[p["doc_id"]].append(p["text"])
        assert p["line_no"] == len(got[p["doc_id"]])
    assert got == {
        1: ["term: Fall 2027", "|---|", week, "|:---|---|", "| 1 | 8/24 | T |  |", "| 2 | 8/25 | T |  |", "x", "Term: again", week, "| 3 | 9/7 | C | |"],
        2: texts[2][:6] + ["| start | 8/24 - 8/25 |", "| |", None],
        3: texts[3], None: texts[None],
    }
    read = x.university_dates(lines.where("doc_id = 2").union(spark.createDataFrame([(2, 99, "Term: Spring 2024"), (2, 11, "| Event |"), (2, 12, "| leap | 2/29 |"), (2, 13, "| span | 1/2 to 3/4/2025 |"), (2, 14, "| none | 13/1 - 2/3 |")], lines.schema)))
    assert [tuple(p)[1:5] for p in read.orderBy("pos").collect()] == [("leap", D(2024, 2, 29), None, None), ("span", None, D(2024, 1, 2), D(2025, 3, 4))]


def test_undated_breaks(spark):
    no_class = spark.createDataFrame([("T", 0, "Long Break", None, D(2027, 1, 16), D(2027, 1, 30)), ("T", 1, "Late Break", None, D(2027, 2, 8), D(2027, 2, 9)), ("T", 2, "Short", None, D(2027, 2, 2), D(2027, 2, 3))], NO_CLASS)
    courses = spark.createDataFrame([(1, "T", D(2027, 1, 11))], "course_id long, target_term string, week_one date")
    weeks = spark.createDataFrame([(1, 10, 1, False), (1, 20, 2, False)], "course_id long, row_no int, week_number int, is_break boolean")
    dated = r.date_undated(courses, weeks, no_class)
    assert [p["day"] for p in dated.orderBy("row_no").collect()] == [D(2027, 1, 11), D(2027, 2, 1)]
    assert [p["label"] for p in r.undated_breaks(dated, courses, no_class).collect()] == ["Long Break (1/16 - 1/30)"]


def test_small_functions(spark):
    row = spark.range(1).select(
        m.rate_section(F.lit("openai"), F.lit("http://localhost:1")).alias("a"), m.rate_section(F.lit("Gemini"), F.lit("http://x")).alias("b"), m.rate_section(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("c"),
        m.cost_text(F.lit(None).cast("double")).alias("d"), t.plain_text(F.lit(" **a** *b*\n")).alias("e"), t.has_ai_task(F.lit("x\n## AI use task")).alias("f"), t.has_ai_task(F.lit(None).cast("string")).alias("g"),
        t.written_label(F.lit("3"), F.to_date(F.lit("2027-09-05")), F.lit("Month d")).alias("h"),
    ).first()
    assert tuple(row) == ("local", "gemini", "openai", "cost unknown", "a b", True, False, "Week 3 (September 5)")
