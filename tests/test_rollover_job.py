"""The rollover job by hand: breaks that are stepped over, weeks cut and added, breaks the class meets through."""

import datetime

from pyspark.sql import functions as F

from loomwork.operators import rollover as r
from loomwork.operators import rollover_job as job
from loomwork.sources import fixtures as fx

D = datetime.date
WEEKS = "course_id long, row_no int, week_number int, day date, date_start date, date_end date, label string, is_break boolean, topics array<string>, assignments array<string>, notes string"


def test_outputs_of_the_job(spark):
    courses = spark.createDataFrame(
        [(1, "Fall 2026", "Fall 2027", 10, "MWF", "markdown"), (2, "Fall 2026", "Fall 2027", 3, "MWF", "word"), (3, "Fall 2026", "Fall 2027", 10, "MWF", "word"), (4, "Fall 2026", "Fall 2099", 3, "", "word")],
        "course_id long, term string, target_term string, duration_weeks int, meeting_pattern string, source_format string",
    )
    rows = []
    for c, n in ((1, 10), (2, 3), (3, 10), (4, 3)):
        rows += [(c, 10 * w, w, D(2026, 8, 24) + datetime.timedelta(7 * (w - 1)), None, None, f"Week {w}", False, [f"t{w}"], [], None) for w in range(1, n + 1)]
    rows.append((3, 75, None, None, D(2026, 10, 10), D(2026, 10, 18), "Fall Break (10/10 - 10/18)", True, [], [], None))
    dates = spark.createDataFrame([(1, 0, "Classes begin", D(2026, 8, 24), None, None), (1, 1, "Fall break", None, D(2026, 10, 10), D(2026, 10, 18))], "course_id long, pos int, event string, day date, date_start date, date_end date")
    choices = spark.createDataFrame([(2, 5, None), (3, 8, ["Fall Break"])], "course_id long, new_weeks int, through array<string>")
    out = job.roll_over_catalogue(courses, spark.createDataFrame(rows, WEEKS), dates, fx.terms(spark), fx.no_class(spark), choices)
    plan = {}
    for x in out.schedule.orderBy("course_id", "day").collect():
        plan.setdefault(x.course_id, []).append((x.label, x.day, x.date_end))
    # 2027-10-11 to 15 lies in Fall Break: week 8 moves on, and the break gets a row
    assert plan[1][6:9] == [("Week 7", D(2027, 10, 4), None), ("Fall Break (10/9 - 10/17)", D(2027, 10, 9), D(2027, 10, 17)), ("Week 8", D(2027, 10, 18), None)]
    assert [x[0] for x in plan[2]] == ["Week 1", "Week 2", "Week 3", "Week 4", "Week 5"] and plan[2][4][1] == D(2027, 9, 20)
    assert plan[3][-1] == ("Week 8", D(2027, 10, 11), None) and len(plan[3]) == 8 and 4 not in plan
    told = {(x.course_id, x.flag): x.detail for x in out.flags.collect()}
    assert told == {(1, "break_stepped_over"): "Fall Break", (2, "duration_changed"): "3 to 5", (3, "duration_changed"): "10 to 8", (3, "break_not_taken"): "Fall Break"}
    new = {x.course_id: x for x in out.courses.collect()}
    assert set(new) == {1, 2, 3} and (new[1].term, new[1].term_start, new[1].term_end, new[1].duration_weeks) == ("Fall 2027", D(2027, 8, 23), D(2027, 11, 1), 10) and new[2].duration_weeks == 5
    assert {(x.event, x.day, x.date_start) for x in out.university_dates.collect()} == {("Classes begin", D(2027, 8, 23), None), ("Fall break", None, D(2027, 10, 9))}
    changed = {(x.course_id, x.row_no): x for x in out.changes.collect()}
    assert changed[1, 2001].old_date is None and changed[1, 80].old_date == D(2026, 10, 12) and "collision:Labor Day" in changed[1, 30].flags and changed[2, 40].old_date is None


def test_spans_that_fit(spark):
    spans = r.available_spans(fx.terms(spark), fx.no_class(spark)).collect()
    fall = {x.code: (x.label, x.week_one) for x in spans if x.term == "Fall 2026"}
    assert fall["1-3"] == ("Full term (Sessions 1–3)", D(2026, 8, 24)) and fall["2"] == ("Session 2 (5 weeks)", D(2026, 9, 28)) and fall["3"] == ("Session 3 (5 weeks)", D(2026, 11, 9))
    assert [(x.place, x.code, x.label) for x in sorted(spans, key=lambda x: x.place) if x.term == "Summer 2027"] == [(0, "12 weeks", "Full summer term (12 weeks)"), (1, "10 weeks", "10 weeks")]
    short = fx.terms(spark).withColumn("end_date", F.date_sub("end_date", 30))
    assert {x.code for x in r.available_spans(short, fx.no_class(spark)).where("term = 'Fall 2026'").collect()} == {"1-3", "1-2", "1", "2"}
    codes = spark.createDataFrame([("1–3",), (" 2 ",), ("3-2",), (None,)], "c string").select(r.session_code(F.col("c")).alias("s")).collect()
    assert [tuple(x.s) if x.s else None for x in codes] == [(1, 3), (2, 2), None, None]
