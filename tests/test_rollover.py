"""Rollover on known calendars: golden dates, invariants, and functions on terms and labels."""

import datetime as dt

from pyspark.sql import functions as F

from loomwork.functions import terms as t
from loomwork.operators import checks as c
from loomwork.operators import rollover as r
from loomwork.sources import fixtures as fx

D = dt.date


def starts(spark, week_one, days, breaks, numbers):
    course = spark.createDataFrame([(1, week_one, days, breaks)], "course_id long, week_one date, days array<int>, breaks array<struct<s:date,e:date,label:string>>")
    weeks = spark.createDataFrame([(1, n, False) for n in numbers], "course_id long, week_number int, is_break boolean")
    return [(x.week_number, x.start, x.shift) for x in r.plan_week_starts(course, weeks).orderBy("week_number").collect()]


def test_weeks_step_over_a_break(spark):
    spring = [(D(2027, 3, 6), D(2027, 3, 14), "Spring Break")]
    assert starts(spark, D(2027, 1, 11), [2], spring, [8, 9, 10]) == [(8, D(2027, 3, 1), 0), (9, D(2027, 3, 15), 1), (10, D(2027, 3, 22), 1)]


def test_only_a_break_over_all_class_days_moves_weeks(spark):
    late = [(D(2026, 11, 26), D(2026, 11, 29), "Thanksgiving Break")]
    assert starts(spark, D(2026, 8, 24), [1, 3], late, [14, 15]) == [(14, D(2026, 11, 23), 0), (15, D(2026, 11, 30), 0)]
    assert starts(spark, D(2026, 8, 24), [3], late, [14, 15]) == [(14, D(2026, 11, 30), 1), (15, D(2026, 12, 7), 1)]
    assert starts(spark, D(2026, 8, 24), [], None, [1, 3]) == [(1, D(2026, 8, 24), 0), (3, D(2026, 9, 7), 0)]


def test_fall_to_fall(spark):
    course = spark.createDataFrame([(1, "IS 1", "Fall 2026", "Fall 2027", 10, "Monday", "word")], "course_id long, number string, term string, target_term string, duration_weeks int, meeting_pattern string, source_format string")
    week = lambda n: (1, n * 10, n, D(2026, 8, 24) + dt.timedelta(7 * (n - 1)), None, None, f"Week {n}", False, ["t"], [], None)
    rows = [week(n) for n in range(1, 11)] + [(1, 75, None, None, D(2026, 10, 10), D(2026, 10, 18), "Fall Break (10/10 - 10/18)", True, [], [], None)]
    weeks = spark.createDataFrame(rows, "course_id long, row_no int, week_number int, day date, date_start date, date_end date, label string, is_break boolean, topics array<string>, assignments array<string>, notes string")
    out = {x.week_number or "break": x for x in r.roll_over(course, weeks, fx.terms(spark), fx.no_class(spark)).collect()}
    assert [out[n].new_day for n in (1, 2, 3, 7, 8)] == [D(2027, 8, 23), D(2027, 8, 30), D(2027, 9, 6), D(2027, 10, 4), D(2027, 10, 18)]
    assert out[3].flags == "collision:Labor Day" and out["break"].label == "Fall Break (10/9 - 10/17)"
    assert len(out) == 11


def test_sessions(spark):
    got = [x.session_start for x in r.session_starts(fx.terms(spark), fx.no_class(spark)).where("term = 'Fall 2026'").orderBy("session").collect()]
    assert got == [D(2026, 8, 24), D(2026, 9, 28), D(2026, 11, 9)]


def test_undated_schedule_skips_the_break(spark):
    course = spark.createDataFrame([(1, "Fall 2026", D(2026, 8, 24))], "course_id long, target_term string, week_one date")
    weeks = spark.createDataFrame([(1, n, n, False) for n in range(1, 9)], "course_id long, row_no int, week_number int, is_break boolean")
    got = {x.week_number: x.day for x in r.date_undated(course, weeks, fx.no_class(spark)).collect()}
    assert got[7] == D(2026, 10, 5) and got[8] == D(2026, 10, 19)


def twice_a_week(spark, days, week_one=D(2026, 8, 24), skip=()):
    """A Tuesday and Thursday class of three weeks in spring, moved to fall."""
    rows = [(1, 10 * w + m, w, D(2026, 1, 20) + dt.timedelta(days=7 * (w - 1) + 2 * m), False) for w in (1, 2, 3) for m in (0, 1) if (w, m) not in skip]
    weeks = spark.createDataFrame(rows, "course_id long, row_no int, week_number int, day date, is_break boolean")
    course = spark.createDataFrame([(1, D(2026, 1, 19), week_one, days, None)], "course_id long, old_start date, week_one date, days array<int>, breaks array<struct<s:date,e:date,label:string>>")
    got = r.new_days(weeks, r.plan_week_starts(course, weeks), course)
    return [x.new_day for x in got.orderBy("row_no").collect()], r.meeting_plan(weeks, course).first()


def test_meetings_move_to_the_days_of_the_new_term(spark):
    assert twice_a_week(spark, [1, 3])[0][:4] == [D(2026, 8, 25), D(2026, 8, 27), D(2026, 9, 1), D(2026, 9, 3)]
    got, plan = twice_a_week(spark, [0, 4])
    assert got[:4] == [D(2026, 8, 24), D(2026, 8, 28), D(2026, 8, 31), D(2026, 9, 4)] and plan.pairs == {1: 0, 3: 4} and plan.flag is None
    assert twice_a_week(spark, [0, 2], week_one=D(2026, 8, 26))[0][:4] == [D(2026, 8, 26), D(2026, 8, 31), D(2026, 9, 2), D(2026, 9, 7)]
    assert twice_a_week(spark, [0, 2], skip=[(2, 0)])[0][2] == D(2026, 9, 2)
    got, plan = twice_a_week(spark, [0, 2, 4])
    assert got[:2] == [D(2026, 8, 24), D(2026, 8, 26)] and plan.pairs is None and plan.flag == "meeting_count_differs"


def test_long_schedules_lose_no_week(spark):
    course = spark.createDataFrame([(1, "Fall 2026", D(2026, 8, 24))], "course_id long, target_term string, week_one date")
    weeks = spark.createDataFrame([(1, n, n, False) for n in range(1, 251)], "course_id long, row_no int, week_number int, is_break boolean")
    got = sorted((x.week_number, x.day) for x in r.date_undated(course, weeks, fx.no_class(spark)).collect())
    assert [n for n, _ in got] == list(range(1, 251)) and all((b[1] - a[1]).days % 7 == 0 and b[1] > a[1] for a, b in zip(got, got[1:]))
    span = spark.createDataFrame([(1, D(2026, 8, 24), [0, 2], [(D(2027, 1, 1), D(2028, 6, 30), "closed")])], "course_id long, week_one date, days array<int>, breaks array<struct<s:date,e:date,label:string>>")
    plan = {x.week_number: (x.start, x.shift) for x in r.plan_week_starts(span, weeks).collect()}
    assert len(plan) == 250 and plan[19] == (D(2026, 12, 28), 0)
    assert all(start + dt.timedelta(days=7) > D(2028, 7, 1) and shift >= 77 for n, (start, shift) in plan.items() if n > 19)


def one(spark, *columns, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'date' if isinstance(v, D) else 'string'}" for k, v in values.items()))
    return tuple(row.select(*columns).first())


def test_term_functions(spark):
    assert one(spark, t.season(F.col("a")), t.year_of(F.col("a")), t.season(F.col("b")), a="FALL 2026", b="Term 3") == ("Fall", 2026, None)
    assert one(spark, t.holiday_key(F.col("a")), t.holiday_key(F.col("b")), t.core_name(F.col("c")), a="Labor Day (no class)", b="Labor Day - no class", c="(x)") == ("labor day", "labor day", "(x)")
    assert one(spark, t.labels_match(F.col("a"), F.col("b")), t.labels_match(F.col("a"), F.col("c")), a="Fall break!", b="Fall Break (10/1)", c="123") == (True, False)
    days = lambda p: one(spark, t.meeting_days(F.col("p")), p=p)[0]
    assert [days(p) for p in ("MWF", "TR 9:00", "TTh", "Tuesdays and Thursdays", "TuThSaSu", "Online", "Monday, Mon")] == [[0, 2, 4], [1, 3], [1, 3], [1, 3], [1, 3, 5, 6], [], [0]]
    assert one(spark, t.provisional_start(F.col("a")), t.provisional_start(F.col("b")), a="Fall 2031", b="Spring 2027") == (D(2031, 8, 25), D(2027, 1, 11))
    assert one(spark, t.slug(F.col("a")), t.escape_html(F.col("b")), a="Week 1: Intro!", b="a&<b>\"'") == ("week-1-intro", "a&amp;&lt;b&gt;&quot;&#x27;")


def test_university_dates_keep_their_rows(spark):
    course = spark.createDataFrame([(1, "Fall 2027", D(2026, 8, 24), D(2027, 8, 23), D(2027, 12, 9))], "course_id long, target_term string, old_start date, week_one date, target_end date")
    rows = [(1, 0, "Classes begin", D(2026, 8, 24), None, None), (1, 1, "Labor Day (no class)", D(2026, 9, 7), None, None), (1, 2, "Fall break", None, D(2026, 10, 10), D(2026, 10, 18)), (1, 3, "Independence Day picnic", D(2026, 9, 1), None, None), (1, 4, "Classes end", D(2026, 12, 10), None, None)]
    dates = spark.createDataFrame(rows, "course_id long, pos int, event string, day date, date_start date, date_end date")
    out = r.roll_university_dates(dates, course, fx.no_class(spark)).orderBy("pos").collect()
    assert [x.rule for x in out] == ["begin", "holiday", "break", "moved", "end"]
    assert [x.day or x.date_start for x in out] == [D(2027, 8, 23), D(2027, 9, 6), D(2027, 10, 9), D(2027, 8, 31), D(2027, 12, 9)]


def test_checks(spark):
    terms = spark.createDataFrame([("A", 0, D(2026, 5, 1), D(2026, 4, 1)), ("B", 1, D(2026, 1, 1), D(2026, 3, 1))], "term string, pos int, start_date date, end_date date")
    none = fx.no_class(spark).where("false")
    assert {(x.term, x.problem) for x in c.calendar_problems(terms, none).collect()} == {("A", "reversed_term"), ("B", "terms_out_of_order")}
    weights = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 0.9)], "course_id long, weight double")
    assert [(x.course_id, x.total) for x in c.weight_warnings(weights).collect()] == [(2, 0.9)]
