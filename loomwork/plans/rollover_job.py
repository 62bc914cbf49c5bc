"""Queries over the outputs of the rollover job."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import rollover_job as job
from loomwork.plans.base import add
from loomwork.plans.rollover import J7_DATES, J7_MISSING, MD, ROLLED
from loomwork.sources import fixtures as fx


def choices(s, d):
    """Of every five courses one has two weeks more, one two fewer; every sixth meets through Fall Break."""
    key = F.col("course_id")
    weeks = F.when(key % 5 == 1, F.col("duration_weeks") + 2).when(key % 5 == 3, F.col("duration_weeks") - 2).cast("int")
    return fx.courses(s, d).where("course_id % 11 > 0").select("course_id", weeks.alias("new_weeks"), F.when(key % 6 == 1, F.array(F.lit("Fall Break"))).alias("through"))


def rolled(s, d):
    return job.roll_over_catalogue(fx.courses(s, d), fx.weeks(s, d), fx.university_dates(s, d), fx.terms(s), fx.no_class(s), choices(s, d))


def swapped(sql: str, *pairs: tuple[str, str]) -> str:
    for old, new in pairs:
        assert old in sql, old
        sql = sql.replace(old, new)
    return sql


#: The schedule of ``e23_rollover`` under those choices: other weeks (wx), breaks that are met through left out, and rows for
#: breaks that were stepped over.
JOB = swapped(
    ROLLED,
    ("fx_weeks", "wx"),
    ("WITH RECURSIVE ", """WITH RECURSIVE ch AS (SELECT course_id, CASE WHEN course_id % 11 > 0 THEN CASE course_id % 5 WHEN 1 THEN duration_weeks + 2 WHEN 3 THEN duration_weeks - 2 END END::INT AS asked, course_id % 11 > 0 AND course_id % 6 = 1 AS thr, duration_weeks, coalesce(asked, duration_weeks) AS new_weeks FROM fx_courses),
      wx AS (SELECT w.* FROM fx_weeks w JOIN ch USING (course_id) WHERE CASE WHEN is_break THEN NOT thr ELSE week_number <= new_weeks END
        UNION ALL SELECT course_id, (n * 10)::INT, n::INT, NULL, NULL, NULL, 'Week ' || n, false, NULL, NULL, 'Placeholder: add topics' FROM (SELECT course_id, unnest(generate_series(duration_weeks + 1, new_weeks)) AS n FROM ch WHERE new_weeks > duration_weeks)),
      """),
    ("q AS (SELECT p.*, course_id IN (SELECT course_id FROM men) AS own FROM p WHERE", "q AS (SELECT p.*, thr, ch.new_weeks, course_id IN (SELECT course_id FROM men) AS own FROM p JOIN ch USING (course_id) WHERE"),
    ("g AS (SELECT target_term, days, i,", "g AS (SELECT target_term, days, thr, i,"),
    ("b.date_start IS NOT NULL AND NOT EXISTS", "b.date_start IS NOT NULL AND NOT (thr AND b.label = 'Fall Break') AND NOT EXISTS"),
    ("FROM (SELECT DISTINCT target_term, days, week_one FROM q)", "FROM (SELECT DISTINCT target_term, days, week_one, thr FROM q)"),
    ("g.days = q.days AND g.i", "g.days = q.days AND g.thr = q.thr AND g.i"),
    ("BETWEEN coalesce(c.day, c.date_start) AND coalesce(c.day, c.date_end)", "BETWEEN coalesce(c.day, c.date_start) AND coalesce(c.day, c.date_end) AND NOT (course_id IN (SELECT course_id FROM ch WHERE thr) AND c.label = 'Fall Break')"),
    ("course_id IN (SELECT course_id FROM wx WHERE is_break)", "course_id IN (SELECT course_id FROM fx_weeks WHERE is_break)"),
    ("AND date_start <= hi AND date_end >= lo", "AND date_start <= hi AND date_end >= lo AND NOT (course_id IN (SELECT course_id FROM ch WHERE thr) AND label = 'Fall Break')"),
    ("(w.day - min(w.day) OVER (PARTITION BY w.course_id, w.week_number))::INT AS since", "coalesce((w.day - min(w.day) OVER (PARTITION BY w.course_id, w.week_number))::INT, 0) AS since"),
    ("      rolled AS (", f"""      so AS (SELECT DISTINCT w.course_id, b.label, b.date_start AS s, b.date_end AS e FROM walk w JOIN q USING (course_id), fx_no_class b WHERE NOT w.placed AND b.term = q.target_term AND b.date_start IS NOT NULL AND NOT (q.thr AND b.label = 'Fall Break') AND NOT EXISTS (
          SELECT 1 FROM range(0, 7) o(j) WHERE list_contains(CASE WHEN len(days) > 0 THEN days ELSE [0,1,2,3,4] END, (isodow((w.start + o.j::INT)::DATE) - 1)::INT) AND NOT (w.start + o.j::INT)::DATE BETWEEN b.date_start AND b.date_end)),
      ad AS (SELECT course_id, (2000 + row_number() OVER (PARTITION BY course_id ORDER BY s))::INT AS row_no, label || ' (' || {MD.format('s')} || ' - ' || {MD.format('e')} || ')' AS label, s, e FROM so WHERE NOT EXISTS (SELECT 1 FROM br WHERE br.course_id = so.course_id AND br.s = so.s AND br.e = so.e)),
      rolled AS (SELECT course_id, row_no, NULL::INT AS week_number, label, true AS is_break, NULL::DATE AS old_day, s AS new_day, e AS new_end FROM ad UNION ALL """),
)

add("e23_job_schedule", lambda s, d: rolled(s, d).schedule.select("course_id", "row_no", "week_number", "label", "is_break", F.col("day").alias("new_date"), "date_end", F.coalesce(F.array_join("topics", "|"), F.lit("")).alias("topics"), "notes"),
    f"""{JOB} SELECT f.course_id, f.row_no, f.week_number, f.label, f.is_break, f.new_day AS new_date, f.new_end AS date_end, coalesce(array_to_string(w.topics, '|'), '') AS topics, w.notes FROM flagged f LEFT JOIN wx w USING (course_id, row_no)""")
add("e23_job_changes", lambda s, d: rolled(s, d).changes,
    f"{JOB} SELECT f.course_id, f.row_no, f.week_number, f.label, coalesce(f.old_day, w.date_start) AS old_date, f.new_day AS new_date, f.flags FROM flagged f LEFT JOIN wx w USING (course_id, row_no)")
add("e23_job_courses", lambda s, d: rolled(s, d).courses,
    f"""{JOB} SELECT q.course_id, q.target_term AS term, q.week_one AS term_start, arg_max(coalesce(f.new_end, f.new_day), (f.new_day, f.is_break, f.row_no)) AS term_end, q.new_weeks AS duration_weeks FROM q JOIN flagged f USING (course_id) GROUP BY ALL""")
UNMATCHED = "SELECT course_id, 'unmatched_date', event FROM ({0}) WHERE flag = 'unmatched' UNION ALL SELECT course_id, 'missing_holiday', label FROM ({1})"
add("e23_job_flags", lambda s, d: rolled(s, d).flags,
    f"""{JOB},
      lastday AS (SELECT nd.course_id, max(new_day) AS last, arg_max(week_number, (new_day, week_number)) AS n, any_value(q.target_end) AS over FROM nd JOIN q USING (course_id) WHERE nd.course_id IN (SELECT course_id FROM so) GROUP BY 1)
    SELECT course_id, 'duration_changed' AS flag, duration_weeks || ' to ' || new_weeks AS detail FROM q WHERE duration_weeks <> new_weeks
    UNION ALL SELECT course_id, 'meeting_count_differs', NULL FROM tw JOIN wo USING (course_id) JOIN q USING (course_id) WHERE len(q.days) > 0 AND len(l) <> len(q.days)
    UNION ALL SELECT course_id, 'break_not_taken', 'Fall Break' FROM fx_weeks JOIN q USING (course_id) WHERE is_break AND thr
    UNION ALL SELECT q.course_id, 'breaks_replaced', coalesce(string_agg(DISTINCT br.name, ',' ORDER BY br.name), '') FROM q LEFT JOIN br USING (course_id) WHERE season_change AND q.course_id IN (SELECT course_id FROM fx_weeks WHERE is_break) GROUP BY 1
    UNION ALL SELECT course_id, 'break_stepped_over', label FROM so
    UNION ALL SELECT course_id, 'past_term_end', n::VARCHAR FROM lastday WHERE last > over
    UNION ALL {UNMATCHED.format(J7_DATES, J7_MISSING)}""")  # fmt: skip
