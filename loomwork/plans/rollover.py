"""Queries over courses, calendars and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import terms as t
from loomwork.operators import checks as c
from loomwork.operators import rollover as r
from loomwork.plans.base import add
from loomwork.sources import fixtures as fx

DAYS = "CASE meeting_pattern WHEN 'MWF 9:00-9:50' THEN [0,2,4] WHEN 'Wednesday' THEN [2] WHEN 'Online' THEN []::INT[] ELSE [1,3] END"
SEASON = "nullif(regexp_extract({0}, '(Fall|Spring|Summer)', 1), '')"
PLAIN = "trim(regexp_replace(lower({0}), '[^a-z ]', '', 'g'))"
KEY = PLAIN.format("regexp_replace({0}, '(\\s*\\([^)]*\\))+\\s*$|\\s+[-–—:]\\s.*$', '')")
MATCH = f"({PLAIN.format('{0}')} <> '' AND {PLAIN.format('{1}')} <> '' AND (contains({PLAIN.format('{0}')}, {PLAIN.format('{1}')}) OR contains({PLAIN.format('{1}')}, {PLAIN.format('{0}')})))"
MD = "month({0}) || '/' || day({0})"
PLAN = f"""p AS (SELECT c.*, n.start_date AS week_one, n.end_date AS target_end, o.start_date AS old_start, {DAYS} AS days,
    coalesce({SEASON.format('c.term')} <> {SEASON.format('c.target_term')}, false) AS season_change FROM fx_courses c LEFT JOIN fx_terms n ON n.term = c.target_term LEFT JOIN fx_terms o ON o.term = c.term)"""


def planned(s, d):
    return r.plan(fx.courses(s, d), fx.terms(s), fx.no_class(s))


def dated(s, d):
    """Schedule rows with their term's calendar and meeting days."""
    course = planned(s, d).select("course_id", F.col("term").alias("target_term"), "days")
    return fx.weeks(s, d).where("not is_break").join(course, "course_id").withColumn("one_a_week", F.pmod("course_id", F.lit(4)) != 0)


add("fx_courses", fx.courses, "SELECT * FROM fx_courses")
add("fx_weeks", lambda s, d: fx.weeks(s, d).withColumns({k: F.array_join(k, "|") for k in ("topics", "assignments")}), "SELECT * REPLACE (array_to_string(topics, '|') AS topics, array_to_string(assignments, '|') AS assignments) FROM fx_weeks")
add("fx_university_dates", fx.university_dates, "SELECT * FROM fx_university_dates")
#: Each row's first two neighbouring words that name a break.
NAMED = ", ".join(f"'{name}'" for name in (*(f"{x} break" for x in t.BREAK_NAMES), *t.NO_CLASSES))
MENTIONS = f"""SELECT course_id, row_no, week_number, list_filter(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]), lambda p: lower(p) IN ({NAMED}))[1] AS mention
      FROM (SELECT course_id, row_no, week_number, string_split(concat_ws(' ', array_to_string(topics, ' '), array_to_string(assignments, ' '), notes), ' ') AS w FROM fx_weeks WHERE NOT is_break)"""

add("j1_target_term", lambda s, d: r.look_up_target(fx.courses(s, d), fx.terms(s)).select("course_id", "target_term", "week_one", "target_end", "error_code"),
    f"WITH {PLAN} SELECT course_id, target_term, week_one, target_end, CASE WHEN week_one IS NULL THEN 'no_week_one' END AS error_code FROM p")
add("w13_suggested_term", lambda s, d: r.next_terms(fx.terms(s), fx.courses(s, d)),
    """WITH l AS (SELECT term, lead(term) OVER (ORDER BY pos) AS after FROM fx_terms)
    SELECT course_id, c.term, coalesce(s.term, l.after) AS suggested_term FROM fx_courses c LEFT JOIN fx_terms s ON s.term = split_part(c.term, ' ', 1) || ' ' || (split_part(c.term, ' ', 2)::INT + 1) LEFT JOIN l ON l.term = c.term""")  # fmt: skip
add("a9_week_count", lambda s, d: r.week_counts(fx.weeks(s, d)), "SELECT course_id, count(DISTINCT CASE WHEN NOT is_break THEN week_number END) AS week_count FROM fx_weeks GROUP BY 1")
add("p5_numbered_breaks", lambda s, d: r.numbered_break(fx.weeks(s, d)),
    f"""SELECT course_id, row_no, week_number, mention FROM ({MENTIONS}) WHERE mention IS NOT NULL""")
add("w1_meetings", lambda s, d: r.number_meetings(fx.weeks(s, d)).select("course_id", "row_no", "week_number", "meeting"),
    """WITH n AS (SELECT course_id, row_no, week_number, is_break, row_number() OVER (PARTITION BY course_id, week_number ORDER BY row_no) AS nth, count(*) FILTER (NOT is_break) OVER (PARTITION BY course_id, week_number) AS k FROM fx_weeks)
    SELECT course_id, row_no, week_number, CASE WHEN NOT is_break AND max(CASE WHEN NOT is_break THEN k END) OVER (PARTITION BY course_id) > 1 THEN nth::INT END AS meeting FROM n""")  # fmt: skip
add("w8_schedule_days", lambda s, d: r.usual_weekdays(fx.weeks(s, d)).withColumn("schedule_days", F.array_join(F.transform("schedule_days", lambda x: x.cast("string")), ",")),
    """WITH w AS (SELECT course_id, week_number, array_to_string(list_sort(list_distinct(list(isodow(day) - 1))), ',') AS days, len(list_distinct(list(isodow(day)))) AS n, min(row_no) AS first FROM fx_weeks WHERE NOT is_break GROUP BY ALL),
      f AS (SELECT *, max(n) OVER (PARTITION BY course_id) AS m FROM w), g AS (SELECT course_id, days, count(*) AS c, min(first) AS first FROM f WHERE n = m GROUP BY ALL)
    SELECT course_id, days AS schedule_days FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY c DESC, first) AS k FROM g) WHERE k = 1""")  # fmt: skip
add("w8_usual_weekday", lambda s, d: r.usual_row_weekday(fx.weeks(s, d)),
    """WITH g AS (SELECT course_id, (isodow(day) - 1)::INT AS d, count(*) AS n FROM fx_weeks WHERE NOT is_break GROUP BY ALL),
      b AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY n DESC, d) AS k, sum(n) OVER (PARTITION BY course_id) AS a FROM g)
    SELECT course_id, CASE WHEN n >= 0.75 * a THEN d END AS usual_day FROM b WHERE k = 1""")  # fmt: skip
add("t2_adjusted_weeks", lambda s, d: r.adjust_weeks(fx.weeks(s, d), fx.courses(s, d).select("course_id", (5 + F.col("course_id") % 7 * 2).cast("int").alias("new_weeks"))).select("course_id", "row_no", "week_number", "label", "day", "notes"),
    """WITH n AS (SELECT course_id, (5 + course_id % 7 * 2)::INT AS new_weeks FROM fx_courses), r AS (SELECT *, dense_rank() OVER (PARTITION BY course_id ORDER BY week_number) AS nth FROM fx_weeks WHERE NOT is_break),
      k AS (SELECT course_id, count(DISTINCT week_number)::INT AS c FROM fx_weeks WHERE NOT is_break GROUP BY 1)
    SELECT course_id, row_no, week_number, label, day, notes FROM r JOIN n USING (course_id) WHERE nth <= new_weeks
    UNION ALL SELECT course_id, (w * 10)::INT, w::INT, 'Week ' || w, NULL, 'Placeholder: add topics' FROM (SELECT course_id, unnest(generate_series(coalesce(c, 0) + 1, new_weeks)) AS w FROM n LEFT JOIN k USING (course_id) WHERE new_weeks > coalesce(c, 0))""")  # fmt: skip
add("w12_week_starts", lambda s, d: r.plan_week_starts(planned(s, d).select("course_id", "week_one", "days", "breaks"), fx.weeks(s, d)),
    f"""WITH RECURSIVE {PLAN},
      n AS (SELECT course_id, week_number, row_number() OVER (PARTITION BY course_id ORDER BY week_number) AS k FROM (SELECT DISTINCT course_id, week_number FROM fx_weeks WHERE NOT is_break)),
      g AS (SELECT target_term, days, i, (week_one + (7 * i)::INT)::DATE AS start, EXISTS (SELECT 1 FROM fx_no_class b WHERE b.term = target_term AND b.date_start IS NOT NULL AND NOT EXISTS (
              SELECT 1 FROM range(0, 7) o(j) WHERE list_contains(CASE WHEN len(days) > 0 THEN days ELSE [0,1,2,3,4] END, (isodow((week_one + (7 * i + o.j)::INT)::DATE) - 1)::INT)
                AND NOT (week_one + (7 * i + o.j)::INT)::DATE BETWEEN b.date_start AND b.date_end)) AS hit
            FROM (SELECT DISTINCT target_term, days, week_one FROM p WHERE week_one IS NOT NULL), range(0, 80) r(i)),
      walk AS (
        SELECT course_id, 0::BIGINT AS k, NULL::INT AS week_number, NULL::DATE AS start, 0::BIGINT AS shift, true AS placed FROM p WHERE week_one IS NOT NULL
        UNION ALL
        SELECT w.course_id, n.k, n.week_number, g.start, w.shift + g.hit::INT, NOT g.hit FROM walk w JOIN p USING (course_id)
          JOIN n ON n.course_id = w.course_id AND n.k = CASE WHEN w.placed THEN w.k + 1 ELSE w.k END JOIN g ON g.target_term = p.target_term AND g.days = p.days AND g.i = n.week_number - 1 + w.shift)
    SELECT course_id, week_number, start, shift::INT AS shift FROM walk WHERE placed AND k > 0""")  # fmt: skip
add("j2_collisions", lambda s, d: r.collisions(dated(s, d), fx.no_class(s)),
    f"""WITH w AS (SELECT w.course_id, row_no, week_number, term, day, {DAYS} AS days FROM fx_weeks w JOIN fx_courses USING (course_id) WHERE NOT is_break),
      e AS (SELECT course_id, row_no, week_number, term, unnest(CASE WHEN course_id % 4 <> 0 AND len(days) > 0 THEN list_transform(days, lambda x: (day - (isodow(day) - 1)::INT + x)::DATE) ELSE [day] END) AS class_day FROM w)
    SELECT course_id, row_no, week_number, label, min(class_day) AS first_hit FROM e JOIN fx_no_class n USING (term) WHERE class_day BETWEEN coalesce(n.day, date_start) AND coalesce(n.day, date_end) GROUP BY ALL""")  # fmt: skip
add("p6_clock_change", lambda s, d: r.dst_weeks(fx.weeks(s, d), fx.courses(s, d)),
    """WITH w AS (SELECT course_id, row_no, week_number, day, (make_date(year(day), 11, 1) + ((7 - isodow(make_date(year(day), 11, 1))) % 7)::INT)::DATE AS clock_change FROM fx_weeks JOIN fx_courses USING (course_id) WHERE source_format = 'markdown' AND NOT is_break AND len(assignments) > 0)
    SELECT course_id, row_no, week_number, clock_change FROM w WHERE abs(day - clock_change) <= 14""")  # fmt: skip
add("p10_past_term_end", lambda s, d: r.past_end(fx.weeks(s, d).where("not is_break").join(fx.courses(s, d).join(F.broadcast(fx.terms(s).select("term", F.date_sub("end_date", 30).alias("target_end"))), "term").select("course_id", "target_end"), "course_id")),
    """WITH w AS (SELECT course_id, week_number, day, end_date - 30 AS target_end FROM fx_weeks JOIN fx_courses USING (course_id) JOIN fx_terms USING (term) WHERE NOT is_break)
    SELECT course_id, arg_max(week_number, day) AS week_number, max(day) AS last_day, max(target_end) AS target_end FROM w GROUP BY 1 HAVING max(day) > max(target_end)""")  # fmt: skip
add("j4_moved_breaks", lambda s, d: r.move_breaks(fx.weeks(s, d), planned(s, d).where("week_one is not null"), fx.no_class(s)),
    f"""WITH {PLAN}, b AS (SELECT w.course_id, row_no, w.label, w.date_start, w.date_end, week_one - old_start AS o, n.label AS name, n.date_start AS s, n.date_end AS e, {MATCH.format('w.label', 'n.label')} AS m
        FROM fx_weeks w JOIN p USING (course_id) LEFT JOIN fx_no_class n ON n.term = target_term AND n.date_start IS NOT NULL WHERE is_break AND week_one IS NOT NULL),
      k AS (SELECT *, row_number() OVER (PARTITION BY course_id, row_no ORDER BY coalesce(m, false) DESC, s) AS i FROM b),
      x AS (SELECT course_id, row_no, coalesce(m, false) AS matched, CASE WHEN m THEN s ELSE (date_start + o::INT)::DATE END AS date_start, CASE WHEN m THEN e ELSE (date_end + o::INT)::DATE END AS date_end, CASE WHEN m THEN name ELSE trim(regexp_replace(label, '\\s*\\([^)]*\\)\\s*$', '')) END AS name FROM k WHERE i = 1)
    SELECT course_id, row_no, date_start, date_end, name || ' (' || {MD.format('date_start')} || ' - ' || {MD.format('date_end')} || ')' AS label, matched FROM x""")  # fmt: skip
add("j3_overlapping_breaks", lambda s, d: r.overlapping_breaks(dated(s, d), fx.no_class(s)),
    """WITH e AS (SELECT course_id, term, min(day) AS lo, max(day) + 6 AS hi FROM fx_weeks JOIN fx_courses USING (course_id) WHERE NOT is_break GROUP BY ALL)
    SELECT course_id, label, date_start, date_end FROM e JOIN fx_no_class USING (term) WHERE date_start <= hi AND date_end >= lo""")  # fmt: skip
add("t1_schedule_end", lambda s, d: r.term_ends(fx.weeks(s, d)),
    "SELECT course_id, arg_max(coalesce(day, date_end), (coalesce(day, date_start), is_break, row_no)) AS schedule_end, count(*) AS rows FROM fx_weeks GROUP BY 1")
add("w10_session_starts", lambda s, d: r.session_starts(fx.terms(s), fx.no_class(s)).join(fx.courses(s, d).groupBy("term").agg(F.count("*").alias("courses")), "term"),
    """WITH s AS (SELECT term, (start_date + (7 * i)::INT)::DATE AS day FROM fx_terms, range(0, 30) g(i)), f AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM fx_no_class n WHERE n.term = s.term AND s.day BETWEEN date_start AND date_end)),
      k AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY day) AS nth FROM f)
    SELECT term, ((nth - 1) // 5 + 1)::INT AS session, day AS session_start, (SELECT count(*) FROM fx_courses c WHERE c.term = k.term) AS courses FROM k WHERE (nth - 1) % 5 = 0 AND nth <= 15 AND term IN (SELECT term FROM fx_courses)""")  # fmt: skip
add("w11_dated_schedules", lambda s, d: r.date_undated(planned(s, d), fx.weeks(s, d), fx.no_class(s)),
    f"""WITH {PLAN}, r AS (SELECT course_id, row_no, week_number, row_number() OVER (PARTITION BY course_id ORDER BY row_no) AS nth FROM fx_weeks WHERE NOT is_break),
      s AS (SELECT course_id, target_term, (week_one + (7 * i)::INT)::DATE AS day FROM p, range(0, 60) g(i) WHERE week_one IS NOT NULL),
      f AS (SELECT course_id, day, row_number() OVER (PARTITION BY course_id ORDER BY day) AS nth FROM s WHERE NOT EXISTS (SELECT 1 FROM fx_no_class n WHERE n.term = s.target_term AND s.day BETWEEN n.date_start AND n.date_end))
    SELECT course_id, row_no, week_number, day FROM r JOIN f USING (course_id, nth)""")  # fmt: skip
add("w11_break_rows", lambda s, d: r.undated_breaks(r.date_undated(planned(s, d), fx.weeks(s, d), fx.no_class(s)), planned(s, d), fx.no_class(s)),
    f"""WITH {PLAN}, k AS (SELECT course_id, count(*) AS n FROM fx_weeks WHERE NOT is_break GROUP BY 1), s AS (SELECT course_id, target_term, i, (week_one + (7 * i)::INT)::DATE AS day FROM p, range(0, 60) g(i) WHERE week_one IS NOT NULL),
      h AS (SELECT s.*, n.label, n.date_start, n.date_end, count(*) FILTER (n.label IS NULL) OVER (PARTITION BY course_id ORDER BY s.day) AS free FROM s LEFT JOIN fx_no_class n ON n.term = s.target_term AND s.day BETWEEN n.date_start AND n.date_end)
    SELECT DISTINCT course_id, date_start, date_end, label || ' (' || {MD.format('date_start')} || ' - ' || {MD.format('date_end')} || ')' AS label FROM h JOIN k USING (course_id) WHERE label IS NOT NULL AND free < n""")  # fmt: skip
#: Each span of a semester: its place, first and last session.
SPANS = "(VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(r.SPANS)) + ") s(place, first, last)"
OFFERED = f"""sl AS (SELECT term, start_date, end_date, (start_date + 7 * i::INT)::DATE AS d, row_number() OVER (PARTITION BY term ORDER BY i) AS n FROM fx_terms t, range(0, 40) r(i) WHERE NOT EXISTS (SELECT 1 FROM fx_no_class b WHERE b.term = t.term AND b.date_start IS NOT NULL AND (t.start_date + 7 * i::INT)::DATE BETWEEN b.date_start AND b.date_end)),
      se AS (SELECT term, end_date, ((n - 1) / 5 + 1)::INT AS session, d, d + 28 <= end_date AS fits FROM sl WHERE n IN (1, 6, 11) AND term NOT LIKE 'Summer%'),
      sp AS (SELECT term, place, first, last, min(d) AS week_one, bool_and(fits) AS fit FROM se JOIN {SPANS} ON session BETWEEN first AND last GROUP BY ALL HAVING bool_and(fits) OR place = 0),
      offered AS (SELECT term, place::INT AS place, CASE WHEN first = last THEN first::VARCHAR ELSE first || '-' || last END AS code, CASE WHEN place = 0 THEN 'Full term (Sessions 1–3)' ELSE CASE WHEN first = last THEN 'Session ' || first ELSE 'Sessions ' || first || '–' || last END || ' (' || 5 * (last - first + 1) || ' weeks)' END AS label, (5 * (last - first + 1))::INT AS weeks, week_one FROM sp
        UNION ALL SELECT term, unnest([0, 1])::INT, unnest(['12 weeks', '10 weeks']), unnest(['Full summer term (12 weeks)', '10 weeks']), unnest([12, 10])::INT, start_date FROM fx_terms WHERE term LIKE 'Summer%')"""


def short_terms(s):
    """The calendar, and its terms cut short so that late sessions don't fit."""
    c = fx.terms(s)
    return c.unionByName(c.select(F.concat("term", F.lit(" short")).alias("term"), "pos", "start_date", F.date_sub("end_date", 30).alias("end_date")))


add("f7_available_spans", lambda s, d: r.available_spans(fx.terms(s), fx.no_class(s)).join(fx.courses(s, d).select(F.col("target_term").alias("term"), "course_id"), "term"),
    f"WITH {OFFERED} SELECT o.*, course_id FROM offered o JOIN fx_courses c ON c.target_term = o.term")
add("f7_short_terms", lambda s, d: r.available_spans(short_terms(s), fx.no_class(s)).where("term like '% short'").withColumn("term", F.replace("term", F.lit(" short"), F.lit(""))).join(fx.courses(s, d).groupBy("term").agg(F.count("*").alias("courses")), "term").select("term", "code", "weeks", "week_one", "courses"),
    f"""WITH {OFFERED.replace("FROM fx_terms t", "FROM (SELECT * REPLACE ((end_date - 30)::DATE AS end_date) FROM fx_terms) t").replace("SELECT 1 FROM fx_no_class b WHERE b.term = t.term AND", "SELECT 1 FROM fx_no_class b WHERE false AND")}
    SELECT o.term, code, weeks, week_one, courses FROM offered o JOIN (SELECT term, count(*) AS courses FROM fx_courses GROUP BY 1) USING (term)""")  # fmt: skip
add("f7_session_codes", lambda s, d: fx.table(s, d, "orders").select(F.col("o_orderkey").alias("request_id"), r.session_code(F.element_at(F.array(*map(F.lit, ("2", " 1–3 ", "3-1", "2-3", "", "1-1", "two"))), (F.col("o_orderkey") % 7 + 1).cast("int"))).alias("c")).select("request_id", "c.first", "c.last"),
    "SELECT o_orderkey AS request_id, CASE o_orderkey % 7 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 3 THEN 2 END::INT AS first, CASE o_orderkey % 7 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 3 THEN 3 END::INT AS last FROM orders")
GUESS = """CASE WHEN target_term LIKE 'Summer%' THEN CASE WHEN duration_weeks <= 10 THEN '10 weeks' ELSE '12 weeks' END WHEN course_id % 4 + 0.5 < 2 OR duration_weeks = 5 THEN '1' WHEN duration_weeks = 10 THEN '1-2' ELSE '1-3' END"""
add("f17_settled_spans", lambda s, d: r.settled_span(fx.courses(s, d).select("course_id", "target_term", F.col("duration_weeks").alias("week_count"), (F.col("course_id") % 4 + 0.5).alias("credits")), short_terms(s).where("term not like 'Fall 2027' and term not like 'Summer 2027 short' and term not like 'Spring 2027 short'").withColumn("term", F.replace("term", F.lit("Fall 2027 short"), F.lit("Fall 2027"))), fx.no_class(s)),
    f"""WITH {OFFERED.replace("FROM fx_terms t", "FROM (SELECT * REPLACE ((end_date - CASE WHEN term = 'Fall 2027' THEN 30 ELSE 0 END)::DATE AS end_date) FROM fx_terms) t")}, g AS (SELECT course_id, target_term, duration_weeks, {GUESS} AS guess FROM fx_courses)
    SELECT course_id, target_term, guess, coalesce(o.code, w.code) AS session, coalesce(o.label, w.label) AS label, CASE WHEN coalesce(o.code, w.code) = '1-3' THEN duration_weeks ELSE coalesce(o.weeks, w.weeks) END::INT AS weeks, coalesce(o.week_one, w.week_one) AS week_one
    FROM g JOIN offered w ON w.term = target_term AND w.place = 0 LEFT JOIN offered o ON o.term = target_term AND o.code = guess""")  # fmt: skip
add("f17_default_plan", lambda s, d: r.default_plan(fx.courses(s, d).withColumn("credits", F.col("course_id") % 4 + 0.5), fx.weeks(s, d), fx.terms(s)).withColumn("days", F.array_join(F.transform("days", lambda x: x.cast("string")), ",")),
    f"""WITH l AS (SELECT term, lead(term) OVER (ORDER BY pos) AS after FROM fx_terms), w AS (SELECT course_id, week_number, list_sort(list_distinct(list((isodow(day) - 1)::INT))) AS dd, min(row_no) AS first FROM fx_weeks WHERE NOT is_break GROUP BY ALL),
      f AS (SELECT *, max(len(dd)) OVER (PARTITION BY course_id) AS m FROM w), g AS (SELECT course_id, dd, count(*) AS c, min(first) AS first FROM f WHERE len(dd) = m GROUP BY ALL), b AS (SELECT course_id, dd FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY c DESC, first) AS k FROM g) WHERE k = 1)
    SELECT course_id, coalesce(s.term, l.after) AS suggested_term, array_to_string(CASE WHEN len({DAYS}) > 0 THEN {DAYS} ELSE dd END, ',') AS days,
      CASE WHEN c.term LIKE 'Summer%' THEN CASE WHEN duration_weeks <= 10 THEN '10 weeks' ELSE '12 weeks' END WHEN course_id % 4 + 0.5 < 2 OR duration_weeks = 5 THEN '1' WHEN duration_weeks = 10 THEN '1-2' ELSE '1-3' END AS session,
      CASE WHEN c.term LIKE 'Summer%' THEN CASE WHEN duration_weeks <= 10 THEN 10 ELSE 12 END WHEN course_id % 4 + 0.5 < 2 OR duration_weeks = 5 THEN 5 WHEN duration_weeks = 10 THEN 10 ELSE duration_weeks END::INT AS weeks
    FROM fx_courses c JOIN b USING (course_id) LEFT JOIN fx_terms s ON s.term = split_part(c.term, ' ', 1) || ' ' || (split_part(c.term, ' ', 2)::INT + 1) LEFT JOIN l ON l.term = c.term""")  # fmt: skip
def moving(s, d):
    return planned(s, d).where("week_one is not null").select("course_id", "target_term", "old_start", "week_one", "target_end", "season_change")


NAMED = f"""{PLAN}, u AS (SELECT d.*, target_term, week_one, target_end, week_one - old_start AS o, season_change,
        (SELECT arg_min(h.pos, h.pos) FROM fx_no_class h WHERE h.term = target_term AND h.day IS NOT NULL AND {KEY.format('h.label')} = {KEY.format('d.event')}) AS h_pos,
        EXISTS (SELECT 1 FROM fx_no_class h WHERE h.day IS NOT NULL AND {KEY.format('h.label')} = {KEY.format('d.event')}) AS is_holiday,
        (SELECT min(b.pos) FROM fx_no_class b WHERE b.term = target_term AND b.date_start IS NOT NULL AND d.date_start IS NOT NULL AND {MATCH.format('d.event', 'b.label')}) AS b_pos
        FROM fx_university_dates d JOIN p USING (course_id) WHERE week_one IS NOT NULL),
      x AS (SELECT *, CASE WHEN regexp_matches(event, '(?i)\\bbegin') THEN 'begin' WHEN regexp_matches(event, '(?i)\\bend') THEN 'end' WHEN b_pos IS NOT NULL THEN 'break' WHEN h_pos IS NOT NULL AND day IS NOT NULL THEN 'holiday' ELSE 'moved' END AS rule FROM u),
      f AS (SELECT course_id, CASE WHEN n.day IS NULL THEN 'break' ELSE 'holiday' END AS kind, n.label, coalesce(n.day, n.date_start) AS s, n.date_end AS e, row_number() OVER (PARTITION BY course_id, n.day IS NULL ORDER BY n.pos) AS nth FROM p JOIN fx_no_class n ON n.term = target_term
        WHERE season_change AND week_one IS NOT NULL AND NOT EXISTS (SELECT 1 FROM u WHERE u.course_id = p.course_id AND n.pos = CASE WHEN n.day IS NULL THEN u.b_pos ELSE u.h_pos END))"""
J7_DATES = f"""WITH {NAMED}, k AS (SELECT *, CASE WHEN season_change AND rule = 'moved' THEN CASE WHEN date_start IS NOT NULL THEN 'break' WHEN is_holiday THEN 'holiday' END END AS kind FROM x),
      y AS (SELECT k.*, row_number() OVER (PARTITION BY course_id, kind ORDER BY pos) AS nth FROM k),
      z AS (SELECT y.* REPLACE (CASE WHEN f.s IS NULL THEN rule ELSE 'next_' || y.kind END AS rule), f.label, f.s, f.e FROM y LEFT JOIN f ON f.course_id = y.course_id AND f.kind = y.kind AND f.nth = y.nth)
    SELECT course_id, z.pos, coalesce(z.label, event) AS event, rule, CASE rule WHEN 'begin' THEN week_one WHEN 'end' THEN coalesce(target_end, (z.day + o::INT)::DATE) WHEN 'holiday' THEN h.day WHEN 'next_holiday' THEN s WHEN 'moved' THEN (z.day + o::INT)::DATE END AS day,
      CASE rule WHEN 'break' THEN b.date_start WHEN 'next_break' THEN s WHEN 'moved' THEN (z.date_start + o::INT)::DATE END AS date_start, CASE rule WHEN 'break' THEN b.date_end WHEN 'next_break' THEN e WHEN 'moved' THEN (z.date_end + o::INT)::DATE END AS date_end,
      CASE WHEN rule = 'moved' AND season_change THEN 'unmatched' END AS flag
    FROM z LEFT JOIN fx_no_class h ON h.term = target_term AND h.pos = h_pos LEFT JOIN fx_no_class b ON b.term = target_term AND b.pos = b_pos"""
J7_MISSING = f"""WITH {NAMED}, h AS (SELECT course_id, count(*) FILTER (rule = 'moved' AND is_holiday AND date_start IS NULL) AS taken FROM x GROUP BY 1 HAVING bool_or(is_holiday))
    SELECT course_id, (nth - taken)::INT AS nth, label, s AS day FROM f JOIN h USING (course_id) WHERE kind = 'holiday' AND nth > taken"""
add("j7_university_dates", lambda s, d: r.roll_university_dates(fx.university_dates(s, d), moving(s, d), fx.no_class(s)),
    J7_DATES)
add("j7_missing_holidays", lambda s, d: r.missing_holidays(fx.university_dates(s, d), moving(s, d), fx.no_class(s)),
    J7_MISSING)
add("f1_f4_term_functions", lambda s, d: planned(s, d).select("course_id", t.season(F.col("term")).alias("season"), t.year_of(F.col("target_term")).alias("year"), "season_change", F.array_join(F.transform("days", lambda x: x.cast("string")), ",").alias("days"), F.array_join(F.transform(t.class_dates(F.col("week_one"), F.col("days")), lambda x: x.cast("string")), ",").alias("week_days"), t.first_class_day(F.col("week_one"), F.col("days")).alias("first_class"), t.provisional_start(F.col("target_term")).alias("provisional")),
    f"""WITH {PLAN} SELECT course_id, {SEASON.format('term')} AS season, right(target_term, 4)::INT AS year, season_change, array_to_string(days, ',') AS days,
      CASE WHEN len(days) > 0 THEN coalesce(array_to_string(list_transform(days, lambda x: ((week_one - (isodow(week_one) - 1)::INT + x)::DATE)::VARCHAR), ','), '') ELSE coalesce(week_one::VARCHAR, '') END AS week_days,
      CASE WHEN len(days) > 0 THEN list_min(list_transform(days, lambda x: (week_one + ((x - isodow(week_one) + 8) % 7)::INT)::DATE)) ELSE week_one END AS first_class,
      (SELECT (q + ((8 - isodow(q)) % 7)::INT)::DATE FROM (SELECT CASE {SEASON.format('target_term')} WHEN 'Spring' THEN make_date(right(target_term, 4)::INT, 1, 7) WHEN 'Summer' THEN make_date(right(target_term, 4)::INT, 5, 13) ELSE make_date(right(target_term, 4)::INT, 8, 20) END AS q)) AS provisional FROM p""")  # fmt: skip
add("j8_meeting_plan", lambda s, d: r.meeting_plan(fx.weeks(s, d), planned(s, d).where("week_one is not null")).select("course_id", *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("old_days", "days")), F.array_join(F.transform(F.map_entries("pairs"), lambda e: F.concat(e["key"].cast("string"), F.lit(">"), e["value"].cast("string"))), ",").alias("pairs"), "flag"),
    f"""WITH {PLAN}, w AS (SELECT course_id, week_number, list_sort(list_distinct(list(isodow(day) - 1))) AS l, min(row_no) AS first FROM fx_weeks WHERE NOT is_break GROUP BY ALL),
      f AS (SELECT *, max(len(l)) OVER (PARTITION BY course_id) AS m FROM w), g AS (SELECT course_id, l, count(*) AS c, min(first) AS first FROM f WHERE len(l) = m GROUP BY ALL),
      o AS (SELECT course_id, l FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY c DESC, first) AS k FROM g) WHERE k = 1),
      t AS (SELECT course_id, min(day) AS d FROM fx_weeks WHERE NOT is_break GROUP BY 1 HAVING count(*) > count(DISTINCT week_number)),
      x AS (SELECT course_id, l, p.days AS n, list_sort(list_transform(l, lambda c: ((c - isodow(coalesce(old_start, t.d)) + 8) % 7) * 10 + c)) AS a, list_sort(list_transform(p.days, lambda c: ((c - isodow(week_one) + 8) % 7) * 10 + c)) AS b FROM t JOIN o USING (course_id) JOIN p USING (course_id) WHERE week_one IS NOT NULL)
    SELECT course_id, array_to_string(l, ',') AS old_days, coalesce(array_to_string(n, ','), '') AS days,
      CASE WHEN len(a) = len(b) THEN array_to_string(list_transform(range(1, len(a) + 1), lambda i: (a[i] % 10) || '>' || (b[i] % 10)), ',') END AS pairs,
      CASE WHEN len(n) > 0 AND len(n) <> len(l) THEN 'meeting_count_differs' END AS flag FROM x""")  # fmt: skip
def rolled_over(s, d):
    return r.roll_over(fx.courses(s, d), fx.weeks(s, d), fx.terms(s), fx.no_class(s))


ROLLED = f"""WITH RECURSIVE {PLAN},
      men AS (SELECT course_id, row_no FROM ({MENTIONS}) WHERE mention IS NOT NULL),
      q AS (SELECT p.*, course_id IN (SELECT course_id FROM men) AS own FROM p WHERE week_one IS NOT NULL),
      n AS (SELECT course_id, week_number, row_number() OVER (PARTITION BY course_id ORDER BY week_number) AS k FROM (SELECT DISTINCT course_id, week_number FROM fx_weeks WHERE NOT is_break)),
      g AS (SELECT target_term, days, i, (week_one + (7 * i)::INT)::DATE AS start, EXISTS (SELECT 1 FROM fx_no_class b WHERE b.term = target_term AND b.date_start IS NOT NULL AND NOT EXISTS (
              SELECT 1 FROM range(0, 7) o(j) WHERE list_contains(CASE WHEN len(days) > 0 THEN days ELSE [0,1,2,3,4] END, (isodow((week_one + (7 * i + o.j)::INT)::DATE) - 1)::INT)
                AND NOT (week_one + (7 * i + o.j)::INT)::DATE BETWEEN b.date_start AND b.date_end)) AS hit
            FROM (SELECT DISTINCT target_term, days, week_one FROM q), range(0, 80) r(i)),
      walk AS (
        SELECT course_id, 0::BIGINT AS k, NULL::INT AS week_number, NULL::DATE AS start, 0::BIGINT AS shift, true AS placed FROM q
        UNION ALL
        SELECT w.course_id, n.k, n.week_number, g.start, w.shift + (g.hit AND NOT q.own)::INT, NOT (g.hit AND NOT q.own) FROM walk w JOIN q USING (course_id)
          JOIN n ON n.course_id = w.course_id AND n.k = CASE WHEN w.placed THEN w.k + 1 ELSE w.k END JOIN g ON g.target_term = q.target_term AND g.days = q.days AND g.i = n.week_number - 1 + w.shift),
      ww AS (SELECT course_id, week_number, list_sort(list_distinct(list(isodow(day) - 1))) AS l, min(row_no) AS first FROM fx_weeks WHERE NOT is_break GROUP BY ALL),
      wf AS (SELECT *, max(len(l)) OVER (PARTITION BY course_id) AS m FROM ww), wg AS (SELECT course_id, l, count(*) AS c, min(first) AS first FROM wf WHERE len(l) = m GROUP BY ALL),
      wo AS (SELECT course_id, l FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY c DESC, first) AS k FROM wg) WHERE k = 1),
      tw AS (SELECT course_id, min(day) AS d FROM fx_weeks WHERE NOT is_break GROUP BY 1 HAVING count(*) > count(DISTINCT week_number)),
      pr AS (SELECT course_id, list_transform(list_sort(list_transform(l, lambda c: ((c - isodow(coalesce(old_start, tw.d)) + 8) % 7) * 10 + c)), lambda c: c % 10) AS a, list_transform(list_sort(list_transform(days, lambda c: ((c - isodow(week_one) + 8) % 7) * 10 + c)), lambda c: c % 10) AS b FROM tw JOIN wo USING (course_id) JOIN q USING (course_id)),
      mv AS (SELECT w.*, s.start, q.days, q.target_term, q.source_format, count(*) OVER (PARTITION BY w.course_id, w.week_number) AS iw, (w.day - min(w.day) OVER (PARTITION BY w.course_id, w.week_number))::INT AS since
        FROM fx_weeks w JOIN walk s ON s.course_id = w.course_id AND s.week_number = w.week_number AND s.placed AND s.k > 0 JOIN q ON q.course_id = w.course_id WHERE NOT w.is_break),
      mp AS (SELECT mv.*, CASE WHEN len(a) = len(b) THEN b[list_position(a, isodow(day) - 1)] END AS planned, max(iw) OVER (PARTITION BY mv.course_id) = 1 AS once FROM mv LEFT JOIN pr ON pr.course_id = mv.course_id),
      nd AS (SELECT * EXCLUDE (planned, once), coalesce((start + ((planned - isodow(start) + 8) % 7)::INT)::DATE, CASE WHEN once AND len(days) > 0 THEN list_min(list_transform(days, lambda x: (start + ((x - isodow(start) + 8) % 7)::INT)::DATE)) END, (start + since)::DATE) AS new_day FROM mp),
      cd AS (SELECT course_id, row_no, target_term, unnest(CASE WHEN iw = 1 AND len(days) > 0 THEN list_transform(days, lambda x: (new_day - (isodow(new_day) - 1)::INT + x)::DATE) ELSE [new_day] END) AS class_day FROM nd),
      cc AS (SELECT *, (make_date(year(new_day), 11, 1) + ((7 - isodow(make_date(year(new_day), 11, 1))) % 7)::INT)::DATE AS change FROM nd WHERE source_format = 'markdown' AND len(assignments) > 0),
      fl AS (SELECT DISTINCT course_id, row_no, 'collision:' || c.label AS flag FROM cd JOIN fx_no_class c ON c.term = target_term AND class_day BETWEEN coalesce(c.day, c.date_start) AND coalesce(c.day, c.date_end)
        UNION ALL SELECT course_id, row_no, 'numbered_break' FROM men UNION ALL SELECT course_id, row_no, 'clock_change' FROM cc WHERE abs(new_day - change) <= 14),
      fs AS (SELECT course_id, row_no, string_agg(flag, ',' ORDER BY flag) AS flags FROM fl GROUP BY ALL),
      bb AS (SELECT w.course_id, row_no, w.label, w.date_start, w.date_end, week_one - old_start AS o, n.label AS name, n.date_start AS s, n.date_end AS e, coalesce({MATCH.format('w.label', 'n.label')}, false) AS m
        FROM fx_weeks w JOIN q USING (course_id) LEFT JOIN fx_no_class n ON n.term = target_term AND n.date_start IS NOT NULL WHERE is_break AND NOT season_change),
      bk AS (SELECT *, row_number() OVER (PARTITION BY course_id, row_no ORDER BY m DESC, s) AS i FROM bb),
      ends AS (SELECT course_id, nd.target_term, min(new_day) AS lo, max(new_day) + 6 AS hi FROM nd JOIN q USING (course_id) WHERE season_change AND course_id IN (SELECT course_id FROM fx_weeks WHERE is_break) GROUP BY ALL),
      br AS (SELECT course_id, row_no, CASE WHEN m THEN name ELSE trim(regexp_replace(label, '\\s*\\([^)]*\\)\\s*$', '')) END AS name, CASE WHEN m THEN s ELSE (date_start + o::INT)::DATE END AS s, CASE WHEN m THEN e ELSE (date_end + o::INT)::DATE END AS e FROM bk WHERE i = 1
        UNION ALL SELECT course_id, (1000 + row_number() OVER (PARTITION BY course_id ORDER BY date_start))::INT, label, date_start, date_end FROM ends JOIN fx_no_class c ON c.term = target_term AND date_start <= hi AND date_end >= lo),
      rolled AS (SELECT course_id, row_no, week_number, label, false AS is_break, day AS old_day, new_day, NULL::DATE AS new_end FROM nd
        UNION ALL SELECT course_id, row_no, NULL, name || ' (' || {MD.format('s')} || ' - ' || {MD.format('e')} || ')', true, NULL, s, e FROM br),
      flagged AS (SELECT rolled.*, coalesce(flags, '') AS flags FROM rolled LEFT JOIN fs USING (course_id, row_no))"""
add("e23_rollover", rolled_over, f"{ROLLED} SELECT * FROM flagged")
add("e23_events", lambda s, d: r.rollover_events(rolled_over(s, d), fx.courses(s, d), fx.weeks(s, d)),
    f"""{ROLLED}, o AS (SELECT course_id, count(DISTINCT week_number) FILTER (NOT is_break) AS c FROM fx_weeks GROUP BY 1)
    SELECT course_id, 'rollover' AS event_type, c.term AS source_term, c.target_term, o.c AS source_weeks, count(DISTINCT week_number) AS target_weeks, sum(CASE WHEN flags = '' THEN 0 ELSE len(string_split(flags, ',')) END)::BIGINT AS flag_count FROM flagged JOIN fx_courses c USING (course_id) JOIN o USING (course_id) GROUP BY ALL""")  # fmt: skip

add("p1_invalid_weeks", lambda s, d: c.invalid_weeks(fx.weeks(s, d).withColumn("day", F.when(F.col("course_id") % 13 != 0, F.col("day"))).withColumn("date_end", F.when(F.col("course_id") % 9 != 0, F.col("date_end")))),
    """SELECT * FROM (SELECT course_id, row_no, concat_ws(',', CASE WHEN is_break AND (date_start IS NULL OR CASE WHEN course_id % 9 <> 0 THEN date_end END IS NULL) THEN 'break_without_span' END,
      CASE WHEN NOT is_break AND week_number IS NULL THEN 'week_without_number' END, CASE WHEN NOT is_break AND CASE WHEN course_id % 13 <> 0 THEN day END IS NULL THEN 'week_without_date' END) AS reasons FROM fx_weeks) WHERE reasons <> ''""")  # fmt: skip
add("p3_term_consistency", lambda s, d: c.term_consistency(fx.courses(s, d).withColumn("term", F.when(F.col("course_id") % 6 == 0, "Spring 2027").otherwise(F.col("term"))), fx.weeks(s, d)),
    f"""WITH c AS (SELECT course_id, CASE WHEN course_id % 6 = 0 THEN 'Spring 2027' ELSE term END AS term FROM fx_courses), f AS (SELECT course_id, arg_min(day, (day, row_no)) AS first_day FROM fx_weeks WHERE week_number = 1 AND NOT is_break GROUP BY 1),
      j AS (SELECT course_id, term, {SEASON.format('term')} AS said, month(first_day) AS m FROM c LEFT JOIN f USING (course_id)),
      k AS (SELECT *, said IS NULL OR m IS NULL OR CASE said WHEN 'Fall' THEN m BETWEEN 8 AND 11 WHEN 'Spring' THEN m BETWEEN 1 AND 4 ELSE m BETWEEN 5 AND 7 END AS passed FROM j)
    SELECT course_id, term, m::INT AS first_month, passed, CASE WHEN NOT passed THEN CASE WHEN m BETWEEN 8 AND 11 THEN 'Fall' WHEN m BETWEEN 1 AND 4 THEN 'Spring' WHEN m BETWEEN 5 AND 7 THEN 'Summer' ELSE 'Fall' END END AS likely_season FROM k""")  # fmt: skip
add("p4_lists_breaks", lambda s, d: c.lists_breaks(fx.university_dates(s, d).withColumns({"event": F.when((F.col("course_id") % 7 == 0) & (F.col("pos") == 2), "Long weekend").otherwise(F.col("event")), "date_start": F.when(F.col("course_id") % 7 > 0, F.col("date_start"))})), "SELECT course_id, course_id % 7 > 0 AND bool_or(lower(event) LIKE '%break%' OR date_start IS NOT NULL) AS lists_breaks FROM fx_university_dates GROUP BY 1")
add("p7_duration_flags", lambda s, d: c.duration_flags(fx.courses(s, d).withColumn("duration_weeks", (F.col("duration_weeks") + F.when(F.col("course_id") % 8 == 0, 1).otherwise(0)).cast("int")).withColumn("new_weeks", (5 + F.col("course_id") % 7 * 2).cast("int")), fx.weeks(s, d)),
    """WITH c AS (SELECT course_id, (duration_weeks + CASE WHEN course_id % 8 = 0 THEN 1 ELSE 0 END)::INT AS duration_weeks, (5 + course_id % 7 * 2)::INT AS new_weeks FROM fx_courses), k AS (SELECT course_id, count(DISTINCT week_number) AS week_count FROM fx_weeks WHERE NOT is_break GROUP BY 1)
    SELECT course_id, duration_weeks, new_weeks, week_count, duration_weeks <> new_weeks AS duration_changed, duration_weeks <> week_count AS schedule_differs FROM c JOIN k USING (course_id)""")  # fmt: skip
add("p11_course_level", lambda s, d: c.course_levels(fx.courses(s, d)), "SELECT course_id, number, CASE WHEN n >= 6000 THEN 'graduate' WHEN n >= 3000 THEN 'upper' WHEN n IS NOT NULL THEN 'lower' END AS level FROM (SELECT *, try_cast(nullif(regexp_extract(number, '\\b([0-9]{4})\\b', 1), '') AS INT) AS n FROM fx_courses)")
add("p12_calendar_checks", lambda s, d: c.calendar_problems(fx.terms(s), fx.no_class(s).withColumn("date_end", F.when(F.col("label") == "Spring Break", F.to_date(F.lit("2027-05-01"))).otherwise(F.col("date_end")))).join(F.broadcast(fx.courses(s, d).groupBy("term").agg(F.count("*").alias("courses"))), "term"),
    """SELECT n.term, n.pos, n.label, 'outside_term' AS problem, (SELECT count(*) FROM fx_courses c WHERE c.term = n.term) AS courses FROM fx_no_class n WHERE label = 'Spring Break'""")  # fmt: skip
add("a8_weight_warning", lambda s, d: c.weight_warnings(fx.table(s, d, "lineitem").select(F.col("l_orderkey").alias("course_id"), (F.col("l_quantity") / 100).alias("weight"))),
    "SELECT course_id, round(sum(weight), 6) AS total FROM (SELECT l_orderkey AS course_id, l_quantity / 100 AS weight FROM lineitem) GROUP BY 1 HAVING abs(round(sum(weight), 6) - 1) > 0.005")
add("a16_extraction_summary", lambda s, d: c.extraction_summary(fx.courses(s, d), fx.weeks(s, d), fx.university_dates(s, d)),
    """SELECT course_id, (SELECT count(*) FROM fx_weeks w WHERE w.course_id = c.course_id AND NOT is_break) AS week_rows, (SELECT count(*) FROM fx_weeks w WHERE w.course_id = c.course_id AND is_break) AS break_rows,
      (SELECT count(*) FROM fx_university_dates u WHERE u.course_id = c.course_id) AS dates, CASE WHEN meeting_pattern = '' THEN 'meeting_pattern' ELSE '' END AS blank_fields FROM fx_courses c""")  # fmt: skip
add("a16_reading_summary", lambda s, d: c.reading_summary(fx.courses(s, d), fx.weeks(s, d), fx.university_dates(s, d),
        fx.courses(s, d).where("course_id % 3 > 0").select("course_id", F.explode(F.when(F.col("course_id") % 3 == 1, F.array(F.lit(0.5), F.lit(0.5))).otherwise(F.array(F.lit(0.5), F.lit(0.3), F.lit(0.1)))).alias("weight")), fx.courses(s, d).where("course_id % 4 > 0").select("course_id", F.explode(F.sequence(F.lit(1), (F.col("course_id") % 4).cast("int"))))),
    """SELECT course_id, (SELECT count(*) FROM fx_weeks w WHERE w.course_id = c.course_id AND NOT is_break) AS week_rows, (SELECT count(*) FROM fx_weeks w WHERE w.course_id = c.course_id AND is_break) AS break_rows, (SELECT count(*) FROM fx_university_dates u WHERE u.course_id = c.course_id) AS dates,
      CASE course_id % 3 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END::BIGINT AS assessments, CASE course_id % 3 WHEN 1 THEN 1.0 WHEN 2 THEN 0.9 END::DOUBLE AS weight_total, course_id % 3 = 2 AS weight_warning, (course_id % 4)::BIGINT AS objectives, CASE WHEN meeting_pattern = '' THEN 'meeting_pattern' ELSE '' END AS blank_fields FROM fx_courses c""")  # fmt: skip
