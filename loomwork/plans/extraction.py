"""Queries that read syllabi rendered from the catalogue views back into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions import terms as t
from loomwork.operators import extraction as x
from loomwork.plans.base import add
from loomwork.sources import fixtures as fx
from loomwork.sources.files import dealt, settled


def syllabus_lines(s: SparkSession, d: str) -> DataFrame:
    """Courses as lines of markdown: (doc_id, line_no, text)."""
    c, w, u = dealt(fx.courses(s, d), "course_id"), fx.weeks(s, d), fx.university_dates(s, d)
    line = lambda n, text: F.struct(F.lit(n).alias("line_no"), text.alias("text"))
    fixed = [("# ", "title"), ("**Course:** ", "number"), ("Term: ", "term"), ("Meets: ", "meeting_pattern")]
    head = [line(i, F.concat(F.lit(p), c)) for i, (p, c) in enumerate(fixed)]
    texts = ["", "## Learning Objectives", "- Explain things", "2. Build things", "", "## Schedule", "| Week | Date | Topics | Assignments |", "| --- | --- | --- | --- |"]
    head += [line(10 + i, F.lit(v)) for i, v in enumerate(texts)]
    foot = [line(1000 + i, F.lit(v)) for i, v in enumerate(["", "| Event | Date |", "|---|---|"])]
    fixed_lines = c.select(F.col("course_id").alias("doc_id"), F.explode(F.array(*head, *foot)).alias("l")).select("doc_id", "l.*")
    span = lambda a, b: F.concat(t.month_day(F.col(a)), F.lit(" - "), t.month_day(F.col(b)))
    date = F.when(F.col("is_break"), span("date_start", "date_end")).otherwise(t.month_day(F.col("day")))
    week = F.concat_ws(" | ", F.when(F.col("is_break"), "| -").otherwise(F.concat(F.lit("| "), F.col("week_number").cast("string"))), date, F.when(F.col("is_break"), F.col("label")).otherwise(F.array_join("topics", "; ")), F.concat(F.array_join("assignments", "; "), F.lit(" |")))
    event = F.concat_ws(" | ", F.concat(F.lit("| "), F.col("event")), F.concat(F.coalesce(F.concat(t.month_day(F.col("day")), F.lit("/"), F.year("day").cast("string")), span("date_start", "date_end")), F.lit(" |")))
    return fixed_lines.unionByName(w.select(F.col("course_id").alias("doc_id"), (100 + F.col("row_no")).alias("line_no"), week.alias("text"))).unionByName(u.select(F.col("course_id").alias("doc_id"), (2000 + F.col("pos")).alias("line_no"), event.alias("text"))).withColumn("line_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")))


def grading_rows(s: SparkSession, d: str) -> DataFrame:
    """Orders as grading tables: percent in every third, points with a total in another, points alone else."""
    rows = fx.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("q"))
    value = F.when(F.col("l_orderkey") % 3 == 0, F.concat("q", F.lit("%"))).otherwise(F.concat("q", F.lit(" points")))
    items = rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("row_no"), F.concat(F.lit("Part "), "l_linenumber").alias("name"), value.alias("value"))
    total = rows.where("l_orderkey % 3 = 1").select(F.col("l_orderkey").alias("doc_id")).distinct().select("doc_id", F.lit(99).alias("row_no"), F.lit("Total").alias("name"), F.lit("400").alias("value"))
    return items.unionByName(total)


add("e1_schedule", lambda s, d: x.schedule(syllabus_lines(s, d)).select("doc_id", "row_no", "week_number", "day", "date_start", "date_end", "is_break", F.array_join("topics", "|").alias("topics"), F.array_join("assignments", "|").alias("assignments"), "error_code"),
    """SELECT course_id AS doc_id, (row_number() OVER (PARTITION BY course_id ORDER BY row_no))::INT AS row_no, week_number, day, date_start, date_end, is_break, CASE WHEN is_break THEN label ELSE array_to_string(topics, '|') END AS topics,
      array_to_string(assignments, '|') AS assignments, NULL::VARCHAR AS error_code FROM fx_weeks""")  # fmt: skip
add("e4_university_dates", lambda s, d: x.university_dates(syllabus_lines(s, d)).select("doc_id", "pos", "event", "day", "date_start", "date_end"), "SELECT course_id AS doc_id, pos, event, day, date_start, date_end FROM fx_university_dates")
add("f8_front_matter", lambda s, d: x.front_matter(syllabus_lines(s, d)).select("doc_id", "number", "term", "meeting_pattern", "error_code"), "SELECT course_id AS doc_id, number, term, meeting_pattern, NULL::VARCHAR AS error_code FROM fx_courses")
add("w15_objectives", lambda s, d: x.section_lines(settled(syllabus_lines(s, d)), "(?i)objectives"), "SELECT c_custkey AS doc_id, unnest([1, 2])::INT AS pos, unnest(['Explain things', 'Build things']) AS text FROM customer")
add("e3_grading_weights", lambda s, d: x.grading(grading_rows(s, d)),
    """WITH r AS (SELECT l_orderkey, l_linenumber, max(l_quantity)::INT AS q FROM lineitem GROUP BY ALL)
    SELECT l_orderkey AS doc_id, l_linenumber AS row_no, 'Part ' || l_linenumber AS name, least(round_even(CASE l_orderkey % 3 WHEN 0 THEN q / 100 WHEN 1 THEN q / 400 ELSE q / sum(q) OVER (PARTITION BY l_orderkey) END, 4), 1.0) AS weight FROM r""")  # fmt: skip


def grading_cells(s: SparkSession, d: str) -> DataFrame:
    """Orders as grading tables with and without headers, in percent and in points, with and without a total."""
    rows = fx.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("row_no")).agg(F.max("l_quantity").cast("int").cast("string").alias("q"))
    name, kind = F.concat(F.lit("Part "), "row_no"), F.col("doc_id") % 4
    cells = F.when(kind == 0, F.array(name, F.lit("note"), F.concat("q", F.lit(" %")))).when(kind == 1, F.array(name, F.concat(F.lit("1,0"), F.lpad("q", 2, "0")))).when(kind == 2, F.array(name, F.concat("q", F.lit(" pts")))).otherwise(F.array(name, F.concat("q", F.lit("%"))))
    items = rows.select("doc_id", F.lit(1).alias("table_no"), "row_no", cells.alias("cells"))
    heads = rows.where("doc_id % 4 < 2").select("doc_id").distinct().select("doc_id", F.lit(1).alias("table_no"), F.lit(0).alias("row_no"), F.when(kind == 0, F.array(*map(F.lit, ("Item", "Points", "Weight")))).otherwise(F.array(*map(F.lit, ("Item", "Points")))).alias("cells"))
    totals = rows.where("doc_id % 4 = 1 and doc_id % 3 = 0").select("doc_id").distinct().select("doc_id", F.lit(1).alias("table_no"), F.lit(99).alias("row_no"), F.array(F.lit("Total points"), F.lit("8,000")).alias("cells"))
    return items.unionByName(heads).unionByName(totals)


add("f12_grading_tables", lambda s, d: x.grading_tables(grading_cells(s, d)),
    """WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber::INT AS row_no, max(l_quantity)::INT AS q FROM lineitem GROUP BY ALL), v AS (SELECT *, CASE WHEN doc_id % 4 = 1 THEN 1000 + q ELSE q END::DOUBLE AS n FROM r)
    SELECT doc_id, 1 AS table_no, row_no, 'Part ' || row_no AS name, CASE WHEN doc_id % 4 IN (0, 3) THEN 'percent' ELSE 'points' END AS unit,
      CASE WHEN doc_id % 4 IN (0, 3) THEN n / 100 ELSE least(round_even(n / CASE WHEN doc_id % 4 = 1 AND doc_id % 3 = 0 THEN 8000 ELSE sum(n) OVER (PARTITION BY doc_id) END, 4), 1.0) END AS weight FROM v""")  # fmt: skip
add("w2_new_year", lambda s, d: x.roll_new_year(fx.table(s, d, "orders").select(F.col("o_custkey").alias("doc_id"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).alias("row_no"), F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 2 == 0).alias("is_spring"))),
    """WITH RECURSIVE o AS (SELECT o_custkey AS doc_id, o_orderdate::DATE AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_no FROM orders),
      walk AS (SELECT doc_id, row_no, 0 AS extra, day FROM o WHERE row_no = 1 UNION ALL
        SELECT o.doc_id, o.row_no, w.extra + (w.day - (o.day + to_months(12 * w.extra))::DATE > 180)::INT, (o.day + to_months(12 * (w.extra + (w.day - (o.day + to_months(12 * w.extra))::DATE > 180)::INT)))::DATE FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.row_no = w.row_no + 1)
    SELECT doc_id, row_no::INT AS row_no, CASE WHEN doc_id % 2 = 0 THEN (day - to_months(12 * max(extra) OVER (PARTITION BY doc_id)))::DATE ELSE day END AS day FROM walk""")  # fmt: skip
def dated_rows(s: SparkSession, d: str) -> DataFrame:
    """Orders as schedule rows: a day, a span of up to 400 days, both, or nothing."""
    o = fx.table(s, d, "orders")
    day, kind = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    return o.select(
        F.col("o_custkey").alias("doc_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("row_no"), F.when(kind.isin(0, 2), day).alias("day"),
        F.when(kind.isin(1, 2), F.date_add(day, 3)).alias("date_start"), F.when(kind.isin(1, 2), F.date_add(day, -(F.col("o_orderkey") % 400).cast("int"))).alias("date_end"), (F.col("o_custkey") % 2 == 0).alias("is_spring"),
    )


add("w2_all_dates", lambda s, d: x.roll_dates(dated_rows(s, d)),
    """WITH RECURSIVE r AS (SELECT o_custkey AS doc_id, o_orderkey AS k, o_orderdate::DATE AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_no FROM orders),
      e AS (SELECT doc_id, row_no, 0 AS place, day FROM r WHERE k % 4 IN (0, 2) UNION ALL SELECT doc_id, row_no, 1, day + 3 FROM r WHERE k % 4 IN (1, 2) UNION ALL SELECT doc_id, row_no, 2, day - (k % 400)::INT FROM r WHERE k % 4 IN (1, 2)),
      o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row_no, place) AS n FROM e),
      walk AS (SELECT doc_id, row_no, place, n, 0 AS extra, day FROM o WHERE n = 1 UNION ALL
        SELECT o.doc_id, o.row_no, o.place, o.n, w.extra + (w.day - (o.day + to_months(12 * w.extra))::DATE > 180)::INT, (o.day + to_months(12 * (w.extra + (w.day - (o.day + to_months(12 * w.extra))::DATE > 180)::INT)))::DATE FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.n = w.n + 1),
      f AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN (day - to_months(12 * max(extra) OVER (PARTITION BY doc_id)))::DATE ELSE day END AS d FROM walk)
    SELECT r.doc_id, r.row_no::INT AS row_no, max(d) FILTER (place = 0) AS day, max(d) FILTER (place = 1) AS date_start, max(d) FILTER (place = 2) AS date_end FROM r LEFT JOIN f ON f.doc_id = r.doc_id AND f.row_no = r.row_no GROUP BY ALL""")  # fmt: skip
add("f10_week_labels", lambda s, d: fx.weeks(s, d).where("not is_break").select("course_id", "row_no", x.week_label(F.when(F.col("row_no") % 3 == 0, F.concat("label", F.lit(" ("), t.month_day(F.col("day")), F.lit(")"))).when(F.col("row_no") % 3 == 1, F.concat("label", F.lit(" ("), F.date_format("day", "MMM. d"), F.lit(")"))).otherwise(F.col("label")), F.year("day")).alias("l")).select("course_id", "row_no", "l.*"),
    "SELECT course_id, row_no, week_number, CASE WHEN row_no % 3 < 2 THEN day END AS day, CASE row_no % 3 WHEN 0 THEN 'm/d' WHEN 1 THEN 'Mon. d' ELSE 'undated' END AS style FROM fx_weeks WHERE NOT is_break")
add("e7_course_brief", lambda s, d: x.brief(fx.courses(s, d), fx.weeks(s, d), fx.university_dates(s, d)),
    """WITH p AS (SELECT course_id, string_agg('- ' || label || CASE WHEN is_break THEN '' ELSE ': ' || array_to_string(topics, '; ') END, chr(10) ORDER BY row_no) AS plan FROM fx_weeks GROUP BY 1),
      e AS (SELECT course_id, string_agg('- ' || event || ': ' || coalesce(day, date_start), chr(10) ORDER BY pos) AS events FROM fx_university_dates GROUP BY 1)
    SELECT course_id, '# ' || title || chr(10) || chr(10) || number || ', ' || term || chr(10) || chr(10) || '## Schedule' || chr(10) || plan || chr(10) || chr(10) || '## Dates' || chr(10) || events AS content FROM fx_courses JOIN p USING (course_id) JOIN e USING (course_id)""")  # fmt: skip
add("e8_course_page", lambda s, d: x.page(fx.courses(s, d), fx.weeks(s, d)),
    """WITH r AS (SELECT course_id, string_agg('<tr><td>' || label || '</td><td>' || array_to_string(topics, '; ') || '</td></tr>', '' ORDER BY row_no) AS rows FROM fx_weeks GROUP BY 1)
    SELECT course_id, '<h1>' || title || '</h1><p>' || number || ', ' || term || ', ' || meeting_pattern || '</p><table>' || rows || '</table>' AS content FROM fx_courses JOIN r USING (course_id)""")  # fmt: skip
add("s4_nested_and_flat", lambda s, d: x.flat(x.nested(fx.courses(s, d), fx.weeks(s, d), fx.university_dates(s, d)), "weeks").select("course_id", "row_no", "week_number", "day", "label", F.array_join("topics", "|").alias("topics")), "SELECT course_id, row_no, week_number, day, label, array_to_string(topics, '|') AS topics FROM fx_weeks")


def rolled(s: SparkSession, d: str) -> DataFrame:
    """Syllabi of all courses a year on, 52 weeks later."""
    c = dealt(fx.courses(s, d), "course_id").select(F.col("course_id").alias("doc_id"), F.concat_ws(" ", t.season(F.col("term")), t.year_of(F.col("term")) + 1).alias("term"))
    on = lambda day: F.date_add(day, 364)
    name = F.array(t.break_label(t.core_name(F.col("label")), on("date_start"), on("date_end")))
    plan = fx.weeks(s, d).select(F.col("course_id").alias("doc_id"), "row_no", "week_number", "is_break", on(F.coalesce("day", "date_start")).alias("day"), on("date_end").alias("day_end"), F.when(F.col("is_break"), name).otherwise(F.col("topics")).alias("topics"), "assignments")
    # every third course's dates lack a row, so they are paired by name
    dates = fx.university_dates(s, d).where("course_id % 3 > 0 or pos <> 3").select(F.col("course_id").alias("doc_id"), "pos", "event", on("day").alias("day"), on("date_start").alias("date_start"), on("date_end").alias("date_end"))
    return x.rolled_lines(syllabus_lines(s, d), plan, c, dates)


add("e6_rolled_syllabi", lambda s, d: x.schedule(rolled(s, d)).select("doc_id", "row_no", "week_number", "is_break", F.coalesce("day", "date_start").alias("day"), "date_end", F.array_join("topics", "|").alias("topics"), "error_code"),
    """SELECT course_id AS doc_id, (row_number() OVER (PARTITION BY course_id ORDER BY row_no))::INT AS row_no, week_number, is_break, (coalesce(day, date_start) + 364)::DATE AS day, (date_end + 364)::DATE AS date_end,
      CASE WHEN is_break THEN 'Fall Break (' || month(date_start + 364) || '/' || day(date_start + 364) || ' - ' || month(date_end + 364) || '/' || day(date_end + 364) || ')' ELSE array_to_string(topics, '|') END AS topics, NULL::VARCHAR AS error_code FROM fx_weeks""")  # fmt: skip
add("e6_rolled_dates", lambda s, d: x.university_dates(rolled(s, d)).select("doc_id", "pos", "event", "day", "date_start", "date_end"),
    "SELECT course_id AS doc_id, pos, event, CASE WHEN course_id % 3 = 0 AND pos = 3 THEN day ELSE (day + 364)::DATE END AS day, (date_start + 364)::DATE AS date_start, (date_end + 364)::DATE AS date_end FROM fx_university_dates")
add("e6_untouched_lines", lambda s, d: rolled(s, d).where("text not like '|%'").groupBy("doc_id").agg(F.count("*").alias("lines"), F.max(F.when(F.rlike("text", F.lit("^Term:")), F.col("text"))).alias("term_line")),
    "SELECT course_id AS doc_id, 11::BIGINT AS lines, 'Term: ' || split_part(term, ' ', 1) || ' ' || (split_part(term, ' ', 2)::INT + 1) AS term_line FROM fx_courses")
add("f10_written_labels", lambda s, d: fx.weeks(s, d).where("not is_break").select("course_id", "row_no", t.written_label(F.col("week_number").cast("string"), F.date_add("day", 364), fx.pick(F.col("row_no") % 5, "m/d", "Mon. d", "Month d", "undated", "Mon d")).alias("label")),
    """SELECT course_id, row_no, 'Week ' || week_number || CASE row_no % 5 WHEN 3 THEN '' ELSE ' (' || CASE row_no % 5 WHEN 0 THEN month(n) || '/' || day(n) WHEN 1 THEN strftime(n, '%b. %-d') WHEN 2 THEN strftime(n, '%B %-d') ELSE strftime(n, '%b %-d') END || ')' END AS label FROM (SELECT *, (day + 364)::DATE AS n FROM fx_weeks WHERE NOT is_break)""")


def header_lines(s: SparkSession, d: str) -> DataFrame:
    """Tops of syllabi in five forms: details in one line, in several, under labels, without a term, with little else."""
    c = fx.courses(s, d)
    key = F.col("course_id")
    forms = F.array(
        F.array(F.concat("number", F.lit("-00"), key % 9 + 1, F.lit(": "), "title", F.lit(" – Online "), "term"), F.lit(""), F.lit("1.5 credit hours"), F.lit("Office Hours: Monday 1 pm"), F.lit("Tuesdays 6:00-9:00 pm CRCC 105")),
        F.array(F.lit("# Syllabus"), F.concat(F.upper("term"), F.lit(" 1234")), F.concat(F.lit("**"), "title", F.lit("** (In-Person)")), F.concat(F.lit("see "), "number", F.lit(", Section 12 of 3 credits"))),
        F.array(F.lit("Course: IS 6640-001"), F.concat(F.lit("Term: "), F.regexp_replace("term", " ", " semester ")), F.concat(F.lit("Title: "), "title"), F.lit("Credits: 3 hours"), F.lit("Meets: MWF 9:00"), F.lit("Other IS 7777 course")),
        F.array(F.lit("About this class"), F.lit("-"), F.lit("Spring fever 2027")),
        F.array(F.lit("Week 12"), F.lit("ab"), F.lit("Term: Fall Semester")),
    )
    return c.select(key.alias("doc_id"), F.posexplode(F.element_at(forms, (key % 5 + 1).cast("int"))).alias("line_no", "text"))


add("f9_header_guesses", lambda s, d: x.header_guesses(header_lines(s, d)),
    """SELECT course_id AS doc_id, CASE course_id % 5 WHEN 3 THEN NULL WHEN 4 THEN 'Fall Semester' ELSE term END AS term, CASE WHEN course_id % 5 < 2 THEN number WHEN course_id % 5 = 2 THEN 'IS 6640' ELSE '' END AS number,
      CASE course_id % 5 WHEN 0 THEN '00' || (course_id % 9 + 1) WHEN 1 THEN '12' WHEN 2 THEN '001' ELSE '' END AS section, CASE course_id % 5 WHEN 1 THEN '1234' WHEN 3 THEN 'About this class' WHEN 4 THEN 'Week 12' ELSE title END AS title,
      CASE course_id % 5 WHEN 0 THEN 1.5 WHEN 1 THEN 3 WHEN 2 THEN 3 END::DOUBLE AS credits, CASE course_id % 5 WHEN 0 THEN 'Tuesdays 6:00-9:00 pm CRCC 105' WHEN 2 THEN 'MWF 9:00' ELSE '' END AS meeting_pattern, CASE WHEN course_id % 5 = 3 THEN 'no_term' END AS error_code FROM fx_courses""")  # fmt: skip
