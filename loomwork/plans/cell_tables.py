"""Queries over Word tables: schedules written back, tables cleaned up."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import terms as t
from loomwork.operators import cell_tables as c
from loomwork.plans.base import add
from loomwork.plans.text import LINES, document_lines
from loomwork.sources import fixtures as fx


def schedule_cells(s, d):
    """Schedules as two Word tables with headers, a module's title, and labels in three styles."""
    w = fx.weeks(s, d)
    kind = F.col("course_id") % 3
    label = F.when(kind == 0, F.concat("label", F.lit(" ("), t.month_day(F.col("day")), F.lit(")"))).when(kind == 1, F.concat("label", F.lit(" ("), F.date_format("day", "MMM. d"), F.lit(") in class"))).otherwise(F.col("label"))
    table = F.when(F.col("row_no") < 60, 0).otherwise(1)
    own = F.when(F.col("is_break"), F.array(F.concat("label", F.lit("\nkept line")), F.lit("No class today"), F.lit("z"))).otherwise(F.array(label, F.array_join("topics", "; "), F.concat(F.lit("x"), "row_no")))
    rows = w.select(F.col("course_id").alias("doc_id"), table.alias("table_no"), "row_no", own.alias("cells"))
    heads = rows.select("doc_id", "table_no").distinct().select("*", F.lit(0).alias("row_no"), F.array(*map(F.lit, ("Week", "Topics", "Work"))).alias("cells"))
    titles = fx.courses(s, d).select(F.col("course_id").alias("doc_id"), F.lit(0).alias("table_no"), F.lit(5).alias("row_no"), F.array(F.lit("Module A"), F.lit(""), F.lit("")).alias("cells"))
    return rows.unionByName(heads).unionByName(titles)


def new_schedule(s, d):
    """A year on; of every four courses one loses its last week and one has another."""
    w = fx.weeks(s, d).join(fx.courses(s, d).select("course_id", "duration_weeks"), "course_id")
    on = lambda day, n=364: F.date_add(day, n)
    name = t.break_label(t.core_name(F.col("label")), on("date_start"), on("date_end"))
    none = F.lit(None)
    rows = w.where("course_id % 4 <> 1 or is_break or week_number < duration_weeks").select(
        F.col("course_id").alias("doc_id"), "week_number", F.when(~F.col("is_break"), F.col("row_no") % 10 + 1).cast("int").alias("meeting"), "is_break", on("day").alias("day"), on("date_start").alias("date_start"),
        F.when(F.col("is_break"), name).otherwise(F.col("label")).alias("label"), "topics", "assignments", "notes",
    )
    lines = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    last = w.where("course_id % 4 = 2 and week_number = duration_weeks")
    more = last.select(F.col("course_id").alias("doc_id"), (F.col("week_number") + 1).alias("week_number"), F.lit(1).alias("meeting"), F.lit(False).alias("is_break"), on("day", 371).alias("day"), none.cast("date").alias("date_start"), F.lit("").alias("label"), lines("New topic").alias("topics"), lines("New essay due").alias("assignments"), F.lit("bring it").alias("notes"))
    start = w.where("week_number = 1 and row_no = 10 and course_id % 5 = 0")
    extra = start.select(F.col("course_id").alias("doc_id"), none.cast("int").alias("week_number"), none.cast("int").alias("meeting"), F.lit(True).alias("is_break"), none.cast("date").alias("day"), on("day", 374).alias("date_start"), F.lit("Extra break").alias("label"), lines().alias("topics"), lines().alias("assignments"), none.cast("string").alias("notes"))
    return rows.unionByName(more).unionByName(extra)


STYLED = "'Week ' || {n} || CASE course_id % 3 WHEN 0 THEN ' (' || month({d}) || '/' || day({d}) || ')' WHEN 1 THEN strftime({d}, ' (%b. %-d)') ELSE '' END"

add("e24_cell_rollover", lambda s, d: c.rolled_cells(schedule_cells(s, d), new_schedule(s, d)).select("doc_id", "table_no", "row_no", "kind", F.array_join("cells", "|").alias("cells")),
    f"""WITH w AS (SELECT course_id, duration_weeks, CASE WHEN row_no < 60 THEN 0 ELSE 1 END AS tab, row_no, week_number, is_break, (day + 364)::DATE AS d, date_start, label, array_to_string(topics, '; ') AS topics FROM fx_weeks JOIN fx_courses USING (course_id)),
      ends AS (SELECT course_id, max(tab) AS last_tab FROM w GROUP BY 1),
      k AS (SELECT course_id, tab, row_no AS r, 1 AS rank, 0 AS nth, d, {STYLED.format(n='week_number', d='d')} || CASE WHEN course_id % 3 = 1 THEN ' in class' ELSE '' END || '|' || topics || '|x' || row_no AS cells FROM w WHERE NOT is_break AND (course_id % 4 <> 1 OR week_number < duration_weeks)),
      g AS (SELECT course_id, tab, r, 2 AS rank, 1 AS nth, (d + 7)::DATE AS d, {STYLED.format(n='(r // 10 + 1)', d='((d + 7)::DATE)')} || '|New topic' || chr(10) || 'New essay due' || chr(10) || 'Note: bring it|' AS cells FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY r DESC) AS z FROM k) WHERE z = 1 AND course_id % 4 = 2),
      dated AS (SELECT * FROM k UNION ALL SELECT * FROM g),
      b AS (SELECT course_id, date_start + 364 AS s, trim(regexp_replace(label, '\\s*\\([^)]*\\)\\s*$', '')) || ' (' || month(date_start + 364) || '/' || day(date_start + 364) || ' - ' || month(date_start + 372) || '/' || day(date_start + 372) || ')' AS label FROM w WHERE is_break
        UNION ALL SELECT course_id, d + 10, 'Extra break' FROM w WHERE week_number = 1 AND row_no = 10 AND course_id % 5 = 0),
      had AS (SELECT DISTINCT course_id FROM w WHERE is_break),
      n AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY s, label) AS i, course_id IN (SELECT course_id FROM had) AS used FROM b),
      p AS (SELECT n.course_id, i, n.label, used, min({{'tab': tab, 'r': r, 'rank': rank, 'nth': nth}}) FILTER (d > s) AS a FROM n JOIN dated USING (course_id) GROUP BY ALL),
      every AS (SELECT course_id, tab, r, rank, nth, 1000 AS part, 'week' AS kind, cells FROM dated
        UNION ALL SELECT course_id, coalesce(a.tab, last_tab), coalesce(a.r, 100000), CASE WHEN a IS NULL THEN 3 WHEN a.rank = 2 THEN 2 ELSE 0 END, CASE WHEN a.rank = 2 THEN a.nth ELSE 0 END, i, 'break', label || CASE WHEN used THEN chr(10) || 'kept line|No class today|z' ELSE '|No class|' END FROM p JOIN ends USING (course_id)
        UNION ALL SELECT DISTINCT course_id, tab, 0, 1, 0, 1000, 'head', 'Week|Topics|Work' FROM w UNION ALL SELECT course_id, 0, 5, 1, 0, 1000, 'other', 'Module A||' FROM fx_courses)
    SELECT course_id AS doc_id, tab::INT AS table_no, (row_number() OVER (PARTITION BY course_id, tab ORDER BY r, rank, nth, part) - 1)::INT AS row_no, kind, cells FROM every""")  # fmt: skip


def date_cells(s, d):
    """University dates as Word tables; those of every third course lack a row, so they are paired by event."""
    rows = fx.university_dates(s, d).select(F.col("course_id").alias("doc_id"), F.lit(3).alias("table_no"), (F.col("pos") + 1).alias("row_no"), F.array(F.col("event"), F.lit("old"), F.concat(F.lit("room "), "pos")).alias("cells"))
    heads = fx.courses(s, d).select(F.col("course_id").alias("doc_id"), F.explode(F.array(F.lit(2), F.lit(3))).alias("table_no")).select("doc_id", "table_no", F.lit(0).alias("row_no"), F.when(F.col("table_no") == 3, F.array(F.lit("Event "), F.lit("DATE"), F.lit("Where"))).otherwise(F.array(F.lit("Event"), F.lit("x"))).alias("cells"))
    return rows.where("doc_id % 3 > 0 or row_no <> 2").unionByName(heads)


add("e24_cell_dates", lambda s, d: c.rolled_date_cells(date_cells(s, d), fx.university_dates(s, d).select(F.col("course_id").alias("doc_id"), "pos", F.when((F.col("pos") == 2) & (F.col("course_id") % 3 > 0), "Spring Break").otherwise(F.col("event")).alias("event"), *(F.date_add(x, 364).alias(x) for x in ("day", "date_start", "date_end")))).select("doc_id", "table_no", "row_no", F.array_join("cells", "|").alias("cells")),
    """SELECT course_id AS doc_id, 3 AS table_no, (pos + 1)::INT AS row_no, CASE WHEN pos = 2 AND course_id % 3 > 0 THEN 'Spring Break' ELSE event END || '|' || coalesce(month(day + 364) || '/' || day(day + 364) || '/' || year(day + 364), month(date_start + 364) || '/' || day(date_start + 364) || ' - ' || month(date_end + 364) || '/' || day(date_end + 364)) || '|room ' || pos AS cells
    FROM fx_university_dates WHERE course_id % 3 > 0 OR pos <> 1""")  # fmt: skip
add("e17_tidy_rows", lambda s, d: c.tidy_rows(document_lines(s, d).select("doc_id", F.floor(F.col("line_no") / 4).cast("int").alias("item_no"), F.col("line_no").alias("row_no"), F.when(F.col("line_no") % 4 == 3, F.array(F.lit(""), F.concat(F.lit("Week "), "line_no"), F.lit("-"))).when(F.col("line_no") % 4 == 2, F.array(F.lit("–"), F.lit(" "))).otherwise(F.array(F.trim("text"), F.lit("--"), F.when(F.col("doc_id") % 2 == 0, "x").otherwise(""))).alias("cells"))).select("doc_id", "item_no", "row_no", F.array_join("cells", "|").alias("cells"), "is_real"),
    f"""WITH {LINES}, c AS (SELECT doc_id, (line_no // 4)::INT AS item_no, line_no, line_no % 4 = 3 AS wk, CASE WHEN line_no % 4 = 3 THEN 'Week ' || line_no WHEN regexp_full_match(trim(text, ' '), '[-–—]+') THEN '' ELSE trim(text, ' ') END AS a, CASE WHEN line_no % 4 < 2 AND doc_id % 2 = 0 THEN 'x' ELSE '' END AS x FROM lines WHERE line_no % 4 <> 2),
      r AS (SELECT * FROM c WHERE a <> '' OR x <> ''), m AS (SELECT *, bool_or(a <> '') OVER t AS has_a, bool_or(x <> '') OVER t AS has_x, bool_or(wk OR regexp_matches(a, '(?i)^week\\s+[0-9]+')) OVER t AS week, count(*) OVER t AS n, count(*) FILTER (a <> '' AND x <> '') OVER t AS two FROM r WINDOW t AS (PARTITION BY doc_id, item_no))
    SELECT doc_id, item_no, (row_number() OVER (PARTITION BY doc_id, item_no ORDER BY line_no))::INT AS row_no, CASE WHEN has_a AND has_x THEN a || '|' || x WHEN has_a THEN a ELSE x END AS cells, week OR (n >= 2 AND 2 * two > n) AS is_real FROM m""")  # fmt: skip


def syllabus_tables(s, d):
    """Schedules in Word tables of two forms: dated labels, notes and work in their own column; numbered meetings without dates,
    under a module's title, with work among the topics. A table of something else stands beside them."""
    w = fx.weeks(s, d)
    even = F.col("course_id") % 2 == 0
    topics, work = F.array_join("topics", "\n"), F.array_join(F.concat("assignments", F.when(F.col("row_no") == 10, F.array(F.lit("Read ahead"))).otherwise(F.array().cast("array<string>"))), "\n")
    note = F.when(F.col("notes").isNotNull(), F.concat(F.lit("\nNote: "), "notes")).otherwise("")
    dated = F.array(F.concat("label", F.lit(" ("), F.date_format("day", "MMM. d"), F.lit("): start\nof it")), F.concat(topics, note), work)
    plain = F.array(F.concat(F.lit("Meeting "), "week_number"), F.concat(topics, F.lit("\n"), F.array_join("assignments", "\n"), note))
    own = F.when(F.col("is_break"), F.when(even, F.array("label", F.lit("No class"), F.lit(""))).otherwise(F.array(F.lit("Fall Break"), F.when(F.col("course_id") % 9 == 0, "off").otherwise("10/10 – 10/18")))).otherwise(F.when(even, dated).otherwise(plain))
    rows = w.select(F.col("course_id").alias("doc_id"), F.lit(1).alias("table_no"), "row_no", own.alias("cells"))
    c = fx.courses(s, d).select(F.col("course_id").alias("doc_id"), (F.col("course_id") % 2 == 0).alias("even"))
    head = c.select("doc_id", F.lit(1).alias("table_no"), F.lit(0).alias("row_no"), F.when(F.col("even"), F.array(*map(F.lit, ("Module one", "", "")))).otherwise(F.array(*map(F.lit, ("Meeting", "What is due and read")))).alias("cells"))
    second = c.where("even").select("doc_id", F.lit(1).alias("table_no"), F.lit(5).alias("row_no"), F.array(*map(F.lit, ("Week", "Topics", "Assignments"))).alias("cells"))
    other = c.select("doc_id", F.lit(0).alias("table_no"), F.explode(F.array(F.struct(F.lit(0).alias("row_no"), F.array(F.lit("Part"), F.lit("Points")).alias("cells")), F.struct(F.lit(1).alias("row_no"), F.array(F.lit("1 Essay"), F.lit("40")).alias("cells")))).alias("x")).select("doc_id", "table_no", "x.*")
    return rows.unionByName(head).unionByName(second).unionByName(other)


add("e2_schedule_tables", lambda s, d: c.schedule_rows(syllabus_tables(s, d), fx.weeks(s, d).groupBy(F.col("course_id").alias("doc_id")).agg(F.max(F.year("day")).alias("year"), F.min("day").alias("week_one"))).select("doc_id", "table_no", "row_no", "kind", "week_number", "day", "date_start", "date_end", F.array_join("topics", "|").alias("topics"), F.array_join("assignments", "|").alias("assignments"), "notes", "error_code"),
    """WITH w AS (SELECT *, course_id % 2 = 0 AS even, min(day) OVER (PARTITION BY course_id) AS one FROM fx_weeks)
    SELECT course_id AS doc_id, 1 AS table_no, row_no, CASE WHEN is_break THEN 'break' ELSE 'week' END AS kind, week_number, CASE WHEN even THEN day WHEN NOT is_break THEN (one + 7 * (week_number - 1))::DATE END AS day,
      CASE WHEN even OR course_id % 9 > 0 THEN date_start END AS date_start, CASE WHEN even OR course_id % 9 > 0 THEN date_end END AS date_end,
      CASE WHEN is_break THEN '' WHEN even THEN 'start|of it|' || array_to_string(topics, '|') ELSE '' END AS topics,
      CASE WHEN is_break THEN '' WHEN even THEN concat_ws('|', nullif(array_to_string(assignments, '|'), ''), CASE WHEN row_no = 10 THEN 'Read ahead' END) ELSE concat_ws('|', array_to_string(topics, '|'), nullif(array_to_string(assignments, '|'), '')) END AS assignments,
      notes, CASE WHEN is_break AND NOT even AND course_id % 9 = 0 THEN 'bad_break' END AS error_code FROM w""")  # fmt: skip
