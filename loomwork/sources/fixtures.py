"""Course-catalogue views over the star-schema tables, each in Spark and, for the oracles, in DuckDB SQL.

Both dialects give the same rows; the ``fx_*`` queries compare them. The views grow with the tables they read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.sources.files import dealt

#: Dates of four terms of a public academic calendar.
TERMS = [
    ("Fall 2026", 0, "2026-08-24", "2026-12-10"),
    ("Spring 2027", 1, "2027-01-11", "2027-04-27"),
    ("Summer 2027", 2, "2027-05-17", "2027-08-04"),
    ("Fall 2027", 3, "2027-08-23", "2027-12-09"),
]
NO_CLASS = [
    ("Fall 2026", 0, "Labor Day", "2026-09-07", None, None),
    ("Fall 2026", 1, "Fall Break", None, "2026-10-10", "2026-10-18"),
    ("Fall 2026", 2, "Thanksgiving Break", None, "2026-11-26", "2026-11-29"),
    ("Spring 2027", 0, "Martin Luther King Jr. Day", "2027-01-18", None, None),
    ("Spring 2027", 1, "Presidents Day", "2027-02-15", None, None),
    ("Spring 2027", 2, "Spring Break", None, "2027-03-06", "2027-03-14"),
    ("Summer 2027", 0, "Memorial Day", "2027-05-31", None, None),
    ("Summer 2027", 1, "Juneteenth (observed)", "2027-06-21", None, None),
    ("Fall 2027", 0, "Labor Day", "2027-09-06", None, None),
    ("Fall 2027", 1, "Fall Break", None, "2027-10-09", "2027-10-17"),
    ("Fall 2027", 2, "Thanksgiving Break", None, "2027-11-25", "2027-11-28"),
]
RATES = [
    ("openai", "gpt-4o", 0.0025, 0.01),
    ("openai", "gpt-4o-mini", 0.00015, 0.0006),
    ("gemini", "flash", 0.0015, 0.009),
    ("local", "default", 0.0, 0.0),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def terms(spark: SparkSession) -> DataFrame:
    """calendar_terms(term, pos, start_date, end_date)."""
    rows = spark.createDataFrame(TERMS, "term string, pos int, s string, e string")
    return rows.select("term", "pos", F.to_date("s").alias("start_date"), F.to_date("e").alias("end_date"))


def no_class(spark: SparkSession) -> DataFrame:
    """no_class_dates(term, pos, label, day, date_start, date_end): one date or a span."""
    rows = spark.createDataFrame(NO_CLASS, "term string, pos int, label string, d string, s string, e string")
    return rows.select("term", "pos", "label", F.to_date("d").alias("day"), F.to_date("s").alias("date_start"), F.to_date("e").alias("date_end"))


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATES, "section string, model string, input_per_1k double, output_per_1k double")


def pick(index: F.Column, *values: str | None) -> F.Column:
    """The value at ``index`` (from 0); null beyond the end."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(index == i, F.lit(v)).otherwise(out)
    return out


def eval_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage log: one row an event, the union of all payloads. Times are UTC."""
    return as_log(table(spark, sf_dir, "events"))


def as_log(e: DataFrame) -> DataFrame:
    """The events table, batch or stream, as a usage log."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.withColumn("k", k).withColumn("at", F.col("ts").cast("timestamp") + F.make_dt_interval(F.col("k") % 7 * 61))
    kind = (
        F.when(F.col("event_type") == "purchase", "generation").when(F.col("event_type") == "error", "extraction_error")
        .when(F.col("event_type") == "click", "extraction").when(F.col("event_type") == "view", "consistency_check").otherwise("rollover")
    )
    k = F.col("k")
    return e.select(
        "event_id", "k", (F.col("user_id") % 25).alias("project_id"), kind.alias("event_type"), F.col("at").alias("ts"),
        pick(k % 4, "quiz", "discussion", "rubric").alias("content_type"),
        pick(k % 3, "gpt-4o", "gpt-4o-mini", "unknown-model").alias("model"),
        F.when(k % 11 == 0, "local").otherwise("openai").alias("provider"),
        (k * 10).alias("input_tokens"), (k * 5).alias("output_tokens"),
        F.when(k % 10 != 0, F.round(F.col("value") / 1000, 6)).alias("cost_usd"),
        F.concat(F.lit("f"), F.col("event_id"), F.coalesce(pick(k % 5, ".docx", ".md", ".PDF", ".txt"), F.lit(""))).alias("filename"),
        F.coalesce(pick(k % 4, "word", "markdown", "word"), F.lit("markdown")).alias("source_format"),
        F.when(k % 6 == 0, "local").alias("pdf_method"),
        pick(k % 3, "MissingTable", "BadDate", "NoTerm").alias("error_type"),
        F.when(k % 8 != 0, k % 3 != 0).alias("passed"),
        F.coalesce(pick(k % 2, "Fall 2026"), F.lit("Spring 2027")).alias("term"),
        F.lit("Fall 2026").alias("source_term"), F.lit("Fall 2027").alias("target_term"),
        (k % 10 + 5).alias("source_weeks"), (k % 7 + 5).alias("target_weeks"), (k % 6).alias("flag_count"),
    )


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """courses(course_id, number, term, target_term, duration_weeks, meeting_pattern, source_format, location)."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("course_id"), F.concat(F.lit("IS "), 1000 + 37 * key % 8000).alias("number"), F.col("c_name").alias("title"),
        pick(key % 3, "Fall 2026", "Spring 2027", "Summer 2027").alias("term"),
        pick(key % 5, "Fall 2027", "Spring 2027", "Summer 2027", "Fall 2027", "Fall 2031").alias("target_term"),
        (5 + key % 11).cast("int").alias("duration_weeks"),
        pick(F.col("c_nationkey") % 5, "MWF 9:00-9:50", "Tuesdays and Thursdays", "TTh 2:00", "Wednesday", "Online").alias("meeting_pattern"),
        pick(key % 2, "word", "markdown").alias("source_format"),
    )


def weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """weeks(course_id, row_no, week_number, day, date_start, date_end, label, is_break, topics, assignments, notes)."""
    c = dealt(courses(spark, sf_dir), "course_id").join(F.broadcast(terms(spark)), "term")
    key = F.col("course_id")
    twice = F.when(key % 4 == 0, 2).otherwise(1)
    per = c.select("course_id", "term", "start_date", twice.alias("twice"), F.explode(F.sequence(F.lit(1), F.col("duration_weeks"))).alias("w"))
    per = per.select("*", F.explode(F.sequence(F.lit(0), F.col("twice") - 1)).alias("m"))
    regular = per.select(
        "course_id", (F.col("w") * 10 + F.col("m")).alias("row_no"), F.col("w").alias("week_number"),
        F.date_add("start_date", 7 * (F.col("w") - 1) + 2 * F.col("m")).alias("day"),
        F.lit(None).cast("date").alias("date_start"), F.lit(None).cast("date").alias("date_end"),
        F.concat(F.lit("Week "), F.col("w")).alias("label"), F.lit(False).alias("is_break"),
        F.when((key % 17 == 0) & (F.col("w") == 5), F.array(F.lit("Fall Break - no class"))).otherwise(F.array(F.concat(F.lit("Topic "), F.col("w")))).alias("topics"),
        F.when(F.col("w") % 3 == 0, F.array(F.concat(F.lit("Essay "), F.col("w"), F.lit(" due")))).otherwise(F.array().cast("array<string>")).alias("assignments"),
        F.when(F.col("w") == 2, F.lit("Bring a laptop")).alias("notes"),
    )
    breaks = c.where((F.col("term") == "Fall 2026") & (key % 3 == 0)).select(
        "course_id", F.lit(75).alias("row_no"), F.lit(None).cast("int").alias("week_number"), F.lit(None).cast("date").alias("day"),
        F.to_date(F.lit("2026-10-10")).alias("date_start"), F.to_date(F.lit("2026-10-18")).alias("date_end"),
        F.lit("Fall Break (10/10 - 10/18)").alias("label"), F.lit(True).alias("is_break"),
        F.array().cast("array<string>").alias("topics"), F.array().cast("array<string>").alias("assignments"), F.lit(None).cast("string").alias("notes"),
    )
    return regular.unionByName(breaks)


def university_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """university_dates(course_id, pos, event, day, date_start, date_end)."""
    c = dealt(courses(spark, sf_dir), "course_id").join(F.broadcast(terms(spark)), "term")
    none = F.lit(None).cast("date")
    entry = lambda pos, event, day, s=none, e=none: F.struct(F.lit(pos).alias("pos"), F.lit(event).alias("event"), day.alias("day"), s.alias("date_start"), e.alias("date_end"))
    rows = F.array(
        entry(0, "Classes begin", F.col("start_date")),
        entry(1, "Labor Day (no class)", F.date_add("start_date", 14)),
        entry(2, "Fall break", none, F.date_add("start_date", 47), F.date_add("start_date", 55)),
        entry(3, "Last day to drop before Labor Day", F.date_add("start_date", 11)),
        entry(4, "Classes end", F.col("end_date")),
    )
    return c.select("course_id", F.explode(rows).alias("r")).select("course_id", "r.*")


def rubrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rubrics(rubric_id, text): numbered criteria with points, dashed parts for every third."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    line = F.concat(F.lit("{n}. "), F.col("p_name"), F.lit(" - "), F.col("p_size"), F.lit(" points"))
    halves = F.concat(F.lit("\n- part one - "), F.floor(F.col("p_size") / 2), F.lit(" points\n- part two - "), F.col("p_size") - F.floor(F.col("p_size") / 2), F.lit(" points"))
    body = F.when(F.col("p_partkey") % 3 == 0, F.concat(line, halves)).otherwise(line)
    rows = p.select((F.floor(F.col("p_partkey") / 8)).cast("long").alias("rubric_id"), F.col("p_partkey").alias("key"), body.alias("body"))
    ordered = rows.groupBy("rubric_id").agg(F.array_sort(F.collect_list(F.struct("key", "body"))).alias("a"))
    numbered = F.transform("a", lambda x, i: F.replace(x["body"], F.lit("{n}"), (i + 1).cast("string")))
    return ordered.select("rubric_id", F.concat(F.lit("Rubric\n"), F.array_join(numbered, "\n")).alias("text"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


#: The same views in DuckDB SQL, by name; a view may use those before it.
SQL = {
    "fx_terms": f"SELECT term, pos::INT AS pos, s::DATE AS start_date, e::DATE AS end_date FROM (VALUES {_values(TERMS)}) t(term, pos, s, e)",
    "fx_no_class": f"SELECT term, pos::INT AS pos, label, d::DATE AS day, s::DATE AS date_start, e::DATE AS date_end FROM (VALUES {_values(NO_CLASS)}) t(term, pos, label, d, s, e)",
    "fx_rates": f"SELECT section, model, i::DOUBLE AS input_per_1k, o::DOUBLE AS output_per_1k FROM (VALUES {_values(RATES)}) t(section, model, i, o)",
    "fx_events": """SELECT event_id, k, (user_id % 25)::BIGINT AS project_id,
        CASE event_type WHEN 'purchase' THEN 'generation' WHEN 'error' THEN 'extraction_error' WHEN 'click' THEN 'extraction' WHEN 'view' THEN 'consistency_check' ELSE 'rollover' END AS event_type,
        ts + to_days(k % 7 * 61) AS ts,
        CASE k % 4 WHEN 0 THEN 'quiz' WHEN 1 THEN 'discussion' WHEN 2 THEN 'rubric' END AS content_type,
        CASE k % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' ELSE 'unknown-model' END AS model,
        CASE WHEN k % 11 = 0 THEN 'local' ELSE 'openai' END AS provider,
        k * 10 AS input_tokens, k * 5 AS output_tokens,
        CASE WHEN k % 10 <> 0 THEN round(value / 1000, 6) END AS cost_usd,
        'f' || event_id || CASE k % 5 WHEN 0 THEN '.docx' WHEN 1 THEN '.md' WHEN 2 THEN '.PDF' WHEN 3 THEN '.txt' ELSE '' END AS filename,
        CASE k % 4 WHEN 0 THEN 'word' WHEN 1 THEN 'markdown' WHEN 2 THEN 'word' ELSE 'markdown' END AS source_format,
        CASE WHEN k % 6 = 0 THEN 'local' END AS pdf_method,
        CASE k % 3 WHEN 0 THEN 'MissingTable' WHEN 1 THEN 'BadDate' ELSE 'NoTerm' END AS error_type,
        CASE WHEN k % 8 <> 0 THEN k % 3 <> 0 END AS passed,
        CASE k % 2 WHEN 0 THEN 'Fall 2026' ELSE 'Spring 2027' END AS term,
        'Fall 2026' AS source_term, 'Fall 2027' AS target_term, k % 10 + 5 AS source_weeks, k % 7 + 5 AS target_weeks, k % 6 AS flag_count
        FROM (SELECT *, json_extract(props, '$.k')::INT AS k FROM events)""",
    "fx_courses": """SELECT c_custkey AS course_id, 'IS ' || (1000 + 37 * c_custkey % 8000) AS number, c_name AS title,
        CASE c_custkey % 3 WHEN 0 THEN 'Fall 2026' WHEN 1 THEN 'Spring 2027' ELSE 'Summer 2027' END AS term,
        CASE c_custkey % 5 WHEN 0 THEN 'Fall 2027' WHEN 1 THEN 'Spring 2027' WHEN 2 THEN 'Summer 2027' WHEN 3 THEN 'Fall 2027' ELSE 'Fall 2031' END AS target_term,
        (5 + c_custkey % 11)::INT AS duration_weeks,
        CASE c_nationkey % 5 WHEN 0 THEN 'MWF 9:00-9:50' WHEN 1 THEN 'Tuesdays and Thursdays' WHEN 2 THEN 'TTh 2:00' WHEN 3 THEN 'Wednesday' ELSE 'Online' END AS meeting_pattern,
        CASE c_custkey % 2 WHEN 0 THEN 'word' ELSE 'markdown' END AS source_format FROM customer""",
    "fx_weeks": """SELECT course_id, (w * 10 + m)::INT AS row_no, w::INT AS week_number, (start_date + (7 * (w - 1) + 2 * m)::INT)::DATE AS day,
        NULL::DATE AS date_start, NULL::DATE AS date_end, 'Week ' || w AS label, false AS is_break,
        CASE WHEN course_id % 17 = 0 AND w = 5 THEN ['Fall Break - no class'] ELSE ['Topic ' || w] END AS topics,
        CASE WHEN w % 3 = 0 THEN ['Essay ' || w || ' due'] ELSE []::VARCHAR[] END AS assignments, CASE WHEN w = 2 THEN 'Bring a laptop' END AS notes
        FROM (SELECT c.course_id, t.start_date, g.w, h.m FROM fx_courses c JOIN fx_terms t USING (term), unnest(generate_series(1, c.duration_weeks)) g(w), unnest(generate_series(0, CASE WHEN c.course_id % 4 = 0 THEN 1 ELSE 0 END)) h(m))
        UNION ALL SELECT course_id, 75, NULL, NULL, DATE '2026-10-10', DATE '2026-10-18', 'Fall Break (10/10 - 10/18)', true, []::VARCHAR[], []::VARCHAR[], NULL FROM fx_courses WHERE term = 'Fall 2026' AND course_id % 3 = 0""",
    "fx_university_dates": """SELECT course_id, pos::INT AS pos, event, day, date_start, date_end FROM (
        SELECT course_id, 0 AS pos, 'Classes begin' AS event, start_date AS day, NULL::DATE AS date_start, NULL::DATE AS date_end FROM fx_courses JOIN fx_terms USING (term)
        UNION ALL SELECT course_id, 1, 'Labor Day (no class)', start_date + 14, NULL, NULL FROM fx_courses JOIN fx_terms USING (term)
        UNION ALL SELECT course_id, 2, 'Fall break', NULL, start_date + 47, start_date + 55 FROM fx_courses JOIN fx_terms USING (term)
        UNION ALL SELECT course_id, 3, 'Last day to drop before Labor Day', start_date + 11, NULL, NULL FROM fx_courses JOIN fx_terms USING (term)
        UNION ALL SELECT course_id, 4, 'Classes end', end_date, NULL, NULL FROM fx_courses JOIN fx_terms USING (term))""",
    "fx_rubrics": """SELECT rubric_id, 'Rubric' || chr(10) || string_agg(replace(body, '{n}', n::VARCHAR), chr(10) ORDER BY key) AS text FROM (
        SELECT (p_partkey // 8)::BIGINT AS rubric_id, p_partkey AS key, row_number() OVER (PARTITION BY p_partkey // 8 ORDER BY p_partkey) AS n,
        '{n}. ' || p_name || ' - ' || p_size || ' points' || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || '- part one - ' || (p_size // 2) || ' points' || chr(10) || '- part two - ' || (p_size - p_size // 2) || ' points' ELSE '' END AS body FROM part)
        GROUP BY rubric_id""",
}


def with_views(sql: str) -> str:
    """``sql`` behind the views that it names, in order."""
    needed: set[str] = set()
    text = sql
    for name in reversed(SQL):
        if name in text:
            needed.add(name)
            text += SQL[name]
    views = ", ".join(f"{name} AS ({SQL[name]})" for name in SQL if name in needed)
    if not views:
        return sql
    if sql.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views}, {sql.lstrip()[len('WITH RECURSIVE'):]}"
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH {views}, {sql.lstrip()[len('WITH '):]}"
    return f"WITH {views} {sql}"
