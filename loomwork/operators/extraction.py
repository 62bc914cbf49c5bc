"""Syllabi to tables: labelled lines, sections, schedule and date tables, grading tables. Set-based per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import terms as t
from loomwork.operators import documents as doc

# Names under which syllabi give a course's details.
ALIASES = {
    "term": ("term", "semester", "session"), "number": ("course", "course number", "number"), "title": ("title", "course title"), "credits": ("credits", "credit hours", "units"),
    "meeting_pattern": ("meets", "meeting", "meeting time", "class time", "schedule", "days"), "location": ("location", "room", "where"), "instructor": ("instructor", "professor", "taught by"),
}
MONTH_DAY = r"([0-9]{1,2})/([0-9]{1,2})(?:/([0-9]{4}))?"
JUMP = 180  # days back that mean a new year


def label_of(text: Column) -> Column:
    """F8: (field, value) of a line ``Label: value`` with a known label, markup stripped; null for other lines."""
    clean = F.regexp_replace(text, r"[*_`]|^\s*#+\s*|^\s*[-•]\s+", "")
    name = F.lower(F.trim(F.regexp_extract(clean, r"^\s*([A-Za-z ]+?)\s*:\s*\S", 1)))
    known = F.create_map(*[x for field, names in ALIASES.items() for n in names for x in (F.lit(n), F.lit(field))])
    field, value = F.try_element_at(known, name), F.trim(F.regexp_extract(clean, r"^[^:]*:\s*(.+?)\s*$", 1))
    return F.when(F.contains(text, F.lit(":")) & field.isNotNull() & (value != ""), F.struct(field.alias("field"), value.alias("value")))


def labelled(rows: DataFrame) -> DataFrame:
    """F8: (doc_id, field, value): lines ``Label: value`` of known labels, markup stripped; the first of a field counts."""
    found = rows.select("doc_id", "line_no", label_of(F.col("text")).alias("l")).where("l is not null").select("doc_id", "line_no", "l.*")
    return found.groupBy("doc_id", "field").agg(F.min_by("value", "line_no").alias("value"))


def named_term(term: Column) -> Column:
    """A term as "Season year"; null where either is unknown."""
    return F.when(t.season(term).isNotNull() & t.year_of(term).isNotNull(), F.concat_ws(" ", t.season(term), t.year_of(term).cast("string")))


def front_matter(rows: DataFrame) -> DataFrame:
    """One row a document with its details; a document without a term is an error row."""
    told = rows.select("doc_id", "line_no", label_of(F.col("text")).alias("l"))
    of = lambda field, c: F.when(F.col("l.field") == field, c)
    out = told.groupBy("doc_id").agg(*(F.min_by(of(f, F.col("l.value")), of(f, F.col("line_no"))).alias(f) for f in ALIASES))
    return out.withColumn("term", named_term(F.col("term"))).withColumn("error_code", F.when(F.col("term").isNull(), "no_term"))


HEADER = 15  # lines with text at a syllabus's top that may hold its details without a label
COURSE = r"\b[A-Z]{2,5}[ -]?[0-9]{4}\b"
EDGES = " \t-–—:,|·*_`#"
# How a class is taught, as written behind a title.
MODES = ("online", "hybrid", "in person", "remote", "face to face")
MODE = rf"(?i)\s*[-–—:|·,(]\s*(?:fully )?(?:{'|'.join(m.replace(' ', '[- ]') for m in MODES)})(?: a?sync(?:hronous)?)?\s*\)?\s*$"
UNTITLED = "Untitled course"


def term_in(text: Column) -> Column:
    """The first season that a year follows, with "term" or "semester" between them or not: (season, year); null without one."""
    words = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z]+|[0-9]+"), F.lit(0)), lambda w: ~F.lower(w).isin("term", "semester"))
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.struct(a.alias("season"), b.alias("year")))
    return F.try_element_at(F.filter(pairs, lambda p: F.lower(p["season"]).isin("fall", "spring", "summer") & F.rlike(p["year"], F.lit("^[0-9]{4}$"))), F.lit(1))


def course_in(text: Column) -> Column:
    """The first course number of a line: (number, section, before, behind); null without one. A section stands right behind it,
    after a hyphen or "Section"."""
    found = F.filter(F.regexp_extract_all(text, F.lit(COURSE), F.lit(0)), lambda m: ~F.rlike(m, F.lit("^(?:FALL|SPRING|SUMMER)[^A-Z]")))
    first = F.try_element_at(found, F.lit(1))
    at = F.position(first, text)
    rest = F.substring(text, at + F.length(first), F.length(text))
    tokens = F.filter(F.regexp_extract_all(rest, F.lit(r"[A-Za-z]+|[0-9]+|[^\s.]"), F.lit(0)), lambda x: x != ",")
    is_mark = (F.try_element_at(tokens, F.lit(1)) == "-") | F.lower(F.try_element_at(tokens, F.lit(1))).isin("section", "sec")
    section = F.when(is_mark & F.rlike(F.try_element_at(tokens, F.lit(2)), F.lit("^[0-9]{1,3}$")) & (F.coalesce(F.try_element_at(tokens, F.lit(3)), F.lit("")) != "-"), F.try_element_at(tokens, F.lit(2)))
    behind = F.when(section.isNotNull(), F.regexp_replace(rest, F.concat(F.lit("^[^0-9]*"), section), F.lit(""))).otherwise(rest)
    number = F.concat_ws(" ", F.regexp_extract(first, "^[A-Z]+", 0), F.regexp_extract(first, "[0-9]+$", 0))
    return F.when(first.isNotNull(), F.struct(number.alias("number"), section.alias("section"), F.substring(text, F.lit(1), at - 1).alias("before"), behind.alias("behind")))


def title_in(text: Column, course: Column, term: Column) -> Column:
    """What is left of a line without markup, course number, term, "syllabus" and how the class is taught; null if that is
    fewer than three characters."""
    kept = F.when(course.isNotNull(), F.concat(course["before"], course["behind"])).otherwise(text)
    named = F.concat(F.lit(r"(?i)\b"), term["season"], F.lit(r"\W+(?:(?:semester|term)\W+)?"), term["year"])
    kept = F.when(term.isNotNull(), F.regexp_replace(kept, named, F.lit(""))).otherwise(kept)
    kept = F.btrim(F.regexp_replace(F.regexp_replace(kept, r"(?i)\bsyllabus\b", ""), r"\s{2,}", " "), F.lit(EDGES))
    short = F.btrim(F.regexp_replace(kept, MODE, ""), F.lit(EDGES))
    best = F.when(F.length(short) >= 3, short).otherwise(kept)
    return F.when(F.length(best) >= 3, best)


def header_guesses(rows: DataFrame) -> DataFrame:
    """a syllabus's details from its labels, else from its first HEADER lines with text; one row a document.

    Each line offers what it may hold; of each detail a label counts first, then the first line that offers it. Labelled lines
    offer a term, credits and meeting times, but no number, section or title; a labelled number gives its section. Without a title the number
    stands for it, or UNTITLED; without a term the row has an error code. ``rows(doc_id, line_no, text)``.
    """
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    header = rows.where(F.trim("text") != "").withColumn("nth", place).where(F.col("nth") <= HEADER).select("doc_id", "line_no", F.trim("text").alias("text"))
    header = header.withColumn("plain", label_of(F.col("text")).isNull()).withColumn("term", term_in(F.col("text"))).withColumn("course", F.when(F.col("plain"), course_in(F.col("text"))))
    header = header.withColumn("title", F.when(F.col("plain"), title_in(F.col("text"), F.col("course"), F.col("term"))))
    counted = F.filter(F.zip_with(F.regexp_extract_all("text", F.lit(r"\b([0-9]{1,2}(?:\.[0-9]{1,2})?)\s+([A-Za-z]+)"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"\b([0-9]{1,2}(?:\.[0-9]{1,2})?)\s+([A-Za-z]+)"), F.lit(2)), lambda n, w: F.struct(n.alias("n"), w.alias("w"))), lambda x: F.lower(x["w"]).isin("credit", "credits"))
    days = (*t.DAY_NAMES, *(f"{n}s" for n in t.DAY_NAMES), *t.DAY_SHORT)
    says_day = F.exists(F.split(F.lower("text"), "[^a-z]+"), lambda w: w.isin(*days))
    meets = says_day & F.rlike("text", F.lit(r"(?i)[0-9]\s*[ap]m\b")) & ~F.rlike("text", F.lit("^[A-Za-z][^:0-9]{0,40}:"))
    header = header.withColumn("credits", F.try_element_at(counted, F.lit(1))["n"]).withColumn("meets", F.when(meets, F.col("text")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    guessed = header.groupBy("doc_id").agg(*map(first, ("term", "course", "title", "credits", "meets")))
    wide = labelled(rows).groupBy("doc_id").pivot("field", list(ALIASES)).agg(F.first("value"))
    named = rows.select("doc_id").distinct().join(wide.select("doc_id", *(F.col(c).alias(f"l_{c}") for c in ALIASES)), "doc_id", "left").join(guessed, "doc_id", "left")
    stated, own = course_in(F.col("l_number")), term_in(F.coalesce("l_term", F.lit("")))
    named = named.withColumn("stated", stated).withColumn("own", F.when(F.col("l_term").isNull(), F.col("term")).otherwise(own))
    number = F.coalesce(F.when(F.col("stated.section").isNotNull(), F.col("stated.number")), "l_number", "course.number", F.lit(""))
    section = F.coalesce("stated.section", F.col("course.section"), F.lit(""))
    year = F.when(F.col("own").isNotNull(), F.concat_ws(" ", F.initcap(F.lower("own.season")), "own.year")).otherwise(F.col("l_term"))
    return named.select(
        "doc_id", year.alias("term"), number.alias("number"), section.alias("section"), F.coalesce("l_title", "title", F.nullif(number, F.lit("")), F.lit(UNTITLED)).alias("title"),
        F.regexp_extract(F.coalesce("l_credits", "credits", F.lit("")), r"[0-9]+(?:\.[0-9]+)?", 0).try_cast("double").alias("credits"), F.coalesce("l_meeting_pattern", "meets", F.lit("")).alias("meeting_pattern"),
        F.when(F.coalesce("l_term", year).isNull(), "no_term").alias("error_code"),
    )


def section_lines(rows: DataFrame, heading: str) -> DataFrame:
    """The bullets behind the first heading that matches, up to the next heading, table or other line."""
    is_head = F.rlike("text", F.lit(r"^\s*#+\s"))
    starts = rows.where(is_head & F.rlike("text", F.lit(heading))).groupBy("doc_id").agg(F.min("line_no").alias("start"))
    after = rows.join(starts, "doc_id").where("line_no > start")
    bullet = F.rlike("text", F.lit(r"^\s*(?:[-*•]|[0-9]+[.)])\s+\S"))
    stops = after.where(~bullet & (F.trim("text") != "")).groupBy("doc_id").agg(F.min("line_no").alias("stop"))
    kept = after.join(stops, "doc_id", "left").where(bullet & (F.col("line_no") < F.coalesce("stop", F.lit(1 << 30))))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    return kept.select("doc_id", nth.alias("pos"), F.regexp_replace("text", r"^\s*(?:[-*•]|[0-9]+[.)])\s+", "").alias("text"))


def dated(text: Column, year: Column, n: int = 1) -> Column:
    """the n-th m/d or m/d/yyyy of a cell; null where it isn't a date."""
    parts = F.split(F.try_element_at(F.regexp_extract_all(text, F.lit(MONTH_DAY), F.lit(0)), F.lit(n)), "/")
    y = F.coalesce(F.try_element_at(parts, F.lit(3)), year.cast("string"))
    return F.concat(y, F.lit("-"), F.lpad(F.element_at(parts, 1), 2, "0"), F.lit("-"), F.lpad(F.element_at(parts, 2), 2, "0")).try_cast("date")


def tables_headed(rows: DataFrame, first: str) -> DataFrame:
    """Rows of the tables whose first header cell reads ``first``, headers left out, with the number of such tables and the
    document's term. All of a document's facts come from one sort of its lines."""
    told = doc.table_lines(rows.where(F.col("doc_id").isNotNull() & (F.contains("text", F.lit("|")) | F.contains("text", F.lit(":")))))
    told = told.withColumn("is_head", F.coalesce((F.col("row_no") == 1) & (F.col("head") == first), F.lit(False))).withColumn("label", label_of(F.col("text")))
    whole = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    term = F.first(F.when(F.col("label.field") == "term", F.col("label.value")), True)
    told = told.withColumns({"tables": F.count_if("is_head").over(whole), "term": term.over(whole)}).where((F.col("head") == first) & (F.col("row_no") > 1))
    return told.select("doc_id", "table_no", "row_no", "line_no", doc.cells_of(F.col("text")).alias("cells"), "tables", named_term(F.col("term")).alias("term"))


def cell(n: int) -> Column:
    return F.coalesce(F.try_element_at("cells", F.lit(n)), F.lit(""))


def schedule(rows: DataFrame) -> DataFrame:
    """Schedule rows of markdown syllabi, with an error code where a row can't be read.

    A break row has "-" for its week and a span for its date. Columns: week, date, topics, assignments.
    """
    year = F.col("year")
    body = tables_headed(rows, "week").withColumn("year", t.year_of(F.col("term"))).withColumns({"first": dated(cell(2), year), "second": dated(cell(2), year, 2)})
    is_break = cell(1) == "-"
    week, day, start, end = cell(1).try_cast("int"), F.col("first"), F.col("first"), F.col("second")
    parts = lambda c: F.filter(F.split(c, r"\s*;\s*"), lambda x: x != "")
    error = F.when(F.col("tables") > 1, "several_schedules").when(F.col("term").isNull(), "no_term").when(is_break & (start.isNull() | end.isNull()), "bad_break").when(~is_break & week.isNull(), "bad_week").when(~is_break & day.isNull(), "bad_date")
    return body.select(
        "doc_id", (F.col("row_no") - 1).alias("row_no"), F.when(~is_break, week).alias("week_number"), F.when(~is_break, day).alias("day"), F.when(is_break, start).alias("date_start"), F.when(is_break, end).alias("date_end"),
        is_break.alias("is_break"), parts(cell(3)).alias("topics"), parts(cell(4)).alias("assignments"), error.alias("error_code"),
    )


def university_dates(rows: DataFrame) -> DataFrame:
    """Rows of the Event/Date table; a row whose date can't be read is left out, as the tables' users expect."""
    year = F.col("year")
    body = tables_headed(rows, "event").withColumn("year", t.year_of(F.col("term")))
    read = body.select("doc_id", "row_no", "line_no", cell(1).alias("event"), dated(cell(2), year).alias("first"), dated(cell(2), year, 2).alias("second"))
    # counted before the unreadable rows are left out, so that dates are read once
    so_far = Window.partitionBy("doc_id").orderBy("row_no", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = read.withColumn("pos", (F.count("first").over(so_far) - 1).cast("int")).where("first is not null")
    return out.select("doc_id", "event", F.when(F.col("second").isNull(), F.col("first")).alias("day"), F.when(F.col("second").isNotNull(), F.col("first")).alias("date_start"), F.col("second").alias("date_end"), "pos")


def grading(rows: DataFrame) -> DataFrame:
    """Weights of a grading table ``(doc_id, row_no, name, value)``: percent, or points over the stated total or their sum.

    Rounded half-even to four places, at most 1.
    """
    number = F.regexp_extract("value", r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    parsed = rows.withColumn("n", number).withColumn("percent", F.contains("value", F.lit("%"))).where("n is not null")
    is_total = F.lower(F.trim("name")) == "total"
    whole = Window.partitionBy("doc_id")
    any_percent = F.max(F.col("percent")).over(whole)
    stated, summed = F.max(F.when(is_total, F.col("n"))).over(whole), F.sum(F.when(~is_total, F.col("n"))).over(whole)
    weight = F.when(any_percent, F.when(F.col("percent"), F.col("n") / 100)).otherwise(F.col("n") / F.coalesce(stated, summed))
    out = parsed.withColumn("weight", F.when(weight.isNotNull(), F.least(F.bround(weight, 4), F.lit(1.0)))).where(~is_total & F.col("weight").isNotNull())
    return out.select("doc_id", "row_no", "name", "weight")


# How grading tables write their units.
UNITS = {"%": "percent", "pt": "points", "pts": "points", "point": "points", "points": "points"}
AMOUNT = r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*(%|[A-Za-z]*)"


def amounts(text: Column) -> Column:
    """Every number of a cell with its unit: percent, points, an empty string where none follows, null for other words."""
    units = F.create_map(F.lit(""), F.lit(""), *[F.lit(x) for pair in UNITS.items() for x in pair])
    read = lambda group: F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(group))
    return F.zip_with(read(1), read(2), lambda n, unit: F.struct(F.replace(n, F.lit(","), F.lit("")).cast("double").alias("n"), F.try_element_at(units, F.lower(unit)).alias("unit")))


def amount_in(text: Column, unit: Column | str) -> Column:
    """The first number with a unit; a cell that is a number and no more counts as points. Null where there is none."""
    unit = F.lit(unit) if isinstance(unit, str) else unit
    listed = amounts(text)
    bare = F.when((unit == "points") & (F.regexp_replace(F.trim(text), "^[0-9][0-9,]*([.][0-9]+)?$", "") == ""), F.try_element_at(listed, F.lit(1))["n"])
    return F.coalesce(F.try_element_at(F.filter(listed, lambda a: a["unit"] == unit), F.lit(1))["n"], bare)


def headed_by(unit: str) -> Column:
    """The place of the first cell, behind the first and without digits, whose words name a unit; null where there is none."""
    words = lambda c: F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z%]+")
    if unit == "percent":
        says = lambda w: F.contains(w, F.lit("%")) | F.contains(w, F.lit("percent")) | F.contains(w, F.lit("weight"))
    else:
        says = lambda w: w.isin(*(k for k, v in UNITS.items() if v == unit))
    named = lambda c: F.exists(words(c), says) & (F.translate(c, "0123456789", "") == c)
    return F.nullif(F.array_position(F.transform("cells", lambda c, i: (i > 0) & F.coalesce(named(c), F.lit(False))), True), F.lit(0))


def grading_tables(tables: DataFrame) -> DataFrame:
    """Weights of grading tables as they stand in a text; ``tables(doc_id, table_no, row_no, cells)``, row 1 first.

    The first row is a header if a cell behind its first, without digits, says percent or weight (this wins) or points. A table
    without one counts by its second cells, if more than half of them, the first too, are percentages, else points. Points
    are divided by the "Total" row's, else by their sum, and rounded half-even to four places, at most 1. Rows without a
    readable value give nothing, as do tables of neither kind.
    """
    table = Window.partitionBy("doc_id", "table_no")
    holds = lambda unit: F.exists(amounts(cell(2)), lambda a: F.coalesce(a["unit"] == unit, F.lit(False)))
    top = tables.withColumn("is_first", F.col("row_no") == F.min("row_no").over(table))
    at = lambda unit: F.max(F.when(F.col("is_first"), headed_by(unit))).over(table)
    most = lambda unit: (2 * F.count_if(holds(unit)).over(table) > F.count("*").over(table)) & F.bool_or(F.col("is_first") & holds(unit)).over(table)
    found = top.select("*", *(at(u).alias(f"c_{u}") for u in ("percent", "points")), *(most(u).alias(f"m_{u}") for u in ("percent", "points")))
    headed = F.coalesce("c_percent", "c_points")
    unit = F.when(F.col("c_percent").isNotNull() | (headed.isNull() & F.col("m_percent")), "percent").when(headed.isNotNull() | F.col("m_points"), "points")
    value = F.coalesce(F.try_element_at("cells", F.coalesce(headed, F.lit(2)).cast("int")), F.lit(""))
    rows = found.select("doc_id", "table_no", "row_no", unit.alias("unit"), F.trim(cell(1)).alias("name"), value.alias("value")).where(F.col("unit").isNotNull() & ~(headed.isNotNull() & F.col("is_first")))
    rows = rows.withColumn("n", amount_in(F.col("value"), F.col("unit"))).withColumn("is_total", F.startswith(F.lower("name"), F.lit("total")))
    # the last Total row counts, though it has no number
    stated = F.max_by(F.when(F.col("is_total"), F.coalesce("n", F.lit(0.0))), F.when(F.col("is_total"), F.col("row_no"))).over(table)
    whole = F.coalesce(F.nullif(stated, F.lit(0.0)), F.nullif(F.sum(F.when(~F.col("is_total"), F.col("n"))).over(table), F.lit(0.0)))
    weight = F.when(F.col("unit") == "percent", F.col("n") / 100).otherwise(F.when(whole > 0, F.least(F.bround(F.col("n") / whole, 4), F.lit(1.0))))
    return rows.withColumn("weight", weight).where("not is_total and n is not null and weight is not null").select("doc_id", "table_no", "row_no", "name", "unit", "weight")


def roll_new_year(rows: DataFrame) -> DataFrame:
    """Dates of a schedule whose years all came from its term. A date more than JUMP days before the one before it, as
    adjusted, starts a new year from there on; in spring terms the whole schedule moves back by what was added.

    ``rows(doc_id, row_no, day, is_spring)``; an ordered fold over one schedule.
    """
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_no", "day"))).alias("r"), F.bool_or("is_spring").alias("spring"))

    def step(state: Column, x: Column) -> Column:
        moved = F.add_months(x["day"], 12 * state["extra"])
        jump = F.coalesce(F.date_diff(state["before"], moved) > JUMP, F.lit(False))
        extra = state["extra"] + F.when(jump, 1).otherwise(0)
        day = F.add_months(x["day"], 12 * extra)
        return F.struct(extra.alias("extra"), F.coalesce(day, state["before"]).alias("before"), F.concat(state["out"], F.array(F.struct(x["row_no"].alias("row_no"), day.alias("day")))).alias("out"))

    start = F.struct(F.lit(0).alias("extra"), F.lit(None).cast("date").alias("before"), F.array().cast("array<struct<row_no:int,day:date>>").alias("out"))
    walked = listed.withColumn("w", F.aggregate("r", start, step))
    back = F.when(F.col("spring"), F.col("w.extra")).otherwise(0)
    return walked.select("doc_id", back.alias("back"), F.explode("w.out").alias("x")).select("doc_id", F.col("x.row_no").alias("row_no"), F.add_months("x.day", -12 * F.col("back")).alias("day"))


DATES = ("day", "date_start", "date_end")


def roll_dates(rows: DataFrame) -> DataFrame:
    """W2 over all dates of a schedule: ``rows(doc_id, row_no, day, date_start, date_end, is_spring)``. The dates of a row come in
    that order, behind those of the rows before; a row that crosses New Year itself ends in the next year. Rows without a date
    stay as they are."""
    listed = F.array(*(F.struct((len(DATES) * F.col("row_no") + i).cast("int").alias("row_no"), F.col(c).alias("day")) for i, c in enumerate(DATES)))
    each = rows.select("doc_id", "is_spring", F.explode(listed).alias("d")).select("doc_id", "is_spring", "d.*").where("day is not null")
    moved = roll_new_year(each).select("doc_id", F.floor(F.col("row_no") / len(DATES)).cast("int").alias("row_no"), F.pmod("row_no", F.lit(len(DATES))).alias("place"), "day")
    wide = moved.groupBy("doc_id", "row_no").agg(*(F.max(F.when(F.col("place") == i, F.col("day"))).alias(c) for i, c in enumerate(DATES)))
    return rows.select("doc_id", "row_no").join(wide, ["doc_id", "row_no"], "left")


def week_label(text: Column, year: Column) -> Column:
    """week number, day and style of labels "Week N (m/d)" and "(Mon. d)"."""
    numeric = F.regexp_extract(text, r"\(([0-9]{1,2}/[0-9]{1,2})\)", 1)
    worded = F.regexp_extract(text, r"\(([A-Z][a-z]{2})[a-z]*\.? ([0-9]{1,2})\)", 0)
    month, day = F.regexp_extract(text, r"\(([A-Z][a-z]{2})[a-z]*\.? ([0-9]{1,2})\)", 1), F.regexp_extract(text, r"\(([A-Z][a-z]{2})[a-z]*\.? ([0-9]{1,2})\)", 2)
    written = F.try_to_date(F.concat_ws(" ", month, F.lpad(day, 2, "0"), year.cast("string")), "MMM dd yyyy")
    return F.struct(
        F.regexp_extract(text, r"(?i)week\s+([0-9]+)", 1).try_cast("int").alias("week_number"),
        F.when(numeric != "", dated(numeric, year)).when(worded != "", written).alias("day"),
        F.when(numeric != "", "m/d").when(worded != "", "Mon. d").when(F.rlike(text, F.lit("(?i)week")), "undated").alias("style"),
    )


def brief(courses: DataFrame, weeks: DataFrame, dates: DataFrame) -> DataFrame:
    """One markdown brief per course."""
    topic = F.array_join("topics", "; ")
    line = F.when(F.col("is_break"), F.concat(F.lit("- "), "label")).otherwise(F.concat(F.lit("- "), "label", F.lit(": "), topic))
    plan = weeks.groupBy("course_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", line.alias("l")))), lambda x: x["l"]), "\n").alias("plan"))
    events = dates.groupBy("course_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("- "), "event", F.lit(": "), F.coalesce(F.col("day"), F.col("date_start")).cast("string")).alias("l")))), lambda x: x["l"]), "\n").alias("events"))
    text = F.concat(F.lit("# "), F.replace("title", F.lit("|"), F.lit("\\|")), F.lit("\n\n"), "number", F.lit(", "), "term", F.lit("\n\n## Schedule\n"), F.coalesce("plan", F.lit("none")), F.lit("\n\n## Dates\n"), F.coalesce("events", F.lit("none")))
    return courses.join(plan, "course_id", "left").join(events, "course_id", "left").select("course_id", text.alias("content"))


def page(courses: DataFrame, weeks: DataFrame) -> DataFrame:
    """One HTML page per course, our own neutral template, every value escaped."""
    e = t.escape_html
    row = F.concat(F.lit("<tr><td>"), e(F.col("label")), F.lit("</td><td>"), e(F.array_join("topics", "; ")), F.lit("</td></tr>"))
    body = weeks.groupBy("course_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", row.alias("l")))), lambda x: x["l"]), "").alias("rows"))
    text = F.concat(F.lit("<h1>"), e(F.col("title")), F.lit("</h1><p>"), e(F.concat_ws(", ", "number", "term", "meeting_pattern")), F.lit("</p><table>"), F.coalesce("rows", F.lit("")), F.lit("</table>"))
    return courses.join(body, "course_id", "left").select("course_id", text.alias("content"))


def nested(courses: DataFrame, weeks: DataFrame, dates: DataFrame) -> DataFrame:
    """One record a course, its rows in order inside it."""
    w = weeks.groupBy("course_id").agg(F.array_sort(F.collect_list(F.struct("row_no", *(c for c in weeks.columns if c not in ("course_id", "row_no"))))).alias("weeks"))
    d = dates.groupBy("course_id").agg(F.array_sort(F.collect_list(F.struct("pos", *(c for c in dates.columns if c not in ("course_id", "pos"))))).alias("university_dates"))
    return courses.join(w, "course_id", "left").join(d, "course_id", "left")


def flat(records: DataFrame, field: str) -> DataFrame:
    """S4 the other way: the rows of one field."""
    return records.select("course_id", F.explode(field).alias("x")).select("course_id", "x.*")


def same(text: Column) -> Column:
    return F.lower(F.trim(text))


def listed_dates(dates: DataFrame) -> DataFrame:
    """(doc_id, listed, names): a document's few dates in order, and their events' names."""
    listed = dates.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "event", "day", "date_start", "date_end"))).alias("listed"))
    return listed.withColumn("names", F.transform("listed", lambda e: same(e["event"])))


#: The date that a document's nth university-date row of so many takes: by place if there are as many, else by event.
PARTNER = "try_element_at(listed, cast(if(of = size(listed), nth, nullif(array_position(names, name), 0)) as int))"


def new_cells() -> Column:
    """The cells of a row from its ``partner``; further cells stay as they are."""
    new, cells = F.col("partner"), F.col("cells")
    when = F.coalesce(F.concat(t.month_day(new["day"]), F.lit("/"), F.year(new["day"]).cast("string")), F.concat_ws(" - ", t.month_day(new["date_start"]), t.month_day(new["date_end"])))
    return F.concat(F.array(new["event"], when), F.slice(cells, F.lit(3), F.greatest(F.size(cells) - 2, F.lit(0))))


def paired_dates(old: DataFrame, dates: DataFrame) -> DataFrame:
    """New cells of university-date rows ``old(doc_id, line_no, cells)``; ``dates(doc_id, pos, event, day, date_start,
    date_end)`` are paired with them by place if there are as many, else by event. Rows without a partner are left out; further
    cells stay as they are."""
    by_line = Window.partitionBy("doc_id").orderBy("line_no")
    whole = by_line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = old.select("doc_id", "line_no", "cells", same(cell(1)).alias("name")).withColumns({"nth": F.row_number().over(by_line), "of": F.count("*").over(whole)})
    met = numbered.join(listed_dates(dates), "doc_id").withColumn("partner", F.expr(PARTNER)).where("partner is not null")
    return met.select("doc_id", "line_no", new_cells().alias("cells"))


def table_line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def rolled_dates(rows: DataFrame, dates: DataFrame) -> DataFrame:
    """New texts of a syllabus's university-date rows ``(doc_id, line_no, new_text)``; rules as for ``paired_dates``."""
    new = paired_dates(tables_headed(rows, "event"), dates)
    return new.select("doc_id", "line_no", table_line(F.col("cells")).alias("new_text"))


def rolled_lines(rows: DataFrame, plan: DataFrame, targets: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """The lines of a syllabus in its new term: term line and schedule rows replaced, all other lines untouched.

    ``plan(doc_id, row_no, week_number, is_break, day, day_end, topics, assignments)`` holds the new rows, ``targets(doc_id, term)``
    the new terms, ``dates`` the new university dates. New rows stand where the old ones began; lines are numbered again. Lines
    are read once: what a line needs of its document comes from windows over it.
    """
    by_line = Window.partitionBy("doc_id").orderBy("line_no")
    so_far, whole = (by_line.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, Window.unboundedFollowing))
    in_table = lambda first: F.coalesce((F.col("head") == first) & (F.col("row_no") > 1), F.lit(False))
    lines = doc.table_lines(rows).withColumns({"is_old": in_table("week") & F.col("doc_id").isNotNull(), "is_date": in_table("event"), "is_term": F.coalesce(F.rlike("text", F.lit(r"(?i)^[*_#\s]*(?:term|semester)[*_\s]*:")), F.lit(False))})
    lines = lines.withColumn("cells", F.when(F.col("is_date"), doc.cells_of(F.col("text")))).withColumn("name", same(cell(1)))
    lines = lines.withColumns({"nth": F.count_if("is_date").over(so_far), "of": F.count_if("is_date").over(whole), "first_term": F.min(F.when(F.col("is_term"), F.col("line_no"))).over(whole)})
    lines = lines.join(targets.select("doc_id", F.col("term").alias("new_term")), "doc_id", "left")
    text = F.when((F.col("line_no") == F.col("first_term")) & F.col("new_term").isNotNull(), F.concat(F.regexp_extract("text", r"^([^:]*:[*_]*\s*)", 1), "new_term"))
    if dates is not None:
        lines = lines.join(listed_dates(dates), "doc_id", "left").withColumn("partner", F.when(F.col("is_date"), F.expr(PARTNER)))
        text = F.coalesce(text, F.when(F.col("partner").isNotNull(), table_line(new_cells())))
    lines = lines.select("doc_id", "line_no", F.lit(None).cast("int").alias("row_no"), "is_old", F.coalesce(text, F.col("text")).alias("text"))
    dates = F.when(F.col("is_break"), F.concat_ws(" - ", t.month_day(F.col("day")), t.month_day(F.col("day_end")))).otherwise(t.month_day(F.col("day")))
    week = F.when(F.col("is_break"), "-").otherwise(F.col("week_number").cast("string"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", week, dates, F.array_join("topics", "; "), F.array_join("assignments", "; ")), F.lit(" |"))
    fresh = plan.select("doc_id", F.lit(None).cast("int").alias("line_no"), "row_no", F.lit(False).alias("is_old"), line.alias("text"))
    # new rows (no line number) stand first among the lines here, and where the old ones began in the end
    every = lines.unionByName(fresh).withColumn("anchor", F.min(F.when(F.col("is_old"), F.col("line_no"))).over(Window.partitionBy("doc_id")))
    kept = every.where("not is_old and coalesce(line_no, anchor) is not null").withColumn("at", F.coalesce("line_no", "anchor"))
    return kept.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "row_no")).alias("line_no"), "text")
