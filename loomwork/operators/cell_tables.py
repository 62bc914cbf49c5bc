"""Word tables as rows of cells: clean-up, and schedules written back in their new term. Set-based per document.

``rows(doc_id, table_no, row_no, cells)``: a cell's paragraphs are its lines. A schedule has at most a term's rows, so joins
of its breaks with its weeks stay small; documents never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import terms as t
from loomwork.operators.extraction import paired_dates
from loomwork.sources.files import settled

LABEL = r"(?i)\bweek\s+([0-9]+)(\s*\(\s*([^()]*?)\s*\))?"
BREAK = r"(?i)\b(?:break|no class|holiday)\b"
NO_CLASS = "No class"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
LAST = 1 << 30  # behind every row of a table


def first_cell(cells: Column) -> Column:
    return F.coalesce(F.try_element_at(cells, F.lit(1)), F.lit(""))


def style_of(date: Column) -> Column:
    """How the date of a label is written; null where it isn't one."""
    is_like = lambda pattern: F.rlike(date, F.lit(pattern))
    month = F.lower(F.substring(date, 1, 3)).isin(*MONTHS)
    return (
        F.when(is_like("^[0-9]{1,2}/[0-9]{1,2}$"), "m/d").when(~month, None).when(is_like(r"^[A-Za-z]{3,4}\. ?[0-9]{1,2}$"), "Mon. d")
        .when(is_like(r"^[A-Za-z]{3} [0-9]{1,2}$"), "Mon d").when(is_like(r"^[A-Za-z]{4,} [0-9]{1,2}$"), "Month d")
    )


def labelled_rows(rows: DataFrame) -> DataFrame:
    """Rows of schedule tables with kind (head, week, break, other), week_number, meeting (by place, over all of a document's
    tables) and the style of their label."""
    line = F.coalesce(F.try_element_at(F.filter(F.split(first_cell(F.col("cells")), "\n"), lambda x: F.rlike(x, F.lit(LABEL))), F.lit(1)), F.lit(""))
    number = F.regexp_extract(line, LABEL, 1).try_cast("int")
    kind = F.when(F.col("row_no") == 0, "head").when(number.isNotNull(), "week").when(F.rlike(first_cell(F.col("cells")), F.lit(BREAK)), "break").otherwise("other")
    found = rows.withColumn("kind", kind).withColumn("week_number", F.when(F.col("kind") == "week", number)).withColumn("style", F.when(F.col("kind") == "week", F.coalesce(style_of(F.regexp_extract(line, LABEL, 3)), F.lit("undated"))))
    nth = F.row_number().over(Window.partitionBy("doc_id", "week_number").orderBy("table_no", "row_no"))
    return found.withColumn("meeting", F.when(F.col("kind") == "week", nth))


def relabelled(cells: Column, label: Column) -> Column:
    """Cells whose first label takes a new date; the text around it stays."""
    lines = F.split(first_cell(cells), "\n")
    at = F.array_position(F.transform(lines, lambda x: F.rlike(x, F.lit(LABEL))), True)
    new = F.array_join(F.transform(lines, lambda x, i: F.when(i + 1 == at, F.regexp_replace(x, LABEL, label)).otherwise(x)), "\n")
    return F.concat(F.array(new), F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))))


def filled(width: Column, first: Column, second: Column) -> Column:
    """A row of ``width`` cells: a label, then lines in the second cell, the others empty; all in one cell if there is but one."""
    lines = F.array_join(second, "\n")
    rest = F.when(width > 2, F.array_repeat(F.lit(""), F.greatest(width - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.when(width > 1, F.concat(F.array(first, lines), rest)).otherwise(F.array(F.array_join(F.concat(F.array(first), second), "\n")))


def rolled_cells(rows: DataFrame, schedule: DataFrame) -> DataFrame:
    """The schedule tables of each document in its new term.

    ``schedule(doc_id, week_number, meeting, is_break, day, date_start, label, topics, assignments, notes)``. Rows of weeks that
    stay get the new date in their label's own style; rows of weeks that are gone are left out; new weeks follow the last
    week that stays, as its table's rows are. Break rows stand before the first week, in that order, that begins after them,
    else at the end of the last table: the old ones are used again in order, further ones are like the first; where there were
    none they are made like a week's row. Header and other rows stay where they are. Returns doc_id, table_no, row_no (counted
    again), kind and cells; ``schedule`` without rows for a document leaves it its header and other rows.
    """
    told = settled(labelled_rows(rows))
    schedule = settled(schedule)
    new = schedule.where("not is_break and day is not null").select("doc_id", "week_number", F.coalesce("meeting", F.lit(1)).cast("int").alias("meeting"), "day", "topics", "assignments", "notes")
    place = lambda table, row, rank, nth, part: F.struct(table.alias("table_no"), row.alias("row"), F.lit(rank).alias("rank"), nth.alias("nth"), part.alias("part"))
    none = F.lit(LAST)
    own = place(F.col("table_no"), F.col("row_no"), 1, F.lit(0), none)
    weeks = told.where("kind = 'week'")
    kept = weeks.join(new.select("doc_id", "week_number", "meeting", "day"), ["doc_id", "week_number", "meeting"])
    label = t.written_label(F.col("week_number").cast("string"), F.col("day"), F.col("style"))
    stay = kept.select("doc_id", "day", own.alias("at"), F.when(F.col("style") == "undated", F.col("cells")).otherwise(relabelled(F.col("cells"), label)).alias("cells"))
    # what new rows are like, and where they go
    like = F.max_by(F.struct(F.size("cells").alias("width"), "style"), F.struct("table_no", "row_no"))
    shape = weeks.groupBy("doc_id").agg(like.alias("like"))
    ends = told.groupBy("doc_id").agg(F.max("table_no").alias("last_table"))
    anchor = kept.groupBy("doc_id").agg(F.max(F.struct("table_no", "row_no")).alias("anchor"))
    added = new.join(weeks.select("doc_id", "week_number", "meeting"), ["doc_id", "week_number", "meeting"], "left_anti")
    added = added.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("week_number", "meeting"))).join(shape, "doc_id").join(ends, "doc_id").join(anchor, "doc_id", "left")
    content = F.concat("topics", "assignments", F.when(F.trim("notes") != "", F.array(F.concat(F.lit("Note: "), "notes"))).otherwise(F.array().cast("array<string>")))
    title = t.written_label(F.col("week_number").cast("string"), F.col("day"), F.col("like.style"))
    behind = place(F.coalesce("anchor.table_no", "last_table"), F.coalesce("anchor.row_no", none), 2, F.col("nth"), none)
    grown = added.select("doc_id", "day", behind.alias("at"), filled(F.col("like.width"), title, content).alias("cells"))
    dated = settled(stay.unionByName(grown))
    # breaks: the old rows in order, then copies of the first, else rows made like a week's
    breaks = schedule.where("is_break").select("doc_id", "date_start", "label", F.row_number().over(Window.partitionBy("doc_id").orderBy("date_start", "label")).alias("nth"))
    old = told.where("kind = 'break'").select("doc_id", "cells", F.row_number().over(Window.partitionBy("doc_id").orderBy("table_no", "row_no")).alias("nth"))
    first = old.where("nth = 1").select("doc_id", F.col("cells").alias("first"))
    width = dated.groupBy("doc_id").agg(F.min_by(F.size("cells"), "at").alias("width"))
    later = breaks.join(dated.select("doc_id", "day", F.col("at").alias("week_at")), "doc_id", "left")
    before = later.groupBy("doc_id", "nth", "date_start", "label").agg(F.min(F.when(F.col("day") > F.col("date_start"), F.col("week_at"))).alias("week_at"))
    met = before.join(old, ["doc_id", "nth"], "left").join(first, "doc_id", "left").join(width, "doc_id", "left").join(ends, "doc_id")
    used = F.coalesce("cells", "first")
    renamed = F.concat(F.array(F.concat(F.col("label"), F.regexp_extract(first_cell(used), r"(?s)^[^\n]*(.*)$", 1))), F.slice(used, F.lit(2), F.greatest(F.size(used) - 1, F.lit(0))))
    made = filled(F.col("width"), F.col("label"), F.array(F.lit(NO_CLASS)))
    at_end = place(F.col("last_table"), none, 3, F.lit(0), F.col("nth"))
    in_front = place(F.col("week_at.table_no"), F.col("week_at.row"), 0, F.when(F.col("week_at.rank") == 2, F.col("week_at.nth")).otherwise(0), F.col("nth")).withField("rank", F.when(F.col("week_at.rank") == 2, 2).otherwise(0))
    placed = met.where(used.isNotNull() | F.col("width").isNotNull()).select("doc_id", F.when(F.col("week_at").isNotNull(), in_front).otherwise(at_end).alias("at"), F.when(used.isNotNull(), renamed).otherwise(made).alias("cells"))
    rest = told.where("kind in ('head', 'other')").select("doc_id", own.alias("at"), "cells", "kind")
    every = dated.select("doc_id", "at", "cells", F.lit("week").alias("kind")).unionByName(placed.select("doc_id", "at", "cells", F.lit("break").alias("kind"))).unionByName(rest)
    number = F.row_number().over(Window.partitionBy("doc_id", "at.table_no").orderBy("at")) - 1
    return every.select("doc_id", F.col("at.table_no").alias("table_no"), number.cast("int").alias("row_no"), "kind", "cells")


def rolled_date_cells(rows: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows of university-date tables (a header with "event" and "date") with their new event and date in the first two
    cells, further cells as they were; ``dates(doc_id, pos, event, day, date_start, date_end)``."""
    names = F.transform("cells", lambda c: F.lower(F.trim(c)))
    heads = rows.where((F.col("row_no") == 0) & F.array_contains(names, "event") & F.array_contains(names, "date")).select("doc_id", "table_no")
    body = rows.where("row_no > 0").join(heads, ["doc_id", "table_no"])
    keyed = body.select("doc_id", F.struct("table_no", "row_no").alias("line_no"), "cells")
    return paired_dates(keyed, dates).select("doc_id", "line_no.*", "cells")


def tidy_rows(tables: DataFrame) -> DataFrame:
    """Rows of tables as they were found on pages, cleaned: cells that hold but a dash are empty, empty rows and columns go,
    short rows are padded, and a week's label moves from the second cell into an empty first one.

    ``tables(doc_id, item_no, row_no, cells)``; returns the rows that are left, numbered again, with ``is_real``: a row names
    a week, or the table has two rows or more and most fill two cells or more.
    """
    key = ["doc_id", "item_no"]
    clean = F.transform("cells", lambda c: F.when(F.rlike(F.trim(F.coalesce(c, F.lit(""))), F.lit("^[-–—]+$")), "").otherwise(F.trim(F.coalesce(c, F.lit("")))))
    rows = tables.withColumn("cells", clean).where(F.exists("cells", lambda c: c != ""))
    width = F.max(F.size("cells")).over(Window.partitionBy(*key))
    padded = rows.withColumn("width", width).withColumn("cells", F.concat("cells", F.array_repeat(F.lit(""), F.col("width") - F.size("cells"))))
    second = F.try_element_at("cells", F.lit(2))
    moved = (F.element_at("cells", 1) == "") & F.coalesce(F.rlike(second, F.lit(r"(?i)^week\s+[0-9]+")), F.lit(False))
    padded = padded.withColumn("cells", F.when(moved, F.concat(F.array(second, F.lit("")), F.slice("cells", F.lit(3), F.greatest(F.col("width") - 2, F.lit(0))))).otherwise(F.col("cells")))
    # columns that are empty all the way: by place, over all rows of the table
    shown = padded.select(*key, F.posexplode("cells").alias("place", "c")).where("c <> ''").groupBy(*key).agg(F.array_sort(F.collect_set("place")).alias("places"))
    kept = padded.join(shown, key).withColumn("cells", F.transform("places", lambda i: F.element_at("cells", i + 1)))
    full = F.size(F.filter("cells", lambda c: c != ""))
    table = Window.partitionBy(*key)
    is_week = F.rlike(F.element_at("cells", 1), F.lit(r"(?i)^week\s+[0-9]+"))
    real = (F.max("width").over(table) >= 2) & (F.bool_or(is_week).over(table) | ((F.count("*").over(table) >= 2) & (2 * F.count_if(full >= 2).over(table) > F.count("*").over(table))))
    return kept.select(*key, F.row_number().over(table.orderBy("row_no")).alias("row_no"), "cells", real.alias("is_real"))


# What the first column of a schedule without dates is called, and words of columns that hold assignments.
NUMBERED = ("week", "meeting", "session", "module", "class", "lesson", "unit")
NUMBERED_COLUMNS = (*NUMBERED, *(f"{n}s" for n in NUMBERED), "classes", "#", "no", "no.")
WORK_COLUMNS = ("assignment", "assignments", "deliverable", "deliverables")  # as a header's first word; "due" as any
RANGE = r"([0-9]{1,2}/[0-9]{1,2})\s*[-–—]\s*([0-9]{1,2}/[0-9]{1,2})"
BARE = rf"(?i)^\s*(?:{'|'.join(NUMBERED)})?\s*([0-9]{{1,2}})(?![0-9A-Za-z/(])"


def day_of(date: Column, year: Column) -> Column:
    """The date that "8/24", "Jan. 6" or "January 6" means in a year; null for anything else."""
    month = F.when(F.contains(date, F.lit("/")), F.substring_index(date, "/", 1).try_cast("int")).otherwise(F.month(F.try_to_date(F.concat_ws(" ", F.initcap(F.substring(F.ltrim(date), 1, 3)), F.lit("1 2000")), "MMM d yyyy")))
    return F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(date, "([0-9]{1,2})\\s*$", 1), 2, "0")), "yyyy-MM-dd")


def schedule_rows(rows: DataFrame, years: DataFrame) -> DataFrame:
    """Schedules from Word tables: doc_id, table_no, row_no, kind, week_number, day, date_start, date_end, topics, assignments,
    notes, error_code.

    ``years(doc_id, year, week_one)``: the term's year and provisional Week 1. A table counts if a row behind its first begins with
    a week and date, or if it has no such row, its first header names NUMBERED_COLUMNS and two rows or more begin with a number:
    those weeks are a week apart from Week 1. A row with a span of dates in its first two cells is a break; one that says "break"
    without is an error (``bad_break``). The header is the last row before the first week: all lines in columns that it heads with
    WORK_COLUMNS or "due" are assignments; elsewhere lines with the word "due" are. Lines that begin with "Note:" are notes, all others topics,
    what stands behind the label too. Rows that are neither week nor break are left out.
    """
    table = Window.partitionBy("doc_id", "table_no")
    first = first_cell(F.col("cells"))
    dated_line = F.try_element_at(F.filter(F.split(first, "\n"), lambda x: F.rlike(x, F.lit(LABEL)) & style_of(F.regexp_extract(x, LABEL, 3)).isNotNull()), F.lit(1))
    told = rows.join(years, "doc_id", "left").withColumn("dated", F.when(F.col("row_no") > 0, dated_line)).withColumn("bare", F.when(F.col("row_no") > 0, F.regexp_extract(first, BARE, 1).try_cast("int")))
    heads = F.bool_or((F.col("row_no") == 0) & F.lower(F.trim(first)).isin(*NUMBERED_COLUMNS)).over(table)
    any_date = F.bool_or(F.col("dated").isNotNull()).over(table)
    told = told.withColumn("any_date", any_date).withColumn("undated", ~F.col("any_date") & heads & (F.count("bare").over(table) >= 2)).where("any_date or undated")
    number = F.when(F.col("undated"), F.col("bare")).otherwise(F.regexp_extract("dated", LABEL, 1).try_cast("int"))
    told = told.withColumn("week_number", number)
    # columns of assignments, by the last row before the first week
    start = F.min(F.when(F.col("week_number").isNotNull(), F.col("row_no"))).over(table)
    head = F.max_by("cells", F.when(F.col("row_no") < F.col("start"), F.col("row_no"))).over(table)
    told = told.withColumn("start", start).withColumn("head", head)
    words = lambda c: F.split(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z]+")
    names_work = lambda c: words(c)[0].isin(*WORK_COLUMNS) | F.array_contains(words(c), "due")
    told = told.withColumn("work", F.transform("head", lambda c, i: (i > 0) & names_work(c)))
    two = F.concat_ws(" ", F.slice("cells", 1, 2))
    span = F.rlike(two, F.lit(RANGE))
    says_break = F.contains(F.lower(first), F.lit("break"))
    kind = F.when(F.col("week_number").isNotNull(), "week").when(F.col("row_no") == 0, None).when(span | says_break, "break")
    told = told.withColumn("kind", kind).where("kind is not null")
    # lines of all cells in order; of the label's own line what stands behind the label
    stripped = lambda x, i: F.when(F.col("undated") & (i == 0), F.regexp_replace(x, BARE, "")).when(~F.col("undated"), F.regexp_replace(x, rf"(?i)^.*?{LABEL.removeprefix('(?i)')}", "")).otherwise(x)
    after = F.transform(F.split(first, "\n"), lambda x, i: F.btrim(stripped(x, i), F.lit(" \t:;,-–—")))
    lines = F.flatten(F.transform("cells", lambda c, i: F.transform(F.when(i == 0, after).otherwise(F.split(F.coalesce(c, F.lit("")), "\n")), lambda x: F.struct(F.trim(x).alias("text"), F.coalesce(F.try_element_at("work", i + 1), F.lit(False)).alias("work")))))
    full = F.filter(lines, lambda x: x["text"] != "")
    told = told.withColumn("lines", F.when(F.col("kind") == "week", full))
    note = r"(?i)^notes?:\s*"
    is_note = lambda x: F.rlike(x["text"], F.lit(note))
    is_work = lambda x: ~is_note(x) & (x["work"] | F.rlike(x["text"], F.lit(r"(?i)\bdue\b")))
    texts = lambda keep: F.coalesce(F.transform(F.filter("lines", keep), lambda x: x["text"]), F.array().cast("array<string>"))
    day = F.when(F.col("undated"), F.date_add("week_one", (7 * (F.col("week_number") - 1)).cast("int"))).otherwise(day_of(F.regexp_extract("dated", LABEL, 3), F.col("year")))
    edge = lambda n: F.when(F.col("kind") == "break", day_of(F.nullif(F.regexp_extract(two, RANGE, n), F.lit("")), F.col("year")))
    notes = F.array_join(F.transform(texts(is_note), lambda x: F.regexp_replace(x, note, "")), " ")
    return told.select(
        "doc_id", "table_no", "row_no", "kind", "week_number", F.when(F.col("kind") == "week", day).alias("day"), edge(1).alias("date_start"), edge(2).alias("date_end"),
        texts(lambda x: ~is_note(x) & ~is_work(x)).alias("topics"), texts(is_work).alias("assignments"), F.nullif(notes, F.lit("")).alias("notes"),
        F.when((F.col("kind") == "break") & ~span, "bad_break").when((F.col("kind") == "week") & day.isNull(), "bad_date").alias("error_code"),
    )
