"""Positioned page lines to paragraphs, parsed replies to documents, cells to schedule rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.extraction import week_label

GAP = 0.6  # of a line's height between two paragraphs
ROOM = 1.0  # character widths of slack at a line's right end


def bullet(text: Column) -> Column:
    return F.rlike(text, F.lit(r"^\s*(?:[-*•▪◦]|[0-9]{1,2}[.)])\s+\S"))


def caps(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text) & (F.length(F.trim(text)) <= 60)


def url_end(text: Column) -> Column:
    return F.rlike(text, F.lit(r"(?:\S*://\S*|(?:^|\s)www\.\S*)$"))


def reflow(lines: DataFrame) -> DataFrame:
    """Paragraphs of each page; ``lines(doc_id, page, line_no, text, x0, x1, top, bottom)``.

    A line goes on with the paragraph above it unless it is a bullet, follows a heading in capitals, a gap, or the end of a
    sentence, or its first word would have fitted on the line above; a line that starts in lower case or follows an open
    address always goes on. What only needs the line above is settled with ``lag``; an ordered fold a page joins the texts.
    """
    order = Window.partitionBy("doc_id", "page").orderBy("line_no")
    edge = F.max("x1").over(Window.partitionBy("doc_id", "page"))
    rows = lines.withColumn("text", F.trim("text")).where("text <> ''").withColumn("edge", edge)
    for c in ("text", "x0", "x1", "top", "bottom"):
        rows = rows.withColumn(f"p_{c}", F.lag(c).over(order))
    width = (F.col("p_x1") - F.col("p_x0")) / F.greatest(F.length("p_text"), F.lit(1))
    word = F.length(F.regexp_extract("text", r"^(\S+)", 1)) * width
    never = F.col("p_text").isNull() | bullet(F.col("text")) | caps(F.col("p_text")) | (F.col("top") - F.col("p_bottom") > GAP * (F.col("p_bottom") - F.col("p_top")))
    always = F.rlike("text", F.lit(r"^\p{Ll}")) | url_end(F.col("p_text"))
    full = (F.col("edge") - F.col("p_x1")) < word + width * (1 + ROOM)
    goes_on = F.when(never, False).when(always, True).when(F.rlike("p_text", F.lit(r"[.!?:;][\"'”’)]*$")), False).otherwise(full)
    marked = rows.select("doc_id", "page", "line_no", "text", F.coalesce(goes_on, F.lit(False)).alias("goes_on"))

    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        glue = F.when(url_end(last) | F.rlike(last, F.lit(r"\S-$")), "").otherwise(" ")
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(last, glue, x["text"])))
        return F.when(x["goes_on"] & (F.size(out) > 0), joined).otherwise(F.concat(out, F.array(x["text"])))

    listed = marked.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "text", "goes_on"))).alias("l"))
    folded = listed.withColumn("p", F.aggregate("l", F.array().cast("array<string>"), step))
    return folded.select("doc_id", "page", F.posexplode("p").alias("pos", "text"))


REPLY = "course struct<title:string,term:string,number:string>, weeks array<struct<week:int,date:string,topics:string>>, text string"


def joined_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(courses, weeks, errors) from the replies to a document's parts; ``replies(doc_id, part, text, cut_off)``.

    Of each course field the first that isn't blank counts. A week whose rows stand in two parts side by side becomes one,
    unless their dates differ. A reply that was cut off or can't be read, and a document without weeks, are errors.
    """
    parsed = replies.withColumn("r", F.from_json("text", REPLY))
    bad = parsed.where(F.col("cut_off") | F.col("r").isNull() | (F.col("r.course").isNull() & F.col("r.weeks").isNull() & F.col("r.text").isNull()))
    broken = bad.select("doc_id", F.when(F.col("cut_off"), "cut_off").otherwise("unreadable").alias("error_code"))
    first = lambda f: F.min_by(F.when(F.trim(f"r.course.{f}") != "", F.col(f"r.course.{f}")), F.when(F.trim(f"r.course.{f}") != "", F.col("part"))).alias(f)
    courses = parsed.groupBy("doc_id").agg(*(first(f) for f in ("title", "term", "number")))
    rows = parsed.select("doc_id", "part", F.posexplode("r.weeks").alias("pos", "w")).select("doc_id", "part", "pos", "w.*")
    order = Window.partitionBy("doc_id").orderBy("part", "pos")
    differs = (F.lag("week").over(order) != F.col("week")) | (F.lag("date").over(order) != F.col("date")) | F.lag("week").over(order).isNull()
    island = F.sum(F.coalesce(differs, F.lit(False)).cast("int")).over(order)
    merged = rows.withColumn("island", island).groupBy("doc_id", "island", "week").agg(
        F.min_by("date", F.when(F.col("date").isNotNull(), F.struct("part", "pos"))).alias("date"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "pos", "topics"))), lambda x: x["topics"]), "; ").alias("topics"),
    )
    weeks = merged.select("doc_id", F.col("island").cast("int").alias("row_no"), "week", "date", "topics")
    empty = parsed.select("doc_id").distinct().join(rows.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit("no_schedule").alias("error_code"))
    return courses, weeks, broken.unionByName(empty).distinct()


def cell_rows(cells: DataFrame, years: DataFrame) -> DataFrame:
    """Schedule rows from Word content as cells: kind, week, day, topics, assignments, notes.

    ``cells(doc_id, table_no, row_no, cell_no, para_no, text)``, ``years(doc_id, year)``. The first cell's label decides a
    row's kind; of the other cells a paragraph with "due" is an assignment, one that starts with "Note:" a note, the rest topics.
    """
    key = ["doc_id", "table_no", "row_no"]
    first = F.col("cell_no") == 0
    note = F.rlike("text", F.lit(r"(?i)^\s*note:"))
    due = F.rlike("text", F.lit(r"(?i)\bdue\b"))
    at = F.struct("cell_no", "para_no", F.trim("text").alias("t"))
    gather = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(~first & cond & (F.trim("text") != ""), at))), lambda x: x["t"])
    rows = cells.groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(first, at))), lambda x: x["t"]), " ").alias("label"),
        gather(~note & ~due).alias("topics"), gather(~note & due).alias("assignments"), F.array_join(gather(note), "; ").alias("notes"),
    ).join(years, "doc_id", "left")
    rows = rows.withColumn("l", week_label(F.col("label"), F.col("year")))
    kind = F.when(F.col("l.week_number").isNotNull() | F.col("l.day").isNotNull(), "week").when(F.rlike("label", F.lit(r"(?i)\b(?:break|no class|holiday)\b")), "break").otherwise("other")
    return rows.select(*key, "label", kind.alias("kind"), F.col("l.week_number").alias("week_number"), F.col("l.day").alias("day"), "topics", "assignments", F.regexp_replace("notes", r"(?i)note:\s*", "").alias("notes"))


def stitched(pieces: DataFrame) -> DataFrame:
    """Schedule pieces across pages as one table a module; ``pieces(doc_id, item_no, row_no, cells)``, row 0 the header.

    A piece whose header repeats the one before goes on with its table, without the header; another header starts a module.
    A row with a blank first cell was cut off: its cells are joined onto the row above, also across pages.
    """
    heads = pieces.where("row_no = 0").select("doc_id", "item_no", F.transform("cells", lambda c: F.lower(F.trim(c))).alias("head"))
    by_item = Window.partitionBy("doc_id").orderBy("item_no")
    changed = F.coalesce(F.lag("head").over(by_item) != F.col("head"), F.lit(True))
    modules = heads.withColumn("changed", changed).withColumn("module", F.sum(F.col("changed").cast("int")).over(by_item)).select("doc_id", "item_no", "module")
    rows = pieces.where("row_no > 0").join(modules, ["doc_id", "item_no"])
    in_order = Window.partitionBy("doc_id", "module").orderBy("item_no", "row_no")
    starts = F.trim(F.coalesce(F.try_element_at("cells", F.lit(1)), F.lit(""))) != ""
    rows = rows.withColumn("starts", starts).withColumn("nth", F.sum(F.col("starts").cast("int")).over(in_order))
    listed = rows.groupBy("doc_id", "module", "nth").agg(F.transform(F.array_sort(F.collect_list(F.struct("item_no", "row_no", "cells"))), lambda x: x["cells"]).alias("l"), F.max(F.size("cells")).alias("width"))
    cell = lambda i: F.array_join(F.filter(F.transform("l", lambda c: F.trim(F.coalesce(F.try_element_at(c, i), F.lit("")))), lambda x: x != ""), " ")
    return listed.select("doc_id", F.col("module").cast("int").alias("module"), F.col("nth").cast("int").alias("row_no"), F.transform(F.sequence(F.lit(1), "width"), cell).alias("cells"))
