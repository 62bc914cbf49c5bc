"""Queries over page lines, part replies and cells."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.functions import terms as t
from loomwork.operators import pages as p
from loomwork.plans.base import add
from loomwork.plans.text import page_lines
from loomwork.sources import fixtures as fx


def cells(s, d):
    """Schedule rows as cells: a label, then topic, assignment and note paragraphs."""
    w = fx.weeks(s, d)
    label = F.when(F.col("is_break"), F.col("label")).otherwise(F.concat("label", F.lit(" ("), t.month_day(F.col("day")), F.lit(")")))
    para = lambda c, n, text: F.struct(F.lit(c).alias("cell_no"), F.lit(n).alias("para_no"), text.alias("text"))
    parts = F.array(para(0, 0, label), para(1, 0, F.array_join("topics", "; ")), para(1, 1, F.array_join("assignments", "; ")), para(1, 2, F.concat(F.lit("Note: "), "notes")))
    return w.select(F.col("course_id").alias("doc_id"), F.lit(0).alias("table_no"), "row_no", F.explode(parts).alias("x")).select("doc_id", "table_no", "row_no", "x.*").where("text is not null")


def part_replies(s, d):
    """Courses as replies to two parts, the third week's last row cut in two."""
    w = fx.weeks(s, d).where("not is_break")
    row = F.struct(F.col("week_number").alias("week"), F.date_format("day", "M/d").alias("date"), F.array_join("topics", "").alias("topics"))
    again = w.where("week_number = 3").groupBy("course_id").agg(F.max("day").alias("day")).select("course_id", F.lit(2).alias("part"), F.lit(0).alias("row_no"), F.struct(F.lit(3).alias("week"), F.date_format("day", "M/d").alias("date"), F.lit("more").alias("topics")).alias("w"))
    rows = w.select("course_id", F.when(F.col("week_number") <= 3, 1).otherwise(2).alias("part"), "row_no", row.alias("w")).unionByName(again)
    listed = rows.groupBy("course_id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "w"))), lambda x: x["w"]).alias("weeks"))
    named = listed.join(fx.courses(s, d).select("course_id", "title", "term"), "course_id")
    reply = F.to_json(F.struct(F.struct(F.when(F.col("part") == 2, F.col("title")).otherwise(" ").alias("title"), F.when(F.col("part") == 1, F.col("term")).alias("term")).alias("course"), "weeks"))
    return named.select(F.col("course_id").alias("doc_id"), "part", reply.alias("text"), F.lit(False).alias("cut_off"))


add("e2_cell_rows", lambda s, d: p.cell_rows(cells(s, d), fx.weeks(s, d).groupBy(F.col("course_id").alias("doc_id")).agg(F.max(F.year("day")).alias("year"))).select("doc_id", "row_no", "kind", "week_number", "day", F.array_join("topics", "|").alias("topics"), F.array_join("assignments", "|").alias("assignments"), "notes"),
    """SELECT course_id AS doc_id, row_no, CASE WHEN is_break THEN 'break' ELSE 'week' END AS kind, week_number, CASE WHEN NOT is_break THEN day END AS day, array_to_string(topics, '|') AS topics, array_to_string(assignments, '|') AS assignments, coalesce(notes, '') AS notes FROM fx_weeks""")  # fmt: skip
add("e16_paragraphs", lambda s, d: p.reflow(page_lines(s, d).select("*", F.lit(72.0).alias("x0"), (72.0 + 5 * F.length("text")).alias("x1"))).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars")), None)
add("e20_joined_replies", lambda s, d: p.joined_replies(part_replies(s, d))[1],
    """SELECT course_id AS doc_id, (row_number() OVER (PARTITION BY course_id ORDER BY row_no))::INT AS row_no, week_number AS week, strftime(day, '%-m/%-d') AS date, array_to_string(topics, '') || CASE WHEN week_number = 3 AND row_no = max(row_no) OVER (PARTITION BY course_id, week_number) THEN '; more' ELSE '' END AS topics FROM fx_weeks WHERE NOT is_break""")  # fmt: skip
add("e20_reply_courses", lambda s, d: p.joined_replies(part_replies(s, d))[0], "SELECT course_id AS doc_id, title, term, NULL::VARCHAR AS number FROM fx_courses")


def pieces(s, d):
    """Schedules cut into pieces of four rows, every fourth week's row cut off in the middle."""
    w = fx.weeks(s, d).where("not is_break").withColumn("n", F.row_number().over(Window.partitionBy("course_id").orderBy("row_no")))
    item = F.floor(F.col("n") / 4).cast("int")
    rows = w.select(F.col("course_id").alias("doc_id"), item.alias("item_no"), (F.col("n") % 4 * 2 + 1).alias("row_no"), F.array("label", F.array_join("topics", "; "), F.lit("")).alias("cells"))
    cut = w.where("n % 4 = 3").select(F.col("course_id").alias("doc_id"), (item + 1).alias("item_no"), F.lit(0).alias("row_no"), F.array(F.lit(""), F.lit("went on"), F.lit("x")).alias("cells")).withColumn("row_no", F.lit(1))
    rows = rows.withColumn("row_no", F.col("row_no") + 1).unionByName(cut)
    head = rows.select("doc_id", "item_no").distinct().select("doc_id", "item_no", F.lit(0).alias("row_no"), F.array(F.lit("Week"), F.lit("Topic"), F.lit("Note")).alias("cells"))
    return rows.unionByName(head)


add("e18_stitched_tables", lambda s, d: p.stitched(pieces(s, d)).select("doc_id", "module", "row_no", F.array_join("cells", "|").alias("cells")),
    """SELECT course_id AS doc_id, 1::INT AS module, n::INT AS row_no, label || '|' || array_to_string(topics, '; ') || CASE WHEN n % 4 = 3 THEN ' went on|x' ELSE '|' END AS cells
    FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY row_no) AS n FROM fx_weeks WHERE NOT is_break)""")  # fmt: skip
