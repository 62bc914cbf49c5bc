"""Queries over flags, overrides and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import flags as f
from loomwork.functions import terms as t
from loomwork.plans.base import add
from loomwork.plans.text import LINES, document_lines
from loomwork.sources import fixtures as fx

def rows(s, d):
    return fx.weeks(s, d).select("course_id", "row_no", "week_number", "label", "is_break", F.coalesce("day", "date_start").alias("day"))

def chosen(s, d):
    return fx.courses(s, d).where("course_id % 10 = 1").select("course_id", F.lit(20).alias("row_no"), F.to_date(F.lit("2026-09-15")).alias("own_day"))

PICKED = "CASE course_id % 3 WHEN 0 THEN [0,2,4] WHEN 1 THEN []::INT[] ELSE [1,3] END"
LISTED = "CASE meeting_pattern WHEN 'MWF 9:00-9:50' THEN [0,2,4] WHEN 'Wednesday' THEN [2] WHEN 'Online' THEN []::INT[] ELSE [1,3] END"
LAST = "CASE WHEN is_break THEN trim(regexp_replace(label, '\\s*\\([^)]*\\)\\s*$', '')) ELSE 'Week ' || week_number END"

add("p8_schedule_choices", lambda s, d: f.schedule_choices(fx.courses(s, d).select("course_id", F.when(F.col("course_id") % 3 == 0, F.array(*map(F.lit, (0, 2, 4)))).when(F.col("course_id") % 3 == 1, F.array().cast("array<int>")).otherwise(F.array(F.lit(1), F.lit(3))).alias("picked_days"), t.meeting_days(F.col("meeting_pattern")).alias("listed_days")), fx.weeks(s, d).where("is_break").select("course_id", t.core_name(F.col("label")).alias("name"))),
    f"""SELECT course_id, CASE WHEN term = 'Fall 2026' AND course_id % 3 = 0 THEN 'Fall Break' ELSE '' END AS meets_through, len({PICKED}) > 0 AND len({LISTED}) > 0 AND array_to_string({PICKED}, '') <> array_to_string({LISTED}, '') AS days_changed FROM fx_courses""")
add("p9_preview", lambda s, d: f.preview(rows(s, d).select("*", F.when(F.col("row_no") < 100, F.col("day")).alias("old_day"), F.date_add("day", 364).alias("new_day"), F.when(F.col("row_no") == 30, "collision").alias("flags"))),
    f"""SELECT course_id, row_no, {LAST} AS name, CASE WHEN row_no < 100 THEN strftime(coalesce(day, date_start), '%b %-d, %Y') ELSE 'new' END AS was, strftime((coalesce(day, date_start) + 364)::DATE, '%b %-d, %Y') AS becomes, CASE WHEN row_no = 30 THEN 'collision' ELSE 'OK' END AS status FROM fx_weeks""")
add("j9_date_overrides", lambda s, d: f.override(rows(s, d), chosen(s, d)).select("course_id", "row_no", "day", "overridden", "place"),
    """WITH o AS (SELECT course_id, row_no, is_break, CASE WHEN course_id % 10 = 1 AND row_no = 20 AND NOT is_break THEN DATE '2026-09-15' ELSE coalesce(day, date_start) END AS day, course_id % 10 = 1 AND row_no = 20 AND NOT is_break AS overridden FROM fx_weeks)
    SELECT course_id, row_no, day, overridden, (row_number() OVER (PARTITION BY course_id ORDER BY day, is_break, row_no))::INT AS place FROM o""")  # fmt: skip
add("j11_stale_holidays", lambda s, d: f.stale_holidays(fx.university_dates(s, d).select("course_id", F.col("pos").alias("line_no"), F.concat(F.lit("Note: "), "event").alias("text")), fx.courses(s, d), fx.no_class(s)),
    """WITH n AS (SELECT DISTINCT term, lower(trim(regexp_replace(label, '\\s*\\([^)]*\\)\\s*$', ''))) AS name FROM fx_no_class), p AS (SELECT course_id, term, target_term FROM fx_courses WHERE split_part(term, ' ', 1) <> split_part(target_term, ' ', 1)),
      h AS (SELECT DISTINCT p.course_id, u.pos, 'Note: ' || event AS text FROM p JOIN fx_university_dates u USING (course_id) JOIN n USING (term) WHERE NOT EXISTS (SELECT 1 FROM n m WHERE m.term = p.target_term AND m.name = n.name) AND regexp_matches(u.event, '(?i)\\b' || n.name || '\\b'))
    SELECT course_id, (row_number() OVER (PARTITION BY course_id ORDER BY pos))::INT AS nth, pos AS line_no, text FROM h""")  # fmt: skip
add("j17_same_layout", lambda s, d: f.same_layout(rows(s, d), rows(s, d).where("course_id % 5 <> 0 or row_no <> 20")),
    "SELECT course_id, course_id % 5 <> 0 AS same FROM fx_courses")
add("j18_reviewed_details", lambda s, d: f.apply_edits(fx.courses(s, d), fx.courses(s, d).where("course_id % 2 = 0").select("course_id", fx.pick(F.col("course_id") % 4, "New title", "", " ").alias("new_title"), fx.pick(F.col("course_id") % 6, "3", "", "1.5", "", "three").alias("new_credits"))),
    """SELECT course_id, CASE WHEN course_id % 4 = 0 THEN 'New title' ELSE title END AS title, CASE WHEN course_id % 6 = 0 THEN 3.0 WHEN course_id % 6 = 2 THEN 1.5 END::DOUBLE AS credits, CASE WHEN course_id % 6 = 4 THEN 'bad_credits' END AS error_code FROM fx_courses""")  # fmt: skip
add("a14_week_flags", lambda s, d: f.week_flags(rows(s, d).select("course_id", "row_no", fx.pick(F.col("row_no") % 4, "collision", "clock", "break", "clock").alias("flag"))),
    """WITH g AS (SELECT course_id, CASE row_no % 4 WHEN 0 THEN 'collision' WHEN 2 THEN 'break' ELSE 'clock' END AS flag, min(row_no) AS first, count(*) AS n FROM fx_weeks GROUP BY ALL)
    SELECT course_id, string_agg(flag, ',' ORDER BY first) AS flags, sum(n)::BIGINT AS flag_count FROM g GROUP BY 1""")  # fmt: skip
add("j14_evidence_scores", lambda s, d: f.evidence_scores(fx.table(s, d, "lineitem").select(F.col("l_orderkey").alias("submission_id"), (F.col("l_linenumber") % 3).alias("pos"), (F.col("l_partkey") % 2).cast("int").alias("part"), (F.col("l_suppkey") % 3 > 0).alias("met"), F.when(F.col("l_quantity") > 10, F.array(F.lit("q"))).otherwise(F.array().cast("array<string>")).alias("evidence")), s.createDataFrame([(p, q, 2.0 * p + q + 1) for p in range(3) for q in range(2)], "pos int, part int, points double")),
    """SELECT l_orderkey AS submission_id, (l_linenumber % 3)::INT AS pos, sum(CASE WHEN l_suppkey % 3 > 0 AND l_quantity > 10 THEN 2.0 * (l_linenumber % 3) + l_partkey % 2 + 1 ELSE 0 END)::DOUBLE AS earned, count(*) FILTER (l_suppkey % 3 > 0 AND l_quantity <= 10) AS met_without_evidence FROM lineitem GROUP BY ALL""")  # fmt: skip
add("j15_source_errors", lambda s, d: f.source_errors(fx.table(s, d, "orders").select(F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 25).alias("project_id"), F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("syllabus.md"))).when(F.col("o_orderkey") % 4 == 1, F.array(F.lit("a.md"), F.lit("zz.md"))).when(F.col("o_orderkey") % 4 == 2, F.array(F.lit("a.md"))).otherwise(F.array().cast("array<string>")).alias("source_files")), s.range(25).select(F.col("id").alias("project_id"), F.explode(F.array(F.lit("a.md"), F.lit("syllabus.md"))).alias("filename"))),
    "SELECT o_orderkey AS request_id, CASE o_orderkey % 4 WHEN 1 THEN 'unknown_source' ELSE 'no_source' END AS error_code FROM orders WHERE o_orderkey % 4 <> 2")
add("j16_changed_paragraphs", lambda s, d: f.changed_paragraphs(document_lines(s, d).select("doc_id", F.col("line_no").alias("para_no"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text")), document_lines(s, d).select("doc_id", F.col("line_no").alias("para_no"), F.concat_ws(" ", F.when((F.col("line_no") % 3 == 0), F.lit("[new]")), F.trim(F.regexp_replace("text", r"\s+", " "))).alias("text"))).groupBy("doc_id").agg(F.count("*").alias("changed"), F.count_if((F.col("added") == "[new]") & (F.col("removed") == "")).alias("insertions")),
    f"WITH {LINES} SELECT doc_id, count(*) AS changed, count(*) FILTER (trim(text) <> '') + count(*) FILTER (trim(text) = '') AS insertions FROM lines WHERE line_no % 3 = 0 GROUP BY 1")
add("e17_real_tables", lambda s, d: f.tidy_tables(document_lines(s, d).select("doc_id", (F.floor(F.col("line_no") / 4)).cast("int").alias("item_no"), F.col("line_no").alias("row_no"), F.array(F.when(F.col("line_no") % 8 == 0, F.concat(F.lit("Week "), "line_no")).otherwise(F.col("text")), F.when(F.col("doc_id") % 2 == 0, "--").otherwise("x")).alias("cells"))),
    f"""WITH {LINES}, c AS (SELECT doc_id, (line_no // 4)::INT AS item_no, CASE WHEN line_no % 8 = 0 THEN 'Week ' || line_no ELSE trim(text, ' ') END AS a, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'x' END AS b FROM lines),
      r AS (SELECT *, (CASE WHEN regexp_full_match(a, '[-–—]+') OR a = '' THEN 0 ELSE 1 END) + (CASE WHEN b = '' THEN 0 ELSE 1 END) AS filled FROM c)
    SELECT doc_id, item_no, count(*) AS rows, bool_or(regexp_matches(a, '^[Ww]eek\\s+[0-9]+')) OR 2 * count(*) FILTER (filled >= 2) > count(*) AS is_real FROM r WHERE filled > 0 GROUP BY ALL""")  # fmt: skip


def paragraphs(s, d, changed: bool):
    """Lines whose words are numbered, so none comes twice; changed: the fifth word is another, every third line has one more
    behind its second word, every seventh document a line more."""
    words = F.transform(F.filter(F.split("text", r"[ \t\r\x0b\f]+"), lambda w: w != ""), lambda w, i: F.concat(w, F.lit("~"), i.cast("string")))
    lines = document_lines(s, d).select("doc_id", F.col("line_no").alias("para_no"), words.alias("w"))
    if not changed:
        return lines.select("doc_id", "para_no", F.array_join("w", " ").alias("text"))
    put = F.when(F.col("para_no") % 3 == 1, F.concat(F.slice("w", 1, 2), F.array(F.lit("put")), F.slice("w", F.lit(3), F.greatest(F.size("w") - 2, F.lit(0))))).otherwise(F.transform("w", lambda x, i: F.when(i == 4, "other").otherwise(x)))
    new = lines.select("doc_id", "para_no", F.array_join(F.when(F.size("w") >= 2, put).otherwise(F.col("w")), " ").alias("text"))
    return new.unionByName(new.where("doc_id % 7 = 0 and para_no = 0").withColumn("para_no", F.lit(-1)))


add("j16_word_changes", lambda s, d: f.word_changes(paragraphs(s, d, False), paragraphs(s, d, True)),
    f"""WITH {LINES}, w AS (SELECT doc_id, line_no, list_transform(list_filter(string_split_regex(text, '[ \\t\\r\\x0b\\f]+'), lambda x: x <> ''), lambda x, i: x || '~' || (i - 1)) AS w FROM lines),
      c AS (SELECT *, len(w) AS n, CASE WHEN line_no % 3 = 1 THEN 2 ELSE 5 END AS i FROM w WHERE len(w) >= CASE WHEN line_no % 3 = 1 THEN 2 ELSE 5 END AND doc_id % 7 <> 0),
      e AS (SELECT *, CASE WHEN n - i <= 2 THEN n ELSE i END AS upto FROM c)
    SELECT doc_id, line_no::INT AS para_no, 0 AS nth, array_to_string(w[i:upto], ' ') AS old, concat_ws(' ', CASE WHEN i = 2 THEN w[2] || ' put' ELSE 'other' END, CASE WHEN upto > i THEN array_to_string(w[i + 1:upto], ' ') END) AS new,
      array_to_string(w[greatest(i - 2, 1):i - 1], ' ') AS context, NULL::VARCHAR AS error_code FROM e
    UNION ALL SELECT DISTINCT doc_id, NULL::INT, NULL::INT, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, 'paragraph_count' FROM lines WHERE doc_id % 7 = 0""")  # fmt: skip
