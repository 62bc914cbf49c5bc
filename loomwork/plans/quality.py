"""Queries over drafts, decks, and the smaller steps of a rollover."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import quality as q
from loomwork.operators import rollover as r
from loomwork.plans.base import add
from loomwork.plans.rollover import planned
from loomwork.sources import fixtures as fx


def drafts(s, d):
    """Whole documents as drafts, with lines that a model might have added."""
    extra = fx.pick(F.col("doc_id") % 6, "\nSubmit it on Canvas.", "\n## Submission\nUpload a file.\n## Next\nMore.", "\nYou must write a report.", "\n## Grading\nTen points.", "\nThe format was not specified.", "\nYou may add a diagram.")
    return fx.table(s, d, "documents").select(F.col("doc_id").alias("draft_id"), F.col("doc_id").alias("request_id"), F.concat_ws("", F.lit("# Draft\n"), "text", extra).alias("text"))


def requests(s, d):
    return fx.table(s, d, "documents").select(F.col("doc_id").alias("request_id"), fx.pick(F.col("doc_id") % 5, "Ask for a report.", "Hand in by email.", "Do not require a report.", "Discuss it.").alias("text"))


DRAFTS = """d AS (SELECT doc_id, doc_id % 5 = 1 AS may_hand_in, doc_id % 5 = 0 AS may_report, concat('# Draft' || chr(10), text, replace(CASE doc_id % 6 WHEN 0 THEN '~Submit it on Canvas.' WHEN 1 THEN '~## Submission~Upload a file.~## Next~More.' WHEN 2 THEN '~You must write a report.'
    WHEN 3 THEN '~## Grading~Ten points.' WHEN 4 THEN '~The format was not specified.' ELSE '~You may add a diagram.' END, '~', chr(10))) AS text FROM documents)"""
IS = lambda p: f"regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}')"
AROUND = ", ".join(f"'{w}'" for w in q.AROUND)
IS_SUBMISSION = f"({IS(q.HEADING)} AND list_filter(string_split_regex(lower(trim(ltrim(t, '#'))), '\\s+'), lambda w: w NOT IN ({AROUND})) = ['submission'])"
DEMANDED = f"{IS(q.DEMAND)} AND NOT {IS(q.OPTIONAL)} AND NOT {IS(q.NEGATED)}"
NEEDS = ", ".join(f"coalesce(bool_or({DEMANDED} AND {IS(f'(?i){chr(92)}b(?:{p})s?{chr(92)}b')}), false) AS needs_{a}" for a, p in q.ARTEFACTS.items())
UNASKED = ", ".join(f"CASE WHEN needs_{a}{' AND NOT may_report' if a == 'report' else ''} THEN 'unasked_{a}' END" for a in q.ARTEFACTS)

add("e11_draft_review", lambda s, d: q.review(drafts(s, d), requests(s, d)),
    f"""WITH {DRAFTS}, s AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+')) AS t FROM d),
      a AS (SELECT doc_id, bool_or({IS(q.HAND_IN)} AND {IS(q.PLACE)}) AS logistics, bool_or({IS_SUBMISSION}) AS sub, bool_or({IS(q.EVALUATION)}) AS ev, bool_or({IS(q.MISSING_NOTE)}) AS missing, {NEEDS} FROM s WHERE t <> '' GROUP BY 1),
      c AS (SELECT doc_id, concat_ws(',', CASE WHEN logistics AND NOT may_hand_in THEN 'submission_logistics' END, CASE WHEN sub AND NOT may_hand_in THEN 'submission_section' END, CASE WHEN ev THEN 'evaluation_section' END, CASE WHEN missing THEN 'missing_information_note' END, {UNASKED}) AS issues FROM d JOIN a USING (doc_id))
    SELECT doc_id AS draft_id, issues, (CASE WHEN issues = '' THEN 0 ELSE len(string_split(issues, ',')) END)::INT AS n_issues FROM c""")  # fmt: skip
add("e12_draft_clean_up", lambda s, d: q.clean_up(drafts(s, d), requests(s, d)).select("draft_id", F.sha2("text", 256).alias("text_sha256"), "removed_lines"),
    f"""WITH {DRAFTS}, l AS (SELECT doc_id, may_hand_in, unnest(generate_series(0, len(x) - 1)) AS n, unnest(x) AS t FROM (SELECT *, string_split(text, chr(10)) AS x FROM d)),
      h AS (SELECT *, last_value(CASE WHEN {IS(q.HEADING)} THEN {IS_SUBMISSION} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM l),
      g AS (SELECT *, (NOT may_hand_in AND (coalesce(sec, false) OR ({IS(q.HAND_IN)} AND {IS(q.PLACE)}))) OR {IS(q.MISSING_NOTE)} AS gone FROM h)
    SELECT doc_id AS draft_id, sha256(trim(regexp_replace(regexp_replace(string_agg(t, chr(10) ORDER BY n) FILTER (NOT gone), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g'), ' ')) AS text_sha256, count(*) FILTER (gone) AS removed_lines FROM g GROUP BY 1""")  # fmt: skip
add("e13_revision_choice", lambda s, d: q.choose_revision(fx.table(s, d, "documents").select(F.col("doc_id").alias("draft_id"), F.lit("The").alias("name"), F.lit("old").alias("text"), (F.col("doc_id") % 3).alias("n_issues"), F.col("text").alias("revised_text"), F.lit(1).alias("revised_issues"))).select("draft_id", "revised", F.sha2("text", 256).alias("text_sha256")),
    "WITH c AS (SELECT doc_id, text, length(trim(text)) > 120 AND contains(lower(text), 'the') AND doc_id % 3 = 2 AS u FROM documents) SELECT doc_id AS draft_id, u AS revised, sha256(CASE WHEN u THEN text ELSE 'old' END) AS text_sha256 FROM c")
add("w7_numbered_slides", lambda s, d: q.number_slides(fx.table(s, d, "documents").select(F.col("doc_id").alias("deck_id"), F.concat(F.lit("Deck "), "doc_id").alias("title"), F.concat_ws("", F.when(F.col("doc_id") % 2 == 0, F.lit("---\nsubtitle: x\nauthor: a\n---\n")), F.lit("# One\n<!-- Slide 9 -->\n"), "text", F.lit("\n## Two")).alias("text"))).select("deck_id", "slides", F.sha2("text", 256).alias("text_sha256")),
    """WITH d AS (SELECT doc_id, string_split(concat('# One' || chr(10) || '<!-- Slide 9 -->' || chr(10), text, chr(10) || '## Two'), chr(10)) AS x FROM documents), l AS (SELECT doc_id, unnest(generate_series(0, len(x) - 1)) AS n, unnest(x) AS t FROM d),
      k AS (SELECT doc_id, n, CASE WHEN regexp_matches(t, '^#\\s+\\S') THEN '#' || t ELSE t END AS t FROM l WHERE NOT regexp_matches(t, '(?i)^\\s*<!--\\s*slide\\s+[0-9]+')), c AS (SELECT *, count(*) FILTER (t LIKE '## %') OVER (PARTITION BY doc_id ORDER BY n) AS slide FROM k),
      b AS (SELECT doc_id, max(slide)::INT AS slides, string_agg(CASE WHEN t LIKE '## %' THEN chr(10) || '<!-- Slide ' || slide || ' -->' || chr(10) ELSE '' END || t, chr(10) ORDER BY n) AS body FROM c GROUP BY 1)
    SELECT doc_id AS deck_id, slides, sha256('---' || chr(10) || 'title: "Deck ' || doc_id || '"' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'author: a' ELSE '' END || chr(10) || '---' || chr(10) || chr(10) || '<!-- AI draft -->' || chr(10) || chr(10)
      || regexp_replace(regexp_replace(body, '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') || chr(10)) AS text_sha256 FROM b""")  # fmt: skip
add("w5_schedule_tables", lambda s, d: q.schedule_tables(fx.weeks(s, d).where("not is_break").select(F.col("course_id").alias("doc_id"), F.when(F.col("course_id") % 3 == 0, 1).when(F.col("course_id") % 3 == 1, F.floor(F.col("week_number") / 4)).otherwise(F.col("week_number") % 2).cast("int").alias("table_no"), "week_number")),
    """WITH x AS (SELECT course_id AS doc_id, (CASE course_id % 3 WHEN 0 THEN 1 WHEN 1 THEN week_number // 4 ELSE week_number % 2 END) AS table_no, week_number FROM fx_weeks WHERE NOT is_break)
    SELECT doc_id, count(DISTINCT table_no) AS tables, CASE WHEN doc_id % 3 = 0 THEN 'one' WHEN doc_id % 3 = 1 THEN 'continued' ELSE 'ambiguous' END AS status FROM x GROUP BY doc_id""")  # fmt: skip
add("j6_breaks_not_taken", lambda s, d: r.not_observed(fx.weeks(s, d), fx.courses(s, d), fx.courses(s, d).select("course_id", fx.pick(F.col("course_id") % 2, "fall break", "spring break").alias("name"))),
    "SELECT course_id, row_no, 'Fall Break' AS dropped FROM fx_weeks WHERE is_break AND course_id % 2 = 0")
add("u1_added_breaks", lambda s, d: r.added_break_rows(planned(s, d).select("course_id", F.explode("breaks").alias("b")).select("course_id", "b.label", F.col("b.s").alias("date_start"), F.col("b.e").alias("date_end")), fx.weeks(s, d).where("is_break").select("course_id", "label", F.date_add("date_start", 364).alias("date_start"), F.date_add("date_end", 364).alias("date_end"))),
    """WITH s AS (SELECT course_id, label, n.date_start, n.date_end FROM fx_courses c JOIN fx_no_class n ON n.term = c.target_term AND n.date_start IS NOT NULL)
    SELECT course_id, date_start, date_end, label || ' (' || month(date_start) || '/' || day(date_start) || ' - ' || month(date_end) || '/' || day(date_end) || ')' AS label FROM s WHERE NOT EXISTS (SELECT 1 FROM fx_weeks w WHERE w.course_id = s.course_id AND is_break AND w.date_start + 364 = s.date_start AND w.date_end + 364 = s.date_end)""")  # fmt: skip
add("u2_unnamed_entries", lambda s, d: r.unnamed_entries(planned(s, d), fx.university_dates(s, d), fx.no_class(s)),
    """SELECT course_id, label FROM fx_courses c JOIN fx_no_class n ON n.term = c.target_term WHERE NOT EXISTS (SELECT 1 FROM fx_university_dates u WHERE u.course_id = c.course_id AND lower(trim(regexp_replace(u.event, '\\s*\\([^)]*\\)\\s*$', ''))) = lower(trim(regexp_replace(n.label, '\\s*\\([^)]*\\)\\s*$', ''))))""")  # fmt: skip
add("f7_session_guess", lambda s, d: r.guess_session(fx.courses(s, d).select("course_id", "term", F.col("duration_weeks").alias("week_count"), (F.col("course_id") % 4 + 0.5).alias("credits"))),
    """SELECT course_id, CASE WHEN term LIKE 'Summer%' THEN CASE WHEN duration_weeks <= 10 THEN '10 weeks' ELSE '12 weeks' END WHEN course_id % 4 + 0.5 < 2 OR duration_weeks = 5 THEN '1' WHEN duration_weeks = 10 THEN '1-2' ELSE '1-3' END AS session,
      CASE WHEN term LIKE 'Summer%' THEN CASE WHEN duration_weeks <= 10 THEN 10 ELSE 12 END WHEN course_id % 4 + 0.5 < 2 OR duration_weeks = 5 THEN 5 WHEN duration_weeks = 10 THEN 10 ELSE duration_weeks END::INT AS weeks FROM fx_courses""")  # fmt: skip
