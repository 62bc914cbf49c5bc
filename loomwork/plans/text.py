"""Queries over documents, submissions, drafts and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import terms as t
from loomwork.operators import documents as doc
from loomwork.operators import drafts as dr
from loomwork.operators import grading as g
from loomwork.operators import metrics as m
from loomwork.plans.base import add
from loomwork.sources import fixtures as fx


def document_lines(s: SparkSession, d: str) -> DataFrame:
    return doc.lines(fx.table(s, d, "documents"))


def page_lines(s: SparkSession, d: str) -> DataFrame:
    """Documents as pages of 40 lines, each page with a header and a footer line."""
    body = document_lines(s, d).select("doc_id", (F.floor(F.col("line_no") / 40) + 1).cast("int").alias("page"), (F.col("line_no") % 40 + 1).alias("line_no"), "text")
    body = body.withColumn("top", 48.0 + 12.0 * F.col("line_no"))
    pages = body.select("doc_id", "page").distinct()
    head = pages.select("doc_id", "page", F.lit(0).alias("line_no"), F.concat(F.lit("Course handout "), F.col("doc_id") % 7).alias("text"), F.lit(10.0).alias("top"))
    foot = pages.select("doc_id", "page", F.lit(99).alias("line_no"), F.concat(F.lit("Page "), "page").alias("text"), F.lit(580.0).alias("top"))
    return body.unionByName(head).unionByName(foot).select("*", (F.col("top") + 10).alias("bottom"), F.lit(600.0).alias("page_height"))


LINES = "lines AS (SELECT doc_id, (unnest(generate_series(0, len(l) - 1)))::INT AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"
PAGES = f"""{LINES}, body AS (SELECT doc_id, (line_no // 40 + 1)::INT AS page, (line_no % 40 + 1)::INT AS line_no, text, 48.0::DOUBLE + 12 * (line_no % 40 + 1) AS top FROM lines),
  pg AS (SELECT DISTINCT doc_id, page FROM body),
  page_lines AS (SELECT * FROM body UNION ALL SELECT doc_id, page, 0, 'Course handout ' || (doc_id % 7), 10.0 FROM pg UNION ALL SELECT doc_id, page, 99, 'Page ' || page, 580.0 FROM pg)"""


def submissions(s: SparkSession, d: str) -> DataFrame:
    rows = fx.table(s, d, "conversations").groupBy(F.col("conv_id").alias("submission_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("a"))
    return rows.select("submission_id", (F.col("submission_id") % 20).alias("rubric_id"), F.array_join(F.transform("a", lambda x: x["text"]), "\n").alias("text"))


def quotes(s: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    a, b = F.substring(text, 11, 20), F.substring(text, 61, 20)
    made = F.array(F.substring(text, 11, 40), F.concat(a, F.lit("..."), b), F.concat(b, F.lit("..."), a), F.lit(""), F.lit("nobody wrote this"))
    return submissions(s, d).select("submission_id", F.posexplode(made).alias("quote_id", "quote"))


SUBMISSIONS = "subs AS (SELECT conv_id AS submission_id, conv_id % 20 AS rubric_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY ALL)"
NORMAL = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\\s+', ' ', 'g'))"


def replies(s: SparkSession, d: str) -> DataFrame:
    due = submissions(s, d).withColumnRenamed("text", "body").join(g.criteria(fx.rubrics(s, d)), "rubric_id")
    k = (F.col("submission_id") + F.col("pos")) % 5
    earned = F.when(F.col("submission_id") % 17 == 0, F.col("possible") + 1).otherwise(F.col("possible") * k / 4)
    name = F.when(F.col("submission_id") % 13 == 0, F.lit("other")).otherwise(F.upper("name"))
    good = F.to_json(F.struct(name.alias("name"), earned.alias("earned"), F.when(k == 1, F.concat(F.lit("So 1 / "), F.col("possible").cast("int"))).otherwise("fine").alias("reasoning"), F.when(k == 2, "Too short").alias("deduction_comment"), F.when(F.col("pos") % 2 == 0, F.array(F.substring("body", 11, 40))).when(F.col("pos") % 3 == 0, F.array(F.lit("nobody wrote this"))).otherwise(F.array().cast("array<string>")).alias("evidence")))
    text = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), good))
    first = due.select("submission_id", "pos", F.lit(1).alias("attempt"), F.when((F.col("submission_id") + F.col("pos")) % 7 == 0, F.lit("I cannot {do} this")).otherwise(text).alias("text"))
    second = due.select("submission_id", "pos", F.lit(2).alias("attempt"), text.alias("text")).where((F.col("submission_id") + F.col("pos")) % 7 == 0)
    return first.unionByName(second).where("submission_id % 11 <> 0 or pos <> 3")


CRITERIA = """crit AS (SELECT rubric_id, (row_number() OVER (PARTITION BY rubric_id ORDER BY p_partkey))::INT AS pos, p_name AS name, p_size::DOUBLE AS possible, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END AS parts FROM (SELECT *, (p_partkey // 8)::BIGINT AS rubric_id FROM part))"""
SCORES = f"""{CRITERIA}, {SUBMISSIONS}, sc AS (SELECT submission_id, s.rubric_id, pos, name AS criterion, possible,
    CASE WHEN submission_id % 11 = 0 AND pos = 3 THEN NULL WHEN submission_id % 17 = 0 THEN possible + 1 ELSE possible * ((submission_id + pos) % 5) / 4 END AS earned FROM subs s JOIN crit USING (rubric_id)),
  es AS (SELECT *, concat_ws(',', CASE WHEN earned IS NULL THEN 'no_reply' END, CASE WHEN earned IS NOT NULL AND submission_id % 13 = 0 THEN 'name_differs' END, CASE WHEN earned > possible THEN 'out_of_range' END) AS errors FROM sc)"""


def scored(s: SparkSession, d: str) -> DataFrame:
    return g.criterion_scores(replies(s, d), g.criteria(fx.rubrics(s, d)), submissions(s, d).select("submission_id", "rubric_id"))


def listing(s: SparkSession, d: str) -> DataFrame:
    """Saved files: drafts, archived versions of drafts, and other files."""
    rows = fx.table(s, d, "lineitem")
    kind = fx.pick(F.col("l_partkey") % 4, "quiz", "discussion", "rubric", "summary")
    stem = F.concat(F.lit("week-"), F.col("l_linenumber"), F.lit("-"), kind)
    path = F.when(F.col("l_quantity") > 40, F.concat(F.lit("outputs/.archive/"), stem, F.lit(".20260101.md"))).when(F.col("l_quantity") > 38, F.concat(F.lit("outputs/notes-"), F.col("l_linenumber"), F.lit(".txt"))).otherwise(F.concat(F.lit("outputs/"), stem, F.lit(".md")))
    return rows.select((F.col("l_suppkey") % 25).alias("project_id"), path.alias("path"), F.col("l_shipdate").cast("timestamp").alias("modified_at"), F.col("l_orderkey").alias("source_id"))


LISTING = """files AS (SELECT (l_suppkey % 25)::BIGINT AS project_id, CASE WHEN l_quantity > 40 THEN 'outputs/.archive/' || stem || '.20260101.md' WHEN l_quantity > 38 THEN 'outputs/notes-' || l_linenumber || '.txt' ELSE 'outputs/' || stem || '.md' END AS path, l_shipdate AS modified_at, l_orderkey AS source_id
  FROM (SELECT *, 'week-' || l_linenumber || '-' || CASE l_partkey % 4 WHEN 0 THEN 'quiz' WHEN 1 THEN 'discussion' WHEN 2 THEN 'rubric' ELSE 'summary' END AS stem FROM lineitem))"""


def status(s: SparkSession, d: str) -> DataFrame:
    """A10: a project's log figures and its files by folder."""
    kind = F.when(F.contains("path", F.lit("/.archive/")), "archived").when(F.rlike("path", F.lit(r"\.md$")), "drafts").otherwise("other")
    files = listing(s, d).withColumn("kind", kind).groupBy("project_id").pivot("kind", ["archived", "drafts", "other"]).count()
    return m.summary(fx.eval_events(s, d)).join(files, "project_id", "left").select("project_id", "total_cost_usd", "rollovers", "extraction_errors", "consistency_failures", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("archived", "drafts", "other")))


def prompt_batch(s: SparkSession, d: str) -> DataFrame:
    requests = fx.table(s, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("course_id"), fx.pick(F.col("o_orderkey") % 2, "quiz", "discussion").alias("content_type"), (F.col("o_orderkey") % 9 + 1).cast("int").alias("week_number"))
    sources = fx.table(s, d, "documents").select(F.floor(F.col("doc_id") / 3).alias("course_id"), F.col("doc_id").alias("pos"), F.concat(F.lit("d"), "doc_id").alias("name"), "text")
    templates = s.createDataFrame([("quiz", "Quiz for week {week_number}: {topics}. {unknown}\n{context}"), ("discussion", "Discuss {topics} ({assignments})\n{context}")], "content_type string, text string")
    return dr.prompts(requests, fx.weeks(s, d), sources, templates).select("request_id", "content_type", F.sha2("prompt", 256).alias("prompt_sha256"), "tokens")


add("s5_lines", lambda s, d: document_lines(s, d).groupBy("doc_id").agg(F.count("*").alias("lines"), F.max(F.length("text")).alias("longest")), f"WITH {LINES} SELECT doc_id, count(*) AS lines, max(length(text))::INT AS longest FROM lines GROUP BY 1")
add("w6_markdown_tables", lambda s, d: doc.table_rows(document_lines(s, d).withColumn("text", F.when(F.col("line_no") % 5 < 3, F.concat(F.lit("| a | "), F.col("text"), F.lit(" |"))).otherwise(F.col("text")))).select("doc_id", F.col("table_no").cast("int").alias("table_no"), "row_no", "line_no", F.array_join("cells", "~").alias("cells")),
    f"""WITH {LINES}, x AS (SELECT doc_id, line_no, CASE WHEN line_no % 5 < 3 THEN '| a | ' || text || ' |' ELSE text END AS text FROM lines), b AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM x WHERE regexp_matches(text, '^\\s*\\|.*\\|\\s*$')),
      k AS (SELECT *, (dense_rank() OVER (PARTITION BY doc_id ORDER BY island))::INT AS table_no, list_transform(string_split_regex(regexp_replace(text, '^\\s*\\||\\|\\s*$', '', 'g'), '\\|'), lambda c: trim(c, ' ')) AS cells FROM b)
    SELECT doc_id, table_no, (row_number() OVER (PARTITION BY doc_id, table_no ORDER BY line_no))::INT AS row_no, line_no, array_to_string(cells, '~') AS cells FROM k WHERE NOT list_bool_and(list_transform(cells, lambda c: regexp_full_match(c, ':?-{{3,}}:?')))""")  # fmt: skip
add("w9_first_mentions", lambda s, d: doc.first_mentions(document_lines(s, d), "[0-9]{3}"),
    f"""WITH {LINES}, h AS (SELECT doc_id, text, min(line_no) AS line_no FROM lines WHERE regexp_matches(text, '[0-9]{{3}}') GROUP BY ALL), n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no))::INT AS nth FROM h)
    SELECT doc_id, nth, line_no, substr(text, 1, 120) AS text FROM n WHERE nth <= 5""")  # fmt: skip
add("j12_class_details", lambda s, d: doc.replace_details(document_lines(s, d), fx.table(s, d, "documents").select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("the").alias("old"), F.lit("MWF 9:00").alias("new")), F.struct(F.lit(1).alias("pos"), F.lit("of").alias("old"), F.lit(" ").alias("new")))).alias("c")).select("doc_id", "c.*")),
    f"WITH {LINES} SELECT doc_id, line_no, replace(replace(text, 'the', 'MWF 9:00'), 'of', 'TBA') AS new_text FROM lines WHERE contains(text, 'the') OR contains(text, 'of')")
add("e14_line_kinds", lambda s, d: doc.line_kinds(document_lines(s, d)).groupBy("doc_id", "kind").agg(F.count("*").alias("n")),
    f"""WITH {LINES}, k AS (SELECT doc_id, CASE WHEN trim(text) = '' THEN 'blank' WHEN text LIKE '# %' THEN 'title' WHEN text LIKE '## %' THEN 'section' WHEN regexp_matches(text, '^###+ ') THEN 'subsection' WHEN regexp_matches(text, '^\\s*[-*•] ') THEN 'bullet' WHEN regexp_matches(text, '^\\s*[0-9]+[.)] ') THEN 'number'
      WHEN text LIKE '> %' THEN 'quote' WHEN regexp_matches(text, '^\\s*\\|.*\\|\\s*$') THEN 'table' ELSE 'paragraph' END AS kind FROM lines) SELECT doc_id, kind, count(*) AS n FROM k GROUP BY ALL""")  # fmt: skip
add("e15_margins", lambda s, d: doc.without_margins(page_lines(s, d)).select("doc_id", "page", "line_no", "text"),
    f"""WITH {PAGES}, e AS (SELECT *, top < 0.07 * 600 OR top + 10 > 0.93 * 600 AS edge, regexp_replace(lower(trim(text)), '[0-9]+', '#', 'g') AS mask FROM page_lines),
      o AS (SELECT doc_id, mask FROM e WHERE edge GROUP BY ALL HAVING count(DISTINCT page) >= 2)
    SELECT doc_id, page, line_no, text FROM e WHERE NOT edge OR NOT (regexp_matches(text, '^\\s*(?:[Pp]age\\s+)?[0-9]+(?:\\s*(?:/|of)\\s*[0-9]+)?\\s*$') OR EXISTS (SELECT 1 FROM o WHERE o.doc_id = e.doc_id AND o.mask = e.mask))""")  # fmt: skip
add("e15_scans", lambda s, d: doc.scans(page_lines(s, d)), f"WITH {PAGES} SELECT doc_id, sum(length(text))::BIGINT AS chars, sum(length(text)) < 200 AS is_scan FROM page_lines GROUP BY 1")
add("e19_parts", lambda s, d: doc.repack(document_lines(s, d).select("doc_id", F.col("line_no").alias("pos"), "text", (F.col("line_no") % 4 == 0).alias("is_heading")), 2000), None)
add("fx_rubrics", fx.rubrics, "SELECT * FROM fx_rubrics")
add("e5_rubric_criteria", lambda s, d: g.criteria(fx.rubrics(s, d)), f"WITH {CRITERIA} SELECT rubric_id, pos, name, possible, parts::BIGINT AS parts, true AS adds_up FROM crit")
add("f14_parsed_replies", lambda s, d: g.parsed_replies(replies(s, d)).select("submission_id", "pos", "attempt", "earned"), f"WITH {SCORES} SELECT submission_id, pos, CASE WHEN (submission_id + pos) % 7 = 0 THEN 2 ELSE 1 END::INT AS attempt, earned FROM sc WHERE earned IS NOT NULL")
add("j13_criterion_scores", lambda s, d: scored(s, d).select("submission_id", "rubric_id", "pos", "criterion", "possible", "earned", "errors"), f"WITH {SCORES} SELECT submission_id, rubric_id, pos, criterion, possible, earned, errors FROM es")
add("e22_graded_submissions", lambda s, d: g.totals(scored(s, d)),
    f"""WITH {SCORES} SELECT submission_id, rubric_id, round(coalesce(sum(earned) FILTER (errors = ''), 0.0), 6) AS earned, sum(possible) AS possible, round(100 * coalesce(sum(earned) FILTER (errors = ''), 0.0) / sum(possible), 4) AS percent, count(*) FILTER (errors <> '') AS errors,
      coalesce(string_agg(criterion, '; ' ORDER BY pos) FILTER (errors = '' AND earned >= 0.75 * possible), '') AS strengths, coalesce(string_agg(criterion, '; ' ORDER BY pos) FILTER (errors = '' AND earned < possible), '') AS improvements FROM es GROUP BY ALL""")  # fmt: skip
add("e22_feedback", lambda s, d: g.feedback(g.reviewed(scored(s, d), submissions(s, d))),
    f"""WITH {SCORES}, n AS (SELECT es.*, CASE WHEN (submission_id + pos) % 5 = 1 THEN 'So 1 / ' || possible::INT ELSE 'fine' END AS reasoning, coalesce((submission_id + pos) % 5 = 1 AND earned <> 1, false) AS contradicts,
        CASE WHEN earned IS NULL THEN 'no_quote' WHEN pos % 2 = 0 THEN CASE WHEN regexp_full_match({NORMAL.format('substr(text, 11, 40)')}, '[\\s".,;:'']*') THEN 'no_quote' END WHEN pos % 3 = 0 THEN 'not_found' ELSE 'no_quote' END AS note FROM es JOIN subs USING (submission_id)),
      a AS (SELECT submission_id, n.rubric_id, sum(earned) AS earned, sum(possible) AS possible, bool_or(errors <> '') AS bad, coalesce(string_agg(criterion, ', ' ORDER BY pos) FILTER (earned >= 0.75 * possible), '') AS good, coalesce(string_agg(criterion, ', ' ORDER BY pos) FILTER (earned < possible), '') AS weak,
        coalesce(string_agg(criterion, ', ' ORDER BY pos) FILTER (note IS NOT NULL), '') AS unsupported, count(*) FILTER (contradicts) AS contradictions, string_agg(criterion || ': ' || reasoning, chr(10) ORDER BY pos) AS lines FROM n GROUP BY ALL)
    SELECT submission_id, rubric_id, CASE WHEN NOT bad THEN earned END AS earned, possible, CASE WHEN NOT bad THEN round(100 * earned / possible, 4) END AS percent, CASE WHEN NOT bad THEN concat_ws(' ', 'Well done: ' || lower(nullif(good, '')) || '.', 'Work next on: ' || lower(nullif(weak, '')) || '.', 'The rubric has the details.') END AS comment,
      CASE WHEN NOT bad THEN concat_ws(chr(10), 'Preliminary scores; please review.', 'Check the evidence for: ' || nullif(unsupported, '') || '.', lines) END AS notes, CASE WHEN NOT bad THEN unsupported END AS unsupported, CASE WHEN NOT bad THEN contradictions END AS contradictions, CASE WHEN bad THEN 'needs_review' END AS error_code FROM a""")  # fmt: skip
add("a7_reviewed_scores", lambda s, d: g.reviewed(scored(s, d), submissions(s, d)).select("submission_id", "pos", "deduction_comment", "contradicts"),
    f"""WITH {SCORES}, n AS (SELECT *, (submission_id + pos) % 5 AS k, coalesce((submission_id + pos) % 5 = 1 AND earned <> 1, false) AS contradicts FROM es)
    SELECT submission_id, pos, contradicts, CASE WHEN earned < possible THEN CASE WHEN k = 2 THEN 'Too short' ELSE '{g.NO_REASON}' END || CASE WHEN contradicts THEN ' {g.CONTRADICTION}' ELSE '' END ELSE '' END AS deduction_comment FROM n""")  # fmt: skip
add("e21_quote_grounding", lambda s, d: g.ground(quotes(s, d), submissions(s, d)),
    f"""WITH {SUBMISSIONS}, q AS (SELECT submission_id, unnest([0, 1, 2, 3, 4])::INT AS quote_id, unnest([substr(text, 11, 40), substr(text, 11, 20) || '...' || substr(text, 61, 20), substr(text, 61, 20) || '...' || substr(text, 11, 20), '', 'nobody wrote this']) AS quote, {NORMAL.format('text')} AS body FROM subs),
      p AS (SELECT *, list_filter(list_transform(string_split({NORMAL.format('quote')}, '...'), lambda x: regexp_replace(x, '^[\\s"''.,;:]+|[\\s"''.,;:]+$', '', 'g')), lambda x: x <> '') AS ps FROM q)
    SELECT submission_id, quote_id, CASE WHEN len(ps) = 0 THEN 'no_quote' WHEN instr(body, ps[1]) > 0 AND (len(ps) = 1 OR instr(substr(body, instr(body, ps[1]) + length(ps[1])), ps[2]) > 0) THEN 'found' ELSE 'not_found' END AS note FROM p""")  # fmt: skip
add("f16_text_functions", lambda s, d: fx.table(s, d, "documents").select("doc_id", t.slug(F.col("text")).alias("slug"), F.sha2(t.escape_html(F.col("text")), 256).alias("escaped")),
    """SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-+$', '') AS slug,
      sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped FROM documents""")  # fmt: skip
add("s8_saved_drafts", lambda s, d: dr.catalogue(listing(s, d)),
    f"""WITH {LISTING}, x AS (SELECT project_id, regexp_extract(regexp_extract(path, '([^/]+)$', 1), '^(week-[0-9]+-[a-z]+)', 1) AS stem, contains(path, '/.archive/') AS old FROM files), c AS (SELECT project_id, stem, count(*) FILTER (old) AS versions FROM x WHERE stem <> '' GROUP BY ALL HAVING count(*) FILTER (NOT old) > 0)
    SELECT project_id, stem, split_part(stem, '-', 2)::INT AS week_number, split_part(stem, '-', 3) AS content_type, CASE split_part(stem, '-', 3) WHEN 'quiz' THEN 1 WHEN 'discussion' THEN 2 WHEN 'rubric' THEN 3 ELSE 4 END::INT AS type_order, versions FROM c""")  # fmt: skip
add("s7_current_versions", lambda s, d: dr.current_versions(listing(s, d).select(F.concat_ws(":", "project_id", "path").alias("key"), F.col("modified_at").alias("version_ts"), F.col("source_id").cast("string").alias("path"))).groupBy("key").agg(F.count("*").alias("versions"), F.max(F.when(F.col("is_current"), F.col("path"))).alias("current")),
    f"WITH {LISTING} SELECT project_id || ':' || path AS key, count(*) AS versions, arg_max(source_id::VARCHAR, (modified_at, source_id::VARCHAR)) AS current FROM files GROUP BY 1")
add("t3_recent_projects", lambda s, d: dr.recent_projects(listing(s, d)), f"WITH {LISTING} SELECT project_id, max(modified_at) AS last_used, count(*) AS files FROM files GROUP BY 1")
add("w14_latest_sources", lambda s, d: dr.latest_sources(listing(s, d).select("project_id", F.col("path").alias("filename"), F.col("modified_at").alias("added_at"), "source_id")),
    f"WITH {LISTING}, k AS (SELECT project_id, path AS filename, modified_at AS added_at, source_id, row_number() OVER (PARTITION BY project_id, path ORDER BY modified_at DESC, source_id DESC) AS nth FROM files) SELECT project_id, filename, added_at, source_id, count(*) OVER (PARTITION BY project_id) AS source_count FROM k WHERE nth = 1")
add("a10_project_status", status,
    f"""WITH {LISTING}, f AS (SELECT project_id, count(*) FILTER (contains(path, '/.archive/')) AS archived, count(*) FILTER (NOT contains(path, '/.archive/') AND path LIKE '%.md') AS drafts, count(*) FILTER (NOT contains(path, '/.archive/') AND path NOT LIKE '%.md') AS other FROM files GROUP BY 1),
      e AS (SELECT project_id, round(coalesce(sum(cost_usd) FILTER (event_type = 'generation'), 0.0), 6) AS total_cost_usd, count(*) FILTER (event_type = 'rollover') AS rollovers, count(*) FILTER (event_type = 'extraction_error') AS extraction_errors, count(*) FILTER (event_type = 'consistency_check' AND NOT coalesce(passed, true)) AS consistency_failures FROM fx_events GROUP BY 1)
    SELECT e.*, coalesce(archived, 0) AS archived, coalesce(drafts, 0) AS drafts, coalesce(other, 0) AS other FROM e LEFT JOIN f USING (project_id)""")  # fmt: skip
add("a12_merged_weeks", lambda s, d: dr.merged_weeks(fx.weeks(s, d)).select("course_id", "week_number", F.array_join("topics", "|").alias("topics"), F.array_join("assignments", "|").alias("assignments"), "notes"),
    "SELECT course_id, week_number, string_agg(array_to_string(topics, '|'), '|' ORDER BY row_no) AS topics, coalesce(string_agg(array_to_string(assignments, '|'), '|' ORDER BY row_no) FILTER (len(assignments) > 0), '') AS assignments, coalesce(string_agg(notes, '; ' ORDER BY row_no), '') AS notes FROM fx_weeks WHERE NOT is_break GROUP BY ALL")
add("u3_missing_variables", lambda s, d: dr.missing_variables(fx.table(s, d, "part").select(F.col("p_partkey").alias("template_id"), fx.pick(F.col("p_partkey") % 2, "quiz", "discussion").alias("content_type"), F.concat(F.lit("Use {topics} "), F.when(F.col("p_size") > 25, F.lit("{context}")).otherwise(F.lit("{other}"))).alias("text")), s.createDataFrame([("quiz", ["topics", "context"]), ("discussion", ["topics", "prompt_count"])], "content_type string, variables array<string>")),
    "SELECT p_partkey AS template_id, CASE p_partkey % 2 WHEN 0 THEN 'quiz' ELSE 'discussion' END AS content_type, CASE p_partkey % 2 WHEN 0 THEN 'context' ELSE 'prompt_count' END AS missing FROM part WHERE p_partkey % 2 = 1 OR p_size <= 25")
add("e10_prompt_batch", prompt_batch,
    """WITH a AS (SELECT doc_id // 3 AS course_id, string_agg('### d' || doc_id || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id) AS t FROM documents GROUP BY 1),
      c AS (SELECT course_id, substr(t, 1, 24000) || CASE WHEN length(t) > 24000 THEN chr(10) || '[... ' || (length(t) - 24000) || ' characters omitted]' ELSE '' END AS context FROM a),
      w AS (SELECT course_id, week_number, string_agg(array_to_string(topics, ', '), ', ' ORDER BY row_no) AS topics, coalesce(string_agg(array_to_string(assignments, ', '), ', ' ORDER BY row_no) FILTER (len(assignments) > 0), '') AS assignments FROM fx_weeks WHERE NOT is_break GROUP BY ALL),
      r AS (SELECT o_orderkey AS request_id, o_custkey AS course_id, CASE o_orderkey % 2 WHEN 0 THEN 'quiz' ELSE 'discussion' END AS content_type, (o_orderkey % 9 + 1)::INT AS week_number FROM orders),
      p AS (SELECT request_id, content_type, CASE content_type WHEN 'quiz' THEN 'Quiz for week ' || r.week_number || ': ' || coalesce(topics, '') || '. {unknown}' || chr(10) || coalesce(context, '') ELSE 'Discuss ' || coalesce(topics, '') || ' (' || coalesce(assignments, '') || ')' || chr(10) || coalesce(context, '') END AS prompt FROM r LEFT JOIN w USING (course_id, week_number) LEFT JOIN c USING (course_id))
    SELECT request_id, content_type, sha256(prompt) AS prompt_sha256, greatest(1, length(prompt) // 4)::BIGINT AS tokens FROM p""")  # fmt: skip
add("f16_emphasis", lambda s, d: fx.table(s, d, "documents").select("doc_id", F.sha2(t.plain_text(F.concat_ws("", F.lit(" **Note** on *this*: "), "text")), 256).alias("plain_sha256")),
    """SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(concat(' **Note** on *this*: ', text), '\\*\\*(.*?)\\*\\*', '\\1', 'g'), '\\*(.*?)\\*', '\\1', 'g'), '^\\s+|\\s+$', '', 'g')) AS plain_sha256 FROM documents""")
add("p11_ai_tasks", lambda s, d: fx.table(s, d, "documents").select("doc_id", t.has_ai_task(F.concat_ws("", "text", fx.pick(F.col("doc_id") % 3, "\n## AI-use task\nAsk.", "\n#### AI-use task", "\nAI-use task"))).alias("has_ai_task")),
    "SELECT doc_id, doc_id % 3 = 0 OR len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: starts_with(l, '#') AND NOT starts_with(l, '####') AND starts_with(replace(lower(ltrim(l, '# ')), '-', ' '), 'ai use task'))) > 0 AS has_ai_task FROM documents")
add("s7_archive_events", lambda s, d: dr.archive_events(listing(s, d).select(F.concat_ws(":", "project_id", "path").alias("key"), F.col("modified_at").alias("version_ts"), F.col("source_id").cast("string").alias("path"))),
    f"""WITH {LISTING}, v AS (SELECT project_id || ':' || path AS key, modified_at, source_id::VARCHAR AS path, row_number() OVER (PARTITION BY project_id, path ORDER BY modified_at DESC, source_id::VARCHAR DESC) AS nth FROM files)
    SELECT 'archive' AS event_type, key AS original_path, regexp_replace(key, '\\.[^./]+$', '') || '-' || strftime(modified_at, '%Y%m%d-%H%M%S') || regexp_extract(key, '(\\.[^./]+)$', 1) AS archived_path, path FROM v WHERE nth > 1""")  # fmt: skip


def marked_drafts(s, d):
    """Documents as drafts: every line gets a mark by its place; of every two drafts one has a title."""
    text = document_lines(s, d).select("doc_id", "line_no", F.trim(F.regexp_replace("text", r"[*|#>\x0b\x0c\t-]|^[0-9]+", "")).alias("t"))
    mark = F.element_at(F.array(*map(F.lit, ("## ", "- ", "| a | **", "|---|", "| ", "", "> ", "12. ", "### "))), (F.col("line_no") % 9 + 1).cast("int"))
    line = F.concat(mark, F.when(F.col("line_no") % 9 == 3, "").otherwise(F.col("t")), F.when(F.col("line_no") % 9 == 2, "** |").otherwise(""))
    gathered = text.select("doc_id", F.struct("line_no", line.alias("l")).alias("l")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["l"]), "\n").alias("text"))
    first = F.when(F.col("doc_id") % 2 == 0, "# Own *title*\n<!-- a banner -->\n").otherwise("## AI-use task\n")
    return gathered.select("doc_id", F.lit("Given").alias("title"), F.concat(first, "text").alias("text"))


add("e14_blocks", lambda s, d: doc.blocks(marked_drafts(s, d)).select("doc_id", "block_no", "kind", F.coalesce("content", F.array_join(F.transform("rows", lambda r: F.array_join(r, "~")), "^")).alias("content")),
    f"""WITH {LINES}, m AS (SELECT doc_id, line_no, line_no % 9 AS k, trim(regexp_replace(text, '[*|#>\\x0b\\x0c\\t-]|^[0-9]+', '', 'g'), ' ') AS t FROM lines),
      h AS (SELECT DISTINCT doc_id, unnest(CASE WHEN doc_id % 2 = 0 THEN [-3] ELSE [-3, -2, -1] END)::INT AS n FROM lines),
      b AS (SELECT doc_id, n AS line_no, CASE WHEN n = -2 THEN 'blank' WHEN n = -1 THEN 'highlighted_section' ELSE 'title' END AS kind, CASE WHEN n = -2 THEN '' WHEN n = -1 THEN 'AI-USE TASK' WHEN doc_id % 2 = 0 THEN 'Own title' ELSE 'Given' END AS content FROM h
        UNION ALL SELECT doc_id, line_no, CASE k WHEN 0 THEN CASE WHEN t = '' THEN 'paragraph' ELSE 'section' END WHEN 1 THEN CASE WHEN t = '' THEN 'paragraph' ELSE 'bullet' END WHEN 5 THEN CASE WHEN t = '' THEN 'blank' ELSE 'paragraph' END WHEN 6 THEN CASE WHEN t = '' THEN 'paragraph' ELSE 'quote' END WHEN 7 THEN CASE WHEN t = '' THEN 'paragraph' ELSE 'number' END WHEN 8 THEN CASE WHEN t = '' THEN 'paragraph' ELSE 'subsection' END ELSE 'table' END,
          CASE WHEN k = 0 THEN CASE WHEN t = '' THEN '##' ELSE upper(replace(t, 'ß', 'ss')) END WHEN t = '' THEN CASE k WHEN 1 THEN '-' WHEN 6 THEN '>' WHEN 7 THEN '12.' WHEN 8 THEN '###' ELSE '' END ELSE t END FROM m WHERE k NOT IN (2, 3, 4)),
      t AS (SELECT doc_id, min(line_no) AS line_no, 'table' AS kind, string_agg(CASE WHEN k = 2 THEN 'a~' || t ELSE t END, '^' ORDER BY line_no) AS content FROM m WHERE k IN (2, 4) GROUP BY doc_id, line_no // 9),
      e AS (SELECT * FROM b UNION ALL SELECT * FROM t)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no))::INT AS block_no, kind, content FROM e""")  # fmt: skip


def asked(s, d):
    """Orders as requests of five kinds, with details of all sorts missing or wrong."""
    k = F.col("o_orderkey")
    o = fx.table(s, d, "orders")
    kind = F.element_at(F.array(*map(F.lit, ("quiz", "discussion", "assignment", "rubric", "slides"))), (k % 5 + 1).cast("int"))
    n = (k % 7).cast("int")
    return o.select(
        k.alias("request_id"), F.col("o_custkey").alias("course_id"), kind.alias("content_type"), (k % 13 + 1).cast("int").alias("week_number"), n.alias("question_count"),
        fx.pick(k % 4, "mixed", "short answer", "essay", "mixed").alias("quiz_format"), F.when(k % 3 > 0, (k % 6).cast("int")).alias("multiple_choice"), F.when(k % 8 > 1, F.greatest(n - (k % 6).cast("int"), F.lit(0))).alias("short_answer"),
        (k % 3).cast("int").alias("prompt_count"), fx.pick(k % 3, "Essay", " ", "Lab").alias("name"), fx.pick(k % 2, "Learn", "Learn more").alias("goal"), fx.pick(k % 4, "", "text", "more", "text").alias("description"), fx.pick(k % 9, "create", "enhance", "other", "enhance", "create", "enhance", "create", "enhance", "create").alias("mode"), (k % 11).cast("int").alias("total_points"),
    )


ASKED = """a AS (SELECT o_orderkey AS k, o_custkey AS course_id, (o_orderkey % 13 + 1)::INT AS week_number, o_orderkey % 7 AS n, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 6 END AS mc, CASE WHEN o_orderkey % 8 > 1 THEN greatest(o_orderkey % 7 - o_orderkey % 6, 0) END AS sa FROM orders),
      w AS (SELECT a.*, EXISTS (SELECT 1 FROM fx_weeks f WHERE f.course_id = a.course_id AND f.week_number = a.week_number AND NOT is_break) AS taught, k % 4 IN (0, 3) AND (mc IS NOT NULL OR sa IS NOT NULL) AS split FROM a),
      e AS (SELECT *, CASE k % 5 WHEN 2 THEN CASE WHEN k % 3 = 1 THEN 'no_name_or_goal' WHEN k % 9 = 2 THEN 'unknown_mode' WHEN k % 9 IN (1, 3, 5, 7) AND k % 4 = 0 THEN 'nothing_to_enhance' END
        WHEN 3 THEN CASE WHEN k % 3 = 1 OR k % 4 = 0 THEN 'no_name_or_description' WHEN k % 11 = 0 THEN 'no_points' END
        ELSE CASE WHEN NOT taught THEN 'no_such_week' WHEN k % 5 = 0 THEN CASE WHEN n < 1 THEN 'no_questions' WHEN k % 4 = 2 THEN 'unknown_format' WHEN split AND (mc IS NULL OR sa IS NULL) THEN 'half_a_split' WHEN split AND (mc < 1 OR sa < 1) THEN 'empty_part' WHEN split AND mc + sa <> n THEN 'parts_and_count_differ' END
          WHEN k % 5 = 1 AND k % 3 = 0 THEN 'no_prompts' END END AS error_code FROM w)"""
add("e10_checked_requests", lambda s, d: dr.checked_requests(asked(s, d), fx.weeks(s, d)),
    f"""WITH {ASKED} SELECT k AS request_id, error_code, CASE WHEN k % 5 = 0 AND error_code IS NULL THEN CASE WHEN split THEN 'mixed (exactly ' || mc || ' multiple choice and ' || sa || ' short answer)' WHEN k % 4 IN (0, 3) THEN 'mixed' ELSE 'short answer' END END AS format FROM e""")
add("e10_unplaced_guidance", lambda s, d: dr.with_guidance(
        fx.table(s, d, "documents").select(F.col("doc_id").alias("request_id"), fx.pick(F.col("doc_id") % 2, "quiz", "assignment").alias("content_type"), F.concat_ws("", "text", F.lit(" \n")).alias("prompt")),
        s.createDataFrame([("quiz", "{topics} {level}"), ("assignment", "{topics}")], "content_type string, text string"),
        fx.table(s, d, "documents").select(F.col("doc_id").alias("request_id"), F.explode(F.array(F.struct(F.lit(1).alias("pos"), F.lit("ai").alias("variable"), F.when(F.col("doc_id") % 3 == 0, "Use AI.").otherwise(" ").alias("text")), F.struct(F.lit(0).alias("pos"), F.lit("level").alias("variable"), F.lit("For beginners.").alias("text")))).alias("g")).select("request_id", "g.*"),
    ).select("request_id", "content_type", F.sha2("prompt", 256).alias("prompt_sha256")),
    """WITH d AS (SELECT doc_id, concat(text, ' ' || chr(10)) AS p, concat_ws(chr(10) || chr(10), CASE WHEN doc_id % 2 = 1 THEN 'For beginners.' END, CASE WHEN doc_id % 3 = 0 THEN 'Use AI.' END) AS more FROM documents)
    SELECT doc_id AS request_id, CASE doc_id % 2 WHEN 0 THEN 'quiz' ELSE 'assignment' END AS content_type, sha256(CASE WHEN more = '' THEN p ELSE rtrim(rtrim(p, chr(10)), ' ') || chr(10) || chr(10) || more || chr(10) END) AS prompt_sha256 FROM d""")  # fmt: skip
