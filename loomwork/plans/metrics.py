"""Queries over the usage log."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import metrics as m
from loomwork.plans.base import add
from loomwork.sources import fixtures as fx

GEN = "event_type = 'generation'"
FAILED = "event_type = 'consistency_check' AND NOT coalesce(passed, true)"
MONTHS = f"""WITH g AS (SELECT project_id, strftime(ts - INTERVAL 7 HOUR, '%Y-%m') AS month, coalesce(content_type, 'unknown') AS t, count(*) AS n, round(coalesce(sum(cost_usd), 0.0), 6) AS c FROM fx_events WHERE {GEN} GROUP BY ALL),
  m AS (SELECT project_id, month, sum(n)::BIGINT AS generations, round(sum(c), 6) AS cost_usd, '{{' || string_agg('"' || t || '":' || c::DECIMAL(18,6), ',' ORDER BY t) || '}}' AS cost_by_type FROM g GROUP BY ALL),
  s AS (SELECT project_id, strftime(unnest(generate_series((min(month) || '-01')::DATE, (max(month) || '-01')::DATE, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM m GROUP BY project_id),
  f AS (SELECT s.project_id, s.month, coalesce(generations, 0)::BIGINT AS generations, coalesce(cost_usd, 0.0) AS cost_usd, coalesce(cost_by_type, '{{}}') AS cost_by_type FROM s LEFT JOIN m USING (project_id, month))"""
ZONE = "-07:00"

add("fx_eval_events", lambda s, d: fx.eval_events(s, d).drop("ts").withColumn("passed", F.col("passed").cast("string")), "SELECT * EXCLUDE (ts) REPLACE (passed::VARCHAR AS passed) FROM fx_events")
add("p2_events_of_type", lambda s, d: m.of_type(fx.eval_events(s, d), "rollover").select("event_id", "project_id", "flag_count"), "SELECT event_id, project_id, flag_count FROM fx_events WHERE event_type = 'rollover'")
add(
    "a1_log_summary",
    lambda s, d: m.summary(fx.eval_events(s, d)),
    f"""WITH t AS (SELECT project_id, round(coalesce(sum(cost_usd) FILTER ({GEN}), 0.0), 6) AS total_cost_usd, count(*) FILTER (event_type = 'rollover') AS rollovers, count(*) FILTER (event_type = 'extraction_error') AS extraction_errors,
      count(*) FILTER ({FAILED}) AS consistency_failures, count(*) FILTER (event_type = 'consistency_check_override') AS consistency_overrides FROM fx_events GROUP BY 1),
      c AS (SELECT project_id, coalesce(content_type, 'unknown') AS t, count(*) AS n FROM fx_events WHERE {GEN} GROUP BY ALL)
    SELECT t.*, coalesce((SELECT '{{' || string_agg('"' || c.t || '":' || c.n, ',' ORDER BY c.t) || '}}' FROM c WHERE c.project_id = t.project_id), '{{}}') AS generation_counts FROM t""",
)
add("a2_monthly_costs", lambda s, d: m.monthly_costs(fx.eval_events(s, d), ZONE), f"{MONTHS} SELECT *, CASE WHEN generations > 0 THEN round(cost_usd / generations, 6) ELSE 0.0 END AS avg_cost_usd FROM f")
add(
    "a3_month_delta",
    lambda s, d: m.month_delta(fx.eval_events(s, d), "2024-04-15", ZONE),
    f"""{MONTHS}, p AS (SELECT project_id, max(cost_usd) FILTER (month = '2024-04') AS this, max(cost_usd) FILTER (month = '2024-03') AS last FROM f GROUP BY 1)
    SELECT project_id, coalesce(this, 0.0) AS this_month_usd, last AS last_month_usd, round(coalesce(this, 0.0) - last, 6) AS delta_usd FROM p""",
)
add(
    "a4_files_processed",
    lambda s, d: m.files_processed(fx.eval_events(s, d)),
    """WITH g AS (SELECT project_id, CASE WHEN pdf_method IS NOT NULL THEN 'pdf' ELSE coalesce(source_format, 'unknown') END AS format, count(*) AS good FROM fx_events WHERE event_type = 'extraction' GROUP BY ALL),
      b AS (SELECT project_id, CASE lower(regexp_extract(filename, '\\.([^.]+)$', 1)) WHEN 'docx' THEN 'word' WHEN 'md' THEN 'markdown' WHEN 'markdown' THEN 'markdown' WHEN 'pdf' THEN 'pdf' ELSE 'other' END AS format, count(*) AS bad FROM fx_events WHERE event_type = 'extraction_error' GROUP BY ALL)
    SELECT project_id, format, coalesce(good, 0) AS extracted, coalesce(bad, 0) AS errors, round(coalesce(bad, 0) / (coalesce(good, 0) + coalesce(bad, 0)), 6) AS error_rate FROM g FULL JOIN b USING (project_id, format)""",
)
add(
    "a5_consistency",
    lambda s, d: m.consistency(fx.eval_events(s, d)),
    f"""WITH c AS (SELECT project_id, count(*) FILTER (event_type = 'consistency_check') AS checks, count(*) FILTER ({FAILED}) AS caught, count(*) FILTER (event_type = 'consistency_check_override') AS overridden FROM fx_events GROUP BY 1),
      t AS (SELECT project_id, term, count(*) AS n FROM fx_events WHERE {FAILED} GROUP BY ALL), l AS (SELECT project_id, string_agg(term || ':' || n, ',' ORDER BY term || ':' || n) AS caught_terms FROM t GROUP BY 1)
    SELECT c.*, coalesce(caught_terms, '') AS caught_terms FROM c LEFT JOIN l USING (project_id)""",
)
add(
    "a6_cost_by_type",
    lambda s, d: m.cost_by_type(fx.eval_events(s, d)),
    f"""WITH g AS (SELECT * REPLACE (coalesce(content_type, 'unknown') AS content_type) FROM fx_events WHERE {GEN})
    SELECT project_id, content_type, grouping(content_type)::INT AS is_total, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(coalesce(sum(cost_usd), 0.0), 6) AS cost_usd,
      round(coalesce(sum(cost_usd), 0.0) / count(*), 6) AS avg_cost_usd, count(*) FILTER (cost_usd IS NULL) AS unpriced, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM g GROUP BY GROUPING SETS ((project_id, content_type), (project_id))""",
)
add(
    "w3_typical_output_tokens",
    lambda s, d: m.typical_output(fx.eval_events(s, d)),
    f"""SELECT project_id, content_type, floor(quantile_cont(output_tokens, 0.5))::BIGINT AS typical_tokens FROM (SELECT *, row_number() OVER (PARTITION BY project_id, content_type ORDER BY ts DESC, event_id DESC) AS nth FROM fx_events WHERE {GEN} AND output_tokens > 0) WHERE nth <= 10 GROUP BY ALL""",
)
add(
    "j10_call_cost",
    lambda s, d: m.price(fx.eval_events(s, d).withColumn("base_url", fx.pick(F.col("k") % 3, "", "http://localhost:11434/v1", "https://api.openai.com/v1")), fx.rates(s)),
    f"""SELECT event_id, project_id, e.model, provider, round(input_tokens / 1000 * input_per_1k + output_tokens / 1000 * output_per_1k, 8) AS priced_usd FROM fx_events e
    LEFT JOIN fx_rates r ON r.section = CASE WHEN k % 3 = 1 THEN 'local' ELSE provider END AND r.model = CASE WHEN provider = 'local' OR k % 3 = 1 THEN 'default' ELSE e.model END WHERE {GEN}""",
)
add(
    "s6_effective_rates",
    lambda s, d: m.effective_rates(fx.rates(s), fx.eval_events(s, d).groupBy(F.col("provider").alias("section"), "model").agg(F.round(F.avg("cost_usd"), 6).alias("input_per_1k"), F.round(F.max("cost_usd"), 6).alias("output_per_1k"))),
    "WITH p AS (SELECT provider AS section, model, round(avg(cost_usd), 6) AS input_per_1k, round(max(cost_usd), 6) AS output_per_1k FROM fx_events GROUP BY ALL) SELECT * FROM p UNION ALL SELECT * FROM fx_rates WHERE section NOT IN (SELECT section FROM p)",
)
add(
    "f13_cost_estimate",
    lambda s, d: m.cost_estimate(fx.table(s, d, "documents").select(F.col("doc_id").alias("request_id"), fx.pick(F.col("doc_id") % 3, "gpt-4o", "gpt-4o-mini", "other").alias("model"), "text"), fx.rates(s)),
    """SELECT request_id, d.model, tokens, round(tokens / 1000 * input_per_1k + 2000 / 1000 * output_per_1k, 8) AS ceiling_usd FROM (SELECT doc_id AS request_id, CASE doc_id % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' ELSE 'other' END AS model, greatest(1, length(text) // 4)::BIGINT AS tokens FROM documents) d LEFT JOIN fx_rates USING (model)""",
)
add(
    "a11_usage_tally",
    lambda s, d: m.usage_tally(fx.eval_events(s, d)),
    f"SELECT project_id, model, ts::DATE AS day, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM fx_events WHERE {GEN} GROUP BY ALL",
)
add(
    "a15_rollover_history",
    lambda s, d: m.rollover_history(fx.eval_events(s, d)),
    "SELECT project_id, (row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, event_id DESC))::INT AS nth, strftime(ts, '%Y-%m-%d %H:%M') AS at, source_term, target_term, source_weeks, target_weeks, flag_count FROM fx_events WHERE event_type = 'rollover'",
)
TYPICAL = f"SELECT project_id, content_type, floor(quantile_cont(output_tokens, 0.5))::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY project_id, content_type ORDER BY ts DESC, event_id DESC) AS nth FROM fx_events WHERE {GEN} AND output_tokens > 0) WHERE nth <= 10 GROUP BY ALL"
add("w3_expected_output", lambda s, d: m.expected_output(fx.eval_events(s, d), {"quiz": 4000, "rubric": 3001, "summary": 1500}),
    f"WITH l AS (SELECT * FROM (VALUES ('quiz', 4000), ('rubric', 3001), ('summary', 1500)) v(content_type, most)), y AS ({TYPICAL}) SELECT e.project_id, l.content_type, coalesce(n, most // 2)::BIGINT AS expected_tokens FROM (SELECT DISTINCT project_id FROM fx_events) e JOIN l ON true LEFT JOIN y ON y.project_id = e.project_id AND y.content_type = l.content_type")
add("f13_reading_estimate", lambda s, d: m.reading_estimate(fx.table(s, d, "documents").select(F.col("doc_id").alias("request_id"), fx.pick(F.col("doc_id") % 3, "gpt-4o", "flash", "other").alias("model"), "text"), fx.rates(s)),
    """SELECT doc_id AS request_id, d.model, floor(length(coalesce(text, '')) / 4 * 1.5)::BIGINT AS reply_tokens, coalesce('about $' || format('{:.4f}', 0.8 * input_per_1k + 1.2 * output_per_1k), 'cost unknown') AS page_cost
    FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'flash' ELSE 'other' END AS model FROM documents) d LEFT JOIN fx_rates USING (model)""")
add("a15_error_list", lambda s, d: m.error_list(fx.eval_events(s, d)),
    "SELECT project_id, (row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, event_id DESC))::INT AS nth, strftime(ts, '%Y-%m-%d %H:%M') AS at, filename, error_type FROM fx_events WHERE event_type = 'extraction_error'")
add("e9_evaluation_report", lambda s, d: m.report(fx.eval_events(s, d), ZONE),
    f"""{MONTHS}, mr AS (SELECT project_id, string_agg(l, chr(10) ORDER BY l) AS r FROM (SELECT project_id, month || ' | ' || generations || ' | ' || format('{{:,.4f}}', cost_usd) AS l FROM f) GROUP BY 1),
      fg AS (SELECT project_id, CASE WHEN pdf_method IS NOT NULL THEN 'pdf' ELSE coalesce(source_format, 'unknown') END AS format, count(*) AS good FROM fx_events WHERE event_type = 'extraction' GROUP BY ALL),
      fb AS (SELECT project_id, CASE lower(regexp_extract(filename, '\\.([^.]+)$', 1)) WHEN 'docx' THEN 'word' WHEN 'md' THEN 'markdown' WHEN 'markdown' THEN 'markdown' WHEN 'pdf' THEN 'pdf' ELSE 'other' END AS format, count(*) AS bad FROM fx_events WHERE event_type = 'extraction_error' GROUP BY ALL),
      fr AS (SELECT project_id, string_agg(l, chr(10) ORDER BY l) AS r FROM (SELECT project_id, format || ' | ' || coalesce(good, 0) || ' | ' || coalesce(bad, 0) || ' | ' || format('{{:,.0f}}', 100 * round(coalesce(bad, 0) / (coalesce(good, 0) + coalesce(bad, 0)), 6)) AS l FROM fg FULL JOIN fb USING (project_id, format)) GROUP BY 1),
      ct AS (SELECT project_id, coalesce(content_type, 'unknown') AS t, count(*) AS n, sum(input_tokens)::BIGINT AS i, sum(output_tokens)::BIGINT AS o, round(coalesce(sum(cost_usd), 0.0), 6) AS c FROM fx_events WHERE {GEN} GROUP BY ALL),
      cr AS (SELECT project_id, string_agg(l, chr(10) ORDER BY l) AS r FROM (SELECT project_id, t || ' | ' || n || ' | ' || i || ' | ' || o || ' | ' || format('{{:,.4f}}', c) AS l FROM ct) GROUP BY 1),
      hr AS (SELECT project_id, string_agg(strftime(ts, '%Y-%m-%d %H:%M') || ' | ' || source_term || ' | ' || target_term || ' | ' || source_weeks || ' | ' || target_weeks || ' | ' || flag_count, chr(10) ORDER BY ts DESC, event_id DESC) AS r FROM fx_events WHERE event_type = 'rollover' GROUP BY 1),
      kt AS (SELECT project_id, string_agg(l, ',' ORDER BY l) AS terms FROM (SELECT project_id, term || ':' || count(*) AS l FROM fx_events WHERE {FAILED} GROUP BY project_id, term) GROUP BY 1),
      kr AS (SELECT project_id, count(*) FILTER (event_type = 'consistency_check') || ' | ' || count(*) FILTER ({FAILED}) || ' | ' || count(*) FILTER (event_type = 'consistency_check_override') || ' | ' AS r FROM fx_events GROUP BY 1)
    SELECT project_id, '# Project ' || project_id || chr(10) || chr(10) || '## Files' || chr(10) || coalesce(fr.r, 'none') || chr(10) || chr(10) || '## Consistency' || chr(10) || kr.r || coalesce(terms, '') || chr(10) || chr(10) || '## Rollovers' || chr(10) || coalesce(hr.r, 'none')
      || chr(10) || chr(10) || '## Cost by type' || chr(10) || coalesce(cr.r, 'none') || chr(10) || chr(10) || '## Cost by month' || chr(10) || coalesce(mr.r, 'none') AS content
    FROM kr LEFT JOIN kt USING (project_id) LEFT JOIN fr USING (project_id) LEFT JOIN hr USING (project_id) LEFT JOIN cr USING (project_id) LEFT JOIN mr USING (project_id)""")  # fmt: skip


def runs(s, d):
    """Orders as grading runs, their items as calls; every seventh run failed, some of these before a call."""
    o = fx.table(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), fx.pick(F.col("o_orderkey") % 2, "quiz", "grading").alias("content_type"), (F.col("o_orderkey") % 7 == 0).alias("failed"))
    model = F.when(F.col("l_suppkey") % 40 == 0, "other").when(F.col("l_suppkey") % 2 == 0, "gpt-4o").otherwise("flash").alias("model")
    c = fx.table(s, d, "lineitem").where("l_orderkey % 3 > 0").select(F.col("l_orderkey").alias("run_id"), model, (F.col("l_partkey") % 3000).cast("long").alias("input_tokens"), F.when(F.col("l_linenumber") < 5, F.col("l_quantity").cast("long")).alias("output_tokens"))
    return o, c


add("a11_run_events", lambda s, d: m.run_events(*runs(s, d), fx.rates(s)),
    """WITH c AS (SELECT l_orderkey AS run_id, CASE WHEN l_suppkey % 40 = 0 THEN 'other' WHEN l_suppkey % 2 = 0 THEN 'gpt-4o' ELSE 'flash' END AS model, (l_partkey % 3000)::BIGINT AS i, coalesce(CASE WHEN l_linenumber < 5 THEN l_quantity::BIGINT END, 0) AS o FROM lineitem WHERE l_orderkey % 3 > 0),
      t AS (SELECT run_id, count(*) AS calls, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o, CASE WHEN count(input_per_1k) = count(*) THEN round(sum(i / 1000 * input_per_1k + o / 1000 * output_per_1k), 8) END AS cost FROM c LEFT JOIN fx_rates USING (model) GROUP BY 1)
    SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 7 = 0 THEN 'generation_failed' ELSE 'generation' END AS event_type, CASE o_orderkey % 2 WHEN 0 THEN 'quiz' ELSE 'grading' END AS content_type, coalesce(calls, 0) AS calls, coalesce(i, 0) AS input_tokens, coalesce(o, 0) AS output_tokens,
      CASE WHEN calls IS NULL THEN 0.0 ELSE cost END AS cost_usd FROM orders LEFT JOIN t ON run_id = o_orderkey WHERE calls IS NOT NULL OR o_orderkey % 7 > 0""")  # fmt: skip
