"""Usage-log metrics on small inline logs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomwork.operators import metrics as m

SCHEMA = "event_id long, project_id long, event_type string, ts timestamp, content_type string, model string, provider string, input_tokens int, output_tokens int, cost_usd double, filename string, source_format string, pdf_method string, passed boolean, term string"


def log(spark, *rows):
    base = dict.fromkeys([c.split()[0] for c in SCHEMA.split(", ")])
    return spark.createDataFrame([tuple((base | {"event_id": i, "project_id": 1} | r).values()) for i, r in enumerate(rows)], SCHEMA)


def gen(day, cost=None, kind="quiz", **more):
    return {"event_type": "generation", "ts": dt.datetime.fromisoformat(day), "cost_usd": cost, "content_type": kind, "model": "m", "provider": "openai", "input_tokens": 1000, "output_tokens": 500} | more


def test_months_in_a_local_zone_with_quiet_ones(spark):
    events = log(spark, gen("2026-11-01T02:00:00", 0.5), gen("2027-02-10T12:00:00", 1.0), gen("2026-11-20T12:00:00", None, None))
    got = {r.month: r for r in m.monthly_costs(events, "-05:00").collect()}
    assert sorted(got) == ["2026-10", "2026-11", "2026-12", "2027-01", "2027-02"]
    assert got["2026-10"].cost_usd == 0.5 and got["2026-12"].generations == 0 and got["2026-12"].avg_cost_usd == 0.0
    assert got["2026-11"].cost_by_type == '{"unknown":0.000000}'


def test_typical_output(spark):
    events = log(spark, *(gen(f"2026-09-0{i + 1}", output_tokens=n) for i, n in enumerate((400, 900, 500, 0))))
    assert m.typical_output(events).first().typical_tokens == 500
    assert m.typical_output(events, last=2).first().typical_tokens == 700


def test_unknown_rate_is_null(spark):
    rates = spark.createDataFrame([("openai", "m", 0.001, 0.002), ("local", "default", 0.0, 0.0)], "section string, model string, input_per_1k double, output_per_1k double")
    events = log(spark, gen("2026-09-01"), gen("2026-09-01", model="other"), gen("2026-09-01", model="other", provider="local"))
    got = {r.event_id: r.priced_usd for r in m.price(events, rates).collect()}
    assert got == {0: pytest.approx(0.002), 1: None, 2: 0.0}


def test_summary_and_files(spark):
    events = log(
        spark, gen("2026-09-01", 0.25), gen("2026-09-02", None), {"event_type": "consistency_check", "passed": False, "term": "Fall"}, {"event_type": "consistency_check"},
        {"event_type": "extraction", "source_format": "word", "pdf_method": "local"}, {"event_type": "extraction_error", "filename": "a.PDF"}, {"event_type": "extraction_error", "filename": "noend"}, {"event_type": "rollover"},
    )
    s = m.summary(events).first()
    assert (s.total_cost_usd, s.rollovers, s.extraction_errors, s.consistency_failures, s.generation_counts) == (0.25, 1, 2, 1, '{"quiz":2}')
    assert {(r.format, r.extracted, r.errors, r.error_rate) for r in m.files_processed(events).collect()} == {("pdf", 1, 1, 0.5), ("other", 0, 1, 1.0)}
    total = m.cost_by_type(events).where("is_total = 1").first()
    assert total.calls == 2 and total.unpriced == 1
    assert m.consistency(events).first().caught_terms == "Fall:1"
    assert m.report(events).first().content.startswith("# Project 1")


def test_project_rates_replace_whole_sections(spark):
    schema = "section string, model string, input_per_1k double, output_per_1k double"
    bundled = spark.createDataFrame([("a", "x", 1.0, 1.0), ("a", "y", 1.0, 1.0), ("b", "z", 1.0, 1.0)], schema)
    own = spark.createDataFrame([("a", "x", 2.0, 2.0)], schema)
    assert {(r.section, r.model) for r in m.effective_rates(bundled, own).collect()} == {("a", "x"), ("b", "z")}


def test_empty_log(spark):
    none = log(spark).where(F.lit(False))
    assert [f(none).count() for f in (m.summary, m.monthly_costs, m.files_processed, m.cost_by_type, m.typical_output)] == [0] * 5
