"""Streaming queries, drained over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomwork.plans.base import add
from loomwork.sources import fixtures as fx
from loomwork.sources.files import shared_folder
from loomwork.streaming import log


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = fx.table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return fx.as_log(raw)


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    spark = stream.sparkSession
    name = f"drain_{uuid.uuid4().hex}"
    return log.drain(stream, f"{shared_folder(spark)}/{name}", name, mode)


def typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 with the state store that timers and lists need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return drained(log.typical_replies(events(spark, sf_dir)), "update")
    finally:
        spark.conf.set(key, before)


add("r1_monthly_stream", lambda s, d: drained(log.monthly(events(s, d), "-07:00")),
    "SELECT project_id, strftime(ts - INTERVAL 7 HOUR, '%Y-%m') AS month, coalesce(content_type, 'unknown') AS content_type, count(*) AS generations, round(coalesce(sum(cost_usd), 0.0), 6) AS cost_usd FROM fx_events WHERE event_type = 'generation' GROUP BY ALL")
add("r2_counters_stream", lambda s, d: drained(log.counters(events(s, d))),
    """SELECT project_id, count(*) FILTER (event_type = 'generation') AS generations, count(*) FILTER (event_type = 'rollover') AS rollovers, count(*) FILTER (event_type = 'extraction_error') AS extraction_errors,
      count(*) FILTER (event_type = 'consistency_check' AND NOT coalesce(passed, true)) AS consistency_failures, round(coalesce(sum(cost_usd) FILTER (event_type = 'generation'), 0.0), 6) AS total_cost_usd FROM fx_events GROUP BY 1""")  # fmt: skip
add("r3_typical_reply_stream", typical,
    """SELECT project_id, content_type, count(*)::INT AS seen, floor(quantile_cont(output_tokens, 0.5))::BIGINT AS typical_tokens FROM (SELECT *, row_number() OVER (PARTITION BY project_id, content_type ORDER BY ts DESC, event_id DESC) AS nth
      FROM (SELECT * REPLACE (coalesce(content_type, 'unknown') AS content_type) FROM fx_events WHERE event_type = 'generation' AND output_tokens > 0)) WHERE nth <= 10 GROUP BY ALL""")  # fmt: skip
