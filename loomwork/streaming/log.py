"""The usage log as a stream: the same figures as the batch jobs, kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomwork.operators import metrics as m

LAST = 10


def monthly(events: DataFrame, zone: str = "UTC") -> DataFrame:
    """Running cost by project, local month and type. Few keys and late events count, so nothing is evicted."""
    gen = m.of_type(events, "generation").where("ts is not null")
    return gen.groupBy("project_id", m.local_month(zone).alias("month"), F.coalesce("content_type", F.lit("unknown")).alias("content_type")).agg(F.count("*").alias("generations"), m.money().alias("cost_usd"))


def daily(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """R1 with bounded state: daily sums in append mode; events behind the watermark are dropped."""
    gen = m.of_type(events, "generation").withWatermark("ts", delay)
    return gen.groupBy("project_id", F.window("ts", "1 day")).agg(F.count("*").alias("generations"), m.money().alias("cost_usd")).select("project_id", F.col("window.start").alias("day"), "generations", "cost_usd")


def counters(events: DataFrame) -> DataFrame:
    """R2: running totals of each project."""
    return events.groupBy("project_id").agg(
        F.count_if(m.is_type("generation")).alias("generations"), F.count_if(m.is_type("rollover")).alias("rollovers"), F.count_if(m.is_type("extraction_error")).alias("extraction_errors"),
        F.count_if(m.failed_check()).alias("consistency_failures"), F.round(F.coalesce(F.sum(F.when(m.is_type("generation"), F.col("cost_usd"))), F.lit(0.0)), 6).alias("total_cost_usd"),
    )


class LastReplies(StatefulProcessor):
    """The newest replies of a (project, type), at most LAST of them, and their median."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", T.StructType([T.StructField("ts", T.ArrayType(T.LongType())), T.StructField("event_id", T.ArrayType(T.LongType())), T.StructField("tokens", T.ArrayType(T.LongType()))]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        old = self.newest.get() if self.newest.exists() else ([], [], [])
        every = list(zip(*(list(x) for x in old)))
        for pdf in rows:
            every = sorted([*every, *zip(pdf.us.tolist(), pdf.event_id.tolist(), pdf.output_tokens.tolist())])[-LAST:]
        self.newest.update(tuple(list(x) for x in zip(*every)))
        yield pd.DataFrame({"project_id": [key[0]], "content_type": [key[1]], "seen": [len(every)], "typical_tokens": [int(pd.Series([x[2] for x in every]).median())]})

    def close(self) -> None:
        pass


def typical_replies(events: DataFrame) -> DataFrame:
    """As ``metrics.typical_output``, kept up to date; update mode."""
    replies = m.of_type(events, "generation").where("output_tokens > 0").select("project_id", F.coalesce("content_type", F.lit("unknown")).alias("content_type"), F.unix_micros("ts").alias("us"), "event_id", F.col("output_tokens").cast("long").alias("output_tokens"))
    return replies.groupBy("project_id", "content_type").transformWithStateInPandas(LastReplies(), "project_id long, content_type string, seen int, typical_tokens long", "Update", "None")


def drain(stream: DataFrame, folder: str, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there; its latest rows as a table. For results of few keys."""
    spark: SparkSession = stream.sparkSession
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
