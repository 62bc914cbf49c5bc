"""A task's share of a job stays the same while tables grow: rows are dealt out before they grow to many."""

import pytest
from pyspark.sql import functions as F

from loomwork.operators import flags as f
from loomwork.plans.base import QUERIES
from loomwork.plans import registry  # noqa: F401  registers the queries
from loomwork.sources import fixtures as fx
from loomwork.sources.files import DEALT


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A table of courses in one file, large enough for several shares."""
    folder = str(tmp_path_factory.mktemp("many"))
    spark.range(5 * DEALT).coalesce(1).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), (F.col("id") % 25).cast("int").alias("c_nationkey")).write.parquet(f"{folder}/customer.parquet")
    return folder


def test_schedules_are_made_in_shares(spark, many):
    for view in (fx.weeks, fx.university_dates):
        shares = view(spark, many).groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("course_id").alias("n")).collect()
        assert sum(x.n for x in shares) == 5 * DEALT and len(shares) == 5 and max(x.n for x in shares) < 1.2 * DEALT


@pytest.mark.parametrize("name", ["a9_week_count", "t1_schedule_end"])
def test_schedules_are_counted_where_they_are_made(spark, many, name):
    assert "ENSURE_REQUIREMENTS" not in plan_of(QUERIES[name](spark, many))


@pytest.mark.parametrize("name", ["e6_rolled_dates", "e6_rolled_syllabi", "e6_untouched_lines", "e1_schedule", "e4_university_dates"])
def test_syllabi_are_read_where_they_are_made(spark, many, name):
    plan = plan_of(QUERIES[name](spark, many))
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_points_come_to_the_evaluations(spark):
    rows = [(s, pos, part, met, evidence) for s in range(50) for pos in range(2) for part, met, evidence in ((0, True, ["q"]), (1, True, []), (2, None, ["q"]))]
    given = spark.createDataFrame(rows, "submission_id long, pos int, part int, met boolean, evidence array<string>")
    parts = spark.createDataFrame([(p, q, p + q + 1.0) for p in range(2) for q in range(3)], "pos int, part int, points double")
    out = f.evidence_scores(given, parts)
    # few kinds of parts: joined by these, all evaluations would meet in a few tasks
    assert "SortMergeJoin" not in plan_of(out)
    assert {(x.pos, x.earned, x.met_without_evidence) for x in out.collect()} == {(0, 1.0, 1), (1, 2.0, 1)} and out.count() == 100
