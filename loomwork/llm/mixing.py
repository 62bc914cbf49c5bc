"""Mixing sources to target weights by iterative proportional fitting. Built-in functions only.

Tokens are summed in cells of (source, lang, topic); cell weights are raked until their sums meet the target
marginals of all three; a document's expected number of copies is its cell's calibrated ratio, scaled to a wanted
share of all tokens (or, if none is given, so that the largest is 1). Every decision then depends on the document alone, through a hash, so it is the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm.common import checkpoint, read, stored

DIMENSIONS = ("source", "lang", "topic")
FLATTEN = 0.7  # target share of a category: its own share to this power, summed to 1
SHARE = 0.9  # tokens wanted, as a share of all, copies included
SWEEPS = 42  # at most; what is left then is told as _mix_miss
AT_ONCE = 3  # sweeps a job
CLOSE = 1e-6  # largest relative miss of a marginal at which raking ends
SMALL = 20_000  # cells that may be broadcast
SALTS = 64


def topic_of(text: Column) -> Column:
    """A coarse topic by form: tables, shouting, records with addresses or long numbers, else prose by length."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("!!")), "shouting")
        .when(F.contains(text, F.lit("@")) | F.rlike(text, F.lit("[0-9]{6}")), "record")
        .when(F.length(text) < 1000, "short prose")
        .otherwise("long prose")
    )


def tokens_of(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def with_parts(docs: DataFrame, topic: Column | None) -> DataFrame:
    """``docs`` with the columns this job works on, under names that no other column has."""
    return docs.select(
        "*",
        *(F.col(d).cast("string").alias(f"_mix_{d}") for d in ("source", "lang")),
        (topic_of(F.col("text")) if topic is None else topic).cast("string").alias("_mix_topic"),
        tokens_of(F.col("text")).alias("_mix_tokens"),
    )


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, flatten: float = FLATTEN, sweeps: int = SWEEPS) -> DataFrame:
    """Cells with ``weight``: tokens raked to the target marginals.

    ``cells(_mix_source, _mix_lang, _mix_topic, tokens)``. ``targets``: by dimension a table (value, share); where there is
    none, each category's own share to the power ``flatten``. Shares are scaled to sum to 1 over the categories that
    have tokens; a category without a target keeps its own share. A null category is one of its own. ``miss`` is the largest
    relative miss of a marginal that is left: under CLOSE, or more if ``sweeps`` don't suffice or the targets contradict
    each other (cells without tokens stay empty).
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    state = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        name = f"_mix_{d}"
        own = cells.groupBy(name).agg((F.sum("tokens") / F.lit(float(max(total, 1)))).alias("own"))
        if targets and d in targets:
            given = targets[d].select(F.col("value").cast("string").alias("value"), F.col("share").cast("double").alias("share"))
            own = own.join(given, F.col(name).eqNullSafe(F.col("value")), "left").select(name, F.coalesce("share", "own").alias("raw"))
        else:
            own = own.select(name, F.pow("own", F.lit(flatten)).alias("raw"))
        own = stored(own)  # a row a category
        scale = own.agg(F.sum("raw")).first()[0] or 1.0
        share = own.select(F.col(name).alias("value"), (F.col("raw") / scale * total).alias(f"goal_{d}"))
        state = state.join(share, F.col(name).eqNullSafe(F.col("value"))).drop("value")
    state = checkpoint(state)
    miss = 0.0
    for done in range(0, sweeps, AT_ONCE):
        for d in DIMENSIONS * min(AT_ONCE, sweeps - done):
            at = F.sum("weight").over(Window.partitionBy(f"_mix_{d}"))
            state = state.withColumn("weight", F.when(at > 0, F.col("weight") * F.col(f"goal_{d}") / at).otherwise(F.lit(0.0)))
        state = checkpoint(state)
        misses = [F.abs(F.sum("weight").over(Window.partitionBy(f"_mix_{d}")) / F.nullif(F.col(f"goal_{d}"), F.lit(0.0)) - 1) for d in DIMENSIONS[:-1]]  # the last was met just now
        miss = state.select(F.greatest(*misses).alias("miss")).agg(F.max("miss")).first()[0] or 0.0
        if miss < CLOSE:
            break
    return state.drop(*(f"goal_{d}" for d in DIMENSIONS)).withColumn("miss", F.lit(float(miss)))


def weighed(docs: DataFrame, topic: Column | None = None, targets: dict[str, DataFrame] | None = None, seed: int = 0, flatten: float = FLATTEN, share: float | None = None) -> DataFrame:
    """``docs`` with ``_mix_*`` columns: the parts, weight (raked over own tokens), probability, copies, selected and miss.

    ``share``: the tokens to expect, copies included, as a share of all; a rare cell's documents then get copies instead of
    all others being thinned out to it.
    """
    parts = with_parts(docs, topic)
    keys = [f"_mix_{d}" for d in DIMENSIONS]
    cells = stored(parts.groupBy(*keys).agg(F.sum("_mix_tokens").alias("tokens")))
    ratios = rake(cells, targets, flatten).withColumn("_mix_weight", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(0.0)))
    most, n = ratios.agg(F.max("_mix_weight"), F.count("*")).first()
    rate = F.col("_mix_weight") / F.lit(most or 1.0) if share is None else F.col("_mix_weight") * F.lit(float(share))  # weighted tokens sum to all tokens
    ratios = ratios.select(*(F.col(k).alias(f"cell{k}") for k in keys), "_mix_weight", rate.alias("_mix_rate"), F.col("miss").alias("_mix_miss"))
    same = [F.col(k).eqNullSafe(F.col(f"cell{k}")) for k in keys]
    if n <= SMALL:
        out = parts.join(F.broadcast(ratios), same, "left")
    else:  # a cell may hold a third of the rows
        salt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int")
        spread = ratios.withColumn("cell_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = parts.withColumn("_mix_salt", salt).join(spread, [*same, F.col("_mix_salt") == F.col("cell_salt")], "left").drop("_mix_salt", "cell_salt")
    even = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rate = F.coalesce("_mix_rate", F.lit(0.0))
    copies = F.floor(rate) + (even < rate - F.floor(rate)).cast("long")
    out = out.withColumns({"_mix_probability": F.least(F.lit(1.0), F.col("_mix_rate")), "_mix_copies": copies})
    return out.drop("_mix_rate", *(f"cell{k}" for k in keys)).withColumn("_mix_selected", F.col("_mix_copies") > 0)


def mix(docs: DataFrame, **options) -> DataFrame:
    """Weight, chance and decision of every row of ``docs(doc_id, text, source, lang, ...)``.

    Returns doc_id, source, lang, topic, n_tokens, weight, probability, selected, copies, miss (of the raking). Options are those of ``weighed``. A
    null or empty text has no tokens and takes its cell's chance (none in a cell without tokens); null sources and
    languages are categories of their own; rows that repeat share one fate; ties can't occur; other columns are
    ignored; an empty table gives no rows.
    """
    return weighed(docs.select("doc_id", "text", "source", "lang"), **options).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(F.col(f"_mix_{d}").alias(d) for d in DIMENSIONS),
        F.col("_mix_tokens").alias("n_tokens"),
        F.round("_mix_weight", 9).alias("weight"),
        F.round("_mix_probability", 9).alias("probability"),
        F.col("_mix_selected").alias("selected"),
        F.col("_mix_copies").alias("copies"),
        F.round("_mix_miss", 9).alias("miss"),
    )


def drawn(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, as often as they have copies, with their own columns only."""
    rows = weighed(docs, **options).where("_mix_selected")
    return rows.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies")))).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), share=SHARE)
