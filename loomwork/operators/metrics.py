"""Usage-log metrics: costs, counts and quality figures over many projects at once.

Log rows are never gathered: every figure is a partial aggregate by a small key. Unknown costs stay null in rows and
count as nothing in sums; a missing content type counts as ``unknown`` and a missing ``passed`` as true.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.sources.files import small

FORMATS = {"docx": "word", "md": "markdown", "markdown": "markdown", "pdf": "pdf"}


def of_type(events: DataFrame, kind: str) -> DataFrame:
    """Events of one type."""
    return events.where(F.col("event_type") == kind)


def is_type(kind: str) -> Column:
    return F.col("event_type") == kind


def failed_check() -> Column:
    return is_type("consistency_check") & ~F.coalesce("passed", F.lit(True))


def money(cost: str = "cost_usd") -> Column:
    return F.round(F.coalesce(F.sum(cost), F.lit(0.0)), 6)


def summary(events: DataFrame) -> DataFrame:
    """A1: totals of each project's log."""
    totals = events.groupBy("project_id").agg(
        F.round(F.coalesce(F.sum(F.when(is_type("generation"), F.col("cost_usd"))), F.lit(0.0)), 6).alias("total_cost_usd"),
        F.count_if(is_type("rollover")).alias("rollovers"),
        F.count_if(is_type("extraction_error")).alias("extraction_errors"),
        F.count_if(failed_check()).alias("consistency_failures"),
        F.count_if(is_type("consistency_check_override")).alias("consistency_overrides"),
    )
    types = of_type(events, "generation").groupBy("project_id", F.coalesce("content_type", F.lit("unknown")).alias("t")).agg(F.count("*").alias("n"))
    maps = types.groupBy("project_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n"))))).alias("generation_counts"))
    return totals.join(maps, "project_id", "left").withColumn("generation_counts", F.coalesce("generation_counts", F.lit("{}")))


def local_month(zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp("ts", zone), "yyyy-MM")


def monthly_costs(events: DataFrame, zone: str = "UTC") -> DataFrame:
    """A2: generation cost per project and calendar month in ``zone``; quiet months between are there with 0."""
    gen = of_type(events, "generation").where("ts is not null").withColumn("month", local_month(zone))
    by_type = gen.groupBy("project_id", "month", F.coalesce("content_type", F.lit("unknown")).alias("t")).agg(F.count("*").alias("n"), money().alias("c"))
    month = by_type.groupBy("project_id", "month").agg(
        F.sum("n").alias("generations"), F.round(F.sum("c"), 6).alias("cost_usd"), F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), "t", F.lit('":'), F.col("c").cast("decimal(18,6)").cast("string")))), ","), F.lit("}")).alias("cost_by_type")
    )
    first = lambda m: F.to_date(F.concat(m, F.lit("-01")))
    ends = month.groupBy("project_id").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    spine = ends.select("project_id", F.explode(F.sequence(first(F.col("lo")), first(F.col("hi")), F.expr("interval 1 month"))).alias("d")).select("project_id", F.date_format("d", "yyyy-MM").alias("month"))
    full = spine.join(month, ["project_id", "month"], "left")
    n, cost = F.coalesce("generations", F.lit(0)), F.coalesce("cost_usd", F.lit(0.0))
    return full.select(
        "project_id", "month", n.cast("long").alias("generations"), cost.alias("cost_usd"),
        F.coalesce("cost_by_type", F.lit("{}")).alias("cost_by_type"), F.when(n > 0, F.round(cost / n, 6)).otherwise(0.0).alias("avg_cost_usd"),
    )


def month_delta(events: DataFrame, as_of: str, zone: str = "UTC") -> DataFrame:
    """A3: this month's cost against last month's; null where the log has no row for last month."""
    months = monthly_costs(events, zone)
    now = F.date_format(F.to_date(F.lit(as_of)), "yyyy-MM")
    before = F.date_format(F.add_months(F.to_date(F.lit(as_of)), -1), "yyyy-MM")
    picked = months.groupBy("project_id").agg(F.max(F.when(F.col("month") == now, F.col("cost_usd"))).alias("this"), F.max(F.when(F.col("month") == before, F.col("cost_usd"))).alias("last"))
    this = F.coalesce("this", F.lit(0.0))
    return picked.select("project_id", this.alias("this_month_usd"), F.col("last").alias("last_month_usd"), F.round(this - F.col("last"), 6).alias("delta_usd"))


def format_of_file(name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    out = F.lit("other")
    for ending, kind in FORMATS.items():
        out = F.when(suffix == ending, kind).otherwise(out)
    return out


def files_processed(events: DataFrame) -> DataFrame:
    """A4: extracted and failed files per format, full outer; a PDF that was converted counts as pdf."""
    kind = F.when(F.col("pdf_method").isNotNull(), "pdf").otherwise(F.coalesce("source_format", F.lit("unknown")))
    good = of_type(events, "extraction").groupBy("project_id", kind.alias("format")).agg(F.count("*").alias("good"))
    bad = of_type(events, "extraction_error").groupBy("project_id", format_of_file(F.col("filename")).alias("format")).agg(F.count("*").alias("bad"))
    g, b = F.coalesce("good", F.lit(0)), F.coalesce("bad", F.lit(0))
    return good.join(bad, ["project_id", "format"], "full_outer").select("project_id", "format", g.alias("extracted"), b.alias("errors"), F.round(b / (g + b), 6).alias("error_rate"))


def consistency(events: DataFrame) -> DataFrame:
    """A5: checks run, caught and overridden; the terms that were caught, by number of times."""
    checks = events.groupBy("project_id").agg(F.count_if(is_type("consistency_check")).alias("checks"), F.count_if(failed_check()).alias("caught"), F.count_if(is_type("consistency_check_override")).alias("overridden"))
    caught = events.where(failed_check()).groupBy("project_id", "term").agg(F.count("*").alias("n"))
    listed = caught.groupBy("project_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", "term", "n"))).alias("t"))
    return checks.join(listed, "project_id", "left").select("project_id", "checks", "caught", "overridden", F.coalesce(F.array_join("t", ","), F.lit("")).alias("caught_terms"))


def cost_by_type(events: DataFrame) -> DataFrame:
    """Calls, tokens and cost by content type, with a total row per project (content_type null, is_total 1)."""
    gen = of_type(events, "generation").withColumn("content_type", F.coalesce("content_type", F.lit("unknown")))
    return gen.rollup("project_id", "content_type").agg(
        F.grouping_id().alias("level"), F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        money().alias("cost_usd"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)) / F.count("*"), 6).alias("avg_cost_usd"),
        F.count_if(F.col("cost_usd").isNull()).alias("unpriced"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
    ).where("level < 3").select("project_id", "content_type", F.col("level").cast("int").alias("is_total"), "calls", "input_tokens", "output_tokens", "cost_usd", "avg_cost_usd", "unpriced", "models")


def typical_output(events: DataFrame, last: int = 10) -> DataFrame:
    """Median of the last ``last`` non-zero replies by project and type, as a whole number. The rank limit is the feature."""
    replies = of_type(events, "generation").where("output_tokens > 0")
    order = Window.partitionBy("project_id", "content_type").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    recent = replies.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= last)
    return recent.groupBy("project_id", "content_type").agg(F.floor(F.percentile("output_tokens", F.lit(0.5))).cast("long").alias("typical_tokens"))


def rate_section(provider: Column, address: Column) -> Column:
    """The section of the rates: a provider's own, or ``local`` where its address is another than the public one."""
    elsewhere = (F.coalesce(address, F.lit("")) != "") & ~F.contains(address, F.lit("api.openai.com"))
    name = F.lower(F.coalesce(provider, F.lit("")))
    return F.when(name.isin("anthropic", "gemini", "local"), name).when(elsewhere, "local").otherwise("openai")


def price(events: DataFrame, rates: DataFrame) -> DataFrame:
    """Cost of each generation from its rate; local calls take the local default; no rate means null, not 0.

    ``events`` may have a ``base_url``, the provider's address.
    """
    address = F.col("base_url") if "base_url" in events.columns else F.lit("")
    gen = of_type(events, "generation").withColumn("section", rate_section(F.col("provider"), address))
    gen = gen.withColumn("rate_model", F.when(F.col("section") == "local", "default").otherwise(F.col("model")))
    r = small(rates.select(F.col("section"), F.col("model").alias("rate_model"), "input_per_1k", "output_per_1k"))  # a configuration file
    cost = F.col("input_tokens") / 1000 * F.col("input_per_1k") + F.col("output_tokens") / 1000 * F.col("output_per_1k")
    return gen.join(r, ["section", "rate_model"], "left").select("event_id", "project_id", "model", "provider", F.round(cost, 8).alias("priced_usd"))


def effective_rates(bundled: DataFrame, project: DataFrame) -> DataFrame:
    """The project's sections replace the bundled ones section by section."""
    return project.unionByName(bundled.join(small(project.select("section").distinct()), "section", "left_anti").select(*project.columns))


def cost_estimate(requests: DataFrame, rates: DataFrame, most_output: int = 2000) -> DataFrame:
    """estimated prompt tokens (a quarter of the characters, at least 1) and the most that a call can cost."""
    tokens = F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long")
    known = small(rates.select("model", "input_per_1k", "output_per_1k"))
    priced = requests.withColumn("tokens", tokens).join(known, "model", "left")
    ceiling = F.round(F.col("tokens") / 1000 * F.col("input_per_1k") + F.lit(most_output) / 1000 * F.col("output_per_1k"), 8)
    return priced.select("request_id", "model", "tokens", ceiling.alias("ceiling_usd"))


def rollover_history(events: DataFrame) -> DataFrame:
    """Rollovers of each project, newest first."""
    order = Window.partitionBy("project_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return of_type(events, "rollover").select("project_id", F.row_number().over(order).alias("nth"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), "source_term", "target_term", "source_weeks", "target_weeks", "flag_count")


def expected_output(events: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The typical reply of each project and content type of ``limits`` (a configuration), else half its token limit."""
    types = F.explode(F.array(*(F.struct(F.lit(k).alias("content_type"), F.lit(v).alias("most")) for k, v in limits.items())))
    asked = events.select("project_id").distinct().select("project_id", types.alias("t")).select("project_id", "t.*")
    typical = typical_output(events.where("content_type is not null"))
    return asked.join(typical, ["project_id", "content_type"], "left").select("project_id", "content_type", F.coalesce("typical_tokens", F.floor(F.col("most") / 2)).cast("long").alias("expected_tokens"))


#: Tokens in and out of reading one page.
PAGE_INPUT, PAGE_OUTPUT = 800, 1200


def cost_text(cost: Column, prefix: str = "") -> Column:
    """a cost in dollars to four places, or that it isn't known."""
    return F.coalesce(F.concat(F.lit(f"{prefix}$"), F.format_number(cost, 4)), F.lit("cost unknown"))


def reading_estimate(texts: DataFrame, rates: DataFrame) -> DataFrame:
    """the expected length of a structured reply to a text, and the cost of reading a page; ``texts(request_id, model, text)``."""
    known = small(rates.select("model", "input_per_1k", "output_per_1k"))
    tokens = F.floor(F.length(F.coalesce("text", F.lit(""))) / 4 * PAGE_OUTPUT / PAGE_INPUT).cast("long")
    page = F.lit(PAGE_INPUT) / 1000 * F.col("input_per_1k") + F.lit(PAGE_OUTPUT) / 1000 * F.col("output_per_1k")
    return texts.join(known, "model", "left").select("request_id", "model", tokens.alias("reply_tokens"), cost_text(page, "about ").alias("page_cost"))


def error_list(events: DataFrame) -> DataFrame:
    """Extraction errors of each project, newest first."""
    order = Window.partitionBy("project_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return of_type(events, "extraction_error").select("project_id", F.row_number().over(order).alias("nth"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), "filename", "error_type")


def usage_tally(events: DataFrame) -> DataFrame:
    """Calls and tokens of each run (a project's model and day)."""
    day = F.to_date("ts")
    return of_type(events, "generation").groupBy("project_id", "model", day.alias("day")).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def run_events(runs: DataFrame, calls: DataFrame, rates: DataFrame) -> DataFrame:
    """One event a run with what its calls took together: calls, tokens, cost and whether it failed.

    ``runs(run_id, content_type, failed)``, ``calls(run_id, model, input_tokens, output_tokens)``, rates by model. A run that failed
    before its first call left nothing to count and has no event; one that failed later has. The cost is null where a call's model
    has no rate; null token counts add nothing.
    """
    known = small(rates.select("model", "input_per_1k", "output_per_1k"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    cost = count("input_tokens") / 1000 * F.col("input_per_1k") + count("output_tokens") / 1000 * F.col("output_per_1k")
    priced = calls.join(known, "model", "left").withColumn("cost", cost)
    tallies = priced.groupBy("run_id").agg(
        F.count("*").alias("calls"), F.sum(count("input_tokens")).alias("input_tokens"), F.sum(count("output_tokens")).alias("output_tokens"),
        F.when(F.count("cost") == F.count("*"), F.round(F.sum("cost"), 8)).alias("cost_usd"),
    )
    joined = runs.join(tallies, "run_id", "left").where(F.col("calls").isNotNull() | ~F.coalesce("failed", F.lit(False)))
    return joined.select("run_id", F.when(F.col("failed"), "generation_failed").otherwise("generation").alias("event_type"), "content_type", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("calls", "input_tokens", "output_tokens")), F.when(F.col("calls").isNull(), F.lit(0.0)).otherwise(F.col("cost_usd")).alias("cost_usd"))


def report(events: DataFrame, zone: str = "UTC") -> DataFrame:
    """One text per project from the tables above."""
    files = files_processed(events).groupBy("project_id").agg(F.array_sort(F.collect_list(F.concat_ws(" | ", "format", "extracted", "errors", F.format_number(100 * F.col("error_rate"), 0)))).alias("rows"))
    costs = cost_by_type(events).where("is_total = 0").groupBy("project_id").agg(F.array_sort(F.collect_list(F.concat_ws(" | ", "content_type", "calls", "input_tokens", "output_tokens", F.format_number("cost_usd", 4)))).alias("cost_rows"))
    months = monthly_costs(events, zone).groupBy("project_id").agg(F.array_sort(F.collect_list(F.concat_ws(" | ", "month", "generations", F.format_number("cost_usd", 4)))).alias("month_rows"))
    for c in ("source_term", "target_term", "source_weeks", "target_weeks", "flag_count"):
        if c not in events.columns:  # a log that never held a rollover
            events = events.withColumn(c, F.lit(None).cast("string"))
    moves = rollover_history(events).groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.concat_ws(" | ", "at", "source_term", "target_term", "source_weeks", "target_weeks", "flag_count").alias("l")))), lambda x: x["l"]).alias("move_rows"))
    checks = consistency(events).select("project_id", F.array(F.concat_ws(" | ", "checks", "caught", "overridden", "caught_terms")).alias("check_rows"))
    s = summary(events)
    joined = s.join(checks, "project_id", "left").join(moves, "project_id", "left").join(files, "project_id", "left").join(costs, "project_id", "left").join(months, "project_id", "left")
    part = lambda title, rows: F.concat(F.lit(f"## {title}\n"), F.coalesce(F.array_join(rows, "\n"), F.lit("none")))
    text = F.concat_ws("\n\n", F.concat(F.lit("# Project "), F.col("project_id")), part("Files", "rows"), part("Consistency", "check_rows"), part("Rollovers", "move_rows"), part("Cost by type", "cost_rows"), part("Cost by month", "month_rows"))
    return joined.select("project_id", text.alias("content"))
