"""Drafts and prompts: what to ask for, what is saved, what is current."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.sources.files import small

ORDER = ("quiz", "discussion", "rubric", "summary")


def catalogue(listing: DataFrame) -> DataFrame:
    """Saved drafts by file name with the number of archived versions; other files are left out.

    ``listing(project_id, path)``. A draft is ``week-N-type.md``; an archived version has a stamp before its suffix.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    stem = F.regexp_extract(name, r"^(week-[0-9]+-[a-z]+)", 1)
    rows = listing.withColumn("stem", stem).where("stem <> ''")
    archived = F.contains("path", F.lit("/.archive/"))
    counted = rows.groupBy("project_id", "stem").agg(F.count_if(archived).alias("versions"), F.count_if(~archived).alias("current"))
    kind = F.regexp_extract("stem", r"^week-[0-9]+-([a-z]+)$", 1)
    rank = F.array_position(F.array(*map(F.lit, ORDER)), kind)
    return counted.where("current > 0").select("project_id", "stem", F.regexp_extract("stem", r"^week-([0-9]+)-", 1).cast("int").alias("week_number"), kind.alias("content_type"), F.when(rank > 0, rank).otherwise(99).cast("int").alias("type_order"), "versions")


def current_versions(writes: DataFrame) -> DataFrame:
    """Of all versions written under a key the newest is current; ``writes(key, version_ts, path)``."""
    order = Window.partitionBy("key").orderBy(F.col("version_ts").desc(), F.col("path").desc())
    return writes.withColumn("nth", F.row_number().over(order)).select("key", "version_ts", "path", (F.col("nth") == 1).alias("is_current"))


def archive_events(writes: DataFrame) -> DataFrame:
    """An ``archive`` event for each version that a newer one replaced: where it was, and its archived name, which has the
    time before the suffix."""
    old = current_versions(writes).where("not is_current")
    suffix, stem = F.regexp_extract("key", r"(\.[^./]+)$", 1), F.regexp_replace("key", r"\.[^./]+$", "")
    return old.select(F.lit("archive").alias("event_type"), F.col("key").alias("original_path"), F.concat(stem, F.lit("-"), F.date_format("version_ts", "yyyyMMdd-HHmmss"), suffix).alias("archived_path"), "path")


def recent_projects(files: DataFrame) -> DataFrame:
    """Each project's last use; ``files(project_id, modified_at)``."""
    return files.groupBy("project_id").agg(F.max("modified_at").alias("last_used"), F.count("*").alias("files"))


def latest_sources(added: DataFrame) -> DataFrame:
    """Of source files added under one name the latest counts; ``added(project_id, filename, added_at, source_id)``."""
    order = Window.partitionBy("project_id", "filename").orderBy(F.col("added_at").desc(), F.col("source_id").desc())
    kept = added.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
    return kept.withColumn("source_count", F.count("*").over(Window.partitionBy("project_id")))


def merged_weeks(weeks: DataFrame) -> DataFrame:
    """All meetings of a week in one row: topics and assignments in row order, notes joined."""
    rows = weeks.where("not is_break").groupBy("course_id", "week_number").agg(F.array_sort(F.collect_list(F.struct("row_no", "topics", "assignments", "notes"))).alias("r"))
    flat = lambda name: F.flatten(F.transform("r", lambda x: x[name]))
    return rows.select("course_id", "week_number", flat("topics").alias("topics"), flat("assignments").alias("assignments"), F.concat_ws("; ", F.transform("r", lambda x: x["notes"])).alias("notes"))


def missing_variables(templates: DataFrame, required: DataFrame) -> DataFrame:
    """Required variables that a template doesn't name; ``templates(template_id, content_type, text)``."""
    named = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\{([a-z_]+)\}"), F.lit(1)))
    gone = F.array_sort(F.array_except("variables", named))
    return templates.join(small(required), "content_type").withColumn("missing", gone).where(F.size("missing") > 0).select("template_id", "content_type", F.array_join("missing", ",").alias("missing"))


# What a quiz may be made of; the last mixes the other two.
QUIZ_FORMATS = ("multiple choice", "short answer", "mixed")
BY_WEEK = ("quiz", "discussion", "summary", "slides")  # content that belongs to a week of the schedule


def checked_requests(requests: DataFrame, weeks: DataFrame) -> DataFrame:
    """(request_id, error_code, format): what is wrong with each request, first things first, and the text that stands for a
    quiz's format; null where nothing is.

    ``requests(request_id, course_id, content_type, week_number, question_count, quiz_format, multiple_choice, short_answer,
    prompt_count, name, goal, description, mode, total_points)``. Content by week needs a week of the course's schedule; a mixed quiz
    may say how many questions of each kind it has: both, at least one each, all together its count. Blank texts are none.
    """
    taught = weeks.where("not is_break").select("course_id", "week_number", F.lit(True).alias("is_taught")).distinct()
    rows = requests.join(taught, ["course_id", "week_number"], "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    is_type = lambda name: F.col("content_type") == name
    few = lambda c: F.coalesce(F.col(c), F.lit(0)) < 1
    mc, sa = F.col("multiple_choice"), F.col("short_answer")
    split = is_type("quiz") & (F.col("quiz_format") == QUIZ_FORMATS[-1]) & (mc.isNotNull() | sa.isNotNull())
    rules = [
        (is_type("assignment") & (blank("name") | blank("goal")), "no_name_or_goal"),
        (is_type("assignment") & ~F.coalesce(F.col("mode").isin("create", "enhance"), F.lit(False)), "unknown_mode"),
        (is_type("assignment") & (F.col("mode") == "enhance") & blank("description"), "nothing_to_enhance"),
        (is_type("rubric") & (blank("name") | blank("description")), "no_name_or_description"),
        (is_type("rubric") & few("total_points"), "no_points"),
        (F.col("content_type").isin(*BY_WEEK) & F.col("is_taught").isNull(), "no_such_week"),
        (is_type("quiz") & few("question_count"), "no_questions"),
        (is_type("quiz") & ~F.coalesce(F.col("quiz_format").isin(*QUIZ_FORMATS), F.lit(False)), "unknown_format"),
        (split & (mc.isNull() | sa.isNull()), "half_a_split"),
        (split & ((mc < 1) | (sa < 1)), "empty_part"),
        (split & (mc + sa != F.col("question_count")), "parts_and_count_differ"),
        (is_type("discussion") & few("prompt_count"), "no_prompts"),
    ]
    error = F.coalesce(*(F.when(F.coalesce(wrong, F.lit(False)), code) for wrong, code in rules))
    mixed = F.concat(F.lit("mixed (exactly "), mc.cast("string"), F.lit(" multiple choice and "), sa.cast("string"), F.lit(" short answer)"))
    text = F.when(is_type("quiz") & error.isNull(), F.when(split, mixed).otherwise(F.col("quiz_format")))
    return rows.select("request_id", error.alias("error_code"), text.alias("format"))


def with_guidance(prompts: DataFrame, templates: DataFrame, guidance: DataFrame) -> DataFrame:
    """Prompts with the guidance that their template has no place for, each on its own behind a blank line, by ``pos``.

    ``prompts(request_id, content_type, prompt)``, ``templates(content_type, text)``, ``guidance(request_id, pos, variable, text)``; blank
    guidance adds nothing.
    """
    known = small(templates.select("content_type", F.regexp_extract_all("text", F.lit(r"\{([a-z_]+)\}"), F.lit(1)).alias("named")))
    asked = guidance.where("trim(text) <> ''").join(prompts.select("request_id", "content_type"), "request_id").join(known, "content_type").where(~F.array_contains("named", F.col("variable")))
    listed = asked.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("more"))
    full = F.concat(F.array_join(F.concat(F.array(F.regexp_replace("prompt", r"\s+$", "")), F.col("more")), "\n\n"), F.lit("\n"))
    return prompts.join(listed, "request_id", "left").select("request_id", "content_type", F.when(F.col("more").isNull(), F.col("prompt")).otherwise(full).alias("prompt"))


def prompts(requests: DataFrame, weeks: DataFrame, sources: DataFrame, templates: DataFrame, budget: int = 24_000) -> DataFrame:
    """The prompt of each request, filled in one pass, so values with braces stay as they are.

    ``requests(request_id, course_id, content_type, week_number)``, ``sources(course_id, pos, name, text)``, pos and name
    once a course: all of a course, in order, share one budget of characters, and no more than that is gathered; ``templates(content_type, text)``. Unknown
    braces are kept. Sources without text are left out.
    """
    piece = F.concat(F.lit("### "), "name", F.lit("\n"), "text")
    in_order = Window.partitionBy("course_id").orderBy("pos", "name")
    # lengths of all go through the window, texts of those only that begin inside the budget are fetched
    sized = sources.where("text is not null").select("course_id", "pos", "name", F.length(piece).alias("size"))
    sized = sized.withColumn("gap", F.when(F.row_number().over(in_order) > 1, 2).otherwise(0))
    placed = sized.withColumn("end", F.sum(F.col("size") + F.col("gap")).over(in_order)).withColumn("start", F.col("end") - F.col("size") - F.col("gap"))
    lengths = placed.groupBy("course_id").agg(F.max("end").alias("length"))
    inside = placed.where(F.col("start") < budget).join(sources.where("text is not null"), ["course_id", "pos", "name"])
    kept = F.substring(F.concat(F.when(F.col("gap") > 0, "\n\n").otherwise(""), piece), F.lit(1), (budget - F.col("start")).cast("int"))
    pieces = inside.select("course_id", F.struct("pos", "name", kept.alias("kept")).alias("p")).groupBy("course_id").agg(F.array_sort(F.collect_list("p")).alias("pieces"))
    whole = lengths.join(pieces, "course_id")
    gone = F.col("length") - budget
    context = whole.select("course_id", F.concat(F.array_join(F.transform("pieces", lambda x: x["kept"]), ""), F.when(gone > 0, F.concat(F.lit("\n[... "), gone.cast("string"), F.lit(" characters omitted]"))).otherwise(F.lit(""))).alias("context"))
    week = merged_weeks(weeks).select("course_id", "week_number", F.array_join("topics", ", ").alias("topics"), F.array_join("assignments", ", ").alias("assignments"))
    rows = requests.join(week, ["course_id", "week_number"], "left").join(context, "course_id", "left").join(small(templates.withColumnRenamed("text", "template")), "content_type")
    values = F.create_map(*[x for n in ("week_number", "topics", "assignments", "context") for x in (F.lit(n), F.coalesce(F.col(n).cast("string"), F.lit("")))])
    # a template in pieces: every other one is a variable's name
    marked = F.split(F.regexp_replace("template", r"\{([a-z_]+)\}", "\u0001$1\u0001"), "\u0001")
    filled = F.transform(marked, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.coalesce(F.try_element_at(values, x), F.concat(F.lit("{"), x, F.lit("}")))))
    text = F.array_join(filled, "")
    return rows.select("request_id", "content_type", text.alias("prompt"), F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long").alias("tokens"))
