"""Rubrics, replies and scores of many submissions at once."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CRITERION = r"^\s*([0-9]+)[.)]\s+(.+?)\s+-\s+([0-9]+(?:\.[0-9]+)?)\s+points?\s*$"
PART = r"^\s*-\s+(.+?)\s+-\s+([0-9]+(?:\.[0-9]+)?)\s+points?\s*$"
POINTS = "decimal(20,6)"


def rubric_lines(rubrics: DataFrame) -> DataFrame:
    """Criterion and part lines, each part with the latest criterion above it (a running count of criteria)."""
    rows = rubrics.select("rubric_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    rows = rows.withColumn("is_criterion", F.rlike("text", F.lit(CRITERION))).withColumn("is_part", F.rlike("text", F.lit(PART)))
    above = Window.partitionBy("rubric_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("pos", F.sum(F.col("is_criterion").cast("int")).over(above)).where("is_criterion or (is_part and pos > 0)")


def criteria(rubrics: DataFrame) -> DataFrame:
    """E5: criteria with points and whether their parts add up to them."""
    rows = rubric_lines(rubrics)
    name = F.regexp_extract("text", CRITERION, 2)
    points = F.regexp_extract("text", CRITERION, 3).try_cast(POINTS)
    part = F.regexp_extract("text", PART, 2).try_cast(POINTS)
    out = rows.groupBy("rubric_id", F.col("pos").cast("int").alias("pos")).agg(
        F.max(F.when(F.col("is_criterion"), name)).alias("name"), F.max(F.when(F.col("is_criterion"), points)).alias("possible"),
        F.count_if("is_part").alias("parts"), F.sum(F.when(F.col("is_part"), part)).alias("part_points"),
    )
    return out.select("rubric_id", "pos", "name", F.col("possible").cast("double").alias("possible"), "parts", (F.col("part_points").isNull() | (F.col("part_points") == F.col("possible"))).alias("adds_up"))


def reply_json(text: Column) -> Column:
    """the inside of a code fence, else from the first brace to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).otherwise(bare)


def parsed_replies(replies: DataFrame) -> DataFrame:
    """the earliest attempt of each criterion whose JSON holds a name and a number; ``replies(submission_id, pos, attempt, text)``."""
    body = F.from_json(reply_json(F.col("text")), "name string, earned double, reasoning string, deduction_comment string, evidence array<string>")
    good = replies.withColumn("r", body).where("r.name is not null and r.earned is not null")
    return good.groupBy("submission_id", "pos").agg(F.min_by("r", "attempt").alias("r"), F.min("attempt").alias("attempt")).select("submission_id", "pos", "attempt", "r.*")


def criterion_scores(replies: DataFrame, rubric: DataFrame, submissions: DataFrame) -> DataFrame:
    """Replies matched to the rubric by place; the rubric owns the points. Reasons that a row is wrong are codes.

    ``submissions(submission_id, rubric_id)``, ``rubric`` from ``criteria``. A criterion without a reply is there too.
    """
    due = submissions.join(rubric, "rubric_id").select("submission_id", "rubric_id", "pos", F.col("name").alias("criterion"), "possible")
    got = parsed_replies(replies)
    joined = due.join(got, ["submission_id", "pos"], "left")
    error = F.concat_ws(
        ",",
        F.when(F.col("earned").isNull(), "no_reply"),
        F.when(F.lower(F.trim("name")) != F.lower(F.trim("criterion")), "name_differs"),
        F.when((F.col("earned") < 0) | (F.col("earned") > F.col("possible")), "out_of_range"),
    )
    return joined.select("submission_id", "rubric_id", "pos", "criterion", "possible", "earned", "reasoning", "deduction_comment", "evidence", error.alias("errors"))


def totals(scores: DataFrame) -> DataFrame:
    """Sums, percentage, strengths (three quarters or more) and improvements of each submission, in rubric order."""
    listed = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "criterion")))), lambda x: x["criterion"]), "; ")
    ok = F.col("errors") == ""
    out = scores.groupBy("submission_id", "rubric_id").agg(
        F.sum(F.when(ok, F.col("earned").cast(POINTS))).cast("double").alias("earned"), F.sum(F.col("possible").cast(POINTS)).cast("double").alias("possible"),
        F.count_if(~ok).alias("errors"), listed(ok & (F.col("earned") >= 0.75 * F.col("possible"))).alias("strengths"), listed(ok & (F.col("earned") < F.col("possible"))).alias("improvements"),
    )
    earned = F.coalesce("earned", F.lit(0.0))
    return out.select("submission_id", "rubric_id", earned.alias("earned"), "possible", F.when(F.col("possible") > 0, F.round(100 * earned / F.col("possible"), 4)).alias("percent"), "errors", "strengths", "improvements")


@F.pandas_udf(T.StringType())
def normalized(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, straight quotes and dashes, case folded, white space as one blank."""
    straight = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "‑": "-"})

    def one(text: str | None) -> str | None:
        return None if text is None else " ".join(unicodedata.normalize("NFKC", text).translate(straight).casefold().split())

    for c in columns:
        yield c.map(one)


def ground(quotes: DataFrame, submissions: DataFrame) -> DataFrame:
    """Does each quote stand in its submission? Pieces between "..." must follow each other there.

    ``quotes(submission_id, quote_id, quote)``, ``submissions(submission_id, text)``. Texts are normalised once each, before
    the join. Codes: found, not_found, no_quote.
    """
    texts = submissions.select("submission_id", normalized("text").alias("body"))
    asked = quotes.select("submission_id", "quote_id", normalized("quote").alias("q"))
    trimmed = F.transform(F.split("q", r"\.\.\."), lambda x: F.regexp_replace(x, r"^[\s\"'.,;:]+|[\s\"'.,;:]+$", ""))
    pieces = F.filter(trimmed, lambda x: x != "")

    def step(at: Column, piece: Column) -> Column:
        where = F.when(at < 1, F.lit(0)).otherwise(F.call_function("locate", piece, F.col("body"), at))
        return F.when(where > 0, where + F.length(piece)).otherwise(F.lit(-1))

    joined = asked.join(texts, "submission_id", "left").withColumn("pieces", pieces)
    end = F.aggregate("pieces", F.lit(1), step)
    note = F.when(F.coalesce(F.size("pieces"), F.lit(0)) <= 0, "no_quote").when(F.col("body").isNotNull() & (end > 0), "found").otherwise("not_found")
    return joined.select("submission_id", "quote_id", note.alias("note"))


NO_REASON, CONTRADICTION = "No reason was given for this deduction; please review it.", "The explanation states another score; please review it."
STATED = r"(?<![0-9])([0-9]+(?:\.[0-9]+)?)\s*/\s*([0-9]+(?:\.[0-9]+)?)(?![0-9])"


def reviewed(scores: DataFrame, submissions: DataFrame) -> DataFrame:
    """Criterion scores with what an instructor must see: a comment on each deduction, a warning where the reasoning
    states "x/y" with the full points but another score, and a note where the evidence isn't in the submission.

    ``scores`` from ``criterion_scores``, ``submissions(submission_id, text)``. Notes: ``not_found`` if any quote isn't there,
    ``no_quote`` if there is none.
    """
    quotes = scores.select("submission_id", "pos", F.posexplode_outer("evidence").alias("nth", "quote")).select("submission_id", F.struct("pos", "nth").alias("quote_id"), F.coalesce("quote", F.lit("")).alias("quote"))
    notes = ground(quotes, submissions).groupBy("submission_id", F.col("quote_id.pos").alias("pos")).agg(F.when(F.bool_or(F.col("note") == "not_found"), "not_found").when(~F.bool_or(F.col("note") == "found"), "no_quote").alias("evidence_note"))
    pairs = F.arrays_zip(F.regexp_extract_all("reasoning", F.lit(STATED), F.lit(1)).alias("x"), F.regexp_extract_all("reasoning", F.lit(STATED), F.lit(2)).alias("y"))
    contradicts = F.coalesce(F.exists(pairs, lambda p: (p["y"].cast("double") == F.col("possible")) & (p["x"].cast("double") != F.col("earned"))), F.lit(False))
    given = F.nullif(F.trim(F.coalesce("deduction_comment", F.lit(""))), F.lit(""))
    comment = F.when(F.col("earned") < F.col("possible"), F.concat_ws(" ", F.coalesce(given, F.lit(NO_REASON)), F.when(contradicts, CONTRADICTION))).otherwise("")
    out = scores.join(notes, ["submission_id", "pos"], "left")
    return out.select("submission_id", "rubric_id", "pos", "criterion", "possible", "earned", "errors", F.coalesce("reasoning", F.lit("")).alias("reasoning"), comment.alias("deduction_comment"), contradicts.alias("contradicts"), "evidence_note")


def feedback(rows: DataFrame) -> DataFrame:
    """One report a submission from ``reviewed`` rows: totals, a comment for the student, notes for the instructor with
    the criteria whose evidence must be checked. A submission with a row that can't be scored is an error without texts."""
    names = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "criterion")))), lambda x: x["criterion"]), ", ")
    line = F.struct("pos", F.concat_ws(": ", "criterion", "reasoning").alias("l"))
    g = rows.groupBy("submission_id", "rubric_id").agg(
        F.sum(F.col("earned").cast(POINTS)).cast("double").alias("earned"), F.sum(F.col("possible").cast(POINTS)).cast("double").alias("possible"), F.bool_or(F.col("errors") != "").alias("bad"),
        names(F.col("earned") >= 0.75 * F.col("possible")).alias("good"), names(F.col("earned") < F.col("possible")).alias("weak"), names(F.col("evidence_note").isNotNull()).alias("unsupported"),
        F.count_if("contradicts").alias("contradictions"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "\n").alias("lines"),
    )
    said = lambda text, c: F.when(F.col(c) != "", F.concat(F.lit(text), F.lower(c), F.lit(".")))
    student = F.concat_ws(" ", said("Well done: ", "good"), said("Work next on: ", "weak"), F.lit("The rubric has the details."))
    notes = F.concat_ws("\n", F.lit("Preliminary scores; please review."), F.when(F.col("unsupported") != "", F.concat(F.lit("Check the evidence for: "), "unsupported", F.lit("."))), "lines")
    ok = lambda c: F.when(~F.col("bad"), c)
    return g.select("submission_id", "rubric_id", ok(F.col("earned")).alias("earned"), "possible", ok(F.round(100 * F.col("earned") / F.col("possible"), 4)).alias("percent"), ok(student).alias("comment"), ok(notes).alias("notes"), ok(F.col("unsupported")).alias("unsupported"), ok(F.col("contradictions")).alias("contradictions"), F.when(F.col("bad"), "needs_review").alias("error_code"))
