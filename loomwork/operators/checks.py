"""Checks of course records: what is missing, what contradicts itself. Every job keeps its reasons as codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import terms as t
from loomwork.sources.files import small

# The months in which a season's first class may be.
MONTHS = {"Fall": (8, 11), "Spring": (1, 4), "Summer": (5, 7)}
DETAILS = ("number", "title", "term", "meeting_pattern")


def codes(*pairs: tuple[Column, str]) -> Column:
    return F.concat_ws(",", *(F.when(cond, code) for cond, code in pairs))


def invalid_weeks(weeks: DataFrame) -> DataFrame:
    """Break rows need a span; all others a number and a date. Rows that break a rule, with the rules."""
    reasons = codes(
        (F.col("is_break") & (F.col("date_start").isNull() | F.col("date_end").isNull()), "break_without_span"),
        (~F.col("is_break") & F.col("week_number").isNull(), "week_without_number"),
        (~F.col("is_break") & F.col("day").isNull(), "week_without_date"),
    )
    return weeks.select("course_id", "row_no", reasons.alias("reasons")).where("reasons <> ''")


def in_months(season: Column, month: Column) -> Column:
    out = F.lit(None).cast("boolean")
    for name, (lo, hi) in MONTHS.items():
        out = F.when(season == name, month.between(lo, hi)).otherwise(out)
    return out


def term_consistency(courses: DataFrame, weeks: DataFrame) -> DataFrame:
    """Does the term's season fit the month of Week 1? Without either there is nothing to say, and it passes."""
    first = weeks.where("week_number = 1 and not is_break").groupBy("course_id").agg(F.min_by("day", F.struct("day", "row_no")).alias("first_day"))
    joined = courses.select("course_id", "term").join(first, "course_id", "left")
    said, month = t.season(F.col("term")), F.month("first_day")
    passed = F.coalesce(in_months(said, month), F.lit(True))
    likely = F.when(month.between(8, 11), "Fall").when(month.between(1, 4), "Spring").when(month.between(5, 7), "Summer").otherwise("Fall")
    return joined.select("course_id", "term", month.alias("first_month"), passed.alias("passed"), F.when(~passed, likely).alias("likely_season"))


def lists_breaks(dates: DataFrame) -> DataFrame:
    """Whether a syllabus mentions a break or a span of days."""
    return dates.groupBy("course_id").agg(F.bool_or(F.contains(F.lower("event"), F.lit("break")) | F.col("date_start").isNotNull()).alias("lists_breaks"))


def duration_flags(courses: DataFrame, weeks: DataFrame) -> DataFrame:
    """The new duration differs from the old; the stated duration differs from the schedule."""
    counts = weeks.where("not is_break").groupBy("course_id").agg(F.count_distinct("week_number").alias("week_count"))
    joined = courses.join(counts, "course_id")
    return joined.select("course_id", "duration_weeks", "new_weeks", "week_count", (F.col("duration_weeks") != F.col("new_weeks")).alias("duration_changed"), (F.col("duration_weeks") != F.col("week_count")).alias("schedule_differs"))


def course_levels(courses: DataFrame) -> DataFrame:
    """Graduate from 6000, upper from 3000, else lower; null without a four-digit number."""
    n = F.regexp_extract("number", r"\b([0-9]{4})\b", 1).try_cast("int")
    return courses.select("course_id", "number", F.when(n >= 6000, "graduate").when(n >= 3000, "upper").when(n.isNotNull(), "lower").alias("level"))


def calendar_problems(terms: DataFrame, no_class: DataFrame) -> DataFrame:
    """Terms that end before they start or stand out of order; entries without a date, reversed, or outside their term."""
    order = Window.orderBy("pos")  # a calendar is one short list
    bad_terms = terms.withColumn("before", F.lag("start_date").over(order)).select(
        "term", "pos", F.lit(None).cast("string").alias("label"), codes((F.col("start_date") >= F.col("end_date"), "reversed_term"), (F.col("before") >= F.col("start_date"), "terms_out_of_order")).alias("problem")
    )
    entries = no_class.join(small(terms.select("term", "start_date", "end_date")), "term", "left")
    lo, hi = F.coalesce("day", "date_start"), F.coalesce("day", "date_end")
    bad_entries = entries.select("term", "pos", "label", codes((lo.isNull() | hi.isNull(), "no_date"), (lo > hi, "reversed_span"), ((lo < F.col("start_date")) | (hi > F.col("end_date")), "outside_term"), (F.col("start_date").isNull(), "unknown_term")).alias("problem"))
    return bad_terms.unionByName(bad_entries).where("problem <> ''")


def weight_warnings(assessments: DataFrame) -> DataFrame:
    """Courses whose weights don't sum to 1, with the sum; courses without assessments are not warned about."""
    total = assessments.groupBy("course_id").agg(F.round(F.sum("weight"), 6).alias("total"))
    return total.where(F.abs(F.col("total") - 1) > 0.005)


def extraction_summary(courses: DataFrame, weeks: DataFrame, dates: DataFrame) -> DataFrame:
    """Row counts of each course's tables and its blank details."""
    w = weeks.groupBy("course_id").agg(F.count_if(~F.col("is_break")).alias("week_rows"), F.count_if("is_break").alias("break_rows"))
    d = dates.groupBy("course_id").agg(F.count("*").alias("dates"))
    blanks = codes(*((F.coalesce(F.trim(c), F.lit("")) == "", c) for c in DETAILS))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return courses.join(w, "course_id", "left").join(d, "course_id", "left").select("course_id", zero("week_rows"), zero("break_rows"), zero("dates"), blanks.alias("blank_fields"))


def reading_summary(courses: DataFrame, weeks: DataFrame, dates: DataFrame, assessments: DataFrame, objectives: DataFrame) -> DataFrame:
    """What was read of each course: rows of its schedule and dates, assessments with the sum of their weights and whether
    that needs a look (A8), learning objectives, and blank details. ``assessments(course_id, weight)``, ``objectives(course_id)``."""
    graded = assessments.groupBy("course_id").agg(F.count("*").alias("assessments"), F.round(F.sum("weight"), 6).alias("weight_total"))
    aims = objectives.groupBy("course_id").agg(F.count("*").alias("objectives"))
    odd = weight_warnings(assessments).select("course_id", F.lit(True).alias("weight_warning"))
    joined = extraction_summary(courses, weeks, dates).join(graded, "course_id", "left").join(aims, "course_id", "left").join(odd, "course_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("course_id", "week_rows", "break_rows", "dates", zero("assessments"), "weight_total", F.coalesce("weight_warning", F.lit(False)).alias("weight_warning"), zero("objectives"), "blank_fields")
