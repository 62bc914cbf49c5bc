"""The rollover of a catalogue as one job: one plan and one moved schedule, read by all of its outputs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import terms as t
from loomwork.operators import rollover as r
from loomwork.sources.files import settled

ADDED = 1000  # row numbers of breaks that come with a new season; those of breaks that were stepped over begin at twice that


class Rollover(NamedTuple):
    schedule: DataFrame  # course_id, row_no, week_number, label, is_break, day, date_end, topics, assignments, notes
    courses: DataFrame  # course_id, term, term_start, term_end, duration_weeks
    university_dates: DataFrame  # course_id, pos, event, rule, day, date_start, date_end
    changes: DataFrame  # course_id, row_no, week_number, label, old_date, new_date, flags
    flags: DataFrame  # course_id, flag, detail


def stepped_over(starts: DataFrame, info: DataFrame) -> DataFrame:
    """(course_id, label, date_start, date_end): the breaks that a schedule's weeks moved past: of each week's start that was
    passed over, the first break that holds all class days of the seven days from it."""
    in_order = Window.partitionBy("course_id").orderBy("week_number")
    past = starts.withColumn("steps", F.col("shift") - F.coalesce(F.lag("shift").over(in_order), F.lit(0))).where("steps > 0")
    slots = past.select("course_id", F.explode(F.transform(F.sequence(F.lit(1), "steps"), lambda k: F.date_sub("start", 7 * k))).alias("slot")).join(info.select("course_id", "days", "breaks"), "course_id")
    wanted = F.when(F.size("days") > 0, F.col("days")).otherwise(F.array(*map(F.lit, range(5))))
    class_days = F.filter(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.date_add("slot", i)), lambda d: F.array_contains(wanted, F.weekday(d)))
    held = slots.withColumn("class_days", class_days)
    inside = F.filter("breaks", lambda b: F.forall("class_days", lambda d: d.between(b["s"], b["e"])))
    return held.select("course_id", F.try_element_at(inside, F.lit(1)).alias("b")).where("b is not null").select("course_id", "b.label", F.col("b.s").alias("date_start"), F.col("b.e").alias("date_end")).distinct()


def roll_over_catalogue(courses: DataFrame, weeks: DataFrame, dates: DataFrame, terms: DataFrame, no_class: DataFrame, choices: DataFrame | None = None) -> Rollover:
    """Schedules, courses, university dates, changes and flags of every course in its target term.

    ``choices(course_id, new_weeks, through)``, a row a course at most: another number of weeks (null: as before; T2 cuts or adds
    weeks) and the names of breaks that the class meets through (J6: their rows go, and nothing steps over or collides with
    them). Breaks that the weeks step over get a row each if there is none yet (U1). Courses whose term isn't in the calendar
    are left to ``look_up_target``.

    Flags of a course: duration_changed, schedule_differs (P7), meeting_count_differs (J8), break_not_taken (J6),
    breaks_replaced (by a new season's), break_stepped_over (U1), past_term_end (P10, where breaks were stepped over),
    unmatched_date and missing_holiday (J7); those of its rows, in ``changes``: collision, numbered_break, clock_change.
    """
    if choices is None:
        choices = courses.select("course_id", F.lit(None).cast("int").alias("new_weeks"), F.array().cast("array<string>").alias("through"))
    given = choices.select("course_id", "new_weeks", F.coalesce("through", F.array().cast("array<string>")).alias("through"))
    planned = r.plan(courses, terms, no_class).where("error_code is null").join(given, "course_id", "left")
    taken = lambda label: ~F.coalesce(F.array_contains("through", label), F.lit(False))
    planned = planned.withColumn("breaks", F.filter("breaks", lambda b: taken(b["label"]))).withColumn("new_weeks", F.coalesce("new_weeks", "duration_weeks"))
    info = settled(planned)
    own = weeks.join(info.select("course_id"), "course_id", "left_semi")
    adjusted = settled(r.adjust_weeks(own, info.select("course_id", "new_weeks")))

    # break rows of the syllabus: those the class meets through go
    had = own.where("is_break")
    through = info.select("course_id", F.explode("through").alias("name"))
    dropped = r.not_observed(had, info, through)
    kept_breaks = had.join(dropped, ["course_id", "row_no"], "left_anti")

    # weeks: their starts, the breaks these step over, their days
    mentions = settled(r.numbered_break(adjusted))
    slot = mentions.select("course_id").distinct().withColumn("own_slot", F.lit(True))
    stepping = info.join(slot, "course_id", "left").withColumn("breaks", F.when(F.col("own_slot").isNull(), F.col("breaks")))
    starts = settled(r.plan_week_starts(stepping.select("course_id", "week_one", "days", "breaks"), adjusted))
    skipped = settled(stepped_over(starts, info))
    moved = r.new_days(adjusted, starts, info).join(info.select("course_id", "target_term", "target_end", "through", "days"), "course_id")
    per_week = Window.partitionBy("course_id", "week_number")
    regular = settled(moved.withColumn("one_a_week", F.count("*").over(per_week) == 1).select("course_id", "row_no", "week_number", "label", "is_break", F.col("day").alias("old_day"), F.col("new_day").alias("day"), "topics", "assignments", "notes", "target_term", "target_end", "through", "days", "one_a_week"))

    # breaks: moved by name or distance, or those of a new season, then those that were stepped over
    same = info.where("not season_change")
    renamed = r.move_breaks(kept_breaks.join(same.select("course_id"), "course_id", "left_semi"), same, no_class).select("course_id", "row_no", "label", "date_start", "date_end")
    new_season = info.where("season_change").join(had.select("course_id").distinct(), "course_id", "left_semi")
    there = r.overlapping_breaks(regular.join(new_season.select("course_id"), "course_id", "left_semi"), no_class).join(info.select("course_id", "through"), "course_id").where(taken(F.col("label"))).drop("through")
    nth = F.row_number().over(Window.partitionBy("course_id").orderBy("date_start"))
    fresh = there.select("course_id", (ADDED + nth).alias("row_no"), t.break_label(F.col("label"), F.col("date_start"), F.col("date_end")).alias("label"), "date_start", "date_end")
    shown = settled(renamed.unionByName(fresh))
    extra = r.added_break_rows(skipped, shown).select("course_id", (2 * ADDED + nth).alias("row_no"), "label", "date_start", "date_end")
    breaks = shown.unionByName(extra)
    none = F.lit(None)
    break_rows = breaks.select("course_id", "row_no", none.cast("int").alias("week_number"), "label", F.lit(True).alias("is_break"), F.col("date_start").alias("day"), "date_end")
    content = ["topics", "assignments", "notes"]
    rows = regular.select("course_id", "row_no", "week_number", "label", "is_break", "day", none.cast("date").alias("date_end"), *content)
    schedule = rows.unionByName(break_rows.join(had.select("course_id", "row_no", *content), ["course_id", "row_no"], "left"))

    # flags of rows
    collisions = r.collisions(regular, no_class).join(info.select("course_id", "through"), "course_id").where(taken(F.col("label")))
    clocks = r.dst_weeks(regular.select("course_id", "row_no", "week_number", "is_break", "day", "assignments"), courses)
    row_flags = (
        collisions.select("course_id", "row_no", F.concat(F.lit("collision:"), "label").alias("flag"))
        .unionByName(mentions.select("course_id", "row_no", F.lit("numbered_break").alias("flag")))
        .unionByName(clocks.select("course_id", "row_no", F.lit("clock_change").alias("flag")))
    )
    joined = row_flags.groupBy("course_id", "row_no").agg(F.array_join(F.array_sort(F.collect_set("flag")), ",").alias("flags"))
    before = regular.select("course_id", "row_no", F.col("old_day").alias("old_date")).unionByName(had.select("course_id", "row_no", F.col("date_start").alias("old_date")))
    changes = schedule.select("course_id", "row_no", "week_number", "label", F.col("day").alias("new_date")).join(before, ["course_id", "row_no"], "left").join(joined, ["course_id", "row_no"], "left")
    changes = changes.select("course_id", "row_no", "week_number", "label", "old_date", "new_date", F.coalesce("flags", F.lit("")).alias("flags"))

    # the courses themselves, and their university dates
    ends = r.term_ends(schedule.select("course_id", "row_no", "is_break", F.when(~F.col("is_break"), F.col("day")).alias("day"), F.when(F.col("is_break"), F.col("day")).alias("date_start"), "date_end"))
    new_courses = info.join(ends, "course_id").select("course_id", F.col("target_term").alias("term"), F.col("week_one").alias("term_start"), F.col("schedule_end").alias("term_end"), F.col("new_weeks").alias("duration_weeks"))
    told = info.select("course_id", "target_term", "old_start", "week_one", "target_end", "season_change")
    new_dates = r.roll_university_dates(dates, told, no_class)

    # flags of courses
    one = lambda df, flag, detail: df.select("course_id", F.lit(flag).alias("flag"), detail.alias("detail"))
    text = lambda c: F.col(c).cast("string")
    span = F.concat_ws(" to ", text("duration_weeks"), text("new_weeks"))
    counted = info.join(r.week_counts(own), "course_id")
    late = r.past_end(regular.join(skipped.select("course_id").distinct(), "course_id", "left_semi"))
    replaced = new_season.join(shown.groupBy("course_id").agg(F.array_join(F.array_sort(F.collect_set(t.core_name(F.col("label")))), ",").alias("names")), "course_id", "left")
    flags = (
        one(info.where("duration_weeks <> new_weeks"), "duration_changed", span)
        .unionByName(one(counted.where("duration_weeks <> week_count"), "schedule_differs", text("week_count")))
        .unionByName(one(r.meeting_plan(adjusted, info).where("flag is not null"), "meeting_count_differs", none.cast("string")))
        .unionByName(one(dropped.select("course_id", "dropped").distinct(), "break_not_taken", F.col("dropped")))
        .unionByName(one(replaced, "breaks_replaced", F.coalesce("names", F.lit(""))))
        .unionByName(one(skipped, "break_stepped_over", F.col("label")))
        .unionByName(one(late, "past_term_end", text("week_number")))
        .unionByName(one(new_dates.where("flag = 'unmatched'"), "unmatched_date", F.col("event")))
        .unionByName(one(r.missing_holidays(dates, told, no_class), "missing_holiday", F.col("label")))
    )
    return Rollover(schedule, new_courses, new_dates.drop("flag"), changes, flags)
