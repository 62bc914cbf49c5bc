"""Moving whole catalogues of courses to a new term.

Calendars are configuration: a few rows a term, with a checked bound, and always the broadcast side. Courses are
split by ``course_id`` once; windows and folds over a course's weeks then share that partitioning. ``weeks`` of one
course are at most a term's, so what a fold gathers is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import terms as t
from loomwork.sources.files import dealt, settled, small

def look_up_target(courses: DataFrame, terms: DataFrame, manual: str | None = None) -> DataFrame:
    """The target term's dates; Week 1 is the manual date, else the term's start, else the course is an error row."""
    found = small(terms.select(F.col("term").alias("target_term"), F.col("start_date").alias("target_start"), F.col("end_date").alias("target_end")))
    given = F.to_date(F.lit(manual)) if manual else F.lit(None).cast("date")
    return courses.join(found, "target_term", "left").withColumn("week_one", F.coalesce(given, "target_start")).withColumn("error_code", F.when(F.col("week_one").isNull(), "no_week_one"))


def next_terms(terms: DataFrame, courses: DataFrame) -> DataFrame:
    """The same season next year if listed, else the next term in the list, else null."""
    # the calendar is one short list: a window over all of it
    listed = terms.select("term", F.lead("term").over(Window.orderBy("pos")).alias("after"))
    names = small(terms.select(F.col("term").alias("same_next")))
    wanted = F.concat_ws(" ", F.regexp_extract("term", r"^(.*) [0-9]+$", 1), (F.regexp_extract("term", r" ([0-9]+)$", 1).try_cast("int") + 1).cast("string"))
    out = courses.withColumn("wanted", wanted).join(names, F.col("wanted") == F.col("same_next"), "left").join(small(listed), "term", "left")
    return out.select("course_id", "term", F.coalesce("same_next", "after").alias("suggested_term"))


def week_counts(weeks: DataFrame) -> DataFrame:
    """Distinct teaching weeks of each course."""
    return weeks.groupBy("course_id").agg(F.count_distinct(F.when(~F.col("is_break"), F.col("week_number"))).alias("week_count"))


def numbered_break(weeks: DataFrame) -> DataFrame:
    """P5: weeks with a number whose words mention a break; ``mention`` is what they say."""
    words = F.concat_ws(" ", F.flatten(F.array("topics", "assignments")), "notes")
    return weeks.where(~F.col("is_break")).withColumn("mention", t.break_mention(words)).where("mention is not null").select("course_id", "row_no", "week_number", "mention")


def number_meetings(weeks: DataFrame) -> DataFrame:
    """The place of each row in its week; null in courses where no week repeats, and in breaks."""
    in_week = Window.partitionBy("course_id", "week_number")
    rows = weeks.withColumn("nth", F.when(~F.col("is_break"), F.row_number().over(in_week.orderBy("row_no")))).withColumn("of", F.count(F.when(~F.col("is_break"), 1)).over(in_week))
    repeats = F.max(F.when(~F.col("is_break"), F.col("of"))).over(Window.partitionBy("course_id")) > 1
    return rows.withColumn("meeting", F.when(repeats, F.col("nth")).cast("int")).drop("nth", "of")


def usual_weekdays(weeks: DataFrame) -> DataFrame:
    """The set of weekdays that most weeks with the most distinct days have; ties go to the first seen."""
    dated = weeks.where("not is_break and day is not null")
    sets = dated.groupBy("course_id", "week_number").agg(F.array_sort(F.collect_set(F.weekday("day"))).alias("days"), F.min("row_no").alias("first"))
    most = Window.partitionBy("course_id")
    full = sets.withColumn("n", F.max(F.size("days")).over(most)).where(F.size("days") == F.col("n"))
    counted = full.groupBy("course_id", "days").agg(F.count("*").alias("c"), F.min("first").alias("first"))
    return counted.groupBy("course_id").agg(F.min_by("days", F.struct(-F.col("c"), F.col("first"))).alias("schedule_days"))


def usual_row_weekday(weeks: DataFrame, share: float = 0.75) -> DataFrame:
    """The commonest weekday of the rows, if it holds at least ``share`` of them."""
    days = weeks.where("not is_break and day is not null").groupBy("course_id", F.weekday("day").alias("d")).agg(F.count("*").alias("n"))
    best = days.groupBy("course_id").agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("d"), F.max("n").alias("n"), F.sum("n").alias("all"))
    return best.select("course_id", F.when(F.col("n") >= share * F.col("all"), F.col("d")).alias("usual_day"))


def adjust_weeks(weeks: DataFrame, courses: DataFrame) -> DataFrame:
    """The first N distinct weeks of each course, or weeks count + 1 to N more with a placeholder note.

    ``courses(course_id, new_weeks)``. The added rows have no day yet.
    """
    regular = weeks.where("not is_break")
    rank = F.dense_rank().over(Window.partitionBy("course_id").orderBy("week_number"))
    kept = regular.withColumn("nth", rank).join(courses.select("course_id", "new_weeks"), "course_id").where("nth <= new_weeks").drop("nth", "new_weeks")
    counts = courses.join(week_counts(weeks), "course_id", "left").withColumn("week_count", F.coalesce("week_count", F.lit(0)).cast("int")).where("new_weeks > week_count")
    added = counts.select("course_id", F.explode(F.sequence(F.col("week_count") + 1, F.col("new_weeks"))).alias("week_number"))
    blank = added.select("course_id", (F.col("week_number") * 10).alias("row_no"), "week_number", F.concat(F.lit("Week "), "week_number").alias("label"), F.lit(False).alias("is_break"), F.lit("Placeholder: add topics").alias("notes"))
    return kept.unionByName(blank, allowMissingColumns=True)


def spans_of(no_class: DataFrame) -> DataFrame:
    """A term's breaks of several days, gathered in date order: a calendar's few rows."""
    rows = no_class.where("date_start is not null and date_end is not null")
    return rows.groupBy(F.col("term").alias("target_term")).agg(F.array_sort(F.collect_list(F.struct(F.col("date_start").alias("s"), F.col("date_end").alias("e"), "label"))).alias("breaks"))


def plan_week_starts(courses: DataFrame, weeks: DataFrame) -> DataFrame:
    """The first day of every week in the new term, a week apart, stepping over breaks.

    ``courses(course_id, week_one, days, breaks)``. While one break covers all class days of the seven days from a week's
    start, this week and all later ones move a week on. Returns course_id, week_number, start and shift; one fold a course.
    """
    numbers = weeks.where("not is_break and week_number is not null").groupBy("course_id").agg(F.array_sort(F.collect_set("week_number")).alias("numbers"))

    def covered(start: Column) -> Column:
        wanted = F.when(F.size("days") > 0, F.col("days")).otherwise(F.array(*map(F.lit, range(5))))
        days = F.filter(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.date_add(start, i)), lambda d: F.array_contains(wanted, F.weekday(d)))
        return F.exists(F.coalesce("breaks", F.array().cast("array<struct<s:date,e:date,label:string>>")), lambda b: F.forall(days, lambda d: d.between(b["s"], b["e"])))

    # Which of the weeks from the one before Week 1 are covered: once for each calendar and set of class days, for as many
    # weeks as the longest schedule there has and its breaks can take.
    key = ["week_one", "days", "breaks"]
    taken = F.aggregate(F.coalesce("breaks", F.array().cast("array<struct<s:date,e:date,label:string>>")), F.lit(0), lambda n, b: n + F.floor(F.date_diff(b["e"], b["s"]) / 7).cast("int") + 2)
    kinds = courses.where("week_one is not null").join(numbers, "course_id").groupBy(*key).agg(F.max(F.array_max("numbers")).alias("last"))
    kinds = kinds.withColumn("covered", F.transform(F.sequence(F.lit(-1), F.greatest("last", F.lit(1)) + taken), lambda i: covered(F.date_add("week_one", 7 * i))))
    kinds = small(kinds.select(*(F.col(k).alias(f"k_{k}") for k in key), "covered"))
    joined = courses.join(numbers, "course_id").join(kinds, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in key])

    def step(state: Column, n: Column) -> Column:
        free = F.greatest(F.array_position(F.slice("covered", n + state["shift"] + 1, F.size("covered")), False) - 1, F.lit(0)).cast("int")
        shift = state["shift"] + free
        new = F.struct(n.alias("week_number"), F.date_add(F.col("week_one"), (7 * (n - 1 + shift)).cast("int")).alias("start"), shift.alias("shift"))
        return F.struct(shift.alias("shift"), F.concat(state["out"], F.array(new)).alias("out"))

    empty = F.array().cast("array<struct<week_number:int,start:date,shift:int>>")
    walked = joined.withColumn("plan", F.aggregate("numbers", F.struct(F.lit(0).alias("shift"), empty.alias("out")), step, lambda s: s["out"]))
    return walked.select("course_id", F.explode("plan").alias("p")).select("course_id", "p.*")


def meeting_plan(weeks: DataFrame, courses: DataFrame) -> DataFrame:
    """For schedules with a row a class meeting, the new weekday of each old one: both in their order through a week
    that begins on its term's first weekday, so the first meeting stays first.

    ``courses(course_id, old_start, week_one, days)``. Returns course_id, old_days, days, pairs (a map, null where the
    numbers of days differ or none are picked) and flag: ``meeting_count_differs`` where days are picked but can't be paired.
    """
    repeats = weeks.where("not is_break").groupBy("course_id").agg((F.count("*") > F.count_distinct("week_number")).alias("repeats"), F.min("day").alias("first_day")).where("repeats")
    met = repeats.join(usual_weekdays(weeks), "course_id").join(courses.select("course_id", "old_start", "week_one", "days"), "course_id")

    def in_order(days: str, start: Column) -> Column:
        keyed = F.array_sort(F.transform(days, lambda d: F.struct(F.pmod(d - F.weekday(start), F.lit(7)).alias("k"), d.alias("d"))))
        return F.transform(keyed, lambda x: x["d"])

    alike = F.size("days") == F.size("schedule_days")
    pairs = F.when(alike, F.map_from_arrays(in_order("schedule_days", F.coalesce("old_start", "first_day")), in_order("days", F.col("week_one"))))
    return met.select("course_id", F.col("schedule_days").alias("old_days"), "days", pairs.alias("pairs"), F.when((F.size("days") > 0) & ~alike, "meeting_count_differs").alias("flag"))


def new_days(weeks: DataFrame, starts: DataFrame, courses: DataFrame) -> DataFrame:
    """a row's day in the new term: where each class meeting has a row, the planned weekday on or after its week's start
    (J8); where each week has one, the first class day on or after it; else the week's start and the days since the week's
    first meeting. ``courses(course_id, old_start, week_one, days)``.
    """
    asked = courses.select("course_id", "days").join(meeting_plan(weeks, courses).select("course_id", "pairs"), "course_id", "left")
    regular = weeks.where("not is_break").join(starts, ["course_id", "week_number"]).join(asked, "course_id")
    week = Window.partitionBy("course_id", "week_number")
    since = F.coalesce(F.date_diff("day", F.min("day").over(week)), F.lit(0))
    counted = regular.withColumn("since", since).withColumn("in_week", F.count("*").over(week))
    once = F.max("in_week").over(Window.partitionBy("course_id")) == 1
    planned = F.try_element_at("pairs", F.weekday("day"))
    on_plan = F.date_add("start", F.pmod(planned - F.weekday("start"), F.lit(7)).cast("int"))
    first = F.when(once & (F.size("days") > 0), t.first_class_day(F.col("start"), F.col("days")))
    return counted.withColumn("new_day", F.coalesce(on_plan, first, F.expr("date_add(start, since)"))).drop("days", "pairs", "since", "in_week")


def collisions(rows: DataFrame, no_class: DataFrame) -> DataFrame:
    """Class days that fall on a day without classes: one row for each week row and calendar entry.

    ``rows(course_id, row_no, week_number, target_term, day, days, one_a_week)``; a row of a course that meets once a week in
    the schedule stands for all its class days of that calendar week.
    """
    days = F.when(F.col("one_a_week"), t.class_dates(F.col("day"), F.col("days"))).otherwise(F.array("day"))
    each = rows.where("day is not null").select("course_id", "row_no", "week_number", "target_term", F.explode(days).alias("class_day"))
    entries = small(no_class.select(F.col("term").alias("target_term"), "label", F.coalesce("day", "date_start").alias("from_day"), F.coalesce("day", "date_end").alias("to_day")))
    hit = each.join(entries, "target_term").where("class_day between from_day and to_day")
    return hit.groupBy("course_id", "row_no", "week_number", "label").agg(F.min("class_day").alias("first_hit"))


def dst_weeks(weeks: DataFrame, courses: DataFrame) -> DataFrame:
    """Weeks with assignments within 14 days of the first Sunday of November, in markdown courses."""
    change = F.next_day(F.make_date(F.year("day"), F.lit(10), F.lit(31)), "SUN")
    rows = weeks.join(courses.where("source_format = 'markdown'").select("course_id"), "course_id").where("not is_break and day is not null and size(assignments) > 0")
    return rows.withColumn("change", change).where(F.abs(F.date_diff("day", "change")) <= 14).select("course_id", "row_no", "week_number", F.col("change").alias("clock_change"))


def past_end(rows: DataFrame) -> DataFrame:
    """P10: courses whose last class is after the term's end. ``rows(course_id, week_number, day, target_end)``."""
    last = rows.where("day is not null").groupBy("course_id").agg(F.max_by("week_number", F.struct("day", "week_number")).alias("week_number"), F.max("day").alias("last_day"), F.max("target_end").alias("target_end"))
    return last.where("last_day > target_end")


def move_breaks(weeks: DataFrame, courses: DataFrame, no_class: DataFrame) -> DataFrame:
    """Break rows in the new term: the earliest break with a matching name, else moved by the terms' distance.

    ``courses(course_id, target_term, old_start, week_one)``.
    """
    rows = weeks.where("is_break").select("course_id", "row_no", "label", "date_start", "date_end").join(courses.select("course_id", "target_term", "old_start", "week_one"), "course_id")
    entries = small(no_class.where("date_start is not null").select(F.col("term").alias("target_term"), F.col("label").alias("name"), F.col("date_start").alias("s"), F.col("date_end").alias("e")))
    pairs = rows.join(entries, "target_term", "left").withColumn("match", F.coalesce(t.labels_match(F.col("label"), F.col("name")), F.lit(False)))
    best = pairs.groupBy("course_id", "row_no").agg(
        F.min(F.when(F.col("match"), F.struct("s", "e", "name"))).alias("m"),
        *(F.first(c).alias(c) for c in ("label", "date_start", "date_end", "old_start", "week_one")),
    )
    offset = F.date_diff("week_one", "old_start")
    start, end = F.coalesce("m.s", F.date_add("date_start", offset)), F.coalesce("m.e", F.date_add("date_end", offset))
    return best.select("course_id", "row_no", start.alias("date_start"), end.alias("date_end"), t.break_label(F.coalesce("m.name", t.core_name(F.col("label"))), start, end).alias("label"), F.col("m").isNotNull().alias("matched"))


def overlapping_breaks(rows: DataFrame, no_class: DataFrame) -> DataFrame:
    """The breaks of the target term that overlap a course's weeks, first day to last day and six more."""
    ends = rows.where("day is not null").groupBy("course_id", "target_term").agg(F.min("day").alias("lo"), F.date_add(F.max("day"), 6).alias("hi"))
    entries = small(no_class.where("date_start is not null").select(F.col("term").alias("target_term"), "label", "date_start", "date_end"))
    return ends.join(entries, "target_term").where("date_start <= hi and date_end >= lo").select("course_id", "label", "date_start", "date_end")


def term_ends(rows: DataFrame) -> DataFrame:
    """Schedule order (class rows before break rows of the same day) and the last row's date of each course."""
    at = F.struct(F.coalesce("day", "date_start").alias("at"), "is_break", "row_no")
    return rows.groupBy("course_id").agg(F.max_by(F.coalesce("day", "date_end"), at).alias("schedule_end"), F.count("*").alias("rows"))


def break_slots(no_class: DataFrame) -> DataFrame:
    """How many weekly slots a term's breaks can take at most, wherever the first slot is."""
    spans = no_class.where("date_start is not null and date_end is not null")
    return spans.groupBy("term").agg(F.sum(F.floor(F.date_diff("date_end", "date_start") / 7) + 1).cast("int").alias("taken"))


def session_starts(terms: DataFrame, no_class: DataFrame, sessions: int = 3) -> DataFrame:
    """The (5 (k - 1) + 1)-th weekly slot from a term's start that isn't inside a break, for k = 1, 2, ..."""
    slots = terms.join(small(break_slots(no_class)), "term", "left").withColumn("last", F.coalesce("taken", F.lit(0)) + 5 * sessions)
    slots = slots.select("term", F.explode(F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.date_add("start_date", 7 * i))).alias("day"))
    spans = small(no_class.where("date_start is not null").select("term", "date_start", "date_end"))
    free = slots.join(spans, (slots.term == spans.term) & F.col("day").between(F.col("date_start"), F.col("date_end")), "left_anti")
    nth = free.withColumn("nth", F.row_number().over(Window.partitionBy("term").orderBy("day")))
    return nth.where(((F.col("nth") - 1) % 5 == 0) & (F.col("nth") <= 5 * sessions)).select("term", ((F.col("nth") - 1) / 5 + 1).cast("int").alias("session"), F.col("day").alias("session_start"))


def date_undated(courses: DataFrame, weeks: DataFrame, no_class: DataFrame) -> DataFrame:
    """The n-th week row of a schedule without dates takes the n-th weekly slot from Week 1 that isn't inside a break.

    ``courses(course_id, target_term, week_one)``. A course has as many slots as rows and slots that breaks can take, so
    none of its rows is lost, however many there are.
    """
    rows = weeks.where("not is_break").select("course_id", "row_no", "week_number", F.row_number().over(Window.partitionBy("course_id").orderBy("row_no")).alias("nth"))
    asked = courses.where("week_one is not null").join(rows.groupBy("course_id").agg(F.max("nth").alias("n")), "course_id")
    asked = asked.join(small(break_slots(no_class).withColumnRenamed("term", "target_term")), "target_term", "left")
    slots = asked.select("course_id", "target_term", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") + F.coalesce("taken", F.lit(0))), lambda i: F.date_add("week_one", 7 * i))).alias("day"))
    spans = small(no_class.where("date_start is not null").select(F.col("term").alias("span_term"), "date_start", "date_end"))
    free = slots.join(spans, (F.col("target_term") == F.col("span_term")) & F.col("day").between(F.col("date_start"), F.col("date_end")), "left_anti")
    nth = free.withColumn("nth", F.row_number().over(Window.partitionBy("course_id").orderBy("day"))).select("course_id", "nth", "day")
    return rows.join(nth, ["course_id", "nth"]).select("course_id", "row_no", "week_number", "day")


def undated_breaks(dated: DataFrame, courses: DataFrame, no_class: DataFrame) -> DataFrame:
    """A row for each break that a weekly slot fell in before the last week; ``dated`` from ``date_undated``."""
    spans = small(no_class.where("date_start is not null").select(F.col("term").alias("target_term"), "label", "date_start", "date_end"))
    last = dated.groupBy("course_id").agg(F.max("day").alias("last"))
    near = last.join(courses.select("course_id", "target_term", "week_one"), "course_id").join(spans, "target_term")
    # the first slot on or after the break's start, a whole number of weeks from Week 1
    ahead = F.greatest(F.ceil(F.date_diff("date_start", "week_one") / 7), F.lit(0)).cast("int")
    slot = F.date_add("week_one", 7 * ahead)
    return near.where(slot.between(F.col("date_start"), F.col("date_end")) & (slot < F.col("last"))).select("course_id", "date_start", "date_end", t.break_label(F.col("label"), F.col("date_start"), F.col("date_end")).alias("label"))


SESSION_WEEKS, SESSIONS = 5, 3
#: A semester's spans of sessions, the whole first; a summer's lengths in weeks, the full one first.
SPANS = ((1, 3), (1, 2), (2, 3), (1, 1), (2, 2), (3, 3))
SUMMER_WEEKS = (12, 10)


def span_label(first: Column, last: Column, weeks: Column) -> Column:
    """how a span is called; summer lengths have no sessions."""
    long = F.concat(F.lit(" ("), weeks.cast("string"), F.lit(" weeks)"))
    summer = F.when(weeks == max(SUMMER_WEEKS), F.concat(F.lit("Full summer term"), long)).otherwise(F.concat(weeks.cast("string"), F.lit(" weeks")))
    some = F.when(first == last, F.concat(F.lit("Session "), first.cast("string"))).otherwise(F.concat(F.lit("Sessions "), first.cast("string"), F.lit("–"), last.cast("string")))
    return F.when(first.isNull(), summer).when((first == 1) & (last == SESSIONS), F.lit(f"Full term (Sessions 1–{SESSIONS})")).otherwise(F.concat(some, long))


def session_code(text: Column) -> Column:
    """the span that a text names ("2", "1–3"), as first and last session; null for any other text."""
    plain = F.replace(F.trim(text), F.lit("–"), F.lit("-"))
    known = F.create_map(*[x for a, b in SPANS for x in (F.lit(f"{a}" if a == b else f"{a}-{b}"), F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")))])
    return F.try_element_at(known, plain)


def available_spans(terms: DataFrame, no_class: DataFrame) -> DataFrame:
    """the spans that each term of the calendar offers, in order: (term, place, code, label, weeks, week_one).

    In summer the two lengths from the term's first day. Else the whole term, and every span all of whose sessions fit: a
    session fits if its last class week begins no later than the term ends.
    """
    spans = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(a).alias("first"), F.lit(b).alias("last")) for i, (a, b) in enumerate(SPANS)))
    starts = session_starts(terms, no_class, SESSIONS)
    ends = small(terms.select("term", "end_date", (F.coalesce(t.season(F.col("term")), F.lit("")) == "Summer").alias("summer"), "start_date"))
    fits = starts.join(ends, "term").where("not summer").withColumn("fits", F.date_add("session_start", 7 * (SESSION_WEEKS - 1)) <= F.col("end_date"))
    each = fits.select("term", "session", "session_start", "fits", F.explode(spans).alias("s")).select("term", "session", "session_start", "fits", "s.*").where("session between first and last")
    held = each.groupBy("term", "place", "first", "last").agg(F.bool_and("fits").alias("fit"), F.min("session_start").alias("week_one")).where(F.col("fit") | (F.col("place") == 0))
    weeks = (SESSION_WEEKS * (F.col("last") - F.col("first") + 1)).cast("int")
    code = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    regular = held.select("term", "place", code.alias("code"), span_label(F.col("first"), F.col("last"), weeks).alias("label"), weeks.alias("weeks"), "week_one")
    lengths = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(n).alias("weeks")) for i, n in enumerate(SUMMER_WEEKS)))
    none = F.lit(None).cast("int")
    summer = ends.where("summer").select("term", "start_date", F.explode(lengths).alias("s"))
    return regular.unionByName(summer.select("term", "s.place", F.concat("s.weeks", F.lit(" weeks")).alias("code"), span_label(none, none, F.col("s.weeks")).alias("label"), "s.weeks", F.col("start_date").alias("week_one")))


def settled_span(courses: DataFrame, terms: DataFrame, no_class: DataFrame) -> DataFrame:
    """the span that a course takes in its term: the likely one if the term offers it, else the whole term, with its first
    day and the weeks that the course then has (its own in a whole term). ``courses(course_id, target_term, week_count,
    credits)``; courses whose term isn't in the calendar are left out."""
    guess = guess_session(courses.withColumnRenamed("target_term", "term")).select("course_id", F.col("session").alias("guess"))
    # the calendar's few spans, its whole term beside each
    offered = available_spans(terms, no_class)
    wholes = offered.where("place = 0").select(F.col("term").alias("target_term"), F.struct("code", "label", "weeks", "week_one").alias("whole"))
    some = offered.select(F.col("term").alias("target_term"), F.col("code").alias("guess"), F.struct("code", "label", "weeks", "week_one").alias("span"))
    joined = courses.join(guess, "course_id").join(small(wholes), "target_term").join(small(some), ["target_term", "guess"], "left").withColumn("taken", F.coalesce("span", "whole"))
    own = F.col("taken.code") == f"1-{SESSIONS}"
    return joined.select("course_id", "target_term", "guess", F.col("taken.code").alias("session"), F.col("taken.label").alias("label"), F.when(own, F.col("week_count")).otherwise(F.col("taken.weeks")).alias("weeks"), F.col("taken.week_one").alias("week_one"))


def default_plan(courses: DataFrame, weeks: DataFrame, terms: DataFrame) -> DataFrame:
    """what a rollover would take if nobody chose: the suggested term, the likely span, and the class days: those of the
    meeting pattern, else those of the schedule, else the usual weekday. ``courses(course_id, term, duration_weeks, credits,
    meeting_pattern)``; ``settled_span`` checks the span against the term."""
    listed = F.nullif(t.meeting_days(F.col("meeting_pattern")), F.array().cast("array<int>"))
    span = guess_session(courses.withColumnRenamed("duration_weeks", "week_count"))
    joined = courses.join(next_terms(terms, courses).select("course_id", "suggested_term"), "course_id").join(span, "course_id")
    joined = joined.join(usual_weekdays(weeks), "course_id", "left").join(usual_row_weekday(weeks), "course_id", "left")
    days = F.coalesce(listed, F.nullif("schedule_days", F.array().cast("array<int>")), F.when(F.col("usual_day").isNotNull(), F.array("usual_day")), F.array().cast("array<int>"))
    return joined.select("course_id", "suggested_term", "session", "weeks", days.alias("days"))


def named_dates(dates: DataFrame, courses: DataFrame, no_class: DataFrame) -> DataFrame:
    """Each university date with the target term's break (spans, by matching name) and holiday (by whole name) that
    it names, and whether its name is a holiday of any term. One row a date; the calendar's few rows are broadcast."""
    entries = no_class.select(F.col("term").alias("target_term"), "pos", "label", "day", "date_start", "date_end", t.holiday_key(F.col("label")).alias("key"))
    breaks = small(entries.where("date_start is not null").select(F.col("target_term").alias("break_term"), F.struct(F.col("pos").alias("at"), F.col("date_start").alias("s"), F.col("date_end").alias("e"), "label").alias("break")))
    holidays = small(entries.where("day is not null").groupBy("target_term", "key").agg(F.min(F.struct(F.col("pos").alias("at"), F.col("day").alias("on"), "label")).alias("holiday")))
    known = small(entries.where("day is not null").select("key", F.lit(True).alias("is_holiday")).distinct())
    keyed = dates.join(courses, "course_id").withColumn("key", t.holiday_key(F.col("event"))).join(holidays, ["target_term", "key"], "left").join(known, "key", "left")
    paired = keyed.join(breaks, (F.col("target_term") == F.col("break_term")) & F.col("date_start").isNotNull() & t.labels_match(F.col("event"), F.col("break.label")), "left")
    kept = ("event", "day", "date_start", "date_end", "target_term", "old_start", "week_one", "target_end", "season_change", "holiday")
    return paired.groupBy("course_id", "pos").agg(F.min("break").alias("break"), F.first(F.coalesce("is_holiday", F.lit(False))).alias("is_holiday"), *(F.first(c).alias(c) for c in kept))


def unused_entries(named: DataFrame, courses: DataFrame, no_class: DataFrame) -> DataFrame:
    """Breaks and holidays of the target term that no university date of a course names, numbered by kind in the calendar's
    order; courses that change season only."""
    kind = F.when(F.col("date_start").isNotNull(), "break").otherwise("holiday")
    entries = small(no_class.select(F.col("term").alias("target_term"), kind.alias("kind"), F.col("pos").alias("at"), F.col("label").alias("new_event"), F.coalesce("day", "date_start").alias("from_day"), "date_end"))
    due = courses.where("season_change").select("course_id", "target_term").join(entries, "target_term")
    used = named.select("course_id", F.explode(F.array(F.struct(F.lit("break").alias("kind"), F.col("break.at").alias("at")), F.struct(F.lit("holiday").alias("kind"), F.col("holiday.at").alias("at")))).alias("u")).select("course_id", "u.*").where("at is not null").distinct()
    free = due.join(used, ["course_id", "kind", "at"], "left_anti")
    return free.select("course_id", "kind", "new_event", "from_day", "date_end", F.row_number().over(Window.partitionBy("course_id", "kind").orderBy("at")).alias("nth"))


def roll_university_dates(dates: DataFrame, courses: DataFrame, no_class: DataFrame) -> DataFrame:
    """Begin and end rows take the term's dates, spans the break they name, holidays their own date. On a season change the
    n-th span without a break takes the n-th break that is left, and the n-th holiday without a date the n-th holiday that is
    left, with its name. All others move by the terms' distance, on a season change with the flag ``unmatched``. Rows and
    their order never change; ``no_class`` is the whole calendar, breaks that the class meets through included.

    ``courses(course_id, target_term, old_start, week_one, target_end, season_change)``; without the last, none changes season.
    """
    if "season_change" not in courses.columns:
        courses = courses.withColumn("season_change", F.lit(False))
    named = settled(named_dates(dates, courses, no_class))
    offset = F.date_diff("week_one", "old_start")
    begins, ends = F.rlike("event", F.lit(r"(?i)\bbegin")), F.rlike("event", F.lit(r"(?i)\bend"))
    rule = F.when(begins, "begin").when(ends, "end").when(F.col("break").isNotNull(), "break").when(F.col("holiday").isNotNull() & F.col("day").isNotNull(), "holiday").otherwise("moved")
    open_kind = F.when(F.col("season_change") & (F.col("rule") == "moved"), F.when(F.col("date_start").isNotNull(), "break").when(F.col("day").isNotNull() & F.col("is_holiday"), "holiday"))
    ruled = named.withColumn("rule", rule).withColumn("kind", open_kind)
    ruled = ruled.withColumn("nth", F.row_number().over(Window.partitionBy("course_id", "kind").orderBy("pos")))
    left = unused_entries(named, courses, no_class).withColumnRenamed("date_end", "new_end")
    full = ruled.join(left, ["course_id", "kind", "nth"], "left").withColumn("rule", F.when(F.col("new_event").isNotNull(), F.concat(F.lit("next_"), "kind")).otherwise(F.col("rule")))
    is_rule = lambda name: F.col("rule") == name
    day = F.when(is_rule("begin"), F.col("week_one")).when(is_rule("end"), F.coalesce("target_end", F.date_add("day", offset))).when(is_rule("holiday"), F.col("holiday.on")).when(is_rule("next_holiday"), F.col("from_day")).when(is_rule("moved"), F.date_add("day", offset))
    start = F.when(is_rule("break"), F.col("break.s")).when(is_rule("next_break"), F.col("from_day")).when(is_rule("moved"), F.date_add("date_start", offset))
    end = F.when(is_rule("break"), F.col("break.e")).when(is_rule("next_break"), F.col("new_end")).when(is_rule("moved"), F.date_add("date_end", offset))
    return full.select("course_id", "pos", F.coalesce("new_event", "event").alias("event"), "rule", day.alias("day"), start.alias("date_start"), end.alias("date_end"), F.when(is_rule("moved") & F.col("season_change"), "unmatched").alias("flag"))


def missing_holidays(dates: DataFrame, courses: DataFrame, no_class: DataFrame) -> DataFrame:
    """Holidays of a new season that a course's dates don't show once its own holidays have taken theirs over; only for
    courses whose dates had a holiday at all. ``courses`` as for ``roll_university_dates``."""
    named = named_dates(dates, courses, no_class)
    plain = ~F.rlike("event", F.lit(r"(?i)\b(?:begin|end)"))
    taken = plain & F.col("is_holiday") & F.col("holiday").isNull() & F.col("day").isNotNull() & F.col("date_start").isNull()
    had = named.groupBy("course_id").agg(F.bool_or("is_holiday").alias("had"), F.count_if(taken).alias("taken")).where("had")
    left = unused_entries(named, courses, no_class).where("kind = 'holiday'").join(had, "course_id").where("nth > taken")
    return left.select("course_id", (F.col("nth") - F.col("taken")).cast("int").alias("nth"), F.col("new_event").alias("label"), F.col("from_day").alias("day"))


def plan(courses: DataFrame, terms: DataFrame, no_class: DataFrame) -> DataFrame:
    """One row a course with all that a rollover needs (F17): target dates, meeting days, breaks."""
    old = small(terms.select("term", F.col("start_date").alias("old_start")))
    found = look_up_target(dealt(courses, "course_id"), terms).join(old, "term", "left").withColumn("days", t.meeting_days(F.col("meeting_pattern")))
    return found.join(small(spans_of(no_class)), "target_term", "left").withColumn("season_change", t.season_change(F.col("term"), F.col("target_term")))


def roll_over(courses: DataFrame, weeks: DataFrame, terms: DataFrame, no_class: DataFrame) -> DataFrame:
    """Every course's schedule in its target term, with flags; courses without a Week 1 are left to ``look_up_target``.

    Weeks step over breaks unless a numbered week is itself a break; break rows follow by name or, on a season change, are
    the breaks that overlap the new weeks. Flags are codes, joined by commas: collision, numbered_break, clock_change.
    """
    info = settled(plan(courses, terms, no_class).where("error_code is null"))
    mentions = numbered_break(weeks)
    own_slot = mentions.select("course_id").distinct().withColumn("own_slot", F.lit(True))
    stepping = info.join(own_slot, "course_id", "left").withColumn("breaks", F.when(F.col("own_slot").isNull(), F.col("breaks")))
    starts = plan_week_starts(stepping.select("course_id", "week_one", "days", "breaks"), weeks)
    moved = new_days(weeks, starts, info).join(info.select("course_id", "target_term", "target_end"), "course_id")
    regular = settled(moved.select("course_id", "row_no", "week_number", "label", "is_break", F.col("day").alias("old_day"), F.col("new_day").alias("day"), F.lit(None).cast("date").alias("date_end"), "assignments", "target_term"))
    per_week = Window.partitionBy("course_id", "week_number")
    checked = regular.join(info.select("course_id", "days"), "course_id").withColumn("one_a_week", F.count("*").over(per_week) == 1)
    flags = (
        collisions(checked, no_class).select("course_id", "row_no", F.concat(F.lit("collision:"), "label").alias("flag"))
        .unionByName(mentions.select("course_id", "row_no", F.lit("numbered_break").alias("flag")))
        .unionByName(dst_weeks(regular, courses).select("course_id", "row_no", F.lit("clock_change").alias("flag")))
    )
    joined_flags = flags.groupBy("course_id", "row_no").agg(F.array_join(F.array_sort(F.collect_set("flag")), ",").alias("flags"))
    same = info.where("not season_change")
    kept = move_breaks(weeks.join(same.select("course_id"), "course_id", "left_semi"), same, no_class)
    had = weeks.where("is_break").select("course_id").distinct()
    changed = info.where("season_change").join(had, "course_id", "left_semi")
    fresh = overlapping_breaks(regular.join(changed.select("course_id"), "course_id", "left_semi"), no_class)
    fresh = fresh.withColumn("row_no", 1000 + F.row_number().over(Window.partitionBy("course_id").orderBy("date_start")))
    breaks = kept.select("course_id", "row_no", "label", "date_start", "date_end").unionByName(fresh.select("course_id", "row_no", t.break_label(F.col("label"), F.col("date_start"), F.col("date_end")).alias("label"), "date_start", "date_end"))
    rows = regular.drop("assignments", "target_term").unionByName(breaks.select("course_id", "row_no", F.lit(None).cast("int").alias("week_number"), "label", F.lit(True).alias("is_break"), F.lit(None).cast("date").alias("old_day"), F.col("date_start").alias("day"), "date_end"))
    return rows.join(joined_flags, ["course_id", "row_no"], "left").select("course_id", "row_no", "week_number", "label", "is_break", "old_day", F.col("day").alias("new_day"), F.col("date_end").alias("new_end"), F.coalesce("flags", F.lit("")).alias("flags"))


def rollover_events(rolled: DataFrame, courses: DataFrame, weeks: DataFrame) -> DataFrame:
    """One ``rollover`` event a course that was moved, for the log; ``rolled`` from ``roll_over``."""
    flags = F.when(F.col("flags") == "", 0).otherwise(F.size(F.split("flags", ",")))
    after = rolled.groupBy("course_id").agg(F.count_distinct("week_number").alias("target_weeks"), F.sum(flags).alias("flag_count"))
    before = week_counts(weeks).withColumnRenamed("week_count", "source_weeks")
    joined = after.join(courses.select("course_id", F.col("term").alias("source_term"), "target_term"), "course_id").join(before, "course_id")
    return joined.select("course_id", F.lit("rollover").alias("event_type"), "source_term", "target_term", "source_weeks", "target_weeks", "flag_count")


def not_observed(weeks: DataFrame, courses: DataFrame, through: DataFrame) -> DataFrame:
    """Break rows that name a break the class meets through; ``through(course_id, name)``. The rest stays."""
    rows = weeks.where("is_break").join(courses.select("course_id"), "course_id", "left_semi")
    hit = rows.join(through, "course_id").where(t.labels_match(F.col("label"), F.col("name")))
    return hit.select("course_id", "row_no", t.core_name(F.col("label")).alias("dropped")).dropDuplicates(["course_id", "row_no"])


def added_break_rows(skipped: DataFrame, shown: DataFrame) -> DataFrame:
    """A row for each break stepped over that the schedule doesn't show yet; both ``(course_id, label, date_start, date_end)``."""
    span = ["course_id", "date_start", "date_end"]
    return skipped.join(shown.select(*span).distinct(), span, "left_anti").groupBy(*span).agg(F.min("label").alias("label")).select("course_id", "date_start", "date_end", t.break_label(F.col("label"), F.col("date_start"), F.col("date_end")).alias("label"))


def unnamed_entries(courses: DataFrame, dates: DataFrame, no_class: DataFrame) -> DataFrame:
    """Calendar entries of the target term that no row of a course's dates names, by core name."""
    entries = small(no_class.select(F.col("term").alias("target_term"), "label", F.lower(t.core_name(F.col("label"))).alias("core")))
    due = courses.join(entries, "target_term").select("course_id", "label", "core")
    named = dates.select("course_id", F.lower(t.core_name(F.col("event"))).alias("core")).distinct()
    return due.join(named, ["course_id", "core"], "left_anti").select("course_id", "label")


def guess_session(courses: DataFrame) -> DataFrame:
    """a likely span from weeks and credits; ``courses(course_id, term, week_count, credits)``. Summer has 10 or 12 weeks."""
    summer = t.season(F.col("term")) == "Summer"
    one = (F.coalesce("credits", F.lit(3.0)) < 2) | (F.col("week_count") == 5)
    code = F.when(summer, F.when(F.col("week_count") <= 10, "10 weeks").otherwise("12 weeks")).when(one, "1").when(F.col("week_count") == 10, "1-2").otherwise("1-3")
    weeks = F.when(summer, F.when(F.col("week_count") <= 10, 10).otherwise(12)).when(one, 5).when(F.col("week_count") == 10, 10).otherwise(F.col("week_count"))
    return courses.select("course_id", code.alias("session"), weeks.cast("int").alias("weeks"))
