"""Flags, overrides and edits of a rollover, before an instructor signs it."""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import terms as t
from loomwork.sources.files import dealt, small


EVALUATIONS = 500_000  # rows that one task gathers by submission
TOKEN = re.compile(r"\s+|\S+")


def schedule_choices(courses: DataFrame, dropped: DataFrame) -> DataFrame:
    """Breaks that a class meets through, by name, and meeting days that differ from those listed, where both are known.

    ``courses(course_id, picked_days, listed_days)``, ``dropped(course_id, name)``.
    """
    names = dropped.groupBy("course_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    days = lambda c: F.array_join(F.transform(F.array_sort(c), lambda d: d.cast("string")), "")
    changed = (F.size("picked_days") > 0) & (F.size("listed_days") > 0) & (days("picked_days") != days("listed_days"))
    return courses.join(names, "course_id", "left").select("course_id", F.coalesce("names", F.lit("")).alias("meets_through"), changed.alias("days_changed"))


def preview(rows: DataFrame) -> DataFrame:
    """What a row was and will be: its name, old date or "new", new date, flags or "OK"."""
    name = F.when(F.col("is_break"), t.core_name(F.col("label"))).otherwise(F.concat(F.lit("Week "), F.coalesce(F.col("week_number").cast("string"), F.lit("?"))))
    show = lambda c: F.date_format(c, "MMM d, yyyy")
    return rows.select("course_id", "row_no", name.alias("name"), F.coalesce(show("old_day"), F.lit("new")).alias("was"), show("new_day").alias("becomes"), F.when(F.coalesce("flags", F.lit("")) == "", "OK").otherwise(F.col("flags")).alias("status"))


def override(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """An instructor's own dates, class rows only; the schedule is sorted again. ``chosen(course_id, row_no, own_day)``."""
    joined = rows.join(chosen, ["course_id", "row_no"], "left")
    day = F.when(~F.col("is_break"), F.coalesce("own_day", "day")).otherwise(F.col("day"))
    moved = joined.withColumn("day", day).withColumn("overridden", F.col("own_day").isNotNull() & ~F.col("is_break")).drop("own_day")
    order = Window.partitionBy("course_id").orderBy("day", "is_break", "row_no")
    return moved.withColumn("place", F.row_number().over(order))


def override_errors(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Overrides that name no class row."""
    return chosen.join(rows.where("not is_break").select("course_id", "row_no"), ["course_id", "row_no"], "left_anti").groupBy("course_id").agg(F.count("*").alias("unknown_rows"))


def stale_holidays(lines: DataFrame, courses: DataFrame, no_class: DataFrame, most: int = 5) -> DataFrame:
    """Lines that name a holiday of the old term that the new term hasn't; both seasons known and different.

    ``lines(course_id, line_no, text)``, ``courses(course_id, term, target_term)``. One pattern a pair of terms is built from
    the calendar's few names, so each line is searched once. The first ``most`` distinct lines are the feature.
    """
    names = no_class.select("term", F.lower(t.core_name(F.col("label"))).alias("name")).distinct()
    pairs = courses.select("term", "target_term").distinct().where(t.season_change(F.col("term"), F.col("target_term")))
    old = pairs.join(small(names), "term")
    new = names.select(F.col("term").alias("target_term"), "name")
    gone = old.join(small(new), ["target_term", "name"], "left_anti")
    patterns = gone.groupBy("term", "target_term").agg(F.concat(F.lit(r"(?i)\b(?:"), F.array_join(F.array_sort(F.collect_set(F.regexp_replace("name", r"([.()\[\]*+?])", r"\\$1"))), "|"), F.lit(r")\b")).alias("pattern"))
    asked = courses.join(small(patterns), ["term", "target_term"]).select("course_id", "pattern")
    hits = lines.join(asked, "course_id").where(F.expr("text rlike pattern")).groupBy("course_id", "text").agg(F.min("line_no").alias("line_no"))
    nth = F.row_number().over(Window.partitionBy("course_id").orderBy("line_no"))
    return hits.withColumn("nth", nth).where(F.col("nth") <= most).select("course_id", "nth", "line_no", "text")


def same_layout(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether week keys and breaks follow each other as before."""
    keys = lambda df, name: df.groupBy("course_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "week_number", "is_break"))), lambda x: F.struct(x["week_number"], x["is_break"])).alias(name))
    return keys(before, "b").join(keys(after, "a"), "course_id", "full_outer").select("course_id", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))


def apply_edits(courses: DataFrame, edits: DataFrame) -> DataFrame:
    """Reviewed details over extracted ones; blanks keep what was there; credits must look like a number or be blank."""
    kept = lambda new, old: F.coalesce(F.nullif(F.trim(new), F.lit("")), old)
    bad = F.coalesce(F.trim("new_credits") != "", F.lit(False)) & ~F.coalesce(F.rlike(F.trim("new_credits"), F.lit(r"^[0-9]+(?:\.[0-9]+)?$")), F.lit(False))
    joined = courses.join(edits, "course_id", "left")
    return joined.select("course_id", kept(F.col("new_title"), F.col("title")).alias("title"), F.when(~bad, F.nullif(F.trim("new_credits"), F.lit("")).cast("double")).alias("credits"), F.when(bad, "bad_credits").alias("error_code"))


def week_flags(flags: DataFrame) -> DataFrame:
    """Distinct flags of a course in the order of their first row, and how many there are in all."""
    firsts = flags.groupBy("course_id", "flag").agg(F.min("row_no").alias("first"), F.count("*").alias("n"))
    return firsts.groupBy("course_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "flag"))), lambda x: x["flag"]), ",").alias("flags"), F.sum("n").alias("flag_count"))


def evidence_scores(evaluations: DataFrame, parts: DataFrame) -> DataFrame:
    """A part that is met, with evidence, earns its points; all others nothing.

    ``evaluations(submission_id, pos, part, met, evidence)``, ``parts(pos, part, points)``.
    """
    counts = F.coalesce(F.col("met"), F.lit(False)) & (F.coalesce(F.size("evidence"), F.lit(0)) > 0)
    told = evaluations.select("submission_id", "pos", "part", counts.alias("counts"), (F.coalesce("met", F.lit(False)) & ~counts).alias("bare"))
    joined = dealt(told.join(small(parts), ["pos", "part"]), "submission_id", EVALUATIONS)
    return joined.groupBy("submission_id", "pos").agg(F.sum(F.when(F.col("counts"), F.col("points")).otherwise(0)).cast("double").alias("earned"), F.count_if("bare").alias("met_without_evidence"))


def source_errors(requests: DataFrame, sources: DataFrame, syllabus: str = "syllabus.md") -> DataFrame:
    """Requests without a source besides the syllabus, or with names that the project hasn't.

    ``requests(request_id, project_id, source_files)``, ``sources(project_id, filename)``.
    """
    named = requests.select("request_id", "project_id", F.explode_outer("source_files").alias("filename"))
    known = named.join(sources.select("project_id", "filename", F.lit(1).alias("known")).distinct(), ["project_id", "filename"], "left")
    real = F.col("filename").isNotNull() & (F.col("filename") != syllabus)
    out = known.groupBy("request_id").agg(F.count_if(real & (F.col("known") == 1)).alias("sources"), F.count_if(F.col("filename").isNotNull() & F.col("known").isNull()).alias("unknown"))
    return out.where("sources = 0 or unknown > 0").select("request_id", F.concat_ws(",", F.when(F.col("sources") == 0, "no_source"), F.when(F.col("unknown") > 0, "unknown_source")).alias("error_code"))


def changed_paragraphs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paragraphs whose text differs, with the words that were taken out and put in between their common ends.

    ``(doc_id, para_no, text)`` each; documents with another number of paragraphs are an error row.
    """
    both = before.withColumnRenamed("text", "old").join(after.withColumnRenamed("text", "new"), ["doc_id", "para_no"], "full_outer")
    torn = both.groupBy("doc_id").agg(F.bool_or(F.col("old").isNull() | F.col("new").isNull()).alias("torn")).where("torn").select("doc_id", F.lit("paragraph_count").alias("error_code"))
    diff = both.join(torn, "doc_id", "left").where("error_code is not null or old <> new")
    diff = diff.withColumns({"a": F.split("old", r"\s+"), "b": F.split("new", r"\s+")}).withColumn("n", F.least(F.size("a"), F.size("b")))

    def common(x: Column, y: Column) -> Column:
        """Length of the common beginning: up to the first pair that differs."""
        same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
        first = F.array_position(same, False)
        return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")

    diff = diff.withColumn("head", common(F.col("a"), F.col("b"))).withColumn("back", common(F.reverse("a"), F.reverse("b")))
    diff = diff.withColumn("tail", F.least("back", F.col("n") - F.col("head")))
    cut = lambda x: F.array_join(F.slice(x, F.col("head") + 1, F.greatest(F.size(x) - F.col("head") - F.col("tail"), F.lit(0))), " ")
    ok = F.col("error_code").isNull()
    return diff.select("doc_id", "para_no", F.when(ok, cut(F.col("a"))).alias("removed"), F.when(ok, cut(F.col("b"))).alias("added"), "error_code")


def tidy_tables(tables: DataFrame) -> DataFrame:
    """Rows of cells without dash placeholders and without empty rows; a table is real if a row names a week or most
    rows have two filled cells. ``tables(doc_id, item_no, row_no, cells)``."""
    clean = F.transform("cells", lambda c: F.when(F.rlike(F.trim(c), F.lit("^[-–—]+$")), "").otherwise(F.trim(c)))
    rows = tables.withColumn("cells", clean).withColumn("filled", F.size(F.filter(F.col("cells"), lambda c: c != ""))).where("filled > 0")
    is_week = F.rlike(F.element_at("cells", 1), F.lit(r"(?i)^week\s+[0-9]+"))
    return rows.groupBy("doc_id", "item_no").agg(F.count("*").alias("rows"), (F.bool_or(is_week) | (2 * F.count_if(F.col("filled") >= 2) > F.count("*"))).alias("is_real"))


CONTEXT, ABSORBED = 2, 2  # words in front of a change that tell its place; unchanged words that are folded into the changes around them
CHANGES = "array<struct<old:string,new:string,context:string>>"


def places_once(tokens: list[str]) -> dict[str, int] | None:
    """The place of each word; null where a word comes twice. Words and white space take turns."""
    first = int(bool(tokens) and tokens[0].isspace())
    words = tokens[first::2]
    places = dict(zip(words, range(first, len(tokens), 2)))
    return places if len(places) == len(words) else None


def runs_of(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """All longest runs of two equal tokens or more, as (place in a, place in b, length).

    They are runs of pairs of neighbours: a pair holds a word, so few pairs match, while every blank matches every other. Where
    no word comes twice, each has one place at most and equal stretches are compared whole.
    """
    runs: list[tuple[int, int, int]] = []
    places = places_once(b) if places_once(a) is not None else None
    if places is not None:
        i, end = 0, len(a)
        while i < end:
            j = places.get(a[i])
            if j is None:
                i += 1
                continue
            start, step = i, 1
            while step:  # ever longer stretches while they are equal, then shorter ones
                if i + step <= end and j + step <= len(b) and a[i : i + step] == b[j : j + step]:
                    i, j, step = i + step, j + step, 2 * step
                else:
                    step //= 2
            n = i - start
            if start and j > n and a[start - 1] == b[j - n - 1]:
                start, n = start - 1, n + 1
            if n > 1:
                runs.append((start, j - n, n))
        return runs
    pairs: dict[tuple[str, str], list[int]] = {}
    for j, pair in enumerate(zip(b, b[1:])):
        pairs.setdefault(pair, []).append(j)
    lengths: dict[int, int] = {}  # of the runs of pairs that end at a place in b
    for i, pair in enumerate(zip(a, a[1:])):
        found = {j: lengths.pop(j - 1, 0) + 1 for j in reversed(pairs.get(pair, ()))}
        runs += [(i - n, j - n + 1, n + 1) for j, n in lengths.items()]
        lengths = found
    return runs + [(len(a) - 1 - n, j - n + 1, n + 1) for j, n in lengths.items()]


def blocks_of(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """The matching blocks of ``difflib`` without junk, in order: the longest run, the first in a, then in b, counts, and what is
    in front of it and behind it is matched in the same way."""
    out = []
    at: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        at.setdefault(x, []).append(j)
    todo = [(0, len(a), 0, len(b), runs_of(a, b))]
    while todo:
        alo, ahi, blo, bhi, runs = todo.pop()
        inside = []
        for i, j, n in runs:
            cut = max(alo - i, blo - j, 0)
            i, j, n = i + cut, j + cut, min(n - cut, ahi - i - cut, bhi - j - cut)
            if n > 1:
                inside.append((i, j, n))
        if inside:
            i, j, n = min(inside, key=lambda r: (-r[2], r[0], r[1]))
        else:  # single tokens: the first of a that is in b at all
            for i in range(alo, ahi):
                listed = at.get(a[i], ())
                k = bisect.bisect_left(listed, blo)
                if k < len(listed) and listed[k] < bhi:
                    j, n = listed[k], 1
                    break
            else:
                continue
        out.append((i, j, n))
        if alo < i and blo < j:
            todo.append((alo, i, blo, j, inside))
        if i + n < ahi and j + n < bhi:
            todo.append((i + n, ahi, j + n, bhi, inside))
    return sorted(out)


def words_before(tokens: list[str], i: int) -> list[str]:
    """The CONTEXT words in front of a token."""
    words: list[str] = []
    while i > 0 and len(words) < CONTEXT:
        i -= 1
        if not tokens[i].isspace():
            words.append(tokens[i])
    return words[::-1]


def edits_of(old: str, new: str) -> list[dict]:
    """Changes between two texts, word by word: what to look for, what to put there, and the words in front of it.

    What is only put in takes the word before it along, so every change replaces something; changes with no more than ABSORBED
    words between them, or between the last one and the end, are one. Changes of white space alone are none.
    """
    a, b = TOKEN.findall(old), TOKEN.findall(new)
    # words and white space take turns
    few = lambda start, end: end - start <= 2 * ABSORBED + 1 and sum(not x.isspace() for x in a[start:end]) <= ABSORBED
    spans: list[tuple[int, int, int, int]] = []
    i = j = 0
    for i_next, j_next, n in [*blocks_of(a, b), (len(a), len(b), 0)]:
        i_end, j_end = i_next, j_next
        if i < i_end or j < j_end:
            only_put_in = i == i_end
            while only_put_in and i > 0:
                i, j = i - 1, j - 1
                if not a[i].isspace():
                    break
            if spans and few(spans[-1][1], i):
                i, j = spans[-1][0], spans.pop()[2]
            spans.append((i, i_end, j, j_end))
        i, j = i_next + n, j_next + n
    if spans and few(spans[-1][1], len(a)):
        i, _, j, _ = spans.pop()
        spans.append((i, len(a), j, len(b)))
    pieces = (("".join(a[i:i_end]).strip(), "".join(b[j:j_end]).strip(), words_before(a, i)) for i, i_end, j, j_end in spans)
    return [{"old": x, "new": y, "context": " ".join(before)} for x, y, before in pieces if x]


def word_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every change between two versions of documents: (doc_id, para_no, nth, old, new, context, error_code).

    ``(doc_id, para_no, text)`` each. Documents with another number of paragraphs give one error row; null texts are empty;
    paragraphs that are alike, or differ in white space alone, give none. Paragraphs are compared one by one, in Arrow batches.
    """
    key = ["doc_id", "para_no"]
    # places alone tell which documents are torn; texts meet once
    there = lambda df, name: df.select(*key, F.lit(True).alias(name))
    torn = there(before, "had").join(there(after, "has"), key, "full_outer").where("had is null or has is null").select("doc_id").distinct()

    @F.pandas_udf(CHANGES)
    def changes(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([edits_of(x, y) for x, y in zip(old, new)])

    both = before.select(*key, F.coalesce("text", F.lit("")).alias("old")).join(after.select(*key, F.coalesce("text", F.lit("")).alias("new")), key)
    differing = both.where("old <> new").join(torn, "doc_id", "left_anti")
    found = differing.select("doc_id", "para_no", F.posexplode(changes("old", "new")).alias("nth", "c")).select("doc_id", "para_no", "nth", "c.old", "c.new", "c.context", F.lit(None).cast("string").alias("error_code"))
    none = F.lit(None)
    errors = torn.select("doc_id", none.cast("int").alias("para_no"), none.cast("int").alias("nth"), *(none.cast("string").alias(c) for c in ("old", "new", "context")), F.lit("paragraph_count").alias("error_code"))
    return found.unionByName(errors)
