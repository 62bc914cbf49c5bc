"""Review and clean-up of drafts, slide decks, and schedules in several tables. Set-based per draft."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Our own short vocabulary of what a draft may demand.
ARTEFACTS = {"report": "report", "diagram": "diagram", "presentation": "presentation|slides", "pdf": "pdf", "screenshot": "screenshot"}
DEMAND = r"(?i)\b(?:must|required?|submit|upload|hand in|turn in|attach|prepare|write|create)\b"
OPTIONAL = r"(?i)\b(?:may|could|optional(?:ly)?|for example)\b"
NEGATED = r"(?i)\b(?:do not|don't|without|not required|avoid)\b"
HAND_IN = r"(?i)\b(?:submit|submission|upload|turn in|hand in)\b"
PLACE = r"(?i)\b(?:canvas|dropbox|moodle|blackboard|portal|folder|platform|website|email)\b"
MISSING_NOTE = r"(?i)\b(?:not (?:provided|specified)|unspecified)\b"
HEADING = r"^#{1,6}[ \t]+\S"
# Words that may stand around "submission" in the heading of a section that is about nothing else.
AROUND = ("assignment", "instructions", "for", "guidelines", "details", "information", "method")
EVALUATION = r"(?i)^#{1,6}\s+(?:evaluation|grading|scoring|rubric)"
SHORTEST = 120


def sentences(table: DataFrame, key: str, text: str = "text") -> DataFrame:
    return table.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+")).alias("pos", "sentence")).where("sentence <> ''")


def has(column: str, pattern: str) -> Column:
    return F.rlike(column, F.lit(pattern))


def is_submission(column: str) -> Column:
    """Whether a line is the heading of a section on handing in: nothing but "submission" and words around it."""
    words = F.filter(F.split(F.lower(F.trim(F.ltrim(column, F.lit("#")))), r"\s+"), lambda w: ~w.isin(*AROUND))
    return has(column, HEADING) & (words == F.array(F.lit("submission")))


def permissions(requests: DataFrame) -> DataFrame:
    """What a request's own sentences ask for; a sentence that forbids something doesn't ask for it."""
    asks = ~has("sentence", NEGATED)
    return sentences(requests, "request_id").groupBy("request_id").agg(
        F.bool_or(asks & has("sentence", HAND_IN)).alias("may_hand_in"),
        *(F.bool_or(asks & has("sentence", rf"(?i)\b(?:{p})s?\b")).alias(f"may_{a}") for a, p in ARTEFACTS.items()),
    )


def review(drafts: DataFrame, requests: DataFrame) -> DataFrame:
    """Issue codes of each draft in a fixed order; ``drafts(draft_id, request_id, text)``, ``requests(request_id, text)``."""
    lines = sentences(drafts, "draft_id")
    demanded = has("sentence", DEMAND) & ~has("sentence", OPTIONAL) & ~has("sentence", NEGATED)
    seen = lines.groupBy("draft_id").agg(
        F.bool_or(has("sentence", HAND_IN) & has("sentence", PLACE)).alias("logistics"),
        F.bool_or(is_submission("sentence")).alias("submission_section"),
        F.bool_or(has("sentence", EVALUATION)).alias("evaluation_section"),
        F.bool_or(has("sentence", MISSING_NOTE)).alias("missing_note"),
        *(F.bool_or(demanded & has("sentence", rf"(?i)\b(?:{p})s?\b")).alias(f"needs_{a}") for a, p in ARTEFACTS.items()),
    )
    joined = drafts.select("draft_id", "request_id").join(seen, "draft_id", "left").join(permissions(requests), "request_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    free = ~yes("may_hand_in")
    codes = [F.when(free & yes("logistics"), "submission_logistics"), F.when(free & yes("submission_section"), "submission_section"), F.when(yes("evaluation_section"), "evaluation_section"), F.when(yes("missing_note"), "missing_information_note")]
    codes += [F.when(yes(f"needs_{a}") & ~yes(f"may_{a}"), f"unasked_{a}") for a in ARTEFACTS]
    issues = F.array_compact(F.array(*codes))
    return joined.select("draft_id", F.array_join(issues, ",").alias("issues"), F.size(issues).alias("n_issues"))


def clean_up(drafts: DataFrame, requests: DataFrame) -> DataFrame:
    """Drafts without submission sections, logistics lines and notes on missing information, where handing in wasn't
    asked for; runs of blank lines become one. A section ends at the next heading (the last heading above a line decides)."""
    rows = drafts.select("draft_id", "request_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "text")).join(permissions(requests).select("request_id", "may_hand_in"), "request_id", "left")
    above = Window.partitionBy("draft_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(has("text", HEADING), is_submission("text")), ignorenulls=True).over(above)
    free = ~F.coalesce("may_hand_in", F.lit(False))
    gone = free & (F.coalesce(section, F.lit(False)) | (has("text", HAND_IN) & has("text", PLACE))) | has("text", MISSING_NOTE)
    kept = rows.withColumn("gone", gone).groupBy("draft_id").agg(F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("line_no", "text")))).alias("l"), F.count_if("gone").alias("removed_lines"))
    text = F.array_join(F.transform("l", lambda x: x["text"]), "\n")
    return kept.select("draft_id", F.trim(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")).alias("text"), "removed_lines")


def choose_revision(pairs: DataFrame) -> DataFrame:
    """The revised draft only if it is long enough, names the assignment and has fewer issues.

    ``pairs(draft_id, name, text, n_issues, revised_text, revised_issues)``.
    """
    better = (F.length(F.trim(F.coalesce("revised_text", F.lit("")))) > SHORTEST) & F.contains(F.lower("revised_text"), F.lower("name")) & (F.col("revised_issues") < F.col("n_issues"))
    use = F.coalesce(better, F.lit(False))
    return pairs.select("draft_id", use.alias("revised"), F.when(use, F.col("revised_text")).otherwise(F.col("text")).alias("text"))


def number_slides(decks: DataFrame, banner: str = "AI draft") -> DataFrame:
    """Decks whose slides are numbered: old slide comments dropped, first-level headings made second-level, a comment with
    the running number before each, and a title in the front matter. ``decks(deck_id, title, text)``."""
    body = F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), r"(?s)\A---\n(.*?)\n---\n?", "")
    front = F.regexp_extract(F.trim(F.coalesce("text", F.lit(""))), r"(?s)\A---\n(.*?)\n---", 1)
    rows = decks.select("deck_id", "title", front.alias("front"), F.posexplode(F.split(body, "\n")).alias("line_no", "text")).where(~has("text", r"(?i)^\s*<!--\s*slide\s+[0-9]+"))
    rows = rows.withColumn("text", F.when(has("text", r"^#\s+\S"), F.concat(F.lit("#"), F.col("text"))).otherwise(F.col("text"))).withColumn("is_title", has("text", r"^## "))
    above = Window.partitionBy("deck_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("slide", F.sum(F.col("is_title").cast("int")).over(above))
    shown = F.when(F.col("is_title"), F.concat(F.lit("\n<!-- Slide "), "slide", F.lit(" -->\n"), "text")).otherwise(F.col("text"))
    whole = rows.groupBy("deck_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", shown.alias("t")))), lambda x: x["t"]), "\n").alias("body"), F.max("slide").alias("slides"), F.first("front").alias("front"), F.first("title").alias("title"))
    lines = F.filter(F.split("front", "\n"), lambda x: (F.trim(x) != "") & ~F.rlike(x, F.lit("(?i)^subtitle:")))
    titled = F.when(F.exists(lines, lambda x: F.rlike(x, F.lit("(?i)^title:"))), lines).otherwise(F.concat(F.array(F.concat(F.lit('title: "'), "title", F.lit('"'))), lines))
    text = F.concat(F.lit("---\n"), F.array_join(titled, "\n"), F.lit(f"\n---\n\n<!-- {banner} -->\n\n"), F.regexp_replace(F.regexp_replace("body", r"\n{3,}", "\n\n"), r"^\n+|\n+$", ""), F.lit("\n"))
    return whole.select("deck_id", F.col("slides").cast("int").alias("slides"), text.alias("text"))


def schedule_tables(tables: DataFrame) -> DataFrame:
    """Which candidate tables are the schedule: one, or several whose weeks continue each other; else the choice is open.

    ``tables(doc_id, table_no, week_number)``: the week numbers of every candidate.
    """
    ends = tables.groupBy("doc_id", "table_no").agg(F.min("week_number").alias("lo"), F.max("week_number").alias("hi"))
    before = F.max("hi").over(Window.partitionBy("doc_id").orderBy("table_no").rowsBetween(Window.unboundedPreceding, -1))
    checked = ends.withColumn("continues", F.coalesce(F.col("lo") > before, F.lit(True)))
    status = F.when(F.count("*") == 1, "one").when(F.bool_and("continues"), "continued").otherwise("ambiguous")
    return checked.groupBy("doc_id").agg(F.count("*").alias("tables"), status.alias("status"))
