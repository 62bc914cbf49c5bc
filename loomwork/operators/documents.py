"""Jobs over document corpora: lines, tables, page margins, parts. All work is set-based per document."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE = 0.07  # share of a page's height that counts as margin


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, text); a null text has no lines."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


BAR = r"^\s*\|.*\|\s*$"  # a table's line


def cells_of(text: Column) -> Column:
    """The cells of a table's line."""
    return F.transform(F.split(F.regexp_replace(text, r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))


def table_lines(rows: DataFrame) -> DataFrame:
    """Every line with its place in a table: ``table_no``, ``row_no`` and ``head``, the table's first header cell in lower
    case; nulls for separator rows and lines outside tables.

    A table is a run of neighbouring lines that start and end with a bar. One sort a document, no line is read twice.
    """
    by_line = Window.partitionBy("doc_id").orderBy("line_no")
    so_far = by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_bar = F.coalesce(F.rlike("text", F.lit(BAR)), F.lit(False))
    separator = F.contains("text", F.lit("---")) & F.forall(cells_of(F.col("text")), lambda c: F.rlike(c, F.lit("^:?-{3,}:?$")))
    told = rows.withColumn("is_bar", is_bar).withColumn("is_row", F.col("is_bar") & ~separator)
    told = told.withColumns({"before": F.lag(F.when(F.col("is_bar"), F.col("line_no"))).over(by_line), "nth": F.count_if("is_row").over(so_far)})
    told = told.withColumn("starts", F.col("is_bar") & F.coalesce(F.col("before") != F.col("line_no") - 1, F.lit(True)))
    told = told.withColumns({"table_no": F.count_if("starts").over(so_far), "skip": F.last(F.when(F.col("starts"), F.col("nth") - F.col("is_row").cast("int")), True).over(so_far)})
    told = told.withColumns({c: F.when(F.col("is_row"), v.cast("int")) for c, v in (("table_no", F.col("table_no")), ("row_no", F.col("nth") - F.col("skip")))})
    head = F.last(F.when(F.col("row_no") == 1, F.lower(F.element_at(cells_of(F.col("text")), 1))), True).over(so_far)
    told = told.withColumn("head", head)
    return told.select(*rows.columns, "table_no", "row_no", F.when(F.col("is_row"), F.col("head")).alias("head"))


def table_rows(rows: DataFrame) -> DataFrame:
    """Rows of tables by table and row, separator rows dropped, cells split."""
    kept = table_lines(rows.where(F.rlike("text", F.lit(BAR)))).where("row_no is not null")
    return kept.select("doc_id", "table_no", "row_no", "line_no", cells_of(F.col("text")).alias("cells"))


def first_mentions(rows: DataFrame, pattern: str, most: int = 5, width: int = 120) -> DataFrame:
    """The first distinct lines of each document that match, cut to ``width``. The number is the feature."""
    hits = rows.where(F.rlike("text", F.lit(pattern))).groupBy("doc_id", "text").agg(F.min("line_no").alias("line_no"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    return hits.withColumn("nth", nth).where(F.col("nth") <= most).select("doc_id", "nth", "line_no", F.substring("text", 1, width).alias("text"))


def replace_details(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Every exact repeat of each document's old text replaced, in the order of the changes; changed lines only.

    ``changes(doc_id, pos, old, new)``: a few a document. A blank new text becomes TBA.
    """
    listed = changes.where("old <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "old", F.when(F.trim("new") == "", "TBA").otherwise(F.col("new")).alias("new")))).alias("c"))
    new = F.aggregate("c", F.col("text"), lambda s, x: F.replace(s, x["old"], x["new"]))
    return rows.join(listed, "doc_id").withColumn("new_text", new).where("new_text <> text").select("doc_id", "line_no", "new_text")


def masked(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), "[0-9]+", "#")


def without_margins(page_lines: DataFrame) -> DataFrame:
    """Page lines without running headers and footers.

    ``page_lines(doc_id, page, line_no, text, top, bottom, page_height)``. A line near an edge goes if it is a page number or
    if its text, digits masked, stands near an edge on two pages or more.
    """
    edge = (F.col("top") < EDGE * F.col("page_height")) | (F.col("bottom") > (1 - EDGE) * F.col("page_height"))
    rows = page_lines.withColumn("edge", edge).withColumn("mask", masked(F.col("text")))
    often = rows.where("edge").groupBy("doc_id", "mask").agg(F.count_distinct("page").alias("pages")).where("pages >= 2").select("doc_id", "mask", F.lit(True).alias("running"))
    number = F.rlike("text", F.lit(r"^\s*(?:[Pp]age\s+)?[0-9]+(?:\s*(?:/|of)\s*[0-9]+)?\s*$"))
    joined = rows.join(often, ["doc_id", "mask"], "left")
    return joined.where(~F.col("edge") | ~(number | F.coalesce("running", F.lit(False)))).drop("edge", "mask", "running")


def scans(page_lines: DataFrame, least: int = 200) -> DataFrame:
    """Documents with fewer than ``least`` characters are scans."""
    return page_lines.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars")).select("doc_id", "chars", (F.col("chars") < least).alias("is_scan"))


def repack(blocks: DataFrame, most: int = 12_000) -> DataFrame:
    """(doc_id, pos, part): blocks in parts of at most ``most`` characters, cut before the last heading if that is in
    a part's second half; a larger block stands alone. An ordered fold over one document's blocks, lengths only.
    """
    order = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.length("text").alias("n"), "is_heading"))).alias("b"))

    @F.pandas_udf("array<int>")
    def parts(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(b: list) -> list[int]:
            upto = [0, *itertools.accumulate(x["n"] for x in b)]
            out, part, start, head = [], 0, 0, 0  # head: the last heading behind the part's start
            for i, x in enumerate(b):
                size = upto[i] - upto[start]
                if size and size + x["n"] > most:
                    cut = head if head > start and (upto[head] - upto[start]) * 2 >= size else i
                    part += 1
                    out[cut:] = [part] * (i - cut)
                    start = cut
                    if upto[i] > upto[start] and upto[i + 1] - upto[start] > most:
                        part, start = part + 1, i
                out.append(part)
                if x["is_heading"] and i > 0:
                    head = i
            return out

        for c in columns:
            yield c.map(one)

    packed = order.select("doc_id", F.explode(F.arrays_zip("b", parts("b").alias("p"))).alias("x"))
    return packed.select("doc_id", F.col("x.b.pos").alias("pos"), F.col("x.p").alias("part"))


def line_kinds(rows: DataFrame) -> DataFrame:
    """The kind of each line of a draft."""
    text = F.col("text")
    kind = (
        F.when(F.trim(text) == "", "blank").when(F.rlike(text, F.lit("^# ")), "title").when(F.rlike(text, F.lit("^## ")), "section").when(F.rlike(text, F.lit("^###+ ")), "subsection")
        .when(F.rlike(text, F.lit(r"^\s*[-*•] ")), "bullet").when(F.rlike(text, F.lit(r"^\s*[0-9]+[.)] ")), "number").when(F.rlike(text, F.lit("^> ")), "quote").when(F.rlike(text, F.lit(r"^\s*\|.*\|\s*$")), "table").otherwise("paragraph")
    )
    return rows.withColumn("kind", kind)


BANNER = r"(?i)^\s*>?\s*(?:<!--.*-->|\W*AI[- ]generated draft\b.*)\s*$"  # a line that says no more than that a draft is one
MARKS = {"subsection": "### ", "section": "## ", "title": "# ", "bullet": "- ", "quote": "> "}


def blocks(drafts: DataFrame) -> DataFrame:
    """A draft as blocks for a document: (doc_id, block_no, kind, content, rows).

    ``drafts(doc_id, title, text)``. Banner lines go; a draft without a title of its own gets ``title``, if that isn't blank.
    Kinds: title, section (in capitals), highlighted_section (an AI-use task), subsection, bullet, number, quote, paragraph,
    blank, and table: a run of lines that begin with a bar, separators left out, whose cells are in ``rows``. Emphasis marks are
    taken out. A null text has no lines.
    """
    every = lines(drafts.select("doc_id", F.regexp_replace("text", "\r\n?", "\n").alias("text"))).where(~F.rlike("text", F.lit(BANNER)))
    every = every.select("doc_id", "line_no", F.btrim("text", F.lit(" \t\x0b\x0c")).alias("line"))
    titled = every.groupBy("doc_id").agg(F.bool_or(F.startswith("line", F.lit("# "))).alias("has_title"))
    given = drafts.select("doc_id", "title").join(titled, "doc_id").where("not has_title and trim(title) <> ''")
    opening = given.select("doc_id", F.explode(F.array(F.struct(F.lit(-2).alias("line_no"), F.concat(F.lit("# "), F.trim("title")).alias("line")), F.struct(F.lit(-1).alias("line_no"), F.lit("").alias("line")))).alias("l")).select("doc_id", "l.*")
    told = every.unionByName(opening)
    is_row = F.startswith("line", F.lit("|"))
    by_mark = lambda m: F.startswith("line", F.lit(m))
    kind = F.when(is_row, "table").when(F.col("line") == "", "blank")
    for name, mark in MARKS.items():
        kind = kind.when(by_mark(mark), name)
    kind = kind.when(by_mark("* "), "bullet").when(F.rlike("line", F.lit(r"^[0-9]+[.)]\s")), "number").otherwise("paragraph")
    bare = F.regexp_replace("line", r"^(?:#{1,3} |[-*] |> |[0-9]+[.)]\s+)", "")
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"\*\*(.*?)\*\*", "$1"), r"\*(.*?)\*", "$1"))
    content = F.when(F.col("kind") == "paragraph", clean(F.col("line"))).when(F.col("kind") == "section", F.upper(clean(bare))).otherwise(clean(bare))
    # runs of table lines: a table line's place less its rank among its document's table lines stays the same within a run
    order = Window.partitionBy("doc_id").orderBy("line_no")
    numbered = told.withColumn("kind", kind).withColumn("place", F.row_number().over(order))
    rank = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("line_no"))
    numbered = numbered.withColumn("run", F.when(F.col("kind") == "table", F.col("place") - rank)).withColumn("content", F.when(F.col("kind") != "table", content))
    cells = F.transform(F.split(F.btrim("line", F.lit("|")), r"\|"), clean)
    rows = numbered.where("kind = 'table'").where(~F.rlike("line", F.lit(r"^\|?[\s:|-]*-[\s:|-]*$"))).select("doc_id", "run", "place", F.struct("place", cells.alias("cells")).alias("r"))
    tables = rows.groupBy("doc_id", "run").agg(F.min("place").alias("place"), F.transform(F.array_sort(F.collect_list("r")), lambda x: x["cells"]).alias("rows"))
    single = numbered.where("kind <> 'table'").select("doc_id", "place", F.when((F.col("kind") == "section") & (F.replace("content", F.lit("-"), F.lit(" ")) == "AI USE TASK"), "highlighted_section").otherwise(F.col("kind")).alias("kind"), "content")
    both = single.unionByName(tables.select("doc_id", "place", F.lit("table").alias("kind"), "rows"), allowMissingColumns=True)
    return both.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("place")).alias("block_no"), "kind", "content", "rows")
