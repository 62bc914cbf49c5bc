"""Document, grading and draft jobs on inline rows."""

from pyspark.sql import functions as F

from loomwork.operators import documents as doc
from loomwork.operators import drafts as dr
from loomwork.operators import grading as g


def test_tables_in_markdown(spark):
    text = "intro\n| a | b |\n|---|:---:|\n| 1 | 2 |\nx\n| c |\n"
    rows = doc.table_rows(doc.lines(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")))
    assert [(r.table_no, r.row_no, r.cells) for r in rows.orderBy("line_no").collect()] == [(1, 1, ["a", "b"]), (1, 2, ["1", "2"]), (2, 1, ["c"])]


def test_margins(spark):
    rows = [(1, p, n, text, top, top + 10.0, 600.0) for p in (1, 2) for n, text, top in ((0, f"Syllabus v{p}", 5.0), (1, "body text", 100.0), (2, f"{p} of 2", 585.0), (3, f"odd {'ab'[p - 1]}", 30.0))]
    page = spark.createDataFrame(rows, "doc_id long, page int, line_no int, text string, top double, bottom double, page_height double")
    assert sorted(r.text for r in doc.without_margins(page).collect()) == ["body text", "body text", "odd a", "odd b"]


def test_parts(spark):
    rows = [(1, i, "x" * n, head) for i, (n, head) in enumerate([(40, True), (30, False), (20, True), (30, False), (150, False), (10, False)])]
    got = doc.repack(spark.createDataFrame(rows, "doc_id long, pos int, text string, is_heading boolean"), 100)
    assert [r.part for r in got.orderBy("pos").collect()] == [0, 0, 1, 1, 2, 3]


def test_rubric(spark):
    text = "Rubric\n1. Thesis - 10 points\n- claim - 4 points\n- support - 6 points\n2) Style - 5 points\n- tone - 4 points\nnote"
    got = g.criteria(spark.createDataFrame([(1, text)], "rubric_id long, text string")).orderBy("pos").collect()
    assert [(r.name, r.possible, r.parts, r.adds_up) for r in got] == [("Thesis", 10.0, 2, True), ("Style", 5.0, 1, False)]


def test_replies_and_totals(spark):
    rubric = g.criteria(spark.createDataFrame([(1, "1. A - 10 points\n2. B - 4 points\n3. C - 2 points")], "rubric_id long, text string"))
    replies = spark.createDataFrame([(7, 1, 1, "no {json} here"), (7, 1, 2, '```json\n{"name": "a", "earned": 8}\n```'), (7, 2, 1, 'ok {"name": "B", "earned": 9.5}')], "submission_id long, pos int, attempt int, text string")
    scores = g.criterion_scores(replies, rubric, spark.createDataFrame([(7, 1)], "submission_id long, rubric_id long"))
    assert [r.errors for r in scores.orderBy("pos").collect()] == ["", "out_of_range", "no_reply"]
    total = g.totals(scores).first()
    assert (total.earned, total.possible, total.percent, total.errors, total.strengths, total.improvements) == (8.0, 16.0, 50.0, 2, "A", "A")


def test_grounding(spark):
    texts = spark.createDataFrame([(1, "The “quick” brown\n fox — jumps over Straße … end")], "submission_id long, text string")
    asked = ['the "quick" brown', "quick... jumps", "jumps...quick", "", "STRASSE", "absent", "... "]
    rows = spark.createDataFrame([(1, i, q) for i, q in enumerate(asked)] + [(2, 99, "x")], "submission_id long, quote_id int, quote string")
    got = [r.note for r in g.ground(rows, texts).orderBy("quote_id").collect()]
    assert got == ["found", "found", "not_found", "no_quote", "found", "not_found", "no_quote", "not_found"]


def test_prompt_values_are_not_filled_again(spark):
    weeks = spark.createDataFrame([(1, 10, 2, False, ["{context}"], ["x"], None), (1, 11, 2, False, ["b"], [], "n")], "course_id long, row_no int, week_number int, is_break boolean, topics array<string>, assignments array<string>, notes string")
    requests = spark.createDataFrame([(5, 1, "quiz", 2)], "request_id long, course_id long, content_type string, week_number int")
    sources = spark.createDataFrame([(1, 1, "s", "abcdef"), (1, 0, "r", "zz")], "course_id long, pos long, name string, text string")
    templates = spark.createDataFrame([("quiz", "{topics}|{nope}|{context}")], "content_type string, text string")
    got = dr.prompts(requests, weeks, sources, templates, 18).first()
    assert got.prompt == "{context}, b|{nope}|### r\nzz\n\n### s\nab\n[... 4 characters omitted]"  # one budget for all sources in order
    assert dr.prompts(requests, weeks, sources, templates, 9).first().prompt == "{context}, b|{nope}|### r\nzz\n\n[... 13 characters omitted]"
    assert dr.prompts(requests, weeks, sources, templates, 22).first().prompt.endswith("|### r\nzz\n\n### s\nabcdef")


def test_catalogue(spark):
    paths = ["outputs/week-2-quiz.md", "outputs/.archive/week-2-quiz.1.md", "outputs/.archive/week-3-quiz.1.md", "outputs/notes.txt"]
    got = dr.catalogue(spark.createDataFrame([(1, p) for p in paths], "project_id long, path string")).collect()
    assert [(r.stem, r.week_number, r.versions) for r in got] == [("week-2-quiz", 2, 1)]
    kept = dr.latest_sources(spark.createDataFrame([(1, "f", 1, 1), (1, "f", 2, 2), (1, "g", 1, 3)], "project_id long, filename string, added_at int, source_id long"))
    assert {(r.filename, r.source_id, r.source_count) for r in kept.collect()} == {("f", 2, 2), ("g", 3, 2)}


def test_details(spark):
    rows = doc.lines(spark.createDataFrame([(1, "at MWF in B1\nelse")], "doc_id long, text string"))
    changes = spark.createDataFrame([(1, 0, "MWF", "TTh"), (1, 1, "B1", " ")], "doc_id long, pos int, old string, new string")
    assert [r.new_text for r in doc.replace_details(rows, changes).collect()] == ["at TTh in TBA"]
    assert doc.first_mentions(rows, "MWF").first().nth == 1
    assert doc.line_kinds(rows).agg(F.count("*")).first()[0] == 2
