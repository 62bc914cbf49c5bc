"""Schedules in Word tables written back, tables cleaned up, words that changed."""

import datetime

from loomwork.operators import cell_tables as c

D = datetime.date
ROWS = "doc_id int, table_no int, row_no int, cells array<string>"
PLAN = "doc_id int, week_number int, meeting int, is_break boolean, day date, date_start date, label string, topics array<string>, assignments array<string>, notes string"


def week(doc, n, day, meeting=1, topics=(), work=(), notes=None):
    return (doc, n, meeting, False, day, None, f"Week {n}", list(topics), list(work), notes)


def pause(doc, start, label):
    return (doc, None, None, True, None, start, label, [], [], None)


def rolled(spark, rows, plan):
    out = c.rolled_cells(spark.createDataFrame(rows, ROWS), spark.createDataFrame(plan, PLAN)).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.table_no, r.row_no)):
        got.setdefault((r.doc_id, r.table_no), []).append(list(r.cells))
    return got


def test_schedules_are_written_back(spark):
    head = ["Week", "What"]
    rows = [
        # styles, text around labels, a module's title, a week that goes
        (1, 0, 0, head), (1, 0, 1, ["Module 1", ""]), (1, 0, 2, ["Week 1 (8/24) lab", "a"]), (1, 0, 3, ["first\nWeek 2 (Aug. 31)", "b"]), (1, 0, 4, ["Week 3 (September 7)", "c"]), (1, 0, 5, ["Week 4 (Sep 14)", "d"]),
        # two meetings a week in two tables; the break moves to the other table, a second is like it
        (2, 0, 0, head), (2, 0, 1, ["Week 1 (8/24)", "a"]), (2, 0, 2, ["Week 1 (8/26)", "b"]), (2, 0, 3, ["Fall Break (8/29 - 8/30)\nrest", "No class, all"]), (2, 1, 0, head), (2, 1, 1, ["Week 2 (8/31)", "c"]), (2, 1, 2, ["Week 2 (9/2)", "d"]),
        # no break rows, one column, weeks added behind the last, a break in front of an added week and one at the end
        (3, 0, 0, ["Week"]), (3, 0, 1, ["Week 1 (8/24)\nold text"]), (3, 0, 2, ["closing words"]),
        # surplus break rows go; undated labels stay
        (4, 0, 0, head), (4, 0, 1, ["Fall Break", "off"]), (4, 0, 2, ["Week 1", "a"]), (4, 0, 3, ["Labor holiday", "off"]),
        (5, 0, 0, head), (5, 0, 1, ["notes", "x"]),
    ]
    plan = [
        week(1, 1, D(2027, 8, 23)), week(1, 2, D(2027, 8, 30)), week(1, 3, D(2027, 9, 6)),
        week(2, 1, D(2027, 8, 23)), week(2, 1, D(2027, 8, 25), 2), week(2, 2, D(2027, 8, 30)), week(2, 2, D(2027, 9, 1), 2), pause(2, D(2027, 8, 31), "Fall Break (8/31 - 8/31)"), pause(2, D(2027, 10, 9), "Late Break (10/9 - 10/17)"),
        week(3, 1, D(2027, 8, 23)), week(3, 2, D(2027, 8, 30), 1, ["New"], ["Essay due"], "bring it"), week(3, 3, D(2027, 9, 6)), pause(3, D(2027, 8, 25), "B (8/25 - 8/26)"), pause(3, D(2027, 9, 7), "C (9/7 - 9/8)"),
        week(4, 1, D(2027, 8, 23)), pause(4, D(2027, 9, 1), "One Break"),
    ]
    got = rolled(spark, rows, plan)
    assert got[1, 0] == [head, ["Module 1", ""], ["Week 1 (8/23) lab", "a"], ["first\nWeek 2 (Aug. 30)", "b"], ["Week 3 (September 6)", "c"]]
    assert got[2, 0] == [head, ["Week 1 (8/23)", "a"], ["Week 1 (8/25)", "b"]]
    assert got[2, 1] == [head, ["Week 2 (8/30)", "c"], ["Fall Break (8/31 - 8/31)\nrest", "No class, all"], ["Week 2 (9/1)", "d"], ["Late Break (10/9 - 10/17)\nrest", "No class, all"]]
    assert got[3, 0] == [["Week"], ["Week 1 (8/23)\nold text"], ["B (8/25 - 8/26)\nNo class"], ["Week 2 (8/30)\nNew\nEssay due\nNote: bring it"], ["Week 3 (9/6)"], ["closing words"], ["C (9/7 - 9/8)\nNo class"]]
    assert got[4, 0] == [head, ["Week 1", "a"], ["One Break", "off"]] and got[5, 0] == [head, ["notes", "x"]]
    assert c.rolled_cells(spark.createDataFrame([], ROWS), spark.createDataFrame(plan, PLAN)).count() == 0


def test_tables_are_cleaned(spark):
    rows = [(1, 0, 0, ["", "Week 1 (8/24)", "-"]), (1, 0, 1, ["a", None, "", "–"]), (1, 0, 2, ["-", " "]), (2, 0, 0, ["a boxed text", ""]), (2, 0, 1, ["more of it", ""]), (3, 0, 0, ["a", "b"]), (3, 0, 1, ["c", "d"]), (3, 0, 2, ["e", ""]), (4, 0, 0, ["a", "b"])]
    out = c.tidy_rows(spark.createDataFrame([(a, b, n, x) for a, b, n, x in rows], "doc_id int, item_no int, row_no int, cells array<string>")).orderBy("doc_id", "row_no").collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, ([], r.is_real))[0].append(list(r.cells))
    assert got == {1: ([["Week 1 (8/24)"], ["a"]], True), 2: ([["a boxed text"], ["more of it"]], False), 3: ([["a", "b"], ["c", "d"], ["e", ""]], True), 4: ([["a", "b"]], False)}


def test_word_changes_by_hand():
    from loomwork.operators.flags import edits_of

    one = lambda old, new: [(x["old"], x["new"], x["context"]) for x in edits_of(old, new)]
    assert one("Week 2 (Jan. 6) has more words behind", "Week 2 (Aug. 30) has more words behind") == [("(Jan. 6)", "(Aug. 30)", "Week 2")]
    assert one("Term: Spring 2026", "Term: Fall 2026") == [("Spring 2026", "Fall 2026", "Term:")]  # up to the paragraph's end
    assert one("a b c d e f", "a b x c d e f") == [("b", "b x", "a")]  # what is only put in takes a word along
    assert one("b c d e", "x b c d e") == []  # nothing before it to look for
    assert one("a b c d e f g h i j", "a B c d e f G h i j") == [("b", "B", "a"), ("g", "G", "e f")]
    assert one("a b c d e f g", "a B c d E f g") == [("b c d e f g", "B c d E f g", "a")]  # two words between are absorbed
    assert one("a b c d e", "a c d e") == [("b", "", "a")] and one("same", "same") == [] and one("a   b c d e", "a b c d e") == []


def test_word_changes_are_those_of_the_standard_matcher_in_time():
    import difflib
    import random
    import time

    from loomwork.operators.flags import TOKEN, blocks_of, edits_of

    draw = random.Random(1)
    for n in range(600):
        a, b = ([f"w{draw.randrange(draw.choice((2, 5, 40)))}" for _ in range(draw.randrange(25))] for _ in "ab")
        if n % 3 == 0:  # words that come once
            a, b = [f"{x}~{i}" for i, x in enumerate(a)], [f"{x}~{i}" for i, x in enumerate(a) if draw.random() < 0.8] + ["new"]
        a, b = TOKEN.findall(" ".join(a)), TOKEN.findall("  ".join(b) if n % 5 == 0 else " ".join(b))
        blocks = lambda found: [(i, j) for i0, j0, size in found for i, j in zip(range(i0, i0 + size), range(j0, j0 + size))]
        assert blocks(blocks_of(a, b)) == blocks(difflib.SequenceMatcher(None, a, b, False).get_matching_blocks())
    # 10,000 words in one paragraph: every blank is like every other, which once took minutes
    words = [f"w{draw.randrange(3000)}" for _ in range(10_000)]
    for old in (words, [f"{w}~{i}" for i, w in enumerate(words)]):
        began = time.time()
        assert [x["new"] for x in edits_of(" ".join(old), " ".join([*old[:5000], "other", *old[5001:]]))] == ["other"]
        assert time.time() - began < 10


def test_word_changes_of_documents(spark):
    from loomwork.operators.flags import word_changes

    rows = lambda *x: spark.createDataFrame(list(x), "doc_id int, para_no int, text string")
    out = word_changes(rows((1, 0, "one two"), (1, 1, None), (2, 0, "a"), (3, 0, "same")), rows((1, 0, "one 2"), (1, 1, "x"), (2, 0, "a"), (2, 1, "b"), (3, 0, "same"))).collect()
    assert sorted((r.doc_id, r.para_no, r.old, r.new, r.context, r.error_code) for r in out if r.doc_id == 1) == [(1, 0, "two", "2", "one", None)]
    assert [(r.doc_id, r.error_code) for r in out if r.doc_id > 1] == [(2, "paragraph_count")]


def test_header_guesses_by_hand(spark):
    from loomwork.operators.extraction import header_guesses

    tops = {
        1: ["IS 6640-001 Networking and Servers – Online", "Fall Semester 2026, 3 credit hours", "Office Hours: Tuesday 2:00 pm", "Tuesday 6:00-9:00 pm CRCC 105"],
        2: ["# Online Learning Design (Hybrid Asynchronous)", "FALL 2026", "OSC6660, Sec. 012"],
        3: ["Course: IS 4410 - 003", "Title: Data", "Semester: spring 2027"],
        4: ["Syllabus", "IS 5555-8001 Data"],
        5: ["x"] * 15 + ["Fall 2026"],
        6: ["Term: Fall Semester", "Summer 2027", "12 credits of 3"],
    }
    rows = [(d, 2 * i, x) for d, lines in tops.items() for i, x in enumerate(lines)] + [(1, 1, "")]
    got = {r.doc_id: r for r in header_guesses(spark.createDataFrame(rows, "doc_id int, line_no int, text string")).collect()}
    one = lambda d: (got[d].term, got[d].number, got[d].section, got[d].title, got[d].credits, got[d].meeting_pattern)
    assert one(1) == ("Fall 2026", "IS 6640", "001", "Networking and Servers", 3.0, "Tuesday 6:00-9:00 pm CRCC 105")
    assert one(2) == ("Fall 2026", "OSC 6660", "012", "Online Learning Design", None, "")
    assert one(3) == ("Spring 2027", "IS 4410", "003", "Data", None, "")
    assert one(4)[1:4] == ("IS 5555", "", "8001 Data") and got[4].error_code == "no_term" and got[5].error_code == "no_term" and got[5].title == "Untitled course"
    assert one(6)[0] == "Fall Semester" and one(6)[4] == 12.0


def test_blocks_of_a_draft(spark):
    from loomwork.operators.documents import blocks

    text = "> **AI-generated draft** for review\n## Tasks **in** brief\n| a | *b* |\n|---|:-:|\n| c | d |\n\n| e |\n* one\n1. two\n### Three\n> said\nplain **words**\r\n## AI-use task"
    rows = [(1, "Week 3", text), (2, "Given", "# Own\nx"), (3, " ", "x"), (4, "T", None)]
    out = blocks(spark.createDataFrame(rows, "doc_id int, title string, text string")).orderBy("doc_id", "block_no").collect()
    got = [(r.kind, r.content if r.rows is None else [list(x) for x in r.rows]) for r in out if r.doc_id == 1]
    assert got == [
        ("title", "Week 3"), ("blank", ""), ("section", "TASKS IN BRIEF"), ("table", [["a", "b"], ["c", "d"]]), ("blank", ""), ("table", [["e"]]), ("bullet", "one"), ("number", "two"),
        ("subsection", "Three"), ("quote", "said"), ("paragraph", "plain words"), ("highlighted_section", "AI-USE TASK"),
    ]
    assert [(r.doc_id, r.kind, r.content) for r in out if r.doc_id > 1] == [(2, "title", "Own"), (2, "paragraph", "x"), (3, "paragraph", "x")]


def test_dates_roll_inside_a_row(spark):
    from loomwork.operators.extraction import roll_dates

    rows = [(1, 0, D(2026, 12, 7), None, None, False), (1, 1, None, D(2026, 12, 20), D(2026, 1, 3), False), (1, 2, D(2026, 1, 11), None, None, False), (1, 3, None, None, None, False)]
    rows += [(2, 0, D(2027, 12, 15), None, None, True), (2, 1, D(2027, 1, 11), None, None, True)]
    got = [tuple(r)[2:] for r in roll_dates(spark.createDataFrame(rows, "doc_id int, row_no int, day date, date_start date, date_end date, is_spring boolean")).orderBy("doc_id", "row_no").collect()]
    assert got == [(D(2026, 12, 7), None, None), (None, D(2026, 12, 20), D(2027, 1, 3)), (D(2027, 1, 11), None, None), (None, None, None), (D(2026, 12, 15), None, None), (D(2027, 1, 11), None, None)]


def test_half_written_tails_and_other_corrupt_lines(spark, tmp_path):
    from loomwork.sources import files

    good = '{"event_type": "generation", "timestamp": "2026-01-01T00:00:00Z"}'
    (tmp_path / "a.jsonl").write_text(f"{good}\n\n{good}\n" + '{"event_type": "gen')
    (tmp_path / "b.jsonl").write_text(f"{good}\nnot é json\n{good}\n")
    (tmp_path / "c.jsonl").write_text(f"{good}\nbroken\n")
    (tmp_path / "d.jsonl").write_text(f"broken\n{good}")
    events, bad = files.read_log(spark, str(tmp_path))
    assert events.count() == 6 and sorted((r._corrupt, r.is_tail) for r in bad.collect()) == [("broken", False), ("broken", False), ("not é json", False), ('{"event_type": "gen', True)]
    assert files.read_log(spark, str(tmp_path / "a.jsonl"), fail=True, allow_tail=True)[0].count() == 2
    try:
        files.read_log(spark, str(tmp_path / "c.jsonl"), fail=True, allow_tail=True)
        raise AssertionError("a corrupt line with its end is an error")
    except ValueError:
        pass
    assert files.read_log(spark, str(tmp_path / "none"))[0].count() == 0


def test_markdown_files(spark, tmp_path):
    from loomwork.sources import files

    (tmp_path / "in").mkdir()
    (tmp_path / "a.md").write_bytes("﻿# Één\r\ntwo\rthree\n".encode())
    (tmp_path / "in" / "b.md").write_bytes(b"caf\xe9\n")
    (tmp_path / "c.md").write_bytes(b"")
    (tmp_path / "d.txt").write_bytes(b"\xff")
    lines, rejected = files.read_markdown(spark, str(tmp_path))
    assert [(r.path[-4:], r.line_no, r.text) for r in lines.orderBy("path", "line_no").collect()] == [("a.md", 0, "# Één"), ("a.md", 1, "two"), ("a.md", 2, "three"), ("a.md", 3, "")]
    assert [(r.path[-4:], r.error_code) for r in rejected.collect()] == [("b.md", "not_utf8")]


def test_schedules_are_read(spark):
    rows = [
        (1, 0, 0, ["Unit", "Text", "Due"]), (1, 0, 1, ["Week 1 (8/24): hello", "a\nNotes: bring it\nQuiz due", "x\nNote: y"]), (1, 0, 2, ["Module 2", ""]), (1, 0, 3, ["first\nWeek 2 (Aug 31)", "b", "z"]), (1, 0, 4, ["Fall break", "9/5 – 9/7"]), (1, 0, 5, ["Winter break", "soon"]),
        (2, 3, 0, ["#", "Topic"]), (2, 3, 1, ["1", "a"]), (2, 3, 2, ["Meeting 3: c", "d due"]), (2, 3, 3, ["2nd try", "x"]), (2, 4, 0, ["Grade", "Points"]), (2, 4, 1, ["1", "2"]), (2, 4, 2, ["2", "3"]),
        (3, 0, 0, ["Week", "x"]), (3, 0, 1, ["Week 3 (Online 2)", "x"]), (3, 0, 2, ["Week 4 (2/30)", "x"]), (4, 0, 0, ["Week"]), (4, 0, 1, ["1"]),
    ]
    years = spark.createDataFrame([(i, 2026, D(2026, 8, 24)) for i in range(1, 5)], "doc_id int, year int, week_one date")
    out = c.schedule_rows(spark.createDataFrame(rows, ROWS), years).orderBy("doc_id", "table_no", "row_no").collect()
    got = [(r.doc_id, r.kind, r.week_number, r.day or r.date_start, list(r.topics), list(r.assignments), r.notes, r.error_code) for r in out]
    assert got == [
        (1, "week", 1, D(2026, 8, 24), ["hello", "a"], ["Quiz due", "x"], "bring it y", None), (1, "week", 2, D(2026, 8, 31), ["first", "b"], ["z"], None, None),
        (1, "break", None, D(2026, 9, 5), [], [], None, None), (1, "break", None, None, [], [], None, "bad_break"),
        (2, "week", 1, D(2026, 8, 24), ["a"], [], None, None), (2, "week", 3, D(2026, 9, 7), ["c"], ["d due"], None, None), (3, "week", 4, None, ["x"], [], None, "bad_date"),
    ]
