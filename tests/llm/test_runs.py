"""Periodic runs against brute force over all lags."""

import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm import runs

SCHEMA = "doc_id long, text string, runs string, n_words string"  # extra columns with clashing names


def plain_runs(words):
    """Every stretch with smallest period q that is long enough and can't be extended."""
    out = []
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            s = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            length = i - s
            if length >= max(6, 4 * q) and not any(all(words[k] == words[k - p] for k in range(s + p, i)) for p in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)), n,
    )


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), st.integers(1, 9)), max_size=5))
def test_runs_equal_brute_force(pieces):
    words = [w for piece, times in pieces for w in piece * times]
    assert sorted(runs.periodic_runs(np.array([ord(w) for w in words], "i8")), key=lambda r: (r[0], r[2])) == plain_runs(words)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab \n", max_size=40), max_size=6))
def test_texts_of_a_batch_do_not_meet(texts):
    for text, (n, found, _) in zip(texts, runs.runs_of_texts([t.encode() for t in texts])):
        assert n == len(text.split()) and found == plain_runs(text.split())


def test_one_word_a_million_times_takes_no_square():
    assert list(runs.periodic_runs(np.zeros(1_000_000, "i8"))) == [(0, 1_000_000, 1)]
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 100_000:
        fib.append(fib[-1] + fib[-2])
    assert list(runs.periodic_runs(np.array(fib[-1], "i8"))) == []  # exponents below four only


def test_query_equals_brute_force(spark, tmp_path):
    texts = ["", None, " \t\n", "a", "la " * 20, "x y " * 9 + "z", "a b c " * 8, "one two three four five six seven", "word " * 3000, "é\x0bé\x0cé\ré é\té"]
    rows = [(i, texts[i % len(texts)] if i % 3 else " ".join(f"w{k * i % 97}" for k in range(i)), "r", "n") for i in range(400)] + [(None, "la la la la la la", "r", "n"), (5, "la " * 6, "r", "n"), (5, "la " * 6, "r", "n")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in runs.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((plain_row(i, t) if i is not None else (None, *plain_row("x", t)[1:]) for i, t, _, _ in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 50
    assert runs.find_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_without_repeats_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "a  b", "r", "n"), (2, None, None, None), (3, "see la la la la la la la end", "r", "n")], SCHEMA)
    out = {r.doc_id: r.text for r in runs.without_repeats(df).collect()}
    assert out == {1: "a  b", 2: None, 3: "see la end"} and runs.without_repeats(df).columns == df.columns
