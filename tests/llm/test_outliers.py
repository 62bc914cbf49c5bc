"""Quality rules: counts against brute force, estimates against a plain numpy version, planted outliers."""

import math
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm import outliers as o

SCHEMA = "doc_id long, text string, lang string, source string, kept string, n_words string, x0 string"  # clashing names


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    seen, doubled = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            doubled += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), doubled, len(inside), failed


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "é#", "|", " ", "\n", "\t", "c d e f g", "\x0b", " "]), max_size=40).map("".join), max_size=5))
def test_counts_equal_brute_force(texts):
    counts, _ = o.measured(texts)
    assert [tuple(int(c[i]) for c in counts) for i in range(len(texts))] == [plain_counts(t)[:5] for t in texts]


def plain_fit(vectors):
    """The same estimate with plain loops over the vectors of one group."""
    v = np.array(vectors, float) / o.UNIT
    n, floor = len(v), np.array(list(o.VECTOR.values()))
    q = np.percentile(v, [25, 50, 75], axis=0)
    spread = np.maximum((q[2] - q[0]) / 1.349, floor)
    z = (v - q[1]) / spread
    norm = np.maximum((z * z).sum(1), 1e-9)
    shapes = [np.eye(o.P), (np.tanh(z)[:, :, None] * np.tanh(z)[:, None, :]).mean(0), (z[:, :, None] * z[:, None, :] / norm[:, None, None]).mean(0)]
    starts = []
    for s in shapes:
        s = s / max(np.trace(s) / o.P, 1e-9) + 0.05 * np.eye(o.P)
        starts.append((q[1], np.linalg.inv(s) / np.outer(spread, spread), math.inf))

    def distances(c, inverse):
        return np.einsum("ni,ij,nj->n", v - c, inverse, v - c)

    def refit(rows, share):
        c = rows.mean(0)
        s = (rows[:, :, None] * rows[:, None, :]).mean(0) - np.outer(c, c)
        if share < 1:
            s = s * share / (1 - o.chi_square_tail(o.chi_square_limit(1 - share, o.P), o.P + 2))
        s = s + np.diag(floor**2)
        return c, np.linalg.inv(s), np.linalg.slogdet(s)[1]

    def step(c, inverse, _):
        bins = np.floor(16 * np.log2(np.maximum(distances(c, inverse), 1e-6)))
        half = (n + o.P + 1) // 2
        near = v[bins <= np.sort(bins)[half - 1]]
        return refit(near, len(near) / n)

    for k in range(o.STEPS):
        new = [step(*s) for s in starts]
        if k == 1:
            at = min(range(3), key=lambda i: (new[i][2], i))
            new, starts = [new[at]], [starts[at]]
        done = k > 1 and new[0][2] >= starts[0][2] - 1e-6
        starts = new
        if done:
            break
    c, inverse, _ = starts[0]
    d = distances(c, inverse)
    return refit(v[d <= o.chi_square_limit(o.INNER, o.P)], 1 - o.INNER)


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(n)) + "."


def corpus():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(420):
        text = prose(rng, int(rng.integers(30, 90)))
        if i % 4 == 1:
            text = text.replace(" ", " | ")  # a quarter of the group: records of cells
        rows.append((i, text, "en", "big" if i < 380 else f"s{i % 3}"))
    rows += [(1000 + i, rows[0][1], "en", "big") for i in range(300)]  # copies count once
    rows += [(2000 + i, prose(rng, 40), None, None) for i in range(5)] + [(None, None, None, None), (3000, "", "en", "big"), (3001, "### $$$ " * 3 + prose(rng, 10).upper(), "de", "x")]
    return rows


def test_estimates_equal_plain_version_and_reject_a_planted_quarter(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    out = o.judged(df).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for doc_id, text, _, _ in rows:
        r = by[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(text)
    for i in range(380):
        assert by[i].kept == (i % 4 != 1), i
    assert all(by[1000 + i].kept for i in range(300))
    assert not by[None].kept and not by[3000].kept and by[3000].distance is None
    assert '"source":"big"' in by[0].fit and '"of":"language"' in by[400].fit and by[2000].fit == by[3001].fit == "all"
    big = [t for _, t, _, s in rows if s == "big" and not plain_counts(t)[5]]
    vectors = np.array(o.measured(big)[1]).T
    c, inverse, _ = plain_fit(np.unique(vectors, axis=0))
    for i in range(0, 380, 7):
        v = np.array(o.measured([rows[i][1]])[1]).T[0] / o.UNIT
        assert math.isclose(by[i].distance, (v - c) @ inverse @ (v - c), rel_tol=1e-6)
    again = o.judged(df.repartition(7)).collect()  # the same in any order
    assert {(r.doc_id, r.distance) for r in again} == {(r.doc_id, r.distance) for r in out}


def test_empty_table_and_few_rows(spark):
    assert o.judged(spark.createDataFrame([], SCHEMA)).count() == 0
    few = o.judged(spark.createDataFrame([(1, "one two three four five six seven eight nine ten", "en", "s", None, None, None)], SCHEMA)).collect()
    assert [(r.n_words, r.kept) for r in few] == [(10, True)]


def test_chi_square():
    assert abs(o.chi_square_tail(12.5916, 6) - 0.05) < 1e-5 and abs(o.chi_square_limit(0.05, 6) - 12.5916) < 1e-3
