"""Joins of keys that hold very many rows: the same rows as a plain join, dealt over several tasks."""

from collections import Counter

import numpy as np
import pytest

from loomwork.llm import common, neardup

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join(spark, monkeypatch, how):
    monkeypatch.setattr(common, "HOT", 5)
    rows = [(f"k{i % 3}" if i % 2 else f"u{i}", i) for i in range(120)] + [(None, 500 + i) for i in range(9)] + [("alone", 900)]
    facts = [(f"k{i}", i) for i in range(3)] + [(f"u{i}", i) for i in range(0, 60)] + [(None, 7)]
    a, b = spark.createDataFrame(rows, "key string, x long"), spark.createDataFrame(facts, "key string, y long")
    want = Counter(map(tuple, a.join(b, "key", how).select("key", "x", "y").collect()))
    assert Counter(map(tuple, common.salted_join(a, b, "key", "x", how).select("key", "x", "y").collect())) == want
    hot = common.hot_keys(a, "key")
    assert {r._hot: r._pieces for r in hot.collect()} == {k: 4 for k in ("k0", "k1", "k2")}
    pieces = Counter((r.key, r._piece) for r in common.dealt(a, "key", hot, "x").collect() if r.key and r.key[0] == "k")
    assert max(pieces.values()) < 20
    assert common.salted_join(a.where("false"), b, "key", "x", how).count() == 0


def test_components_of_stars_and_giants(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 5)
    edges = [(0, i) for i in range(1, 80)] + [(100 + i, 101 + i) for i in range(60)] + [(150, 79), (300, 301)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(80)}, **{100 + i: 0 for i in range(61)}, 300: 300, 301: 300}


def test_one_group_is_most_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 5)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base)) for i in range(40)]
    for i in range(40, 80):
        w = list(base)
        w[int(rng.integers(0, 100))] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, None if i % 2 else "") for i in range(30)] + [(200 + i, f"text number {i} of its own") for i in range(20)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {d: 0 if d < 80 else d for d, _ in rows}
    left = neardup.without_near_copies(spark.createDataFrame(rows, DOCS))
    assert {r.doc_id for r in left.collect()} == {0, *(d for d, _ in rows if d >= 100)}


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError):
        common.shared_folder(Session)
