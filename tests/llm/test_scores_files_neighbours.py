"""Toxicity by its formula and whatever a text's length; media files of others; neighbours in many leaves; planted keys."""

import hashlib
import math
import random
import re
import string
from collections import defaultdict

import numpy as np
import pytest

from loomwork.llm import ann, media, mixing, pii, secrets, toxicity

SCHEMA = "doc_id long, text string, spans string, score double"


# --- toxicity

MODEL = toxicity.Model(-5.0, -4.0, {"^zonk": 6.0, "^zonker$": 1.5, "^mild$": 1.0, "^calm$": -3.0})


def brute_score(text):
    stay = 1 - 1 / (1 + math.exp(5.0))
    for sentence in re.split(r"[.!?\n]", text or ""):
        hits = set()
        for word in re.findall(r"[a-z]+", sentence.lower()):
            hits |= {f for f in MODEL.weights if f == f"^{word}$" or (not f.endswith("$") and f"^{word}$".startswith(f) and 5 <= len(f) <= 9)}
        if hits:
            stay *= 1 - 1 / (1 + math.exp(4.0 - sum(MODEL.weights[f] for f in hits)))
    return 1 - stay


def test_score_is_noisy_or(spark):
    rng = random.Random(3)
    words = ["zonker", "zonking", "mild", "calm", "plain", "word", "zon"]
    texts = [". ".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 9))) for _ in range(60)] + [None, "", "...", "x" * 100_000 + " zonker"]
    out = toxicity.score(spark.createDataFrame([(i, t, "x", 0.5) for i, t in enumerate(texts)], SCHEMA), MODEL).collect()
    assert len(out) == len(texts)
    for r in out:
        assert r.score == pytest.approx(brute_score(texts[r.doc_id]), abs=1e-12) and r.predicted == int(r.score >= 0.3)


def marked(spark, neutral):
    rng = np.random.default_rng(2)
    calm = [f"w{i}{c}" for i in range(150) for c in "abc"]
    say = lambda n: ". ".join(" ".join(rng.choice(calm, 8)) for _ in range(n))
    rows = [(i, f"{say(int(rng.integers(1, 10)))}. {'you are a zonker' if i % 5 == 0 else 'and so on'}. {say(2)}.") for i in range(400)]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows + neutral], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_length_alone_is_not_toxic(spark):
    docs, labels = marked(spark, [(9000, "the sea is calm today. " * 20_000), (9001, "w1a w2b w3c. " * 20_000), (9002, "the sea is calm. " * 5_000 + "what a zonker. " + "all is well. " * 5_000), (9003, "")])
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).where("doc_id >= 9000").collect()}
    assert got[9000].score == got[9001].score == got[9003].score < 0.3 and got[9002].predicted == 1
    assert got[9002].spans.count(":") == 1


def test_sample_is_bounded_in_bytes_and_rows(spark):
    docs, labels = marked(spark, [(5, f"copy {i}") for i in range(300)] + [(7, "long " * 200_000)])
    whole, some = toxicity.train(docs, labels), toxicity.train(docs, labels, sample_bytes=60_000)
    assert whole.weights and any(f.startswith("^zonk") for f in some.weights)
    assert toxicity.train(docs, labels, sample=4) == toxicity.train(docs, labels, sample=4)


# --- media


def test_null_broken_and_foreign_files(spark):
    good = media.encode([b"x" * 192])[0]
    grey = b"\xff\xd8" + media.segment(0xDB, b"\0" + b"\1" * 64) + media.segment(0xC0, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0]))
    table = bytes([1] + [0] * 15) + b"\0"
    grey += media.segment(0xC4, b"\x00" + table) + media.segment(0xC4, b"\x10" + table) + media.segment(0xDA, b"\1\1\0\0\x3f\0") + b"\x3f\xff\xd9"
    huge = good.replace(media.segment(0xC0, good[good.index(b"\xff\xc0") + 4 : good.index(b"\xff\xc0") + 19]), media.segment(0xC0, bytes([8, 255, 255, 255, 255, 3]) + good[good.index(b"\xff\xc0") + 10 : good.index(b"\xff\xc0") + 19]))
    files = [good, None, b"", b"no image", good[:40], good[:-60] + b"\xff\xd9", grey, huge, b"\xff\xd8\xff", good]
    df = spark.createDataFrame([(i, 5, x, "e") for i, x in enumerate(files)], "doc_id long, n_bytes long, media binary, error string")
    out = {r.doc_id: r for r in media.features(df, keep_payload=True).collect()}
    assert len(out) == len(files)
    assert all(out[i].error is None and bytes(out[i].payload) == b"x" * 192 for i in (0, 9))
    assert out[6].error is None and out[6].payload_sha256 is None and out[6].payload is None and (out[6].width, out[6].height) == (8, 8) and out[6].feature.startswith("8x8:")
    for i in (1, 2, 3, 4, 5, 7, 8):
        assert out[i].error and out[i].feature is None and out[i].payload_sha256 is None, i
    assert out[1].media_bytes is None and out[3].media_sha256 == hashlib.sha256(b"no image").hexdigest()


# --- neighbours


def test_neighbours_in_many_leaves(spark, monkeypatch):
    for name, value in (("LEAF", 64), ("SAMPLE", 256), ("QUERY_BLOCK", 8)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 24)) * 3
    x = centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 24))
    x[1000:1400] = centres[3] + 1e-9 * rng.standard_normal((400, 24))  # more than a leaf that no cut divides well
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(ann.nearest(df, df.where("vec_id % 25 = 0")).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    hits = near = 0
    for q in range(0, 4000, 25):
        s = unit @ unit[q]
        s[q] = -9
        top = np.lexsort((np.arange(4000), -s))[:5]
        hits += len({v for v, _ in got[q]} & set(top.tolist()))
        near += sum(c >= s[top[-1]] - 1e-12 for _, c in got[q])
        assert len(got[q]) == 5 and all(abs(s[v] - c) < 1e-12 for v, c in got[q])
    assert near >= 0.9 * 5 * 160, (hits, near)


def test_grafted_tree_is_a_partition():
    rng = np.random.default_rng(6)
    points = rng.standard_normal((500, 4))
    top = ann.grow(points[:100], 3)
    leaf = top.leaf(points)
    whole = ann.grafted(top, {i: ann.grow(points[leaf == i], 2) for i in range(8) if i != 5}, 2)
    cells = whole.leaf(points)
    assert (cells >> 2 == leaf).all() and set(cells[leaf == 5]) == {5 << 2}
    assert ((points >= whole.low[cells]) & (points <= whole.high[cells])).all()


# --- secrets

ALPHABETS = {"base62": string.ascii_letters + string.digits, "base32": string.ascii_uppercase + "234567", "lower": string.ascii_lowercase, "upper": string.ascii_uppercase, "lower_digits": string.ascii_lowercase + string.digits, "base64": string.ascii_letters + string.digits + "+/"}


@pytest.mark.parametrize("kind", ALPHABETS)
def test_planted_keys_are_found(spark, kind):
    rng = random.Random(7)
    rows = []
    for i in range(200):
        key = "A" + "".join(rng.choice(ALPHABETS[kind]) for _ in range(rng.choice([18, 22, 30, 38]))) + "b"
        rows.append((i, f"Here are words before {key} and some words after it.", "x", 0.5))
    rows += [(1000 + i, f"Here are words before internationalization-of-organizations and {i} words after it.", "x", 0.5) for i in range(50)]
    out = secrets.find_secrets(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.n_random > 0 for r in out if r.doc_id < 1000) >= 0.95 * 200
    assert not any(r.n_random for r in out if r.doc_id >= 1000)


# --- personal data


def test_joined_terms_give_the_same(spark, monkeypatch):
    rows = [(i, f"please write to Kingfisher under k.f@mail.example.org today note{i}", "x", 0.5) for i in range(4)] + [(20 + i, f"please write under pressure today {i}", "x", 0.5) for i in range(60)] + [(99, "Kingfisher", "x", 0.5), (None, "Kingfisher", "x", 0.5)]
    df = spark.createDataFrame(rows, SCHEMA)
    first = sorted(map(str, pii.sanitise(df, with_text=True).collect()))
    monkeypatch.setattr(pii, "LITERALS", 0)
    assert sorted(map(str, pii.sanitise(df, with_text=True).collect())) == first
    assert sum("n_base=1, n_terms=1" in r for r in first) == 4


def test_raking_says_what_it_missed(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 30)], "_mix_source string, _mix_lang string, _mix_topic string, tokens long")
    share = lambda a, b: spark.createDataFrame(list(zip(a, b)), "value string, share double")
    torn = mixing.rake(cells, {"source": share("ab", [0.5, 0.5]), "lang": share("xy", [0.9, 0.1])}, sweeps=5)
    assert torn.first().miss > 0.1  # no weights can meet both
    assert mixing.rake(cells).first().miss < mixing.CLOSE


def test_files_without_a_segment_and_with_wrong_bytes_give_rows(spark):
    good = media.encode([b"some text of a document".ljust(384)])[0]
    cuts, at = [], 2
    while good[at] == 0xFF and good[at + 1] != 0xDA:
        length = int.from_bytes(good[at + 2 : at + 4], "big") + 2
        cuts.append(good[:at] + good[at + length :])
        at += length
    rng = np.random.default_rng(1)
    flipped = []
    for _ in range(300):
        x = bytearray(good)
        x[int(rng.integers(2, len(x)))] = int(rng.integers(256))
        flipped.append(bytes(x))
    files = [good, *cuts, *(good[:k] for k in range(0, len(good), 7)), *flipped, good]
    out = media.decoded(files)
    assert len(out) == len(files) and not isinstance(out[0], str) and not isinstance(out[-1], str) and out[0][2] == out[-1][2]
    assert all(isinstance(x, str) and x for x in out[2 : len(cuts) - 1])  # without quantiser, frame or codes
    rows = media.features(spark.createDataFrame([(i, 1, x) for i, x in enumerate(files)], "doc_id long, n_bytes long, media binary")).collect()
    assert len(rows) == len(files) and rows[0].error is None and rows[0].tail_crc32 is not None and {r.error for r in rows} > {None, "a table is missing"}
