"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learn from document labels.

A document is toxic if any sentence is: P(doc) = 1 - (1 - P0) prod(1 - P(sentence)). Sentence scores are logistic in
their words and parts of words, so inflected forms of a stem count too; a sentence in which nothing speaks for it adds
nothing, so a text isn't toxic for being long, and P0 stands once for each document. Only documents carry labels; the
gradient of the noisy-or sends the blame to the sentences that explain it, which are then reported.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import chunks, read, stored, utf8_bytes

HELD_OUT = 2
THRESHOLD = 0.3
SAMPLE = 4000  # labelled rows that the model is fitted on, at most
SAMPLE_BYTES = 24 << 20  # and the bytes of their texts
LEAST_GAIN = 9.0  # nats by which a part of a word must tell the labels apart, and no less than the log of the number of parts tried
PULL = 3e-4  # towards the prior
CACHED = 200_000

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    base: float  # log odds of a document without any evidence
    bias: float  # of a sentence with some, less its weights
    weights: dict[str, float]


def parts(word: str) -> set[str]:
    """The word and its beginnings of four to eight letters, which inflected forms of a stem share."""
    w = f"^{word}$"
    return {w, *(w[:n] for n in range(5, min(10, len(w))))}


def sentences(text: str | None) -> list[tuple[int, int, set[str]]]:
    """(start, end, distinct words) of each sentence; an empty text has one without words."""
    text = text or ""
    return [(m.start(), m.end(), set(WORD.findall(m.group().lower()))) for m in SENTENCE.finditer(text)] or [(0, 0, set())]


def fit(rows: list[tuple[str | None, int]], rounds: int = 300) -> Model:
    """Fit on (text, label) rows. Without both labels the score is the labels' mean everywhere."""
    rows = sorted({(t or "", label) for t, label in rows})  # copies tell nothing new
    y = np.array([r[1] for r in rows], float)
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.0
        return Model(math.log((p + 1e-3) / (1 - p + 1e-3)), 0.0, {})
    vocabulary: dict[str, int] = {}
    tokens, lengths, per_doc = array("i"), array("i"), array("i")  # distinct words of each sentence, all in a row
    for text, _ in rows:
        found = sentences(text)
        per_doc.append(len(found))
        for _, _, ws in found:
            lengths.append(len(ws))
            tokens.extend(vocabulary.setdefault(w, len(vocabulary)) for w in ws)
    rows.clear()  # the texts aren't needed any more
    tokens, lengths, per_doc = (np.frombuffer(x, "i4") for x in (tokens, lengths, per_doc))
    n = len(lengths)
    doc = np.repeat(np.arange(len(y), dtype="i4"), per_doc)
    at = np.repeat(np.arange(n, dtype="i4"), lengths)  # the sentence of each word
    # screen: parts of words that are commoner in toxic documents than chance allows
    once = doc[at].astype("i8") * len(vocabulary) + tokens
    once.sort()
    once = once[np.diff(once, prepend=-1) > 0]  # a word counts once a document
    word_of, toxic = (once % len(vocabulary)).astype("i4"), y[once // len(vocabulary)] > 0
    in1, in0 = (np.bincount(word_of[x], minlength=len(vocabulary)).tolist() for x in (toxic, ~toxic))
    del once, word_of, toxic
    n1, n0 = y.sum(), len(y) - y.sum()
    initials: dict[str, list[str]] = {}
    for word in vocabulary:
        initials.setdefault(word[0], []).append(word)
    seen: dict[str, tuple[float, int, int]] = {}  # a part's gain, its toxic and its other documents (by words)
    tried = 0
    for some in initials.values():  # words share parts only with those of the same first letter
        seen1: Counter = Counter()
        seen0: Counter = Counter()
        for word in some:
            if c := in1[vocabulary[word]]:
                for f in parts(word):
                    seen1[f] += c
        for word in some:
            if c := in0[vocabulary[word]]:
                for f in parts(word):
                    if f in seen1:
                        seen0[f] += c
        tried += len(seen1)
        for f, a in seen1.items():
            b = seen0.get(f, 0)
            if a * n0 > b * n1:
                gain = a * math.log(a * len(y) / ((a + b) * n1)) + (b * math.log(b * len(y) / ((a + b) * n0)) if b else 0.0)
                if gain > LEAST_GAIN:
                    seen[f] = gain, a, b
    seen = {f: x for f, x in seen.items() if x[0] > math.log(tried)}
    # of parts that always come together, such as those of one rare word, one stays
    alike: dict[tuple[int, int], list[str]] = {}
    for f in sorted(seen, key=lambda f: (f.endswith("$"), -len(f), f)):
        same = alike.setdefault(seen[f][1:], [])
        if not any(f in g or g in f for g in same):
            same.append(f)
    chosen = sorted((f for same in alike.values() for f in same), key=lambda f: (-seen[f][0], f))
    odds = np.array([math.log((seen[f][1] + 0.5) / (n1 + 1)) - math.log((seen[f][2] + 0.5) / (n0 + 1)) for f in chosen])
    number = {f: i for i, f in enumerate(chosen)}
    known = {i: ids for i, word in enumerate(vocabulary) if (ids := [number[f] for f in parts(word) if f in number])}
    spoken = np.zeros(len(vocabulary), bool)
    spoken[list(known)] = True
    hit = np.flatnonzero(spoken[tokens])
    pairs = np.unique(np.array([(s, f) for s, t in zip(at[hit].tolist(), tokens[hit].tolist()) for f in known[t]], "i8").reshape(-1, 2), axis=0)
    held, sentence = np.unique(pairs[:, 0], return_inverse=True)  # sentences with evidence only
    feature, doc, n = pairs[:, 1], doc[held], len(held)
    # The prior: each part's own log odds. Without it, words that share documents explain each other away.
    w = np.concatenate([odds, [-4.0, -4.0]])
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = np.where(y > 0, min(5.0, n0 / n1), 1.0)
    chance = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, rounds + 1):
        p, p0 = chance(w[-2] + np.bincount(sentence, w[feature], n)), chance(w[-1])
        none = np.exp(np.log1p(-p0) + np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)))  # chance of no toxic sentence
        pull = np.where(y > 0, -none / np.maximum(1 - none, 1e-9), 1.0) * weight
        g_z = p * pull[doc]
        g = np.concatenate([np.bincount(feature, g_z[sentence], len(chosen)), [g_z.sum(), p0 * pull.sum()]]) / len(y)
        g[:-2] += PULL * (w[:-2] - odds)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(float(w[-1]), float(w[-2]), {f: float(x) for f, x in zip(chosen, w)})


class Scorer:
    """Scores of words are looked up once a worker, in bounded space."""

    def __init__(self, model: Model) -> None:
        self.model, self.words = model, {}

    def features(self, word: str) -> frozenset[str]:
        found = self.words.get(word)
        if found is None:
            if len(self.words) > CACHED:
                self.words.clear()
            weights = self.model.weights
            found = self.words[word] = frozenset(f for f in parts(word) if f in weights)
        return found

    def __call__(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and each sentence's (start, end, score) where something speaks for it."""
        base, bias, weights = self.model
        none, found = math.log1p(-1 / (1 + math.exp(-max(-30.0, min(30.0, base))))), []
        for start, end, words in sentences(text):
            hits = set().union(*(f for f in map(self.features, words) if f))
            if hits:
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(weights[f] for f in sorted(hits))))))
                found.append((start, end, p))
                none += math.log1p(-min(p, 1 - 1e-12))
        return -math.expm1(none), found


def remainder() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out quarter, picked by the hash of doc_id, and of these on
    the first that have no more than ``sample_bytes`` of text together.

    A doc_id labelled twice is toxic if any label says so; labels other than 0 and 1 are left out; of several texts under
    one doc_id the fit takes that of the smallest hash.
    """
    rows = labels.where("doc_id is not null and toxic in (0, 1)").where(remainder() != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    met = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # no more than ``sample`` ids
    texts = stored(met.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).withColumns({"order": F.xxhash64("doc_id"), "bytes": utf8_bytes("text")}))
    left, ids = sample_bytes, []
    for r in texts.select("doc_id", "order", "bytes").orderBy("order", "doc_id").collect():  # a row an id
        if r.bytes <= left:
            left, ids = left - r.bytes, [*ids, r.doc_id]
    taken = texts.where(F.col("doc_id").isin(ids)) if len(ids) < sample else texts
    return fit([(r.text, r.toxic) for r in taken.select("text", "toxic").collect()])  # fit() puts them in order


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every row of ``docs(doc_id, text, ...)``.

    ``spans`` are the offending sentences, ``start:end`` in code points, those with a chance of at least one half.
    A null text counts as empty and gets the score of a text without evidence; a null doc_id is not held out; repeated
    rows give repeated results; other columns are ignored; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for whole in batches:
            for b in chunks(whole, "text"):
                scores, spans = [], []
                for text in b.column("text").to_pylist():
                    p, found = scorer(text)
                    scores.append(p)
                    spans.append(",".join(f"{s}:{e}" for s, e, q in found if q >= 0.5))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, pa.string())], names=["doc_id", "score", "spans"])

    out = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, score double, spans string")
    return out.select("doc_id", F.coalesce(remainder() == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


def not_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series([scorer(t)[0] for t in texts], dtype="f8")

    return docs.where(scores("text") < THRESHOLD)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
