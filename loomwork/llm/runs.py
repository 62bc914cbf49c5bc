"""Runs of repeated words: a sparse dynamic programme over diagonals, word by word.

A diagonal is a lag q; its match length grows by one for every word that equals the word q before it, and a diagonal
that a word does not carry on ends. A run is a diagonal that ends with a length of four periods or more. Of a word's
earlier occurrences only those are listed that can carry on such a run: the last one that agrees on a context of b words,
where b is the power of two with b/2 < q <= b. In a run of four periods that occurrence is exactly one period back
(a primitive word does not occur inside its own square but at its ends), and no lag that is a multiple of the period is
ever listed, so a text of n words has O(n log n) entries even if it is one word n times. Contexts are named by doubling,
and only words with a context that occurs again are looked at any further.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import chunks, read

POWER = 4  # periods that a run holds at least
SHORTEST = 6  # and words
SPACE = r"[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def listed_lags(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, lags) of the earlier occurrences that can carry on a run, by position, then lag.

    ``words``: numbers of the words of one text or of several, one behind the other, that share no numbers; ``longest`` has
    so many words.
    """
    found_at, found_lag = [], []
    at = np.arange(len(words))
    keys = words.astype("i8")
    names = np.empty(len(words), "i8")
    block = 1
    while len(at):
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]  # equal contexts together, each by position
        again = keys[1:] == keys[:-1]
        lag = at[1:] - at[:-1]
        fits = again & (2 * lag > block) & (lag <= block)
        found_at.append(at[1:][fits])
        found_lag.append(lag[fits])
        if POWER * block // 2 >= longest:
            break
        repeated = np.zeros(len(at), bool)
        repeated[1:] |= again
        repeated[:-1] |= again
        names[:] = -1
        names[at[repeated]] = np.concatenate(([0], np.cumsum(~again)))[repeated]
        at = np.sort(at[repeated])
        at = at[at >= block]
        at = at[names[at - block] >= 0]
        keys = names[at - block] * len(words) + names[at]
        block *= 2
    if not found_at:
        return np.empty(0, "i8"), np.empty(0, "i8")
    at, lag = np.concatenate(found_at), np.concatenate(found_lag)
    order = np.lexsort((lag, at))
    return at[order], lag[order]


def periodic_runs(words: np.ndarray, longest: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of every run, each as soon as its diagonal ends."""
    at, lags = listed_lags(words, len(words) if longest is None else longest)

    def ended(q: int, since: int, last: int) -> Iterator[tuple[int, int, int]]:
        start = since - q - (1 << (q - 1).bit_length()) + 1  # the context was matched at once
        if last + 1 - start >= max(SHORTEST, POWER * q):
            yield start, last + 1 - start, q

    active: dict[int, int] = {}  # lag: the position where its diagonal was first carried on
    last = -2
    for i, entries in groupby(zip(at.tolist(), lags.tolist()), itemgetter(0)):
        before, active = active, {}
        for _, q in entries:
            active[q] = before.pop(q, i) if i == last + 1 else i
        for q, since in before.items():
            yield from ended(q, since, last)
        last = i
    for q, since in active.items():
        yield from ended(q, since, last)


def runs_of_texts(texts: list[bytes]) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(words, runs by start and period, text without the repeats) of each text."""
    split = [t.split() for t in texts]  # bytes are split on the six characters of SPACE
    numbers: list[int] = []
    base = 0
    for words in split:
        known: dict[bytes, int] = {}
        numbers.extend([base + known.setdefault(w, len(known)) for w in words])
        base += len(known)
    starts = np.cumsum([0, *map(len, split)])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, q in periodic_runs(np.array(numbers, "i8"), max(map(len, split), default=0)):
        k = int(np.searchsorted(starts, start, "right")) - 1
        found[k].append((start - int(starts[k]), length, q))
    out = []
    for words, runs in zip(split, found):
        runs.sort(key=itemgetter(0, 2))
        kept = words
        if runs:
            drop = np.zeros(len(words), bool)
            for start, length, q in runs:
                drop[start + q : start + length] = True
            kept = [words[i] for i in np.flatnonzero(~drop).tolist()]
        out.append((len(words), runs, b" ".join(kept)))
    return out


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        for part in chunks(batch, "text"):
            found = runs_of_texts(part.column("text").cast(pa.binary()).to_pylist())
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for _, r, _ in found]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([n for n, _, _ in found], pa.int64()), pa.array(runs, kind), pa.array([t.decode() for _, _, t in found], pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )


def find_runs(docs: DataFrame) -> DataFrame:
    """Periodic runs of every whole text of ``docs(doc_id, text, ...)``, a row a row.

    Returns doc_id, n_words, runs (start, length, period in words, by start and period) and collapsed: the words joined by one
    space, without those that a run holds behind its first period. A null text counts as empty and has no runs; an empty
    table gives no rows; repeated rows and null ids stay as they are; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_find, SCHEMA)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeats of runs taken out of their texts; rows without runs keep theirs as it is.

    Null texts stay null; ``docs`` may not hold a column named ``_collapsed``.
    """
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = part.column("text").to_pylist()
                found = runs_of_texts([(t or "").encode() for t in texts])
                new = pa.array([c.decode() if runs else t for t, (_, runs, c) in zip(texts, found)], pa.string())
                yield pa.RecordBatch.from_arrays([new if n == "text" else part.column(n) for n in names], names)

    return docs.mapInArrow(cut, docs.schema)


def with_loops(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with loops in a tenth of the texts: with h = crc32(doc_id), g = h // 10 and h % 10 = 0, each of
    the n words from a = g % n on becomes one of the p = 1 + (n - a) // (3 + g % 8) words from there, in turn."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda w: w != ""))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    loop = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    looped = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), loop), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), looped).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Digest columns of ``find_runs``: the longest run (ties to the smallest start, then period) and two SHA-256."""
    best: Column = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_runs(with_loops(read(spark, sf_dir, "documents"))))
