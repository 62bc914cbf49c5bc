"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Each text gives a vector of six transformed statistics. For each language and source a minimum-covariance-determinant
estimate is fitted to the distinct vectors of all its documents: of three robust starts, concentration steps keep the half
of the vectors that is nearest to the current centre by Mahalanobis distance, and the start whose half ends with the
smallest determinant wins; a last step takes all vectors within the 97.5 % ellipse of that. Documents beyond the
ellipse that a normal vector leaves with chance TAIL are rejected.

A concentration step is one aggregate: distances fall into bins of a sixteenth of an octave, every bin keeps its sums, and
the nearest bins are added up until they hold half of the vectors. So a group of any size is a few hundred rows of sums
after partial aggregation, and no group meets in a task. Vectors are whole thousandths, which makes all sums exact and results
the same whatever order tasks end in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import chunks, read, salted_join, stored

LEAST_WORDS = 10  # fixed limits: fewer words fail,
MOST_REPEATED = 20  # and more than so many per cent of the words in windows that come again
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalpha())

#: The statistics and the least standard deviation of each, in its own units: what a clean text may well differ by.
VECTOR = {"length": 0.06, "symbols": 0.17, "lines": 0.3, "repeats": 0.3, "capitals": 0.13, "marks": 0.17}
UNIT = 1000
STEPS = 10  # concentration steps at most; the first two with all starts
LEAST_VECTORS = 60  # a group with fewer takes the estimate of its language, a language with fewer that of all
TAIL = 1e-9
INNER = 0.025  # outside of the ellipse whose vectors enter the last estimate
FACTS = 100_000  # rows of estimates that are broadcast, at most; beyond, they are joined

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = f"doc_id long, lang string, source string, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, {', '.join(f'x{i} int' for i in range(len(VECTOR)))}"
P = len(VECTOR)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
FIT = "fit string, start int, n long, kept long, centre array<double>, inverse array<double>, log_det double"


def again(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose key occurs twice or more, in order, and numbers of their keys."""
    _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
    many = count[name] > 1
    return at[many], name[many]


def in_repeated_windows(words: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words stand in a window that occurs twice or more. ``words``: numbers of the words of one text, or of several
    that share no numbers. Windows grow a word at a time, and only those that still repeat grow on."""
    n = len(words)
    cover = np.zeros(n + 1, "i8")
    at, name = again(words, np.arange(n))
    for k in range(1, window):
        fits = at + k < n
        at, name = at[fits], name[fits]
        at, name = again(name.astype("i8") * (int(words.max()) + 1 if n else 1) + words[at + k], at)
    cover[at] += 1
    cover[at + window] -= 1
    return np.cumsum(cover)[:n] > 0


def measured(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Columns of COUNTS and of VECTOR (thousandths) for each text."""
    raw = [t.encode() for t in texts]
    numbers: list[int] = []
    sizes, base = [], 0
    for b in raw:
        words, known = b.split(), {}
        numbers.extend([base + known.setdefault(w, len(known)) for w in words])
        sizes.append(len(words))
        base += len(known)
    n = np.array(sizes, "i8")
    ends = np.cumsum(n)
    sums = np.concatenate(([0], np.cumsum(in_repeated_windows(np.array(numbers, "i8")))))
    repeated = sums[ends] - sums[ends - n]
    chars = np.array([len(t) - sum(map(t.count, " \t\n\x0b\x0c\r")) for t in texts], "i8")
    without = lambda b, gone: len(b) - len(b.translate(None, gone))
    symbols, capitals, marks = (np.array([without(b, gone) for b in raw], "i8") for gone in (SYMBOLS, CAPITALS, MARKS))
    lines = [[x for x in b.split(b"\n") if x.strip()] for b in raw]
    all_lines = np.array([len(x) for x in lines], "i8")
    doubled = np.array([len(x) - len(set(x)) for x in lines], "i8")
    # shares are shrunk by some words, characters or lines, so that short texts don't stand out by chance
    share = lambda a, b, more: np.log1p(20 * a / (b + more))
    vector = [np.log((chars + 100) / (n + 20)), share(symbols, chars, 100), share(doubled, all_lines, 10), share(repeated, n, 50), share(capitals, chars, 100), share(marks, chars, 100)]
    return [n, chars, symbols, doubled, repeated], [np.rint(UNIT * v).astype("i4") for v in vector]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            counts, vector = measured(part.column("text").to_pylist())
            n, repeated = counts[0], counts[4]
            failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
            names = ["doc_id", "lang", "source", *COUNTS, "base_failed", *(f"x{i}" for i in range(P))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), *map(pa.array, counts), pa.array(failed), *map(pa.array, vector)], names)


def statistics(docs: DataFrame) -> DataFrame:
    """Counts, the fixed limits' verdict and the vector of every whole text of ``docs(doc_id, text, lang, source, ...)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_measure, SCHEMA)


def with_facts(rows: DataFrame, facts: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` with the facts of their key: broadcast after a count, else a join that splits hot keys."""
    if facts.limit(FACTS + 1).count() <= FACTS:
        return rows.join(F.broadcast(facts), key)
    return salted_join(rows, facts, key, by)


def fits_of(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group, fit) and (group, feeds): the estimate that each group takes and those that its vectors enter."""
    sizes = points.groupBy("lang", "source", "group").agg(F.count("*").alias("n"))
    language = F.to_json(F.struct(F.lit("language").alias("of"), "lang"))
    sizes = stored(sizes.withColumn("language", language))
    totals = sizes.groupBy("language").agg(F.sum("n").alias("in_language"))
    fit = F.when(F.col("n") >= LEAST_VECTORS, F.col("group")).when(F.col("in_language") >= LEAST_VECTORS, F.col("language")).otherwise("all")
    chosen = sizes.join(totals, "language").select("group", "language", fit.alias("fit"))
    wanted = stored(chosen.select(F.col("fit").alias("wanted")).distinct())
    feeds = chosen.select("group", F.explode(F.array("group", "language", F.lit("all"))).alias("wanted")).join(wanted, "wanted")
    return chosen.select("group", "fit"), feeds.groupBy("group").agg(F.collect_set("wanted").alias("feeds"))


def x(i: int) -> Column:
    return F.col(f"x{i}")


def chi_square_tail(value: float, df: int) -> float:
    """P(chi-square > value) for an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, df // 2):
        term *= value / 2 / k
        total += term
    return math.exp(-value / 2) * total


def chi_square_limit(tail: float, df: int) -> float:
    """The value that a chi-square variable exceeds with chance ``tail``."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_tail(mid, df) > tail else (low, mid)
    return (low + high) / 2


def square(half: np.ndarray) -> np.ndarray:
    out = np.zeros((P, P))
    for (i, j), v in zip(PAIRS, half):
        out[i, j] = out[j, i] = v
    return out


LEAST_VARIANCE = np.diag([s * s for s in VECTOR.values()])


def estimate(kept: int, share: float, first: np.ndarray, second: np.ndarray) -> tuple[list[float], list[float], float]:
    """Centre, inverse scatter (half) and log determinant from sums over ``kept`` vectors, the nearest ``share`` of a normal sample."""
    centre = first / kept / UNIT
    scatter = square(second) / kept / UNIT**2 - np.outer(centre, centre)
    if share < 1:  # what that part is too narrow by
        scatter = scatter * share / (1 - chi_square_tail(chi_square_limit(1 - share, P), P + 2))
    scatter = scatter + LEAST_VARIANCE
    inverse = np.linalg.inv(scatter)
    return centre.tolist(), [float(inverse[i, j]) for i, j in PAIRS], float(np.linalg.slogdet(scatter)[1])


def _start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three robust starts of each fit: the marginal spreads alone, with the correlation of squashed values, and with that of
    directions."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            spread = np.array(r["spread"])
            for k, sums in enumerate((None, r["squashed"], r["directions"])):
                scatter = np.eye(P) if sums is None else square(np.array(sums, float)) / 1e6 / r["n"]
                scatter = scatter / max(np.trace(scatter) / P, 1e-9) + 0.05 * np.eye(P)
                inverse = np.linalg.inv(scatter) / np.outer(spread, spread)
                out.append({"fit": r["fit"], "start": k, "n": r["n"], "kept": 0, "centre": r["centre"], "inverse": [float(inverse[i, j]) for i, j in PAIRS], "log_det": math.inf})
        yield pa.RecordBatch.from_pylist(out, schema=batch_schema())


def batch_schema() -> pa.Schema:
    return pa.schema([("fit", pa.string()), ("start", pa.int32()), ("n", pa.int64()), ("kept", pa.int64()), ("centre", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64())), ("log_det", pa.float64())])


def _concentrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            n = sum(b["n"] for b in r["bins"])
            half, kept = (n + P + 1) // 2, 0
            first, second = np.zeros(P), np.zeros(len(PAIRS))
            for b in sorted(r["bins"], key=lambda b: b["bin"]):
                if kept >= half and not r["all"]:
                    break
                kept += b["n"]
                first += b["first"]
                second += b["second"]
            centre, inverse, log_det = estimate(kept, 1 - INNER if r["all"] else kept / n, first, second)
            out.append({"fit": r["fit"], "start": r["start"], "n": n, "kept": kept, "centre": centre, "inverse": inverse, "log_det": log_det})
        yield pa.RecordBatch.from_pylist(out, schema=batch_schema())


def distance() -> Column:
    """Squared Mahalanobis distance of x0, x1, ... from ``centre`` under ``inverse``."""
    off = [x(i) / UNIT - F.col("centre")[i] for i in range(P)]
    terms = [(1 if i == j else 2) * F.col("inverse")[k] * off[i] * off[j] for k, (i, j) in enumerate(PAIRS)]
    return sum(terms[1:], terms[0])


def concentrated(fed: DataFrame, fits: DataFrame, within: float | None = None) -> DataFrame:
    """One concentration step of every (fit, start); with ``within``, all vectors of at most that distance are taken."""
    rows = with_facts(fed, fits.select("fit", "start", "centre", "inverse"), "fit", "x0").withColumn("d", distance())
    if within is not None:
        rows = rows.where(F.col("d") <= within)
    place = F.floor(16 * F.log2(F.greatest("d", F.lit(1e-6)))).cast("int") if within is None else F.lit(0)
    sums = [F.sum(x(i).cast("long")).alias(f"s{i}") for i in range(P)] + [F.sum(x(i).cast("long") * x(j)).alias(f"s{i}{j}") for i, j in PAIRS]
    bins = rows.groupBy("fit", "start", place.alias("bin")).agg(F.count("*").alias("n"), *sums)
    one = F.struct("bin", "n", F.array(*[F.col(f"s{i}") for i in range(P)]).alias("first"), F.array(*[F.col(f"s{i}{j}") for i, j in PAIRS]).alias("second"))
    gathered = bins.groupBy("fit", "start").agg(F.collect_list(one).alias("bins"))  # a fit has a few hundred bins, however large it is
    return stored(gathered.withColumn("all", F.lit(within is not None)).mapInArrow(_concentrate, FIT))


def estimates(points: DataFrame) -> DataFrame:
    """(fit, n, kept, centre, inverse, log_det) of the fits that ``points(fit, x0, x1, ...)`` feeds; one row a vector."""
    thirds = [F.percentile(x(i), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i in range(P)]  # over whole thousandths: few values
    middle = points.groupBy("fit").agg(F.count("*").alias("n"), *thirds)
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / (1.349 * UNIT), F.lit(s)) for i, s in enumerate(VECTOR.values())]
    middle = stored(middle.select("fit", "n", F.array(*[F.col(f"q{i}")[1] / UNIT for i in range(P)]).alias("centre"), F.array(*spread).alias("spread")))
    scaled = with_facts(points, middle, "fit", "x0").select("fit", *((x(i) / UNIT - F.col("centre")[i]).alias(f"o{i}") for i in range(P)), "spread")
    scaled = scaled.select("fit", *((F.col(f"o{i}") / F.col("spread")[i]).alias(f"z{i}") for i in range(P)))
    norm = F.greatest(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, P)), F.col("z0") * F.col("z0")), F.lit(1e-9))
    whole = lambda c: F.sum(F.round(1e6 * c).cast("long"))  # noqa: E731  exact in any order
    shapes = scaled.withColumn("norm", norm).groupBy("fit").agg(
        *(whole(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"t{i}{j}") for i, j in PAIRS), *(whole(F.col(f"z{i}") * F.col(f"z{j}") / F.col("norm")).alias(f"u{i}{j}") for i, j in PAIRS)
    )
    shapes = shapes.select("fit", F.array(*[F.col(f"t{i}{j}") for i, j in PAIRS]).alias("squashed"), F.array(*[F.col(f"u{i}{j}") for i, j in PAIRS]).alias("directions"))
    fits = stored(middle.join(shapes, "fit").mapInArrow(_start, FIT))
    for k in range(STEPS):
        new = concentrated(points, fits)
        if k == 1:  # the most promising start goes on
            best = new.groupBy("fit").agg(F.min_by("start", F.struct("log_det", "start")).alias("start"))
            new = stored(new.join(best, ["fit", "start"]))
        ended = k > 1 and not new.join(fits.select("fit", F.col("log_det").alias("before")), "fit").where("log_det < before - 1e-6").limit(1).count()
        fits = new
        if ended:
            break
    last = concentrated(points, fits, chi_square_limit(INNER, P)).drop("start")
    return last


def judged(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """The quality of every whole text of ``docs(doc_id, text, lang, source, ...)``, a row a row.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance (squared
    Mahalanobis; null for rows that the fixed limits reject) and fit, the group that was compared with. A null text counts as
    empty, which fails; null languages and sources are values of their own; texts that fail the limits enter no estimate, equal
    vectors of a group enter once. An empty table gives no rows; other columns are ignored.
    """
    group = F.to_json(F.struct(F.lit("source").alias("of"), "lang", "source"))
    rows = stored(statistics(docs).withColumn("group", group))
    xs = [f"x{i}" for i in range(P)]
    points = stored(rows.where("not base_failed").select("lang", "source", "group", *xs).distinct())
    taken, feeds = fits_of(points)
    fed = stored(with_facts(points.drop("lang", "source"), feeds, "group", "x0").select(F.explode("feeds").alias("fit"), *xs))
    fits = estimates(fed).select("fit", "centre", "inverse")
    facts = stored(taken.join(fits, "fit"))
    passed = with_facts(rows.where("not base_failed"), facts, "group", "doc_id").withColumn("distance", distance())
    names = ["doc_id", *COUNTS, "base_failed"]
    passed = passed.select(*names, (F.col("distance") <= chi_square_limit(tail, P)).alias("kept"), "distance", "fit")
    failed = rows.where("base_failed").select(*names, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"), F.lit(None).cast("string").alias("fit"))
    return passed.unionByName(failed)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents"))
