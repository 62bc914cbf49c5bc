"""MinHash near-duplicates by min-max hashing: both the smallest and the largest value under each permutation.

Each of the two agrees between two documents with a chance equal to their Jaccard similarity, so half the
permutations give a signature of full length. Banded signatures propose pairs, pairs are confirmed on full
shingle sets, and confirmed links are joined into components.

How groups stay bounded: documents with equal sets are one class from the start; in a bucket (a band value)
each class is first compared with one hub only, the member that shares most bucket places, so proposals grow
with the rows and not with the square of a bucket. What hubs leave open (members of one bucket that are in
different components) is compared in blocks of bounded size, on signatures first and then on full sets in the
same task, so no link is lost and no pairs are given out but links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import checkpoint, chunks, components, hot_keys, read, salted_join, stored

WIDTH = 5  # words in a shingle
LINK = (85, 100)
MISS = 4e-7  # chance that a pair right at the threshold shares no band
UNLIKE = 1e-7  # chance that its signatures agree in fewer values than the filter asks for
MOST_BANDS = 24
BLOCK = 512  # classes of a bucket that meet in one task
CACHED = 200_000


class Plan(NamedTuple):
    """What follows from a threshold: bands of so many rows, and the least number of signature values that agree."""

    link: tuple[int, int]
    bands: int
    rows: int
    floor: int


def plan_of(link: tuple[int, int]) -> Plan:
    """The longest bands of which MOST_BANDS or fewer miss a pair at the threshold with a chance under MISS."""
    s = link[0] / link[1]
    if not 0.5 <= s < 1:
        raise ValueError("the threshold must be at least 0.5 and below 1")
    need = lambda rows: math.ceil(math.log(MISS) / math.log1p(-(s**rows)))
    rows = max((r for r in range(1, 9) if need(r) <= MOST_BANDS), default=1)
    bands = need(rows)
    bands += bands * rows % 2  # smallest and largest values come in pairs
    values, below, floor = bands * rows, 0.0, 0
    while below + (chance := math.comb(values, floor) * s**floor * (1 - s) ** (values - floor)) < UNLIKE:
        below, floor = below + chance, floor + 1
    return Plan(link, bands, rows, floor)


def constants(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_917)
    return rng.integers(0, 1 << 63, permutations, dtype="u8") * 2 + 1, rng.integers(0, 1 << 63, permutations, dtype="u8")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes. Words' hashes are cached in bounded space."""

    def __init__(self) -> None:
        self.cache: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return np.zeros(0, "u8")
        cache = self.cache
        if len(cache) > CACHED:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = xxhash.xxh3_64_intdigest(w)
        w = np.array([cache[x] for x in words], "u8")
        n = max(1, len(w) - WIDTH + 1)
        h = np.full(n, min(len(w), WIDTH), "u8")
        for i in range(min(len(w), WIDTH)):
            h = mixed(h ^ w[i : i + n]) + np.uint64(0x9E3779B97F4A7C15)
        return np.unique(h)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest and largest value under each permutation, side by side."""
    out = np.empty((len(a), 2), "u8")
    for at in range(0, len(a), 8):  # eight permutations at a time keep a long text's rows in cache
        v = shingles[None, :] * a[at : at + 8, None] + b[at : at + 8, None]
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        out[at : at + 8, 0], out[at : at + 8, 1] = v.min(1), v.max(1)
    return out.ravel()


def sketches(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, sig, bands): the set's 128-bit digest, one byte of each signature value, band hashes."""
    n_bands, n_rows = plan.bands, plan.rows
    a, b = constants(n_bands * n_rows // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        salt = np.arange(1, n_bands + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
        for whole in batches:
            for batch in chunks(whole, "text"):
                counts, keys, sigs, bands = [], [], [], []
                for text in batch.column("text").to_pylist():
                    s = shingle(text)
                    counts.append(len(s))
                    if not len(s):
                        keys.append(None), sigs.append(None), bands.append(None)
                        continue
                    sig = signature(s, a, b)
                    h = salt.copy()
                    for column in sig.reshape(n_bands, n_rows).T:
                        h = mixed(h ^ column)
                    keys.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                    sigs.append(sig.astype("u1").tobytes())  # low bytes; the high ones of minima are all near zero
                    bands.append(h.view("i8"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(counts, pa.int64()), pa.array(keys, pa.string()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_key", "n_shingles", "set_key", "sig", "bands"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text", "xxhash64(text) text_key").mapInArrow(run, "doc_id bigint, text_key bigint, n_shingles bigint, set_key string, sig binary, bands array<bigint>")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the classes in ``wanted(node, doc_id, text_key)``: full sets, computed again from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for whole in batches:
            for batch in chunks(whole, "text"):
                sets = [shingle(t) for t in batch.column("text").to_pylist()]
                same = pa.array([xxhash.xxh3_128_hexdigest(x.tobytes()) == k for x, k in zip(sets, batch.column("node").to_pylist())], pa.bool_())  # not another text of the same doc_id
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.view("i8") for x in sets], pa.list_(pa.int64()))], names=["node", "shingles"]).filter(same)

    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text", "xxhash64(text) text_key")
    texts = rows.join(wanted, ["doc_id", "text_key"]).select("node", "text")
    nameless = rows.where("doc_id is null").dropDuplicates(["text_key"]).drop("doc_id")  # found by their text
    texts = texts.unionByName(nameless.join(wanted.where("doc_id is null").drop("doc_id"), "text_key").select("node", "text"))
    return texts.mapInArrow(run, "node string, shingles array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, link: tuple[int, int]) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets, of ``sets(node, shingles)``, overlap enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - both
    # the hubs (b) meet last: their sets aren't shuffled once a pair; the pairs of a hub that has very many are dealt out
    hot = hot_keys(pairs, "b")
    return checkpoint(salted_join(pairs.join(left, "a"), right, "b", "a", hot=hot).where(both * link[1] >= union * link[0]).select("a", "b"))


def near_enough(m: str, n: str, link: tuple[int, int]) -> F.Column:
    """No two sets whose sizes differ more can be linked."""
    return (F.least(m, n) * link[1] >= F.greatest(m, n) * link[0])


def open_links(members: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) between members of one bucket that are in different components.

    ``members(band, bucket, m, node, n, sig, bands, shingles, component, hub)``. A bucket of m members is cut into blocks of
    BLOCK, and every pair of blocks is one group: no task holds more than two blocks, and all pairs are looked at, each
    in the first band that it shares. Pairs are compared on signatures, then confirmed on full sets in the same task, and
    only links that join two components there are given out, fewer than the task has rows.
    """
    (part, whole), floor = plan.link, plan.floor
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = placed.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("m", "blocks", "other")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi, band = int(pdf.lo.iloc[0]), int(pdf.hi.iloc[0]), int(pdf.band.iloc[0])
        sig = np.frombuffer(b"".join(pdf.sig), "u1").reshape(len(pdf), -1)
        bands = np.stack(pdf.bands.to_numpy())
        n, hub, block = pdf.n.to_numpy(), pdf.hub.to_numpy(), pdf.block.to_numpy()
        comp, names = pd.factorize(pdf.component)
        group = list(range(len(names)))  # components that links found here have joined

        def find(x: int) -> int:
            while group[x] != x:
                group[x] = x = group[group[x]]
            return x

        sets = pdf.shingles.to_numpy()
        ends = np.cumsum([len(x) for x in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        each = np.split(ids, ends[:-1])
        mark = np.zeros(int(ids.max()) + 1, bool)
        rows, cols = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        found = []
        for i in rows.tolist():
            if hub[i]:
                continue
            js = cols if lo != hi else cols[cols > i]
            js = js[(comp[js] != comp[i]) & ~hub[js] & (np.minimum(n[js], n[i]) * whole >= np.maximum(n[js], n[i]) * part)]
            js = js[(sig[js] == sig[i]).sum(1) >= floor]
            js = js[(bands[js] == bands[i]).argmax(1) == band]
            if not len(js):
                continue
            mark[each[i]] = True
            for j in js.tolist():
                x, y = find(comp[i]), find(comp[j])
                if x != y:
                    both = int(mark[each[j]].sum())
                    if both * whole >= (n[i] + n[j] - both) * part:
                        group[x] = y
                        found.append((i, j))
            mark[each[i]] = False
        node = pdf.node.to_numpy()
        return pd.DataFrame([(node[i], node[j]) for i, j in found], columns=["a", "b"], dtype=object)

    return dealt.groupBy("bucket", "lo", "hi").applyInPandas(compare, "a string, b string")


def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels(node, component)`` after the links ``more(a, b)``: components of components, which are few."""
    known = labels.select(F.col("node").alias("a"), F.col("component").alias("x"))
    ends = more.join(known, "a", "left").join(known.toDF("b", "y"), "b", "left")
    ends = stored(ends.select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")))
    top = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).toDF("component", "top")
    fresh = ends.select(F.explode(F.array(F.struct("a", "x"), F.struct(F.col("b").alias("a"), F.col("y").alias("x")))).alias("e")).select("e.*").where("a = x").distinct().toDF("node", "component")
    every = stored(labels.unionByName(fresh.join(labels, "node", "left_anti")))
    return checkpoint(salted_join(every, top, "component", "node", "left").select("node", F.coalesce("top", "component").alias("component")))


def grouped(docs: DataFrame, link: tuple[int, int] = LINK) -> DataFrame:
    """(doc_id, text_key, n_shingles, component, component_id) of each row: its text's digest, the component's own key (null
    without shingles) and its smallest doc_id. Rows are linked as in ``near_duplicates``."""
    plan = plan_of(link)
    each = stored(sketches(docs, plan))
    # one row a distinct set from here on
    classes = stored(each.where("set_key is not null").groupBy(F.col("set_key").alias("node")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_key")).alias("row"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")).select("node", "row.doc_id", "row.text_key", "n", "sig", "bands"))
    places = classes.select("node", "n", F.posexplode("bands").alias("band", "hash")).select("node", "n", "band", F.xxhash64("band", "hash").alias("bucket"))
    # buckets of two members or more; of buckets with the same members only the one of the lowest band
    mix = F.xxhash64("node").cast("decimal(38,0)")
    crowd = places.groupBy("bucket").agg(F.count("*").alias("m"), F.min("band").alias("band"), F.sum(mix).alias("s"), F.bit_xor(F.xxhash64("node")).alias("x")).where("m > 1")
    single = crowd.groupBy("m", "s", "x").agg(F.min(F.struct("band", "bucket")).alias("first")).select(F.col("first.bucket").alias("bucket"), "m")
    hot = hot_keys(places, "bucket")
    shared = stored(salted_join(places, single, "bucket", "node", hot=hot))
    reach = shared.groupBy("node").agg(F.sum("m").alias("reach"))
    ranked = shared.join(reach, "node").withColumn("rank", F.struct(F.col("reach"), "node", "n"))
    hubs = stored(ranked.groupBy("bucket").agg(F.max("rank").alias("h")).select("bucket", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n")))
    stars = stored(salted_join(shared.select("bucket", "band", "node", "n"), hubs, "bucket", "node", hot=hot))
    sets = stored(shingle_sets(docs, classes.select("node", "doc_id", "text_key").join(stars.select("node").distinct(), "node")))
    first = stars.where((F.col("node") != F.col("hub")) & near_enough("n", "hub_n", link)).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = confirmed(stored(first), sets, link)
    labels = components(links)
    # what the hubs left open
    at = stars.join(labels, "node", "left").select("bucket", "band", "node", F.coalesce("component", "node").alias("component"), (F.col("node") == F.col("hub")).alias("hub"))
    torn = at.where("not hub").groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    inside = stored(salted_join(at, torn, "bucket", "node", hot=hot).where("not hub"))
    crowds = inside.groupBy("bucket").agg(F.count("*").alias("m"))
    members = salted_join(inside, crowds, "bucket", "node", hot=hot).join(classes.select("node", "n", "sig", "bands"), "node").join(sets, "node")
    more = checkpoint(open_links(members, plan))
    if more.limit(1).count():
        labels = joined(labels, more)
    ids = stored(classes.select(F.col("node").alias("set_key"), "doc_id").join(labels.select(F.col("node").alias("set_key"), "component"), "set_key", "left").withColumn("component", F.coalesce("component", "set_key")))
    smallest = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    owner = stored(salted_join(ids, smallest, "component", "set_key").select("set_key", "component", "component_id"))
    rows = each.select("doc_id", "text_key", "n_shingles", "set_key")
    return salted_join(rows, owner, "set_key", "doc_id", "left").drop("set_key")


def near_duplicates(docs: DataFrame, link: tuple[int, int] = LINK) -> DataFrame:
    """Components of documents whose five-word shingle sets have a Jaccard similarity of ``link`` (a fraction, 0.85) or more.

    ``docs(doc_id, text, ...)``; returns doc_id, n_shingles, component_id (smallest doc_id that can be reached) and
    kept (doc_id = component_id), a row for each row. Null and empty texts, and texts of white space, have no shingles
    and are linked with nothing (component_id is their own doc_id). Fewer than five words are one shingle. Rows that
    repeat a text are linked; rows that repeat a doc_id are told apart by text only, and get a result each. Rows of a null
    doc_id are linked like others. Ties cannot matter. Other columns
    are ignored; an empty table gives no rows. Shingles are 64-bit hashes, set digests have 128 bits.
    """
    out = grouped(docs, link)
    component = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_copies(docs: DataFrame, link: tuple[int, int] = LINK) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id (a null last) and then of the smallest digest.

    Rows without shingles stay; a row given twice stays once. Rows are told apart by doc_id and text, so another text
    under the doc_id of one that stays is judged by itself.
    """
    rows = grouped(docs, link).select("component", F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_key").alias("row"))
    best = rows.where("component is not null").groupBy("component").agg(F.min("row").alias("row")).select("row.*")
    kept = best.unionByName(rows.where("component is null").select("row.*").distinct())
    kept = kept.select(F.col("doc_id").alias("_kept"), F.col("text_key").alias("_kept_text"))
    keyed = docs.withColumn("_text", F.xxhash64("text"))
    left = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")) & (F.col("_text") == F.col("_kept_text")), "left_semi")
    return left.dropDuplicates(["doc_id", "_text"]).drop("_text")


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
