"""Conversation structure: faults of turns, and the cheapest edits that make roles alternate.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Every row is kept, given another role or
deleted, and empty rows are inserted; a cost programme over (rows read, state) finds the costs to the end, and the arcs that
attain them are the optimal ones. Among optimal repairs the one whose audit (the edits' initials) is least is taken by prefix
doubling: arcs are ranked by the next 1, 2, 4, ... letters of the least audits that begin with them, ranks of length 2k
from the ranks of an arc and of the node that it leads to after k letters; the last ranks select each node's arc, and doubled
pointers read the path.

A conversation of ordinary size is solved at once. A larger one is cut into ranges of rows: what a range costs from each
state to each other is a matrix of 4 by 4, the matrices give the costs to the end at every border, and then the ranges
are solved apart for each state that they may be entered in. Only the matrices and the hash of the whole repaired text
pass through one task, the latter as a stream.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import read, salted_join, stored

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3  # costs of edits, and of an undeleted truncated row
LARGE = 8 << 20  # bytes of a conversation from which on it is cut into ranges
RANGE = 4 << 20  # bytes of a range, about

LETTERS = "DIKR"
START, SYSTEM, USER, ASSISTANT = range(4)  # what was read last
KEPT = {(START, "s"): SYSTEM, **{(s, "u"): USER for s in (START, SYSTEM, ASSISTANT)}, (USER, "a"): ASSISTANT}
WANTED = (USER, USER, ASSISTANT, USER)  # the role that an inserted or changed row takes in each state
NAMES = {USER: "user", ASSISTANT: "assistant"}
TO_END = (0, 2 * INSERT, INSERT, 0)  # from each state behind the last row
LEGAL = ("su", "ua", "au")
FAULTS = ("blank", "duplicate", "truncated")


class Turn(NamedTuple):
    turn: int | None
    role: str
    text: str
    first: bool = True  # of its role and text in the conversation


def fault(row: Turn) -> str | None:
    """The first fault of a row."""
    said = row.text.rstrip(SPACE)
    if not said:
        return "blank"
    if not row.first:
        return "duplicate"
    return None if said[-1] in ENDS else "truncated"


def code(row: Turn, found: str | None) -> str:
    """What the costs depend on: ``-`` must go; else the role's initial, as a capital if the row is truncated."""
    if found in ("blank", "duplicate"):
        return "-"
    kind = row.role[:1] if row.role[:1] in ("s", "u", "a") else "x"
    return kind.upper() if found else kind


def costs_to_end(codes: str, behind: tuple) -> list[list[float]]:
    """The least cost from every (rows read, state) on; ``behind``: that behind the last row."""
    out = [list(behind)]
    for c in reversed(codes):
        after = out[-1]
        more = TRUNCATED if c.isupper() else 0
        here = []
        for s in range(4):
            best = DELETE + after[s]
            if c != "-":
                best = min(best, REROLE + more + after[WANTED[s]])
                if (to := KEPT.get((s, c.lower()))) is not None:
                    best = min(best, more + after[to])
            here.append(best)
        here[USER], here[ASSISTANT] = min(here[USER], INSERT + here[ASSISTANT]), min(here[ASSISTANT], INSERT + here[USER])
        for s in (START, SYSTEM):
            here[s] = min(here[s], INSERT + here[USER])
        out.append(here)
    return out[::-1]


def optimal_arcs(codes: str, costs: list[list[float]], last: bool) -> np.ndarray:
    """Node reached by each letter of LETTERS from each node 4 * rows + state, -1 where that isn't optimal."""
    arcs = np.full((4 * (len(codes) + 1), 4), -1)
    for i, here in enumerate(costs):
        end = i == len(codes)
        if end and not last:
            break
        for s, cost in enumerate(here):
            node = 4 * i + s
            if math.isinf(cost) or end and cost == 0:
                continue
            if cost == INSERT + here[WANTED[s]]:
                arcs[node, 1] = 4 * i + WANTED[s]
            if end:
                continue
            c, after = codes[i], costs[i + 1]
            more = TRUNCATED if c.isupper() else 0
            if cost == DELETE + after[s]:
                arcs[node, 0] = 4 * i + 4 + s
            if c != "-":
                to = KEPT.get((s, c.lower()))
                if to is not None and cost == more + after[to]:
                    arcs[node, 2] = 4 * i + 4 + to
                if cost == REROLE + more + after[WANTED[s]]:
                    arcs[node, 3] = 4 * i + 4 + WANTED[s]
    return arcs


def least_paths(arcs: np.ndarray, entries: list[int]) -> list[tuple[str, int]]:
    """(least audit, node where it ends) from each of ``entries``, by prefix doubling."""
    nodes = len(arcs)
    some = arcs >= 0
    never = np.iinfo("i8").max
    rank = np.where(some, np.arange(1, 5), never)  # of the first letter
    reached = np.where(some, arcs, 0)  # the node behind the letters ranked so far
    ends = ~some.any(1)
    while True:
        best = rank.argmin(1)
        of_node = np.where(ends, 0, rank[np.arange(nodes), best])  # an audit that has ended comes before all that go on
        if ends[reached[some]].all():
            break
        pairs = np.stack([rank[some], of_node[reached[some]]], 1)
        rank[some] = np.unique(pairs, axis=0, return_inverse=True)[1].ravel() + 1
        reached = np.where(ends[reached], reached, reached[reached, best[reached]])
    best = rank.argmin(1)
    pointers = [np.where(ends, np.arange(nodes), arcs[np.arange(nodes), best])]
    while (pointers[-1] != pointers[-1][pointers[-1]]).any():
        pointers.append(pointers[-1][pointers[-1]])
    out = []
    for entry in entries:
        path = np.array([entry])
        for jump in reversed(pointers):
            path = np.stack([path, jump[path]], 1).ravel()
        out.append(("".join(LETTERS[k] for k in best[path[~ends[path]]].tolist()), int(pointers[-1][entry])))
    return out


@lru_cache(50_000)
def repairs(codes: str, behind: tuple = TO_END, last: bool = True, entries: tuple = (START,)) -> list[tuple[float, str, int]]:
    """(cost to the end, least audit, state behind the rows) for each state in which the rows may be entered."""
    costs = costs_to_end(codes, behind)
    paths = least_paths(optimal_arcs(codes, costs, last), list(entries))
    return [(costs[0][s], audit, node % 4) for s, (audit, node) in zip(entries, paths)]


def matrix(codes: str) -> list[float]:
    """The least cost of rows from each state (four rows) to each state behind them."""
    columns = [costs_to_end(codes, tuple(0 if s == t else math.inf for s in range(4)))[0] for t in range(4)]
    return [columns[t][s] for s in range(4) for t in range(4)]


def edited(rows: list[Turn], audit: str, state: int = START) -> list[tuple[str, str]]:
    """(role, text) of the rows after the edits of an audit."""
    out = []
    rest = iter(rows)
    for letter in audit:
        if letter == "D":
            next(rest)
            continue
        row = next(rest) if letter != "I" else None
        if letter == "K":
            state = KEPT[state, row.role[:1]]
            out.append((row.role, row.text))
        else:
            state = WANTED[state]
            out.append((NAMES[state], row.text if row else ""))
    return out


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def in_order(rows: list[dict], seen: set | None = None) -> list[Turn]:
    """Rows by turn (nulls first), role and text, each as often as its copies say. With ``seen``, firsts are found here."""
    out = []
    for r in sorted(rows, key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"], r["text"])):
        for k in range(r["copies"]):
            first = k == 0 and ((r["role"], r["text"]) not in seen if seen is not None else r["first"])
            if seen is not None:
                seen.add((r["role"], r["text"]))
            out.append(Turn(r["turn"], r["role"], r["text"], first))
    return out


TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
RESULT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", *FAULTS, "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("part", pa.int64()), ("turns", TURNS)])
RESULT_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, part long, turns array<struct<role:string,text:string>>"
AS_STRUCTS = lambda turns: [{"role": r, "text": t} for r, t in turns]


def _solve(with_turns: bool):
    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            out = []
            for conv in batch.to_pylist():
                rows = in_order(conv["rows"], set())
                faults = [fault(r) for r in rows]
                cost, audit, _ = repairs("".join(map(code, rows, faults)))[0]
                fixed = edited(rows, audit)
                turns = [r.turn for r in rows if r.turn is not None]
                out.append({
                    "conv_id": conv["conv_id"], "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{f: faults.count(f) for f in FAULTS},
                    "illegal": illegal_pairs([r.role[:1] for r in rows]), "cost": int(cost), "audit": audit,
                    "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest(), "part": 0, "turns": AS_STRUCTS(fixed) if with_turns else None,
                })
            yield pa.RecordBatch.from_pylist(out, RESULT)

    return solved


def prepared(turns: DataFrame) -> DataFrame:
    """(key, conv_id, turn, role, text, copies) of ``turns``; nulls in role and text are one space, a row has one copy."""
    copies = F.col("copies").cast("int") if "copies" in turns.columns else F.lit(1)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(blank("conv_id").alias("key"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), copies.alias("copies"))


def ordinary(rows: DataFrame, with_turns: bool) -> DataFrame:
    """Conversations of at most LARGE bytes: each is gathered and solved at once."""
    said = F.struct("turn", "role", F.when(F.col("copies") > 0, F.col("text")).otherwise("").alias("text"), "copies")
    return rows.groupBy("key", "conv_id").agg(F.collect_list(said).alias("rows")).select("conv_id", "rows").mapInArrow(_solve(with_turns), RESULT_SQL)


def ranges(rows: DataFrame, size: int) -> DataFrame:
    """(key, conv_id, range, rows) of large conversations: rows in order, equal rows once with their copies, in ranges of
    about RANGE bytes; ``first`` tells the first row of its role and text in the whole conversation."""
    row = rows.groupBy("key", "conv_id", "turn", "role", "text").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    kind = F.concat_ws(":", F.col("key"), F.sha2(F.col("role"), 256), F.sha2(F.col("text"), 256))
    row = stored(row.withColumn("kind", kind))
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = row.groupBy("kind").agg(F.min(at).alias("at"))
    told = salted_join(row, firsts, "kind", "turn").withColumn("first", F.col("at").eqNullSafe(at))
    placed = told.repartitionByRange(max(1, math.ceil(size / RANGE)), "key", "turn", "role", "text").withColumn("range", F.spark_partition_id().cast("long"))
    return stored(placed.groupBy("key", "conv_id", "range").agg(F.collect_list(F.struct("turn", "role", "text", "copies", "first")).alias("rows")))


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            rows = in_order(r["rows"])
            faults = [fault(x) for x in rows]
            initials = [x.role[:1] for x in rows]
            costs = matrix("".join(map(code, rows, faults)))
            out.append({"key": r["key"], "range": r["range"], "costs": costs, "head": initials[0], "tail": initials[-1], "illegal": illegal_pairs(initials), **{f: faults.count(f) for f in FAULTS}})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.string()), ("range", pa.int64()), ("costs", pa.list_(pa.float64())), ("head", pa.string()), ("tail", pa.string()), *((c, pa.int64()) for c in ("illegal", *FAULTS))]))


WEIGHED = "key string, range long, costs array<double>, head string, tail string, illegal long, blank long, duplicate long, truncated long"


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The costs to the end behind every range of a conversation, from its last one on; one small row a range."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            behind, last, parts = list(TO_END), True, sorted(r["parts"], key=lambda p: -p["range"])
            for p, before in zip(parts, [*parts[1:], None]):
                illegal = p["illegal"] + (before is not None and before["tail"] + p["head"] not in LEGAL)
                out.append({"key": r["key"], "range": p["range"], "behind": behind, "last": last, "illegal": illegal, **{f: p[f] for f in FAULTS}})
                behind, last = [min(c + b for c, b in zip(p["costs"][4 * s : 4 * s + 4], behind)) for s in range(4)], False
                # an empty row may be inserted at a border as well, but in front of the next range's rows: the matrices hold that
        yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.string()), ("range", pa.int64()), ("behind", pa.list_(pa.float64())), ("last", pa.bool_()), *((c, pa.int64()) for c in ("illegal", *FAULTS))]))


BORDERS = "key string, range long, behind array<double>, last boolean, illegal long, blank long, duplicate long, truncated long"


def _options(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each range is repaired to, for each state that it may be entered in."""
    option = pa.list_(pa.struct([("cost", pa.float64()), ("audit", pa.string()), ("state", pa.int64()), ("turns", TURNS)]))
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            rows = in_order(r.pop("rows"))
            codes = "".join(code(x, fault(x)) for x in rows)
            found = repairs(codes, tuple(r.pop("behind")), r.pop("last"), tuple(range(4)))
            out.append(r | {"options": [{"cost": c, "audit": a, "state": s, "turns": AS_STRUCTS(edited(rows, a, k)) if not math.isinf(c) else []} for k, (c, a, s) in enumerate(found)]})
        kept = pa.schema([("key", pa.string()), ("conv_id", pa.int64()), ("range", pa.int64()), *((c, pa.int64()) for c in ("illegal", *FAULTS, "gaps")), ("options", option)])
        yield pa.RecordBatch.from_pylist(out, kept)


OPTIONS = "key string, conv_id long, range long, illegal long, blank long, duplicate long, truncated long, gaps long, options array<struct<cost:double,audit:string,state:long,turns:array<struct<role:string,text:string>>>>"


def _chain(with_turns: bool):
    """Follow the ranges of each conversation, sorted: the state behind one enters the next; the text is hashed on the way."""

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        for batch in batches:
            for k in range(batch.num_rows):  # ranges are large: one at a time
                r = batch.slice(k, 1).to_pylist()[0]
                if now is None or now["key"] != r["key"]:
                    if now:
                        yield closed(now)
                    now = {"key": r["key"], "conv_id": r["conv_id"], "gaps": r["gaps"], "state": START, "hash": hashlib.sha256(), "any": False, "audit": [], "cost": r["options"][START]["cost"], **{c: 0 for c in ("illegal", *FAULTS)}}
                taken = r["options"][now["state"]]
                for t in taken["turns"]:
                    now["hash"].update(f"{chr(10) if now['any'] else ''}{t['role']}:{t['text']}".encode())
                    now["any"] = True
                now["state"] = taken["state"]
                now["audit"].append(taken["audit"])
                for c in ("illegal", *FAULTS):
                    now[c] += r[c]
                if with_turns:
                    yield pa.RecordBatch.from_pylist([{"conv_id": r["conv_id"], "part": r["range"], "turns": taken["turns"]}], RESULT)
        if now and not with_turns:
            yield closed(now)

    def closed(now: dict) -> pa.RecordBatch:
        row = {c: now[c] for c in ("conv_id", "gaps", "illegal", *FAULTS)}
        return pa.RecordBatch.from_pylist([] if with_turns else [row | {"cost": int(now["cost"]), "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest(), "part": 0, "turns": None}], RESULT)

    return chained


def large(rows: DataFrame, size: int, with_turns: bool) -> DataFrame:
    """Conversations beyond LARGE bytes, of ``size`` bytes together."""
    parts = ranges(rows, size)
    weighed = stored(parts.mapInArrow(_weigh, WEIGHED))
    borders = weighed.groupBy("key").agg(F.collect_list(F.struct("range", "costs", "head", "tail", "illegal", *FAULTS)).alias("parts")).mapInArrow(_borders, BORDERS)
    there = rows.where("copies > 0")
    gaps = there.groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    met = parts.join(borders, ["key", "range"]).join(gaps, "key")
    options = stored(met.select("key", "conv_id", "range", "illegal", *FAULTS, "gaps", "rows", "behind", "last").mapInArrow(_options, OPTIONS))
    return options.repartition("key").sortWithinPartitions("key", "range").mapInArrow(_chain(with_turns), RESULT_SQL)


def solved(turns: DataFrame, with_turns: bool, most: int = LARGE) -> DataFrame:
    rows = prepared(turns)
    sizes = stored(rows.groupBy("key").agg(F.sum(F.when(F.col("copies") > 0, F.col("copies") * (F.octet_length("text") + 64))).alias("bytes")).where(F.col("bytes") > most))
    size = sizes.agg(F.sum("bytes")).first()[0]
    if not size:
        return ordinary(rows, with_turns)
    told = stored(salted_join(rows, sizes.select("key", F.lit(True).alias("is_large")), "key", "turn", "left"))
    return ordinary(told.where("is_large is null"), with_turns).unionByName(large(told.where("is_large").drop("is_large"), int(size), with_turns))


def repair(turns: DataFrame, most: int = LARGE) -> DataFrame:
    """Faults and the cheapest repair of every conversation of ``turns(conv_id, turn, role, text, ...)``, a row a conversation.

    Returns conv_id, gaps (turn numbers that are missing), blank, duplicate and truncated (rows by first fault), illegal
    (neighbouring roles that may not follow each other), cost, audit (K keep, R change the role, D delete, I insert) and
    repaired_sha256 (of ``role:text``, one a line). Rows are taken by turn (nulls first), then role and text. A null role or
    text counts as one space; null ids are one conversation; rows that repeat are duplicates; a role that begins with no known
    initial can't be kept. An optional column ``copies`` says how often a row stands there; a conversation with 0 only has
    zeros and an empty audit. An empty table gives no rows; other columns are ignored.
    """
    return solved(turns, False, most).drop("part", "turns")


def repaired_turns(turns: DataFrame, most: int = LARGE) -> DataFrame:
    """(conv_id, part, nth, role, text): the repaired conversations, by part and place; rules as for ``repair``."""
    return solved(turns, True, most).select("conv_id", "part", F.posexplode("turns").alias("nth", "t")).select("conv_id", "part", "nth", "t.role", "t.text")


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults put in by crc32("conv_id:turn") % 20: 0 drops a row (no copies), 1 empties its text, 2 takes out
    its ends of sentences, 3 repeats it, 4 gives it the role user. Nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way: Column = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(way == 1, "").when(way == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    return turns.select("conv_id", "turn", F.when(way == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.when(way == 0, 0).when(way == 3, 2).otherwise(1).alias("copies"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(read(spark, sf_dir, "conversations")))
