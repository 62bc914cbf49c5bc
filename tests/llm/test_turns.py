"""Conversation repair against brute force over all edits."""

import hashlib
import heapq
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm import turns as t

SCHEMA = "conv_id long, turn long, role string, text string, audit string, rows string"  # extra columns with clashing names
DONE = re.compile(r"(s?(ua)+)?")
MAY_GO_ON = re.compile(r"s?(ua)*u?")


def plain_repair(rows):
    """Cheapest edits by searching all of them in order of (cost, audit); rows are (role, text) after their order."""
    seen, faults = set(), []
    for role, text in rows:
        said = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
    heap, reached = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        initials = "".join(r[:1] for r, _ in out)
        if not MAY_GO_ON.fullmatch(initials):
            continue
        if i == len(rows) and DONE.fullmatch(initials):
            return faults, cost, audit, out
        key = i, initials[-1:]
        if key in reached:  # before, at no higher cost and by a lesser audit
            continue
        reached.add(key)
        for name in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, (*out, (name, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if role[:1] in ("s", "u", "a"):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*out, rows[i])))
                for name in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, (*out, (name, text))))


def plain_row(conv_id, given_rows):
    rows = []
    for turn, role, text in sorted(given_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        rows.append((turn, role, text))
    faults, cost, audit, out = plain_repair([r[1:] for r in rows])
    known = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    return (
        conv_id, max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in t.FAULTS),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
        hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest(),
    )


def plain_damage(rows):
    out = {}
    one = lambda x: " " if x is None else x
    for conv_id, turn, role, text in rows:
        some = out.setdefault(conv_id, [])
        way = zlib.crc32(f"{one(conv_id)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if way == 0:
            continue
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        some += [(turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    return sorted((plain_row(c, r) for c, r in out.items()), key=str)


ROWS = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", " "]), st.sampled_from(["a.", "b", "c!", " ", "d?\n"])), max_size=7)


@settings(max_examples=300, deadline=None)
@given(ROWS)
def test_repairs_equal_brute_force(rows):
    faults, cost, audit, out = plain_repair(rows)
    found = t.in_order([{"turn": i, "role": r, "text": x, "copies": 1} for i, (r, x) in enumerate(rows)], set())
    assert [t.fault(r) for r in found] == faults
    got = t.repairs("".join(t.code(r, f) for r, f in zip(found, faults)))[0]
    assert got[:2] == (cost, audit) and tuple(t.edited(found, audit)) == out


@settings(max_examples=150, deadline=None)
@given(ROWS, st.integers(0, 7))
def test_ranges_chain_to_the_same(rows, cut):
    found = t.in_order([{"turn": i, "role": r, "text": x, "copies": 1} for i, (r, x) in enumerate(rows)], set())
    codes = "".join(t.code(r, t.fault(r)) for r in found)
    a, b = codes[:cut], codes[cut:]
    tail = t.matrix(b)
    behind = tuple(min(tail[4 * s + k] + t.TO_END[k] for k in range(4)) for s in range(4))
    cost, audit, state = t.repairs(a, behind, False)[0]
    assert (cost, audit + t.repairs(b, t.TO_END, True, tuple(range(4)))[state][1]) == t.repairs(codes)[0][:2]


def conversations():
    rows = []
    for c in range(150):
        for k in range(c % 9):
            role = ["user", "assistant"][k % 2] if (c * 7 + k) % 5 else ["system", "tool", "assistant", None][(c + k) % 4]
            rows.append((c, k + (k > 3) * (c % 3), role, [f"said {c % 4} {k % 3}.", "yes!", None, "no end", " \t", "é?"][(c * 3 + k * k) % 6]))
    rows += [(900, None, "user", "a."), (900, 2, "assistant", "b."), (900, 2, "assistant", "b."), (None, 0, "user", "hi."), (None, 1, "assistant", "ho."), (901, None, None, None), (902, 0, "system", "only.")]
    return rows


def test_query_equals_brute_force(spark, tmp_path):
    rows = conversations()
    spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in t.op13_conversation_repair(spark, str(tmp_path)).collect()), key=str)
    assert got == plain_damage(rows)
    assert t.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_conversations_in_ranges_give_the_same(spark, monkeypatch):
    df = t.damaged(spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string"))
    whole = sorted(map(tuple, t.repair(df).collect()), key=str)
    monkeypatch.setattr(t, "RANGE", 150)
    assert sorted(map(tuple, t.repair(df, most=200).collect()), key=str) == whole
    turns = t.repaired_turns(df, most=200).orderBy("part", "nth").collect()
    texts: dict = {}
    for r in turns:
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for row in whole:
        assert hashlib.sha256("\n".join(texts.get(row[0], [])).encode()).hexdigest() == row[-1]


def test_one_long_conversation(spark):
    rows = [(1, k, ["user", "assistant"][k % 2], f"line {k}." if k % 50 else "line") for k in range(3000)]
    (r,) = t.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert r.cost == 3 + 59 * 7 and len(r.audit) == 3059  # the first is truncated, the others are duplicates that leave a gap
