"""Conversation repair against a brute force over whole audits, on the table and on awkward rows, in runs of any length."""

import hashlib
import itertools
import random
import zlib

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from fleetsift.llm.conversations import damage, repair_conversations

SPACES = " \t\n\x0b\x0c\r"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def spoilt(rows):
    """Rows after damage by conversation, in the order of repair among different turns."""
    found = {}
    for conv, turn, role, text in rows:
        one = lambda v: " " if v is None else str(v)
        mine = found.setdefault(conv, [])
        kind, role, text = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20, one(role), one(text)
        if kind:
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {conv: sorted(mine, key=lambda r: (r[0] is not None, r[0] or 0)) for conv, mine in found.items()}


def step(state, initial):
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))


def best(rows, state, faults, at=0, inserted=0, memo=None):
    """(cost, audit, repaired) that is least by cost, then audit, from a state in front of row `at`."""
    memo = {} if memo is None else memo
    if (at, state, inserted) not in memo:
        ways = [(0, "", ())] if at == len(rows) and state in ("", "a") else []
        asked = "a" if state == "u" else "u"
        name = "assistant" if asked == "a" else "user"
        after = lambda s, k, i: best(rows, s, faults, k, i, memo)
        if inserted < 3:
            c, a, r = after(asked, at, inserted + 1)
            ways.append((c + 5, "I" + a, ((name, ""),) + r))
        if at < len(rows):
            _, role, text = rows[at]
            c, a, r = after(state, at + 1, 0)
            ways.append((c + 2, "D" + a, r))
            if faults[at] not in ("blank", "duplicate"):
                extra = 5 if faults[at] == "truncated" else 0
                if step(state, role[:1]):
                    c, a, r = after(step(state, role[:1]), at + 1, 0)
                    ways.append((c + extra, "K" + a, ((role, text),) + r))
                c, a, r = after(asked, at + 1, 0)
                ways.append((c + extra + 1, "R" + a, ((name, text),) + r))
        memo[(at, state, inserted)] = min(ways, default=(10 ** 9, "", ()))
    return memo[(at, state, inserted)]


def brute(rows):
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(SPACES)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    memo = {}
    for at in range(len(rows), -1, -1):
        for state in ("", "s", "u", "a"):
            best(rows, state, faults, at, 0, memo)
    cost, audit, repaired = best(rows, "", faults, memo=memo)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())


def plain(rows):
    return {r["conv"]: tuple(r[c] for c in COLUMNS) for r in rows}


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r.values()) for r in pq.read_table(f"{sf}/conversations.parquet").to_pylist()]
    want = {conv: brute(mine) for conv, mine in spoilt(rows).items()}
    got = entry.queries()["op12_conversation_structure_repair"](spark, sf).withColumnRenamed("conv_id", "conv").collect()
    assert len(got) == len(want) and plain(got) == want


def awkward():
    rng = random.Random(5)
    rows = [(None, t, "user", "Hi.") for t in range(5)] + [(1, None, None, None), (1, None, "user", "A."), (2, 1, "user", " \n"), (3, 7, "", "x.")]
    rows += [(4, t, rng.choice(["system", "user", "assistant", "tool", "", None]), rng.choice(["Yes.", "No!", "cut off", "", None, "été?"]))
             for t in rng.sample(range(400), 150)]
    rows += [(conv, t, rng.choice(["system", "user", "assistant"]), f"{rng.random()}" + rng.choice([".", "", "?"]))
             for conv in range(10, 40) for t in rng.sample(range(30), rng.randrange(1, 12))]
    return rows + [(50, t, "user", "word " * 20000 + ".") for t in range(3)]


@pytest.mark.parametrize("run_rows,run_bytes", [(4096, 2_000_000), (2, 2_000_000), (7, 60_000)])
def test_runs_of_any_length(spark, run_rows, run_bytes):
    rows = awkward()
    want = {conv: brute(mine) for conv, mine in spoilt(rows).items()}
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    result, pieces = repair_conversations(damage(frame), True, run_rows, run_bytes, 50)
    got = result.collect()
    assert len(got) == len(want) and plain(got) == want
    texts = {}
    for r in pieces.orderBy("seq").collect():
        texts.setdefault(r["conv"], []).extend(f"{a}:{b}" for a, b in zip(r["roles"], r["texts"]))
    assert {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in texts.items()} == {c: w[-1] for c, w in want.items()}


def test_empty_table_and_other_columns(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair_conversations(damage(frame))[0].count() == 0
    rows = [(1, 0, "user", "Hi.", 9, "x", "y"), (1, 1, "assistant", "Yes.", 9, "x", "y")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq long, kind string, gone string")
    assert plain(repair_conversations(damage(frame))[0].collect()) == {1: brute(spoilt([r[:4] for r in rows])[1])}


def test_repeated_rows_keep_one(spark):
    frame = spark.createDataFrame([(1, 2, "user", "Same.", False)] * 40 + [(1, 3, "assistant", "Fine.", False)],
                                  "conv long, turn long, role string, text string, gone boolean")
    for run_rows in (4096, 3):
        row = repair_conversations(frame, run_rows=run_rows)[0].first()
        assert (row["duplicate"], row["cost"], row["audit"]) == (39, 78, "K" + "D" * 39 + "K")
