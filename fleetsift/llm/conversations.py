"""Conversation structure repair: faults of every conversation and the cheapest edits that make it well formed.

Rows are sorted over all tasks by conversation and turn, so one conversation with a large share of the rows
is spread over many tasks. A conversation that begins and ends inside a task is repaired there, many at a time.
Runs of rows of the others meet by their numbers: each run is a 4 x 4 matrix of least costs, matrices of a
conversation are multiplied from its end, then every run knows the costs behind it, finds where its least audit
ends for each state in front of it, and those maps are followed from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fleetsift.session import cut_lineage

from .audit_paths import ASKED, AT_END, ASSISTANT, FAR, LETTERS, START, Audits, Costs, row_code
from .common import arrow_schema

SPACES = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_EDGES = "low long, high long, distinct long"
_SUMS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone): rows spoilt in a way fixed by crc32 of `conv:turn`, as a test for repairs.

    Of 20 values, 0 drops the row (gone is true and its text empty), 1 empties the text, 2 removes its
    `[.!?]`, 3 repeats the row, 4 sets the role user. A null is written as one space; turn and conv keep their nulls.
    """
    one = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one(conv), F.lit(":"), one(turn)).cast("binary")) % 20
    known = rows.select(rows[conv].alias("conv"), rows[turn].alias("turn"), one(role).alias("role"), one(text).alias("text"), kind.alias("kind"))
    return known.select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _codes(roles: list[str], texts: list[str], first: set[int] | None) -> tuple[list[int], list[int]]:
    """Rows as numbers, and the numbers of blank, duplicate, truncated rows and illegal neighbours.

    first: the rows whose role and text no earlier row of the conversation has, or None if these are all its rows.
    """
    codes, counts, seen, last = [], [0, 0, 0, 0], set(), ""
    for k, (role, text) in enumerate(zip(roles, texts)):
        body = text.strip(SPACES)
        blank = not body
        again = not blank and ((role, text) in seen if first is None else k not in first)
        cut = not blank and not again and body[-1] not in ".!?"
        if first is None:
            seen.add((role, text))
        counts[0] += blank
        counts[1] += again
        counts[2] += cut
        counts[3] += k > 0 and last + role[:1] not in LEGAL
        last = role[:1]
        codes.append(row_code(role[:1], blank, again, cut))
    return codes, counts


def _rebuilt(roles: list[str], texts: list[str], letters: list[int], places: list[int], states: list[int]) -> tuple[list, list]:
    """Roles and texts after the edits."""
    out_roles, out_texts = [], []
    for letter, place, state in zip(letters, places, states):
        if letter:  # all but D
            out_roles.append(roles[place] if letter == 2 else "assistant" if ASKED[state] == ASSISTANT else "user")
            out_texts.append(texts[place] if letter != 1 else "")
    return out_roles, out_texts


def _repairs(runs: list[tuple], costs: Costs) -> Iterator[tuple[int, str, list, list]]:
    """(cost, audit, roles, texts) of each run (roles, texts, codes, costs behind, closed, first state)."""
    audits = Audits([run[2:] for run in runs], costs)
    count, letter, place, state = audits.paths()
    text, letter, place, state = LETTERS[letter].tobytes().decode(), letter.tolist(), place.tolist(), state.tolist()
    ends = np.cumsum(count).tolist()
    for k, (run, end) in enumerate(zip(runs, ends)):
        at = end - int(count[k])
        yield (int(audits.cost[k]), text[at:end], *_rebuilt(run[0], run[1], letter[at:end], place[at:end], state[at:end]))


def _lines(roles: list[str], texts: list[str]) -> str:
    return "\n".join(f"{r}:{t}" for r, t in zip(roles, texts))


class _Open:
    """The rows of one conversation as they come, sorted."""

    def __init__(self, conv, leading: bool):
        self.conv, self.leading, self.cut = conv, leading, False
        self.clear()

    def clear(self) -> None:
        self.roles, self.texts, self.bytes = [], [], 0
        self.low = self.high = None
        self.distinct = 0

    def add(self, turn, role: str, text: str) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(text) + 16
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn


def _sorted_runs(batches, schema: pa.Schema, limit: tuple[int, int, int], with_turns: bool) -> Iterator[pa.RecordBatch]:
    """Finished conversations, and runs of the first and last conversation of a task and of long ones."""
    costs, task, out, waiting, held = Costs(), TaskContext.get().partitionId(), [], [], 0
    number = 0

    def emit(run: _Open, **more) -> None:
        nonlocal number
        out.append({"conv": run.conv, "seq": (task << 32) + number} | more)
        number += 1

    def broken(run: _Open) -> None:
        emit(run, roles=run.roles, texts=run.texts, low=run.low, high=run.high, distinct=run.distinct)
        run.clear()

    def finish() -> None:
        nonlocal held
        coded = [_codes(run.roles, run.texts, None) for run in waiting]
        runs = [(run.roles, run.texts, codes, AT_END, True, START) for run, (codes, _) in zip(waiting, coded)]
        for run, (_, counts), (cost, audit, roles, texts) in zip(waiting, coded, _repairs(runs, costs) if runs else ()):
            gaps = run.high - run.low + 1 - run.distinct if run.distinct else 0
            emit(run, gaps=gaps, cost=cost, audit=audit, repaired_sha256=hashlib.sha256(_lines(roles, texts).encode()).hexdigest(),
                 **dict(zip(_COUNTS, counts)), **({"roles": roles, "texts": texts} if with_turns else {}))
        waiting.clear()
        held = 0

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist(out, schema=schema)
        out.clear()
        return batch

    run = None
    for batch in batches:
        for conv, turn, role, text, gone in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if run is None or conv != run.conv:
                if run is not None and (run.leading or run.cut):
                    broken(run)
                elif run is not None:
                    waiting.append(run)
                    held += len(run.roles) + 1
                    if held >= limit[2]:
                        finish()
                        yield flush()
                run = _Open(conv, run is None)
            if not gone:
                run.add(turn, role, text)
                if len(run.roles) >= limit[0] or run.bytes >= limit[1]:
                    run.cut = True
                    broken(run)
                    if len(out) >= 64:
                        yield flush()
    if run is not None:
        broken(run)
    finish()
    yield flush()


def repair_conversations(turns: DataFrame, with_turns: bool = False, run_rows: int = 4096, run_bytes: int = 2_000_000,
                         batch_rows: int = 40_000) -> tuple[DataFrame, DataFrame | None]:
    """Faults, audit and repaired form of every conversation in turns (conv, turn, role, text, gone).

    First (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each
    conversation; second, with with_turns, (conv, seq, roles, texts): the repaired turns in pieces, in the
    order of seq. Rows with gone count for nothing but keep their conversation. Rows are taken by turn, nulls first,
    and among equal turns by role and a hash of the text. A null conversation is one like others. A
    null role or text counts as one space. A conversation without rows has zeros, no audit and the hash of an
    empty text. Long texts and repeated rows are nothing special; an empty table gives an empty table; other columns
    are not read. run_rows and run_bytes bound what a task holds of one conversation, batch_rows what it repairs at once;
    neither changes a result.
    """
    kind = turns.schema["conv"].dataType.simpleString()
    limit = (run_rows, run_bytes, batch_rows)
    rows = turns.select("conv", F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), F.coalesce("gone", F.lit(False)).alias("gone"))
    keyed = rows.withColumn("tie", F.xxhash64("text")).withColumn("spread", F.rand(11))
    keys = ["conv", "turn", "role", "tie", "spread"]
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "turn", "role", "text", "gone")
    schema = f"conv {kind}, seq long, {_SUMS}, {_EDGES}, roles array<string>, texts array<string>"
    arrow = arrow_schema(schema)
    got = cut_lineage(dealt.mapInArrow(lambda batches: _sorted_runs(batches, arrow, limit, with_turns), schema))
    sums = ["conv", *(c.split()[0] for c in _SUMS.split(", "))]
    whole = got.where("audit IS NOT NULL")
    joined, pieces = _join_runs(got.where("audit IS NULL").select("conv", "seq", "low", "high", "distinct", "roles", "texts"), kind)
    result = whole.select(*sums).unionByName(joined.select(*sums))
    return result, (whole.select("conv", "seq", "roles", "texts").unionByName(pieces.select("conv", "seq", "roles", "texts")) if with_turns else None)


def _join_runs(runs: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Conversations whose rows are in several runs, or that end where a task does; and their repaired pieces."""
    each = runs.select("seq", "conv", F.posexplode(F.arrays_zip("roles", "texts")).alias("k", "r"))
    first = (each.groupBy("conv", F.col("r.roles"), F.sha2("r.texts", 256)).agg(F.min(F.struct("seq", "k")).alias("f"))
             .groupBy("f.seq").agg(F.collect_list("f.k").alias("first")))
    runs = cut_lineage(runs.join(first, "seq", "left").withColumn("first", F.coalesce("first", F.expr("array()").cast("array<int>"))))

    def each_run(work):
        def run(batches):
            costs = Costs()
            for batch in batches:
                rows = batch.to_pylist()
                coded = [_codes(r["roles"], r["texts"], set(r["first"])) for r in rows]
                if rows:
                    yield from work(rows, coded, costs)
        return run

    def by(schema, work):
        arrow = arrow_schema(schema)
        return lambda frame: frame.mapInArrow(each_run(lambda rows, coded, costs: [pa.RecordBatch.from_pylist(work(rows, coded, costs), schema=arrow)]), schema)

    matrices = by(f"conv {kind}, seq long, matrix array<long>", lambda rows, coded, costs: [
        {"conv": r["conv"], "seq": r["seq"], "matrix": costs.matrix(codes)} for r, (codes, _) in zip(rows, coded)])(runs)

    def backwards(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        after, found = np.array(AT_END), []
        for matrix in reversed(group["matrix"].tolist()):
            found.append(after)
            after = np.minimum((np.reshape(matrix, (4, 4)) + after).min(1), FAR)
        return pd.DataFrame({"seq": group["seq"], "after": [x.tolist() for x in reversed(found)], "closed": group["seq"] == group["seq"].max()})

    behind = matrices.groupBy("conv").applyInPandas(backwards, "seq long, after array<long>, closed boolean")
    runs = cut_lineage(runs.join(behind, "seq"))

    def maps(rows, coded, costs):
        ends = Audits([(codes, tuple(r["after"]), r["closed"], s) for r, (codes, _) in zip(rows, coded) for s in range(4)], costs).ends().reshape(-1, 4)
        return [{"conv": r["conv"], "seq": r["seq"], "ends": e} for r, e in zip(rows, ends.tolist())]

    def forwards(group: pd.DataFrame) -> pd.DataFrame:
        group, state, found = group.sort_values("seq"), START, []
        for ends in group["ends"]:
            found.append(state)
            state = int(ends[state])
        return pd.DataFrame({"seq": group["seq"], "state": found})

    starts = by(f"conv {kind}, seq long, ends array<int>", maps)(runs).groupBy("conv").applyInPandas(forwards, "seq long, state int")
    shape = (f"conv {kind}, seq long, {_EDGES}, blank long, duplicate long, truncated long, illegal long, cost long, "
             "audit string, head string, tail string, rows long, roles array<string>, texts array<string>")

    def pieces(rows, coded, costs):
        todo = [(r["roles"], r["texts"], codes, tuple(r["after"]), r["closed"], r["state"]) for r, (codes, _) in zip(rows, coded)]
        return [{k: r[k] for k in ("conv", "seq", "low", "high", "distinct")} | dict(zip(_COUNTS, counts)) | {
            "cost": cost, "audit": audit, "head": r["roles"][0][:1] if r["roles"] else "", "tail": r["roles"][-1][:1] if r["roles"] else "",
            "rows": len(r["roles"]), "roles": roles, "texts": texts}
            for r, (_, counts), (cost, audit, roles, texts) in zip(rows, coded, _repairs(todo, costs))]

    done = cut_lineage(by(shape, pieces)(runs.join(starts, "seq")))
    arrow = arrow_schema(f"conv {kind}, {_SUMS}")
    ordered = done.repartition("conv").sortWithinPartitions("conv", "seq")
    return ordered.mapInArrow(lambda batches: _digests(batches, arrow), f"conv {kind}, {_SUMS}"), done


def _digests(batches, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its pieces in order; texts pass through a running hash."""
    now, audit, digest, edge = None, [], None, None

    def close() -> pa.RecordBatch:
        now["gaps"] = edge["high"] - edge["low"] + 1 - edge["distinct"] if edge["distinct"] else 0
        return pa.RecordBatch.from_pylist([now | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema=schema)

    for batch in batches:
        for row in batch.to_pylist():
            if now is None or row["conv"] != now["conv"]:
                if now is not None:
                    yield close()
                now = {"conv": row["conv"], "cost": row["cost"]} | dict.fromkeys(_COUNTS, 0)
                audit, digest, edge, written = [], hashlib.sha256(), {"low": None, "high": None, "distinct": 0, "tail": None}, False
            for name in _COUNTS:
                now[name] += row[name]
            if row["rows"]:
                now["illegal"] += edge["tail"] is not None and edge["tail"] + row["head"] not in LEGAL
                edge["tail"] = row["tail"]
            if row["distinct"]:
                edge["distinct"] += row["distinct"] - (row["low"] == edge["high"])
                edge["low"], edge["high"] = row["low"] if edge["low"] is None else edge["low"], row["high"]
            audit.append(row["audit"])
            if row["roles"]:
                digest.update((("\n" if written else "") + _lines(row["roles"], row["texts"])).encode())
                written = True
    if now is not None:
        yield close()
