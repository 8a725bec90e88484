"""Detections judged by the clock of the stream: anomalies and topology shifts every few seconds, heard of or not.

Rows are counted per key and interval before they reach a key's state. Each key keeps the counts of its window
and one event-time timer for its next turn; when the watermark passes turns, they are judged one by one with
all rows before them, so the result does not depend on how the stream was cut into batches. A key that falls
silent is still judged: that is how alarms clear, links are called silent, and state is given up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import fixed_values as V
from ..functions.times import as_timestamp
from ..operators.flows import observe_flows
from ..operators.graph import declared_edges, edge_id
from ..sources.topology import Topology

MEMORY = "next long, heard double, active string, sent long, at array<long>, n array<long>, total array<long>, last array<double>"
_COUNTS = ("n", "total", "last")
DETECTION = ("kind string, instance string, event string, turn timestamp, n long, measure double, armed boolean, "
             "change string, sent boolean")
SHIFT = ("edge_id string, source string, target string, protocol string, type string, severity string, turn timestamp, "
         "rate_1m long, baseline_15m double, quiet_s double, change string, sent boolean")


def _minutes(at: int, started: float | None, window_s: int) -> float:
    """Minutes of baseline there can be at a turn: those since the start, one at least, the window at most."""
    most = window_s / 60.0
    return most if started is None else min(max((at - started) / 60.0, 1.0), most)


class Turns(StatefulProcessor):
    """Counts of a key by interval, judged at every turn of `every` seconds. Subclasses say what a turn shows."""

    def __init__(self, every: int, window_s: int):
        self.every, self.window_s = every, window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", MEMORY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, first = self._held(), None
        counts = dict(zip(held["at"], zip(*(held[name] for name in _COUNTS))))
        for batch in rows:
            for at, n, total, last in zip(batch["at"], batch["n"], batch["total"], batch["last"]):
                was = counts.get(int(at), (0, 0, 0.0))
                first = int(at) if first is None else min(first, int(at))
                counts[int(at)] = (was[0] + int(n), was[1] + int(total), max(was[2], float(last)))
        ends = sorted(counts)
        held |= {"at": ends} | {name: [counts[t][k] for t in ends] for k, name in enumerate(_COUNTS)}
        if held["next"] is None or first < held["next"]:
            held["next"] = first
            self.handle.registerTimer(first * 1000)
        self.keep(held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, out = self._held(), []
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        # A turn sees the counts of its window and the next ones to come, not all that the batch brought.
        every, first, upto = {name: held[name] for name in ("at", *_COUNTS)}, 0, 0
        ends = every["at"]
        while held["next"] is not None and held["next"] <= passed:
            at, held["heard"] = held["next"], held["heard"] or 0.0
            while first < len(ends) and ends[first] <= at - self.window_s:
                first += 1
            upto = max(upto, first)
            while upto < len(ends) and ends[upto] <= at:
                held["heard"] = max(held["heard"], every["last"][upto])
                upto += 1
            held |= {name: every[name][first:upto + 1] for name in every}
            out += self.judge(key, at, held)
            held["next"] = self.next_turn(key, at, held)
        held |= {name: every[name][first:] for name in every}
        if held["next"] is not None:
            self.handle.registerTimer(held["next"] * 1000)
        self.keep(held)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def _held(self) -> dict:
        names = [c.split()[0] for c in MEMORY.split(", ")]
        if self.memory.exists():
            held = dict(zip(names, self.memory.get()))
            return held | {name: [int(x) for x in held[name]] for name in ("at", "n", "total")} | {"last": [float(x) for x in held["last"]]}
        return dict(zip(names, (None, None, None, None, [], [], [], [])))

    def keep(self, held: dict) -> None:
        self.memory.update(tuple(held.values()))

    def within(self, held: dict, at: int, span: int, what: str = "n") -> int:
        """The sum of counts of intervals that end after at - span and not after at."""
        return sum(n for t, n in zip(held["at"], held[what]) if at - span < t <= at)

    def close(self) -> None:
        pass


class Anomalies(Turns):
    """Rate spikes and surges of unstructured lines: raised high, cleared low, held in between, dropped when silent."""

    columns = [c.split()[0] for c in DETECTION.split(", ")]

    def __init__(self, started: float | None, limits: dict):
        self.limits = dict(raise_z=4.0, clear_z=2.0, min_count=30, min_minutes=5, min_ratio=2.5, raise_share=20.0, clear_share=8.0,
                           min_total=50, min_surge=20, window_s=V.WINDOW_SECONDS, every_s=V.EVALUATION_SECONDS,
                           warmup_s=V.WARMUP_SECONDS, cooldown_s=V.ALERT_COOLDOWN_SECONDS) | limits
        self.started = started
        super().__init__(self.limits["every_s"], self.limits["window_s"])

    def judge(self, key, at: int, held: dict) -> list[tuple]:
        if not any(t <= at for t in held["at"]):
            was, held["active"] = held["active"], None
            return [(*key, _moment(at), 0, None, self._armed(at), "aged", False)] if was else []
        count, total = self.within(held, at, 60), self.within(held, at, 60, "total")
        measure, high, low = self._spike(held, at, count) if key[0] == "rate_spike" else self._surge(count, total)
        change = "raised" if high and not held["active"] else "cleared" if low and held["active"] else None
        if high or low:
            held["active"] = "yes" if high else None
        send = bool(high and self._armed(at) and (held["sent"] is None or at - held["sent"] >= self.limits["cooldown_s"]))
        if send:
            held["sent"] = at
        return [(*key, _moment(at), count, measure, self._armed(at), change, send)] if change or send else []

    def next_turn(self, key, at: int, held: dict) -> int | None:
        """Every turn while the window holds rows or the cooldown lasts; then none."""
        cooling = held["sent"] is not None and at - held["sent"] < self.limits["cooldown_s"]
        return at + self.every if held["at"] or cooling else None

    def keep(self, held: dict) -> None:
        if held["next"] is None:
            self.memory.clear()
        else:
            super().keep(held)

    def _armed(self, at: int) -> bool:
        return self.started is None or at - self.started >= self.limits["warmup_s"]

    def _spike(self, held: dict, at: int, count: int) -> tuple:
        lim = self.limits
        average = self.within(held, at, self.window_s) / _minutes(at, self.started, self.window_s)
        z = (count - average) / max(math.sqrt(average), 1.0)
        if len({(t - self.every) // 60 for t in held["at"] if t <= at}) < lim["min_minutes"]:
            return z, False, False
        high = count >= lim["min_count"] and z >= lim["raise_z"] and count >= average * lim["min_ratio"]
        return z, high, not high and z < lim["clear_z"]

    def _surge(self, count: int, total: int) -> tuple:
        lim = self.limits
        share = count / total * 100 if total else 0.0
        if total < lim["min_total"]:
            return share, False, False
        high = share > lim["raise_share"] and count >= lim["min_surge"]
        return share, high, not high and share < lim["clear_share"]


class Shifts(Turns):
    """The shifts of an edge; critical ones are sent, again after each cooldown while they last."""

    columns = [c.split()[0] for c in SHIFT.split(", ")]

    def __init__(self, started: float | None, limits: dict):
        self.limits = dict(min_rate=30.0, min_z=4.0, min_ratio=2.5, heavy=20.0, drop=0.2, silent_s=120.0, window_s=V.WINDOW_SECONDS,
                           every_s=V.EVALUATION_SECONDS, cooldown_s=V.ALERT_COOLDOWN_SECONDS, warmup_s=0) | limits
        self.started = started
        super().__init__(self.limits["every_s"], self.limits["window_s"])

    def judge(self, key, at: int, held: dict) -> list[tuple]:
        source, target, protocol, declared, expected = key
        lim, quiet = self.limits, at - held["heard"]
        rate = self.within(held, at, 60)
        base = round(self.within(held, at, self.window_s) / _minutes(at, self.started, self.window_s) + 1e-9, 2)
        z = (rate - base) / max(math.sqrt(base), 1.0)
        found = {}
        if declared and expected > 0 and quiet > lim["silent_s"] and rate == 0:
            found["SILENT_LINK"] = "critical" if expected >= 2.0 else "warning"
        else:
            if not declared:
                found["NOVEL_EDGE"] = "warning"
            if rate >= lim["min_rate"] and base > 0 and z >= lim["min_z"] and rate >= base * lim["min_ratio"]:
                found["FLOW_SURGE"] = "warning"
            elif base >= lim["heavy"] and rate < base * lim["drop"] and quiet <= lim["silent_s"]:
                found["STARVATION"] = "notice"
        before = set((held["active"] or "").split(",")) - {""}
        armed = self.started is None or at - self.started >= lim["warmup_s"]
        send = armed and "critical" in found.values() and (held["sent"] is None or at - held["sent"] > lim["cooldown_s"])
        if send:
            held["sent"] = at
        held["active"] = ",".join(sorted(found))
        row = lambda kind, change, sent: (f"{source}->{target}:{protocol}", source, target, protocol, kind,
                                          found.get(kind), _moment(at), rate, base, quiet, change, sent)
        out = [row(kind, "raised" if kind not in before else None, bool(send and found[kind] == "critical")) for kind in sorted(found)]
        return [r for r in out if r[-2] or r[-1]] + [row(kind, "cleared", False) for kind in sorted(before - set(found))]

    def next_turn(self, key, at: int, held: dict) -> int | None:
        """Every turn while rates may change; a lasting critical shift when it is next due; else none until rows come."""
        if held["at"] or at - held["heard"] <= self.limits["silent_s"]:
            return at + self.every
        if "SILENT_LINK" in held["active"] and key[4] >= 2.0:
            return at + self.every if held["sent"] is None else held["sent"] + (int(self.limits["cooldown_s"]) // self.every + 1) * self.every
        return None


def _moment(at: int) -> pd.Timestamp:
    return pd.Timestamp(at, unit="s")


def _started(as_of) -> float | None:
    return None if as_of is None else pd.Timestamp(as_of).timestamp()


def _counted(rows: DataFrame, keys: list[str], every_s: int, total: Column) -> DataFrame:
    """Rows per key and interval of a watermarked stream, named by the interval's end."""
    return (rows.groupBy(F.window("timestamp", f"{every_s} seconds"), *keys)
            .agg(F.sum("n").alias("n"), F.sum(total).alias("total"), F.max(F.unix_micros("timestamp") / 1e6).alias("last"))
            .select(*keys, F.unix_seconds("window.end").alias("at"), "n", "total", "last", F.window_time("window").alias("time")))


def anomaly_turns(events: DataFrame, started=None, **limits) -> DataFrame:
    """Changes and alerts (kind, instance, event, turn, n, measure, armed, change, sent) of a watermarked stream of rows.

    Each key is judged every limits['every_s'] seconds on the last minute against its window. change says that an alarm was
    raised, cleared, or aged out because the window holds nothing any more; sent marks alerts: turns that are high,
    armed (started was warmup_s ago, or is not given) and a cooldown after the last alert. Other turns give no row.
    """
    judge = Anomalies(_started(started), limits)
    instance = F.coalesce(F.try_element_at("labels", F.lit("instance")), F.lit("unknown"))
    kinds = F.array(F.struct(F.lit("rate_spike").alias("kind"), F.col("event").alias("event"), F.lit(1).alias("n")),
                    F.struct(F.lit("unstructured_surge").alias("kind"), F.lit("unstructured_surge").alias("event"),
                             (F.col("event") == "unstructured").cast("int").alias("n")))
    rows = events.select("timestamp", instance.alias("instance"), F.explode(kinds).alias("k")).select("timestamp", "instance", "k.*")
    keys = ["kind", "instance", "event"]
    return _counted(rows, keys, judge.every, F.lit(1)).groupBy(*keys).transformWithStateInPandas(
        judge, outputStructType=DETECTION, outputMode="Append", timeMode="EventTime")


def shift_turns(events: DataFrame, topology: Topology, started=None, **limits) -> DataFrame:
    """Shifts of the edges of a watermarked stream of rows, raised, cleared and sent.

    An edge is judged every limits['every_s'] seconds from its first flow on. Critical shifts are sent when they come up
    and again more than cooldown_s later while they last. An edge without flows in the window is judged no more until one
    comes, except to send.
    """
    judge = Shifts(_started(started), limits)
    flows = observe_flows(events, topology).select("timestamp", "source", "target", "protocol", "bytes", F.lit(1).alias("n"))
    known = declared_edges(topology).select("source", "target", "protocol", "expected_min_rate", "is_declared")
    ends = ["source", "target", "protocol"]
    rows = flows.join(known, ends, "left").withColumn("declared", F.coalesce("is_declared", F.lit(False))).withColumn(
        "expected", F.coalesce("expected_min_rate", F.lit(0.0)))
    keys = [*ends, "declared", "expected"]
    return _counted(rows, keys, judge.every, F.col("bytes")).groupBy(*keys).transformWithStateInPandas(
        judge, outputStructType=SHIFT, outputMode="Append", timeMode="EventTime")
