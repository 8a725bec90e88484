"""N-gram Jaccard join: universe partition with one-deletion neighbourhoods.

Documents are sets of hashed word shingles. Two sets of sizes x <= y with a Jaccard likeness of p percent
or more differ in at most H = (x + y)(100 - p) / (100 + p) elements. Sizes fall into bands; a band's sets
split the universe of hashes into m segments. Give segment i an allowance v of 0, 1 or 2, with a sum of
H + 1 + e: then the allowances of a similar pair exceed its differences by e + 1 units in all, so some
segment is equal on both sides (v = 1) or differs by at most one element (v = 2). Signatures are hashes
of segments (v >= 1), and of segments less one element (v = 2); segments with v = 0 are left out.

Allowances follow a cost: for every band and segment one pass over all documents counts sets and
elements and estimates how many pairs of sets agree in the segment (squares of signed sums). Costly
segments get 0; where that leaves too little, the cheapest ones get 2.

An empty segment says little and is left out, unless the units a set could match through empty segments
exceed e; similar sets that match through nothing else both have more than e, so none is lost.

Equal sets are one class from the start, and a task sends a class once. Sets with a common signature are
candidates: all pairs in groups of a few sets; in larger groups each set with the group's first. Sketches
show most of those that are no links: sums over buckets, of which no more can differ than elements do.
Links are verified on whole sets, the strongest candidate of every class first; candidates within a component
need no more looking at. Where larger groups still span several components, their sets are compared once more
by their rarest shingles (a prefix filter), so no link that joins two components is missed. Links have several
signatures in common, so sets with too few of them in such groups are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetsift.session import cut_lineage, scratch_path

from .components import components
from .shingles import digest, mix, shingle_set

_U = np.uint64
#: Counters of the sketch that orders shingles, and how many are added up at a time.
_SKETCH, _SLICE = 1 << 20, 1 << 16
#: Shingles a row of the join by rarest shingles knows of those before its own.
_BEFORE = 3
_LOW = _U(0xFFFFFFFF)
#: Bits that a signature leaves the task with: few enough to travel cheaply, so many that strangers seldom meet; the others name its band.
_SENT, _BAND = _U(0xFFFFFFFFFFFF0000), 0xFFFF
#: Documents whose signatures or shingles are held at once, and rows of a batch that leaves a task.
_HELD, _ROWS_OUT = 4096, 1 << 16
#: Buckets of the parities that go with a set's rarest shingles, as bits and in 64-bit numbers.
_PARITY_BITS, _PARITY = 9, 8


@dataclass(frozen=True)
class Settings:
    words: int = 4
    percent: int = 85
    growth: float = 1.4
    small_group: int = 6
    signs: int = 4

    def bands(self, most: int) -> list[tuple[int, int]]:
        """(lowest, highest size) of each band up to the size given."""
        out, low = [], 1
        while low <= most:
            high = max(low, int(low * self.growth) - 1)
            out.append((low, high))
            low = high + 1
        return out

    def shape(self, high: int) -> tuple[int, int, int, int]:
        """Largest difference, slack, number of segments and common allowance for a band that ends at high.

        Small sets get few segments with an allowance of 2, so that none is likely to be empty; others
        get an allowance of 1 and a few segments to spare. The slack grows with the difference, as the number of
        empty segments does: links have what is left of it in common.
        """
        partner = high * 100 // self.percent
        most = (high + partner) * (100 - self.percent) // (100 + self.percent)
        if most < 8:
            m = most // 2 + 1
            return most, 2 * m - most - 1, m, 2
        slack = 1 + max(min(4, most // 10), most // 8)
        return most, slack, most + 1 + slack + max(1, most // 16), 1

    def meeting_bands(self, size: int, bands: list[tuple[int, int]]) -> list[int]:
        """Bands in which a set of this size meets similar, unequal sets of at most its size."""
        least = -(-size * self.percent // 100)
        own = int(np.searchsorted([b[1] for b in bands], size))
        out = [own]
        while own > 0 and bands[own - 1][1] >= least:
            own -= 1
            out.append(own)
        return [b for b in out if self.shape(bands[b][1])[0] > 0]


def sketch(found: np.ndarray, share: int = 1) -> np.ndarray:
    """Sums modulo 256 over a power of two of buckets, at least the number of elements by share.

    Two sets differ in no fewer elements than buckets, so buckets that differ bound the difference.
    """
    size = 1 << (max(1, len(found) // share) - 1).bit_length()
    at = ((found >> _U(32)) * _U(size) >> _U(32)).astype(np.int64)
    return (np.bincount(at, weights=(found & _U(255)).astype(np.float64), minlength=size).astype(np.int64) & 255).astype(np.uint8)


def parities(found: np.ndarray) -> np.ndarray:
    """Whether each of 64 * _PARITY buckets holds an odd number of elements, as bits of _PARITY numbers.

    Every element in which two sets differ turns one bit, so no more bits differ than elements do.
    """
    odd = np.bincount((found >> _U(64 - _PARITY_BITS)).astype(np.int64), minlength=1 << _PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def least_difference(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the number of elements in which two sketched sets differ."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) > len(a):
        b = (b.reshape(len(a), -1).sum(axis=1, dtype=np.int64) & 255).astype(np.uint8)
    return int(np.count_nonzero(a != b))


class Segments:
    """The segments of one set in one band: 32-bit half sums of the elements, and element counts."""

    def __init__(self, found: np.ndarray, m: int):
        self.at = (mix(found ^ _U(m)) % _U(m)).astype(np.int64)
        self.low, self.high = (found & _LOW).astype(np.float64), (found >> _U(32)).astype(np.float64)
        self.count = np.bincount(self.at, minlength=m)
        self.sums = [np.bincount(self.at, weights=w, minlength=m) for w in (self.low, self.high)]


def _signature(band: int, segment: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    place = mix((segment.astype(_U) << _U(8)) + _U(band))
    return mix(low.astype(_U) + (high.astype(_U) << _U(32)) + place)


def allowances(cost: np.ndarray, deletion_cost: np.ndarray, need: int, start: int) -> np.ndarray:
    """0, 1 or 2 for each segment, with a sum of at least need, for little cost.

    From 1 everywhere, the costliest segments drop to 0 while the sum allows; then pairs of a segment
    to drop and one to raise are taken while dropping saves more than raising costs. From 2 everywhere
    nothing is to spare.
    """
    v = np.full(len(cost), start, np.int8)
    if start == 2:
        return v
    ranked = np.argsort(-cost, kind="stable")
    spare = len(cost) - need
    v[ranked[:spare]] = 0
    dear = [i for i in ranked[spare:]]
    cheap = sorted(ranked[spare:], key=lambda i: (deletion_cost[i], -i))
    for drop, rise in zip(dear, cheap):
        if v[drop] != 1 or v[rise] != 1 or drop == rise or deletion_cost[rise] >= cost[drop]:
            break
        v[drop], v[rise] = 0, 2
    return v


def _first_pass(docs: DataFrame, s: Settings) -> DataFrame:
    """(kind, i, n, cls, sketch, coarse): one row of kind 0 for each document; and of kind 1 the statistics of a
    task, as (kind, band, segment, [sets, elements, signed sums])."""
    kind = docs.schema["i"].dataType.simpleString()
    arrow = pa.schema([("kind", pa.int32()), ("i", _arrow(docs, "i")), ("n", pa.int64()), ("cls", pa.int64()), ("sketch", pa.binary()), ("coarse", pa.binary()),
                       ("band", pa.int32()), ("segment", pa.int32()), ("sums", pa.list_(pa.int64()))])

    def run(batches):
        bands, seen, held = s.bands(1000), set(), {}
        for batch in batches:
            ids, n, cls, sketches, coarse = batch.column("i"), [], [], [], []
            for text in batch.column("t"):
                found = shingle_set(text.as_py(), s.words)
                mark = digest(found)
                n.append(len(found))
                cls.append(mark)
                if not len(found) or mark in seen:
                    sketches.append(None)
                    coarse.append(None)
                    continue
                sketches.append(sketch(found).tobytes())
                coarse.append(sketch(found, 4).tobytes())
                seen.add(mark)
                while bands[-1][1] < len(found):
                    bands = s.bands(2 * bands[-1][1])
                for band in s.meeting_bands(len(found), bands):
                    m = s.shape(bands[band][1])[2]
                    seg = Segments(found, m)
                    sig = _signature(band, np.arange(m), *seg.sums)
                    sums = held.setdefault(band, np.zeros((2 + s.signs, m), np.int64))
                    sums[0] += 1
                    sums[1] += seg.count
                    for k in range(s.signs):
                        sums[2 + k] += 1 - 2 * ((sig >> _U(k + 7)) & _U(1)).astype(np.int64)
            k = len(n)
            yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), ids, pa.array(n, pa.int64()), pa.array(cls, pa.int64()),
                                              pa.array(sketches, pa.binary()), pa.array(coarse, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.list_(pa.int64()))], schema=arrow)
        for band, sums in held.items():
            k = sums.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.nulls(k, arrow.field("i").type), pa.nulls(k, pa.int64()),
                                              pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array([band] * k, pa.int32()), pa.array(range(k), pa.int32()),
                                              pa.array(sums.T.tolist(), pa.list_(pa.int64()))], schema=arrow)

    return docs.mapInArrow(run, f"kind int, i {kind}, n long, cls long, sketch binary, coarse binary, band int, segment int, sums array<long>")


def _arrow(docs: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(docs.schema[column].dataType)


def _plan(stats: DataFrame, s: Settings) -> dict[int, np.ndarray]:
    """Allowances by band, from sums over all tasks: one row for each band and segment, a number that
    depends on the largest set and not on how many there are."""
    sums = [F.sum(F.get("sums", F.lit(k))).cast("double").alias(f"s{k}") for k in range(2 + s.signs)]
    found: dict[int, list] = {}
    for row in stats.groupBy("band", "segment").agg(*sums).collect():
        found.setdefault(row["band"], []).append(row)
    out = {}
    for band, rows in found.items():
        rows.sort(key=lambda r: r["segment"])
        sets, elements = (np.array([r[f"s{k}"] for r in rows]) for k in (0, 1))
        squares = np.mean([[r[f"s{k}"] ** 2 for r in rows] for k in range(2, 2 + s.signs)], axis=0)
        agreeing = np.maximum(squares - sets, 0) / 2
        high = s.bands(1 << 40)[band][1]
        most, slack, _, start = s.shape(high)
        out[band] = allowances(sets + agreeing, 2 * (sets + elements) + agreeing, most + 1 + slack, start)
    return out


_ROWS = pa.schema([("kind", pa.int32()), ("x", pa.int64()), ("y", pa.int64())])
_ROW, _HOT_ROW, _PAIR, _GROUP, _NEED = 0, 1, 2, 3, 4


def _batch(kind: int, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x), pa.array(y)], schema=_ROWS)


def _batches(kind: int, x: np.ndarray, y: np.ndarray):
    for k in range(0, len(x), _ROWS_OUT):
        yield _batch(kind, x[k:k + _ROWS_OUT], y[k:k + _ROWS_OUT])


def _set_signatures(found: np.ndarray, band: int, slack: int, v: np.ndarray) -> tuple[np.ndarray, int]:
    """Signatures of a set in a band, and how many of them it has in common with any set it is linked to there.

    A link's units exceed its differences by slack + 1; those that do not go through empty segments have a
    signature each.
    """
    seg = Segments(found, len(v))
    used = np.flatnonzero(v)
    through_empty = int(v[seg.count == 0].sum() + ((seg.count == 1) & (v == 2)).sum())
    if through_empty <= slack:
        used = used[seg.count[used] > 0]
    out = [_signature(band, used, seg.sums[0][used], seg.sums[1][used])]
    near = v[seg.at] == 2
    if through_empty <= slack:
        near &= seg.count[seg.at] > 1
    if near.any():
        at = seg.at[near]
        out.append(_signature(band, at, seg.sums[0][at] - seg.low[near], seg.sums[1][at] - seg.high[near]))
    return (np.concatenate(out) & _SENT | _U(band)).view(np.int64), max(1, slack + 1 - through_empty)


def _regrouped(batches, rows: int):
    """The rows of batches in batches of this many rows, the last one smaller."""
    wait, n = [], 0
    for batch in batches:
        for part in (batch.slice(0, rows - n), *(batch.slice(k, rows) for k in range(rows - n, batch.num_rows, rows))):
            wait.append(part)
            n += part.num_rows
            if n == rows:
                yield pa.Table.from_batches(wait).combine_chunks().to_batches()[0]
                wait, n = [], 0
    if n:
        yield pa.Table.from_batches(wait).combine_chunks().to_batches()[0]


def _second_pass(docs: DataFrame, plan, s: Settings) -> DataFrame:
    """(kind, x, y): signatures with classes; groups that are large within a batch are reduced to one
    marked row, with the pairs and members they stand for beside it; and for each class and band how many
    signatures its links have in common, as (class, number and band)."""
    def run(batches):
        v_of = plan.value
        bands, seen = s.bands(1000), set()
        for batch in _regrouped(batches, _HELD):
            sigs, classes, needs = [], [], []
            for text in batch.column("t"):
                found = shingle_set(text.as_py(), s.words)
                if not len(found):
                    continue
                mark = digest(found)
                if mark in seen:
                    continue
                seen.add(mark)
                while bands[-1][1] < len(found):
                    bands = s.bands(2 * bands[-1][1])
                for band in s.meeting_bands(len(found), bands):
                    own, need = _set_signatures(found, band, s.shape(bands[band][1])[1], v_of[band])
                    sigs.append(own)
                    classes.append(np.full(len(own), mark, np.int64))
                    needs.append((mark, need * (_BAND + 1) + band))
            if not sigs:
                continue
            yield from _batches(_NEED, *np.array(needs, np.int64).T.copy())
            x, y = np.concatenate(sigs), np.concatenate(classes)
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            size = np.diff(np.append(start, len(x)))
            large = np.repeat(size > s.small_group, size)
            first = np.zeros(len(x), bool)
            first[start] = True
            yield from _batches(_ROW, x[~large], y[~large])
            if large.any():
                yield from _batches(_HOT_ROW, x[large & first], y[large & first])
                rest = large & ~first
                centre = np.repeat(y[start], size)
                yield from _batches(_PAIR, *_distinct(centre[rest], y[rest]))
                yield from _batches(_GROUP, x[rest], y[rest])

    return docs.select("t").mapInArrow(run, "kind int, x long, y long")


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a < b, each once."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    keep = low < high
    low, high = low[keep], high[keep]
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return low[new], high[new]


def _closed_groups(x, y, hot, small):
    """Pairs and group members of whole groups; x ascending, hot marks groups known to be large."""
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    size = np.diff(np.append(start, len(x)))
    marked = np.logical_or.reduceat(hot, start)
    pairs_a, pairs_b = [], []
    for n in range(2, small + 1):
        at = start[(size == n) & ~marked]
        for i in range(n):
            for j in range(i + 1, n):
                pairs_a.append(y[at + i])
                pairs_b.append(y[at + j])
    big = np.repeat((size > small) | marked, size)
    pairs_a.append(np.repeat(y[start], size)[big])
    pairs_b.append(y[big])
    return _distinct(np.concatenate(pairs_a), np.concatenate(pairs_b)), (x[big], y[big])


def _third_pass(rows: DataFrame, s: Settings) -> DataFrame:
    """(kind, x, y): candidate pairs, and the members of large groups, from signatures in order; numbers
    of signatures pass through.

    The last group of a batch waits for the next batch; once it is large only its first member does.
    """
    def run(batches):
        wait = None  # x, y and mark of the group that may go on
        for batch in batches:
            kind, x, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for k in (_PAIR, _GROUP, _NEED):
                if (kind == k).any():
                    yield _batch(k, x[kind == k], y[kind == k])
            own = kind < _PAIR
            if not own.any():
                continue
            x, y, hot = x[own], y[own], kind[own] == _HOT_ROW
            if wait:
                x, y, hot = np.concatenate([wait[0], x]), np.concatenate([wait[1], y]), np.concatenate([wait[2], hot])
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            last = x == x[-1]
            marked = bool(hot[last].any())
            x, y, hot, last = x[new], y[new], hot[new], last[new]
            if marked:
                hot = hot | last
            going_on = int(last.sum())
            closed, tail = ~last, (x[last], y[last], hot[last])
            if going_on > s.small_group:
                closed, tail = np.ones(len(x), bool), (x[last][:1], y[last][:1], np.array([True]))
            wait = tail
            if closed.any():
                (a, b), members = _closed_groups(x[closed], y[closed], hot[closed] | (last[closed] if going_on > s.small_group else False), s.small_group)
                yield _batch(_PAIR, a, b)
                yield _batch(_GROUP, *members)
        if wait:
            (a, b), members = _closed_groups(*wait, s.small_group)
            yield _batch(_PAIR, a, b)
            yield _batch(_GROUP, *members)

    return rows.repartition("x").sortWithinPartitions("x", "y").mapInArrow(run, "kind int, x long, y long")


def _sifted(pairs: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """Candidates (cls_a, cls_b, w) as (a, cls_a, b, cls_b, w), without those whose sizes or sketches show
    that they are no links. All go through coarse sketches, and those left through fine ones."""
    names = ["a", "cls_a", "b", "cls_b", "w"]

    def sift(batches):
        for batch in batches:
            ends = zip(*(batch.column(c) for c in ("n_a", "n_b", "of_a", "of_b")))
            keep = [least_difference(*(np.frombuffer(v.as_buffer(), np.uint8) for v in (f, g))) * (100 + s.percent)
                    <= (n.as_py() + m.as_py()) * (100 - s.percent) for n, m, f, g in ends]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names], names=names).filter(pa.array(keep, pa.bool_()))

    for column in ("coarse", "sketch"):
        end = lambda e: classes.select(F.col("cls").alias(f"cls_{e}"), F.col("rep").alias(e), F.col("n").alias(f"n_{e}"), F.col(column).alias(f"of_{e}"))
        joined = (pairs.select("cls_a", "cls_b", "w").join(end("b"), "cls_b").join(end("a"), "cls_a")
                  .where(f"100 * least(n_a, n_b) >= {s.percent} * greatest(n_a, n_b)").select(*names, "n_a", "n_b", "of_a", "of_b"))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.select(*names).schema)
        pairs = cut_lineage(joined.mapInArrow(sift, schema))
    return pairs


def _between(docs: DataFrame, members: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """Candidates (cls_a, cls_b, w) between components of members (cls, component), by their rarest shingles.

    Take the shingles of each set from the rarest among members to the most frequent: two sets of the likeness
    asked for have one in common among the first n - ceil(n * percent / 100) + 1 of each, whatever the order is, as long as it is the same for all. The order comes from a sketch of counts, of bounded size;
    a shingle that is counted once has no partner and is not sent. A common shingle counts where what lies behind it
    can still suffice, and where the parities of the two sets differ in no more bits than a link's elements may: so sets
    that only resemble each other, however many share a shingle, are no pairs that leave the join. Nor is a pair that
    meets at an earlier shingle as well: each row knows the _BEFORE shingles before its own. w grows with the likeness
    that the parities leave possible.
    """
    spark = docs.sparkSession
    texts = cut_lineage(docs.join(members.join(classes.select("cls", "rep", "n"), "cls"), F.col("i") == F.col("rep"))
                        .select("cls", "component", "n", "t").dropDuplicates(["cls", "t"]))

    def count(batches):
        sums = np.zeros(_SKETCH, np.int64)
        for batch in batches:
            for t, cls in zip(batch.column("t"), batch.column("cls")):
                found = shingle_set(t.as_py(), s.words)
                if digest(found) == cls.as_py():
                    np.add.at(sums, (found & _U(_SKETCH - 1)).astype(np.int64), 1)
        cells = np.flatnonzero(sums)
        edges = np.searchsorted(cells, np.arange(0, _SKETCH + 1, _SLICE))
        parts = [(k, cells[a:b], sums[cells[a:b]]) for k, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in parts], pa.int32()), pa.array([c.astype(np.int32).tobytes() for _, c, _ in parts], pa.binary()),
                                          pa.array([n.astype(np.int32).tobytes() for _, _, n in parts], pa.binary())], ["slice", "cells", "sums"])

    def add(group):
        total = np.zeros(_SKETCH, np.int64)
        for cells, counts in zip(group["cells"], group["sums"]):
            total[np.frombuffer(cells, np.int32)] += np.frombuffer(counts, np.int32)
        k = int(group["slice"].iloc[0])
        return group[["slice"]].iloc[:1].assign(sums=np.minimum(total[k * _SLICE:(k + 1) * _SLICE], 2 ** 31 - 1).astype(np.int32).tobytes())

    sums = np.zeros(_SKETCH, np.int32)
    for row in texts.mapInArrow(count, "slice int, cells binary, sums binary").groupBy("slice").applyInPandas(add, "slice int, sums binary").collect():
        sums[row["slice"] * _SLICE:(row["slice"] + 1) * _SLICE] = np.frombuffer(row["sums"], np.int32)
    known = spark.sparkContext.broadcast(sums)  # 4 MB, whatever the input

    def rarest(batches):
        for batch in (whole.slice(k, _HELD // 16) for whole in batches for k in range(0, whole.num_rows, _HELD // 16)):
            held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            bits = np.zeros((batch.num_rows, _PARITY), np.int64)
            for row, (t, cls) in enumerate(zip(batch.column("t"), batch.column("cls"))):
                found = shingle_set(t.as_py(), s.words)
                if digest(found) != cls.as_py():
                    continue
                times = known.value[(found & _U(_SKETCH - 1)).astype(np.int64)]
                first = np.lexsort((found, times))[:len(found) - -(-len(found) * s.percent // 100) + 1]
                shared = np.flatnonzero(times[first] > 1)
                bits[row] = parities(found)
                held[0].append(found[first[shared]].view(np.int64))
                held[1].append(shared)
                held[2].append(np.full(len(shared), row))
            shingle, place, row = (np.concatenate(h) for h in held)
            at, back = np.arange(len(row)), np.arange(1, _BEFORE + 1)
            rank = at - np.searchsorted(row, row)
            before = shingle[(at[:, None] - back)[rank[:, None] >= back]]
            ends = np.concatenate([[0], np.cumsum(np.minimum(rank, _BEFORE))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(place), *(batch.column(c).take(pa.array(row)) for c in ("cls", "component", "n")),
                                              pa.ListArray.from_arrays(pa.array(ends), pa.array(before)),
                                              *(pa.array(bits[row, k]) for k in range(_PARITY))], ["shingle", "place", "cls", "component", "n", "before", *odd])

    kind = texts.schema["n"].dataType.simpleString()
    odd = [f"p{k}" for k in range(_PARITY)]
    rows = cut_lineage(texts.mapInArrow(rarest, f"shingle long, place long, cls long, component long, n {kind}, before array<long>, " + ", ".join(f"{p} long" for p in odd)))
    return _met(rows, s).groupBy("cls_a", "cls_b").agg(F.max("w").alias("w"))


def _met(rows: DataFrame, s: Settings) -> DataFrame:
    """Pairs (cls_a, cls_b, w) of rows of equal shingles that can be links; seldom one more than once."""
    a, b = rows.alias("a"), rows.alias("b")
    need = F.ceil((F.col("a.n") + F.col("b.n")) * F.lit(s.percent / (100 + s.percent)) - 1e-6)
    enough = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place")) >= need
    alike = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * s.percent
    turned = sum((F.bit_count(F.col(f"a.p{k}").bitwiseXOR(F.col(f"b.p{k}"))) for k in range(_PARITY)), F.lit(0))
    near = turned * (100 + s.percent) <= (F.col("a.n") + F.col("b.n")) * (100 - s.percent)
    met = F.arrays_overlap("a.before", "b.before")
    pairs = a.join(b, F.col("a.shingle") == F.col("b.shingle")).where((F.col("a.component") < F.col("b.component")) & alike & enough & near & ~met)
    return pairs.select(F.least("a.cls", "b.cls").alias("cls_a"), F.greatest("a.cls", "b.cls").alias("cls_b"),
                        (F.lit(1000) - F.floor(turned * 1000 / (F.col("a.n") + F.col("b.n")))).alias("w"))


def _across(placed: DataFrame, needs: DataFrame, turns: int = 3) -> DataFrame:
    """Members (sig, cls, component) of large groups that may have a link to another component that is no candidate.

    All signatures that such a link's sets have in common belong to large groups that span components, else one of
    them had made it a candidate: so a set that has fewer of them in a band than its links have in common there
    has none, and leaves its groups. What it leaves behind is looked at again, a few times.
    """
    least = needs.select("cls", F.col("need").bitwiseAND(_BAND).alias("band"), F.floor(F.col("need") / (_BAND + 1)).alias("least"))
    for _ in range(turns):
        spanning = placed.groupBy("sig").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c < d").select("sig")
        placed = placed.join(spanning, "sig").withColumn("band", F.col("sig").bitwiseAND(_BAND))
        enough = placed.groupBy("cls", "band").agg(F.count("*").alias("times")).join(least, ["cls", "band"]).where("times >= least").select("cls", "band")
        placed = cut_lineage(placed.join(enough, ["cls", "band"], "left_semi").select("sig", "cls", "component"))
    return placed


def _texts(docs: DataFrame, pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """docs' rows of the ids in pairs, written once; known rows are not read again."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("i")).distinct()
    if known is None:
        return cut_lineage(docs.join(wanted, "i", "left_semi"))
    wanted = cut_lineage(wanted.join(known.select("i"), "i", "left_anti"))
    return known.unionByName(cut_lineage(docs.join(wanted, "i", "left_semi"))) if wanted.limit(1).count() else known


def _verified(docs: DataFrame, pairs: DataFrame, s: Settings) -> DataFrame:
    """The pairs (cls_a, cls_b) whose sets reach the likeness; a and b are ids of documents.

    Texts travel, not sets: they are a third of the size. Where rows share an id, the one of the class
    asked for is found by its digest.
    """
    def compare(batches):
        last, first = None, None
        for batch in batches:
            keep = []
            for t, other, want_a, want_b in zip(batch.column("t"), batch.column("other"), batch.column("cls_a"), batch.column("cls_b")):
                t = t.as_py()
                if t != last:
                    last, first = t, shingle_set(t, s.words)
                g = shingle_set(other.as_py(), s.words)
                both = len(np.intersect1d(first, g, assume_unique=True))
                keep.append(100 * both >= s.percent * (len(first) + len(g) - both) and digest(first) == want_a.as_py() and digest(g) == want_b.as_py())
            yield pa.RecordBatch.from_arrays([batch.column("cls_a"), batch.column("cls_b")],
                                             schema=pa.schema([("cls_a", pa.int64()), ("cls_b", pa.int64())])).filter(pa.array(keep, pa.bool_()))

    other = docs.join(pairs, docs["i"] == pairs["b"]).select("a", "cls_a", "cls_b", F.col("t").alias("other"))
    return (docs.join(other, docs["i"] == other["a"]).select("t", "other", "cls_a", "cls_b")
            .mapInArrow(compare, "cls_a long, cls_b long").distinct())


def _settled(docs: DataFrame, pairs: DataFrame, labels: DataFrame | None, s: Settings, rounds: int) -> DataFrame:
    """Components (node, component) of classes: those known, joined by the links among pairs (a, cls_a, b, cls_b, w).

    In all rounds but the last each class has only its strongest pair to another component verified;
    pairs within a component found so are not looked at again. Components found before stand for their links.
    """
    tried = None
    for turn in range(rounds):
        rest = pairs
        if labels is not None:
            for end in ("a", "b"):
                rest = rest.join(labels.select(F.col("node").alias(f"cls_{end}"), F.col("component").alias(f"in_{end}")), f"cls_{end}", "left")
            rest = rest.where("coalesce(in_a, cls_a) <> coalesce(in_b, cls_b)").select(*pairs.columns)
        if tried is not None:
            rest = rest.join(tried, ["cls_a", "cls_b"], "left_anti").select(*pairs.columns)
        rest = cut_lineage(rest)
        if not rest.limit(1).count():
            break
        if turn < rounds - 1:
            strongest = F.max(F.struct("w", "cls_a", "cls_b", "a", "b")).alias("p")
            ends = rest.select(F.explode(F.array("cls_a", "cls_b")).alias("node"), "*")
            rest = cut_lineage(ends.groupBy("node").agg(strongest).select("p.*").distinct())
        now = rest.select("cls_a", "cls_b")
        tried = now if tried is None else tried.unionByName(now)
        found = cut_lineage(_verified(docs, rest.select("a", "cls_a", "b", "cls_b"), s)).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"))
        if labels is not None:
            found = found.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        labels = components(found)
    return docs.sparkSession.createDataFrame([], "node long, component long") if labels is None else labels


def similarity_components(docs: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), one row for each row of docs.

    component_id is the smallest id reachable by links. Texts that are null or without words have no
    shingles and are linked with nothing; so is a row with a null id, unless a row with an id has the
    same set. Repeated rows have equal sets and so one component. Other columns are not read. An empty
    table gives an empty table.
    """
    s, spark = settings, docs.sparkSession
    docs = docs.select(docs[id].alias("i"), docs[text].alias("t"))
    path = scratch_path(spark, "sets")
    _first_pass(docs, s).write.partitionBy("kind").parquet(path)
    first = spark.read.parquet(path) if docs.limit(1).count() else None
    if first is None:
        return docs.select(F.col("i").alias(id), F.lit(0).cast("long").alias("n_shingles"), F.col("i").alias("component_id"))
    sets = first.where("kind = 0").select("i", "n", "cls", "sketch", "coarse")
    plan = spark.sparkContext.broadcast(_plan(first.where("kind = 1"), s))  # a byte for each band and segment
    classes = cut_lineage(sets.where("n > 0").groupBy("cls").agg(F.min("i").alias("rep"), F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.max("coarse").alias("coarse"))
                          .where("rep IS NOT NULL"))
    path = scratch_path(spark, "candidates")
    _third_pass(_second_pass(docs, plan, s), s).write.partitionBy("kind").parquet(path)
    found = spark.read.schema("x long, y long, kind int").parquet(path)

    candidates = cut_lineage(found.where(f"kind = {_PAIR}").groupBy(F.col("x").alias("cls_a"), F.col("y").alias("cls_b")).agg(F.count("*").alias("w")))
    pairs = _sifted(candidates, classes, s)
    texts = _texts(docs, pairs)
    labels = _settled(texts, pairs, None, s, 3)
    members = found.where(f"kind = {_GROUP}").select(F.col("x").alias("sig"), F.col("y").alias("cls")).distinct()
    placed = members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select(
        "sig", "cls", F.coalesce("component", "cls").alias("component"))
    across = _across(placed, found.where(f"kind = {_NEED}").select(F.col("x").alias("cls"), F.col("y").alias("need")).distinct())
    if across.limit(1).count():
        more = _between(docs, across.select("cls", "component").distinct(), classes, s).join(candidates.select("cls_a", "cls_b"), ["cls_a", "cls_b"], "left_anti")
        more = _sifted(more, classes, s)
        labels = _settled(_texts(docs, more, texts), more, labels, s, 3)
    labels = labels.withColumnRenamed("node", "cls")
    named = classes.join(labels, "cls", "left").select("cls", "rep", F.coalesce("component", "cls").alias("component"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = named.join(smallest, "component").select("cls", "component_id")
    return sets.join(by_class, "cls", "left").select(
        F.col("i").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "i")).otherwise(F.col("i")).alias("component_id"))
