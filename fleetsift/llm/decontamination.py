"""Benchmark decontamination: a positional inverted index of the training texts, and phrase and proximity search on it.

The index is a table with one row for each segment, a run of documents of a few megabytes: the distinct
words, how often each occurs, and the positions of every occurrence in ascending order, word after word.
All words are stored, so one index serves any test set. A search takes the test windows in blocks of
bounded size. In a segment the lists of a window's words are intersected from the rarest word of the
whole corpus to the most frequent one, each list moved by the word's place in the window; a window with a
word that the segment lacks is never started. Segments are independent, so nothing is shuffled by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from fleetsift.session import bound_batches, cut_lineage

from .common import arrow_schema
from .tokens import byte_class, bytes_of, cut_words, numbered, stretches

#: Words are runs of digits, letters and everything beyond ASCII.
IN_WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_PIECE = 2048
#: A row of the index is megabytes long, and Parquet counts bytes only every hundred rows: each row is a row group of its
#: own, so that neither the writer nor a reader, which fetches up to 4,096 rows of a group at once, holds more than one.
_ROW_GROUPS = {"parquet.block.row.count.limit": 1}


@dataclass(frozen=True)
class Search:
    """width: words of a window; reach: how far from a window's rarest word its other words may stand in a
    proximity match, at least width - 1; block_words: words of test windows in one pass over the index;
    slab: alignments examined at a time."""
    width: int = 10
    reach: int = 20
    block_words: int = 4_000_000
    slab: int = 2_000_000


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text", segment_bytes: int = 8_000_000) -> DataFrame:
    """(segment, ids, sizes, terms, counts, positions), a row for each segment, written to the shared folder.

    ids and sizes: the documents and their numbers of words; terms: the distinct words; counts: occurrences of
    each; positions: of every occurrence, counted in words from the segment's start, ascending within a term.
    A text longer than segment_bytes is a segment alone. Null and empty texts have no words and keep their
    place; repeated rows and null ids stay; other columns are not read; an empty table gives an empty index.
    """
    kind = docs.schema[id].dataType.simpleString()
    bound_batches(docs.sparkSession)

    def run(batches):
        number = 0
        for batch in batches:
            data, edges = bytes_of(batch.column("t"))
            for a, b in stretches(edges, segment_bytes):
                words, _, before = cut_words(data[edges[a]:edges[b]], edges[a:b + 1] - edges[a], IN_WORD)
                codes, terms = numbered(words)
                counts = np.bincount(codes, minlength=len(terms))
                columns = [pa.array([(TaskContext.get().partitionId() << 32) + number]), _row(batch.column("i").slice(a, b - a)),
                           _row(pa.array(np.diff(before).astype(np.int32))), _row(terms.cast(pa.string())),
                           _row(pa.array(counts.astype(np.int32))), _row(pa.array(np.argsort(codes, kind="stable").astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, names)
                number += 1

    names = ["segment", "ids", "sizes", "terms", "counts", "positions"]
    return cut_lineage(docs.select(docs[id].alias("i"), docs[text].alias("t")).mapInArrow(
        run, f"segment long, ids array<{kind}>, sizes array<int>, terms array<string>, counts array<int>, positions array<int>"), **_ROW_GROUPS)


def _row(values: pa.Array) -> pa.Array:
    """A column of one row that holds the values as a list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class Block:
    """Distinct windows of some test texts: the words of each as numbers, and the items that hold it."""

    def __init__(self, pieces: list[tuple], width: int):
        codes, terms = numbered(pa.array([w for _, words in pieces for w in words], pa.large_string()))
        rows, owners, at = [], [], 0
        names: dict = {}
        for item, words in pieces:
            n = len(words)
            got = codes[at:at + n]
            at += n
            rows.append(np.lib.stride_tricks.sliding_window_view(got, width) if n >= width
                        else np.pad(got, (0, width - n), constant_values=-1)[None])
            owners.append(np.full(len(rows[-1]), names.setdefault(item, len(names))))
        windows, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners)], 1), axis=0)
        self.terms, self.windows, self.items = terms, windows, list(names)
        self.owners, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1))
        self.lengths = (windows >= 0).sum(1)

    def rank(self, known: dict[str, int]) -> None:
        """Fix the order in which the words of each window are taken: rarest first, ties by the word."""
        words = self.terms.to_pylist()
        order = sorted(range(len(words)), key=lambda k: (known.get(words[k], 0), words[k].encode()))
        place = np.empty(len(words) + 1, np.int64)
        place[order] = np.arange(len(words))
        place[-1] = len(words)
        self.order = np.argsort(place[self.windows], axis=1, kind="stable")


def _pieces(items: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """(item, words): the words of each item in stretches that overlap, so that each window lies in one."""
    def run(batches):
        for batch in batches:
            data, edges = bytes_of(batch.column("t"))
            words, _, before = cut_words(data, edges, IN_WORD)
            words, rows, lists = words.cast(pa.string()), [], []
            for k, (a, b) in enumerate(zip(before, before[1:])):
                for start in range(a, max(a + 1, b - width + 1) if b > a else a, _PIECE):
                    rows.append(k)
                    lists.append(words.slice(start, min(b, start + _PIECE + width - 1) - start).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("i").take(pa.array(rows, pa.int64())), pa.array(lists, pa.list_(pa.string()))], ["i", "w"])

    return cut_lineage(items.select(items[id].cast("string").alias("i"), items[text].alias("t")).mapInArrow(run, "i string, w array<string>"))


def _blocks(pieces: DataFrame, search: Search) -> Iterator[Block]:
    """The pieces in blocks of bounded size, one at a time."""
    held, n = [], 0
    for row in pieces.toLocalIterator():
        held.append((row["i"], row["w"]))
        n += len(row["w"])
        if n >= search.block_words:
            yield Block(held, search.width)
            held, n = [], 0
    if held:
        yield Block(held, search.width)


class _Lists:
    """The position lists of one segment for the words of a block; documents are set apart by a gap."""

    def __init__(self, row: dict, block: Block, gap: int):
        self.ids, self.sizes = row["ids"], row["sizes"].to_numpy(zero_copy_only=False).astype(np.int64)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.shift, self.base = gap, np.append(0, np.cumsum(self.sizes))
        found = pc.index_in(row["terms"].cast(pa.large_string()), value_set=block.terms).fill_null(-1).to_numpy(zero_copy_only=False)
        counts = row["counts"].to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(counts)
        hit = np.flatnonzero(found >= 0)
        hit = hit[np.argsort(found[hit])]
        self.count = np.zeros(len(block.terms) + 1, np.int64)
        self.count[found[hit]] = counts[hit]
        self.count[-1] = 1  # the padding of short windows
        self.start = np.append(0, np.cumsum(self.count[:-1]))
        places = row["positions"].to_numpy(zero_copy_only=False)[_ranges(ends[hit] - counts[hit], counts[hit])].astype(np.int64)
        self.keys = (np.repeat(found[hit].astype(np.int64), counts[hit]) << 32) + places + gap * self.owner[places]

    def holds(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term's list has a position from low to high."""
        at = np.searchsorted(self.keys, (term << 32) + low)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= (term << 32) + high)

    def place(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and word number of positions with gaps."""
        base = self.base[:-1] + self.shift * np.arange(len(self.sizes))
        doc = np.searchsorted(base, position, "right") - 1
        return doc, position - base[doc]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[k], starts[k] + 1, ... of every range, one range after another."""
    if not len(counts):
        return np.empty(0, np.int64)
    return np.repeat(starts - np.append(0, np.cumsum(counts[:-1])), counts) + np.arange(counts.sum())


def _intersect(lists: _Lists, block: Block, search: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, first word's position) of every phrase match, and the positions of rarest words with a proximity match."""
    live = np.flatnonzero((lists.count[block.windows] > 0).all(1))
    wins, starts, near = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    rarest = block.windows[live, block.order[live, 0]]
    sizes = lists.count[rarest]
    for a, b in stretches(np.append(0, np.cumsum(sizes)), search.slab):
        win = np.repeat(live[a:b], sizes[a:b])
        spot = lists.keys[_ranges(lists.start[rarest[a:b]], sizes[a:b])] & 0xFFFFFFFF
        for level in range(1, search.width):
            term = block.windows[win, block.order[win, level]]
            ok = (term < 0) | lists.holds(term, np.maximum(spot - search.reach, 0), spot + search.reach)
            win, spot = win[ok], spot[ok]
        near.append(np.unique(spot))
        start = spot - block.order[win, 0]
        for level in range(1, search.width):
            place = block.order[win, level]
            term = block.windows[win, place]
            ok = (term < 0) | lists.holds(term, start + place, start + place)
            win, start = win[ok], start[ok]
        wins.append(win)
        starts.append(start)
    return np.concatenate(wins), np.concatenate(starts), np.unique(np.concatenate(near))


def search_index(index: DataFrame, items: DataFrame, search: Search = Search(), id: str = "doc_id", item: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """(segment, place, id, n_words, spans, items, near), one row for each indexed document.

    spans: the word ranges [first, end) inside any occurrence of a window, joined and ascending; items: the ids of
    items with an occurring window, as strings, ascending; near: the places of words that are the rarest of
    some window whose other words all stand within search.reach words of them, in any order. Words are
    counted from 0. Items without words take no part; an item of fewer words than a window is one window; the
    windows of an item with a null id count for spans, not for items. An empty test table gives no matches.
    """
    kind = index.schema["ids"].dataType.elementType.simpleString()
    schema = (f"segment long, place int, i {kind}, n_words long, spans array<struct<first: int, end: int>>, items array<string>, near array<int>")
    gap = max(search.reach, search.width) + 1
    if search.reach < search.width - 1:
        raise ValueError("reach must cover a window")
    arrow = arrow_schema(schema)
    context = bound_batches(index.sparkSession).sparkContext
    found, passes = None, 0
    for block in _blocks(_pieces(items, item, item_text, search.width), search):
        block.rank(_counts(index, block))
        sent = context.broadcast(block)
        got = index.mapInArrow(lambda batches, sent=sent, first=not passes: _matches(batches, sent.value, search, gap, first, arrow), schema)
        found = got if found is None else found.unionByName(got)
        passes += 1
    if found is None:
        none = index.select("segment", F.posexplode(F.arrays_zip("ids", "sizes")).alias("place", "d"))
        return none.select("segment", "place", F.col("d.ids").alias(id), F.col("d.sizes").cast("long").alias("n_words"),
                           F.expr("array()").cast("array<struct<first: int, end: int>>").alias("spans"),
                           F.expr("array()").cast("array<string>").alias("items"), F.expr("array()").cast("array<int>").alias("near"))
    merged = found.groupBy("segment", "place").agg(
        F.max("i").alias("i"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near")) if passes > 1 else found
    return merged.withColumn("spans", joined_spans(F.col("spans"))).withColumnRenamed("i", id)


def joined_spans(spans: Column) -> Column:
    """Ranges sorted, those that meet or overlap made one."""
    kind = "array<struct<first: int, end: int>>"
    return F.aggregate(F.array_sort(spans), F.expr("array()").cast(kind), lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["first"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(s))))


def _counts(index: DataFrame, block: Block) -> dict[str, int]:
    """How often the block's words occur in the whole corpus."""
    sent = index.sparkSession.sparkContext.broadcast(block.terms)

    def run(batches):
        for batch in batches:
            terms, counts = batch.column("terms").flatten(), batch.column("counts").flatten()
            ours = pc.is_in(terms.cast(pa.large_string()), value_set=sent.value)
            yield pa.RecordBatch.from_arrays([terms.filter(ours), counts.filter(ours).cast(pa.int64())], ["term", "n"])

    rows = index.select("terms", "counts").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in rows.collect()}


def _matches(batches, block: Block, search: Search, gap: int, everything: bool, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of search_index for one block, segment by segment; without everything, only documents with a match."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name).slice(k, 1).flatten() for name in ("ids", "sizes", "terms", "counts", "positions")}
            lists = _Lists(row, block, gap)
            win, start, near = _intersect(lists, block, search)
            doc, first = lists.place(start)
            spans: dict[int, list] = {}
            for d, a, b in np.unique(np.stack([doc, first, first + block.lengths[win]], 1), axis=0).tolist():
                mine = spans.setdefault(d, [])
                if mine and mine[-1]["end"] >= a:
                    mine[-1]["end"] = max(mine[-1]["end"], b)
                else:
                    mine.append({"first": a, "end": b})
            held: dict[int, set] = {}
            for d, w in np.unique(np.stack([doc, win], 1), axis=0).tolist():
                held.setdefault(d, set()).update(block.owners[block.first[w]:block.first[w + 1]].tolist())
            close: dict[int, list] = {}
            for d, p in zip(*(x.tolist() for x in lists.place(near))):
                close.setdefault(d, []).append(p)
            docs = range(len(lists.sizes)) if everything else sorted(close)
            yield pa.RecordBatch.from_pydict({
                "segment": [batch.column("segment")[k].as_py()] * len(docs), "place": docs, "i": row["ids"].take(pa.array(docs, pa.int64())),
                "n_words": lists.sizes[list(docs)], "spans": [spans.get(d, []) for d in docs],
                "items": [sorted((block.items[i] for i in held.get(d, ()) if block.items[i] is not None), key=str.encode) for d in docs],
                "near": [close.get(d, []) for d in docs]}, schema=arrow)


def decontaminate(docs: DataFrame, items: DataFrame, search: Search = Search(), id: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, n_near), one row for each row of docs.

    The digest of search_index: words inside windows, items, and rarest words with a proximity match. Cases as there.
    """
    found = search_index(build_index(docs, id, text), items, search, id, item, item_text)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(id, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
                        F.size("near").cast("long").alias("n_near"))
