"""Best-fit packing by sums of squares: documents of tokens into sequences of a fixed capacity.

A document longer than the capacity is cut into full pieces, its first piece taking the rest; full
pieces are sequences as they stand. The other pieces are packed in groups of bounded size, dealt at
random. Within a group the longest come first, and each goes into the open sequence that makes the sum over
gap classes of the squared number of open sequences smallest, the smallest gap among equals; a sequence is
opened only for a piece that no open one takes, so at most one of a group stays half empty or more. What lies
in sequences with a gap of `spare` or more is dealt into new groups and packed again, level by level, until one
group is left; each level is written to the shared folder. Pieces that find no partner (600 of 1024 tokens,
say) never fill a sequence: once a level closes less than an eighth of its tokens, the next one lets all
sequences stand but those at most half full, of which a group has one. So no task holds more than a group,
every second level has at most seven eighths of the tokens, and the number of levels grows with the logarithm
of the input.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from itertools import compress, count
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from fleetsift.session import cut_lineage

from .common import map_batches

#: How the byte-level vocabulary splits text before its merges, for code points below U+0250, where
#: letters, numbers and white space are the classes spelled out here.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[^\x00-ɏ]")


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    Merges never cross a pre-token, so the ids of a pre-token are looked up, and the tokenizer runs for
    those not seen before. A store that is full becomes the elder one, from which pre-tokens still in use are
    taken over; so common ones stay, and at most twice `keep` are held, of some 160 bytes each: a task must not take
    more for them, as every core has a store. Texts with special tokens or with code points the split is not spelled
    out for go to the tokenizer whole.
    """

    def __init__(self, path: str, keep: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer, self.keep, self.known, self.elder = Tokenizer.from_file(path), keep, {}, {}
        self.feed: int | None = None  # id of a line feed
        added = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) if added else r"(?!)")

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, missing: list[str]) -> None:
        """Ids of pre-tokens never seen. Those that are not white space are encoded as lines of one text:
        a line feed stands as a pre-token of its own, so the lines' ids are those of each alone."""
        blank = [p for p in missing if p.isspace()]
        self.known.update(zip(blank, self._bytes(blank)))
        lines = [p for p in missing if not p.isspace()]
        if not lines:
            return
        if self.feed is None:  # the first lines show that each is one word between line feeds
            got = self.tokenizer.encode("\n".join(lines), add_special_tokens=False)
            (self.feed,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
            if got.word_ids[-1] != 2 * len(lines) - 2:
                raise ValueError("the tokenizer does not split texts as byte-level ones do")
        else:
            got = self.tokenizer.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0]
        ids = np.array(got.ids, "<u4")
        edge = [-1, *np.flatnonzero(ids == self.feed).tolist(), len(ids)]
        if len(edge) != len(lines) + 1:
            raise ValueError("the tokenizer does not split texts as byte-level ones do")
        data = ids.tobytes()
        self.known.update((p, data[4 * i + 4:4 * j]) for p, i, j in zip(lines, edge, edge[1:]))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.keep:
            self.known, self.elder = {}, self.known
        known, elder = self.known, self.elder
        plain = [not (_BEYOND.search(t) or self.special.search(t)) for t in texts]
        split, found, holes = [], [], []
        for t, ok in zip(texts, plain):
            split.append(parts := PRE_TOKEN.findall(t) if ok else [])
            found.append(ids := [*map(known.get, parts)])  # looked up once; few are missing
            holes.append([*compress(count(), map(not_, ids))])
        missing = {parts[k] for parts, own in zip(split, holes) for k in own}
        known.update((p, elder[p]) for p in missing if p in elder)
        self._learn([p for p in missing if p not in known])
        for parts, ids, own in zip(split, found, holes):
            for k in own:
                ids[k] = known[parts[k]]
        return [b"".join(ids) if ok else self._bytes([t])[0] for t, ids, ok in zip(texts, found, plain)]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of this Python process; tasks that run in it one after another share what it has seen."""
    return Encoder(path)


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: full ones, with what is left over in front."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id: str = "doc_id",
                 text: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): every document's ids followed by end_id, cut.

    A null text counts as empty: the end alone. Repeated rows each give their pieces, a null id stays
    null, an empty table gives an empty table; other columns are not read.
    """
    kind = dict(docs.select(id).dtypes)[id]
    names = ["i", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def make():
        own_encoder, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()

        def work(batch: dict) -> dict:
            rows = []
            for at in range(0, len(batch["i"]), 64):
                for i, data in zip(batch["i"][at:at + 64], own_encoder.encode([t or "" for t in batch["t"][at:at + 64]])):
                    data, start = data + end, 0
                    for k, n in enumerate(cut_lengths(len(data) // 4, capacity)):
                        own = data[4 * start:4 * (start + n)]
                        rows.append((i, k, start, n, zlib.crc32(own), np.frombuffer(own, "<u4") if with_ids else None))
                        start += n
            return {name: [r[k] for r in rows] for k, name in enumerate(names)}
        return work

    schema = f"i {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return map_batches(docs.select(docs[id].alias("i"), docs[text].alias("t")), make, schema).withColumnRenamed("i", id)


def place(sizes: np.ndarray, capacity: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every size, in the order given, and the gaps left in the bins.

    Classes hold `width` gaps each; gaps of the first class count as closed in the sum, but still take what fits.
    """
    kind = np.arange(capacity + 1) // width
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    by_gap, by_kind = np.zeros(capacity + 1, np.int64), np.zeros(kind[-1] + 1, np.int64)
    bins, offsets, gaps = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    for k, size in enumerate(sizes):
        fits = np.flatnonzero(by_gap[size:capacity]) + size
        if len(fits):
            a, b = kind[fits], kind[fits - size]
            change = np.where(a > 0, 1 - 2 * by_kind[a], 0) + np.where(b > 0, 1 + 2 * by_kind[b], 0) - 2 * ((a == b) & (a > 0))
            gap = int(fits[np.argmin(change)])
            at = open_bins[gap].pop()
            by_gap[gap] -= 1
            by_kind[kind[gap]] -= kind[gap] > 0
        else:
            gap, at = capacity, len(gaps)
            gaps.append(capacity)
        left = gap - int(size)
        bins[k], offsets[k], gaps[at] = at, capacity - gap, left
        if left:
            open_bins[left].append(at)
            by_gap[left] += 1
            by_kind[kind[left]] += kind[left] > 0
    return bins, offsets, np.array(gaps, np.int64)


def _amount(pieces: DataFrame) -> tuple[int, int]:
    """How many pieces there are, and their tokens."""
    total, tokens = pieces.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return total, int(tokens)


def pack(pieces: DataFrame, capacity: int = 1024, width: int = 4, spare: int = 32, group: int = 4000,
         regroup: int = 200) -> DataFrame:
    """pieces (with a length of 1 to capacity) with sequence_id and offset; offsets are gapless from 0.

    Columns of these names are replaced, others are carried along. Repeated rows are pieces of their
    own. An empty table gives an empty table.
    """
    order = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    carried = [c for c in order if c != "length"]
    names = ["length"] + [f"c{k}" for k in range(len(carried))]
    pieces = cut_lineage(pieces.select("length", *[pieces[c].alias(f"c{k}") for k, c in enumerate(carried)]))
    full = pieces.where(F.col("length") >= capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity).withColumn("_row", F.monotonically_increasing_id())
    (total, tokens), level, base, settle, done = _amount(rest), 0, 0, False, [full]
    while total:
        groups = max(1, min(-(-total // (regroup if level and not settle else group)), tokens // (32 * capacity)))
        last = groups == 1
        dealt = rest.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(level)), F.lit(groups)))
        schema = StructType(dealt.schema.fields + [StructField("sequence_id", LongType()), StructField("offset", LongType()), StructField("_open", BooleanType())])

        def run(rows: pa.Table) -> pa.Table:
            rows = rows.take(pc.sort_indices(rows, [("length", "descending"), ("_row", "ascending")]))
            bins, offsets, gaps = place(rows["length"].to_numpy(), capacity, width)
            found = base + (rows["_group"].to_numpy().astype(np.int64) << 20) + bins
            left_open = (gaps[bins] >= (-(-capacity // 2) if settle else spare)) & (not last)
            return pa.Table.from_arrays([*rows.columns, pa.array(found), pa.array(offsets), pa.array(left_open)], names=schema.names)

        packed = cut_lineage(dealt.groupBy("_group").applyInArrow(run, schema))
        done.append(packed.where("NOT _open").select(*names, "sequence_id", "offset"))
        rest = packed.where("_open").select(*names, "_row")
        before, (total, tokens) = tokens, (0, 0) if last else _amount(rest)
        settle, base, level = not settle and 8 * tokens > 7 * before, base + (groups << 20), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    place_of = {c: f"c{k}" for k, c in enumerate(carried)}
    return out.select(*[F.col(place_of.get(c, c)).alias(c) for c in order], "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of every sequence, from packed pieces that carry theirs."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id, id, text), capacity)
