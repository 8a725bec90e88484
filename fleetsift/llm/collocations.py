"""Phrase collocation mining: phrases of up to four words that stay together, scored and listed by language.

A phrase occurs at most as often as its parts, so each length is counted only where the two phrases one word
shorter are frequent. Phrases are first counted by code in a HAT-trie per task: its subtrees leave it as sorted
runs, runs are dealt by prefix (the first two words and a few bits of the rest, so that one hot prefix is
many parts) and merged there. Codes that reach the threshold are kept as a Bloom filter of bounded size.
Codes only sift: phrases that pass are counted again by their words, so no collision of codes or filter
reaches a result. That count is summed up in the task, in a table of bounded size, and dealt by phrase to merge parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetsift.session import cut_lineage

from .hat_trie import HatTrie, tally
from .shingles import _power, mix
from .tokens import byte_class, bytes_of, cut_words, numbered, stretches

_U = np.uint64
#: Space, tab, line ends and the marks that end a piece are no part of words.
IN_WORD = ~byte_class((0x20, 0x20), (0x09, 0x0D), (0x2E, 0x2E), (0x2C, 0x2C), (0x3A, 0x3B), (0x21, 0x21), (0x3F, 0x3F))
BREAKS = byte_class((0x0A, 0x0D), (0x2E, 0x2E), (0x2C, 0x2C), (0x3A, 0x3B), (0x21, 0x21), (0x3F, 0x3F))
_STEP, _TURN = _U(0xD6E8FEB86659FD93), _U(0x9E3779B97F4A7C15)
#: Bits of a code that belong to the first word, and to the first two.
_FIRST, _SECOND = 12, 12


@dataclass(frozen=True)
class Mining:
    """longest: words of a phrase; least: occurrences of a candidate; cover: percent of a candidate's occurrences inside a
    longer one at which it is dropped; top: phrases listed for each language; scale: factor of the score;
    filter_bits: bits of a filter at most, as a power of two; part_bytes: bytes of text for each merge part;
    stretch: bytes of text counted at a time; trie: entries a task holds."""
    longest: int = 4
    least: int = 30
    cover: int = 80
    top: int = 2000
    scale: int = 2_000_000
    filter_bits: int = 28
    part_bytes: int = 16_000_000
    stretch: int = 4_000_000
    trie: int = 2_000_000


def word_ids(words: pa.Array, lang: str) -> np.ndarray:
    """A 64-bit number for each word of a language, the same everywhere."""
    words = words.cast(pa.large_string())
    edges = np.frombuffer(words.buffers()[1], np.int64)[words.offset: words.offset + len(words) + 1]
    if not len(words):
        return np.empty(0, _U)
    data = np.frombuffer(words.buffers()[2], np.uint8)[edges[0]: edges[-1]]
    edges = edges - edges[0]
    power, inverse = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * power[:-1], dtype=_U, out=total[1:])
    own = mix((total[edges[1:]] - total[edges[:-1]]) * inverse[edges[:-1]] + np.diff(edges).astype(_U))
    salt = np.frombuffer(lang.encode("utf-8", "surrogatepass"), np.uint8).astype(_U)
    return mix(own + mix(np.array([(salt * _power(len(salt) + 1)[0][1:]).sum(dtype=_U) + _U(len(salt))], _U)))


class Filter:
    """A Bloom filter with two probes of a code."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        size = 1 << bits
        self.bits, self.cells = bits, np.zeros(max(size // 8, _BLOCK // 8), np.uint8)
        for k, block in blocks.items():
            self.cells[k * _BLOCK // 8: (k + 1) * _BLOCK // 8] = np.frombuffer(block, np.uint8)

    @staticmethod
    def slots(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        shift = _U(64 - bits)
        return (mix(codes + _TURN) >> shift).astype(np.int64), (mix(codes ^ _STEP) >> shift).astype(np.int64)

    def holds(self, codes: np.ndarray) -> np.ndarray:
        a, b = self.slots(codes, self.bits)
        return ((self.cells[a >> 3] >> (a & 7).astype(np.uint8)) & (self.cells[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


#: Bits of one block of bitmap_construct_agg.
_BLOCK = 32768


def build_filter(codes: DataFrame, most: int) -> Filter:
    """The filter of a column `code`: 32 bits for each code, at most 2^most. Blocks are built on executors."""
    n = codes.count()
    bits = min(most, max(15, math.ceil(math.log2(32 * n + 1))))

    def run(batches):
        for batch in batches:
            slots = Filter.slots(batch.column("code").to_numpy(zero_copy_only=False).view(_U), bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(slots)))], ["slot"])

    slot = F.col("slot") + 1
    blocks = (codes.mapInArrow(run, "slot long").groupBy((F.bitmap_bucket_number(slot) - 1).alias("k"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("cells")))
    return Filter(bits, {r["k"]: bytes(r["cells"]) for r in blocks.collect()})


class Texts:
    """The words of some texts of one language, and which phrases of them are still in question."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, lang: str):
        self.words, starts, before = cut_words(data, edges, IN_WORD)
        self.codes, self.terms = numbered(self.words)
        ends = np.cumsum(BREAKS[data], dtype=np.int32)
        piece = (ends[starts] if len(starts) else starts) + np.repeat(np.arange(len(edges) - 1), np.diff(before))
        self.follows = piece[1:] == piece[:-1] if len(piece) else np.empty(0, bool)
        self.lang = lang

    def sift(self, filters: list[Filter], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, codes) of the phrases of 2 to length words whose shorter parts all pass the filters."""
        ids = word_ids(self.terms, self.lang)
        good = filters[0].holds(ids)[self.codes]
        places = np.flatnonzero(good[:-1] & good[1:] & self.follows) if len(good) else np.empty(0, np.int64)
        words, found = ids[self.codes], []
        first = mix(words[places] + _STEP)
        whole = mix(first + words[places + 1])
        lead = (first >> _U(64 - _FIRST)) << _U(64 - _FIRST)
        codes = lead | (whole >> _U(_FIRST))
        found.append((places, codes))
        lead |= (whole >> _U(64 - _SECOND)) << _U(64 - _FIRST - _SECOND)
        for n in range(3, length + 1):
            good = filters[n - 2].holds(codes)
            both = np.flatnonzero(good[:-1] & good[1:] & (places[1:] == places[:-1] + 1)) if len(places) else places
            places, lead, whole = places[both], lead[both], mix(whole[both] * _STEP + words[places[both] + n - 1])
            codes = lead | (whole >> _U(_FIRST + _SECOND))
            found.append((places, codes))
        return found

    def phrases(self, places: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray]:
        """Distinct phrases of n words at the places, and how often each stands there."""
        key = self.codes[places]
        for k in range(1, n):
            pair = key * len(self.terms) + self.codes[places + k]
            key = np.unique(pair, return_inverse=True)[1]
        _, at, counts = np.unique(key, return_index=True, return_counts=True)
        at = places[at]
        parts = [self.words.take(pa.array(at + k)) for k in range(n)]
        return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())).cast(pa.string()), counts


def _texts(batches, stretch: int) -> Iterator[Texts]:
    for batch in batches:
        langs = batch.column("lang")
        for lang in pc.unique(langs).to_pylist():
            data, edges = bytes_of(batch.column("t").filter(pc.equal(langs, lang)))
            for a, b in stretches(edges, stretch):
                yield Texts(data[edges[a]:edges[b]], edges[a:b + 1] - edges[a], lang)


def _frequent_codes(docs: DataFrame, filters: list, length: int, parts: int, mining: Mining) -> DataFrame:
    """Codes of phrases of a length that come up often enough."""
    def dealt(runs) -> Iterator[pa.RecordBatch]:
        if not runs:
            return
        codes, counts = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
        part = (mix(codes >> _U(32)) % _U(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        full = np.flatnonzero(np.diff(edges))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)),
                                          pa.array([codes[order[edges[k]:edges[k + 1]]].tobytes() for k in full], pa.binary()),
                                          pa.array([counts[order[edges[k]:edges[k + 1]]].astype(np.uint32).tobytes() for k in full], pa.binary())],
                                         ["part", "codes", "counts"])

    def count(batches):
        trie = HatTrie(limit=mining.trie)
        for texts in _texts(batches, mining.stretch):
            if length == 1:
                found = tally(word_ids(texts.terms, texts.lang), np.bincount(texts.codes, minlength=len(texts.terms)))
            else:
                found = tally(texts.sift([f.value for f in filters], length)[-1][1])
            yield from dealt(trie.add(*found))
        yield from dealt(trie.drain())

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        codes, counts = tally(np.frombuffer(b"".join(group["codes"]), _U), np.frombuffer(b"".join(group["counts"]), np.uint32).astype(np.int64))
        return pd.DataFrame({"code": codes[counts >= mining.least].view(np.int64)})

    runs = docs.mapInArrow(count, "part int, codes binary, counts binary")
    return cut_lineage(runs.groupBy("part").applyInPandas(merge, "code long"))


def count_phrases(docs: DataFrame, mining: Mining = Mining(), text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of every phrase of up to mining.longest words with enough occurrences, and (lang, n), the number of words.

    Occurrences overlap, lie inside one piece of one text, and are counted in whole texts over all rows. A null
    language is `und`; null and empty texts have no words; repeated rows count again; other columns are not
    read; an empty table gives empty tables.
    """
    context = docs.sparkSession.sparkContext
    read = docs.select(F.coalesce(docs[lang], F.lit("und")).alias("lang"), docs[text].alias("t")).where("t <> ''")
    size = read.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts, filters = max(1, math.ceil(size / mining.part_bytes)), []
    for length in range(1, mining.longest + 1):
        filters.append(context.broadcast(build_filter(_frequent_codes(read, list(filters), length, parts, mining), mining.filter_bits)))

    def packed(held: pa.Table) -> pa.RecordBatch:
        """A row for each language and part, with the phrases a line feed apart, which no phrase holds."""
        part = word_ids(held["phrase"].combine_chunks(), "") % _U(parts)
        order = pc.sort_indices(held.append_column("part", pa.array(part)), [("lang", "ascending"), ("part", "ascending")])
        held, part = held.take(order), part[order.to_numpy()]
        langs = held["lang"].combine_chunks().dictionary_encode()
        lang = langs.indices.to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (lang[1:] != lang[:-1]), [True]]))
        phrases, counts = held["phrase"].combine_chunks().cast(pa.string()), held["a"].to_numpy()
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), phrases), "\n")
        return pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]].astype(np.int32)), langs.dictionary.take(pa.array(lang[edges[:-1]])), joined,
                                           pa.array([counts[i:j].tobytes() for i, j in zip(edges, edges[1:])], pa.binary())], ["part", "lang", "phrases", "counts"])

    def summed(held: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(held).group_by(["lang", "phrase"], use_threads=False).aggregate([("a", "sum")])
        return found.select(["lang", "phrase", "a_sum"]).rename_columns(["lang", "phrase", "a"])

    def exact(batches):
        known, held, most = [f.value for f in filters], [], mining.trie
        for texts in _texts(batches, mining.stretch):
            often = known[0].holds(word_ids(texts.terms, texts.lang))
            found = [(pa.array([""]), np.array([len(texts.codes)])),
                     (texts.terms.filter(pa.array(often)).cast(pa.string()), np.bincount(texts.codes, minlength=len(often))[often])]
            for n, (places, codes) in enumerate(texts.sift(known, mining.longest), 2):
                found.append(texts.phrases(places[known[n - 1].holds(codes)], n))
            held += [pa.table([pa.array([texts.lang] * len(counts), pa.string()), phrases.cast(pa.large_string()), pa.array(counts, pa.int64())], ["lang", "phrase", "a"])
                     for phrases, counts in found]
            if sum(map(len, held)) > most:
                held = [summed(held)]
                if 2 * len(held[0]) > most:
                    yield packed(held[0])
                    held = []
        if held:
            yield packed(summed(held))

    def merge(group: pa.Table) -> pa.Table:
        held = []
        for lang, phrases, counts in zip(group["lang"].to_pylist(), group["phrases"], group["counts"]):
            each = pc.split_pattern(phrases.cast(pa.large_string()), "\n").values
            held.append(pa.table([pa.array([lang] * len(each), pa.string()), each, pa.array(np.frombuffer(counts.as_buffer(), np.int64))], ["lang", "phrase", "a"]))
        found = summed(held)
        words = np.where(pc.equal(found["phrase"], ""), 0, pc.add(pc.count_substring(found["phrase"], " "), 1).to_numpy())
        found = pa.table([found["lang"], found["phrase"].cast(pa.string()), pa.array(words.astype(np.int32)), found["a"]], ["lang", "phrase", "words", "a"])
        return found.filter(pa.array((words == 0) | (found["a"].to_numpy() >= mining.least)))

    counted = cut_lineage(read.mapInArrow(exact, "part int, lang string, phrases string, counts binary")
                          .groupBy("part").applyInArrow(merge, "lang string, phrase string, words int, a long"))
    return counted.where("words > 0"), counted.where("words = 0").select("lang", F.col("a").alias("n"))


def _some(words: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def mine_collocations(docs: DataFrame, mining: Mining = Mining(), text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score), the first mining.top phrases of each language. Cases as in count_phrases."""
    counts, sizes = count_phrases(docs, mining, text, lang)
    many = counts.where("words > 1").withColumn("w", F.split("phrase", " "))
    one = F.lit(1)
    cuts = many.select("lang", "phrase", "w", "a", F.explode(F.sequence(one, F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _some(F.col("w"), one, F.col("k")).alias("first"), _some(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    part = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    scored = scored.withColumn("score", F.expr(f"cast(a AS decimal(20,0)) * {mining.scale} div cast(l + r AS decimal(20,0))"))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("b"))
    places = many.where("words > 2").select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    inner = places.select("lang", "a", "w", "m", F.explode(F.sequence(one, F.size("w") - F.col("m") + 1)).alias("s")).select(
        "lang", _some(F.col("w"), F.col("s"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    large = lambda c: F.col(c).cast("decimal(20,0)")
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("around").isNull() | (large("around") * 100 < large("a") * mining.cover))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "b.l", "b.r", "b.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= mining.top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
