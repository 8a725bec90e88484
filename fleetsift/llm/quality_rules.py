"""Quality rules: compression bands over whole documents and fixed chunks.

The zstandard ratio (compressed bytes by bytes) of repetitive text is low and that of noise is high.
What is usual depends on the length, so each length class has its own band. A document is rejected if
its own ratio lies outside the band of its length, or if more of its chunks than the share of its length
lie outside the band of the chunk length. Chunks have a fixed length; what is left at the end is judged as
the chunk that ends there, so every byte of a text that holds a chunk belongs to one.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import WORD, map_batches

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits by length in bytes, ascending: (shortest length, lowest ratio, highest ratio) of whole texts,
    and (shortest length, highest share of chunks outside their band)."""
    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 9.9), (200, 0.40, 1.05), (500, 0.36, 0.90), (1000, 0.32, 0.80), (4000, 0.28, 0.70), (32000, 0.20, 0.62))
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (0.30, 0.80)
    bad_share: tuple[tuple[int, float], ...] = ((0, 0.5), (8192, 0.4), (32000, 0.3))
    level: int = 3

    def of(self, length: int) -> tuple[float, float]:
        low, high = 0.0, 9.9
        for start, a, b in self.whole:
            if length >= start:
                low, high = a, b
        return low, high

    def share(self, length: int) -> float:
        return max((limit for limit in self.bad_share if length >= limit[0]), default=(0, 1.0))[1]


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, and words in repeated three-word windows."""
    found = WORD.findall(text)
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                repeated += 1
            seen.add(line)
    windows = list(zip(found, found[1:], found[2:]))
    times = Counter(windows)
    covered, until = 0, 0
    if len(times) < len(windows):
        for at, window in enumerate(windows):
            if times[window] > 1:
                covered += at + 3 - max(at, until)
                until = at + 3
    return len(found), sum(map(len, found)), sum(map(text.count, SYMBOLS)), repeated, covered


def ratios(text: str, bands: Bands, compressor) -> tuple[float, int, int, int]:
    """Length in bytes, ratio of the whole text, number of chunks, and how many of them lie outside the chunk band."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return 1.0, 0, 0
    whole = len(compressor.compress(data)) / len(data)
    size = bands.chunk_bytes
    low, high = bands.chunk
    starts = [*range(0, len(data) - size + 1, size)]
    if starts and len(data) % size:
        starts.append(len(data) - size)
    bad = sum(not low <= len(compressor.compress(data[at:at + size])) / size <= high for at in starts)
    return whole, len(starts), bad


def judge_quality(docs: DataFrame, bands: Bands = Bands(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, n_chunks,
    n_bad_chunks, kept), one row for each row.

    base_failed: under 50 words, or more than half of the words in three-word windows that occur twice
    or more. kept is false for those, else the verdict of the bands. A null text counts as empty: no
    words, ratio 1, not kept. Texts are taken whole. Repeated rows stay, a null id stays null, other
    columns are not read, an empty table gives an empty table.
    """
    def make():
        import zstandard
        compressor = zstandard.ZstdCompressor(level=bands.level)

        def work(batch: dict) -> dict:
            rows = []
            for body in batch["t"]:
                body = body or ""
                n, chars, symbols, lines, repeat = base_counts(body)
                failed = n < 50 or 100 * repeat > 50 * n
                ratio, chunks, bad = ratios(body, bands, compressor)
                length = len(body.encode("utf-8", "surrogatepass"))
                low, high = bands.of(length)
                kept = not failed and low <= ratio <= high and bad <= bands.share(length) * chunks
                rows.append((n, chars, symbols, lines, repeat, failed, ratio, chunks, bad, kept))
            return {"i": batch["i"]} | {name: [r[k] for r in rows] for k, name in enumerate(names)}
        return work

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio",
             "n_chunks", "n_bad_chunks", "kept"]
    kind = dict(docs.select(id).dtypes)[id]
    got = map_batches(docs.select(docs[id].alias("i"), docs[text].alias("t")), make,
                      f"i {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                      "base_failed boolean, ratio double, n_chunks long, n_bad_chunks long, kept boolean")
    return got.withColumnRenamed("i", id)
