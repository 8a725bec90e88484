"""Verdicts of the compression bands, chunk by chunk, against a plain rewrite of the rule."""

import random

import pyarrow.parquet as pq
import pytest
import zstandard

from fleetsift.llm.quality_rules import Bands, judge_quality

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def prose(size, seed):
    """Words of a text, none of whose three-word windows need repeat."""
    mixed = random.Random(seed)
    known = ["".join(mixed.choices(LETTERS, k=mixed.randint(2, 9))) for _ in range(400)]
    out = ""
    while len(out) < size:
        out += mixed.choice(known) + " "
    return out[:size]


def noise(size, seed):
    mixed = random.Random(seed)
    return "".join(chr(mixed.randrange(33, 127)) for _ in range(size))  # 6.6 bits a byte, above the band


def filler(size):
    """Lines of one repeated word and a number: hardly a repeated window, but highly compressible."""
    return "".join(f"{'lorem' * 20} {k}\n" for k in range(size))[:size]


TEXTS = {
    "empty": "", "null": None, "below a chunk": prose(2047, 1), "one chunk": prose(2048, 2), "one byte more": prose(2049, 3),
    "filler at the end": prose(2048, 4) + filler(2000), "filler in the middle": prose(3000, 5) + filler(5000) + prose(3000, 6),
    "long with a third of filler": prose(40000, 7) + filler(22000), "long and clean": prose(60000, 8), "noise": noise(9000, 9),
    "noise at the end": prose(2048, 10) + noise(1900, 11), "beyond ASCII": "".join(chr(0x430 + random.Random(k).randrange(32)) if k % 7 else " " for k in range(5000)),
}


def verdict(text, bands):
    data = (text or "").encode()
    packed = lambda part: len(zstandard.ZstdCompressor(level=bands.level).compress(part)) / len(part)
    low, high = [(a, b) for start, a, b in bands.whole if len(data) >= start][-1]
    ratio = packed(data) if data else 1.0
    chunks, at = [], 0
    while at + bands.chunk_bytes <= len(data):
        chunks.append(data[at:at + bands.chunk_bytes])
        at += bands.chunk_bytes
    if chunks and at < len(data):
        chunks.append(data[-bands.chunk_bytes:])
    bad = [c for c in chunks if packed(c) < bands.chunk[0] or packed(c) > bands.chunk[1]]
    share = [limit for start, limit in bands.bad_share if len(data) >= start][-1]
    return len(chunks), len(bad), low <= ratio <= high and len(bad) <= share * len(chunks)


@pytest.mark.parametrize("of", ["made", "documents"])
def test_verdicts(spark, sf, of):
    texts = dict(enumerate(TEXTS.values())) if of == "made" else {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    rows = judge_quality(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, bad, kept = verdict(texts[r["doc_id"]], Bands())
        assert (r["n_chunks"], r["n_bad_chunks"], r["kept"]) == (n, bad, kept and not r["base_failed"])


def test_ends_and_long_texts_are_judged():
    got = {name: verdict(text, Bands()) for name, text in TEXTS.items()}
    assert got["below a chunk"][0] == 0 and got["one chunk"][0] == 1 and got["one byte more"][0] == 2
    assert got["filler at the end"][1] == got["noise at the end"][1] == 1
    assert not got["long with a third of filler"][2] and got["long and clean"][2]
