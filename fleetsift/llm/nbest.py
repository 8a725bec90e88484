"""SentencePiece encoding and decoding, with the N best segmentations.

White space is written as ▁ and one ▁ is put in front. Pieces never run on over the start of a word, so
the piece lattice of a text is a row of small lattices, one for each word with the ▁ before it. In each,
forward Viterbi scores are the exact best scores of all prefixes. A backward search from the end takes
the open path with the best sum of its own score and the forward score of where it stands; as that
estimate is exact, paths are completed in order of their scores, and no path is taken up that is not
part of one of the N best.

The best segmentation of a text joins those of its words. Another of its N best departs from it in few
words, and only in those N - 1 places where departing costs least; the cost is known from the forward
pass, which keeps the two best scores. So the backward search runs for those places alone, and the N
best of the text are the N cheapest combinations. Words seen before are looked up.

Characters without a piece are spelled in byte pieces. Decoding gives back the very text.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, count
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches
from .shingles import mix

SPACE = "▁"
_LITERAL = "\udc00"  # stands for a ▁ of the text itself; no text from Spark holds a lone surrogate
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
#: Bits of the number that marks a beginning of pieces.
_BEGIN_BITS = 22
#: Characters of the texts that are encoded together.
_RUN = 6_000_000


def zipf_score(rank: int) -> float:
    """Log of a Zipf-Mandelbrot weight, for vocabularies whose scores are ranks of merges."""
    return -float(np.log(rank + 2.7))


class Lattice:
    """Pieces, their scores, and searches over the words of texts."""

    def __init__(self, model: str, scores: str = "zipf", keep: int = 300_000):
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=model)
        plain = [i for i in range(sp.get_piece_size())
                 if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        if any(re.search(f"[^{SPACE}]{SPACE}", sp.id_to_piece(i)) for i in plain):
            raise ValueError("pieces run over the start of a word")
        ranked = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        self.score = {sp.id_to_piece(i): (zipf_score(k) if scores == "zipf" else sp.get_score(i), i) for k, i in enumerate(ranked)}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no byte pieces to spell other characters")
        spelled = {i: bytes([b]) for b, i in self.bytes.items()}
        whole = {i: sp.id_to_piece(i).replace(SPACE, " ").encode() for i in plain}
        self.read = [spelled.get(i, whole.get(i, b"")) for i in range(sp.get_piece_size())]
        self.spelled = min(s for s, _ in self.score.values()) - 10  # of one byte
        self.longest = max(map(len, self.score))
        keys = self._hashes(list(self.score))
        order = np.argsort(keys)
        self.keys, self.values, self.ids = keys[order], *(np.array(v)[order] for v in zip(*self.score.values()))
        self.begins = np.zeros(1 << _BEGIN_BITS, bool)  # marks all beginnings of pieces, and some others
        for size in set(map(len, self.score)):
            codes, rolling = self._points([p for p in self.score if len(p) == size], size), _U(0)
            for width in range(1, size + 1):
                rolling = rolling * _STEP + codes[width - 1]
                self.begins[self._key(rolling, width) >> _U(64 - _BEGIN_BITS)] = True
        self.pieces = pa.array(self.read, pa.large_binary())
        self.keep, self.known, self.elder, self.searched = keep, {}, {}, {}

    # ---- forward -----------------------------------------------------------------

    @staticmethod
    def _hashes(pieces: list[str]) -> np.ndarray:
        out = []
        for p in pieces:
            h = _U(len(p))
            with np.errstate(over="ignore"):
                for c in p:
                    h = h * _STEP + _U(ord(c) + 1)
            out.append(h)
        return mix(np.array(out, _U))

    @staticmethod
    def _points(words: list[str], size: int) -> np.ndarray:
        """Numbers of the characters of words of one size, a row for each place."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), size).astype(_U) + _U(1)
        return np.ascontiguousarray(codes.T)

    @staticmethod
    def _key(rolling: np.ndarray, width: int) -> np.ndarray:
        """The hash of a piece of length L is that of its characters plus L * step^L."""
        return mix(rolling + _U((width * pow(int(_STEP), width, 1 << 64)) % (1 << 64)))

    def _spell(self, c: str) -> bytes:
        return (SPACE if c == _LITERAL else c).encode()

    def edge(self, piece: str) -> tuple[float, tuple[int, ...]] | None:
        """Score and ids of a stretch of a word, if it is a piece or a character to spell."""
        got = self.score.get(piece)
        if got:
            return got[0], (got[1],)
        if len(piece) == 1:
            spelled = self._spell(piece)
            return self.spelled * len(spelled), tuple(self.bytes[b] for b in spelled)
        return None

    def _forward(self, words: list[str]) -> None:
        """Best ids, best score and the cost of the second best, for words of one length."""
        n, size = len(words), len(words[0])
        codes = self._points(words, size)
        best, second = np.full((size + 1, n), -np.inf), np.full((size + 1, n), -np.inf)
        back, piece = np.zeros((size + 1, n), np.int64), np.zeros((size + 1, n), np.int64)
        best[0] = 0
        last, every = len(self.keys) - 1, np.arange(n)
        for start in range(size):
            rolling, going = np.zeros(n, _U), every  # words in which a piece may begin so
            for end in range(start + 1, min(size, start + self.longest) + 1):
                rolling = rolling * _STEP + codes[end - 1, going]
                width = end - start
                key = self._key(rolling, width)
                if width == 1:
                    at = np.minimum(np.searchsorted(self.keys, key), last)
                    known, on = self.keys[at] == key, every
                    s, own = np.where(known, self.values[at], 0.0), np.where(known, self.ids[at], -1)
                    for k in np.flatnonzero(~known):
                        s[k] = self.spelled * len(self._spell(words[k][start]))
                else:  # few stretches are pieces
                    more = np.flatnonzero(self.begins[key >> _U(64 - _BEGIN_BITS)])
                    if not len(more):
                        break
                    rolling, going, key = rolling[more], going[more], key[more]
                    at = np.minimum(np.searchsorted(self.keys, key), last)
                    known = self.keys[at] == key
                    on = going[known]
                    if not len(on):
                        continue
                    s, own = self.values[at[known]], self.ids[at[known]]
                one, two = best[start, on] + s, second[start, on] + s
                old, old_second = best[end, on], second[end, on]
                better = one > old
                second[end, on] = np.where(better, np.maximum(old, two), np.maximum(old_second, one))
                best[end, on] = np.where(better, one, old)
                back[end, on] = np.where(better, start, back[end, on])
                piece[end, on] = np.where(better, own, piece[end, on])
        best, second, back, piece = best.T, second.T, back.T, piece.T
        gap = best[:, size] - second[:, size]
        rows, at, path, column = np.arange(n), np.full(n, size), np.zeros((n, size), "<u4"), size
        count, to_spell = np.zeros(n, np.int64), np.zeros(n, bool)
        while at.any():
            column -= 1
            on = at > 0
            own = piece[rows, at]
            path[on, column] = own[on].astype(np.uint32)
            to_spell |= on & (own < 0)
            count += on
            at = np.where(on, back[rows, at], 0)
        data, scores, gaps, counts = path.tobytes(), best[:, size].tolist(), gap.tolist(), count.tolist()
        for k, word in enumerate(words):
            self.known[word] = (data[4 * (size * (k + 1) - counts[k]):4 * size * (k + 1)], scores[k], gaps[k])
        for k in np.flatnonzero(to_spell):
            ids, at = [], size
            while at:
                ids.append(self.edge(words[k][back[k, at]:at])[1])
                at = back[k, at]
            self.known[words[k]] = (np.array([i for part in reversed(ids) for i in part], "<u4").tobytes(), scores[k], gaps[k])

    def learn(self, words: set[str]) -> None:
        """Words not known yet; a store that is full becomes the elder one, from which words still in use are taken over."""
        if len(self.known) > self.keep:
            self.known, self.elder, self.searched = {}, self.known, {}
        self.known.update((w, self.elder[w]) for w in words if w not in self.known and w in self.elder)
        by_size: dict[int, list[str]] = {}
        for w in words:
            if w not in self.known:
                by_size.setdefault(len(w), []).append(w)
        for size, group in by_size.items():
            group.sort()
            block = max(1, 2_000_000 // (size + 1))
            for at in range(0, len(group), block):
                self._forward(group[at:at + block])

    # ---- backward ----------------------------------------------------------------

    def n_best(self, word: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a word: (score, ids), best first, then by the cuts made last."""
        if (word, n) in self.searched:
            return self.searched[word, n]
        size = len(word)
        edges: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
        forward = [0.0] + [-np.inf] * size
        for end in range(1, size + 1):
            for start in range(max(0, end - self.longest), end):
                got = self.edge(word[start:end])
                if got:
                    edges[end].append((start, *got))
                    forward[end] = max(forward[end], forward[start] + got[0])
        open_paths, done = [(-forward[size], 0, size, 0.0, ())], []
        count = 0
        while open_paths and len(done) < n:
            _, _, at, own, tail = heapq.heappop(open_paths)
            if at == 0:
                done.append((own, np.array([i for ids in tail for i in ids], "<u4").tobytes()))
                continue
            for start, s, ids in edges[at]:
                count += 1
                heapq.heappush(open_paths, (-(forward[start] + s + own), count, start, s + own, (ids,) + tail))
        self.searched[word, n] = done
        return done

    # ---- texts -------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        return _WORD.findall(SPACE + text.replace(SPACE, _LITERAL).replace(" ", SPACE))

    def encode(self, texts: list[str], n: int) -> list[list[tuple[float, bytes]]]:
        """The n best segmentations of each text as (score, ids), best first."""
        split, found, holes = [], [], []
        for t in texts:
            split.append(parts := self.words(t))
            found.append(own := [*map(self.known.get, parts)])  # looked up once; few are missing
            holes.append([*compress(count(), map(not_, own))])
        self.learn({parts[k] for parts, own in zip(split, holes) for k in own})
        for parts, known, own in zip(split, found, holes):
            for k in own:
                known[k] = self.known[parts[k]]
        return [self._combined(parts, known, n) for parts, known in zip(split, found)]

    def _combined(self, parts: list[str], known: list[tuple[bytes, float, float]], n: int) -> list[tuple[float, bytes]]:
        pieces, scores, gaps = map(list, zip(*known)) if known else ([], [], [])
        total, gap = sum(scores), np.array(gaps)
        places = [int(at) for at in np.argsort(gap, kind="stable")[:n - 1] if gap[at] < np.inf]
        sums = [(0.0, ())]  # cost over the best, and (place, rank) of each departure
        for at in places:
            own = self.n_best(parts[at], n)
            sums = heapq.nsmallest(n, ((cost + own[0][0] - s, gone + ((at, k),) * (k > 0)) for cost, gone in sums for k, (s, _) in enumerate(own)))
        out = []
        for cost, gone in sums:
            chosen = pieces.copy() if gone else pieces
            for at, k in gone:
                chosen[at] = self.n_best(parts[at], n)[k][1]
            out.append((total - cost, b"".join(chosen)))
        return out

    def decoded(self, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """The bytes of the texts that runs of ids stand for; run k is ids[edges[k]:edges[k + 1]]."""
        got = self.pieces.take(pa.array(ids))
        at = np.frombuffer(got.buffers()[1], np.int64)[got.offset: got.offset + len(got) + 1][edges].tolist()
        data = memoryview(got.buffers()[2] or b"")
        texts = [bytes(data[i:j]) for i, j in zip(at, at[1:])]
        return [t[1:] if t.startswith(b" ") else t for t in texts]

    def decode(self, ids) -> str:
        """The text that ids stand for; ids of control pieces stand for nothing."""
        text = b"".join(map(self.read.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def lattice_of(model: str, scores: str) -> Lattice:
    """The lattice of this Python process; tasks that run in it one after another share what it has seen."""
    return Lattice(model, scores)


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts [a, b) of some million characters or one text: words of one length are scored together."""
    a = held = 0
    for b, t in enumerate(texts):
        if b > a and held + len(t) > _RUN:
            yield a, b
            a, held = b, 0
        held += len(t)
    if texts:
        yield a, len(texts)


def encode_n_best(docs: DataFrame, model: str, n: int = 4, scores: str = "zipf", id: str = "doc_id", text: str = "text",
                  with_ids: bool = True) -> DataFrame:
    """(id, rank, score, n_pieces, ids_crc32, decodes[, ids]): the n best segmentations of every text.

    rank counts from 0; there are fewer than n rows where a text has fewer segmentations. decodes tells
    whether the ids give back the text. A null text counts as empty: the single ▁. Repeated rows each
    give their rows, a null id stays null, an empty table gives an empty table, other columns are not
    read. Texts are encoded whole.
    """
    kind = dict(docs.select(id).dtypes)[id]
    names = ["i", "rank", "score", "n_pieces", "ids_crc32", "decodes"] + ["ids"] * with_ids

    def make():
        lattice = lattice_of(model, scores)

        def work(batch: dict) -> dict:
            rows = []
            every = [t or "" for t in batch["t"]]
            for at, end in _runs(every):
                texts = every[at:end]
                for i, body, found in zip(batch["i"][at:end], texts, lattice.encode(texts, n)):
                    whole = np.frombuffer(b"".join([data for _, data in found]), "<u4")
                    edges = np.cumsum([0] + [len(data) // 4 for _, data in found])
                    body = body.encode("utf-8", "surrogatepass")
                    for rank, ((score, data), back) in enumerate(zip(found, lattice.decoded(whole, edges))):
                        rows.append((i, rank, score, len(data) // 4, zlib.crc32(data), back == body, np.frombuffer(data, "<u4") if with_ids else None))
            return {name: [r[k] for r in rows] for k, name in enumerate(names)}
        return work

    schema = f"i {kind}, rank int, score double, n_pieces long, ids_crc32 long, decodes boolean" + ", ids array<int>" * with_ids
    return map_batches(docs.select(docs[id].alias("i"), docs[text].alias("t")), make, schema).withColumnRenamed("i", id)


def decode_ids(encoded: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """encoded with a column of the texts that its ids stand for; null ids give null. The column replaces one of its name."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != out)

    def make():
        lattice = lattice_of(model, "zipf")

        def work(batch: dict) -> dict:
            return batch | {out: [None if i is None else lattice.decode(i) for i in batch[ids]]}
        return work

    return map_batches(encoded.drop(out), make, f"{schema}, `{out}` string")
