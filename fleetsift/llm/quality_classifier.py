"""Quality classifier by co-training on two views of a document.

The *text* view is what the text says: rates of byte pairs in hashed slots and how often words repeat.
The *page* view is what is known about the page: language and source (hashed), length, lines and the
shares of kinds of characters. Each view has its own logistic regression. In every round each model
labels the unlabelled rows it is surest of, in the classes' proportions, and hands them to the other.
After the rounds each view is calibrated on labelled rows kept aside (Platt), and the calibrated views
are combined by a logistic regression of their log-odds on the same rows. The result scores all rows.

Training uses a bounded sample of labelled rows and a bounded sample of unlabelled ones (the lowest by
a hash of the id); the driver gets their features, a few hundred numbers a row.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from fleetsift.session import cut_lineage

from .common import map_batches, one_row_each
from .linear import sigmoid, slots
from .toxicity import held_out


@dataclass(frozen=True)
class Settings:
    sample: int = 8000
    pool: int = 8000
    rounds: int = 5
    growth: float = 0.05
    confidence: float = 0.9
    slot_bits: int = 8
    category_slots: int = 64
    l2: float = 3.0


def text_view(text: str, bits: int) -> np.ndarray:
    """Square roots of byte-pair rates by slot, then repetition of words."""
    at = slots(text, 2, 2, bits)
    rates = np.sqrt(np.bincount(at, minlength=1 << bits) / max(len(at), 1))
    found = text.split()
    n = max(len(found), 1)
    counts = Counter(found)
    top = counts.most_common(1)[0][1] if counts else 0
    same = sum(a == b for a, b in zip(found, found[1:]))
    return np.concatenate([rates, [len(counts) / n, top / n, same / n, len(counts) / n ** 0.8]])


def page_view(text: str, categories: list, n_slots: int) -> np.ndarray:
    """Hashed categories, then lengths and the shares of kinds of characters."""
    hashed = np.zeros(n_slots)
    for k, value in enumerate(categories):
        hashed[zlib.crc32(f"{k}={value}".encode("utf-8", "surrogatepass")) % n_slots] += 1
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n, lines = max(len(data), 1), text.count("\n") + 1
    kinds = np.bincount(np.select([data == 32, data == 10, (data >= 97) & (data <= 122) | (data >= 128), (data >= 65) & (data <= 90),
                                   (data >= 48) & (data <= 57)], [0, 1, 2, 3, 4], 5), minlength=6) / n
    return np.concatenate([hashed, [np.log1p(len(data)), np.log1p(lines), np.log1p(len(data) / lines)], np.sqrt(kinds)])


def _fit(x: np.ndarray, y: np.ndarray, l2: float, rounds: int = 200) -> np.ndarray:
    """Weights, the last being the bias, of a logistic regression on standardised features."""
    x = np.column_stack([x, np.ones(len(x))])
    step = 4 / (np.linalg.eigvalsh(x.T @ x)[-1] + 4 * l2)
    penalty = np.append(np.full(x.shape[1] - 1, l2), 0)
    w = v = np.zeros(x.shape[1])
    for k in range(rounds):
        new = v - step * (x.T @ (sigmoid(x @ v) - y) + penalty * v)
        v, w = new + k / (k + 3) * (new - w), new
    return w


@dataclass
class View:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log-odds of good quality."""
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights[:-1] + self.weights[-1]
        return np.clip(self.slope * z + self.shift, -12, 12)


def _view(x, y, l2) -> View:
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    return View(mean, scale, _fit(np.clip((x - mean) / scale, -6, 6), y, l2))


@dataclass
class Model:
    settings: Settings
    text: View | None
    page: View | None
    mix: np.ndarray

    def scores(self, xt: np.ndarray, xp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, text and page probabilities of good quality."""
        if self.text is None:
            flat = np.full(len(xt), sigmoid(self.mix[2]))
            return flat, flat, flat
        a, b = self.text.odds(xt), self.page.odds(xp)
        return sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2]), sigmoid(a), sigmoid(b)


def co_train(xt: np.ndarray, xp: np.ndarray, y: np.ndarray, settings: Settings) -> Model:
    """y: 1, 0, or -1 where unlabelled. The last fifth of the labelled rows calibrates."""
    s, known = settings, np.flatnonzero(y >= 0)
    share = float((y[known] == 1).mean()) if len(known) else 0.5
    flat = Model(s, None, None, np.array([0, 0, np.log((share + 1e-3) / (1 - share + 1e-3))]))
    fit, aside = known[: len(known) * 4 // 5], known[len(known) * 4 // 5:]
    if min((y[fit] == 1).sum(), (y[fit] == 0).sum()) < 2 or len(aside) < 2:
        return flat
    guesses = [dict(), dict()]  # row -> label, given to each view by the other
    pool = np.flatnonzero(y < 0)
    views = [xt, xp]

    def trained(k: int) -> View:
        extra = np.fromiter(guesses[k], np.int64, len(guesses[k]))
        rows = np.concatenate([fit, extra])
        return _view(views[k][rows], np.concatenate([y[fit], [guesses[k][r] for r in extra]]).astype(float), s.l2)

    for _ in range(s.rounds):
        models = [trained(0), trained(1)]
        for k in (0, 1):
            left = np.array([r for r in pool if r not in guesses[1 - k]], np.int64)
            if not len(left):
                continue
            p = sigmoid(models[k].odds(views[k][left]))
            order = np.argsort(-p, kind="stable")
            take = max(1, int(s.growth * len(pool)))
            for label, ranked, sure in ((1, order[: round(take * share)], p), (0, order[::-1][: round(take * (1 - share))], 1 - p)):
                guesses[1 - k].update((int(left[r]), label) for r in ranked if sure[r] >= s.confidence)
    final = [trained(0), trained(1)]
    for k in (0, 1):
        z = final[k].odds(views[k][aside])
        final[k].slope, final[k].shift = (float(w) for w in _fit(z[:, None], y[aside].astype(float), 0.01))
    odds = np.column_stack([final[k].odds(views[k][aside]) for k in (0, 1)])
    return Model(s, final[0], final[1], _fit(odds, y[aside].astype(float), 0.3))


def _features(batch: dict, categories: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    texts = [t or "" for t in batch["t"]]
    return (np.array([text_view(t, s.slot_bits) for t in texts]).reshape(len(texts), -1),
            np.array([page_view(t, list(c), s.category_slots) for t, c in zip(texts, zip(*[batch[f"c{k}"] for k in range(len(categories))]))]
                     if categories else [page_view(t, [], s.category_slots) for t in texts]).reshape(len(texts), -1))


def _columns(docs: DataFrame, id: str, text: str, categories: list[str]):
    return [docs[id].alias("i"), docs[text].alias("t"), *[docs[c].cast("string").alias(f"c{k}") for k, c in enumerate(categories)]]


def train_quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text",
                  label: str = "quality", categories: tuple[str, ...] = ("lang", "source")) -> Model:
    """Co-train on labelled rows that are not held out and on unlabelled rows.

    Null ids and labels are left out; an id labelled more than once is good only if all rows say so;
    of the rows of one document a single one counts, picked by a hash. With too few rows of a class the model gives every document the labelled share of good ones.
    """
    s, categories = settings, list(categories)
    marked = labels.select(labels[id].alias("i"), labels[label].cast("int").alias("y")).dropna().groupBy("i").agg(F.min("y").alias("y"))
    lowest = lambda rows, n: rows.orderBy(F.xxhash64("i"), "i").limit(n)
    free = docs.select(docs[id].alias("i")).dropna().distinct().join(marked, "i", "left_anti").select("i", F.lit(-1).alias("y"))
    chosen = lowest(marked.where(~held_out(F.col("i"))), s.sample).unionByName(lowest(free, s.pool))

    def make():
        def work(batch: dict) -> dict:
            xt, xp = _features(batch, categories, s)
            return {"i": [str(i) for i in batch["i"]], "y": batch["y"],
                    "xt": [r.astype("<f4").tobytes() for r in xt], "xp": [r.astype("<f4").tobytes() for r in xp]}
        return work

    # s.sample + s.pool rows of an id and a label: the bound of the broadcast
    rows = one_row_each(docs.select(*_columns(docs, id, text, categories)).join(F.broadcast(cut_lineage(chosen)), "i"), "i")
    got = map_batches(rows, make, "i string, y int, xt binary, xp binary").collect()
    got.sort(key=lambda r: (zlib.crc32(r["i"].encode("utf-8", "surrogatepass")), r["i"], r["xt"]))
    if not got:
        return Model(s, None, None, np.zeros(3))
    view = lambda name: np.array([np.frombuffer(r[name], "<f4") for r in got], float)
    return co_train(view("xt"), view("xp"), np.array([min(r["y"], 1) for r in got]), s)


def score_quality(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text",
                  categories: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """docs' rows as (id, held_out, score, text_score, page_score, predicted); 1 stands for good.

    Null texts count as empty, null categories as a category of their own. Repeated rows stay, a null id
    stays null, an empty table gives an empty table; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights
    kind, categories = dict(docs.select(id).dtypes)[id], list(categories)

    def make():
        own = shared.value

        def work(batch: dict) -> dict:
            both, a, b = own.scores(*_features(batch, categories, own.settings))
            return {"i": batch["i"], "score": both, "text_score": a, "page_score": b}
        return work

    got = map_batches(docs.select(*_columns(docs, id, text, categories)), make,
                      f"i {kind}, score double, text_score double, page_score double")
    return got.select(F.col("i").alias(id), held_out(F.col("i")).alias("held_out"), "score", "text_score", "page_score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text: str = "text", categories: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of docs predicted to be of good quality, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def make():
        own = shared.value

        def work(batch: dict) -> dict:
            seen = {"t": batch[text]} | {f"c{k}": [None if v is None else str(v) for v in batch[c]] for k, c in enumerate(categories)}
            good = own.scores(*_features(seen, list(categories), own.settings))[0] >= 0.5
            return {name: [v for v, ok in zip(values, good) if ok] for name, values in batch.items()}
        return work

    return map_batches(docs, make, schema)
