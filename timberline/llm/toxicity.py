"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with marks at both ends), hashed into rows of one embedding
table; an unseen misspelling shares most of its n-grams with the word it misspells. The vectors of a window of
WINDOW words are averaged and go through a linear softmax of two classes; a text scores as its most toxic window, so
one word in a very long text counts as in a short one. Table and softmax are trained together by Adam on windows
chosen by the model itself: the top windows of every labelled text.

As the model is linear in n-grams, scoring needs one number per n-gram row; each worker keeps the numbers of words it
has met in a table of bounded size. Training sees at most SAMPLE labelled rows (drawn by a hash of doc_id), whole, of about
SAMPLE_CHARS characters together.

Defined cases: null or empty text scores as a window without words; rows without a label, with a null id or with a
held-out id are never learned from; of several labels of one id all count; with one class only, every score is its
smoothed share, and with no labels 0; repeated rows each give a row; other columns are kept, but for one with
the name of the column that is added.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, lower_words, small, without

SAMPLE, ROWS_LOG, DIM, WINDOW, NGRAMS = 6_000, 16, 8, 4, (3, 4, 5, 6, 7, 8)
SAMPLE_CHARS = 48_000_000  # of the texts that reach the driver
ROWS = 1 << ROWS_LOG
ROW = np.uint16 if ROWS_LOG <= 16 else np.uint32  # n-grams are many: each is the number of its row, and no wider
PIECE = 1 << 18  # letters or n-grams that are worked on at once
STEP, STEP_GRAMS = 512, 1 << 20  # windows of a training step, and n-grams of them; one window with more is a step of its own, as a bag of rows


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table for the n-grams of all words, one word after the other, and where each word's begin. Of a word
    the shorter n-grams come first. Besides what it returns it needs little: the letters are worked off in pieces."""
    if not words:
        return np.zeros(0, ROW), np.zeros(0, np.int64)
    raw = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begin = np.cumsum(size) - size
    count = sum(np.maximum(size - n + 1, 0) for n in NGRAMS)
    start = np.cumsum(count) - count
    rows = np.empty(int(count.sum()), ROW)
    for lo in range(0, len(raw), PIECE):
        hi = min(lo + PIECE, len(raw))
        first, last = np.searchsorted(begin, [lo, hi - 1], "right") - 1  # words of this piece
        edges = np.append(begin[first : last + 1], hi)
        edges[0] = lo
        word = np.repeat(np.arange(first, last + 1), np.diff(edges))
        at, whole = np.arange(lo, hi) - begin[word], size[word]
        left, to = whole - at, start[word] + at  # bytes from here to the end of the word; where the next n-gram from here goes
        here = raw[lo : hi + max(NGRAMS) - 1].astype(np.uint64)
        code = here.copy()
        for n in range(2, min(max(NGRAMS), len(here)) + 1):
            code[: len(here) - n + 1] = code[: len(here) - n + 1] * np.uint64(0x100000001B3) + here[n - 1 :]
            if n in NGRAMS:
                full = np.flatnonzero(left >= n)
                rows[to[full]] = ((code[full] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - ROWS_LOG)
                to += np.maximum(whole - n + 1, 0)
    return rows, start


def _bag(flat: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Each row's share of the n-grams from lo to hi."""
    count = np.zeros(ROWS)
    for at in range(lo, hi, PIECE):
        count += np.bincount(flat[at : min(at + PIECE, hi)], minlength=ROWS)
    return count / (hi - lo)


def _means(values: np.ndarray, flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The mean value of each word's n-grams; each word has one: "<w>" is one."""
    out, ends = np.empty(len(start)), np.append(start[1:], len(flat))
    lo = 0
    while lo < len(start):  # so many words that their n-grams fit a piece, one word at least
        hi = max(lo + 1, int(np.searchsorted(ends, start[lo] + PIECE, "right")))
        if ends[hi - 1] - start[lo] > PIECE:
            out[lo] = _bag(flat, start[lo], ends[lo]) @ values * (ends[lo] - start[lo])
        else:
            out[lo:hi] = np.add.reduceat(values[flat[start[lo] : ends[hi - 1]]], start[lo:hi] - start[lo])
        lo = hi
    return out / (ends - start)


@dataclass
class Bag:
    """weight: per n-gram row, how much it moves the difference of the two softmax inputs; bias: of that difference."""

    weight: np.ndarray
    bias: float
    memo_size: int = 300_000
    memo: dict = field(default_factory=dict, repr=False)

    def score(self, texts: list[str | None]) -> np.ndarray:
        docs = [lower_words(t) for t in texts]
        memo = self.memo
        if len(memo) >= self.memo_size:
            memo.clear()
        new = [w for w in set(chain.from_iterable(docs)) if w not in memo]
        for lo in range(0, len(new), 100_000):
            part = new[lo : lo + 100_000]
            memo.update(zip(part, _means(self.weight, *grams(part)).tolist(), strict=True))
        look = memo.__getitem__
        raw = [_windows(np.fromiter(map(look, d), np.float64, len(d))).max() if d else 0.0 for d in docs]
        return 1 / (1 + np.exp(-(np.array(raw, dtype=float) + self.bias)))


def _windows(v: np.ndarray) -> np.ndarray:
    """Sums of each WINDOW neighbours over WINDOW; a shorter text is one window, filled up with nothing."""
    if len(v) <= WINDOW:
        return v.sum(keepdims=True) / WINDOW
    c = np.concatenate([[0.0], np.cumsum(v)])
    return (c[WINDOW:] - c[:-WINDOW]) / WINDOW


def train(texts: Iterable[str | None], y: np.ndarray, epochs: int = 12, rate: float = 0.05, top: int = 2, seed: int = 0, explore: int = 8, most: float = 12.0) -> Bag:
    """Table and softmax together; every text gives its `top` highest windows to each epoch, and random ones to the
    first `explore`. Toxic texts weigh as much as the others together, each `most` times as much as another at most.
    Texts are taken one at a time; what stays of them are numbers of words."""
    y = np.asarray(y, dtype=float)
    if len(y) == 0 or y.min() == y.max():
        share = 0.0 if len(y) == 0 else (y.sum() + 1) / (len(y) + 2)
        return Bag(np.zeros(ROWS), float(np.log(max(share, 1e-9) / (1 - share))))
    rng = np.random.default_rng(seed)
    index: dict[bytes, int] = {}
    docs = []
    for t in texts:
        docs.append(np.array([index.setdefault(w, len(index)) for w in lower_words(t)], dtype=np.int32))
    flat, start = grams(list(index))
    index.clear()
    size = np.diff(start, append=len(flat))
    # Words of few texts say little by themselves: their own row and rare n-grams start at nothing like all others.
    table = rng.normal(0, 0.02, (ROWS, DIM))
    soft = rng.normal(0, 0.3, (DIM, 2))
    bias = np.array([0.0, -2.0])
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in (("table", table), ("soft", soft), ("bias", bias))}
    step = 0
    positive = np.flatnonzero(y == 1)
    balance = np.where(y == 1, min(most, (len(y) - len(positive)) / max(1, len(positive))), 1.0)
    for epoch in range(epochs):
        logit = _means(table @ (soft[:, 1] - soft[:, 0]), flat, start)
        picked, target, weight = [], [], []
        for d in rng.permutation(len(docs)):
            words = docs[d]
            if not len(words):
                continue
            w = _windows(logit[words])
            # At first every window of a toxic text is as good a guess as any other: random ones join in.
            best = np.argpartition(w, -min(top, len(w)))[-min(top, len(w)) :]
            if epoch < explore:
                best = np.union1d(best, rng.integers(0, len(w), min(len(w), 12 if y[d] else 6)))
            if y[d] and epoch >= explore:
                best = best[[w[best].argmax()]]
            for b in best:
                picked.append(words[b : b + WINDOW])
                target.append(y[d])
                weight.append(balance[d] / len(best))
        sums, hi = np.cumsum([0, *(size[p].sum() for p in picked)]), 0
        while hi < len(picked):
            lo, hi = hi, min(hi + STEP, max(hi + 1, int(np.searchsorted(sums, sums[hi] + STEP_GRAMS, "right")) - 1))
            part = picked[lo:hi]
            t, wt = np.array(target[lo:hi]), np.array(weight[lo:hi])
            word = np.concatenate(part)
            if sums[hi] - sums[lo] > STEP_GRAMS:
                share = sum(_bag(flat, start[w], start[w] + size[w]) for w in word) / WINDOW
                g = np.flatnonzero(share)
                grow, share = np.zeros(len(g), np.int64), share[g]
            else:
                row = np.repeat(np.arange(len(part)), [len(p) for p in part])
                k = size[word]
                g = flat[np.repeat(start[word] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())]
                grow, share = np.repeat(row, k), np.repeat(1 / (k * WINDOW), k)
            hidden = np.add.reduceat(table[g] * share[:, None], np.searchsorted(grow, np.arange(len(part))))
            z = hidden @ soft + bias
            z = np.exp(z - z.max(1, keepdims=True))
            p = z / z.sum(1, keepdims=True)
            dz = (p - np.stack([1 - t, t], 1)) * wt[:, None] / len(part)
            dh = dz @ soft.T
            order = np.argsort(g, kind="stable")
            rows, first = np.unique(g[order], return_index=True)
            dt = np.add.reduceat((dh[grow] * share[:, None])[order], first)
            step += 1
            for name, array, grad, at in (("table", table, dt, rows), ("soft", soft, hidden.T @ dz, slice(None)), ("bias", bias, dz.sum(0), slice(None))):
                m, v = state[name]
                m[at] = 0.9 * m[at] + 0.1 * grad
                v[at] = 0.99 * v[at] + 0.01 * grad**2
                array[at] -= rate * m[at] / (np.sqrt(v[at]) + 1e-8) / (1 - 0.9**step)
    return Bag(table @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held: int = 1, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Bag:
    """A model from at most `sample` labelled rows whose crc32(id) mod modulus isn't `held`; whole texts, about `chars`
    characters of them at most, reach the driver."""
    chosen = (
        labels.where(F.col(label).isin(0, 1) & (crc_mod(F.col("doc_id"), modulus) != held))
        .select("doc_id", F.col(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of labels
    # Rows in order of a hash while their texts have at most `chars` characters together.
    sizes = sorted((r["h"], r["doc_id"], r["y"], r["n"]) for r in rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", "y", F.coalesce(F.length("text"), F.lit(0)).alias("n")).collect())
    sums = np.cumsum([r[3] for r in sizes])
    if len(sizes) and sums[-1] > chars:
        last = max(1, int(np.searchsorted(sums, chars, "right")))
        rows = rows.where((F.xxhash64("doc_id") < sizes[last - 1][0]) | (F.col("doc_id") == sizes[last - 1][1]))
    got = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["y"], r["text"] or ""))
    y = np.array([r["y"] for r in got])
    got.reverse()
    return train((got.pop()["text"] for _ in range(len(got))), y)  # each text goes once its words are numbered


def classify(docs: DataFrame, model: Bag, column: str = "score") -> DataFrame:
    """docs (text, ...) -> the same columns and `column`: how likely label 1 is; an older column of that name gives way."""
    docs = without(docs, column)
    sent = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))  # ROWS numbers

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag = Bag(*sent.value)
        for batch in small(it):
            yield batch.append_column(column, pa.array(bag.score(batch.column("text").to_pylist()), pa.float64()))

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{fields}, `{column}` double")
