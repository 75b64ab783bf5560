"""Benchmark decontamination with an FM-index for each shard of training documents.

A phrase is each window of 13 words of a benchmark text, or the whole of a shorter one. Documents are read in shards
of bounded size. Words that no phrase holds cannot be part of an occurrence, so they become separators, and stretches
between separators that are shorter than every phrase are left out; what remains of the shard is indexed: a suffix
array by prefix doubling, its Burrows-Wheeler transform in a wavelet matrix, and suffix positions sampled at every
SAMPLE-th place and at each stretch's start. All phrases are searched backwards at once, occurrences are located by
walking to a sampled position, and their word spans are merged per document. Nothing is shuffled: a document's rows
never meet another's.

Phrases are sent to executors in blocks of at most BLOCK_WORDS words. One pass over the documents serves one block;
a larger benchmark takes more passes, each adding its spans, and loses none.

Defined cases: null or empty texts have no words, in documents and benchmark alike; very long texts are a shard of
their own; repeated rows each give a row and repeated items count once per item_id; a null item_id is no item, its
words still hit; empty tables give no rows, or no hits; other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER_WORDS, free_names, lower_words, small

WINDOW, SAMPLE, SHARD_TOKENS, SHARD_BYTES, BLOCK_WORDS = 13, 8, 400_000, 16 << 20, 2_000_000


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of a text of integers in order; a 0 is smaller than all else and than every later 0."""
    n = len(text)
    zeros = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    step = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        if step < n:
            second[:-step] = rank[step:] + 1
        key = rank * (max(n, int(rank.max(initial=0))) + 2) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.zeros(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if n else []
        if n == 0 or new[order[-1]] == n - 1:
            return order
        rank, step = new, 2 * step


class WaveletMatrix:
    """rank(c, i): how many of the first i values are c, for many c and i at once."""

    def __init__(self, values: np.ndarray, bits: int):
        self.ones, self.zeros = [], []
        for b in range(bits - 1, -1, -1):
            bit = (values >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(values) - self.ones[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        self.bits = bits

    def _place(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            ones = self.ones[level][i]
            i = np.where((c >> (self.bits - 1 - level)) & 1, self.zeros[level] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._place(c, i) - self._place(c, np.zeros_like(i))


class FMIndex:
    """Counts and locates phrases in a text of integers; 0 separates stretches, and no phrase holds it."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        if len(text) and text[-1] != 0:
            text = np.concatenate([text, [0]])
        n = len(text)
        order = suffix_array(text)
        self.last = text[order - 1] if n else text  # the symbol before each suffix
        if n:
            self.last = np.where(order == 0, 0, self.last)
        self.tree = WaveletMatrix(self.last, max(1, int(sigma).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        self.n = n
        kept = (order % sample == 0) | (self.last == 0)
        self.kept, self.kept_rank, self.places = kept, np.cumsum(kept) - 1, order[kept]

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.first[c] + self.tree.rank(c, i)

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each phrase; phrases: one a row, padded behind."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((length >= back) & (hi > lo))
            if not len(live):
                continue
            c = phrases[live, length[live] - back]
            lo[live], hi[live] = self.step(c, lo[live]), self.step(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, walked = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.kept[rows])
        while len(live):
            rows[live] = self.step(self.last[rows[live]], rows[live])
            walked[live] += 1
            live = live[~self.kept[rows[live]]]
        return self.places[self.kept_rank[rows]] + walked


class Phrases:
    """A block of benchmark texts: the alphabet, distinct phrases, and the items of each phrase."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, words in items:
            seq = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            for i in range(max(1, len(seq) - window + 1) if seq else 0):
                found.setdefault(tuple(seq[i : i + window]), set()).add(item)
        self.items = [v for v in found.values()]
        self.length = np.array([len(k) for k in found], dtype=np.int64)
        self.table = np.zeros((len(found), window), dtype=np.int64)
        for i, k in enumerate(found):
            self.table[i, : len(k)] = k
        self.shortest = int(self.length.min()) if found else 1 << 30


def _stretches(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """[start, end) of the runs of known words that are at least so long."""
    known = np.concatenate([[0], (ids != 0).view(np.int8), [0]])
    edge = np.flatnonzero(np.diff(known))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def search_shard(docs: list[np.ndarray], phrases: Phrases) -> list[tuple[list[list[int]], set]]:
    """Merged spans [start, end) of hit words and the items found, for each document's word ids (0: unknown)."""
    out: list[tuple[list[list[int]], set]] = [([], set()) for _ in docs]
    starts, owners, origins, parts, at = [], [], [], [], 0
    for d, ids in enumerate(docs):
        for a, b in _stretches(ids, phrases.shortest):
            starts.append(at)
            owners.append(d)
            origins.append(a)
            parts += [ids[a:b], [0]]
            at += b - a + 1
    if not parts:
        return out
    index = FMIndex(np.concatenate(parts).astype(np.int64), len(phrases.ids))
    lo, hi = index.search(phrases.table, phrases.length)
    count = hi - lo
    which = np.repeat(np.arange(len(lo)), count)
    if not len(which):
        return out
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(which))
    place = index.locate(rows)
    run = np.searchsorted(starts, place, "right") - 1
    doc, word = np.array(owners)[run], np.array(origins)[run] + place - np.array(starts)[run]
    order = np.lexsort((word, doc))
    for d, w, p in zip(doc[order].tolist(), word[order].tolist(), which[order].tolist(), strict=True):
        spans, items = out[d]
        end = w + int(phrases.length[p])
        if spans and w <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([w, end])
        items |= phrases.items[p]
    return out


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list]:
    block, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        words = lower_words(r["text"])
        block.append((r["item_id"], words))
        size += len(words)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


FOUND = ("hit_spans", "hit_items", "hit_n_words")


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, names: tuple[str, ...] = FOUND) -> DataFrame:
    """docs (text, ...) -> its columns, hit_spans ([start, end) of words), hit_items and hit_n_words, or these under
    other names; older columns of those names give way."""
    return _search(docs, benchmark, window, block_words, names)


def _search(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, names: tuple[str, ...], then=None) -> DataFrame:
    """then: (a function of a batch with the new columns, the schema of what it gives), applied where the last block of
    phrases was searched, so that no second Python stage stands behind it."""
    taken = {c.lower() for c in names}
    columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    spans, items, words = names
    item_type = dict(benchmark.dtypes)["item_id"]
    out = docs.select(*columns).withColumns(
        {spans: F.array().cast("array<array<int>>"), items: F.array().cast(f"array<{item_type}>"), words: F.lit(0).cast("long")}
    )
    sc = docs.sparkSession.sparkContext
    last: list = []  # without phrases, the words are counted still
    for i, block in enumerate(_blocks(benchmark, block_words)):
        if i:
            out = _pass(out, sc.broadcast((last, window)), names)
        last = block
    return _pass(out, sc.broadcast((last, window)), names, then)


def _pass(df: DataFrame, sent, names: tuple[str, ...], then=None) -> DataFrame:
    spans_, items_, words_ = names
    finish, schema = then or (lambda batch: batch, df.schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(*sent.value)
        get = phrases.ids.get
        held: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
        tokens = size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            found = iter(search_shard([d for _, docs in held for d in docs], phrases))
            for batch, docs in held:
                mine = [next(found) for _ in docs]
                spans = [_merged(a + b) for a, (b, _) in zip(batch.column(spans_).to_pylist(), mine, strict=True)]
                items = [sorted({*a, *b} - {None}) for a, (_, b) in zip(batch.column(items_).to_pylist(), mine, strict=True)]
                new = {spans_: spans, items_: items, words_: [len(d) for d in docs]}
                arrays = [pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name) for f in batch.schema]
                yield finish(pa.RecordBatch.from_arrays(arrays, schema=batch.schema))
            held.clear()

        for batch in small(it):
            docs = []
            for text in batch.column("text").to_pylist():
                words = lower_words(text)
                ids = np.fromiter([get(w, 0) for w in words], np.int32, len(words))
                docs.append(ids)
                tokens += sum(b - a for a, b in _stretches(ids, phrases.shortest))
            held.append((batch, docs))
            size += batch.nbytes
            if tokens >= SHARD_TOKENS or size >= SHARD_BYTES:
                yield from flush()
                tokens = size = 0
        if held:
            yield from flush()

    return df.mapInArrow(run, schema)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find(docs.select("doc_id", "text"), benchmark)
    spans, items, words = FOUND
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    names = F.array_sort(F.transform(items, lambda x: x.cast("string")))
    return found.select("doc_id", F.col(words).alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def cut(text: str | None, spans: list[list[int]]) -> str | None:
    """The text without its words [start, end) of each span and what stands between them."""
    if not text or not spans:
        return text
    data = text.encode("utf-8", "surrogatepass")
    words = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(_LOWER_WORDS))]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : words[a][0]])
        at = words[b - 1][1]
    return (b"".join(out) + data[at:]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = 0.05) -> DataFrame:
    """docs without documents of which at least `share` of the words were hit, and without hit words in the rest;
    n_chars, if there, follows the text."""
    columns = docs.columns
    hit, items, words = free_names(columns, *FOUND)

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_hit = [sum(b - a for a, b in own) for own in batch.column(hit).to_pylist()]
        batch = batch.filter(pa.array([n == 0 or n < share * m for n, m in zip(n_hit, batch.column(words).to_pylist(), strict=True)], pa.bool_()))
        spans = batch.column(hit).to_pylist()
        i = batch.schema.get_field_index("text")
        if any(spans):
            texts = [cut(t, s) for t, s in zip(batch.column(i).to_pylist(), spans, strict=True)]
            batch = batch.set_column(i, "text", pa.array(texts, pa.string()))
            j = batch.schema.get_field_index("n_chars")
            if j >= 0:
                sizes = [n if not s else len(t) for n, t, s in zip(batch.column(j).to_pylist(), texts, spans, strict=True)]
                batch = batch.set_column(j, "n_chars", pa.array(sizes, batch.schema.field(j).type))
        return batch.select(columns)

    return _search(docs, benchmark, WINDOW, BLOCK_WORDS, (hit, items, words), (finish, docs.schema))
