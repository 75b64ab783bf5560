"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

Any two equal windows of WINDOW words hold the same smallest GRAM-word gram at the same place, their anchor. Every
document is cut at its anchors: the windows of one anchor lie in one short context. All contexts of an anchor go to
one reference block, so a context needs to be parsed against that block only; no other block can hold its windows.
A context that a document repeats, as in repeated lines, is one row with all its places: what is found at one holds at each.

* A context that occurs, word for word, in an earlier document is a duplicate as a whole: counted by hash, with
  partial sums before the shuffle, so copies of whatever number never meet in one task.
* An anchor with one context needs nothing. Contexts of an anchor that differ go, once each, to their block. A block
  is indexed by ranks of windows (doubling the compared length, as for a suffix array), and every context is factored
  greedily, in document order: the longest stretch that goes on as an earlier document's does becomes a factor, and
  windows across the boundary of factors are looked up one by one.
* Contexts of an anchor with more than HOT different contexts, as at the ends of a passage that very many documents
  share, are dealt out window by window, again by hash and with partial sums.

A window of a document is a duplicate if it starts in a document with a smaller doc_id; windows are judged on the
input. Defined cases: null texts have no words; texts shorter than a window lose nothing; very long texts are whole;
repeated rows (one doc_id) are not smaller than each other; a null doc_id is greater than all; an empty table gives no
rows; other columns are kept by `dedup`, ignored by `digest`. Words are compared by 64-bit hashes, contexts by an anchor's and their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import among, bitmap, spot
from .common import make_room, materialize, sha_hex, small
from .shingles import _BASE, in_parts, mix, powers, word_hashes

WINDOW, GRAM, HOT, BLOCKS = 50, 16, 500, 16  # BLOCKS: reference blocks for each partition
_LAST = 2**63 - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BACK = np.ones(1, dtype=np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _BACK
    if len(_BACK) < n:
        _BACK = powers(n, _INVERSE)
    return _BACK[:n]


class Rolling:
    """Hashes of any stretch of an array of word hashes."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(words * powers(n + 1)[:n], out=self.sums[1:])
        self.back = _inverse_powers(n + 1)

    def of(self, lo: np.ndarray, hi: np.ndarray, salt: int = 0) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.back[lo] + (hi - lo).astype(np.uint64) * np.uint64(2 * salt + 1))


def anchors(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts of all texts: (text, first window's start, last window's start, anchor hash, context hash), starts
    counted from each text's first word."""
    n, grams = len(words), WINDOW - GRAM + 1
    none = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if n < WINDOW:
        return none
    roll = Rolling(words)
    at = np.arange(n - GRAM + 1)
    g = roll.of(at, at + GRAM)
    best, size = at, 1
    while size < grams:  # place of the smallest of `size` neighbours, the first of equals
        step = min(size, grams - size)
        a, b = best[: len(best) - step], best[step:]
        best, size = np.where(g[a] <= g[b], a, b), size + step
    text = np.searchsorted(first, np.arange(len(best)), "right") - 1
    good = np.arange(len(best)) + WINDOW <= first[np.minimum(text + 1, len(first) - 1)]
    start = np.flatnonzero(good)
    if not len(start):
        return none
    place, text = best[start], text[start]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    lo, hi = start[new], start[np.concatenate([new[1:], [len(start)]]) - 1]
    place, text = place[new], text[new]
    context = mix(roll.of(lo, hi + WINDOW, 1) + (place - lo).astype(np.uint64))
    base = first[text]
    return text, lo - base, hi - base, g[place], context


def _key() -> list:
    """A document's place in the order, and what tells its text from another row's of the same doc_id."""
    return [F.coalesce("doc_id", F.lit(_LAST)).alias("k"), F.xxhash64("text").alias("th")]


def once(text: np.ndarray, lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray, context: np.ndarray) -> tuple:
    """Contexts as `anchors` gives them, once for each text: (text, anchor, context, how many windows follow the first, first
    windows' starts at all places as bytes of 32-bit numbers)."""
    order = np.lexsort((context, anchor, text))  # keeps the order of places
    text, lo, hi, anchor, context = (x[order] for x in (text, lo, hi, anchor, context))
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])
    new = np.flatnonzero(new)
    ends = (4 * np.append(new, len(text))).astype(np.int32)
    places = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(ends), pa.py_buffer(lo.astype(np.int32))])
    return text[new], anchor[new], context[new], (hi - lo)[new], places


def contexts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> k, th (what tells a row's text), anchor, context, more, places (see `once`)."""
    schema = pa.schema([("k", pa.int64()), ("th", pa.int64()), ("anchor", pa.int64()), ("context", pa.int64()), ("more", pa.int32()), ("places", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in small(it):
            k, th = (batch.column(c).to_numpy() for c in ("k", "th"))
            for at, texts in in_parts(batch.column("text").to_pylist()):
                text, anchor, context, more, places = once(*anchors(*word_hashes(texts, lower=False)))
                columns = [k[at + text], th[at + text], anchor.view(np.int64), context.view(np.int64), more.astype(np.int32), places]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return docs.select(*_key(), "text").mapInArrow(run, "k long, th long, anchor long, context long, more int, places binary")


def parse_block(pieces: list[tuple[int, np.ndarray]]) -> list[list[tuple[int, int]]]:
    """Factors each piece (document, word hashes) against the pieces of smaller documents in the block.

    Gives each piece's duplicate spans [start, end) of words, in the order of the pieces.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in pieces]
    order = sorted(range(len(pieces)), key=lambda i: pieces[i][0])
    words = np.concatenate([np.concatenate([pieces[i][1], np.zeros(1, np.uint64)]) for i in order])
    n = len(words)
    first = np.concatenate([[0], np.cumsum([len(pieces[i][1]) + 1 for i in order])])
    doc = np.repeat(np.array([pieces[i][0] for i in order]), np.diff(first))
    rank, size = np.unique(words, return_inverse=True)[1], 1
    while size < WINDOW:  # ranks of the next `size` words, as far as the text goes
        step = min(size, WINDOW - size)
        pair = rank[: n - size - step + 1].astype(np.int64) * n + rank[step : n - size + 1]
        rank, size = np.unique(pair, return_inverse=True)[1], size + step
    # Pieces lie in the order of documents, so a window's first place is in its smallest document.
    seen, earliest = np.unique(rank, return_index=True)
    source = earliest[np.searchsorted(seen, rank)]
    found = doc[source] < doc[: len(source)]
    text = words.tolist()
    for i, a, b in zip(order, first[:-1].tolist(), first[1:].tolist(), strict=True):
        last = b - 1 - WINDOW  # where the last window starts
        at = a
        while at <= last:
            if not found[at]:
                at += 1
                continue
            q, end = int(source[at]) + WINDOW, at + WINDOW  # a factor: as long as both go on alike
            while end < b - 1 and text[q] == text[end]:
                q, end = q + 1, end + 1
            out[i].append((at - a, end - a))
            for s in range(end - WINDOW + 1, min(end, last + 1)):  # windows across its end
                if found[s]:
                    out[i].append((s - a, s + WINDOW - a))
            at = end
    return out


def duplicate_spans(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """docs (doc_id, text) -> k, th, spans: arrays of (places, start, end); words from start to before end, counted from
    each place, go. Neither sorted nor merged."""
    spark = docs.sparkSession
    blocks = blocks or BLOCKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ctx = materialize(contexts(docs), "rlz-contexts")
    distinct = ctx.groupBy("anchor", "context").agg(F.min("k").alias("first"), F.count("*").alias("times"))
    distinct = materialize(distinct, "rlz-distinct")
    varied = distinct.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    # What may matter: contexts seen more than once, or one of several of an anchor.
    several = distinct.join(varied, "anchor", "left").where("times > 1 or n > 1").select("anchor", "context", "first", F.coalesce("n", F.lit(1)).alias("n"))
    judged = ctx.join(several, ["anchor", "context"]).select("k", "th", "anchor", "more", "places", "n", (F.col("first") < F.col("k")).alias("whole"))
    judged = materialize(judged.where("whole or n > 1"), "rlz-judged")
    whole = judged.where("whole").select("k", "th", "places", F.lit(0).alias("start"), (F.col("more") + WINDOW).alias("end"))

    wanted = judged.where("not whole").groupBy("k", "th").agg(F.collect_list(F.struct("anchor", "more", "places", (F.col("n") > HOT).alias("hot"))).alias("at"))
    bits, packed = bitmap(judged.where("not whole"), "k")
    sent = spark.sparkContext.broadcast(packed)  # 32 MB at most

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield batch.filter(pa.array(among(batch.column("p").to_numpy(), sent.value))).select(["k", "th", "text"])

    texts = docs.select(*_key(), "text").withColumn("p", spot("k", bits)).mapInArrow(near, "k long, th long, text string").dropDuplicates(["k", "th"])
    schema = pa.schema([("k", pa.int64()), ("th", pa.int64()), ("block", pa.int32()), ("places", pa.binary()), ("start", pa.int32()), ("words", pa.binary()), ("w1", pa.int64()), ("w2", pa.int64())])

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(it):
            ks, ths, ats = (batch.column(c).to_pylist() for c in ("k", "th", "at"))
            for lo, part in in_parts(batch.column("text").to_pylist()):
                words, first = word_hashes(part, lower=False)
                second = mix(words ^ np.uint64(0x5851F42D4C957F2D))
                r1, r2 = Rolling(words), Rolling(second)
                rows: list[tuple] = []
                for i in range(len(part)):
                    k, th, base = ks[lo + i], ths[lo + i], int(first[i])
                    for c in ats[lo + i]:
                        a = base + int(np.frombuffer(c["places"], np.int32, 1)[0])
                        b = a + c["more"]
                        if c["hot"]:
                            s = np.arange(a, b + 1)
                            h1, h2 = r1.of(s, s + WINDOW, 2).view(np.int64).tolist(), r2.of(s, s + WINDOW, 3).view(np.int64).tolist()
                            rows += [(k, th, None, c["places"], j, None, x, y) for j, (x, y) in enumerate(zip(h1, h2, strict=True))]
                        else:
                            block = c["anchor"] % blocks
                            rows.append((k, th, block, c["places"], 0, words[a : b + WINDOW].tobytes(), None, None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    cut_up = texts.join(wanted, ["k", "th"]).select("k", "th", "text", "at").mapInArrow(split, "k long, th long, block int, places binary, start int, words binary, w1 long, w2 long")
    cut_up = materialize(cut_up, "rlz-pieces")

    piece_schema = pa.schema([("k", pa.int64()), ("th", pa.int64()), ("places", pa.binary()), ("start", pa.int32()), ("end", pa.int32())])

    def parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their blocks; only one block's are held."""
        now, rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            found = parse_block([(r[0], np.frombuffer(r[3], np.uint64)) for r in rows])
            spans = [(r[0], r[1], r[2], a, b) for r, own in zip(rows, found, strict=True) for a, b in joined(own)]
            if spans:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*spans, strict=True), piece_schema, strict=True)], schema=piece_schema)
            rows.clear()

        for batch in small(it):
            for b, *row in zip(*(batch.column(c).to_pylist() for c in ("block", "k", "th", "places", "words")), strict=True):
                if b != now and rows:
                    yield from done()
                now = b
                rows.append(row)
        if rows:
            yield from done()

    factors = cut_up.where("block is not null").select("block", "k", "th", "places", "words").repartition(max(1, blocks // BLOCKS), "block").sortWithinPartitions("block").mapInArrow(parse, "k long, th long, places binary, start int, end int")
    hot = cut_up.where("block is null").select("k", "th", "places", "start", "w1", "w2")
    earliest = hot.groupBy("w1", "w2").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last").select("w1", "w2", "first")
    single = hot.join(earliest, ["w1", "w2"]).where("first < k").select("k", "th", "places", "start", (F.col("start") + WINDOW).alias("end"))
    spans = whole.union(factors).union(single)
    return spans.groupBy("k", "th").agg(F.collect_list(F.struct("places", "start", "end")).alias("spans"))


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans sorted, and those that touch as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """What goes, at all places, as sorted spans of a text's words that don't touch."""
    if not spans:
        return []
    at = [np.frombuffer(s["places"], np.int32).astype(np.int64) for s in spans]
    sizes = [len(a) for a in at]
    start, end = (np.concatenate(at) + np.repeat([s[c] for s in spans], sizes) for c in ("start", "end"))
    order = np.argsort(start)
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(start[1:] > end[:-1]) + 1
    return list(zip(start[np.append(0, new)].tolist(), end[np.append(new - 1, len(end) - 1)].tolist(), strict=True))


def _apply(docs: DataFrame, make, schema) -> DataFrame:
    """make(batch with columns of docs and a list of merged spans for each row) over all rows; only texts that may have
    spans are shuffled."""
    columns = docs.columns
    spans = materialize(duplicate_spans(docs.select("doc_id", "text")), "rlz-spans")
    bits, packed = bitmap(spans, "k")
    sent = docs.sparkSession.sparkContext.broadcast(packed)  # 32 MB at most
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), *_key()).withColumn("p", spot("k", bits))

    def side(inside: bool):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                mask = among(batch.column("p").to_numpy(), sent.value)
                yield batch.filter(pa.array(mask if inside else ~mask))

        return run

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(it):
            rows = pa.RecordBatch.from_struct_array(batch.column("row"))
            got = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * batch.num_rows
            yield make(rows, [merged(s) for s in got])

    def plain(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return finish(side(False)(it))

    alone = keyed.mapInArrow(plain, schema)
    # Not broadcast, however few the spans are: with a shuffle between them, the two Python steps don't run in one task.
    shared = keyed.mapInArrow(side(True), keyed.schema).join(spans.hint("merge"), ["k", "th"], "left").select("row", "spans").mapInArrow(finish, schema)
    return alone.union(shared)


def digest(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def make(rows: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        n, gone, sha = [], [], []
        for text, own in zip(rows.column("text").to_pylist(), spans, strict=True):
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            kept, at = [], 0
            for a, b in own:
                kept += words[at:a]
                at = b
            kept += words[at:]
            n.append(len(words))
            gone.append(len(words) - len(kept))
            sha.append(sha_hex(b" ".join(kept)))
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], schema=schema)

    return _apply(docs.select("doc_id", "text"), make, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its words [start, end) of each span and the space before each but the first of a text."""
    data = text.encode("utf-8", "surrogatepass")
    words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", data)]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : words[a][0]])
        at = words[b][0] if b < len(words) else len(data)
    return (b"".join(out) + data[at:]).decode("utf-8", "surrogatepass")


def dedup(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> the same columns, duplicate words cut out of text; n_chars, if there, follows."""

    def make(rows: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        if not any(spans):
            return rows
        i, j = rows.schema.get_field_index("text"), rows.schema.get_field_index("n_chars")
        texts = [cut(t, s) if s else t for t, s in zip(rows.column(i).to_pylist(), spans, strict=True)]
        rows = rows.set_column(i, "text", pa.array(texts, pa.string()))
        if j >= 0:
            sizes = [len(t) if s else n for n, t, s in zip(rows.column(j).to_pylist(), texts, spans, strict=True)]
            rows = rows.set_column(j, "n_chars", pa.array(sizes, rows.schema.field(j).type))
        return rows

    return _apply(docs, make, docs.schema)
