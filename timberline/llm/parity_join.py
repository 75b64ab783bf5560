"""N-gram Jaccard join by parity sketches, and the components of its links.

A text's shingles fall into the lanes of a sketch by their hash, and each lane keeps the XOR of its shingles. Two
sets differ in at most as many lanes as their symmetric difference has members, so the number of unlike lanes bounds
it from below. With a similarity of at least NUM/DEN and sizes a <= b, the symmetric difference is at most
(a + b) * (DEN - NUM) / (DEN + NUM) and b <= a * DEN / NUM: texts are sketched per band of sizes (and at the next
band if a larger partner may lie there) with more lanes than that, so that partners must share filled lanes. By the
prefix principle it is enough to publish, in one order fixed for all, D + 1 lanes of a text's D possible unlike ones;
slack(n) more are published, so partners share slack + 1. The order puts lanes last whose shingles all are frequent in
a bounded sample, as those of boilerplate are, and lanes of many shingles first; those seldom agree by chance.

1. Published lanes travel as packed arrays, a few bytes a lane, dealt out by hash. Where lanes meet, each text pairs
   with one other of its group only. A second sketch of single bits, one for each shingle or more, drops pairs that
   are too far apart. What is left makes first families.
2. Groups whose members are of several families are searched for pairs between them, size band by size band, on the bit
   sketches, in blocks; only one edge for each family that joins another leaves a block. A lane that many texts share
   (HOT) is such a group only for texts with more hot lanes than the slack of their smallest possible partner: any
   other text meets its partners in another lane. No link that the sketches allow leads out of a family any more.
3. All sets of a family are compared on the shingles themselves, in blocks and pairs of blocks, as products of 0-1
   matrices. That gives each text's number of links, and a forest of true links, whose components are the result.

So no pair of texts is a row of a shuffle but those of steps 1 and 2, at most a few for each text and lane. The
comparisons of step 2 and 3 grow with the square of a family, inside numpy; rows grow with its size times its blocks.

Texts with equal shingle sets are one class from the start, however many they are. Sets are compared by 64-bit
hashes of their shingles, classes by 128 bits of a digest.

Defined cases: texts without words, null included, have an empty set and are linked with nothing (each is its own
component); with fewer words than a shingle has, all words are one shingle; very long texts are whole; rows of one
doc_id are one node of the result's ids, but each row gives a row; a null doc_id is never a component's smallest,
unless no other is there (then the component is null); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import among, bitmap, spot
from .common import make_room, materialize, small
from .components import components, forest, stars
from .shingles import in_parts, mix, shingle_sets

NUM, DEN = 75, 100
BAND, HOT, BITS = 2, 32, 1024
CHIEFS = 16  # texts that each member of a hot lane's group may pair with
FLUSH = 1 << 19  # lanes that a map task holds before it sends them
SLICE = 200_000  # entries of a bucket that are sorted at once
FEW, GROUP = 64, 1_024  # classes of a group that come whole, and that are compared at once with as many others, by their sketches
BLOCK, BLOCK_BYTES = 512, 1 << 21  # classes, and bytes of their compressed texts, that are compared at once on their shingles
SAMPLE, LONGEST = 4_000, 8_192  # texts to learn frequent shingles from, and shingles of each (the smallest hashes)
_COLLAPSED = 0xFFFFFFFF
NO_ID = -(2**63)


def band_of(n: int) -> int:
    """The band of a size: [BAND^j, BAND^(j+1))."""
    j = 0
    while n >= BAND ** (j + 1):
        j += 1
    return j


def lanes(shingles: np.ndarray, band: int, frequent: np.ndarray | None = None) -> np.ndarray:
    """The published lanes of a set at a band of sizes, as hashes of (band, lane, number of its shingles, XOR of them)."""
    n, top = len(shingles), BAND ** (band + 1)
    count = max(top * 3 // 4, 4 * top if top <= 128 else 0, 1 << 14 if top <= 32 else 0)  # few shingles: one to a lane
    lane = (shingles >> np.uint64(16)) % np.uint64(count)
    order = np.argsort(lane)
    lane = lane[order]
    start = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
    folded = np.bitwise_xor.reduceat(shingles[order], start)
    size = np.diff(start, append=n)
    keys = mix(folded ^ mix(lane[start] + np.uint64((band + 1) << 40) + (size.astype(np.uint64) << np.uint64(48))))
    common = np.zeros(len(start), dtype=bool)
    if frequent is not None and len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        common = np.bitwise_and.reduceat((frequent[at] == shingles)[order], start)
    # Lanes with a shingle that few texts have come first, then lanes of many shingles: unlike texts seldom share those.
    keys = keys[np.lexsort((keys, -size, common))]
    partner = min(n * DEN // NUM, max(n, top - 1))
    unlike = (n + partner) * (DEN - NUM) // (DEN + NUM)
    return keys[: unlike + 1 + slack(n)]


def slack(n: int) -> int:
    """Lanes published beyond those needed; none for sets so small that they might not have so many."""
    return n // 40 + (n >= 32)


def published(shingles: np.ndarray, frequent: np.ndarray | None = None) -> np.ndarray:
    n = len(shingles)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    band = band_of(n)
    out = [lanes(shingles, band, frequent)]
    if n * DEN // NUM >= BAND ** (band + 1):  # a larger partner may be in the next band
        out.append(lanes(shingles, band + 1, frequent))
    return np.concatenate(out)


def bit_sketch(shingles: np.ndarray) -> bytes:
    """Parity of the shingles that fall on each of BITS bits, or twice as many until there is one for each shingle."""
    bits = BITS
    while bits < len(shingles):
        bits *= 2
    parity = np.bincount(((shingles >> np.uint64(40)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of words, those of more bytes than size folded onto it; unlike bits never grow by that."""
    if all(len(s) == size for s in sketches):
        return np.frombuffer(b"".join(sketches), np.uint64).reshape(-1, size // 8)
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, size // 8), axis=0) for s in sketches])


def _may_link(na: np.ndarray, nb: np.ndarray, unlike: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes with so many unlike bits can link."""
    return (DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb)) & ((DEN + NUM) * unlike <= (DEN - NUM) * (na + nb))


def class_of(shingles: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sets_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n, c1, c2 (the class of its set; null if the set is empty), sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("sketch", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in small(it):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for lo, part in in_parts(texts):
                sets = shingle_sets(part)
                keys = [class_of(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids[lo : lo + len(part)],
                        "n": [len(s) for s in sets],
                        "c1": [k[0] for k in keys],
                        "c2": [k[1] for k in keys],
                        "sketch": [bit_sketch(s) if len(s) else None for s in sets],
                    },
                    schema=schema,
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, c1 long, c2 long, sketch binary")


def frequent_shingles(docs: DataFrame, rows: int, sample: int = SAMPLE, least: int = 3) -> np.ndarray:
    """Shingles of at least `least` of about `sample` different texts, drawn by their hash: an order for lanes that all
    texts share. It decides only which lanes are published first, so any set gives the same links."""
    h = F.xxhash64("text")
    drawn = docs.select("text", h.alias("h")).where(F.pmod(F.xxhash64(h), F.lit(1 << 30)) < int(min(1.0, sample / max(1, rows)) * (1 << 30))).dropDuplicates(["h"])
    schema = pa.schema([("s", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(it):
            for _, texts in in_parts(batch.column("text").to_pylist()):
                # A fixed part of the hash range of very long texts bounds what is sent.
                yield pa.RecordBatch.from_pydict({"s": [s[:LONGEST].tobytes() for s in shingle_sets(texts) if len(s)]}, schema=schema)

    found = [np.frombuffer(r["s"], np.uint64) for r in drawn.select("text").mapInArrow(run, "s binary").collect()]
    if not found:
        return np.zeros(0, np.uint64)
    value, count = np.unique(np.concatenate(found), return_counts=True)
    return value[count >= least]


_MEET = "kind string, a long, b long, members array<long>"
_MEET_ARROW = pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("members", pa.list_(pa.int64()))])
_SENT = pa.schema([("bucket", pa.int32()), ("data", pa.binary()), *_MEET_ARROW])


def _rows(schema: pa.Schema, kind: str, a=(), b=(), members=None) -> pa.RecordBatch:
    n = len(a)
    columns = {"kind": [kind] * n, "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()) if len(b) else [None] * n}
    columns |= {"members": members if members is not None else [None] * n, "bucket": [None] * n, "data": [None] * n}
    return pa.RecordBatch.from_pydict({f.name: columns[f.name] for f in schema}, schema=schema)


def _grouped(keys: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, who) in order, and where groups of a key with two members or more start and end."""
    order = np.lexsort((who, keys))
    keys, who = keys[order], who[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (who[1:] != who[:-1])]) if len(keys) else np.zeros(0, bool)
    keys, who = keys[new], who[new]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(start, append=len(keys))
    many = size >= 2
    return keys, who, start[many], size[many]


def _chief(key: np.uint64, members: np.ndarray) -> int:
    """Which member of a hot lane all others pair with. One of CHIEFS orders, by the lane, picks it: a large group of
    texts that are not all alike falls together by several of them."""
    return int(np.argmin(mix(members.view(np.uint64) ^ np.uint64((int(key) % CHIEFS + 1) << 56))))


def _gid(keys: np.ndarray, bucket: int) -> np.ndarray:
    """The group of a hot lane, the same wherever it is found: from the bits of its key that are sent, and its bucket."""
    return ((keys.astype(np.int64) & 0xFFFFFFFF) << 20) | bucket


def _star(chief: int, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    others = np.delete(members, chief)
    return np.minimum(members[chief], others), np.maximum(members[chief], others)


def meetings(docs: DataFrame, buckets: int, frequent: np.ndarray | None = None) -> DataFrame:
    """Where published lanes of different classes meet: kind 'pair' (a: smallest, b: other class), 'group' (members)
    and 'hot' (a: lane, b: class), by the first 64 bits of the classes."""

    sent_frequent = docs.sparkSession.sparkContext.broadcast(frequent)  # at most SAMPLE * LONGEST / 3 hashes

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: list[int] = []
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(parts)
            who = np.repeat(np.array(classes, dtype=np.int64), [len(p) for p in parts])
            keys, who, start, count = _grouped(keys, who)
            drop, marks = np.zeros(len(keys), bool), []
            for s, c in zip(start[count > HOT].tolist(), count[count > HOT].tolist(), strict=True):
                chief = _chief(keys[s], who[s : s + c])
                yield _rows(_SENT, "pair", *_star(chief, who[s : s + c]))
                yield _rows(_SENT, "hot", np.full(c, _gid(keys[s], int(keys[s] >> np.uint64(32)) % buckets)), who[s : s + c])
                drop[s : s + c] = True
                drop[s + chief] = False
                marks.append(keys[s])
            table, index = np.unique(who[~drop], return_inverse=True)
            keys = np.concatenate([keys[~drop], np.array(marks, dtype=np.uint64)])
            index = np.concatenate([index.astype(np.uint32), np.full(len(marks), _COLLAPSED, np.uint32)])
            bucket = (keys >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            keys, index, bucket = keys[order], index[order], bucket[order]
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            data, names = [], []
            for b in range(buckets):
                lo, hi = edge[b], edge[b + 1]
                if hi > lo:
                    used, short = np.unique(index[lo:hi], return_inverse=True)
                    ids = np.where(used == _COLLAPSED, 0, table[np.minimum(used, max(0, len(table) - 1))] if len(table) else 0)
                    flag = (used == _COLLAPSED).astype(np.uint8)
                    head = np.array([len(used), hi - lo], dtype=np.int64)
                    width = np.uint16 if len(used) <= 1 << 16 else np.uint32
                    low = keys[lo:hi].astype(np.uint32) if BITS_SENT == 32 else keys[lo:hi]
                    data.append(b"".join([head.tobytes(), ids.astype(np.int64).tobytes(), low.tobytes(), short.astype(width).tobytes(), flag.tobytes()]))
                    names.append(b)
            n = len(names)
            columns = {"bucket": names, "data": data, "kind": [None] * n, "a": [None] * n, "b": [None] * n, "members": [None] * n}
            yield pa.RecordBatch.from_pydict(columns, schema=_SENT)
            classes.clear()
            parts.clear()

        for batch in small(it):
            for _, texts in in_parts(batch.column("text").to_pylist()):
                for s in shingle_sets(texts):
                    if len(s):
                        p = published(s, sent_frequent.value)
                        parts.append(p)
                        classes.append(class_of(s)[0])
                        size += len(p)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if parts:
            yield from flush()

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in it:
            own = batch.filter(pa.compute.is_valid(batch.column("kind")))
            if own.num_rows:
                yield own.select(_MEET_ARROW.names)
            for b, raw in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if raw is None:
                    continue
                n, m = np.frombuffer(raw, np.int64, 2).tolist()
                ids = np.frombuffer(raw, np.int64, n, 16)
                at = 16 + 8 * n
                low = np.frombuffer(raw, np.uint32, m, at)
                at += 4 * m
                width = np.uint16 if n <= 1 << 16 else np.uint32
                short = np.frombuffer(raw, width, m, at)
                flag = np.frombuffer(raw, np.uint8, n, at + m * width().itemsize)
                held.setdefault(b, []).append((low, short, ids, flag))  # as they came, nothing is copied
        while held:
            b, parts = held.popitem()
            slices = 1 + sum(len(p[0]) for p in parts) // SLICE
            for s in range(slices):  # a lane's entries all have the same remainder
                some = [(p, np.flatnonzero(p[0] % np.uint32(slices) == s)) for p in parts]
                low = np.concatenate([p[0][at] for p, at in some])
                who, flag = (np.concatenate([p[i][p[1][at]] for p, at in some]) for i in (2, 3))
                yield from _meet_bucket(b, low, who, flag)

    def _meet_bucket(bucket: int, low: np.ndarray, who: np.ndarray, flag: np.ndarray) -> Iterator[pa.RecordBatch]:
        marked = np.unique(low[flag == 1])
        keys, who, start, count = _grouped(low[flag == 0], who[flag == 0])
        hot = (count > HOT) | np.isin(keys[start], marked)
        small_start, small = start[~hot], count[~hot] - 1
        first = np.repeat(who[small_start], small)
        other = who[np.repeat(small_start + 1 - np.concatenate([[0], np.cumsum(small)[:-1]]), small) + np.arange(len(first))] if len(first) else first
        stars = [_star(_chief(keys[s], who[s : s + c]), who[s : s + c]) for s, c in zip(start[hot].tolist(), count[hot].tolist(), strict=True)]
        pairs = np.concatenate([np.stack([first, other], 1), *[np.stack(x, 1) for x in stars]])
        pairs = np.unique(pairs, axis=0)
        if len(pairs):
            yield _rows(_MEET_ARROW, "pair", pairs[:, 0], pairs[:, 1])
        alone = keys[np.flatnonzero(np.isin(keys, marked))]
        hot_rows = np.isin(keys, np.concatenate([keys[start[hot]], alone]))
        if hot_rows.any():
            yield _rows(_MEET_ARROW, "hot", _gid(keys[hot_rows], bucket), who[hot_rows])
        sets, names = {}, []
        for s, c in zip(start[~hot & (count > 2)].tolist(), count[~hot & (count > 2)].tolist(), strict=True):
            sets.setdefault(who[s : s + c].tobytes(), None)
        for m in sets:
            names.append(int.from_bytes(hashlib.blake2b(m, digest_size=8).digest(), "little", signed=True))
        if names:
            yield _rows(_MEET_ARROW, "group", names, members=[np.frombuffer(m, np.int64) for m in sets])

    sent = "bucket int, data binary, kind string, a long, b long, members array<long>"
    dealt = docs.select("text").mapInArrow(send, sent).repartition(buckets, F.coalesce("bucket", F.xxhash64("a", "b")))
    return dealt.mapInArrow(meet, _MEET)


BITS_SENT = 32  # of a lane's hash, besides its bucket: lanes that only look alike are told apart by verification


def near_enough(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose sizes and bit sketches allow a link, as edges (u, v) with the same components;
    classes: c1, n, sketch, one row a class."""
    left = classes.select(F.col("c1").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("c1").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(it, 4096):
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            batch = batch.filter(pa.array(DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb)))
            a, b, na, nb = (batch.column(c).to_numpy() for c in ("a", "b", "na", "nb"))
            sa, sb = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
            size, near = np.array([min(len(x), len(y)) for x, y in zip(sa, sb, strict=True)], dtype=np.int64), np.zeros(len(a), bool)
            for z in np.unique(size).tolist():
                at = np.flatnonzero(size == z)
                unlike = np.bitwise_count(folded([sa[i] for i in at], z) ^ folded([sb[i] for i in at], z)).sum(axis=1, dtype=np.int64)
                near[at] = _may_link(na[at], nb[at], unlike)
            yield stars(a[near].tolist(), b[near].tolist())

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "u long, v long")


def _between(n: np.ndarray, family: np.ndarray, sketches: list[bytes], own: np.ndarray, block: np.ndarray) -> list[tuple[int, int]]:
    """Edges between families of members that may link: one at least for any two families joined by such pairs, at
    most one for each family. Pairs of which neither is own, or of one block if there are two, are met elsewhere."""
    names, of = np.unique(family, return_inverse=True)
    up = list(range(len(names)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    edges: list[tuple[int, int]] = []
    most = int(np.bincount(of).argmax())
    two = block.min() != block.max()
    size = np.array([len(s) for s in sketches])
    at = {z: folded([s if len(s) >= z else bytes(z) for s in sketches], z) for z in np.unique(size).tolist()}  # shorter ones are not compared at z
    for i in np.flatnonzero(of != most).tolist():  # pairs inside the largest family need no look
        other = of != of[i]
        other[:i] &= of[:i] == most  # a pair of two others once
        if not own[i]:
            other &= own
        if two:
            other &= block != block[i]
        other &= DEN * np.minimum(n, n[i]) >= NUM * np.maximum(n, n[i])
        j = np.flatnonzero(other)
        for z in np.unique(np.minimum(size[j], size[i])).tolist():
            k = j[np.minimum(size[j], size[i]) == z]
            unlike = np.bitwise_count(at[z][k] ^ at[z][i]).sum(axis=1, dtype=np.int64)
            for m in k[_may_link(n[k], n[i], unlike)].tolist():
                x, y = top(of[i]), top(of[m])
                if x != y:
                    up[max(x, y)] = min(x, y)
                    edges.append((int(family[i]), int(family[m])))
    return edges


def _within_few(start: np.ndarray, size: np.ndarray, n: np.ndarray, family: np.ndarray, sketches: list[bytes]) -> dict[int, int]:
    """Joined families of many groups of FEW members or less at once, all pairs of a group; rows lie group by group."""
    # Place r of a group pairs with all behind it: size - 1 - r partners.
    place = np.arange(len(n)) - np.repeat(start, size)
    behind = np.repeat(size, size) - 1 - place
    i = np.repeat(np.arange(len(n)), behind)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(behind) - behind, behind)
    fit = (family[i] != family[j]) & (DEN * np.minimum(n[i], n[j]) >= NUM * np.maximum(n[i], n[j]))
    i, j = i[fit], j[fit]
    bytes_of = np.array([len(s) for s in sketches])
    least = np.minimum(bytes_of[i], bytes_of[j])
    joined: list[tuple[int, int]] = []
    for z in np.unique(least).tolist():
        x, y = i[least == z], j[least == z]
        used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        bits = folded([sketches[k] for k in used.tolist()], z)
        for lo in range(0, len(x), 1 << 14):
            p, q = x[lo : lo + (1 << 14)], y[lo : lo + (1 << 14)]
            unlike = np.bitwise_count(bits[at[lo : lo + len(p)]] ^ bits[at[len(x) + lo : len(x) + lo + len(q)]]).sum(axis=1, dtype=np.int64)
            near = _may_link(n[p], n[q], unlike)
            joined += set(zip(family[p[near]].tolist(), family[q[near]].tolist(), strict=True))
    return forest([e[0] for e in joined], [e[1] for e in joined])


def gathered(wide: DataFrame) -> DataFrame:
    """wide (gid, m: members of the group, c1, n, sketch, family) -> gid, c1, n, sketch, family: groups that overlap,
    directly or through others, as one group, if that has no more pairs than they have. Near copies of one text share
    most of their lanes, and would be compared again in each; no pair of a group is lost by joining it with others."""
    stars_ = wide.join(wide.groupBy("gid").agg(F.min("c1").alias("u")), "gid").select("u", F.col("c1").alias("v"))
    net = materialize(components(stars_), "join-net")
    groups = wide.groupBy("gid").agg(F.min("c1").alias("node"), F.max("m").alias("m")).join(net, "node")
    apart = groups.groupBy("component").agg(F.sum(F.col("m") * F.col("m")).alias("apart"))
    worth = net.groupBy("component").agg(F.count("*").alias("c")).join(apart, "component").where("c * c <= apart").select("component")
    into = materialize(groups.join(worth, "component").select("gid", "component"), "join-into")
    named = net.join(worth, "component", "left_semi").select(F.col("component").alias("gid"), F.col("node").alias("c1"))
    joint = named.join(wide.select("c1", "n", "sketch", "family").dropDuplicates(["c1"]), "c1")
    columns = ["gid", "c1", "n", "sketch", "family"]
    return joint.select(columns).union(wide.join(into, "gid", "left_anti").select(columns))


def between_families(member: DataFrame) -> DataFrame:
    """member (gid, c1, n, sketch, family) -> edges (u, v) between families that have members in one group which may
    link by size and sketch.

    Groups of FEW members or less come whole, many at once. Larger ones are first joined where they overlap, then
    dealt into bands of sizes a little wider than the ratio of partners' sizes, so partners are of one band or of
    neighbours: a text is in its own and, as a guest, in the next one's group. Those of more than GROUP members are cut
    into blocks, and each pair of blocks is a task record of its own."""
    size = member.groupBy("gid").agg(F.count("*").alias("m"))
    member = materialize(member.join(size, "gid"), "join-open")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def few(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their groups; what is held ends with whole groups."""
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> pa.RecordBatch:
            gid, n, family = (table.column(c).to_numpy() for c in ("gid", "n", "family"))
            start = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]]))
            tops = _within_few(start, np.diff(start, append=len(gid)), n, family, table.column("sketch").to_pylist())
            edges = [(x, m) for x, m in tops.items() if x != m]
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], schema=schema)

        for batch in small(it, 2048):
            held.append(batch)
            table = pa.Table.from_batches(held)
            gid = table.column("gid").to_numpy()
            cut = int(np.flatnonzero(gid != gid[-1])[-1]) + 1 if (gid != gid[-1]).any() else 0
            if cut:
                yield done(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    parts = int(member.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = member.where(F.col("m") <= FEW).select("gid", "n", "family", "sketch").repartition(parts, "gid").sortWithinPartitions("gid")
    narrow = narrow.mapInArrow(few, "u long, v long")

    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(DEN / NUM * 1.0001))).cast("int")
    both = F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band + 1).alias("band"), F.lit(False).alias("own")))
    large = materialize(gathered(member.where(F.col("m") > FEW)), "join-wide")
    dealt = large.withColumn("at", F.explode(both)).select("gid", "c1", "n", "sketch", "family", "at.band", "at.own")
    wide = dealt.groupBy("gid", "band").agg(F.count("*").alias("m"), F.min("family").alias("lo"), F.max("family").alias("hi"), F.max("own").alias("any"))
    wide = wide.where("lo < hi and any").select("gid", "band", F.ceil(F.col("m") / GROUP).cast("int").alias("blocks"))
    dealt = dealt.join(wide, ["gid", "band"]).withColumn("block", F.pmod(F.xxhash64("c1"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("other", "blocks")

    def near(table: pa.Table) -> pa.Table:
        n, family, own, block = (table.column(c).to_numpy() for c in ("n", "family", "own", "block"))
        found = _between(n, family, table.column("sketch").to_pylist(), own, block)
        return pa.table({"u": pa.array([e[0] for e in found], pa.int64()), "v": pa.array([e[1] for e in found], pa.int64())})

    return narrow.union(paired.groupBy("gid", "band", "x", "y").applyInArrow(near, "u long, v long")).distinct()


def texts_of(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """One text of each wanted class: owners (c1, id: a doc_id, NO_ID for null) -> c1, text (compressed). A bitmap over ids
    keeps most other texts out of the shuffle."""
    bits, packed = bitmap(owners, "id")
    sent = docs.sparkSession.sparkContext.broadcast(packed)  # 32 MB at most
    schema = pa.schema([("id", pa.int64()), ("c1", pa.int64()), ("text", pa.binary())])

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in it:
            for part in small([batch.filter(pa.array(among(batch.column("p").to_numpy(), sent.value)))]):
                ids, texts = part.column("id").to_pylist(), part.column("text").to_pylist()
                for lo, some in in_parts(texts):
                    sets = shingle_sets(some)
                    found = [(i, class_of(s)[0], pack(t.encode("utf-8", "surrogatepass"))) for i, s, t in zip(ids[lo : lo + len(some)], sets, some, strict=True) if len(s)]
                    yield pa.RecordBatch.from_pydict({"id": [f[0] for f in found], "c1": [f[1] for f in found], "text": [f[2] for f in found]}, schema=schema)

    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text").withColumn("p", spot("id", bits)).mapInArrow(keep, "id long, c1 long, text binary")
    return rows.join(owners.select("id", "c1"), ["id", "c1"]).dropDuplicates(["c1"]).select("c1", "text")


def _held(texts: list) -> list[np.ndarray]:
    """The shingle sets of compressed texts."""
    unpack, out = zstandard.ZstdDecompressor().decompress, []
    for lo in range(0, len(texts), 32):
        part = [unpack(t).decode("utf-8", "surrogatepass") for t in texts[lo : lo + 32]]
        for _, some in in_parts(part):
            out += shingle_sets(some)
    return out


def common_shingles(x: list[np.ndarray], y: list[np.ndarray], cells: int = 1 << 22) -> np.ndarray:
    """How many shingles each set of x has in common with each of y: products of 0-1 matrices, a range of the shared
    shingles at a time, at most `cells` wide and long."""
    sx, sy = np.concatenate(x), np.concatenate(y)
    shared = np.unique(sx) if x is y else np.intersect1d(sx, sy)
    out = np.zeros((len(x), len(y)), dtype=np.int64)
    if not len(shared):
        return out
    width = max(1, cells // max(len(x), len(y)))

    def places(s: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(shared, s), len(shared) - 1)
        hit = shared[at] == s
        row, at = np.repeat(np.arange(len(sets)), [len(v) for v in sets])[hit], at[hit]
        order = np.argsort(at, kind="stable")
        return row[order], at[order]

    (rx, ax), (ry, ay) = places(sx, x), places(sy, y)
    for lo in range(0, len(shared), width):
        m = []
        for row, at, n in ((rx, ax, len(x)), (ry, ay, len(y))):
            a, b = np.searchsorted(at, [lo, lo + width])
            one = np.zeros((n, min(width, len(shared) - lo)), dtype=np.float32)  # sums below 2^24 are exact
            one[row[a:b], at[a:b] - lo] = 1
            m.append(one)
        out += (m[0] @ m[1].T).astype(np.int64)
    return out


def _linked(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    same = common_shingles(x, y)
    size = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :]
    return DEN * same >= NUM * (size - same)


def _packed(sets: list[np.ndarray]) -> bytes:
    """Sets as one frame, each distinct shingle once: a block of near copies takes little more than one of them."""
    values, index = np.unique(np.concatenate(sets), return_inverse=True)
    head = np.array([len(sets), len(values), *map(len, sets)], dtype=np.int64)
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + values.tobytes() + index.astype(np.uint32).tobytes())


def _unpacked(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    count, distinct = np.frombuffer(raw, np.int64, 2).tolist()
    sizes, at = np.frombuffer(raw, np.int64, count, 16), 16 + 8 * count
    values = np.frombuffer(raw, np.uint64, distinct, at)
    return np.split(values[np.frombuffer(raw, np.uint32, -1, at + 8 * distinct)], np.cumsum(sizes)[:-1])


_BLOCK = "family long, blocks int, block int, names array<long>, links array<long>, tops array<long>, sets binary"
_BLOCK_ARROW = pa.schema(
    [("family", pa.int64()), ("blocks", pa.int32()), ("block", pa.int32()), ("names", pa.list_(pa.int64())), ("links", pa.list_(pa.int64())), ("tops", pa.list_(pa.int64())), ("sets", pa.binary())]
)


def _within(family: int, blocks: int, block: int, names: list[int], sets: list[np.ndarray]) -> dict:
    """A block's row: of each class, with how many of the block it links, and the smallest it is joined with by links."""
    if len(sets) == 2:
        same = len(np.intersect1d(*sets, assume_unique=True))
        near = np.array([[True, DEN * same >= NUM * (len(sets[0]) + len(sets[1]) - same)]] * 2)
        near[1] = near[1, ::-1]
    else:
        near = _linked(sets, sets)
    x, y = np.nonzero(np.triu(near, 1))
    tops = forest([names[i] for i in x.tolist()], [names[i] for i in y.tolist()])
    raw = _packed(sets) if blocks > 1 else None
    links = (near.sum(axis=1) - 1).tolist()  # each set is near itself
    return {"family": family, "blocks": blocks, "block": block, "names": names, "links": links, "tops": [tops.get(c, c) for c in names], "sets": raw}


def compared(group: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """group (node, component), texts (c1, text: compressed) of all nodes -> c1, n_links (with how many other classes each
    links) and edges (u, v) of links that join what links join. All sets of a component are compared, in blocks of about
    BLOCK classes or BLOCK_BYTES of text; each pair of blocks is a task record of its own."""
    member = group.select(F.col("node").alias("c1"), F.col("component").alias("family")).join(texts, "c1")
    member = materialize(member.select("family", "c1", "text"), "join-members")
    blocks = member.groupBy("family").agg(F.count("*").alias("m"), F.sum(F.octet_length("text")).alias("bytes"))
    blocks = blocks.select("family", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = member.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("c1"), F.col("blocks")).cast("int"))

    def one(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their blocks; only those of one block are held."""
        now, names, sets = None, [], []
        for batch in small(it):
            done = []
            keys = zip(*(batch.column(c).to_pylist() for c in ("family", "blocks", "block")), strict=True)
            for key, c, s in zip(keys, batch.column("c1").to_pylist(), _held(batch.column("text").to_pylist()), strict=True):
                if key != now:
                    if now is not None:
                        done.append(_within(*now, names, sets))
                    now, names, sets = key, [], []
                names.append(c)
                sets.append(s)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_BLOCK_ARROW)
        if now is not None:
            yield pa.RecordBatch.from_pylist([_within(*now, names, sets)], schema=_BLOCK_ARROW)

    def between(table: pa.Table) -> pa.Table:
        names, rows = table.column("names").to_pylist(), []
        if len(names) == 2:  # a block may be empty
            near = _linked(*map(_unpacked, table.column("sets").to_pylist()))
            x, y = np.nonzero(near)
            tops = forest([names[0][i] for i in x.tolist()], [names[1][i] for i in y.tolist()])
            links = [*near.sum(axis=1).tolist(), *near.sum(axis=0).tolist()]
            rows = [(c, m, tops.get(c, c)) for c, m in zip(names[0] + names[1], links, strict=True)]
        return pa.table({k: pa.array([r[i] for r in rows], pa.int64()) for i, k in enumerate(("c1", "links", "top"))})

    parts = int(group.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(parts, "family", "block").sortWithinPartitions("family", "block")
    done = materialize(ordered.select("family", "blocks", "block", "c1", "text").mapInArrow(one, _BLOCK), "join-blocks")
    inside = done.select(F.explode(F.arrays_zip("names", "links", "tops")).alias("p")).select(F.col("p.names").alias("c1"), F.col("p.links").alias("links"), F.col("p.tops").alias("top"))
    wide = done.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
    wide = wide.select("family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "names", "sets")
    across = wide.groupBy("family", "lo", "hi").applyInArrow(between, "c1 long, links long, top long")
    every = materialize(inside.union(across), "join-links")
    return every.groupBy("c1").agg(F.sum("links").alias("n_links")), every.where("top <> c1").select(F.col("c1").alias("u"), F.col("top").alias("v"))


def hot_only(hot: DataFrame, sizes: DataFrame) -> DataFrame:
    """hot (gid, c1), sizes (c1, n) -> c1 of classes that may share nothing but hot lanes with a partner: those with more
    of them than the slack of their smallest partner, as two sets are sure of one lane more than the smaller's."""
    least = F.floor((NUM * F.col("n") + DEN - 1) / DEN)
    spare = F.floor(least / 40) + (least >= 32).cast("int")
    return hot.groupBy("c1").agg(F.count("*").alias("h")).join(sizes, "c1").where(F.col("h") > spare).select("c1")


def families(docs: DataFrame, classes: DataFrame, buckets: int, rows: int) -> DataFrame:
    """docs (text), classes (c1, n, sketch) -> node, component: groups of classes such that no link leads out of one."""
    met = materialize(meetings(docs, buckets, frequent_shingles(docs, rows)), "join-met")
    near = near_enough(met.where("kind = 'pair'").select("a", "b").distinct(), classes)
    first = materialize(components(near, contract=False), "join-first")
    hot = met.where("kind = 'hot'").select(F.col("a").alias("gid"), F.col("b").alias("c1"))
    short = hot_only(hot, classes.select("c1", "n"))
    member = met.where("kind = 'group'").select(F.col("a").alias("gid"), F.explode("members").alias("c1")).union(hot.join(short, "c1", "left_semi").select("gid", "c1"))
    member = member.distinct().join(first.withColumnRenamed("node", "c1"), "c1", "left").withColumn("family", F.coalesce("component", "c1"))
    split = member.groupBy("gid").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo < hi").select("gid")
    open_ = member.join(split, "gid", "left_semi").join(classes.select("c1", "n", "sketch"), "c1").select("gid", "c1", "n", "sketch", "family")
    joined = materialize(components(between_families(open_)), "join-joined")
    to = joined.select(F.col("node").alias("old"), F.col("component").alias("new"))
    moved = first.join(to, first["component"] == to["old"], "left").select("node", F.coalesce("new", "component").alias("component"))
    alone = joined.join(first.select("node"), "node", "left_anti")  # classes that were no family before
    return moved.union(alone.select("node", "component"))


def link(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, class (null without words), n_links: with how many
    other classes its class links."""
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text")
    sets = materialize(sets_of(docs), "join-sets")
    # One row a class. Of classes that agree in their first 64 bits only, pairs meet both, and verification decides.
    some = sets.where("n > 0")
    reps = some.groupBy("c1", "c2").agg(F.min("doc_id").alias("doc_id"))
    classes = materialize(some.groupBy("c1").agg(F.max("n").alias("n"), F.min_by("sketch", "c2").alias("sketch"), F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("id")), "join-sketches")
    near = materialize(families(docs, classes, buckets, sets.count()), "join-families")
    owners = classes.select("c1", "id").join(near.select(F.col("node").alias("c1")), "c1", "left_semi")
    counts, edges = compared(near, texts_of(docs, materialize(owners, "join-owners")))
    group = components(edges).withColumnRenamed("node", "c1")

    named = reps.join(group, "c1", "left").join(counts, "c1", "left")
    key = F.struct(F.col("component").isNull().alias("own"), F.coalesce("component", "c1").alias("x"), F.when(F.col("component").isNull(), F.col("c2")).alias("y"))
    named = named.withColumn("k", key)
    least = named.groupBy("k").agg(F.min("doc_id").alias("component_id"))
    named = materialize(named.join(least, "k").select("c1", "c2", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "join-classes")
    out = sets.join(named, ["c1", "c2"], "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.concat_ws("-", F.hex("c1"), F.hex("c2"))).alias("class"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without documents that are linked with one of a smaller doc_id, directly or through others; of rows with
    one doc_id and one component, all stay or go together. Rows with a null doc_id stay."""
    joined = link(docs).select(F.col("doc_id").alias("_id"), "component_id").where("component_id < _id").select("_id").distinct()
    return docs.join(joined, docs["doc_id"] == joined["_id"], "left_anti")
