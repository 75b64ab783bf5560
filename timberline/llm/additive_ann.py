"""Nearest neighbours by additive quantisation, with an exact check of all that the codes leave open.

Vectors are scaled to unit length. STAGES codebooks of CENTRES full-dimensional centres each are trained one after
the other on the residuals of a bounded sample (SAMPLE rows, fewer where that is more than SAMPLE_NUMBERS numbers, drawn
by a hash of vec_id). A vector's code is the best sum of one centre from each codebook that a beam of BEAM partial sums
finds; beside the code stand the squared norm of that sum and its angle to the vector. A query scores all codes of a
block by tables of its products with all centres, STAGES look-ups a vector, over the norm. The exact cosines of the
DEPTH best give a threshold, and by the triangle inequality of angles a code's score and angle bound its vector's cosine:
each vector whose bound reaches the threshold is compared with the query in double precision. So no vector is missed,
however poor the codes are: they decide how many vectors are compared, not which are found.

Codes with their vectors, and queries, are packed into blocks, and each pair of a block of queries and a block of codes
is one small task record, of which the k best of each query come out: no task holds all codes or all queries, and nothing
that grows with the input is broadcast. Only the trained codebooks are.

Defined cases: vectors null, zero, or holding null or non-finite components take no part on either side; those of
different lengths are no candidates of each other (each length with CENTRES rows in the sample has codebooks of its
own, others are compared without); a null vec_id takes no part; a query's own vec_id is no candidate; ties go to the
smaller vec_id; repeated rows of one vec_id and vector count once; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import materialize

STAGES, CENTRES, BEAM, SAMPLE, DEPTH, BLOCK, QUERIES = 16, 256, 4, 16_384, 300, 1 << 13, 1 << 13
#: Numbers in a block of vectors, and in the sample; queries scored at once.
BLOCK_NUMBERS, SAMPLE_NUMBERS, ASKED = 1 << 21, 1 << 22, 128


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v (array of double) and its length, one row for each different usable row; what is too large or small to be squared is scaled."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where("vec_id is not null and embedding is not null").where(fine).select("vec_id", v.alias("v"))
    kept = kept.withColumn("peak", F.greatest(F.array_max("v"), -F.array_min("v"))).where("peak > 0")
    kept = kept.withColumn("v", F.when(F.col("peak").between(1e-100, 1e100), F.col("v")).otherwise(F.transform("v", lambda x: x / F.col("peak"))))
    return kept.select("vec_id", "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("length")).dropDuplicates(["vec_id", "v"])


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def train(x: np.ndarray, stages: int = STAGES, centres: int = CENTRES, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Codebooks (stages x centres x dimensions) by k-means on what the stages before leave over."""
    rng = np.random.default_rng(seed)
    books, rest = [], x.astype(np.float32).copy()
    for _ in range(stages):
        book = rest[rng.choice(len(rest), centres, replace=len(rest) < centres)].copy()
        for _ in range(rounds):
            own = _nearest(rest, book)
            n = np.bincount(own, minlength=centres)
            sums = np.stack([np.bincount(own, rest[:, j], centres) for j in range(rest.shape[1])], 1)
            book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], rest[rng.integers(0, len(rest), centres)]).astype(np.float32)
        rest -= book[_nearest(rest, book)]
        books.append(book)
    return np.stack(books)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x stages, uint8) and squared norms of what they stand for, by beam search."""
    x = x.astype(np.float32)
    n = len(x)
    sums, codes, kept = np.zeros((n, 1, x.shape[1]), np.float32), np.zeros((n, 1, 0), np.uint8), 1
    for book in books:
        rest = x[:, None, :] - sums
        cost = (rest**2).sum(2)[:, :, None] - 2 * rest @ book.T + (book**2).sum(1)
        flat = cost.reshape(n, -1)
        width = min(beam, flat.shape[1])
        best = np.argpartition(flat, width - 1, axis=1)[:, :width]
        parent, centre = np.divmod(best, len(book))
        row = np.arange(n)[:, None]
        sums = sums[row, parent] + book[centre]
        codes = np.concatenate([codes[row, parent], centre[:, :, None].astype(np.uint8)], 2)
        kept = width
    error = ((x[:, None, :] - sums) ** 2).sum(2)
    best = error.argmin(1) if kept > 1 else np.zeros(n, np.int64)
    row = np.arange(n)
    return codes[row, best], (sums[row, best] ** 2).sum(1)


def score(queries: np.ndarray, books: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Approximate cosines (codes x queries) of unit queries, by look-up."""
    tables = np.matmul(books, queries.astype(np.float32).T)
    out = np.zeros((len(codes), len(queries)), np.float32)
    for s in range(len(books)):
        out += tables[s][codes[:, s]]
    return out / np.sqrt(np.maximum(norms, 1e-12)).astype(np.float32)[:, None]


def angles(x: np.ndarray, books: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms of what the codes stand for, and its angles to the unit vectors x, rounded up."""
    sums = np.zeros(x.shape)
    for book, centre in zip(books, codes.T):
        sums += book[centre]
    norms = (sums**2).sum(1)
    apart = np.sqrt(((x - sums / np.sqrt(np.maximum(norms, 1e-12))[:, None]) ** 2).sum(1))
    return norms, np.where(norms > 1e-6, 2 * np.arcsin(np.minimum(apart / 2, 1)) + 1e-5, np.pi)


def bounds(near: np.ndarray, books: np.ndarray, norms: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """What the cosines can be at most, where near (queries x codes) are the scores. Rounding of single precision is allowed for."""
    reach = np.sqrt((books**2).sum(2)).max(1, initial=0).sum()
    slack = (books.shape[2] + len(books) + 8) * 2.0**-23 * reach / np.sqrt(np.maximum(norms, 1e-12)) + 1e-6
    top = np.clip(near + slack.astype(np.float32), -1, 1)
    cos, sin = np.cos(angle).astype(np.float32), np.sin(angle).astype(np.float32)
    return np.where(top < cos, top * cos + np.sqrt((1 - top) * (1 + top)) * sin + np.float32(2e-6), np.float32(2))


def nearest(ids: np.ndarray, x: np.ndarray, length: np.ndarray, code: tuple[np.ndarray, ...], asked: np.ndarray, y: np.ndarray, asked_length: np.ndarray, books: np.ndarray, k: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in `asked`, places in `ids` and cosines of the k nearest rows x of each y, all of which are found; code is (codes, norms, angles) of x."""
    codes, norms, angle = code
    unit, q = x / length[:, None], y / asked_length[:, None]
    none = asked[:, None] == ids
    near = score(q, books, codes, norms).T
    if len(ids) > max(depth, k):
        first = np.argpartition(near, -max(depth, k + 1), axis=1)[:, -max(depth, k + 1) :]
        known = np.stack([unit[at] @ v for at, v in zip(first, q)])
        known[np.take_along_axis(none, first, 1)] = -np.inf
        least = np.partition(known, -k, axis=1)[:, -k]
        rows = np.flatnonzero((bounds(near, books, norms, angle) >= least[:, None]).any(0))
    else:
        rows = np.arange(len(ids))
    exact = q @ unit[rows].T
    exact[none[:, rows]] = -np.inf
    least = np.partition(exact, -k, axis=1)[:, -k] if len(rows) > k else np.full(len(q), -np.inf)
    who, at = np.nonzero((exact >= (least - 8 * (x.shape[1] + 8) * 2.0**-52)[:, None]) & (exact > -np.inf))
    at = rows[at]
    cosine = np.zeros(len(at))
    step = max(1, (1 << 21) // x.shape[1])
    for lo in range(0, len(at), step):  # in the order of the vectors' numbers, as a plain sum has it
        left, right, sums = x[at[lo : lo + step]], y[who[lo : lo + step]], cosine[lo : lo + step]
        for j in range(x.shape[1]):
            sums += left[:, j] * right[:, j]
    cosine /= length[at] * asked_length[who]
    order = np.lexsort((ids[at], -cosine, who))
    who, at, cosine = who[order], at[order], cosine[order]
    kept = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[kept], at[kept], cosine[kept]


def _packed(df: DataFrame, size: int, total: int, name: str) -> DataFrame:
    """Adds a block number: rows are dealt by a hash of vec_id into blocks of about `size`."""
    return df.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-total // size)))).cast("int"))


def search(rows: DataFrame, queries: DataFrame, k: int, depth: int = DEPTH, block: int = BLOCK, query_block: int = QUERIES, sample: int = SAMPLE) -> DataFrame:
    """rows, queries (vec_id, embedding) -> query_id, rank, vec_id, score: the k nearest of each query."""
    spark = rows.sparkSession
    base = materialize(usable(rows), "ann-rows").withColumn("width", F.size("v"))
    asked = materialize(usable(queries), "ann-queries").withColumn("width", F.size("v"))
    (n, numbers), (m, asked_numbers) = (df.agg(F.count("*"), F.sum("width")).first() for df in (base, asked))
    if not n or not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = min(sample, max(CENTRES, SAMPLE_NUMBERS * n // numbers))
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) <= min(1.0, 2 * sample / n + 1e-4) * (1 << 40)
    drawn = base.where(share).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()["v"].combine_chunks()
    books = {}
    for width, count in zip(*np.unique(sizes := pc.list_value_length(drawn).to_numpy(), return_counts=True)):
        if count >= CENTRES or len(drawn) == n == count:
            x = pc.list_flatten(drawn.filter(sizes == width)).to_numpy().reshape(-1, width)
            books[int(width)] = train(x / np.linalg.norm(x, axis=1, keepdims=True))
    sent = spark.sparkContext.broadcast(books)  # STAGES x CENTRES vectors for each length
    block, query_block = (max(1, min(size, BLOCK_NUMBERS * rows_ // total)) for size, rows_, total in ((block, n, numbers), (query_block, m, asked_numbers)))
    single = isinstance(rows.schema["embedding"].dataType.elementType, FloatType)

    def own(width: int) -> np.ndarray:
        return sent.value.get(width, np.zeros((0, 1, width), np.float32))

    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            for width, of in part.groupby("width"):
                step = max(1, min(4096, (1 << 18) // width))
                for lo in range(0, len(of), step):
                    p = of.iloc[lo : lo + step]
                    v = np.stack(p["v"].to_numpy())
                    unit, books = v / p["length"].to_numpy()[:, None], own(width)
                    codes = encode(unit, books)[0]
                    norms, angle = angles(unit, books, codes)
                    vectors = v.astype("<f4" if single else "<f8")
                    yield pd.DataFrame({"width": width, "block": p["block"], "vec_id": p["vec_id"], "length": p["length"], "code": [c.tobytes() for c in codes], "norm": norms, "angle": angle, "vector": [x.tobytes() for x in vectors]})

    codes = _packed(base, block, n, "block").mapInPandas(pack, "width int, block int, vec_id long, length double, code binary, norm double, angle double, vector binary")
    q_blocks, c_blocks = max(1, -(-m // query_block)), max(1, -(-n // block))
    tiles_q = _packed(asked, query_block, m, "qb").select("width", "qb", F.col("vec_id").alias("query_id"), "v", "length", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("block"))
    codes = materialize(codes, "ann-codes").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def tile(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(left) and len(right):
            books = own(int(key[0]))
            right = right.sort_values("vec_id", kind="stable")
            right = right[right.groupby("vector").cumcount() <= k]  # of equal vectors no query takes more, its own left out
            ids, length = right["vec_id"].to_numpy(), right["length"].to_numpy()
            x = np.frombuffer(b"".join(right["vector"]), "<f4" if single else "<f8").reshape(len(right), -1).astype(float)
            code = np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1), right["norm"].to_numpy(), right["angle"].to_numpy()
            for lo in range(0, len(left), ASKED):
                part = left.iloc[lo : lo + ASKED]
                qid = part["query_id"].to_numpy()
                who, at, cosine = nearest(ids, x, length, code, qid, np.stack(part["v"].to_numpy()), part["length"].to_numpy(), books, k, depth)
                found.append(pd.DataFrame({"query_id": qid[who], "vec_id": ids[at], "score": cosine}))
        return pd.concat(found)

    keys = ("width", "qb", "block")
    near = tiles_q.groupBy(*keys).cogroup(codes.groupBy(*keys)).applyInPandas(tile, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
