"""Helpers shared by the training-data operators: reading tables, cutting lineage, words and digests."""

from __future__ import annotations

import gc
import hashlib
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII bytes that separate words once A-Z are lower-cased; every non-ASCII byte belongs to a word.
_LOWER_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
#: The same classes as a Java/RE2 regular expression, for text already lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ARROW_ROWS, ARROW_BYTES = 2_000, 16 << 20
#: Of the C library: large arrays go back to the system when they are freed, as workers live on from stage to stage.
ALLOCATION = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_ARENA_MAX": "2"}
#: What an operator keeps in a worker from task to task.
KEPT: dict = {}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ensure_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did, and keeps what they get at once small: whole
    texts may be long, and a batch is held on both sides."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    env = spark.sparkContext.environment
    for key, value in ALLOCATION.items():
        env.setdefault(key, value)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def make_room() -> None:
    """In a worker: lets go what another operator kept, as workers live on from stage to stage."""
    if KEPT:
        KEPT.clear()
        gc.collect()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    ensure_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); in local mode, as in
    tests, a temporary one if none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        own = spark.sparkContext.getCheckpointDir()
        if own is None:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="timberline-"))
            own = spark.sparkContext.getCheckpointDir()
        path = own
    return path.rstrip("/")


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Writes df to a new table in the shared folder and reads it back: the lineage is cut, and a lost
    executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/timberline/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, each with as many underscores behind it as keep it apart from all others."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, column: str) -> DataFrame:
    """df without a column of this name, in whatever case."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != column.lower()])


def small(batches_: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, so that only a few become Python objects at once."""
    for batch in batches_:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z: runs of 0-9, a-z and non-ASCII characters, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER_WORDS).split() if text else []


def sha_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def crc_of_id(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def crc_mod(column, modulus: int):
    """crc32(id as text) mod modulus as a Column; null stays null."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def batches(rows: Iterator[pa.RecordBatch], schema: pa.Schema, make) -> Iterator[pa.RecordBatch]:
    """Applies make(columns as a dict of Python lists) -> dict of lists to each batch."""
    for batch in small(rows):
        out = make(batch.to_pydict())
        yield pa.RecordBatch.from_pydict(out, schema=schema)
