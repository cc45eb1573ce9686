"""Shared helpers: input tables, the shared work folder, written tables and
vectorised word hashing."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes in one Arrow batch handed to Python. Texts can be long, so the
#: default of 10,000 rows would make batches of a gigabyte.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches, unless the session already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("bB"))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def release() -> None:
    """Give memory that isn't used any more back to the system. Workers live on
    after a task; what they keep would add up over the stages of a job."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such function in this C library
        pass


def releasing(f: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function over the batches of a task that releases memory when it ends."""

    @functools.wraps(f)
    def run(*args):
        try:
            yield from f(*args)
        finally:
            release()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (as in tests) may do without; a folder is made for it."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pagewright-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


class Scratch:
    """Tables of one run in the shared folder; they cut lineage and outlive a
    lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables no later step reads."""
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def sweep(self) -> None:
        """Let go of the shuffle files of tables already written. Spark deletes them
        when the driver collects their plans, by itself every half hour."""
        self.spark._jvm.System.gc()


# --- vectorised hashing -----------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)

#: str.translate table of A-Z to lower case, for bytes.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place on a uint64 array."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def _power_table(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), _BASE if which == "up" else _INV, dtype=np.uint64)
        step[0] = 1
        have = _powers[which] = np.multiply.accumulate(step)
    return have


#: Bytes hashed at once; longer texts, and longer words too, go piece by piece so
#: that memory stays bounded.
PIECE = 1 << 18
_ANY_SPACE = re.compile(rb"[\t-\r ]")


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of ``data`` in order; words are what white
    space (bytes 9 to 13 and 32) leaves."""
    out, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + PIECE)
        if end < n and not _SPACE[data[end]]:  # never cut a word
            cut = max(data.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < at:
                m = _ANY_SPACE.search(data, end)
                end = m.start() if m else n
                out.append(_hash_long(data, at, end))
                at = end
                continue
            end = cut + 1
        out.append(_hash_piece(data[at:end]))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _hash_long(data: bytes, start: int, end: int) -> np.ndarray:
    """The hash of one word that is longer than a piece."""
    total = 0
    for at in range(start, end, PIECE):
        raw = np.frombuffer(data, np.uint8, min(PIECE, end - at), at)
        part = int((_LETTER[raw] * _power_table("up", PIECE)[: len(raw)]).sum())
        total += part * pow(_BASE, at - start, 1 << 64)
    h = np.array([total % (1 << 64)], np.uint64)
    h += np.array([end - start], np.uint64) * _MULT
    return mix(h)


def _hash_piece(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_LETTER[raw] * _power_table("up", len(raw))[: len(raw)], out=sums[1:])
    h = (sums[end] - sums[start]) * _power_table("down", len(raw))[start]
    h += (end - start).astype(np.uint64) * _MULT
    return mix(h)


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of runs of ``width`` words; with fewer words, the whole sequence as one."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    acc = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        acc *= np.uint64(_BASE)
        acc += words[k : k + n]
    acc += np.uint64(width)
    return mix(acc)


def text_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
