"""Helpers that the operators of this subpackage share: hashing, cut points, batches of bytes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

U64 = np.uint64
_C1, _C2, _S1, _S2, _S3 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(30), U64(27), U64(31)

# A random odd base and one random value a byte, from a fixed seed: equal on every worker.
_RNG = np.random.default_rng(20240607)
BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values: equal in, equal out, and all bits are well spread."""
    x = x ^ (x >> _S1)
    x = x * _C1
    x = x ^ (x >> _S2)
    x = x * _C2
    return x ^ (x >> _S3)


_LOW = 16  # powers of the base are products of one below 2**_LOW and one of its multiples: small tables for any length


def _powers(base: int, n: int) -> np.ndarray:
    p = np.ones(n, np.uint64)
    p[1:] = U64(base)
    return np.multiply.accumulate(p)


_INVERSE = pow(_BASE, -1, 2**64)
_UP, _DOWN = (_powers(b, 1 << _LOW) for b in (_BASE, _INVERSE))


class Spans:
    """64-bit hashes of spans of one byte array, from one prefix sum: equal bytes, equal hash, wherever they lie."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        high = -(-n // (1 << _LOW)) + 1
        self.up, self.down = (_powers(pow(b, 1 << _LOW, 2**64), high) for b in (_BASE, _INVERSE))
        self.total = np.empty(n + 1, np.uint64)
        self.total[0] = 0
        part = BYTE[data]
        for k in range(high - 1):
            at = part[k << _LOW : (k + 1) << _LOW]
            at *= _UP[: len(at)]
            if k:
                at *= self.up[k]
        np.cumsum(part, out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        shift = _DOWN[start & ((1 << _LOW) - 1)]
        if len(self.down) > 2:
            shift *= self.down[start >> _LOW]
        return mix64((self.total[end] - self.total[start]) * shift + (end - start).astype(np.uint64))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans of one byte array."""
    return Spans(data)(start, end)


class Recent:
    """Names (signed longs) that came by lately, in a table of fixed size: leaves out most repeats, and never a first one."""

    def __init__(self, bits: int = 17):
        self.bits = bits
        self.table = np.zeros(1 << bits, np.int64)
        self.table[0] = 1  # the name 0 would lie here

    def first(self, names: np.ndarray) -> np.ndarray:
        """Places of names that are not known to have come before, each once, ascending."""
        _, at = np.unique(names, return_index=True)
        at = np.sort(at)
        slot = (names[at].view(np.uint64) >> U64(64 - self.bits)).astype(np.int64)
        new = self.table[slot] != names[at]
        self.table[slot] = names[at]
        return at[new]


#: 1 for A-Z lower-cased and every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space."""
    mark = np.empty(len(data) + 2, bool)
    mark[0] = mark[-1] = True
    mark[1:-1] = _SPACE[data]
    edge = np.flatnonzero(mark[1:] != mark[:-1])
    return edge[0::2], edge[1::2]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what the session was given by setCheckpointDir.

    One of our own is made only where none is set and everything runs in one process's machine, as in tests.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        given = sc.getConf().get("spark.checkpoint.dir")
        if not given and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table of scratch() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files that no DataFrame needs any more, as after a cut of what made them.

    Py4J tells the JVM of what Python has let go in a thread of its own, which is waited for, a few seconds at most.
    """
    gc.collect()
    told = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    end = time.monotonic() + 5
    while told and time.monotonic() < end:
        time.sleep(0.05)
    time.sleep(0.05)  # the last one taken from the queue may still be under way
    spark.sparkContext._jvm.System.gc()


_BATCH_KEY, _DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 1 << 20


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, owner: str = "") -> DataFrame:
    """df.mapInArrow(f, schema) with input batches of about BATCH bytes, and workers that give memory back after each task.

    The session's own setting of the batches' bytes stays, where there is one.  owner: the module whose kept things a
    worker goes on keeping, f's own if not given.
    """
    spark = df.sparkSession
    if spark.conf.get(_BATCH_KEY) == _DEFAULT:
        spark.conf.set(_BATCH_KEY, str(BATCH))
    owner = owner or f.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            forget(owner)
            yield from f(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


#: What this worker keeps from task to task, such as a table of encoded words, and the module whose tasks use it.
_KEPT: dict[object, object] = {}
_OWNER = ""


def kept(key: object, make: Callable[[], object]) -> object:
    """The worker's one large thing, made once and kept for the next tasks of the same module."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget(owner: str) -> None:
    """As a task of the module `owner` begins: let go what tasks of another one have kept, which would lie beside all that this one holds."""
    global _OWNER
    if owner != _OWNER:
        _KEPT.clear()
        _OWNER = owner


def give_back() -> None:
    """Return freed memory to the system: a worker that Spark keeps for its next task holds only what it needs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def carried(docs: DataFrame) -> DataFrame:
    """docs under the names c0, c1, ..., so that no name of a column can clash with one of ours."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def add_columns(docs: DataFrame, text_col: str, f: Callable[[Iterator[list[bytes | None]]], Iterator[list[pa.Array]]], added: list[StructField], keep: list[str] | None = None, most: int = BATCH) -> DataFrame:
    """The columns in keep (default: all) under the names c0, c1, ... by their places in docs, with those that f makes of each text.

    f goes through lists of texts as bytes and yields the new columns of each.  Every text moves once.
    """
    names = docs.columns
    at = [names.index(c) for c in keep] if keep is not None else list(range(len(names)))
    t = names.index(text_col)
    rows = carried(docs).select(*(f"c{i}" for i in at if i != t), f"c{t}")
    source = [f for f in rows.schema.fields if f.name != f"c{t}" or t in at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts() -> Iterator[list[bytes | None]]:
            for batch in small_batches(batches, f"c{t}", most):
                held.append(batch)
                yield raw(batch.column(batch.num_columns - 1))

        for made in f(texts()):
            batch = held.pop()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(source)], *made], names=[*(x.name for x in source), *(x.name for x in added)])

    return map_arrow(rows, run, StructType([*source, *added]), f.__module__)


def shown(df: DataFrame, names: list[str], added: list[str], keep: list[str] | None = None) -> DataFrame:
    """Columns c0, c1, ... under their names again, with added ones after them, which replace any with their names."""
    kept = [i for i, c in enumerate(names) if c not in added and (keep is None or c in keep)]
    return df.select(*(f"c{i}" for i in kept), *added).toDF(*(names[i] for i in kept), *added)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose string column has about `most` bytes (one longer text stays whole)."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(column))
        lens = np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64)
        at, total = 0, 0
        for i, n in enumerate(lens.tolist()):
            if total and total + n > most:
                yield b.slice(at, i - at)
                at, total = i, 0
            total += n
        yield b.slice(at)


def raw(col: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each text."""
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
