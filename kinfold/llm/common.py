"""What the operators share: Arrow column maps, checkpoints, hashing of sequences."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Base of the rolling hashes (odd, so that it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: Column | str, modulus: int) -> Column:
    """crc32 of an id as text, modulo a fold count."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % modulus


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """All of df if it has at most ``rows`` rows, else about that many, chosen by the hash of key where they are.

    No row is sorted or sent to be chosen, however many there are.  Should one key be
    so common that over twice as many come together, those are thinned out by lot.
    """
    n = df.count()
    if n <= rows:
        return df
    some = df.where(F.shiftrightunsigned(F.xxhash64(key, F.lit("sample")), 2) < int(rows / n * (1 << 62)))
    m = some.count()
    return some if m <= 2 * rows else some.where(F.rand(7) < rows / m)


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; one is set here only where none is named and all tasks run on this machine, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="kinfold-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df in the shared checkpoint folder, its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def slices(batches: Iterator[pa.RecordBatch], rows: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most ``rows`` rows and, but for single longer rows, about ``most`` bytes of text."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
                size += pc.binary_length(column).fill_null(0).to_numpy()
        total, lo = np.cumsum(size), 0
        while lo < batch.num_rows:
            before = total[lo - 1] if lo else 0
            hi = max(lo + 1, min(lo + rows, int(np.searchsorted(total, before + most, side="right"))))
            yield batch.slice(lo, hi - lo)
            lo = hi


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column without nulls, one after the other, and where each starts, with the end at last."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    starts = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, starts - starts[0]


def arrow_columns(
    df: DataFrame,
    inputs: list[str],
    outputs: T.StructType,
    make: Callable[[], Callable[..., list]],
    keep: list[str] | None = None,
    rows: int = 2000,
) -> DataFrame:
    """df's columns plus those that make()(*input arrays) returns for each slice of at most ``rows`` rows and about 4 MB of text.

    make is called once a task, so that caches and models live as long as the task does.
    """
    made = {f.name for f in outputs}
    kept = [c for c in (df.columns if keep is None else keep) if c not in made]
    more = [c for c in inputs if c not in kept]
    wide = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(f"__in_{i}") for i, c in enumerate(more)])
    schema = T.StructType([wide.schema[c] for c in kept] + list(outputs))
    where = [kept.index(c) if c in kept else len(kept) + more.index(c) for c in inputs]
    n_kept, out_types = len(kept), [(f.name, _arrow_type(f.dataType)) for f in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for part in slices(batches, rows):
            fn = fn or make()
            arrays = fn(*[part.column(i) for i in where])
            arrays = [a if isinstance(a, pa.Array) else pa.array(a, type=t) for a, (_, t) in zip(arrays, out_types, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n_kept)] + arrays, names=kept + [n for n, _ in out_types])

    return wide.mapInArrow(run, schema)


def _arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow_type(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in t])
    return {
        T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.FloatType: pa.float32(),
        T.StringType: pa.string(), T.BinaryType: pa.binary(), T.BooleanType: pa.bool_(),
    }[type(t)]


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen before; bounded, as the cache starts anew when full."""

    def __init__(self, bound: int = 200_000):
        self.bound = bound

    def __missing__(self, word) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(x: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``length`` consecutive items of x (uint64), by doubling."""
    n = len(x) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, size = x, 1  # hashes of runs of ``size`` items
    out, done = None, 0
    while True:
        if length & size:
            if out is None:
                out = power[:].copy()
            else:
                scale = np.uint64(pow(BASE, size, 1 << 64))
                m = min(len(out), len(power) - done)
                out = out[:m] * scale + power[done : done + m]
            done += size
        if done == length:
            return mix(out[:n])
        power = power[: len(power) - size] * np.uint64(pow(BASE, size, 1 << 64)) + power[size:]
        size *= 2


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
