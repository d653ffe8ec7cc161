"""What the operators share: reading, scratch space, batches and word arrays.

The word arrays are built with numpy over the raw UTF-8 bytes of many texts at
once.  No Python object is made for a word, so a pass over a corpus costs some
tens of nanoseconds a byte.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: Bytes of a batch between Spark and Python; the default of 64 MB costs several times that on both sides.
BATCH_BYTES = 8 << 20

#: Word separators: blank, and tab to carriage return.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that start a code point.
_LEAD = (np.arange(256) & 0xC0) != 0x80

_MASK = (1 << 64) - 1


def _splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


_BYTE_CODE = np.array([_splitmix(i + 1) for i in range(256)], dtype=np.uint64)
_BASE = 0x2545F4914F6CDD1D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_K1, _K2, _K3 = (np.uint64(_splitmix(i) | 1) for i in (1001, 1002, 1003))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, STEP_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the path is opened by Spark's reader alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same rows, handed to Python in batches of ``BATCH_BYTES``.

    Spark has no such setting for one plan.  The session's is set if the caller
    has not set it; one that the caller has chosen stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return df


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``.

    Only where that is unset and the master is local it is set to a local folder.
    """
    root = checkpoint_root(spark)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder, which is also made known to ``checkpoint()``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ridgeflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(root)
    return root


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let the driver collect garbage, so that Spark deletes the shuffle files of jobs that are done.

    Spark does so whenever the driver happens to collect, by default within half
    an hour; between the steps of a long operator that is late.
    """
    spark.sparkContext._jvm.System.gc()


def has_files(spark: SparkSession, path: str, pattern: str = "*") -> bool:
    """Whether a file below ``path`` matches."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}")
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where))


def hash_share(key: Column, share: Column | float) -> Column:
    """Whether a 64-bit hash lies in the lowest share of its range."""
    return F.shiftrightunsigned(key, 11) < (share if isinstance(share, Column) else F.lit(share)) * float(1 << 53)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in order, in pieces of at most ``limit`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(lengths(batch.column(batch.schema.get_field_index(column))))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n + 1 offsets into them; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lengths(texts: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text; null counts 0."""
    return np.diff(raw(texts)[1])


class Words:
    """All words of some texts: byte spans, text numbers and 64-bit hashes.

    A word is a maximal run of bytes other than blank and U+0009 to U+000D; no
    word crosses from one text to the next.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, self.offsets = raw(texts)
        n = len(self.data)
        self.n_texts = len(texts)
        inside = ~_SPACE[self.data]
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        first = self.offsets[:-1]
        before[first[first < n]] = False
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        last = self.offsets[1:] - 1
        after[last[last >= 0]] = False
        self.inside = inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first_word = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first_word)
        self.text_of = np.repeat(np.arange(self.n_texts), self.counts)
        self._lower = lower

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Position-independent 64-bit hashes of byte spans."""
        up, down = _powers(len(self.data) + 1)
        codes = _BYTE_CODE[_LOWER[self.data] if self._lower else self.data]
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(codes * up[:-1], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends)

    def windows(self, hashes: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of ``width`` words within a text."""
        if len(hashes) < width:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.text_of[width - 1 :] == self.text_of[: len(hashes) - width + 1])
        keys = hashes[at]
        for j in range(1, width, 2):
            keys = keys * _K1 + mix(hashes[at + j] * _K2)
            if j + 1 < width:
                keys += hashes[at + j + 1] * _K3
            keys = mix(keys)
        return at, keys

    def code_points(self, flags: np.ndarray) -> np.ndarray:
        """For each text the number of code points whose first byte is flagged."""
        total = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(flags & _LEAD[self.data], out=total[1:])
        return np.diff(total[self.offsets])


def per_text(text_of: np.ndarray, n_texts: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sums by text number, as 64-bit integers."""
    return np.bincount(text_of, weights=weights, minlength=n_texts).astype(np.int64)
