"""Shared pieces of the corpus operators: shared storage and vectorised tokens."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; longer texts are a step of their own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode a temporary one where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="noticeflow-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared storage; one that isn't there is no error."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Open blocks of ``scratch``, innermost last: what they delete, and whether kept tables are among it.
_blocks: list[tuple[list[str], bool]] = []
_kept: list[str] = []


@contextmanager
def scratch(spark: SparkSession, everything: bool = False):
    """Delete the tables that were staged inside when the block ends, kept ones only if ``everything``."""
    _blocks.append(([], everything))
    try:
        yield
    finally:
        for path in _blocks.pop()[0]:
            delete(spark, path)
        spark.sparkContext._jvm.System.gc()  # Spark removes the shuffle files of plans that are gone


def forget_later(path: str, keep: bool = True) -> None:
    """Delete ``path`` with the innermost block; kept ones with the innermost that deletes everything, or when Python ends."""
    for paths, everything in reversed(_blocks):
        if everything or not keep:
            paths.append(path)
            return
    _kept.append(path)


@atexit.register
def _forget_kept() -> None:
    spark = SparkSession.getActiveSession() if _kept else None
    if spark is not None:
        for path in _kept:
            try:
                delete(spark, path)
            except Exception:  # the JVM may be gone by now; its files stay
                return


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts lineage and lets several later jobs read one result; the files
    survive lost executors.  ``keep``: the caller's result reads them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    forget_later(path, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that are joined by salts: at most so many, as each holds more than this share of the rows.
HOT_KEYS, HOT_LEAST = 10_000, 500


def hot_keys(counts: DataFrame, key: list[str], n: str = "n") -> DataFrame:
    """key, salts: the keys that hold so many rows that a join should spread them, small enough to broadcast.

    counts: one row for each key.  A hot key holds more than ``HOT_LEAST`` rows
    and more than one in ``HOT_KEYS`` of all, so there are fewer than ``HOT_KEYS``,
    and no other key brings a task more than this share.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    size = max(HOT_LEAST, -(-total // HOT_KEYS))
    return counts.filter(F.col(n) > size).select(*key, F.ceil(F.col(n) / size).cast("int").alias("salts"))


def salted_join(many: DataFrame, one: DataFrame, key: list[str], hot: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``; rows of hot keys of ``many`` are dealt by the hash ``spread`` over copies of ``one``'s rows."""
    salt = lambda x: x.join(F.broadcast(hot), key, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    left = salt(many).withColumn("salt", F.pmod(spread, F.col("salts")).cast("int")).drop("salts")
    right = salt(one).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return left.join(right, [*key, "salt"], how).drop("salt")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Batches of at most ``rows`` rows for the Python functions of the jobs that run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def byte_class(inside) -> np.ndarray:
    """A 256-entry mask of the bytes for which ``inside`` holds."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Bytes of a word [^\x20\x09-\x0D]+; multi-byte characters have no such byte.
PLAIN_WORD = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Bytes of a word of digits, letters and characters from U+0080 on.
ALNUM_WORD = byte_class(lambda b: b >= 0x80 or chr(b).isalnum())
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_P = int(_RNG.integers(0, 2**62)) * 4 + 3
_P_INV = pow(_P, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 2 * STEP_BYTES:  # a very long text's table isn't kept
            _powers[base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, alike for equal bytes wherever they stand; spans in order, none within another."""
    if len(data) > 2 * STEP_BYTES and len(starts) > 1:  # a very long text by parts of its spans
        cut = np.unique(np.searchsorted(starts, np.arange(0, len(data), STEP_BYTES)))
        parts = [(b, e) for b, e in zip(cut, [*cut[1:], len(starts)], strict=True) if b < e]
        return np.concatenate([_hash_spans(data[starts[b] : ends[e - 1]], starts[b:e] - starts[b], ends[b:e] - starts[b]) for b, e in parts])
    return _hash_spans(data, starts, ends)


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power_table(_P, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power_table(_P_INV, n + 1)[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def text_steps(texts: pa.Array | pa.ChunkedArray, step_bytes: int = STEP_BYTES):
    """Yield (first row, bytes, offsets) for consecutive rows; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + step_bytes, "right")) - 1)
        end = min(end, n)
        yield row, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray):
    """Lower-cased bytes, and starts, ends and rows of the words in them."""
    low = LOWER[data]
    if not len(low):
        none = np.zeros(0, np.int64)
        return low, none, none, none
    is_word = inside[low]
    begins = offs[:-1][offs[:-1] < offs[1:]]
    before = np.empty(len(low), bool)
    before[0] = False
    before[1:] = is_word[:-1]
    before[begins] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.empty(len(low), bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    after[begins[1:] - 1] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    return low, starts, ends, np.searchsorted(offs, starts, "right") - 1
