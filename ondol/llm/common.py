"""Shared plumbing of the corpus operators: written tables, Arrow text buffers, byte-level words.

Words follow one rule everywhere: lower-case A-Z, then maximal runs of bytes outside
0x20 and 0x09-0x0D.  Word identity in the vectorised operators is a 64-bit hash; with V
distinct words the chance that any two of them share it is about V^2 / 2^65.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[list(SPACES)] = False
BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
BASE_INVERSE = pow(BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver see; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="ondol-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of Spark that has a default; it holds for executions inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_files_go(spark: SparkSession):
    """The shuffle files of executions inside go when each of them ends."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def write_out(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with shuffle_files_go(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def temporary(df: DataFrame, name: str) -> str:
    """A column name like the given one that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(id_col: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % k


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**i (or its inverse) modulo 2^64 for i < n."""
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), BASE_INVERSE if inverse else BASE, dtype=np.uint64)
        have[0] = 1
        _POWERS[inverse] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    y = x >> U(30)
    y ^= x
    y *= U(0xBF58476D1CE4E5B9)
    z = y >> U(27)
    y ^= z
    y *= U(0x94D049BB133111EB)
    np.right_shift(y, U(31), out=z)
    y ^= z
    return y


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Running polynomial of the bytes, so that any substring hashes in constant time."""
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    tail = out[1:]
    np.take(BYTE_VALUE, buf, out=tail)
    tail *= powers(len(buf))
    np.cumsum(tail, dtype=np.uint64, out=tail)
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of buf[start:end] for each pair."""
    return mixed((sums[ends] - sums[starts]) * powers(len(sums), True)[starts] + (ends - starts).astype(np.uint64))


def words_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """spans_hash of spans in ascending order, a block of bytes at a time, for the memory."""
    out = np.empty(len(starts), np.uint64)
    cut = np.searchsorted(starts, np.arange(0, len(buf) + block, block))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if a < b:
            lo, hi = starts[a], ends[b - 1]
            out[a:b] = spans_hash(prefix_sums(buf[lo:hi]), starts[a:b] - lo, ends[a:b] - lo)
    return out


def grams_hash(sums: np.ndarray, length: int) -> np.ndarray:
    """spans_hash of every substring of the length, in order."""
    x = sums[length:] - sums[:-length]
    x *= powers(len(x), True)
    x += U(length)
    return mixed(x)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n+1 offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batches, most_bytes: int = 2 << 20, text: str = "text"):
    """Slices of the batches whose texts hold about most_bytes; one long text is never split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        block = (np.cumsum(sizes) - sizes) // most_bytes
        cut = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [batch.num_rows]])
        for a, b in zip(cut[:-1], cut[1:]):
            yield batch.slice(int(a), int(b - a))


ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])  # for words without ASCII punctuation


def words_of(buf: np.ndarray, at: np.ndarray, letters: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, word starts, first word of each document and the end) of lower-cased texts."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    buf = LOWER[buf]
    word = letters[buf]
    inner = at[1:-1]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    cut = inner[inner < len(buf)]
    opens[cut] = word[cut]
    shuts = word.copy()
    shuts[:-1] &= ~word[1:]
    cut = inner[inner > 0] - 1
    shuts[cut] = word[cut]
    starts = np.flatnonzero(opens)
    return words_hash(buf, starts, np.flatnonzero(shuts) + 1), starts, np.searchsorted(starts, at)


class Lookup:
    """Positions of 64-bit hashes in a sorted array, by a table over their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        self.shift = U(64 - bits)
        self.first = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=np.uint64)[:-1] << self.shift)
        self.first = np.append(self.first, len(keys)).astype(np.int32)
        self.most = int(np.diff(self.first).max()) if len(keys) else 0

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each hash, or -1."""
        out = np.full(len(wanted), -1, dtype=np.int32)
        if not len(self.keys) or not len(wanted):
            return out
        lead = (wanted >> self.shift).astype(np.int64)
        here, stop = self.first[lead], self.first[lead + 1]
        last = len(self.keys) - 1
        for _ in range(self.most):
            hit = (here < stop) & (self.keys[np.minimum(here, last)] == wanted)
            out[hit] = here[hit]
            here = here + np.int32(1)
        return out
