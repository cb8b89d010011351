"""Shared helpers: tables in the shared folder, Arrow text access, vectorised word hashing, connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and 0x09-0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Lower case for A-Z only; every other byte stays.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_written: list[str] = []
_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one only for a local session that has none."""
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="gridlens-")
    return _local_dir


#: Bytes of an Arrow batch at most. Ten thousand documents (Spark's other bound) would be tens of MB, held several times over.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Have Spark cut Arrow batches at BATCH_BYTES; a smaller bound of the session stands."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").lower().strip()
    size = int(now.rstrip("bkmg")) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now.rstrip("b")[-1:], 1)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged() -> int:
    """How many staged tables there are; a mark for drop_staged."""
    return len(_written)


def drop_staged(spark: SparkSession, since: int = 0, but_last: int = 0) -> int:
    """Delete the tables this process staged after the mark, but for the last few; call it once what read them is stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    going = _written[since : len(_written) - but_last]
    for name in going:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        _written.remove(name)
    return len(going)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans nothing refers to; else they stay until the driver happens to collect its
    garbage. Spark's listeners hold a plan for a moment after its end, so garbage is collected twice."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, column: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds at most max_bytes of the column's text, or a single row."""
    lengths = np.asarray(pc.binary_length(batch.column(column).fill_null("")).cast(pa.int64()))
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > max_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its row offsets (rows + 1); null counts as empty."""
    array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    buffers, n = array.buffers(), len(array)
    if n == 0 or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray | None = None, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the index of its first word (rows + 1). No word spans two rows.

    alone: the first bytes of three-byte characters that are each a word of their own, as in scripts without spaces.
    """
    inside = ~_SPACE[data] if is_word is None else is_word[data]
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if alone is not None:
        at = np.flatnonzero(alone[data])
        edge[at] = True
        edge[np.minimum(at + 3, n)] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_KEY = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased; equal words have equal hashes on every worker."""
    global _powers
    out = np.empty(len(starts), np.uint64)
    lengths = ends - starts
    total = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(total, total[at] + block, "right")) - 1)
        n = lengths[at:to]
        base = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(base, n)
        if len(_powers) <= (longest := int(n.max())):
            _powers = np.cumprod(np.full(max(256, 2 * longest), _STEP, np.uint64), dtype=np.uint64)
        chars = _LOWER[data[place + np.repeat(starts[at:to], n)]]
        out[at:to] = mix(np.add.reduceat(_BYTE_KEY[chars] * _powers[place], base) + n.astype(np.uint64))
        at = to
    return out


def hash_text(text: str) -> int:
    """hash_words for one word given as a string."""
    data = np.frombuffer(text.encode(), np.uint8)
    return int(hash_words(data, np.array([0]), np.array([len(data)]))[0])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b) of long; root is the least node of its component.

    Alternates a large-star and a small-star step (Kiveris et al. 2014) until the edges are stars. Every step is joins and
    combinable minima, so a node of any degree is split among tasks; each round is written to the shared folder.
    """
    mark = staged()
    now = stage_table(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc"
    )
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = stage_table(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "cc")
        drop_staged(now.sparkSession, mark, but_last=1)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
