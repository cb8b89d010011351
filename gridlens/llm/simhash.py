"""SimHash near-duplicates found through a byte-position inverted index with count filtering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, fresh, stage_table, table, text_or_empty

BYTES = 8
SEED = 42
SPACE = re.compile(rb"[\x20\x09-\x0D]")


#: Distinct fingerprints from which posting lists are keyed by four positional bytes instead of three.
WIDE_FROM = 1 << 32


def key_positions(max_bits: int, wide: bool = False) -> list[tuple[int, ...]]:
    """Byte positions of each posting list of the inverted index.

    At most max_bits differing bits leave at least 8 - max_bits bytes equal: the guaranteed minimum. A list of one positional
    byte would hold 1/256 of all fingerprints, so the lists of several positions are met before they are read: for a minimum of
    four, twenty triples suffice for any four equal positions to contain a triple (Turan's construction on groups of 3, 3 and 2),
    and a list holds 1/2^24 of unrelated fingerprints. Wide: all seventy sets of four positions, with lists of 1/2^32.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("max_bits must be 0 to 4")
    if wide:
        return list(combinations(range(BYTES), 4))
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    keys = [g for g in groups if len(g) == 3]
    for k, g in enumerate(groups):
        keys += [(*pair, x) for pair in combinations(g, 2) for x in groups[(k + 1) % 3]]
    return [tuple(sorted(k)) for k in keys]


#: Bytes of a text that are cut into words at a time.
BLOCK = 1 << 20


def blocks_of(text: bytes) -> Iterator[bytes]:
    """The text in blocks of about BLOCK bytes that end where a word does."""
    at = 0
    while len(text) - at > BLOCK:
        tail = text[at : at + BLOCK].rsplit(None, 1)
        cut = at + len(tail[0]) if len(tail) == 2 else at + BLOCK
        if len(tail) != 2 and (end := SPACE.search(text, cut)):
            cut = end.start()
        elif len(tail) != 2:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def fingerprint(text: bytes, shingle: int) -> int:
    """The fingerprint of a text: zero without words. A long text is worked through in blocks."""
    ones, count, held = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for block in blocks_of(text):
        words = held + block.lower().split()
        if len(words) >= shingle:
            joined = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(size + 1) - 1
            starts = (ends - size)[: len(words) - shingle + 1].tolist()
            ends = ends[shingle - 1 :].tolist()
            h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), "<u8", len(starts))
            for at in range(0, len(h), 1 << 14):
                ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            count += len(h)
            held = words[len(words) - shingle + 1 :] if shingle > 1 else []
        else:
            held = words
    if not count and held:  # fewer words than a shingle: the whole sequence
        ones, count = np.unpackbits(np.array([digest(b" ".join(held), SEED)], "<u8").view(np.uint8), bitorder="little").astype(np.int64), 1
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp long) for each row. A-Z are lower-cased; words are runs without space, tab, line feeds; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = [fingerprint(t.as_py(), shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of one posting list: same components as all its linked pairs, but fewer than its rows."""
    rest, heads, tails = np.arange(1, len(fps)), [], []
    queue = [0]
    while queue and len(rest):
        node = queue.pop()
        x = fps[rest] ^ fps[node]
        shared = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)
        kept = np.flatnonzero(shared >= BYTES - max_bits)
        hit = kept[np.bitwise_count(x[kept]) <= max_bits]
        if len(hit):
            found = rest[hit]
            heads.append(np.full(len(found), node))
            tails.append(found)
            queue.extend(found.tolist())
            rest = np.delete(rest, hit)
        if not queue and len(rest):
            queue, rest = [int(rest[0])], rest[1:]
    if not heads:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(heads), np.concatenate(tails)


def links(distinct: DataFrame, max_bits: int = 4, block: int = 2048, wide: bool = False) -> DataFrame:
    """Edges (a, b) between distinct fingerprints with the components of all pairs at most max_bits apart.

    A list of more than block rows is dealt into blocks and each pair of blocks is one group, so no task holds more than about
    two blocks of a list and no pair is lost. Within a group, shared positional bytes are tallied, pairs below the guaranteed
    minimum fall away, the rest are verified by bit count, and only a spanning forest is emitted.
    """
    masks = [sum(0xFF << (8 * p) for p in key) for key in key_positions(max_bits, wide)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)]
    index = distinct.select("fp", F.explode(F.array(*keys)).alias("k"))
    sizes = index.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    dealt = index.join(sizes, "k").withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    dealt = dealt.withColumn("mine", mine).select(
        "k", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    )
    dealt = dealt.select(
        F.xxhash64("k", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"), "fp"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_g, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def done(g: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.diff(g)) + 1
            bounds = np.concatenate([[0], cut, [len(g)]]) if len(g) else np.zeros(1, np.int64)
            size = np.diff(bounds)
            a, b = [], []
            pairs = bounds[:-1][size == 2]
            x = f[pairs] ^ f[pairs + 1]
            near = pairs[((x.view(np.uint8).reshape(-1, BYTES) == 0).sum(1) >= BYTES - max_bits) & (np.bitwise_count(x.view(np.uint64)) <= max_bits)] if len(pairs) else pairs
            a.append(f[near])
            b.append(f[near + 1])
            for k in np.flatnonzero(size > 2):
                own = f[bounds[k] : bounds[k + 1]].view(np.uint64)
                i, j = forest(own, max_bits)
                a.append(own[i].view(np.int64))
                b.append(own[j].view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        for batch in batches:
            g = np.concatenate([held_g, batch.column(0).to_numpy()])
            f = np.concatenate([held_f, batch.column(1).to_numpy()])
            if not len(g):
                continue
            to = int(np.searchsorted(g, g[-1]))
            if to:
                yield done(g[:to], f[:to])
            held_g, held_f = g[to:], f[to:]
        if len(held_g):
            yield done(held_g, held_f)

    found = dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")
    return found.distinct()


def roots(marks: DataFrame, max_bits: int, wide_from: int = WIDE_FROM) -> DataFrame:
    """(fp, root) of the fingerprints of marks(fp) that some other one is linked to."""
    distinct = marks.select("fp").distinct()
    found = stage_table(links(distinct, max_bits, wide=distinct.count() >= wide_from), "links")
    return connected_components(found).select(F.col("node").alias("fp"), "root")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id (least doc_id reachable).

    Copies meet first: rows of one fingerprint are counted as one, so a group of copies of any size is one row of the index.
    Nulls: a null text is empty (fingerprint zero, linked like any other); a null doc_id keeps its row and is never a
    component_id unless its whole component has none. Repeated rows stay. An empty table gives an empty result. Extra columns
    are not read, so clashing names do no harm.
    """
    marks = stage_table(fingerprints(docs, id_col, text_col, shingle), "simhash")
    heads = marks.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = heads.join(roots(marks, max_bits), "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("linked_id"))
    linked = linked.join(least, "root").select("fp", "linked_id")
    named = heads.join(linked, "fp", "left").select("fp", F.coalesce("linked_id", "least").alias("component_id"))
    return marks.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of each component stays, all columns as they are, whatever their names: the one with the least id.

    Each row is looked at by itself, so rows that share an id but not a component don't give way to each other; of those with
    the least id of one component the first in the table stays. A row without an id stays only where no row of its component has
    one, and then one does. A null text is empty. An empty table gives an empty result. Rows are staged with their fingerprints,
    and texts meet the rows that stay in one join on a number that no two rows share.
    """
    row, fp, text = fresh(docs, "row", "fp", "own_text")
    source = docs.withColumns({text: text_or_empty(text_col), fp: F.lit(0).cast("long")})
    at = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(at).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(np.array(fps, np.uint64).view(np.int64))], [*batch.schema.names[:at], fp])

    held = stage_table(source.mapInArrow(run, source.drop(text).schema).withColumn(row, F.monotonically_increasing_id()), "simhash")
    marks = held.select(F.col(id_col).cast("long").alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    heads = marks.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    first = heads.join(roots(marks, max_bits), "fp", "left").groupBy(F.coalesce("root", "fp")).agg(F.min("first").alias("first"))
    return held.join(first.select(F.col("first.row").alias(row)), row, "left_semi").select(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
