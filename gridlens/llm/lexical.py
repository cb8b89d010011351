"""Ranked lexical search over a two-level quantised index: bytes that bound every impact from above, then exact integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import find_words, hash_words, slices, stage_table, table, text_bytes, text_or_empty

#: Bytes inside a term: digits, letters, and all of characters beyond ASCII.
TERM = np.zeros(256, bool)
TERM[0x30:0x3A] = TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True
#: An exact impact is at most a million; a byte counts steps of it, rounded up.
STEP = 3922
#: A part of the index: so many bytes of text and documents at most, but for one longer text. Places in it fit 16 bits.
PART_BYTES, PART_DOCS = 16 << 20, 16_384
#: Bytes of text worked through at once, and items whose bounds are summed side by side.
SLICE_BYTES, BLOCK_ITEMS = 1 << 20, 128

INDEX = "part long, term long, df int, docs binary, impacts binary, tfs binary, ids array<long>, lengths array<long>"


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of some texts, and for each text the index of its first (texts + 1)."""
    data, offsets = text_bytes(column)
    starts, ends, firsts = find_words(data, offsets, TERM)
    return hash_words(data, starts, ends).view(np.int64), firsts


def counted(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents that hold a term, and terms of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for part in slices(batch, 0, SLICE_BYTES):
                data, offsets = text_bytes(part.column(0))
                own = np.diff(find_words(data, offsets, TERM)[2])
                n, total = n + int((own > 0).sum()), total + int(own.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "l"])

    found = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return found[0] or 0, found[1] or 0


def impacts(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    m = 50 + 50 * length * n // total
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def build(docs: DataFrame, n: int, total: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, written to the shared folder: for each part a row with ids and lengths of its documents (term null), and for
    each of its terms the places of the documents that hold it, a byte for each impact, and exact counts.

    Searches read places and bytes; counts, a column of their own, are read for the rows that come near. A term is known by 64
    bits of hash: among a billion terms, a million of them asked for, 5e-5 collisions are to be expected.
    """

    def rows(part: int, ids: list, lengths: np.ndarray, h: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int64()), ("term", pa.int64()), ("df", pa.int32()), ("docs", pa.binary()), ("impacts", pa.binary()), ("tfs", pa.binary()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
        head = {"part": [part], "term": [None], "df": [None], "docs": [None], "impacts": [None], "tfs": [None], "ids": [ids], "lengths": [lengths]}
        yield pa.RecordBatch.from_pydict(head, schema=schema)
        if not len(h):
            return
        order = np.argsort(h, kind="stable")
        h, doc, tf = h[order], doc[order], tf[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(h) != 0]))
        bounds = np.append(first, len(h))
        byte = -(-impacts(tf, lengths[doc], n, total) // STEP)

        def lists(values: np.ndarray) -> pa.Array:
            offsets = pa.py_buffer((bounds * values.itemsize).astype(np.int32))
            return pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(values)])

        whole = pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(first), part)), pa.array(h[first]), pa.array(np.diff(bounds).astype(np.int32)), lists(doc.astype("<u2")), lists(byte.astype(np.uint8)),
                lists(tf.astype("<u4")), pa.nulls(len(first), pa.list_(pa.int64())), pa.nulls(len(first), pa.list_(pa.int64())),
            ],
            schema=schema,
        )
        for at in range(0, len(first), 16_384):
            yield whole.slice(at, 16_384)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = TaskContext.get().partitionId() << 32, 0
        ids, lengths, held = [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            h, doc, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from rows(part, ids, np.concatenate(lengths), h, doc, tf)

        for batch in batches:
            for many in slices(batch, 1, SLICE_BYTES):
                for at in range(0, many.num_rows, PART_DOCS):
                    piece = many.slice(at, PART_DOCS)
                    bytes_here = piece.column(1).nbytes
                    if ids and (size + bytes_here > PART_BYTES or len(ids) + piece.num_rows > PART_DOCS):
                        yield from flush()
                        part, size, ids, lengths, held = part + 1, 0, [], [], []
                    h, firsts = terms_of(piece.column(1))
                    own = np.diff(firsts)
                    doc = np.repeat(np.arange(len(own)), own)
                    order = np.lexsort((doc, h))
                    h, doc = h[order], doc[order]
                    new = np.flatnonzero(np.concatenate([[True], (np.diff(h) != 0) | (np.diff(doc) != 0)])) if len(h) else np.zeros(0, np.int64)
                    held.append((h[new], doc[new] + len(ids), np.diff(np.append(new, len(h)))))
                    ids, size = ids + piece.column(0).to_pylist(), size + bytes_here
                    lengths.append(own.astype(np.int64))
        if ids:
            yield from flush()

    source = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return stage_table(source.mapInArrow(run, INDEX), "postings")


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term), each once; rows of one id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, firsts = terms_of(batch.column(1))
            item = np.repeat(batch.column(0).to_numpy(), np.diff(firsts))
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(h)], ["item_id", "term"])

    source = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, "item_id long, term long").distinct()


def weighted(index: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """(item_id, term, w) of the terms that some document holds and that weigh anything."""
    held = index.where("term is not null").join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return asked.join(held.select("term", w.alias("w")).where("w > 0"), "term").select("item_id", "term", "w")


def bounded(dealt: DataFrame, k: int) -> DataFrame:
    """(item_id, part, doc, upper, lower): of each part the documents whose upper bound reaches the kth lower bound so far.

    dealt(part, block, docs, impacts, w, items) comes sorted by part and block, so one part's lists for one block of items are
    held at a time. A task remembers the k best lower bounds of each item over all of its parts.
    """

    def score(rows: list[tuple], best: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        part = rows[0][0]
        items = np.unique(np.concatenate([r[4] for r in rows]))
        docs = [np.frombuffer(r[1], "<u2").astype(np.int64) for r in rows]
        upper = np.zeros((len(items), 1 + max(int(d.max()) for d in docs)), np.int64)
        slack = np.zeros_like(upper)
        for (_, _, levels, w, own), d in zip(rows, docs, strict=True):
            q = np.frombuffer(levels, np.uint8).astype(np.int64)
            at = np.ix_(np.searchsorted(items, own), d)
            upper[at] += w * q
            slack[at] += w * (q > 0)
        for item, high, less in zip(items.tolist(), upper * STEP, slack * STEP, strict=True):
            own = best.setdefault(item, np.zeros(k, np.int64))
            at = np.flatnonzero(high >= max(1, own.min()))
            low = (high - less)[at]
            both = np.concatenate([own, low])
            best[item] = own = np.partition(both, len(both) - k)[len(both) - k :]
            keep = high[at] >= own.min()
            at, low = at[keep], low[keep]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), item)), pa.array(np.full(len(at), part)), pa.array(at.astype(np.int32)), pa.array(high[at]), pa.array(low)], ["item_id", "part", "doc", "upper", "lower"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[int, np.ndarray]] = {}
        key, rows = None, []
        for batch in batches:
            for part, block, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, block) != key:
                    if rows:
                        yield from score(rows, best.setdefault(key[1], {}))
                    key, rows = (part, block), []
                rows.append((part, *rest))
        if rows:
            yield from score(rows, best.setdefault(key[1], {}))

    return dealt.mapInArrow(run, "item_id long, part long, doc int, upper long, lower long")


def counts_of(index: DataFrame, wanted: DataFrame, terms: DataFrame) -> DataFrame:
    """(part, doc, term, tf) of the documents in wanted(part, places) and of terms(term), from the exact level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, term = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = []
            for i, (docs, tfs, places) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                _, at, _ = np.intersect1d(np.frombuffer(docs, "<u2"), np.array(places, "<u2"), True, True)
                if len(at):
                    out.append((np.full(len(at), i), np.frombuffer(docs, "<u2")[at].astype(np.int32), np.frombuffer(tfs, "<u4")[at].astype(np.int64)))
            if out:
                row, doc, tf = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(part[row]), pa.array(doc), pa.array(term[row]), pa.array(tf)], ["part", "doc", "term", "tf"])

    lists = index.where("term is not null").select("part", "term", "docs", "tfs").join(terms, "term").join(wanted, "part")
    return lists.select("part", "term", "docs", "tfs", "places").mapInArrow(run, "part long, doc int, term long, tf long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item, equal scores by ascending doc_id.

    Sums of upward-rounded bytes bound every score from above, and the same sums less a step for each term from below. Every
    document whose upper bound reaches the kth lower bound of an item is scored again in exact integers, ties included, so the
    result is that of scoring all. Every row of docs is a document: repeated rows take ranks of their own, a null id sorts last,
    a null or empty text holds no term. Rows of one item_id are one item, each term once; an item without an id or without a term
    that a document holds has no rows. Empty tables give an empty result. Other columns aren't read.
    """
    spark = docs.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    n, total = counted(docs, text_col)
    if not n:
        return spark.createDataFrame([], schema)
    index = build(docs, n, total, id_col, text_col)
    weights = stage_table(weighted(index, item_terms(items, item_col, item_text_col), n), "weights")
    blocks = -(-weights.select("item_id").distinct().count() // BLOCK_ITEMS)
    if not blocks:
        return spark.createDataFrame([], schema)
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block")
    asked = weights.groupBy("term", block).agg(F.first("w").alias("w"), F.collect_list("item_id").alias("items"))
    lists = index.where("term is not null").select("part", "term", "docs", "impacts").join(asked, "term")
    dealt = lists.select("part", "block", "docs", "impacts", "w", "items").repartition("part", "block").sortWithinPartitions("part", "block")
    near = stage_table(bounded(dealt, k), "bounds")
    by_item = Window.partitionBy("item_id").orderBy(F.desc("lower"))
    kth = near.select("item_id", "lower").withColumn("r", F.row_number().over(by_item)).where(F.col("r") <= k)
    cut = kth.groupBy("item_id").agg(F.when(F.count("*") == k, F.min("lower")).otherwise(0).alias("cut"))
    kept = stage_table(near.join(cut, "item_id").where("upper >= cut").select("item_id", "part", "doc"), "candidates")
    wanted = kept.select("part", "doc").distinct().groupBy("part").agg(F.array_sort(F.collect_list("doc")).alias("places"))
    exact = counts_of(index, wanted, weights.select("term").distinct())
    heads = index.where("term is null").select("part", "ids", "lengths").join(wanted, "part")
    heads = heads.select("part", F.explode("places").alias("doc"), "ids", "lengths")
    heads = heads.select("part", "doc", F.col("ids")[F.col("doc")].alias("doc_id"), (50 + F.expr(f"(50 * lengths[doc] * {n}L) div {total}L")).alias("m"))
    own = kept.join(weights, "item_id").join(exact, ["part", "doc", "term"]).join(heads, ["part", "doc"])
    part_score = F.expr("w * ((1000000000 * tf) div (1000 * tf + 20 * m))")
    scores = own.groupBy("item_id", "part", "doc").agg(F.first("doc_id").alias("doc_id"), F.sum(part_score).alias("score")).where("score > 0")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "part", "doc")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
lengths AS (SELECT r, doc_id, len(ts) AS n FROM words WHERE len(ts) > 0),
sums AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM lengths),
postings AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM words) GROUP BY r, term),
items AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE item_id IS NOT NULL)),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM postings, sums GROUP BY term, nn),
scores AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (r), sums
  GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 50
"""
