"""Nearest neighbours by largest inner product from several shifted Hilbert orderings of projected vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage_table, table

#: Orderings, dimensions of a projection, bits a dimension.
CURVES, DIMENSIONS, BITS = 14, 6, 8
#: Rows of a stretch of an ordering at least; a query is held against its own stretch and one on either side.
STRETCH = 2048
#: Queries that are held against every vector, and the share of their neighbours that the stretches must meet.
PROBED, RECALL = 64, 0.95
#: Vectors that the projections and the cuts between stretches are fitted on, and cuts of an ordering that are quantiles of
#: these, at most; where a table needs more stretches, each piece between two cuts is parted evenly along the curve.
FIT_ROWS, CUTS = 50_000, 20_000
#: Queries that a stretch may meet in one group; a wider stretch is met by several groups of queries.
ASKING = 50_000


def hilbert_key(x: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer points (rows, dimensions) along a Hilbert curve (Skilling's transform, all rows at once)."""
    axes = [x[:, i].astype(np.uint64) for i in range(x.shape[1])]
    n, one = len(axes), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(n):
            hit = (axes[i] & bit) != 0
            swap = np.where(hit, np.uint64(0), (axes[0] ^ axes[i]) & low)
            axes[0] = axes[0] ^ np.where(hit, low, swap)
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, n):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        turn = turn ^ np.where((axes[n - 1] & bit) != 0, bit - one, np.uint64(0))
    key = np.zeros_like(turn)
    for level in range(bits - 1, -1, -1):
        for a in axes:
            key = (key << one) | (((a ^ turn) >> np.uint64(level)) & one)
    return key.astype(np.int64)


@dataclass
class Curves:
    """Projections, shifts and cuts of all orderings. Vectors are lifted to the unit sphere (of the largest norm), where the
    largest inner product is the nearest point; queries lie on its equator."""

    norm: float
    projection: np.ndarray
    low: np.ndarray
    scale: np.ndarray
    cuts: list[np.ndarray]
    fine: int = 1

    def lift(self, v: np.ndarray, query: bool) -> np.ndarray:
        size = np.sqrt((v * v).sum(1))
        if query:
            return np.column_stack([v / size[:, None], np.zeros(len(v))])
        return np.column_stack([v / self.norm, np.sqrt(np.maximum(0.0, 1 - (size / self.norm) ** 2))])

    def keys(self, v: np.ndarray, query: bool) -> np.ndarray:
        """(curves, rows) of places."""
        lifted = self.lift(v, query)
        out = []
        for p, low, scale in zip(self.projection, self.low, self.scale, strict=True):
            y = np.clip((lifted @ p - low) * scale, 0, (1 << BITS) - 1)
            out.append(hilbert_key(y.astype(np.int64), BITS))
        return np.array(out)

    def stretches(self, v: np.ndarray, query: bool) -> np.ndarray:
        return np.array([self.places(c, k) for c, k in enumerate(self.keys(v, query))])

    def places(self, curve: int, keys: np.ndarray) -> np.ndarray:
        """The stretch of each key of an ordering, numbered along the curve."""
        cuts = self.cuts[curve]
        piece = np.searchsorted(cuts, keys, "right")
        if self.fine == 1:
            return piece
        ends = np.concatenate([[0], cuts, [1 << (BITS * self.low.shape[1])]]).astype(float)
        part = (keys - ends[piece]) / np.maximum(ends[piece + 1] - ends[piece], 1.0)
        return piece * self.fine + np.clip(part * self.fine, 0, self.fine - 1).astype(np.int64)

    def last(self, curve: int) -> int:
        return (len(self.cuts[curve]) + 1) * self.fine - 1

    def cut(self, places: np.ndarray, rows: int, stretch: int) -> None:
        """Cuts of each ordering at quantiles of the sample's places, so that a stretch has about as many of all rows."""
        wanted = max(1, -(-rows // stretch))
        parts = min(wanted, CUTS, places.shape[1])
        self.fine = -(-wanted // parts)
        self.cuts = [np.unique(np.quantile(own, np.arange(1, parts) / parts, method="lower")).astype(np.int64) if parts > 1 else np.zeros(0, np.int64) for own in places]


def fit(sample: np.ndarray, norm: float, rows: int, curves: int = CURVES, stretch: int = STRETCH, seed: int = 11) -> Curves:
    """Random orthonormal projections, each with its own shift; cuts are quantiles of the sample's places."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1] + 1
    k = min(DIMENSIONS, d)
    out = Curves(norm, np.array([np.linalg.qr(rng.normal(size=(d, k)))[0] for _ in range(curves)]), np.zeros((curves, k)), np.ones((curves, k)), [])
    lifted = out.lift(sample, False)
    for c in range(curves):
        y = lifted @ out.projection[c]
        sd = np.maximum(y.std(0), 1e-9)
        out.low[c] = y.mean(0) - sd * (2 + rng.uniform(-0.5, 0.5, k))
        out.scale[c] = (1 << BITS) / (4 * sd)
    out.cut(out.keys(sample, False), rows, stretch)
    return out


def probe(each: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query's vector and one of its true k nearest others, for a sample of the queries, by brute force."""
    asked = each.where("asks").orderBy("h1", "h2").limit(PROBED).select("h1", "h2", "v").toArrow().combine_chunks()
    none = np.zeros((0, 1))
    if not asked.num_rows:
        return none, none
    shared = each.sparkSession.sparkContext.broadcast((matrix(asked.column("v").combine_chunks()), asked.column("h1").to_numpy(), asked.column("h2").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, h1, h2 = shared.value
        best, vectors = np.full((len(q), k), -np.inf), np.zeros((len(q), k, q.shape[1]))
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(2))
            score = q @ v.T
            score[(h1[:, None] == batch.column(0).to_numpy()) & (h2[:, None] == batch.column(1).to_numpy())] = -np.inf
            top = np.argsort(-score, axis=1)[:, :k]
            both = np.concatenate([best, np.take_along_axis(score, top, 1)], axis=1)
            held = np.concatenate([vectors, v[top]], axis=1)
            order = np.argsort(-both, axis=1, kind="stable")[:, :k]
            best, vectors = np.take_along_axis(both, order, 1), np.take_along_axis(held, order[:, :, None], 1)
        i, j = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(best[i, j]), pa.array(list(vectors[i, j]), pa.list_(pa.float64()))], ["i", "score", "v"])

    near = each.select("h1", "h2", "v").mapInArrow(run, "i long, score double, v array<double>")
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score")))).where(F.col("r") <= k)
    found = first.select("i", "v").toArrow().combine_chunks()
    return shared.value[0][found.column("i").to_numpy()], matrix(found.column("v").combine_chunks()) if found.num_rows else none


def widened(index: Curves, places: np.ndarray, rows: int, stretch: int, queries: np.ndarray, nearest: np.ndarray) -> Curves:
    """index with the narrowest stretches, from stretch on by doubling, in which queries meet a share RECALL of their nearest."""
    if not len(queries) or not len(nearest):
        return index
    asked, there = index.keys(queries, True), index.keys(nearest, False)
    while True:
        index.cut(places, rows, stretch)
        sides = [np.abs(index.places(c, a) - index.places(c, b)) for c, (a, b) in enumerate(zip(asked, there, strict=True))]
        if (np.min(sides, axis=0) <= 1).mean() >= RECALL or stretch >= rows:
            return index
        stretch *= 2


def first_ids(column: pa.Array) -> np.ndarray:
    """The first entry of each list; no list is empty."""
    offsets = np.asarray(column.offsets)
    return column.values.to_numpy()[offsets[:-1]]


def best_of(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, score) of the k best for each row of q: by score, then least id.

    A matrix product finds all that may be among them, ties and what rounding hides included; these are scored exactly.
    """
    near = q @ x.T
    k = min(k, len(x))
    edge = np.partition(near, len(x) - k, axis=1)[:, len(x) - k]
    slack = 1e-9 * np.sqrt((q * q).sum(1) * (x * x).sum(1).max())
    i, j = np.nonzero(near >= (edge - slack)[:, None])
    exact = (q[i] * x[j]).sum(1)
    order = np.lexsort((ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k], exact[rank < k]


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def taking_part(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(fine)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == (sizes.d if sizes else 0))


def marks(v: str) -> list[Column]:
    return [F.xxhash64(F.col(v)).alias("h1"), F.xxhash64(F.col(v), F.lit(1)).alias("h2")]


def distinct_vectors(rows: DataFrame, most: int, modulus: int) -> DataFrame:
    """(h1, h2, v, ids, asks): each vector once, with the least ids that have it and whether a query has it.

    Ids are cut to the least ones batch by batch before the shuffle, so a vector that very many rows share stays small.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, ids = (batch.column(k).to_numpy() for k in (0, 1, 3))
            if not len(ids):
                continue
            order = np.lexsort((ids, h2, h1))
            new = np.ones(len(ids), bool)
            new[1:] = (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)
            heads = np.flatnonzero(new)
            ends = np.append(heads[1:], len(ids))
            kept = [np.unique(ids[order[a:b]])[:most] for a, b in zip(heads, ends, strict=True)]
            asks = np.logical_or.reduceat(ids[order] % modulus == 0, heads)
            pick = pa.array(order[heads])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), batch.column(2).take(pick), pa.array(kept, pa.list_(pa.int64())), pa.array(asks)], ["h1", "h2", "v", "ids", "asks"])

    local = rows.select(*marks("v"), "v", "vec_id").mapInArrow(combine, "h1 long, h2 long, v array<double>, ids array<long>, asks boolean")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most)
    return local.groupBy("h1", "h2").agg(F.any_value("v").alias("v"), ids.alias("ids"), F.max("asks").alias("asks"))


def search(vectors: DataFrame, k: int = 20, modulus: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, stretch: int = STRETCH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by modulus, in double precision.

    Every row is in every ordering. Stretches are widened until a sample of queries, held against every vector, meets a share
    RECALL of its nearest; stretch is the least. Equal vectors are one entry with its least ids, which loses nothing since ties go to the
    smaller id. Null, zero and non-finite vectors, null ids, and vectors whose length isn't the most common one take no part;
    rows of one id are one candidate for each vector, and none of their own query. An empty table gives an empty result; other
    columns are not read.
    """
    spark = vectors.sparkSession
    rows = taking_part(vectors, id_col, vector_col)
    each = stage_table(distinct_vectors(rows, k + 1, modulus), "vectors")
    size = each.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("s")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not size.n:
        return spark.createDataFrame([], schema)
    sample = matrix(each.orderBy("h1", "h2").limit(FIT_ROWS).select("v").toArrow().column("v").combine_chunks())
    index = fit(sample, float(np.sqrt(size.s)), int(size.n), curves, stretch)
    index = widened(index, index.keys(sample, False), int(size.n), stretch, *probe(each, k))
    asking = each.where("asks").count()
    stretches = min(index.last(c) + 1 for c in range(curves))
    blocks = max(1, -(-3 * asking // (stretches * ASKING)))  # three stretches meet a query
    shared = spark.sparkContext.broadcast(index)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        names = ["g", "data", "h1", "h2", "ids", "v"]
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                v = matrix(batch.column(2))
                asks = np.flatnonzero(batch.column(4).to_numpy(zero_copy_only=False))
                for c, own in enumerate(index.stretches(v, False)):
                    n = batch.num_rows
                    for b in range(blocks):
                        yield pa.RecordBatch.from_arrays([pa.array(((c << 40) + own) * blocks + b), pa.array(np.ones(n, bool)), batch.column(0), batch.column(1), batch.column(3), batch.column(2)], names)
                if len(asks):
                    pick = pa.array(asks)
                    head = [batch.column(j).take(pick) for j in (0, 1)]
                    block = head[0].to_numpy() % blocks
                    own_v, none = batch.column(2).take(pick), pa.nulls(len(asks), pa.list_(pa.int64()))
                    for c, own in enumerate(index.stretches(v[asks], True)):
                        last = index.last(c)
                        for side in (-1, 0, 1):
                            there = (own + side >= 0) & (own + side <= last)
                            to = pa.array(((c << 40) + own + side) * blocks + block)
                            part = pa.RecordBatch.from_arrays([to, pa.array(np.zeros(len(asks), bool)), *head, none, own_v], names)
                            yield part.filter(pa.array(there))

    dealt = each.mapInArrow(deal, "g long, data boolean, h1 long, h2 long, ids array<long>, v array<double>")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries of a stretch come first, then its vectors, a batch at a time; each batch gives its best to the merge."""
        group, questions, heads = None, None, []
        for whole in batches:
            g, data = whole.column(0).to_numpy(), whole.column(1).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((np.diff(g) != 0) | (data[1:] != data[:-1])) + 1
            for a, b in zip([0, *cut], [*cut, len(g)], strict=True):
                if a == b:
                    continue
                part = whole.slice(a, b - a)
                if g[a] != group:
                    group, questions, heads = g[a], [], []
                if not data[a]:
                    questions.append(matrix(part.column(5)))
                    heads.append(np.column_stack([part.column(2).to_numpy(), part.column(3).to_numpy()]))
                elif questions:
                    q, x, head = np.concatenate(questions), matrix(part.column(5)), np.concatenate(heads)
                    for at in range(0, len(q), 512):
                        i, j, exact = best_of(q[at : at + 512], x, first_ids(part.column(4)), k + 1)
                        yield pa.RecordBatch.from_arrays([pa.array(head[at + i, 0]), pa.array(head[at + i, 1]), part.column(4).take(pa.array(j)), pa.array(exact)], ["h1", "h2", "ids", "score"])

    near = dealt.repartition("g").sortWithinPartitions("g", "data").mapInArrow(rerank, "h1 long, h2 long, ids array<long>, score double")
    found = near.groupBy("h1", "h2", F.col("ids")[0].alias("first")).agg(F.any_value("ids").alias("ids"), F.max("score").alias("score"))
    by_entry = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "first")
    found = found.withColumn("r", F.row_number().over(by_entry)).where(F.col("r") <= k + 1 + 8)
    single = found.select("h1", "h2", "score", F.explode("ids").alias("vec_id"))
    top = single.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = stage_table(top.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found")), "nearest")
    queries = rows.where(F.col("vec_id") % modulus == 0).select(F.col("vec_id").alias("query_id"), *marks("v"))
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    asked = queries.join(lists, ["h1", "h2"]).select("query_id", F.posexplode(others).alias("r", "f"))
    return asked.select("query_id", (F.col("r") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
