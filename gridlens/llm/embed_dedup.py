"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative of each group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import matrix
from .common import connected_components, stage_table, table

#: Distinct vectors of a cell, about; cells at most; distinct vectors that the cells are fitted on, at most; steps of the fit.
CELL, CELLS, FIT_ROWS, STEPS = 2048, 4096, 50_000, 8
#: Rows of a cell in a block of its own vectors, and in a block of visitors.
BLOCK, VISITORS = 2048, 4096


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # so that no square overflows or vanishes
    return v / np.sqrt((v * v).sum(1))[:, None]


def fit(sample: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """Unit centres of spherical k-means; a cell that loses all its vectors starts anew at the one farthest from its centre."""
    x = unit(sample)
    centres = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(STEPS if cells > 1 else 1):
        near, best = np.empty(len(x), np.int64), np.empty(len(x))
        for at in range(0, len(x), 4096):
            p = x[at : at + 4096] @ centres.T
            near[at : at + 4096] = p.argmax(1)
            best[at : at + 4096] = p.max(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(1))
        lost = np.flatnonzero(size < 1e-9)
        sums[lost] = x[np.argsort(best, kind="stable")[: len(lost)]]
        size[lost] = 1
        centres = sums / size[:, None]
    return np.unique(centres, axis=0)  # two equal centres would leave one cell empty


def assigned(x: np.ndarray, centres: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each unit vector, and (rows, cells) whether it visits another.

    Of two vectors at an angle t in two cells, the angles to the plane half-way between the centres add up to t at most, so one of
    them is within t / 2 of it. A vector visits each cell whose plane is as near as half the angle of the threshold.
    """
    p = x @ centres.T
    home = p.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 1e-18))
    margin = (p[np.arange(len(x)), home][:, None] - p) / apart[home]
    visits = margin <= np.sqrt((1 - cosine) / 2) + 1e-9
    visits[np.arange(len(x)), home] = False
    return home, visits


def linked(x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of rows reach the cosine in double precision; a product of floats decides all that isn't close."""
    near = ux.astype(np.float32) @ uy.astype(np.float32).T
    slack = np.float32(max(1e-5, 2.4e-7 * x.shape[1]))
    out = near >= np.float32(cosine) + slack
    i, j = np.nonzero(~out & (near >= np.float32(cosine) - slack))
    for at in range(0, len(i), 1 << 16):
        a, b = x[i[at : at + (1 << 16)]], y[j[at : at + (1 << 16)]]
        out[i[at : at + (1 << 16)], j[at : at + (1 << 16)]] = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))) >= cosine
    return out


def spanning(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, column) of a table of links that connect whatever all of them connect; fewer than rows and columns."""
    rows, cols = mask.any(1), mask.any(0)
    i, j = [], []
    for start in np.flatnonzero(rows):
        stack = [int(start)] if rows[start] else []
        rows[start] = False
        while stack:
            r = stack.pop()
            found = np.flatnonzero(mask[r] & cols)
            if not len(found):
                continue
            cols[found] = False
            i.append(np.full(len(found), r))
            j.append(found)
            open_rows = np.flatnonzero(rows)
            there = mask[np.ix_(open_rows, found)]
            hit = there.any(1)
            more = open_rows[hit]
            i.append(more)
            j.append(found[there[hit].argmax(1)])
            rows[more] = False
            stack.extend(more.tolist())
    none = np.zeros(0, np.int64)
    return (np.concatenate(i), np.concatenate(j)) if i else (none, none)


def taking_part(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(vec_id, v) of all rows, v null unless the row takes part; and one row for each distinct v: (class, v, n, least)."""
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
    rows = rows.select("vec_id", F.when(fine, F.col("v")).alias("v"))
    grouped = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    return rows, stage_table(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")


def dealt(classes: DataFrame, centres: np.ndarray, cosine: float) -> DataFrame:
    """(cell, own, class, n, v, home, visits): each vector in its cell, with the cells it visits, and in each of these."""
    shared = classes.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                home, visits = assigned(unit(matrix(batch.column(2))), shared.value, cosine)
                row, cell = np.nonzero(visits)
                ends = np.searchsorted(row, np.arange(len(home) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(cell.astype(np.int32)))
                names = ["cell", "own", "class", "n", "v", "home", "visits"]
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(np.ones(len(home), bool)), *batch.columns[:3], pa.array(home.astype(np.int32)), lists], names)
                for start in range(0, len(row), 2048):
                    r, c = row[start : start + 2048], cell[start : start + 2048]
                    copies = [batch.column(k).take(pa.array(r)) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(np.zeros(len(r), bool)), *copies, pa.array(home[r].astype(np.int32)), pa.nulls(len(r), pa.list_(pa.int32()))], names)

    kind = dict(classes.dtypes)["v"]
    return classes.select("class", "n", "v").mapInArrow(run, f"cell int, own boolean, class long, n long, v {kind}, home int, visits array<int>")


def compared(cells: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n): links (a, b) that connect what all links of cells connect, and numbers n of linked vectors of a (b null).

    The vectors of a cell are parted into blocks, and so are its visitors; a group is a block of its vectors beside another or
    itself, or beside a block of visitors, so no group grows with a cell. A pair of two cells that would be met in both counts
    in the cell of smaller number.
    """
    sizes = cells.groupBy("cell").agg(F.ceil(F.sum(F.col("own").cast("int")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.sum((~F.col("own")).cast("int")) / VISITORS).cast("int").alias("others"))
    placed = cells.join(sizes, "cell").where("blocks > 0")
    mine = F.pmod(F.xxhash64("class", F.lit(3)), F.when(F.col("own"), F.col("blocks")).otherwise(F.col("others"))).cast("int")
    placed = placed.withColumn("mine", mine)
    #: a pair of blocks (left, right): right counts on from the cell's own blocks for visitors
    own_pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("mine")).alias("left"), F.greatest(x, F.col("mine")).alias("right")))
    seen_pairs = F.when(F.col("others") > 0, F.transform(F.sequence(F.lit(1), F.greatest("others", F.lit(1))), lambda x: F.struct(F.col("mine").alias("left"), (-x).alias("right")))).otherwise(F.array().cast("array<struct<left:int,right:int>>"))
    visit_pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(x.alias("left"), (-1 - F.col("mine")).alias("right")))
    pairs = placed.withColumn("pair", F.explode(F.when(F.col("own"), F.concat(own_pairs, seen_pairs)).otherwise(visit_pairs)))
    groups = pairs.select("cell", F.col("pair.left").alias("left"), F.col("pair.right").alias("right"), "own", "mine", "class", "n", "v", "home", F.when(F.col("pair.right") < 0, F.col("visits")).alias("visits"))

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        cell, left, right = (group.column(k)[0].as_py() for k in ("cell", "left", "right"))
        own, mine = group.column("own").to_numpy(), group.column("mine").to_numpy()
        first = np.flatnonzero(own & (mine == left))
        second = np.flatnonzero(~own) if right < 0 else first if left == right else np.flatnonzero(own & (mine == right))
        out = []
        if len(first) and len(second):
            v = matrix(group.column("v").combine_chunks() if group.column("v").num_chunks != 1 else group.column("v").chunk(0))
            u = unit(v)
            ids, sizes, home = (group.column(k).to_numpy() for k in ("class", "n", "home"))
            mask = linked(v[first], v[second], u[first], u[second], cosine)
            if right < 0:  # of these pairs, those go that the other cell has, if its number is smaller
                there = home[second]
                asked = np.unique(there)
                goes = np.zeros((len(first), len(asked)), bool)
                lists = group.column("visits").take(pa.array(first)).combine_chunks()
                lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
                ends = np.asarray(lists.offsets)
                flat, row = lists.values.to_numpy()[ends[0] : ends[-1]], np.repeat(np.arange(len(first)), np.diff(ends))
                at = np.minimum(np.searchsorted(asked, flat), len(asked) - 1)
                known = asked[at] == flat
                goes[row[known], at[known]] = True
                mask &= ~(goes[:, np.searchsorted(asked, there)] & (there < cell))
            elif left == right:
                np.fill_diagonal(mask, False)
            weight = mask.astype(np.float64)
            count = (weight @ sizes[second]).astype(np.int64)
            some = np.flatnonzero(count)
            out.append((ids[first][some], np.full(len(some), -1), count[some]))
            if left != right:
                count = (sizes[first] @ weight).astype(np.int64)
                some = np.flatnonzero(count)
                out.append((ids[second][some], np.full(len(some), -1), count[some]))
            i, j = spanning(mask)
            out.append((ids[first][i], ids[second][j], np.zeros(len(i), np.int64)))
        a, b, n = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ())))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64(), mask=b < 0), "n": pa.array(n, pa.int64())})

    return groups.groupBy("cell", "left", "right").applyInArrow(compare, "a long, b long, n long")


def components(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = CELL) -> DataFrame:
    """One row per vector: vec_id, n_links (others at that cosine or nearer), component_id (least vec_id reachable), kept.

    Links are all there are: a vector also visits every cell that may hold a partner. Equal vectors are one entry of the index with
    their number, so copies of any number are one row there; each counts the others as links. Centres are fitted on at most
    FIT_ROWS distinct vectors in hash order. Vectors that are null, zero, or hold null or non-finite components link with nothing,
    and vectors of two lengths don't link. Repeated rows are vectors like others. A row without an id links like any other, and
    is a component_id (null) only where its whole component has none; kept is whether vec_id is the component_id. An empty table
    gives an empty result; other columns aren't read.
    """
    rows, classes = taking_part(vectors, id_col, vector_col)
    lengths = sorted(r[0] for r in classes.groupBy(F.size("v")).count().select("size(v)").collect())
    found = None
    for length in lengths:
        part = classes.where(F.size("v") == length)
        n = part.count()
        cells = min(CELLS, -(-n // cell))
        drawn = part.orderBy(F.xxhash64("class"), "class").limit(FIT_ROWS) if cells > 1 else part.limit(1)
        centres = fit(matrix(drawn.select("v").toArrow().column("v").combine_chunks()), cells)
        own = stage_table(compared(stage_table(dealt(part, centres, cosine), "cells"), cosine), "links")
        found = own if found is None else found.unionByName(own)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    roots = connected_components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("class"), "root")
    counts = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("others"))
    joined = classes.select("class", "v", "n", "least").join(roots, "class", "left").join(counts, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "root").select("v", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    given = rows.where("v is not null").join(named, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return given.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH RECURSIVE good AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.r AS a, y.r AS b FROM good x JOIN good y ON x.r <> y.r AND len(x.v) = len(y.v)
  WHERE list_inner_product(x.v, y.v) / (sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v))) >= 0.9),
reach AS (
  SELECT r AS a, r AS b FROM good
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT reach.a AS r, min(good.vec_id) AS component_id FROM reach JOIN good ON reach.b = good.r GROUP BY reach.a),
degrees AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a),
found AS (SELECT r, vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id FROM good JOIN least USING (r) LEFT JOIN degrees USING (r))
SELECT vec_id, n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM found
UNION ALL
SELECT vec_id, CAST(0 AS BIGINT), vec_id, true FROM embeddings
WHERE embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 OR len(list_filter(embedding, lambda x: x <> 0)) = 0
"""
