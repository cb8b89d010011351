"""Benchmark decontamination: spaced-seed hashes of test items and documents meet in a join, and overlaps are verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import find_words, fresh, hash_words, mix, slices, stage_table, table, text_bytes, text_or_empty

#: Masks: 1 is a token that must agree, 0 one that is ignored. Checked by brute force (tests) to hit every window of WINDOW
#: tokens, or the whole of a shorter item, of which at least four fifths agree. An item of fewer than SHORT_FROM tokens must
#: agree whole: its mask is as many ones.
SHORT_MASKS = ("11011", "111001", "1000111", "11101")
LONG_MASKS = ("10100110101", "1101110001", "111111", "111010101", "1000101011001", "111000001011")
SHORT_FROM, LONG_FROM = 8, 16
MASKS = (*("1" * n for n in range(1, SHORT_FROM)), *SHORT_MASKS, *LONG_MASKS)
WINDOW = 20
AGREE = 0.8
#: Bytes of a word: ASCII letters and digits and all bytes of other scripts. A character from U+3000 to U+9FFF is a word.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[65:91] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True
ALONE = np.zeros(256, bool)
ALONE[0xE3:0xEA] = True
#: Bits of the filter of seed hashes that is broadcast: so many a hash, and at most (32 MB).
BITS_PER_SEED, MOST_BITS, PROBES = 64, 1 << 28, 4


def tokens(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, one after the other, and each row's first word (rows + 1)."""
    data, offsets = text_bytes(array)
    starts, ends, first = find_words(data, offsets, WORD_BYTES, ALONE)
    return hash_words(data, starts, ends), first


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash at each place where the mask fits; ignored places don't enter, the mask itself does."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(int("1" + mask, 2)))
    for i, c in enumerate(mask):
        if c == "1":
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return h


def masks_of(size: int) -> range:
    """Indexes of the masks for an item of so many tokens."""
    short, long = SHORT_FROM - 1, SHORT_FROM - 1 + len(SHORT_MASKS)
    return range(size - 1, size) if size < SHORT_FROM else range(short, long) if size < LONG_FROM else range(long, len(MASKS))


def least_agreeing(window: int) -> int:
    """Tokens of a window that must agree."""
    return window if window < SHORT_FROM else int(np.ceil(AGREE * window - 1e-9))


def blob(words: np.ndarray) -> bytes:
    return np.ascontiguousarray(words).astype("<u8").tobytes()


def seeds(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(item, item_id, words) of the items with a token, and (h, item, place) of all their seed hashes, both staged."""
    source = benchmark.select(F.col(id_col).cast("long").alias("item_id"), text_or_empty(text_col).alias("text")).distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 1 << 20):
                words, first = tokens(batch.column(1))
                rows = [blob(words[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["item_id", "words"]).filter(pa.array(np.diff(first) > 0))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = np.frombuffer(raw, "<u8")
                for m in masks_of(len(words)):
                    h = seed_hashes(words, MASKS[m]).view(np.int64)
                    n = len(h)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(n, item)), pa.array(np.arange(n)), pa.array(np.full(n, m, np.int32))], ["h", "item", "place", "mask"])

    items = stage_table(source.mapInArrow(cut, "item_id long, words binary").withColumn("item", F.monotonically_increasing_id()), "items")
    return items, stage_table(items.select("item", "words").mapInArrow(hashed, "h long, item long, place long, mask int"), "seeds")


@dataclass
class SeedFilter:
    """A Bloom filter of the seed hashes: of the places of a document few that aren't in the benchmark pass it."""

    bits: np.ndarray
    masks: list[str]

    def passing(self, h: np.ndarray) -> np.ndarray:
        at = np.arange(len(h))
        size = np.uint64(8 * len(self.bits) - 1)
        for probe in range(PROBES):
            where = probe_of(h[at], probe) & size
            at = at[(self.bits[where >> np.uint64(3)] >> (where & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return at


def probe_of(h: np.ndarray, probe: int) -> np.ndarray:
    return h >> np.uint64(15 * probe) if probe < 3 else mix(h)


def seed_filter(found: DataFrame) -> SeedFilter:
    """Bits are set in Spark, in blocks of 4 KB, and put together on the driver: MOST_BITS / 8 bytes at most.

    A benchmark of more than MOST_BITS / BITS_PER_SEED seeds makes the filter let more places pass, to be parted in the join;
    none is lost.
    """
    size = found.agg(F.count("*").alias("n"), F.collect_set("mask").alias("masks")).first()  # at most one of each of MASKS
    bits = min(MOST_BITS, 1 << max(16, (size.n * BITS_PER_SEED).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            where = np.unique(np.concatenate([probe_of(h, k) & np.uint64(bits - 1) for k in range(PROBES)])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(where >> 15), pa.array(where & 32767)], ["block", "at"])

    blocks = found.select("h").mapInArrow(places, "block long, at long").groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in blocks.toLocalIterator():
        out[row.block * 4096 : (row.block + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    return SeedFilter(out, [MASKS[m] for m in sorted(size.masks)])


#: Stretches of a document around places that pass the filter: the first token, all tokens, and the hits: token and hash.
FOUND = "array<struct<start:bigint,words:binary,at:array<int>,h:array<bigint>>>"
_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.binary()), ("at", pa.list_(pa.int32())), ("h", pa.list_(pa.int64()))]))


def stretches(words: np.ndarray, at: np.ndarray, h: np.ndarray) -> list[dict]:
    """Hits of one document whose surroundings touch are one stretch; WINDOW tokens lie on both sides of each hit."""
    order = np.argsort(at, kind="stable")
    at, h = at[order], h[order]
    cut = np.flatnonzero(np.diff(at) > 2 * WINDOW) + 1
    out = []
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
        low, high = max(0, int(at[a]) - WINDOW), int(at[b - 1]) + WINDOW
        out.append({"start": low, "words": blob(words[low:high]), "at": (at[a:b] - low).astype(np.int32), "h": h[a:b].view(np.int64)})
    return out


def noted(docs: DataFrame, seed: SeedFilter, text_col: str, keep: list[str]) -> tuple[DataFrame, str, str]:
    """Columns keep of docs, a number that no two rows share, and FOUND: staged. One pass over the texts."""
    spark = docs.sparkSession
    text, found, row = fresh(docs, "own_text", "found", "row")
    source = docs.select(*keep, F.lit(None).cast(FOUND).alias(found), text_or_empty(text_col).alias(text))
    shared = spark.sparkContext.broadcast(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed = shared.value
        for whole in batches:
            for batch in slices(whole, whole.num_columns - 1, 1 << 20):
                words, first = tokens(batch.column(batch.num_columns - 1))
                own, hashes = [], []
                for mask in seed.masks:
                    h = seed_hashes(words, mask)
                    at = seed.passing(h)
                    last = np.searchsorted(first, at, "right")  # the row after the hit's own
                    at = at[at + len(mask) <= first[np.minimum(last, len(first) - 1)]]
                    own.append(at)
                    hashes.append(h[at])
                at, h = np.concatenate(own), np.concatenate(hashes)
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order]
                bounds = np.searchsorted(at, first)
                rows: list[list[dict] | None] = [None] * batch.num_rows
                for r in np.flatnonzero(np.diff(bounds)):
                    a, b = bounds[r], bounds[r + 1]
                    rows[r] = stretches(words[first[r] : first[r + 1]], at[a:b] - first[r], h[a:b])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(rows, _FOUND)], batch.schema.names[:-1])

    made = source.mapInArrow(run, source.drop(text).schema) if seed.masks else source.drop(text)
    return stage_table(made.withColumn(row, F.monotonically_increasing_id()), "noted"), found, row


def best_window(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(first token in doc, tokens, agreeing) of the window with most agreeing tokens, the first of these, at one shift."""
    window = min(WINDOW, len(item))
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    if b - a < window:
        return None
    total = np.concatenate([[0], np.cumsum(doc[a + shift : b + shift] == item[a:b])])
    inside = total[window:] - total[:-window]
    k = int(inside.argmax())
    return (a + shift + k, window, int(inside[k])) if inside[k] >= least_agreeing(window) else None


def verified(held: DataFrame, found: str, row: str, items: DataFrame, seed_table: DataFrame) -> DataFrame:
    """(row, item_id, start_token, tokens, agreeing): the best window of each pair that overlaps.

    Hits meet the seeds in a join on the hash, once for each shift of a stretch; stretches and items are then joined by their
    numbers. A hash that very many documents share is split by adaptive execution, as any skewed join.
    """
    each = held.where(F.col(found).isNotNull()).select(F.col(row).alias("row"), F.posexplode(found).alias("part", "s"))
    each = each.select("row", "part", "s.start", "s.words", "s.at", "s.h")
    hits = each.select("row", "part", F.explode(F.arrays_zip("at", "h")).alias("x")).select("row", "part", "x.at", "x.h")
    shifts = hits.join(seed_table.select("h", "item", "place"), "h").select("row", "part", "item", (F.col("at") - F.col("place")).alias("shift"))
    tried = shifts.groupBy("row", "part", "item").agg(F.collect_set("shift").alias("shifts"))
    both = tried.join(each.select("row", "part", "start", "words"), ["row", "part"]).join(items.select("item", "item_id", F.col("words").alias("own")), "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "item_id", "start_token", "tokens", "agreeing"]
        for batch in batches:
            out = []
            for number, item_id, shifts, start, words, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc, item = np.frombuffer(words, "<u8"), np.frombuffer(own, "<u8")
                for shift in shifts:
                    if best := best_window(doc, item, shift):
                        out.append((number, item_id, start + best[0], *best[1:]))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    near = both.select("row", "item_id", "shifts", "start", "words", "own").mapInArrow(run, "row long, item_id long, start_token long, tokens long, agreeing long")
    best = F.max_by(F.struct("start_token", "tokens", "agreeing"), F.struct("agreeing", -F.col("start_token"))).alias("b")
    return near.groupBy("row", "item_id").agg(best).select("row", "item_id", "b.*")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", bench_id: str = "item_id", bench_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start_token, tokens, agreeing) for each row of docs and benchmark item that its text overlaps.

    Tokens are runs of letters and digits, A-Z lower-cased; each character of a script without spaces is one. A text overlaps an
    item when, at one shift, a window of WINDOW tokens (all of a shorter item) lies in the text and at least AGREE of its tokens
    agree; other tokens may be substituted. An item of fewer than SHORT_FROM tokens must agree whole. Of several windows the one
    with most agreeing tokens is given, of these the first. Items without a token, and null and empty texts, overlap nothing; an
    empty benchmark or table gives an empty result; repeated rows, and rows with a null id, are each given; items that share an
    id are one; other columns are not read.
    """
    items, seed_table = seeds(benchmark, bench_id, bench_text)
    held, found, row = noted(docs, seed_filter(seed_table), text_col, [id_col])
    near = verified(held, found, row, items, seed_table).withColumnRenamed("row", row)
    ids = held.where(F.col(found).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), row)
    return ids.join(near, row).drop(row)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", bench_id: str = "item_id", bench_text: str = "text") -> DataFrame:
    """docs without the rows that overlap a benchmark item; columns as they were, whatever their names. Odd rows as in overlaps().

    Rows none of whose places pass the filter stay without meeting anything; only the others are joined with what was verified.
    """
    items, seed_table = seeds(benchmark, bench_id, bench_text)
    held, found, row = noted(docs, seed_filter(seed_table), text_col, docs.columns)
    gone = verified(held, found, row, items, seed_table).select(F.col("row").alias(row)).distinct()
    clear = held.where(F.col(found).isNull())
    return clear.unionByName(held.where(F.col(found).isNotNull()).join(gone, row, "left_anti")).select(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it overlaps."""
    return overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
