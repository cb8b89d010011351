"""Language-model scores from a log-frequency Bloom filter, beside an exact add-one unigram score."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import find_words, free_shuffles, hash_words, mix, slices, stage_table, table, text_bytes, text_or_empty

END = np.uint64(0x5E0FE0D5E0FE0D11)
BEGIN = np.uint64(0xB0B0B0B0CAFE0123)
PROBES = 4
BASE = 1.5
#: Bits of a filter that is broadcast at most (32 MB); the segments of a larger one stay in the shared folder and are joined.
MAX_BITS = 1 << 28
#: Bits of a segment at most.
SEGMENT_BITS = 1 << 24
BITS_PER_ITEM = 12
#: Words whose exact counts are broadcast at most; counts of all others are joined.
HOT_WORDS = 1 << 19
#: Bytes of text that are scored at a time, and distinct n-grams of a task's text that are summed before they are handed on.
SLICE, COMBINED = 4 << 20, 1_500_000
#: Of an n-gram's hash the highest bits name its segment; these are entered there. A segment holds a million or so of 2^32 keys,
#: so two meet less often than the filter errs, and four bytes are moved instead of eight.
KEY = np.uint64((1 << 32) - 1)
#: Weight of the unigram estimate, in tokens seen after a context.
MU = 400.0


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == rest


def token_stream(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows with END after each row's words, and each row's first token (rows + 1)."""
    data, offsets = text_bytes(array)
    starts, ends, first = find_words(data, offsets)
    words = hash_words(data, starts, ends)
    first = first + np.arange(len(first))
    out = np.full(int(first[-1]), END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[first[1:] - 1] = False
    out[keep] = words
    return out, first


def bigrams(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = BEGIN
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens), before


def levels(counts: np.ndarray, least: int) -> np.ndarray:
    """1 for least occurrences, one more for each factor BASE; 0 below."""
    ratio = np.maximum(counts, 1) / least
    return np.where(counts >= least, 1 + np.floor(np.log(np.maximum(ratio, 1)) / np.log(BASE) + 1e-9), 0).astype(np.int64)


def represented(least: int, top: int = 120) -> np.ndarray:
    """The count that each level stands for: the mean of the counts that have it."""
    out = np.zeros(top)
    for q in range(1, top):
        low, high = np.ceil(least * BASE ** (q - 1) - 1e-9), np.ceil(least * BASE**q - 1e-9) - 1
        out[q] = (low + max(low, high)) / 2
    return out


def bit_places(h: np.ndarray, level: np.ndarray | int, probe: int, seg_bits: int) -> np.ndarray:
    salt = np.uint64((0xA24BAED4963EE407 * (probe + 1)) & (2**64 - 1))
    return mix(h + np.asarray(level, np.uint64) * np.uint64(0x9FB21C651E98DF25) + salt) & np.uint64(seg_bits - 1)


@dataclass
class LogFrequencyFilter:
    """A Bloom filter in segments (a power of two): an n-gram with level q is entered q times, as (n-gram, 1) to (n-gram, q)."""

    bits: np.ndarray
    segments: int
    seg_bits: int

    def level(self, h: np.ndarray) -> np.ndarray:
        """The level of each n-gram: probe (n-gram, 1), (n-gram, 2), ... until one isn't there."""
        out = np.zeros(len(h), np.int64)
        base = segment_of(h, self.segments).astype(np.uint64) * np.uint64(self.seg_bits)
        h = h & KEY
        live, q = np.arange(len(h)), 1
        while len(live) and q < 119:
            hit = np.ones(len(live), bool)
            for probe in range(PROBES):
                at = base[live] + bit_places(h[live], q, probe, self.seg_bits)
                hit &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            live = live[hit]
            out[live] = q
            q += 1
        return out


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    bits = segments.bit_length() - 1
    return (h >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), np.int32)


def blobs(values: np.ndarray, heads: np.ndarray) -> pa.Array:
    """A binary row for each stretch of values that begins at one of heads."""
    offsets = (np.append(heads, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def unblob(array: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the binary rows, one after the other, and how many values of so many bytes each has."""
    wide = pa.types.is_large_binary(array.type)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if array.buffers()[2] else np.zeros(0, np.uint8)
    return raw, np.diff(offsets) // width


def by_segment(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The segments at hand of sorted h, and where each begins."""
    return np.unique(segment_of(h, segments), return_index=True)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams and their counts from several such lists."""
    h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    heads = np.flatnonzero(new)
    return h[heads], np.add.reduceat(n, heads) if len(heads) else n


def counted(h: np.ndarray, n: np.ndarray, uni: bool, segments: int) -> pa.RecordBatch:
    """A row for each segment: n-grams that occur more than once first, whose counts follow; all others occur once."""
    seg = segment_of(h, segments)
    order = np.lexsort((n == 1, seg))
    h, n, seg = h[order], n[order], seg[order]
    there, heads = np.unique(seg, return_index=True)
    often = np.flatnonzero(n > 1)
    return pa.RecordBatch.from_arrays(
        [pa.array(there), pa.array(np.full(len(there), uni)), blobs(h if uni else h.astype(np.uint32), heads), blobs(n[often].astype(np.uint32), np.searchsorted(often, heads))],
        ["seg", "uni", "h", "n"],
    )


def read_counted(uni: bool, h: pa.Array, n: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """N-grams and counts of rows that counted() made; pairs by their KEY."""
    raw, size = unblob(h, 8 if uni else 4)
    counts, often = unblob(n, 4)
    out = np.ones(int(size.sum()), np.int64)
    begin = np.cumsum(size) - size
    out[np.repeat(begin - (np.cumsum(often) - often), often) + np.arange(int(often.sum()))] = counts.view(np.uint32)
    return (raw.view(np.uint64).copy() if uni else raw.view(np.uint32).astype(np.uint64)), out


def ngram_counts(docs: DataFrame, segments: int) -> DataFrame:
    """(seg, uni, h, n): words or pairs of neighbours and how often they occur, summed over a task's text as far as COMBINED allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {True: [], False: []}
        size = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            for uni, parts in held.items():
                if parts:
                    yield counted(*summed(parts), uni, segments)
                    parts.clear()

        for whole in batches:
            for batch in slices(whole, 0, SLICE):
                tokens, first = token_stream(batch.column(0))
                if not len(tokens):
                    continue
                for uni, values in ((True, tokens), (False, bigrams(tokens, first)[0])):
                    held[uni].append(np.unique(values, return_counts=True))
                    size += len(held[uni][-1][0])
                if size > COMBINED:
                    yield from hand_on()
                    size = 0
        yield from hand_on()

    return docs.mapInArrow(run, "seg int, uni boolean, h binary, n binary")


@dataclass
class Model:
    """A fitted model: the filter, exact counts of words (h, n), their totals, and the frequent words' counts.

    built holds the filter's segments (seg, bits); filter is None where it is too large for a broadcast.
    """

    filter: LogFrequencyFilter | None
    built: DataFrame
    segments: int
    seg_bits: int
    words: DataFrame
    tokens: int
    distinct: int
    hot_from: int
    hot_h: np.ndarray
    hot_n: np.ndarray


def runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each stretch of rows in which no column changes."""
    cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
    return list(zip([0, *cut], [*cut, len(columns[0])], strict=True)) if len(columns[0]) else []


def fit(docs: DataFrame, max_bits: int = MAX_BITS, hot_words: int = HOT_WORDS) -> Model:
    """Count words and pairs over all of docs(text) and enter every one of them in the filter.

    The filter grows with the text. Each segment of it is built in the task that sums its n-grams; only a filter of up to
    max_bits is put together for a broadcast, which changes nothing in what it answers.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    expected = (size.b or 0) / 6 + size.n + 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = 1 << max(8, (8 * parts - 1).bit_length())
    bits = 1 << max(18, least.bit_length() + 5, int(np.ceil(np.log2(expected * BITS_PER_ITEM))))
    segments = max(least, bits // SEGMENT_BITS)
    seg_bits = bits // segments

    dealt = ngram_counts(docs, segments).repartition(parts, "seg").sortWithinPartitions("seg", "uni")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["seg", "bits", "h", "n"]
        now, bitmap = None, np.zeros(seg_bits, bool)
        hs: list[np.ndarray] = []
        ns: list[np.ndarray] = []

        def enter() -> Iterator[pa.RecordBatch]:
            """Sum the n-grams of one segment and kind, and enter them; words are handed on with their counts."""
            h, n = summed(list(zip(hs, ns, strict=True)))
            q = levels(n, 1)
            for level in range(1, int(q.max()) + 1):
                at = h[q >= level] & KEY
                for probe in range(PROBES):
                    bitmap[bit_places(at, level, probe, seg_bits)] = True
            if now[1]:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.int32()), pa.nulls(len(h), pa.binary()), pa.array(h.view(np.int64)), pa.array(n)], names)
            hs.clear()
            ns.clear()

        def whole() -> pa.RecordBatch:
            packed = np.packbits(bitmap, bitorder="little").tobytes()
            bitmap[:] = False
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([packed], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names)

        for batch in batches:
            seg, uni = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in runs(seg, uni):
                own = (int(seg[a]), bool(uni[a]))
                if now is not None and own != now:
                    yield from enter()
                    if own[0] != now[0]:
                        yield whole()
                now = own
                h, n = read_counted(own[1], batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a))
                hs.append(h)
                ns.append(n)
        if now is not None:
            yield from enter()
            yield whole()

    staged = stage_table(dealt.mapInArrow(build, "seg int, bits binary, h long, n long"), "lm")
    del dealt
    free_shuffles(spark)
    built, lfbf = staged.where("seg is not null").select("seg", "bits"), None
    if bits <= max_bits:
        whole = np.zeros(bits // 8, np.uint8)
        for row in built.toLocalIterator():
            at = row.seg * seg_bits // 8
            whole[at : at + seg_bits // 8] = np.frombuffer(row.bits, np.uint8)
        lfbf = LogFrequencyFilter(whole, segments, seg_bits)
    words = staged.where("seg is null").select("h", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # count classes: each count up to 1000, then by powers of two; a bounded table, whatever the vocabulary
    coarse = F.when(F.col("n") <= 1000, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("long"))
    classes = sorted(((r.c, r.w) for r in words.groupBy(coarse.alias("c")).agg(F.count("*").alias("w")).collect()), reverse=True)
    hot_from, room = (classes[0][0] + 1 if classes else 1), hot_words
    for c, w in classes:
        if w > room:
            break
        hot_from, room = c, room - w
    hot = words.where(F.col("n") >= hot_from).toArrow()
    h, n = hot.column("h").to_numpy().view(np.uint64), hot.column("n").to_numpy()
    order = np.argsort(h)
    return Model(lfbf, built, segments, seg_bits, words, int(total[0]), int(total[1]), int(hot_from), h[order], n[order])


def frequent(h: np.ndarray, hot_h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of h are in sorted hot_h, and their places there."""
    at = np.minimum(np.searchsorted(hot_h, h), max(0, len(hot_h) - 1))
    return (hot_h[at] == h if len(hot_h) else np.zeros(len(h), bool)), at


def slice_name(keys: np.ndarray, place: int) -> int:
    """A name of a slice of rows, the same whenever the same rows are read in the same place."""
    place = mix(np.array([place], np.uint64))
    rows = mix(keys.view(np.uint64) + np.arange(len(keys), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return int(mix(place + rows.sum(dtype=np.uint64)).view(np.int64)[0])


def answered(source: DataFrame, model: Model, hot: object) -> DataFrame:
    """(slice, seg, levels, doc_id, k, text): the rows of each slice of text, after the levels of its n-grams by segment.

    Each slice asks each segment of the filter once for all of its n-grams, so what is held at a time is a segment or a slice,
    whatever the filter's size. source(doc_id, k, text) is read twice; a slice that isn't the same both times is an error.
    """
    spark = source.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    segments, seg_bits = model.segments, model.seg_bits
    # the partition's number in the source itself; a task's own number counts what a union reads before it
    source = source.withColumn("part", F.spark_partition_id())

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        count = 0
        for whole in batches:
            for batch in slices(whole, 2, SLICE):
                part = batch.column(3)[0].as_py()
                yield slice_name(batch.column(1).to_numpy(), (part << 32) + count), batch
                count += 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, batch in named(batches):
            h = needed(*token_stream(batch.column(2)), hot.value[0])
            there, heads = by_segment(h, segments)
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(np.ones(len(there), bool)), pa.array(np.full(len(there), name)), blobs(h.astype(np.uint32), heads)], ["seg", "asks", "slice", "data"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lfbf = None, None
        for batch in batches:
            seg, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in runs(seg, asks):
                part = batch.slice(a, b - a)
                if seg[a] != now:
                    now, lfbf = seg[a], None
                if not asks[a]:
                    lfbf = LogFrequencyFilter(np.frombuffer(part.column(3)[0].as_py(), np.uint8), 1, seg_bits)
                    continue
                raw, size = unblob(part.column(3), 4)
                h = raw.view(np.uint32).astype(np.uint64)
                found = lfbf.level(h) if lfbf else np.zeros(len(h))
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(0), blobs(found.astype(np.uint8), np.cumsum(size) - size)], ["slice", "seg", "levels"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, batch in named(batches):
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *batch.columns[:3]], ["slice", "seg", "levels", "doc_id", "k", "text"])

    asked = source.mapInArrow(ask, "seg int, asks boolean, slice long, data binary")
    bits = model.built.select("seg", F.lit(False).alias("asks"), F.lit(0).cast("long").alias("slice"), F.col("bits").alias("data"))
    found = bits.unionByName(asked).repartition(parts, "seg").sortWithinPartitions("seg", "asks").mapInArrow(probe, "slice long, seg int, levels binary")
    kept = source.mapInArrow(keep, "slice long, seg int, levels binary, doc_id long, k long, text string")
    return kept.unionByName(found, allowMissingColumns=True).repartition(parts, "slice").sortWithinPartitions("slice", F.asc_nulls_last("seg"))


def needed(tokens: np.ndarray, first: np.ndarray, hot_h: np.ndarray) -> np.ndarray:
    """The n-grams, sorted, whose levels no exact count gives."""
    words = np.unique(tokens)
    return np.union1d(words[~frequent(words, hot_h)[0]], bigrams(tokens, first)[0])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for each row.

    Frequent words are looked up in the worker; of all others a row (text, word, times) goes to a join with the exact counts.
    Levels of pairs and rare words come from the broadcast filter, or from its segments where it isn't broadcast; docs must then
    be read in one order, as a stored table is. Nulls: a null text is empty (one end token); a null doc_id stays. Repeated rows
    each get their row. Other columns are not read. With an empty training set every word is unknown and the scores are those of
    the smoothing alone.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.hot_h, model.hot_n, model.tokens, model.distinct, model.filter))
    id_text = text_or_empty(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_text, F.col(id_col).cast("long"), F.length(id_text)).alias("k"), id_text.alias("text"))
    schema = "doc_id long, k long, n_tokens long, known long, logs double, score double, h long, times long"
    names = [c.split()[0] for c in schema.split(", ")]
    segments = model.segments

    def numbered() -> Callable[[int], np.ndarray]:
        """Numbers for a task's rows that no row of another task has."""
        given = TaskContext.get().partitionId() << 33

        def numbers(n: int) -> np.ndarray:
            nonlocal given
            given += n
            return np.arange(given - n, given)

        return numbers

    def rate(ids: pa.Array, keys: np.ndarray, tokens: np.ndarray, first: np.ndarray, look: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The rows of a slice, and rows for its rare words. look gives the levels of n-grams."""
        hot_h, hot_n, total, distinct, _ = shared.value
        unseen, means = 1.0 / (total + distinct + 1), represented(1)
        size = np.diff(first)
        u, where = np.unique(tokens, return_inverse=True)
        is_hot, at = frequent(u, hot_h)
        exact = np.where(is_hot, hot_n[at] if len(hot_h) else 0, 0)
        logs = np.add.reduceat(np.log10(exact + 1.0)[where], first[:-1])
        known = np.add.reduceat(is_hot[where].astype(np.int64), first[:-1])
        level = levels(exact, 1)
        level[~is_hot] = look(u[~is_hot])
        guess = means[level]
        pair, _ = bigrams(tokens, first)
        pu, pwhere = np.unique(pair, return_inverse=True)
        together = means[look(pu)][pwhere]
        alone = guess[where]
        context = np.empty(len(tokens))
        context[1:] = alone[:-1]
        context[first[:-1]] = guess[np.searchsorted(u, END)]
        together = np.minimum(together, np.minimum(alone, context))
        p = (together + MU * (alone + 1) * unseen) / (np.maximum(context, together) + MU)
        scores = np.add.reduceat(np.log10(np.minimum(p, 1.0)), first[:-1])
        rows = len(size)
        none = pa.nulls(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([ids, pa.array(keys), pa.array(size), pa.array(known), pa.array(logs), pa.array(scores), none, none], names)
        rare = np.flatnonzero(~is_hot[where])
        owner = np.repeat(np.arange(rows), size)[rare]
        order = np.lexsort((tokens[rare], owner))
        owner, rare_h = owner[order], tokens[rare][order]
        new = np.ones(len(owner), bool)
        new[1:] = (np.diff(owner) != 0) | (rare_h[1:] != rare_h[:-1])
        heads = np.flatnonzero(new)
        times = np.diff(np.append(heads, len(owner)))
        n = len(heads)
        if n:
            nothing = pa.nulls(n, pa.int64())
            key = keys[owner[heads]]
            yield pa.RecordBatch.from_arrays([nothing, pa.array(key), nothing, nothing, pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array(rare_h[heads].view(np.int64)), pa.array(times)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = numbered()
        for whole in batches:
            for batch in slices(whole, 2, SLICE):
                yield from rate(batch.column(0), numbers(batch.num_rows), *token_stream(batch.column(2)), shared.value[4].level)

    def run_answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, numbers = None, numbered()
        said: list[np.ndarray] = []
        rows: list[pa.RecordBatch] = []

        def rate_slice() -> Iterator[pa.RecordBatch]:
            ids, texts = (pa.concat_arrays([r.column(c) for r in rows]) for c in (3, 5)) if rows else ([], pa.array([], pa.string()))
            tokens, first = token_stream(texts)
            h = needed(tokens, first, shared.value[0]) if rows else np.zeros(0, np.uint64)
            level = np.zeros(len(h), np.int64)
            if sum(map(len, said)) != len(h):
                raise RuntimeError("a slice of documents changed between two readings: store the table before it is scored")
            level[:] = np.concatenate(said)
            yield from rate(ids, numbers(len(ids)), tokens, first, lambda x: level[np.searchsorted(h, x)])
            said.clear()
            rows.clear()

        for batch in batches:
            name, answer = batch.column(0).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for a, b in runs(name, answer):
                if now is not None and name[a] != now:
                    yield from rate_slice()
                now, part = name[a], batch.slice(a, b - a)
                if answer[a]:
                    said.append(unblob(part.column(2), 1)[0].copy())
                else:
                    rows.append(part)
        if now is not None:
            yield from rate_slice()

    mapped = source.mapInArrow(run, schema) if model.filter else answered(source, model, shared).mapInArrow(run_answered, schema)
    looked = stage_table(mapped, "lmscore")
    del mapped
    free_shuffles(spark)
    rare = looked.where("h is not null").select("k", "h", "times")
    counts = model.words.where(F.col("n") < model.hot_from)
    c = F.coalesce(F.col("n"), F.lit(0))
    rest = rare.join(counts, "h", "left").groupBy("k").agg(
        F.sum(F.col("times") * F.log10(c + 1.0)).alias("rest_logs"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rest_known")
    )
    rows = looked.where("h is null").select("doc_id", "k", "n_tokens", "known", "logs", "score")
    joined = rows.join(rest, "k", "left")
    size = F.log10(F.lit(float(model.tokens + model.distinct + 1)))
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).cast("long").alias("n_known"),
        (F.col("logs") + F.coalesce("rest_logs", F.lit(0.0)) - F.col("n_tokens") * size).alias("base_score"),
        "score",
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"), 7, 2)).select(text_or_empty().alias("text")))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
