"""Best-fit packing of token pieces by linear grouping: plan on the length histogram, place every piece from its rank."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, stage_table, table, text_or_empty

CAPACITY = 4096
END_ID = 1
#: Entries of a worker's cache of words and of the one of their pieces, about 200 bytes each. A full cache becomes the older one,
#: in whose place it steps; what is found there is taken over, so words in use stay.
CACHE_ENTRIES, PIECE_ENTRIES = 200_000, 60_000

# ---------------------------------------------------------------------------------------------------------------- tokens

#: Characters whose class and lower case Python and the tokenizer agree on: ASCII without controls, Latin letters with marks.
_PLAIN = re.compile(r"[\t\n\x0b\f\r -~À-ÖØ-öø-ÿ¿¡«»€–—‘’“”…]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


class WordIds(dict):
    """A word between spaces -> its token ids as little-endian unsigned 32-bit numbers.

    White space always parts tokens in this vocabulary, so a text's ids are those of its words in turn. A plain word is lower-
    cased and cut as the tokenizer's own pattern cuts it, and its pieces go to the tokenizer's BPE model; any other word goes
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.symbols = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def piece(self, piece: str) -> bytes:
        known = self.pieces.get(piece)
        if known is None:
            known = self.older_pieces.get(piece)
            if known is None:
                symbols = piece if piece.isascii() else "".join(map(self.symbols.__getitem__, piece.encode()))
                known = np.array([t.id for t in self.model.tokenize(symbols)], "<u4").tobytes()
            if len(self.pieces) >= PIECE_ENTRIES:
                self.older_pieces, self.pieces = self.pieces, {}
            self.pieces[piece] = known
        return known

    def __missing__(self, word: str) -> bytes:
        if (found := self.older.get(word)) is not None:
            pass
        elif _PLAIN.fullmatch(word):
            found = b"".join(map(self.piece, _PIECES.findall(word.lower())))
        else:
            found = self.whole(word)
        if len(word) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def text(self, text: str) -> bytes:
        if any(s in text for s in self.special) or re.search(r"[\x1c-\x1f]", text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


_worker: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The tokenizer of this worker process; kept from task to task."""
    if path not in _worker:
        _worker[path] = WordIds(path)
    return _worker[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every text's tokens and one end token, cut only beyond capacity.

    Texts are tokenised about 1 MB at a time, a longer one by itself.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for whole in batches:
            for batch in slices(whole, 1, 1 << 20):
                out: list[list] = [[] for _ in range(6)]
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = words.text(text) + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        for column, value in zip(out, (doc, k, at // 4, len(own) // 4, zlib.crc32(own)), strict=False):
                            column.append(value)
                        if with_ids:
                            out[5].append(np.frombuffer(own, "<i4"))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 5 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, schema)


# ------------------------------------------------------------------------------------------------------------------ plan


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes that fits the capacity and has the largest value: a knapsack, one more item each round."""
    best, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        new, pick = best.copy(), np.full(capacity + 1, -1)
        for k, n in enumerate(sizes.tolist()):
            gain = best[: capacity + 1 - n] + values[k]
            better = np.flatnonzero(gain > new[n:] + 1e-12) + n
            new[better], pick[better] = gain[better - n], k
        if (pick < 0).all():
            break
        best = new
        picks.append(pick)
    count, room = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            count[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float(best[capacity]), count


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """A basic solution of the fractional configuration problem: (items of each size, bins), as many pairs as sizes.

    Column generation: the simplex basis starts with one pattern a size; each round prices the best pattern by knapsack.
    """
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        amount = inverse @ demand
        price = inverse.T @ np.ones(k)
        value, column = best_pattern(sizes, np.maximum(price, 0), capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, np.maximum(amount, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    amount = np.maximum(np.linalg.inv(basis) @ demand, 0)
    return [(basis[:, j].round().astype(np.int64), float(amount[j])) for j in range(k)]


@dataclass
class Kind:
    """Equal bins: how many, the room left, and their items as (length, first rank, items a bin, offset of the first)."""

    bins: int
    room: int
    items: list[tuple[int, int, int, int]]


class Plan:
    """Where each piece goes, by its length and its rank among pieces of that length.

    The plan is made from the histogram of lengths alone, so its size depends on the capacity and not on the corpus.
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 24, small: int = 512):
        self.capacity = capacity
        self.used: dict[int, int] = defaultdict(int)
        self.rooms: dict[int, list[Kind]] = defaultdict(list)
        self.done: list[Kind] = []
        self.bins = 0
        large = sorted((n for n in histogram if small < n), reverse=True)
        self.large([(n, histogram[n]) for n in large], groups)
        for n in sorted((n for n in histogram if n <= small), reverse=True):
            self.best_fit(n, histogram[n])
        self.done += [k for kinds in self.rooms.values() for k in kinds]
        self.table = self.runs()

    def open(self, kind: Kind) -> None:
        (self.rooms[kind.room] if kind.room else self.done).append(kind)

    def large(self, lengths: list[tuple[int, int]], groups: int) -> None:
        """Group by rank, round up to each group's largest, solve for few sizes, then put in the actual lengths."""
        total = sum(c for _, c in lengths)
        if not total:
            return
        group_of: list[list[list[int]]] = []
        per, held = -(-total // groups), 0
        for n, count in lengths:
            while count:
                if not group_of or held == per:
                    group_of.append([])
                    held = 0
                take = min(count, per - held)
                group_of[-1].append([n, take])
                held, count = held + take, count - take
        merged: dict[int, list[list[int]]] = {}
        for g in group_of:
            merged.setdefault(g[0][0], []).extend(g)
        sizes = np.array(list(merged))
        queues = list(merged.values())
        demand = np.array([sum(c for _, c in q) for q in queues])
        for pattern, amount in sorted(configurations(sizes, demand.astype(float), self.capacity), key=lambda x: -x[1]):
            left = np.array([sum(c for _, c in q) for q in queues])
            used = pattern > 0
            if not used.any():
                continue
            bins = min(int(amount + 1e-6), int((left[used] // pattern[used]).min()))
            self.substitute(pattern, bins, queues)
        for q in queues:
            for n, count in q:
                if count:
                    self.best_fit(n, count)

    def take(self, n: int, count: int) -> int:
        rank = self.used[n]
        self.used[n] += count
        return rank

    def substitute(self, pattern: np.ndarray, bins: int, queues: list[list[list[int]]]) -> None:
        """Fill the slots of so many equal configurations with actual lengths, largest first; bins part where lengths change."""
        need = {g: int(k) for g, k in enumerate(pattern) if k}
        while bins:
            count = bins
            for g, k in need.items():
                self.trim(queues[g])
                count = min(count, queues[g][0][1] // k)
            count = max(count, 1)  # where a length runs out within a bin, that bin is one of its own
            chosen: dict[int, int] = defaultdict(int)
            for g, k in need.items():
                for _ in range(k):
                    self.trim(queues[g])
                    queues[g][0][1] -= count
                    chosen[queues[g][0][0]] += 1
            items, offset = [], 0
            for n, k in sorted(chosen.items(), reverse=True):
                items.append((n, self.take(n, count * k), k, offset))
                offset += n * k
            self.open(Kind(count, self.capacity - offset, items))
            bins -= count

    @staticmethod
    def trim(queue: list[list[int]]) -> None:
        while not queue[0][1]:
            queue.pop(0)

    def best_fit(self, n: int, count: int) -> None:
        """Put count pieces of length n where least room stays over; a bin once chosen takes as many as it can."""
        for room in sorted(r for r in self.rooms if r >= n and self.rooms[r]):
            each = room // n
            kinds = self.rooms[room]
            while kinds and count:
                kind = kinds.pop()
                full = min(kind.bins, count // each)
                if full:
                    self.open(self.part(kind, 0, full, n, each))
                    count -= full * each
                if full < kind.bins and count:
                    self.open(self.part(kind, full, 1, n, count))
                    count, full = 0, full + 1
                if full < kind.bins:
                    self.open(self.part(kind, full, kind.bins - full, n, 0))
            if not count:
                return
        each = self.capacity // n
        for bins, k in ((count // each, each), (1, count % each)):
            if bins and k:
                self.open(self.part(Kind(bins, self.capacity, []), 0, bins, n, k))

    def part(self, kind: Kind, start: int, bins: int, n: int, each: int) -> Kind:
        """Some bins of a kind, each with so many more pieces of length n."""
        items = [(m, rank + start * k, k, offset) for m, rank, k, offset in kind.items]
        if each:
            items.append((n, self.take(n, bins * each), each, self.capacity - kind.room))
        return Kind(bins, kind.room - each * n, items)

    def runs(self) -> dict[int, np.ndarray]:
        """Per length: rows (first rank, items a bin, first bin, offset of the first item), by first rank."""
        found: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for kind in self.done:
            for n, rank, k, offset in kind.items:
                found[n].append((rank, k, self.bins, offset))
            self.bins += kind.bins
        return {n: np.array(sorted(rows)) for n, rows in found.items()}


#: (groups, length up to which a piece is small) of the plans that are tried.
TRIALS = ((12, 512), (24, 1024), (24, 1365), (24, 2048))


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan with the fewest bins among TRIALS, scaled to the capacity."""
    plans = (Plan(histogram, capacity, g, max(1, n * capacity // CAPACITY)) for g, n in TRIALS)
    return min(plans, key=lambda p: p.bins)


def packed(parts: DataFrame, capacity: int = CAPACITY, rows_per_bucket: int = 50_000) -> DataFrame:
    """parts(doc_id, piece, start, length, ids_crc32, ..., row) with sequence_id and offset, without row.

    row is a number that no two pieces share. Ranks within a length come from buckets of its hash, as many as the length's share
    of all pieces needs, so a length that very many pieces have, or copies of one document, are ranked in many tasks: the rows of
    each (length, bucket) are counted, counts are summed over the buckets before, and a row adds its place in its own.
    """
    spark = parts.sparkSession
    histogram = {int(n): int(c) for n, c in parts.groupBy("length").agg(F.count("*")).collect()}
    columns = [c for c in parts.columns if c != "row"]
    if not histogram:
        return parts.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    shared = spark.sparkContext.broadcast(best_plan(histogram, capacity).table)
    hot = [F.lit(x) for n, c in histogram.items() if c > rows_per_bucket for x in (n, -(-c // rows_per_bucket))]  # lengths: at most capacity
    buckets = F.coalesce(F.try_element_at(F.create_map(*hot), F.col("length").cast("int")), F.lit(1)) if hot else F.lit(1)
    keyed = parts.withColumn("bucket", F.pmod(F.xxhash64("row"), buckets).cast("int"))
    counts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1
    ranked = keyed.withColumn("own", own).join(counts, ["length", "bucket"])
    ranked = ranked.select(*columns, (F.col("own") + F.col("before")).cast("long").alias("rank"))
    at = columns.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        for batch in batches:
            n, rank = batch.column(at).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            bins, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            order = np.argsort(n, kind="stable")
            cut = np.flatnonzero(np.diff(n[order])) + 1
            for rows in np.split(order, cut) if len(n) else []:
                table = runs[int(n[rows[0]])]
                run = table[np.searchsorted(table[:, 0], rank[rows], "right") - 1]
                k = rank[rows] - run[:, 0]
                bins[rows], offset[rows] = run[:, 2] + k // run[:, 1], run[:, 3] + k % run[:, 1] * n[rows]
            columns = [*batch.columns[:-1], pa.array(bins), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema if f.name != "row") + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for.

    A null or empty text is one piece that holds the end token only. A null doc_id stays null. Repeated rows are packed each.
    A text longer than capacity is cut into pieces of capacity tokens and a shorter last one; no other text is cut. An empty
    table gives an empty result. Other columns are not read, so clashing names do no harm.
    """
    found = pieces(docs, tokenizer, capacity, id_col, text_col, with_ids).withColumn("row", F.monotonically_increasing_id())
    return packed(stage_table(found, "pieces"), capacity, **options)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
