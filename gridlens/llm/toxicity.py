"""Toxic spans and document scores from a linear-chain conditional random field with two states."""

from __future__ import annotations

import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stage_table, table, text_or_empty
from .lm import held_out

#: Labelled rows of each class that are fitted on at most. They are taken in the order of a hash of the id, whatever their
#: length; of each class no further row is taken once the texts have so many characters together.
FIT_ROWS = 1500
FIT_CHARS = 16_000_000
#: Lines without a toxic token that are fitted on for each line with one.
PLAIN_LINES = 2
WEIGHTS = 1 << 18
CACHE_ENTRIES = 150_000
_EDGE = ".,;:!?\"'()[]{}<>*#$%&@-_=+/\\|~`^«»¿¡“”‘’…"


def parts_of(word: str) -> list[str]:
    """The strings that describe a word: itself, its beginnings and its end."""
    core = word.strip(_EDGE).lower()
    return ["w=" + core, *(f"p{n}={core[:n]}" for n in (4, 5, 6) if len(core) > n), "s=" + core[-4:], f"n={min(len(core), 12)}"]


def place(part: str) -> int:
    return zlib.crc32(part.encode("utf-8", "surrogatepass")) % WEIGHTS


def own_places(word: str) -> list[int]:
    return [place(p) for p in parts_of(word)]


def near_place(word: str, side: str) -> int:
    return place(side + word.strip(_EDGE).lower()[:6])


def suspicious_parts(rows: list[tuple[str, int]], ratio: float = 20.0) -> set[str]:
    """Beginnings and words that toxic texts hold far more often than others: they label the tokens to learn from.

    What counts is in how many different company (word before and after) a part is seen: copies of a text add nothing. At
    least five, and one for a hundred toxic texts, so that a rare word doesn't count by chance.
    """
    known: dict[str, list[str]] = {}

    def parts(word: str) -> list[str]:
        if word not in known:
            known[word] = [p for p in parts_of(word) if p[0] in "wp" and len(p) > 5]
        return known[word]

    n = Counter(y for _, y in rows)
    least = max(5, n[1] // 100)
    scale = (n[0] + 1) / (n[1] + 1)
    often = {0: Counter(), 1: Counter()}
    for text, y in rows:
        words = Counter(text.split())
        for word, times in words.items():
            for part in parts(word):
                often[y][part] += times
    # company is noted only of parts that may qualify, so that what is held stays small
    may = {p for p, c in often[1].items() if c >= least and c * scale / (often[0][p] + 0.5) >= ratio / 10}
    del often
    seen: dict[int, dict[str, set[int]]] = {0: defaultdict(set), 1: defaultdict(set)}
    for text, y in rows:
        words = text.split()
        for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
            for part in parts(word):
                if part in may:
                    seen[y][part].add(hash((before, after)))
    return {p for p, c in seen[1].items() if len(c) >= least and len(c) * scale / (len(seen[0].get(p, ())) + 0.5) >= ratio}


def label_tokens(words: list[str], suspicious: set[str]) -> list[int]:
    return [int(any(p in suspicious for p in parts_of(w) if p[0] in "wp")) for w in words]


def ratios(emit: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Posterior log-odds of state 1 at each token, by forward and backward passes over all sequences at once.

    emit: log-odds of state 1 from the token; first: the first token of each sequence (sequences + 1); trans[i, j]: weight of
    going from state i to j. The recursions carry log(alpha_1 / alpha_0), so one number a token is kept.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    at, size = first[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), "left")
    ahead, behind = emit.copy(), np.zeros_like(emit)
    for t in range(1, longest):
        i = at[: live[t]] + t
        r = ahead[i - 1]
        ahead[i] += np.logaddexp(trans[0, 1], trans[1, 1] + r) - np.logaddexp(trans[0, 0], trans[1, 0] + r)
    for t in range(longest - 1, 0, -1):
        i = at[: live[t]] + t
        r = behind[i] + emit[i]
        behind[i - 1] = np.logaddexp(trans[1, 0], trans[1, 1] + r) - np.logaddexp(trans[0, 0], trans[0, 1] + r)
    return ahead + behind


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Crf:
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    document: np.ndarray = field(default_factory=lambda: np.array([-4.0, 8.0, 0.0]))


def lines_of(text: str, most: int = 100) -> list[list[str]]:
    """The words of each line; for fitting, a longer line is several sequences."""
    words = (line.split() for line in text.split("\n"))
    return [w[k : k + most] for w in words for k in range(0, len(w), most)]


def fit(rows: list[tuple[str, int]], rounds: int = 30, rate: float = 0.5, ridge: float = 1e-4, seed: int = 7) -> Crf:
    """Fit on (text, toxic): label tokens, learn the field's weights by AdaGrad on its likelihood, then the document's score."""
    suspicious = suspicious_parts(rows)
    rng = np.random.default_rng(seed)
    with_toxic, without = [], []  # lines as (row, line)
    for r, (text, y) in enumerate(rows):
        for k, words in enumerate(lines_of(text)):
            (with_toxic if y and any(label_tokens(words, suspicious)) else without).append((r, k))
    keep = min(len(without), max(2000, PLAIN_LINES * len(with_toxic)))
    picked = with_toxic + ([without[i] for i in sorted(rng.choice(len(without), keep, replace=False))] if without else [])
    chosen = []
    for r, own in groupby(sorted(picked), key=lambda x: x[0]):
        lines = lines_of(rows[r][0])
        chosen += [(lines[k], label_tokens(lines[k], suspicious) if rows[r][1] else [0] * len(lines[k])) for _, k in own]
    crf = Crf(np.zeros(WEIGHTS), -3.0, np.zeros((2, 2)))
    if with_toxic:
        known: dict[str, list[int]] = {}
        token, feature, first, y = array("i"), array("i"), [0], []
        for words, labels in chosen:
            for k, w in enumerate(words):
                own = known[w] if w in known else known.setdefault(w, own_places(w))
                near = [near_place(words[k - 1], "<") if k else place("<^"), near_place(words[k + 1], ">") if k + 1 < len(words) else place(">$")]
                feature.extend(own + near)
                token.extend([len(y) + k] * (len(own) + 2))
            y += labels
            first.append(len(y))
        token, feature, first, y = np.frombuffer(token, np.int32), np.frombuffer(feature, np.int32), np.array(first), np.array(y, float)
        inner = np.ones(len(y), bool)
        inner[first[:-1]] = False
        inner = np.flatnonzero(inner)
        total = np.full(WEIGHTS, 1e-8)
        pair_total, bias_total = np.full((2, 2), 1e-8), 1e-8
        gold = np.zeros((2, 2))
        np.add.at(gold, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
        for _ in range(rounds):
            emit = crf.bias + np.bincount(token, crf.weights[feature], len(y))
            log_odds = ratios(emit, first, crf.trans)
            p = sigmoid(log_odds)
            step = np.bincount(feature, (y - p)[token], WEIGHTS) / len(chosen) - ridge * crf.weights
            total += step**2
            crf.weights += rate * step / np.sqrt(total)
            b = float((y - p).sum()) / len(chosen)
            bias_total += b * b
            crf.bias += 0.2 * rate * b / np.sqrt(bias_total)
            pairs = pair_marginals(emit, log_odds, first, inner, crf.trans)
            g = (gold - pairs) / len(chosen) - ridge * crf.trans
            pair_total += g**2
            crf.trans += 0.2 * rate * g / np.sqrt(pair_total)
    crf.document = fit_document(crf, rows)
    return crf


def pair_marginals(emit: np.ndarray, log_odds: np.ndarray, first: np.ndarray, inner: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Expected number of each transition: of tokens t-1 and t, alpha and beta as log-odds, normalised over the four pairs."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    at, size = first[:-1][order], size[order]
    ahead = emit.copy()
    for t in range(1, int(size[0]) if len(size) else 0):
        i = at[: np.searchsorted(-size, -t, "left")] + t
        r = ahead[i - 1]
        ahead[i] += np.logaddexp(trans[0, 1], trans[1, 1] + r) - np.logaddexp(trans[0, 0], trans[1, 0] + r)
    left, right = ahead[inner - 1], log_odds[inner] - ahead[inner] + emit[inner]
    four = np.stack([np.full(len(inner), trans[0, 0]), trans[0, 1] + right, trans[1, 0] + left, trans[1, 1] + left + right])
    four = np.exp(four - four.max(0))
    return (four / four.sum(0)).sum(1).reshape(2, 2)


class Emissions(dict):
    """A word as it stands -> the row of self.rows with its own log-odds and what it adds to its right and left neighbour."""

    def __init__(self, crf: Crf):
        super().__init__()
        self.weights = crf.weights.tolist()
        self.rows = array("d")  # three numbers a word

    def __missing__(self, word: str) -> int:
        w = self.weights
        core = word.strip(_EDGE).lower()
        self[word] = row = len(self)
        self.rows.extend((sum([w[place(p)] for p in parts_of(core)]), w[place("<" + core[:6])], w[place(">" + core[:6])]))
        return row

    def renew(self) -> None:
        """Between slices of text: start anew when the cache is full."""
        if len(self) >= CACHE_ENTRIES:
            self.clear()
            del self.rows[:]


def tag(crf: Crf, known: Emissions, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Marginal of the toxic state at each word of all texts, in order, and each text's first word (texts + 1)."""
    known.renew()
    at, line_first, text_first = [], [0], [0]
    for text in texts:
        for line in text.split("\n"):
            words = line.split()
            if words:
                at.extend(map(known.__getitem__, words))
                line_first.append(len(at))
        text_first.append(len(at))
    if not at:
        return np.zeros(0), np.array(text_first)
    e = np.array(known.rows).reshape(-1, 3)[np.array(at)]
    first = np.array(line_first)
    emit = crf.bias + e[:, 0]
    start, end = crf.weights[place("<^")], crf.weights[place(">$")]
    left, right = np.empty(len(e)), np.empty(len(e))
    left[1:], right[:-1] = e[:-1, 1], e[1:, 2]
    left[first[:-1]], right[first[1:] - 1] = start, end
    return sigmoid(ratios(emit + left + right, first, crf.trans)), np.array(text_first)


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each text: 1, the largest marginal, and log(1 + sum of marginals above one half)."""
    out = np.zeros((len(first) - 1, 3))
    out[:, 0] = 1
    for k in np.flatnonzero(np.diff(first)):
        own = p[first[k] : first[k + 1]]
        out[k, 1], out[k, 2] = own.max(), np.log1p(own[own >= 0.5].sum())
    return out


def fit_document(crf: Crf, rows: list[tuple[str, int]]) -> np.ndarray:
    """Logistic weights of summary(), by Newton steps with a small ridge."""
    if len({y for _, y in rows}) < 2:
        return np.array([-4.0, 8.0, 0.0])
    p, first = tag(crf, Emissions(crf), [t for t, _ in rows])
    x, y = summary(p, first), np.array([y for _, y in rows], float)
    w = np.zeros(3)
    for _ in range(30):
        q = sigmoid(x @ w)
        hess = (x * (q * (1 - q) + 1e-6)[:, None]).T @ x + 0.5 * np.eye(3)
        w += np.linalg.solve(hess, x.T @ (y - q) - 0.5 * w)
    return w


def labelled_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> list[tuple[str, int]]:
    """Whole texts of a bounded sample of labelled rows: see FIT_ROWS. Of rows that share an id, the least text counts."""
    kept = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picks = [kept.where(F.col("y") == y).orderBy(*order).limit(rows) for y in (0, 1)]
    chosen = picks[0].unionByName(picks[1])  # 2 x rows ids at most
    own = docs.select(F.col("doc_id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    found = stage_table(own.groupBy("doc_id", "y").agg(F.min("text").alias("text")), "labelled")
    sizes = found.select("doc_id", "y", F.length("text").alias("n")).orderBy("y", *order).collect()
    within, total = [], Counter()
    for r in sizes:
        if total[r.y] < chars:
            within.append((r.doc_id,))
            total[r.y] += r.n
    taken = found.join(F.broadcast(docs.sparkSession.createDataFrame(within, "doc_id long")), "doc_id", "left_semi") if len(within) < len(sizes) else found
    texts = taken.select("text", "y").toArrow()
    return sorted(zip(texts.column("text").to_pylist(), texts.column("y").to_pylist(), strict=True))


def score(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans): the document's probability of being toxic and "start:end" code points of toxic spans, comma-joined.

    Null and empty texts have no words and get the score of no marginal; null ids and repeated rows keep their rows; other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        known = Emissions(crf)
        for whole in batches:
            for batch in slices(whole, 1, 2 << 20):
                texts = batch.column(1).to_pylist()
                p, first = tag(crf, known, texts)
                scores = sigmoid(summary(p, first) @ crf.document)
                spans = [toxic_spans(t, p[a:b]) for t, a, b in zip(texts, first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(spans, pa.string())], ["doc_id", "score", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, score double, spans string")


def toxic_spans(text: str, p: np.ndarray) -> str:
    """Runs of words on a line whose marginal is one half or more."""
    hot = set(np.flatnonzero(p >= 0.5).tolist())
    if not hot:
        return ""
    out, k, base = [], 0, 0
    for line in text.split("\n"):
        at, last = 0, -2
        for word in line.split():
            at = line.index(word, at)
            if k in hot:
                if last == k - 1:
                    out[-1][1] = base + at + len(word)
                else:
                    out.append([base + at, base + at + len(word)])
                last = k
            at += len(word)
            k += 1
        base += len(line) + 1
    return ",".join(f"{a}:{b}" for a, b in out)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    crf = fit(labelled_rows(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", "toxic")))
    out = score(docs, crf)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
