"""Document quality by co-training: a text view and a metadata view teach each other, then their calibrated scores combine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import find_words, fresh, hash_words, slices, stage_table, table, text_bytes, text_or_empty

#: Labelled rows that are fitted on, about, chosen by a hash of the id; a fifth of them calibrates.
FIT_ROWS = 20_000
ROUNDS = 3
#: Documents of each class that a view hands to the other in a round, about, and how sure it must be.
HANDED = 1000
SURE = 0.98
BUCKETS = 16

# --------------------------------------------------------------------------------------------------------------- features

#: Classes of bytes.
_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:",
    "shout": b"!?",
    "symbol": b"#$%&*+=@^_~|\\<>{}[]/`",
    "quote": b"\"'()-",
    "space": b" \t\r\x0b\x0c",
    "line": b"\n",
}
TEXT_FEATURES = (
    *(f"share_{c}" for c in (*_CLASSES, "other")), "log_bytes", "log_words", "word_length", "distinct_words", "longest_word",
    "words_with_symbol", "words_in_capitals", "words_shouted", "repeated_lines", "distinct_root",
)
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _k, _chars in enumerate(_CLASSES.values()):
    _CLASS[list(_chars)] = _k


def text_features(array: pa.Array) -> np.ndarray:
    """A row of TEXT_FEATURES for each text."""
    data, offsets = text_bytes(array)
    rows, kinds = len(array), len(_CLASSES) + 1
    out = np.zeros((rows, len(TEXT_FEATURES)))
    if not len(data):
        return out
    kind = _CLASS[data]
    size = np.diff(offsets)
    row_of = np.repeat(np.arange(rows), size)
    counts = np.bincount(row_of * kinds + kind, minlength=rows * kinds).reshape(rows, kinds)
    out[:, :kinds] = counts / np.maximum(size, 1)[:, None]
    starts, ends, first = find_words(data, offsets)
    words = np.diff(first)
    length = ends - starts
    h = hash_words(data, starts, ends)
    symbol = np.concatenate([[0], np.cumsum(kind == 5)])
    shout = np.concatenate([[0], np.cumsum(kind == 4)])
    upper = np.concatenate([[0], np.cumsum(kind == 1)])
    with_symbol = (symbol[ends] - symbol[starts] > 0).astype(float)
    shouted = (shout[ends] - shout[starts] > 1).astype(float)
    capitals = ((upper[ends] - upper[starts]) * 2 > length).astype(float) * (length > 1)
    sums = lambda v: np.concatenate([[0.0], np.cumsum(v)])
    per_word = lambda v: (sums(v)[first[1:]] - sums(v)[first[:-1]]) / np.maximum(words, 1)
    out[:, kinds] = np.log1p(size)
    out[:, kinds + 1] = np.log1p(words)
    out[:, kinds + 2] = per_word(length) / 10
    out[:, kinds + 5] = per_word(with_symbol)
    out[:, kinds + 6] = per_word(capitals)
    out[:, kinds + 7] = per_word(shouted)
    for r in np.flatnonzero(words):
        own = slice(first[r], first[r + 1])
        distinct = len(np.unique(h[own]))
        out[r, kinds + 3] = distinct / words[r]
        out[r, kinds + 9] = np.log1p(distinct / np.sqrt(words[r]))
        out[r, kinds + 4] = np.log1p(length[own].max())
        lines = bytes(data[offsets[r] : offsets[r + 1]]).split(b"\n")
        out[r, kinds + 8] = 1 - len(set(lines)) / len(lines)
    return out


#: Columns of features() and their types.
FEATURES = {"doc_id": "long", "x": "array<float>", "lang": "int", "source": "int", "chars": "double", "known": "boolean"}


def features(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, chars_col: str) -> tuple[DataFrame, list[str]]:
    """docs with columns of FEATURES, and their names there: x of TEXT_FEATURES, lang and source as buckets of their hashes,
    chars as the log of n_chars, and whether that is known. Texts are looked at about 256 KB at a time, a longer one by itself."""
    bucket = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(BUCKETS - 1)) + 1).cast("int")
    known = F.col(chars_col).isNotNull()
    names = fresh(docs, *(f"q_{c}" for c in FEATURES))
    text = fresh(docs, "q_text")[0]
    own = [
        F.col(id_col).cast("long"),
        F.lit(None).cast("array<float>"),
        bucket(lang_col),
        bucket(source_col),
        F.when(known & (F.col(chars_col) >= 0), F.log1p(F.col(chars_col).cast("double"))).otherwise(F.lit(0.0)),
        known,
    ]
    source = docs.withColumns(dict(zip(names, own, strict=True)) | {text: text_or_empty(text_col)})
    at = source.columns.index(names[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.num_columns - 1, 1 << 18):
                x = text_features(batch.column(batch.num_columns - 1)).astype(np.float32)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                columns = batch.columns[:-1]
                columns[at] = flat
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return source.mapInArrow(run, source.drop(text).schema), names


# ---------------------------------------------------------------------------------------------------------------- fitting


@dataclass
class Linear:
    """A logistic view: standardised features, weights with the intercept first, and Platt's slope and intercept."""

    mean: np.ndarray
    sd: np.ndarray
    w: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (self.w[0] + ((x - self.mean) / self.sd) @ self.w[1:]) + self.shift


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: np.ndarray, rounds: int = 25) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (y - p)) - ridge * w
        hess = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_view(x: np.ndarray, y: np.ndarray, weight: np.ndarray, hold_x: np.ndarray, hold_y: np.ndarray, ridge: float = 1.0) -> Linear:
    """A logistic fit, calibrated on rows it hasn't seen."""
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 1e-9, sd, 1.0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    view = Linear(mean, sd, newton(z, y, weight, np.array([1e-3] + [ridge] * x.shape[1])))
    if len(set(hold_y.tolist())) == 2:
        raw = view.logit(hold_x)
        view.shift, view.slope = newton(np.column_stack([np.ones(len(raw)), raw]), hold_y, np.ones(len(raw)), np.array([0.1, 0.1]))
        view.slope = max(view.slope, 0.0)
    return view


def meta_matrix(lang: np.ndarray, source: np.ndarray, chars: np.ndarray, known: np.ndarray) -> np.ndarray:
    one_hot = lambda v: (v[:, None] == np.arange(BUCKETS)[None, :]).astype(float)
    return np.column_stack([one_hot(lang), one_hot(source), chars, chars**2 / 10, known])


def linear_column(view: Linear, terms: list[Column]) -> Column:
    w = view.slope * view.w[1:] / view.sd
    at = view.slope * view.w[0] + view.shift - float(w @ view.mean)
    out = F.lit(float(at))
    for c, term in zip(w.tolist(), terms, strict=True):
        if c:
            out = out + F.lit(c) * term
    return out


SELF = {c: c for c in FEATURES}


def text_logit(view: Linear, names: dict[str, str] = SELF) -> Column:
    return linear_column(view, [F.col(names["x"])[k].cast("double") for k in range(len(TEXT_FEATURES))])


def meta_logit(view: Linear, names: dict[str, str] = SELF) -> Column:
    is_ = lambda c, k: (F.col(names[c]) == k).cast("double")
    terms = [is_("lang", k) for k in range(BUCKETS)] + [is_("source", k) for k in range(BUCKETS)]
    chars = F.col(names["chars"])
    return linear_column(view, [*terms, chars, chars * chars / 10, F.col(names["known"]).cast("double")])


def arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(rows.column("x").to_pylist(), float).reshape(rows.num_rows, len(TEXT_FEATURES))
    get = lambda c: np.array(rows.column(c).to_pylist(), float)
    return x, meta_matrix(get("lang"), get("source"), get("chars"), get("known"))


@dataclass
class CoTrained:
    text: Linear
    meta: Linear
    blend: np.ndarray
    rounds: list[dict[str, int]]

    def score(self, names: dict[str, str] = SELF) -> tuple[Column, Column, Column]:
        """Logits of the text view, the metadata view, and both."""
        t, m = text_logit(self.text, names), meta_logit(self.meta, names)
        return t, m, F.lit(float(self.blend[0])) + F.lit(float(self.blend[1])) * t + F.lit(float(self.blend[2])) * m


def share(n: int, of: int) -> float:
    return min(1.0, n / max(1, of))


def drawn(part: float, *salt: int) -> Column:
    """Whether a hash of the id falls into this share of all hashes."""
    return F.pmod(F.xxhash64("doc_id", *map(F.lit, salt)), F.lit(1 << 30)) < int(part * (1 << 30))


def fit(found: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = FIT_ROWS, rounds: int = ROUNDS, handed: int = HANDED, sure: float = SURE) -> CoTrained:
    """Co-train on the columns of FEATURES.

    Each round both views score all unlabelled documents in Spark. Of those that a view is sure of, about handed of each class,
    drawn by a hash of the id from all of them, join the other view's training rows for good, with the label that the first
    view gave them. A round draws from its own share of the ids, so no document is handed over twice. Of rows that share an id
    the least by features is the labelled one.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    picked = own.where(drawn(share(rows, own.count())))  # a bounded sample of labelled rows
    one = F.min(F.struct("x", "lang", "source", "chars", "known")).alias("r")
    train = found.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(one, F.max("y").alias("y"))
    train = train.orderBy(F.xxhash64("doc_id"), "doc_id").select("r.*", "y").toArrow()
    x, m = arrays(train)
    y = np.array(train.column("y").to_pylist(), float)
    hold = np.arange(len(y)) % 5 == 4
    if len(set(y[~hold].tolist())) < 2:
        flat = lambda n: Linear(np.zeros(n), np.ones(n), np.zeros(n + 1))
        return CoTrained(flat(x.shape[1]), flat(m.shape[1]), np.array([np.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.0, 0.0]), [])
    more: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {"text": [], "meta": []}
    unlabelled = stage_table(found.join(own.select("doc_id"), "doc_id", "left_anti"), "unlabelled")
    edge, history = float(np.log(sure / (1 - sure))), []
    for step in range(rounds + 1):
        views = {}
        for name, all_x in (("text", x), ("meta", m)):
            extra = more[name]
            tx = np.concatenate([all_x[~hold], *[e[0] for e in extra]])
            ty = np.concatenate([y[~hold], *[e[1] for e in extra]])
            weight = np.concatenate([np.ones((~hold).sum()), *[np.full(len(e[1]), 0.3) for e in extra]])
            views[name] = fit_view(tx, ty, weight, all_x[hold], y[hold])
        if step == rounds:
            break
        turn = unlabelled.where(F.pmod(F.xxhash64("doc_id", F.lit(-1)), F.lit(rounds)) == step)
        scored = turn.withColumns({"text_z": text_logit(views["text"]), "meta_z": meta_logit(views["meta"])})
        certain = {(name, label): F.col(f"{name}_z") >= edge if label else F.col(f"{name}_z") <= -edge for name in ("text", "meta") for label in (0, 1)}
        sure_of = scored.agg(*[F.count_if(c).alias(f"{name}{label}") for (name, label), c in certain.items()]).first()
        chosen = {key: c & drawn(share(handed, sure_of[f"{key[0]}{key[1]}"]), step, k) for k, (key, c) in enumerate(certain.items())}
        marked = scored.withColumns({f"{name}{label}": c for (name, label), c in chosen.items()})
        taken = marked.where(reduce(or_, map(F.col, [f"{name}{label}" for name, label in chosen]))).toArrow()
        tx, tm = arrays(taken)
        passed = {}
        for name, other in (("text", "meta"), ("meta", "text")):
            for label in (0, 1):
                rows_of = np.flatnonzero(np.array(taken.column(f"{name}{label}").to_pylist(), bool))
                more[other].append(((tx if other == "text" else tm)[rows_of], np.full(len(rows_of), float(label))))
                passed[f"{name} to {other}, {label}"] = len(rows_of)
        history.append(passed)
    z = np.column_stack([np.ones(hold.sum()), views["text"].logit(x[hold]), views["meta"].logit(m[hold])])
    blend = newton(z, y[hold], np.ones(len(z)), np.array([0.1, 0.1, 1.0])) if len(set(y[hold].tolist())) == 2 else np.array([0.0, 1.0, 0.0])
    return CoTrained(views["text"], views["meta"], blend, history)


COLUMNS = {"id_col": "doc_id", "text_col": "text", "lang_col": "lang", "source_col": "source", "chars_col": "n_chars"}


def judged(docs: DataFrame, labels: DataFrame, columns: dict[str, str], options: dict) -> tuple[DataFrame, CoTrained, DataFrame]:
    """docs with their features, staged, so that features are made once; the model; and the features alone, by FEATURES."""
    made, names = features(docs, **(COLUMNS | columns))
    held = stage_table(made, "quality")
    found = held.select(*[F.col(n).alias(c) for n, c in zip(names, FEATURES, strict=True)])
    model = fit(found, labels, **options)
    own = dict(zip(FEATURES, names, strict=True))
    kept = held.withColumns({n: c for n, c in zip(fresh(held, "z_text", "z_meta", "z_both"), model.score(own), strict=True)})
    return kept, model, found


def score(docs: DataFrame, labels: DataFrame, columns: dict[str, str] | None = None, **options) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) for each row: probabilities that the document is good; keep from one half.

    columns: names of docs' columns where they differ from COLUMNS. Null languages, sources and lengths are categories of their
    own; a null text is empty; a null id keeps its row and is never a training row; repeated rows are scored each; other columns
    are not read. Without labels of both classes every score is the share (good + 1) / (labels + 2): one half without any, which
    keeps all. An empty table gives an empty result.
    """
    names = COLUMNS | (columns or {})
    kept, _, _ = judged(docs.select(*dict.fromkeys(names.values())), labels, names, options)
    p = lambda c: 1 / (1 + F.exp(-F.col(c)))
    t, m, z = kept.columns[-3:]
    return kept.select(F.col(names["id_col"]).cast("long").alias("doc_id"), p(t).alias("text_score"), p(m).alias("meta_score"), p(z).alias("score")).withColumn("keep", F.col("score") >= 0.5)


def keep_good(docs: DataFrame, labels: DataFrame, columns: dict[str, str] | None = None, **options) -> DataFrame:
    """docs without the rows that are rejected; columns as they were, whatever their names. Odd rows as in score().

    Rows are staged with their features, the model is fitted on these, and each row is judged where it lies: no row meets
    another, so nothing is shuffled for the decision.
    """
    kept, _, _ = judged(docs, labels, columns or {}, options)
    return kept.where(F.col(kept.columns[-1]) >= 0).select(*docs.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
