"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a span classifier decides. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, stage_table, table, text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("ssn", "iban", "person")
KINDS = BASE_KINDS + MORE_KINDS
LABELERS = ("format", "gazetteer", "context", "border")
#: Characters before a span in which the context labeler looks.
CONTEXT = 48

# Where a quantifier is possessive or a look-behind stands, what follows can't match what it took, so matches are those of
# the plain pattern, found in time linear in the text: a failed start within a run of the same characters isn't tried anew.
#: Fixed values.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?",
}
#: A text that doesn't match this holds no span of the kind; cheaper than the pattern.
GUARDS: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"(?:[0-9][\x20-]?){12}[0-9]"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "ssn": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    "person": lambda t: t.rlike(r"(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z]"),
}
#: First and family names that are common in English, German, Spanish and French.
NAMES = """
Adam Alexander Alice Amanda Andrea Andrew Angela Anna Anne Anthony Antonio Barbara Benjamin Brian Carlos Carmen Carol Caroline Catherine
Charles Charlotte Christian Christine Christopher Claire Claudia Daniel David Deborah Dennis Diego Donald Dorothy Edward Elena Elizabeth
Emily Emma Eric Eva Florian Frank Gabriel George Hannah Helen Henri Ines Isabel Jack Jacob James Jane Jason Jean Jeffrey Jennifer Jessica
Joan John Jonas Jonathan Jorge Joseph Juan Julia Julie Karen Karl Katharina Kenneth Kevin Klaus Laura Lea Leon Linda Lisa Louis Lucas
Lucia Luis Luke Margaret Maria Marie Mark Markus Martha Martin Mary Matthew Max Michael Miguel Monica Nancy Natalie Nicolas Nicole Olivia
Oscar Pablo Patricia Paul Pedro Peter Philip Pierre Rachel Rebecca Richard Robert Rosa Ruth Samuel Sandra Sara Sarah Simon Sophie Stefan
Stephen Steven Susan Thomas Timothy Ursula Victor Victoria William Wolfgang
Bauer Becker Bernard Brown Clark Davis Diaz Dubois Durand Evans Fernandez Fischer Garcia Gonzalez Green Hall Harris Hernandez Hill Hoffmann
Jackson Johnson Jones King Klein Koch Lefebvre Leroy Lewis Lopez Martinez Meyer Miller Moore Moreau Moreno Morris Mueller Müller Parker
Perez Petit Richter Rivera Robinson Rodriguez Roberts Romero Sanchez Schmidt Schneider Schulz Scott Smith Taylor Thompson Torres Turner
Wagner Walker Weber White Williams Wilson Wolf Wright Young Zimmermann
"""
#: Gazetteers as patterns on a span, and words before a span that speak for or against its kind.
GAZETTEER = {
    "email": r"(?i)@(?:gmail|yahoo|hotmail|outlook|icloud|aol|proton(?:mail)?|gmx|web|mail[0-9]*|example)\.|\.(?:com|org|net|edu|gov|de|fr|es|it|uk|eu|io|info)$",
    "ip": r"^(?!0+\.)(?!127\.)(?!255\.)(?!22[4-9]\.)(?!23[0-9]\.)[0-9]",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9])|35|30[0-5]|36|38)",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "iban": r"^(?:AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK)",
    "person": r"\b(?:" + "|".join(NAMES.split()) + r")\b",
}
SPEAKS_FOR = {
    "email": r"(?i)e-?mail|contact|write|mail to|reach|@",
    "ip": r"(?i)\bip\b|address|host|server|client|login|from",
    "card": r"(?i)card|visa|master|amex|payment|credit|debit|number",
    "phone": r"(?i)phone|tel|call|mobile|fax|whatsapp|contact|dial",
    "ssn": r"(?i)ssn|social|security",
    "iban": r"(?i)iban|account|bank|konto|transfer",
    "person": r"(?i)contact|signed|dear|by|from|with|name",
}
SPEAKS_AGAINST = {
    "email": r"(?i)regex|pattern|placeholder",
    "ip": r"(?i)version|release|build|section|chapter",
    "card": r"(?i)order|invoice|isbn|serial|tracking|hash",
    "phone": r"(?i)formula|equals|score|offset",
    "ssn": r"(?i)part|model|serial|invoice",
    "iban": r"(?i)serial|licen[cs]e|key",
    "person": r"(?i)street|avenue|company",
}


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass Luhn's test: from the right, every second one doubled, nine taken off what exceeds it."""

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    values = F.transform(F.split(F.reverse(number), ""), weigh)
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """What a match must pass to be a base span; further kinds need nothing more."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        small = lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255"))
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return F.length(digits(value)).between(13, 19) & luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def format_vote(kind: str, value: Column) -> Column:
    """A stricter form than the pattern's: well-formed parts, usual lengths and groups."""
    strict = {
        "email": value.rlike(r"^[A-Za-z0-9][^@]*+@(?:[A-Za-z0-9][A-Za-z0-9-]*+\.)++[A-Za-z]{2,}$") & ~value.contains(".."),
        "ip": ~value.rlike(r"(?:^|\.)0[0-9]"),
        "card": value.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5})$"),
        "phone": value.rlike(r"^\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,4}$"),
        "ssn": F.lit(True),
        "iban": F.length(F.regexp_replace(value, " ", "")).between(15, 34),
        "person": value.rlike(r"\x20[A-Z][a-z]+\x20[A-Z]"),
    }[kind]
    return F.when(strict, 1).otherwise(-1)


def votes(kind: str, value: Column, before: Column, after: Column) -> list[Column]:
    """+1 for, -1 against, 0 no opinion, of each of LABELERS."""
    known = F.when(value.rlike(GAZETTEER[kind]), 1).otherwise(-1 if kind in ("ssn", "ip") else 0)
    context = F.when(before.rlike(SPEAKS_AGAINST[kind]), -1).when(before.rlike(SPEAKS_FOR[kind]), 1).otherwise(0)
    clean = ~before.rlike(r"[A-Za-z0-9_]$") & ~after.rlike("^[A-Za-z0-9_]")
    return [format_vote(kind, value), known, context, F.when(clean, 1).otherwise(-1)]


#: What the span classifier knows beside the votes: length in tens, what stands on either side, share of digits in quarters,
#: and parts between marks, each up to a largest value.
SHAPES = {"size": 3, "ahead": 4, "behind": 4, "numeric": 4, "parts": 4}
SPAN = "struct<kind:string,start:bigint,end:bigint," + ",".join(f"{v}:int" for v in (*SHAPES, *LABELERS)) + ">"
#: Matches that are placed together; what is copied grows with this and not with the matches of a text.
TOGETHER = 128


def side(c: Column) -> Column:
    """Class of the character beside a span: none, white space, bracket or quote, word character, other."""
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[()\[\]{}<>\"']"), 2).when(c.rlike(r"\w"), 3).otherwise(4)


def shapes(value: Column, before: Column, after: Column) -> list[Column]:
    """The values of SHAPES."""
    return [
        F.least(F.lit(3), (F.length(value) / 10).cast("int")),
        side(F.right(before, F.lit(1))),
        side(after),
        (4 * F.length(digits(value)) / F.greatest(F.length(value), F.lit(1))).cast("int"),
        F.least(F.lit(4), F.length(F.regexp_replace(value, r"[A-Za-z0-9]+", ""))),
    ]


def spans_of(kind: str, text: Column) -> Column:
    """Spans of a kind with shapes and votes, in order. Matches and what lies between them alternate, so lengths add up to places.

    They are added up in stretches of TOGETHER matches, and a span looks at the text between it and its neighbours, so the work
    is in proportion to the text however many matches it has.
    """

    def placed(p: Column) -> Column:
        gaps, hits = p["gap"], p["hit"]
        pieces = F.transform(hits, lambda h, i: F.struct(gaps[i].alias("gap"), h.alias("hit"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("next")))
        long = lambda x: F.length(x["gap"]) + F.length(x["hit"])
        many = F.ceil(F.size(hits) / TOGETHER).cast("int")
        stretches = F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.slice(pieces, k * TOGETHER + 1, F.lit(TOGETHER)))
        sized = F.transform(stretches, lambda s: F.struct(s.alias("s"), F.aggregate(s, F.lit(0), lambda a, x: a + long(x)).alias("n")))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(sized, none, lambda a, x: F.struct((a["at"] + x["n"]).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")))["starts"]
        empty = F.array().cast("array<struct<s:int,v:string,b:string,a:string>>")

        def one(s: Column, at: Column) -> Column:
            def add(acc: Column, x: Column) -> Column:
                begin = acc["at"] + F.length(x["gap"])
                put = F.array(F.struct(begin.alias("s"), x["hit"].alias("v"), F.right(x["gap"], F.lit(CONTEXT)).alias("b"), F.coalesce(x["next"], F.lit("")).alias("a")))
                return F.struct((begin + F.length(x["hit"])).alias("at"), F.concat(acc["out"], put).alias("out"))

            return F.aggregate(s["s"], F.struct(at.alias("at"), empty.alias("out")), add)["out"]

        return F.when(F.size(hits) > 0, F.flatten(F.zip_with(sized, starts, one))).otherwise(empty)

    both = F.struct(F.split(text, PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("hit"))
    found = F.filter(F.transform(F.array(both), placed)[0], lambda x: valid(kind, x["v"]))

    def voted(x: Column) -> Column:
        values = dict(zip(SHAPES, shapes(x["v"], x["b"], x["a"]), strict=True)) | dict(zip(LABELERS, votes(kind, x["v"], x["b"], x["a"]), strict=True))
        start = x["s"].cast("long")
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["v"])).alias("end"), *[v.cast("int").alias(name) for name, v in values.items()])

    return F.when(GUARDS[kind](text), F.transform(found, voted)).otherwise(F.array().cast(f"array<{SPAN}>")).cast(f"array<{SPAN}>")


def candidates(text: Column) -> Column:
    return F.concat(*[spans_of(k, text) for k in KINDS])


# ----------------------------------------------------------------------------------------------------------- reliability


@dataclass
class SpanModel:
    """Weights of the final span classifier, by (feature, value), and of each labeler how often it is right about true and false spans."""

    weights: dict[tuple[str, str | int], float]
    reliability: dict[str, tuple[float, float]]

    def logit(self, x: Column) -> Column:
        out = F.lit(0.0)
        for name in ("kind", *SHAPES, *LABELERS):
            own = [F.lit(v) for (f, value), w in self.weights.items() if f == name for v in (value, w)]
            out = out + F.coalesce(F.try_element_at(F.create_map(*own), x[name]), F.lit(0.0))
        return out


def fit(counts: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], rounds: int = 50) -> SpanModel:
    """From (kind, shapes, votes, spans): EM for the labelers' reliabilities, then a logistic fit on what EM believes.

    EM sees kinds and votes; the classifier sees the shapes too, so it also says something of spans on which no labeler has an
    opinion. The input has a row for each combination, a few thousand at any corpus size.
    """
    kinds = np.array([KINDS.index(k) for k, *_ in counts], int)
    vote = np.array([v for _, _, v, _ in counts], int).reshape(len(counts), len(LABELERS))
    c = np.array([n for *_, n in counts], float)
    based = np.array([k in BASE_KINDS for k in KINDS])
    prior = np.where(based, 8.0, 5.0)
    share = np.where(based, 0.8, 0.5)
    # rate[j, y, v + 1]: how often labeler j votes v on spans that are (y = 1) or aren't personal data
    rate = np.tile(np.array([[0.4, 0.4, 0.2], [0.1, 0.2, 0.7]]), (len(LABELERS), 1, 1))
    post = share[kinds]
    for _ in range(rounds):
        yes, no = np.log(share[kinds]), np.log(1 - share[kinds])
        for j in range(len(LABELERS)):
            yes, no = yes + np.log(rate[j, 1, vote[:, j] + 1]), no + np.log(rate[j, 0, vote[:, j] + 1])
        post = 1 / (1 + np.exp(np.clip(no - yes, -500, 500)))
        for j in range(len(LABELERS)):
            for y, mass in ((0, c * (1 - post)), (1, c * post)):
                seen = np.bincount(vote[:, j] + 1, mass, 3) + np.where(np.arange(3) == 2 * y, 3.0, 1.0)
                rate[j, y] = seen / seen.sum()
        share = np.clip((prior + np.bincount(kinds, c * post, len(KINDS))) / (10 + np.bincount(kinds, c, len(KINDS))), 0.005, 0.995)
    names = [("kind", k) for k in KINDS] + [(f, v) for f, top in SHAPES.items() for v in range(top + 1)] + [(f, v) for f in LABELERS for v in (1, -1)]
    x = np.zeros((len(counts), len(names)))
    for r, (kind, shape, own, _) in enumerate(counts):
        for key in (("kind", kind), *zip(SHAPES, shape, strict=True), *((f, v) for f, v in zip(LABELERS, own, strict=True) if v)):
            x[r, names.index(key)] = 1
    w = np.zeros(len(names))
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (c * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + np.eye(len(names))
        step = np.linalg.solve(hess, x.T @ (c * (post - q)) - w)
        w += step * min(1.0, 3 / max(1e-9, float(np.abs(step).max())))
    return SpanModel(dict(zip(names, w.tolist(), strict=True)), {f: (float(rate[j, 1, 2]), float(rate[j, 0, 0])) for j, f in enumerate(LABELERS)})


def fit_on(spans: DataFrame) -> SpanModel:
    """Fit on all spans of a table with a column spans."""
    names = ["kind", *SHAPES, *LABELERS]
    each = spans.select(F.explode("spans").alias("s")).select(*[f"s.{v}" for v in names])
    rows = each.groupBy(*names).agg(F.count("*").alias("c")).orderBy(*names).collect()
    return fit([(r.kind, tuple(r[v] for v in SHAPES), tuple(r[v] for v in LABELERS), r.c) for r in rows])


def decided(spans: Column, model: SpanModel) -> Column:
    """Base spans stay; others stay where the classifier says one half or more. Each gets its probability."""
    kept = F.filter(spans, lambda x: x["kind"].isin(*BASE_KINDS) | (model.logit(x) >= 0))
    return F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (1 / (1 + F.exp(-model.logit(x)))).alias("p")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, SpanModel]:
    """(doc_id, spans array<struct<kind, start, end, p>>) for each row, by kind as in KINDS, then start; and the model.

    Null and empty texts have no spans; null ids and repeated rows keep their rows; other columns are not read; a table without
    a span gives the model of its priors.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = stage_table(source.select("doc_id", candidates(F.col("text")).alias("spans")), "pii")
    model = fit_on(found)
    return found.select("doc_id", decided(F.col("spans"), model).alias("spans")), model


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with each span replaced by its kind in angle brackets, and chars_col, where there is one, the new length.

    Spans that overlap are one, named by the first. A null text stays null, an empty one empty; repeated rows are treated alike;
    all other columns stay as they are, whatever their names. An empty table gives an empty result. Rows are staged with their
    spans, so texts are searched once.
    """
    name = fresh(docs, "spans")[0]
    held = stage_table(docs.withColumn(name, candidates(text_or_empty(text_col))), "pii")
    model = fit_on(held.select(F.col(name).alias("spans")))
    text = text_or_empty(text_col)
    spans = F.array_sort(F.transform(decided(F.col(name), model), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def put(acc: Column, x: Column) -> Column:
        between = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        new = F.struct(x["end"].alias("at"), F.concat(acc["out"], between, F.lit("<"), F.upper(x["kind"]), F.lit(">")).alias("out"))
        wider = F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(x["start"] >= acc["at"], new).otherwise(wider)

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    clean = F.when(F.size(name) == 0, F.col(text_col)).otherwise(F.aggregate(spans, start, put, rest))
    out = held.withColumn(text_col, clean)
    if chars_col in docs.columns:
        changed = (F.size(name) > 0) & F.col(chars_col).isNotNull()
        out = out.withColumn(chars_col, F.when(changed, F.length(text_col).cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col)))
    return out.select(*docs.columns)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = scan(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
