"""Column expressions: rates, count maps, signatures, bins, hash order, text forms, tapes. All stay inside Catalyst."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# ------------------------------------------------------------------------------------------------------------------ rates


def rate(count: Column, of: Column) -> Column:
    """count / of, NULL where of is zero or NULL."""
    return F.try_divide(count.cast("double"), of.cast("double"))


def ones(flag: Column) -> Column:
    """How many rows have the flag; NULL flags don't count."""
    return F.coalesce(F.sum(flag.cast("long")), F.lit(0))


def wilson(successes: Column, trials: Column, z: float = 1.959963984540054) -> Column:
    """struct(low, high): Wilson's score interval."""
    p, n, zz = rate(successes, trials), trials.cast("double"), z * z
    centre, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return F.when(n > 0, F.struct(((centre - half) / (1 + zz / n)).alias("low"), ((centre + half) / (1 + zz / n)).alias("high")))


# ------------------------------------------------------------------------------------------------------------- count maps


def sorted_entries(counts: Column) -> Column:
    """A map as an array of (key, value) by key: maps can't be compared, this can."""
    return F.array_sort(F.map_entries(F.coalesce(counts, F.create_map().cast("map<string,bigint>"))))


def signature(qubits: Column, clbits: Column, gates: Column, counts: Column) -> Column:
    """SHA-256 of the canonical JSON of sizes and sorted counts: equal exactly for equal signatures."""
    entries = F.to_json(F.map_from_entries(sorted_entries(counts)))
    return F.sha2(F.concat_ws("|", qubits, clbits, gates, entries), 256)


def map_total(counts: Column, without: str | None = None) -> Column:
    kept = F.map_filter(counts, lambda k, _: F.lower(k) != without) if without else counts
    return F.aggregate(F.map_values(kept), F.lit(0).cast("long"), lambda a, v: a + v.cast("long"))


def entropy(counts: Column) -> Column:
    """Shannon entropy of a count map in nats; zero for an empty one."""
    total = map_total(counts).cast("double")
    part = lambda a, v: a - F.when(v > 0, v / total * F.log(v / total)).otherwise(0.0)
    return F.when(total > 0, F.aggregate(F.map_values(counts), F.lit(0.0), part)).otherwise(0.0)


# ------------------------------------------------------------------------------------------------------------------- bins


#: Gates that join qubits, and gates by an angle.
ENTANGLING = ("cx", "cz", "cp", "ch", "cs", "ct", "ccx", "swap", "rxx", "rzz")
ROTATIONS = ("rx", "ry", "rz", "p", "u", "u1", "u2", "u3", "rxx", "rzz")


def set_flags(counts: Column, gates: Column) -> dict[str, Column]:
    """What kinds of gates a count map has, and whether these are many kinds or many gates."""
    names = F.coalesce(F.map_keys(counts), F.array().cast("array<string>"))
    any_of = lambda group: F.arrays_overlap(names, F.array(*map(F.lit, group)))
    return {
        "has_measure": F.array_contains(names, "measure"), "has_barrier": F.array_contains(names, "barrier"), "has_controlled_or_entangling": any_of(ENTANGLING), "has_rotation": any_of(ROTATIONS),
        "high_gate_diversity": F.size(names) >= 5, "high_gate_count": F.coalesce(gates, F.lit(0)) >= 13,
    }


def bins(value: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """The label of the first edge that is not below the value."""
    out = F.when(F.lit(False), F.lit(""))
    for edge, label in edges:
        out = out.when(value <= edge, label)
    return out.otherwise(last)


#: Fixed values: (upper edge, label) and the label beyond.
WIDTH_BINS = ([(2, "1-2 qubits"), (3, "3 qubits"), (4, "4 qubits"), (8, "5-8 qubits")], "9+ qubits")
COUNT_BINS = ([(4, "2-4 gates"), (8, "5-8 gates"), (12, "9-12 gates"), (20, "13-20 gates")], "21+ gates")
DIVERSITY_BINS = ([(2, "1-2 gate types"), (4, "3-4 gate types")], "5+ gate types")
CLBIT_BINS = ([(0, "0 clbits"), (2, "1-2 clbits"), (3, "3 clbits")], "4+ clbits")
TYPE_BINS = ([(2, "1-2"), (4, "3-4")], "5+")
#: Exact numbers first; what lies between them falls to the next edge.
EXACT_BINS = [(0, "0"), (1, "1"), (2, "2")]
NUMERIC_BINS = [(4, "3_4"), (9, "5_9"), (24, "10_24"), (49, "25_49"), (99, "50_99"), (249, "100_249"), (999, "250_999")]


def numeric_bin(raw: Column) -> Column:
    """A label for any raw value: missing, not a number, negative, or the class its number falls in."""
    x = raw.try_cast("double")
    out = F.when(raw.isNull() | F.isnan(x), "<missing>").when(x.isNull(), "<non_numeric>").when(x < 0, "negative")
    for number, label in EXACT_BINS:
        out = out.when(x == number, label)
    return out.otherwise(bins(x, NUMERIC_BINS, "1000_plus"))


def normal_value(raw: Column) -> Column:
    """A value as a token: missing, empty, or trimmed."""
    text = F.trim(raw.cast("string"))
    return F.when(raw.isNull(), "<missing>").when(text == "", "<empty>").otherwise(text)


# ------------------------------------------------------------------------------------------------------------- hash order


def hash_order(*parts: Column | str) -> Column:
    """Orders rows as the integer of a SHA-256 would: the hex digest sorts the same way. Parts are joined by NUL."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def draw(replicate: Column, i: Column, size: Column | int) -> Column:
    """A reproducible draw of 0 .. size-1 for (replicate, i), the same in any engine that has SHA-256."""
    digest = F.sha2(F.concat_ws(":", replicate, i), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % (F.lit(size) if isinstance(size, int) else size)


def average_rank(value: Column, *within: str | Column, descending: bool = False) -> Column:
    """Ranks from 1 where ties share the mean of their ranks."""
    order = value.desc() if descending else value.asc()
    own = Window.partitionBy(*within)
    ties = F.count("*").over(Window.partitionBy(*within, value))
    return F.rank().over(own.orderBy(order)) + (ties - 1) / 2.0


# ------------------------------------------------------------------------------------------------------------------- text

#: Letters that stand for words, the token pattern, and words that say nothing.
GREEK = (("π", " pi "), ("θ", " theta "), ("λ", " lambda "), ("φ", " phi "), ("Φ", " phi "))
TOKEN = r"[A-Za-z_][A-Za-z_0-9]*|\d+(?:\.\d+)?"
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "both", "by", "create", "for", "from", "in", "into", "is", "it", "make", "of", "on", "or", "that", "the", "then", "this", "to", "using", "with",
)
#: Single characters that stay, in text and in code.
SHORT_TOKENS = ("h", "x", "y", "z", "s", "t", "u")
SHORT_CODE_TOKENS = ("h", "x", "y", "z", "s", "t")
#: Kinds of instruction by pattern, and the label of those that match none.
FAMILIES = {
    "teleportation": r"teleport",
    "bell_or_superdense": r"\bbell\b|superdense",
    "ghz": r"\bghz\b",
    "fourier_qft_phase": r"qft|fourier|controlled-phase|controlled phase",
    "deutsch_jozsa": r"deutsch",
    "bernstein_vazirani": r"bernstein",
    "simon": r"\bsimon\b",
    "grover_setup": r"\bgrover\b",
    "error_correction": r"bit-flip|bit flip|phase-flip|phase flip|error-correction|error correction",
    "vqc_ansatz": r"vqc|variational|ansatz",
    "oracle_logic": r"oracle|x-cx-x|x.cx.x",
    "arithmetic_toffoli": r"half-adder|half adder|toffoli|ccx",
    "qkd_e91": r"\be91\b|qkd",
    "pauli_measurement": r"pauli|measure|measurement",
    "deep_mixed_rotation": r"deep gate sequence|rxx|rzz|swap",
}
NO_FAMILY = "generic_or_low_level"


def normal_text(text: Column) -> Column:
    for letter, word in GREEK:
        text = F.replace(text, F.lit(letter), F.lit(word))
    return text


#: TOKEN's matches in the parts that tokens() makes of them: a number that no identifier holds, or a piece of one.
TOKEN_PART = r"(?<![A-Za-z_0-9])\d+(?:\.\d+)?|[A-Z]+[a-z0-9]*|[a-z0-9]+"


def tokens(text: Column) -> Column:
    """Identifiers and numbers; identifiers part at _ and at a change to upper case; lower case; without stop words and single
    characters other than SHORT_TOKENS."""
    parts = F.split(F.lower(F.array_join(F.regexp_extract_all(normal_text(text), F.lit(TOKEN_PART), F.lit(0)), " ")), " ")
    return F.filter(parts, lambda w: (w != "") & ~w.isin(*STOP_WORDS) & ((F.length(w) > 1) | w.isin(*SHORT_TOKENS)))


def code_tokens(text: Column, most: int = 400) -> Column:
    raw = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)
    return F.slice(F.filter(raw, lambda w: (F.length(w) > 1) | w.isin(*SHORT_CODE_TOKENS)), 1, most)


def each_of(df: DataFrame, values: Column, name: str, *keys: str | Column) -> DataFrame:
    """(keys, name): a row for each element of an array that isn't null. An inner explode would have Catalyst filter on the array's
    size first, and that makes an array that comes from a text a second time."""
    return df.select(*keys, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def word_ngrams(words: Column, n: int = 2, sep: str = "__") -> Column:
    """Words followed by n-grams of neighbours, for n = 2."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(sep, a, b))
    return F.when(F.size(words) > 1, F.concat(words, pairs)).otherwise(words)


def padded_text(text: Column) -> Column:
    """Lower-cased, spaces squeezed, padded by one space on either side."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(normal_text(text)), r"\s+", " ")), F.lit(" "))


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of a text as padded_text() has it."""
    padded = padded_text(text)

    def grams(chars: Column) -> Column:
        each = lambda n: F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(*[chars[i + k] for k in range(n)]))
        return F.concat(*[F.when(F.size(chars) >= n, each(n)).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)])

    # the characters are taken apart once for all n-grams
    return F.transform(F.array(F.regexp_extract_all(padded, F.lit("(?s)."), F.lit(0))), grams)[0]


def strip_fence(text: Column) -> Column:
    """The inside of the first fenced block, or the text, trimmed."""
    inside = F.regexp_extract(text, r"(?is)```(?:python|py)?\s*(.*?)```", 1)
    body = F.when(text.rlike(r"(?is)```(?:python|py)?\s*(.*?)```"), inside).otherwise(text)
    return F.regexp_replace(body, r"\A\s+|\s+\z", "")


def normal_code(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normal_lines(text: Column) -> Column:
    """Line ends as \\n, no space at line ends, runs of blank lines as one, no outer fence, trimmed."""
    body = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    body = F.regexp_replace(body, r"(?is)\A\s*```(?:python|py)?[ \t]*\n(.*?)\n?```\s*\z", "$1")
    body = F.regexp_replace(body, r"(?m)[ \t]+$", "")
    return F.regexp_replace(F.regexp_replace(body, r"\n{3,}", "\n\n"), r"\A\s+|\s+\z", "")


def ascii_text(json: Column) -> Column:
    """JSON text with everything beyond ASCII as \\uxxxx in lower case, a character beyond the first plane as two of them."""
    escaped = lambda x: F.regexp_replace(F.lower(F.hex(F.encode(x, "UTF-16BE"))), "(.{4})", r"\\u$1")
    runs = F.regexp_extract_all(json, F.lit(r"[\x00-\x7E]+|[^\x00-\x7E]+"), F.lit(0))
    out = F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^[\x00-\x7E]"), x).otherwise(escaped(x))), "")
    for digit in "ABCDEF":  # control characters come with a capital
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}")
    return out


def ascii_json(value: Column) -> Column:
    """Compact JSON in ASCII of a struct whose fields are in order; nulls are left out."""
    return ascii_text(F.to_json(value))


def json_text(text: Column) -> Column:
    """A text as JSON, in ASCII and in its quotes."""
    whole = F.to_json(F.struct(text.alias("v")))
    return ascii_text(F.substring(whole, F.lit(6), F.length(whole) - 6))


def text_digest(text: Column) -> Column:
    """SHA-256 of a text; an empty one has an empty digest."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(F.sha2(text, 256))


def short(text: Column, most: int = 220) -> Column:
    """The text on one line, cut to most characters."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(line)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def any_labels(text: Column, patterns: dict[str, str] = FAMILIES, default: str = NO_FAMILY) -> Column:
    """Every label whose pattern the text has, or the default."""
    found = F.filter(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(k)) for k, p in patterns.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


# ------------------------------------------------------------------------------------------------------------------- tape


def parameter_token(raw: Column) -> Column:
    """struct(kind, value) of a parameter: a number rounded to twelve places, nan, inf or -inf; anything else stays as it stands."""
    x = raw.try_cast("double")
    shown = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(F.round(x, 12).cast("string"))
    return F.when(x.isNull(), F.struct(F.lit("symbolic").alias("kind"), raw.alias("value"))).otherwise(F.struct(F.lit("numeric").alias("kind"), shown.alias("value")))


def phase_equal(a: Column, b: Column) -> Column:
    """Whether two phase tokens are equal: numbers up to whole turns within 1e-10, others as they stand."""
    x, y = a["value"].try_cast("double"), b["value"].try_cast("double")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    turn = 2 * math.pi
    apart = F.abs(F.pmod(x - y + math.pi, F.lit(turn)) - math.pi)
    numbers = (a["kind"] == "numeric") & finite(x) & finite(y)
    return (a["kind"] == b["kind"]) & F.when(numbers, apart <= 1e-10).otherwise(a["value"] == b["value"])


def compare_tapes(a: Column, b: Column, phase_a: Column, phase_b: Column, shape_a: Column, shape_b: Column) -> dict[str, Column]:
    """Equalities of two operation tapes, arrays of struct(name, qubits, clbits, params), with phases as tokens and shapes."""
    pick = lambda t, *f: F.transform(t, lambda x: F.struct(*[x[k].alias(k) for k in f]))
    same = lambda *f: pick(a, *f) == pick(b, *f)
    measures = lambda t: pick(F.filter(t, lambda x: x["name"] == "measure"), "qubits", "clbits")
    shape = shape_a == shape_b
    wires = same("name", "qubits", "clbits")
    ordered = shape & wires
    aware = ordered & same("params")
    phase = phase_equal(phase_a, phase_b)
    return {
        "gate_order_match": same("name"), "quantum_operand_sequence_match": same("qubits"), "classical_operand_sequence_match": same("clbits"),
        "circuit_shape_match": shape, "operation_wire_tape_match": wires, "ordered_wire_tape_match": ordered, "measurement_map_match": measures(a) == measures(b),
        "parameter_token_sequence_match": same("params"), "parameter_aware_tape_match": aware, "global_phase_match": phase, "full_literal_circuit_match": aware & phase,
    }
