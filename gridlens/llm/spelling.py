"""Spelling variants: words one edit apart, met in blocks of a forward and a reversed sorted dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_staged, stage_table, staged, table

#: Code points of a word at least, and occurrences.
SHORTEST, SEEN = 5, 3
#: Words that a block may hold before it is subdivided, as long as what its words don't share is longer than one code point.
BLOCK = 48
#: Of runs whose number this divides, one code point is deleted.
DROPS = 97

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What makes a block: the length of its shorter words, and what they share on the left and on the right.
BLOCK_KEY = ["len", "left", "right", "head", "tail"]


def dictionary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, seen: int = SEEN, drops: int = DROPS) -> DataFrame:
    """(word, n). Counts are combined before they move; a run that is too short for a word is never made a row."""
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{shortest},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    plain = F.octet_length("run") == F.char_length("run")  # no letter beyond ASCII, so lower() changes A-Z only
    each = each.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    each = each.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = each.select(F.when(F.col("h") % drops == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= seen)


def keyed(entries: DataFrame) -> DataFrame:
    return entries.withColumns({"head": F.substring("word", F.lit(1), F.col("left")), "tail": F.expr("right(word, right)")})


def halves(words: DataFrame) -> DataFrame:
    """Each word's four blocks: by its first half and by its last, as the shorter (or equal) and as the longer word of a pair.

    One edit of a word of len code points lies behind its first half, or leaves its last half as it is. A pair whose first halves
    agree (share cap code points) is left to the first kind of block.
    """
    size = F.char_length("word")
    roles = F.array(F.struct(size.alias("len"), F.lit(False).alias("longer")), F.struct((size - 1).alias("len"), F.lit(True).alias("longer")))
    each = words.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.len", "r.longer")
    half = F.floor(F.col("len") / 2).cast("int")
    kinds = F.array(
        F.struct(half.alias("left"), F.lit(0).alias("right"), F.lit(0).alias("cap")),
        F.struct(F.lit(0).alias("left"), (F.col("len") - half).alias("right"), half.alias("cap")),
    )
    return keyed(each.select("*", F.explode(kinds).alias("k")).select("word", "n", "len", "longer", "k.left", "k.right", "k.cap"))


def subdivided(entries: DataFrame) -> DataFrame:
    """The two blocks of each entry of a block that is too large: what lies between the shared ends is halved in the same way."""
    half = F.floor((F.col("len") - F.col("left") - F.col("right")) / 2).cast("int")
    kinds = F.array(
        F.struct((F.col("left") + half).alias("left"), F.col("right"), F.col("cap")),
        F.struct(F.col("left"), (F.col("len") - F.col("left") - half).alias("right"), (F.col("left") + half).alias("cap")),
    )
    return keyed(entries.select("word", "n", "len", "longer", F.explode(kinds).alias("k")).select("word", "n", "len", "longer", "k.left", "k.right", "k.cap"))


def verified(entries: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): pairs of a block one edit apart. Both sides are sorted by block, and the merge scans range by range."""
    mine = entries.where("not longer").select(*BLOCK_KEY, F.col("word").alias("a"), F.col("n").alias("a_n"), "cap")
    other = entries.select(*BLOCK_KEY, F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
    apart = (F.col("cap") == 0) | (F.substring("a", F.lit(1), F.col("cap")) != F.substring("b", F.lit(1), F.col("cap")))
    near = F.levenshtein("a", "b", 1) == 1
    met = mine.hint("merge").join(other, BLOCK_KEY)
    return met.where((F.col("longer") | (F.col("a") < F.col("b"))) & apart & near).select("a", "a_n", "b", "b_n")


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of words(word, n) one edit apart, each once.

    A block of more than block words is subdivided, again and again, until it is small or its words differ in one code point
    only, when the alphabet bounds it. Every pair of a block lies in just one of the two that it is parted into.
    """
    entries, found = halves(words), None
    while True:
        sizes = entries.groupBy(*BLOCK_KEY).count().where((F.col("count") > block) & (F.col("len") - F.col("left") - F.col("right") > 1))
        large = stage_table(sizes.select(*BLOCK_KEY), "large")
        small = verified(entries.join(large, BLOCK_KEY, "left_anti"))
        found = small if found is None else found.unionByName(small)
        if large.isEmpty():
            return found
        entries = stage_table(subdivided(entries.join(large, BLOCK_KEY, "left_semi")), "blocks")


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) for forms(word, form): the end of the chain of forms. Each round doubles the way that is followed."""
    now = stage_table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        mark = staged()
        step = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        ahead = stage_table(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not ahead.where("moved").limit(1).count():
            drop_staged(forms.sparkSession, mark)
            return now
        now = ahead.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts.

    Words are runs of Latin letters (A-Z, a-z, U+00C0-U+00FF), A-Z lower-cased, of at least 5 code points, seen at least 3 times;
    of some runs, as the hash of document and run says, a code point is deleted first. A word's form is the most frequent word one
    edit away (of equal ones the first in code-point order) if that is at least twice as frequent; root is the last form. Every
    row counts, repeated ones too; a null id is empty in the hash, a null or empty text has no runs, a text of any length
    is read whole. An empty table gives an empty result; other columns aren't read.
    """
    words = stage_table(dictionary(docs, id_col, text_col), "words")
    pairs = stage_table(near_pairs(words, block), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    all_words = words.join(best, "word", "left")
    wins: Column = -F.col("best.less") >= 2 * F.col("n")
    all_words = stage_table(all_words.select("word", F.when(wins, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(wins, -F.col("best.less")).alias("form_n")), "forms")
    roots = rooted(all_words.where("form is not null"))
    return all_words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
