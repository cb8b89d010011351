"""Secret scan: fixed patterns, and strings in a sensitive context that a primed compressor finds new."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_or_empty

KINDS = ("assign", "access", "hex", "novel")
#: Keyword letters count in either case; the value's class has both cases anyway.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: Greedy runs, so a least length in the pattern drops what a test after the match would drop.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

SENSITIVE = re.compile(r"pass(?:word|wd|phrase)|secret|token|api.?key|access.?key|private.?key|credential|auth|bearer|signature|session.?id", re.ASCII | re.IGNORECASE)
#: Characters of a candidate, at least.
LEAST = 16
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Characters after a sensitive word in which a candidate may begin, and of surrounding text that primes the compressor.
REACH, AROUND = 64, 512
#: The rest of the identifier that holds a sensitive word, and the sign before a value written directly after it.
ASSIGNED = re.compile(r"[A-Za-z0-9_-]{0,63}=+")
#: Compressed bytes a byte of the candidate, at least.
NOVEL = 0.7
#: Words that code and configuration are made of; they prime the compressor before the surrounding text.
IDENTIFIERS = (
    "password passwd passphrase secret token api_key apikey access_key private_key public_key credential credentials authorization "
    "authenticate authentication bearer signature session_id client_id client_secret username user_name account default example "
    "placeholder changeme undefined environment variable configuration parameter function return import export require module "
    "connection database hostname localhost development production staging certificate encryption algorithm identifier "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 00000000 11111111 xxxxxxxxxxxxxxxx"
).encode()


def novelty(candidate: str, around: str) -> float:
    """Marginal compressed bytes of the candidate, for each of its bytes, given identifiers and the text around it.

    Copies of the candidate in that text don't count against it: a secret that is printed twice is no less a secret.
    """
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + around.replace(candidate, "").encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False)
    raw = candidate.encode()
    return (len(press.compress(raw)) - len(press.compress(b""))) / len(raw)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def mixed(s: str) -> bool:
    """Letters and digits, or upper and lower case in no order a name would have."""
    letters, digits = any(c.isalpha() for c in s), sum(c.isdigit() for c in s)
    turns = sum(a.islower() and b.isupper() for a, b in zip(s, s[1:], strict=False))
    return (letters and digits >= 2) or turns >= 4


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Values that begin within reach of a sensitive word, to their own end; some are given more than once.

    A value is a whole run of its class, or in a run that holds the word what follows the identifier's '='.
    """
    begin = end = -1  # of the run looked at last: no run is measured again for each word in it
    for word in SENSITIVE.finditer(text):
        at = word.end()
        if assigned := ASSIGNED.match(text, at):
            a = assigned.end()
            if not begin <= a < end:
                run = RUN.match(text, a)
                begin, end = a, run.end() if run else a
            if end - a >= LEAST:
                yield a, end
        for m in CANDIDATE.finditer(text, at, at + REACH + LEAST):
            a = m.start()
            if a and RUN.match(text, a - 1, a):
                continue
            if not begin <= a < end:
                begin, end = a, RUN.match(text, a).end()
            own = SENSITIVE.search(text, a, min(end, a + REACH))
            mark = own and ASSIGNED.match(text, own.end(), end)
            if mark and end - mark.end() >= LEAST:
                yield a, own.start()  # the run holds a word and its value; that word gives it
            else:
                yield a, end


def merged(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Begins and ends of the stretches that spans cover, in order."""
    begins: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    return begins, ends


def left_over(a: int, b: int, begins: list[int], ends: list[int]) -> Iterator[tuple[int, int]]:
    """What the stretches leave of a .. b."""
    k = bisect_right(ends, a)
    while k < len(begins) and begins[k] < b:
        if begins[k] > a:
            yield a, begins[k]
        a, k = max(a, ends[k]), k + 1
    if a < b:
        yield a, b


def novel_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Of candidates near a sensitive word what base spans leave, if it is long enough and the primed compressor can't shorten it;
    a check that it isn't words written together follows. A value that occurs several times is judged at each place."""
    out, done = [], -1
    begins, ends = merged(taken)
    for a, b in sorted(set(candidates(text))):
        if a < done:
            continue
        done = b
        for x, y in left_over(a, b, begins, ends):
            if y - x >= LEAST and novelty(text[x:y], text[max(0, x - AROUND) : x] + text[y : y + AROUND]) >= NOVEL and mixed(text[x:y]):
                out.append(("novel", x, y))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) by start, then kind as in KINDS; code points, end exclusive.

    Spans of a kind beyond the base overlap no base span; what is left of a value that a base span cuts is judged by itself. Null
    and empty texts have no spans; null ids and repeated rows keep their rows; other columns are not read.
    """
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 8 << 20):
                out = []
                for text in batch.column(1).to_pylist():
                    base = base_spans(text)
                    found = sorted(base + novel_spans(text, base), key=lambda s: (s[1], KINDS.index(s[0])))
                    out.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, spans)], ["doc_id", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"] != "novel")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", *map(count, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans")
    )
