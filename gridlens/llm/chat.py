"""Chat formatting: schema fingerprints choose declarative mappings to turns; turns are marked, escaped and read back."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import product
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# ------------------------------------------------------------------------------------------------------------- mappings

#: A mapping takes a layout's fields to turns, in order. ("row", role, text, order): the record is one turn itself; ("each", list,
#: role, text, before): the entries of a list field are turns, before stands before their roles; (role, fields): several fields
#: joined by "+" are one text, parts that are empty left out. A field that ends in "?" may be absent.
MAPPINGS: list[dict[str, Any]] = [
    {"name": "turn row", "turns": [("row", "role", "text", "turn")]},
    {"name": "messages", "turns": [("system", "system?"), ("each", "messages", "role", "content", "")]},
    {"name": "messages with text", "turns": [("system", "system?"), ("each", "messages", "role", "text", "")]},
    {"name": "from and value", "turns": [("system", "system?"), ("each", "conversations", "from", "value", "")]},
    {"name": "role and content in conversations", "turns": [("system", "system?"), ("each", "conversations", "role", "content", "")]},
    {"name": "instruction, output", "turns": [("system", "system?"), ("user", "instruction+input?"), ("assistant", "output")]},
    {"name": "instruction, response", "turns": [("system", "system?"), ("user", "instruction+context?"), ("assistant", "response")]},
    {"name": "prompt, completion", "turns": [("system", "system?"), ("user", "prompt"), ("assistant", "completion")]},
    {"name": "prompt, response", "turns": [("system", "system?"), ("user", "prompt"), ("assistant", "response")]},
    {"name": "question, answer", "turns": [("system", "system?"), ("user", "context?+question"), ("assistant", "answer")]},
    {"name": "nested prompt and reply", "turns": [("user", "data.prompt"), ("assistant", "data.reply")]},
    {"name": "messages as prompt, completion", "turns": [("each", "prompt", "role", "content", ""), ("assistant", "completion?")]},
    {"name": "messages as prompt, response", "turns": [("each", "prompt", "role", "content", ""), ("assistant", "response")]},
    {"name": "messages as prompt and completion", "turns": [("each", "prompt", "role", "content", ""), ("each", "completion", "role", "content", "")]},
    {"name": "prompt, chosen, rejected", "turns": [("system", "system?"), ("user", "prompt"), ("assistant", "chosen"), ("rejected", "rejected")]},
    {"name": "chosen and rejected messages", "turns": [("user", "prompt?"), ("each", "chosen", "role", "content", ""), ("each", "rejected", "role", "content", "rejected ")]},
]
#: Fields that say something about a record but are no part of its turns, with all that lies in them. Every other path enters the
#: fingerprint, so a record with a field that no mapping has is kept whole as a raw turn.
ASIDE = {"conv_id", "id", "uuid", "source", "lang", "language", "dataset", "category", "license", "metadata", "created_at"}
#: Names that layouts with lists use for the canonical roles; a turn row's role stays as it is.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def mapping_paths(m: dict[str, Any]) -> Iterator[set[str]]:
    """Every set of paths that a record of the mapping may have: with and without absent fields, with full and empty lists."""
    choices: list[list[set[str]]] = []
    for kind, *rest in m["turns"]:
        if kind == "row":
            choices.append([set(rest)])
        elif kind == "each":
            entries, role, text, _ = rest
            choices.append([{f"{entries}[]", f"{entries}[].{role}", f"{entries}[].{text}"}, {f"{entries}[]"}])
        else:
            choices += [[{f.rstrip("?")}, set()] if f.endswith("?") else [{f}] for f in rest[0].split("+")]
    for one in product(*choices):
        yield set().union(*one)


#: Paths whose values become a text whatever they hold; what lies below them doesn't enter a fingerprint.
TEXTS = {f"{t[1]}[].{t[3]}" for m in MAPPINGS for t in m["turns"] if t[0] == "each"}


def paths(value: Any, nulls: bool, prefix: str = "") -> Iterator[str]:
    """Nested field paths of a record, with or without those of null fields; "[]" stands for the entries of a list, and "[]=" for
    entries that are no objects."""
    if prefix in ASIDE:
        return
    if isinstance(value, dict) and prefix not in TEXTS:
        for k, v in value.items():
            yield from paths(v, nulls, f"{prefix}.{k}" if prefix else k)
    elif isinstance(value, list) and prefix not in TEXTS:
        yield prefix + "[]"
        for v in value:
            if isinstance(v, dict):
                yield from paths(v, nulls, prefix + "[]")
            else:
                yield prefix + "[]="
    elif nulls or value is not None:
        yield prefix


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


#: The first mapping that has a fingerprint gets it.
BY_FINGERPRINT = {fingerprint(own): m for m in reversed(MAPPINGS) for own in mapping_paths(m)}


def as_part(value: Any) -> str:
    """A string, the text of an object that holds nothing else but its type, or JSON."""
    if isinstance(value, str):
        return value
    if isinstance(value, dict) and isinstance(value.get("text"), str) and value.keys() <= {"type", "text"}:
        return value["text"]
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def as_text(value: Any) -> str:
    """A field's text; a list is its parts joined by line feeds, an image or another part without a text being its JSON."""
    if value is None:
        return ""
    return "\n".join(map(as_part, value)) if isinstance(value, list) else as_part(value)


def field(record: Any, path: str) -> str:
    value = record
    for part in path.split("."):
        value = value.get(part) if isinstance(value, dict) else None
    return as_text(value)


def turns_of(record: Any) -> tuple[str, list[tuple[int | None, str, str]]]:
    """The mapping's name and the turns (order, role, text) of one record; of an unknown layout, the whole record as one turn."""
    m = None
    if isinstance(record, dict):
        m = next((m for nulls in (True, False) if (m := BY_FINGERPRINT.get(fingerprint(set(paths(record, nulls)))))), None)
    if m is None:
        return "unmapped", [(0, "raw", json.dumps(record, ensure_ascii=False, sort_keys=True))]
    turns: list[tuple[str, str]] = []
    for kind, *rest in m["turns"]:
        if kind == "row":
            return m["name"], [(record.get(rest[2]), field(record, rest[0]), field(record, rest[1]))]
        if kind == "each":
            entries, role, text, before = rest
            turns += [(before + ROLES.get(field(e, role), field(e, role)), field(e, text)) for e in record[entries]]
        else:
            fields = rest[0].split("+")
            said = "\n\n".join(t for f in fields if (t := field(record, f.rstrip("?"))))
            if said or not all(f.endswith("?") for f in fields):
                turns.append((kind, said))
    return m["name"], [(k, *t) for k, t in enumerate(turns)]


def canonical_turns(records: DataFrame, record_col: str = "record") -> DataFrame:
    """(conv_id, turn, role, text, layout) from JSON records of any known layout.

    A null record, or one that isn't JSON, is one turn of role raw with its text as it stands; a record of no known layout, or with
    a field that its layout doesn't have, is one of its JSON, so no field is lost but those in ASIDE. Where no layout has all of a
    record's fields, its null ones count as absent; null roles and texts are empty; a list of parts is joined, a part that is no text
    as its JSON; an empty list of messages has no turns. A rejected answer is a turn of role rejected. Null conv_ids stay and count
    as one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for raw in batch.column(0).to_pylist():
                try:
                    record = json.loads(raw or "null")
                    key = record.get("conv_id") if isinstance(record, dict) else None
                    layout, turns = turns_of(record)
                except ValueError:
                    key, layout, turns = None, "not json", [(0, "raw", raw or "")]
                out += [(key if isinstance(key, int) else None, *t, layout) for t in turns]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "turn", "role", "text", "layout"])

    return records.select(F.col(record_col).cast("string")).mapInArrow(run, "conv_id long, turn long, role string, text string, layout string")


# ------------------------------------------------------------------------------------------------------------- template

START, MIDDLE, STOP = "<|turn|>", "<|says|>", "<|over|>"
#: Beginnings of control strings of this and of other common templates; inside a text a backslash parts them.
CONTROL = re.compile(r"\\|<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])")
TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(STOP), re.DOTALL)


def escape(text: str) -> str:
    r"""Reversible: \ is doubled, and one follows the first character of a control string, so none is left whole."""
    return CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    """A backslash after a backslash, or after the first character of a control string, goes."""
    return re.sub(r"([\\<\[])\\", r"\1", text)


def format_turn(role: str, text: str) -> str:
    return f"{START}{escape(role)}{MIDDLE}{escape(text)}{STOP}"


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, segment): each turn in the template, in order of turn, then role, then text; a conversation is its segments in
    a row, all in one partition, since one digest runs over all of it: a conversation of any length is streamed by one task,
    never held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            done = [format_turn(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], ["conv_id", "segment"])

    own = turns.select("conv_id", "turn", "role", "text")
    ordered = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, segment string")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation from its formatted text alone: turns, their digest, and what lies under the loss mask (the
    texts of assistant turns), unescaped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, state = None, None

        def close() -> tuple:
            n, turns, loss_chars, loss, chars = state
            return now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            rows = []
            for conv, segment in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        rows.append(close())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(segment)
                for m in TURN.finditer(segment):
                    role, text = unescape(m[1]), unescape(m[2])
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if role == "assistant":
                        state[2] += len(text)
                        state[3].update(text.encode())
            if rows:
                yield batch_of(rows)
        if state is not None:
            yield batch_of([close()])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInArrow(run, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as turn rows, and conversation -7 in the layout of messages."""
    keep = {"ignoreNullFields": "false"}
    rows = table(spark, sf_dir, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text"), keep).alias("record"))
    said = "</s>[INST] ok [/INST]"
    extra = json.dumps({"conv_id": -7, "messages": [{"role": r, "content": said} for r in ("user", "assistant")]})
    records = rows.unionByName(spark.range(1).select(F.lit(extra).alias("record")))
    return read_back(format_turns(canonical_turns(records)))
