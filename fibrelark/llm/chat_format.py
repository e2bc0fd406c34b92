"""Chat formatting by schema fingerprint.

A record's fingerprint is the hash of its nested field paths. Each known fingerprint
selects a declarative mapping that turns the record into canonical (role, text)
turns; layouts with prompts, instructions, message lists or single turns meet in one
form. Canonical turns are rendered with turn marks; control strings inside texts are
escaped so that they can be read back, and nobody can forge a turn.

The rendered output is a table of segments, one for each turn, with the place of the
loss mask (the assistant's text) in the conversation. Reading back streams through
the segments in order with a parser that only sees characters, so a conversation of
any length takes bounded memory.

Defined results: a null text or role is empty; rows with the same turn are ordered by
their records; a null conv_id is a conversation of its own; records of an unknown
layout become no turns and are listed by ``unknown_layouts``; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fibrelark.llm.common import batches

START, STOP = "<|im_start|>", "<|im_end|>"

# Roles of common layouts and their canonical names.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    ``turns`` has (role, fields) pairs for texts at the top, joined by blank lines;
    ``each`` names a list whose items have a role and a text field. A role that
    starts with ``$`` is read from that field. ``renames`` is for layouts with role
    names of their own.
    """

    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: tuple[str, str, str] | None = None
    renames: bool = False


# Nested field paths of each layout, and its mapping.
LAYOUTS: dict[tuple[str, ...], Mapping] = {
    ("role", "text"): Mapping(turns=(("$role", ("text",)),)),
    ("content", "role"): Mapping(turns=(("$role", ("content",)),)),
    ("messages", "messages[].content", "messages[].role"): Mapping(each=("messages", "role", "content")),
    ("messages", "messages[].content", "messages[].role", "system"): Mapping(turns=(("system", ("system",)),), each=("messages", "role", "content")),
    ("conversations", "conversations[].from", "conversations[].value"): Mapping(each=("conversations", "from", "value"), renames=True),
    ("conversations", "conversations[].from", "conversations[].value", "system"): Mapping(
        turns=(("system", ("system",)),), each=("conversations", "from", "value"), renames=True
    ),
    ("instruction", "output"): Mapping(turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    ("input", "instruction", "output"): Mapping(turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    ("input", "instruction", "output", "system"): Mapping(turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    ("completion", "prompt"): Mapping(turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    ("prompt", "response"): Mapping(turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    ("answer", "question"): Mapping(turns=(("user", ("question",)), ("assistant", ("answer",)))),
    ("context", "instruction", "response"): Mapping(turns=(("user", ("context", "instruction")), ("assistant", ("response",)))),
}


def field_paths(value: object, at: str = "") -> set[str]:
    """Paths of all nested fields; items of a list share one path."""
    out: set[str] = set()
    if isinstance(value, dict):
        for key, inner in value.items():
            path = f"{at}.{key}" if at else str(key)
            out |= {path} | field_paths(inner, path)
    elif isinstance(value, list):
        for inner in value:
            out |= field_paths(inner, f"{at}[]")
    return out


def fingerprint(paths: set[str] | tuple[str, ...]) -> str:
    return hashlib.sha1("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()


MAPPINGS = {fingerprint(paths): mapping for paths, mapping in LAYOUTS.items()}


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical_turns(record: dict) -> list[tuple[str, str]] | None:
    """(role, text) turns of a record, or None if its layout is unknown. An empty list of messages has no turns."""
    paths = field_paths(record)
    mapping = MAPPINGS.get(fingerprint(paths))
    if mapping is None:
        lists = {m.each[0] for m in MAPPINGS.values() if m.each}
        return [] if len(record) == 1 and [] in record.values() and set(record) <= lists else None
    out = []
    for role, fields in mapping.turns:
        texts = [_text(record[f]) for f in fields]
        name = _text(record[role[1:]]) if role.startswith("$") else role
        out.append((name, texts[0] if len(texts) == 1 else "\n\n".join(t for t in texts if t)))
    if mapping.each:
        items, role, text = mapping.each
        for item in record[items]:
            name = _text(item.get(role))
            out.append((ROLES.get(name, name) if mapping.renames else name, _text(item.get(text))))
    return out


_OPENING = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No ``<|`` is left: a backslash goes between, one more if there are some."""
    return _OPENING.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment, and where its text starts and ends in it."""
    head = START + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text)
    return head + body + STOP + "\n", len(head), len(head) + len(body)


def _role(said: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(said))


class Reader:
    """Reads canonical turns back from the characters of a rendered conversation, piece by piece."""

    def __init__(self) -> None:
        self.left = ""

    def feed(self, piece: str) -> list[tuple[str, str]]:
        self.left += piece
        out, at = [], 0
        closing = STOP + "\n"
        while (end := self.left.find(closing, at)) >= 0:
            turn = self.left[at:end]
            if not turn.startswith(START):
                raise ValueError(f"no turn starts at {turn[:40]!r}")
            role, _, text = turn[len(START) :].partition("\n")
            out.append((_role(role), unescape(text)))
            at = end + len(closing)
        self.left = self.left[at:]
        return out


_TURNS = "conv_id long, turn long, record string, part int, role string, text string"


def _canonical(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(parts):
        rows: list[tuple] = []
        for conv_id, turn, record in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            turns = canonical_turns(json.loads(record))
            rows += [(conv_id, turn, record, k, role, text) for k, (role, text) in enumerate(turns or [])]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()]
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _TURNS.split(", ")])


def canonical(records: DataFrame) -> DataFrame:
    """Turns of a table with conv_id, turn and record (JSON of any known layout)."""
    return records.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "record").mapInArrow(_canonical, _TURNS)


def unknown_layouts(records: DataFrame) -> DataFrame:
    """Rows whose layout no mapping knows, with their fingerprint."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            rows = [(c, t, fingerprint(field_paths(json.loads(r)))) for c, t, r in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) if canonical_turns(json.loads(r)) is None]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["conv_id", "turn", "fingerprint"])

    return records.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "record").mapInArrow(run, "conv_id long, turn long, fingerprint string")


_SEGMENTS = "conv_id long, position long, segment string, loss_start long, loss_end long"


def _render(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From turns in order of conversation: their segments, with the loss mask as places in the conversation."""
    conv: object = Reader  # no conversation yet
    position = offset = 0
    for batch in batches(parts):
        rows = []
        for conv_id, role, text in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
            if conv is Reader or conv_id != conv:
                conv, position, offset = conv_id, 0, 0
            segment, start, end = render(role, text)
            masked = role == "assistant"
            rows.append((conv_id, position, segment, offset + start if masked else None, offset + end if masked else None))
            position += 1
            offset += len(segment)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _SEGMENTS.split(", ")])


def format_chat(records: DataFrame) -> DataFrame:
    """Rendered segments of every conversation, in order within a partition; a conversation is in one partition."""
    turns = canonical(records)
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "record", "part")
    return ordered.mapInArrow(_render, _SEGMENTS)


def _digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv: object = Reader
    state: dict = {}

    def fresh() -> dict:
        return {"reader": Reader(), "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}

    def told(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        )

    def row() -> tuple:
        if state["reader"].left:
            raise ValueError(f"conversation {conv} ends within a turn")
        return (conv, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"])

    for batch in batches(parts):
        rows = []
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end")]
        for conv_id, segment, start, end in zip(*columns, strict=True):
            if conv is Reader or conv_id != conv:
                if conv is not Reader:
                    rows.append(row())
                conv, state = conv_id, fresh()
            for role, text in state["reader"].feed(segment):
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if start is not None:
                masked = unescape(segment[start - state["chars"] : end - state["chars"]])
                state["loss_chars"] += len(masked)
                state["loss"].update(masked.encode("utf-8", "surrogatepass"))
            state["chars"] += len(segment)
        yield told(rows)
    if conv is not Reader:
        yield told([row()])


def read_back(segments: DataFrame) -> DataFrame:
    """Counts and digests of every conversation, read from its rendered segments.

    Takes the partitions that ``format_chat`` made. For segments read from files use
    ``ordered_segments`` first.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return segments.mapInArrow(_digest, schema)


def ordered_segments(segments: DataFrame) -> DataFrame:
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segments.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "position")


def turn_records(conversations: DataFrame) -> DataFrame:
    """The table of turns as records of the layout (role, text)."""
    record = F.to_json(F.struct(F.col("role"), F.col("text")), {"ignoreNullFields": "false"})
    return conversations.select("conv_id", "turn", record.alias("record"))
