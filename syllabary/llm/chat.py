"""Chat formatting: records of many layouts become canonical turns, and turns become text with a loss mask.

The layout of a record is known by its schema fingerprint: a hash of its nested field paths, array elements written ``[]``. A
fingerprint selects a declarative mapping (``Mapping``): where the turns are, which fields hold role and text, or which single
fields are a prompt and its answer. The fingerprints of the mappings' own layouts are known from the start (``registry``). Records
carry more fields than a mapping needs, so other fingerprints are entered as they are met: of each distinct one, once, the mapping
of most paths that the layout holds, or none (``choose``). Records then find their mapping by their fingerprint alone, in a join with
that table (``canonical_turns``), as a table of turns does by its schema (``turn_rows``).

Formatted text marks turns with two strings. Wherever a control string begins in a text, a backslash is put after its first
character, and backslashes of the text are doubled, so no text can be taken for a mark and every text can be had back. The
loss mask is one span for each assistant text.

A conversation is written as one row a turn, in order; formatted text of a conversation is those rows joined. So a conversation
of any length streams through sorted partitions and none is gathered.

Null roles and texts are empty; rows without a turn come first, equal turns are ordered by role and text and all kept; a null
conv_id is a conversation of its own; an empty table gives no rows; fields beyond the layout's change nothing. An array without
turns gives no rows. A record that is no JSON, nests too deep or has a layout that no mapping knows gives a row with null role and
text, never an error; lone surrogates become replacement characters. A table of an unknown layout is an error.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syllabary.llm.common import Scratch, together

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that some template takes for control.
CONTROLS = (START, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_BEGINS = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)", re.S)
_ESCAPED = re.compile(r"\\(\\?)")


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``paths``: the nested field paths that make its fingerprint. ``turns``: the array that holds the turns, or None for a record
    that is one turn (``conv``, ``turn``, ``role``, ``text`` are field names) or a fixed dialogue (``fixed``: (role, field) pairs,
    empty ones skipped). Roles have other names translated but in records of one turn.
    """

    name: str
    paths: tuple[str, ...]
    turns: str | None = None
    conv: str | None = None
    turn: str | None = None
    role: str | None = None
    text: str | None = None
    fixed: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def fingerprint(paths) -> str:
    """A hash of nested field paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


MAPPINGS = (
    Mapping("turn rows", ("conv_id", "turn", "role", "text"), conv="conv_id", turn="turn", role="role", text="text"),
    Mapping("messages", ("messages[].role", "messages[].content"), turns="messages", role="role", text="content"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value"),
    Mapping("prompt and response", ("prompt", "response"), fixed=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt and completion", ("prompt", "completion"), fixed=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("question and answer", ("question", "answer"), fixed=(("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", ("instruction", "input", "output"), fixed=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("instruction with system", ("system", "instruction", "input", "output"), fixed=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
)
#: Other names of the roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def schema_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a Spark type."""
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{at}[]")
    return [at]


def registry(mappings: tuple[Mapping, ...]) -> dict[str, Mapping]:
    """The mappings by the fingerprints of their own layouts; of two with one, the first."""
    return {m.fingerprint: m for m in reversed(mappings)}


def value_paths(value, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; null fields count as present."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in value_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in value_paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def choose(paths, mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping | None:
    """The mapping of a layout: by its fingerprint, if that is a mapping's own; else of those whose paths it holds the one of most paths,
    then the first, as it is entered under the layout's fingerprint."""
    paths = set(paths)
    if (own := registry(mappings).get(fingerprint(paths))) is not None:
        return own
    for mapping in sorted(mappings, key=lambda m: -len(m.paths)):
        # An array without elements shows none of their fields.
        empty = mapping.turns and f"{mapping.turns}[]" in paths and not any(p.startswith(f"{mapping.turns}[].") for p in paths)
        if empty or paths.issuperset(mapping.paths):
            return mapping
    return None


def turn_rows(table: DataFrame, conv_id: str = "conv_id", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``conv_id, turn, role, text`` of a table, by the mapping that the fingerprint of its schema selects.

    A table whose rows hold whole conversations names them by the column ``conv_id``.
    """
    mapping = choose(schema_paths(table.schema), mappings)
    if mapping is None:
        raise ValueError("no mapping for a table with these columns: " + ", ".join(schema_paths(table.schema)))
    if mapping.role and not mapping.turns:
        return table.select(F.col(mapping.conv).alias("conv_id"), F.col(mapping.turn).alias("turn"), _filled(F.col(mapping.role)).alias("role"), _filled(F.col(mapping.text)).alias("text"))
    if mapping.turns:
        turns = F.transform(F.col(mapping.turns), lambda t: F.struct(_filled(t[mapping.role]).alias("role"), _filled(t[mapping.text]).alias("text")))
    else:
        turns = F.filter(F.array(*[F.struct(F.lit(role).alias("role"), _filled(F.col(field)).alias("text")) for role, field in mapping.fixed]), lambda t: t["text"] != "")
    rows = table.select(F.col(conv_id).alias("conv_id"), F.posexplode(turns).alias("at", "said"))
    return rows.select("conv_id", F.col("at").cast("long").alias("turn"), _role(F.col("said.role")).alias("role"), F.col("said.text").alias("text"))


def _filled(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def _role(role: Column) -> Column:
    """The usual name of a role."""
    out = role
    for other, usual in ROLES.items():
        out = F.when(role == other, usual).otherwise(out)
    return out


_TURNS = "conv_id long, turn long, role string, text string, layout string"
_TURNS_ARROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("layout", pa.string())])
_UNKNOWN = None, [(None, None, None)]


def _text(value) -> str:
    """A JSON value as text that can be encoded."""
    out = "" if value is None else value if isinstance(value, str) else json.dumps(value)
    return out if out.isascii() else out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _parsed(record: str | None) -> dict | None:
    """A record that is a JSON object."""
    try:
        value = json.loads(record or "")
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def record_turns(value: dict, mapping: Mapping) -> tuple[str | None, list[tuple[int | None, str | None, str | None]]]:
    """(layout, turns (number, role, text)) of a record by its mapping."""
    try:
        if mapping.turns:
            if not all(isinstance(x, dict) for x in value[mapping.turns]):
                return _UNKNOWN
            found = [(i, _text(x.get(mapping.role)), _text(x.get(mapping.text))) for i, x in enumerate(value[mapping.turns])]
        elif mapping.role:
            turn = value[mapping.turn]
            number = turn if isinstance(turn, int) and -(1 << 63) <= turn < 1 << 63 else None
            return mapping.name, [(number, _text(value[mapping.role]), _text(value[mapping.text]))]
        else:
            filled = [(role, x) for role, field in mapping.fixed if (x := _text(value[field]))]
            found = [(i, role, x) for i, (role, x) in enumerate(filled)]
        return mapping.name, [(i, ROLES.get(role, role), x) for i, role, x in found]
    except (ValueError, RecursionError, KeyError, TypeError):
        return _UNKNOWN


def _layout(record: str | None) -> tuple[str | None, list[str]]:
    """(fingerprint, paths) of a record; no fingerprint if it is no JSON object or nests too deep."""
    value = _parsed(record)
    try:
        paths = sorted(value_paths(value)) if value is not None else []
        return (fingerprint(paths) if value is not None else None), paths
    except (RecursionError, ValueError):
        return None, []


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records to their distinct layouts, as far as a batch shows: (fingerprint, paths)."""
    for batch in batches:
        met = dict(map(_layout, batch.column(0).to_pylist()))
        met.pop(None, None)
        yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.string()), pa.array(list(met.values()), pa.list_(pa.string()))], names=["fingerprint", "paths"])


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, record) with the record's fingerprint."""
    for batch in batches:
        prints = [_layout(x)[0] for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.string())], names=["conv_id", "record", "fingerprint"])


def known_layouts(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``fingerprint, mapping``: the layouts of ``record``, each once, and the number of the mapping that each selects, if any."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [choose(x, mappings) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if m is None else mappings.index(m) for m in found], pa.int32())], names=["fingerprint", "mapping"])

    met = records.select("record").mapInArrow(_layouts, "fingerprint string, paths array<string>")
    return met.groupBy("fingerprint").agg(F.first("paths").alias("paths")).mapInArrow(enter, "fingerprint string, mapping int")


def canonical_turns(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``conv_id, turn, role, text, layout`` of JSON records (columns conv_id and ``record``).

    The table of layouts is written, so that Spark knows its size when it joins it; one layout may have all records, as there is one
    row of it on the other side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in together(batch, 1):
                rows = []
                for conv_id, text, number in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    layout, found = _UNKNOWN if number is None else record_turns(_parsed(text), mappings[number])
                    rows += [{"conv_id": conv_id, "turn": i, "role": r, "text": t, "layout": layout} for i, r, t in found]
                yield pa.RecordBatch.from_pylist(rows, _TURNS_ARROW)

    plain = records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col(record).cast("string").alias("record"))
    layouts = Scratch(records.sparkSession, "layouts").keep(known_layouts(plain, mappings), "layouts")
    printed = plain.mapInArrow(_printed, "conv_id long, record string, fingerprint string")
    return printed.join(layouts, "fingerprint", "left").select("conv_id", "record", "mapping").mapInArrow(run, _TURNS)


def escape(text: str) -> str:
    """A text in which no control string occurs, and from which ``unescape`` has the text back."""
    return _BEGINS.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, where the loss begins in it, loss characters)."""
    head = f"{START}{escape(json.dumps(role, ensure_ascii=False)[1:-1])}\n"
    body = escape(text)
    learnt = len(body) if role == "assistant" else 0
    return f"{head}{body}{END}\n", len(head), learnt


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    head, _, rest = formatted[len(START) :].partition("\n")
    return json.loads(f'"{unescape(head)}"'), unescape(rest[: -len(END) - 1])


_FORMATTED = "conv_id long, part long, formatted string, loss_start long, loss_length long"


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, part, formatted, loss_start, loss_length``: a row a turn; parts count a conversation's turns from 0 and
    ``loss_start`` is the place in that part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, begun = None, 0, False
        for batch in batches:
            rows = []
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                part = part + 1 if begun and conv_id == conv else 0
                conv, begun = conv_id, True
                rows.append((conv_id, part, *format_turn(role, text)))
            columns = [list(x) for x in zip(*rows, strict=True)] or [[]] * 5
            kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["conv_id", "part", "formatted", "loss_start", "loss_length"])

    order = ["conv_id", "turn", "role", "text"]
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = plain.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text")
    return dealt.mapInArrow(run, _FORMATTED)


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted turns alone; running hashes, so no conversation is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def close() -> None:
            rows.append((now["conv"], now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["all"]))

        def flush() -> pa.RecordBatch:
            columns = [list(x) for x in zip(*rows, strict=True)] or [[]] * 6
            kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _DIGESTS.split(", ")])
            rows.clear()
            return out

        for batch in batches:
            for conv_id, part, text, begin, length in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if part == 0:
                    if now:
                        close()
                    now = {"conv": conv_id, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0}
                role, body = parse_turn(text)
                now["n"] += 1
                now["turns"].update(f"{role}\n{body}\n".encode())
                learnt = unescape(text[begin : begin + length])
                now["chars"] += len(learnt)
                now["loss"].update(learnt.encode())
                now["all"] += len(text)
            yield flush()
        if now:
            close()
            yield flush()

    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, _DIGESTS)
