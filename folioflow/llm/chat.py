"""Chat formatting of heterogeneous conversations.

A record's layout is known by a fingerprint: the hash of its nested field paths.
It selects a declarative mapping to canonical turns (conv_id, turn, role, text).
Turns are then written in a template; control strings inside roles and texts are
escaped, so the output can be read back exactly, loss mask included.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEGIN, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
TURNS = "conv_id long, turn long, role string, text string"


@dataclass(frozen=True)
class Layout:
    """How records that have these field paths become turns.

    each: the list field that holds turns, with the names of their role and text; or turns: (role, fields) pairs, whose
    non-empty texts are joined by a blank line; or row: the columns of conversation, turn, role and text of
    tables with a row a turn.
    """

    name: str
    paths: frozenset[str]
    each: tuple[str, str, str] | None = None
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    row: tuple[str, str, str, str] | None = None

    def prints(self) -> Iterator[tuple[frozenset[str], str]]:
        """Paths that tell the layout, with their fingerprint; those of an empty list of turns too."""
        yield self.paths, fingerprint(self.paths)
        if self.each:
            bare = frozenset(p for p in self.paths if "[]" not in p) | {f"{self.each[0]}[]"}
            yield bare, fingerprint(bare)


def _pair(name: str, ask: str, answer: str) -> list[Layout]:
    turns = (("user", (ask,)), ("assistant", (answer,)))
    return [Layout(name, frozenset({ask, answer}), turns=turns), Layout(f"{name}_system", frozenset({"system", ask, answer}), turns=(("system", ("system",)), *turns))]


def _list(name: str, field: str, role: str, text: str) -> list[Layout]:
    paths = {f"{field}[].{role}", f"{field}[].{text}"}
    return [Layout(name, frozenset(paths), each=(field, role, text)), Layout(f"{name}_system", frozenset(paths | {"system"}), each=(field, role, text))]


LAYOUTS = [
    Layout("turn_rows", frozenset({"conv_id", "turn", "role", "text"}), row=("conv_id", "turn", "role", "text")),
    *_list("messages", "messages", "role", "content"),
    *_list("conversations", "conversations", "from", "value"),
    *_pair("prompt_response", "prompt", "response"),
    *_pair("prompt_completion", "prompt", "completion"),
    *_pair("question_answer", "question", "answer"),
    *_pair("instruction_output", "instruction", "output"),
    Layout("instruction_input_output", frozenset({"instruction", "input", "output"}), turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
]
#: Other names of the canonical roles, in layouts of lists.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def value_paths(value: object, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; [] stands for any element of a list."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in value_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in value_paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def type_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Nested field paths of a DataFrame's schema."""
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for p in type_paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    if isinstance(kind, T.ArrayType):
        return type_paths(kind.elementType, f"{at}[]")
    return {at}


#: Layouts by the number of their paths, most first, each with the paths that it looks for and their fingerprint.
_LOOKED_FOR = sorted(((paths, mark, x) for x in LAYOUTS for paths, mark in x.prints()), key=lambda look: -len(look[0]))


def layout_of(paths: set[str], rows: bool = False) -> Layout | None:
    """The layout (of tables with a row a turn, or of records) whose fingerprint the paths have among those that it looks for; of several the one with most paths.

    All other paths are metadata and don't count.
    """
    return next((x for wanted, mark, x in _LOOKED_FOR if bool(x.row) == rows and fingerprint(paths & wanted) == mark), None)


def _text(value: object) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True)


def record_turns(record: object) -> tuple[str | None, list[tuple[str, str]]]:
    """Layout name and (role, text) turns of a parsed record; (None, []) if no layout fits."""
    found = layout_of(value_paths(record)) if isinstance(record, dict) else None
    if found is None:
        return None, []
    out = []
    if found.each:
        field, role, text = found.each
        if record.get("system"):
            out.append(("system", _text(record["system"])))
        for x in record[field]:
            who = _text(x.get(role))
            out.append((ROLES.get(who, who), _text(x.get(text))))
    for role, fields in found.turns:
        said = "\n\n".join(t for t in (_text(record.get(f)) for f in fields) if t)
        if said or role != "system":
            out.append((role, said))
    return found.name, out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                name, turns = record_turns(json.loads(value or "null"))
            except ValueError:
                name, turns = None, []
            rows += [(conv, name, k, r, t) for k, (r, t) in enumerate(turns)] or [(conv, name, None, None, None)]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["conv_id", "layout", "turn", "role", "text"])


def json_turns(records: DataFrame) -> DataFrame:
    """Turns of JSON records (conv_id, json), each by its own fingerprint, with the layout's name.

    A record without a known layout, or that isn't JSON, gives one row with null layout, turn, role and text, to be
    inspected. A known layout without turns gives one row with its name and nulls. formatted() leaves both out.
    """
    return records.select("conv_id", "json").mapInArrow(_parse, "conv_id long, layout string, turn long, role string, text string")


def table_turns(table: DataFrame) -> DataFrame:
    """Turns of a table with a row a turn, as its schema's fingerprint says; other layouts as structs go by json_turns."""
    found = layout_of(type_paths(table.schema), rows=True)
    if found is None:
        raise ValueError(f"no layout of turn rows has the fields {sorted(type_paths(table.schema))}")
    conv, turn, role, text = found.row
    return table.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(value: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], value)


def formatted(turns: DataFrame) -> DataFrame:
    """Each turn in the template: conv_id, turn, piece, loss_start, loss_end.

    A conversation's formatted text is its pieces, joined in order of turn, then role and text. The mask
    (code points within the piece, end exclusive; null for other roles) covers each assistant text. Null roles and texts are empty; a row
    without turn, role and text is none (see json_turns). Repeated rows are repeated turns. A piece a row keeps conversations of any length within bounded memory.
    """
    role = F.replace(_escaped(F.col("role")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(BEGIN), role, F.lit("\n"))
    piece = F.concat(head, _escaped(F.col("text")), F.lit(f"{END}\n"))
    learned = F.col("role") == LEARNED
    return turns.where("turn is not null or role is not null or text is not null").select(
        "conv_id", "turn", piece.alias("piece"), F.when(learned, F.length(head)).alias("loss_start"), F.when(learned, F.length(piece) - len(END) - 1).alias("loss_end"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )


def read_piece(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    head, _, body = piece.removeprefix(BEGIN).partition("\n")
    return unescape(head), unescape(body.removesuffix(f"{END}\n"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation, read back from its pieces, which arrive in order."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, state, out = None, None, []

    def emit() -> None:
        if state:
            out.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for batch in batches:
        for conv, piece, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end")), strict=True):
            if now != (conv,):
                emit()
                now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = read_piece(piece)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if a is not None:
                said = unescape(piece[int(a) : int(b)])
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(piece)
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)
            out = []
    emit()
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)


def digests(pieces: DataFrame) -> DataFrame:
    """One row a conversation, from formatted(): conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A SHA-256 is a chain, so a conversation's pieces stream through one task, sorted and one batch at a time.
    """
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("role", "text")
    return ordered.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
