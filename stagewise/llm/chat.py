"""Chat formatting: schema fingerprints select mappings to canonical turns, which a template writes.

Layouts. The fingerprint of a record is a hash of its sorted nested field paths
(`messages[].role`). Each known fingerprint selects a declarative mapping; the
fields of a mapping that are optional count for the fingerprint only when they
are there, so each mapping lists its variants. Tables with a column for each
field have one fingerprint, taken from their schema; columns of JSON are
fingerprinted record by record.

Template. A turn is written `<|turn|>role\\n` + text + `<|end|>\\n`. In roles and
texts every control string, ours or of other common templates, gets a backslash
behind its first character (one more if it already has some), and back: no text
can forge a marker, and reading back returns it exactly. Line ends and
backslashes in roles are written `\\n` and `\\\\`.

Conversations are written turn by turn in order, over rows sorted within
partitions: a conversation of any length needs the memory of one turn only.

Defined results: null texts and roles count as empty; null turns come first,
equal turns in order of role and text; rows with a null conversation id form
one conversation; an empty table gives no conversations; extra columns are
left out. A record of unknown layout gives no turn but a row with its
fingerprint in `unmapped`.
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
from pyspark.sql import types as T

from stagewise.llm.common import ship

#: Control strings of common chat templates; an escaped one has backslashes behind its first character.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>"]
TAILS = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
ESCAPE = re.compile(rf"([<\[])(\\*)(?=(?:{TAILS}))")
UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?=(?:{TAILS}))")
TURN, END = "<|turn|>", "<|end|>\n"


def escape(text: str) -> str:
    return ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2", text)


def write_turn(role: str, text: str) -> str:
    role = escape(role.replace("\\", "\\\\").replace("\n", "\\n"))
    return f"{TURN}{role}\n{escape(text)}{END}"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns = []
    for piece in formatted.split(TURN)[1:]:
        role, _, text = piece.partition("\n")
        role = re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))
        turns.append((role, unescape(text[: -len(END)])))
    return turns


def field_paths(value, path: str = "") -> set[str]:
    """Nested field paths of a JSON value, or of a Spark type."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{path}.{k}" if path else k) for k, v in value.items())) if value else {path}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{path}[]") for v in value)) if value else {f"{path}[]"}
    if isinstance(value, T.StructType):
        return set().union(*(field_paths(f.dataType, f"{path}.{f.name}" if path else f.name) for f in value.fields))
    if isinstance(value, T.ArrayType):
        return field_paths(value.elementType, f"{path}[]")
    return {path}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """Fields, in order, that become turns: (path, role); or the list of messages with its role and text fields."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    messages: str = ""
    role: str = ""
    text: str = ""

    def fingerprints(self) -> list[str]:
        sets = [set(self.required)]
        for path in self.optional:
            sets += [s | {path} for s in sets]
        return [fingerprint(s) for s in sets]


#: The names that published data sets give the fields, and roles by other names.
MAPPINGS = [
    Mapping("rows", ("conv_id", "turn", "role", "text"), role="role", text="text"),
    Mapping("messages", ("messages[].role", "messages[].content"), ("id", "source"), messages="messages", role="role", text="content"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), ("id", "source"), messages="conversations", role="from", text="value"),
    Mapping("instruction", ("instruction", "output"), ("input", "id", "system"), turns=(("system", "system"), ("instruction+input", "user"), ("output", "assistant"))),
    Mapping("prompt", ("prompt", "response"), ("id", "system"), turns=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Mapping("completion", ("prompt", "completion"), ("id",), turns=(("prompt", "user"), ("completion", "assistant"))),
    Mapping("question", ("question", "answer"), ("id", "context"), turns=(("context+question", "user"), ("answer", "assistant"))),
]
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
BY_FINGERPRINT = {f: m for m in MAPPINGS for f in m.fingerprints()}


def record_turns(record: dict) -> tuple[str, list[tuple[str, str]] | None]:
    """The record's fingerprint, and its turns (None: no mapping for it)."""
    f = fingerprint(field_paths(record))
    m = BY_FINGERPRINT.get(f)
    if m is None:
        return f, None
    if m.messages:
        return f, [(ROLES.get(x[m.role] or "", x[m.role] or ""), x[m.text] or "") for x in record[m.messages]]
    turns = []
    for path, role in m.turns:
        said = [str(record[p]) for p in path.split("+") if record.get(p)]
        if said or role != "system":
            turns.append((role, "\n\n".join(said)))
    return f, turns


def turns_of_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """conv_id, turn, role, text (and unmapped: the fingerprint of a layout without mapping) from a column of JSON records."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    record = json.loads(raw or "null")
                except ValueError:
                    record = None
                f, turns = record_turns(record) if isinstance(record, dict) else ("not a record", None)
                out += [(i, None, None, None, f)] if turns is None else [(i, k, r, t, None) for k, (r, t) in enumerate(turns)]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [batch.schema.field(0).type, pa.int64(), *[pa.string()] * 3], strict=True)], names=["conv_id", "turn", "role", "text", "unmapped"])

    return df.select(id_col, json_col).mapInArrow(run, f"conv_id {df.schema[id_col].dataType.simpleString()}, turn long, role string, text string, unmapped string")


def canonical_turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a table whose schema's fingerprint has a mapping; other columns are tried without."""
    want = {p for m in MAPPINGS if not m.messages and not m.turns for p in m.required}
    m = BY_FINGERPRINT.get(fingerprint({p for p in field_paths(df.schema) if p in want}))
    if m is None:
        raise ValueError(f"no mapping for the layout {sorted(field_paths(df.schema))}")
    return df.select("conv_id", "turn", F.coalesce(F.col(m.role), F.lit("")).alias("role"), F.coalesce(F.col(m.text), F.lit("")).alias("text"))


def ordered(turns: DataFrame) -> DataFrame:
    """Each conversation's rows one behind another, in one partition."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, formatted and the loss mask as a span (loss_from, loss_to) of code points in formatted; a conversation's formatted rows, in order, are its output."""
    ship(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, spans = [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                out.append(write_turn(role or "", text or ""))
                spans.append((out[-1].index("\n") + 1, len(out[-1]) - len(END)) if role == "assistant" else (0, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([s for s, _ in spans], pa.int64()), pa.array([e for _, e in spans], pa.int64())], names=["conv_id", "turn", "formatted", "loss_from", "loss_to"])

    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, turn {turns.schema['turn'].dataType.simpleString()}, formatted string, loss_from long, loss_to long"
    return ordered(turns).mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read from rows of format_turns() as they stand in their partitions."""
    ship(formatted.sparkSession)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kind = object(), None, None
        done: list[tuple] = []

        def close() -> None:
            if state:
                n, turns, loss_n, loss, chars = state
                done.append((now, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [()] * 6
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, text, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                loss = unescape(text[a:b])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(text)
            yield flush()
        if kind is not None:
            close()
            yield flush()

    schema = f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInArrow(run, schema)


def formatted_digests(turns: DataFrame) -> DataFrame:
    return read_back(format_turns(turns))
