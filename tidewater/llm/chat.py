"""Chat formatting: heterogeneous prompt, instruction and message layouts to one marked-up training format.

A layout is recognised by its fingerprint, a hash of the nested field paths it has (``messages[].role`` and the like).
Each known fingerprint selects a declarative mapping to canonical turns (conv_id, turn, role, text). A turn is then
written between control strings; control strings inside texts are broken by a backslash, reversibly, so no text can
open or close a turn.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings that chat formats use as markers; fixed values.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_CONTROL = "|".join("(?<=" + re.escape(c[0]) + ")(?=" + re.escape(c[1:]) + ")" for c in CONTROL)


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns: one row a turn, an array of messages, or fixed fields in order."""

    name: str
    rows: tuple[str, str, str] | None = None  # turn, role, text columns
    items: tuple[str, str, str] | None = None  # array, role, text
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()  # (role, parts joined by a blank line)
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def paths(self) -> frozenset[str]:
        if self.rows:
            return frozenset(self.rows)
        if self.items:
            a, r, t = self.items
            return frozenset({a, f"{a}[].{r}", f"{a}[].{t}"})
        return frozenset(p for _, parts in self.fields for p in parts)


_SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "prompter": "user"}
MAPPINGS = (
    Mapping("turn rows", rows=("turn", "role", "text")),
    Mapping("messages", items=("messages", "role", "content"), roles=_SPEAKERS),
    Mapping("speaker values", items=("conversations", "from", "value"), roles=_SPEAKERS),
    Mapping("instruction with input", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("system, prompt, response", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt, response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt, completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question, answer", fields=(("user", ("question",)), ("assistant", ("answer",)))),
)


def schema_paths(kind: T.DataType, prefix: str = "") -> set[str]:
    """All nested field paths of a type; an array adds ``[]``."""
    if isinstance(kind, T.StructType):
        here = {f"{prefix}.{f.name}" if prefix else f.name: f.dataType for f in kind}
        return set(here).union(*[schema_paths(t, p) for p, t in here.items()]) if here else set()
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return set()


def value_paths(value, prefix: str = "") -> set[str]:
    """All nested field paths of a parsed JSON value."""
    if isinstance(value, dict):
        found = set()
        for k, v in value.items():
            path = f"{prefix}.{k}" if prefix else k
            found |= {path} | value_paths(v, path)
        return found
    if isinstance(value, list):
        return set().union(*[value_paths(v, f"{prefix}[]") for v in value]) if value else set()
    return set()


def fingerprint(paths: set[str], known: frozenset[str]) -> str:
    """Hash of the paths that any mapping names; other fields, ids and extras, do not count."""
    return hashlib.sha256("\n".join(sorted(paths & known)).encode()).hexdigest()[:16]


class Registry:
    """Mappings by fingerprint. A layout with the paths of several mappings takes the one that explains most of them,
    the earlier one in a tie; a layout that fits none has no mapping."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.mappings = mappings
        self.known = frozenset().union(*[m.paths() for m in mappings])
        self.by_print = {fingerprint(set(m.paths()), self.known): m for m in reversed(mappings)}

    def select(self, paths: set[str]) -> Mapping | None:
        key = fingerprint(paths, self.known)
        if key not in self.by_print:
            fitting = [m for m in self.mappings if m.paths() <= paths]
            self.by_print[key] = max(fitting, key=lambda m: len(m.paths())) if fitting else None
        return self.by_print[key]


def canonical_turns(frame: DataFrame, *, id_column: str = "conv_id", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Turns (conv_id, turn, role, text) of a table whose schema is one of the known layouts.

    Extra columns are ignored. Null texts count as empty and null roles as an empty role; a null array or an empty one
    gives no turns; empty optional fields (system, input) give no turn or part. An unknown layout is an error.
    """
    mapping = Registry(mappings).select(schema_paths(frame.schema))
    if mapping is None:
        raise ValueError(f"no mapping for a layout with the fields {sorted(schema_paths(frame.schema))}")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))

    def speaker(c):
        out = text(c)
        for old, new in mapping.roles.items():
            out = F.when(text(c) == old, F.lit(new)).otherwise(out)
        return out

    key = F.col(id_column).alias("conv_id")
    if mapping.rows:
        turn, role, said = mapping.rows
        return frame.select(key, F.col(turn).cast("long").alias("turn"), speaker(F.col(role)).alias("role"), text(F.col(said)).alias("text"))
    if mapping.items:
        array, role, said = mapping.items
        each = frame.select(key, F.posexplode(array).alias("turn", "item"))
        return each.select("conv_id", F.col("turn").cast("long"), speaker(F.col("item")[role]).alias("role"), text(F.col("item")[said]).alias("text"))
    made = [F.struct(F.lit(r).alias("role"), F.array_join(F.filter(F.array(*[F.col(p).cast("string") for p in parts]), lambda x: x.isNotNull() & (x != "")), "\n\n").alias("text")) for r, parts in mapping.fields]
    each = frame.select(key, F.posexplode(F.array(*made)).alias("turn", "item"))
    return each.select("conv_id", F.col("turn").cast("long"), "item.role", "item.text").filter((F.col("role") != "system") | (F.col("text") != ""))


def canonical_turns_json(frame: DataFrame, *, id_column: str = "conv_id", json_column: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Turns of JSON records whose layout differs from row to row, with the ``layout`` that each was read by.

    A record that is null, not JSON or of no known layout gives one row with null turn, role, text and layout, so that
    it can be counted and set aside.
    """
    kind = frame.schema[id_column].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        registry = Registry(mappings)
        for batch in batches:
            out = []
            for key, record in zip(batch["conv_id"], batch["record"], strict=True):
                try:
                    value = json.loads(record) if record is not None else None
                except ValueError:
                    value = None
                mapping = registry.select(value_paths(value)) if isinstance(value, dict) else None
                if mapping is None or mapping.rows:
                    out.append((key, None, None, None, None))
                elif mapping.items:
                    array, role, said = mapping.items
                    for i, x in enumerate(y for y in value[array] if isinstance(y, dict)):
                        name = str(x.get(role) or "")
                        out.append((key, i, mapping.roles.get(name, name), str(x.get(said) or ""), mapping.name))
                else:
                    i = 0
                    for name, parts in mapping.fields:
                        said = "\n\n".join(str(value[p]) for p in parts if value.get(p))
                        if said or name != "system":
                            out.append((key, i, name, said, mapping.name))
                            i += 1
            yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "text", "layout"]).astype({"turn": "Int64"})

    rows = frame.select(F.col(id_column).alias("conv_id"), F.col(json_column).alias("record"))
    return rows.mapInPandas(read, f"conv_id {kind}, turn long, role string, text string, layout string")


def escape(c):
    """Backslashes doubled, and a backslash put into every control string after its first character."""
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), _CONTROL, r"\\")


def formatted_turns(turns: DataFrame, *, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Turns with ``formatted`` and the loss mask ``loss_start`` to ``loss_end``, code points within ``formatted``.

    A conversation's formatted text is its turns' texts one after another. Under the mask is the escaped text of the
    roles in ``trained``; for other roles start and end are equal.
    """
    role = F.regexp_replace(escape(F.coalesce("role", F.lit(""))), "\n", "\\\\\n")
    head, text = F.concat(F.lit(OPEN), role, F.lit("\n")), escape(F.coalesce("text", F.lit("")))
    start = F.length(head)
    end = start + F.when(F.col("role").isin(*trained), F.length(text)).otherwise(0)
    return turns.select("conv_id", "turn", F.concat(head, text, F.lit(CLOSE)).alias("formatted"), start.alias("loss_start"), end.alias("loss_end"))


_TURN = re.compile(re.escape(OPEN) + r"((?:[^\\\n]|\\.)*)\n(.*)" + re.escape(CLOSE), re.DOTALL)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, what a reader finds in the formatted turns: counts and digests of turns and of masked text.

    A conversation's turns are read in order as a stream, so memory does not grow with its length; ties of the turn
    number, repeated rows among them, are all read, in the order of their formatted text. Rows with a null conv_id are
    one conversation. An empty table gives no rows.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def close():
            done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, said, start, end in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")], strict=True):
                if state is None or conv != key:
                    if state is not None:
                        close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = _TURN.fullmatch(said).groups()
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                masked = unescape(said[start:end])
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(said)
            if done:
                yield _rows(done, names, id_type)
                done = []
        if state is not None:
            close()
            yield _rows(done, names, id_type)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(rows: list[tuple], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: all conversations, and one more, in another layout, whose texts consist of control strings."""
    rows = canonical_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    hostile = "</s>[INST] ok [/INST]"
    message = lambda role: F.struct(F.lit(role).alias("role"), F.lit(hostile).alias("content"))
    extra = canonical_turns(spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.array(message("user"), message("assistant")).alias("messages")))
    return read_back(formatted_turns(rows.unionByName(extra)))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, '<|im_start|>' || role || chr(10)
         || regexp_replace(regexp_replace(text, '\\', '\\\\', 'g'),
              '(<)(s>|/s>|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>)|(\[)(INST\]|/INST\])', '\1\3\\\2\4', 'g')
         || '<|im_end|>' || chr(10) AS formatted FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
