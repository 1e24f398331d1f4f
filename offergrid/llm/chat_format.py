"""Records of many layouts to one chat template, and back.

A record is JSON. The set of its nested field paths is hashed; the hash selects a declarative mapping from the layout to
canonical turns (role, text). Turns are written in a template whose marks can't occur inside texts, because a text's own
marks are escaped; the loss mask is a list of spans over the code points of the formatted text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offergrid.llm.common import batched

START, END = "<|im_start|>", "<|im_end|>"
SPANS = "array<struct<start: long, end: long>>"


class Step(NamedTuple):
    """Turns of one field or list: ``text`` is a path below ``over`` (a list) or below the record; ``role`` a path there, or
    a fixed role after ``=``. Several texts of one turn, by a path with ``[]``, are joined; a missing field gives no turn."""

    role: str
    text: str
    over: str = ""


@dataclass(frozen=True)
class Layout:
    name: str
    steps: tuple[Step, ...]
    roles: tuple[tuple[str, str], ...] = ()
    needs: tuple[str, ...] = ()

    def paths(self) -> frozenset[str]:
        """The paths a record must have: those of its steps, or ``needs`` where some steps may be absent."""
        own = [p for s in self.steps for p in ([] if s.role.startswith("=") else [s.role]) + [s.text] for p in [f"{s.over}[].{p}" if s.over else p]]
        return frozenset(self.needs or own)


_NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
#: The layouts known by default; callers pass their own tuple to add or replace some. Of several that fit, the one that
#: needs most paths counts, then the first.
LAYOUTS = (
    Layout("messages", (Step("role", "content", "messages"),)),
    Layout("message_parts", (Step("role", "content[].text", "messages"),)),
    Layout("from_value", (Step("=system", "system"), Step("from", "value", "conversations")), _NAMES, ("conversations[].from", "conversations[].value")),
    Layout("dialog", (Step("speaker", "text", "dialog"),), _NAMES),
    Layout("instruction", (Step("=system", "system"), Step("=user", "instruction"), Step("=assistant", "output")), needs=("instruction", "output")),
    Layout("instruction_input", (Step("=system", "system"), Step("=user", "instruction"), Step("=user+", "input"), Step("=assistant", "output")), needs=("instruction", "input", "output")),
    Layout("prompt_response", (Step("=system", "system"), Step("=user", "prompt"), Step("=assistant", "response")), needs=("prompt", "response")),
    Layout("prompt_completion", (Step("=system", "system"), Step("=user", "prompt"), Step("=assistant", "completion")), needs=("prompt", "completion")),
    Layout("question_answer", (Step("=user", "question"), Step("=assistant", "answer"))),
    Layout("nested_exchange", (Step("=user", "data.prompt"), Step("=assistant", "data.response"))),
    Layout("text_only", (Step("=assistant", "text"),)),
)


def field_paths(value, at: str = "") -> set[str]:
    """Paths of all leaves: ``a.b`` below objects, ``a[]`` below lists, ``a[0]`` for a list without elements."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{at}.{_name(k)}" if at else _name(k))}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{at}[]")} if value else {f"{at}[0]"}
    return {at}


def _name(key: str) -> str:
    return re.sub(r"([\\.\[\]])", r"\\\1", key)


def fingerprint(paths: frozenset[str]) -> int:
    """A signed 64-bit hash of the sorted paths."""
    return int.from_bytes(xxhash.xxh64(json.dumps(sorted(paths)).encode()).digest(), "big", signed=True)


class Mappings:
    """Mappings by fingerprint. What no layout has exactly is resolved once a fingerprint, by the paths layouts need."""

    def __init__(self, layouts: tuple[Layout, ...]):
        self.layouts = layouts
        self.exact = {fingerprint(x.paths()): x for x in reversed(layouts)}
        self.of = lru_cache(4096)(self._resolve)

    def _resolve(self, mark: int, paths: frozenset[str]) -> Layout | None:
        if mark in self.exact:
            return self.exact[mark]
        empty = {p[:-3] for p in paths if p.endswith("[0]")}
        has = lambda p: p in paths or any(p[: m.start()] in empty for m in re.finditer(r"\[\]", p))
        fit = [x for x in self.layouts if all(map(has, x.paths()))]
        return max(fit, key=lambda x: len(x.paths()), default=None)


def _values(value, path: str) -> list:
    """What stands at a path: one value, or one for each element below a ``[]``."""
    out = [value]
    for part in re.findall(r"\[\]|(?:\\.|[^.\[\]\\])+", path):
        if part == "[]":
            out = [x for v in out if isinstance(v, list) for x in v]
        else:
            key = re.sub(r"\\(.)", r"\1", part)
            out = [v[key] for v in out if isinstance(v, dict) and key in v]
    return out


def _text(value) -> str:
    shown = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)
    return shown.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def canonical_turns(record, layout: Layout) -> list[tuple[str, str]]:
    """Turns of a parsed record: a role of the layout's table is renamed, others stay; a null text is empty."""
    turns, rename = [], dict(layout.roles)
    for step in layout.steps:
        for item in _values(record, f"{step.over}[]") if step.over else [record]:
            found = _values(item, step.text)
            if not found:
                continue
            text = "".join(map(_text, found))
            if step.role == "=user+":  # more of the user's turn, where there is any
                if text and turns:
                    turns[-1] = turns[-1][0], f"{turns[-1][1]}\n\n{text}"
                continue
            role = step.role[1:] if step.role.startswith("=") else _text(next(iter(_values(item, step.role)), None))
            turns.append((rename.get(role, role), text))
    return turns


def escape(text: str) -> str:
    """Break each ``<|`` by a backslash, and lengthen those that look broken already, so that ``unescape`` is exact."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans of it (code points) that count for the loss: the texts of ``learn``."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role(role)}\n", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(_unrole(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def format_chats(records: DataFrame, record: str = "record", keys: tuple[str, ...] = ("conv_id",), layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``keys``, the record's fingerprint, its layout, n_turns, formatted text and loss spans; one row a record.

    A record that is null, no JSON or of no known layout has layout null, no turns and an empty text: nothing is dropped.
    Repeated rows stay. A record is one cell, so it is as long as a cell may be.
    """
    given = records.select(*keys, F.col(record).cast("string").alias("_record"))
    kind = records.select(*keys).schema
    out = f"{kind.simpleString()[7:-1]}, fingerprint: long, layout: string, n_turns: long, formatted: string, loss: {SPANS}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Mappings(layouts)
        for batch in batched(batches, column="_record"):
            made = [_one(known, r) for r in batch.column(len(keys)).to_pylist()]
            cols = [batch.column(i) for i in range(len(keys))]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            cols += [pa.array([m[i] for m in made], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "fingerprint", "layout", "n_turns", "formatted", "loss"])

    return given.mapInArrow(work, out)


def _one(known: Mappings, record: str | None) -> tuple:
    try:
        value = json.loads(record)
        paths = frozenset(field_paths(value))
    except (TypeError, ValueError, RecursionError):
        return None, None, 0, "", []
    mark = fingerprint(paths)
    layout = known.of(mark, paths)
    turns = canonical_turns(value, layout) if layout else []
    text, spans = render(turns)
    return mark, layout and layout.name, len(turns), text, [{"start": a, "end": b} for a, b in spans]


def read_back(formatted: DataFrame, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """From formatted text and loss spans alone: the turns, and the unescaped text under the mask."""
    given = formatted.select(*keys, "formatted", "loss")
    kind = formatted.select(*keys).schema.simpleString()[7:-1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = pa.struct([("role", pa.string()), ("text", pa.string())])
        for batch in batched(batches, column="formatted"):
            texts, spans = batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist()
            turns = [[{"role": r, "text": t} for r, t in parse(x)] for x in texts]
            masked = ["".join(unescape(x[s["start"] : s["end"]]) for s in own) for x, own in zip(texts, spans, strict=True)]
            cols = [*[batch.column(i) for i in range(len(keys) + 1)], pa.array(turns, pa.list_(turn)), pa.array(masked, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "formatted", "turns", "loss_text"])

    return given.mapInArrow(work, f"{kind}, formatted: string, turns: array<struct<role: string, text: string>>, loss_text: string")


def records_of_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, record) of turn rows, each conversation in the plainest layout that holds it.

    A user and an assistant row make a prompt and a response, with a system row before them also a system text; other
    conversations are lists of messages. Rows go by turn (nulls first), then role and text; null role and text are empty.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    one = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    roles, text = F.array_join(F.col("t.role"), ","), lambda i: F.get("t.content", F.lit(i))
    plain = F.struct(text(0).alias("prompt"), text(1).alias("response"))
    led = F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response"))
    listed = F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    record = F.when(roles == "user,assistant", F.to_json(plain)).when(roles == "system,user,assistant", F.to_json(led)).otherwise(F.to_json(listed))
    return one.select("conv_id", record.alias("record"))
