"""Chat formatting: conversations laid out as bytes in one buffer for each batch, and read back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags of the roles that have one; any other role is named in its header.
TAGS = {"user": "INST", "assistant": "ANS", "system": "SYS"}
OTHER = "ROLE"
TRAINED = "assistant"

#: Control strings: <s>, </s>, [TAG] and [/TAG], and [ROLE with a name. One backslash more after the first letter makes
#: a control string, with however many backslashes, plain text; taking one away undoes that.
_ENDS = r"(/?(?:s>|(?:INST|ANS|SYS|ROLE)\]|ROLE ))"
_PLAIN = r"([<\[])(\\*)" + _ENDS
_ESCAPED = re.compile(r"([<\[])\\(\\*)" + _ENDS)
_TURN = re.compile(r"<s>\[(?:(INST|ANS|SYS)|ROLE ([^\]]*))\] (.*?) \[/(?:INST|ANS|SYS|ROLE)\]</s>", re.DOTALL)

#: Bytes copied at a time through a scatter index.
COPY = 1 << 20


def header(role: str) -> str:
    name = re.sub(r"[%\[\]<>]", lambda m: f"%{ord(m[0]):02X}", role)
    return f"<s>[{TAGS[role]}] " if role in TAGS else f"<s>[{OTHER} {name}] "


def footer(role: str) -> str:
    return f" [/{TAGS.get(role, OTHER)}]</s>"


def _scatter(out: np.ndarray, data: np.ndarray, lengths: np.ndarray, to: np.ndarray) -> None:
    """Copy consecutive segments of ``data`` to the places ``to`` of ``out``, a bounded index at a time."""
    at = np.concatenate([[0], np.cumsum(lengths)])
    shift = to - at[:-1]
    for lo in range(0, len(data), COPY):
        hi = min(lo + COPY, len(data))
        a, b = int(np.searchsorted(at, lo, "right")) - 1, int(np.searchsorted(at, hi, "left"))
        own = np.minimum(at[a + 1:b + 1], hi) - np.maximum(at[a:b], lo)
        out[np.arange(lo, hi) + np.repeat(shift[a:b], own)] = data[lo:hi]


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text array and the length of each text."""
    values = values.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset:values.offset + len(values) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], np.diff(at)


def assemble(roles: pa.Array, texts: pa.Array, turns: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted conversations, and start and end of each text inside its conversation, in bytes.

    ``turns`` holds the offsets of the conversations in the flat turns. Lengths of
    header, text and footer give cumulative offsets; the three are scattered into one
    buffer, which becomes the data of the text column.
    """
    texts = pc.fill_null(texts, "")
    if pc.any(pc.match_substring_regex(texts, _PLAIN)).as_py():
        texts = pc.replace_substring_regex(texts, _PLAIN, r"\1\\\2\3")
    coded = pc.fill_null(roles, "").dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False)
    names = coded.dictionary.to_pylist()
    parts = [(pa.array([f(n) for n in names], pa.string()).take(coded.indices)) for f in (header, footer)]
    (head, head_n), (body, body_n), (foot, foot_n) = _bytes(parts[0]), _bytes(texts), _bytes(parts[1])
    assert len(which) == len(body_n)
    ends = np.cumsum(head_n + body_n + foot_n)
    starts = ends - head_n - body_n - foot_n
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for data, lengths, to in ((head, head_n, starts), (body, body_n, starts + head_n), (foot, foot_n, ends - foot_n)):
        _scatter(out, data, lengths, to)
    bounds = np.concatenate([[0], ends])[turns]
    formatted = pa.LargeStringArray.from_buffers(len(turns) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out))
    origin = np.repeat(bounds[:-1], np.diff(turns))
    return formatted, starts + head_n - origin, ends - foot_n - origin


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns = batch.column("turns")
        at = turns.offsets.to_numpy().astype(np.int64)
        flat = turns.values.slice(at[0], at[-1] - at[0])
        at = at - at[0]
        roles, texts = flat.field("role"), flat.field("text")
        formatted, start, end = assemble(roles, texts, at)
        trained = pc.fill_null(pc.equal(roles, TRAINED), False).to_numpy(zero_copy_only=False)
        counts = np.concatenate([[0], np.cumsum(trained)])[at]
        spans = pa.StructArray.from_arrays([pa.array(start[trained]), pa.array(end[trained])], ["start", "end"])
        yield pa.RecordBatch.from_pydict({
            "conv_id": batch.column("conv_id"), "formatted": formatted.cast(pa.string()),
            "loss": pa.ListArray.from_arrays(pa.array(counts, pa.int32()), spans)})


def format_chats(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, formatted, loss (spans of UTF-8 bytes under the loss mask).

    ``rows`` has conv_id, turn, role and text; other columns are left out. Turns are
    ordered by turn, then role, then text, so ties have one order; repeated rows stay.
    A NULL turn comes first, a NULL role or text is empty, a NULL conv_id is a
    conversation. A conversation is one value of the result, hence in one task.
    """
    grouped = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    slim = grouped.select("conv_id", F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return slim.mapInArrow(_format, "conv_id long, formatted string, loss array<struct<start: long, end: long>>")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn, read back."""
    roles = {tag: role for role, tag in TAGS.items()}
    return [(roles[m[1]] if m[1] else re.sub(r"%([0-9A-F]{2})", lambda x: chr(int(x[1], 16)), m[2]), unescape(m[3]))
            for m in _TURN.finditer(formatted)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for value, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
            turns, raw = parse(value), value.encode()
            loss = "".join(unescape(raw[s["start"]:s["end"]].decode()) for s in spans)
            out["n_turns"].append(len(turns))
            out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
            out["loss_chars"].append(len(loss))
            out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
            out["formatted_chars"].append(len(value))
        yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id"), **out})


def read_back(chats: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, taken from the formatted text and its loss spans."""
    return chats.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                      "loss_sha256 string, formatted_chars long")
