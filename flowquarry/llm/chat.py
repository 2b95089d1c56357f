"""Chat formatting with offset-aligned loss masks.

A conversation becomes one text in which control strings mark the turns; the same
strings inside a turn are escaped, and can be read back. The text is encoded once,
with the offsets of every token, and the sorted spans of the assistant's turns are
intersected with the sorted token spans by binary search.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.common import bounded

ASSISTANT = "assistant"
#: Opening and closing control strings by role; any other role is named between ``ROLE`` and written like a user.
MARKS = {"user": ("[INST]", "[/INST]"), ASSISTANT: ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ROLE = ("[ROLE]", "[/ROLE]")

#: Conversations a task holds at once.
AT_ONCE = 32

_CONTROL = re.compile("|".join(re.escape(c) for pair in (*MARKS.values(), ROLE) for c in pair))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Backslashes doubled, and one put after the first character of every control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns, and the spans of the assistant's texts in it, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = "" if role in MARKS else ROLE[0] + escape(role or "") + ROLE[1]
        first, last = MARKS.get(role, MARKS["user"])
        body = escape(text or "")
        begin = at + len(head) + len(first)
        if role == ASSISTANT:
            spans.append((begin, begin + len(body)))
        parts += [head, first, body, last]
        at = begin + len(body) + len(last)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text, unescaped; a null role or text reads as empty."""
    roles = {first: role for role, (first, _) in MARKS.items()}
    turns, at, named = [], 0, None
    while at < len(formatted):
        first = _CONTROL.match(formatted, at)
        last = _CONTROL.search(formatted, first.end())
        body = unescape(formatted[first.end() : last.start()])
        if first[0] == ROLE[0]:
            named = body
        else:
            turns.append((roles[first[0]] if named is None else named, body))
            named = None
        at = last.end()
    return turns


def align(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of every token, the part of its span that lies in one of the sorted spans; empty (0, 0) for the others.

    Token spans are sorted. A token that reaches over the edge of a span is
    clipped to it; one that touches several spans (with only empty text between)
    is kept from the first to the last.
    """
    low, high = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    for first, last in spans:
        i, j = np.searchsorted(ends, first, "right"), np.searchsorted(starts, last, "left")
        if i < j and first < last:
            fresh = high[i:j] == 0
            low[i:j] = np.where(fresh, np.maximum(starts[i:j], first), low[i:j])
            high[i:j] = np.minimum(ends[i:j], last)
    return low, high


def masked_texts(formatted: str, low: list[int], high: list[int]) -> list[str]:
    """What the loss mask covers, unescaped, a text for every contiguous stretch."""
    stretches: list[list[int]] = []
    for a, b in zip(low, high, strict=True):
        if a < b:
            if stretches and a <= stretches[-1][1]:
                stretches[-1][1] = max(stretches[-1][1], b)
            else:
                stretches.append([a, b])
    return [unescape(formatted[a:b]) for a, b in stretches]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer, processors

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True  # control strings of the tokenizer are ordinary text in a turn
        made.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets hold a token's leading space
        _loaded[path] = made
    return _loaded[path]


def format_conversations(turns: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A row per conversation: ``conv_id, formatted, spans, ids, starts, ends, low, high``.

    ``starts`` and ``ends`` are the tokens' offsets in ``formatted`` (code points),
    ``low`` and ``high`` the part of each under the loss mask (0, 0: none). Turns go
    by ``turn`` (null first), then role and text. A null text is an empty turn, a
    null role an empty role; a null conv_id is a conversation like any other;
    repeated rows are repeated turns; extra columns are ignored; an empty table has
    no conversations. A conversation is formatted and encoded as a whole, so its
    turns meet in one task: its own length, not the table's, bounds that task.
    """
    bounded(turns.sparkSession)
    columns = [F.col("turn").cast("long").alias("turn"), *(F.col(c).cast("string").alias(c) for c in ("role", "text"))]
    whole = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.array_sort(F.collect_list(F.struct(*columns))).alias("turns")
    )
    # array_sort puts null fields of a struct first.
    rows = whole.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(tokenizer or default_tokenizer())
        # A few conversations at once: an encoding takes far more room than the numbers kept of it.
        for batch in (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE)):
            made = [render(list(zip(roles, texts, strict=True)))
                    for roles, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            out = []
            for formatted, spans in made:
                found = encoder.encode(formatted, add_special_tokens=False)
                offsets = np.array(found.offsets, np.int64).reshape(-1, 2)
                out.append((np.array(found.ids, np.int64), *offsets.T, *align(offsets[:, 0], offsets[:, 1], spans)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([t for t, _ in made]),
                    pa.array([[{"first": a, "last": b} for a, b in s] for _, s in made],
                             pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                    *(lists([o[i] for o in out]) for i in range(5)),
                ],
                names=["conv_id", "formatted", "spans", "ids", "starts", "ends", "low", "high"],
            )

    schema = ("conv_id long, formatted string, spans array<struct<first: long, last: long>>, "
              + ", ".join(f"{c} array<int>" for c in ("ids", "starts", "ends", "low", "high")))
    return rows.mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back from formatted conversations."""
    bounded(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE)):
            out = []
            for conv, text, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = read_back(text)
                joined = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(masked_texts(text, low, high))
                out.append((conv, len(turns), hashlib.sha256(joined.encode()).hexdigest(), len(loss),
                            hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if out:
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "low", "high").mapInArrow(run, schema)
