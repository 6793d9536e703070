"""Chat formatting by columnar byte assembly.

A turn becomes ``### role: text </turn>`` and a line feed. Inside roles and texts a
backslash becomes two, ``### `` becomes ``\\h`` and ``</turn>`` becomes ``\\e``
(in roles also ``:`` becomes ``\\c``), so that control strings occur in the
output only as marks and every text can be read back.

Turns are shuffled by conversation, sorted, and assembled batch by batch: segment
lengths, cumulative offsets and scatter indices are computed in numpy, and
headers and contents are copied into one preallocated Arrow buffer, about ``PART_BYTES`` at a time. A
conversation longer than that comes in several parts, so one of any number of turns streams through a task in bounded
memory; a single turn is never cut. All turns of a conversation, and so all rows whose conv_id is null, are sorted in one task, as its parts are in order.

Defined cases: null roles and texts are empty; a null turn comes first, a null
conv_id is one conversation; turns that tie are ordered by role and text, and
repeated rows are kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import raw_bytes

PART_BYTES = 8 << 20
#: Texts and roles longer than this are copied one by one, shorter ones by scatter indices (16 bytes a byte of a part).
LONG_BYTES = 1 << 16
FORMATTED = "conv_id long, part int, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>"

_OPEN, _COLON, _CLOSE = b"### ", b": ", b" </turn>\n"
_TURN = re.compile(r"### (.*?): (.*?) </turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)")
_MEANING = {"\\": "\\", "h": "### ", "e": "</turn>", "c": ":"}


def escape(texts: pa.Array, role: bool = False) -> pa.Array:
    for plain, coded in (("\\", "\\\\"), ("### ", "\\h"), ("</turn>", "\\e"), *([(":", "\\c")] if role else [])):
        texts = pc.replace_substring(texts, plain, coded)
    return texts


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _MEANING[m[1]], text) if "\\" in text else text


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, the inverse of the template."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def assemble(roles: pa.Array, texts: pa.Array, ends: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """One string for each group of turns; ``ends`` has the turn after each group.

    Also the start and end, in code points of its string, of each turn's text.
    """
    roles, texts = escape(roles, role=True), escape(texts)
    role_bytes, role_at = raw_bytes(roles)
    text_bytes, text_at = raw_bytes(texts)
    n = len(texts)
    role_len, text_len = np.diff(role_at), np.diff(text_at)
    lengths = np.stack([np.full(n, len(_OPEN)), role_len, np.full(n, len(_COLON)), text_len, np.full(n, len(_CLOSE))], 1)
    starts = np.concatenate([[0], np.cumsum(lengths.ravel())])
    buffer = np.empty(int(starts[-1]), np.uint8)
    at = starts[:-1].reshape(n, 5)
    for k, mark in ((0, _OPEN), (2, _COLON), (4, _CLOSE)):
        mark = np.frombuffer(mark, np.uint8)
        buffer[(at[:, k, None] + np.arange(len(mark))).ravel()] = np.tile(mark, n)
    for k, data, own, size in ((1, role_bytes, role_at, role_len), (3, text_bytes, text_at, text_len)):
        long = np.flatnonzero(size > LONG_BYTES)
        for row in long:  # one slice each needs no indices
            buffer[at[row, k] : at[row, k] + size[row]] = data[own[row] : own[row + 1]]
        short = np.where(size > LONG_BYTES, 0, size)
        from_ = np.arange(int(short.sum())) - np.repeat(np.cumsum(short) - short, short)
        buffer[from_ + np.repeat(at[:, k], short)] = data[from_ + np.repeat(own[:-1], short)]
    bounds = np.concatenate([[0], ends])
    group_at = starts[::5][bounds]
    kind = pa.large_string() if group_at[-1] > 2**31 - 1 else pa.string()
    offsets = group_at.astype(np.int64 if kind == pa.large_string() else np.int32)
    strings = pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(buffer)])
    # Code points of each segment, and before it; an empty segment has none, whatever reduceat says.
    points = np.where(lengths.ravel() > 0, np.add.reduceat((buffer & 0xC0) != 0x80, starts[:-1], dtype=np.int64), 0) if n else np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(points)])
    base = np.repeat(before[::5][bounds[:-1]], np.diff(bounds))
    first = before[:-1].reshape(n, 5)
    return strings, first[:, 3] - base, first[:, 4] - base


def _format_partition(batches: Iterator[pa.RecordBatch], trained: str, part_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns to parts. The last conversation of a batch waits for the next one, unless it fills a part."""
    waiting: list[pa.Table] = []
    parts: dict = {}  # of the conversation that goes on, only

    def close(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        ids = table["conv_id"].combine_chunks()
        roles, texts = table["role"].combine_chunks(), table["text"].combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        values = pc.fill_null(ids, 0).to_numpy()
        changes = np.flatnonzero((values[1:] != values[:-1]) | (known[1:] != known[:-1])) + 1
        sizes = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + pc.binary_length(roles).to_numpy())
        ends: list[int] = []
        for lo, hi in zip([0, *changes], [*changes, len(ids)], strict=True):
            done = sizes[lo - 1] if lo else 0
            while sizes[hi - 1] - done > part_bytes:  # a long conversation, cut between turns
                cut = max(int(np.searchsorted(sizes, done + part_bytes, "right")), (ends[-1] if ends and ends[-1] > lo else lo) + 1)
                if cut >= hi:
                    break
                ends.append(cut)
                done = sizes[cut - 1]
            ends.append(hi)
        loss = np.asarray(pc.equal(roles, trained).to_numpy(zero_copy_only=False), bool)
        first = 0
        while first < len(ends):  # about a part at a time
            row = ends[first - 1] if first else 0
            done = sizes[row - 1] if row else 0
            upto = first + 1
            while upto < len(ends) and sizes[ends[upto] - 1] - done <= part_bytes:
                upto += 1
            own = np.array(ends[first:upto])
            strings, text_from, text_to = assemble(roles.slice(row, own[-1] - row), texts.slice(row, own[-1] - row), own - row)
            rows: dict[str, list] = {"conv_id": [], "part": [], "n_turns": [], "loss_starts": [], "loss_ends": []}
            for lo, hi in zip([row, *own[:-1].tolist()], own.tolist(), strict=True):
                key = ids[lo].as_py()
                part = parts.get(key, 0)
                parts.clear()
                parts[key] = part + 1
                rows["conv_id"].append(key)
                rows["part"].append(part)
                rows["n_turns"].append(hi - lo)
                rows["loss_starts"].append(text_from[lo - row : hi - row][loss[lo:hi]].tolist())
                rows["loss_ends"].append(text_to[lo - row : hi - row][loss[lo:hi]].tolist())
            yield pa.record_batch(
                [pa.array(rows["conv_id"], pa.int64()), pa.array(rows["part"], pa.int32()), pa.array(rows["n_turns"], pa.int64()), strings, pa.array(rows["loss_starts"], pa.list_(pa.int64())), pa.array(rows["loss_ends"], pa.list_(pa.int64()))],
                names=["conv_id", "part", "n_turns", "formatted", "loss_starts", "loss_ends"],
            )
            first = upto

    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(pa.Table.from_batches([batch]))
        table = pa.concat_tables(waiting)
        ids = table["conv_id"].combine_chunks()
        last = ids[len(ids) - 1].as_py()
        same = ids.is_null() if last is None else pc.fill_null(pc.equal(ids, last), False)
        head = len(ids) - int(pc.sum(same).as_py())
        if table.slice(head).nbytes > part_bytes:
            head = len(ids)
        if head:
            yield from close(table.slice(0, head), False)
        waiting = [table.slice(head)] if head < len(ids) else []
    if waiting:
        yield from close(pa.concat_tables(waiting), True)


def format_conversations(turns: DataFrame, trained: str = "assistant", part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per conversation (or part of a very long one): conv_id, part, n_turns, formatted and the loss mask.

    ``loss_starts`` and ``loss_ends`` are code points of ``formatted``: the texts of turns whose role is ``trained``.
    Parts of a conversation are in order, in one partition.
    """
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(lambda it: _format_partition(it, trained, part_bytes), FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation, from its formatted parts alone; parts follow each other."""
    state: list | None = None

    def row(s: list) -> dict:
        return {"conv_id": s[0], "n_turns": s[1], "turns_sha256": s[2].hexdigest(), "loss_chars": s[3], "loss_sha256": s[4].hexdigest(), "formatted_chars": s[5]}

    for batch in batches:
        done = []
        for x in batch.to_pylist():
            if x["part"] == 0:
                if state:
                    done.append(row(state))
                state = [x["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse_turns(x["formatted"]):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            for lo, hi in zip(x["loss_starts"], x["loss_ends"], strict=True):
                text = unescape(x["formatted"][lo:hi])
                state[3] += len(text)
                state[4].update(text.encode())
            state[5] += len(x["formatted"])
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_DIGEST_SCHEMA)
    if state:
        yield pa.RecordBatch.from_pylist([row(state)], schema=_DIGEST_SCHEMA)


_DIGEST_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one with control strings inside its texts; digests are read back from the output."""
    from ..runtime import ship, table

    ship(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.sql(r"SELECT * FROM VALUES (-7L, 0L, 'user', r'\### Assistant: </turn> ok'), (-7L, 1L, 'assistant', r'\### Assistant: </turn> ok') AS t(conv_id, turn, role, text)")
    return format_conversations(turns.unionByName(tricky)).mapInArrow(_read_back, DIGESTS)


OP2_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\\'), '### ', '\h'), '</turn>', '\e'))
  + length(replace(replace(replace(replace(role, '\', '\\'), '### ', '\h'), '</turn>', '\e'), ':', '\c')) + 15 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
