"""Chat formatting with loss masks that are aligned by offsets.

A turn is rendered as ``<turn>role</role>text</turn>`` and a line end. Inside
role and text a backslash is doubled, and a backslash goes behind the ``<`` of
each control string. So no control string stands inside a text, and dropping
one backslash before each escaped character gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, BETWEEN, CLOSE = "<turn>", "</role>", "</turn>\n"
CONTROL = re.compile("<(?=/?turn>|/role>)")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: A rendered block is closed at the end of the turn that reaches this many characters. Turn marks are tokens of their own, so a block encodes as it would inside its conversation.
BLOCK_CHARS = 1_000_000
BLOCKS = "conv_id bigint, block bigint, first_turn bigint, n_turns bigint, formatted string, ids array<int>, token_mask array<boolean>, turn_starts array<int>, text_starts array<int>, text_ends array<int>, loss_starts array<int>, loss_ends array<int>"


def escape(text: str) -> str:
    return CONTROL.sub(r"<\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, int, bool]]]:
    """The formatted text, and per turn its start, its text's start and end, and whether its text bears loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + BETWEEN, escape(text)
        spans.append((at, at + len(head), at + len(head) + len(body), role == "assistant"))
        parts += [head, body, CLOSE]
        at = spans[-1][2] + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Read turns back from a formatted text alone."""
    out = []
    for turn in formatted.split(CLOSE)[:-1]:
        role, text = turn.removeprefix(OPEN).split(BETWEEN)
        out.append((unescape(role), unescape(text)))
    return out


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    """The marks are added as tokens, so no merge joins a mark with what stands beside it."""
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # special strings of the vocabulary in a text are ordinary text
    t.add_tokens([AddedToken(x, normalized=False) for x in (OPEN, BETWEEN, CLOSE)])
    return t


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens lie in one of the sorted, disjoint, non-empty spans, and in which: a binary search of each token's start."""
    if not spans or not len(offsets):
        return np.zeros(len(offsets), bool), np.zeros(len(offsets), np.int64)
    starts, ends = np.array(spans).T
    at = np.searchsorted(starts, offsets[:, 0], side="right") - 1
    inside = (at >= 0) & (offsets[:, 0] < ends[at]) & (offsets[:, 1] <= ends[at])
    return inside, at


def runs(offsets: np.ndarray, marked: np.ndarray, span: np.ndarray) -> list[tuple[int, int]]:
    """The characters under a token mask: a run of marked tokens of one span without a gap is one stretch."""
    low, high, of = offsets[marked, 0], offsets[marked, 1], span[marked]
    if not len(low):
        return []
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (low[1:] > high[:-1])]))
    last = np.concatenate([new[1:], [len(low)]]) - 1
    return list(zip(low[new].tolist(), high[last].tolist(), strict=True))


def format_conversations(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """Blocks of formatted conversations with ids, token masks and spans (in characters).

    Needs conv_id, turn, role, text; other columns are ignored. A null role or
    text is empty, rows with a null conv_id form one conversation, a null turn
    comes first, and rows with equal turn are ordered by role, then text, so
    repeated rows each give a turn. An empty table gives no rows.

    Rows are dealt by ranges of (conv_id, turn), so a conversation with very
    many turns spreads over tasks; each task renders stretches of its sorted
    rows. Most conversations are one block. Block numbers rise with the turns.
    """
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return dealt.mapInArrow(lambda batches: _blocks(batches, tokenizer_path), BLOCKS)


def _rows(batches):
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in b.slice(at, 1024).columns), strict=True)


def _blocks(batches, path: str):
    lot, held = [], 0
    for conv, group in groupby(_rows(batches), key=lambda r: r[0]):
        block, turns, first, chars = 0, [], None, 0
        for _, turn, role, text in group:
            if not turns:
                first = turn
            turns.append((role, text))
            chars += len(text) + len(role) + 16
            if chars >= BLOCK_CHARS:
                lot.append((conv, block, first, turns))
                held += chars
                block, turns, chars = block + 1, [], 0
                if held >= BLOCK_CHARS:
                    yield _encoded(lot, path)
                    lot, held = [], 0
        if turns:
            lot.append((conv, block, first, turns))
            held += chars
        if held >= BLOCK_CHARS:
            yield _encoded(lot, path)
            lot, held = [], 0
    if lot:
        yield _encoded(lot, path)


def _encoded(lot: list, path: str) -> pa.RecordBatch:
    made = [render(turns) for *_, turns in lot]
    out = []
    for (conv, block, first, turns), (text, spans), e in zip(lot, made, _tokenizer(path).encode_batch([m[0] for m in made], add_special_tokens=False), strict=True):
        offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
        marked, span = mask(offsets, [(a, b) for _, a, b, loss in spans if loss and b > a])
        loss = runs(offsets, marked, span)
        out.append((conv, block, first, len(turns), text, e.ids, marked.tolist(), [s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans], [a for a, _ in loss], [b for _, b in loss]))
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_())] + [pa.list_(pa.int32())] * 5
    names = ["conv_id", "block", "first_turn", "n_turns", "formatted", "ids", "token_mask", "turn_starts", "text_starts", "text_ends", "loss_starts", "loss_ends"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, n_loss_tokens bigint"


def digests(blocks: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted text and the mask's spans alone.

    A digest takes its text in order, so a conversation's blocks meet in one
    task; they stream through it, and it holds one block at a time.
    """
    ordered = blocks.select("conv_id", "first_turn", "block", "formatted", "loss_starts", "loss_ends", F.size("ids").alias("n_ids"), F.expr("size(filter(token_mask, x -> x))").alias("n_mask"))
    return ordered.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn", "block").mapInArrow(_digests, DIGEST)


def _digests(batches):
    out = []
    for conv, group in groupby(_rows_few(batches), key=lambda r: r[0]):
        whole, loss, n, chars, total, tokens, marked = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0, 0
        for _, _, _, formatted, starts, ends, n_ids, n_mask in group:
            turns = parse(formatted)
            n += len(turns)
            for role, text in turns:
                whole.update(f"{role}\n{text}\n".encode())
            for a, b in zip(starts, ends, strict=True):
                text = unescape(formatted[a:b])
                chars += len(text)
                loss.update(text.encode())
            total += len(formatted)
            tokens += n_ids
            marked += n_mask
        out.append((conv, n, whole.hexdigest(), chars, loss.hexdigest(), total, tokens, marked))
        if len(out) >= 4096:
            yield _digest_batch(out)
            out = []
    if out:
        yield _digest_batch(out)


def _rows_few(batches):
    """One row at a time becomes Python objects: a block is large."""
    for b in batches:
        for at in range(b.num_rows):
            yield tuple(c[at].as_py() for c in b.columns)


def _digest_batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])
