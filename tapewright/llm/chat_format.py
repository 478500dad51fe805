"""Chat formatting with offset-aligned loss masks: conversations are rendered and encoded once with offsets, and
sorted turn spans are intersected with token spans by binary search."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
#: Turns and characters of a part. Markers are tokens of their own, so parts encode as the whole would.
PART_TURNS, PART_CHARS = 64, 1 << 20
LOSS_ROLE = "assistant"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)
SCHEMA = "conv_id long, part int, text string, ids array<int>, loss_mask array<boolean>, loss_spans array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    r"""Control strings start with ``<|``: ``<``, any backslashes and ``|`` get one backslash more."""
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


@lru_cache(1)
def tokenizer(path: str | None = None):
    import public_tokenizers
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
    t.add_special_tokens([AddedToken(m, normalized=False) for m in (START, TEXT, END)])
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


def loss_tokens(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens meet a span, and the spans' characters that they cover (merged, clipped, in order)."""
    mask = np.zeros(len(offsets), bool)
    if not len(spans) or not len(offsets):
        return mask, np.zeros((0, 2), np.int64)
    at = np.searchsorted(spans[:, 1], offsets[:, 0], "right")
    ok = at < len(spans)
    at = np.minimum(at, len(spans) - 1)
    mask = ok & (spans[at, 0] < offsets[:, 1]) & (offsets[:, 1] > offsets[:, 0])
    lo, hi = np.maximum(offsets[mask, 0], spans[at[mask], 0]), np.minimum(offsets[mask, 1], spans[at[mask], 1])
    done = np.maximum.accumulate(np.concatenate([[0], hi]))[:-1] if len(hi) else hi
    lo = np.maximum(lo, done)
    lo, hi, own = lo[lo < hi], hi[lo < hi], at[mask][lo < hi]
    new = np.flatnonzero(np.concatenate([[True], (lo[1:] != hi[:-1]) | (own[1:] != own[:-1])])) if len(lo) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(lo)) - 1
    return mask, np.stack([lo[new], hi[last]], 1)


def _format(path: str | None, loss_role: str):
    def render(conv, part: int, turns: list[tuple[str, str]]) -> tuple:
        pieces, spans, at = [], [], 0
        for role, text in turns:
            head, body = START + escape(role) + TEXT, escape(text)
            if role == loss_role and body:
                spans.append((at + len(head), at + len(head) + len(body)))
            pieces += [head, body, END]
            at += len(head) + len(body) + len(END)
        whole = "".join(pieces)
        e = tokenizer(path).encode(whole, add_special_tokens=False)
        mask, loss = loss_tokens(np.array(e.offsets, np.int64).reshape(-1, 2), np.array(spans, np.int64).reshape(-1, 2))
        return conv, part, whole, e.ids, mask.tolist(), [{"start": int(a), "end": int(b)} for a, b in loss]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        turns: list[tuple[str, str]] = []
        held: tuple | None = None
        part = size = 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
                if held is not None and (held[0] != conv or len(turns) >= PART_TURNS or size >= PART_CHARS):
                    yield render(held[0], part, turns)
                    part = part + 1 if held[0] == conv else 0
                    turns, size = [], 0
                held = (conv,)
                turns.append((role or "", text or ""))
                size += len(text or "")
        if held is not None:
            yield render(held[0], part, turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        names = ["conv_id", "part", "text", "ids", "loss_mask", "loss_spans"]
        rows: list[tuple] = []
        size = 0
        for row in parts(batches):
            rows.append(row)
            size += len(row[2])
            if size > 1 << 21:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                         loss_role: str = LOSS_ROLE, tokenizer_path: str | None = None) -> DataFrame:
    """(conv_id, part, text, ids, loss_mask, loss_spans): the formatted conversations.

    A conversation's turns, by turn, then role, then text, are rendered between markers, which are tokens of their
    own; what looks like one inside a role or text is escaped. Conversations longer than a part's bound continue in
    further parts, consecutive rows of one partition: a task streams through its rows and holds one part.
    ``loss_mask`` marks the tokens that meet a text of ``loss_role``, ``loss_spans`` its characters under them.

    Null role and text count as empty, a null turn comes first, null conversation ids are one conversation. Repeated
    rows are turns of their own. An empty table gives an empty result. Only the four named columns are read."""
    rows = turns.select(F.col(conv_col).cast("long").alias("c"), F.col(role_col).alias("r"), F.col(text_col).alias("t"), F.col(turn_col).alias("n"))
    rows = rows.repartition("c").sortWithinPartitions("c", "n", "r", "t").select("c", "r", "t")
    return rows.mapInArrow(_format(tokenizer_path, loss_role), SCHEMA)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, out = None, []

    def row(h: list) -> tuple:
        return h[0], h[1], h[2].hexdigest(), h[3], h[4].hexdigest(), h[5], h[6], h[7]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for x in batch.to_pylist():
            if held is None or x["part"] == 0:
                if held is not None:
                    out.append(row(held))
                held = [x["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            for role, text in _TURN.findall(x["text"]):
                held[1] += 1
                held[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            for s in x["loss_spans"]:
                masked = unescape(x["text"][s["start"] : s["end"]])
                held[3] += len(masked)
                held[4].update(masked.encode())
            held[5] += len(x["text"])
            held[6] += len(x["ids"])
            held[7] += sum(x["loss_mask"])
        if len(out) > 4096:
            yield pack(out)
            out = []
    if held is not None:
        yield pack([*out, row(held)])


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation, from the output of ``format_conversations`` in its order: turns and loss text are
    parsed from the formatted text, the spans and the mask, and unescaped."""
    return formatted.mapInArrow(
        _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
    )
