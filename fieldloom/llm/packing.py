"""Packing of tokenised documents into training sequences of balanced attention cost."""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .shared import prepare

SEQUENCE = 1024
#: Tokens that one plan covers. It bounds a task's memory; padding does not depend on it.
WINDOW = 1 << 20
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n, in units of one token's projections (hidden size 1024).
LINEAR, QUADRATIC = 1.0, 1.0 / 6144
#: A longer text is tokenised in parts.
LONG_CHARS = 1 << 19

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: Characters on which both tokenizer libraries split alike whatever their Unicode version.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-ɏ–—‘-”…]")
#: No token of this vocabulary spans a letter, then a space, so a long text may be cut here.
_SEAM = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
#: The split pattern that the vocabulary file's byte-level pre-tokenizer stands for.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of the byte-level vocabulary in a ``tokenizers`` JSON file.

    Plain texts go through tiktoken, which reads the same vocabulary as ranks and is several
    times faster; every other text (unusual characters, strings of special tokens) goes
    through tokenizers itself. Ids are the same.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("plain", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _part(self, text: str) -> np.ndarray:
        if _PLAIN.search(text) or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= LONG_CHARS:
            return self._part(text)
        parts, a = [], 0
        while len(text) - a > LONG_CHARS:
            seam = _SEAM.search(text, a + LONG_CHARS)
            if seam is None:
                break
            parts.append(self._part(text[a : seam.start()]))
            a = seam.start()
        return np.concatenate([*parts, self._part(text[a:])])


@functools.lru_cache(maxsize=2)
def encoder(path: str | None) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Encoder(path)


def plan(lengths: np.ndarray, size: int = SEQUENCE) -> np.ndarray:
    """Rows (document, start, length, sequence, offset): every token of every document in one place, no sequence over ``size``.

    Whole sequences are cut off long documents. What is left of each document goes, costliest
    first, to the cheapest sequence that still holds all of it; what fits in none is cut and
    fills the emptiest ones. Sequences are of ``size`` tokens but for the last few, whose sizes
    are the powers of two that make up the rest, so nothing is padded.
    """
    lengths = np.asarray(lengths, np.int64)
    whole, tail = lengths // size, lengths % size
    docs = np.repeat(np.arange(len(lengths)), whole)
    nth = np.arange(len(docs)) - np.repeat(np.cumsum(whole) - whole, whole)
    out = [np.stack([docs, nth * size, np.full(len(docs), size), np.arange(len(docs)), np.zeros(len(docs), np.int64)], 1)]
    total = int(tail.sum())
    room = np.array([size] * (total // size) + [1 << b for b in range(size.bit_length() - 1, -1, -1) if (total % size) >> b & 1], np.int64)
    full, cost = room.copy(), np.zeros(len(room))
    rows, rest = [], []

    def put(doc, start, n, s):
        rows.append((doc, start, n, len(docs) + s, full[s] - room[s]))
        room[s] -= n
        cost[s] += LINEAR * n + QUADRATIC * n * n

    for doc in np.argsort(-(LINEAR * tail + QUADRATIC * tail * tail), kind="stable"):
        n = int(tail[doc])
        if n == 0:
            break
        fits = np.where(room >= n, cost, np.inf)
        s = int(np.argmin(fits))
        if np.isfinite(fits[s]):
            put(doc, whole[doc] * size, n, s)
        else:
            rest.append((doc, n))
    for doc, n in rest:
        start = whole[doc] * size
        while n:
            s = int(np.argmax(room))
            take = min(n, int(room[s]))
            put(doc, start, take, s)
            start, n = start + take, n - take
    return np.concatenate([*out, np.array(rows, np.int64).reshape(-1, 5)])


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    A document is its text's ids and ``end_id``; a null or empty text is ``end_id`` alone. Each
    row of ``docs`` is packed, repeated rows each by themselves, rows with a null doc_id with
    that null. ``tokenizer`` is the path of a vocabulary file that every worker can read (by
    default that of the installed package). Each input partition is packed in windows of about
    a million tokens, without any shuffle; a document is cut at a window's end if it has to be.
    Other columns are not read. An empty table gives no rows.
    """
    prepare(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        encode = encoder(tokenizer).encode
        sequence = TaskContext.get().partitionId() << 40
        held, tokens = [], 0

        def flush():
            nonlocal sequence
            pieces = plan([len(ids) for _, _, ids, _ in held], size)
            pieces = pieces[np.lexsort((pieces[:, 4], pieces[:, 3]))]
            cols = [[held[d][0] for d in pieces[:, 0]], [held[d][1] + s for d, s in zip(pieces[:, 0], pieces[:, 1], strict=True)], pieces[:, 2]]
            cols += [[zlib.crc32(held[d][2][s : s + n]) for d, s, n in pieces[:, :3]], [held[d][3] for d in pieces[:, 0]], sequence + pieces[:, 3], pieces[:, 4]]
            sequence += int(pieces[:, 3].max()) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_PIECES)

        for batch in batches:
            for doc, text in zip(tk.column(batch, "doc_id").to_pylist(), tk.column(batch, "text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                at = 0
                while at < len(ids):
                    part = ids[at : at + WINDOW - tokens] if len(ids) > WINDOW else ids
                    held.append((doc, at, part, len(ids)))
                    at, tokens = at + len(part), tokens + len(part)
                    if tokens >= WINDOW:
                        yield flush()
                        held, tokens = [], 0
        if held:
            yield flush()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
