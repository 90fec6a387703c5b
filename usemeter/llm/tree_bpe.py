"""BPE encoding by tree concatenation, and decoding.

A long text is cut into halves of halves down to leaves; leaves are encoded apart, in parallel tasks, then
joined pairwise up the tree.  At a join a window around the cut is encoded anew and grows until it agrees
exactly with both sides:

* between words: the window ends at spaces where the text could be cut anyway, and what both sides have
  for their part of the window must be what encoding these parts alone gives;
* inside a run of letters without any break: the window's first and last token must equal those of the
  sides.  A sequence of BPE tokens is the encoding of its bytes if every adjacent pair is, and every pair
  of the joined sequence lies within the left side, the window, or the right side.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usemeter.llm.bpe import Encoder, encoder
from usemeter.llm.common import narrow, partitions, record_batch, release, releasing

#: Pieces that a task remembers; what it has learnt goes with it, later stages have the memory.
REMEMBERED = 250_000
_SYNC = re.compile(r"(?<=\S) (?=\S)")
_LETTERS = re.compile(r"[A-Za-z]+\Z")
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded_sha256", pa.string())])
_LEAF = pa.schema([("id", pa.int64()), ("digest", pa.binary()), ("copy", pa.int64()), ("leaf", pa.int32()), ("text", pa.string())])
_ENCODED = pa.schema([*_LEAF, ("ids", pa.binary())])


def join_encoded(enc: Encoder, text: str, start: int, cut: int, end: int, left: np.ndarray, right: np.ndarray, window: int = 48) -> np.ndarray:
    """The ids of ``text[start:end]`` from those of ``text[start:cut]`` and ``text[cut:end]``."""
    while True:
        lo, hi = max(start, cut - window), min(end, cut + window)
        if lo > start:
            found = _SYNC.search(text, lo, cut)
            lo = found.start() if found else None
        if hi < end:
            found = [m.start() for m in _SYNC.finditer(text, cut + 1, hi)]
            hi = found[-1] if found else None
        if lo is not None and hi is not None:
            tail, head = enc.encode_one(text[lo:cut]), enc.encode_one(text[cut:hi])
            if np.array_equal(left[len(left) - len(tail) :], tail) and np.array_equal(right[: len(head)], head):
                return np.concatenate([left[: len(left) - len(tail)], enc.encode_one(text[lo:hi]), right[len(head) :]])
        elif (run := _within_letters(enc, text, start, cut, end, left, right, window // 4)) is not None:
            return run
        if start >= cut - window and end <= cut + window:
            return enc.encode_one(text[start:end])
        window *= 2


def _within_letters(enc: Encoder, text: str, start: int, cut: int, end: int, left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray | None:
    """The joined ids if ``k`` tokens to either side are plain letters and their encoding agrees at both edges.

    Three more letters before the window keep a contraction's apostrophe out of reach.
    """
    k_left, k_right = min(k, len(left)), min(k, len(right))
    inside_left, inside_right = enc.decode(left[len(left) - k_left :]), enc.decode(right[:k_right])
    lo, hi = cut - len(inside_left), cut + len(inside_right)
    if lo - 3 < start or hi >= end or not _LETTERS.match(text[lo - 3 : hi + 1]) or text[lo:hi] != inside_left + inside_right:
        return None
    middle = enc.encode_one(text[lo:hi])
    if len(middle) < 2 or middle[0] != left[len(left) - k_left] or middle[-1] != right[k_right - 1]:
        return None
    return np.concatenate([left[: len(left) - k_left], middle, right[k_right:]])


def concatenate(enc: Encoder, text: str, ends: list[int], ids: list[np.ndarray]) -> np.ndarray:
    """The ids of ``text`` from those of its leaves, which end at ``ends``, by joining neighbours level by level."""
    spans = list(zip([0, *ends[:-1]], ends, ids))
    while len(spans) > 1:
        pairs = [(a[0], b[1], join_encoded(enc, text, a[0], a[1], b[1], a[2], b[2])) for a, b in zip(spans[::2], spans[1::2])]
        spans = pairs + spans[len(pairs) * 2 :]
    return spans[0][2]


def leaf_ends(text: str, leaf_chars: int) -> list[int]:
    """Halve until no part has more than ``leaf_chars`` characters; a cut never splits a special string's bracket pair."""
    parts = 1
    while -(-len(text) // parts) > leaf_chars:
        parts *= 2
    return [len(text) * (i + 1) // parts for i in range(parts)]


def encode_text(enc: Encoder, text: str, leaf_chars: int) -> np.ndarray:
    """The whole tree in one process."""
    out = []
    for i, part in enumerate(enc.vocabulary.split_special(text)):
        if i % 2:
            out.append(enc.encode_one(part))
        elif part:
            ends = leaf_ends(part, leaf_chars)
            out.append(concatenate(enc, part, ends, list(enc.encode(part[a:b] for a, b in zip([0, *ends[:-1]], ends)))))
    return np.concatenate(out) if out else enc.encode_one("")


def _result(enc: Encoder, keys: list[int | None], ids: list[np.ndarray]) -> pa.RecordBatch:
    decoded = enc.vocabulary.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in decoded]
    return record_batch(_RESULT, keys, [len(x) for x in ids], [x.astype("<u4").tobytes() for x in ids], digests)


def tree_encode(docs: DataFrame, vocabulary: str, leaf_chars: int = 32_768, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded_sha256)``: each row's ids (little-endian u32) and the SHA-256 of their decoding.

    Texts up to ``leaf_chars`` characters are one leaf and are encoded where they are read.  Longer ones are
    cut into leaves that any task may encode; the leaves of one document then meet in one task for the joins.
    A null text is empty (no ids); null ids and repeated rows give a row each; an empty table gives none;
    other columns are not looked at.  Special strings in a text become their id, as the library does.
    """
    n = partitions(docs.sparkSession)
    size = F.char_length("text")
    rows = narrow(docs, text, key)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(vocabulary, REMEMBERED)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [t or "" for t in part.column("text").to_pylist()]
                plain = iter(enc.encode(t for t in texts if "<" not in t))
                yield _result(enc, part.column("id").to_pylist(), [encode_text(enc, t, leaf_chars) if "<" in t else next(plain) for t in texts])
            release()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, copy in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("copy").to_pylist()):
                ends = leaf_ends(t, leaf_chars)
                digest = hashlib.sha256(t.encode()).digest()
                m = len(ends)
                yield record_batch(_LEAF, [i] * m, [digest] * m, [copy] * m, range(m), [t[a:b] for a, b in zip([0, *ends[:-1]], ends)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(vocabulary, REMEMBERED)
        for batch in batches:
            ids = enc.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in ids], pa.binary())], schema=_ENCODED)

    def join(leaves: pa.Table) -> pa.Table:
        enc = encoder(vocabulary, 1000)
        rows = leaves.sort_by("leaf")
        parts = rows.column("text").to_pylist()
        whole = "".join(parts)
        if enc.vocabulary.special and enc.vocabulary.special.search(whole):
            ids = encode_text(enc, whole, leaf_chars)  # special strings cut the text before any leaf does
        else:
            ids = concatenate(enc, whole, np.cumsum([len(p) for p in parts]).tolist(), [np.frombuffer(b, enc.ids.dtype) for b in rows.column("ids").to_pylist()])
        return pa.Table.from_batches([_result(enc, [rows.column("id")[0].as_py()], [ids])])

    result = "doc_id long, n_tokens long, ids binary, decoded_sha256 string"
    at_once = rows.where(size <= leaf_chars).mapInArrow(releasing(short), result)
    leaf = "id long, digest binary, copy long, leaf int, text string"
    leaves = rows.where(size > leaf_chars).withColumn("copy", F.monotonically_increasing_id()).mapInArrow(releasing(cut), leaf)
    encoded = leaves.repartition(n, "id", "copy", "leaf").mapInArrow(releasing(encode), f"{leaf}, ids binary")
    return at_once.unionByName(encoded.groupBy("id", "digest", "copy").applyInArrow(join, result))
