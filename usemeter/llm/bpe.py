"""Byte-level BPE of a public vocabulary file: pieces that encode independently, cached encoding, decoding.

A space between two characters that are not white space always starts a pre-token, so a text may be cut
there: the ids of the whole are the ids of its pieces.  Most pieces are words met before; each task asks
the library for new ones only.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

from usemeter.llm.common import release

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_SYNC = re.compile(r"(?<=\S) (?=\S)")
#: White space of any script but the space and the line feed.
_RARE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_RARE_ASCII = [c for c in _RARE if c.isascii()]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(text: str) -> list[str]:
    """``text`` cut at the single spaces between words, these spaces left out."""
    even = not ("  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " ")
    if even and not any(c in text for c in (_RARE_ASCII if text.isascii() else _RARE)):
        return text.split(" ")
    return _SYNC.split(text)


class Vocabulary:
    """What the file says: merges by rank, special strings, and whether texts may be cut at single spaces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex"):
            raise ValueError("a byte-level BPE vocabulary with the usual word pattern is needed")
        if spec.get("normalizer") or before.get("add_prefix_space") or any(
            t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")
        ):
            raise ValueError("normalisers, prefix spaces and greedy special strings are not supported")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = spec["model"]["merges"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        del spec
        release()  # reading the file takes more than what is kept of it

    def ranks(self) -> dict[tuple[str, str], int]:
        return {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(self.merges)}

    def split_special(self, text: str) -> list[str]:
        """Ordinary text and special strings in turn, ordinary first and last."""
        if not self.special or not self.special.search(text):
            return [text]
        return re.split(f"({self.special.pattern})", text)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i] .. starts[i] + lengths[i] - 1`` for all i, end to end."""
    ends = np.cumsum(lengths, dtype=np.int64)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class _Places(dict):
    """Where a piece is kept; a new one gets the next place."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = place = len(self)
        self.new.append(piece)
        return place


class Encoder:
    """Ids of texts, piece by piece; new pieces go to the library in one call.

    A key is a piece without the space before it; a text's first piece, which has none, gets one as its mark.
    Beyond ``limit`` pieces the half that was met most often is remembered.
    """

    def __init__(self, path: str, limit: int = 1_100_000):
        self.vocabulary, self.limit = Vocabulary(path), limit
        self.places = _Places()
        self.ids = np.zeros(0, np.uint16 if self.vocabulary.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int32)
        self.uses = np.zeros(0, np.int32)

    def _forget(self) -> None:
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: self.limit // 2])
        new = np.full(len(self.uses), -1, np.int64)
        new[kept] = np.arange(len(kept))
        self.ids = self.ids[ragged(self.starts[kept], self.lengths[kept])]
        self.lengths, self.uses = self.lengths[kept], self.uses[kept] // 2
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        places = _Places()
        places.update((piece, at) for piece, at in zip(self.places, new.tolist()) if at >= 0)
        self.places = places

    def _learn(self) -> None:
        new = [p[1:] if p[:1] == " " else " " + p for p in self.places.new]
        self.places.new = []
        flat, lengths = self._by_library(new)
        starts = np.cumsum(lengths) - lengths + len(self.ids)
        self.ids, self.starts, self.lengths = np.r_[self.ids, flat], np.r_[self.starts, starts], np.r_[self.lengths, lengths]
        self.uses = np.r_[self.uses, np.zeros(len(new), np.int32)]

    def _by_library(self, new: list[str], at_once: int = 200) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short pieces end to end, and how many each has; a special string between them tells them apart."""
        encode, special = self.vocabulary.tokenizer.encode_batch_fast, self.vocabulary.special
        kind = self.ids.dtype
        if not special or any(special.search(p) for p in new):
            found = [e.ids for e in encode(new, add_special_tokens=False)]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for ids in found for i in ids), kind, int(lengths.sum())), lengths.astype(np.int32)
        mark = self.vocabulary.specials[0]
        mark_id = self.vocabulary.tokenizer.token_to_id(mark)
        joined = [mark.join([*new[i : i + at_once], ""]) for i in range(0, len(new), at_once)]
        ids = np.concatenate([np.array(e.ids, kind) for e in encode(joined, add_special_tokens=False)])
        ends = np.flatnonzero(ids == mark_id)
        return ids[ids != mark_id], (np.diff(np.r_[-1, ends]) - 1).astype(np.int32)

    def encode(self, texts: Iterable[str], at_once: int = 1 << 20) -> Iterator[np.ndarray]:
        """The ids of each text, in order; about ``at_once`` characters are looked at together."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= at_once:
                yield from self._encode(group)
                group, size = [], 0
        if group:
            yield from self._encode(group)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.places) > self.limit:
            self._forget()
        at, counts, get = [], [], self.places.__getitem__
        for text in texts:
            parts = pieces(text)
            parts[0] = " " + parts[0]
            at.append(np.fromiter(map(get, parts), np.int32, len(parts)))
            counts.append(len(parts))
        if self.places.new:
            self._learn()
        at = np.concatenate(at)
        self.uses += np.bincount(at, minlength=len(self.uses)).astype(np.int32)
        lengths = self.lengths[at]
        ends = np.cumsum(lengths, dtype=np.int64)
        return np.split(self.ids[ragged(self.starts[at], lengths)], ends[np.cumsum(counts)[:-1] - 1])

    def encode_one(self, text: str) -> np.ndarray:
        """By the library alone: for texts that will not come again."""
        return np.array(self.vocabulary.tokenizer.encode(text, add_special_tokens=False).ids, self.ids.dtype)

    def decode(self, ids: np.ndarray) -> str:
        return self.vocabulary.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, limit: int = 1_100_000) -> Encoder:
    """The worker process's encoder of this file: what one task has learnt serves the next.

    A remembered piece takes about 250 bytes; fewer remembered ones cost more calls of the library.
    """
    if (path, limit) not in _encoders:
        _encoders.clear()
        _encoders[path, limit] = Encoder(path, limit)
    return _encoders[path, limit]
