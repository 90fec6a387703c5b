"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a pre-token form a linked list, its adjacent pairs a heap ordered by merge rank, then by
place.  The lowest pair is popped and merged until no known pair is left: the count is the number of symbols
less the number of merges.  No ids are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from usemeter.llm.bpe import Vocabulary, pieces
from usemeter.llm.common import narrow, record_batch

_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def merged_length(symbols: str, ranks: dict[tuple[str, str], int]) -> int:
    """Tokens of one pre-token, given one character for each of its bytes."""
    n = len(symbols)
    if n < 2:
        return n
    token = list(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(ranks[pair], i, pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks]
    heapify(heap)
    merges = 0
    while heap:
        _, i, pair = heappop(heap)
        j = after[i] if token[i] is not None else n
        if j >= n or token[i] != pair[0] or token[j] != pair[1]:
            continue  # one of the two has been merged since
        merges += 1
        token[i], token[j] = pair[0] + pair[1], None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (new := (token[i], token[k])) in ranks:
                heappush(heap, (ranks[new], i, new))
        if (h := before[i]) >= 0 and (new := (token[h], token[i])) in ranks:
            heappush(heap, (ranks[new], h, new))
    return n - merges


class _Known(dict):
    """Counts of what has been met; ``work`` counts what is new."""

    def __init__(self, work):
        super().__init__()
        self.work = work

    def __missing__(self, key: str) -> int:
        self[key] = n = self.work(key)
        return n


class TokenCounter:
    """Counts tokens of texts; remembers pre-tokens and whole words, at most ``limit`` of each."""

    def __init__(self, path: str, limit: int = 600_000):
        self.vocabulary, self.limit = Vocabulary(path), limit
        self.split = self.vocabulary.tokenizer.pre_tokenizer.pre_tokenize_str
        ranks = self.vocabulary.ranks()
        self.tokens = _Known(lambda symbols: merged_length(symbols, ranks))
        self.words = _Known(self._word)

    def _word(self, key: str) -> int:
        """A key is a piece without the space before it, or with a space if it has none."""
        piece = key[1:] if key[:1] == " " else " " + key
        return sum(self.tokens[symbols] for symbols, _ in self.split(piece))

    def count(self, text: str) -> int:
        for known in (self.tokens, self.words):
            if len(known) > self.limit:
                known.clear()
        total = 0
        for i, part in enumerate(self.vocabulary.split_special(text)):
            if i % 2:
                total += 1
            elif part:
                words = pieces(part)
                words[0] = " " + words[0]
                total += sum(map(self.words.__getitem__, words))
        return total


_counters: dict[str, TokenCounter] = {}


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row of ``docs``, counted as the vocabulary's library does.

    A null text counts as empty (0 bytes, 0 tokens); repeated rows and null ids each give their own row; an empty
    table gives no rows; other columns are not looked at.  Special strings within a text are one token each.
    One pass without a shuffle: each worker process remembers the words it has met.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _counters:
            _counters[vocabulary] = TokenCounter(vocabulary)
        counter = _counters[vocabulary]
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = [counter.count(t) for t in texts]
            sizes = [len(t.encode()) for t in texts]
            yield record_batch(_RESULT, batch.column("id").to_pylist(), sizes, counts, [n > limit for n in counts])

    return narrow(docs, text, key).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
