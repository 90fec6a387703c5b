import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from usemeter.llm.bpe import Encoder, vocabulary_path
from usemeter.llm.common import releasing
from usemeter.llm.token_counts import TokenCounter, merged_length, token_counts
from usemeter.llm.token_files import read_file, token_files, write_file
from usemeter.llm.tree_bpe import encode_text, leaf_ends, tree_encode

PATH = vocabulary_path("byte_bpe_50k.json")
TEXTS = st.one_of(
    st.text(max_size=200),
    st.text(alphabet="abt helri'\n\t.,1é漢 \x1c", max_size=200),
    st.lists(st.sampled_from(["<|endoftext|>", "'ll", " the", "ing", " ", "\n", "lama", "  ", "'s"]), max_size=40).map("".join),
    st.text(alphabet="abcdeghilnorst", min_size=50, max_size=400),
)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH, limit=500)


def library(encoder, text):
    return encoder.vocabulary.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(TEXTS, min_size=1, max_size=5))
def test_pieces_encode_as_the_whole(encoder, texts):
    assert [x.tolist() for x in encoder.encode(texts)] == [library(encoder, t) for t in texts]


@settings(max_examples=400, deadline=None)
@given(text=TEXTS, leaf=st.integers(1, 60))
def test_tree_gives_the_librarys_ids(encoder, text, leaf):
    assert encode_text(encoder, text, leaf).tolist() == library(encoder, text)


def test_tree_of_one_unbroken_run(encoder):
    text = "".join(random.Random(1).choices("abcdefghilmnorst", k=60_000))
    assert encode_text(encoder, text, 1000).tolist() == library(encoder, text)


def test_leaves_cover_the_text():
    for n in (1, 2, 7, 100):
        ends = leaf_ends("x" * n, 3)
        assert ends[-1] == n and max(np.diff([0, *ends])) <= 3


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(PATH, limit=50)


@settings(max_examples=300, deadline=None)
@given(text=TEXTS)
def test_heap_counts_as_the_library(encoder, counter, text):
    assert counter.count(text) == len(library(encoder, text))


def test_merges_take_the_lowest_rank_first():
    ranks = {("b", "c"): 0, ("a", "b"): 1, ("a", "bc"): 2, ("x", "x"): 3}
    assert merged_length("abc", ranks) == 1 and merged_length("ab", ranks) == 1 and merged_length("xxx", ranks) == 2
    assert merged_length("", ranks) == 0 and merged_length("q", ranks) == 1


@settings(max_examples=200, deadline=None)
@given(docs=st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**62), 2**62)), st.lists(st.integers(0, 2**32 - 1), max_size=300)), max_size=6))
def test_files_round_trip(docs):
    ids = [np.array(x, np.uint32) for _, x in docs]
    numbers, found = read_file(write_file([d for d, _ in docs], ids))
    assert numbers == [d for d, _ in docs] and [x.tolist() for x in found] == [x for _, x in docs]


def test_exceptions_leave_blocks_narrow():
    ids = np.r_[np.arange(1000) % 8, 1 << 31].astype(np.uint32)
    assert len(write_file([1], [ids])) < 700 and np.array_equal(read_file(write_file([1], [ids]))[1][0], ids)


def test_other_formats_are_refused():
    with pytest.raises(ValueError):
        read_file(b"something else")


def test_counts_of_odd_rows(encoder, odd_docs, odd_rows, no_docs):
    got = sorted(map(tuple, token_counts(odd_docs, PATH, limit=3).collect()), key=str)
    want = [(i, len((t or "").encode()), len(library(encoder, t or ""))) for i, t, *_ in odd_rows]
    assert got == sorted([(*w, w[2] > 3) for w in want], key=str)
    assert token_counts(no_docs, PATH).count() == 0


def test_tree_of_odd_rows(encoder, odd_docs, odd_rows, no_docs):
    got = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in tree_encode(odd_docs, PATH, leaf_chars=4).collect()), key=str)
    want = []
    for i, t, *_ in odd_rows:
        ids = np.array(library(encoder, t or ""), "<u4")
        want.append((i, len(ids), ids.tobytes(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert tree_encode(no_docs, PATH).count() == 0


def test_files_of_odd_rows(encoder, odd_docs, odd_rows, no_docs):
    got = token_files(odd_docs, PATH, 2).orderBy("start").collect()
    assert len(got) == len(odd_rows) and got[0].start == 0
    numbers = [r.doc_id for r in got]
    assert numbers == sorted(numbers, key=lambda i: (i is not None, i))
    assert [r.start for r in got[1:]] == list(np.cumsum([r.n_tokens for r in got])[:-1])
    want = {}
    for i, t, *_ in odd_rows:
        ids = np.array([*library(encoder, t or ""), 2], "<u4")
        want[i] = (len(ids), zlib.crc32(ids.tobytes()))
    assert all(want[r.doc_id] == (r.n_tokens, r.ids_crc32) for r in got)
    assert token_files(no_docs, PATH, 2).count() == 0


def test_a_task_leaves_little_memory_behind():
    """The worker process lives on: what a task's texts, pieces and arrays took goes back to the system."""

    def held() -> int:
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(line.split()[1]) for line in f if line.startswith("Private_Dirty:")) >> 10

    stays = []

    def work(batches):
        arrays = [np.arange(2000) + i for i in range(10_000)]  # 160 MB, each below the size that is mapped apart
        stays.append(arrays[-1])  # what was taken last and stays keeps all before it from going by itself
        yield from batches

    batch = pa.RecordBatch.from_pydict({"id": [1]})
    before = held()
    assert list(releasing(work)([batch])) == [batch]
    assert held() < before + 40
