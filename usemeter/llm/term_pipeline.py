"""Ranked lexical search by pipelined term partitioning.

Terms belong to owners by how many documents hold them, the rarest first.  Items travel in bundles: for each
block of documents a bundle carries, for every item, the documents met so far and their scores.  Successive
stages cogroup the bundles with the next owner's lists of that block and add its integer contributions; what
the last owner leaves is cut to the best ``k`` a block and then over all blocks.

A score only grows, and a term adds less than ``weight * SCALE``.  So a document whose score plus all that later
owners can add stays below the item's ``k``-th best score in its block is not among the best ``k`` and leaves the
bundle: the sums that travel stay few, the result is the full one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usemeter.llm.common import from_planes, keep, narrow, planes, record_batch

#: Documents of a block, items of a bundle: what one cogroup call holds.
BLOCK_DOCS = 4096
BUNDLE_ITEMS = 256
#: Owners: terms in up to 1/64 of the documents, in up to 1/8, and the others.
OWNER_SHARES = (64, 8)
#: Bits of the sketch of wanted terms, whatever their number (1 MB).
SKETCH_BITS = 1 << 23
SCALE = 1_000_000
_MEMORY, _REMEMBERED = 1 << 19, 64  # terms of up to so many bytes that a task remembers as wanted or not

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_BLOCK_DDL = "block long, term binary, ids array<long>, places binary, numbers binary, n_docs long, n_terms long"
_BLOCK = pa.schema(
    [("block", pa.int64()), ("term", pa.binary()), ("ids", pa.list_(pa.int64())), ("places", pa.binary()), ("numbers", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())]
)
_CARRY_DDL = "block long, bundle int, item long, head boolean, ids array<long>, places binary, numbers binary"
_CARRY = pa.schema(
    [("block", pa.int64()), ("bundle", pa.int32()), ("item", pa.int64()), ("head", pa.bool_()), ("ids", pa.list_(pa.int64())), ("places", pa.binary()), ("numbers", pa.binary())]
)
_FOUND_DDL = "item_id long, doc_id long, score long"
_FOUND = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_LOWER).split()


def _item_terms(items: DataFrame, text: str, key: str) -> DataFrame:
    """``item, term``, each once."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item", pa.int64()), ("term", pa.binary())])
        for batch in batches:
            rows = [(i, t) for i, x in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()) for t in set(terms_of(x.encode()))]
            yield record_batch(schema, [i for i, _ in rows], [t for _, t in rows])

    return narrow(items, text, key).mapInArrow(split, "item long, term binary").distinct()


def _sketch(wanted: DataFrame) -> bytes:
    """A bit for each wanted term's hash: ``SKETCH_BITS`` bits, whatever their number."""
    place = F.pmod(F.xxhash64("term"), F.lit(SKETCH_BITS)) + 1
    rows = wanted.groupBy(F.bitmap_bucket_number(place).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bits = bytearray(SKETCH_BITS // 8)
    for row in rows:
        at = (row.n - 1) * len(row.bits)
        bits[at : at + len(row.bits)] = row.bits
    return bytes(bits)


def _blocks(docs: DataFrame, sketch: bytes, text: str, key: str, size: int) -> DataFrame:
    """The documents in blocks: a row with ids and lengths, and a list for each term that may be wanted.

    A block is what its task read in a row, so no document moves to be indexed.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number, known = TaskContext.get().partitionId() << 32, 0, {}
        ids, lengths, lists = [], [], {}

        def out() -> pa.RecordBatch:
            n = len(lists)
            lengths_ = np.array(lengths, np.int64)
            held = [np.array(x, np.int64).reshape(-1, 2) for x in lists.values()]
            return record_batch(
                _BLOCK, [first + number] * (n + 1), [None, *lists], [ids, *[None] * n],
                [None, *[planes(np.ascontiguousarray(x[:, 0]).astype(np.uint32)) for x in held]],
                [planes(lengths_), *[planes(np.ascontiguousarray(x[:, 1])) for x in held]],
                [len(ids), *map(len, held)], [int(lengths_.sum()), *[0] * n],
            )

        for batch in batches:
            for doc, x in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary())):
                terms = terms_of(x.as_py())
                if not terms:
                    continue
                for term, count in Counter(terms).items():
                    hit = known.get(term)
                    if hit is None:
                        place = xxhash.xxh64_intdigest(term, seed=42) % SKETCH_BITS
                        hit = sketch[place >> 3] >> (place & 7) & 1
                        if len(term) <= _REMEMBERED:
                            if len(known) >= _MEMORY:
                                known.clear()
                            known[term] = hit
                    if hit:
                        lists.setdefault(term, []).append((len(ids), count))
                ids.append(doc)
                lengths.append(len(terms))
                if len(ids) >= size:
                    yield out()
                    number, ids, lengths, lists = number + 1, [], [], {}
        if ids:
            yield out()

    return narrow(docs, text, key).mapInArrow(index, _BLOCK_DDL)


def contributions(weight: int, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to documents that hold it ``tf`` times and have the length norm ``m``."""
    return weight * ((1000 * SCALE * tf) // (1000 * tf + 8 * m))


def _best(scores: np.ndarray, ids: list, k: int) -> np.ndarray:
    """Places of the best ``k`` positive scores, equal ones by ascending id, null ids last."""
    at = np.flatnonzero(scores)
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], -k)[-k]]
    return np.array(sorted(at.tolist(), key=lambda i: (-scores[i], ids[i] is None, ids[i] or 0))[:k], np.int64)


def visit(left: pa.Table, right: pa.Table, k: int) -> tuple[list, dict]:
    """An owner's contributions added to a bundle: the block's ids, and for each item ``(places, scores)``.

    ``left`` holds the block's ids with their norms (the head) and the bundle's sums, ``right`` the owner's lists with
    the items that ask for the term, and what later owners can add to each.
    """
    ids, norms, sums = [], np.zeros(0, np.int64), {}
    for row in left.select(["item", "head", "ids", "places", "numbers"]).to_pylist():
        if row["head"]:
            ids, norms = row["ids"], from_planes(row["numbers"], np.int64)
        else:
            sums[row["item"]] = from_planes(row["places"], np.uint32), from_planes(row["numbers"], np.int64)
    asked, rest = {}, {}
    for row in right.select(["weight", "askers", "places", "numbers"]).to_pylist():
        places = from_planes(row["places"], np.uint32)
        added = contributions(row["weight"], from_planes(row["numbers"], np.int64), norms[places])
        for asker in row["askers"]:
            asked.setdefault(asker["item"], []).append((places, added))
            rest[asker["item"]] = asker["rest"]
    for item, parts in asked.items():
        scores = np.zeros(len(ids), np.int64)
        for places, added in ([sums[item]] if item in sums else []) + parts:
            scores[places] += added
        at = np.flatnonzero(scores)
        if len(at) > k:
            at = at[scores[at] + rest[item] >= np.partition(scores[at], -k)[-k]]
        sums[item] = at.astype(np.uint32), scores[at]
    return ids, sums


def _stage(k: int, last: bool) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def stage(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block, bundle = (x.as_py() for x in key)
        ids, sums = visit(left, right, k)
        if last:
            rows = []
            for item, (places, scores) in sums.items():
                rows += [(item, ids[places[i]], int(scores[i])) for i in _best(scores, [ids[p] for p in places], k).tolist()]
            return pa.table(dict(zip(_FOUND.names, map(list, zip(*rows)))) if rows else {n: [] for n in _FOUND.names}, _FOUND)
        head = left.filter(left["head"]).select(_CARRY.names).cast(_CARRY)
        n = len(sums)
        carried = record_batch(
            _CARRY, [block] * n, [bundle] * n, list(sums), [False] * n, [None] * n,
            [planes(p) for p, _ in sums.values()], [planes(s) for _, s in sums.values()],
        )
        return pa.concat_tables([head, pa.Table.from_batches([carried])])

    return stage


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", doc_key: str = "doc_id", item_key: str = "item_id",
    block_docs: int = BLOCK_DOCS, bundle_items: int = BUNDLE_ITEMS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item.

    Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased.  N counts the
    documents with a term, L their terms; a term in df documents weighs ``floor(1000 * ln((2N + 2) / (2df + 1)))``; a
    document of n terms has the norm ``m = 10 + (90 * n * N) div L``; a term that stands tf times adds
    ``weight * ((10**9 * tf) div (1000 * tf + 8 * m))``, 64-bit integers throughout.  Only scores above 0 count.

    Null and empty texts have no terms and are never found; an item without terms, or without a hit, has no row.
    Rows with the same item id are one item with all their terms; every document row counts for itself, equal ids
    included.  Equal scores go by ascending document id, null ids last; a null item id is an item like others.
    Empty tables give no rows.

    What stays bounded: a group holds one block's documents and one bundle's items; the items' terms reach the scan
    as a sketch of fixed size whose false hits end at the join on the term; a term has one list a block, so no term
    is hot, and the bundles of a block are dealt by (block, bundle).
    """
    spark = docs.sparkSession
    wanted = keep(_item_terms(items, text, item_key), "wanted-terms")
    blocks = keep(_blocks(docs, _sketch(wanted), text, doc_key, block_docs), "term-blocks")
    heads, lists = blocks.where("term is null"), blocks.where("term is not null")
    n_docs, n_terms = heads.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    n_bundles = -(-wanted.agg(F.count_distinct("item")).first()[0] // bundle_items) or 1

    ratio = F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")
    owner = sum(((F.col("df") * share > n_docs).cast("int") for share in OWNER_SHARES), F.lit(0))
    weighed = (
        lists.groupBy("term").agg(F.sum("n_docs").alias("df"))
        .select("term", F.floor(1000 * F.log(ratio)).cast("long").alias("weight"), owner.alias("owner"))
        .where("weight > 0")
    )
    asked = keep(wanted.join(weighed, "term"), "asked-terms")
    owners = len(OWNER_SHARES) + 1
    later = [F.sum(F.when(F.col("owner") > o, F.col("weight")).otherwise(0)).alias(f"rest{o}") for o in range(owners)]
    rests = asked.groupBy("item").agg(*later).withColumnRenamed("item", "of")
    rest = F.element_at(F.array(*[f"rest{o}" for o in range(owners)]), F.col("owner") + 1) * SCALE
    bundle = F.pmod(F.xxhash64("item"), F.lit(n_bundles)).cast("int")
    askers = keep(
        asked.join(rests, F.col("item").eqNullSafe(F.col("of")))
        .groupBy("term", "owner", "weight", bundle.alias("bundle"))
        .agg(F.collect_list(F.struct("item", rest.alias("rest"))).alias("askers")),
        "term-askers",
    )
    asked_lists = keep(lists.select("block", "term", "places", "numbers").join(askers, "term"), "asked-lists")

    norm = _norms(n_docs, n_terms)
    carried = heads.select("block", "ids", "numbers").mapInArrow(norm, "block long, ids array<long>, numbers binary").select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(n_bundles - 1))).alias("bundle"), F.lit(None).cast("long").alias("item"),
        F.lit(True).alias("head"), "ids", F.lit(None).cast("binary").alias("places"), "numbers",
    )
    for o in range(owners):
        last = o == owners - 1
        owned = asked_lists.where(F.col("owner") == o).select("block", "bundle", "weight", "askers", "places", "numbers")
        carried = carried.groupBy("block", "bundle").cogroup(owned.groupBy("block", "bundle")).applyInArrow(
            _stage(k, last), _FOUND_DDL if last else _CARRY_DDL
        )
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return carried.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _norms(n_docs: int, n_terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lengths of a block's documents to their norms."""

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [planes(10 + (90 * from_planes(x.as_py(), np.int64) * n_docs) // n_terms) for x in batch.column("numbers")]
            yield batch.set_column(2, "numbers", pa.array(found, pa.binary()))

    return norm
