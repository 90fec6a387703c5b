"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that they belong to).  Words flow from
patterns to source quotas; a pattern's first pass costs nothing, each further pass more than the one before
(convex), so text is repeated only where nothing fresh is left.  The flow says how many words each pattern
gives; whole passes go to all its documents, the rest to documents in the order of a seeded hash, the last
of them in part.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usemeter.llm.common import WORD, keep, record_batch

#: Patterns and sources meet on the driver; beyond this many the sources are no categories.
MAX_PATTERNS = 100_000
_CELLS = 1024
_GIVEN = pa.schema([("pattern", pa.list_(pa.string())), ("pattern_size", pa.int64()), ("flow", pa.int64()), ("source_sizes", pa.list_(pa.int64())), ("targets", pa.list_(pa.float64()))])


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, passes: float) -> list[float]:
    """``total`` shared by ``weights``; no share above ``passes`` times its size, the excess shared again by weight."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while open_:
        weight = sum(weights[i] for i in sorted(open_))
        share = {i: left * weights[i] / weight for i in open_}
        full = [i for i in sorted(open_) if share[i] > passes * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = share[i]
            break
        for i in full:
            targets[i] = float(passes * sizes[i])
            left -= targets[i]
            open_.remove(i)
    return targets


def min_cost_flow(capacities: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], passes: int) -> list[list[int]]:
    """Words from each pattern to each source, ``flow[pattern][k]`` for ``members[pattern][k]``.

    Successive cheapest augmenting paths: pass ``r`` of a pattern costs ``r * r`` a word.  Quotas that no path
    can fill stay open.
    """
    flow = [[0] * len(m) for m in members]
    used = [0] * len(members)
    for r in range(passes):
        # All arcs of this pass cost the same and more than those before: a largest flow on top of the
        # present one, along shortest paths that may take words back from a source, stays the cheapest.
        for source, quota in enumerate(quotas):
            while (need := quota - sum(flow[p][m.index(source)] for p, m in _with(members, source))) > 0:
                path = _path(source, members, flow, [c * (r + 1) - u for c, u in zip(capacities, used)])
                if path is None:
                    break
                amount = min([need, capacities[path[-1][0]] * (r + 1) - used[path[-1][0]], *(flow[p][members[p].index(s)] for p, _, s in path if s is not None)])
                for pattern, to, taken_from in path:
                    flow[pattern][members[pattern].index(to)] += amount
                    if taken_from is not None:
                        flow[pattern][members[pattern].index(taken_from)] -= amount
                used[path[-1][0]] += amount
    return flow


def _with(members, source):
    return [(p, m) for p, m in enumerate(members) if source in m]


def _path(source, members, flow, free):
    """Shortest way to bring words to ``source``: steps (pattern, to, taken from), the last pattern has words free."""
    seen, layer = {source}, [(source, [])]
    while layer:
        following = []
        for at, steps in layer:
            for p, m in _with(members, at):
                if free[p] > 0:
                    return [*steps, (p, at, None)]
            for p, m in _with(members, at):
                for k, other in enumerate(m):
                    if other not in seen and flow[p][k] > 0:
                        seen.add(other)
                        following.append((other, [*steps, (p, at, other)]))
        layer = following
    return None


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(
    docs: DataFrame, members: Column, share: float = 1.5, weights: Sequence[float] = (3.0, 1.0, 2.0), passes: int = 2, seed: int = 17, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``(doc_id, tie, pattern, size, taken)`` of every row, and each pattern's flow.

    ``members`` is an array of source names (a null name is a source of its own, the last).  Sources weigh
    ``weights`` in turn, in code point order, and share ``share`` of all words; no target exceeds ``passes``
    times its source's size.  Null texts have size 0; rows of size 0 give nothing; null ids and repeated rows
    are rows like others (equal rows may change places); an empty table gives none.  The seeded hash is of
    the id and the text, so reruns and other partitionings agree.
    """
    value = F.col(f"`{text}`")
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(value, F.lit(""))).alias("tie"),
        F.array_sort(F.array_distinct(members)).alias("pattern"), word_count(value).alias("size"),
    )
    rows = keep(rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "tie")), "sizes")
    patterns = rows.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    names = sorted({n for p in patterns for n in p["pattern"]}, key=lambda n: (n is None, n or ""))
    place = {n: i for i, n in enumerate(names)}
    own = [[place[n] for n in p["pattern"]] for p in patterns]
    sizes = [sum(p["size"] for p, m in zip(patterns, own) if i in m) for i in range(len(names))]
    total = sum(p["size"] for p in patterns)
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(names))], share * total, passes)
    flow = min_cost_flow([p["size"] for p in patterns], own, [round(t) for t in targets], passes)
    spark = docs.sparkSession
    given = [(p["pattern"], p["size"], int(sum(f)), [sizes[i] for i in m], [float(targets[i]) for i in m]) for p, f, m in zip(patterns, flow, own)]
    # As an Arrow table: a list of rows would go through Python workers of a kind of their own, which then stay.
    given = spark.createDataFrame(pa.Table.from_batches([record_batch(_GIVEN, *(zip(*given) if given else [[]] * len(_GIVEN)))]))
    return take(rows, given)


def take(rows: DataFrame, given: DataFrame) -> DataFrame:
    """``rows`` with the words taken of each: whole passes of its pattern, then the rest in the order of ``h``.

    Sums before a row come in two steps, over ``_CELLS`` ranges of the hash and within one range, so a
    pattern with most of the rows is no single task's work.
    """
    cell = F.shiftrightunsigned("h", 64 - (_CELLS.bit_length() - 1)).cast("int")
    rows = rows.withColumn("cell", cell)
    before_cell = F.coalesce(F.sum("words").over(Window.partitionBy("pattern").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = rows.groupBy("pattern", "cell").agg(F.sum("size").alias("words")).select("pattern", "cell", before_cell.alias("before_cell"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("pattern", "cell").orderBy("h", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("inside", inside).join(cells.join(F.broadcast(given), "pattern"), ["pattern", "cell"])
    whole = F.when(F.col("pattern_size") > 0, F.floor(F.col("flow") / F.col("pattern_size"))).otherwise(0)
    rest = F.col("flow") - whole * F.col("pattern_size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before_cell") - F.col("inside")))
    return placed.select("doc_id", "tie", "pattern", "size", (whole * F.col("size") + extra).cast("long").alias("taken"), "pattern_size", "source_sizes", "targets")


def mix_sources(docs: DataFrame, source: str = "source", **options) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` where each document has one source, as ``mix``."""
    mixed = mix(docs, F.array(F.col(f"`{source}`").cast("string")), **options)
    return mixed.select("doc_id", "size", F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), "taken")


def mixed_documents(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them (the part of the last to the nearest whole).

    Rows without words are not taken; rows equal in id and text are taken equally often.
    """
    taken = mix(docs, F.array(F.col(f"`{source}`").cast("string")), text=text, key=key, **options)
    copies = taken.where("size > 0").groupBy("doc_id", "tie").agg(F.round(F.avg(F.col("taken") / F.col("size"))).cast("int").alias("copies")).where("copies > 0")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{key}`").cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_tie"))
    joined = packed.join(copies, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_tie") == F.col("tie")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select(*(F.col(f"row.`{c}`") for c in docs.columns))
