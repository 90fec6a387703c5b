"""Quality rules whose cutoffs are certified on labelled holdouts.

Each signal has a grid of cutoffs fixed beforehand; a rule set takes one cutoff, or none, of each.  In a
stratum a rule set is safe if the good labelled documents that it rejects, by whichever rule, are so few that
the exact binomial tail P(X <= rejected; n, ``risk``) is at most ``error`` divided by the number of all rule
sets of all strata (Bonferroni): with probability ``1 - error`` no rule set that passes, however it was
found, rejects more than ``risk`` of its stratum's good documents.  Of each signal's safe cutoffs the one that
best parts bad from good is proposed (the mildest of equals), if it parts them by ``gain`` at least; proposals
join the rule set from the best on, as long as it stays safe.  A stratum with too few labels gets no cutoff and
keeps all that passes the base rules.

Everything is DataFrame expressions: arrays are bound once by a one-element ``transform``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usemeter.llm.common import keep

_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOL = r"[#*$%&|<>]"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Signal: its value, and the cutoffs that are tried; a document is rejected above the cutoff.
SIGNALS: dict[str, tuple[str, list[float]]] = {
    "symbols per word": ("n_symbols / nullif(n_words, 0)", [0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0, 2.5]),
    "characters per word": ("word_chars / nullif(n_words, 0)", [5.5, 6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0]),
    "repeated words": ("n_repeat_words / nullif(n_words, 0)", [0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4]),
    "repeated lines": ("n_dup_lines / nullif(n_lines, 0)", [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5]),
}


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more; windows are compared by 64-bit hashes."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )

    def covered(places: Column) -> Column:
        return F.aggregate(
            F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3)))),
            F.lit(0), lambda a, b: a + b,
        )

    def repeated(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return _bind(F.array_sort(F.transform(twice, lambda x: x["i"])), covered)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_bind(F.array_sort(windows), repeated))


def text_counts(text: Column) -> Column:
    """A struct of the base counts of ``text`` and its number of lines with a word."""
    words = F.array_remove(F.split(text, _SPACE), "")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    of_words = _bind(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    of_lines = _bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(of_words.alias("w"), of_lines.alias("l"), F.regexp_count(text, F.lit(_SYMBOL)).cast("long").alias("n_symbols"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial (n, p), summed in logarithms; 1 where ``k`` is above the mean, which is never safe."""
    log = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(F.least(k, F.ceil(n * p)), F.lit(1))),
        F.struct((n * F.log1p(F.lit(-p))).alias("term"), (n * F.log1p(F.lit(-p))).alias("sum")),
        lambda acc, i: F.when(i > k, acc).otherwise(
            _bind(
                acc["term"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p))),
                lambda t: F.struct(t.alias("term"), (F.greatest(acc["sum"], t) + F.log1p(F.exp(-F.abs(acc["sum"] - t)))).alias("sum")),
            )
        ),
        lambda acc: acc["sum"],
    )
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(log))


def certified_cutoffs(counted: DataFrame, risk: float, error: float, gain: float) -> DataFrame:
    """``(stratum, cutoffs map<signal, cutoff>)`` from labelled counts with columns ``stratum`` and ``good``."""
    signals = F.array(*(F.struct(F.lit(s).alias("signal"), F.expr(f"coalesce({value}, 0D)").alias("value"), F.array(*map(F.lit, grid)).alias("grid")) for s, (value, grid) in SIGNALS.items()))
    # One histogram over the grid a stratum and signal; what a cutoff rejects is a sum of its upper cells.
    cells = (
        counted.select("stratum", "good", F.explode(signals).alias("s"))
        .select("stratum", "good", "s.signal", "s.grid", F.size(F.filter("s.grid", lambda g: g < F.col("s.value"))).alias("above"))
        .groupBy("stratum", "signal", "grid", "above")
        .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    )
    tests = (
        cells.select("stratum", "signal", "good", "bad", "above", F.posexplode("grid").alias("at", "cutoff"))
        .groupBy("stratum", "signal", "at", "cutoff")
        .agg(*(F.sum(c).alias(f"n_{c}") for c in ("good", "bad")), *(F.sum(F.when(F.col("above") > F.col("at"), F.col(c)).otherwise(0)).alias(f"cut_{c}") for c in ("good", "bad")))
    )
    rule_sets = counted.select("stratum").distinct().count() * math.prod(len(grid) + 1 for _, grid in SIGNALS.values())
    level = error / max(rule_sets, 1)
    parted = F.coalesce(F.try_divide("cut_bad", "n_bad"), F.lit(0.0)) - F.try_divide("cut_good", "n_good")
    safe = tests.where("n_good > 0").withColumn("gain", F.round(parted, 6)).where(
        (F.col("gain") >= gain) & (binomial_tail(F.col("cut_good"), F.col("n_good"), risk) <= level)
    )
    number = F.array_position(F.array(*map(F.lit, SIGNALS)), F.col("signal"))
    best = safe.groupBy("stratum", "signal").agg(F.max(F.struct("gain", "cutoff")).alias("b"), F.max("n_good").alias("n_good"))
    proposals = best.groupBy("stratum", "n_good").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("b.gain")).alias("order"), number.alias("number"), "signal", "b.cutoff"))).alias("rules")
    )
    # The first proposal that rejects a good document says from which rule set on it is lost.
    value_of = F.create_map(*[x for s, (value, _) in SIGNALS.items() for x in (F.lit(s), F.expr(f"coalesce({value}, 0D)"))])
    lost = (
        counted.where("good").withColumn("v", value_of)
        .join(proposals.select(F.col("stratum").alias("of"), "rules"), F.col("stratum").eqNullSafe(F.col("of")))
        .select("stratum", F.array_position(F.transform("rules", lambda r: F.element_at("v", r["signal"]) > r["cutoff"]), True).alias("first"))
        .where("first > 0").groupBy("stratum", "first").agg(F.count("*").alias("n"))
    )
    sets = proposals.select("stratum", "n_good", F.posexplode("rules").alias("at", "rule"))
    joint = (
        sets.alias("s").join(lost.alias("l"), F.expr("s.stratum <=> l.stratum AND l.first <= s.at + 1"), "left")
        .groupBy("s.stratum", "s.n_good", "s.at", "s.rule").agg(F.coalesce(F.sum("l.n"), F.lit(0)).alias("lost"))
        .where(binomial_tail(F.col("lost"), F.col("n_good"), risk) <= level)
    )
    return joint.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule.signal", "rule.cutoff"))).alias("cutoffs"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05, gain: float = 0.1, stratum: str = "lang", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Base counts of every row, ``base_failed``, ``kept``, and the signals that rejected it.

    The holdout is every labelled row (``quality`` 1 good, 0 bad) that passes the base rules; a document
    labelled twice counts as good only if all its labels say so, null labels are not looked at.  A null stratum is one
    of its own.  A null or empty text has no words, fails the base rules and is not kept; null ids and repeated
    rows give a row each; empty tables give no rows, or no cutoffs; other columns are not looked at.
    """
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    c = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{stratum}`").cast("string").alias("stratum"), text_counts(value).alias("c"))
    counted = c.select("doc_id", "stratum", "c.w.n_words", "c.w.word_chars", "c.n_symbols", "c.l.n_dup_lines", "c.w.n_repeat_words", "c.l.n_lines")
    counted = counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    counted = keep(counted, "quality-counts")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("q")).where("doc_id is not null and q is not null")
    holdout = counted.where("not base_failed").join(marks.groupBy("doc_id").agg((F.min("q") >= 1).alias("good")), "doc_id")
    cutoffs = certified_cutoffs(holdout, risk, error, gain)
    checks = F.array(*(F.when(F.expr(f"coalesce({v}, 0D)") > F.col("cutoffs")[s], F.lit(s)) for s, (v, _) in SIGNALS.items()))
    cutoffs = cutoffs.withColumnRenamed("stratum", "of")
    judged = counted.join(cutoffs, F.col("stratum").eqNullSafe(F.col("of")), "left").withColumn("rejected_by", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(checks)))
    return judged.select("doc_id", *_COUNTS, "base_failed", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by")
