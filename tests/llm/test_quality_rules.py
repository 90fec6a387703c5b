import math
import random
import re
from collections import Counter

from conftest_rows import documents
from pyspark.sql import functions as F

from usemeter.llm.quality_rules import SIGNALS, binomial_tail, quality_verdicts


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_base_counts(spark, odd_docs, odd_rows, no_docs):
    rnd = random.Random(1)
    rows = odd_rows + [(100 + i, "".join(rnd.choices(["a", "b ", " ", "\n", "#", "\t", "é\x0b", "x|y "], k=rnd.randint(0, 300))), rnd.choice(["en", None]), "s") for i in range(150)]
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_verdicts(documents(spark, rows, ("n_words", "stratum", "c", "good")), labels).collect()
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter((i, *counts(t)) for i, t, *_ in rows)
    assert all(r.kept != r.base_failed and r.rejected_by == [] for r in got)  # no labels, no cutoffs
    assert quality_verdicts(no_docs, labels).count() == 0


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10, 0.3), (2, 50, 0.1), (3, 400, 0.02), (8, 400, 0.02), (9, 400, 0.02), (0, 100_000, 0.02), (1900, 100_000, 0.02)]
    for k, n, p in cases:
        got = spark.range(1).select(binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        want = 1.0 if k > n * p else sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        assert math.isclose(got, want, rel_tol=1e-6, abs_tol=1e-300)


def test_strata_of_one_kind_of_label_do_no_harm(spark, words):
    rows = [(i, " ".join(words[i : i + 60]), "en" if i % 2 else "de", "a") for i in range(40)] + [(90, "\n\n", "en", "a")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = quality_verdicts(documents(spark, rows), labels).collect()
    assert {r.kept for r in got if r.doc_id < 90} == {True} and len(got) == 41


def test_cutoffs_are_certified_per_stratum(spark, words):
    rnd = random.Random(7)
    rows, marks = [], []
    for i in range(1600):
        lang, bad = ("en" if i % 4 else "de"), i % 5 == 0
        text = " ".join(rnd.choice(words) + ("##" if bad and j % 2 else "") for j in range(60))
        rows.append((i, text + f" {i}", lang, "a"))
        marks.append((i, 0 if bad else 1, 0))
    marks += [(0, 1, 0), (5, None, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = quality_verdicts(documents(spark, rows), labels, risk=0.02, error=0.05).collect()
    rule_sets = 2 * math.prod(len(grid) + 1 for _, grid in SIGNALS.values())
    enough = {g for g in ("en", "de") if (1 - 0.02) ** sum(1 for r in rows if r[2] == g and r[0] % 5) <= 0.05 / rule_sets}
    assert enough == {"en"}  # the other stratum has too few labelled documents
    for r in got:
        bad = r.doc_id % 5 == 0
        assert r.kept == (not bad or r.doc_id % 4 == 0)
        assert ("symbols per word" in r.rejected_by) != r.kept


def test_all_rules_of_a_stratum_together_keep_the_promise(spark, words):
    """Four signals, each high in another 1.2 % of the good documents: one of them may be used, not all four."""
    rnd, rows, marks = random.Random(9), [], []

    def text(i, kind):
        w = [f"{rnd.choice(words)}{i}x{j}" for j in range(60)]
        w = [x[:5] for x in w] if kind != 1 else [x + "long" * 5 for x in w]
        w = [f"{chr(97 + j // 26)}{chr(97 + j % 26)}{i}"[:5] for j in range(60)] if kind != 1 else w
        if kind == 0:
            w = [x + "###" for x in w]
        if kind == 2:
            w[20:50] = w[:5] * 6
        lines = [" ".join(w[j : j + 6]) for j in range(0, 60, 6)]
        return "\n".join(lines + (["same"] * 12 if kind == 3 else []))

    for i in range(5000):
        good = i < 4000
        kind = i // 48 if good and i < 192 else (i % 4 if not good else None)
        rows.append((i, text(i, kind), None if i % 2 else "", "a"))
        marks.append((i, int(good), 0))
    rows = [(i, t, "en", s) for i, t, _, s in rows]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = quality_verdicts(documents(spark, rows), labels, gain=0.05).collect()
    lost = sum(1 for r in got if r.doc_id < 4000 and not r.kept)
    caught = sum(1 for r in got if r.doc_id >= 4000 and not r.kept)
    assert 0 < lost <= 0.02 * 4000 and caught >= 200


def test_a_null_stratum_is_one_of_its_own(spark, words):
    rnd, rows, marks = random.Random(4), [], []
    for i in range(2400):
        bad = i % 3 == 0 and i % 2 == 0  # only the null stratum has bad ones
        rows.append((i, " ".join(rnd.choice(words) + ("##" if bad and j % 2 else "") for j in range(60)) + f" {i}", "" if i % 2 else None, "a"))
        marks.append((i, 0 if bad else 1, 0))
    rows.append((9000, "## ".join(words[:60]), "", "a"))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality_verdicts(documents(spark, rows), labels).collect()}
    assert got[9000] and all(kept == (i % 6 > 0) for i, kept in got.items() if i < 9000)
