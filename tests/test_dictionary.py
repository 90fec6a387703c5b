"""Large dictionaries against one search a word."""

import random
import time

from pyspark.sql import functions as F

from usemeter.functions.dictionary import find_words, words_of
from usemeter.functions.text import words_in
from usemeter.operators.digest import platforms_per_repo


def texts(spark, n=400, seed=2):
    rnd = random.Random(seed)
    rows = [(i, f"r{i % 7}", "".join(rnd.choices("abcd \n\u00e9", k=rnd.randint(0, 400)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, "r0", None), (n + 1, "r1", "")], "id int, repo_key string, text string")


def dictionary(n, seed=3):
    rnd, words = random.Random(seed), {"a", "ab", "abc", "bcd", "\u00e9", "a b", "\n"}
    while len(words) < n:
        words.add("".join(rnd.choices("abcd \u00e9", k=rnd.randint(2, 9))))
    return tuple(sorted(words, key=lambda w: rnd.random()))


def test_equals_one_search_a_word(spark):
    df, words = texts(spark), dictionary(300)
    both = df.select("id", words_in(F.col("text"), words).alias("a"), words_of(F.col("text"), words).alias("b"))
    rows = both.collect()
    assert len(rows) == 402 and all(r.a == r.b for r in rows) and any(len(r.a) > 20 for r in rows)


def test_the_empty_word_and_repeated_words(spark):
    words = ("ab", "", "ab", "zz") + dictionary(80)
    found = texts(spark, 50).select(words_of(F.col("text"), words, one_by_one=2).alias("a"), words_of(F.col("text"), words, 1000).alias("b"))
    assert all(r.a == r.b for r in found.collect())


def test_operators_take_large_dictionaries(spark, spec):
    df, words = texts(spark), dictionary(500)
    large = platforms_per_repo(df, spec.with_(platforms=words)).collect()
    whole = df.groupBy("repo_key").agg(F.concat_ws("", F.collect_list(F.lower("text"))).alias("t")).collect()
    assert {r.repo_key for r in large} == {r.repo_key for r in whole}
    rows = [r for r in df.collect() if r.text]
    for r in large:
        assert r.platforms == sorted({w for w in words for x in rows if x.repo_key == r.repo_key and w in x.text})


def test_ten_thousand_words_cost_about_what_ten_do():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(5, 12)))
    text = " ".join(word() for _ in range(200_000))
    few, many = tuple(word() for _ in range(10)), tuple({word() for _ in range(10_000)})

    def seconds(words):
        find_words("", words)  # the automaton is built once
        start = time.perf_counter()
        found = find_words(text, words)
        return time.perf_counter() - start, len(found)

    (many_s, hits), (few_s, _) = (min(seconds(w) for _ in range(5)) for w in (many, few))
    assert hits > 50 and many_s < 10 * few_s  # hits cost as well; one search a word would cost 1000 times
