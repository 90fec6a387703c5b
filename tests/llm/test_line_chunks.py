import random
from collections import defaultdict

from conftest_rows import documents

from usemeter.llm.line_chunks import chunk_spans, drop_repeated_chunks, without_repeats


def brute(rows):
    """Texts after removal, by comparing chunk texts directly; rows are (order key, text)."""
    places = defaultdict(list)
    for key, text in set(rows):
        lines = text.split("\n")
        for a, b in chunk_spans(lines):
            places["\n".join(lines[a:b])].append((key, a, b))
    drop = defaultdict(set)
    for found in places.values():
        for key, a, b in sorted(found)[1:]:
            drop[key] |= set(range(a, b))
    return {key: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop[key]) for key, t in rows}


def test_equals_brute_force(spark, words):
    rnd = random.Random(2)
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = [[line(rnd.randint(3, 12)) for _ in range(rnd.randint(2, 9))] for _ in range(8)] + [[line(60)]]
    rows = []
    for i in range(150):
        lines = [line(rnd.randint(1, 15)) for _ in range(rnd.randint(0, 12))]
        for _ in range(rnd.choice([0, 1, 1, 2])):
            at = rnd.randint(0, len(lines))
            lines[at:at] = rnd.choice(shared)
        rows.append((i, "\n".join(lines), "en", "a"))
    rows += [(1000 + r[0], r[1], "en", "a") for r in rows[:20]]
    got = {r.doc_id: r for r in drop_repeated_chunks(documents(spark, rows).repartition(4)).collect()}
    want = brute([(r[0], r[1]) for r in rows])
    assert {i: r.text for i, r in got.items()} == want
    assert sum(r.n_removed for r in got.values()) > 100
    long_line = shared[-1][0]
    holders = sorted(i for i, r in got.items() if long_line in r.text)
    assert holders == [min(r[0] for r in rows if long_line in r[1])]


def test_every_line_survives_somewhere(spark, words):
    rnd = random.Random(4)
    pool = [" ".join(rnd.choice(words) for _ in range(4)) for _ in range(30)]
    rows = [(i, "\n".join(pool[a : a + rnd.randint(2, 12)]), "en", "a") for i in range(60) for a in [rnd.randrange(25)]]
    got = drop_repeated_chunks(documents(spark, rows)).collect()
    assert {x for r in got for x in r.text.split("\n") if x} == {x for r in rows for x in r[1].split("\n")}


def test_boundaries_resist_shifts(words):
    lines = [f"{w} line number {i}" for i, w in enumerate(words[:200])]
    spans = {tuple(lines[a:b]) for a, b in chunk_spans(lines)}
    moved = {tuple((["new first line"] + lines)[a:b]) for a, b in chunk_spans(["new first line"] + lines)}
    assert len(spans & moved) > 0.95 * len(spans)
    assert all(a < b for a, b in chunk_spans(lines)) and chunk_spans([""]) == [] and chunk_spans(["", " ", "x"]) == []


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = drop_repeated_chunks(odd_docs).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((i or 0, t or "") for i, t, *_ in odd_rows)
    whole = without_repeats(odd_docs)
    assert whole.columns == odd_docs.columns
    assert sorted(map(str, whole.collect())) == sorted(map(str, odd_docs.collect()))
    assert drop_repeated_chunks(no_docs).count() == 0 and without_repeats(no_docs).count() == 0


def test_repeated_rows_are_one_document(spark):
    text = "first line of two here\nsecond line of two here"
    rows = [(5, text, "en", "a")] * 3 + [(9, "a\n" + text + "\nb " + "x " * 60, "en", "a")] * 2 + [(5, "other\n" + text, "en", "a")]
    got = drop_repeated_chunks(documents(spark, rows)).collect()
    assert len(got) == 6 and [r.text for r in got if r.doc_id == 5].count(text) in (0, 3)
    assert len({r.text for r in got if r.doc_id == 9}) == 1


def test_null_ids_stand_last(spark):
    text = "first line of two here\nsecond line of two here"
    rows = [(None, text, "en", "a"), (5, text, "en", "a"), (9, "a\n" + text + "\nb", "en", "a")]
    got = {r.doc_id: r.text for r in drop_repeated_chunks(documents(spark, rows)).collect()}
    assert got[5] == text


def test_short_lined_passages_of_fifty_words_go_in_full(spark, words):
    rnd = random.Random(8)
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passages = []
    for i in range(60):
        n = 2 + i % 4
        passages.append([line(-(-50 // n) + rnd.randint(0, 3)) for _ in range(n)])
    passages += [[line(45), line(70), "", line(6)], [line(3), line(49), line(2)]]
    rows = [(k * 100 + i, "\n".join([line(9) for _ in range(rnd.randint(1, 4))] + p + [line(9) for _ in range(3)]), "en", "a") for k in range(2) for i, p in enumerate(passages)]
    got = {r.doc_id: r for r in drop_repeated_chunks(documents(spark, rows)).collect()}
    for i, p in enumerate(passages):
        kept, left = got[i].text.split("\n"), got[100 + i].text.split("\n")
        assert got[i].n_removed == 0 and all(x in kept for x in p) and not [x for x in p if x and x in left]
        assert got[100 + i].n_lines - got[100 + i].n_removed == len(rows[len(passages) + i][1].split("\n")) - len(p)
