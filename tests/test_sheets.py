"""Column resolution against a plain restatement of its rules, and the CSV scan."""

import random

import pytest
from pyspark.sql import functions as F

from usemeter.config import FIELDS, HEADER_ALIASES, LABEL_HINTS
from usemeter.sources.sheets import (
    canonical_rows, column_profile, load_submissions, long_cells, read_sheets, resolve_columns,
    unusable_sheets,
)

LINK = "https://github.com/own/rep{}"


def frame(spark, sheets):
    rows = [(name, i, list(r)) for name, rs in sheets.items() for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, "sheet_id string, row_no bigint, cells array<string>")


def resolved(spark, spec, sheets):
    got = resolve_columns(frame(spark, sheets), spec).collect()
    return {r.sheet_id: (r.header_row, {k: v for k, v in r.asDict().items()
                                        if k not in ("sheet_id", "header_row") and v is not None})
            for r in got}


def test_layouts(spark, spec):
    data = lambda *cols: [[c.format(i) for c in cols] for i in range(12)]
    sheets = {
        "aliases": [["Project Title", "Names", "E-Mails", "GitHub Repo", "Feedback", "Live URL"],
                    *data("T{}", "N", "a@b.cd", LINK, "ok", "x")],
        "banner": [["Winter cup", "", "", ""], ["", "Submission title", "Repo Link", "Mail"],
                   *data("{}", "T{}", LINK, "a@b.cd")],
        "substring": [["Your project name here", "All team members (names)", "The github link"],
                      *data("T{}", "N", LINK)],
        # 'name' is too short for the substring round; as a hint it makes the column a label
        "short alias": [["File name of logo", "Team", "Source"], *data("l.png", "T{}", LINK)],
        "content": [["A", "B", "C", "D", "E"], *data("{}", "x{}@y.zz", "http://x/{}", "words {}", LINK)],
        "hint wins": [["Remark", "Group", "Where"], *data("r{}", "g{}", LINK)],
        "names as label": [["Team name", "Code"], *data("T{}", LINK)],
        "no repo": [["Project", "Text"], *data("T{}", "t")],
        "no label": [["Url", "Number"], *data(LINK, "{},0%")],
        # the repo links stand in a column another field already claimed; in the next row the
        # link itself reads like a header of the repo column
        "taken": [["Project", "Feedback"], *data("T{}", LINK)],
    }
    got = resolved(spark, spec, sheets)
    assert got == {
        "aliases": (0, dict(project=0, names=1, emails=2, github=3, feedback=4, deployed=5)),
        "banner": (1, dict(project=1, github=2)),
        "substring": (0, dict(project=0, names=1, github=2)),
        "short alias": (0, dict(project=0, github=2)),
        "content": (0, dict(project=3, github=4)),
        "hint wins": (0, dict(project=1, github=2)),
        "names as label": (0, dict(project=0, names=0, github=1)),
        "taken": (1, dict(project=0, github=1)),
    }


HEADERS = ["Project", "Name", "Team Name", "Title of project", "Github", "Repo", "Repository link",
           "Emails", "Feedback", "Demo video", "Presentation", "Live URL", "Group", "X", ""]
CELLS = [LINK.format(1), "a@b.cd", "http://x", "12", "1,000.5", "plain", "", "  "]


def expected_mapping(headers, sample):
    """All rounds as one list of (field, suitable columns, best first), taken in turn."""
    columns = range(len(headers))
    plain = ["".join(c for c in h.lower() if c.isascii() and c.isalnum()) for h in headers]
    column = [[r[j].strip() for r in sample] for j in columns]

    def repo_links(j):
        return sum("github.com/own/rep" in v for v in column[j])

    def label_like(j):
        shown = [v for v in column[j] if v][:8]
        number = [v.translate(str.maketrans("", "", ".- ,%$")).isdigit() for v in shown]
        marked = any("@" in v or "://" in v for v in shown)
        return shown != [] and not marked and not all(number)

    exact = [(f, [j for j in columns if plain[j] in HEADER_ALIASES[f]]) for f in FIELDS]
    longer = [
        (f, [j for j in columns if any(len(a) >= 5 and a in plain[j] for a in HEADER_ALIASES[f])])
        for f in FIELDS
    ]
    taken = {}
    for field, suitable in exact + longer:
        free = [j for j in suitable if j not in taken.values()]
        if field not in taken and free:
            taken[field] = free[0]
    best = max(columns, key=repo_links)
    if "github" not in taken and repo_links(best) and best not in taken.values():
        taken["github"] = best
    if not {"project", "names"} & set(taken):
        free = [j for j in columns if j not in taken.values() and label_like(j)]
        free.sort(key=lambda j: not any(w in plain[j] for w in LABEL_HINTS))
        taken.update({"project": j for j in free[:1]})
    if "names" in taken:
        taken.setdefault("project", taken["names"])
    return taken if {"project", "github"} <= set(taken) else None


def test_random_headers(spark, spec):
    rng = random.Random(7)
    sheets, want = {}, {}
    for n in range(120):
        width = rng.randint(2, 6)
        headers = [rng.choice(HEADERS) for _ in range(width)]
        if sum(h != "" for h in headers) < max(2, (width + 1) // 2):
            continue  # would be taken for a banner
        kinds = [rng.choice(CELLS) for _ in range(width)]
        body = [[k if rng.random() < 0.8 else rng.choice(CELLS) for k in kinds] for _ in range(9)]
        body.append(["z"] * width)  # the sheet is as wide as its rows
        mapping = expected_mapping(headers, body)
        if mapping is None:
            continue
        sheets[f"s{n}"], want[f"s{n}"] = [headers, *body], (0, mapping)
    got = resolved(spark, spec, sheets)
    assert len(want) > 30 and got == want


def test_rows_are_trimmed_and_titles_cut(spark, spec):
    cells = frame(spark, {"s": [["x"], ["Project", "Github", "Feedback"], [" a\nb ", LINK, "q\nr "],
                                ["c"]]})
    rows = canonical_rows(cells, resolve_columns(cells, spec)).orderBy("row_no").collect()
    assert [(r.project, r.github, r.feedback, r.demo) for r in rows] == [
        ("a", LINK, "q\nr", ""), ("c", "", "", "")]


def test_header_beyond_the_eighth_row_is_not_found(spark, spec):
    banner = [["note"]] * 8
    assert resolved(spark, spec, {"s": [*banner, ["Project", "Github"], ["a", LINK]]}) == {}
    assert resolved(spark, spec, {"s": [*banner[1:], ["Project", "Github"], ["a", LINK]]})["s"][0] == 7


def test_csv_scan(spark, spec, tmp_path):
    (tmp_path / "a.csv").write_bytes(
        '﻿"Project title, short",Github Repo,Team Members Names\r\n'
        '"Say ""hi""\r\nand more",https://github.com/o/r/tree/x,"Zoë\r\nBob, Ann"\r\n'
        ",,\r\n5\" pipe, github.com/o/q ,\t\r\n".encode())
    (tmp_path / "b.csv").write_bytes(
        "Project,Repo,Feedback\nCaf\xe9 \x96 \x80,github.com/o/s,\xfc\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes("Project,Repo\nreal � mark é,github.com/o/t\n".encode())
    rows = load_submissions(spark, str(tmp_path), spec, columns=8).orderBy("github").collect()
    assert [(r.project, r.github, r.names, r.feedback) for r in rows] == [
        ('5" pipe', "github.com/o/q", "", ""),
        ("Café – €", "github.com/o/s", "", "ü"),
        ("real � mark é", "github.com/o/t", "", ""),
        ('Say "hi"', "https://github.com/o/r/tree/x", "Zoë\nBob, Ann", ""),
    ]
    assert len({r.ord for r in rows}) == 4
    limited = load_submissions(spark, str(tmp_path / "a.csv"), spec, limit=1, columns=8).collect()
    assert [r.project for r in limited] == ['Say "hi"']
    assert read_sheets(spark, str(tmp_path / "a.csv"), 8).count() == 3  # the blank row is left out


def test_unusable_sheets_are_refused(spark, spec, tmp_path):
    with pytest.raises(ValueError, match="unsupported"):
        read_sheets(spark, "/x/a.xlsx")
    (tmp_path / "blank.csv").write_text(" ,\n\n")
    with pytest.raises(ValueError, match="no rows"):
        load_submissions(spark, str(tmp_path / "blank.csv"), spec, columns=4)
    (tmp_path / "other.csv").write_text("City,Size\nX,1\n")
    with pytest.raises(ValueError, match="headers seen: .*City"):
        load_submissions(spark, str(tmp_path / "other.csv"), spec, columns=4)
    (tmp_path / "fine one.CSV").write_text("Project,Repo\nX,github.com/a/b\n")
    (tmp_path / "notes.txt").write_text("no sheet")
    (tmp_path / "wide.csv").write_text("Project,Repo" + ",x" * 300 + "\nW,github.com/a/w" + ",1" * 300 + "\n")
    for name in ("other.csv", "notes.txt", "wide.csv"):
        with pytest.raises(ValueError, match=name):
            load_submissions(spark, str(tmp_path), spec, columns=4)
    rows = load_submissions(spark, str(tmp_path), spec, columns=4, skip_unusable=True).collect()
    cells = read_sheets(spark, str(tmp_path), 4)
    reasons = unusable_sheets(spark, str(tmp_path), cells, resolve_columns(cells, spec), 4).collect()
    assert {r.sheet_id.rpartition("/")[2]: r.reason.partition(";")[0] for r in reasons} == {
        "other.csv": "no repo column and label column found", "notes.txt": "not a CSV file",
        "wide.csv": "more than 4 columns"}
    wide = load_submissions(spark, str(tmp_path / "wide.csv"), spec, columns=400).collect()
    assert [r.project for r in wide] == ["W"]
    assert [(r.project, r.sheet_id.endswith("fine%20one.CSV")) for r in rows] == [("X", True)]


def test_row_keys_are_the_same_in_every_run(spark, spec, tmp_path):
    for name, n in (("b", 40), ("a", 3), ("c", 25)):
        rows = "".join(f"{name}{i},github.com/o/{name}{i}\n" + ("\n" if i % 7 == 0 else "") for i in range(n))
        (tmp_path / f"{name}.csv").write_text("Project,Repo\n" + rows)
    keys = lambda **kw: {r.project: r.ord for r in load_submissions(spark, str(tmp_path), spec, columns=4, **kw).collect()}
    first = keys()
    assert len(first) == 68 and sorted(first, key=first.get)[:4] == ["a0", "a1", "a2", "b0"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert keys() == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "aa.csv").write_bytes("Project,Repo\nCaf\xe9,github.com/o/x\n".encode("latin-1"))
    assert {k: v for k, v in keys().items() if k != "Café"} == first
    assert set(keys(limit=5)) == {"a0", "a1", "a2", "Café", "b0"}


def test_file_names_with_blanks_and_old_encodings(spark, spec, tmp_path):
    for name, text in {"a b.csv": "caf\xe9", "c d.csv": "plain"}.items():
        (tmp_path / name).write_bytes(f"Project,Repo\n{text},github.com/a/b\n".encode("latin-1"))
    rows = load_submissions(spark, str(tmp_path), spec, columns=4).collect()
    assert sorted(r.project for r in rows) == ["café", "plain"]


def test_profile(spark, spec):
    cells = frame(spark, {"s": [["a@b.cd", LINK, "1.5"], ["", "http://x", "-2 %"]]})
    rows = column_profile(long_cells(cells), spec).orderBy("col_no").collect()
    assert [tuple(r)[2:] for r in rows] == [(2, 1, 0, 0, 1, 0), (2, 2, 1, 2, 0, 0), (2, 2, 0, 0, 0, 2)]


def test_only_the_first_rows_are_gathered(spark, spec):
    plan = resolve_columns(
        spark.range(1000).select((F.col("id") % 3).cast("string").alias("sheet_id"), F.col("id").alias("row_no"),
                               F.array(F.lit("x")).alias("cells")), spec
    )._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "38, Partial" in plan
