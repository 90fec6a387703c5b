"""The whole job: a full run, then a corrected row merged into its sheet."""

from test_evidence import tables
from test_results import CLOSED, CORPUS

from usemeter.__main__ import run


def test_full_run_and_merge(spark, spec, tmp_path):
    snapshot = str(tmp_path / "snapshot")
    for name, df in zip(("repos", "repo_tree", "repo_files"), tables(spark, CORPUS, CLOSED)):
        df.write.parquet(f"{snapshot}/{name}")
    sheets = tmp_path / "in"
    sheets.mkdir()
    (sheets / "a.csv").write_text(
        "Project title,Team Members Names,Team Members Emails,Github Repo,Feedback\n"
        "One,Ann,a@b.example,https://github.com/own/good,\"nice\n\"\nTwo,Bob,,github.com/own/gone,\n"
        "Three,,,n/a,\n", encoding="utf-8")
    first = str(tmp_path / "first")
    summary = run(spark, spec, str(sheets), snapshot, first)
    assert {(r.facet, r.value): r.n for r in summary.collect()} == {
        ("tag", "Significant"): 1, ("tag", "None"): 2, ("backbone", "Yes"): 1, ("backbone", "No"): 2,
        ("review_group", "Yes"): 1, ("review_group", "review"): 2}
    before = spark.read.parquet(f"{first}/sheet").orderBy("row_no").collect()
    assert [r.project_name for r in before] == ["One", "Two", "Three"]

    # the file of failed rows is corrected and run again
    review = next((tmp_path / "first" / "needs_review").glob("part-*.csv"))
    fixed = tmp_path / "fixed"
    fixed.mkdir()
    text = review.read_text(encoding="utf-8").replace("own/gone", "own/plain")
    (fixed / "b.csv").write_text(text + "Four,,,github.com/own/plain,\n", encoding="utf-8")
    second = str(tmp_path / "second")
    run(spark, spec, str(fixed), snapshot, second, merge=f"{first}/sheet")
    after = spark.read.parquet(f"{second}/sheet").orderBy("row_no").collect()
    assert [(r.project_name, r.repo_link, r.usage_tag) for r in after] == [
        ("One", "https://github.com/own/good", "Significant"),
        ("Two", "github.com/own/plain", "None"), ("Three", "n/a", "None"),
        ("Four", "github.com/own/plain", "None")]
    assert after[1].notes.endswith("duplicate repo (2 rows share own/plain)")
    limited = run(spark, spec, str(sheets), snapshot, str(tmp_path / "third"), limit=1)
    assert limited.where("facet = 'tag'").collect()[0].n == 1
