"""Small tables for the tests."""

_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=()):
    """A table of documents; ``extra`` columns have names that the operators use inside."""
    df = spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], _SCHEMA)
    for name in extra:
        df = df.selectExpr("*", f"'x' as `{name}`")
    return df
