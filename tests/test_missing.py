"""Patterns of missing values against pandas."""

import pandas as pd

from sitepanel.operators.missing import missing_patterns, rows_kept

ROWS = [(1, None, "x", 2.0), (2, 1.0, None, 2.0), (3, None, "x", 1.0), (None, 1.0, "y", 3.0), (5, 2.0, "z", 1.0), (6, None, None, None)]


def test_patterns_and_choices(spark):
    df = spark.createDataFrame(ROWS, "a int, b double, `c d` string, e double").repartition(3)
    table = missing_patterns(df)
    found = sorted((tuple(r.missing), r.n_missing, r.rows) for r in table.collect())
    assert found == [((), 0, 1), (("a",), 1, 1), (("b",), 1, 2), (("b", "c d", "e"), 3, 1), (("c d",), 1, 1)]
    choices = {"whole": df.columns, "ab": ["a", "b"], "none": [], "e": ["e"]}
    frame = pd.DataFrame(ROWS, columns=["a", "b", "c d", "e"])
    for row in rows_kept(table, choices).collect():
        part = frame[choices[row.choice]]
        kept = len(part.dropna()) if len(part.columns) else len(frame)
        assert (row.kept, row.dropped, row.fails) == (kept, len(frame) - kept, kept < len(frame))
        assert row.at_fault == ",".join(sorted(c for c in part.columns if part[c].isna().any()))


def test_more_columns_than_bits(spark):
    names = [f"c{k}" for k in range(130)]
    df = spark.createDataFrame([tuple(None if k in (0, 61, 62, 129) else 1 for k in range(130))] * 2, ", ".join(f"{n} int" for n in names))
    row = missing_patterns(df).first()
    assert (row.missing, row.rows) == (["c0", "c61", "c62", "c129"], 2)


def test_empty_frame(spark):
    df = spark.createDataFrame([], "a int, b int")
    assert missing_patterns(df).count() == 0
    row = rows_kept(missing_patterns(df), {"ab": ["a", "b"]}).first()
    assert (row.kept, row.dropped, row.at_fault, row.fails) == (0, 0, "", False)
