from pyspark.sql import functions as F

from sitepanel.functions import nulls, scalars


def test_aggregates_answer_null_when_a_value_is_missing(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "k string, x double")
    x = F.col("x")
    strict = df.groupBy("k").agg(nulls.na_sum(x), nulls.na_min(x), nulls.na_max(x), nulls.na_mean(x))
    assert rows(strict) == [("a", None, None, None, None), ("b", 6.0, 2.0, 4.0, 3.0)]
    loose = df.groupBy("k").agg(nulls.na_sum(x, na_rm=True), nulls.na_mean(x, na_rm=True))
    assert rows(loose) == [("a", 1.0, 1.0), ("b", 6.0, 3.0)]


def test_conditional_aggregate_looks_only_at_matching_rows(spark, rows):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("b", 2, 5.0)], "k string, m int, x double")
    result = df.groupBy("k").agg(nulls.na_sum(F.col("x"), F.col("m") == 1))
    assert rows(result) == [("a", 1.0), ("b", None)]


def test_row_functions(spark, rows):
    df = spark.createDataFrame([(1, 1.0, 3.0), (2, None, 4.0), (3, None, None)], "k int, x double, y double")
    cells = [F.col("x"), F.col("y")]
    result = df.select("k", nulls.row_sum(cells), nulls.row_min(cells), nulls.row_mean(cells))
    assert rows(result) == [(1, 4.0, 1.0, 2.0), (2, None, None, 4.0), (3, None, None, None)]


def test_nan_becomes_null_and_leaves_extremes_alone(spark, rows):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "k int, x double")
    clean = nulls.nan_to_null(df)
    assert rows(clean) == [(1, None), (2, 1.0)]
    assert clean.agg(F.max("x")).first()[0] == 1.0
    assert clean.dropna(how="any").count() == 1


def test_logs_and_division_outside_their_domain(spark):
    df = spark.createDataFrame([(-1.0,), (-2.0,), (0.0,)], "x double")
    x = F.col("x")
    values = [r[0] for r in df.select(scalars.shifted_log(x)).collect()]
    assert values == [None, None, 0.0]
    assert df.select(scalars.percent_change(x, F.lit(-1.0))).first()[0] is None


def test_text_conversions_never_raise(spark, rows):
    df = spark.createDataFrame([("3/5/2014", "7"), ("12/31/2014", "x"), ("2014-01-01", "")], "d string, n string")
    result = rows(df.select(scalars.parse_day(F.col("d")).cast("string"), scalars.to_number(F.col("n"))))
    assert result == [("2014-03-05", 7.0), ("2014-12-31", None), (None, None)]
    other = spark.createDataFrame([("2014/3/5",)], "d string")
    assert str(other.select(scalars.parse_day(F.col("d"), "y/M/d")).first()[0]) == "2014-03-05"


def test_coordinate_keys_match_where_doubles_do_not(spark):
    df = spark.createDataFrame([(0.1 + 0.2, 0.3)], "a double, b double")
    raw, keyed = df.select(
        F.col("a") == F.col("b"), scalars.coordinate_key(F.col("a")) == scalars.coordinate_key(F.col("b"))
    ).first()
    assert (raw, keyed) == (False, True)
