import pytest
from pyspark.sql import functions as F

from sitepanel import session
from sitepanel.functions.scalars import parse_day
from sitepanel.sources import schemas, tables

LINES = ["SITE NAME,Site Code,County,Lon.,Lat.,elev,rel yr", "A b,AB,Ada,-117.04,42.4,0,2004", "C,C1,,,,,"]
WANTED = [("A b", "AB", "Ada", -117.04, 42.4, 0.0, 2004), ("C", "C1", None, None, None, None, None)]


@pytest.mark.parametrize("mark", [b"", b"\xef\xbb\xbf"])
@pytest.mark.parametrize("end", ["\n", "\r", "\r\n"])
def test_csv_dialects(spark, rows, tmp_path, mark, end):
    path = tmp_path / "sites.csv"
    path.write_bytes(mark + end.join(LINES + [""]).encode())
    df = tables.read_csv(spark, str(path), schemas.RELEASE_SITES)
    assert df.columns == schemas.RELEASE_SITES.names
    assert rows(df) == WANTED


def test_renames_and_nan(spark, rows, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("site,year\nA,NaN\nB,2\n")
    schema = schemas._schema(site=schemas._TEXT, release_year=schemas._NUM)
    df = tables.read_csv(spark, str(path), schema, {"release_year": "year"})
    assert rows(df) == [("A", None), ("B", 2.0)]


def test_surveys_bind_by_header(spark, rows, tmp_path):
    path = tmp_path / "surveys.csv"
    names = list(schemas.SURVEY_HEADERS)[::-1]
    values = {"SITE_NAME": "A", "DATE": "3/5/2014", "YEAR": "2014", "Grass": "n/a", "NumStems": "7"}
    path.write_text("Extra.col," + ",".join(names) + "\nx," + ",".join(values.get(n, "") for n in names) + "\n")
    df = tables.read_csv_by_header(spark, str(path), schemas.SURVEY_HEADERS)
    day = parse_day(F.col("survey_date")).cast("string")
    assert rows(df.select("site", "year", "grass", "stems", day)) == [("A", 2014, None, 7.0, "2014-03-05")]


def test_panel_prunes_years(spark, tmp_path, capsys):
    df = spark.range(100).select(F.col("id").alias("site"), (2000 + F.col("id") % 5).cast("int").alias("year"))
    path = str(tmp_path / "panel")
    tables.write_panel(df, path)
    kept = tables.read_panel(spark, path).where("year = 2003")
    assert kept.count() == 20
    kept.explain()
    assert "PartitionFilters: [isnotnull(year" in capsys.readouterr().out


def test_durable_frames_live_in_the_configured_folder(spark):
    df = spark.range(10).withColumn("a:b", F.rand())
    kept = session.durable(df)
    folder = spark.conf.get("spark.checkpoint.dir")
    assert all(folder in name for name in kept.inputFiles())
    assert sorted(kept.collect()) == sorted(kept.collect())
    assert kept.schema.simpleString() == df.schema.simpleString()


def test_comparisons_reach_the_scan_and_leave_nan_out(spark, rows, tmp_path, capsys):
    path = str(tmp_path / "gaps")
    values = [(1, 1.0), (2, 5.0), (3, float("nan")), (4, None), (5, 9.0)]
    spark.createDataFrame(values, "id int, x double").write.parquet(path)
    kept = {}
    for sign in ("=", "!=", "<", "<=", ">", ">="):
        scan = tables.read_panel(spark, path, where=[("x", sign, 5.0)])
        kept[sign] = [r[0] for r in rows(scan, "id")]
        after = tables.read_panel(spark, path).where(f"x {sign} 5.0")
        assert rows(scan) == rows(after)
    assert kept[">="] == [2, 5] and kept["!="] == [1, 5] and kept["<"] == [1]
    assert tables.read_panel(spark, path, where=[("x", "<=", float("nan"))]).count() == 0
    tables.read_panel(spark, path, where=[("x", ">=", 5.0), ("id", "<", 9)]).explain()
    plan = capsys.readouterr().out
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(x,5.0)" in pushed and "LessThan(id,9)" in pushed
