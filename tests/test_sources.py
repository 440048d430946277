import datetime as dt
import json

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from keystead.operators import upsert
from keystead.sources import logs, models, pages, tables


def test_land_prices(spark, tmp_path):
    (tmp_path / "l.csv").write_text(
        "prefecture,city,average_land_price,land_use,land_price_growth_rate\n 東京都 ,港区,1000001,residential,1.5\n東京都,港区,x,commercial,y\n,港区,1,residential,1\n東京都,a,1,industrial,1\n",
        encoding="utf-8",
    )
    got = [tuple(r) for r in tables.read_land_prices(spark, str(tmp_path / "l.csv")).select("prefecture", "land_use", "average", "rosenka", "fixed_asset", F.col("growth").cast("double")).collect()]
    assert got == [("東京都", "residential", 1000001, 800000, 700000, 1.5), ("東京都", "commercial", 0, 0, 0, 0.0)]


def test_stations(spark, tmp_path):
    (tmp_path / "s.csv").write_text("line_name,station_name,passenger_volume\nA,新宿駅,100\nB,駅前駅,?\n,x,1\n", encoding="utf-8")
    got = [tuple(r) for r in tables.read_stations(spark, str(tmp_path / "s.csv")).collect()]
    assert got == [("新宿", "A", 100), ("前", "B", 0)]


def test_municipalities(spark, tmp_path):
    (tmp_path / "m.csv").write_text("prefecture,city,population_growth_rate,average_income,total_population,income_growth_rate,population_density\n東京都,港区,0.5,5000,,,\n", encoding="utf-8")
    r = tables.read_municipalities(spark, str(tmp_path / "m.csv")).first()
    assert (r["income"], r["total_population"], float(r["income_growth"]), r["density"]) == (5000, None, 0.0, None)


def test_trades(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"data": [{"City": "港区", "Use": "住宅", "TradePrice": "1", "Area": "2"}, {"City": "x"}]}, indent=1), encoding="utf-8")
    assert tables.read_trades(spark, str(tmp_path / "t.json")).count() == 2


def test_cells(spark, tmp_path):
    doc = {"GET_STATS_DATA": {"STATISTICAL_DATA": {"DATA_INF": {"VALUE": [{"@area": "13103", "@cat01": "A", "$": "5"}, {"@area": "13103", "@cat01": "B", "$": "-"}]}}}}
    (tmp_path / "c.json").write_text(json.dumps(doc), encoding="utf-8")
    r = tables.pivot_cells(tables.read_statistics_cells(spark, str(tmp_path / "c.json")), {"A": "income", "B": "people"}).first()
    assert (r["area"], r["income"], r["people"]) == ("13103", 5.0, None)


def test_error_pages(spark, tmp_path):
    folder = tmp_path / "mitsui_mansion"
    folder.mkdir()
    (folder / "abc_meta.txt").write_text("URL: http://x/1\nReason: no price\nTimestamp: 2024-01-02 03:04:05\n", encoding="utf-8")
    (folder / "def_meta.txt").write_text("Reason: other\n", encoding="utf-8")
    got = {r["file"]: r for r in logs.read_error_pages(spark, str(tmp_path)).collect()}
    assert (got["abc.html"]["company_type"], got["abc.html"]["url"], got["abc.html"]["ts"]) == ("mitsui_mansion", "http://x/1", dt.datetime(2024, 1, 2, 3, 4, 5))
    assert got["def.html"]["url"] == "unknown" and got["def.html"]["ts"] is not None


def test_page_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(("価格" * 800).encode("cp932"))
    r = pages.read_page_files(spark, str(tmp_path), "cp932").first()
    assert r["html"] == "価格" * 800


def test_files_are_written_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("a_mansion", "f1", "http://x/1", "no price", dt.datetime(2024, 1, 2, 3, 4, 5)), ("b_tochi", "f2", None, " other ", None)],
                                 "company_type string, file string, url string, reason string, ts timestamp")
    for _ in range(2):  # a run again writes the same files
        logs.write_error_pages(rows, str(tmp_path / "notes"))
    got = {r["file"]: r for r in logs.read_error_pages(spark, str(tmp_path / "notes")).collect()}
    assert set(got) == {"f1.html", "f2.html"}
    assert (got["f1.html"]["company_type"], got["f1.html"]["url"], got["f1.html"]["reason"], got["f1.html"]["ts"]) == ("a_mansion", "http://x/1", "no price", dt.datetime(2024, 1, 2, 3, 4, 5))
    assert got["f2.html"]["reason"] == "other" and got["f2.html"]["ts"] is not None
    saved = spark.createDataFrame([("1/a.html", "価格"), ("2.html", None)], "file string, html string")
    pages.write_page_files(saved, f"file:{tmp_path}/pages")
    read = sorted((r["url"].rsplit("/pages/", 1)[1], r["html"]) for r in pages.read_page_files(spark, str(tmp_path / "pages")).collect())
    assert read == [("1/a.html", "価格")] and (tmp_path / "pages" / "2.html").read_bytes() == b""  # Spark reads no empty files
    assert not [p for p in tmp_path.rglob("*.part")]
    pages.write_page_files(saved.limit(0), str(tmp_path / "empty"))


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.0)], "a int, b double")
    logs.append_prediction_errors(rows, str(tmp_path / "e"))
    logs.append_prediction_errors(rows, str(tmp_path / "e"))
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).count() == 2
    logs.write_report(rows, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["b"] == 2.0


def test_upsert_keeps_what_is_not_supplied(spark):
    old = spark.createDataFrame([("a", 1, 5.0), ("b", 2, 6.0)], "k string, v int, growth double")
    new = spark.createDataFrame([("a", 9, 1), ("a", 10, 2), ("c", None, 1)], "k string, v int, seq int")
    got = sorted(map(tuple, upsert.upsert(old, new, ["k"], "seq").collect()))
    assert got == [("a", 10, 5.0), ("b", 2, 6.0), ("c", None, None)]


def test_insert_and_delete(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 2), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, upsert.insert_absent(old, new, ["k"]).collect())) == [("a", 1), ("b", 2)]
    children = spark.createDataFrame([("a", 1), ("b", 1)], "k string, x int")
    kept, rest = upsert.delete_cascade(new, children, F.col("v") == 9, "k", "k")
    assert kept.count() == 2 and [r["k"] for r in rest.collect()] == ["b"]


def test_model_folders(spark, tmp_path):
    df = spark.createDataFrame([(1.0,)], "x double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="f")]).fit(df)
    root = str(tmp_path)
    models.save_model(model, root, "mansion", "first", "rf")
    assert set(models.load_models(spark, root, "mansion", "first")) == {"rf"}
    model.write().overwrite().save(models.legacy_path(root, "mansion", "first"))
    assert set(models.load_models(spark, root, "mansion", "first")) == {"rf", "lgb"}
    assert models.load_models(spark, root, "tochi", "first") == {}
    models.save_master(df, root)
    assert models.load_master(spark, root).count() == 1


def test_union(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("t",)], "y string")
    got = tables.union_sources({("c1", "mansion"): a, ("c2", "tochi"): b})
    assert sorted(got.columns) == ["company", "property_type", "x", "y"] and got.count() == 2


def test_prefecture_codes(one):
    assert one(tables.trade_prefecture, "14") == "神奈川県"
    assert one(tables.trade_prefecture, "99") == "東京都"


def test_notes_are_not_listed_by_the_driver(spark, tmp_path):
    rows = spark.range(300).selectExpr(
        "concat('s', id % 3, '_x') as company_type", "concat('f', id, '.html') as file", "concat('http://x/', id) as url",
        "'無' as reason", "timestamp'2024-01-02 03:04:05' as ts",
    )
    logs.write_error_pages(rows, str(tmp_path / "notes"))
    (tmp_path / "notes" / "s0_x" / "other.txt").write_text("URL: no")
    read = logs.read_error_pages(spark, f"file:{tmp_path}/notes")
    assert read.inputFiles() == []  # of no file does the plan know
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, rows.withColumn("file", F.concat("file", F.lit(".html"))).collect()))
