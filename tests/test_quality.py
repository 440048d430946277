from decimal import Decimal

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from keystead.functions import address, text
from keystead.operators import normalize, quality, repair


def reasons_of(spark, rules, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return quality.apply_rules(row, rules(row) if callable(rules) and rules is not quality.required_rules else rules()).first()["reasons"]


GOOD = dict(
    property_name="パークハイツ", price_text="5,480万円", price_yen=54800000, address="東京都港区1", address1="東京都", address2="港区",
    railway1="山手線", station1="新宿", walk_min1=3, property_type="mansion", senyu_menseki=70.0, tochi_menseki=0.0, built_text="2000年1月",
    url="http://x/1", kanrihi=1, syuzen=1, tatemono_menseki=0.0,
)


def test_required(spark):
    assert reasons_of(spark, quality.required_rules, **GOOD) == []
    assert reasons_of(spark, quality.required_rules, **{**GOOD, "price_yen": 0, "price_text": " "}) == ["price"]
    assert reasons_of(spark, quality.required_rules, **{**GOOD, "price_yen": 0}) == []
    assert reasons_of(spark, quality.required_rules, **{**GOOD, "property_name": "", "address": "-"}) == ["property_name", "address"]


def test_strict(spark):
    assert reasons_of(spark, quality.strict_rules, **GOOD) == []
    bad = {**GOOD, "property_name": "不動産購入、A", "price_yen": 500000, "railway1": "山手線徒歩3分", "station1": "「新宿", "senyu_menseki": 0.0}
    assert reasons_of(spark, quality.strict_rules, **bad) == ["name_seo", "price_scale", "railway_dirty", "station_dirty", "area_missing"]
    assert reasons_of(spark, quality.strict_rules, **{**GOOD, "property_type": "tochi", "tochi_menseki": 10.0, "built_text": ""}) == []
    assert reasons_of(spark, quality.strict_rules, **{**GOOD, "built_text": "昭和年"}) == ["built_incomplete"]


def test_schema(spark):
    assert reasons_of(spark, quality.schema_rules, **GOOD) == []
    assert reasons_of(spark, quality.schema_rules, **{**GOOD, "price_yen": 10**11 + 1, "senyu_menseki": 10001.0}) == ["price_range", "senyu_range"]


def test_missing_fields(spark):
    row = spark.createDataFrame([("investment", "n", "u", 1, "a", 5.0)], "property_type string, property_name string, url string, price_yen long, address string, gross_yield double")
    missing = quality.reject_incomplete(row).first()["missing"]
    assert set(missing) == {"annual_rent", "monthly_rent", "current_status", "tochi_menseki", "tatemono_menseki"}


def test_split_valid(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "")], "id int, property_name string")
    ok, bad = quality.split_valid(quality.apply_rules(rows, [("name", F.col("property_name") == "")]))
    assert [r["id"] for r in ok.collect()] == [1] and bad.first()["reasons"] == ["name"]


def test_clean_strings(spark):
    rows = spark.createDataFrame([(" a  b ", "None"), (None, "x")], "a string, b string")
    got = normalize.clean_strings(rows, not_null=["b"]).collect()
    assert [tuple(r) for r in got] == [("a b", ""), (None, "x")]


def test_typed_columns_keep_raw(spark):
    rows = spark.createDataFrame([("5,480万円", "81.65㎡")], "price_text string, senyu_menseki_text string")
    r = normalize.typed_columns(rows).first()
    assert (r["price_text"], r["price_yen"], r["senyu_menseki"]) == ("5,480万円", 54800000, Decimal("81.650"))


def test_normalize_whole_row(spark):
    rows = spark.createDataFrame(
        [(1, "東京都世田谷区成城６丁目", "小田急線 『成城学園前』駅 徒歩3分", "5,480万円", "1998年3月", "RC造", "2024-01-01")],
        "property_id long, address string, traffic string, price_text string, built_text string, kouzou string, day string",
    ).withColumn("input_ts", F.to_timestamp("day"))
    r = normalize.normalize_listings(rows).first()
    assert (r["address1"], r["address2"], r["address3"]) == ("東京都", "世田谷区", "成城６丁目")
    assert (r["railway1"], r["station1"], r["walk_min1"], r["route_count"]) == ("小田急線", "成城学園前", 3, 1)
    assert (r["price_yen"], r["structure"], r["age_whole_years"], r["old_quake_code"]) == (54800000, "RC", 26, 0)


def test_ratio_repair(spark):
    rows = spark.createDataFrame(
        [(1, "60%／200%", "", None, None), (2, "50%", "100%", 50.0, 100.0)],
        "id int, kenpei_text string, youseki_text string, kenpei double, youseki double",
    )
    got = [tuple(r) for r in repair.repair_ratios(rows).orderBy("id").select("id", "kenpei_text", "youseki_text", "kenpei", "youseki").collect()]
    assert got == [(1, "60%", "200%", 60.0, 200.0), (2, "50%", "100%", 50.0, 100.0)]


def test_recover_source(spark):
    rows = spark.createDataFrame([("unknown", "mitsuimansion"), ("unknown", "other"), ("x", "mitsuitochi")], "company string, property_type string")
    got = [tuple(r) for r in repair.recover_source(rows).collect()]
    assert got == [("mitsui", "mansion", True), ("unknown", "other", False), ("x", "mitsuitochi", False)]


TEXTS = st.lists(st.text(alphabet="東京都市区町一二三十丁目番号-ー−１２９0123 　\n\tNonea", max_size=25), min_size=1, max_size=30)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS)
def test_canonical_and_clean_are_idempotent(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    once = df.select(address.canonical_address("t").alias("a"), text.clean_text("t").alias("c"))
    twice = once.select("a", "c", text.clean_text("c").alias("cc"))
    for r in twice.collect():
        assert r["c"] == r["cc"]
        assert not (r["a"] or "").startswith("-") and not (r["a"] or "").endswith("-")
