import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from keystead.operators import aggregates, investment, lookups, screening, valuation

LISTING = (
    "property_id long, property_type string, address1 string, address2 string, station1 string, walk_min1 int, senyu_menseki double, "
    "tochi_menseki double, tatemono_menseki double, kouzou string, built date, built_text string, setsudou string, biko string, tochikenri string, "
    "road_width double, maguchi double, youseki_text string, kenpei_text string, youto_chiiki string, gross_yield double, annual_rent double, "
    "price_yen long, road_structure string, kuiki string"
)
BASE = dict(
    property_id=1, property_type="kodate", address1="東京都", address2="港区", station1="新宿駅", walk_min1=None, senyu_menseki=None, tochi_menseki=200.0,
    tatemono_menseki=100.0, kouzou="木造", built=date(2010, 1, 1), built_text="", setsudou="", biko="", tochikenri="所有権", road_width=6.0, maguchi=10.0,
    youseki_text="200%", kenpei_text="60%", youto_chiiki="第一種住居地域", gross_yield=None, annual_rent=None, price_yen=50000000, road_structure="", kuiki="",
)


@pytest.fixture(scope="module")
def dims(spark):
    m = spark.createDataFrame(
        [("東京都", "港区", 0.5, 5000, 250000, 1.0, 16800.0), ("東京都", "青梅市", -0.5, 3000, None, None, 950.0)],
        "prefecture string, city string, pop_growth double, income int, total_population long, income_growth double, density double",
    )
    s = spark.createDataFrame([(1, "新宿", "A", 100), (2, "新宿駅", "B", 500)], "station_id long, station_name string, railway_line string, passenger_volume long")
    p = spark.createDataFrame(
        [(1, "東京都", "港区", "residential", 1000000, 800000, 700000, 2.0), (2, "東京都", "港区", "commercial", 2000000, None, 1400000, None)],
        "land_id long, prefecture string, city string, land_use string, average long, rosenka long, fixed_asset long, growth double",
    )
    h = spark.createDataFrame([("東京都", "港区", 2, 1)], "prefecture string, city string, flood int, landslide int")
    z = spark.createDataFrame([(1, "第一種低層住居専用地域", 50, 100), (2, "商業地域", 80, 400)], "zone_id long, zone_name string, max_kenpei int, max_youseki int")
    return valuation.Dimensions(m, s, p, h, z)


@pytest.fixture()
def features(spark, dims):
    def run(master=None, compat=False, **changes):
        row = {**BASE, **changes}
        names = [c.split()[0] for c in LISTING.split(", ")]
        df = spark.createDataFrame([tuple(row[n] for n in names)], LISTING)
        return valuation.build_features(df, dims, F.to_date(F.lit("2020-01-01")), master, compat).first()
    return run


def test_max_areas(features):
    f = features()
    assert (f["max_building_area"], f["max_floor_area"]) == (pytest.approx(120.0), pytest.approx(400.0))
    assert features(road_structure="角地")["max_building_area"] == pytest.approx(140.0)


@pytest.mark.parametrize("rights,want", [("所有権", 1.0), ("借地権", 0.65), ("底地", 0.20), ("定期借地権", 0.70 * 0.8)])
def test_rights(features, rights, want):
    assert features(tochikenri=rights)["rights_ratio"] == pytest.approx(want, abs=0.001)


def test_term_lease_at_25_years(features):
    assert features(tochikenri="定期借地", built=date(1995, 1, 1))["rights_ratio"] == pytest.approx(0.35, abs=0.001)


@pytest.mark.parametrize("biko,want", [("旗竿地", 0.25), ("台形地", 0.15), ("", 0.0)])
def test_shade(features, biko, want):
    assert features(biko=biko)["shade_ratio"] == want


def test_walk_weight(features):
    assert features(walk_min1=15)["effective_walk"] == pytest.approx(15.0)
    assert features(address2="青梅市")["effective_walk"] == pytest.approx(8.1375)


def test_municipality_gaps(features):
    known = features(address2="青梅市")
    assert (known["total_population"], known["income_growth"]) == (100000, 0.0)
    pref = features(address2="未知")
    assert (pref["income"], pref["pop_growth"], pref["density"]) == (4000, 0.0, pytest.approx(8875.0))
    assert features(address2="未知", compat=True)["income_growth"] == 0.5
    none = features(address1="北海道", address2="札幌市")
    assert (none["income"], none["total_population"], none["density"]) == (3000, 100000, 4000.0)


def test_station_last_row_wins(features):
    assert features()["passenger_volume"] == 500
    assert features(station1="なし")["passenger_volume"] == 10000


def test_land_price_blend(features):
    f = features(youseki_text="300%")
    assert f["average_land_price"] == 1500000
    assert f["rosenka_price"] == 800000  # commercial has none
    assert f["fixed_asset_price"] == 1050000
    assert features(youseki_text="100%")["average_land_price"] == 1000000
    assert features(youseki_text="500%")["average_land_price"] == 2000000
    assert features(address1="北海道")["average_land_price"] == 350000
    assert features(address1="北海道")["rosenka_price"] == 280000


def test_zone_limits(features):
    f = features(youseki_text="商業地域", kenpei_text=None)
    assert (f["max_youseki"], f["max_kenpei"]) == (400.0, 80.0)
    f = features(youseki_text=None, kenpei_text=None)
    assert (f["max_youseki"], f["max_kenpei"]) == (200.0, 60.0)


def test_setback(features):
    f = features(road_width=3.0, maguchi=10.0)
    assert (f["setback_area"], f["land_area"]) == (5.0, 195.0)
    assert features(biko="セットバック約3.5㎡要")["setback_area"] == 3.5
    f = features(road_width=None, maguchi=None, setsudou="北2m 間口8m")
    assert (f["road_width_m"], f["frontage_m"], f["setback_area"]) == (2.0, 8.0, 8.0)
    assert features(tochi_menseki=3.0, road_width=2.0)["setback_ratio"] == 1.0


def test_land_factors(features):
    f = features(property_type="tochi", setsudou="北5m", road_width=None, maguchi=1.5)
    assert (f["volume_digest_factor"], f["frontage_factor"], f["area"]) == (1.15, 0.25, 200.0)
    assert features(setsudou="南5m", tochi_menseki=50.0)["volume_digest_factor"] == 0.85
    assert features(setsudou="二方道路 6m")["road_condition_factor"] == 1.03
    assert features(road_width=4.0)["actual_volume_limit"] == pytest.approx(160.0)
    assert features(road_width=4.0, youto_chiiki="商業地域")["actual_volume_limit"] == 200.0


def test_volume_use(features):
    f = features(tatemono_menseki=500.0)
    assert (f["digest_volume_ratio"], f["surplus_volume"], f["non_conforming"]) == (250.0, 0.0, 1)


def test_income_value(features):
    assert features(annual_rent=1200000.0, gross_yield=6.0)["income_approach_value"] == pytest.approx(2000.0)
    assert features(annual_rent=120.0, gross_yield=6.0, compat=True)["income_approach_value"] == pytest.approx(2000.0)


def test_market_value(spark, features):
    master = spark.createDataFrame([("東京都", "青梅市", "kodate", 0, 40.0), ("東京都", "八王子市", "kodate", 0, 60.0)], "prefecture string, city string, property_type string, age_band int, unit_price double")
    assert features(master)["market_value"] == pytest.approx(50.0 * 100)
    assert features(master, address2="青梅市")["market_value"] == pytest.approx(40.0 * 100)
    assert features(master, address1="北海道")["market_value"] == pytest.approx(30.0 * 100)


def test_market_master(spark):
    df = spark.createDataFrame([("東京都", "港区", "mansion", 6000.0, 60.0, None, None, 5.0)], "address1 string, address2 string, property_type string, price_man double, senyu_menseki double, tatemono_menseki double, tochi_menseki double, age_years double")
    assert aggregates.market_master(df).first()["unit_price"] == 100.0


@pytest.mark.parametrize("kind,age,want", [("RC", 10, 35), ("W", 20, 20), ("RC", 5, 35), ("S", 10, 24)])
def test_loan_years(one, kind, age, want):
    assert one(lambda k, a: investment.loan_years(k, a), kind, age) == want


def test_payment(one):
    assert one(lambda p: investment.annual_payment(p, 0.025, F.lit(35)), 1000.0) == pytest.approx(42.90, abs=0.01)
    assert one(lambda p: investment.annual_payment(p, 0.0, F.lit(20)), 1000.0) == 50.0
    assert one(lambda p: investment.annual_payment(p, 0.025, F.lit(20)), 0.0) == 0.0


@pytest.fixture()
def invest(spark, dims):
    schema = (
        "price_yen long, address1 string, address2 string, address string, tochi_menseki double, tatemono_menseki double, senyu_menseki double, kouzou string, "
        "built date, built_text string, annual_rent double, gross_yield double, tochikenri string, biko string, pred1 double, pred2 double"
    )
    base = dict(
        price_yen=100000000, address1="東京都", address2="港区", address="東京都港区1", tochi_menseki=100.0, tatemono_menseki=200.0, senyu_menseki=None, kouzou="RC造",
        built=date(2010, 1, 1), built_text="", annual_rent=800.0, gross_yield=8.0, tochikenri="所有権", biko="", pred1=None, pred2=None,
    )

    def run(**changes):
        row = {**base, **changes}
        df = spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))], schema)
        return investment.evaluate_investments(df, dims.land_price, F.to_date(F.lit("2020-06-01"))).first()
    return run


def test_investment(invest):
    r = invest()
    assert (r["noi"], r["asset_age"], r["loan_years"]) == (640, 10, 35)
    assert r["asset_value"] == int(100 * 1000000 / 10000 + 200 * 20.0 * 37 / 47)
    assert invest(annual_rent=8000000.0)["noi"] == 640
    assert invest(annual_rent=0.0, gross_yield=4.0)["noi"] == 320
    assert invest(annual_rent=None, gross_yield=None)["noi"] == 640
    assert invest(price_yen=90000) is None


def test_investment_rules(invest):
    cash = invest(biko="再建築不可")
    assert (cash["debt_service"], float(cash["dscr"])) == (0, 9.99)
    assert invest(tochikenri="借地権")["noi"] == int(640 - cash["asset_value"] * 0.01)
    for r in (invest(), invest(pred2=12000.0), invest(annual_rent=1.0)):
        assert 0 <= r["total_investment_score"] <= 100


@pytest.mark.parametrize("place,want", [(("東京", "港"), 1000000), (("東京都", "未知"), 1500000), (("大阪府", "北区"), 100000), (("", "港区"), 100000)])
def test_land_price_contains(spark, dims, place, want):
    df = spark.createDataFrame([place], "address1 string, address2 string")
    assert lookups.with_land_price_contains(df, dims.land_price).first()["asset_land_price"] == want


def test_discount_rule(spark):
    df = spark.createDataFrame(
        [(8000000, 1000.0), (5000000, 1000.0), (9000000, 1000.0)], "price_yen long, pred2 double"
    ).select("*", F.lit(None).cast("double").alias("pred1"), F.lit("mansion").alias("property_type"), F.lit(False).alias("is_notified"),
             F.lit(None).cast("double").alias("investment_score"), F.lit(None).cast("double").alias("total_investment_score"))
    got = {r["price_yen"]: (r["recommend_reason"], r["suspect_error"]) for r in screening.recommend(df).collect()}
    assert got == {8000000: ("discount", False), 5000000: (None, True), 9000000: (None, False)}


def test_score_statistics_defaults(spark):
    df = spark.createDataFrame([(float(i), None) for i in range(9)], "investment_score double, total_investment_score double").select(
        "*", F.lit("completed").alias("analysis_status"), F.lit(None).cast("bigint").alias("duplicate_of")
    )
    assert [tuple(r) for r in aggregates.score_statistics(df, min_rows=10).collect()] == [(False, 55.0, 12.0, 9)]
    # without a limit small groups have their own figures; without spread the default
    assert [tuple(r) for r in aggregates.score_statistics(df).collect()] == [(False, 4.0, pytest.approx(math.sqrt(60 / 9)), 9)]
    assert [tuple(r) for r in aggregates.score_statistics(df.limit(1)).collect()] == [(False, 0.0, 12.0, 1)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("n", [1, 2, 7, 100, 5000])
def test_exact_quantiles(spark, seed, n):
    import numpy as np

    rng = np.random.default_rng(seed)
    values = np.where(rng.random(n) < 0.3, 5.0, np.round(rng.normal(size=n), 2))  # a third of all rows alike
    df = spark.createDataFrame([("a", float(v)) for v in values], "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.98, 1.0]
    got = aggregates.exact_quantiles(df, ["g"], "v", probs).first()
    assert [got[f"q{i}"] for i in range(len(probs))] == pytest.approx(list(np.quantile(values, probs)))
    coarse = aggregates.exact_quantiles(df, [], "v", probs, accuracy=10).first()
    assert [coarse[f"q{i}"] for i in range(len(probs))] == pytest.approx(list(np.quantile(values, probs)))


def test_containment_pairs_equal_brute_force(spark):
    import random

    from keystead.operators.lookups import containment_pairs

    rng = random.Random(3)
    name = lambda n: "".join(rng.choice("川市田中県a") for _ in range(rng.randint(1, n)))
    stored, asked = {name(7) for _ in range(300)}, {name(4) for _ in range(80)} | {"無い"}
    a = spark.createDataFrame([(x,) for x in [*asked, "", None, *asked]], "part string")
    b = spark.createDataFrame([(x,) for x in [*stored, "", None]], "name string")
    got = [tuple(r) for r in containment_pairs(a, b, "part", "name").collect()]
    assert sorted(got) == sorted((x, y) for x in asked for y in stored if x in y)
    assert containment_pairs(a.limit(0), b, "part", "name").isEmpty() and containment_pairs(a, b.limit(0), "part", "name").isEmpty()


def test_exact_quantiles_of_one_hot_group(spark):
    import numpy as np

    hot = spark.range(200000).select(F.lit("hot").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(10**6)) / 7.0).alias("v"))
    rows = hot.unionByName(spark.createDataFrame([("small", 1.0), ("small", 2.0), ("none", None), (None, 1.0)], "g string, v double"))
    got = {r["g"]: r for r in aggregates.exact_quantiles(rows, ["g"], "v", [0.25, 0.5, 0.999], accuracy=100).collect()}
    values = np.array([r["v"] for r in hot.collect()])
    assert [got["hot"][f"q{i}"] for i in range(3)] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.999])))
    assert got["small"]["q1"] == 1.5 and set(got) == {"hot", "small"}
