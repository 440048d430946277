"""Literal cases of every text converter."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from keystead.functions import address, dates, measure, money, road, text, traffic, urls
from keystead.operators.valuation import effective_walk


def cases(*rows):
    return pytest.mark.parametrize("given,want", rows)


@cases(
    ("5,480万円", 54800000), ("1億4,800万円", 148000000), ("1億円", 100000000), ("1.5億円", 150000000), ("", None), (None, None),
    ("-", None), ("価格未定", 0), ("億5000万円", None), ("５，４８０万円", 50000), ("５４８０万円", 54800000), ("1億2億3万", 100020000),
    ("9999999999999999999", None),
)
def test_price(one, given, want):
    assert one(money.price_yen, given) == want


@cases(
    ("1億5,000万円", 150000000), ("8,000万円", 80000000), ("1億円", 100000000), ("12345678", 12345678), ("億5000万円", None),
    ("0円", None), ("万円", None), (None, None), ("1億万円", 100000000),
)
def test_investment_price(one, given, want):
    assert one(money.investment_price_yen, given) == want


@cases(("15,760円", 15760), ("", None), ("-", None), ("なし", 0), ("１２３円", 123))
def test_yen(one, given, want):
    assert one(money.yen, given) == want


@cases(("8.5万円", 80000), ("85,000円", 85000), ("-", None), (" 1億円 ", 100000000))
def test_rent(one, given, want):
    assert one(money.rent_yen, given) == want


@cases(("81.65㎡", Decimal("81.650")), ("1,234.5㎡（壁芯）", Decimal("1234.500")), ("約", None), ("1.2.3㎡", None), ("", None))
def test_area(one, given, want):
    assert one(measure.area_m2, given) == want


@cases(("地上10階", 10), ("平屋", 0), ("", None), (None, None), ("１２階", 12))
def test_first_int(one, given, want):
    assert one(measure.first_int, given) == want


@cases(("8.0％", Decimal("8.00")), ("60%", Decimal("60.00")), ("-", None), ("なし", None))
def test_ratio(one, given, want):
    assert one(measure.ratio_pct, given) == want


@cases(
    ("60%・200%", (60, 200)), ("建ぺい率60%容積率200%", (60, 200)), ("60%/200%", (60, 200)), ("60／200", (None, None)),
    ("容積率300%", (None, 300)), (None, (None, None)),
)
def test_coverage_and_far(one, given, want):
    assert tuple(one(measure.coverage_and_far, given)) == want


@cases(("200%", 200.0), ("容積率 150 %", 150.0), ("400％", 400.0), ("5", None), ("1001", None), (None, None))
def test_limit(one, given, want):
    assert one(measure.ratio_limit, given) == want


@cases(("3階/地上10階 地下1階", (3, 10, 1)), ("平屋", (None, None, None)))
def test_floors(one, given, want):
    assert tuple(one(measure.floors, given)) == want


@cases(("1998年3月", date(1998, 3, 1)), ("1998年13月", None), ("不詳", None), ("平成10年3月", date(1998, 3, 1)), ("２０２０年１月", date(2020, 1, 1)))
def test_built(one, given, want):
    assert one(dates.built_month, given) == want


def test_built_compat(one):
    assert one(lambda c: dates.built_month(c, compat=True), "平成10年3月") == date(10, 3, 1)


@cases(
    ("平成元年", 20.0), ("昭和63年1月", 36.0), ("1998/3", 25.83), ("2023-12-31", 0.08), ("築25年", 20.0), (None, 20.0),
    ("平成10年13月", 20.0), ("令和5年", 1.0),
)
def test_age_years(one, given, want):
    got = one(lambda c: dates.age_years(c, F.to_date(F.lit("2024-01-01"))), given)
    assert got == pytest.approx(want, abs=0.01)


@cases(("2000年5月", 24), ("平成元年", 35), ("昭和60年", 39), ("令和元年", 5), ("昭和元年", 20), ("築25年", 25), (None, 20), ("2050年", 0))
def test_age_whole(one, given, want):
    assert one(lambda c: dates.age_whole_years(c, F.to_date(F.lit("2024-06-01"))), given) == want


@cases(
    ("東京都新宿区西新宿２丁目８−１", "東京都新宿区西新宿2-8-1"), ("東京都千代田区永田町一丁目七番一号", "東京都千代田区永田町1-7-1"),
    ("東京都 港区 赤坂 9丁目 7番 1号", "東京都港区赤坂9-7-1"), ("西新宿二十三丁目十番", "西新宿23-10"), (None, ""), ("−１−", "1"),
)
def test_canonical_address(one, given, want):
    assert one(address.canonical_address, given) == want


def test_canonical_address_compat(one):
    assert one(lambda c: address.canonical_address(c, compat=True), "二十丁目") == "210"


@cases(
    ("東京都世田谷区成城６丁目", ("東京都", "世田谷区", "成城６丁目")), ("神奈川県横浜市中区本町1", ("神奈川県", "横浜市中区", "本町1")),
    ("京都府京都市中京区1", ("京都府", "京都市中京区", "1")), ("千葉県市原市五井", ("千葉県", "市原市", "五井")), ("町田市原町田", ("東京都", "町田市", "原町田")),
    ("鎌倉市材木座", ("神奈川県", "鎌倉市", "材木座")), ("柏市柏", ("千葉県", "柏市", "柏")), ("埼玉県比企郡小川町大塚", ("埼玉県", "比企郡小川町", "大塚")),
    ("", ("", "", "")), ("北海道札幌市北区1", ("北海道", "札幌市北区", "1")),
)
def test_split_address(one, given, want):
    assert tuple(one(address.split_address, given)) == want


def test_light_keys(one):
    assert tuple(one(address.light_key, "神奈川県横浜市中区1")) == ("神奈川県", "横浜市")
    assert tuple(one(address.light_key, "東京都町田市1")) == ("", "")
    assert tuple(one(address.light_key_investment, "千葉県千葉市中央区1")) == ("千葉県", "千葉市")


def routes(one, given):
    return [(r["railway"], r["station"], r["walk_min"]) for r in one(traffic.routes, given)]


def test_routes(one):
    assert routes(one, "小田急線 『成城学園前』駅 徒歩3分") == [("小田急線", "成城学園前", 3)]
    assert routes(one, "JR中央線 三鷹駅 徒歩12分 / 京王線 調布駅 徒歩5分") == [("JR中央線", "三鷹", 12), ("京王線", "調布", 5)]
    # torn into fragments and put together again
    assert routes(one, "京王井の頭線 / 久我山駅 / 徒歩7分") == [("京王井の頭線", "久我山", 7)]
    assert one(traffic.routes, "") is None
    assert len(one(traffic.routes, " / ".join(f"A線 B{i}駅 徒歩{i}分" for i in range(1, 8)))) == 7


def test_bus_route(one):
    r = one(traffic.routes, "京王線 調布駅 バス10分 停歩3分")[0]
    assert (r["walk_min"], r["bus_min"], r["bus_walk_min"], r["bus_use"], r["bus_station"]) == (None, 10, 3, 1, "バス乗車10分")


def spaced(one, given):
    return [(r["railway"], r["station"], r["walk_min"], r["bus_min"]) for r in one(traffic.routes_spaced, given)]


def test_spaced_routes(one):
    assert spaced(one, "小田急線成城学園前駅徒歩3分 京王線調布駅徒歩5分") == [
        ("小田急線", "成城学園前駅", 3, 0), ("京王線", "調布駅", 5, 0),
    ]
    assert spaced(one, "京王線調布駅バス10分停歩3分") == [("京王線", "調布駅", 3, 10)]
    # a later stop time is taken into the first match, as the pattern says
    assert spaced(one, "小田急線成城学園前駅徒歩3分 京王線調布駅バス10分停歩3分") == [("小田急線", "成城学園前駅", 3, 10)]
    assert spaced(one, "東横線「日吉」徒歩4分") == [("東横線", "日吉", 4, 0)]
    assert spaced(one, "なし") == []


@cases(("RC造", "RC"), ("木造2階建", "W"), ("軽量鉄骨造", "LS"), ("重量鉄骨造", "S"), ("SRC造", "SRC"), ("鉄骨鉄筋コンクリート造", "SRC"), (None, "default"), ("鉄骨鉄筋", "SRC"))
def test_structure(one, given, want):
    assert one(road.structure_class, given) == want


def test_structure_label(one):
    assert [one(road.structure_label, t) for t in ("鉄骨鉄筋コンクリート造", "SRC", "鉄筋コンクリート", "鉄骨造", "木造")] == ["ＳＲＣ造", "ＳＲＣ造", "ＲＣ造", "Ｓ造", "木造"]
    literal = lambda c: road.structure_label(c, compat=True)
    assert one(literal, "鉄骨鉄筋コンクリート造") == "ＲＣ造"
    assert one(lambda c: road.structure_class(c, compat=True), "SRC造") == "RC"


def test_all_routes_are_kept(one):
    text = "  ".join(f"山手線「駅{i}」徒歩{i}分" for i in range(1, 8))
    assert len(one(traffic.routes, text)) == 7


@cases(("RC造", "RC"), ("木造2階建", "W"), ("軽量鉄骨造", "S"), (None, "W"), ("鉄骨鉄筋コンクリート", "SRC"), ("レンガ", "W"))
def test_structure_investment(one, given, want):
    assert one(road.structure_class_investment, given) == want


def test_road(one):
    r = one(road.road_facts, "角地 北東側 幅員約6.5m 公道 間口 約8.2m")
    assert (r["direction"], float(r["width"]), float(r["frontage"]), r["road_type"], r["structure"]) == ("北東", 6.5, 8.2, "公道", "角地")
    c = one(road.road_facts_compact, "一方道路・南西17.2m(公道)接面2m")
    assert (c["direction"], float(c["width"]), float(c["frontage"]), c["road_type"]) == ("南西", 17.2, 2.0, "公道")
    n = one(road.road_facts_labelled, "")
    assert tuple(n) == ("-", "0", "0", "-")


def test_fees(one):
    assert one(money.fee_per_area, 10000, 81.65) == Decimal("122.474")
    assert one(money.fee_per_area, 0, 81.65) == Decimal("0.000")
    assert one(money.fee_per_area, 1000000, 0.05) == Decimal("9999.999")
    assert one(money.fee_per_area_even, 1, 16) == Decimal("0.062")
    assert one(measure.depth_m, Decimal("100.5"), Decimal("4")) == Decimal("25.12")
    assert one(money.monthly_rent, 100) == 8


@cases((16800.0, 15.0), (950.0, 8.1375), (0.0, 6.0))
def test_effective_walk(one, given, want):
    assert one(lambda d: effective_walk(F.lit(15), d), given) == pytest.approx(want)


@cases(("ABCあいう", "ABCあ"), ("", ""), (None, ""), ("あいう", "あい"), ("aｱé", "aｱé"))
def test_truncate(one, given, want):
    assert one(lambda c: text.truncate_display(c, 5), given) == want


def test_width(one):
    assert one(text.display_width, "ABあ") == 4


@cases(("  a \n b　c ", "a b c"), ("None", None), ("none ", None), ("", None), (None, None))
def test_clean(one, given, want):
    assert one(text.clean_text, given) == want


@cases(
    ("https://x.jp/list?page=2&a=1", "https://x.jp/list?page=3&a=1"), ("https://x.jp/list", "https://x.jp/list?page=2"),
    ("https://x.jp/list?page=abc", "https://x.jp/list?page=2"), ("https://x.jp/l?a=&b=2#t", "https://x.jp/l?b=2&page=2#t"),
    ("https://x.jp/l?page=1&page=5", "https://x.jp/l?page=2"), (None, None),
)
def test_next_page(one, given, want):
    assert one(urls.next_page_url, given) == want


@cases(
    ("/a", "https://x.jp/a"), ("b.html", "https://x.jp/d/b.html"), ("../b", "https://x.jp/b"), ("?q=1", "https://x.jp/d/p?q=1"),
    ("//y.jp/c", "https://y.jp/c"), ("http://z.jp/", "http://z.jp/"), ("#t", "https://x.jp/d/p?k=1#t"), ("./c", "https://x.jp/d/c"),
)
def test_absolute(one, given, want):
    assert one(urls.absolute_url, given, "https://x.jp/d/p?k=1#u") == want
