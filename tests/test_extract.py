import time

import pytest
from pyspark.sql import functions as F

from keystead.functions import html
from keystead.operators import extract, screening
from keystead.plans.pipeline import parse_pages

PAGE = """<html><head><title>東京の家</title><link href='https://x.jp/l?page=2' rel=canonical></head><body>
<script>var a = "<table><tr><th>偽</th><td>偽</td></tr></table>";</script><!-- <h1>no</h1> -->
<ul class="c breadcrumb"><li><a href="/">TOP</a></li><li>パークハイツ成城</li></ul><h1>家 <em>&amp;</em> 庭</h1>
<table><tr><th>物件名</th><td>-</td><th>価格</th><td> <b>5,480</b> 万円</td></tr>
<tr><th>所在<br>地：</th><td>東京都世田谷区成城６丁目</td></tr><tr><th></th><td>空</td></tr><tr><th>価格</th><td>二番目</td></tr>
<tr><td class="label">築年月</td><td class="content">1998年3月</td></tr><tr><td>a</td><td>b</td></tr></table>
<dl><dt>交通</dt><dt>沿線・駅</dt><dd>小田急線 『成城学園前』駅 徒歩3分</dd></dl>
<a href="/mansion/123/?q=1">x</a><a href='?page=3'>次へ</a><a>none</a>
<img src="a.jpg" alt="外観"><img data-src="/b.png?x" title="間取り"><img src="c.gif"><img src="a.jpg"></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    return spark.createDataFrame([(1, "s", "mansion", "https://x.jp/d/p", PAGE)], "page_id long, site string, property_type string, url string, html string")


def pairs(page):
    return [(p["kind"], p["label"], p["value"]) for p in extract.label_rows(page).first()["pairs"]]


def test_label_pairs(page):
    assert pairs(page) == [
        ("table", "物件名", "-"), ("table", "価格", "5,480万円"), ("table", "所在地", "東京都世田谷区成城６丁目"),
        ("labelled", "築年月", "1998年3月"), ("list", "交通", "小田急線 『成城学園前』駅 徒歩3分"), ("list", "沿線・駅", "小田急線 『成城学園前』駅 徒歩3分"),
    ]


def test_other_precedence(spark):
    text = "<dl><dt>a b</dt><dd>1</dd><dt>ab</dt><dd>22</dd></dl><table><tr><th>ab</th><td>333</td></tr><tr><th>c</th><td>long</td></tr><tr><th>c</th><td>s</td></tr></table>"
    df = spark.createDataFrame([(text,)], "html string")
    got = {p["label"]: p["value"] for p in extract.label_rows(df, "longest").first()["pairs"]}
    assert got == {"ab": "333", "c": "long"}


def test_lookup(spark):
    df = spark.createDataFrame([([("table", "販売価格", "1"), ("list", "価格", "2"), ("labelled", "面積", "3")],)], "p array<struct<kind:string,label:string,value:string>>")
    look = lambda label: df.select(html.lookup(F.col("p"), label)).first()[0]
    assert (look("価格"), look("面積"), look("ない")) == ("1", "3", None)
    free = lambda text: df.select(html.lookup(F.col("p"), "方位", F.lit(text))).first()[0]
    assert (free("<p>方位：南向き</p>"), free("<b>方位</b><i>南</i>"), free("<p>x</p>")) == ("方位：南向き", "南", None)
    two = lambda label, **k: df.select(html.lookup_two_way(F.col("p"), label, **k)).first()[0]
    assert two("価 格：") == "2"
    assert two("価格", partial=True) == "1"


def test_name_cascade(page):
    name = extract.label_rows(page).select(extract.property_name()).first()[0]
    assert name == "パークハイツ成城"
    bare = page.withColumn("html", F.lit("<h1>家 <em>&amp;</em> 庭</h1>"))
    assert extract.label_rows(bare).select(extract.property_name()).first()[0] == "家 & 庭"


LABELS = "site string, property_type string, field string, label string, rank int"


def test_site_labels_go_first(spark, page):
    rows = spark.createDataFrame([("s", "mansion", "price_text", "築年月", 0)], LABELS)
    assert extract.extract_listings(page, rows).first()["price_text"] == "1998年3月"
    assert extract.extract_listings(page).first()["price_text"] == "5,480万円"


def test_site_labels_rank_ties_and_nulls(spark):
    def listed(i, cells):
        return i, "s", "mansion", f"http://x/{i}", "<table>" + "".join(f"<tr><th>{k}</th><td>{v}</td></tr>" for k, v in cells) + "</table>"

    pages = spark.createDataFrame([
        listed(1, [("甲", "1"), ("乙", "2"), ("丙", "3")]), listed(2, [("甲", ""), ("乙", "2")]), listed(3, [("備考", "x")]), (4, "s", "mansion", "u", None), (5, None, None, "u", "<p>"),
    ], "page_id long, site string, property_type string, url string, html string")
    rows = [("s", "mansion", "biko", "甲", 1), ("s", "mansion", "biko", "乙", 1), ("s", "mansion", "biko", "丙", 2), ("s", "kodate", "biko", "丙", 0),
            ("s", "mansion", "biko", "丙", None), ("s", "mansion", "nothing", "甲", 0), (None, "mansion", "biko", "甲", 0), ("s", "mansion", "price_text", "甲", 5)]
    # twenty thousand labels that no page has: a table of any length
    many = spark.range(20000).select(F.lit("s"), F.lit("mansion"), F.lit("biko"), F.concat(F.lit("x"), "id"), F.lit(0)).toDF("site", "property_type", "field", "label", "rank")
    got = {r["page_id"]: (r["biko"], r["price_text"]) for r in extract.extract_listings(pages, spark.createDataFrame(rows, LABELS).unionByName(many)).collect()}
    assert got[1] == ("2", "1") and got[2] == ("2", None) and got[3] == ("x", None)  # 乙 sorts before 甲
    none = spark.createDataFrame([], LABELS)
    assert extract.extract_listings(pages, none).exceptAll(extract.extract_listings(pages)).isEmpty()


def test_parse_pages(page):
    ok, bad = parse_pages(page)
    assert ok.isEmpty() and bad.first()["reasons"] == ["area_missing"]  # the page has no area
    ok, bad = parse_pages(page, strict=False)
    r = ok.first()
    assert (r["price_yen"], r["address2"], r["station1"], r["walk_min1"]) == (54800000, "世田谷区", "成城学園前", 3)
    assert bad.isEmpty()


def test_links(page):
    got = {r["dst_url"] for r in extract.page_links(page).collect()}
    assert got == {"https://x.jp/", "https://x.jp/mansion/123/?q=1", "https://x.jp/d/p?page=3"}
    detail = extract.page_links(page, extract.DETAIL_PATHS, canonical=True)
    assert [r["dst_url"] for r in detail.collect()] == ["https://x.jp/mansion/123/"]


def test_next_page(page):
    assert extract.next_pages(page).first()["next_url"] == "https://x.jp/d/p?page=3"
    without = page.withColumn("html", F.regexp_replace("html", "次へ", "先"))
    assert extract.next_pages(without).first()["next_url"] == "https://x.jp/l?page=3"


def test_images(page):
    found = page.select(extract.clean_images(extract.page_images(html.visible_markup("html"), "url")).alias("i"))
    assert [tuple(i) for i in found.first()["i"]] == [("https://x.jp/d/a.jpg", "exterior"), ("https://x.jp/b.png?x", "layout")]


def test_image_rules(spark):
    rows = [("1.jpg", "外観"), ("2.jpg", "間取図"), ("3.jpg", "リビング"), ("4.jpg", "周辺環境"), ("5.jpg", "最寄り駅"), ("logo.jpg", ""), ("7.jpg", "エントランス"), ("8.jpg", "寝室")]
    df = spark.createDataFrame([(rows,)], "i array<struct<url:string,label:string>>")
    kept = df.select(extract.clean_images(F.col("i")).alias("i"))
    assert [i["category"] for i in kept.first()["i"]] == ["exterior", "layout", "interior", "exterior", "interior"]
    three = df.select(extract.clean_images(F.concat("i", "i")).alias("i")).select(screening.images_for_analysis("i").alias("c")).first()["c"]
    assert [i["category"] for i in three] == ["layout", "layout", "exterior", "exterior", "interior", "interior"]


@pytest.mark.parametrize("text,want", [
    ("<title>掲載終了</title>", "ended"), ("<title>サーバーが混み合っています</title>", "busy"), ("<p>お探しの物件は見つかりません</p>", "ended"),
    ("<title>家</title>", "active"), ("", "active"),
])
def test_status(one, text, want):
    assert one(lambda c: extract.page_status(c), text) == want


def test_analysis_reply(one):
    r = one(extract.analysis_reply, 'Here:\n```json\n{"interior_score": 4, "plot_shape_type": "regular"}\n```')
    assert (r["interior_score"], r["layout_score"], r["plot_shape_type"], r["maintenance_comment"]) == (4.0, 3.5, "regular", "")
    assert one(extract.analysis_reply, "no json")["plot_shape_description"] == "画像なしのため判定不能"


def test_state(spark):
    state = '{"props":{"pageProps":{"propertyList":[{"detailUrl":"/a"}],"summary":{"tableItems":[{"title":"住所","data":{"text":"東京"}},{"title":"備考","data":{"html":"<p>x</p>"}}]}}}}'
    df = spark.createDataFrame([(1, f'<script id="__NEXT_DATA__" type="application/json">{state}</script>')], "page_id long, html string")
    assert extract.state_detail_urls(df, "https://x.jp").first()["detail_url"] == "https://x.jp/a"
    r = extract.state_values(df, ["所在地", "備考", "価格"]).first()
    assert (r["所在地"], r["備考"], r["価格"]) == ("東京", "x", "")


def test_script_ids(spark):
    df = spark.createDataFrame([(1, "u", "{'number': 'B2'},{'number':'A1'},{'number': 'B2'}")], "page_id long, url string, html string")
    assert [r["item_id"] for r in extract.script_ids(df).orderBy("pos").collect()] == ["A1", "B2"]


def test_investment_kind(one):
    assert one(extract.investment_kind, "一棟アパート") == "apartment"
    assert one(extract.investment_kind, "戸建") == "kodate"
    assert one(extract.investment_kind, "") is None


def test_error_rows(spark):
    df = spark.createDataFrame([("u", ["price", "address"])], "url string, reasons array<string>")
    r = extract.error_rows(df, F.lit("MitsuiInvestmentKodate"), F.lit("2024-01-01").cast("timestamp")).first()
    assert (r["company_type"], r["reason"], len(r["file"])) == ("mitsui_investment_kodate", "price, address", 64)


@pytest.mark.parametrize("n", [1, 100])
@pytest.mark.parametrize("charset,declared", [("cp932", "cp932"), ("euc-jp", "euc-jp"), ("utf-8", "ascii"), ("utf-8", "UTF-8"), ("utf-8", None)])
def test_decode(spark, charset, declared, n):
    text = "東京都の中古マンション" * n
    df = spark.createDataFrame([(bytearray(text.encode(charset)),)], "content binary")
    assert df.select(extract.decode_page("content", F.lit(declared).cast("string"))).first()[0] == text


def test_long_pages_do_not_end_the_jvm(one):
    """10^5 tags, with and without dd."""
    tags = "<span>x</span>" * 50_000
    assert one(html.label_pairs, "<dl><dt>a</dt>" + tags + "</dl>") == []
    assert one(html.label_pairs, "<dl>" + "<dt>a</dt>" * 50_000 + "</dl>") == []
    gap = "<i></i>" * 50_000
    assert [tuple(p) for p in one(html.label_pairs, f"<dl><dt>a</dt>{gap}<dt>b：</dt> <dd>c</dd><dd>d</dd></dl>")] == [("list", "a", "c"), ("list", "b", "c")]
    rows = "<dt>k</dt><dd>v</dd>" * 30_000
    assert len(one(html.label_pairs, f"<dl>{rows}</dl>")) == 30_000


def test_unclosed_anchors(spark):
    """Each one is found; a page of 100,000 takes no time that grows with their square."""
    text = '<p><a href="/1">one<a href="/2">two</a> no <A HREF=/3 >three</A ><abbr>x</abbr><a name="n">n</a><a href="/4"'
    page = spark.createDataFrame([(text,), ("",), (None,)], "markup string").select(html.links("markup").alias("l")).collect()
    assert [tuple(x) for x in page[0]["l"]] == [("/1", "one"), ("/2", "two"), ("/3", "three")]
    assert page[1]["l"] == [] and page[2]["l"] is None
    start = time.time()
    many = spark.range(1).select(F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(100000)), lambda i: F.concat(F.lit('<a href="/'), i, F.lit('">x')))).alias("markup"))
    assert many.select(F.size(html.links("markup"))).first()[0] == 100000
    assert time.time() - start < 20
