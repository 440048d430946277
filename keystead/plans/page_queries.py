"""Queries over stored pages and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystead import vocab
from keystead.functions import html
from keystead.functions.text import explode_kept
from keystead.operators import extract, quality, screening, upsert
from keystead.plans.quality_queries import PREDICTION_ERRORS_SQL, REQUIRED, joined_reasons, prediction_errors
from keystead.plans.registry import has, query, trim, whole
from keystead.plans.testbed import cte, load, table
from keystead.plans.text_queries import url_sql
from keystead.session import scratch_path, stage
from keystead.sources import logs, pages, tables

PAGE = cte("page")

# --- given pages ---------------------------------------------------------------------

_VISIBLE = r"regexp_replace(regexp_replace({}, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b[^>]*>.*?</script[ ]*>|<style\b[^>]*>.*?</style[ ]*>', '', 'g')"


def unescape_sql(x: str) -> str:
    for entity, char in text_entities():
        x = f"replace({x}, '{entity}', {char})"
    return x


def text_entities():
    return [
        ("&nbsp;", "chr(32)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&apos;", "chr(39)"),
        ("&yen;", "'¥'"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&times;", "'×'"), ("&sup2;", "'²'"), ("&hellip;", "'…'"), ("&amp;", "'&'"),
    ]


def plain_sql(x: str) -> str:
    return trim(unescape_sql(f"regexp_replace({x}, '<[^>]*>', '', 'g')"))


_ROOT = f"{url_sql('url', 1)} || '://' || {url_sql('url', 2)}"
_DIR = f"regexp_replace(case when {url_sql('url', 3)} = '' then '/' else {url_sql('url', 3)} end, '[^/]*$', '')"


def absolute_sql(h: str) -> str:
    return f"""(case when regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*:') then {h} when starts_with({h}, '//') then {url_sql("url", 1)} || ':' || {h}
      when starts_with({h}, '/') then {_ROOT} || {h} when starts_with({h}, '?') then {_ROOT} || {url_sql("url", 3)} || {h}
      when starts_with({h}, '#') then regexp_replace(url, '#.*$', '') || {h} else {_ROOT} || {_DIR} || {h} end)"""


@query("page_links", f"""
with a as (select url, unnest(regexp_extract_all({_VISIBLE.format("html")}, '(?is)<a\\b[^>]*\\shref="([^"]*)"', 1)) as h0 from pages),
b as (select url, {unescape_sql("h0")} as h from a where h0 <> '')
select distinct url as src_url, {absolute_sql("h")} as dst_url from b""")
def page_links(spark, sf):
    return extract.page_links(table(spark, sf, "pages"))


@query("page_headings", f"""
select page_id, nullif({plain_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '') as title,
  nullif({plain_sql(f"regexp_extract({_VISIBLE.format('html')}, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, '') as h1 from pages""")
def page_headings(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", html.title("html").alias("title"), html.heading(html.visible_markup("html")).alias("h1")
    )


_TITLE = plain_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
STATUS_SQL = f"""case when contains({_TITLE}, 'サーバーが混み合っています') then 'busy'
  when {has(_TITLE, vocab.ENDED_TITLE_WORDS)} or {has("html", vocab.ENDED_PHRASES)} then 'ended' else 'active' end"""


@query("page_status", f"""{PAGE} select page_id, {STATUS_SQL} as status,
  case when page_id % 10 = 0 then 'error' else {STATUS_SQL} end as status_http from page""")
def page_status(spark, sf):
    rows = load(spark, sf, "page").select("page_id", "html")
    http = F.when(F.col("page_id") % 10 == 0, 503).otherwise(200)
    return rows.select(
        "page_id", extract.page_status("html").alias("status"), extract.page_status("html", http).alias("status_http")
    )


# --- listing pages -------------------------------------------------------------------------

@query("detail_links", f"""{PAGE}, l as (select page_id, unnest(['/mansion/' || cast(page_id as string) || '/', '/kodate/' || cast(page_id % 100 as string)]) as path from page)
select distinct 'http://ex.example/' || property_type || '/' || cast(l.page_id as string) || '/' as src_url, 'http://ex.example' || path as dst_url from l join page p on l.page_id = p.page_id
union select url, url from page where page_id % 6 = 1 and property_type in ('mansion', 'kodate', 'tochi')""")
def detail_links(spark, sf):
    return extract.page_links(load(spark, sf, "page"), extract.DETAIL_PATHS, canonical=True)


@query("next_pages", f"""{PAGE} select page_id, case when page_id % 6 = 1 then url || '?page=9'
  else 'https://ex.example/list/' || property_type || case page_id % 4 when 0 then '?page=' || cast(page_id % 30 + 1 as string) || '&sort=new' when 1 then '?page=2' when 2 then '?sort=old&page=2' else '?area=13&page=2#top' end end as next_url from page""")
def next_pages(spark, sf):
    return extract.next_pages(load(spark, sf, "page")).drop("url")


@query("script_ids", f"""{PAGE} select page_id, i as pos, case i when 0 then 'A1' else 'B' || cast(page_id as string) end as item_id from page, (select unnest([0, 1]) as i) x""")
def script_ids(spark, sf):
    return extract.script_ids(load(spark, sf, "page").select("page_id", "url", "html")).drop("url")


def _value(x):
    return f"nullif({trim(x)}, '')"


_NAME = _value("coalesce(property_name, '-')")
SPECS = [
    ("price_text", _value("price_text")), ("address", _value("address")),
    ("traffic", _value("coalesce(traffic, '')")), ("built_text", _value("built_text")), ("biko", _value("coalesce(biko, '')")),
]
FIELDS = ", ".join(f"{v} as {c}" for c, v in SPECS)
_PAGE_JOIN = "page p join listing l on p.page_id = l.listing_id"


@query("label_pairs", f"""{PAGE}, v as (select page_id, l.* from {_PAGE_JOIN}),
u as (select page_id, case when page_id % 5 = 0 then '建物名' else '物件名' end as label, {trim("coalesce(property_name, '-')")} as value from v
  union all select page_id, case when page_id % 2 = 0 then '価格' else '販売価格' end, {trim("price_text")} from v
  union all select page_id, '所在地', {trim("address")} from v union all select page_id, '交通', {trim("coalesce(traffic, '')")} from v
  union all select page_id, '築年月', {trim("built_text")} from v union all select page_id, '備考', {trim("coalesce(biko, '')")} from v
  union all select page_id, '物件名', '後の名前' from v where page_id % 5 = 0
  union all select page_id, '種別', case page_id % 4 when 0 then '一棟アパート' when 1 then '中古一戸建て' when 2 then 'ビル' else '' end from v)
select page_id, label, value from u""")
def label_pairs(spark, sf):
    rows = extract.label_rows(load(spark, sf, "page").select("page_id", "html"))
    return explode_kept(rows, ["page_id"], F.col("pairs"), "p").select("page_id", "p.label", "p.value")


# the heading keeps its small print; the breadcrumb ends on the type or on a stop word
_SPEC_NAME = f"case when page_id % 5 = 0 then '後の名前' else nullif({_NAME}, '-') end"
NAME_SQL = f"""coalesce({_SPEC_NAME}, case when page_id % 5 = 0 then null end, case when page_id % 3 <> 0 then p.property_type end,
  {plain_sql("coalesce(property_name, '') || '<small> 中古 </small>'")})"""


@query("property_names", f"""{PAGE} select page_id, {NAME_SQL} as name from {_PAGE_JOIN}""")
def property_names(spark, sf):
    rows = extract.label_rows(load(spark, sf, "page").select("page_id", "html"))
    return rows.select("page_id", extract.property_name().alias("name"))


@query("extract_listings", f"""{PAGE}, live as (select * from page where {STATUS_SQL} = 'active')
select page_id, p.site, p.property_type, {NAME_SQL} as property_name, {FIELDS},
  case page_id % 4 when 0 then 'apartment' when 1 then 'kodate' when 2 then 'apartment' end as invest_kind from live p join listing l on p.page_id = l.listing_id""")
def extract_listings(spark, sf):
    out = extract.extract_listings(load(spark, sf, "page"))
    return out.select("page_id", "site", "property_type", "property_name", *[c for c, _ in SPECS], "invest_kind")


# labels that a site has of its own, for some sites and types; one of them on every page, one on none
_OWN = [
    ("address", "交通", 0, "property_type = 'mansion'"), ("price_text", "築年月", 1, "site = 'building'"), ("price_text", "ない", 0, "true"),
    ("traffic", "所在地", 2, "site <> 'furniture'"), ("traffic", "備考", 1, "site = 'machinery'"), ("property_name", "種別", 0, "site = 'household'"),
]
SITE_LABELS = "\nunion all ".join(
    f"select site, property_type, '{field}' as field, '{label}' as label, {rank} as rank from (select distinct company as site, property_type from listing) k where {test}"
    for field, label, rank, test in _OWN
)
_KIND = "nullif(case page_id % 4 when 0 then '一棟アパート' when 1 then '中古一戸建て' when 2 then 'ビル' else '' end, '')"
_OWN_VALUE = {
    "property_name": f"case when p.site = 'household' then {_KIND} end", "price_text": f"case when p.site = 'building' then {_value('built_text')} end",
    "address": f"case when p.property_type = 'mansion' then {_value("coalesce(traffic, '')")} end",
    "traffic": f"coalesce(case when p.site = 'machinery' then {_value("coalesce(biko, '')")} end, case when p.site <> 'furniture' then {_value('address')} end)",
}


@query("site_labels", f"""{PAGE}, live as (select * from page where {STATUS_SQL} = 'active')
select page_id, p.site, p.property_type, {", ".join(f"coalesce({_OWN_VALUE.get(c, 'null')}, {v}) as {c}" for c, v in [("property_name", NAME_SQL), *SPECS])} from live p join listing l on p.page_id = l.listing_id""")
def site_labels(spark, sf):
    load(spark, sf, "listing").createOrReplaceTempView("listing")
    labels = stage(spark.sql(SITE_LABELS), "site-labels")
    out = extract.extract_listings(load(spark, sf, "page"), labels)
    return out.select("page_id", "site", "property_type", "property_name", *[c for c, _ in SPECS])


_PRICE, _BUILT, _NOTE = trim("price_text"), trim("built_text"), trim("coalesce(biko, '')")


@query("label_contains", f"""{PAGE} select page_id, {_PRICE} as price, {trim("coalesce(property_name, '-')")} as name, case when page_id % 5 = 0 then '後の名前' else {trim("coalesce(property_name, '-')")} end as named,
  {_BUILT} as built, cast(null as string) as built_part, coalesce({_value("built_text")}, '無関係') as built_running, {_NOTE} as note, {_PRICE} as price_asked, {_BUILT} as month from {_PAGE_JOIN}""")
def label_contains(spark, sf):
    rows = extract.label_rows(load(spark, sf, "page").select("page_id", "html"))
    pairs = F.col("pairs")
    return rows.select(
        "page_id", html.lookup(pairs, "価格").alias("price"), html.lookup(pairs, "名").alias("name"), html.lookup(pairs, "物件名").alias("named"),
        html.lookup(pairs, "築年月").alias("built"), html.lookup(pairs, "築年").alias("built_part"),
        html.lookup(pairs, "築年", "markup").alias("built_running"), html.lookup(pairs, "考").alias("note"),
        html.lookup_two_way(pairs, "販売 価格（税込）：").alias("price_asked"), html.lookup_two_way(pairs, "年月", partial=True).alias("month"),
    )


@query("page_images", f"""{PAGE}, i as (select page_id, 'http://ex.example/img/' || cast(page_id as string) || '/1.jpg' as u, 1 as pos, 'exterior' as category from page
  union all select page_id, url || '2.png?w=1', 2, 'layout' from page union all select page_id, 'http://ex.example/img/' || cast(page_id as string) || '/3.JPG', 3, 'interior' from page
  union all select page_id, 'http://cdn.ex.example/4.webp', 4, 'interior' from page union all select page_id, 'http://ex.example/img/5.jpeg', 5, 'interior' from page)
select page_id, u as image_url, category, (category <> 'interior' or pos in (3, 4)) as analysed from i""")
def page_images(spark, sf):
    rows = load(spark, sf, "page").select(F.col("page_id").alias("eval_id"), "html", "url").withColumn(
        "images", extract.clean_images(extract.page_images(html.visible_markup("html"), "url"))
    )
    rows = rows.withColumn("chosen", F.transform(screening.images_for_analysis("images"), lambda i: i["url"]))
    return upsert.image_rows(rows, keep=["chosen"]).select(
        F.col("eval_id").alias("page_id"), "image_url", "category", F.array_contains("chosen", F.col("image_url")).alias("analysed")
    )


@query("image_category", f"""
with t as (select doc_id, case doc_id % 5 when 0 then '間取図' when 1 then '建物外観' when 2 then 'リビング' when 3 then '周辺環境' else '' end as label,
  case when doc_id % 7 = 3 then '/img/LOGO/' else '/img/' end || lang || '.jpg' as url, substr(text, 1, 0) as e, text from documents),
x as (select doc_id, lower(label || chr(10) || url || ' ' || text) as s from t)
select doc_id, case when {has("s", [w.lower() for w in vocab.IMAGE_REJECT])} then null when {has("s", vocab.IMAGE_LAYOUT)} then 'layout'
  when {has("s", vocab.IMAGE_EXTERIOR)} then 'exterior' else 'interior' end as category from x""")
def image_category(spark, sf):
    n = F.col("doc_id")
    label = (
        F.when(n % 5 == 0, "間取図").when(n % 5 == 1, "建物外観").when(n % 5 == 2, "リビング").when(n % 5 == 3, "周辺環境").otherwise("")
    )
    url = F.concat(F.when(n % 7 == 3, "/img/LOGO/").otherwise("/img/"), F.col("lang"), F.lit(".jpg "), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", extract.image_category(label, url).alias("category"))


@query("json_in_text", """
with t as (select conv_id, turn, case when turn % 3 = 2 then null else '{"interior_score": ' || cast(1 + turn % 5 as string) || '.5, "plot_shape_type": "regular"' || case when conv_id % 2 = 0 then ', "maintenance_score": 2' else '' end || '}' end as j from conversations)
select conv_id, turn, coalesce(try_cast(json_extract_string(j, '$.interior_score') as double), 3.5) as interior_score, 3.5 as layout_score,
  coalesce(json_extract_string(j, '$.plot_shape_type'), 'unknown') as plot_shape_type, case when j is null then '画像なしのため判定不能' else '' end as plot_shape_description,
  coalesce(try_cast(json_extract_string(j, '$.maintenance_score') as double), 3.5) as maintenance_score, case when j is null then '画像なしのため判定不能' else '' end as maintenance_comment from t""")
def json_in_text(spark, sf):
    rows = table(spark, sf, "conversations")
    turn = F.col("turn")
    reply = F.concat(
        F.lit('{"interior_score": '), (1 + turn % 5).cast("string"), F.lit('.5, "plot_shape_type": "regular"'),
        F.when(F.col("conv_id") % 2 == 0, ', "maintenance_score": 2').otherwise(""), F.lit("}"),
    )
    body = F.translate("text", "{}", "")
    wrapped = F.when(turn % 3 == 2, body).otherwise(F.concat(body, F.lit("\n```json\n"), reply, F.lit("\n```\n"), body))
    return rows.select("conv_id", "turn", extract.analysis_reply(wrapped).alias("r")).select("conv_id", "turn", "r.*")


@query("events_json", """select event_id, try_cast(json_extract_string(props, '$.k') as int) as k from events""")
def events_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("state_urls", f"""{PAGE} select page_id, i as pos, case i when 0 then 'https://ex.example/d/' || cast(page_id as string) || '/' else 'https://ex.example/e/' end as detail_url from page, (select unnest([0, 2]) as i) x""")
def state_urls(spark, sf):
    return extract.state_detail_urls(load(spark, sf, "page").select("page_id", "html"), "https://ex.example")


@query("state_values", f"""{PAGE} select page_id, price_text as price, {trim("coalesce(biko, '')")} as note, '' as traffic from {_PAGE_JOIN}""")
def state_values(spark, sf):
    out = extract.state_values(load(spark, sf, "page").select("page_id", "html"), ["価格", "備考", "交通"])
    return out.withColumnsRenamed({"価格": "price", "備考": "note", "交通": "traffic"})


# --- errors, logs and files ------------------------------------------------------------------

@query("error_rows", f"""{cte("listing")}, r as (select *, {joined_reasons(REQUIRED)} as reasons from listing)
select sha256(url) as file, url, replace(reasons, ',', ', ') as reason, company || '_' || property_type || '_page' as company_type, strftime(input_ts, '%Y-%m-%d') as day from r where reasons <> ''""")
def error_rows(spark, sf):
    checked = quality.apply_rules(load(spark, sf, "listing"), quality.required_rules())
    _, rejected = quality.split_valid(checked)
    model = F.concat(F.initcap("company"), F.initcap("property_type"), F.lit("Page"))
    out = extract.error_rows(rejected, model, F.col("input_ts"))
    return out.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).drop("ts")


@query("error_notes", f"""{cte("crawl")} select case when user_id % 3 = 0 then 'unknown' else url end as url, case when user_id % 4 = 1 then 'unknown' else 'parse ' || property_type end as reason, event_id from crawl""")
def error_notes(spark, sf):
    note = F.concat(
        F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit("URL: "), F.col("url"), F.lit("\n"))),
        F.when(F.col("user_id") % 4 == 1, "").otherwise(F.concat(F.lit("Reason:  parse "), F.col("property_type"), F.lit(" \n"))),
        F.lit("Timestamp: 2024-01-01 00:00:00\n"),
    )
    return load(spark, sf, "crawl").select(
        logs.meta_field(note, "URL").alias("url"), logs.meta_field(note, "Reason").alias("reason"), "event_id"
    )


@query("error_pages_read", f"""{cte("listing")}, r as (select *, {joined_reasons(REQUIRED)} as reasons from listing)
select company || '_' || property_type || '_page' as company_type, sha256(url) || '.html' as file, trim(url) as url, replace(reasons, ',', ', ') as reason, strftime(input_ts, '%Y-%m-%d') as day from r where reasons <> ''""")
def error_pages_read(spark, sf):
    """The notes of the rejected rows, written as files and read back."""
    checked = quality.apply_rules(load(spark, sf, "listing"), quality.required_rules())
    _, rejected = quality.split_valid(checked)
    model = F.concat(F.initcap("company"), F.initcap("property_type"), F.lit("Page"))
    path = scratch_path(spark, "error-pages")
    logs.write_error_pages(extract.error_rows(rejected, model, F.col("input_ts")), path)
    return logs.read_error_pages(spark, path).withColumn("day", F.date_format("ts", "yyyy-MM-dd")).drop("ts")


@query("page_files", "select page_id, cast(length(html) as bigint) as n_chars, md5(html) as body from pages")
def page_files(spark, sf):
    path = scratch_path(spark, "page-files")
    n = F.col("page_id")
    given = table(spark, sf, "pages").select(F.concat((n % 10).cast("string"), F.lit("/"), n.cast("string"), F.lit(".html")).alias("file"), "html")
    pages.write_page_files(given, path)
    return pages.read_page_files(spark, path).select(
        F.regexp_extract("url", r"(\d+)\.html$", 1).cast("bigint").alias("page_id"), F.char_length("html").cast("bigint").alias("n_chars"), F.md5("html").alias("body")
    )


@query("prediction_error_file", PREDICTION_ERRORS_SQL)
def prediction_error_file(spark, sf):
    """Prediction errors, appended in two runs and read back."""
    path = scratch_path(spark, "prediction-errors")
    found = prediction_errors(spark, sf).withColumn("error_ratio", F.col("error_ratio").cast("string"))
    for part in (0, 1):
        logs.append_prediction_errors(found.filter(F.col("eval_id") % 2 == part), path)
    return spark.read.schema("eval_id bigint, error_ratio double").option("header", True).csv(path)


@query("crawl_log", f"""{cte("crawl")} select url, status, company || '_' || property_type as model, case when status = 'FAILURE' then 'value ' || cast({whole("value")} as string) end as error,
  strftime(ts, '%Y-%m-%d %H:%M:%S') as at from crawl""")
def crawl_log(spark, sf):
    rows = load(spark, sf, "crawl")
    path = scratch_path(spark, "crawl-log")
    error = F.concat(F.lit("value "), F.floor("value").cast("string"))
    entries = rows.select(*logs.crawl_log_rows(
        F.col("url"), F.col("status") == "SUCCESS", F.concat_ws("_", "company", "property_type"), error, F.col("ts")
    ))
    logs.append_crawl_log(entries, path)
    return logs.read_crawl_log(spark, path).withColumn("at", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).drop("timestamp")


@query("land_price_file", f"""{cte("land")} select prefecture, city, land_use, case when land_id % 7 = 3 then 0 else average end as average, {whole("case when land_id % 7 = 3 then 0 else average end * 0.8")} as rosenka,
  {whole("case when land_id % 7 = 3 then 0 else average end * 0.7")} as fixed_asset, coalesce(growth, 0) as growth from land where land_id % 11 <> 5""")
def land_price_file(spark, sf):
    path = scratch_path(spark, "land-file")
    n = F.col("land_id")
    load(spark, sf, "land").select(
        F.concat(F.lit(" "), F.col("prefecture")).alias("prefecture"), "city",
        F.when(n % 7 == 3, "n/a").otherwise(F.col("average").cast("string")).alias("average_land_price"),
        F.when(n % 11 == 5, "industrial").otherwise(F.col("land_use")).alias("land_use"),
        F.col("growth").cast("string").alias("land_price_growth_rate"),
    ).write.option("header", True).csv(path)
    return tables.read_land_prices(spark, path).withColumn("growth", F.col("growth").cast("double"))


@query("station_file", f"""{cte("station")} select replace(station_name, '駅', '') as station_name, railway_line, case when station_id % 9 = 2 then 0 else passenger_volume end as passenger_volume from station where station_id % 13 <> 4""")
def station_file(spark, sf):
    path = scratch_path(spark, "station-file")
    n = F.col("station_id")
    load(spark, sf, "station").select(
        F.when(n % 13 == 4, " ").otherwise(F.col("railway_line")).alias("line_name"), "station_name",
        F.when(n % 9 == 2, "不明").otherwise(F.col("passenger_volume").cast("string")).alias("passenger_volume"),
    ).write.option("header", True).csv(path)
    return tables.read_stations(spark, path)


@query("municipality_file", f"""{cte("municipality")} select prefecture, city, pop_growth, cast(income as int) as income, total_population, coalesce(income_growth, 0) as income_growth, density from municipality""")
def municipality_file(spark, sf):
    path = scratch_path(spark, "municipality-file")
    load(spark, sf, "municipality").select(
        "prefecture", "city", F.col("pop_growth").alias("population_growth_rate"), F.col("income").alias("average_income"),
        "total_population", F.col("income_growth").alias("income_growth_rate"), F.col("density").alias("population_density"),
    ).write.option("header", True).csv(path)
    out = tables.read_municipalities(spark, path)
    return out.withColumns({c: F.col(c).cast("double") for c in ("pop_growth", "income_growth", "density")})


@query("trade_file", f"""{cte("trade")} select City, Use, TradePrice, Area, count(*) as n from trade group by 1, 2, 3, 4""")
def trade_file(spark, sf):
    path = scratch_path(spark, "trade-file")
    load(spark, sf, "trade").select(F.array(F.struct("City", "Use", "TradePrice", "Area")).alias("data")).write.json(path)
    found = tables.read_trades(spark, path, multi_line=False)
    return found.groupBy("City", "Use", "TradePrice", "Area").agg(F.count(F.lit(1)).alias("n"))


@query("statistics_cells", f"""{cte("municipality")} select prefecture || city as area, pop_growth, cast(income as double) as income, density from municipality""")
def statistics_cells(spark, sf):
    rows = load(spark, sf, "municipality").select(F.concat("prefecture", "city").alias("area"), "pop_growth", "income", "density")
    cells = rows.unpivot(
        ["area"], [F.col("pop_growth").cast("double").alias("A01"), F.col("income").cast("double").alias("A02"), F.col("density").cast("double").alias("A03")],
        "item", "value",
    )
    return tables.pivot_cells(cells, {"A01": "pop_growth", "A02": "income", "A03": "density"})


@query("decoded_pages", """select page_id, length(html) as n_chars, md5(html) as body from pages""")
def decoded_pages(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.encode("html", "utf-8").alias("content"))
    # a wrong charset is declared for every second page
    charset = F.when(F.col("page_id") % 2 == 0, "ascii").otherwise("utf-8")
    return rows.select("page_id", extract.decode_page("content", charset).alias("html")).select(
        "page_id", F.char_length("html").cast("bigint").alias("n_chars"), F.md5("html").alias("body")
    )
