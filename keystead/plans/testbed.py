"""Listing data derived from the given tables, in SQL both engines run.

There is no property data to test on.  These views make listings, evaluations
and public statistics out of the given tables, one listing per order, so that a
query over them grows with the tables.  The text is plain SQL that Spark and
DuckDB read alike; ``cte`` puts it in front of a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keystead.session import stage

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

PREFS = ["東京都", "神奈川県", "千葉県", "埼玉県", "京都府"]
CITIES = [
    ["世田谷区", "町田市", "八王子市", "港区", "新宿区"],
    ["横浜市中区", "川崎市中原区", "藤沢市", "鎌倉市", "相模原市緑区"],
    ["市川市", "船橋市", "千葉市美浜区", "市原市", "柏市"],
    ["さいたま市浦和区", "川口市", "所沢市", "川越市", "越谷市"],
    ["京都市中京区", "宇治市", "亀岡市", "長岡京市", "京都市左京区"],
]
STATIONS = ["成城学園前", "三鷹", "調布", "日吉", "新宿", "久我山", "横浜", "浦和", "西宮北口", "烏丸"]
TYPES = ["mansion", "kodate", "apartment", "tochi"]


def pick(expr: str, values: list[str | None]) -> str:
    """CASE over small whole numbers."""
    arms = " ".join(
        f"when {i} then " + ("cast(null as string)" if v is None else f"'{v}'") for i, v in enumerate(values)
    )
    return f"(case {expr} {arms} end)"


def _city_case() -> str:
    # nation keys go round the regions, five to a region
    return pick("n_nationkey", [CITIES[k % 5][k // 5] for k in range(25)])


PLACE_SQL = f"""
select n_nationkey, n_regionkey,
  {pick("n_regionkey", PREFS)} as prefecture,
  {_city_case()} as city
from nation
"""

_SEQ = """
select o_orderkey as k, cast(floor(o_orderkey / 4) as bigint) as q,
  o_orderdate, o_totalprice, o_orderstatus, o_orderpriority,
  prefecture, city, lower(c_mktsegment) as company
from orders join customer on o_custkey = c_custkey join place on c_nationkey = n_nationkey
"""

_FACTS = f"""
select s.*,
  {pick("k % 4", TYPES)} as property_type,
  cast(floor(o_totalprice) as bigint) * 1000 as price_yen,
  cast(floor(floor(o_totalprice) / 10) as bigint) as man,
  200 + (k * 37) % 1300 as senyu_t,
  500 + (k * 53) % 2500 as tochi_t,
  400 + (k * 41) % 1600 as tatemono_t,
  cast(year(o_orderdate) - q % 45 as int) as by_,
  cast(month(o_orderdate) as int) as bm_,
  1 + (k * 3) % 9 as chome, 1 + (k * 7) % 29 as ban, 1 + (k * 11) % 19 as go,
  2 + (k * 13) % 18 as walk,
  {pick("(k * 7) % 10", STATIONS)} as st,
  {pick("(k * 3 + 1) % 10", STATIONS)} as st2
from seq s
"""

_MAN_TEXT = """case
  when man >= 10000 and man % 10000 = 0 then cast(cast(floor(man / 10000) as bigint) as string) || '億円'
  when man >= 10000 and man % 10000 >= 1000 then cast(cast(floor(man / 10000) as bigint) as string) || '億'
    || cast(cast(floor(man % 10000 / 1000) as bigint) as string) || ',' || lpad(cast(man % 1000 as string), 3, '0') || '万円'
  when man >= 10000 then cast(cast(floor(man / 10000) as bigint) as string) || '億' || cast(man % 10000 as string) || '万円'
  when man >= 1000 then cast(cast(floor(man / 1000) as bigint) as string) || ',' || lpad(cast(man % 1000 as string), 3, '0') || '万円'
  else cast(man as string) || '万円' end"""


def _tenths(c: str) -> str:
    return f"cast(cast(floor({c} / 10) as bigint) as string) || '.' || cast({c} % 10 as string) || '㎡'"


_FULL = "translate({}, '0123456789', '０１２３４５６７８９')"
_KANJI = "translate({}, '123456789', '一二三四五六七八九')"

LISTING_SQL = f"""
select k as listing_id, k as property_id, company, property_type,
  'http://ex.example/' || property_type || '/' || cast(k as string) || '/' as url,
  case when q % 23 = 7 then 'パーク' || cast(k as string) || 'の中古マンション'
    when q % 31 = 5 then 'A' when q % 37 = 3 then '' when q % 41 = 2 then cast(null as string)
    when q % 43 = 1 then '一棟アパート  ' || cast(k as string)
    else 'パークハイツ' || cast(k as string) end as property_name,
  case when q % 53 = 4 then cast(0 as bigint) when q % 59 = 6 then cast(null as bigint) else price_yen end as price_yen,
  case when q % 19 = 3 then '-' when q % 29 = 4 then '価格未定' when q % 47 = 1 then ''
    when q % 13 = 5 then {_FULL.format(f"({_MAN_TEXT})")}
    when q % 13 = 6 then ' ' || ({_MAN_TEXT}) || '（税込）'
    else {_MAN_TEXT} end as price_text,
  case when q % 17 = 2 then cast(price_yen as string)
    when q % 17 = 3 then '億5000万円' when q % 17 = 4 then '0円'
    else {_MAN_TEXT} end as invest_price_text,
  case when q % 11 = 4 then '' when q % 11 = 7 then '-' else
    (case when q % 7 = 3 then '' else prefecture end) || city ||
    {pick("k % 6", ["中央", "本町", "緑ケ丘", "桜台", "三番町", "センター北"])} ||
    (case q % 5
      when 0 then cast(chome as string) || '丁目' || cast(ban as string) || '番' || cast(go as string) || '号'
      when 1 then {_FULL.format("cast(chome as string)")} || '丁目' || {_FULL.format("cast(ban as string)")} || '−' || {_FULL.format("cast(go as string)")}
      when 2 then {_KANJI.format("cast(chome as string)")} || '丁目' || cast(ban as string) || '番地' || cast(go as string)
      when 3 then cast(chome as string) || '-' || cast(ban as string) || '-' || cast(go as string)
      else ' ' || cast(chome as string) || '丁目　' || cast(ban as string) || '番の' || cast(go as string) end)
  end as address,
  prefecture as address1, city as address2,
  case when q % 27 = 4 then cast(null as string) when q % 27 = 9 then '' else
  (case q % 9
    when 0 then '小田急線 『' || st || '』駅 徒歩' || cast(walk as string) || '分'
    when 1 then 'JR中央線 ' || st || '駅 徒歩' || cast(walk as string) || '分 / 京王線 ' || st2 || '駅 バス10分 停歩3分'
    when 2 then '東急東横線「' || st || '」徒歩' || cast(walk as string) || '分'
    when 3 then 'JR山手線　' || st || '駅　徒歩' || cast(walk as string) || '分　都営大江戸線　' || st2 || '駅　徒歩5分'
    when 4 then '京王井の頭線 / ' || st || '駅 / 徒歩' || cast(walk as string) || '分'
    when 5 then '阪急線 ' || st || ' 徒歩' || {_FULL.format("cast(walk as string)")} || '分、京阪線 ' || st2 || '駅 徒歩9分'
    when 6 then st || '駅' || chr(10) || '徒歩' || cast(walk as string) || '分'
    when 7 then '西武線・' || st || '駅・徒歩' || cast(walk as string) || '分'
    else 'バス' || cast(walk as string) || '分 ' || st || '停 停歩' || cast(1 + walk % 5 as string) || '分' end) end as traffic,
  case when property_type = 'mansion' then {_tenths("senyu_t")} end as senyu_menseki_text,
  case when property_type = 'mansion' and q % 21 <> 8 then senyu_t / 10e0 end as senyu_menseki,
  case when property_type <> 'mansion' then (case when q % 9 = 4 then '約' else '' end) || {_tenths("tochi_t")} end as tochi_menseki_text,
  case when property_type <> 'mansion' and q % 33 <> 8 then tochi_t / 10e0 end as tochi_menseki,
  case when property_type in ('kodate', 'apartment') then {_tenths("tatemono_t")} || '（壁芯）' end as tatemono_menseki_text,
  case when property_type in ('kodate', 'apartment') then
    (case when q % 39 = 2 then 3.5e0 when q % 39 = 3 then 12e0 else tatemono_t / 10e0 end) end as tatemono_menseki,
  case q % 9
    when 0 then (case when by_ >= 1989 then '平成' || cast(by_ - 1988 as string) else '昭和' || cast(by_ - 1925 as string) end)
      || '年' || cast(bm_ as string) || '月'
    when 1 then cast(by_ as string) || '/' || cast(bm_ as string)
    when 2 then '築' || cast(3 + k % 40 as string) || '年' when 3 then '不詳' when 4 then ''
    when 5 then cast(by_ as string) || '-' || lpad(cast(bm_ as string), 2, '0') || '-01'
    when 6 then (case when by_ >= 1989 then '平成元年' else '昭和年' end)
    else cast(by_ as string) || '年' || cast(bm_ as string) || '月' end as built_text,
  case when q % 3 = 1 then make_date(by_, bm_, 1) end as built,
  {pick("(q * 5) % 8", ["RC造", "鉄骨鉄筋コンクリート造", "木造2階建", "軽量鉄骨造", "重量鉄骨造", "SRC造", None, "ＲＣ造"])} as kouzou,
  {pick("(q * 3) % 7", ["所有権", "借地権（賃借権）", "底地", "定期借地権50年", "旧法借地", "所有権", None])} as tochikenri,
  {pick("(q * 7) % 10", ["再建築不可", "旗竿地です", "不整形", "市街化調整区域内", "セットバック約3.5㎡要", "", None, "12.5㎡のセットバックあり", "路地状部分あり", "None  あり"])} as biko,
  {pick("(q * 7) % 6", ["200%", "150", "第一種低層住居専用地域", "400％", "近隣商業地域", None])} as youseki_text,
  {pick("(q * 5) % 4", ["60%", "50", "八〇", None])} as kenpei_text,
  {pick("(q * 11) % 6", ["60%・200%", "建ぺい率60%容積率200%", "50／100", "80%/400%", "第一種住居", None])} as ratio_text,
  {pick("(q * 5) % 7", ["南東4m(公道)接面5.1m", "北側 約6.5m 私道 間口 約8.2m", "角地 東3.2m(公道)", "二方道路 幅員 5m", "西17.2ｍ(公道)接面2m", None, "北 5.0m 間口1.8m"])} as setsudou,
  case when q % 9 = 5 then 3e0 + (k % 5) when q % 9 = 6 then 0e0 end as road_width,
  case when q % 8 = 3 then 1.5e0 + (k % 9) when q % 8 = 4 then 0e0 end as maguchi,
  {pick("(q * 3) % 5", ["第一種低層住居専用地域", "商業地域", "準工業地域", "市街化調整区域", None])} as youto_chiiki,
  5000 + (k % 200) * 100 as kanrihi, 3000 + (k % 150) * 90 as syuzen,
  cast(5000 + (k % 200) * 100 as string) || '円' as kanrihi_text,
  case when property_type = 'apartment' and q % 4 <> 3 then (30 + k % 90) / 10e0 when property_type = 'apartment' and q % 8 = 3 then 0e0 end as gross_yield,
  '約' || cast((30 + k % 90) / 10e0 as string) || '％' as gross_yield_text,
  case when property_type = 'apartment' and q % 3 = 0 then cast(floor(price_yen * (40 + k % 60) / 1000) as bigint) end as annual_rent,
  case q % 5 when 0 then cast(man as string) || '万円' when 1 then cast(price_yen as string) || '円' when 2 then '-' when 3 then '' else '応相談' end as rent_text,
  {pick("q % 6", ["3階", "地上10階 地下1階 5階部分", "１２階建", "2階／地上5階建", None, "平屋"])} as floor_text,
  {pick("q % 5", ["1LDK", "2LDK  ", "none", " 3DK", None])} as madori,
  o_orderdate as input_ts, cast(o_orderdate as date) as input_date
from facts
"""

EVALUATION_SQL = """
select k + 1 as eval_id,
  'http://ex.example/' || property_type || '/' || cast(k as string) || '/' as property_url,
  company,
  case when property_type = 'apartment' and q % 2 = 0 then 'investmentapartment'
    when property_type = 'kodate' and q % 5 = 0 then 'invest_kodate' else property_type end as property_type,
  k as property_id,
  case when q % 7 = 6 then cast(null as bigint) else cast(floor(man * (70 + k % 80) / 100) as bigint) end as pred1,
  case when q % 7 = 6 or q % 5 = 4 then cast(null as bigint) when q % 61 = 1 then cast(0 as bigint)
    else cast(floor(man * (75 + k % 60) / 100) as bigint) end as pred2,
  (k % 80) >= 30 as is_first_stage_passed,
  case when q % 4 = 1 then cast(null as double) else 1e0 + (k % 9) / 2e0 end as interior_score,
  case when q % 4 = 1 then cast(null as double) else 1e0 + (k % 7) / 2e0 end as layout_score,
  case when q % 11 = 3 then cast(null as double) when q % 11 = 4 then 0e0 else (k * 17 % 1000) / 10e0 end as investment_score,
  case when property_type = 'apartment' and q % 6 <> 1 then (k * 29 % 1000) / 10e0 end as total_investment_score,
  case q % 5 when 0 then 'pending' when 1 then 'processing' when 4 then 'failed' else 'completed' end as analysis_status,
  o_orderdate as analyzed_at,
  q % 9 = 2 as is_notified,
  case when q % 37 = 5 then k - 3 end as duplicate_of
from facts
"""

MUNICIPALITY_SQL = """
select prefecture,
  case when n_nationkey % 8 = 7 then city || '（旧）' else city end as city,
  ((n_nationkey * 37) % 50 - 20) / 10e0 as pop_growth,
  500 + (n_nationkey * 113) % 600 as income,
  case when n_nationkey % 6 = 5 then cast(null as bigint) else cast(50000 + (n_nationkey * 9973) % 400000 as bigint) end as total_population,
  case when n_nationkey % 5 = 3 then cast(null as double) else ((n_nationkey * 11) % 40 - 15) / 10e0 end as income_growth,
  case when n_nationkey % 7 = 3 then cast(null as double) else 500e0 + (n_nationkey * 977) % 9000 end as density
from place
"""

HAZARD_SQL = """
select prefecture, case when n_nationkey % 9 = 4 then city || '（旧）' else city end as city,
  n_nationkey % 4 as flood, n_nationkey % 3 as landslide
from place
"""

STATION_SQL = f"""
select p_partkey as station_id,
  {pick("p_partkey % 8", STATIONS[:8])} || (case when p_partkey % 3 = 0 then '駅' else '' end) as station_name,
  p_brand || '線' as railway_line,
  cast(1000 + p_size * 997 + p_partkey % 500 as bigint) as passenger_volume
from part
"""

ZONE_SQL = f"""
select p_partkey as zone_id,
  {pick("p_partkey % 7", ["第一種低層住居専用地域", "第二種低層住居専用地域", "第一種住居地域", "近隣商業地域", "商業地域", "準工業地域", "工業専用地域"])} as zone_name,
  cast(40 + p_size % 5 * 10 as int) as max_kenpei, cast(100 + p_size % 8 * 50 as int) as max_youseki
from part
"""

TRADE_SQL = """
select prefecture,
  case when l_linenumber = 7 and l_returnflag = 'R' then '' else ' ' || city || ' ' end as City,
  case when l_suppkey % 5 = 0 then '商業地' when l_suppkey % 5 = 1 then '店舗・事務所' when l_suppkey % 5 = 2 then '工業地'
    else '住宅地' end as Use,
  case when l_linenumber = 6 and l_returnflag = 'N' then '非公開' else cast(cast(floor(l_extendedprice * 1000) as bigint) as string) end as TradePrice,
  case when l_linenumber = 5 and l_returnflag = 'A' then '2000㎡以上' else cast(cast(l_quantity as int) as string) || '㎡' end as Area
from lineitem join supplier on l_suppkey = s_suppkey join place on s_nationkey = n_nationkey
"""

LAND_SQL = """
select n_nationkey * 2 + u as land_id, prefecture,
  case when n_nationkey % 10 = 9 or (n_nationkey % 7 = 6 and u = 1) then city || '（旧）' else city end as city,
  case when u = 0 then 'residential' else 'commercial' end as land_use,
  cast(100000 + (n_nationkey * 7919 + u * 104729) % 700000 as bigint) as average,
  case when (n_nationkey + u) % 6 = 2 then cast(null as bigint) else cast(80000 + (n_nationkey * 7919 + u * 104729) % 500000 as bigint) end as rosenka,
  cast(70000 + (n_nationkey * 7919 + u * 104729) % 450000 as bigint) as fixed_asset,
  case when (n_nationkey + u) % 4 = 1 then cast(null as double) else ((n_nationkey * 13 + u * 7) % 60 - 20) / 10e0 end as growth
from (select *, 0 as u from place union all select *, 1 as u from place) uses
"""

CRAWL_SQL = """
select event_id, cast(ts as timestamp) as ts, user_id,
  'site' || cast(user_id % 6 as string) as company,
  case event_type when 'view' then 'mansion' when 'click' then 'kodate' when 'purchase' then 'tochi' when 'signup' then 'apartment' else 'invest_kodate' end as property_type,
  'http://ex.example/' || cast(user_id as string) || '/' || cast(cast(floor(value) as bigint) as string) as url,
  case when event_type = 'error' then 'FAILURE' else 'SUCCESS' end as status,
  value, props
from events
"""

# the first route by a short pattern, good and bad values alike
STRICT_SQL = """
select listing_id, property_type, property_name, price_yen, address, address1,
  case when listing_id % 67 = 3 then '' else address2 end as address2,
  regexp_extract(traffic, '^([^「『 　/]*)', 1) as railway1,
  regexp_extract(traffic, '([^ 　]+)駅', 1) as station1,
  try_cast(regexp_extract(traffic, '徒歩([0-9]+)分', 1) as int) as walk_min1,
  senyu_menseki, tochi_menseki, built_text
from listing
"""

SITED_SQL = """
select *, regexp_extract(traffic, '([^ 　『「・、/]+)』?駅', 1) as station1,
  try_cast(regexp_extract(traffic, '徒歩([0-9]+)分', 1) as int) as walk_min1
from listing
"""

RATIO_ROWS_SQL = """
select listing_id, case when listing_id % 7 = 1 then '' else ratio_text end as kenpei_text, youseki_text,
  case when listing_id % 3 = 0 then 55e0 end as kenpei, case when listing_id % 2 = 0 then 210e0 end as youseki
from listing
"""

ROUTE_ROWS_SQL = """
select listing_id, traffic, case when listing_id % 3 = 0 then '既存線' end as railway1,
  '既存' as station1, cast(99 as int) as walk_min1
from listing
"""

CODED_SQL = f"""
select eval_id, case when eval_id % 2 = 0 then 'unknown' else company end as company,
  {pick("eval_id % 6", ["mitsui", "sumai1", "Sumifu", "other", "keio", "homes"])} || property_type as property_type
from evaluation
"""

# every listing and a later copy of it: other price and area within tolerance,
# kanji digits in the address, and for every third copy a room number added
COPIES_SQL = """
select 2 * listing_id as eval_id, url, property_type, address, senyu_menseki, tatemono_menseki,
  price_yen, built, built_text from listing
union all
select 2 * (listing_id + 37) + 1 as eval_id, url || 'copy' as url, property_type,
  translate(address, '123456789', '一二三四五六七八九') || case when listing_id % 3 = 0 and address <> '' then '１０１' else '' end as address,
  senyu_menseki * 1.002e0 as senyu_menseki, tatemono_menseki * (case when listing_id % 5 = 0 then 1.02e0 else 1.004e0 end) as tatemono_menseki,
  cast(floor(price_yen * (case when listing_id % 4 = 1 then 1.05e0 else 1.005e0 end)) as bigint) as price_yen,
  built, built_text from listing
"""

# a stored page per listing, with every shape of label and link
PAGE_SQL = """
select listing_id as page_id, company as site, property_type, url,
  '<!DOCTYPE html><html><head><title>' || (case when listing_id % 17 = 3 then '掲載終了物件' when listing_id % 17 = 5 then 'サーバーが混み合っています'
    else coalesce(property_name, '') || ' | 詳細' end) || '</title><link rel="canonical" href="https://ex.example/list/' || property_type
  || (case listing_id % 4 when 0 then '?page=' || cast(listing_id % 30 as string) || '&amp;sort=new' when 1 then '' when 2 then '?sort=old&amp;page=x' else '?area=13#top' end) || '"></head><body>'
  || '<!-- <a href="/mansion/1/">x</a> <table><tr><th>物件名</th><td>ない</td></tr></table> -->'
  || '<div class="breadcrumb"><ul><li>TOP</li><li>' || (case when listing_id % 3 = 0 then '物件詳細' else address2 || '</li><li>' || property_type end) || '</li></ul></div>'
  || '<h1 class="t">' || coalesce(property_name, '') || '<small> 中古 </small></h1>'
  || '<table><tr><th>' || (case when listing_id % 5 = 0 then '建物名' else '物件名' end) || '</th><td> ' || coalesce(property_name, '-') || ' </td></tr>'
  || '<tr><th>' || (case when listing_id % 2 = 0 then '価格：' else '販売価格' end) || '</th><td><b>' || price_text || '</b></td></tr>'
  || '<tr><th>所在地</th><td>' || address || '<br></td><th>交通</th><td>' || coalesce(traffic, '') || '</td></tr>'
  || '<tr><td class="table-header">築年月</td><td class="table-data">' || built_text || '</td></tr>'
  || '<tr><td>無関係</td><td>' || property_type || '</td></tr></table>'
  || '<dl><dt>物件名</dt><dd>後の名前</dd><dt>備考</dt><dd>' || coalesce(biko, '') || '</dd><dt>種別</dt><dd>'
  || (case listing_id % 4 when 0 then '一棟アパート' when 1 then '中古一戸建て' when 2 then 'ビル' else '' end) || '</dd></dl>'
  || '<img src="/img/' || cast(listing_id as string) || '/1.jpg" alt="外観"><img data-src="2.png?w=1" title="間取図"><img src="/img/logo.gif" alt="ロゴ">'
  || '<img src="/img/' || cast(listing_id as string) || '/3.JPG" alt=" リビング "><img src="/img/' || cast(listing_id as string) || '/1.jpg" alt="重複"><img src="/img/map.webp" alt="周辺">'
  || '<img alt="寝室" data-lazy="//cdn.ex.example/4.webp"><img src="/img/5.jpeg" alt="キッチン">'
  || '<a class="n" href="/mansion/' || cast(listing_id as string) || '/">詳細</a><a href="/kodate/' || cast(listing_id % 100 as string) || '?x=1&amp;y=2">戸建</a><a href="/kodate/' || cast(listing_id % 100 as string) || '?x=3">戸建</a><a name="here">印</a>'
  || (case when listing_id % 6 = 1 then '<a href="?page=9">次へ</a>' else '' end)
  || '<script>list.push({' || chr(39) || 'number' || chr(39) || ': ' || chr(39) || 'B' || cast(listing_id as string) || chr(39) || '});list.push({' || chr(39) || 'number' || chr(39) || ':' || chr(39) || 'A1' || chr(39) || '});</script>'
  || '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"propertyList":[{"detailUrl":"/d/' || cast(listing_id as string) || '/"},{"detailUrl":""},{"detailUrl":"/e/"}],'
  || '"summary":{"tableItems":[{"title":"' || (case when listing_id % 2 = 0 then '価格' else '販売価格' end) || '","data":{"text":"' || price_text || '"}},{"title":"備考","data":{"html":"<p>' || coalesce(biko, '') || '</p>"}}]}}}}</script>'
  || (case when listing_id % 19 = 4 then '<p>お探しの物件は、掲載が終了しました</p>' else '' end) || '</body></html>' as html
from listing
"""

# every view with the views and tables it stands on
VIEWS: dict[str, tuple[str, list[str]]] = {
    "place": (PLACE_SQL, ["nation"]),
    "seq": (_SEQ, ["orders", "customer", "place"]),
    "facts": (_FACTS, ["seq"]),
    "listing": (LISTING_SQL, ["facts"]),
    "evaluation": (EVALUATION_SQL, ["facts"]),
    "municipality": (MUNICIPALITY_SQL, ["place"]),
    "hazard": (HAZARD_SQL, ["place"]),
    "station": (STATION_SQL, ["part"]),
    "zone": (ZONE_SQL, ["part"]),
    "trade": (TRADE_SQL, ["lineitem", "supplier", "place"]),
    "land": (LAND_SQL, ["place"]),
    "crawl": (CRAWL_SQL, ["events"]),
    "strict": (STRICT_SQL, ["listing"]),
    "sited": (SITED_SQL, ["listing"]),
    "ratio_rows": (RATIO_ROWS_SQL, ["listing"]),
    "route_rows": (ROUTE_ROWS_SQL, ["listing"]),
    "coded": (CODED_SQL, ["evaluation"]),
    "copies": (COPIES_SQL, ["listing"]),
    "page": (PAGE_SQL, ["listing"]),
}


def _needed(names: list[str]) -> list[str]:
    out: list[str] = []

    def add(name: str) -> None:
        for parent in VIEWS.get(name, ("", []))[1]:
            add(parent)
        if name not in out:
            out.append(name)

    for name in names:
        add(name)
    return out


def cte(*names: str) -> str:
    """WITH clause that defines the views."""
    return "with " + ",\n".join(f"{n} as ({VIEWS[n][0].strip()})" for n in _needed(list(names)) if n in VIEWS)


# tables with a row per listing, page, text or event
FACTS = {"orders", "lineitem", "events", "documents", "pages", "conversations"}

# lazy handles per session and folder, so that footers and view texts are read once
_HANDLES: dict[tuple[str, str, str], DataFrame] = {}


def _handle(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _HANDLES:
        _HANDLES[key] = make(spark, sf_dir, name)
    return _HANDLES[key]


DEALT_ROWS = 100_000  # rows of a dealt fact table a partition has
PAGE_ROWS = 20_000  # pages a task writes: some 50 MB of text


def _dealt(df: DataFrame, rows: int, each: int) -> DataFrame:
    """Rows in partitions of ``each`` or fewer, as many for every core, one at least.

    The cores known so far may be fewer than the job gets, the rows are not.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * max(1, -(-rows // (each * cores))))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in FACTS:
        return df
    cores, splits = spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    # a split without the start of a row group is empty; counts come from the footers
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    if splits < cores or max(sizes, default=0) * cores > 2 * sum(sizes):
        df = _dealt(df, sum(sizes), DEALT_ROWS)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables.

    A fact table that comes as fewer splits than there are cores (a small file is
    one split), or with most of its rows in a few of them (a file of few row groups),
    is dealt out; any other is left as it is read.
    """
    return _handle(spark, sf_dir, name, _read)


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for t in _needed([name]):
        if t in TABLES:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    if name != "page":
        return spark.sql(f"{cte(name)} select * from {name}")
    # pages are stored, as a crawl leaves them; their facts are dealt out before the text,
    # some twenty times as wide, is made
    rows = table(spark, sf_dir, "orders").count()
    _dealt(spark.sql(f"{cte('facts')} select * from facts"), rows, PAGE_ROWS).createOrReplaceTempView("facts")
    return stage(spark.sql(f"with listing as ({LISTING_SQL}), page as ({PAGE_SQL}) select * from page"), "pages")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the given tables."""
    return _handle(spark, sf_dir, name, _view)
