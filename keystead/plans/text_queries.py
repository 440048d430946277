"""Queries over raw listing text: one typed column (or a few) per query."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystead import vocab
from keystead.functions import address, dates, measure, money, road, text, traffic, urls
from keystead.plans.registry import SPACE, asc, first_of, has, num, query, rex, trim, values, whole
from keystead.plans.testbed import cte, load, table

LISTING = cte("listing")


def listing(spark, sf):
    return load(spark, sf, "listing")


def date_text(c):
    return F.date_format(c, "yyyy-MM-dd")


# --- prices ---------------------------------------------------------------------

_W = f"regexp_replace({asc('price_text')}, '[, ]', '', 'g')"


@query("price_parse", f"""{LISTING}, t as (
  select listing_id, price_text, {_W} as w from listing),
p as (select *, split_part(w, '億', 1) as head, split_part(w, '億', 2) as tail, contains(w, '億') as oku from t),
n as (select *,
  case when regexp_matches(head, '^[0-9]+([.][0-9]+)?$') then {whole("try_cast(head as double) * 10000")} end as a,
  coalesce({whole(num("case when oku then tail else w end", "([0-9]+(?:[.][0-9]+)?)"))}, 0) as b from p)
select listing_id, case when price_text is null or price_text in ('', '-') then null
  when oku then (a + b) * 10000 else b * 10000 end as price_yen from n""")
def price_parse(spark, sf):
    return listing(spark, sf).select("listing_id", money.price_yen("price_text").alias("price_yen"))


_IW = f"replace({asc('invest_price_text')}, ',', '')"


def _digits(x):
    return f"try_cast(nullif(regexp_replace({x}, '[^0-9]', '', 'g'), '') as bigint)"


@query("invest_price_parse", f"""{LISTING}, t as (select listing_id, {_IW} as w from listing),
p as (select *, contains(w, '億') as oku, case when contains(w, '億') then split_part(w, '億', 2) else w end as r from t),
n as (select *,
  case when oku then {_digits("split_part(w, '億', 1)")} * 100000000 else 0 end as a,
  case when contains(r, '万') then (case when split_part(r, '万', 1) = '' then 0 else {_digits("split_part(r, '万', 1)")} * 10000 end)
    when oku then 0 else coalesce({_digits("r")}, 0) end as b from p)
select listing_id, cast(nullif(a + b, 0) as bigint) as price_yen from n""")
def invest_price_parse(spark, sf):
    return listing(spark, sf).select("listing_id", money.investment_price_yen("invest_price_text").alias("price_yen"))


def _yen(x):
    return f"""case when {x} is null or {x} in ('', '-') then null else coalesce({_digits(asc(x))}, 0) end"""


@query("rent_parse", f"""{LISTING}
select listing_id, {_yen("kanrihi_text")} as fee_yen,
  case when regexp_matches(rent_text, '[万億]') then 10000 * {whole(num(asc("regexp_replace(rent_text, '[, ]', '', 'g')"), "([0-9]+)"))}
    else {_yen("rent_text")} end as rent_yen,
  coalesce({whole("annual_rent / 12")}, 0) as monthly_rent from listing""")
def rent_parse(spark, sf):
    return listing(spark, sf).select(
        "listing_id", money.yen("kanrihi_text").alias("fee_yen"), money.rent_yen("rent_text").alias("rent_yen"),
        money.monthly_rent("annual_rent").alias("monthly_rent"),
    )


_UNIT = "cast({} as decimal(18,3)) / cast(senyu_menseki as decimal(18,3))"


@query("yield_and_fees", f"""{LISTING}
select listing_id,
  try_cast(nullif(regexp_replace(gross_yield_text, '[^0-9.]', '', 'g'), '') as double) as yield_pct,
  {num("gross_yield_text", "([0-9]+(?:[.][0-9]+)?)")} as yield_2dp,
  case when senyu_menseki > 0 then least(floor(kanrihi * 1000 / cast(round(senyu_menseki * 10) as bigint) * 10 + 0.5) / 1000, 9999.999) else 0 end as fee_per_m2,
  case when tochi_menseki > 0 and maguchi > 0 then round(tochi_menseki / maguchi, 1) end as depth_1dp,
  coalesce({num("gross_yield_text", "([0-9.]+)")}, 0.0) as number_any
from listing""")
def yield_and_fees(spark, sf):
    return listing(spark, sf).select(
        "listing_id", money.yield_pct("gross_yield_text").alias("yield_pct"),
        money.yield_pct_2dp("gross_yield_text").cast("double").alias("yield_2dp"),
        money.fee_per_area("kanrihi", "senyu_menseki").cast("double").alias("fee_per_m2"),
        F.round(F.col("tochi_menseki") / F.when(F.col("maguchi") > 0, F.col("maguchi")), 1).alias("depth_1dp"),
        measure.number_or("gross_yield_text", 0.0).alias("number_any"),
    )


# half-even rounding at the last digit, by whole-number arithmetic
def _half_even(n: str, d: str, scale: int) -> str:
    """round-half-even of n/d (whole numbers) at a scale."""
    q, r = f"(({n}) * {scale}) // ({d})", f"(({n}) * {scale}) % ({d})"
    return f"(({q}) + case when 2 * ({r}) > ({d}) or (2 * ({r}) = ({d}) and ({q}) % 2 = 1) then 1 else 0 end) / {scale}e0"


@query("half_even_units", f"""{LISTING}, t as (
  select listing_id, cast(round(senyu_menseki * 10) as bigint) as s10, kanrihi, syuzen,
    cast(round(tochi_menseki * 10) as bigint) as t10, cast(round(maguchi * 10) as bigint) as m10 from listing)
select listing_id,
  case when s10 > 0 then {_half_even("kanrihi * 10", "s10", 1000)} end as kanrihi_per_m2,
  case when s10 > 0 then {_half_even("syuzen * 10", "s10", 1000)} end as syuzen_per_m2,
  case when m10 > 0 then {_half_even("t10", "m10", 100)} end as depth_m from t""")
def half_even_units(spark, sf):
    return listing(spark, sf).select(
        "listing_id", money.fee_per_area_even("kanrihi", "senyu_menseki").cast("double").alias("kanrihi_per_m2"),
        money.fee_per_area_even("syuzen", "senyu_menseki").cast("double").alias("syuzen_per_m2"),
        measure.depth_m("tochi_menseki", "maguchi").cast("double").alias("depth_m"),
    )


# --- areas, numbers ----------------------------------------------------------------

def _area(x):
    return num(f"split_part(replace({x}, ',', ''), '㎡', 1)", "([0-9.]+)")


@query("area_parse", f"""{LISTING}
select listing_id, {_area("senyu_menseki_text")} as senyu, {_area("tochi_menseki_text")} as tochi,
  {_area("tatemono_menseki_text")} as tatemono from listing""")
def area_parse(spark, sf):
    return listing(spark, sf).select("listing_id", *[
        measure.area_m2(f"{n}_menseki_text").cast("double").alias(n) for n in ("senyu", "tochi", "tatemono")
    ])


@query("floor_parse", f"""{LISTING}, t as (select listing_id, floor_text, {asc("floor_text")} as f from listing)
select listing_id,
  case when floor_text <> '' then coalesce(try_cast({rex("f", "([0-9]+)")} as bigint), 0) end as first_int,
  try_cast({rex("f", "([0-9]+)階")} as int) as floor, try_cast({rex("f", "地上([0-9]+)階")} as int) as above,
  try_cast({rex("f", "地下([0-9]+)階")} as int) as below from t""")
def floor_parse(spark, sf):
    f = measure.floors("floor_text")
    return listing(spark, sf).select(
        "listing_id", measure.first_int("floor_text").alias("first_int"), f["floor"].alias("floor"),
        f["above"].alias("above"), f["below"].alias("below"),
    )


def _limit(x):
    a = asc(x)
    bare = num(a, "([0-9]+(?:[.][0-9]+)?)")
    return f"coalesce({num(a, '([0-9]+(?:[.][0-9]+)?)[ ]*%')}, case when {bare} between 10 and 1000 then {bare} end)"


def _ratio_part(i):
    p = f"string_split_regex(ratio_text, '[・/]')"  # noqa: F541
    return f"case when len({p}) >= 2 and contains({p}[{i}], '%') then {rex(f'{p}[{i}]', '([0-9]+)')} end"


_LABELLED = "regexp_matches(ratio_text, '建ぺい率|容積率')"


@query("ratio_split", f"""{LISTING}
select listing_id, {num("translate(ratio_text, '％%', '')", "([0-9.]+)")} as ratio_pct,
  try_cast(case when {_LABELLED} then {rex("ratio_text", "建ぺい率([0-9]+)%")} else {_ratio_part(1)} end as int) as kenpei,
  try_cast(case when {_LABELLED} then {rex("ratio_text", "容積率([0-9]+)%")} else {_ratio_part(2)} end as int) as youseki,
  {_limit("youseki_text")} as youseki_limit, {_limit("kenpei_text")} as kenpei_limit from listing""")
def ratio_split(spark, sf):
    both = measure.coverage_and_far("ratio_text")
    return listing(spark, sf).select(
        "listing_id", measure.ratio_pct("ratio_text").cast("double").alias("ratio_pct"),
        both["kenpei"].alias("kenpei"), both["youseki"].alias("youseki"),
        measure.ratio_limit("youseki_text").alias("youseki_limit"), measure.ratio_limit("kenpei_text").alias("kenpei_limit"),
    )


# --- dates -----------------------------------------------------------------------------

ERA = "(昭和|平成|令和)"


def era_base(x):
    return "(case " + " ".join(f"when {x} = '{e}' then {y}" for e, y in vocab.ERA_BASE.items()) + " end)"


def month_start(y, m):
    return f"try_cast(lpad(cast({y} as string), 4, '0') || '-' || lpad(cast({m} as string), 2, '0') || '-01' as date)"


@query("built_parse", f"""{LISTING}, t as (select listing_id, {asc("built_text")} as b from listing),
p as (select *, try_cast({rex("b", "([0-9]+)年([0-9]+)月", 1)} as int) as y, try_cast({rex("b", "([0-9]+)年([0-9]+)月", 2)} as int) as m,
  {rex("b", ERA + "[0-9]+年[0-9]+月")} as era from t)
select listing_id, strftime({month_start(f"case when era is not null then {era_base('era')} + y else y end", "m")}, '%Y-%m-%d') as built,
  strftime({month_start("y", "m")}, '%Y-%m-%d') as built_compat from p""")
def built_parse(spark, sf):
    return listing(spark, sf).select(
        "listing_id", date_text(dates.built_month("built_text")).alias("built"),
        date_text(dates.built_month("built_text", compat=True)).alias("built_compat"),
    )


AGE_SQL = f"""aged as (select *,
  coalesce(date_diff('day', coalesce(built, case when era_ is not null then {month_start(f"{era_base('era_')} + ey", "coalesce(em, 1)")}
    else {month_start("wy", "wm")} end), input_date) / 365.25, 20.0) as age_years
from (select *, {rex("b_", ERA + "([0-9]{1,2})年", 1)} as era_,
    try_cast({rex("b_", ERA + "([0-9]{1,2})年(?:([0-9]{1,2})月)?", 2)} as int) as ey,
    try_cast({rex("b_", ERA + "([0-9]{1,2})年(?:([0-9]{1,2})月)?", 3)} as int) as em,
    try_cast({rex("b_", "([0-9]{4})[年/.-]([0-9]{1,2})", 1)} as int) as wy,
    try_cast({rex("b_", "([0-9]{4})[年/.-]([0-9]{1,2})", 2)} as int) as wm
  from (select *, {asc("built_text")} as b_ from listing) x) y)"""


def _era_year(name, first):
    found = rex("b_", f"{name}([0-9]+{first})年")
    return f"{vocab.ERA_BASE[name]} + (case when {found} = '元' then 1 else try_cast({found} as int) end)"


WHOLE_AGE = f"""coalesce(greatest(0, year(input_date) - coalesce(year(built), try_cast({rex("b_", "([0-9]{4})")} as int),
    case when contains(b_, '平成') then {_era_year("平成", "|元")} when contains(b_, '昭和') then {_era_year("昭和", "")}
      when contains(b_, '令和') then {_era_year("令和", "|元")} end)),
    try_cast({rex("b_", "築([0-9]+)年")} as int), 20)"""
# DuckDB's greatest skips NULL, so the year has to be there first
WHOLE_AGE_SQL = f"""case when coalesce(year(built), try_cast({rex("b_", "([0-9]{4})")} as int),
    case when contains(b_, '平成') then {_era_year("平成", "|元")} when contains(b_, '昭和') then {_era_year("昭和", "")}
      when contains(b_, '令和') then {_era_year("令和", "|元")} end) is null
  then coalesce(try_cast({rex("b_", "築([0-9]+)年")} as int), 20) else {WHOLE_AGE} end"""


@query("building_age", f"""{LISTING}, {AGE_SQL}
select listing_id, round(age_years, 6) as age_years, cast({WHOLE_AGE_SQL} as int) as age_whole,
  case when built < date '1982-01-01' then 1 else 0 end as old_code,
  case when built is not null then (case when built < date '1981-06-01' then 0 else 1 end)
    when age_years > 45 then 0 else 1 end as new_code from aged""")
def building_age(spark, sf):
    rows = listing(spark, sf)
    age = dates.age_years("built_text", F.col("input_date"), F.col("built"))
    return rows.select(
        "listing_id", F.round(age, 6).alias("age_years"),
        dates.age_whole_years("built_text", F.col("input_date"), F.col("built")).alias("age_whole"),
        dates.is_old_quake_code("built").alias("old_code"), dates.is_new_quake_code("built", age).alias("new_code"),
    )


# --- addresses --------------------------------------------------------------------------

def canonical_sql(x: str, compat: bool = False) -> str:
    k = f"[{vocab.KANJI_DIGITS}]"
    a = f"translate(coalesce({x}, ''), '{vocab.FULLWIDTH_ALNUM}', '{vocab.ASCII_ALNUM}')"
    steps = [(f"{SPACE}+", ""), (f"[{vocab.DASHES}]+", "-")]
    if not compat:
        steps += [(f"({k})十({k})", r"\1\2"), (f"({k})十", r"\g0"), (f"十({k})", r"1\1")]
    for pattern, new in steps:
        new = r"\1" + "0" if new == r"\g0" else new
        a = f"regexp_replace({a}, '{pattern}', '{new}', 'g')"
    a = f"translate(replace({a}, '十', '10'), '{vocab.KANJI_DIGITS}', '123456789')"
    for pattern, new in [("([0-9]+)丁目", r"\1-"), ("([0-9]+)番(?:地|の)?", r"\1-"), ("([0-9]+)号", r"\1"), ("-+", "-"), ("^-|-$", "")]:
        a = f"regexp_replace({a}, '{pattern}', '{new}', 'g')"
    return a


@query("address_normalize", f"""{LISTING}
select listing_id, {canonical_sql("address")} as address_key, {canonical_sql("address", True)} as address_key_compat from listing""")
def address_normalize(spark, sf):
    return listing(spark, sf).select(
        "listing_id", address.canonical_address("address").alias("address_key"),
        address.canonical_address("address", compat=True).alias("address_key_compat"),
    )


def _implied(city):
    arms = " ".join(
        f"when regexp_matches({city}, '^({'|'.join(c)})') then '{p}'" for p, c in vocab.CITY_PREFECTURE.items()
    )
    return f"(case {arms} else '{vocab.DEFAULT_PREFECTURE}' end)"


def split_address_sql(x: str) -> str:
    """Subquery columns pref_, city_, town_ of a text column."""
    return f"""(select *, substr(rest_, length(city_) + 1) as town_,
      case when pref0_ = '' and city_ <> '' then {_implied("city_")} else pref0_ end as pref_
    from (select *, case when ward_ <> '' then ward_ else regexp_extract(rest_, '^(.+?(?:市|区|郡[^市区]*?[町村]|町|村))', 1) end as city_
      from (select *, regexp_extract(rest_, '^(.+?市.+?区)', 1) as ward_
        from (select *, substr(a_, length(pref0_) + 1) as rest_
          from (select *, regexp_extract(a_, '^(京都府|[^都道府県]+[都道府県])', 1) as pref0_
            from (select *, coalesce({x}, '') as a_ from listing) x0) x1) x2) x3) x4)"""


@query("address_split", f"""{LISTING}
select listing_id, pref_ as prefecture, city_ as city, town_ as town,
  regexp_extract(a_, '^(東京都|大阪府|京都府|北海道|[^県]+県)([^区市町]+[区市町])', 1) as light_prefecture,
  regexp_extract(a_, '^(東京都|大阪府|京都府|北海道|[^県]+県)([^区市町]+[区市町])', 2) as light_city
from {split_address_sql("address")} t""")
def address_split(spark, sf):
    rows = listing(spark, sf).select(
        "listing_id", address.split_address("address").alias("s"), address.light_key("address").alias("l")
    )
    return rows.select("listing_id", "s.*", F.col("l.prefecture").alias("light_prefecture"), F.col("l.city").alias("light_city"))


@query("light_keys", f"""{LISTING}, a as (select listing_id, coalesce(address, '') as a from listing), b as (select *, regexp_extract(a, '^(東京都|京都府|大阪府|北海道|[^県]+[県])', 1) as prefecture from a)
select listing_id, prefecture, case when prefecture <> '' then regexp_extract(substr(a, length(prefecture) + 1), '^([^市町村]+[市区町村])', 1) else '' end as city from b""")
def light_keys(spark, sf):
    return listing(spark, sf).select("listing_id", address.light_key_investment("address").alias("k")).select("listing_id", "k.*")


# --- access routes -------------------------------------------------------------------------

_FRAGMENTS = f"""regexp_replace(traffic, '[\\r\\n]+', '  ', 'g')"""
_FRAGMENTS = f"""regexp_replace({_FRAGMENTS}, '{SPACE}*[/／、]{SPACE}*', '  ', 'g')"""
_FRAGMENTS = f"""replace({_FRAGMENTS}, '　', '  ')"""
# the space after a walk time: once at every place it can follow
_FRAGMENTS = f"""regexp_replace({_FRAGMENTS}, '((?:徒歩|停歩|分)[0-9０-９]+分){SPACE}*([^ ])', '\\1  \\2', 'g')"""
_WALK = "regexp_matches({}, '徒歩|分|停歩|バス')"
_STATION = "regexp_matches({}, '駅|」|』')"

ROUTES_SQL = f"""frag as (
  select listing_id, list_filter(list_transform(string_split_regex({_FRAGMENTS}, '{SPACE}{{2,}}'), lambda x: {trim("x")}), lambda x: x <> '') as f
  from listing where traffic <> ''),
walkthrough as (
  select listing_id, f, 1 as i, 0 as line, f[1] as open_ from frag where len(f) > 0
  union all
  select listing_id, f, i + 1,
    case when joins then line else line + 1 end, case when joins then open_ || ' ' || f[i + 1] else f[i + 1] end
  from (select *, ((not {_STATION.format("open_")}) and {_STATION.format("f[i + 1]")})
      or ((not {_WALK.format("open_")}) and {_WALK.format("f[i + 1]")}) as joins from walkthrough) w
  where i < len(f)),
lines as (select listing_id, line + 1 as idx, arg_max(open_, i) as l from walkthrough group by listing_id, line),
plain_ as (select *, {asc("l")} as n, contains(l, 'バス') as bus,
    regexp_matches(l, '^(.*?){SPACE}*[「『（(]([^」』）)]+)[」』）)]') as br,
    regexp_matches(l, '^(.*?){SPACE}+([^{SPACE[1:-1]}]+?)駅') as gap,
    {trim("regexp_replace(l, '(?:徒歩|停歩|バス).*$', '')")} as pl from lines),
worded as (select *, case when contains(pl, '・') and contains(pl, '駅') then string_split(pl, '・')
    else string_split_regex(pl, '{SPACE}+') end as w,
    try_cast({rex("n", "(?:徒歩|停歩)" + SPACE + "*([0-9]+)" + SPACE + "*分")} as int) as walk,
    try_cast({rex("n", "バス" + SPACE + "*([0-9]+)" + SPACE + "*分")} as int) as bmin from plain_),
route as (select listing_id, idx, l as transfer,
  {trim(f"case when br then regexp_extract(l, '^(.*?){SPACE}*[「『（(]([^」』）)]+)[」』）)]', 1) when gap then regexp_extract(l, '^(.*?){SPACE}+([^{SPACE[1:-1]}]+?)駅', 1) when len(w) >= 2 then w[1] else '' end")} as railway,
  regexp_replace({trim(f"case when br then regexp_extract(l, '^(.*?){SPACE}*[「『（(]([^」』）)]+)[」』）)]', 2) when gap then regexp_extract(l, '^(.*?){SPACE}+([^{SPACE[1:-1]}]+?)駅', 2) when len(w) >= 2 then w[2] else w[1] end")}, '駅$', '') as station,
  case when not bus then walk end as walk_min, case when bus then bmin end as bus_min,
  case when bus then walk end as bus_walk_min, cast(bus as int) as bus_use from worded)"""
ROUTES_CTE = LISTING.replace("with ", "with recursive ", 1)


@query("traffic_routes", f"""{ROUTES_CTE}, {ROUTES_SQL}
select listing_id, cast(idx as int) as idx, transfer, railway, station, walk_min, bus_min, bus_walk_min, bus_use from route""")
def traffic_routes(spark, sf):
    return text.explode_kept(listing(spark, sf), ["listing_id"], traffic.routes("traffic"), "r").select(
        "listing_id", "r.idx", "r.transfer", "r.railway", "r.station", "r.walk_min", "r.bus_min", "r.bus_walk_min", "r.bus_use"
    )


@query("traffic_spaced")
def traffic_spaced(spark, sf):
    return listing(spark, sf).select("listing_id", F.posexplode(traffic.routes_spaced("traffic")).alias("pos", "r")).select(
        "listing_id", "pos", "r.*"
    )


# --- structure, road, rights ---------------------------------------------------------------

CLASS_SQL = f"""(case when {has("u", ["SRC", "鉄骨鉄筋"])} then 'SRC' when {has("u", ["RC", "鉄筋コンクリート"])} then 'RC'
  when {has("u", ["鉄骨", "Ｓ造"])} and {has("u", ["軽量"])} then 'LS' when {has("u", ["鉄骨", "Ｓ造"])} then 'S'
  when {has("u", ["木", "Ｗ造"])} then 'W' else 'default' end)"""
ASSET_CLASS_SQL = f"""(case when {has("u", ["SRC", "鉄骨鉄筋"])} then 'SRC' when {has("u", ["RC", "鉄筋コン"])} then 'RC'
  when {has("u", ["鉄骨", "鋼造", "S造"])} then 'S' else 'W' end)"""


@query("structure_class", f"""{LISTING}, t as (select *, upper(kouzou) as u from listing)
select listing_id, {CLASS_SQL} as cost_class, {ASSET_CLASS_SQL} as asset_class,
  (case when {has("kouzou", ["鉄骨鉄筋コンクリート", "SRC", "ＳＲＣ"])} then 'ＳＲＣ造' when {has("kouzou", ["鉄筋コンクリート"])} then 'ＲＣ造' when {has("kouzou", ["鉄骨"])} then 'Ｓ造'
    when {has("kouzou", ["木造"])} then '木造' when {has("kouzou", ["RC", "ＲＣ"])} then 'ＲＣ造'
    when {has("kouzou", ["S", "Ｓ"])} then 'Ｓ造' else '' end) as label,
  {values(CLASS_SQL, vocab.COST_UNIT)} as cost_unit, {values(ASSET_CLASS_SQL, vocab.ASSET_LIFE)} as asset_life from t""")
def structure_class(spark, sf):
    cost, asset = road.structure_class("kouzou"), road.structure_class_investment("kouzou")
    return listing(spark, sf).select(
        "listing_id", cost.alias("cost_class"), asset.alias("asset_class"), road.structure_label("kouzou").alias("label"),
        road.table_value(cost, vocab.COST_UNIT).alias("cost_unit"), road.table_value(asset, vocab.ASSET_LIFE).alias("asset_life"),
    )


_N = "([0-9]+(?:[.][0-9]+)?)"
_DIR = "(" + "|".join(vocab.DIRECTIONS) + ")"


@query("road_facts", f"""{LISTING}
select listing_id, coalesce({rex("setsudou", _DIR)}, '') as direction,
  coalesce({num("setsudou", "(?:幅員|幅|道路|前面)[ ]*(?:約)?[ ]*" + _N)}, {num("setsudou", _DIR + "[ ]*(?:約)?[ ]*" + _N + "[ ]*(?:m|米)", 2)}) as width,
  {num("setsudou", "(?:間口|接面|接す|接道)[ ]*[：:]?[ ]*(?:約)?[ ]*" + _N)} as frontage,
  coalesce({rex("setsudou", "(公道|私道)")}, '') as road_type,
  coalesce({rex("setsudou", "(" + "|".join(vocab.ROAD_STRUCTURES) + ")")}, '中間地') as structure,
  {rex("setsudou", "([東西南北]{1,2})")} as compact_direction, {num("setsudou", "([0-9]+([.][0-9]+)?)m")} as compact_width,
  {num("setsudou", "接面([0-9]+([.][0-9]+)?)m")} as compact_frontage,
  {first_of("setsudou", ["公道", "私道"])} as compact_type,
  coalesce({rex("setsudou", "([北東西南]+)")}, '-') as labelled_direction,
  coalesce({rex("setsudou", "([0-9.]+)[ ]*[mｍ]")}, '0') as labelled_width,
  coalesce({rex("setsudou", "(?:接面|間口)[：:]?[ ]*(?:約)?[ ]*([0-9.]+)[ ]*[mｍ]")}, '0') as labelled_frontage
from listing""")
def road_facts(spark, sf):
    rows = listing(spark, sf).select(
        "listing_id", road.road_facts("setsudou").alias("r"), road.road_facts_compact("setsudou").alias("c"),
        road.road_facts_labelled("setsudou").alias("l"),
    )
    return rows.select(
        "listing_id", "r.direction", F.col("r.width").cast("double").alias("width"),
        F.col("r.frontage").cast("double").alias("frontage"), "r.road_type", "r.structure",
        F.col("c.direction").alias("compact_direction"), F.col("c.width").cast("double").alias("compact_width"),
        F.col("c.frontage").cast("double").alias("compact_frontage"), F.col("c.road_type").alias("compact_type"),
        F.col("l.direction").alias("labelled_direction"), F.col("l.width").alias("labelled_width"),
        F.col("l.frontage").alias("labelled_frontage"),
    )


# --- display, URLs -------------------------------------------------------------------------

@query("display_truncate", f"""
with c as (select doc_id, generate_subscripts(x, 1) as i, unnest(x) as ch from (
    select doc_id, string_split(substr(text, 1, 40), '') as x from documents) t),
w as (select *, sum(case when regexp_matches(ch, '{text.wide_class()}') then 2 else 1 end) over (partition by doc_id order by i) as used from c)
select d.doc_id, coalesce(s.cut, '') as cut,
  2 * length(d.text) - length(regexp_replace(d.text, '{text.wide_class()}', '', 'g')) as width
from documents d left join (select doc_id, string_agg(ch, '' order by i) as cut from w where used <= 40 group by doc_id) s on d.doc_id = s.doc_id""")
def display_truncate(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.truncate_display("text", 40).alias("cut"), text.display_width("text").cast("bigint").alias("width")
    )


_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_sql(x: str, group: int) -> str:
    return f"regexp_extract({x}, '{_URL}', {group})"


@query("url_canonical", f"""
select page_id, {url_sql("url", 1)} || '://' || {url_sql("url", 2)} || {url_sql("url", 3)} as canonical,
  {url_sql("url", 2)} as host, {url_sql("url", 4)} as query from pages""")
def url_canonical(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", urls.canonical_url("url").alias("canonical"), urls.url_part("url", 2).alias("host"),
        urls.url_part("url", 4).alias("query"),
    )


@query("next_page", f"""
with t as (select page_id, url, {url_sql("url", 4)} as q, {url_sql("url", 5)} as frag,
  {url_sql("url", 1)} || '://' || {url_sql("url", 2)} || {url_sql("url", 3)} as base from pages)
select page_id, base || '?' || case
    when regexp_matches(q, '(^|&)page=[0-9]+') then regexp_replace(q, '(^|&)page=[0-9]+', '\\1page=' || cast(try_cast({rex("q", "(?:^|&)page=([0-9]+)")} as bigint) + 1 as string))
    when q = '' then 'page=2' else q || '&page=2' end || case when frag <> '' then '#' || frag else '' end as next_url from t""")
def next_page(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.next_page_url("url").alias("next_url"))
