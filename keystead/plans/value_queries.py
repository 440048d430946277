"""Queries over public statistics, valuation columns and the investment simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystead import vocab
from keystead.functions import measure
from keystead.operators import aggregates, investment, lookups, screening, valuation
from keystead.plans.registry import first_of, has, num, query, values, whole
from keystead.plans.testbed import cte, load
from keystead.plans.text_queries import AGE_SQL, ASSET_CLASS_SQL, CLASS_SQL, WHOLE_AGE_SQL, _limit
from keystead.session import stage

LISTING = cte("listing")


def rounded(df, scale=6, keys=("listing_id",)):
    """Doubles rounded for comparison, decimals as doubles."""
    out = {}
    for name, kind in df.dtypes:
        if name not in keys and (kind == "double" or kind.startswith("decimal")):
            out[name] = F.round(F.col(name).cast("double"), scale)
    return df.withColumns(out)


def r(x, scale=6, name=None):
    return f"round({x}, {scale}) as {name or x}"


# exact decimals end on a tie now and then; both engines step off it the same way
NUDGE = 1e-7


# --- dimensions -----------------------------------------------------------------------

MUNI_PREF = """muni_pref as (select prefecture, avg(pop_growth) as pop_growth, floor(avg(income)) as income,
  floor(avg(total_population)) as total_population, avg(income_growth) as income_growth, avg(density) as density
  from municipality group by prefecture)"""


@query("municipality_averages", f"""{cte("municipality")}, {MUNI_PREF}
select prefecture, round(pop_growth, 6) as pop_growth, cast(income as bigint) as income, cast(total_population as bigint) as total_population,
  round(income_growth, 6) as income_growth, round(density, 6) as density,
  (select round(sum(density) / count(*), 6) from municipality m where m.prefecture = p.prefecture) as density_all_rows from muni_pref p""")
def municipality_averages(spark, sf):
    dim = load(spark, sf, "municipality")
    every = lookups.municipality_averages(dim, compat=True).select("prefecture", F.col("density").alias("density_all_rows"))
    return rounded(lookups.municipality_averages(dim).join(every, "prefecture"), keys=("prefecture",))


def _muni(c, kind, default):
    if c == "density":
        return f"coalesce(m.density, p.density, {default}e0) as density"
    return f"cast(case when m.city is not null then coalesce(m.{c}, {default}) else coalesce(p.{c}, {default}) end as {kind}) as {c}"


MUNI_SQL = f"""{MUNI_PREF},
with_muni as (select l.*, {_muni("pop_growth", "double", 0)}, {_muni("income", "bigint", 3000)},
  {_muni("total_population", "bigint", 100000)}, {_muni("income_growth", "double", 0)}, {_muni("density", "double", 4000)}
  from {{source}} l left join municipality m on l.address1 = m.prefecture and l.address2 = m.city
  left join muni_pref p on l.address1 = p.prefecture)"""
_MUNI_OUT = "listing_id, round(pop_growth, 6) as pop_growth, income, total_population, round(income_growth, 6) as income_growth, round(density, 6) as density"


@query("municipality_lookup", f"""{cte("listing", "municipality")}, {MUNI_SQL.format(source="listing")}
select {_MUNI_OUT}, round({{walk}}, 6) as effective_walk from with_muni""".replace(
    "{walk}", "(2 + listing_id % 17) * greatest(0.4, least(1.0, 0.4 + 0.6 * (density / 4000.0)))"))
def municipality_lookup(spark, sf):
    rows = load(spark, sf, "listing").select("listing_id", "address1", "address2")
    out = lookups.with_municipality(rows, load(spark, sf, "municipality"))
    out = out.withColumn("effective_walk", valuation.effective_walk(F.lit(2) + F.col("listing_id") % 17, F.col("density")))
    return rounded(out.drop("address1", "address2"))


STATION_SQL = """station_dim as (select replace(station_name, '駅', '') as st, arg_max(passenger_volume, station_id) as v from station group by 1),
with_station as (select l.*, coalesce(d.v, 10000) as passenger_volume from {source} l left join station_dim d on replace(l.station1, '駅', '') = d.st)"""


@query("station_lookup", f"""{cte("sited", "station")}, {STATION_SQL.format(source="sited")}
select listing_id, station1, passenger_volume from with_station""")
def station_lookup(spark, sf):
    rows = load(spark, sf, "sited").select("listing_id", "station1")
    return lookups.with_station(rows, load(spark, sf, "station"))


_KW = " union all ".join(f"select {i} as n, '{w}' as word" for i, w in enumerate(vocab.ZONE_KEYWORDS))
LIMIT_SQL = f"""zone_kw as (select word, arg_min(max_youseki, zone_id) as zy, arg_min(max_kenpei, zone_id) as zk
  from ({_KW}) k join zone on contains(zone_name, word) group by word),
limited as (select *, {_limit("youseki_text")} as yl, {_limit("kenpei_text")} as kl from {{source}}),
with_limits as (select l.* exclude (yl, kl), coalesce(yl, cast(zy as double), 200e0) as max_youseki, coalesce(kl, cast(zk as double), 60e0) as max_kenpei
  from limited l left join zone_kw z on z.word = case when yl is null or kl is null then {first_of("youseki_text", vocab.ZONE_KEYWORDS)} end)"""


@query("zone_limits", f"""{cte("listing", "zone")}, {LIMIT_SQL.format(source="listing")}
select listing_id, max_youseki, max_kenpei from with_limits""")
def zone_limits(spark, sf):
    rows = load(spark, sf, "listing").select("listing_id", "youseki_text", "kenpei_text")
    out = lookups.with_limits(
        rows, load(spark, sf, "zone"), measure.ratio_limit("youseki_text"), measure.ratio_limit("kenpei_text")
    )
    return out.select("listing_id", "max_youseki", "max_kenpei")


def _wide(use, tag):
    w = f"filter (where land_use = '{use}')"
    cols = ", ".join(f"cast(max({c}) {w} as double) as {tag}_{c}" for c in ("average", "rosenka", "fixed_asset", "growth"))
    return f"count(*) {w} > 0 as has_{tag}, {cols}"


def _pref(use, tag):
    w = f"filter (where land_use = '{use}')"
    cols = ", ".join(f"avg({c}) {w} as p_{tag}_{c}" for c in ("average", "rosenka", "fixed_asset"))
    return f"{cols}, case when count(*) {w} > 0 then coalesce(avg(growth) {w}, 0) end as p_{tag}_growth"


def _src(tag, c):
    if c == "growth":
        return f"coalesce(w.{tag}_growth, p.p_{tag}_growth)"
    return f"case when w.has_{tag} then w.{tag}_{c} else p.p_{tag}_{c} end"


def _blend(c):
    a, b = f"({_src('res', c)})", f"({_src('com', c)})"
    return f"coalesce({a} * (1.0 - wc) + {b} * wc, {a}, {b})"


LAND_SQL = f"""land_wide as (select prefecture, city, {_wide("residential", "res")}, {_wide("commercial", "com")} from land group by 1, 2),
land_pref as (select prefecture, {_pref("residential", "res")}, {_pref("commercial", "com")} from land group by 1),
weighted as (select *, least(1e0, greatest(0e0, (max_youseki - 150.0) / 300.0)) as wc from {{source}}),
blended as (select l.* exclude (wc), coalesce({whole(_blend("average"))}, 350000) as average_land_price, {whole(_blend("rosenka"))} as ro,
    {whole(_blend("fixed_asset"))} as fa, coalesce({_blend("growth")}, 0) as land_price_growth
  from weighted l left join land_wide w on l.address1 = w.prefecture and l.address2 = w.city left join land_pref p on l.address1 = p.prefecture),
with_land as (select * exclude (ro, fa), coalesce(ro, {whole("average_land_price * 0.8")}) as rosenka_price,
  coalesce(fa, {whole("average_land_price * 0.7")}) as fixed_asset_price from blended)"""


@query("land_blend", f"""{cte("listing", "zone", "land")}, {LIMIT_SQL.format(source="listing")}, {LAND_SQL.format(source="with_limits")}
select listing_id, average_land_price, rosenka_price, fixed_asset_price, round(land_price_growth, 6) as land_price_growth from with_land""")
def land_blend(spark, sf):
    rows = load(spark, sf, "listing").select("listing_id", "address1", "address2", "youseki_text", "kenpei_text")
    limited = lookups.with_limits(
        rows, load(spark, sf, "zone"), measure.ratio_limit("youseki_text"), measure.ratio_limit("kenpei_text")
    )
    out = lookups.with_land_price(limited, load(spark, sf, "land"))
    return rounded(out.select("listing_id", "average_land_price", "rosenka_price", "fixed_asset_price", "land_price_growth"))


HAZARD_SQL = """with_hazard as (select l.*, cast(coalesce(h.flood, 0) as int) as flood_risk, cast(coalesce(h.landslide, 0) as int) as landslide_risk
  from {source} l left join hazard h on l.address1 = h.prefecture and l.address2 = h.city)"""


@query("hazard_lookup", f"""{cte("listing", "hazard")}, {HAZARD_SQL.format(source="listing")}
select listing_id, flood_risk, landslide_risk from with_hazard""")
def hazard_lookup(spark, sf):
    rows = load(spark, sf, "listing").select("listing_id", "address1", "address2")
    return lookups.with_hazard(rows, load(spark, sf, "hazard")).drop("address1", "address2")


# places asked for: short forms, so that containment matters
_ASKED = "case when listing_id % 5 = 0 then substr(address1, 1, 2) else address1 end as a1, case when listing_id % 3 = 0 then substr(address2, 1, 2) when listing_id % 11 = 0 then '未知' when listing_id % 13 = 0 then '' else address2 end as a2"
CONTAINS_SQL = """places as (select distinct a1, a2 from {source}),
land_hit as (select a1, a2, arg_min(average, case when land_use = 'residential' then 0 else 1000000 end + land_id) as v
  from places join land on contains(prefecture, a1) and contains(city, a2) and a1 <> '' and a2 <> '' group by 1, 2),
pref_hit as (select a1, cast(floor(avg(average)) as bigint) as v from (select distinct a1 from places) x join land on contains(prefecture, a1) where a1 <> '' group by 1),
with_contains as (select s.*, coalesce(case when s.a1 <> '' and s.a2 <> '' then coalesce(h.v, q.v) end, 100000) as asset_land_price
  from {source} s left join land_hit h on s.a1 = h.a1 and s.a2 = h.a2 left join pref_hit q on s.a1 = q.a1)"""


@query("land_price_contains", f"""{cte("listing", "land")}, asked as (select listing_id, {_ASKED} from listing), {CONTAINS_SQL.format(source="asked")}
select listing_id, asset_land_price from with_contains""")
def land_price_contains(spark, sf):
    n, a1, a2 = F.col("listing_id"), F.col("address1"), F.col("address2")
    rows = load(spark, sf, "listing").select(
        "listing_id", F.when(n % 5 == 0, F.substring(a1, 1, 2)).otherwise(a1).alias("a1"),
        F.when(n % 3 == 0, F.substring(a2, 1, 2)).when(n % 11 == 0, "未知").when(n % 13 == 0, "").otherwise(a2).alias("a2"),
    )
    return lookups.with_land_price_contains(rows, load(spark, sf, "land"), "a1", "a2").select("listing_id", "asset_land_price")


TRADE_SQL = f"""trade_unit as (select prefecture, trim(City) as city,
    case when contains(Use, '住宅') then 'residential' when {has("Use", vocab.COMMERCIAL_WORDS)} then 'commercial' end as land_use,
    try_cast(TradePrice as double) / nullif({num("Area", "([0-9.]+)")}, 0) as unit from trade)"""


@query("trades_to_land_prices", f"""{cte("trade")}, {TRADE_SQL}, m as (select prefecture, city, land_use, {whole("avg(unit)")} as average, count(*) as n
  from trade_unit where city <> '' and land_use is not null and unit between 10000 and 10000000 group by 1, 2, 3)
select *, {whole("average * 0.8")} as rosenka, {whole("average * 0.7")} as fixed_asset from m""")
def trades_to_land_prices(spark, sf):
    trades = load(spark, sf, "trade")
    return aggregates.trades_to_land_prices(trades, F.col("prefecture"))


@query("public_prices", f"""{cte("land")}
select land_id, average, {whole("average * 0.8")} as rosenka, {whole("average * 0.7")} as fixed_asset from land""")
def public_prices(spark, sf):
    return aggregates.public_prices(load(spark, sf, "land").select("land_id", "average"))


# --- market --------------------------------------------------------------------------------

MASTER_SQL = f"""{AGE_SQL}, priced as (select *, price_yen / 10000.0 as price_man, cast(floor(age_years / 10) as int) as age_band,
  case property_type when 'tochi' then tochi_menseki when 'mansion' then senyu_menseki else tatemono_menseki end as unit_area from aged),
master as (select coalesce(address1, '') as prefecture, coalesce(address2, '') as city, property_type, age_band,
  avg(price_man / unit_area) as unit_price, count(*) as n from priced where unit_area > 0 and price_man > 0 group by 1, 2, 3, 4),
master_pref as (select prefecture, property_type, age_band, avg(unit_price) as pref_unit from master group by 1, 2, 3)"""


def priced_listings(spark, sf):
    from keystead.functions import dates

    return load(spark, sf, "listing").withColumns({
        "price_man": F.col("price_yen") / 10000.0,
        "age_years": dates.age_years("built_text", F.col("input_date"), F.col("built")),
    })


@query("market_master", f"""{LISTING}, {MASTER_SQL}
select prefecture, city, property_type, age_band, round(unit_price, 6) as unit_price, n from master""")
def market_master(spark, sf):
    return rounded(aggregates.market_master(priced_listings(spark, sf)), keys=())


MARKET_JOIN = """left join master c on l.address1 = c.prefecture and l.address2 = c.city and l.property_type = c.property_type and l.age_band = c.age_band
  left join master_pref q on l.address1 = q.prefecture and l.property_type = q.property_type and l.age_band = q.age_band"""
# a place of its own for some rows, so that both fallbacks are met
_MOVED = "select * replace (case when listing_id % 10 = 1 then '（旧）' else address2 end as address2, case when listing_id % 50 = 1 then '北海道' else address1 end as address1) from priced"


@query("market_lookup", f"""{LISTING}, {MASTER_SQL}, moved as ({_MOVED})
select listing_id, round(coalesce(c.unit_price, q.pref_unit, 30.0), 6) as market_unit from moved l {MARKET_JOIN}""")
def market_lookup(spark, sf):
    rows = priced_listings(spark, sf)
    master = stage(aggregates.market_master(rows), "market")
    n = F.col("listing_id")
    moved = rows.select(
        "listing_id", "property_type", aggregates.age_band(F.col("age_years")).alias("age_band"),
        F.when(n % 10 == 1, "（旧）").otherwise(F.col("address2")).alias("address2"),
        F.when(n % 50 == 1, "北海道").otherwise(F.col("address1")).alias("address1"),
    )
    return rounded(lookups.with_market(moved, master).select("listing_id", "market_unit"))


@query("bargains", f"""{LISTING}, {MASTER_SQL}, valued as (select l.listing_id, l.property_type, l.address1, l.address2, l.price_man,
    coalesce(c.unit_price, q.pref_unit, 30.0) * unit_area as mv from priced l {MARKET_JOIN} where unit_area > 0 and price_man > 0)
select listing_id, property_type, address1, address2, round(price_man, 1) as price_man, round(mv, 4) as market_value,
  round((mv - price_man) / mv * 100.0, 4) as discount_pct from valued order by (mv - price_man) / mv desc, listing_id limit 20""")
def bargains(spark, sf):
    rows = priced_listings(spark, sf).withColumns({
        "valued_area": aggregates.unit_area(), "age_band": aggregates.age_band(F.col("age_years")),
    }).select(
        "listing_id", "property_type", "address1", "address2", "price_man", "valued_area", "age_band", "age_years",
        "senyu_menseki", "tochi_menseki", "tatemono_menseki",
    ).filter((F.col("valued_area") > 0) & (F.col("price_man") > 0))
    master = stage(aggregates.market_master(rows), "market")
    top = screening.bargains(lookups.with_market(rows, master))
    return top.select(
        "listing_id", "property_type", "address1", "address2", F.round("price_man", 1).alias("price_man"),
        F.round("market_value", 4).alias("market_value"), F.round("discount_pct", 4).alias("discount_pct"),
    )


# --- valuation columns -------------------------------------------------------------------------

def _stated():
    arms = []
    for t in ("setsudou", "biko", "tochi_menseki_text"):
        for p in vocab.SETBACK_PATTERNS:
            n = num(t, p.replace(r"\.", "."))
            arms.append(f"case when {n} > 0 then {n} end")
    return "coalesce(" + ", ".join(arms) + ")"


SETBACK_SQL = f"""sized as (select *, upper(kouzou) as u, coalesce(nullif(road_width, 0), {num("setsudou", "([0-9.]+)[ ]*[mｍ]")}, 4.0) as road_width_m,
  coalesce(nullif(maguchi, 0), {num("setsudou", "(?:間口|接面)[ ]*(?:約)?[ ]*([0-9.]+)[ ]*[mｍ]")}, 6.0) as frontage_m,
  coalesce(tochi_menseki, 0e0) as land0, coalesce(senyu_menseki, 0e0) as private_area, coalesce(tatemono_menseki, 0e0) as building_area from {{source}}),
setb as (select *, coalesce({_stated()}, case when road_width_m < 4.0 then frontage_m * (4.0 - road_width_m) / 2.0 end, 0e0) as setback_area from sized),
ratioed as (select *, case when land0 > 0 then least(1e0, setback_area / land0) else 0e0 end as setback_ratio from setb),
with_setback as (select * exclude (land0), land0 * (1.0 - setback_ratio) as land_area from ratioed)"""


@query("setback", f"""{LISTING}, {SETBACK_SQL.format(source="listing")}
select listing_id, round(road_width_m, 6) as road_width_m, round(frontage_m, 6) as frontage_m, round(setback_area, 6) as setback_area,
  round(setback_ratio, 6) as setback_ratio, round(land_area, 6) as land_area from with_setback""")
def setback(spark, sf):
    rows = load(spark, sf, "listing").select(
        "listing_id", "setsudou", "biko", "tochi_menseki_text", "road_width", "maguchi", "tochi_menseki"
    )
    return rounded(valuation.with_setback(rows).select(
        "listing_id", "road_width_m", "frontage_m", "setback_area", "setback_ratio", "land_area"
    ))


RIGHTS_SQL = f"""with_rights as (select *, case when {has("tochikenri", ["底地", "貸地"])} then 0.20
    when {has("tochikenri", ["定期", "定借"])} then 0.70 * (case when age_years > 0 then greatest(0.20, (50 - age_years) / 50.0) else 0.50 end)
    when {has("tochikenri", ["借地", "賃借"])} then 0.65 else 1.0 end as rights_ratio,
  cast({has("youto_chiiki", ["調整区域"])} or {has("biko", ["調整区域"])} as double) as is_urban_control,
  cast({has("tochikenri", ["再建築不可"])} or {has("biko", ["再建築不可"])} as double) as is_no_rebuild,
  case when {has("biko", vocab.FLAG_LOT_WORDS)} or {has("tochikenri", vocab.FLAG_LOT_WORDS)} then 0.25
    when {has("biko", vocab.IRREGULAR_WORDS)} or {has("tochikenri", vocab.IRREGULAR_WORDS)} then 0.15 else 0.0 end as shade_ratio from {{source}})"""
_RIGHTS_OUT = "round(cast(rights_ratio as double), 6) as rights_ratio, is_urban_control, is_no_rebuild, cast(shade_ratio as double) as shade_ratio"


@query("rights", f"""{LISTING}, {AGE_SQL}, {RIGHTS_SQL.format(source="aged")}
select listing_id, {_RIGHTS_OUT} from with_rights""")
def rights(spark, sf):
    return rounded(valuation.with_rights(priced_listings(spark, sf)).select(
        "listing_id", "rights_ratio", "is_urban_control", "is_no_rebuild", "shade_ratio"
    ))


_HAS_LAND = "property_type in ('tochi', 'kodate', 'apartment')"
_DIRS = ["北東", "北西", "南東", "南西", "東", "西", "南", "北"]
FACTOR_SQL = f"""volumed as (select *, case when property_type in ('kodate', 'apartment') and land_area > 0 then building_area / land_area * 100.0 else 0e0 end as digest_volume_ratio from {{source}}),
used as (select *, case when property_type in ('kodate', 'apartment') and land_area > 0 then greatest(0e0, max_youseki - digest_volume_ratio) else 0e0 end as surplus_volume,
  case when property_type in ('kodate', 'apartment') and land_area > 0 and digest_volume_ratio > max_youseki then 1 else 0 end as non_conforming,
  case when {_HAS_LAND} then coalesce({first_of("setsudou", _DIRS)}, '') else '' end as dir_,
  case when {_HAS_LAND} then coalesce({first_of("setsudou", ["公道", "私道"])}, '') else '' end as road_type_used,
  {has("setsudou", vocab.CORNER_WORDS)} as corner, {has("setsudou", vocab.TWO_SIDE_WORDS)} as twoside,
  road_width_m * (case when {has("youto_chiiki", vocab.BUSINESS_ZONE_WORDS)} then 0.6 else 0.4 end) * 100.0 as road_volume_limit from volumed),
factored as (select *, case when {_HAS_LAND} then least(max_youseki, road_volume_limit) else max_youseki end as actual_volume_limit,
  cast(case when not {_HAS_LAND} then 1.0 when contains(dir_, '北') and road_width_m >= 4 then 1.15
    when contains(dir_, '南') and (case when frontage_m > 0 then land_area / frontage_m else 10.0 end) < 10 then 0.85 else 1.0 end as double) as volume_digest_factor,
  cast(case when {_HAS_LAND} and corner then 1.05 when {_HAS_LAND} and twoside then 1.03 else 1.0 end as double) as road_condition_factor,
  cast(case when {_HAS_LAND} and frontage_m < 2 then 0.25 when {_HAS_LAND} and frontage_m < 4 then 0.90 else 1.0 end as double) as frontage_factor from used),
with_factors as (select *, case when {_HAS_LAND} then land_area * (average_land_price / 10000.0) * volume_digest_factor * road_condition_factor * frontage_factor else 0e0 end as residual_land_value,
  case when land_area > 0 then land_area * ((case when corner then least(100.0, max_kenpei + 10.0) else max_kenpei end) / 100.0) else 0e0 end as max_building_area,
  case when land_area > 0 then land_area * (actual_volume_limit / 100.0) else 0e0 end as max_floor_area from factored)"""

APPROACH_SQL = f"""costed as (select *, {CLASS_SQL} as cost_class, cast(floor(age_years / 10) as int) as age_band, average_land_price / 10000.0 as lu from {{source}}),
unit_ as (select *, {values("cost_class", vocab.COST_UNIT)} as cu, {values("cost_class", vocab.COST_LIFE)} as cl,
  case when (case when property_type = 'mansion' then private_area else building_area end) > 0 then (case when property_type = 'mansion' then private_area else building_area end) else 50e0 end as valued_area from costed),
valued as (select l.* exclude (cu, cl, lu),
  case when l.property_type = 'mansion' then private_area * 0.2 * lu + private_area * cu * greatest(0.1, (cl - age_years) / cl)
    else land_area * lu + building_area * cu * greatest(0.1, (cl - age_years) / cl) end as cost_approach_value,
  coalesce(c.unit_price, q.pref_unit, 30.0) * valued_area as market_value,
  cast(case when gross_yield is null then (case when income > 900 then 0.045 when income > 600 then 0.055 else 0.06 end) when gross_yield <= 0 then 0.06 else gross_yield / 100.0 end as double) as cap_rate,
  coalesce(annual_rent / 10000.0, valued_area * lu * 0.05) as rent_
  from unit_ l {MARKET_JOIN}),
with_values as (select * exclude (rent_), rent_ / cap_rate as income_approach_value from valued)"""

# the master stands on its own aged view, the features on theirs
FEATURES_CTE = f"""{cte("sited", "municipality", "station", "zone", "land", "hazard")}, {MASTER_SQL},
aged_sited as (select a.*, s.station1, s.walk_min1 from aged a join sited s on a.listing_id = s.listing_id),
{SETBACK_SQL.format(source="aged_sited")}, {MUNI_SQL.format(source="with_setback")}, {STATION_SQL.format(source="with_muni")},
{LIMIT_SQL.format(source="with_station")}, {LAND_SQL.format(source="with_limits")}, {HAZARD_SQL.format(source="with_land")},
{FACTOR_SQL.format(source="with_hazard")}, {APPROACH_SQL.format(source="with_factors")}, {RIGHTS_SQL.format(source="with_values")}"""

_F_SMALL = ["setback_ratio", "digest_volume_ratio", "surplus_volume", "actual_volume_limit", "max_building_area", "max_floor_area", "max_youseki", "max_kenpei", "cap_rate"]
_F_BIG = ["cost_approach_value", "market_value", "income_approach_value", "residual_land_value"]
FEATURE_OUT = ["listing_id", "property_type", *_F_SMALL, *_F_BIG]


def listing_features(spark, sf):
    """All valuation columns, with the market master of the same listings."""
    dims = valuation.Dimensions(*[load(spark, sf, n) for n in ("municipality", "station", "land", "hazard", "zone")])
    master = stage(aggregates.market_master(priced_listings(spark, sf)), "market")
    return valuation.build_features(load(spark, sf, "sited"), dims, F.col("input_date"), master)


@query("features", f"""{FEATURES_CTE}
select listing_id, property_type, {", ".join(r(c) for c in _F_SMALL)}, {", ".join(r(f"{c} + {NUDGE}", 3, c) for c in _F_BIG)},
  non_conforming, volume_digest_factor, road_condition_factor, frontage_factor, {_RIGHTS_OUT}, passenger_volume, income, average_land_price,
  flood_risk, landslide_risk, dir_ as road_direction_used, road_type_used,
  round(coalesce(walk_min1, 15) * greatest(0.4, least(1.0, 0.4 + 0.6 * (density / 4000.0))), 6) as effective_walk,
  case when built is not null then (case when built < date '1981-06-01' then 0 else 1 end) when age_years > 45 then 0 else 1 end as is_new_code,
  round(case property_type when 'mansion' then private_area when 'tochi' then land_area else building_area end, 6) as area
from with_rights""")
def features(spark, sf):
    out = listing_features(spark, sf).select(
        *FEATURE_OUT, "non_conforming", "volume_digest_factor", "road_condition_factor", "frontage_factor", "rights_ratio",
        "is_urban_control", "is_no_rebuild", "shade_ratio", "passenger_volume", "income", "average_land_price", "flood_risk",
        "landslide_risk", "road_direction_used", "road_type_used", "effective_walk", "is_new_code", "area",
    )
    big = {c: F.round(F.col(c) + NUDGE, 3) for c in _F_BIG}
    return rounded(out.withColumns(big))


# --- investment ------------------------------------------------------------------------------------



def payment_sql(principal, years):
    g = f"pow(1 + 0.025 / 12.0, ({years}) * 12)"
    return f"(case when ({principal}) <= 0 or ({years}) <= 0 then 0e0 else ({principal}) * ((0.025 / 12.0) * {g}) / ({g} - 1) * 12 end)"


_TERM = f"cast(greatest(20, least(35, {values('k', vocab.ASSET_LIFE)} - a)) as int)"


@query("loan_terms", f"""{LISTING}, {AGE_SQL}, t as (select listing_id, price_yen / 10000.0 * 0.9 as principal, {ASSET_CLASS_SQL} as k, cast({WHOLE_AGE_SQL} as int) as a
  from (select *, upper(kouzou) as u from aged) z), y as (select *, {_TERM} as years from t)
select listing_id, years as loan_years, round({payment_sql("principal", "years")}, 4) as annual_payment from y""")
def loan_terms(spark, sf):
    from keystead.functions import dates, road

    rows = load(spark, sf, "listing")
    years = investment.loan_years(
        road.structure_class_investment("kouzou"), dates.age_whole_years("built_text", F.col("input_date"), F.col("built"))
    )
    principal = F.col("price_yen") / 10000.0 * 0.9
    return rows.select("listing_id", years.alias("loan_years"), principal.alias("p")).select(
        "listing_id", "loan_years",
        F.round(investment.annual_payment(F.coalesce("p", F.lit(None).cast("double")), vocab.LOAN_RATE, F.col("loan_years")), 4).alias("annual_payment"),
    )


def _score(x):
    return f"least(100e0, greatest(0e0, {x}))"


INVEST_SQL = f"""inv0 as (select *, price_yen / 10000e0 as p, address1 as a1, address2 as a2 from aged where price_yen / 10000e0 >= 10),
{CONTAINS_SQL.format(source="inv0")},
inv1 as (select c.*, e.pred1, e.pred2, {ASSET_CLASS_SQL} as k, cast({WHOLE_AGE_SQL} as int) as a,
  {has("tochikenri", ["再建築不可"])} or {has("biko", ["再建築不可"])} as no_rebuild,
  case when annual_rent > 0 then cast(annual_rent as double) when gross_yield > 0 then p * (gross_yield / 100.0) else p * 0.08 end as rent0,
  case when coalesce(tatemono_menseki, 0) <> 0 then tatemono_menseki else coalesce(senyu_menseki, 0e0) end as bld
  from (select *, upper(kouzou) as u from with_contains) c join evaluation e on c.property_id = e.property_id),
inv2 as (select *, case when rent0 > 100000 then rent0 / 10000.0 else rent0 end as rent_man, case when no_rebuild then p else p * 0.1 end as down,
  {values("k", vocab.ASSET_UNIT)} as au, {values("k", vocab.ASSET_LIFE)} as al from inv1),
inv3 as (select *, {whole("coalesce(tochi_menseki, 0) * asset_land_price / 10000.0 + bld * au * (greatest(0e0, al - a) / al)")} as asset_value,
  cast(greatest(20, least(35, al - a)) as int) as loan_years, case when no_rebuild then 0e0 else p - down end as principal from inv2),
inv4 as (select *, case when {has("tochikenri", ["借地", "賃借", "定期"])} then greatest(0e0, rent_man * 0.8 - (case when asset_value > 0 then asset_value else p end) * 0.01)
    else rent_man * 0.8 end as noi0, {payment_sql("principal", "loan_years")} as repay, asset_value / p * 100.0 as ar from inv3),
inv5 as (select *, noi0 - repay as cf, case when repay > 0 then noi0 / repay else 9.99 end as ds from inv4),
inv6 as (select *, case when down > 0 then cf / down * 100.0 else 0 end as coc, coalesce(nullif(pred2, 0), pred1, 0) as pr from inv5),
inv7 as (select *, case when pr > 0 then {_score("(pr / p - 0.8) / 0.4 * 100.0")} else 50e0 end as s_asset,
  ({_score("coc / 12.0 * 100.0")} + {_score("cf / p * 100.0 / 2.0 * 100.0")}) / 2.0 as s_cash,
  {_score("(ar - 50.0) / 50.0 * 100.0")} * 0.7 + {_score("(ds - 1.0) / 0.3 * 100.0")} * 0.3 as s_fin from inv6)"""


def _clamp(x):
    return f"greatest(-9999.99, least(9999.99, {x}))"


@query("investment_scores", f"""{cte("listing", "evaluation", "land")}, {AGE_SQL}, {INVEST_SQL}
select listing_id, asset_value, loan_years, cast(trunc(noi0) as bigint) as noi, cast(trunc(repay) as bigint) as debt_service, cast(trunc(cf) as bigint) as cash_flow,
  round({_clamp("ds")}, 2) as dscr, round({_clamp("coc")}, 2) as coc_return, round({_clamp("ar")}, 2) as asset_ratio,
  round(s_cash, 2) as cashflow_score, round(s_fin, 2) as finance_score, round(s_asset * 0.4 + s_cash * 0.4 + s_fin * 0.2, 2) as total_investment_score from inv7""")
def investment_scores(spark, sf):
    evals = load(spark, sf, "evaluation").select("property_id", "pred1", "pred2")
    rows = load(spark, sf, "listing").join(evals, "property_id")
    out = investment.evaluate_investments(rows, load(spark, sf, "land"), F.col("input_date"))
    picked = out.select(
        "listing_id", "asset_value", "loan_years", "noi", "debt_service", "cash_flow", "dscr", "coc_return", "asset_ratio",
        "cashflow_score", "finance_score", "total_investment_score",
    )
    return rounded(picked, 2)


@query("value_score", f"""{cte("listing", "evaluation")}
select eval_id, round(case when price_yen > 0 then {_score("coalesce(pred2, 0) / (price_yen / 10000.0) * 50.0")} else 0 end, 6) as value_score,
  coalesce(pred1 > 0 and price_yen > 0 and pred1 >= price_yen / 10000.0, false) as passed
from evaluation e join listing l on e.property_id = l.property_id""")
def value_score(spark, sf):
    rows = load(spark, sf, "evaluation").select("property_id", "eval_id", "pred1", "pred2").join(
        load(spark, sf, "listing").select("property_id", "price_yen"), "property_id"
    )
    ask = F.col("price_yen") / 10000.0
    return rows.select(
        "eval_id",
        F.round(investment.simple_value_score(F.coalesce("pred2", F.lit(0)).cast("double"), ask), 6).alias("value_score"),
        screening.first_stage_passed(F.col("pred1"), ask).alias("passed"),
    )
