"""Queries over rule checks, audits and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystead import vocab
from keystead.functions import measure
from keystead.operators import aggregates, normalize, quality, repair, screening
from keystead.plans.registry import SPACE, asc, has, num, query, rex, trim
from keystead.plans.testbed import cte, load, table
from keystead.plans.text_queries import ROUTES_SQL

LISTING = cte("listing")


def joined_reasons(rules: list[tuple[str, str]]) -> str:
    """concat_ws over CASE arms, in rule order."""
    return "concat_ws(',', " + ", ".join(f"case when {c} then '{n}' end" for n, c in rules) + ")"


def _reasons(df):
    return df.withColumn("reasons", F.array_join("reasons", ","))


def _clean_sql(x):
    t = trim(x)
    return f"case when {x} is null or lower({t}) in ('none', '') then null else regexp_replace({t}, '{SPACE}+', ' ', 'g') end"


@query("clean_strings", f"""
select doc_id, length({_clean_sql("text")}) as n_clean, md5({_clean_sql("text")}) as clean_md5,
  {_clean_sql("lang")} as lang, {_clean_sql("source")} as source from documents""")
def clean_strings(spark, sf):
    docs = normalize.clean_strings(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
    return docs.select("doc_id", F.char_length("text").alias("n_clean"), F.md5("text").alias("clean_md5"), "lang", "source")


@query("clean_listing_text", f"""{LISTING}
select listing_id, {_clean_sql("madori")} as madori, {_clean_sql("biko")} as biko, coalesce({_clean_sql("property_name")}, case when property_name is not null then '' end) as property_name from listing""")
def clean_listing_text(spark, sf):
    rows = load(spark, sf, "listing").select("listing_id", "madori", "biko", "property_name")
    return normalize.clean_strings(rows, not_null=["property_name"])


def _blank(c):
    return f"coalesce({trim(c)}, '') = ''"


REQUIRED = [
    ("property_name", _blank("property_name")),
    ("price", f"(coalesce(price_yen, 0) = 0 and {_blank('price_text')})"),
    ("address", f"({_blank('address')} or address = '-')"),
]


@query("required_fields", f"""{LISTING}, r as (select listing_id, {joined_reasons(REQUIRED)} as reasons from listing)
select listing_id, reasons, reasons = '' as is_valid from r""")
def required_fields(spark, sf):
    checked = quality.apply_rules(load(spark, sf, "listing"), quality.required_rules())
    return _reasons(checked).select("listing_id", "reasons", "is_valid")


_EMPTY = "coalesce({}, '') = ''"
_KIND = "lower(property_type)"
STRICT = [
    ("name_empty", _EMPTY.format("property_name")),
    ("name_seo", has("property_name", vocab.SEO_PHRASES)),
    ("name_short", "length(property_name) = 1"),
    ("price_missing", "coalesce(price_yen, 0) <= 0"),
    ("price_scale", "price_yen > 0 and price_yen < 1000000"),
    ("address_empty", _EMPTY.format("address")),
    ("address_parts", f"({_EMPTY.format('address1')} or {_EMPTY.format('address2')})"),
    ("route_missing", f"({_EMPTY.format('railway1')} or {_EMPTY.format('station1')})"),
    ("railway_dirty", f"regexp_matches({asc('railway1')}, '徒歩|停歩|駅|[0-9]+分')"),
    ("station_dirty", "regexp_matches(station1, '[」』）「『]')"),
    ("walk_without_route", f"({_EMPTY.format('railway1')} or {_EMPTY.format('station1')}) and walk_min1 is not null"),
    ("area_missing", f"""case when contains({_KIND}, 'mansion') then coalesce(senyu_menseki, 0) <= 0
      when regexp_matches({_KIND}, 'tochi|kodate|invest|apartment') then coalesce(tochi_menseki, 0) <= 0 else false end"""),
    ("built_missing", f"(not contains({_KIND}, 'tochi')) and {_EMPTY.format('built_text')}"),
    ("built_incomplete", f"(not contains({_KIND}, 'tochi')) and regexp_matches(built_text, '昭和年|平成年|令和年')"),
]


@query("strict_reasons", f"""{cte("strict")}, r as (select listing_id, {joined_reasons(STRICT)} as reasons from strict)
select listing_id, reasons, nullif(split_part(reasons, ',', 1), '') as first_reason from r""")
def strict_reasons(spark, sf):
    rows = load(spark, sf, "strict")
    checked = rows.withColumn("r", quality.reasons(quality.strict_rules(rows)))
    return checked.select(
        "listing_id", F.array_join("r", ",").alias("reasons"), F.get("r", F.lit(0)).alias("first_reason")
    )


SCHEMA = [
    ("property_name_length", "coalesce(length(property_name), 0) < 1"),
    ("url_length", "coalesce(length(url), 0) < 1"),
    ("price_text_missing", "price_text is null"),
    ("price_range", "(price_yen is null or price_yen < 0 or price_yen > 100000000000)"),
    ("address_missing", "address is null"),
    ("senyu_range", "property_type = 'mansion' and (senyu_menseki <= 0 or senyu_menseki > 10000)"),
    ("kanrihi_negative", "property_type = 'mansion' and kanrihi < 0"),
    ("syuzen_negative", "property_type = 'mansion' and syuzen < 0"),
    ("tochi_menseki_negative", "property_type in ('kodate', 'tochi') and tochi_menseki < 0"),
    ("tatemono_menseki_negative", "property_type = 'kodate' and tatemono_menseki < 0"),
]


@query("schema_reasons", f"{LISTING} select listing_id, {joined_reasons(SCHEMA)} as reasons from listing")
def schema_reasons(spark, sf):
    rows = load(spark, sf, "listing")
    return _reasons(quality.apply_rules(rows, quality.schema_rules(rows))).select("listing_id", "reasons")


def _gap(c, applies="true"):
    return f"({applies}) and coalesce(cast({c} as string), '') = ''"


_INVEST = "regexp_matches(lower(property_type), 'invest|apartment')"
MISSING = [(c, _gap(c)) for c in ("property_name", "url", "price_yen", "address")]
MISSING += [(c, _gap(c, "property_type = 'mansion'")) for c in ("senyu_menseki", "madori")]
MISSING += [(c, _gap(c, "property_type = 'kodate'")) for c in ("tochi_menseki", "tatemono_menseki")]
MISSING += [(c, _gap(c, "property_type = 'tochi'")) for c in ("tochi_menseki", "kenpei", "youseki")]
MISSING += [
    (c, _gap(c, _INVEST))
    for c in ("gross_yield", "annual_rent", "monthly_rent", "current_status", "tochi_menseki", "tatemono_menseki")
]


@query("missing_fields", f"""{LISTING}, t as (select *, {num("translate(kenpei_text, '％%', '')", "([0-9.]+)")} as kenpei,
  {num("translate(youseki_text, '％%', '')", "([0-9.]+)")} as youseki, annual_rent / 12 as monthly_rent, rent_text as current_status from listing)
select listing_id, {joined_reasons(MISSING)} as missing from t""")
def missing_fields(spark, sf):
    rows = load(spark, sf, "listing").withColumns({
        "kenpei": measure.ratio_pct("kenpei_text"), "youseki": measure.ratio_pct("youseki_text"),
        "monthly_rent": F.col("annual_rent") / 12, "current_status": F.col("rent_text"),
    })
    return quality.reject_incomplete(rows).select("listing_id", F.array_join(F.map_keys("missing"), ",").alias("missing"))


MAIN_AREA = "coalesce(senyu_menseki, tatemono_menseki, tochi_menseki, {})"
CRITICAL = [
    ("price", "coalesce(price_yen, 0) / 10000.0 < 100"),
    ("area", f"{MAIN_AREA.format(0)} <= 5"),
    ("apartment_area", f"property_type = 'apartment' and {MAIN_AREA.format(0)} < 15"),
]
WARNING = [("frontage_zero", "property_type in ('tochi', 'kodate', 'invest_kodate') and coalesce(maguchi, 0) <= 0")]
ANOMALY = f"""anomaly as (select *, {joined_reasons(CRITICAL + WARNING)} as reasons, {joined_reasons(CRITICAL)} <> '' as is_critical
  from listing where url <> '')"""


@query("anomalies", f"""{LISTING}, {ANOMALY}
select listing_id, company, property_type, reasons, is_critical, round({MAIN_AREA.format(0)}, 3) as area_used from anomaly where reasons <> ''""")
def anomalies(spark, sf):
    return _reasons(quality.anomaly_scan(load(spark, sf, "listing"))).select(
        "listing_id", "company", "property_type", "reasons", "is_critical", F.round("area_used", 3).alias("area_used")
    )


BOTH = cte("listing", "evaluation")


@query("invalidate", f"""{BOTH}, {ANOMALY}
select eval_id, case when a.url is not null then 0 else pred1 end as pred1, case when a.url is not null then 0 else pred2 end as pred2,
  (a.url is not null) or is_notified as is_notified
from evaluation e left join (select distinct url from anomaly where is_critical) a on e.property_url = a.url""")
def invalidate(spark, sf):
    bad = quality.anomaly_scan(load(spark, sf, "listing"))
    return quality.invalidate_predictions(load(spark, sf, "evaluation"), bad).select("eval_id", "pred1", "pred2", "is_notified")


HEAL_DAY = "1998-07-03"


@query("heal_targets", f"""{BOTH}, j as (select l.*, e.analyzed_at,
  case when l.price_yen <> 0 and l.price_yen < 1000000 then 'price_small' when tatemono_menseki <> 0 and tatemono_menseki < 5 then 'building_small'
    when tochi_menseki <> 0 and tochi_menseki < 5 then 'land_small' when maguchi = 0 and setsudou <> '' then 'frontage_unparsed' end as reason
  from evaluation e join listing l on e.company = l.company and e.property_type = l.property_type and e.property_id = l.property_id
  where e.analyzed_at >= timestamp '{HEAL_DAY}' - interval 3 day)
select distinct url, company, property_type, property_name, price_yen, reason, strftime(analyzed_at, '%Y-%m-%d') as analyzed from j where reason is not null""")
def heal_targets(spark, sf):
    found = quality.heal_targets(
        load(spark, sf, "evaluation"), load(spark, sf, "listing"), F.lit(HEAL_DAY).cast("timestamp_ntz")
    )
    return found.withColumn("analyzed", F.date_format("analyzed_at", "yyyy-MM-dd")).drop("analyzed_at")


BEST_PRED = "coalesce(nullif(pred2, 0), nullif(pred1, 0), 0)"


PREDICTION_ERRORS_SQL = f"""{BOTH}, j as (select eval_id, {BEST_PRED} as predicted, price_yen / 10000.0 as actual
  from evaluation e join listing l on e.property_id = l.property_id), r as (select *, (predicted - actual) / actual as ratio from j where actual > 0)
select eval_id, round(ratio, 4) as error_ratio from r where abs(ratio) >= 0.3"""


@query("prediction_errors", PREDICTION_ERRORS_SQL)
def prediction_errors(spark, sf):
    evals = load(spark, sf, "evaluation").select("property_id", "eval_id", "pred1", "pred2")
    rows = evals.join(load(spark, sf, "listing").select("property_id", "price_yen"), "property_id").select(
        "eval_id", screening.best_prediction().alias("predicted"), (F.col("price_yen") / F.lit(10000.0)).alias("actual")
    )
    return quality.prediction_errors(rows).select("eval_id", F.col("error_ratio").cast("double").alias("error_ratio"))


_AUDITED = ["address", "biko", "madori", "property_name", "traffic", "url"]


@query("text_audit", f"""{LISTING}, u as ({" union all ".join(f"select listing_id as row_key, '{c}' as field, {c} as value from listing" for c in _AUDITED)})
select 'listing' as table_name, row_key, field, value from u where regexp_matches(value, 'None|none|  ') order by row_key, field limit 50""")
def text_audit(spark, sf):
    return quality.text_audit(load(spark, sf, "listing").select("listing_id", *_AUDITED), "listing_id", "listing")


_SPLIT = "string_split_regex(comb, '[／/]')"
_PCT = "translate({}, '％%', '')"


@query("ratio_repair", f"""{cte("ratio_rows")}, t as (select *,
  (kenpei is null and coalesce(kenpei_text, '') <> '') or (youseki is null and coalesce(youseki_text, '') <> '') as repaired,
  case when regexp_matches(kenpei_text, '[／/]') then kenpei_text when regexp_matches(youseki_text, '[／/]') then youseki_text end as comb from ratio_rows),
s as (select *, case when repaired then coalesce({trim(f"{_SPLIT}[1]")}, kenpei_text) else kenpei_text end as kt,
  case when repaired then coalesce({trim(f"{_SPLIT}[2]")}, youseki_text) else youseki_text end as yt from t)
select listing_id, repaired, kt as kenpei_text, yt as youseki_text,
  case when repaired and kt <> '' then {num(_PCT.format("kt"), "([0-9.]+)")} else kenpei end as kenpei,
  case when repaired and yt <> '' then {num(_PCT.format("yt"), "([0-9.]+)")} else youseki end as youseki from s""")
def ratio_repair(spark, sf):
    rows = repair.repair_ratios(load(spark, sf, "ratio_rows"))
    return rows.withColumns({c: F.col(c).cast("double") for c in ("kenpei", "youseki")})


@query("route_repair", f"""{cte("listing", "route_rows").replace("with ", "with recursive ", 1)}, {ROUTES_SQL}
select r.listing_id, (railway1 is null and coalesce(r.traffic, '') <> '') as repaired,
  case when railway1 is null and coalesce(r.traffic, '') <> '' then f.railway else railway1 end as railway1,
  case when railway1 is null and coalesce(r.traffic, '') <> '' then f.station else station1 end as station1,
  case when railway1 is null and coalesce(r.traffic, '') <> '' then f.walk_min else walk_min1 end as walk_min1
from route_rows r left join (select * from route where idx = 1) f on r.listing_id = f.listing_id""")
def route_repair(spark, sf):
    return repair.repair_routes(load(spark, sf, "route_rows")).drop("traffic")


@query("null_sample", f"""{LISTING}
select company, property_type, listing_id from (select *, row_number() over (partition by company, property_type order by listing_id) as rn
  from listing where maguchi is null) where rn <= 5""")
def null_sample(spark, sf):
    rows = load(spark, sf, "listing").select("company", "property_type", "listing_id", "maguchi")
    return repair.missing_value_sample(rows, "maguchi", ["company", "property_type"], "listing_id").drop("maguchi")


_CODES = "|".join(vocab.COMPANY_CODES)


@query("recover_source", f"""{cte("coded")}, t as (select *, company = 'unknown' and regexp_matches(lower(property_type), '^({_CODES})(.+)$') as hit from coded)
select eval_id, hit as recovered, case when hit then regexp_extract(lower(property_type), '^({_CODES})(.+)$', 1) else company end as company,
  case when hit then regexp_extract(lower(property_type), '^({_CODES})(.+)$', 2) else property_type end as property_type from t""")
def recover_source(spark, sf):
    return repair.recover_source(load(spark, sf, "coded"))


@query("type_detect", f"""{cte("listing", "coded")}, t as (select listing_id, case when listing_id % 3 = 0 then c.property_type end as declared,
  senyu_menseki, tatemono_menseki, tochi_menseki, gross_yield, maguchi from listing l join coded c on c.eval_id = l.listing_id + 1)
select listing_id, case when contains(lower(declared), 'mansion') then 'mansion' when contains(lower(declared), 'kodate') then 'kodate'
  when contains(lower(declared), 'apartment') then 'apartment' when contains(lower(declared), 'tochi') then 'tochi'
  when senyu_menseki is not null then 'mansion' when tatemono_menseki is not null and gross_yield is not null then 'apartment'
  when tatemono_menseki is not null then 'kodate' when tochi_menseki is not null or maguchi is not null then 'tochi' else 'mansion' end as kind,
  case when contains(lower(declared), 'kodate') then 'kodate' when contains(lower(declared), 'apartment') then 'apartment' else 'mansion' end as scoring
from t""")
def type_detect(spark, sf):
    coded = load(spark, sf, "coded").select((F.col("eval_id") - 1).alias("listing_id"), F.col("property_type").alias("declared"))
    rows = load(spark, sf, "listing").select(
        "listing_id", "senyu_menseki", "tatemono_menseki", "tochi_menseki", "gross_yield", "maguchi"
    ).join(coded, "listing_id").withColumn("declared", F.when(F.col("listing_id") % 3 == 0, F.col("declared")))
    return rows.select(
        "listing_id", repair.detect_type(rows, "declared").alias("kind"),
        repair.scoring_type(F.col("declared")).alias("scoring"),
    )


@query("null_profile", f"""{LISTING}
select company, property_type, count(*) as total, count(*) filter (where senyu_menseki is null or senyu_menseki = 0) as null_senyu_menseki,
  count(*) filter (where maguchi is null or maguchi = 0) as null_maguchi, cast(-1 as bigint) as null_soukosu from listing group by 1, 2""")
def null_profile(spark, sf):
    return quality.null_profile(
        load(spark, sf, "listing"), ["senyu_menseki", "maguchi", "soukosu"], ["company", "property_type"]
    )


@query("success_rate", f"""{LISTING}, r as (select *, {joined_reasons(REQUIRED)} = '' as ok from listing)
select company, count(*) as total, count(*) filter (where ok) as passed, round(count(*) filter (where ok) / count(*), 6) as rate from r group by company""")
def success_rate(spark, sf):
    checked = quality.apply_rules(load(spark, sf, "listing"), quality.required_rules())
    return aggregates.success_rate(checked, ["company"]).withColumn("rate", F.round("rate", 6))


@query("random_sample", f"""{LISTING}
select company, listing_id from (select *, row_number() over (partition by company order by md5(url || '42'), url) as rn from listing) where rn <= 10""")
def random_sample(spark, sf):
    rows = load(spark, sf, "listing").select("company", "url", "listing_id")
    return repair.random_sample(rows, ["company"], "url").drop("url")
