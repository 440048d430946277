"""Queries over screening, reports, writes and duplicate links."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystead import vocab
from keystead.models import cleaning, training
from keystead.operators import aggregates, dedup, lookups, quality, repair, screening, upsert
from keystead.plans.quality_queries import ANOMALY, BEST_PRED, MAIN_AREA
from keystead.plans.registry import has, query, trim
from keystead.plans.testbed import cte, load, table
from keystead.plans.text_queries import AGE_SQL, canonical_sql
from keystead.plans.value_queries import NUDGE, TRADE_SQL, priced_listings, rounded
from keystead.session import scratch_path, stage
from keystead.sources import logs
from keystead.sources.tables import union_sources

BOTH = cte("listing", "evaluation")
DONE = "analysis_status = 'completed' and duplicate_of is null"

STATS_SQL = f"""scores as (select true as is_investment, total_investment_score as s from evaluation where {DONE} and total_investment_score is not null
  union all select false, investment_score from evaluation where {DONE} and investment_score is not null),
stats as (select is_investment, avg(s) as mean,
  case when stddev_pop(s) > 0 then stddev_pop(s) else 12.0 end as sd, count(*) as n from scores group by 1)"""


@query("score_stats", f"""{cte("evaluation")}, {STATS_SQL}
select is_investment, round(mean, 6) as mean, round(sd, 6) as sd, n from stats""")
def score_stats(spark, sf):
    return rounded(aggregates.score_statistics(load(spark, sf, "evaluation")))


@query("t_score", f"""{cte("evaluation")}, {STATS_SQL}, e as (select *, contains(lower(property_type), 'invest') as inv,
  case when contains(lower(property_type), 'invest') then total_investment_score else investment_score end as sc from evaluation),
t as (select eval_id, inv, is_notified, case when coalesce(sc, 0) <> 0 then 50.0 + 10.0 * (sc - mean) / sd else 0.0 end as t from e left join stats on inv = stats.is_investment)
select eval_id, inv as is_investment, round(t, 6) as t_score, t >= 65.0 and not is_notified as is_top from t""")
def t_score(spark, sf):
    out = screening.with_t_score(load(spark, sf, "evaluation"), alert_at=65.0)
    return rounded(out.select("eval_id", "is_investment", "t_score", "is_top"), keys=("eval_id",))


@query("validity_report", f"""{BOTH}, r as (select price_yen / 10000.0 as a, cast(pred2 as double) as p, {MAIN_AREA.format(10)} as area from evaluation e join listing l on e.property_id = l.property_id),
f as (select (a - p) / p as e from r where a >= 100 and a < 30000 and p > 0 and area >= 10),
m as (select count(*) as n, avg(e) as mu, stddev_pop(e) as sd from f),
s as (select any_value(n) as n, any_value(mu) as mu, any_value(sd) as sd, avg(pow((e - mu) / sd, 3)) as sk, avg(pow((e - mu) / sd, 4)) - 3 as ku from f, m)
select n, round(mu, 6) as mean_error, round(sd, 6) as sd_error, round(sk, 6) as skewness, round(ku, 6) as kurtosis,
  abs(mu) <= 0.05 and abs(sk) <= 1 and abs(ku) <= 2 as is_normal from s""")
def validity_report(spark, sf):
    rows = load(spark, sf, "evaluation").select("property_id", "pred2").join(
        load(spark, sf, "listing").select("property_id", "price_yen", "senyu_menseki", "tatemono_menseki", "tochi_menseki"), "property_id"
    )
    shaped = rows.select(
        (F.col("price_yen") / 10000.0).alias("asking_man"), F.col("pred2").cast("double").alias("predicted_man"),
        quality.main_area(rows, None).alias("area"),
    )
    return rounded(aggregates.validity_report(shaped))


# --- crawl reports ------------------------------------------------------------------------

NOW = "2024-01-30 12:00:00"


@query("counts_24h", f"""{cte("crawl")} select company, property_type, count(*) as n from crawl where ts >= timestamp '{NOW}' - interval 24 hour group by 1, 2 order by 1, 2""")
def counts_24h(spark, sf):
    return aggregates.recent_counts(load(spark, sf, "crawl"), "ts", F.lit(NOW).cast("timestamp"), ["company", "property_type"])


_JOBS = "jobs as (select company, property_type, min(ts) + interval 10 day as started_at from crawl group by 1, 2)"


@query("counts_since_start", f"""{cte("crawl")}, {_JOBS}
select j.company, j.property_type, count(c.event_id) as n from jobs j left join crawl c on j.company = c.company and j.property_type = c.property_type and c.ts >= j.started_at group by 1, 2""")
def counts_since_start(spark, sf):
    rows = load(spark, sf, "crawl")
    jobs = rows.groupBy("company", "property_type").agg((F.min("ts") + F.expr("INTERVAL 10 DAYS")).alias("started_at"))
    return aggregates.counts_since_start(rows, jobs, "ts").drop("started_at")


_STATUS = "case arg_min(event_type, event_id) when 'error' then 'error' when 'signup' then 'timeout' when 'purchase' then 'failed' else 'success' end"


@query("job_summary", f"""with j as (select user_id, {_STATUS} as status from events group by 1)
select count(*) as total_jobs, count(*) filter (where status = 'success') as success_jobs, count(*) filter (where status in ('failed', 'timeout', 'error')) as failed_jobs from j""")
def job_summary(spark, sf):
    first = F.min_by("event_type", "event_id")
    jobs = table(spark, sf, "events").groupBy("user_id").agg(first.alias("first")).withColumn(
        "status",
        F.when(F.col("first") == "error", "error").when(F.col("first") == "signup", "timeout")
        .when(F.col("first") == "purchase", "failed").otherwise("success"),
    )
    return aggregates.job_summary(jobs)


ERROR_REPORT_SQL = f"""{cte("crawl")}, e as (select company || '_' || property_type as company_type, ts from crawl where status = 'FAILURE')
select company_type, count(*) as total, count(*) filter (where ts >= timestamp '{NOW}' - interval 24 hour) as recent_24h, grouping(company_type) = 1 as is_total,
  grouping(company_type) = 1 and count(*) filter (where ts >= timestamp '{NOW}' - interval 24 hour) >= 5 as alert from e group by rollup (company_type)"""


@query("error_report", ERROR_REPORT_SQL)
def error_report(spark, sf):
    errors = load(spark, sf, "crawl").filter("status = 'FAILURE'").withColumn(
        "company_type", F.concat_ws("_", "company", "property_type")
    )
    return aggregates.error_report(errors, F.lit(NOW).cast("timestamp"))


@query("report_file", ERROR_REPORT_SQL)
def report_file(spark, sf):
    """The error report, written as a JSON report and read back."""
    path, report = scratch_path(spark, "report"), error_report(spark, sf)
    logs.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query("daily_budget", """select event_id, case when row_number() over (partition by cast(ts as date) order by ts, event_id) <= 200 then 'processing' else 'skipped_by_budget' end as budget_status from events""")
def daily_budget(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "ts")
    return screening.daily_budget(rows, "ts", "event_id").select("event_id", "budget_status")


# --- recommendations -----------------------------------------------------------------------

_CODE = "replace(lower({}), '_', '')"
_APT = f"{_CODE.format('e.property_type')} in (" + ", ".join(f"'{c}'" for c in vocab.APARTMENT_CODES) + ")"
RECOMMEND_SQL = f"""cand as (select eval_id, e.property_type, {_APT} as apt, cast(floor(price_yen / 10000) as bigint) as asking_man, cast({BEST_PRED} as double) as best_pred,
    coalesce(nullif(e.investment_score, 0), nullif(e.total_investment_score, 0), 0.0) as score, property_name
  from evaluation e join listing l on e.property_id = l.property_id where not e.is_notified and price_yen > 0),
gap as (select *, case when best_pred > 0 then (best_pred - asking_man) / best_pred * 100.0 end as d from cand),
rec as (select *, case when apt then (case when score >= 60 then 'score' end) when d >= 15 and d < 40 then 'discount' end as reason,
  coalesce((not apt) and (d >= 40 or d <= -40), false) as suspect from gap)"""


def evaluated(spark, sf):
    listing = load(spark, sf, "listing").select("property_id", "price_yen", "property_name")
    return load(spark, sf, "evaluation").join(listing, "property_id")


@query("recommend", f"""{BOTH}, {RECOMMEND_SQL}
select eval_id, asking_man, round(d, 4) as discount_pct, reason as recommend_reason, suspect as suspect_error from rec""")
def recommend(spark, sf):
    out = screening.recommend(evaluated(spark, sf)).select(
        "eval_id", F.col("asking_man").cast("bigint").alias("asking_man"), "discount_pct", "recommend_reason", "suspect_error"
    )
    return rounded(out, 4, ("eval_id",))


_K = _CODE.format("property_type")


@query("routes", f"""{cte("listing", "evaluation")}, t as (select eval_id, case when eval_id % 10 = 0 then 'investment' else e.property_type end as property_type, property_name, e.company from evaluation e join listing l on e.property_id = l.property_id)
select eval_id, case when property_type in ('invest_apartment', 'apartment') then 'apartment' when property_type in ('invest_kodate', 'mansion', 'kodate', 'tochi') then property_type else 'general' end as alert_route,
  case when {_K} in ('mansion', 'kodate', 'tochi') then {_K} when {_K} in ('investapartment', 'investmentapartment', 'apartment') then 'invest_apartment'
    when {_K} in ('investkodate', 'investmentkodate') then 'invest_kodate' when {_K} = 'investment' and {has("lower(property_name)", ["アパート", "マンション", "一棟"])} then 'invest_apartment'
    when {_K} = 'investment' then 'invest_kodate' else 'default' end as recommend_route,
  case when contains(company || '_' || property_type, 'mansion') then 'mansion' when contains(property_type, 'kodate') and contains(property_type, 'invest') then 'invest_kodate'
    when contains(property_type, 'kodate') then 'kodate' when contains(property_type, 'tochi') then 'tochi' when contains(property_type, 'apartment') then 'apartment' else 'general' end as error_route from t""")
def routes(spark, sf):
    rows = evaluated(spark, sf).withColumn(
        "property_type", F.when(F.col("eval_id") % 10 == 0, "investment").otherwise(F.col("property_type"))
    )
    return rows.select(
        "eval_id", screening.alert_route("property_type").alias("alert_route"),
        screening.recommend_route("property_type", "property_name").alias("recommend_route"),
        screening.error_route(F.concat_ws("_", "company", "property_type")).alias("error_route"),
    )


def _shown(c):
    t = trim(f"cast({c} as string)")
    return f"(case when {c} is null or lower({t}) in ('none', '') then '-' else {t} end)"


def _known(c, label=""):
    return f"case when {_shown(c)} <> '-' then '{label}' || {_shown(c)} end"


_LABEL = "(case property_type " + " ".join(f"when '{k}' then '{v}'" for k, v in vocab.TYPE_LABELS.items()) + " else property_type end)"
_ACCESS = f"concat_ws(' ', {_known('railway1')}, {_known('station1')}, {_known('walk_min1_str')})"
_AREAS = f"concat_ws(' / ', {_known('senyu_menseki_text', '専有面積: ')}, {_known('tochi_menseki_text', '土地面積: ')}, {_known('tatemono_menseki_text', '建物面積: ')})"


@query("display_card", f"""{cte("sited")}, t as (select *, cast(null as string) as railway1, cast(walk_min1 as string) as walk_min1_str from sited)
select listing_id, {_shown("property_name")} || ' (' || {_LABEL} || ')' as card_title, case when {_ACCESS} <> '' then {_ACCESS} else {_shown("traffic")} end as card_access,
  case when {_AREAS} <> '' then {_AREAS} else '-' end as card_area, {_shown("address")} as card_address, {_shown("madori")} as card_layout, {_shown("built_text")} as card_built,
  {_shown("kenpei_text")} || ' / ' || {_shown("youseki_text")} as card_ratios, strftime(input_ts, '%Y-%m-%d %H:%M:%S') as card_published from t""")
def display_card(spark, sf):
    rows = load(spark, sf, "sited").withColumns({
        "railway1": F.lit(None).cast("string"), "walk_min1_str": F.col("walk_min1").cast("string")
    })
    out = screening.display_card(rows)
    return out.select("listing_id", *[c for c in out.columns if c.startswith("card_")])


@query("route_digest", f"""{cte("listing")}, {ANOMALY}, a as (select listing_id, property_type as route from anomaly where reasons <> ''),
n as (select *, row_number() over (partition by route order by listing_id) as rn, count(*) over (partition by route) as total from a)
select route, listing_id, total, greatest(0, total - 10) as others from n where rn <= 10""")
def route_digest(spark, sf):
    items = quality.anomaly_scan(load(spark, sf, "listing")).select("listing_id", F.col("property_type").alias("route"))
    return screening.route_digest(items, "route", [F.col("listing_id")]).withColumn("others", F.col("others").cast("bigint"))


# --- joins with evaluations ------------------------------------------------------------------

_NORM = "regexp_replace(replace(lower({}), '_', ''), '^investment', 'invest')"


@query("evaluation_listing", f"""{BOTH}, l2 as (select *, case when property_type = 'kodate' and listing_id % 20 < 2 then 'invest_kodate' else property_type end as pt from listing)
select e.eval_id, l.listing_id, l.price_yen from evaluation e join l2 l on e.company = l.company and e.property_id = l.property_id and {_NORM.format("e.property_type")} = {_NORM.format("l.pt")}""")
def evaluation_listing(spark, sf):
    listing = load(spark, sf, "listing").withColumn(
        "property_type",
        F.when((F.col("property_type") == "kodate") & (F.col("listing_id") % 20 < 2), "invest_kodate").otherwise(F.col("property_type")),
    ).select("company", "property_type", "property_id", "listing_id", "price_yen")
    return lookups.with_listing(load(spark, sf, "evaluation"), listing).select("eval_id", "listing_id", "price_yen")


@query("image_scores", f"""{BOTH} select listing_id, coalesce(e.interior_score, 3.0) as interior_score, coalesce(e.layout_score, 3.0) as layout_score
from listing l left join evaluation e on l.url = e.property_url""")
def image_scores(spark, sf):
    rows = load(spark, sf, "listing").select("listing_id", "url")
    return lookups.with_image_scores(rows, load(spark, sf, "evaluation")).drop("url")


@query("training_rows", f"""{BOTH} select listing_id from listing where price_yen > 0 and coalesce(url, '') <> '' and url not in (select property_url from evaluation where duplicate_of is not null)""")
def training_rows(spark, sf):
    rows = screening.eligible(load(spark, sf, "listing").select("listing_id", "url", "price_yen"))
    return lookups.without_duplicates(rows, load(spark, sf, "evaluation")).select("listing_id")


@query("needs_evaluation", f"""{BOTH} select listing_id, 'predicted' as rule from listing where url not in (select property_url from evaluation where pred1 is not null)
union all select listing_id, 'staged' from listing where url not in (select property_url from evaluation where pred1 is not null and (pred2 is not null or not is_first_stage_passed))""")
def needs_evaluation(spark, sf):
    rows, evals = load(spark, sf, "listing").select("listing_id", "url"), load(spark, sf, "evaluation")
    parts = [
        screening.needs_evaluation(rows, evals, rule).select("listing_id", F.lit(rule).alias("rule")) for rule in ("predicted", "staged")
    ]
    return parts[0].unionByName(parts[1])


# --- writes ------------------------------------------------------------------------------------

@query("upsert_land_prices", f"""{cte("land", "trade")}, {TRADE_SQL}, m as (select prefecture, city, land_use, cast(floor(avg(unit)) as bigint) as average
  from trade_unit where city <> '' and land_use is not null and unit between 10000 and 10000000 group by 1, 2, 3),
n as (select *, cast(floor(average * 0.8) as bigint) as rosenka, cast(floor(average * 0.7) as bigint) as fixed_asset from m)
select coalesce(n.prefecture, o.prefecture) as prefecture, coalesce(n.city, o.city) as city, coalesce(n.land_use, o.land_use) as land_use,
  case when n.city is not null then n.average else o.average end as average, case when n.city is not null then n.rosenka else o.rosenka end as rosenka,
  case when n.city is not null then n.fixed_asset else o.fixed_asset end as fixed_asset, o.growth
from land o full join n on o.prefecture = n.prefecture and o.city = n.city and o.land_use = n.land_use""")
def upsert_land_prices(spark, sf):
    fresh = aggregates.trades_to_land_prices(load(spark, sf, "trade"), F.col("prefecture")).drop("n")
    return upsert.upsert(load(spark, sf, "land").drop("land_id"), fresh, ["prefecture", "city", "land_use"])


@query("latest_stations", f"""{cte("station")} select railway_line, station_name, max(station_id) as station_id, arg_max(passenger_volume, station_id) as passenger_volume from station group by 1, 2""")
def latest_stations(spark, sf):
    return upsert.latest_per_key(load(spark, sf, "station"), ["station_name", "railway_line"], ["station_id"])


@query("insert_absent", f"""{BOTH} select property_url, max(src) as src from (select property_url, 'old' as src from evaluation where pred1 is not null
  union all select url, 'new' from listing where url not in (select property_url from evaluation where pred1 is not null)) group by 1""")
def insert_absent(spark, sf):
    old = load(spark, sf, "evaluation").filter("pred1 IS NOT NULL").select("property_url", F.lit("old").alias("src"))
    new = load(spark, sf, "listing").select(F.col("url").alias("property_url"), F.lit("new").alias("src"))
    return upsert.insert_absent(old, new, ["property_url"])


@query("delete_cascade", f"""{cte("coded")}, alive as (select eval_id from coded where company <> 'unknown' and eval_id > 280)
select 'evaluation' as kind, eval_id, '' as category from alive union all select 'image', eval_id, c from alive, (select unnest(['layout', 'exterior']) as c) x""")
def delete_cascade(spark, sf):
    parents = load(spark, sf, "coded")
    children = parents.select("eval_id", F.explode(F.array(F.lit("layout"), F.lit("exterior"))).alias("category"))
    kept, images = upsert.delete_cascade(parents, children, upsert.stale_evaluations(280), "eval_id", "eval_id")
    return kept.select(F.lit("evaluation").alias("kind"), "eval_id", F.lit("").alias("category")).unionByName(
        images.select(F.lit("image").alias("kind"), "eval_id", "category")
    )


@query("union_sources", """
select 'first' as company, 'mansion' as property_type, o_orderkey as source_id, o_orderpriority as note, cast(null as double) as balance from orders
union all select 'second', 'kodate', s_suppkey, null, s_acctbal from supplier
union all select 'third', 'tochi', c_custkey, c_mktsegment, c_acctbal from customer""")
def union_sources_query(spark, sf):
    o, s, c = (table(spark, sf, t) for t in ("orders", "supplier", "customer"))
    return union_sources({
        ("first", "mansion"): o.select(F.col("o_orderkey").alias("source_id"), F.col("o_orderpriority").alias("note")),
        ("second", "kodate"): s.select(F.col("s_suppkey").alias("source_id"), F.col("s_acctbal").alias("balance")),
        ("third", "tochi"): c.select(
            F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("note"), F.col("c_acctbal").alias("balance")
        ),
    })


# --- set operations and limits ---------------------------------------------------------------------

@query("latest_evaluations", f"{cte('evaluation')} select eval_id, property_url from evaluation order by eval_id desc limit 1000")
def latest_evaluations(spark, sf):
    return load(spark, sf, "evaluation").select("eval_id", "property_url").orderBy(F.col("eval_id").desc()).limit(1000)


@query("ratio_gaps", f"""{cte("ratio_rows")} select listing_id from ratio_rows where kenpei is null and coalesce(kenpei_text, '') <> ''
union select listing_id from ratio_rows where youseki is null and coalesce(youseki_text, '') <> ''""")
def ratio_gaps(spark, sf):
    return load(spark, sf, "ratio_rows").filter(repair.needs_ratio_repair()).select("listing_id").distinct()


@query("other_urls", f"""{BOTH} select distinct url from listing where url not in (select property_url from evaluation where is_notified)""")
def other_urls(spark, sf):
    notified = load(spark, sf, "evaluation").filter("is_notified").select(F.col("property_url").alias("url"))
    return load(spark, sf, "listing").select("url").exceptAll(notified)


# --- training rows ---------------------------------------------------------------------------------

TRAIN_SQL = f"""{AGE_SQL}, tr as (select listing_id, property_type, price_yen / 10000.0 as price, age_years,
  case property_type when 'tochi' then tochi_menseki when 'mansion' then senyu_menseki else tatemono_menseki end as area from aged)"""


def training_frame(spark, sf):
    return priced_listings(spark, sf).select(
        "listing_id", "property_type", F.col("price_man").alias("price"), "age_years", aggregates.unit_area().alias("area"),
        F.col("tochi_menseki").alias("land_area"),
    )


@query("quantiles", f"""{cte("listing")}, {TRAIN_SQL}
select property_type, round(quantile_cont(price, 0.25), 6) as q0, round(quantile_cont(price, 0.5), 6) as q1, round(quantile_cont(price, 0.75), 6) as q2, round(quantile_cont(price, 0.99), 6) as q3 from tr group by 1""")
def quantiles(spark, sf):
    q = aggregates.exact_quantiles(training_frame(spark, sf), ["property_type"], "price", [0.25, 0.5, 0.75, 0.99])
    return rounded(q)


def _bounds(source, value):
    lo, hi = f"quantile_cont({value}, 0.25)", f"quantile_cont({value}, 0.75)"
    return f"""select s.* from {source} s join (select property_type, {lo} - 2.5 * ({hi} - {lo}) as b, {hi} + 2.5 * ({hi} - {lo}) as t from {source} group by 1) q
  on s.property_type = q.property_type where {value} between b and t"""


@query("iqr_clean", f"""{cte("listing")}, {TRAIN_SQL}, lim as (select * from tr where price > 50 and area > 5 and age_years >= 0 and age_years < 100),
p1 as ({_bounds("lim", "price")}), p2 as ({_bounds("p1", "area")}) select listing_id from p2""")
def iqr_clean(spark, sf):
    return cleaning.iqr_clean(training_frame(spark, sf)).select("listing_id")


@query("isolation_forest")
def isolation_forest(spark, sf):
    rows = stage(cleaning.iqr_clean(training_frame(spark, sf)), "iqr")
    return cleaning.drop_forest_outliers(rows, "listing_id").select("listing_id", "property_type", "price", "area")


PRED_SQL = f"""pr as (select eval_id % 5 as fold, cast({BEST_PRED} as double) as p, price_yen / 10000.0 as y, l.property_type, address2 as city, analyzed_at from evaluation e join listing l on e.property_id = l.property_id where price_yen is not null)"""


def predictions(spark, sf):
    evals = load(spark, sf, "evaluation").select("property_id", "eval_id", "pred1", "pred2", "analyzed_at")
    listing = load(spark, sf, "listing").select("property_id", "property_type", "address2", "price_yen")
    return evals.join(listing, "property_id").filter("price_yen IS NOT NULL").select(
        (F.col("eval_id") % 5).alias("fold"), screening.best_prediction().alias("predicted"),
        (F.col("price_yen") / 10000.0).alias("actual"), "property_type", F.col("address2").alias("city"), "analyzed_at",
    )


@query("regression_metrics", f"""{BOTH}, {PRED_SQL}, f as (select fold, avg(abs(((case when y = 0 then 1.0 else y end) - p) / (case when y = 0 then 1.0 else y end))) * 100 as mape,
  avg(abs(y - p)) as mae, 1 - avg((y - p) * (y - p)) / var_pop(y) as r2, count(*) as n from pr group by fold)
select round(avg(mape), 3) as mape, round(avg(mae), 4) as mae, round(avg(r2), 6) as r2, cast(sum(n) as bigint) as n, count(*) as folds from f""")
def regression_metrics(spark, sf):
    out = aggregates.regression_metrics(predictions(spark, sf))
    return out.withColumns({"mape": F.round("mape", 3), "mae": F.round("mae", 4), "r2": F.round("r2", 6)})


def _fold_sql(pred, name):
    rel = "abs(((case when y = 0 then 1.0 else y end) - p) / (case when y = 0 then 1.0 else y end))"
    return f"""{name}_f as (select property_type, fold, avg({rel}) * 100 as mape, avg(abs(y - p)) as mae, 1 - avg((y - p) * (y - p)) / nullif(var_pop(y), 0) as r2
    from (select *, cast({pred} as double) as p from ev where {pred} is not null) x group by 1, 2),
  {name} as (select property_type, avg(mape) as mape, avg(mae) as mae, avg(r2) as r2 from {name}_f group by 1)"""


@query("champions", f"""{BOTH}, ev as (select eval_id % 5 as fold, pred1, pred2, price_yen / 10000.0 as y, l.property_type from evaluation e join listing l on e.property_id = l.property_id where price_yen is not null),
{_fold_sql("pred1", "a")}, {_fold_sql("pred2", "b")}
select coalesce(a.property_type, b.property_type) as property_type, round(a.mape, 3) as champion_mape, round(a.mae, 4) as champion_mae, round(a.r2, 6) as champion_r2, round(b.mape, 3) as challenger_mape, round(b.mae, 4) as challenger_mae,
  round(b.r2, 6) as challenger_r2, case when b.mape < a.mape or (a.mape is null and b.mape is not null) then 'challenger' else 'champion' end as winner from a full join b on a.property_type = b.property_type""")
def champions(spark, sf):
    """Stored predictions of two model generations over the same folds."""
    evals = load(spark, sf, "evaluation").select("property_id", "eval_id", "pred1", "pred2")
    rows = evals.join(load(spark, sf, "listing").select("property_id", "property_type", "price_yen"), "property_id").filter("price_yen IS NOT NULL")

    def metrics(pred):
        known = rows.filter(F.col(pred).isNotNull()).select(
            "property_type", (F.col("eval_id") % 5).alias("fold"), F.col(pred).cast("double").alias("predicted"), (F.col("price_yen") / 10000.0).alias("actual")
        )
        return aggregates.regression_metrics(known, ["property_type"])

    out = training.better_models(metrics("pred1"), metrics("pred2"), ["property_type"])
    return out.withColumns({f"{s}_{c}": F.round(f"{s}_{c}", d) for s in ("champion", "challenger") for c, d in (("mape", 3), ("mae", 4), ("r2", 6))})


@query("errors_by_period", f"""{BOTH}, {PRED_SQL}
select property_type, city, strftime(date_trunc('month', analyzed_at), '%Y-%m') as period, round(avg(abs((y - p) / y)) * 100 + {NUDGE}, 4) as mape, round(avg(abs(y - p)) + {NUDGE}, 4) as mae, count(*) as n from pr where y > 0 group by 1, 2, 3""")
def errors_by_period(spark, sf):
    out = aggregates.errors_by_period(predictions(spark, sf), "analyzed_at").drop("r2")
    stepped = {c: F.col(c) + NUDGE for c in ("mape", "mae")}
    return rounded(out.withColumns({**stepped, "period": F.date_format("period", "yyyy-MM")}), 4)


@query("unit_target", f"""{cte("listing")}, {TRAIN_SQL}
select listing_id, round(ln(1 + price / area), 6) as label, round((exp(ln(1 + price / area)) - 1) * area, 3) as price_back from tr where area > 0 and price is not null""")
def unit_target(spark, sf):
    rows = training.with_label(training_frame(spark, sf).filter((F.col("area") > 0) & F.col("price").isNotNull()))
    back = training.price_of(F.col("label"), F.col("area"))
    return rows.select("listing_id", F.round("label", 6).alias("label"), F.round(back, 3).alias("price_back"))


# --- duplicates ------------------------------------------------------------------------------------

def _pts(a, b, steps):
    off = f"abs({a} - {b}) / greatest({a}, {b})"
    return f"(case when {a} > 0 and {b} > 0 then (case " + " ".join(f"when {off} <= {lim} then {p}" for lim, p in steps) + " else 0 end) else 0 end)"


# DuckDB's levenshtein counts bytes: each sign of the test addresses gets one byte.
ADDRESS_SIGNS = "いさたまケセタン世丘中亀京倉北区千原口台和埼央奈子宇宿岡崎川左市府所新本東柏桜模横橋沢治浜浦港玉王田町相県神緑美船葉藤谷越都鎌長"
ONE_BYTE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz!#$%&()*+,./:"[: len(ADDRESS_SIGNS)]
LEVENSHTEIN = f"levenshtein(translate(na, '{ADDRESS_SIGNS}', '{ONE_BYTE}'), translate(ca, '{ADDRESS_SIGNS}', '{ONE_BYTE}'))"
SIG_SQL = f"""sig as (select eval_id as id, url, case when property_type in ('mansion', 'investmentapartment', 'tochi') then 'building' else 'house' end as grp,
  {canonical_sql("address")} as addr, coalesce(nullif(tatemono_menseki, 0), senyu_menseki, 0.0) as area, cast(coalesce(price_yen, 0) as double) as price,
  built, coalesce(built_text, '') as built_text from copies),
pair_ as (select n.id as new_id, c.id as cand_id, n.addr as na, c.addr as ca, {_pts("n.area", "c.area", vocab.DUP_AREA_STEPS)} as pa, {_pts("n.price", "c.price", vocab.DUP_PRICE_STEPS)} as pp,
    case when n.built = c.built or (n.built_text = c.built_text and n.built_text <> '') then 10 else 0 end as pb
  from (select *, floor(ln(area) / 0.08) as blk from sig where area > 0) n join (select *, unnest([floor(ln(area) / 0.08) - 1, floor(ln(area) / 0.08), floor(ln(area) / 0.08) + 1]) as blk from sig where area > 0) c on n.blk = c.blk and n.grp = c.grp and c.id < n.id
  where n.area > 0 and c.area > 0 and n.addr <> '' and c.addr <> '' and abs(n.area - c.area) / greatest(n.area, c.area) <= 0.07),
score_ as (select new_id, cand_id, pa + pp + pb + (case when na = ca then 50 else (case when 1.0 - {LEVENSHTEIN} / cast(greatest(length(na), length(ca)) as double) >= 0.85 then 35
    when 1.0 - {LEVENSHTEIN} / cast(greatest(length(na), length(ca)) as double) >= 0.70 then 20 else 0 end) end) as score
  from pair_ where pa + pp + pb >= 35),
link as (select new_id, max(cand_id) as cand_id, cast(arg_max(score, cand_id) as int) as score from score_ where score >= 85 group by new_id)"""


@query("dup_links", f"{cte('copies')}, {SIG_SQL} select * from link")
def dup_links(spark, sf):
    return dedup.duplicate_links(load(spark, sf, "copies"), method="levenshtein")


@query("dup_links_sequence")
def dup_links_sequence(spark, sf):
    return dedup.duplicate_links(load(spark, sf, "copies"), method="sequence")


@query("dup_roots", f"""{cte("copies").replace("with ", "with recursive ", 1)}, {SIG_SQL},
walk as (select new_id, cand_id from link union all select w.new_id, l.cand_id from walk w join link l on w.cand_id = l.new_id)
select new_id, min(cand_id) as root_id from walk group by new_id""")
def dup_roots(spark, sf):
    return dedup.duplicate_roots(dedup.duplicate_links(load(spark, sf, "copies"), method="levenshtein"))
