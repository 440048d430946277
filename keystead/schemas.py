"""Declared schemas: one column set per listing type, evaluations, dimensions.

Every measured value is kept twice: the raw text under ``<name>_text`` and the
typed value under ``<name>``.  Money in yen ends in ``_yen``, money in units of
10,000 yen in ``_man``.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
DATE, TS = T.DateType(), T.TimestampType()
AREA = T.DecimalType(10, 3)
PCT = T.DecimalType(5, 2)
LENGTH = T.DecimalType(6, 2)
MONEY = T.DecimalType(12, 0)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


UNIVERSAL = dict(
    property_id=L, company=S, property_type=S, url=S, property_name=S, price_text=S, price_yen=L,
    address=S, address1=S, address2=S, address3=S, traffic=S, input_ts=TS, biko=S, tochikenri=S,
)
MANSION = dict(
    senyu_menseki_text=S, senyu_menseki=AREA, built_text=S, built=DATE, kanrihi=L, syuzen=L,
    madori=S, saikou=S, soukosu=I, kouzou=S,
)
KODATE = dict(
    tochi_menseki_text=S, tochi_menseki=AREA, tatemono_menseki_text=S, tatemono_menseki=AREA,
    built_text=S, built=DATE, kouzou=S, kenpei_text=S, youseki_text=S, kenpei=T.DecimalType(10, 2),
    youseki=T.DecimalType(10, 2), setsudou=S, road_structure=S, maguchi=LENGTH, road_width=LENGTH,
    youto_chiiki=S,
)
TOCHI = dict(
    tochi_menseki_text=S, tochi_menseki=AREA, kenpei_text=S, youseki_text=S,
    kenpei=T.DecimalType(10, 2), youseki=T.DecimalType(10, 2), setsudou=S, maguchi=LENGTH,
    okuyuki=LENGTH, road_direction=S, road_type=S, road_structure=S, road_width=LENGTH, chimoku=S,
    youto_chiiki=S,
)
INVESTMENT = {**KODATE, **dict(gross_yield=PCT, annual_rent=L, monthly_rent=L, current_status=S)}

LISTING = {
    "mansion": struct(**UNIVERSAL, **MANSION),
    "kodate": struct(**UNIVERSAL, **KODATE),
    "tochi": struct(**UNIVERSAL, **TOCHI),
    "investment": struct(**UNIVERSAL, **INVESTMENT),
}

EVALUATION = struct(
    eval_id=L, property_url=S, company=S, property_type=S, property_id=L, pred1=MONEY, pred2=MONEY,
    is_first_stage_passed=B, interior_score=D, layout_score=D, investment_score=D,
    total_investment_score=D, analysis_status=S, analyzed_at=TS, is_notified=B, duplicate_of=L,
)
IMAGE = struct(eval_id=L, image_url=S, category=S, is_cleaned=B)

MUNICIPALITY = struct(
    prefecture=S, city=S, pop_growth=PCT, income=I, total_population=L, income_growth=PCT,
    density=T.DecimalType(8, 2),
)
STATION = struct(station_name=S, railway_line=S, passenger_volume=L)
LAND_PRICE = struct(
    prefecture=S, city=S, land_use=S, average=L, rosenka=L, fixed_asset=L, growth=PCT
)
HAZARD = struct(prefecture=S, city=S, flood=I, landslide=I)
ZONE = struct(zone_id=L, zone_name=S, max_kenpei=I, max_youseki=I)

CRAWL_LOG = struct(timestamp=TS, url=S, status=S, model=S, error=S)
TRADE = struct(City=S, Use=S, TradePrice=S, Area=S)
PAGE = struct(page_id=L, url=S, html=S)

# fields a row must have before it is saved, by listing type
REQUIRED = {
    "all": ["property_name", "url", "price_yen", "address"],
    "mansion": ["senyu_menseki", "madori"],
    "kodate": ["tochi_menseki", "tatemono_menseki"],
    "tochi": ["tochi_menseki", "kenpei", "youseki"],
    "investment": [
        "gross_yield", "annual_rent", "monthly_rent", "current_status", "tochi_menseki", "tatemono_menseki",
    ],
}
ALLOWED = {
    "analysis_status": ["pending", "processing", "completed", "skipped_by_budget", "failed"],
    "land_use": ["residential", "commercial"],
    "category": ["interior", "layout", "exterior"],
    "plot_shape_type": ["regular", "irregular", "flagpole", "unknown"],
}
