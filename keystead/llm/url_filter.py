"""URL filters over time: an as-of join of captures with dated list entries.

An entry puts an action on a rule from its date on; the next entry of the rule ends
it, so entries become validity intervals.  A capture is judged by the entries that were
active when it was fetched; of these the most specific rule counts: a path before a
host, a host before the domains above it, from the longest down.

Time is cut into days.  For each rule and day that has captures, the entry that is
still active when the day begins is found once, among entries alone; captures then
meet this entry and the day's own ones by rule and day.  A host with a third of the
captures is spread over its days and split by Catalyst; no capture is paired with the
whole history of a rule, and no rule with all captures of a host.

Rules: `path` is host/first segment of the path, `host` a whole host name, `domain` a
host name and all below it.  Actions: `block`, `allow`; any other action takes the rule
off the list.  Of entries of a rule with one date the largest entry_id counts.

Nulls: entries without rule, kind, date or action are left out.  A capture without
url or fetch time meets no entry: its verdict is `none`.  Repeated captures are judged
one by one.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parts of a url, the kinds of rules from the least to the most specific.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)"
KINDS = ("domain", "host", "path")
LISTED = ("block", "allow")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def segment_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), SEGMENT, 1)


def rule_keys(url: Column) -> Column:
    """array<struct<rank, key>>: every rule that can match a url; longer domains rank higher."""
    host, segment = host_of(url), segment_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(i.alias("rank"), F.concat(F.lit("domain:"), F.array_join(F.slice(labels, F.size(labels) - i + 1, i), ".")).alias("key")),
    )
    exact = F.struct(F.lit(1_000).alias("rank"), F.concat(F.lit("host:"), host).alias("key"))
    path = F.struct(F.lit(2_000).alias("rank"), F.concat(F.lit("path:"), host, F.lit("/"), segment).alias("key"))
    return F.when(host != "", F.concat(domains, F.array(exact, path)))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, since, until) of (entry_id, kind, rule, action, dated): until is null for the last of a rule."""
    own = entries.select("entry_id", F.concat_ws(":", "kind", F.lower("rule")).alias("key"), "action", F.col("dated").alias("since")).where(
        F.col("kind").isin(*KINDS) & F.col("rule").isNotNull() & F.col("dated").isNotNull() & F.col("action").isNotNull())
    last = own.groupBy("key", "since").agg(F.max_by("action", F.struct("entry_id", "action")).alias("action"))
    order = Window.partitionBy("key").orderBy("since")  # the entries of one rule
    return last.withColumn("until", F.lead("since").over(order))


def daily(history: DataFrame, days: DataFrame) -> DataFrame:
    """(key, day, action, since, until): what is or becomes active on the days (key, day) asked for."""
    entry = F.struct("action", "since", "until")
    events = history.select("key", F.col("since").alias("at"), F.lit(1).alias("turn"), F.to_date("since").alias("day"), entry.alias("entry"))
    marks = days.select("key", F.col("day").cast("timestamp_ntz").alias("at"), F.lit(0).alias("turn"), "day", F.lit(None).alias("entry"))
    order = Window.partitionBy("key").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    line = events.unionByName(marks).withColumn("active", F.last("entry", ignorenulls=True).over(order))
    carried = line.where("turn = 0 and active is not null").select("key", "day", "active.*")
    return carried.unionByName(events.select("key", "day", "entry.*"))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched_at, verdict, rule, since for every row of (page_id, url, fetched_at)."""
    rows = captures.select("page_id", "url", "fetched_at", F.monotonically_increasing_id().alias("row"))
    asked = rows.select("row", "fetched_at", F.to_date("fetched_at").alias("day"), F.explode(rule_keys(F.col("url"))).alias("k")).select(
        "row", "fetched_at", "day", F.col("k.rank").alias("rank"), F.col("k.key").alias("key"))
    days = asked.where("day is not null").select("key", "day").distinct()
    active = daily(intervals(entries), days).select(
        F.col("key").alias("l_key"), F.col("day").alias("l_day"), "action", "since", "until")
    met = asked.join(
        active,
        (F.col("key") == F.col("l_key")) & (F.col("day") == F.col("l_day"))
        & (F.col("since") <= F.col("fetched_at")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until"))),
    ).where(F.col("action").isin(*LISTED))
    best = met.groupBy(F.col("row").alias("m_row")).agg(F.max_by(F.struct("action", "key", "since"), F.col("rank")).alias("b"))
    return rows.join(best, F.col("row") == F.col("m_row"), "left").select(
        "page_id", "url", "fetched_at", F.coalesce("b.action", F.lit("none")).alias("verdict"), F.col("b.key").alias("rule"), F.col("b.since").alias("since"))


def kept(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched_at of captures that no entry blocked when they were fetched."""
    return evaluate(captures, entries).where("verdict <> 'block'").select("page_id", "url", "fetched_at")
