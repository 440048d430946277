"""The plans are the ones we want: pushed down, pruned, without cross joins or row Python."""

import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from keystead import session
from keystead.operators import aggregates, dedup, quality, repair, screening, upsert
from keystead.plans.testbed import load, table

QUERIES = entry.queries()
ROOT = Path(__file__).parent.parent
TRAINED = {"nightly", "ensemble_prices", "model_metrics", "feature_importance", "stream_links"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINED))
def test_no_cross_join_and_no_row_python(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    if name not in ("dup_links_sequence", "decoded_pages", "isolation_forest"):
        assert "ArrowEvalPython" not in text


@pytest.mark.parametrize("name", [
    "price_parse", "address_split", "traffic_routes", "strict_reasons", "anomalies", "extract_listings", "page_images", "next_pages", "setback",
])
def test_projections_do_not_shuffle(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Exchange hashpartitioning" not in text and "Exchange SinglePartition" not in text


def test_columns_are_pruned(spark, sf_dir):
    text = plan(load(spark, sf_dir, "trade").select("City"))
    scan = next(x for x in text.splitlines() if "lineitem" in x and "FileScan" in x)
    read = re.search(r"ReadSchema: struct<([^>]*)>", scan).group(1)
    assert "l_tax" not in read and "l_shipdate" not in read and "l_suppkey" in read


def test_filters_reach_the_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").filter(F.col("s_acctbal") > 100.0)
    assert "GreaterThan(s_acctbal,100.0)" in plan(rows)


@pytest.mark.parametrize("make", [
    lambda df: repair.sample_per_group(df, ["k"], [F.col("id")], 5),
    lambda df: screening.daily_budget(df.withColumn("ts", F.timestamp_seconds("id")), "ts", "id", 5),
])
def test_rank_limits_are_cut_before_the_shuffle(spark, make):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    text = plan(make(df))
    assert text.count("WindowGroupLimit") >= 2  # once per task, once after the exchange


def test_latest_row_combines_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    assert "partial_max_by" in plan(upsert.latest_per_key(df, ["k"], ["id"]))


def folded_signatures(spark, towns, copies=1):
    """Signatures of listings in so many towns, no two towns with a sign in common."""
    town = F.concat(*[F.expr(f"decode(unhex(hex(19968 + (id % {towns}) * 4 + {k})), 'UTF-16BE')") for k in range(4)])
    return spark.range(towns * 20 * copies).select(
        F.col("id").alias("num"), F.col("id").cast("string").alias("sid"), F.lit("house").alias("grp"),
        F.concat(F.lit("東京都"), town, F.lit("町"), (F.col("id") % 9).cast("string")).alias("addr"),
        F.lit(50.0).alias("area"), F.lit(1e7).alias("price"), F.lit(None).cast("date").alias("built"), F.lit("").alias("built_text"),
        F.col("id").alias("first"), F.col("id").alias("last"),
    )


@pytest.mark.parametrize("method", ["sequence", "levenshtein"])
def test_similar_addresses_join_on_a_sign(spark, method):
    """Every join of the candidates has an address key, equal addresses the address itself."""
    rows = folded_signatures(spark, 5)
    joins = re.findall(r"Join \[([^\]]*)\]", plan(dedup._similar_pairs(rows, method)))
    assert joins and all("sign#" in keys and "a_bucket#" in keys and "p_bucket#" in keys for keys in joins)
    same = re.findall(r"Join \[([^\]]*)\]", plan(dedup._pairs(rows.withColumn("bucket", F.lit(1)), ["grp", "addr", "bucket"], ["bucket"], lambda n, c: F.lit(True))))
    assert same and all("addr#" in keys for keys in same)


def test_similar_pairs_grow_with_the_table(spark):
    """Ten times the towns: ten times what meets, not a hundred times."""
    def met(towns):
        signed = dedup.with_signs(folded_signatures(spark, towns), "sequence", 0.85).withColumn("sign", F.explode("lead"))
        sizes = signed.groupBy("grp", "sign").count()
        return sizes.agg(F.sum(F.col("count") * F.col("count"))).first()[0]

    assert met(100) <= 11 * met(10)


def test_signs_lose_no_similar_address(spark):
    import random
    from difflib import SequenceMatcher
    rng = random.Random(5)
    base = ["東京都港区赤坂一丁目2-3-4", "神奈川県横浜市西区みなとみらい2-2-1", "京都府京都市中京区河原町9"]
    texts = []
    for k in range(120):
        t = list(base[k % 3])
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("東西南北123赤町-")
        texts.append("".join(t))
    rows = [(i, str(i), "house", t, 50.0, 1e7, None, "", i, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "num long, sid string, grp string, addr string, area double, price double, built date, built_text string, first long, last long")
    got = {(r["a"], r["b"]) for r in dedup._similar_pairs(df, "sequence").collect()}
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts[:i]) if a != b and SequenceMatcher(None, a, b).ratio() >= 0.85}
    assert want and want <= got


def test_large_dimension_is_not_broadcast(spark, sf_dir):
    """The size check is Catalyst's: without room for a broadcast the join shuffles."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["hazard_lookup"](spark, sf_dir))
        assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
        assert spark_rows(QUERIES["market_lookup"](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def spark_rows(df):
    return df.collect()


def test_quantiles_hold_no_whole_group(spark):
    df = spark.range(10000).select(F.lit("a").alias("g"), F.rand(1).alias("v"))
    text = plan(aggregates.exact_quantiles(df, ["g"], "v", [0.5]))
    assert "collect_list" not in text and "percentile(" not in text


def test_scratch_folder_is_the_session_setting(spark, tmp_path):
    assert session.scratch_root(spark)
    code = (
        "from keystead.session import local_session, scratch_path, stage, CHECKPOINT_KEY\n"
        f"spark = local_session(1, 'folder', **{{CHECKPOINT_KEY: '{tmp_path}'}})\n"
        f"assert scratch_path(spark, 'x').startswith('{tmp_path}')\n"
        f"assert '{tmp_path}' in stage(spark.range(5), 't').inputFiles()[0]\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        session.scratch_root(Session)


def test_anomaly_scan_reads_only_what_it_needs(spark, sf_dir):
    text = plan(quality.anomaly_scan(load(spark, sf_dir, "listing")).select("listing_id", "reasons"))
    assert "o_orderpriority" not in text
