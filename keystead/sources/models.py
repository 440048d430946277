"""Model folders: one per type, stage and algorithm, with the feature list beside."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

ALGORITHMS = ["lgb", "xgb", "cat", "rf"]


def model_path(root: str, kind: str, stage: str, algorithm: str) -> str:
    return f"{root}/{kind}_{stage}_stage_{algorithm}"


def legacy_path(root: str, kind: str, stage: str) -> str:
    """Folder of the time before there were several algorithms."""
    return f"{root}/{kind}_{stage}_stage_model"


def save_model(model: PipelineModel, root: str, kind: str, stage: str, algorithm: str) -> str:
    path = model_path(root, kind, stage, algorithm)
    model.write().overwrite().save(path)
    return path


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_models(spark: SparkSession, root: str, kind: str, stage: str) -> dict[str, PipelineModel]:
    """The algorithms there are; the first may also come from the legacy folder."""
    found = {}
    for algorithm in ALGORITHMS:
        path = model_path(root, kind, stage, algorithm)
        if not _exists(spark, path) and algorithm == ALGORITHMS[0]:
            path = legacy_path(root, kind, stage)
        if _exists(spark, path):
            found[algorithm] = PipelineModel.load(path)
    return found


def save_master(master: DataFrame, root: str) -> None:
    master.write.mode("overwrite").parquet(f"{root}/market_master")


def load_master(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/market_master")
