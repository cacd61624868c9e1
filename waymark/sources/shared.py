"""Written intermediate tables: lineage ends there, and a lost executor costs a reread."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; only a local session may go without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file:///tmp/checkpoints"


def written(df: DataFrame, name: str, by: str | None = None, free: bool = True) -> DataFrame:
    """df, written once to the shared folder and read back; by: a column whose values get folders of their own; free: what
    the step has shuffled ends with it."""
    path = f"{shared_folder(df.sparkSession)}/waymark/{uuid.uuid4().hex}/{name}"
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, str(free).lower())
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors once, for sessions whose workers don't find it on their path."""
    context = spark.sparkContext
    if not getattr(context, "waymark_shipped", False):
        context.waymark_shipped = True
        root = Path(__file__).resolve().parents[2]
        folder = tempfile.mkdtemp(prefix="spark-")
        with zipfile.ZipFile(f"{folder}/waymark_code.zip", "w") as archive:
            for file in sorted((root / "waymark").rglob("*.py")):
                archive.write(file, file.relative_to(root))
        context.addPyFile(f"{folder}/waymark_code.zip")
