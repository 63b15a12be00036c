"""What driver and workers share: this package's code, folders, and tables written in them."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors once per Spark application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = Path(tempfile.mkdtemp(prefix=f"{root.name}-"))
    target = folder / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def map_batches(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``rows.mapInArrow`` with a function of this package, which workers may not have."""
    ship(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``; where that is unset, a temporary one, which only a local master reaches."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = Path(tempfile.gettempdir(), "lodestone-checkpoints").as_uri()
        spark.conf.set("spark.checkpoint.dir", base)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


def stored(df: DataFrame, where: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut and executors may go."""
    where = where or shared_dir(df.sparkSession)
    df.write.mode("overwrite").option("compression", "zstd").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows``, stored, with a dense number from 0, and how many there are."""
    held = stored(rows.withColumn("__at", F.monotonically_increasing_id()))
    sizes = dict(held.groupBy(F.shiftright("__at", 33).cast("int").alias("p")).count().collect())
    starts = np.cumsum([0, *(sizes.get(p, 0) for p in range(max(sizes, default=0) + 1))]).tolist()
    number = F.get(F.lit(starts), F.shiftright("__at", 33).cast("int")) + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return held.select(*rows.columns, number.cast("int").alias("number")), starts[-1]


def state_of(rows: DataFrame) -> tuple:
    """The files that ``rows`` are read from, with sizes and times of change."""
    spark = rows.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in sorted(rows.inputFiles())]
    found = [p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p) for p in paths]
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found)
