"""Session helpers: tables of a data folder, runtime settings, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Set only where the session leaves them unset.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Rows of one Arrow batch to a Python worker; contents run to tens of kilobytes.
ARROW_ROWS = "1000"


def build(app: str = "weirstone", **conf: str) -> SparkSession:
    """A session with the engine's settings; conf overrides them."""
    b = SparkSession.builder.appName(app)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return tune(b.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Bound the memory of Arrow batches and keep sessions on UTC."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def _shared_folder(df: DataFrame) -> str:
    """The session's ``spark.checkpoint.dir``; where none is set, as in local tests, a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get("spark.checkpoint.dir") or None
        if where is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="weirstone-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder that all executors share."""
    _shared_folder(df)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """Like cut, for wide or long tables: a compressed table written to the shared folder and read again."""
    path = f"{_shared_folder(df)}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(path)
