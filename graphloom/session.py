"""Session settings shared by the operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder of spark.checkpoint.dir; only where that is unset and one machine does all the work makes one of its own.

    A cluster without that setting is refused: its executors would each write to a disk of their own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="graphloom-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder: later plans start there and survive the loss of executors.

    A checkpoint keeps the size that its plan was guessed to have, and joins multiply such guesses; over many rounds they
    outgrow any number. The rows are therefore taken up anew, without a guess: Spark then plans by what shuffles hold.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    held = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(held.queryExecution().toRdd(), held.schema(), False), spark)


def local_session(app: str = "graphloom", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.driver.host": "127.0.0.1", "spark.ui.showConsoleProgress": "false", "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
