"""Session settings and the two ways of cutting lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session you are given."""
    n = partitions if partitions is not None else (8 if cores == "*" else int(cores))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spanloom")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where they couldn't: as a zip file that Spark hands out.

    Called by every operator whose tasks run functions of this package.
    """
    package = os.path.dirname(os.path.abspath(__file__))
    root, application = os.path.dirname(package), spark.sparkContext.applicationId
    named = map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))
    if application in _SHIPPED or root in named or "site-packages" in root:
        return
    _SHIPPED.add(application)
    base = os.path.join(tempfile.mkdtemp(prefix="spanloom-code-"), "spanloom")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, os.path.basename(package)))


def shared_dir(spark: SparkSession) -> str:
    """The folder for data that must outlive an executor: ``spark.checkpoint.dir``.

    Only a local master may run without the setting; a cluster has to name a shared folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    made = tempfile.mkdtemp(prefix="spanloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark).rstrip('/')}/spanloom-{label}-{uuid.uuid4().hex}"


def keyed_store(df: DataFrame, key: str, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder, dealt out by ``key``, as a bucketed table.

    A join on ``key`` shuffles only the other side, however often it is done. The table stays in the session's
    catalog, and its files in the folder, until they are dropped.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, label)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(name)
    return spark.table(name)


def cut(df: DataFrame, label: str = "cut", codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Readers of the result prune columns and push filters into parquet, and a lost executor
    costs a re-read instead of the whole lineage.
    """
    ship(df.sparkSession)
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
