"""Session builder and the few physical helpers that every operator shares."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a dimension may be broadcast; larger ones take the ordinary join.
BROADCAST_ROWS = 20_000


def build(app: str = "specimatrix", cores: int | str = "*", shuffle: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the library expects; on a cluster the session is given."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application, so that Python stages can import it."""
    context = spark.sparkContext
    if getattr(context, "_specimatrix_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="specimatrix-code-")) / "specimatrix.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._specimatrix_shipped = True
    return spark


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Partitions for stages that run Python: adaptive coalescing would leave these on one core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marks ``df`` for broadcast if it has at most ``most`` rows; otherwise the planner chooses the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fixed_rows(df: DataFrame, what: str, most: int = 1000) -> list[Row]:
    """The rows of a table that is fixed and small by its nature; a larger one is refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"More than {most} {what}")
    return rows


def hot_keys(counted: DataFrame, keys: list[str], total: int, parts: int = 64) -> DataFrame:
    """The keys of ``counted`` whose ``n`` is more than one part of ``total``: by that, fewer than ``parts`` rows."""
    return counted.where(F.col("n") * parts > total).select(*keys)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, by: Column, parts: int = 64) -> DataFrame:
    """Inner join on ``keys``, where the rows of ``left`` with a key of ``hot`` are spread over ``parts`` tasks.

    ``right`` has one row for a key, ``hot`` at most ``parts`` rows (``hot_keys``), so it may be broadcast; ``by`` is a hash
    of the left row, so that a task that runs again deals its rows alike.
    """
    hot = F.broadcast(hot.limit(parts).withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(by, F.lit(parts)).cast("int")).otherwise(0)
    dealt = left.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    spread = right.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return dealt.join(spread, [*keys, "_salt"]).drop("_salt")


def spread_null(df: DataFrame, key: Column, parts: int = 1024) -> Column:
    """A text key for an outer join in which rows without one do not all meet in one task; they match nothing, as before."""
    plain = [c for c, t in df.dtypes if t in ("string", "bigint", "int", "double", "boolean", "date", "timestamp")]
    return F.coalesce(key, F.concat(F.lit("\0"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(parts)).cast("string")))


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are evaluated once.

    The optimizer merges projections and would repeat these expressions wherever later ones use them, until the code is
    too large to be compiled; a generator of one row is not merged.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; set here only if the session has none (tests, one machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="specimatrix-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession) -> str:
    """A new name in this application's part of the shared folder, which is removed when the driver ends."""
    context = spark.sparkContext
    home = f"{shared_dir(spark)}/specimatrix-scratch/{context.applicationId}"
    if not getattr(context, "_specimatrix_scratch", False):
        context._specimatrix_scratch = True
        atexit.register(_remove_quietly, spark)
    return f"{home}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from a table in the shared folder: its lineage ends there."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Removes all tables that this application's ``cut`` wrote; results that were not yet read are lost with them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/specimatrix-scratch/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _remove_quietly(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        clear_scratch(spark)
