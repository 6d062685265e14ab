"""Session, shared folder, materialisation and skew helpers used by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("lumentext")
    base = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors see.

    Only where it is unset, as in tests on one machine, a folder of our own is made and set.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="lumentext-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d.rstrip("/")


def materialize(df: DataFrame, what: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/lumentext-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``, once nothing that is still to run reads it; other DataFrames are left alone."""
    path, spark = getattr(df, "_written", None), df.sparkSession
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer splits than there are cores, such as one small file, dealt out to all of them; any other as it is.

    For work that takes long for its bytes. Only for scans: it asks for the number of splits, which runs nothing for them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def skew_join(rows: DataFrame, keyed: DataFrame, key: str, counts: DataFrame, hot: int = 200_000, salts: int = 32, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed`` (one row a key) where a key may hold a large part of ``rows``.

    counts: (key, n), the number of ``rows`` of each key. Keys with more than ``hot`` rows, or one in 100,000 of all rows if that is
    more, are spread over ``salts`` tasks; so there are at most 100,000 of them, and their list is broadcast. The result has the columns of both
    sides, the key once.
    """
    hot = max(hot, (counts.agg(F.sum("n")).first()[0] or 0) // 100_000)
    hot_keys = counts.filter(F.col("n") > hot).select(F.col(key), F.lit(salts).alias("_salts"))
    left = rows.join(F.broadcast(hot_keys), key, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("_salts")).cast("int"))
    )
    right = keyed.join(F.broadcast(hot_keys), key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    )
    return left.drop("_salts").join(right.drop("_salts"), [key, "_salt"], how).drop("_salt")


def small(keys: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``keys``, narrow rows already written or cheap to compute, marked to be broadcast if there are at most ``most`` of them; otherwise as they are, for a shuffled join."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def is_blank(c: Column) -> Column:
    """True for NULL and for text of white space only, no-break spaces included."""
    return c.isNull() | F.regexp_like(c, F.lit(r"^(?U)\s*$"))
