"""Where relations come from and where intermediate tables are kept."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small relation of given rows; a schema is always given, never guessed."""
    return spark.createDataFrame(list(rows), schema)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; unset, a local one in local mode, else the warehouse."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return "file:///tmp/checkpoints/lemmaflow"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes the rows as Parquet in the shared folder; returns the table read back, and its path.

    The lineage ends there: what an executor loses is read again, not computed again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``store`` without the path, for tables that results go on reading."""
    return store(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bit_words(spark: SparkSession, path: str) -> DataFrame:
    """Files as bit vectors: ``(path, n_bits, word_idx, word)``, 8 bits a byte, least significant first.

    The last word is padded with zero bits; ``n_bits`` is 8 times the file's bytes.
    """
    f = spark.read.format("binaryFile").load(path).select("path", (F.col("length") * 8).alias("n_bits"), "content")
    n_words = F.ceil(F.col("n_bits") / 64).cast("int")
    words = F.transform(F.sequence(F.lit(0), F.greatest(n_words - 1, F.lit(0))), lambda i: F.substring("content", i * 8 + 1, F.lit(8)))
    w = f.where("n_bits > 0").select("path", "n_bits", F.posexplode(words).alias("word_idx", "bytes"))
    padded = F.rpad(F.hex("bytes"), 16, "0")
    turned = F.concat(*(F.substring(padded, 15 - 2 * k, 2) for k in range(8)))  # little-endian
    return w.select("path", "n_bits", F.col("word_idx").cast("long").alias("word_idx"), F.conv(turned, 16, -10).cast("long").alias("word"))
