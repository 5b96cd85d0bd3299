"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the public vocabulary files; a parameter of the operators that need one.
TOKENIZER_DIR = os.environ.get("DOCKETFORGE_TOKENIZERS", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where the session names none (local tests) a folder of this machine is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"docketforge-{os.getuid()}", spark.sparkContext.applicationId)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends in files any executor can read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete the files of cut tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Share rows evenly over all cores when a scan gives fewer partitions than cores (a few small files)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    # a scan of many files has a partition for each of them, or for each block of a large one
    if len(files) >= cores or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, *[F.col(k) for k in keys])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b): rows (node, comp), comp being the least node id.

    Labels spread along edges and then jump to their label's own label (pointer jumping), so
    a chain of n nodes ends in about log2(n) rounds. Each round is a few shuffles of the edge
    list and is written to the shared folder; nothing is collected. The answer is exact:
    rounds only guards against an endless loop and raises when it is reached.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    lab = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    last = lab
    for _ in range(rounds):
        near = both.join(lab.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        met = lab.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = lab.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = cut(met.join(up, "comp", "left").select("node", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")))
        settled = new.where("comp <> old").limit(1).count() == 0
        forget(last)
        last, lab = new, new.select("node", "comp")
        if settled:
            forget(both)
            return lab
    raise RuntimeError("components did not settle")
