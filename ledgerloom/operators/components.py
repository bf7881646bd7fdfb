"""Connected components of a table of links, for assignments that run component by component."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The temporary folder of this process, for sessions on one machine that name none.
_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a session on one machine takes a temporary one; on a
    cluster, whose machines would each have their own, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="links-"))
        folder = _OWN[0]
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows with their lineage cut: written once to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/links-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """(v, root) for the vertices of links (a, b): root is the smallest vertex of the component.

    Labels start as the vertices; each round a vertex takes the smallest label next to it, and then the label of that
    label, so that distances halve. It ends when no label moves.
    """
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "v"))
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("root").alias("_n"))
        next_to = labels.join(near, labels.v == near.a).select("v", "root", F.least("root", "_n").alias("_to"))
        jump = labels.select(F.col("v").alias("_to"), F.col("root").alias("_far"))
        moved = cut(next_to.join(jump, "_to", "left").select("v", F.least("_to", F.coalesce("_far", "_to")).alias("root"), F.col("root").alias("_was")))
        labels = moved.select("v", "root")
        if moved.filter("root <> _was").isEmpty():
            return labels
