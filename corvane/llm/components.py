"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import remove_folder, work_folder


def connected_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (src, dst; both long) reaches.

    Each round takes the smallest label among a node and its neighbours, then the label of that label, so
    that labels travel twice as far each time. Only whether a label changed comes to the driver. Labels are written to the shared folder in every
    round, and those of the round before go; a plan never holds more than one round. Nodes without edges aren't in the result;
    an empty table gives an empty one.
    """
    spark = edges.sparkSession

    def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
        uri = work_folder(spark, tag)
        df.write.parquet(uri)
        return spark.read.schema(df.schema).parquet(uri), uri

    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    both, _ = written(both, "edges")
    labels, uri = written(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("root")), "labels")
    for _ in range(rounds):
        heard = both.join(labels, both.src == labels.node).groupBy(F.col("dst").alias("node")).agg(F.min("root").alias("heard"))
        better = labels.join(heard, "node", "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("heard", "root")).alias("root"))
        jump = labels.select(F.col("node").alias("of"), F.col("root").alias("jumped"))
        after, new_uri = written(better.join(jump, F.col("root") == F.col("of"), "left").select("node", "was", F.least("root", F.coalesce("jumped", "root")).alias("root")), "labels")
        remove_folder(uri)
        labels, uri = after.select("node", "root"), new_uri
        if after.filter("was <> root").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")
