"""Connected components of a graph given as an edge table, without a driver-side graph.

Alternating large-star and small-star steps: each points every neighbour of a node
at the least node around it.  A step is a min per node (combined on the map side, so
a hub of any degree costs one partial row a task) and a sort-merge join back, whose
large partitions adaptive execution may split.  Each round is written to the shared
folder, which cuts lineage and survives lost executors, and the round before is
removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import remove, temporary

#: Rounds after which something must be wrong: the method needs about the square of the logarithm of the longest path.
ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v), u > v, after one step."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """Nodes that have an edge, as (node, root): root is the least node of the component.

    ``edges`` has two bigint columns u and v; loops, repeats and nulls are ignored.
    """
    spark = edges.sparkSession
    schema = "u bigint, v bigint"

    def keep(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = temporary(spark, "edges")
        df.write.parquet(path)
        out = spark.read.schema(schema).parquet(path)
        mark = out.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        return out, path, tuple(mark)

    now, path, mark = keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(ROUNDS):
        if not mark[0]:
            break
        then, then_path, then_mark = keep(_star(_star(now, True), False))
        remove(spark, path)
        same, now, path, mark = then_mark == mark, then, then_path, then_mark
        if same:
            break
    else:
        raise RuntimeError(f"components not found in {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
