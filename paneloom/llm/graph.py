"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(t, c) for every end of links (a, b): c is the least t that it is connected with.

    Each round takes the least label of a node and its neighbours, then the label of that
    label. Sums per key are partly made before each shuffle, so a node with very many
    links is no single task's work. Labels stay in files between rounds.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("t")).agg(F.least("t", F.min("b")).alias("c")), "labels")
    while True:
        near = both.join(labels, F.col("a") == F.col("t")).groupBy(F.col("b").alias("t")).agg(F.min("c").alias("near"))
        stepped = labels.join(near, "t").select("t", F.col("c").alias("old"), F.least("c", "near").alias("c"))
        root = labels.select(F.col("t").alias("c"), F.col("c").alias("root"))
        new = written(stepped.join(root, "c", "left").select("t", "old", F.least("c", F.coalesce("root", "c")).alias("c")), "labels")
        labels = new.select("t", "c")
        if not new.where("c <> old").limit(1).count():
            return labels
