"""Union-find grouping of links over many partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import fields, id_type, materialise


def _forest(edges: DataFrame) -> DataFrame:
    """Within each partition, links that close a cycle go and each tree is hung from its smallest node (union-find)."""
    kind = id_type(edges, "src")
    schema = fields(("src", kind), ("dst", kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up] if up in parent else up
                x = parent[x]
            return x

        to = None
        for batch in batches:
            to = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > 500_000:  # bounded memory: pass on what is known so far and begin anew
                yield flush(parent, root, to)
        if parent:
            yield flush(parent, root, to)

    def flush(parent: dict, root, to) -> pa.RecordBatch:
        found = [(x, r) for x in list(parent) if (r := root(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], to), pa.array([r for _, r in found], to)], names=["src", "dst"])

    return edges.select("src", "dst").mapInArrow(run, schema)


def _handed_back(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Links with their sources' minima. least is a written table: no aggregate stands between its exchange and the join."""
    return edges.join(least, "src")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, component (smallest node reachable) of every node of the undirected links (src, dst).

    Alternating large-star and small-star contraction; every round is written to the shared folder. Hubs are safe: minima
    are partial aggregates and written out before the join that hands them back, so that both its sides are plain exchanges
    and adaptive execution can split a hub. Links with a null end and
    loops are ignored. Rounds grow with the logarithm of the nodes; if `most` don't do, it raises rather than return a part.
    """
    edges = materialise(_forest(edges.where("src is not null and dst is not null and src <> dst")).distinct())
    for _ in range(most):
        # large star: every larger neighbour of u gets the smallest node around u
        both = edges.union(edges.select("dst", "src"))
        least = materialise(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m")))
        large = materialise(_handed_back(both.where("dst > src"), least).select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct())
        # small star: u and its smaller neighbours get the smallest of them
        least = materialise(large.groupBy("src").agg(F.min("dst").alias("m")))
        small = (
            _handed_back(large, least)
            .select(F.explode(F.array(F.struct("src", F.col("m").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")))).alias("e"))
            .select("e.*")
            .where("src <> dst")
            .distinct()
        )
        after = materialise(small)
        done = after.groupBy("src").count().where("count > 1").limit(1).union(after.select("dst").join(after.select(F.col("src").alias("dst")), "dst", "left_semi").withColumn("count", F.lit(0)).limit(1)).isEmpty()
        edges = after
        if done:
            break
    else:
        raise RuntimeError(f"components are not complete after {most} rounds")
    roots = edges.select("dst").distinct()
    return materialise(edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots.select("dst", F.col("dst"))))
