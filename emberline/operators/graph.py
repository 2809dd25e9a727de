"""Connected components on Spark, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .scan import ranked
from .store import removed, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the smallest node that it knows, itself included."""
    seen = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", F.col("lo")))
    least = seen.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, F.col("lo") == F.col("u")).select("hi", F.col("m").alias("lo"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties its smaller neighbours and itself to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    own = least.select("hi", F.col("m").alias("lo"))
    return edges.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(own).distinct()


def _round(edges: DataFrame, label: str) -> tuple[DataFrame, tuple]:
    """The edges, written, and a state that is equal for equal sets of edges, taken on the way."""
    seen = Observation()
    state = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi", F.lit(1)))]
    out = written(edges.observe(seen, *[c.alias(f"s{i}") for i, c in enumerate(state)]), label)
    return out, tuple(seen.get.get(f"s{i}") for i in range(3))


def stars(edges: DataFrame) -> DataFrame:
    """hi, lo: every node but the smallest of its component, with that smallest one. ``edges`` are pairs of integers, hi > lo.

    Large and small stars take turns until nothing changes; each leaves the components as they are and
    brings nodes nearer to their smallest one, so that the number of rounds grows with the logarithm of
    the longest path. A node's smallest neighbour comes from partial aggregates, and the join back to its
    edges is of a kind that adaptive execution splits where one node has very many.
    """
    now, state = _round(edges.distinct(), "edges")
    before = None
    while state != before:
        large = written(_large_star(now), "large-star")
        removed(now)
        before = state
        now, state = _round(_small_star(large), "small-star")
        removed(large)
    return now


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: every node that an edge names, with the smallest node that it reaches.

    Nodes that are not integers are numbered in their order first. Null is no node: an edge to it names
    the other end only. An edge from a node to itself names it.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    oriented = lambda x, y: (F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo"))
    if isinstance(edges.schema[a].dataType, IntegralType):
        kept = written(pairs.distinct(), "pairs")
        found = stars(kept.where("a <> b").select(*oriented("a", "b")))
        nodes = kept.select(F.explode(F.array("a", "b")).alias("node")).where("node IS NOT NULL").distinct()
        return nodes.join(found, nodes.node == found.hi, "left").select("node", F.coalesce("lo", "node").alias("root"))
    kept = written(pairs.distinct(), "pairs")
    names = kept.select(F.explode(F.array("a", "b")).alias("node")).where("node IS NOT NULL").distinct()
    nodes = ranked(names, [F.col("node").asc()], "id")
    number = lambda end: nodes.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id"))
    numbered = kept.where("a <> b").join(number("a"), "a").join(number("b"), "b")
    found = stars(numbered.select(*oriented("a_id", "b_id")))
    rooted = nodes.join(found, nodes.id == found.hi, "left").select("node", F.coalesce("lo", "id").alias("root_id"))
    return rooted.join(nodes.select(F.col("id").alias("root_id"), F.col("node").alias("root")), "root_id").select("node", "root")
