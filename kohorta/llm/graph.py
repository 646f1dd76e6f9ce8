"""Connected components of an edge table by alternating star contractions; no group of edges meets in one task."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node of that neighbourhood."""
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b") \
        .distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of `edges`; the component is the smallest node that links reach.

    Links to null or to the node itself are ignored; repeated links count once; no links give an empty table. Each
    round is stored in the shared folder, so lineage stays short; the number of rounds is logarithmic.
    """
    now = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
                 .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    was, state = None, _state(now)
    while state[0] and state != was:
        old, was = now, state
        now = stored(_small_star(_large_star(old)), "links")
        state = _state(now)
        discard(old)
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")) \
        .union(roots.select("node", F.col("node").alias("component")))


def _side(sketch: DataFrame, node: str, name: str) -> DataFrame:
    """(node, kind, name): the other columns of `sketch` in one struct."""
    rest = [c for c in sketch.columns if c not in ("node", "kind")]
    return sketch.select(F.col("node").alias(node), "kind", F.struct(*rest).alias(name))


def bucket_groups(buckets: DataFrame | list[DataFrame], fits: Callable[[str, str], str], alike: Callable[[DataFrame], DataFrame],
                  kind: str = "0", sketch: DataFrame | None = None, likely: Callable[[str, str], str] | None = None) -> DataFrame:
    """(node, component) of the nodes that are linked to others of a bucket; `buckets` has key, node, size and n.

    `fits` says in SQL whether two sizes allow a link, `alike` returns the pairs (a, b) that are links of pairs (a, b, kind),
    where `kind` is SQL of the key. All nodes of a bucket are compared with the one of most occurrences n. Then each that
    isn't in the leader's group is compared with all others of the bucket outside its own group: two nodes of a bucket are
    in one group or were compared. Several tables with keys of their own are dealt out one after the other.

    `sketch` (node, kind and more columns) travels with the nodes: pairs of which `likely` says in SQL, given the names of the
    two nodes' structs of those columns, that they can't be links are dropped where they meet, before pairs are dealt out.
    """
    led = []
    for table in buckets if isinstance(buckets, list) else [buckets]:
        # the order puts the leader first; buckets of one node, nearly all, go before anything is stored
        led.append(stored(table.withColumn("lead", F.expr("first(struct(node, size)) over (partition by key order by n desc, node)"))
                          .withColumn("m", F.expr("count(*) over (partition by key)")).where("m > 1").drop("m", "n"), "buckets"))
    shares = led
    led = reduce(DataFrame.union, shares)
    near = led.where("node <> lead.node").where(fits("size", "lead.size")) \
        .select(F.greatest("node", "lead.node").alias("a"), F.least("node", "lead.node").alias("b"), F.expr(kind).alias("kind")).distinct()
    if sketch is not None:
        near = near.join(_side(sketch, "a", "x"), ["a", "kind"]).join(_side(sketch, "b", "y"), ["b", "kind"]) \
            .where(likely("x", "y")).select("a", "b").distinct()
    near = stored(near, "pairs")
    links = stored(alike(near), "led")
    discard(near)
    label = stored(components(links), "label")

    def named(df: DataFrame, node: str, to: str) -> DataFrame:
        return df.join(label.select(F.col("node").alias(node), F.col("component").alias(to)), node, "left") \
            .withColumn(to, F.coalesce(to, node))

    parts = named(led.select("key", "node", "size", F.col("lead.node").alias("lead")), "node", "part")
    parts = named(parts, "lead", "main").select("key", "node", "size", "part", "main", "lead")
    if sketch is not None:
        parts = parts.withColumn("kind", F.expr(kind)).join(_side(sketch, "node", "x"), ["node", "kind"]).drop("kind")
    parts = stored(parts, "parts")
    discard(*shares, label)
    carried = ["x"] if sketch is not None else []
    x = parts.where("part <> main").select("key", F.col("node").alias("a"), F.col("size").alias("sa"), F.col("part").alias("pa"), *carried)
    # the leader has met all; a bucket that is one group has nothing left to compare
    y = parts.where("node <> lead").select("key", F.col("node").alias("b"), F.col("size").alias("sb"), F.col("part").alias("pb"), "main",
                                           *[F.col(c).alias("y") for c in carried])
    # nodes outside the leader's group meet each other once
    rest = x.join(y, "key").where("pa <> pb and (pb = main or a > b)").where(fits("sa", "sb"))
    kinds = [F.expr(kind).alias("kind")]
    if sketch is not None:
        rest, kinds = rest.where(likely("x", "y")), []
    rest = stored(rest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), *kinds).distinct(), "rest")
    discard(parts)
    return components(links.union(alike(rest)))
