"""Connected components of a link table, as rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshlane.llm.common import written
from freshlane.llm.private import may_be, term_filter

#: Words of 64 bits in the filter of shared bucket keys (1 MB, whatever the input).
KEY_FILTER = 1 << 17
#: A round of centres is followed by another if it settled at least this share of the rows.
WORTH = 0.25


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of ``links`` (a, b; any orderable type) the smallest node it reaches.

    Each round sends every node to the smallest of itself and its neighbours, and contracts the links
    by that; the rounds end when no link is left, after about the logarithm of the longest path.
    A hub's links are pre-aggregated before their shuffle, and its joins are sort-merge joins that
    adaptive execution splits. Null ends and self-links are ignored; an empty table has no nodes.
    """
    edges = links.select("a", "b").where("a <> b").distinct()
    edges = written(edges, "links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    roots = nodes.select("node", F.col("node").alias("root"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = (both.groupBy("a").agg(F.min("b").alias("b"))
                  .select(F.col("a").alias("node"), F.least("a", "b").alias("parent")))
        parent = written(parent, "parents")
        to_a = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        to_b = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        edges = (edges.join(to_a, "a").join(to_b, "b").where("pa <> pb")
                 .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        edges = written(edges, "links")
        roots = (roots.join(parent.select(F.col("node").alias("root"), "parent"), "root", "left")
                 .select("node", F.coalesce("parent", "root").alias("root")))
        roots = written(roots, "roots")
    return roots


def links_within_buckets(buckets: DataFrame, methods) -> DataFrame:
    """Verified links that connect all nodes linked inside any bucket of ``buckets`` (key, node).

    ``methods(members)`` gets the nodes that share buckets (key, node, centre) and returns two functions:
    ``verify`` takes pairs (a, b) and returns those that are links; ``settle`` takes members of buckets with
    their component (key, node, root) and returns links that join all components that links inside a bucket join.

    In each bucket every node is compared with one centre, after which the centre has met all others and leaves the
    bucket. Buckets whose nodes are then in one component are done; the others go through another round, with the node
    that is linked to most first centres as the next centre. Rounds end when one settles less than ``WORTH`` of the
    rows; what stays in different components goes to ``settle``. So no link inside a bucket is lost, while a large
    group of alike nodes costs a linear number of comparisons.
    """
    sized = buckets.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("other"))
    shared = sized.where("centre <> other").select("key", "centre")
    shared = written(shared, "shared-keys")
    maybe = term_filter(shared.select(F.col("key").alias("term")), KEY_FILTER)       # spares single keys the shuffle
    members = written(buckets.where(may_be(maybe, F.col("key"), KEY_FILTER)).join(shared, "key"), "buckets")
    verify, settle = methods(members)
    first = members.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    links = first_links = written(verify(first), "links-first")

    def unsettled(rows):
        """The rows (key, node, root, links) of the buckets that hold several components."""
        mixed = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        return written(rows.join(mixed.select("key"), "key", "left_semi"), "unsettled")

    # a node that is linked to many of its centres is in the middle of its group
    degree = first_links.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("links"))
    known = written(connected_components(links).join(degree, "node", "left"), "known")
    rest = unsettled(members.where("node <> centre").join(known, "node", "left")
                     .select("key", "node", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    before, now = None, rest.count()
    while now and (before is None or now <= (1 - WORTH) * before):
        centres = written(rest.groupBy("key").agg(F.max(F.struct("links", "node", "root")).alias("c"))
                          .select("key", F.col("c.node").alias("c"), F.col("c.root").alias("croot")), "centres")
        met = rest.join(centres, "key").where("node <> c")
        pairs = met.where("root <> croot").select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()
        found = written(verify(pairs), "links-next")
        links = links.unionByName(found)
        root_of = rest.select("node", "root").distinct()
        joined = (found.join(root_of.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
                  .join(root_of.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b"))
        merged = connected_components(joined.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        left = met.select("key", "node", "root", "links").join(
            merged.select(F.col("node").alias("root"), F.col("root").alias("into")), "root", "left")
        rest = unsettled(left.select("key", "node", F.coalesce("into", "root").alias("root"), "links"))
        before, now = now, rest.count()
    return written(links.unionByName(settle(rest)) if now else links, "links")
