"""Bounded breadth-first search over typed edges, from many nodes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.shared import materialize

#: Edges of a node that one task follows; nodes with more are hubs, whose edges are dealt to several.
HUB_EDGES = 10_000


def split_hubs(edges: DataFrame, most: int = HUB_EDGES) -> tuple[DataFrame, DataFrame]:
    """``edges`` with ``part``, and (src, kind, parts) of the hubs: nodes with over ``most`` edges of a kind."""
    degrees = edges.groupBy("src", "kind").agg(F.count("*").alias("n"))
    hubs = materialize(degrees.where(F.col("n") > most).select("src", "kind", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    # Of all nodes at most edges / most are hubs; the join leaves their choice of strategy to the optimizer.
    dealt = edges.join(hubs, ["src", "kind"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("dst"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    return dealt, hubs


def reached(edges: DataFrame, starts: DataFrame, depth: int, kinds: list[list[str]] | None = None, back: bool = False, most: int = HUB_EDGES) -> DataFrame:
    """[C37, C41, J16] (start, node, hops, path): every node within ``depth`` edges of each start, at its first visit.

    edges(src, kind, dst), starts(start); nodes are texts.  ``path`` lists (kind, node) from the start; of equally
    short paths the least.  ``kinds`` names the kinds that each hop may take, ``back`` follows edges from their
    target to their source as well (their kind is then written ``<kind``).  A start is not visited again; nulls
    lead nowhere.  The frontier only holds what the last hop visited for the first time.
    """
    edges = edges.where("src is not null and dst is not null").select("src", "kind", "dst")
    if back:
        edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.concat(F.lit("<"), "kind").alias("kind"), F.col("src").alias("dst")))
    dealt, hubs = split_hubs(materialize(edges.distinct()), most)
    dealt = materialize(dealt)
    step = "array<struct<kind:string,node:string>>"
    frontier = starts.where("start is not null").select("start").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("hops"), F.array().cast(step).alias("path"))
    seen, found = materialize(frontier), []
    frontier = seen
    for hop in range(1, depth + 1):
        taken = F.col("kind").isin(kinds[hop - 1]) if kinds else F.lit(True)
        allowed = dealt.where(taken)
        split = hubs.where(taken).groupBy("src").agg(F.max("parts").alias("parts"))
        at = frontier.join(split, frontier["node"] == split["src"], "left").drop("src")
        # A row at a hub goes to each of the tasks that have some of its edges that this hop may take.
        at = at.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
        # Sizes of tables in between are guessed, often far too small: neither side may go through the driver.
        met = at.join(allowed.hint("merge"), (at["node"] == allowed["src"]) & (at["part"] == allowed["part"]))
        longer = met.select("start", F.col("dst").alias("to"), F.concat("path", F.array(F.struct("kind", F.col("dst").alias("node")))).alias("path"))
        new = longer.groupBy("start", "to").agg(F.min("path").alias("path")).withColumnRenamed("to", "node")
        frontier = materialize(new.join(seen.select("start", "node").hint("merge"), ["start", "node"], "left_anti").select("start", "node", F.lit(hop).alias("hops"), "path"))
        seen = seen.select("start", "node").unionByName(frontier.select("start", "node"))
        found.append(frontier)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
