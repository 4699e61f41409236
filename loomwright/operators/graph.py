"""Bounded breadth-first search over a link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.session import materialize


def crawl_order(edges: DataFrame, seeds: DataFrame, max_depth: int = 3, max_pages: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """(url, depth) of the pages that are reached from the seeds (url, depth) in at most
    max_depth steps; edges: (src, dst). Pages in known are not visited again. Each level is one
    join and one anti join, written to the shared folder, so lineage stays short on any graph."""
    level = materialize(seeds.groupBy("url").agg(F.min("depth").alias("depth")))
    if known is not None:
        level = materialize(level.join(known.select("url"), "url", "left_anti"))
    seen = level
    while True:
        reached = level.where(F.col("depth") < max_depth).join(edges, F.col("url") == F.col("src")).groupBy("dst").agg(F.min("depth").alias("depth"))
        new = reached.select(F.col("dst").alias("url"), (F.col("depth") + 1).alias("depth")).join(seen.select("url"), "url", "left_anti")
        if known is not None:
            new = new.join(known.select("url"), "url", "left_anti")
        level = materialize(new)
        if level.isEmpty():
            break
        seen = materialize(seen.unionByName(level))
    return seen if max_pages is None else seen.orderBy("depth", "url").limit(max_pages)


def crawl_sites(edges: DataFrame, seeds: DataFrame, limits: DataFrame, rejected: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(site, url, depth) of the pages that each site's crawl accepts.

    edges: (site, src, dst); seeds: (site, url, depth); limits: (site, max_depth, max_pages);
    rejected: (url) pages that are fetched, but neither kept nor followed; known: (url) pages of
    any site's index, which are not fetched again and count as their site's pages only through
    max_pages of the caller. A level is visited in the order of depth and URL, and a site stops at
    its max_pages, after which it follows no links. Sites do not see each other's pages."""
    level = materialize(seeds.groupBy("site", "url").agg(F.min("depth").alias("depth")))
    seen, kept = level.select("site", "url"), None
    while True:
        new = level.join(limits, "site").where(F.col("depth") <= F.col("max_depth"))
        for gone in (rejected, known):
            if gone is not None:
                new = new.join(gone.select("url"), "url", "left_anti")
        count = limits.select("site", F.lit(0).alias("have")) if kept is None else kept.groupBy("site").agg(F.count("*").alias("have"))
        place = F.row_number().over(Window.partitionBy("site").orderBy("depth", "url"))
        new = new.join(count, "site", "left").withColumn("place", place + F.coalesce("have", F.lit(0))).where(F.col("place") <= F.col("max_pages"))
        new = materialize(new.select("site", "url", "depth", (F.col("place") < F.col("max_pages")).alias("more"), "max_depth"))
        kept = new.select("site", "url", "depth") if kept is None else materialize(kept.unionByName(new.select("site", "url", "depth")))
        ends = new.where("more and depth < max_depth").join(edges.withColumnRenamed("src", "url"), ["site", "url"])
        level = ends.groupBy("site", F.col("dst").alias("url")).agg((F.min("depth") + 1).alias("depth")).join(seen, ["site", "url"], "left_anti")
        level = materialize(level)
        if level.isEmpty():
            return kept
        seen = materialize(seen.unionByName(level.select("site", "url")))
