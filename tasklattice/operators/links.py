"""Following links from task to task by pointer doubling: rounds grow with the logarithm of a chain's length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, release

HASH = F.xxhash64


def single_links(rows: DataFrame, link: str) -> DataFrame:
    """(id, to) for every id with a link, written; an id on several rows has its smallest link."""
    given = rows.where(F.col("id").isNotNull() & F.col(link).isNotNull())
    return materialise(given.groupBy("id").agg(F.min(link).alias("to")))


def _doubled(hops: DataFrame) -> DataFrame:
    """Twice as many steps at once, for the ids that have so many ahead of them."""
    further = hops.select(F.col("id").alias("to"), F.col("to").alias("next"))
    return materialise(hops.join(further, "to").select("id", F.col("next").alias("to")))


def _hashed(links: DataFrame) -> DataFrame | None:
    """The links by 64-bit hashes of their ids, written; None if two of the ids have one hash, as a second hash tells."""
    ids = links.select("id").unionByName(links.select(F.col("to").alias("id")))
    other = F.xxhash64(F.lit(1), F.col("id"))
    shared = ids.groupBy(HASH("id").alias("hash")).agg(F.min(other).alias("low"), F.max(other).alias("high")).where("low <> high")
    return materialise(links.select(HASH("id").alias("id"), HASH("to").alias("to"))) if shared.isEmpty() else None


def on_cycles(links: DataFrame) -> DataFrame:
    """The links (id, to) whose ids stand on a cycle; ``links`` come from ``single_links``.

    The ids that still have 2^k steps ahead of them are fewer and fewer, until all that
    are left lead into cycles: then a round loses none. The ids where they
    arrive are fewer and fewer, until all of them stand on a cycle: then a step only
    moves them about, and a round finds as many. Rounds grow with the logarithm of the
    longest chain outside of cycles, whatever the cycles' lengths.

    The rounds move hashes of the ids, which are shorter; if two ids share a hash, they move the ids.
    """
    short = _hashed(links)
    hops = links if short is None else short
    arrivals = lambda hops: hops.agg(F.count_distinct("to")).first()[0]
    size = hops.count()
    while size:
        longer = _doubled(hops)
        before, size = size, longer.count()
        done = size == before and arrivals(longer) == arrivals(hops)
        if hops is not links:
            release(hops)
        hops = longer
        if done:
            break
    arrived = hops.select(F.col("to").alias("_arrived")).distinct()
    return links.join(arrived, (F.col("id") if short is None else HASH("id")) == F.col("_arrived"), "left_semi")


def reached(seeds: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
    """The ids (id) that the links (id, to) lead to from the seeds, none of them a seed; and how many.

    After k rounds all ids within 2^k - 1 steps are found; a round that adds none is the last.
    """
    found: list[DataFrame] = []
    hops, count = links, 0
    while True:
        known = reduce(DataFrame.unionByName, found, seeds.select("id"))
        new = materialise(
            hops.join(known, "id", "left_semi").select(F.col("to").alias("id")).distinct().join(known, "id", "left_anti")
        )
        added = new.count()
        if not added:
            break
        found.append(new)
        count += added
        hops = _doubled(hops)
    return (reduce(DataFrame.unionByName, found) if found else new), count


def leading_to(marked: DataFrame, links: DataFrame) -> DataFrame:
    """The ids (id) whose links (id, to) lead to a marked id, sooner or later; none of them marked.

    After k rounds all ids less than 2^k steps away are found; a round that adds none is the last.
    """
    found: list[DataFrame] = []
    hops = links
    while True:
        known = reduce(DataFrame.unionByName, found, marked.select("id"))
        ahead = known.select(F.col("id").alias("to"))
        new = materialise(hops.join(ahead, "to", "left_semi").select("id").join(known, "id", "left_anti").distinct())
        if new.isEmpty():
            return reduce(DataFrame.unionByName, found) if found else new
        found.append(new)
        hops = _doubled(hops)
