"""Connected components of a distributed edge list by random contraction.

Every round each node picks, of itself and its neighbours, the one with the
least round-dependent hash; nodes with one pick become one node and the edges
between different picks go on.  The expected number of nodes shrinks by a
constant factor whatever the shape (a chain of a million nodes takes about 30
rounds, a star two).  All state is in written tables; picks are partial
aggregates, so a hub with many neighbours is combined map-side.  Picks go whole
through the driver, as a broadcast, only in a round of at most ``SENT`` edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Edges of a round whose picks, two an edge at most, may be broadcast.
SENT = 100_000


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(u, v)``; two nodes have
    equal ``component`` iff a path joins them.  Null ends are ignored."""
    live = staged(
        edges.filter("u is not null and v is not null and u <> v")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    labels: DataFrame | None = None
    turn = 0
    while True:
        n_live = live.count()
        if n_live == 0:
            return labels if labels is not None else live.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = live.union(live.select("v", "u"))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("x"))  # noqa: E731, B023
        picks = staged(
            both.groupBy("u")
            .agg(F.min(rank("v")).alias("best"))
            .select(F.col("u").alias("node"), F.least(rank("u"), F.col("best"))["x"].alias("pick")),
            "picks",
        )
        if n_live > SENT:  # Spark would go by the size of the compressed file
            picks = picks.hint("merge")
        pick_u = picks.select(F.col("node").alias("u"), F.col("pick").alias("pu"))
        pick_v = picks.select(F.col("node").alias("v"), F.col("pick").alias("pv"))
        live = staged(
            live.join(pick_u, "u")
            .join(pick_v, "v")
            .filter("pu <> pv")
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
            .distinct(),
            "edges",
        )
        if labels is None:
            labels = picks.select("node", F.col("pick").alias("component"))
        else:
            onward = picks.select(F.col("node").alias("component"), "pick")
            labels = labels.join(onward, "component", "left").select(
                "node", F.coalesce("pick", "component").alias("component")
            )
        labels = staged(labels, "components")
        turn += 1
