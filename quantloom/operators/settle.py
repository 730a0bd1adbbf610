"""First come, first kept: the lexicographically first maximal independent set of a conflict graph, in rounds.

An ordered pass keeps each item that conflicts with none kept before it. Here an item is settled as soon as all
its earlier neighbours are: it is dropped if one of them is kept, kept if none is. A round settles all such items at
once with joins of the edges that are still open, so there is no order to walk and no group to gather; rounds
are as many as the longest chain of items that wait for each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.sources.shared import Tables


def first_kept(edges: DataFrame, tables: Tables | None = None, cliques: DataFrame | None = None) -> DataFrame:
    """dropped, kept: each item that is not kept, and the first kept item before it that it conflicts with.

    edges: earlier, later: pairs of items that conflict, each named by its place in the order. cliques: item, clique:
    items of one clique all conflict; their pairs are never made, since a clique keeps at most one item. An item without
    a conflict, and each that no row names as dropped, is kept.
    """
    tables = tables or Tables()
    all_ = tables.stored(edges.select("earlier", "later").where(F.col("earlier") < F.col("later")).distinct(), "conflicts")
    if cliques is None:
        cliques = all_.select(F.col("later").alias("item"), F.col("later").cast("string").alias("clique")).limit(0)
    members = tables.stored(cliques.select("item", "clique").where("clique is not null").distinct(), "cliques")
    open_, inside, kept_all, gone_all = all_, members, None, None
    while True:
        first = inside.groupBy(F.col("clique").alias("_c")).agg(F.min("item").alias("_first"))
        placed = inside.join(first, F.col("clique") == F.col("_c")).select("item", "clique", "_first")
        waiting = open_.select(F.col("later").alias("_w")).unionByName(placed.where("item > _first").select(F.col("item").alias("_w"))).distinct()
        items = open_.select(F.col("earlier").alias("_k")).unionByName(inside.select(F.col("item").alias("_k"))).distinct()
        kept = tables.stored(items.join(waiting, F.col("_k") == F.col("_w"), "left_anti"), "kept")
        beside = placed.join(kept, F.col("_first") == F.col("_k")).where("item > _first").select(F.col("item").alias("_d"))
        out = tables.stored(open_.join(kept, F.col("earlier") == F.col("_k")).select(F.col("later").alias("_d")).unionByName(beside).distinct(), "dropped")
        kept_all = kept if kept_all is None else kept_all.unionByName(kept)
        gone_all = out if gone_all is None else gone_all.unionByName(out)
        # an edge is closed when its later item is dropped or its earlier one settled; a member leaves its clique when it is settled
        settled = out.unionByName(kept.select(F.col("_k").alias("_d")))
        open_ = tables.stored(open_.join(out, F.col("later") == F.col("_d"), "left_anti").join(settled, F.col("earlier") == F.col("_d"), "left_anti"), "open")
        inside = tables.stored(inside.join(settled, F.col("item") == F.col("_d"), "left_anti"), "inside")
        if open_.isEmpty() and inside.isEmpty():
            break
    kept, gone = tables.stored(kept_all.distinct(), "kept"), tables.stored(gone_all.distinct(), "gone")
    by_edge = all_.join(gone, F.col("later") == F.col("_d")).join(kept, F.col("earlier") == F.col("_k")).select("later", "earlier")
    heads = members.join(kept, F.col("item") == F.col("_k")).select(F.col("clique").alias("_c"), F.col("item").alias("earlier"))
    by_clique = members.join(heads, F.col("clique") == F.col("_c")).where("item > earlier").select(F.col("item").alias("later"), "earlier")
    return by_edge.unionByName(by_clique).groupBy(F.col("later").alias("dropped")).agg(F.min("earlier").alias("kept"))
