"""Communities over time: transitions between consecutive periods, paths through them and changes of membership.

``members`` tables have period, community and node, without repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.ordering import numbered
from kinweave.scratch import materialize


def next_periods(members: DataFrame) -> DataFrame:
    """Each period with the one that follows among those that occur (a row for each period)."""
    periods = members.select("period").distinct()
    return periods.withColumn("next_period", F.lead("period").over(Window.orderBy("period"))).where("next_period IS NOT NULL")


def transitions(members: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of communities of consecutive periods that share nodes, with Jaccard similarity of at least ``least``.

    An equi-join on node and period, so only pairs that share a node exist; a similarity of 0 never counts.
    """
    after = F.broadcast(next_periods(members))  # a row for each period
    sizes = members.groupBy("period", "community").agg(F.count(F.lit(1)).alias("size"))
    a = members.join(after, "period").select("period", "next_period", F.col("community").alias("source"), "node")
    b = members.select(F.col("period").alias("next_period"), F.col("community").alias("target"), "node")
    shared = a.join(b, ["next_period", "node"]).groupBy("period", "next_period", "source", "target").agg(F.count(F.lit(1)).alias("retained"))
    sa = sizes.select("period", F.col("community").alias("source"), F.col("size").alias("source_size"))
    sb = sizes.select(F.col("period").alias("next_period"), F.col("community").alias("target"), F.col("size").alias("target_size"))
    joined = shared.join(sa, ["period", "source"]).join(sb, ["next_period", "target"])
    scored = joined.withColumn("jaccard", F.col("retained") / (F.col("source_size") + F.col("target_size") - F.col("retained")))
    return scored.where(F.col("jaccard") >= least).select(
        "period", "next_period", "source", "target", "source_size", "target_size", "retained",
        (F.col("target_size") - F.col("retained")).alias("joined"), (F.col("source_size") - F.col("retained")).alias("exited"), "jaccard",
        F.concat_ws("_", "period", "source").alias("source_node"), F.concat_ws("_", "next_period", "target").alias("target_node"),
    )


def starts_and_ends(transition_rows: DataFrame) -> DataFrame:
    """Nodes of the transition graph with no way in (start) or out (end)."""
    a, b = transition_rows.select(F.col("source_node").alias("node")).distinct(), transition_rows.select(F.col("target_node").alias("node")).distinct()
    start = a.join(b, "node", "left_anti").withColumn("kind", F.lit("start"))
    return start.unionByName(b.join(a, "node", "left_anti").withColumn("kind", F.lit("end")))


def all_paths(transition_rows: DataFrame, periods: int) -> DataFrame:
    """Every simple path from a start to an end, as an array of nodes.

    Periods grow along a path, so it has at most ``periods`` - 1 steps and never repeats a node; each step is a join.
    """
    kinds = materialize(starts_and_ends(transition_rows), "kinds")
    ends = kinds.where("kind = 'end'").select(F.col("node").alias("last"))
    step = transition_rows.select(F.col("source_node").alias("last"), F.col("target_node").alias("following"))
    grown = kinds.where("kind = 'start'").select(F.array("node").alias("path"), F.col("node").alias("last"))
    found = grown.where("false").select("path")
    for _ in range(periods - 1):
        grown = materialize(grown.join(step, "last").select(F.concat("path", F.array("following")).alias("path"), F.col("following").alias("last")), "paths")
        found = found.unionByName(grown.join(ends, "last", "left_semi").select("path"))
    return found


def best_paths(transition_rows: DataFrame, periods: int, k: int = 5) -> DataFrame:
    """The ``k`` first of all paths from a start to an end: path_id, duration, retained_total, mean_jaccard and nodes.

    Longer ones come first, then those that retain more members, then the higher mean similarity, then the nodes.  Of
    paths of one length that meet in a node only the ``k`` first so far can be among the first in the end, as what
    follows adds the same to each; so each step keeps those, and work grows with the links times ``k``, where all paths
    together may be many more.  Paths that part later and tie in sums are told apart by their nodes.
    """
    kinds = materialize(starts_and_ends(transition_rows), "kinds")
    ends = kinds.where("kind = 'end'").select("node")
    step = transition_rows.select(F.col("source_node").alias("node"), F.col("target_node").alias("following"), F.col("retained").cast("long").alias("r"), F.col("jaccard").alias("j"))
    grown = kinds.where("kind = 'start'").select("node", F.array("node").alias("nodes"), F.lit(0).cast("long").alias("retained"), F.lit(0.0).alias("jaccard"))
    found = grown.where("false")
    first = Window.partitionBy("node", F.size("nodes")).orderBy(F.desc("retained"), F.desc(F.round("jaccard", 9)), "nodes")
    for _ in range(periods - 1):
        longer = grown.join(step, "node").select(F.col("following").alias("node"), F.concat("nodes", F.array("following")).alias("nodes"), (F.col("retained") + F.col("r")).alias("retained"), (F.col("jaccard") + F.col("j")).alias("jaccard"))
        grown = materialize(longer.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k).drop("place"), "paths")
        found = found.unionByName(grown.join(ends, "node", "left_semi"))
    duration = F.size("nodes").cast("long")
    rows = found.select(path_id(F.col("nodes")).alias("path_id"), duration.alias("duration"), F.col("retained").alias("retained_total"), F.round(F.col("jaccard") / (duration - 1), 6).alias("mean_jaccard"), "nodes")
    return rows.orderBy(F.desc("duration"), F.desc("retained_total"), F.desc("mean_jaccard"), "nodes").limit(k)


def path_id(path):
    """A stable id of a path: the first 16 hex digits of the SHA-256 of its nodes joined by the unit separator."""
    return F.concat(F.lit("path_"), F.substring(F.sha2(F.array_join(path, "\x1f").cast("binary"), 256), 1, 16))


def path_steps(paths: DataFrame) -> DataFrame:
    """path_id, step_index and node of every step."""
    return paths.select(path_id(F.col("path")).alias("path_id"), F.posexplode("path").alias("step_index", "node"))


def path_table(paths: DataFrame, transition_rows: DataFrame) -> DataFrame:
    """One row for each path: duration, transitions, mean similarity, retained total and its nodes."""
    steps = path_steps(paths).withColumn("before", F.lag("node").over(Window.partitionBy("path_id").orderBy("step_index")))
    edges = transition_rows.select(F.col("source_node").alias("before"), F.col("target_node").alias("node"), "jaccard", "retained")
    joined = steps.join(edges, ["before", "node"], "left")
    return joined.groupBy("path_id").agg(
        F.count(F.lit(1)).alias("duration"), (F.count(F.lit(1)) - 1).alias("transitions"), F.round(F.avg("jaccard"), 6).alias("mean_jaccard"),
        F.coalesce(F.sum("retained"), F.lit(0)).alias("retained_total"), F.sort_array(F.collect_list(F.struct("step_index", "node"))).getField("node").alias("nodes"),
    )


def ranked_paths(table: DataFrame) -> DataFrame:
    """Display order: longest first, then most retained, then the path's text."""
    text = F.array_join("nodes", " > ")
    return numbered(table, F.desc("duration"), F.desc("retained_total"), text, name="display_rank").withColumn("display_rank", F.col("display_rank") + 1)


def membership_changes(steps: DataFrame, members: DataFrame) -> DataFrame:
    """For each step of each path: sizes of the existing, new, lost and reappearing members and the change in size.

    Compared with the step before; a member is reappearing if it was seen in an earlier step but not in the last one.
    At the first step all members exist already.  ``members`` has node (``<period>_<community>``) and member.  Works on
    (path, member) rows with window functions, so a community's members are never gathered in one row.
    """
    rows = steps.join(members, "node").select("path_id", "step_index", "member")
    own = Window.partitionBy("path_id", "member").orderBy("step_index")
    seen = rows.withColumn("prev", F.lag("step_index").over(own)).withColumn("following", F.lead("step_index").over(own))
    state = seen.select(
        "path_id", "step_index",
        (F.col("prev") == F.col("step_index") - 1).alias("stays"), F.col("prev").isNull().alias("first"), (F.coalesce("following", F.lit(-1)) != F.col("step_index") + 1).alias("leaves"),
    )
    counts = state.groupBy("path_id", "step_index").agg(
        F.count(F.lit(1)).alias("size"), F.count_if("stays").alias("stayed"), F.count_if("first").alias("fresh"), F.count_if("leaves").alias("leaving")
    )
    at = Window.partitionBy("path_id").orderBy("step_index")
    all_steps = steps.select("path_id", "step_index").join(counts, ["path_id", "step_index"], "left").fillna(0)
    start = F.col("step_index") == 0
    return all_steps.select(
        "path_id", "step_index", "size",
        F.when(start, F.col("size")).otherwise(F.col("stayed")).alias("existing"), F.when(start, 0).otherwise(F.col("fresh")).alias("new"),
        F.coalesce(F.lag("leaving").over(at), F.lit(0)).alias("lost"),
        F.when(start, 0).otherwise(F.col("size") - F.col("stayed") - F.col("fresh")).alias("reappearing"), (F.col("size") - F.lag("size").over(at)).alias("size_delta"),
    )


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Weakly connected components of (source_node, target_node): node and the smallest node reachable.

    In a round labels spread one step and then to the label of their label, until none moves.  With ``rounds``, more
    rounds than that are an error.
    """
    both = materialize(edges.select(F.col("source_node").alias("node"), F.col("target_node").alias("other")).union(edges.select("target_node", "source_node")).distinct(), "links")
    labels = both.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("component"))
    done = 0
    while True:
        spread = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        beyond = labels.select(F.col("node").alias("near"), F.col("component").alias("next"))
        stepped = labels.join(spread, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("near")).join(beyond, "near")
        moved = materialize(stepped.select("node", F.least("near", "next").alias("component"), (F.least("near", "next") < F.col("old")).alias("moved")), "labels")
        labels = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return labels
        done += 1
        if rounds is not None and done > rounds:
            raise ValueError(f"labels still move after {rounds} rounds")


def sankey(transition_rows: DataFrame) -> DataFrame:
    """Positions of both nodes of each transition in the sorted list of all nodes."""
    nodes = transition_rows.select(F.explode(F.array("source_node", "target_node")).alias("node")).distinct()
    place = numbered(nodes, "node", name="place")
    a, b = place.toDF("source_node", "source_index"), place.toDF("target_node", "target_index")
    return transition_rows.join(a, "source_node").join(b, "target_node").select("source_node", "target_node", "source_index", "target_index", "jaccard")


def percent_change(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Change against the row before in percent of its absolute value; null without one or if it is 0."""
    prev = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return series.withColumn("percent_change", (F.col(value) - prev) / F.abs(F.nullif(prev, F.lit(0))) * 100)
