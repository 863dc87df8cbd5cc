"""Interaction edges from messages: who spreads whom, in absolute (IF) and relative (WIF) weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.scratch import discard, materialize


def normalized_id(column):
    """An identifier as text: integral floats without ``.0``, blanks as null."""
    text = F.trim(column.cast("string"))
    return F.nullif(F.regexp_replace(text, r"^(-?\d+)\.0$", "$1"), F.lit(""))


def join_relations(relations: DataFrame, creator: str, spreader: str) -> DataFrame:
    """Messages from a creator and a spreader relation, joined on the message id as text.

    ``relations`` has message_id, user_id and relation.  Many to many: each creator row of a message meets each
    spreader row.  Null and blank ids join nothing.
    """
    key = normalized_id(F.col("message_id"))
    sides = relations.select(key.alias("message_id"), "user_id", "relation").where("message_id IS NOT NULL")
    made = sides.where(F.col("relation") == creator).select("message_id", F.col("user_id").alias("from_id"))
    spread = sides.where(F.col("relation") == spreader).select("message_id", F.col("user_id").alias("forwarder_id"))
    return made.join(spread, "message_id")


def edge_metrics(messages: DataFrame, author: str = "from_id", spreader: str = "forwarder_id") -> DataFrame:
    """source, target, total_post, shared_post, weighted_post for each pair of author and spreader.

    ``total_post`` counts every message of the author, those without spreader and to oneself included; such messages
    make no edge.  Totals are sums of the pre-aggregated pair counts, so messages are shuffled once.
    """
    return edges_of_counts(pair_counts(messages, author, spreader))


def pair_counts(messages: DataFrame, author: str = "from_id", spreader: str = "forwarder_id") -> DataFrame:
    """source, target, shared_post: messages of each pair, with those of no spreader (null target) and to oneself."""
    known = messages.where(F.col(author).isNotNull())
    return known.groupBy(F.col(author).alias("source"), F.col(spreader).alias("target")).agg(F.count(F.lit(1)).alias("shared_post"))


def edges_of_counts(pairs: DataFrame) -> DataFrame:
    """The edges of ``pair_counts``, which may have been added up over time."""
    totals = pairs.groupBy("source").agg(F.sum("shared_post").alias("total_post"))
    return (
        pairs.where("target IS NOT NULL AND source <> target")
        .join(totals, "source")
        .select("source", "target", "total_post", "shared_post", (F.col("shared_post") / F.col("total_post")).alias("weighted_post"))
    )


def threshold(edges: DataFrame, min_total: int, min_shared: int) -> DataFrame:
    """Edges at or above both thresholds."""
    return edges.where((F.col("total_post") >= min_total) & (F.col("shared_post") >= min_shared))


def single_author(messages: DataFrame, author_id) -> DataFrame:
    """Spreaders of one author with their counts and shares of the author's messages."""
    mine = messages.where(F.col("from_id") == author_id)
    counts = mine.groupBy(F.col("forwarder_id").alias("target")).agg(F.count(F.lit(1)).alias("shared_post"))
    total = counts.agg(F.sum("shared_post").alias("total_post"))  # one row
    return counts.where(F.col("target").isNotNull() & (F.col("target") != author_id)).crossJoin(F.broadcast(total)).withColumn("weighted_post", F.col("shared_post") / F.col("total_post"))


def snapshot(edges: DataFrame, data_type: str, content_type: str, month: int, year: int) -> DataFrame:
    """The nine columns of a published interaction table."""
    return edges.select(
        F.lit(data_type).alias("data_type"), F.lit(content_type).alias("content_type"), F.lit(year).alias("year"), F.lit(month).alias("month"),
        "source", "target", "total_post", "shared_post", "weighted_post",
    )


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Interactions merged by pair: counts add up, the weight follows, 0 where the total is 0; no edges to oneself."""
    both = old.select("source", "target", "total_post", "shared_post").unionByName(new.select("source", "target", "total_post", "shared_post"))
    sums = both.where("source <> target").groupBy("source", "target").agg(F.sum("total_post").alias("total_post"), F.sum("shared_post").alias("shared_post"))
    return weighted(sums)


def weighted(sums: DataFrame) -> DataFrame:
    """With the weight of each pair's counts, 0 where the total is 0."""
    return sums.withColumn("weighted_post", F.when(F.col("total_post") == 0, 0.0).otherwise(F.col("shared_post") / F.col("total_post")))


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct nodes at either end."""
    return edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """in_degree and out_degree of every node; parallel edges count each, nodes without edges have 0."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    counts = ends.groupBy(F.col("x.node").alias("node")).agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))
    return nodes.join(counts, "node", "left").select("node", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree centralities, degree / (n - 1) with n nodes; with one node the centrality is 1 by convention."""
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    scale = F.when(F.col("n") > 1, 1.0 / (F.col("n") - 1))
    return degrees(nodes, edges).crossJoin(F.broadcast(n)).select(
        "node", F.coalesce(F.col("in_degree") * scale, F.lit(1.0)).alias("in_centrality"), F.coalesce(F.col("out_degree") * scale, F.lit(1.0)).alias("out_centrality")
    )


def centrality_summary(scores: DataFrame) -> DataFrame:
    """Largest, smallest and mean centralities with the nodes that have them; the smallest node of those that tie."""
    first = lambda c, sign: F.min_by("node", F.struct(sign * F.col(c), F.col("node")))
    return scores.agg(
        F.max("in_centrality").alias("max_in"), first("in_centrality", -1).alias("max_in_node"), F.min("in_centrality").alias("min_in"), first("in_centrality", 1).alias("min_in_node"), F.avg("in_centrality").alias("avg_in"),
        F.max("out_centrality").alias("max_out"), first("out_centrality", -1).alias("max_out_node"), F.min("out_centrality").alias("min_out"), first("out_centrality", 1).alias("min_out_node"), F.avg("out_centrality").alias("avg_out"),
    )


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (column node)."""
    return edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi").select(*edges.columns)


def graph_info(edges: DataFrame) -> DataFrame:
    """Nodes, edges and the density m / (n (n - 1)) of a directed multigraph."""
    n = endpoints(edges).agg(F.count(F.lit(1)).alias("nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("edges"))
    return n.crossJoin(m).withColumn("density", F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0))


def strong_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of a directed graph.

    Nodes without a way in or out are components of their own and are trimmed first.  Then the highest node that
    leads to each node is its colour; the nodes of a colour that lead back to that highest node are a component.  They
    are taken out, and what is left is coloured anew.  Each step of a colour is a join; rounds are as many as the
    longest way that colours go.  Null ends are left out.
    """
    links = materialize(edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct(), "links")
    left = materialize(endpoints(links).select("node"), "left")
    found = left.where("false").select("node", F.col("node").alias("component"))
    links = links.where("source <> target")
    while not left.isEmpty():
        inner = left.join(links.select(F.col("target").alias("node")), "node", "left_semi").join(links.select(F.col("source").alias("node")), "node", "left_semi")
        inner = materialize(inner, "left")
        trimmed = left.join(inner, "node", "left_anti")
        found = found.unionByName(trimmed.select("node", F.col("node").alias("component")))
        if inner.count() == left.count():
            colours = _spread(inner.select("node", F.col("node").alias("colour")), links)
            ends = colours.toDF("source", "cs"), colours.toDF("target", "ct")
            own = links.join(ends[0], "source").join(ends[1], "target").where("cs = ct")
            back = own.select(F.col("target").alias("source"), F.col("source").alias("target"))
            seeds = colours.select("node", F.when(F.col("node") == F.col("colour"), F.col("colour")).alias("colour"))
            met = materialize(_spread(seeds, back).where("colour IS NOT NULL"), "met")
            names = met.groupBy("colour").agg(F.min("node").alias("component"))
            found = found.unionByName(met.join(names, "colour").select("node", "component"))
            inner = materialize(inner.join(met, "node", "left_anti"), "left")
        left = inner
        kept = lambda c: left.select(F.col("node").alias(c))
        links = materialize(links.join(kept("source"), "source", "left_semi").join(kept("target"), "target", "left_semi"), "links")
    return found


def _spread(state: DataFrame, links: DataFrame) -> DataFrame:
    """node and the highest colour that reaches it along ``links``; null colours take any."""
    state = materialize(state, "colours")
    while True:
        came = links.join(state.select(F.col("node").alias("source"), "colour"), "source").groupBy(F.col("target").alias("node")).agg(F.max("colour").alias("came"))
        higher = F.col("came").isNotNull() & (F.col("colour").isNull() | (F.col("came") > F.col("colour")))
        after = materialize(state.join(came, "node", "left").select("node", F.when(higher, F.col("came")).otherwise(F.col("colour")).alias("colour"), higher.alias("moved")), "colours")
        discard(state)
        if after.where("moved").isEmpty():
            return after.select("node", "colour")
        state = materialize(after.select("node", "colour"), "colours")
        discard(after)


def strongly_connected(edges: DataFrame) -> DataFrame:
    """One row: whether every node leads to every other; false for an empty graph."""
    return strong_components(edges).agg((F.count_distinct("component") == 1).alias("is_strongly_connected"))


def daily_statistics(messages: DataFrame, day) -> DataFrame:
    """Messages a day over the days that occur: least, most, mean and sample deviation; the earliest day of a tie."""
    days = messages.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n")).where("day IS NOT NULL")
    return days.agg(
        F.min("n").alias("min_messages"), F.min_by("day", F.struct("n", "day")).alias("min_day"), F.max("n").alias("max_messages"),
        F.min_by("day", F.struct(-F.col("n"), F.col("day"))).alias("max_day"), F.stddev_samp("n").alias("std_messages"), F.avg("n").alias("mean_messages"),
    )


def strongest_edges(community_edges: DataFrame, n: int) -> DataFrame:
    """The ``n`` heaviest edges; ties by community as text, source, target.  None if n is not positive."""
    order = [F.desc("weight"), F.col("community_number").cast("string"), F.col("source"), F.col("target")]
    return community_edges.orderBy(*order).limit(max(0, n))


def undirected(edges: DataFrame) -> DataFrame:
    """Edges folded by unordered pair, with the weights and counts of both directions."""
    forward = F.col("source") <= F.col("target")
    return edges.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(
        F.sum(F.when(forward, F.col("weight")).otherwise(0.0)).alias("forward_weight"),
        F.sum(F.when(~forward, F.col("weight")).otherwise(0.0)).alias("reverse_weight"),
        F.sum(F.when(forward, 1).otherwise(0)).alias("forward_edges"),
        F.sum(F.when(~forward, 1).otherwise(0)).alias("reverse_edges"),
    )


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an explicit order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


#: Cells of a layout along either side, and the steps that it takes.
CELLS, STEPS = 16, 12


def force_layout(edges: DataFrame, steps: int = STEPS) -> DataFrame:
    """node, x and y by springs along edges (source, target, weight) and repulsion between all nodes.

    Nodes begin at hashed places in a square.  In each step a node is drawn to its neighbours and pushed away by the
    mean places of the CELLS x CELLS cells, each by the number of nodes in it, so that no pairs of nodes are formed; it
    moves by no more than the step's temperature, which falls.  Cells are a row each and reach all nodes as one array of
    bounded size.
    """
    both = edges.select("source", "target", "weight").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    links = materialize(both.where("source <> target").groupBy("source", "target").agg(F.sum("weight").alias("weight")), "links")
    hashed = lambda seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    at = materialize(endpoints(edges).select("node", hashed(1).alias("x"), hashed(2).alias("y")), "layout")
    ideal = 1.0 / max(1, at.count()) ** 0.5
    for step in range(steps):
        cell = lambda c: F.least(F.greatest(F.floor(F.col(c) * CELLS), F.lit(0)), F.lit(CELLS - 1))
        cells = at.groupBy(cell("x").alias("i"), cell("y").alias("j")).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
        crowd = cells.agg(F.array_sort(F.collect_list(F.struct("i", "j", "n", "cx", "cy"))).alias("crowd"))  # CELLS * CELLS entries
        ends = at.select(F.col("node").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"))
        pulls = links.join(ends, "target").join(at.withColumnRenamed("node", "source"), "source")
        away = F.sqrt((F.col("tx") - F.col("x")) ** 2 + (F.col("ty") - F.col("y")) ** 2)
        drawn = pulls.groupBy("source").agg(F.sum((F.col("tx") - F.col("x")) * away / ideal).alias("px"), F.sum((F.col("ty") - F.col("y")) * away / ideal).alias("py")).withColumnRenamed("source", "node")

        def push(c: str, own: str) -> Column:
            far = lambda k: (F.col("x") - k["cx"]) ** 2 + (F.col("y") - k["cy"]) ** 2 + F.lit(ideal**2)  # noqa: E731, B023
            return F.aggregate("crowd", F.lit(0.0), lambda sum_, k: sum_ + k["n"] * F.lit(ideal**2) * (F.col(own) - k[c]) / far(k))

        moved = at.crossJoin(F.broadcast(crowd)).join(drawn, "node", "left")
        dx, dy = push("cx", "x") + F.coalesce("px", F.lit(0.0)), push("cy", "y") + F.coalesce("py", F.lit(0.0))
        length = F.sqrt(dx**2 + dy**2) + F.lit(1e-12)
        reach = F.least(length, F.lit(0.1 * (1 - step / steps))) / length
        after = materialize(moved.select("node", (F.col("x") + dx * reach).alias("x"), (F.col("y") + dy * reach).alias("y")), "layout")
        discard(at)
        at = after
    return at
