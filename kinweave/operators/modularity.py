"""Communities of high modularity by conflict-free moves, on DataFrames.

In a round communities stand in an order of their own, a hash of label and round, and every node moves to the community
above its own that it gains most by joining.  So nodes of two communities never change places.  What is left to go wrong
is that a node follows a neighbour that moves on, or that many crowd into one community at once; so the modularity of
every state is computed, a round that does not raise it is taken back, and half as many of its moves are tried, down to
the single best one, which always raises it.
Modularity therefore rises from state to state, and a level ends.  Then communities become nodes, as long as they get
fewer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.ordering import numbered
from kinweave.scratch import discard, materialize

#: A level ends once all moves that are left would bring less than this by themselves, or PATIENCE rounds less together.
LEAST_GAIN, PATIENCE = 1e-3, 3
#: Moves are worth making above this gain.
EPSILON = 1e-10


def modularity_communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """node and community_number of directed, weighted edges (source, target, weight).

    Communities are named by their smallest member, then numbered.  Every state is a written table, deleted when the
    next one stands.  Edges without a weight add nothing, and edges that add up to nothing leave each node alone.
    """
    current = materialize(edges.groupBy("source", "target").agg(F.sum(F.coalesce("weight", F.lit(0.0))).cast("double").alias("weight")), "edges")
    assigned = None
    while True:
        moved, fewer = _move_all(current, resolution)
        labels = moved.select("node", "label")
        if assigned is None:
            assigned, kept = labels, moved
        elif fewer:
            renamed = labels.select(F.col("node").alias("label"), F.col("label").alias("upper"))
            assigned = materialize(assigned.join(renamed, "label").select("node", F.col("upper").alias("label")), "assigned")
            discard(kept)
            kept = assigned
        if not fewer:
            break
        a, b = labels.toDF("source", "ls"), labels.toDF("target", "lt")
        joined = current.join(a, "source").join(b, "target").groupBy(F.col("ls").alias("source"), F.col("lt").alias("target"))
        following = materialize(joined.agg(F.sum("weight").alias("weight")), "edges")
        discard(current)
        current = following
    first = assigned.groupBy("label").agg(F.min("node").alias("first"))
    return assigned.join(numbered(first, "first", name="community_number"), "label").select("node", "community_number")


def _move_all(edges: DataFrame, resolution: float) -> tuple[DataFrame, bool]:
    """node and label once moves bring next to nothing, written, and whether there are fewer labels than nodes."""
    total = float(edges.agg(F.sum("weight")).first()[0] or 0.0)
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "weight").unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), "weight"))
    links = materialize(both.where("node <> other").groupBy("node", "other").agg(F.sum("weight").alias("w")), "links")
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("weight").alias("o"), F.lit(0.0).alias("i")), F.struct(F.col("target").alias("node"), F.lit(0.0).alias("o"), F.col("weight").alias("i")))).alias("x"))
    degree = ends.groupBy(F.col("x.node").alias("node")).agg(F.sum("x.o").alias("out_w"), F.sum("x.i").alias("in_w"))
    state = materialize(degree.withColumn("label", F.col("node")), "state")
    nodes = state.count()
    if total <= 0:
        return state.select("node", "label"), False
    state, good, highest, stalled, tries, r = state.withColumnRenamed("label", "own"), None, None, [], 0, 0
    while True:
        wishes = materialize(_wishes(links, state, total, resolution, r), "wishes")
        now = wishes.agg(F.sum("part").alias("q"), F.sum("left").alias("left")).first()
        r += 1
        if highest is None or now["q"] > highest + EPSILON or tries == 0 and now["q"] >= highest - EPSILON:
            stalled = [*stalled, now["q"] - highest][-PATIENCE:] if highest is not None else []
            if good is not None:
                discard(good)
            good, highest, tries = wishes, now["q"], 0
            if now["left"] < LEAST_GAIN or len(stalled) == PATIENCE and sum(stalled) < LEAST_GAIN:
                break
        else:  # taken back: half as many of the same moves, in the end only the best one
            discard(wishes)
            tries += 1
            if tries > 9:
                break
        state = _moved(good, tries, r)
    discard(links)
    moved = materialize(good.select("node", F.col("own").alias("label")), "labels")
    discard(good)
    return moved, moved.select("label").distinct().count() < nodes


def _wishes(links: DataFrame, state: DataFrame, total: float, resolution: float, r: int) -> DataFrame:
    """For each node of ``state`` (node, own, out_w, in_w) the best community that it may move to, and figures.

    ``gain``: what that move brings; ``left``: what the best move of all would bring; ``part``: the node's part of the
    modularity as things are, half of its links inside and its share of its community's squares (loops add the same in
    every state and are left out).
    """
    sums = state.groupBy(F.col("own").alias("label")).agg(F.sum("out_w").alias("com_out"), F.sum("in_w").alias("com_in"))
    near = links.join(state.select(F.col("node").alias("other"), F.col("own").alias("label")), "other").select("node", "label", "w")
    options = near.unionByName(state.select("node", F.col("own").alias("label"), F.lit(0.0).alias("w"))).groupBy("node", "label").agg(F.sum("w").alias("w"))
    mine = F.col("label") == F.col("own")
    rest_in = F.col("com_in") - F.when(mine, F.col("in_w")).otherwise(0.0)
    rest_out = F.col("com_out") - F.when(mine, F.col("out_w")).otherwise(0.0)
    score = F.round(F.col("w") / total - resolution * (F.col("out_w") * rest_in + F.col("in_w") * rest_out) / (total * total), 12)
    part = F.when(mine, F.col("w") / total / 2 - resolution * F.col("out_w") * F.col("com_in") / (total * total))
    allowed = F.when(F.xxhash64("label", F.lit(r)) > F.xxhash64("own", F.lit(r)), F.col("score"))
    scored = options.join(state, "node").join(sums, "label").select("node", "label", "own", "out_w", "in_w", score.alias("score"), mine.alias("mine"), part.alias("part"))
    stay = F.max(F.when(F.col("mine"), F.col("score")))
    return scored.groupBy("node", "own", "out_w", "in_w").agg(
        F.min_by("label", F.when(allowed.isNotNull(), F.struct(-allowed, F.col("label")))).alias("best"), (F.max(allowed) - stay).alias("gain"), (F.max("score") - stay).alias("left"), F.max("part").alias("part")
    )


def _moved(wishes: DataFrame, tries: int, r: int) -> DataFrame:
    """The state after the moves of a round, of which each try leaves half; beyond the eighth only the best."""
    moves = F.coalesce(F.col("gain") > EPSILON, F.lit(False))
    if tries > 8:
        first = [x["node"] for x in wishes.where(moves).orderBy(F.desc("gain"), "node").limit(1).collect()]
        moves = moves & F.col("node").isin(first)
    elif tries:
        moves = moves & (F.pmod(F.xxhash64("node", F.lit(r)), F.lit(1 << tries)) == 0)
    return wishes.select("node", "out_w", "in_w", F.when(moves, F.col("best")).otherwise(F.col("own")).alias("own"))


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Directed modularity of a partition, one row."""
    a = membership.select(F.col("node").alias("source"), F.col("community_number").alias("cs"))
    b = membership.select(F.col("node").alias("target"), F.col("community_number").alias("ct"))
    e = edges.join(a, "source").join(b, "target")
    inside = e.agg(F.sum(F.when(F.col("cs") == F.col("ct"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("m"))
    k = e.select(F.explode(F.array(F.struct(F.col("cs").alias("c"), F.col("weight").alias("o"), F.lit(0.0).alias("i")), F.struct(F.col("ct").alias("c"), F.lit(0.0).alias("o"), F.col("weight").alias("i")))).alias("x"))
    null = k.groupBy("x.c").agg(F.sum("x.o").alias("o"), F.sum("x.i").alias("i")).agg(F.sum(F.col("o") * F.col("i")).alias("oi"))
    return inside.crossJoin(null).select((F.col("inside") / F.col("m") - resolution * F.col("oi") / (F.col("m") * F.col("m"))).alias("modularity"))
