"""Clustering of vectors within groups.

Groups of up to ``LARGEST`` rows are clustered in a task each.  Larger ones go by blocks: pairs of blocks meet in tasks
that give shortest edges, or the pairs within reach, and rounds on tables build a spanning tree, or merge mutual nearest
clusters.  Both ways order equal distances by the smaller keys, so they give the same clusters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from kinweave.operators.evolution import components
from kinweave.operators.vectors import centre
from kinweave.scratch import discard, materialize

LARGEST = 4000


# --- groups of vectors


def _stack(pdf: pd.DataFrame, key: str, vector: str, geometry: str = "unit") -> tuple[pd.DataFrame, np.ndarray]:
    pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
    return pdf, _placed(pdf[vector], geometry)


def _placed(vectors: pd.Series, geometry: str) -> np.ndarray:
    """The vectors as rows, of length one but in the raw geometry."""
    x = np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 1))
    return x if geometry == "raw" else _unit(x)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def leaf_clusters(x: np.ndarray, least: int = 2, samples: int = 3) -> np.ndarray:
    """Leaves of the density hierarchy of unit vectors: a label for each row, -1 for noise."""
    return density_labels(x, least, samples)[0]


def density_labels(x: np.ndarray, least: int = 2, samples: int = 3, geometry: str = "unit", selection: str = "leaf", single: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Label (-1 for noise) and membership probability of each row by the density hierarchy.

    Distances (Euclidean for the raw and unit geometries, else 1 - cosine) are made mutual: no less than either end's
    distance to its ``samples``-th neighbour, itself counted.  What the spanning tree makes of them, see
    ``clusters_of_tree``.  Less than ``least`` + 1 rows are noise.
    """
    n = len(x)
    if n < max(least, 2) + 1:
        return np.full(n, -1), np.zeros(n)
    return clusters_of_tree(n, density_tree(x, samples, geometry), least, selection, single)


def density_tree(x: np.ndarray, samples: int, geometry: str) -> list[tuple[float, int, int]]:
    """The minimum spanning tree of the rows under mutual distances: distance and ends of each edge."""
    n = len(x)
    d = _distances(x, x, geometry)
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, min(samples, n) - 1]
    d = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    # minimum spanning tree, grown from row 0; of equal edges that with the smaller ends comes first
    rows = np.arange(n)
    near, via, inside = d[0].copy(), np.zeros(n, int), np.zeros(n, bool)
    inside[0] = True
    tree = []
    for _ in range(n - 1):
        open_ = np.flatnonzero(~inside & (near == near[~inside].min()))
        j = int(min(open_, key=lambda k: (min(via[k], k), max(via[k], k))))
        tree.append((near[j], *sorted((int(via[j]), j))))
        inside[j] = True
        first, now = (np.minimum(j, rows), np.maximum(j, rows)), (np.minimum(via, rows), np.maximum(via, rows))
        closer = (d[j] < near) | (d[j] == near) & ((first[0] < now[0]) | (first[0] == now[0]) & (first[1] < now[1]))
        near[closer], via[closer] = d[j][closer], j
    return tree


def _distances(x: np.ndarray, y: np.ndarray, geometry: str = "unit") -> np.ndarray:
    """Rounded to nine places, so that blocks of any shape give the same."""
    if geometry == "raw":
        square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
        return np.round(np.sqrt(np.maximum(0, square)), 9)
    if geometry == "cosine":
        return np.round(np.maximum(0, 1 - x @ y.T), 9)
    return np.round(np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T))), 9)


def clusters_of_tree(n: int, tree: list[tuple[float, int, int]], least: int, selection: str = "leaf", single: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Label and probability of each of ``n`` rows from a spanning tree (distance, end, end).

    The tree is cut from its longest edge on.  A part that splits into two of ``least`` rows or more each ends and two
    begin; smaller parts fall out of the one they were in.  Density is 1 / distance, and a cluster's stability the sum
    over its rows of the density at which each leaves it less that at which it began.  ``leaf`` chooses the clusters
    that never split, ``mass`` those with more stability than all that were chosen below them.  The whole is none
    unless ``single``; if it is the only one, it holds the rows that stay to the last.  A row's probability is the
    density at which it left its cluster by the highest of any row that did.
    """
    left, right, size, level = [], [], [1] * n, []
    up = list(range(n))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    part = list(range(n))  # of each root, its node
    for distance, a, b in sorted(tree):
        a, b = find(a), find(b)
        left.append(part[a]), right.append(part[b]), level.append(1 / max(distance, 1e-12))
        size.append(size[part[a]] + size[part[b]])
        up[b] = a
        part[a] = len(size) - 1

    parent, birth, end, weight, leaves_at = [-1], [0.0], [0.0], [0.0], np.zeros(n)
    own = np.zeros(n, int)

    def fall(node: int, cluster: int, density: float) -> None:
        todo = [node]
        while todo:
            k = todo.pop()
            if k < n:
                own[k], leaves_at[k] = cluster, density
            else:
                todo += [left[k - n], right[k - n]]
        weight[cluster] += size[node] * (density - birth[cluster])
        end[cluster] = max(end[cluster], density)

    todo = [(len(size) - 1, 0)]
    while todo:
        node, cluster = todo.pop()
        if node < n:  # the whole is one row
            continue
        density, below = level[node - n], (left[node - n], right[node - n])
        large = [size[k] >= least for k in below]
        for k, is_large in zip(below, large, strict=True):
            if all(large):
                parent.append(cluster), birth.append(density), end.append(density), weight.append(0.0)
                weight[cluster] += size[k] * (density - birth[cluster])
                end[cluster] = max(end[cluster], density)
                todo.append((k, len(parent) - 1))
            elif is_large and k >= n:
                todo.append((k, cluster))
            else:
                fall(k, cluster, density)
    count = len(parent)
    children: list[list[int]] = [[] for _ in range(count)]
    for c in range(1, count):
        children[parent[c]].append(c)
    chosen, best = [False] * count, [0.0] * count
    for c in range(count - 1, -1, -1):
        below = sum(best[k] for k in children[c])
        whole = c == 0 and not single
        chosen[c] = not whole and (not children[c] if selection == "leaf" else weight[c] >= below)
        best[c] = weight[c] if chosen[c] else below
    top = [-1] * count  # the uppermost chosen cluster that holds each
    for c in range(count):
        above = top[parent[c]] if c else -1
        top[c] = above if above >= 0 else c if chosen[c] else -1
    labels = np.array([top[c] for c in own], dtype=int) if n else np.zeros(0, int)
    if single and labels.size and (labels == 0).any():
        labels[leaves_at < max(leaves_at[own == 0], default=0.0)] = -1
        labels[own != 0] = 0
    highest = np.array(end)
    with np.errstate(invalid="ignore"):
        probability = np.where(labels >= 0, np.minimum(leaves_at, highest[labels]) / np.where(highest[labels] > 0, highest[labels], 1), 0.0)
    order = {c: k for k, c in enumerate(dict.fromkeys(labels[labels >= 0].tolist()))}
    return np.array([order.get(c, -1) for c in labels.tolist()], dtype=int), probability


def density_clusters(rows: DataFrame, group: str, key: str, vector: str, least: int = 2, samples: int = 3, largest: int = LARGEST, geometry: str = "unit", selection: str = "leaf", single: bool = False) -> DataFrame:
    """group, key, cluster (-1 for noise) and membership probability of every row, clustered within its group.

    Groups of up to ``largest`` rows are a task each.  Larger ones are dealt out in blocks; pairs of blocks meet in tasks
    that give each row's nearest distances and, in rounds, each part's shortest edge to another part, until one tree is
    left, and only the tree, an edge for each row, is one task's.  Keys are unique within a group.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"{group} {kinds[group]}, {key} {kinds[key]}, cluster int, probability double"
    named = lambda labels, p: {"cluster": labels.astype("int32"), "probability": np.round(p, 8)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x = _stack(pdf, key, vector, geometry)
        return pdf[[group, key]].assign(**named(*density_labels(x, least, samples, geometry, selection, single)))

    small, large = _by_size(rows.select(group, key, vector), group, largest)
    found = small.groupBy(group).applyInPandas(run, schema)
    if large is None:
        return found
    tree = _spanning_tree(large, group, key, vector, samples, largest, geometry)

    def condense(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, labels = _condensed(pdf, [(least, selection, single)])
        return pd.DataFrame({group: pdf[group].iloc[0], key: keys} | named(*labels[0]))

    return found.unionByName(tree.groupBy(group).applyInPandas(condense, schema))


def _condensed(tree: pd.DataFrame, settings: list[tuple[int, str, bool]]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The keys of a tree (a, b, distance), and their labels and probabilities for each (least, selection, single)."""
    keys = np.unique(np.concatenate([tree["a"].to_numpy(), tree["b"].to_numpy()]))
    ends = [np.searchsorted(keys, tree[c].to_numpy()) for c in ("a", "b")]
    edges = list(zip(tree["distance"].tolist(), ends[0].tolist(), ends[1].tolist(), strict=True))
    return keys, [clusters_of_tree(len(keys), edges, *s) for s in settings]


def _by_size(rows: DataFrame, group: str, largest: int, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` in groups of up to ``largest``, and those in larger ones with the group's size as ``__n`` (None if there are none)."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n")) if sizes is None else sizes
    large = materialize(sizes.where(F.col("__n") > largest), "large")
    if large.isEmpty():
        return rows, None
    return rows.join(large, group, "left_anti"), rows.join(large, group)


#: Rows of a block whose distances to another block are held at a time.
STRIP = 256


def _strips(x: np.ndarray, y: np.ndarray, geometry: str):
    """Distances in strips: the first row of each, and its distances to all of ``y``."""
    for at in range(0, len(x), STRIP):
        yield at, _distances(x[at : at + STRIP], y, geometry)


#: Rows of a packed block.
PACKED = 8192


def _packed(rows: DataFrame, group: str, size: int) -> DataFrame:
    """``rows`` (c: key, v: vector of doubles) of each group by key in blocks of about ``size`` rows: b, n, keys, and vectors as bytes.

    ``n`` is the number of the group's blocks.  Rows of one key are in one block.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    blocks = rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n"))
    dealt = rows.select(group, "c", "v").join(blocks, group).withColumn("b", F.pmod(F.xxhash64("c"), "n").cast("int"))
    schema = f"{group} {kinds[group]}, b int, n int, keys array<{kinds['c']}>, v binary"
    out = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("c")
        v = t["v"].combine_chunks().flatten().to_numpy().tobytes()
        return pa.table([t[group][:1], t["b"][:1], t["n"][:1], pa.array([t["c"].to_pylist()], out.field("keys").type), pa.array([v], out.field("v").type)], schema=out)

    return materialize(dealt.groupBy(group, "b").applyInArrow(pack, schema), "packed")


def _facing(sought: DataFrame, blocks: DataFrame, group: str) -> DataFrame:
    """Every block of ``sought`` (p_keys, p_v) beside every one of ``blocks`` (keys, v) of its group."""
    left = sought.select(group, F.col("b").alias("p"), F.col("n").alias("parts"), F.col("keys").alias("p_keys"), F.col("v").alias("p_v"))
    parts = left.groupBy(group).agg(F.max("parts").alias("parts"))
    right = blocks.join(parts, group).select(group, "keys", "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    return right.join(left.drop("parts"), [group, "p"]).select(group, "p_keys", "p_v", "keys", "v")


def _blocks_of(batches):
    """Group, then keys and vectors of both blocks, of each row of ``_facing``."""
    for batch in batches:
        for i in range(batch.num_rows):
            p, q = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("p_keys", "keys"))
            yield batch.column(0)[i], p, np.frombuffer(batch.column("p_v")[i].as_buffer()).reshape(len(p), -1), q, np.frombuffer(batch.column("v")[i].as_buffer()).reshape(len(q), -1)


def nearest_clusters(p: np.ndarray, x: np.ndarray, q: np.ndarray, y: np.ndarray, cut: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each cluster of ``x`` the nearest other one of ``y`` within ``cut``: cluster, other, distance; none for those without.

    ``p`` and ``q`` are the clusters of the rows, in order; rows have a length of one at most.  The distance of two
    clusters is the largest cosine distance of their members, rounded; of equal ones the smaller key is the nearer.
    Products of 32 bits pick those that may be nearest, within twice the error that such sums can have, and only these
    are computed with 64.
    """
    (own, first), (other, begins) = (np.unique(k, return_index=True) for k in (p, q))
    many = len(other) < len(q)
    ends, stops = np.append(first, len(p)), np.append(begins, len(q))
    error = (x.shape[1] + 4) * 2.0**-22
    x32, y32 = x.astype(np.float32), y.astype(np.float32).T
    places = np.searchsorted(other, own)
    same = np.flatnonzero((places < len(other)) & (other[np.minimum(places, len(other) - 1)] == own))
    found = [], [], []
    at = 0
    while at < len(own):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + STRIP, side="right")) - 1)
        near = None
        for lo in range(ends[at], ends[stop], STRIP):  # a strip, or a cluster of more rows
            hi = min(lo + STRIP, ends[stop])
            part = x32[lo:hi] @ y32
            if many:
                part = np.minimum.reduceat(part, begins, axis=1)
            if hi - lo > stop - at:
                part = np.minimum.reduceat(part, np.maximum(ends[at:stop], lo) - lo if stop - at > 1 else [0], axis=0)
            near = part if near is None else np.minimum(near, part)
        self_ = same[(same >= at) & (same < stop)]
        near[self_ - at, places[self_]] = -np.inf
        i, j = np.divmod(np.flatnonzero(near >= (np.maximum(near.max(axis=1, initial=-np.inf), 1 - cut) - error).astype(np.float32)[:, None]), len(other))
        i += at
        exact = np.einsum("ij,ij->i", x[first[i]], y[begins[j]])
        for k in np.flatnonzero((ends[i + 1] - ends[i] > 1) | (stops[j + 1] - stops[j] > 1)):
            sides = x[ends[i[k]] : ends[i[k] + 1]], y[stops[j[k]] : stops[j[k] + 1]]
            left, right = sides if own[i[k]] < other[j[k]] else sides[::-1]  # so that both find the same
            exact[k] = (left @ right.T).min()
        d = np.round(np.maximum(0, 1 - exact), 9)
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        best = np.append(True, i[1:] != i[:-1])[: len(i)] & (d <= cut)
        for out, values in zip(found, (own[i[best]], other[j[best]], d[best]), strict=True):
            out.append(values)
        at = stop
    return tuple(map(np.concatenate, found))


def _spanning_tree(rows: DataFrame, group: str, key: str, vector: str, samples: int, block: int, geometry: str = "unit") -> DataFrame:
    return _spanning_trees(rows, group, key, vector, [(geometry, samples)], block).drop("setting")


#: Nearest rows that each row's list holds.
NEAREST = 16


def _squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Two matrices of 32 bits whose product has the squared distances of rows, and a bound of twice its error."""
    a, b = (np.einsum("ij,ij->i", z, z)[:, None] for z in (x, y))
    left, right = np.concatenate([x, np.ones_like(a), a], axis=1), np.concatenate([-2 * y, b, np.ones_like(b)], axis=1)
    scale = a.max(initial=0) + b.max(initial=0)
    return left.astype(np.float32), right.astype(np.float32).T, float(scale * (x.shape[1] + 6) * 2.0**-21)


def _distance_of(x: np.ndarray, y: np.ndarray, geometry: str) -> np.ndarray:
    """The distance of each row of ``x`` to that of ``y``, as ``_distances`` gives it."""
    product = np.einsum("ij,ij->i", x, y)
    if geometry == "raw":
        return np.round(np.sqrt(np.maximum(0, np.einsum("ij,ij->i", x, x) + np.einsum("ij,ij->i", y, y) - 2 * product)), 9)
    return np.round(np.maximum(0, 1 - product) if geometry == "cosine" else np.sqrt(np.maximum(0, 2 - 2 * product)), 9)


def _square_of(d: np.ndarray, geometry: str) -> np.ndarray:
    """Squared Euclidean distances of rows that are as far apart as ``d`` says."""
    return 2 * d if geometry == "cosine" else d * d


def _first_of(i: np.ndarray, keys: np.ndarray, d: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` nearest of each row ``i``, ties to the smaller key."""
    order = np.lexsort((np.unique(keys, return_inverse=True)[1], d, i))
    i, keys, d = i[order], keys[order], d[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < most
    return i[first], keys[first], d[first]


def nearest_rows(held: tuple | None, p: np.ndarray, x: np.ndarray, q: np.ndarray, y: np.ndarray, geometry: str, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``held`` (place in ``p``, key, distance; None: nothing) with those of ``y`` that are among the ``most`` nearest of a row of ``x``.

    Products of 32 bits pick the rows that may be among them, and only these are computed with 64.
    """
    x, y = (z if geometry == "raw" else _unit(z) for z in (x, y))
    left, right, error = _squares(x, y)
    bound = np.full(len(x), np.inf)
    found = [] if held is None else [held]
    if held is not None:
        i, _, d = held
        full = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i) == most - 1)
        bound[i[full]] = _square_of(d[full], geometry) + error
    parts = 4 * most
    for lo in range(0, len(x), STRIP):
        near = left[lo : lo + STRIP] @ right
        limit = bound[lo : lo + STRIP]
        if held is None and near.shape[1] >= 4 * parts:  # the row itself is one of them
            least = near[:, : near.shape[1] // parts * parts].reshape(len(near), -1, parts).min(axis=1)
            limit = np.partition(least, most, axis=1)[:, most] + error
        i, j = np.divmod(np.flatnonzero(near <= limit.astype(np.float32)[:, None]), near.shape[1])
        other = p[lo + i] != q[j]
        i, j = lo + i[other], j[other]
        found.append((i, q[j], _distance_of(x[i], y[j], geometry)))
    return _first_of(*map(np.concatenate, zip(*found, strict=True)), most)


def nearest_parts(p: np.ndarray, x: np.ndarray, core: np.ndarray, part: np.ndarray, q: np.ndarray, y: np.ndarray, core_y: np.ndarray, part_y: np.ndarray, geometry: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``x`` the nearest of another part under mutual distances: place in ``p``, key, distance; none if there is no other part."""
    x, y = (z if geometry == "raw" else _unit(z) for z in (x, y))
    left, right, error = _squares(x, y)
    floor, floor_y = (_square_of(c, geometry).astype(np.float32) for c in (core, core_y))
    found = [(np.zeros(0, int), q[:0], np.zeros(0))]
    for lo in range(0, len(x), STRIP):
        strip = slice(lo, lo + STRIP)
        near = left[strip] @ right
        np.maximum(near, floor_y, out=near)
        np.maximum(near, floor[strip, None], out=near)
        near[part[strip, None] == part_y] = np.inf
        least = near.min(axis=1)
        i, j = np.divmod(np.flatnonzero(near <= np.where(np.isinf(least), -np.inf, least * (1 + 1e-6) + error).astype(np.float32)[:, None]), near.shape[1])
        d = np.maximum(_distance_of(x[lo + i], y[j], geometry), np.maximum(core[lo + i], core_y[j]))
        found.append(_first_of(lo + i, q[j], d, 1))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def grown_forest(part: np.ndarray, least: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple, tuple]:
    """Parts joined by their shortest edges as far as the known edges (ends a and b, distance d) prove these to be shortest.

    ``least``: every edge of a row that is not known is as long or longer.  Returns each row's part, which rows have to
    look for an edge (those whose unknown edges may be shorter, of all parts but the largest), the edges taken and the
    known ones between parts.
    """
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((hi, lo, d))
    edges = lo[order], hi[order], d[order]
    n, taken, part = len(part), [], part.copy()
    while True:
        ends = part[edges[0]], part[edges[1]]
        between = ends[0] != ends[1]
        edges, ends = tuple(e[between] for e in edges), [e[between] for e in ends]
        m = len(edges[0])
        best = np.full((2, n), m)
        for k in (0, 1):
            best[k, ends[k][::-1]] = np.arange(m)[::-1]  # the last that is written is the shortest
        best = best.min(axis=0)
        length = np.append(edges[2], np.inf)[best]
        known = np.full(n, np.inf)
        np.minimum.at(known, part, least)
        sure = (best < m) & (length < known)
        if not sure.any():
            break
        of = np.flatnonzero(sure)
        to = np.arange(n)
        to[of] = np.where(ends[0][best[of]] == of, ends[1][best[of]], ends[0][best[of]])
        mutual = (to[to] == np.arange(n)) & (np.arange(n) < to)
        to[mutual] = np.flatnonzero(mutual)
        while (to != to[to]).any():
            to = to[to]
        chosen = np.unique(best[of])
        taken.append(tuple(e[chosen] for e in edges))
        part = to[part]
    seek = (least <= length[part]) & (part != np.bincount(part, minlength=1).argmax()) if n else np.zeros(0, bool)
    return part, seek, tuple(map(np.concatenate, zip(*taken, strict=True))) if taken else tuple(e[:0] for e in edges), edges


def _spanning_trees(rows: DataFrame, group: str, key: str, vector: str, settings: list[tuple[str, int]], block: int) -> DataFrame:
    """setting, group, a, b and distance of the minimum spanning trees of each group under mutual distances.

    ``settings`` are pairs of a geometry and a number of samples; ``setting`` is a place in the list.  One run over all
    pairs of blocks gives each row's nearest, for each geometry.  Their edges build most of a tree: a part's shortest
    edge is known if no row of it can have a shorter one that is not among its nearest.  Rows of other parts, except the
    largest, look for theirs among all rows, in rounds that join every such part to another.  Ties go to the smaller
    keys, so that a tree is one and the same.  ``block`` bounds the rows of a block; a group's lists are one task's.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    kind, of, spark = kinds[key], kinds[group], rows.sparkSession
    geometries = list(dict.fromkeys(g for g, _ in settings))
    most = max(NEAREST, *(m for _, m in settings))
    size = min(PACKED, 2 * block)
    vectors = rows.select(group, F.col(key).alias("c"), F.col(vector).cast("array<double>").alias("v"))
    blocks = _packed(vectors, group, size)
    arrow = lambda schema: to_arrow_schema(spark.createDataFrame([], schema).schema)
    near = f"geometry int, {group} {of}, k {kind}, near array<{kind}>, d array<double>"
    near_arrow = arrow(near)

    def nearest(batches):
        held: dict = {}

        def lists(name, first):
            p, found = held.pop((name, first))
            for g, (i, keys, d) in enumerate(found):
                at = pa.array(np.searchsorted(i, np.arange(len(p) + 1)), pa.int32())
                columns = [pa.array(v, near_arrow.field(c).type) for c, v in ((0, [g] * len(p)), (1, [name] * len(p)), (2, p))]
                lists = [pa.ListArray.from_arrays(at, pa.array(v, near_arrow.field(c).type.value_type)).cast(near_arrow.field(c).type) for c, v in ((3, keys), (4, d))]
                yield pa.RecordBatch.from_arrays(columns + lists, schema=near_arrow)

        for name, p, x, q, y in _blocks_of(batches):
            at = name.as_py(), p[0]
            if at not in held and len(held) >= 4:  # parts of lists are put together where trees are built
                yield from lists(*next(iter(held)))
            before = held.get(at, (p, [None] * len(geometries)))[1]
            held[at] = p, [nearest_rows(b, p, x, q, y, g, most) for b, g in zip(before, geometries, strict=True)]
        while held:
            yield from lists(*next(iter(held)))

    # rows (0) with part, core, least and whether they seek; edges of the tree (1) and known edges between parts (2)
    fields = f"setting int, {group} {of}, kind int, a {kind}, b {kind}, d double, part {kind}, core double, least double, seek boolean"

    def table(setting: int, name, keys: np.ndarray, core: np.ndarray, least: np.ndarray, grown: tuple) -> pd.DataFrame:
        part, seek, taken, between = grown
        out = [pd.DataFrame({"kind": 0, "a": keys, "b": keys, "d": 0.0, "part": keys[part], "core": core, "least": least, "seek": seek})]
        for what, (a, b, d) in ((1, taken), (2, between)):
            out.append(pd.DataFrame({"kind": what, "a": keys[a], "b": keys[b], "d": d, "part": keys[a], "core": 0.0, "least": 0.0, "seek": False}))
        return pd.concat(out, ignore_index=True).assign(**{"setting": setting, group: name})[[f.split()[0] for f in fields.split(", ")]]

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        name, geometry = pdf[group].iloc[0], geometries[int(pdf["geometry"].iloc[0])]
        keys = np.unique(pdf["k"].to_numpy())
        a = np.repeat(np.searchsorted(keys, pdf["k"].to_numpy()), pdf["near"].str.len())
        b, d = np.searchsorted(keys, np.concatenate(pdf["near"].to_numpy())), np.concatenate(pdf["d"].to_numpy())
        a, b, d = _first_of(a, b, d, most)
        begins, count = np.searchsorted(a, np.arange(len(keys))), np.bincount(a, minlength=len(keys))
        last = np.where(count < most, np.inf, np.append(d, 0)[begins + count - 1])  # who has less has all
        out = []
        for s, (g, samples) in enumerate(settings):
            if g == geometry:
                core = np.append(d, 0)[begins + np.minimum(samples - 1, count) - 1] if samples > 1 else np.zeros(len(keys))
                least = np.maximum(last, core)
                mutual = np.maximum(d, np.maximum(core[a], core[b]))
                out.append(table(s, name, keys, core, least, grown_forest(np.arange(len(keys)), least, a, b, mutual)))
        return pd.concat(out, ignore_index=True)

    def resume(pdf: pd.DataFrame) -> pd.DataFrame:
        each = pdf[pdf["kind"] == 0].sort_values("a", kind="stable")
        keys, core, least = (each[c].to_numpy().copy() for c in ("a", "core", "least"))
        edges, sought = pdf[pdf["kind"] >= 2], pdf[pdf["kind"] == 3]
        # an edge that was looked for is the row's shortest out of its part, now and later
        least[np.searchsorted(keys, sought["a"].to_numpy())] = np.nextafter(sought["d"].to_numpy(), np.inf)
        a, b = (np.searchsorted(keys, edges[c].to_numpy()) for c in ("a", "b"))
        grown = grown_forest(np.searchsorted(keys, each["part"].to_numpy()), least, a, b, edges["d"].to_numpy())
        return table(int(pdf["setting"].iloc[0]), pdf[group].iloc[0], keys, core, least, grown)

    lists = materialize(_facing(blocks, blocks, group).mapInArrow(nearest, near), "lists")
    state = materialize(lists.groupBy("geometry", group).applyInPandas(begin, fields), "forest")
    discard(lists, blocks)
    edge = ["setting", group, "a", "b", F.col("d").alias("distance")]
    tree = state.where("kind = 1").select(*edge)
    met_schema = f"setting int, {group} {of}, a {kind}, b {kind}, d double"
    met_arrow = arrow(met_schema)

    def shortest(t: pa.Table) -> pa.Table:
        """Of one block of rows that seek and one of all rows of a group."""
        own = t["own"].to_numpy()
        sides = []
        for side in (t.filter(pa.array(own)), t.filter(pa.array(~own))):
            side = side.sort_by("a")
            k, core, part = (side[c].to_numpy() for c in ("a", "core", "part"))
            sides.append((k, side["v"].combine_chunks().flatten().to_numpy().reshape(len(k), -1), core, part))
        if not len(sides[0][0]) or not len(sides[1][0]):
            return met_arrow.empty_table()
        setting = t["setting"][0].as_py()
        i, x, d = nearest_parts(*sides[0], *sides[1], settings[setting][0])
        return pa.table([pa.array(v, met_arrow.field(c).type) for c, v in enumerate(([setting] * len(i), [t[group][0].as_py()] * len(i), sides[0][0][i], x, d))], schema=met_arrow)

    while True:
        each = state.where("kind = 0").select("setting", group, "a", "part", "core", "seek")
        seekers = materialize(each.where("seek").groupBy("setting", group).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts")), "seekers")
        if seekers.isEmpty():
            return tree
        placed = vectors.withColumnRenamed("c", "a")
        sizes = each.groupBy("setting", group).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n"))
        open_ = each.join(seekers, ["setting", group]).join(sizes, ["setting", group]).join(placed, [group, "a"])
        dealt = lambda n: F.pmod(F.xxhash64("a"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        columns = ["setting", group, "a", "v", "part", "core"]
        sought = open_.where("seek").select(*columns, F.lit(True).alias("own"), dealt(F.col("parts")).alias("p"), every("n").alias("b"))
        among = open_.select(*columns, F.lit(False).alias("own"), dealt(F.col("n")).alias("b"), every("parts").alias("p"))
        met = sought.unionByName(among).groupBy("setting", group, "p", "b").applyInArrow(shortest, met_schema)
        best = F.min(F.struct("d", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "b")).alias("e")
        found = met.groupBy("setting", group, "a").agg(best).select("setting", group, F.lit(3).alias("kind"), "a", F.col("e.b").alias("b"), F.col("e.d").alias("d"))
        nothing = {"part": F.col("a"), "core": F.lit(0.0), "least": F.lit(0.0), "seek": F.lit(False)}
        going = state.join(seekers.select("setting", group), ["setting", group], "left_semi").where("kind <> 1")
        after = going.unionByName(found.withColumns(nothing)).groupBy("setting", group).applyInPandas(resume, fields)
        state = materialize(after, "forest")
        tree = tree.unionByName(state.where("kind = 1").select(*edge))


def merge_order(d: np.ndarray, cut: float, average: bool, size: np.ndarray | None = None) -> list[tuple[float, int, int]]:
    """Merges of clusters (distance, into, merged), closest first while the distance is ``cut`` at most; changes ``d``.

    Of equal distances the one with the smaller ends comes first.  What the merges up to a smaller distance give is what
    that distance as ``cut`` gives, as neither linkage brings a merged cluster closer to others than its parts were.
    """
    n, out = len(d), []
    size = np.ones(n) if size is None else size.astype(float)
    np.fill_diagonal(d, np.inf)
    to = d.argmin(axis=1) if n else np.zeros(0, int)
    near = d[np.arange(n), to]
    while n > 1:
        i = int(near.argmin())
        if not near[i] <= cut:
            break
        i, j = sorted((i, int(to[i])))
        out.append((float(d[i, j]), i, j))
        far = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j]) if average else np.maximum(d[i], d[j])
        d[i], d[:, i] = far, far
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        closer = (far < near) | (far == near) & (i < to)
        near[closer], to[closer] = far[closer], i
        again = np.flatnonzero(((to == i) | (to == j)) & ~closer)
        again = np.union1d(again, [i, j]).astype(int)
        to[again] = d[again].argmin(axis=1)
        near[again] = d[again, to[again]]
    return out


def linkage(x: np.ndarray, cut: float = 0.35, average: bool = False) -> np.ndarray:
    """Clusters of unit vectors, merged closest first while their cosine distance is ``cut`` at most.

    The distance of two clusters is the largest between their members (complete linkage), or the mean of all (average).
    """
    label = np.arange(len(x))
    for _, i, j in merge_order(_distances(x, x, "cosine"), cut, average):
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def complete_linkage(x: np.ndarray, cut: float = 0.35) -> np.ndarray:
    """Clusters in which any two have cosine distance of ``cut`` at most."""
    return linkage(x, cut)


def singletons_as_noise(labels: np.ndarray) -> np.ndarray:
    """Clusters of one become noise (-1); the others are numbered anew in their order."""
    out = np.where(np.bincount(labels)[labels] > 1, labels, -1)
    kept = np.unique(out[out >= 0])
    return np.where(out >= 0, np.searchsorted(kept, out), -1)


def linked_families(rows: DataFrame, group: str, key: str, vector: str, cut: float = 0.35, average: bool = False, largest: int = LARGEST) -> DataFrame:
    """group, key and family by complete (or average) linkage within each group, numbered by their smallest key.

    Groups of up to ``largest`` rows are a task each, larger ones are merged in rounds on tables.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"{group} {kinds[group]}, {key} {kinds[key]}, family int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x = _stack(pdf, key, vector)
        return pdf[[group, key]].assign(family=linkage(x, cut, average).astype("int32"))

    small, large = _by_size(rows.select(group, key, vector), group, largest)
    found = small.groupBy(group).applyInPandas(run, schema)
    if large is None:
        return found
    names, merges = _merged(large, group, key, vector, cut, average, largest)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        leaves, merged = pdf[pdf["d"].isna()], pdf[pdf["d"].notna()]
        (labels,) = _labels_at(leaves["c"].to_numpy(), merged, [cut])
        return leaves[[group, "c"]].assign(family=pd.factorize(labels, sort=True)[0].astype("int32"))

    leaves = names.select(group, F.col("family").alias("c")).distinct().select(group, F.lit(None).cast(kinds[key]).alias("to"), "c", F.lit(None).cast("double").alias("d"))
    labels = leaves.unionByName(merges).groupBy(group).applyInPandas(label, f"{group} {kinds[group]}, c {kinds[key]}, family int")
    return found.unionByName(names.join(labels.withColumnRenamed("family", "n"), (names[group] == labels[group]) & (names["family"] == labels["c"])).select(names[group], names[key], F.col("n").alias("family")))


def _labels_at(leaves: np.ndarray, merges: pd.DataFrame, cuts: list[float]) -> list[np.ndarray]:
    """For each of rising ``cuts`` the cluster (its smallest key) of each leaf, from a group's merges (d, to, c)."""
    order = np.sort(leaves)
    up = np.arange(len(order))
    ends = [np.searchsorted(order, merges[c].to_numpy()) for c in ("to", "c")]
    height, out = merges["d"].to_numpy(dtype=float), []
    for cut in cuts:
        now = height <= cut
        up[ends[1][now]] = ends[0][now]  # a cluster is merged once, into one with a smaller key
        root = up.copy()
        while (root != root[root]).any():
            root = root[root]
        out.append(order[root[np.searchsorted(order, leaves)]])
    return out


def _merged(rows: DataFrame, group: str, key: str, vector: str, cut: float, average: bool, largest: int) -> tuple[DataFrame, DataFrame]:
    """group, key and family (equal vectors under complete linkage are one), and all merges: group, to, c, d up to ``cut``.

    Merging all clusters that are each other's nearest, in rounds, gives what merging the closest pair one by one does.
    In a round blocks of clusters meet in tasks, which keep the nearest of each cluster and no pairs: the mean distance
    of two clusters is that of their mean vectors, the largest is found from their members, a strip at a time.  No
    merged cluster is closer to others than its parts were, so a nearest stays until either end is merged, only clusters
    that lost theirs look for one, and clusters that have none within ``cut`` are done.  A group of ``largest`` clusters
    or fewer is merged to the end by one task.
    """
    kind, of = rows.schema[key].dataType.simpleString(), rows.schema[group].dataType.simpleString()
    first = F.col(key) if average else F.min(key).over(Window.partitionBy(group, vector))
    names = materialize(rows.select(group, key, vector, first.alias("family")), "rows")
    alone = names.where(F.col(key) == F.col("family"))

    def of_length_one(batches):
        for pdf in batches:
            yield pdf.assign(v=list(_placed(pdf["v"], "unit")), size=1.0)

    state = materialize(alone.select(group, F.col(key).alias("c"), F.col(vector).alias("v")).mapInPandas(of_length_one, f"{group} {of}, c {kind}, v array<double>, size double"), "clusters")
    merges = None

    kinds = f"{group} {of}, c {kind}, x {kind}, d double"
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], kinds).schema)

    def nearest(batches):
        for name, *blocks in _blocks_of(batches):
            c, x, d = nearest_clusters(*blocks, cut)
            yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(c), arrow.field(0).type), *(pa.array(v, arrow.field(k + 1).type) for k, v in enumerate((c, x, d)))], schema=arrow)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.rename(columns={"c": "k"}).sort_values("k", kind="stable")
        d, own, _ = _between(pdf, pdf)
        size = pdf.groupby("k", sort=True)["size"].first().to_numpy()
        found = merge_order(d, cut, average, size)
        i, j = ([own[m[c]] for m in found] for c in (1, 2))
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(found), "to": i, "c": j, "d": [m[0] for m in found]})

    schema = f"{group} {of}, to {kind}, c {kind}, d double"
    sought, kept = state, None
    while True:
        blocks = _packed(state, group, PACKED)
        seekers = blocks if sought is state else _packed(sought, group, PACKED)
        met = _facing(seekers, blocks, group).mapInArrow(nearest, kinds)
        closest = F.min(F.struct("d", F.least("c", "x").alias("a"), F.greatest("c", "x").alias("b"), "x")).alias("e")  # ties as everywhere
        found = met.groupBy(group, "c").agg(closest).select(group, "c", F.col("e.x").alias("x"), F.col("e.d").alias("d"))
        near = materialize(found if kept is None else found.unionByName(kept), "near")
        discard(blocks, *([] if sought is state else [seekers]))
        state, before = materialize(state.join(near.select(group, "c"), [group, "c"], "left_semi"), "clusters"), state
        discard(before)
        small, large = _by_size(state, group, largest, near.groupBy(group).agg(F.count(F.lit(1)).alias("__n")))
        done = materialize(small.groupBy(group).applyInPandas(finish, schema), "merges")
        merges = done if merges is None else merges.unionByName(done)
        if large is None:
            discard(state, near)
            return names.select(group, key, "family"), merges
        near = near.join(large.select(group).distinct(), group, "left_semi")
        ends = near.groupBy(group, F.least("c", "x").alias("to"), F.greatest("c", "x").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d"))
        found = materialize(ends.where("n = 2").select(group, "to", "c", "d"), "merges")
        if found.isEmpty():
            return names.select(group, key, "family"), merges
        merges = merges.unionByName(found)
        moved = large.join(found.select(group, "c", F.col("to").alias("__to")), [group, "c"], "left").withColumn("c", F.coalesce("__to", "c")).drop("__to", "__n")
        if average:
            each = moved.groupBy(F.struct(group, "c").alias("gc")).agg(centre(F.col("v"), F.col("size")).alias("v"), F.sum("size").alias("size"))
            moved = each.select(F.col(f"gc.{group}").alias(group), F.col("gc.c").alias("c"), "v", "size")
        # those that were merged, and those whose nearest was, look for one in the next round
        merged = found.select(group, F.explode(F.array("to", "c")).alias("m"))
        kept = near.join(merged.withColumnRenamed("m", "c"), [group, "c"], "left_anti").join(merged.withColumnRenamed("m", "x"), [group, "x"], "left_anti").select(group, "c", "x", "d")
        kept, before = materialize(kept, "kept"), state
        state = materialize(moved, "clusters")
        discard(before)
        sought = state.join(kept.select(group, "c"), [group, "c"], "left_anti")


def _between(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest distances between the clusters (``k``) of two tables of vectors (``v``), by cluster, and both lists of clusters."""
    x, y = _placed(a["v"], "raw"), _placed(b["v"], "raw")
    (own, first), (other, begins) = (np.unique(t["k"].to_numpy(), return_index=True) for t in (a, b))
    out = np.zeros((len(own), len(other)))
    cluster = np.searchsorted(own, a["k"].to_numpy())
    for at, d in _strips(x, y, "cosine"):
        d = np.maximum.reduceat(d, begins, axis=1)
        here, starts = np.unique(cluster[at : at + len(d)], return_index=True)
        out[here] = np.maximum(out[here], np.maximum.reduceat(d, starts, axis=0))
    return out, own, other


def sweep(rows: DataFrame, variants: DataFrame, group: str, key: str, vector: str, largest: int = LARGEST) -> DataFrame:
    """Every variant of a parameter table over every group: clusters, noise, largest share and mean probability.

    ``variants`` is a table of settings: variant, method (density, complete or average), least, samples, cut, geometry,
    selection and single.  Variants that differ in what they make of a tree or where they cut it share the tree: one for
    each geometry and number of samples, and one for each linkage.  Groups of up to ``largest`` rows are a task for each
    tree, larger ones go by tables.  Clusters of one that linkage leaves count as noise; members that linkage keeps have
    probability 1.
    """
    kind, of = rows.schema[group].dataType.simpleString(), rows.schema[key].dataType.simpleString()
    chosen = variants.collect()  # a table of settings
    schema = f"variant string, {group} {kind}, observations long, clusters long, noise long, largest_share double, mean_probability double"
    dense: dict[tuple[str, int], list] = {}
    linked: dict[str, list] = {}
    for v in chosen:
        if v["method"] == "density":
            dense.setdefault((v["geometry"], v["samples"]), []).append((v["variant"], v["least"], v["selection"], bool(v["single"])))
        else:
            linked.setdefault(v["method"], []).append((v["cut"], v["variant"]))
    trees = list(dense)

    def row(variant: str, of_group, labels: np.ndarray, probability: np.ndarray) -> dict:
        sizes = np.bincount(labels[labels >= 0]) if (labels >= 0).any() else np.zeros(0, int)
        mean = round(float(np.round(probability, 8)[labels >= 0].mean()), 6) if len(sizes) else None
        return {"variant": variant, group: of_group, "observations": len(labels), "clusters": len(sizes), "noise": int((labels < 0).sum()), "largest_share": round(float(sizes.max(initial=0)) / len(labels), 6), "mean_probability": mean}

    def of_merges(of_group, leaves: np.ndarray, merges: pd.DataFrame, method: str) -> pd.DataFrame:
        out, cuts = [], sorted(linked[method])
        for (_, variant), labels in zip(cuts, _labels_at(leaves, merges, [c for c, _ in cuts]), strict=True):
            labels = singletons_as_noise(np.unique(labels, return_inverse=True)[1])
            out.append(row(variant, of_group, labels, (labels >= 0).astype(float)))
        return pd.DataFrame(out)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        number, of_group = int(pdf["tree"].iloc[0]), pdf[group].iloc[0]
        if number < len(trees):
            geometry, samples = trees[number]
            pdf, x = _stack(pdf, key, vector, geometry)
            edges = density_tree(x, samples, geometry)
            out = []
            for variant, least, selection, single in dense[geometry, samples]:
                found = clusters_of_tree(len(x), edges, least, selection, single) if len(x) > max(least, 2) else (np.full(len(x), -1), np.zeros(len(x)))
                out.append(row(variant, of_group, *found))
            return pd.DataFrame(out)
        method = list(linked)[number - len(trees)]
        pdf, x = _stack(pdf, key, vector)
        found = merge_order(_distances(x, x, "cosine"), max(linked[method])[0], method == "average")
        return of_merges(of_group, np.arange(len(x)), pd.DataFrame(found, columns=["d", "to", "c"]).astype({"to": int, "c": int}), method)

    small, large = _by_size(rows.select(group, key, vector), group, largest)
    numbers = F.explode(F.sequence(F.lit(0), F.lit(len(trees) + len(linked) - 1)))
    found = small.withColumn("tree", numbers).groupBy("tree", group).applyInPandas(run, schema)
    if large is None:
        return found
    if trees:

        def condense(pdf: pd.DataFrame) -> pd.DataFrame:
            own = dense[trees[int(pdf["setting"].iloc[0])]]
            _, labels = _condensed(pdf, [o[1:] for o in own])
            return pd.DataFrame([row(o[0], pdf[group].iloc[0], *x) for o, x in zip(own, labels, strict=True)])

        found = found.unionByName(_spanning_trees(large, group, key, vector, trees, largest).groupBy("setting", group).applyInPandas(condense, schema))

    def cut_by(method: str):
        def cut(pdf: pd.DataFrame) -> pd.DataFrame:
            leaves, merged = pdf[pdf["d"].isna()], pdf[pdf["d"].notna()]
            return of_merges(pdf[group].iloc[0], leaves["c"].to_numpy(), merged, method)

        return cut

    for method, cuts in linked.items():
        names, merges = _merged(large, group, key, vector, max(cuts)[0], method == "average", largest)
        leaves = names.select(group, F.lit(None).cast(of).alias("to"), F.col("family").alias("c"), F.lit(None).cast("double").alias("d"))
        found = found.unionByName(leaves.unionByName(merges).groupBy(group).applyInPandas(cut_by(method), schema))
    return found


def quality(labels: DataFrame, group: str) -> DataFrame:
    """For each group of clustered rows (``cluster``, -1 for noise, and ``probability``): sizes, noise and mean probability."""
    own = F.col("cluster") >= 0
    each = labels.groupBy(group, "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("probability").alias("p"))
    size = F.when(own, F.col("n"))
    return each.groupBy(group).agg(
        F.sum("n").alias("observations"), F.count(size).alias("clusters"), F.coalesce(F.sum(F.when(~own, F.col("n"))), F.lit(0)).alias("noise"),
        F.coalesce(F.round(F.max(size) / F.sum("n"), 6), F.lit(0.0)).alias("largest_share"), F.round(F.sum(F.when(own, F.col("p"))) / F.sum(size), 6).alias("mean_probability"),
        F.avg(size).alias("mean_size"), F.percentile(size, 0.5).alias("median_size"),
    )


# --- cutoffs and selections


def knee(weights: np.ndarray, sensitivity: float = 3.0) -> int:
    """Index of the knee of a falling, convex curve: where it lies furthest under the straight line between its ends.

    A candidate counts once the distance has fallen by ``sensitivity`` mean steps before the next candidate; with no
    knee, a tenth of the points (the last point if they are less than ten).
    """
    n = len(weights)
    if n >= 3 and weights[0] > weights[-1]:
        x = np.arange(n) / (n - 1)
        y = (weights - weights[-1]) / (weights[0] - weights[-1])
        gap = (1 - x) - y
        peaks = [i for i in range(1, n - 1) if gap[i] > gap[i - 1] and gap[i] >= gap[i + 1]]
        for k, i in enumerate(peaks):
            stop = peaks[k + 1] if k + 1 < len(peaks) else n
            if (gap[i + 1 : stop] < gap[i] - sensitivity / (n - 1)).any():
                return i
    return (int(n * 0.1) - 1) % n if n else -1


def keep_to_knee(rows: DataFrame, group: str, word: str, weight: str) -> DataFrame:
    """The heaviest words of each group up to its knee; a group is one topic's keyword list."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([weight, word], ascending=[False, True]).reset_index(drop=True)
        return pdf.iloc[: knee(pdf[weight].to_numpy(dtype=np.float64)) + 1]

    return rows.select(group, word, weight).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {word} {kinds[word]}, {weight} {kinds[weight]}")


def greedy_edges(edges: DataFrame, max_nodes: int = 1000, max_edges: int = 5000) -> DataFrame:
    """Walk the edges from the heaviest on and take each that keeps the nodes within ``max_nodes``, ``max_edges`` at most.

    Until one node is missing every edge is taken, so the ``max_edges`` heaviest (on the driver) settle all nodes but
    perhaps the last, which the heaviest edge that adds just one node brings.  What the walk takes are then the heaviest
    of all edges whose two ends are chosen.
    """
    rows = edges.select("source", "target", "weight")
    order = [F.desc("weight"), F.asc("source"), F.asc("target")]
    nodes: set = set()
    for r in rows.orderBy(*order).limit(max_edges).collect():
        if len(nodes | {r["source"], r["target"]}) <= max_nodes:
            nodes |= {r["source"], r["target"]}
    kind = rows.schema["source"].dataType.simpleString()

    def marked(df: DataFrame) -> DataFrame:
        chosen = df.sparkSession.createDataFrame([(n,) for n in nodes], f"node {kind}")  # at most max_nodes rows
        for end in ("source", "target"):
            near = F.broadcast(chosen.select(F.col("node").alias("n"), F.lit(True).alias(f"has_{end}")))
            df = df.join(near, F.col(end).eqNullSafe(F.col("n")), "left").drop("n").fillna(False, [f"has_{end}"])
        return df

    if len(nodes) == max_nodes - 1:
        one = (F.col("has_source") != F.col("has_target")) | (F.col("source").eqNullSafe(F.col("target")) & ~F.col("has_source"))
        for r in marked(rows).where(one).orderBy(*order).limit(1).collect():
            nodes |= {r["source"], r["target"]}
    return marked(rows).where("has_source AND has_target").orderBy(*order).limit(max_edges).select("source", "target", "weight")
