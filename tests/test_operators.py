"""Small tables with known results, and invariants of operators that SQL can't express."""

import math

import numpy as np
import pytest
from kinweave import sinks, sources
from kinweave.functions import text as T
from kinweave.functions import vectors as V
from kinweave.operators import clustering as cl
from kinweave.operators import modularity as mod
from kinweave.operators import communities as com
from kinweave.operators import evolution as ev
from kinweave.operators import network as net
from kinweave.streaming import merge_batches
from pyspark.sql import functions as F


def value(spark, column, **cells):
    return spark.createDataFrame([tuple(cells.values())], list(cells)).select(column.alias("x")).first()["x"]


def test_edge_metrics_count_self_and_missing_spreaders(spark):
    rows = [("u1", "u2"), ("u1", "u2"), ("u1", "u1"), ("u1", None), (None, "u2"), ("u2", "u3")]
    e = {(r.source, r.target): (r.shared_post, r.total_post, r.weighted_post) for r in net.edge_metrics(spark.createDataFrame(rows, "from_id string, forwarder_id string")).collect()}
    assert e == {("u1", "u2"): (2, 4, 0.5), ("u2", "u3"): (1, 1, 1.0)}


def test_thresholds_are_inclusive(spark):
    e = spark.createDataFrame([(10, 5), (9, 5), (10, 4), (11, 6)], "total_post long, shared_post long")
    assert net.threshold(e, 10, 5).count() == 2


def test_centrality_of_a_small_graph(spark):
    e = spark.createDataFrame([("u1", "u2"), ("u1", "u3"), ("u2", "u3")], "source string, target string")
    (r,) = net.centrality_summary(net.centrality(net.endpoints(e), e)).collect()
    assert (r.max_out, r.max_out_node, r.max_in, r.max_in_node, r.avg_in, r.avg_out) == (1.0, "u1", 1.0, "u3", 0.5, 0.5)


def test_upsert_adds_up(spark):
    schema = "source string, target string, total_post long, shared_post long"
    old, new = spark.createDataFrame([("a", "b", 4, 2), ("c", "c", 1, 1)], schema), spark.createDataFrame([("a", "b", 6, 1), ("d", "e", 0, 0)], schema)
    assert sorted((r.source, r.total_post, r.shared_post, r.weighted_post) for r in net.upsert(old, new).collect()) == [("a", 10, 3, 0.3), ("d", 0, 0, 0.0)]


def test_matches_are_exact_partial_or_none(spark):
    a = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (9, 2)], "node int, community_number int")
    b = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (5, 1)], "node int, community_number int")
    m = com.match(a, b)
    assert {(r.a, r.b): round(r.jaccard, 4) for r in m.collect()} == {(0, 0): 1.0, (1, 1): 0.3333}
    assert [r.a for r in com.unmatched(a, m, "a").collect()] == [2]


def test_seats_follow_the_highest_averages(spark):
    sizes = spark.createDataFrame([(0, 100), (1, 9), (2, 1)], "community_number int, size long")
    got = {r.community_number: r.quota for r in com.seats(sizes, 12).collect()}
    quota = {0: 2, 1: 2, 2: 1}
    while sum(quota.values()) < 12:
        best = max((c for c in quota if quota[c] < {0: 100, 1: 9, 2: 1}[c]), key=lambda c: (math.sqrt({0: 100, 1: 9, 2: 1}[c]) / (quota[c] + 1), -c))
        quota[best] += 1
    assert got == quota


def test_reappearing_members(spark):
    rows = [("1", 0, x) for x in "ab"] + [("2", 0, x) for x in "bc"] + [("3", 0, x) for x in "ac"]
    m = spark.createDataFrame(rows, "period string, community int, node string")
    t = ev.transitions(m, 0.3)
    p = ev.all_paths(t, 3)
    assert [r.path for r in p.collect()] == [["1_0", "2_0", "3_0"]]
    changes = ev.membership_changes(ev.path_steps(p), m.select(F.concat_ws("_", "period", "community").alias("node"), F.col("node").alias("member")))
    got = [(r.existing, r.new, r.lost, r.reappearing, r.size_delta) for r in changes.orderBy("step_index").collect()]
    assert got == [(2, 0, 0, 0, None), (1, 1, 1, 0, 0), (1, 0, 1, 1, 0)]


def test_components_of_transitions(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "source_node string, target_node string")
    assert {r.node: r.component for r in ev.components(e, 5).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


@pytest.mark.parametrize(("raw", "want"), [("Hello @you, see https://a.b/c #News www.x.y hahaha the river River river", "hello see news river"), ("a\nb", "ab"), ("one. two,three", "one two three"), ("jaja ahah ok", "ok")])
def test_clean_text(spark, raw, want):
    assert value(spark, T.clean(F.col("t")), t=raw) == want


def test_small_text_functions(spark):
    assert value(spark, T.parsed_list(F.col("t")), t="['a', 'b']") == ["a", "b"]
    assert value(spark, T.parsed_list(F.col("t")), t='["a, b"]') == ["a, b"]
    assert value(spark, T.parsed_list(F.col("t")), t="a, b ,") == ["a", "b"]
    assert value(spark, T.strip_html(F.col("t")), t="<p>a &amp; b</p><script>x<y</script> <b> c </b>") == "a & bc"
    assert value(spark, T.month_number(F.col("t")), t="March") == 3 and value(spark, T.month_number(F.lit(None).cast("string")), t="x") is None
    assert value(spark, T.day_of(F.col("t")), t="(2017, 3, 9, 12)") == 9 and value(spark, T.day_of(F.col("t")), t="2017-03-08T10:00:00Z") == 8
    assert value(spark, T.distinct_keywords(F.col("t")), t=[" A", "a", "b ", ""]) == ["A", "b"]
    assert value(spark, T.legacy_multi_theme(F.col("t")), t="Trade News.Local Food") is True


def test_vectors(spark):
    assert value(spark, V.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 0.0]) is None
    assert abs(value(spark, V.cosine(F.col("a"), F.col("b")), a=[1.0, 1.0], b=[1.0, 0.0]) - math.sqrt(0.5)) < 1e-12
    with pytest.raises(Exception, match="no finite length"):
        value(spark, V.unit(F.col("a")), a=[0.0, 0.0])


def test_two_cliques_are_two_communities(spark):
    rows = [(a, b, 1.0) for g in (range(6), range(10, 16)) for a in g for b in g if a != b] + [(0, 10, 1.0)]
    e = spark.createDataFrame(rows, "source int, target int, weight double")
    m = mod.modularity_communities(e)
    groups = {}
    for r in m.collect():
        groups.setdefault(r.community_number, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(6)), list(range(10, 16))]
    assert mod.modularity(e, m).first()[0] > 0.45


def test_labels_that_swap_end(spark):
    """One heavy node and a light pair: labels swapped at equal modularity are no merge, and rounds end."""
    for rows in ([(1, 1, 50.0), (1001, 1003, 1.0), (1, 1001, 0.2), (1, 1003, 0.2)], [(1, 2, 1.0), (2, 1, 1.0)], [(1, 2, 0.0)], [(1, 1, 3.0)]):
        e = spark.createDataFrame(rows, "source int, target int, weight double")
        found = {r.node: r.community_number for r in mod.modularity_communities(e).collect()}
        assert set(found) == {n for a, b, _ in rows for n in (a, b)}
        if len(rows) == 4:
            assert found[1001] == found[1003] != found[1]


def best_by_single_moves(edges, start):
    """Directed modularity of the partition that single moves reach, one node at a time, in plain Python."""
    m = sum(w for _, _, w in edges)
    out, into = {}, {}
    for a, b, w in edges:
        out[a], into[b] = out.get(a, 0) + w, into.get(b, 0) + w

    def score(label):
        inside = sum(w for a, b, w in edges if label[a] == label[b])
        k = set(label.values())
        return inside / m - sum(sum(out.get(n, 0) for n in label if label[n] == c) * sum(into.get(n, 0) for n in label if label[n] == c) for c in k) / m**2

    label, moved = dict(start), True
    while moved:
        moved = False
        for n in sorted(label):
            options = {label[n]} | {label[b] for a, b, _ in edges if a == n} | {label[a] for a, b, _ in edges if b == n}
            best = max(sorted(options), key=lambda c: round(score(label | {n: c}), 9))
            if score(label | {n: best}) > score(label) + 1e-9:
                label[n], moved = best, True
    return score(label)


def test_communities_against_plain_moves(spark):
    """No single move improves what is found, and it is about as good as moving nodes one at a time."""
    import random

    for seed in (1, 2):
        rng = random.Random(seed)
        pairs = {(a, b) for a in range(30) for b in range(30) if a != b and rng.random() < (0.5 if a // 6 == b // 6 else 0.04)}
        edges = [(a, b, float(rng.randrange(1, 4))) for a, b in sorted(pairs)]
        e = spark.createDataFrame(edges, "source int, target int, weight double")
        found = mod.modularity_communities(e)
        label = {r.node: r.community_number for r in found.collect()}
        got = mod.modularity(e, found).first()[0]
        assert got > best_by_single_moves(edges, {n: n for n in label}) - 0.01
        assert sorted(set(label.values())) == list(range(len(set(label.values()))))


def test_numbers_in_a_total_order(spark):
    from kinweave.operators.ordering import numbered

    rows = [(i * 37 % 101, i % 3) for i in range(100)]
    found = numbered(spark.createDataFrame(rows, "a int, b int").repartition(5), F.desc("b"), "a", name="place").collect()
    want = {r: k for k, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert {(r.a, r.b): r.place for r in found} == want and numbered(spark.createDataFrame([], "a int"), "a").count() == 0


def test_layout_brings_neighbours_together(spark):
    rows = [(a, b, 1.0) for g in (range(6), range(10, 16)) for a in g for b in g if a < b] + [(0, 10, 0.1)]
    at = {r.node: (r.x, r.y) for r in net.force_layout(spark.createDataFrame(rows, "source int, target int, weight double")).collect()}
    far = lambda a, b: math.dist(at[a], at[b])
    near = np.mean([far(a, b) for a, b, w in rows if w == 1.0])
    apart = np.mean([far(a, b) for a in range(6) for b in range(10, 16)])
    assert len(at) == 12 and all(math.isfinite(c) for p in at.values() for c in p) and near < apart


def test_phrases_and_coherence(spark):
    from kinweave.operators import topics

    rng = np.random.default_rng(3)
    other = lambda n: [f"w{k}" for k in rng.integers(0, 4000, n)]
    rows = [(i, [*other(10), "old", "stone", "bridge", *other(10)]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id int, words array<string>")
    more = topics.with_phrases(docs)
    found = {r.doc_id: r.words for r in more.collect()}
    assert more.columns == docs.columns and all(found[i] == [*w, "old_stone", "stone_bridge", "old_stone_bridge"] for i, w in rows)
    # windows counted one by one
    words, window = [["a", "b", "c", "a"], ["b"] * 3, [], ["c", "d", "a", "b", "d", "c"]], 3
    seen = [set(w[i : i + window]) for w in words if w for i in range(max(1, len(w) - window + 1))]
    described = [(0, "a"), (0, "b"), (1, "c"), (1, "d"), (1, "x")]
    got = {r.topic: r.coherence for r in topics.coherence(spark.createDataFrame([(w,) for w in words], "words array<string>"), spark.createDataFrame(described, "topic int, word string"), window=window).collect()}
    for topic in (0, 1):
        own = sorted(w for t, w in described if t == topic)
        p = lambda *ws: sum(set(ws) <= s for s in seen) / len(seen)
        v = np.array([[np.log((p(a, b) + 1e-12) / (p(a) * p(b) + 1e-12)) / -np.log(p(a, b) + 1e-12) for b in own] for a in own])
        s = v.sum(axis=0)
        assert abs(got[topic] - np.mean(v @ s / (np.linalg.norm(v, axis=1) * np.linalg.norm(s) + 1e-12))) < 1e-6


def test_topics_see_every_document_and_word(spark, monkeypatch):
    """Every pass meets all documents; likelihood rises, to no less than that of Spark's LDA with the same topics."""
    from kinweave.operators import topics
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    rng = np.random.default_rng(5)
    rows = [(i, [f"t{i % 4}_{k}" for k in rng.integers(0, 25, 30)] + [f"c{k}" for k in rng.integers(0, 10, 15)]) for i in range(300)] + [(300, []), (301, None), (302, ["once"])]
    docs = spark.createDataFrame(rows, "doc_id int, words array<string>").repartition(3)
    monkeypatch.setattr(topics, "BLOCK_DOCS", 40)
    monkeypatch.setattr(topics, "LEAST_GAIN", -1.0)
    model = topics.fit(docs, topics=4, passes=12)
    assert model.seen == [303] * 12 and model.vocabulary == len({w for _, ws in rows for w in ws or []})
    assert all(b > a - 1e-6 for a, b in zip(model.likelihood, model.likelihood[1:], strict=False))
    found = {r.doc_id: r.topic for r in topics.dominant(model).collect()}
    assert len(found) == 303 and found[300] == found[301] == -1 and found[302] >= 0
    assert all(len({found[i] for i in range(k, 300, 4)}) == 1 for k in range(4)) and len(set(found.values())) == 5
    heavy = topics.keywords(model, 5).toPandas()
    assert len(heavy) == 20 and (heavy["weight"] > 0).all() and abs(sum(model.totals) - sum(len(w or []) for _, w in rows)) < 1e-6
    counted = CountVectorizer(inputCol="words", outputCol="counts").fit(docs.dropna())
    lda = LDA(featuresCol="counts", k=4, maxIter=40, optimizer="em", seed=1).fit(counted.transform(docs.dropna()))
    phi = lda.topicsMatrix().toArray()
    at = {w: i for i, w in enumerate(counted.vocabulary)}
    counts = [sorted((at[w], ws.count(w)) for w in set(ws)) for _, ws in rows if ws]
    flat = np.array([p for c in counts for p in c])
    theirs = topics.shares(phi / phi.sum(axis=0), np.array([len(c) for c in counts]), flat[:, 0], flat[:, 1])[2] / flat[:, 1].sum()
    assert model.likelihood[-1] > theirs - 0.01
    with pytest.raises(ValueError, match="no document"):
        topics.fit(docs.where("doc_id = 300"))


def test_bundles_tell_what_has_changed(spark, tmp_path):
    path = str(tmp_path / "topics")
    docs = spark.createDataFrame([(1, ["a", "b, c"]), (2, []), (3, None)], "id int, words array<string>")
    sinks.topic_inputs({"documents": docs}, path, {"month": 3})
    assert sorted(sources.topic_inputs(spark, path, {"month": 3})["documents"].collect()) == sorted(docs.collect())
    with pytest.raises(ValueError, match="other settings"):
        sources.topic_inputs(spark, path, {"month": 4})
    sinks.table(sinks.with_json_lists(docs.limit(1)), path + "/documents.parquet")
    with pytest.raises(ValueError, match="not what the manifest says"):
        sources.topic_inputs(spark, path, {"month": 3})
    themes = str(tmp_path / "themes")
    for period in ("2017-03", "2017-04", "2017-03"):
        sinks.theme_inputs(docs, themes, period)
    assert sources.theme_inputs(spark, themes).groupBy("period").count().orderBy("period").collect() == [("2017-03", 3), ("2017-04", 3)]
    calls = []
    build = lambda: calls.append(1) or docs
    for _ in range(2):
        assert sinks.cached(spark, str(tmp_path / "cache"), {"a": 1}, build).count() == 3
    assert len(calls) == 1
    bad = spark.range(3).select(F.raise_error(F.lit("no such row")).cast("int").alias("x"))
    with pytest.raises(Exception, match="no such row"):
        sinks.bundle({"bad": bad}, str(tmp_path / "run"), "r2", "2024-01-01")
    assert '"status": "failed"' in spark.read.text(str(tmp_path / "run" / "manifest")).first()[0]


def test_first_entries_of_a_map_cell(spark):
    got = value(spark, T.first_entries(F.col("t")), t='{"a": ["x", "y"], "b\\"c": [], "a": ["z"]}')
    assert [(r.key, r.words) for r in got] == [("a", ["x", "y"]), ('b\\"c', [])]


def test_one_to_one_joins_refuse_repeats(spark):
    from kinweave.operators import published as pub

    a, b = spark.createDataFrame([(1, 5), (2, 6)], "k int, x int"), spark.createDataFrame([(1, 7)], "k int, y int")
    assert sorted(map(tuple, pub.one_to_one(a, b, "k").collect())) == [(1, 5, 7), (2, 6, None)]
    with pytest.raises(Exception, match="twice"):
        pub.one_to_one(a, b.union(b), "k").collect()


def _blobs(rng, n=6):
    x = np.concatenate([c + rng.normal(0, 0.01, (n, 8)) for c in np.eye(8)[:3]])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_density_clusters():
    rng = np.random.default_rng(1)
    x = _blobs(rng)
    labels = cl.leaf_clusters(x)
    for k in range(3):
        part = labels[6 * k : 6 * k + 6]
        assert not set(part[part >= 0]) & set(np.delete(labels, np.s_[6 * k : 6 * k + 6])) - {-1}
    assert labels.max() >= 2
    assert (cl.leaf_clusters(x[:2]) == -1).all()


def test_large_groups_are_clustered_like_small_ones(spark):
    """One order of equal distances: clusters and probabilities are the same on both sides of the bound."""
    rng = np.random.default_rng(8)
    rows = []
    for g, n in (("a", 50), ("b", 12)):
        centres = rng.normal(size=(6, 5))
        rows += [(g, i, (centres[i % 6] + rng.normal(0, 0.15, 5)).tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, k int, v array<double>")
    clusters = lambda **kw: {(r.g, r.k): (r.cluster, r.probability) for r in cl.density_clusters(df, "g", "k", "v", **kw).collect()}
    for more in ({"samples": 1}, {"samples": 3}, {"samples": 3, "selection": "mass", "geometry": "raw"}):
        want = clusters(**more)
        assert len(set(want.values())) > 3 and clusters(largest=16, **more) == want
    tree = cl._spanning_tree(df.join(df.groupBy("g").agg(F.count(F.lit(1)).alias("__n")), "g"), "g", "k", "v", 3, 16).collect()
    for g in "ab":
        x = np.array([v for h, _, v in rows if h == g])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        d = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T))
        np.fill_diagonal(d, 0)
        core = np.sort(d, axis=1)[:, 2]
        edges = sorted((max(d[i, j], core[i], core[j]), i, j) for i in range(len(x)) for j in range(i))
        part, lengths = list(range(len(x))), []
        for w, i, j in edges:
            if part[i] != part[j]:
                part = [part[i] if q == part[j] else q for q in part]
                lengths.append(w)
        assert np.allclose(sorted(r.distance for r in tree if r.g == g), lengths)


def plain_density(d, least, selection, single):
    """Labels as sets of rows, from mutual distances: parts at every density, stabilities and the choice, in plain Python."""
    n = len(d)
    levels = sorted({d[i][j] for i in range(n) for j in range(i)})

    def parts(rows, limit):
        """Connected parts of ``rows`` by distances under ``limit``."""
        rows, out = set(rows), []
        while rows:
            seen = todo = {min(rows)}
            while todo:
                todo = {j for i in todo for j in rows - seen if d[i][j] < limit}
                seen = seen | todo
            out.append(frozenset(seen))
            rows -= seen
        return out

    def walk(rows, born):
        """(own stability, chosen sets, their stability) of the cluster that begins with ``rows``."""
        now, mass = set(rows), 0.0
        for limit in reversed(levels):
            split = parts(now, limit)
            if len(split) == 1:
                continue
            density = 1 / max(limit, 1e-12)
            large = [p for p in split if len(p) >= least]
            if len(large) > 1:
                mass += len(now) * (density - born)
                below = [walk(p, density) for p in large]
                chosen, total = [c for b in below for c in b[1]], sum(b[2] for b in below)
                whole = born == 0 and not single
                if not whole and selection == "mass" and mass >= total:
                    return mass, [frozenset(rows)], mass
                return mass, chosen, total
            mass += (len(now) - (len(large[0]) if large else 0)) * (density - born)
            if not large:
                break
            now = set(large[0])
        return mass, ([] if born == 0 and not single else [frozenset(rows)]), mass

    return {c for c in walk(range(n), 0.0)[1]}


def test_density_labels_like_plain_python():
    """Distances without ties, as splits into more than two parts at once have no one order."""
    rng = np.random.default_rng(11)
    for trial in range(12):
        centres = rng.normal(size=(4, 3))
        x = np.concatenate([centres[i] + rng.normal(0, 0.1 + 0.2 * (i % 2), (8, 3)) for i in range(4)])
        for geometry in ("raw", "unit", "cosine"):
            y = x if geometry == "raw" else x / np.linalg.norm(x, axis=1, keepdims=True)
            d = cl._distances(y, y, geometry)
            for selection in ("leaf", "mass"):
                labels, probability = cl.density_labels(y, 3, 1, geometry, selection)
                got = {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels.tolist()) - {-1}}
                assert got == plain_density(d.tolist(), 3, selection, False), (trial, geometry, selection)
                assert ((probability > 0) == (labels >= 0)).all() and probability.max(initial=0) <= 1
                assert all(probability[labels == c].max() == 1 for c in set(labels.tolist()) - {-1})
    one = np.concatenate([rng.normal(0, 0.01, (6, 3)), [[5.0, 5, 5]]])
    assert (cl.density_labels(one, 2, 3, "raw", "mass")[0] >= 0).sum() < 7
    assert (cl.density_labels(one, 2, 3, "raw", "mass", True)[0] >= 0).any()


def test_linkage_of_any_size(spark):
    """By rounds on tables as in one task, equal vectors and small groups included."""
    rng = np.random.default_rng(3)
    rows = []
    for g, n in (("a", 130), ("b", 9)):
        centres = rng.normal(size=(12, 4))
        rows += [(g, i, (centres[i % 12] + rng.normal(0, 0.35, 4)).tolist()) for i in range(n)]
    rows += [("a", 300 + i, rows[i % 3][2]) for i in range(12)]
    df = spark.createDataFrame(rows, "g string, k int, v array<double>")
    for average in (False, True):
        found = lambda **kw: {(r.g, r.k): r.family for r in cl.linked_families(df, "g", "k", "v", 0.1, average, **kw).collect()}
        want = found()
        assert 12 < len({f for (g, _), f in want.items() if g == "a"}) < 100 and found(largest=64) == want
    settings = "('d', 'density', 2, 3, 0.0D, 'cosine', 'mass', false), ('c', 'complete', 0, 0, 0.1D, 'unit', 'leaf', false)"
    variants = spark.sql(f"SELECT * FROM VALUES {settings} AS t(variant, method, least, samples, cut, geometry, selection, single)")
    swept = lambda **kw: sorted(map(tuple, cl.sweep(df, variants, "g", "k", "v", **kw).collect()))
    assert swept(largest=64) == swept()


def test_complete_linkage_builds_no_chains():
    x = np.array([[math.cos(a), math.sin(a)] for a in (0, 0.7, 1.4)])
    assert len(set(cl.complete_linkage(x))) == 2
    assert len(set(cl.complete_linkage(_blobs(np.random.default_rng(2))))) == 3


def test_average_linkage_like_plain_means():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(14, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for cut in (0.1, 0.3, 0.6):
        groups = [[i] for i in range(len(x))]
        mean = lambda a, b: np.mean([1 - x[i] @ x[j] for i in a for j in b])
        while len(groups) > 1:
            d, i, j = min((mean(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
            if d > cut:
                break
            groups[i] += groups.pop(j)
        labels = cl.linkage(x, cut, average=True)
        assert sorted(sorted(np.flatnonzero(labels == k).tolist()) for k in set(labels)) == sorted(map(sorted, groups))
    assert cl.singletons_as_noise(np.array([2, 0, 1, 2, 1])).tolist() == [1, -1, 0, 1, 0]


def test_knee():
    assert cl.knee(np.arange(20, 0, -1.0)) == 1 and cl.knee(np.arange(5, 0, -1.0)) == 4
    assert cl.knee(np.concatenate([[100, 50, 20], np.linspace(3, 1, 60)])) in (2, 3, 4)


def test_greedy_edges_keep_their_caps(spark):
    rng = np.random.default_rng(0)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 400), rng.integers(0, 60, 400), rng.random(400), strict=True)]
    got = cl.greedy_edges(spark.createDataFrame(rows, "source int, target int, weight double"), 20, 50).collect()
    assert len(got) <= 50 and len({n for r in got for n in (r.source, r.target)}) <= 20 and max(rows, key=lambda r: r[2])[2] == max(r.weight for r in got)


def test_sources_and_sinks(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('source,target,relation\n"{\'id\': 1}","{\'id\': ""2""}",PRODUCED\n')
    assert sources.relationships(spark, str(path)).first().target == "{'id': \"2\"}"
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="missing columns: source"):
        sources.relationships(spark, str(tmp_path / "bad.csv"))
    with pytest.raises(ValueError, match="not a Parquet name"):
        sinks.table(spark.range(1), str(tmp_path / "x.csv"))
    spark.range(3).write.parquet(str(tmp_path / "march_2017.parquet"))
    month = sources.monthly(spark, str(tmp_path / "*_2017.parquet"), ("words",)).first()
    assert (month.month, month.year, month.words) == ("march", 2017, [])
    manifest = sinks.bundle({"n": spark.range(5)}, str(tmp_path / "run"), "r1", "2024-01-01")
    assert manifest.first().n_rows == 5
    assert [r.run_id for r in sources.run_catalog(spark, str(tmp_path / "run" / "manifest")).collect()] == ["r1"]


def test_streamed_merge_adds_nothing_twice(spark, tmp_path):
    spark.createDataFrame([(1, 2), (1, 3)], "k int, v int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, v int").parquet(str(tmp_path / "in"))
    total = lambda old, new: (new if old is None else old.unionByName(new)).groupBy("k").agg(F.sum("v").cast("int").alias("v"))
    for _ in range(2):
        merge_batches(stream, str(tmp_path / "out"), str(tmp_path / "state"), total).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out/v0")).collect()] == [(1, 5)]


def test_greedy_edges_take_later_edges_between_chosen_nodes(spark):
    import random

    rng = random.Random(5)
    for case in range(4):
        rows = [(1, 2, 9e3), (2, 3, 8e3)] if case else [(1, 2, 9e3), (3, 4, 8e3)]
        rows += [(10 + i, 2000 + i, 1e3 - i) for i in range(600)] + [(2, 1, 0.5), (3, 2, 0.4), (3, 1, 0.3), (1, 3, 0.2)]
        if case > 1:
            rows += [(rng.randrange(60), rng.randrange(60), rng.random()) for _ in range(400)]
        most, cap = (4 if case < 3 else 9), 7
        nodes, want = set(), []
        for r in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
            if len(want) < cap and len(nodes | {*r[:2]}) <= most:
                nodes |= {*r[:2]}
                want.append(r)
        got = cl.greedy_edges(spark.createDataFrame(rows, "source int, target int, weight double"), most, cap).collect()
        assert [tuple(r) for r in got] == want


def test_components_of_a_long_zigzag(spark):
    names = [f"{'AB'[i % 2]}_{i * 37 % 101:03d}" for i in range(60)]
    e = spark.createDataFrame([(names[i + i % 2], names[i + 1 - i % 2]) for i in range(59)], "source_node string, target_node string")
    assert {r.node: r.component for r in ev.components(e).collect()} == dict.fromkeys(names, min(names))


def test_chunks_of_one_long_list(spark):
    """One list that holds nearly all rows, sizes over the limit, none, and items of one chunk as many as allowed."""
    from kinweave.operators.chunking import greedy_chunks

    rng = np.random.default_rng(2)
    rows = [("long", i, int(n)) for i, n in enumerate(rng.choice([0, 1, 5, 30, 120], 400))] + [("b", 1, 500), ("b", 2, 1), ("c", 1, None), (None, 1, 3)]
    df = spark.createDataFrame(rows, "g string, i int, n int")
    for most, size in ((3, 100), (1, 50), (8, 60), (100, 10**6)):
        want = []
        for g in ("long", "b", "c"):
            chunks = [[]]
            for _, _, n in sorted(r for r in rows if r[0] == g):
                if chunks[-1] and (len(chunks[-1]) >= most or sum(chunks[-1]) + (n or 0) > size):
                    chunks.append([])
                chunks[-1].append(n or 0)
            want += [(g, k, len(c), sum(c)) for k, c in enumerate(chunks)]
        assert sorted(map(tuple, greedy_chunks(df, "g", "i", F.col("n"), most, size).collect())) == sorted(want)


def test_strong_components(spark):
    """A cycle, a chain, a loop, two components that share a way, and random graphs against reachability."""
    rng = np.random.default_rng(6)
    graphs = [[(i, (i + 1) % 9) for i in range(9)], [(1, 2), (2, 3), (3, 3)], [(1, 2), (2, 1), (2, 5), (5, 6), (6, 5)], [tuple(e) for e in rng.integers(0, 14, (20, 2)).tolist()]]
    for edges in graphs:
        nodes = sorted({n for e in edges for n in e})
        reach = {n: {n} for n in nodes}
        for _ in nodes:
            reach = {n: r | {b for a, b in edges if a in r} for n, r in reach.items()}
        want = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
        e = spark.createDataFrame(edges, "source int, target int")
        assert {r.node: r.component for r in net.strong_components(e).collect()} == want
    assert not net.strongly_connected(e.where("false")).first()[0] and net.strongly_connected(spark.createDataFrame(graphs[0], "source int, target int")).first()[0]


def test_best_paths_are_the_first_of_all(spark):
    rng = np.random.default_rng(9)
    rows = [(f"{p}_{a}", f"{p + 1}_{b}", int(rng.integers(1, 4)), float(rng.integers(1, 4)) / 4) for p in range(4) for a in range(5) for b in range(5) if rng.random() < 0.5]
    t = spark.createDataFrame(rows, "source_node string, target_node string, retained int, jaccard double")
    table = ev.path_table(ev.all_paths(t, 5), t)
    want = sorted((-r.duration, -r.retained_total, -r.mean_jaccard, r.nodes) for r in table.collect())[:7]
    assert [(-r.duration, -r.retained_total, -r.mean_jaccard, r.nodes) for r in ev.best_paths(t, 5, 7).collect()] == want


def test_pages_of_files(spark, tmp_path):
    """Every page is the slice of all files one after the other, and only files that hold it are read."""
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 7).selectExpr("id", "id % 3 AS k").write.parquet(path)
    whole = [r.id for r in spark.read.parquet(path).withColumn("f", F.col("_metadata.file_path")).withColumn("i", F.col("_metadata.row_index")).orderBy("f", "i").collect()]
    for offset, limit in ((0, 10), (140, 10), (0, 2000), (995, 50), (1000, 5), (3, 0), (-4, 6)):
        page = sources.file_page(spark, path, offset, limit)
        assert [r.id for r in page.collect()] == whole[max(0, offset) : max(0, offset) + limit], (offset, limit)
    assert len(sources.file_page(spark, path, 140, 10).inputFiles()) <= 2


def test_evidence_needs_a_theme_and_a_period(spark):
    from kinweave.operators import published as pub

    rows = spark.createDataFrame([("2017-01", "a", i) for i in range(9)], "period string, theme string, seq int")
    assert [(r.seq, r.total) for r in pub.evidence_page(rows, "2017-01", " a ", ["seq"], 7, 5).collect()] == [(7, 9), (8, 9)]
    assert pub.evidence_page(rows, "2017-01", "b", ["seq"]).count() == 0
    for period, theme in (("2017-01", " "), ("2017-02", "a")):
        with pytest.raises(ValueError):
            pub.evidence_page(rows, period, theme, ["seq"])


def test_topics_with_and_without_numbers_for_words(spark, monkeypatch):
    """Words beyond the numbered ones take part by a join, with the same weights; a pass sends numbered words once a task."""
    from kinweave.operators import topics

    words = [[f"w{'ab'[i % 2]}{(i * 7 + j * j) % (9 + i % 30)}" for j in range(12)] for i in range(120)] + [None, []]
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, words array<string>")
    monkeypatch.setattr(topics, "BLOCK_DOCS", 10)
    found = {}
    for common in (1 << 18, 20, 0):
        monkeypatch.setattr(topics, "COMMON", common)
        model = topics.fit(docs, topics=3, passes=4)
        weights = {r.word: r.w for r in model.weights.collect()}
        assert len(weights) == model.vocabulary == len({w for d in words for w in d or []}) and model.seen[0] == 122
        assert len(model.common) <= common
        found[common] = ({w: [round(x, 3) for x in v] for w, v in weights.items()}, {r.doc_id: r.topic for r in topics.dominant(model).collect()})
    assert found[20] == found[1 << 18] == found[0]


def test_frequent_words_are_in_no_phrase(spark, monkeypatch):
    """Leaving out runs with words that are too frequent changes no phrase, and most runs are left out."""
    from kinweave.operators import topics

    texts = [[w for i in range(30) for w in (("new", "york") if (i + d) % 5 == 0 else ("the", f"x{(i * d) % 400}"))] for d in range(40)]
    docs = spark.createDataFrame([(d, w) for d, w in enumerate(texts)], "doc_id long, words array<string>")
    counts = docs.selectExpr("explode(words) w").groupBy("w").count().withColumnRenamed("count", "n")
    assert {r.w for r in topics.too_frequent(counts, "w", "n", 1.0).collect()} == {"the"}
    phrases = lambda: sorted((r.doc_id, r.words) for r in topics.with_phrases(docs, least=2, score=1.0).collect())
    found = phrases()
    assert any("new_york" in w for _, w in found)
    monkeypatch.setattr(topics, "FREQUENT", 2.0)
    assert phrases() == found


def test_neighbours_by_blocks_like_plain_cosines(spark):
    """Copies, equal cosines, a zero and a null vector; blocks of any size; few pairs leave a task."""
    from kinweave.operators import vectors

    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(70)] + [(100 + i, [1.0] + [0.0] * 5) for i in range(40)] + [(200, [2.0] + [0.0] * 5), (201, [0.0] * 6), (202, None)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    asked = [0, 10, 110, 201]
    for blocks in ({}, {"query_block": 2, "row_block": 20}):
        found = vectors.neighbours(df.where(df.k.isin(asked)), df, "k", "v", 3, **blocks).orderBy("query", "place").collect()
        for q in asked:
            x, want = np.array(dict(rows)[q]), []
            for k, v in rows:
                if k != q:
                    length = np.linalg.norm(x) * np.linalg.norm(v) if v else 0
                    want.append((-round(float(x @ np.array(v) / length), 9) if length else 9, k))
            assert [r.neighbour for r in found if r.query == q] == [k for _, k in sorted(want)[:3]], (q, blocks)


def test_sweep_shares_trees_and_holds_strips(spark, monkeypatch):
    """All density variants take one run of rounds and each linkage one, at any cut; distances are held in strips."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(9, 4))
    df = spark.createDataFrame([("a", i, (centres[i % 9] + rng.normal(0, 0.3, 4)).tolist()) for i in range(60)], "g string, k int, v array<double>")
    settings = "('d', 'density', 2, 3, 0.0D, 'cosine', 'mass', false), ('e', 'density', 2, 2, 0.0D, 'raw', 'leaf', false)"
    settings += "".join(f", ('{m}{c}', '{m}', 0, 0, {c}D, 'unit', 'leaf', false)" for m in ("complete", "average") for c in (0.1, 0.2, 0.5))
    variants = spark.sql(f"SELECT * FROM VALUES {settings} AS t(variant, method, least, samples, cut, geometry, selection, single)")
    calls = []
    for name in ("_spanning_trees", "_merged"):
        monkeypatch.setattr(cl, name, lambda *a, real=getattr(cl, name), name=name: calls.append(name) or real(*a))
    monkeypatch.setattr(cl, "STRIP", 7)
    found = {r.variant: tuple(r) for r in cl.sweep(df, variants, "g", "k", "v", largest=40).collect()}
    assert sorted(calls) == ["_merged", "_merged", "_spanning_trees"] and len(found) == 8
    x = cl._unit(np.array([r.v for r in df.orderBy("k").collect()]))
    for m in ("complete", "average"):
        for c in (0.1, 0.2, 0.5):
            labels = cl.singletons_as_noise(cl.linkage(x, c, m == "average"))
            assert found[f"{m}{c}"][2:5] == (60, labels.max() + 1, (labels < 0).sum())
    assert max(len(d) for _, d in cl._strips(x, x, "cosine")) == 7


def test_trees_from_short_lists_and_rows_that_seek(spark, monkeypatch):
    """Most of a tree comes from lists of a few nearest rows; what they don't prove is looked for, with the same clusters."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(7, 4))
    rows = [("a", i, (centres[i % 7] + rng.normal(0, 0.05, 4)).tolist()) for i in range(90)]
    rows += [("a", 200 + i, rows[i % 2][2]) for i in range(8)]
    df = spark.createDataFrame(rows, "g string, k int, v array<double>")
    monkeypatch.setattr(cl, "NEAREST", 4)
    monkeypatch.setattr(cl, "STRIP", 7)
    written, real = [], cl.materialize
    monkeypatch.setattr(cl, "materialize", lambda t, name: written.append(name) or real(t, name))
    found = lambda **kw: {(r.g, r.k): (r.cluster, r.probability) for r in cl.density_clusters(df, "g", "k", "v", geometry="cosine", **kw).collect()}
    want = found()
    assert found(largest=16) == want
    assert written.count("lists") == 1 and 2 < written.count("forest") + written.count("seekers") < 12


def test_kernels_of_32_bits_give_exact_neighbours():
    rng = np.random.default_rng(13)
    x, keys = rng.normal(size=(300, 8)), rng.permutation(300)
    x[40:44] = x[7]
    for geometry in ("raw", "unit", "cosine"):
        z = x if geometry == "raw" else cl._unit(x)
        held = None
        for part in (slice(0, 140), slice(140, 300)):
            held = cl.nearest_rows(held, keys, x, keys[part], x[part], geometry, 3)
        d = np.array([cl._distance_of(np.tile(z[i], (300, 1)), z, geometry) for i in range(300)])
        np.fill_diagonal(d, np.inf)
        want = [(i, keys[j], d[i, j]) for i in range(300) for j in np.lexsort((keys, d[i]))[:3]]
        assert list(zip(*map(np.ndarray.tolist, held), strict=True)) == want
    z, of = cl._unit(x), np.sort(rng.integers(0, 120, 300))
    got = {c: (o, e) for c, o, e in zip(*cl.nearest_clusters(of, z, of, z, 0.2), strict=True)}
    for c in np.unique(of):
        far = {o: round(max(0.0, float((1 - z[of == c] @ z[of == o].T).max())), 9) for o in np.unique(of) if o != c}
        near = min(far, key=lambda o: (far[o], o))
        assert got.get(c, (None, 9))[0] == (near if far[near] <= 0.2 else None)


def test_linkage_looks_again_only_where_the_nearest_was_merged(spark, monkeypatch):
    """Rows without any within the cut are done after the first round, others keep their nearest while it stands."""
    rng = np.random.default_rng(14)
    x = cl._unit(np.concatenate([rng.normal(size=(60, 12)), np.repeat(rng.normal(size=(4, 12)), 10, axis=0) + rng.normal(0, 0.05, (40, 12))]))
    df = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "g string, k int, v array<double>")
    sizes, real = [], cl._packed
    monkeypatch.setattr(cl, "_packed", lambda rows, *a: sizes.append(rows.count()) or real(rows, *a))
    found = {r.k: r.family for r in cl.linked_families(df, "g", "k", "v", 0.1, largest=30).collect()}
    assert [found[i] for i in range(100)] == cl.linkage(x, 0.1).tolist()
    assert sizes[0] == 100 and len(sizes) > 1 and max(sizes[1:]) <= 50


def test_shares_are_laid_out_by_topic():
    """Plain sums over each document's words; the arrays are views of rows a topic, which are quicker to add up."""
    from kinweave.operators import topics as tp

    rng = np.random.default_rng(15)
    size = np.array([3, 0, 5, 1])
    at, n, phi = rng.integers(0, 6, 9), rng.integers(1, 4, 9), rng.random((6, 4)).astype(np.float32)
    theta, part, likelihood = tp.shares(phi, size, at, n)
    want = np.ones((4, 4))
    doc = np.repeat(np.arange(4), size)
    for _ in range(tp.ROUNDS):
        each = want[doc] * phi[at]
        each *= (n / each.sum(axis=1))[:, None]
        want = np.array([each[doc == k].sum(axis=0) + tp.ALPHA if size[k] else want[k] for k in range(4)])
    each = want[doc] * phi[at]
    assert np.allclose(theta, want) and np.allclose(part, each * (n / each.sum(axis=1))[:, None]) and part.T.flags.c_contiguous
    assert np.isclose(likelihood, (n * np.log(each.sum(axis=1) / want.sum(axis=1)[doc])).sum())
