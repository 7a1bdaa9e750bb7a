"""Graph operators against plain versions."""

from __future__ import annotations

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from groovemill.operators import communities, graph
from groovemill.plans import album_queries, document_queries, graph_queries
from groovemill.sources.domain import Tables


def test_labels_reach_the_end_of_a_chain(spark):
    edges = spark.createDataFrame([(f"a{i:02}", f"a{i + 1:02}", 1.0) for i in range(9)] + [("x", "y", 1.0)], "src string, dst string, weight double")
    got = graph.propagate_labels(edges, spark.createDataFrame([("a09", "C1")], "artist string, community string"))
    assert sorted(tuple(r) for r in got.collect()) == [(f"a{i:02}", "C1") for i in range(10)]


def _distances(edges, start):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    found, front = {start: 0}, {start}
    for hop in range(1, 11):
        front = {y for x in front for y in near[x]} - found.keys()
        found |= dict.fromkeys(front, hop)
    return found


def test_community_matrix_by_plain_searches(spark, sf_dir):
    t = Tables(spark, sf_dir)
    edges = [(r["src"], r["dst"]) for r in graph_queries.artist_edges(spark, sf_dir).collect()]
    centroids = {r["community"]: r["artist"] for r in graph_queries.weighted_degree_centroid(spark, sf_dir).where("place = 1").collect()}
    assert set(centroids) == {r["community"] for r in t.memberships().collect()}
    wanted = {(c, d): _distances(edges, a).get(b) for c, a in centroids.items() for d, b in centroids.items()}
    got = graph_queries.QUERIES["community_distance_matrix"](spark, sf_dir).collect()
    assert len(got) == len(wanted) and {(r["community"], r["neighbour"]): r["hops"] for r in got} == wanted


def test_community_matrix_beyond_three_hops(spark):
    edges = spark.createDataFrame([(f"a{i:02}", f"a{i + 1:02}", 1.0) for i in range(12)], "src string, dst string, weight double")
    centroids = spark.createDataFrame([("A", "a00"), ("B", "a05"), ("C", "a12")], "community string, artist string")
    got = graph.community_matrix(graph.hop_distances(edges, centroids.select("artist")), centroids).collect()
    assert {(r["community"], r["neighbour"]): r["hops"] for r in got} == {(c, d): abs(i - j) if abs(i - j) <= 10 else None for c, i in zip("ABC", (0, 5, 12)) for d, j in zip("ABC", (0, 5, 12))}


def _modularity(edges, label):
    total, inside, volume = sum(edges.values()), 0.0, defaultdict(float)
    for (a, b), w in edges.items():
        inside += w if label[a] == label[b] else 0
        volume[label[a]] += w
        volume[label[b]] += w
    return inside / total - sum(v * v for v in volume.values()) / (2 * total) ** 2


def test_distances_from_more_sources_than_a_word_has_bits(spark):
    rng = random.Random(6)
    pairs = sorted({(rng.randrange(120), rng.randrange(120)) for _ in range(150)})
    edges = spark.createDataFrame([(f"a{a:03}", f"a{b:03}", 1.0) for a, b in pairs], "src string, dst string, weight double")
    sources = [f"a{i:03}" for i in range(0, 120)] + ["nowhere"]
    got = {(r["source"], r["artist"]): r["hops"] for r in graph.hop_distances(edges, spark.createDataFrame([(x,) for x in sources + sources[:5]], "artist string"), 4).collect()}
    wanted = {}
    for x in sources:
        wanted |= {(x, y): h for y, h in _distances([(f"a{a:03}", f"a{b:03}") for a, b in pairs], x).items() if h <= 4}
    assert got == wanted
    bits = graph.reached_bits(edges, spark.createDataFrame([(x, i) for i, x in enumerate(sources)], "artist string, nth long"), 4)
    assert max(r["count"] for r in bits.groupBy("hops", "word").count().collect()) <= 121


BLOCKS = [(f"{c}{i}", f"{c}{j}", 1.0 + 0.1 * ((i * j) % 3)) for c in "abcd" for i in range(5) for j in range(i)] + [("a0", "b0", 0.5), ("b1", "a2", 0.7), ("c0", "d0", 2.5), ("d1", "c1", 2.0), ("z", "z", 3.0), ("a0", "a0", 1.0)]


def test_modularity_never_falls(spark):
    edges = spark.createDataFrame(BLOCKS, "src string, dst string, weight double")
    weights = {(r["a"], r["b"]): r["weight"] for r in graph.undirected_edges(edges).collect()}
    ties, nodes = communities.first_level(edges)
    total = nodes.agg(F.sum("k")).first()[0]
    assert abs(total - 2 * sum(weights.values())) < 1e-9
    found = [_modularity(weights, {r["u"]: r["u"] for r in nodes.collect()})]
    for nodes in communities.moves(ties, nodes, total):
        label = {r["u"]: r["label"] for r in nodes.collect()}
        found.append(_modularity(weights, label))
    assert len(found) > 2 and all(a < b for a, b in zip(found, found[1:], strict=False))
    for artist in label:  # no move is left
        for other in set(label.values()):
            assert _modularity(weights, {**label, artist: other}) <= found[-1] + 1e-8


def test_communities_level_by_level(spark):
    edges = spark.createDataFrame(BLOCKS, "src string, dst string, weight double")
    weights = {(r["a"], r["b"]): r["weight"] for r in graph.undirected_edges(edges).collect()}
    found = [{r["artist"]: r["label"] for r in x.collect()} for x in communities.levels(edges)]
    assert all(set(x) == {e for pair in weights for e in pair} for x in found)
    for finer, coarser in zip(found, found[1:], strict=False):
        assert _modularity(weights, coarser) > _modularity(weights, finer)
        assert all(len({coarser[x] for x in finer if finer[x] == c}) == 1 for c in set(finer.values()))
    groups = {frozenset(x for x in found[-1] if found[-1][x] == c) for c in set(found[-1].values())}
    assert {frozenset("z")} < groups and all(len({x[0] for x in g if x != "z"} & {"a", "b"}) < 2 for g in groups)
    got = {r["artist"]: r["community"] for r in communities.modular_communities(edges).collect()}
    assert {frozenset(x for x in got if got[x] == c) for c in set(got.values())} == groups
    sizes = [list(got.values()).count(c) for c in sorted(set(got.values()))]
    assert sizes == sorted(sizes, reverse=True)
    assert communities.modular_communities(edges.limit(0)).count() == 0


def test_query_beats_a_single_round(spark, sf_dir):
    edges = graph_queries._edges(Tables(spark, sf_dir))
    weights = {(r["a"], r["b"]): r["weight"] for r in graph.undirected_edges(edges).collect()}
    got = {r["artist"]: r["community"] for r in graph_queries.modular_communities(spark, sf_dir).collect()}
    ties, nodes = communities.first_level(edges)
    once = {r["u"]: r["label"] for r in next(communities.moves(ties, nodes, nodes.agg(F.sum("k")).first()[0])).collect()}
    assert set(got) == {x for pair in weights for x in pair} and _modularity(weights, got) > _modularity(weights, once) + 0.01


def test_label_in_each_step_of_the_way(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 1.0), ("a", "d", 0.5), ("e", "a", 1.0), ("x", "x", 1.0)], "src string, dst string, weight double")
    labels = spark.createDataFrame([("b", "C1"), ("c", "C2"), ("d", "C1")], "artist string, community string")
    assert {tuple(r) for r in graph.propagate_labels(edges, labels).collect()} == {("b", "C1"), ("c", "C2"), ("d", "C1"), ("a", "C1"), ("e", "C1")}


def test_page_headings(spark, sf_dir):
    pages_ = Tables(spark, sf_dir).read("pages").select("page_id", "html").collect()
    got = {r["page_id"]: r for r in album_queries.html_pages(spark, sf_dir).collect()}
    assert len(got) == len(pages_)
    for r in pages_:
        html = re.sub("(?s)<!--.*?-->|<(script|style).*?</\\1>", "", r["html"] or "", flags=re.I)
        assert got[r["page_id"]]["n_paragraphs"] == len(re.findall(r"(?i)<p[\s>/]", html)) and got[r["page_id"]]["n_links"] == len(re.findall(r"(?i)<a[\s>/]", html))


def test_communities_send_and_receive_in_one_round(spark):
    """Two cliques with some members in each other's community: all of them go home at once."""
    edges = spark.createDataFrame([(f"{c}{i:02}", f"{c}{j:02}", 1.0) for c in "ab" for i in range(16) for j in range(i)], "src string, dst string, weight double")
    ties, nodes = communities.first_level(edges)
    stray = F.substring("u", 2, 2).cast("int") < 3
    start = nodes.withColumn("label", F.when(stray, F.when(F.col("u") < "b", "b15").otherwise("a15")).otherwise(F.concat(F.substring("u", 1, 1), F.lit("15"))))
    rounds = [{r["u"]: r["label"] for r in x.collect()} for x in communities.moves(ties, start, nodes.agg(F.sum("k")).first()[0])]
    assert len(rounds) == 1 and all(label == f"{u[0]}15" for u, label in rounds[0].items())


def test_edges_are_dealt_out_once_for_all_levels(spark, monkeypatch):
    plans, real = [], graph.stored

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(graph, "stored", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    tables = len(spark.catalog.listTables())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = real(spark.createDataFrame([(f"a{i}", f"a{i + 1}", 1.0) for i in range(6)], "src string, dst string, weight double"), "edges")
        found = graph.reached_bits(edges, spark.createDataFrame([("a0", 0)], "artist string, nth long"), 4).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r["artist"], r["hops"]) for r in found) == [(f"a{i}", i) for i in range(5)]
    steps = [x for x in plans if "Join" in x]
    assert len(steps) == 4 and all(x.count("Exchange hashpartitioning(src") == 1 for x in steps)
    assert len(spark.catalog.listTables()) == tables


def _above_the_bits(df):
    """Lines of the plan over and under the one that gives each source a row."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(lines) if "Generate explode" in x)
    return lines[:at], lines[at + 1 :]


def test_community_distances_count_before_sources_are_dealt_out(spark, sf_dir):
    over, under = _above_the_bits(graph_queries.community_distances(spark, sf_dir))
    assert sum("Join" in x for x in over) == 1 and any("Join Inner" in x for x in under)
    pairs = [(f"a{i:02}", f"a{i + 1:02}") for i in range(12)] + [("a03", "b"), ("x", "y")]
    edges = spark.createDataFrame([(*p, 1.0) for p in pairs], "src string, dst string, weight double")
    members = {x: f"C{i % 3}" for i, x in enumerate(sorted({x for p in pairs for x in p}))}
    sources = ["a00", "a07", "y", "nowhere"]
    wanted = {}
    for x in sources:
        hops = defaultdict(list)
        for y, h in _distances(pairs, x).items():
            if y in members:
                hops[members[y]].append(h)
        wanted |= {(x, c): (min(h), sum(h) / len(h)) for c, h in hops.items()}
    got = graph.community_distances(edges, spark.createDataFrame([(x,) for x in sources], "artist string"), spark.createDataFrame(list(members.items()), "artist string, community string"))
    assert {(r["source"], r["community"]): (r["min_hops"], r["mean_hops"]) for r in got.collect()} == wanted


def test_community_matrix_asks_for_centroids_alone(spark, sf_dir):
    _, under = _above_the_bits(graph_queries.community_distance_matrix(spark, sf_dir))
    assert any("Join LeftSemi" in x for x in under)
    edges = spark.createDataFrame([(f"a{i}", f"a{i + 1}", 1.0) for i in range(5)], "src string, dst string, weight double")
    ends = spark.createDataFrame([("a0",), ("a3",), ("nowhere",)], "artist string")
    got = {tuple(r) for r in graph.hop_distances(edges, ends, 10, ends).select("source", "artist", "hops").collect()}
    assert got == {("a0", "a0", 0), ("a0", "a3", 3), ("a3", "a0", 3), ("a3", "a3", 0), ("nowhere", "nowhere", 0)}


def test_communities_document_makes_no_pairs(spark, sf_dir, monkeypatch):
    t = Tables(spark, sf_dir)
    wanted = {r["artist"]: r["degree"] for r in graph.weighted_degrees(graph.artist_edges(t.reviews(), t.refs())).collect()}
    got = {r["artist"]: r["degree"] for r in graph.artist_degrees(t.reviews(), t.refs()).collect()}
    assert set(got) == set(wanted) and all(abs(got[x] - wanted[x]) < 1e-9 for x in wanted)

    def none(*_):
        raise AssertionError("edges")

    monkeypatch.setattr(graph, "artist_edges", none)
    assert document_queries.communities_document(spark, sf_dir).count() == 25


def test_communities_compute_the_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(rows):
        for batch in rows:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame(BLOCKS, "src string, dst string, weight double")
    tables = len(spark.catalog.listTables())
    assert communities.modular_communities(edges.mapInArrow(counted, edges.schema)).count() == 21
    assert seen.value == len(BLOCKS) and len(spark.catalog.listTables()) == tables


def _chance(spark):
    rng = random.Random(4)
    pairs = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(300)})
    return spark.createDataFrame([(f"a{a:02}", f"a{b:02}", rng.random()) for a, b in pairs], "src string, dst string, weight double")


def test_ties_stay_in_their_buckets(spark):
    ties, nodes = communities.first_level(_chance(spark))
    for everyone in (True, False):
        plan = communities.best_moves(ties, nodes.withColumn("slack", F.lit(0.0)), 1.0, 1.0, everyone)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(label" in plan and "Exchange hashpartitioning(u" not in plan and "Exchange hashpartitioning(v" not in plan


def test_rounds_that_look_at_some_nodes_move_the_same_ones(spark, monkeypatch):
    ties, nodes = communities.first_level(_chance(spark))
    weight = nodes.agg(F.sum("k")).first()[0]
    looks, real = [], communities.best_moves

    def seen(ties, nodes, weight, resolution, everyone):
        looks.append((everyone, nodes.where(f"slack <= {communities.MARGIN}").count() if not everyone else nodes.count()))
        return real(ties, nodes, weight, resolution, everyone)

    def rounds():
        return [{r["u"]: r["label"] for r in x.collect()} for x in communities.moves(ties, nodes, weight, 1.0, 0.001)]

    wanted = rounds()
    monkeypatch.setattr(communities, "MANY", 0)
    monkeypatch.setattr(communities, "FEW", 0)
    monkeypatch.setattr(communities, "best_moves", seen)
    assert len(wanted) > 3 and rounds() == wanted
    assert not any(everyone for everyone, _ in looks[1:]) and min(n for _, n in looks) < 60


def test_names_are_numbered_in_their_order(spark):
    names = [f"n{i * 7919 % 1000:03}" for i in range(1000)]
    found = communities.numbered(spark.createDataFrame([(x,) for x in names], "u string").repartition(7))
    assert {r["u"]: r["id"] for r in found.collect()} == {x: i for i, x in enumerate(sorted(names))}
