"""Graph measures against plain Python on random graphs."""

import random
from collections import defaultdict, deque
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from feedpanel.operators import graph, networks, search


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(2)
    nodes = [f"n{i}" for i in range(60)]
    out = {("hub", n) for n in nodes[:30]}
    out |= {(rng.choice(nodes[:40]), rng.choice(nodes[:40])) for _ in range(90)}
    out |= {(b, a) for a, b in list(out)[:20]}
    # a long path far from the rest, a pair and a loop
    out |= {(f"p{i:02d}", f"p{i + 1:02d}") for i in range(25)} | {("q1", "q0"), ("z", "z")}
    return sorted(out)


@pytest.fixture(scope="module")
def df(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def neighbours(edges, directed=False):
    out = defaultdict(set)
    for a, b in edges:
        if a != b:
            out[a].add(b)
            if not directed:
                out[b].add(a)
    return out


def reach(start, near):
    dist, todo = {start: 0}, deque([start])
    while todo:
        x = todo.popleft()
        for y in near[x]:
            if y not in dist:
                dist[y] = dist[x] + 1
                todo.append(y)
    return dist


def brute_components(edges):
    near = neighbours(edges)
    ids = {x for e in edges for x in e}
    return {x: min(reach(x, near)) for x in ids}


def test_components(df, edges):
    got = {r["id"]: r["component"] for r in graph.components(df).collect()}
    assert got == brute_components(edges)


def test_reciprocity_and_size(df, edges):
    plain = [(a, b) for a, b in edges if a != b]
    want = sum((b, a) in set(plain) for a, b in plain) / len(plain)
    assert graph.reciprocity(df).first()[0] == pytest.approx(want)
    ids = {x for e in edges for x in e}
    row = graph.size_and_density(df).first()
    assert (row["n_nodes"], row["n_edges"]) == (len(ids), len(edges))
    assert row["density"] == pytest.approx(len(edges) / (len(ids) * (len(ids) - 1)))


def test_transitivity(df, edges):
    near = neighbours(edges)
    triples = sum(len(v) * (len(v) - 1) // 2 for v in near.values())
    closed = sum(b in near[a] for v in near.values() for a, b in combinations(v, 2))
    row = graph.transitivity(df).first()
    assert (row["triangles"], row["triples"]) == (closed // 3, triples)
    assert row["transitivity"] == pytest.approx(closed / triples)


def test_path_lengths(df, edges):
    comp = graph.components(df)
    giant = {r["id"] for r in graph.giant_component(comp).collect()}
    inside = [(a, b) for a, b in edges if a in giant and b in giant]
    near = neighbours(inside, directed=True)
    dists = [d for x in giant for y, d in reach(x, near).items() if y != x]
    row = graph.path_lengths(df, graph.giant_component(comp)).first()
    assert (row["reachable_pairs"], row["total_distance"]) == (len(dists), sum(dists))


def test_path_lengths_in_batches(df, edges, monkeypatch):
    monkeypatch.setattr(graph, "_MAX_WORDS", 1)
    ids = graph.nodes_of(df)
    near = neighbours(edges, directed=True)
    dists = [d for x in {x for e in edges for x in e} for y, d in reach(x, near).items() if y != x]
    row = graph.path_lengths(df, ids).first()
    assert (row["reachable_pairs"], row["total_distance"]) == (len(dists), sum(dists))


def test_path_lengths_need_no_more_jobs_for_more_nodes(spark, monkeypatch):
    monkeypatch.setattr(graph, "_MAX_WORDS", 1)

    def jobs(nodes):
        # a star of paths with three edges each: the longest distance is the same for any number of nodes
        star = spark.range(nodes).select(F.explode(F.expr("array(struct('hub' AS src, concat('a', id) AS dst), struct(concat('a', id) AS src, concat('b', id) AS dst))")).alias("e")).select("e.*")
        context, name = spark.sparkContext, f"paths-{nodes}"
        context.setJobGroup(name, name)
        row = graph.path_lengths(star, graph.nodes_of(star)).first()
        assert (row["reachable_pairs"], row["total_distance"]) == (3 * nodes, 4 * nodes)
        count = len(context.statusTracker().getJobIdsForGroup(name))
        context.setLocalProperty("spark.jobGroup.id", None)
        return count

    few, many = jobs(20), jobs(600)  # one batch of sources, nineteen batches
    assert many <= few + 3


def test_path_lengths_need_no_more_jobs_for_longer_paths(spark):
    def jobs(nodes):
        path = spark.range(nodes - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
        context, name = spark.sparkContext, f"path-{nodes}"
        context.setJobGroup(name, name)
        row = graph.path_lengths(path, graph.nodes_of(path)).first()
        assert (row["reachable_pairs"], row["total_distance"]) == (nodes * (nodes - 1) // 2, (nodes + 1) * nodes * (nodes - 1) // 6)
        count = len(context.statusTracker().getJobIdsForGroup(name))
        context.setLocalProperty("spark.jobGroup.id", None)
        return count

    assert jobs(30) <= jobs(5) + 3  # no step crosses the shuffle


@pytest.mark.parametrize("limit", ["_EDGES_PER_TASK", "_BITS_PER_TASK"])
def test_path_lengths_of_graphs_too_large_for_a_task(df, edges, monkeypatch, limit):
    monkeypatch.setattr(graph, limit, 1)
    near = neighbours(edges, directed=True)
    dists = [d for x in {x for e in edges for x in e} for y, d in reach(x, near).items() if y != x]
    row = graph.path_lengths(df, graph.nodes_of(df)).first()
    assert (row["reachable_pairs"], row["total_distance"]) == (len(dists), sum(dists))


@pytest.mark.parametrize("few,rows", [(0, 8192), (0, 7), (10**6, 8192), (150, 64)])
def test_search_inside_a_task(monkeypatch, few, rows):
    monkeypatch.setattr(search, "_ROWS_AT_ONCE", rows)
    rng = random.Random(6)
    # two nodes that nearly all lead to, a path off the rest and nodes without edges in or out
    links = {(i, h) for h in (200, 201) for i in range(150) if i % 7} | {(rng.randrange(120), rng.randrange(40, 202)) for _ in range(400)}
    links |= {(200, 3), (201, 210)} | {(i, i + 1) for i in range(210, 240)}
    links = {(a, b) for a, b in links if a != b}
    into = defaultdict(int)
    for _, b in links:
        into[b] += 1
    ids = sorted({x for e in links for x in e}, key=lambda x: (-into[x], x))
    no = {x: i for i, x in enumerate(ids)}
    table = pd.DataFrame(sorted((no[b], no[a]) for a, b in links), columns=["d", "s"])
    packed = list(search.pack(table.iloc[i : i + 90] for i in range(0, len(table), 90)))
    src, dst = search.unpack(pd.concat(packed[::-1], ignore_index=True))
    assert list(zip(dst, src)) == list(table.itertuples(index=False, name=None))
    found = search.Search(src, dst, len(ids), 2)
    sources = found.sources()
    assert sorted(ids[i] for i in sources) == sorted({a for a, _ in links})
    near = neighbours(links, directed=True)
    for some in (sources[:128], sources[128:]):
        dists = [d for x in some for y, d in reach(ids[x], near).items() if y != ids[x]]
        assert found.run(np.asarray(some), few) == (len(dists), sum(dists))


def test_compared_networks_shuffle_no_bits(spark, monkeypatch):
    monkeypatch.setattr(graph, "_stepwise", None)  # the joins that carry a bit per pair
    ring = spark.range(9).select(F.col("id").alias("src"), ((F.col("id") + 1) % 9).alias("dst"))
    row = graph.compare_networks({"ring": ring}).first()
    assert (row["network"], row["giant_size"], row["avg_path_length"], row["max_core"]) == ("ring", 9, 4.5, 2)


def test_path_lengths_of_nothing(spark, df):
    none = graph.nodes_of(df).limit(0)
    for lengths in (graph.path_lengths, graph.path_lengths_sketch):
        assert lengths(df, none).first().asDict() == {"reachable_pairs": 0, "total_distance": 0, "avg_path_length": None}


def test_sketched_path_lengths_are_close(spark):
    rng = random.Random(9)
    links = {(rng.randrange(1500), rng.randrange(1500)) for _ in range(4000)}
    random_graph = spark.createDataFrame(sorted(links), "src bigint, dst bigint")
    ids = graph.nodes_of(random_graph)
    exact, close = graph.path_lengths(random_graph, ids).first(), graph.path_lengths_sketch(random_graph, ids).first()
    # sketches of 4,096 bytes: 1.6 % per count
    assert close["reachable_pairs"] == pytest.approx(exact["reachable_pairs"], rel=0.03)
    assert close["avg_path_length"] == pytest.approx(exact["avg_path_length"], rel=0.02)


def test_states_of_nodes_are_not_sent_to_the_driver(spark, monkeypatch):
    plans, store = [], graph.materialize
    monkeypatch.setattr(graph, "_EDGES_PER_TASK", 0)
    monkeypatch.setattr(graph, "materialize", lambda t: plans.append((t.columns, t._jdf.queryExecution().executedPlan().toString())) or store(t))
    ring = spark.range(9).select(F.col("id").alias("src"), ((F.col("id") + 1) % 9).alias("dst"))
    # in the end every node reaches the same ones: files of equal sketches are small, the sketches are not
    assert graph.path_lengths(ring, graph.nodes_of(ring)).first()["reachable_pairs"] == 72
    assert graph.path_lengths_sketch(ring, graph.nodes_of(ring)).first()["reachable_pairs"] == 72
    steps = [plan for columns, plan in plans if ("reach" in columns or "fw0" in columns) and "Join" in plan]
    assert len(steps) > 10 and not any("Broadcast" in plan for plan in steps)


def test_core_numbers(df, edges):
    near = defaultdict(lambda: defaultdict(int))
    for a, b in edges:
        if a != b:
            near[a][b] += 1
            near[b][a] += 1
    want = {x: 0 for e in edges for x in e}
    left, k = {x for x in near}, 0
    while left:
        degree = {x: sum(m for y, m in near[x].items() if y in left) for x in left}
        low = min(degree, key=degree.get)
        k = max(k, degree[low])
        want[low] = k
        left.remove(low)
    assert {r["id"]: r["core"] for r in graph.core_numbers(df).collect()} == want


def test_cosharing_in_tiles(spark):
    rng = random.Random(4)
    # one user shares everything, so a third of all rows are theirs
    rows = [("all", f"d{i}") for i in range(40)] + [(f"u{rng.randrange(9)}", f"d{rng.randrange(40)}") for _ in range(80)]
    rows += rows[:10]
    want = defaultdict(int)
    mine = defaultdict(set)
    for u, d in rows:
        mine[u].add(d)
    for ds in mine.values():
        for pair in combinations(sorted(ds), 2):
            want[pair] += 1
    df = spark.createDataFrame(rows, "author_id string, domain string")
    for tile, chunk in ((1024, 4096), (7, 3)):
        got = networks.cosharing_edges(df, tile, chunk).collect()
        assert {(r["source"], r["target"]): r["weight"] for r in got} == dict(want)


@pytest.mark.parametrize("pairs,at_once,dense", [(20, 7, 0), (20, 7, 10**6), (10**6, 7, 0)])
def test_cosharing_thin_and_full(spark, monkeypatch, pairs, at_once, dense):
    rng = random.Random(5)
    monkeypatch.setattr(networks, "_PAIRS_PER_TASK", pairs)
    monkeypatch.setattr(networks, "_PAIRS_AT_ONCE", at_once)
    monkeypatch.setattr(networks, "_DENSE_PER_PAIR", dense)
    mine = {f"u{i}": {f"d{rng.randrange(60)}" for _ in range(rng.choice([1, 2, 9, 40]))} for i in range(25)}
    want = defaultdict(int)
    for ds in mine.values():
        for pair in combinations(sorted(ds), 2):
            want[pair] += 1
    df = spark.createDataFrame([(u, d) for u, ds in mine.items() for d in ds] + [(None, "d1"), ("u1", None)], "author_id string, domain string")
    got = networks.cosharing_edges(df, 10, 6).collect()
    assert {(r["source"], r["target"]): r["weight"] for r in got} == dict(want) and len(got) == len(want)


def test_cosharing_cells_travel_packed():
    rng = np.random.default_rng(7)
    n, side = 100_000, 30
    cells = np.unique(rng.integers(0, n, (200_000, 2)), axis=0)
    low, high = (cells.min(axis=1) + 1)[cells[:, 0] != cells[:, 1]], (cells.max(axis=1) + 1)[cells[:, 0] != cells[:, 1]]
    weight = rng.integers(1, 4, len(low))
    weight[0] = 2**40
    wide = n // side + 1
    packed = networks._packed(pd.DataFrame({"i": low, "j": high, "weight": weight}), side, wide)
    assert len(packed) == side * side
    # three words of a pair took 24 bytes
    assert packed["cells"].map(len).sum() <= 4 * len(low)
    twice = pd.concat([packed, packed])
    got = pd.concat([networks._sum_block(part, side, wide) for _, part in twice.groupby("block")])
    want = defaultdict(int)
    for i, j, w in zip(low, high, weight):
        want[int(i), int(j)] += 2 * int(w)
    assert len(got) == len(want) and {(i, j): w for i, j, w in got.itertuples(index=False, name=None)} == dict(want)


@pytest.mark.parametrize("pairs", [1, 50])
def test_cosharing_in_blocks(spark, monkeypatch, pairs):
    monkeypatch.setattr(networks, "_PAIRS_PER_BLOCK", pairs)
    rng = random.Random(8)
    mine = {f"u{i}": {f"d{rng.randrange(70)}" for _ in range(rng.choice([1, 2, 9]))} | {"d0"} for i in range(30)}
    want = defaultdict(int)
    for ds in mine.values():
        for pair in combinations(sorted(ds), 2):
            want[pair] += 1
    df = spark.createDataFrame([(u, d) for u, ds in mine.items() for d in ds], "author_id string, domain string")
    shared = networks.cosharing_edges(df, 10, 6)
    got = shared.collect()
    assert {(r["source"], r["target"]): r["weight"] for r in got} == dict(want) and len(got) == len(want)
    # no row per pair of a chunk is shuffled
    assert "HashAggregate" not in shared._jdf.queryExecution().sparkPlan().toString().split("FlatMapGroupsInPandas")[0]


def test_reply_tables(spark):
    rows = [("a", "b")] * 3 + [("b", "a"), ("a", "x"), ("x", "a"), ("x", "y"), ("a", "a")]
    replies = spark.createDataFrame(rows, "src string, dst string")
    sample = spark.createDataFrame([("a",), ("b",), ("b",)], "author_id string")
    edges = networks.reply_edges(replies, sample)
    kinds = {(r["src"], r["dst"]): (r["weight"], r["edge_type"]) for r in edges.collect()}
    assert kinds == {("a", "b"): (3, "internal"), ("b", "a"): (1, "internal"), ("a", "x"): (1, "outgoing"),
                     ("x", "a"): (1, "incoming"), ("x", "y"): (1, "outgoing"), ("a", "a"): (1, "internal")}
    nodes = {r["user_id"]: (r["n_replies_received"], r["n_replies_sent"], r["sample_status"])
             for r in networks.with_sample_status(networks.reply_nodes(edges), sample).collect()}
    assert nodes == {"a": (3, 5, "inside"), "b": (3, 1, "inside"), "x": (1, 2, "outside"), "y": (1, 0, "outside")}
    assert networks.internal_edges(replies, sample).agg(F.sum("weight")).first()[0] == 5
    summary = networks.reply_summary(edges).first()
    assert (summary["targets"], summary["targets_in_sample"], summary["replies_in_sample"], summary["replies_outside"]) == (4, 2, 6, 2)
