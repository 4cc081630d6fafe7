"""Measures of a directed weighted graph given as (src, dst) edges.

Iterations write their state to the work folder, so the lineage stays short and
a lost executor costs only its running tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedpanel.operators import search
from feedpanel.operators.networks import induced_edges
from feedpanel.operators.ordered import row_numbers
from feedpanel.session import materialize, slots


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Simple undirected edges (a < b): no loops, no repeats."""
    return (
        edges.filter("src <> dst")
        .select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .distinct()
    )


def size_and_density(edges: DataFrame) -> DataFrame:
    """Nodes, edges, directed density without loops, mean degree."""
    n = nodes_of(edges).agg(F.count(F.lit(1))).scalar()
    out = edges.agg(F.count(F.lit(1)).alias("n_edges")).withColumn("n_nodes", n)
    e, v = F.col("n_edges"), F.col("n_nodes")
    return out.select(
        "n_nodes",
        "n_edges",
        (e / F.nullif(v * (v - 1), F.lit(0))).alias("density"),
        (2 * e / F.nullif(v, F.lit(0))).alias("mean_degree"),
    )


def reciprocity(edges: DataFrame) -> DataFrame:
    """Share of edges (loops left out) whose reverse exists: both directions of a
    pair meet in one group, so no self join is needed."""
    pairs = (
        edges.filter("src <> dst")
        .groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .agg(F.count_distinct(F.col("src") < F.col("dst")).alias("directions"), F.count(F.lit(1)).alias("n"))
    )
    mutual = F.sum(F.when(F.col("directions") == 2, F.col("n")).otherwise(0))
    return pairs.agg((mutual / F.nullif(F.sum("n"), F.lit(0))).alias("reciprocity"))


def _either_way(edges: DataFrame) -> DataFrame:
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select(F.explode(F.array(F.struct("src", "dst"), back)).alias("e")).select("e.*")


def _same_links(now: DataFrame, before: DataFrame) -> bool:
    """Whether two tables of distinct links are equal."""
    return now.count() == before.count() and now.join(before, ["src", "dst"], "left_anti").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Weakly connected components as (id, component = smallest id).

    A round links every larger neighbour of a node to the smallest node around
    it, then every smaller neighbour, and the node itself, to the smallest of
    those. Long paths shrink to stars in few rounds; the links never grow.
    """
    links = materialize(undirected(edges).select(F.col("b").alias("src"), F.col("a").alias("dst")))
    before = None
    while before is None or not _same_links(links, before):
        around = _either_way(links)
        low = around.groupBy("src").agg(F.min(F.least("src", "dst")).alias("low"))
        large = materialize(
            around.filter("dst > src")
            .join(low, "src")
            .select(F.col("dst").alias("src"), F.col("low").alias("dst"))
            .distinct()
        )
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        ends = F.explode(F.array("src", "dst")).alias("src")
        shrunk = large.join(low, "src").select(ends, F.col("low").alias("dst")).filter("src <> dst").distinct()
        before, links = links, materialize(shrunk)
    roots = links.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    return nodes_of(edges).join(roots, "id", "left").withColumn("component", F.coalesce("component", "id"))


def giant_component(components: DataFrame) -> DataFrame:
    """Ids of the largest component (ties: the smallest component id)."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), "component").limit(1)
    return components.join(top.select("component"), "component", "left_semi").select("id")


def component_summary(components: DataFrame) -> DataFrame:
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_components"),
        F.max("n").alias("giant_size"),
        (F.max("n") / F.sum("n")).alias("giant_share"),
    )


def transitivity(edges: DataFrame) -> DataFrame:
    """Three times the triangles over the connected triples, edges undirected.

    Edges point from the lower to the higher degree, which bounds every
    neighbour list by the square root of twice the edges; triangles of an edge are
    the common entries of two such lists, so no pair of neighbours is listed.
    """
    simple = materialize(undirected(edges))
    degree = simple.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    da = degree.select(F.col("id").alias("a"), F.col("d").alias("da"))
    db = degree.select(F.col("id").alias("b"), F.col("d").alias("db"))
    up = F.struct("da", "a") < F.struct("db", "b")
    directed = simple.join(da, "a").join(db, "b").select(
        F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"),
        F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"),
    )
    directed = materialize(directed)
    lists = directed.groupBy("u").agg(F.collect_list("v").alias("out"))
    common = (
        directed.join(lists, "u")
        .join(lists.select(F.col("u").alias("v"), F.col("out").alias("out_v")), "v")
        .select(F.size(F.array_intersect("out", "out_v")).alias("t"))
    )
    triangles = common.agg(F.coalesce(F.sum("t"), F.lit(0))).scalar()
    triples = degree.agg(F.sum(F.col("d") * (F.col("d") - 1) / 2).alias("triples"))
    return triples.select(
        triangles.cast("bigint").alias("triangles"),
        F.col("triples").cast("bigint").alias("triples"),
        (3 * triangles / F.nullif("triples", F.lit(0.0))).alias("transitivity"),
    )


_MAX_WORDS = 16  # 64 sources per word
# Largest graph that one task searches by itself, and bytes of each of the three tables of bits it then holds.
_EDGES_PER_TASK = 32_000_000
_BITS_PER_TASK = 64_000_000


def _inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges without loops between the nodes."""
    return materialize(induced_edges(edges.filter("src <> dst").select("src", "dst").distinct(), nodes))


def path_lengths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean directed distance over reachable ordered pairs of ``nodes``.

    Breadth-first search from all sources at once, one bit per source and node. A
    graph of up to ``_EDGES_PER_TASK`` edges is sent to each group of sources, whose
    task keeps the bits of a batch of them in bounded memory, so only the edges are
    shuffled, once per shuffle partition. The steps of a larger graph are joins.
    """
    inside = _inside(edges, nodes)
    ends = F.array(F.struct(F.col("dst").alias("id"), F.lit(-1).alias("k")), F.struct(F.col("src").alias("id"), F.lit(0).alias("k")))
    ends = inside.select(F.explode(ends).alias("e")).groupBy("e.id").agg(F.sum("e.k").alias("k"))
    numbered = materialize(row_numbers(ends, ["k", "id"], "no").select("id", (F.col("no") - 1).alias("no"), "no_total", "k"))
    n, n_edges = numbered.agg(F.max("no_total"), -F.sum("k")).first()
    if not n:
        pairs = total = 0
    elif n_edges <= _EDGES_PER_TASK and 8 * n <= _BITS_PER_TASK:
        pairs, total = _searched(inside, numbered, n)
    else:
        pairs, total = _stepwise(inside, numbered, n)
    mean = float(total) / pairs if pairs else None
    return edges.sparkSession.createDataFrame(
        [(int(pairs), int(total), mean)], "reachable_pairs bigint, total_distance bigint, avg_path_length double"
    )


def _searched(inside: DataFrame, numbered: DataFrame, n: int) -> tuple[int, int]:
    """Reachable pairs and the sum of their distances, each group of sources searched by one task."""
    partitions = int(inside.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = min(_MAX_WORDS, _BITS_PER_TASK // (8 * n), n // 64 + 1)
    per_batch = 64 * words
    groups = min(partitions, -(-n // per_batch))
    one, other = (numbered.select(F.col("id").alias(end), F.col("no").alias(end[0])) for end in ("src", "dst"))
    edges = inside.join(one, "src").join(other, "dst").select("d", "s")
    packed = edges.repartitionByRange("d", "s").sortWithinPartitions("d", "s").mapInPandas(search.pack, search.PACKED)
    each = [F.struct(F.lit(g).alias("group"), F.lit(s).alias("slot")) for g, s in enumerate(slots(partitions)[:groups])]
    sent = packed.withColumn("to", F.explode(F.array(*each))).select("*", "to.*").drop("to").repartition(partitions, "slot")

    def lengths(pdf: pd.DataFrame) -> pd.DataFrame:
        graph = search.Search(*search.unpack(pdf), n, words)
        sources, step = graph.sources(), per_batch * groups
        found = [graph.run(sources[i : i + per_batch]) for i in range(per_batch * int(pdf["group"].iloc[0]), len(sources), step)]
        return pd.DataFrame({"pairs": [sum(p for p, _ in found)], "total": [sum(t for _, t in found)]})

    found = sent.groupBy("slot").applyInPandas(lengths, "pairs bigint, total bigint")
    return found.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()


def _stepwise(inside: DataFrame, numbered: DataFrame, n: int) -> tuple[int, int]:
    """The same by one join per step: a row per node and batch of sources that reach
    it carries one bit per source. Jobs follow the longest distance, not the number
    of nodes; the state has at most one bit per pair and is spread by node and batch.
    """
    words = [f"w{i}" for i in range(min(_MAX_WORDS, n // 64 + 1))]
    per_batch = 64 * len(words)
    bit = F.expr("shiftleft(bigint(1), int(no % 64))")
    own = {w: F.when(F.floor(F.col("no") % per_batch / 64) == i, bit).otherwise(F.lit(0).cast("bigint")) for i, w in enumerate(words)}
    state = numbered.select("id", F.floor(F.col("no") / per_batch).alias("batch"), *[e.alias(w) for w, e in own.items()])
    state = materialize(state.select("*", *[F.col(w).alias(f"f{w}") for w in words]))
    none = F.lit(0).cast("bigint")
    depth = total = pairs = 0
    while True:
        depth += 1
        # bits that arrived in the last step travel on
        front = state.filter(" OR ".join(f"f{w} <> 0" for w in words))
        arriving = (
            front.select(F.col("id").alias("src"), "batch", *[f"f{w}" for w in words])
            .hint("merge")  # the files of a state are small, the state is not
            .join(inside, "src")
            .groupBy(F.col("dst").alias("id"), "batch")
            .agg(*[F.bit_or(f"f{w}").alias(f"n{w}") for w in words])
        )
        known = state.select("id", "batch", *words).join(arriving, ["id", "batch"], "full")
        seen = {w: F.coalesce(F.col(w), none) for w in words}
        fresh = {w: F.coalesce(F.col(f"n{w}"), none).bitwiseAND(F.bitwise_not(seen[w])) for w in words}
        moved = known.select("id", "batch", *[seen[w].alias(w) for w in words], *[f.alias(f"f{w}") for w, f in fresh.items()])
        state = materialize(
            moved.select("id", "batch", *[F.col(w).bitwiseOR(F.col(f"f{w}")).alias(w) for w in words], *[f"f{w}" for w in words])
        )
        reached = state.agg(F.coalesce(F.sum(sum((F.bit_count(F.col(f"f{w}")) for w in words), F.lit(0))), F.lit(0))).first()[0]
        if reached == 0:
            break
        total += depth * reached
        pairs += reached
    return pairs, total


def path_lengths_sketch(edges: DataFrame, nodes: DataFrame, precision: int = 12) -> DataFrame:
    """Estimates of ``path_lengths`` from one mergeable sketch per node.

    A node's sketch counts the distinct nodes it reaches; every step merges in
    those of the nodes its edges lead to. What all sketches count after a step,
    less what they counted before, is the number of pairs at that distance. A
    sketch has at most 2^precision bytes, so the state grows with the nodes alone;
    a count is off by about 1 / sqrt(2^precision) of itself.
    """
    inside = _inside(edges, nodes)
    state = materialize(nodes.select("id").distinct().groupBy("id").agg(F.hll_sketch_agg("id", F.lit(precision)).alias("reach")))

    def counted(table: DataFrame) -> int:
        return table.agg(F.sum(F.hll_sketch_estimate("reach"))).first()[0] or 0

    n = before = counted(state)
    depth = total = 0
    while True:
        depth += 1
        # sketches that are alike make a small file, but not a small table to send to the driver and all executors
        onward = inside.join(state.withColumnRenamed("id", "dst").hint("merge"), "dst").select(F.col("src").alias("id"), "reach")
        state = materialize(state.unionByName(onward).groupBy("id").agg(F.hll_union_agg("reach").alias("reach")))
        now = counted(state)
        if now <= before:
            break
        total += depth * (now - before)
        before = now
    pairs = before - n
    return edges.sparkSession.createDataFrame(
        [(int(pairs), int(total), float(total) / pairs if pairs else None)],
        "reachable_pairs bigint, total_distance bigint, avg_path_length double",
    )


def core_numbers(edges: DataFrame) -> DataFrame:
    """k-core number per node. Both directions of a pair count, loops do not.

    Every node starts with its degree and takes the largest k that at least k of
    its neighbours reach, until nothing changes (rounds grow with the spread of
    changes, not with the highest core). A node is seen through the counts per
    distinct value of its neighbours, which are few even for a hub.
    """
    near = materialize(
        _either_way(edges.filter("src <> dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    )
    cores = materialize(near.groupBy("src").agg(F.sum("m").alias("core")))
    from_high = Window.partitionBy("src").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
    before, now = None, cores.agg(F.sum("core")).first()[0]
    while before != now:
        other = cores.select(F.col("src").alias("dst"), F.col("core").alias("theirs"))
        seen = near.join(other, "dst").join(cores, "src")
        values = seen.groupBy("src", F.least("theirs", "core").alias("v")).agg(F.sum("m").alias("n"))
        reached = values.withColumn("reach", F.sum("n").over(from_high))
        cores = materialize(reached.groupBy("src").agg(F.max(F.least("v", "reach")).alias("core")))
        # numbers only fall, so an equal sum means that none fell
        before, now = now, cores.agg(F.sum("core")).first()[0]
    named = cores.select(F.col("src").alias("id"), F.col("core").cast("int").alias("core"))
    return nodes_of(edges).join(named, "id", "left").fillna(0, subset=["core"])


def network_summary(edges: DataFrame, name: str) -> DataFrame:
    """All measures of one network in one row."""
    edges = materialize(edges.select("src", "dst").distinct())
    comp = materialize(components(edges))
    giant = giant_component(comp)
    rows = {
        "size": size_and_density(edges).first(),
        "rec": reciprocity(edges).first(),
        "comp": component_summary(comp).first(),
        "tri": transitivity(edges).first(),
        "path": path_lengths(edges, giant).first(),
        "core": core_numbers(edges).agg(F.max("core").alias("max_core")).first(),
    }
    merged = {k: v for row in rows.values() for k, v in row.asDict().items()}
    schema = (
        "network string, n_nodes bigint, n_edges bigint, density double, mean_degree double, reciprocity double, "
        "giant_size bigint, giant_share double, transitivity double, avg_path_length double, max_core int"
    )
    names = [c.split()[0] for c in schema.split(", ")][1:]
    return edges.sparkSession.createDataFrame([(name, *[merged[c] for c in names])], schema)


def compare_networks(networks: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, edges in networks.items():
        one = network_summary(edges, name)
        out = one if out is None else out.unionByName(one)
    return out
