"""Reply and co-sharing networks, graph measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import POSTS, query
from catalog.daily import r, rounded
from catalog.users import GROUPS_SQL, make_groups
from feedpanel.operators import graph, networks, panel

_RP = f"""WITH RECURSIVE {POSTS}, rp AS (SELECT author_id AS src, in_reply_to_user_id AS dst FROM posts WHERE in_reply_to_user_id IS NOT NULL AND created_at >= TIMESTAMP '2024-01-02' AND created_at < TIMESTAMP '2024-01-29'),
ed AS (SELECT src, dst, count(*) AS weight, src IN (SELECT author_id FROM authors) AS source_in_sample, dst IN (SELECT author_id FROM authors) AS target_in_sample FROM rp GROUP BY 1, 2),
ie AS (SELECT src, dst, weight FROM ed WHERE source_in_sample AND target_in_sample)"""


def make_replies(t):
    return networks.replies(panel.in_period(t.posts(), "2024-01-02", "2024-01-29"))


def make_edges(t):
    return networks.reply_edges(make_replies(t), t.authors())


@query("reply_edges", f"{_RP} SELECT *, CASE WHEN source_in_sample AND target_in_sample THEN 'internal' WHEN NOT target_in_sample THEN 'outgoing' ELSE 'incoming' END AS edge_type FROM ed")
def reply_edges(t):
    return make_edges(t)


@query("internal_edges", f"{_RP} SELECT * FROM ie")
def internal_edges(t):
    return networks.internal_edges(make_replies(t), t.authors())


_ND = """nd AS (SELECT user_id, CAST(sum(rec) AS BIGINT) AS n_replies_received, CAST(sum(sent) AS BIGINT) AS n_replies_sent, CAST(sum(rec + sent) AS BIGINT) AS total_activity
 FROM (SELECT dst AS user_id, 1 AS rec, 0 AS sent FROM rp UNION ALL SELECT src, 0, 1 FROM rp) GROUP BY 1)"""


@query("reply_nodes", f"{_RP}, {_ND} SELECT *, user_id IN (SELECT author_id FROM authors) AS in_sample, CASE WHEN user_id IN (SELECT author_id FROM authors) THEN 'inside' ELSE 'outside' END AS sample_status FROM nd")
def reply_nodes(t):
    return networks.with_sample_status(networks.reply_nodes(make_edges(t)), t.authors())


@query("reply_summary", f"""{_RP} SELECT count(DISTINCT dst) AS targets, count(DISTINCT dst) FILTER (target_in_sample) AS targets_in_sample, count(DISTINCT dst) FILTER (NOT target_in_sample) AS targets_outside,
 {r('count(DISTINCT dst) FILTER (target_in_sample) * 100.0 / count(DISTINCT dst)', 'overlap_pct')}, CAST(sum(weight) FILTER (target_in_sample) AS BIGINT) AS replies_in_sample, CAST(sum(weight) FILTER (NOT target_in_sample) AS BIGINT) AS replies_outside FROM ed""")
def reply_summary(t):
    return rounded(networks.reply_summary(make_edges(t)))


@query("top_replied", f"{_RP} SELECT dst AS user_id, count(*) AS reply_count FROM rp GROUP BY 1 ORDER BY reply_count DESC, user_id LIMIT 20")
def top_replied(t):
    return networks.top_replied(make_replies(t))


@query("ranked_edges", f"{_RP} SELECT src, dst, weight FROM ie ORDER BY weight DESC, src, dst")
def ranked_edges(t):
    return networks.ranked(networks.internal_edges(make_replies(t), t.authors()), "weight", "src", "dst")


_SH = """sh AS (SELECT author_id, ng_domain AS domain, Score FROM panel WHERE ng_domain IS NOT NULL AND author_id IN (SELECT author_id FROM groups WHERE "group" = 'Untrustworthy'))"""


def make_shares(t):
    sharers = make_groups(t).filter("`group` = 'Untrustworthy'")
    shares = panel.keep_authors(t.panel(), sharers).filter("ng_domain IS NOT NULL AND Score IS NOT NULL")
    return shares.select("author_id", F.col("ng_domain").alias("domain"), "Score")


@query("source_nodes", f"{GROUPS_SQL}, {_SH} SELECT domain, count(*) AS mentions, CAST(CASE WHEN count(*) FILTER (Score >= 60) > count(*) FILTER (Score < 60) THEN 1 ELSE 0 END AS INTEGER) AS \"Rating\", count(DISTINCT author_id) AS unique_users FROM sh GROUP BY 1")
def source_nodes(t):
    return networks.source_nodes(make_shares(t))


_PAIRS = "SELECT a.domain AS source, b.domain AS target, count(*) AS weight FROM (SELECT DISTINCT author_id, domain FROM sh) a JOIN (SELECT DISTINCT author_id, domain FROM sh) b ON a.author_id = b.author_id AND a.domain < b.domain GROUP BY 1, 2"


@query("cosharing_edges", f"{GROUPS_SQL}, {_SH} {_PAIRS}")
def cosharing_edges(t):
    return networks.cosharing_edges(make_shares(t))


@query("cosharing_suppliers", "WITH sh AS (SELECT o_custkey AS author_id, 's' || l_suppkey AS domain FROM lineitem JOIN orders ON l_orderkey = o_orderkey) " + _PAIRS)
def cosharing_suppliers(t):
    shares = t.table("lineitem").join(t.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return networks.cosharing_edges(shares.select(F.col("o_custkey").alias("author_id"), F.concat(F.lit("s"), "l_suppkey").alias("domain")))


# --- graph measures on the internal reply network --------------------------
def make_internal(t):
    return networks.internal_edges(make_replies(t), t.authors()).select("src", "dst")


@query("induced_subgraph", f"{GROUPS_SQL}, rp AS (SELECT author_id AS src, in_reply_to_user_id AS dst FROM posts WHERE in_reply_to_user_id IS NOT NULL), g AS (SELECT author_id FROM groups WHERE \"group\" = 'Trustworthy') SELECT src, dst, count(*) AS weight FROM rp WHERE src IN (SELECT author_id FROM g) AND dst IN (SELECT author_id FROM g) GROUP BY 1, 2")
def induced_subgraph(t):
    edges = networks.replies(t.posts()).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    group = make_groups(t).filter("`group` = 'Trustworthy'").select(F.col("author_id").alias("id"))
    return networks.induced_edges(edges, group)


@query("size_and_density", f"{_RP}, v AS (SELECT count(*) AS n FROM (SELECT src FROM ie UNION SELECT dst FROM ie)) SELECT n AS n_nodes, count(*) AS n_edges, {r('count(*) / CAST(n * (n - 1) AS DOUBLE)', 'density')}, {r('2.0 * count(*) / n', 'mean_degree')} FROM ie, v GROUP BY n")
def size_and_density(t):
    return rounded(graph.size_and_density(make_internal(t)))


@query("reciprocity", f"{_RP}, e AS (SELECT * FROM ie WHERE src <> dst) SELECT {r('avg(CAST((SELECT count(*) FROM e f WHERE f.src = e.dst AND f.dst = e.src) AS DOUBLE))', 'reciprocity')} FROM e")
def reciprocity(t):
    return rounded(graph.reciprocity(make_internal(t)))


_COMP = f"""{_RP}, un AS (SELECT src AS a, dst AS b FROM ie UNION SELECT dst, src FROM ie),
rc AS (SELECT a AS id, a AS m FROM un UNION SELECT un.b, rc.m FROM rc JOIN un ON rc.id = un.a),
comp AS (SELECT id, min(m) AS component FROM rc GROUP BY 1)"""


@query("components", f"{_COMP} SELECT * FROM comp")
def components(t):
    return graph.components(make_internal(t))


@query("component_summary", f"{_COMP} SELECT count(*) AS n_components, max(n) AS giant_size, {r('max(n) / CAST(sum(n) AS DOUBLE)', 'giant_share')} FROM (SELECT component, count(*) AS n FROM comp GROUP BY 1)")
def component_summary(t):
    return rounded(graph.component_summary(graph.components(make_internal(t))))


@query("transitivity", f"""{_RP}, e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ie WHERE src <> dst),
 tri AS (SELECT count(*) AS n FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b),
 deg AS (SELECT id, count(*) AS d FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY 1)
 SELECT (SELECT n FROM tri) AS triangles, CAST(sum(d * (d - 1) / 2) AS BIGINT) AS triples, {r('3.0 * (SELECT n FROM tri) / sum(d * (d - 1) / 2)', 'transitivity')} FROM deg""")
def transitivity(t):
    return rounded(graph.transitivity(make_internal(t)))


_PATHS = f"""{_COMP}, gc AS (SELECT id FROM comp WHERE component = (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)),
 e AS (SELECT DISTINCT src, dst FROM ie WHERE src <> dst AND src IN (SELECT id FROM gc) AND dst IN (SELECT id FROM gc)),
 bfs AS (SELECT src, dst, 1 AS d FROM e UNION SELECT bfs.src, e.dst, d + 1 FROM bfs JOIN e ON bfs.dst = e.src WHERE d < 12),
 sp AS (SELECT src, dst, min(d) AS d FROM bfs WHERE src <> dst GROUP BY 1, 2)
 SELECT count(*) AS reachable_pairs, CAST(sum(d) AS BIGINT) AS total_distance, {r('avg(d)', 'avg_path_length')}"""


@query("path_lengths", f"{_PATHS} FROM sp")
def path_lengths(t):
    edges = make_internal(t)
    return rounded(graph.path_lengths(edges, graph.giant_component(graph.components(edges))))


# the sketch's own numbers are estimates: compared is that they lie within 3 % of the exact ones
@query("path_lengths_sketch", f"{_PATHS}, true AS pairs_close, true AS length_close FROM sp")
def path_lengths_sketch(t):
    edges = make_internal(t)
    giant = graph.giant_component(graph.components(edges))
    about = graph.path_lengths_sketch(edges, giant).select(F.col("reachable_pairs").alias("p"), F.col("avg_path_length").alias("l"))
    p, length = about.select("p").scalar(), about.select("l").scalar()
    close = {
        "pairs_close": F.abs(p / F.col("reachable_pairs") - 1) < 0.03,
        "length_close": F.abs(length / F.col("avg_path_length") - 1) < 0.03,
    }
    return rounded(graph.path_lengths(edges, giant).withColumns(close))


def _cores(edges: str, name: str) -> str:
    """Core numbers by repeated h-indices: a node's number is the largest k that k of its links lead to numbers of k or more."""
    return f"""near_{name} AS (SELECT src, dst, CAST(count(*) AS BIGINT) AS m FROM (SELECT src, dst FROM {edges} WHERE src <> dst UNION ALL SELECT dst, src FROM {edges} WHERE src <> dst) GROUP BY 1, 2),
it_{name} AS (SELECT 0 AS i, src AS id, CAST(sum(m) AS BIGINT) AS core FROM near_{name} GROUP BY src
 UNION ALL SELECT i + 1, src, CAST(max(least(v, reach)) AS BIGINT) FROM (SELECT i, src, v, sum(n) OVER (PARTITION BY i, src ORDER BY v DESC) AS reach
  FROM (SELECT a.i, near_{name}.src, least(a.core, b.core) AS v, sum(m) AS n FROM near_{name} JOIN it_{name} a ON a.id = near_{name}.src JOIN it_{name} b ON b.id = near_{name}.dst WHERE a.i < 60 GROUP BY 1, 2, 3)) GROUP BY i, src),
cores_{name} AS (SELECT id, min(core) AS core FROM it_{name} GROUP BY 1)"""


@query("core_numbers", f"{_RP}, {_cores('ie', 'ie')} SELECT v.id, CAST(coalesce(core, 0) AS INTEGER) AS core FROM (SELECT src AS id FROM ie UNION SELECT dst FROM ie) v LEFT JOIN cores_ie c ON c.id = v.id")
def core_numbers(t):
    return graph.core_numbers(make_internal(t))


def _network(group: str, n: str) -> tuple[str, str]:
    """(CTEs, row) of all measures of the replies inside one group."""
    ctes = f"""e_{n} AS (SELECT DISTINCT src, dst FROM rp WHERE src IN (SELECT author_id FROM groups WHERE "group" = '{group}') AND dst IN (SELECT author_id FROM groups WHERE "group" = '{group}')),
v_{n} AS (SELECT src AS id FROM e_{n} UNION SELECT dst FROM e_{n}),
un_{n} AS (SELECT src AS a, dst AS b FROM e_{n} UNION SELECT dst, src FROM e_{n}),
rc_{n} AS (SELECT a AS id, a AS m FROM un_{n} UNION SELECT un_{n}.b, rc_{n}.m FROM rc_{n} JOIN un_{n} ON rc_{n}.id = un_{n}.a),
comp_{n} AS (SELECT id, min(m) AS component FROM rc_{n} GROUP BY 1),
sizes_{n} AS (SELECT component, count(*) AS k FROM comp_{n} GROUP BY 1),
gc_{n} AS (SELECT id FROM comp_{n} WHERE component = (SELECT component FROM sizes_{n} ORDER BY k DESC, component LIMIT 1)),
g_{n} AS (SELECT src, dst FROM e_{n} WHERE src <> dst AND src IN (SELECT id FROM gc_{n}) AND dst IN (SELECT id FROM gc_{n})),
bfs_{n} AS (SELECT src, dst, 1 AS d FROM g_{n} UNION SELECT b.src, g.dst, d + 1 FROM bfs_{n} b JOIN g_{n} g ON b.dst = g.src WHERE d < 20),
sp_{n} AS (SELECT src, dst, min(d) AS d FROM bfs_{n} WHERE src <> dst GROUP BY 1, 2),
s_{n} AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e_{n} WHERE src <> dst),
deg_{n} AS (SELECT id, count(*) AS d FROM (SELECT a AS id FROM s_{n} UNION ALL SELECT b FROM s_{n}) GROUP BY 1),
{_cores(f'e_{n}', n)}"""
    nodes, edges = f"(SELECT count(*) FROM v_{n})", f"(SELECT count(*) FROM e_{n})"
    mutual = f"(SELECT avg(CAST((SELECT count(*) FROM e_{n} f WHERE f.src = x.dst AND f.dst = x.src) AS DOUBLE)) FROM e_{n} x WHERE x.src <> x.dst)"
    triangles = f"(SELECT count(*) FROM s_{n} x JOIN s_{n} y ON x.b = y.a JOIN s_{n} z ON z.a = x.a AND z.b = y.b)"
    row = f"""SELECT '{group}' AS network, {nodes} AS n_nodes, {edges} AS n_edges, {r(f'{edges} / CAST({nodes} * ({nodes} - 1) AS DOUBLE)', 'density')}, {r(f'2.0 * {edges} / {nodes}', 'mean_degree')},
 {r(mutual, 'reciprocity')}, (SELECT max(k) FROM sizes_{n}) AS giant_size, {r(f'(SELECT max(k) FROM sizes_{n}) / CAST((SELECT sum(k) FROM sizes_{n}) AS DOUBLE)', 'giant_share')},
 {r(f'3.0 * {triangles} / (SELECT sum(d * (d - 1) / 2) FROM deg_{n})', 'transitivity')}, {r(f'(SELECT avg(d) FROM sp_{n})', 'avg_path_length')}, CAST((SELECT max(core) FROM cores_{n}) AS INTEGER) AS max_core"""
    return ctes, row


_NETS = [_network("Untrustworthy", "u"), _network("Trustworthy", "t")]
_GROUP_REPLIES = "rp AS (SELECT author_id AS src, in_reply_to_user_id AS dst FROM posts WHERE in_reply_to_user_id IS NOT NULL AND created_at >= TIMESTAMP '2024-01-02' AND created_at < TIMESTAMP '2024-01-29')"


@query("compare_networks", f"{GROUPS_SQL.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_GROUP_REPLIES}, {', '.join(c for c, _ in _NETS)} {' UNION ALL '.join(row for _, row in _NETS)}")
def compare_networks(t):
    edges, groups = make_internal(t), make_groups(t)
    parts = {}
    for g in ("Untrustworthy", "Trustworthy"):
        ids = groups.filter(F.col("group") == g).select(F.col("author_id").alias("id"))
        parts[g] = networks.induced_edges(edges, ids)
    return rounded(graph.compare_networks(parts))
