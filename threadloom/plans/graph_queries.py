"""Registered graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import graph
from threadloom.plans.registry import Registry
from threadloom.plans.relations import duck, relation, run

ROOT = "DWM.P000000001"

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.oracle_sql


def _walk(edges: str, root: str, depth: int) -> str:
    return f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {edges} t), w AS (
      SELECT {root} AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < {depth}
    ), n AS (SELECT node, min(depth) AS depth FROM w GROUP BY node)"""


@query(_walk(duck("edges_tree"), f"'{ROOT}'", 7) + " SELECT count(*) FILTER (WHERE depth = 1) AS direct, count(*) FILTER (WHERE depth >= 2) AS indirect, count(*) FILTER (WHERE depth >= 1) AS total, CAST(max(depth) AS BIGINT) AS max_depth FROM n")
def blast_radius_tree(spark, sf_dir):
    return graph.blast_radius(relation(spark, sf_dir, "edges_tree"), ROOT)


@query(_walk(duck("edges_tree"), f"'{ROOT}'", 7) + " SELECT node, CAST(depth AS INTEGER) AS depth, CAST(row_number() OVER (ORDER BY depth, node) - 1 AS INTEGER) AS rank FROM n QUALIFY rank < 60")
def bfs_nodes_capped(spark, sf_dir):
    return graph.bounded_bfs(relation(spark, sf_dir, "edges_tree"), ROOT, max_nodes=60).nodes


@query(_walk(duck("edges_tree"), f"'{ROOT}'", 5) + " SELECT e.src, e.dst FROM e WHERE e.src IN (SELECT node FROM n) AND e.dst IN (SELECT node FROM n)")
def bfs_edges_induced(spark, sf_dir):
    return graph.bounded_bfs(relation(spark, sf_dir, "edges_tree"), ROOT, max_depth=5).edges


_MIDDLE = "DWM.P000000012"


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {duck('edges_tree')} t), d AS (
      SELECT '{_MIDDLE}' AS node, 0 AS depth UNION SELECT e.dst, d.depth + 1 FROM d JOIN e ON e.src = d.node WHERE d.depth < 4
    ), u AS (SELECT '{_MIDDLE}' AS node, 0 AS depth UNION SELECT e.src, u.depth + 1 FROM u JOIN e ON e.dst = u.node WHERE u.depth < 4)
    SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT * FROM d UNION ALL SELECT * FROM u) GROUP BY node ORDER BY depth, node LIMIT 20"""
)
def bfs_both(spark, sf_dir):
    return graph.bfs_both(relation(spark, sf_dir, "edges_tree"), _MIDDLE, max_depth=4, max_nodes=20).nodes.select("node", "depth")


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {duck('edges_cycle')} t), s AS (SELECT min(o_orderkey) AS start FROM orders GROUP BY o_custkey),
    w AS (SELECT start, start AS node, 0 AS level FROM s UNION SELECT w.start, e.dst, w.level + 1 FROM w JOIN e ON e.src = w.node WHERE w.level < 60)
    SELECT start, node, CAST(min(level) AS INTEGER) AS level FROM w GROUP BY start, node"""
)
def dependents_by_level(spark, sf_dir):
    """Every customer's first job and all its dependents, without a bound of depth (no chain of the tables has 60 jobs)."""
    starts = run(spark, sf_dir, "select min(o_orderkey) as start from orders group by o_custkey")
    return graph.levels(relation(spark, sf_dir, "edges_cycle"), starts)


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {duck('edges_chain')} t),
    w AS (SELECT src, dst FROM e UNION SELECT w.src, e.dst FROM w JOIN e ON e.src = w.dst) SELECT src, count(*) AS reached FROM w GROUP BY src"""
)
def reachability_closure(spark, sf_dir):
    """Every chain."""
    return graph.closure(relation(spark, sf_dir, "edges_chain")).groupBy("src").agg(F.count(F.lit(1)).alias("reached"))


_SCC = f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {duck('edges_cycle')} t), w AS (SELECT src, dst FROM e UNION SELECT w.src, e.dst FROM w JOIN e ON e.src = w.dst),
    m AS (SELECT a.src AS node, a.dst AS other FROM w a JOIN w b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst)"""


@query(_SCC + " SELECT node, least(min(other), node) AS component, count(*) + 1 AS size FROM m GROUP BY node")
def scc_members(spark, sf_dir):
    return graph.strong_components(relation(spark, sf_dir, "edges_cycle"), "o_custkey")


@query(_SCC + " SELECT o_custkey, count(DISTINCT node) AS in_cycle FROM m JOIN orders ON o_orderkey = node GROUP BY o_custkey")
def cycle_orders(spark, sf_dir):
    members = graph.strong_components(relation(spark, sf_dir, "edges_cycle"), "o_custkey")
    orders = run(spark, sf_dir, "select o_orderkey, o_custkey from orders")
    return members.join(orders, members["node"] == orders["o_orderkey"]).groupBy("o_custkey").agg(F.countDistinct("node").alias("in_cycle"))


#: A layered graph with many paths: suppliers feed parts, parts feed temporary nodes, those feed results.
_LAYERED = """(select distinct concat('S', cast(l_suppkey % 40 as varchar(20))) as src, concat('A', cast(l_partkey % 30 as varchar(20))) as dst from lineitem
    union select distinct concat('A', cast(l_partkey % 30 as varchar(20))) as src, concat('B', cast(l_orderkey % 25 as varchar(20))) as dst from lineitem where l_linenumber <= 2
    union select distinct concat('B', cast(l_orderkey % 25 as varchar(20))) as src, concat('R', cast(l_quantity as int)) as dst from lineitem where l_returnflag = 'R'
    union select distinct concat('S', cast(l_suppkey % 40 as varchar(20))) as src, concat('R', cast(l_quantity as int)) as dst from lineitem where l_returnflag = 'A' and l_linenumber = 1)"""


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_LAYERED} t), w AS (
      SELECT src, dst AS pos, 1 AS depth, 1::BIGINT AS paths FROM e WHERE substr(src, 1, 1) NOT IN ('A', 'B')
      UNION ALL SELECT w.src, e.dst, w.depth + 1, w.paths FROM w JOIN e ON e.src = w.pos WHERE substr(w.pos, 1, 1) IN ('A', 'B'))
    SELECT src, pos AS dst, CAST(sum(paths) AS BIGINT) AS paths, CAST(min(depth) AS BIGINT) AS depth FROM w WHERE substr(pos, 1, 1) NOT IN ('A', 'B') GROUP BY src, pos"""
)
def collapse_path_counts(spark, sf_dir):
    edges = run(spark, sf_dir, f"select src, dst from {_LAYERED} t")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return graph.collapse(edges, nodes.withColumn("collapsible", F.substring("node", 1, 1).isin("A", "B")))


_KEY = "cast(substr({0}, 6) as bigint)"


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {duck('edges_tree')} t), w AS (
      SELECT src, dst AS pos, 1 AS depth FROM e WHERE {_KEY.format('src')} % 5 NOT IN (0, 1)
      UNION ALL SELECT w.src, e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.pos WHERE {_KEY.format("w.pos")} % 5 IN (0, 1))
    SELECT src, pos AS dst, CAST(min(depth) AS BIGINT) AS depth FROM w WHERE {_KEY.format("pos")} % 5 NOT IN (0, 1) GROUP BY src, pos"""
)
def collapse_business_edges(spark, sf_dir):
    edges = relation(spark, sf_dir, "edges_tree").where("src <> dst")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    kinds = nodes.withColumn("collapsible", F.expr(_KEY.format("node")).cast("long") % 5 <= 1)
    return graph.collapse(edges, kinds).select("src", "dst", "depth")


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT program, src, dst FROM {duck('program_edges')} t), r AS (SELECT program, max(dst) AS target FROM e GROUP BY program),
    up AS (SELECT program, target, target AS node FROM r UNION SELECT up.program, up.target, e.src FROM up JOIN e ON e.program = up.program AND e.dst = up.node),
    i AS (SELECT DISTINCT e.program, up.target, e.src, e.dst FROM e JOIN up ON e.program = up.program AND e.dst = up.node)
    SELECT DISTINCT program, target, src FROM i WHERE src <> target AND NOT EXISTS (SELECT 1 FROM i j WHERE j.program = i.program AND j.target = i.target AND j.dst = i.src)
    UNION SELECT DISTINCT program, target, src FROM i WHERE src = target AND dst = target"""
)
def program_boundary(spark, sf_dir):
    edges = relation(spark, sf_dir, "program_edges")
    return graph.program_boundary(edges, edges.groupBy("program").agg(F.max("dst").alias("target")))


@query(
    f"""WITH e AS (SELECT DISTINCT src, dst FROM {duck('edges_tree')} t), o AS (SELECT src AS node, count(*) AS n FROM e GROUP BY src), i AS (SELECT dst AS node, count(*) AS n FROM e GROUP BY dst)
    SELECT node, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, CASE WHEN i.n IS NULL THEN 'SOURCE_ONLY' WHEN o.n IS NULL THEN 'SINK_ONLY' ELSE 'INTERMEDIATE' END AS role FROM o FULL JOIN i USING (node)"""
)
def node_roles(spark, sf_dir):
    return graph.roles(relation(spark, sf_dir, "edges_tree"))


@query(f"WITH e AS (SELECT * FROM {duck('program_edges')} t) SELECT DISTINCT program, dst AS sink FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.program = e.program AND x.src = e.dst AND x.src <> x.dst)")
def program_sinks(spark, sf_dir):
    return graph.sinks(relation(spark, sf_dir, "program_edges"))


@query(
    f"""WITH e AS (SELECT DISTINCT src, dst FROM {duck('edges_chain')} t), k AS (SELECT o_orderkey AS node FROM orders WHERE o_orderstatus <> 'F')
    SELECT concat(CAST(src AS VARCHAR), '_RUN') AS src, concat(CAST(dst AS VARCHAR), '_RUN') AS dst FROM e WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)"""
)
def subgraph_rewrite(spark, sf_dir):
    keep = run(spark, sf_dir, "select o_orderkey as node from orders where o_orderstatus <> 'F'")
    return graph.subgraph(relation(spark, sf_dir, "edges_chain"), keep, "_RUN")


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {duck('edges_chain')} t), l AS (SELECT o_orderkey AS node, concat('T', CAST(o_custkey AS VARCHAR), '_', substr(o_orderpriority, 1, 1)) AS label FROM orders WHERE o_orderkey % 3 <> 0),
    w AS (SELECT e.src, e.dst AS pos FROM e JOIN l ON l.node = e.src UNION SELECT w.src, e.dst FROM w JOIN e ON e.src = w.pos WHERE w.pos NOT IN (SELECT node FROM l))
    SELECT DISTINCT a.label AS src, b.label AS dst FROM w JOIN l a ON a.node = w.src JOIN l b ON b.node = w.pos"""
)
def table_trace(spark, sf_dir):
    labels = run(spark, sf_dir, "select o_orderkey as node, concat('T', cast(o_custkey as string), '_', substr(o_orderpriority, 1, 1)) as label from orders where o_orderkey % 3 <> 0")
    return graph.contract(relation(spark, sf_dir, "edges_chain"), labels)


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {duck('edges_chain')} t), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
    w AS (SELECT node, 0 AS level FROM n UNION SELECT e.dst, w.level + 1 FROM w JOIN e ON e.src = w.node) SELECT node, CAST(max(level) AS INTEGER) AS level FROM w GROUP BY node"""
)
def topological_levels(spark, sf_dir):
    """every chain."""
    return graph.topological_levels(relation(spark, sf_dir, "edges_chain"))


@query()
def closure_chunks(spark, sf_dir):
    return graph.pack_closures(relation(spark, sf_dir, "edges_chain"), 500)
