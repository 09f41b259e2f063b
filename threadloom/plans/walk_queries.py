"""Registered queries of cycle lists, column chains, stars and traces; their graphs grow with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions.tables import store
from threadloom.operators import audit, columns, cycles, graph, traces
from threadloom.plans.registry import Registry
from threadloom.plans.relations import duck, relation, run

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.oracle_sql

# -- cycles as lists: elementary cycles begun at their least node, the first 20 of a component by length and nodes


def _cycles(edges: str, component: str, longest: int) -> str:
    """All cycles of at most `longest` nodes; enough where a component has more than 20 of those, or no longer ones."""
    return f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {edges} t), w AS (
      SELECT src AS start, dst AS node, [src] AS path FROM e WHERE dst >= src
      UNION ALL SELECT w.start, e.dst, list_append(w.path, w.node) FROM w JOIN e ON e.src = w.node
      WHERE w.node <> w.start AND e.dst >= w.start AND len(w.path) < {longest} AND e.dst <> w.node AND NOT list_contains(list_slice(w.path, 2, len(w.path)), e.dst)),
    reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst),
    part AS (SELECT a.src AS node, least(min(a.dst), a.src) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src),
    c AS (SELECT {component} AS component, path, row_number() OVER (PARTITION BY {component} ORDER BY len(path), path) AS place, count(*) OVER (PARTITION BY {component}) > 20 AS more
      FROM w JOIN part ON part.node = w.start WHERE w.node = w.start)
    SELECT component, CAST(place AS INTEGER) AS place, array_to_string(path, '>') AS cycle, more FROM c WHERE place <= 20"""


def _shown(lists):
    return lists.select("component", "place", F.array_join(F.transform("cycle", lambda n: n.cast("string")), ">").alias("cycle"), "more")


@query(_cycles(duck("edges_cycle"), "component", 99))
def cycle_lists(spark, sf_dir):
    """Every ring of orders."""
    return _shown(cycles.cycle_lists(relation(spark, sf_dir, "edges_cycle"), near="o_custkey"))


_DENSE = f"(SELECT concat(program, '.', src) AS src, concat(program, '.', dst) AS dst FROM {duck('program_edges')} p)"


@query(_cycles(_DENSE, "component", 4))
def cycle_lists_dense(spark, sf_dir):
    """Programs with very many cycles, self edges among them; each component tells that it has more than 20."""
    edges = relation(spark, sf_dir, "program_edges").select(F.concat_ws(".", "program", "src").alias("src"), F.concat_ws(".", "program", "dst").alias("dst"), "program")
    return _shown(cycles.cycle_lists(edges, near="program"))


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {duck('edges_cycle')} t), w AS (SELECT src, dst FROM e UNION SELECT w.src, e.dst FROM w JOIN e ON e.src = w.dst),
    m AS (SELECT DISTINCT a.src AS node, a.dst AS other FROM w a JOIN w b ON a.src = b.dst AND a.dst = b.src),
    s AS (SELECT node, string_agg(concat('"J', other, '"'), ',' ORDER BY concat('J', other)) AS nodes FROM m GROUP BY node)
    SELECT concat('J', node) AS node, 'CYCLE_DETECTED' AS issue_type, sha256(concat('{{"cycle_nodes":[', nodes, '],"environment":"PROD","issue_type":"CYCLE_DETECTED","program_name":"P","scope":"cycle","source_profile":"S"}}')) AS issue_key FROM s
    UNION ALL SELECT concat('J', src), 'ORPHAN_BRANCH', sha256(concat('{{"branch_sink":"J', src, '","environment":"PROD","issue_type":"ORPHAN_BRANCH","program_name":"P","scope":"branch","source_profile":"S"}}')) FROM e WHERE src % 5 = 0
    UNION ALL SELECT concat('J', src), 'SELF_REFERENCE', sha256(concat('{{"environment":"PROD","issue_type":"SELF_REFERENCE","node_key":"J', src, '","program_name":"P","scope":"node","source_profile":"S"}}')) FROM e WHERE src % 5 = 1
    UNION ALL SELECT concat('J', src), 'MULTI_SINK_CANDIDATE', sha256('{{"environment":"PROD","issue_type":"MULTI_SINK_CANDIDATE","program_name":"P","scope":"program","source_profile":"S"}}') FROM e WHERE src % 5 = 2"""
)
def issue_keys(spark, sf_dir):
    """Every node of a cycle finds the same key, each other issue the key of its own scope."""
    edges = relation(spark, sf_dir, "edges_cycle").select("src", "dst").distinct()
    name = lambda c: F.concat(F.lit("J"), F.col(c).cast("string"))
    members = graph.strong_components(relation(spark, sf_dir, "edges_cycle"), "o_custkey")
    sets = members.groupBy("component").agg(F.collect_set(name("node")).alias("nodes"))
    found = members.join(sets, "component").select(name("node").alias("node"), F.lit("CYCLE_DETECTED").alias("issue_type"), F.shuffle("nodes").alias("nodes"))
    kinds = F.element_at(F.array(F.lit("ORPHAN_BRANCH"), F.lit("SELF_REFERENCE"), F.lit("MULTI_SINK_CANDIDATE")), (F.col("src") % 5 + 1).cast("int"))
    others = edges.where("src % 5 < 3").select(name("src").alias("node"), kinds.alias("issue_type"), F.lit(None).cast("array<string>").alias("nodes"))
    key = audit.issue_key(F.lit("PROD"), F.lit("S"), F.lit("P"), F.col("issue_type"), node=F.col("node"), branch=F.col("node"), cycle=F.col("nodes"))
    return found.unionByName(others).select("node", "issue_type", key.alias("issue_key"))


# -- columns across statements: chains of a customer's orders, rings of some, ambiguous and missing ones among them

_DEFINED = """select 'G' as program, concat('T', cast(dst as varchar(20))) as tab, 'K' as col, concat('T', cast(src as varchar(20))) as stab, 'K' as scol, case when o_custkey % 11 = 3 and dst % 2 = 0 then 'AMBIGUOUS' else 'RESOLVED' end as state from {0}
    union all select concat('H', cast(dst % 3 as varchar(20))), concat('T', cast(dst as varchar(20))), 'V', concat('T', cast(src as varchar(20))), case when dst % 2 = 0 then 'V' else 'K' end, 'RESOLVED' from {0}
    union all select 'G', concat('T', cast(dst as varchar(20))), 'V', concat('DWO.D', cast(dst % 9 as varchar(20))), 'X', 'RESOLVED' from {0} where dst % 3 = 0
    union all select 'F', concat('T', cast(o_orderkey as varchar(20))), c, concat('DWO.C', cast(o_custkey as varchar(20))), c, 'RESOLVED' from (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders) x, (select 'K' as c union all select 'V') y where n = 1 and o_custkey % 7 <> 0 and o_custkey % 5 <> 2"""


@query(
    f"""WITH RECURSIVE x AS ({_DEFINED.format('(' + duck("edges_cycle") + ') q')}), d AS (SELECT DISTINCT * FROM x), r AS (
      SELECT tab, col, stab, scol, program, state FROM d UNION SELECT r.tab, r.col, d.stab, d.scol, d.program, d.state FROM r JOIN d ON d.tab = r.stab AND d.col = r.scol WHERE r.state = 'RESOLVED'),
    loop AS (SELECT DISTINCT tab, col FROM r WHERE tab = stab AND col = scol AND state = 'RESOLVED'),
    k AS (SELECT r.tab, r.col, r.stab, r.scol, r.program, CASE WHEN (r.stab, r.scol) IN (SELECT (tab, col) FROM loop) OR (r.tab, r.col) IN (SELECT (tab, col) FROM loop) THEN 0 WHEN r.state = 'AMBIGUOUS' THEN 1
      WHEN r.stab LIKE 'T%' AND (r.stab, r.scol) NOT IN (SELECT (tab, col) FROM d) THEN 3 END AS bad, r.stab NOT LIKE 'T%' AS leaf FROM r),
    s AS (SELECT tab, col, min(bad) AS bad FROM k GROUP BY tab, col)
    SELECT s.tab AS "table", s.col AS "column", ['CYCLE', 'AMBIGUOUS', 'UNRESOLVED', 'MISSING'][s.bad + 1] AS state, NULL AS source_table, NULL AS source_column, NULL AS program FROM s WHERE bad IS NOT NULL
    UNION ALL SELECT DISTINCT k.tab, k.col, 'RESOLVED', k.stab, k.scol, k.program FROM k JOIN s ON s.tab = k.tab AND s.col = k.col WHERE s.bad IS NULL AND leaf"""
)
def producer_chains(spark, sf_dir):
    """N2."""
    store(relation(spark, sf_dir, "edges_cycle"), "chain").createOrReplaceTempView("threadloom_chain")
    owned = _DEFINED.replace(" from {0}", ", o_custkey as owner from {0}").replace(" from (select o_orderkey,", ", o_custkey from (select o_orderkey,")
    defined = run(spark, sf_dir, owned.format("threadloom_chain")).toDF("program", "table", "column", "source_table", "source_column", "state", "owner")
    return columns.producer_chains(defined, lambda t: t.startswith("T"), "owner")


_RELATIONS = "select l_orderkey as query, place, concat('a', cast(place as varchar(9))) as alias, concat('t', cast(l_partkey % 50 as varchar(9))) as tab, l_returnflag = 'R' as merges from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) as place from lineitem) x"
_METADATA = "select distinct concat('T', cast(p_partkey % 50 as varchar(9))) as tab, p_size as position, concat('c', cast(p_size as varchar(9))) as col from part where p_size <= 4 and p_partkey % 50 % 13 <> 0 union select distinct concat('T', cast(p_partkey % 50 as varchar(9))), 0, 'k' from part where p_partkey % 50 % 13 <> 0"


@query(
    f"""WITH r AS (SELECT query, place, upper(alias) AS alias, upper(tab) AS tab, merges AND place > 1 AS merges FROM ({_RELATIONS})), m AS (SELECT tab, position, upper(col) AS col FROM ({_METADATA})),
    q AS (SELECT r.query, bool_or(r.tab NOT IN (SELECT tab FROM m)) AS unknown, max(CASE WHEN merges THEN place END) AS last FROM r GROUP BY r.query),
    f AS (SELECT r.query, bool_or(r.merges AND r.place > 2 AND NOT p.merges AND p.place > 1) AS late FROM r JOIN r p ON p.query = r.query AND p.place = r.place - 1 GROUP BY r.query),
    k AS (SELECT r.query, r.place, r.merges, m.tab IS NOT NULL AS has, coalesce(sum((m.tab IS NOT NULL)::INT - r.merges::INT) OVER (PARTITION BY r.query ORDER BY r.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS visible
      FROM r LEFT JOIN (SELECT DISTINCT tab FROM m) m ON m.tab = r.tab),
    z AS (SELECT query, max(CASE WHEN merges AND (NOT has OR visible < 1) THEN 2 WHEN merges AND visible > 1 THEN 1 ELSE 0 END) AS fault FROM k GROUP BY query),
    g AS (SELECT q.*, z.fault, CASE WHEN unknown OR fault = 2 THEN 'UNRESOLVED' WHEN fault = 1 THEN 'AMBIGUOUS' END AS verdict FROM q JOIN z USING (query)),
    c AS (SELECT r.query, r.place, r.tab, m.position, m.col, g.last, g.verdict, (m.col = 'K' AND r.place <= g.last) AS merged FROM r JOIN m ON m.tab = r.tab JOIN g ON g.query = r.query),
    a AS (SELECT query, 1 AS ordinal, CASE WHEN merged THEN 0 ELSE 1 END AS x, CASE WHEN merged THEN 0 ELSE place END AS y, CASE WHEN merged THEN 0 ELSE position END AS z, col AS name, tab AS "table", col AS "column", 'RESOLVED' AS state FROM c WHERE verdict IS NULL
      UNION ALL SELECT query, 1, 0, 0, 0, 'STAR_1', NULL, NULL, verdict FROM g WHERE verdict IS NOT NULL
      UNION ALL SELECT r.query, 2, 1, r.place, coalesce(m.position, 0), coalesce(m.col, 'STAR_2'), CASE WHEN m.col IS NOT NULL THEN r.tab END, m.col, CASE WHEN m.col IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END FROM r LEFT JOIN m ON m.tab = r.tab WHERE r.place = 2
      UNION ALL SELECT query, 2, 1, 0, 0, 'STAR_2', NULL, NULL, 'UNRESOLVED' FROM g WHERE query NOT IN (SELECT query FROM r WHERE place = 2))
    SELECT DISTINCT query, CAST(dense_rank() OVER (PARTITION BY query ORDER BY ordinal, x, y, z) AS INTEGER) AS position, name, "table", "column", state FROM a"""
)
def expanded_stars(spark, sf_dir):
    """Of each order's lines as relations, `select *, a2.*`."""
    rel = run(spark, sf_dir, _RELATIONS).withColumn("using", F.when(F.col("merges"), F.array(F.lit("K"))).otherwise(F.array().cast("array<string>"))).withColumnRenamed("tab", "table").drop("merges")
    stars = [(F.lit(1), F.lit(None).cast("string")), (F.lit(2), F.lit("A2"))]
    items = rel.select("query").distinct().select("query", F.explode(F.array(*[F.struct(o.alias("ordinal"), q.alias("qualifier")) for o, q in stars])).alias("s")).select("query", "s.*", F.lit("*").alias("column"), F.lit(None).cast("string").alias("alias"))
    return columns.expand_stars(items, rel, run(spark, sf_dir, _METADATA).toDF("table", "position", "column"))


# -- traces: each customer's last order is a root; its chain of orders leads upstream

_TABLE = "concat(case when o_orderpriority like '1%' then 'DWF.T' else 'DWM.T' end, cast(o_orderkey as varchar(20)))"
_OUTPUTS = f"select concat('J', cast(o_orderkey as varchar(20))) as job, {_TABLE} as tab from orders where o_orderstatus <> 'P'"
_NEEDS = "select concat('J', cast(dst as varchar(20))) as job, concat('J', cast(src as varchar(20))) as dependency from {0} union all select concat('J', cast(min_key as varchar(20))), concat('X', cast(o_custkey as varchar(20))) from (select o_custkey, min(o_orderkey) as min_key from orders where o_custkey % 5 = 0 group by o_custkey) f"
_ROOTS = f"select {_TABLE} as root, concat('J', cast(o_orderkey as varchar(20))) as rjob from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) x where n = 1 and o_orderstatus <> 'P'"
_JOB_WALK = f"""WITH RECURSIVE o AS ({_OUTPUTS}), j AS (SELECT concat('J', o_orderkey) AS job, o.tab FROM orders LEFT JOIN o ON o.job = concat('J', o_orderkey)),
    d AS (SELECT DISTINCT * FROM ({_NEEDS.format('(' + duck("edges_cycle") + ') q')}) y), r AS ({_ROOTS}), w AS (
      SELECT root, rjob, rjob AS job, root AS tab, 0 AS depth, 0 AS step FROM r
      UNION SELECT w.root, w.rjob, d.dependency, coalesce(j.tab, w.tab), w.depth + (j.tab IS NOT NULL)::INT, w.step + 1 FROM w JOIN d ON d.job = w.job JOIN j ON j.job = d.dependency WHERE w.step < 6 AND w.tab NOT LIKE 'DWF.%' AND d.dependency <> w.rjob),
    n AS (SELECT w.*, d.dependency, d.dependency IN (SELECT job FROM j) AS known FROM w JOIN d ON d.job = w.job WHERE w.tab NOT LIKE 'DWF.%')"""


def _jobs(spark, sf_dir):
    relation(spark, sf_dir, "edges_cycle").createOrReplaceTempView("threadloom_chain")
    jobs = run(spark, sf_dir, "select concat('J', cast(o_orderkey as string)) as job from orders")
    outputs = run(spark, sf_dir, _OUTPUTS).withColumnRenamed("tab", "table")
    return traces.trace_jobs(jobs, run(spark, sf_dir, _NEEDS.format("threadloom_chain")), outputs, run(spark, sf_dir, _ROOTS).select("root"), lambda t: t.startswith("DWF."), max_depth=6)


@query(_JOB_WALK + ' SELECT root, tab AS "table", CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY root, tab')
def job_trace_tables(spark, sf_dir):
    """J22."""
    return _jobs(spark, sf_dir).tables


@query(
    _JOB_WALK
    + """ SELECT DISTINCT root, 'STOP' AS "end", tab AS name FROM w WHERE tab LIKE 'DWF.%' UNION SELECT root, 'MISSING', dependency FROM n WHERE step < 6 AND NOT known UNION SELECT root, 'CYCLE', dependency FROM n WHERE step < 6 AND dependency = rjob
    UNION SELECT root, 'UNMAPPED', w.job FROM w JOIN j ON j.job = w.job WHERE j.tab IS NULL UNION SELECT root, 'DEPTH', tab FROM n WHERE step = 6
    UNION SELECT root, 'NATURAL', tab FROM w WHERE tab NOT LIKE 'DWF.%' AND job NOT IN (SELECT job FROM d)"""
)
def job_trace_ends(spark, sf_dir):
    """How each branch ends."""
    return _jobs(spark, sf_dir).ends


_SCRIPTS = """select concat('G', cast(p_partkey as varchar(20))) as program, concat('dwm.p', cast(p_partkey as varchar(20))) as target, p_size, concat('insert into dwm.p', cast(p_partkey as varchar(20)), ' select ''from dwm.lie'' from ', case when cast(floor(p_partkey / 2) as bigint) % 5 = 0 then 'DWF' else 'dwm' end,
    '.p', cast(cast(floor(p_partkey / 2) as bigint) as varchar(20)), ' a', case when p_partkey % 3 = 0 then concat(' join dwd.seed', cast(p_partkey % 10 as varchar(20)), ' b on 1 = 1') else '' end, ' -- from dwm.hidden') as script from part where p_partkey >= 1"""
_TEXT_WALK = f"""WITH RECURSIVE s AS (SELECT p_partkey AS k, CAST(floor(p_partkey / 2) AS BIGINT) AS p FROM part WHERE p_partkey >= 1), f AS (
      SELECT k, p, concat(CASE WHEN p % 5 = 0 THEN 'DWF' ELSE 'DWM' END, '.P', p) AS tab FROM s UNION ALL SELECT k, NULL, concat('DWD.SEED', k % 10) FROM s WHERE k % 3 = 0), w AS (
      SELECT concat('G', k) AS root, p, tab, 1 AS depth FROM f WHERE k IN (SELECT p_partkey FROM part WHERE p_size = 50)
      UNION SELECT w.root, f.p, f.tab, w.depth + 1 FROM w JOIN f ON f.k = w.p WHERE w.tab LIKE 'DWM.%')"""


def _programs(spark, sf_dir):
    rows = run(spark, sf_dir, _SCRIPTS)
    return traces.trace_programs(rows.select("program", "target", "script"), rows.where("p_size = 50"), lambda t: t.startswith("DWF."))


@query(_TEXT_WALK + ' SELECT root, tab AS "table", CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY root, tab')
def text_trace_tables(spark, sf_dir):
    """J23 by SQL text."""
    return _programs(spark, sf_dir).tables


@query(_TEXT_WALK + """ SELECT DISTINCT root, CASE WHEN tab LIKE 'DWF.%' THEN 'STOP' ELSE 'NATURAL' END AS "end", tab AS name FROM w WHERE tab NOT LIKE 'DWM.%'""")
def text_trace_ends(spark, sf_dir):
    """J23 by SQL text: how each branch ends."""
    return _programs(spark, sf_dir).ends


_SCHEDULE_WALK = f"""WITH RECURSIVE t AS (SELECT o_orderkey AS k, {_TABLE} AS tab FROM orders), e AS (SELECT DISTINCT a.tab AS src, b.tab AS dst FROM {duck('edges_cycle')} q JOIN t a ON a.k = q.src JOIN t b ON b.k = q.dst), r AS ({_ROOTS}), w AS (
      SELECT root, root AS tab, 0 AS depth FROM r UNION SELECT w.root, e.src, w.depth + 1 FROM w JOIN e ON e.dst = w.tab WHERE (w.depth = 0 OR w.tab NOT LIKE 'DWF.%') AND w.depth < 10 AND e.src <> w.root)"""


@query(
    _SCHEDULE_WALK
    + """ SELECT DISTINCT root, 'STOP' AS "end", tab AS name FROM w WHERE depth > 0 AND tab LIKE 'DWF.%' UNION SELECT root, 'CYCLE', root FROM w JOIN e ON e.dst = w.tab AND e.src = w.root WHERE (depth = 0 OR tab NOT LIKE 'DWF.%') AND depth < 10
    UNION SELECT root, 'DEPTH', tab FROM w JOIN e ON e.dst = w.tab WHERE depth = 10 AND tab NOT LIKE 'DWF.%' UNION SELECT root, 'NATURAL', tab FROM w WHERE (depth = 0 OR tab NOT LIKE 'DWF.%') AND tab NOT IN (SELECT dst FROM e)"""
)
def schedule_trace_ends(spark, sf_dir):
    """J23 over a schedule map."""
    names = run(spark, sf_dir, f"select o_orderkey as k, {_TABLE} as tab, o_orderpriority from orders").select("k", "tab")
    edges = relation(spark, sf_dir, "edges_cycle").join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    roots = run(spark, sf_dir, _ROOTS).select("root")
    return traces.trace_schedule(edges, roots, lambda t: t.startswith("DWF."), max_depth=10).ends


# -- the layered graph: a program for each order reads the order before and a supplier's table

_K = "cast({0} as varchar(20))"
_READS = f"""select concat('G', {_K.format('dst')}) as program, concat('DWM.T', {_K.format('src')}) as source from {{0}} union all select concat('G', {_K.format('l_orderkey')}), concat('DWF.S', {_K.format('l_suppkey')}) from lineitem where l_linenumber = 1
    union all select concat('G', {_K.format('o_orderkey')}), concat('DWM.T', {_K.format('o_orderkey')}) from orders where o_orderkey % 4 = 0"""
_KNOWN = f"select concat('DWM.T', {_K.format('o_orderkey')}) as tab from orders where o_orderstatus <> 'P' union select concat('DWF.S', {_K.format('l_suppkey')}) from lineitem"
_TIMES = f"select concat('DWM.T', {_K.format('o_orderkey')}) as tab, o_orderkey * 37 % 86400 as seconds from orders where o_orderkey % 3 <> 0 union all select concat('DWF.S', {_K.format('s_suppkey')}), s_suppkey * 61 % 86400 from supplier where s_suppkey % 2 = 0"
_LAST = "select max_by(o_orderkey, struct(o_orderdate, o_orderkey)) as k from orders group by o_custkey"
_LAYERS = f"""WITH RECURSIVE rd AS (SELECT DISTINCT * FROM ({_READS.format('(' + duck("edges_cycle") + ') q')}) x), kn AS ({_KNOWN}), pr AS (SELECT concat('G', o_orderkey) AS program, concat('DWM.T', o_orderkey) AS target FROM orders),
    kp AS (SELECT pr.program, target, source FROM pr JOIN rd USING (program) WHERE source <> target AND source IN (SELECT tab FROM kn)),
    sh AS (SELECT * FROM pr WHERE program IN (SELECT program FROM kp) OR program NOT IN (SELECT program FROM rd)),
    rt AS (SELECT concat('DWM.T', arg_max(o_orderkey, (o_orderdate, o_orderkey))) AS root FROM orders GROUP BY o_custkey),
    w AS (SELECT root, program, target, 0 AS d FROM rt JOIN sh ON sh.target = rt.root
      UNION SELECT w.root, sh.program, sh.target, w.d + 1 FROM w JOIN kp ON kp.program = w.program JOIN sh ON sh.target = kp.source WHERE w.d < 4 AND sh.target <> w.root AND kp.source NOT LIKE 'DWF.%'),
    p AS (SELECT root, program, target, min(d) AS d FROM w GROUP BY ALL),
    ti AS (SELECT tab, min(seconds) AS seconds FROM ({_TIMES}) GROUP BY tab),
    f AS (SELECT p.root, kp.source AS tab, min(p.d) * 2 + 2 AS level, min(ti.seconds) AS later FROM p JOIN kp ON kp.program = p.program LEFT JOIN ti ON ti.tab = p.target GROUP BY p.root, kp.source),
    t AS (SELECT root, root AS node, 0 AS level, NULL::BIGINT AS later FROM rt UNION ALL SELECT root, tab, level, later FROM f WHERE tab <> root),
    n AS (SELECT t.root, CASE WHEN level = 0 THEN 'root_table' WHEN (t.root, t.node) IN (SELECT (root, target) FROM p) THEN 'table' ELSE 'source_table' END AS kind, t.node, level, ti.seconds AS own, later FROM t LEFT JOIN ti ON ti.tab = t.node
      UNION ALL SELECT p.root, 'process', p.program, 2 * d + 1, ti.seconds, NULL FROM p LEFT JOIN ti ON ti.tab = p.target),
    s AS (SELECT root, kind, node, level, CASE WHEN kind = 'source_table' THEN coalesce(own, later) ELSE own END AS seconds FROM n),
    a AS (SELECT root, node, row_number() OVER (PARTITION BY root ORDER BY seconds DESC, node) AS alert FROM s WHERE kind <> 'process' AND seconds IS NOT NULL AND node LIKE 'DWF.%')
    SELECT s.root, s.kind, s.node, CAST(level AS INTEGER) AS level, CAST(row_number() OVER (PARTITION BY s.root, level ORDER BY seconds NULLS LAST, list_position(['root_table', 'process', 'table', 'source_table'], kind), s.node) AS INTEGER) AS place, seconds,
      CASE WHEN alert <= 3 THEN CAST(alert AS INTEGER) END AS alert FROM s LEFT JOIN a ON a.root = s.root AND a.node = s.node"""


@query(_LAYERS)
def layered_graph(spark, sf_dir):
    """Levels, order and alerts of each customer's last order."""
    relation(spark, sf_dir, "edges_cycle").createOrReplaceTempView("threadloom_chain")
    programs = run(spark, sf_dir, f"select concat('G', {_K.format('o_orderkey')}) as program, concat('DWM.T', {_K.format('o_orderkey')}) as target from orders")
    roots = run(spark, sf_dir, _LAST).select(F.concat(F.lit("DWM.T"), F.col("k").cast("string")).alias("root"))
    table = lambda df: df.withColumnRenamed("tab", "table")
    nodes, _ = traces.layered_graph(programs, run(spark, sf_dir, _READS.format("threadloom_chain")), roots, table(run(spark, sf_dir, _KNOWN)), table(run(spark, sf_dir, _TIMES)), lambda t: t.startswith("DWF."), max_depth=4)
    return nodes
