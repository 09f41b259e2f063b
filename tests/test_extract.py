from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from threadloom.functions import names, sqltext
from threadloom.operators import extract


@pytest.mark.parametrize(
    "text,want",
    [("a; b", ["a", "b"]), ("x ';' ;;", ["x ';'"]), ("'it''s; one';two", ["'it''s; one'", "two"]), ('"a;b"', ['"a;b"']), ("", []), ("'open; end", ["'open; end"])],
)
def test_split_statements(text, want):
    assert extract.split_statements(text) == want


def test_comments_keep_offsets():
    text = "a -- b\nc /* d\ne */ f '--x' \"/*\" `--`"
    out = extract.strip_comments(text)
    assert len(out) == len(text) and out.count("\n") == 2
    assert "b" not in out and " e " not in out and "'--x'" in out and '"/*"' in out and "`--`" in out
    assert extract.strip_comments("a /* never closed") == "a                "


def test_blocks_and_effective_sources():
    text = "insert into t select a from x where 1 = 2 union all select b from y join (select c from z where false) q on 1 = 1 where p or 1 = 2"
    blocks = extract.query_blocks(text)
    assert [(b[1], b[2], b[3]) for b in blocks] == [(None, "X", True), (None, "Y", False), (1, "Z", True)]
    assert extract.effective_sources(blocks) == ["Y"]
    assert extract.query_blocks("select extract(day from d), trim(x from y) from real_table")[0][2] == "REAL_TABLE"
    assert extract.query_blocks("select 1 from f(x)")[0][2] == ""


def test_python_sources():
    code = 'a = "dwf.t"\nsql = "insert into " + a + f" select * from s{n}"\ndb.execute(sql)\nother = "select 1"'
    assert extract.python_sql(code) == [(0, "insert into dwf.t select * from s{}", "CALL")]
    assert extract.python_sql('q = "select 1 from t"') == [(0, "select 1 from t", "ASSIGNMENT")]
    assert extract.python_sql("def broken(:\n  x = '''select 2 from u'''") == [(0, "select 2 from u", "RECOVERED")]
    assert extract.python_sql("insert into t select 1 from u") == [(0, "insert into t select 1 from u", "RAW")]
    assert extract.python_sql("run_sql(sql='delete from {}'.replace('{}', 'x'))") == [(0, "delete from x", "CALL")]
    assert extract.python_sql("print('hello')") == []


def test_programs_nested_or_long_beyond_reason():
    deep = "run_sql(" + " + ".join(["'select 1 from t '"] * 5000) + ")"
    assert len(extract.python_sql(deep)[0][1]) > 50_000 and extract.python_sql("x = " + "-" * 30_000 + "1") == []
    assert extract.envelope("f(" * 3000 + ")" * 3000)[0][2] in ("PYTHON_PARSE_FAILED", "NO_SQL_CANDIDATE")
    nested = "insert into t (a) " + "select a from (" * 1500 + "select a from x.y" + ") q" * 1500
    assert extract.effective_sources(extract.query_blocks(nested)) == ["X.Y"] and extract.projections(nested) in ([], [("T", "A", "X.Y", "A", "RESOLVED")])


def test_formatted_texts():
    one = lambda code: [s for _, s, _ in extract.python_sql(code)]
    assert one("run_sql('select {1}.{0} from {t} where a = {{x}} and b = {u}'.format('t', 's', t='dwf.t'))") == ["select s.t from dwf.t where a = {x} and b = {}"]
    assert one("n = 3\nrun_sql(f'select {5} from t{n}')") == ["select 5 from t{}"] and one("run_sql(text('select 1 from t'))") == ["select 1 from t"]


def test_names_stand_for_their_last_binding():
    code = 'sql = "select 1 from a"\nrun_sql(sql)\nsql = "select 2 from b"\nrun_sql(sql)\nsql = make()\nrun_sql(sql)\nq = "select 3 "\nq += "from c"\nfetch_all(sql_str=q)'
    assert [s for _, s, _ in extract.python_sql(code)] == ["select 1 from a", "select 2 from b", "select 3 from c"]
    assert extract.envelope(code)[0] == ("SUCCESS", "HIGH", "CANDIDATE_FOUND", 3)
    reasons = {"": "EMPTY_SCRIPT", "run_sql()": "SQL_ARGUMENT_MISSING", "run_sql('x')": "SQL_ARGUMENT_NOT_SQL", "f(": "PYTHON_PARSE_FAILED", "go('select a from b')": "SQL_CALL_NOT_RECOGNIZED"}
    assert {k: extract.envelope(k)[0][2] for k in reasons} == reasons


def test_statement_grammar(spark):
    one = lambda x, f: _eval(spark, x, f)
    sources = ["select * from \"a b\".`c`, x join [d].[e] on 1 = 1", "select * from f(1) join s . t using (k)", "with recursive r (n) as (select 1 from base) select * from r", "select substring(a from 2 for 3) from t", "select * from lateral (select 1 from u) x", "/* from no */ select 'from no' -- from no\nfrom yes", None]
    assert one(sources, sqltext.source_tables) == [["AB.C", "D.E"], ["S.T"], ["BASE"], ["T"], ["U"], ["YES"], []]
    classes = one(["INSERT INTO LOCAL TABLE x.y SELECT 1", "create unlogged table if not exists t#1 (a int)", "create or replace temp view v as select 1", "update only a . b set c = 1", "drop table x"], sqltext.statement_class)
    assert [(c["statement_type"], c["target"], c["is_temporary"]) for c in classes] == [("INSERT_INTO", "X.Y", False), ("CREATE_TABLE", "T#1", False), ("CREATE_VIEW", "V", True), ("UPDATE", "A.B", False), ("UNKNOWN", None, False)]
    assert one(["insert into a.{x} select 1", "merge into a . {0} using b", "create foreign table if not exists %s (a int)", "insert into a select '{x}'"], sqltext.dynamic_target) == ["INSERT", "MERGE", "CREATE_FOREIGN_TABLE", None]
    odd = [r"select E'it\'s' from a where x = 'from b'", 'select "a--b" from t', "select extract(day from max(f(d))) from u", "select * from x where a in (select trim(b from c) from y) and d = 'x; -- from z'", "with a as not materialized(select 1 from b), c (k, l) as (select 2 from a) select * from c", "select " + "f(" * 3 + "a from b" + ")" * 3 + " from t", "select '" + "''" * 50_000 + r"\'" * 50_000 + "' from t"]
    assert one(odd, sqltext.source_tables) == [["A"], ["T"], ["U"], ["X", "Y"], ["B"], ["T"], ["T"]]
    assert one(["it's", "a 'b''c' \"d'e\" 'f", r"'\'' x"], sqltext.mask_literals) == ["it'", "a '' \"d'e\" '", "'' x"]
    assert one(["a" * 200_000 + " from t where x = '" + "b" * 200_000 + "'"], sqltext.source_tables) == [["T"]]


def test_columns_through_queries():
    leaf = lambda sql: [r[2:] for r in extract.projections(sql)]
    assert leaf("insert into t (a) with c as (select x.k as a from s.u x), d as (select a from c) select d.a from d") == [("S.U", "K", "RESOLVED")]
    assert leaf("with c as (select a from c) insert into t (a) select c.a from c") == [(None, "A", "UNRESOLVED")]  # its own source
    assert leaf("insert into t (a) select q.a from (select a from x union select a from y) q")[0][2] == "UNRESOLVED"
    assert leaf("insert into t (a, b) select q.n, r.m from (select distinct p.z n from s.p p) as q left join s.r r on q.n = r.n where 1 = 1") == [("S.P", "Z", "RESOLVED"), ("S.R", "M", "RESOLVED")]


def test_json_paths_and_hashes(spark):
    assert _eval(spark, ['{"b": 1, "a": [ {"d": 2, "c": null} ]}', "no json", None, "3"], names.canonical_json) == ['{"a":[{"c":null,"d":2}],"b":1}', None, None, "3"]
    a, b, c = _eval(spark, ["http://h/x/y?q=1", "/z/x/y", None], names.path_hash)
    assert a == b and c is None


def test_ddl_and_projections():
    ddl = "create temp table x.y (a int comment 'it, is', b decimal(1,2), primary key (a)); comment on column x.y.b is 'B'; alter table x.y add c int comment 'C'"
    assert extract.ddl_columns(ddl) == [("X.Y", "A", "it, is", "create"), ("X.Y", "B", None, "create"), ("X.Y", "C", "C", "alter"), ("X.Y", "B", "B", "comment")]
    assert extract.projections("insert into t (a, b) select x.k as a, sum(v) from s.u x") == [("T", "A", "S.U", "K", "RESOLVED"), ("T", "B", None, None, "UNRESOLVED")]
    assert extract.projections("insert into t (a) select k from s.u, s.v") == [("T", "A", None, "K", "AMBIGUOUS")]
    assert extract.projections("insert into t (a, b) select k from s") == []


def test_null_texts_give_no_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "select 1 from t")], "id int, script string")
    for f in (extract.statements, extract.blocks, extract.programs_sql, extract.columns_defined, extract.column_lineage):
        assert {r["id"] for r in f(rows, ["id"], "script").collect()} <= {3}


def _eval(spark, values, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string")
    return [r[1] for r in rows.select("k", f(F.col("x"))).orderBy("k").collect()]


def test_name_functions(spark):
    assert _eval(spark, [' "dwf"."t" ', "a.b.c", "t", ".t", None], names.canonical_name) == ["DWF.T", None, None, None, None]
    assert _eval(spark, ["dws_dwf.t", "DLK_DLO.x", "DWF.t", "other.t"], names.comparison_name) == ["DWF.T", "DLO.X", "DWF.T", "OTHER.T"]
    assert _eval(spark, ["DLO.x", "DWF.x", "x", None], names.is_technical) == [True, False, False, False]
    parsed = _eval(spark, ["005:dws_dwf.t:3:x", "005:dwf.t:3", "004:dwf.t:3", "005:t:3", "", "x", None], names.parse_program_name)
    got = [(p["target"], p["hint"], p["step"]) for p in parsed]
    assert got == [("DWF.T", "DWF.T", 3), (None, "DWF.T", None), *[(None, None, None)] * 2, (None, None, None), (None, None, None), (None, None, None)]
    assert "PROGRAM_NAME_STEP_MISSING" in parsed[1]["diagnostics"] and parsed[3]["diagnostics"][0] == "PROGRAM_NAME_TARGET_INVALID" and parsed[2]["diagnostics"] == ["PROGRAM_NAME_MARKER_INVALID", "PROGRAM_NAME_TARGET_INVALID"]
    assert _eval(spark, ["8:05", "23:59:59", "8:61", "x", None], names.schedule_seconds) == [29100, 86399, None, None, None]
    assert _eval(spark, ["DWS_T", "T"], lambda x: F.array_join(names.table_aliases(x), ",")) == ["DWS_T,T", "T,DWS_T"]
    assert _eval(spark, [r"C:\a\b\c.py", "/x/y/", ""], lambda x: names.last_components(x, 2)) == ["b/c.py", "x/y", ""]
    plans = ["PLAN_SA_RECV_N_S_SRC_A_DAY", "PLAN_SA_RECV_SRC_A", "PLAN_SA_RECV_X_SRC_A_Y_SRC_A", "OTHER_N_SRC_A", "PLAN_SA_RECV_N__SRC_A"]
    assert _eval(spark, plans, lambda x: names.receive_namespace(x, F.lit("src_a"))) == ["N_S", None, None, None, None]
    assert _eval(spark, ["DWF.F_X", "dwf_x", "X"], names.logical_target) == ["X", "X", "X"]
    assert _eval(spark, ["/a/005_JOB_x_DAY.py", "JOB_DWS_DWS_T_NIGHT"], names.program_file_name) == ["X", "DWS_T"]


def test_text_functions(spark):
    assert _eval(spark, ["1 = 2", "false", "x = 1 and 3=4", "1 = 2 or x", "1 between 2 and 3", "1 = 1.0", None, "TRUE = FALSE", "(not true)", "true <> true", "1 = true", "(x = 1 and 2 <> 2.0)", "x in (select 1 from t where y and 1 = 2)", "not (1 = 2)"], sqltext.is_statically_false) == [True, True, True, False, False, False, False, True, True, True, False, True, False, False]
    guarded = {"select 1": True, "select 1; drop table t": False, "update t set a = 1": False, " show tables;": True, "with d as (delete from t returning *) select * from d": False, "with x as (select 1) delete from t": False, "select ';' -- ;\n ; ": True, 'select "a;b"': True, "explain select 1": True, "explain analyze delete from t": False, "select a into t from u": False, "": False}
    assert _eval(spark, [*guarded], sqltext.is_read_only) == [*guarded.values()]
    assert _eval(spark, ["insert into {t} select 1", "insert into dwf.t select 1", "merge into dwf.{x} using y"], sqltext.has_dynamic_target) == [True, False, True]
    assert _eval(spark, ["create table t (a int) DISTRIBUTE BY HASH(a, b)", "x"], sqltext.distribution_key) == ["a, b", None]
    assert _eval(spark, ["-outfile:1:outfile=X.dat:0", "y"], lambda x: sqltext.job_parameter(x, "outfile")) == ["X.dat", None]
