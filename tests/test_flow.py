"""The flow language end to end, with expected rows."""

import gzip
import json

import pytest

from sluice import Engine, FlowError, FlowNameError, FlowSyntaxError, FlowTestFailure
from sluice.plans import ast as A
from sluice.plans.parser import parse, parse_expr

PEOPLE = [{"id": 1, "name": "ann", "age": 10}, {"id": 2, "name": "ben", "age": 24}, {"id": 3, "name": "cat", "age": 40}]
NOVELS = [
    {"id": "1", "title": "Dawn", "author": "Ode", "year": 1951}, {"id": "2", "title": "Dusk", "author": "Ode", "year": 1960},
    {"id": "3", "title": "Noon", "author": "Pim", "year": 1951}, {"id": "4", "title": "Dawn", "author": "Ode", "year": 1951},
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("flow")
    (d / "people.json").write_text(json.dumps(PEOPLE))
    (d / "novels.json").write_text("\n".join(map(json.dumps, NOVELS)))
    with gzip.open(d / "people2.json.gz", "wt") as f:
        json.dump(PEOPLE[2:] + [{"id": 4, "name": "dan", "age": 5}], f)
    (d / "pay.csv").write_text("id,name,pay\n1,ann,50000\n2,ben,\n")
    (d / "adults.wv").write_text("from 'people.json'\nwhere age >= 18\n")
    (d / "lib.wv").write_text("package shared\nmodel old(n: int = 30) = { from 'people.json' where age > n }\ndef double_it(x: int): int = x * 2\n")
    return d


@pytest.fixture
def engine(spark, folder):
    return Engine(spark, base_dir=str(folder))


def rows(df):
    from sluice.printer import plain

    return [plain(list(r)) for r in df.collect()]


OK = [
    "from 'people.json' test _.size should be 3 test _.columns = ['id', 'name', 'age'] test _.json should contain '{\"id\":1,\"name\":\"ann\",\"age\":10}' test _.json should not contain 'zed'",
    "from 'people2.json.gz' test _.rows = [[3, 'cat', 40], [4, 'dan', 5]]",
    "from 'pay.csv' test _.rows = [[1, 'ann', 50000], [2, 'ben', null]]",
    "from 'adults.wv' select name test _.rows = [['ben'], ['cat']]",
    "from 'people.json' add age_group = (age / 5).to_int * 5 exclude name, age test _.columns should be ['id', 'age_group']",
    "from 'people.json' where id = 1 group by age select age test _.rows should be [[10]]",
    "from 'people.json' group by id count test _.rows = [[3]]",
    "from 'people.json' select 1, | count test _.rows = [[3]]",
    "from 'people.json' select _.count test _.rows = [[3]]",
    "from 'people.json' select id, age group by age / 10 as tens test _.columns = ['tens', 'arbitrary(id)', 'arbitrary(age)']",
    "from 'people.json' limit 2 count test _.rows = [[2]]",
    "from 'novels.json' group by author where _.count >= 2 select author test _.rows = [['Ode']]",
    "from 'novels.json' group by author agg title.max_by(year).trim as latest order by author test _.rows = [['Ode', 'Dusk'], ['Pim', 'Noon']]",
    "from 'novels.json' pivot on year in (1951, 1960) group by author agg _.count order by `1951` desc test _.rows = [['Ode', 2, 1], ['Pim', 1, 0]]",
    "from 'novels.json' pivot on year group by author agg id.max as m order by author test _.columns = ['author', '1951', '1960']",
    "from 'novels.json' describe where column_type like 'long' test _.rows = [['year', 'long']]",
    "select 1 as id exclude id describe test _.size should be 0",
    "from [[1, [10, 20]], [2, []]] as t(id, arr) select id, arr[1] as a, arr.size as n order by id test _.rows = [[1, 10, 2], [2, null, 0]]",
    "from [['s1', [1, 2]], ['s2', [3]]] as tests(student, scores) cross join unnest(scores) as u(score) select student, score order by score test _.rows = [['s1', 1], ['s1', 2], ['s2', 3]]",
    "from [[1, 'a'], [1, 'b'], [2, null]] as t(id, v) group by id agg v.to_array as arr order by id test _.rows = [[1, ['a', 'b']], [2, [null]]]",
    "from [[1, 2], [1, 2], [3, 4]] dedup order by 1 test _.rows = [[1, 2], [3, 4]]",
    "from [[1, 2]] concat { from [[1, 2], [3, 4]] } dedup order by 1 test _.rows = [[1, 2], [3, 4]]",
    "from [[10, 20]] as s(`2024-01`, `2024-02`) exclude `2024-01` test _.rows = [[20]]",
    "from 'people.json' rename name as full_name rename id as pid test _.columns = ['pid', 'full_name', 'age']",
    "from 'people.json' shift to right id test _.columns = ['name', 'age', 'id']",
    "from 'people.json' prepend 1 as i, 'a' as v, test _.columns = ['i', 'v', 'id', 'name', 'age']",
    "select 1::int as a, \"42\"::int as b, (1 + 2)::int as c, null::int as d test _.rows should be [[1, 42, 3, null]]",
    "select null.to_int as a, null.to_string as b, null.to_date as c test _.rows should be [[null, null, null]]",
    "select ceiling(17.4).to_string as s, ceiling(17.4).to_int as i test _.rows = [['18', 18]]",
    "select 1.234.round(1) test _.rows is [[1.2]]",
    "select 0.123.to_double.round(1).to_string test _.rows is [['0.1']]",
    "select list_transform([1, 2], x -> list_reduce([4, 5], (a, b) -> a + b) + x) as arr test _.rows = [[[10, 11]]]",
    "select regexp_replace('re_01', '[_-]\\d+', '') test _.rows = [['re']]",
    "select s\"a${1 + 2}b\" as t, 'it''s' as q test _.rows = [['a3b', 'it''s']]",
    "select map {'a': 1}['a'] as x, {k: 'v'}.k as y, {k: 'v'}['k'] as z test _.rows = [[1, 'v', 'v']]",
    "select 2 + 3 * 4 - 1 as a, not true or true as b, -2 * 3 as c, 7 // 2 as d test _.rows = [[13, true, -6, 3]]",
    "select case 2 when 1 then 'one' when 2 then 'two' else 'more' as c, if(1 > 2, 'y') as n test _.rows = [['two', null]]",
    "from [['A', '2024-01-01', 1.0], ['A', '2024-01-04', 2.0]] as h(sym, date, n) asof join { from [['A', '2024-01-01', 10], ['A', '2024-01-03', 50]] as s(sym, date, price) } on s.sym = h.sym and s.date <= h.date add s.price * h.n as worth select sym, date, price, worth order by date test _.rows = [['A', '2024-01-01', 10, 10.0], ['A', '2024-01-04', 50, 100.0]]",
    "from [[1, 'x'], [2, 'y']] as f(id, name) join { from [['o1', 1]] as o(oid, fid) } on f.id = o.fid select f.name, o.oid test _.rows = [['x', 'o1']]",
    "from 'people.json' as p join 'people.json' as q on p.id = q.id and p.age > 20 select p.name, q.id order by q.id test _.rows = [['ben', 2], ['cat', 3]]",
    "from [[1, 1], [1, 2], [2, 5]] as t(g, v) group by g agg v.sum as s add s.sum() over () as total order by g test _.rows = [[1, 3, 8], [2, 5, 8]]",
    "from [[1, 10], [2, 20], [3, 30]] as t(i, v) add sum(v) over (order by i rows [-1, 0]) as s select s test _.rows = [[10], [30], [50]]",
    "from [[1, 10, null], [2, 20, 30]] as t(id, a, b) unpivot for k in (a, b) order by id, k test _.rows = [[1, 'a', 10], [2, 'a', 20], [2, 'b', 30]]",
    "from [[1, 'a'], [2, 'b'], [3, null]] as t(i, s) where (i, s) in ((1, 'a'), (2, 'x')) select i test _.rows = [[1]]",
    "from [[1], [2]] as t(i) where i not in (from [[1], [null]] as u(k) select k) test _.size = 0",
    "from [[1], [2]] as t(i) where i not in (from [[1]] as u(k) select k) test _.rows = [[2]]",
    "from [[1], [null]] as t(i) where i not in (from [[1]] as u(k) where k > 5 select k) test _.size = 2",
    "with a as { from [[1], [2]] as t(x) } with b(y) as [[2], [3]] from a join b on a.x = b.y select x test _.rows = [[2]]",
    "from 'people.json' debug { where id = 1 test _.size should be 1 } where id = 2 test _.rows should be [[2, 'ben', 24]]",
    "from [[1, null], [2, 3]] as t(i, v) order by v desc select i test _.rows = [[2], [1]]",
    "from [[1, 'a']] as t(id, id2) join [[1, 'z']] as u(id, w) on t.id = u.id test _.columns = ['id', 'id2', 'id_1', 'w']",
    "from [[1, 'a'], [2, 'b']] as l(id, x) full join [[2, 'c'], [3, 'd']] as r(id, y) on id order by id test _.rows = [[1, 'a', null], [2, 'b', 'c'], [3, null, 'd']]",
    "-- a comment\n---\nblock\n---\n/* c */ select 1 as x -- end\ntest _.rows = [[1]]",
    "from 'people.json' sample 2 test _.size = 2",
    "from 'people.json' sample reservoir(50%) test _.size = 2",
]


@pytest.mark.parametrize("text", OK, ids=range(len(OK)))
def test_in_query_tests_hold(engine, text):
    engine.run(text)
    assert engine.tests and all(t.ok for t in engine.tests)


def test_box(engine):
    got = engine.run("from 'people.json' where id < 3 select id, name")[0].box()
    assert got.splitlines() == ["┌──────┬────────┐", "│  id  │  name  │", "│ long │ string │", "├──────┼────────┤", "│    1 │ ann    │", "│    2 │ ben    │", "├──────┴────────┤", "│ 2 rows        │", "└───────────────┘"]


def test_models_functions_imports(engine):
    text = """
import shared.*
model m(n: int) = { from old(n) select name, twice = double_it(age) }
from m(20)
"""
    assert rows(engine.query(text)) == [["ben", 48], ["cat", 80]]
    assert engine.run("show query m")[0].text.startswith("model m")
    assert ["m"] in [r[:1] for r in rows(engine.query("show models"))]
    with pytest.raises(FlowError):
        engine.query("from m()")
    with pytest.raises(FlowNameError):
        engine.query("from m(k = 1)")


def test_functions_that_aggregate(engine):
    text = "def total(x: long): long = x.sum\nfrom [[1, 2], [1, 3], [2, 9]] as t(g, v) group by g where total(v) < 9 agg total(v) as s, total(v) * 2 as twice"
    assert rows(engine.query(text)) == [[1, 5, 10]]


def test_types_and_methods(engine):
    text = """
type person = {
  age: years
  def adult: boolean = age >= 18
}
type years extends long = { def months: long = this * 12 }
model people: person = { from 'people.json' }
from people where _.adult select age.months as m
"""
    assert rows(engine.query(text)) == [[288], [480]]


def test_vals_are_bound_once(engine):
    a, b = rows(engine.query("val id = ulid_string\nfrom [[1], [2]] as t(x) select id as u"))
    assert a == b and len(a[0]) == 26


def test_save_append_delete(engine, spark, folder):
    spark.sql("drop table if exists flow_people")
    engine.run("from 'people.json' save to flow_people\nfrom [[9, 'zoe', 1]] as t(id, name, age) append to flow_people\nfrom [[8, 'yan']] as t(id, name) append to flow_people(id, name)")
    assert sorted(rows(engine.query("from flow_people select id, age"))) == sorted([[1, 10], [2, 24], [3, 40], [9, 1], [8, None]], key=str) or len(rows(engine.query("from flow_people"))) == 5
    engine.run("from flow_people where age < 20 delete")
    assert sorted(r[0] for r in rows(engine.query("from flow_people"))) == [2, 3, 8]
    spark.sql("drop table flow_people")
    for name in ("x.parquet", "x.json", "x.csv"):
        engine.run(f"from 'people.json' save to '{name}'\nfrom 'people.json' where id = 1 append to '{name}'\nfrom '{name}' where id = 2 delete")
        assert sorted(rows(engine.query(f"from '{name}'"))) == [[1, "ann", 10], [1, "ann", 10], [3, "cat", 40]]


def test_sql_rewrites(engine, spark):
    for t in ("acc", "news"):
        spark.sql(f"drop table if exists {t}")
    engine.sql("create table acc as select * from values (1, 10), (2, 20), (3, 30) as t(id, v)")
    engine.sql("update acc set v = v + 1 where id >= 2")
    assert sorted(rows(engine.sql("select * from acc"))) == [[1, 10], [2, 21], [3, 31]]
    engine.sql("create table news as select * from values (2, 200), (3, null), (4, 400) as t(id, v)")
    engine.sql("merge into acc as a using news as n on a.id = n.id when matched and n.v is null then delete when matched then update set v = n.v when not matched then insert (id, v) values (n.id, n.v)")
    assert sorted(rows(engine.sql("select * from acc"))) == [[1, 10], [2, 200], [4, 400]]
    engine.sql("delete from acc where v > 100")
    assert rows(engine.sql("select * from acc")) == [[1, 10]]
    engine.sql("prepare one from select * from acc where id = ?")
    assert rows(engine.sql("execute one using 1")) == [[1, 10]]
    for t in ("acc", "news"):
        spark.sql(f"drop table {t}")


@pytest.mark.parametrize("text", ["from 1", "select 1:int as x", "from t where", "from [[1]] as t(a) sample odd(3)", "select 'open", "from t group by"])
def test_syntax_errors(text):
    with pytest.raises(FlowSyntaxError):
        parse(text)


def test_other_errors(engine):
    with pytest.raises(FlowTestFailure):
        engine.run("from 'people.json' test _.size should be 4")
    with pytest.raises(FlowNameError):
        engine.query("from 'people.json' exclude nope")
    with pytest.raises(FlowNameError):
        engine.query("from no_such_table")
    with pytest.raises(FlowError):
        engine.query("from 'people.json' group by id select _3")
    with pytest.raises(FlowError):
        engine.query("use no_such_schema")


def test_precedence():
    assert parse_expr("a * b + c") == A.Bin("+", A.Bin("*", A.Col("a"), A.Col("b")), A.Col("c"))
    assert parse_expr("not a = 1 and b") == A.Bin("and", A.Un("not", A.Bin("=", A.Col("a"), A.Lit(1))), A.Col("b"))
    assert parse_expr("-x.abs") == A.Un("-", A.Dot(A.Col("x"), "abs"))
    assert parse_expr("a || b = c") == A.Bin("=", A.Bin("||", A.Col("a"), A.Col("b")), A.Col("c"))


def test_explain_and_pushdown(engine, spark):
    engine.folder = "/root/testdata/sf0.001"
    text = engine.run("explain from lineitem where l_quantity > 49 group by l_suppkey agg _.count as n")[0].text
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in text
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in text
    assert "CartesianProduct" not in engine.run("explain from customer, orders where c_custkey = o_custkey count")[0].text


def test_correlated_aggregates_make_no_product(engine):
    tables = """with part as { from [[1, 5], [2, 30], [3, 7], [null, 1]] as p(pk, size) }
with line as { from [[1, 10, 1], [1, 2, 2], [1, 3, 3], [2, 9, 4], [null, 1, 5]] as l(lk, q, no) }
"""
    few = engine.query(tables + "from line, part where pk = lk and size < 20 where q < { from line as o where o.lk = pk select 0.5 * o.q.avg + 1 } select no order by no")
    assert rows(few) == [[2], [3]]
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "<=>" not in plan
    # no row of the other side: a count is 0, other aggregates are null; what is made of both, too
    each = engine.query(tables + "from part select pk, n = { from line as o where o.lk = pk select _.count }, m = { from line as o where o.lk = pk select o.q.sum + _.count }, c = { from line as o where o.lk = pk select _.count + 1 } order by pk")
    assert rows(each) == [[1, 3, 18, 4], [2, 1, 10, 2], [3, 0, None, 1], [None, 0, None, 1]]
    named = engine.query(tables + "from part where size > { from line as o where o.lk = pk select top = o.q.max select top + 0 } select pk order by pk")
    assert rows(named) == [[2]]


def test_catalog_and_commands(engine, spark):
    spark.sql("drop table if exists listed")
    engine.sql("create table listed as select 1 as id, 'a' as s")
    assert ["listed"] in rows(engine.query("show tables"))
    assert ["default"] in [r[1:] for r in rows(engine.query("show schemas"))]
    assert rows(engine.query("show columns in listed where column_name = 's'")) == [["listed", "s", "string"]]
    assert "listed" in [r[2] for r in rows(engine.query("from wv_tables()"))]
    assert ["default"] in [r[1:] for r in rows(engine.query("from wv_schemas()"))]
    assert rows(engine.run('execute sql"select count(*) as n from listed"')[0].df) == [[1]]
    assert "LocalTableScan" in engine.run('explain sql"select 1 as x"')[0].text or "OneRow" in engine.run('explain sql"select 1 as x"')[0].text
    engine.sql("insert overwrite table listed values (7, 'z')")
    assert rows(engine.query("from listed")) == [[7, "z"]]
    engine.sql("truncate table listed")
    assert engine.query("from listed").count() == 0
    engine.sql("create or replace table listed as select 2 as id")
    assert rows(engine.query("from listed")) == [[2]]
    engine.run("use default")
    spark.sql("drop table listed")
    assert rows(engine.query('from json\'{"a": [1, 2], "b": null}\' select a[2] as x, b')) == [[2, None]]
    assert rows(engine.query("from unnest([3, 4]) as t(x) select x.sum as s")) == [[7]]
    assert rows(engine.query("from range(3) count")) == [[3]]
