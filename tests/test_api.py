from pathlib import Path

from sluice import Engine
from sluice.api import flow
from sluice.operators.asof import asof_join
from sluice.streaming import subscribe as S


def test_fluent_equals_text(spark):
    engine = Engine(spark, "/root/testdata/sf0.001")
    built = flow(engine, "lineitem").where("l_quantity > 10").group_by("l_returnflag").agg("_.count as n", "l_quantity.sum as q").where("n > 5").order_by("l_returnflag desc").df()
    text = engine.query("from lineitem where l_quantity > 10 group by l_returnflag agg _.count as n, l_quantity.sum as q where n > 5 order by l_returnflag desc")
    assert built.collect() == text.collect()
    orders = flow(engine, "orders")
    assert orders.rollup("o_orderstatus").agg("_.count as n").df().count() == 4
    assert orders.cube("o_orderstatus", "o_orderpriority").agg("_.count as n").df().count() == 24
    assert orders.grouping_sets(["o_orderstatus", "o_orderpriority"], [[0], [1], []]).agg("_.count as n").df().count() == 9
    assert flow(engine, "nation").join("region", "n_regionkey = r_regionkey").select("n_name", "r_name").df().count() == 25
    assert flow(engine, "[[1, [5, 6]]] as t(i, a)").unnest("a", names=("x",), ordinality="no").df().collect() == [(1, [5, 6], 5, 1), (1, [5, 6], 6, 2)]
    assert flow(engine, "nation").pivot("n_regionkey", [0, 1], agg=("_.count as n",), group_by=("n_name",)).df().columns == ["n_name", "0", "1"]
    assert flow(engine, "nation").shift("n_name").rename(n_name="name").add("n_nationkey + 1 as next").limit(3).df().columns == ["name", "n_nationkey", "n_regionkey", "next"]
    assert flow(engine, "nation").select("n_regionkey").except_("region select r_regionkey").df().count() == 0


def test_asof_buckets_agree(spark):
    """Hot keys cut into time ranges give what one window per key gives."""
    left = spark.range(3000).selectExpr("id", "cast(pmod(id * 7919, 3) as int) as k", "pmod(id * 104729, 997) as t").selectExpr("id", "if(k = 2 and id % 50 = 0, null, 0) as k", "t")
    right = spark.range(400).selectExpr("0 as rk", "pmod(id * 31337, 1013) as rt").distinct()
    for op in (">=", ">", "<=", "<"):
        got = [sorted(map(str, asof_join(left, right, [(left.k, right.rk)], left.t, right.rt, op, True, b).collect())) for b in (1, 7)]
        assert got[0] == got[1] and len(got[0]) == 3000
        times = sorted(r.rt for r in right.collect())
        for r in asof_join(left, right, [(left.k, right.rk)], left.t, right.rt, op, False, 7).collect()[:200]:
            fits = [x for x in times if {">=": x <= r.t, ">": x < r.t, "<=": x >= r.t, "<": x > r.t}[op]]
            assert r.rt == (max(fits) if op in (">=", ">") else min(fits))


def test_subscription_is_incremental(spark, tmp_path):
    source = Path(tmp_path, "in")
    spark.sql("select 1 as id, timestamp'2024-01-01 00:00:00' as ts").write.parquet(str(source))
    options = {"watermark_column": "ts", "window_size": "1h", "checkpoint": f"{tmp_path}/check", "target": f"{tmp_path}/out"}
    engine = Engine(spark, base_dir=str(tmp_path))
    text = "model m = { from 'in' where id > 0 }\nfrom m.subscribe(" + ", ".join(f"{k} = '{v}'" for k, v in options.items()) + ")"
    text = text.replace("'in'", "'in/*.parquet'")
    assert engine.query(text).count() == 1
    spark.sql("select 2 as id, timestamp'2024-01-01 01:00:00' as ts").write.mode("append").parquet(str(source))
    assert engine.query(text).count() == 2
    assert engine.query(text).count() == 2


def test_dedup_and_sliding(spark, tmp_path):
    spark.sql("select * from values (1, timestamp_ntz'2024-01-01 00:10:00'), (1, timestamp_ntz'2024-01-01 00:20:00'), (2, timestamp_ntz'2024-01-01 01:10:00') as t(k, ts)").coalesce(1).write.parquet(f"{tmp_path}/e")
    events = S.as_stream(spark.read.parquet(f"{tmp_path}/e"))
    assert S.run_available(S.deduplicated(events, "ts", ["k"], "1h"), f"{tmp_path}/c", f"{tmp_path}/o").count() == 2
    from pyspark.sql import functions as F

    got = S.run_complete(S.windowed(events, "ts", "1h", [F.count(F.lit(1)).alias("n")], slide="30m"), f"{tmp_path}/w").collect()
    assert sorted(r.n for r in got) == [1, 1, 2, 2]


def test_plans_of_band_and_asof_joins(spark, sf_dir):
    engine = Engine(spark, sf_dir)
    from sluice import queries as Q

    for name in ("join_band", "join_band_dates"):
        plan = engine.query(Q.FLOWS[name][0])._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    plan = engine.query(Q.FLOWS["asof_inner"][0])._jdf.queryExecution().optimizedPlan().toString()
    assert "_b" in plan  # time ranges for timestamps without a zone too
