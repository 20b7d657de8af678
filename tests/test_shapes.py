from sluice.engine import Engine


def test_pivot_keys_that_hold_the_separator(spark):
    rows = [("a_b", "c", 1), ("a", "b_c", 2), (None, "x", 4), ("x", None, 8), ("a", "c", 16), ("a", "c", 32)]
    spark.createDataFrame(rows, "p string, q string, n int").createOrReplaceTempView("pivot_keys")
    got = Engine(spark).query("from pivot_keys pivot on p in ('a_b', 'a'), q in ('c', 'b_c') agg n.sum, _.count as k")
    assert got.columns[:2] == ["a_b_c_sum(n)", "a_b_c_k"] and len(set(got.columns)) == 8
    assert list(got.first()) == [1, 1, None, 0, 48, 2, 2, 1]


def test_zones_and_objects(spark):
    engine = Engine(spark)
    row = engine.sql("select min(t at time zone 'America/New_York') as a, (t0 + interval '1' day) at time zone 'UTC' as b, json_object('a' : (1 + 2), 'b' : json_object('c' : 'x : )')) as j from values (timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-01 00:00:00') as v(t, t0) group by t0").first()
    assert str(row.a.astimezone()) and row.j == '{"a":3,"b":{"c":"x : )"}}'


def test_views_of_another_engine(spark, tmp_path):
    """Tables that SQL text saw under an engine do not stand in the way of another engine's folder."""
    for n in (1, 2):
        spark.range(n).write.parquet(f"{tmp_path}/{n}/shape_rows.parquet")
    one, two = Engine(spark, f"{tmp_path}/1"), Engine(spark, f"{tmp_path}/2")
    assert one.sql("select * from shape_rows").count() == 1
    assert two.query("from shape_rows").count() == 2 and two.sql("select * from shape_rows").count() == 2
    assert one.query("from shape_rows").count() == 1 and Engine(spark, f"{tmp_path}/2", streaming=True).query("from shape_rows").isStreaming
