"""Registered flow queries and the same questions as DuckDB SQL.

``FLOWS`` maps a name to its flow text and SQL (None where the result is
random or an estimate).  Every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.engine import Engine

FLOWS: dict[str, tuple[str, str | None]] = {
    # ------------------------------------------------------------ scan, columns
    "scan_region": ("from region", "select * from region"),
    "project_alias": (
        "from lineitem select l_orderkey, line = l_linenumber, net = (l_extendedprice * (1 - l_discount)).round(4)",
        "select l_orderkey, l_linenumber as line, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem",
    ),
    "filter_and_chain": (
        "from lineitem where l_quantity > 10 where l_returnflag = 'R' and l_discount <= 0.05 select l_orderkey, l_linenumber, l_quantity",
        "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 10 and l_returnflag = 'R' and l_discount <= 0.05",
    ),
    "add_cols": (
        "from nation add n_nationkey * 10 as ten, up = n_name.upper",
        "select *, n_nationkey * 10 as ten, upper(n_name) as up from nation",
    ),
    "prepend_cols": ("from nation prepend n_nationkey + 1 as next_key", "select n_nationkey + 1 as next_key, * from nation"),
    "transform_cols": ("from nation transform n_name = n_name.lower, twice = n_nationkey * 2", "select n_nationkey, lower(n_name) as n_name, n_regionkey, n_nationkey * 2 as twice from nation"),
    "exclude_cols": ("from customer exclude c_name, c_mktsegment", "select c_custkey, c_nationkey, c_acctbal from customer"),
    "rename_cols": ("from region rename r_name as region_name", "select r_regionkey, r_name as region_name from region"),
    "shift_left": ("from supplier shift s_acctbal, s_name", "select s_acctbal, s_name, s_suppkey, s_nationkey from supplier"),
    "shift_right": ("from supplier shift to right s_suppkey", "select s_name, s_nationkey, s_acctbal, s_suppkey from supplier"),
    "pipe_separator": ("from nation select n_nationkey, n_name, | where n_nationkey < 5", "select n_nationkey, n_name from nation where n_nationkey < 5"),
    "describe_region": ("from region describe", "select * from (values ('r_regionkey', 'int'), ('r_name', 'string')) t(column_name, column_type)"),
    "values_inline": (
        "from [[1, 'apple', 2.5], [2, 'pear', null], [3, null, 1.25]] as fruit(id, name, price) where id > 1 select id, name, price = price.to_double",
        "select * from (values (2::bigint, 'pear', null::double), (3, null, 1.25)) t(id, name, price)",
    ),
    "table_const_join": (
        "val flags(flag, label) = [['A', 'accepted'], ['R', 'returned']]\nfrom lineitem join flags on l_returnflag = flags.flag group by label agg _.count as n",
        "select label, count(*) as n from lineitem join (values ('A', 'accepted'), ('R', 'returned')) f(flag, label) on l_returnflag = flag group by label",
    ),
    "val_constant": ("val least = 40\nfrom lineitem where l_quantity >= least select l_orderkey, l_linenumber", "select l_orderkey, l_linenumber from lineitem where l_quantity >= 40"),
    "raw_sql_source": ('from sql"select o_orderstatus, count(*) as n from orders group by o_orderstatus" where n > 1', "select o_orderstatus, count(*) as n from orders group by o_orderstatus having count(*) > 1"),
    "raw_json_source": ("""from json'[{"k": "a", "v": 1}, {"k": "b", "v": 2}]'""", "select * from (values ('a', 1::bigint), ('b', 2)) t(k, v)"),
    "select_without_from": ("select 1 + 2 as three, 'a' + 'b' as ab", "select 3 as three, 'ab' as ab"),
    # -------------------------------------------------------------------- joins
    "join_inner_on": (
        "from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING' select o_orderkey, c_name, o_totalprice",
        "select o_orderkey, c_name, o_totalprice from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING'",
    ),
    "join_theta_range": (
        "from nation as a join nation as b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey select a.n_name as first_nation, b.n_name as second_nation",
        "select a.n_name as first_nation, b.n_name as second_nation from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey",
    ),
    "join_left_null": (
        "from customer left join orders on c_custkey = o_custkey and o_totalprice > 300000 where o_orderkey is null select c_custkey, c_name",
        "select c_custkey, c_name from customer left join orders on c_custkey = o_custkey and o_totalprice > 300000 where o_orderkey is null",
    ),
    "join_right": (
        "from [[1, 'x'], [99, 'y']] as t(k, tag) right join region on t.k = r_regionkey select tag, r_regionkey",
        "select tag, r_regionkey from (values (1, 'x'), (99, 'y')) t(k, tag) right join region on t.k = r_regionkey",
    ),
    "join_full_using": (
        "from [[1, 'a'], [2, 'b']] as l(id, x) full join [[2, 'c'], [3, 'd']] as r(id, y) on id",
        "select * from (values (1::bigint, 'a'), (2, 'b')) l(id, x) full join (values (2::bigint, 'c'), (3, 'd')) r(id, y) using (id)",
    ),
    "join_cross": ("from nation cross join region select n_name, r_name", "select n_name, r_name from nation cross join region"),
    "join_comma_filters": (
        "from customer, orders, nation where c_custkey = o_custkey and c_nationkey = n_nationkey and o_orderstatus = 'F' group by n_name agg _.count as n, o_totalprice.sum.round(4) as total",
        "select n_name, count(*) as n, round(sum(o_totalprice), 4) as total from customer, orders, nation where c_custkey = o_custkey and c_nationkey = n_nationkey and o_orderstatus = 'F' group by n_name",
    ),
    "semi_in_subquery": (
        "from customer where c_custkey in (from orders where o_totalprice > 400000 select o_custkey) select c_custkey, c_name",
        "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)",
    ),
    "semi_method_in": (
        "from orders where o_orderkey.in(from lineitem group by l_orderkey where l_quantity.sum > 200 select l_orderkey) select o_orderkey",
        "select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 200)",
    ),
    "semi_exists": (
        "from supplier where exists { from lineitem where l_suppkey = s_suppkey and l_quantity >= 50 } select s_suppkey",
        "select s_suppkey from supplier where exists (select 1 from lineitem where l_suppkey = s_suppkey and l_quantity >= 50)",
    ),
    "anti_not_exists": (
        "from customer where not exists { from orders where o_custkey = c_custkey } select c_custkey, c_acctbal",
        "select c_custkey, c_acctbal from customer where not exists (select 1 from orders where o_custkey = c_custkey)",
    ),
    "anti_not_in": (
        "from part where p_partkey not in (from lineitem where l_quantity > 45 select l_partkey) select p_partkey, p_brand",
        "select p_partkey, p_brand from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)",
    ),
    "anti_not_in_null": (
        "from region where r_regionkey not in (from [[1], [null]] as t(k) select k) select r_name",
        "select r_name from region where r_regionkey not in (select k from (values (1), (null)) t(k))",
    ),
    "tuple_in": (
        "from lineitem where (l_returnflag, l_linestatus) in (('A', 'F'), ('N', 'O')) group by l_returnflag, l_linestatus agg _.count as n",
        "select l_returnflag, l_linestatus, count(*) as n from lineitem where (l_returnflag, l_linestatus) in (('A', 'F'), ('N', 'O')) group by all",
    ),
    "tuple_in_subquery": (
        "from lineitem where (l_orderkey, l_linenumber) in (from lineitem where l_quantity = 50 select l_orderkey, l_linenumber) select l_orderkey, l_linenumber, l_quantity",
        "select l_orderkey, l_linenumber, l_quantity from lineitem where (l_orderkey, l_linenumber) in (select (l_orderkey, l_linenumber) from lineitem where l_quantity = 50)",
    ),
    "scalar_subquery": (
        "from orders where o_totalprice > { from orders select o_totalprice.avg } select o_orderkey",
        "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) from orders)",
    ),
    "scalar_correlated": (
        "from supplier as s where s_acctbal >= { from supplier as b where b.s_nationkey = s.s_nationkey select b.s_acctbal.max } select s_suppkey, s_nationkey",
        "select s_suppkey, s_nationkey from supplier s where s_acctbal >= (select max(b.s_acctbal) from supplier b where b.s_nationkey = s.s_nationkey)",
    ),
    "scalar_running_avg": (
        """from orders as o where o.o_totalprice > 1.1 * { from orders as b where b.o_custkey = o.o_custkey and b.o_orderdate < o.o_orderdate select b.o_totalprice.avg }
select o_orderkey, o_custkey, so_far = { from orders as c where c.o_custkey = o.o_custkey and c.o_orderdate <= o.o_orderdate select _.count }""",
        """select o_orderkey, o_custkey, (select count(*) from orders c where c.o_custkey = o.o_custkey and c.o_orderdate <= o.o_orderdate) as so_far from orders o
where o_totalprice > 1.1 * (select avg(b.o_totalprice) from orders b where b.o_custkey = o.o_custkey and b.o_orderdate < o.o_orderdate)""",
    ),
    "scalar_running_global": (
        "from part add dearer = { from lineitem where l_quantity > 40 and l_extendedprice / l_quantity > p_retailprice select _.count }, least = { from supplier where s_acctbal >= p_retailprice select s_acctbal.min } select p_partkey, dearer, least",
        """select p_partkey, (select count(*) from lineitem where l_quantity > 40 and l_extendedprice / l_quantity > p_retailprice) as dearer,
(select min(s_acctbal) from supplier where s_acctbal >= p_retailprice) as least from part""",
    ),
    "semi_exists_less": (
        "from customer as c where exists { from supplier where s_nationkey = c.c_nationkey and s_acctbal < c.c_acctbal and s_suppkey > 3 } select c_custkey",
        "select c_custkey from customer c where exists (select 1 from supplier where s_nationkey = c.c_nationkey and s_acctbal < c.c_acctbal and s_suppkey > 3)",
    ),
    "anti_exists_less": (
        "from orders as o where not exists { from orders as b where b.o_custkey = o.o_custkey and b.o_orderdate < o.o_orderdate } where exists { from customer where c_acctbal * 40 >= o_totalprice } select o_orderkey",
        """select o_orderkey from orders o where not exists (select 1 from orders b where b.o_custkey = o.o_custkey and b.o_orderdate < o.o_orderdate)
and exists (select 1 from customer where c_acctbal * 40 >= o_totalprice)""",
    ),
    "asof_inner": (
        "from events as e where e.event_type = 'purchase' asof join { from events where event_type = 'view' select user_id as v_user, ts as v_ts, event_id as v_id } as v on e.user_id = v.v_user and e.ts >= v.v_ts select event_id, user_id, v_ts",
        "select e.event_id, e.user_id, v.ts as v_ts from (select * from events where event_type = 'purchase') e asof join (select * from events where event_type = 'view') v on e.user_id = v.user_id and e.ts >= v.ts",
    ),
    "asof_left_strict": (
        "from events as e where e.event_type = 'error' asof left join { from events where event_type = 'click' select user_id as v_user, ts as v_ts } as v on v.v_user = e.user_id and v.v_ts < e.ts select event_id, v_ts",
        "select e.event_id, v.ts as v_ts from (select * from events where event_type = 'error') e asof left join (select * from events where event_type = 'click') v on e.user_id = v.user_id and e.ts > v.ts",
    ),
    "asof_next": (
        "from events as e where e.event_type = 'view' asof join { from events where event_type = 'purchase' select user_id as v_user, ts as v_ts } as v on v.v_user = e.user_id and e.ts <= v.v_ts select event_id, v_ts",
        "select e.event_id, v.ts as v_ts from (select * from events where event_type = 'view') e asof join (select * from events where event_type = 'purchase') v on e.user_id = v.user_id and e.ts <= v.ts",
    ),
    "unnest_cross_join": (
        "from embeddings cross join unnest(embedding) as t(x) group by label agg _.count as n, x.to_double.max as top",
        "select label, count(*) as n, max(x::double) as top from (select label, unnest(embedding) as x from embeddings) group by label",
    ),
    # -------------------------------------------------------------- aggregation
    "agg_global": (
        "from lineitem select _.count as n, l_quantity.sum as q, l_extendedprice.avg.round(4) as p, l_shipdate.min as first_ship, l_shipdate.max as last_ship",
        "select count(*) as n, sum(l_quantity) as q, round(avg(l_extendedprice), 4) as p, min(l_shipdate) as first_ship, max(l_shipdate) as last_ship from lineitem",
    ),
    "agg_group": (
        "from lineitem group by l_returnflag, l_linestatus agg _.count as n, l_quantity.sum as q, l_discount.avg.round(6) as d",
        "select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as q, round(avg(l_discount), 6) as d from lineitem group by all",
    ),
    "agg_having": (
        "from lineitem group by l_suppkey where l_quantity.sum > 500 and _.count > 10 agg l_quantity.sum as q",
        "select l_suppkey, sum(l_quantity) as q from lineitem group by l_suppkey having sum(l_quantity) > 500 and count(*) > 10",
    ),
    "agg_then_where": ("from orders group by o_custkey agg _.count as n where n > 5", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 5"),
    "agg_distinct": (
        "from lineitem group by l_returnflag agg l_suppkey.count_distinct as suppliers, count(distinct l_partkey) as parts, sum(distinct l_linenumber) as s",
        "select l_returnflag, count(distinct l_suppkey) as suppliers, count(distinct l_partkey) as parts, sum(distinct l_linenumber)::bigint as s from lineitem group by all",
    ),
    "agg_filter_clause": (
        "from orders group by o_orderpriority agg count(*) filter (where o_orderstatus = 'F') as done, sum(o_totalprice) filter (where o_orderstatus = 'O') as open_total select o_orderpriority, done, open_total = open_total.round(4)",
        "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as done, round(sum(o_totalprice) filter (where o_orderstatus = 'O'), 4) as open_total from orders group by all",
    ),
    "agg_minmax_by": (
        "from orders group by o_orderstatus agg o_orderkey.max_by(o_orderkey * 2) as last_key, o_orderkey.min_by(o_orderkey) as first_key",
        "select o_orderstatus, max_by(o_orderkey, o_orderkey * 2) as last_key, min_by(o_orderkey, o_orderkey) as first_key from orders group by all",
    ),
    "agg_median_var_std": (
        "from lineitem group by l_returnflag agg l_quantity.median as m, l_quantity.variance.round(6) as v, l_quantity.stddev.round(6) as s",
        "select l_returnflag, median(l_quantity) as m, round(variance(l_quantity), 6) as v, round(stddev(l_quantity), 6) as s from lineitem group by all",
    ),
    "agg_array_sorted": (
        "from nation group by n_regionkey agg array_agg(n_name order by n_nationkey desc) as names",
        "select n_regionkey, array_agg(n_name order by n_nationkey desc) as names from nation group by all",
    ),
    "agg_count_if": ("from lineitem group by l_linestatus agg count_if(l_quantity > 25) as big", "select l_linestatus, count_if(l_quantity > 25)::bigint as big from lineitem group by all"),
    "agg_conditional_sum": (
        "from orders group by o_orderstatus agg (if o_totalprice > 200000 then 1 else 0).sum as high",
        "select o_orderstatus, sum(case when o_totalprice > 200000 then 1 else 0 end)::bigint as high from orders group by all",
    ),
    "approx_distinct": ("from lineitem select l_partkey.count_approx_distinct as parts", None),
    "approx_quantile": ("from lineitem group by l_returnflag agg l_extendedprice.approx_quantile(0.5) as mid", None),
    "count_operator": ("from lineitem where l_tax > 0.05 count", 'select count(*) as "count" from lineitem where l_tax > 0.05'),
    "count_of_groups": ("from lineitem group by l_suppkey, l_returnflag count", 'select count(*) as "count" from (select distinct l_suppkey, l_returnflag from lineitem)'),
    "count_method_quirk": (
        "from customer left join orders on c_custkey = o_custkey group by c_custkey agg o_orderkey.count as n",
        "select c_custkey, count(*) as n from customer left join orders on c_custkey = o_custkey group by c_custkey",
    ),
    "group_key_index": ("from lineitem group by l_returnflag, l_linestatus select _2, _1, _.count as n", "select l_linestatus, l_returnflag, count(*) as n from lineitem group by all"),
    "group_expression_key": (
        "from lineitem group by (l_quantity / 10).floor as tens agg _.count as n",
        "select floor(l_quantity / 10)::bigint as tens, count(*) as n from lineitem group by 1",
    ),
    "group_twice": (
        "from orders group by o_custkey agg _.count as n group by n agg _.count as customers",
        "select n, count(*) as customers from (select o_custkey, count(*) as n from orders group by o_custkey) group by n",
    ),
    "pivot_values": (
        "from orders pivot on o_orderstatus in ('F', 'O', 'P') group by o_orderpriority agg _.count",
        "select o_orderpriority, count_if(o_orderstatus = 'F')::bigint as \"F\", count_if(o_orderstatus = 'O')::bigint as \"O\", count_if(o_orderstatus = 'P')::bigint as \"P\" from orders group by all",
    ),
    "pivot_auto": (
        "from lineitem pivot on l_returnflag group by l_linestatus agg l_quantity.sum",
        "select l_linestatus, sum(l_quantity) filter (where l_returnflag = 'A') as \"A\", sum(l_quantity) filter (where l_returnflag = 'N') as \"N\", sum(l_quantity) filter (where l_returnflag = 'R') as \"R\" from lineitem group by all",
    ),
    "pivot_multi_key": (
        "from lineitem pivot on l_returnflag in ('A', 'R'), l_linestatus in ('F', 'O') group by l_linenumber agg _.count",
        "select l_linenumber, count_if(l_returnflag='A' and l_linestatus='F')::bigint as \"A_F\", count_if(l_returnflag='A' and l_linestatus='O')::bigint as \"A_O\", count_if(l_returnflag='R' and l_linestatus='F')::bigint as \"R_F\", count_if(l_returnflag='R' and l_linestatus='O')::bigint as \"R_O\" from lineitem where l_linenumber is not null group by all",
    ),
    "pivot_multi_agg": (
        "from orders pivot on o_orderstatus in ('F', 'O') group by o_orderpriority agg o_totalprice.max as top, _.count as n",
        "select o_orderpriority, max(o_totalprice) filter (where o_orderstatus='F') as \"F_top\", count_if(o_orderstatus='F')::bigint as \"F_n\", max(o_totalprice) filter (where o_orderstatus='O') as \"O_top\", count_if(o_orderstatus='O')::bigint as \"O_n\" from orders group by all",
    ),
    "unpivot_drop_nulls": (
        "from [[1, 10, null], [2, 20, 30]] as t(id, a, b) unpivot amount for kind in (a, b)",
        "select * from (values (1::bigint, 'a', 10::bigint), (2, 'a', 20), (2, 'b', 30)) t(id, kind, amount)",
    ),
    "unpivot_table": (
        "from lineitem select l_orderkey, l_linenumber, l_discount, l_tax unpivot rate for kind in (l_discount, l_tax)",
        "select l_orderkey, l_linenumber, 'l_discount' as kind, l_discount as rate from lineitem union all select l_orderkey, l_linenumber, 'l_tax', l_tax from lineitem",
    ),
    "join_band": (
        "from supplier join { from customer select c_custkey, c_acctbal - 5 as lo, c_acctbal + 5 as hi } as c on s_acctbal between c.lo and c.hi select s_suppkey, c_custkey",
        "select s_suppkey, c_custkey from supplier join customer on s_acctbal between c_acctbal - 5 and c_acctbal + 5",
    ),
    "join_band_dates": (
        """from { from orders select o_orderkey, o_orderdate } as o
join { from lineitem group by l_shipdate agg _.count as n } as l on o.o_orderdate <= l.l_shipdate and o.o_orderdate >= l.l_shipdate - '3 days':interval
group by o_orderkey agg n.sum as near""",
        """select o_orderkey, sum(n)::bigint as near from orders join (select l_shipdate, count(*) as n from lineitem group by l_shipdate) l
on o_orderdate <= l_shipdate and o_orderdate >= l_shipdate - interval 3 days group by o_orderkey""",
    ),
    "join_band_left": (
        "from { from customer select c_custkey, c_acctbal } as c left join { from supplier select s_suppkey, s_acctbal } as s on s.s_acctbal between c.c_acctbal - 20 and c.c_acctbal + 3 select c_custkey, s_suppkey",
        "select c_custkey, s_suppkey from customer left join supplier on s_acctbal between c_acctbal - 20 and c_acctbal + 3",
    ),
    "join_overlap": (
        """from { from part select p_partkey, p_retailprice as lo, p_retailprice + if p_partkey = 7 then 1000000.0 else p_size / 10.0 as hi } as a
join { from part select p_partkey as other, p_retailprice - p_size / 20.0 as from_price, p_retailprice as to_price } as b on a.lo < b.to_price and b.from_price <= a.hi and other != p_partkey
group by p_partkey agg _.count as n, other.min as first""",
        """select p_partkey, count(*) as n, min(other) as first from (select p_partkey, p_retailprice as lo, p_retailprice + if(p_partkey = 7, 1000000.0, p_size / 10.0) as hi from part) a
join (select p_partkey as other, p_retailprice - p_size / 20.0 as from_price, p_retailprice as to_price from part) b on a.lo < b.to_price and b.from_price <= a.hi and other <> p_partkey group by p_partkey""",
    ),
    "join_two_inequalities": (
        """from { from customer select c_custkey, c_acctbal } as c full join { from supplier select s_suppkey, s_acctbal } as s
on c.c_acctbal < s.s_acctbal + 8 and s.s_acctbal < c.c_acctbal + 8 and c_custkey % 3 != s_suppkey % 3 select c_custkey, s_suppkey""",
        """select c_custkey, s_suppkey from customer full join supplier on c_acctbal < s_acctbal + 8 and s_acctbal < c_acctbal + 8 and c_custkey % 3 <> s_suppkey % 3""",
    ),
    "agg_median_global": (
        "from lineitem add gap = if l_linenumber = 4 then null else l_extendedprice select _.count as n, l_extendedprice.median.round(4) as m, gap.median.round(4) as g, l_quantity.median as q, quantile_cont(gap, 0.9).round(4) as nine",
        """select count(*) as n, round(median(l_extendedprice), 4) as m, round(median(gap), 4) as g, median(l_quantity) as q, round(quantile_cont(gap, 0.9), 4) as nine
from (select *, if(l_linenumber = 4, null, l_extendedprice) as gap from lineitem)""",
    ),
    "agg_quantiles_exact": (
        """from lineitem add part = if l_linenumber < 3 then null else l_partkey % 5
group by part agg quantile_cont(l_extendedprice, 0.25).round(4) as lower, l_extendedprice.median.round(4) as middle, quantile_cont(l_extendedprice, 0.99).round(4) as upper, l_discount.median as d, _.count as n where n > 10""",
        """select part, round(quantile_cont(l_extendedprice, 0.25), 4) as lower, round(median(l_extendedprice), 4) as middle, round(quantile_cont(l_extendedprice, 0.99), 4) as upper, median(l_discount) as d, count(*) as n
from (select *, if(l_linenumber < 3, null, l_partkey % 5) as part from lineitem) group by part having count(*) > 10""",
    ),
    "histogram_wide": (
        """from lineitem group by l_returnflag agg histogram(l_extendedprice) as h, _.count as n
select l_returnflag, n, cardinality(map_keys(h)) as many, list_sum(map_values(h)) as total, map_keys(h)[1] as least, map_values(h)[1] as times""",
        """select l_returnflag, count(*) as n, count(distinct l_extendedprice)::int as many, count(*) as total, min(l_extendedprice) as least,
count(*) filter (where l_extendedprice = low) as times from lineitem join (select l_returnflag as f, min(l_extendedprice) as low from lineitem group by 1) on f = l_returnflag group by l_returnflag""",
    ),
    "asof_hot_key": (
        """from { from lineitem where l_shipdate is not null select l_orderkey, l_linenumber, l_partkey, l_shipdate, k = if l_partkey % 3 = 0 then 0 else l_suppkey } as l
asof left join { from orders group by o_orderdate, o_custkey % 100 as c agg o_totalprice.max as top, o_orderkey.min as first select o_orderdate, ok = if c < 34 then 0 else c, top, first
group by o_orderdate, ok agg top.max as top, first.min as first } as o on l.k = o.ok and o.o_orderdate < l.l_shipdate select l_orderkey, l_linenumber, l_partkey, o_orderdate, top, first""",
        """select l_orderkey, l_linenumber, l_partkey, o.o_orderdate, top, first from (select *, if(l_partkey % 3 = 0, 0, l_suppkey) as k from lineitem) l
asof left join (select o_orderdate, if(o_custkey % 100 < 34, 0, o_custkey % 100) as ok, max(o_totalprice) as top, min(o_orderkey) as first from orders group by 1, 2) o on l.k = o.ok and o.o_orderdate < l.l_shipdate""",
    ),
    "histogram": (
        "from orders group by o_orderpriority agg histogram(o_orderstatus) as h select o_orderpriority, h['F'] as f, h['O'] as o",
        "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as f, count(*) filter (where o_orderstatus = 'O') as o from orders group by o_orderpriority",
    ),
    "array_concat_op": (
        "from nation where n_nationkey < 5 add concat([n_nationkey, 1], [n_regionkey]) as c, len([n_regionkey, 2, 3]) as n, list_sum([n_nationkey, 10]) as s, concat(n_name, '-', n_nationkey) as t select n_nationkey, c[1] as c1, c[3] as c3, n, s, t",
        "select n_nationkey, n_nationkey as c1, n_regionkey as c3, 3::int as n, n_nationkey + 10 as s, n_name || '-' || n_nationkey as t from nation where n_nationkey < 5",
    ),
    "regexp_extract": (
        "from part select p_partkey, regexp_extract(p_type, '[A-Z]+') as first, regexp_extract(p_type, '([A-Z]+) ([A-Z]+)', 2) as second",
        "select p_partkey, regexp_extract(p_type, '[A-Z]+') as first, regexp_extract(p_type, '([A-Z]+) ([A-Z]+)', 2) as second from part",
    ),
    "date_diff": (
        "from orders select o_orderkey, date_diff('day', o_orderdate, '1999-01-15'::date) as d, date_diff('month', o_orderdate, '1999-01-15'::date) as m, date_diff('year', o_orderdate, '1999-01-15'::date) as y",
        "select o_orderkey, date_diff('day', o_orderdate::date, date '1999-01-15') as d, date_diff('month', o_orderdate::date, date '1999-01-15') as m, date_diff('year', o_orderdate::date, date '1999-01-15') as y from orders",
    ),
    "strftime": (
        "from orders select o_orderkey, strftime(o_orderdate, '%Y/%m/%d') as day, try_cast(o_orderpriority as int) as none",
        "select o_orderkey, strftime(o_orderdate::timestamp, '%Y/%m/%d') as day, try_cast(o_orderpriority as int) as none from orders",
    ),
    "like_regex_contains": (
        "from part where p_name like '%a%' where contains(p_type, 'A') where regexp_like(p_type, 'N|E') select p_partkey",
        "select p_partkey from part where p_name like '%a%' and contains(p_type, 'A') and regexp_matches(p_type, 'N|E')",
    ),
    "group_ordinal": (
        "from orders select o_orderstatus, o_orderkey group by 1 agg _.count as n",
        "select o_orderstatus, count(*) as n from orders group by 1",
    ),
    "array_get": (
        "from nation select n_nationkey, [n_nationkey, n_regionkey].get(2) as r, current_date.extract('year') > 2000 as now",
        "select n_nationkey, n_regionkey as r, true as now from nation",
    ),
    # ------------------------------------------------------------------ windows
    "win_rank_family": (
        "from nation add rank() over (partition by n_regionkey order by n_name) as r, dense_rank() over (order by n_regionkey) as d, row_number() over (partition by n_regionkey order by n_name desc) as i, ntile(4) over (order by n_nationkey) as q select n_nationkey, r, d, i, q",
        "select n_nationkey, rank() over (partition by n_regionkey order by n_name)::int as r, dense_rank() over (order by n_regionkey)::int as d, row_number() over (partition by n_regionkey order by n_name desc)::int as i, ntile(4) over (order by n_nationkey)::int as q from nation",
    ),
    "win_lag_lead": (
        "from orders add lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as before, lead(o_orderkey, 2) over (partition by o_custkey order by o_orderdate, o_orderkey) as after select o_orderkey, before, after",
        "select o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as before, lead(o_orderkey, 2) over (partition by o_custkey order by o_orderdate, o_orderkey) as after from orders",
    ),
    "win_lag_default": (
        "from [[1, 10, 7], [2, null, 8], [3, 30, 9]] as t(i, v, y) add lag(v, 1, y) over (order by i) as p, lead(v, 1, i + y) over (order by i) as n, lag(v, 1, 9) ignore nulls over (order by i) as g",
        "select *, lag(v, 1, y) over (order by i) as p, lead(v, 1, i + y) over (order by i) as n, lag(v, 1, 9 ignore nulls) over (order by i) as g from (values (1::bigint, 10::bigint, 7::bigint), (2, null, 8), (3, 30, 9)) t(i, v, y)",
    ),
    "win_lag_offset": (
        "from orders add lag(o_orderkey, 1 + 1) over (partition by o_custkey order by o_orderkey) as p, lead(o_orderkey, 2 * 2 - 1, -o_custkey) over (partition by o_custkey order by o_orderkey) as n select o_orderkey, p, n",
        "select o_orderkey, lag(o_orderkey, 2) over (partition by o_custkey order by o_orderkey) as p, lead(o_orderkey, 3, -o_custkey) over (partition by o_custkey order by o_orderkey) as n from orders",
    ),
    "win_ignore_nulls": (
        "from [[1, 10], [2, null], [3, 30], [4, null]] as t(i, v) add lag(v) ignore nulls over (order by i) as p, last_value(v) ignore nulls over (order by i) as l, first_value(v) over (order by i desc) as f",
        "select *, lag(v ignore nulls) over (order by i) as p, last_value(v ignore nulls) over (order by i) as l, first_value(v) over (order by i desc) as f from (values (1::bigint, 10::bigint), (2, null), (3, 30), (4, null)) t(i, v)",
    ),
    "win_rows_frames": (
        "from orders add sum(o_shippriority) over (partition by o_custkey order by o_orderkey rows [-1, 1]) as near, o_shippriority.sum() over (partition by o_custkey order by o_orderkey rows [,0]) as upto select o_orderkey, near, upto".replace("o_shippriority", "o_orderkey"),
        "select o_orderkey, sum(o_orderkey) over (partition by o_custkey order by o_orderkey rows between 1 preceding and 1 following)::bigint as near, sum(o_orderkey) over (partition by o_custkey order by o_orderkey rows unbounded preceding)::bigint as upto from orders",
    ),
    "win_range_frame": (
        "from lineitem add count(*) over (partition by l_suppkey order by l_orderkey range between 100 preceding and 100 following) as near select l_orderkey, l_linenumber, near",
        "select l_orderkey, l_linenumber, count(*) over (partition by l_suppkey order by l_orderkey range between 100 preceding and 100 following) as near from lineitem",
    ),
    "win_sum_over_group": (
        "from lineitem group by l_returnflag, l_linestatus agg l_linenumber.sum as s add (s * 100 / s.sum() over (partition by l_returnflag)).round(6) as share",
        "select l_returnflag, l_linestatus, sum(l_linenumber)::bigint as s, round(sum(l_linenumber) * 100.0::double / sum(sum(l_linenumber)) over (partition by l_returnflag), 6) as share from lineitem group by l_returnflag, l_linestatus",
    ),
    "win_over_aggregate": (
        "from orders group by o_custkey select o_custkey, _.count as n, rank() over (order by _.count desc, o_custkey) as r",
        "select o_custkey, count(*) as n, rank() over (order by count(*) desc, o_custkey)::int as r from orders group by o_custkey",
    ),
    "win_filter_topn": (
        "from orders add row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r where r <= 2 select o_custkey, o_orderkey, r",
        "select o_custkey, o_orderkey, r from (select *, (row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey))::int as r from orders) where r <= 2",
    ),
    "win_percent_cume": (
        "from nation add percent_rank() over (order by n_regionkey) as p, cume_dist() over (order by n_regionkey) as c, nth_value(n_name, 2) over (partition by n_regionkey order by n_nationkey rows [,]) as second select n_nationkey, p, c, second",
        "select n_nationkey, percent_rank() over (order by n_regionkey) as p, cume_dist() over (order by n_regionkey) as c, nth_value(n_name, 2) over (partition by n_regionkey order by n_nationkey rows between unbounded preceding and unbounded following) as second from nation",
    ),
    "win_global_rank": (
        """from lineitem add part = if l_linenumber = 7 then null else l_partkey
add rank() over (order by part desc) as r, dense_rank() over (order by part desc) as d, row_number() over (order by part desc, l_orderkey, l_linenumber, l_partkey, l_suppkey) as i,
  percent_rank() over (order by part desc) as p, cume_dist() over (order by part desc) as c, ntile(7) over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as q
select l_orderkey, l_linenumber, r, d, i, p, c, q""",
        """select l_orderkey, l_linenumber, rank() over (order by part desc nulls last)::int as r, dense_rank() over (order by part desc nulls last)::int as d,
row_number() over (order by part desc nulls last, l_orderkey, l_linenumber, l_partkey, l_suppkey)::int as i, percent_rank() over (order by part desc nulls last) as p, cume_dist() over (order by part desc nulls last) as c,
ntile(7) over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey)::int as q from (select *, if(l_linenumber = 7, null, l_partkey) as part from lineitem)""",
    ),
    "win_global_running": (
        """from lineitem add n = if l_linenumber = 3 then null else l_partkey
select l_orderkey, l_linenumber, sum(n) over (order by l_shipdate) as s, count(n) over (order by l_shipdate) as k, avg(n) over (order by l_shipdate desc) as a,
  min(l_extendedprice) over (order by l_shipdate) as least, max(l_extendedprice) over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey rows [,0]) as most, l_partkey.sum() over () as total""",
        """select l_orderkey, l_linenumber, sum(n) over (order by l_shipdate)::bigint as s, count(n) over (order by l_shipdate) as k, avg(n) over (order by l_shipdate desc) as a,
min(l_extendedprice) over (order by l_shipdate) as least, max(l_extendedprice) over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey rows unbounded preceding) as most, (sum(l_partkey) over ())::bigint as total
from (select *, if(l_linenumber = 3, null, l_partkey) as n from lineitem)""",
    ),
    "win_global_lag": (
        """from lineitem add n = if l_linenumber = 2 then null else l_partkey
select l_orderkey, l_linenumber, lag(n) over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as before, lead(n, 3, -l_orderkey) over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as after,
  lag(l_partkey, 40) over (order by l_orderkey desc, l_linenumber, l_partkey, l_suppkey) as far, sum(n) over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey rows [-2, 1]) as near""",
        """select l_orderkey, l_linenumber, lag(n) over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as before, lead(n, 3, -l_orderkey) over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as after,
lag(l_partkey, 40) over (order by l_orderkey desc, l_linenumber, l_partkey, l_suppkey) as far, (sum(n) over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey rows between 2 preceding and 1 following))::bigint as near
from (select *, if(l_linenumber = 2, null, l_partkey) as n from lineitem)""",
    ),
    # ---------------------------------------------------------- sort, limit, sets
    "order_nulls_last": (
        "from [[1, 5], [2, null], [3, 7]] as t(i, v) order by v desc, i limit 2",
        "select * from (values (3::bigint, 7::bigint), (1, 5)) t(i, v)",
    ),
    "order_ordinal": ("from nation select n_regionkey, n_name order by 1 desc, 2 limit 7", "select n_regionkey, n_name from nation order by 1 desc, 2 limit 7"),
    "topk": ("from orders order by o_totalprice desc, o_orderkey limit 25 select o_orderkey, o_totalprice", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25"),
    "limit_then_filter": (
        "from orders order by o_orderkey limit 100 where o_orderstatus = 'F' select o_orderkey",
        "select o_orderkey from (select * from orders order by o_orderkey limit 100) where o_orderstatus = 'F'",
    ),
    "limit_then_count": ("from orders limit 30 count", "select 30::bigint as \"count\""),
    "offset": ("from customer select c_custkey order by c_custkey offset 20 limit 10", "select c_custkey from customer order by c_custkey limit 10 offset 20"),
    "sort_hints": ("from nation select n_regionkey, n_name cluster by n_regionkey", "select n_regionkey, n_name from nation"),
    "concat_all": (
        "from nation select n_nationkey as k, n_name as name concat { from region select r_regionkey, r_name }",
        "select n_nationkey as k, n_name as name from nation union all select r_regionkey, r_name from region",
    ),
    "union_distinct": ("from lineitem select l_returnflag as f union { from lineitem select l_linestatus }", "select l_returnflag as f from lineitem union select l_linestatus from lineitem"),
    "dedup": ("from lineitem select l_returnflag, l_linestatus dedup", "select distinct l_returnflag, l_linestatus from lineitem"),
    "select_distinct": ("from orders select distinct o_orderpriority, o_orderstatus", "select distinct o_orderpriority, o_orderstatus from orders"),
    "intersect_set": (
        "from orders select o_custkey intersect { from customer where c_acctbal > 0 select c_custkey }",
        "select o_custkey from orders intersect select c_custkey from customer where c_acctbal > 0",
    ),
    "intersect_bag": (
        "from lineitem where l_quantity > 30 select l_suppkey intersect all { from lineitem where l_discount > 0.05 select l_suppkey }",
        "select l_suppkey from lineitem where l_quantity > 30 intersect all select l_suppkey from lineitem where l_discount > 0.05",
    ),
    "except_set": ("from customer select c_custkey except { from orders select o_custkey }", "select c_custkey from customer except select o_custkey from orders"),
    "except_bag": (
        "from lineitem select l_linenumber except all { from lineitem where l_quantity > 10 select l_linenumber }",
        "select l_linenumber from lineitem except all select l_linenumber from lineitem where l_quantity > 10",
    ),
    "sample_rows": ("from lineitem sample 100", None),
    "sample_percent": ("from lineitem sample bernoulli(10%)", None),
    # ------------------------------------------------------------------ scalars
    "str_methods": (
        "from part select p_partkey, p_name.length as n, p_name.trim as t, p_name.substring(2, 3) as s, upper(p_brand) as u, p_type.like('%STEEL%') as steel, replace(p_name, ' ', '_') as r",
        "select p_partkey, length(p_name) as n, trim(p_name) as t, substring(p_name, 2, 3) as s, upper(p_brand) as u, p_type like '%STEEL%' as steel, replace(p_name, ' ', '_') as r from part",
    ),
    "str_interpolation": ("from nation select s\"${n_name} in ${n_regionkey}\" as t, n_name + '!' as bang", "select n_name || ' in ' || n_regionkey as t, n_name || '!' as bang from nation"),
    "str_concat_null": ("from [['a', null], ['b', 'c']] as t(x, y) select concat(x, y) as c, x || y as p", "select concat(x, y) as c, x || y as p from (values ('a', null), ('b', 'c')) t(x, y)"),
    "regexp": (
        "from customer select c_custkey, c_name.regexp_like('0[1-5]$') as hit, regexp_replace(c_name, '[0-9]', '#') as first_one, regexp_replace(c_name, '[0-9]', '#', 'g') as every",
        "select c_custkey, regexp_matches(c_name, '0[1-5]$') as hit, regexp_replace(c_name, '[0-9]', '#') as first_one, regexp_replace(c_name, '[0-9]', '#', 'g') as every from customer",
    ),
    "like_escape": ("from [['a%b'], ['axb']] as t(s) where s like 'a!%b' escape '!'", "select 'a%b' as s"),
    "case_if": (
        "from part select p_partkey, size = if p_size > 40 then 'L' else if p_size > 20 then 'M' else 'S', kind = case p_size when 1 then 'one' when 2 then 'two' else 'more'",
        "select p_partkey, case when p_size > 40 then 'L' when p_size > 20 then 'M' else 'S' end as size, case p_size when 1 then 'one' when 2 then 'two' else 'more' end as kind from part",
    ),
    "cast_rounding": (
        "from [[2.5, 4.8], [3.5, -1.5]] as t(d, e) select d::int as a, d.to_double.to_int as b, e.to_double::long as c, '12'::int as s, d.to_double.to_string as t",
        "select d::bigint as a, d::double::bigint as b, e::double::bigint as c, 12::bigint as s, d::double::varchar as t from (values (2.5, 4.8), (3.5, -1.5)) t(d, e)",
    ),
    "division": (
        "from [[7, 2], [-7, 2], [1, 0], [-1, 0]] as t(a, b) select a, b, a / b as q, a % 5 as m",
        "select a::bigint as a, b::bigint as b, case when b = 0 then case when a > 0 then 'inf'::double else '-inf'::double end else a / b end as q, (a % 5)::bigint as m from (values (7, 2), (-7, 2), (1, 0), (-1, 0)) t(a, b)",
    ),
    "null_safe_eq": (
        "from [[1, 1], [1, null], [null, null]] as t(a, b) select a is not distinct from b as same, a is distinct from b as other",
        "select a is not distinct from b as same, a is distinct from b as other from (values (1, 1), (1, null), (null, null)) t(a, b)",
    ),
    "between_in": (
        "from part where p_size between 10 and 20 and p_size.in(11, 13, 17) and !p_brand.in('Brand#11') and p_retailprice.between(900, 1500) select p_partkey, p_size",
        "select p_partkey, p_size from part where p_size in (11, 13, 17) and p_brand not in ('Brand#11') and p_retailprice between 900 and 1500",
    ),
    "date_extract": (
        "from orders select o_orderkey, o_orderdate.extract('year') as y, extract('month', o_orderdate) as m, o_orderdate.extract('dow') as w, o_orderdate.extract('doy') as d",
        "select o_orderkey, extract(year from o_orderdate) as y, extract(month from o_orderdate) as m, extract(dow from o_orderdate) as w, extract(doy from o_orderdate) as d from orders",
    ),
    "interval_arith": (
        "from orders where o_orderdate >= '1995-01-01'::date and o_orderdate < '1995-01-01'::date + '3 months':interval select o_orderkey, o_orderdate + '1 day':interval as next_day",
        "select o_orderkey, o_orderdate + interval 1 day as next_day from orders where o_orderdate >= date '1995-01-01' and o_orderdate < date '1995-04-01'",
    ),
    "json_props": (
        "from events select event_id, json_extract_string(props, '$.k').to_int as k where k > 50",
        "select event_id, (props->>'$.k')::bigint as k from events where (props->>'$.k')::bigint > 50",
    ),
    "json_object": ("from region select json_object('k', r_regionkey, 'n', null) as j", "select json_object('k', r_regionkey, 'n', null)::varchar as j from region"),
    "array_ops": (
        "from embeddings select vec_id, embedding.size as n, embedding[1].to_double as first_one, embedding[-1].to_double as last_one, embedding[1000] as none_one",
        "select vec_id, len(embedding)::int as n, embedding[1]::double as first_one, embedding[-1]::double as last_one, embedding[1000] as none_one from embeddings",
    ),
    "map_struct": (
        "from nation select m = map {\"k\": n_nationkey}['k'], s = {a: n_name, b: n_regionkey}.a, arr = [n_nationkey, n_regionkey][2]",
        "select n_nationkey as m, n_name as s, n_regionkey as arr from nation",
    ),
    "lambda_transform_reduce": (
        "from nation select n_nationkey, list_transform([1, 2, n_nationkey], x -> x * 10) as tens, list_reduce([1, 2, n_nationkey], (a, b) -> a + b) as total",
        "select n_nationkey, [10, 20, n_nationkey * 10]::int[] as tens, 3 + n_nationkey as total from nation",
    ),
    "array_exclude": ("select [1, 2, 3, 2].exclude([2]) as rest", "select [1, 3]::int[] as rest"),
    "or_else": ("from [[1, null], [2, 'x']] as t(i, v) select i, v.or_else('none') as v", "select * from (values (1::bigint, 'none'), (2, 'x')) t(i, v)"),
    # -------------------------------------------------------------- composition
    "with_cte": (
        "with big as { from orders where o_totalprice > 300000 } with names(k, label) as [['F', 'finished'], ['O', 'open']] from big join names on o_orderstatus = names.k group by label agg _.count as n",
        "with big as (select * from orders where o_totalprice > 300000), names(k, label) as (values ('F', 'finished'), ('O', 'open')) select label, count(*) as n from big join names on o_orderstatus = k group by label",
    ),
    "model_param": (
        "model pricey(least: double, status: string = 'F') = { from orders where o_totalprice >= least and o_orderstatus = status }\nfrom pricey(350000) select o_orderkey",
        "select o_orderkey from orders where o_totalprice >= 350000 and o_orderstatus = 'F'",
    ),
    "nested_model": (
        "model open_orders = { from orders where o_orderstatus = 'O' }\nmodel by_customer(n: int) = { from open_orders group by o_custkey agg _.count as c where c >= n }\nfrom by_customer(n = 4)",
        "select o_custkey, count(*) as c from orders where o_orderstatus = 'O' group by o_custkey having count(*) >= 4",
    ),
    "select_as_reuse": (
        "from customer where c_acctbal < 0 select as in_debt\nfrom in_debt join nation on c_nationkey = n_nationkey group by n_name agg _.count as n",
        "select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey where c_acctbal < 0 group by n_name",
    ),
    "computed_table_name": (
        "from region where r_regionkey = 1 select as s`region_${1}`\nmodel pick(n: int) = { from s`region_${n}` }\nfrom pick(1)",
        "select * from region where r_regionkey = 1",
    ),
    "type_method": (
        "type lineitem = {\n l_extendedprice: double\n def net: double = l_extendedprice * (1 - l_discount)\n}\nfrom lineitem select l_orderkey, l_linenumber, _.net.round(4) as net",
        "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem",
    ),
    "user_function": (
        "def band(x: double, width: double = 1000.0): long = (x / width).floor\nfrom part group by band(p_retailprice, width = 500) as b agg _.count as n",
        "select floor(p_retailprice / 500)::bigint as b, count(*) as n from part group by 1",
    ),
    "debug_and_test": ("from region test _.size should be 5 debug { where r_regionkey = 1 test _.size should be 1 } where r_regionkey > 2", "select * from region where r_regionkey > 2"),
    # ---------------------------------------------------------- flow-style TPC-H
    "flow_q1": (
        """from lineitem
where l_shipdate <= '1998-09-02'::date
group by l_returnflag, l_linestatus
select
  l_returnflag, l_linestatus,
  sum_qty = l_quantity.sum,
  sum_base_price = l_extendedprice.sum.round(4),
  sum_disc_price = (l_extendedprice * (1 - l_discount)).sum.round(4),
  sum_charge = (l_extendedprice * (1 - l_discount) * (1 + l_tax)).sum.round(4),
  avg_qty = l_quantity.avg.round(6),
  avg_price = l_extendedprice.avg.round(6),
  avg_disc = l_discount.avg.round(6),
  count_order = _.count
order by l_returnflag, l_linestatus""",
        """select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 4) as sum_base_price,
round(sum(l_extendedprice * (1 - l_discount)), 4) as sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 4) as sum_charge,
round(avg(l_quantity), 6) as avg_qty, round(avg(l_extendedprice), 6) as avg_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order
from lineitem where l_shipdate <= date '1998-09-02' group by all order by 1, 2""",
    ),
    "flow_q3": (
        """from customer, orders, lineitem
where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey
  and o_orderdate < '1995-03-15'::date and l_shipdate > '1995-03-15'::date
group by l_orderkey, o_orderdate
select l_orderkey, revenue = (l_extendedprice * (1 - l_discount)).sum.round(4), o_orderdate
order by revenue desc, o_orderdate, l_orderkey
limit 10""",
        """select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue, o_orderdate from customer, orders, lineitem
where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate < date '1995-03-15' and l_shipdate > date '1995-03-15'
group by l_orderkey, o_orderdate order by revenue desc, o_orderdate, l_orderkey limit 10""",
    ),
    "flow_q5": (
        """from customer, orders, lineitem, supplier, nation, region
where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey
  and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA'
group by n_name
select n_name, revenue = (l_extendedprice * (1 - l_discount)).sum.round(4)
order by revenue desc""",
        """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from customer, orders, lineitem, supplier, nation, region
where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey
and n_regionkey = r_regionkey and r_name = 'ASIA' group by n_name order by revenue desc""",
    ),
    "flow_q6": (
        "from lineitem where l_shipdate >= '1994-01-01'::date and l_shipdate < '1995-01-01'::date and l_discount between 0.05 and 0.07 and l_quantity < 24 select revenue = (l_extendedprice * l_discount).sum.round(4)",
        "select round(sum(l_extendedprice * l_discount), 4) as revenue from lineitem where l_shipdate >= date '1994-01-01' and l_shipdate < date '1995-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24",
    ),
    "flow_q7": (
        """from {
  from supplier, lineitem, orders, customer, nation as n1, nation as n2
  where s_suppkey = l_suppkey and o_orderkey = l_orderkey and c_custkey = o_custkey
    and s_nationkey = n1.n_nationkey and c_nationkey = n2.n_nationkey and n1.n_regionkey < n2.n_regionkey
  select supp_nation = n1.n_name, cust_nation = n2.n_name, l_year = l_shipdate.extract('year'), volume = l_extendedprice * (1 - l_discount)
} as shipping
group by supp_nation, cust_nation, l_year
select supp_nation, cust_nation, l_year, revenue = volume.sum.round(4)""",
        """select n1.n_name as supp_nation, n2.n_name as cust_nation, extract(year from l_shipdate) as l_year, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue
from supplier, lineitem, orders, customer, nation n1, nation n2 where s_suppkey = l_suppkey and o_orderkey = l_orderkey and c_custkey = o_custkey
and s_nationkey = n1.n_nationkey and c_nationkey = n2.n_nationkey and n1.n_regionkey < n2.n_regionkey group by all""",
    ),
    "flow_q10": (
        """from customer, orders, lineitem, nation
where c_custkey = o_custkey and l_orderkey = o_orderkey and l_returnflag = 'R' and c_nationkey = n_nationkey
group by c_custkey, c_name, c_acctbal, n_name
select c_custkey, c_name, revenue = (l_extendedprice * (1 - l_discount)).sum.round(4), c_acctbal, n_name
order by revenue desc, c_custkey
limit 20""",
        """select c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue, c_acctbal, n_name from customer, orders, lineitem, nation
where c_custkey = o_custkey and l_orderkey = o_orderkey and l_returnflag = 'R' and c_nationkey = n_nationkey
group by all order by revenue desc, c_custkey limit 20""",
    ),
    "flow_q4": (
        """from orders
where o_orderdate >= '1994-01-01'::date and o_orderdate < '1996-01-01'::date
where exists { from lineitem where l_orderkey = o_orderkey and l_shipdate > o_orderdate and l_returnflag = 'R' }
group by o_orderpriority agg _.count as n order by o_orderpriority""",
        """select o_orderpriority, count(*) as n from orders where o_orderdate >= date '1994-01-01' and o_orderdate < date '1996-01-01'
and exists (select * from lineitem where l_orderkey = o_orderkey and l_shipdate > o_orderdate and l_returnflag = 'R') group by o_orderpriority""",
    ),
    "flow_q8": (
        """from {
  from part, supplier, lineitem, orders, customer, nation as n1, nation as n2, region
  where p_partkey = l_partkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_custkey = c_custkey
    and c_nationkey = n1.n_nationkey and n1.n_regionkey = r_regionkey and s_nationkey = n2.n_nationkey and r_regionkey = 1
  select o_orderdate.extract('year') as o_year, l_extendedprice * (1 - l_discount) as volume, n2.n_nationkey as nation
}
group by o_year
agg ((if nation = 3 then volume else 0.0).sum / volume.sum).round(6) as share
order by o_year""",
        """select extract(year from o_orderdate) as o_year, round(sum(case when n2.n_nationkey = 3 then l_extendedprice * (1 - l_discount) else 0.0 end) / sum(l_extendedprice * (1 - l_discount)), 6) as share
from part, supplier, lineitem, orders, customer, nation n1, nation n2, region
where p_partkey = l_partkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_custkey = c_custkey
and c_nationkey = n1.n_nationkey and n1.n_regionkey = r_regionkey and s_nationkey = n2.n_nationkey and r_regionkey = 1 group by 1""",
    ),
    "flow_q13": (
        """from {
  from customer left join { from orders where o_orderpriority != '1-URGENT' } as o on c_custkey = o.o_custkey
  group by c_custkey agg count(o.o_orderkey) as c_count
}
group by c_count agg _.count as custdist order by custdist desc, c_count desc""",
        """select c_count, count(*) as custdist from (select c_custkey, count(o_orderkey) as c_count from customer
left join orders on c_custkey = o_custkey and o_orderpriority <> '1-URGENT' group by c_custkey) group by c_count""",
    ),
    "flow_q15": (
        """with revenue as {
  from lineitem where l_shipdate >= '1996-01-01'::date and l_shipdate < '1997-01-01'::date
  group by l_suppkey agg (l_extendedprice * (1 - l_discount)).sum.round(4) as total
}
from supplier join revenue on s_suppkey = revenue.l_suppkey
where total = { from revenue select total.max as m }
select s_suppkey, s_name, total""",
        """with revenue as (select l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 4) as total from lineitem
where l_shipdate >= date '1996-01-01' and l_shipdate < date '1997-01-01' group by l_suppkey)
select s_suppkey, s_name, total from supplier join revenue on s_suppkey = l_suppkey where total = (select max(total) from revenue)""",
    ),
    "flow_q17": (
        """from lineitem, part
where p_partkey = l_partkey and p_size < 20
where l_quantity < { from lineitem as other where other.l_partkey = p_partkey select 0.5 * other.l_quantity.avg }
select (l_extendedprice.sum / 7.0).round(4) as avg_yearly""",
        """select round(sum(l_extendedprice) / 7.0, 4) as avg_yearly from lineitem, part where p_partkey = l_partkey and p_size < 20
and l_quantity < (select 0.5 * avg(o.l_quantity) from lineitem o where o.l_partkey = p_partkey)""",
    ),
    "flow_q19": (
        """from lineitem, part
where p_partkey = l_partkey
where (p_size between 1 and 5 and l_quantity between 1 and 11) or (p_size between 10 and 15 and l_quantity between 10 and 20) or (p_size between 30 and 40 and l_linenumber in (1, 2))
select (l_extendedprice * (1 - l_discount)).sum.round(2) as revenue""",
        """select round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem, part where p_partkey = l_partkey
and ((p_size between 1 and 5 and l_quantity between 1 and 11) or (p_size between 10 and 15 and l_quantity between 10 and 20) or (p_size between 30 and 40 and l_linenumber in (1, 2)))""",
    ),
    "flow_q12": (
        """from orders, lineitem
where o_orderkey = l_orderkey and l_shipdate >= '1994-01-01'::date and l_shipdate < '1996-01-01'::date
group by l_linestatus
select l_linestatus,
  high = (if o_orderpriority = '1-URGENT' or o_orderpriority = '2-HIGH' then 1 else 0).sum,
  low = (if o_orderpriority != '1-URGENT' and o_orderpriority != '2-HIGH' then 1 else 0).sum""",
        """select l_linestatus, sum(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end)::bigint as high,
sum(case when o_orderpriority not in ('1-URGENT', '2-HIGH') then 1 else 0 end)::bigint as low from orders, lineitem
where o_orderkey = l_orderkey and l_shipdate >= date '1994-01-01' and l_shipdate < date '1996-01-01' group by l_linestatus""",
    ),
    "flow_q14": (
        """from lineitem, part
where l_partkey = p_partkey and l_shipdate >= '1995-01-01'::date and l_shipdate < '1996-01-01'::date
select promo = (100.00 * (if p_type.like('PROMO%') then l_extendedprice * (1 - l_discount) else 0.0).sum / (l_extendedprice * (1 - l_discount)).sum).round(6)""",
        """select round(100.00 * sum(case when p_type like 'PROMO%' then l_extendedprice * (1 - l_discount) else 0.0 end) / sum(l_extendedprice * (1 - l_discount)), 6) as promo
from lineitem, part where l_partkey = p_partkey and l_shipdate >= date '1995-01-01' and l_shipdate < date '1996-01-01'""",
    ),
    "flow_q18": (
        """from customer, orders, lineitem
where o_orderkey.in(from lineitem group by l_orderkey where l_quantity.sum > 250 select l_orderkey)
  and c_custkey = o_custkey and o_orderkey = l_orderkey
group by c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice
select c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, quantity = l_quantity.sum
order by o_totalprice desc, o_orderdate, o_orderkey
limit 100""",
        """select c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) as quantity from customer, orders, lineitem
where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 250) and c_custkey = o_custkey and o_orderkey = l_orderkey
group by all order by o_totalprice desc, o_orderdate, o_orderkey limit 100""",
    ),
    "flow_q21": (
        """from supplier, lineitem as l1, orders, nation
where s_suppkey = l1.l_suppkey and o_orderkey = l1.l_orderkey and o_orderstatus = 'F'
  and exists { from lineitem as l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey != l1.l_suppkey }
  and not exists { from lineitem as l3 where l3.l_orderkey = l1.l_orderkey and l3.l_suppkey != l1.l_suppkey and l3.l_quantity > l1.l_quantity }
  and s_nationkey = n_nationkey
group by s_name
select s_name, numwait = count(*)
order by numwait desc, s_name""",
        """select s_name, count(*) as numwait from supplier, lineitem l1, orders, nation where s_suppkey = l1.l_suppkey and o_orderkey = l1.l_orderkey and o_orderstatus = 'F'
and exists (select 1 from lineitem l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey != l1.l_suppkey)
and not exists (select 1 from lineitem l3 where l3.l_orderkey = l1.l_orderkey and l3.l_suppkey != l1.l_suppkey and l3.l_quantity > l1.l_quantity)
and s_nationkey = n_nationkey group by s_name""",
    ),
    "flow_q22": (
        """from customer
where c_acctbal > { from customer where c_acctbal > 0.00 select c_acctbal.avg }
  and not exists { from orders where o_custkey = c_custkey }
group by c_nationkey
select c_nationkey, numcust = _.count, total = c_acctbal.sum.round(4)""",
        """select c_nationkey, count(*) as numcust, round(sum(c_acctbal), 4) as total from customer where c_acctbal > (select avg(c_acctbal) from customer where c_acctbal > 0.00)
and not exists (select 1 from orders where o_custkey = c_custkey) group by c_nationkey""",
    ),
}

#: SQL text through the front door, and the same for DuckDB
SQLS: dict[str, tuple[str, str]] = {
    "sql_array_agg_order": (
        "select n_regionkey, array_join(array_agg(n_name order by n_name desc), ',') as names, array_join(array_agg(n_nationkey order by length(n_name), n_name), ',') as keys from nation group by n_regionkey",
        "select n_regionkey, array_to_string(array_agg(n_name order by n_name desc), ',') as names, array_to_string(array_agg(n_nationkey order by length(n_name), n_name), ',') as keys from nation group by n_regionkey",
    ),
    "sql_int_div": ("select o_orderkey, o_orderkey // 7 as q, 'a // b' as t from orders", "select o_orderkey, o_orderkey // 7 as q, 'a // b' as t from orders"),
    "sql_array_literal": (
        "select n_nationkey, [n_nationkey, n_regionkey][1] as a, ARRAY[ARRAY[1, n_regionkey], [3]][0][1] as b, size([[1, 2], [3]]) as c from nation",
        "select n_nationkey, n_regionkey as a, n_regionkey as b, 2::int as c from nation",
    ),
    "sql_from_unnest": ("select x, x * 2 as y from unnest(ARRAY[1, 2, 3]) as t(x)", "select x, x * 2 as y from unnest([1, 2, 3]) as t(x)"),
    "sql_literal_untouched": (
        "select n_nationkey, 'a varchar array[1] arbitrary(x) -- from region' as t, cast(n_nationkey as varchar) as k from nation -- no table here",
        "select n_nationkey, 'a varchar array[1] arbitrary(x) -- from region' as t, cast(n_nationkey as varchar) as k from nation",
    ),
    "sql_rows_between": (
        "select o_orderkey, sum(o_orderkey) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row) as s from orders",
        "select o_orderkey, sum(o_orderkey) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row)::bigint as s from orders",
    ),
    "sql_rlike_distinct_from": ("select p_partkey from part where p_type rlike 'STEEL$' and p_size is distinct from 10", "select p_partkey from part where regexp_matches(p_type, 'STEEL$') and p_size is distinct from 10"),
    "sql_typed_literals": (
        "select o_orderkey from orders where o_orderdate >= date '1995-01-01' and o_orderdate < date '1995-01-01' + interval '3' month",
        "select o_orderkey from orders where o_orderdate >= date '1995-01-01' and o_orderdate < date '1995-01-01' + interval 3 month",
    ),
    "sql_grouping_sets": (
        "select l_returnflag, l_linestatus, count(*) as n, cast(grouping(l_returnflag) as bigint) as g from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())",
        "select l_returnflag, l_linestatus, count(*) as n, grouping(l_returnflag)::bigint as g from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())",
    ),
    "sql_rollup": ("select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup(o_orderstatus, o_orderpriority)",) * 2,
    "sql_cube": ("select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube(o_orderstatus, o_orderpriority)",) * 2,
    "sql_filter_clause": ("select o_orderstatus, count(*) filter (where o_totalprice > 100000) as n from orders group by o_orderstatus",) * 2,
    "sql_recursive_cte": ("with recursive t(n) as (select 1 union all select n + 1 from t where n < 20) select n from t",) * 2,
    "recursive_reach": (
        """with recursive edges as (select o_custkey as a, o_orderkey % 1000 + 1 as b from orders where o_totalprice > 150000),
reach(node) as (select c_custkey from customer where c_mktsegment = 'BUILDING' and c_nationkey = 7 union select b from reach join edges on a = node)
select node, c_nationkey from reach left join customer on c_custkey = node""",
    )
    * 2,
    "recursive_chain": (
        """with recursive walk(k, hops, path) as (select min(c_custkey), 0, 'start, union all' from customer
union all select c_custkey, hops + 1, c_mktsegment from walk join customer on c_custkey = k + 1 where hops < 130)
select k, hops, path from walk""",
    )
    * 2,
    "sql_array_agg_mixed": (
        """select o_custkey, array_join(array_agg(o_orderkey order by o_orderstatus desc, o_orderpriority asc, o_orderkey desc), ',') as keys,
array_join(array_agg(o_orderkey order by nullif(o_orderstatus, 'F') nulls first, o_totalprice desc, o_orderkey), ',') as first from orders group by o_custkey""",
        """select o_custkey, array_to_string(array_agg(o_orderkey order by o_orderstatus desc, o_orderpriority asc, o_orderkey desc), ',') as keys,
array_to_string(array_agg(o_orderkey order by nullif(o_orderstatus, 'F') nulls first, o_totalprice desc, o_orderkey), ',') as first from orders group by o_custkey""",
    ),
    "sql_at_time_zone": (
        """select event_type, cast(min(ts at time zone 'America/New_York') as timestamp_ntz) as first, cast(max((ts + interval '1' hour) at time zone 'Asia/Tokyo') as timestamp_ntz) as last,
cast(timestamp '2024-07-01 00:00:00' at time zone 'Europe/Berlin' as timestamp_ntz) as fixed from events group by event_type""",
        """select event_type, min(ts at time zone 'America/New_York') at time zone 'UTC' as first, max((ts + interval 1 hour) at time zone 'Asia/Tokyo') at time zone 'UTC' as last,
(timestamp '2024-07-01 00:00:00' at time zone 'Europe/Berlin') at time zone 'UTC' as fixed from events group by event_type""",
    ),
    "sql_json_nested": (
        """select n_nationkey, json_object('sum' : (n_nationkey + (n_regionkey * 2)), key 'name' value concat(n_name, ': (', 'x'), 'in' : json_object('k' : upper(n_name), 'none' : nullif(1, 1)) null on null) as j,
json_object(key 'a' value nullif(n_regionkey, 1), key 'b' value ARRAY[n_regionkey, 7] absent on null) as g from nation""",
        """select n_nationkey, json_object('sum', n_nationkey + n_regionkey * 2, 'name', n_name || ': (x', 'in', json_object('k', upper(n_name), 'none', null))::varchar as j,
case when n_regionkey = 1 then '{"b":[1,7]}' else json_object('a', n_regionkey, 'b', [n_regionkey, 7])::varchar end as g from nation""",
    ),
    "sql_window_ignore_nulls": (
        "select i, lag(v) ignore nulls over (order by i) as p from values (1, 10), (2, null), (3, 30) as t(i, v)",
        "select i, lag(v ignore nulls) over (order by i) as p from (values (1, 10), (2, null), (3, 30)) t(i, v)",
    ),
    "sql_unnest": (
        "select vec_id, x from embeddings cross join unnest(embedding) as t(x)",
        "select vec_id, unnest(embedding) as x from embeddings",
    ),
    "sql_unnest_ordinality": (
        "select vec_id, x, i from embeddings cross join unnest(embedding) with ordinality as t(x, i)",
        "select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1)::bigint as i from embeddings",
    ),
    "sql_lateral_view": ("select k, v from (select 1 as k, array(10, 20) as a) t lateral view explode(a) e as v", "select * from (values (1, 10), (1, 20)) t(k, v)"),
    "sql_lateral_join": (
        "select r_name, n from region, lateral (select count(*) as n from nation where n_regionkey = r_regionkey) x",
        "select r_name, n from region, lateral (select count(*) as n from nation where n_regionkey = r_regionkey) x",
    ),
    "sql_natural_join": ("select * from (select r_regionkey as k, r_name from region) a natural join (select n_regionkey as k, n_name from nation) b",) * 2,
    "sql_json_object": (
        "select r_regionkey, json_object(key 'k' value r_regionkey, key 'v' value null absent on null) as j from region",
        "select r_regionkey, '{\"k\":' || r_regionkey || '}' as j from region",
    ),
    "sql_trim_map": (
        "select trim(leading '0' from '0012') as t, map(array['a', 'b'], array[1, 2])['b'] as b",
        "select '12' as t, 2 as b",
    ),
}


def flow(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(spark, sf_dir).query(FLOWS[name][0])


def sql(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(spark, sf_dir).sql(SQLS[name][0])


# Sinks and streams ---------------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share."""
    import tempfile
    import uuid

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/sluice-{uuid.uuid4().hex}"


def save_then_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_scratch(spark)}/saved.parquet"
    engine = Engine(spark, sf_dir)
    engine.run(f"from nation where n_regionkey < 3 save to '{path}' with compression: 'zstd'")
    return engine.query(f"from '{path}'")


def append_then_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_scratch(spark)}/grown.parquet"
    engine = Engine(spark, sf_dir)
    engine.run(f"from nation where n_regionkey = 0 append to '{path}'\nfrom nation where n_regionkey = 1 append to '{path}'")
    return engine.query(f"from '{path}'")


def delete_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_scratch(spark)}/thinned.parquet"
    engine = Engine(spark, sf_dir)
    engine.run(f"from customer save to '{path}'\nfrom '{path}' where c_acctbal < 0 where c_nationkey > 5 delete")
    return engine.query(f"from '{path}'")


def csv_then_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_scratch(spark)}/saved.csv"
    engine = Engine(spark, sf_dir)
    engine.run(f"from supplier select s_suppkey, s_name, s_nationkey save to '{path}'")
    return engine.query(f"from '{path}' where s_nationkey < 10")


def json_then_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_scratch(spark)}/saved.json.gz"
    engine = Engine(spark, sf_dir)
    engine.run(f"from customer select c_custkey, c_name, c_mktsegment save to '{path}'")
    return engine.query(f"from '{path}' where c_mktsegment = 'BUILDING'")


def _named(name: str) -> str:
    import uuid

    return f"{name}_{uuid.uuid4().hex[:8]}"


def table_save_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, engine = _named("grown"), Engine(spark, sf_dir)
    engine.run(f"from nation where n_regionkey = 0 save to {t}\nfrom nation where n_regionkey = 1 append to {t}")
    return engine.query(f"from {t} select n_nationkey, n_name")


def sql_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, engine = _named("changed"), Engine(spark, sf_dir)
    engine.sql(f"create or replace table {t} as select n_nationkey as k, n_name as name, n_regionkey as r from nation")
    engine.sql(f"update {t} set name = concat(name, ', set'), r = r + 10 where r = 2")
    engine.sql(f"insert into {t} values (100, 'new', 7)")
    engine.sql(f"delete from {t} where k < 3")
    return engine.sql(f"select * from {t}")


def sql_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, engine = _named("merged"), Engine(spark, sf_dir)
    engine.sql(f"create or replace table {t} as select n_nationkey as k, n_regionkey as r from nation where n_nationkey < 20")
    engine.sql(
        f"merge into {t} as t using (select n_nationkey as k, n_regionkey as r from nation where n_nationkey > 10) as s on t.k = s.k "
        "when matched and s.r = 3 then delete when matched then update set r = s.r + 100 when not matched then insert (k, r) values (s.k, s.r)"
    )
    return engine.sql(f"select * from {t}")


def sql_merge_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first clause that holds wins, of updates and deletes as of inserts."""
    t, engine = _named("merged"), Engine(spark, sf_dir)
    engine.sql(f"create or replace table {t} as select o_orderkey as k, o_orderstatus as s, o_totalprice as p from orders where o_orderkey % 3 > 0")
    engine.sql(
        f"""merge into {t} as t using (select o_orderkey as k, o_orderstatus as s, o_totalprice as p, 'when matched then where' as note from orders where o_orderkey % 2 = 0) as n on t.k = n.k
when matched and t.s = 'F' and t.p > 200000 then update set s = concat(n.note, case when t.p > 300000 then '!' else '' end), p = greatest(n.p, 1)
when matched and t.s = 'F' then delete
when matched and t.s = 'O' then update set p = -n.p
when matched then delete
when not matched and n.s = 'O' then insert (k, s) values (n.k, 'values (1, 2)')
when not matched and n.p > 100000 then insert values (n.k, n.s, n.p * (1 + 1))"""
    )
    return engine.sql(f"select * from {t}")


def sql_update_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, engine = _named("changed"), Engine(spark, sf_dir)
    engine.sql(f"create or replace table {t} as select c_custkey as k, c_name as s, c_acctbal as b from customer")
    engine.sql(f"update {t} set s = 'up where down, set x = 1' where k in (select o_custkey from orders where o_totalprice > 300000) and s != 'a where b'")
    engine.sql(f"update {t} as u set b = round(u.b * 2, 2), s = concat(u.s, ' -- no comment') where u.b < (select avg(c_acctbal) from customer)")
    engine.sql(f"delete from {t} as d where d.k % 7 = 0 or d.s = 'from x where y'")
    return engine.sql(f"select * from {t}")


def merge_touched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each priority in files of their own; a merge of one priority leaves the files of the others."""
    from sluice.sources import touched

    t, engine = _named("filed"), Engine(spark, sf_dir)
    for i, p in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")):
        head = f"create or replace table {t} as" if i == 0 else f"insert into {t}"
        engine.sql(f"{head} select o_orderkey as k, o_orderpriority as p, o_totalprice as v from orders where o_orderpriority = '{p}'")
    before = touched.numbered(spark, t).select(touched.FILE).distinct().withColumn("kept", F.lit(True)).collect()
    engine.sql(
        f"""merge into {t} as t using (select * from orders where o_orderpriority = '2-HIGH' and o_orderkey % 2 = 0) as o on t.k = o.o_orderkey
when matched and o.o_orderkey % 4 = 0 then delete when matched then update set v = 0"""
    )
    old = spark.createDataFrame(before, "_file string, kept boolean")
    rows = touched.numbered(spark, t).join(F.broadcast(old), touched.FILE, "left")
    return rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == 0).alias("changed"), F.bool_and(F.coalesce("kept", F.lit(False))).alias("kept"))


def sql_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, sf_dir)
    engine.sql("prepare by_region from select n_nationkey, 'why?' as t from nation where n_regionkey = ? and n_name > ?")
    return engine.sql("execute by_region using 1, 'B, ?'")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.streaming import subscribe as s

    events = s.as_stream(spark.read.parquet(f"{sf_dir}/events.parquet"))
    out = s.run_complete(s.windowed(events, "ts", "1d", [F.count(F.lit(1)).alias("n")], ["event_type"]), f"{_scratch(spark)}/daily")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("day"), "event_type", "n")


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.streaming import subscribe as s

    events = s.as_stream(spark.read.parquet(f"{sf_dir}/events.parquet"))
    out = s.run_complete(s.sessions(events, "ts", "12h", [F.count(F.lit(1)).alias("n")], ["user_id"]), f"{_scratch(spark)}/sessions")
    return out.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("started"), "n")


def stream_subscribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.streaming import subscribe as s

    scratch = _scratch(spark)
    events = Engine(spark, sf_dir, streaming=True).query("from events where event_type = 'purchase' select event_id, ts, user_id, value")
    out = s.subscribe(events, "ts", "1h", f"{scratch}/checkpoint", f"{scratch}/target")
    return out.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "value")


def _arriving(spark: SparkSession, sf_dir: str, each: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """All events in four instalments into one folder; ``each`` runs on the folder's stream after every one, and once more without new input."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = f"{_scratch(spark)}/arriving"
    out = None
    for i in range(5):
        if i < 4:
            events.where(F.col("event_id") % 4 == i).write.mode("append").parquet(folder)
        out = each(spark.readStream.schema(events.schema).parquet(folder), i)
    return out


def stream_incremental_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.streaming import subscribe as s

    target = f"{_scratch(spark)}/totals"
    value = [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("event_id").alias("last")]
    return _arriving(spark, sf_dir, lambda events, i: s.run_updates(events.groupBy("user_id", "event_type").agg(*value), ["user_id", "event_type"], target))


def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.streaming import subscribe as s

    scratch = _scratch(spark)

    def each(events: DataFrame, i: int) -> DataFrame:
        bought = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
        seen = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
        pairs = s.interval_join(bought, seen, ["user_id"], "ts", "view_ts", "6h", "30m", delay="60d")
        return s.run_available(pairs, f"{scratch}/checkpoint", f"{scratch}/pairs")

    return _arriving(spark, sf_dir, each).select("user_id", "event_id", "view_id")


def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.streaming import subscribe as s

    target = f"{_scratch(spark)}/split"

    def each(events: DataFrame, i: int) -> DataFrame:
        good, late = s.split_late(events, "ts", "20d", target)
        return good.select("event_id", F.lit(False).alias("late")).union(late.select("event_id", F.lit(True)))

    return _arriving(spark, sf_dir, each)


def cube_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 32 grouping sets of five keys, from the finest one."""
    from sluice.api import flow as start

    items = start(Engine(spark, sf_dir), "lineitem").add("y = l_shipdate.extract('year')", "b = l_quantity > 25")
    cube = items.cube("l_returnflag", "l_linestatus", "l_linenumber", "y", "b")
    return cube.agg("_.count as n", "l_quantity.sum as q", "l_extendedprice.max as top", "l_partkey.avg.round(4) as a").df()


CALLS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "save_then_read": (save_then_read, "select * from nation where n_regionkey < 3"),
    "append_then_read": (append_then_read, "select * from nation where n_regionkey < 2"),
    "csv_then_read": (csv_then_read, "select s_suppkey::bigint as s_suppkey, s_name, s_nationkey::bigint as s_nationkey from supplier where s_nationkey < 10"),
    "json_then_read": (json_then_read, "select c_custkey::bigint as c_custkey, c_name, c_mktsegment from customer where c_mktsegment = 'BUILDING'"),
    "table_save_append": (table_save_append, "select n_nationkey, n_name from nation where n_regionkey < 2"),
    "sql_update": (
        sql_update,
        """select n_nationkey as k, case when n_regionkey = 2 then n_name || ', set' else n_name end as name, case when n_regionkey = 2 then n_regionkey + 10 else n_regionkey end as r
from nation where n_nationkey >= 3 union all select 100, 'new', 7""",
    ),
    "sql_merge": (
        sql_merge,
        """select n_nationkey as k, case when n_nationkey > 10 and n_nationkey < 20 then n_regionkey + 100 else n_regionkey end as r
from nation where not (n_nationkey > 10 and n_nationkey < 20 and n_regionkey = 3)""",
    ),
    "sql_merge_clauses": (
        sql_merge_clauses,
        """select t.k, case when m and s = 'F' then 'when matched then where' || case when p > 300000 then '!' else '' end else s end as s,
case when m and s = 'F' then greatest(p, 1) when m then -p else p end as p
from (select o_orderkey as k, o_orderstatus as s, o_totalprice as p, o_orderkey % 2 = 0 as m from orders where o_orderkey % 3 > 0) t
where not (m and ((s = 'F' and p <= 200000) or s not in ('F', 'O')))
union all select o_orderkey, case when o_orderstatus = 'O' then 'values (1, 2)' else o_orderstatus end, case when o_orderstatus <> 'O' then o_totalprice * 2 end
from orders where o_orderkey % 2 = 0 and o_orderkey % 3 = 0 and (o_orderstatus = 'O' or o_totalprice > 100000)""",
    ),
    "sql_update_literal": (
        sql_update_literal,
        """with u as (select c_custkey as k, case when c_custkey in (select o_custkey from orders where o_totalprice > 300000) then 'up where down, set x = 1' else c_name end as s, c_acctbal as b from customer)
select k, case when b < (select avg(c_acctbal) from customer) then s || ' -- no comment' else s end as s, case when b < (select avg(c_acctbal) from customer) then round(b * 2, 2) else b end as b
from u where k % 7 <> 0""",
    ),
    "merge_touched_files": (
        merge_touched_files,
        """select o_orderpriority as p, count(*) as n, count(*) filter (where o_orderpriority = '2-HIGH' and o_orderkey % 2 = 0) as changed, o_orderpriority <> '2-HIGH' as kept
from orders where not (o_orderpriority = '2-HIGH' and o_orderkey % 4 = 0) group by o_orderpriority""",
    ),
    "sql_prepared": (sql_prepared, "select n_nationkey, 'why?' as t from nation where n_regionkey = 1 and n_name > 'B, ?'"),
    "delete_rewrite": (delete_rewrite, "select * from customer where not (c_acctbal < 0 and c_nationkey > 5)"),
    "stream_tumbling": (stream_tumbling, "select date_trunc('day', ts)::timestamp as day, event_type, count(*) as n from events group by all"),
    "stream_session": (
        stream_session,
        """select user_id, min(ts) as started, count(*) as n from (select *, sum(fresh) over (partition by user_id order by ts, event_id) as s from
(select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 12 hour then 0 else 1 end as fresh from events)) group by user_id, s""",
    ),
    "stream_incremental_agg": (stream_incremental_agg, "select user_id, event_type, count(*) as n, round(sum(value), 4) as total, max(event_id) as last from events group by user_id, event_type"),
    "stream_interval_join": (
        stream_interval_join,
        """select p.user_id, p.event_id, v.event_id as view_id from events p join events v on p.user_id = v.user_id and v.ts between p.ts - interval 6 hours and p.ts + interval 30 minutes
where p.event_type = 'purchase' and v.event_type = 'view'""",
    ),
    "stream_late_rows": (
        stream_late_rows,
        """with upto as (select event_id % 4 as batch, max(ts) as upto from events group by 1)
select event_id, coalesce(ts < (select max(upto) from upto where upto.batch < event_id % 4) - interval 20 days, false) as late from events""",
    ),
    "cube_lattice": (
        cube_lattice,
        """select l_returnflag, l_linestatus, l_linenumber, y, b, count(*) as n, sum(l_quantity) as q, max(l_extendedprice) as top, round(avg(l_partkey), 4) as a
from (select *, year(l_shipdate) as y, l_quantity > 25 as b from lineitem) group by cube (l_returnflag, l_linestatus, l_linenumber, y, b)""",
    ),
    "stream_subscribe": (stream_subscribe, "select event_id, ts, user_id, value from events where event_type = 'purchase'"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: flow(n) for n in FLOWS} | {n: sql(n) for n in SQLS} | {n: f for n, (f, _) in CALLS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q for n, (_, q) in FLOWS.items() if q} | {n: q for n, (_, q) in SQLS.items()} | {n: q for n, (_, q) in CALLS.items()}
