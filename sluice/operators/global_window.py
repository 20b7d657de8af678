"""Windows over one order without a partition, as many tasks.

Spark gathers such a window in a single task.  Here the order is cut into
ranges by splitters, quantiles of a bounded random sample of the order keys, and
rows of equal keys always share a range.  Windows run inside ranges; what a range
needs from the others is carried over a small table of one row per range:

* ranks and tiles add the rows (or the different keys) of earlier ranges;
* running aggregates add those ranges' aggregates;
* ``lag``, ``lead`` and frames of a bounded number of rows see copies of the
  neighbouring ranges' edge rows, which are dropped afterwards.

An aggregate over everything needs no order and is joined as a single row.
Rows of equal keys are told apart by a hash of all columns, so every pass sees
them in one sequence; rows that are equal throughout may stand for each other.
Ranks keep Spark's type, int: beyond 2**31 - 1 rows they are an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Ranges at most, sampled keys of a range, rows of a halo on either side, and bytes of a relation that one task may hold.
MOST_RANGES, SAMPLED, MOST_HALO, SMALL = 1024, 20, 128, 1 << 16
#: What tells rows of equal keys apart lies from -TIES to TIES - 1.
TIES = 1 << 62


@dataclass(frozen=True)
class Key:
    """An order key: a column and its direction."""

    column: Column
    desc: bool
    nulls_first: bool

    def reversed(self) -> Key:
        return Key(self.column, not self.desc, not self.nulls_first)

    def sorted(self) -> Column:
        if self.desc:
            return self.column.desc_nulls_first() if self.nulls_first else self.column.desc_nulls_last()
        return self.column.asc_nulls_first() if self.nulls_first else self.column.asc_nulls_last()

    def after(self, value: Column) -> Column:
        """Whether the key sorts strictly after a value that may be null."""
        x = self.column
        beyond = F.coalesce(x < value if self.desc else x > value, F.lit(False))
        return beyond | (x.isNotNull() & value.isNull() if self.nulls_first else x.isNull() & value.isNotNull())


@dataclass(frozen=True)
class Ranked:
    """row_number, rank, dense_rank, percent_rank, cume_dist or ntile."""

    name: str
    tiles: int = 0


@dataclass(frozen=True)
class Running:
    """An aggregate from the first row to this one (``peers``: and those of equal keys), or over all rows.

    ``parts`` are aggregates that can be merged; ``merge`` puts an earlier and a
    later value of a part together; ``value`` makes the result of the parts.
    """

    parts: tuple[Column, ...]
    merge: tuple[Callable[[Column, Column], Column], ...]
    value: Callable[..., Column]
    peers: bool = True


@dataclass(frozen=True)
class Near:
    """A function of rows at most ``before`` and ``behind`` away."""

    make: Callable[[object], Column]
    before: int
    behind: int


def merged(merge: Callable[[Column, Column], Column]) -> Callable[[Column | str], Column]:
    """The aggregate that puts many values of a part together."""
    return {added: F.sum, F.least: F.min, F.greatest: F.max}[merge]


def added(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


def running(name: str, args: list[Column], peers: bool) -> Running | None:
    """Aggregates that can be carried over ranges."""
    x = args[0] if args else F.lit(1)
    one: Callable[[Column], Column] = lambda v: v
    match name:
        case "sum":
            return Running((F.sum(x),), (added,), one, peers)
        case "count" | "count_star":
            return Running((F.count(x),), (added,), lambda n: F.coalesce(n, F.lit(0)), peers)
        case "count_if":
            return Running((F.count_if(x),), (added,), lambda n: F.coalesce(n, F.lit(0)), peers)
        case "min":
            return Running((F.min(x),), (F.least,), one, peers)
        case "max":
            return Running((F.max(x),), (F.greatest,), one, peers)
        case "avg" | "mean":
            return Running((F.sum(x.cast("double")), F.count(x)), (added, added), lambda s, n: F.when(n > 0, s / n), peers)
    return None


def whole(df: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """``df`` with aggregates over all its rows, joined as one row."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in aggregates.items()])))


def small(df: DataFrame) -> bool:
    """Whether Catalyst knows the relation to be small enough for a single task."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SMALL


def supported(df: DataFrame, keys: list[Key]) -> bool:
    kinds = [df.select(k.column).schema[0].dataType for k in keys]
    return all(isinstance(t, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)) for t in kinds)


def ranges_of(df: DataFrame) -> int:
    """As many ranges as the session has shuffle partitions, within bounds."""
    return max(8, min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def drawn_keys(df: DataFrame, keys: list[Key], rows: int) -> tuple[list[tuple], list[int], list[T.DataType]]:
    """A random sample of the keys in order, as strings, and the number of each among the different ones."""
    kinds = [df.select(k.column).schema[0].dataType for k in keys]
    names = [f"_s{i}" for i in range(len(keys))]
    drawn = df.select(*[k.column.alias(n) for k, n in zip(keys, names, strict=True)]).orderBy(F.rand(7)).limit(rows)
    order = [Key(F.col(n), k.desc, k.nulls_first).sorted() for k, n in zip(keys, names, strict=True)]
    found = drawn.withColumn("_no", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(*order))).orderBy("_no").select(*[F.col(n).cast("string") for n in names], "_no").collect()
    return [tuple(r)[:-1] for r in found], [r["_no"] for r in found], kinds


def as_columns(row: tuple, kinds: list[T.DataType]) -> list[Column | None]:
    return [None if v is None else F.lit(v).cast(kind) for v, kind in zip(row, kinds, strict=True)]


def splitters(df: DataFrame, keys: list[Key], ranges: int) -> list[list[Column | None]]:
    """Ascending quantiles of a random sample of the keys."""
    rows, _, kinds = drawn_keys(df, keys, SAMPLED * ranges)
    cuts = list(dict.fromkeys(rows[len(rows) * i // ranges] for i in range(1, ranges))) if rows else []
    return [as_columns(row, kinds) for row in cuts]


def splitters_of_ties(df: DataFrame, keys: list[Key], ranges: int) -> tuple[list[list[Column | None]], list[int]]:
    """Splitters over the keys and ``TIE``, and for each range the first one of its ties' ranges.

    Only keys of more than a range's rows are cut, at even steps of ``TIE``; all
    ranges between such a key's first and last splitter hold nothing else.
    """
    rows, numbers, kinds = drawn_keys(df, keys, SAMPLED * ranges)
    at = dict.fromkeys(len(rows) * i // ranges for i in range(1, ranges)) if rows else {}
    key = {numbers[i]: rows[i] for i in at}
    times = Counter(numbers[i] for i in at)
    if all(n == 1 for n in times.values()):  # as few keys as tell the splitters apart
        some = next((p for p in range(1, len(keys)) if len({row[:p] for row in key.values()}) == len(key)), len(keys))
        return [as_columns(row[:some], kinds[:some]) for row in key.values()], list(range(len(key) + 1))
    cuts: list[list[Column | None]] = []
    first = [0]
    for no in key:
        hot = times[no] if times[no] > 1 else 0
        spots = [-TIES, *(-TIES + 2 * TIES * i // hot for i in range(1, hot)), TIES] if hot else [-TIES]
        start = len(cuts) + 1
        for i, spot in enumerate(spots):
            cuts.append([*as_columns(key[no], kinds), F.lit(spot).cast("long")])
            first.append(start if i < len(spots) - 1 else len(cuts))
    return cuts, first


def range_of(keys: list[Key], cuts: list[list[Column | None]]) -> Column:
    """Number of splitters at or before a row's keys, by halving over arrays: as short for many splitters as for few."""
    if not cuts:
        return F.lit(0)
    lists = [F.array(*[F.lit(None) if row[i] is None else row[i] for row in cuts]) for i in range(len(keys))]

    def halved(found: Column, step: Column) -> Column:
        at = found + step - 1
        beyond = F.lit(True)
        for key, values in reversed(list(zip(keys, lists, strict=True))):
            value = F.get(values, at)
            beyond = key.after(value) | (key.column.eqNullSafe(value) & beyond)
        return F.when((at < len(cuts)) & beyond, found + step).otherwise(found)

    return F.reduce(F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))]), F.lit(0), halved)


def spread(df: DataFrame, keys: list[Key], functions: dict[str, Ranked | Running | Near], ranges: int | None = None, base: DataFrame | None = None) -> DataFrame:
    """``df`` with a column for each function over the order of ``keys``.

    ``base`` is ``df`` without columns that neither keys nor functions use, such
    as windows over other orders: what is known of ranges beforehand comes from it.
    """
    own = df.columns
    base = df if base is None else base
    ranges = ranges or ranges_of(df)
    sortable = [f"`{c.name}`" for c in base.schema if not isinstance(c.dataType, (T.MapType, T.VariantType))]
    names = [f"_key{i}" for i in range(len(keys))]
    keyed = [Key(F.col(n), k.desc, k.nulls_first) for k, n in zip(keys, names, strict=True)]
    in_order = [*keyed, Key(F.col("_tie"), False, False)]
    order = [k.sorted() for k in in_order]
    cuts, first = splitters_of_ties(base, keys, ranges)
    hot = any(i != g for i, g in enumerate(first))

    def deal(rows: DataFrame) -> DataFrame:
        rows = rows.select("*", *[k.column.alias(n) for k, n in zip(keys, names, strict=True)], F.shiftright(F.xxhash64(*sortable), 1).alias("_tie"))
        return rows.withColumn("_range", range_of(in_order if hot else keyed[: len(cuts[0])] if cuts else [], cuts))

    near = [f for f in functions.values() if isinstance(f, Near)]
    ranks = {f.name for f in functions.values() if isinstance(f, Ranked)}

    # one row per range; everything of earlier ranges by a window over these few rows
    runs = {name: f for name, f in functions.items() if isinstance(f, Running)}
    sums = [F.count(F.lit(1)).alias("_rows"), F.max(F.lit(0)).alias("_all")]
    sums += [p.alias(f"_part_{n}_{i}") for n, f in runs.items() for i, p in enumerate(f.parts)]
    if "dense_rank" in ranks:
        sums.append(F.count_distinct(F.struct(*names)).alias("_keys"))
    dealt_base = deal(base)
    per_range = dealt_base.groupBy("_range").agg(*sums)
    kind = {f.name: f.dataType for f in per_range.schema}
    # ranges of one key's rows are a group; other groups are one range each
    groups = per_range.withColumn("_group", F.get(F.array(*map(F.lit, first)), F.col("_range")) if hot else F.col("_range"))
    alike = Window.partitionBy("_group")
    before = Window.partitionBy("_all").orderBy("_group").rangeBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_all").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)

    def carried_over(part: Column | str, add: Callable[[Column | str], Column]) -> tuple[Column, Column, Column]:
        """Of earlier ranges, of earlier groups, of the own group."""
        return add(part).over(earlier), add(part).over(before), add(part).over(alike)

    carry = ["_range", (F.count(F.lit(1)).over(alike) > 1).alias("_hot"), F.sum("_rows").over(Window.partitionBy("_all")).alias("_total")]
    none = F.lit(0).cast("long")
    for c, n in zip(carried_over("_rows", F.sum), ("_before", "_before_group", "_rows_group"), strict=True):
        carry.append(F.coalesce(c, none).alias(n))
    if "dense_rank" in ranks:
        groups = groups.withColumn("_keys", F.when(F.row_number().over(alike.orderBy("_range")) == 1, F.col("_keys")).otherwise(0))
        carry.append(F.coalesce(F.sum("_keys").over(before), none).alias("_before_keys"))
    for n, f in runs.items():
        for i, merge in enumerate(f.merge):
            at_range, at_group, in_group = (c.cast(kind[f"_part_{n}_{i}"]) for c in carried_over(f"_part_{n}_{i}", merged(merge)))
            carry.append((at_group if f.peers else at_range).alias(f"_carry_{n}_{i}"))
            carry.append(in_group.alias(f"_group_{n}_{i}"))
    carried = groups.select(*carry)
    dealt = dealt_base if df is base else deal(df)

    rows = dealt.withColumn("_copy", F.lit(False))
    if near:
        rows = _with_edges(rows, dealt_base.withColumn("_copy", F.lit(False)), per_range, in_order, max(f.before for f in near), max(f.behind for f in near))
    real = Window.partitionBy("_range", "_copy").orderBy(*order)
    peers = Window.partitionBy("_range", "_copy").orderBy(*[k.sorted() for k in keyed])
    local: list[Column] = []
    for n, f in functions.items():
        if isinstance(f, Ranked):
            made = {"rank": F.rank, "percent_rank": F.rank, "dense_rank": F.dense_rank}.get(f.name)
            value = made().over(peers) if made else F.count(F.lit(1)).over(peers) if f.name == "cume_dist" else F.row_number().over(real)
            local.append(value.alias(f"_local_{n}"))
        elif isinstance(f, Near):
            local.append(f.make(Window.partitionBy("_range").orderBy(*order)).alias(f"_local_{n}"))
        else:
            upto = peers.rangeBetween(Window.unboundedPreceding, Window.currentRow) if f.peers else real.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            local += [p.over(upto).alias(f"_local_{n}_{i}") for i, p in enumerate(f.parts)]
    seen = rows.select(*[f"`{c}`" for c in own], "_range", "_copy", *local).where(~F.col("_copy"))
    seen = seen.join(F.broadcast(carried), "_range")  # a row per range, MOST_RANGES at most
    out = [F.col(f"`{c}`") for c in own]
    for n, f in functions.items():
        if isinstance(f, Ranked):
            out.append(_rank(f, F.col(f"_local_{n}").cast("long"), ranks).alias(n))
        elif isinstance(f, Near):
            out.append(F.col(f"_local_{n}").alias(n))
        else:
            inside = [F.when(F.col("_hot"), F.col(f"_group_{n}_{i}")).otherwise(F.col(f"_local_{n}_{i}")) if f.peers else F.col(f"_local_{n}_{i}") for i in range(len(f.parts))]
            both = [merge(F.col(f"_carry_{n}_{i}"), x).cast(kind[f"_part_{n}_{i}"]) for i, (merge, x) in enumerate(zip(f.merge, inside, strict=True))]
            out.append(f.value(*both).alias(n))
    return seen.select(*out)


def _rank(f: Ranked, local: Column, ranks: set[str]) -> Column:
    peers = f.name in ("rank", "percent_rank", "cume_dist")
    at, total = local + F.col("_before_group" if peers else "_before"), F.col("_total")
    match f.name:
        case "dense_rank":
            return (local + F.col("_before_keys")).cast("int")
        case "percent_rank":
            return F.when(total > 1, (at - 1) / (total - 1)).otherwise(F.lit(0.0))
        case "cume_dist":
            return F.when(F.col("_hot"), F.col("_before_group") + F.col("_rows_group")).otherwise(at) / total
        case "ntile":
            size = F.floor(total / f.tiles)
            long = F.pmod(total, F.lit(f.tiles))  # so many tiles have one row more
            cut = long * (size + 1)
            return F.when(at <= cut, F.floor((at - 1) / (size + 1)) + 1).otherwise(long + F.floor((at - 1 - cut) / F.greatest(size, F.lit(1))) + 1).cast("int")
    return at.cast("int")


def _with_edges(rows: DataFrame, base: DataFrame, per_range: DataFrame, order: list[Key], before: int, behind: int) -> DataFrame:
    """``rows`` and copies of the last ``before`` rows of ``base`` ahead of each range and of the first ``behind`` rows after it."""
    whole = F.struct(*[F.col(f"`{c}`") for c in base.columns])
    local = Window.partitionBy("_range")

    def edge(n: int, last: bool) -> DataFrame:
        if n == 0:
            return base.limit(0)
        sort = [(k.reversed() if last else k).sorted() for k in order]
        ends = base.withColumn("_no", F.row_number().over(local.orderBy(*sort))).where(F.col("_no") <= n)
        lists = ends.groupBy("_range").agg(F.sort_array(F.collect_list(F.struct("_no", whole.alias("row")))).alias("edge"))
        # nearest first; every range with rows has one at least, so n ranges give n rows if there are so many
        some = Window.partitionBy("_all").orderBy("_range" if not last else F.desc("_range")).rowsBetween(1, n)
        reach = per_range.select("_range", "_all").join(lists, "_range").select(F.col("_range").alias("_to"), F.slice(F.flatten(F.collect_list("edge").over(some)), 1, n).alias("near"))
        moved = {"_range": F.col("_to"), "_copy": F.lit(True)}
        return reach.select("_to", F.explode("near.row").alias("row")).select(*[moved.get(c, F.col(f"row.`{c}`")).alias(c) for c in base.columns])

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [rows, edge(before, True), edge(behind, False)])


def running_by(rows: DataFrame, by: list[str], order: list[Key], parts: list[Column], merges: list[Callable[[Column, Column], Column]], names: list[str], ranges: int | None = None) -> DataFrame:
    """``rows`` with aggregates ``names`` from a key's first row to this one and its peers.

    Ranges are cut over (key, order), so that a key of very many rows is many
    ranges and small keys share one; a key that spans ranges carries its
    aggregates over them in a table of one row per key and range.
    """
    ranges = ranges or ranges_of(rows)
    keys = [*(Key(F.col(k), False, True) for k in by), *order]
    dealt = rows.withColumn("_range", range_of(keys, splitters(rows, keys, ranges)) if supported(rows, keys) else F.lit(0))
    held = [f"_sum_{n}" for n in names]
    sums = dealt.groupBy(*by, "_range").agg(*[p.alias(h) for p, h in zip(parts, held, strict=True)], F.max(F.lit(0)).alias("_all"))
    earlier = Window.partitionBy(*by, "_all").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    kind = {f.name: f.dataType for f in sums.schema}
    renamed = [F.col(k).alias(f"_of_{k}") for k in by]
    carried = sums.select(*renamed, F.col("_range").alias("_of_range"), *[merged(m)(h).over(earlier).cast(kind[h]).alias(f"_carry_{n}") for m, h, n in zip(merges, held, names, strict=True)])
    upto = Window.partitionBy(*by, "_range").orderBy(*[k.sorted() for k in order]).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = dealt.select("*", *[p.over(upto).alias(f"_local_{n}") for p, n in zip(parts, names, strict=True)])
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by], F.col("_range") == F.col("_of_range"))
    both = [m(F.col(f"_carry_{n}"), F.col(f"_local_{n}")).cast(kind[h]).alias(n) for m, h, n in zip(merges, held, names, strict=True)]
    return seen.join(carried, on).select(*[f"`{c}`" for c in rows.columns], *both)


def aggregates_before(
    outer: DataFrame, inner: DataFrame, pairs: list[tuple[Column, Column]], value: Column, op: str, bound: Column, functions: dict[str, Callable[[list[Column]], Running | None]], args: dict[str, list[Column]]
) -> DataFrame:
    """``outer`` with aggregates of the ``inner`` rows of equal keys for which ``value op bound`` holds.

    ``pairs`` are equal keys (inner, outer); ``bound`` is the outer row's.  Both
    sides are one relation in the order of value and bound, in which aggregates
    run from the first inner row, so no pair of rows is made.
    """
    by = [f"_by{i}" for i in range(len(pairs))]
    first = 0 if op in ("<=", ">=") else 1  # an inner row of an equal value comes before exactly if it counts
    given = {n: [f"_arg_{n}_{i}" for i in range(len(a))] for n, a in args.items()}
    i = inner.select(*[p.alias(n) for (p, _), n in zip(pairs, by, strict=True)], value.alias("_at"), F.lit(first).alias("_side"), F.lit(1).alias("_in"), *[c.alias(g) for n, a in args.items() for c, g in zip(a, given[n], strict=True)])
    i = i.where(reduce(Column.__and__, [F.col(n).isNotNull() for n in by], F.col("_at").isNotNull()))
    o = outer.select(*[p.alias(n) for (_, p), n in zip(pairs, by, strict=True)], bound.alias("_at"), F.lit(1 - first).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in outer.columns]).alias("_row"))
    both = i.unionByName(o, allowMissingColumns=True)
    desc = op in (">", ">=")
    order = [Key(F.col("_at"), desc, True), Key(F.col("_side"), False, False)]
    made = {n: functions[n]([F.col(g) for g in given[n]] or [F.col("_in")]) for n in args}
    parts = [(p, m, f"_{n}_{k}") for n, f in made.items() for k, (p, m) in enumerate(zip(f.parts, f.merge, strict=True))]
    ran = running_by(both, by, order, [p for p, _, _ in parts], [m for _, m, _ in parts], [n for _, _, n in parts]).where(F.col("_row").isNotNull())
    values = [f.value(*[F.col(f"_{n}_{k}") for k in range(len(f.parts))]).alias(n) for n, f in made.items()]
    return ran.select(*[F.col(f"_row.`{c}`").alias(c) for c in outer.columns], *values)
