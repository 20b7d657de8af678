"""The engine: runs flow queries on a SparkSession.

>>> engine = Engine(spark, "/data/sf1")
>>> df = engine.query("from lineitem group by l_returnflag agg _.count as n")
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import printer
from sluice.errors import FlowError, FlowNameError, FlowTestFailure
from sluice.plans import ast as A
from sluice.plans.env import Env
from sluice.plans.lower import Lowering
from sluice.plans.lower_expr import constant
from sluice.plans.parser import parse
from sluice.plans.scope import Scope
from sluice.plans.show import show_expr, show_plan
from sluice.sources import files, sinks, touched
from sluice.sources.catalog import sql_views

#: Rows that a test or a printed result shows at most.
ROW_LIMIT = 40


@dataclass
class Result:
    """What a statement gave: a DataFrame, or text."""

    statement: A.Stmt
    df: DataFrame | None = None
    text: str | None = None

    def box(self, limit: int = ROW_LIMIT) -> str:
        if self.df is None:
            return self.text or ""
        return printer.box(self.df.schema, self.df.limit(limit).collect())


@dataclass
class TestOutcome:
    check: str
    ok: bool
    detail: str = ""


@dataclass
class Engine:
    """Runs flow text; tables are ``<folder>/<name>.parquet``, registered DataFrames, or the catalog's."""

    spark: SparkSession
    folder: str | None = None
    base_dir: str | None = None
    run_tests: bool = True
    env: Env = field(default_factory=Env)
    tests: list[TestOutcome] = field(default_factory=list)
    package: str = ""
    #: files are read as streams
    streaming: bool = False
    _tables: dict[str, DataFrame] = field(default_factory=dict)
    _prepared: dict[str, str] = field(default_factory=dict)
    _modules: set[str] = field(default_factory=set)
    _attached: dict[str, dict[str, str]] = field(default_factory=dict)

    # ------------------------------------------------------------------ sources

    def register(self, name: str, df: DataFrame) -> Engine:
        self._tables[name] = df
        return self

    def attach(self, name: str, url: str, **options: Any) -> Engine:
        """Make another database's tables readable as ``name.table`` or ``name.schema.table``.

        Options go to Spark's JDBC source (user, driver, fetchsize, ...); filters,
        columns and limits are pushed down to the database.  For a parallel read
        give partitionColumn, lowerBound, upperBound and numPartitions.
        """
        self._attached[name] = {"url": url, **{k: str(v) for k, v in options.items()}}
        return self

    def known_sources(self) -> list[str]:
        return list(self._tables)

    def source(self, name: str) -> DataFrame | None:
        """A registered table, a table of the catalog, or a Parquet file of the folder."""
        if name in self._tables:
            return self._tables[name]
        database, _, table = name.partition(".")
        if table and database in self._attached:
            return self.spark.read.format("jdbc").options(**self._attached[database], dbtable=table).load()
        if self.spark.catalog.tableExists(name) and not (name in sql_views and self.folder is not None and self._in_folder(name)):
            return self.spark.table(name)
        if self.folder is not None and name.isidentifier():
            path = f"{self.folder.rstrip('/')}/{name}.parquet"
            if self._in_folder(name):
                return self._tables.setdefault(name, self.opened(self.spark.read.parquet(path)))
        return None

    def _in_folder(self, name: str) -> bool:
        return sinks.exists(self.spark, f"{self.folder.rstrip('/')}/{name}.parquet")

    def opened(self, df: DataFrame) -> DataFrame:
        """A file's DataFrame, as a stream where this engine works on streams."""
        if not self.streaming:
            return df
        from sluice.streaming.subscribe import as_stream

        return as_stream(df)

    def on_streams(self) -> Engine:
        """An engine with the same names whose files are streams."""
        return Engine(self.spark, self.folder, self.base_dir, False, self.env.child(), streaming=True, _attached=self._attached)

    def file_text(self, path: str) -> str:
        """A query file's text, read with Spark so that any store works."""
        rows = self.spark.read.option("wholetext", True).text(path).collect()
        return "\n".join(r[0] for r in rows)

    def included(self, path: str, env: Env) -> DataFrame:
        """The last query of a flow file."""
        inner = Engine(self.spark, self.folder, os.path.dirname(path) or self.base_dir, False, env.child(), _tables=self._tables, _attached=self._attached)
        return inner.query(self.file_text(path))

    # ---------------------------------------------------------------------- run

    def run(self, text: str) -> list[Result]:
        """All statements in order; definitions give no result."""
        out = []
        for s in parse(text):
            r = self.execute(s)
            if r is not None:
                out.append(r)
        return out

    def query(self, text: str) -> DataFrame:
        """The DataFrame of the last query in the text."""
        found = [r.df for r in self.run(text) if r.df is not None]
        if not found:
            raise FlowError("the text has no query")
        return found[-1]

    def sql(self, text: str, args: Any = None) -> DataFrame:
        """SQL text through the dialect shim, over the same tables."""
        from sluice.sql_front import run_sql

        return run_sql(self, text, args)

    def lowering(self, env: Env | None = None, current: Scope | None = None) -> Lowering:
        return Lowering(self, env or self.env, current)

    def execute(self, s: A.Stmt) -> Result | None:
        return getattr(self, f"_{type(s).__name__.lower()}")(s)

    def _query(self, s: A.Query) -> Result:
        return Result(s, self.lowering().relation(s.relation).shown())

    def _package(self, s: A.Package) -> None:
        self.package = s.name

    def _model(self, s: A.Model) -> None:
        self.env.models[s.name] = s
        if s.type:
            self.env.row_types[s.name.rsplit(".", 1)[-1]] = s.type

    def _val(self, s: A.Val) -> None:
        value = self.with_vals(s.value, self.env)
        if isinstance(value, (A.Call, A.Col)) and value.name == "ulid_string":
            from sluice.functions.library import ulid

            value = A.Lit(ulid())  # once, when it is bound
        self.env.vals[s.name] = A.Cast(value, s.type) if s.type else value

    def _tableval(self, s: A.TableVal) -> None:
        relation = A.Alias(A.Values(s.rows), s.name, s.columns)
        self.env.tables[s.name] = self.lowering().relation(relation)

    def _def(self, s: A.Def) -> None:
        self.env.functions[s.name] = s

    def _typedef(self, s: A.TypeDef) -> None:
        self.env.types.setdefault(s.name, []).append(s)

    def _import(self, s: A.Import) -> None:
        """Definitions of another package's files in the base folder."""
        if s.source is not None:
            return  # remote packages are only named
        package, _, name = s.name.rpartition(".")
        for path in self._flow_files():
            if path in self._modules:
                continue
            statements = parse(self.file_text(path))
            own = next((p.name for p in statements if isinstance(p, A.Package)), "")
            if own not in (package, s.name):
                continue
            for d in statements:
                if isinstance(d, (A.Model, A.Def, A.TypeDef)) and (name in ("*", d.name) or own == s.name):
                    self.execute(d)
                    if s.alias and d.name == name:
                        table = {A.Model: self.env.models, A.Def: self.env.functions, A.TypeDef: self.env.types}[type(d)]
                        table[s.alias] = [d] if isinstance(d, A.TypeDef) else d

    def _flow_files(self) -> list[str]:
        if not self.base_dir:
            return []
        fs, p = sinks._fs(self.spark, self.base_dir)
        if not fs.exists(p):
            return []
        return sorted(f.getPath().toString() for f in fs.listStatus(p) if f.getPath().getName().endswith(".wv"))

    def _save(self, s: A.Save, current: Scope | None = None) -> Result:
        df = self.lowering(current=current).relation(s.relation).shown()
        options = dict(s.options)
        if s.is_file:
            sinks.save_file(df, files.located(s.target, self.base_dir), options)
        else:
            sinks.save_table(df, s.target, options)
            self._forget(s.target)
        return Result(s, text=f"saved {s.target}")

    def _append(self, s: A.Append, current: Scope | None = None) -> Result:
        df = self.lowering(current=current).relation(s.relation).shown()
        if s.is_file:
            sinks.append_file(df, files.located(s.target, self.base_dir))
        else:
            sinks.append_table(df, s.target, s.columns)
            self._forget(s.target)
        return Result(s, text=f"appended to {s.target}")

    def _forget(self, name: str) -> None:
        self._tables.pop(name, None)
        self.env.tables.pop(name, None)

    def _delete(self, s: A.Delete) -> Result:
        """``from t where p delete``: keep the rows for which p is not true."""
        conditions, r = [], s.relation
        while isinstance(r, A.Filter):
            conditions.append(r.condition)
            r = r.child
        source = r.child if isinstance(r, A.Alias) else r
        if not isinstance(source, (A.Table, A.File)):
            raise FlowError("delete takes filters over a table or file")
        plan = self.lowering()
        table = isinstance(source, A.Table) and self.spark.catalog.tableExists(source.name) and source.name not in self._tables
        if table:  # files without such a row stay as they are
            rows = touched.numbered(self.spark, source.name)
            scope = replace(Scope.of(self.spark.table(source.name), r.name if isinstance(r, A.Alias) else source.name.rsplit(".", 1)[-1]), df=rows)
        else:
            scope = plan.relation(r)
        gone = F.lit(True)
        for c in conditions:
            gone = gone & plan.expressions(scope)(c)
        if table:
            touched.apply(self.spark, source.name, scope.df.where(gone).select(touched.FILE, touched.ROW, F.lit(True).alias("_gone")))
            self._forget(source.name)
            return Result(s, text="deleted")
        rest = Scope(scope.df.where(~F.coalesce(gone, F.lit(False))), scope.columns).shown()
        if isinstance(source, A.File):
            sinks.save_file(rest, files.located(source.path, self.base_dir))
        else:
            sinks.save_table(rest, source.name)
            self._forget(source.name)
        return Result(s, text="deleted")

    def _execute(self, s: A.Execute) -> Result:
        return Result(s, self.sql(self.text_value(s.parts, self.env, as_sql=True)))

    def _explain(self, s: A.Explain) -> Result:
        if isinstance(s.target, tuple):
            df = self.sql(self.text_value(s.target, self.env, as_sql=True))
            return Result(s, text=df._jdf.queryExecution().toString())
        if isinstance(s.target, (A.Save, A.Append, A.Delete, A.Query)):
            df = self.lowering().relation(s.target.relation).shown()
            return Result(s, text=show_plan(s.target.relation) + "\n\n" + df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        raise FlowError("explain takes a query")

    def _use(self, s: A.Use) -> Result:
        name = s.name.rsplit(".", 1)[-1]
        if not self.spark.catalog.databaseExists(name):
            raise FlowNameError(f"no schema {name}")
        self.spark.catalog.setCurrentDatabase(name)
        return Result(s, text=f"using {name}")

    def _showquery(self, s: A.ShowQuery) -> Result:
        model = self.env.model(s.name)
        if model is None:
            raise FlowNameError(f"no model {s.name}")
        return Result(s, text=model.source)

    # ------------------------------------------------------------------- values

    def with_vals(self, e: A.Expr, env: Env) -> A.Expr:
        """The expression with named values put in."""
        return A.rewrite(e, lambda x: env.val(x.name) if isinstance(x, A.Col) else None)

    def text_value(self, parts: tuple[str | A.Expr, ...], env: Env, as_sql: bool = False) -> str:
        """An interpolated text whose expressions are literals or named values."""
        out = []
        for p in parts:
            if isinstance(p, str):
                out.append(p)
                continue
            e = self.with_vals(p, env)
            try:
                v = constant(e)
            except ValueError:
                if not as_sql:
                    raise FlowError(f"{show_expr(p)} is no literal") from None
                v = None
                out.append(self.lowering(env).expressions(Scope(self.spark.range(1), ())).sql_text(e))
                continue
            out.append(str(v))
        return "".join(out)

    # -------------------------------------------------------------------- tests

    def debug(self, branch: Any, scope: Scope, env: Env) -> None:
        """A side branch on the relation so far; the query goes on unchanged."""
        if isinstance(branch, A.Save):
            self._save(branch, scope)
        elif isinstance(branch, A.Append):
            self._append(branch, scope)
        else:
            out = self.lowering(env, scope).relation(branch)
            if not any(isinstance(x, A.Test) for x in A.walk(branch)):
                print(printer.box(out.shown().schema, out.shown().limit(ROW_LIMIT).collect()))

    def check(self, e: A.Expr, scope: Scope) -> None:
        """A ``test``: compares the rows so far, of which at most ``ROW_LIMIT`` + 1 are fetched."""
        if not self.run_tests:
            return
        df = scope.shown()

        def value(x: A.Expr) -> Any:
            if isinstance(x, A.Dot) and isinstance(x.base, A.Here):
                if x.name == "size":
                    return df.count()
                if x.name == "columns":
                    return df.columns
                rows = df.limit(ROW_LIMIT + 1).collect()
                if x.name == "rows":
                    return [printer.plain(list(r)) for r in rows]
                if x.name == "json":
                    return printer.json_lines(df.schema, rows)
                if x.name == "output":
                    return printer.box(df.schema, rows[:ROW_LIMIT])
                raise FlowError(f"test has no _.{x.name}")
            return printer.plain(constant(x))

        if not isinstance(e, A.Should):
            raise FlowError("a test compares")
        left, right = value(e.left), value(e.right)
        if isinstance(left, str) and isinstance(right, str):
            left, right = left.strip(), right.strip()
        ok = {
            "be": lambda: left == right, "=": lambda: left == right, "not be": lambda: left != right, "!=": lambda: left != right, "<>": lambda: left != right,
            "contain": lambda: right in left, "not contain": lambda: right not in left, "<": lambda: left < right, "<=": lambda: left <= right,
            ">": lambda: left > right, ">=": lambda: left >= right, "==": lambda: left == right,
        }[e.op]()
        name = f"{show_expr(e.left)} {e.op} {show_expr(e.right)}"
        outcome = TestOutcome(name, ok, "" if ok else f"left: {left!r}\nright: {right!r}")
        self.tests.append(outcome)
        if not ok:
            raise FlowTestFailure(f"{name}\n{outcome.detail}")
