"""A registry of models: what each is built of, how it is kept, and in which order they run."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from ..operators import checks
from ..sources import sinks

#: table: written and read back; view: named in the session; inlined: part of whatever reads it.
KINDS = ("table", "view", "inlined")


@dataclass(frozen=True)
class Model:
    name: str
    build: Callable[[Run], DataFrame]
    needs: tuple[str, ...]
    kind: str = "view"
    schema: str = "default"
    tags: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    present: tuple[str, ...] = ()


@dataclass
class Run:
    """One run of models: sources are asked for by schema and name, models that ran before by name."""

    spark: SparkSession
    source: Callable[[str, str], DataFrame]
    done: dict[str, DataFrame] = field(default_factory=dict)

    def ref(self, name: str) -> DataFrame:
        return self.done[name]


class Registry:
    def __init__(self):
        self.models: dict[str, Model] = {}

    def model(self, *needs: str, **properties):
        """Register a function as the model of its name; needs are the models it reads, declared so that none is hidden."""

        def add(build):
            m = Model(build.__name__, build, needs, **properties)
            assert m.kind in KINDS, m.kind
            self.models[m.name] = m
            return build

        return add

    def order(self, names: Iterable[str] | None = None) -> list[str]:
        """The named models and all that they need, each after what it needs; an unknown or circular need is an error."""
        wanted, stack = set(), list(self.models if names is None else names)
        while stack:
            n = stack.pop()
            if n not in wanted:
                wanted.add(n)
                stack += self.models[n].needs
        return list(TopologicalSorter({n: self.models[n].needs for n in sorted(wanted)}).static_order())

    def tagged(self, *tags: str) -> list[str]:
        """Models that have one of the tags."""
        return [m.name for m in self.models.values() if set(tags) & set(m.tags)]

    def run(self, spark: SparkSession, source: Callable[[str, str], DataFrame], names: Iterable[str] | None = None, write: bool = False, namespace: Callable[[str], str] = lambda schema: schema) -> Run:
        """Run models in order. With write, tables are reloaded in namespace(schema) (K15); without, all stay lazy."""
        run = Run(spark, source)
        for name in self.order(names):
            m = self.models[name]
            out = m.build(run)
            if write and m.kind == "table":
                schema = namespace(m.schema)
                sinks.reload(out, schema, name)
                out = spark.table(f"`{schema}`.`{name}`")
            elif m.kind != "inlined":
                out.createOrReplaceTempView(name)
            run.done[name] = out
        return run

    def violations(self, run: Run) -> DataFrame | None:
        """The declared checks of all models of a run (T1 to T4): rows (model, check, violations)."""
        from pyspark.sql import functions as F

        out = None
        for name, df in run.done.items():
            m = self.models[name]
            if m.unique or m.present:
                one = checks.report(df, [list(u) for u in m.unique], list(m.present)).select(F.lit(name).alias("model"), "check", "violations")
                out = one if out is None else out.unionAll(one)
        return out
