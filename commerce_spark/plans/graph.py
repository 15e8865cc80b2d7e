"""Models with declared needs: built in order, each once, and kept by layer.

A model is a function of the tables and of the models that it needs, in the order of their names. Its layer says how it is
kept: views are plans, tables are written. Within a run, a table is written as soon as two others read it, so that what
it was made of is scanned and shuffled once; with a single reader its plan goes on and Catalyst sees the whole. `publish`
writes all tables, by their layouts, in one version of a store.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from commerce_spark.functions.scalar import identifier
from commerce_spark.sources.scratch import kept
from commerce_spark.sources.store import Layout, Store

LAYERS = {"staging": "view", "intermediario": "view", "dm": "table", "comercial": "table"}


def schema_name(custom: str | None, default: str = "comercial") -> str:
    """The schema of a model: the name that it asks for as it is, without the target's name before it."""
    return identifier(custom or default)


@dataclass(frozen=True)
class Model:
    name: str
    layer: str
    needs: tuple[str, ...]
    build: Callable[..., DataFrame]
    layout: Layout


class Graph:
    def __init__(self):
        self.models: dict[str, Model] = {}
        self.written: list[DataFrame] = []  # the plans that the last run wrote, for tests and explanations

    def model(self, layer: str, *needs: str, by: tuple[str, ...] = (), sort: tuple[str, ...] = ()) -> Callable:
        """Declares the decorated function, under its own name. A need may be named twice, if the function reads it twice."""
        if layer not in LAYERS:
            raise ValueError(f"no layer {layer}")

        def declared(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            name = f.__name__.strip("_")
            if name in self.models:
                raise ValueError(f"{name} is declared twice")
            self.models[name] = Model(name, layer, needs, f, Layout(by, sort))
            return f

        return declared

    def order(self, *targets: str) -> list[str]:
        """All that the targets need, and they, each after its own needs; a circle or an unknown name is an error."""
        done: list[str] = []
        path: list[str] = []

        def visit(name: str) -> None:
            if name in done:
                return
            if name not in self.models:
                raise KeyError(f"{name}, which {path[-1] if path else 'a run'} needs, isn't declared")
            if name in path:
                raise ValueError(f"a circle: {' -> '.join([*path[path.index(name) :], name])}")
            path.append(name)
            for n in self.models[name].needs:
                visit(n)
            path.pop()
            done.append(name)

        for t in targets:
            visit(t)
        return done

    def run(self, t, *targets: str) -> list[DataFrame]:
        """The targets, named as often as the caller reads them; t: the tables. A model given as a DataFrame in t.given is taken as it is."""
        order = self.order(*targets)
        readers = Counter(targets) + Counter(n for m in order for n in self.models[m].needs)
        built: dict[str, DataFrame] = {}
        self.written = []
        for name in order:
            m = self.models[name]
            if name in t.given:
                built[name] = t.given[name]
                continue
            df = m.build(t, *[built[n] for n in m.needs])
            if LAYERS[m.layer] == "table" and readers[name] > 1:
                self.written.append(df)
                df = kept(df, name)
            built[name] = df
        return [built[n] for n in targets]

    def publish(self, t, store: Store, *targets: str) -> int:
        """Every model of a table layer that the targets need, built once, as one version of the store: `schema.name` there is
        `schema__name`. The number of the version."""
        names = [n for n in self.order(*targets) if LAYERS[self.models[n].layer] == "table"]
        frames = dict(zip(names, self.run(t, *names), strict=True))
        label = {n: f"{schema_name(self.models[n].layer)}__{n}" for n in names}
        return store.commit(replaced={label[n]: df for n, df in frames.items()}, layouts={label[n]: self.models[n].layout for n in names})


GRAPH = Graph()
