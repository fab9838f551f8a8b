"""Collections by name: models with where their rows come from."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from fieldstone.operators.docset import DocSet, Query
from fieldstone.plans.filters import FilterCache
from fieldstone.plans.model import Conventions, Model

Loader = Callable[[SparkSession], DataFrame]


class Context:
    """A named bundle of collections.  Subclasses may override ``on_models`` to register theirs."""

    def __init__(self, spark: SparkSession, conventions: Conventions = Conventions()):
        self.spark, self.conventions = spark, conventions
        self.models: dict[str, Model] = {}
        self.loaders: dict[str, Loader] = {}
        self.cache = FilterCache(conventions.filter_cache)
        self.on_models()

    def on_models(self) -> None:
        """Called once when the context is made."""

    def register(self, model: Model, loader: Loader, view: bool = False) -> Model:
        """Adds a collection; with ``view`` also as a temporary view for SQL."""
        self.models[model.name], self.loaders[model.name] = model, loader
        if view:
            loader(self.spark).createOrReplaceTempView(model.name)
        return model

    def from_files(self, path: str, id_column: str, name: str | None = None, format: str = "parquet", **options) -> Model:
        """A collection of files in any format the session reads, also connectors' (given as ``format``)."""
        load = lambda spark: spark.read.format(format).options(**options).load(path)
        name = name or PurePosixPath(path).stem
        return self.register(Model(name, load(self.spark).schema, id_column, conventions=self.conventions), load)

    def from_rows(self, model: Model, rows: Iterable) -> Model:
        """A collection of given rows, with ids made, once, where they have none."""
        data = model.with_ids(self.spark.createDataFrame(list(rows), model.schema)).collect()
        return self.register(model, lambda spark: spark.createDataFrame(data, model.schema))

    def set(self, name: str) -> DocSet:
        if name not in self.models:
            raise ValueError(f"there is no collection '{name}'")
        return DocSet(self.loaders[name](self.spark), self.models[name], self.cache)

    def query(self, name: str, condition=None) -> Query:
        """A query with includes over a collection."""
        return Query(self.set(name), self.set, condition)
