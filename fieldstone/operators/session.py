"""Units of work: a pinned snapshot, staged changes, one atomic save.

A session reads the commit that was current when it opened and sees its own staged changes.  Rows that
were loaded by id are kept in an identity map: loading one again reads nothing and gives the same object.
Loaded and attached rows may be edited in place; saving finds the edited ones by comparison with their
snapshot.  Bulk work is staged as DataFrames and never passes through the driver.
"""

from __future__ import annotations

import copy
import uuid
from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstone.functions.metrics import Metrics
from fieldstone.plans.filters import FilterCache
from fieldstone.plans.model import Conventions, Model
from fieldstone.sources.store import Store

from . import changes as ch
from . import attachments as at
from .constraints import Index, check_indexes
from .docset import Condition, DocSet, Query


class Entity(dict):
    """A row loaded into a session; edited in place like a dict."""


def _entity(row: Row) -> Entity:
    return Entity(row.asDict(recursive=True))


class Staged:
    """What a session has staged for one collection."""

    def __init__(self, tracked: list[str]):
        self.tracked = tracked
        self.deletes: list[DataFrame] = []
        self.inserts: list[DataFrame] = []
        self.updates: list[DataFrame] = []
        self.added: dict[Any, tuple[int, Entity]] = {}
        self.removed: set[Any] = set()
        self.known: dict[Any, tuple[Entity, Entity | None]] = {}  # entity, snapshot (None: untracked)
        self.blobs: list[tuple[str, DataFrame]] = []  # of attachments: what is stored, under which token
        self.names: list[DataFrame] = []  # and the names that go or are replaced
        self.fresh = 0  # how many of the inserts hold only ids made for them, each once

    def touched(self) -> bool:
        return bool(self.deletes or self.inserts or self.updates or self.added or self.removed or self.dirty())

    def dirty(self) -> dict[Any, tuple[Entity, list[str]]]:
        """Edited entities with the names of their changed fields."""
        out = {}
        for key, (entity, snapshot) in self.known.items():
            if snapshot is not None and key not in self.added and key not in self.removed:
                names = [c for c in self.tracked if _canonical(entity.get(c)) != _canonical(snapshot.get(c))]
                if names:
                    out[key] = (entity, names)
        return out


def _canonical(value: Any) -> Any:
    """Null and empty collections alike, maps without order; as ``fieldstone.functions.compare``."""
    if isinstance(value, dict):
        return {k: _canonical(v) for k, v in value.items()} or None
    if isinstance(value, (list, tuple)):
        return [_canonical(v) for v in value] or None
    return value


class Session:
    """Use as a context manager: leaving without ``save`` discards."""

    def __init__(self, store: Store, models: Iterable[Model], conventions: Conventions = Conventions(), indexes: Iterable[Index] = (), metrics: Metrics | None = None):
        self.store, self.spark, self.conventions = store, store.spark, conventions
        self.models = {m.name: m for m in models}
        self.indexes = list(indexes)
        self.metrics = metrics or Metrics(enabled=False)
        self.cache = FilterCache(conventions.filter_cache)
        self._seq = 0
        self.open()

    # -- lifecycle

    def open(self) -> None:
        """Pins the current commit and forgets everything staged."""
        self.commit = self.store.latest()
        self._manifest = self.store.manifest(self.commit)
        self._there = set(self._manifest)
        self._staged = {name: Staged(m.tracked) for name, m in self.models.items()}

    abort = clear_tracking = open

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        self.abort()

    # -- reading

    def _model(self, name: str) -> Model:
        if name not in self.models:
            raise ValueError(f"there is no collection '{name}'")
        return self.models[name]

    def base(self, name: str) -> DataFrame:
        """The pinned snapshot, without staged changes."""
        model = self._model(name)
        return self.store.rows(self._manifest[name]) if name in self._there else self.spark.createDataFrame([], model.schema)

    def rows(self, name: str) -> DataFrame:
        """The snapshot with this session's staged changes."""
        return self._view(name) if self._staged[self._model(name).name].touched() else self.base(name)

    def set(self, name: str) -> DocSet:
        return DocSet(self.rows(name), self._model(name), self.cache)

    def query(self, name: str, condition=None) -> Query:
        return Query(self.set(name), self.set, condition)

    def find(self, name: str, condition: Condition = None, include: Iterable[str] = ()) -> list[Entity]:
        """The matching rows as entities of the identity map, with staged changes, edits in place included.  What
        the fields ``include`` refer to becomes loadable without another read, but is not tracked for changes."""
        with self.metrics.command("query"):
            query = self.query(name, condition)
            for field in include:
                query = query.include(field)
            found = self.track(name, query.roots())
            for field, to in zip(query.fields, query.to):
                self.track(to, query.included(field), shadow=False)
            self.metrics.add("query_rows", len(found))
        return found

    def track(self, name: str, rows: DataFrame, shadow: bool = True) -> list[Entity]:
        """Brings rows into the identity map and returns its entities: the first one seen of an id stays.
        For row counts that fit the driver; larger work is staged as DataFrames."""
        model, staged = self._model(name), self._staged[name]
        out = []
        for row in rows.toLocalIterator():
            key = row[model.id]
            if key in staged.removed:
                continue
            if key not in staged.known:
                entity = _entity(row)
                staged.known[key] = (entity, copy.deepcopy(entity) if shadow else None)
            out.append(staged.known[key][0])
        return out

    def tracked(self, name: str, id_value: Any) -> Entity | None:
        """The identity map's entity of an id, if it has one; never reads."""
        return self._staged[self._model(name).name].known.get(id_value, (None, None))[0]

    def untrack(self, name: str, id_value: Any) -> None:
        """Takes an entity out of the identity map: its edits, and its insert if that is staged, are not saved."""
        staged = self._staged[self._model(name).name]
        staged.known.pop(id_value, None)
        staged.added.pop(id_value, None)

    def load(self, name: str, id_value: Any) -> Entity | None:
        """By id: from the identity map, else from what is staged, else from the snapshot."""
        model, staged = self._model(name), self._staged[name]
        if id_value is None:
            raise ValueError(f"{name}: an id must not be null")
        if id_value in staged.removed:
            return None
        if id_value in staged.known:
            return staged.known[id_value][0]
        bulk = staged.deletes or staged.inserts or staged.updates
        with self.metrics.command("load"):
            found = self.track(name, DocSet(self._view(name) if bulk else self.base(name), model, self.cache).load(id_value))
        return found[0] if found else None

    def attachments(self, bucket: str | None = None) -> SessionAttachments:
        """The attachments of a bucket, by default the conventions'; they are saved, or not, with all else."""
        bucket = bucket or self.conventions.bucket
        for table, ddl in ((f"{bucket}.files", at.FILES), (f"{bucket}.chunks", at.CHUNKS)):
            if table not in self.models:
                schema = T.StructType.fromDDL(ddl)
                self.models[table] = Model(table, schema, "_id", conventions=self.conventions)
                self._staged[table] = Staged(self.models[table].tracked)
        return SessionAttachments(self, bucket)

    # -- staging

    def _next(self) -> int:
        self._seq += 1
        return self._seq

    def store_one(self, name: str, document: dict) -> Entity:
        """Stages an insert; makes an id if it has none."""
        model, staged = self._model(name), self._staged[name]
        entity = document if isinstance(document, Entity) else Entity(document)
        if entity.get(model.id) in (None, ""):
            if not isinstance(model.schema[model.id].dataType, T.StringType):
                raise ValueError(f"{name}: the row has no id")
            entity[model.id] = self.spark.range(1).select(model.conventions.make_id(name)).first()[0]
        key = entity[model.id]
        staged.removed.discard(key)
        staged.added[key] = (self._next(), entity)
        staged.known[key] = (entity, None)
        return entity

    def attach(self, name: str, document: dict) -> Entity:
        """Tracks a row as it is: later edits of it are saved."""
        model, staged = self._model(name), self._staged[name]
        entity = document if isinstance(document, Entity) else Entity(document)
        if entity.get(model.id) in (None, ""):
            raise ValueError(f"{name}: the row has no id")
        staged.known[entity[model.id]] = (entity, Entity(copy.deepcopy(dict(entity))))
        return entity

    def delete_one(self, name: str, id_or_document: Any) -> None:
        """Stages a delete and cancels a staged insert of that id."""
        model, staged = self._model(name), self._staged[name]
        key = id_or_document.get(model.id) if isinstance(id_or_document, dict) else id_or_document
        if key is None:
            raise ValueError(f"{name}: an id must not be null")
        staged.added.pop(key, None)
        staged.known.pop(key, None)
        staged.removed.add(key)

    def delete_now(self, name: str, id_value: Any) -> None:
        """Deletes one row at once, in a commit of its own; KeyError unless it is there."""
        with Session(self.store, [self._model(name)], self.conventions) as own:
            if own.load(name, id_value) is None:
                raise KeyError(id_value)
            own.delete_one(name, id_value)
            own.save()

    def insert(self, name: str, rows: DataFrame) -> None:
        """Stages rows of any number; ids are made where missing and settled by the save."""
        model = self._model(name)
        self._staged[name].inserts.append(model.with_ids(rows.select(*model.schema.names)).withColumn(ch.SEQ, F.lit(self._next())))

    def update(self, name: str, rows: DataFrame) -> None:
        """Stages replacements; with versions, of the version that each row carries."""
        self._staged[name].updates.append(rows.select(*self._model(name).schema.names).withColumn(ch.SEQ, F.lit(self._next())))

    def delete(self, name: str, ids: DataFrame) -> None:
        """Stages deletes of the ids in the first column."""
        model = self._model(name)
        self._staged[name].deletes.append(ids.select(F.col(ids.columns[0]).cast(model.schema[model.id].dataType).alias(model.id)))

    def pending(self, name: str) -> dict[str, list]:
        """Ids of staged inserts and deletes and of edited entities."""
        s = self._staged[self._model(name).name]
        return {"added": list(s.added), "removed": sorted(s.removed, key=repr), "dirty": list(s.dirty())}

    # -- saving

    def _local(self, entities: list, model: Model, extra: list[T.StructField]) -> DataFrame:
        return self.spark.createDataFrame(entities, T.StructType([*model.schema.fields, *extra]))

    def _changes(self, name: str) -> ch.ChangeSet:
        model, s = self._model(name), self._staged[name]
        seq = T.StructField(ch.SEQ, T.IntegerType())
        names = model.schema.names
        inserts, updates, deletes = list(s.inserts), [], list(s.deletes)
        if s.added:
            inserts.append(self._local([(*(e.get(c) for c in names), n) for n, e in s.added.values()], model, [seq]))
        # Entities' edits come after all bulk updates; they send their changed fields only.
        whole = [f for f in names if f != model.id]
        updates = [u.withColumn("changed", F.array(*map(F.lit, whole))) for u in s.updates]
        dirty = s.dirty()
        if dirty:
            partial = T.StructField("changed", T.ArrayType(T.StringType()))
            updates.append(self._local([(*(e.get(c) for c in names), self._seq + 1, changed) for e, changed in dirty.values()], model, [seq, partial]))
        if s.removed:
            deletes.append(self.spark.createDataFrame([(k,) for k in s.removed], T.StructType([T.StructField(model.id, model.schema[model.id].dataType)])))
        gone, added, changed = (reduce(DataFrame.unionByName, parts) if parts else None for parts in (deletes, inserts, updates))
        if added is not None and changed is None and len(inserts) == s.fresh:
            return ch.ChangeSet(gone if gone is None else gone.distinct(), added.drop(ch.SEQ), None)  # nothing to compare, so nothing is shuffled
        return ch.resolve(gone, added, changed, model.id)

    def _view(self, name: str) -> DataFrame:
        model = self._model(name)
        return ch.apply(self.base(name), self._changes(name), model.id, None)

    def save(self) -> int:
        """Publishes all staged changes in one commit, or nothing.

        Raises ConcurrencyError if a row that is updated has another version by now or is gone, and
        StaleSnapshotError if another writer came between reading and publishing.  The session goes on
        from the new commit; its entities stay tracked with their new values.  Under conventions that are
        not ``atomic`` every collection is published by itself, in order, and a failure leaves those before it."""
        with self.metrics.command("save"):
            return self._save()

    def _save(self) -> int:
        now = self.store.latest()
        touched = [n for n, s in self._staged.items() if s.touched()]
        if not touched:
            return self.commit
        manifest, staged, parked = self.store.manifest(now), {}, []
        try:
            for name in touched:
                model, changes, entry = self.models[name], self._changes(name), manifest.get(name)
                changes = changes.each(lambda d: self.store.park(d, parked))  # made ids stay; nothing is computed twice
                base = self.store.rows(entry) if entry else self.spark.createDataFrame([], model.schema)
                version = model.version if self.conventions.version_attribute else None
                if version and changes.updates is not None:
                    failed = ch.conflicts(base, changes.updates, model.id, version).select(model.id)
                    if not failed.isEmpty():
                        raise ch.ConcurrencyError(self.store.park(failed, []), model.id)  # stays readable after the save
                strict = self.conventions.strict_insert
                # Deleted and inserted ids replace their rows, so only updates, and the check of strict inserts, read these.
                needed = changes.touched(base, model.id) if changes.updates is not None or (strict and changes.inserts is not None) else self.spark.createDataFrame([], base.schema)
                after = ch.apply(needed if entry else base, changes, model.id, version, strict)
                staged[name] = self.store.stage(name, after, model.id, entry, changes.deletes)
                self.metrics.add("save_rows", staged[name].pop("rows"))
                unique = [i for i in self.indexes if i.collection == name and i.unique]
                if unique:
                    check_indexes(self.store.rows(staged[name]), unique)
                if not self.conventions.atomic:
                    now = self.store.publish({name: staged.pop(name)}, now)
                    manifest = self.store.manifest(now)
        except Exception:
            self.store.discard(staged)
            raise
        finally:
            self.store.unpark(parked)
        done = self.store.publish(staged, now) if staged else now
        self._accept(done)
        return done

    def _accept(self, commit: int) -> None:
        """The published commit becomes the snapshot; versions of saved entities go up."""
        self.commit, self._manifest = commit, self.store.manifest(commit)
        self._there = set(self._manifest)
        for name, s in self._staged.items():
            version = self.models[name].version if self.conventions.version_attribute else None
            for key in s.dirty():
                if version:
                    entity = s.known[key][0]
                    entity[version] = (entity.get(version) or 0) + 1
            fresh = Staged(s.tracked)
            fresh.known = {k: (e, Entity(copy.deepcopy(dict(e)))) for k, (e, _) in s.known.items()}
            self._staged[name] = fresh


class SessionAttachments:
    """Attachments of one bucket within a session: staged with its other changes, read with them."""

    def __init__(self, session: Session, bucket: str):
        self.session, self.files, self.chunks = session, f"{bucket}.files", f"{bucket}.chunks"

    def tables(self) -> tuple[DataFrame, DataFrame]:
        return self.session.rows(self.files), self.session.rows(self.chunks)

    def store(self, entity_id: Any, name: str, data: bytes | None, content_type: str | None = None) -> None:
        """Stages one blob, in place of one of the same name."""
        blobs = self.session.spark.createDataFrame([(str(entity_id), name, None if data is None else bytearray(data), content_type)], at.BLOBS)
        self._stage(blobs.select(at.file_name(F.col("entity_id"), F.col("name")).alias("filename")), blobs)

    def store_all(self, blobs: DataFrame) -> None:
        """Stages blobs (entity_id, name, data, content_type) of any number, in place of those of the same names."""
        blobs = at.one_per_name(blobs, lambda names: self.session.store.park(names, []))
        self._stage(blobs.select(at.file_name(F.col("entity_id"), F.col("name")).alias("filename")), blobs)

    def delete(self, entity_id: Any, name: str) -> None:
        """Stages the removal of one attachment; nothing happens if there is none."""
        self.delete_all(self.session.spark.createDataFrame([(f"{entity_id}/{name}",)], "filename string"))

    def delete_all(self, names: DataFrame) -> None:
        """Stages the removal of the files of those file names."""
        self._stage(names.select("filename"))

    def _stage(self, names: DataFrame, blobs: DataFrame | None = None) -> None:
        """Files of these names go, saved ones and staged ones; then the blobs come."""
        files, chunks = self.session._staged[self.files], self.session._staged[self.chunks]
        named = at.file_name(F.col("entity_id"), F.col("name"))
        files.blobs = [(t, b.withColumn("filename", named).join(names, "filename", "left_anti").drop("filename")) for t, b in files.blobs]
        files.names.append(names)
        if blobs is not None:
            files.blobs.append((uuid.uuid4().hex, blobs))
        gone = self.session.base(self.files).join(reduce(DataFrame.union, files.names), "filename", "left_semi").select("_id")
        files.deletes = [gone]
        chunks.deletes = [self.session.base(self.chunks).join(gone.toDF("files_id"), "files_id", "left_semi").select("_id")]
        files.inserts = [at.files_of(b, token=t).withColumn(ch.SEQ, F.lit(i)) for i, (t, b) in enumerate(files.blobs)]
        chunks.inserts = [at.chunks_of(b, token=t).withColumn(ch.SEQ, F.lit(i)) for i, (t, b) in enumerate(files.blobs)]
        files.fresh = chunks.fresh = len(files.blobs)

    def get(self, entity_id: Any, name: str) -> bytes:
        """One attachment; FileNotFoundError if there is none."""
        return at.fetch(*self.tables(), str(entity_id), name)

    def all(self) -> DataFrame:
        """All files with their data, and whether they are complete."""
        return at.reassembled(*self.tables())

    def names(self, entity_id: Any) -> DataFrame:
        """(name, content_type, size) of a document's attachments."""
        return at.names_of(self.tables()[0], str(entity_id))
