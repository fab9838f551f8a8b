"""Binary attachments: named blobs of a document, cut into chunks.

Two tables: ``files`` (one row per document and name) and ``chunks`` (numbered parts of at most
``CHUNK`` bytes).  An empty or null blob has a file row of length 0 and no chunk.  Storing under a name that is taken
replaces it.  Of several blobs of one document and name in a batch one is stored: the one with the highest ``seq``
if the batch has this column, else the longest, of equally long ones the one with the highest hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 255 * 1024
DEFAULT_TYPE = "application/octet-stream"
FILES = "_id string, length bigint, chunkSize int, uploadDate timestamp, filename string, metadata struct<EntityId: string, Name: string, ContentType: string>"
CHUNKS = "_id string, files_id string, n int, data binary"
BLOBS = "entity_id string, name string, data binary, content_type string"


class CorruptAttachment(Exception):
    """A file whose chunks are not all there."""


def file_name(entity_id: Column, name: Column) -> Column:
    return F.concat(entity_id.cast("string"), F.lit("/"), name)


def one_per_name(blobs: DataFrame, settle: Callable[[DataFrame], DataFrame] = lambda names: names) -> DataFrame:
    """The blobs (entity_id, name, data, content_type) that are stored, one per document and name.  Only blobs whose name is
    repeated are shuffled, if ``settle`` writes these names, so that the planner knows that they are few."""
    by = ["entity_id", "name"]
    size = F.coalesce(F.length("data"), F.lit(0))
    order = F.col("seq") if "seq" in blobs.columns else F.struct(size, F.xxhash64("data"), F.xxhash64("content_type"))
    again = settle(blobs.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(*by))
    last = blobs.join(again, by, "left_semi").groupBy(*by).agg(F.max_by(F.struct("data", "content_type"), order).alias("__b"))
    return blobs.join(again, by, "left_anti").select(*by, "data", "content_type").unionByName(last.select(*by, "__b.data", "__b.content_type"))


def _file_id(token: str) -> Column:
    return F.sha2(F.concat(file_name(F.col("entity_id"), F.col("name")), F.lit(token)).cast("binary"), 256)


def files_of(blobs: DataFrame, chunk: int = CHUNK, token: str = "") -> DataFrame:
    """The files table of blobs (entity_id, name, data, content_type), each name once.  A file's id is the hash of its name
    and ``token``, so both tables come from the blobs without materialising random ids first."""
    kind = F.coalesce(F.col("content_type"), F.lit(DEFAULT_TYPE))
    return blobs.select(
        _file_id(token).alias("_id"), F.coalesce(F.length("data"), F.lit(0)).cast("bigint").alias("length"), F.lit(chunk).alias("chunkSize"),
        F.current_timestamp().alias("uploadDate"), file_name(F.col("entity_id"), F.col("name")).alias("filename"),
        F.struct(F.col("entity_id").cast("string").alias("EntityId"), F.col("name").alias("Name"), kind.alias("ContentType")).alias("metadata"),
    )


def chunks_of(blobs: DataFrame, chunk: int = CHUNK, token: str = "") -> DataFrame:
    """The chunks table of the same blobs."""
    n = F.ceil(F.length("data") / chunk).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("data"), i * chunk + 1, F.lit(chunk)))
    numbered = blobs.filter(F.length("data") > 0).select(_file_id(token).alias("files_id"), F.posexplode(parts).alias("n", "data"))
    return numbered.select(F.concat_ws("/", "files_id", F.col("n").cast("string")).alias("_id"), "files_id", "n", "data")


def stored(files: DataFrame, chunks: DataFrame, blobs: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Both tables with the blobs stored, in place of files of the same name."""
    blobs = one_per_name(blobs)
    new_files, new_chunks = files_of(blobs, chunk), chunks_of(blobs, chunk)
    left_files, left_chunks = deleted(files, chunks, new_files.select("filename"))
    return left_files.unionByName(new_files), left_chunks.unionByName(new_chunks)


def deleted(files: DataFrame, chunks: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the files of those file names."""
    gone = files.join(names.select("filename"), "filename", "left_semi").select(F.col("_id").alias("files_id"))
    return files.join(names.select("filename"), "filename", "left_anti").select(*files.columns), chunks.join(gone, "files_id", "left_anti").select(*chunks.columns)


def reassembled(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """files with ``data``, its chunks in order; ``complete`` says whether all of them are there."""
    whole = chunks.groupBy("files_id").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY n)").alias("data"), F.count(F.lit(1)).alias("parts"))
    out = files.join(whole, files["_id"] == whole["files_id"], "left")
    data = F.coalesce("data", F.lit(bytearray()))
    return out.select(*files.columns, data.alias("data"), ((F.length(data) == F.col("length")) & (F.coalesce("parts", F.lit(0)) == F.ceil(F.col("length") / F.col("chunkSize")))).alias("complete"))


def names_of(files: DataFrame, entity_id: str) -> DataFrame:
    """(name, content_type, size) of a document's attachments."""
    own = files.filter(F.col("metadata.EntityId") == entity_id)
    return own.select(F.col("metadata.Name").alias("name"), F.col("metadata.ContentType").alias("content_type"), F.col("length").alias("size"))


def fetch(files: DataFrame, chunks: DataFrame, entity_id: str, name: str) -> bytes:
    """One attachment; FileNotFoundError if there is none, CorruptAttachment if chunks are missing."""
    own = files.filter(F.col("filename") == f"{entity_id}/{name}")
    key = own.select(F.col("_id").alias("files_id"))
    row = reassembled(own, chunks.join(key, "files_id", "left_semi")).first()
    if row is None:
        raise FileNotFoundError(f"{entity_id}/{name}")
    if not row["complete"]:
        raise CorruptAttachment(f"{entity_id}/{name}")
    return bytes(row["data"])
