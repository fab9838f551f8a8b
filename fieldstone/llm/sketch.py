"""Document fingerprints: bottom-k sketches of shingle hashes, all in DataFrame functions.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's word shingles.  The
sketch of a whole is the k smallest of its parts' sketches, so sketches merge across the parts of a
text or corpus in any order.  Two sketches estimate the resemblance (shared share of all shingles), the
containment (shared share of one text's shingles) and each gives the number of distinct shingles.

Shingles are five consecutive lower-cased words (anything between white space); a text of one to four words
is one shingle.  A shingle's hash is made of its words' hashes, each taken once.

Defined results: null and empty texts have empty sketches, two empty sketches are alike (1), an empty and another
not (0); very long texts are sketched whole; equal texts have equal sketches; equal hashes count once, so ties can't
arise; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

K = 128
WIDTH = 5
SPAN = float(1 << 64)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Lower-cased words; null and empty texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+", -1), lambda w: w != "")


def shingle_hashes(tokens: Column, width: int = WIDTH) -> Column:
    """The distinct hashes of all runs of ``width`` words."""

    def of(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))
        return F.when(n >= width, F.array_distinct(runs)).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), of)


def bottom(hashes: Column, k: int = K) -> Column:
    """The k smallest, sorted."""
    return F.slice(F.sort_array(hashes), 1, k)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The text's sketch, array<bigint>."""
    return bottom(shingle_hashes(words(text), width), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return bottom(F.array_union(a, b), k)


def merge_all(sketches: DataFrame, by: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch per group, without gathering a group in one task: each hash is a row, repeated
    hashes go before the shuffle, and only k per salted part and then k per group remain."""
    hashes = sketches.select(*by, F.explode(column).alias("__h")).groupBy(*by, "__h").agg(F.lit(1))
    salted = hashes.withColumn("__part", F.pmod(F.xxhash64("__h"), F.lit(64)))
    part = salted.groupBy(*by, "__part").agg(bottom(F.collect_list("__h"), k).alias("__s"))
    return part.groupBy(*by).agg(bottom(F.flatten(F.collect_list("__s")), k).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's sketch that both texts have; 1 for two empty sketches."""

    def of(union: Column) -> Column:
        shared = F.size(F.array_intersect(union, F.array_intersect(a, b)))
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(shared / F.size(union))

    return let(merge(a, b, k), of)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k; else (k - 1) over the share of the hash range below the k-th smallest."""
    share = (F.element_at(a, k).cast("double") + F.lit(SPAN / 2)) / F.lit(SPAN)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a's shingles that b has; 1 for an empty a."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """The hashes in hexadecimal, joined by nothing: 16 digits each."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


RANGE_BYTES, TASK_BYTES = 512 << 20, 1 << 30  # of text in a window, which spills, and in a task


def constants(values: list, kind: str) -> Column:
    """An array of constants; one literal, however many they are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def placed(rows: DataFrame, parts: int, hot: list[tuple[int | None, int]]) -> DataFrame:
    """``rows`` (doc_id, h, ...) with ``range``: numbers that rise with (doc_id, h), nulls first, of at most about ``parts``
    ranges of as many ids each.  ``hot`` ids with many rows are cut by h into as many ranges as are given beside them."""
    q = [i / parts for i in range(1, parts)] or [0.5]
    ids = rows.agg(F.percentile_approx("doc_id", constants(q, "double"), F.lit(max(10_000, 10 * parts))).alias("q")).first()[0]
    own = [i for i, _ in hot if i is not None]
    bounds = sorted({*(ids or []), *own, *(i + 1 for i in own)})
    step = max(1, int(len(bounds) ** 0.5))
    fine, coarse = constants(bounds, "bigint"), constants(bounds[::step], "bigint")

    def below(array: Column, key: Column) -> Column:
        return F.size(F.filter(array, lambda b: b <= key))

    key = F.col("doc_id")
    block = below(coarse, key)
    place = F.when(key.isNull(), F.lit(0)).when(block == 0, F.lit(1)).otherwise(1 + (block - 1) * step + below(F.slice(fine, (block - 1) * step + 1, step), key))
    cut = F.when(key.isNull(), F.lit(dict(hot).get(None, 1)))
    if own:
        cut = cut.when(key.isin(own), F.element_at(F.create_map(*[F.lit(x).cast("bigint") for i, n in hot if i is not None for x in (i, n)]), key))
    cut = cut.otherwise(1)
    share = F.col("h") / F.lit(SPAN) + 0.5
    return rows.withColumn("range", F.struct(place.alias("place"), F.least(F.floor(share * cut), cut - 1).alias("sub")))


def with_next(rows: DataFrame, parts: int, tasks: int, hot: list[tuple[int | None, int]], k: int) -> DataFrame:
    """``rows`` (doc_id, h, text, copies) with their sketch ``s`` and ``after``, the text and sketch of the next row by (doc_id, h),
    the first following the last.

    Each range is a window of its own; the first row of every range is also given to the range before it, as a
    guard row that closes that window.  Texts are shuffled once and sketched behind the shuffle."""
    ranged = placed(rows, parts, hot)
    firsts = ranged.groupBy("range").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    chain = Window.orderBy("range")  # one row per range
    ends = firsts.select("range", "first", F.row_number().over(chain).alias("n"), F.count(F.lit(1)).over(Window.partitionBy()).alias("all"))
    guard = ends.select("first", F.when(F.col("n") > 1, F.col("n") - 1).otherwise(F.col("all")).alias("n"))
    to = guard.join(ends.select(F.col("range").alias("to"), "n"), "n").select(F.col("first.doc_id").alias("of"), F.col("first.h").alias("at"), "to")
    to = settle(to, "guards")
    guards = rows.join(F.broadcast(to), rows["doc_id"].eqNullSafe(to["of"]) & (rows["h"] == to["at"]))  # one row per range
    guards = guards.select(*rows.columns, F.col("to").alias("range"), F.lit(1).alias("guard"))
    both = ranged.withColumn("guard", F.lit(0)).unionByName(guards).repartition(tasks, "range").withColumn("s", sketch(F.col("text"), k))
    line = Window.partitionBy("range").orderBy("guard", F.col("doc_id").asc_nulls_first(), "h")
    return both.withColumn("after", F.lead(F.struct("text", "s")).over(line)).filter("guard = 0").drop("guard", "range")


CHUNK = 10_000


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, parts: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id (a whole number), n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, distinct_shingles.

    The edited text has its last quarter of code points replaced by as many first ones (or all) of
    the next document in ascending id, the first following the last.  Rows without an id come first; rows that
    share an id follow one another by the hash of their text, and of equal rows each but the last is followed by its equal."""
    shuffled = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size, n = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.count(F.lit(1))).first()
    parts = parts or max(1, 4 * shuffled, -(-size // RANGE_BYTES))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(1).cast("bigint").alias("copies"))
    shared = settle(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "shared-ids")
    repeated, hot = not shared.isEmpty(), []
    if repeated:
        ids = shared.select(F.col("doc_id").alias("of"), "rows")
        same = rows["doc_id"].eqNullSafe(ids["of"])
        several = rows.join(ids, same, "left_semi").groupBy("doc_id", F.xxhash64("text").alias("h"), "text").agg(F.count(F.lit(1)).alias("copies"))
        rows = settle(rows.join(ids, same, "left_anti").unionByName(several), "rows")
        most = max(1, n // parts)  # rows of a range, so that at most ``parts`` ids have more
        hot = [(r[0], 1 + r[1] // most) for r in rows.groupBy("doc_id").count().filter(F.col("count") > most).collect()]
    near = with_next(rows, parts, max(shuffled, -(-size // TASK_BYTES)), hot, k)
    nexts = F.struct("after", F.lit(1).cast("bigint").alias("times"))
    if repeated:
        itself = F.struct(F.struct("text", "s").alias("after"), (F.col("copies") - 1).alias("times"))
        near = near.withColumn("next", F.explode(F.when(F.col("copies") > 1, F.array(nexts, itself)).otherwise(F.array(nexts))))
    else:
        near = near.withColumn("next", nexts)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.col("next.after.text"), F.lit(1), cut))
    out = near.select("doc_id", n.cast("long").alias("n_chars"), "s", F.col("next.after.s").alias("next"), edited.alias("edited"), F.col("next.times").alias("times"))
    out = out.withColumn("e", sketch(F.col("edited"), k))
    columns = [
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("s")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
        resemblance(F.col("s"), F.col("e"), k).alias("near_edited"), resemblance(F.col("s"), F.col("next"), k).alias("near_next"),
        distinct_shingles(F.col("s"), k).alias("distinct_shingles"),
    ]
    if not repeated:
        return out.select(*columns)
    # Copies are written out in chunks that are dealt to all tasks.
    out = out.select(*columns, "times").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(times - 1) div {CHUNK}")))).repartition(shuffled)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(CHUNK), F.col("times") - F.col("chunk") * CHUNK))))
    return out.drop("times", "chunk", "copy")
