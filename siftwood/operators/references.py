"""References to records that do not exist, were deleted or came later.

Parent keys are integers with gaps. Sorted, they are compressed into contiguous
runs (start, end); a reference is matched as of the run that starts at or before
it, and is an orphan if it lies beyond that run's end. Keys are cut into buckets
of `BUCKET` consecutive numbers first: a run never leaves its bucket, so the
match is a window over one bucket, bounded whatever the data. References are
reduced to distinct keys before, so that a target to which a tenth of the rows
point is one key.

What exists gets one row with its times. Only keys that could be a case for some
reference (missing, deleted, or first indexed after the earliest reference) are
joined back to the references.

Defined results: references whose id or type is null are no case, nor is a type
without a table; a comparison with a null time is no case; repeated rows of a
reference are one case; extra columns are ignored; an empty parent table makes
every reference to it 'missing' or 'deleted'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwood.session import materialize

#: Consecutive keys that are matched in one go.
BUCKET = 1 << 16
#: Kinds of edges whose written path is looked up.
PATH_KINDS = ("includes", "references", "execs")


def runs(keys: DataFrame) -> DataFrame:
    """type, bucket, first and last of the contiguous runs of distinct keys (type, id) within a bucket."""
    order = Window.partitionBy("type", "bucket").orderBy("id")
    placed = keys.select("type", "id", F.floor(F.col("id") / BUCKET).alias("bucket")).withColumn("island", F.col("id") - F.row_number().over(order))
    return placed.groupBy("type", "bucket", "island").agg(F.min("id").alias("first"), F.max("id").alias("last")).drop("island")


def orphans(references: DataFrame, keys: DataFrame) -> DataFrame:
    """The distinct references (type, id) that no key (type, id) answers."""
    parents = runs(keys).select("type", "bucket", F.col("first").alias("id"), "last")
    asked = references.select("type", "id").distinct()
    asked = asked.select("type", F.floor(F.col("id") / BUCKET).alias("bucket"), "id", F.lit(None).cast("bigint").alias("last"), F.lit(1).alias("asks"))
    both = parents.withColumn("asks", F.lit(0)).unionByName(asked)
    order = Window.partitionBy("type", "bucket").orderBy("id", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = both.withColumn("end", F.last("last", ignorenulls=True).over(order))
    return matched.where((F.col("asks") == 1) & (F.col("end").isNull() | (F.col("end") < F.col("id")))).select("type", "id")


def _latest(tombstones: DataFrame) -> DataFrame:
    return (
        tombstones.where("entity_type is not null and entity_id is not null")
        .groupBy(F.col("entity_type").alias("type"), F.col("entity_id").alias("id"))
        .agg(F.max("deleted_at").alias("deleted_at"))
    )


def _file_times(files: DataFrame, latest: DataFrame) -> DataFrame:
    """id, first, gone of each file: when it was first indexed, and whether it was deleted after the last time."""
    dead = latest.where("type = 'file'").select("id", "deleted_at")
    seen = (
        files.where("file_id is not null")
        .groupBy(F.col("file_id").alias("id"))
        .agg(F.min("indexed_at").alias("first"), F.max("indexed_at").alias("last"), F.max("rel_path").alias("rel_path"))
    )
    return seen.join(dead, "id", "left").select(
        "id", "rel_path", "first", "last", F.coalesce(F.col("deleted_at") > F.col("last"), F.lit(False)).alias("gone")
    )


def normalized(folder: F.Column, raw: F.Column) -> F.Column:
    """The path that raw names from folder, or null if it goes up beyond the top.

    What follows ? or # is dropped, empty and . parts are ignored, .. goes up.
    """
    cut = F.regexp_replace(raw, "[?#].*$", "")
    parts = F.filter(F.split(F.concat_ws("/", folder, cut), "/"), lambda x: (x != "") & (x != "."))
    # a part that goes up takes the last one away; beyond the top the path is lost
    folded = F.aggregate(
        parts,
        F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok")),
        lambda acc, x: F.struct(
            F.when(x != "..", F.concat(acc["p"], F.array(x)))
            .when(F.size(acc["p"]) > 0, F.slice(acc["p"], F.lit(1), F.greatest(F.size(acc["p"]) - 1, F.lit(0))))
            .otherwise(acc["p"])
            .alias("p"),
            (acc["ok"] & ((x != "..") | (F.size(acc["p"]) > 0))).alias("ok"),
        ),
    )
    return F.when(folded["ok"], F.array_join(folded["p"], "/"))


def stripped(raw: F.Column) -> F.Column:
    """raw without blanks and quotes around it."""
    return F.regexp_replace(raw, "^[\\s\"'`]+|[\\s\"'`]+$", "")


def dangling(
    edges: DataFrame,
    files: DataFrame,
    symbols: DataFrame,
    resources: DataFrame,
    tombstones: DataFrame,
) -> DataFrame:
    """edge_id, side, reason, and for reports type and seen_at, of every reference that is a case."""
    latest = _latest(tombstones)
    times = materialize(_file_times(files, latest), "files")
    owners = symbols.where("symbol_id is not null").groupBy(F.col("symbol_id").alias("id")).agg(F.min("file_id").alias("file_id"))
    things = resources.where("resource_id is not null").select(F.col("resource_id").alias("id")).distinct()
    keys = (
        times.select(F.lit("file").alias("type"), "id")
        .unionByName(owners.select(F.lit("symbol").alias("type"), "id"))
        .unionByName(things.select(F.lit("resource").alias("type"), "id"))
    )

    ids = edges.where("edge_id is not null")
    src = ids.select("edge_id", F.lit("src").alias("side"), F.col("src_type").alias("type"), F.col("src_id").alias("id"), "seen_at")
    dst = ids.select("edge_id", F.lit("dst").alias("side"), F.col("dst_type").alias("type"), F.col("dst_id").alias("id"), "seen_at")
    refs = src.unionByName(dst).where("id is not null and type in ('file', 'symbol', 'resource')")

    # distinct keys with the time of the earliest reference to each
    asked = materialize(refs.groupBy("type", "id").agg(F.min("seen_at").alias("earliest")), "asked")
    absent = orphans(asked, keys).join(latest.select("type", "id", F.lit(True).alias("named")), ["type", "id"], "left")
    absent = absent.select("type", "id", F.when(F.col("named"), "deleted").otherwise("missing").alias("always"), F.lit(None).cast("timestamp_ntz").alias("first"))

    file_keys = times.select(F.lit("file").alias("type"), "id", "first", "gone")
    dead = latest.where("type = 'symbol'").select("id", "deleted_at")
    symbol_keys = (
        owners.join(asked.where("type = 'symbol'").select("id"), "id", "left_semi")
        .join(times.select(F.col("id").alias("file_id"), "first", "last", "gone"), "file_id", "left")
        .join(dead, "id", "left")
        .select(
            F.lit("symbol").alias("type"), "id", "first",
            (F.coalesce("gone", F.lit(False)) | F.coalesce(F.col("deleted_at") > F.col("last"), F.lit(False))).alias("gone"),
        )
    )
    present = asked.join(file_keys.unionByName(symbol_keys), ["type", "id"]).where(F.col("gone") | (F.col("first") > F.col("earliest")))
    present = present.select("type", "id", F.when(F.col("gone"), "deleted").alias("always"), F.col("first").cast("timestamp_ntz").alias("first"))
    suspects = materialize(absent.unionByName(present), "suspects")

    things_found = refs.join(suspects, ["type", "id"]).where("always is not null or first > seen_at")
    things_found = things_found.select("edge_id", "side", F.coalesce("always", F.lit("late")).alias("reason"), "type", "seen_at")
    return things_found.unionByName(_paths(ids, times)).dropDuplicates(["edge_id", "side"])


def _paths(edges: DataFrame, times: DataFrame) -> DataFrame:
    """The cases of side 'raw': what no file that the written path names answers."""
    name = stripped(F.col("raw"))
    asks = edges.where(F.col("dst_id").isNull() & F.col("kind").isin(*PATH_KINDS)).select("edge_id", "file_id", "seen_at", name.alias("name"))
    asks = asks.where(F.col("name").startswith("./") | F.col("name").startswith("../"))
    folder = times.select(F.col("id").alias("file_id"), F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1).alias("folder"))
    placed = asks.join(folder, "file_id", "left")
    placed = placed.select("edge_id", "seen_at", F.when(F.col("folder").isNotNull(), normalized(F.col("folder"), F.col("name"))).alias("path"))

    # one row per path that may be named: whether a file of it lives, and since when at the earliest
    bare = F.regexp_replace("rel_path", r"\.[^./]*$", "")
    named = times.where("rel_path is not null").select(F.explode(F.array_distinct(F.array(F.col("rel_path"), bare))).alias("path"), "first", "gone")
    known = named.groupBy("path").agg(
        F.min(F.when(~F.col("gone"), F.col("first"))).alias("since"), F.bool_or(~F.col("gone")).alias("lives"),
    )
    joined = placed.join(known, "path", "left")
    reason = (
        F.when(F.col("lives").isNull(), "missing")
        .when(~F.col("lives"), "deleted")
        .when(F.col("since") > F.col("seen_at"), "late")
    )
    return joined.select("edge_id", F.lit("raw").alias("side"), reason.alias("reason"), F.lit("path").alias("type"), "seen_at").where("reason is not null")


def report(cases: DataFrame) -> DataFrame:
    """side, referred table, month of seen_at and reason, with the number of cases."""
    return (
        cases.groupBy("side", "type", F.date_format("seen_at", "yyyy-MM").alias("month"), "reason")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("side", F.col("type").alias("referred"), "month", "reason", "n")
    )
