"""Stored runs and their traces. A trace is JSON whose record kinds need not be known: it is read as VARIANT, and whatever
an operation doesn't touch goes through as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OBJECT = "map<string,variant>"


def new_runs(stored: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to append, rejected): a run is stored once; of equal ids in one batch the first goes in, of equal times any one."""
    numbered = runs.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("arrived")))
    marked = numbered.join(stored.select("id").distinct().withColumn("_held", F.lit(True)), "id", "left").select(*runs.columns, ((F.col("_n") == 1) & F.col("_held").isNull()).alias("_new"))
    return marked.where("_new").drop("_new"), marked.where("not _new").drop("_new")


def entries(trace: Column) -> Column:
    """array<variant> of a JSON trace; null where it isn't a JSON array."""
    return F.try_variant_get(F.try_parse_json(trace), "$", "array<variant>")


def look_up(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The stored runs (id, trace) with these ids, with the trace's `entries`."""
    return runs.join(wanted.select("id").distinct(), "id", "left_semi").withColumn("entries", entries(F.col("trace")))


def field(entry: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(entry, path, kind)


def rebuilt(entry: Column, **changes: Column | None) -> Column:
    """The object with some of its fields (names to variants) replaced, or taken out by None; the others stay as they are.
    What isn't an object stays as it is."""
    fields = F.try_variant_get(entry, "$", _OBJECT)
    kept = F.map_filter(fields, lambda k, _: ~k.isin(*changes))
    put = [F.create_map(F.lit(k), v) for k, v in changes.items() if v is not None]
    return F.coalesce(F.to_variant_object(F.map_concat(kept, *put) if put else kept), entry)


def without_denials(trace: Column) -> Column:
    """The entries without the checks that denied a chunk, for readers of their own runs only."""

    def seen(e: Column) -> Column:
        checks = F.try_variant_get(e, "$.access", "array<variant>")
        allowed = F.filter(checks, lambda a: F.coalesce(field(a, "$.allowed", "boolean"), F.lit(False)))
        return F.when(checks.isNull(), e).otherwise(rebuilt(e, access=F.to_variant_object(allowed)))

    return F.transform(entries(trace), seen)


def migrate_trace(trace: Column) -> Column:
    """The entries, where `contradicts_verdict` stays only in explanations of runs that have an answer step."""
    all_ = entries(trace)
    answered = F.exists(all_, lambda e: F.coalesce(field(e, "$.step") == "answer", F.lit(False)))

    def moved(e: Column) -> Column:
        record = F.try_variant_get(e, "$.record", "variant")
        explains = F.coalesce(field(e, "$.record.kind") == "explain", F.lit(False))
        return F.when(explains & ~answered, rebuilt(e, record=rebuilt(record, contradicts_verdict=None))).otherwise(e)

    return F.transform(all_, moved)


def as_json(entries_: Column) -> Column:
    """A JSON array of entries, each object's fields by name."""
    return F.concat(F.lit("["), F.array_join(F.transform(entries_, lambda e: F.to_json(e)), ","), F.lit("]"))


def migrate_acl(acl: Column) -> Column:
    """Untagged entries: role-shaped ones become role:<name>, others user:<id>; sorted, once each."""
    return F.array_sort(F.array_distinct(F.transform(acl, lambda a: F.when(a.rlike("^(role|user):"), a).when(a.rlike("^[a-z0-9_.:-]+$"), F.concat(F.lit("role:"), a)).otherwise(F.concat(F.lit("user:"), a)))))
