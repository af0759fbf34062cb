"""Who may read what: compiled scopes, filters, decisions and label rules, as joins and expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.session import broadcast_small

#: From the least to the most sensitive.
SENSITIVITIES = ("public", "internal", "confidential")
ACL_ENTRY = "^(user:[^\\p{Cntrl}]+|role:[a-z0-9_.:-]+)$"


def level(sensitivity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SENSITIVITIES)), sensitivity)


def compile_scopes(principals: DataFrame, members: DataFrame, grants: DataFrame, everyone: tuple[str, ...]) -> DataFrame:
    """A row a principal (user_id, asserted array): its members and its grants in role order, and the levels these clear.

    A role is held if it is asserted, everyone's or the user's by `members` (user_id, role). `grants` is (role, clearance).
    """
    roles = principals.select("user_id", F.explode(F.array_union(F.coalesce("asserted", F.array().cast("array<string>")), F.array(*map(F.lit, everyone)))).alias("role"))
    roles = roles.union(members.join(principals.select("user_id"), "user_id", "left_semi").select("user_id", "role")).distinct()
    held = roles.join(grants, "role", "left").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("role", "clearance"))).alias("held"))
    joined = principals.select("user_id").join(held, "user_id", "left").withColumn("held", F.coalesce("held", F.array().cast("array<struct<role:string,clearance:string>>")))
    cleared = F.filter("held", lambda g: g["clearance"].isNotNull())
    highest = F.coalesce(F.array_max(F.transform(cleared, lambda g: level(g["clearance"]))), F.lit(0))
    entries = F.array_sort(F.concat(F.array(F.concat(F.lit("user:"), F.col("user_id"))), F.transform("held", lambda g: F.concat(F.lit("role:"), g["role"]))))
    return joined.select("user_id", entries.alias("members"), cleared.alias("grants"), F.slice(F.array(*map(F.lit, SENSITIVITIES)), 1, highest.cast("int")).alias("sensitivities"))


def in_scope(acl: str, sensitivity: str, members: str, sensitivities: str) -> Column:
    return ((F.size(acl) == 0) | F.arrays_overlap(acl, members)) & F.array_contains(F.col(sensitivities), F.col(sensitivity))


def readable(chunks: DataFrame, scopes: DataFrame) -> DataFrame:
    """(user_id, chunk columns) of each chunk in each stated scope."""
    return chunks.join(broadcast_small(scopes), in_scope("acl", "sensitivity", "members", "sensitivities")).drop("members", "grants", "sensitivities")


def decision(acl: str, sensitivity: str, members: str, grants: str) -> Column:
    """`allowed by <role>`, `not_in_acl` or `no_grant`: the list first, then the first grant that clears."""
    clears = F.filter(grants, lambda g: level(g["clearance"]) >= level(F.col(sensitivity)))
    open_ = (F.size(acl) == 0) | F.arrays_overlap(acl, members)
    return F.when(~open_, F.lit("not_in_acl")).when(F.size(clears) == 0, F.lit("no_grant")).otherwise(F.concat(F.lit("allowed by "), F.try_element_at(clears, F.lit(1))["role"]))


def enforce(rows: DataFrame, scopes: DataFrame, key: str = "qid") -> tuple[DataFrame, DataFrame]:
    """(what may be read, all decisions): rows (key, acl, sensitivity, ...) with the `decision` of their question's scope
    (key, members, grants). A row whose question has no scope is denied; every row has a decision, kept or not."""
    held = scopes.select(key, "members", "grants")
    judged = rows.join(broadcast_small(held), key, "left")
    judged = judged.withColumn("decision", F.when(F.col("members").isNull(), "no_grant").otherwise(decision("acl", "sensitivity", "members", "grants"))).drop("members", "grants")
    return judged.where(F.col("decision").startswith("allowed")), judged


def run_decision(runs: Column, user: Column, owner: Column) -> Column:
    """Reading a stored run: `any`, `own` and nothing."""
    return F.when(runs == "any", "allowed").when((runs == "own") & (user == owner), "allowed").when(runs == "own", "not_owner").otherwise("no_grant")


def apply_label_rules(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Labels of documents (document_id, source, external_id) by all rules (rule, source, prefix, acl, sensitivity) that cover them.

    A rule covers its source and a path prefix of whole segments. Lists intersect (an empty one yields the other; a
    disjoint pair is an error), the highest sensitivity stays. Without a rule: anyone, internal. Every prefix of a
    path is a key, so the join is an equal one however many rules there are.
    """
    parts = F.split("external_id", "/")
    prefixes = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    keyed = docs.select("document_id", "source", F.explode(prefixes).alias("prefix")).join(rules, ["source", "prefix"])
    merged = keyed.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("rule", "acl", "sensitivity"))).alias("rules"))
    nobody = F.array(F.lit("!"))

    def tighten(s: Column, r: Column) -> Column:
        both = F.array_intersect(s, r["acl"])
        return F.when(F.size(r["acl"]) == 0, s).when(F.size(s) == 0, r["acl"]).when(F.size(both) == 0, nobody).otherwise(both)

    acl = F.aggregate("rules", F.array().cast("array<string>"), tighten)
    most = F.array_max(F.transform("rules", lambda r: level(r["sensitivity"])))
    rows = docs.join(merged, "document_id", "left").select("document_id", F.coalesce(acl, F.array().cast("array<string>")).alias("acl"), F.coalesce(F.get(F.array(*map(F.lit, SENSITIVITIES)), most.cast("int") - 1), F.lit("internal")).alias("sensitivity"))
    return rows.select("document_id", F.array_sort("acl").alias("acl"), "sensitivity", F.array_contains("acl", "!").alias("disjoint"))


def layer_of(paths: DataFrame, layers: DataFrame) -> DataFrame:
    """(path, standing) by the longest listed prefix of whole segments; unlisted paths and skipped ones are left out."""
    parts = F.split("path", "/")
    keyed = paths.select("path", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))).alias("prefix"))
    depth = F.when(F.col("prefix") == "", 0).otherwise(F.size(F.split("prefix", "/")))
    best = keyed.join(layers, "prefix").groupBy("path").agg(F.max_by("standing", depth).alias("standing"))
    return best.where("standing <> 'skip'")


