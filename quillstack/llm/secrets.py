"""Secret scans with an incremental blob ledger (operator 9), in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. The ledger says which rule versions have seen
which blob, and what they found; only unseen pairs are scanned, each once however many paths hold the blob, and
the findings are joined back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstack.llm.textcore import quoted
from quillstack.session import materialize, remove, table

_SPANS = "array<struct<kind: string, start: long, end: long>>"
_KEPT = "array<struct<rule: string, kind: string, start: long, end: long>>"
_PARTS = "array<struct<rule: string, kind: string, at: int, gap: int, size: int, counts: boolean>>"
LEDGER = f"blob binary, rules array<string>, findings {_KEPT}"


@dataclass(frozen=True)
class Rule:
    """A pattern; a match stays if its `group` has `least` characters. A changed rule takes a new version."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1
    base: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.version}"


#: In the order of a span list. Runs of 32 or 16 characters can be asked for at once, since runs don't overlap.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, base=True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16, base=True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, base=True),
    Rule("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 20),
)


def parts(text: Column, rule: Rule) -> Column:
    """A row a match of a rule in order: the characters before it since the last one, its own, and those of its group. Places
    are summed up over rows, not in the array: that would copy it for each match."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    held = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    row = F.transform(
        F.arrays_zip(gaps.alias("gap"), F.transform(matches, F.char_length).alias("size"), F.transform(held, F.char_length).alias("held")),
        lambda p, i: F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.kind).alias("kind"), i.alias("at"), p["gap"].alias("gap"), p["size"].alias("size"), (p["held"] >= rule.least).alias("counts")),
    )
    return F.when(text.rlike(rule.pattern), F.filter(row, lambda p: p["size"].isNotNull())).otherwise(F.array().cast(_PARTS))


def placed(rows: DataFrame) -> DataFrame:
    """(blob, findings) of rows (blob, parts): each match's place, in code points, is the sum of all before it."""
    each = rows.select("blob", F.inline("parts"))
    upto = F.sum(F.col("gap").cast("long") + F.col("size")).over(Window.partitionBy("blob", "rule").orderBy("at"))
    spans = each.withColumn("end", upto).where("counts").select("blob", F.struct("rule", "kind", (F.col("end") - F.col("size")).alias("start"), "end").alias("f"))
    return spans.groupBy("blob").agg(F.collect_list("f").alias("findings"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan(paths: DataFrame, path: str, text: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(path, findings array<struct<kind, start, end>>) for each row, and the ledger's new rows (written already).

    A row is one version of one path; other columns are not read. Null texts are empty, and empty texts have no
    findings; texts of any length are scanned whole; rows with equal texts share one scan; repeated rows keep their
    rows. An empty table adds nothing to the ledger. Findings go by start, then by the rules' order. Each finding in the
    ledger names its rule version, and only those of `rules` as they are now come back: what an older version or a rule
    that was taken out has found stays in the ledger alone, for the day that it is put in again.
    """
    names = [r.name for r in rules]
    held = paths.select(quoted(path).alias("path"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"))
    blob = F.unhex(F.sha2("text", 256)).alias("blob")
    blobs = held.select(blob, "text").groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
        blobs = blobs.join(seen, "blob", "left")
    else:
        blobs = blobs.withColumn("seen", F.lit(None).cast("array<string>"))
    unseen = F.array_except(F.array(*map(F.lit, names)), F.coalesce("seen", F.array().cast("array<string>")))
    blobs = blobs.select("blob", "text", unseen.alias("rules")).where(F.size("rules") > 0)
    # The flag keeps the patterns of seen rules from running.
    found = F.flatten(F.array(*[F.when(F.array_contains("rules", r.name), parts(F.col("text"), r)).otherwise(F.array().cast(_PARTS)) for r in rules]))
    scanned = materialize(blobs.select("blob", "rules", found.alias("parts")), "scanned")
    findings = placed(scanned.where(F.size("parts") > 0))
    none = F.array().cast(_KEPT)
    new = materialize(scanned.select("blob", "rules").join(findings, "blob", "left").select("blob", "rules", F.coalesce("findings", none).cast(_KEPT).alias("findings")), "ledger")
    remove(scanned)

    known = new if ledger is None else new.unionByName(ledger)
    known = known.where(F.size("findings") > 0).withColumn("f", F.explode("findings"))
    order = F.array_position(F.array(*map(F.lit, names)), F.col("f.rule"))
    span = F.struct(*[F.col(f"f.{x}").alias(x) for x in ("kind", "start", "end")])
    mine = known.where(order > 0).groupBy("blob").agg(F.sort_array(F.collect_set(F.struct(F.col("f.start").alias("start"), order.alias("order"), span.alias("f")))).alias("all"))
    mine = materialize(mine.select("blob", F.transform("all", lambda x: x["f"]).alias("findings")), "findings")
    back = held.select("path", blob).join(mine, "blob", "left")
    return back.select("path", F.coalesce("findings", F.array().cast(_SPANS)).alias("findings")), new


def kind_is(kind: str):
    return lambda span: span["kind"] == kind


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = scan(table(spark, sf_dir, "documents"), "doc_id", "text")
    base = [r.kind for r in RULES if r.base]
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = [F.size(F.filter("findings", kind_is(k))).cast("long").alias(f"n_{k}") for k in base]
    return found.select(F.col("path").alias("doc_id"), *count, F.sha2(joined(F.filter("findings", lambda x: x["kind"].isin(*base))), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
