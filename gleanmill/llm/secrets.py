r"""Operator 10, secret scans: an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The
ledger has a row for each blob and rule version that was scanned, with the
findings in it. A run reduces its versions to distinct blobs, leaves out those
that the ledger has under the current rule version, scans the rest and appends
them; findings are then joined back to all paths, old and new. A rule set's
version is a digest of its rules, so changed rules scan everything again.

Positions come from built-in functions only: ``split`` by a pattern gives the
gaps between its matches, ``regexp_extract_all`` the matches, and a running
sum of their lengths in code points gives the spans.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, join_groups, key_ranges, table


@dataclass(frozen=True)
class Rule:
    """A pattern without look-around; matches whose ``group`` is shorter than ``least`` are dropped after matching."""

    kind: str
    pattern: str
    group: int
    least: int


#: The base rules, in the order in which spans with one start are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    Rule("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    # Runs are maximal, so asking for the length in the pattern finds the same spans as dropping short runs.
    Rule("hex", r"([0-9a-f]{24,})", 1, 24),
)
EMPTY = "array<struct<kind:int,start:long,end:long>>"
_HITS = "array<struct<kind:int,i:int,gap:long,whole:long,ok:boolean>>"
#: Loads in which a table is put into a ledger, and buckets of its table; at 100 TB use several thousand.
BATCHES, BUCKETS = 2, 16


def rule_version(rules: Sequence[Rule]) -> str:
    """A digest of the rules, the same in every session."""
    return hashlib.sha256(repr([(r.kind, r.pattern, r.group, r.least) for r in rules]).encode()).hexdigest()[:16]


def blob_of(text: Column) -> Column:
    """A text's content address; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _lengths(text: Column, rule: Rule, k: int) -> Column:
    """For each match: the rule, its number, the gap before it, its own length and that of its group; no rows for the many texts without one."""
    pattern = F.lit(rule.pattern)
    sizes = lambda parts, name: F.transform(parts, lambda x: F.length(x).cast("long")).alias(name)
    gaps = sizes(F.split(text, rule.pattern, -1), "gap")
    whole = sizes(F.regexp_extract_all(text, pattern, F.lit(1)), "whole")
    group = sizes(F.regexp_extract_all(text, pattern, F.lit(rule.group)), "group")
    found = F.filter(F.arrays_zip(gaps, whole, group), lambda x: x["whole"].isNotNull())
    rows = F.transform(found, lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["whole"].alias("whole"), (x["group"] >= rule.least).alias("ok")))
    return F.when(text.rlike(rule.pattern), rows).otherwise(F.expr("array()").cast(_HITS))


def _hits(text: Column, rules: Sequence[Rule]) -> Column:
    return F.flatten(F.array(*[_lengths(text, r, k) for k, r in enumerate(rules)])).alias("hits")


def _findings(hits: DataFrame) -> DataFrame:
    """blob, findings for every row of ``hits`` (blob, hits), a written table."""
    each = hits.where(F.size("hits") > 0).select("blob", F.explode("hits").alias("h")).select("blob", "h.*")
    so_far = Window.partitionBy("blob", "kind").orderBy("i")
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("whole")).over(so_far)).where("ok")
    spans = placed.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("whole")).alias("start"), "kind", "end"))).alias("found"))
    findings = F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return hits.select("blob").join(spans.select("blob", findings.alias("findings")), "blob", "left").select("blob", F.coalesce("findings", F.expr("array()").cast(EMPTY)).alias("findings"))


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """blob, findings array<struct<kind int, start long, end long>> for rows (blob, text) with distinct blobs.

    ``kind`` is a rule's place in ``rules``; findings are sorted by start, then
    kind, and hold code points, end exclusive. Texts without findings get an
    empty array.
    """
    return _findings(checkpointed(blobs.select("blob", _hits(F.coalesce(F.col("text"), F.lit("")), rules))))


class BlobLedger:
    """The ledger in the warehouse, by table name: blob, rule_version, findings; bucketed and sorted by blob."""

    def __init__(self, spark: SparkSession, name: str, rules: Sequence[Rule] = RULES, buckets: int = BUCKETS):
        self.spark, self.name, self.rules, self.version, self.buckets = spark, name, tuple(rules), rule_version(rules), buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def scanned(self) -> DataFrame:
        """blob, findings under the current rule version."""
        return self.spark.table(self.name).where(F.col("rule_version") == self.version).select("blob", "findings")

    def ingest(self, versions: DataFrame, text: str = "text") -> DataFrame:
        """Scans the blobs among the rows of ``versions`` that this rule version hasn't seen; returns blob, n (its rows) for all of them.

        Copies collapse within each task before the shuffle, so a hot text
        travels once for each task. Blobs meet the ledger before their texts
        are looked at. A repeated run finds its blobs scanned.
        """
        rows = versions.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        blobs = rows.groupBy("blob").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
        known = self.scanned().select("blob", F.lit(True).alias("known")) if self.exists() else None
        # An outer join, since an anti-join would be pushed below the aggregate, to all rows.
        blobs = blobs.withColumn("known", F.lit(None).cast("boolean")) if known is None else blobs.join(known, "blob", "left")
        hits = F.when(F.col("known").isNull(), _hits(F.col("text"), self.rules)).otherwise(F.expr("array()").cast(_HITS))
        found = checkpointed(blobs.select("blob", "n", F.col("known").isNotNull().alias("known"), hits.alias("hits")))
        new = _findings(found.where("NOT known").select("blob", "hits")).select("blob", F.lit(self.version).alias("rule_version"), "findings")
        dealt = new.repartition(self.buckets, "blob")
        dealt.write.mode("append").bucketBy(self.buckets, "blob").sortBy("blob").format("parquet").saveAsTable(self.name)
        return found.select("blob", "n")

    def groups(self, counts: list[DataFrame]) -> DataFrame:
        """blob, n, findings (null for none) of the blobs that ``ingest`` returned, as a checkpoint."""
        n = reduce(DataFrame.union, counts).groupBy("blob").agg(F.sum("n").alias("n"))
        return checkpointed(n.join(self.scanned().where(F.size("findings") > 0), "blob", "left"))

    def findings(self, versions: DataFrame, text: str = "text", name: str = "findings") -> DataFrame:
        """The rows of ``versions`` with column ``name`` appended (or replaced); blobs that were never ingested have none."""
        counts = versions.select(blob_of(F.col(text)).alias("blob")).groupBy("blob").agg(F.count(F.lit(1)).alias("n"))
        return with_findings(versions, self.groups([counts]), text, name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def with_findings(versions: DataFrame, groups: DataFrame, text: str = "text", name: str = "findings") -> DataFrame:
    """``versions`` with column ``name`` appended (or replaced) from ``groups`` (blob, n, findings), a checkpoint with a row for each blob.

    Rows of a hot blob find its findings where they are.
    """
    rows = versions.select(F.struct("*").alias("row"), blob_of(F.col(text)).alias("blob"))
    joined = join_groups(rows, groups, "blob", "n")
    return joined.select(*[F.col("row")[c].alias(c) for c in versions.columns if c != name], F.coalesce("findings", F.expr("array()").cast(EMPTY)).alias(name))


def spans_text(findings: Column, rules: Sequence[Rule] = RULES, only: int | None = None) -> Column:
    """``kind:start:end`` of the findings (of the first ``only`` rules), comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    kept = findings if only is None else F.filter(findings, lambda x: x["kind"] < only)
    return F.concat_ws(",", F.transform(kept, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))))


def redacted(text: Column, findings: Column, mask: str = "[secret]") -> Column:
    """``text`` with every stretch covered by findings replaced by ``mask``; overlapping spans make one stretch."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        gap = F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(fresh, F.concat(s["out"], gap, F.lit(mask))).otherwise(s["out"]).alias("out"))

    whole = F.aggregate(findings, state, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(findings) > 0, whole).otherwise(text)


def scan_table(df: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES, name: str = "findings", batches: int = BATCHES) -> DataFrame:
    """``df`` with column ``name`` appended (or replaced), by a ledger made for this call.

    The table goes into the ledger in ``batches`` loads, by ranges of ``key``; the
    later ones scan only blobs that the earlier ones haven't.
    """
    ledger = BlobLedger(df.sparkSession, f"blobs_{uuid.uuid4().hex}", rules)
    try:
        groups = ledger.groups([ledger.ingest(df.where(part), text) for part in key_ranges(df, key, batches)])
    finally:
        ledger.drop()
    return with_findings(df, groups, text, name)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (long), base_sha256, spans of every row of ``documents``.

    Null texts count as empty and have no spans; repeated rows each get their
    row; an empty table gives none. The findings come from a ledger made for
    this call, filled in ``BATCHES`` loads.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    slim = docs.select("doc_id", blob_of(F.col("text")).alias("blob"))
    ledger = BlobLedger(spark, f"blobs_{uuid.uuid4().hex}")
    try:
        groups = ledger.groups([ledger.ingest(docs.where(part)) for part in key_ranges(docs, "doc_id", BATCHES)])
    finally:
        ledger.drop()
    found = F.coalesce("findings", F.expr("array()").cast(EMPTY))
    count = lambda k: F.size(F.filter(found, lambda x: x["kind"] == k)).cast("long")
    return join_groups(slim, groups, "blob", "n").select(
        "doc_id",
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(RULES)],
        F.sha2(spans_text(found, only=len(RULES)).cast("binary"), 256).alias("base_sha256"),
        spans_text(found).alias("spans"),
    )


_KINDS = " UNION ALL ".join(
    f"SELECT doc_id, '{r.kind}' AS kind, {k} AS k, string_split_regex(t, $${p}$$) AS parts, regexp_extract_all(t, $${p}$$, 0) AS whole, regexp_extract_all(t, $${p}$$, {g}) AS grp, {r.least} AS least FROM d"
    for k, (r, p, g) in enumerate(
        (
            (RULES[0], r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1),
            (RULES[1], r"AKIA[A-Z0-9]+", 0),
            (RULES[2], r"[0-9a-f]+", 0),
        )
    )
)
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_KINDS}),
u AS (SELECT doc_id, kind, k, i, length(parts[i]) AS gap, length(whole[i]) AS n, length(grp[i]) >= least AS ok FROM m, unnest(range(1, len(whole) + 1)) AS r(i)),
s AS (SELECT *, sum(gap + n) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM u),
a AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(stop - n AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY stop - n, k) AS spans
  FROM s WHERE ok GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""
