"""Secret scan with an incremental blob ledger.

Every document version is a path to a blob, the SHA-256 of its whole text. The
ledger is a Parquet table in the shared folder: per scan of a blob the
rule versions that ran and the spans they found. A scan reads the ledger,
keeps the blobs that some current rule version has not seen, scans each of
them once with just those rules, appends the results, and joins the findings
back to all paths. Copies are dropped before the shuffle; a second scan of
unchanged documents scans nothing, and a raised rule version rescans for that
rule only.

Results: null counts as the empty text; spans are code points, end exclusive,
leftmost and not overlapping within a kind; a match that fails its test is
dropped without another try. Repeated rows are paths to one blob and get equal
findings; an empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .base import table

SPAN = "array<struct<kind:string,rule:string,start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    ignore_case: bool = False
    #: lower-case ASCII texts of which a match holds at least one; none: always searched
    hints: tuple[str, ...] = ()
    #: the group that must have ``least`` characters or more
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def finder(self) -> Callable:
        find = re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0)).finditer

        def spans(text: str, lower: str):
            if self.hints and not any(h in lower for h in self.hints):
                return []
            return [(self.kind, self.name, m.start(), m.end()) for m in find(text) if len(m[self.group]) >= self.least]

        return spans


# The first three are the stated ones; access and hex carry their
# least length in the pattern, as a run that is too short holds no match at all.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         True, ("passw", "secret", "token", "api"), 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", hints=("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hints=("private key-----",)),
    Rule("git_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hints=("eyj",)),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("url_password", 2, r"://[^\s:/@]++:[^\s:/@]++@", hints=("://",)),
)


def scan_column(rules=RULES):
    """Column function (text, names of the rules to run) -> spans."""
    @F.pandas_udf(SPAN)
    def scan(text: pd.Series, todo: pd.Series) -> pd.Series:
        finders = {r.name: r.finder() for r in rules}
        out = []
        for t, names in zip(text, todo):
            lower = t.lower()
            out.append([dict(zip(("kind", "rule", "start", "end"), s)) for n in names for s in finders[n](t, lower)])
        return pd.Series(out, dtype=object)

    return scan


def read_ledger(spark, path: str) -> DataFrame | None:
    """The ledger so far; None if nothing has been scanned into it."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def update_ledger(docs: DataFrame, ledger: str, rules=RULES, scan=None) -> None:
    """Scan what the ledger lacks of these documents' texts and append it."""
    spark = docs.sparkSession
    names = F.array(*[F.lit(r.name) for r in rules])
    blobs = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(F.unhex(F.sha2("text", 256)).alias("blob"), "text")
    seen = read_ledger(spark, ledger)
    if seen is None:
        todo = blobs.withColumn("todo", names)
    else:
        known = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
        todo = (blobs.join(known, "blob", "left")
                .withColumn("todo", F.array_except(names, F.coalesce("done", F.array().cast("array<string>"))))
                .where(F.size("todo") > 0).drop("done"))
    fresh = todo.dropDuplicates(["blob"])
    (fresh.select("blob", F.col("todo").alias("rules"), (scan or scan_column(rules))("text", "todo").alias("found"))
     .write.mode("append").parquet(ledger))


def findings(docs: DataFrame, ledger: str, rules=RULES) -> DataFrame:
    """doc_id and the sorted spans of every document, after bringing the ledger up to date."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    paths = materialize(docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob")), "paths")
    update_ledger(docs, ledger, rules)
    current = F.array(*[F.lit(r.name) for r in rules])
    found = (docs.sparkSession.read.parquet(ledger).where(F.size("found") > 0)
             .select("blob", F.filter("found", lambda s: F.array_contains(current, s["rule"])).alias("found"))
             .groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found")))
    ranked = F.transform("found", lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["kind"]).alias("at"),
                                                     s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.coalesce(F.array_sort(ranked), F.array().cast("array<struct<start:bigint,at:int,end:bigint,kind:string>>"))
    return paths.join(found, "blob", "left").select("doc_id", F.hex("blob").alias("blob"), spans.alias("spans"))


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secret_scan(spark, sf_dir):
    # a ledger of its own for this run; a service would keep one path
    rows = findings(table(spark, sf_dir, "documents"), scratch_path(spark, "ledger"))
    base = ("assign", "access", "hex")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *[count(k) for k in base],
                       F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
                       joined(F.col("spans")).alias("spans"))
