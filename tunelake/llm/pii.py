"""Personal data by weak supervision (DataFrame functions only).

1. Candidates. Base spans: leftmost matches of the stated patterns that pass
   their tests. Further candidates that the base patterns miss: written-out
   addresses (``name (at) host (dot) org``), national phone numbers without a
   country code, and IPv6 addresses.
2. Labelers vote on each candidate (1 for, -1 against, 0 abstains): the regex
   with its test, a gazetteer of known forms, and the words before the span.
3. Expectation-maximisation estimates, per kind, how often each labeler votes
   so on true and on false spans (Dawid-Skene), from the counts of the vote
   patterns of all documents. There are at most 27 patterns a kind, so the
   table that reaches the driver has a fixed size.
4. A span classifier (naive Bayes over categorical features of the span, not
   its votes alone) is trained on the posterior weights of all candidates,
   again from a table of fixed size.
5. Base spans stay. A further candidate is added if the classifier and the
   posterior both exceed ACCEPT and no base span of its kind overlaps it.

The patterns start only where a run of their characters starts (or where the
last match ended), which gives the same matches as the plain patterns without
their quadratic search; texts without the mark of a kind (@, a digit, +) skip
it. Repeated groups are possessive or of bounded count: Java matches those in a
loop, others by recursion, whose stack would grow with the text.

Results: null counts as the empty text; positions are code points, end
exclusive; a match that fails its test is dropped without another try.
Repeated rows get equal spans and count as often in the estimates; an empty
table gives an empty result; further columns are ignored."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .base import table

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9
ROUNDS = 30

_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a run of digits with single separators is matched whole, so only runs of 12 digits or more matter
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
FURTHER = {
    "email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,64}(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,64}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+.-])(?<![0-9]\x20)\([0-9]{3}\)\x20?[0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
}
#: A text without this mark holds no span of the kind.
MARKS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

# Fixed values of the gazetteer and context labelers.
KNOWN = {
    "email": r"(?i)(?:\.|dot[\])]\x20?)(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk|at|ch|it|nl)$",
    "ip": r"^(?!0\.|127\.|255\.)[0-9a-fA-F.:]+$",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^(?:\+(?:1|33|34|44|49|43|41|39|31)[^0-9]|\()",
}
UNKNOWN = {
    "email": r"(?i)(?:\.|dot[\])]\x20?)(?:png|jpg|gif|js|css|txt|local|invalid)$",
    "ip": r"^(?:0|127|255)\.",
    "card": r"^(?:([0-9])\1{11,}|0)",
    "phone": r"^\+0",
}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|kontakt|courriel|correo|write)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse|login|from)\b",
    "card": r"(?i)\b(?:card|karte|carte|tarjeta|visa|payment|credit)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|telefon|call|mobile|fax)\b",
}
AGAINST = r"(?i)\b(?:version|v|isbn|section|order|invoice|serial|page|chapter|build)\.?\s*$"

SPAN = "array<struct<start:int,end:int,s:string,before:string>>"


def spans(text: Column, pattern: str) -> Column:
    """All matches with positions: the pieces between them give the distances."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    paired = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda s, gap: F.struct(
        s.alias("s"), F.length(gap).alias("gap"), F.substring(gap, -24, 24).alias("before")))
    return F.aggregate(
        paired, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.length(x["s"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.length(x["s"])).alias("end"),
                x["s"].alias("s"), x["before"].alias("before")))).alias("out")),
        lambda acc: acc["out"])


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    each = F.split(F.reverse(number), "")
    total = F.aggregate(
        F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))),
        F.lit(0), lambda a, d: a + d)
    return total % 10 == 0


def passes(kind: str, s: Column) -> Column:
    if kind == "ip":
        octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return s.rlike(rf"^{octet}(?:\.{octet}){{3}}$")
    n = F.length(digits(s))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits(s))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _candidates(kind: str, text: Column) -> Column:
    """The kind's spans as array<struct<kind, start, end, base, s, before>>."""
    def tagged(found, base):
        return F.transform(found, lambda x: F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(base).alias("base"),
            x["s"].alias("s"), x["before"].alias("before")))

    # a cheap test first, so that most texts skip the search
    mark = F.contains(text, F.lit(MARKS[kind])) if MARKS[kind] else text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean,s:string,before:string>>")
    base = F.when(mark, F.filter(tagged(spans(text, BASE[kind]), True), lambda x: passes(kind, x["s"]))).otherwise(empty)
    if kind not in FURTHER:
        return base
    other = {"email": r"(?:\(|\[)at(?:\)|\])", "ip": ":", "phone": "("}[kind]
    there = text.rlike(other) if kind == "email" else F.contains(text, F.lit(other))
    return F.concat(base, F.when(there, tagged(spans(text, FURTHER[kind]), False)).otherwise(empty))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and all candidates of its whole text, with votes; candidates under a base span of their kind left out."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = rows.select("doc_id", F.concat(*[_candidates(k, F.col("text")) for k in KINDS]).alias("c"))
    clear = F.when(F.exists("c", lambda x: ~x["base"]), F.filter("c", lambda x: x["base"] | ~F.exists("c", lambda y: (
        y["base"] & (y["kind"] == x["kind"]) & (y["start"] < x["end"]) & (x["start"] < y["end"]))))).otherwise(F.col("c"))
    return found.select("doc_id", F.transform(clear, _voted).alias("c"))


def _pick(kind: Column, patterns: dict, s: Column) -> Column:
    out = F.lit(False)
    for k, pattern in patterns.items():
        out = F.when(kind == k, s.rlike(pattern)).otherwise(out)
    return out


def _voted(x: Column) -> Column:
    """A candidate with its votes and the features of the classifier."""
    kind, s, before = x["kind"], x["s"], x["before"]
    plain = F.when(kind == "card", digits(s)).otherwise(s)
    gazetteer = F.when(_pick(kind, UNKNOWN, plain), -1).when(_pick(kind, KNOWN, plain), 1).otherwise(0)
    context = F.when(before.rlike(AGAINST), -1).when(_pick(kind, CONTEXT, before), 1).otherwise(0)
    regex = F.when(x["base"], 1).otherwise(0)
    return F.struct(
        kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"),
        F.concat_ws(",", regex.cast("string"), gazetteer.cast("string"), context.cast("string")).alias("votes"),
        F.array(
            F.concat(F.lit("length "), F.least(F.floor(F.length(s) / 4), F.lit(8)).cast("string")),
            F.concat(F.lit("gazetteer "), gazetteer.cast("string")),
            F.concat(F.lit("context "), context.cast("string")),
            F.concat(F.lit("separators "), F.least(F.length(F.regexp_replace(s, "[A-Za-z0-9]", "")), F.lit(6)).cast("string")),
            F.concat(F.lit("left "), F.when(before.rlike(r"[\s(,;:]$"), "open").when(before == "", "edge").otherwise("tight")),
        ).alias("features"))


def estimate(patterns: list[tuple[str, str, int]], rounds: int = ROUNDS) -> dict[tuple[str, str], float]:
    """Posterior that a span is personal data, per (kind, votes), by EM over (kind, votes, count)."""
    out = {}
    for kind in {p[0] for p in patterns}:
        own = [(tuple(map(int, v.split(","))), n) for k, v, n in patterns if k == kind]
        width = len(own[0][0])
        # begin from the majority of the votes
        post = {v: min(0.95, max(0.05, 0.5 + 0.3 * sum(v))) for v, _ in own}
        for _ in range(rounds):
            yes = sum(n * post[v] for v, n in own) + 1
            no = sum(n * (1 - post[v]) for v, n in own) + 1
            rate = [{x: ((sum(n * post[v] for v, n in own if v[j] == x) + 1) / (yes + 2),
                         (sum(n * (1 - post[v]) for v, n in own if v[j] == x) + 1) / (no + 2)) for x in (-1, 0, 1)}
                    for j in range(width)]
            for v, _ in own:
                odds = math.log(yes / no) + sum(math.log(rate[j][v[j]][0] / rate[j][v[j]][1]) for j in range(width))
                post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        out.update({(kind, ",".join(map(str, v))): p for v, p in post.items()})
    return out


def _lookup(values: dict[str, float], key: Column, default: float) -> Column:
    if not values:
        return F.lit(default)
    made = F.create_map(*[F.lit(x) for k, v in sorted(values.items()) for x in (k, float(v))])
    return F.coalesce(F.try_element_at(made, key), F.lit(default))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and its final spans, array<struct<start, at, end, kind, base>>, sorted."""
    rows = materialize(candidates(docs), "pii-candidates")
    each = rows.select(F.explode("c").alias("c"))
    # at most 27 vote patterns and a few dozen features a kind
    patterns = [(r[0], r[1], r[2]) for r in each.groupBy("c.kind", "c.votes").count().collect()]
    posterior = {f"{k} {v}": p for (k, v), p in estimate(patterns).items()}
    p = _lookup(posterior, F.concat_ws(" ", "c.kind", "c.votes"), 0.0)
    weights = (each.select("c.kind", p.alias("p"), F.explode("c.features").alias("f"))
               .groupBy("kind", "f").agg(F.sum("p"), F.sum(1 - F.col("p"))).collect())
    prior = {k: [1.0, 1.0] for k in KINDS}
    for k, v, n in patterns:
        q = posterior[f"{k} {v}"]
        prior[k][0] += n * q
        prior[k][1] += n * (1 - q)
    odds = {f"{k} {f}": math.log((a + 1) / (prior[k][0] + 9)) - math.log((b + 1) / (prior[k][1] + 9)) for k, f, a, b in weights}
    base_odds = {k: math.log(a / b) for k, (a, b) in prior.items()}

    def accepted(x: Column) -> Column:
        score = F.aggregate(x["features"], _lookup(base_odds, x["kind"], 0.0),
                            lambda s, f: s + _lookup(odds, F.concat_ws(" ", x["kind"], f), 0.0))
        sure = _lookup(posterior, F.concat_ws(" ", x["kind"], x["votes"]), 0.0)
        return x["base"] | ((score > math.log(ACCEPT / (1 - ACCEPT))) & (sure > ACCEPT))

    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    kept = F.transform(F.filter("c", accepted), lambda x: F.struct(
        x["start"].alias("start"), F.element_at(place, x["kind"]).alias("at"), x["end"].alias("end"),
        x["kind"].alias("kind"), x["base"].alias("base")))
    return rows.select("doc_id", F.array_sort(kept).alias("spans"))


def joined(found) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_personal_data(spark, sf_dir):
    rows = detect(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"),
                       joined(F.col("spans")).alias("spans"))
