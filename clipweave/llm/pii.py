"""Personal data: base patterns, and secrets by weak supervision. Only DataFrame functions.

Candidates for secrets are long runs of letters and digits. Four labelers vote on each: its shape
(regex), known prefixes and names in front of it (gazetteers), and the punctuation around it
(context). EM over the counts of vote patterns gives posteriors; these train a naive Bayes
classifier on the span's shape, length and hashed neighbourhood, and what it accepts is added.

Patterns match possessively and never start inside a run they have just refused, so that their
time is linear in the text and no long match exhausts the stack; both leave the matches as they are.

Defined cases: a null or empty text has no spans; rows are told apart by doc_id and text, so equal
rows get equal results, also with a null doc_id; extra input columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clipweave.llm import weaklabels
from clipweave.llm.common import written

#: base kinds in the order of the result contract, with their patterns; fixed values
KINDS = ["email", "ip", "card", "phone"]
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+(?![A-Za-z0-9_-])",
}
#: what a text must hold before a pattern is tried
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: words in front of a secret, and prefixes of well-known keys
NAMES = "token|password|passwd|pwd|secret|key|apikey|api_key|access|auth|bearer|credential"
PREFIXES = "AKIA|ASIA|ghp_|gho_|sk_|pk_|xox|glpat"
LABELERS = ["shape", "prefix", "name", "quoted"]
#: hash buckets of the classifier's features
BUCKETS = 4096
#: code points of text kept on either side of a candidate
AROUND = 16


def _found(text: Column, kind: str) -> Column:
    """(kind, number, code points between this match and the one before, match, text around) of all matches."""
    def cut(both: Column) -> Column:
        return F.transform(
            both["hits"],
            lambda hit, i: F.struct(
                F.lit(kind).alias("kind"), i.alias("i"), F.length(both["gaps"][i]).alias("gap"), hit.alias("hit"),
                F.right(both["gaps"][i], F.lit(AROUND)).alias("left"), F.left(both["gaps"][i + 1], F.lit(2)).alias("right"),
            ),
        )

    pattern = F.lit(PATTERNS[kind])
    both = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"), F.split(text, PATTERNS[kind], -1).alias("gaps"))
    able = text.contains(NEEDS[kind]) if kind in NEEDS else F.lit(True)
    return F.when(able & text.rlike(PATTERNS[kind]), F.transform(F.array(both), cut)[0])


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a run of digits has a right check digit."""
    def worth(i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = 2 * d
        return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda s, i: s + worth(i))
    return total % 10 == 0


def valid(kind: Column, hit: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
    size = F.length(digits(hit))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", hit.rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when((kind == "card") & size.between(12, 19), luhn(digits(hit)))
        .when(kind == "phone", size.between(9, 15))
        .when(kind == "secret", hit.rlike("[0-9]") & hit.rlike("[A-Za-z]"))
        .otherwise(False)
    )


def matches(docs: DataFrame) -> DataFrame:
    """doc, body, kind, start, end, hit and the text around every valid match of all five patterns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("body"), text.alias("text"))
    some = held.filter(text.rlike("[0-9@]"))
    found = [F.coalesce(_found(F.col("text"), k), F.array().cast("array<struct<kind:string,i:int,gap:int,hit:string,left:string,right:string>>")) for k in PATTERNS]
    flat = some.select("doc", "body", F.explode(F.concat(*found)).alias("m")).select("doc", "body", "m.*").distinct()
    flat = flat.repartition("doc", "body")
    so_far = W.partitionBy("doc", "body", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    placed = flat.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(so_far))
    placed = placed.withColumn("start", F.col("end") - F.length("hit"))
    return placed.filter(valid(F.col("kind"), F.col("hit"))).select("doc", "body", "kind", "start", "end", "hit", "left", "right")


def vote_columns() -> list[Column]:
    hit, left, right = F.col("hit"), F.col("left"), F.col("right")
    mixed = F.length(digits(hit)) / F.length(hit)
    hexes = hit.rlike("^[0-9a-f]{16,}$|^[0-9A-F]{16,}$|^[A-Z0-9]{18,}$")
    return [
        F.when(hexes & mixed.between(0.1, 0.9), 1).when((mixed < 0.05) | (mixed > 0.95), -1).otherwise(0),
        F.when(hit.rlike(f"^(?:{PREFIXES})"), 1).otherwise(0),
        F.when(left.rlike(f"(?i)(?:{NAMES})[\"']?\\s*[:=]?\\s*[\"']?$"), 1).when(left.rlike("[/.]$"), -1).otherwise(0),
        F.when(left.rlike("[=:]\\s*[\"']?$") | (left.rlike("[\"']$") & right.rlike("^[\"']")), 1).otherwise(0),
    ]


def span_features() -> Column:
    hit = F.col("hit")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(hit, "[a-f]+", "h"), "[g-z]+", "l"), "[0-9]+", "0")
    parts = [
        F.concat(F.lit("shape "), F.left(shape, F.lit(4))),
        F.concat(F.lit("length "), F.floor(F.length(hit) / 4).cast("string")),
        F.concat(F.lit("head "), F.left(hit, F.lit(4))),
        F.concat(F.lit("before "), F.lower(F.right("left", F.lit(3)))),
        F.concat(F.lit("after "), F.left("right", F.lit(1))),
        F.concat(F.lit("digits "), F.floor(10 * F.length(digits(hit)) / F.length(hit)).cast("string")),
    ]
    return F.array(*[F.pmod(F.xxhash64(p), F.lit(BUCKETS)).cast("int") for p in parts])


def added_spans(candidates: DataFrame) -> DataFrame:
    """Spans that the trained classifier accepts: doc, body, start, end.

    The votes are combined over all candidates; the classifier's table has at most ``BUCKETS`` rows.
    """
    votes = vote_columns()
    voted = written(candidates.withColumn("pattern", weaklabels.pattern(votes)).withColumn("features", span_features()).drop("hit", "left", "right"), "pii-votes")
    _, share, post = weaklabels.estimate(weaklabels.count_patterns(voted, "pattern"), len(LABELERS))
    rows = weaklabels.posterior(voted, "pattern", post, "good").withColumn("feature", F.explode(F.array_distinct("features")))
    seen = rows.groupBy("feature").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    whole = voted.groupBy("pattern").count().collect()
    good = sum(post.get(r["pattern"], 0.0) * r["count"] for r in whole)
    bad = sum(r["count"] for r in whole) - good
    odds = F.log((F.col("good") + 0.5) / (F.lit(good) + 1)) - F.log((F.col("bad") + 0.5) / (F.lit(bad) + 1))
    table = written(seen.select("feature", odds.alias("odds")), "pii-odds")
    prior = F.log(F.lit((good + 1) / (bad + 1)))
    scored = voted.select("doc", "body", "start", "end", F.explode(F.array_distinct("features")).alias("feature")).join(F.broadcast(table), "feature")
    return scored.groupBy("doc", "body", "start", "end").agg(F.sum("odds").alias("sum")).filter(F.col("sum") + prior > 0).select("doc", "body", "start", "end")


def _listed(rows: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(rows), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc, counts of the base kinds, base spans and all spans as kind:start:end lists."""
    placed = written(matches(docs), "pii-matches")
    base = placed.filter(F.col("kind") != "secret").select("doc", "body", "kind", "start", "end")
    added = added_spans(placed.filter(F.col("kind") == "secret")).select("doc", "body", F.lit("secret").alias("kind"), "start", "end")
    order = F.array_position(F.array(*map(F.lit, [*KINDS, "secret"])), F.col("kind"))
    row = F.struct("start", order.alias("n"), "end", "kind")
    per = base.unionByName(added).groupBy("doc", "body").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS],
        _listed(F.collect_list(F.when(F.col("kind") != "secret", row))).alias("base"),
        _listed(F.collect_list(row)).alias("spans"),
    )
    per = per.withColumnRenamed("doc", "d").withColumnRenamed("body", "b")
    held = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("body"))
    out = held.join(per, F.col("doc").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b")), "left")
    zero, none = F.lit(0).cast("long"), F.lit("")
    return out.select("doc", *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS], F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))
