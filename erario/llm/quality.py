"""Quality: a document classifier combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erario.llm.toxicity import held_out
from erario.sources.writers import written

#: Rows of good and of bad documents that every bucket of a feature has in advance.
PRIOR_ROWS = 2.0
#: The features speak of the same thing in part, so their sum is weighed down.
DAMPING = 0.7
#: Strength of the shrinkage, as a number of documents, at least and at most.
WEAKEST, STRONGEST = 5.0, 5000.0


def features(text: Column) -> list[Column]:
    """Each feature of a text as the number of a bucket; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, size = F.size(words), F.greatest(F.length(text), F.lit(1))

    def share(count: Column, total: Column, steps: int) -> Column:
        return F.floor(count * steps / F.greatest(total, F.lit(1))).cast("int")

    def fine(count: Column, total: Column) -> Column:
        return F.floor(F.log2(1 + 1000 * count / F.greatest(total, F.lit(1)))).cast("int")

    def matches(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    return [
        F.floor(2 * F.log2(1 + n)).cast("int"),
        share(F.size(F.array_distinct(words)), n, 20) * 16 + F.least(F.floor(F.log2(1 + n)), F.lit(15)).cast("int"),
        fine(matches(r"[^\p{L}\p{N}\s.,;:'\"!?()-]"), size),
        fine(matches(r"[.!?](?=\s|$)"), n),
        fine(matches(r"\p{N}"), size),
        fine(matches(r"\p{Lu}"), size),
        F.floor(4 * F.log2(1 + size / F.greatest(n, F.lit(1)))).cast("int"),
        fine(matches(r"(?<=^|\s)(\S+)\s+\1(?=\s|$)"), n),
        F.floor(F.log2(1 + n / matches(r"\n|$"))).cast("int"),
    ]


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _shrunk(total: Column, n: Column, prior: Column, strength: Column) -> Column:
    return (total + strength * prior) / (n + strength)


def score_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """``doc_id, held_out, evidence, host_posterior, path_posterior, score, predicted`` of every document.

    ``evidence`` is the log ratio that the text's features give (naive Bayes over buckets,
    learned from labels of rows that are not held out).  Every document, by its label where
    that may be used, else by its evidence, counts for its host and its path.  A host's rate
    is shrunk toward the corpus, a path's toward its host, by a strength estimated from the
    spread of the rates; a document's own share is left out of its host and path.  The score
    joins the path's posterior and the evidence.

    A null text is empty; a null host or path part is a host of its own.  Repeated labels of
    a document count once, the better one; other columns are not read; without labels the
    corpus rate is one half and evidence zero.  Hot hosts are summed before they travel.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & F.col("label_id").isNotNull())
    known = known.filter(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("quality").alias("quality"))
    part = lambda c: F.col(c).cast("string")
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), part(host).alias("host"), F.to_json(F.array(*map(part, path))).alias("path"), F.array(*features(F.col("text").cast("string"))).alias("buckets"),
    )
    own = written(own.join(known, F.col("doc_id") == F.col("label_id"), "left").drop("label_id"), "features")

    buckets = own.filter("quality IS NOT NULL").select("quality", F.posexplode("buckets").alias("feature", "bucket"))
    counts = buckets.groupBy("feature", "bucket").agg(F.sum("quality").alias("good"), F.count("*").alias("n")).collect()  # features times buckets of logarithms and shares: some hundred rows, whatever the texts
    good, bad = (sum(f(r) for r in counts if r.feature == 0) for f in (lambda r: r.good, lambda r: r.n - r.good))
    rate = (good + 1) / (good + bad + 2)
    weights: dict[int, dict[int, float]] = {}
    for r in counts:
        given_good = (r.good + PRIOR_ROWS * rate) / (good + PRIOR_ROWS)
        given_bad = (r.n - r.good + PRIOR_ROWS * (1 - rate)) / (bad + PRIOR_ROWS)
        weights.setdefault(r.feature, {})[r.bucket] = math.log(given_good / given_bad)
    evidence = F.lit(0.0)
    for feature, by_bucket in sorted(weights.items()):
        table = F.create_map(*[F.lit(x) for pair in sorted(by_bucket.items()) for x in pair])
        evidence = evidence + F.coalesce(F.try_element_at(table, F.col("buckets")[feature]), F.lit(0.0))
    prior = F.lit(rate)
    judged = own.withColumn("evidence", DAMPING * evidence).withColumn("chance", 1 / (1 + F.exp(-(F.col("evidence") + _logit(prior)))))
    judged = written(judged.withColumn("share", F.coalesce(F.col("quality").cast("double"), F.col("chance"))).drop("buckets", "quality"), "judged")

    def rates(level: DataFrame) -> tuple[DataFrame, float]:
        """Sums of a level, and its strength: how many documents weigh as much as the level above."""
        spread = level.filter("n > 1").select((F.col("total") / F.col("n")).alias("r"), "n").agg(F.var_pop("r").alias("between"), F.avg(F.lit(rate * (1 - rate)) / F.col("n")).alias("within"), F.count("*").alias("k")).first()
        excess = (spread.between or 0.0) - (spread.within or 0.0)
        strength = rate * (1 - rate) / excess - 1 if excess > 0 else STRONGEST
        return level, min(STRONGEST, max(WEAKEST, strength))

    hosts, host_strength = rates(written(judged.groupBy("host").agg(F.sum("share").alias("total"), F.count("*").alias("n")), "hosts"))
    paths, path_strength = rates(written(judged.groupBy("host", "path").agg(F.sum("share").alias("total"), F.count("*").alias("n")), "paths"))
    hosts = hosts.select(F.col("host").alias("h"), F.col("total").alias("h_total"), F.col("n").alias("h_n"))
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).select(F.col("host").alias("h"), F.col("path").alias("p"), "h_total", "h_n", F.col("total").alias("p_total"), F.col("n").alias("p_n"))
    found = judged.join(sites, F.col("path").eqNullSafe(F.col("p")) & F.col("host").eqNullSafe(F.col("h")))
    host_rate = _shrunk(F.col("h_total") - F.col("share"), F.col("h_n") - 1, prior, F.lit(host_strength))
    found = found.withColumn("host_posterior", host_rate)
    found = found.withColumn("path_posterior", _shrunk(F.col("p_total") - F.col("share"), F.col("p_n") - 1, F.col("host_posterior"), F.lit(path_strength)))
    score = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_posterior")))))
    found = found.withColumn("score", score)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
