"""Mixing documents to target domain weights by soft membership, in DataFrame expressions only.

A naive Bayes classifier over hashed words is counted on labelled rows, `labelled` at most, picked by a hash of their
ids. Every document gets posteriors over the domains `toxic`, `low` and `good`. Nonnegative rates x are then fitted so
that expected domain token totals sum(tokens * posterior * x) match the targets: each step of projected gradient descent
needs only the three totals of the current rates and their second moments, which Spark sums; rates are a function of
posteriors and the steps so far, so nothing per document leaves the executors. What is left between the shares reached
and the targets is returned as `gap`: it stays above CLOSE where no nonnegative rates, or none within STEPS, meet them.

Edge cases: null and empty texts have no tokens, the prior as posterior, and rate like others of that posterior; labels
of unknown or null ids, or with null flags, are not learned from; of several labels of a document one is used (the most
severe); without labels or tokens every rate is 1; repeated rows each have their row; further columns of any name are
ignored by mixed_rates and kept by mix; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

DOMAINS = ("good", "low", "toxic")
#: The share of all tokens that each domain is to have.
TARGETS = {"good": 0.7, "low": 0.25, "toxic": 0.05}
BUCKETS, STEPS, CLOSE = 2048, 40, 1e-4
#: Labelled rows that the classifier learns from, at most: their ids and domains are broadcast.
LABELLED = 20_000
#: Words of evidence: the log odds of a longer text are scaled down to so many words, which keeps membership soft.
EVIDENCE = 40.0


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[list[float], list[list[float]]] | None:
    """Log priors and, for each domain, log probabilities of the buckets: a table of BUCKETS times three counts."""
    flags = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and quality is not null and toxic is not null")
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    draw = F.xxhash64("id")
    # one row of each place at most, so that what is broadcast is bounded and texts stay where they are
    known = flags.groupBy(F.pmod(draw, F.lit(labelled)).alias("place")).agg(F.min(F.struct(draw.alias("h"), "id", (-domain).alias("domain"))).alias("x")).select("x.id", (-F.col("x.domain")).alias("domain"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "id")
    counted = rows.select("domain", F.explode(F.concat(F.array(F.lit(-1)), F.transform(word_list(F.col("text")), bucket))).alias("bucket")).groupBy("domain", "bucket").count().collect()
    if not counted:
        return None
    table, prior = np.ones((3, BUCKETS)), np.ones(3)
    for r in counted:
        if r["bucket"] < 0:
            prior[r["domain"]] += r["count"]
        else:
            table[r["domain"], r["bucket"]] += r["count"]
    return np.log(prior / prior.sum()).tolist(), np.log(table / table.sum(axis=1, keepdims=True)).tolist()


def posteriors(rows: DataFrame, text: Column, model) -> DataFrame:
    """The columns of rows (none of whose names begins with `_`), n_tokens and p, the posteriors in the order of DOMAINS."""
    listed = rows.withColumn("_words", F.transform(word_list(text), bucket)).withColumn("n_tokens", F.size("_words").cast("long"))
    if model is None:
        return listed.drop("_words").withColumn("p", F.array(*[F.lit(1 / 3)] * 3))
    prior, table = model
    weight = F.lit(1.0) / F.greatest(F.lit(1.0), F.col("n_tokens") / EVIDENCE)
    # literal arrays: constants of a fixed size in the plan
    literals = [F.expr("array(" + ",".join(f"{x!r}D" for x in row) + ")") for row in table]
    sums = F.aggregate("_words", F.array(*[F.lit(0.0)] * 3), lambda s, b: F.array(*(F.get(s, F.lit(k)) + F.get(literals[k], b) for k in range(3))))
    out = listed.withColumn("_sum", sums).drop("_words")
    out = out.withColumn("_log", F.array(*(F.lit(prior[k]) + F.get("_sum", F.lit(k)) * weight for k in range(3)))).drop("_sum")
    out = out.withColumn("_e", F.transform("_log", lambda x: F.exp(x - F.array_max("_log")))).drop("_log")
    total = F.aggregate("_e", F.lit(0.0), lambda s, x: s + x)
    return out.withColumn("p", F.transform("_e", lambda x: x / total)).drop("_e")


def rate(steps: list[list[float]]) -> Column:
    """The rate after the steps: from 1, move along the posteriors and project onto nonnegative rates, each time."""
    if not steps:
        return F.lit(1.0)
    taken = F.expr("array(" + ",".join("array(" + ",".join(f"{x!r}D" for x in s) + ")" for s in steps) + ")")
    return F.aggregate(taken, F.lit(1.0), lambda x, s: F.greatest(F.lit(0.0), x - sum((F.get(s, F.lit(k)) * F.get("p", F.lit(k)) for k in range(3)), F.lit(0.0))))


def fit(members: DataFrame, targets: dict[str, float]) -> tuple[list[list[float]], float | None]:
    """Steps of projected gradient descent, scaled by the second moments of the documents that still have a rate, and the
    sum of what their shares miss the targets by (None without tokens)."""
    want = np.array([targets[d] for d in DOMAINS]) / sum(targets.values())
    p = [F.get("p", F.lit(k)) for k in range(3)]
    steps: list[list[float]] = []
    best, chosen = math.inf, 0
    for _ in range(STEPS):
        x = members.withColumn("x", rate(steps))
        live = F.when(F.col("x") > 0, F.col("n_tokens")).otherwise(0)
        sums = [F.sum(F.col("n_tokens") * F.col("x") * p[k]) for k in range(3)]
        squares = [F.sum(live * p[i] * p[j]) for i in range(3) for j in range(3)]
        got = x.agg(F.sum("n_tokens"), *sums, *squares).first()
        if not got[0]:
            return [], None
        gap = np.array(got[1:4], float) / got[0] - want
        if (error := float(np.abs(gap).sum())) < best:
            best, chosen = error, len(steps)
        if error < CLOSE:
            break
        moments = np.array(got[4:], float).reshape(3, 3) / got[0]
        steps.append(np.linalg.solve(moments + 1e-4 * np.eye(3), gap).tolist())
    return steps[:chosen], best


def mixed_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, n_tokens, p_good, p_low, p_toxic and rate for each row, and the gap of the whole."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    members = written(posteriors(rows, F.col("text"), learn(docs, labels)).select("doc_id", "n_tokens", "p"), "members")
    steps, gap = fit(members, targets)
    return members.select("doc_id", "n_tokens", *(F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(DOMAINS)), rate(steps).alias("rate"), F.lit(gap).cast("double").alias("gap"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of docs, all columns, each as often as its rate says: whole copies, and one more with the probability of
    the rest, drawn from a hash of id and text. Posteriors are computed again for it, so that no text is written."""
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    members = posteriors(rows, F.col("row.text").cast("string"), learn(docs, labels))
    small = written(members.select("n_tokens", "p"), "members")
    steps, _ = fit(small, targets)
    forget(small)
    draw = F.pmod(F.xxhash64("row.doc_id", "row.text", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(rate(steps) + draw).cast("int")
    # outer, as the filter that Spark infers for an inner explode would repeat the posteriors' expression for every use
    return members.select("row", F.explode_outer(F.array_repeat(F.lit(1), copies)).alias("copy")).where("copy is not null").select("row.*")
