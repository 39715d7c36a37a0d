"""A mixture of documents whose sources have target shares of the tokens, by soft membership.

1. A classifier, fitted to labelled documents (their source is the label; at most ``SAMPLE`` of them, taken by hash),
   gives every document its posterior over the sources, its domains. The source a document is listed under is evidence
   as well: it is taken to be right but for ``LABEL_NOISE``, and enters by Bayes' rule. (Posteriors of the text alone match
   expected totals, but text tells these sources apart too weakly: a source with a target of 0.20 got 0.10 of the tokens.)
2. Every document gets a rate, the expected number of times it is used, from 0 to its source's ``max_repeats``. Projected
   gradient descent fits the rates by least squares, so that the expected tokens of each domain under the posteriors are
   its target. The gradient of a rate is the document's posterior times the short vector of residuals, scaled by the
   inverse Gram matrix of the documents that aren't held at a bound; a step is one aggregation of the documents in the JVM,
   and only a few numbers for each domain reach the driver. It ends on the optimality condition: residuals of all
   reachable domains within ``TOLERANCE`` of the total.
3. Rates become whole uses by error diffusion within strata of a source: the largest document first, each takes the
   number of uses next to its rate that leaves the least tokens owed, which goes over to the next one.

A domain whose documents can't reach its target at their caps has what they can give as its target.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.session import written

#: Labelled documents the classifier is fitted to, at most.
SAMPLE = 20_000
FEATURES = 4096
#: Share of documents taken to be listed under another source than their own.
LABEL_NOISE = 0.001
#: Residual, as a share of the total, at which the fit has converged; and steps after which it is reported as not converged.
TOLERANCE = 1e-3
STEPS = 20
#: Documents in a stratum of the rounding, about.
STRATUM = 50_000


def _features(docs: DataFrame) -> DataFrame:
    """Letters in runs, and single characters of scripts without blanks, hashed."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "([\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}])", " $1 "), "[^\\p{L}\\p{M}]+"), lambda w: w != "")
    return HashingTF(inputCol="_words", outputCol="_features", numFeatures=FEATURES, binary=True).transform(docs.withColumn("_words", words)).drop("_words")


def posteriors(docs: DataFrame, sources: list[str], sample: int = SAMPLE) -> DataFrame:
    """docs with a column ``posterior``: the probability of each of sources, in their order, by the text and the source listed."""
    at = F.element_at(F.create_map(*[x for k, s in enumerate(sources) for x in (F.lit(s), F.lit(float(k)))]), F.col("source"))
    ready = _features(docs.withColumn("_label", at))
    n = docs.count()
    share = min(1.0, sample / max(n, 1))
    fit = written(ready.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))).select("_label", "_features"), "labelled")
    if fit.select("_label").distinct().count() < 2:  # nothing to tell apart
        one_hot = F.array(*[F.when(F.col("source") == s, 1.0).otherwise(0.0) for s in sources])
        return docs.withColumn("posterior", one_hot)
    model = LogisticRegression(featuresCol="_features", labelCol="_label", probabilityCol="_p", family="multinomial", regParam=0.01, maxIter=20).fit(fit)
    p = vector_to_array("_p")
    known = model.numClasses
    full = F.array(*[p[k] if k < known else F.lit(0.0) for k in range(len(sources))])
    read = model.transform(ready).withColumn("posterior", full)
    other = LABEL_NOISE / max(1, len(sources) - 1)
    joint = F.transform("posterior", lambda v, k: F.greatest(v, F.lit(1e-6)) * F.when(k == F.col("_label"), 1.0 - LABEL_NOISE).otherwise(other))
    whole = F.aggregate("_joint", F.lit(0.0), lambda a, v: a + v)
    read = read.withColumn("_joint", joint).withColumn("posterior", F.transform("_joint", lambda v: v / whole))
    return read.drop("_label", "_features", "_p", "_joint", "rawPrediction", "prediction")


def _rate(start: Column, moves: list[np.ndarray]) -> Column:
    """The rate after all moves so far: each a step against the gradient and a projection into [0, cap]."""
    rate = start
    for m in moves:
        along = sum((F.col("posterior")[k] * F.lit(float(v)) for k, v in enumerate(m)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), F.least(F.col("cap"), rate - along))
    return rate


def _by_source(values: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("at") + 1)


def fit_rates(docs: DataFrame, shares: list[float], total: float, start: list[float]) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Moves of projected gradient descent, the targets in tokens, and the largest residual as a share of the total. docs: at (index of the source), posterior, cap, size.

    start: the rate of each source's documents to begin with. Steps go along the inverse Gram matrix of the free documents,
    so that a few do; a step that doesn't bring the sum of squares down is halved.
    """
    k = len(shares)
    p, weight = [F.col("posterior")[i] for i in range(k)], F.col("size").cast("double")
    held = docs.withColumn("_start", _by_source(start))
    target = np.array(shares) * total

    def state(moves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x = held.withColumn("_rate", _rate(F.col("_start"), moves))
        free = (F.col("_rate") > 0) & (F.col("_rate") < F.col("cap"))
        sums = [F.sum(F.col("_rate") * weight * q).alias(f"t{i}") for i, q in enumerate(p)]
        gram = [F.sum(F.when(free, weight * p[i] * p[j]).otherwise(0.0)).alias(f"g{i}_{j}") for i in range(k) for j in range(i + 1)]
        row = x.agg(*sums, *gram).first()
        g = np.zeros((k, k))
        for i in range(k):
            for j in range(i + 1):
                g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
        return np.array([row[f"t{i}"] or 0.0 for i in range(k)]), g

    # what the domains' own documents give at their caps bounds a target
    own = docs.groupBy("at").agg(F.sum(F.col("cap") * weight * F.element_at("posterior", F.col("at") + 1)).alias("most")).collect()
    most = np.zeros(k)
    for row in own:
        most[row.at] = row.most or 0.0
    target = np.minimum(target, most)
    moves: list[np.ndarray] = []
    made, gram = state(moves)
    size = 1.0
    for _ in range(STEPS):
        residual = made - target
        if np.abs(residual).max() <= TOLERANCE * total:
            break
        ridge = 1e-3 * np.trace(gram) / k + 1e-9 * total
        move = size * np.linalg.solve(gram + ridge * np.eye(k), residual)
        then, next_gram = state([*moves, move])
        if np.square(then - target).sum() < np.square(residual).sum():
            moves, made, gram, size = [*moves, move], then, next_gram, min(1.0, 2 * size)
        else:
            size /= 2
            if size < 1e-3:
                break
    return moves, target, float(np.abs(made - target).max() / total)


def mixture(docs: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """doc_id, source, size, posterior, rate, n_used for every document of a listed source.

    docs: doc_id, text, source, size (tokens). targets: source, target_share, max_repeats, a short list. total: tokens of
    the mixture, by default as many as the listed sources hold once. Documents of other sources, or of null, take no
    part. A source whose cap can't reach its target is used up to the cap. A null share is 0, a null cap 1; an empty
    document may be used, but adds nothing. doc_id is unique; without documents there are no rows. posterior is in the
    order of the sources by name.
    """
    listed = sorted((r.source, r.target_share or 0.0, 1 if r.max_repeats is None else max(0, r.max_repeats)) for r in targets.select("source", "target_share", "max_repeats").distinct().collect() if r.source is not None)
    sources, shares, caps = [list(x) for x in zip(*listed)] if listed else ([], [], [])
    spark = docs.sparkSession
    part = docs.select("doc_id", "text", "source", F.coalesce("size", F.lit(0)).cast("bigint").alias("size")).where(F.col("source").isin(sources))
    by_source = {r.source: r.n for r in part.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    if not by_source:
        return spark.createDataFrame([], "doc_id bigint, source string, size bigint, posterior array<double>, rate double, n_used bigint")
    total = total or float(sum(by_source.values())) or 1.0
    of = lambda values, kind: F.element_at(F.create_map(*[x for s, v in zip(sources, values) for x in (F.lit(s), F.lit(v))]), F.col("source")).cast(kind)
    ready = posteriors(part, sources).withColumn("at", of(list(range(len(sources))), "int")).withColumn("cap", of(caps, "double")).drop("text")
    ready = written(ready, "mixing")
    start = [min(float(c), s * total / max(by_source.get(x, 0), 1)) for x, s, c in zip(sources, shares, caps)]
    moves, _, _ = fit_rates(ready, shares, total, start)
    rated = ready.select("doc_id", "source", "size", "posterior", _rate(_by_source(start), moves).alias("rate"))
    strata = max(1, -(-ready.count() // STRATUM))
    grouped = rated.withColumn("_stratum", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(strata))).groupBy("source", "_stratum")
    return grouped.applyInPandas(_whole, "doc_id bigint, source string, size bigint, posterior array<double>, rate double, n_used bigint")


def whole_uses(sizes: list[int], rates: list[float]) -> list[int]:
    """Whole uses of documents, in the order given, each next to its rate, so that the tokens used stay close to those the rates ask for."""
    out, owed = [], 0.0
    for size, rate in zip(sizes, rates):
        low = math.floor(rate + 1e-9)
        high = max(low, math.ceil(rate - 1e-9))
        want = rate + (owed / size if size else 0.0)
        n = high if want >= low + 0.5 else low
        owed += (rate - n) * size
        out.append(n)
    return out


def _whole(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable")
    rows["n_used"] = whole_uses(rows["size"].tolist(), rows["rate"].tolist())
    return rows[["doc_id", "source", "size", "posterior", "rate", "n_used"]]


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each listed source: target and actual share of the tokens, by source and as expected under the posteriors; tokens used and available, the most uses of one document."""
    made = mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("n_used")).alias("tokens"), F.sum("size").alias("available"), F.max("n_used").alias("most_used"), F.count("*").alias("n_docs"))
    total = made.agg(F.sum("tokens").alias("_total"))
    listed = targets.where("source IS NOT NULL").select("source", "target_share", "max_repeats").distinct()
    names = listed.agg(F.array_sort(F.collect_set("source")).alias("_names"))
    soft = mixed.select(F.posexplode("posterior").alias("_k", "_p"), (F.col("size") * F.col("n_used")).alias("_t")).groupBy("_k").agg(F.sum(F.col("_p") * F.col("_t")).alias("_soft"))
    soft = soft.join(F.broadcast(names)).select(F.element_at("_names", F.col("_k") + 1).alias("source"), "_soft")
    share = lambda c: F.coalesce(F.col(c) / F.nullif("_total", F.lit(0)), F.lit(0.0))
    return listed.join(made, "source", "left").join(soft, "source", "left").join(F.broadcast(total)).select("source", "target_share", "max_repeats", share("tokens").alias("actual_share"), share("_soft").alias("expected_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("available", F.lit(0)).alias("available_tokens"), "most_used", "n_docs")
