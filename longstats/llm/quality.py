"""Quality classifier with hierarchical empirical Bayes over sites.

A document's own evidence is the log odds of a logistic regression on surface
features of its text.  Its site gives the prior: a host's share of good
documents is shrunk toward the global share, and a path's (host and language
here; any second key will do) toward its host's, by beta priors whose weight
says how many documents a parent is worth.  Each weight is found by the method of moments
from the spread between siblings.  The posterior odds are the prior's odds times
the evidence; the fit's own class balance is taken out of the evidence.

The site counts are of the classifier's soft decisions on every document, so
unlabelled sites take part; labelled rows also count by their label.  They are
grouped aggregates of three numbers per site.  A hot site is summed in every
task before the shuffle; only the tables of sites are joined back, and a NULL
host or path is a site like any other.

The regression is fitted on at most ``sample_rows`` labelled documents (the
first by a hash of the id); that bound is the only one.

Defined results: NULL texts count as empty; empty texts have the features of no
text, and are judged by them; without labels of both classes every document is kept with
the score 0.5; repeated labels of a document count once, as their smaller value; repeated
documents each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, stage, word_count

SAMPLE_ROWS = 20_000
THRESHOLD = 0.5
#: Documents that a parent's share is worth to children that don't differ beyond chance.
MOST_WORTH = 999.0


def _removed(text: Column, pattern: str) -> Column:
    """Code points that the pattern matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def features(text: Column) -> dict[str, Column]:
    """Surface features, each a bounded number; all JVM-side."""
    t = F.coalesce(text, F.lit(""))
    n, words = F.length(t).cast("double"), word_count(t)
    share = lambda x: x / F.greatest(n, F.lit(1.0))
    per_word = lambda x: x / F.greatest(words.cast("double"), F.lit(1.0))
    again = _removed(t, rf"(?<![^{SPACE_CLASS}])([^{SPACE_CLASS}]++)(?=[{SPACE_CLASS}]+\1(?![^{SPACE_CLASS}]))")
    return {
        "f_symbols": share(_removed(t, r"[^\p{L}\p{N}\x20\x09-\x0D.,;:!?'\"()-]")),
        "f_symbol_words": per_word(_removed(t, r"(?<=[^\x20\x09-\x0D\p{S}\p{P}])[.,]?([%#$&*@^~=+<>|_\\/])\1*")),
        "f_upper": share(_removed(t, r"\p{Lu}")),
        "f_digits": share(_removed(t, r"\p{N}")),
        "f_pipes": per_word(_removed(t, r"\|")),
        "f_shouts": per_word(_removed(t, r"!")),
        "f_repeats": share(again),
        "f_lines": share(_removed(t, r"\n") * F.lit(10.0)),
        "f_short": F.lit(1.0) / (F.lit(1.0) + words.cast("double")),
        "f_length": F.log1p(n) / F.lit(10.0),
        "f_word": F.least(n / F.greatest(words.cast("double"), F.lit(1.0)), F.lit(40.0)) / F.lit(10.0),
    }


def _logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Ridge logistic regression by Newton steps on standardised columns: (weights, mean, scale, intercept)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge * len(x))
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + penalty * w
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], mean, scale, float(w[-1])


def evidence(docs: DataFrame, labels: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS):
    """A column with the log odds of a good document from its features, and the fit's log prior odds; None if unfit."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    # written first: with its size known it is broadcast, and the texts stay where they are
    picked = stage(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "quality-sample")
    named = features(F.col(text))
    rows = (docs.select("doc_id", text).join(picked, "doc_id").select("quality", *[c.alias(k) for k, c in named.items()])).toPandas()
    y = rows["quality"].to_numpy(float) if len(rows) else np.zeros(0)
    if len(set(y)) < 2:
        return None
    x = rows[list(named)].to_numpy(float)
    order = np.lexsort(tuple(x.T))  # the same sums whatever order the rows arrive in
    w, mean, scale, bias = fit(x[order], y[order])
    total = F.lit(bias)
    for (_, c), a, m, s in zip(named.items(), w, mean, scale):
        z = F.greatest(F.least((c - F.lit(float(m))) / F.lit(float(s)), F.lit(8.0)), F.lit(-8.0))
        total = total + F.lit(float(a)) * z
    balance = (y.sum() + 1) / (len(y) + 2)
    return total, math.log(balance / (1 - balance))


def prior_weight(n: Column, good: Column, parent: Column) -> Column:
    """Documents that a parent's share is worth to its children, by the method of moments over the children.

    Aggregate over siblings: with shares p_i of n_i documents around the parent's P, the variance beyond the
    binomial's gives the beta prior's weight; no spread beyond chance gives the largest weight.
    """
    total, squares = F.sum(n), F.sum(n * n)
    spread = F.sum(n * F.pow(good / n - parent, 2)) / total
    chance = F.max(parent * (1 - parent))
    children = F.count(F.lit(1))
    effective = (total - squares / total) / F.greatest(children - 1, F.lit(1))
    between = (spread - chance * children / total) / F.greatest(1 - children / total, F.lit(1e-6))
    rho = F.greatest(F.least(between / F.greatest(chance, F.lit(1e-6)), F.lit(0.5)), F.lit(1e-3))
    return F.when((children < 2) | (effective <= 0), F.lit(MOST_WORTH)).otherwise(1 / rho - 1)


def site_priors(sites: DataFrame) -> DataFrame:
    """``(host, path, n, good)`` -> host, path and ``prior``: the path's shrunken share of good documents."""
    # two numbers go to the driver; half a good and half a bad document keep every share off 0 and 1
    share = float(sites.agg((F.coalesce(F.sum("good"), F.lit(0.0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 1)).first()[0])
    hosts = sites.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    worth = float(hosts.agg(prior_weight(F.col("n"), F.col("good"), F.lit(share))).first()[0] or MOST_WORTH)
    hosts = hosts.select(F.col("host").alias("h_host"),
                         ((F.col("good") + worth * share) / (F.col("n") + worth)).alias("host_prior"))
    below = sites.join(hosts, F.col("host").eqNullSafe(F.col("h_host"))).drop("h_host")
    weight = below.groupBy("host").agg(
        prior_weight(F.col("n"), F.col("good"), F.col("host_prior")).alias("w")).withColumnRenamed("host", "w_host")
    return (below.join(weight, F.col("host").eqNullSafe(F.col("w_host")))
            .select(F.col("host").alias("p_host"), F.col("path").alias("p_path"),
                    ((F.col("good") + F.col("w") * F.col("host_prior")) / (F.col("n") + F.col("w"))).alias("prior")))


def judged(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = THRESHOLD,
           sample_rows: int = SAMPLE_ROWS, keep: Column | None = None) -> DataFrame:
    """doc_id (or the column to keep), ``evidence``, ``prior``, ``score`` (posterior of good), ``kept`` (score at or above)."""
    found = evidence(docs, labels, sample_rows=sample_rows)
    own = F.col("doc_id") if keep is None else keep
    if found is None:
        return docs.select(own, F.lit(0.0).alias("evidence"), F.lit(0.5).alias("prior"), F.lit(0.5).alias("score"),
                           F.lit(True).alias("kept"))
    log_odds, balance = found
    scored = docs.select(F.struct(own).alias("row"), F.col("doc_id").alias("l_doc"), host.alias("host"),
                         path.alias("path"), log_odds.alias("log_odds"))
    soft = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("log_odds")))
    told = (labels.where(F.col("quality").isNotNull()).groupBy("doc_id")
            .agg(F.min("quality").cast("double").alias("told")).withColumnRenamed("doc_id", "t_doc"))
    # the features are computed once: what follows reads one row per document
    scored = stage(scored, "quality-evidence")
    sites = (scored.select("l_doc", "host", "path", "log_odds").join(told, F.col("l_doc") == F.col("t_doc"), "left")
             .groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"),
                                          F.sum(F.round(F.coalesce("told", soft), 6).cast("decimal(20,6)")).alias("good"))
             .withColumn("good", F.col("good").cast("double")))
    priors = site_priors(stage(sites, "quality-sites"))
    posterior = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("log_odds") - F.lit(balance) + _logit(F.col("prior")))))
    return (scored.join(priors, F.col("host").eqNullSafe(F.col("p_host")) & F.col("path").eqNullSafe(F.col("p_path")))
            .select("row.*", F.round(F.col("log_odds") - F.lit(balance), 6).alias("evidence"),
                    F.round("prior", 6).alias("prior"), F.round(posterior, 6).alias("score"))
            .withColumn("kept", F.col("score") >= threshold))


def keep_good(docs: DataFrame, labels: DataFrame, host: Column, path: Column, **options) -> DataFrame:
    """The documents that the classifier keeps, all columns."""
    found = judged(docs, labels, host, path, keep=F.struct(*docs.columns).alias("doc"), **options)
    return found.where("kept").select("doc.*")


__all__ = ["evidence", "features", "fit", "judged", "keep_good", "site_priors"]
