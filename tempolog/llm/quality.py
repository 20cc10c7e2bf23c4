"""Quality classifier with hierarchical empirical Bayes.

A logistic regression on features of the text gives each document's own evidence.  Its host and its path
on the host add prior evidence: grouped sums of the classifier's probabilities are shrunk, paths toward
their host and hosts toward the corpus, the more the fewer documents a site has and the less sites of one parent differ.
The posterior of a document combines its likelihood ratio with its path's shrunk prior.

Documents have no URL column, so source stands for the host and lang for the path: what is called the path
prior is that of a language within its source.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, bound_batches, staged, whole_row, whole_text

#: The classifier is fitted on at most this many labelled documents, those with the least hashes of doc_id.
LABELLED = 20_000
#: Probabilities enter sums as whole millionths, so that sums do not depend on their order.
UNIT = 1_000_000
#: Bounds of the strength, in documents, with which a level pulls the one below it.
STRENGTH = (2.0, 200.0)
CLIP = 12.0
RESULTS = ["__evidence", "__host_prior", "__prior", "__score", "__keep"]

_UPPER, _DIGIT = slice(65, 91), slice(48, 58)
_SYMBOLS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_STOPS = np.array([ord(c) for c in ".,;:'\"()-?"])
_RARE = np.setdiff1d(_SYMBOLS, _STOPS)


def features(text: bytes) -> list[float]:
    """Features of a whole UTF-8 text, all bounded; the empty text has zeros."""
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n, size = len(words), max(1, len(text))
    if not n:
        return [0.0] * 12
    lines = text.split(b"\n")
    letters = max(1, int(histogram[65:91].sum() + histogram[97:123].sum()))
    repeats = sum(map(eq, words, words[1:]))
    distinct = len(set(words))
    rare = int(histogram[_RARE].sum())
    return [
        1.0,
        np.log1p(n) / 10,
        histogram[_UPPER].sum() / letters,
        rare / size,
        min(1.0, rare / n),
        histogram[_SYMBOLS].sum() / size,
        histogram[_DIGIT].sum() / size,
        repeats / n,
        distinct / n,
        min(1.0, distinct / (n**0.75)),
        1 - len(set(lines)) / len(lines),
        min(1.0, size / n / 20),
    ]


def feature_table(texts: pd.Series) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), 12)


def expand(table: np.ndarray) -> np.ndarray:
    """Features with square roots, which tell small shares from none, and a constant."""
    return np.hstack([table, np.sqrt(table[:, 2:8]), np.ones((len(table), 1))])


def fit_logistic(table: np.ndarray, labels: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Weights of a logistic regression by Newton's method on standardized columns; constant last."""
    x = expand(table)
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    centre[-1], spread[-1] = 0.0, 1.0
    z = (x - centre) / spread
    w = np.zeros(z.shape[1])
    penalty = ridge * len(z) * np.ones(z.shape[1])
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        curve = (z * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ z + np.diag(penalty)
        move = np.linalg.solve(curve, z.T @ (labels - p) - penalty * w)
        w += np.clip(move, -3, 3)
        if np.abs(move).max() < 1e-8:
            break
    raw = w / spread
    raw[-1] = w[-1] - (w[:-1] * centre[:-1] / spread[:-1]).sum()
    return raw


def train(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[np.ndarray, float]:
    """Weights and the share of good labels.  Rows without doc_id or quality are no examples; of a doc_id
    that repeats in labels the least quality counts.  Without examples of both kinds the classifier knows
    nothing: its evidence is zero everywhere.  Of a doc_id that repeats in documents the least text counts, so
    the training set does not depend on the order of rows.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    examples = docs.select("doc_id", whole_text().cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("__quality").alias("__quality"))
    fields = ", ".join(f"f{k} double" for k in range(12))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            table = pd.DataFrame(feature_table(batch["text"]), columns=[f"f{k}" for k in range(12)])
            yield pd.concat([batch[["doc_id", "__quality"]].reset_index(drop=True), table], axis=1)

    got = examples.mapInPandas(run, f"doc_id long, __quality int, {fields}").toPandas().sort_values("doc_id")
    good = (got["__quality"].to_numpy() > 0).astype(float)
    if not len(got) or good.min() == good.max():
        return np.zeros(19), 0.5
    return fit_logistic(got[[f"f{k}" for k in range(12)]].to_numpy(), good), float(good.mean())


def evidence(weights: np.ndarray, base: float) -> Column:
    """Log likelihood ratio of good against bad, from the whole text: the classifier's log odds less those of its training."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        odds = expand(feature_table(texts)) @ weights
        return pd.Series(np.clip(odds - np.log(base / (1 - base)), -CLIP, CLIP))

    return score(whole_text().cast("binary"))


def _logit(p: Column) -> Column:
    bounded = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(bounded / (F.lit(1.0) - bounded))


def _strength(groups: DataFrame) -> float:
    """How many documents of the parent's mean a group's own mean is pulled by: variance within groups over variance between them.

    ``groups``: n, s, q (number, sum and sum of squares of the documents' probabilities), and parent_n, parent_s of the group's parent.
    Both variances are moment estimates of a one-way layout nested in parents; what lies between parents is in neither.
    """
    mean, above = F.col("s") / F.col("n"), F.col("parent_s") / F.col("parent_n")

    def whole(value: Column) -> Column:
        return F.sum(F.round(value * UNIT).cast("long"))

    got = groups.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), whole(F.col("n") / F.col("parent_n")).alias("parents"), whole(F.col("q") - F.col("s") * mean).alias("within"),
        whole(F.col("n") * (mean - above) * (mean - above)).alias("between"), whole(F.col("n") - F.col("n") * F.col("n") / F.col("parent_n")).alias("spread"),
    ).first()
    if not got["n"] or got["n"] <= got["groups"] or got["spread"] < 1:
        return STRENGTH[1]
    inner = max(got["within"], 0) / UNIT / (got["n"] - got["groups"])
    outer = (got["between"] / UNIT - inner * (got["groups"] - round(got["parents"] / UNIT))) / (got["spread"] / UNIT)
    return float(min(max(inner / outer if outer > 0 else STRENGTH[1], STRENGTH[0]), STRENGTH[1]))


def site_priors(scored: DataFrame) -> DataFrame:
    """__host, __path, prior: shrunk probability that a document there is good.  scored has __host, __path, evidence."""
    p = F.round(F.lit(UNIT) / (F.lit(1.0) + F.exp(-F.col("evidence")))).cast("long")
    sums = [F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")]
    counted = scored.select("__host", "__path", F.lit(1).alias("n"), p.alias("s"), F.round(p * p / UNIT).cast("long").alias("q"))
    paths = staged(counted.groupBy("__host", "__path").agg(*sums), "paths")
    hosts = staged(paths.groupBy("__host").agg(*sums), "hosts")
    whole = hosts.agg(*sums).first()

    def scaled(groups: DataFrame, parent_n: Column, parent_s: Column) -> DataFrame:
        return groups.select("*", (F.col("g.s") / UNIT).alias("s"), (F.col("g.q") / UNIT).alias("q"), F.col("g.n").alias("n"), parent_n.alias("parent_n"), (parent_s / UNIT).alias("parent_s"))

    mean = whole["s"] / UNIT / whole["n"] if whole["n"] else 0.5
    of_hosts = scaled(hosts.select("__host", F.struct("n", "s", "q").alias("g")), F.lit(whole["n"] or 1), F.lit(whole["s"] or 0))
    pull_host = _strength(of_hosts)
    shrunk = of_hosts.select("__host", F.col("g.n").alias("host_n"), F.col("g.s").alias("host_s"), ((F.col("s") + pull_host * mean) / (F.col("n") + pull_host)).alias("host_prior"))
    joined = scaled(paths.select("__host", "__path", F.struct("n", "s", "q").alias("g")).join(shrunk, "__host"), F.col("host_n"), F.col("host_s"))
    pull_path = _strength(joined)
    return joined.select("__host", "__path", "host_prior", ((F.col("s") + F.lit(pull_path) * F.col("host_prior")) / (F.col("n") + F.lit(pull_path))).alias("prior"))


def _judged(scored: DataFrame) -> DataFrame:
    """``scored`` (a staged table with __host, __path, __evidence) with what the sites add and what follows."""
    priors = staged(site_priors(scored.select("__host", "__path", F.col("__evidence").alias("evidence"))), "priors")
    # Sites that hold over 1/1024 of all rows, at most 1024 of them, are salted if the table is too large to broadcast.
    counts = scored.groupBy("__host", "__path").agg(F.count(F.lit(1)).alias("n"))
    hot = counts.filter(F.col("n") * 1024 > scored.count()).select("__host", "__path")
    placed = attach(scored, priors.withColumnsRenamed({"host_prior": "__host_prior", "prior": "__prior"}), ["__host", "__path"], hot)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("__evidence") + _logit(F.col("__prior")))))
    return placed.withColumn("__score", score).withColumn("__keep", F.col("__score") >= 0.5).drop("__host", "__path")


def classified(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", most_labelled: int = LABELLED, columns: list[str] | None = None) -> DataFrame:
    """The ``columns`` of ``docs`` (all, if not given) with __evidence, __host_prior, __prior, __score (probability of good) and __keep.

    A null text counts as empty; null hosts or paths form a site of their own.  Repeated rows count and are
    judged alike; texts of any length are read whole, an empty table gives an empty result.  A document stays when
    its posterior is at least one half, exactly one half included.  Columns that have a result's name
    give way to it; :func:`keep_good` leaves columns of any name.  Every text is read once: the evidence is staged with the columns.
    """
    own = [c for c in (docs.columns if columns is None else columns) if c.lower() not in RESULTS]
    return _classified(docs, labels, host, path, most_labelled, own).select("row.*", *RESULTS)


def _classified(docs: DataFrame, labels: DataFrame, host: str, path: str, most_labelled: int, columns: list[str]) -> DataFrame:
    """The ``columns`` of every row of ``docs`` as row, with RESULTS."""
    bound_batches(docs.sparkSession)
    weights, base = train(docs, labels, most_labelled)
    site = {f"__{name}": F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("")) for name, column in (("host", host), ("path", path))}
    scored = docs.select(whole_row(columns), *[value.alias(name) for name, value in site.items()], evidence(weights, base).alias("__evidence"))
    return _judged(staged(scored, "evidence"))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns unchanged; cases as in :func:`classified`."""
    return _classified(docs, labels, host, path, LABELLED, docs.columns).filter("__keep").select("row.*")
