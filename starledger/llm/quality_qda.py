"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each statistic is put on a bounded scale (logarithms for counts, logits for shares) and
standardised.  Class means and covariances come from sums over *all* labelled training rows, added
up in the tasks and then by Spark, so the fit grows with the rows and the driver sees one short
vector per class.  A class covariance is shrunk towards the pooled one and towards a multiple of
the identity.  A document's score is the logistic of the difference of the class log-densities,
with Mahalanobis distances from Cholesky factors computed once per fit.

Defined results: a null or empty text gets the score of an empty one; null labels and labels of
unknown documents are ignored; with only one class known every score is that class's prior, without
any label 0.5; repeated rows get the same score; further columns are ignored; an empty table gives
an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.llm import textstats
from starledger.llm.common import part_of, pick
from starledger.session import cut_lineage

SHRINK_TO_POOLED = 0.1
SHRINK_TO_SPHERE = 0.02
SPREAD = 6.0            # standardised values end here
COUNT_LIKE = ("words", "word_length", "line_words")
SHARE_STEP = 1e-3       # added to shares before the logit


def transform(ratios: np.ndarray) -> np.ndarray:
    """Statistics on comparable, bounded scales."""
    out = np.empty_like(ratios)
    for i, name in enumerate(textstats.RATIOS):
        x = ratios[:, i]
        if name in COUNT_LIKE:
            out[:, i] = np.log1p(x)
        else:
            p = np.clip(x, 0.0, 1.0)
            out[:, i] = np.log((p + SHARE_STEP) / (1.0 - p + SHARE_STEP))
    return out


@dataclass(frozen=True)
class Model:
    """Means and inverse Cholesky factors of both classes; ``prior`` alone where a class is missing."""

    prior: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: tuple | None = None
    factors: tuple | None = None      # inverse lower triangles
    constants: tuple | None = None    # log prior - log determinant / 2

    def score(self, ratios: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(ratios), self.prior)
        z = np.clip((transform(ratios) - self.centre) / self.scale, -SPREAD, SPREAD)
        log_density = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1)
                       for m, f, c in zip(self.means, self.factors, self.constants)]
        return 1.0 / (1.0 + np.exp(np.clip(log_density[0] - log_density[1], -700, 700)))


def _sums(rows: DataFrame, centre: np.ndarray, scale: np.ndarray, clipped: bool) -> dict:
    """Per label: rows, sum and sum of outer products of the standardised statistics."""
    d = len(textstats.RATIOS)
    names = [f"r_{r}" for r in textstats.RATIOS]

    def partial(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = transform(np.column_stack([batch.column(c).to_numpy() for c in names]))
            z = (x - centre) / scale
            if clipped:
                z = np.clip(z, -SPREAD, SPREAD)
            z = np.column_stack([np.ones(len(z)), z])
            label = batch.column("label").to_numpy()
            for k in np.unique(label):
                part = z[label == k]
                total[int(k)] = total.get(int(k), 0) + part.T @ part
        for k, matrix in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * matrix.size, pa.int32()), pa.array(np.arange(matrix.size), pa.int32()),
                 pa.array(matrix.ravel())], ["label", "cell", "value"])

    added = (rows.mapInArrow(partial, "label int, cell int, value double")
             .groupBy("label", "cell").agg(F.sum("value").alias("value")).collect())
    out: dict[int, np.ndarray] = {}
    for label, cell, value in added:
        out.setdefault(label, np.zeros((d + 1) ** 2))[cell] = value
    return {k: v.reshape(d + 1, d + 1) for k, v in out.items()}


def fit(rows: DataFrame) -> Model:
    """A model from rows (label, r_*): two passes, first the common scale, then class moments."""
    d = len(textstats.RATIOS)
    first = _sums(rows, np.zeros(d), np.ones(d), False)
    n = sum(m[0, 0] for m in first.values())
    if not n:
        return Model(0.5)
    if set(first) != {0, 1} or min(m[0, 0] for m in first.values()) < 2:
        return Model(float(first[1][0, 0] / n) if 1 in first else 0.0)
    total = sum(first.values())
    centre = total[0, 1:] / n
    scale = np.sqrt(np.maximum(np.diag(total)[1:] / n - centre ** 2, 0.0))
    # Rounded, so that the order in which Spark adds does not show in the scores.
    centre, scale = np.round(centre, 9), np.round(np.where(scale > 1e-6, scale, 1.0), 9)
    second = _sums(rows, centre, scale, True)
    size = {k: m[0, 0] for k, m in second.items()}
    mean = {k: m[0, 1:] / size[k] for k, m in second.items()}
    cov = {k: m[1:, 1:] / size[k] - np.outer(mean[k], mean[k]) for k, m in second.items()}
    pooled = sum(size[k] * cov[k] for k in cov) / n
    means, factors, constants = [], [], []
    for k in (0, 1):
        shrunk = (1 - SHRINK_TO_POOLED) * cov[k] + SHRINK_TO_POOLED * pooled
        shrunk = ((1 - SHRINK_TO_SPHERE) * shrunk
                  + SHRINK_TO_SPHERE * max(np.trace(shrunk) / d, 1e-3) * np.eye(d))
        lower = np.linalg.cholesky(np.round(shrunk, 9))
        means.append(np.round(mean[k], 9))
        factors.append(np.linalg.inv(lower))
        constants.append(float(np.log(size[k] / n) - np.log(np.diag(lower)).sum()))
    return Model(float(size[1] / n), centre, scale, tuple(means), tuple(factors), tuple(constants))


def scores(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id",
           label: str = "quality", folds: int = 4, held_fold: int = 2, threshold: float = 0.7) -> DataFrame:
    """Per document: id, held_out, score, predicted.  Rows of the held-out fold teach nothing."""
    slim = pick(docs, id=ident, text=text).select(F.col("id").cast("bigint"), F.col("text").cast("string"))
    measured = cut_lineage(
        slim.mapInArrow(lambda it: textstats.stats_batches(it, "text", ["id"]),
                        f"id bigint, {textstats.STATS_SCHEMA}")
        .select("id", *[f"r_{r}" for r in textstats.RATIOS]), "statistics")
    held = F.coalesce(part_of(F.col("id"), folds) == held_fold, F.lit(False))
    known = (pick(labels, id=ident, label=label).select(F.col("id").cast("bigint"), F.col("label").cast("int"))
             .filter("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
             .filter(~held))
    model = fit(measured.join(known, "id").select("label", *[f"r_{r}" for r in textstats.RATIOS]))

    def judge(batches):
        for batch in batches:
            x = np.column_stack([batch.column(f"r_{r}").to_numpy() for r in textstats.RATIOS])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(x))], ["id", "score"])

    return (measured.mapInArrow(judge, "id bigint, score double")
            .select(F.col("id").alias(ident), held.alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
