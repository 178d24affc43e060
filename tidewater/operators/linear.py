"""Linear regression from aggregated cross products (survey M14, E10).

One aggregation gives the cross products of the standardised features and the
response for every split; OLS, the whole ridge path and the errors on all
splits follow from these p x p tables, so the number of penalties costs no
pass over the data.
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["gram_moments", "ridge_path"]


def gram_moments(df: DataFrame, features: Sequence[str], response: str, split: str, fit_split: str):
    """(means, stds, moments): train means and population standard deviations (0 counts as 1), and per split the row
    count and the cross products of (1, standardised features, response).  Missing features count as the train mean;
    rows without a response are left out.  Two aggregations; a row per split comes to the driver."""
    features = list(features)
    d = df.where(F.col(response).isNotNull()).select(F.col(split).alias("__split"), F.col(response).cast("double").alias("__y"),
                                                     *[F.col(c).cast("double").alias(c) for c in features])
    row = d.where(F.col("__split") == fit_split).agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)]).first()
    means = [row[f"m{i}"] or 0.0 for i in range(len(features))]
    stds = [row[f"s{i}"] or 1.0 for i in range(len(features))]
    z = [F.lit(1.0), *[F.coalesce((F.col(c) - F.lit(m)) / F.lit(s), F.lit(0.0)) for c, m, s in zip(features, means, stds)], F.col("__y")]
    names = [f"z{i}" for i in range(len(z))]
    d = d.select("__split", *[c.alias(n) for c, n in zip(z, names)])
    sums = d.groupBy("__split").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]])
    moments = {}
    for r in sums.collect():
        g = np.zeros((len(names), len(names)))
        for i, a in enumerate(names):
            for j, b in enumerate(names[i:], start=i):
                g[i, j] = g[j, i] = r[f"{a}_{b}"]
        moments[r["__split"]] = g
    return np.array(means), np.array(stds), moments


def ridge_path(df: DataFrame, features: Sequence[str], response: str, split: str = "split", fit_split: str = "train",
               pick_split: str = "val", alphas: Sequence[float] = (0.0, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)) -> DataFrame:
    """Rows (alpha, term, coefficient, rmse_<pick_split>, picked) of OLS (alpha 0) and ridge on standardised features, with
    the penalty alpha on the slopes only; the alpha with the least error on ``pick_split`` is picked (the smaller of
    equal ones).  ``term`` is ``intercept`` or a feature; coefficients belong to the standardised features.
    A singular system at alpha 0 is solved with least norm.  Without rows in ``fit_split`` the result is empty."""
    features = list(features)
    _, _, moments = gram_moments(df, features, response, split, fit_split)
    schema = f"alpha double, term string, coefficient double, rmse_{pick_split} double, picked boolean"
    spark, p = df.sparkSession, len(features) + 1
    if fit_split not in moments:
        return spark.createDataFrame([], schema)
    gram, held = moments[fit_split], moments.get(pick_split)
    rows, best = [], None
    for alpha in alphas:
        penalty = np.diag([0.0] + [float(alpha)] * len(features))
        beta = np.linalg.lstsq(gram[:p, :p] + penalty, gram[:p, p], rcond=None)[0]
        rmse = None
        if held is not None:
            # sum (y - xb)^2 from the cross products alone
            sse = held[p, p] - 2 * beta @ held[:p, p] + beta @ held[:p, :p] @ beta
            rmse = math.sqrt(max(0.0, sse / held[0, 0]))
            if best is None or rmse < best[0]:
                best = (rmse, alpha)
        rows.append((float(alpha), beta, rmse))
    return spark.createDataFrame([(a, t, float(b), rmse, best is not None and a == best[1])
                                  for a, beta, rmse in rows for t, b in zip(["intercept", *features], beta)], schema)
