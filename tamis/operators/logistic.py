"""Logistic regression of a label on gate signals, and its comparison with the weighted gate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions import gates
from tamis.operators import metrics


def coefficients(df: DataFrame, features: list[str], label: str, ridge: float = 0.01, rounds: int = 50, tolerance: float = 1e-9) -> list[float]:
    """Bias and weights that minimise the mean log loss and ridge / 2 times the squared weights, by Newton's method.
    Each round is one aggregate of the gradient and the Hessian; only those sums reach the driver."""
    names = ["_one", *features]
    x = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    y, k = (F.col(label) == 1).cast("double"), len(names)
    w = np.zeros(k)
    penalty = ridge * np.diag([0.0, *[1.0] * (k - 1)])
    for _ in range(rounds):
        z = sum((F.lit(float(v)) * c for v, c in zip(w, x, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        row = df.agg(F.count(F.lit(1)), *(F.sum((p - y) * c) for c in x), *(F.sum(p * (1 - p) * x[i] * x[j]) for i, j in pairs)).first()
        n = row[0]
        if not n:
            break
        gradient = np.array(row[1 : 1 + k]) / n + penalty @ w
        hessian = np.zeros((k, k))
        for (i, j), v in zip(pairs, row[1 + k :], strict=True):
            hessian[i, j] = hessian[j, i] = v / n
        step = np.linalg.solve(hessian + penalty + 1e-12 * np.eye(k), gradient)
        w -= step
        if np.abs(step).max() < tolerance:
            break
    return [float(v) for v in w]


def fit_logistic(df: DataFrame, features: list[str], label: str, ridge: float = 0.01) -> DataFrame:
    """One row: bias and a weight per feature, to six decimals."""
    w = coefficients(df, features, label, ridge)
    return df.sparkSession.createDataFrame([tuple(round(v, 6) for v in w)], ", ".join(f"{n} double" for n in ["bias", *(f"weight_{f}" for f in features)]))


def compare(fit_on: DataFrame, test: DataFrame, sev: str, slm: str, label: str, band: float = 0.02) -> DataFrame:
    """Metrics of the weighted gate and of the fitted one, and what their F2 difference means."""
    bias, weight_sev, weight_slm = coefficients(fit_on, [sev, slm], label)
    linear = gates.linear_gate(F.col(sev), F.col(slm))
    logistic = gates.logistic_gate(F.col(sev), F.col(slm), bias, weight_sev, weight_slm)
    both = test.select(label, F.explode(F.array(F.struct(F.lit("linear").alias("gate"), linear.alias("pred")), F.struct(F.lit("logistic").alias("gate"), logistic.alias("pred")))).alias("g")).select(label, "g.*")
    m = metrics.gate_metrics(both, F.col("pred"), F.col(label), ["gate"])
    of = lambda g: F.max(F.when(F.col("gate") == g, F.col("f2")))
    delta = F.round(F.col("logistic_f2") - F.col("linear_f2"), 4)
    verdict = F.when(F.abs(delta) < band, "linear is enough").when(delta > 0, "logistic is better").otherwise("linear is better")
    return m.agg(of("linear").alias("linear_f2"), of("logistic").alias("logistic_f2")).withColumn("delta", delta).withColumn("verdict", verdict)
