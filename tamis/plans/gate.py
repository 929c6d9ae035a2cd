"""The gate study: metrics, variants, grid search, ablations, ranking curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import gates
from tamis.operators import grid, metrics
from tamis.operators.logistic import compare, fit_logistic
from tamis.plans.samples import S, metrics_sql, samples, table

_COEF = {"bias": -1.0, "weight_sev": 0.5, "weight_slm": 1.0}
_PROD = {k: gates.PRODUCTION[k] for k in ("weight_static", "weight_slm", "threshold")}

#: The compared variants: name -> (strategy, parameters).
VARIANTS = {
    "static_only": ("static_only", {}), "small_model": ("model_only", {}), "always": ("always", {}), "static_or_model": ("static_or_model", {}), "production": ("weighted_override", _PROD),
    "tuned_override": ("weighted_override", {}), "tuned": ("weighted", {}), "logistic": ("logistic", _COEF),
}


def _pred(name: str) -> Column:
    strategy, params = VARIANTS[name]
    return gates.STRATEGIES[strategy](F.col("sev"), F.col("slm"), **params)


def gate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.gate_metrics(samples(spark, sf_dir), _pred("tuned"), F.col("label"))


def gate_metrics_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.gate_metrics(samples(spark, sf_dir), _pred("tuned"), F.col("label"), ["project"])


def with_variants(df: DataFrame) -> DataFrame:
    """A row per sample and variant."""
    return df.select("*", F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), _pred(n).alias("pred")) for n in VARIANTS))).alias("v")).select("project", "label", "v.*")


def gate_variants_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics per variant and project, and per variant (project null)."""
    rows = with_variants(samples(spark, sf_dir))
    counts = rows.rollup("variant", "project").agg(*metrics.confusion(F.col("pred"), F.col("label"))).filter("variant is not null")
    return metrics.with_metrics(counts)


def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.grid_search(samples(spark, sf_dir), "sev", "slm", "label")


def grid_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.best_point(grid_search(spark, sf_dir))


def threshold_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_search(spark, sf_dir).filter("weight_static = 0.15").select("threshold", "precision", "recall", "f2", "escalation_rate")


def heatmap_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = [(w, round(1 - w, 4), t) for w in (0.0, 0.5, 1.0) for t in (0.2, 0.5, 0.8)]
    found = grid.grid_search(samples(spark, sf_dir), "sev", "slm", "label", points)
    wide = found.groupBy("weight_static").pivot("threshold", [0.2, 0.5, 0.8]).agg(F.first("f2"))
    return wide.select("weight_static", *(F.col(f"`{t}`").alias(f"t{int(t * 10)}") for t in (0.2, 0.5, 0.8)))


def override_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the override less without it."""
    rows = with_variants(samples(spark, sf_dir)).filter(F.col("variant").isin("tuned", "tuned_override"))
    m = metrics.gate_metrics(rows, F.col("pred"), F.col("label"), ["variant"])
    of = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    return m.agg(*(F.round(of("tuned_override", c) - of("tuned", c), 4).alias(f"{c}_delta") for c in ("f2", "recall", "escalation_rate")))


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    total, kinds = s.agg(F.count(F.lit(1)), F.countDistinct("label")).first()
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", "n", F.round(F.lit(float(total)) / (F.lit(float(kinds)) * F.greatest(F.lit(1), F.col("n"))), 6).alias("weight"))


def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per project and over all (project null)."""
    s = samples(spark, sf_dir)
    return s.rollup("project").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("vulnerable"), (F.count(F.lit(1)) - F.sum("label")).cast("long").alias("safe"), F.countDistinct("project").alias("projects"))


def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by label, by severity and by kind in one pass."""
    s = samples(spark, sf_dir).select("label", "severity", "cwe")
    s.createOrReplaceTempView("tamis_dataset")
    return spark.sql("SELECT label, severity, cwe, count(*) AS n FROM tamis_dataset GROUP BY GROUPING SETS ((label), (severity), (cwe), ())")


def pipeline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates with the savings as percentages."""
    m = gate_metrics(spark, sf_dir)
    e = (F.col("tp") + F.col("fp")) / F.col("total_samples")
    return m.select("precision", "recall", "f1", F.round((1 - e) * 100, 2).alias("trr_percent"), F.round((1 - e) * 98, 2).alias("cost_percent"), "total_samples")


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the model's own decision beside its ranking scores; both are one row."""
    s = samples(spark, sf_dir)
    one = F.lit(1)
    m = metrics.gate_metrics(s, _pred("small_model"), F.col("label")).withColumn("_one", one)
    return m.join(F.broadcast(metrics.ranking_scores(s, "slm", "label").withColumn("_one", one)), "_one").select("accuracy", "precision", "recall", "f1", "f2", "roc_auc", "average_precision")


def production_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    risk = F.round(gates.risk(F.col("sev"), F.col("slm"), 0.4, 0.6), 4)
    return s.select("sample_id", risk.alias("risk"), (risk >= 0.52).alias("escalate"), F.col("sev").alias("static_score"), F.col("slm").alias("slm_score"))


def category_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("ok", (_pred("small_model") == (F.col("label") == 1)).cast("int"))
    return s.groupBy(F.col("cwe").alias("category")).agg(F.sum("ok").cast("long").alias("correct"), F.count(F.lit(1)).alias("total"), F.round(F.avg("ok"), 6).alias("accuracy"))


def multi_label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of three class probabilities, of which the first is the safe class."""
    s = samples(spark, sf_dir)
    p = F.array(1 - F.col("slm"), F.col("slm") * 0.75, F.col("slm") * 0.25)
    return s.select("sample_id", F.round(gates.multi_label_score(p, 0), 6).alias("score"))


def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_points(samples(spark, sf_dir), "slm", "label")


def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pr_points(samples(spark, sf_dir), "slm", "label")


def ranking_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranking_scores(samples(spark, sf_dir), "slm", "label")


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.calibration(samples(spark, sf_dir), "slm", "label")


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(samples(spark, sf_dir), "slm")


def ratio_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    slm = F.col("slm")
    bucket = F.when(slm < 0.1, "0-10%").when(slm < 0.25, "10-25%").when(slm < 0.5, "25-50%").when(slm < 0.75, "50-75%").otherwise("75-100%")
    return samples(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_logistic(samples(spark, sf_dir), ["sev", "slm"], "label")


def linear_vs_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on one third of the samples, compared on the rest."""
    s = samples(spark, sf_dir)
    return compare(s.filter("sample_id % 3 = 0"), s.filter("sample_id % 3 <> 0"), "sev", "slm", "label")


def gold_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a case, with the last of its urgent orders as its finding, defaults where it has none."""
    cases = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    last = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("risk"))
    return cases.join(last, "c_custkey", "left").select("c_custkey", "c_mktsegment", F.col("risk").isNotNull().alias("escalated"), F.coalesce("risk", F.lit(0.0)).alias("risk"))


def _variant_sql() -> str:
    lin = lambda a, b, t: f"{a} * sev + {b} * slm >= {t}"
    d = lambda x: f"CAST({x} AS DOUBLE)"
    over = f" OR sev >= 1 OR slm > {d(0.9)}"
    rules = {
        "static_only": "sev > 0", "small_model": f"slm >= {d(0.5)}", "always": "true", "static_or_model": f"sev > 0 OR slm >= {d(0.5)}", "production": lin(d(0.4), d(0.6), d(0.52)) + over,
        "tuned_override": lin(d(0.15), d(0.85), d(0.2)) + over, "tuned": lin(d(0.15), d(0.85), d(0.2)), "logistic": "1 / (1 + exp(-(-1 + CAST(0.5 AS DOUBLE) * sev + slm))) >= CAST(0.5 AS DOUBLE)",
    }
    return "v AS (" + " UNION ALL ".join(f"SELECT project, label, '{n}' AS variant, {r} AS pred FROM s" for n, r in rules.items()) + ")"


_V = _variant_sql()
_TUNED = "t AS (SELECT *, CAST(0.15 AS DOUBLE) * sev + CAST(0.85 AS DOUBLE) * slm >= CAST(0.2 AS DOUBLE) AS pred FROM s)"
_GRID_VALUES = ", ".join(f"({w!r}::DOUBLE, {v!r}::DOUBLE, {t!r}::DOUBLE)" for w, v, t in grid.grid_points())
_GRID = f"""g(weight_static, weight_slm, threshold) AS (VALUES {_GRID_VALUES}),
x AS (SELECT g.*, label, weight_static * sev + weight_slm * slm >= threshold AS pred FROM s, g), m AS ({metrics_sql('x', 'weight_static, weight_slm, threshold')})"""
_RANK = """b AS (SELECT slm AS score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM s GROUP BY slm),
r AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM b)"""
_RANK_SCORES = """SELECT round(sum(p * (an - cn) + p * n / 2.0::DOUBLE) / (max(ap) * max(an)), 6) AS roc_auc, round(sum(p / ap::DOUBLE * cp / (cp + cn)), 6) AS average_precision FROM r"""

QUERIES = {
    f.__name__: f
    for f in (
        gate_metrics, gate_metrics_by_project, gate_variants_rollup, grid_search, grid_best, threshold_slice, heatmap_pivot, override_ablation, class_weights, manifest_summary, dataset_summary, pipeline_metrics,
        model_metrics, production_gate, category_accuracy, multi_label_scores, roc_curve, pr_curve, ranking_scores, calibration, score_histogram, ratio_buckets, logistic_fit, linear_vs_logistic, gold_join,
    )
}

ORACLES = {
    "gate_metrics": f"WITH {S}, {_TUNED} {metrics_sql('t')}",
    "gate_metrics_by_project": f"WITH {S}, {_TUNED} {metrics_sql('t', 'project')}",
    "gate_variants_rollup": f"WITH {S}, {_V} ({metrics_sql('v', 'variant, project')}) UNION ALL ({metrics_sql('v', 'variant').replace('SELECT variant, tp', 'SELECT variant, NULL, tp', 1)})",
    "grid_search": f"WITH {S}, {_GRID} SELECT * FROM m",
    "grid_best": f"WITH {S}, {_GRID} SELECT * FROM m ORDER BY f2 DESC, recall DESC, escalation_rate, weight_static, threshold LIMIT 1",
    "threshold_slice": f"WITH {S}, {_GRID} SELECT threshold, precision, recall, f2, escalation_rate FROM m WHERE weight_static = 0.15::DOUBLE",
    "heatmap_pivot": f"WITH {S}, {_GRID} SELECT weight_static, max(f2) FILTER (threshold = 0.2::DOUBLE) AS t2, max(f2) FILTER (threshold = 0.5::DOUBLE) AS t5, max(f2) FILTER (threshold = 0.8::DOUBLE) AS t8 FROM m WHERE weight_static IN (0.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE) GROUP BY weight_static",
    "override_ablation": f"WITH {S}, {_V}, m AS ({metrics_sql('v', 'variant')}) SELECT " + ", ".join(f"round(max({c}) FILTER (variant = 'tuned_override') - max({c}) FILTER (variant = 'tuned'), 4) AS {c}_delta" for c in ("f2", "recall", "escalation_rate")) + " FROM m",
    "class_weights": f"WITH {S} SELECT label, count(*) AS n, round((SELECT count(*) FROM s)::DOUBLE / ((SELECT count(DISTINCT label) FROM s) * count(*)), 6) AS weight FROM s GROUP BY label",
    "manifest_summary": f"WITH {S} SELECT project, count(*) AS n, sum(label)::BIGINT AS vulnerable, (count(*) - sum(label))::BIGINT AS safe, count(DISTINCT project) AS projects FROM s GROUP BY ROLLUP (project)",
    "dataset_summary": f"WITH {S} SELECT label, severity, cwe, count(*) AS n FROM s GROUP BY GROUPING SETS ((label), (severity), (cwe), ())",
    "pipeline_metrics": f"WITH {S}, {_TUNED}, m AS ({metrics_sql('t')}) SELECT precision, recall, f1, round((1 - (tp + fp) / total_samples::DOUBLE) * 100, 2) AS trr_percent, round((1 - (tp + fp) / total_samples::DOUBLE) * 98, 2) AS cost_percent, total_samples FROM m",
    "model_metrics": f"WITH {S}, t AS (SELECT *, slm >= 0.5::DOUBLE AS pred FROM s), m AS ({metrics_sql('t')}), {_RANK}, k AS ({_RANK_SCORES}) SELECT accuracy, precision, recall, f1, f2, roc_auc, average_precision FROM m, k",
    "production_gate": f"WITH {S}, q AS (SELECT *, round(0.4::DOUBLE * sev + 0.6::DOUBLE * slm, 4) AS risk FROM s) SELECT sample_id, risk, risk >= 0.52::DOUBLE AS escalate, sev AS static_score, slm AS slm_score FROM q",
    "category_accuracy": f"WITH {S}, t AS (SELECT *, CASE WHEN (slm >= 0.5::DOUBLE) = (label = 1) THEN 1 ELSE 0 END AS ok FROM s) SELECT cwe AS category, sum(ok)::BIGINT AS correct, count(*) AS total, round(avg(ok), 6) AS accuracy FROM t GROUP BY cwe",
    "multi_label_scores": f"WITH {S} SELECT sample_id, round(greatest(1 - (1 - slm), slm * 0.75::DOUBLE, slm * 0.25::DOUBLE), 6) AS score FROM s",
    "roc_curve": f"WITH {S}, {_RANK} SELECT score, round(cn / an::DOUBLE, 6) AS fpr, round(cp / ap::DOUBLE, 6) AS tpr FROM r",
    "pr_curve": f"WITH {S}, {_RANK} SELECT score, round(cp / (cp + cn)::DOUBLE, 6) AS precision, round(cp / ap::DOUBLE, 6) AS recall FROM r",
    "ranking_scores": f"WITH {S}, {_RANK} {_RANK_SCORES}",
    "calibration": f"WITH {S} SELECT least(floor(slm * 10), 9)::INTEGER AS bin, round(avg(slm), 6) AS mean_score, round(avg(label::DOUBLE), 6) AS positive_share, count(*) AS n FROM s GROUP BY 1",
    "score_histogram": f"""WITH {S}, l AS (SELECT min(slm) AS lo, (max(slm) - min(slm)) / 15 AS w FROM s), h AS (SELECT least(floor((slm - lo) / w), 14)::INTEGER AS bin, count(*) AS n FROM s, l GROUP BY 1)
SELECT b::INTEGER AS bin, coalesce(n, 0) AS n FROM range(15) AS k(b) LEFT JOIN h ON h.bin = k.b""",
    "ratio_buckets": f"WITH {S} SELECT CASE WHEN slm < 0.1::DOUBLE THEN '0-10%' WHEN slm < 0.25::DOUBLE THEN '10-25%' WHEN slm < 0.5 THEN '25-50%' WHEN slm < 0.75 THEN '50-75%' ELSE '75-100%' END AS bucket, count(*) AS n FROM s GROUP BY 1",
    "gold_join": """WITH l AS (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS risk FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey)
SELECT c_custkey, c_mktsegment, l.risk IS NOT NULL AS escalated, coalesce(l.risk, 0) AS risk FROM customer LEFT JOIN l ON c_custkey = o_custkey""",
}
