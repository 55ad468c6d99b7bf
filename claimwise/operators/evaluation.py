"""Model evaluation operators.

Threshold scans read the scored table once and never replicate it per threshold:
an aggregate counts the rows between neighbouring thresholds (one row a bin), and
a second one over those few bins adds them up for every threshold; the result is
unpivoted with ``stack``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import contracts as K
from ..functions import numeric as N

# FIXED VALUES — scan grids generated by the published rules
FRAUD_THRESHOLDS = [float(x) for x in np.linspace(0.10, 0.90, 33)]
DELAY_THRESHOLDS = [float(x) for x in np.arange(0.30, 0.81, 0.02)]


def _safe(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def confusion_scan(df: DataFrame, label: str, prob: str, thresholds: list[float]) -> DataFrame:
    """M10 for many thresholds at once: tp, fp, tn, fn, flagged Σp per
    threshold plus the derived precision / recall / F1 / specificity /
    accuracy (zero when undefined)."""
    y, p, grid = F.col(label) == 1, F.col(prob), sorted(set(thresholds))
    # a row's bin: the number of thresholds that it reaches (a null score reaches and misses none)
    place = sum((F.when(p >= F.lit(t), 1).otherwise(0) for t in grid), F.lit(0))
    bins = df.where(F.col(label).isNotNull()).groupBy(F.when(p.isNotNull(), place).alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"), F.sum(p).alias("p"))
    aggs = [F.coalesce(F.sum("rows"), F.lit(0)).alias("n")]
    for i, t in enumerate(thresholds):
        hit, total = F.col("bin") > F.lit(grid.index(t)), lambda c, v: F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0))
        aggs += [total(hit, "pos").alias(f"tp{i}"), total(hit, "neg").alias(f"fp{i}"), total(~hit, "neg").alias(f"tn{i}"),
                 total(~hit, "pos").alias(f"fn{i}"), F.coalesce(F.sum(F.when(hit, F.col("p"))), F.lit(0.0)).alias(f"sp{i}")]
    wide = bins.agg(*aggs)
    rows = ", ".join(f"{t!r}D, tp{i}, fp{i}, tn{i}, fn{i}, sp{i}" for i, t in enumerate(thresholds))
    long = wide.select("n", F.expr(f"stack({len(thresholds)}, {rows}) as (threshold, tp, fp, tn, fn, flagged_p)"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    long = long.withColumns({
        "precision": _safe(tp, tp + fp), "recall": _safe(tp, tp + fn),
        "specificity": _safe(tn, tn + fp), "accuracy": _safe(tp + tn, F.col("n")),
    })
    return long.withColumn("f1_score", _safe(2 * F.col("precision") * F.col("recall"),
                                             F.col("precision") + F.col("recall")))


def fraud_business_scan(df: DataFrame, label: str = "est_frauduleux_claim", prob: str = "fraud_probability",
                        amount: str = "montant_indemnisation_claim",
                        prevented_ratio: float = K.PREVENTED_LOSS_RATIO) -> DataFrame:
    """Business value per threshold — flagged cases, effort hours
    (1.5 + 6p each), review cost, prevented / residual loss at the mean
    fraud amount, net value, queue rate."""
    s = confusion_scan(df, label, prob, FRAUD_THRESHOLDS)
    avg_amt = df.where(F.col(label) == 1).agg(F.coalesce(F.avg(amount), F.lit(0.0)).alias("avg_fraud_amount"))
    s = s.crossJoin(F.broadcast(avg_amt))  # one-row side
    flagged = F.col("tp") + F.col("fp")
    hours = F.lit(K.BASE_INVESTIGATION_HOURS) * flagged + \
        F.lit(K.MAX_INVESTIGATION_HOURS - K.BASE_INVESTIGATION_HOURS) * F.col("flagged_p")
    s = s.withColumns({
        "flagged_count": flagged,
        "investigation_rate": _safe(flagged, F.col("n")),
        "estimated_investigation_hours": hours,
        "review_cost": hours * K.AGENT_HOURLY_RATE,
        "prevented_loss": F.col("tp") * F.col("avg_fraud_amount") * prevented_ratio,
        "residual_loss": F.col("fn") * F.col("avg_fraud_amount"),
    })
    return s.withColumn("net_value", F.col("prevented_loss") - F.col("review_cost"))


def operating_points(scan: DataFrame) -> DataFrame:
    """Precision-first (precision ≥ .40, recall ≥ .30, queue ≤ .20; best
    by precision, net value, F1) and balanced (recall ≥ .70, precision ≥ .20;
    best by net value, F1), each falling back to every threshold; ties go to
    the lowest threshold (first in scan order)."""
    pf = (F.col("precision") >= K.FRAUD_MIN_PRECISION) & (F.col("recall") >= K.FRAUD_MIN_RECALL) \
        & (F.col("investigation_rate") <= K.FRAUD_MAX_INVESTIGATION_RATE)
    bal = (F.col("recall") >= K.FRAUD_BALANCED_MIN_RECALL) & (F.col("precision") >= K.FRAUD_BALANCED_MIN_PRECISION)
    row = F.struct("threshold", "precision", "recall", "f1_score", "net_value", "investigation_rate")
    neg_t = -F.col("threshold")
    a = scan.agg(
        F.max_by(F.when(pf, row), F.when(pf, F.struct("precision", "net_value", "f1_score", neg_t))).alias("pf"),
        F.max_by(row, F.struct("precision", "net_value", "f1_score", neg_t)).alias("pf_all"),
        F.max_by(F.when(bal, row), F.when(bal, F.struct("net_value", "f1_score", neg_t))).alias("bal"),
        F.max_by(row, F.struct("net_value", "f1_score", neg_t)).alias("bal_all"),
    )
    pick = lambda name, x, y: F.struct(F.lit(name).alias("operating_point"),
                                       F.col(x).isNull().alias("used_fallback"),
                                       F.coalesce(F.col(x), F.col(y)).alias("p"))
    ex = a.select(F.explode(F.array(pick("precision_first", "pf", "pf_all"),
                                    pick("balanced", "bal", "bal_all"))).alias("o"))
    return ex.select("o.operating_point", "o.used_fallback", "o.p.*")


def quality_threshold(scan: DataFrame) -> DataFrame:
    """Score .45·precision + .40·accuracy + .15·recall over thresholds
    with recall ≥ .20; first (lowest) threshold among equal scores.  When no
    threshold clears the floor: threshold 0.5 with null measures."""
    s = scan.where(F.col("recall") >= K.DELAY_SCAN_RECALL_FLOOR).withColumn(
        "score", 0.45 * F.col("precision") + 0.40 * F.col("accuracy") + 0.15 * F.col("recall"))
    best = s.agg(F.max_by(F.struct("threshold", "score", "precision", "recall", "accuracy"),
                          F.struct("score", -F.col("threshold"))).alias("b"))
    return best.select(F.coalesce("b.threshold", F.lit(0.5)).alias("threshold"), "b.score", "b.precision", "b.recall", "b.accuracy")


def roc_pr_auc(df: DataFrame, label: str, prob: str) -> DataFrame:
    """Exact ROC-AUC (Mann–Whitney with ties counted ½) and average
    precision.  Scores are grouped to distinct values first (partial
    aggregate); the running sums over distinct scores are a distributed
    prefix sum (``operators/prefix.py``), not a global window."""
    from .prefix import running_sums
    g = df.where(F.col(label).isNotNull()).groupBy(F.col(prob).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    tot = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("Nn"))
    g = running_sums(g, "s", ["pos", "neg"]).crossJoin(F.broadcast(tot))
    g = g.withColumns({
        "neg_below": F.col("cum_neg") - F.col("neg"),
        "tp_at": F.col("P") - F.col("cum_pos") + F.col("pos"),
        "fp_at": F.col("Nn") - F.col("cum_neg") + F.col("neg"),
    })
    return g.agg(
        (F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))) / (F.first("P") * F.first("Nn"))).alias("roc_auc"),
        F.sum(F.col("pos") / F.col("P") * (F.col("tp_at") / (F.col("tp_at") + F.col("fp_at")))).alias("average_precision"),
        F.first("P").alias("positives"), F.first("Nn").alias("negatives"))


def regression_metrics(df: DataFrame, actual: str, pred: str) -> DataFrame:
    """MAE, RMSE, R² (1 − SSE/SST, not regr_r2) and median absolute error, and
    AUC, precision and accuracy of the prediction as a sign that the actual value lies
    above its median (F5); precision is 0 when nothing is predicted above it."""
    from . import stats
    d = df.where(F.col(actual).isNotNull() & F.col(pred).isNotNull())
    e = F.col(pred) - F.col(actual)
    one = d.agg(F.avg(actual).alias("_my"))
    q = stats.quantile_row(d, {"ae": (F.abs(e), [0.5]), "y": (F.col(actual), [0.5])}).select(
        F.col(stats.QCOL.format("ae"))[0].alias("median_ae"), F.col(stats.QCOL.format("y"))[0].alias("_mid"))
    x = d.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(q.select("_mid")))
    high, said = F.col(actual) > F.col("_mid"), F.col(pred) > F.col("_mid")
    auc = roc_pr_auc(x.withColumn("_high", high.cast("int")), "_high", pred).select(F.col("roc_auc").alias("auc"))
    return x.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / F.sum((F.col(actual) - F.col("_my")) ** 2)).alias("r2"),
        F.coalesce(F.try_divide(F.count_if(high & said), F.count_if(said)), F.lit(0.0)).alias("precision"),
        (F.count_if(high == said) / F.count(F.lit(1))).alias("accuracy")).crossJoin(F.broadcast(q.select("median_ae"))).crossJoin(F.broadcast(auc))


def forecast_metrics(actual_vs_pred: DataFrame, key: str = "kpi") -> DataFrame:
    """MAE, MAPE (ε = 1e-9 in the denominator) and RMSE per series."""
    e = F.col("forecast") - F.col("actual")
    return actual_vs_pred.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.abs(e) / (F.abs(F.col("actual")) + 1e-9)) * 100).alias("mape_pct"),
        F.sqrt(F.avg(e * e)).alias("rmse"))


def label_profile(df: DataFrame, label: str, amount: str) -> DataFrame:
    """H15 + H16: rows, positives, positive rate %, average amount, average
    amount of positives, imbalance ratio neg / max(pos, 1)."""
    d = df.where(F.col(label).isNotNull())
    y = F.col(label) == 1
    return d.agg(F.count(F.lit(1)).alias("rows"), F.count_if(y).alias("positives"),
                 F.avg(amount).alias("_avg"), F.avg(F.when(y, F.col(amount))).alias("_avg_pos")) \
        .select("rows", "positives",
                N.np_round(F.col("positives") / F.col("rows") * 100, 2).alias("positive_rate_pct"),
                N.np_round(F.col("_avg"), 2).alias("avg_amount"),
                N.np_round(F.col("_avg_pos"), 2).alias("avg_amount_positive"),
                N.np_round((F.col("rows") - F.col("positives")) / F.greatest(F.col("positives"), F.lit(1)), 4)
                .alias("imbalance_ratio"))


def round_cols(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (stable comparisons of aggregates)."""
    from pyspark.sql.types import DoubleType
    return df.select(*[N.np_round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, DoubleType)
                       else F.col(f.name) for f in df.schema.fields])
