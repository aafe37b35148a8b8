"""Binary classification metrics from (label, score) rows, for one model or many at once.

Ranks and running sums run over distinct scores, pre-aggregated and sorted in ranges by group and score, not over rows; the functions that
need them write a scratch table when they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.running import number_in_order, running_sums


def _by_score(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    return df.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))


def _from_above(s: DataFrame, by: list[str]) -> DataFrame:
    """Adds tp and fp (p and n of this score and all above), and pos and neg of the group. Scores are summed in ranges, those of one group too; writes them down when called."""
    return running_sums(s, [F.desc("score")], {"tp": F.col("p"), "fp": F.col("n")}, by, {"pos": "tp", "neg": "fp"})


def ranking_metrics(df: DataFrame, by: list[str] | None = None, score: str = "score", label: str = "label") -> DataFrame:
    """auroc (ties count half) and average precision; null where a class is absent."""
    by = by or []
    s = _by_score(df, by, score, label)
    s = _from_above(s, by)
    area = F.sum(F.col("p") * (F.col("neg") - F.col("fp") + F.col("n") / F.lit(2.0)))
    both = (F.max("pos") > 0) & (F.max("neg") > 0)
    return s.groupBy(*by).agg(
        F.when(both, area / (F.max("pos") * F.max("neg"))).alias("auroc"),
        F.when(F.max("pos") > 0, F.sum(F.col("p") / F.when(F.col("pos") > 0, F.col("pos")) * (F.col("tp") / (F.col("tp") + F.col("fp"))))).alias("average_precision"),
    )


def _rate(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(1)).otherwise(b))


def from_confusion(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Metrics of a confusion table; a zero denominator gives 0."""
    sens, spec, prec = _rate(tp, tp + fn), _rate(tn, tn + fp), _rate(tp, tp + fp)
    d = [x.cast("double") for x in (tp + fp, tp + fn, tn + fp, tn + fn)]
    root = F.sqrt(d[0] * d[1] * d[2] * d[3])
    return {
        "accuracy": _rate(tp + tn, tp + fp + tn + fn), "balanced_accuracy": (sens + spec) / 2, "precision": prec, "recall": sens, "specificity": spec,
        "f1": _rate(2 * tp, 2 * tp + fp + fn), "mcc": _rate(tp.cast("double") * tn - fp.cast("double") * fn, root),
    }


def metrics_at(df: DataFrame, threshold: float | Column, by: list[str] | None = None, score: str = "score", label: str = "label") -> DataFrame:
    """Confusion table and metrics of score >= threshold."""
    by = by or []
    called, is_pos = F.col(score) >= threshold, F.col(label) == 1
    c = df.groupBy(*by).agg(F.count_if(called & is_pos).alias("tp"), F.count_if(called & ~is_pos).alias("fp"), F.count_if(~called & ~is_pos).alias("tn"), F.count_if(~called & is_pos).alias("fn"))
    return c.select("*", *[v.alias(k) for k, v in from_confusion(*(F.col(x) for x in ("tp", "fp", "tn", "fn"))).items()])


def select_threshold(df: DataFrame, metric: str = "mcc", by: list[str] | None = None, score: str = "score", label: str = "label", extra: tuple[float, ...] = (0.0, 0.5, 1.0)) -> DataFrame:
    """Best threshold among distinct scores (clipped to 0..1) and the extra ones; of equal metrics the lowest.

    One pass of running sums over distinct scores in place of a sweep.
    """
    by = by or []
    clipped = df.withColumn(score, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score))))
    s = _by_score(clipped, by, score, label)
    groups = s.select(*by).distinct() if by else None
    more = df.sparkSession.createDataFrame([(float(x), 0, 0) for x in extra], "score double, p long, n long")
    more = groups.crossJoin(F.broadcast(more)) if by else more
    s = s.unionByName(more).groupBy(*by, "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    s = _from_above(s, by)
    value = from_confusion(F.col("tp"), F.col("fp"), F.col("neg") - F.col("fp"), F.col("pos") - F.col("tp"))[metric]
    # Rounding keeps equal metrics equal whatever the order of the arithmetic.
    best = F.max_by(F.struct("score", "value"), F.struct(F.round("value", 12), -F.col("score")))
    return s.withColumn("value", value).groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.score").alias("threshold"), F.col("b.value").alias(metric))


def calibration_error(df: DataFrame, bins: int = 15, by: list[str] | None = None, score: str = "score", label: str = "label") -> DataFrame:
    """Expected calibration error of max(p, 1-p) over equal bins (lo, hi], the first closed."""
    by = by or []
    p = F.col(score)
    conf = F.greatest(p, 1 - p)
    right = ((p >= 0.5).cast("int") == F.col(label)).cast("double")
    rows = df.select(*by, conf.alias("c"), right.alias("r")).withColumn("bin", F.greatest(F.ceil(F.col("c") * bins) - 1, F.lit(0)))
    b = rows.groupBy(*by, "bin").agg(F.count("*").alias("k"), F.avg("c").alias("c"), F.avg("r").alias("r"))
    return b.groupBy(*by).agg((F.sum(F.col("k") * F.abs(F.col("c") - F.col("r"))) / F.sum("k")).alias("ece"))


COVERAGES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0)


def selective_accuracy(df: DataFrame, coverages: tuple[float, ...] = COVERAGES, id_col: str = "id", uncertainty: str = "uncertainty", score: str = "score", label: str = "label") -> DataFrame:
    """Accuracy among the most certain share of rows, k = max(1, n * share rounded half to even), ties by id.

    Uncertainties are cut at exact ranks found from running sums over distinct values; neither these nor rows of one value are sorted in one task.
    """
    right = ((F.col(score) >= 0.5).cast("int") == F.col(label)).cast("long")
    rows = df.select(F.col(uncertainty).alias("u"), F.col(id_col).alias("id"), right.alias("r"))
    per = rows.groupBy("u").agg(F.count("*").alias("k"), F.sum("r").alias("r"))
    per = running_sums(per, ["u"], {"upto": F.col("k"), "right": F.col("r")})
    wanted = df.sparkSession.createDataFrame([(float(c),) for c in coverages], "coverage double")
    cut = wanted.crossJoin(per.agg(F.max("upto").alias("n"))).withColumn("k_cut", F.greatest(F.lit(1), F.expr("bround(n * coverage)")).cast("long"))
    at = per.join(F.broadcast(cut), (F.col("upto") >= F.col("k_cut")) & (F.col("upto") - F.col("k") < F.col("k_cut")))
    # Within the value at the cut, the first by id.
    need = at.select("coverage", "n", "k_cut", F.col("u").alias("cu"), (F.col("k_cut") - F.col("upto") + F.col("k")).alias("take"), (F.col("right") - F.col("r")).alias("before"))
    tied = number_in_order(rows.join(F.broadcast(need), F.col("u") == F.col("cu")), ["coverage", "id"], "i")
    first = tied.groupBy("coverage").agg(F.min("i").alias("first"))
    tied = tied.join(F.broadcast(first), "coverage").where("i - first < take")
    return tied.groupBy("coverage", "k_cut").agg(((F.max("before") + F.sum("r")) / F.col("k_cut")).alias("accuracy")).select("coverage", F.col("k_cut").alias("k"), "accuracy")


def uncertainty_by_outcome(df: DataFrame, uncertainty: str = "uncertainty", score: str = "score", label: str = "label") -> DataFrame:
    """Mean uncertainty of right and of wrong calls; 0 if there are none."""
    right = (F.col(score) >= 0.5).cast("int") == F.col(label)
    return df.agg(F.coalesce(F.avg(F.when(right, F.col(uncertainty))), F.lit(0.0)).alias("right"), F.coalesce(F.avg(F.when(~right, F.col(uncertainty))), F.lit(0.0)).alias("wrong"))


def class_weights(df: DataFrame, label: str = "label", scale: str = "ratio") -> DataFrame:
    """ratio: [1, n0 / max(1, n1)]; share: [n1 / n, n0 / n]."""
    n0, n1 = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    if scale == "ratio":
        return df.agg(F.lit(1.0).alias("w0"), (n0 / F.greatest(F.lit(1), n1)).alias("w1"))
    return df.agg(_rate(n1, n0 + n1).alias("w0"), _rate(n0, n0 + n1).alias("w1"))


def split_report(df: DataFrame, threshold: float | Column, by: str = "split", score: str = "score", label: str = "label") -> DataFrame:
    """Per split: rows, positives, ranking metrics, and metrics at 0.5 and at the threshold."""
    sizes = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))
    named = lambda t, suffix: metrics_at(df, t, [by], score, label).select(by, *[F.col(c).alias(f"{c}_{suffix}") for c in ("accuracy", "f1", "mcc")])
    return sizes.join(ranking_metrics(df, [by], score, label), by).join(named(0.5, "half"), by).join(named(threshold, "best"), by)


def prediction_table(df: DataFrame, threshold: float | Column, keep: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """A row for each prediction: the columns in keep, label, score, pred_half (score >= 0.5) and pred_best (at the chosen threshold)."""
    called = lambda t: (F.col(score) >= t).cast("int")
    return df.select(*keep, F.col(label).alias("label"), F.col(score).alias("score"), called(0.5).alias("pred_half"), called(threshold).alias("pred_best"))
