"""Rankings and their evaluation, with ties grouped, from one row per distinct score.

Ratios without a denominator (no positives, no negatives, one row) are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.sources.shared import stored


def running(rows: DataFrame, by: str, *values: str, descending: bool = False) -> DataFrame:
    """rows (one for each value of `by`) with the running total _to_<value> of each of `values` in the order of `by`.

    Rows are range-partitioned and summed inside partitions; the offsets come from one row a partition, so no task sees all rows.
    """
    order = F.col(by).desc() if descending else F.col(by).asc()
    ranged = stored(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_part").agg(*(F.sum(v).alias(f"_sum_{v}") for v in values))
    offsets = sums.select("_part", *(F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_before_{v}") for v in values))
    local = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({f"_to_{v}": F.sum(v).over(local) for v in values}).join(F.broadcast(offsets), "_part")
    return summed.withColumns({f"_to_{v}": F.col(f"_to_{v}") + F.col(f"_before_{v}") for v in values}).drop("_part", *(f"_before_{v}" for v in values))


def curve(scored: DataFrame, label: str = "label", score: str = "score", *by: str) -> DataFrame:
    """One row for each distinct score (of each `by`): positives and rows at it, and cumulative ones from the best score down."""
    at = scored.groupBy(*by, score).agg(F.sum(F.col(label).cast("bigint")).alias("tp_at"), F.count("*").alias("n_at"))
    if by:
        down, whole = Window.partitionBy(*by).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
        return at.withColumns({"tp": F.sum("tp_at").over(down), "n": F.sum("n_at").over(down), "positives": F.sum("tp_at").over(whole), "rows": F.sum("n_at").over(whole)})
    summed = running(at, score, "tp_at", "n_at", descending=True).withColumnsRenamed({"_to_tp_at": "tp", "_to_n_at": "n"})
    return summed.join(F.broadcast(scored.agg(F.sum(F.col(label).cast("bigint")).alias("positives"), F.count("*").alias("rows"))))


def roc(scored: DataFrame, *by: str) -> DataFrame:
    """M1: (score, fpr, tpr)"""
    c = curve(scored, "label", "score", *by)
    return c.select(*by, F.col("score").alias("threshold"), F.try_divide(F.col("n") - F.col("tp"), F.col("rows") - F.col("positives")).alias("fpr"), F.try_divide("tp", "positives").alias("tpr"))


def precision_recall(scored: DataFrame, *by: str) -> DataFrame:
    """M3: (threshold, precision, recall)"""
    c = curve(scored, "label", "score", *by)
    return c.select(*by, F.col("score").alias("threshold"), F.try_divide("tp", "n").alias("precision"), F.try_divide("tp", "positives").alias("recall"))


def average_precision(scored: DataFrame, *by: str) -> DataFrame:
    """M2: the sum of precision times the gain of recall, ties grouped."""
    c = curve(scored, "label", "score", *by)
    return c.groupBy(*by).agg(F.sum(F.try_divide("tp_at", "positives") * F.try_divide("tp", "n")).alias("average_precision"))


def auc(scored: DataFrame, *by: str) -> DataFrame:
    """M1: area under the ROC curve as Mann-Whitney with average ranks: each negative counts the positives above it and half of those at it."""
    c = curve(scored, "label", "score", *by)
    negatives = F.col("n_at") - F.col("tp_at")
    won = negatives * ((F.col("tp") - F.col("tp_at")) + F.col("tp_at") / 2)
    return c.groupBy(*by).agg(F.try_divide(F.sum(won), F.max(F.col("positives") * (F.col("rows") - F.col("positives")))).alias("auc"))


def confusion(scored: DataFrame, threshold: float = 0.5, *by: str) -> DataFrame:
    """M4: accuracy, precision, recall and F1 at a threshold."""
    yes, said = F.col("label") == 1, F.col("score") >= threshold
    count = lambda c: F.sum(c.cast("bigint"))
    t = scored.groupBy(*by).agg(count(yes & said).alias("tp"), count(~yes & said).alias("fp"), count(yes & ~said).alias("fn"), count(~yes & ~said).alias("tn"))
    return t.withColumns(
        {
            "accuracy": F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")),
            "precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")),
            "f1": F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
        }
    )


def average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Rows with the average rank of `value`; ranks come from one row per distinct value."""
    at = running(rows.groupBy(value).agg(F.count("*").alias("_n")), value, "_n")
    return rows.join(at.select(value, (F.col("_to__n") - F.col("_n") + (F.col("_n") + 1) / 2).alias(name)), value)


def correlations(rows: DataFrame, x: str, y: str) -> DataFrame:
    """M5: Pearson and Spearman."""
    ranked = average_ranks(average_ranks(rows, x, "_rx"), y, "_ry")
    return ranked.agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))


def best_fit(rows: DataFrame, x: str, y: str) -> DataFrame:
    """M6"""
    return rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def paired_t(rows: DataFrame, a: str, b: str) -> DataFrame:
    """M7: t of the paired differences and degrees of freedom (Q22: both come from the same rows)."""
    d = F.col(a) - F.col(b)
    return rows.agg(F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.greatest(F.count(d), F.lit(1)))).alias("t"), (F.count(d) - 1).alias("df"))


def at_k(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    """Precision and recall of the k best; ties go by the columns `ties`."""
    total = scored.agg(F.sum(F.col("label").cast("bigint")).alias("_all"))
    best = scored.orderBy(F.col("score").desc(), *ties).limit(k).agg(F.sum(F.col("label").cast("bigint")).alias("_hit"), F.count("*").alias("_k"))
    return best.join(F.broadcast(total)).select(F.try_divide("_hit", "_k").alias("precision_at_k"), F.try_divide("_hit", "_all").alias("recall_at_k"))


def share_known(predicted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """M8, Q14: predicted positives that are known, by key."""
    marked = predicted.select(key).distinct().join(known.select(key).distinct().withColumn("_known", F.lit(1)), key, "left")
    return marked.agg(F.count("*").alias("predicted"), F.count("_known").alias("known"), F.try_divide(F.count("_known"), F.count("*")).alias("share"))


def rounded(rows: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return rows.withColumns({c: F.round(F.col(c).cast("double"), places) for c in columns})


def top(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """A top-k report."""
    return rows.orderBy(*order).limit(n)


def _half_ratio(a: Column) -> Column:
    """ln(gamma(a + 1/2) / gamma(a)) for a > 0: its asymptotic series at a + 30, brought down by the recurrence."""
    up = a + 30
    series = F.log(up) / 2 - 1 / (8 * up) + 1 / (192 * F.pow(up, F.lit(3.0))) - 1 / (640 * F.pow(up, F.lit(5.0))) + 17 / (14336 * F.pow(up, F.lit(7.0)))
    return series + F.aggregate(F.sequence(F.lit(0), F.lit(29)), F.lit(0.0), lambda s, i: s + F.log((a + i) / (a + i + 0.5)))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function by Lentz's method; as many terms as arguments of this size need."""
    tiny = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)
    terms = F.sequence(F.lit(1), (F.lit(60) + 4 * F.sqrt(F.greatest(a, b))).cast("int"))
    first = 1 / tiny(1 - (a + b) * x / (a + 1))

    def step(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for factor in (even, odd):
            c, d = tiny(1 + factor / state["c"]), 1 / tiny(1 + factor * state["d"])
            state = F.struct(c.alias("c"), d.alias("d"), (state["h"] * c * d).alias("h"))
        return state

    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(terms, start, step, lambda s: s["h"])


def student_tails(t: Column, df: Column) -> Column:
    """The probability that Student's variable of df degrees of freedom is farther from 0 than t: an incomplete beta function of df / 2 and 1 / 2."""
    t, df = t.cast("double"), df.cast("double")
    a, b, x, y = df / 2, F.lit(0.5), df / (df + t * t), t * t / (df + t * t)
    front = F.exp(a * F.log(x) + b * F.log(y) + _half_ratio(a) - F.lit(0.5723649429247001))  # ln gamma(1/2)
    inside = F.when(x < (a + 1) / (a + b + 2), front * _beta_fraction(a, b, x) / a).otherwise(1 - front * _beta_fraction(b, a, y) / b)
    return F.when((df <= 0) | df.isNull() | t.isNull(), F.lit(None)).when(y == 0, F.lit(1.0)).when(x == 0, F.lit(0.0)).otherwise(inside)


def student_quantile(level: float, df: Column, rounds: int = 40) -> Column:
    """The t beyond which, on either side, lies 1 - level of Student's distribution: Newton's method from 0, which rises to it without overshooting."""
    df = df.cast("double")
    log_peak = _half_ratio(df / 2) - F.log(df * F.lit(3.141592653589793)) / 2
    density = lambda t: F.exp(log_peak - (df + 1) / 2 * F.log1p(t * t / df))
    step = lambda t, _: t + (student_tails(t, df) - F.lit(1 - level)) / (2 * density(t))
    return F.when(df > 0, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(0.0), step))


def paired_test(rows: DataFrame, a: str, b: str, level: float = 0.95, *by: str) -> DataFrame:
    """M7: mean difference of pairs, t, df, two-sided p-value and the t-interval of the mean (of each `by`), from one aggregation.

    Pairs with a null don't count. One pair, or differences that are all equal, have no t: all but the mean and df are null then.
    """
    d = F.col(a) - F.col(b)
    sums = rows.groupBy(*by).agg(F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("_sd"), F.count(d).alias("_n"))
    error = F.when((F.col("_n") > 1) & (F.col("_sd") > 0), F.col("_sd") / F.sqrt("_n"))
    found = sums.withColumns({"df": F.col("_n") - 1, "_error": error}).withColumn("t", F.col("mean_difference") / F.col("_error"))
    # the quantile depends on df alone and is found once for each
    quantiles = found.where("_error IS NOT NULL").select("df").distinct().withColumn("_q", student_quantile(level, F.col("df")))
    met = found.join(quantiles, "df", "left").withColumn("_half", F.col("_q") * F.col("_error"))
    ends = [(F.col("mean_difference") + sign * F.col("_half")).alias(name) for sign, name in ((-1, "low"), (1, "high"))]
    return met.select(*by, "mean_difference", "t", "df", student_tails(F.col("t"), F.col("df")).alias("p_value"), *ends)
