"""Accuracy summaries, permutation p-values, Welch's t, and the published tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairspan.functions.numeric import ratio

P_BUCKETS = 1000  # accuracies lie in [0, 1]: at most this many buckets plus one


def accuracy_summary(acc: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and n-1 standard deviation of accuracy, rounded to 9 digits so that ties are ties."""
    return acc.groupBy(*keys).agg(
        F.round(F.avg("accuracy"), 9).alias("mean_accuracy"),
        F.round(F.stddev_samp("accuracy"), 9).alias("sd_accuracy"),
    )


def pooled_null(nul: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct null accuracies with their counts and the share of the pool below each.

    Values are first reduced to counts; running sums then go over buckets (a bounded number) and
    inside buckets, never over the whole pool in one task.
    """
    counts = _null_counts(nul, keys)
    inside = Window.partitionBy(*keys, "bucket").orderBy("null_accuracy")
    before = F.sum("n").over(inside) - F.col("n")
    joined = counts.join(_bucket_base(counts, keys), [*keys, "bucket"])
    return joined.select(*keys, "null_accuracy", "n", (F.col("base") + before).alias("n_below"), "n_pool")


def _null_counts(nul: DataFrame, keys: list[str]) -> DataFrame:
    value = F.round("null_accuracy", 9)
    counts = nul.select(*keys, value.alias("null_accuracy")).groupBy(*keys, "null_accuracy").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("bucket", _bucket(F.col("null_accuracy")))


def _bucket(col: Column) -> Column:
    return F.floor(col * P_BUCKETS)


def _bucket_base(counts: DataFrame, keys: list[str]) -> DataFrame:
    sums = counts.groupBy(*keys, "bucket").agg(F.sum("n").alias("m"))
    run = Window.partitionBy(*keys).orderBy("bucket")
    return sums.select(
        *keys, "bucket", (F.sum("m").over(run) - F.col("m")).alias("base"), F.sum("m").over(Window.partitionBy(*keys)).alias("n_pool")
    )


def p_empirical(means: DataFrame, nul: DataFrame, keys: list[str]) -> DataFrame:
    """1 - share of the pooled null strictly below the mean accuracy; may be 0.

    Each mean meets the counts of its own bucket plus one prefix sum, not the whole null.
    """
    counts = _null_counts(nul, keys)
    base = counts.groupBy(*keys, "bucket").agg(F.sum("n").alias("m"))
    cols = [f"null_{k}" for k in keys]

    def renamed(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(k).alias(c) for k, c in zip(keys, cols)], *[c for c in df.columns if c not in keys])

    # at most P_BUCKETS + 1 rows per key: the whole histogram is one small row
    packed = base.groupBy(*keys).agg(F.collect_list(F.struct("bucket", "m")).alias("hist"), F.sum("m").alias("n_pool"))
    m = means.join(packed, keys).withColumn("bucket", _bucket(F.col("mean_accuracy")))
    lower = F.expr("aggregate(filter(hist, h -> h.bucket < bucket), 0L, (s, h) -> s + h.m)")
    m = m.withColumn("n_lower", lower).drop("hist")
    near = renamed(counts.select(*keys, F.col("bucket").alias("null_bucket"), "null_accuracy", "n"))
    same = (F.col("bucket") == F.col("null_bucket")) & (F.col("null_accuracy") < F.col("mean_accuracy"))
    for k, c in zip(keys, cols):
        same = same & (F.col(k) == F.col(c))
    ids = [*means.columns, "n_pool", "n_lower"]
    hits = m.join(near, same, "left").groupBy(*ids).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_same"))
    p = 1 - (F.col("n_lower") + F.col("n_same")) / F.col("n_pool")
    return hits.select(*means.columns, p.alias("p_value"))


def p_bonferroni(pvals: DataFrame, keys: list[str]) -> DataFrame:
    """min(1, p * number of tests) per problem."""
    tests = pvals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tests"))
    out = pvals.join(tests, keys)
    return out.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col("p_value") * F.col("n_tests"))).drop("n_tests")


def significant(pvals: DataFrame, level: float = 0.05) -> DataFrame:
    return pvals.withColumn("significant", F.col("p_bonferroni") < level)


def p_values(acc: DataFrame, nul: DataFrame, keys: list[str]) -> DataFrame:
    means = accuracy_summary(acc, [*keys, "spi"])
    return significant(p_bonferroni(p_empirical(means, nul, keys), keys))


def histogram_share(pvals: DataFrame, keys: list[str], bins: int, low: float, high: float) -> DataFrame:
    """Equal-width histogram as shares of all values of ``keys``; the top edge belongs to the last bin."""
    x = F.col("mean_accuracy")
    bin_no = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).alias("bin")
    inside = pvals.where(x.between(low, high)).select(*keys, "significant", bin_no)
    counts = inside.groupBy(*keys, "significant", "bin").agg(F.count(F.lit(1)).alias("n"))
    # bounded: bins x 2 rows per key
    share = ratio(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy(*keys)))
    return counts.withColumn("share", share)


def box_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, quartiles, extremes and 1.5 IQR whiskers."""
    base = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
    )
    q1, q2, q3 = F.col("q")[0], F.col("q")[1], F.col("q")[2]
    return base.select(
        *keys, "n", "mean", "low", q1.alias("q1"), q2.alias("median"), q3.alias("q3"), "high",
        (q1 - 1.5 * (q3 - q1)).alias("fence_low"), (q3 + 1.5 * (q3 - q1)).alias("fence_high"),
    )


def whiskers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Box summary plus the most extreme values inside the fences."""
    box = box_summary(df, keys, value)
    inside = df.join(box.select(*keys, "fence_low", "fence_high"), keys)
    inside = inside.where(F.col(value).between(F.col("fence_low"), F.col("fence_high")))
    ends = inside.groupBy(*keys).agg(F.min(value).alias("whisker_low"), F.max(value).alias("whisker_high"))
    return box.join(ends, keys)


def welch_t(fact: DataFrame, keys: list[str], grp: str = "grp", value: str = "value") -> DataFrame:
    """Welch's t of every two classes per ``keys``; first class alphabetically minus second."""
    m = fact.groupBy(*keys, grp).agg(
        F.avg(value).alias("mean"), F.var_samp(value).alias("var"), F.count(value).alias("n")
    )
    a = m.select(*keys, F.col(grp).alias("grp_a"), *[F.col(c).alias(f"{c}_a") for c in ("mean", "var", "n")])
    b = m.select(*keys, F.col(grp).alias("grp_b"), *[F.col(c).alias(f"{c}_b") for c in ("mean", "var", "n")])
    se = F.sqrt(ratio(F.col("var_a"), F.col("n_a")) + ratio(F.col("var_b"), F.col("n_b")))
    t = ratio(F.col("mean_a") - F.col("mean_b"), F.when(se > 1e-12, se))
    return a.join(b, keys).where("grp_a < grp_b").select(*keys, "grp_a", "grp_b", t.alias("t_stat"))


def top_abs(df: DataFrame, by: list[str], value: str, order: list[str], digits: int = 9) -> DataFrame:
    """The row with the largest absolute value per ``by``; ties go to the first in ``order``.

    A max over a struct keeps one row per map task, where a window would sort whole groups.
    """
    rank = F.struct(F.round(-F.abs(value), digits).alias("neg"), F.struct(*[F.col(c) for c in order]).alias("pos"))
    rest = [c for c in df.columns if c not in by]
    best = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min_by(F.struct(*rest), rank).alias("best"))
    return best.select(*by, "best.*")


def most_discriminative_pair(fact: DataFrame) -> DataFrame:
    """Rows of the class pair and node pair with the largest absolute t, per statistic."""
    pairs = fact.where("node_from <> node_to")
    t = welch_t(pairs, ["spi", "node_from", "node_to"])
    top = top_abs(t, ["spi"], "t_stat", ["grp_a", "grp_b", "node_from", "node_to"])
    rows = pairs.join(top, ["spi", "node_from", "node_to"])
    return rows.where("grp = grp_a OR grp = grp_b").drop("grp_a", "grp_b")
