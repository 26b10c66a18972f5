"""The two published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairspan.operators.joins import join_spi_info
from pairspan.operators.sets import union_many
from pairspan.operators.stats import accuracy_summary, most_discriminative_pair, p_bonferroni, p_empirical, p_values, significant


def accuracy_table(acc: DataFrame, nul: DataFrame, acc_all: DataFrame, nul_all: DataFrame, info: DataFrame) -> DataFrame:
    """One row per statistic and one for all together: accuracy %, corrected p, significance."""
    keys = ["problem"]
    each = join_spi_info(p_values(acc, nul, keys), info)
    whole = significant(p_bonferroni(p_empirical(accuracy_summary(acc_all, keys), nul_all, keys), keys)).withColumn("spi", F.lit("All"))
    both = union_many([whole, each])
    pct = (100 * F.col("mean_accuracy")).alias("accuracy_pct")
    return both.select("problem", "spi", pct, "p_bonferroni", "significant", "category", "module")


def violin_table(problems: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """Values of the most class-separating node pair of one chosen statistic per problem."""
    parts = []
    for spi, (problem, fact) in problems.items():
        top = most_discriminative_pair(fact.where(F.col("spi") == spi)).withColumn("problem", F.lit(problem))
        parts.append(top.select("problem", "grp", "sample_id", "spi", "node_from", "node_to", "value"))
    return union_many(parts)
