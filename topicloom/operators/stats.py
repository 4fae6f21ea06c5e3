"""Univariate statistics per group, in the sample definitions of statistical packages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from .ranking import median_positions, most_frequent, order_statistics, running_total, value_counts

# The percentages of the standard quantile report, as whole numbers.
QUANTILES = [100, 99, 95, 90, 75, 50, 25, 10, 5, 1, 0]


def long_values(df: DataFrame, by: Sequence[str], variables: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """by..., keep..., variable, value."""
    pairs = [F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables]
    return df.select(*by, *keep, F.inline(F.array(*pairs)))


def moments(df: DataFrame, by: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """N, sum, mean, std, variance, skewness, kurtosis, USS, CSS, CV, std error per group and variable.

    All variables are aggregated in one pass and unpivoted afterwards, so rows are not multiplied.
    Spark's skewness and kurtosis are population figures; they are converted to the sample figures.
    """
    aggs: list[Column] = []
    for v in variables:
        x = F.col(v).cast("double")
        aggs += [
            F.count(x).alias(f"{v}_n"), F.sum(x).alias(f"{v}_sum"), F.avg(x).alias(f"{v}_mean"),
            F.var_samp(x).alias(f"{v}_var"), F.skewness(x).alias(f"{v}_g1"), F.kurtosis(x).alias(f"{v}_g2"),
            F.sum(x * x).alias(f"{v}_uss"),
        ]
    wide = df.groupBy(*by).agg(*aggs)

    def block(v: str) -> Column:
        n, var, mean = F.col(f"{v}_n"), F.col(f"{v}_var"), F.col(f"{v}_mean")
        std = F.sqrt(var)
        spread = var > 0
        skew = F.when((n > 2) & spread, F.col(f"{v}_g1") * F.sqrt(n * (n - 1)) / (n - 2))
        kurt = F.when((n > 3) & spread, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col(f"{v}_g2") + 6))
        return F.struct(
            F.lit(v).alias("variable"), n.alias("n"), F.col(f"{v}_sum").alias("sum"), mean.alias("mean"),
            std.alias("std"), var.alias("variance"), skew.alias("skewness"), kurt.alias("kurtosis"),
            F.col(f"{v}_uss").alias("uss"), (var * (n - 1)).alias("css"),
            F.when(mean != 0, std / mean * 100).alias("cv"), (std / F.sqrt(n)).alias("std_error"),
        )

    return wide.select(*by, F.inline(F.array(*[block(v) for v in variables])))


def quantiles(df: DataFrame, by: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Quantiles by averaging at jumps of the distribution function, with range, IQR and mode.

    n*p = j+g: g = 0 gives the mean of the j-th and the next value, otherwise the next value. Exact
    integer arithmetic on whole percentages. The mode is the smallest of the most frequent values.
    """
    rows = long_values(df, by, variables)
    group = [*by, "variable"]
    n = F.col("_n")
    picks = {}
    for q in QUANTILES:
        j = F.floor(n * q / 100)
        exact = (n * q) % 100 == 0
        lo = F.greatest(F.when(exact, j).otherwise(j + 1), F.lit(1))
        hi = F.least(j + 1, n)
        picks[f"p{q}"] = (lo, hi)
    counts = materialize(value_counts(rows, group, "value"), "counts")
    q = order_statistics(counts, group, "value", picks)
    q = q.withColumn("range", F.col("p100") - F.col("p0")).withColumn("iqr", F.col("p75") - F.col("p25"))
    modes = most_frequent(counts, group, "value")
    cond = F.lit(True)
    for i, g in enumerate(group):
        modes = modes.withColumnRenamed(g, f"_m{i}")
    for i, g in enumerate(group):
        cond = cond & q[g].eqNullSafe(modes[f"_m{i}"])
    return q.join(modes, cond).select(*q.columns, "mode")


def extremes(df: DataFrame, by: Sequence[str], variables: Sequence[str], obs: str, k: int = 5) -> DataFrame:
    """The k lowest and k highest values with their observation number.

    `row_number() <= k` lets Spark keep k rows per group in every task before the shuffle, so a hot
    group never travels whole.
    """
    rows = long_values(df, by, variables, [obs]).filter(F.col("value").isNotNull())
    low = Window.partitionBy(*by, "variable").orderBy(F.col("value"), F.col(obs))
    high = Window.partitionBy(*by, "variable").orderBy(F.col("value").desc(), F.col(obs).desc())

    def side(name: str, window: Window) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= k).withColumn("side", F.lit(name))

    return side("low", low).unionByName(side("high", high)).select(*by, "variable", "side", "place", "value", obs)


def location_tests(df: DataFrame, by: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Student t, sign M and signed rank S against 0.

    Ranks of |x| use average ranks of ties, from counts of distinct |x|, so equal values collapse
    before the sort.
    """
    group = [*by, "variable"]
    rows = long_values(df, by, variables).filter(F.col("value").isNotNull())
    student = rows.groupBy(*group).agg(
        F.count("*").alias("n"),
        (F.avg("value") / (F.stddev_samp("value") / F.sqrt(F.count("*")))).alias("student_t"),
        ((F.count_if(F.col("value") > 0) - F.count_if(F.col("value") < 0)) / 2).alias("sign_m"),
    )
    ties = (
        rows.filter(F.col("value") != 0)
        .groupBy(*group, F.abs("value").alias("size"))
        .agg(F.count("*").alias("n_ties"), F.count_if(F.col("value") > 0).alias("n_pos"))
    )
    ranked = running_total(ties, [F.col("size")], group, "n_ties", "_upto")
    mean_rank = F.col("_upto") - (F.col("n_ties") - 1) / 2
    nt = F.max("_upto")
    signed = ranked.groupBy(*group).agg((F.sum(F.col("n_pos") * mean_rank) - nt * (nt + 1) / 4).alias("signed_rank_s"))
    for i, g in enumerate(group):
        signed = signed.withColumnRenamed(g, f"_m{i}")
    cond = F.lit(True)
    for i, g in enumerate(group):
        cond = cond & student[g].eqNullSafe(signed[f"_m{i}"])
    return student.join(signed, cond, "left").select(
        *group, "n", "student_t", "sign_m", F.coalesce("signed_rank_s", F.lit(0.0)).alias("signed_rank_s")
    )


def missing_values(df: DataFrame, by: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Missing count and percent of all observations."""
    wide = df.groupBy(*by).agg(
        F.count("*").alias("n_obs"), *[F.count_if(F.col(v).isNull()).alias(f"{v}_missing") for v in variables]
    )
    pairs = [F.struct(F.lit(v).alias("variable"), F.col(f"{v}_missing").alias("n_missing")) for v in variables]
    return wide.select(*by, "n_obs", F.inline(F.array(*pairs))).withColumn(
        "pct_missing", F.col("n_missing") * 100 / F.col("n_obs")
    )


def crosstab(df: DataFrame, by: Sequence[str], row: str, col: str, strata: Sequence[str] = ()) -> DataFrame:
    """Two-way table per BY group and stratum: frequency, percent, row and column percent, and totals.

    Missing levels are left out. After counting, one shuffle by table serves all totals: the windows run over
    cells, whose number per table is the number of level pairs. The first cell of a row, column or table also
    emits its total.
    """
    group = [*by, *strata]
    present = df
    for c in [*strata, row, col]:
        present = present.filter(F.col(c).isNotNull())
    cells = present.groupBy(*group, row, col).agg(F.count("*").alias("_cell"))
    in_table, in_row, in_col = (Window.partitionBy(*group, *k) for k in ([], [row], [col]))
    sums = cells.repartition(*group).select(
        *group, row, col, "_cell",
        F.sum("_cell").over(in_table).alias("_all"), F.sum("_cell").over(in_row).alias("_in_row"), F.sum("_cell").over(in_col).alias("_in_col"),
        (F.min(col).over(in_row) == F.col(col)).alias("_opens_row"), (F.min(row).over(in_col) == F.col(row)).alias("_opens_col"),
        (F.min(row).over(in_table) == F.col(row)).alias("_first_row"),
    )
    types = dict(cells.dtypes)

    def line(kind: str, size: str, with_row: bool, with_col: bool) -> Column:
        share = lambda base: F.col(size) * 100 / F.col(base) if kind == "cell" else F.lit(None).cast("double")
        return F.struct(
            (F.col(row) if with_row else F.lit(None).cast(types[row])).alias(row),
            (F.col(col) if with_col else F.lit(None).cast(types[col])).alias(col),
            F.lit(kind).alias("kind"),
            F.col(size).alias("frequency"),
            (F.col(size) * 100 / F.col("_all")).alias("percent"),
            share("_in_row").alias("row_pct"),
            share("_in_col").alias("col_pct"),
        )

    lines = F.array(
        line("cell", "_cell", True, True),
        F.when(F.col("_opens_row"), line("row_total", "_in_row", True, False)),
        F.when(F.col("_opens_col"), line("col_total", "_in_col", False, True)),
        F.when(F.col("_opens_row") & F.col("_first_row"), line("total", "_all", False, False)),
    )
    return sums.select(*group, F.explode(lines).alias("_l")).filter(F.col("_l").isNotNull()).select(*group, "_l.*")


def score_summary(df: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """Mean, mode (smallest of the most frequent), median, population standard deviation."""
    base = df.groupBy(*by).agg(F.avg(score).alias("score_mean"), F.stddev_pop(score).alias("score_std"))
    counts = materialize(value_counts(df, by, score), "counts")
    modes = most_frequent(counts, by, score, "score_mode")
    medians = order_statistics(counts, by, score, {"score_median": median_positions()})
    return base.join(modes, list(by)).join(medians, list(by)).select(*by, "score_mean", "score_mode", "score_median", "score_std")
