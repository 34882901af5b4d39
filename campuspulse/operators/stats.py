"""Correlation, significance and insight tables.

Student frames come in already materialised: these operators read them more than
once, and their size is the number of students, not of events.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campuspulse.functions.exprs import PASS_MARK, direction, safe_ratio
from campuspulse.functions.tails import chi2_pvalue, normal_pvalue, r_to_t, rank_sum_pvalue, t_pvalue, two_by_two_pvalue
from campuspulse.operators.ranks import attach_row, percentiles, prefix_totals, value_counts


def guarded_r(covar: Column, sx: Column, sy: Column) -> Column:
    """Pearson r, null without spread (a bare ``corr`` fails on constants)."""
    return F.when((sx > 0) & (sy > 0), F.try_divide(covar, sx * sy))


def correlations(df: DataFrame, features: list[str], target: str, by: list[str], min_n: int = 5) -> DataFrame:
    """Pearson r of every feature with the target per group: (by, feature, n, r).

    All moments come from one wide aggregate, so rows are not multiplied by the
    number of features.
    """
    y = F.col(target).cast("double")
    aggs, rows = [], []
    for f in features:
        x = F.col(f).cast("double")
        both = x.isNotNull() & y.isNotNull()
        aggs += [
            F.count_if(both).alias(f"_n_{f}"),
            F.covar_pop(x, y).alias(f"_c_{f}"),
            F.stddev_pop(F.when(both, x)).alias(f"_x_{f}"),
            F.stddev_pop(F.when(both, y)).alias(f"_y_{f}"),
        ]
        rows.append(F.struct(
            F.lit(f).alias("feature"), F.col(f"_n_{f}").alias("n"),
            guarded_r(F.col(f"_c_{f}"), F.col(f"_x_{f}"), F.col(f"_y_{f}")).alias("r"),
        ))
    wide = df.groupBy(*by).agg(*aggs)
    return wide.select(*by, F.inline(F.array(*rows))).where((F.col("n") >= min_n) & F.col("r").isNotNull())


def to_long(df: DataFrame, keep: list[str], features: list[str]) -> DataFrame:
    """(keep, feature, value) rows."""
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keep, F.inline(rows))


def spearman(df: DataFrame, features: list[str], target: str, by: list[str], min_n: int = 5) -> DataFrame:
    """Spearman rho of every feature with the target per group: (by, feature, n, r).

    Rows become joint counts of (feature value, target value) first. Target ranks come from their marginal counts and are added up per
    feature value, so feature values, of which one (zero) may hold most rows, are only ever aggregated and ranked as distinct values. Ranks
    are centred before they are multiplied.
    """
    long = to_long(df, [*by, F.col(target).cast("double").alias("_y")], features)
    keys = [*by, "feature"]
    joint = long.where(F.col("value").isNotNull() & F.col("_y").isNotNull()).groupBy(*keys, "_y", "value").agg(F.count("*").alias("n"))
    centred = F.col("n_below") + F.col("n") / 2 - F.col("n_below_all") / 2
    targets = prefix_totals(value_counts(joint, keys, "_y", F.col("n")), keys, "_y", {"n": "n_below"})
    ranked = joint.join(targets.select(*keys, "_y", centred.alias("_ry")), [*keys, "_y"])
    per_value = ranked.groupBy(*keys, "value").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("_ry")).alias("_s"), F.sum(F.col("n") * F.col("_ry") ** 2).alias("_q"))
    placed = prefix_totals(per_value, keys, "value", {"n": "n_below"}).withColumn("_rx", centred)
    sums = placed.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(F.col("_rx") * F.col("_s")).alias("_xy"), F.sum(F.col("n") * F.col("_rx") ** 2).alias("_xx"), F.sum("_q").alias("_yy"))
    r = guarded_r(F.col("_xy"), F.sqrt("_xx"), F.sqrt("_yy"))
    return sums.select(*keys, "n", r.alias("r")).where((F.col("n") >= min_n) & F.col("r").isNotNull())


def with_significance(corr: DataFrame, alpha: float = 0.05) -> DataFrame:
    """p-value of r by the t distribution with n - 2 degrees of freedom."""
    return corr.withColumn(
        "p_value", t_pvalue(r_to_t(F.col("r"), F.col("n")), (F.col("n") - 2).cast("double"))
    ).withColumn("significant", F.col("p_value") < alpha)


def significant_by_t(corr: DataFrame, critical: Column) -> DataFrame:
    return corr.where(F.abs(r_to_t(F.col("r"), F.col("n"))) > critical)


def ranked(corr: DataFrame) -> DataFrame:
    """Pooled correlations by strength, with the direction of the effect."""
    return corr.withColumn("abs_r", F.abs("r")).withColumn("direction", direction(F.col("r"))).orderBy(F.desc("abs_r"), "feature")


def top_per_group(corr: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """The k strongest features per group; a group has one row per feature."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.abs("r")), "feature")
    return corr.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_feature_heatmap(corr: DataFrame, by: str = "course_id", k: int = 5) -> DataFrame:
    """Correlations of all groups over the union of each group's k strongest features."""
    union = top_per_group(corr, [by], k).select("feature").distinct()
    return corr.join(union, "feature", "left_semi")


def cross_course_mean(corr: DataFrame, min_courses: int = 2) -> DataFrame:
    """Mean r over the courses given, with course count and total n."""
    return (
        corr.groupBy("feature")
        .agg(F.avg("r").alias("avg_r"), F.count("*").alias("n_courses"), F.sum("n").alias("total_n"))
        .where(F.col("n_courses") >= min_courses)
        .withColumn("abs_avg_r", F.abs("avg_r"))
    )


def cross_course_consistency(corr: DataFrame) -> DataFrame:
    """Mean, deviation and count of r across courses; consistent when all signs agree."""
    return corr.groupBy("feature").agg(
        F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), F.count("*").alias("n_courses"),
        F.when((F.min("r") > 0) | (F.max("r") < 0), "consistent").otherwise("mixed").alias("consistency"),
    )


def compare_groups(corr: DataFrame, by: str, groups: list) -> DataFrame:
    """Feature rows with one correlation column per group."""
    return corr.groupBy("feature").agg(
        *[F.max(F.when(F.col(by) == g, F.col("r"))).alias(f"r_{g}") for g in groups]
    )


def correlation_matrix(df: DataFrame, features: list[str], method: str = "pearson") -> DataFrame:
    """(feature1, feature2, r) for i < j. Only the small matrix reaches the driver.

    Each pair uses the rows where both are present. Features without spread are left out of the matrix. Rank
    correlation takes complete columns only.
    """
    spark = df.sparkSession
    wide = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    missing = wide.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in features]).first()
    holes = [f for f in features if missing[f]]
    if holes and method != "pearson":
        raise ValueError(f"nulls in {holes}")
    full = [f for f in features if f not in holes]
    found = {}
    if len(full) > 1:
        vectors = VectorAssembler(inputCols=full, outputCol="_v").transform(wide.select(*full)).select("_v")
        matrix = Correlation.corr(vectors, "_v", method).head()[0].toArray()
        found = {(full[i], full[j]): float(matrix[i, j]) for i in range(len(full)) for j in range(i + 1, len(full))}
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    partial = [p for p in pairs if p[0] in holes or p[1] in holes]
    for at in range(0, len(partial), 100):
        part = partial[at: at + 100]
        both = [F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in part]
        row = wide.agg(*[
            guarded_r(F.covar_pop(a, b), F.stddev_pop(F.when(k, F.col(a))), F.stddev_pop(F.when(k, F.col(b)))).alias(f"_{i}")
            for i, ((a, b), k) in enumerate(zip(part, both))
        ]).first()
        found |= {p: row[i] for i, p in enumerate(part)}
    rows = [(a, b, found[a, b]) for a, b in pairs if found.get((a, b)) is not None and found[a, b] == found[a, b]]
    return spark.createDataFrame(rows, "feature1 string, feature2 string, r double")


def high_pairs(matrix: DataFrame, threshold: float = 0.7) -> DataFrame:
    return matrix.where(F.abs("r") > threshold)


def pass_fail(df: DataFrame, score: str = "final_score") -> DataFrame:
    return df.withColumn("failed", F.when(F.col(score) < PASS_MARK, 1).when(F.col(score).isNotNull(), 0))


def t_test(df: DataFrame, features: list[str]) -> DataFrame:
    """Pooled-variance t of passed against failed students per feature."""
    rows, aggs = [], []
    for f in features:
        for tag, flag in (("p", 0), ("f", 1)):
            x = F.when(F.col("failed") == flag, F.col(f).cast("double"))
            aggs += [F.count(x).alias(f"_n{tag}_{f}"), F.avg(x).alias(f"_m{tag}_{f}"), F.var_samp(x).alias(f"_v{tag}_{f}")]
        rows.append(F.struct(
            F.lit(f).alias("feature"),
            *[F.col(f"_{m}{t}_{f}").alias(f"{name}_{side}") for m, name in (("n", "n"), ("m", "mean"), ("v", "var"))
              for t, side in (("p", "passed"), ("f", "failed"))],
        ))
    long = df.agg(*aggs).select(F.inline(F.array(*rows)))
    n1, n2 = F.col("n_passed"), F.col("n_failed")
    pooled = F.try_divide((n1 - 1) * F.col("var_passed") + (n2 - 1) * F.col("var_failed"), (n1 + n2 - 2).cast("double"))
    t = F.try_divide(F.col("mean_passed") - F.col("mean_failed"), F.sqrt(pooled * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))))
    return long.select("feature", "n_passed", "n_failed", "mean_passed", "mean_failed", t.alias("t"), (n1 + n2 - 2).alias("df"))


def rank_sums(df: DataFrame, features: list[str], by: list[str] | None = None) -> DataFrame:
    """U of passed against failed per feature (and group), with the tie-corrected normal score and whether there are ties.

    Works on counts per distinct value and never ranks single rows.
    """
    keys = [*(by or []), "feature"]
    long = to_long(df.where("failed is not null"), [*(by or []), "failed"], features)
    counts = value_counts(long, keys, "value", passed=F.count_if(F.col("failed") == 0))
    placed = prefix_totals(counts, keys, "value", {"n": "n_below"})
    mid = F.col("n_below") + (F.col("n") + 1) / 2
    agg = placed.groupBy(*keys).agg(
        F.sum("passed").alias("n_passed"), F.sum(F.col("n") - F.col("passed")).alias("n_failed"),
        F.sum(F.col("passed") * mid).alias("_ranks"),
        F.sum(F.pow(F.col("n").cast("double"), F.lit(3)) - F.col("n")).alias("_ties"),
    )
    a, b = F.col("n_passed").cast("double"), F.col("n_failed").cast("double")
    n = a + b
    u = F.col("_ranks") - a * (a + 1) / 2
    sd = F.sqrt(a * b / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    z = F.try_divide(F.abs(u - a * b / 2) - 0.5, sd)
    return agg.select(*keys, "n_passed", "n_failed", u.alias("u"), F.greatest(z, F.lit(0.0)).alias("z"), (F.col("_ties") > 0).alias("tied"))


def mann_whitney(df: DataFrame, features: list[str], by: list[str] | None = None) -> DataFrame:
    return rank_sums(df, features, by).drop("tied")


EXACT_GROUP = 8


def mann_whitney_test(df: DataFrame, features: list[str], by: list[str] | None = None) -> DataFrame:
    """The same with two-sided p-values: exact where a group has at most eight members and nothing ties, else by the normal score."""
    found = rank_sums(df, features, by).where((F.col("n_passed") > 0) & (F.col("n_failed") > 0))
    small = (F.least("n_passed", "n_failed") <= EXACT_GROUP) & ~F.col("tied")
    return found.withColumn("p_value", F.when(small, rank_sum_pvalue("u", "n_passed", "n_failed")).otherwise(normal_pvalue(F.col("z")))).drop("tied")


def contingency(df: DataFrame, rows: str, columns: str) -> DataFrame:
    return df.groupBy(rows, columns).agg(F.count("*").alias("n"))


def chi_square(table: DataFrame, rows: str, columns: str) -> DataFrame:
    """Chi-square of a long contingency table; Yates' correction for 2 x 2.

    The table has one row per pair of categories and is tiny whatever the input.
    """
    r = Window.partitionBy(rows)
    c = Window.partitionBy(columns)
    total = table.agg(F.sum("n").alias("_total"), F.count_distinct(rows).alias("_r"), F.count_distinct(columns).alias("_c"))
    cells = table.withColumn("_rs", F.sum("n").over(r)).withColumn("_cs", F.sum("n").over(c))
    expected = F.col("_rs") * F.col("_cs") / F.col("_total")
    two = (F.col("_r") == 2) & (F.col("_c") == 2)
    off = F.abs(F.col("n") - expected)
    part = F.pow(F.when(two, off - F.least(F.lit(0.5), off)).otherwise(off), F.lit(2)) / expected
    # Cells absent from the long table have n = 0 and add their expected count.
    return attach_row(cells, total).withColumn("_e", expected).agg(
        (F.sum(part) + F.max("_total") - F.sum("_e")).alias("chi2"),
        F.max((F.col("_r") - 1) * (F.col("_c") - 1)).alias("dof"),
        F.max("_total").alias("n"),
    )


def with_chi2_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p_value", chi2_pvalue(F.col("chi2"), F.col("dof").cast("double")))


def with_t_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p_value", t_pvalue(F.col("t"), F.col("df").cast("double")))


# Insight catalogue (feature, description, higher is worse, share with a 20 % cut).
CATALOGUE = [
    ("weekday_morning_pct", "studying in the morning (6am-12pm)", False, True),
    ("weekday_afternoon_pct", "studying in the afternoon (12pm-6pm)", False, True),
    ("weekday_evening_pct", "studying in the evening (6pm-10pm)", False, True),
    ("weekday_night_pct", "studying in the night (10pm-6am)", False, True),
    ("session_count", "total number of study sessions", False, False),
    ("sessions_per_week", "sessions per week", False, False),
    ("session_gap_mean", "average gap between sessions (days)", True, False),
    ("session_gap_std", "irregular session timing", True, False),
    ("early_engagement_ratio", "early course engagement", False, False),
    ("engagement_velocity", "increasing engagement over time", False, False),
    ("weekly_cv", "inconsistent weekly activity", True, False),
    ("trend_reversals", "fluctuating engagement patterns", True, False),
    ("first_access_day", "late first access to course", True, False),
    ("first_module_day", "delayed start on course modules", True, False),
    ("total_page_views", "total page views", False, False),
    ("unique_active_hours", "unique active hours", False, False),
    ("activity_span_days", "days active in course", False, False),
    ("weekend_study_pct", "weekend studying", False, True),
]


def feature_impact(
    students: DataFrame, catalogue: list[tuple] | None = None, min_n: int = 50, min_group: int = 10, digits: int | None = None
) -> DataFrame:
    """High/low split of every catalogued feature with failure rates, relative risk and odds ratio.

    One pass for all features: counts per (feature, value) carry both the median
    search and the split. Gates: ``min_n`` students, ``min_group`` per side, both
    failure rates above zero.
    """
    catalogue = [c for c in (catalogue or CATALOGUE) if c[0] in students.columns]
    names = [c[0] for c in catalogue]
    long = to_long(students.where("failed is not null"), ["failed"], names)
    if digits is not None:
        long = long.withColumn("value", F.round("value", digits))
    counts = value_counts(long, ["feature"], "value", fails=F.sum("failed"))
    cut = percentiles(long, ["feature"], "value", {"median": 0.5})
    high = counts.groupBy("feature").agg(F.max("value").alias("_max"), F.sum("n").alias("n"))
    traits = F.col("feature")
    share = traits.isin(*[c[0] for c in catalogue if c[3]]) if any(c[3] for c in catalogue) else F.lit(False)
    inverse = traits.isin(*[c[0] for c in catalogue if c[2]]) if any(c[2] for c in catalogue) else F.lit(False)
    threshold = F.when(share, F.when(F.col("_max") <= 1, 0.2).otherwise(20.0)).otherwise(F.col("median"))
    above = F.col("value") > F.col("threshold")
    split = (
        counts.join(cut.join(high.select("feature", "_max"), "feature").withColumn("threshold", threshold), "feature")
        .groupBy("feature", "threshold")
        .agg(
            F.sum(F.when(above, F.col("n")).otherwise(0)).alias("high_group_n"),
            F.sum(F.when(~above, F.col("n")).otherwise(0)).alias("low_group_n"),
            F.sum(F.when(above, F.col("fails")).otherwise(0)).alias("high_failed"),
            F.sum(F.when(~above, F.col("fails")).otherwise(0)).alias("low_failed"),
        )
    )
    hi = F.try_divide(F.col("high_failed").cast("double"), F.col("high_group_n"))
    lo = F.try_divide(F.col("low_failed").cast("double"), F.col("low_group_n"))
    a, b = F.col("high_group_n") - F.col("high_failed"), F.col("high_failed")
    c, d = F.col("low_group_n") - F.col("low_failed"), F.col("low_failed")
    return (
        split.where(
            (F.col("high_group_n") + F.col("low_group_n") >= min_n)
            & (F.col("high_group_n") >= min_group) & (F.col("low_group_n") >= min_group)
            & (F.col("high_failed") > 0) & (F.col("low_failed") > 0)
        )
        .withColumn("inverse", inverse)
        .withColumn("high_fail_rate", hi)
        .withColumn("low_fail_rate", lo)
        .withColumn("relative_risk", F.when(inverse, F.try_divide(hi, lo)).otherwise(F.try_divide(lo, hi)))
        .withColumn("odds_ratio", F.try_divide((a * d).cast("double"), (b * c).cast("double")))
        .withColumn("yates_chi2", yates(a, b, c, d))
    )


def yates(a: Column, b: Column, c: Column, d: Column) -> Column:
    """2 x 2 chi-square with continuity correction, floored at zero."""
    a, b, c, d = (v.cast("double") for v in (a, b, c, d))
    n = a + b + c + d
    diff = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    return F.try_divide(n * diff * diff, (a + b) * (c + d) * (a + c) * (b + d))


def insights(impact: DataFrame, min_risk: float = 1.2) -> DataFrame:
    """Impacts worth reporting: p-value, stars of significance and a sentence.

    Fisher's exact test when a cell is below five, Yates' chi-square otherwise. The
    rows are one per feature.
    """
    a, b = F.col("high_group_n") - F.col("high_failed"), F.col("high_failed")
    c, d = F.col("low_group_n") - F.col("low_failed"), F.col("low_failed")
    spark = impact.sparkSession
    texts = spark.createDataFrame([(x[0], x[1]) for x in CATALOGUE], "feature string, description string")
    kept = impact.where(F.col("relative_risk") > min_risk).join(texts, "feature")
    p = F.col("p_value")
    worse, other = (
        F.when(F.col("inverse"), F.col("high_fail_rate")).otherwise(F.col("low_fail_rate")) * 100,
        F.when(F.col("inverse"), F.col("low_fail_rate")).otherwise(F.col("high_fail_rate")) * 100,
    )
    note = (
        F.when(p < 0.001, F.lit(" (p < 0.001)"))
        .when(p < 0.01, F.lit(" (p < 0.01)"))
        .when(p < 0.05, F.lit(" (p < 0.05)"))
        .otherwise(F.format_string(" (p = %.3f, not statistically significant)", p))
    )
    sentence = F.concat(
        F.format_string(
            "Students with %s %s have %.0f%% higher failure risk (failure rate: %.1f%% vs %.1f%%)",
            F.when(F.col("inverse"), "high").otherwise("low"), F.col("description"),
            (F.col("relative_risk") - 1) * 100, worse, other,
        ),
        note,
    )
    return (
        kept.withColumn("p_value", two_by_two_pvalue(a, b, c, d, F.col("yates_chi2")))
        .withColumn("significant", p < 0.05)
        .withColumn("insight_text", sentence)
        .orderBy(F.desc(F.abs(F.col("relative_risk") - 1)), "feature")
    )


def trend_line(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*(by or [])).agg(
        F.regr_slope(ys, xs).alias("slope"), F.regr_intercept(ys, xs).alias("intercept"), F.regr_count(ys, xs).alias("n")
    )


def density_curve(df: DataFrame, value: str, by: str, points: int = 40, bins: int = 20, reach: float = 9.0) -> DataFrame:
    """Gaussian kernel density per group on a common grid, Scott's bandwidth.

    Values are binned linearly first: each gives its two neighbouring bins, of which a bandwidth has ``bins``, weights that keep its place on average. Only
    bins meet the grid points, and only within ``reach`` bandwidths. Against the sum over all values a density is off by
    at most ``1 / (8 * bins**2)`` of the kernel's peak (0.03 percent for 20 bins), whatever the number of rows.
    """
    present = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).select(F.col(by), F.col(value).cast("double").alias("_v"))
    widths = present.groupBy(by).agg(
        F.count("*").alias("_n"), (F.stddev_samp("_v") * F.pow(F.count("*").cast("double"), F.lit(-0.2))).alias("_h")).where(F.col("_h") > 0)
    # One small map for all groups: rows meet it without a join.
    per_group = widths.agg(F.map_from_entries(F.collect_list(F.struct(by, F.struct("_n", "_h")))).alias("_groups"))
    bounds = df.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    known = attach_row(attach_row(present, bounds), per_group).withColumn("_g", F.try_element_at("_groups", F.col(by))).where("_g is not null")
    step = F.col("_g._h") / bins
    place = (F.col("_v") - F.col("_lo")) / step
    low = F.floor(place)
    part = place - low
    binned = known.select(by, F.inline(F.array(F.struct(low.alias("_bin"), (1 - part).alias("_w")), F.struct((low + 1).alias("_bin"), part.alias("_w")))))
    weights = binned.where("_w > 0").groupBy(by, "_bin").agg(F.sum("_w").alias("_w"))
    rows = attach_row(attach_row(weights, bounds), per_group).withColumn("_g", F.try_element_at("_groups", F.col(by)))
    grid = F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda i: F.struct(i.alias("i"), (F.col("_lo") + i * (F.col("_hi") - F.col("_lo")) / (points - 1)).alias("x")),
    )
    u = (F.col("_p.x") - F.col("_lo")) / F.col("_g._h") - F.col("_bin") / F.lit(float(bins))
    kernel = F.when(F.abs(u) <= reach, F.col("_w") * F.exp(-0.5 * u * u) / (F.col("_g._n") * F.col("_g._h") * F.sqrt(F.lit(2) * F.pi()))).otherwise(0.0)
    return (
        rows.withColumn("_p", F.explode(grid))
        .groupBy(by, F.col("_p.i").alias("point"))
        .agg(F.max("_p.x").alias("x"), F.sum(kernel).alias("density"))
    )


def resource_impact(views: DataFrame, scores: DataFrame, min_viewers: int = 5) -> DataFrame:
    """Score of viewers against non-viewers per resource, and the share of variance it explains.

    Non-viewers come from course totals minus viewers, so students are never paired
    with the resources they did not open.
    """
    s = F.col("score")
    totals = scores.groupBy("course_id").agg(
        F.count("*").alias("all_n"), F.sum("score").alias("all_sum"), F.avg("score").alias("all_mean"), F.var_pop("score").alias("all_var")
    )
    seen = (
        views.select("course_id", "user_id", "resource_id").distinct()
        .join(scores, ["course_id", "user_id"])
        .groupBy("course_id", "resource_id")
        .agg(F.count("*").alias("viewers"), F.sum(s).alias("seen_sum"))
    )
    n, m = F.col("viewers"), F.col("all_n") - F.col("viewers")
    mean_v, mean_o = F.try_divide(F.col("seen_sum"), n), F.try_divide(F.col("all_sum") - F.col("seen_sum"), m)
    share = F.try_divide(n.cast("double"), F.col("all_n"))
    return (
        seen.join(totals, "course_id")
        .where((n >= min_viewers) & (m > 0))
        .select(
            "course_id", "resource_id", "viewers", mean_v.alias("viewed_mean"), mean_o.alias("other_mean"),
            (mean_v - mean_o).alias("difference"),
            F.try_divide(F.pow(mean_v - mean_o, F.lit(2)) * share * (1 - share), F.col("all_var")).alias("r2"),
        )
    )


def trending_resources(events: DataFrame, scores: DataFrame | None = None, success_weight: float = 2.0) -> DataFrame:
    """Views per resource and day, optionally counting successful students more."""
    per_user = events.groupBy("user_id", F.to_date("ts").alias("day"), "resource_id").agg(F.sum("cnt").alias("views"))
    if scores is not None:
        weight = F.when(F.col("score") >= PASS_MARK, F.lit(success_weight)).otherwise(F.lit(1.0))
        per_user = per_user.join(scores.select("user_id", "score"), "user_id", "left").withColumn("_w", weight)
    else:
        per_user = per_user.withColumn("_w", F.lit(1.0))
    return per_user.groupBy("day", "resource_id").agg(
        F.sum("views").alias("views"), F.sum(F.col("views") * F.col("_w")).alias("weighted_views")
    )


def outcome_means(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean of each feature for passed and failed students, the difference in percent, and scaled profiles."""
    rows, aggs = [], []
    for f in features:
        x = F.col(f).cast("double")
        aggs += [
            F.avg(F.when(F.col("failed") == 0, x)).alias(f"_p_{f}"), F.avg(F.when(F.col("failed") == 1, x)).alias(f"_f_{f}"),
            F.max(x).alias(f"_t_{f}"),
        ]
        rows.append(F.struct(
            F.lit(f).alias("feature"), F.col(f"_p_{f}").alias("passed_mean"), F.col(f"_f_{f}").alias("failed_mean"),
            F.col(f"_t_{f}").alias("_top"),
        ))
    p, q, top = F.col("passed_mean"), F.col("failed_mean"), F.col("_top")
    return df.agg(*aggs).select(F.inline(F.array(*rows))).select(
        "feature", "passed_mean", "failed_mean", (p - q).alias("difference"),
        F.coalesce(F.try_divide((p - q) * 100, q), F.lit(0.0)).alias("diff_pct"),
        F.when(top > 0, p / F.nullif(top, F.lit(0.0))).otherwise(0.0).alias("passed_scaled"),
        F.when(top > 0, q / F.nullif(top, F.lit(0.0))).otherwise(0.0).alias("failed_scaled"),
    )


def failure_rate_by(df: DataFrame, by: str, total: bool = True) -> DataFrame:
    """Students, failures and failure rate per label, with the label's share of all students."""
    counts = df.groupBy(by).agg(
        F.count("*").alias("n_students"), F.sum("failed").alias("n_failed"), F.avg("failed").alias("failure_rate")
    )
    if not total:
        return counts
    everyone = df.agg(F.count("*").alias("_all"))
    return attach_row(counts, everyone).withColumn("share", F.col("n_students") / F.col("_all")).drop("_all")


def quantile_buckets(df: DataFrame, column: str, buckets: int = 5, name: str = "bucket") -> DataFrame:
    """Right-closed quantile buckets 1..n with exact, interpolated cut points."""
    probs = {f"_q{i}": i / buckets for i in range(1, buckets)}
    cuts = percentiles(df, [], column, probs)
    label = F.lit(1)
    for q in probs:
        label = label + F.when(F.col(column) > F.col(q), 1).otherwise(0)
    return attach_row(df.where(F.col(column).isNotNull()), cuts).withColumn(name, label).drop(*probs)


def median_split(df: DataFrame, column: str, name: str = "side") -> DataFrame:
    """'early' at or above the median, 'late' below."""
    cut = percentiles(df, [], column, {"_m": 0.5})
    return attach_row(df, cut).withColumn(name, F.when(F.col(column) >= F.col("_m"), "early").otherwise("late")).drop("_m")


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing count and percentage per column, long form."""
    wide = df.agg(F.count("*").alias("_all"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in df.columns])
    return wide.select("_all", F.inline(rows)).select(
        "column", "missing", (safe_ratio(F.col("missing"), F.col("_all")) * 100).alias("missing_pct")
    )


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per column; quartiles are exact."""
    long = to_long(df, [], columns)
    basic = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return basic.join(percentiles(long, ["feature"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}), "feature", "left")


def order_by_median(df: DataFrame, by: str, value: str) -> DataFrame:
    return percentiles(df, [by], value, {"median": 0.5}, F.floor(value)).orderBy(F.desc("median"), by)


def overall(df: DataFrame, value: str) -> DataFrame:
    """Average, best, worst and median of a column over all rows."""
    mid = percentiles(df, [], value, {"median": 0.5})
    return attach_row(df.agg(F.avg(value).alias("average"), F.max(value).alias("best"), F.min(value).alias("worst")), mid)


def leaky_vs_pure(leaky: DataFrame, pure: DataFrame, key: str = "course_id") -> DataFrame:
    """Mean r2 of two result sets over the same courses and the inflation in percent."""
    both = leaky.select(key, F.col("r2").alias("_l")).join(pure.select(key, F.col("r2").alias("_p")), key)
    return both.agg(
        F.avg("_l").alias("with_leaky"), F.avg("_p").alias("pure"), (F.avg("_l") - F.avg("_p")).alias("difference"),
        ((F.try_divide(F.avg("_l"), F.avg("_p")) - 1) * 100).alias("inflation_pct"), F.count("*").alias("n_courses"),
    )


def rank_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score, counts at or above it: the material of ROC and PR curves."""
    negative = df.withColumn("_neg", -F.col(score).cast("double"))
    counts = value_counts(negative, [], "_neg", pos=F.sum(label))
    placed = prefix_totals(counts, [], "_neg", {"n": "n_above", "pos": "pos_above"})
    return placed.select(
        (-F.col("_neg")).alias("threshold"),
        (F.col("pos_above") + F.col("pos")).alias("tp"),
        (F.col("n_above") + F.col("n") - F.col("pos_above") - F.col("pos")).alias("fp"),
        F.col("pos_above_all").alias("positives"),
        (F.col("n_above_all") - F.col("pos_above_all")).alias("negatives"),
    )


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    return rank_curve(df, score, label).select(
        "threshold", safe_ratio(F.col("tp"), F.col("positives")).alias("tpr"), safe_ratio(F.col("fp"), F.col("negatives")).alias("fpr")
    )


def pr_points(df: DataFrame, score: str, label: str) -> DataFrame:
    return rank_curve(df, score, label).select(
        "threshold", safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        safe_ratio(F.col("tp"), F.col("positives")).alias("recall"),
    )


def auc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve from mid-ranks of distinct scores."""
    by = by or []
    counts = value_counts(df.withColumn("_s", F.col(score).cast("double")), by, "_s", pos=F.sum(label))
    placed = prefix_totals(counts, by, "_s", {"n": "n_below"})
    mid = F.col("n_below") + (F.col("n") + 1) / 2
    p = F.sum("pos").cast("double")
    n = F.sum(F.col("n") - F.col("pos")).cast("double")
    return placed.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * mid) - p * (p + 1) / 2, p * n).alias("auc"))


