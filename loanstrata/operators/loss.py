"""Expected loss per loan, portfolio rollups, stress scenarios and amortization."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanstrata.functions.ordered import quantiles
from loanstrata.functions.text import clip
from loanstrata.session import attach, pin

# Scenario, factor on PD, floor of LGD.
SCENARIOS = [("base", 1.0, None), ("adverse", 1.5, 0.45), ("severe", 2.0, 0.60)]
# Plausible expected loss in percent of exposure per portfolio type.
PORTFOLIO_BANDS = {"prime": (0.5, 2.0), "near_prime": (1.5, 3.5), "subprime": (3.0, 6.0), "non_prime": (4.0, 8.0)}


def expected_loss(df: DataFrame) -> DataFrame:
    """PD x LGD x EAD with PD and LGD held in 0..1 and EAD at 0 or more."""
    held = df.withColumns({"pd": clip(F.col("pd"), 0, 1), "lgd": clip(F.col("lgd"), 0, 1),
                           "ead": clip(F.col("ead"), 0, None)})
    return held.withColumn("expected_loss", F.col("pd") * F.col("lgd") * F.col("ead"))


def loss_summary(el: DataFrame) -> DataFrame:
    """Portfolio totals, and percentiles of PD and LGD."""
    one = el.agg(
        F.count(F.lit(1)).alias("total_loans"), F.sum("expected_loss").alias("portfolio_el"),
        F.avg("expected_loss").alias("mean_el"), F.sum("ead").alias("total_ead"),
        (F.sum("expected_loss") / F.greatest(F.sum("ead"), F.lit(1.0))).alias("el_rate"),
        F.avg("pd").alias("mean_pd"), F.avg("lgd").alias("mean_lgd"), F.avg("ead").alias("mean_ead"))
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    spread = quantiles(el, ["expected_loss", "pd", "lgd"], probs).groupBy().agg(*[
        F.max(F.when(F.col("feature") == c, F.col("q")[i])).alias(name)
        for c, names in (("expected_loss", {2: "median_el"}),
                         ("pd", {i: f"pd_p{round(p * 100):02d}" for i, p in enumerate(probs)}),
                         ("lgd", {i: f"lgd_p{round(p * 100):02d}" for i, p in enumerate(probs)}))
        for i, name in names.items()])
    return attach(one, spread)


def rollup(el: DataFrame, group: str) -> DataFrame:
    """Counts, losses, exposures and the share of portfolio loss per value of a column."""
    sums = el.groupBy(group).agg(
        F.count("expected_loss").alias("loan_count"), F.sum("expected_loss").alias("total_el"),
        F.avg("expected_loss").alias("mean_el"), F.sum("ead").alias("total_ead"), F.avg("pd").alias("mean_pd"),
        F.avg("lgd").alias("mean_lgd"), F.avg("ead").alias("mean_ead"))
    medians = quantiles(el, ["expected_loss"], [0.5], [group]).select(
        F.col(group).alias("_g"), F.col("q")[0].alias("median_el"))
    both = sums.join(medians, sums[group].eqNullSafe(medians["_g"]), "left").drop("_g")
    return with_shares(both)


def with_shares(sums: DataFrame) -> DataFrame:
    """Adds the loss rate and the share of the portfolio's loss; the groups may be many, so their total is an aggregate."""
    held = pin(sums)
    portfolio = held.agg(F.sum("total_el")).first()[0]
    return held.withColumns({
        "el_rate": F.coalesce(F.try_divide("total_el", "total_ead"), F.lit(0.0)),
        "el_share_pct": F.col("total_el") / F.greatest(F.lit(portfolio).cast("double"), F.lit(1.0)) * 100,
    })


def multi_rollup(el: DataFrame, groups: list[str]) -> DataFrame:
    """Rollups by each of several columns, and the portfolio total, from one scan with grouping sets."""
    sets = [[F.col(g)] for g in groups] + [[]]
    sums = el.groupingSets(sets, *groups).agg(
        F.grouping_id(*groups).alias("_set"), F.count(F.lit(1)).alias("loan_count"),
        F.sum("expected_loss").alias("total_el"), F.sum("ead").alias("total_ead"))
    # In the grouping id a zero bit marks the column that is grouped by.
    full = 2 ** len(groups) - 1
    name = F.when(F.col("_set") == full, "portfolio")
    value = F.when(F.col("_set") == full, "all")
    for i, g in enumerate(groups):
        only = full - 2 ** (len(groups) - 1 - i)
        name = name.when(F.col("_set") == only, g)
        value = value.when(F.col("_set") == only, F.col(g).cast("string"))
    return sums.select(name.alias("dimension"), value.alias("segment"), "loan_count", "total_el", "total_ead",
                       F.coalesce(F.try_divide("total_el", "total_ead"), F.lit(0.0)).alias("el_rate"))


def under_stress(el: DataFrame, scenarios: list[tuple] | None = None) -> DataFrame:
    """Every loan once per scenario with its stressed PD, LGD and loss. A narrow explode of literals."""
    rows = [
        F.struct(F.lit(name).alias("scenario"), clip(F.col("pd") * factor, 0, 1).alias("stressed_pd"),
                 clip(F.col("lgd") if floor is None else F.greatest("lgd", F.lit(floor)), 0, 1).alias("stressed_lgd"))
        for name, factor, floor in (scenarios or SCENARIOS)
    ]
    wide = el.withColumn("_s", F.explode(F.array(*rows))).select(*el.columns, "_s.*")
    return wide.withColumn("stressed_el", F.col("stressed_pd") * F.col("stressed_lgd") * F.col("ead"))


def stress_report(el: DataFrame, scenarios: list[tuple] | None = None) -> DataFrame:
    """Totals and impact of each scenario against the unstressed loss: one pass for all scenarios."""
    out = under_stress(el, scenarios).groupBy("scenario").agg(
        F.count(F.lit(1)).alias("total_loans"), F.sum("expected_loss").alias("baseline_el"),
        F.sum("stressed_el").alias("stressed_el"), F.avg("stressed_el").alias("mean_stressed_el"),
        F.avg("pd").alias("mean_pd"), F.avg("stressed_pd").alias("mean_stressed_pd"),
        F.avg("lgd").alias("mean_lgd"), F.avg("stressed_lgd").alias("mean_stressed_lgd"),
        F.max("stressed_el").alias("max_stressed_el"))
    change = F.col("stressed_el") - F.col("baseline_el")
    rise = lambda new, old: (F.col(new) - F.col(old)) / F.greatest(F.col(old), F.lit(1e-10)) * 100
    return out.withColumns({
        "el_change": change, "el_change_pct": change / F.greatest(F.col("baseline_el"), F.lit(1.0)) * 100,
        "pd_change_pct": rise("mean_stressed_pd", "mean_pd"), "lgd_change_pct": rise("mean_stressed_lgd", "mean_lgd"),
    })


def stress_percentiles(el: DataFrame, probs: list[float] | None = None) -> DataFrame:
    """Percentiles of the stressed loss per scenario."""
    probs = probs or [0.05, 0.25, 0.5, 0.75, 0.95]
    q = quantiles(under_stress(el).select("scenario", "stressed_el"), ["stressed_el"], probs, ["scenario"])
    return q.select("scenario", *[F.col("q")[i].alias(f"p{round(p * 100):02d}") for i, p in enumerate(probs)])


def stressed_rollup(el: DataFrame, group: str) -> DataFrame:
    """Loss per scenario and group with its rise over the unstressed loss."""
    out = under_stress(el).groupBy("scenario", group).agg(
        F.count(F.lit(1)).alias("loan_count"), F.sum("expected_loss").alias("baseline_el"),
        F.sum("stressed_el").alias("stressed_el"), F.sum("ead").alias("total_ead"))
    return out.withColumn("el_change_pct", F.coalesce(F.try_divide(
        (F.col("stressed_el") - F.col("baseline_el")) * 100, "baseline_el"), F.lit(0.0)))


def loss_invariants(el: DataFrame) -> DataFrame:
    """Violations of 0 <= EL <= EAD per loan and of the order base <= adverse <= severe."""
    stressed = {name: clip(F.col("pd") * factor, 0, 1) * clip(
        F.col("lgd") if floor is None else F.greatest("lgd", F.lit(floor)), 0, 1) * F.col("ead")
        for name, factor, floor in SCENARIOS}
    n = lambda test: F.count(F.when(test, 1))
    return el.agg(
        n(F.col("expected_loss") < 0).alias("negative_el"),
        n(F.col("expected_loss") > F.col("ead") + 1e-9).alias("el_above_ead"),
        n(stressed["adverse"] + 1e-9 < stressed["base"]).alias("adverse_below_base"),
        n(stressed["severe"] + 1e-9 < stressed["adverse"]).alias("severe_below_adverse"))


def loss_band(el: DataFrame, group: str, bands: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Loss rate per portfolio type against the band expected for that type."""
    sums = el.groupBy(group).agg((F.sum("expected_loss") / F.greatest(F.sum("ead"), F.lit(1.0)) * 100).alias("el_pct"))
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, (lo, hi) in (bands or PORTFOLIO_BANDS).items():
        low = F.when(F.col(group) == name, lo).otherwise(low)
        high = F.when(F.col(group) == name, hi).otherwise(high)
    return sums.withColumns({"band_low": low, "band_high": high}).withColumn(
        "inside", F.col("el_pct").between(F.col("band_low"), F.col("band_high")))


def amortization(df: DataFrame, funded: str, rate_pct: str, term: str, keep: list[str] | None = None) -> DataFrame:
    """Month-by-month schedule of every loan in closed form: one row per loan and month, no state between rows."""
    keep = keep or ["id"]
    loans = df.where((F.col(funded) > 0) & (F.col(rate_pct) >= 0) & (F.col(term) > 0)).select(
        *keep, F.col(funded).cast("double").alias("_p"), (F.col(rate_pct) / 1200).alias("_r"),
        F.col(term).cast("int").alias("term"))
    months = loans.withColumn("month", F.explode(F.sequence(F.lit(1), F.col("term"))))
    growth = lambda m: F.pow(1 + F.col("_r"), m)
    n, m = F.col("term"), F.col("month")
    flat = F.col("_r") == 0
    balance = lambda at: F.when(flat, F.col("_p") * (1 - at / n)).otherwise(
        F.greatest(F.lit(0.0), F.col("_p") * F.try_divide(growth(n) - growth(at), growth(n) - 1)))
    payment = F.when(flat, F.col("_p") / n).otherwise(F.col("_p") * F.try_divide(F.col("_r") * growth(n), growth(n) - 1))
    out = months.withColumns({"payment": payment, "interest": balance(m - 1) * F.col("_r"),
                              "remaining_balance": balance(m)})
    return out.withColumns({
        "principal": F.col("payment") - F.col("interest"),
        "cumulative_principal_pct": (1 - F.col("remaining_balance") / F.col("_p")) * 100,
    }).select(*keep, F.col("_p").alias("funded"), "term", "month", "payment", "principal", "interest",
              "remaining_balance", "cumulative_principal_pct")


def amortization_milestones(schedule: DataFrame) -> DataFrame:
    """Rows at a quarter, half and three quarters of the term."""
    marks = F.array(*[F.struct(F.lit(f"{int(q * 100)}pct_term").alias("milestone"),
                               F.floor(F.col("term") * q).alias("at")) for q in (0.25, 0.5, 0.75)])
    at = schedule.withColumn("_m", F.explode(marks)).where(F.col("month") == F.col("_m.at"))
    return at.select(*[c for c in schedule.columns], F.col("_m.milestone").alias("milestone"),
                     (F.col("remaining_balance") / F.col("funded") * 100).alias("remaining_pct"))


def amortization_totals(schedule: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Total interest and payments per loan."""
    return schedule.groupBy(*(keys or ["id"])).agg(
        F.max("payment").alias("monthly_payment"), F.sum("interest").alias("total_interest"),
        F.sum("payment").alias("total_payments"))


def scheduled_exposure(df: DataFrame, funded: str, rate_pct: str, term: str, months_on_book: str,
                       keep: list[str] | None = None) -> DataFrame:
    """Balance left after a number of months on book, in closed form: an alternative exposure at default."""
    keep = keep or ["id"]
    r, n = F.col(rate_pct) / 1200, F.col(term)
    m = F.greatest(F.lit(0), F.least(F.col(months_on_book), n))
    grown = F.pow(1 + r, n)
    left = F.when(r == 0, F.col(funded) * (1 - m / n)).otherwise(
        F.col(funded) * F.try_divide(grown - F.pow(1 + r, m), grown - 1))
    return df.select(*keep, F.greatest(F.lit(0.0), left).alias("scheduled_ead"))
