"""The six cleaning steps in their fixed order: leakage, filter, types, imputation, capping, encoding.

Steps that learn something from data come as a `fit_...` that returns a few numbers and an `apply` that uses
them as literals, so applying a step is a projection with no join and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanstrata.functions.ordered import quantile_values, quantiles, rank_values
from loanstrata.functions.text import clip, employment_years, issue_date, percent_number, term_months
from loanstrata.operators.profile import numeric_columns, string_columns, struct_rows, value_counts
from loanstrata.functions.stats import moments
from loanstrata.session import attach, join_lookup, pin, small_table

# Columns known only after origination, prefixes of such columns, columns without model value.
LEAKAGE_COLUMNS = [
    "recoveries", "collection_recovery_fee", "total_pymnt", "total_pymnt_inv", "total_rec_prncp", "total_rec_int",
    "total_rec_late_fee", "last_pymnt_d", "last_pymnt_amnt", "last_credit_pull_d", "last_fico_range_high",
    "last_fico_range_low", "out_prncp", "out_prncp_inv", "next_pymnt_d", "pymnt_plan", "debt_settlement_flag",
]
LEAKAGE_PREFIXES = ("settlement_", "hardship_")
UNUSED_COLUMNS = ["id", "member_id", "url", "desc", "emp_title", "title", "zip_code", "policy_code"]
RESOLVED_STATUSES = ["Fully Paid", "Charged Off"]
CAPPED_COLUMNS = ["annual_inc", "revol_bal", "loan_amnt", "funded_amnt", "dti", "open_acc"]
# Bounds that replace the percentile bounds of a column.
CREDIT_BOUNDS = {
    "funded_amnt": (1000.0, 40000.0),
    "annual_inc": (10000.0, 200000.0),
    "dti": (0.0, 50.0),
    "fico_range_low": (300.0, 850.0),
    "fico_range_high": (300.0, 850.0),
    "term_months": (36.0, 60.0),
    "mths_since_last_delinq": (0.0, 600.0),
}
GRADES = "ABCDEFG"
ONE_HOT_COLUMNS = ["home_ownership", "verification_status", "initial_list_status", "application_type"]


def leakage_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c in LEAKAGE_COLUMNS or c.startswith(LEAKAGE_PREFIXES)]


def split_leakage(df: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The frame without post-origination columns, and the key with those columns."""
    leaks = leakage_columns(df)
    return df.drop(*leaks), df.select(key, *[c for c in leaks if not c.startswith(LEAKAGE_PREFIXES)])


def resolved_only(df: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    return df.where(F.col("loan_status").isin(*(statuses or RESOLVED_STATUSES)))


def with_default_flag(df: DataFrame, default_statuses: list[str] | None = None) -> DataFrame:
    bad = F.col("loan_status").isin(*(default_statuses or ["Charged Off"]))
    return df.withColumn("default_flag", F.when(bad, 1).otherwise(0))


def with_targets(df: DataFrame) -> DataFrame:
    """Adds loss given default, exposure at default and the credit conversion factor."""
    funded = F.when(F.col("funded_amnt") != 0, F.col("funded_amnt").cast("double"))
    recovered = F.coalesce("recoveries", F.lit(0.0)) - F.coalesce("collection_recovery_fee", F.lit(0.0))
    exposure = F.coalesce("out_prncp", F.lit(0.0)) if "out_prncp" in df.columns else F.col("funded_amnt")
    return df.withColumns({
        "lgd": clip(1 - recovered / funded, 0, 1),
        "ead": exposure.cast("double"),
        "ccf": exposure / funded,
    })


def loss_stage_targets(df: DataFrame) -> DataFrame:
    """Defaulted loans with the any-loss flag; severity rows are those with the flag set."""
    return df.where((F.col("default_flag") == 1) & F.col("lgd").isNotNull()).withColumn(
        "any_loss", F.when(F.col("lgd") > 0, 1).otherwise(0))


def coerce_types(df: DataFrame) -> DataFrame:
    """Text numbers and dates to doubles and dates, for the known columns that are text."""
    texts = set(string_columns(df))
    parsers = {"int_rate": percent_number, "revol_util": percent_number, "term": term_months,
               "emp_length": employment_years}
    out = {c: parse(F.col(c)) for c, parse in parsers.items() if c in texts}
    out.update({c: issue_date(F.col(c)) for c in ("issue_d", "earliest_cr_line") if c in texts})
    return df.withColumns(out) if out else df


def fill_numeric_by_group(df: DataFrame, columns: list[str], group: str = "grade",
                          fit_on: DataFrame | None = None) -> DataFrame:
    """Null to the median of the group, then what is left to the median of the column after that fill."""
    source = df if fit_on is None else fit_on
    medians = quantiles(source, columns, [0.5], [group])
    wide = medians.groupBy(group).agg(*[
        F.max(F.when(F.col("feature") == c, F.col("q")[0])).alias(f"_m_{c}") for c in columns
    ])
    fill = lambda frame: join_lookup(frame, wide, [group]).withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in columns}
    ).drop(*[f"_m_{c}" for c in columns])
    filled = fill(df)
    fitted = filled if fit_on is None else fill(fit_on)
    rest = filled.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns]).collect()[0].asDict()
    left = [c for c in columns if rest[c]]
    return fill_numeric(filled, left, fitted) if left else filled


def fill_numeric(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Null to the median of the column."""
    medians = quantile_values(df if fit_on is None else fit_on, columns, [0.5])
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c][0])) for c in columns if c in medians})


def category_modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent value per column, lowest value on ties: one grouped job for all columns."""
    counts = value_counts(df, columns).where(F.col("value").isNotNull())
    best = counts.groupBy("column").agg(F.min_by("value", F.struct((-F.col("n")).alias("n"), "value")).alias("mode"))
    return {r["column"]: r["mode"] for r in best.collect()}


def fill_categories(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    modes = category_modes(df if fit_on is None else fit_on, columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(modes[c])) for c in columns if c in modes})


@dataclass
class CapRule:
    """How bounds are found: percentile, std, iqr, or range (no capping), with fixed bounds taking precedence."""
    method: str = "percentile"
    low: float = 0.01
    high: float = 0.99
    std_factor: float = 3.0
    iqr_factor: float = 1.5
    fixed: dict[str, tuple[float, float]] = field(default_factory=dict)


def fit_caps(df: DataFrame, columns: list[str], rule: CapRule | None = None) -> dict[str, tuple[float, float]]:
    """Lower and upper bound per column."""
    rule = rule or CapRule()
    bounds = {c: rule.fixed[c] for c in columns if c in rule.fixed}
    rest = [c for c in columns if c not in bounds]
    if not rest:
        return bounds
    if rule.method == "percentile":
        q = quantile_values(df, rest, [rule.low, rule.high])
        bounds.update({c: (q[c][0], q[c][1]) for c in rest if c in q})
    elif rule.method == "iqr":
        q = quantile_values(df, rest, [0.25, 0.75])
        for c in q:
            reach = rule.iqr_factor * (q[c][1] - q[c][0])
            bounds[c] = (q[c][0] - reach, q[c][1] + reach)
    elif rule.method == "std":
        stats = moments(df, rest)
        for c in rest:
            if stats[c]["n"] and stats[c]["std"] is not None:
                reach = rule.std_factor * stats[c]["std"]
                bounds[c] = (stats[c]["mean"] - reach, stats[c]["mean"] + reach)
    else:
        row = df.agg(*[f(c).alias(f"{n}_{c}") for c in rest for n, f in (("lo", F.min), ("hi", F.max))]).collect()[0]
        bounds.update({c: (float(row[f"lo_{c}"]), float(row[f"hi_{c}"])) for c in rest if row[f"lo_{c}"] is not None})
    return bounds


def apply_caps(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: clip(F.col(c).cast("double"), lo, hi) for c, (lo, hi) in bounds.items()})


def cap_report(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Values clipped per column, their percentage of all rows, and the bounds."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count(F.when((F.col(c) < lo) | (F.col(c) > hi), 1)).alias(c) for c, (lo, hi) in bounds.items()]
    return struct_rows(df.agg(*aggs), [], [
        F.struct(F.lit(c).alias("feature"), F.lit(float(lo)).alias("lower"), F.lit(float(hi)).alias("upper"),
                 F.col(c).alias("clipped"), (F.col(c) / F.col("_rows") * 100).alias("clip_pct"))
        for c, (lo, hi) in bounds.items()
    ])


def cap_check(before: DataFrame, after: DataFrame, bounds: dict[str, tuple[float, float]], key: str = "id") -> DataFrame:
    """After capping: no row lost or gained, no value outside the bounds, and no in-range value changed."""
    left = before.select(key, *[F.col(c).cast("double").alias(f"b_{c}") for c in bounds])
    right = after.select(key, *[F.col(c).cast("double").alias(f"a_{c}") for c in bounds], F.lit(1).alias("_a"))
    both = left.withColumn("_b", F.lit(1)).join(right, key, "full_outer")
    aggs = [F.count(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1)).alias("unmatched_rows")]
    changed, outside = F.lit(False), F.lit(False)
    for c, (lo, hi) in bounds.items():
        inside = F.col(f"b_{c}").between(lo, hi)
        changed = changed | F.coalesce(inside & (F.col(f"a_{c}") != F.col(f"b_{c}")), F.lit(False))
        outside = outside | F.coalesce((F.col(f"a_{c}") < lo) | (F.col(f"a_{c}") > hi), F.lit(False))
    aggs += [F.count(F.when(changed, 1)).alias("in_range_changed"), F.count(F.when(outside, 1)).alias("out_of_bounds")]
    return both.agg(*aggs)


def encode_grade(df: DataFrame, column: str = "grade") -> DataFrame:
    """A..G to 1..7."""
    position = F.instr(F.lit(GRADES), F.col(column))
    return df.withColumn(f"{column}_ord", F.when(F.length(column) == 1, F.nullif(position, F.lit(0))).cast("double"))


def encode_rank(df: DataFrame, column: str = "sub_grade", fit_on: DataFrame | None = None) -> DataFrame:
    """Value to its rank among the sorted distinct values, from 1."""
    source = df if fit_on is None else fit_on
    levels = source.where(F.col(column).isNotNull()).select(column).distinct()
    ranked = rank_values(levels, column).select(column, F.col("rank").cast("double").alias(f"{column}_ord"))
    return join_lookup(df, ranked, [column])


def encode_target_rate(df: DataFrame, column: str = "purpose", target: str = "default_flag",
                       fit_on: DataFrame | None = None) -> DataFrame:
    """Category to its mean target; fit on the training rows to keep later rows out of it.

    A category that the fitted rows do not hold gets their overall rate; null stays null.
    """
    source = df if fit_on is None else fit_on
    rate = F.avg(F.col(target).cast("double"))
    rates = source.where(F.col(column).isNotNull()).groupBy(column).agg(rate.alias(f"{column}_risk"))
    overall = source.agg(rate.alias("r")).collect()[0]["r"]
    coded = join_lookup(df, rates, [column])
    unseen = F.when(F.col(column).isNotNull(), F.lit(overall).cast("double"))
    return coded.withColumn(f"{column}_risk", F.coalesce(F.col(f"{column}_risk"), unseen))


def category_levels(df: DataFrame, column: str, limit: int | None = None) -> list[str]:
    """Sorted distinct values; a caller that wants no more than `limit` of them gets an error beyond it."""
    levels = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).distinct()
    held = levels if limit is None else small_table(levels, limit)
    if held is None:
        raise ValueError(f"{column} has more than {limit} levels; use encode_target_rate")
    return sorted(r[0] for r in held.collect())


# Levels beyond which a column becomes a sparse vector instead of a column per level.
FLAG_LEVELS = 256


def encode_one_hot(df: DataFrame, columns: list[str] | None = None, fit_on: DataFrame | None = None,
                   flag_levels: int = FLAG_LEVELS) -> DataFrame:
    """0/1 columns `<column>_<level>` for all levels but the first, replacing the source columns.

    A column with more than `flag_levels` levels is replaced by the sparse vector `<column>_vec` of `encode_sparse`.
    """
    columns = [c for c in (columns or ONE_HOT_COLUMNS) if c in df.columns]
    source = df if fit_on is None else fit_on
    flags, wide = {}, []
    for c in columns:
        held = small_table(source.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("level")).distinct(), flag_levels)
        if held is None:
            wide.append(c)
            continue
        for level in sorted(r["level"] for r in held.collect())[1:]:
            flags[f"{c}_{level}"] = F.coalesce((F.col(c) == level).cast("int"), F.lit(0))
    out = df.withColumns(flags) if flags else df
    for c in wide:
        out = encode_sparse(out, c, fit_on)
    return out.drop(*columns)


def encode_sparse(df: DataFrame, column: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Adds `<column>_vec`: a sparse vector with a 1 at the level's place among the sorted levels.

    Places are distributed ranks joined by value, so no level reaches the driver. Null, and a level that the fitted rows
    do not hold, give the zero vector.
    """
    source = df if fit_on is None else fit_on
    levels = source.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("_level")).distinct()
    ranked = pin(rank_values(levels, "_level").withColumnRenamed("rank", "_rank"))
    size = ranked.agg(F.coalesce(F.max("_rank"), F.lit(0)).alias("n")).collect()[0]["n"]
    if not size:
        raise ValueError(f"{column} has no levels")
    # One place more than there are levels; the encoder leaves the last place out, which is the zero vector.
    marked = {"ml_attr": {"type": "nominal", "num_vals": size + 1}}
    placed = df.join(ranked, F.col(column).cast("string") == F.col("_level"), "left").withColumn(
        "_place", F.coalesce(F.col("_rank") - 1, F.lit(size)).cast("double")).withMetadata("_place", marked).drop("_level", "_rank")
    coder = OneHotEncoder(inputCol="_place", outputCol=f"{column}_vec", dropLast=True)
    return coder.fit(placed.limit(0)).transform(placed).drop("_place")


def drop_texts(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Drops every text column that was not encoded."""
    return df.drop(*[c for c in string_columns(df) if c not in (keep or [])])


def numeric_only(df: DataFrame, keep: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Numeric columns with infinities as null and nulls at the (training) median."""
    columns = [c for c in numeric_columns(df) if c not in keep]
    tidy = lambda frame: frame.select(*keep, *[
        F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")),
               F.col(c).cast("double")).alias(c) for c in columns])
    return fill_numeric(tidy(df), columns, None if fit_on is None else tidy(fit_on))


LINEAGE_SCHEMA = ("step int, action string, rows_before long, rows long, columns_before int, columns int, nulls_before long, nulls_after long, "
                  "values_clipped long, columns_dropped array<string>, columns_changed array<string>")
LINEAGE_COLUMN_SCHEMA = "step int, action string, column string, nulls_before long, nulls_after long, lower double, upper double, clipped long"


@dataclass
class Cleaned:
    """What cleaning leaves, what it set aside, a row per step, and a row per column that was imputed or capped."""
    features: DataFrame
    targets: DataFrame
    leakage: DataFrame
    lineage: DataFrame
    lineage_columns: DataFrame


def _nulls(columns: list[str]) -> list[Column]:
    return [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns]


def clean_tape(tape: DataFrame, key: str = "id", fit_scope: str = "all", train_last_year: int = 2015) -> Cleaned:
    """All six steps. `fit_scope='train'` learns medians, bounds and rates from the training vintages only.

    Rows, nulls and clipped values of the lineage are gathered by the three writes themselves: of the resolved loans, of
    the imputed columns and of the result.
    """
    spark = tape.sparkSession
    rows = F.count(F.lit(1)).alias("rows")
    initial, resolved, before, after, clips = (Observation() for _ in range(5))
    # The joins behind the tape run once; every fit and every output below reads this table.
    held = pin(with_default_flag(resolved_only(tape.observe(initial, rows))).observe(resolved, rows))
    dated = with_targets(held).withColumn("issue_d", issue_date(F.col("issue_d"))).withColumn("issue_year", F.year("issue_d"))
    target_columns = [key, "default_flag", "issue_year", "issue_d", "lgd", "ead", "ccf"]
    base, leakage = split_leakage(held, key)
    typed = coerce_types(base.drop("loan_status", *[c for c in UNUSED_COLUMNS if c != key]))
    held_back = [key, "default_flag", "issue_year"]
    typed = typed.withColumn("issue_year", F.year("issue_d")).drop(*[
        f.name for f in typed.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))])
    train = typed.where(F.col("issue_year") <= train_last_year) if fit_scope == "train" else typed
    numeric = [c for c in numeric_columns(typed) if c not in held_back]
    texts = string_columns(typed)
    seen = typed.observe(before, rows, *_nulls([*numeric, *texts]))
    filled = (fill_numeric_by_group(seen, numeric, "grade", train) if "grade" in texts else fill_numeric(seen, numeric, train))
    filled = fill_categories(filled, texts, train)
    imputed = pin(filled.observe(after, rows, *_nulls([*numeric, *texts])))
    fit = imputed if fit_scope != "train" else imputed.where(F.col("issue_year") <= train_last_year)
    bounds = fit_caps(fit, [c for c in CAPPED_COLUMNS if c in numeric], CapRule(fixed=CREDIT_BOUNDS))
    outside = [F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"clip_{c}") for c, (lo, hi) in bounds.items()]
    coded = apply_caps(imputed.observe(clips, rows, *outside), bounds)
    coded = encode_grade(coded) if "grade" in texts else coded
    coded = encode_rank(coded, fit_on=imputed) if "sub_grade" in texts else coded
    if "purpose" in texts:
        coded = encode_target_rate(coded, "purpose", "default_flag", fit)
    coded = drop_texts(encode_one_hot(coded, fit_on=imputed))
    features = pin(coded)

    first, n, gaps, rest, cut = (o.get for o in (initial, resolved, before, after, clips))
    columns = [*numeric, *texts]
    total = lambda found: sum(found[f"null_{c}"] for c in columns)
    filled_in = [c for c in columns if gaps[f"null_{c}"] > rest[f"null_{c}"]]
    clipped = [c for c in bounds if cut[f"clip_{c}"]]
    gone = lambda old, new: sorted(set(old) - set(new))
    width = len(tape.columns)
    steps = [
        (0, "initial", first["rows"], first["rows"], width, width, None, None, None, [], []),
        (1, "resolved_only", first["rows"], n["rows"], width, width, None, None, None, [], []),
        (2, "drop_leakage", n["rows"], n["rows"], width, len(base.columns) - 1, None, None, None, gone(held.columns, base.columns), []),
        (3, "coerce_types", n["rows"], gaps["rows"], len(base.columns) - 1, len(typed.columns), None, total(gaps), None,
         gone(base.columns, typed.columns), sorted(f.name for f in typed.schema.fields if f.name in base.columns and f.dataType != base.schema[f.name].dataType)),
        (4, "impute", gaps["rows"], rest["rows"], len(typed.columns), len(imputed.columns), total(gaps), total(rest), None, [], sorted(filled_in)),
        (5, "cap", rest["rows"], cut["rows"], len(imputed.columns), len(imputed.columns), total(rest), total(rest),
         sum(cut[f"clip_{c}"] for c in bounds), [], sorted(clipped)),
        (6, "encode", cut["rows"], cut["rows"], len(imputed.columns), len(features.columns), None, None, None,
         gone(imputed.columns, features.columns), sorted(set(features.columns) - set(imputed.columns)))]
    details = [(4, "impute", c, gaps[f"null_{c}"], rest[f"null_{c}"], None, None, None) for c in columns if gaps[f"null_{c}"]]
    details += [(5, "cap", c, None, None, float(lo), float(hi), cut[f"clip_{c}"]) for c, (lo, hi) in bounds.items()]
    return Cleaned(features, dated.select(*[c for c in target_columns if c in dated.columns]), leakage,
                   spark.createDataFrame(steps, LINEAGE_SCHEMA), spark.createDataFrame(details, LINEAGE_COLUMN_SCHEMA))


def clean_summary(tape: DataFrame, cleaned: Cleaned) -> DataFrame:
    """Rows before and after, number of features and the default rate."""
    rows = tape.agg(F.count(F.lit(1)).alias("initial_rows"))
    after = cleaned.targets.agg(
        F.count(F.lit(1)).alias("resolved_rows"), F.sum("default_flag").alias("defaults"),
        F.avg(F.col("default_flag").cast("double")).alias("default_rate"))
    features = len([c for c in cleaned.features.columns if c not in ("id", "default_flag", "issue_year")])
    return attach(rows, after).withColumn("features", F.lit(features))
