"""Rules with known answers: parsers, cleaning edge cases, statistics, stress order, registry and sources."""

from __future__ import annotations

import datetime as dt
import math
import tempfile

import pytest

from loanstrata.functions import ordered, stats, text
from loanstrata.operators import clean, drift, loss, metrics, profile, quality, registry, scorecard, tournament
from loanstrata.session import join_lookup, pin, release_pins
from loanstrata.sources import tables
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


@pytest.mark.parametrize("raw,want", [("< 1 year", 0.0), ("10+ years", 10.0), ("3 years", 3.0), ("n/a", None), ("", None),
                                      ("None", None), (None, None), ("1 year", 1.0)])
def test_employment_years(spark, raw, want):
    assert one(spark, text.employment_years(F.lit(raw).cast("string"))) == want


def test_other_parsers(spark):
    assert one(spark, text.percent_number(F.lit(" 13.5%"))) == 13.5
    assert one(spark, text.percent_number(F.lit("high"))) is None
    assert one(spark, text.term_months(F.lit(" 36 months"))) == 36.0
    assert one(spark, text.issue_date(F.lit("Dec-2015"))) == dt.date(2015, 12, 1)
    assert one(spark, text.issue_year(F.lit("2015"))) == 2015
    assert one(spark, text.issue_year(F.lit("soon"))) is None
    assert one(spark, text.clip(F.lit(None).cast("double"), 0, 1)) is None
    assert one(spark, text.finite(F.lit(float("nan")))) is None


def test_targets_with_zero_funding_and_missing_recoveries(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0, 1.0, None), (2, 100.0, None, None, 20.0), (3, 100.0, 150.0, 0.0, 0.0)],
                               "id int, funded_amnt double, recoveries double, collection_recovery_fee double, out_prncp double")
    rows = {r["id"]: r for r in clean.with_targets(df).collect()}
    assert (rows[1]["lgd"], rows[1]["ead"], rows[1]["ccf"]) == (None, 0.0, None)
    assert (rows[2]["lgd"], rows[2]["ccf"]) == (1.0, 0.2)
    assert rows[3]["lgd"] == 0.0
    bare = clean.with_targets(df.drop("out_prncp"))
    assert [r["ead"] for r in bare.orderBy("id").collect()] == [0.0, 100.0, 100.0]


def test_group_fill_falls_back_to_the_column(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 3.0), ("A", None), ("B", None), (None, None), (None, 9.0)], "grade string, x double")
    got = sorted(r["x"] for r in clean.fill_numeric_by_group(df, ["x"]).collect())
    # A fills with 2, the null grade with its own 9, B with the median of what is then there.
    assert got == [1.0, 2.0, 3.0, 3.0, 9.0, 9.0]


def test_mode_takes_the_lowest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "t string")
    assert clean.category_modes(df, ["t"]) == {"t": "a"}


def test_one_hot_refuses_free_text_and_drops_the_first_level(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("t"))
    with pytest.raises(ValueError):
        clean.category_levels(df, "t", 10)
    coded = clean.encode_one_hot(spark.createDataFrame([("x",), ("y",), (None,)], "home_ownership string"))
    assert coded.columns == ["home_ownership_y"] and sorted(r[0] for r in coded.collect()) == [0, 0, 1]


def test_rank_paths_agree(spark):
    df = spark.range(200).select(F.concat(F.lit("k"), F.lpad(F.col("id"), 4, "0")).alias("t"))
    a = ordered.rank_values(df, "t").orderBy("t").collect()
    b = ordered.rank_values(df, "t", 30).orderBy("t").collect()
    assert [r["rank"] for r in a] == [r["rank"] for r in b] == list(range(1, 201))


def test_lookup_join_matches_nulls_on_both_paths(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "k string, v int")
    side = spark.createDataFrame([("a", 10), (None, 20)], "k string, w int")
    for bound in (100, 1):
        got = {r["v"]: r["w"] for r in join_lookup(df, side, ["k"], max_rows=bound).collect()}
        assert got == {1: 10, 2: 20, 3: None}


def test_pins_live_in_the_named_folder_and_go_away(spark):
    kept = pin(spark.range(10))
    assert kept.count() == 10
    assert release_pins(spark) >= 1


def test_tails():
    assert stats.chi2_tail(15.507, 8) == pytest.approx(0.05, abs=1e-4)
    assert stats.chi2_tail(2.733, 8) == pytest.approx(0.95, abs=1e-3)
    assert stats.student_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert stats.student_quantile(0.95, 10) == pytest.approx(2.22814, abs=1e-4)
    assert stats.f_tail(4.10, 2, 10) == pytest.approx(0.05, abs=1e-3)


def test_even_chi_square_and_kolmogorov_columns(spark):
    assert one(spark, stats.chi2_tail_even(F.lit(15.507), 8)) == pytest.approx(0.05, abs=1e-4)
    n = F.lit(1e6)
    d = 1.3581 / math.sqrt(5e5)
    assert one(spark, stats.kolmogorov_tail(F.lit(d), n, n)) == pytest.approx(0.05, abs=2e-3)
    assert one(spark, stats.kolmogorov_tail(F.lit(0.0), n, n)) == 1.0


def test_psi_of_itself_and_near_symmetry(spark):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("s"),
        F.when(F.col("id") % 2 == 0, F.rand(1)).otherwise(F.rand(2) * 0.9 + 0.05).alias("x"))
    edges = drift.equal_width_edges(rows, ["x"])
    ab = drift.psi(rows, "s", "a", "b", edges, drift.EQUAL_WIDTH).collect()[0]["psi"]
    ba = drift.psi(rows, "s", "b", "a", edges, drift.EQUAL_WIDTH).collect()[0]["psi"]
    assert abs(ab - ba) < 0.05 and ab > 0
    assert drift.psi(rows, "s", "a", "a", edges, drift.EQUAL_WIDTH).collect()[0]["psi"] == pytest.approx(0.0)


def test_psi_keeps_repeated_edges_as_empty_bins(spark):
    df = spark.createDataFrame([("r", 1.0), ("r", 5.0), ("r", 5.0), ("r", 7.0), ("c", 5.0), ("c", 8.0)], "s string, x double")
    counts = {r["bin"]: (r["n_r"], r["n_c"]) for r in drift.side_counts(
        df, "s", ["r", "c"], {"x": [0.0, 5.0, 5.0, 9.0]}, drift.QUANTILE_OPEN).collect()}
    assert counts == {0: (1, 0), 2: (3, 2)}


def test_amortization_matches_the_month_by_month_loop(spark):
    df = spark.createDataFrame([(1, 10000.0, 12.5, 36), (2, 5000.0, 0.0, 10), (3, 0.0, 5.0, 36)], "id int, f double, r double, t int")
    rows = loss.amortization(df, "f", "r", "t").orderBy("id", "month").collect()
    assert len(rows) == 46
    r = 12.5 / 1200
    pay = 10000 * r * (1 + r) ** 36 / ((1 + r) ** 36 - 1)
    balance = 10000.0
    for row in rows[:36]:
        interest = balance * r
        balance = max(balance - (pay - interest), 0.0)
        assert row["payment"] == pytest.approx(pay) and row["interest"] == pytest.approx(interest, abs=1e-6)
        assert row["remaining_balance"] == pytest.approx(balance, abs=1e-6)
    assert [row["principal"] for row in rows[36:]] == [500.0] * 10
    assert rows[-1]["cumulative_principal_pct"] == pytest.approx(100.0)


def test_stress_never_lowers_a_loss(spark):
    el = loss.expected_loss(spark.createDataFrame([(0.9, 0.1, 100.0), (0.2, 0.7, 50.0), (1.4, 1.2, -5.0)], "pd double, lgd double, ead double"))
    row = loss.loss_invariants(el).collect()[0]
    assert list(row) == [0, 0, 0, 0]
    capped = loss.under_stress(el).where("scenario = 'severe' AND pd = 0.9").collect()[0]
    assert (capped["stressed_pd"], capped["stressed_lgd"]) == (1.0, 0.6)


def test_refinement_stops_on_small_gain(spark):
    scores = [0.750, 0.758, 0.761, 0.762, 0.790]
    df = spark.createDataFrame([(i + 1, "m", s) for i, s in enumerate(scores)] + [(1, "late", 0.71)], "round int, model string, score double")
    rows = tournament.refinement_trace(df).orderBy("round").collect()
    assert [r["status"] for r in rows] == ["Continuing", "Continuing", "Continuing", "Converged"]
    assert rows[0]["models_pruned"] == 1 and rows[0]["best_model"] == "m"


def test_rubric_weights_are_valid(spark):
    assert tournament.weight_validity(tournament.rubric_table(spark)).where("NOT valid").count() == 0


def test_equal_metrics_score_full_marks(spark):
    df = spark.createDataFrame([("a", 0.7, 0.4, 0.2, 0.1, 0.5, 0.0, 0.0, 5, "sklearn", 1.0), ("b", 0.7, 0.4, 0.2, 0.1, 0.5, 0.0, 0.0, 5, "sklearn", 1.0)],
                               "model string, auc double, gini double, ks double, brier double, hl_pvalue double, psi double, gap double, "
                               "feature_count int, library string, training_time_s double").withColumn("status", F.lit("trained"))
    rows = tournament.rubric_scores(df).orderBy("rank").collect()
    # All but efficiency (0) and interpretability (0.3 of its tenth) are full.
    assert [r["model"] for r in rows] == ["a", "b"] and rows[0]["rubric_score"] == pytest.approx(0.88)


def test_early_stop_matches_the_rule(spark):
    history = [0.5, 0.6, 0.7] + [0.69] * 60 + [0.9]
    df = spark.createDataFrame([("m", i + 1, v) for i, v in enumerate(history)], "model string, iteration int, metric double")
    row = tournament.early_stop(df, ["model"], 50).collect()[0]
    assert row["stopped_at"] == 53 and row["saved_share"] == pytest.approx(1 - 52 / 64)


def test_registry_demotes_and_promotes(spark):
    path = tempfile.mkdtemp(prefix="registry-") + "/events"
    base = {"model_type": "pd", "metrics": {"auc": 0.7}, "hyperparameters": {}, "champion": True}
    first = registry.register_model(spark, path, {**base, "algorithm": "logistic", "registered_at": dt.datetime(2024, 1, 1)})
    second = registry.register_model(spark, path, {**base, "algorithm": "tree", "registered_at": dt.datetime(2024, 1, 2)})
    events = lambda: spark.read.schema(registry.MODEL_SCHEMA).parquet(path)
    champion = lambda: [r["model_id"] for r in registry.get_champion(registry.registry_state(events()), "PD").collect()]
    assert champion() == [second]
    assert registry.promote(spark, path, first, dt.datetime(2024, 1, 3)) and champion() == [first]
    assert not registry.promote(spark, path, "unknown", dt.datetime(2024, 1, 4))
    assert [r["model_id"] for r in registry.list_models(registry.registry_state(events()), "pd").collect()] == [second, first]


@pytest.mark.parametrize("bad", ["", "drop table t", "select 1; select 2", "with x as (select 1) insert into t select * from x",
                                 "pragma table_info(t)", "update t set a = 1"])
def test_sql_guard_refuses(bad):
    with pytest.raises(ValueError):
        tables.check_read_only(bad)


def test_sql_guard_accepts_and_limits(spark):
    df = spark.range(5000)
    assert tables.run_sql(spark, "select replace('a', 'a', 'drop it') as t, id from {df};", 9999, df=df).count() == 2000
    assert tables.run_sql(spark, "with x as (select id from {df}) select * from x", 0, df=df).count() == 1


def test_csv_dictionary_and_describe(spark):
    root = tempfile.mkdtemp(prefix="csv-")
    tables.write_csv(spark.createDataFrame([(1, "a"), (2, None)], "id int, grade string"), f"{root}/in")
    df = tables.ingest_csv(spark, f"{root}/in", f"{root}/out", "id int, grade string")
    assert df.count() == 2
    dictionary = spark.createDataFrame([(" Grade ", "risk grade"), ("other", "x")], "field string, description string")
    rows = {r["name"]: r for r in tables.describe_table(df, dictionary, "id").collect()}
    assert rows["grade"]["description"] == "risk grade" and rows["id"]["is_key"]
    one_row = tables.dictionary_summary(df, dictionary).collect()[0]
    assert (one_row["matched"], one_row["unmatched"], one_row["first_unmatched"]) == (1, 1, ["id"])
    nulls = {r["column"]: r["null_count"] for r in tables.null_counts(df).collect()}
    assert nulls == {"id": 0, "grade": 1}


def test_mcar_flags_a_dependent_gap(spark):
    df = spark.range(2000).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") > 500, F.col("id") * 1.0).alias("y"))
    rows = profile.mcar_flags(df, ["y"], ["x"]).collect()
    assert [r["interpretation"] for r in rows] == ["MAR likely"]


def test_constant_column_has_no_outliers(spark):
    rows = quality.outliers(spark.range(50).select(F.lit(3.0).alias("x")), ["x"]).collect()
    assert (rows[0]["z_outliers"], rows[0]["iqr_outliers"]) == (0, 0)


def test_perfect_and_inverted_scores(spark):
    df = spark.range(100).select((F.col("id") >= 50).cast("int").alias("label"), (F.col("id") / 100).alias("score"))
    row = metrics.discrimination(df, []).collect()[0]
    assert (row["auc"], row["gini"], row["ks"]) == (1.0, 1.0, 1.0)
    scan = metrics.feature_auc(df.withColumn("inverse", -F.col("score")), ["score", "inverse"], "label").collect()
    assert {r["leakage"] for r in scan} == {"flag"}


def test_scan_reads_only_what_a_query_needs(spark):
    from conftest import SMALL
    from loanstrata.plans.tape import resolved_loans
    plan = resolved_loans(spark, SMALL, ["loan_amnt"]).groupBy("split").agg(F.sum("loan_amnt"))._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "customer" not in plan
    assert "In(o_orderstatus" in plan and "o_orderpriority" not in plan


def test_wide_tables_take_the_long_path(spark):
    df = spark.range(20).select(*[(F.col("id") * (i + 1)).cast("double").alias(f"c{i}") for i in range(70)], F.lit(None).cast("double").alias("empty"))
    wide, narrow = stats.moments(df, df.columns), stats.moments(df, ["c0", "c69", "empty"])
    assert wide.rows == narrow.rows == 20
    for c in ("c0", "c69", "empty"):
        assert {k: v if v is None else pytest.approx(v) for k, v in narrow[c].items()} == wide[c]


def test_lineage_counts_rows_and_columns(spark):
    from conftest import SMALL
    from loanstrata.plans.tape import loan_tape
    made = clean.clean_tape(loan_tape(spark, SMALL), fit_scope="train", train_last_year=1998)
    rows = {r["action"]: r for r in made.lineage.collect()}
    assert rows["initial"]["rows"] == 1500 and rows["resolved_only"]["rows"] == made.targets.count() == made.features.count()
    assert rows["drop_leakage"]["columns"] == rows["initial"]["columns"] - 3
    assert not [t for _, t in made.features.dtypes if t == "string"]
    assert set(made.leakage.columns) == {"id", "recoveries", "collection_recovery_fee", "out_prncp"}
    held = [c for c in made.features.columns if c not in ("id", "default_flag", "issue_year")]
    gaps = made.features.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in held]).collect()[0]
    assert sum(gaps) == 0
    parts = {(r["action"], r["column"]): r for r in made.lineage_columns.collect()}
    assert rows["impute"]["nulls_before"] == sum(r["nulls_before"] for (a, _), r in parts.items() if a == "impute") > 0
    assert rows["impute"]["nulls_after"] == 0 and "annual_inc" in rows["impute"]["columns_changed"]
    assert rows["cap"]["values_clipped"] == sum(r["clipped"] for (a, _), r in parts.items() if a == "cap") > 0
    assert parts["cap", "dti"]["lower"] == 0.0 and parts["cap", "dti"]["upper"] == 50.0


def test_lineage_runs_no_job_of_its_own(spark, monkeypatch):
    from conftest import SMALL
    from loanstrata.plans.tape import loan_tape
    counted = []
    monkeypatch.setattr(type(spark.range(0)), "count", lambda self: counted.append(1) or 0)
    clean.clean_tape(loan_tape(spark, SMALL, ["id", "loan_status", "issue_d", "grade", "loan_amnt", "dti", "annual_inc", "funded_amnt",
                                              "out_prncp", "recoveries", "collection_recovery_fee"]))
    # Exact quantiles count their rows once each; the lineage itself asks for none.
    assert len(counted) <= 3


def test_wide_categories_become_sparse_vectors(spark):
    rows = [(i, f"v{i % 300:03d}" if i % 10 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, level string").withColumn("rank", F.lit(1.0))
    levels = sorted({v for _, v in rows if v})
    wide = clean.encode_one_hot(df, ["level"])
    assert wide.columns == ["id", "rank", "level_vec"]
    for r in wide.collect():
        level = rows[r["id"]][1]
        assert r["level_vec"].size == len(levels)
        assert r["level_vec"].indices.tolist() == ([levels.index(level)] if level else [])
    unseen = clean.encode_sparse(df, "level", fit_on=df.where("level < 'v010'")).where("level >= 'v010'").first()
    assert unseen["level_vec"].size == len([v for v in levels if v < "v010"]) and not len(unseen["level_vec"].indices)
    assert len(clean.encode_one_hot(df, ["level"], flag_levels=300).columns) == 2 + len(levels) - 1


def test_permutations_keep_sizes_and_pick_the_smallest_tickets(spark, monkeypatch):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 7 < 3, "train").otherwise("test").alias("split"),
                                    (F.col("id") * 37 % 101).cast("double").alias("x"), F.when(F.col("id") % 50 != 0, F.col("id") % 13).alias("y"))
    held = rows.where("y IS NOT NULL")
    size = held.where("split = 'train'").count()
    exact = {}
    for r in drift.tickets(held.select("id"), "id", 6, 9).collect():
        exact.setdefault(r["draw"], []).append((r["ticket"], r["id"]))
    want = {d: sorted(v)[size - 1] for d, v in exact.items()}
    for limit in (2_000, 1):  # one histogram level, then all of them
        monkeypatch.setattr(drift, "BOUNDARY_ROWS", limit)
        assert drift.ticket_cuts(drift.tickets(held.select("id"), "id", 6, 9), "id", 6, size) == want
    draws = drift.permutation_draws(rows, ["x", "y"], permutations=6, seed=9).collect()
    assert {r["n_reference"] for r in draws} == {size} and len({r["stat"] for r in draws}) == 7
    # Two draws share about as many rows as independent ones would.
    one, two = ({i for t, i in exact[d] if (t, i) <= want[d]} for d in (1, 2))
    share = size / held.count()
    assert abs(len(one & two) / held.count() - share * share) < 0.03
    same = rows.withColumn("x", F.lit(1.0)).withColumn("y", F.lit(2.0))
    assert drift.permutation_drift(same, ["x", "y"], permutations=5).collect()[0]["p_value"] == 1.0


def test_a_missing_metric_counts_as_neutral(spark):
    rows = [("a", "trained", 0.8, None), ("b", "trained", 0.6, 0.1), ("c", "trained", None, 0.1), ("d", "failed", 0.9, 0.0)]
    entries = spark.createDataFrame(rows, "model string, status string, auc double, brier double")
    got = {r.model: (r.auc_part, r.brier_part) for r in tournament.rubric_parts(entries.where("status = 'trained'"), ["auc", "brier"]).collect()}
    assert got == {"a": (1.0, 0.5), "b": (0.0, 1.0), "c": (0.5, 1.0)}


def test_shipped_rubrics_are_valid_and_broken_ones_are_not(spark):
    assert all(r.valid for r in tournament.weight_validity(tournament.rubric_table(spark)).collect())
    broken = spark.createDataFrame([("x", 0.5), ("x", 0.6), ("y", 1.5), ("y", -0.5)], "rubric string, weight double")
    assert [r.valid for r in tournament.weight_validity(broken).collect()] == [False, False]


def test_cuts_of_unexploded_rows_are_those_of_exploded_ones(spark, monkeypatch):
    """Text keys, repeated keys and a key missing; no row may be exploded into its draws."""
    keys = [None if i == 5 else f"k{i % 900}" for i in range(1000)]
    rows = spark.createDataFrame([(k, "train" if i % 3 else "test", float(i % 17)) for i, k in enumerate(keys)], "id string, split string, x double")
    made = rows.where("id IS NOT NULL").select(F.col("id").alias("_key"), *[h.alias(n) for n, h in drift.key_hashes(F.col("id"), 4).items()])
    size = rows.where("split = 'train'").count() - 1
    want = drift.ticket_cuts(drift.tickets(rows.where("id IS NOT NULL"), "id", 5, 4), "id", 5, size)
    mean = sum(i % 17 for i in range(1000) if i % 3) / 666
    spread = (sum((i % 17 - mean) ** 2 for i in range(1000) if i % 3) / 666) ** 0.5
    for limit in (2_000, 1):
        monkeypatch.setattr(drift, "BOUNDARY_ROWS", limit)
        assert drift.row_cuts(made, 5, 4, size) == want

    def refuse(*args):
        raise AssertionError("rows were exploded")

    exact = {d: [(t, k, x) for t, k, x in drawn if (t, k) <= want[d]] for d, drawn in (
        (d, [(r["ticket"], r["id"], r["x"]) for r in drift.tickets(rows.where("id IS NOT NULL"), "id", 5, 4).where(F.col("draw") == d).collect()]) for d in want)}
    monkeypatch.setattr(drift, "tickets", refuse)
    for r in drift.permutation_draws(rows, ["x"], permutations=5, seed=4).where("draw > 0").collect():
        held = [x for _, _, x in exact[r["draw"]]]
        rest = (sum(i % 17 for i in range(1000)) - sum(held)) / (1000 - len(held))
        assert r["n_reference"] == len(held) and r["n_other"] == 1000 - len(held)
        assert abs(r["stat"] - abs(sum(held) / len(held) - rest) / spread) < 1e-9


def test_neighbours_of_a_full_leaf_take_bounded_memory():
    import tracemalloc

    import numpy as np
    import pandas as pd

    from loanstrata.operators import robustness

    rng = np.random.default_rng(2)
    leaf = pd.DataFrame({"id": np.arange(20_000), "a": rng.random(20_000), "b": rng.random(20_000)})
    tracemalloc.start()
    found = [len(part) for part, _ in zip(robustness._nearest_in_leaf(["a", "b"], 5)(iter([leaf])), range(3))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(found) and peak < 60e6


def test_count_summary_equals_counting_texts(spark):
    rows = [(1, 0.0, "a", None), (1, -0.0, "b", None), (2, float("nan"), None, None), (None, float("nan"), "a", None), (2**62 + 1, 2.5, "a", None), (2**62, 2.5, "", None)]
    df = spark.createDataFrame(rows, "k long, v double, t string, e float")
    got = {r["column"]: tuple(r)[1:] for r in profile.count_summary(df, df.columns).collect()}
    want = {c: (len(rows), sum(v is None for v in texts), len({v for v in texts if v is not None}), max((texts.count(v) for v in texts if v is not None), default=None))
            for c, texts in ((c, [None if r[i] is None else str(r[i]) for r in rows]) for i, c in enumerate(df.columns))}
    assert got == want


def test_the_scorecard_counts_its_columns_once(spark, monkeypatch):
    made = []
    plain = profile.struct_rows
    monkeypatch.setattr(profile, "struct_rows", lambda df, keep, rows: made.append(len(rows)) or plain(df, keep, rows))
    df = spark.createDataFrame([(i, "train" if i % 2 else "test", int(i * 7 % 10 < 3), i * 37 % 401 / 7, i * i * 13 % 409 / 3, "xyz"[i % 3]) for i in range(400)],
                               "id long, split string, default_flag int, a double, b double, grade string")
    verdicts = {r["test_id"]: r for r in scorecard.dq_scorecard(df).collect()}
    assert made.count(3) == 1
    assert verdicts["DQ-03"]["value"] == 3 and verdicts["DQ-04"]["value"] == pytest.approx(134 / 400) and verdicts["DQ-04"]["evidence"] == "grade"
