import math

from pyspark.sql import functions as F

from riskloom.operators.history import HistorySpec, RowWindow, gathered, output_names, summarise
from riskloom.plans import applicants as A

ROWS = [
    (1, None, -10, 1.0),
    (1, None, -400, 1.0),
    (2, 5.0, -1, 2.0),
    (3, 1.0, -1, 1.0),
    (3, None, -2, None),
    (3, 4.0, -500, 1.0),
    (None, 9.0, -1, 9.0),
    (4, 7.0, -900, 3.0),
]
METRICS = {"k": ("count",), "x": ("mean", "max", "min", "sum", "count"), "v": ("nunique",)}


def table(spark):
    return spark.createDataFrame(ROWS, "k bigint, x double, d int, v double")


def by_key(df):
    return {r["k"]: r.asDict() for r in df.collect()}


def test_rules_for_missing_values(spark):
    spec = HistorySpec("k", METRICS, [RowWindow("A_"), RowWindow("R_", "d > -365")])
    out = summarise(table(spark), spec)
    assert out.columns == ["k", *output_names(spec)]
    got = by_key(out)
    assert set(got) == {1, 2, 3, 4}
    assert (got[1]["A_K_COUNT"], got[1]["A_X_SUM"], got[1]["A_X_MEAN"], got[1]["A_X_COUNT"]) == (2, 0.0, None, 0)
    assert got[1]["A_V_NUNIQUE"] == 1
    assert got[3]["A_V_NUNIQUE"] == 1 and got[3]["R_K_COUNT"] == 2 and got[3]["R_X_MEAN"] == 1.0
    # no recent rows: everything of that window is missing, counts and sums too
    assert all(v is None for c, v in got[4].items() if c.startswith("R_"))


def test_one_pass_equals_filter_group_join(spark):
    fused = summarise(table(spark), HistorySpec("k", METRICS, [RowWindow("A_"), RowWindow("R_", "d > -365")]))
    whole = summarise(table(spark), HistorySpec("k", METRICS, [RowWindow("A_")]))
    recent = summarise(table(spark).filter("d > -365"), HistorySpec("k", METRICS, [RowWindow("R_")]))
    assert by_key(fused) == by_key(whole.join(recent, "k", "left"))


def test_opposite_infinities_are_missing(spark):
    df = spark.createDataFrame([(1, math.inf), (1, -math.inf), (2, math.inf)], "k bigint, x double")
    got = by_key(summarise(df, HistorySpec("k", {"x": ("mean", "sum", "max")}, [RowWindow("")])))
    assert (got[1]["X_MEAN"], got[1]["X_SUM"], got[1]["X_MAX"]) == (None, None, math.inf)
    assert got[2]["X_MEAN"] == math.inf


def test_balances_of_hot_and_unknown_credits(spark):
    bureau = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (None, 13)], "SK_ID_CURR bigint, SK_ID_BUREAU bigint")
    rows = [(10, -m, "1" if m % 2 else "5") for m in range(300)] + [(11, -3, None), (12, None, "C"), (13, -1, "1"), (99, -1, "1")]
    balance = spark.createDataFrame(rows, "SK_ID_BUREAU bigint, MONTHS_BALANCE int, STATUS string")
    got = {r[0]: r for r in A.bureau_balance_features(bureau, balance).collect()}
    p = "BUREAU_BAL_"
    assert set(got) == {1, 2}
    assert got[1][p + "SK_ID_CURR_COUNT"] == 301
    assert got[1][p + "BUREAU_BAL_IS_DPD_SUM"] == 300 and got[1][p + "BUREAU_BAL_IS_DPD_OVER120_SUM"] == 150
    assert got[1][p + "MONTHS_BALANCE_MIN"] == -299
    assert got[2][p + "MONTHS_BALANCE_MEAN"] is None and got[2][p + "SK_ID_CURR_COUNT"] == 1


def test_second_shuffle_only_carries_combined_rows(spark):
    df = table(spark)
    plain = summarise(df, HistorySpec("k", {"x": ("mean", "sum")}, [RowWindow("A_")]))
    assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    two = summarise(df, HistorySpec("k", {"x": ("mean", "sum")}, [RowWindow("A_"), RowWindow("R_", "d > -365")]))
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("Scan") == 1


def test_undecided_applicants_have_no_share(spark):
    cols = {c: "double" for c in A.PREVIOUS_METRICS if not c.startswith("PREV_") and c != A.KEY}
    cols.update({c: "double" for c in A.SENTINEL_COLUMNS})
    rows = spark.createDataFrame([(1, "Approved"), (1, "Refused"), (1, "Canceled"), (2, "Canceled")], "SK_ID_CURR bigint, NAME_CONTRACT_STATUS string")
    rows = rows.select("*", *[F.lit(1.0).alias(c) for c in cols])
    got = {r["SK_ID_CURR"]: r for r in A.previous_features(rows).collect()}
    assert math.isclose(got[1]["PREV_REFUSED_RATIO"], 1 / 3) and got[2]["PREV_REFUSED_RATIO"] is None


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, 2.0, 5), (1, 4.0, -5), (2, None, 1)], "`the.key` int, `a.b` double, `c-d` int")
    spec = HistorySpec("the.key", {"the.key": ["count"], "a.b": ["mean", "max"], "c-d": ["sum"]}, [RowWindow("P_"), RowWindow("Q_", "`c-d` > 0")])
    got = {r["the.key"]: r.asDict() for r in summarise(df, spec).collect()}
    assert (got[1]["P_A.B_MEAN"], got[1]["Q_A.B_MAX"], got[1]["P_C-D_SUM"], got[1]["Q_THE.KEY_COUNT"]) == (3.0, 2.0, 0, 1)
    assert got[2]["P_A.B_MEAN"] is None and got[2]["P_THE.KEY_COUNT"] == 1


def test_gathered_rows_are_the_only_thing_that_travels(spark):
    """Source rows are dealt out by key once; no partial figures follow them, and the figures are the same."""
    spec = HistorySpec("k", METRICS, [RowWindow("A_"), RowWindow("R_", "d > -365")])
    found = summarise(gathered(table(spark), "k"), spec)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert by_key(found) == by_key(summarise(table(spark), spec))


def test_scattered_histories_are_gathered(spark):
    df = spark.createDataFrame([(1, 1), (None, 2)], "SK_ID_CURR bigint, x int")
    got = A.gathered({name: df for name in ("application", "bureau", *A.SCATTERED)})
    assert got["application"] is df and got["bureau"] is df
    assert [[tuple(r) for r in got[name].collect()] for name in A.SCATTERED] == [[(1, 1)]] * 4
