"""Applicant features: base ratios plus summaries of six history tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import (
    fill_with_mean,
    flag,
    ieee_div,
    overdue_bands,
    row_mean,
    row_std,
    sentinel_to_null,
)
from riskloom.operators import encode, graph, history, scale
from riskloom.operators.history import HistorySpec, RowWindow, summarise
from riskloom.session import materialise

KEY = "SK_ID_CURR"

# ---- Fixed values: column names, metric lists, thresholds and name prefixes ----

DAY_SENTINEL = 365243

SENTINEL_COLUMNS = [
    "DAYS_FIRST_DRAWING",
    "DAYS_FIRST_DUE",
    "DAYS_LAST_DUE_1ST_VERSION",
    "DAYS_LAST_DUE",
    "DAYS_TERMINATION",
]

EXTERNAL_SCORES = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]

# output: (numerator, denominator)
APPLICATION_RATIOS = {
    "APPS_ANNUITY_CREDIT_RATIO": ("AMT_ANNUITY", "AMT_CREDIT"),
    "APPS_GOODS_CREDIT_RATIO": ("AMT_GOODS_PRICE", "AMT_CREDIT"),
    "APPS_ANNUITY_INCOME_RATIO": ("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    "APPS_CREDIT_INCOME_RATIO": ("AMT_CREDIT", "AMT_INCOME_TOTAL"),
    "APPS_GOODS_INCOME_RATIO": ("AMT_GOODS_PRICE", "AMT_INCOME_TOTAL"),
    "APPS_CNT_FAM_INCOME_RATIO": ("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
    "APPS_EMPLOYED_BIRTH_RATIO": ("DAYS_EMPLOYED", "DAYS_BIRTH"),
    "APPS_INCOME_EMPLOYED_RATIO": ("AMT_INCOME_TOTAL", "DAYS_EMPLOYED"),
    "APPS_INCOME_BIRTH_RATIO": ("AMT_INCOME_TOTAL", "DAYS_BIRTH"),
    "APPS_CAR_BIRTH_RATIO": ("OWN_CAR_AGE", "DAYS_BIRTH"),
    "APPS_CAR_EMPLOYED_RATIO": ("OWN_CAR_AGE", "DAYS_EMPLOYED"),
}

PREVIOUS_METRICS = {
    "SK_ID_CURR": ("count",),
    "AMT_CREDIT": ("mean", "max", "sum"),
    "AMT_ANNUITY": ("mean", "max", "sum"),
    "AMT_APPLICATION": ("mean", "max", "sum"),
    "AMT_DOWN_PAYMENT": ("mean", "max", "sum"),
    "AMT_GOODS_PRICE": ("mean", "max", "sum"),
    "RATE_DOWN_PAYMENT": ("min", "max", "mean"),
    "DAYS_DECISION": ("min", "max", "mean"),
    "CNT_PAYMENT": ("mean", "sum"),
    "PREV_CREDIT_DIFF": ("mean", "max", "sum"),
    "PREV_CREDIT_APPL_RATIO": ("mean", "max"),
    "PREV_GOODS_DIFF": ("mean", "max", "sum"),
    "PREV_GOODS_APPL_RATIO": ("mean", "max"),
    "PREV_DAYS_LAST_DUE_DIFF": ("mean", "max", "sum"),
    "PREV_INTERESTS_RATE": ("mean", "max"),
}

BUREAU_METRICS = {
    "SK_ID_BUREAU": ("count",),
    "DAYS_CREDIT": ("min", "max", "mean"),
    "CREDIT_DAY_OVERDUE": ("min", "max", "mean"),
    "DAYS_CREDIT_ENDDATE": ("min", "max", "mean"),
    "DAYS_ENDDATE_FACT": ("min", "max", "mean"),
    "AMT_CREDIT_MAX_OVERDUE": ("max", "mean"),
    "AMT_CREDIT_SUM": ("max", "mean", "sum"),
    "AMT_CREDIT_SUM_DEBT": ("max", "mean", "sum"),
    "AMT_CREDIT_SUM_OVERDUE": ("max", "mean", "sum"),
    "AMT_ANNUITY": ("max", "mean", "sum"),
    "BUREAU_ENDDATE_FACT_DIFF": ("min", "max", "mean"),
    "BUREAU_CREDIT_FACT_DIFF": ("min", "max", "mean"),
    "BUREAU_CREDIT_ENDDATE_DIFF": ("min", "max", "mean"),
    "BUREAU_CREDIT_DEBT_RATIO": ("min", "max", "mean"),
    "BUREAU_CREDIT_DEBT_DIFF": ("min", "max", "mean"),
    "BUREAU_IS_DPD": ("mean", "sum"),
    "BUREAU_IS_DPD_OVER120": ("mean", "sum"),
}

OVERDUE_STATUSES = ["1", "2", "3", "4", "5"]
WORST_STATUS = "5"

POS_METRICS = {
    "SK_ID_CURR": ("count",),
    "MONTHS_BALANCE": ("min", "mean", "max"),
    "SK_DPD": ("min", "max", "mean", "sum"),
    "CNT_INSTALMENT": ("min", "max", "mean", "sum"),
    "CNT_INSTALMENT_FUTURE": ("min", "max", "mean", "sum"),
    "POS_IS_DPD": ("mean", "sum"),
    "POS_IS_DPD_UNDER_120": ("mean", "sum"),
    "POS_IS_DPD_OVER_120": ("mean", "sum"),
}

INSTALMENT_METRICS = {
    "SK_ID_CURR": ("count",),
    "NUM_INSTALMENT_VERSION": ("nunique",),
    "DAYS_ENTRY_PAYMENT": ("mean", "max", "sum"),
    "DAYS_INSTALMENT": ("mean", "max", "sum"),
    "AMT_INSTALMENT": ("mean", "max", "sum"),
    "AMT_PAYMENT": ("mean", "max", "sum"),
    "AMT_DIFF": ("mean", "min", "max", "sum"),
    "AMT_RATIO": ("mean", "max"),
    "SK_DPD": ("mean", "min", "max"),
    "INS_IS_DPD": ("mean", "sum"),
    "INS_IS_DPD_UNDER_120": ("mean", "sum"),
    "INS_IS_DPD_OVER_120": ("mean", "sum"),
}

CARD_METRICS = {
    "SK_ID_CURR": ("count",),
    "AMT_BALANCE": ("max",),
    "AMT_CREDIT_LIMIT_ACTUAL": ("max",),
    "AMT_DRAWINGS_ATM_CURRENT": ("max", "sum"),
    "AMT_DRAWINGS_CURRENT": ("max", "sum"),
    "AMT_DRAWINGS_POS_CURRENT": ("max", "sum"),
    "AMT_INST_MIN_REGULARITY": ("max", "mean"),
    "AMT_PAYMENT_TOTAL_CURRENT": ("max", "sum"),
    "AMT_TOTAL_RECEIVABLE": ("max", "mean"),
    "CNT_DRAWINGS_ATM_CURRENT": ("max", "sum"),
    "CNT_DRAWINGS_CURRENT": ("max", "mean", "sum"),
    "CNT_DRAWINGS_POS_CURRENT": ("mean",),
    "SK_DPD": ("mean", "max", "sum"),
    "BALANCE_LIMIT_RATIO": ("min", "max"),
    "DRAWING_LIMIT_RATIO": ("min", "max"),
    "CARD_IS_DPD": ("mean", "sum"),
    "CARD_IS_DPD_UNDER_120": ("mean", "sum"),
    "CARD_IS_DPD_OVER_120": ("mean", "sum"),
}

# Row windows: a name's prefix and the condition on rows; none means all rows.
PREVIOUS_ALL = ("PREV_", None)
PREVIOUS_YEAR = ("PREV_D365_", "DAYS_DECISION > -365")
DECIDED_STATUSES = ("Approved", "Refused")
BUREAU_ALL = ("BUREAU_", None)
BUREAU_ACTIVE = ("BUREAU_ACT_", "CREDIT_ACTIVE = 'Active'")
BUREAU_RECENT = ("BUREAU_ACT_", "DAYS_CREDIT > -750")  # named like the active summary, as its users expect
BALANCE_PREFIX = "BUREAU_BAL_"
POS_WINDOWS = [("POS_", None), ("POS_M20", "MONTHS_BALANCE > -20")]
INSTALMENT_WINDOWS = [("INS_", None), ("INS_D365", "DAYS_ENTRY_PAYMENT >= -365")]
CARD_WINDOWS = [("CARD_", None), ("CARD_M3", "MONTHS_BALANCE >= -3")]

# ---- End of fixed values ----


# -- derived columns -----------------------------------------------------------


def application_columns(apps: DataFrame) -> DataFrame:
    """External-score mean and spread, and eleven amount and age ratios."""
    out = apps.withColumns(
        {
            "APPS_EXT_SOURCE_MEAN": row_mean(EXTERNAL_SCORES),
            "APPS_EXT_SOURCE_STD": row_std(EXTERNAL_SCORES),
            **{name: ieee_div(a, b) for name, (a, b) in APPLICATION_RATIOS.items()},
        }
    )
    return fill_with_mean(out, "APPS_EXT_SOURCE_STD")


def previous_columns(prev: DataFrame) -> DataFrame:
    prev = prev.withColumns({c: sentinel_to_null(c, DAY_SENTINEL) for c in SENTINEL_COLUMNS})
    paid = F.col("AMT_ANNUITY") * F.col("CNT_PAYMENT")
    return prev.withColumns(
        {
            "PREV_CREDIT_DIFF": F.col("AMT_APPLICATION") - F.col("AMT_CREDIT"),
            "PREV_GOODS_DIFF": F.col("AMT_APPLICATION") - F.col("AMT_GOODS_PRICE"),
            "PREV_CREDIT_APPL_RATIO": ieee_div("AMT_CREDIT", "AMT_APPLICATION"),
            "PREV_GOODS_APPL_RATIO": ieee_div("AMT_GOODS_PRICE", "AMT_APPLICATION"),
            "PREV_DAYS_LAST_DUE_DIFF": F.col("DAYS_LAST_DUE_1ST_VERSION") - F.col("DAYS_LAST_DUE"),
            "PREV_INTERESTS_RATE": ieee_div(ieee_div(paid, "AMT_CREDIT") - 1, "CNT_PAYMENT"),
        }
    )


def bureau_columns(bureau: DataFrame) -> DataFrame:
    return bureau.withColumns(
        {
            "BUREAU_ENDDATE_FACT_DIFF": F.col("DAYS_CREDIT_ENDDATE") - F.col("DAYS_ENDDATE_FACT"),
            "BUREAU_CREDIT_FACT_DIFF": F.col("DAYS_CREDIT") - F.col("DAYS_ENDDATE_FACT"),
            "BUREAU_CREDIT_ENDDATE_DIFF": F.col("DAYS_CREDIT") - F.col("DAYS_CREDIT_ENDDATE"),
            "BUREAU_CREDIT_DEBT_RATIO": ieee_div("AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM"),
            "BUREAU_CREDIT_DEBT_DIFF": F.col("AMT_CREDIT_SUM_DEBT") - F.col("AMT_CREDIT_SUM"),
            "BUREAU_IS_DPD": flag(F.col("CREDIT_DAY_OVERDUE") > 0),
            "BUREAU_IS_DPD_OVER120": flag(F.col("CREDIT_DAY_OVERDUE") > 120),
        }
    )


def pos_columns(pos: DataFrame) -> DataFrame:
    return pos.withColumns(overdue_bands("SK_DPD", "POS"))


def instalment_columns(install: DataFrame) -> DataFrame:
    install = install.withColumns(
        {
            "AMT_DIFF": F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT"),
            "AMT_RATIO": ieee_div(F.col("AMT_PAYMENT") + 1, F.col("AMT_INSTALMENT") + 1),
            "SK_DPD": F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT"),
        }
    )
    return install.withColumns(overdue_bands("SK_DPD", "INS"))


def card_columns(card: DataFrame) -> DataFrame:
    return card.withColumns(
        {
            "BALANCE_LIMIT_RATIO": ieee_div("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL"),
            "DRAWING_LIMIT_RATIO": ieee_div("AMT_DRAWINGS_CURRENT", "AMT_CREDIT_LIMIT_ACTUAL"),
            **overdue_bands("SK_DPD", "CARD"),
        }
    )


# -- summaries -----------------------------------------------------------------


def _within(rows: DataFrame, metrics: Mapping[str, Sequence[str]], window: tuple[str, str]) -> DataFrame:
    """Summary of the rows of one window alone."""
    prefix, condition = window
    return summarise(rows.filter(condition), HistorySpec(KEY, metrics, [RowWindow(prefix)]))


def _decided(status: str) -> str:
    """1 for the status, 0 for the other decided one, missing for undecided rows."""
    name = "NAME_CONTRACT_STATUS"
    return f"CASE WHEN {name} IN {DECIDED_STATUSES} THEN CAST({name} = '{status}' AS BIGINT) END"


def previous_amounts(prev: DataFrame) -> DataFrame:
    return summarise(previous_columns(prev), HistorySpec(KEY, PREVIOUS_METRICS, [RowWindow(*PREVIOUS_ALL)]))


def previous_year_amounts(prev: DataFrame) -> DataFrame:
    return _within(previous_columns(prev), PREVIOUS_METRICS, PREVIOUS_YEAR)


def previous_status_counts(prev: DataFrame) -> DataFrame:
    """Approved and refused applications per applicant that has any of them."""
    return (
        prev.filter(F.col("NAME_CONTRACT_STATUS").isin(*DECIDED_STATUSES) & F.col(KEY).isNotNull())
        .groupBy(KEY)
        .agg(
            *[F.sum(F.expr(_decided(s))).alias(f"PREV_{s.upper()}_COUNT") for s in DECIDED_STATUSES],
        )
    )


def previous_features(prev: DataFrame) -> DataFrame:
    """All previous applications and those of the last year, plus decision shares."""
    spec = HistorySpec(
        KEY,
        PREVIOUS_METRICS,
        [RowWindow(*PREVIOUS_ALL), RowWindow(*PREVIOUS_YEAR)],
        extra={"__refused": _decided("Refused"), "__approved": _decided("Approved")},
    )
    out = summarise(previous_columns(prev), spec)
    count = "PREV_SK_ID_CURR_COUNT"
    return out.withColumns(
        {
            "PREV_REFUSED_RATIO": ieee_div("__refused", count),
            "PREV_APPROVED_RATIO": ieee_div("__approved", count),
        }
    ).drop("__refused", "__approved")


def bureau_amounts(bureau: DataFrame) -> DataFrame:
    return summarise(bureau_columns(bureau), HistorySpec(KEY, BUREAU_METRICS, [RowWindow(*BUREAU_ALL)]))


def bureau_active_amounts(bureau: DataFrame) -> DataFrame:
    return _within(bureau_columns(bureau), BUREAU_METRICS, BUREAU_ACTIVE)


def bureau_recent_amounts(bureau: DataFrame) -> DataFrame:
    return _within(bureau_columns(bureau), BUREAU_METRICS, BUREAU_RECENT)


def bureau_balance_features(bureau: DataFrame, balance: DataFrame) -> DataFrame:
    """Monthly balances summed up per credit first, then per applicant.

    The first step shrinks the balances to one row per credit before the join,
    so a credit with very many months weighs no more there than any other.
    """
    status = F.col("STATUS")
    per_credit = (
        balance.filter(F.col("SK_ID_BUREAU").isNotNull())
        .groupBy("SK_ID_BUREAU")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("MONTHS_BALANCE").alias("nm"),
            F.min("MONTHS_BALANCE").alias("lo"),
            F.max("MONTHS_BALANCE").alias("hi"),
            F.sum("MONTHS_BALANCE").alias("sm"),
            F.sum(flag(status.isin(OVERDUE_STATUSES))).alias("over"),
            F.sum(flag(status == WORST_STATUS)).alias("worst"),
        )
    )
    owners = bureau.select("SK_ID_BUREAU", KEY).filter(F.col(KEY).isNotNull())
    n = F.sum("n")
    p = BALANCE_PREFIX
    return (
        per_credit.join(owners, "SK_ID_BUREAU")
        .groupBy(KEY)
        .agg(
            n.alias(p + "SK_ID_CURR_COUNT"),
            F.min("lo").alias(p + "MONTHS_BALANCE_MIN"),
            F.max("hi").alias(p + "MONTHS_BALANCE_MAX"),
            F.when(F.sum("nm") > 0, F.sum("sm").cast("double") / F.sum("nm")).alias(p + "MONTHS_BALANCE_MEAN"),
            (F.sum("over").cast("double") / n).alias(p + "BUREAU_BAL_IS_DPD_MEAN"),
            F.sum("over").alias(p + "BUREAU_BAL_IS_DPD_SUM"),
            (F.sum("worst").cast("double") / n).alias(p + "BUREAU_BAL_IS_DPD_OVER120_MEAN"),
            F.sum("worst").alias(p + "BUREAU_BAL_IS_DPD_OVER120_SUM"),
        )
    )


def bureau_features(bureau: DataFrame, balance: DataFrame) -> DataFrame:
    """All, active and recent credits in one pass, overdue shares, monthly balances."""
    spec = HistorySpec(
        KEY,
        BUREAU_METRICS,
        [
            RowWindow(*BUREAU_ALL),
            RowWindow(*BUREAU_ACTIVE, "_x"),
            RowWindow(*BUREAU_RECENT, "_y"),
        ],
    )
    out = summarise(bureau_columns(bureau), spec)
    count = "BUREAU_SK_ID_BUREAU_COUNT"
    out = out.withColumns(
        {
            "BUREAU_ACT_IS_DPD_RATIO": ieee_div("BUREAU_ACT_BUREAU_IS_DPD_SUM_x", count),
            "BUREAU_ACT_IS_DPD_OVER120_RATIO": ieee_div("BUREAU_ACT_BUREAU_IS_DPD_OVER120_SUM_x", count),
        }
    )
    return out.join(bureau_balance_features(bureau, balance), KEY, "left")


def pos_features(pos: DataFrame) -> DataFrame:
    return summarise(pos_columns(pos), HistorySpec(KEY, POS_METRICS, [RowWindow(*w) for w in POS_WINDOWS]))


def instalment_features(install: DataFrame) -> DataFrame:
    return summarise(instalment_columns(install), HistorySpec(KEY, INSTALMENT_METRICS, [RowWindow(*w) for w in INSTALMENT_WINDOWS]))


def card_features(card: DataFrame) -> DataFrame:
    return summarise(card_columns(card), HistorySpec(KEY, CARD_METRICS, [RowWindow(*w) for w in CARD_WINDOWS]))


# Histories with few rows per applicant, spread over the whole table. Credits aren't among them: they are combined where they are.
SCATTERED = ("previous_application", "pos_cash_balance", "installments_payments", "credit_card_balance")


def gathered(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with each applicant's scattered rows brought together, for tables that aren't laid out by applicant."""
    return {name: history.gathered(df, KEY) if name in SCATTERED else df for name, df in tables.items()}


def applicant_features(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The full applicant table: one row per application, histories joined on the left.

    ``tables`` has the frames application, previous_application, bureau,
    bureau_balance, pos_cash_balance, installments_payments, credit_card_balance.
    Every history arrives with one row per applicant, already partitioned on the key.
    """
    out = application_columns(tables["application"])
    for part in (
        previous_features(tables["previous_application"]),
        bureau_features(tables["bureau"], tables["bureau_balance"]),
        pos_features(tables["pos_cash_balance"]),
        instalment_features(tables["installments_payments"]),
        card_features(tables["credit_card_balance"]),
    ):
        out = out.join(part, KEY, "left")
    return out


@dataclass(frozen=True)
class ApplicantTable:
    """A prepared table, the columns of each role, and the size of the code dictionary."""

    rows: DataFrame
    values: list[str]
    codes: list[str]
    n_codes: int


def coded_applicants(features: DataFrame, label: str = "TARGET", order: Sequence[str] = (KEY,)) -> ApplicantTable:
    """Model input: text as codes, value columns filled with 0 and scaled, the others as shared-dictionary codes.

    The features are written once, as the roles, the ranges and the dictionary each need a pass.
    """
    rows = encode.factorize(materialise(features, "features"), encode.text_columns(features), order)
    values, codes = encode.roles_by_name(rows, [KEY, label])
    rows = scale.fill_then_min_max(rows, values)
    rows, n = encode.bag_encode(rows, codes, order)
    return ApplicantTable(rows, values, codes, n)


def applicant_clusters(
    table: ApplicantTable, zero_share: float = 0.3, below: int = 20, label: str = "TARGET"
) -> tuple[DataFrame, list[str]]:
    """Rows with ``cluster_id`` and ``degree`` by the rarely-zero attributes with few values, and those attributes."""
    rows = materialise(table.rows, "coded")
    attributes = graph.attributes_by_zero_share(rows, zero_share, below, [KEY, label])
    return graph.assign_clusters(rows, attributes), attributes
