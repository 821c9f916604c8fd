"""Queries and SQL for the applicant features."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from catalog.frames import FRAMES, frame, frame_sql, lending_tables
from riskloom.plans import applicants as A
from riskloom.session import new_path
from riskloom.sources.tables import write_bucketed

def is_ratio(name: str) -> bool:
    """Columns whose values depend on summation order in their last digits."""
    return any(part in name for part in ("RATIO", "RATE", "_STD"))


def comparable(df: DataFrame) -> DataFrame:
    """Round ratio columns to 6 places, show infinities as a far finite number."""
    return df.selectExpr(
        *[
            f"CASE WHEN {f.name} = double('inf') THEN 1e15D WHEN {f.name} = double('-inf') THEN -1e15D "
            f"ELSE round({f.name}, 6) + 0D END AS {f.name}"
            if isinstance(f.dataType, T.DoubleType) and is_ratio(f.name)
            else f.name
            for f in df.schema.fields
        ]
    )


def shown(expr: str, name: str, kind: str = "double") -> str:
    if kind == "double" and is_ratio(name):
        return (
            f"CASE WHEN isinf({expr}) AND {expr} > 0 THEN 1e15 WHEN isinf({expr}) THEN -1e15 "
            f"ELSE round({expr}, 6) + 0e0 END AS {name}"
        )
    return f"{expr} AS {name}"


def div(a: str, b: str) -> str:
    return (
        f"(CASE WHEN ({b}) <> 0 THEN CAST(({a}) AS DOUBLE) / ({b}) WHEN ({b}) = 0 AND ({a}) > 0 THEN "
        f"CAST('inf' AS DOUBLE) WHEN ({b}) = 0 AND ({a}) < 0 THEN CAST('-inf' AS DOUBLE) END)"
    )


def flag(cond: str) -> str:
    return f"(CASE WHEN {cond} THEN 1 ELSE 0 END)"


def bands(prefix: str) -> dict[str, str]:
    return {
        f"{prefix}_IS_DPD": flag("SK_DPD > 0"),
        f"{prefix}_IS_DPD_UNDER_120": flag("SK_DPD > 0 AND SK_DPD < 120"),
        f"{prefix}_IS_DPD_OVER_120": flag("SK_DPD >= 120"),
    }


RATIOS = {name: div(a, b) for name, (a, b) in A.APPLICATION_RATIOS.items()}

_E = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
_N = "(" + " + ".join(f"(CASE WHEN {e} IS NULL THEN 0 ELSE 1 END)" for e in _E) + ")"
_SUM = "(" + " + ".join(f"coalesce({e}, 0)" for e in _E) + ")"
_MEAN = f"(CASE WHEN {_N} > 0 THEN {_SUM} / {_N} END)"
_SQ = "(" + " + ".join(f"coalesce(({e} - {_MEAN}) * ({e} - {_MEAN}), 0)" for e in _E) + ")"
_STD = f"(CASE WHEN {_N} > 1 THEN sqrt({_SQ} / ({_N} - 1)) END)"

PREVIOUS = {
    "PREV_CREDIT_DIFF": "AMT_APPLICATION - AMT_CREDIT",
    "PREV_GOODS_DIFF": "AMT_APPLICATION - AMT_GOODS_PRICE",
    "PREV_CREDIT_APPL_RATIO": div("AMT_CREDIT", "AMT_APPLICATION"),
    "PREV_GOODS_APPL_RATIO": div("AMT_GOODS_PRICE", "AMT_APPLICATION"),
    "PREV_DAYS_LAST_DUE_DIFF": "nullif(DAYS_LAST_DUE_1ST_VERSION, 365243) - nullif(DAYS_LAST_DUE, 365243)",
    "PREV_INTERESTS_RATE": div(div("AMT_ANNUITY * CNT_PAYMENT", "AMT_CREDIT") + " - 1", "CNT_PAYMENT"),
}
BUREAU = {
    "BUREAU_ENDDATE_FACT_DIFF": "DAYS_CREDIT_ENDDATE - DAYS_ENDDATE_FACT",
    "BUREAU_CREDIT_FACT_DIFF": "DAYS_CREDIT - DAYS_ENDDATE_FACT",
    "BUREAU_CREDIT_ENDDATE_DIFF": "DAYS_CREDIT - DAYS_CREDIT_ENDDATE",
    "BUREAU_CREDIT_DEBT_RATIO": div("AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM"),
    "BUREAU_CREDIT_DEBT_DIFF": "AMT_CREDIT_SUM_DEBT - AMT_CREDIT_SUM",
    "BUREAU_IS_DPD": flag("CREDIT_DAY_OVERDUE > 0"),
    "BUREAU_IS_DPD_OVER120": flag("CREDIT_DAY_OVERDUE > 120"),
}
INSTALMENT = {
    "AMT_DIFF": "AMT_INSTALMENT - AMT_PAYMENT",
    "AMT_RATIO": div("AMT_PAYMENT + 1", "AMT_INSTALMENT + 1"),
    "SK_DPD": "DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT",
}
CARD = {
    "BALANCE_LIMIT_RATIO": div("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL"),
    "DRAWING_LIMIT_RATIO": div("AMT_DRAWINGS_CURRENT", "AMT_CREDIT_LIMIT_ACTUAL"),
}


def _plus(inner: str, extra: dict[str, str]) -> str:
    return f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in extra.items())} FROM ({inner})"


PREVIOUS_SQL = _plus(frame_sql("previous_application"), PREVIOUS)
BUREAU_SQL = _plus(frame_sql("bureau"), BUREAU)
POS_SQL = _plus(frame_sql("pos_cash_balance"), bands("POS"))
INSTALMENT_SQL = _plus(_plus(frame_sql("installments_payments"), INSTALMENT), bands("INS"))
CARD_SQL = _plus(frame_sql("credit_card_balance"), {**CARD, **bands("CARD")})

_WHOLE = {"DAYS_DECISION", "DAYS_CREDIT", "CREDIT_DAY_OVERDUE", "CNT_DRAWINGS_CURRENT", "AMT_CREDIT_LIMIT_ACTUAL"}


def metric(c: str, f: str) -> str:
    if f == "count":
        return f"count({c})"
    if f == "nunique":
        return f"count(DISTINCT {c})"
    if f == "mean":
        return f"CASE WHEN isnan(avg({c})) THEN NULL ELSE avg({c}) END"
    if f == "sum":
        whole = c in _WHOLE or "_IS_DPD" in c
        return f"coalesce(CAST(sum({c}) AS BIGINT), 0)" if whole else f"coalesce(sum({c}), 0)"
    return f"{f}({c})"


def summary_sql(rows: str, metrics, prefix: str, where: str | None = None, suffix: str = "", key: str = A.KEY) -> str:
    """The two-step form: filter the rows, then group them."""
    cols = []
    for c, funcs in metrics.items():
        for f in funcs:
            expr = metric(c, f)
            if c == "SK_DPD" and f == "sum":
                expr = "coalesce(CAST(sum(SK_DPD) AS BIGINT), 0)"
            cols.append(f"{expr} AS {prefix}{c}_{f.upper()}{suffix}")
    cond = f"{key} IS NOT NULL" + (f" AND {where}" if where else "")
    return f"SELECT {key}, {', '.join(cols)} FROM ({rows}) WHERE {cond} GROUP BY {key}"


def names(metrics, prefix: str, suffix: str = "") -> list[str]:
    return [f"{prefix}{c}_{f.upper()}{suffix}" for c, funcs in metrics.items() for f in funcs]


def final(sql: str, columns: list[str]) -> str:
    return f"SELECT {', '.join(shown(c, c) for c in columns)} FROM ({sql})"


def two_windows(rows: str, metrics, a: str, b: str, where: str) -> tuple[str, list[str]]:
    cols = [A.KEY, *names(metrics, a), *names(metrics, b)]
    sql = (
        f"SELECT {', '.join(cols)} FROM ({summary_sql(rows, metrics, a)}) x "
        f"LEFT JOIN ({summary_sql(rows, metrics, b, where)}) y USING ({A.KEY})"
    )
    return sql, cols


STATUS_SQL = (
    "SELECT SK_ID_CURR, CAST(sum(CASE WHEN NAME_CONTRACT_STATUS = 'Approved' THEN 1 ELSE 0 END) AS BIGINT) AS "
    "PREV_APPROVED_COUNT, CAST(sum(CASE WHEN NAME_CONTRACT_STATUS = 'Refused' THEN 1 ELSE 0 END) AS BIGINT) AS "
    f"PREV_REFUSED_COUNT FROM ({frame_sql('previous_application')}) WHERE NAME_CONTRACT_STATUS IN ('Approved', "
    "'Refused') GROUP BY SK_ID_CURR"
)

_prev, _prev_cols = two_windows(PREVIOUS_SQL, A.PREVIOUS_METRICS, "PREV_", "PREV_D365_", "DAYS_DECISION > -365")
PREV_AGG_COLS = [*_prev_cols, "PREV_REFUSED_RATIO", "PREV_APPROVED_RATIO"]
PREV_AGG = (
    f"SELECT p.*, {div('PREV_REFUSED_COUNT', 'PREV_SK_ID_CURR_COUNT')} AS PREV_REFUSED_RATIO, "
    f"{div('PREV_APPROVED_COUNT', 'PREV_SK_ID_CURR_COUNT')} AS PREV_APPROVED_RATIO "
    f"FROM ({_prev}) p LEFT JOIN ({STATUS_SQL}) s USING (SK_ID_CURR)"
)

BALANCE_METRICS = {
    "SK_ID_CURR": ("count",),
    "MONTHS_BALANCE": ("min", "max", "mean"),
    "BUREAU_BAL_IS_DPD": ("mean", "sum"),
    "BUREAU_BAL_IS_DPD_OVER120": ("mean", "sum"),
}
_OVERDUE = "STATUS IN ('1', '2', '3', '4', '5')"
_WORST = "STATUS = '5'"
_ACTIVE = "CREDIT_ACTIVE = 'Active'"
BALANCE_ROWS = (
    f"SELECT b.*, k.SK_ID_CURR, {flag(_OVERDUE)} "
    f"AS BUREAU_BAL_IS_DPD, {flag(_WORST)} AS BUREAU_BAL_IS_DPD_OVER120 "
    f"FROM ({frame_sql('bureau_balance')}) b LEFT JOIN (SELECT SK_ID_CURR, SK_ID_BUREAU FROM ({frame_sql('bureau')})) k "
    "USING (SK_ID_BUREAU)"
)
BALANCE_SQL = summary_sql(BALANCE_ROWS, BALANCE_METRICS, "BUREAU_BAL_")

_M = A.BUREAU_METRICS
BUREAU_COLS = [
    A.KEY,
    *names(_M, "BUREAU_"),
    *names(_M, "BUREAU_ACT_", "_x"),
    *names(_M, "BUREAU_ACT_", "_y"),
    "BUREAU_ACT_IS_DPD_RATIO",
    "BUREAU_ACT_IS_DPD_OVER120_RATIO",
    *names(BALANCE_METRICS, "BUREAU_BAL_"),
]
BUREAU_AGG = (
    f"SELECT x.*, y.* EXCLUDE (SK_ID_CURR), z.* EXCLUDE (SK_ID_CURR), w.* EXCLUDE (SK_ID_CURR), "
    f"{div('BUREAU_ACT_BUREAU_IS_DPD_SUM_x', 'BUREAU_SK_ID_BUREAU_COUNT')} AS BUREAU_ACT_IS_DPD_RATIO, "
    f"{div('BUREAU_ACT_BUREAU_IS_DPD_OVER120_SUM_x', 'BUREAU_SK_ID_BUREAU_COUNT')} AS BUREAU_ACT_IS_DPD_OVER120_RATIO "
    f"FROM ({summary_sql(BUREAU_SQL, _M, 'BUREAU_')}) x "
    f"LEFT JOIN ({summary_sql(BUREAU_SQL, _M, 'BUREAU_ACT_', _ACTIVE, '_x')}) y ON x.SK_ID_CURR = y.SK_ID_CURR "
    f"LEFT JOIN ({summary_sql(BUREAU_SQL, _M, 'BUREAU_ACT_', 'DAYS_CREDIT > -750', '_y')}) z ON x.SK_ID_CURR = z.SK_ID_CURR "
    f"LEFT JOIN ({BALANCE_SQL}) w ON x.SK_ID_CURR = w.SK_ID_CURR"
)

POS_AGG, POS_COLS = two_windows(POS_SQL, A.POS_METRICS, "POS_", "POS_M20", "MONTHS_BALANCE > -20")
INSTALMENT_AGG, INSTALMENT_COLS = two_windows(
    INSTALMENT_SQL, A.INSTALMENT_METRICS, "INS_", "INS_D365", "DAYS_ENTRY_PAYMENT >= -365"
)
# Instalment days are doubles, so their overdue sum stays one.
CARD_AGG, CARD_COLS = two_windows(CARD_SQL, A.CARD_METRICS, "CARD_", "CARD_M3", "MONTHS_BALANCE >= -3")

_APP = list(FRAMES["application"][1])
APP_SQL = (
    f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in RATIOS.items())}, {_MEAN} AS APPS_EXT_SOURCE_MEAN, "
    f"coalesce({_STD}, avg({_STD}) OVER ()) AS APPS_EXT_SOURCE_STD FROM ({frame_sql('application')})"
)
APP_COLS = [*_APP, "APPS_EXT_SOURCE_MEAN", "APPS_EXT_SOURCE_STD", *RATIOS]

_rest = [
    (PREV_AGG, PREV_AGG_COLS),
    (BUREAU_AGG, BUREAU_COLS),
    (POS_AGG, POS_COLS),
    (INSTALMENT_AGG, INSTALMENT_COLS),
    (CARD_AGG, CARD_COLS),
]
FEATURE_COLS = APP_COLS + [c for _, cols in _rest for c in cols if c != A.KEY]
FEATURES = f"SELECT * FROM ({APP_SQL}) t0 " + " ".join(
    f"LEFT JOIN ({sql}) t{i} USING (SK_ID_CURR)" for i, (sql, _) in enumerate(_rest, 1)
)


def _one(name, fn):
    return lambda spark, sf: comparable(fn(frame(spark, sf, name)))


def _gathered(name, fn):
    return lambda spark, sf: comparable(fn(A.gathered({name: frame(spark, sf, name)})[name]))


def _derived(name, fn, columns):
    return lambda spark, sf: comparable(fn(frame(spark, sf, name)).select(*columns))


def queries():
    def balance(spark, sf):
        return comparable(A.bureau_balance_features(frame(spark, sf, "bureau"), frame(spark, sf, "bureau_balance")))

    def bureau(spark, sf):
        return comparable(A.bureau_features(frame(spark, sf, "bureau"), frame(spark, sf, "bureau_balance")))

    def features(spark, sf):
        return comparable(A.applicant_features(A.gathered(lending_tables(spark, sf))))

    def bucketed(spark, sf):
        folder = new_path(spark, "bucketed")
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        tables = write_bucketed(lending_tables(spark, sf), folder, f"b{uuid.uuid4().hex}", buckets, refuse=False)
        return comparable(A.applicant_features(tables))

    key = "SK_ID_CURR"
    line = [key, "SK_ID_PREV"]
    return {
        "app_ratios": _derived("application", A.application_columns, [key, *RATIOS]),
        "row_mean": _derived("application", A.application_columns, [key, "APPS_EXT_SOURCE_MEAN"]),
        "row_std_fill": _derived("application", A.application_columns, [key, "APPS_EXT_SOURCE_STD"]),
        "sentinel_null": _derived("previous_application", A.previous_columns, ["SK_ID_PREV", *A.SENTINEL_COLUMNS]),
        "prev_processed": _derived("previous_application", A.previous_columns, ["SK_ID_PREV", *PREVIOUS]),
        "bureau_processed": _derived("bureau", A.bureau_columns, [key, "SK_ID_BUREAU", *BUREAU]),
        "install_processed": _derived("installments_payments", A.instalment_columns, [*line, "NUM_INSTALMENT_NUMBER", *INSTALMENT]),
        "card_processed": _derived("credit_card_balance", A.card_columns, [*line, *CARD]),
        "dpd_bands": _derived("pos_cash_balance", A.pos_columns, [*line, *bands("POS")]),
        "prev_amt_agg": _one("previous_application", A.previous_amounts),
        "prev_status_pivot": _one("previous_application", A.previous_status_counts),
        "prev_d365_agg": _one("previous_application", A.previous_year_amounts),
        "prev_agg": _gathered("previous_application", A.previous_features),
        "bureau_day_amt_agg": _one("bureau", A.bureau_amounts),
        "bureau_active_agg": _one("bureau", A.bureau_active_amounts),
        "bureau_d750_agg": _one("bureau", A.bureau_recent_amounts),
        "bureau_bal_agg": balance,
        "bureau_agg": bureau,
        "pos_bal_agg": _gathered("pos_cash_balance", A.pos_features),
        "install_agg": _gathered("installments_payments", A.instalment_features),
        "card_bal_agg": _gathered("credit_card_balance", A.card_features),
        "applicant_features": features,
        "applicant_features_bucketed": bucketed,
    }


def oracle():
    key = "SK_ID_CURR"
    line = [key, "SK_ID_PREV"]
    sentinel = ", ".join(f"nullif({c}, 365243) AS {c}" for c in A.SENTINEL_COLUMNS)
    M = A.PREVIOUS_METRICS
    return {
        "app_ratios": final(APP_SQL, [key, *RATIOS]),
        "row_mean": f"SELECT {key}, {_MEAN} AS APPS_EXT_SOURCE_MEAN FROM ({frame_sql('application')})",
        "row_std_fill": final(APP_SQL, [key, "APPS_EXT_SOURCE_STD"]),
        "sentinel_null": f"SELECT SK_ID_PREV, {sentinel} FROM ({frame_sql('previous_application')})",
        "prev_processed": final(PREVIOUS_SQL, ["SK_ID_PREV", *PREVIOUS]),
        "bureau_processed": final(BUREAU_SQL, [key, "SK_ID_BUREAU", *BUREAU]),
        "install_processed": final(INSTALMENT_SQL, [*line, "NUM_INSTALMENT_NUMBER", *INSTALMENT]),
        "card_processed": final(CARD_SQL, [*line, *CARD]),
        "dpd_bands": final(POS_SQL, [*line, *bands("POS")]),
        "prev_amt_agg": final(summary_sql(PREVIOUS_SQL, M, "PREV_"), [key, *names(M, "PREV_")]),
        "prev_status_pivot": STATUS_SQL,
        "prev_d365_agg": final(
            summary_sql(PREVIOUS_SQL, M, "PREV_D365_", "DAYS_DECISION > -365"), [key, *names(M, "PREV_D365_")]
        ),
        "prev_agg": final(PREV_AGG, PREV_AGG_COLS),
        "bureau_day_amt_agg": final(summary_sql(BUREAU_SQL, _M, "BUREAU_"), [key, *names(_M, "BUREAU_")]),
        "bureau_active_agg": final(
            summary_sql(BUREAU_SQL, _M, "BUREAU_ACT_", "CREDIT_ACTIVE = 'Active'"), [key, *names(_M, "BUREAU_ACT_")]
        ),
        "bureau_d750_agg": final(
            summary_sql(BUREAU_SQL, _M, "BUREAU_ACT_", "DAYS_CREDIT > -750"), [key, *names(_M, "BUREAU_ACT_")]
        ),
        "bureau_bal_agg": BALANCE_SQL,
        "bureau_agg": final(BUREAU_AGG, BUREAU_COLS),
        "pos_bal_agg": final(POS_AGG, POS_COLS),
        "install_agg": final(INSTALMENT_AGG, INSTALMENT_COLS),
        "card_bal_agg": final(CARD_AGG, CARD_COLS),
        "applicant_features": final(FEATURES, FEATURE_COLS),
        "applicant_features_bucketed": final(FEATURES, FEATURE_COLS),
    }
