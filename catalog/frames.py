"""The given tables seen as lending tables.

Each frame is a list of column expressions valid in both Spark and DuckDB, so
both sides start from the same rows. ``@days(a; b)`` stands for a - b in days.
Amounts are whole cents held as doubles: their sums are exact in any order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_LOANS = "orders JOIN customer ON o_custkey = c_custkey"


def _whole(x: str) -> str:
    """Nearest whole number of a non-negative amount, as a double."""
    return f"CAST(floor({x} + 0.5e0) AS DOUBLE)"


def _cents(x: str) -> str:
    return _whole(f"{x} * 100")


def _gap(x: str, key: str, every: int) -> str:
    """Make the value missing for one row in ``every``."""
    return f"CASE WHEN {key} % {every} = 0 THEN NULL ELSE {x} END"


def _beside(key: str, every: int, rest: int) -> str:
    """The next key for one key in ``every``, so that some keys have no rows and no row is lost."""
    return f"CASE WHEN {key} % {every} = {rest} THEN {key} + 1 ELSE {key} END"


# name: (source, {column: expression})
FRAMES: dict[str, tuple[str, dict[str, str]]] = {
    "application": (
        "customer",
        {
            "SK_ID_CURR": "c_custkey",
            "TARGET": "CASE WHEN c_acctbal + (c_custkey * 7919) % 3001 < 1500 THEN 1 ELSE 0 END",
            "NAME_SEGMENT": _gap("c_mktsegment", "c_custkey", 29),
            "CODE_REGION": "c_nationkey",
            "FLAG_CAR": "CASE WHEN c_custkey % 3 = 0 THEN 'N' ELSE 'Y' END",
            "EXT_SOURCE_1": _gap("((c_custkey * 17) % 101) / 100e0", "c_custkey", 3),
            "EXT_SOURCE_2": _gap("((c_custkey * 23) % 97) / 100e0", "c_custkey", 6),
            "EXT_SOURCE_3": _gap("((c_custkey * 29) % 89) / 100e0", "c_custkey", 4),
            "AMT_CREDIT": _cents("c_acctbal"),
            "AMT_ANNUITY": _gap("CAST((c_custkey * 101) % 5000 AS DOUBLE)", "c_custkey", 13),
            "AMT_GOODS_PRICE": "CAST((c_custkey * 211) % 90000 AS DOUBLE)",
            "AMT_INCOME_TOTAL": "CAST((c_custkey * 307) % 7000 AS DOUBLE)",
            "CNT_FAM_MEMBERS": _gap("CAST(c_custkey % 6 AS DOUBLE)", "c_custkey", 41),
            "DAYS_BIRTH": "CAST(-7000 - (c_custkey * 13) % 18000 AS INT)",
            "DAYS_EMPLOYED": "CAST(0 - (c_custkey * 19) % 900 AS INT)",
            "DAYS_REGISTRATION": "CAST(0 - (c_custkey * 43) % 9000 AS DOUBLE)",
            "DAYS_ID_PUBLISH": "CAST(0 - (c_custkey * 47) % 6000 AS INT)",
            "DAYS_LAST_PHONE_CHANGE": "CAST(0 - (c_custkey * 53) % 4000 AS DOUBLE)",
            "REGION_POPULATION_RELATIVE": "c_nationkey / 500e0",
            "OWN_CAR_AGE": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 31 AS DOUBLE) END",
        },
    ),
    "previous_application": (
        "orders",
        {
            "SK_ID_PREV": "o_orderkey",
            "SK_ID_CURR": _beside("o_custkey", 11, 0),
            "NAME_CONTRACT_STATUS": "CASE WHEN o_custkey % 13 = 0 THEN 'Canceled' WHEN o_orderstatus = 'F' THEN "
            "'Approved' WHEN o_orderstatus = 'O' THEN 'Refused' ELSE 'Canceled' END",
            "AMT_CREDIT": "CASE WHEN o_orderkey % 17 = 0 THEN 0e0 ELSE " + _cents("o_totalprice") + " END",
            "AMT_ANNUITY": "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE " + _whole("o_totalprice * 10") + " END",
            "AMT_APPLICATION": "CASE WHEN o_orderkey % 19 = 0 THEN 0e0 ELSE " + _whole("o_totalprice * 97") + " END",
            "AMT_DOWN_PAYMENT": _gap(_whole("o_totalprice * 5"), "o_orderkey", 3),
            "AMT_GOODS_PRICE": _gap(_whole("o_totalprice * 90"), "o_orderkey", 5),
            "RATE_DOWN_PAYMENT": _gap("((o_orderkey * 31) % 100) / 100e0", "o_orderkey", 3),
            "CNT_PAYMENT": _gap("CAST(o_orderkey % 12 AS DOUBLE)", "o_orderkey", 23),
            "DAYS_DECISION": "@days(o_orderdate; date '2001-08-01')",
            "DAYS_FIRST_DRAWING": "CASE WHEN o_orderkey % 2 = 0 THEN 365243e0 ELSE CAST(0 - o_orderkey % 2900 AS DOUBLE) END",
            "DAYS_FIRST_DUE": "CASE WHEN o_orderkey % 9 = 0 THEN 365243e0 ELSE CAST(0 - o_orderkey % 2800 AS DOUBLE) END",
            "DAYS_LAST_DUE_1ST_VERSION": "CASE WHEN o_orderkey % 8 = 0 THEN 365243e0 ELSE CAST(0 - o_orderkey % 2700 AS DOUBLE) END",
            "DAYS_LAST_DUE": "CASE WHEN o_orderkey % 5 = 0 THEN 365243e0 ELSE CAST(0 - o_orderkey % 2500 AS DOUBLE) END",
            "DAYS_TERMINATION": "CASE WHEN o_orderkey % 4 = 0 THEN 365243e0 ELSE CAST(0 - o_orderkey % 2400 AS DOUBLE) END",
        },
    ),
    "bureau": (
        "lineitem",
        {
            "SK_ID_CURR": _beside("l_suppkey", 9, 0),
            "SK_ID_BUREAU": _gap("l_orderkey * 10 + l_linenumber", "l_orderkey", 31),
            "CREDIT_ACTIVE": "CASE WHEN l_suppkey % 7 = 0 THEN 'Closed' WHEN l_linestatus = 'O' THEN 'Active' ELSE 'Closed' END",
            "DAYS_CREDIT": "@days(l_shipdate; date '2001-11-04')",
            "CREDIT_DAY_OVERDUE": "CAST((l_orderkey * 7) % 200 - 60 AS INT)",
            "DAYS_CREDIT_ENDDATE": _gap("CAST((l_orderkey * 3) % 2000 - 1000 AS DOUBLE)", "l_orderkey", 6),
            "DAYS_ENDDATE_FACT": "CASE WHEN l_linestatus = 'O' THEN NULL ELSE CAST(0 - l_partkey % 1500 AS DOUBLE) END",
            "AMT_CREDIT_MAX_OVERDUE": "CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE " + _whole("l_extendedprice * l_discount * 100") + " END",
            "AMT_CREDIT_SUM": "CASE WHEN l_orderkey % 37 = 0 THEN 0e0 ELSE " + _cents("l_extendedprice") + " END",
            "AMT_CREDIT_SUM_DEBT": _gap(_whole("l_extendedprice * l_tax * 100"), "l_linenumber", 5),
            "AMT_CREDIT_SUM_OVERDUE": _whole("l_extendedprice * l_discount * 10"),
            "AMT_ANNUITY": _gap(_whole("l_quantity * 100"), "l_partkey", 4),
        },
    ),
    # One balance row per line, attached to credits by line number 1..4 of the same order.
    "bureau_balance": (
        "lineitem",
        {
            "SK_ID_BUREAU": "l_orderkey * 10 + CAST(1 + l_linenumber % 4 AS INT)",
            "MONTHS_BALANCE": "CAST(0 - (l_partkey + l_linenumber) % 97 AS INT)",
            "STATUS": "CASE WHEN l_partkey % 9 = 0 THEN 'C' WHEN l_partkey % 10 = 0 THEN NULL ELSE CAST(l_linenumber AS VARCHAR(2)) END",
        },
    ),
    "pos_cash_balance": (
        "events",
        {
            "SK_ID_PREV": "event_id",
            "SK_ID_CURR": _gap("user_id", "event_id", 43),
            "MONTHS_BALANCE": "@days(ts; date '2024-01-31')",
            "SK_DPD": "CAST(floor(value) AS INT) - 20",
            "SK_DPD_DEF": "CAST(event_id % 3 AS INT)",
            "CNT_INSTALMENT": _gap("CAST(event_id % 48 AS DOUBLE)", "event_id", 7),
            "CNT_INSTALMENT_FUTURE": "CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(event_id % 36 AS DOUBLE) END",
        },
    ),
    "installments_payments": (
        _LINES,
        {
            "SK_ID_PREV": "l_orderkey",
            "SK_ID_CURR": _beside("o_custkey", 10, 3),
            "NUM_INSTALMENT_VERSION": _gap("CAST(l_linenumber AS DOUBLE)", "l_partkey", 6),
            "NUM_INSTALMENT_NUMBER": "l_linenumber",
            "DAYS_INSTALMENT": "CAST(@days(o_orderdate; date '2001-08-01') AS DOUBLE)",
            "DAYS_ENTRY_PAYMENT": "CAST(CASE WHEN l_partkey % 21 = 0 THEN NULL ELSE @days(l_shipdate; date '2001-08-01') END AS DOUBLE)",
            "AMT_INSTALMENT": _cents("l_extendedprice"),
            "AMT_PAYMENT": _gap(_whole("l_extendedprice * (1 - l_discount) * 100"), "l_partkey", 21),
        },
    ),
    "credit_card_balance": (
        _LINES,
        {
            "SK_ID_PREV": "l_orderkey",
            "SK_ID_CURR": _beside("o_custkey", 4, 1),
            "MONTHS_BALANCE": "CAST(0 - (l_orderkey + l_linenumber) % 40 AS INT)",
            "AMT_BALANCE": _whole("l_tax * 100"),
            "AMT_CREDIT_LIMIT_ACTUAL": "CAST(floor(l_discount * 100 + 0.5e0) AS INT)",
            "AMT_DRAWINGS_ATM_CURRENT": _gap(_whole("l_quantity"), "l_partkey", 3),
            "AMT_DRAWINGS_CURRENT": _whole("l_quantity * l_discount * 100"),
            "AMT_DRAWINGS_POS_CURRENT": "CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE " + _whole("l_quantity * 3") + " END",
            "AMT_INST_MIN_REGULARITY": _gap(_whole("l_extendedprice"), "l_partkey", 5),
            "AMT_PAYMENT_TOTAL_CURRENT": _cents("l_extendedprice"),
            "AMT_TOTAL_RECEIVABLE": _whole("l_extendedprice * 7"),
            "CNT_DRAWINGS_ATM_CURRENT": _gap("CAST(l_linenumber AS DOUBLE)", "l_partkey", 4),
            "CNT_DRAWINGS_CURRENT": "CAST(l_quantity AS INT)",
            "CNT_DRAWINGS_POS_CURRENT": _gap("CAST(l_linenumber * 2 AS DOUBLE)", "l_partkey", 8),
            "SK_DPD": "CAST((l_orderkey * 11) % 260 - 90 AS INT)",
        },
    ),
    "loans": (
        _LOANS,
        {
            "id": "o_orderkey",
            "addr_state": "concat('S', CAST(c_nationkey AS VARCHAR(3)))",
            "annual_inc": _gap("CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0e0 END", "o_orderkey", 101),
            "application_type": "CASE WHEN o_orderkey % 4 = 2 THEN 'Joint App' ELSE 'Individual' END",
            "dti": _gap("((o_custkey * 37 + o_orderkey) % 400) / 10e0", "o_orderkey", 53),
            "earliest_cr_line": "concat('Jan-', CAST(1970 + c_custkey % 40 AS VARCHAR(4)))",
            "emp_length": "CASE WHEN c_custkey % 13 = 0 THEN '< 1 year' WHEN c_custkey % 13 = 10 THEN '10+ years' "
            "WHEN c_custkey % 13 = 11 THEN NULL ELSE concat(CAST(c_custkey % 13 AS VARCHAR(2)), ' years') END",
            "fico_range_high": "CAST(604 + (c_custkey * 5) % 246 AS DOUBLE)",
            "fico_range_low": "CAST(600 + (c_custkey * 5) % 246 AS DOUBLE)",
            "home_ownership": "CASE c_custkey % 6 WHEN 0 THEN 'RENT' WHEN 1 THEN 'OWN' WHEN 2 THEN 'NONE' WHEN 3 THEN "
            "'ANY' WHEN 4 THEN 'OTHER' ELSE 'MORTGAGE' END",
            "initial_list_status": "CASE WHEN o_orderkey % 3 = 0 THEN 'f' ELSE 'w' END",
            "installment": _whole("o_totalprice / 36"),
            "int_rate": "(500 + (o_orderkey * 13) % 2000) / 100e0",
            "issue_d": "o_orderdate",
            "loan_amnt": _whole("o_totalprice"),
            "loan_status": "CASE o_orderstatus WHEN 'F' THEN 'Fully Paid' WHEN 'O' THEN 'Charged Off' ELSE 'Current' END",
            "mort_acc": _gap("CAST(c_custkey % 9 AS DOUBLE)", "o_orderkey", 19),
            "open_acc": "CAST(c_custkey % 33 AS DOUBLE)",
            "pub_rec": "CAST(c_custkey % 4 AS DOUBLE)",
            "pub_rec_bankruptcies": _gap("CAST(c_custkey % 3 AS DOUBLE)", "o_orderkey", 67),
            "purpose": "o_orderpriority",
            "revol_bal": "CAST((o_orderkey * 17) % 50000 AS DOUBLE)",
            "revol_util": _gap("((o_orderkey * 29) % 1100) / 10e0", "o_orderkey", 71),
            "sub_grade": "concat(substring('ABCDEFG', CAST(1 + o_orderkey % 7 AS INT), 1), CAST(1 + o_orderkey % 5 AS VARCHAR(1)))",
            "term": "CASE WHEN o_orderkey % 4 = 0 THEN ' 60 months' ELSE ' 36 months' END",
            "total_acc": "CAST(c_custkey % 71 AS DOUBLE)",
            "verification_status": "CASE o_orderkey % 3 WHEN 0 THEN 'Verified' WHEN 1 THEN 'Source Verified' ELSE 'Not Verified' END",
        },
    ),
    "vectors": (
        "embeddings",
        {"row_id": "vec_id", "label": "CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END", "cluster_id": "label", "x": "embedding"},
    ),
    "scored": (
        "orders",
        {
            "row_id": "o_orderkey",
            "batch_id": "o_orderkey % 10",
            "label": "CASE WHEN o_orderkey % 10 = 9 THEN 1 WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END",
            "p": "((o_orderkey * 7919 + o_custkey * 31) % 1001) / 1000e0",
        },
    ),
}


def _days(expr: str, engine: str) -> str:
    spark = r"datediff(\1, \2)"
    duck = r"CAST(date_diff('day', CAST(\2 AS DATE), CAST(\1 AS DATE)) AS INTEGER)"
    return re.sub(r"@days\(([^;]+); ([^)]+)\)", spark if engine == "spark" else duck, expr)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = FRAMES[name]
    if source == _LINES:
        rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), _on("l_orderkey", "o_orderkey"))
    elif source == _LOANS:
        rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), _on("o_custkey", "c_custkey"))
    else:
        rows = table(spark, sf_dir, source)
    return rows.selectExpr(*[f"{_days(e, 'spark')} AS {c}" for c, e in columns.items()])


def _on(a: str, b: str):
    from pyspark.sql import functions as F

    return F.col(a) == F.col(b)


def frame_sql(name: str) -> str:
    source, columns = FRAMES[name]
    body = ", ".join(f"{_days(e, 'duck')} AS {c}" for c, e in columns.items())
    return f"SELECT {body} FROM {source}"


def lending_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    names = [
        "application",
        "previous_application",
        "bureau",
        "bureau_balance",
        "pos_cash_balance",
        "installments_payments",
        "credit_card_balance",
    ]
    return {n: frame(spark, sf_dir, n) for n in names}
