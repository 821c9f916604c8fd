"""The wide loan table: cleaning, column roles, encoding, splits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import leading_int, log10_plus1, midpoint, remap, trailing_year
from riskloom.operators import encode, scale, split
from riskloom.operators.profile import require_dense, value_shares
from riskloom.session import materialise

# ---- Fixed values: kept columns, statuses and replacements ----

KEPT_COLUMNS = [
    "addr_state",
    "annual_inc",
    "application_type",
    "dti",
    "earliest_cr_line",
    "emp_length",
    "fico_range_high",
    "fico_range_low",
    "home_ownership",
    "initial_list_status",
    "installment",
    "int_rate",
    "issue_d",
    "loan_amnt",
    "loan_status",
    "mort_acc",
    "open_acc",
    "pub_rec",
    "pub_rec_bankruptcies",
    "purpose",
    "revol_bal",
    "revol_util",
    "sub_grade",
    "term",
    "total_acc",
    "verification_status",
]
FINAL_STATUSES = ["Fully Paid", "Charged Off"]
DEFAULT_STATUS = "Charged Off"
EMPLOYMENT_NAMES = {"10+ years": "10 years", "< 1 year": "0 years"}
OWNERSHIP_NAMES = {"NONE": "OTHER", "ANY": "OTHER"}
MAX_MISSING_SHARE = 0.3

# ---- End of fixed values ----

LABEL, DATE = "loan_label", "issue_d"


def settled(loans: DataFrame) -> DataFrame:
    return loans.filter(F.col("loan_status").isin(FINAL_STATUSES))


def keep_columns(loans: DataFrame, keys: Sequence[str] = (), check: bool = False) -> DataFrame:
    """The 26 kept columns, preceded by row keys; ``check`` rejects sparse ones by name."""
    if check:
        require_dense(loans, KEPT_COLUMNS, MAX_MISSING_SHARE)
    return loans.select(*keys, *KEPT_COLUMNS)


def clean_loans(loans: DataFrame, keys: Sequence[str] = (), check: bool = False) -> DataFrame:
    """Settled loans with parsed terms, years and employment, log amounts, score and label."""
    rows = keep_columns(settled(loans), keys, check)
    replaced = {
        "term": leading_int("term"),
        "emp_length": leading_int(remap("emp_length", EMPLOYMENT_NAMES)),
        "home_ownership": remap("home_ownership", OWNERSHIP_NAMES),
        "earliest_cr_line": trailing_year("earliest_cr_line"),
    }
    gone = {"annual_inc", "fico_range_high", "fico_range_low", "revol_bal", "loan_status"}
    return rows.select(
        *[replaced.get(c, F.col(c)).alias(c) for c in rows.columns if c not in gone],
        log10_plus1("annual_inc").alias("log_annual_inc"),
        midpoint("fico_range_low", "fico_range_high").alias("fico_score"),
        log10_plus1("revol_bal").alias("log_revol_bal"),
        (F.col("loan_status") == DEFAULT_STATUS).cast("int").alias(LABEL),
    )


def term_shares(loans: DataFrame) -> DataFrame:
    return value_shares(settled(loans).select(leading_int("term").alias("term")), "term")


@dataclass(frozen=True)
class LoanTable:
    """A prepared table, the columns of each role, and the size of the code dictionary."""

    rows: DataFrame
    values: list[str]
    codes: list[str]
    n_codes: int = 0


def coded_loans(loans: DataFrame, keys: Sequence[str], order: Sequence[str]) -> LoanTable:
    """Scaled value columns and shared-dictionary codes, for the graph model."""
    clean = materialise(clean_loans(loans, keys), "clean")
    values, codes = encode.roles_by_count(clean, [*keys, LABEL, DATE])
    rows = scale.min_max_scale(clean, values, fill=False)
    rows, n = encode.bag_encode(rows, codes, order)
    return LoanTable(rows.fillna(0.0, subset=values), values, codes, n)


def indicator_loans(loans: DataFrame, keys: Sequence[str]) -> LoanTable:
    """Text as indicator vectors without the first level, everything scaled, for the baselines."""
    clean = materialise(clean_loans(loans, keys), "clean")
    text = [c for c in encode.text_columns(clean) if c not in set(keys)]
    numbers = [c for c in clean.columns if c not in {*keys, *text, LABEL, DATE}]
    # An indicator is 1 in some row and 0 in another, so scaling would not change it.
    rows, flags = encode.one_hot_vectors(scale.min_max_scale(clean, numbers), text, drop_first=True)
    return LoanTable(rows.drop(*text), [*numbers, *flags], [])


def category_loans(loans: DataFrame, keys: Sequence[str]) -> LoanTable:
    """Text as sorted category codes, everything scaled, for the perceptron."""
    clean = materialise(clean_loans(loans, keys), "clean")
    text = [c for c in encode.text_columns(clean) if c not in set(keys)]
    rows = encode.category_codes(clean, text)
    values = [c for c in rows.columns if c not in {*keys, LABEL, DATE}]
    return LoanTable(scale.min_max_scale(rows, values), values, [])


def wide_loans(
    loans: DataFrame, keys: Sequence[str], order: Sequence[str], named: bool = False
) -> tuple[LoanTable, list[str]]:
    """As ``coded_loans``, with indicators of all text levels next to it (second result).

    They are sparse vectors, one per text column; with ``named`` a column per level, which suits few levels only.
    """
    clean = materialise(clean_loans(loans, keys), "clean")
    text = [c for c in encode.text_columns(clean) if c not in set(keys)]
    values, codes = encode.roles_by_count(clean, [*keys, LABEL, DATE])
    if named:
        levels = encode.column_levels(clean, text)
        wide = [encode.level_name(c, v) for c in text for v in levels[c]]
        rows = encode.one_hot(clean, levels, keep=True)
    else:
        rows, wide = encode.one_hot_vectors(clean, text)
    rows = scale.min_max_scale(rows, values)
    rows, n = encode.bag_encode(rows, codes, order)
    return LoanTable(rows, values, codes, n), wide


def split_loans(rows: DataFrame, share: float = 0.9) -> tuple[DataFrame, DataFrame]:
    return split.time_split(rows, DATE, share)
