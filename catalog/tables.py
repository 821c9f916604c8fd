"""Queries and SQL for sources, cleaning, profiles, encoding, splits and class balance."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.frames import FRAMES, frame, frame_sql, table
from riskloom.functions import scalars as S
from riskloom.operators import balance, encode, profile, scale, split, vectors
from riskloom.operators.running import with_row_ids
from riskloom.plans import loans as L
from riskloom.session import new_path
from riskloom.sources import tables as sources

LOANS = frame_sql("loans")
APPS = frame_sql("application")
DIM = 64  # elements of the given vectors
STATUS = "loan_status IN ('Fully Paid', 'Charged Off')"


def rounded(df: DataFrame, columns, digits: int) -> DataFrame:
    chosen = set(columns)
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if c in chosen else F.col(c) for c in df.columns])


def _round(e: str, digits: int, name: str) -> str:
    return f"round({e}, {digits}) + 0e0 AS {name}"


# -- SQL pieces ----------------------------------------------------------------------

_EMP = (
    "TRY_CAST(regexp_extract(CASE emp_length WHEN '10+ years' THEN '10 years' WHEN '< 1 year' THEN '0 years' "
    "ELSE emp_length END, '^([0-9]+)', 1) AS INTEGER)"
)
_OWN = "CASE WHEN home_ownership IN ('NONE', 'ANY') THEN 'OTHER' ELSE home_ownership END"
_TERM = "TRY_CAST(regexp_extract(trim(term), '^([0-9]+)', 1) AS INTEGER)"
_YEAR = "TRY_CAST(right(earliest_cr_line, 4) AS INTEGER)"
_CLEAN = {
    "id": "id",
    "addr_state": "addr_state",
    "application_type": "application_type",
    "dti": "dti",
    "earliest_cr_line": _YEAR,
    "emp_length": _EMP,
    "home_ownership": _OWN,
    "initial_list_status": "initial_list_status",
    "installment": "installment",
    "int_rate": "int_rate",
    "issue_d": "issue_d",
    "loan_amnt": "loan_amnt",
    "mort_acc": "mort_acc",
    "open_acc": "open_acc",
    "pub_rec": "pub_rec",
    "pub_rec_bankruptcies": "pub_rec_bankruptcies",
    "purpose": "purpose",
    "revol_util": "revol_util",
    "sub_grade": "sub_grade",
    "term": _TERM,
    "total_acc": "total_acc",
    "verification_status": "verification_status",
    "log_annual_inc": "log10(annual_inc + 1)",
    "fico_score": "0.5e0 * fico_range_low + 0.5e0 * fico_range_high",
    "log_revol_bal": "log10(revol_bal + 1)",
    "loan_label": "CASE WHEN loan_status = 'Charged Off' THEN 1 ELSE 0 END",
}
CLEAN = f"SELECT {', '.join(f'{e} AS {n}' for n, e in _CLEAN.items())} FROM ({LOANS}) WHERE {STATUS}"
_LOGS = ["log_annual_inc", "log_revol_bal"]
CLEAN_ROUNDED = CLEAN.replace("log10(annual_inc + 1)", "round(log10(annual_inc + 1), 9)").replace(
    "log10(revol_bal + 1)", "round(log10(revol_bal + 1), 9)"
)

_APP_COLUMNS = ["SK_ID_CURR", "NAME_SEGMENT", "CODE_REGION", "FLAG_CAR", "EXT_SOURCE_1", "AMT_ANNUITY", "CNT_FAM_MEMBERS", "DAYS_EMPLOYED"]


def _per_column(expr: str, out: str, columns, source: str) -> str:
    """One SELECT per column: simple, and independent of the one-pass form."""
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {expr.format(c=c)} AS {out} FROM ({source})" for c in columns)


def _rank_codes(source: str, columns, order: str, missing: str) -> dict[str, str]:
    """code expression per column: order of first appearance, by a self-contained subquery."""
    out = {}
    for c in columns:
        out[c] = (
            f"(SELECT code FROM (SELECT v, CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS code FROM "
            f"(SELECT {c} AS v, min({order}) AS first FROM ({source}) {missing.format(c=c)} GROUP BY 1)) d "
            f"WHERE d.v IS NOT DISTINCT FROM t.{c})"
        )
    return out


FACTOR_COLUMNS = ["NAME_SEGMENT", "FLAG_CAR"]
BAG_COLUMNS = ["NAME_SEGMENT", "CODE_REGION", "FLAG_CAR", "CNT_FAM_MEMBERS", "OWN_CAR_AGE"]
CATEGORY_COLUMNS = ["addr_state", "application_type", "home_ownership", "initial_list_status", "purpose", "sub_grade", "verification_status"]


def _bag_sql() -> str:
    parts = [
        f"SELECT {i} AS i, CAST({c} AS VARCHAR) AS v, min(SK_ID_CURR) AS first FROM ({APPS}) GROUP BY 1, 2"
        for i, c in enumerate(BAG_COLUMNS)
    ]
    codes = f"SELECT i, v, CAST(row_number() OVER (ORDER BY i, first) - 1 AS INTEGER) AS code FROM ({' UNION ALL '.join(parts)})"
    joins = " ".join(
        f"LEFT JOIN codes c{i} ON c{i}.i = {i} AND c{i}.v IS NOT DISTINCT FROM CAST(t.{c} AS VARCHAR)"
        for i, c in enumerate(BAG_COLUMNS)
    )
    cols = ", ".join(f"c{i}.code AS {c}" for i, c in enumerate(BAG_COLUMNS))
    return f"WITH codes AS ({codes}) SELECT t.SK_ID_CURR, {cols}, (SELECT count(*) FROM codes) AS n_codes FROM ({APPS}) t {joins}"


SCALED = [c for c in _CLEAN if c not in (*CATEGORY_COLUMNS, "id", "issue_d", "loan_label")]
_APP_TEXT = ["NAME_SEGMENT", "FLAG_CAR"]
FILL_FIRST = [c for c in FRAMES["application"][1] if c not in (*_APP_TEXT, "SK_ID_CURR", "TARGET")]


def _scaled(c: str, lo: str, hi: str) -> str:
    return f"coalesce(CASE WHEN {hi} <> {lo} THEN ({c} - {lo}) / CAST({hi} - {lo} AS DOUBLE) END, 0e0)"


_RANK = "(row_id * 7919) % 10007"
SCORED = frame_sql("scored")
VECTORS = frame_sql("vectors")


# -- queries ---------------------------------------------------------------------------


def queries():
    def loans(spark, sf):
        return frame(spark, sf, "loans")

    def apps(spark, sf):
        return frame(spark, sf, "application")

    def clean(spark, sf):
        return L.clean_loans(loans(spark, sf), ["id"])

    def scan_typed(spark, sf):
        path = new_path(spark, "csv")
        frame(spark, sf, "pos_cash_balance").write.option("header", True).option("nullValue", "NA").csv(path)
        return sources.read_typed(spark, path, sources.POS_CASH_TYPES)

    def scan_inferred(spark, sf):
        path = new_path(spark, "csv")
        frame(spark, sf, "previous_application").write.option("header", True).option("nullValue", "N/A").csv(path)
        return sources.read_inferred(spark, path)

    def scan_text(spark, sf):
        path = new_path(spark, "csv")
        out = table(spark, sf, "documents").write.option("header", True).option("quoteAll", True).option("escape", '"')
        out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
        kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
        return sources.read_typed(spark, path, kinds, multi_line=True)

    def parse_issue_date(spark, sf):
        text = loans(spark, sf).select("id", F.date_format("issue_d", "MMM-yyyy").alias("issue_d"))
        return text.select("id", S.to_date_time("issue_d", "MMM-yyyy").cast("timestamp_ntz").alias("issue_d"))

    def hot_places(spark, sf):
        rows, names = encode.one_hot_vectors(clean(spark, sf).select("id", *CATEGORY_COLUMNS), CATEGORY_COLUMNS)
        place = {n: F.coalesce(F.array_position(vector_to_array(n), 1.0), F.lit(0)) - 1 for n in names}
        return rows.select("id", *[place.get(f"{c}_levels", F.lit(-1).cast("bigint")).alias(c) for c in CATEGORY_COLUMNS])

    def logged_figures(spark, sf):
        path, log = new_path(spark, "applicants"), new_path(spark, "log")
        rows = apps(spark, sf)
        figures = {"n_rows": F.count(F.lit(1)), "n_positive": F.count(F.when(F.col("TARGET") == 1, 1)), "highest_key": F.max("SK_ID_CURR")}
        sources.write_logged(rows, path, log, "first", figures)
        return spark.read.parquet(log)

    def feature_roundtrip(spark, sf):
        path = new_path(spark, "vectors")
        sources.write_vectors(frame(spark, sf, "vectors"), path, "x")
        back = sources.read_vectors(spark, path)
        total = F.aggregate("feature_intermediate", F.lit(0.0), lambda a, v: a + v)
        return back.select("row_id", F.size("feature_intermediate").alias("n"), F.round(total, 6).alias("total"))

    def feature_combine(spark, sf):
        base = apps(spark, sf).select(F.col("SK_ID_CURR").alias("row_id"), "AMT_ANNUITY")
        return vectors.combine(base, frame(spark, sf, "vectors"), "x", DIM)

    def roles_name(spark, sf):
        from riskloom.plans.applicants import application_columns

        rows = application_columns(apps(spark, sf))
        values, codes = encode.roles_by_name(rows, ["SK_ID_CURR", "TARGET"])
        return _role_table(rows, values, codes)

    def roles_count(spark, sf):
        rows = clean(spark, sf)
        return _role_table(rows, *encode.roles_by_count(rows, ["id", L.LABEL, L.DATE]))

    def bag(spark, sf):
        rows = apps(spark, sf).select("SK_ID_CURR", *BAG_COLUMNS)
        coded, n = encode.bag_encode(rows, BAG_COLUMNS, ["SK_ID_CURR"])
        return coded.withColumn("n_codes", F.lit(n).cast("bigint"))

    def splits(pair):
        early, late = pair
        return early.withColumn("part", F.lit("train")).unionByName(late.withColumn("part", F.lit("test")))

    def scored(spark, sf):
        return frame(spark, sf, "scored")

    return {
        "scan_typed": scan_typed,
        "scan_inferred": scan_inferred,
        "scan_text": scan_text,
        "parse_issue_date": parse_issue_date,
        "sample_rows": lambda s, d: sources.sample_rows(scored(s, d), 0.01, "row_id"),
        "feature_roundtrip": feature_roundtrip,
        "one_hot_vectors": hot_places,
        "logged_figures": logged_figures,
        "keep_columns": lambda s, d: L.keep_columns(loans(s, d), ["id"], check=True),
        "status_filter": lambda s, d: L.settled(loans(s, d)).select("id", "loan_status"),
        "value_remap": lambda s, d: loans(s, d).select(
            "id",
            S.remap("emp_length", L.EMPLOYMENT_NAMES).alias("emp_length"),
            S.remap("home_ownership", L.OWNERSHIP_NAMES).alias("home_ownership"),
        ),
        "leading_int": lambda s, d: loans(s, d).select(
            "id",
            S.leading_int("term").alias("term"),
            S.leading_int(S.remap("emp_length", L.EMPLOYMENT_NAMES)).alias("emp_length"),
        ),
        "trailing_year": lambda s, d: loans(s, d).select("id", S.trailing_year("earliest_cr_line").alias("year")),
        "log_amounts": lambda s, d: rounded(
            loans(s, d).select(
                "id", S.log10_plus1("annual_inc").alias("log_annual_inc"), S.log10_plus1("revol_bal").alias("log_revol_bal")
            ),
            _LOGS,
            9,
        ),
        "fill_zero": lambda s, d: S.fill_missing(apps(s, d).select(*_APP_COLUMNS), 0, ["EXT_SOURCE_1", "AMT_ANNUITY"]),
        "loan_clean": lambda s, d: rounded(clean(s, d), _LOGS, 9),
        "missing_profile": lambda s, d: rounded(profile.missing_shares(L.settled(loans(s, d))), ["missing_share"], 9),
        "distinct_profile": lambda s, d: profile.distinct_counts(clean(s, d)),
        "zero_profile": lambda s, d: rounded(profile.zero_shares(apps(s, d)), ["zero_share"], 9),
        "term_share": lambda s, d: rounded(L.term_shares(loans(s, d)), ["share"], 9),
        "class_ratio": lambda s, d: profile.class_counts(clean(s, d), L.LABEL),
        "factorize": lambda s, d: encode.factorize(apps(s, d).select("SK_ID_CURR", *FACTOR_COLUMNS), FACTOR_COLUMNS, ["SK_ID_CURR"]),
        "bag_encode": bag,
        "category_codes": lambda s, d: encode.category_codes(clean(s, d).select("id", *CATEGORY_COLUMNS), CATEGORY_COLUMNS),
        "one_hot_drop_first": lambda s, d: _plain_names(
            encode.one_hot_drop_first(clean(s, d).select("id", *CATEGORY_COLUMNS))
        ),
        "one_hot_wide": lambda s, d: encode.one_hot_few(
            apps(s, d).select("SK_ID_CURR", "CODE_REGION", "NAME_SEGMENT", "FLAG_CAR", "TARGET").fillna("none", ["NAME_SEGMENT"]),
            ["CODE_REGION", "NAME_SEGMENT", "FLAG_CAR", "TARGET"],
        ),
        "minmax_scale": lambda s, d: rounded(
            scale.min_max_scale(clean(s, d).select("id", *SCALED), SCALED), SCALED, 9
        ),
        "minmax_fill_first": lambda s, d: rounded(
            scale.fill_then_min_max(apps(s, d).select("SK_ID_CURR", *FILL_FIRST), FILL_FIRST), FILL_FIRST, 9
        ),
        "column_roles_name": roles_name,
        "column_roles_card": roles_count,
        "row_ids": lambda s, d: with_row_ids(
            table(s, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]
        ),
        "time_split": lambda s, d: splits(L.split_loans(clean(s, d).select("id", L.DATE))),
        "modulo_split": lambda s, d: splits(
            split.modulo_split(table(s, d, "orders").select("o_orderkey", "o_custkey"), 0.1, ["o_custkey", "o_orderkey"])
        ),
        "rebalance_up": lambda s, d: balance.repeat_positives(scored(s, d), "label", 3),
        "rebalance_down": lambda s, d: balance.sample_negatives(
            scored(s, d), "label", 0.3, ["row_id"], F.pmod(F.col("row_id") * 7919, F.lit(10007)), 10007
        ),
        "class_weights": lambda s, d: balance.with_class_weights(scored(s, d).select("row_id", "label"), "label"),
        "feature_combine": feature_combine,
    }


def _plain_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(" ", "_") for c in df.columns])


def _role_table(df: DataFrame, values, codes) -> DataFrame:
    """(column, role) with the row count of the table, so the result follows the data."""
    pairs = [F.struct(F.lit(c).alias("column"), F.lit(r).alias("role")) for r, cs in (("value", values), ("code", codes)) for c in cs]
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(*pairs)), "n").select("column", "role", "n")


def oracle():
    from catalog.history import APP_COLS, APP_SQL

    prev = frame_sql("previous_application")
    name_rule = " OR ".join(f"contains(\"column\", '{p}')" for p in encode.VALUE_NAME_PARTS)
    forced = ", ".join(f"'{c}'" for c in encode.FORCED_VALUE_COLUMNS)
    app_cols = [c for c in APP_COLS if c not in ("SK_ID_CURR", "TARGET")]
    clean_cols = [c for c in _CLEAN if c not in ("id", "loan_label", "issue_d")]
    counts = "count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)"
    factor = _rank_codes(APPS, FACTOR_COLUMNS, "SK_ID_CURR", "WHERE {c} IS NOT NULL")
    hot = {  # sorted levels; the first gets no indicator
        "addr_state": sorted(f"S{n}" for n in range(25)),
        "application_type": ["Individual", "Joint App"],
        "home_ownership": ["MORTGAGE", "OTHER", "OWN", "RENT"],
        "initial_list_status": ["f", "w"],
        "purpose": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
        "sub_grade": [f"{a}{b}" for a in "ABCDEFG" for b in range(1, 6)],
        "verification_status": ["Not Verified", "Source Verified", "Verified"],
    }
    hot_sql = ", ".join(
        f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v.replace(' ', '_')}\"" for c, vs in hot.items() for v in vs[1:]
    )
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "none"]
    wide = {"NAME_SEGMENT": [f"'{v}'" for v in segments], "FLAG_CAR": ["'N'", "'Y'"], "TARGET": ["0", "1"]}
    wide_sql = ", ".join(
        f"CASE WHEN {c} = {v} THEN 1 ELSE 0 END AS {c}_{v.strip(chr(39))}" for c, vs in wide.items() for v in vs
    )
    wide_rows = (
        f"SELECT SK_ID_CURR, CODE_REGION, coalesce(NAME_SEGMENT, 'none') AS NAME_SEGMENT, FLAG_CAR, TARGET FROM ({APPS})"
    )
    ranges = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in SCALED)
    filled = f"SELECT SK_ID_CURR, {', '.join(f'coalesce({c}, 0) AS {c}' for c in FILL_FIRST)} FROM ({APPS})"
    fill_ranges = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in FILL_FIRST)
    inferred = (
        "SK_ID_PREV, SK_ID_CURR, NAME_CONTRACT_STATUS, AMT_CREDIT, AMT_ANNUITY, AMT_APPLICATION, AMT_DOWN_PAYMENT, "
        "AMT_GOODS_PRICE, RATE_DOWN_PAYMENT, CNT_PAYMENT, CAST(DAYS_DECISION AS BIGINT) AS DAYS_DECISION, "
        "DAYS_FIRST_DRAWING, DAYS_FIRST_DUE, DAYS_LAST_DUE_1ST_VERSION, DAYS_LAST_DUE, DAYS_TERMINATION"
    )
    days = "date_trunc('month', o_orderdate)"
    elements = ", ".join(f"coalesce(CAST(x[{i + 1}] AS DOUBLE), 0e0) AS feature_nn{i}" for i in range(DIM))
    return {
        "scan_typed": frame_sql("pos_cash_balance"),
        "scan_inferred": f"SELECT {inferred} FROM ({prev})",
        "scan_text": "SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents",
        "parse_issue_date": f"SELECT o_orderkey AS id, {days} AS issue_d FROM orders JOIN customer ON o_custkey = c_custkey",
        "sample_rows": f"SELECT * FROM ({SCORED}) WHERE row_id % 100 = 0",
        "feature_roundtrip": "SELECT vec_id AS row_id, CAST(len(embedding) AS INTEGER) AS n, "
        "round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings",
        "keep_columns": f"SELECT id, {', '.join(L.KEPT_COLUMNS)} FROM ({LOANS})",
        "status_filter": f"SELECT id, loan_status FROM ({LOANS}) WHERE {STATUS}",
        "value_remap": f"SELECT id, CASE emp_length WHEN '10+ years' THEN '10 years' WHEN '< 1 year' THEN '0 years' ELSE "
        f"emp_length END AS emp_length, {_OWN} AS home_ownership FROM ({LOANS})",
        "leading_int": f"SELECT id, {_TERM} AS term, {_EMP} AS emp_length FROM ({LOANS})",
        "trailing_year": f"SELECT id, {_YEAR} AS year FROM ({LOANS})",
        "log_amounts": f"SELECT id, {_round('log10(annual_inc + 1)', 9, 'log_annual_inc')}, "
        f"{_round('log10(revol_bal + 1)', 9, 'log_revol_bal')} FROM ({LOANS})",
        "fill_zero": "SELECT SK_ID_CURR, NAME_SEGMENT, CODE_REGION, FLAG_CAR, coalesce(EXT_SOURCE_1, 0) AS EXT_SOURCE_1, "
        f"coalesce(AMT_ANNUITY, 0) AS AMT_ANNUITY, CNT_FAM_MEMBERS, DAYS_EMPLOYED FROM ({APPS})",
        "loan_clean": CLEAN_ROUNDED,
        "missing_profile": _per_column(
            "round(avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END), 9) + 0e0",
            "missing_share",
            ["id", *L.KEPT_COLUMNS],
            f"SELECT * FROM ({LOANS}) WHERE {STATUS}",
        ),
        "distinct_profile": _per_column(counts, "n_distinct", list(_CLEAN), CLEAN),
        "zero_profile": _zero_sql(),
        "term_share": f"SELECT term, round(count(*) / CAST((SELECT count(*) FROM ({LOANS}) WHERE {STATUS}) AS DOUBLE), 9) + 0e0 "
        f"AS share FROM (SELECT {_TERM} AS term FROM ({LOANS}) WHERE {STATUS}) GROUP BY term",
        "class_ratio": "SELECT count(*) FILTER (WHERE loan_label = 0) AS n_neg, count(*) FILTER (WHERE loan_label = 1) AS n_pos, "
        "CAST(count(*) FILTER (WHERE loan_label = 0) AS DOUBLE) / count(*) FILTER (WHERE loan_label = 1) AS ratio "
        f"FROM ({CLEAN})",
        "factorize": f"SELECT SK_ID_CURR, {', '.join(f'coalesce({e}, -1) AS {c}' for c, e in factor.items())} FROM ({APPS}) t",
        "bag_encode": _bag_sql(),
        "category_codes": "SELECT id, "
        + ", ".join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}" for c in CATEGORY_COLUMNS)
        + f" FROM ({CLEAN})",
        "one_hot_drop_first": f"SELECT id, {hot_sql} FROM ({CLEAN})",
        "one_hot_vectors": f"WITH c AS MATERIALIZED ({CLEAN}) SELECT id, " + ", ".join(
            f"CASE WHEN {c} IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY {c} NULLS LAST) - 1 END AS {c}" for c in CATEGORY_COLUMNS
        ) + " FROM c",
        "logged_figures": "SELECT 'first' AS run_id, CAST(0 AS INTEGER) AS step, unnest(['n_rows', 'n_positive', 'highest_key']) AS name, "
        "unnest([CAST(count(*) AS VARCHAR), CAST(count(*) FILTER (WHERE TARGET = 1) AS VARCHAR), CAST(max(SK_ID_CURR) AS VARCHAR)]) AS value "
        f"FROM ({frame_sql('application')})",
        "one_hot_wide": f"SELECT *, {wide_sql} FROM ({wide_rows})",
        "minmax_scale": f"SELECT id, {', '.join(_round(_scaled(c, 'lo_' + c, 'hi_' + c), 9, c) for c in SCALED)} "
        f"FROM ({CLEAN}), (SELECT {ranges} FROM ({CLEAN}))",
        "minmax_fill_first": f"SELECT SK_ID_CURR, {', '.join(_round(_scaled(c, 'lo_' + c, 'hi_' + c), 9, c) for c in FILL_FIRST)} "
        f"FROM ({filled}), (SELECT {fill_ranges} FROM ({filled}))",
        "column_roles_name": f"SELECT \"column\", CASE WHEN {name_rule} OR \"column\" IN ({forced}) OR k > 50 THEN 'value' ELSE "
        f"'code' END AS role, (SELECT count(*) FROM ({APPS})) AS n FROM ({_per_column(counts, 'k', app_cols, APP_SQL)})",
        "column_roles_card": "SELECT \"column\", CASE WHEN k < 200 THEN 'code' ELSE 'value' END AS role, "
        f"(SELECT count(*) FROM ({CLEAN})) AS n FROM ({_per_column(counts, 'k', clean_cols, CLEAN)})",
        "row_ids": "SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_id FROM orders",
        "time_split": "SELECT id, issue_d, CASE WHEN issue_d < (SELECT quantile_cont(issue_d, 0.9) FROM "
        f"({CLEAN})) THEN 'train' ELSE 'test' END AS part FROM ({CLEAN})",
        "modulo_split": "SELECT o_orderkey, o_custkey, row_id, CASE WHEN row_id % 10 = 0 THEN 'test' ELSE 'train' END AS part FROM "
        "(SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS row_id FROM orders)",
        "rebalance_up": f"SELECT s.*, CAST(k AS INTEGER) AS copy FROM ({SCORED}) s, range(1, 4) r(k) WHERE label = 1 OR k = 1",
        "rebalance_down": f"SELECT row_id, batch_id, label, p FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_RANK}, row_id) "
        f"AS k, CAST(floor(0.3 * (SELECT count(*) FROM ({SCORED}) WHERE label = 0)) AS BIGINT) AS take FROM ({SCORED})) "
        "WHERE label = 1 OR k <= take",
        "class_weights": "SELECT row_id, label, CASE WHEN label = 1 THEN (SELECT CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) / "
        f"count(*) FILTER (WHERE label = 1) FROM ({SCORED})) ELSE 1e0 END AS weight FROM ({SCORED})",
        "feature_combine": f"SELECT SK_ID_CURR AS row_id, AMT_ANNUITY, {elements} FROM ({APPS}) a LEFT JOIN ({VECTORS}) v ON "
        "a.SK_ID_CURR = v.row_id",
    }


def _zero_sql() -> str:
    text = set(_APP_TEXT)
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", "
        + ("min(0e0)" if c in text else f"round(avg(CASE WHEN {c} = 0 THEN 1e0 ELSE 0e0 END), 9) + 0e0")
        + f" AS zero_share FROM ({APPS})"
        for c in FRAMES["application"][1]
    )
