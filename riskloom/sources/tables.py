"""Reading the lending tables and reading or writing intermediate results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.scalars import quoted, scrub_nan, to_date_time

# ---- Fixed values: missing-value texts, declared column types, file names ----

MISSING_TEXTS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "n/a",
    "nan",
    "null",
]

POS_CASH_TYPES = (
    "SK_ID_PREV bigint, SK_ID_CURR bigint, MONTHS_BALANCE int, SK_DPD int, SK_DPD_DEF int, "
    "CNT_INSTALMENT double, CNT_INSTALMENT_FUTURE double"
)
INSTALMENT_TYPES = (
    "SK_ID_PREV bigint, SK_ID_CURR bigint, NUM_INSTALMENT_NUMBER int, NUM_INSTALMENT_VERSION double, "
    "DAYS_INSTALMENT double, DAYS_ENTRY_PAYMENT double, AMT_INSTALMENT double, AMT_PAYMENT double"
)
CARD_TYPES = (
    "SK_ID_PREV bigint, SK_ID_CURR bigint, MONTHS_BALANCE smallint, AMT_CREDIT_LIMIT_ACTUAL int, "
    "CNT_DRAWINGS_CURRENT int, SK_DPD int, SK_DPD_DEF int, AMT_BALANCE double, AMT_DRAWINGS_ATM_CURRENT double, "
    "AMT_DRAWINGS_CURRENT double, AMT_DRAWINGS_OTHER_CURRENT double, AMT_DRAWINGS_POS_CURRENT double, "
    "AMT_INST_MIN_REGULARITY double, AMT_PAYMENT_CURRENT double, AMT_PAYMENT_TOTAL_CURRENT double, "
    "AMT_RECEIVABLE_PRINCIPAL double, AMT_RECIVABLE double, AMT_TOTAL_RECEIVABLE double, "
    "CNT_DRAWINGS_ATM_CURRENT double, CNT_DRAWINGS_OTHER_CURRENT double, CNT_DRAWINGS_POS_CURRENT double, "
    "CNT_INSTALMENT_MATURE_CUM double"
)

# table: (file name, declared types or None)
LENDING_FILES = {
    "application": ("application_train.csv", None),
    "previous_application": ("previous_application.csv", None),
    "bureau": ("bureau.csv", None),
    "bureau_balance": ("bureau_balance.csv", None),
    "pos_cash_balance": ("POS_CASH_balance.csv", POS_CASH_TYPES),
    "installments_payments": ("installments_payments.csv", INSTALMENT_TYPES),
    "credit_card_balance": ("credit_card_balance.csv", CARD_TYPES),
}

# ---- End of fixed values ----


_SURPLUS = "__surplus"
_WHOLE = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"


def _text_table(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """Every column as text, missing-value texts as NULL. A byte-order mark is dropped by the reader.

    Quoted values may span lines with ``multi_line``, which reads each file in one task; without it a file is split at line
    breaks. A record with more fields than the header is an error, one with fewer has missing values at its end.
    """
    options = {"header": True, "escape": '"', "multiLine": multi_line}
    names = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, _SURPLUS]])
    raw = spark.read.options(**options).schema(schema).csv(path)
    surplus = F.raise_error(F.lit(f"a record of {path} has more fields than the header")).cast("boolean")
    raw = raw.filter(F.when(F.col(_SURPLUS).isNull(), F.lit(True)).otherwise(surplus))
    cells = {c: F.col(quoted(c)) for c in names}
    return raw.select(*[F.when(~v.isin(MISSING_TEXTS), v).alias(c) for c, v in cells.items()])


def read_typed(spark: SparkSession, path: str, types: str | T.StructType, multi_line: bool = False) -> DataFrame:
    """CSV with declared types; other columns of the file are kept as text.

    Text that does not fit its declared type is an error, a missing-value text is NULL.
    """
    declared = types if isinstance(types, T.StructType) else T.StructType.fromDDL(types)
    kinds = {f.name: f.dataType for f in declared.fields}
    text = _text_table(spark, path, multi_line)
    absent = [c for c in kinds if c not in text.columns]
    if absent:
        raise KeyError("columns not in the file: " + ", ".join(absent))
    cells = {c: F.col(quoted(c)) for c in text.columns}
    return scrub_nan(text.select(*[v.cast(kinds[c]).alias(c) if c in kinds else v for c, v in cells.items()]))


def infer_types(text: DataFrame) -> T.StructType:
    """Whole numbers, reals or text per column, in one pass; whole numbers with gaps are reals.

    A number is digits with an optional sign, point and exponent; the engine's own suffixes (1d, 2F) are text. A cast is
    tried only on text that looks the part, as one that fails costs far more than looking.
    """
    def cells(i: int, c: str) -> list[Column]:
        v = F.col(quoted(c))
        real = F.when(v.try_cast("double").isNotNull(), 1).otherwise(2)
        whole = F.when(v.try_cast("bigint").isNotNull(), 0).otherwise(real)
        kind = F.when(v.isNull(), None).when(v.rlike(_WHOLE), whole).when(v.rlike(_NUMBER), real).otherwise(2)
        return [F.max(kind).alias(f"k_{i}"), F.some(v.isNull()).alias(f"m_{i}")]

    found = text.agg(*[cell for i, c in enumerate(text.columns) for cell in cells(i, c)]).first()

    def kind(i: int) -> T.DataType:
        most, missing = found[f"k_{i}"], found[f"m_{i}"]  # 0 whole, 1 real, 2 text; missing is null where there are no rows
        if missing is None or most == 2:
            return T.StringType()
        return T.LongType() if most == 0 and not missing else T.DoubleType()

    return T.StructType([T.StructField(c, kind(i)) for i, c in enumerate(text.columns)])


def read_inferred(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with types taken from the values; costs one extra pass over the file."""
    text = _text_table(spark, path, multi_line)
    kinds = infer_types(text)
    return scrub_nan(text.select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in kinds.fields]))


def read_lending_tables(
    spark: SparkSession, folder: str, types: Mapping[str, str] | None = None
) -> dict[str, DataFrame]:
    """The seven tables, lazily. ``types`` declares further tables and saves their inference pass."""
    out = {}
    for name, (file, declared) in LENDING_FILES.items():
        declared = (types or {}).get(name, declared)
        path = f"{folder}/{file}"
        out[name] = read_typed(spark, path, declared) if declared else read_inferred(spark, path)
    return out


def read_loans(
    spark: SparkSession,
    path: str,
    sample_path: str | None = None,
    sample: bool = False,
    date_format: str = "MMM-yyyy",
    types: str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """The loan table, whole or (``sample``) its sample file, with ``issue_d`` parsed.

    Its free-text columns may hold line breaks, so values may span lines unless told otherwise.
    """
    if sample and sample_path is None:
        raise ValueError("no sample file given")
    chosen = sample_path if sample else path
    rows = read_typed(spark, chosen, types, multi_line) if types else read_inferred(spark, chosen, multi_line)
    return rows.withColumn("issue_d", to_date_time("issue_d", date_format))


def sample_rows(df: DataFrame, share: float = 0.01, key: str | None = None, seed: int = 0) -> DataFrame:
    """A sample of rows: random, or every n-th value of a whole-number key."""
    if key is None:
        return df.sample(share, seed)
    return df.filter(F.pmod(F.col(key), F.lit(round(1 / share))) == 0)


# -- bucketed layout -------------------------------------------------------------------

# Columns the tables are bucketed by: the applicant, but balances by their credit.
BUCKET_KEYS = {name: "SK_ID_CURR" for name in LENDING_FILES} | {"bureau_balance": "SK_ID_BUREAU"}
MAX_KEY_SHARE = 4  # times an even bucket's rows that one key may hold


def write_bucketed(
    tables: Mapping[str, DataFrame], folder: str, prefix: str, buckets: int, keys: Mapping[str, str] = BUCKET_KEYS, refuse: bool = True
) -> dict[str, DataFrame]:
    """Write the tables bucketed and sorted by their key, as ``prefix_name`` under a folder, and read them back.

    Summaries per key and joins on it then need no exchange, given no fewer buckets than spark.sql.shuffle.partitions where they
    meet a table that does need one: of two layouts Spark keeps the one with more partitions. A bucket is one task, so a table is refused if one key holds more than
    MAX_KEY_SHARE times the rows of an even bucket: such tables are better read as they are, since summaries combine rows before they shuffle.
    Rows without key count as one key. Unless told to ``refuse`` it, such a table comes back as it is, and the others bucketed.
    """
    out = {}
    for name, df in tables.items():
        key = keys[name]
        counts = df.groupBy(F.col(quoted(key)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        told = counts.agg(F.sum("n").alias("n"), F.max("n").alias("top")).first()
        if told["n"] and told["top"] > max(1000, MAX_KEY_SHARE * told["n"] / buckets):
            if not refuse:
                out[name] = df
                continue
            raise ValueError(f"{name}: one {key} holds {told['top']} of {told['n']} rows, too many for one of {buckets} buckets")
        table = f"{prefix}_{name}"
        # Rows come dealt out by bucket, so a bucket is one file.
        dealt = df.repartition(buckets, F.col(quoted(key)))
        dealt.write.bucketBy(buckets, key).sortBy(key).option("path", f"{folder}/{table}").saveAsTable(table)
        out[name] = df.sparkSession.table(table)
    return out


# -- intermediate results ----------------------------------------------------------


def write_vectors(df: DataFrame, path: str, column: str, keys: Sequence[str] = ("row_id",)) -> None:
    df.select(*keys, F.col(column).cast("array<double>").alias("feature_intermediate")).write.parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_log(spark: SparkSession, path: str, run_id: str, values: Mapping[str, object], step: int = 0) -> None:
    """Append run parameters or per-step figures as (run_id, step, name, value) rows."""
    rows = [(run_id, int(step), k, str(v)) for k, v in values.items()]
    spark.createDataFrame(rows, "run_id string, step int, name string, value string").coalesce(1).write.mode(
        "append"
    ).parquet(path)


def write_logged(df: DataFrame, path: str, log: str, run_id: str, figures: Mapping[str, Column], step: int = 0) -> dict[str, object]:
    """Write rows as Parquet and append aggregates of them to the run log, taken while they are written; also the figures.

    The rows are computed once: no second scan reads them for the log.
    """
    seen = Observation()
    df.observe(seen, *[c.alias(name) for name, c in figures.items()]).write.parquet(path)
    append_log(df.sparkSession, log, run_id, seen.get, step)
    return dict(seen.get)
