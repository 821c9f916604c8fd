import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.plans import loans as L
from riskloom.sources import tables as sources


def write(path, text, mark=False):
    path.write_bytes((b"\xef\xbb\xbf" if mark else b"") + text.encode("utf-8"))
    return str(path)


def test_typed_scan(spark, tmp_path):
    path = write(tmp_path / "t.csv", "k,x,note\n1,2.5,a\n2,NA,N/A\n3,nan,\n", mark=True)
    df = sources.read_typed(spark, path, "k bigint, x double")
    assert df.dtypes == [("k", "bigint"), ("x", "double"), ("note", "string")]
    assert sorted(map(tuple, df.collect()), key=lambda r: r[0]) == [(1, 2.5, "a"), (2, None, None), (3, None, None)]


def test_typed_scan_rejects_bad_text(spark, tmp_path):
    path = write(tmp_path / "t.csv", "k\n1\nx\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sources.read_typed(spark, path, "k bigint").collect()
    with pytest.raises(KeyError, match="zz"):
        sources.read_typed(spark, path, "zz bigint")


def test_inferred_scan(spark, tmp_path):
    path = write(tmp_path / "t.csv", 'w,g,r,t\n1,1,1.5,"a, b"\n2,NA,2,NULL\n')
    df = sources.read_inferred(spark, path)
    assert df.dtypes == [("w", "bigint"), ("g", "double"), ("r", "double"), ("t", "string")]
    assert sorted(map(tuple, df.collect()), key=lambda r: r[0]) == [(1, 1.0, 1.5, "a, b"), (2, None, 2.0, None)]


def test_quoted_values_may_span_lines(spark, tmp_path):
    path = write(tmp_path / "t.csv", 'id,note,n\n1,"line one\nline ""two""",5\n2,None,6\n')
    df = sources.read_inferred(spark, path, multi_line=True)
    assert df.dtypes == [("id", "bigint"), ("note", "string"), ("n", "bigint")]
    assert sorted(map(tuple, df.collect())) == [(1, 'line one\nline "two"', 5), (2, "None", 6)]


@pytest.mark.parametrize("multi_line", [False, True])
def test_surplus_fields_are_an_error_and_absent_ones_missing(spark, tmp_path, multi_line):
    short = write(tmp_path / "s.csv", "a,b\n1,2\n3\n")
    assert sorted(map(tuple, sources.read_typed(spark, short, "a bigint, b bigint", multi_line).collect())) == [(1, 2), (3, None)]
    for extra in ("1,2,3", "1,2,3,4"):
        long_ = write(tmp_path / "l.csv", f"a,b\n1,2\n{extra}\n")
        with pytest.raises(Exception, match="more fields than the header"):
            sources.read_typed(spark, long_, "a bigint, b bigint", multi_line).select("a").collect()


def test_codes_with_number_suffixes_stay_text(spark, tmp_path):
    path = write(tmp_path / "t.csv", "code,real,word\n1d,1.,inf\n2F,-.5e3,Infinity\n")
    df = sources.read_inferred(spark, path)
    assert df.dtypes == [("code", "string"), ("real", "double"), ("word", "double")]
    assert sorted(r["code"] for r in df.collect()) == ["1d", "2F"]


def test_names_with_dots_and_backticks(spark, tmp_path):
    path = write(tmp_path / "t.csv", "a.b,c`d\n1,x\n")
    assert tuple(sources.read_typed(spark, path, "`a.b` bigint").first()) == (1, "x")
    assert tuple(sources.read_inferred(spark, path).first()) == (1, "x")


def test_bundle_has_seven_tables(spark, tmp_path):
    for name, (file, declared) in sources.LENDING_FILES.items():
        head = [c.split()[0] for c in declared.split(", ")] if declared else ["SK_ID_CURR", "x"]
        write(tmp_path / file, ",".join(head) + "\n" + ",".join("1" for _ in head) + "\n")
    bundle = sources.read_lending_tables(spark, str(tmp_path), {"bureau": "SK_ID_CURR bigint"})
    assert len(bundle) == 7 and dict(bundle["credit_card_balance"].dtypes)["MONTHS_BALANCE"] == "smallint"
    assert dict(bundle["bureau"].dtypes) == {"SK_ID_CURR": "bigint", "x": "string"}


def test_loans_whole_or_sample(spark, tmp_path):
    whole = write(tmp_path / "all.csv", "id,issue_d\n1,Dec-2015\n2,NA\n")
    sample = write(tmp_path / "some.csv", "id,issue_d\n1,Dec-2015\n")
    df = sources.read_loans(spark, whole, sample)
    assert df.count() == 2 and df.orderBy("id").first()["issue_d"] == dt.datetime(2015, 12, 1)
    assert sources.read_loans(spark, whole, sample, sample=True).count() == 1


def test_vectors_and_log(spark, tmp_path):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "row_id bigint, v array<float>")
    sources.write_vectors(df, str(tmp_path / "v"), "v")
    back = {r["row_id"]: r["feature_intermediate"] for r in sources.read_vectors(spark, str(tmp_path / "v")).collect()}
    assert back == {0: [1.0, 2.0], 1: [3.0, 4.0]}
    sources.append_log(spark, str(tmp_path / "log"), "r1", {"batch": 500})
    sources.append_log(spark, str(tmp_path / "log"), "r1", {"auc": 0.7}, step=1)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_sampling(spark):
    df = spark.range(1000)
    assert sources.sample_rows(df, 0.01, "id").count() == 10
    assert 0 < sources.sample_rows(df, 0.1, seed=4).count() < 250


def test_loan_cleaning(spark):
    values = {c: F.lit(1.0) for c in L.KEPT_COLUMNS}
    text = {
        "loan_status": "Charged Off",
        "term": " 36 months",
        "emp_length": "< 1 year",
        "home_ownership": "ANY",
        "earliest_cr_line": "Aug-2003",
    }
    values.update({c: F.lit(v) for c, v in text.items()})
    values["issue_d"] = F.lit(dt.datetime(2015, 1, 1))
    df = spark.range(1).select(*[v.alias(c) for c, v in values.items()])
    r = L.clean_loans(df, check=True).first()
    assert (r["term"], r["emp_length"], r["home_ownership"], r["earliest_cr_line"]) == (36, 0, "OTHER", 2003)
    assert r["loan_label"] == 1 and r["fico_score"] == 1.0
    assert L.clean_loans(df.withColumn("loan_status", F.lit("Current"))).count() == 0


def test_figures_are_taken_while_rows_are_written(spark, tmp_path):
    rows = spark.range(100, numPartitions=4).selectExpr("id", "id % 7 AS r")
    figures = {"n": F.count(F.lit(1)), "top": F.max("id"), "sevens": F.sum((F.col("r") == 0).cast("int"))}
    got = sources.write_logged(rows, f"{tmp_path}/rows", f"{tmp_path}/log", "a", figures, 3)
    assert got == {"n": 100, "top": 99, "sevens": 15} and spark.read.parquet(f"{tmp_path}/rows").count() == 100
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/log").collect()} == {("a", 3, "n", "100"), ("a", 3, "top", "99"), ("a", 3, "sevens", "15")}
    sources.write_logged(rows.limit(0), f"{tmp_path}/none", f"{tmp_path}/log", "b", {"n": F.count(F.lit(1))})
    assert spark.read.parquet(f"{tmp_path}/log").filter("run_id = 'b'").first().value == "0"


def test_inferred_types_of_odd_cells(spark):
    """One column a case: its values and the type that fits all of them."""
    cases = [
        (["1", " -2 ", "+3"], "bigint"),
        (["1", None], "double"),
        (["9223372036854775807", "1"], "bigint"),
        (["9223372036854775808", "1"], "double"),
        (["1", "2.", ".5", "1e400"], "double"),
        (["1", "-Infinity", "inf"], "double"),
        (["1", "2F"], "string"),
        (["1", "0x10"], "string"),
        (["1", "1e"], "string"),
        ([None, None], "double"),
        (["1.5", "x", None], "string"),
    ]
    for values, kind in cases:
        found = sources.infer_types(spark.createDataFrame([(v,) for v in values], "c string"))
        assert found["c"].dataType.simpleString() == kind, values
    assert sources.infer_types(spark.createDataFrame([], "c string"))["c"].dataType.simpleString() == "string"


def test_inference_tries_no_cast_on_text_that_looks_otherwise(spark):
    """A cast that fails costs far more than a look at the text: every try is behind a pattern, and a column takes two figures."""
    seen = []

    class Watched:
        columns = ["c"]

        def agg(self, *figures):
            seen.extend(str(f) for f in figures)
            return spark.createDataFrame([("1",)], "c string").agg(*figures)

    assert sources.infer_types(Watched())["c"].dataType.simpleString() == "bigint"
    assert len(seen) == 2 and all("RLIKE" in f.split("TRY_CAST")[0].upper() for f in seen if "TRY_CAST" in f.upper())
