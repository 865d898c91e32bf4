"""C1–C4 and the CSV / JSON sources."""

import json
import os
import tempfile

import pytest

from urlsieve.operators import cleaning as C
from urlsieve.sources import files as S


def test_detect_columns(spark):
    df = spark.createDataFrame([("a", "x", 1)], "id string, Website string, Status int")
    assert C.detect_columns(df) == ("Website", "Status")
    df2 = spark.createDataFrame([("a", "b")], "c0 string, c1 string")
    assert C.detect_columns(df2) == ("c0", "c1")
    one = spark.createDataFrame([("a",)], "only string")
    assert C.detect_columns(one) == ("only", "only")
    with pytest.raises(ValueError):
        C.detect_columns(one, C.URL_CANDIDATES_STRUCTURED, single_column_fallback=False)
    t = spark.createDataFrame([("a", "b", 1)], "text string, url string, label int")
    assert C.detect_columns(t) == ("text", "label")
    assert C.detect_columns(t, C.URL_CANDIDATES_STRUCTURED)[0] == "url"


def _labels(spark, values, ddl="label string"):
    df = spark.createDataFrame([(i, f"u{i}", v) for i, v in enumerate(values)], f"row_id int, url string, {ddl}")
    out = C.normalize_labels(df, "label")
    return sorted((r.row_id, r.label) for r in out.collect())


def test_label_vocabularies(spark):
    assert _labels(spark, ["good", "bad", "bad"]) == [(0, 0), (1, 1), (2, 1)]
    assert _labels(spark, ["legitimate", "phishing"]) == [(0, 0), (1, 1)]
    assert _labels(spark, ["benign", "phishing"]) == [(0, 0), (1, 1)]


def test_label_numeric_branch(spark):
    # one-class text column falls to the numeric branch and loses every row
    assert _labels(spark, ["phishing", "phishing"]) == []
    assert _labels(spark, ["1", "0", "2.7", "-1.5", "x", "1d", "nan", "inf", " 3 "]) == \
        [(0, 1), (1, 0), (2, 2), (3, -1), (8, 3)]


def test_label_typed(spark):
    assert _labels(spark, [0.0, 1.0, 1.0], "label double") == [(0, 0), (1, 1), (2, 1)]
    assert _labels(spark, [True, False], "label boolean") == [(0, 1), (1, 0)]
    assert _labels(spark, [2.9, float("nan"), 5.0], "label double") == [(0, 2), (2, 5)]


def test_clean_rows_drops_nulls(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, None, 0), (3, "c", None)], "row_id int, url string, label int")
    assert C.clean_rows(df, "url", "label", keep=["row_id"]).count() == 1


def test_profile(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "row_id int, label int")
    r = C.dataset_profile(df).first()
    assert (r.rows, r.distinct_labels, r.positives, r.negatives) == (3, 2, 2, 1)
    assert {(x.label, x.n) for x in C.label_distribution(df).collect()} == {(1, 2), (0, 1)}


def test_csv_na_tokens(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    p = os.path.join(d, "in.csv")
    with open(p, "w") as fh:
        fh.write("url,label\nhttp://a.com,1\nNA,0\nhttp://b.com,nan\nnull,N/A\n")
    df = S.read_csv(spark, p, "url string, label int")
    got = {(r.url, r.label) for r in df.collect()}
    assert got == {("http://a.com", 1), ("http://b.com", None), (None, 0), (None, None)}


def test_json_array_file(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    p = os.path.join(d, "urls.json")
    with open(p, "w") as fh:
        json.dump([{"text": "http://a.com", "label": 1}, {"text": "http://b.com", "label": 0}], fh, indent=2)
    df = S.read_json_records(spark, p)
    assert sorted((r.text, r.label) for r in df.collect()) == [("http://a.com", 1), ("http://b.com", 0)]
