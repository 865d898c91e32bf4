"""Lookups inside the row: many parts, equal ids, nulls; scores that are not rounded; records that are not lost."""

import json

import pytest
from pyspark.sql import functions as F

from urlsieve.operators import cascade as H
from urlsieve.operators import layer1 as M
from urlsieve.operators import lookup as L
from urlsieve.operators import tokens as T
from urlsieve.plans import jobs as J

ROWS = [(1, ["a", "b", None, "zz"]), (1, ["b"]), (2, []), (3, None), (1, ["b"]), (None, ["w7", "w8", "w7"])]


@pytest.fixture(params=[1 << 25, 200, 60], ids=["one part", "some parts", "many parts"])
def vocab(spark, request, monkeypatch):
    monkeypatch.setattr(L, "PART_BYTES", request.param)
    words = ["a", "b", *(f"w{i}" for i in range(10))]
    return spark.createDataFrame([(w, i + 2) for i, w in enumerate(words)], "token string, idx int")


def test_encode_and_decode_keep_every_row(spark, vocab):
    df = spark.createDataFrame([(*r, "x" * 10) for r in ROWS], "row_id long, tokens array<string>, wide string")
    enc = T.encode(df, vocab, 3)
    got = [(r.row_id, r.sequence) for r in enc.collect()]
    assert sorted(got, key=repr) == sorted([(1, [2, 3, 1]), (1, [3, 0, 0]), (2, [0, 0, 0]), (3, [0, 0, 0]), (1, [3, 0, 0]), (None, [11, 12, 11])], key=repr)
    assert enc.columns == ["row_id", "wide", "sequence"]
    dec = [(r.row_id, r.decoded) for r in T.decode(enc, vocab).collect()]
    assert sorted(dec, key=repr) == sorted([(1, ["a", "b", "<UNK>"]), (1, ["b"]), (2, []), (3, []), (1, ["b"]), (None, ["w7", "w8", "w7"])], key=repr)


def test_sums(spark, vocab):
    df = spark.createDataFrame(ROWS, "row_id long, tokens array<string>")
    got = L.lookup_sum(df, vocab.withColumn("weight", F.col("idx") / 4), "token", "weight", F.col("tokens"), "s").collect()
    assert sorted((r.row_id is None, r.row_id or 0, r.s) for r in got) == [(False, 1, 0.75), (False, 1, 0.75), (False, 1, 1.25), (False, 2, 0.0), (False, 3, 0.0), (True, 0, 8.5)]


def test_no_shuffle(spark):
    vocab = spark.createDataFrame([("a", 2)], "token string, idx int")
    plan = T.encode(spark.createDataFrame(ROWS, "row_id long, tokens array<string>"), vocab, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_confidence_is_not_rounded_before_routing(spark):
    import math

    want = 0.3000004
    model = M.TokenModel(spark.createDataFrame([("a", math.log(want / (1 - want)))], "token string, weight double"),
                         spark.createDataFrame([(0.0,)], "bias double"))
    df = spark.createDataFrame([(1, "u", ["a"])], "row_id long, url string, tokens array<string>")
    r = H.route(M.score_layer1(df, model)).first()
    assert r.used_layer2 and abs(r.layer1_confidence - want) < 1e-12


@pytest.mark.parametrize("array_file", [True, False])
def test_every_record_is_packed(spark, tmp_path, array_file):
    """Given ids that equal the numbers of records without, and records that share an id."""
    records = [{"row_id": 0, "text": "a b", "label": 0}, {"row_id": 1, "text": "c d", "label": 1}, {"text": "e f", "label": 0},
               {"text": "g h", "label": 1}, {"row_id": 1, "text": "i j", "label": 1}, {"row_id": 1, "text": "i j", "label": 1}]
    path = tmp_path / "r.json"
    path.write_text(json.dumps(records) if array_file else "\n".join(map(json.dumps, records)))
    out = J.instruction_data_job(spark, str(path), str(tmp_path / "out"), array_file=array_file).collect()
    assert len(out) == 6
    ids = [r.row_id for r in out]
    assert sorted(ids)[:4] == [0, 1, 1, 1] and len(set(ids)) == 4 and min(set(ids) - {0, 1}) > 1
