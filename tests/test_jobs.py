"""B1–B5 and S4 on the 15-row labelled sample, written as CSV."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from urlsieve.operators import sampling as P
from urlsieve.plans import fixtures as fx
from urlsieve.plans import flows
from urlsieve.plans import jobs as J

SF = "/root/testdata/sf0.001"
GOOD = ["orchard", "harbour", "lantern", "meadow", "quarry", "saddle", "timber"]
BAD = ["parcel-fee", "locked-mailbox", "card-refund", "toll-notice", "prize-desk", "wallet-repair", "tax-rebate", "sim-renewal"]
BATCH = [(f"https://{w}.example.org", 0) for w in GOOD] + [(f"http://{w}-confirm.example.net", 1) for w in BAD]


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(BATCH)], "row_id long, url string, label int")
    return flows.train_layer1(df, min_freq=1)[0]


def test_batch_job_csv(spark, model):
    d = tempfile.mkdtemp(dir="/tmp")
    src = os.path.join(d, "sample.csv")
    with open(src, "w") as fh:
        fh.write("url,label,source\n")
        for u, y in BATCH:
            fh.write(f"{u},{y},by_hand\n")
    path, out = J.batch_job(spark, src, model, "url", "label", os.path.join(d, "out"), layer2_fn=fx.rule_layer2)
    assert os.path.basename(path).startswith("batch_results_")
    rows = out.collect()
    assert len(rows) == 15
    assert set(out.columns) >= {"original_label", "original_source", "true_label", "correct_prediction",
                                "decision_maker"}
    assert all(r.original_source == "by_hand" for r in rows)
    assert all(r.correct_prediction == (r.true_label == r.final_prediction) for r in rows)
    m = J.batch_metrics(out).first()
    assert 0.0 <= m.accuracy <= 1.0


def test_batch_job_spreads_one_file(spark, model, monkeypatch):
    d, parts, score = tempfile.mkdtemp(dir="/tmp"), [], J.score_table
    src = os.path.join(d, "one.csv")
    with open(src, "w") as fh:
        fh.write("url,label\n" + "".join(f"{u},{y}\n" for u, y in BATCH * 20))
    monkeypatch.setattr(J, "score_table", lambda df, *a: (parts.append(df.rdd.getNumPartitions()), score(df, *a))[1])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        counts = [J.batch_job(spark, src, model, "url", "label", os.path.join(d, f"out{m}"), "r", "url string, label int", multi_line=m)[1].count()
                  for m in (True, False)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert counts == [len(BATCH) * 20] * 2 and min(parts) > 1
    assert J.parse_args(["-i", src, "--single-line"]).single_line and not J.parse_args(["-i", src]).single_line
    with open(os.path.join(d, "job.json"), "w") as fh:
        fh.write('{"input": {"multi_line": false}}')
    assert not J.JobConfig.from_json(os.path.join(d, "job.json")).multi_line and J.JobConfig().multi_line


def test_batch_metrics_clamps(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "true_label int, final_prediction int")
    m = J.batch_metrics(df).first()
    assert (m.accuracy, m.precision, m.recall, m.f1_score) == (1.0, 0.0, 0.0, 0.0)


def test_url_list_job_accepts_a_string(spark, model):
    d = tempfile.mkdtemp(dir="/tmp")
    _, out = J.url_list_job(spark, "http://toll-notice-confirm.example.net", model, d)
    assert out.count() == 1


def test_model_round_trip_and_missing_model(spark, model):
    d = tempfile.mkdtemp(dir="/tmp")
    J.save_model(model, os.path.join(d, "m"))
    m2 = J.load_model(spark, os.path.join(d, "m"))
    assert m2.weights.count() == model.weights.count()
    with pytest.raises(Exception):
        J.load_model(spark, os.path.join(d, "missing")).weights.count()


def test_simulated_rates(spark):
    df = spark.range(0, 20000).select(F.col("id").alias("row_id"), F.lit("u").alias("url"),
                                      (F.col("id") % 2).cast("int").alias("label"))
    s = J.simulate_scored(df)
    fp = s.where("true_label = 0").agg(F.avg("layer1_prediction")).first()[0]
    fn = s.where("true_label = 1").agg(F.avg(1 - F.col("layer1_prediction"))).first()[0]
    assert abs(fp - 0.15) < 0.02 and abs(fn - 0.10) < 0.02
    band = s.where("used_layer2").agg(F.min("layer1_confidence"), F.max("layer1_confidence")).first()
    assert band[0] > 0.3 and band[1] < 0.7


def test_sampling_sizes(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("row_id"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    assert P.sample_n(df, 1234).count() == 1234
    assert P.sample_n(df, 10_000).count() == 5000
    sp = {(r.label, r.split): r["count"] for r in P.stratified_split(df).groupBy("label", "split").count().collect()}
    assert sp[(1, "test")] == 200 and sp[(1, "validation")] == 160 and sp[(1, "train")] == 640
    assert sp[(0, "test")] == 800 and sp[(0, "validation")] == 640
    b = P.balanced_sample(df, per_class=700)
    counts = {r.label: r["count"] for r in b.groupBy("label").count().collect()}
    assert counts == {0: 700, 1: 700}
    assert sorted(r.position for r in b.collect()) == list(range(1, 1401))


def test_cli_main_with_config(spark, model, capsys):
    d = tempfile.mkdtemp(dir="/tmp")
    J.save_model(model, os.path.join(d, "model"))
    src = os.path.join(d, "in.csv")
    with open(src, "w") as fh:
        fh.write("url,label\n" + "".join(f"{u},{y}\n" for u, y in BATCH))
    cfg = os.path.join(d, "config.json")
    with open(cfg, "w") as fh:
        fh.write('{"models": {"bigru": {"model_path": "%s"}}, "pipeline": {"bigru_threshold_low": 0.25, '
                 '"batch_size": 64}, "output": {"output_directory": "%s"}}' % (os.path.join(d, "model"), d))
    J.main(["--input", src, "--label-column", "label", "--config", cfg, "--output", "run1"])
    assert "Results saved to:" in capsys.readouterr().out
    assert os.path.isdir(os.path.join(d, "run1"))
    c = J.JobConfig.from_json(cfg)
    assert c.threshold == 0.25 and c.batch_size == 64 and c.device == "cpu"


def test_csv_texts_survive(spark):
    from urlsieve.sources import files as S

    rows = [("a\nb", 'say "x", y', 1), ("None", " padded ", 2), ("", None, 3), ("NA", "z\\", 4)]
    df = spark.createDataFrame(rows, "t string, u string, n int")
    path = S.write_results(df, tempfile.mkdtemp(dir="/tmp"), "r")
    assert sorted(tuple(r) for r in S.read_back(spark, path, df.schema).collect() if r.u) == sorted(r for r in rows if r[1])
    src = os.path.join(tempfile.mkdtemp(dir="/tmp"), "in.csv")
    with open(src, "w") as fh:
        fh.write('label,url\n1,"http://a\nb"\n0,"say ""x"""\nNA,c\n')
    got = S.read_csv(spark, src, "url string, label int").collect()
    assert [(r.url, r.label) for r in got] == [("http://a\nb", 1), ('say "x"', 0), ("c", None)]


def test_second_stage_by_configuration(spark, model):
    d = tempfile.mkdtemp(dir="/tmp")
    urls = spark.createDataFrame([(u,) for u, _ in BATCH], "url string")
    urls.select("url", F.lit("Phishing: it asks for money").alias("response")).write.parquet(os.path.join(d, "answers"))
    saved = J.saved_answers(spark, os.path.join(d, "answers"))
    out = J.url_list_job(spark, urls, model, d, "a", layer2_fn=saved, threshold=0.0)[1]
    routed = out.where("used_layer2").collect()
    assert all(r.final_prediction == 1 and r.layer2_explanation.startswith("Phishing") for r in routed)
    assert J.url_list_job(spark, urls, model, d, "b")[1].count() == len(BATCH)


def test_records_without_ids_text_labels_and_missing_label_column(spark, model, capsys):
    d = tempfile.mkdtemp(dir="/tmp")
    src = os.path.join(d, "in.json")
    with open(src, "w") as fh:
        fh.write('[{"text": "http://a.example.org", "label": 1}, {"text": "http://b.example.org", "label": 0}]')
    assert J.instruction_data_job(spark, src, os.path.join(d, "packed"), array_file=True).count() == 2
    final = spark.createDataFrame([("x", 1, "phishing")], "url string, final_prediction int, original_label string")
    assert J.with_truth(final, "label").first().true_label == 1
    with open(os.path.join(d, "in.csv"), "w") as fh:
        fh.write("url\nhttp://a.example.org\n")
    J.save_model(model, os.path.join(d, "model"))
    J.main(["--input", os.path.join(d, "in.csv"), "--label-column", "label", "--model", os.path.join(d, "model"), "--output", os.path.join(d, "o")])
    assert "Results saved to:" in capsys.readouterr().out


def test_null_row_ids_are_refused_and_other_labels_go(spark):
    df = spark.createDataFrame([(1, 0), (None, 1)], "row_id long, label int")
    with pytest.raises(Exception, match="row id is null"):
        P.sample_n(df, 1).collect()
    assert P.balanced_sample(spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "row_id long, label int")).count() == 2


def test_saved_model_keeps_its_tokenizer(spark, tmp_path):
    from urlsieve.plans import fixtures as fx
    from urlsieve.plans import jobs as J

    urls = fx.raw_urls(spark, SF).withColumnRenamed("page_id", "row_id")
    csv, out = str(tmp_path / "urls"), str(tmp_path / "out")
    urls.select("url", "status").write.option("header", True).csv(csv)
    J.train_main(["--input", csv, "--output", out, "--tokenizer", "structured"])
    model = J.load_model(spark, out + "/model")
    assert model.tok == "structured"
    spark.createDataFrame([(0.0,)], "bias double").write.parquet(str(tmp_path / "old/bias"))
    model.weights.write.parquet(str(tmp_path / "old/weights"))
    with pytest.raises(ValueError, match="tokenizer"):
        J.load_model(spark, str(tmp_path / "old"))


def test_layer1_job_and_evaluation_job(spark, tmp_path):
    from pyspark.sql import functions as F

    from urlsieve.plans import fixtures as fx
    from urlsieve.plans import flows
    from urlsieve.plans import jobs as J

    model, _ = flows.train_layer1(fx.urls(spark, SF))
    path, result, stats = J.standalone_job(spark, ["http://a.com/x", None, "http://blog.b.org"], model, output_dir=str(tmp_path / "one"))
    rows = {r.url: r for r in result.collect()}
    assert rows[None].status == "error" and len(rows) == 3
    s = stats.first()
    assert s.total_processed == 3 and s.phishing_detected + s.legitimate_detected == 3

    final = flows.fixture_cascade(fx.scored(spark, SF), fx.rule_layer2)
    saved = J.write_results(final.withColumn("true_label", F.when(F.col("row_id") % 2 == 0, F.col("true_label"))), str(tmp_path), "result")
    lines, metrics, report = J.evaluation_job(spark, saved, str(tmp_path / "reports"))
    total = final.where("row_id % 2 = 0").count()
    assert f"Rows in all: {total}" in {r.line for r in lines.collect()}
    assert {r.value for r in metrics.where("metric = 'total_samples'").collect()} == {float(total)}
    assert spark.read.text(report).count() > 0


def test_text_labels_are_truth(spark):
    from urlsieve.plans import jobs as J

    df = spark.createDataFrame([("phishing", 1), ("legitimate", 1), ("bad", 1), ("0", 0), ("1.0", 1), ("?", 1)], "original_label string, final_prediction int")
    got = [(r.true_label, r.correct_prediction) for r in J.with_truth(df, "label").collect()]
    assert got == [(1, True), (0, False), (1, True), (0, True), (1, True), (None, None)]
