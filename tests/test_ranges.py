"""Files with the separator inside records, read by many tasks, against Spark's one-task readers."""

import csv
import json
import random

import pytest

from urlsieve.plans import catalog
from urlsieve.sources import files as S
from urlsieve.sources import ranges

BITS = ["a", "b,", '"', "\n", "\r\n", "é", "x y", '""', " ", ",", "\\"]
CSV_OPTIONS = {"mode": "PERMISSIVE", "quote": '"', "escape": '"'}


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "997", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


@pytest.mark.parametrize("seed", range(4))
def test_csv_equals_the_one_task_reader(small_blocks, tmp_path, seed):
    spark, r, end = small_blocks, random.Random(seed), "\r\n" if seed % 2 else "\n"
    for k in range(2):
        rows = [["".join(r.choice(BITS) for _ in range(r.choice([0, 1, 3, 8, 8, 60, 400]))) for _ in range(3)] + [str(i)] for i in range(150)]
        with open(tmp_path / f"{k}.csv", "w", newline="") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(["x,1", "y", "w", "id"])
            w.writerows(rows)
            f.write('stray"quote,un"quoted\\,,7' + end + '"abc"d"e,f,g,8' + end + "short" + end)
    got = S._csv_rows(spark, str(tmp_path), CSV_OPTIONS)
    want = spark.read.options(**CSV_OPTIONS, header=True, multiLine=True).schema("a string, b string, c string, id string").csv(str(tmp_path))
    assert ranges.blocks(spark, str(tmp_path), "\n").rdd.getNumPartitions() > 20
    assert got.columns == ["x,1", "y", "w", "id"]
    rows = [tuple(r) for r in got.collect()]
    if seed % 2:    # Spark's reader turns line breaks inside quotes into line feeds where lines end with both; here values stay
        assert any("\r\n" in (v or "") for x in rows for v in x)
        rows = [tuple(v and v.replace("\r\n", "\n") for v in x) for x in rows]
    assert same(rows, map(tuple, want.collect()))


def test_one_record_over_many_blocks(small_blocks, tmp_path):
    text = 'a "quoted" line,\n' * 500
    with open(tmp_path / "a.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([["t", "n"], ["first", "1"], [text, "2"], ["", "3"], [text + "end", "4"]])
    got = S.read_csv(small_blocks, str(tmp_path), "t string, n int").collect()
    assert same(map(tuple, got), [("first", 1), (text, 2), (None, 3), (text + "end", 4)])


def test_inferred_types(small_blocks, tmp_path):
    with open(tmp_path / "a.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows(
            [["i", "l", "d", "b", "s", "none"], *([str(i), str(i + (1 << 40)), f"{i}.5", "true", "a\nb", "NA"] for i in range(200)), ["NA"] * 6])
    df = S.read_csv(small_blocks, str(tmp_path))
    assert [f.dataType.simpleString() for f in df.schema] == ["int", "bigint", "double", "boolean", "string", "string"]
    assert df.count() == 201 and df.where("i is null and l is null and d is null and b is null and s is null").count() == 1


@pytest.mark.parametrize("seed", range(4))
def test_json_array_equals_the_one_task_reader(small_blocks, tmp_path, seed):
    spark, r = small_blocks, random.Random(seed)
    bits = ["a", "{", "}", "[", "]", '"', "\\", "\n", "é", ",", ":", '\\"', "}}", "\\\\"]
    for k in range(2):
        records = [{"text": "".join(r.choice(bits) for _ in range(r.choice([0, 2, 10, 900]))), "label": r.choice([0, 1, None]),
                    "deep": {"q": [{"z": "}"}, {"z": "[{"}]}} for _ in range(100)]
        records[5]["row_id"] = 5
        (tmp_path / f"{k}.json").write_text(json.dumps(records, indent=seed % 2 or None, ensure_ascii=seed < 2), encoding="utf-8")
    ddl = "row_id bigint, text string, label int, deep struct<q: array<struct<z: string>>>"
    want = spark.read.option("multiLine", True).schema(ddl).json(str(tmp_path)).collect()
    assert ranges.blocks(spark, str(tmp_path), "}").rdd.getNumPartitions() > 20
    assert same(S.read_json_records(spark, str(tmp_path), ddl).collect(), want)
    inferred = S.read_json_records(spark, str(tmp_path))
    assert set(inferred.columns) == {"row_id", "text", "label", "deep"} and inferred.count() == 200
    assert same(inferred.select("row_id", "text", "label", "deep").collect(), want)


def test_small_json_files(spark, tmp_path):
    for name, text in {"a": "[]", "b": ' [ {"text": "x"} ] \n', "c": '{"text": "alone"}', "d": '{"text": "l1"}\n{"text": "l2"}\n'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert sorted(r.text for r in S.read_json_records(spark, str(tmp_path), "text string").collect()) == ["alone", "l1", "l2", "x"]


@pytest.mark.parametrize("name", ["csv_multiline_scan", "json_array_scan"])
def test_scan_queries_write_by_many_tasks(spark, tmp_path, name):
    """No task takes up the whole table, neither to write the files nor to read them; rows stay, whichever file holds them."""
    rows = [(i, None if i % 9 == 0 else f'say "{i}"\n{{ [x], }} ' * (i % 7), len(str(i)), "web") for i in range(60)] + [(None, "no id", 5, None), (7, "again", 5, "a,b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, source string")
    docs.repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES[name](spark, str(tmp_path))
    files = got.inputFiles()
    assert len(files) >= spark.read.parquet(str(tmp_path / "documents.parquet")).rdd.getNumPartitions() > 1
    if name == "csv_multiline_scan":
        want = [(i, t or None, n, s) for i, t, n, s in rows]
    else:
        want = [(i if (i or 0) % 3 else -1, t, int(i is not None and i % 2 == 0)) for i, t, *_ in rows]
        for f in files:
            records = json.loads(open(f.removeprefix("file://")).read())
            assert records[-1] == {} and all("label" in r for r in records[:-1])
    assert same(map(tuple, got.collect()), want)


def test_json_arrays_of_an_empty_table(spark, tmp_path):
    path = S.write_json_arrays(spark.createDataFrame([], "text string"), str(tmp_path / "a"))
    assert S.read_json_records(spark, path, "text string").where("text is not null").count() == 0
