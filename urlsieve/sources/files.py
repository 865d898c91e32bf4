"""File sources and sinks.

Readers take an explicit path or glob (never "the first file a directory
listing returns") and a schema where the caller knows it.  Writers never
``coalesce(1)``: a result is a folder of part files written in parallel.
"""

from __future__ import annotations

import datetime as _dt
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from . import ranges

# Texts pandas reads as missing by default (S1 parity).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
STAMP_FORMAT = "%Y%m%d_%H%M%S"


def null_na_tokens(df: DataFrame, na_tokens=NA_TOKENS) -> DataFrame:
    """String columns: the pandas missing-value texts become null."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(~c.isin(*na_tokens), c) if na_tokens else c
        cols.append(c.alias(f.name))
    return df.select(*cols)


#: Types tried for a column without a schema, first to last; text otherwise.
INFERRED_TYPES = ("int", "bigint", "double", "boolean", "timestamp")


def inferred(df: DataFrame) -> DataFrame:
    """Text columns as the first type that fits all of their values (one aggregate over all rows)."""
    if not df.columns:
        return df
    fits = [F.min(F.coalesce(F.col(f"`{c}`").try_cast(t).isNotNull(), F.lit(True)) | F.col(f"`{c}`").isNull()).alias(f"{i}_{t}")
            for i, c in enumerate(df.columns) for t in INFERRED_TYPES]
    some = [F.count(F.col(f"`{c}`")).alias(f"{i}_n") for i, c in enumerate(df.columns)]
    got = df.agg(*fits, *some).first()
    kinds = [next((t for t in INFERRED_TYPES if got[f"{i}_{t}"] and got[f"{i}_n"]), "string") for i in range(len(df.columns))]
    return df.select(*[F.col(f"`{c}`").try_cast(t).alias(c) for c, t in zip(df.columns, kinds, strict=True)])


def _csv_rows(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """All columns as text, each file read by many tasks (see ``ranges``); the first file's header names the columns."""
    names = spark.read.options(**options, header=True, multiLine=True, inferSchema=False).csv(path).columns
    found = ranges.records(spark, path, ranges.Csv()).where(~F.col("first"))
    text = F.regexp_replace("record", r"\r$", "")
    fields = ", ".join(f"_c{i} string" for i in range(len(names)))
    row = F.from_csv(F.when(text != "", text), fields, {**options, "multiLine": "true"})
    return found.where(text != "").select(row.alias("r")).select(*[F.col(f"r._c{i}").alias(n) for i, n in enumerate(names)])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             na_tokens=NA_TOKENS, multi_line: bool = True) -> DataFrame:
    """Header row, columns by name, quoted line breaks and doubled quotes.  A file is
    read by many tasks, whether its values hold line breaks or not; ``multi_line=False``
    spares the scans that find the quotes, for files known to have none.  Typed by
    ``schema`` (or inferred: one extra pass, avoid at scale).  Numeric columns are read
    as text first, so a pandas missing token (``NA``, ``nan`` …) becomes null instead of
    failing the cast.  Lines end with a line feed, with or without a carriage return."""
    options = {"mode": "PERMISSIVE", "quote": '"', "escape": '"'}
    if multi_line:
        raw = _csv_rows(spark, path, options)
    else:
        raw = spark.read.options(**options, header=True, inferSchema=False).csv(path)
    if schema is None:
        return inferred(null_na_tokens(raw, na_tokens))
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    raw = null_na_tokens(raw.select(*[f"`{f.name}`" for f in st.fields]), na_tokens)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) if not isinstance(f.dataType, T.StringType)
                        else F.col(f.name) for f in st.fields])


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                      array_file: bool = True) -> DataFrame:
    """Records with ``text`` and ``label``.  ``array_file``: one JSON array of records
    per file, read by many tasks (see ``ranges``); otherwise JSON Lines.  Without a schema
    it is inferred from all records (one extra pass)."""
    if not array_file:
        return (spark.read.schema(schema) if schema is not None else spark.read).json(path)
    found = ranges.records(spark, path, ranges.Json()).where(F.col("record").contains("{"))
    record = F.concat(F.regexp_extract("record", r"(?s)\{.*", 0), F.lit("}"))
    if schema is None:
        kind = found.select(F.schema_of_variant_agg(F.try_parse_json(record))).first()[0]
        schema = T._parse_datatype_string(kind.replace("OBJECT<", "struct<").replace("VOID", "string").replace("VARIANT", "string"))
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    return found.select(F.from_json(record, st).alias("r")).select(*[F.col(f"r.`{f.name}`").alias(f.name) for f in st.fields])


def _array_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of one array: records, each with a comma, between the brackets; an empty object ends it."""
    yield pa.RecordBatch.from_pydict({"value": ["["]})
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(batch.column(0), ",", "")], names=["value"])
    yield pa.RecordBatch.from_pydict({"value": ["{}]"]})


def write_json_arrays(df: DataFrame, path: str) -> str:
    """S2's input: a folder of files, one per partition, each a JSON array of the partition's records."""
    ship_package(df.sparkSession)
    record = df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("value"))
    record.mapInArrow(_array_lines, "value string").write.mode("errorifexists").text(path)
    return path


def stamped_name(prefix: str, now: _dt.datetime | None = None) -> str:
    return f"{prefix}_{(now or _dt.datetime.now()).strftime(STAMP_FORMAT)}"


def write_results(df: DataFrame, out_dir: str, name: str | None = None, prefix: str = "results",
                  fmt: str = "csv") -> str:
    """Write a result table into ``out_dir`` (a folder named
    ``<prefix>_<stamp>`` by default).  Fails rather than overwrites."""
    path = os.path.join(out_dir, name or stamped_name(prefix))
    w = df.write.mode("errorifexists")
    if fmt == "csv":
        (w.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        w.format(fmt).save(path)
    return path


def read_back(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    if fmt == "csv":
        return read_csv(spark, path, schema, na_tokens=())   # our own output: a text "None" is a text
    return spark.read.schema(schema).format(fmt).load(path)


def metrics_json(groups: dict[str, DataFrame]) -> DataFrame:
    """Nested report {group: {metric: value}} as one JSON text row.

    Each group is a metrics DataFrame of one row, or of none: such a group is left out.
    The rows are combined through scalar subqueries (no join), pretty-printed like an
    indented dump.  A metric that is undefined (null) is left out, too."""
    first = next(iter(groups.values()))
    fields = []
    for g, df in groups.items():
        fields.append(F.lit(g))
        fields.append(df.select(F.struct(*df.columns)).scalar())
    obj = F.named_struct(*fields)
    return first.select(F.to_json(obj, {"pretty": "true", "ignoreNullFields": "true"}).alias("report"))


def write_metrics_json(groups: dict[str, DataFrame], out_dir: str, name: str | None = None) -> str:
    """S5 sink: the report as a text file in ``out_dir``."""
    path = os.path.join(out_dir, name or stamped_name("evaluation_report"))
    metrics_json(groups).write.mode("errorifexists").text(path)
    return path


def read_metrics_json(spark: SparkSession, path: str) -> DataFrame:
    """The report of :func:`write_metrics_json` as rows: grp, metric, value."""
    text = spark.read.text(path, wholetext=True)
    groups = text.select(F.explode(F.from_json("value", "map<string, map<string, double>>")).alias("grp", "metrics"))
    return groups.select("grp", F.explode("metrics").alias("metric", "value"))
