"""Column discovery, row cleaning, label normalisation, label profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Candidate column names (compared lower-cased, table order wins).
URL_CANDIDATES = ("text", "url", "website", "domain", "link")
URL_CANDIDATES_STRUCTURED = ("url", "website", "domain", "link")
LABEL_CANDIDATES = ("label", "target", "class", "result", "status")
# Two-class text vocabularies, mapped to (0, 1).
LABEL_VOCABULARIES = (("good", "bad"), ("legitimate", "phishing"), ("benign", "phishing"))
MAX_DISTINCT_LABELS = 16
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def detect_columns(df: DataFrame, url_candidates: Sequence[str] = URL_CANDIDATES,
                   label_candidates: Sequence[str] = LABEL_CANDIDATES,
                   single_column_fallback: bool = True) -> tuple[str, str]:
    """First column in table order whose lower-cased name is a candidate.

    Fallback: column 0 for the url, column 1 for the label (column 0 when the
    table has one column and ``single_column_fallback``).  Schema only, no job.
    """
    cols = df.columns
    url_set = {c.lower() for c in url_candidates}
    label_set = {c.lower() for c in label_candidates}
    url_col = next((c for c in cols if c.lower() in url_set), None)
    label_col = next((c for c in cols if c.lower() in label_set), None)
    if url_col is None:
        url_col = cols[0]
    if label_col is None:
        if len(cols) > 1:
            label_col = cols[1]
        elif single_column_fallback:
            label_col = cols[0]
        else:
            raise ValueError("table has one column and no label candidate")
    return url_col, label_col


def clean_rows(df: DataFrame, url_col: str, label_col: str, keep: Sequence[str] = (),
               keep_all: bool = False, drop_any_null: bool = False) -> DataFrame:
    """Keep url + label (+ ``keep`` key columns), drop rows with a null in
    either, url as string.  ``keep_all`` keeps every column (tuning variant);
    ``drop_any_null`` drops rows with any null (instruction-data variant)."""
    if keep_all:
        out = df
    else:
        names = [*keep, url_col, label_col]
        out = df.select(*[F.col(c) for c in dict.fromkeys(names)])
    out = out.na.drop(how="any") if drop_any_null else out.na.drop(subset=[url_col, label_col])
    return out.withColumn(url_col, F.col(url_col).cast("string"))


def label_scheme(df: DataFrame, label_col: str) -> str:
    """Decide the normalisation on the whole set of distinct labels.

    One aggregate; at most ``MAX_DISTINCT_LABELS + 1`` values reach the driver.
    Returns ``keep``, ``map:<neg>,<pos>`` or ``numeric``.
    """
    dtype = df.schema[label_col].dataType
    vals = [r[0] for r in df.select(label_col).where(F.col(label_col).isNotNull())
            .distinct().limit(MAX_DISTINCT_LABELS + 1).collect()]
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        as_num = set()
        for v in vals:
            as_num.add(float(v))
        return "keep" if as_num == {0.0, 1.0} else "numeric"
    s = set(vals)
    for neg, pos in LABEL_VOCABULARIES:
        if s == {neg, pos}:
            return f"map:{neg},{pos}"
    return "numeric"


def normalized_label(c: Column, dtype: T.DataType, scheme: str) -> Column:
    """Column expression of the chosen scheme; null = row to drop."""
    if scheme == "keep":
        return c.cast("int")
    if scheme.startswith("map:"):
        neg, pos = scheme[4:].split(",")
        return F.when(c == F.lit(neg), F.lit(0)).when(c == F.lit(pos), F.lit(1)).cast("int")
    if isinstance(dtype, T.BooleanType):
        return c.cast("int")
    if isinstance(dtype, T.NumericType):
        d = c.cast("double")
    else:
        # Spark would also accept '1d', 'nan', 'Infinity': gate with a strict pattern.
        d = F.when(c.rlike(NUMERIC_TEXT), F.trim(c).try_cast("double"))
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))
    return F.when(finite, F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d))).try_cast("int")


def label_value(df: DataFrame, label_col: str) -> Column:
    """0/1 or an integer per value, without looking at the whole set: a text of any of C3's
    pairs, or a number; null otherwise."""
    c = F.col(label_col)
    number = normalized_label(c, df.schema[label_col].dataType, "numeric")
    if not isinstance(df.schema[label_col].dataType, T.StringType):
        return number
    negative, positive = ([pair[i] for pair in LABEL_VOCABULARIES] for i in (0, 1))
    return F.when(c.isin(*negative), 0).when(c.isin(*positive), 1).otherwise(number)


def normalize_labels(df: DataFrame, label_col: str, scheme: str | None = None) -> DataFrame:
    """Map the label column to 0/1 or integers; drop rows that do not parse."""
    scheme = scheme or label_scheme(df, label_col)
    expr = normalized_label(F.col(label_col), df.schema[label_col].dataType, scheme)
    return df.withColumn(label_col, expr).where(F.col(label_col).isNotNull())


def load_labelled(df: DataFrame, keep: Sequence[str] = ("row_id",), structured: bool = False) -> DataFrame:
    """C1 → C2 → C3, renamed to (``keep``…, url, label)."""
    cands = URL_CANDIDATES_STRUCTURED if structured else URL_CANDIDATES
    url_col, label_col = detect_columns(df, cands, LABEL_CANDIDATES, single_column_fallback=not structured)
    out = clean_rows(df, url_col, label_col, keep=keep)
    out = normalize_labels(out, label_col)
    return out.select(*keep, F.col(url_col).alias("url"), F.col(label_col).alias("label"))


def label_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    """C4: count per label."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def dataset_profile(df: DataFrame, label_col: str = "label") -> DataFrame:
    """C4: one-row profile: rows, distinct labels, positives, negatives."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(F.col(label_col)).alias("distinct_labels"),
        F.count(F.when(F.col(label_col) == 1, 1)).alias("positives"),
        F.count(F.when(F.col(label_col) == 0, 1)).alias("negatives"),
    )
