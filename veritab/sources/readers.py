"""Reading flat files: CSV with inferred types, parquet with its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.schema import col, nan_to_null

# Cell texts that mean "no value".
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Cell texts of a boolean column.
BOOLEAN_PATTERN = r"^(True|TRUE|true|False|FALSE|false)$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
DECIMAL_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^[+-]?[iI]nf(inity)?$"

# The documented size limits.
SIZE_LIMITS = {"max_file_size_mb": 50, "max_rows": 100_000, "max_columns": 500}


class DatasetError(ValueError):
    """The input is not a dataset this package reads."""


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    na_tokens: Sequence[str] = NA_TOKENS,
    multi_line: bool = False,
    infer: bool = True,
) -> DataFrame:
    """CSV with a header row; missing-value texts become NULL and types come from one scan.

    Files are split between tasks. Quoted line breaks need ``multi_line``, which
    reads each file in one task; without it they show up as malformed rows,
    which are an error and never dropped. So are cells that do not fit the type
    ``schema`` gives their column: the error counts them by column.
    """
    if not path.rstrip("/").split("?")[0].lower().endswith(".csv"):
        raise DatasetError(f"only CSV files are read: {path}")
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    header = reader.option("inferSchema", False).csv(path)
    if not header.columns:
        raise DatasetError(f"no columns to parse: {path}")
    names = header.columns
    corrupt = "_malformed_row"
    text_schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, corrupt]])
    raw = (
        reader.schema(text_schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
        .option("enforceSchema", False).csv(path)
    )
    text = raw.select(
        *[F.when(~col(n).isin(list(na_tokens)), col(n)).alias(n) for n in names], F.col(corrupt))
    given = None if schema is None else {f.name: f.dataType.simpleString() for f in schema.fields}
    unknown = [n for n in given or {} if n not in names]
    if unknown:
        raise DatasetError(f"columns not in the file: {unknown}")
    types = _inferred(text, names, corrupt, infer and schema is None, given or {})
    if given is not None:
        types, names = given, list(given)
    return nan_to_null(text.select(*[
        col(n) if types[n] == "string" else F.trim(col(n)).try_cast(types[n]).alias(n) for n in names
    ]))


def _inferred(
    text: DataFrame, names: Sequence[str], corrupt: str, infer: bool, given: dict[str, str],
) -> dict[str, str]:
    """Types that all values of a column fit; an error if a row does not fit the header or a cell its given type."""
    measures = [F.count(F.col(corrupt)).alias("malformed"), F.min(corrupt).alias("example")]
    typed = [n for n, kind in given.items() if kind != "string"]
    for i, n in enumerate(typed):
        misfit = F.when(F.trim(col(n)).try_cast(given[n]).isNull(), col(n))
        measures += [F.count(misfit).alias(f"misfits{i}"), F.min(misfit).alias(f"misfit{i}")]
    for i, n in enumerate(names if infer else []):
        value = col(n)
        measures += [
            F.count(value).alias(f"n{i}"),
            F.count_if(value.rlike(INTEGER_PATTERN) & F.trim(value).try_cast("bigint").isNotNull()).alias(f"int{i}"),
            F.count_if(value.rlike(DECIMAL_PATTERN)).alias(f"dec{i}"),
            F.count_if(value.rlike(BOOLEAN_PATTERN)).alias(f"bool{i}"),
        ]
    # The optimizer would prune the text columns that only the malformed-row check needs.
    row = text.agg(*measures, F.max(F.hash(*[col(n) for n in names])).alias("_rows")).first()
    if row["malformed"]:
        raise DatasetError(
            f"{row['malformed']} rows do not fit the header, for example {row['example']!r}; "
            "quoted line breaks need multi_line=True")
    misfits = {n: (row[f"misfits{i}"], row[f"misfit{i}"]) for i, n in enumerate(typed) if row[f"misfits{i}"]}
    if misfits:
        raise DatasetError("cells that do not fit the given type: " + "; ".join(
            f"{count} in {n} ({given[n]}), for example {example!r}" for n, (count, example) in misfits.items()))
    types = {}
    for i, n in enumerate(names):
        present = row[f"n{i}"] if infer else 0
        if present and row[f"int{i}"] == present:
            types[n] = "bigint"
        elif present and row[f"dec{i}"] == present:
            types[n] = "double"
        elif present and row[f"bool{i}"] == present:
            types[n] = "boolean"
        else:
            types[n] = "string"
    return types


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def size_violation(df: DataFrame, file_bytes: int | None = None, limits: dict[str, int] = SIZE_LIMITS) -> str | None:
    """The first size limit a dataset exceeds, as a message, or ``None``. Off unless called."""
    megabytes = limits["max_file_size_mb"]
    if file_bytes is not None and file_bytes > megabytes * 1024 * 1024:
        return f"File size ({file_bytes / 1024 / 1024:.1f} MB) exceeds maximum allowed size ({megabytes} MB)"
    rows = df.count()
    if rows > limits["max_rows"]:
        return f"Row count ({rows:,}) exceeds maximum allowed ({limits['max_rows']:,} rows)"
    if len(df.columns) > limits["max_columns"]:
        return f"Column count ({len(df.columns)}) exceeds maximum allowed ({limits['max_columns']} columns)"
    return None
