"""CSV scan (S1-S6): header, comma, quoted line breaks, encoding detection, inference.

* S5: only ``.csv`` names are accepted (a folder is read with ``*.csv`` only);
* S2: the encoding of each file is found from its bytes in one splittable scan:
  a UTF-16 byte-order mark, else valid UTF-8 (a UTF-8 mark included), else
  ISO-8859-1 (which decodes any bytes). Files are then read per encoding and unioned;
* S1: every column is read as text; differing headers and rows longer than the header
  are errors, short rows are filled with nulls, repeated headers become ``a, a.1`` (``multiLine`` for quoted line breaks; pass
  ``multiline=False`` for large plain files so Spark can split them);
* S4: empty fields and the usual missing-value words become null;
* S3: one aggregate counts, per column, the present values that look like an
  integer, a float and a boolean; one ``select`` casts. An all-missing column
  is ``double``. Not ``inferSchema``: that would also guess dates and accept
  ``5d`` as a number.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words read as missing (the usual CSV reader defaults).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
TRUE_WORDS = ["True", "TRUE", "true"]
FALSE_WORDS = ["False", "FALSE", "false"]
INT_PATTERN = r"^[+-]?[0-9]+$"
FLOAT_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity)$"

UTF8, UTF16, LATIN1 = "UTF-8", "UTF-16", "ISO-8859-1"


def list_csv(spark: SparkSession, path: str) -> list[str]:
    """The ``*.csv`` files at ``path`` (a file, a folder or a glob, on any
    filesystem); a path with none is refused. ``binaryFile`` prunes the file
    bodies, so this only lists."""
    return list(_sizes(spark, path))


def _sizes(spark: SparkSession, path: str) -> dict[str, int]:
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    files = {r["path"]: r["length"] for r in listing.select("path", "length").collect()}
    if not files:
        raise ValueError(f"Only CSV files are supported: no *.csv file at {path}")
    return files


def _plain_path(uri: str) -> str:
    """A metadata path (escaped, any number of slashes) as the file listing writes it."""
    return re.sub(r"^(\w+):/+", r"\1:/", unquote(uri))


def detect_encodings(spark: SparkSession, path: str) -> dict[str, str]:
    """``{file: encoding}`` from the bytes, one row per file.

    A splittable scan, no file held whole: the ``text`` source hands over raw line
    bytes, and newline bytes never occur inside a UTF-8 sequence, so a file is
    valid UTF-8 exactly when each of its lines is. The byte-order mark is read
    from the first line of each file's first block. Files are listed with
    ``binaryFile`` (its content column is pruned, so not read).
    """
    files = _sizes(spark, path)
    lines = spark.read.option("pathGlobFilter", "*.csv").text(path)
    b = F.col("value").cast("binary")
    first = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
    per_file = (lines.select(F.col("_metadata.file_path").alias("path"), b.alias("b"), first.alias("first"))
                .groupBy("path")
                .agg(F.bool_and(F.is_valid_utf8(F.col("b").cast("string"))).alias("utf8"),
                     F.min_by(F.substring(F.col("b"), 1, 2), F.col("first")).alias("head")))
    enc = (F.when(F.col("head").isin(F.unhex(F.lit("FFFE")), F.unhex(F.lit("FEFF"))), F.lit(UTF16))
           .when(F.col("utf8"), F.lit(UTF8))
           .otherwise(F.lit(LATIN1)))
    found = {_plain_path(r["path"]): r["enc"] for r in per_file.select("path", enc.alias("enc")).collect()}
    plain = {f: re.sub(r"^(\w+):/+", r"\1:/", f) for f in files}
    lost = [f for f, size in files.items() if size and plain[f] not in found]
    if lost:
        raise ValueError(f"no encoding found for {lost[:3]}")
    return {f: found.get(plain[f], UTF8) for f in files}      # an empty file has no lines


def read_text_csv(spark: SparkSession, path: str, encoding: str | None = None,
                  multiline: bool = True) -> DataFrame:
    """S1 + S2 + S5: all columns as text, files grouped by encoding.

    A file whose header differs from the group's first file is an error, and so is a row
    with more fields than the header, empty ones included (only a row of empty fields alone, which holds
    nothing to lose, may pass); a short row is filled with nulls.
    """
    if encoding is not None:
        groups = {encoding: list_csv(spark, path)}
    else:
        groups = {}
        for f, enc in detect_encodings(spark, path).items():
            groups.setdefault(enc, []).append(f)
    frames = [_read_group(spark, files, enc, multiline) for enc, files in sorted(groups.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


CORRUPT = "_corrupt_record"


def _read_group(spark: SparkSession, files: list[str], encoding: str, multiline: bool) -> DataFrame:
    reader = (spark.read.option("multiLine", multiline).option("escape", '"').option("mode", "PERMISSIVE")
              .option("encoding", encoding))
    head = reader.option("header", False).csv(files[0]).first()
    raw = [(c or "").lstrip("\ufeff") for c in head] if head else []   # a byte-order mark can stay on the first header
    if not raw:
        return reader.option("header", True).csv(files)
    names = unique_names(raw)
    checked = names == list(head)                     # the header as it stands: compare it in every file
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
    rows = (reader.option("header", True).option("enforceSchema", not checked)
            .option("columnNameOfCorruptRecord", CORRUPT).schema(schema).csv(files))
    # A row that Spark could not fit is parsed again with one more column: an empty field counts, a missing one does not.
    again = F.from_csv(F.col(CORRUPT), ", ".join(f"c{i} string" for i in range(len(names) + 1)),
                       {"escape": '"', "nullValue": "\u0001", "emptyValue": "", "multiLine": str(multiline).lower()})
    too_long = F.col(CORRUPT).isNotNull() & (F.col(f"`{names[-1]}`").isNotNull() | again[f"c{len(names)}"].isNotNull())
    fits = F.when(too_long, F.raise_error(F.concat(F.lit("more fields than the header: "), F.col(CORRUPT))).cast("boolean"))
    return rows.where(fits.otherwise(F.lit(True))).drop(CORRUPT)


def unique_names(raw: list[str]) -> list[str]:
    """Header names as the usual CSV readers give them: ``a, a.1`` for repeats, ``Unnamed: i`` for blanks."""
    seen: dict[str, int] = {}
    out = []
    for i, c in enumerate(raw):
        name = c or f"Unnamed: {i}"
        k = seen.get(name, 0)
        seen[name] = k + 1
        out.append(f"{name}.{k}" if k else name)
    return out


def na_to_null(df: DataFrame) -> DataFrame:
    """Missing-value words to null (no trimming)."""
    return df.select(*[F.when(F.col(f"`{c}`").isin(NA_TOKENS), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c)
                       if isinstance(df.schema[c].dataType, T.StringType) else F.col(f"`{c}`")
                       for c in df.columns])


def infer_types(df: DataFrame) -> dict[str, str]:
    """S3: one aggregate over all text columns -> Spark type per column."""
    aggs = []
    for i, c in enumerate(df.columns):
        v = F.ltrim(F.col(f"`{c}`"))             # leading blanks do not make a number a text
        aggs += [F.count(v).alias(f"n{i}"),
                 F.count_if(v.rlike(INT_PATTERN) & F.expr(f"try_cast(ltrim(`{c}`) AS BIGINT)").isNotNull()).alias(f"i{i}"),
                 F.count_if(v.rlike(FLOAT_PATTERN)).alias(f"f{i}"),
                 F.count_if(F.col(f"`{c}`").isin(TRUE_WORDS + FALSE_WORDS)).alias(f"b{i}")]
    if not aggs:
        return {}
    row = df.agg(F.count(F.lit(1)).alias("rows"), *aggs).first()
    types = {}
    for i, c in enumerate(df.columns):
        n = row[f"n{i}"]
        if n == 0:
            types[c] = "double"
        elif row[f"i{i}"] == n:
            types[c] = "bigint"
        elif row[f"f{i}"] == n:
            types[c] = "double"
        elif row[f"b{i}"] == row["rows"]:         # truth words with missing values stay text
            types[c] = "boolean"
        else:
            types[c] = "string"
    return types


def cast_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    cols = []
    for c in df.columns:
        t = types.get(c, "string")
        v = F.col(f"`{c}`")
        if t == "boolean":
            v = F.when(v.isin(TRUE_WORDS), F.lit(True)).when(v.isin(FALSE_WORDS), F.lit(False))
        elif t != "string":
            v = F.ltrim(v).cast(t)
        cols.append(v.alias(c))
    return df.select(*cols)


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, multiline: bool = True,
             schema: T.StructType | None = None) -> DataFrame:
    """The table of a CSV file (or a folder of them) with inferred types."""
    raw = na_to_null(read_text_csv(spark, path, encoding, multiline))
    if schema is not None:
        return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
    return cast_types(raw, infer_types(raw))

