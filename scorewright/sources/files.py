"""File sources: header CSV and spreadsheet workbooks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from scorewright.functions.names import ref

CSV_SUFFIXES, WORKBOOK_SUFFIXES = (".csv",), (".xlsx",)

# Texts a CSV reader takes as missing, besides the empty field.
CSV_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
    "None", "n/a", "nan", "null",
)


def file_kind(path: str) -> str:
    """``csv`` or ``workbook`` by extension; anything else is refused."""
    lowered = path.lower()
    if lowered.endswith(CSV_SUFFIXES):
        return "csv"
    if lowered.endswith(WORKBOOK_SUFFIXES):
        return "workbook"
    raise ValueError(f"unsupported file format: {path!r} (expected .csv or .xlsx)")


def scan_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    *,
    null_tokens: tuple[str, ...] = CSV_NULL_TOKENS,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header line. Give a schema to avoid the extra inference scan.

    Texts that stand for a missing value become null in every column. Inferred
    columns keep the type Spark finds; of those it takes for text, the ones
    that hold nothing but numbers once missing values are gone become bigint or
    double, found for all of them in one more scan.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if schema is None:
        df = reader.option("inferSchema", True).option("nullValue", "NaN").csv(path)
        texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
        rows = df.select(*[_without_tokens(df, c, null_tokens) if c in texts else ref(c) for c in df.columns])
        numbers = _number_columns(rows, [c for c in rows.columns if c in texts])
        return rows.select(*[F.trim(ref(c)).cast(numbers[c]).alias(c) if c in numbers else ref(c) for c in rows.columns])
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted.fields])
    df = reader.schema(as_text).csv(path)
    return df.select(*[
        _without_tokens(df, f.name, null_tokens).try_cast(f.dataType).alias(f.name) for f in wanted.fields
    ])


def _number_columns(rows: DataFrame, texts: list[str]) -> dict[str, str]:
    """The text columns that hold numbers alone, and the type for them; columns of nothing but nulls stay text."""
    if not texts:
        return {}
    cells = []
    for i, c in enumerate(texts):
        value = F.trim(ref(c))
        whole = value.rlike(r"^[+-]?\d+$") & value.try_cast("bigint").isNotNull()
        cells += [F.count(value).alias(f"n{i}"), F.count_if(whole).alias(f"whole{i}"),
                  F.count_if(value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")).alias(f"number{i}")]
    found = rows.agg(*cells).first()
    kinds = {}
    for i, c in enumerate(texts):
        n = found[f"n{i}"]
        if n and found[f"whole{i}"] == n:
            kinds[c] = "bigint"
        elif n and found[f"number{i}"] == n:
            kinds[c] = "double"
    return kinds


def _without_tokens(df: DataFrame, column: str, tokens: tuple[str, ...]):
    value = F.col(f"`{column}`")
    return F.when(~value.isin(*tokens), value).alias(column)


def preview(df: DataFrame, n: int = 10, order: list[str] = ()) -> DataFrame:
    """The first ``n`` rows; give ``order`` for a repeatable answer."""
    return (df.orderBy(*order) if order else df).limit(n)


# --- workbooks ------------------------------------------------------------
# A workbook is a zip archive of XML parts. One file is one task: the format
# cannot be split, and a sheet holds at most 1,048,576 rows.

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_BATCH_ROWS = 10_000


def _sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet name, archive member) in workbook order."""
    targets = {
        rel.get("Id"): rel.get("Target").lstrip("/").removeprefix("xl/")
        for rel in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    }
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
    return [(s.get("name"), "xl/" + targets[s.get(_REL_ID)]) for s in sheets]


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in root.iter(f"{_MAIN}si")]


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - ord("A") + 1
    return index - 1


def _rows(book: zipfile.ZipFile, member: str) -> Iterator[dict[int, str]]:
    """Rows of one sheet as {column index: text}, streamed from the archive."""
    shared = _shared_texts(book)
    with book.open(member) as part:
        for _, row in ElementTree.iterparse(part):
            if row.tag != f"{_MAIN}row":
                continue
            cells = {}
            for position, cell in enumerate(row.iter(f"{_MAIN}c")):
                kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                elif value is None or value.text is None:
                    continue
                else:
                    text = shared[int(value.text)] if kind == "s" else value.text
                cells[_column_index(cell.get("r")) if cell.get("r") else position] = text
            row.clear()
            yield cells


def _binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)


def list_sheets(spark: SparkSession, path: str) -> DataFrame:
    """One row per sheet of every workbook in a folder: file, position, sheet."""
    return read_sheet_names(_binary_files(spark, path))


def read_sheet_names(books: DataFrame) -> DataFrame:
    """The same for workbooks given as (path, content) rows."""

    def read(batches):
        for files in batches:
            for name, content in zip(files["path"], files["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    names = [sheet for sheet, _ in _sheet_parts(book)]
                yield pd.DataFrame({"file": name, "position": range(len(names)), "sheet": names})

    return books.select("path", "content").mapInPandas(read, "file string, position int, sheet string")


def ingest_workbooks(
    spark: SparkSession, path: str, schema: T.StructType | str, *, sheet: str | int = 0
) -> DataFrame:
    """Stack one sheet of every ``.xlsx`` in a folder into one table."""
    return read_workbooks(_binary_files(spark, path), schema, sheet=sheet)


def read_workbooks(books: DataFrame, schema: T.StructType | str, *, sheet: str | int = 0) -> DataFrame:
    """One sheet of every workbook given as (path, content) rows.

    ``schema`` names the header cells to keep with their types. Adds ``file``,
    ``sheet`` and the 1-based ``row_number`` of the data row within its file.
    """
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    fields = wanted.fieldNames()

    def read(batches):
        for files in batches:
            for name, content in zip(files["path"], files["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    parts = _sheet_parts(book)
                    if isinstance(sheet, int):
                        chosen, member = parts[sheet]
                    else:
                        chosen, member = sheet, dict(parts)[sheet]
                    rows = _rows(book, member)
                    header = {text.strip(): index for index, text in next(rows, {}).items()}
                    batch, number = [], 0
                    for number, cells in enumerate(rows, start=1):
                        batch.append([name, chosen, number, *[cells.get(header.get(f, -1)) for f in fields]])
                        if len(batch) == _BATCH_ROWS:
                            yield pd.DataFrame(batch, columns=["file", "sheet", "row_number", *fields])
                            batch = []
                    if batch:
                        yield pd.DataFrame(batch, columns=["file", "sheet", "row_number", *fields])

    as_text = T.StructType(
        [T.StructField("file", T.StringType()), T.StructField("sheet", T.StringType()),
         T.StructField("row_number", T.LongType())]
        + [T.StructField(f, T.StringType()) for f in fields]
    )
    texts = books.select("path", "content").mapInPandas(read, as_text)
    return texts.select(
        "file", "sheet", "row_number",
        *[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted.fields],
    )
