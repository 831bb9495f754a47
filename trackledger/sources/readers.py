"""Sources and sinks with explicit schemas: registers, feeds, CSV dumps, attachments, pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackledger.sources import versions

# Schemas of the XML register; attributes arrive with a leading underscore.
TEXT_VALUE = "struct<_Value:string>"
OP_SCHEMA = (
    f"OPName {TEXT_VALUE}, UniqueOPID {TEXT_VALUE}, OPType struct<_Value:string,_OptionalValue:string>, "
    "OPGeographicLocation struct<_Latitude:string,_Longitude:string>, _ValidityDateStart string, _ValidityDateEnd string"
)
SOL_SCHEMA = (
    f"SOLOPStart {TEXT_VALUE}, SOLOPEnd {TEXT_VALUE}, SOLLength {TEXT_VALUE}, SOLNature {TEXT_VALUE}, _ValidityDateEnd string, "
    f"SOLTrack array<struct<SOLTrackIdentification:{TEXT_VALUE},SOLTrackParameter:array<struct<_ID:string,_Value:string>>>>"
)
# File kinds accepted as attachments, by their first bytes in hex.
MAGIC = {
    "application/pdf": "25504446",
    "image/png": "89504E470D0A1A0A",
    "image/jpeg": "FFD8FF",
    "image/gif": "47494638",
    "application/zip": "504B0304",
}
MAX_ATTACHMENT = 50 * 1024 * 1024
FEED_SCHEMA = "id int, parent_id int, shorttitle string, icon_title string, projecttime string, url string, lat double, lng double"


def decimal_comma(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def operational_points(spark: SparkSession, path: str) -> DataFrame:
    """Operational points of a register file (tag ``OperationalPoint``)."""
    raw = spark.read.format("xml").option("rowTag", "OperationalPoint").schema(T.StructType.fromDDL(OP_SCHEMA)).load(path)
    place = F.col("OPGeographicLocation")
    return raw.select(
        F.col("UniqueOPID._Value").alias("op_id"),
        F.col("OPName._Value").alias("name"),
        F.coalesce("OPType._OptionalValue", "OPType._Value").alias("type"),
        decimal_comma(place["_Latitude"]).alias("latitude"),
        decimal_comma(place["_Longitude"]).alias("longitude"),
        F.col("_ValidityDateStart").try_cast("date").alias("validity_date_start"),
        F.col("_ValidityDateEnd").try_cast("date").alias("validity_date_end"),
    )


def sections_of_line(spark: SparkSession, path: str) -> DataFrame:
    """Sections of line with their nested tracks and parameters (tag ``SectionOfLine``)."""
    raw = spark.read.format("xml").option("rowTag", "SectionOfLine").schema(T.StructType.fromDDL(SOL_SCHEMA)).load(path)
    tracks = F.transform(
        "SOLTrack",
        lambda t: F.struct(
            t["SOLTrackIdentification"]["_Value"].alias("track"),
            F.transform(t["SOLTrackParameter"], lambda p: F.struct(p["_ID"].alias("id"), p["_Value"].alias("value"))).alias("parameters"),
        ),
    )
    return raw.select(
        F.col("SOLOPStart._Value").alias("sol_op_start"),
        F.col("SOLOPEnd._Value").alias("sol_op_end"),
        decimal_comma(F.col("SOLLength._Value")).alias("sol_length"),
        F.col("_ValidityDateEnd").try_cast("date").alias("validity_date_end"),
        tracks.alias("tracks"),
    )


def json_feed(spark: SparkSession, path: str, schema: str = FEED_SCHEMA) -> DataFrame:
    """Records of a landed feed, one JSON array per file; anything but an array is an error."""
    text = spark.read.option("wholetext", True).text(path)
    first = F.substring(F.ltrim(F.col("value")), 1, 1)
    ok = F.assert_true(first == "[", F.lit("the feed is not a JSON array"))
    rows = text.where(ok.isNull()).select(F.explode(F.from_json("value", f"array<struct<{struct_fields(schema)}>>")).alias("r"))
    return rows.select("r.*")


def struct_fields(ddl: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl).fields)


def csv_coerced(spark: SparkSession, path: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """CSV with header; ``columns`` maps a source column to (name, type), others are dropped.

    Numbers that cannot be read become null, booleans false; empty texts become null.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False)
    out = []
    for source, (name, kind) in columns.items():
        value = F.col(f"`{source}`")
        if kind == "boolean":
            out.append(F.coalesce(F.lower(F.trim(value)).isin("true", "t", "1", "yes"), F.lit(False)).alias(name))
        elif kind == "string":
            out.append(F.when(F.trim(value) != "", value).alias(name))
        else:
            out.append(F.trim(value).try_cast("double" if kind in ("int", "long") else kind).try_cast(kind).alias(name))
    return raw.select(*out)


def csv_checked(spark: SparkSession, path: str, schema: str, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with a reason) of a CSV with header."""
    fields = T.StructType.fromDDL(f"{schema}, _corrupt string")
    raw = spark.read.schema(fields).csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    missing = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in required]
    reason = F.coalesce(F.when(F.col("_corrupt").isNotNull(), F.lit("unreadable")), *missing)
    marked = raw.withColumn("reason", reason)
    return marked.where("reason is null").drop("_corrupt", "reason"), marked.where("reason is not null")


def attachments(spark: SparkSession, path: str) -> DataFrame:
    """Binary files with sniffed kind and a verdict: ok, too large, kind not allowed, unsafe name."""
    files = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 16))
    kind = F.lit(None).cast("string")
    for name, magic in MAGIC.items():
        kind = F.when(head.startswith(magic), name).otherwise(kind)
    name = F.element_at(F.split("path", "/"), -1)
    verdict = (
        F.when(F.col("length") > MAX_ATTACHMENT, "too large").when(kind.isNull(), "kind not allowed")
        .when(name.contains("..") | name.rlike(r"[\\\x00]"), "unsafe name").otherwise("ok")
    )
    return files.select("path", name.alias("name"), "length", kind.alias("mime"), verdict.alias("verdict"), "content")


def page_rows(files: DataFrame, extract: Callable[[bytes], list[tuple[int, list[list[str | None]]]]]) -> DataFrame:
    """Table rows of binary documents ``(path, content)`` through a caller's extractor.

    The extractor returns (page number, rows of cells). Output ``path, page, row_no, cells``
    keeps the order; a file that cannot be read gives one row with null cells and page 0.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    pages = extract(bytes(content))
                except Exception:  # noqa: BLE001 a damaged file must not stop the batch
                    out.append((path, 0, 0, None))
                    continue
                n = 0
                for page, table in pages:
                    for cells in table:
                        out.append((path, page, n, [None if c is None else str(c) for c in cells]))
                        n += 1
            yield pd.DataFrame(out, columns=["path", "page", "row_no", "cells"])

    return files.select("path", "content").mapInPandas(rows, "path string, page int, row_no long, cells array<string>")


def page_text(files: DataFrame, remote: Callable[[bytes], str] | None, local: Callable[[bytes], str]) -> DataFrame:
    """Text of binary documents: the remote reader, else the local one; ``status`` tells which."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                text, status = None, "failed"
                for name, reader in (("done", remote), ("fallback", local)):
                    if reader is None:
                        continue
                    try:
                        text, status = reader(bytes(content)), name
                        break
                    except Exception:  # noqa: BLE001 the next reader is tried
                        continue
                out.append((path, text, status))
            yield pd.DataFrame(out, columns=["path", "text", "status"])

    return files.select("path", "content").mapInPandas(read, "path string, text string, status string")


def extracted(rows: DataFrame, text_col: str, call: Callable[[str], str] | None, into: str = "answer") -> DataFrame:
    """``rows`` with the JSON answer of an extraction model; null without a model or on failure."""
    if call is None:
        return rows.withColumn(into, F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def safe(t):
            try:
                return call(t) if t is not None else None
            except Exception:  # noqa: BLE001 a failed call counts as no answer
                return None

        for s in batches:
            yield pd.Series([safe(t) for t in s], dtype=object)

    return rows.withColumn(into, ask(rows[text_col]))


def reload(df: DataFrame, path: str) -> int:
    """The rows become the next version of the table at ``path``, in one step for its readers
    (``versions.read``); a failed job leaves the version before. Returns the version's number."""
    return versions.publish(df, path)


def dump_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
