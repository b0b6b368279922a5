"""Scoresheets: nested JSON documents in, flat headers and lines out.

A sheet is one JSON object per file line. Numbers and texts are kept apart
(VARIANT), because only real numbers count in an automatic total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.exprs import as_number, col, trimmed

SHEET_SCHEMA = (
    "submission_id BIGINT, user_id BIGINT, team_id VARIANT, date STRING, yardage VARIANT, roundNumber VARIANT, "
    "first_pos BIGINT, shooters ARRAY<STRUCT<name: STRING, stations: ARRAY<VARIANT>, total: VARIANT, "
    "subFor: STRING, roundNumber: VARIANT>>"
)
# In files, documents that do not parse keep their text here.
MALFORMED = "_corrupt_record"
FILE_SCHEMA = f"{SHEET_SCHEMA}, {MALFORMED} STRING"
STATION_FIELDS = [f"st{i}" for i in range(1, 6)]
HEADER_FIELDS = ["submission_id", "user_id", "team_id", "raw_date", "raw_yardage", "raw_round_number"]
DOCUMENT_FIELDS = ["head_hash", "first_pos", "lines_hash"]
LINE_FIELDS = ["pos", "raw_name", *STATION_FIELDS, "station_sum", "raw_total", "raw_sub_for", "raw_row_round"]


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).json(path)


def parse_sheets(docs: DataFrame, text: str = "doc") -> DataFrame:
    """Sheets from a column of JSON text. A text that is no sheet is a row of NULLs that keeps it in MALFORMED."""
    parsed = F.from_json(text, FILE_SCHEMA, {"columnNameOfCorruptRecord": MALFORMED})
    return docs.select(parsed.alias("s")).select("s.*")


def broken_sheets(sheets: DataFrame) -> DataFrame:
    """The documents that did not parse."""
    return sheets.filter(F.col(MALFORMED).isNotNull()).select("submission_id", MALFORMED)


def _is_number(value: Column) -> Column:
    # BIGINT, DECIMAL(p,s), DOUBLE or FLOAT.
    return F.substring(F.schema_of_variant(value), 1, 3).isin("BIG", "DEC", "DOU", "FLO")


def _text(value: str | Column) -> Column:
    """A JSON scalar as the text the database would be given; NULL for null or missing.

    Numbers are judged as numbers: 2e1 and 20.0 are 20. Texts stay as they are.
    """
    value = col(value)
    number = F.when(_is_number(value), value.try_cast("double"))
    whole = number.try_cast("bigint")
    return F.when(whole == number, whole.cast("string")).otherwise(value.cast("string"))


def _team(value: str | Column) -> Column:
    """The number of a team given as a number or as text; NULL for none, 0 and anything that is no whole number."""
    text = _text(value)
    number = as_number(trimmed(F.when(text != "", text)))
    whole = number.try_cast("int")
    return F.when((whole == number) & (whole != 0), whole)


def one_per_key(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per key, the same one on every run, also when repeats differ."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*")


def _header_columns() -> list[Column]:
    return [
        F.col("submission_id"),
        F.col("user_id"),
        _team("team_id").alias("team_id"),
        F.col("date").alias("raw_date"),
        _text("yardage").alias("raw_yardage"),
        _text("roundNumber").alias("raw_round_number"),
    ]


def _line_columns() -> list[Column]:
    """Raw texts of ``line`` and the sum of its numeric entries.

    ``first_pos`` lets a long sheet arrive in several documents; it is the
    position of the document's first line and 1 when missing.
    """
    stations = F.col("line.stations")
    numbers = F.filter(stations, _is_number)
    total = F.aggregate(numbers, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return [
        (F.coalesce("first_pos", F.lit(1)) + F.col("offset")).cast("bigint").alias("pos"),
        F.col("line.name").alias("raw_name"),
        *[_text(F.get(stations, F.lit(i))).alias(name) for i, name in enumerate(STATION_FIELDS)],
        F.when(F.size(numbers) > 0, total).alias("station_sum"),
        _text("line.total").alias("raw_total"),
        F.col("line.subFor").alias("raw_sub_for"),
        _text("line.roundNumber").alias("raw_row_round"),
    ]


def sheet_header_rows(sheets: DataFrame) -> DataFrame:
    """One row per sheet with its raw header texts, also when it came in several documents."""
    return one_per_key(sheets.filter("submission_id IS NOT NULL").select(*_header_columns()), "submission_id")


def sheet_line_rows(sheets: DataFrame) -> DataFrame:
    """One row per shooter line, in sheet order."""
    lines = sheets.select("submission_id", "first_pos", F.posexplode("shooters").alias("offset", "line"))
    return lines.select("submission_id", *_line_columns())


def flat_sheets(sheets: DataFrame) -> DataFrame:
    """Lines with their sheet's header beside them, in one pass over the documents.

    A sheet without lines is one row without a position. ``rows_to_headers`` and
    ``rows_to_lines`` take the two apart again.
    """
    header = _header_columns()
    shape = F.xxhash64(*[F.to_json(F.struct(c)) for c in ("user_id", "team_id", "date", "yardage", "roundNumber")])
    exploded = sheets.withColumns({"head_hash": shape, "lines_hash": F.xxhash64(F.to_json("shooters"))}).select(
        *header, MALFORMED, "head_hash", "lines_hash", F.coalesce("first_pos", F.lit(1)).alias("first_pos"),
        F.posexplode_outer("shooters").alias("offset", "line"),
    )
    return exploded.select(*HEADER_FIELDS, MALFORMED, *DOCUMENT_FIELDS, *_line_columns())


def line_count() -> Column:
    """Lines of one document, whose positions have no gaps, however often it arrived."""
    return F.coalesce(F.max("pos") - F.min("pos") + 1, F.lit(0)).cast("bigint")


def first_rows(rows: DataFrame) -> DataFrame:
    """One row per arrived document of flat sheets: that of its first line, or its only one."""
    return rows.filter("pos IS NULL OR pos = first_pos")


def odd_sheets(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Of flat rows the sheets that do not count just as they came, each once: (submission_id, broken, late).

    They came in several documents, or have one that does not parse (``broken``), or
    are ``known`` (``late``). Documents are counted before the shuffle.
    """
    named = first_rows(rows).filter("submission_id IS NOT NULL")
    judged = known.select("submission_id", F.lit(True).alias("_late")).distinct()
    return (
        named.groupBy("submission_id")
        .agg(F.count(F.lit(1)).alias("documents"), F.max(F.col(MALFORMED).isNotNull()).alias("broken"))
        .join(judged, "submission_id", "left")
        .withColumn("late", F.coalesce("_late", F.lit(False)))
        .filter("documents > 1 OR broken OR late")
        .select("submission_id", "broken", "late")
    )


def settled_documents(rows: DataFrame) -> DataFrame:
    """The documents of flat sheets, equal ones once, with their number of lines and whether each is ``chosen``.

    Of differing documents of one sheet one set counts, whole. Parts of a sheet share
    their header and begin at different positions. Where headers differ, the documents
    of the least header hash are taken; where two parts begin at one position, the one
    of the least hash. The same documents win on every run.
    """
    keys = ["submission_id", *DOCUMENT_FIELDS]
    documents = rows.groupBy(*keys).agg(line_count().alias("n_lines"))
    head = documents.groupBy("submission_id").agg(F.min("head_hash").alias("head_hash"))
    part = documents.join(head, ["submission_id", "head_hash"], "left_semi").groupBy(
        "submission_id", "head_hash", "first_pos"
    ).agg(F.min("lines_hash").alias("lines_hash"))
    found = documents.join(part.withColumn("_chosen", F.lit(True)), keys, "left")
    return found.withColumn("chosen", F.coalesce("_chosen", F.lit(False))).drop("_chosen")


def rows_to_headers(rows: DataFrame) -> DataFrame:
    return one_per_key(rows.select(*HEADER_FIELDS), "submission_id")


def rows_to_lines(rows: DataFrame) -> DataFrame:
    lines = rows.filter("pos IS NOT NULL").select("submission_id", *LINE_FIELDS)
    return one_per_key(lines, "submission_id", "pos")


def flat_line_rows(lines: DataFrame) -> DataFrame:
    """The same line rows from lines that are already flat and have numeric stations."""
    given = [F.col(s) for s in STATION_FIELDS]
    some = F.coalesce(*given).isNotNull()
    total = sum((F.coalesce(s, F.lit(0)) for s in given[1:]), F.coalesce(given[0], F.lit(0)))
    return lines.select(
        "submission_id",
        "pos",
        "raw_name",
        *[s.cast("string").alias(n) for s, n in zip(given, STATION_FIELDS)],
        F.when(some, total.cast("double")).alias("station_sum"),
        "raw_total",
        "raw_sub_for",
        F.col("row_round_number").cast("string").alias("raw_row_round"),
    )


def sheet_documents(headers: DataFrame, lines: DataFrame, lines_per_document: int = 5_000) -> DataFrame:
    """Nested JSON documents from flat headers and lines, long sheets in several documents.

    Lines take their sheet's header along and are gathered per (sheet, block of
    positions), so even a sheet with most of all lines is spread over many rows.
    """
    line = F.struct(
        F.col("pos"),
        F.struct(
            F.col("raw_name").alias("name"),
            F.array(*STATION_FIELDS).alias("stations"),
            F.col("raw_total").alias("total"),
            F.col("raw_sub_for").alias("subFor"),
            F.col("row_round_number").alias("roundNumber"),
        ).alias("line"),
    )
    block = F.floor((F.col("pos") - 1) / lines_per_document)
    # The same filter for both joins: they share the headers' shuffle.
    named = headers.filter("submission_id IS NOT NULL")
    filled = (
        lines.withColumn("block", block)
        .join(named, "submission_id")
        .groupBy(*headers.columns, "block")
        .agg(F.min("pos").alias("first_pos"), F.array_sort(F.collect_list(line)).alias("lines"))
        .drop("block")
    )
    empty = named.join(lines.select("submission_id").distinct(), "submission_id", "left_anti").unionByName(
        headers.filter("submission_id IS NULL")
    )
    body = F.struct(
        "submission_id",
        *([F.col("user_id")] if "user_id" in headers.columns else []),
        "team_id",
        F.col("raw_date").alias("date"),
        F.col("raw_yardage").alias("yardage"),
        F.col("raw_round_number").alias("roundNumber"),
        "first_pos",
        F.coalesce(F.transform("lines", lambda e: e["line"]), F.array()).alias("shooters"),
    )
    return filled.unionByName(empty, allowMissingColumns=True).select(
        "submission_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("doc")
    )
