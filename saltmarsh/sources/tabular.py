"""Readers: property tables in CSV, manifests, text corpora, JSON lines, page ranges, unit catalogues."""

from __future__ import annotations

import re

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The header that opens the data of a property table, and its columns (fixed values).
HEADER = "Salt,Composition range"
COLUMNS = ("salt", "composition", "code", "t_min", "t_max", "uncertainty", "data1", "data2", "data3", "data4", "data5", "comment", "formatting_comment")


def property_rows(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Rows of property tables (path by property) with property and place of the row in its file.

    Everything up to the header line is skipped; a row without exactly 13 fields is no data; quoted fields may hold
    commas, quotes and line ends. Empty fields are empty texts. Files are small documents: each is read by one task.
    """

    def parse(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io

        for page in pages:
            rows = []
            for prop, text in zip(page["property"], page["value"]):
                at = text.find(HEADER)
                if at < 0:
                    raise ValueError(f"{prop}: no header line {HEADER!r}")
                reader = csv.reader(io.StringIO(text[at:]), strict=False)
                next(reader)
                rows += [(prop, i, *r) for i, r in enumerate(r for r in reader if len(r) == len(COLUMNS))]
            yield pd.DataFrame(rows, columns=["property", "row", *COLUMNS])

    parts = [spark.read.text(path, wholetext=True).select(F.lit(p).alias("property"), "value") for p, path in files.items()]
    pages = parts[0]
    for p in parts[1:]:
        pages = pages.unionByName(p)
    return pages.mapInPandas(parse, T.StructType([T.StructField("property", T.StringType()), T.StructField("row", T.LongType()), *(T.StructField(c, T.StringType()) for c in COLUMNS)]))


def text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """document (file name without suffix), text of every `*.txt` below a folder."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.txt$", "")
    return df.select(F.url_decode(name).alias("document"), F.col("value").alias("text"))


def one_text_each(corpus: DataFrame, documents: list[str], suffix: str = ".normalized") -> DataFrame:
    """Texts of the listed documents, one each: the designated one (document with the suffix) where there is one, else the raw one.

    A document that is held in both forms counts once, so its terms aren't counted twice.
    """
    own = F.regexp_replace("document", f"{re.escape(suffix)}$", "")
    c = corpus.select(own.alias("document"), F.endswith("document", F.lit(suffix)).alias("_designated"), "text").where(F.col("document").isin(documents))
    return c.groupBy("document").agg(F.max_by("text", F.struct("_designated", F.length("text"), "text")).alias("text"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """report_number, title, date, ocr_path of a Markdown table; separators, rows without four cells and without an `ocr/*.txt` link are skipped."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    df = spark.read.text(path).where(F.trim("value").startswith("|")).select(cells.alias("c")).where(F.size("c") == 4)
    df = df.where(~F.forall("c", lambda x: x.rlike(r"^:?-+:?$")))
    link = F.regexp_extract(F.col("c")[3], r"(ocr/[^)\s\"]+\.txt)", 1)
    return df.select(F.col("c")[1].alias("report_number"), F.col("c")[0].alias("title"), F.col("c")[2].alias("date"), link.alias("ocr_path")).where("ocr_path <> ''")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, fields that are missing are null."""
    return spark.read.schema(schema).json(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """JSON lines with keys in order of name, nulls written out and letters as they are, so equal rows give equal lines."""
    one = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    rows.select(one.alias("value")).write.text(path)


def page_text(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """document, text: pages within 1-based inclusive ranges, in order, with an empty line between; a page in two ranges counts once.

    pages: document, page, text; ranges: document, start, end.
    """
    kept = pages.join(ranges, (pages["document"] == ranges["document"]) & pages["page"].between(ranges["start"], ranges["end"]), "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))  # pages of one document
    return kept.groupBy("document").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("text"))


def unit_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(property, quantity_kind, unit_curie) and (unit) of a JSON unit catalogue."""
    raw = spark.read.json(path, multiLine=True)
    props = raw.selectExpr("from_json(to_json(properties), 'map<string, struct<quantityKind string, canonicalUnit string, unitCurie string>>') AS m")
    props = props.select(F.explode("m").alias("property", "u")).select("property", F.col("u.quantityKind").alias("quantity_kind"), F.col("u.unitCurie").alias("unit_curie"), F.col("u.canonicalUnit").alias("unit"))
    return props, raw.select(F.explode("allowedUnits").alias("unit"))


def sse_events(text: Column) -> Column:
    """array of struct(event, data) of a server-sent event stream; comments and empty frames are dropped."""
    frames = F.filter(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n\n"), lambda f: F.trim(f) != "")
    data = lambda f: F.array_join(F.transform(F.filter(F.split(f, "\n"), lambda line: F.startswith(line, F.lit("data:"))), lambda line: F.regexp_replace(line, "^data: ?", "")), "\n")
    events = F.transform(frames, lambda f: F.struct(F.when(f.rlike(r"(?m)^event:"), F.trim(F.regexp_extract(f, r"(?m)^event: ?(.*)$", 1))).otherwise("message").alias("event"), data(f).alias("data")))
    return F.filter(events, lambda e: e["data"] != "")


def sse_frame(event: Column, payload: Column) -> Column:
    """One frame of a server-sent event stream; payload is a struct."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n"))


def selected_reports(every: list[str], wanted: list[str] | None = None, limit: int | None = None) -> list[str]:
    """The wanted reports in the order of the curated list, then the first `limit`; unknown ids and limits below 1 are errors."""
    if wanted is not None:
        if unknown := [r for r in wanted if r not in every]:
            raise ValueError(f"unknown reports: {', '.join(unknown)}; known are {', '.join(every)}")
        every = [r for r in every if r in set(wanted)]
    if limit is not None and limit < 1:
        raise ValueError(f"a limit of {limit} is below 1")
    return every[:limit]


def in_curated_order(rows: DataFrame, reports: list[str], column: str = "report") -> DataFrame:
    """Rows of the reports with `ordinal`, their place in the list, by which an output is sorted at its edge."""
    place = F.create_map(*[F.lit(x) for i, r in enumerate(reports) for x in (r, i)]) if reports else F.create_map(F.lit(""), F.lit(-1))
    return rows.withColumn("ordinal", place[F.col(column)]).where("ordinal >= 0")
