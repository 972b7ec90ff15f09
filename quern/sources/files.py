"""Scans and sinks with contracts: CSV, archives, JSON, GeoJSON, HTML, pages of a remote index."""

import csv
import io
import os
import urllib.parse
import zipfile
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf


def read_csv(spark: SparkSession, path: str, required: list[str], sep: str = ",") -> DataFrame:
    """A CSV file with a header, all columns as strings, names trimmed, lower-cased and without a byte-order mark.

    Fails if one of ``required`` is missing. Compressed files are read as they
    come; gzip files are not split.
    """
    df = spark.read.csv(path, header=True, sep=sep, encoding="UTF-8", inferSchema=False, multiLine=False)
    df = df.toDF(*[c.lstrip("﻿").strip().lower() for c in df.columns])
    missing = {c.lower() for c in required} - set(df.columns)
    if missing:
        raise ValueError(f"schema drift: {sorted(missing)} not in {path}")
    return df


def unit_lists(df: DataFrame, column: str) -> DataFrame:
    """(key, item) of a JSON object of arrays, such as {"a": ["x", "y"]}."""
    parsed = F.from_json(column, "map<string,array<string>>")
    return df.select(F.explode(parsed).alias("key", "items")).select("key", F.explode("items").alias("item"))


def read_features(spark: SparkSession, path: str, code: str, name: str) -> DataFrame:
    """(code, name, kind, rings) of a GeoJSON file's features, all rings of a MultiPolygon in one list.

    Fails at run time if a code repeats or a geometry is of another kind.
    """
    schema = "features array<struct<properties: map<string,string>, geometry: struct<type:string, coordinates:string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    kind, text, ring = F.col("f.geometry.type"), F.col("f.geometry.coordinates"), "array<array<array<double>>>"
    rings = F.when(kind == "Polygon", F.from_json(text, ring)).when(kind == "MultiPolygon", F.flatten(F.from_json(text, f"array<{ring}>")))
    rows = f.select(F.col("f.properties")[code].alias("code"), F.col("f.properties")[name].alias("name"), kind.alias("kind"), rings.alias("rings"))
    return expect_unique(expect(rows, **{"polygons only": F.col("rings").isNotNull()}), ["code"])


def expect(df: DataFrame, **checks: Column) -> DataFrame:
    """``df``, failing at run time on the first row for which a named check is not true."""
    for name, ok in checks.items():
        df = df.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"expectation failed: {name}")).cast("boolean")))
    return df


def expect_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(*keys))
    return expect(df.withColumn("_n", n), **{f"unique {','.join(keys)}": F.col("_n") == 1}).drop("_n")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, sha256) of the files below ``path``."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def local_path(path: str) -> str:
    """The path of a folder or file that is mounted on all workers, without ``file:``."""
    parts = urllib.parse.urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"archives need a mounted folder, {path} is not one")
    return parts.path


def write_archives(df: DataFrame, path: str, member: str, other: dict[str, str]) -> None:
    """A ZIP archive for each partition of ``df`` below ``path``, with the rows as a tab-separated member and ``other`` members as they are.

    An archive gets its name when it is whole, so a task that is run again
    replaces it. Values must hold neither tabs nor line breaks.
    """
    folder, names = local_path(path), df.columns

    def body(batches):
        from pyspark import TaskContext

        os.makedirs(folder, exist_ok=True)
        task = TaskContext.get()
        part = f"{folder}/.{task.partitionId()}-{task.taskAttemptId()}"
        with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, text in other.items():
                archive.writestr(name, text)
            with archive.open(member, "w", force_zip64=True) as f:
                f.write(("\ufeff" + "\t".join(names) + "\n").encode())
                for batch in batches:
                    columns = [batch.column(i).to_pylist() for i in range(len(names))]
                    f.write("".join("\t".join("" if v is None else str(v) for v in row) + "\n" for row in zip(*columns)).encode())
        os.replace(part, f"{folder}/{task.partitionId()}.zip")
        yield from ()

    df.mapInArrow(body, df.schema).write.format("noop").mode("overwrite").save()


class ZipTable(DataSource):
    """Rows of the one member of a ZIP archive whose header has all required columns; the delimiter is found out.

    Options: path, an archive or a folder of archives on a file system that
    all workers see, and required (comma-separated). Columns are strings. An
    archive is a task.
    """

    @classmethod
    def name(cls) -> str:
        return "ziptable"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType()) for c in self.options["required"].split(",")])

    def reader(self, schema: T.StructType) -> "ZipTableReader":
        return ZipTableReader(local_path(self.options["path"]), [f.name for f in schema.fields])


class ZipTableReader(DataSourceReader):
    def __init__(self, path: str, required: list[str]) -> None:
        self.path, self.required = path, required

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(self.path):
            return [InputPartition(f"{self.path}/{f}") for f in sorted(os.listdir(self.path)) if f.endswith(".zip") and not f.startswith(".")]
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition):
        found = []
        with zipfile.ZipFile(partition.value) as archive:
            for member in archive.namelist():
                with archive.open(member) as f:
                    head = io.TextIOWrapper(f, "utf-8-sig", errors="replace").readline().rstrip("\r\n")
                sep = max("\t,;", key=head.count)
                if set(self.required) <= {c.strip().lower() for c in head.split(sep)}:
                    found.append((member, sep))
            if len(found) != 1:
                raise ValueError(f"{len(found)} members of {partition.value} have the columns {self.required}")
            member, sep = found[0]
            with archive.open(member) as f:
                for row in csv.DictReader(io.TextIOWrapper(f, "utf-8-sig", newline=""), delimiter=sep):
                    low = {k.strip().lower(): v for k, v in row.items() if k}
                    yield tuple(low[c] for c in self.required)


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th", "li"):
            if tag == "li" or not self.rows:
                self.rows.append([])
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th", "li") and self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


@udtf(returnType="row_no int, cells array<string>")
class HtmlRows:
    """Rows of tables and lists of an HTML page, entities decoded, white space collapsed."""

    def eval(self, html: str):
        parser = _Tables()
        parser.feed(html or "")
        for k, row in enumerate(r for r in parser.rows if r):
            yield k, row


#: Rows of an index that a remote service lets one page through.
DEEPEST = 100_000


def page_offsets(total: Column, page: int, most: int, deepest: int = DEEPEST) -> Column:
    """At most ``most`` page starts, spread evenly over an index of ``total`` rows, its first and last row included.

    Of the index ``deepest`` rows can be reached. If all pages fit, they are
    the plan. Else evenly spread starts are rounded to whole pages, half to
    even, and cut at the last full page's start; starts that fall together are
    made up for by the first pages that are not in the plan.
    """
    if page < 1 or most < 1:
        raise ValueError("page and most have to be positive")
    none = F.array().cast("array<bigint>")
    reach = F.greatest(F.lit(0), F.least(total, F.lit(deepest))).cast("long")
    pages, last = F.ceil(reach / page), F.greatest(F.lit(0).cast("long"), reach - page)
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1).cast("long"), pages) - 1), lambda i: i * page)
    step = last / F.lit(float(max(1, most - 1)))
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.least(last, (F.bround(i * step / page, 0) * page).cast("long"))))
    free = F.array_except(F.sequence(F.lit(0).cast("long"), last, F.lit(page).cast("long")), spread)
    filled = F.array_sort(F.concat(spread, F.slice(free, F.lit(1), F.lit(most) - F.size(spread))))
    return F.when(reach <= 0, none).when(pages <= most, every).when(F.lit(most == 1), F.array(F.lit(0).cast("long"))).otherwise(filled)


def state_key(name: Column, tag: str) -> Column:
    """The name under which a consumer's progress is kept: 16 hex digits of a digest of tag and name, and the name without blanks; empty names fail."""
    known = F.when(F.length(F.trim(name)) > 0, F.trim(name)).otherwise(F.raise_error(F.lit("a name has to be non-empty")).cast("string"))
    return F.concat_ws("-", F.substring(F.sha2(F.concat_ws("|", F.lit(tag), known), 256), 1, 16), F.replace(known, F.lit(" "), F.lit("_")))


def window_chunks(offset: Column, length: Column, size: int) -> Column:
    """array<struct<start, n>>: a window cut into chunks of at most ``size``."""
    starts = F.when(length > 0, F.sequence(F.lit(0).cast("long"), length - 1, F.lit(size).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.struct((offset + s).alias("start"), F.least(F.lit(size).cast("long"), length - s).alias("n")))


def last_write_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys that with the largest ``order``, which has to tell them apart."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("_r")).select(*keys, "_r.*")


def write_csv(df: DataFrame, path: str, order: list[str], compression: str | None = None) -> None:
    """Rows in a stated order, as one file for each range of it; names sort as the ranges do."""
    df.orderBy(*order).write.csv(path, header=True, compression=compression)


def write_receipt(df: DataFrame, path: str) -> None:
    """JSON lines with the columns in name order; Spark's commit makes the folder whole or absent."""
    df.select(*sorted(df.columns)).write.json(path)
