"""Sources and sinks: pinned Parquet, JSON lines, delimited tables, file trees, patches."""

from __future__ import annotations

import csv
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pinned(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A Parquet table whose columns must be exactly these, in this order."""
    df = spark.read.parquet(path)
    if df.columns != columns:
        raise ValueError(f"columns of {path}: {df.columns}, not {columns}")
    return df


def write_sorted(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Written in the keys' order with zstd, then read again: rows, columns and unique keys must agree."""
    df.orderBy(*keys).write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.parquet(path)
    if back.columns != df.columns or back.count() != df.count():
        raise ValueError(f"{path} does not hold what was written")
    if back.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"{path} has repeated keys")
    return back


def write_json_lines(df: DataFrame, path: str) -> None:
    """One compact JSON object a line, nulls kept, keys in the order of the columns' names."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that is no object of the schema fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_delimited(spark: SparkSession, path: str, sep: str = ",", most_columns: int = 32) -> DataFrame:
    """A CSV or TSV file with a header of unique names, all columns as text."""
    df = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"', quote='"')
    if len(df.columns) > most_columns or len(set(df.columns)) < len(df.columns):
        raise ValueError(f"header of {path}")
    return df


def delimited_rows(text: str, sep: str = ",", most_columns: int = 32) -> list[tuple[int, int, int, dict]]:
    """(row number, first line, last line, values) of a delimited text: quoted fields may span lines, whose numbers are kept."""
    lines, out, at, header = text.split("\n"), [], 0, None
    reader = csv.reader((x + "\n" for x in lines), delimiter=sep)
    for values in reader:
        first, at = at + 1, reader.line_num
        if not values:
            continue
        if header is None:
            header = values
            if len(header) > most_columns or len(set(header)) < len(header):
                raise ValueError("header")
        else:
            out.append((len(out) + 1, first, at, dict(zip(header, values))))
    return out


def table_rows(files: DataFrame, sep: str = ",") -> DataFrame:
    """The rows of delimited files (path, content) with their physical lines; a file without a usable header gives none."""

    def run(batches):
        for b in batches:
            rows = []
            for path, text in zip(b.path, b.content):
                try:
                    rows += [(path, *r) for r in delimited_rows(text or "", sep)]
                except (ValueError, csv.Error):
                    continue
            yield pd.DataFrame(rows, columns=["path", "row_no", "line_start", "line_end", "fields"])

    return files.select("path", "content").mapInPandas(run, "path string, row_no bigint, line_start bigint, line_end bigint, fields map<string,string>")


def typed_records(lines: DataFrame, column: str, types: list[str]) -> DataFrame:
    """JSON objects of the given record types with their type; other lines give none."""
    kind = F.when(F.try_parse_json(column).isNotNull(), F.get_json_object(column, "$.record_type"))
    return lines.withColumn("record_type", kind).where(F.col("record_type").isin(types))


def read_results(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """JSON results of a folder tree, one object a file, with the file's path."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("multiLine", "true").json(root).withColumn("result_path", F.col("_metadata.file_path"))


def read_tree(spark: SparkSession, root: str, least_text: float = 0.9) -> DataFrame:
    """Every file below a folder: path relative to it, length, content as text, and a reason where it is left out (binary, not UTF-8)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    nul = F.locate("00", F.hex(F.substring("content", 1, 4096)))
    text = F.try_validate_utf8(F.col("content").cast("string")) if hasattr(F, "try_validate_utf8") else F.col("content").cast("string")
    reason = F.when((nul > 0) & (F.pmod(nul, F.lit(2)) == 1), "binary").when(text.isNull() & (F.col("length") > 0), "not_utf8")
    return raw.select(rel.alias("path"), "length", reason.alias("reason"), F.when(reason.isNull(), text).alias("content"))


def check_listing(tree: DataFrame, listed: DataFrame) -> DataFrame:
    """Paths that are on one side only: (path, problem) with problem missing or unlisted."""
    a = listed.select("path").join(tree.select("path"), "path", "left_anti").withColumn("problem", F.lit("missing"))
    return a.unionByName(tree.select("path").join(listed.select("path"), "path", "left_anti").withColumn("problem", F.lit("unlisted")))


def tree_digest(tree: DataFrame, by: list[str], path: str = "path", content: str = "content") -> DataFrame:
    """A digest of each tree that depends on paths and contents only: SHA-256 over the ordered digests of its files."""
    one = F.sha2(F.concat(F.length(path).cast("string"), F.lit(":"), F.col(path), F.lit(":"), F.coalesce(F.length(content), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(content, F.lit(""))), 256)
    files = tree.groupBy(*by, path).agg(F.min(one).alias("_d"))
    return files.groupBy(*by).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat(F.col(path), F.lit(" "), F.col("_d")))), "\n"), 256).alias("digest"), F.count("*").alias("files"))


_HUNK = re.compile(r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@")


def patch_lines(text: str) -> list[tuple[str, int, str]]:
    """(path, line in the new file, + or -) of a unified diff's changes; a removal stands at the line it leaves."""
    out, path, new = [], None, None
    for line in text.split("\n"):
        if line.startswith("+++ "):
            path, new = re.sub(r"^[ab]/", "", line[4:].split("\t")[0].strip()), None
        elif m := _HUNK.match(line):
            new = int(m[2])
        elif new is not None and path:
            if line.startswith("+"):
                out.append((path, new, "+"))
                new += 1
            elif line.startswith("-") and not line.startswith("--- "):
                out.append((path, new, "-"))
            elif line.startswith(" ") or not line:
                new += 1
    return out


def changed_lines(patches: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, line, sign) of all changes of the patches; null texts give none."""

    def run(batches):
        for b in batches:
            rows = [(k, *r) for k, t in zip(b[key], b[text]) if t for r in patch_lines(t)]
            yield pd.DataFrame(rows, columns=[key, "path", "line", "sign"])

    kind = dict(patches.dtypes)[key]
    return patches.select(key, text).mapInPandas(run, f"{key} {kind}, path string, line bigint, sign string")


def sessions_as_lines(events: DataFrame, by: str, order: str) -> DataFrame:
    """One row a session with its events in order as a JSON array; a session's events are bounded."""
    item = F.struct(F.col(order), *[c for c in events.columns if c not in (by, order)])
    return events.groupBy(by).agg(F.to_json(F.sort_array(F.collect_list(item))).alias("trajectory"), F.count("*").alias("events"))


def first_unseen(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet, one a key: what a resumed run has left to do."""
    left = df.join(done.select(key).distinct(), key, "left_anti")
    w = Window.partitionBy(key).orderBy(*[F.col(c) for c in df.columns if c != key])
    return left.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
