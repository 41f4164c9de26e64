"""Loading tables: by extension, from addresses, from local databases."""

from __future__ import annotations

import bz2
import csv
import gzip
import io
import lzma
import re
import zipfile
from collections import Counter
from dataclasses import dataclass, field
from pathlib import PurePosixPath
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, xlsx
from .layout import Layout, analyze_body, header_row, unique_labels


class IngestionError(Exception):
    """A table could not be loaded."""


class FileFormatError(IngestionError):
    pass


class EncodingDetectionError(IngestionError):
    pass


TEXT, PACKED = (".csv", ".tsv", ".txt"), (".gz", ".bz2", ".zip", ".xz")
TABLES = (*TEXT, ".parquet", ".json", ".jsonl", ".xlsx")
#: Limits of an archive: bytes unpacked, and how much it may shrink.
MOST_UNPACKED, MOST_RATIO = 10 << 30, 250
SAMPLE = 256 << 10


@dataclass
class SourceTable:
    df: DataFrame
    name: str
    origin: str
    layout: Layout = field(default_factory=Layout)
    original_rows: int | None = None
    sample_reason: str | None = None


def _suffixes(path: str) -> tuple[str, str, str]:
    """(stem, suffix, packing)"""
    name = PurePosixPath(urlparse(path).path if "://" in path else path).name
    packed = next((p for p in PACKED if name.lower().endswith(p)), "")
    bare = name[: len(name) - len(packed)] if packed else name
    stem, dot, suffix = bare.rpartition(".")
    return (stem, f".{suffix.lower()}", packed) if dot else (bare, "", packed)


def detect_encoding(data: bytes) -> str:
    """UTF-8 if the bytes are that, else the best guess; an error if there is none."""
    for n in range(4):  # the sample may end within a character
        try:
            data[: len(data) - n].decode("utf-8")
            return "utf-8"
        except UnicodeDecodeError:
            continue
    from charset_normalizer import from_bytes

    if not (best := from_bytes(data).best()):
        raise EncodingDetectionError("the encoding cannot be told")
    return best.encoding


def sniff_separator(lines: list[str]) -> str:
    """Of comma, semicolon, tab and bar the one by which most rows have one number of fields, and then most fields."""
    lines = [x for x in lines if x.strip()][:50]

    def rate(sep: str) -> tuple[float, int]:
        sizes = Counter(len(r) for r in csv.reader(lines, delimiter=sep))
        fields, rows = max(sizes.items(), key=lambda x: (x[1], x[0]))
        return (round(rows / len(lines), 3), fields) if fields > 1 else (0.0, 0)

    best = max(",;\t|", key=rate) if lines else ","
    return best if lines and rate(best)[1] > 1 else ","


def _unpacked_head(spark: SparkSession, path: str, packing: str) -> bytes:
    raw = store.head(spark, path, SAMPLE)
    if packing == ".gz":
        return gzip.GzipFile(fileobj=io.BytesIO(raw)).read1(SAMPLE)
    if packing == ".bz2":
        return bz2.BZ2Decompressor().decompress(raw, SAMPLE)
    if packing == ".xz":
        return lzma.LZMADecompressor().decompress(raw, SAMPLE)
    return raw


def check_zip(data: bytes) -> zipfile.ZipInfo:
    """The one text member of an archive; an error for anything else or anything suspicious."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        members = [m for m in z.infolist() if not m.is_dir()]
    if len(members) != 1:
        raise FileFormatError("a ZIP archive must hold exactly one file")
    m = members[0]
    if not m.filename.lower().endswith(TEXT):
        raise FileFormatError(f"{m.filename} is not a text table")
    if m.file_size > MOST_UNPACKED or m.file_size > MOST_RATIO * max(1, m.compress_size):
        raise FileFormatError("the archive unpacks to too much")
    return m


def _text(spark: SparkSession, path: str, packing: str, first_row: int | None, detect: bool, scratch: str | None) -> tuple[DataFrame, Layout]:
    if packing in (".zip", ".xz"):  # no codec of Spark's: unpacked into the shared folder
        from uuid import uuid4

        data = store.content(spark, path, 1 << 30)
        if packing == ".zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                data = z.read(check_zip(data))
        else:
            data = lzma.decompress(data)
        root = scratch or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
        path, packing = store.put(spark, f"{root.rstrip('/')}/unpacked-{uuid4().hex}.csv", [data]), ""
    sample = _unpacked_head(spark, path, packing)
    encoding = detect_encoding(sample)
    lines = sample.decode(encoding, "replace").splitlines()
    sep = sniff_separator(lines)
    matrix = [[c.strip() or None for c in r] for r in csv.reader(lines[:40], delimiter=sep)]
    layout = Layout(separator=sep, encoding=encoding)
    at = first_row if first_row is not None else header_row(matrix, layout) if detect else 0
    layout.header_row = at
    width = max((len(r) for r in matrix), default=1)
    labels = unique_labels(matrix[at] + [None] * (width - len(matrix[at])) if matrix else [None])
    schema = ", ".join(f"`{x.replace('`', '``')}` string" for x in labels)
    df = spark.read.csv(path, sep=sep, encoding=encoding, schema=schema, mode="PERMISSIVE", multiLine=any(x.count('"') % 2 for x in lines[:200]), escape='"', ignoreLeadingWhiteSpace=False)
    df = df.withColumn("_row", F.monotonically_increasing_id())
    # Rows up to the header are cut by their texts' order, which one file keeps.
    skip = df.orderBy("_row").limit(at + 1).agg(F.max("_row")).first()[0] if matrix else None
    return (df.where(F.col("_row") > skip) if skip is not None else df), layout


def bad_bytes(df: DataFrame) -> list[str]:
    """Text columns that hold the mark of undecodable bytes."""
    texts = [c for c, k in df.dtypes if k == "string"]
    if not texts:
        return []
    row = df.agg(*(F.count_if(F.contains(F.col(f"`{c}`"), F.lit("�"))).alias(f"n{i}") for i, c in enumerate(texts))).first()
    return [c for i, c in enumerate(texts) if row[i]]


def load_table(spark: SparkSession, path: str, sheet: int | str = 0, first_row: int | None = None, detect_layout: bool = True, row_limit: int | None = None, scratch: str | None = None) -> SourceTable:
    """A table from a file or address, its layout worked out and its types inferred."""
    if path.startswith(("http://", "https://")):
        return load_url(spark, path, row_limit)
    stem, suffix, packing = _suffixes(path)
    try:
        if suffix in TEXT:
            df, layout = _text(spark, path, packing, first_row, detect_layout, scratch)
            df = analyze_body(df, layout) if detect_layout else df.drop("_row")
        elif packing:
            raise FileFormatError(f"only text tables are read from {packing}")
        elif suffix == ".parquet":
            df, layout = spark.read.parquet(path), Layout()
        elif suffix in (".json", ".jsonl"):
            df, layout = spark.read.json(path, multiLine=suffix == ".json"), Layout()
        elif suffix == ".xlsx":
            df, layout = xlsx.read_sheet(spark, path, sheet, first_row, detect_layout)
        else:
            raise FileFormatError(f"no reader for {suffix or path}")
    except IngestionError:
        raise
    except Exception as e:
        raise IngestionError(f"{path}: {e}") from e
    if found := bad_bytes(df):
        layout.warnings.append(f"undecodable bytes in {', '.join(found)}")
    return limited(SourceTable(df, stem, path, layout), row_limit)


def limited(table: SourceTable, n: int | None, seed: int = 42) -> SourceTable:
    """At most n rows, drawn uniformly; the rows there were are noted."""
    if n is not None and (total := table.df.count()) > n:
        table.df = table.df.withColumn("_r", F.rand(seed)).orderBy("_r").limit(n).drop("_r")
        table.original_rows, table.sample_reason = total, f"{n} of {total} rows drawn"
    return table


def load_url(spark: SparkSession, url: str, row_limit: int | None = None) -> SourceTable:
    """A table from an address: Parquet, JSON or else text; fetched into the shared folder."""
    from urllib.request import urlopen
    from uuid import uuid4

    stem, suffix, _ = _suffixes(url)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    target = f"{root.rstrip('/')}/fetched-{uuid4().hex}{suffix if suffix in ('.parquet', '.json', '.jsonl') else '.csv'}"
    with urlopen(url, timeout=60) as r:
        store.put(spark, target, iter(lambda: r.read(1 << 20), b""))
    out = load_table(spark, target, row_limit=row_limit)
    out.name, out.origin = stem or "table", url
    return out


def load_query(spark: SparkSession, source: str, sql: str) -> SourceTable:
    """A SELECT on ``sqlite:///file`` or ``duckdb:///file`` (opened for reading), or ``spark`` for the session's views."""
    if not re.match(r"\s*(select|with)\b", sql, re.I):
        raise IngestionError("only SELECT and WITH queries are run")
    if source == "spark":
        return SourceTable(spark.sql(sql), "query", source)
    kind, _, path = source.partition(":///")
    import pyarrow as pa

    if kind == "duckdb":
        import duckdb

        with duckdb.connect(path, read_only=True) as c:
            table = c.sql(sql).to_arrow_table()
    elif kind == "sqlite":
        import sqlite3
        from contextlib import closing

        with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as c:
            cursor = c.execute(sql)
            names, rows = [d[0] for d in cursor.description], cursor.fetchall()
        table = pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)})
    else:
        raise IngestionError(f"no source {source}")
    return SourceTable(spark.createDataFrame(table), f"query_{PurePosixPath(path).stem}", source)


def discover(spark: SparkSession, folder: str) -> list[str]:
    """The tables of a folder; .txt files only count when named."""
    found = []
    for p in store.listing(spark, folder):
        _, suffix, packing = _suffixes(p)
        if suffix in TABLES and suffix != ".txt" and (not packing or suffix in TEXT):
            found.append(p)
    return found
