"""Cleaning: a live transformation, the same as a PySpark script, and as SQL."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..settings import DATE_SENTINELS, TEXT_SENTINELS

Payload = dict[str, Any]
Step = tuple[str, str, Any]


def steps(p: Payload) -> list[Step]:
    """(kind, column, detail) in the order they are done, from a profile."""
    out: list[Step] = [("dedup", "*", None)] if p["duplicates"]["n_extra"] else []
    by = {c["column"]: c for c in p["columns"]}
    empty = {c for c, r in by.items() if r["characteristic"] == "empty"}
    out += [("drop", c, None) for c in by if c in empty]
    found: dict[str, list] = {}
    for s in p["sentinels"]:
        found.setdefault(s["column"], []).append((s["kind"], s["value"]))
    reasons = {d["column"]: d["reasons"].split(",") for d in p["damage"]}
    for c, r in by.items():
        if c in empty:
            continue
        if c in found:
            out.append((f"{found[c][0][0]} sentinels", c, [v for _, v in found[c]]))
        if "spelling" in reasons.get(c, ()):
            out.append(("spelling", c, None))
        if r["logical_type"] == "text date":
            out.append(("date", c, None))
        if r.get("pattern") in ("CPF", "E-mail", "Telefone") or r["role"] == "person name":
            out.append(("pseudonym", c, None))
    return out


def not_automatic(p: Payload) -> list[str]:
    """Defects that need a person."""
    kinds = {"mojibake": "load again with the right encoding", "invalid_document": "check the documents", "mixed_types": "separate the types", "pii_in_text": "decide on personal data in the text"}
    return [f"{d['column']}: {kinds[x]}" for d in p["damage"] for x in d["reasons"].split(",") if x in kinds]


def parse_date(c):
    formats = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm")
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats))


def clean(df: DataFrame, p: Payload, key: str | None = None) -> DataFrame:
    """The table with the profile's steps done. Pseudonyms need a key; without one those columns stay as they are."""
    for kind, c, detail in steps(p):
        x = F.col(f"`{c}`")
        if kind == "dedup":
            df = df.dropDuplicates()
        elif kind == "drop":
            df = df.drop(c)
        elif kind == "text sentinels":
            df = df.withColumn(c, F.when(~text.fold(x).isin(*[v for v in detail if v in TEXT_SENTINELS]), x))
        elif kind == "number sentinels":
            df = df.withColumn(c, F.when(~x.isin(*map(float, detail)), x))
        elif kind == "date sentinels":
            df = df.withColumn(c, F.when(~F.date_format(x, "yyyy-MM-dd").isin(*[v for v in detail if v in DATE_SENTINELS]), x))
        elif kind == "spelling":
            df = df.withColumn(c, F.upper(F.trim(x)))
        elif kind == "date":
            df = df.withColumn(c, parse_date(x))
        elif kind == "pseudonym" and key:
            df = df.withColumn(c, text.pseudonym(x.cast("string"), key))
    return df


def script(p: Payload, path: str) -> str:
    """A PySpark script of the same steps. Every name and value is a Python literal, so none can inject code."""
    lines = ["import os", "", "from pyspark.sql import SparkSession", "from pyspark.sql import functions as F", "", "from tabsight.functions import text", "from tabsight.sinks.cleaning import parse_date", "", "spark = SparkSession.builder.getOrCreate()", f"df = spark.read.parquet({path!r})", 'key = os.environ.get("PSEUDONYM_KEY")']
    for kind, c, detail in steps(p):
        x = f"F.col({'`' + c.replace('`', '``') + '`'!r})"
        body = {
            "dedup": "df = df.dropDuplicates()",
            "drop": f"df = df.drop({c!r})",
            "text sentinels": f"df = df.withColumn({c!r}, F.when(~text.fold({x}).isin(*{detail!r}), {x}))",
            "number sentinels": f"df = df.withColumn({c!r}, F.when(~{x}.isin(*{[float(v) if kind.startswith('number') else v for v in detail or []]!r}), {x}))",
            "date sentinels": f"df = df.withColumn({c!r}, F.when(~F.date_format({x}, 'yyyy-MM-dd').isin(*{detail!r}), {x}))",
            "spelling": f"df = df.withColumn({c!r}, F.upper(F.trim({x})))",
            "date": f"df = df.withColumn({c!r}, parse_date({x}))",
            "pseudonym": f"df = df.withColumn({c!r}, text.pseudonym({x}.cast('string'), key)) if key else df",
        }[kind]
        lines.append(body)
    lines += [f"# by hand: {x!r}" for x in not_automatic(p)]
    return "\n".join(lines) + "\n"


def select_sql(p: Payload, table: str) -> str:
    """The same steps as one SELECT."""
    q = lambda x: "`" + x.replace("`", "``") + "`"
    lit = lambda v: "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    done: dict[str, str] = {c["column"]: q(c["column"]) for c in p["columns"]}
    distinct = ""
    for kind, c, detail in steps(p):
        if kind == "dedup":
            distinct = "DISTINCT "
        elif kind == "drop":
            done.pop(c)
        elif kind == "text sentinels":
            done[c] = f"CASE WHEN lower(trim({q(c)})) NOT IN ({', '.join(map(lit, detail))}) THEN {done[c]} END"
        elif kind == "number sentinels":
            done[c] = f"CASE WHEN {q(c)} NOT IN ({', '.join(detail)}) THEN {done[c]} END"
        elif kind == "date sentinels":
            done[c] = f"CASE WHEN date_format({q(c)}, 'yyyy-MM-dd') NOT IN ({', '.join(map(lit, detail))}) THEN {done[c]} END"
        elif kind == "spelling":
            done[c] = f"upper(trim({done[c]}))"
        elif kind == "date":
            done[c] = f"try_cast({done[c]} AS TIMESTAMP)"
    return f"SELECT {distinct}" + ", ".join(f"{x} AS {q(c)}" for c, x in done.items()) + f" FROM {q(table)}"


def power_query(p: Payload, path: str, header_row: int = 0) -> str:
    """The same steps as a Power Query expression for a text table."""
    quote = lambda x: '"' + x.replace('"', '""') + '"'
    out = [f"Source = Csv.Document(File.Contents({quote(path)}))", f"Skipped = Table.Skip(Source, {header_row})", "Promoted = Table.PromoteHeaders(Skipped)"]
    last = "Promoted"
    for i, (kind, c, detail) in enumerate(steps(p)):
        body = {
            "dedup": f"Table.Distinct({last})",
            "drop": f"Table.RemoveColumns({last}, {{{quote(c)}}})",
            "spelling": f"Table.TransformColumns({last}, {{{{{quote(c)}, each Text.Upper(Text.Trim(_))}}}})",
            "date": f"Table.TransformColumnTypes({last}, {{{{{quote(c)}, type datetime}}}})",
        }.get(kind)
        if kind.endswith("sentinels"):
            body = f"Table.TransformColumns({last}, {{{{{quote(c)}, each if List.Contains({{{', '.join(quote(str(v)) for v in detail)}}}, Text.Lower(Text.Trim(Text.From(_)))) then null else _}}}})"
        if body:
            last = f"Step{i}"
            out.append(f"{last} = {body}")
    return "let\n  " + ",\n  ".join(out) + f"\nin\n  {last}\n"
