"""Command line: python -m tabsight.cli VERB ..."""

from __future__ import annotations

import argparse
import sys
from datetime import date
from pathlib import Path

from .operators import versions as V
from .operators.semantics import Context, corrections_template
from .plans.profiler import Profiler
from .sinks import cleaning, reports
from .sources.readers import discover, load_table

FORMATS = ("json", "markdown", "html", "pdf", "parquet", "script", "sql", "powerquery")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tabsight")
    p.add_argument("--out", default=".", help="folder for reports")
    p.add_argument("--vocabulary", action="append", default=[], help="YAML with more words")
    p.add_argument("--rows", type=int, help="most rows of a table")
    p.add_argument("--as-of", default=date.today().isoformat())
    v = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *places: tuple[str, str | None], **options):
        x = v.add_parser(name)
        for a, n in places:
            x.add_argument(a, **({"nargs": n} if n else {}))
        for k, o in options.items():
            x.add_argument(f"--{k}", **o)

    verb("profile", ("file", None), format={"default": "json", "help": ", ".join(FORMATS)}, sheet={"default": "0"})
    verb("batch", ("files", "+"))
    verb("model", ("files", "+"))
    verb("folder", ("folder", None), mode={"default": "auto", "choices": ["auto", "single", "batch", "model"]})
    verb("compare", ("before", None), ("after", None))
    verb("history", ("files", "+"), limits={})
    verb("contract", ("file", None))
    verb("validate", ("file", None), ("contract", None))
    verb("dictionary", ("files", "+"))
    verb("review", ("file", None))
    verb("source", ("source", None), ("sql", None))
    verb("version")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = _parser().parse_args(argv)
    if a.verb == "version":
        print("tabsight 0.1")
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    profiler = Profiler(spark, context=Context.from_yaml(*(Path(x).read_text() for x in a.vocabulary)), row_limit=a.rows, as_of=a.as_of)
    out = Path(a.out)
    out.mkdir(parents=True, exist_ok=True)

    def write(name: str, content: str | bytes) -> None:
        target = out / name
        target.write_bytes(content if isinstance(content, bytes) else content.encode())
        print(target)

    def load(path: str):
        return load_table(spark, path, row_limit=a.rows)

    def tables(paths: list[str]):
        return {t.name: t.df for t in map(load, paths)}

    if a.verb == "profile":
        if a.format not in FORMATS:
            print(f"unknown format {a.format}", file=sys.stderr)
            return 2
        p = profiler.profile_file(a.file, sheet=int(a.sheet) if a.sheet.isdigit() else a.sheet)
        name = reports.safe_names([p["metadata"]["table"]])[0]
        if a.format == "parquet":
            reports.to_parquet(spark, p, str((out / name).absolute()))
        else:
            made = {"json": ("json", reports.to_json), "markdown": ("md", reports.to_markdown), "html": ("html", reports.to_html), "pdf": ("pdf", lambda x: reports.to_pdf(reports.to_html(x))), "script": ("py", lambda x: cleaning.script(x, a.file)), "sql": ("sql", lambda x: cleaning.select_sql(x, name)), "powerquery": ("pq", lambda x: cleaning.power_query(x, a.file))}
            suffix, make = made[a.format]
            write(f"{name}.{suffix}", make(p))
    elif a.verb in ("batch", "folder", "model"):
        paths = a.files if a.verb != "folder" else discover(spark, a.folder)
        mode = a.verb if a.verb != "folder" else a.mode if a.mode != "auto" else "model" if len(paths) > 1 else "single"
        if not paths:
            print("no tables", file=sys.stderr)
            return 2
        if mode == "model":
            write("model.md", reports.model_markdown(profiler.model(tables(paths))))
        elif mode == "batch":
            write("batch.html", reports.batch_html(profiler.batch(paths)))
        else:
            for p in paths:
                made = profiler.profile_file(p)
                write(f"{reports.safe_names([made['metadata']['table']])[0]}.html", reports.to_html(made))
    elif a.verb == "compare":
        write("comparison.md", reports.comparison_markdown(profiler.compare(load(a.before).df, load(a.after).df)))
    elif a.verb == "history":
        limits = V.read_limits(Path(a.limits).read_text()) if a.limits else None
        write("history.md", reports.history_markdown(profiler.history([(t.name, t.df) for t in map(load, a.files)], limits)))
    elif a.verb == "contract":
        t = load(a.file)
        write(f"{reports.safe_names([t.name])[0]}.contract.yaml", profiler.contract(t.df, t.original_rows is not None).to_yaml())
    elif a.verb == "validate":
        result = profiler.validate(load(a.file).df, V.Contract.from_yaml(Path(a.contract).read_text()))
        write("validation.md", reports.validation_markdown(result))
        return 0 if result["approved"] else 1
    elif a.verb == "dictionary":
        write("dictionary.xlsx", reports.dictionary([profiler.profile_file(p) for p in a.files]))
    elif a.verb == "review":
        t = load(a.file)
        write(f"{reports.safe_names([t.name])[0]}.corrections.yaml", corrections_template(t.df, t.name))
    elif a.verb == "source":
        write("query.json", reports.to_json(profiler.profile_query(a.source, a.sql)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
