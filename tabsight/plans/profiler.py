"""The programmatic surface: profile, batch, model, compare, history, contract, validate."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import columns as C
from ..operators import model as M
from ..operators import quality as Q
from ..operators import rules as R
from ..operators import semantics as S
from ..operators import statistics as H
from ..operators import tables as T
from ..operators import versions as V
from ..settings import DEFAULT, Settings
from ..sources.readers import SourceTable, limited, load_query, load_table

Payload = dict[str, Any]


def _rows(df: DataFrame, most: int | None = None) -> list[dict]:
    return [r.asDict(recursive=True) for r in (df if most is None else df.limit(most)).collect()]


@dataclass
class Profiler:
    """Runs the engine on tables. ``context`` is the vocabulary, ``as_of`` the day that "future" is judged by, today unless given."""

    spark: SparkSession
    settings: Settings = DEFAULT
    context: S.Context = field(default_factory=S.Context)
    row_limit: int | None = None
    as_of: str = field(default_factory=lambda: date.today().isoformat())

    # --- one table ---

    def profile(self, df: DataFrame, name: str = "table", source: SourceTable | None = None) -> Payload:
        """All sections of a table's profile. Personal data is masked before anything is collected."""
        if df.limit(1).count() == 0:
            raise ValueError(f"{name} has no rows")
        df = df.persist()
        try:
            return self._profile(df, name, source)
        finally:
            df.unpersist()

    def _profile(self, df: DataFrame, name: str, source: SourceTable | None) -> Payload:
        s = self.settings
        columns = S.describe(df, name, self.context)
        by = {c["column"]: c for c in columns}
        texts, numbers, dates = C.text_columns(df), C.numeric_columns(df), C.date_columns(df)
        sensitive = {c["column"] for c in columns if c.get("pattern") not in (None, "CNPJ") or c["role"] == "person name"}
        open_numbers = [c for c in numbers if c not in sensitive and by[c]["n_distinct"] > 1]
        few = [c for c in df.columns if 2 <= by[c]["n_distinct"] <= s.max_levels and c not in sensitive]
        measures = [c for c in open_numbers if by[c]["role"] not in ("identifier",)]
        out: Payload = {"metadata": {"table": name, "n_rows": columns[0]["n_rows"], "n_columns": len(columns)}, "columns": columns}
        if source:
            out["metadata"] |= {"origin": source.origin, "original_rows": source.original_rows, "sample_reason": source.sample_reason, "layout": vars(source.layout)}
            if source.original_rows:
                n = columns[0]["n_rows"]
                out["metadata"]["sampling"] = {"coverage": n / source.original_rows, "rare_event": 3.0 / n}
        visible = [c for c in df.columns if c not in sensitive and by[c]["n_distinct"] <= 100_000]
        out["top_values"] = _rows(C.top_values(df, visible)) if visible else []
        out["numbers"] = _rows(C.numeric_stats(df, open_numbers)) if open_numbers else []
        out["outliers"] = _rows(C.iqr_outliers(df, open_numbers, s)) if open_numbers else []
        out["histograms"] = _rows(C.histogram(df, open_numbers)) if open_numbers else []
        out["dates"] = _rows(C.date_profile(df, dates, self.as_of)) if dates else []
        out["text"] = _rows(C.text_lengths(df, texts)) if texts else []
        out["sentinels"] = _rows(C.sentinels(df, None, s))
        out["damage"] = _rows(Q.column_damage(Q.defects(df, s)))
        out["score"] = _rows(Q.quality_score(df, s))[0]
        out["exposure"] = _rows(Q.personal_exposure(df, [c for c in sensitive if by[c]["role"] == "person name"], s))[0]
        out["kpi_gap"] = _rows(Q.kpi_gap(self.spark, sorted({c["primary"] for c in columns if c["primary"]}), s))
        out["recommendations"] = _rows(Q.recommendations(df, name, s, [c for c in measures if by[c]["primary"] == "money"], self.as_of)) + [{"column": "*", "layer": "Silver", "rows_affected": None, "action": f"{r['action']} ({r['subject']})", "priority": r["priority"]} for r in _rows(Q.table_recommendations(df))]
        out["duplicates"] = _rows(T.duplicate_rows(df))[0]
        out["composite_keys"] = _rows(T.composite_keys(df, [c for c in df.columns if c not in measures]))
        found = _rows(T.functional_dependencies(df, few, s)) if len(few) > 1 else []
        out["dependencies"] = found
        out["hierarchies"] = T.hierarchies([(r["determinant"], r["dependent"], r["kind"]) for r in found])
        out["redundancy"] = _rows(T.near_identical_columns(df, s=s))
        out["correlations"] = _rows(T.correlations(df, open_numbers, s)) if len(open_numbers) > 1 else []
        levels = [c for c in few if c in texts]
        out["associations"] = _rows(T.cramers_v(df, levels).where(F.col("v") >= s.correlation)) if len(levels) > 1 else []
        out["drivers"] = _rows(T.measure_drivers(df, few, measures, s=s)) if few and measures else []
        out["rules"] = (_rows(R.date_order(df, dates, s)) if len(dates) > 1 else []) + _rows(R.domain_rules(df, int(self.as_of[:4]), s))
        out["derivations"] = _rows(R.arithmetic_derivation(df, measures[:10], s)) if len(measures) > 2 else []
        nullable = [c for c in df.columns if 0.1 < by[c]["pct_null"] < 0.95]
        out["conditional_nullity"] = _rows(R.conditional_nullity(df, nullable, levels, s)) if nullable and levels else []
        out["series"] = self._series(df, dates, measures)
        out["insights"] = insights(out)
        return out

    def _series(self, df: DataFrame, dates: list[str], measures: list[str]) -> Payload:
        day = T.reference_date(df, dates) if dates else None
        grain = T.best_grain(df, day) if day and measures else None
        if not grain:
            return {}
        ops = {c: M.aggregate_of(c) for c in measures}
        series = T.time_series(df, day, ops, grain)
        return {"date": day, "grain": grain, "tests": _rows(H.series_tests(series, measures, self.settings))}

    def profile_file(self, path: str, **options: Any) -> Payload:
        t = load_table(self.spark, path, row_limit=self.row_limit, **options)
        return self.profile(t.df, t.name, t)

    def profile_query(self, source: str, sql: str) -> Payload:
        t = limited(load_query(self.spark, source, sql), self.row_limit)
        return self.profile(t.df, t.name, t)

    # --- several tables ---

    def batch(self, paths: list[str]) -> list[Payload]:
        """A summary a file, worst first; a file that fails is noted and the others go on."""
        out = []
        for p in paths:
            try:
                r = self.profile_file(p)
                out.append({"file": p, "table": r["metadata"]["table"], "n_rows": r["metadata"]["n_rows"], "n_columns": r["metadata"]["n_columns"], "score": r["score"]["score"], "grade": r["score"]["grade"], "error": None})
            except Exception as e:  # noqa: BLE001
                out.append({"file": p, "table": None, "n_rows": None, "n_columns": None, "score": None, "grade": None, "error": str(e).splitlines()[0][:300]})
        return sorted(out, key=lambda r: (r["error"] is not None, r["score"] if r["score"] is not None else 0, r["file"]))

    def model(self, tables: dict[str, DataFrame]) -> Payload:
        """Keys, links, roles, grain, coverage, warnings and star queries of two tables or more."""
        if len(tables) < 2:
            raise ValueError("a model needs two tables")
        meaning = {t: S.describe(df, t, self.context) for t, df in tables.items()}
        links = M.fk_discovery(tables).persist()
        joined = {(r["src_table"], r["src_col"]) for r in links.collect()} | {(r["table"], r["column"]) for r in M.pk_candidates(tables).collect()}
        measures = {t: [c["column"] for c in cs if c["logical_type"] in ("integer", "decimal") and c["role"] != "identifier" and (t, c["column"]) not in joined] for t, cs in meaning.items()}
        roles = _rows(M.table_roles(tables, measures, links))
        found = _rows(links.orderBy(F.desc("confidence"), "src_table", "src_col", "dst_table"))
        star = []
        for r in roles:
            if r["role"] == "fact":
                t = r["table"]
                dims = [(x["dst_table"], x["src_col"], x["dst_col"], [c["column"] for c in meaning[x["dst_table"]] if 2 <= c["n_distinct"] <= 100 and c["role"] != "identifier"]) for x in found if x["src_table"] == t]
                date = T.reference_date(tables[t], C.date_columns(tables[t])) if C.date_columns(tables[t]) else None
                star += [{"fact": t, "title": a, "sql": q} for a, q in M.suggested_analyses(t, dims, measures[t], date)]
        dated = {t: df for t, df in tables.items() if C.date_columns(df)}
        keys = {t: sorted({x["src_col"] for x in found if x["src_table"] == t}) for t in tables}
        return {
            "tables": roles, "relationships": found, "keys": _rows(M.pk_candidates(tables)), "measures": measures, "analyses": star,
            "grain": [{"table": t, "columns": cs} | _rows(M.grain_check(tables[t], cs))[0] for t, cs in keys.items() if cs],
            "coverage": _rows(M.temporal_coverage(dated)) if dated else [],
            "warnings": _rows(M.model_warnings(links, M.table_roles(tables, measures, links))),
        }

    def compare(self, a: DataFrame, b: DataFrame) -> Payload:
        common = [c for c in a.columns if c in b.columns]
        numbers = [c for c in common if c in C.numeric_columns(a) and c in C.numeric_columns(b)]
        texts = [c for c in common if c in C.text_columns(a) and c in C.text_columns(b)]
        keys = [r["column"] for r in M.pk_candidates({"a": a.select(*common), "b": b.select(*common)}).groupBy("column").count().where("count = 2").collect()]
        key = next((c for c in common if c in keys), None)
        return {
            "schema": _rows(V.schema_diff(a, b)), "behaviour": _rows(V.column_behaviour(a, b)), "warnings": _rows(V.compare_versions(a, b)),
            "numeric_drift": _rows(V.numeric_drift(a, b, numbers)) if numbers else [], "categorical_drift": _rows(V.categorical_drift(a, b, texts)) if texts else [],
            "key": key, "records": _rows(V.key_reconcile(a, b, key)) if key else [],
        }

    def history(self, extractions: list[tuple[str, DataFrame]], limits: dict[str, float] | None = None) -> Payload:
        scores = {n: _rows(Q.quality_score(df, self.settings))[0]["score"] for n, df in extractions}
        summary = V.history_summary(extractions, scores)
        return {"summary": _rows(summary), "alerts": _rows(V.history_alerts(summary, limits))}

    def contract(self, df: DataFrame, sampled: bool = False) -> V.Contract:
        return V.generate_contract(df, sampled)

    def validate(self, df: DataFrame, contract: V.Contract) -> Payload:
        found = V.validate_contract(df, contract).persist()
        return {"approved": V.approved(found), "violations": _rows(found), "notes": ["the contract comes from a sample: no uniqueness, ranges or domains"] if contract.sampled else []}


def insights(p: Payload) -> list[str]:
    """Up to three sentences on what matters most."""
    out = []
    if worst := max((d for d in p["damage"] if d["damage"] > 0), key=lambda d: d["damage"], default=None):
        out.append(f"{worst['column']} is the most damaged column ({worst['reasons'].replace(',', ', ')}).")
    if p["duplicates"]["n_extra"]:
        out.append(f"{p['duplicates']['n_extra']} rows are copies.")
    if p["exposure"]["level"] in ("high", "medium"):
        out.append(f"Exposure of personal data is {p['exposure']['level']}.")
    if p["correlations"]:
        best = max(p["correlations"], key=lambda r: abs(r["r"]))
        out.append(f"{best['col_a']} and {best['col_b']} move together (r = {best['r']:.2f}).")
    return out[:3]
