"""Meaning of columns: a role and a domain, from the name, the values and the other columns.

Evidence is a weight from 0 to 1 for a category on one of two axes; weights of one category combine by noisy-or. All of
this works on one record a column, so it is plain Python on the driver; the values' part comes from Spark aggregations.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import jaro_winkler
from ..functions.text import fold
from . import columns as C


class Evidence(NamedTuple):
    category: str
    axis: str  # role or domain
    weight: float
    origin: str


#: Words of names that say a column's role, and those that say its domain.
ROLE_WORDS = {
    "identifier": ("id", "key", "code", "cod", "codigo", "number", "num", "matricula", "uuid", "pk", "fk", "cpf", "cnpj", "hash"),
    "calendar date": ("date", "data", "dt", "day", "dia", "month", "mes", "ts", "timestamp", "time", "admissao", "nascimento"),
    "money": ("price", "preco", "value", "valor", "vl", "cost", "custo", "salary", "salario", "amount", "acctbal", "balance", "revenue", "totalprice", "extendedprice", "retailprice", "tax"),
    "quantity": ("quantity", "qty", "qtd", "quantidade", "count", "total", "size", "n", "availqty", "chars"),
    "percentage": ("pct", "percent", "percentual", "rate", "taxa", "discount", "desconto"),
    "person name": ("nome", "name", "fullname", "employee", "funcionario"),
    "status": ("status", "flag", "situacao", "ativo", "active", "state"),
    "contact": ("email", "mail", "phone", "telefone", "celular", "contato"),
    "free text": ("text", "comment", "obs", "observacao", "description", "descricao", "html", "props"),
}
DOMAIN_WORDS = {
    "location": ("city", "cidade", "uf", "country", "nation", "region", "estado", "regiao", "address", "endereco", "cep"),
    "organization": ("department", "departamento", "dpto", "diretoria", "unit", "setor", "area", "segment", "mktsegment"),
    "employee profile": ("employee", "funcionario", "colaborador", "matricula"),
    "job title": ("cargo", "job", "title", "funcao", "role"),
    "training": ("course", "curso", "treinamento", "training"),
    "assessment result": ("nota", "score", "grade", "avaliacao", "desempenho"),
    "customer": ("customer", "cust", "client", "cliente"),
    "product": ("product", "produto", "part", "item", "brand", "type", "sku"),
    "order": ("order", "pedido", "lineitem", "venda", "sale"),
    "supplier": ("supplier", "supp", "fornecedor"),
    "health": ("patient", "paciente", "diagnosis", "saude"),
    "education": ("student", "aluno", "school", "escola"),
    "web": ("url", "page", "html", "event", "user"),
}
#: Roles that name a column better than its domain does.
STRUCTURAL = ("identifier", "calendar date", "money", "quantity", "percentage", "status", "contact")
#: Values that show a domain: (domain, least share of the values, most different values, values).
GAZETTEERS = (
    ("location", 0.8, 60, ("ac", "al", "am", "ap", "ba", "ce", "df", "es", "go", "ma", "mg", "ms", "mt", "pa", "pb", "pe", "pi", "pr", "rj", "rn", "ro", "rr", "rs", "sc", "se", "sp", "to")),
    ("location", 0.6, 300, ("africa", "america", "asia", "europe", "middle east", "brazil", "brasil", "canada", "china", "france", "germany", "india", "japan", "united states", "united kingdom")),
    ("status", 0.8, 10, ("ativo", "inativo", "active", "inactive", "pending", "open", "closed", "cancelado", "aprovado", "sim", "nao", "yes", "no", "o", "f", "p", "n", "r", "a")),
)
ABBREVIATIONS = {"dt": "date", "vl": "value", "qtd": "quantity", "qty": "quantity", "cd": "code", "nr": "number", "nm": "name", "ds": "description", "tp": "type", "cust": "customer", "supp": "supplier", "acct": "account", "bal": "balance"}


@dataclass(frozen=True)
class Context:
    """The vocabulary of a run; corrections win over everything. Passed on, never global."""

    roles: dict[str, tuple[str, ...]] = field(default_factory=lambda: ROLE_WORDS)
    domains: dict[str, tuple[str, ...]] = field(default_factory=lambda: DOMAIN_WORDS)
    gazetteers: tuple = GAZETTEERS
    corrections: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def from_yaml(*texts: str) -> Context:
        import yaml

        out = Context()
        for t in texts:
            data = yaml.safe_load(t) or {}
            if unknown := set(data) - {"roles", "domains", "gazetteers", "corrections"}:
                raise ValueError(f"unknown section: {sorted(unknown)}")
            more = [(g["domain"], float(g.get("share", 0.8)), int(g.get("most", 100)), tuple(g["values"])) for g in data.get("gazetteers", [])]
            out = Context({**out.roles, **{k: tuple(v) for k, v in data.get("roles", {}).items()}}, {**out.domains, **{k: tuple(v) for k, v in data.get("domains", {}).items()}}, (*out.gazetteers, *more), {**out.corrections, **data.get("corrections", {})})
        return out


def tokens(name: str) -> list[str]:
    """Lower-case words of a name: at separators, changes of case, and between letters and digits."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]


def expansions(token: str, known: set[str]) -> list[tuple[str, float]]:
    """Words that a token may stand for: itself, a known abbreviation, or words it runs through in order."""
    if token in known:
        return [(token, 1.0)]
    if token in ABBREVIATIONS:
        return [(ABBREVIATIONS[token], 0.95)]
    out = []
    if len(token) >= 3:
        for w in known:
            if w[0] == token[0] and len(token) < len(w) <= 4 * len(token):
                letters = iter(w)
                if all(x in letters for x in token):
                    out.append((w, 0.35 + 0.35 * len(token) / len(w)))
    return sorted(out, key=lambda x: (-x[1], x[0]))[:3]


def name_evidence(name: str, context: Context) -> list[Evidence]:
    parts = [t for t in tokens(name) if not t.isdigit()]
    out = []
    for axis, words in (("role", context.roles), ("domain", context.domains)):
        known = {w for ws in words.values() for w in ws}
        owners: dict[str, list[str]] = defaultdict(list)
        for category, ws in words.items():
            for w in ws:
                owners[w].append(category)
        for i, token in enumerate(parts):
            decay = max(0.5, 1 - 0.03 * i)
            border = 0.9 if i in (0, len(parts) - 1) else 0.7
            for w, sure in expansions(token, known):
                for category in owners.get(w, ()):
                    out.append(Evidence(category, axis, 0.85 * sure * decay * border, f"name:{w}"))
            for w in known:  # like words
                if len(w) > 3 and token != w and token[0] == w[0] and (j := jaro_winkler(token, w)) >= 0.93:
                    out += [Evidence(c, axis, 0.8 * j * decay * 0.7, f"like:{w}") for c in owners[w]]
    return out


def value_evidence(record: dict) -> list[Evidence]:
    """From a column's facts: kind of pattern, type, share of different values, lengths, gazetteer hits."""
    out = []
    pattern = {"CPF": "identifier", "CNPJ": "identifier", "UUID": "identifier", "E-mail": "contact", "Telefone": "contact"}.get(record.get("pattern"))
    if pattern:
        out.append(Evidence(pattern, "role", 0.98, "pattern"))
    if record.get("pattern") == "CEP":
        out.append(Evidence("location", "domain", 0.98, "pattern"))
    if record["logical_type"] == "boolean":
        out.append(Evidence("status", "role", 0.7, "boolean"))
    if record["logical_type"] in ("date", "text date"):
        out.append(Evidence("calendar date", "role", 0.9, "type"))
    if record["logical_type"] == "integer" and record["uniqueness"] >= 0.999:
        out.append(Evidence("identifier", "role", 0.6, "unique"))
    if record["logical_type"] == "decimal" and record.get("decimals") == 2 and (record.get("min") or 0) >= 0:
        out.append(Evidence("money", "role", 0.45, "two decimals"))
    if record["logical_type"] == "text":
        if (record.get("mean_len") or 0) >= 60 and record["uniqueness"] >= 0.5:
            out.append(Evidence("free text", "role", 0.55, "long"))
        if record.get("fixed") and record["uniqueness"] >= 0.95 and (record.get("mean_len") or 0) > 4:
            out.append(Evidence("identifier", "role", 0.5, "fixed length"))
    return out + [Evidence(d, "role" if d in ROLE_WORDS else "domain", 0.9 * share, "values") for d, share in record.get("gazetteer", ())]


def combine(evidence: list[Evidence]) -> dict[str, list[tuple[str, float]]]:
    """{axis: [(category, confidence)]} by noisy-or of the best evidence of each origin, best first."""
    best: dict[tuple[str, str, str], float] = {}
    for e in evidence:
        k = (e.axis, e.category, e.origin)
        best[k] = max(best.get(k, 0.0), e.weight)
    left: dict[tuple[str, str], float] = {}
    for (axis, category, _), w in best.items():
        left[axis, category] = left.get((axis, category), 1.0) * (1 - w)
    out: dict[str, list[tuple[str, float]]] = {"role": [], "domain": []}
    for (axis, category), p in left.items():
        out[axis].append((category, 1 - p))
    return {a: sorted(v, key=lambda x: (-x[1], x[0])) for a, v in out.items()}


def conclusive(ranked: list[tuple[str, float]], margin: float = 0.15) -> bool:
    return bool(ranked) and (len(ranked) == 1 or ranked[0][1] - ranked[1][1] >= margin)


def conclude(name: str, evidence: list[Evidence], record: dict, context: Context) -> dict:
    ranked = combine(evidence)
    role, role_score = ranked["role"][0] if ranked["role"] else (None, 0.0)
    domain, domain_score = ranked["domain"][0] if ranked["domain"] else (None, 0.0)
    if domain_score < 0.5:
        domain, domain_score = None, 0.0
    if role == "person name" and domain not in (None, "employee profile", "health", "education", "customer"):
        role = "label"  # the name of a thing
    if role == "free text" and 2 <= record["n_distinct"] <= 100 and record["uniqueness"] < 0.5:
        role = "category"
    primary = role if role in STRUCTURAL or not domain else domain
    if name in context.corrections:
        primary, role_score = context.corrections[name], 1.0
    return {"role": role, "domain": domain, "score": max(role_score, domain_score), "primary": primary, "conclusive": conclusive(ranked["role"]) or conclusive(ranked["domain"])}


def describe(df: DataFrame, table: str, context: Context | None = None) -> list[dict]:
    """A record a column with its facts and its meaning; inconclusive columns get a second look with the table's subject."""
    context = context or Context()
    records = {r["column"]: r.asDict() for r in C.column_profile(df, table).collect()}
    texts, numbers = C.text_columns(df), C.numeric_columns(df)
    for kind, rows in (("pattern", C.structured_pattern(df, texts).collect() if texts else []),):
        for r in rows:
            records[r["column"]][kind] = r["kind"]
    for r in C.text_lengths(df, texts).collect() if texts else []:
        records[r["column"]] |= {"mean_len": r["mean_len"], "fixed": r["fixed"]}
    for r in C.numeric_stats(df, numbers).select("column", "min").collect() if numbers else []:
        records[r["column"]]["min"] = r["min"]
    for r in C.fixed_decimals(df, numbers).collect() if numbers else []:
        records[r["column"]]["decimals"] = r["decimals"]
    few = [c for c in texts if 1 < records[c]["n_distinct"] <= 300]
    if few:
        values = C.value_counts(df, few).select("column", fold(F.col("value")).alias("v")).distinct()
        for domain, share, most, listed in context.gazetteers:
            by = values.groupBy("column").agg(F.count("*").alias("n"), F.count_if(F.col("v").isin(*listed)).alias("k")).where((F.col("n") <= most) & (F.col("k") >= share * F.col("n"))).collect()
            for r in by:
                records[r["column"]].setdefault("gazetteer", []).append((domain, r["k"] / r["n"]))
    evidence = {c: name_evidence(c, context) + value_evidence(r) for c, r in records.items()}
    first = {c: conclude(c, evidence[c], r, context) for c, r in records.items()}
    sure: dict[str, int] = defaultdict(int)
    for m in first.values():
        if m["domain"] and m["score"] >= 0.7:
            sure[m["domain"]] += 1
    for c, m in first.items():
        if not m["conclusive"] and sure:
            subject, n = max(sure.items(), key=lambda x: (x[1], x[0]))
            evidence[c].append(Evidence(subject, "domain", 0.4 * n / len(first), "table"))
            first[c] = conclude(c, evidence[c], records[c], context)
    return [records[c] | first[c] for c in df.columns]


def semantic_roles(df: DataFrame, table: str, context: Context | None = None) -> DataFrame:
    """(table, column, role, domain, primary, score)."""
    rows = [(table, r["column"], r["role"], r["domain"], r["primary"], float(round(r["score"], 4))) for r in describe(df, table, context)]
    return df.sparkSession.createDataFrame(rows, "table string, column string, role string, domain string, primary string, score double")


def corrections_template(df: DataFrame, table: str) -> str:
    """YAML in which a reader fills in the meaning of uncertain columns."""
    import yaml

    return yaml.safe_dump({"corrections": {r["column"]: r["primary"] or "" for r in describe(df, table) if not r["conclusive"]}}, sort_keys=False)


