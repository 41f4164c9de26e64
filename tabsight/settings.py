"""Thresholds of the engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Texts that stand for a missing value, after folding.
TEXT_SENTINELS = (
    "", "-", "--", "---", ".", "..", "...", "?", "??", "???", "n/a", "na", "n.a.", "n/d", "nd", "null", "none", "nil", "nan",
    "#n/d", "#n/a", "#valor!", "#value!", "#ref!", "#nome?", "#name?", "#div/0!",
    "sem informacao", "sem informacoes", "nao informado", "nao informada", "nao consta", "nao se aplica", "nao disponivel",
    "nao identificado", "desconhecido", "desconhecida", "indefinido", "indefinida", "vazio", "branco", "em branco",
    "s/i", "s/d", "s/n", "ignorado",
)
#: Numbers and dates that stand for a missing value.
NUMBER_SENTINELS = (-1.0, -99.0, -999.0, -9999.0, -99999.0, -1.0e9, 9999.0, 99999.0, 999999.0, 9999999.0, 99999999.0, 999999999.0)
DATE_SENTINELS = ("1753-01-01", "1899-12-30", "1900-01-01", "1901-01-01", "1970-01-01", "2099-12-31", "9999-12-31")
#: Shapes of dates written as text.
DATE_SHAPES = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$",
    r"^[0-9]{2}-[0-9]{2}-[0-9]{4}$",
    r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$",
    r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}",
    r"^[0-9]{2}/[0-9]{2}/[0-9]{4}\s+[0-9]{2}:[0-9]{2}",
    r"^[0-9]{2}-[0-9]{2}-[0-9]{4}\s+[0-9]{2}:[0-9]{2}",
    r"^[0-9]{2}/[0-9]{2}/[0-9]{4}\s+[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?\s*(AM|PM|am|pm)?$",
)
DATE_TEXT = "|".join(f"({x})" for x in DATE_SHAPES)
#: Structured identifiers, in the order they are tried.
PATTERNS = {
    "CPF": r"^[0-9]{3}[.\-]?[0-9]{3}[.\-]?[0-9]{3}[.\-]?[0-9]{2}$",
    "CNPJ": r"^[0-9]{2}[.\-]?[0-9]{3}[.\-]?[0-9]{3}[/\-]?[0-9]{4}[.\-]?[0-9]{2}$",
    "CEP": r"^[0-9]{5}[-\s]?[0-9]{3}$",
    "E-mail": r"^[0-9A-Za-z_.+\-]+@[0-9A-Za-z_\-]+(\.[0-9A-Za-z_\-]+)*\.[0-9A-Za-z_\-]{2,}$",
    "Telefone": r"^\(?[0-9]{2}\)?\s?9?[0-9]{4}[\s\-]?[0-9]{4}$",
    "UUID": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
}
#: Marks of text decoded with the wrong encoding.
MOJIBAKE = r"Ã[\x{80}-¿–—‚-…]|Â[\x{A0} -¿]|â€|ï¿½|\x{FFFD}"
#: Damage of each defect to a column, weights of the score, weights of personal data.
DAMAGE = {"mojibake": 0.8, "invalid_document": 0.8, "mixed_types": 0.7, "sentinel": 0.6, "pii_in_text": 0.6, "spelling": 0.5, "date_as_text": 0.4}
COLUMN_SHARE, TABLE_SHARE = 0.85, 0.15
PERSONAL_WEIGHTS = {"CPF": 1.0, "person name": 0.9, "E-mail": 0.8, "Telefone": 0.7, "CEP": 0.5, "UUID": 0.2}
#: What each KPI needs.
KPI_RULES = (
    ("KPI_HR_001", "Effort by department", ("organization", "quantity")),
    ("KPI_HR_002", "Leadership by profile", ("employee profile", "job title")),
    ("KPI_HR_003", "Staff cost over time", ("money", "calendar date")),
    ("KPI_HR_004", "Turnover", ("employee profile", "calendar date")),
    ("KPI_TREIN_001", "Training effectiveness", ("training", "assessment result")),
    ("KPI_GEO_001", "Headcount by place", ("location", "organization")),
)


@dataclass(frozen=True)
class Settings:
    near_key: float = 0.95
    quasi_constant: float = 0.95
    mixed_type: float = 0.05
    structured: float = 0.75
    date_as_text: float = 0.80
    sentinel_share: float = 0.005
    fence: float = 1.5
    robust_skew: float = 1.0
    kernel_rows: int = 5_000
    fd_max_distinct: int = 500
    fd_max_uniqueness: float = 0.98
    alpha: float = 0.05
    correlation: float = 0.7
    strong_correlation: float = 0.9
    correlation_rows: int = 30
    max_levels: int = 50
    partial_redundancy: float = 0.9
    rule_rows: int = 20
    rule_conformity: float = 0.95
    adf_rows: int = 30
    top_values: int = 5
    histogram_bins: int = 18
    kpis: tuple = field(default=KPI_RULES)


DEFAULT = Settings()
