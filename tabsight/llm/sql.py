"""The operators' queries as SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from . import quality
from .mixing import ORACLE as MIXING
from .sharding import ORACLE as SHARDING

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_CELLS = {
    "symbols": "(n_symbols + 1)::DOUBLE / (word_chars + 1)::DOUBLE",
    "repeated_lines": "(n_dup_lines + 1)::DOUBLE / (n_lines - n_dup_lines + 1)::DOUBLE",
    "word_length": "greatest(word_chars, 1)::DOUBLE / greatest(n_words, 1)::DOUBLE",
}


def _cell(name: str) -> str:
    return f"floor(ln({_CELLS[name]}) * {quality.STEPS[name]})::BIGINT"


def _beyond(i: int, r: quality.Rule) -> str:
    return f"coalesce({_cell(r.measure)} {'>' if r.upper else '<'} fence{i}, false)"


def _fence(i: int, r: quality.Rule) -> str:
    return f"max(CASE WHEN m = '{r.measure}' THEN {f'q2 + {r.spread} * down' if r.upper else f'q2 - {r.spread} * up'} END) AS fence{i}"


def _quartiles(name: str, rows: str, by: str) -> str:
    least = ", ".join(f"min(CASE WHEN 4 * upto >= {k} * total THEN cell END) AS q{k}" for k in (1, 2, 3))
    return f"{name} AS (SELECT {by}, {least} FROM (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY {by}) AS total FROM {rows}) GROUP BY {by})"


QUALITY = rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
five AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM w, unnest(generate_series(1, len(w) - 4)) t(i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM five) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM twice, unnest(generate_series(i, i + 4)) t(p) GROUP BY 1),
m AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
cells AS ({' UNION ALL '.join(f"SELECT coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source, '{k}' AS m, {_cell(k)} AS cell FROM b WHERE NOT base_failed" for k in quality.STEPS)}),
g AS (SELECT lang, source, m, cell, count(*)::BIGINT AS n FROM cells GROUP BY ALL),
l AS (SELECT lang, m, cell, sum(n)::BIGINT AS n FROM g GROUP BY ALL),
a AS (SELECT m, cell, sum(n)::BIGINT AS n FROM g GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source, m FROM g),
lent AS (SELECT lang, m, cell, (n * {quality.UNIT} * least({quality.BORROWED}, size)) // size AS n FROM l JOIN (SELECT lang, m, sum(n)::BIGINT AS size FROM l GROUP BY ALL) USING (lang, m)),
given AS (SELECT m, cell, (n * {quality.UNIT} * least({quality.BORROWED}, size)) // size AS n FROM a JOIN (SELECT m, sum(n)::BIGINT AS size FROM a GROUP BY ALL) USING (m)),
mixed AS (SELECT lang, source, m, cell, sum(n)::BIGINT AS n FROM (SELECT lang, source, m, cell, n * {quality.UNIT} AS n FROM g
          UNION ALL SELECT lang, source, m, cell, n FROM groups JOIN lent USING (lang, m) UNION ALL SELECT lang, source, m, cell, n FROM groups JOIN given USING (m)) GROUP BY ALL),
{_quartiles("ql", "l", "lang, m")},
{_quartiles("qa", "a", "m")},
{_quartiles("qg", "mixed", "lang, source, m")},
q AS (SELECT qg.*, coalesce(nullif(greatest(qg.q2 - qg.q1, ql.q2 - ql.q1), 0), nullif(qa.q2 - qa.q1, 0), 1) AS down,
             coalesce(nullif(greatest(qg.q3 - qg.q2, ql.q3 - ql.q2), 0), nullif(qa.q3 - qa.q2, 0), 1) AS up FROM qg JOIN ql USING (lang, m) JOIN qa USING (m)),
f AS (SELECT lang, source, {', '.join(_fence(i, r) for i, r in enumerate(quality.RULES))} FROM q GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({' OR '.join(_beyond(i, r) for i, r in enumerate(quality.RULES))}) AS kept
FROM b LEFT JOIN f ON coalesce('=' || b.lang, '') = f.lang AND coalesce('=' || b.source, '') = f.source
"""

_TOKENS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = f"""
WITH b AS (SELECT item_id, {_TOKENS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS s, least(len(w), 13) AS n FROM b, unnest(generate_series(1, greatest(1, len(w) - 12))) t(i) WHERE len(w) > 0),
d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM win), unnest(generate_series(1, len(w) - n + 1)) t(i)),
hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN win USING (s, n)),
cov AS (SELECT doc_id, count(DISTINCT p) AS h FROM hit, unnest(generate_series(i, i + n - 1)) t(p) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS k, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS l FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h, 0)::BIGINT AS n_hit, coalesce(k, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(h, 0) > 0 AND 20 * coalesce(h, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""

ORACLES = {"op3_quality_rules": QUALITY, "op7_mixing": MIXING, "op8_sharding": SHARDING, "op9_decontamination": CONTAMINATION}
