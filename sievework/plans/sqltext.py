"""Text functions of the oracles: SQL for DuckDB that computes what functions/text.py does, from the same fixed patterns."""

from __future__ import annotations

from sievework.functions import text as T


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def lead_sql(column: str) -> str:
    """clean_lead as SQL: the same passes of the fixed patterns."""
    out = f"trim({column})"
    for _ in range(3):  # the dealt sentences are clean after three passes
        for pattern in (T.LEAD_RESTATED, T.LEAD_DANGLING, T.AUDIT_RESTATED, T.AUDIT_DANGLING, T.LEAD_PUNCT):
            out = f"regexp_replace({out}, {quoted(pattern)}, '')"
        out = f"trim({out})"
    return f"(SELECT upper(x[1]) || x[2:] FROM (SELECT {out} AS x))"


def clause_sql(concept: str) -> str:
    """The clause of the first principle by priority that column lead names, else the concept's."""
    clause = lambda f: quoted(T.CLAUSES[f][0])
    families, out = dict(T.PRINCIPLES), "CASE "
    for f in T.PRIORITY:
        out += f"WHEN {'true' if T.CLAUSES[f][1] else chr(39) + 'beginner' + chr(39) + ' <> tier'} AND regexp_matches(lead, {quoted(families[f])}) THEN {clause(f)} "
    return out + f"ELSE {clause(concept)} END"


def run_sql(column: str) -> str:
    """Longest run of move tokens: numbers are transparent, other words break it."""
    token = "'^(?:O-O(?:-O)?|[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](?:=[QRBN])?)[+#]?$'"
    return f"""(SELECT coalesce(max(n), 0) FROM (SELECT count(*) FILTER (WHERE mv) AS n FROM (SELECT mv, sum(CASE WHEN mv THEN 0 ELSE 1 END) OVER (ORDER BY i) AS grp FROM
      (SELECT i, regexp_matches(t, {token}) AS mv FROM (SELECT generate_subscripts(w, 1) AS i, regexp_replace(regexp_replace(regexp_replace(regexp_replace(unnest(w), '^[()\\[\\]{{}}"'']+|[()\\[\\]{{}}"'']+$', '', 'g'), '^\\d+\\.+$', ''), '[.,;:!?]+$', ''), '^\\d+\\.+', '') AS t FROM (SELECT string_split_regex({column}, '\\s+') AS w)) WHERE t <> '')) GROUP BY grp))"""
