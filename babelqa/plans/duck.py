"""SQL-text builders for the DuckDB oracle, mirroring the Column functions.

Only the oracle uses these: they spell the same rule in DuckDB's dialect (e.g. Python
``strip`` as ``trim`` with an explicit character set), so a result can be checked by a
second engine.
"""

from __future__ import annotations

from .. import constants as K


def ws_literal() -> str:
    return "(" + " || ".join(f"chr({ord(c)})" for c in K.PY_WHITESPACE) + ")"


def py_strip(x: str) -> str:
    return f"trim({x}, {ws_literal()})"


def is_blank(x: str) -> str:
    return f"({py_strip(x)} = '')"


def with_fallback(x: str) -> str:
    return f"(CASE WHEN {is_blank(x)} THEN '{K.FALLBACK_ANSWER}' ELSE {x} END)"


def strip_thinking(x: str, q: str | None = None) -> str:
    t = py_strip(f"regexp_replace({x}, '(?s)<think>.*?</think>', '', 'g')")
    if q is None:
        return t
    return f"(CASE WHEN {q} IS NULL OR {q} = '' THEN {t} ELSE replace({t}, {q}, '') END)"


def strip_echo(x: str, q: str) -> str:
    return py_strip(f"(CASE WHEN {q} IS NULL OR {q} = '' THEN {x} ELSE replace({x}, {q}, '') END)")


def exact_match(p: str, r: str) -> str:
    return f"CAST(lower({py_strip(p)}) = lower({py_strip(r)}) AS INTEGER)"


def lenient_lang(s: str) -> str:
    return f"coalesce(CASE WHEN strpos({s}, '_') > 0 THEN substr({s}, 1, strpos({s}, '_') - 1) ELSE {s} END, '')"


def lenient_country(s: str) -> str:
    return f"coalesce(CASE WHEN strpos({s}, '_') > 0 THEN substr({s}, strpos({s}, '_') + 1) ELSE '' END, '')"


def lang_of(s: str) -> str:
    return (f"(CASE WHEN {s} IS NULL OR {s} = '' THEN 'unknown' "
            f"WHEN strpos({s}, '_') > 0 THEN substr({s}, 1, strpos({s}, '_') - 1) ELSE {s} END)")


def sq(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def regex(p: str) -> str:
    return sq(p)


def md5_key(*parts: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(parts) + "))"


def permuted(src: str) -> str:
    """SELECT of (id, y) from ``src`` (id, x, n, k): where the keyed permutation takes x."""
    hashed = lambda j, v: f"CAST('0x' || substr(md5(concat_ws('|', k, {j}, {v})), 1, 8) AS BIGINT)"
    return f"""WITH RECURSIVE walk AS (
  SELECT id, 0 AS step, CAST(x AS BIGINT) AS x, n, k, greatest(CAST(ceil(sqrt(CAST(n AS DOUBLE))) AS BIGINT), 1) AS a FROM {src}
  UNION ALL SELECT id, step + 1, r3 * a + l3, n, k, a FROM (
    SELECT *, greatest(CAST(ceil(n / a) AS BIGINT), 1) AS b, x % a AS l0, x // a AS r0, (l0 + {hashed(0, 'r0')}) % a AS l1,
      (r0 + {hashed(1, 'l1')}) % b AS r1, (l1 + {hashed(2, 'r1')}) % a AS l2, (r1 + {hashed(3, 'l2')}) % b AS r2,
      (l2 + {hashed(4, 'r2')}) % a AS l3, (r2 + {hashed(5, 'l3')}) % b AS r3
    FROM walk WHERE step = 0 OR x >= n) t)
SELECT id, x AS y FROM walk WHERE step > 0 AND x < n"""


def subword_merges(src: str, n: int) -> list:
    """CTEs ``m0`` to ``m<n-1>`` (pair, n): the merges of ``src`` (w, cnt), one by one."""
    out = [("w0", f"SELECT w, CAST(cnt AS BIGINT) AS cnt FROM {src}")]
    for k in range(n):
        out.append((f"m{k}", f"""SELECT pair, CAST(sum(cnt) AS BIGINT) AS n FROM (SELECT cnt, unnest(list_transform(range(1, length(w)),
  lambda i: substr(w, i, 2))) AS pair FROM w{k}) t GROUP BY pair HAVING sum(cnt) >= 2
  ORDER BY n DESC, greatest(substr(pair, 1, 1), substr(pair, 2, 1)), pair LIMIT 1"""))
        out.append((f"w{k + 1}", f"SELECT replace(w, (SELECT pair FROM m{k}), chr({0xF0000 + k})) AS w, cnt FROM w{k}"))
    return out
