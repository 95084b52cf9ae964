"""The ROUGE oracle in DuckDB SQL: Porter's steps over the distinct vocabulary, clipped
overlap by counting, the longest common subsequence as a longest increasing subsequence.

It shares the fixed suffix tables with the library, and none of its logic: the stemmer works
on a consonant/vowel string made with regular expressions, the subsequence on match positions.
"""

from __future__ import annotations

from ..functions.porter import IRREGULAR, STEP2, STEP3, STEP4


def _shape(w: str) -> str:
    """C and V for each letter; a y is a vowel after a consonant only."""
    x = f"regexp_replace(regexp_replace({w}, '[aeiou]', 'V', 'g'), '[^Vy]', 'C', 'g')"
    x = f"regexp_replace({x}, '^y', 'C')"
    for _ in range(4):
        x = f"replace(replace({x}, 'Cy', 'CV'), 'Vy', 'VC')"
    return x


def _measure(shape: str) -> str:
    return f"((length({shape}) - length(replace({shape}, 'VC', ''))) // 2)"


def _cut(n: int, col: str = "w") -> str:
    return f"left({col}, length({col}) - {n})"


def _m(n: int) -> str:
    return _measure(f"left(c, length(c) - {n})")


def _cvc(w: str, c: str) -> str:
    return (f"(CASE WHEN length({w}) >= 3 THEN right({c}, 3) = 'CVC' AND right({w}, 1) NOT IN ('w', 'x', 'y') "
            f"ELSE {c} = 'VC' END)")


def _ends(suffix: str, col: str = "w") -> str:
    return f"ends_with({col}, '{suffix}')"


def _rules(table, least: str) -> str:
    arms = []
    for suffix, new in table:
        n = len(suffix)
        m = _m(3) if suffix == "logi" else _m(n)
        arms.append(f"WHEN {_ends(suffix)} THEN CASE WHEN {m} {least} THEN {_cut(n)} || '{new}' ELSE w END")
    return "CASE " + " ".join(arms) + " ELSE w END"


def stem_ctes(words: str) -> list[tuple[str, str]]:
    """CTEs ending in ``stems`` (word, stem) for the distinct ``word`` of the table ``words``."""
    steps: list[str] = []
    steps.append("CASE WHEN ends_with(w, 'ies') AND length(w) = 4 THEN " + _cut(1) + " WHEN " + _ends("sses") + " THEN "
                 + _cut(2) + " WHEN " + _ends("ies") + " THEN " + _cut(2) + " WHEN " + _ends("ss") + " THEN w WHEN "
                 + _ends("s") + " THEN " + _cut(1) + " ELSE w END")
    # 1b in two parts: cut ed / ing (kept in s), then tidy what is left
    cut_b = ("CASE WHEN " + _ends("ied") + " OR " + _ends("eed") + " THEN NULL WHEN " + _ends("ed") + " AND contains(left(c, length(c) - 2), 'V') THEN "
             + _cut(2) + " WHEN " + _ends("ing") + " AND contains(left(c, length(c) - 3), 'V') THEN " + _cut(3) + " END")
    tidy_b = ("CASE WHEN s IS NULL THEN CASE WHEN " + _ends("ied") + " THEN CASE WHEN length(w) = 4 THEN " + _cut(1) + " ELSE "
              + _cut(2) + " END WHEN " + _ends("eed") + " THEN CASE WHEN " + _m(3) + " > 0 THEN " + _cut(1) + " ELSE w END ELSE w END "
              "WHEN ends_with(s, 'at') OR ends_with(s, 'bl') OR ends_with(s, 'iz') THEN s || 'e' "
              "WHEN length(s) >= 2 AND right(s, 1) = left(right(s, 2), 1) AND right(t, 1) = 'C' THEN "
              "CASE WHEN right(s, 1) IN ('l', 's', 'z') THEN s ELSE left(s, length(s) - 1) END "
              "WHEN " + _measure("t") + " = 1 AND " + _cvc("s", "t") + " THEN s || 'e' ELSE s END")
    step_c = "CASE WHEN ends_with(w, 'y') AND length(w) > 2 AND left(right(c, 2), 1) = 'C' THEN " + _cut(1) + " || 'i' ELSE w END"
    pre_2 = "CASE WHEN ends_with(w, 'alli') AND " + _m(4) + " > 0 THEN " + _cut(2) + " ELSE w END"
    arms = []
    for suffix in STEP4:
        n = len(suffix)
        extra = f" AND right({_cut(n)}, 1) IN ('s', 't')" if suffix == "ion" else ""
        arms.append(f"WHEN {_ends(suffix)} THEN CASE WHEN {_m(n)} > 1{extra} THEN {_cut(n)} ELSE w END")
    step_4 = "CASE " + " ".join(arms) + " ELSE w END"
    step_5e = ("CASE WHEN ends_with(w, 'e') AND (" + _m(1) + " > 1 OR (" + _m(1) + " = 1 AND NOT "
               + _cvc(_cut(1), "left(c, length(c) - 1)") + ")) THEN " + _cut(1) + " ELSE w END")
    step_5l = "CASE WHEN ends_with(w, 'll') AND " + _m(1) + " > 1 THEN " + _cut(1) + " ELSE w END"

    odd = ", ".join(f"('{k}', '{v}')" for k, v in IRREGULAR.items())
    ctes = [("odd", f"SELECT * FROM (VALUES {odd}) t(word, stem)"),
            ("p0", f"SELECT DISTINCT word, word AS w FROM {words} WHERE length(word) > 3 AND word NOT IN (SELECT word FROM odd)")]

    def step(name: str, before: str, expr: str) -> None:
        ctes.append((name, f"SELECT word, {expr} AS w FROM (SELECT word, w, {_shape('w')} AS c FROM {before}) x"))

    step("p1a", "p0", steps[0])
    ctes.append(("p1s", f"SELECT word, w, c, {cut_b} AS s FROM (SELECT word, w, {_shape('w')} AS c FROM p1a) x"))
    ctes.append(("p1b", f"SELECT word, {tidy_b} AS w FROM (SELECT *, {_shape('s')} AS t FROM p1s) x"))
    step("p1c", "p1b", step_c)
    step("p2a", "p1c", pre_2)
    step("p2", "p2a", _rules(STEP2, "> 0"))
    step("p3", "p2", _rules(STEP3, "> 0"))
    step("p4", "p3", step_4)
    step("p5", "p4", step_5e)
    step("p6", "p5", step_5l)
    ctes.append(("stems", f"""SELECT word, w AS stem FROM p6
  UNION ALL SELECT DISTINCT x.word, odd.stem FROM {words} x JOIN odd USING (word)
  UNION ALL SELECT DISTINCT word, word FROM {words} WHERE length(word) <= 3 AND word NOT IN (SELECT word FROM odd WHERE length(word) > 3)"""))
    return ctes


def rouge_ctes(source: str, key: str, gen: str, gold: str) -> list[tuple[str, str]]:
    """CTEs ending in ``rouge`` (key, n_gen, n_gold, overlap, lcs, f1, fl, rouge1_f1, rougeL_f1,
    score) for the texts ``gen`` and ``gold`` of ``source``, tokens stemmed."""
    tok = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
    ctes = [("rt", f"SELECT {key}, {tok.format(gen)} AS g, {tok.format(gold)} AS r FROM {source}"),
            ("rw", "SELECT unnest(g) AS word FROM rt UNION SELECT unnest(r) AS word FROM rt")]
    ctes += stem_ctes("rw")
    for side, name in (("g", "sg"), ("r", "sr")):
        ctes.append((f"{name}t", f"""SELECT x.{key}, x.pos, s.stem FROM
      (SELECT {key}, unnest(generate_series(1, len({side}))) AS pos, unnest({side}) AS word FROM rt) x JOIN stems s USING (word)"""))
    ctes += [
        ("ov", f"""SELECT {key}, sum(least(a.n, b.n)) AS overlap FROM
      (SELECT {key}, stem, count(*) AS n FROM sgt GROUP BY ALL) a JOIN (SELECT {key}, stem, count(*) AS n FROM srt GROUP BY ALL) b
      USING ({key}, stem) GROUP BY {key}"""),
        # matches in order of the generated text, descending in the reference: an increasing
        # run of reference positions is a common subsequence
        ("mp", f"SELECT a.{key}, list([b.pos] ORDER BY a.pos, b.pos DESC) AS p FROM sgt a JOIN srt b USING ({key}, stem) GROUP BY a.{key}"),
        ("lc", f"""SELECT {key}, len(list_reduce(p, lambda t, q: list_concat(list_filter(t, lambda x: x < q[1]), q,
        list_slice(t, len(list_filter(t, lambda x: x < q[1])) + 2, len(t))))) AS lcs FROM mp"""),
        ("rn", f"""SELECT rt.{key}, len(g) AS n_gen, len(r) AS n_gold, CAST(coalesce(overlap, 0) AS INTEGER) AS overlap,
        CAST(coalesce(lcs, 0) AS INTEGER) AS lcs FROM rt LEFT JOIN ov ON ov.{key} = rt.{key} LEFT JOIN lc ON lc.{key} = rt.{key}"""),
        ("rf", f"""SELECT *, {_f1('overlap')} AS f1, {_f1('lcs')} AS fl FROM rn"""),
        ("rouge", f"""SELECT *, {round4('f1')} AS rouge1_f1, {round4('fl')} AS rougeL_f1, {round4('f1 * 0.5 + fl * 0.5')} AS score FROM rf"""),
    ]
    return ctes


def _f1(n: str) -> str:
    p = f"(CAST({n} AS DOUBLE) / CAST(greatest(n_gen, 1) AS DOUBLE))"
    r = f"(CAST({n} AS DOUBLE) / CAST(greatest(n_gold, 1) AS DOUBLE))"
    return f"(CASE WHEN {n} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(2 AS DOUBLE) * {p} * {r} / ({p} + {r}) END)"


def round4(x: str) -> str:
    """Four places, correctly rounded from the binary value (as C's printf does)."""
    return f"CAST(printf('%.4f', {x}) AS DOUBLE)"


def exact_sum(x: str) -> str:
    """Sum of four-place values that does not depend on the order."""
    return f"CAST(sum(CAST({x} AS DECIMAL(20, 4))) AS DOUBLE)"
