"""Registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read_table


def public_tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=2).drop("t")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup_digest
    return dedup_digest(read_table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("t")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predict_documents
    return predict_documents(read_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from .packing import pack_documents
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer or public_tokenizer("word_bpe_49k.json"))


def pack_conversations(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """The packing of operator 2 for instruction data, where all three limits bind."""
    from .chat_packing import pack_chats
    return pack_chats(read_table(spark, sf_dir, "conversations"), tokenizer or public_tokenizer("word_bpe_49k.json"))


def op6_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from .token_files import round_trip
    return round_trip(read_table(spark, sf_dir, "documents"), tokenizer or public_tokenizer("byte_bpe_50k.json"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edited_fingerprints
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))


# Conversation -7: both turns hold the template's own marks.
PROBE = r"""
SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, r'\### Assistant: </turn> ok' AS text
FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)
"""


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import round_trip
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return round_trip(rows.unionByName(spark.sql(PROBE)))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text
    return extract_text(read_table(spark, sf_dir, "pages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import score_documents
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import run_digest
    return run_digest(read_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import digest
    return digest(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op4_license_scan": op4_license_scan,
    "op8_chat_formatting": op8_chat_formatting,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_token_files": op6_token_files,
    "op2_packing": op2_packing,
    "op7_language_id": op7_language_id,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_fill_in_middle": op13_fill_in_middle,
    "pack_conversations": pack_conversations,
}

ORACLE: dict[str, str] = {}

ORACLE["op9_minhash_near_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) = 1 THEN w
         ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
classes AS (
  SELECT min(doc_id) AS c, list_sort(s) AS s, list(doc_id) AS ids FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
flat AS (SELECT c, unnest(s) AS g FROM classes),
common AS (
  SELECT x.c AS a, y.c AS b, count(*) AS n FROM flat x JOIN flat y ON x.g = y.g AND x.c < y.c GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN classes p ON p.c = a JOIN classes q ON q.c = b
  WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT c AS node, c AS top FROM classes
  UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.top),
comp AS (SELECT node, min(top) AS top FROM reach GROUP BY node),
member AS (SELECT unnest(ids) AS doc_id, c FROM classes)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(comp.top, s.doc_id) AS component_id,
       coalesce(comp.top, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN member m ON m.doc_id = s.doc_id LEFT JOIN comp ON comp.node = m.c
"""

# Every mask ignores two of the four classes of places modulo 4; short items are searched whole, by
# masks that skip one place. A hit counts if its surroundings (6 words a side) agree in 80 percent,
# all of a short item; where an item has no such hit, if some range that holds the span does.
ORACLE["op10_benchmark_decontamination"] = r"""
WITH masks AS (
  SELECT 12 AS span, 4 * a + b AS id, list_filter(range(12), lambda k: k % 4 <> a AND k % 4 <> b) AS o
  FROM range(4) x(a), range(4) y(b) WHERE a < b
  UNION ALL SELECT n, skip, list_filter(range(n), lambda k: k <> skip) FROM range(5, 12) z(n), range(11) v(skip) WHERE skip < n),
texts AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS h FROM documents),
items AS (SELECT DISTINCT item_id, g FROM (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS g FROM benchmark) t WHERE len(g) >= 5),
item_seeds AS (
  SELECT item_id, g, q, span, id, list_transform(o, lambda k: g[q + k + 1]) AS key FROM (
    SELECT *, unnest(range(0, len(g) - span + 1)) AS q FROM items JOIN masks ON span = least(len(g), 12)) t),
used AS (SELECT * FROM masks WHERE span IN (SELECT span FROM item_seeds)),
doc_seeds AS (
  SELECT doc_id, h, p, span, id, list_transform(o, lambda k: h[p + k + 1]) AS key FROM (
    SELECT *, unnest(range(0, len(h) - span + 1)) AS p FROM texts JOIN used ON len(h) >= span) t),
hits AS (SELECT DISTINCT doc_id, h, item_id, g, p, q, span FROM doc_seeds JOIN item_seeds USING (span, id, key)),
sized AS (SELECT *, least(6, p, q) AS a, least(6, len(h) - p - span, len(g) - q - span) AS b FROM hits),
same AS (
  SELECT *, a + span + b AS n, list_transform(range(0, a + span + b), lambda k: CAST(h[p - a + k + 1] = g[q - a + k + 1] AS INT)) AS s FROM sized),
scored AS (SELECT *, list_sum(s) AS m, list_transform(s, lambda x: 100 * x - 80) AS c FROM same),
ranged AS (
  SELECT *, 100 * m >= CASE WHEN span < 12 THEN 100 ELSE 80 END * n AS whole,
         list_sum(c[a + 1:a + span])
         + list_max(list_prepend(0, list_transform(range(0, a), lambda k: CAST(list_sum(c[k + 1:a]) AS BIGINT))))
         + list_max(list_prepend(0, list_transform(range(0, b), lambda k: CAST(list_sum(c[a + span + 1:a + span + k + 1]) AS BIGINT)))) AS best FROM scored),
kept AS (SELECT *, bool_or(whole) OVER (PARTITION BY doc_id, item_id) AS any_whole FROM ranged WHERE whole OR best >= 0)
SELECT doc_id, item_id, count(*) AS n_hits, CAST(max(m) AS BIGINT) AS matched, CAST(min(p) AS BIGINT) AS first_word
FROM kept WHERE whole OR NOT any_whole GROUP BY doc_id, item_id
"""

# A turn that holds a mark is flagged and escaped: backslash, "<" and "#" take one more place.
ORACLE["op8_chat_formatting"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
sized AS (
  SELECT *, CASE WHEN contains(text, '### ') OR contains(text, '</turn>')
            THEN 1 + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) ELSE length(text) END AS body,
         length(role) + length(regexp_replace(role, '[^\\<#:!\n]', '', 'g')) AS head FROM rows),
joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         CAST(sum(body + head + 14) AS BIGINT) AS formatted_chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM joined
"""

# Every 200-byte window by its 128-bit hash; runs of repeated windows; what lies between them.
ORACLE["op3_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
hashed AS (
  SELECT doc_id, list_transform(range(0, greatest(length(h) // 2 - 199, 0)), lambda p: md5_number(substr(h, 2 * p + 1, 400))) AS m FROM d),
windows AS (SELECT doc_id, unnest(range(0, len(m))) AS p, unnest(m) AS m FROM hashed),
met AS (SELECT m FROM windows GROUP BY m HAVING count(*) > 1),
repeated AS (SELECT doc_id, p FROM windows WHERE m IN (SELECT m FROM met)),
cut AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS first FROM repeated),
runs AS (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM cut),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 200 AS b FROM runs GROUP BY doc_id, run),
edges AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start, a AS stop FROM spans
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(length(h)) // 2 FROM d LEFT JOIN spans ON spans.doc_id = d.doc_id GROUP BY d.doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * start + 1, 2 * (stop - start)), '' ORDER BY start, stop) AS k FROM edges JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sums ON sums.doc_id = d.doc_id
"""

# The checksum bit by bit; equal words one period apart; their islands; the smallest periods.
ORACLE["op12_periodic_runs"] = r"""
WITH bytes AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM range(256) r(i)),
poly AS (SELECT list(v ORDER BY i) AS v FROM bytes),
texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
             lambda c, b: xor(c // 256, v[xor(c % 256, b) + 1])), 4294967295) AS h FROM documents, poly),
placed AS (SELECT doc_id, w, len(w) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS planted, (h // 10) % len(w) AS a FROM texts),
formed AS (
  SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(0, n), lambda i:
         w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE w END AS w FROM placed),
flat AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(w) AS word FROM formed),
pairs AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM flat x JOIN flat y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i
  WHERE 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS length FROM islands GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (
  SELECT * FROM stretches r WHERE NOT EXISTS (
    SELECT 1 FROM stretches o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.s <= r.s AND o.s + o.length >= r.s + r.length)),
summed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
         list(struct_pack(start := s, length := length, period := q) ORDER BY s, q) AS l FROM runs GROUP BY doc_id),
best AS (
  SELECT doc_id, n_runs, lines, list_reduce(l, lambda t, r: CASE WHEN r.length * t.period > t.length * r.period THEN r ELSE t END) AS b FROM summed),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + length)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM flat ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT f.doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period,
       1000 * b.length // b.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(t, '')) AS collapsed_sha256
FROM formed f LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE["op13_fill_in_middle"] = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
drawn AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS p, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS q,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (
  SELECT *, array_to_string(u[1:least(p, q)], '') AS a, array_to_string(u[least(p, q) + 1:greatest(p, q)], '') AS b,
         array_to_string(u[greatest(p, q) + 1:], '') AS c FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
                        ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""
