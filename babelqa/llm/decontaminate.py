"""Benchmark decontamination by spaced-seed hashing, on Spark expressions only.

Texts are lower-cased words (runs of letters and digits), each kept as a 64-bit hash. A seed
is a fixed mask over SPAN neighbouring words; it hashes the words under its ones and ignores
the others, so a substitution in an ignored place does not hide a match; whatever two words of
a span are changed, one mask ignores both. Benchmark and document seeds are joined; each hit is
checked along its diagonal: the words of the span and up to EXTEND words on both sides must agree in
at least AGREE percent of the places. Where an item has no such hit in a document, as with a short excerpt from its middle, any range that
holds the span and at most EXTEND words on each side may agree in AGREE percent instead.

Items with fewer than SPAN words are searched whole, by masks of their length that skip one
place each: places with one other word count where the document has no exact one. Items under LEAST_WORDS words cannot be told from chance and match nothing. The seed table
is broadcast only while it has at most SEED_ROWS rows of fixed width; a larger one meets the
documents' seeds in a shuffle join, and the hits are checked after joining the documents'
words back by content. Equal texts of several items are searched once.

No row carries a whole text: texts are cut into pieces of PIECE places, with the words around
them, and a hit keeps only the words that its check may read. Generated code holds all rows that
one input row gives, so what a task holds is bounded by a piece and not by the document.

Defined results: null or empty text has no words and no hits; empty tables give no row; other
columns of the tables, whatever their names, are not read; a repeated row gives no second
result row; null ids match null-safely; items repeated under other ids each give their own
rows. Different texts under one item id (or without an id) are checked each on its own words
and share the row of their id, which counts the places of each text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import content_key, without

SPAN = 12
# Masks of six words out of twelve: the places fall into four classes by their rest modulo 4, and
# each mask ignores two of them, so that any two changed words are ignored by some mask.
SEEDS = tuple("".join("0" if k % 4 in (a, b) else "1" for k in range(SPAN)) for a in range(4) for b in range(a + 1, 4))
EXTEND = 6
AGREE = 80
LEAST_WORDS = 5
SEED_ROWS = 1_000_000   # 32 bytes of payload each
PIECE = 256             # places; at least twice EXTEND


def word_hashes(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seed_key(mask: str, at: str) -> Column:
    return F.expr("xxhash64({}L, {})".format(
        int("1" + mask, 2), ", ".join(f"get(h, {at} + {k})" for k, bit in enumerate(mask) if bit == "1")))


def pieces(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows with ``h`` (word hashes) -> keep, start, h: one row per PIECE places, with the words
    from EXTEND before the first place, which is word ``start``, to those that the widest span and
    EXTEND reach behind the last one. The higher-order function keeps the explode out of generated
    code, so the pieces of a text are handed on one at a time."""
    start = lambda at: F.greatest(at - EXTEND, F.lit(0))
    cut = lambda at: F.slice("h", start(at) + 1, at + PIECE - 1 + SPAN + EXTEND - start(at))
    every = F.transform(F.sequence(F.lit(0), F.size("h") - 1, F.lit(PIECE)), lambda at: F.struct(start(at).alias("start"), cut(at).alias("h")))
    return rows.select(*keep, F.explode(F.when(F.size("h") > 0, every)).alias("_p")).select(*keep, "_p.start", "_p.h")


def seeds(rows: DataFrame, keep: list[str], masks: tuple[str, ...]) -> DataFrame:
    """Pieces -> keep, p (first word in the text), span, key, one row per seed, in one pass over
    the positions for masks of all lengths."""
    if not masks:
        return rows.select(*keep, F.lit(0).alias("p"), F.lit(0).alias("span"), F.lit(0).cast("long").alias("key")).limit(0)
    first = F.least("start", F.lit(EXTEND))
    last = F.least(first + PIECE - 1, F.size("h") - min(map(len, masks)))
    at = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_k", F.explode(at))
    found = F.array(*(F.struct(F.lit(len(m)).alias("span"), _seed_key(m, "_k").alias("key")) for m in masks))
    found = rows.select("*", F.explode(found).alias("_s"))
    if len(set(map(len, masks))) > 1:
        found = found.where(F.col("_k") + F.col("_s.span") <= F.size("h"))
    return found.select(*keep, (F.col("start") + F.col("_k")).alias("p"), "_s.span", "_s.key")


def _around() -> list[Column]:
    """Of pieces and seeds found in them: lead, one, the words of the span and up to EXTEND on both
    sides, lead of them before it. Again a higher-order function, which ends the generated code:
    the hits of a piece meet their items one at a time."""
    at, lead = F.col("p") - F.col("start"), F.least(F.lit(EXTEND), F.col("p"))
    last = F.least(F.size("h"), at + F.col("span") + EXTEND) - 1
    return [lead.alias("lead"), F.transform(F.sequence(at - lead, last), lambda k: F.get("h", k)).alias("one")]


def _some_range() -> Column:
    """Some range around the span agrees in AGREE percent: its places sum up to 0 or more where
    an agreeing one counts 100 - AGREE and another -AGREE, so both sides are stretched alone."""
    score = F.transform("same", lambda x: x * 100 - AGREE)
    best = lambda part: F.aggregate(
        part, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top")),
        lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.greatest(a["top"], a["sum"] + x).alias("top")), lambda a: a["top"])
    left, behind = F.slice(score, 1, F.col("before")), F.col("before") + F.col("span")
    right = F.slice(score, behind + 1, F.col("n") - behind)
    middle = F.aggregate(F.slice(score, F.col("before") + 1, F.col("span")), F.lit(0), lambda a, x: a + x)
    return middle + best(F.reverse(left)) + best(right) >= 0


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", seed_rows: int = SEED_ROWS) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, t (content key), item_id,
    n_hits (distinct confirmed places), matched (most words agreeing around a hit),
    first_word (smallest place of a hit in the document, in words)."""
    items = (benchmark.select(F.col(item_col).alias("item_id"), word_hashes(F.col(item_text)).alias("h"))
             .where(F.size("h") >= LEAST_WORDS).withColumn("words", F.xxhash64("h")))
    of_text = items.select("item_id", "words").distinct()
    items = items.select("words", "h").distinct()
    short = sorted(r[0] for r in items.where(F.size("h") < SPAN).select(F.size("h")).distinct().collect())
    skips = {n: tuple("1" * k + "0" + "1" * (n - 1 - k) for k in range(n)) for n in short}
    every = SEEDS + tuple(m for n in short for m in skips[n])
    item_seeds = seeds(pieces(items, ["words"]), ["words"], SEEDS)
    for n, masks in skips.items():
        whole = items.where(F.size("h") == n)
        item_seeds = item_seeds.unionByName(seeds(pieces(whole, ["words"]), ["words"], masks))
    item_seeds = item_seeds.select("key", "words", F.col("p").alias("q"), "span")
    item_words = items.select("words", F.col("h").alias("g"))
    n_seeds = item_seeds.count()

    texts = docs.select(F.col(id_col).alias("doc_id"), content_key(text_col).alias("t"),
                        word_hashes(F.col(text_col)).alias("h"))
    parts = pieces(texts, ["doc_id", "t"])
    if n_seeds <= seed_rows:
        known = F.broadcast(item_seeds.select("key").distinct())
        hits = seeds(parts, ["doc_id", "t", "start", "h"], every).join(known, "key", "left_semi")
        hits = hits.select("doc_id", "t", "p", "span", "key", *_around())
        hits = hits.join(F.broadcast(item_seeds), ["key", "span"]).join(F.broadcast(item_words), "words")
    else:
        narrow = seeds(parts, ["doc_id", "t", "start"], every).join(item_seeds, ["key", "span"]).drop("key").distinct()
        whole = parts.select(F.col("doc_id").alias("d"), F.col("t").alias("u"), F.col("start").alias("s"), "h")
        hits = narrow.join(whole, (F.col("t") == F.col("u")) & (F.col("start") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")))
        hits = hits.select("doc_id", "t", "p", "span", "words", "q", *_around()).join(item_words, "words")

    before = F.least("lead", "q")
    behind = F.least(F.size("one") - F.col("lead") - F.col("span"), F.lit(EXTEND), F.size("g") - F.col("q") - F.col("span"))
    hits = hits.withColumn("before", before).withColumn("n", before + F.col("span") + behind)
    one = F.slice("one", F.col("lead") - before + 1, F.col("n"))
    two = F.slice("g", F.col("q") - before + 1, F.col("n"))
    hits = hits.withColumn("same", F.zip_with(one, two, lambda x, y: (x == y).cast("int")))
    hits = hits.withColumn("matched", F.aggregate("same", F.lit(0), lambda a, x: a + x))
    needed = F.when(F.col("span") < SPAN, 100).otherwise(AGREE)
    hits = hits.withColumn("whole", F.col("matched") * 100 >= needed * F.col("n")).where(F.col("whole") | _some_range())
    places = hits.groupBy("doc_id", "t", "words", "p", "q").agg(
        F.max("matched").alias("matched"), F.max("whole").alias("whole"))
    of = lambda agg, c: (agg(F.when(F.col("whole"), c)), agg(c))
    (most_whole, most), (first_whole, first) = of(F.max, F.col("matched")), of(F.min, F.col("p"))
    by_text = places.groupBy("doc_id", "t", "words").agg(
        F.count(F.when(F.col("whole"), 1)).alias("n_whole"), F.count("*").alias("n"), most_whole.alias("most_whole"),
        most.alias("most"), first_whole.alias("first_whole"), first.alias("first"))
    n_whole, n = (F.coalesce(F.sum(c), F.lit(0)) for c in ("n_whole", "n"))
    either = lambda agg, c: F.coalesce(agg(f"{c}_whole"), agg(c)).cast("long")
    return by_text.join(of_text, "words").groupBy("doc_id", "t", "item_id").agg(
        F.when(n_whole > 0, n_whole).otherwise(n).alias("n_hits"), either(F.max, "most").alias("matched"),
        either(F.min, "first").alias("first_word"))


def without_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents in which a benchmark item is found; columns as they were."""
    return without(docs, contaminated(docs, benchmark))
