"""Language ID by hierarchical discrimination: the family first, then one-versus-one linear
support vector machines between the languages of that family.

Features of a whole text: its bytes (letters as they are, ASCII lower-cased, other ASCII
bytes as one blank), counts of 1- to 4-byte windows hashed into FEATURES slots, square root,
unit length. The models are squared-hinge linear SVMs fitted by Nesterov gradient steps on a
bounded sample: about SAMPLE_PER_LANGUAGE labelled documents of each language and SAMPLE_ROWS in
all, drawn by a hash of id and text, so that neither the table's size nor its layout matters. Families come from a fixed table of
ISO codes; a code that is not listed is a family of its own.

score = probability of the family times the mean one-versus-one probability of the language
inside it, both from logistic margins; 0 for ``und``.

Defined results: null text, or text without a letter, is ``und`` with score 0; with no
labelled document to learn from, every text is ``und``; with a single language, that one;
repeated rows are drawn once and predicted each, rows without an id too; an empty table gives
no row; other columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, prepare, text_bytes, written
from .encoding import forget_chunks

FEATURES = 2048
WINDOWS = (1, 2, 3, 4)
SAMPLE_PER_LANGUAGE = 1000
SAMPLE_ROWS = 20_000     # of all languages together, 4 KB each on the driver
STEPS, PENALTY = 120, 1e-4
SHARPNESS = 4.0
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")

# ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt tk uz",
    "indic": "as bn gu hi mr ne or pa si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "austronesian": "id jv ms mg su tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

# ASCII letters lower-cased, other ASCII bytes one blank, the rest as is.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One unit row of FEATURES per text."""
    out = np.zeros((len(at) - 1, FEATURES), np.float32)
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        for s in range(a, b, 1 << 20):   # blocks overlap, so that no window is lost
            x = FOLD[raw[s:min(b, s + (1 << 20) + max(WINDOWS) - 1)]].astype(np.uint32)
            mixed = np.zeros(len(x), np.uint32)
            for n in range(1, max(WINDOWS) + 1):
                if len(x) < n:
                    break
                mixed = (mixed[:len(x) - n + 1] * np.uint32(0x01000193)) ^ x[n - 1:]
                last = len(mixed) if s + (1 << 20) >= b else 1 << 20
                if n in WINDOWS:
                    slot = ((mixed[:last] + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(21)
                    out[k] += np.bincount(slot, minlength=FEATURES)
    out = np.sqrt(out)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=out, where=size > 0)


def fit_svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a squared-hinge linear SVM; y is +1 or -1, the sides weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    past, step = w.copy(), 1.0 / (2 * 2.0 + PENALTY)   # rows have squared length 2
    for k in range(STEPS):
        ahead = w + k / (k + 3) * (w - past)
        slack = np.maximum(0, 1 - y * (x @ ahead))
        past, w = w, ahead - step * (PENALTY * ahead - 2 * x.T @ (weight * slack * y))
    return w.astype(np.float32)


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-SHARPNESS * np.clip(margin, -20, 20)))


class Hierarchy:
    """Family classifiers (one against the rest) and pairwise classifiers in each family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        names = np.array(langs)
        self.families: dict[str, list[str]] = {}
        for lang in self.langs:
            self.families.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
        family = np.array([FAMILY_OF.get(lang, lang) for lang in langs])
        self.heads = {f: fit_svm(x, np.where(family == f, 1, -1).astype(np.float32))
                      for f in self.families if len(self.families) > 1}
        self.pairs = {}
        for members in self.families.values():
            for a, b in combinations(members, 2):
                rows = (names == a) | (names == b)
                self.pairs[a, b] = fit_svm(x[rows], np.where(names[rows] == a, 1, -1).astype(np.float32))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        order = list(self.families)
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        if self.heads:
            chance = np.stack([_chance(x @ self.heads[f]) for f in order], axis=1)
            chance /= chance.sum(axis=1, keepdims=True)
        else:
            chance = np.ones((len(x), len(order)))
        pick = chance.argmax(axis=1)
        best, score = np.empty(len(x), object), chance[np.arange(len(x)), pick]
        for k, f in enumerate(order):
            rows, members = np.flatnonzero(pick == k), self.families[f]
            votes = np.zeros((len(rows), len(members)))
            for a, b in combinations(range(len(members)), 2):
                p = _chance(x[rows] @ self.pairs[members[a], members[b]])
                votes[:, a] += p
                votes[:, b] += 1 - p
            if len(members) > 1:
                votes /= len(members) - 1
                score[rows] *= votes.max(axis=1)
            best[rows] = np.array(members, object)[votes.argmax(axis=1)]
        return best.tolist(), np.clip(score, 0, 1)


def training_rows(docs: DataFrame, labelled: Column, bound: int = SAMPLE_PER_LANGUAGE,
                  total: int = SAMPLE_ROWS) -> tuple[np.ndarray, list[str]]:
    """Features and languages of about ``bound`` labelled documents per language, and about
    ``total`` where there are many languages."""
    rows = docs.where(labelled).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = written(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    per_language = min(float(bound), total / max(1, counts.count()))
    draw = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    share = counts.select(F.col("lang").alias("_lang"), (F.lit(per_language) / F.col("n")).alias("_share"))
    rows = rows.withColumn("_draw", draw).join(share, F.col("lang") == F.col("_lang")).where(F.col("_draw") < F.col("_share"))
    rows = rows.groupBy("lang", "_draw").agg(F.first("text").alias("text"))      # equal rows draw alike
    out = pa.schema([("lang", pa.string()), ("x", pa.binary())])

    def run(batches):
        for batch in batches:
            found = features(*text_bytes(batch.column("text"))).astype(np.float16)
            yield batches_of({"lang": batch.column("lang"), "x": [v.tobytes() for v in found]}, out)

    sample = rows.select("lang", "text").mapInArrow(run, "lang string, x binary").collect()
    sample.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    if not sample:
        return np.empty((0, FEATURES), np.float32), []
    return (np.stack([np.frombuffer(bytes(r["x"]), np.float16) for r in sample]).astype(np.float32),
            [r["lang"] for r in sample])


def identify(docs: DataFrame, labelled: Column, columns: list[str], bound: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """docs (with doc_id, text, lang) -> the given columns, then lang_pred and score. Only
    rows where ``labelled`` holds are learned from; a prediction reads the text alone."""
    spark = docs.sparkSession
    prepare(spark)
    x, langs = training_rows(docs, labelled, bound)
    model = spark.sparkContext.broadcast(Hierarchy(x, langs) if langs else None)
    schema = docs.select(*columns).schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        forget_chunks()
        for batch in batches:
            column = batch.column("text")
            known = np.array([t is not None and LETTER.search(t) is not None for t in column.to_pylist()], bool)
            lang, score = [UNKNOWN] * len(known), np.zeros(len(known))
            if model.value is not None:
                raw, at = text_bytes(column)
                for k in range(0, len(known), 256):
                    best, sure = model.value.predict(features(raw, at[k:k + 257]))
                    for j in np.flatnonzero(known[k:k + 256]).tolist():
                        lang[k + j], score[k + j] = best[j], sure[j]
            arrays = [batch.column(c) for c in columns] + [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "lang_pred", "score"])

    return docs.select(*columns, *([] if "text" in columns else ["text"])).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True for the documents whose crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def predict_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from documents that are not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    found = identify(docs, ~held_out(F.col("doc_id")), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs whose language can be told; ``lang`` becomes the predicted one."""
    rest = F.struct(*(F.lit(None).cast("string").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(rest.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    found = identify(rows, ~held_out(F.col("doc_id")), ["row", "text"]).where(F.col("lang_pred") != UNKNOWN)
    row = F.col("row").withField("text", F.col("text")).withField("lang", F.col("lang_pred"))
    return found.select(row.alias("row")).select("row.*")
