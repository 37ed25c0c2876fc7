"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a learned lexicon (whole words and word beginnings), how
often a second-person word stands near a lexicon hit, capitals, punctuation, and signs of
obfuscation. Nothing else of a document is an input.

The labelled rows are split by hash: one part teaches the lexicon and the trees, the other
the calibration. At most MAX_LABELLED labelled rows are used, a share of all by hash of the
id; everything else works on all rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.llm.batches import map_texts
from leadline.llm.columns import without
from leadline.llm.decontamination import words_of
from leadline.session import stage

MAX_LABELLED = 10_000
MAX_TERMS = 5_000
THRESHOLD = 0.3
HEAD = 4  # bytes of the shortest word beginning in the lexicon
HEADS = (4, 5, 6)
NEAR = 5  # words around a hit in which a second-person word counts
SECOND_PERSON = frozenset(
    w.encode()
    for w in "you your yours yourself u ur du dich dir dein deine ihr euch sie ihnen tu te toi ton ta tes vous votre vos"
    " tú ti tu tus usted ustedes vosotros vuestra vuestro".split()
)
_UPPER = bytes(range(65, 91))
_MARKS = b"!?.,;:\"'()-"
_SHOUT = re.compile(rb"\b[A-Z]{3,}\b")
_RUNS = re.compile(rb"[!?]{2,}")
_MASKED = re.compile(rb"[A-Za-z][@$*#!|0-9]+[A-Za-z]")

FEATURES = (
    "word_density", "head_density", "hits", "hit_kinds", "near_second_person", "second_person", "capitals", "shouting",
    "exclamations", "questions", "marks", "mark_runs", "masked", "stretched", "length",
)


@dataclass(frozen=True)
class Lexicon:
    """Words, and beginnings of words, that mark the label. ``first`` has the first bytes of all."""

    words: frozenset[bytes]
    heads: frozenset[bytes]
    first: frozenset[bytes]


def terms_of(text: bytes | None) -> set[tuple[str, bytes]]:
    """Different words and word beginnings of a text; kind "w" or "h"."""
    out: set[tuple[str, bytes]] = set()
    for w in set(words_of(text)):
        out.add(("w", w))
        out.update(("h", w[:n]) for n in HEADS if len(w) > n)
    return out


def features_of(text: bytes | None, lexicon: Lexicon) -> list[float]:
    """FEATURES of one text; all zero without words."""
    words = words_of(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    by_word = by_head = 0
    places, kinds = [], set()
    first = lexicon.first
    for k, w in enumerate(words):
        if w[:HEAD] in first:
            head = next((w[:m] for m in HEADS if w[:m] in lexicon.heads and len(w) > m), None)
            if w in lexicon.words:
                by_word += 1
                kinds.add(w)
                places.append(k)
            elif head is not None:
                by_head += 1
                kinds.add(head)
                places.append(k)
    near = sum(any(w in SECOND_PERSON for w in words[max(0, k - NEAR) : k + NEAR + 1]) for k in places)
    size = len(text)
    codes = np.frombuffer(text, np.uint8)
    same = codes[1:] == codes[:-1]
    letter = codes[2:] > 64
    stretched = int((same[1:] & same[:-1] & letter).sum()) if size > 2 else 0
    second = sum(map(SECOND_PERSON.__contains__, words))
    return [
        by_word / n,
        by_head / n,
        float(np.log1p(len(places))),
        float(np.log1p(len(kinds))),
        near / len(places) if places else 0.0,
        second / n,
        (size - len(text.translate(None, _UPPER))) / size,
        len(_SHOUT.findall(text)) / n,
        text.count(b"!") / n,
        text.count(b"?") / n,
        (size - len(text.translate(None, _MARKS))) / size,
        len(_RUNS.findall(text)) / n,
        len(_MASKED.findall(text)) / n,
        stretched / size,
        float(np.log1p(n)),
    ]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_lexicon(labelled: DataFrame, max_terms: int = MAX_TERMS) -> Lexicon:
    """Terms that nearly only rows of label 1 hold, by the Wilson lower bound of their share.

    Rows are (text, label). Tasks count terms before the shuffle. At most ``max_terms`` terms
    with the highest bound come to the driver.
    """
    fields = [
        T.StructField("terms", T.ArrayType(T.StructType([
            T.StructField("kind", T.StringType()), T.StructField("term", T.BinaryType()),
            T.StructField("n", T.LongType()), T.StructField("ones", T.LongType()),
        ])))
    ]

    def work(texts, part):
        n, ones = Counter(), Counter()
        for text, label in zip(texts.to_pylist(), part.column("label").to_pylist()):
            found = terms_of(text)
            n.update(found)
            if label == 1:
                ones.update(found)
        counted = [{"kind": k, "term": t, "n": c, "ones": ones[k, t]} for (k, t), c in n.items()]
        return {"terms": [counted] + [None] * (len(texts) - 1)}

    counts = map_texts(labelled, "text", fields, work, ["label"]).select(F.explode("terms").alias("t")).select("t.*")
    counts = counts.groupBy("kind", "term").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    p, z2, n = F.col("ones") / F.col("n"), 1.96**2, F.col("n")
    bound = (p + z2 / (2 * n) - 1.96 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    top = (
        counts.where(F.col("ones") >= 4)
        .withColumn("bound", bound)
        .where(F.col("bound") > 0.5)
        .orderBy(F.desc("bound"), "kind", "term")
        .limit(max_terms)
        .collect()
    )
    words = frozenset(bytes(r["term"]) for r in top if r["kind"] == "w")
    heads = frozenset(bytes(r["term"]) for r in top if r["kind"] == "h")
    return Lexicon(words, heads, frozenset(t[:HEAD] for t in words | heads))


def with_features(df: DataFrame, lexicon: Lexicon, text_col: str, keep: list[str]) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(lexicon)
    fields = [T.StructField(c, T.DoubleType()) for c in FEATURES]

    def work(texts, part):
        rows = np.array([features_of(t, sent.value) for t in texts.to_pylist()]).reshape(-1, len(FEATURES))
        return {c: pa.array(rows[:, k]) for k, c in enumerate(FEATURES)}

    return map_texts(df, text_col, fields, work, keep)


@dataclass
class Model:
    """A fitted scorer; ``trees`` is None where the labels had one class only."""

    lexicon: Lexicon
    base_rate: float
    trees: object = None
    calibration: object = None

    def score(self, docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
        """``keep`` columns (all by default) and the score, 0 to 1. A column named like the score is replaced.

        Null and empty texts have all features zero and are scored like any other. Repeated
        rows get equal scores, an empty table stays empty.
        """
        keep = without(docs.columns if keep is None else keep, [score_col])
        if self.trees is None:
            return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(self.base_rate).alias(score_col))
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(text_col).alias("text"))
        featured = _assembled(with_features(rows, self.lexicon, "text", ["kept"]))
        scored = self.calibration.transform(_raw(self.trees.transform(featured)))
        value = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
        return scored.select("kept", value.alias("value")).select(
            *[F.col("kept").getField(c).alias(c) for c in keep], F.col("value").alias(score_col)
        )


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(df)


def _raw(predicted: DataFrame) -> DataFrame:
    return predicted.withColumn("raw", vector_to_array("probability")[1]).drop("prediction", "probability", "rawPrediction")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = MAX_LABELLED,
    trees: int = 20,
    depth: int = 3,
    learnable: Column | None = None,
) -> Model:
    """Fit lexicon, trees and calibration on labelled rows that are not held out.

    Null labels and null ids teach nothing; an id with several labels counts as 1 if any is 1.
    With labels of one class only, or none, every score is the share of ones (0 without labels).
    With fewer than 50 rows to calibrate on, the calibration takes the rows of the trees as well.
    """
    learnable = ~held_out(id_col) if learnable is None else learnable
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & learnable)
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = stage(texts.join(known, "id").withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(10))))
    teach, adjust = F.col("part") < 7, F.col("part") >= 7
    sizes = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones"),
        F.count(F.when(teach, 1)).alias("taught"), F.sum(F.when(teach, F.col("label"))).alias("taught_ones"),
    ).first()
    rate = (sizes["ones"] or 0) / max(1, sizes["n"])
    lexicon = learn_lexicon(rows.where(teach).select("text", "label"))
    if not 0 < (sizes["taught_ones"] or 0) < sizes["taught"]:
        return Model(lexicon, rate)
    featured = stage(_assembled(with_features(rows, lexicon, "text", ["label", "part"])).select("label", "part", "vector"))
    model = GBTClassifier(
        featuresCol="vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, minInstancesPerNode=3
    ).fit(featured.where(teach))
    checked = _raw(model.transform(featured.where(adjust)))
    if sizes["n"] - sizes["taught"] < 50:
        checked = _raw(model.transform(featured))  # too few rows to calibrate on their own
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label").fit(checked.select("raw", F.col("label").cast("double")))
    return Model(lexicon, rate, model, calibration)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 from THRESHOLD on) for every row."""
    model = fit(docs, labels, id_col, text_col)
    return model.score(docs, text_col, [id_col]).select(
        F.col(id_col).alias("doc_id"),
        held_out(id_col).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
