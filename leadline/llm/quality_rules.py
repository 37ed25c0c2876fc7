r"""Quality rules with adaptive thresholds, DataFrame functions only.

Base counts come from each whole text. Two fixed base rules reject texts that are too short
or repeat themselves. For the remaining rules the values above zero of each metric are
sketched per (lang, source), and a text is rejected where it lies far outside the bulk of its
group's values: further from their median than SPREAD quartile distances. That is half the distance
between the quartiles; for metrics that are mostly zero it is the shorter of the two distances from
the median, as much of what is above zero there may be junk and must not widen the limits.
A value of zero is never above a limit. Where values above zero are rare in a large group, its few
values are out of place and say nothing of its bulk; the limit is then the lower quartile of the
next wider sketch.

The sketch is a log-bucket histogram: a value falls into the bucket ``floor(ln(v) / ln(GROWTH))``
and a sketch is its bucket counts. Two sketches merge by adding counts, which is how a group
with few values takes the sketch of its language, or of all texts. Quantiles read from it
are within a factor of GROWTH, and limits are buckets too: the only fixed part of a limit is
that a quartile distance is at least one bucket. Unlike sampled sketches it gives the same
result on every run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadline.llm.columns import strip_space
from leadline.session import stage

WINDOW = 8
GROWTH = 1.01
# A metric is an integer ratio in thousandths; ``low`` says that it has a lower limit too, and is above zero in all texts.
METRICS = {
    "symbols": {"over": ("n_symbols", "n_words"), "low": False},
    "dup_lines": {"over": ("n_dup_lines", "n_lines"), "low": False},
    "repeats": {"over": ("n_repeat_words", "n_words"), "low": False},
    "word_length": {"over": ("word_chars", "n_words"), "low": True},
}
SPREAD = 4
# A sketch of fewer values above zero gives way to the next wider one.
MIN_VALUES = 20
# In a group of at least MIN_GROUP texts, values above zero in less than one of RARE texts are rare.
MIN_GROUP, RARE = 100, 100
_SPACES = r"[\x20\x09-\x0D]+"


def _window_hashes(words: str) -> Column:
    """One hash per window of WINDOW words, from one hash per word."""
    n = F.size(words) - WINDOW + 1
    return F.when(
        n > 0,
        F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(F.col("word_hashes"), i + k) for k in range(WINDOW)])
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    r"""Counts per row: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Words are runs of other characters than ASCII white space. ``n_lines`` are \n-split lines
    with a word. ``n_repeat_words`` are words in 8-word windows that occur at least twice in
    the text, the first occurrence included. Null or empty text: all zero. One row per input
    row; columns are the id, the counts and ``keep``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), *[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep], text.alias("text"))
    df = df.withColumn("words", F.filter(F.split("text", _SPACES, -1), lambda w: w != ""))
    df = df.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: strip_space(x) != ""))
    df = df.withColumn("word_hashes", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("windows", _window_hashes("words"))
    # Most texts repeat no window; only the others sort theirs. A window repeats if a neighbour
    # in hash order has the same hash. Sorting keeps this linear in memory for texts of any length.
    df = df.withColumn(
        "by_hash",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    df = df.withColumn(
        "starts",
        F.sort_array(
            F.transform(
                F.filter(
                    "by_hash",
                    lambda x, k: x["h"].eqNullSafe(F.get(F.col("by_hash"), k - 1)["h"])
                    | x["h"].eqNullSafe(F.get(F.col("by_hash"), k + 1)["h"]),
                ),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
    )["n"]
    return df.select(
        "doc_id",
        *[F.col(f"keep_{c}").alias(c) for c in keep],
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _value(name: str) -> Column:
    """A metric in thousandths; a text without words or lines has 0."""
    over, under = METRICS[name]["over"]
    return F.floor(F.col(over) * 1000 / F.greatest(F.col(under), F.lit(1))).cast("long")


def _bucket(value: Column) -> Column:
    """The bucket of a value above zero; null for zero."""
    return F.when(value > 0, F.floor(F.log(value.cast("double")) / F.lit(math.log(GROWTH))).cast("int"))


def _long(counts: DataFrame) -> DataFrame:
    """One row per text and metric: lang, source, metric, value in thousandths."""
    pairs = [F.struct(F.lit(name).alias("metric"), _value(name).alias("value")) for name in METRICS]
    return counts.select("lang", "source", F.explode(F.array(*pairs)).alias("m")).select("lang", "source", "m.metric", "m.value")


def sketches(counts: DataFrame) -> DataFrame:
    """Bucket counts per (lang, source, metric) of values above zero, over texts that pass the base rules."""
    return (
        _long(counts.where(~F.col("base_failed")))
        .withColumn("bucket", _bucket(F.col("value")))
        .where(F.col("bucket").isNotNull())
        .groupBy("lang", "source", "metric", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge_sketches(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and metric: ``total`` values, and the buckets ``upper`` and ``lower`` that are still within the limits.

    ``q_low`` is the bucket of the lower quartile, ``step`` is the quartile distance that decided, in buckets; 0 where the least distance of one bucket did.
    """
    by = Window.partitionBy(*keys, "metric")
    ranked = sketch.select(
        *keys,
        "metric",
        "bucket",
        F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(by).alias("total"),
    )
    at = {
        name: F.min(F.when(F.col("upto") * 100 >= F.col("total") * percent, F.col("bucket")))
        for name, percent in (("q_low", 25), ("q_mid", 50), ("q_high", 75))
    }
    out = ranked.groupBy(*keys, "metric").agg(F.max("total").alias("total"), *[v.alias(k) for k, v in at.items()])
    has_low = F.col("metric").isin([k for k, m in METRICS.items() if m["low"]])
    half = F.ceil((F.col("q_high") - F.col("q_low")) / 2).cast("int")
    step = F.when(has_low, half).otherwise(F.least(F.col("q_high") - F.col("q_mid"), F.col("q_mid") - F.col("q_low")))
    reach = SPREAD * F.greatest(step, F.lit(1))
    return out.select(
        *keys,
        "metric",
        "total",
        "q_low",
        step.alias("step"),
        (F.col("q_mid") + reach).alias("upper"),
        F.when(has_low, F.col("q_mid") - reach).alias("lower"),
    )


def _wide(bounds: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """One row per group with the limits of every metric as columns."""
    cells = []
    for name in METRICS:
        for part in ("total", "q_low", "upper", "lower"):
            cells.append(F.max(F.when(F.col("metric") == name, F.col(part))).alias(f"{prefix}_{name}_{part}"))
    return bounds.groupBy(*keys).agg(*cells)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts and verdict per row: doc_id, counts, base_failed, kept.

    ``docs`` needs columns lang and source besides id and text. A null lang or source is a
    group of its own. A metric of which a group has fewer than MIN_VALUES values above zero, among
    texts that pass the base rules, takes the merged sketch of the language, and where that has
    too few, of all texts; a rare one takes their lower quartile as its limit. A text in the bucket of a limit is kept. An empty table gives an empty
    table; repeated rows are judged alike. The counts are staged once, without the texts, and read
    by the sketch and the filter.
    """
    counts = base_counts(docs, id_col, text_col, keep=("lang", "source")).withColumns(
        {
            "lang": F.col("lang").cast("string"),
            "source": F.col("source").cast("string"),
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        }
    )
    counts = stage(counts)
    fine = stage(sketches(counts))
    own = _wide(limits(fine, ["lang", "source"]), ["lang", "source"], "own")
    lang = _wide(limits(merge_sketches(fine, ["lang"]), ["lang"]), ["lang"], "lang").withColumnRenamed("lang", "of_lang")
    every = _wide(limits(merge_sketches(fine, []), []), [], "every").select("*", F.lit(1).alias("one"))
    # The groups' limits are few rows next to the texts; Spark broadcasts them by measured size.
    table = own.join(lang, F.col("lang").eqNullSafe(F.col("of_lang"))).withColumn("one", F.lit(1)).join(every, "one")
    texts = F.col("own_word_length_total")  # no text that passes the base rules has a word length of zero
    chosen = []
    for name in METRICS:

        def enough(level: str, part: str, wider: Column) -> Column:
            return F.when(F.col(f"{level}_{name}_total") >= MIN_VALUES, F.col(f"{level}_{name}_{part}")).otherwise(wider)

        of_wider = {part: enough("lang", part, F.col(f"every_{name}_{part}")) for part in ("q_low", "upper", "lower")}
        rare = (texts >= MIN_GROUP) & (F.col(f"own_{name}_total") * RARE < texts)
        upper = F.when(rare, of_wider["q_low"]).otherwise(enough("own", "upper", of_wider["upper"]))
        chosen += [upper.alias(f"{name}_upper"), enough("own", "lower", of_wider["lower"]).alias(f"{name}_lower")]
    table = table.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), *chosen)
    # Null limits and the null bucket of zero reject nothing.
    fails = F.lit(False)
    for name in METRICS:
        bucket = _bucket(_value(name))
        for beyond in (bucket > F.col(f"{name}_upper"), bucket < F.col(f"{name}_lower")):
            fails = fails | F.coalesce(beyond, F.lit(False))
    same = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    return counts.join(table, same, "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~fails).alias("kept"),
    )
