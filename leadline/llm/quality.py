"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic regression on the text alone gives each document a probability. Documents of a host,
and of a path on the host, share evidence: their mean probability, shrunk. The global mean is
the prior of a host, a host's posterior is the prior of its paths. How many documents a prior
is worth is estimated from how far hosts (paths) really differ, so a sparse site stays near its
prior and a large one speaks for itself. A document's own evidence is left out of its site's.

    log-odds(document) = log-odds(text) + log-odds(path without the document) - log-odds(global)
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadline.llm.columns import SPACE
from leadline.llm.quality_rules import base_counts
from leadline.llm.toxicity import held_out
from leadline.session import stage, staging_dir

MAX_LABELLED = 20_000
THRESHOLD = 0.5
# Bounds of a prior's worth in documents.
LEAST_WORTH, MOST_WORTH = 2.0, 1000.0
EDGE = 1e-4

FEATURES = ("symbols", "dup_lines", "repeats", "word_length", "length", "distinct", "marks", "lines")


def text_features(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """doc_id, FEATURES and ``keep`` per row; ratios of a text without words are 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.split(F.btrim(text, F.lit(SPACE)), r"[\x20\x09-\x0D]+")
    more = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.struct(
            *[F.col(f"`{c}`").alias(c) for c in keep],
            F.size(F.array_distinct(words)).alias("n_distinct"),
            F.regexp_count(text, F.lit(r"[!?.,;:]")).alias("n_marks"),
            F.char_length(text).alias("n_chars"),
        ).alias("more"),
    )
    counts = base_counts(more, "id", "text", keep=("more",))
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counts.select(
        "doc_id",
        *[F.col(f"more.{c}").alias(c) for c in keep],
        (F.col("n_symbols") / n).alias("symbols"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_lines"),
        (F.col("n_repeat_words") / n).alias("repeats"),
        (F.col("word_chars") / n).alias("word_length"),
        F.log1p(F.col("n_words").cast("double")).alias("length"),
        (F.when(F.col("n_words") > 0, F.col("more.n_distinct")).otherwise(0) / n).alias("distinct"),
        (F.col("more.n_marks") / n).alias("marks"),
        (F.col("n_lines") / n).alias("lines"),
    )


@dataclass
class Model:
    """Stages that turn FEATURES into a probability; empty where the labels had one class only."""

    base_rate: float
    stages: tuple = ()

    def probability(self, featured: DataFrame) -> DataFrame:
        if not self.stages:
            return featured.withColumn("p", F.lit(self.base_rate))
        for s in self.stages:
            featured = s.transform(featured)
        return featured.withColumn("p", vector_to_array("probability")[1])


def fit(featured: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Model:
    """Logistic regression on at most ``max_labelled`` labelled rows that are not held out, by hash of the id.

    Null labels and ids teach nothing; an id with several labels counts as the largest.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
    rows = stage(featured.join(known, "doc_id").select("label", *FEATURES))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).first()
    rate = (sizes["ones"] or 0) / max(1, sizes["n"])
    if not 0 < (sizes["ones"] or 0) < sizes["n"]:
        return Model(rate)
    gather = VectorAssembler(inputCols=list(FEATURES), outputCol="raw_vector")
    scale = StandardScaler(inputCol="raw_vector", outputCol="vector", withMean=True).fit(gather.transform(rows))
    taught = scale.transform(gather.transform(rows))
    line = LogisticRegression(featuresCol="vector", labelCol="label", regParam=1e-3, maxIter=60).fit(taught)
    # A model just fitted holds its training summary and so the session, which tasks cannot be sent once it observed rows.
    path = f"{staging_dir(featured.sparkSession)}/model-{uuid.uuid4().hex}"
    line.save(path)
    return Model(rate, (gather, scale, LogisticRegressionModel.load(path)))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(q / (1 - q))


def _worth(groups: DataFrame) -> float:
    """Documents that a prior is worth, by moments: within-group over between-group variance.

    Groups are (n, mean, squares, prior). Without spread between groups the prior is worth MOST_WORTH.
    """
    n, mean = F.col("n"), F.col("mean")
    sums = groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum(n).alias("rows"),
        F.sum(F.col("squares") - n * mean * mean).alias("within"),
        F.sum(n * (mean - F.col("prior")) ** 2).alias("between"),
    ).first()
    if not sums["rows"]:
        return MOST_WORTH
    within = sums["within"] / max(1, sums["rows"] - sums["groups"])
    between = (sums["between"] - (sums["groups"] - 1) * within) / sums["rows"]
    return min(max(within / between, LEAST_WORTH), MOST_WORTH) if between > 0 else MOST_WORTH


def posteriors(scored: DataFrame, host: str = "host", path: str = "path", p: str = "p") -> DataFrame:
    """``scored`` with the global mean and each row's host and path posteriors without the row.

    Sums per path are made first and added up per host, so a host with a third of all rows is
    partial sums like any other. Null hosts and paths are groups of their own.
    """
    squares = F.sum(F.col(p) * F.col(p))
    paths = stage(
        scored.groupBy(F.col(host).alias("host_"), F.col(path).alias("path_")).agg(
            F.sum(p).alias("path_sum"), F.count(p).alias("path_n"), squares.alias("squares")
        )
    )
    hosts = stage(
        paths.groupBy("host_").agg(F.sum("path_sum").alias("host_sum"), F.sum("path_n").alias("host_n"), F.sum("squares").alias("squares"))
    )
    total = hosts.agg(F.sum("host_sum").alias("s"), F.sum("host_n").alias("n")).first()
    overall = (total["s"] or 0.0) / max(1, total["n"] or 0)
    host_mean, path_mean = F.col("host_sum") / F.col("host_n"), F.col("path_sum") / F.col("path_n")
    host_worth = _worth(hosts.select(F.col("host_n").alias("n"), host_mean.alias("mean"), "squares", F.lit(overall).alias("prior")))
    of_host = hosts.select(F.col("host_").alias("of_host"), "host_sum", "host_n")
    sites = paths.join(of_host, paths["host_"].eqNullSafe(of_host["of_host"])).drop("of_host")
    path_worth = _worth(sites.select(F.col("path_n").alias("n"), path_mean.alias("mean"), "squares", host_mean.alias("prior")))
    sites = sites.drop("squares")
    # A site is one row; Spark broadcasts the sites by measured size, or splits a hot one's rows.
    joined = scored.join(sites, scored[host].eqNullSafe(sites["host_"]) & scored[path].eqNullSafe(sites["path_"]))
    own = F.col(p)
    host_post = (F.col("host_sum") - own + F.lit(host_worth * overall)) / (F.col("host_n") - 1 + F.lit(host_worth))
    path_post = (F.col("path_sum") - own + F.lit(path_worth) * host_post) / (F.col("path_n") - 1 + F.lit(path_worth))
    return joined.select(
        *[scored[c] for c in scored.columns],
        F.lit(overall).alias("overall"),
        host_post.alias("host_posterior"),
        path_post.alias("path_posterior"),
    )


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
) -> DataFrame:
    """doc_id, held_out, text_score, host_posterior, path_posterior, score and kept for every row.

    ``labels`` (doc_id, quality) are read for rows that are not held out only. Null and empty texts
    have all ratios 0. Rows with null ids are scored; repeated rows are so many documents of their
    site and score alike but for rounding. An empty table stays empty; other columns are not read.
    """
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"), F.col(path_col).alias("path")
    )
    featured = stage(text_features(source, "doc_id", "text", ("host", "path")))
    model = fit(featured, labels)
    scored = stage(model.probability(featured).select("doc_id", "host", "path", "p"))
    odds = _logit(F.col("p")) + _logit(F.col("path_posterior")) - _logit(F.col("overall"))
    score = 1 / (1 + F.exp(-odds))
    return posteriors(scored).select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("p").alias("text_score"),
        "host_posterior",
        "path_posterior",
        score.alias("score"),
        (score >= THRESHOLD).alias("kept"),
    )
