"""Preprocessing for MLlib: imputation, pooled one-hot codes, ordinal codes, scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadline.operators.order_stats import DISTINCT_LIMIT, exact_quantiles
from leadline.operators.profile import value_counts
from leadline.session import stage

INFREQUENT = "__infrequent__"
MAX_CATEGORIES = 1_000_000
# Rare categories of a column that a filter lists; more are joined.
MAX_LISTED = 1000
# Accuracy of the sketches that bracket a median; a bracket holds about 4 rows in so many.
BRACKET = 500


@dataclass(frozen=True)
class Encoding:
    """How categorical and numeric columns become one vector.

    ``kind`` is ``"onehot"`` or ``"ordinal"``. One-hot codes pool categories under
    ``min_rows`` rows; ``unknown_to_pool`` sends categories unseen in training there too,
    otherwise they get all zeros. ``scale`` is None, ``"std"`` or ``"center"``.
    """

    categorical: tuple[str, ...]
    numeric: tuple[str, ...]
    kind: str = "onehot"
    min_rows: int = 20
    unknown_to_pool: bool = False
    scale: str | None = None


@dataclass
class FittedEncoding:
    """What the training rows taught: fills, category counts and medians.

    ``counts`` (column_name, value, n) is a staged table, so pooling works for any number of categories. The
    vocabularies that MLlib's stages and the slots need live on the driver and are read when first asked for.
    """

    spec: Encoding
    train: DataFrame
    counts: DataFrame | None
    fill: dict[str, str]
    few: dict[str, int]
    medians: dict[str, float]

    @cached_property
    def _vocabulary(self) -> dict[str, dict[str, int]]:
        return _collected(self.counts, self.spec.categorical) if self.counts is not None else {}

    @cached_property
    def labels(self) -> dict[str, list[str]]:
        """The categories of each column, in order, and last the pool of rare ones if there is one."""
        spec, out = self.spec, {}
        for c in spec.categorical:
            counts = self._vocabulary[c]
            out[c] = sorted(counts)
            if spec.kind == "onehot":
                out[c] = [v for v in out[c] if counts[v] >= spec.min_rows or v == self.fill[c]]
                if self.few[c] and not spec.unknown_to_pool:
                    out[c].append(INFREQUENT)
            out[c] = out[c] or [INFREQUENT]
        return out

    @cached_property
    def slots(self) -> list[str]:
        pool = [INFREQUENT] if self.spec.unknown_to_pool else []
        return [f"{c}={v}" for c in self.spec.categorical for v in self.labels[c] + pool] + list(self.spec.numeric)

    @cached_property
    def stages(self) -> PipelineModel:
        spec = self.spec
        categorical, numeric = list(spec.categorical), list(spec.numeric)
        # The last slot of a column is its "unknown" index: kept as the pool, or dropped to zeros.
        encoder = OneHotEncoder(
            inputCols=[f"_i_{c}" for c in categorical], outputCols=[f"_h_{c}" for c in categorical],
            dropLast=not spec.unknown_to_pool, handleInvalid="error",
        )
        stages = [*_index_models(self.labels, categorical), *([encoder] if categorical else [])]
        stages += _onehot_vector(categorical, numeric, [f"_m_{c}" for c in numeric], spec.scale)
        return Pipeline(stages=stages).fit(self.prepare(self.train))

    @cached_property
    def _rare(self) -> dict[str, list[str] | DataFrame]:
        """Per column with rare categories that are pooled: their list, or a table of one column if they are many."""
        out = {}
        if self.spec.kind != "onehot" or self.spec.unknown_to_pool:
            return out
        for c, n in self.few.items():
            if n:
                rare = self.counts.filter(
                    (F.col("column_name") == c) & (F.col("n") < self.spec.min_rows) & (F.col("value") != F.lit(self.fill[c]))
                ).select(F.col("value").alias(f"_r_{c}"))
                out[c] = rare if n > MAX_LISTED else [r[0] for r in rare.collect()]
        return out

    def prepare(self, df: DataFrame) -> DataFrame:
        """Filled and pooled text columns ``_c_<name>``, numbers ``_m_<name>`` with the median for nulls and NaN."""
        out, joined = {}, {}
        for c in self.spec.categorical:
            text, rare = F.coalesce(F.col(c).cast("string"), F.lit(self.fill[c])), self._rare.get(c)
            if isinstance(rare, list):
                text = F.when(text.isin(rare), INFREQUENT).otherwise(text)
            elif rare is not None:
                joined[c] = rare
            out[f"_c_{c}"] = text
        for c in self.spec.numeric:
            out[f"_m_{c}"] = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(float(self.medians[c])))
        ready = df.withColumns(out)
        for c, rare in joined.items():
            # A category is in the table once, so the join keeps the rows as they are.
            hit = F.col(f"_r_{c}").isNotNull()
            ready = ready.join(rare, F.col(f"_c_{c}") == F.col(f"_r_{c}"), "left")
            ready = ready.withColumn(f"_c_{c}", F.when(hit, INFREQUENT).otherwise(F.col(f"_c_{c}"))).drop(f"_r_{c}")
        return ready

    def transform(self, df: DataFrame) -> DataFrame:
        return self.stages.transform(self.prepare(df))


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Median per column, nulls and NaN left out; 0 for a column without a number.

    One aggregation for all columns of at most ``DISTINCT_LIMIT`` distinct values, and three passes for all others.
    """
    if not columns:
        return {}
    values = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(f"v{k}") for k, c in enumerate(columns)])
    sizes = values.agg(*[F.approx_count_distinct(f"v{k}") for k in range(len(columns))]).first()
    small = [k for k, n in enumerate(sizes) if n <= DISTINCT_LIMIT]
    found = dict(zip(small, values.agg(F.lit(0), *[F.percentile(f"v{k}", F.lit(0.5)) for k in small]).first()[1:]))
    found.update(_bracketed_medians(values, [k for k in range(len(columns)) if k not in found]))
    return {c: found[k] or 0.0 for k, c in enumerate(columns)}


def _bracketed_medians(values: DataFrame, columns: list[int]) -> dict[int, float]:
    """Medians of the columns v<k>. Sketches bracket each median, counts tell whether they do, and only
    values inside the brackets are counted one by one. A bracket that failed is searched by histograms."""
    if not columns:
        return {}
    probs = F.array(F.lit(0.5 - 2 / BRACKET), F.lit(0.5 + 2 / BRACKET))
    edges = values.agg(*[F.percentile_approx(f"v{k}", probs, F.lit(BRACKET)).alias(f"e{k}") for k in columns]).first()
    edges = {k: edges[f"e{k}"] for k in columns if edges[f"e{k}"]}
    asked = []
    for k, (low, high) in edges.items():
        v = F.col(f"v{k}")
        asked += [F.count(v), F.count(F.when(v < F.lit(low), 1)), F.count(F.when(v <= F.lit(high), 1))]
    seen = values.agg(F.lit(0), *asked).first()[1:]
    ranks, found = {}, {}
    for i, (k, (low, high)) in enumerate(edges.items()):
        n, below, upto = seen[3 * i : 3 * i + 3]
        first, last = (n - 1) // 2, n // 2
        if not (below <= first and last < upto):
            found[k] = exact_quantiles(values, [], f"v{k}", {"m": 0.5}).first()["m"]
        elif low == high:
            found[k] = low
        else:
            ranks[k] = (first - below, last - below)
    if ranks:
        cells = [
            F.when(F.col(f"v{k}").between(F.lit(edges[k][0]), F.lit(edges[k][1])), F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("v")))
            for k in ranks
        ]
        inside = values.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).groupBy("x.k", "x.v").agg(F.count(F.lit(1)).alias("n"))
        upto = inside.withColumn("upto", F.sum("n").over(W.partitionBy("k").orderBy("v")))
        wanted = [((F.col("k") == k) & (F.col("upto") - F.col("n") <= r) & (r < F.col("upto"))) for k, pair in ranks.items() for r in set(pair)]
        hit = wanted[0]
        for one in wanted[1:]:
            hit = hit | one
        rows = upto.filter(hit).collect()
        for k, pair in ranks.items():
            two = [next(r["v"] for r in rows if r["k"] == k and r["upto"] - r["n"] <= rank < r["upto"]) for rank in pair]
            found[k] = two[0] * 0.5 + two[1] * 0.5
    return {k: found.get(k) for k in columns}


def category_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, int]]:
    """Rows per category and column, one aggregation for all columns.

    The vocabulary is part of a fitted model and lives on the driver, as it does in
    ``StringIndexer``; more than ``MAX_CATEGORIES`` values is an error, not a cut.
    """
    return _collected(value_counts(df, columns).filter(F.col("value").isNotNull()), columns)


def _collected(counts: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, int]]:
    rows = counts.limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories; drop or coarsen a column")
    out: dict[str, dict[str, int]] = {c: {} for c in columns}
    for r in rows:
        out[r["column_name"]][r["value"]] = r["n"]
    return out


class _OrdinalCode:
    """Index columns to numbers, the index of unknown categories to -1."""

    def __init__(self, columns: Sequence[str], sizes: dict[str, int]):
        self.columns, self.sizes = list(columns), dict(sizes)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {f"_o_{c}": F.when(F.col(f"_i_{c}") == self.sizes[c], -1.0).otherwise(F.col(f"_i_{c}")) for c in self.columns}
        )


class _FittedOrdinal(FittedEncoding):
    @cached_property
    def slots(self) -> list[str]:
        return [*self.spec.categorical, *self.spec.numeric]

    @cached_property
    def stages(self) -> PipelineModel:
        return Pipeline(stages=_index_models(self.labels, self.spec.categorical)).fit(self.prepare(self.train))

    @cached_property
    def _tail(self) -> PipelineModel:
        inputs = [f"_o_{c}" for c in self.spec.categorical] + [f"_m_{c}" for c in self.spec.numeric]
        raw = "features" if self.spec.scale is None else "_raw"
        stages = [VectorAssembler(inputCols=inputs, outputCol=raw, handleInvalid="keep")]
        if self.spec.scale:
            stages.append(StandardScaler(inputCol=raw, outputCol="features", withStd=True, withMean=self.spec.scale == "center"))
        return Pipeline(stages=stages).fit(self.codes(self.train))

    @property
    def coded_columns(self) -> list[str]:
        return [*[f"_o_{c}" for c in self.spec.categorical], *[f"_m_{c}" for c in self.spec.numeric]]

    def codes(self, df: DataFrame) -> DataFrame:
        """Ordinal codes ``_o_<name>``, before assembly. ``df`` may have its codes already."""
        if set(self.coded_columns) <= set(df.columns):
            return df
        sizes = {c: len(self.labels[c]) for c in self.spec.categorical}
        return _OrdinalCode(self.spec.categorical, sizes).apply(self.stages.transform(self.prepare(df)))

    def transform(self, df: DataFrame) -> DataFrame:
        return self._tail.transform(self.codes(df))


def _index_models(labels: dict[str, list[str]], columns: Sequence[str]) -> list[StringIndexerModel]:
    # One model per column: the many-column constructor pads shorter vocabularies with nulls.
    return [
        StringIndexerModel.from_labels(labels[c], inputCol=f"_c_{c}", outputCol=f"_i_{c}", handleInvalid="keep") for c in columns
    ]


def fit_encoding(train: DataFrame, spec: Encoding) -> FittedEncoding:
    """Learn fills, category counts and medians from the training rows; vocabularies and scales when first asked for."""
    categorical, numeric = list(spec.categorical), list(spec.numeric)
    counts, fill, few = None, dict.fromkeys(categorical, INFREQUENT), dict.fromkeys(categorical, 0)
    if categorical:
        # Nulls become the most frequent category (the smallest on ties) before rows are counted against the pool
        # limit; that never makes a category rare, so the counts need no second pass.
        counts = stage(value_counts(train, categorical).filter(F.col("value").isNotNull()))
        usual = F.min(F.struct((-F.col("n")).alias("n"), "value"))
        known = counts.groupBy("column_name").agg(usual.alias("u"), F.count(F.when(F.col("n") < spec.min_rows, 1)).alias("few"))
        for r in known.collect():
            fill[r["column_name"]] = r["u"]["value"]
            few[r["column_name"]] = r["few"] - (1 if -r["u"]["n"] < spec.min_rows else 0)
    kind = _FittedOrdinal if spec.kind == "ordinal" else FittedEncoding
    return kind(spec, train, counts, fill, few, exact_medians(train, numeric))


def _onehot_vector(categorical: list[str], numeric: list[str], numeric_out: list[str], scale: str | None) -> list:
    """Scale the numeric part alone, then put it behind the sparse codes."""
    if not numeric:
        return [VectorAssembler(inputCols=[f"_h_{c}" for c in categorical], outputCol="features", handleInvalid="keep")]
    raw = VectorAssembler(inputCols=numeric_out, outputCol="_numeric", handleInvalid="keep")
    stages, last = [raw], "_numeric"
    if scale:
        stages.append(StandardScaler(inputCol="_numeric", outputCol="_scaled", withStd=True, withMean=scale == "center"))
        last = "_scaled"
    return [*stages, VectorAssembler(inputCols=[*[f"_h_{c}" for c in categorical], last], outputCol="features", handleInvalid="keep")]
