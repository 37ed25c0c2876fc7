"""Near-duplicate groups by bottom-k sketches of word shingles.

One hash function gives every shingle a number. The KEPT smallest of a text are its sketch, from
which the similarity of two texts is estimated; the HEAD smallest are posted to inverted lists.

1. Texts with equal shingle sets are one class; only class representatives go on.
2. Of the HEAD values a text posts its rarest ones. Two texts of the asked similarity share so
   many of their HEAD values (all but a chance of about 1e-7) that, whatever the order, their
   rarest ones must share one. A text with unique values posts none for these.
3. Lists of up to SHORT_LIST texts give their pairs. A longer list is worked off in two rounds: each
   round compares all its texts with one pivot and joins those that match into components; a
   list is done when its texts are one component. Texts of lists that the rounds leave in several
   components are compared across these by their smallest values. No list is capped.
4. The union-sketch estimate drops pairs far below the similarity. The others are verified on
   full shingle sets: first each text's best partner, then only pairs still in different components.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.llm.batches import free_memory, map_texts
from leadline.llm.components import components, joined
from leadline.session import stage

KEPT = 96
HEAD = 48
SHORT_LIST = 64
# Rounds over long lists, by what their pivots are.
PIVOTS = ("central", "smallest")
# Smallest values posted for texts that the rounds leave apart; all missed with a chance of 0.2 ** REST.
REST = 8
# Texts of a block, and columns into which the values of its sketches are hashed.
BLOCK, COLUMNS = 512, 4096


def _mixed(x: np.ndarray) -> np.ndarray:
    """A strong mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles_of(text: bytes | None, size: int) -> np.ndarray:
    """Sorted different shingle hashes (63 bits) of a text; see ``sketches`` for the rules."""
    words = text.lower().split() if text else []  # on bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.int64)
    hashed = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    width = min(size, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashed[k : len(words) - width + 1 + k]
    return np.unique((_mixed(out) >> np.uint64(1)).astype(np.int64))


def sketches(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (shingles), digest (of the set) and sketch (its KEPT smallest) per row.

    Words are runs of other characters than ASCII white space, A-Z lower-cased; a shingle is
    ``size`` words in a row, and a text of fewer words is one shingle. Null and empty texts have none.
    """

    def work(texts, part):
        n, digest, sketch = [], [], []
        for text in texts.to_pylist():
            values = shingles_of(text, size)
            n.append(len(values))
            digest.append(_digest(values.tobytes()))
            sketch.append(values[:KEPT])
        return {"n": n, "digest": digest, "sketch": pa.array(sketch, pa.list_(pa.int64()))}

    fields = [
        T.StructField("n", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("sketch", T.ArrayType(T.LongType())),
    ]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(rows, "text", fields, work, ["doc_id"])


def _posted(classes: DataFrame, similarity: float) -> DataFrame:
    """Postings (v, doc, n, weight): of each text's HEAD values the rarest that a similar text cannot all miss."""
    values = classes.select("doc", "n", F.explode(F.slice("sketch", 1, HEAD)).alias("v"))
    shared = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    by_doc = (
        values.join(shared, "v").groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("common"))
    )
    # Two similar texts share at least ``least`` of HEAD values, five deviations below the mean.
    least = math.floor(HEAD * similarity - 5.2 * math.sqrt(HEAD * similarity * (1 - similarity)))
    m = F.least(F.col("n"), F.lit(HEAD))
    # Below this size a partner's sketch holds its whole set, and the exact bound holds.
    whole = math.floor(HEAD * similarity)
    slots = F.when(F.col("n") <= whole, F.floor(F.col("n") * (1 - similarity) + 1e-9) + 1).otherwise(m - least + 1)
    # Values that no other text has are the rarest of all; they take slots without being posted.
    own = m - F.size("common")
    left = F.greatest(F.least(slots - own, F.size("common").cast("long")), F.lit(0)).cast("int")
    weight = F.aggregate("common", F.lit(0).cast("long"), lambda total, x: total + x["df"])
    posts = by_doc.where(left > 0).select(
        "doc", "n", weight.alias("weight"), F.explode(F.slice("common", F.lit(1), left)).alias("x")
    )
    return posts.select("x.v", "doc", "n", "weight")


def _sizes_allow(a: Column, b: Column, similarity: float) -> Column:
    return F.least(a, b) >= F.lit(similarity - 1e-9) * F.greatest(a, b)


def _likely(n_a: Column, n_b: Column, s_a: Column, s_b: Column, similarity: float) -> tuple[Column, Column, Column]:
    """(exact, estimate, likely) of two sketches.

    ``exact``: the sketches are whole sets, and the estimate is the Jaccard similarity itself.
    Otherwise it is the share of common values among the smallest of the union. ``likely`` is
    false where the similarity is ruled out, by five deviations of the estimate.
    """
    exact = F.greatest(n_a, n_b) <= KEPT
    union, common = F.array_union(s_a, s_b), F.array_intersect(s_a, s_b)
    low = F.slice(F.array_sort(union), 1, KEPT)
    estimate = F.when(exact, F.size(common) / F.size(union)).otherwise(F.size(F.array_intersect(common, low)) / F.size(low))
    lowest = similarity - 5 * math.sqrt(similarity * (1 - similarity) / KEPT)
    return exact, estimate, estimate >= F.when(exact, F.lit(similarity - 1e-9)).otherwise(F.lit(lowest))


def _estimated(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that are likely, with ``exact`` and ``estimate``."""
    side = classes.select("doc", "n", "sketch")
    joined = pairs.join(
        side.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a")), "a"
    ).join(side.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b")), "b")
    exact, estimate, likely = _likely(F.col("n_a"), F.col("n_b"), F.col("s_a"), F.col("s_b"), similarity)
    return joined.where(likely).select("a", "b", exact.alias("exact"), estimate.alias("estimate"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b): pairs whose full sets reach the similarity."""
    known = pairs.where("exact").select("a", "b")
    open_pairs = (
        pairs.where(~F.col("exact"))
        .select("a", "b")
        .join(sets.select(F.col("doc").alias("a"), F.col("members").alias("m_a")), "a")
        .join(sets.select(F.col("doc").alias("b"), F.col("members").alias("m_b")), "b")
    )
    schema = T.StructType([open_pairs.schema["a"], open_pairs.schema["b"]])

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("m_a"), batch.column("m_b")):
                one, two = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                met = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(met >= similarity * (len(one) + len(two) - met) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        free_memory()

    return known.union(open_pairs.select("a", "b", "m_a", "m_b").mapInArrow(check, schema))


def _across(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    if labels is None:
        return pairs
    return (
        pairs.join(labels.select(F.col("node").alias("a"), F.col("component").alias("c_a")), "a", "left")
        .join(labels.select(F.col("node").alias("b"), F.col("component").alias("c_b")), "b", "left")
        .where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b"))
        .drop("c_a", "c_b")
    )


def _best_partner(pairs: DataFrame) -> DataFrame:
    """For each text its partner of the highest estimate, the smallest on ties."""
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "exact", "estimate").union(
        pairs.select(F.col("b"), F.col("a"), "exact", "estimate")
    )
    best = ends.groupBy("x").agg(F.min(F.struct(-F.col("estimate"), "y", "exact")).alias("best"))
    return best.select(
        F.least("x", "best.y").alias("a"), F.greatest("x", "best.y").alias("b"), F.col("best.exact").alias("exact")
    ).distinct()


def _full_sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc, members (sorted shingle hashes as bytes) and head (REST smallest) of the classes in ``wanted`` (doc, first_id)."""

    def work(texts, part):
        values = [shingles_of(t, size) for t in texts.to_pylist()]
        members = [x.tobytes() for x in values]
        heads = pa.array([x[:REST] for x in values], pa.list_(pa.int64()))
        return {"doc": [_digest(m) for m in members], "members": members, "head": heads}

    ids = wanted.select(F.col("first_id").alias("id"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi")
    fields = [
        T.StructField("doc", T.BinaryType()),
        T.StructField("members", T.BinaryType()),
        T.StructField("head", T.ArrayType(T.LongType())),
    ]
    # One row per class, also where rows repeat or an id has other texts too.
    made = map_texts(rows, "text", fields, work, [])
    return made.groupBy("doc").agg(F.first("members").alias("members"), F.first("head").alias("head"))


def _digest(members: bytes) -> bytes:
    return hashlib.blake2b(members, digest_size=16).digest()


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    similarity: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) for every row.

    Texts are linked if the Jaccard similarity of their shingle sets is at least ``similarity``;
    a component is what links reach, named by its smallest id. A text without words is linked
    with nothing. A null id is never a link's end: its component is null and it is kept. Rows
    that share an id but not the text are texts of their own. Equal rows get equal results. An
    empty table gives an empty table; extra columns are not read.

    Below, ``doc`` names a class of texts with equal sets, by the digest of the set.
    """
    rows = stage(sketches(docs, size, id_col, text_col))
    linkable = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = stage(
        linkable.groupBy(F.col("digest").alias("doc"), "n").agg(
            F.min("doc_id").alias("first_id"), F.first("sketch").alias("sketch")
        )
    )
    posts = stage(_posted(classes, similarity))
    lists = posts.groupBy("v").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > 1)
    sized = stage(posts.join(lists, "v"))
    short, long = sized.where(F.col("texts") <= SHORT_LIST), sized.where(F.col("texts") > SHORT_LIST).drop("texts")

    def ends(frame: DataFrame, name: str) -> DataFrame:
        return frame.select("v", F.col("doc").alias(name), F.col("n").alias(f"n_{name}"))

    left, right = ends(short, "a"), ends(short, "b")
    fits = _sizes_allow(F.col("n_a"), F.col("n_b"), similarity)
    found = left.join(right, (left["v"] == right["v"]) & (left["a"] < right["b"]) & fits).select("a", "b").distinct()
    pairs = stage(_estimated(found, classes, similarity))

    # Sketches of up to KEPT values are whole sets; other pairs, and long lists, need the texts again.
    wanted = pairs.where(~F.col("exact")).select(F.explode(F.array("a", "b")).alias("doc")).union(long.select("doc")).distinct()
    sets = stage(_full_sets(docs, classes.join(wanted, "doc", "left_semi"), size, id_col, text_col))

    def round_of(pivot: str, labels: DataFrame | None) -> DataFrame:
        return _estimated(_with_pivots(long, labels, pivot, similarity), classes, similarity).drop("estimate")

    has_long = not long.isEmpty()
    first = _best_partner(pairs)
    if has_long:
        first = first.unionByName(round_of(PIVOTS[0], None))
    labels = components(stage(_verified(first, sets, similarity)))
    second = _across(pairs, labels).drop("estimate")
    if has_long:
        second = second.unionByName(round_of(PIVOTS[1], labels))
    labels = joined(labels, stage(_verified(second, sets, similarity)))
    if has_long:
        labels = joined(labels, stage(_rest_of_long_lists(long, sets, labels, similarity)))
    return _labelled(rows, classes, labels)


def _placed(long: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The postings with the component of each text so far."""
    if labels is None:
        return long.withColumn("c", F.col("doc"))
    return long.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("c", F.coalesce("component", "doc")).drop("component")


def _with_pivots(long: DataFrame, labels: DataFrame | None, pivot: str, similarity: float) -> DataFrame:
    """Pairs (a, b): each text of a long list and the list's pivot, where still in different components.

    The central text of a list has the most values that many texts have: few edits of its own.
    """
    now = _placed(long, labels)
    rank = {
        "central": F.struct(-F.col("weight"), "doc", "c", "n"),
        "smallest": F.struct("n", "doc", "c"),
    }[pivot]
    pivots = (
        now.groupBy("v")
        .agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min(rank).alias("p"))
        .where(F.col("low") != F.col("high"))
        .select("v", F.col("p.doc").alias("pivot"), F.col("p.c").alias("pivot_c"), F.col("p.n").alias("pivot_n"))
    )
    near = (F.col("c") != F.col("pivot_c")) & _sizes_allow(F.col("n"), F.col("pivot_n"), similarity)
    tried = now.join(pivots, "v").where(near)
    return tried.select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b")).distinct()


def _rest_of_long_lists(long: DataFrame, sets: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) across components among the texts of long lists that are still mixed.

    These texts post their REST smallest values. A list is dealt into blocks of about BLOCK texts,
    and each pair of blocks is one group that has the full sets of its texts, so no task holds a
    whole list and no pair is moved. A pair is looked at in one list only.
    """
    now = _placed(long, labels)
    mixed = now.groupBy("v").agg(F.min("c").alias("low"), F.max("c").alias("high")).where(F.col("low") != F.col("high"))
    left = now.join(mixed.select("v"), "v", "left_semi").select("doc", "c").distinct()
    texts = stage(left.join(sets, "doc").select("doc", "c", "members", F.explode("head").alias("v")))
    blocks = texts.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = texts.join(blocks, "v").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc", "c", "members")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v, i, j = key
        left, right = rows[rows["own"] == i], rows[rows["own"] == j]
        found = [] if left.empty or right.empty else _links_in_blocks(int(v), left, right, i == j, similarity)
        return pd.DataFrame(found, columns=["a", "b"])

    return dealt.groupBy("v", "i", "j").applyInPandas(compare, "a binary, b binary")


def _counts(sets: list[np.ndarray], columns: int) -> np.ndarray:
    """A row per set: how many of its values fall into each of the hashed columns."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = row * columns + np.concatenate(sets) % columns
    return np.bincount(at, minlength=len(sets) * columns).reshape(-1, columns).astype(np.float32)


def _links_in_blocks(v: int, left: pd.DataFrame, right: pd.DataFrame, same: bool, similarity: float) -> list[tuple]:
    """Pairs (a, b) of two blocks of list ``v`` that link different components."""
    docs_a, docs_b = ([bytes(d) for d in side["doc"]] for side in (left, right))
    sets_a, sets_b = ([np.frombuffer(m, np.int64) for m in side["members"]] for side in (left, right))
    codes, names = pd.factorize(pd.concat([left["c"], right["c"]]).map(bytes))
    c_a, c_b = codes[: len(left)], codes[len(left) :]
    n_a, n_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    # Values that share a column by chance only add to a count, so a count rules out no similar pair.
    low_a, low_b = _counts([s[:KEPT] for s in sets_a], COLUMNS), _counts([s[:KEPT] for s in sets_b], COLUMNS)
    lowest = KEPT * similarity - 5 * math.sqrt(KEPT * similarity * (1 - similarity))
    # Of whole sets at least this many values are common; of longer texts' sketches at least ``lowest``.
    needed = np.minimum(similarity / (1 + similarity) * (n_a[:, None] + n_b[None, :]) - 1e-6, lowest)
    sizes = np.minimum(n_a[:, None], n_b[None, :]) >= (similarity - 1e-9) * np.maximum(n_a[:, None], n_b[None, :])
    open_pairs = (low_a @ low_b.T >= needed) & sizes & (c_a[:, None] != c_b[None, :])
    if same:
        open_pairs = np.triu(open_pairs, 1)
    # A pair with a smaller value in common is looked at in that value's list.
    heads_a, heads_b = ([s[:REST][s[:REST] < v] for s in sets] for sets in (sets_a, sets_b))
    values = np.unique(np.concatenate([*heads_a, *heads_b]))
    if len(values):
        mark_a, mark_b = (_counts([np.searchsorted(values, h) for h in heads], len(values)) for heads in (heads_a, heads_b))
        open_pairs &= (mark_a @ mark_b.T) == 0
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in np.argwhere(open_pairs).tolist():
        p, q = find(c_a[x]), find(c_b[y])
        if p == q:
            continue
        met = len(np.intersect1d(sets_a[x], sets_b[y], assume_unique=True))
        if met >= similarity * (n_a[x] + n_b[y] - met) - 1e-9:
            root[p] = q
            out.append((docs_a[x], docs_b[y]))
    return out


def _labelled(rows: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row with the smallest id of its class's component."""
    grouped = classes.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select(
        "doc", "first_id", F.coalesce("component", "doc").alias("component")
    )
    named = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = grouped.join(named, "component").select(F.col("doc").alias("digest"), "component_id")
    placed = rows.select("doc_id", "n", "digest").join(of_class, "digest", "left")
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    component = F.when(linked, F.col("component_id")).otherwise(F.col("doc_id"))
    return placed.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
