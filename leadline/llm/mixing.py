r"""Mixing sources to target weights, with DataFrame functions only.

1. Sizes. A text's size is its number of words ``[^\x20\x09-\x0D]+``. Each source's documents are laid end
   to end, in the order of a hash of their ids, and cut into blocks of ``block_words`` words. Short documents
   share blocks, long ones span several.
2. Targets. The mix holds ``share`` times all words. Sources share it by weight; no target is above ``most``
   times its source, and what is over goes to the others by weight.
3. Counts. Every output shard has ``shard_slots`` slots, each a multinomial draw of a source. The draws of a
   source come near its target, not onto it; so a source's draws are numbered by a pseudorandom
   permutation, those beyond its target are handed to the sources that lack some, and the last slot of a
   source is cut. The mix then holds each target to the word.
4. Blocks. A source's n-th slot takes block n mod B of epoch n div B, mapped through a
   pseudorandom permutation of the source and epoch. So a block is met once per epoch, and words are taken
   at most ``most`` times (rounded up). Slots and blocks meet in an equi-join on (source, block).

All draws are hashes of the seed and of numbers, so a rerun gives the same mix.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadline.operators.ranking import running_start
from leadline.session import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCK_WORDS = 256
SHARD_SLOTS = 4096
SEED = 42
# Rounds of the swap-or-not shuffle.
ROUNDS = 16
# Modulus of the hash inside the shuffle; products of two numbers below it fit a long.
PRIME = (1 << 31) - 1
# Documents per chunk of a source, about; it sets the work of a task and never changes the result.
CHUNK_DOCS = 5_000
# Slots that one task draws.
TASK_SLOTS = 1 << 20


def round_keys(n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """What ``permuted`` needs to know of a permutation of 0 .. n - 1, from the MD5 of its key and round."""

    def one(r: Column) -> Column:
        digest = F.md5(F.concat_ws(":", key, r))
        k, a, b = (F.conv(F.substring(digest, at, size), 16, 10).cast("long") for at, size in ((1, 15), (16, 8), (24, 8)))
        return F.struct(F.pmod(k, n).alias("k"), (F.pmod(a, F.lit(PRIME - 1)) + 1).alias("a"), F.pmod(b, F.lit(PRIME)).alias("b"))

    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.lit(rounds)), one))


def permuted(x: Column, n: Column, keys: Column) -> Column:
    """Where the pseudorandom permutation of 0 .. n - 1 with these round keys sends ``x``.

    A swap-or-not shuffle: in each round x and its partner k - x (mod n) change places or not, as a
    pairwise independent hash of the pair says. It needs no table and no power of two, and holds for every n.
    """

    def swap(at: Column, step: Column) -> Column:
        partner = F.pmod(step["k"] - at, n)
        pair = F.greatest(at, partner)
        mixed = F.pmod(step["a"] * F.pmod(pair, F.lit(PRIME)) + step["b"] + F.floor(pair / F.lit(PRIME)), F.lit(PRIME))
        return F.when(mixed * 2 > PRIME, partner).otherwise(at)

    return F.when(n > 1, F.aggregate(keys, x, swap)).otherwise(x)


@dataclass
class Mix:
    """``documents``: one row per row of the input: id, size, source, source_no, position (its first word
    in its source). ``sources``: one row per source: source, source_no, size, target, words (the target in
    whole words), blocks, slots. ``pieces``: the mix itself, see ``mix``."""

    documents: DataFrame
    sources: DataFrame
    pieces: DataFrame


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source and size of each document; a null text has size 0."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))


def targets(
    rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per source of ``sized`` rows, with its target and what follows from it.

    Sources by code point, null last, have the weights in turn. With sources by rising (cap / weight),
    those at their cap are a first part of them: each of these has a cap below its part of what
    the ones before it leave. The others share the rest by weight.
    """
    source = rows.groupBy("source").agg(F.sum("size").alias("size"))
    everything = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    source = source.withColumn("source_no", (F.row_number().over(everything) - 1).cast("long"))
    source = source.withColumns(
        {
            "weight": F.element_at(cycle, (F.col("source_no") % len(weights) + 1).cast("int")),
            "cap": F.col("size") * F.lit(float(most)),
            "total": F.sum("size").over(W.partitionBy()) * F.lit(float(share)),
        }
    ).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = W.orderBy("ratio", "source_no").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    source = source.withColumn("level", left / weight_left)
    first_open = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "source_no", "level"))).over(W.partitionBy())
    goal = F.least(F.col("cap"), F.coalesce(first_open["level"] * F.col("weight"), F.col("cap")))
    source = source.withColumn("target", goal).withColumn("words", F.floor("target").cast("long"))
    epochs = F.expr("CASE WHEN size > 0 THEN words div size ELSE 0 END")
    source = source.withColumns(
        {"epochs": epochs, "blocks": F.ceil(F.col("size") / F.lit(block_words)).cast("long")}
    ).withColumn("rest", F.col("words") - F.col("epochs") * F.col("size"))
    slots = F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / F.lit(block_words))
    return source.select("source", "source_no", "weight", "size", "target", "words", "blocks", slots.cast("long").alias("slots"))


def _owners(points: DataFrame, spans: DataFrame, at: str, total: int, n_spans: int) -> DataFrame:
    """``points`` joined to the row of ``spans`` whose [low, high) holds the number ``at`` in 0 .. total - 1.

    An equi-join on stretches of the range. The points are evenly spread over them, so none is hot.
    """
    width = max(total // (4 * n_spans), 1)
    cut = spans.where("high > low").withColumn(
        "stretch", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}")))
    )
    held = (F.col(at) >= F.col("low")) & (F.col(at) < F.col("high"))
    return points.withColumn("stretch", F.expr(f"{at} div {width}")).join(cut, "stretch").where(held).drop("stretch", "low", "high")


def _before(value: Column, order: str) -> Column:
    """Sum of ``value`` over the rows before, in a table with one row per source."""
    return F.coalesce(F.sum(value).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def _drawn(spark, source: DataFrame, n_slots: int, n_sources: int, shard_slots: int, seed: int) -> DataFrame:
    """Slots of all shards: shard, slot, source_no and n, the slot's number inside its source."""
    spans = source.select("source_no", _before(F.col("slots"), "source_no").alias("low"), "slots")
    spans = spans.select("source_no", "low", (F.col("low") + F.col("slots")).alias("high"))
    draws = spark.range(0, n_slots, 1, max(n_slots // TASK_SLOTS, 1)).select(
        F.expr(f"id div {shard_slots}").alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(n_slots)).alias("draw"),
    )
    counts = stage(_owners(draws, spans, "draw", n_slots, n_sources).groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("n")))

    numbered = running_start(counts.withColumn("part", F.expr("shard div 4096")), ["source_no"], "part", ["shard"], "n", "first")
    own = W.partitionBy("shard")
    inside = own.orderBy("source_no").rowsBetween(W.unboundedPreceding, -1)
    numbered = numbered.withColumns(
        {"slot_first": F.coalesce(F.sum("n").over(inside), F.lit(0)), "in_shard": F.sum("n").over(own)}
    ).withColumn("shard_keys", round_keys(F.col("in_shard"), F.concat_ws(":", F.lit(seed), F.lit("shard"), F.col("shard")), 8))

    # What each source drew against what its target needs.
    drawn = source.join(counts.groupBy("source_no").agg(F.sum("n").alias("drawn")), "source_no", "left").na.fill(0, ["drawn"])
    over = F.greatest(F.col("drawn") - F.col("slots"), F.lit(0))
    lack = F.greatest(F.col("slots") - F.col("drawn"), F.lit(0))
    key = F.concat_ws(":", F.lit(seed), F.lit("settle"), F.col("source_no"))
    settled = stage(
        drawn.select(
            "source_no", "slots", "drawn", _before(over, "source_no").alias("over_first"),
            _before(lack, "source_no").alias("low"), lack.alias("lack"),
            F.when(over > 0, round_keys(F.col("drawn"), key)).alias("settle_keys"),
        )
    )
    lacking = settled.select(
        F.col("source_no").alias("to_no"), F.col("drawn").alias("to_drawn"), F.col("low").alias("lack_first"),
        "low", (F.col("low") + F.col("lack")).alias("high"),
    )
    n_moved = settled.agg(F.sum("lack")).first()[0] or 0

    # A row of counts becomes up to shard_slots rows, so the few rows are first dealt out to tasks.
    tasks = max(n_slots // TASK_SLOTS, spark.sparkContext.defaultParallelism)
    slots = (
        numbered.join(settled.select("source_no", "slots", "drawn", "over_first", "settle_keys"), "source_no")
        .repartition(tasks, "shard", "source_no")
        .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    )
    draw_no = F.col("first") + F.col("k")
    slots = slots.select(
        "shard",
        # The sources of a shard are mixed inside it.
        permuted(F.col("slot_first") + F.col("k"), F.col("in_shard"), F.col("shard_keys")).alias("slot"),
        "source_no", "slots", "over_first",
        F.when(F.col("drawn") > F.col("slots"), permuted(draw_no, F.col("drawn"), F.col("settle_keys"))).otherwise(draw_no).alias("n"),
    )
    kept = slots.where(F.col("n") < F.col("slots")).select("shard", "slot", "source_no", "n")
    if not n_moved:
        return kept
    moved = slots.where(F.col("n") >= F.col("slots")).select(
        "shard", "slot", (F.col("over_first") + F.col("n") - F.col("slots")).alias("freed")
    )
    moved = _owners(moved, lacking, "freed", n_moved, n_sources).select(
        "shard", "slot", F.col("to_no").alias("source_no"), (F.col("to_drawn") + F.col("freed") - F.col("lack_first")).alias("n")
    )
    return kept.unionByName(moved)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
) -> Mix:
    """The mix of ``docs``. Its pieces: shard, slot (its place in the shard), at (words of the slot before the
    piece), source_no, block, position (key of the document's row, with source_no), id, start and length (the
    words of the document that the piece takes).

    * Null, empty and blank texts have size 0: they are in ``documents`` and in no piece.
    * A null source is a source of its own, the last one. A null id is an id like any other.
    * Rows that share an id, equal rows too, are documents of their own.
    * An empty table, or one without words, gives an empty mix; its targets are 0.
    * Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    rows = stage(sized(docs, id_col, text_col, source_col))
    source = stage(targets(rows, weights, share, most, block_words))
    n_slots, n_sources = source.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count(F.lit(1))).first()
    n_docs = rows.count()

    digits = 0
    while CHUNK_DOCS << 4 * digits < n_docs:
        digits += 1
    same = F.col("r.source").eqNullSafe(F.col("s.source"))
    hashed_id = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    placed = (
        rows.alias("r").join(source.select("source", "source_no").alias("s"), same)
        .select("r.*", "source_no", hashed_id.alias("order"))
        .withColumn("chunk", F.substring("order", 1, digits))
    )
    documents = stage(running_start(placed, ["source_no"], "chunk", ["order", "id", "size"], "size", "position").drop("order", "chunk"))

    last = F.col("position") + F.col("size") - 1
    cuts = documents.where("size > 0").select(
        "source_no", "position", "id", "size",
        F.explode(F.sequence(F.expr(f"position div {block_words}"), F.expr(f"(position + size - 1) div {block_words}"))).alias("block"),
    )
    begin = F.greatest(F.col("position"), F.col("block") * block_words)
    end = F.least(last + 1, (F.col("block") + 1) * block_words)
    cuts = cuts.select(
        "source_no", "block", "position", "id", (begin - F.col("position")).alias("start"),
        (end - begin).alias("length"), (begin - F.col("block") * block_words).alias("at"),
    )
    if not n_slots:
        nothing = cuts.withColumns({"shard": F.lit(0).cast("long"), "slot": F.lit(0).cast("long")}).limit(0)
        return Mix(documents, source, nothing)

    # A source's last block may be short; it closes each epoch, so that the words before any slot are known.
    full = F.col("blocks") - 1
    key = F.concat_ws(":", F.lit(seed), F.lit("block"), F.col("source_no"), F.col("epoch"))
    epochs = (
        source.where("slots > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(slots - 1) div blocks"))))
        .select("source_no", "epoch", "size", "words", "blocks", round_keys(full, key).alias("block_keys"))
    )
    slots = (
        _drawn(spark, source, n_slots, n_sources, shard_slots, seed)
        .join(source.select("source_no", "blocks"), "source_no")
        .select("shard", "slot", "source_no", F.expr("n div blocks").alias("epoch"), F.expr("n % blocks").alias("turn"))
        .join(epochs, ["source_no", "epoch"])
    )
    block = F.when(F.col("turn") == full, F.col("turn")).otherwise(permuted(F.col("turn"), full, F.col("block_keys")))
    taken = F.least(F.lit(block_words), F.col("words") - F.col("epoch") * F.col("size") - F.col("turn") * block_words)
    slots = slots.select("shard", "slot", "source_no", block.alias("block"), taken.alias("taken"))
    pieces = slots.join(cuts, ["source_no", "block"]).where(F.col("at") < F.col("taken"))
    pieces = pieces.withColumn("length", F.least(F.col("length"), F.col("taken") - F.col("at"))).drop("taken")
    return Mix(documents, source, pieces)


def texts(made: Mix, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix as text: shard, slot and the words of each slot, joined by spaces.

    Needs ids that are unique and not null. Words are cut out per piece before the join of a slot.
    """
    words = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)).alias("all_words"))
    part = F.array_join(F.slice("all_words", F.col("start").cast("int") + 1, F.col("length").cast("int")), " ")
    cut = made.pieces.join(words, "id").select("shard", "slot", "at", part.alias("words"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda p: p["words"]), " ")
    return cut.groupBy("shard", "slot").agg(joined.alias("text"))


def taken_words(made: Mix) -> DataFrame:
    """The mix's documents with their source's size and target, and the words that the mix takes of them."""
    taken = made.pieces.groupBy("source_no", "position").agg(F.sum("length").alias("taken"))
    # Documents without words share a position with the one after them.
    rows = made.documents.join(taken, ["source_no", "position"], "left").join(
        made.sources.select("source_no", F.col("size").alias("source_size"), "target"), "source_no"
    )
    count = F.when(F.col("size") > 0, F.coalesce(F.col("taken"), F.lit(0))).otherwise(0)
    return rows.select("id", "source", "size", "source_size", "target", count.cast("long").alias("taken"))
