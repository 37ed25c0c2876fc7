"""Registered queries of the llm operators: thin forms that derive the result columns."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline.llm import (
    decontamination,
    licenses,
    line_dedup,
    mixing,
    near_dedup,
    packing,
    periodic_runs,
    quality,
    quality_rules,
    resampling,
    token_files,
    token_rollup,
    toxicity,
)
from leadline.session import stage, staging_dir
from leadline.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


@query(
    "op1_decontamination",
    r"""
    WITH dw AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    iw AS (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    windows AS (
      SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
      FROM iw, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT n FROM windows),
    grams AS (
      SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
      FROM dw, sizes, unnest(range(1, greatest(len(w) - n, -1) + 2)) AS t(i)),
    met AS (SELECT doc_id, i, g.n, item_id FROM grams g JOIN windows v ON g.n = v.n AND g.s = v.s),
    hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY 1),
    ids AS (
      SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM met) GROUP BY 1)
    SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)
    """,
)
def decontamination_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.scan(docs, read_table(spark, folder, "benchmark"), keep=["doc_id"])
    n_hit = decontamination.hit_words()
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query("op2_toxicity")
def toxicity_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.judge(docs, read_table(spark, folder, "labels"))


@query("op3_quality")
def quality_query(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query("op4_token_files")
def token_files_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    path = f"{staging_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WORDS = (
    "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)


@query(
    "op5_licenses",
    rf"""
    WITH lines AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
      FROM documents),
    worded AS (
      SELECT doc_id, pos, {_WORDS.format("line")} AS w FROM lines),
    runs AS (
      SELECT *, sum((len(w) = 0)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM worded),
    filled AS (SELECT * FROM runs WHERE len(w) > 0),
    paragraphs AS (
      SELECT doc_id, run, count(*) AS n, flatten(list(w ORDER BY pos)) AS w FROM filled GROUP BY doc_id, run),
    units AS (
      SELECT doc_id, w FROM filled
      UNION ALL SELECT doc_id, w FROM paragraphs WHERE n > 1
      UNION ALL SELECT doc_id, flatten(list(w ORDER BY run)) FROM paragraphs GROUP BY doc_id HAVING count(*) > 1),
    grams AS (
      SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM units WHERE len(w) > 1),
    templates AS (
      SELECT licence, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
      FROM (SELECT licence, {_WORDS.format("body")} AS w
            FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in licenses.TEMPLATES.items())}) AS v(licence, body))),
    scored AS (
      SELECT doc_id, licence, max(2.0 * len(list_intersect(u.g, t.g)) / (len(u.g) + len(t.g))) AS dice
      FROM grams u JOIN templates t
        ON len(u.g) >= 0.8 / 1.2 * len(t.g) - 1e-9 AND len(u.g) <= len(t.g) * 1.2 / 0.8 + 1e-9
      GROUP BY doc_id, licence)
    SELECT d.doc_id, count(licence) AS n_licences, coalesce(string_agg(licence, ',' ORDER BY licence), '') AS licences,
      round(coalesce(max(dice), 0)::DOUBLE, 6) AS best_dice
    FROM documents d LEFT JOIN (SELECT * FROM scored WHERE dice >= 0.8) s USING (doc_id) GROUP BY d.doc_id
    """,
)
def licenses_query(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(read_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_licences"),
        F.array_join("matches.licence", ",").alias("licences"),
        F.round(F.coalesce(F.array_max("matches.dice"), F.lit(0.0)), 6).alias("best_dice"),
    )


@query(
    "op6_line_dedup",
    r"""
    WITH raw AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
      FROM documents),
    keyed AS (
      SELECT doc_id, pos, line,
        translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM raw),
    frequent AS (
      SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    marked AS (
      SELECT k.doc_id, pos, line, f.key IS NOT NULL AND k.doc_id <> f.top AS gone
      FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def line_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


# Token rules of the two tokenizer versions that the rollup counts.
WORD_1 = r"[^\x20\x09-\x0D]+"
WORD_2 = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x20\x09-\x0D\x{80}-\x{10FFFF}]"


@query(
    "op7_token_counts",
    rf"""
    WITH counts AS (
      SELECT *, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id,
        len(regexp_extract_all(coalesce(text, ''), '{WORD_1}')) AS n_1,
        len(regexp_extract_all(coalesce(text, ''), '{WORD_2}')) AS n_2
      FROM documents)
    SELECT 1::BIGINT AS batch, source, lang, 'word-1' AS tokenizer_version, count(*) AS docs, sum(n_1)::BIGINT AS tokens
    FROM counts GROUP BY ALL
    UNION ALL
    SELECT 2::BIGINT, source, lang, 'word-1', count(*), sum(n_1)::BIGINT FROM counts WHERE doc_id = first_id GROUP BY ALL
    UNION ALL
    SELECT 3::BIGINT, source, lang, 'word-2', count(*), sum(n_2)::BIGINT FROM counts WHERE doc_id = first_id GROUP BY ALL
    """,
)
def token_counts_query(spark: SparkSession, folder: str) -> DataFrame:
    """All documents inserted, exact copies deleted, and every document left revised to the new tokenizer version.

    Returns the totals after each of the three batches, so that the counts of both versions show.
    """
    text = F.coalesce("text", F.lit(""))
    counts = stage(
        read_table(spark, folder, "documents").select(
            "doc_id",
            "source",
            "lang",
            F.sha2(text, 256).alias("digest"),
            token_rollup.counted(text, WORD_1).alias("n_1"),
            token_rollup.counted(text, WORD_2).alias("n_2"),
        )
    )
    first = counts.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    placed = stage(counts.join(first, "digest").withColumn("copy", F.col("doc_id") != F.col("first_id")))

    def events(op: str, version: str, count: str) -> DataFrame:
        return placed.select(
            F.lit(op).alias("op"), "doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"),
            F.col(count).alias("n_tokens"), "copy",
        )

    rollup = token_rollup.Rollup(spark, f"{staging_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit(1, events("insert", "word-1", "n_1"))
    deleted = events("delete", "word-1", "n_1").where("copy")
    rollup.commit(2, deleted)
    rollup.commit(2, deleted)  # a repeated commit changes nothing
    rollup.commit(3, events("revise", "word-2", "n_2").where("NOT copy"))
    after = [rollup.totals(batch).select(F.lit(batch).cast("long").alias("batch"), "*") for batch in (1, 2, 3)]
    return after[0].unionByName(after[1]).unionByName(after[2])


def _quality_rules_sql() -> str:
    """The rules of ``quality_rules.judge`` in SQL."""
    q = quality_rules
    metrics = " UNION ALL ".join(
        f"SELECT doc_id, lang, source, base_failed, '{name}' AS metric, {m['low']} AS has_low,"
        f" CASE WHEN {m['over'][0]} * 1000 // {m['over'][1]} > 0"
        f" THEN floor(ln({m['over'][0]} * 1000 // {m['over'][1]}) / {math.log(q.GROWTH)!r})::INT END AS bucket FROM counts"
        for name, m in q.METRICS.items()
    )

    two_sided = ", ".join(f"'{name}'" for name, m in q.METRICS.items() if m["low"])

    def bounds(name: str, keys: str) -> str:
        by = f"{keys}, metric" if keys else "metric"
        return f"""
    {name}_sum AS (SELECT {by}, bucket, sum(n) AS n FROM sketch GROUP BY ALL),
    {name}_run AS (
      SELECT {by}, bucket, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS total
      FROM {name}_sum),
    {name}_at AS (
      SELECT {by}, max(total) AS total,
        min(bucket) FILTER (upto * 100 >= total * 25) AS lo,
        min(bucket) FILTER (upto * 100 >= total * 50) AS mid,
        min(bucket) FILTER (upto * 100 >= total * 75) AS hi
      FROM {name}_run GROUP BY ALL),
    {name} AS (
      SELECT *, {q.SPREAD} * greatest(
        CASE WHEN metric IN ({two_sided}) THEN (hi - lo + 1) // 2 ELSE least(hi - mid, mid - lo) END, 1) AS reach FROM {name}_at)"""

    def wider(value: str) -> str:
        return f"CASE WHEN l.total >= {q.MIN_VALUES} THEN {value.format(t='l')} ELSE {value.format(t='e')} END"

    def level(value: str) -> str:
        return f"CASE WHEN o.total >= {q.MIN_VALUES} THEN {value.format(t='o')} ELSE {wider(value)} END"

    return rf"""
    WITH base AS (
      SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
      FROM documents),
    grams AS (
      SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM base, unnest(range(1, greatest(len(w) - 6, 1))) AS t(i)),
    repeated AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM grams) WHERE c > 1),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM repeated) GROUP BY 1),
    lines AS (
      SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM base)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
    counts AS (
      SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n, 0) AS n_lines,
        coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        len(w) < 20 OR 100 * coalesce(c.n, 0) > 30 * len(w) AS base_failed
      FROM base LEFT JOIN covered c USING (doc_id) LEFT JOIN lines l USING (doc_id)),
    metrics AS ({metrics}),
    sketch AS (
      SELECT lang, source, metric, bucket, count(*) AS n FROM metrics
      WHERE NOT base_failed AND bucket IS NOT NULL GROUP BY ALL),
    {bounds("own", "lang, source")},
    {bounds("by_lang", "lang")},
    {bounds("overall", "")},
    chosen AS (
      SELECT m.doc_id, m.bucket, m.has_low, {level("{t}.mid - {t}.reach")} AS lower,
        CASE WHEN g.texts >= {q.MIN_GROUP} AND o.total * {q.RARE} < g.texts THEN {wider("{t}.lo")}
          ELSE {level("{t}.mid + {t}.reach")} END AS upper
      FROM metrics m
        LEFT JOIN (SELECT lang, source, count(*) AS texts FROM counts WHERE NOT base_failed GROUP BY ALL) g
          ON m.lang IS NOT DISTINCT FROM g.lang AND m.source IS NOT DISTINCT FROM g.source
        LEFT JOIN own o ON m.lang IS NOT DISTINCT FROM o.lang AND m.source IS NOT DISTINCT FROM o.source AND m.metric = o.metric
        LEFT JOIN by_lang l ON m.lang IS NOT DISTINCT FROM l.lang AND m.metric = l.metric
        LEFT JOIN overall e ON m.metric = e.metric WHERE NOT m.base_failed),
    failed AS (SELECT DISTINCT doc_id FROM chosen WHERE bucket > upper OR has_low AND bucket < lower)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND f.doc_id IS NULL AS kept
    FROM counts LEFT JOIN failed f USING (doc_id)
    """


@query("op8_quality_rules", _quality_rules_sql())
def quality_rules_query(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, folder, "documents"))


@query("op9_packing")
def packing_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group"
    )


@query("op10_near_dedup")
def near_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, folder, "documents").select("doc_id", "text"), size=4)


def _permuted_sql(rows: str, x: str, n: str, key: str, name: str) -> str:
    """``rows`` with the column ``name``: ``mixing.permuted`` of x in 0 .. n - 1, one subquery per round."""
    prime = mixing.PRIME

    def digits(begin: int, size: int) -> str:
        return f"('0x' || substr(digest_, {begin}, {size}))::BIGINT"

    sql = f"SELECT *, {x} AS cur, {n} AS n_, {key} AS key_ FROM {rows}"
    for r in range(1, mixing.ROUNDS + 1):
        sql = f"SELECT *, md5(key_ || ':{r}') AS digest_ FROM ({sql})"
        sql = f"SELECT *, CASE WHEN n_ > 1 THEN (({digits(1, 15)} % n_ - cur) % n_ + n_) % n_ ELSE cur END AS other FROM ({sql})"
        a, b, pair = f"({digits(16, 8)} % {prime - 1} + 1)", f"{digits(24, 8)} % {prime}", "greatest(cur, other)"
        mixed = f"({a} * ({pair} % {prime}) + {b} + {pair} // {prime}) % {prime}"
        sql = (
            f"SELECT * EXCLUDE (cur, other, digest_), CASE WHEN n_ > 1 AND {mixed} * 2 > {prime} THEN other ELSE cur END AS cur"
            f" FROM ({sql})"
        )
    return f"SELECT * EXCLUDE (cur, n_, key_), cur AS {name} FROM ({sql})"


def _mixing_sql() -> str:
    m, size = mixing, mixing.BLOCK_WORDS
    weights = ", ".join(f"{w}::DOUBLE" for w in m.WEIGHTS)
    unfinished = _permuted_sql(
        "turns", "turn", "blocks - 1", f"'{m.SEED}:block:' || no || ':' || epochs", "moved"
    )
    return rf"""
    WITH sized AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
    sources AS (
      SELECT source, sum(size)::BIGINT AS total, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM sized GROUP BY source),
    weighed AS (
      SELECT *, [{weights}][no % {len(m.WEIGHTS)} + 1] AS weight, {m.MOST}::DOUBLE * total AS cap,
        {m.SHARE}::DOUBLE * sum(total) OVER () AS whole FROM sources),
    levels AS (
      SELECT *, cap / weight AS ratio,
        (whole - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM weighed WINDOW b AS (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    goals AS (
      SELECT *, least(cap, coalesce(
        (SELECT level FROM levels WHERE ratio > level ORDER BY ratio, no LIMIT 1) * weight, cap)) AS target FROM levels),
    quotas AS (
      SELECT *, floor(target)::BIGINT AS words, ceil(total / {size})::BIGINT AS blocks,
        CASE WHEN total > 0 THEN floor(target)::BIGINT // total ELSE 0 END AS epochs FROM goals),
    turns AS (
      SELECT no, epochs, blocks, turn, least({size}, words - epochs * total - turn * {size}) AS part
      FROM quotas, unnest(range(0, ceil((words - epochs * total) / {size})::BIGINT)) AS t(turn)),
    unfinished AS (
      SELECT no, part, CASE WHEN turn = blocks - 1 THEN turn ELSE moved END AS block FROM ({unfinished})),
    placed AS (
      SELECT d.*, no, total, target, epochs,
        sum(size) OVER (PARTITION BY no ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS pos,
        row_number() OVER () AS row_no
      FROM sized d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source),
    parts AS (
      SELECT row_no, sum(greatest(least(pos + size, u.block * {size} + part) - greatest(pos, u.block * {size}), 0)) AS more
      FROM (SELECT *, unnest(range(pos // {size}, (pos + size - 1) // {size} + 1)) AS block FROM placed WHERE size > 0) p
      JOIN unfinished u ON p.no = u.no AND p.block = u.block GROUP BY row_no)
    SELECT doc_id, size, total AS source_size, target, (epochs * size + coalesce(more, 0))::BIGINT AS taken
    FROM placed LEFT JOIN parts USING (row_no)
    """


@query("op11_mixing", _mixing_sql())
def mixing_query(spark: SparkSession, folder: str) -> DataFrame:
    made = mixing.mix(read_table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixing.taken_words(made).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, bit by bit."""
    octets = f"list_transform(range(0, strlen({text})), lambda k: ('0x' || hex(encode({text}))[2 * k + 1:2 * k + 2])::BIGINT)"
    bits = f"flatten(list_transform({octets}, lambda b: [(b >> i) & 1 for i in range(0, 8)]))"
    step = "xor(c >> 1, 3988292384 * (xor(c, b) & 1))"
    return f"xor(4294967295, list_reduce({bits}, lambda c, b: {step}, 4294967295))"


def _resampling_sql() -> str:
    q = resampling
    grams = " UNION ALL ".join(
        f"SELECT kind, id, array_to_string(w[i:i + {n - 1}], ' ') AS f FROM texts, unnest(range(1, len(w) - {n} + 2)) AS t(i)"
        f" WHERE len(w) >= {n}"
        for n in range(1, q.LONGEST + 1)
    )
    return rf"""
    WITH texts AS (
      SELECT 'raw' AS kind, doc_id AS id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
      UNION ALL SELECT 'target', item_id, {_WORDS.format("coalesce(text, '')")} FROM benchmark),
    features AS ({grams}),
    hashed AS (SELECT f, {_crc32_sql("f")} % {q.BUCKETS} AS bucket FROM (SELECT DISTINCT f FROM features)),
    held AS (SELECT kind, id, bucket, count(*) AS n FROM features JOIN hashed USING (f) GROUP BY ALL),
    counts AS (
      SELECT bucket, coalesce(sum(n) FILTER (kind = 'raw'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 'target'), 0)::DOUBLE AS t
      FROM held GROUP BY bucket),
    gains AS (
      SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + {q.BUCKETS}) / ((s + 1) * (sum(t) OVER () + {q.BUCKETS}))))::BIGINT AS gain
      FROM counts),
    weights AS (
      SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM held JOIN gains USING (bucket)
      WHERE kind = 'raw' GROUP BY id),
    scored AS (
      SELECT t.id AS doc_id, len(w) >= {q.MIN_WORDS} AS enough, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{q.SEED}:' || t.id), 1, 8))::BIGINT + 0.5::DOUBLE)
          / 4294967296::DOUBLE)))::BIGINT AS score
      FROM texts t LEFT JOIN weights v ON t.id = v.id WHERE kind = 'raw'),
    ranked AS (
      SELECT *, row_number() OVER (ORDER BY enough DESC, score DESC, doc_id) AS place, {q.DRAW_PERCENT} * count(*) FILTER (enough) OVER () // 100 AS drawn
      FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM ranked
    """


@query("op12_resampling", _resampling_sql())
def resampling_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    drawn = resampling.resample(docs, read_table(spark, folder, "benchmark"), keep=["doc_id"])
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def _looped(text: Column, identity: Column) -> Column:
    """The texts that op13 judges: of a tenth of the documents, the later words are a loop of their own."""
    h = F.crc32(identity.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def loop(words: Column) -> Column:
        n = F.size(words)
        begin = (g % n).cast("int")
        period = (1 + F.floor((n - begin) / (3 + g % 8))).cast("int")
        rounds = F.ceil((n - begin) / period).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(words, begin + 1, period), rounds)), F.lit(1), n - begin)
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), begin), tail), " ")).otherwise("")

    # Inside a lambda the words are split once, however often they are named.
    words = F.array(F.regexp_extract_all(text, F.lit(WORD_1), F.lit(0)))
    return F.when(h % 10 == 0, F.element_at(F.transform(words, loop), 1)).otherwise(text)


def _periodic_runs_sql() -> str:
    q = periodic_runs
    width = q.least_lcp(q.MIN_LENGTH, q.MIN_PERIODS)
    return rf"""
    WITH split AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD_1}') AS w, {_crc32_sql("doc_id::VARCHAR")} AS h FROM documents),
    looped AS (
      SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split),
    base AS (
      SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, len(w)),
        lambda i: w[CASE WHEN i >= a THEN a + (i - a) % (1 + (len(w) - a) // (3 + (h // 10) % 8)) ELSE i END + 1]) END AS w
      FROM looped),
    grams AS (
      SELECT doc_id, len(w) AS n, i, array_to_string(w[i + 1:i + {width}], ' ') AS gram
      FROM base, unnest(range(0, len(w) - {width} + 1)) AS t(i)),
    pairs AS (
      SELECT a.doc_id, a.i, b.i - a.i AS d FROM grams a JOIN grams b
        ON a.doc_id = b.doc_id AND a.gram = b.gram AND a.i < b.i AND (b.i - a.i) * {q.MIN_PERIODS} <= a.n),
    stretches AS (
      SELECT doc_id, d, min(i) AS start, count(*) + {width - 1} + d AS length
      FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS part FROM pairs) GROUP BY doc_id, d, part),
    periodic AS (
      SELECT doc_id, start, length, d AS period FROM stretches WHERE length >= greatest({q.MIN_LENGTH}, {q.MIN_PERIODS} * d)),
    runs AS (
      SELECT * FROM periodic c WHERE NOT EXISTS (
        SELECT 1 FROM periodic o WHERE o.doc_id = c.doc_id AND o.period < c.period AND o.start <= c.start
          AND o.start + o.length >= c.start + c.length)),
    listed AS (
      SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
      FROM runs GROUP BY doc_id),
    best AS (
      SELECT * FROM runs QUALIFY row_number() OVER (
        PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
    dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
    kept AS (
      SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS body
      FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM base) t ANTI JOIN dropped d
        ON t.doc_id = d.doc_id AND t.i = d.i GROUP BY t.doc_id)
    SELECT b.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
      sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
    FROM base b LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
    """


@query("op13_periodic_runs", _periodic_runs_sql())
def periodic_runs_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", _looped(F.col("text"), F.col("doc_id")).alias("text"))
    return periodic_runs.digests(periodic_runs.find_runs(docs))
