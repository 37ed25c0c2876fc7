"""Source mixing, importance resampling and periodic runs against brute force, on small odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadline.llm import mixing, periodic_runs, resampling
from leadline.llm.queries import _looped

LONG = " ".join(f"w{k % 977}" for k in range(30_000))
ODD = [
    None, "", " \t\n", "one", "One line\nof text", "  x  y z \x0b w ", LONG, "la " * 5000, "one", "one",
    "a b c d e f g h i j k l m n o p q r s t u v w", "A-b'C! é世 D" * 30,
]
SCHEMA = "doc_id long, text string, source string, start string, N_WORDS int, rank string, size int, block string, taken double, length string"


def rows_of(texts, sources):
    return [(k, t, sources[k % len(sources)], "s", k, "r", k, "b", 0.5, "l") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts with a null source, repeated rows, null ids and extra columns named like results and helpers."""
    rows = rows_of(ODD * 2, ["hot", "hot", None, "b", "é"])
    rows += [rows[4], rows[6], (None, "a null id with words", "b", *rows[0][3:]), (None, None, None, *rows[0][3:])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


# --- mixing -----------------------------------------------------------------------------


def shared_out(sizes, weights, share, most):
    """Targets by handing excess on until none is left."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] <= left * weight[s] / whole}
        if not full:
            return out | {s: left * weight[s] / whole for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def permuted_plain(x, n, key, rounds=mixing.ROUNDS):
    if n <= 1:
        return x
    prime = mixing.PRIME
    for r in range(1, rounds + 1):
        digest = hashlib.md5(f"{key}:{r}".encode()).hexdigest()
        other = (int(digest[:15], 16) - x) % n
        a, b, pair = int(digest[15:23], 16) % (prime - 1) + 1, int(digest[23:31], 16) % prime, max(x, other)
        if (a * (pair % prime) + b + pair // prime) % prime * 2 > prime:
            x = other
    return x


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_permutation_meets_every_number_once(spark, n):
    x = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n), mixing.round_keys(F.lit(n), F.lit("k"))).alias("to")).collect()
    assert sorted(r["to"] for r in x) == list(range(n))
    assert all(r["to"] == permuted_plain(r["id"], n, "k") for r in x)


@pytest.mark.parametrize("block_words, shard_slots", [(3, 8), (64, 5), (100_000, 2)])
def test_mix_meets_targets_and_takes_blocks_by_index(docs, block_words, shard_slots):
    made = mixing.mix(docs, block_words=block_words, shard_slots=shard_slots)
    rows = docs.collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(spaced(r["text"]))
    goals = shared_out(sizes, mixing.WEIGHTS, mixing.SHARE, mixing.MOST)
    sources = {r["source"]: r for r in made.sources.collect()}
    assert {s: r["size"] for s, r in sources.items()} == dict(sizes)
    assert all(math.isclose(r["target"], goals[s]) for s, r in sources.items())

    taken = mixing.taken_words(made).collect()
    assert Counter((r["id"], r["source"], r["size"]) for r in taken) == Counter(
        (r["doc_id"], r["source"], len(spaced(r["text"]))) for r in rows
    )
    assert all(0 <= r["taken"] <= mixing.MOST * r["size"] for r in taken)
    by_source = Counter()
    for r in taken:
        by_source[r["source"]] += r["taken"]
    assert all(by_source[s] == math.floor(goals[s]) for s in goals)

    # Slots are numbered from 0 without gaps; pieces lie one behind the other; a block comes once per epoch.
    pieces = made.pieces.collect()
    slots = defaultdict(list)
    for p in pieces:
        slots[p["shard"], p["slot"]].append((p["at"], p["length"], p["source_no"], p["block"]))
    per_shard = Counter(shard for shard, _ in slots)
    assert all(per_shard[s] == shard_slots for s in per_shard if s != max(per_shard))
    assert all({slot for shard, slot in slots if shard == s} == set(range(n)) for s, n in per_shard.items())
    drawn = Counter()
    for parts in slots.values():
        parts.sort()
        assert len({p[2:] for p in parts}) == 1
        assert [p[0] for p in parts] == [0, *np.cumsum([p[1] for p in parts])[:-1]]
        drawn[parts[0][2:]] += 1
    assert max(drawn.values()) <= 2
    # Every document's words by the plain rule: full epochs, then the permuted blocks of the last one.
    for source, s in sources.items():
        no, total, words = s["source_no"], s["size"], s["words"]
        if not total:
            continue
        ids = sorted(
            ((hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest(), r["doc_id"], len(spaced(r["text"])))
             for r in rows if r["source"] == source), key=lambda x: (x[0], x[2]),
        )
        epochs, rest = divmod(words, total)
        count = np.full(total, epochs)
        blocks, turn = -(-total // block_words), 0
        while rest > 0:
            block = turn if turn == blocks - 1 else permuted_plain(turn, blocks - 1, f"{mixing.SEED}:block:{no}:{epochs}")
            size = min(rest, block_words, total - block * block_words)
            count[block * block_words : block * block_words + size] += 1
            rest, turn = rest - min(block_words, rest), turn + 1
        at, expected = 0, Counter()
        for _, i, size in ids:
            expected[i, size, int(count[at : at + size].sum())] += 1
            at += size
        assert expected == Counter((r["id"], r["size"], r["taken"]) for r in taken if r["source"] == source)


def test_mix_counts_are_drawn_per_shard(spark):
    """Shards of a large mix hold sources as a multinomial draw would, and no shard lacks one."""
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.expr("concat('s', id % 3)").alias("source"), F.lit("a b c d e f g h").alias("text")
    )
    pieces = mixing.mix(docs, block_words=4, shard_slots=500).pieces
    counts = pieces.select("shard", "slot", "source_no").distinct().groupBy("shard").pivot("source_no").count().collect()
    total = np.array([[r["0"], r["1"], r["2"]] for r in counts if sum(r[str(k)] or 0 for k in range(3)) == 500], float)
    p = total.sum(0) / total.sum()
    assert len(total) > 20 and (np.abs(total - 500 * p) < 5 * np.sqrt(500 * p * (1 - p))).all()
    chi = ((total - 500 * p) ** 2 / (500 * p)).sum()
    degrees = 2 * (len(total) - 1)
    assert abs(chi - degrees) < 6 * math.sqrt(2 * degrees)


def test_mix_repeats_and_joins_texts(spark):
    rows = [(k, " ".join(f"d{k}w{i}" for i in range(3 + k % 7)), f"s{k % 2}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made = [mixing.mix(docs.repartition(n), block_words=5, shard_slots=7) for n in (1, 6)]
    pieces = [sorted(map(tuple, m.pieces.select("shard", "slot", "at", "id", "start", "length").collect())) for m in made]
    assert pieces[0] == pieces[1]
    words = {k: text.split() for k, text, _ in rows}
    expected = defaultdict(list)
    for shard, slot, _, i, start, length in pieces[0]:
        expected[shard, slot] += words[i][start : start + length]
    got = {(r["shard"], r["slot"]): r["text"].split() for r in mixing.texts(made[0], docs).collect()}
    assert got == dict(expected)


def test_mix_of_nothing(docs, empty):
    for part in (empty, docs.where("trim(text) = '' or text is null")):
        made = mixing.mix(part)
        assert made.pieces.count() == 0 and mixing.taken_words(made).count() == part.count()
        assert all(r["target"] == 0 for r in made.sources.collect())


# --- resampling -------------------------------------------------------------------------


def features(text):
    w = lowered(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def test_resampling_equals_brute_force(spark, docs):
    target = spark.createDataFrame([("one line OF text one",), (None,), ("w1 w2 w3 b'c",)], "text string")
    rows = docs.collect()
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for text in texts for f in features(text)) for texts in
            ([r["text"] for r in rows], [r["text"] for r in target.collect()]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    expected = Counter()
    scores = []
    for r in rows:
        found = features(r["text"])
        weight = sum(gain(b) * n for b, n in Counter(map(bucket, found)).items())
        identity = "" if r["doc_id"] is None else r["doc_id"]
        h = int(hashlib.sha256(f"42:{identity}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        expected[r["doc_id"], len(lowered(r["text"])), len(found), weight, score] += 1
        if len(lowered(r["text"])) >= 20:
            scores.append((-score, r["doc_id"]))
    got = resampling.resample(docs, target, draw_percent=40, keep=docs.columns)
    assert {"text", "source", "taken"} <= set(got.columns) and "N_WORDS" not in got.columns
    got = got.collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got) == expected
    drawn = sorted(((r["rank"], -r["score"], r["doc_id"]) for r in got if r["rank"] is not None))
    assert [d[0] for d in drawn] == list(range(1, 40 * len(scores) // 100 + 1))
    assert [d[1:] for d in drawn] == sorted(scores)[: len(drawn)]


def test_feature_crcs_of_joined_words():
    draw = random.Random(5)
    texts = [" ".join(draw.choice(["a", "bb", "é" * 70, "x" * 300, "7"]) for _ in range(draw.randrange(40))) for _ in range(50)]
    words, bounds = resampling.words_of(pa.array(texts))
    plain = words.to_pylist()
    for n, (first, found) in enumerate(resampling.feature_buckets(words, bounds, 1 << 20, 5), start=1):
        assert found.tolist() == [zlib.crc32(" ".join(plain[i : i + n]).encode()) % (1 << 20) for i in first.tolist()]
        assert len(first) == sum(max(len(lowered(t)) - n + 1, 0) for t in texts)


def test_resampling_of_nothing(spark, empty):
    nothing = spark.createDataFrame([], "text string")
    assert resampling.resample(empty, nothing).count() == 0
    one = spark.createDataFrame([(1, "only"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_features"], r["weight"], r["rank"]) for r in resampling.resample(one, nothing).collect()}
    assert got[2] == (0, 0, None) and got[1][0] == 1 and got[1][2] is None


# --- periodic runs ----------------------------------------------------------------------


def runs_plain(w, min_length=24, min_periods=3):
    """Every period by itself: stretches of words that equal the word a period later, without a smaller period."""
    out = []
    for q in range(1, len(w) // min_periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_length, min_periods * q):
                part = w[i : i + length]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(w, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return [x for i, x in enumerate(w) if i not in gone]


@pytest.mark.parametrize("limits", [(24, 3), (8, 3), (6, 2), (1, 2), (30, 10)])
def test_runs_of_random_texts_equal_brute_force(limits):
    draw = random.Random(limits[0])
    for _ in range(60):
        texts = []
        for _ in range(draw.randrange(1, 5)):
            w = []
            for _ in range(draw.randrange(5)):
                period = [draw.randrange(draw.choice([1, 2, 3, 9])) for _ in range(draw.randrange(1, 12))]
                w += (period * draw.randrange(1, 9))[: draw.randrange(1, 90)]
            texts.append(w)
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
        found = periodic_runs.runs_of(np.array([x for w in texts for x in w], np.int64), bounds, *limits)
        assert [tuple(r) for r in found.tolist()] == [(k, *r) for k, w in enumerate(texts) for r in runs_plain(w, *limits)]
        stays = periodic_runs.collapsed(found, bounds)
        for k, w in enumerate(texts):
            mine = [tuple(r[1:]) for r in found.tolist() if r[0] == k]
            assert [x for x, s in zip(w, stays[bounds[k] : bounds[k + 1]]) if s] == kept_words(w, mine)


def test_runs_on_rows(docs, empty):
    found = periodic_runs.find_runs(docs)
    assert "N_WORDS" not in found.columns and {"start", "length", "text"} <= set(found.columns)
    plain = {t: runs_plain(spaced(t)) for t in ODD if t is not LONG} | {LONG: [(0, 30_000, 977)]}
    rows = found.collect()
    assert len(rows) == docs.count()
    for r in rows:
        w, runs = spaced(r["text"]), plain.get(r["text"], [])
        assert r["n_words"] == len(w) and [tuple(x) for x in r["runs"]] == runs
        assert r["collapsed"] == " ".join(kept_words(w, runs))
    digest = {r["doc_id"]: r for r in periodic_runs.digests(found.where("doc_id = 7")).collect()}[7]
    assert (digest["n_runs"], digest["start"], digest["length"], digest["period"], digest["exponent_milli"]) == (1, 0, 5000, 1, 5_000_000)
    assert digest["runs_sha256"] == hashlib.sha256(b"0,5000,1\n").hexdigest()
    nothing = periodic_runs.digests(found.where("text is null")).first()
    assert nothing["n_runs"] == 0 and nothing["start"] is None and nothing["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()
    assert periodic_runs.digests(periodic_runs.find_runs(empty)).count() == 0


def test_best_run_breaks_ties(spark):
    # Two runs of the exponent 12: the first one counts. The third is shorter.
    text = " ".join(["a", "b"] * 12 + ["x"] + ["c", "d", "e"] * 12 + ["y"] + ["f"] * 4 + ["g", "h", "i"] * 9)
    got = periodic_runs.digests(periodic_runs.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (got["n_runs"], got["start"], got["length"], got["period"], got["exponent_milli"]) == (3, 0, 24, 2, 12000)


def test_looped_texts(spark):
    rows = [(k, " ".join(f"w{i}" for i in range(k % 50))) for k in range(400)] + [(None, "x y"), (10_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = docs.select("doc_id", _looped(F.col("text"), F.col("doc_id")).alias("text")).collect()
    changed = 0
    for (k, text), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r["doc_id"], dict(rows)[r["doc_id"]])))):
        h = zlib.crc32(str(k).encode())
        w, n = spaced(text), len(spaced(text))
        if k is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            changed += 1
        assert r["doc_id"] == k and spaced(r["text"]) == w
    assert changed > 20
