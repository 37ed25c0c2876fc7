"""Near duplicates, components, models and the pipeline against brute force."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadline.llm import components, decontamination, near_dedup, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_shingles string"


def brute_groups(rows, size, similarity=(80, 100)):
    """component per row number, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                met = len(sets[a] & sets[b])
                if similarity[1] * met >= similarity[0] * (len(sets[a]) + len(sets[b]) - met):
                    root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return [(i, len(sets[k]), low[find(k)] if i is not None else None) for k, (i, _) in enumerate(rows)]


def corpus(seed):
    """Groups of edited copies, texts that share a long passage, short and odd texts."""
    rng = random.Random(seed)

    def prose(n):
        return [f"w{rng.randrange(4000)}" for _ in range(n)]

    def edited(words, share):
        return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words]

    passage, out = prose(60), []
    for _ in range(6):
        first = prose(rng.randrange(20, 260))
        out += [edited(first, rng.choice([0, 0.01, 0.02, 0.03, 0.05])) for _ in range(rng.randrange(2, 20))]
    first = prose(120)
    out += [edited(first, 0.015 * (k % 3)) for k in range(60)]  # a large group, links in part
    out += [prose(rng.randrange(0, 40)) + passage + prose(rng.randrange(0, 8)) for _ in range(60)]
    out += [prose(rng.randrange(1, 9)) for _ in range(20)] + [["a", "b"], ["A", "b"], ["b", "a"], ["a", "b", "c"]]
    rng.shuffle(out)
    rows = [(k, " ".join(w)) for k, w in enumerate(out)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, rows[0][1]), rows[3], (5, "the same id with another text here")]
    return rows


@pytest.mark.parametrize(("seed", "short"), [(1, 64), (2, 4), (3, 4)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, seed, short):
    """Also with lists cut so short that nearly all go through pivots and blocks."""
    monkeypatch.setattr(near_dedup, "SHORT_LIST", short)
    monkeypatch.setattr(near_dedup, "BLOCK", 16 if short == 4 else 1024)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "clash") for i, t in rows], SCHEMA)
    got = near_dedup.near_duplicates(docs, size=4).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r)[:3] for r in got], key=key) == sorted(brute_groups(rows, 4), key=key)
    assert all(r["kept"] == (r["component_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_dedup.near_duplicates(docs).count() == 0
    alone = spark.createDataFrame([(1, None, None, None, None, None)], SCHEMA)
    assert [tuple(r) for r in near_dedup.near_duplicates(alone).collect()] == [(1, 0, 1, True)]


def test_components_joined_by_more_edges(spark):
    rng = random.Random(9)
    for n in (0, 4, 40):
        before, after = ([(rng.randrange(60), rng.randrange(60)) for _ in range(k)] for k in (30, n))
        edges, more = (spark.createDataFrame(e, "a int, b int") for e in (before, after))
        got = components.joined(components.components(edges), more).collect()
        want = components.components(edges.union(more)).collect()
        linked = {r["node"]: r["component"] for r in want}
        assert {r["node"]: r["component"] for r in got} == linked and len(got) == len(linked)
    empty = spark.createDataFrame([], "a int, b int")
    assert components.joined(components.components(empty), empty).count() == 0
    assert {tuple(r) for r in components.joined(components.components(empty), edges.limit(0).union(empty)).collect()} == set()


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(20, 50)] + [(3, 3), (50, 160)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**dict.fromkeys(range(100, 161), 50), **dict.fromkeys(range(20, 50), 7), 7: 7, 50: 50}
    assert got == want


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    rude, rows, labels = [f"rude{k}" for k in range(5)] + ["vile"], [], []
    for k in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(10, 80))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(4):
                bad = rng.choice(rude)
                words.insert(rng.randrange(len(words)), bad if bad != "vile" else f"vile{rng.randrange(999)}")
        rows.append((k, " ".join(words), "en", "s", 0, None))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus(1500, 4)
    rows += [(9000, None, None, None, None, None), (9001, "", "en", "s", 0, None), (None, "w1 rude1 rude2 rude3", "en", "s", 0, "x"), rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels + [(9000, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.judge(docs.withColumn("score", F.lit("clash")), known).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 200
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    # Labels of held-out rows are not read.
    import zlib

    hidden = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    assert {r["doc_id"] for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2}
    again = {r["doc_id"]: r["score"] for r in toxicity.judge(docs, hidden).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in got)
    assert toxicity.judge(docs.limit(0), known).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1, None), (2, None, "en", "s", 1, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.judge(docs, none).collect()] == [0.0, 0.0]


def test_site_posteriors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for h in range(12):
        rate = rng.beta(2, 2)
        for path in range(int(rng.integers(1, 4))):
            for _ in range(int(rng.integers(1, 60)) if h else 400):
                rows.append((f"h{h}" if h < 11 else None, f"p{path}", float(np.clip(rng.normal(rate, 0.1), 0, 1))))
    got = quality.posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()

    def worth(groups):
        n = sum(len(g) for g, _ in groups)
        within = sum(sum(x * x for x in g) - len(g) * np.mean(g) ** 2 for g, _ in groups) / max(1, n - len(groups))
        between = (sum(len(g) * (np.mean(g) - c) ** 2 for g, c in groups) - (len(groups) - 1) * within) / n
        return min(max(within / between, quality.LEAST_WORTH), quality.MOST_WORTH) if between > 0 else quality.MOST_WORTH

    overall = float(np.mean([p for _, _, p in rows]))
    hosts, paths = defaultdict(list), defaultdict(list)
    for h, path, p in rows:
        hosts[h].append(p)
        paths[h, path].append(p)
    host_worth = worth([(g, overall) for g in hosts.values()])
    path_worth = worth([(g, np.mean(hosts[h])) for (h, _), g in paths.items()])
    assert len(got) == len(rows)
    for r in got:
        host, path = hosts[r["host"]], paths[r["host"], r["path"]]
        a = (sum(host) - r["p"] + host_worth * overall) / (len(host) - 1 + host_worth)
        b = (sum(path) - r["p"] + path_worth * a) / (len(path) - 1 + path_worth)
        assert math.isclose(a, r["host_posterior"], rel_tol=1e-6) and math.isclose(b, r["path_posterior"], rel_tol=1e-6)


def test_quality_on_held_out_rows(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(800):
        good = rng.random() < 0.7
        words = [f"word{rng.randrange(500)}" for _ in range(60)]
        if not good:
            words = [w + "###" for w in words] if k % 2 else [w for w in words[:6] for _ in range(10)]
        rows.append((k, " ".join(words), ["en", None][k % 2], f"s{k % 5}", 0, None))
        labels.append((k, int(good), 0))
    rows += [(900, None, None, None, None, None), (901, "", "en", "s9", 0, None), (None, "a", "en", "s0", 0, None), rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.judge(docs.withColumn("host", F.lit("clash")), known).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(got) == len(rows)
    assert sum(r["kept"] == bool(truth[r["doc_id"]]) for r in held) >= 0.95 * len(held)
    assert quality.judge(docs.limit(0), known).count() == 0
    assert all(r["score"] is not None for r in quality.judge(docs, known.limit(0)).collect())


def test_pipeline_stages(spark, tmp_path):
    """Every stage on its predecessor's rows; planted cases are caught, clean texts stay."""
    import corpus_pipeline

    rows, labels = toxic_corpus(700, 5)
    rng = random.Random(6)
    clean = [(2000 + k, " ".join(f"c{rng.randrange(900)}" for _ in range(40)), "en", "s", 0, None) for k in range(40)]
    passage = " ".join(f"q{k}" for k in range(30))
    line = "this footer line stands in many documents"
    planted = [
        (3000, clean[0][1] + " tail", "en", "s", 0, None),  # a near copy
        (3001, clean[1][1].upper(), "en", "s", 0, None),  # an equal one but for case
        (3002, " ".join(f"d{k}" for k in range(40)) + " " + passage + " end", "en", "s", 0, None),
        (3003, passage, "en", "s", 0, None),
        *[(3010 + k, f"g{k} " * 3 + "\n" + line + "\n" + f"unlike{k} {k}", "en", "s", 0, None) for k in range(4)],
        (3020, None, None, None, None, None),
        (3021, "", "en", "s", 0, None),
    ]
    folder = str(tmp_path)
    spark.createDataFrame(rows + clean + planted, SCHEMA).drop("n_shingles").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, after = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        out = function(spark, docs, folder)
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        after[name] = {r["doc_id"]: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    truth = {i: t for i, _, t in labels}
    wrong = sum((i in after["toxicity"]) == bool(t) for i, t in truth.items())
    assert wrong <= 0.03 * len(truth) and all(c[0] in after["toxicity"] for c in clean + planted)
    assert set(after["line_dedup"]) == set(after["toxicity"])
    assert [line in after["line_dedup"][3010 + k]["text"] for k in range(4)] == [False, False, False, True]
    gone = set(after["line_dedup"]) - set(after["near_dedup"])
    brute = brute_groups([(i, r["text"]) for i, r in after["line_dedup"].items()], 5)
    assert gone == {i for i, _, low in brute if i != low} and {3000, 3001} <= gone
    final = after["decontamination"]
    assert 3003 not in final and "q5" not in final[3002]["text"] and final[3002]["text"].endswith(" end")
    assert final[3002]["n_chars"] == len(final[3002]["text"]) and {3020, 3021} <= set(final)
    assert set(after["near_dedup"]) - set(final) == {3003}
    assert set(after["packing"]) == set(final)
    assert corpus_pipeline.run(spark, folder).select("doc_id").distinct().count() == len(final)


def test_pipeline_near_copies_row_by_row(spark):
    """Repeated rows, an id with several texts and null ids: one row of each group stays."""
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(5, a), (5, a), (6, b), (7, c), (7, b), (None, c), (None, d), (None, d), (None, None), (None, None), (8, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    key = lambda r: tuple((x is None, x) for x in r)
    want = [(5, a), (6, b), (7, c), (None, d), (None, None), (None, None), (8, ""), (8, "")]
    assert sorted([tuple(r)[:2] for r in got], key=key) == sorted(want, key=key)


def test_pipeline_keeps_columns_named_like_its_own(spark, tmp_path):
    """Extra columns named like features, counts and helpers pass through, in either case; empty tables stay empty."""
    import corpus_pipeline

    rows, labels = toxic_corpus(400, 7)
    rows = [r[:5] for r in rows] + [(9000, None, "en", "s", 0), (9001, "", "en", "s", 0), (9002, "w " * 200_000, "en", "s", 0)]
    names = [
        *toxicity.FEATURES, "score", "toxicity_score", "kept", "vector", "raw", "prediction", "probability", "value",
        "n_lines", "n_dropped", "row", "pos", "h1", "gone", "gone_id", "gone_row", "id", "many", "top",
        "row_number", "row_key", "doc", "digest", "component", "n_words", "spans", "items", "hit_spans", "text_in", "text_again",
    ]
    extra = [n.upper() if k % 2 else n for k, n in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in extra])
    folder = str(tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    passage = " ".join(f"q{k}" for k in range(30))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    empty = docs.limit(0)
    for k, (name, function) in enumerate(corpus_pipeline.STAGES[:4]):
        out, none = function(spark, docs, folder), function(spark, empty, folder)
        assert out.columns == docs.columns == none.columns, name
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        got = docs.drop("text").collect()
        assert len(got) > 100 and all(r[n] == f"{n}:{r['doc_id']}" for r in got for n in extra), name
        assert {9000, 9001} <= {r["doc_id"] for r in got} and none.count() == 0, name
    assert corpus_pipeline.pack_sequences(spark, docs, folder).select("doc_id").distinct().count() == len(got)
    assert corpus_pipeline.pack_sequences(spark, empty, folder).count() == 0


def test_scan_replaces_result_columns_in_either_case(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y", "z")], "doc_id long, text string, N_WORDS string, Spans string, ITEMS string")
    items = spark.createDataFrame([(7, "b c")], "item_id long, text string")
    got = decontamination.scan(docs, items).first().asDict(recursive=True)
    assert got == {"doc_id": 1, "text": "a b c", "n_words": 3, "spans": [{"from": 1, "to": 3}], "items": ["7"]}


def test_quality_after_rows_were_observed(spark):
    from pyspark.sql import Observation

    seen = Observation()
    assert spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).count() == 3 and seen.get["n"] == 3
    rows = [(k, " ".join(f"w{(k * j) % 97}" + "#" * (k % 2) for j in range(1, 30)), "en", "s", 0, None) for k in range(60)]
    known = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    assert len(quality.judge(spark.createDataFrame(rows, SCHEMA), known).collect()) == 60
