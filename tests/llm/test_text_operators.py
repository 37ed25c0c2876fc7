"""Row-wise and line operators against brute force, on small odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadline.llm import (
    decontamination,
    licenses,
    line_dedup,
    packing,
    quality_rules,
    token_files,
    token_ids,
    token_rollup,
)

LONG = " ".join(f"w{k % 977}" for k in range(30_000))
ODD = [
    None,
    "",
    " ",
    "\n\n",
    "One line that is long enough to be counted as repeated.",
    "  one LINE that is long enough to be counted as repeated.\t\nshort\nshort",
    "x\nOne line that is long enough to be counted as repeated.\ny",
    "One line that is long enough to be counted as repeated.\nOne line that is long enough to be counted as repeated.",
    "éÉ " * 12 + "\nIÌ",
    "a  b \n c\td",
    "don't 's <|endoftext|> x",
    "the quick brown fox jumps over the lazy dog and runs away from it all day",
    "The Quick brown fox jumps over the lazy dog, and runs away! from it all day",
    "all day",
    "say ALL   day, all\nday twice and some more words",
    LONG,
    "Released under the MIT License.",
    "text\n\nThis work is licensed\nunder the GNU General Public License version 3\n\nmore",
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["en", "de", None][k % 3], f"src{k % 2}", len(t or ""), "e") for k, t in enumerate(ODD)]
    rows += [(None, "One line that is long enough to be counted as repeated.", "en", None, None, None)]
    rows += [rows[5], (5, "another text of the same id", None, "src0", 1, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (10, "brown fox jumps over the lazy dog and runs away from it all day"),
        (9, "ALL day"),
        (11, None),
        (12, "!!"),
        (13, "x " * 9),
        (14, " ".join(f"w{k}" for k in range(100, 140))),
        (15, "brown fox jumps over the lazy dog and runs away from it all day"),
    ]
    return spark.createDataFrame(rows, "item_id long, text string")


def words(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute_hits(text, items, window=10):
    w, hit, met = words(text), set(), set()
    for item, body in items:
        iw = words(body)
        n = min(window, len(iw))
        grams = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
        for k in range(len(w) - n + 1) if n else ():
            if tuple(w[k : k + n]) in grams:
                hit.update(range(k, k + n))
                met.add(str(item))
    return len(w), len(hit), sorted(met)


def keyed(rows, *columns):
    return Counter(tuple(tuple(r[c]) if isinstance(r[c], list) else r[c] for c in columns) for r in rows)


@pytest.mark.parametrize("block_words", [60_000, 20])
def test_decontamination_scan_equals_brute_force(docs, items, block_words):
    known = [tuple(r) for r in items.collect()]
    found = decontamination.scan(docs, items, block_words=block_words).withColumn("n_hit", decontamination.hit_words())
    assert set(docs.columns) < set(found.columns)
    want = Counter((r["doc_id"], a, b, tuple(c)) for r in docs.collect() for a, b, c in [brute_hits(r["text"], known)])
    assert keyed(found.collect(), "doc_id", "n_words", "n_hit", "items") == want


def test_automaton_on_repetitive_words():
    rng = np.random.default_rng(3)
    for _ in range(60):
        items = [(k, [b"%d" % x for x in rng.integers(0, 3, rng.integers(1, 25))]) for k in range(4)]
        text = [b"%d" % x for x in rng.integers(0, 3, 60)]
        spans, met = decontamination.Automaton(items, 5).scan(text)
        n, hit, ids = brute_hits(b" ".join(text).decode(), [(k, b" ".join(w).decode()) for k, w in items], 5)
        assert sum(b - a for a, b in spans) == hit and sorted(map(str, met)) == ids


def test_decontamination_clean_cuts_or_drops(docs, items, empty):
    rows = decontamination.clean(docs, items).collect()
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert 11 not in texts and 12 not in texts  # mostly benchmark text
    assert texts[14] == ODD[14] and 0 in texts  # short spans and null texts stay
    assert len(words(texts[15])) < len(words(LONG)) and "w100 w101" not in texts[15]
    assert decontamination.clean(empty, items).columns == empty.columns
    assert decontamination.clean(empty, items).count() == 0
    assert decontamination.scan(docs, items.limit(0)).where("size(items) > 0").count() == 0


def test_decontamination_clean_cuts_whole_short_items(spark):
    items = spark.createDataFrame([(1, "Who wrote the first long novel?"), (2, "all day")], "item_id long, text string")
    around = " ".join(f"w{k}" for k in range(20))
    texts = [f"{around}. Who wrote the first long novel? {around}", f"{around} who wrote the first {around}", f"{around} all day {around}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontamination.clean(docs, items).collect()}
    assert got == {0: f"{around}. ? {around}", 1: texts[1], 2: texts[2]}


def test_decontamination_clean_goes_through_python_once(docs, items):
    got = decontamination.clean(docs, items)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    blocks = decontamination.clean(docs, items, block_words=5)  # several passes, the last one cuts
    assert Counter(map(tuple, blocks.collect())) == Counter(map(tuple, got.collect()))


def brute_lines(rows):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    held = defaultdict(set)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(r["doc_id"])
    out = Counter()
    for r in rows:
        lines = (r["text"] or "").split("\n")
        gone = [
            len(held[key(x)]) >= 3 and r["doc_id"] != max(i for i in held[key(x)] if i is not None) if key(x) in held else False
            for x in lines
        ]
        out[r["doc_id"], len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)] += 1
    return out


def test_line_dedup_equals_brute_force(docs, empty):
    got = line_dedup.dedup_lines(docs.withColumn("n_lines", F.lit("clash")).withColumn("id", F.lit(1)))
    assert keyed(got.collect(), "doc_id", "n_lines", "n_dropped", "text") == brute_lines(docs.collect())
    assert line_dedup.dedup_lines(empty).count() == 0


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    covered = {p for v in at.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_quality_base_counts_and_verdict(spark, docs, empty):
    more = docs.unionByName(
        spark.createDataFrame([(90, "a b c d e f g h i " * 3, "en", "s", 1, "")], DOCS)
    ).unionByName(spark.createDataFrame([(91, "a " * 50 + "# | & x", "en", "s", 1, "")], DOCS))
    rows = quality_rules.judge(more.withColumn("n_words", F.lit("clash"))).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert keyed(rows, "doc_id", *names) == Counter((r["doc_id"], *brute_counts(r["text"])) for r in more.collect())
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(empty).count() == 0


def test_quality_limits_follow_the_spread_of_each_metric(spark):
    """Two groups with values around the same median: the one of wider spread has wider limits."""

    def counts(k, source, spread, far):
        shift = 1 + (k % 9 - 4) * spread if far is None else far
        return (k, "en", source, 1000, int(5000 * shift), int(300 * shift), 1000, int(200 * shift), int(100 * shift), False)

    rows = [counts(k, "even", 0.01, None) for k in range(90)] + [counts(k, "mixed", 0.05, None) for k in range(90)]
    rows += [(900, None, None, 1000, 5000, 0, 1000, 0, 0, False)]  # no value above zero
    made = spark.createDataFrame(
        rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long,"
        " n_dup_lines long, n_repeat_words long, base_failed boolean")
    found = {(r["source"], r["metric"]): r for r in quality_rules.limits(quality_rules.sketches(made), ["lang", "source"]).collect()}
    assert len(found) == 9 and (None, "symbols") not in found
    for metric in quality_rules.METRICS:
        even, mixed = found["even", metric], found["mixed", metric]
        assert even["upper"] < mixed["upper"] and mixed["step"] > even["step"] >= 1
        assert (even["lower"] is None) == (metric != "word_length")
    assert found["mixed", "word_length"]["lower"] < found["even", "word_length"]["lower"]


def test_quality_null_and_odd_groups(spark):
    def text(k):
        return " ".join(f"word{k:04}x{j}" for j in range(60))

    groups = [(None, None), ("\x00", None), (None, "?null"), ("en", "?null")]
    rows = [(100 * g + k, text(100 * g + k), *groups[g]) for g in range(4) for k in range(30)]
    rows += [(9000, " ".join(f"extraordinarily{j}long" * 8 for j in range(60)), None, None), (9001, "word " * 3, None, None)]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert len(kept) == len(rows) and not kept.pop(9000) and not kept.pop(9001) and all(kept.values())


def test_quality_limits_adapt_to_the_group(spark):
    def text(k, marks):
        return " ".join(f"word{k}x{j}" + "|" * (j < marks) for j in range(60))

    rows = [(k, text(k, 0), "en", "prose") for k in range(150)] + [(500, text(500, 40), "en", "prose")]
    rows += [(1000 + k, text(k, 30 + k % 9), "en", "tables") for k in range(150)]
    rows += [(2000 + k, text(2000 + k, 0), "en", "small") for k in range(3)] + [(2500, text(2500, 40), "en", "small")]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert not kept[500] and all(kept[k] for k in range(150))
    assert all(kept[1000 + k] for k in range(150))  # marks are normal there


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    path = public_tokenizers.path(name)
    odd = ODD + ["a \n b", "\n \n x ", "ſ ǅ é ́a", "a\x1cb \x1c c\x85 d", "foo \n", "日本 語 １２ ²", "<|startoftext|>q  z"]
    coder, library = token_ids.Encoder(path), Tokenizer.from_file(path)
    for _ in range(2):  # the second time from the table
        ids, counts = coder.encode(pa.array(odd))
        got = np.split(ids, np.cumsum(counts)[:-1])
        want = [library.encode(t or "", add_special_tokens=False).ids for t in odd]
        assert [x.tolist() for x in got] == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_cuts_words_from_marks_as_the_library_does(name):
    path = public_tokenizers.path(name)
    odd = ["Stone, stone. STONE;stone's (stone) don't 'tis l'eau, x's,y a,b,c", "\u0130, I\u0307, H\u0331, h\u0331; J\u030c. é́, e\u0301,"]
    odd += ["end,\u0338 <\u0338= b<\u0338", "x<|EndOfText|>, y<|endoftext|>, z<|startoftext|>.", "Été. ǰ, ÿ! ×, ÷a ªb; ʃ, Σ, ΑΣ.", "a\x00, </w>a, a</w>"]
    coder, library = token_ids.Encoder(path), Tokenizer.from_file(path)
    for _ in range(2):
        ids, counts = coder.encode(pa.array(odd))
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in odd]


def test_encoder_gives_the_library_a_word_once(monkeypatch):
    given, encode = [], token_ids._encode_strings
    monkeypatch.setattr(token_ids, "_encode_strings", lambda tokenizer, strings: given.extend(strings) or encode(tokenizer, strings))
    coder = token_ids.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    coder.encode(pa.array(["Stone stone, stone. STONE; stones", "stones, stone"]))
    assert sorted(given) == [",", ".", ";", "stone stones"]


def test_re_pair_round_trip_and_random_access():
    rng = np.random.default_rng(5)
    for vocabulary, n in ((3, 4000), (2000, 20_000), (1, 500)):
        ids = (rng.zipf(1.4, n) % vocabulary).astype(np.uint32)
        cuts = np.sort(rng.integers(0, n, 30))
        parts = np.split(ids, cuts)
        counts = np.array([len(p) for p in parts])
        g = token_files.re_pair(ids, counts, 2000)
        shard = token_files.Shard(2000, g.rules.tobytes(), g.spans().tobytes(), g.symbols.tobytes(), g.n_symbols, counts)
        assert [b for b in shard.documents()] == [p.astype("<u4").tobytes() for p in parts]
        assert len(g.symbols) < n
        for k in (0, 7, 30):
            assert shard.document(k).tolist() == parts[k].tolist()
        for start, size in ((0, 5), (n // 3, 40), (n - 3, 10)):
            assert shard.read(start, size).tolist() == ids[start : start + size].tolist()
    assert len(token_files.re_pair(np.zeros(0, np.uint32), np.zeros(2, np.int64), 10).symbols) == 0


def test_re_pair_leaves_no_frequent_pair():
    """Also where a round replaces few places: a passage six times among ids that occur once."""
    passage = np.arange(50_000, 50_016)
    once = np.array_split(np.arange(50_000), 6)
    ids = np.concatenate([np.append(part, passage) for part in once]).astype(np.uint32)
    g = token_files.re_pair(ids, np.array([len(ids)]), 50_016)
    left = Counter(zip(g.symbols.tolist(), g.symbols[1:].tolist()))
    assert g.base + len(g.rules) < token_files.MAX_SYMBOL and max(left.values()) < token_files.LEAST_COUNT


def test_token_files_hold_every_document(spark, docs, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    token_files.write(docs, f"{tmp_path}/t", path, 2, shard_ids=500)
    got = token_files.read(spark, f"{tmp_path}/t").orderBy("start").collect()
    rows = docs.collect()
    want = Counter(
        (r["doc_id"], np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for r in rows
    )
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert ids == sorted(ids)
    token_files.write(empty, f"{tmp_path}/e", path, 2)
    assert token_files.read(spark, f"{tmp_path}/e").count() == 0


def test_packing_holds_every_id_once(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    pieces = packing.pack(rows, path, end_id=0, block_tokens=20_000).collect()
    texts = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in rows.collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for doc, ids in texts.items():
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert bytes(p["ids"]) == np.array(ids[at : at + p["length"]], "<u4").tobytes()
            at += p["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= p["tier"] <= 1024
    assert packing.pack(empty, path, end_id=0).count() == 0
    assert packing.pack(docs, path, end_id=0).where("start = 0").count() == docs.count()


def test_packing_wastes_little_and_balances():
    rng = np.random.default_rng(2)
    lengths = [int(x) for x in rng.lognormal(6, 1.2, 3000)] + [50_000, 1024, 512, 1]
    windows = packing.pack_lengths(lengths)
    held = [sum(n for _, _, n in pieces) for _, pieces in windows]
    assert sum(held) == sum(lengths)
    padded = sum(0 if h & (h - 1) == 0 else 1024 - h for h in held)
    assert padded <= 1024
    groups = defaultdict(list)
    for (size, pieces), where in zip(windows, packing.step_groups(windows)):
        groups[where].append(sum(n * n for _, _, n in pieces))
    long = [sum(v) for (size, _), v in groups.items() if size == 1024]
    assert max(map(len, groups.values())) <= packing.GROUP and max(long) < 1.6 * min(long) + 1024**2 * packing.GROUP / 4


def brute_licences(text):
    def grams(w):
        return set(zip(w, w[1:]))

    lines = [words(x) for x in (text or "").split("\n")]
    groups, units = [[]], [x for x in lines if x]
    for x in lines:
        groups[-1].append(x) if x else groups.append([])
    groups = [g for g in groups if g]
    units += [sum(g, []) for g in groups if len(g) > 1]
    if len(groups) > 1:
        units.append(sum(lines, []))
    best = {}
    for u in map(grams, units):
        for name, body in licenses.TEMPLATES.items():
            t = grams(words(body))
            if u and 2 * len(u & t) / (len(u) + len(t)) >= 0.8:
                best[name] = max(best.get(name, 0), 2 * len(u & t) / (len(u) + len(t)))
    return tuple(sorted(best.items()))


def test_license_scan_equals_brute_force(docs, empty):
    got = licenses.scan(docs.withColumn("matches", F.lit("clash"))).collect()
    want = Counter((r["doc_id"], brute_licences(r["text"])) for r in docs.collect())
    assert Counter((r["doc_id"], tuple((m["licence"], m["dice"]) for m in r["matches"])) for r in got) == want
    assert any(r["matches"] for r in got)
    assert licenses.scan(empty).count() == 0


def test_license_inside_longer_lines_and_wrapped(spark):
    mit, mpl = licenses.PARAGRAPHS["MIT permission paragraph"], licenses.PARAGRAPHS["MPL-2.0 notice"]
    cut = mit.split()
    wrapped = "\n".join(" # " + " ".join(cut[k : k + 7]) for k in range(0, len(cut), 7))
    texts = {
        1: (f"Some words before. {mit} And some words after it.", {"MIT permission", "MIT permission paragraph"}),
        2: (f"before\n{wrapped}\nafter it in the same paragraph", {"MIT permission", "MIT permission paragraph"}),
        3: (mpl, {"MPL-2.0", "MPL-2.0 notice"}),
        4: ("Copyright 2019 Example Corp. All rights reserved.", {"All rights reserved"}),
        5: ("The code is small. Released under the MIT License. It has no tests.", {"MIT"}),
        6: ("Rights of all people are reserved under the law of the software.", set()),
    }
    rows = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string")
    for r in licenses.scan(rows).collect():
        assert {m["licence"] for m in r["matches"]} == texts[r["doc_id"]][1]
        assert all(m["dice"] == 1 for m in r["matches"])


def test_license_best_run_equals_all_runs(spark):
    rng = np.random.default_rng(7)
    templates = {f"t{k}": " ".join(f"v{x}" for x in rng.integers(0, 5, 2 + k)) for k in range(10)}
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 6, rng.integers(0, 40))) for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    matched = 0
    for least in (0.8, 0.6):
        for r in licenses.scan(rows, templates, least).collect():
            w, want = texts[r["doc_id"]].split(), {}
            for name, body in templates.items():
                b = set(zip(body.split(), body.split()[1:]))
                runs = [set(zip(w[i:j], w[i + 1 : j])) for i in range(len(w)) for j in range(i + 2, len(w) + 1)]
                best = max((2 * len(a & b) / (len(a) + len(b)) for a in runs), default=0)
                if best >= least:
                    want[name] = best
            assert {m["licence"]: m["dice"] for m in r["matches"]} == want
            matched += len(want)
    assert matched > 50


def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    schema = "op string, doc_id long, source string, lang string, tokenizer_version string, n_tokens long, extra string"
    rollup = token_rollup.Rollup(spark, str(tmp_path))
    assert rollup.totals().count() == 0
    first = spark.createDataFrame(
        [("insert", k, "a" if k < 5 else None, "en", "v1", 10 * k, "") for k in range(8)]
        + [("insert", 1, "a", "en", "v1", 10, ""), ("insert", None, "a", "en", "v1", 5, ""), ("?", 99, "a", "en", "v1", 5, "")],
        schema,
    )
    second = spark.createDataFrame(
        [("delete", 2, "a", "en", "v1", None, ""), ("revise", 3, "a", "en", "v2", 7, ""), ("delete", 50, "a", "en", "v1", 1, ""),
         ("revise", 60, "b", "de", "v2", None, "")],
        schema,
    )
    rollup.commit(1, first)
    rollup.commit(2, second)
    want = {("a", "en", "v1"): (3, 0 + 10 + 40), (None, "en", "v1"): (3, 180), ("a", "en", "v2"): (1, 7), ("b", "de", "v2"): (1, 0)}

    def totals(upto=None):
        return {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals(upto).collect()}

    assert totals() == want
    rollup.commit(2, second)
    rollup.commit(3, second.limit(0))
    assert totals() == want and totals(1) == {("a", "en", "v1"): (5, 100), (None, "en", "v1"): (3, 180)}


def test_rollup_commits_of_any_batch_repeat(spark, tmp_path, monkeypatch):
    """Histories with earlier batches committed again, cut off, or late equal one clean history."""
    rng = random.Random(5)
    schema = "op string, doc_id long, source string, lang string, tokenizer_version string, n_tokens long"

    def batch():
        rows = [
            (rng.choice(["insert", "delete", "revise"]), rng.randrange(12), rng.choice(["a", None]), "en", rng.choice("vw"), rng.randrange(30))
            for _ in range(8)
        ]
        return spark.createDataFrame(rows, schema)

    def brute(batches):
        held = {}
        for events in batches:
            last = {}
            for e in events.collect():
                key = (e["op"], e["source"] is not None, e["source"] or "", e["lang"], e["tokenizer_version"], e["n_tokens"])
                if e["doc_id"] not in last or key > last[e["doc_id"]][0]:
                    last[e["doc_id"]] = (key, e)
            for doc, (_, e) in last.items():
                held.pop(doc, None)
                if e["op"] != "delete":
                    held[doc] = ((e["source"], e["lang"], e["tokenizer_version"]), e["n_tokens"])
        sums = {}
        for key, n in held.values():
            docs, tokens = sums.get(key, (0, 0))
            sums[key] = (docs + 1, tokens + n)
        return sums

    def got(upto=None):
        return {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals(upto).collect()}

    rollup = token_rollup.Rollup(spark, str(tmp_path), snapshot_every=2)
    one, two, three, other = batch(), batch(), batch(), batch()
    rollup.commit(1, one)
    rollup.commit(3, three)
    rollup.commit(2, two)  # late
    assert got() == brute([one, two, three]) and got(2) == brute([one, two])
    rollup.commit(1, one)  # equal events, in any order
    rollup.commit(1, one.orderBy("n_tokens"))
    assert got() == brute([one, two, three])
    rollup.commit(1, other)  # other events
    assert got() == brute([other, two, three]) and got(1) == brute([other])

    class Lost(Exception):
        pass

    def lost(number):
        raise Lost

    with monkeypatch.context() as patch:
        patch.setattr(rollup, "_work_out", lost)
        with pytest.raises(Lost):
            rollup.commit(2, one)
    assert got() == brute([other])  # nothing of the commit that was cut off
    rollup.commit(4, two)  # works out what is left before
    assert got() == brute([other, one, three, two])
    rollup._mark(3, token_rollup.OPEN)
    with pytest.raises(RuntimeError):
        rollup.commit(5, three)
    rollup.commit(3, three)
    assert got() == brute([other, one, three, two])


def test_digest_columns(spark):
    """The registered forms read whole tables and give the contract's columns."""
    from leadline.llm import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = QUERIES["op9_packing"](spark, folder).limit(3).collect()
    assert all(0 <= r["ids_crc32"] < 2**32 for r in rows)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [0]
        piece = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(piece)
    lines = QUERIES["op6_line_dedup"](spark, folder).collect()
    assert len(lines) == len(texts) and all(re.fullmatch("[0-9a-f]{64}", r["kept_sha256"]) for r in lines)
    assert hashlib.sha256(b"").hexdigest() in {r["items_sha256"] for r in QUERIES["op1_decontamination"](spark, folder).collect()}


def test_token_counts_query_shows_both_versions_after_each_batch(spark, tmp_path):
    import __spark_entry__ as driver

    rows = [(1, "s", "en", "don't stop"), (2, "s", "en", "don't stop"), (3, "s", "en", "two words"), (4, None, "en", None)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = driver.queries()["op7_token_counts"](spark, str(tmp_path)).collect()
    table = {(r["batch"], r["source"], r["tokenizer_version"]): (r["docs"], r["tokens"]) for r in got}
    assert set(table) == {(b, s, v) for b, v in ((1, "word-1"), (2, "word-1"), (3, "word-2")) for s in ("s", None)}
    assert [table[b, "s", v][0] for b, v in ((1, "word-1"), (2, "word-1"), (3, "word-2"))] == [3, 2, 2]
    # "don't stop" has 2 tokens in the first version and 4 in the second.
    assert [table[b, "s", v][1] for b, v in ((1, "word-1"), (2, "word-1"), (3, "word-2"))] == [6, 4, 6]
    assert table[1, None, "word-1"] == (1, 0)
