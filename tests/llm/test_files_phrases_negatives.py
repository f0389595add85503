"""Co-bucketed files, repeated phrases and hard negatives against brute force, with awkward rows."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm.cobuckets import FINAL, START, Numbered, co_bucket, crc32_bucket, surrogate, surrogate_keys
from tidemark.llm.negatives import best_of, hard_negatives, score_limits
from tidemark.llm.phrases import PhraseAutomaton, WordHashes, repeated_phrases

# --- files -------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 7, 64, 602])
def test_surrogates_hit_each_partition_once(spark, n):
    keys = surrogate_keys(spark, n)
    assert len(set(keys)) == n
    got = spark.range(n).withColumn("p", F.pmod(F.hash(surrogate(F.col("id"), keys)), F.lit(n))).collect()
    assert all(r["id"] == r["p"] for r in got)
    # and repartition() itself deals them so
    dealt = spark.range(n).repartition(n, surrogate(F.col("id"), keys)).withColumn("p", F.spark_partition_id()).collect()
    assert all(r["id"] == r["p"] for r in dealt)


def crc(text):
    return zlib.crc32(text.encode())


LEFT, RIGHT = "k long, x string, known_key double, path int", "k long, line int, item long, start_file string, id string"
BUCKETS = 12


def tables(spark, left, right):
    bucket = F.coalesce(crc32_bucket("k", BUCKETS, "s"), F.lit(BUCKETS + 1))
    a = Numbered("left", spark.createDataFrame(left, LEFT), "k", F.when(bucket % 4 == 1, bucket - 1).otherwise(bucket), BUCKETS + 2)
    b = Numbered("right", spark.createDataFrame(right, RIGHT), "k", F.coalesce(crc32_bucket("item", BUCKETS), F.lit(0)), BUCKETS)
    return a, b


def expected(left, right):
    have = {r[0] for r in left if r[0] is not None}
    home = lambda k: BUCKETS + 1 if k is None else crc(f"s{k}") % BUCKETS
    sides = {
        "left": (left, lambda r: home(r[0]), lambda r: home(r[0]) - (home(r[0]) % 4 == 1)),
        "right": (right, lambda r: BUCKETS if r[0] is not None and r[0] not in have else home(r[0]), lambda r: 0 if r[2] is None else crc(str(r[2])) % BUCKETS),
    }
    key = lambda row: tuple((0,) if x is None else (1, x.encode() if isinstance(x, str) else x) for x in row)
    out, of = {}, {}
    for name, (rows, bucket, start) in sides.items():
        final, lineage, holds = defaultdict(list), defaultdict(Counter), defaultdict(set)
        for r in rows:
            final[bucket(r)].append(r)
            lineage[bucket(r)][start(r)] += 1
            holds[start(r)].add(bucket(r))
        of[name] = final
        for b, some in final.items():
            stays = len(lineage[b]) == 1 and len(holds[next(iter(lineage[b]))]) == 1
            ids = ",".join("" if r[0] is None else str(r[0]) for r in sorted(some, key=key))
            lines = ",".join(f"{s}:{n}" for s, n in sorted(lineage[b].items()))
            out[name, b] = [sorted(some, key=key), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(lines.encode()).hexdigest(), not stays]
    for (_, b), x in out.items():
        n = Counter(r[0] for r in of["left"].get(b, []))
        x.append(sum(n[r[0]] for r in of["right"].get(b, [])) if b < BUCKETS else 0)
    return out


def check_files(spark, left, right, folder):
    got = co_bucket(*tables(spark, left, right), BUCKETS, "s", f"file://{folder}").collect()
    want = expected(left, right)
    assert {(r["table_name"], r["bucket"]) for r in got} == set(want)
    assert len({r["path"] for r in got}) == len(got)
    for r in got:
        rows, ids, lineage, rewritten, joined = want[r["table_name"], r["bucket"]]
        file = pq.read_table(r["path"].removeprefix("file://"), partitioning=None)
        assert list(zip(*[c.to_pylist() for c in file.columns])) == rows
        assert (r["ids_sha256"], r["lineage_sha256"], r["rewritten"], r["n_joined"], r["n_rows"]) == (ids, lineage, rewritten, joined, len(rows))
        assert r["columns"] == ",".join(file.column_names)
    there = {f"{a}/{f}" for a, _, names in os.walk(folder) for f in names if not f.endswith(".crc")}
    assert there == {r["path"].removeprefix("file://") for r in got}
    return got


def test_files_equal_brute_force(spark, tmp_path):
    rng = random.Random(3)
    odd = lambda: rng.choice([None, "", "a", "é", "z", "\U0001f600"])
    left = [(rng.choice([None, *range(60)]), odd(), rng.choice([None, -0.5, 2.0]), rng.randrange(3)) for _ in range(200)]
    left += left[:40]  # repeated rows
    # one key with half of all rows, keys that the left lacks, null keys and items
    right = [(rng.choice([None, 7, 7, 7, *range(90)]) if rng.random() < 0.6 else 7, rng.randrange(4), rng.choice([None, *range(5)]), odd(), odd()) for _ in range(600)]
    got = check_files(spark, left, right, tmp_path / "a")
    assert {r["bucket"] for r in got if r["table_name"] == "right"} >= {BUCKETS, BUCKETS + 1}


def test_files_that_are_final_stay(spark, tmp_path):
    left = [(k, "x", 1.0, 1) for k in range(40)]
    # each bucket's lines share an item that no other bucket's lines have, as far as items' files differ
    items, used = {}, set()
    for i in range(1000):
        if crc(str(i)) % BUCKETS not in used:
            used.add(crc(str(i)) % BUCKETS)
            items[len(items)] = i
    right = [(k, n, items[crc(f"s{k}") % BUCKETS], None, None) for k in range(40) for n in range(2)]
    got = check_files(spark, left, right, tmp_path / "a")
    assert not any(r["rewritten"] for r in got if r["table_name"] == "right")
    assert {r["rewritten"] for r in got if r["table_name"] == "left"} == {False, True}


@pytest.mark.parametrize("sides", [(0, 0), (5, 0), (0, 5)])
def test_files_of_empty_tables(spark, tmp_path, sides):
    left = [(k, "x", 1.0, 1) for k in range(sides[0])]
    right = [(k, 1, k, None, None) for k in range(sides[1])]
    got = check_files(spark, left, right, tmp_path / "a")
    assert {r["table_name"] for r in got} == {n for n, k in zip(("left", "right"), sides) if k}
    assert START in RIGHT and FINAL not in RIGHT  # the clash is really there


# --- phrases -----------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_removal(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(w), sum(gone), spans, hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def phrase_texts():
    rng = random.Random(11)
    some = lambda n, k=400: [f"w{rng.randrange(k)}" for _ in range(n)]
    hot, pieces = some(60), [some(n) for n in (34, 35, 36, 80)]
    texts = [None, "", " \n\t\x0b", "one", " ".join(some(34)), "é " * 50, "a b " * 200, "\x1f".join(some(50)), "x y " * 40]
    base = some(300)
    texts += [" ".join(base)] * 3  # copies
    for i in range(40):  # near copies, which share windows around their changes
        edited = list(base)
        for _ in range(rng.randrange(1, 6)):
            edited[rng.randrange(300)] = f"new{rng.randrange(9)}"
        texts.append(" ".join(edited[: rng.randrange(200, 301)]))
    for i in range(60):  # one passage in many different contexts, others in some
        parts = [some(rng.randrange(0, 40), 10**6), hot if i % 2 else some(30), some(rng.randrange(0, 40), 10**6)]
        if i % 5 == 0:
            parts.insert(rng.randrange(3), rng.choice(pieces))
        texts.append(rng.choice([" ", "  ", "\n"]).join(x for p in parts for x in p))
    return texts + [" ".join(some(5000, 10**6))]


def test_phrases_equal_brute_force(spark):
    texts = phrase_texts()
    rows = [(None if i == 3 else i, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int").withColumnRenamed("n_words", "row").withColumn("d", F.lit(1))
    got = {r["doc_id"]: r for r in repeated_phrases(df, words_per_shard=3000, keep_text=True).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(plain_removal(texts, 35)):
        r = got[None if i == 3 else i]
        assert (r["n_words"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[:4], i
        assert r["kept"] == (want[4] if want[1] else None)
    assert repeated_phrases(df.limit(0)).count() == 0


@pytest.mark.parametrize("window,span", [(8, 5), (20, 12)])
def test_phrases_of_other_lengths(spark, window, span):
    rng = random.Random(window)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 120))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeated_phrases(df, window=window, span=span, words_per_shard=500).collect()}
    assert got == {i: x[:4] for i, x in enumerate(plain_removal(texts, window))}


def test_a_very_long_text(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(10**7)}" for _ in range(400_000))  # some MB
    passage = " ".join(long.split()[200_000:200_050])
    df = spark.createDataFrame([(1, long), (2, "start " + passage + " end")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in repeated_phrases(df).collect()}
    assert got == {1: (400_000, 50), 2: (52, 50)}


def test_automaton_finds_all_places():
    rng = random.Random(4)
    phrases = [[rng.choice("abc") for _ in range(rng.randrange(1, 6))] for _ in range(12)]
    automaton = PhraseAutomaton(" ".join(p).encode() for p in phrases)
    for _ in range(200):
        words = [rng.choice("abcd") for _ in range(rng.randrange(0, 30))]
        want = [False] * len(words)
        for p in phrases:
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    want[i : i + len(p)] = [True] * len(p)
        assert automaton.covered([x.encode() for x in words]).tolist() == want
    assert not PhraseAutomaton(iter([])).covered([b"a"]).any()


def test_equal_windows_have_equal_entries():
    rng = random.Random(6)
    passage = " ".join(f"p{rng.randrange(500)}" for _ in range(100))
    a = WordHashes((passage + " tail" * 3).encode()).entries(35, 28)
    b = WordHashes(("head of it " + passage).encode()).entries(35, 28)
    assert len(set(a[3].tolist()) & set(b[3].tolist())) >= 3
    assert sum(a[1]) == 103 - 34 and sum(b[1]) == 103 - 34


# --- hard negatives -----------------------------------------------------------


def plain_negatives(rows, positives=5, negatives=3, low=50, high=95, modulus=50):
    rows = [(i, [int(np.floor(256 * x)) for x in v], y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (i, v, y) in enumerate(rows):
        if i % modulus:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for n, (j, w, z) in enumerate(rows) if n != at and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            fit = [x for x in scored if x[2] != y and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, r, k, -s, -t) for r, (t, k, _) in enumerate(fit, 1)]
    return sorted(out)


def vectors(seed, n=400, width=6, labels=4):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=(n, width)), 1)  # coarse, so scores tie
    return [(i, [float(x) for x in v[i]], int(rng.integers(labels))) for i in range(n)]


def test_negatives_equal_brute_force(spark):
    rows = vectors(1) + [(50, [0.5] * 6, None), (100, None, 1), (None, [1.0] * 6, 1), (150, [1.0, None] * 3, 1), (401, [float("nan")] + [1.0] * 5, 2), (402, [float("inf")] * 6, 2), (403, [], 1)]
    rows += [(i, [0.3, 0.3, 0.3, 0.0, 0.0, 0.0], i % 4) for i in range(500, 620)]  # one vector for many ids
    rows += [(700, [1.0, 2.0], 1), (701, [1.0, 2.0], 1), (702, [1.0, 1.0], 2)]  # of another length
    rows += rows[:7]  # repeated rows, an anchor among them
    df = spark.createDataFrame([(i, v, y, 1.0, "x") for i, v, y in rows], "vec_id long, embedding array<double>, label int, score double, row string")
    want = plain_negatives(rows)
    assert sorted(map(tuple, hard_negatives(df).collect())) == want
    # small blocks must change nothing
    assert sorted(map(tuple, hard_negatives(df, rows_per_block=64, anchors_per_block=3).collect())) == want
    assert hard_negatives(df.limit(0)).count() == 0


def test_negatives_of_wide_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3) * 2.0**18], i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, hard_negatives(df, anchor_modulus=10).collect())) == plain_negatives(rows, modulus=10)
    # scores beyond a long are held at its ends
    far = [(0, [1e9], 1), (1, [1e9], 1), (2, [1e9], 2), (3, [6e8], 2)]
    got = hard_negatives(spark.createDataFrame(far, "vec_id long, embedding array<double>, label int")).collect()
    assert all(r["positive_score"] == 2**63 - 1 for r in got)


def test_limits_and_ties():
    for score in (-7, -1, 0, 1, 2, 3, 7, 100, 2**63 - 1, -(2**63)):
        least, most = score_limits(score, 50, 95)
        assert 50 * score <= 100 * least and 100 * (least - 1) < 50 * score
        assert 100 * most <= 95 * score and 100 * (most + 1) > 95 * score
    scores = np.array([5, 9, 9, 1, 9, 5] * 20, np.int64)
    places = np.flatnonzero(np.arange(120) % 2 == 0)
    assert best_of(scores, places, 4).tolist() == sorted(places.tolist(), key=lambda i: (-scores[i], i))[:4]


# --- prefix tables ---------------------------------------------------------------


def test_prefix_tables_of_awkward_rows(spark):
    pytest.importorskip("public_tokenizers")
    from tidemark.llm.token_counts import prefix_tables, within_budget

    rows = [(None, "one two"), (1, "one two"), (1, "one two"), (2, None), (3, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, prefix_tokens string")
    got = prefix_tables(df).withColumns({"fits": within_budget("prefix_tokens", 1), "none": within_budget(F.lit(None).cast("array<int>"), 3)}).collect()
    assert Counter((r["doc_id"], len(r["prefix_tokens"])) for r in got) == Counter({(None, 8): 1, (1, 8): 2, (2, 1): 1, (3, 1): 1})
    assert all(r["prefix_tokens"][0] == 0 and r["none"] is None for r in got)
    assert len({r["fits"] for r in got if r["doc_id"] in (None, 1)}) == 1
    assert prefix_tables(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        within_budget("prefix_tokens", -1)
