"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter
from fractions import Fraction
from math import erf, exp, floor, log

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import stages
from tidemark.llm.common import hot_keys, salted_join
from tidemark.llm.exact_search import exact_topk, search_block
from tidemark.llm.jaccard_join import connected, jaccard_join
from tidemark.llm.language_id import codewords, identify_language
from tidemark.llm.licenses import RULES, SENTENCES, scan_licences
from tidemark.llm.mixing import mix_sources, targets
from tidemark.llm.neighbours import balanced_parts, index_vectors, neighbour_graph, nearest
from tidemark.llm.packing import best_fit, cuts, pack_documents, pack_tiers
from tidemark.llm.quality import PENALTY, STATISTICS, RuleEnsemble, _lasso, learn_quality, score_quality, statistics
from tidemark.llm.repeats import _suffix_order, repeat_spans
from tidemark.llm.token_counts import MODEL, PrefixCounter, prefix_tables, token_counts, within_budget

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score string, i long, t string"


def docs(spark, rows):
    """rows of (doc_id, text, lang, source), with extra columns that clash with inner names."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "k", "x", 1, "t") for i, t, lang, s in rows], SCHEMA)


def awkward(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(["ana", "bel", "cor", "dun", "eli", "fox"]) + rng.choice("aeiou") for _ in range(n))
    same = words(60)
    rows = [(1, None, "en", None), (2, "", None, "a"), (3, same, "en", "a"), (4, same, "fr", "b"), (4, same, "fr", "b"), (None, words(40), "fr", "b"), (6, words(9000), "en", "a"), (7, "é" * 300, "fr", "b"), (8, " \n\t", "en", "a"), (9, "123 !!", "en", "a"), (10, same.replace("ana", "anb", 1), "en", "a")]
    return docs(spark, rows + [(20 + i, words(50), "en" if i % 2 else "fr", "ab"[i % 2]) for i in range(10)])


OPERATORS = {
    "licences": scan_licences, "tokens": token_counts, "repeats": repeat_spans, "language": identify_language, "mixing": mix_sources, "jaccard": jaccard_join, "packing": pack_documents,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_back_and_empty_tables_give_none(spark, name):
    df = awkward(spark)
    got = OPERATORS[name](df)
    ids = Counter(r["doc_id"] for r in (got.where("start = 0") if name == "packing" else got).collect())
    assert ids == Counter(r["doc_id"] for r in df.collect())
    assert OPERATORS[name](df.limit(0)).count() == 0


def test_licence_rules_take_the_longest_sequence(spark):
    s = SENTENCES
    bsd = "\n\n".join(s[k] for k in ("bsd_redistribution", "bsd_source", "bsd_binary"))
    rows = [(1, f"Intro.\n# {s['mit_released']}\nmore", "en", "a"), (2, bsd, "en", "a"), (3, bsd + "\n\n" + s["bsd_endorse"], "en", "a"), (4, "from from\nLicensed under CC BY-NC 4.0.", "en", "a"), (5, "SPDX-License-Identifier: Apache-2.0", "en", "a"), (6, "a licence to kill", "en", "a")]
    got = {r["doc_id"]: r["licenses"] for r in scan_licences(docs(spark, rows)).collect()}
    assert got == {1: "MIT", 2: "BSD-2-Clause", 3: "BSD-3-Clause", 4: "CC-BY-NC-4.0", 5: "Apache-2.0", 6: ""}


def test_licences_in_comment_headers(spark):
    s = SENTENCES
    block = lambda paragraphs, lead: "\n".join(lead + line for p in paragraphs for line in [*textwrap.wrap(p, 60), ""])
    mit = ["Copyright (c) 2020 Some One", s["mit_grant"], s["mit_condition"], s["mit_warranty"]]
    bsd = [s[k] for k in ("bsd_source", "bsd_binary", "bsd_endorse")]
    marked = lambda mark: "\n".join(["Copyright 2020, Some One", s["bsd_redistribution"], *[mark(i) + x for i, x in enumerate(bsd, 1)]])
    wrapped = lambda text: "\n".join(line for x in text.split("\n") for line in textwrap.wrap(x, 60))
    gpl = s["gpl3_or_later"].replace("software: you", "software:\nyou")
    texts = ["/*\n" + block(mit, " * ") + "\n */\nint main() {}", block(mit, "# "), block(mit, "// "), block(mit, "dnl "), block(mit, "")]
    texts += [wrapped(marked(lambda i: f"{i}. ")), wrapped(marked(lambda i: f"({i}) ")), wrapped(marked(lambda i: " * ")), block([gpl], ""), gpl]
    texts.append("/*\n" + "\n".join(" * " + x for x in wrapped(marked(lambda i: f"{i}. ")).split("\n")) + "\n */")
    got = {r["doc_id"]: r["licenses"] for r in scan_licences(docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(11)] == ["MIT"] * 5 + ["BSD-3-Clause"] * 3 + ["GPL-3.0-or-later"] * 2 + ["BSD-3-Clause"]


def plain_scan(text, sentences=SENTENCES, rules=RULES):
    """Licences by word sequences alone: known sentences wherever their words stand, then rules in order."""
    words = lambda x: re.findall("[a-z0-9]+", x.lower())
    known = {name: words(re.split(r"[.!?;] ", x)[0]) for name, x in sentences.items()}
    have, found, at = words(text), [], 0
    while at < len(have):
        here = [(len(w), name) for name, w in known.items() if have[at : at + len(w)] == w]
        found += [max(here)[1]] if here else []
        at += max(here)[0] if here else 1
    out = []
    while found:
        for licence, ids in rules:
            if found[: len(ids)] == list(ids):
                out.append(licence)
                found = found[len(ids) :]
                break
        else:
            found = found[1:]
    return out


def test_licences_equal_a_search_for_word_sequences(spark):
    rng = random.Random(21)
    s, texts = SENTENCES, []
    filler = lambda: " ".join(rng.choice(["ana", "bel", "cor", "dun"]) for _ in range(rng.randint(3, 30))) + "."
    decorate = [lambda p: p, lambda p: "\n".join("# " + x for x in textwrap.wrap(p, 60)) + "\n#", lambda p: "\n".join(" * " + x for x in textwrap.wrap(p, 50)) + "\n *"]
    for _ in range(150):
        style, blocks = rng.choice(decorate), []
        for _ in range(rng.randint(0, 3)):
            _, ids = rng.choice(RULES)
            blocks += [style(filler()), *[style(s[x]) for x in ids]]
        texts.append("\n\n".join([*blocks, filler()]))
    got = {r["doc_id"]: r["licenses"] for r in scan_licences(docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        assert got[i] == ",".join(plain_scan(text)), text


def test_licences_with_names_and_expressions(spark):
    s = SENTENCES
    bsd = "\n".join(f"{i}. {x}" for i, x in enumerate([s["bsd_source"], s["bsd_binary"], s["bsd_endorse"].replace("the copyright holder", "Some One Inc.")], 1))
    texts = {
        "BSD-3-Clause": s["bsd_redistribution"] + "\n" + bsd,
        "MIT,Apache-2.0": "SPDX-License-Identifier: MIT OR Apache-2.0",
        "GPL-2.0-or-later,BSD-3-Clause": "// SPDX-License-Identifier: (GPL-2.0-or-later WITH Some-exception) AND BSD-3-Clause",
        "GPL-3.0-only": "      GNU GENERAL PUBLIC LICENSE\n        Version 3, 29 June 2007\n\n Everyone is",
        "CC0-1.0": "To the extent possible under law, J. Doe has waived all copyright and related or neighboring rights to Some Work.",
    }
    got = {r["doc_id"]: r["licenses"] for r in scan_licences(docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts.values())])).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts)
    # an identifier that ends in another one is another one
    sentences, rules = {"a_licence": "a licence one", "xa_licence": "xa licence two"}, (("ONE", ("a_licence",)),)
    found = scan_licences(docs(spark, [(1, "xa licence two", "en", "a"), (2, "a licence one", "en", "a")]), sentences=sentences, rules=rules).collect()
    assert {r["doc_id"]: r["licenses"] for r in found} == {1: "", 2: "ONE"}


def test_exact_search(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.integers(-2, 3, (120, 9)) / 3.0)]
    rows += [(200, None), (250, [1.0, None] * 4 + [1.0]), (300, [float("nan")] * 9), (350, [1.0, 2.0]), (50, rows[50][1])]
    got = exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), rows_per_block=30, queries_per_block=1)
    valid = {i: np.floor(256 * np.array(v, np.float32).astype(float)) for i, v in rows[:120]}
    for q in (0, 50, 100):
        best = sorted((-int(valid[q] @ v), i) for i, v in valid.items() if i != q)[:5]
        assert [(-r["score"], r["vec_id"]) for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == best


def test_wide_integers_are_exact():
    q, r = np.array([[2.0**24, 1.0]]), np.array([[2.0**24, 1.0], [2.0**24, 2.0]])
    got = search_block(np.array([9]), q, np.array([1, 2]), r, 5)
    assert got["score"].tolist() == [2**64 + 2 * 2**16, 2**64 + 2**16] or got["vec_id"].tolist() == [2, 1]


def test_repeated_neighbours_take_one_place(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((1000, 64))
    x[7] = 2 * x[0]  # the best neighbour of query 0, six times
    x[9] = 1.5 * x[0]  # an id with two vectors, both of them near
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())] * 5 + [(9, (1.4 * x[0]).tolist())] + [(0, x[0].tolist())] * 5
    got = exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    whole = np.floor(256 * np.array([v for _, v in rows]))
    for q in (0, 50, 100):
        score = {}
        for (i, _), s in zip(rows, whole @ whole[q]):
            score[i] = max(score.get(i, s), s)
        best = sorted((-int(s), i) for i, s in score.items() if i != q)[:5]
        assert [(-r["score"], r["vec_id"]) for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == best


def test_nearest_reaches_its_recall_with_routing(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16))
    x = centres[rng.integers(0, 12, 1500)] + 0.3 * rng.standard_normal((1500, 16))
    x[:400] = x[0]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, [0.0] * 16), (5020, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    # the parameters of the query, but for blocks that make it meet several
    for blocks in ({}, {"rows_per_block": 200, "queries_per_block": 30}):
        got = nearest(df, **blocks).toPandas()
        hit = total = 0
        for q in range(0, 1500, 20):
            s = x @ x[q]
            s[q] = -np.inf
            kth = np.sort(s)[-20]
            mine = got[got.query_id == q]
            assert len(mine) == 20 and (mine.sort_values("rank").score.diff().dropna() <= 0).all()
            hit, total = hit + (mine.score >= kth - 1e-9).sum(), total + 20
        assert hit / total >= 0.9
    # that recall comes from routing: a query meets a part of the rows only
    indexed, index = index_vectors(df)
    sizes = np.bincount([r["part"] for r in indexed.collect()], minlength=index.last + 1)
    asked = pd.Series([v.tolist() for v in x[::20]])
    met = [sizes[p].sum() for p in index.visits(asked, sizes, 160)]
    assert index.last >= 32 and np.mean(met) < 0.7 * len(x)


def test_parts_are_balanced():
    x = np.random.default_rng(3).standard_normal((400, 8))
    sizes = np.bincount(balanced_parts(neighbour_graph(x, 8), 8))
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 2


def test_token_counts_at_every_prefix():
    import sentencepiece

    file = public_tokenizers.path(MODEL)
    sp, counter, rng = sentencepiece.SentencePieceProcessor(model_file=file), PrefixCounter(file), random.Random(4)
    for _ in range(120):
        text = "".join(rng.choice("abcdeth  ing\n\t.,<>/0x▁é中🙂_-=") for _ in range(rng.randint(0, 30)))
        counts = counter.prefix_counts(text)
        assert counts == [len(sp.encode(text[:i])) for i in range(len(text) + 1)]
        budget = rng.randint(0, 12)
        assert counter.fit(text, budget) == max(i for i, n in enumerate(counts) if n <= budget)


def brute_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[s : s + length] for d in data for s in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot_core", [1, 4096])
def test_repeats_equal_brute_force(spark, hot_core):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(260)
    texts = [word(300) + passage + word(200), passage + word(150), word(90) + passage[10:] + "é", "a" * 500, "ab" * 150, None, "", "x" * 199, word(3000)]
    texts += [word(rng.randint(1, 40)) + passage[: rng.randint(195, 260)] + word(30) for _ in range(8)] + [texts[0]]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    got = repeat_spans(docs(spark, rows), hot_core=hot_core).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_repeats(texts)


def test_language_and_codes(spark):
    assert len({tuple(r) for r in codewords(4).T}) == 7 and len({tuple(r) for r in codewords(20)}) == 20
    rng = random.Random(7)
    say = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(40))
    parts = {"en": ["the", "ing", "and"], "de": ["sch", "ung", "ein"], "fr": ["eau", "tion", "oui"]}
    rows = [(i, say(parts[lang]), lang, "a") for i, lang in enumerate(list(parts) * 40)]
    got = identify_language(docs(spark, rows + [(900, "12 !", "en", "a"), (901, None, "en", "a")])).toPandas().set_index("doc_id")
    assert all(got.lang_pred[i] == lang for i, _, lang, _ in rows) and got.score.between(0, 1).all()
    assert got.lang_pred[900] == got.lang_pred[901] == "und"
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in got.held_out.items())


def test_mixing_meets_targets(spark):
    assert targets(np.array([100, 100, 100]), np.array([5.0, 2.0, 1.0]), 450.0).tolist() == pytest.approx([200, 500 / 3, 250 / 3])
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(0, 60), "en", rng.choice(["a", "b", "c", None])) for i in range(600)]
    df = docs(spark, rows)
    got, again = mix_sources(df).toPandas(), mix_sources(df.repartition(3)).toPandas()
    assert (got.taken <= 2 * got["size"]).all() and dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 30


def test_long_chains_of_documents_are_one_group(spark):
    rng = random.Random(13)
    words = [rng.choice("abcdefghij") + str(i) for i in range(2000 * 10 + 104)]
    order = rng.sample(range(2000), 2000)  # ids do not follow the chain
    got = jaccard_join(docs(spark, [(i, " ".join(words[10 * at : 10 * at + 104]), "en", "a") for i, at in enumerate(order)])).toPandas()
    assert set(got.class_id) == {0} and sorted(got.n_links) == [1] * 2 + [2] * 1998


def test_hot_keys_are_told_by_rows_at_every_size(spark):
    # 1,100 rows among 8 million, where the mean over 65,536 slots of a hash is 122
    n = 8_000_000
    rows = spark.range(n).select(F.when(F.col("id") < 1_100, F.lit(-7)).otherwise(F.col("id")).alias("key"))
    mark = hot_keys(rows, "key", 1_024)
    asked = spark.createDataFrame([(-7,), (5_000,), (n - 1,), (None,)], "key long")
    assert {r["key"]: r["hot"] for r in mark(asked).collect()} == {-7: True, 5_000: False, n - 1: False, None: False}
    # a slot of the filter has one other of these keys on average
    assert 1_100 <= mark(rows).where("hot").count() <= 1_110


def test_salted_join_splits_a_key_with_half_of_all_rows(spark):
    n = 1_000_000
    many = spark.range(n).select(F.col("id").alias("row"), F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id")).alias("key"))
    once = spark.range(0, n, 3).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "200", "-1")):
            spark.conf.set(k, v)
        for how, expected in (("inner", 500_000 + 166_667), ("left", n), ("left_semi", 500_000 + 166_667)):
            got = salted_join(many, once, ["key"], ["row"], 1_024, 64, how)
            tasks = got.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).head()
            assert tasks[0] == expected and tasks[1] < 0.05 * n
        wrong = salted_join(many, once, ["key"], ["row"], 1_024, 64, "left").where(
            ~F.col("twice").eqNullSafe(F.when(F.col("key") % 3 == 0, F.col("key") * 2))
        )
        assert wrong.count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_salted_join_takes_empty_tables_and_null_keys(spark):
    some, none = spark.createDataFrame([(1, 5), (2, None)], "row long, key long"), spark.createDataFrame([], "key long, x int")
    assert salted_join(some, none, ["key"], ["row"], 1, 4, "left").count() == 2
    assert salted_join(some, none, ["key"], ["row"], 1, 4).count() == 0
    assert salted_join(some.limit(0), none, ["key"], ["row"], 1, 4).count() == 0


def test_connected_equals_brute_force(spark):
    rng = random.Random(14)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(190)] + [(1000 + i, 1001 + i) for i in range(300)] + [(2000 + i, 3000) for i in range(50)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = connected(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == root


def test_jaccard_keeps_its_recall_in_a_large_group_of_near_copies(spark):
    rng = random.Random(12)
    base = [rng.choice("abcdefghij") + rng.choice("klmnop") + str(i) for i in range(104)]
    texts = []
    for _ in range(3000):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(len(w))] = "z" + str(rng.randrange(10**6))
        texts.append(w)
    assert len({tuple(w) for w in texts}) == 3000
    names: dict = {}
    has = np.zeros((3000, 40_000), np.float32)
    for i, w in enumerate(texts):
        for s in zip(*[w[k:] for k in range(5)]):
            has[i, names.setdefault(s, len(names))] = 1
    both, n = has @ has.T, has.sum(axis=1)
    near = both >= 0.8 * (n[:, None] + n[None, :] - both) - 1e-6
    links = near.sum(axis=1) - 1
    got = jaccard_join(docs(spark, [(i, " ".join(w), "en", "a") for i, w in enumerate(texts)])).toPandas().set_index("doc_id").n_links
    assert all(got[i] <= links[i] for i in range(3000))
    assert 1 - got.sum() / links.sum() <= 1e-5


def test_jaccard_equals_brute_force(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(120)) for _ in range(6)]
    rows, texts = [], []
    for b in base:
        for _ in range(12):
            w = b.split()
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = "zz" + str(rng.randrange(99))
            texts.append(" ".join(w))
    texts += [base[0].upper(), "one two", "one two", None, ""]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    sets = {i: set(zip(*[t.lower().split()[k:] for k in range(5)])) or ({tuple(t.lower().split())} if t else set()) for i, t, _, _ in rows if t}
    reps: dict = {}
    for i in sorted(sets):
        reps.setdefault(frozenset(sets[i]), i)
    ids = sorted(reps.values())
    links = Counter()
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links.update([a, b])
    for bucket in (1024, 4):  # 4: deep paths and pairs of blocks
        got = jaccard_join(docs(spark, rows), bucket=bucket).toPandas().set_index("doc_id")
        assert all(got.n_links[i] == links[reps[frozenset(sets[i])]] for i in sets)
        assert all(got.set_id[i] == reps[frozenset(sets[i])] for i in sets)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    for n in (1, 511, 512, 3584, 4095, 4096, 9000):
        got = cuts(n)
        assert [a for a, _ in got] == [sum(m for _, m in got[:k]) for k in range(len(got))] and sum(m for _, m in got) == n
    where, offset = best_fit([3, 2, 2, 1], 4)
    assert len(set(where)) == 2 and max(offset) < 4
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    df = awkward(spark)
    got = pack_documents(df).toPandas()
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in got.itertuples():
        key = None if pd.isna(r.doc_id) else int(r.doc_id)
        ids = np.array([*tk.encode(texts[key] or "", add_special_tokens=False).ids, 2], "<u4")
        assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096
    again = pack_documents(df.repartition(3)).toPandas()
    assert sorted(map(str, got.itertuples(index=False))) == sorted(map(str, again.itertuples(index=False)))


@pytest.mark.parametrize("seed", range(4))
def test_every_tier_is_packed(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5.5, 1.2, 4000).astype(int) + 1, 1, 4096).tolist() if seed else [1024, 700, 324, 5]
    window, offset, tier = pack_tiers(lengths)
    used = Counter()
    for w, o, n, t in zip(window, offset, lengths, tier):
        used.update((w, at) for at in range(o, o + n))
        assert o + n <= t
    assert max(used.values()) == 1 and len(used) == sum(lengths)
    fill = np.bincount(window, lengths)
    of = dict(zip(window, tier))
    assert all(fill[w] == t for w, t in of.items() if t < 4096)
    # windows of each tier hold pieces together
    if seed:
        assert {t for w, t in of.items() if (window == w).sum() > 1} == {4096, 2048, 1024, 512}


def test_quality_generalises(spark):
    rng = random.Random(10)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + rng.choice("abcdef") for _ in range(80)) + "."
    bad = lambda: " | ".join(rng.choice("xyz") * 5 for _ in range(60))
    rows = [(i, bad() if i % 4 == 0 else good(), "en", "a") for i in range(400)]
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(400)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = score_quality(docs(spark, rows + [(999, None, "en", "a"), (998, "", "en", "a")]), labels).toPandas().set_index("doc_id")
    held = got[got.held_out & (got.index < 400)]
    assert len(held) > 40 and ((held.index % 4 != 0) == (held.predicted == 1)).mean() > 0.97
    assert got.score.between(0, 1).all()
    assert score_quality(docs(spark, rows[:3]), labels.limit(0)).toPandas().score.tolist() == [0.5] * 3


def test_quality_columns_and_weights_equal_plain_ones(spark):
    rng = np.random.default_rng(15)
    x = rng.random((600, len(STATISTICS)))
    y = ((x[:, 1] > 0.6) | ((x[:, 2] < 0.3) & (x[:, 4] > 0.5))).astype(float)
    model = RuleEnsemble.fit(x, y)
    assert model.rules
    stats = spark.createDataFrame([([*map(float, row)],) for row in x], "v array<double>").select(
        F.struct(*[F.col("v")[i].alias(name) for i, name in enumerate(STATISTICS)]).alias("stats")
    )
    got = np.array([r[0] for r in stats.select(model.score()).collect()])
    plain = []
    for row in x.tolist():
        total = model.intercept
        for rule, weight in zip(model.rules, model.weights):
            total += weight * all((row[i] > value) == above for i, above, value in rule.conditions)
        plain.append(1 / (1 + np.exp(-total)))
    assert np.allclose(got, plain) and ((got >= 0.5) == (y == 1)).mean() > 0.97
    # the weights minimise loss and penalty: coordinate steps find nothing better
    r = np.stack([rule.holds(x) for rule in model.rules], axis=1).astype(float)
    w, b = _lasso(r, y, 0.0, steps=20_000)

    def cost(w, b):
        z = r @ w + b
        return np.mean(np.logaddexp(0, z) - y * z) + PENALTY * np.abs(w).sum()

    best = cost(w, b)
    for i in range(len(w)):
        for step in (1e-3, -1e-3):
            moved = w.copy()
            moved[i] += step
            assert cost(moved, b) >= best - 1e-6
    assert cost(w, b + 1e-3) >= best - 1e-6 and cost(w, b - 1e-3) >= best - 1e-6


def test_ids_above_doubles_stay_whole(spark):
    rng = random.Random(16)
    say = lambda: " ".join(rng.choice("abcdef") + rng.choice("klmno") for _ in range(60))
    big = [2**60 + 1, 2**60 + 3, -(2**60) - 5, None, 7]
    df = docs(spark, [(i, say(), "en" if n % 2 else "fr", "a") for n, i in enumerate(big)])
    labels = spark.createDataFrame([(i, 1, 0) for i in big], "doc_id long, quality int, toxic int")
    found = {name: op(df) for name, op in OPERATORS.items()} | {"quality": score_quality(df, labels)}
    for name, got in found.items():
        assert Counter(r["doc_id"] for r in got.collect()) == Counter(big), name
    joined = {r["doc_id"]: r["class_id"] for r in found["jaccard"].collect()}
    assert all(c == i for i, c in joined.items())
    vectors = spark.createDataFrame([(20 * (2**56 + n) if n is not None else None, [1.0, float(n or 0)]) for n in (1, 2, 3, None)], "vec_id long, embedding array<double>")
    for got in (exact_topk(vectors, query_modulus=20), nearest(vectors)):
        assert {r["query_id"] for r in got.collect()} == {r["vec_id"] for r in got.collect()} == {20 * (2**56 + n) for n in (1, 2, 3)}


def test_searches_and_quality_of_empty_tables_and_clashing_names(spark):
    schema = "vec_id long, embedding array<float>, key string, part string, v string, score string, rank int"
    rows = [(i, [float(i % 7), 1.0, float(i % 3)], "k", "p", "v", "s", 1) for i in range(1, 130)]
    df = spark.createDataFrame(rows, schema)
    for search in (exact_topk, nearest):
        assert search(df.limit(0)).count() == 0
        assert {r["query_id"] for r in search(df).collect()} >= {100}
    found = score_quality(awkward(spark).limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert found.count() == 0


def test_wide_vectors_against_integers(spark):
    rng = np.random.default_rng(17)
    x = [(rng.standard_normal(6) * 10.0 ** rng.integers(-1, scale)).tolist() for scale in (1, 4, 9, 12, 16, 300) for _ in range(25)]
    got = exact_topk(spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), query_modulus=7, rows_per_block=40).toPandas()
    whole = [[floor(256 * Fraction(c)) if abs(c) >= 2**45 else floor(256 * c) for c in v] for v in x]
    for q in range(0, len(x), 7):
        score = {i: sum(a * b for a, b in zip(whole[q], v)) for i, v in enumerate(whole) if i != q}
        held = {i: min(max(s, -(2**63)), 2**63 - 1) for i, s in score.items()}
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.score.tolist() == sorted(held.values(), reverse=True)[:5]
        assert [held[i] for i in mine.vec_id] == mine.score.tolist()


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(awkward(spark).select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    for limit in (4096, 100):
        for r in token_counts(df, limit=limit).collect():
            text = texts[r["doc_id"]]
            n = len(sp.encode(text))
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > limit)
            assert len(sp.encode(text[: r["fit_chars"]])) <= limit and (n > limit or r["fit_chars"] == len(text))
    short = {i: t for i, t in texts.items() if len(t) < 400}
    tables = prefix_tables(df.where(F.length(F.coalesce("text", F.lit(""))) < 400))
    for r in tables.withColumns({f"b{b}": within_budget("prefix_tokens", b) for b in (0, 5, 60)}).collect():
        text = short[r["doc_id"]]
        counts = [len(sp.encode(text[:i])) for i in range(len(text) + 1)]
        assert r["prefix_tokens"] == counts
        for b in (0, 5, 60):
            assert r[f"b{b}"] == max(i for i, n in enumerate(counts) if n <= b)


@pytest.mark.parametrize("n", range(1, 13))
def test_codewords_of_any_number_of_languages(n):
    code = codewords(n)
    assert len({tuple(row) for row in code}) == n and set(code.ravel()) <= {1.0, -1.0}


def test_language_equals_a_plain_version(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = df.select("doc_id", "text", "lang").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows}
    fold = {b: b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)}

    def grams(text):
        data = [32, *(fold[b] for b in text.lower().encode()), 32]
        return [(((a << 16 | b << 8 | c) * 2654435761) % 2**32) >> 16 for a, b, c in zip(data, data[1:], data[2:]) if b != 32]

    counts: dict = {}
    for r in rows:
        if r["lang"] is not None and r["text"] and not held[r["doc_id"]]:
            counts.setdefault(r["lang"], Counter()).update(x for x in grams(r["text"]) if x)
    names = sorted(counts)
    size = 1 << 16
    share = {k: [(counts[k][x] + 0.5) / (sum(counts[k].values()) + 0.5 * size) for x in range(size)] for k in names}
    code = codewords(len(names))
    bits = []
    for bit in code.T:
        one, zero = ([share[k] for k, b in zip(names, bit) if (b > 0) == side] for side in (True, False))
        w = [log(sum(a) / len(a)) - log(sum(b) / len(b)) for a, b in zip(zip(*one), zip(*zero))]
        w[0] = 0.0
        means = [sum(s * v for s, v in zip(share[k], w)) for k in names]
        spreads = [max(sum(s * v * v for s, v in zip(share[k], w)) - m * m, 1e-12) ** 0.5 for k, m in zip(names, means)]
        bits.append((w, sum(map(abs, means)) / len(means), [0.5 + 0.5 * erf(8 * m * b / d / 2**0.5) for m, d, b in zip(means, spreads, bit)]))
    got = {r["doc_id"]: r for r in identify_language(df).collect()}
    right = total = 0
    for r in rows[::7]:
        found = [x for x in grams(r["text"] or "") if x]
        if found:
            distance = []
            for k in range(len(names)):
                loss, trust = 0.0, sum(t[k] for _, _, t in bits)
                for (w, scale, t), b in zip(bits, code[k]):
                    margin = sum(w[x] for x in found) / len(found) / scale
                    loss += log(1 + exp(-2 * min(max(margin, -4), 4) * b)) * t[k] / trust
                distance.append(loss)
            assert got[r["doc_id"]]["lang_pred"] == names[distance.index(min(distance))]
            assert got[r["doc_id"]]["score"] == pytest.approx(1 / sum(exp(-4 * (d - min(distance))) for d in distance))
    for r in rows:
        if held[r["doc_id"]] and r["lang"] is not None and got[r["doc_id"]]["lang_pred"] != "und":
            right, total = right + (got[r["doc_id"]]["lang_pred"] == r["lang"]), total + 1
    assert total > 20 and right / total >= 0.95


def plain_targets(sizes, weights, total):
    free, out = set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        level = (total - sum(out[i] for i in range(len(sizes)) if i not in free)) / sum(weights[i] for i in free)
        over = {i for i in free if level * weights[i] >= 2 * sizes[i]}
        if not over:
            for i in free:
                out[i] = level * weights[i]
            break
        for i in over:
            out[i] = 2.0 * sizes[i]
        free -= over
    return out


def test_mixing_equals_a_plain_version(spark):
    rng = random.Random(18)
    for _ in range(50):
        sizes = [rng.choice([0, 5, 100, 10_000]) for _ in range(rng.randint(1, 9))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        assert targets(np.array(sizes), np.array(weights, float), 1.5 * sum(sizes)) == pytest.approx(plain_targets(sizes, weights, 1.5 * sum(sizes)))
    rows = [(i, "w " * rng.randint(0, 90), "en", rng.choice(["b", "a", "Z", "é", None])) for i in range(900)]
    # one row of a source very often, and many null ids of one size
    rows += [(5000, "w " * 40, "en", "a")] * 6000 + [(None, "w " * 11, "en", "b")] * 5000
    got = mix_sources(docs(spark, rows)).toPandas()
    assert len(got) == len(rows) and (got.taken == got.copies * got["size"]).all() and got.copies.between(0, 2).all()
    names = sorted({r[3] for r in rows if r[3]}) + [None]
    sizes = [sum(len(t.split()) for _, t, _, s in rows if s == name) for name in names]
    goal = plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes))
    for name, size, target in zip(names, sizes, goal):
        g = got[got.source.isna() if name is None else got.source == name]
        assert set(g.source_size) == {size} and g.target.iloc[0] == pytest.approx(target)
        assert abs(g.taken.sum() - target) <= 100
        if target < 2 * size:
            # entropy balancing: log(rate / (2 - rate)) is one multiple of the size, and the rates meet the target
            odds = np.log(g.rate / (2 - g.rate))
            some = g["size"] > 0
            assert np.ptp(odds[some] / g["size"][some]) < 1e-6 and (g.rate * g["size"]).sum() == pytest.approx(target, rel=1e-6)
    assert got[got.doc_id == 5000].copies.nunique() <= 2 and len(got[got.doc_id.isna()]) == 5000


def test_repeats_in_hot_cores_and_at_one_id(spark):
    rng = random.Random(19)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(230)
    # one core in many entries, which differ on both sides; rows that share an id
    texts = [word(rng.randint(1, 60)) + passage + word(rng.randint(1, 60)) for _ in range(1500)] + [word(500)] * 40
    got = repeat_spans(docs(spark, [(i % 3, t, "en", "a") for i, t in enumerate(texts)]).repartition(40)).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_repeats(texts)


def test_phrases_sort_like_bytes():
    rng = np.random.default_rng(20)
    for alphabet in (1, 2, 4, 200):
        rows = rng.integers(1, alphabet + 1, (400, 120)).astype(np.uint8)
        rows[100:300] = rows[rng.integers(0, 100, 200)]
        rows[200:300, rng.integers(20, 110) :] = 0
        group = rng.integers(0, 3, 400)
        order, common = _suffix_order(group, rows)
        for length in (1, 10, 16, 17, 60, 119, 120):
            mine, classes = np.cumsum(common < length), {}
            for place, i in enumerate(order.tolist()):
                classes.setdefault((group[i], rows[i, :length].tobytes()), set()).add(mine[place])
            assert all(len(x) == 1 for x in classes.values()) and len(set().union(*classes.values())) == len(classes)


def test_jaccard_of_rows_that_share_an_id(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, one, "en", "a"), (1, two, "en", "a"), (2, two, "en", "a"), (None, one, "en", "a")] + [(9, one, "en", "a")] * 1500
    got = jaccard_join(docs(spark, rows)).toPandas()
    assert len(got) == len(rows) and sorted(got.n_copies.unique()) == [2, 1502] and got.n_links.sum() == 0
    assert set(got.class_id) == {1} and got.root.nunique() == 2


def plain_stages(rows, labels_at, spark):
    """The first three stages over (doc_id, text), by plain loops: ids with texts that stay."""
    model = learn_quality(*labels_at)
    kept = []
    for i, text in rows:
        x = np.array([statistics(text)])
        total = model.intercept + sum(w for rule, w in zip(model.rules, model.weights) if rule.holds(x)[0])
        if 1 / (1 + np.exp(-total)) >= 0.3:
            kept.append((i, text))
    sets = []
    for _, text in kept:
        words = re.findall(r"[^ \t\n\v\f\r]+", (text or "").lower())
        sets.append({tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set())
    group = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least: dict = {}
    for (i, text), g, s in zip(kept, group, sets):
        least[g if s else ("alone", i)] = min(least.get(g if s else ("alone", i), (i, text)), (i, text), key=lambda x: x[0])
    single = sorted(least.values(), key=lambda x: x[0])
    data = [(t or "").encode() for _, t in single]
    seen = Counter(d[s : s + 200] for d in data for s in range(len(d) - 199))
    out = []
    for (i, text), d in zip(single, data):
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - 199):
            if seen[d[s : s + 200]] > 1:
                gone[s : s + 200] = True
        out.append((i, text if not gone.any() else np.frombuffer(d, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")))
    return out


def test_pipeline_equals_plain_loops(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    sf_dir = "/root/testdata/sf0.001"
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in whole.collect()]
    expected = plain_stages(rows, (whole, spark.read.parquet(f"{sf_dir}/labels.parquet")), spark)
    df = whole
    for name, stage in corpus_pipeline.STAGES[:3]:
        df = stage(spark, df, sf_dir)
        assert df.columns == whole.columns
    got = df.collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(expected)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    taken = Counter({r["doc_id"]: r["copies"] for r in mix_sources(df).collect()})
    mixed = corpus_pipeline.STAGES[3][1](spark, df, sf_dir)
    assert mixed.columns == whole.columns and Counter(r["doc_id"] for r in mixed.collect()) == +taken
    texts, tk = dict(expected), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = corpus_pipeline.run(spark, sf_dir).toPandas()
    tokens = {i: [*tk.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    assert pieces.length.sum() == sum(n * len(tokens[i]) for i, n in taken.items())
    for r in pieces.itertuples():
        assert zlib.crc32(np.array(tokens[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert Counter(pieces.doc_id[pieces.start == 0]) == +taken


def test_stages_keep_columns_and_one_of_each_group(spark):
    df = awkward(spark)
    kept = stages.one_of_each_group(spark, df, "")
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 3 in ids and 4 not in ids and 1 in ids and 2 in ids
    cut = stages.cut_repeats(spark, df, "")
    assert cut.columns == df.columns and cut.count() == df.count()
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[4] == "" and texts[1] is None
    mixed = stages.mix(spark, kept, "")
    assert mixed.columns == df.columns and mixed.count() > 0


def test_stages_leave_columns_of_their_own_names_alone(spark, tmp_path):
    df = awkward(spark).withColumns({x: F.lit(f"my {x}") for x in ("row", "Stats", "kept", "copies", "row_", "of_text")})
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (stages.keep_good, stages.one_of_each_group, stages.cut_repeats, stages.mix):
        got = stage(spark, df, str(tmp_path))
        assert got.columns == df.columns
        rows = got.collect()
        assert rows and all(r[x] == f"my {x}" for r in rows for x in ("row", "Stats", "kept", "copies", "row_", "of_text"))
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    assert stages.pack(spark, df.limit(0), "").count() == 0
