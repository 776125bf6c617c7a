"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and the odd rows of the corpus fixture."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from conftest_llm import BENCH, corpus, prose
from pyspark.sql import functions as F

from brackwater.llm import chat, common, decontam, katz, licenses, packing, quality_gam, quality_rules, sharding, simhash, toxicity
from brackwater.llm.queries import tokenizer_path

TEXTS = [(i, t or "") for i, t, *_ in corpus()]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def ascii_words(t):
    return re.findall("[^\x20\x09-\x0d]+", t)


# --- decontamination


def hits(text, items):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    hit, found = set(), set()
    for name, t in items:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
        for i in range(max(1, len(w) - 9) if w else 0):
            win = w[i : i + 10]
            for j in range(len(words) - len(win) + 1):
                if words[j : j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    found.add(str(name))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("lot_bytes", [1 << 20, 100])
def test_decontamination(spark, docs, lot_bytes):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = decontam.digest(decontam.search(decontam.build_index(docs, lot_words=700), bench, lot_bytes=lot_bytes)).collect()
    want = sorted(((i is None, i or 0), *hits(t, BENCH)) for i, t in TEXTS)
    assert sorted(((r[0] is None, r[0] or 0), *r[1:5]) for r in got) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)
    assert {r["doc_id"] for r in got if r["contaminated"]} == {109, 110, 111}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b x c d"), (2, "a b x x x x x x x x x x x c d"), (3, "d c b a"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "a b c d")], "item_id long, text string")
    near = {r["doc_id"]: r["near_item_ids"] for r in decontam.search(decontam.build_index(docs), bench, slop=2).collect()}
    assert near == {1: ["9"], 2: [], 3: ["9"], 4: []}


def brute_near(words, window, reach):
    return any(set(window) <= set(words[i : i + reach]) for i in range(len(words)))


@pytest.mark.parametrize(("window", "slop"), [(3, 0), (3, 2), (5, 3), (20, 0), (20, 7), (4, 90)])
def test_proximity_against_brute_force(spark, window, slop):
    r = np.random.default_rng(window + slop)
    texts = [" ".join(r.choice(list("abcdefghijkl"), r.integers(0, 40), p=[0.3, 0.2, 0.1, *[0.4 / 9] * 9])) for _ in range(60)]
    items = [" ".join(r.choice(list("abcdefghijkl"), n)) for n in (2, 3, 4, 6, 25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(items)], "item_id string, text string")
    got = {x["doc_id"]: x["near_item_ids"] for x in decontam.search(decontam.build_index(docs, lot_words=300), bench, window=window, slop=slop).collect()}
    for i, t in enumerate(texts):
        want = [f"i{k}" for k, q in enumerate(items) for w in [q.split()] if any(brute_near(t.split(), w[j : j + window], min(window, len(w)) + slop) for j in range(max(1, len(w) - window + 1)))]
        assert got[i] == sorted(set(want))


def test_empty_index(spark, empty):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontam.search(decontam.build_index(empty), bench).count() == 0
    assert decontam.digest(decontam.search(decontam.build_index(spark.createDataFrame([(1, "x y")], "doc_id long, text string")), bench.limit(0))).first()["n_words"] == 2


# --- chat


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|end|>", "a\\|b<|turn|>", "\\", "<", "<<|", "", None, "<|image|> é\n日本", "\\\\<\\|", "[[/INST]"]
    rows = [(c, i, "assistant" if i % 2 else "user", t, "x") for c in (1, None) for i, t in enumerate(nasty)] + [(5, 0, None, "lone", "x"), (5, 0, None, "lone", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    for r in chat.read_back(chat.format_conversations(turns)).collect():
        own = [x for x in rows if x[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["losses"] == [x[3] or "" for x in own if x[2] == "assistant"]
    d = {r["conv_id"]: r for r in chat.chat_digest(turns).collect()}
    said = "".join(t or "" for t in nasty[1::2])
    assert d[1]["loss_chars"] == len(said) and d[1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and d[5]["n_turns"] == 2
    assert chat.chat_digest(turns.limit(0)).count() == 0


def test_chat_parts(spark):
    rows = [(1, 0, "user", [("text", "see <|image|>", None, None), ("image", None, "a.png", 3), ("audio", None, "b.wav", 4), ("text", "!", None, None)]), (1, 1, "assistant", [("document", None, "c.pdf", None), ("text", "ok", None, None)]), (1, 2, "user", None)]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS_TYPE}")
    f = chat.format_conversations(turns, "parts")
    r = f.first()
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "a.png", 768), ("audio", "b.wav", 100), ("document", "c.pdf", 512)]
    assert r["placeholder_tokens"] == 1380 and r["formatted"].count("<|image|>") == 1
    b = chat.read_back(f).first()
    assert [t["text"] for t in b["turns"]] == ["see <|image|>!", "ok", ""] and b["losses"] == ["ok"]
    with pytest.raises(Exception, match="unknown kind"):
        chat.format_conversations(spark.createDataFrame([(1, 0, "user", [("film", None, "x", 1)])], turns.schema), "parts").collect()


@pytest.mark.parametrize("control", [chat.END, chat.TURN, "</s>", "<s>", "[INST]", "[/INST]", "\\|end|>", "<\\|end|>"])
def test_control_strings_over_several_parts(spark, control):
    cuts = [(control[:i], control[i:j], control[j:]) for i in range(len(control) + 1) for j in range(i, len(control) + 1)]
    rows = [(k, i, "assistant", [("text", t, None, None) for t in cut] + [("image", None, "a", 1), ("text", cut[1], None, None)]) for k, cut in enumerate(cuts) for i in (0, 1)]
    f = chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS_TYPE}"), "parts")
    back = chat.read_back(f).collect()
    assert len(back) == len(cuts)
    for r in back:
        said = control + cuts[r["conv_id"]][1]
        assert r["losses"] == [said] * 2 and [t["text"] for t in r["turns"]] == [said] * 2
        own = r["formatted"].replace(chat.END, "").replace(chat.TURN, "").replace(chat.SAYS, "").replace("<|image|>", "")
        assert control.startswith("\\") or control not in own


# --- packing


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = packing.pack_documents(docs, tokenizer_path(), with_ids=True).toPandas()
    want = Counter()
    for i, t in TEXTS:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            b = np.array(ids[k : k + 4096], "<u4").tobytes()
            want[(i if i is not None else -1, k // 4096, k, len(b) // 4, zlib.crc32(b))] += 1
    cols = got[["doc_id", "piece", "start", "length", "ids_crc32"]].fillna(-1).astype("int64")
    assert Counter(map(tuple, cols.to_numpy().tolist())) == want
    assert all(zlib.crc32(b) == c for b, c in zip(got["ids"], got["ids_crc32"], strict=True))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 4096


def test_encoder_agrees_with_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    e = packing.encoder(tokenizer_path())
    assert e.known
    for s in ["a <|endoftext|> b", "x<|startoftext|>y Z<|ENDOFTEXT|> <|endoftext|><|endoftext|>", "<|endoftext", "é<|endoftext|>é", "İstanbul it's 'RE foo bar\x1cz ½ ² ﬁ é 日本 <|endoftext|> Σας ΣΑΣ 12a3", "ÀÖ×÷ß Ÿ naïve, (x) é  a b", "a" * 3000]:
        assert np.frombuffer(e(s.encode()), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids


def test_unknown_tokenizers_get_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    kind = json.loads(Tokenizer.from_file(tokenizer_path()).to_str())
    kind["normalizer"] = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": "x"}, {"type": "Lowercase"}]}
    (tmp_path / "t.json").write_text(json.dumps(kind))
    e, t = packing.encoder(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json"))
    assert not e.known
    assert np.frombuffer(e(b"joined  by a letter"), "<u4").tolist() == t.encode("joined  by a letter", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_sweep_places_all_and_is_tight(seed):
    r = np.random.default_rng(seed)
    sizes = r.integers(1, 101 if seed % 2 else 60, 700)
    counts = {int(k): int(v) for k, v in zip(*np.unique(sizes, return_counts=True), strict=True)}
    bins, placed = {}, Counter()
    for length, rank, n, first, stride, offset in packing.sweep(counts, 100):
        for i in range(n):
            placed[(length, rank + i)] += 1
            bins.setdefault(first + i * stride, []).append((offset, length))
    assert placed == Counter({(k, i): 1 for k, n in counts.items() for i in range(n)})
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 100
    best = []  # best fit, longest first
    for s in sorted(sizes, reverse=True):
        fit = [j for j, g in enumerate(best) if g >= s]
        if fit:
            best[min(fit, key=lambda j: best[j])] -= s
        else:
            best.append(100 - s)
    assert len(bins) <= len(best) and len(bins) <= 1.02 * math.ceil(sizes.sum() / 100) + 8


def test_packing_empty(empty):
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


# --- near-duplicates


def brute_fingerprint(t):
    w = ascii_words(lower(t))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(pairs):
    ids = list(range(len(pairs)))

    def root(x):
        while ids[x] != x:
            x = ids[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 3:
                ids[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return [low.get(root(i)) for i in range(len(pairs))]


@pytest.mark.parametrize("share", [simhash.SHARE, 3])
def test_simhash(spark, docs, share, monkeypatch):
    monkeypatch.setattr(simhash, "SHARE", share)
    got = simhash.digest(simhash.near_duplicates(docs)).collect()
    pairs = [(i, brute_fingerprint(t)) for i, t in TEXTS]
    want = Counter((i, f"{f:016x}", c) for (i, f), c in zip(pairs, brute_components(pairs), strict=True))
    assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("heavy", [4_000_000, 20])
def test_links_of_crowded_fingerprints(spark, heavy, monkeypatch):
    r = np.random.default_rng(3)
    base = [int(x) for x in r.integers(0, 1 << 63, 4, dtype=np.uint64)]
    fps = {b ^ sum(1 << int(k) for k in r.choice(64, r.integers(0, 5), replace=False)) for b in base for _ in range(60)} | {int(x) for x in r.integers(0, 1 << 63, 50, dtype=np.uint64)}
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {x["node"]: x["root"] for x in simhash.components(simhash.link_forest(df, lot=40, per_bucket=100)).collect()}
    want = brute_components(list(zip(range(len(fps)), fps, strict=True)))
    label = [roots.get(s, s) for s in signed]
    assert len(set(zip(label, want, strict=True))) == len(set(label)) == len(set(want))


def test_crowded_bucket_units():
    r = np.random.default_rng(5)
    fps = np.unique(np.uint64(7) ^ (np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64)))
    a, b = simhash._links(fps, fps)
    assert len(np.unique(b)) == 1 and len(a) == len(fps) - 1


# --- classifiers


@pytest.fixture(scope="module")
def judged(spark):
    rows, labels = [], []
    for i in range(900):
        good, toxic = i % 3 > 0, i % 5 == 0
        t = prose(i, 60 + i % 50)
        t = t if good else t.upper().replace(" ", "!! ")
        rows.append((i, t + (f" you vilex{'abc'[i % 3]} person" if toxic else ""), "en"))
        labels.append((i, int(good), int(toxic)))
    rows += [(9000, None, "en"), (9001, "", "en"), (None, "x", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([*labels, (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_quality_gam(judged):
    docs, labels = judged
    feats = quality_gam.text_features(docs, ["doc_id"])
    got = quality_gam.scored(feats, quality_gam.train(docs, labels)).toPandas()
    assert len(got) == 903 and got["score"].between(0, 1).all()
    held = got[got["doc_id"].map(lambda d: d == d and d < 900 and zlib.crc32(str(int(d)).encode()) % 5 == 0)]
    assert ((held["score"] >= 0.3) == (held["doc_id"] % 3 > 0)).mean() > 0.98
    none = quality_gam.scored(feats, quality_gam.train(docs, labels.limit(0))).toPandas()
    assert (none["score"] == 0.5).all()


def test_gam_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_gam.fit(x[:3000], y[:3000], coarse=6)
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_toxicity(judged):
    docs, labels = judged
    got = toxicity.score_texts(docs, toxicity.train(docs, labels), ["doc_id"]).toPandas()
    assert len(got) == 903 and got["score"].between(0, 1).all()
    held = got[got["doc_id"].map(lambda d: d == d and d < 900 and zlib.crc32(str(int(d)).encode()) % 5 == 0)]
    assert ((held["score"] >= 0.5) == (held["doc_id"] % 5 == 0)).mean() > 0.98
    assert set(toxicity.score_texts(docs, toxicity.train(docs, labels.limit(0)), ["doc_id"]).toPandas()["score"]) == {0.0}


def test_toxicity_scores_each_text_by_itself(judged):
    """Scores and activations don't depend on the text that comes after, be it as toxic as can be."""
    r = np.random.default_rng(0)
    texts = [toxicity.word_codes(prose(i, 30).encode() + (b" vile" if i % 2 else b"")) for i in range(60)]
    m = toxicity.fit(texts, np.array([i % 2 for i in range(60)], np.float32), epochs=2)
    some = [toxicity.word_codes(prose(i, n).encode()) for i, n in enumerate((0, 1, 2, 3, 9))]
    alone = [m.score([t])[0] for t in some]
    loud = toxicity.word_codes(b"vile " * 3)
    assert m.score([x for t in some for x in (t, loud)])[::2] == pytest.approx(alone, abs=1e-6)
    assert m.score([some[i] for i in r.permutation(5)]) == pytest.approx([alone[i] for i in np.random.default_rng(0).permutation(5)], abs=1e-6)


def test_classifiers_on_empty_tables_and_repeated_ids(judged, spark):
    docs, labels = judged
    none = docs.limit(0)
    assert quality_gam.scored(quality_gam.text_features(none, ["doc_id"]), quality_gam.train(none, labels)).count() == 0
    assert toxicity.score_texts(none, toxicity.train(none, labels), ["doc_id"]).count() == 0
    hot = docs.unionByName(spark.createDataFrame([(7, prose(7, 50), "en")] * 300, docs.schema))
    assert quality_gam.scored(quality_gam.text_features(hot, ["doc_id"]), quality_gam.train(hot, labels)).count() == 1203
    assert toxicity.score_texts(hot, toxicity.train(hot, labels), ["doc_id"]).count() == 1203


# --- sharding


def test_sharding(spark, docs, empty):
    p = sharding.shard_digest(docs, 5).toPandas()
    assert len(p) == len(TEXTS) and ((p["grown_shard"] == p["shard"]) | (p["grown_shard"] == 5)).all()
    for _, g in p.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    sizes = Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in TEXTS)
    assert Counter((None if i != i else int(i), s, c) for i, s, c in zip(p["doc_id"], p["size"], p["text_crc32"], strict=True)) == sizes
    assert (p.groupby("doc_id")["shard"].nunique() == 1).all()
    assert sharding.shard_digest(empty).count() == 0
    many = sharding.shard(spark.range(20000).withColumnRenamed("id", "doc_id"), weights=[1.0, 2.0, 1.0]).groupBy("shard").count().toPandas().set_index("shard")["count"]
    assert abs(many[1] - 10000) < 300
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit(1), [1.0, 0.0])


def test_an_added_shard_of_another_weight_only_takes(spark):
    keys = spark.range(20000).withColumnRenamed("id", "doc_id")
    of = lambda weights: sharding.shard_of(F.col("doc_id"), weights)
    moved = keys.select(of([1.0] * 24).alias("a"), of([1.0] * 24 + [2.0]).alias("b")).where("a <> b").groupBy("b").count().collect()
    assert [r["b"] for r in moved] == [24] and abs(moved[0]["count"] - 20000 * 2 / 26) < 200


def test_ranked_over_many_tasks(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("k"))
    p = common.ranked(df, ["g"], ["k"], "r", 10).toPandas()
    assert all(sorted(x["r"]) == list(range(len(x))) for _, x in p.groupby("g"))


def test_listed_rows(spark, monkeypatch):
    """Marks that many keys share, so that most rows pass in vain, and null keys."""
    df = spark.createDataFrame([(i % 90 if i % 7 else None, f"t{i % 11}", i) for i in range(500)], "a long, b string, c long")
    listed = common.materialize(df.where("c % 13 = 0").select("a", "b").distinct(), "listed")
    own = {(r["a"], r["b"]) for r in listed.collect()}
    for bits in (common.MARKS, 64):
        monkeypatch.setattr(common, "MARKS", bits)
        key = [F.col("a"), F.col("b")]
        assert sorted(r["c"] for r in common.only(df, key, listed).collect()) == [r["c"] for r in df.orderBy("c").collect() if (r["a"], r["b"]) in own]
        assert sorted(r["c"] for r in common.without(df, key, listed).collect()) == [r["c"] for r in df.orderBy("c").collect() if (r["a"], r["b"]) not in own]
    assert common.maybe(df, key, listed.limit(0))[0].count() == 0


# --- licenses


def test_licenses(spark, empty):
    rows = [
        ("a/LICENSE", "Intro\nReleased under the MIT License."), ("a/b/x.txt", "nothing"), ("a/b/c/y.txt", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/c/z.txt", None), ("d/e.txt", "the of 2"), ("COPYING", "Licensed under the Apache License, Version 2.0"), ("top.txt", ""), (None, "Licensed under CC BY-NC 4.0."), ("a/bb/x.txt", "mit"), ("a/b/x.txt", "nothing"),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "path string, text string"), []).collect()
    by = {r["path"]: r for r in got}
    assert len(got) == len(rows)
    assert {p: (r["license"], r["inherited_from"]) for p, r in by.items()} == {
        "a/LICENSE": ("MIT", None), "a/b/x.txt": ("MIT", "a"), "a/b/c/y.txt": ("GPL-3.0", None), "a/b/c/z.txt": ("MIT", "a"), "d/e.txt": ("Apache-2.0", ""),
        "COPYING": ("Apache-2.0", None), "top.txt": ("Apache-2.0", ""), None: ("CC-BY-NC-4.0", None), "a/bb/x.txt": ("MIT", "a"),
    }
    assert licenses.scan(licenses.corpus_files(empty), ["doc_id"]).count() == 0


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
REAL = [
    ("MIT", MIT), ("MIT", MIT.split("\n", 4)[4]), ("MIT", "The MIT License (MIT)"), ("MIT", "Released under the MIT License. See the file LICENSE in the root of this repository."),
    ("MIT", "// intro\n//\n" + "".join(f"// {x}\n" for x in MIT.splitlines()[4:])),
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-3.0", "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\nimport os"),
    ("GPL-2.0", " * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version."),
    ("MPL-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"),
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n"),
    ("Apache-2.0", '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    (None, "The license plate of the general public is free software for nobody. A version of 2 or 3 apache helicopters."), (None, "It was permitted to redistribute the books, with or without a license, to any person in the city."),
]


@pytest.mark.parametrize("tail", ["", "\n\n" + prose(3, 200), " " + prose(4, 20)])
def test_real_headers_and_licences(spark, tail):
    cut = [(want, text) for want, text in REAL if not tail.startswith(" ") or text.rstrip()[-1] == "."]  # a header's last sentence may go on
    files = spark.createDataFrame([(f"{i}/{'COPYING' if i % 2 else 'a.py'}", text + tail) for i, (_, text) in enumerate(cut)], "path string, text string")
    got = {r["path"].split("/")[0]: r["own_license"] for r in licenses.scan(files, []).collect()}
    assert {str(i): got[str(i)] for i in range(len(cut))} == {str(i): want for i, (want, _) in enumerate(cut)}


def test_each_template_has_a_key_word():
    assert all(set(re.findall("[a-z0-9]+", t.lower())) & set(licenses.KEY_WORDS) for ts in licenses.TEMPLATES.values() for t in ts)


# --- quality rules


def brute_rules(t):
    w = ascii_words(t)
    lines = [x for x in t.split("\n") if ascii_words(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_quality_rules(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    got = quality_rules.judge(docs, labels, ["doc_id"]).collect()
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[c] for c in cols) for r in got) == Counter((i, *brute_rules(t)) for i, t in TEXTS)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    assert quality_rules.judge(empty, labels, ["doc_id"]).count() == 0


def test_binomial_tail():
    for k, n, p in ((2, 10, 0.3), (0, 5, 0.5), (7, 10, 0.3), (3, 400, 0.01), (9, 9, 0.2)):
        assert quality_rules.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-12)
    assert quality_rules.binomial_tail(9_000, 1_000_000, 0.01) < 1e-20


def test_policies_as_a_whole_keep_their_promise():
    """Good documents for which each of two rules is harmless, but not both: the holdout stops the path after the first."""
    counts = pd.DataFrame({"stratum": 0, "at": [0, 1, 2], "good": [5, 9, 1986]})
    path = [("upper_share", 0.5), ("digit_share", 0.5)]
    assert quality_rules.certify(counts, {0: path}, 0.01, 0.05) == {0: path[:1]}
    assert quality_rules.certify(counts, {0: path[::-1]}, 0.01, 0.05) == {0: path[:0:-1]}
    assert quality_rules.certify(counts.assign(good=[0, 0, 400]), {0: path}, 0.01, 0.05) == {}  # too few to prove anything
    assert quality_rules.certify(counts.assign(good=[0, 0, 440]), {0: path}, 0.01, 0.05) == {0: path}


def test_learned_cutoffs_against_brute_force(spark):
    """4,000 labelled documents, enough for cutoffs to be proven in one stratum and in no other; verdicts recomputed from the texts."""
    rows, labels = [], []
    r = np.random.default_rng(2)
    for i in range(4000):
        good = i % 4 > 0
        t = prose(i, 30 + i % 40) if i % 50 else prose(i, 150)
        if not good:
            t = t.upper() if i % 8 else t.replace(" ", "$ ")
        elif r.random() < 0.001:
            t = t.upper()
        rows.append((i, t))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    stats = quality_rules.rule_stats(docs, ["doc_id"])
    cutoffs = quality_rules.learn_cutoffs(stats, known)
    assert {s for s, _, _ in cutoffs} == {0} and {rule for _, rule, _ in cutoffs} >= {"upper_share"}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *quality_rules.RULES]
    want = {}
    for i, t in rows:
        x = dict(zip(names, quality_rules._stats(t.encode()), strict=True))
        want[i] = not brute_rules(t)[-1] and not any(x[rule] > c for s, rule, c in cutoffs if (x["n_words"] >= 100) == (s > 0))
    got = {x["doc_id"]: x["kept"] for x in quality_rules.judge(docs, known, ["doc_id"]).collect()}
    assert got == want
    short = [i for i, t in rows if i % 50]
    assert sum(not got[i] for i in short if i % 4) < 0.01 * 2940 and sum(not got[i] for i in short if not i % 4) > 900


# --- language model


def brute_katz(rows, order):
    end = ""
    toks = [[*ascii_words(lower(t)), end] for _, t in rows]
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for i, _ in rows]
    grams = [Counter() for _ in range(order + 1)]
    hist = [Counter() for _ in range(order + 1)]
    for ws, tr in zip(toks, train, strict=True):
        seq = [end] * (order - 1) + ws
        for p in range(order - 1, len(seq)) if tr else ():
            for n in range(1, order + 1):
                g = tuple(seq[p - n + 1 : p + 1])
                grams[n][g] += 1
                hist[n][g[:-1]] += 1
    total = sum(grams[1].values())
    disc = [None] + [katz.good_turing(np.array([0] + [sum(v == r for v in grams[n].values()) for r in range(1, 7)])) for n in range(1, order + 1)]
    kept = lambda n, c: float(disc[n].of(np.array([c]))[0])
    unknown = 1 - sum(kept(1, c) for c in grams[1].values()) / total
    alphas = {}

    def p(g):
        n = len(g)
        if n == 1:
            return kept(1, grams[1][g]) / total if grams[1][g] else unknown
        if grams[n][g]:
            return kept(n, grams[n][g]) / hist[n][g[:-1]]
        if not hist[n][g[:-1]]:
            return p(g[1:])
        if g[:-1] not in alphas:
            seen = [x for x in grams[n] if x[:-1] == g[:-1]]
            alphas[g[:-1]] = (1 - sum(kept(n, grams[n][x]) for x in seen) / hist[n][g[:-1]]) / (1 - sum(p(x[1:]) for x in seen))
        return alphas[g[:-1]] * p(g[1:])

    out = []
    kinds = len(grams[1])
    for (i, _), ws, tr in zip(rows, toks, train, strict=True):
        seq = [end] * (order - 1) + ws
        s = sum(math.log10(p(tuple(seq[q - order + 1 : q + 1]))) for q in range(order - 1, len(seq)))
        b = sum(math.log10((grams[1][(w,)] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws)
        out.append((i, not tr, len(ws), sum(grams[1][(w,)] > 0 for w in ws), total, b, s))
    h = next(iter(hist[order]))
    mass = sum(p((*h, w)) for (w,) in grams[1]) + p((*h, "never seen"))
    return out, mass


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz(docs, order, monkeypatch):
    monkeypatch.setattr(katz, "PER_BUCKET", 900)
    got = katz.score(docs, order, lot_tokens=500).collect()
    want, mass = brute_katz(TEXTS, order)
    assert mass == pytest.approx(1, abs=1e-9)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_katz_without_training(spark, empty):
    assert katz.score(empty).count() == 0
    held = [i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    got = katz.score(spark.createDataFrame([(i, "a b", 1) for i in held], "doc_id long, text string, lot int")).collect()
    assert [(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got] == [(0, 0, 0.0, 0.0)] * 2
