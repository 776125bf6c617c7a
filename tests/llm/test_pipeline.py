"""run() of the pipeline against a brute-force version of all five stages."""

import os
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from conftest_llm import BENCH, corpus, prose
from pyspark.sql import functions as F
from test_operators import brute_fingerprint, brute_rules, hits

import corpus_pipeline
from brackwater.llm import common, quality_gam, shingles, simhash
from brackwater.llm.features import features
from brackwater.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def one_of_each(rows):
    """All pairs at 0.8 or more, their components, and of each the row with the smallest doc_id; all doc_ids given."""
    rows = sorted(set(rows))
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [r for i, r in enumerate(rows) if find(i) == i]


def expected(rows, labels):
    """(doc_id, text) of the documents that stages 1 to 4 keep; the classifier is fitted anew, on the same labels, in the order of doc_ids."""
    left = [(i, t or "") for i, t, *_ in rows]
    left = [(i, t) for i, t in left if not brute_rules(t)[-1]]
    known = dict(labels)
    learn = [(features(t.encode()), known[i]) for i, t in left if i in known and zlib.crc32(str(i).encode()) % 5]
    model = quality_gam.fit(np.array([x for x, _ in learn]), np.array([y for _, y in learn], float))
    left = [(i, t) for i, t in left if model.score(np.array([features(t.encode())]))[0] >= 0.3]
    left = one_of_each(left)
    return [(i, t) for i, t in left if not hits(t, BENCH)[1]]


def test_run(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, labels = corpus(), []
    for i in range(1000, 1400):
        good = i % 3 > 0
        t = prose(i, 60 + i % 50)
        rows.append((i, t if good else t.upper().replace(" ", "!! "), "en", "s", 0))
        labels.append((i, int(good)))
    rows += [(2000, rows[-1][1], "en", "s", 0), (2001, prose(1001, 60 + 1001 % 50) + " end", "de", "t", 0)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    want = expected(rows, labels)
    assert 200 < len(want) < 400
    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = Counter()
    for i, t in want:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            b = np.array(ids[k : k + 4096], "<u4").tobytes()
            pieces[(i, k // 4096, k, len(b) // 4, zlib.crc32(b))] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    cols = got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype("int64")
    assert Counter(map(tuple, cols.to_numpy().tolist())) == pieces
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 4096


def test_run_on_empty_tables(spark, tmp_path):
    for name, schema in {"documents": SCHEMA, "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def jaccard(a, b):
    x, y = shingle_set(a), shingle_set(b)
    return len(x & y) / len(x | y)


def test_near_dedup_finds_similar_texts_beyond_three_bits(spark):
    rows = [(i, prose(i, 150)) for i in range(100)]
    for i in range(60):  # a changed word or two in the middle costs up to ten of 146 shingles
        w = prose(i, 150).split()
        for at in range(40, 40 + 50 * (1 + i % 2), 50):
            w[at] = "changed"
        rows.append((1000 + i, " ".join(w)))
    w = prose(70, 150).split()
    rows.append((2000, " ".join("changed" if k % 30 == 3 else x for k, x in enumerate(w))))
    assert all(jaccard(rows[100 + i][1], rows[i][1]) >= 0.8 for i in range(60)) and jaccard(rows[-1][1], rows[70][1]) < 0.8
    beyond = [i for i in range(60) if (brute_fingerprint(rows[100 + i][1]) ^ brute_fingerprint(rows[i][1])).bit_count() > 3]
    assert beyond
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r["doc_id"] for r in got) == [*range(100), 2000]


ODD = [(None, prose(1, 50)), (None, prose(2, 50)), (None, prose(2, 50)), (None, "in front " + BENCH[0][1]), (3, prose(3, 50)), (5, prose(3, 50)), (5, prose(4, 50)), (6, prose(5, 50)), (6, "x " + BENCH[0][1]), (7, prose(6, 50)), (7, prose(6, 50)), (8, None)]


def test_null_and_repeated_ids_lose_no_text(spark):
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(ODD, "doc_id long, text string"), "").collect()
    # the benchmark texts behind "in front" and "x" are near copies, and a row with an id goes before one without
    want = {(None, prose(1, 50)), (None, prose(2, 50)), (3, prose(3, 50)), (5, prose(4, 50)), (6, prose(5, 50)), ODD[8], (7, prose(6, 50)), (8, None)}
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(want)


def test_decontamination_judges_rows(spark, tmp_path):
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.decontaminate(spark, spark.createDataFrame(ODD, "doc_id long, text string"), str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter(r for r in ODD if BENCH[0][1] not in (r[1] or ""))


@pytest.mark.parametrize("block", [64, 3])
def test_crowded_keys_are_compared_whole(spark, monkeypatch, block):
    """Families of texts around 0.8: many share keys, few are linked, and chains along the hashes' order alone would miss links."""
    monkeypatch.setattr(shingles, "BLOCK_TEXTS", block)
    rows, r = [], np.random.default_rng(4)
    for f in range(3):
        base = prose(100 + f, 80).split()
        for _ in range(60):
            w = list(base)
            for at in r.choice(80, r.integers(1, 4), replace=False):
                w[at] = f"w{r.integers(0, 3)}"
            rows.append(" ".join(w))
    rows = list(enumerate(rows))
    sketched = [shingles.band_keys(shingles.shingles(t.encode())) for _, t in rows]
    shared = {i: {j for j in range(len(rows)) if (sketched[i] == sketched[j]).any()} for i in range(len(rows))}
    assert max(map(len, shared.values())) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = shingles.sketches(docs).groupBy("node").agg(F.first("keys").alias("keys"))
    meetings = shingles.met(nodes)
    assert meetings.agg(F.max("n")).first()[0] > shingles.NEXT + 1
    got = sorted(x["doc_id"] for x in shingles.one_of_each(docs).collect())
    assert got == [i for i, _ in one_of_each(rows)] and 3 < len(got) < 150


def test_crowded_key_of_two_groups_and_strangers(spark):
    """A key's largest component, a second one, and texts like neither; links across the order of hashes only."""
    r = np.random.default_rng(9)
    sets = {n: np.unique(r.integers(0, 40, 30).astype(np.uint64)) for n in range(40)}
    frame = pd.DataFrame({"key": 1, "node": list(sets), "root": [n if n % 3 else 0 for n in sets], "minor": [bool(n % 3) for n in sets]})
    left = spark.createDataFrame(frame)
    table = spark.createDataFrame([(n, s.tobytes()) for n, s in sets.items()], "node long, shingles binary")
    like = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.5
    root = dict(zip(frame["node"], frame["root"], strict=True))
    want = {(a, b) for a in sets for b in sets if b < a and root[a] != root[b] and like(a, b)}
    assert want and {tuple(x) for x in shingles.crowded_links(left, table, 0.5).collect()} == want


def test_stages_leave_clashing_columns_alone(spark, tmp_path):
    names = ["n_words", "score", "features", "__hit", "__text", "kept", "base_failed", "node", "__id", "low", "key", "sequence_id", "length"]
    rows = [(i, prose(i, 60), *(f"{n}{i}" for n in names)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    spark.createDataFrame([(i, 1, 0) for i in range(9)] + [(99, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema == docs.schema and sorted(map(tuple, out.collect())) == rows
    assert {r["doc_id"] for r in corpus_pipeline.packed(spark, docs, str(tmp_path)).collect()} == set(range(12))


def test_near_dedup_meets_by_segments_of_simhash_fingerprints(spark, monkeypatch):
    """Fingerprints and groups by brute force: pairs that agree in a segment and are near meet, unlike texts don't."""

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    r = np.random.default_rng(6)
    sets = []
    for n in (1, 3, 5, 14, 16, 60, 300):
        for _ in range(4):
            base = r.integers(0, 1 << 63, n + n // 4, dtype=np.uint64)
            sets += [base[:n], base[n // 5 :], base]
    keys = [shingles.band_keys(s) for s in sets]
    for s, k in zip(sets, keys, strict=True):
        bits = [sum(mixed(int(h) ^ int(seed)) >> i & 1 for h in s) * 2 > len(s) for seed in shingles._SEEDS[: len(k) // 4] for i in range(64)]
        assert k.view(np.uint16).tolist() == [sum(b << j for j, b in enumerate(bits[i : i + 16])) for i in range(0, len(bits), 16)]

    same = {}
    for i, k in enumerate(keys):
        same.setdefault(k[:8].tobytes(), []).append(i)
    want = {frozenset(x) for x in same.values() if len(x) > 1}
    away = lambda x, y: (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count()
    for s in range(2 * shingles.SEGMENTS):
        left = [f for f, x in same.items() if len(keys[x[0]]) > s]
        while left:
            chain, left = [left[0]], left[1:]
            for f in chain:
                near = [g for g in left if keys[same[g][0]][s] == keys[same[f][0]][s] and away(f, g) <= (38 if s < shingles.SEGMENTS else 44)]
                chain += near
                left = [g for g in left if g not in near]
            if len(chain) > 1:
                want.add(frozenset(i for f in chain for i in same[f]))
    nodes = spark.createDataFrame([(i, k.tolist()) for i, k in enumerate(keys)], "node long, keys array<short>")
    got = shingles.grouped(nodes).groupBy("key").agg(F.collect_list("node").alias("nodes")).collect()
    assert len(want) > 20 and sorted(sorted(x["nodes"]) for x in got) == sorted(map(sorted, want))

    values, close = np.zeros(400, np.uint16), r.integers(0, 1 << 64, (400, 2), np.uint64)
    values[200:] = 7
    whole = dict(zip(*map(np.ndarray.tolist, shingles.segment_groups(values, close, 50)), strict=True))
    monkeypatch.setattr(shingles, "RUN", 1)  # crowded segment values
    assert len(whole) > 50 and dict(zip(*map(np.ndarray.tolist, shingles.segment_groups(values, close, 50)), strict=True)) == whole


@pytest.mark.parametrize("common, a, b", [(4, 0, 1), (12, 0, 3), (20, 2, 3), (264, 33, 33), (264, 0, 66)])
def test_pairs_at_least_similarity_meet(common, a, b):
    r = np.random.default_rng(7)
    for _ in range(200):
        s = r.integers(0, 1 << 63, common + a + b, dtype=np.uint64)
        x, y = shingles.band_keys(s[: common + a]), shingles.band_keys(np.concatenate([s[:common], s[common + a :]]))
        n = min(len(x), len(y))
        away = np.bitwise_count(x[:8].view(np.uint64) ^ y[:8].view(np.uint64)).sum()
        few = (x[:n] == y[:n])[shingles.SEGMENTS :]
        assert ((x[:n] == y[:n])[: shingles.SEGMENTS].any() and away <= shingles.NEAR) or (few.any() and away <= shingles.NEAR_FEW)


def test_near_copies_write_rows_in_proportion_to_texts(spark, monkeypatch):
    """One large group of texts around 0.8, which meet under many segments: tables grow with the texts, not with the pairs or the segments that they share."""
    base, r = prose(50, 120).split(), np.random.default_rng(8)
    rows = []
    for i in range(300):
        w = list(base)
        for at in r.choice(120, r.integers(1, 4), replace=False):
            w[at] = f"w{r.integers(0, 1000)}"
        rows.append((i, " ".join(w)))
    written, write = [], shingles.materialize
    monkeypatch.setattr(shingles, "BLOCK_TEXTS", 100)
    monkeypatch.setattr(shingles, "materialize", lambda df, name: (t := write(df, name), written.append((name, t.count())))[0])
    monkeypatch.setattr(shingles, "components", lambda links, own=shingles.components: (written.append(("components", links.count())), own(links))[1])
    got = sorted(x["doc_id"] for x in shingles.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [i for i, _ in one_of_each(rows)]
    assert max(n for _, n in written) <= 6 * len(rows)


def test_fingerprints_numbers_are_those_of_spark(spark):
    a, b = np.random.default_rng(1).integers(0, 1 << 64, (2, 50), np.uint64)
    table = spark.createDataFrame(pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}))
    assert sorted(x[0] for x in table.select(F.xxhash64("a", "b")).collect()) == sorted(shingles._number(a, b).tolist())


def test_near_dedup_leaves_no_pair_out(spark):
    """Two texts at 0.8 whose SimHash fingerprints agree in no segment at a near distance: 24 shingles, and the same with 6 more."""
    r = np.random.default_rng(296733)
    w = [f"w{x}" for x in r.integers(0, 10**6, 28)]
    rows = [(0, " ".join(w)), (1, " ".join(w + [f"w{x}" for x in r.integers(0, 10**6, 6)]))]
    assert jaccard(rows[0][1], rows[1][1]) == 0.8
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert [x["doc_id"] for x in got] == [0]


def test_families_hold_all_pairs_at_least_similarity(spark, monkeypatch):
    """Against brute force, whatever the shingles' order: small and large sets, pairs at just 0.8, and a word that all texts share."""
    r = np.random.default_rng(12)
    rows = [" ".join(f"w{x}" for x in r.integers(0, 1000, n)) for n in (1, 2, 4, 5, 6, 8, 9, 12, 14, 19, 24, 30, 54, 104, 204) for _ in range(4)]
    for t in list(rows):
        w = t.split()
        n = max(1, len(w) - 4)
        rows += [" ".join(["a", *w]), " ".join(w + ["b"] * (n // 4)), " ".join([f"c{k}" for k in range(n // 8)] + w + [f"d{k}" for k in range(n // 8)]), " ".join(w[: len(w) - n // 5])]
    rows = list(enumerate(dict.fromkeys(rows)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    node = {x["doc_id"]: x["node"] for x in docs.select("doc_id", shingles.text_hash().alias("node")).collect()}
    sets = [shingle_set(t) for _, t in rows]
    want = [(i, j) for i in range(len(rows)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    assert len(want) > 100
    found = shingles.materialize(shingles.counted(docs), "counted")
    order = shingles.ranks(found)
    assert 0 < np.count_nonzero(order) <= sum(map(len, sets))
    for ranks, per_bucket in ((order, 500_000), (np.zeros_like(order), 1_000)):
        monkeypatch.setattr(shingles, "PER_BUCKET", per_bucket)
        key = {x["node"]: x["key"] for x in shingles.families(found.where("part IS NULL"), docs, ranks).collect()}
        assert all(key[node[i]] == key[node[j]] for i, j in want)
        assert len(set(key.values())) > 20


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    t = " ".join(f"w{i * 7919}" for i in range(3000)).encode()
    whole = shingles.shingles(t)
    monkeypatch.setattr(shingles, "PIECE", 100)
    assert len(whole) == 2996 and (shingles.shingles(t) == whole).all()


def test_large_sets_meet_though_some_shingles_are_the_same_32_bits():
    """Of two sets of 5,000, the 198 shingles that they have to share are entered; two pairs of them are the same within their bucket."""
    cls = int(shingles._class(5_000.0))
    n = int(shingles._SHARED[cls])
    keys = np.arange(n, dtype=np.uint32)
    keys[[1, 3]] = keys[[0, 2]]
    u, v, shared, needed = shingles.prefix_links(np.tile(keys, 2), np.repeat([7, 9], n), np.full(2 * n, cls, np.uint8))
    assert n > 100 and (u.tolist(), v.tolist(), shared.tolist()) == ([9], [7], [n - 2])
    assert needed[0] <= shared[0]


def test_near_dedup_leaves_only_lists_behind(spark, monkeypatch):
    """Tables of texts, hashes and links go once they are read, also where a family's blocks aren't joined; what the result still reads is lists of rows."""
    monkeypatch.setattr(shingles, "BLOCK_TEXTS", 3)
    r, rows = np.random.default_rng(4), []
    base = prose(100, 80).split()
    for i in range(60):
        w = list(base)
        for at in r.choice(80, r.integers(1, 4), replace=False):
            w[at] = f"w{r.integers(0, 3)}"
        rows.append((i, " ".join(w)))
    written, write = [], common.materialize
    keep = lambda df, name: (t := write(df, name), written.append((name, t._written_to)))[0]
    for module in (common, shingles, simhash):
        monkeypatch.setattr(module, "materialize", keep)
    got = shingles.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    there = {name for name, path in written if os.path.exists(path.removeprefix("file:"))}
    assert "unjoined" in dict(written) and "crowded" in dict(written) and there <= {"gone", "vain", "marks"}
    assert sorted(x["doc_id"] for x in got.collect()) == [i for i, _ in one_of_each(rows)]


def shuffled(plan):
    """Bytes that a plan that has run wrote for its exchanges."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled(plan.plan())
    own = plan.metrics().apply("shuffleBytesWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


@pytest.mark.parametrize("marks", [1 << 26, 1 << 9])
def test_rows_are_taken_out_without_moving_them(spark, monkeypatch, marks):
    """Half of the rows are listed; few marks, so that many rows pass in vain, change nothing."""
    monkeypatch.setattr(common, "MARKS", marks)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        r = np.random.default_rng(2)
        path = common.materialize(spark.createDataFrame([(i if i % 7 else None, r.bytes(4_000).hex()) for i in range(600)], "id long, text string"), "rows")
        key = [F.col("id"), shingles.text_hash("text")]
        listed = common.materialize(path.where("coalesce(id, 0) % 2 = 0").select("id", shingles.text_hash("text").alias("h")), "listed")
        out = common.without(path, key, listed)
        assert sorted(x["id"] for x in out.collect()) == [i for i in range(600) if i % 7 and i % 2]
        if marks > 1 << 20:
            assert shuffled(out._jdf.queryExecution().executedPlan()) < 200_000  # the listed texts are 2.7 MB
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
