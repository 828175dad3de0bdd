"""Operators 5, 9 and 10 against brute force on small tables with nulls, ties, repeats, and hot groups."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lodestone.llm import base, embedding_dedup, ngram_join
from lodestone.llm.embedding_dedup import near_vectors, tables_for
from lodestone.llm.exact_dedup import PatriciaTrie, drop_exact_duplicates, exact_duplicates
from lodestone.llm.ngram_join import banding, drop_near_duplicates, near_duplicates


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 99)), max_size=60), st.sampled_from([1 << 20, 1500, 300]))
def test_trie_is_a_dictionary_even_when_it_spills(items, budget):
    trie, want = PatriciaTrie(min, budget), {}
    for key, owner in items:
        trie.add(key, owner)
        n = want.get(key, (owner, 0))
        want[key] = min(n[0], owner), n[1] + 1
    found = list(trie.items())
    assert len(found) == len(want) and {k: (o, n) for k, o, n in found} == want


def test_trie_spills_long_common_prefixes():
    trie = PatriciaTrie(min, 2000)
    keys = [b"x" * 100 + bytes([i % 7, i % 5, i]) for i in range(200)]
    for i, k in enumerate(keys):
        trie.add(k, i)
    assert trie.spills > 0 and sorted(k for k, _, _ in trie.items()) == sorted(keys)


def documents(spark, seed=1):
    rng = random.Random(seed)
    texts = ["", None, "a", "A", "a ", "long " * 20_000, "é", *(f"text {i % 9}" for i in range(40)), *["hot"] * 300]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, group_size int").repartition(5)


def test_op5_against_a_dictionary(spark):
    docs = documents(spark)
    rows = docs.collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    found = exact_duplicates(docs).collect()
    assert len(found) == len(rows)
    text = {r.doc_id: r.text or "" for r in rows}
    for r in found:
        g = groups[text[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(g), len(g), r.doc_id == max(g))
        assert r.text_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())


def test_op5_repeated_rows_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "b"), (None, "c")], "doc_id long, text string")
    found = exact_duplicates(docs).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in found) == sorted([("1", "1", 3, True), ("1", "1", 3, False), ("None", "1", 3, False), ("None", "2", 2, False), ("2", "2", 2, True), ("None", "None", 1, True)])
    assert drop_exact_duplicates(docs).count() == 3
    assert exact_duplicates(docs.limit(0)).count() == 0 and drop_exact_duplicates(docs.limit(0)).count() == 0


def test_op5_texts_of_one_sha_are_told_apart(spark, monkeypatch):
    from lodestone.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "_sha", lambda text: F.unhex(F.lit("00" * 32)))
    docs = documents(spark)
    groups = {}
    for r in docs.collect():
        groups.setdefault(r.text or "", []).append(r.doc_id)
    want = {d: (max(g), len(g), d == max(g)) for g in groups.values() for d in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_duplicates(docs, budget=20_000).collect()} == want
    monkeypatch.setattr(exact_dedup, "_key", lambda text: F.unhex(F.lit("00" * 40)))
    with pytest.raises(RuntimeError):
        exact_duplicates(docs)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1001 + i) for i in range(200)] + [(2000 + i, 2001 + i) for i in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in base.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {x: root(x) for x in parent}
    assert base.components(spark.createDataFrame([(1, 1)], "src long, dst long")).count() == 0


def near_table(spark, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    texts = ["", None, "one", "One!", "two words", "!!! ...", "long " * 5000 + "end"]
    for _ in range(12):
        base_text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            t = [w if rng.random() > rng.choice([0, 0.02, 0.1, 0.3]) else rng.choice(words) for w in base_text]
            texts += [" ".join(t)] * rng.choice([1, 1, 3])
    hot = [rng.choice(words) for _ in range(60)]
    for i in range(40):
        t = list(hot)
        t[i] = "changed"
        texts.append(" ".join(t))
    return spark.createDataFrame([(3 * i + 1, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, key int").repartition(4)


def brute_near(rows, n, threshold):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def grams(t):
        w = word.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode()))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())

    classes = {}
    for d, t in sorted(rows):
        classes.setdefault(t or "", []).append(d)
    sets = {g[0]: grams(t) for t, g in classes.items()}
    links, parent = {r: 0 for r in sets}, {r: r for r in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    reps = sorted(sets)
    for i, a in enumerate(reps):
        for b in reps[:i]:
            c = len(sets[a] & sets[b])
            if sets[a] and sets[b] and c >= threshold * (len(sets[a]) + len(sets[b]) - c):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (g[0], len(g), links[g[0]], root(g[0])) for g in classes.values() for d in g}


@pytest.mark.parametrize("block", [512, 7])
def test_op9_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "COMPONENT_BLOCK", 4 * block)
    docs = near_table(spark)
    want = brute_near([(r.doc_id, r.text) for r in docs.collect()], 3, 0.5)
    found = near_duplicates(docs, recall=0.9999).collect()
    assert {r.doc_id: (r.class_id, r.n_copies, r.n_links, r.group_id) for r in found} == want
    assert sorted(r.doc_id for r in found if r.kept) == sorted({w[3] for w in want.values()})
    if block == 512:
        kept = drop_near_duplicates(docs, recall=0.9999)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({w[3] for w in want.values()})


def test_op9_defaults_against_pairs_at_the_threshold(spark):
    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(10**9)}"
    rows = []
    for i in range(1200):  # pairs that share 20 of 40 word triples
        a, b, c = ([word() for _ in range(k)] for k in (22, 10, 10))
        rows += [(2 * i, " ".join(a + b)), (2 * i + 1, " ".join(a + c))]
    want = brute_near(rows[:40], 3, 0.5)
    assert all(w[2:] == (1, d // 2 * 2) for d, w in want.items())
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sum(r.n_links == 1 and r.group_id == r.doc_id // 2 * 2 for r in found) >= 0.999 * len(rows)
    docs = near_table(spark)
    want = brute_near([(r.doc_id, r.text) for r in docs.collect()], 3, 0.5)
    assert {r.doc_id: (r.class_id, r.n_copies, r.n_links, r.group_id) for r in near_duplicates(docs).collect()} == want


def test_op9_a_family_is_never_a_table_of_its_pairs(spark, monkeypatch):
    rng = random.Random(23)
    words, texts = [f"w{i}" for i in range(60)], []
    for i in range(400):  # 79,800 pairs, all of them links
        t = list(words)
        t[rng.randrange(60)] = f"x{i}"
        texts.append(" ".join(t))
    made, table = {}, base.table

    def counting(df, name, codec=None):
        out = table(df, name, codec)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(base, "table", counting)
    found = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    assert {(r.n_links, r.group_id) for r in found} == {(399, 0)} and len(found) == 400
    assert max(made.values()) < 79_800 / 4, made


def test_pipeline_stage_keeps_one_of_a_family_without_its_pairs(spark, monkeypatch):
    import corpus_pipeline

    words, made, table = [f"w{i}" for i in range(60)], {}, base.table

    def counting(df, name, codec=None):
        out = table(df, name, codec)
        made[name] = out.count()
        return out

    monkeypatch.setattr(base, "table", counting)
    rows = [(i, " ".join([*words[: i % 60], f"x{i}", *words[i % 60 + 1 :]]), "en") for i in range(300)] + [(1000, "quite another text", "en")]
    kept = corpus_pipeline.ngram_join(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1000]
    assert max(made.values()) < 300 * 299 / 2 / 3, made


def test_op9_sketches_in_buckets_against_all_pairs():
    rng = np.random.default_rng(0)
    places, lens = 207, [2, 3, 300, 40, 500, 130]
    weak, strong = ngram_join.least_matches(places, 0.5), 118
    below = sum(math.comb(places, k) for k in range(weak)) / 2**places
    assert below <= ngram_join.SKETCH_LOSS < below + math.comb(places, weak) / 2**places
    families = rng.integers(0, 256, (6, places), dtype=np.uint8)
    parts = [np.where(rng.random((n, places)) < rng.choice([0.3, 0.6, 0.75, 0.95], (n, 1)), families[rng.integers(0, 6, n)], rng.integers(0, 256, (n, places), dtype=np.uint8)) for n in lens]
    sketch, at = np.concatenate(parts), np.concatenate(([0], np.cumsum(lens)))
    own, crossed = rng.integers(0, 2, len(sketch)), np.repeat([False, False, False, False, True, False], lens)
    ok = lambda x, y: ~crossed[x] | (own[x] != own[y])
    pairs, ties = set(), []
    for p in range(len(sketch)):
        q = np.arange(p + 1, at[np.searchsorted(at, p, side="right")])
        q = q[ok(np.full(len(q), p), q)]
        matches = (sketch[q] == sketch[p]).sum(axis=1)
        pairs |= {(p, int(k)) for k in q[matches >= weak]}
        ties += [(p, int(k)) for k in q[matches >= strong]]

    def labels(u, v):
        out = np.arange(len(sketch))
        u, v = base.spanning(u, v)
        out[u] = v
        return out

    want = labels(*np.array(ties).T)
    x, y, tied = ngram_join.near_pairs(sketch, at, ok, weak, strong)
    assert (labels(x[tied], y[tied]) == want).all() and tied.sum() < len(sketch)
    assert {(min(a, b), max(a, b)) for a, b in zip(x[~tied].tolist(), y[~tied].tolist(), strict=True)} == {(a, b) for a, b in pairs if want[a] != want[b]}


def test_op9_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "x")], "doc_id long, text string")
    found = sorted((str(r.doc_id), str(r.class_id), r.n_copies, r.kept) for r in near_duplicates(docs).collect())
    assert found == sorted([("1", "1", 3, True), ("1", "1", 3, False), ("None", "1", 3, False), ("None", "None", 1, True)]) and drop_near_duplicates(docs).count() == 2
    assert near_duplicates(docs.limit(0)).count() == 0


def test_banding_reaches_its_recall():
    for t, recall in ((0.5, 0.98), (0.8, 0.95), (0.3, 0.9)):
        bands, rows = banding(t, recall)
        assert 1 - (1 - t**rows) ** bands >= recall and bands * rows <= 128
    tables, bits = tables_for(0.93, 0.999, 100_000)
    assert bits >= 10 and 1 - (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** tables >= 0.999


def vectors(spark, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, None):
        for _ in range(60):
            center = rng.standard_normal(16)
            for _ in range(rng.choice([1, 1, 3])):
                rows.append(([float(x) for x in (center + rng.choice([0, 0.05, 0.2, 0.3]) * rng.standard_normal(16)).astype(np.float32)], label))
    hot = rng.standard_normal(16)
    rows += [([float(x) for x in (hot + 0.03 * rng.standard_normal(16)).astype(np.float32)], 1) for _ in range(40)] + [([1.0, 2.0], 1)] * 30
    rows += [(None, 1), ([], 1), ([0.0] * 16, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([None] * 16, 0), ([float("inf")] + [0.0] * 15, 0), ([3.0] * 16, 0), ([6.0] * 16, 0), ([3.0] * 15, 0)]
    return spark.createDataFrame([(i, v, k, "x") for i, (v, k) in enumerate(rows)], "vec_id long, embedding array<float>, label int, n_links string").repartition(3)


@pytest.mark.parametrize("block", [768, 9])
def test_op10_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    table = vectors(spark)
    rows = sorted(table.collect(), key=lambda r: r.vec_id)
    ok = [r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding) and r.label is not None for r in rows]
    links, parent = {r.vec_id: 0 for r in rows}, {r.vec_id: r.vec_id for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if ok[i] and ok[j] and a.label == b.label and len(a.embedding) == len(b.embedding):
                x, y = np.array(a.embedding, dtype=np.float64), np.array(b.embedding, dtype=np.float64)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    p, q = root(i), root(j)
                    parent[max(p, q)] = min(p, q)
    found = near_vectors(table, recall=0.999999).collect()
    assert len(found) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == {i: (links[i], root(i), root(i) == i) for i in links}


def test_op10_double_vectors_and_far_scales(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal(8)
    rows = [[1e300, 0.0], [1e300, 0.0], [1e-300, 0.0], [0.0, 1e300], [1e300, 1e299], *[(x * s).tolist() for s in (1.0, 1e200, 1e-200, 3.0)], (-x).tolist()]
    table = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(table).collect()}
    assert found == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (0, 3), 4: (3, 0), **{k: (3, 5) for k in (5, 6, 7, 8)}, 9: (0, 9)}
    close = spark.createDataFrame([(1, [1.0, 0.3952317654], 1), (2, [1.0, 0.0], 1), (3, [1.0, -1e-9], 1)], "vec_id long, embedding array<double>, label int")
    cos = lambda a, b: (a[0] * b[0] + a[1] * b[1]) / np.hypot(*a) / np.hypot(*b)
    v = {r.vec_id: r.embedding for r in close.collect()}
    want = {i: sum(cos(v[i], v[j]) >= 0.93 for j in v if j != i) for i in v}
    assert {r.vec_id: r.n_links for r in near_vectors(close).collect()} == want  # single precision would not tell 2 and 3 apart


def test_op10_one_bucket_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 4096)
    rng = np.random.default_rng(3)
    hot = rng.standard_normal(16)
    rows = [(i, [float(x) for x in hot + 0.02 * rng.standard_normal(16)], 1) for i in range(400)] + [(1000 + i, [float(x) for x in rng.standard_normal(16)], 1) for i in range(200)]
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in found if r.vec_id < 400} == {(399, 0)}


def test_hot_keys_pass_the_filters(spark):
    rows = base.table(spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 100_000).alias("k"), F.col("id").alias("_p0")), "hot-rows")
    keys = base.table(spark.range(7, 8).select(F.col("id").alias("key")), "hot-keys")
    may = base.passing(rows, F.col("k"), keys)
    assert may.columns == rows.columns and may.where("k = 7").count() == 1334 and may.where("k <> 7").count() < 50
    assert base.flagged(rows, F.col("k"), keys.limit(0), "f").where("f").count() == 0


def test_op10_repeats_and_no_rows(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.1], 1), (None, None, 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in near_vectors(v).collect()) == sorted([("1", 2, "1"), ("1", 2, "1"), ("None", 2, "1"), ("None", 0, "None")])
    assert near_vectors(v.limit(0)).count() == 0


def test_tables_go_to_the_shared_folder(spark):
    import os

    t = base.table(spark.range(3), "t")
    files = [f.removeprefix("file://") for f in t.inputFiles()]
    assert t.count() == 3 and files and all(f.startswith(base.shared_dir(spark).removeprefix("file://")) and os.path.exists(f) for f in files)
    base.drop_table(t)
    assert not any(map(os.path.exists, files))
