import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.errors import LodestoneError, OptionError, PlanError
from lodestone.operators import ann, filters, fusion, lexical, semantic
from lodestone.options import CandidateOptions, FusionOptions, LexicalOptions, ScoringOptions, SemanticOptions, inference_slots
from lodestone.plans.query import Corpus, SearchQuery, compile_query, lexical_stage, semantic_stage

SPACE = "s"
Q = semantic.QueryVector.of([1, 0], SPACE)
SCHEMA = "item string, field string, weight double, vector array<float>, tokens long, capacity long, fingerprint string, chunk long"


def chunk(item, c, tokens=1000, field="content", weight=1.0, space=SPACE, n=0):
    return (item, field, weight, [c, math.sqrt(1 - c * c)], tokens, 1000, space, n)


def order(spark, rows, **k):
    return [r.item for r in semantic.search(spark.createDataFrame(rows, SCHEMA), Q, **k).collect()]


def test_length_confidence_decides_close_matches(spark):
    assert order(spark, [chunk("short", 0.95, 100), chunk("long", 0.93, 800)]) == ["long", "short"]
    assert order(spark, [chunk("short", 0.99, 100), chunk("long", 0.93, 800)]) == ["short", "long"]


def test_irrelevant_chunks_do_not_average_down_and_weak_ones_do_not_add_up(spark):
    a = [chunk("a", c, n=i) for i, c in enumerate((0.94, 0.2, 0.18, 0.1))]
    assert order(spark, [*a, chunk("b", 0.86)]) == ["a", "b"]
    assert order(spark, [chunk("strong", 0.9), *(chunk("weak", 0.55, n=i) for i in range(20))]) == ["strong", "weak"]


def test_support_adds_but_not_beyond_a_better_best(spark):
    rows = spark.createDataFrame([chunk("isolated", 0.94), *(chunk("supported", c, n=i) for i, c in enumerate((0.91, 0.90, 0.89)))], SCHEMA)
    found = {r.item: r for r in semantic.search(rows, Q).collect()}
    assert list(found) == ["isolated", "supported"]
    assert found["supported"].score > 0.91 and found["supported"].scoring == "default-v1" and len(found["supported"].matches) == 3


def test_fields_and_weights(spark):
    rows = [chunk("t", 0.9, field="title", weight=2.0), chunk("t", 0.82, field="body"), chunk("b", 0.35, field="title", weight=2.0), chunk("b", 0.9, field="body")]
    assert order(spark, rows) == ["t", "b"]
    for bad in ([chunk("x", 0.9, weight=1.0), chunk("x", 0.8, weight=2.0, n=1)], [chunk("x", 0.9, weight=-1.0)], [chunk("x", 0.9, space="other")]):
        with pytest.raises(Exception, match="different weights|negative|embedding space"):
            order(spark, bad)
    assert order(spark, [chunk("zero", 0.5, weight=0.0)]) == []
    assert order(spark, [chunk("opposed", -1.0)]) == ["opposed"]


def test_scores_are_those_of_the_formula(spark):
    def evidence(s):
        s = sorted(s, reverse=True)
        return min(1, s[0] + sum((1 - s[0]) * w * min(1, max(0, 1 - (s[0] - x) / 0.12)) * x for x, w in zip(s[1:3], (0.25, 0.1), strict=False)))

    rng = np.random.default_rng(3)
    rows = [chunk(f"i{i % 7}", float(rng.uniform(-1, 1)), int(rng.integers(1, 1500)), f"f{i % 3}", 1.0 + i % 3, n=i) for i in range(200)]
    want: dict = {}
    for item, field, w, v, tokens, cap, _, _ in rows:
        v = np.array(v, dtype=np.float32)
        c = float(v[0]) / float(np.sqrt((v * v).astype(np.float64).sum()))
        want.setdefault(item, {}).setdefault((field, w), []).append(max(0, c) * (0.96 + 0.04 * math.sqrt(min(1, tokens / cap))))
    got = {r.item: r.score for r in semantic.item_scores(spark.createDataFrame(rows, SCHEMA), Q).collect()}
    for item, fields in want.items():
        assert got[item] == pytest.approx(evidence([1 - (1 - evidence(s)) ** w for (_, w), s in fields.items()]), abs=1e-9)


def test_candidates_filter_restrict_and_rerank(spark):
    rows = [chunk("supported", 0.91), chunk("supported", 0.90, n=1), chunk("isolated", 0.94), chunk("foreign", 0.99, space="other")]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("tenant", F.when(F.col("item") == "isolated", 2).otherwise(1))
    m = semantic.Chunks("item", "vector", "field", "weight", "tokens", "capacity", "fingerprint", "chunk", {"tenant": "tenant"})
    found = semantic.candidate_search(table, m, Q).collect()
    assert [r.item for r in found] == ["isolated", "supported"] and found[0].retrieval.budget == 100
    assert [r.item for r in semantic.candidate_search(table, m, Q, where=filters.equal("tenant", 1)).collect()] == ["supported"]
    assert semantic.candidates(table, m, Q, 10, fields=[]).count() == 0
    assert {r.weight for r in semantic.candidates(table, m, Q, 10, weights={"content": 3.0}).collect()} == {3.0}
    assert semantic.candidates(table, m, Q, 10, extra_sql="tenant = 2").count() == 1
    assert [CandidateOptions(t, c).resolve() for t, c in ((1, None), (10, None), (25, None), (10, 42))] == [100, 100, 250, 42]
    with pytest.raises(OptionError):
        CandidateOptions(10, 5)


def test_title_weight_wins_in_bm25(spark):
    docs = spark.createDataFrame([(1, "PostgreSQL Backup", "Routine database operations"), (2, "Database Operations", "postgresql backup " * 20)], "id long, title string, body string")
    found = lexical.bm25(docs, "id", "postgresql backup", {"title": 8.0, "body": 1.0}).collect()
    assert [r.key for r in found] == [1, 2]
    assert sum(x.score for x in found[1].by_field) == pytest.approx(found[1].score)
    assert lexical.bm25(docs, "id", "!!", {"title": 1.0}).count() == 0
    assert lexical.bm25(docs.limit(0), "id", "backup", {"title": 1.0}).count() == 0
    for bad in ((" ", {"title": 1.0}), ("a", {"title": -1.0}), ("a", {" ": 1.0}), ("a", {})):
        with pytest.raises(LodestoneError):
            lexical.bm25(docs, "id", *bad)


def test_bm25_against_plain_arithmetic(spark):
    texts = ["a b c", "a a", "", None, "c d e f a", "B b b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    words = [(t or "").lower().split() for t in texts]
    mean = max(1, sum(map(len, words)) / len(words))
    want = {}
    for i, w in enumerate(words):
        s = 0.0
        for term in ("a", "b"):
            df, tf = sum(term in x for x in words), w.count(term)
            s += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * (lexical.K1 + 1) / (tf + lexical.K1 * (0.25 + 0.75 * len(w) / mean)) if tf else 0
        if s:
            want[i] = s
    got = {r.key: r.score for r in lexical.bm25(docs, "id", "A b", {"t": 1.0}).collect()}
    assert got == pytest.approx(want)
    queries = spark.createDataFrame([(1, "A b"), (2, "zzz"), (3, "")], "q long, t string")
    batch = {r.key: r.score for r in lexical.bm25_batch(docs, "id", "t", queries, "q", "t").collect()}
    assert batch == pytest.approx(want)


def test_profiles(spark):
    docs = spark.createDataFrame([(1, "backup restore", "x"), (2, "backup", "restore"), (3, "restore then backup", "y")], "id long, title string, body string")
    both = {"title": 8.0, "body": 1.0}
    assert {r.key for r in lexical.conjunctive(docs, "id", "backup restore", both).collect()} == {1, 2, 3}
    assert {r.key for r in lexical.conjunctive(docs, "id", "backup then", both).collect()} == {3}
    assert {r.key for r in lexical.frequency_rank(docs, "id", "backup restore", both, mode="phrase").collect()} == {1}
    assert {r.key for r in lexical.frequency_rank(docs, "id", "then zzz", both, mode="any", normalization=63).collect()} == {3}
    assert [r.key for r in lexical.field_fusion(docs, "id", "restore", both).collect()][-1] == 2
    assert lexical.match_query("Full-text") == '"full" AND "text"'
    assert lexical.class_weights({"a": 4, "b": 1}) == {"a": 1, "b": 0.25}
    with pytest.raises(OptionError):
        lexical.match_query("!")


def test_fusion_prefers_what_both_lists_have(spark):
    a = spark.createDataFrame([("semantic-only", 2.0), ("both", 1.0)], "key string, score double")
    b = spark.createDataFrame([("both", 9.0), ("lexical-only", 8.0)], "key string, score double")
    rows = fusion.top(fusion.fuse([fusion.Ranking("a", a), fusion.Ranking("b", b)]), 10).collect()
    assert [r.key for r in rows] == ["both", "semantic-only", "lexical-only"] and len(rows[0].contributions) == 2
    assert rows[0].score == pytest.approx(1 / 62 + 1 / 61)
    twice = spark.createDataFrame([("x", 1, 5.0), ("x", 2, 4.0), ("y", 3, 3.0)], "key string, rank int, score double")
    got = {r.key: r.first_rank for r in fusion.fuse([fusion.Ranking("a", twice)]).collect()}
    assert got == {"x": 1, "y": 3}
    for bad in ([], [fusion.Ranking("a", a), fusion.Ranking("a", b)], [fusion.Ranking("a", a, -1)]):
        with pytest.raises(PlanError):
            fusion.fuse(bad)
    with pytest.raises(OptionError):
        FusionOptions(-1)


def corpus(spark):
    items = spark.createDataFrame([("backup", 1, "backup guide"), ("network", 1, "network guide"), ("other", 2, "backup backup")], "id string, tenant int, title string")
    chunks = spark.createDataFrame([chunk("backup", 0.99), chunk("network", 0.1), chunk("other", 0.98)], SCHEMA)
    return Corpus(items, "id", {"tenant": "tenant", "title": "title"}, ("title",), chunks, semantic.Chunks("item", "vector", "field", "weight", "tokens", "capacity", "fingerprint", "chunk"))


def test_hybrid_plan(spark):
    c = corpus(spark)
    q = SearchQuery("backup").where(filters.equal("tenant", 1)).semantic().lexical()
    rows = compile_query(q, c, lambda _: Q).collect()
    assert rows[0].key == "backup" and len(rows[0].contributions) == 2 and "other" not in [r.key for r in rows]
    assert [r.key for r in compile_query(SearchQuery("backup").semantic().post_where(filters.equal("tenant", 2)).take(1), c, lambda _: Q).collect()] == ["other"]
    rich = SearchQuery("backup").where(filters.equal("tenant", 1) | filters.equal("tenant", 999)).semantic().lexical()
    assert compile_query(rich, c, lambda _: Q).first().key == "backup"


def test_a_lexical_plan_embeds_nothing(spark):
    def fail(_):
        raise AssertionError

    assert compile_query(SearchQuery("backup").lexical(), corpus(spark), fail).count() == 2
    assert compile_query(SearchQuery("backup").add(semantic_stage().with_weight(0), lexical_stage()), corpus(spark), fail).count() == 2


@pytest.mark.parametrize("bad", [SearchQuery(" ").lexical(), SearchQuery("a"), SearchQuery("a").lexical().lexical(), SearchQuery("a").lexical().take(0), SearchQuery("a").add(lexical_stage().with_weight(-1)), SearchQuery("a").add(lexical_stage().with_candidates(0)), SearchQuery("a").lexical({"t": -1.0})])
def test_bad_plans(bad):
    with pytest.raises(PlanError):
        bad.validate()


def test_options():
    assert [inference_slots(t) for t in (1, 2, 8, 16, 64)] == [1, 1, 4, 8, 8] and inference_slots(16, 3) == 3
    for make in (lambda: LexicalOptions(k1=0), lambda: LexicalOptions(b=2), lambda: SemanticOptions(0), lambda: ScoringOptions(second=-1), lambda: ScoringOptions(profile="x")):
        with pytest.raises(OptionError):
            make()


def test_approximate_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").alias("v"), F.lit("s").alias("fingerprint"))
    centroids = ann.fit(e, "v", 16)
    indexed = ann.assign(e, "v", centroids).cache()
    hits = 0
    vectors = {r.vec_id: np.array(r.v, dtype=np.float64) for r in e.collect()}
    ids = np.array(sorted(vectors))
    m = np.stack([vectors[i] for i in ids])
    for i in ids[::50]:
        got = {r.vec_id for r in ann.candidates(indexed, "vec_id", "v", "fingerprint", semantic.QueryVector.of(vectors[i], "s"), centroids, 10, probes=12).collect()}
        hits += len(got & set(ids[np.argsort(-(m @ vectors[i]))[:10]].tolist()))
    assert hits / (10 * len(ids[::50])) >= 0.9
    assert ann.strategy(filters.equal("a", 1)) == "approximate" and ann.strategy(filters.not_equal("a", 1)) == "exact"


def test_recall_of_the_registered_query(spark, sf):
    from lodestone import queries

    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").alias("v"), F.lit("s").alias("fingerprint"))
    centroids = ann.fit(e, "v", queries.CELLS)
    indexed = ann.assign(e, "v", centroids).cache()
    vectors = {r.vec_id: np.array(r.v, dtype=np.float64) for r in e.collect()}
    ids = np.array(sorted(vectors))
    m = np.stack([vectors[i] for i in ids])

    def recall(found, i):
        return len({r.vec_id for r in found.collect()} & set(ids[np.argsort(-(m @ vectors[i]), kind="stable")[: queries.NEAREST]].tolist())) / queries.NEAREST

    assert recall(queries.QUERIES["semantic_approximate"](spark, sf), 0) >= 0.9
    for i in ids[::100]:
        assert recall(ann.candidates(indexed, "vec_id", "v", "fingerprint", semantic.QueryVector.of(vectors[i], "s"), centroids, queries.NEAREST, queries.PROBES), i) >= 0.9


@pytest.mark.parametrize("name", ["POSTGRES_LIKE", "SQLITE_LIKE", "SQL_SERVER_LIKE"])
def test_profiles_of_stores(spark, name):
    from lodestone.plans import query as plans

    q = SearchQuery("backup").where(filters.equal("tenant", 1)).semantic().lexical()
    rows = compile_query(q, corpus(spark), lambda _: Q, profile=getattr(plans, name)).collect()
    assert rows[0].key == "backup" and len(rows[0].contributions) == 2 and "other" not in [r.key for r in rows]


def test_sql_names(spark):
    from lodestone.functions.register import register

    assert "chunk_text" in register(spark)
    r = spark.sql("SELECT vec_cosine(array(1f, 0f), array(0.8f, 0.6f)) AS c, vec_decode(vec_encode(array(1f, 2f), 4)) AS v, size(vec_reduce(array(1f, 2f, 3f), 2)) AS n, count_tokens('a b') AS t").first()
    assert r.c == pytest.approx(0.8, abs=1e-6) and r.v == [1.0, 2.0] and (r.n, r.t) == (2, 2)
    assert spark.sql("SELECT * FROM chunk_text('a b c', 2)").count() == 2


def test_web_queries(spark):
    docs = spark.createDataFrame([(1, "backup restore now"), (2, "restore the backup"), (3, "network switch"), (4, "backup network")], "id long, t string")
    found = lambda q: sorted(r.key for r in lexical.web_search(docs, "id", q, {"t": 1.0}).collect())
    assert found("backup") == [1, 2, 4] and found('"backup restore"') == [1] and found("backup -network") == [1, 2] and found("switch or now") == [1, 3] and found("!!") == []
    assert lexical.parse_web_query('a "b c" -d OR e') == [(["a"], [["b", "c"]], [["d"]]), (["e"], [], [])]
