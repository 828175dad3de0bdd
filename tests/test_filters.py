import datetime
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.errors import OptionError, UnknownFieldError
from lodestone.operators import filters as f

NAMES = ("s", "n", "d")
WORDS = st.sampled_from(["", "a", "A", "ab", "Abc", "xAb", "zz", "100%_safe"])


def leaves():
    value = {"s": st.none() | WORDS, "n": st.none() | st.integers(-3, 3), "d": st.none() | st.floats(-2, 2, width=16)}
    out = []
    for name, v in value.items():
        out += [st.builds(f.equal, st.just(name), v), st.builds(f.not_equal, st.just(name), v), st.builds(f.is_in, st.just(name), st.lists(v, max_size=3)), st.builds(f.not_in, st.just(name), st.lists(v, max_size=3)), st.just(f.is_null(name)), st.just(f.is_not_null(name))]
        there = v.filter(lambda x: x is not None)
        if name != "s":
            out += [st.builds(k, st.just(name), there) for k in (f.greater, f.greater_or_equal, f.less, f.less_or_equal)]
    out += [st.builds(k, st.just("s"), WORDS) for k in (f.contains, f.starts_with, f.ends_with)]
    return st.one_of(out)


TREES = st.recursive(leaves(), lambda t: st.one_of(st.builds(lambda x: f.all_of(*x), st.lists(t, min_size=1, max_size=3)), st.builds(lambda x: f.any_of(*x), st.lists(t, min_size=1, max_size=3)), st.builds(f.negate, t)), max_leaves=6)
ROWS = [(s, n, d) for s in (None, "", "A", "ab", "xab", "100%_SAFE restore") for n in (None, -1, 2) for d in (None, 0.5, -2.0)]


@settings(max_examples=25, deadline=None)
@given(st.lists(TREES, min_size=1, max_size=12))
def test_columns_agree_with_plain_evaluation(spark, trees):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "s string, n int, d double")
    resolve = f.resolver({n: n for n in NAMES})
    rows = df.select("s", "n", "d", *(f.compile_filter(t, resolve).alias(f"r{i}") for i, t in enumerate(trees))).collect()
    for r in rows:
        for i, t in enumerate(trees):
            assert r[f"r{i}"] is f.matches(t, {n: r[n] for n in NAMES}), (t, r)
    for t in trees[:3]:
        kept = df.where(f.condition(t, resolve)).collect()
        assert sorted(map(str, kept)) == sorted(str(r) for r in df.collect() if f.matches(t, {n: r[n] for n in NAMES})), t
    assert F is not None


def test_nulls_are_unequal_and_in_no_list():
    row = {"status": None, "category": None, "title": None}
    for x in (f.not_equal("status", "a"), f.not_in("category", ["a"]), ~f.equal("status", "a"), ~f.contains("title", "a")):
        assert f.matches(x, row)
    assert not f.matches(f.is_in("status", []), row) and f.matches(f.not_in("status", []), row)
    assert f.matches(f.is_in("status", [None]), row)


def test_mixed_filter():
    row = {"tenant": 42, "category": "Database", "updated": 11, "title": "100%_SAFE restore", "at": datetime.datetime(2024, 5, 1)}
    both = f.all_of(f.equal("tenant", 42), f.is_in("category", ["database", "x"]), f.greater_or_equal("updated", 10), f.contains("title", "100%_safe"), f.less("at", datetime.date(2025, 1, 1)))
    assert f.matches(both, row) and not f.matches(f.negate(both), row)


def test_errors_and_collapse():
    with pytest.raises(OptionError):
        f.all_of()
    with pytest.raises(OptionError):
        f.greater("a", None)
    with pytest.raises(OptionError):
        f.contains("a", 3)
    with pytest.raises(UnknownFieldError):
        f.compile_filter(f.equal("a", 1), f.resolver({"b": "b"}))
    one = f.equal("a", 1)
    assert f.all_of(one) is one and f.combine(None, one, None) is one and f.combine() is None


def test_what_an_index_takes():
    assert f.is_simple(None) and f.is_simple(f.equal("a", 1)) and f.is_simple(f.equal("a", 1) & f.greater("b", 2))
    for x in (f.equal("a", 1) | f.equal("a", 2), f.not_equal("a", 1), f.equal("a", None), f.equal("a", 1) & f.less("a", 2), ~f.equal("a", 1)):
        assert not f.is_simple(x)


def test_conditions_reach_the_scan(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    resolve = f.resolver({"price": "o_totalprice", "key": "o_orderkey", "status": "o_orderstatus"})
    for tree, pushed in ((f.greater("price", 5), "GreaterThan(o_totalprice"), (~f.less("price", 5), "GreaterThanOrEqual(o_totalprice"), (f.is_in("key", [1, 2]), "In(o_orderkey"), (f.not_equal("key", 3), "Not(EqualTo(o_orderkey"), (f.equal("key", 3) | f.is_null("status"), "IsNull(o_orderstatus"), (f.equal("status", "o"), "IsNotNull(o_orderstatus")):
        plan = orders.where(f.condition(tree, resolve))._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan[plan.index("PushedFilters") :], plan


def test_values_never_become_sql(spark):
    df = spark.createDataFrame([("x' OR '1'='1",), ("y",)], "s string")
    assert df.where(f.compile_filter(f.equal("s", "x' or '1'='1"), f.resolver({"s": "s"}))).count() == 1
    assert math.isclose(1, 1)
