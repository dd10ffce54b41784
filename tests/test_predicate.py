import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from colonnade.errors import FieldNotFoundError, TypeMismatchError, UnsupportedError
from colonnade.functions import predicate as P
from colonnade.operators import query as Q


@pytest.fixture(scope="module")
def df(spark):
    rows = [(i, None if i % 5 == 0 else i * 10, float("nan") if i % 4 == 0 else float(i), "abc"[i % 3], float(i)) for i in range(24)]
    return spark.createDataFrame(rows, "id bigint, n bigint, x double, s string, f float").cache()


def test_unknown_field(df):
    with pytest.raises(FieldNotFoundError) as e:
        Q.query(df, P.where_cmp("nope", P.EQ, 1))
    assert e.value.field == "nope"


@pytest.mark.parametrize(("field", "value"), [("x", 1), ("s", 1), ("id", 1.0), ("id", "a"), ("f", 1.0), ("id", np.uint8(1))])
def test_kind_mismatch(df, field, value):
    with pytest.raises(TypeMismatchError):
        Q.query(df, P.where_cmp(field, P.EQ, value))


def test_float32_literal(df):
    assert Q.query(df, P.where_cmp("f", P.EQ, np.float32(3))).count() == 1


def test_options_inside_combinators(df):
    for bad in (P.select("id"), P.with_no_copy(), P.with_arena()):
        with pytest.raises(UnsupportedError):
            P.and_(bad)
        with pytest.raises(UnsupportedError):
            P.not_(bad)
    with pytest.raises(UnsupportedError):
        P.where_cmp("id", P.EQ, True).lower(df.schema)


def test_strict_select(df):
    assert Q.query(df, P.select("id", "nope")).columns == ["id"]
    with pytest.raises(FieldNotFoundError):
        Q.query(df, P.select("nope"), strict=True)


def test_select_nothing_keeps_all(df):
    assert Q.query(df, P.select()).columns == df.columns


def test_times_cannot_be_queried(spark):
    t = spark.sql("SELECT timestamp'2020-01-01 00:00:00' AS t")
    with pytest.raises(TypeMismatchError):
        Q.query(t, P.where("t", lambda c: c.isNotNull()))


def test_null_never_reaches_an_opaque_test(df):
    assert {r["id"] for r in Q.query(df, P.where_python("n", lambda v: v > 50)).collect()} == {i for i in range(24) if i % 5 and i * 10 > 50}


# Three-valued logic against a small evaluator

leaf = st.one_of(
    st.tuples(st.just("n"), st.integers(0, 7), st.integers(-10, 250)),
    st.tuples(st.just("x"), st.integers(0, 7), st.one_of(st.floats(-5, 30), st.just(math.nan))),
    st.tuples(st.just("s"), st.integers(0, 7), st.sampled_from("abcd")),
)
tree = st.recursive(leaf, lambda t: st.one_of(st.tuples(st.just("and"), st.lists(t, max_size=3)), st.tuples(st.just("or"), st.lists(t, max_size=3)), st.tuples(st.just("not"), t)), max_leaves=6)


def build(t):
    if t[0] in ("and", "or"):
        return (P.and_ if t[0] == "and" else P.or_)(*map(build, t[1]))
    return P.not_(build(t[1])) if t[0] == "not" else P.where_cmp(*t)


def evaluate(t, row):
    if t[0] == "and":
        got = [evaluate(x, row) for x in t[1]]
        return False if False in got else None if None in got else True
    if t[0] == "or":
        got = [evaluate(x, row) for x in t[1]]
        return True if True in got else None if None in got else False
    if t[0] == "not":
        got = evaluate(t[1], row)
        return None if got is None else not got
    v, op, lit = row[t[0]], t[1], t[2]
    if v is None:
        return None
    if isinstance(v, float) and (math.isnan(v) or math.isnan(lit)):
        return False
    return bool(op & (1 if v < lit else 2 if v == lit else 4))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(t=tree)
def test_trees(df, t):
    want = {r["id"] for r in df.collect() if evaluate(t, r.asDict()) is True}
    assert {r["id"] for r in Q.query(df, build(t)).collect()} == want
