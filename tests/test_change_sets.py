import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.errors import BaseMismatchError, InvalidPatchError, SchemaMismatchError
from colonnade.operators import canonical, delta
from colonnade.operators.order import numbered

SCHEMA = "id bigint, name string, score double, tags map<string,bigint>, items array<struct<a:int,b:string>>"


def records(seed, n):
    r = random.Random(seed)
    out = []
    for i in r.sample(range(40), n):
        tags = None if r.random() < 0.2 else {r.choice("xyz"): r.randrange(3) for _ in range(r.randrange(3))}
        items = None if r.random() < 0.2 else [(r.randrange(2), r.choice([None, "", "q"])) for _ in range(r.randrange(3))]
        out.append((i, r.choice(["a", "b", None]), r.choice([0.0, -0.0, float("nan"), 1.5, None]), tags, items))
    return out


def plain(df):
    return sorted(str(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(6))
def test_keyed_round_trip(spark, seed):
    old, new = (spark.createDataFrame(records(s, 20), SCHEMA) for s in (seed, seed + 100))
    changes = delta.diff_keyed(old, new, "id")
    assert plain(delta.apply_changes(old, changes, "id")) == plain(new)
    assert delta.diff_keyed(old, old, "id").count() == 0


def test_patch_guards(spark):
    old, new = (spark.createDataFrame(records(s, 10), SCHEMA) for s in (1, 2))
    patch = delta.make_patch(old, new, "id")
    with pytest.raises(BaseMismatchError):
        delta.apply_patch(new, patch)
    with pytest.raises(SchemaMismatchError):
        delta.apply_patch(old.drop("name"), patch)
    twice = patch.changes.union(patch.changes)
    with pytest.raises(InvalidPatchError):
        delta.apply_changes(old, twice, "id")


def test_order_list(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "rn bigint, k string")
    order = spark.createDataFrame([(0, "c"), (1, "a"), (2, "b")], "rn bigint, k string")
    assert delta.key_order(rows, order, "k")[0]
    assert [r["k"] for r in delta.apply_order(rows, order, "k").orderBy("rn").collect()] == ["c", "a", "b"]
    with pytest.raises(InvalidPatchError):
        delta.apply_order(rows, order.where("k <> 'a'"), "k")


def test_positional_truncates_and_extends(spark):
    old = numbered(spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), "k")
    for n in (6, 14):
        new = numbered(spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 2 + (F.col("id") % 3 == 0).cast("int")).alias("v")), "k")
        assert plain(delta.apply_changes(old, delta.diff_positional(old, new), "rn")) == plain(new)


def test_map_change(spark):
    dtype = T.MapType(T.StringType(), T.LongType())
    rows = [({"a": 1, "b": 2}, {"b": 3, "c": 4}), (None, {"a": 1}), ({"a": 1}, None), ({}, {}), ({"a": None}, {"a": None}), ({"a": 1}, {})]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("a", dtype), T.StructField("b", dtype)]))
    got = df.withColumn("r", delta.map_apply(F.col("a"), delta.map_diff(F.col("a"), F.col("b"), dtype))).collect()
    assert [r["r"] for r in got] == [b for _, b in rows]


def test_canonical_is_idempotent(spark):
    df = spark.createDataFrame(records(5, 30), SCHEMA).drop("tags")
    once = canonical.canonicalize(df)
    assert plain(canonical.canonicalize(once)) == plain(once)
    assert {r["h"] for r in canonical.content_hash(df, "h").collect()} == {r["h"] for r in canonical.content_hash(once, "h").collect()}


def test_null_and_empty_differ(spark):
    df = spark.createDataFrame([(1, None), (2, {})], "id int, m map<string,int>")
    h = [r["h"] for r in canonical.content_hash(df.drop("id"), "h").collect()]
    assert h[0] != h[1]


NESTED = "id bigint, s struct<a:bigint,b:struct<c:string,d:double>>, m map<string,struct<x:int,y:array<int>>>, a array<struct<p:int,q:map<string,int>>>, n array<array<int>>"


def nested_records(seed, n):
    r = random.Random(seed)
    maybe = lambda f: None if r.random() < 0.15 else f()
    ints = lambda: maybe(lambda: [maybe(lambda: r.randrange(3)) for _ in range(r.randrange(4))])
    few = lambda: maybe(lambda: {r.choice("uv"): maybe(lambda: r.randrange(2)) for _ in range(r.randrange(3))})
    out = []
    for i in r.sample(range(40), n):
        s = maybe(lambda: (maybe(lambda: r.randrange(3)), maybe(lambda: (r.choice("kl"), r.choice([0.0, -0.0, float("nan"), None])))))
        m = maybe(lambda: {r.choice("xyz"): maybe(lambda: (r.randrange(2), ints())) for _ in range(r.randrange(4))})
        a = maybe(lambda: [maybe(lambda: (r.randrange(2), few())) for _ in range(r.randrange(4))])
        out.append((i, s, m, a, maybe(lambda: [ints() for _ in range(r.randrange(3))])))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_nested_round_trip(spark, seed):
    old, new = (spark.createDataFrame(nested_records(s, 30), NESTED) for s in (seed, seed + 50))
    changes = delta.diff_nested(old, new, "id")
    flat = lambda df: sorted(str(r) for r in canonical.canonicalize(df).collect())
    assert flat(delta.apply_nested(old, changes, "id")) == flat(new)
    assert delta.diff_nested(old, old, "id").count() == 0
    # a deep change carries nothing of what is beside it
    one = spark.createDataFrame([(1, (1, ("k", 1.5)), {"x": (1, [1, 2])}, [(1, {"u": 1}), (2, None)], [[1], [2]])], NESTED)
    two = spark.createDataFrame([(1, (1, ("k", 2.5)), {"x": (1, [1, 3])}, [(1, {"u": 2}), (2, None)], [[1], [2, 3]])], NESTED)
    patch = delta.diff_nested(one, two, "id").first()["patch"]
    assert patch["s"]["merge"]["a"]["op"] == "same" and patch["s"]["merge"]["b"]["merge"]["d"]["value"] == 2.5
    assert patch["m"]["merge"]["set"]["x"]["merge"]["y"]["merge"]["at"][0]["patch"]["value"] == 3
    assert patch["a"]["merge"]["at"][0]["patch"]["merge"]["q"]["merge"]["set"]["u"]["value"] == 2 and len(patch["a"]["merge"]["at"]) == 1
    assert patch["n"]["merge"]["at"][0]["patch"]["merge"]["tail"] == [3]


@pytest.mark.parametrize("seed", range(4))
def test_change_sets_one_after_the_other(spark, seed):
    old, mid, new = (spark.createDataFrame(records(s, 20), SCHEMA) for s in (seed, seed + 10, seed + 20))
    first, second = delta.diff_keyed(old, mid, "id"), delta.diff_keyed(mid, new, "id")
    both = delta.append_changes(first, second, "id")
    assert plain(delta.apply_changes(old, both, "id")) == plain(new)
    with pytest.raises(InvalidPatchError):
        delta.append_changes(first, first.where("op <> 'update'"), "id")


def test_changes_in_key_order(spark):
    old, new = (spark.createDataFrame(records(s, 20), SCHEMA) for s in (3, 4))
    rows = delta.ordered(delta.diff_keyed(old, new, "id"), "id").orderBy("place").collect()
    assert [r["id"] for r in rows] == sorted(r["id"] for r in rows) and [r["place"] for r in rows] == list(range(len(rows)))


def bag(seed, n):
    """Rows whose keys repeat, some of them whole."""
    r = random.Random(seed)
    return [(r.choice([None, *range(6)]), r.choice(["a", "b", None]), r.choice([0.0, -0.0, float("nan"), 1.5, None]), None, None) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_keys_that_repeat_are_told_apart(spark, seed):
    rows = [spark.createDataFrame(bag(seed + s, n), SCHEMA) for s, n in ((0, 20), (10, 26), (20, 12))]
    old, mid, new = (delta.with_nth(x.where("id IS NOT NULL"), "id") for x in rows)
    keys = ("id", "nth")
    assert not delta.has_duplicate_keys(mid, *keys)
    first, second = delta.diff_keyed(old, mid, *keys), delta.diff_keyed(mid, new, *keys)
    assert plain(delta.apply_changes(old, first, *keys).drop("nth")) == plain(rows[1].where("id IS NOT NULL"))
    both = delta.append_changes(first, second, *keys)
    assert plain(delta.apply_changes(old, both, *keys).drop("nth")) == plain(rows[2].where("id IS NOT NULL"))
    assert plain(delta.with_nth(rows[0], "id").drop("nth")) == plain(rows[0])  # null keys stay
    registry = delta.BaselineRegistry()
    registry.register(old)
    assert plain(registry.apply(delta.make_patch(old, mid, *keys)).drop("nth")) == plain(rows[1].where("id IS NOT NULL"))


@pytest.fixture(scope="session")
def million(spark, tmp_path_factory):
    """Orders some of whose keys are those that the edited table adds."""
    folder = tmp_path_factory.mktemp("million")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    orders.unionByName(orders.withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000)).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["d01_diff_keyed_changes", "d04_apply_roundtrip", "d15_baseline_registry", "d23_append_changes"])
def test_added_keys_that_are_there(spark, million, name):
    import duckdb

    from colonnade.plans import catalogue

    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{million}/orders.parquet/*.parquet'")
    cursor = con.execute(catalogue.ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(map(str, cursor.fetchall())) == sorted(str(tuple(r)) for r in catalogue.QUERIES[name](spark, million).select(*[f"`{c}`" for c in names]).collect())
