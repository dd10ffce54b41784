import math
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from colonnade.errors import InvalidPatchError
from colonnade.functions import scalar
from colonnade.operators import encode as E
from colonnade.operators import zonemap as Z
from colonnade.operators import order
from colonnade.operators.order import numbered
from colonnade.functions import predicate as P
from colonnade.operators import query as Q


def column(spark, values, kind):
    return spark.createDataFrame(list(enumerate(values)), f"rn bigint, v {kind}")


def back(df, name="v"):
    return [r[name] for r in df.orderBy("rn").collect()]


INTS = {
    "constant": [7] * 40,
    "ascending": list(range(1000, 1100)),
    "runs": [i // 9 for i in range(90)],
    "spikes": [10**9 if i % 31 == 0 else i % 5 for i in range(124)],
    "negative": [(-1) ** i * i * i for i in range(70)],
    "single": [42],
    "extremes": [-(2**63), 2**63 - 1, 0, -1, 1, 2**63 - 1, -(2**63), 2**62, -(2**62)] * 3,
    "far_apart": [-(2**63)] * 20 + [2**63 - 1],
}


@pytest.mark.parametrize("name", INTS)
def test_integer_round_trips(spark, name):
    df = column(spark, INTS[name], "bigint")
    assert back(E.from_frame_of_reference(E.frame_of_reference(df, "v"), "v")) == INTS[name]
    assert back(E.delta_decode(E.delta_encode(df, "v"), "v")) == INTS[name]
    assert back(E.run_length_decode(E.run_length_encode(df, "v"), "v")) == INTS[name]
    assert back(E.dictionary_decode(*E.dictionary_encode(df, "v"), "v")) == INTS[name]
    assert back(E.patched_decode(E.patched_encode(df, "v"), "v")) == INTS[name]
    assert back(E.delta_frame_decode(E.delta_frame_encode(df, "v"), "v")) == INTS[name]
    assert back(E.from_frame_of_reference(E.block_encode(df, "v", rows=8), "v")) == INTS[name]
    costs = E.integer_costs(df, "v").first()
    assert costs["raw"] == 8 * len(INTS[name]) and all(costs[c] > 0 for c in E.INTEGER_CODECS)


def test_unsigned_round_trips(spark):
    values = [0, 1, 2**64 - 1, 2**63, 2**63 - 1, 5, 2**64 - 1]
    df = column(spark, [Decimal(v) for v in values], "decimal(20,0)")
    for encode, decode in ((E.frame_of_reference, E.from_frame_of_reference), (E.delta_encode, E.delta_decode), (E.delta_frame_encode, E.delta_frame_decode), (E.patched_encode, E.patched_decode)):
        assert [int(v) for v in back(decode(encode(df, "v"), "v", unsigned=True))] == values
    assert E.frame_of_reference(df, "v").first()["width"] == 64


def test_varints_and_widths(spark):
    numbers = [0, 1, 127, 128, 2**62, 2**63 - 1, -(2**63), -1]
    rows = spark.createDataFrame([(x,) for x in numbers], "x bigint").select(scalar.varint_length(F.col("x")), scalar.bit_length(F.col("x")), scalar.varint_length(scalar.zigzag(F.col("x")))).collect()
    zigzags = [(2 * x if x >= 0 else -2 * x - 1) for x in numbers]
    size = lambda u: max(1, -(-u.bit_length() // 7))
    assert [tuple(r) for r in rows] == [(size(x % 2**64), (x % 2**64).bit_length(), size(z)) for x, z in zip(numbers, zigzags)]


def test_block_choice(spark):
    r = random.Random(4)
    flat = [r.randrange(1000) for _ in range(1024)]
    mixed = [r.randrange(4) if i // 256 % 2 else r.randrange(2**40) for i in range(1536)]
    for values, rows in ((flat, 0), (mixed, 256), (mixed[:300], 0)):
        got = E.block_choice(column(spark, values, "bigint"), "v").first()
        assert got["rows"] == rows
        cost = lambda part: math.ceil(len(part) * (max(part) - min(part)).bit_length() / 8) + E.BLOCK_HEAD
        size = rows or len(values)
        assert got["bytes"] == sum(cost(values[i : i + size]) for i in range(0, len(values), size))


def test_symbol_tables_are_kept(spark):
    table = E.SymbolTable.train(column(spark, STRINGS, "string"), "v")
    assert E.SymbolTable.from_bytes(table.to_bytes()) == table
    assert list(table.symbols) == E.train_symbols([s.encode() for s in STRINGS if s is not None])
    for bad in (table.to_bytes()[:-1], table.to_bytes() + b"x"):
        with pytest.raises(InvalidPatchError):
            E.SymbolTable.from_bytes(bad)


FLOATS = [struct.unpack("<f", struct.pack("<I", i))[0] for i in (0, 1 << 31, 0x7F800000, 0xFF800000, 0x7FC00000, 1, 0x7F7FFFFF, 0x3DCCCCCD, 0x3E4CCCCD, 0x414570A4)] * 7


@pytest.mark.parametrize("way", [(E.xor_encode, E.xor_decode), (E.xor_window_encode, E.xor_window_decode), (E.real_double_encode, E.real_double_decode)])
def test_float_round_trips(spark, way):
    df = column(spark, FLOATS, "float")
    got = way[1](way[0](df, "v"), "v", width=32)
    assert got.schema["v"].dataType.simpleString() == "float"
    assert [struct.pack("<f", x) for x in back(got)] == [struct.pack("<f", x) for x in FLOATS]
    decimal = E.decimal_decode(E.decimal_encode(df, "v", 2), "v", 2)
    assert [struct.pack("<f", x) for x in back(decimal)] == [struct.pack("<f", x) for x in FLOATS]


def test_field_delta(spark):
    r = random.Random(2)
    rows = [(i, r.choice(STRINGS), f"user-{i // 7}-x") for i in range(200)]
    df = spark.createDataFrame(rows, "rn bigint, a string, b string")
    got = E.field_delta_decode(E.field_delta(df, ["a", "b"]), ["a", "b"]).orderBy("rn").collect()
    assert [tuple(x) for x in got] == rows


@pytest.mark.parametrize("chunk", [5, 64, 65_536])
def test_previous_of_a_group_over_chunks(spark, chunk, monkeypatch):
    monkeypatch.setattr(order, "CHUNK", chunk)
    r = random.Random(chunk)
    values = [r.choice(["a", "a", "a", "b", "c", None]) for _ in range(300)]
    df = column(spark, values, "string")
    last, pair, forms, seen = {}, [], [], set()
    for i, v in enumerate(values):
        prev = values[i - 1] if i else None
        pair.append(prev is not None and v is not None and last.get(prev) == v)
        forms.append("repeat" if i and v is not None and v == prev else "pair" if pair[-1] else "known" if v in seen else "new")
        last[prev] = v
        seen.add(v)
    assert [r["hit"] for r in E.markov_pair(df, "v").orderBy("rn").collect()] == pair
    assert [r["form"] for r in E.state_references(df, "v").orderBy("rn").collect()] == forms


DOUBLES = [0.0, -0.0, 1.5, math.inf, -math.inf, 5e-324, 1e308, 0.1, 0.2, 0.30000000000000004, 12.34, math.nan] * 9


@pytest.mark.parametrize("way", [(E.xor_encode, E.xor_decode), (E.xor_window_encode, E.xor_window_decode), (E.real_double_encode, E.real_double_decode)])
def test_double_round_trips(spark, way):
    got = back(way[1](way[0](column(spark, DOUBLES, "double"), "v"), "v"))
    assert [struct.pack("<d", x) for x in got] == [struct.pack("<d", x) for x in DOUBLES]


def test_decimals(spark):
    values = [1.25, 3.5, -7.75, 100.0, math.nan, -0.0, 1 / 3]
    df = column(spark, values, "double")
    assert E.decimal_exponent(df, "v").first()["exceptions"] == 3
    got = back(E.decimal_decode(E.decimal_encode(df, "v", 2), "v", 2))
    assert [struct.pack("<d", x) for x in got] == [struct.pack("<d", x) for x in values]


STRINGS = ["", "a", "ab", "abc", "abd", "b", "naïve", "naïf", None, "x" * 300, "x" * 299 + "y", "日本", "日光"] * 6


def test_string_round_trips(spark):
    df = column(spark, STRINGS, "string")
    assert back(E.front_delta_decode(E.front_delta(df, "v"), "v")) == STRINGS
    assert back(E.dictionary_decode(*E.dictionary_encode(df, "v"), "v")) == STRINGS
    table = E.train_symbol_table(df, "v")
    assert len(table) <= 255 and all(0 < len(s) <= 8 for s in table)
    assert back(E.symbol_decode(E.symbol_encode(df, "v", table), "packed", table, "w"), "w") == STRINGS
    assert back(E.nullable_join(*E.nullable_split(df, "v"), "v")) == STRINGS


def test_front_coding_restores(spark):
    df = column(spark, STRINGS, "string")
    last, out = b"", []
    for r in E.front_code(df, "v").orderBy("place").collect():
        last = last[: r["shared"]] + r["suffix"].encode()
        out.append(last.decode())
    assert out == sorted({s for s in STRINGS if s is not None}, key=str.encode)


def test_booleans(spark):
    values = [random.Random(1).random() < 0.4 for _ in range(53)]
    assert back(E.bool_unpack(E.bool_pack(column(spark, values, "boolean"), "v"), "v")) == values


def test_scalars(spark):
    df = spark.createDataFrame([(0, 0, 1, 1), (-1, 1, 1, 1), (2**62, 2**63 - 2**63, 1, 1)], "x bigint, a bigint, b bigint, c bigint")
    assert [r[0] for r in df.select(scalar.unzigzag(scalar.zigzag(F.col("x")))).collect()] == [0, -1, 2**62]
    df = spark.createDataFrame([("abcd", "abxx"), ("", "a"), ("é1", "é2"), ("same", "same")], "a string, b string")
    assert [r[0] for r in df.select(scalar.common_prefix(F.col("a"), F.col("b"))).collect()] == [2, 0, 2, 4]
    assert [r[0] for r in df.select(scalar.common_suffix(F.col("a"), F.col("b"))).collect()] == [0, 0, 0, 4]


@pytest.mark.parametrize("seed", range(3))
def test_skipping_never_changes_a_result(spark, seed):
    r = random.Random(seed)
    values = [float("nan") if r.random() < 0.05 else r.gauss(i / 50, 3) for i in range(1500)]
    df = numbered(column(spark, values, "double").withColumnRenamed("rn", "k"), "k").cache()
    zones = Z.build(df, "v")
    tests = [P.where_cmp("v", op, r.uniform(0, 30)) for op in (P.LT, P.LE, P.EQ, P.GE, P.GT, P.NE)] + [P.where_range("v", 5.0, 7.0), P.where_range("v", 7.0, 5.0)]
    for t in tests:
        assert sorted(x["k"] for x in Z.prune(df, zones, t).collect()) == sorted(x["k"] for x in Q.query(df, t).collect())


def test_masks_and_odd_bounds(spark):
    values = [float("nan") if i % 97 == 0 else i / 3 for i in range(1200)]
    df = numbered(column(spark, values, "double").withColumnRenamed("rn", "k"), "k").cache()
    zones = Z.build(df, "v")
    tests = [P.where_cmp("v", op, x) for op in range(8) for x in (100.0, float("nan"), float("inf"))] + [P.where_range("v", float("nan"), 7.0), P.where_range("v", 5.0, float("nan"))]
    for t in tests:
        assert Z.prune(df, zones, t).count() == Q.query(df, t).count()
    model = Z.LinearZones(1.0, 0.0, 1, 1000)
    assert model.zones(float("nan"), 5.0) is None and model.zones(0.0, float("nan")) is None and model.zones(0.0, float("inf")) == (0, 3)


def test_zones_of_unsigned_and_short_columns(spark):
    df = column(spark, [Decimal(2**64 - 1 - i) for i in range(600)], "decimal(20,0)")
    top = Z.build(df, "v").orderBy("zone").collect()
    assert [(int(z["zmin"]), int(z["zmax"])) for z in top] == [(2**64 - 1 - min(i + 255, 599), 2**64 - 1 - i) for i in (0, 256, 512)]
    t = P.where_cmp("v", P.GE, Decimal(2**64 - 10))
    assert Z.prune(df, Z.build_if_worth(df, "v"), t).count() == 10
    short = df.where(F.col("rn") < 511)
    assert Z.build_if_worth(short, "v") is None and Z.prune(short, None, t).count() == 10
    assert Z.linear_model(column(spark, list(range(200)), "bigint"), "v").first()["accepted"] is False  # the index is smaller


def test_linear_zones_have_no_false_skip(spark):
    values = [3 * i + (i * 7919) % 5 for i in range(2000)]
    df = numbered(column(spark, sorted(values), "bigint").withColumnRenamed("rn", "k"), "k").cache()
    model = Z.learn_linear(df, "v")
    assert model is not None
    for lo, hi in ((0, 10), (500, 600), (5990, 9000), (-5, -1), (2999, 2999)):
        t = P.where_range("v", lo, hi)
        assert Z.prune_linear(df, model, t).count() == Q.query(df, t).count()
    assert Z.learn_linear(df.withColumn("v", -F.col("v")), "v") is None


def test_numbering_over_partitions(spark):
    df = numbered(spark.range(1000).repartition(7).select((F.col("id") * 37 % 1000).alias("k")), "k")
    assert [(r["k"], r["rn"]) for r in df.orderBy("k").collect()] == [(i, i) for i in range(1000)]


@pytest.mark.parametrize("rows", [7, 1000])
@pytest.mark.parametrize("kinds", [1, 60])
def test_move_to_front_over_blocks(spark, rows, kinds):
    r = random.Random(kinds)
    values = [None if k == 1 else f"v{k}" for k in (r.randrange(kinds) for _ in range(60))]
    places = [i + 40 * (i // 20) for i in range(60)]  # with gaps longer than a block
    recent, want = [], []
    for v in values:
        want.append(recent.index(v) if v in recent else None)
        recent = [v, *(x for x in recent if x != v)]
    df = spark.createDataFrame(list(zip(places, values)), "rn bigint, v string")
    e = E.move_to_front(df, "v", rows=rows)
    assert back(e, "rank") == want
    firsts = e.where("rank IS NULL").join(df, "rn").select("rn", F.col("v").alias("value"))
    assert back(E.move_to_front_decode(e, firsts, "v", rows=rows)) == values


def test_byte_planes_of_any_width(spark):
    for kind, bits in (("smallint", 16), ("int", 32), ("bigint", 64)):
        values = [0, -1, None, 1, 300, -300, 2 ** (bits - 1) - 1, -(2 ** (bits - 1)), 2 ** (bits - 2) + 77]
        planes = E.byte_planes(column(spark, values, kind), "v")
        assert planes.first()["planes"] == [0] * (bits // 8) and back(E.from_byte_planes(planes, "v")) == values
    values = [0, 2**64 - 1, 2**63]
    df = column(spark, [Decimal(v) for v in values], "decimal(20,0)")
    assert [int(v) for v in back(E.from_byte_planes(E.byte_planes(df, "v"), "v", unsigned=True))] == values


def test_wrapping_raises_nothing(spark, monkeypatch):
    r = random.Random(3)
    edge = [0, 1, -1, 2**31, 2**32, -(2**32), 2**63 - 1, -(2**63)]
    pairs = [(a, b) for a in edge for b in edge] + [(r.randrange(-(2**63), 2**63), r.randrange(-(2**63), 2**63)) for _ in range(100)] + [(None, 1), (1, None)]
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", scalar.wrapping_sub(a, b).alias("sub"), scalar.wrapping_add(a, b).alias("add"))
    for x, y, sub, add in got.collect():
        assert (sub, add) == ((None, None) if x is None or y is None else (wrap(x - y), wrap(x + y)))
    assert "try_" not in got._jdf.queryExecution().toString()  # each overflow that is caught would cost an exception
    monkeypatch.setattr(order, "CHUNK", 8)
    values = [x for x, _ in pairs[:-2]]
    sums = back(order.with_wrapping_sum(column(spark, values, "bigint"), "v", "total"), "total")
    assert sums == [wrap(sum(values[: i + 1])) for i in range(len(values))]


def test_symbols_are_cut_greedily_by_many_tasks(spark):
    texts = [s.encode() for s in STRINGS if s is not None] + [bytes(range(256)), b"a.b|c\n" * 5, b"\xff\xff"]
    table = E.train_symbols(texts)
    for t in texts:
        want, at = [], 0
        while at < len(t):
            want.append(max((s for s in [*table, t[at : at + 1]] if t.startswith(s, at)), key=len))
            at += len(want[-1])
        assert E._cutter(table)(t) == want
    small = column(spark, ["Customer#0001", "Customer#0002"] * 50, "string").coalesce(1)
    packed = E.symbol_encode(small, "v", E.train_symbol_table(small, "v"))
    assert packed.select(F.spark_partition_id().alias("p")).distinct().count() > 1
