"""Diff and apply of tables: keyed, positional, by column, by map key; fingerprints, baselines.

Values are equal by their bits: a NaN equals a NaN, -0.0 differs from 0.0, null differs from
an empty container.  A change set is a table with one row for each changed key or place;
``new`` carries the whole new row, so that applying is one join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..errors import BaselineEvictedError, BaselineRequiredError, BaseMismatchError, InvalidPatchError, SchemaMismatchError, UnsupportedError
from ..functions.scalar import wrapping_add, wrapping_sub
from .canonical import canonical
from .order import numbered

INSERT, DELETE, UPDATE, REORDER = "insert", "delete", "update", "reorder"
SPARSE, ARITHMETIC, DENSE = "sparse", "delta", "dense"
LEAST_COLUMNAR = 16


def same(a: Column, b: Column, dtype: T.DataType) -> Column:
    """Equality by bits; true for two nulls."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        # a zero's sign shows in its text only
        return F.coalesce(a.eqNullSafe(b) & ((a != 0) | (a.cast("string") == b.cast("string"))), a.isNull() & b.isNull())
    if isinstance(dtype, T.StructType):
        out = a.isNull() == b.isNull()
        for f in dtype.fields:
            out = out & same(a[f.name], b[f.name], f.dataType)
        return out
    if isinstance(dtype, T.ArrayType):
        each = F.forall(F.zip_with(a, b, lambda x, y: same(x, y, dtype.elementType)), lambda x: x)
        return F.coalesce((F.size(a) == F.size(b)) & each, F.lit(False)) | (a.isNull() & b.isNull())
    if isinstance(dtype, T.MapType):
        entries = T.ArrayType(T.StructType([T.StructField("key", dtype.keyType), T.StructField("value", dtype.valueType)]))
        order = lambda m: F.array_sort(F.map_entries(m), lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
        return same(order(a), order(b), entries)
    return a.eqNullSafe(b)


def _check(old: DataFrame, new: DataFrame) -> None:
    if S.fingerprint(old.schema) != S.fingerprint(new.schema):
        raise SchemaMismatchError("the tables have different schemas")


def _sides(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    o = old.select(*[F.col(f"`{k}`") for k in keys], F.struct(*[F.col(f"`{c}`") for c in old.columns]).alias("old"))
    n = new.select(*[F.col(f"`{k}`") for k in keys], F.struct(*[F.col(f"`{c}`") for c in new.columns]).alias("new"))
    return o.join(n, keys, "full_outer")


def _changed_fields(schema: T.StructType, keys: list[str]) -> Column:
    return F.filter(F.array(*[F.when(~same(F.col("old")[f.name], F.col("new")[f.name], f.dataType), F.lit(f.name)) for f in schema.fields if f.name not in keys]), lambda x: x.isNotNull())


def has_duplicate_keys(df: DataFrame, *keys: str) -> bool:
    return df.groupBy(*keys).count().where("count > 1").limit(1).count() > 0


def with_nth(df: DataFrame, *keys: str, out: str = "nth") -> DataFrame:
    """Add ``out``: each row's place, from 0, among the rows with its keys, in the order of its other values (maps aside).

    Keys that repeat are distinct with it, so a change set by ``(*keys, out)`` tells such rows apart.
    """
    if not has_duplicate_keys(df, *keys):
        return df.withColumn(out, F.lit(0).cast("bigint"))
    rest = [f.name for f in df.schema.fields if f.name not in keys and "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    rows = numbered(df, *keys, *rest, out="_rn")
    first = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("_rn").alias("_first"))
    joined = rows.join(first, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_rn") - F.col("_first")).alias(out))


def diff_keyed(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Change set by key: keys, op, changed (names of changed fields), new (the new row).

    Keys must be distinct on both sides (see :func:`diff` and :func:`with_nth`).
    """
    _check(old, new)
    joined = _sides(old, new, list(keys))
    op = F.when(F.col("old").isNull(), F.lit(INSERT)).when(F.col("new").isNull(), F.lit(DELETE)).otherwise(F.lit(UPDATE))
    changed = F.when((op == UPDATE), _changed_fields(old.schema, list(keys)))
    return joined.select(*keys, op.alias("op"), changed.alias("changed"), "new").where((F.col("op") != UPDATE) | (F.size("changed") > 0))


def diff_positional(old: DataFrame, new: DataFrame, rn: str = "rn") -> DataFrame:
    """Change set by place: both tables carry row numbers from 0.  A tail that only ``new``
    has is inserted, one that only ``old`` has is deleted."""
    return diff_keyed(old, new, rn)


def diff(old: DataFrame, new: DataFrame, key: str | None = None, rn: str | None = None) -> tuple[str, DataFrame]:
    """("keyed", change set) by ``key`` - the one given or the one the schema marks - if it is
    distinct on both sides, else ("positional", change set) by ``rn``."""
    key = key or S.key_of(old.schema)
    if key and not has_duplicate_keys(old, key) and not has_duplicate_keys(new, key):
        return "keyed", diff_keyed(old, new, key)
    if rn is None:
        raise UnsupportedError("diff", key, "distinct keys or row numbers", "neither")
    return "positional", diff_positional(old, new, rn)


def apply_changes(base: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """``base`` after the change set.

    Raises InvalidPatchError if the set names a key twice, changes or deletes a key that
    ``base`` lacks, or inserts one that it has.
    """
    _check_fit(base, changes, keys)
    c = changes.select(*keys, F.col("op").alias("_op"), F.col("new").alias("_new"))
    b = base.select(*[F.col(f"`{k}`") for k in keys], F.struct(*[F.col(f"`{x}`") for x in base.columns]).alias("_old"))
    joined = b.join(c, list(keys), "full_outer")
    kept = joined.where(F.col("_op").isNull() | (F.col("_op") != DELETE))
    row = F.when(F.col("_op").isNull(), F.col("_old")).otherwise(F.col("_new"))
    return kept.select(row.alias("_row")).select(*[F.col("_row")[x].alias(x) for x in base.columns])


def _check_fit(base: DataFrame, changes: DataFrame, keys: tuple[str, ...] | list[str]) -> None:
    """One pass over keys and ops; rows themselves aren't read."""
    c = changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("op").alias("_op"))
    have = base.select(*[F.col(f"`{k}`") for k in keys], F.lit(True).alias("_has"))
    r = c.join(have, list(keys), "left").agg(F.count_if(F.col("_n") > 1).alias("twice"), F.count_if(F.col("_has").isNull() != (F.col("_op") == INSERT)).alias("unfit")).first()
    if r["twice"]:
        raise InvalidPatchError("a key is changed more than once")
    if r["unfit"]:
        raise InvalidPatchError("the change set doesn't fit the base")


def ordered(changes: DataFrame, *keys: str, out: str = "place") -> DataFrame:
    """A change set in the order of its keys, with each change's ``place`` in it."""
    return numbered(changes, *keys, out=out)


def append_changes(first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    """One change set that does what ``first`` and then ``second`` do.

    An insert that is deleted again leaves nothing, a delete that is inserted again is an update of
    all fields.  Raises InvalidPatchError if ``second`` inserts what ``first`` leaves there or changes
    or deletes what it deletes.
    """
    fields = [f.name for f in first.schema["new"].dataType.fields if f.name not in keys]
    a = first.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in ("op", "changed", "new")])
    b = second.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in ("op", "changed", "new")])
    j = a.join(b, list(keys), "full_outer")
    both = F.col("_a_op").isNotNull() & F.col("_b_op").isNotNull()
    if j.where(both & ((F.col("_a_op") == DELETE) != (F.col("_b_op") == INSERT))).limit(1).count():
        raise InvalidPatchError("the second change set doesn't follow the first")
    gone = both & (F.col("_a_op") == INSERT) & (F.col("_b_op") == DELETE)
    op = F.when(~both, F.coalesce("_a_op", "_b_op")).when(F.col("_a_op") == DELETE, UPDATE).when(F.col("_a_op") == INSERT, INSERT).otherwise(F.col("_b_op"))
    every = F.array(*[F.lit(x) for x in fields])
    some = F.array_sort(F.array_union(F.coalesce("_a_changed", F.array().cast("array<string>")), F.coalesce("_b_changed", F.array().cast("array<string>"))))
    changed = F.when(op == UPDATE, F.when(both & (F.col("_a_op") == DELETE), every).otherwise(F.filter(every, lambda x: F.array_contains(some, x))))
    new = F.when(F.col("_b_op").isNotNull(), F.col("_b_new")).otherwise(F.col("_a_new"))
    return j.where(~gone).select(*keys, op.alias("op"), changed.alias("changed"), new.alias("new"))


# Values within values

SAME, REPLACE, MERGE = "same", "replace", "merge"


def value_patch(old: Column, new: Column, dtype: T.DataType) -> Column:
    """What turns ``old`` to ``new``: struct (op, value, and for containers merge).

    Equal values are ``same``.  Structs merge field by field; maps by ``set`` (a patch for each key
    that is new or changed) and ``drop`` (keys that go); arrays by ``at`` (idx and patch of the
    places that differ), ``tail`` (elements past the old end) and ``size``.  Anything else, and a
    value that becomes null or was null, is replaced whole.  Nothing is written twice: ``value`` is
    null where ``merge`` tells the change.
    """
    equal = same(old, new, dtype)
    merge = _merge(old, new, dtype)
    if merge is None:
        op = F.when(equal, SAME).otherwise(REPLACE)
        return F.struct(op.alias("op"), F.when(~equal, new).alias("value"))
    op = F.when(equal, SAME).when(old.isNull() | new.isNull(), REPLACE).otherwise(MERGE)
    return F.struct(op.alias("op"), F.when(op == REPLACE, new).alias("value"), F.when(op == MERGE, merge).alias("merge"))


def _merge(old: Column, new: Column, dtype: T.DataType) -> Column | None:
    if isinstance(dtype, T.StructType) and dtype.fields:
        return F.struct(*[value_patch(old[f.name], new[f.name], f.dataType).alias(f.name) for f in dtype.fields])
    if isinstance(dtype, T.MapType):
        v = dtype.valueType
        get = lambda m, k: F.try_element_at(m, k)
        put = F.map_filter(new, lambda k, x: ~F.map_contains_key(old, k) | ~same(get(old, k), x, v))
        return F.struct(F.transform_values(put, lambda k, x: value_patch(get(old, k), x, v)).alias("set"), F.array_sort(F.array_except(F.map_keys(old), F.map_keys(new))).alias("drop"))
    if isinstance(dtype, T.ArrayType):
        e = dtype.elementType
        size = F.least(F.size(old), F.size(new))
        pairs = F.zip_with(F.slice(old, F.lit(1), size), F.slice(new, F.lit(1), size), lambda a, b: value_patch(a, b, e))
        at = F.filter(F.transform(pairs, lambda p, i: F.struct(i.alias("idx"), p.alias("patch"))), lambda p: p["patch"]["op"] != SAME)
        return F.struct(at.alias("at"), F.slice(new, size + 1, F.greatest(F.size(new) - size, F.lit(0))).alias("tail"), F.size(new).alias("size"))
    return None


def patched_value(old: Column, patch: Column, dtype: T.DataType) -> Column:
    """``old`` after :func:`value_patch`."""
    whole = F.when(patch["op"] == SAME, old).when(patch["op"] == REPLACE, patch["value"])
    if isinstance(dtype, T.StructType) and dtype.fields:
        return whole.otherwise(F.struct(*[patched_value(old[f.name], patch["merge"][f.name], f.dataType).alias(f.name) for f in dtype.fields]))
    if isinstance(dtype, T.MapType):
        m = patch["merge"]
        kept = F.map_filter(old, lambda k, _: ~F.array_contains(m["drop"], k) & ~F.map_contains_key(m["set"], k))
        # a key that wasn't there is new whatever its patch says: null is no value to start from
        return whole.otherwise(F.map_concat(kept, F.transform_values(m["set"], lambda k, p: patched_value(F.try_element_at(old, k), p, dtype.valueType))))
    if isinstance(dtype, T.ArrayType):
        m = patch["merge"]
        head = F.transform(F.slice(old, F.lit(1), F.least(F.size(old), m["size"])), lambda x, i: F.struct(x.alias("x"), F.get(F.filter(m["at"], lambda a: a["idx"] == i), F.lit(0))["patch"].alias("p")))
        return whole.otherwise(F.concat(F.transform(head, lambda h: F.when(h["p"].isNull(), h["x"]).otherwise(patched_value(h["x"], h["p"], dtype.elementType))), m["tail"]))
    return whole


def diff_nested(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """As :func:`diff_keyed`, but an update carries a patch for each field in ``patch`` and no row:
    what changes deep in a struct, map or array travels without what is around it."""
    _check(old, new)
    fields = [f for f in old.schema.fields if f.name not in keys]
    joined = _sides(old, new, list(keys)).withColumn("op", F.when(F.col("old").isNull(), INSERT).when(F.col("new").isNull(), DELETE).otherwise(UPDATE))
    patch = F.struct(*[value_patch(F.col("old")[f.name], F.col("new")[f.name], f.dataType).alias(f.name) for f in fields])
    changes = joined.select(*keys, "op", F.when(F.col("op") == UPDATE, patch).alias("patch"), F.when(F.col("op") == INSERT, F.col("new")).alias("new"))
    differs = F.lit(False)
    for f in fields:
        differs = differs | (F.col("patch")[f.name]["op"] != SAME)
    return changes.where((F.col("op") != UPDATE) | differs)


def apply_nested(base: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """``base`` after a change set of :func:`diff_nested`; raises as :func:`apply_changes` does."""
    _check_fit(base, changes, keys)
    c = changes.select(*keys, F.col("op").alias("_op"), F.col("patch").alias("_patch"), F.col("new").alias("_new"))
    b = base.select(*[F.col(f"`{k}`") for k in keys], F.struct(*[F.col(f"`{x}`") for x in base.columns]).alias("_old"))
    kept = b.join(c, list(keys), "full_outer").where(F.col("_op").isNull() | (F.col("_op") != DELETE))
    old, op = F.col("_old"), F.col("_op")
    value = lambda f: old[f.name] if f.name in keys else patched_value(old[f.name], F.col("_patch")[f.name], f.dataType)
    return kept.select(*[F.when(op.isNull(), old[f.name]).when(op == INSERT, F.col("_new")[f.name]).otherwise(value(f)).alias(f.name) for f in base.schema.fields])


def column_changes(changes: DataFrame, old: DataFrame, *keys: str) -> DataFrame:
    """One row for each changed (key, column) of an update, with the new value as text."""
    out = changes.where(F.col("op") == UPDATE).select(*keys, "new", F.explode("changed").alias("column"))
    value = F.coalesce(*[F.when(F.col("column") == f.name, F.col("new")[f.name].cast("string")) for f in old.schema.fields if f.name not in keys and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))])
    return out.select(*keys, "column", value.alias("value"))


def key_order(old: DataFrame, new: DataFrame, key: str, rn: str = "rn") -> tuple[bool, DataFrame]:
    """(whether the sequence of keys changed, the new sequence: rn, key)."""
    o, n = old.select(rn, F.col(key).alias("_a")), new.select(rn, F.col(key).alias("_b"))
    moved = o.join(n, rn, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).limit(1).count() > 0
    return moved, new.select(rn, key)


def apply_order(rows: DataFrame, order: DataFrame, key: str, rn: str = "rn") -> DataFrame:
    """``rows`` numbered by the listed order; the list and the rows must hold the same keys once."""
    if has_duplicate_keys(order, key):
        raise InvalidPatchError("a key is listed more than once")
    plain = rows.drop(rn)
    joined = order.withColumn("_listed", F.lit(True)).join(plain.withColumn("_has", F.lit(True)), key, "full_outer")
    if joined.where(F.col("_listed").isNull() | F.col("_has").isNull()).limit(1).count():
        raise InvalidPatchError("the listed keys aren't those of the rows")
    return joined.select(rn, *plain.columns)


# By column


def column_stats(old: DataFrame, new: DataFrame, rn: str = "rn") -> DataFrame:
    """(column, n, changed, mode) of two tables of one length, joined by place.

    Unchanged columns have no row.  Mode: nullable columns dense; at most a quarter changed
    sparse; integers and booleans delta; the others dense.
    """
    _check(old, new)
    fields = [f for f in old.schema.fields if f.name != rn]
    joined = _sides(old, new, [rn])
    agg = joined.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("old").isNull() | F.col("new").isNull()).alias("_single"), *[F.count_if(~same(F.col("old")[f.name], F.col("new")[f.name], f.dataType)).alias(f"c{i}") for i, f in enumerate(fields)])
    long = agg.select("n", "_single", F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(_arithmetic(f.dataType)).alias("arithmetic"), F.lit(f.nullable and f.metadata.get("nullable", False)).alias("nullable"), F.col(f"c{i}").alias("changed")) for i, f in enumerate(fields)])).alias("s"))
    out = long.where((F.col("_single") == 0) & (F.col("n") >= LEAST_COLUMNAR)).select("s.column", "n", "s.changed", "s.arithmetic", "s.nullable").where("changed > 0")
    mode = F.when(F.col("nullable"), DENSE).when(F.col("changed") * 4 <= F.col("n"), SPARSE).when(F.col("arithmetic"), ARITHMETIC).otherwise(DENSE)
    return out.select("column", "n", "changed", mode.alias("mode"))


def _arithmetic(dtype: T.DataType) -> bool:
    return S.kind_of(dtype) in ("int", "uint", "bool")


def wrapped_delta(old: Column, new: Column) -> Column:
    """new - old modulo 2^64, as a signed 64-bit integer."""
    return wrapping_sub(new, old)


def wrapped_add(base: Column, delta: Column) -> Column:
    """base + delta modulo 2^64, as a signed 64-bit integer."""
    return wrapping_add(base, delta)


def column_delta(old: DataFrame, new: DataFrame, column: str, rn: str = "rn") -> DataFrame:
    """(rn, delta): wrapping differences of an integer column; for booleans whether it flipped."""
    joined = old.select(rn, F.col(column).alias("_o")).join(new.select(rn, F.col(column).alias("_n")), rn)
    if isinstance(old.schema[column].dataType, T.BooleanType):
        return joined.select(rn, (F.col("_o") != F.col("_n")).alias("delta"))
    return joined.select(rn, wrapped_delta(F.col("_o"), F.col("_n")).alias("delta"))


def apply_column_delta(base: DataFrame, delta: DataFrame, column: str, rn: str = "rn") -> DataFrame:
    dtype = base.schema[column].dataType
    j = base.join(delta, rn, "left")
    if isinstance(dtype, T.BooleanType):
        return j.withColumn(column, F.col(column) != F.coalesce("delta", F.lit(False))).drop("delta")
    return j.withColumn(column, wrapped_add(F.col(column), F.coalesce("delta", F.lit(0))).cast(dtype)).drop("delta")


# Maps


def map_diff(old: Column, new: Column, dtype: T.MapType) -> Column:
    """Struct of a map's change: replace (null on one side only), set (entries new or changed), drop (keys)."""
    get = lambda m, k: F.try_element_at(m, k)
    put = F.map_filter(new, lambda k, v: ~F.map_contains_key(old, k) | ~same(get(old, k), v, dtype.valueType))
    gone = F.array_sort(F.array_except(F.map_keys(old), F.map_keys(new)))
    both = old.isNotNull() & new.isNotNull()
    return F.struct((old.isNull() != new.isNull()).alias("replace"), F.when(both, put).otherwise(new).alias("set"), F.when(both, gone).alias("drop"))


def map_apply(old: Column, change: Column) -> Column:
    put, gone = change["set"], change["drop"]
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(gone, k) & ~F.map_contains_key(put, k))
    return F.when(change["replace"] | old.isNull(), put).otherwise(F.map_concat(kept, put))


def array_diff(old: Column, new: Column, dtype: T.ArrayType) -> Column:
    """Entries (idx, value) of equally long arrays where the values differ; null if none do."""
    pairs = F.zip_with(old, new, lambda a, b: F.struct(same(a, b, dtype.elementType).alias("same"), b.alias("value")))
    out = F.filter(F.transform(pairs, lambda p, i: F.struct(i.alias("idx"), p["value"].alias("value"), p["same"].alias("same"))), lambda p: ~p["same"])
    return F.transform(out, lambda p: F.struct(p["idx"].alias("idx"), p["value"].alias("value")))


def array_apply(old: Column, entries: Column) -> Column:
    """``old`` with the values of :func:`array_diff` put in their places."""
    at = F.transform(entries, lambda e: e["idx"].cast("bigint"))
    return F.transform(old, lambda x, i: F.when(F.array_contains(at, i.cast("bigint")), F.element_at(F.filter(entries, lambda e: e["idx"] == i), 1)["value"]).otherwise(x))


def map_hash(column: Column, dtype: T.MapType) -> Column:
    """A hash of a map that doesn't hang on the order of its entries; null for null."""
    hashes = F.transform(F.map_entries(column), lambda e: F.xxhash64(e["key"], _hashable(e["value"], dtype.valueType)))
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, h: a.bitwiseXOR(h))


# Fingerprints


def base_fingerprint(df: DataFrame, rn: str | None = None) -> str:
    """Fingerprint of a table's rows: by place if ``rn`` is given, else in any order.

    The seed is fixed, so that change sets can be checked in any process.
    """
    row = F.xxhash64(*[_hashable(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if f.name != rn], *([F.col(rn)] if rn else []))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(1_000_003))).alias("s")).first()
    return f"{r['n']}:{(r['x'] or 0) & (1 << 64) - 1:016x}:{r['s'] or 0}"


def _hashable(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.FloatType | T.DoubleType):
        return c.cast("string")  # keeps the sign of zero
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        # null and empty differ in JSON
        return F.to_json(F.struct(canonical(c, dtype).alias("v")), {"ignoreNullFields": "false"})
    return F.coalesce(F.xxhash64(c, c.isNull()), F.lit(0))


@dataclass(frozen=True)
class Patch:
    """A change set with the fingerprints of the schema and (unless left out) the base it is for."""

    changes: DataFrame
    keys: tuple[str, ...]
    schema_fp: str
    base_fp: str | None


def make_patch(old: DataFrame, new: DataFrame, *keys: str, check_base: bool = True) -> Patch:
    return Patch(diff_keyed(old, new, *keys), keys, S.fingerprint(old.schema), base_fingerprint(old) if check_base else None)


def apply_patch(base: DataFrame, patch: Patch) -> DataFrame:
    if S.fingerprint(base.schema) != patch.schema_fp:
        raise SchemaMismatchError("the patch is for another schema")
    if patch.base_fp is not None and base_fingerprint(base) != patch.base_fp:
        raise BaseMismatchError("the patch is for other rows")
    return apply_changes(base, patch.changes, *patch.keys)


@dataclass
class BaselineRegistry:
    """Tables by fingerprint; a patch is applied to the one it is for, and the result registered.

    Nothing is evicted but by :meth:`evict`.
    """

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def register(self, df: DataFrame) -> str:
        fp = base_fingerprint(df)
        self.tables[fp] = df
        return fp

    def apply(self, patch: Patch) -> DataFrame:
        if patch.base_fp is None:
            raise BaselineRequiredError("the patch has no base fingerprint")
        if patch.base_fp not in self.tables:
            raise BaselineEvictedError(patch.base_fp)
        out = apply_patch(self.tables[patch.base_fp], patch)
        self.register(out)
        return out

    def evict(self, fp: str) -> None:
        self.tables.pop(fp, None)

    def __len__(self) -> int:
        return len(self.tables)
