import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade import sources
from colonnade.operators import vector as V


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(4).standard_normal((80, 40))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>").cache()


@pytest.mark.parametrize("budget", [V.max_rel_error(0.05), V.min_cosine(0.999), V.target_snr(35.0)])
def test_budget_is_met(vectors, budget):
    e = V.encode(vectors, "v", budget)
    assert e.lattice == "scalar"
    r = V.quality(V.decode(e, "v"), "v", "back").first()
    assert budget.met(r["worst_cosine"], r["worst_error"])


def test_small_vectors_stay_lossless(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<double>")
    assert V.encode(df, "v").lattice == "lossless"


def test_e8_points():
    x = np.random.default_rng(1).standard_normal((200, 8)) * 3
    z = V.nearest_e8(x)
    whole = np.abs(z - np.rint(z)).max(axis=1) < 1e-9
    assert ((np.abs(z * 2 - np.rint(z * 2)) < 1e-9).all(axis=1)).all()
    assert (np.rint(z.sum(axis=1)) % 2 == 0).all()
    assert whole.any() and (~whole).any()
    # no neighbouring lattice point is nearer
    for step in ([1, 1, 0, 0, 0, 0, 0, 0], [1, -1, 0, 0, 0, 0, 0, 0], [0.5] * 8, [0.5] * 6 + [-0.5] * 2):
        for s in (1, -1):
            assert (((x - z) ** 2).sum(axis=1) <= ((x - z - s * np.array(step)) ** 2).sum(axis=1) + 1e-9).all()


def test_grouped_budget(spark):
    x = np.random.default_rng(2).standard_normal((60, 64))
    df = spark.createDataFrame([(i % 3, v.tolist()) for i, v in enumerate(x)], "g int, v array<double>")
    got = V.grouped_encode(df, "g", "v", V.max_rel_error(0.1))
    assert {r["lattice"] for r in got.select("lattice").distinct().collect()} <= {"scalar", "e8"}
    assert V.quality(got, "v", "back").first()["worst_error"] <= 0.1


def test_knn_ties_and_self(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(9)], "id bigint, v array<double>")
    got = {(r["query"], r["rank"]): r["neighbor"] for r in V.exact_knn(df, "id", "v", k=2).collect()}
    assert got[0, 1] == 3 and got[0, 2] == 6 and got[3, 1] == 0


def test_float32_files(spark, tmp_path):
    (tmp_path / "a.f32").write_bytes(struct.pack("<6f", 1, 2, 3, 4, 5, 6))
    got = sources.read_float32(spark, str(tmp_path), 3).orderBy("idx").collect()
    assert [r["vec"] for r in got] == [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]
    (tmp_path / "b.f32").write_bytes(b"12345")
    with pytest.raises(Exception, match="no vectors"):
        sources.read_float32(spark, str(tmp_path), 3).collect()


def test_batches(spark):
    got = list(sources.batches(spark.range(10).withColumn("s", F.lit("x")), 4))
    assert [b.num_rows for b in got] == [4, 4, 2]


def test_typed_read_checks_kinds(spark, sf_dir):
    from pyspark.sql import types as T

    from colonnade.errors import TypeMismatchError

    target = T.StructType([T.StructField("n_nationkey", T.StringType())])
    with pytest.raises(TypeMismatchError):
        sources.read(spark, f"{sf_dir}/nation.parquet", target=target)


def test_neighbours_of_all_rows(spark, vectors):
    x = {r["id"]: np.array(r["v"]) for r in vectors.collect()}
    want = {q: sorted((float(((x[i] - x[q]) ** 2).sum()), i) for i in x if i != q)[:3] for q in x}
    for shard, block in ((8192, 128), (13, 7)):
        got = {}
        for r in V.exact_knn(vectors, "id", "v", k=3, shard_rows=shard, block_rows=block).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append(r["neighbor"])
        assert got == {q: [i for _, i in w] for q, w in want.items()}
    some = V.exact_knn(vectors, "id", "v", k=200, queries=vectors.where("id % 40 = 0"))
    assert some.count() == 2 * 79


def test_codebooks_are_of_all_rows(spark, vectors):
    x = np.array([r["v"] for r in vectors.orderBy("id").collect()])
    books = V.train_codebooks(vectors, "v", parts=4, codes=5, rounds=3)
    again = V.train_codebooks(vectors.repartition(5), "v", parts=4, codes=5, rounds=3)
    assert all(np.allclose(a, b) for a, b in zip(books, again))
    more = V.train_codebooks(vectors, "v", parts=4, codes=5, rounds=4)
    for piece, a, b in zip(np.array_split(x, 4, axis=1), books, more):
        near = ((piece[:, None] - a[None]) ** 2).sum(axis=2).argmin(axis=1)  # the next round's centroids are the means of what is nearest now
        assert np.allclose(b, np.stack([piece[near == k].mean(axis=0) if (near == k).any() else a[k] for k in range(5)]))
    back = {r["id"]: np.array(r["back"]) for r in V.product_quantize(vectors, "v", books=books).collect()}
    for i, v in enumerate(x):
        assert np.allclose(back[i], np.concatenate([a[((p - a) ** 2).sum(axis=1).argmin()] for p, a in zip(np.array_split(v, 4), books)]))


def test_rotated_grids(vectors):
    """Against matrices written out: the transform's own, and a search over nearby lattice points."""
    n = 64
    h = np.array([[(-1) ** bin(i & j).count("1") for j in range(n)] for i in range(n)]) / 8.0
    signs = np.random.default_rng([1, n]).integers(0, 2, n) * 2.0 - 1.0
    for r in V.rotated_scalar(V.rotate(vectors, "v"), "v", 0.3).collect():
        y = h @ (np.pad(np.array(r["v"]), (0, 24)) * signs)
        assert np.allclose(r["rotated"], y)
        assert np.allclose(r["back"], (signs * (h.T @ (np.rint(y / 0.3) * 0.3)))[:40])
    for r in V.e8_quantize(vectors, "v", 0.3).limit(5).collect():
        turned = h @ (np.pad(np.array(r["v"]), (0, 24)) * signs)
        got = V.nearest_e8(turned.reshape(-1, 8) / 0.3).reshape(-1) * 0.3
        assert np.allclose(r["e8"], (signs * (h.T @ got))[:40])


def test_large_groups_are_encoded_in_parts(spark):
    x = np.random.default_rng(9).standard_normal((200, 32))
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id bigint, g int, v array<double>")
    got = V.grouped_encode(df, "g", "v", V.max_rel_error(0.05), part_rows=30).collect()
    assert sorted(r["id"] for r in got) == list(range(200))
    assert all(np.linalg.norm(np.array(r["back"]) - np.array(r["v"])) <= 0.05 * np.linalg.norm(r["v"]) + 1e-9 for r in got)
    assert {r["lattice"] for r in got} - {"lossless"}
