"""Vector codes: the annulus search against all entries, whole results against SQL and a plain version."""

from __future__ import annotations

import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lexiloom.llm import codebook, queries


def plain(x: np.ndarray, entries: np.ndarray) -> list[tuple[int, int]]:
    rows, book = x.tolist(), entries.tolist()
    return [min((sum((a - b) ** 2 for a, b in zip(r, e, strict=True)), i) for i, e in enumerate(book)) for r in rows]


def test_annuli_equal_all_entries():
    draw = np.random.default_rng(3)
    for width, high, n in ((4, 3, 40), (16, 500, 256), (1, 9, 5), (3, 1 << 40, 30), (2, 1 << 53, 7), (5, 1, 256), (2, 100, 1)):
        entries, x = draw.integers(-high, high + 1, (n, width)), draw.integers(-high, high + 1, (300, width))
        x[:20] = entries[draw.integers(0, n, 20)]
        at, d = codebook.Annuli.of(entries).nearest(x)
        assert [(int(b), int(a)) for a, b in zip(at, d, strict=True)] == plain(x, entries)
    at, d = codebook.Annuli.of(np.zeros((4, 2), np.int64)).nearest(np.zeros((3, 2), np.int64))
    assert at.tolist() == [0, 0, 0] and d.tolist() == [0, 0, 0]


def test_few_entries_are_evaluated():
    """With norms far apart the annulus holds a few entries of many."""
    entries = np.arange(1, 257)[:, None] * np.array([[1000, 0]])
    seen = []

    class Counting(codebook.Annuli):
        def _take(self, best, which, owner, index, d):
            seen.append(len(index))
            codebook.Annuli._take(best, which, owner, index, d)

    a = codebook.Annuli.of(entries)
    Counting(a.entries, a.order, a.norms).nearest(entries + 3)
    assert sum(seen) <= 256 * 2 * codebook.RING


def fixture(spark):
    draw = np.random.default_rng(8)
    rows = [(i * 3, [float(v) for v in draw.normal(0, 0.3, 8)], i % 3 if i % 7 else None) for i in range(400)]
    rows += [(5, None, 1), (6, [0.1] * 7 + [None], 1), (7, [math.nan] + [0.0] * 7, 2), (8, [math.inf] + [0.0] * 7, 2), (9, rows[0][1], 0), (9, rows[0][1], 0), (9, rows[1][1], 0), (2000, [-0.0001] * 8, None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_nulls_ties_and_repeated_rows_equal_sql(spark, tmp_path):
    vectors = fixture(spark)
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, queries.op13_vector_codes(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.sql(queries.OP13_SQL).fetchall()) and len(got) == 404


def test_few_short_and_no_vectors(spark):
    few = spark.createDataFrame([(1, [0.5, 0.25, 0.0], 1, "a"), (None, [], None, "b"), (2, [0.5], 1, "c"), (3, [1e30] * 4, None, "d")], "vec_id long, embedding array<double>, label int, code string")
    codes, books = codebook.compress(few)
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in codes.collect()}
    assert books.shape == (4, 4, 1) and got[1][0] == "00000000" and got[3][1] == 0
    assert set(got) == {1, 2, 3, None} and got[None][1] == 0 and got[None][2] == 0
    codes, books = codebook.compress(few.limit(0))
    assert codes.collect() == [] and books.size == 0 and len(codebook.digest(books)) == 64
    codes, books = codebook.compress(few.where("vec_id is null"))
    assert [tuple(r) for r in codes.select("code", "error").collect()] == [("00000000", 0)]


def test_codes_stand_for_near_vectors(spark):
    vectors = fixture(spark)
    codes, books = codebook.compress(vectors)
    back = codebook.decode(codes.where("vec_id > 9 and vec_id % 3 = 0"), books).join(vectors.withColumn("x", F.col("embedding").cast("array<double>")), "vec_id")
    for r in back.select("approx", "x", "error").take(50):
        if r.x:
            away = sum((math.floor(1024 * a) - round(1024 * b)) ** 2 for a, b in zip(r.x, r.approx, strict=True))
            assert away == r.error
