import random

from conftest_llm import CLASHES

from tabularium.llm import hamming

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    codes = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and len(v) == 64:
            codes.setdefault(i, tuple(x is not None and x > 0 for x in v))
    out = []
    for q, c in codes.items():
        if q % 50 == 0:
            near = sorted((sum(a != b for a, b in zip(c, d, strict=True)), i) for i, d in codes.items() if i != q)[:k]
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return sorted(out)


def run(spark, rows, k=10, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHES:
        df = df.withColumn(c, df["label"])
    return sorted(tuple(r) for r in hamming.nearest(df, df.where("vec_id % 50 = 0"), k, **options).collect())


def test_same_as_brute_force(spark):
    rng = random.Random(1)
    centre = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, 0.7) for x in centre[i % 4]], 1) for i in range(400)]
    rows += [(1000 + i, rows[50][1], 1) for i in range(60)]  # a group of copies, and ties by id
    assert run(spark, rows) == brute(rows, 10)
    assert run(spark, rows, 3, segments=4, chunk=16) == brute(rows, 3)


def test_odd_rows(spark):
    one, nan = [1.0] * 64, [float("nan")] * 32 + [1.0] * 32
    rows = [(0, one, 1), (0, one, 1), (50, nan, 1), (1, None, 1), (2, [1.0], 1), (None, one, 1), (3, [None] * 64, 1), (4, [-1.0] * 64, None)]
    assert run(spark, rows) == brute(rows, 10)
    assert run(spark, []) == [] and run(spark, [(0, one, 1)]) == []


def test_segments_of_unequal_width(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)], 1) for i in range(250)]
    for segments in (5, 7, None):
        assert run(spark, rows, 4, segments=segments) == brute(rows, 4)

