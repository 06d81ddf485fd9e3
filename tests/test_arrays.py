"""Array and text expressions against plain Python."""

from pyspark.sql import functions as F

from millrace.functions.arrays import before, part_of, sums_before, text_blocks


def test_sums_and_maxima_before(spark):
    rows = [(n, [(7 * i) % 11 for i in range(n)]) for n in (0, 1, 63, 64, 65, 200, 4097)] + [(-1, None)]
    greatest = before(F.col("a"), F.lit(0), lambda a, b: F.greatest(a, b))
    for r in spark.createDataFrame(rows, "n int, a array<int>").select("a", sums_before(F.col("a")).alias("s"), greatest.alias("m")).collect():
        if r.a is None:
            assert r.s is None
            continue
        assert r.s == [sum(r.a[:i]) for i in range(len(r.a))] and r.m == [max([0, *r.a[:i]]) for i in range(len(r.a))]


def test_parts_of_long_texts(spark):
    texts = ["", "abc", "é😀x" * 3000, "a" * 4096, "b" * 4097]
    rows = [(t, a, n) for t in texts for a in (0, 1, 4095, 4096, 8191, 8192) for n in (0, 1, 40, 5000)]
    got = spark.createDataFrame(rows, "t string, a int, n int").select("*", part_of(text_blocks(F.col("t")), F.col("a"), F.col("n")).alias("x"))
    assert all(r.x == r.t[r.a : r.a + r.n] for r in got.collect())
