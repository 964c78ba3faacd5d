"""Running sums over ranges of equal row counts, against a plain loop."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from lorekeep.scale import ranged_sum


def rows_of(seed, n):
    r = random.Random(seed)
    key = lambda: r.choice(["hot"] * 6 + ["a", "b", None] + [f"k{r.randrange(n)}"])
    return [(key(), i % 7 if i % 11 else None, i, r.randrange(-5, 6)) for i in range(n)]


def expected(rows, keyed):
    total, out = defaultdict(int), {}
    for k, a, i, v in sorted(rows, key=lambda x: ((x[0] is not None, x[0] or "") if keyed else 0, x[1] is not None, x[1] or 0, x[2])):
        total[k if keyed else 0] += v
        out[i] = total[k if keyed else 0]
    return out


def test_running_sum_of_a_hot_key(spark):
    rows = rows_of(1, 3000)
    df = spark.createDataFrame(rows, "k string, a int, i long, v long").repartition(5)
    got = {r.i: r.s for r in ranged_sum(df, ["k"], ["a", "i"], F.col("v"), "s").collect()}
    assert got == expected(rows, True)


def test_running_sum_without_keys_spreads_over_ranges(spark):
    rows = rows_of(2, 2000)
    df = spark.createDataFrame(rows, "k string, a int, i long, v long").repartition(5)
    got = ranged_sum(df, [], ["a", "i"], F.col("v"), "s", keep=["i"])
    assert got.columns == ["i", "s"] and {r.i: r.s for r in got.collect()} == expected(rows, False)


def test_running_sum_of_nothing(spark):
    df = spark.createDataFrame([], "k string, a int, i long, v long")
    assert ranged_sum(df, ["k"], ["a", "i"], F.lit(1), "s").collect() == []


def test_python_takes_texts_by_bytes(spark):
    """A batch of long texts is never turned into objects as a whole; rows, nulls and order stay."""
    import pyarrow as pa

    from lorekeep.scale import small_runs, text_batches

    texts = pa.array(["a" * 60, None, "b" * 60, "", "c" * 500, "d"])
    assert list(small_runs(texts, 100)) == [(0, 2), (2, 2), (4, 1), (5, 1)] and list(small_runs(texts.slice(0, 0), 100)) == []
    cut = list(text_batches([pa.RecordBatch.from_arrays([texts], names=["text"])], "text", 100))
    assert [v for b in cut for v in b.column(0).to_pylist()] == texts.to_pylist()

    from lorekeep.operators.ingestion import embed_chunks

    asked = []

    def embed(found):
        asked.append(len(found))
        if sum(map(len, found)) > 3_000_000:
            raise ValueError("too much at a time")
        return [[1.0, float(len(t))] for t in found]

    rows = spark.range(0, 8, 1, 1).selectExpr("id", "repeat('x', 1000000 + cast(id as int)) AS text")
    got = embed_chunks(rows, embed, 2).select("id", "embedding").orderBy("id").collect()
    assert [r["embedding"][1] for r in got] == [1_000_000.0 + n for n in range(8)]
