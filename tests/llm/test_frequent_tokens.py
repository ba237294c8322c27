"""The frequent tokens are taken by a test that doesn't grow with the number of count bins."""

from pyspark.sql import functions as F

from provintel.llm import lm_scoring


def test_taking_frequent_tokens_costs_the_same_for_many_bins(spark, monkeypatch):
    plans, dataframe = [], type(spark.range(1))
    to_pandas = dataframe.toPandas
    monkeypatch.setattr(dataframe, "toPandas", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), to_pandas(df))[1])
    rows = [(i * 7919 % 100_003 - 50_000, i % lm_scoring.RARE, 1 + i * i // 40) for i in range(3000)]
    counted = spark.createDataFrame(rows, "token long, rare int, n long")
    for most in (0, 1, 700, 1500, 2999, 3000, 5000):
        vocabulary, _ = lm_scoring.make_vocabulary(counted, most)
        bins = counted.withColumn("bin", F.floor(F.log2("n") * 16)).collect()
        want, seen = set(), 0
        for b in sorted({r["bin"] for r in bins}, reverse=True):
            inside = [r["token"] for r in bins if r["bin"] == b]
            share = min(1.0, (most - seen) / len(inside))
            want.update(t for t in inside if share == 1 or t < int((share - 0.5) * 2.0**64))
            seen += len(inside)
            if seen >= most:
                break
        assert sorted(vocabulary.frequent.astype("int64").tolist()) == sorted(want)
    assert max(p.upper().count("LOG2") for p in plans) <= 4
