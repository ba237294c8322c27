"""A passage that most documents share, with other text around it in each: crowded anchors against brute force."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from provintel.llm import suffix_dedup as S

WIDTH, GRAM = 60, 12


def texts():
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage, edge = say(150), say(25)
    out = [say(90) + passage + say(90) for _ in range(60)]
    out += [say(70) + passage + edge + say(70) for _ in range(5)] + [say(40) + passage[40:110] + say(9) + passage[90:] for _ in range(5)]
    return out + [passage, passage[:59], "", "a" * 200]


def removed(all_texts):
    count = Counter(t[k : k + WIDTH] for t in all_texts for k in range(len(t) - WIDTH + 1))
    out = {}
    for i, t in enumerate(all_texts):
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - WIDTH + 1):
            if count[t[k : k + WIDTH]] > 1:
                gone[k : k + WIDTH] = True
        out[i] = "".join(c for c, g in zip(t, gone, strict=True) if not g)
    return out


def test_crowded_anchors(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(40)
    for hot in (3, 20, 10**6):
        got = S.suffix_dedup(docs, width=WIDTH, gram=GRAM, hot=hot).collect()
        assert {r["doc_id"]: r["kept_text"] for r in got} == removed(texts())


def test_no_crowd_meets_in_one_array(spark):
    sides = spark.range(50).select((F.col("id") % 7 * F.col("id").between(0, 20).cast("long")).alias("meet"), "id")
    few, crowd = S.split_hot(sides, 3)
    assert {r["meet"] for r in crowd.collect()} == {0} and crowd.count() + few.count() == 50
    assert few.groupBy("meet").count().agg(F.max("count")).first()[0] <= 3
    assert S.split_hot(sides, 50)[1] is None
