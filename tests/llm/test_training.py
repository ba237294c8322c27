"""The language model is fitted on every training document, and its size follows the distinct tokens."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from provintel.llm import lm_scoring as L
from provintel.llm.words import word_slices


def test_every_document_gives_evidence(spark):
    word = F.when(F.col("id") % 200 == 0, F.concat(F.lit("w"), (F.col("id") / 200).cast("int"))).otherwise("the")
    docs = spark.range(0, 60_000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(word, F.lit(" end")).alias("text"))
    vocabulary, bias = L.make_vocabulary(L.count_tokens(docs))
    tables = L.train(docs, vocabulary, bias)
    w = next(word_slices(iter([pa.RecordBatch.from_pydict({"text": [f"w{i}" for i in range(300)]})]), fold=True))
    row, hashes, rare = L.tokens(w)
    first = np.flatnonzero(np.diff(np.append(-1, row)))
    symbols = vocabulary.symbols(hashes, rare)[first]
    assert len(set(symbols.tolist())) == 300 and (np.abs(tables[0][symbols]).max(axis=1) > 0).all()


def test_unmet_tasks_do_not_dilute(spark):
    one = L._blocks(0, np.array([3]), np.array([0, 2]), np.array([1, 7]), np.array([2, 1]), np.array([[1.0, 2.0], [5.0, 6.0]]))
    two = L._blocks(0, np.array([3]), np.array([0, 1]), np.array([1]), np.array([6]), np.array([[5.0, 2.0]]))
    (got,) = L._averaged(iter([one, two]))
    assert got.column(2)[0].as_py() == [1, 7] and got.column(4)[0].as_py() == [4.0, 2.0, 5.0, 6.0]


def test_sizes_follow_the_distinct_tokens():
    small, large = L.sizes(1000), L.sizes(1 << 28)
    assert small == (16, 64, 1 << 13) and large.head > small.head and large.pairs > small.pairs


def test_probabilities_sum_to_one(spark):
    """Over all words of their own and all rare classes, whatever the context; a rare class's shares are those of its tokens and one unknown."""
    docs = spark.range(0, 3000, 1, 3).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), (F.col("id") % 700).cast("string"), F.lit(" the w"), (F.col("id") % 13).cast("string")).alias("text"))
    counted = L.count_tokens(docs)
    vocabulary, bias = L.make_vocabulary(counted, frequent=300)
    tables = L.train(docs, vocabulary, bias)
    size = vocabulary.sizes
    symbols = np.arange(size.head + L.RARE)
    for before in (0, 5, size.head + 3, size.symbols - 1):
        ctx = [np.full(len(symbols), x) for x in (before, before, size.symbols - 1, 7)]
        assert abs(np.exp(L.log_probabilities(tables, bias, ctx, symbols, size)).sum() - 1) < 1e-5
    rows, head = counted.toPandas(), set(vocabulary.head.view(np.int64).tolist())
    shares = rows[~rows.token.isin(head)].groupby("rare").n.apply(lambda n: (n + 1).sum() + 1)
    assert all(abs(10 ** vocabulary.log_rare[r] - v) < 1e-6 for r, v in shares.items())


def test_head_is_filled_when_one_bin_overflows(spark):
    docs = spark.range(0, 5000, 1, 3).select(F.col("id").alias("doc_id"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("text"))
    vocabulary, _ = L.make_vocabulary(L.count_tokens(docs), frequent=2000)
    assert len(vocabulary.head) == vocabulary.sizes.head and 1700 < len(vocabulary.frequent) < 2300
