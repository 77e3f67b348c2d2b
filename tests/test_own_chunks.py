"""The search over own chunks: compact documents against the plain searches, and what the whole way moves."""

import os
import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import retrieval as R

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_compact_search_is_exact(spark):
    from leafmill.operators import compact as V

    r = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(r.choices(words, [1 / (k + 1) for k in range(60)], k=n))
    docs = spark.createDataFrame([(f"d{k}", text(r.randint(0, 12)), 0) for k in range(3000)], "doc_id string, text string, n_images int")
    asked = spark.createDataFrame([*((k, text(5)) for k in range(40)), (40, None), (41, ""), (42, "unknown"), (43, "w59")], "query_id long, question string")
    q = V.questions(asked)
    got = V.both_searches(q, V.compacted(docs, q["words"]))
    assert {(x.query_id, x.doc_id): x.common for x in got.where("query_id < 5").collect()} == {
        (x.query_id, x.doc_id): len(set(x.question.split()) & set(x.text.split())) for x in got.where("query_id < 5").select("query_id", "doc_id").join(asked, "query_id").join(docs, "doc_id").collect()
    }
    near = R.vector_search(R.hashed_embedding(asked, "question"), R.hashed_embedding(docs, "text").select(F.col("doc_id").alias("vec_id"), "embedding"), 30, None)
    found = R.text_search(asked.select("query_id", F.col("question").alias("text")), R.postings(docs), 30)
    want = {(x.query_id, "vector", x.rank, x.vec_id) for x in near.collect()} | {(x.query_id, "bm25", x.rank, x.doc_id) for x in found.collect()}
    assert {(x.query_id, x.list, x.rank, x.doc_id) for x in got.collect()} == want
    assert R.rrf_merge(got, {"vector": 0.75, "bm25": 0.25}, keep=("tokens",)).drop("tokens").exceptAll(R.hybrid_retrieve(asked, docs)).count() == 0


def shuffled(spark) -> int:
    """Records written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jvm = sc._jvm
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="needs the test tables")
def test_no_postings_are_shuffled(spark):
    from leafmill.plans.search import ask_own_chunks

    n, before = spark.read.parquet(f"{LARGER}/atomic_elements.parquet").count(), shuffled(spark)
    ask_own_chunks(spark, LARGER).collect()
    assert shuffled(spark) - before < 40 * n


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_every_question_is_asked(spark):
    from leafmill.plans.search import ask_own_chunks

    answered = {r.query_id for r in ask_own_chunks(spark, DATA).select("query_id").distinct().collect()}
    assert answered == {r.query_id for r in spark.read.parquet(f"{DATA}/questions.parquet").collect()}
