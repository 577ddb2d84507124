"""What a query may take: rows and bytes that it shuffles, memory of a worker."""

import random
import tracemalloc

import corpus_pipeline
import public_tokenizers

from kelvingrid.llm import bpe, hyperminhash


def shuffled(spark, run):
    """Rows and bytes that the stages of a call wrote to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        java = spark.sparkContext._jvm.java.util.ArrayList
        quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        found = sc.statusStore().stageList(java(), False, False, quantiles, java())
        return {(x.stageId(), x.attemptId()): (x.shuffleWriteRecords(), x.shuffleWriteBytes()) for x in (found.apply(i) for i in range(found.size()))}

    before = set(stages())
    run()
    return tuple(map(sum, zip(*(v for k, v in stages().items() if k not in before))))


def test_band_rows_are_shuffled_once_a_step(spark):
    """Two rounds of a third of the bands and one of all: 70 rows a class, besides classes, labels and pairs."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(str(rng.randrange(10**6)) for _ in range(400))) for i in range(1500)], "doc_id long, text string").repartition(8)
    rows, _ = shuffled(spark, lambda: hyperminhash.near_duplicates(docs).collect())
    assert 42 * 1500 < rows < 100 * 1500


def test_merge_replay_takes_little_memory_a_byte():
    """Four 32-bit numbers a byte, the index and its bounded temporaries."""
    rng = random.Random(3)
    words = [bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(60_000)]
    vocabulary = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    bpe.replay_merges(words[:100], vocabulary)
    tracemalloc.start()
    try:
        ids = bpe.replay_merges(words, vocabulary)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [bpe.decode_ids(x, vocabulary) for x in ids[::97]] == words[::97]
    assert peak < 60 * sum(map(len, words))


def test_pipeline_sends_texts_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    before = spark.conf.get(key)
    try:
        for given, want in (("10000", "4000"), ("0", "4000"), ("7", "7")):
            spark.conf.set(key, given)
            assert corpus_pipeline.encode(spark, docs, "").count() == 9
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)
