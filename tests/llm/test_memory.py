import os

import pyarrow as pa

from passagemill.llm import decontaminate, toxicity
from passagemill.llm.packing import pack
from passagemill.llm.queries import byte_bpe


def private_mb():
    _, resident, mapped = open("/proc/self/statm").read().split()[:3]
    return (int(resident) - int(mapped)) * os.sysconf("SC_PAGE_SIZE") / 1e6


def batches(n, first=0):
    for k in range(first, first + n):
        texts = [" ".join(f"Word{k}x{i}x{j}" for j in range(200)) for i in range(100)]
        yield pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(texts)], ["doc_id", "text"])


def test_a_task_leaves_little_memory_in_its_worker(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    run = pack(docs, byte_bpe)
    for _ in run(batches(1)):
        pass
    before, most = private_mb(), 0
    for _ in run(batches(16)):
        most = max(most, private_mb())
    assert most - before > 80
    assert private_mb() - before < 40


def test_a_task_of_another_operator_clears_the_table_of_known_chunks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    run = toxicity.keep_clean(docs, toxicity.Model(0.0, {1: 0.5}))
    decontaminate.canon_of(frozenset(["small"]))
    for _ in run(batches(1)):
        pass
    assert decontaminate.canon_of.cache_info().currsize == 0
