"""What workers keep between the tasks of several operators."""

from __future__ import annotations

import random
import string
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest

from granary.llm import bpe, held, language_id, near_duplicates, secret_scan


@pytest.mark.parametrize("task", [secret_scan._scan_batches, secret_scan._redact_batches, near_duplicates._node_batches])
def test_a_task_lets_go_what_other_operators_hold(task):
    held.held("a model", lambda: [1])
    assert held.held("a model", lambda: [2]) == [1]
    assert sum(len(x) for x in task(iter([pa.array(["some text", None])]))) == 2
    assert not held._held


def test_a_learning_task_lets_go_too():
    held.held("a model", lambda: [1])
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["some text"])], ["lang", "text"])
    assert list(language_id._train_batches(iter([batch]))) and not held._held


def test_one_thing_is_held_at_a_time():
    held.held("one", lambda: 1)
    assert held.held("two", lambda: 2) == 2 and list(held._held) == ["two"]
    held.release()


def test_held_pieces_are_small():
    encoder = bpe.Encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(3)
    words = list({"".join(rng.choices(string.ascii_lowercase, k=8)) for _ in range(20_000)})
    tracemalloc.start()
    for w in words:
        encoder.piece(w)
    held_bytes = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(encoder._known) == len(words) and held_bytes < 180 * len(words)


def test_batches_are_bounded_unless_the_session_says(spark):
    key, old = held._BATCH, spark.conf.get(held._BATCH)
    try:
        spark.conf.set(key, "10000")
        held.small_batches(spark)
        assert spark.conf.get(key) == "1000"
        spark.conf.set(key, "77")
        held.small_batches(spark)
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.set(key, old)
