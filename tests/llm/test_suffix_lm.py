"""The suffix tree's tasks: what they hold at once, and the helpers that pack and look up."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from harbinger.llm import suffix_lm
from harbinger.llm.common import lowered_words


class Caught:
    """Stands for a table and keeps the functions that Spark would run in its tasks."""

    def __init__(self, spark):
        self.sparkSession, self.functions = spark, []

    def __getattr__(self, name):
        def step(*args):
            self.functions += [a for a in args if callable(a)]
            return self

        return step


def test_counting_holds_little_and_sends_packed_rows(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(map(str, rng.integers(0, 400_000, 4000))) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    every = [np.full(2**21, 2**64 - 1, dtype=np.uint64)] * 2
    caught = Caught(spark)
    suffix_lm.gram_counts(caught, "text", 10**8, 3, spark.sparkContext.broadcast(every))
    tracemalloc.start()
    rows = sum(b.num_rows for b in caught.functions[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and rows < 1000  # 2,000,000 grams


@pytest.mark.parametrize("start, rows", [(0, 10), (1, 6), (3, 4), (9, 1)])
def test_tokens_are_words_and_ends(start, rows):
    texts = ["A b\tc", None, "", " x", "y" * 40 + " ZÉ b", "\n", "a", "q" + "y" * 40, "b c", "　 \x1c \xa0e \x0b" + "Y" * 40]
    column = pa.array(texts).slice(start, rows)
    tokens, starts = suffix_lm.tokens_of(column)
    words = [[*lowered_words(t), b""] for t in column.to_pylist()]
    assert [len(w) for w in words] == list(np.diff(starts))
    flat = [w for ws in words for w in ws]
    assert len(set(zip(flat, tokens.tolist()))) == len(set(flat)) == len(set(tokens.tolist()))


@pytest.mark.parametrize("size", [0, 1, 2, 3000])
def test_head_finds_its_keys_only(size):
    rng = random.Random(size)
    keys = [rng.randrange(2**63) >> rng.choice([0, 0, 50]) for _ in range(size)]
    keys = list(dict.fromkeys([*keys, 2**63 - 1][:size] if size else []))
    head = suffix_lm.Head(pa.table({"key": pa.array(keys, pa.int64()), "base": pa.array([None] * len(keys), pa.float64()),
                                    "value": pa.array([float(i) for i in range(len(keys))], pa.float64())}))
    asked = np.array([*keys, 0, 5, 2**64 - 1, *(k + 1 for k in keys)], dtype=np.uint64)
    at, found = head.find(asked)
    assert found.tolist() == [int(k) in set(keys) for k in asked]
    assert head.value[at[: len(keys)]].tolist() == list(range(len(keys)))


def test_packed_rows_keep_their_entries():
    keys = np.sort(np.random.default_rng(2).integers(0, 2**64, 1000, dtype=np.uint64))
    deal = suffix_lm.dealt(keys, 7)
    first = suffix_lm.firsts(deal)
    rows = suffix_lm.packed(deal[first], first, len(keys), keys=keys)
    assert rows.num_rows == 7 and rows["deal"].to_pylist() == list(range(7))
    assert (suffix_lm.entries(pa.Table.from_batches([rows]), "keys", np.uint64) == keys).all()
