"""What the tasks of an operator hold beside an Arrow batch."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from reasonmill.llm import repeats
from reasonmill.llm.blocks import rolling


def test_blocks_of_repeats_stay_small():
    """An executor runs several tasks, so a batch of 8 MB may not cost hundreds of MB more in each."""
    rng = np.random.default_rng(3)
    words = np.array([f"word{n} " for n in range(5000)])
    texts = ["".join(rng.choice(words, 600)) for _ in range(1700)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["k", "text"])
    rolling(np.zeros(repeats.PIECE, np.uint8))  # the tables of powers stay
    tracemalloc.start()
    rows = sum(b.num_rows for b in repeats._occurrences(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 100_000 and peak < 80 << 20
