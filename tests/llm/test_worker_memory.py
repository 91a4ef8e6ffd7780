"""What a Python worker holds while it makes and after it drops a store."""

import tracemalloc

import numpy as np

from ledgerloom.llm import common
from ledgerloom.llm.automaton import Tables


def test_rows_of_transitions_are_made_one_at_a_time():
    """The most that is held is little beyond the rows themselves."""
    n = 3000
    made = Tables(np.random.default_rng(1).integers(0, n, (n, 256)).astype(np.int32), np.zeros(n, np.int64))
    tracemalloc.start()
    row = made.start_row()
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert row[256] == 0 and len(row[5]) == 257
    assert most < 1.2 * held, (most, held)


def test_batches_pass_through_whole():
    assert list(common.trimmed(lambda batches: (2 * b for b in batches))(iter([1, 2, 3]))) == [2, 4, 6]
