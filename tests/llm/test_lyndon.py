import random
import time

import numpy as np
import pytest

from quarry.llm.lyndon import suffix_order


@pytest.mark.parametrize("letters", [1, 2, 3, 26])
def test_order_equals_sorted_suffixes(letters):
    rng = random.Random(letters)
    blocks = [[rng.randrange(1, letters + 1) for _ in range(rng.randrange(0, 40))] + [0] for _ in range(300)]
    blocks += [[1, 2] * 20 + [0], [2, 1] * 20 + [0], ([1, 1, 2] * 5 + [1]) * 4 + [0]]
    got = suffix_order(np.concatenate(blocks), np.array([len(b) for b in blocks]))
    at = 0
    for b in blocks:
        assert [x - at for x in got[at:at + len(b)]] == sorted(range(len(b)), key=lambda i: b[i:])
        at += len(b)


def test_nothing():
    assert len(suffix_order(np.empty(0, np.int64), np.empty(0, np.int64))) == 0
