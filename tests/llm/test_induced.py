"""Induced suffix sorting and anchors against direct definitions."""

import random

import numpy as np
import pytest

from plumbline.llm import induced
from plumbline.llm.anchors import window_runs


@pytest.mark.parametrize("spill", [1 << 16, 2])
def test_order_and_common_prefixes(spill, monkeypatch):
    monkeypatch.setattr(induced, "QUEUE_ITEMS", spill)
    rng = random.Random(3)
    for _ in range(150):
        n, k, depth = rng.randint(1, 60), rng.choice([1, 2, 3, 6]), rng.choice([3, 8, 50])
        body = [rng.randint(1, k) for _ in range(n)]
        if rng.random() < 0.3:
            body = (body[:5] * 20)[:n]
        text = body + [0]
        order, common = induced.suffixes(np.array(text, np.uint16), depth)
        order = order.tolist()
        assert sorted(order) == list(range(len(text)))
        assert all(text[a : a + depth] <= text[b : b + depth] for a, b in zip(order, order[1:]))

        def shared(a, b):
            c = 0
            while c < depth and max(a, b) + c < len(text) and text[a + c] == text[b + c]:
                c += 1
            return c

        assert common.tolist() == [0] + [shared(a, b) for a, b in zip(order, order[1:])]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(5)
    passage = rng.integers(97, 123, 500, np.uint8)
    texts = [np.concatenate((rng.integers(97, 123, n, np.uint8), passage, rng.integers(97, 123, 90, np.uint8))) for n in (0, 13, 700)]
    texts.append(np.full(900, 97, np.uint8))
    by_window = {}
    for raw in texts:
        anchors, first, count = window_runs(raw, 200)
        assert first[0] == 0 and count.sum() == len(raw) - 199
        for a, f, c in zip(anchors.tolist(), first.tolist(), count.tolist()):
            for i in range(f, f + c):
                assert by_window.setdefault(raw[i : i + 200].tobytes(), a) == a
