import os
import weakref

import numpy as np

from weekgrain.llm import common
from weekgrain.llm.common import forget, releasing


def held() -> float:
    """MB of this process in memory."""
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


def test_what_a_batch_freed_is_given_back():
    def batches():
        yield from range(3)

    seen, last = [], []
    for batch in releasing(batches()):
        seen.append(batch)
        parts = [np.ones(10_000) for _ in range(4_000)]
        last.append(parts[-1])  # what lies above the freed parts keeps the C library from giving them back itself
        full = held()
        del parts
    assert seen == [0, 1, 2]
    assert full - held() > 200


def test_one_thing_is_held_at_a_time():
    made = []

    def make(name):
        return lambda: made.append(name) or object()

    first = common.held("a", make("a"))
    assert common.held("a", make("a")) is first and made == ["a"]
    common.held("b", make("b"))
    assert common.held("a", make("a")) is not first and made == ["a", "b", "a"]
    forget()
    common.held("a", make("a"))
    forget()
    assert made == ["a", "b", "a", "a"]


def test_a_scan_for_secrets_leaves_no_word_ids_behind():
    from weekgrain.llm.secret_scan import encoding
    from weekgrain.llm.word_ids import word_ids

    gone = weakref.ref(word_ids(None))
    encoding(None)
    assert gone() is None
    forget()
