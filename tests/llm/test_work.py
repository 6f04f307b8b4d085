"""How much work the operators do: sorts of places (argsort, lexsort) cost several times those of values."""

import math
import random
from collections import Counter

import numpy as np

from lodestow.llm import ppm
from lodestow.llm import text_arrays as A


def _sorted_places(monkeypatch) -> list[int]:
    """How many places each sort of places from now on takes."""
    sizes, sort, by_keys = [], np.argsort, np.lexsort
    monkeypatch.setattr(ppm.np, "argsort", lambda a, *x, **k: (sizes.append(len(a)), sort(a, *x, **k))[1])
    monkeypatch.setattr(ppm.np, "lexsort", lambda keys, *x, **k: (sizes.append(sum(map(len, keys))), by_keys(keys, *x, **k))[1])
    return sizes


def test_contexts_are_shortened_from_the_next_longer_ones(monkeypatch):
    rng = random.Random(4)
    buf = np.frombuffer("".join(rng.choice("abc  ") for _ in range(20_000)).encode(), np.uint8)
    starts, ends, first = A.runs(buf, np.array([0, 9, 9, 20_000]))
    keys, counts = ppm._summed([k := ppm.coded(buf, starts, ends, first, True)[0]], [np.ones(len(k), np.int64)])
    want: Counter = Counter()
    for key, n in zip(keys.tolist(), counts.tolist()):
        for k in range(ppm.NEAR, (key & 7) + 1):
            want[(((key >> 11) & ((1 << 8 * k) - 1)) << 8 | (key >> 3 & 255)) << 3 | k] += n
    sizes = _sorted_places(monkeypatch)
    got = ppm.shortened(keys, counts, range(ppm.NEAR, ppm.ORDER + 1))
    assert dict(zip(got[0].tolist(), got[1].tolist())) == want
    assert sum(sizes) < 3.5 * len(keys)  # not all grams once for each order and once more


def test_what_two_words_foretell_is_found_by_one_sort_of_values(monkeypatch):
    rng = random.Random(3)
    words = A.mix(np.array([rng.randrange(12) for _ in range(3_000)], np.uint64))
    row = np.sort(np.array([rng.randrange(5, 25) for _ in range(3_000)]))
    hit, share, seen, made, right, of = [], [], {}, 0, 0, None
    for i, (w, r) in enumerate(zip(words.tolist(), row.tolist())):
        if r != of:
            seen, made, right, of, begin = {}, 0, 0, r, i
        hit.append(False)
        share.append(0.0)
        if i - begin >= 2:
            two = tuple(words[i - 2 : i].tolist())
            if two in seen:
                p = (right + 0.5) / (made + 1)
                hit[i], share[i] = seen[two] == w, math.log10(p if seen[two] == w else 1 - p)
                made, right = made + 1, right + hit[i]
            seen[two] = w
    sizes = _sorted_places(monkeypatch)
    got = ppm.foretold(words, row)
    assert sum(sizes) == 0
    assert got[0].tolist() == hit and np.allclose(got[1], share)
    # where mixed values take different pairs for one, the answer is the same
    monkeypatch.setattr(ppm, "_alike", lambda g, r, alike=ppm._alike: alike(g, r, 16))
    again = ppm.foretold(words, row)
    assert sum(sizes) > 0 and again[0].tolist() == hit and np.allclose(again[1], share)
