"""The index against searching lists."""

import numpy as np
from hypothesis import given, settings, strategies as st

from tillroll.llm.fm_index import FMIndex, suffix_array
from tillroll.llm.substring_dedup import matches

texts = st.lists(st.integers(0, 3), min_size=1, max_size=120).map(lambda x: np.array([*x, 0], np.int64))


def ordered(symbols):
    keys = [(0, i) if s == 0 else (1, int(s)) for i, s in enumerate(symbols)]
    return sorted(range(len(keys)), key=lambda i: keys[i:])


@settings(deadline=None, max_examples=60)
@given(texts)
def test_suffixes_are_in_order_and_can_be_located(symbols):
    assert suffix_array(symbols).tolist() == ordered(symbols)
    assert FMIndex(symbols, 3, 4).locate(np.arange(len(symbols))).tolist() == ordered(symbols)


@settings(deadline=None, max_examples=60)
@given(texts, st.lists(st.integers(1, 3), min_size=1, max_size=4))
def test_phrases_are_found_where_they_stand(symbols, phrase):
    index = FMIndex(symbols, 3)
    low, high = index.search(np.array([phrase]))
    found = set(index.locate(np.arange(low[0], high[0])).tolist())
    n = len(phrase)
    assert found == {i for i in range(len(symbols) - n + 1) if symbols[i : i + n].tolist() == phrase}


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=30), min_size=1, max_size=6))
def test_matching_statistics_find_all_repeated_windows(bodies):
    window = 4
    seen: dict[tuple, int] = {}
    for body in bodies:
        for i in range(len(body) - window + 1):
            seen[tuple(body[i : i + window])] = seen.get(tuple(body[i : i + window]), 0) + 1
    expected = {
        (d, p)
        for d, body in enumerate(bodies)
        for i in range(len(body) - window + 1)
        if seen[tuple(body[i : i + window])] > 1
        for p in range(i, i + window)
    }
    assert {(d, p) for d, first, last in matches(bodies, window) for p in range(first, last + 1)} == expected
