"""Segments left out of the merge share no window with another one of their anchor."""

import numpy as np
import pytest

from canvass.llm import suffix_dedup as sd


def planted(seed):
    """Texts around one passage of 100 to 160 bytes, at every distance from its anchor, with other bytes beside it."""
    rng = np.random.default_rng(seed)
    letters = lambda n: rng.integers(97, 123, n, dtype=np.uint8)
    passage = letters(int(rng.integers(90, 160)))
    return [np.concatenate([letters(int(rng.integers(0, 150))), passage if k % 3 else passage[: int(rng.integers(40, len(passage)))], letters(int(rng.integers(0, 150)))]) for k in range(12)]


@pytest.mark.parametrize("seed", range(40))
def test_no_shared_window_is_left_out(seed):
    rows = []
    for doc, text in enumerate(planted(seed)):
        for anchor, start, n, _, ahead in zip(*sd.segments(text)):
            assert 0 <= ahead <= sd.LENGTH - sd.ANCHOR and n <= sd.LENGTH - sd.ANCHOR + 1
            rows.append((anchor, ahead, doc, text[start : start + n + sd.LENGTH - 1].tobytes()))
    rows = list({(r[0], r[3]): r for r in rows}.values())
    near = sd.sharing(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), [r[3] for r in rows])
    windows = [{r[3][k : k + sd.LENGTH] for k in range(len(r[3]) - sd.LENGTH + 1)} for r in rows]
    for k, r in enumerate(rows):
        others = set().union(*[w for j, w in enumerate(windows) if j != k and rows[j][0] == r[0]])
        assert near[k] or not windows[k] & others


def test_the_filter_leaves_strangers_out():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 8_000, dtype=np.uint8)  # one tile, whose ends cut segments
    anchor, start, n, _, ahead = sd.segments(text)
    strings = [text[s : s + k + sd.LENGTH - 1].tobytes() for s, k in zip(start, n)]
    assert not sd.sharing(np.zeros(len(start), np.int64), ahead, strings).any()
    assert sd.sharing(np.zeros(2 * len(start), np.int64), np.tile(ahead, 2), strings * 2).all()
