import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinship.llm import rangecoder as rc


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000, 70_000])
@pytest.mark.parametrize("v", [1, 3, 50_000, 1 << 32])
def test_round_trip(n, v):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, v, n), rng.zipf(1.3, n) % v, np.arange(n) % v):
        assert (rc.decode(rc.encode(ids)) == ids).all()


@given(st.lists(st.integers(0, 300), max_size=400))
@settings(max_examples=60, deadline=None)
def test_any_ids(ids):
    assert rc.decode(rc.encode(np.array(ids, np.int64))).tolist() == ids


def test_repeats_shrink():
    ids = np.tile(np.random.default_rng(0).integers(0, 50_000, 500), 400)
    assert len(rc.encode(ids)) < 0.35 * len(ids)
    skewed = np.random.default_rng(1).zipf(2.0, 200_000) % 1000
    assert len(rc.encode(skewed)) < 0.6 * len(skewed)


def test_blocks_are_independent():
    a, b = rc.encode(np.arange(3000)), rc.encode(np.arange(3000))
    assert a == b


def test_damage_is_found():
    block = bytearray(rc.encode(np.arange(5000) % 77))
    for at in (0, 5, 9, 13, 20, 30, len(block) // 2, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 0x20
        with pytest.raises(rc.CorruptBlock):
            rc.decode(bytes(bad))
    with pytest.raises(rc.CorruptBlock):
        rc.decode(bytes(block[:10]))
    with pytest.raises(rc.CorruptBlock):
        rc.decode(bytes(block[:-4]))


def test_out_of_range():
    with pytest.raises(ValueError):
        rc.encode(np.array([-1]))
    with pytest.raises(ValueError):
        rc.encode(np.array([1 << 32]))
