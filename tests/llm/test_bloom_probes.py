"""Reading the filter of op5: the same levels as bit by bit, in an order that keeps a block's addresses together."""

import numpy as np
import pytest

from webgrain.llm import lm_bloom


@pytest.mark.parametrize(("blocks", "piece_blocks"), [(1, 1), (48, 16), (70_000, 1024)])
def test_addresses_go_by_block(blocks, piece_blocks):
    shape = lm_bloom.Shape(blocks, piece_blocks)
    address = np.random.default_rng(1).integers(0, 1 << 40, 50_000).astype(np.uint64)
    order, pieces, ends = lm_bloom._by_piece(shape, address)
    block = shape.block(address)
    assert (np.diff(block[order]) >= 0).all() and sorted(order) == list(range(address.size))
    for piece, i, j in zip(pieces, ends[:-1], ends[1:], strict=True):
        assert (block[order[i:j]] // piece_blocks == piece).all()
    assert ends[-1] == address.size and len(set(pieces)) == len(pieces)
    assert lm_bloom._by_piece(shape, address[:0])[1].size == 0


@pytest.mark.parametrize("above", [0, lm_bloom._REST_LEVEL])
def test_levels_equal_those_read_bit_by_bit(above):
    shape, draw = lm_bloom.Shape(16, 16), np.random.default_rng(2)
    address = draw.integers(0, 1 << 40, 40_000).astype(np.uint64)
    true = draw.geometric(0.6, address.size) - 1
    bits = np.zeros(shape.piece_blocks * lm_bloom.BLOCK_BITS, dtype=bool)
    for k in range(1, true.max() + 1):
        for at in shape.bits(address[true >= k], above + k):
            bits[at] = True
    want = np.zeros(address.size, dtype=int)
    for k in range(1, 256):
        held = np.logical_and.reduce([bits[at] for at in shape.bits(address, above + k)])
        want[(want == k - 1) & held] = k
    got = shape.levels(bits, address, above)
    assert (got == want).all() and (got >= true).all() and shape.levels(bits, address[:0]).size == 0
