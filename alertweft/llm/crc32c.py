"""Masked CRC-32C of many byte strings at once.

The register of a CRC is linear in its bytes.  A string is taken as little-endian
words with zeros in front, which leave a zero register as it is; neighbouring
blocks are then combined pair by pair, the left one advanced over the length of
the right one, so strings of similar length share every step.
"""

from __future__ import annotations

import numpy as np

from alertweft.session import ship

ship(__name__)

# Fixed values of the record format: Castagnoli polynomial (reflected) and the offset of the mask
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8


class Tables(dict):
    """Per power, two tables that advance the lower and upper half of a register over 2**power zero bytes."""

    def __missing__(self, power: int) -> tuple[np.ndarray, np.ndarray]:
        if power:
            self[power] = tuple(_apply(half, power - 1) for half in self[power - 1])
            return self[power]
        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = (byte >> np.uint32(1)) ^ np.where(byte & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
        low = np.arange(1 << 16, dtype=np.uint32)
        self[0] = byte[low & np.uint32(255)] ^ (low >> np.uint32(8)), low << np.uint32(8)
        return self[0]

    def __reduce__(self):
        return Tables, ()  # every worker builds its own


_TABLES = Tables()


def _apply(register: np.ndarray, power: int) -> np.ndarray:
    low, high = _TABLES[power]
    return low[register & np.uint32(0xFFFF)] ^ high[register >> np.uint32(16)]


def crc32c(blocks: list[bytes]) -> np.ndarray:
    """CRC-32C of every byte string."""
    sizes = np.fromiter(map(len, blocks), np.int64, len(blocks))
    out = np.full(len(blocks), 0xFFFFFFFF, dtype=np.uint32)
    for power in range(int(sizes.max(initial=0)).bit_length()):
        on = (sizes >> power & 1).astype(bool)
        out[on] = _apply(out[on], power)
    levels = np.ceil(np.log2(np.maximum(-(-sizes // 4), 1))).astype(np.int64)
    for level in np.unique(levels[sizes > 0]).tolist():
        rows = np.flatnonzero((levels == level) & (sizes > 0))
        wide = np.zeros((len(rows), 4 << level), dtype=np.uint8)
        for at, row in enumerate(rows.tolist()):
            wide[at, wide.shape[1] - sizes[row] :] = np.frombuffer(blocks[row], np.uint8)
        register = _apply(wide.view("<u4"), 2)
        for step in range(level):
            register = _apply(register[:, ::2], 2 + step) ^ register[:, 1::2]
        out[rows] ^= register[:, 0]
    return out ^ np.uint32(0xFFFFFFFF)


def masked(blocks: list[bytes]) -> np.ndarray:
    """The checksum as it is stored: rotated and offset, so that a checksum of stored checksums stays sound."""
    value = crc32c(blocks)
    return ((value >> np.uint32(15)) | (value << np.uint32(17))) + np.uint32(MASK)
