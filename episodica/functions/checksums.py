"""CRC-32C of long byte strings, many lanes at a time."""

from __future__ import annotations

from functools import cache

import numpy as np

#: The reversed Castagnoli polynomial, and what masks a checksum that is stored beside its data.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8

LANE = 256
#: Shorter strings go byte by byte.
LEAST = 4096


@cache
def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


@cache
def _byte_list() -> list[int]:
    return _byte_table().tolist()


def _mapped(tables: np.ndarray, states: np.ndarray) -> np.ndarray:
    """States under a linear map that is given by four tables, one for each byte."""
    return tables[0][states & 255] ^ tables[1][(states >> 8) & 255] ^ tables[2][(states >> 16) & 255] ^ tables[3][states >> 24]


def _tables(images: np.ndarray) -> np.ndarray:
    """The tables of the linear map that takes bit ``i`` to ``images[i]``."""
    index = np.arange(256, dtype=np.uint32)
    tables = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        tables[bit // 8] ^= np.where(index >> (bit % 8) & 1, images[bit], 0).astype(np.uint32)
    return tables


@cache
def _behind(doublings: int) -> np.ndarray:
    """Tables of what ``2 ** doublings`` zero bytes do to a state."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if doublings == 0:
        return _tables(_byte_table()[bits & 255] ^ (bits >> 8))
    half = _behind(doublings - 1)
    return _tables(_mapped(half, _mapped(half, bits)))


def crc32c(data: bytes) -> int:
    """The checksum: lanes of equal length are taken at once, then joined two by two."""
    state, rest = 0xFFFFFFFF, data
    if len(data) >= LEAST:
        n = len(data) // LANE
        lanes, rest = np.frombuffer(data, np.uint8, n * LANE).reshape(n, LANE), data[n * LANE :]
        states, table = np.zeros(n, np.uint32), _byte_table()
        states[0] = state
        for column in np.ascontiguousarray(lanes.T):
            states = table[(states ^ column) & 255] ^ (states >> 8)
        doublings = LANE.bit_length() - 1
        while len(states) > 1:
            if len(states) % 2:  # a lane of zeros from state 0 in front changes nothing
                states = np.concatenate([np.zeros(1, np.uint32), states])
            states = _mapped(_behind(doublings), states[::2]) ^ states[1::2]
            doublings += 1
        state = int(states[0])
    table = _byte_list()
    for byte in rest:
        state = table[(state ^ byte) & 255] ^ (state >> 8)
    return state ^ 0xFFFFFFFF


def masked_crc32c(data: bytes) -> int:
    """The checksum rotated and shifted, as it is stored in files whose data may hold checksums."""
    crc = crc32c(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF
