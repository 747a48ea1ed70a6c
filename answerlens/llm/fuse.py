"""Static 3-wise binary-fuse filters over 64-bit keys, built and probed with numpy.

A filter of n keys has one fingerprint byte for about 1.13 n slots; a key's three
slots lie in three consecutive segments and their exclusive or is its fingerprint.
A key that was put in is always found; another is found in one of 256 cases.
"""

from __future__ import annotations

import struct

import numpy as np

_U = np.uint64


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + _U(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> _U(shift))) * _U(factor)
    return h ^ (h >> _U(33))


def _slots(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """Three slots for each hash: the segment from its high half, the places in segments from its low parts."""
    first = (((h >> _U(32)) * _U(segments)) >> _U(32)).astype(np.int64) * length
    mask = _U(length - 1)
    return np.stack([first + j * length + ((h >> _U(11 * j)) & mask ^ (h >> _U(40 - 7 * j)) & mask).astype(np.int64) for j in range(3)])


def build(keys: np.ndarray) -> bytes:
    """The filter of these keys, as bytes; peeled in rounds, each round's slots independent of one another."""
    keys = np.unique(np.asarray(keys, dtype=np.uint64))
    n = len(keys)
    length = 1 << max(2, min(17, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    size = int(max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) * n) if n > 1 else 3
    segments = max(1, -(-size // length) - 2)
    seed = 0
    while n:
        seed += 1
        if seed % 8 == 0:
            segments += max(1, segments // 8)
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        slots = _slots(h, length, segments)
        total = (segments + 2) * length
        held = np.bincount(slots.ravel(), minlength=total)
        whose = np.zeros(total, dtype=np.int64)
        for j in range(3):  # the exclusive or of the keys in a slot is the key itself when it is alone
            np.bitwise_xor.at(whose, slots[j], np.arange(n))
        rounds, alone = [], np.flatnonzero(held == 1)
        while len(alone):
            key, at = np.unique(whose[alone], return_index=True)
            rounds.append((key, alone[at]))
            touched = slots[:, key].ravel()
            np.subtract.at(held, touched, 1)
            np.bitwise_xor.at(whose, touched, np.tile(key, 3))
            touched = np.unique(touched)
            alone = touched[held[touched] == 1]
        if sum(len(k) for k, _ in rounds) == n:
            break
    else:
        return struct.pack("<QII", 0, length, 0)
    prints = (h ^ (h >> _U(32))).astype(np.uint8)
    table = np.zeros(total, dtype=np.uint8)
    for key, at in reversed(rounds):
        table[at] = 0
        table[at] = prints[key] ^ table[slots[0, key]] ^ table[slots[1, key]] ^ table[slots[2, key]]
    return struct.pack("<QII", seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1, length, segments) + table.tobytes()


def probe(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """For each key, whether it may be in the filter."""
    seed, length, segments = struct.unpack_from("<QII", blob)
    keys = np.asarray(keys, dtype=np.uint64)
    if not segments:
        return np.zeros(len(keys), dtype=bool)
    table = np.frombuffer(blob, dtype=np.uint8, offset=16)
    h = _mix(keys, seed)
    a, b, c = _slots(h, length, segments)
    return (table[a] ^ table[b] ^ table[c]) == (h ^ (h >> _U(32))).astype(np.uint8)
