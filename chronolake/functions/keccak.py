"""Keccak-256 of many byte strings at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

RATE = 136


def _round_constants() -> list[int]:
    """The constants of the 24 rounds, from the bits of the linear feedback register that defines them."""
    bits, lfsr = [], 1
    for _ in range(24 * 7):
        bits.append(lfsr & 1)
        lfsr = (lfsr << 1) ^ (0x171 if lfsr & 0x80 else 0)
    return [sum(bits[7 * r + j] << ((1 << j) - 1) for j in range(7)) for r in range(24)]


def _rotations() -> list[int]:
    """How far each of the 25 lanes is turned: triangular numbers along the walk (x, y) -> (y, 2x + 3y)."""
    turn, (x, y) = [0] * 25, (1, 0)
    for t in range(24):
        turn[x + 5 * y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return turn


_CONSTANTS, _TURN = [np.uint64(c) for c in _round_constants()], _rotations()


def _turn(a: np.ndarray, n: int) -> np.ndarray:
    return a if n == 0 else (a << np.uint64(n)) | (a >> np.uint64(64 - n))


def _permute(lanes: list[np.ndarray]) -> list[np.ndarray]:
    for constant in _CONSTANTS:
        column = [lanes[x] ^ lanes[x + 5] ^ lanes[x + 10] ^ lanes[x + 15] ^ lanes[x + 20] for x in range(5)]
        mix = [column[(x + 4) % 5] ^ _turn(column[(x + 1) % 5], 1) for x in range(5)]
        moved = [None] * 25
        for x in range(5):
            for y in range(5):
                moved[y + 5 * ((2 * x + 3 * y) % 5)] = _turn(lanes[x + 5 * y] ^ mix[x], _TURN[x + 5 * y])
        lanes = [moved[i] ^ (~moved[i - i % 5 + (i + 1) % 5] & moved[i - i % 5 + (i + 2) % 5]) for i in range(25)]
        lanes[0] = lanes[0] ^ constant
    return lanes


def keccak256(messages: Sequence[bytes]) -> list[bytes]:
    """The hash of each message, in order. Messages of equally many blocks are hashed together."""
    out: list[bytes] = [b""] * len(messages)
    groups: dict[int, list[int]] = {}
    for i, m in enumerate(messages):
        groups.setdefault(len(m) // RATE + 1, []).append(i)
    for blocks, members in groups.items():
        data = np.zeros((len(members), blocks * RATE), np.uint8)
        for row, i in enumerate(members):
            m = messages[i]
            data[row, : len(m)] = np.frombuffer(m, np.uint8)
            data[row, len(m)] ^= 1
        data[:, -1] ^= 0x80
        words = data.view("<u8")
        lanes = [np.zeros(len(members), np.uint64) for _ in range(25)]
        for b in range(blocks):
            for j in range(RATE // 8):
                lanes[j] = lanes[j] ^ words[:, b * (RATE // 8) + j]
            lanes = _permute(lanes)
        hashed = np.stack(lanes[:4], 1).astype("<u8").view(np.uint8)
        for row, i in enumerate(members):
            out[i] = hashed[row].tobytes()
    return out
