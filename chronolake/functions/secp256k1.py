"""Addresses of signers, by public-key recovery on the curve secp256k1."""

from __future__ import annotations

from chronolake.functions.keccak import keccak256

#: Fixed values of the curve: field, order, generator.
P = 2**256 - 2**32 - 977
N = 0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFEBAAEDCE6AF48A03BBFD25E8CD0364141
G = (0x79BE667EF9DCBBAC55A06295CE870B07029BFCDB2DCE28D959F2815B16F81798, 0x483ADA7726A3C4655DA4FBFC0E1108A8FD17B448A68554199C47D08FFB10D4B8)

Point = tuple[int, int, int]


def _double(a: Point) -> Point:
    x, y, z = a
    if not y or not z:
        return (0, 1, 0)
    yy = y * y % P
    s, m = 4 * x * yy % P, 3 * x * x % P
    nx = (m * m - 2 * s) % P
    return nx, (m * (s - nx) - 8 * yy * yy) % P, 2 * y * z % P


def _add(a: Point, b: Point) -> Point:
    if not a[2]:
        return b
    if not b[2]:
        return a
    za, zb = a[2] * a[2] % P, b[2] * b[2] % P
    u, v = a[0] * zb % P, b[0] * za % P
    s, t = a[1] * zb * b[2] % P, b[1] * za * a[2] % P
    if u == v:
        return _double(a) if s == t else (0, 1, 0)
    h, r = v - u, t - s
    hh = h * h % P
    hhh, w = h * hh % P, u * hh % P
    x = (r * r - hhh - 2 * w) % P
    return x, (r * (w - x) - s * hhh) % P, h * a[2] * b[2] % P


def combine(*terms: tuple[int, tuple[int, int]]) -> tuple[int, int] | None:
    """The sum of multiples of points; None at infinity. All terms share one run of doublings."""
    points = [(k % N, (x, y, 1)) for k, (x, y) in terms]
    out: Point = (0, 1, 0)
    for bit in range(255, -1, -1):
        out = _double(out)
        for k, p in points:
            if k >> bit & 1:
                out = _add(out, p)
    if not out[2]:
        return None
    inverse = pow(out[2], -1, P)
    return out[0] * inverse**2 % P, out[1] * inverse**3 % P


def recover(digest: bytes, odd: int, r: int, s: int) -> bytes | None:
    """The address whose key signed a digest; None if the signature is none."""
    if not (0 < r < N and 0 < s < N):
        return None
    square = (pow(r, 3, P) + 7) % P
    y = pow(square, (P + 1) // 4, P)
    if y * y % P != square:
        return None
    if y % 2 != odd:
        y = P - y
    inverse = pow(r, -1, N)
    key = combine((-int.from_bytes(digest) * inverse, G), (s * inverse, (r, y)))
    return None if key is None else address(key)


def address(key: tuple[int, int]) -> bytes:
    return keccak256([key[0].to_bytes(32) + key[1].to_bytes(32)])[0][12:]
