"""MurmurHash3 of bytes (public-domain algorithm): the 128-bit forms for 64- and 32-bit machines and the 32-bit form."""

from __future__ import annotations

_M64, _M32 = (1 << 64) - 1, (1 << 32) - 1


def _rotate(x: int, r: int, bits: int) -> int:
    return ((x << r) | (x >> (bits - r))) & ((1 << bits) - 1)


def _mix64(k: int) -> int:
    k = (k ^ (k >> 33)) * 0xFF51AFD7ED558CCD & _M64
    k = (k ^ (k >> 33)) * 0xC4CEB9FE1A85EC53 & _M64
    return k ^ (k >> 33)


def hash128(data: bytes, seed: int = 0) -> tuple[int, int]:
    a, b = 0x87C37B91114253D5, 0x4CF5AD432745937F
    first = lambda k: _rotate(k * a & _M64, 31, 64) * b & _M64
    second = lambda k: _rotate(k * b & _M64, 33, 64) * a & _M64
    h1 = h2 = seed
    full = len(data) // 16 * 16
    for i in range(0, full, 16):
        h1 = (_rotate(h1 ^ first(int.from_bytes(data[i : i + 8], "little")), 27, 64) + h2) * 5 + 0x52DCE729 & _M64
        h2 = (_rotate(h2 ^ second(int.from_bytes(data[i + 8 : i + 16], "little")), 31, 64) + h1) * 5 + 0x38495AB5 & _M64
    rest = data[full:]
    h2 ^= second(int.from_bytes(rest[8:], "little"))
    h1 ^= first(int.from_bytes(rest[:8], "little"))
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = h1 + h2 & _M64
    h2 = h2 + h1 & _M64
    h1, h2 = _mix64(h1), _mix64(h2)
    h1 = h1 + h2 & _M64
    return h1, h2 + h1 & _M64


def hash32(data: bytes, seed: int = 0) -> int:
    scramble = lambda k: _rotate(k * 0xCC9E2D51 & _M32, 15, 32) * 0x1B873593 & _M32
    h, full = seed, len(data) // 4 * 4
    for i in range(0, full, 4):
        h = _rotate(h ^ scramble(int.from_bytes(data[i : i + 4], "little")), 13, 32) * 5 + 0xE6546B64 & _M32
    h ^= scramble(int.from_bytes(data[full:], "little")) ^ len(data)
    return _mix32(h)


def _mix32(h: int) -> int:
    h = (h ^ (h >> 16)) * 0x85EBCA6B & _M32
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & _M32
    return h ^ (h >> 16)


#: Fixed values of the 32-bit machine's 128-bit form, per lane: multipliers, rotations before and after, constant added.
_LANES = (
    (0x239B961B, 0xAB0E9789, 15, 19, 0x561CCD1B),
    (0xAB0E9789, 0x38B34AE5, 16, 17, 0x0BCAA747),
    (0x38B34AE5, 0xA1E38B93, 17, 15, 0x96CD1C35),
    (0xA1E38B93, 0x239B961B, 18, 13, 0x32AC3B17),
)


def hash128_x86(data: bytes, seed: int = 0) -> tuple[int, int, int, int]:
    h, full = [seed] * 4, len(data) // 16 * 16

    def scrambled(lane: int, word: bytes) -> int:
        a, b, r = _LANES[lane][:3]
        return _rotate(int.from_bytes(word, "little") * a & _M32, r, 32) * b & _M32

    for i in range(0, full, 16):
        for lane, (*_, r, c) in enumerate(_LANES):
            h[lane] = (_rotate(h[lane] ^ scrambled(lane, data[i + 4 * lane : i + 4 * lane + 4]), r, 32) + h[(lane + 1) % 4]) * 5 + c & _M32
    rest = data[full:]
    h = [x ^ scrambled(lane, rest[4 * lane : 4 * lane + 4]) ^ len(data) for lane, x in enumerate(h)]

    def spread(v: list[int]) -> list[int]:
        first = sum(v) & _M32
        return [first, *[x + first & _M32 for x in v[1:]]]

    return tuple(spread([_mix32(x) for x in spread(h)]))


def folded(data: bytes, seed: int) -> int:
    """The two halves of the 128-bit hash, xored."""
    h = hash128(data, seed)
    return h[0] ^ h[1]
