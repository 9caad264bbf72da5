"""The public BLAKE3 hash (unkeyed, 32 bytes), for content hashes that must be byte-compatible.

Pure Python: fine for journals and specs. For work over large tables ask for a built-in hash instead.
"""

from __future__ import annotations

#: Fixed values of the algorithm.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8
_MIX = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
_M = 0xFFFFFFFF


def _compress(cv, words, counter: int, length: int, flags: int) -> list[int]:
    v = [*cv, *_IV[:4], counter & _M, counter >> 32 & _M, length, flags]
    m = words
    for turn in range(7):
        for k, (a, b, c, d) in enumerate(_MIX):
            va, vb, vc, vd = v[a], v[b], v[c], v[d]
            va = va + vb + m[2 * k] & _M
            vd ^= va
            vd = vd >> 16 | vd << 16 & _M
            vc = vc + vd & _M
            vb ^= vc
            vb = vb >> 12 | vb << 20 & _M
            va = va + vb + m[2 * k + 1] & _M
            vd ^= va
            vd = vd >> 8 | vd << 24 & _M
            vc = vc + vd & _M
            vb ^= vc
            v[a], v[b], v[c], v[d] = va, vb >> 7 | vb << 25 & _M, vc, vd
        if turn < 6:
            m = [m[i] for i in _ORDER]
    return [v[i] ^ v[i + 8] for i in range(8)]


def _words(block: bytes) -> list[int]:
    block = block.ljust(64, b"\0")
    return [int.from_bytes(block[i : i + 4], "little") for i in range(0, 64, 4)]


def _chunk(data: bytes, counter: int, root: int) -> list[int]:
    cv, blocks = list(_IV), [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
    for i, b in enumerate(blocks):
        last = i == len(blocks) - 1
        cv = _compress(cv, _words(b), counter, len(b), (_CHUNK_START if i == 0 else 0) | (_CHUNK_END | root if last else 0))
    return cv


def _tree(data: bytes, counter: int, root: int) -> list[int]:
    chunks = -(-len(data) // 1024)
    if chunks <= 1:
        return _chunk(data, counter, root)
    left = 1 << (chunks - 1).bit_length() - 1
    halves = _tree(data[: left * 1024], counter, 0) + _tree(data[left * 1024 :], counter + left, 0)
    return _compress(_IV, halves, 0, 64, _PARENT | root)


def digest(data: bytes) -> bytes:
    return b"".join(x.to_bytes(4, "little") for x in _tree(data, 0, _ROOT))


def hexdigest(data: bytes) -> str:
    return digest(data).hex()
