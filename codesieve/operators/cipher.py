"""AES-128 in 8-bit cipher feedback, by the public standards (FIPS 197, SP 800-38A): only what wrapper formats need."""

from __future__ import annotations

import hashlib


def _double(x: int) -> int:
    return ((x << 1) ^ 0x1B) & 0xFF if x & 0x80 else x << 1


def _substitution() -> bytes:
    """The S-box: the inverse in GF(2**8) by powers of a generator, then the affine map."""
    power, log, x = [0] * 255, [0] * 256, 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= _double(x)  # times 3
    out = bytearray(256)
    for v in range(256):
        s = inverse = power[-log[v] % 255] if v else 0
        for k in range(1, 5):
            s ^= (inverse << k | inverse >> (8 - k)) & 0xFF
        out[v] = s ^ 0x63
    return bytes(out)


SBOX = _substitution()
DOUBLE = bytes(map(_double, range(256)))


def round_keys(key: bytes) -> list[bytes]:
    words, rcon = [key[i : i + 4] for i in range(0, 16, 4)], 1
    for i in range(4, 44):
        w = words[-1]
        if i % 4 == 0:
            w = bytes([SBOX[w[1]] ^ rcon, SBOX[w[2]], SBOX[w[3]], SBOX[w[0]]])
            rcon = _double(rcon)
        words.append(bytes(a ^ b for a, b in zip(w, words[i - 4])))
    return [b"".join(words[i : i + 4]) for i in range(0, 44, 4)]


def encrypt_block(block: bytes, keys: list[bytes]) -> bytes:
    s = bytes(a ^ b for a, b in zip(block, keys[0]))
    for k in range(1, 11):
        s = bytes(SBOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16))  # substitute, shift rows
        if k < 10:
            mixed = bytearray(16)
            for c in range(0, 16, 4):
                a = s[c : c + 4]
                whole = a[0] ^ a[1] ^ a[2] ^ a[3]
                for i in range(4):
                    mixed[c + i] = a[i] ^ whole ^ DOUBLE[a[i] ^ a[(i + 1) % 4]]
            s = bytes(mixed)
        s = bytes(a ^ b for a, b in zip(s, keys[k]))
    return s


def decrypt_cfb8(data: bytes, key: bytes, start: bytes) -> bytes:
    keys, register, out = round_keys(key), start, bytearray()
    for c in data:
        out.append(c ^ encrypt_block(register, keys)[0])
        register = register[1:] + bytes([c])
    return bytes(out)


def encrypt_cfb8(data: bytes, key: bytes, start: bytes) -> bytes:
    keys, register, out = round_keys(key), start, bytearray()
    for p in data:
        c = p ^ encrypt_block(register, keys)[0]
        out.append(c)
        register = register[1:] + bytes([c])
    return bytes(out)


def derived(password: bytes, salt: bytes, rounds: int = 100_000) -> tuple[bytes, bytes]:
    """(key, first register) from a password."""
    k = hashlib.pbkdf2_hmac("sha256", password, salt, rounds)
    return k[:16], k[16:]
