"""Ed25519 signatures (RFC 8032) in plain integers, for executors without a crypto library, and SHAKE-256 digests."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StringType

#: The field, the group order, the curve constant and the base point's y are those of the standard.
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
ROOT = pow(2, (P - 1) // 4, P)


def _x_of(y: int, sign: int) -> int | None:
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P or (not x and sign):
        return None
    return P - x if x & 1 != sign else x


def _add(a: tuple, b: tuple) -> tuple:
    """In extended coordinates."""
    s, t = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    u, v = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    e, f, g, h = t - s, v - u, v + u, t + s
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, a: tuple) -> tuple:
    out = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, a)
        a, n = _add(a, a), n >> 1
    return out


_Y = 4 * pow(5, -1, P) % P
BASE = (_x_of(_Y, 0), _Y, 1, _x_of(_Y, 0) * _Y % P)


def _packed(a: tuple) -> bytes:
    inverse = pow(a[2], -1, P)
    return (a[1] * inverse % P | (a[0] * inverse % P & 1) << 255).to_bytes(32, "little")


def _unpacked(data: bytes) -> tuple | None:
    number = int.from_bytes(data, "little")
    y = number & (1 << 255) - 1
    x = _x_of(y, number >> 255)
    return None if x is None else (x, y, 1, x * y % P)


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


def _scalar(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER


def public_key(seed: bytes) -> bytes:
    if len(seed) != 32:
        raise ValueError("a key has 32 bytes")
    return _packed(_times(_secret(seed)[0], BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    r = _scalar(prefix, message)
    point = _packed(_times(r, BASE))
    return point + ((r + _scalar(point, public_key(seed), message) * a) % ORDER).to_bytes(32, "little")


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    """False for any signature that has not 64 bytes."""
    if len(signature) != 64 or len(key) != 32:
        return False
    a, r, s = _unpacked(key), _unpacked(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= ORDER:
        return False
    left, right = _times(s, BASE), _add(r, _times(_scalar(signature[:32], key, message), a))
    return (left[0] * right[2] - right[0] * left[2]) % P == 0 and (left[1] * right[2] - right[1] * left[2]) % P == 0


def signatures(seed: bytes):
    @F.pandas_udf(BinaryType())
    def run(messages: pd.Series) -> pd.Series:
        return messages.map(lambda m: sign(seed, bytes(m)))

    return run


@F.pandas_udf(BooleanType())
def verified(key: pd.Series, message: pd.Series, signature: pd.Series) -> pd.Series:
    return pd.Series([k is not None and s is not None and verify(bytes(k), bytes(m), bytes(s)) for k, m, s in zip(key, message, signature, strict=True)], dtype=bool)


@F.pandas_udf(StringType())
def shake256(data: pd.Series) -> pd.Series:
    return data.map(lambda x: hashlib.shake_256(bytes(x)).hexdigest(32))


def load_or_create_key(path: str) -> bytes:
    """A raw file of 32 bytes; another length is an error."""
    import os

    if os.path.exists(path):
        with open(path, "rb") as f:
            seed = f.read()
    else:
        seed = os.urandom(32)
        with open(path, "wb") as f:
            f.write(seed)
    if len(seed) != 32:
        raise ValueError("a key file has 32 bytes")
    return seed
