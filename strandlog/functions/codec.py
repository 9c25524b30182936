"""Digests, base64, constant-time comparison, signatures and compression."""

from __future__ import annotations

import hashlib
import hmac
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CODECS = ("lz4", "zstd", "zlib")


def sha256(text: Column) -> Column:
    """The 32 bytes of the digest."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def base64url(raw: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.translate(F.rtrim(F.base64(raw.cast("binary")), F.lit("=")), "+/", "-_")


def unbase64url(text: Column) -> Column:
    """Bytes of URL-safe base64, padded or not; null where it is none."""
    bare = F.rtrim(text, F.lit("="))
    padded = F.rpad(F.translate(bare, "-_", "+/"), (F.ceil(F.length(bare) / 4) * 4).cast("int"), F.lit("="))
    good = bare.rlike("^[A-Za-z0-9_-]*$") & (F.length(bare) % 4 != 1)
    return F.when(good, F.when(F.length(bare) == 0, F.lit(b"")).otherwise(F.try_to_binary(padded, F.lit("base64"))))


def sha256_base64url(text: Column) -> Column:
    return base64url(sha256(text))


def secure_compare(a: bytes | str, b: bytes | str) -> bool:
    """Equality in time that does not tell where two values of one length differ."""
    x, y = (v.encode() if isinstance(v, str) else v for v in (a, b))
    return hmac.compare_digest(x, y)


def secure_equal(a: Column, b: Column) -> Column:
    """The column form: equality of the SHA-256 digests, so where two values differ does not show in the time; null with a null."""
    return F.sha2(a.cast("binary"), 256) == F.sha2(b.cast("binary"), 256)


def compress(raw: bytes, codec: str = "zstd", level: int | None = None) -> bytes:
    if codec not in CODECS:
        raise ValueError(f"codec is one of {CODECS}")
    if codec == "zlib":
        return zlib.compress(raw, -1 if level is None else level)
    import pyarrow as pa

    packed = (pa.Codec(codec) if level is None or codec == "lz4" else pa.Codec(codec, compression_level=level)).compress(raw, asbytes=True)
    return len(raw).to_bytes(8, "big") + packed


def decompress(packed: bytes, codec: str = "zstd") -> bytes:
    """The original bytes; ValueError where the input is not of this codec."""
    if codec not in CODECS:
        raise ValueError(f"codec is one of {CODECS}")
    try:
        if codec == "zlib":
            return zlib.decompress(packed)
        import pyarrow as pa

        if len(packed) < 8:
            raise ValueError("too short")
        return pa.Codec(codec).decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "big"), asbytes=True)
    except Exception as e:
        raise ValueError(f"not {codec} data: {e}") from e


def compression_stats(raw: bytes, codec: str = "zstd", level: int | None = None) -> dict:
    n = len(compress(raw, codec, level))
    return {"original": len(raw), "compressed": n, "ratio": len(raw) / n}


def compression_sizes(column: Column, codec: str = "zstd", level: int | None = None) -> Column:
    """struct(original, compressed, ratio) in bytes; null for null."""
    n, m = F.octet_length(column).cast("long"), F.octet_length(compressed(column, codec, level)).cast("long")
    return F.when(column.isNotNull(), F.struct(n.alias("original"), m.alias("compressed"), (n / m).alias("ratio")))


def compressed(column: Column, codec: str = "zstd", level: int | None = None) -> Column:
    """A binary column, compressed value by value in Arrow batches."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda v: None if v is None else compress(bytes(v), codec, level))

    return run(column.cast("binary"))


def decompressed(column: Column, codec: str = "zstd") -> Column:
    """The original bytes; null where a value is null or not of this codec."""

    def one(v):
        try:
            return None if v is None else decompress(bytes(v), codec)
        except ValueError:
            return None

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(one)

    return run(column)


# Ed25519 as in RFC 8032, section 5.1.  The curve's numbers are fixed values.
_P = 2**255 - 19
_ORDER = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, _P - 2, _P) % _P
_ROOT = pow(2, (_P - 1) // 4, _P)
_BASE_Y = 4 * pow(5, _P - 2, _P) % _P


def _x_of(y: int, odd: int) -> int | None:
    if y >= _P:
        return None
    square = (y * y - 1) * pow(_D * y * y + 1, _P - 2, _P) % _P
    if square == 0:
        return None if odd else 0
    x = pow(square, (_P + 3) // 8, _P)
    if (x * x - square) % _P:
        x = x * _ROOT % _P
    if (x * x - square) % _P:
        return None
    return x if x & 1 == odd else _P - x


def _plus(a, b):
    s, t = (a[1] - a[0]) * (b[1] - b[0]) % _P, (a[1] + a[0]) * (b[1] + b[0]) % _P
    u, v = 2 * a[3] * b[3] * _D % _P, 2 * a[2] * b[2] % _P
    e, f, g, h = t - s, v - u, v + u, t + s
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _times(n: int, point):
    total = (0, 1, 1, 0)
    while n:
        if n & 1:
            total = _plus(total, point)
        point = _plus(point, point)
        n >>= 1
    return total


def _point(raw: bytes):
    y = int.from_bytes(raw, "little")
    x = _x_of(y & ((1 << 255) - 1), y >> 255)
    y &= (1 << 255) - 1
    return None if x is None else (x, y, 1, x * y % _P)


def verify_ed25519(message: bytes, signature: bytes, public_key: bytes) -> bool:
    """Is the signature good?  Anything malformed is false."""
    if len(signature) != 64 or len(public_key) != 32:
        return False
    key, r, s = _point(public_key), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    if key is None or r is None or s >= _ORDER:
        return False
    k = int.from_bytes(hashlib.sha512(signature[:32] + public_key + message).digest(), "little") % _ORDER
    base = (_x_of(_BASE_Y, 0), _BASE_Y, 1, _x_of(_BASE_Y, 0) * _BASE_Y % _P)
    a, b = _times(s, base), _plus(r, _times(k, key))
    return (a[0] * b[2] - b[0] * a[2]) % _P == 0 and (a[1] * b[2] - b[1] * a[2]) % _P == 0


def ed25519_valid(message: Column, signature: Column, public_key: Column) -> Column:
    """``verify_ed25519`` row by row in Arrow batches; null inputs are false."""

    @F.pandas_udf("boolean")
    def run(m: pd.Series, s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([x is not None and y is not None and z is not None and verify_ed25519(bytes(x), bytes(y), bytes(z)) for x, y, z in zip(m, s, k)])

    return run(message.cast("binary"), signature, public_key)
