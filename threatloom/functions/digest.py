"""Hash-based identities: SHA-256 ids, keyed handles, seeded draws."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F


def sha_hex(text: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, length)


def keyed_hex(text: Column, key: bytes) -> Column:
    """HMAC-SHA-256 as two nested digests; the padded key is a literal."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    padded = key.ljust(64, b"\0")
    inner_pad = F.unhex(F.lit(bytes(b ^ 0x36 for b in padded).hex()))
    outer_pad = F.unhex(F.lit(bytes(b ^ 0x5C for b in padded).hex()))
    inner = F.unhex(F.sha2(F.concat(inner_pad, F.encode(text, "UTF-8")), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)


def handle_for(client_ref: Column, key: bytes) -> Column:
    """Pseudonymous requester handle."""
    return F.concat(F.lit("rh--"), F.substring(keyed_hex(client_ref, key), 1, 16))


def first_draw(seed: Column, lo: int, hi: int, domain: str) -> Column:
    """First number of the counter-mode generator for ``seed``, in lo..hi.

    ``domain`` is the separation prefix of the deployment whose draws must be
    replayed. The first eight digest bytes are read as an unsigned number.
    """
    lo, hi = min(lo, hi), max(lo, hi)
    if lo == hi:
        return F.lit(lo).cast("long")
    key = F.unhex(F.sha2(F.encode(F.concat(F.lit(domain + "|"), seed), "UTF-8"), 256))
    block = F.sha2(F.concat(key, F.unhex(F.lit("00" * 8))), 256)
    word = F.conv(F.substring(block, 1, 16), 16, 10).cast("decimal(20,0)")
    return (F.lit(lo) + (word % F.lit(hi - lo + 1).cast("decimal(20,0)")).cast("long")).cast("long")


def micros_of(fraction: float) -> int:
    return int(round(max(0.0, fraction) * 1_000_000))


def scaled_draw(seed: Column, nominal: Column, lo: float, hi: float, domain: str) -> tuple[Column, Column]:
    """(drawn value, fraction micros): floor(nominal x fraction), within 1..nominal."""
    fraction = first_draw(seed, micros_of(min(lo, hi)), micros_of(max(lo, hi)), domain)
    nominal = nominal.cast("long")
    scaled = F.floor((nominal * fraction).cast("decimal(38,0)") / F.lit(1_000_000)).cast("long")
    value = F.greatest(F.lit(1).cast("long"), F.least(nominal, scaled))
    return (F.when(nominal > 0, value).otherwise(F.lit(0).cast("long")),
            F.when(nominal > 0, fraction).otherwise(F.lit(1_000_000).cast("long")))
