"""Keyed fingerprints as column expressions."""

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of RFC 2104: the block of SHA-256, and the bytes of both pads.
BLOCK, INNER, OUTER = 64, 0x36, 0x5C


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in lower-case hex of a text (its UTF-8) or of bytes; null of null.  Only the padded key is in the plan, never a lookup."""
    padded = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    pad = lambda byte: F.lit(bytes(b ^ byte for b in padded))
    inner = F.unhex(F.sha2(F.concat(pad(INNER), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(OUTER), inner), 256)


def fingerprint(key: bytes, identifier: Column) -> Column:
    """The fingerprint under which an identifier is suppressed: trimmed, without case."""
    return hmac_sha256(key, F.lower(F.trim(identifier)))
