"""Hashing and authenticated decryption of single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters allowed at the start and end of a national id.
NATIONAL_ID_PREFIX = "ABCEGHJKLMNPRSTWXYZ"
NATIONAL_ID_SUFFIX = "ABCD"


def url_safe_base64(binary: Column) -> Column:
    """URL-safe base64 on one line (the default encoder wraps at 76 characters)."""
    return F.translate(F.base64(binary), "+/\r\n", "-_")


def hash_identifier(value: Column, salt: Column | str) -> Column:
    """SHA-512 of value and salt, as URL-safe base64."""
    salted = F.concat(value, salt if isinstance(salt, Column) else F.lit(salt))
    return url_safe_base64(F.unhex(F.sha2(salted, 512)))


def decrypt_amount(cipher_text: Column, key: Column) -> Column:
    """Text of a URL-safe base64 value holding a 12-byte nonce and an AES-GCM body."""
    raw = F.unbase64(F.translate(cipher_text, "-_", "+/"))
    return F.aes_decrypt(raw, key, F.lit("GCM")).cast("string")


def encrypt_amount(text: Column, key: Column) -> Column:
    """Counterpart of :func:`decrypt_amount`."""
    return url_safe_base64(F.aes_encrypt(text.cast("binary"), key, F.lit("GCM")))


def national_id(seed: Column) -> Column:
    """Well-formed identifier derived from a seed: two letters, six digits, one letter."""
    draw = lambda n, i: F.pmod(F.xxhash64(seed, F.lit(i)), F.lit(n)).cast("int")
    letter = lambda text, i: F.substring(F.lit(text), draw(len(text), i) + 1, F.lit(1))
    return F.concat(
        letter(NATIONAL_ID_PREFIX, 1),
        letter(NATIONAL_ID_PREFIX, 2),
        F.lpad(draw(1_000_000, 3).cast("string"), 6, "0"),
        letter(NATIONAL_ID_SUFFIX, 4),
    )
