"""Keys and sealed maps: HKDF-SHA256 on the driver, AES-GCM in the JVM."""

from __future__ import annotations

import hashlib
import hmac
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INFO = b"shadowmap"
SECRET_BYTES = 32


def device_secret(path: str | None) -> bytes:
    """The secret in the file, which is made (readable by its owner alone) where it is missing; a passing one without a path."""
    if path is None:
        return os.urandom(SECRET_BYTES)
    try:
        with open(path, "rb") as f:
            found = f.read()
        if len(found) == SECRET_BYTES:
            return found
    except FileNotFoundError:
        pass
    made = os.urandom(SECRET_BYTES)
    try:
        with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "wb") as f:
            f.write(made)
    except OSError:
        pass
    return made


def derive_key(secret: bytes, session: str, info: bytes = INFO, size: int = 32) -> bytes:
    """HKDF (RFC 5869) with the session's name as salt."""
    prk = hmac.new(session.encode(), secret, hashlib.sha256).digest()
    out, block, i = b"", b"", 1
    while len(out) < size:
        block = hmac.new(prk, block + info + bytes([i]), hashlib.sha256).digest()
        out, i = out + block, i + 1
    return out[:size]


def derived_key(secret: bytes, session: Column) -> Column:
    """`derive_key` for a column of sessions. The secret travels inside the function, so `explain` doesn't show it."""

    @F.pandas_udf("binary")
    def derive(sessions: pd.Series) -> pd.Series:
        return sessions.map(lambda s: derive_key(secret, s), na_action="ignore")

    return derive(session)


def seal(value: Column, key: Column) -> Column:
    """Nonce (12 bytes), ciphertext and tag."""
    return F.aes_encrypt(value, key, F.lit("GCM"))


def unseal(value: Column, key: Column) -> Column:
    """The sealed text; null where data is missing, short, damaged, or sealed with another key."""
    return F.when(F.octet_length(value) > 28, F.try_aes_decrypt(value, key, F.lit("GCM")).cast("string"))
