"""Identifiers: validation, keyed tokens, masks. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The identifiers' formats.
GSTIN = "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"
PAN = "^[A-Z]{5}[0-9]{4}[A-Z]$"
UDYAM = "^UDYAM-[A-Z]{2}-[0-9]{2}-[0-9]{7}$"
AADHAAR = "^[2-9][0-9]{11}$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tidy(x: Column | str) -> Column:
    """Upper case without white space at the ends."""
    return F.upper(F.regexp_replace(_c(x), r"^\s+|\s+$", ""))


def valid_gstin(x: Column | str) -> Column:
    return F.coalesce(tidy(x).rlike(GSTIN), F.lit(False))


def valid_pan(x: Column | str) -> Column:
    return F.coalesce(tidy(x).rlike(PAN), F.lit(False))


def valid_udyam(x: Column | str) -> Column:
    return F.coalesce(tidy(x).rlike(UDYAM), F.lit(False))


def clean_aadhaar(x: Column | str) -> Column:
    return F.translate(_c(x), " -", "")


def valid_aadhaar(x: Column | str) -> Column:
    return F.coalesce(clean_aadhaar(x).rlike(AADHAAR), F.lit(False))


def in_karnataka(x: Column | str) -> Column:
    return valid_gstin(x) & (F.substring(_c(x), 1, 2) == "29")


def pan_of_gstin(x: Column | str) -> Column:
    return F.when(valid_gstin(x), F.substring(_c(x), 3, 10))


def hmac_sha256(message: Column, key: str) -> Column:
    """HMAC-SHA256 in hex; the key's pads are worked out on the driver."""
    import hashlib

    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)
    first = F.sha2(F.concat(F.lit(bytearray(inner)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)


def token(x: Column | str, kind: str, valid: Column, key: str) -> Column:
    return F.when(valid, hmac_sha256(tidy(F.concat(F.lit(f"{kind}:"), _c(x))), key))


def pan_token(x, key):
    return token(x, "PAN", valid_pan(x), key)


def gstin_token(x, key):
    return token(x, "GSTIN", valid_gstin(x), key)


def udyam_token(x, key):
    return token(x, "UDYAM", valid_udyam(x), key)


def aadhaar_token(x, key):
    return token(clean_aadhaar(x), "AADHAAR", valid_aadhaar(x), key)


def short_token(x: Column | str) -> Column:
    """A token's first 128 bits in 24 characters, to compare tokens where many copies of them are moved; empty and null stay."""
    return F.base64(F.unhex(F.left(_c(x), F.lit(32))))


def tokenized(df: DataFrame, key: str) -> DataFrame:
    """Raw identifiers replaced by tokens; the PAN inside a GSTIN counts only where no PAN is given."""
    have = lambda c: c in df.columns
    embedded = pan_token(pan_of_gstin("gstin"), key) if have("gstin") else F.lit(None).cast("string")
    out = df.withColumn("pan_token", F.when(F.coalesce(F.col("pan"), F.lit("")) != "", pan_token("pan", key)).otherwise(embedded) if have("pan") else embedded)
    for c, f in (("gstin", gstin_token), ("udyam_number", udyam_token), ("aadhaar", aadhaar_token)):
        if have(c):
            out = out.withColumn(f"{c}_token", f(c, key))
    return out.drop("pan", "gstin", "udyam_number", "aadhaar")


def mask_pan(x: Column | str) -> Column:
    return F.when(F.length(_c(x)) < 6, _c(x)).otherwise(F.concat(F.left(_c(x), F.lit(4)), F.lit("●●●●"), F.right(_c(x), F.lit(2))))


def mask_gstin(x: Column | str) -> Column:
    return F.when(F.length(_c(x)) < 10, _c(x)).otherwise(F.concat(F.left(_c(x), F.lit(5)), F.lit("●●●●●●●●"), F.right(_c(x), F.lit(2))))


def export_pan(x: Column | str) -> Column:
    return F.when(F.length(_c(x)) >= 6, F.concat(F.left(_c(x), F.lit(4)), F.lit("****"), F.right(_c(x), F.lit(2)))).otherwise(F.coalesce(_c(x), F.lit("")))


def export_gstin(x: Column | str) -> Column:
    return F.when(F.length(_c(x)) >= 10, F.concat(F.left(_c(x), F.lit(5)), F.lit("*********"), F.right(_c(x), F.lit(2)))).otherwise(F.coalesce(_c(x), F.lit("")))
