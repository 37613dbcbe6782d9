"""Source payloads to the canonical record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def factory_status(x: Column) -> Column:
    up = F.upper(x)
    return F.when(x == "", None).when(up.isin("VALID", "RENEWED", "PENDING_RENEWAL"), "Active").when(up == "EXPIRED", "Suspended").when(up == "REVOKED", "Cancelled").otherwise(x)


def commercial_taxes(df: DataFrame) -> DataFrame:
    a = F.col("principal_place_address")
    return df.select(
        F.coalesce(F.nullif("gstin", F.lit("")), F.col("id") if "id" in df.columns else F.lit(None)).alias("record_id"), F.lit("commercial_taxes").alias("department"), "gstin",
        F.when(F.col("gstin") != "", F.substring("gstin", 3, 10)).alias("pan"), F.coalesce(F.nullif("legal_name", F.lit("")), "trade_name").alias("business_name"), "trade_name",
        F.col("constitution_of_business").alias("legal_status"), F.col("nature_of_business").alias("business_type"),
        *[F.coalesce(a[c], F.lit("")).alias(n) for c, n in (("building", "address_line1"), ("street", "address_line2"), ("city", "city"), ("district", "district"), ("pincode", "pincode"))],
        F.col("gst_status").alias("status"),
    )


def factories_board(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("factory_license_no").alias("record_id"), F.lit("factories_board").alias("department"), F.lit(None).cast("string").alias("gstin"), F.col("pan_of_occupier").alias("pan"),
        F.col("factory_name").alias("business_name"), F.col("factory_name").alias("trade_name"), F.col("ownership_type").alias("legal_status"), F.lit("Manufacturing").alias("business_type"),
        F.col("factory_address").alias("address_line1"), F.lit("").alias("address_line2"), "city", "district", F.col("pin_code").alias("pincode"), factory_status(F.col("license_status")).alias("status"),
    )


def shops_establishments(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("registration_number").alias("record_id"), F.lit("shops_establishments").alias("department"), "gstin", "pan",
        F.coalesce(F.nullif("establishment_name", F.lit("")), "shop_name").alias("business_name"), F.col("shop_name").alias("trade_name"), F.col("type_of_establishment").alias("legal_status"),
        F.col("nature_of_business").alias("business_type"), F.col("address").alias("address_line1"), F.lit("").alias("address_line2"), F.coalesce("city", "taluk", F.lit("")).alias("city"), "district", "pincode",
        F.col("registration_status").alias("status"),
    )


NORMALISERS = {"commercial_taxes": commercial_taxes, "factories_board": factories_board, "shops_establishments": shops_establishments}


def normalised(department: str, df: DataFrame) -> DataFrame:
    if department not in NORMALISERS:
        raise ValueError(f"unknown department: {department}")
    return NORMALISERS[department](df)
