"""Business labels as CASE expressions over Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weekgrain.functions.hashing import hash_bucket

# Customer segment -> sales channel.
CHANNEL_OF_SEGMENT = {
    "Consumer": "Retail",
    "Corporate": "Key Accounts",
    "Home Office": "E-Commerce",
}
DEFAULT_CHANNEL = "Retail"

# Source category -> (family, category, format, variant prefix).
PRODUCT_LINE = {
    "Office Supplies": ("Cigarettes", "Combustible", "Combustible", "CIG"),
    "Technology": ("Heated Tobacco", "Heat-not-burn", "Heated", "HTP"),
    "Furniture": ("Oral Nicotine", "Nicotine Pouches", "Oral", "ONP"),
}
DEFAULT_LINE = ("Other", "Other", "Other", "GEN")

# Hash remainder -> label.
TIER_OF_BUCKET = {0: "Premium", 1: "Core"}
DEFAULT_TIER = "Value"
PACK_OF_BUCKET = {0: "10-pack", 1: "20-pack", 2: "30-pack"}
DEFAULT_PACK = "Multi-pack"

# Channel -> wholesaler tier.
WHOLESALER_TIER_OF_CHANNEL = {"Key Accounts": "T1", "Retail": "T2"}
DEFAULT_WHOLESALER_TIER = "T3"

KEY_ACCOUNTS = "Key Accounts"
COMPLIANCE_LIMIT = "0.25"
PRICE_MOVE = "0.01"


def choose(key: Column, mapping: dict, default) -> Column:
    """CASE key WHEN k THEN v ... ELSE default END; a null key takes the default."""
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


def channel_of(segment: Column) -> Column:
    return choose(segment, CHANNEL_OF_SEGMENT, DEFAULT_CHANNEL)


def _line_part(category: Column, part: int) -> Column:
    return choose(category, {k: v[part] for k, v in PRODUCT_LINE.items()}, DEFAULT_LINE[part])


def product_family(category: Column) -> Column:
    return _line_part(category, 0)


def product_category(category: Column) -> Column:
    return _line_part(category, 1)


def nicotine_format(category: Column) -> Column:
    return _line_part(category, 2)


def variant_prefix(category: Column) -> Column:
    return _line_part(category, 3)


def brand_tier(product_id: Column) -> Column:
    return choose(hash_bucket(product_id, 3), TIER_OF_BUCKET, DEFAULT_TIER)


def pack_size(product_id: Column) -> Column:
    return choose(hash_bucket(product_id, 4), PACK_OF_BUCKET, DEFAULT_PACK)


def wholesaler_tier(channel_name: Column) -> Column:
    return choose(channel_name, WHOLESALER_TIER_OF_CHANNEL, DEFAULT_WHOLESALER_TIER)


def price_change_flag(net: Column, previous: Column) -> Column:
    """1 when the price moved by a cent or more since the last observed week."""
    moved = F.abs(net - previous) >= F.lit(PRICE_MOVE).cast("decimal(3,2)")
    return F.when(previous.isNull(), 0).when(moved, 1).otherwise(0)


def price_strategy(tier: Column, is_key_account: Column) -> Column:
    """Tier is tested before channel."""
    return (
        F.when(tier == "Premium", "Premium Hold")
        .when(tier == "Value", "Value Drive")
        .when(is_key_account, "Contracted")
        .otherwise("Core Maintain")
    )


def incentive_type(tier: Column, is_key_account: Column) -> Column:
    """Channel is tested before tier: the reverse of price_strategy."""
    return (
        F.when(is_key_account, "Contract Rebate")
        .when(tier == "Premium", "Display Allowance")
        .when(tier == "Value", "Price Support")
        .otherwise("Volume Discount")
    )


def compliance_flag(pct: Column, limit: str = COMPLIANCE_LIMIT) -> Column:
    """1 up to and including the limit; a missing rate counts as 0."""
    return (F.coalesce(pct, F.lit(0)) <= F.lit(limit).cast("decimal(10,4)")).cast("int")
