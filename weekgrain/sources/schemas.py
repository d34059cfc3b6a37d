"""Declared schemas as DDL text, so that no reader has to infer types."""

from __future__ import annotations

# Columns of the raw order file, in file order.
RAW_FILE_COLUMNS = {
    "category": "string",
    "city": "string",
    "country": "string",
    "discount": "decimal(10,4)",
    "market": "string",
    "Order.ID": "string",
    "Order.Priority": "string",
    "Product.ID": "string",
    "Product.Name": "string",
    "profit": "decimal(10,2)",
    "quantity": "int",
    "region": "string",
    "sales": "decimal(10,2)",
    "segment": "string",
    "Ship.Mode": "string",
    "Shipping.Cost": "decimal(10,2)",
    "state": "string",
    "Sub.Category": "string",
    "Year": "int",
    "market2": "string",
    "weeknum": "int",
}


def snake(name: str) -> str:
    """Order.ID -> order_id"""
    out = name.strip().lower()
    for mark in ". -":
        out = out.replace(mark, "_")
    return out


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())


RAW_COLUMNS = {snake(name): kind for name, kind in RAW_FILE_COLUMNS.items()}

KPI_KEYS = {
    "date_week_id": "int",
    "fiscal_year": "int",
    "fiscal_week": "int",
    "fiscal_quarter": "int",
    "month": "int",
    "operating_country": "string",
    "channel_name": "string",
    "product_family": "string",
    "product_category": "string",
    "brand_tier": "string",
    "wholesaler_tier": "string",
}

KPI_MEASURES = {
    "shipments_units": "double",
    "gross_revenue": "double",
    "trade_spend": "double",
    "trade_spend_pct": "double",
    "net_revenue_after_trade": "double",
    "avg_list_price": "double",
    "avg_net_price": "double",
    "price_realization": "double",
    "avg_contribution_margin_proxy": "double",
}

KPI_COLUMNS = {**KPI_KEYS, **KPI_MEASURES}
