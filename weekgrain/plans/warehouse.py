"""The staged star schema: each table is built once, written, and read back.

Written tables cut the lineage, survive lost executors, prune columns on read, and carry
real sizes, from which the optimizer decides which dimensions it may broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekgrain.operators import base, dataset, dims, facts
from weekgrain.plans import eda, kpi
from weekgrain.sources.readers import read_snapshot
from weekgrain.sources.sinks import write_snapshot

BUILD: dict[str, Callable[[Callable[[str], DataFrame]], DataFrame]] = {
    # The raw lines may be a view with joins or text to parse: that is done once. Four builds read
    # what they need of this table.
    "raw_lines": lambda t: base.lines(t("raw")),
    "raw_places": lambda t: base.places_of(t("raw_lines")),
    "raw_products": lambda t: base.products_of(t("raw_lines")),
    "raw_weeks": lambda t: base.weeks_of(t("raw_lines")),
    "dim_channel": lambda t: dims.channels(t("raw_places")),
    "dim_country": lambda t: dims.countries(t("raw_places")),
    "dim_region": lambda t: dims.regions(t("raw_places"), t("dim_country")),
    "dim_date_week": lambda t: dims.weeks(t("raw_weeks")),
    "dim_product": lambda t: dims.products(t("raw_products")),
    "dim_wholesaler": lambda t: dims.wholesalers(
        t("raw_places"), t("dim_country"), t("dim_channel")
    ),
    "fact_weekly": lambda t: dataset.enrich_facts(
        facts.shipments(
            t("raw_lines"),
            t("dim_country"),
            t("dim_region"),
            t("dim_channel"),
            t("dim_wholesaler"),
        ),
        t("dim_channel"),
    ),
    "fact_shipments": lambda t: t("fact_weekly").select(*facts.FACT_KEYS, *facts.SHIPMENT_MEASURES),
    "fact_price": lambda t: _known(t).select(*facts.FACT_KEYS, *facts.PRICE_MEASURES),
    "fact_trade": lambda t: _known(t).select(*facts.FACT_KEYS, *facts.TRADE_MEASURES),
    "fact_competitor": lambda t: facts.competitor_prices(t("fact_price")),
    "wide": lambda t: dataset.wide_table(
        t("fact_weekly"),
        t("dim_product"),
        t("dim_country"),
        t("dim_channel"),
        t("dim_date_week"),
        t("dim_wholesaler"),
    ),
    # Sorted files let a week range skip row groups.
    "kpi": lambda t: kpi.weekly_kpis(t("wide")).sortWithinPartitions(*kpi.ORDER),
    "price_index": lambda t: eda.price_index(
        t("wide").select(*facts.FACT_KEYS, "channel_name", "list_unit_price"),
        facts.competitor_means(t("fact_price")),
    ),
}

# Not written: three facts share one grain and are stored side by side in fact_weekly, so each
# is a column projection of it; competitor prices are three times as long as the price fact
# and follow from it row by row.
DERIVED = {"fact_shipments", "fact_price", "fact_trade", "fact_competitor"}


def _known(t) -> DataFrame:
    """Rows with a product: only these have a price and a trade row."""
    return t("fact_weekly").where(F.col("price_strategy").isNotNull())


class Warehouse:
    """Tables by name, built on first use under `root`."""

    def __init__(self, spark: SparkSession, raw: DataFrame, root: str):
        self.spark, self.raw, self.root = spark, raw, root
        self._schemas: dict = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def __call__(self, name: str) -> DataFrame:
        if name == "raw":
            return self.raw
        if name in DERIVED:
            return BUILD[name](self)
        if name not in self._schemas:
            self.load(name)
        return read_snapshot(self.spark, self.path(name), self._schemas[name])

    def load(self, name: str) -> None:
        """(Re)build one table: full refresh from its inputs."""
        df = BUILD[name](self)
        write_snapshot(df, self.path(name))
        self._schemas[name] = df.schema

    def build_all(self) -> None:
        for name in BUILD:
            self(name)
