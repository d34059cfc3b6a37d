"""The operators' registered queries and the SQL of those that SQL can express."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from importlib import import_module
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

# name of the query: module and function
NAMES = {
    "op1_chat_format": "chat_format.op1",
    "op2_secret_scan": "secret_scan.op2",
    "op3_sharding": "sharding.op3",
    "op4_url_filter": "url_filter.op4",
    "op5_packing": "packing.op5",
    "op6_token_count": "token_count.op6",
    "op7_vector_index": "vector_index.op7",
    "op10_set_sketch": "set_sketch.op10",
    "op8_decontaminate": "decontaminate.op8",
    "op9_toxicity": "toxicity.op9",
    "op11_resampling": "resampling.op11",
    "op12_periodic": "periodic.op12",
    "op13_token_output": "token_output.op13",
}
_shipped: set[str] = set()
# Bytes of a batch that goes to Python: a few copies of it are held on either side.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 23


def ship(spark: SparkSession, settings: dict[str, int] = {BATCH: BATCH_BYTES}) -> None:  # noqa: B006
    """Send this package to the executors' Python, once per application, and bound the session's
    Arrow batches, or what else settings name, unless the application has its own bound."""
    for name, value in settings.items():
        if not spark.sparkContext.getConf().contains(name):
            spark.conf.set(name, str(value))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="weekgrain-")) / "weekgrain_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def _query(module: str, function: str) -> Query:
    fn = getattr(import_module(f"weekgrain.llm.{module}"), function)

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {name: _query(*at.split(".")) for name, at in NAMES.items()}


def _sql() -> dict[str, str]:
    out = {}
    for name, at in NAMES.items():
        module, function = at.split(".")
        text = getattr(import_module(f"weekgrain.llm.{module}"), f"{function.upper()}_SQL", None)
        if text:
            out[name] = text
    return out


ORACLES: dict[str, str] = _sql()
