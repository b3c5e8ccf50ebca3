"""Cost of serverless jobs and pipelines from usage and list prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage with the list price of its time: an equi-join on SKU and unit with the price's period as a residual."""
    p = prices.select("sku_name", "usage_unit", "price", "price_start_time", "price_end_time")
    at = F.col("usage_start_time")
    within = (at >= F.col("price_start_time")) & (F.col("price_end_time").isNull() | (at < F.col("price_end_time")))
    return usage.join(p, ["sku_name", "usage_unit"]).filter(within)


def _total() -> Column:
    exact = F.col("usage_quantity").cast("decimal(18,4)") * F.col("price").cast("decimal(18,4)")
    return F.round(F.sum(exact), 2).cast("double")


def cost_by_entity(usage: DataFrame, prices: DataFrame, *, as_of: str | None = None, days: int = 30) -> DataFrame:
    """(entity_type, entity_id, cost_usd) of serverless jobs and of pipelines; with ``as_of`` of the last ``days`` days. Money is summed as decimals, then rounded."""
    if as_of is not None:
        usage = usage.filter(F.to_date("usage_start_time") > F.date_sub(F.to_date(F.lit(as_of)), days))
    rows = priced(usage, prices)
    job = F.col("job_id").isNotNull() & F.col("sku_name").contains("JOBS_SERVERLESS")
    kinds = F.array(F.when(job, F.struct(F.lit("JOB").alias("entity_type"), F.col("job_id").alias("entity_id"))), F.when(F.col("dlt_pipeline_id").isNotNull(), F.struct(F.lit("PIPELINE").alias("entity_type"), F.col("dlt_pipeline_id").alias("entity_id"))))
    one = rows.select("usage_quantity", "price", F.explode(F.array_compact(kinds)).alias("k")).select("usage_quantity", "price", "k.entity_type", "k.entity_id")
    return one.groupBy("entity_type", "entity_id").agg(_total().alias("cost_usd"))


def with_cost(entities: DataFrame, cost: DataFrame) -> DataFrame:
    """Entities with cost_usd, null where none is known; a cost that they had before is replaced."""
    return entities.drop("cost_usd").join(cost.select("entity_type", "entity_id", "cost_usd"), ["entity_type", "entity_id"], "left")
