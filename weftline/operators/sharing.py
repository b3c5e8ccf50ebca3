"""Shares, recipients, providers and foreign catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AUDIENCES = ("provider", "recipient", "both")


def audience_of(wanted: str | None) -> str:
    return wanted if wanted in AUDIENCES else "both"


def recipients_by_share(privileges: DataFrame) -> DataFrame:
    """(share_name, recipients) of those that may select from a share."""
    may = privileges.filter(F.upper("privilege_type") == "SELECT")
    return may.groupBy("share_name").agg(F.sort_array(F.collect_set("recipient_name")).alias("recipients"))


def shared_out(table_shares: DataFrame, privileges: DataFrame) -> DataFrame:
    """(full_name, share_name, shared_as, recipients): which tables go out, under which name, to whom."""
    full = F.concat_ws(".", "catalog_name", "schema_name", "table_name")
    schema = F.coalesce(F.nullif("shared_as_schema", F.lit("")), "schema_name")
    named = F.when(F.coalesce("shared_as_table", F.lit("")) != "", F.concat_ws(".", schema, "shared_as_table"))
    cdf = F.lower(F.col("cdf_enabled").cast("string")) == "true" if "cdf_enabled" in table_shares.columns else F.lit(False)
    rows = table_shares.select(full.alias("full_name"), "share_name", named.alias("shared_as"), F.coalesce(cdf, F.lit(False)).alias("cdf_enabled")).distinct()
    return rows.join(recipients_by_share(privileges), "share_name", "left").withColumn("recipients", F.coalesce("recipients", F.array().cast("array<string>")))


def foreign_catalogs(catalog_uses: DataFrame, providers: DataFrame) -> DataFrame:
    """(catalog_name, provider_name, cloud, region, share_names) of catalogs that come from a provider."""
    who = providers.select("provider_name", "cloud", "region")
    rows = catalog_uses.join(who, "provider_name", "left").withColumn("provider_name", F.coalesce("provider_name", F.lit("unknown")))
    return rows.groupBy("catalog_name", "provider_name").agg(F.max("cloud").alias("cloud"), F.max("region").alias("region"), F.sort_array(F.collect_set("share_name")).alias("share_names"))


def overlay(table_shares: DataFrame, privileges: DataFrame, catalog_uses: DataFrame, providers: DataFrame, audience: str | None = None) -> dict[str, DataFrame]:
    """Both halves, or only what a provider or a recipient sees."""
    who = audience_of(audience)
    out, into = shared_out(table_shares, privileges), foreign_catalogs(catalog_uses, providers)
    return {"shared_out": out if who != "recipient" else out.limit(0), "foreign_catalogs": into if who != "provider" else into.limit(0)}


def totals(shares: DataFrame, recipients: DataFrame, providers: DataFrame, catalog_uses: DataFrame, table_shares: DataFrame) -> DataFrame:
    """One row of counts."""
    one = [df.agg(F.countDistinct(c).alias(name)).withColumn("_", F.lit(1)) for df, c, name in (
        (shares, "share_name", "shares"), (recipients, "recipient_name", "recipients"), (providers, "provider_name", "providers"), (catalog_uses, "catalog_name", "foreign_catalogs"),
        (table_shares.withColumn("t", F.concat_ws(".", "catalog_name", "schema_name", "table_name")), "t", "shared_tables"),
    )]
    out = one[0]
    for df in one[1:]:
        out = out.join(df, "_")
    return out.drop("_")


def tables_per_share(table_shares: DataFrame) -> DataFrame:
    return table_shares.groupBy("share_name").agg(F.countDistinct("catalog_name", "schema_name", "table_name").alias("tables"))


def overview(shares: DataFrame, recipients: DataFrame, providers: DataFrame, catalog_uses: DataFrame, table_shares: DataFrame, privileges: DataFrame) -> dict[str, DataFrame]:
    """All inventories and their totals."""
    return {
        "shares": shares.join(tables_per_share(table_shares), "share_name", "left").na.fill(0, ["tables"]).join(recipients_by_share(privileges), "share_name", "left"),
        "recipients": recipients, "providers": providers, "foreign_catalogs": foreign_catalogs(catalog_uses, providers),
        "shared_tables": shared_out(table_shares, privileges), "totals": totals(shares, recipients, providers, catalog_uses, table_shares),
    }


def augmented(nodes: DataFrame, edges: DataFrame, out: DataFrame, foreign: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with share, recipient and provider nodes for the tables (node) that are shown."""
    shown = out.join(nodes.select(F.col("node").alias("full_name")), "full_name", "left_semi")
    share = F.concat(F.lit("sharing:share:"), "share_name")
    to_share = shown.select(F.col("full_name").alias("source"), share.alias("target"))
    to_people = shown.select(share.alias("source"), F.explode("recipients").alias("r")).select("source", F.concat(F.lit("sharing:recipient:"), "r").alias("target"))
    by_catalog = nodes.withColumn("catalog_name", F.substring_index("node", ".", 1)).join(foreign, "catalog_name")
    from_provider = by_catalog.select(F.concat(F.lit("sharing:provider:"), "provider_name").alias("source"), F.col("node").alias("target"))
    extra = to_share.unionByName(to_people).unionByName(from_provider).distinct()
    added = extra.select(F.explode(F.array("source", "target")).alias("node")).filter(F.col("node").startswith("sharing:")).distinct()
    return nodes.select("node").unionByName(added), edges.select("source", "target").unionByName(extra)
