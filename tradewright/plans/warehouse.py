"""All-or-nothing warehouse build.

Every table of a build is written under its own `build=<id>` folder; the checks read those files;
a manifest row is appended last. Readers follow the newest manifest row, so a failing check or a
lost job leaves the previous build in place.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewright.operators import quality, star
from tradewright.sources import raw as rawsrc


class BuildRefused(RuntimeError):
    """An error-level check failed; nothing was published."""


def build(spark: SparkSession, source: dict[str, DataFrame], target: str, build_id: str,
          imported: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Write layers, run checks, publish. Returns the check table."""
    root = f"{target}/build={build_id}"

    def store(prefix, frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{root}/{prefix}{name}")
        return {name: spark.read.parquet(f"{root}/{prefix}{name}") for name in frames}

    stg = store("staging_", star.stage(source))
    fact = store("", star.facts(stg))
    dims = store("", star.dimensions(stg, fact, imported))
    store("", star.marts(fact["sales_lines"]))
    checks = quality.warehouse_checks(stg, fact, dims)
    checks.write.mode("overwrite").parquet(f"{root}/etl_checks")
    checks = spark.read.parquet(f"{root}/etl_checks")
    failed = checks.filter("status = 'error'").select("check").collect()      # a few dozen rows at most
    if failed:
        raise BuildRefused("checks failed: " + ", ".join(sorted(r["check"] for r in failed)))
    manifest = spark.range(1).select(F.lit(build_id).alias("build_id"), F.lit(rawsrc.SCHEMA_VERSION).alias("schema_version"),
                                     F.current_timestamp().alias("built_at"))
    if sources is not None:
        sources.write.mode("overwrite").parquet(f"{root}/source_signatures")
    manifest.coalesce(1).write.mode("append").parquet(f"{target}/manifest")
    return checks


def published(spark: SparkSession, target: str) -> str | None:
    """Identifier of the newest published build."""
    try:
        rows = spark.read.parquet(f"{target}/manifest")
    except AnalysisException:  # no build published yet
        return None
    return rows.agg(F.max_by("build_id", "built_at")).first()[0]


def table(spark: SparkSession, target: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{target}/build={published(spark, target)}/{name}")


def register_views(spark: SparkSession, target: str) -> None:
    """Presentation views under their public names."""
    get = lambda n: table(spark, target, n)
    views = {"sales": star.presented_sales(get("sales"), get("dim_customer"), get("dim_mode")),
             "purchases": star.presented_purchases(get("purchases")), "sales_lines": get("sales_lines"),
             "sales_lines_rejected": get("sales_lines_rejected"), "quotes": get("quotes"), "deliveries": get("deliveries"),
             "product_sales": get("mart_sales_product"), "product_family": get("mart_sales_family"),
             "client_product_demand": get("mart_demand_customer_product"), "client_margin": get("mart_margin_customer_month"),
             "margin_quality": get("mart_margin_quality"), "margin_category": get("mart_margin_category_month"),
             "margin_product": get("mart_margin_product")}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
