"""Save and reload extracted filing facts."""

from pyspark.sql import DataFrame, SparkSession

FACTS_SCHEMA = (
    "ticker string, suppliers array<string>, "
    "geographic_exposure array<struct<region: string, share: double>>, "
    "risk_factors array<string>, "
    "revenue_by_region array<struct<region: string, share: double>>, "
    "main_products array<string>, dependencies array<string>, key_customers array<string>, "
    "manufacturing_locations array<string>")


def write_facts(facts: DataFrame, path: str, fmt: str = "parquet") -> None:
    facts.write.mode("overwrite").format(fmt).save(path)


def read_facts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(FACTS_SCHEMA).format(fmt).load(path)
