"""The catalog as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.schema import Catalog


def tables(spark: SparkSession, catalog: Catalog, schema: str = "public") -> DataFrame:
    rows = [(schema, t.name, t.access) for t in catalog.tables.values()]
    return spark.createDataFrame(rows, "table_schema string, table_name string, access string")


def columns(spark: SparkSession, catalog: Catalog, schema: str = "public") -> DataFrame:
    rows = [
        (schema, t.name, c.name, k, "YES" if c.nullable else "NO", c.kind.spark) for t in catalog.tables.values() for k, c in enumerate(t.columns, 1)
    ]
    return spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")
