"""The nine stored tables, from files or from a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from depthspark.schemas import TABLES


def load_tables(spark: SparkSession, root: str, fmt: str = "parquet",
                names: list[str] | None = None) -> dict[str, DataFrame]:
    """Each table with its fixed schema, never inferred; ``connection_events`` is partitioned by day."""
    return {name: spark.read.schema(TABLES[name]).format(fmt).load(f"{root}/{name}")
            for name in names or TABLES}


def load_jdbc(spark: SparkSession, name: str, options: dict[str, str], partition_column: str | None = None,
              bounds: tuple[str, str] | None = None, partitions: int = 16) -> DataFrame:
    """One table over JDBC; give a partition column with bounds to read it with many tasks."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", name)
    if partition_column and bounds:
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0])
                  .option("upperBound", bounds[1]).option("numPartitions", str(partitions)))
    return reader.load()
