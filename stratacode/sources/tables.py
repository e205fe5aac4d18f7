"""Reading and writing the model's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import TABLES, conform


def read_table(spark: SparkSession, root: str, name: str, form: str = "parquet") -> DataFrame:
    """A table of the model from parquet, ORC or JSON lines, completed to its schema."""
    reader = spark.read.schema(TABLES[name]) if form == "json" else spark.read
    return conform(reader.format(form).load(f"{root}/{name}.{form}"), name)


def write_table(df: DataFrame, root: str, name: str, form: str = "parquet", by_project: bool = False) -> str:
    """Writes a table of the model as a whole; with ``by_project`` one folder a project, of which only those in ``df`` are replaced."""
    path = f"{root}/{name}.{form}"
    writer = df.write.format(form).mode("overwrite")
    if by_project:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy("project_id")
    writer.save(path)
    return path
