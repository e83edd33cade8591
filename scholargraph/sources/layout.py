"""Statement tables laid out by item: buckets of ``item_id``, sorted inside.

The merges of J6, J5 and P3 join statements on the item and the property, again
and again, with a batch that is small beside them. From a bucketed table they
read the statement side without an exchange; only the batch is dealt out
(``deal``). One item's statements lie in one bucket.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Lets a join on (item_id, property) use rows that are dealt by item_id alone.
SUBSET_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def write_statements(statements: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Write statements as a bucketed table ``name`` at ``path`` (a new folder in
    shared storage) and read it. ``item_id`` is dealt out once, here; one file
    per bucket."""
    dealt = statements.repartition(buckets, "item_id")
    dealt.write.mode("errorifexists").format("parquet").bucketBy(buckets, "item_id").sortBy("item_id").option("path", path).saveAsTable(name)
    return read_statements(statements.sparkSession, name)


def open_statements(spark: SparkSession, name: str, path: str, schema: str, buckets: int) -> DataFrame:
    """A table that ``write_statements`` wrote, in a session whose catalog does not know it."""
    if not spark.catalog.tableExists(name):
        spark.sql(
            f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (item_id) SORTED BY (item_id) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
        )
    return read_statements(spark, name)


def read_statements(spark: SparkSession, name: str) -> DataFrame:
    """The table, with joins on more than ``item_id`` using its buckets too."""
    spark.conf.set(SUBSET_KEYS, "false")
    return spark.table(name)


def deal(df: DataFrame, buckets: int) -> DataFrame:
    """A batch dealt out as the table is, so that what groups and joins it next
    finds it in place and leaves the table where it is."""
    return df.repartition(buckets, "item_id")


def drop_statements(spark: SparkSession, name: str) -> None:
    """Forget the table; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def exchanged(df: DataFrame, name: str) -> list[str]:
    """The exchanges of ``df``'s plan that rows of the table ``name`` go through
    (none, if its buckets are used); for guards and tuning."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    found = []
    for i, line in enumerate(lines):
        if "FileScan" in line and f".{name}[" in line:
            level = depth(line)
            for above in reversed(lines[:i]):
                if depth(above) < level:
                    level = depth(above)
                    if "Exchange" in above:
                        found.append(above.strip())
    return found
