"""Database sink over JDBC: create if missing, insert, or upsert by a key."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import last_by_key


@dataclass
class Database:
    """``columns``: name -> SQL type. An upsert goes through a staging table, written by all tasks, and one MERGE, so a batch is applied whole or not at all."""

    url: str
    table: str
    columns: dict[str, str]
    key: str
    create: bool = True
    upsert: bool = True
    order: str | None = None
    driver: str = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    properties: dict[str, str] = field(default_factory=dict)

    def _connect(self, spark: SparkSession):
        """A connection with all of ``properties``, user and password among them."""
        spark._jvm.java.lang.Class.forName(self.driver)
        given = spark._jvm.java.util.Properties()
        for k, v in self.properties.items():
            given.setProperty(k, v)
        return spark._jvm.java.sql.DriverManager.getConnection(self.url, given)

    def execute(self, spark: SparkSession, *statements: str) -> None:
        connection = self._connect(spark)
        try:
            for sql in statements:
                statement = connection.createStatement()
                try:
                    statement.execute(sql)
                finally:
                    statement.close()
        finally:
            connection.close()

    def exists(self, spark: SparkSession, table: str) -> bool:
        connection = self._connect(spark)
        try:
            found = connection.getMetaData().getTables(None, None, table.upper(), None)
            return found.next()
        finally:
            connection.close()

    def ensure(self, spark: SparkSession, table: str | None = None, keyed: bool = True) -> None:
        table = table or self.table
        if not self.exists(spark, table):
            columns = ", ".join(f"{c} {t}{' NOT NULL PRIMARY KEY' if keyed and c == self.key else ''}" for c, t in self.columns.items())
            self.execute(spark, f"CREATE TABLE {table} ({columns})")

    def write(self, df: DataFrame, number: int = 0) -> None:
        """One batch. The last row of each key wins: by ``order``, or without it by its place in the batch."""
        spark = df.sparkSession
        if self.create:
            self.ensure(spark, keyed=self.upsert)
        rows, order = (df, self.order) if self.order else (df.withColumn("_place", F.monotonically_increasing_id()), "_place")
        rows = (last_by_key(rows, self.key, order) if self.upsert else df).select(*self.columns)
        if not self.upsert:
            rows.write.jdbc(self.url, self.table, "append", self.properties | {"driver": self.driver})
            return
        staging = f"{self.table}_{uuid.uuid4().hex[:12]}"  # of this batch alone, so writers don't meet
        self.ensure(spark, staging, keyed=False)
        rows.write.jdbc(self.url, staging, "append", self.properties | {"driver": self.driver})
        rest = [c for c in self.columns if c != self.key]
        matched = f"WHEN MATCHED THEN UPDATE SET {', '.join(f't.{c} = s.{c}' for c in rest)} " if rest else ""
        names, values = ", ".join(self.columns), ", ".join(f"s.{c}" for c in self.columns)
        self.execute(spark, f"MERGE INTO {self.table} t USING {staging} s ON t.{self.key} = s.{self.key} {matched}WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})", f"DROP TABLE {staging}")

    def batches(self) -> Callable[[DataFrame, int], None]:
        return self.write

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.jdbc(self.url, self.table, properties=self.properties | {"driver": self.driver})
