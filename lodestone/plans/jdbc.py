"""Loads into a database that take effect once, whatever is run again.

Spark writes each partition in a transaction of its own; a task that is lost after its commit is run again, and its
rows are there twice. So rows go to a staging table first, each with the run, its number in it and a mark of its copy. One
transaction on the driver then enters the load in a ledger, whose key refuses a second entry, and moves one copy
of every row to the target. A run that ends before that has changed nothing but the staging table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources import files


class LoadError(RuntimeError):
    """The staging table does not hold what was written to it."""


class _Connection:
    """A connection of the driver's JVM, for a few small statements."""

    def __init__(self, spark: SparkSession, url: str, options: dict[str, str]):
        jvm = spark.sparkContext._jvm
        if options.get("driver"):
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
        properties = jvm.java.util.Properties()
        for key in ("user", "password"):
            if options.get(key):
                properties.setProperty(key, options[key])
        self.own = jvm.java.sql.DriverManager.getConnection(url, properties)

    def __enter__(self) -> _Connection:
        return self

    def __exit__(self, *_) -> None:
        self.own.close()

    def run(self, sql: str, *values) -> int:
        statement = self.own.prepareStatement(sql)
        try:
            for i, v in enumerate(values):
                statement.setObject(i + 1, v)
            return statement.executeUpdate()
        finally:
            statement.close()

    def number(self, sql: str, *values) -> int:
        statement = self.own.prepareStatement(sql)
        try:
            for i, v in enumerate(values):
                statement.setObject(i + 1, v)
            rows = statement.executeQuery()
            rows.next()
            return rows.getLong(1)
        finally:
            statement.close()

    def has_table(self, name: str) -> bool:
        found = self.own.getMetaData().getTables(None, None, None, None)
        while found.next():
            if found.getString("TABLE_NAME").lower() == name.lower():
                return True
        return False


def _stage(rows: DataFrame, url: str, table: str, batch: int, options: dict[str, str]) -> None:
    kinds = "run_id VARCHAR(64)"
    rows.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), createTableColumnTypes=kinds, **options).mode("append").save()


def load_once(rows: DataFrame, url: str, table: str, load: str, batch: int = 200, **options: str) -> int | None:
    """Append rows to a table under a load's name; their number, or None where that load is in already.

    Rows may be repeated, and all come in. The target is made if it is not there. ``options`` are the driver's own.
    """
    spark, run = rows.sparkSession, uuid.uuid4().hex
    staging, ledger = f"{table}_staging", f"{table}_loads"
    with _Connection(spark, url, options) as db:
        mark = db.own.getMetaData().getIdentifierQuoteString().strip()  # Spark quotes the columns that it makes
        columns = ", ".join(f"{mark}{c}{mark}" for c in rows.columns)
        run_id, row_no, copy_no = (f"{mark}{c}{mark}" for c in ("run_id", "row_no", "copy_no"))
        if not db.has_table(ledger):
            db.run(f"CREATE TABLE {ledger} (load_id VARCHAR(200) NOT NULL PRIMARY KEY, n BIGINT NOT NULL)")
        if db.number(f"SELECT COUNT(*) FROM {ledger} WHERE load_id = ?", load):
            return None
        if not db.has_table(table):
            rows.limit(0).write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
        # Stored rows are the same each time a task reads them, and so are their numbers.
        held = files.materialize(rows, "load")
        # Spark's own random values are the same when a task is run again; a copy's mark must not be.
        mark_of_copy = F.xxhash64(F.expr("reflect('java.util.UUID', 'randomUUID')"))
        numbered = held.select("*", F.lit(run).alias("run_id"), F.monotonically_increasing_id().alias("row_no"), mark_of_copy.alias("copy_no"))
        counted = Observation()
        new = not db.has_table(staging)
        _stage(numbered.observe(counted, F.count("*").alias("n")), url, staging, batch, options)
        if new:
            db.run(f"CREATE INDEX {staging}_rows ON {staging} ({run_id}, {row_no})")
        wanted = counted.get["n"]
        if (there := db.number(f"SELECT COUNT(DISTINCT {row_no}) FROM {staging} WHERE {run_id} = ?", run)) != wanted:
            raise LoadError(f"{there} rows of {wanted} are in the staging table")
        db.own.setAutoCommit(False)
        try:
            db.run(f"INSERT INTO {ledger} (load_id, n) VALUES (?, ?)", load, wanted)
            one = f"{copy_no} = (SELECT MIN(m.{copy_no}) FROM {staging} m WHERE m.{run_id} = s.{run_id} AND m.{row_no} = s.{row_no})"
            moved = db.run(f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {staging} s WHERE {run_id} = ? AND {one}", run)
            if moved != wanted:
                raise LoadError(f"{moved} rows of {wanted} were moved")
            db.own.commit()
        except Exception:
            db.own.rollback()
            if db.number(f"SELECT COUNT(*) FROM {ledger} WHERE load_id = ?", load):  # another run was first
                return None
            raise
        finally:
            db.run(f"DELETE FROM {staging} WHERE {run_id} = ?", run)
            db.own.commit()
            db.own.setAutoCommit(True)
        return wanted
