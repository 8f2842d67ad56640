"""The evidence edges as one view, and the tables of a request read at one snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CERTAINTY

TABLES = ("edges", "capabilities", "components", "employees", "dependencies", "ceilings", "units")
#: Memberships that count: applied without review, or approved in one.
COUNTED = ("auto_applied", "human_approved")


def evidence_edges(items: DataFrame, units: DataFrame, memberships: DataFrame, descendants: DataFrame) -> DataFrame:
    """The columns of items with unit, capability and the weaker of the two certainties: who showed what in which work.

    items (item_id, employee_id, eligible, certainty, ...), units (item_id, unit),
    memberships (item_id, node, certainty, review_state), descendants (ancestor,
    node): the closure below each capability. Items without an employee or not
    eligible give no edge, nor do memberships that wait for review or were
    rejected. The employees who left do.
    """
    rank = lambda c: F.array_position(F.array(*map(F.lit, CERTAINTY)), c)
    mine = items.where("employee_id IS NOT NULL AND eligible")
    linked = memberships.where(F.col("review_state").isin(*COUNTED)).select("item_id", "node", F.col("certainty").alias("_linked"))
    below = descendants.select("node", F.col("ancestor").alias("capability"))
    found = mine.join(units.select("item_id", "unit"), "item_id").join(linked, "item_id").join(below, "node").drop("node")
    weaker = F.greatest(rank(F.col("certainty")), rank(F.col("_linked"))).cast("int")
    return found.withColumn("certainty", F.element_at(F.array(*map(F.lit, CERTAINTY)), weaker)).drop("_linked", "eligible")


@dataclass(frozen=True)
class World:
    """What every answer of a request is computed from."""

    edges: DataFrame
    capabilities: DataFrame
    components: DataFrame
    employees: DataFrame
    dependencies: DataFrame
    ceilings: DataFrame
    units: DataFrame

    def coverage_set(self) -> DataFrame:
        """Active people; no service accounts."""
        return self.employees.where("status = 'active' AND NOT is_service_account").select("employee_id")


def _listing(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """(path, length, time) of all files of the tables."""
    found = []
    for name in TABLES:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def load_world(spark: SparkSession, folder: str, tries: int = 5) -> World:
    """The TABLES below folder, Parquet, of one moment: a table lists its files once, and if any file of any table changed
    while they were listed all are listed again. RuntimeError if they never hold still."""
    for _ in range(tries):
        before = _listing(spark, folder)
        world = World(**{name: spark.read.parquet(f"{folder}/{name}") for name in TABLES})
        if _listing(spark, folder) == before:
            return world
    raise RuntimeError(f"the tables below {folder} keep changing")
