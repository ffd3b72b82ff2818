"""Views on the given tables, one SQL text for both engines, and the register of queries with their DuckDB twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
VIEWS: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def expand(text: str, table: Callable[[str], str]) -> str:
    """Replace {name} by a table or, in brackets, by the text of a view."""
    return re.sub(r"\{([a-z_]+)\}", lambda m: table(m[1]) if m[1] in TABLES else f"({expand(VIEWS[m[1]], table)})", text)


#: Bytes of the tables' files for each partition that a shuffle begins with.
SHARE = 8 << 20
#: Methods of more bytes of code than this are not compiled by the JVM; Spark makes small ones instead.
METHOD = 8000


def fit_session(spark: SparkSession, sf_dir: str) -> None:
    """Lets shuffles begin with partitions in proportion to the tables, so that what a task holds of a grouping does not grow with them (adaptive execution joins those that turn out small), and
    Spark make small methods where one would be too long to be compiled. Only raises the first setting and lowers the second."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    size = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(hadoop).getLength()
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if (parts := -(-size // SHARE)) > int(spark.conf.get(name, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(name, parts)
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) > METHOD:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", METHOD)


class Source:
    """The tables of one folder, and the views on them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        fit_session(spark, sf_dir)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        return self.sql("SELECT * FROM {" + name + "} v")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(expand(text, lambda t: f"parquet.`{self.sf_dir}/{t}.parquet`"))


def view(name: str, text: str) -> None:
    VIEWS[name] = text


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a function of a Source under a name, with the DuckDB SQL that gives the same rows."""

    def add(f: Callable[[Source], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Source(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = expand(oracle, lambda t: t)
        return f

    return add


from . import views  # noqa: E402, F401
