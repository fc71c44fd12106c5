"""Survey and benchmark roles over the given tables.

* orders survey: one respondent per order, described by the ordering customer;
* customer base: the population those orders should mirror;
* document survey: labelled documents, against all documents;
* supplier survey: suppliers by country, against customers by country.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.operators.strata import Dimension, cell_counts, key_columns, line_up, population_shares

COUNTRY_SEGMENT = Dimension("Country × Segment", ("country", "segment"), description="Fine-grained match")
REGION_SEGMENT = Dimension(
    "Region × Segment", ("region", "segment"), ("country_to_region",), "Regional match by segment"
)
COUNTRY = Dimension("Country", ("country",), description="Country match")
REGION = Dimension("Region", ("region",), ("country_to_region",), "Regional match")
SEGMENT = Dimension("Segment", ("segment",), description="Segment match")
STANDARD = (COUNTRY_SEGMENT, REGION_SEGMENT, COUNTRY, REGION, SEGMENT)

LANG_SOURCE = Dimension("Language × Source", ("lang", "source"))
LANG = Dimension("Language", ("lang",))
SOURCE = Dimension("Source", ("source",))
DOCUMENT = (LANG_SOURCE, LANG, SOURCE)


class Tables:
    """The given parquet tables and the roles built on them, all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def places(self) -> DataFrame:
        nation, region = self.read("nation"), self.read("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            "n_nationkey", F.col("n_name").alias("country"), F.col("r_name").alias("region")
        )

    @cached_property
    def population(self) -> DataFrame:
        customer = self.read("customer")
        return customer.join(self.places, customer.c_nationkey == F.col("n_nationkey")).select(
            "c_custkey", "country", "region", F.col("c_mktsegment").alias("segment"), "c_acctbal"
        )

    @cached_property
    def survey(self) -> DataFrame:
        orders = self.read("orders")
        return orders.join(self.population, orders.o_custkey == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("respondent"),
            "country",
            "region",
            "segment",
            F.col("o_orderpriority").alias("priority"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_totalprice").alias("price"),
            F.year("o_orderdate").cast("long").alias("wave"),
        )

    @cached_property
    def benchmark(self) -> DataFrame:
        return population_shares(self.population, STANDARD)

    def benchmark_for(self, *dims: Dimension) -> DataFrame:
        return population_shares(self.population, dims)

    def order_cells(self, columns, by=()) -> DataFrame:
        """Cells of the orders survey. Orders are counted per customer before they meet the
        customer table: a customer with very many orders is a few rows in that join."""
        known = {
            "priority": F.col("o_orderpriority"),
            "status": F.col("o_orderstatus"),
            "wave": F.year("o_orderdate").cast("long"),
        }
        orders = self.read("orders").select("o_custkey", *[known[b].alias(b) for b in by])
        counted = orders.groupBy("o_custkey", *by).agg(F.count(F.lit(1)).alias("n"))
        described = counted.join(self.population, F.col("o_custkey") == F.col("c_custkey"))
        return described.groupBy(*by, *columns).agg(F.sum("n").alias("n"))

    def aligned(self, dims, by=(), **options) -> DataFrame:
        return line_up(self.order_cells(key_columns(dims), by), self.benchmark_for(*dims), dims, by, **options)

    @cached_property
    def labelled(self) -> DataFrame:
        documents = self.read("documents").select("doc_id", "lang", "source")
        return self.read("labels").join(documents, "doc_id")

    def document_shares(self, *dims: Dimension) -> DataFrame:
        return population_shares(self.read("documents").select("lang", "source"), dims)

    def document_aligned(self, dims, **options) -> DataFrame:
        cells = cell_counts(self.labelled, key_columns(dims))
        return line_up(cells, self.document_shares(*dims), dims, **options)

    @cached_property
    def supplier_survey(self) -> DataFrame:
        supplier = self.read("supplier")
        return supplier.join(self.places, supplier.s_nationkey == F.col("n_nationkey")).select(
            "s_suppkey", "country", "region"
        )
