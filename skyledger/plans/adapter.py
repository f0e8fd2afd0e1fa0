"""The climate tables, made from the given order, customer and event tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators.panel import base_panel
from skyledger.session import materialize, tune

# The zones of the given tables.
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def dyadic(key: str, factor: int, modulus: int, base: float, step: float) -> Column:
    """A coordinate by integer arithmetic, exact in binary."""
    return F.lit(base) + F.pmod(F.col(key) * F.lit(factor), F.lit(modulus)).cast("double") / F.lit(step)


def cents(c: str) -> Column:
    """A two-decimal number as a whole number of hundredths; sums of it are exact."""
    return F.rint(F.col(c) * F.lit(100.0)).cast("long")


def exact_sum(c: str) -> Column:
    return F.sum(cents(c)).cast("double") / F.lit(100.0)


@dataclass(frozen=True)
class Tables:
    """Climate tables over one folder of Parquet files."""

    spark: SparkSession
    folder: str

    def __post_init__(self) -> None:
        tune(self.spark)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def raw_panel(self) -> DataFrame:
        """Supplier by month: line items are summed per supplier and month before any join."""
        monthly = (
            self.read("lineitem")
            .groupBy("l_suppkey", F.trunc("l_shipdate", "month").alias("date"))
            .agg(
                F.sum("l_quantity").alias("q"),
                exact_sum("l_extendedprice").alias("p"),
                exact_sum("l_discount").alias("d"),
                F.max("l_discount").alias("dmax"),
                exact_sum("l_tax").alias("x"),
                F.count("*").cast("double").alias("n"),
            )
        )
        return (
            monthly.join(self.read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_suppkey").cast("string").alias("city"),
                F.col("r_name").alias("climate_zone"),
                dyadic("s_suppkey", 7, 232, 8.0, 8.0).alias("latitude"),
                dyadic("s_suppkey", 13, 232, 68.0, 8.0).alias("longitude"),
                "date",
                (F.col("p") / F.col("n") / F.lit(1500.0) + F.lit(273.15)).alias("t2m"),
                (F.col("q") / F.lit(4000.0)).alias("tp"),
                (F.col("d") / F.col("n") * F.lit(4.0)).alias("swvl1"),
                (F.col("dmax") * F.lit(4.0)).alias("swvl2"),
                (-(F.col("x") / F.col("n")) / F.lit(40.0)).alias("evabs"),
                (F.col("d") / F.lit(50.0)).alias("sro"),
            )
        )

    @cached_property
    def panel(self) -> DataFrame:
        """The monthly panel, stored: every feature query reads it several times."""
        return materialize(base_panel(materialize(self.raw_panel, "raw-panel")), "panel")

    @property
    def districts(self) -> DataFrame:
        return (
            self.read("customer")
            .join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_custkey").alias("district_id"),
                F.col("c_name").alias("district_name"),
                F.col("n_name").alias("state"),
                dyadic("c_custkey", 11, 467, 8.0, 16.0).alias("latitude"),
                dyadic("c_custkey", 17, 463, 68.0, 16.0).alias("longitude"),
            )
        )

    @property
    def observations(self) -> DataFrame:
        humidity = F.get_json_object("props", "$.k").cast("double")
        return self.read("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("district_id"),
            (F.col("value") * humidity / F.lit(100.0)).alias("rainfall"),
            F.col("value").alias("temperature"),
            humidity.alias("humidity"),
            F.col("ts").cast("date").alias("observation_date"),
        )

    @property
    def forecasts(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("district_id"),
            (F.col("o_totalprice") / F.lit(1000.0)).alias("predicted_rainfall"),
            (F.col("o_totalprice") / F.lit(10000.0)).alias("predicted_temperature"),
            F.col("o_orderdate").cast("date").alias("forecast_date"),
        )

    @property
    def customer_history(self) -> DataFrame:
        """Customer by month, with many months missing."""
        return (
            self.read("orders")
            .groupBy(
                F.col("o_custkey").cast("string").alias("city"),
                F.year("o_orderdate").alias("year"),
                F.month("o_orderdate").alias("month"),
            )
            .agg((exact_sum("o_totalprice") / F.count("*").cast("double") / F.lit(10000.0)).alias("temperature_c"))
        )

    @property
    def grid(self) -> DataFrame:
        """A lattice of customer nation by supplier nation, per month."""
        lines = (
            self.read("lineitem")
            .join(self.read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("o_custkey", "l_suppkey", F.trunc("l_shipdate", "month").alias("valid_time"))
            .agg(
                F.sum("l_quantity").alias("q"),
                F.sum(cents("l_extendedprice")).alias("p"),
                F.count("*").alias("n"),
            )
        )
        return (
            lines.join(self.read("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.read("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy("c_nationkey", "s_nationkey", "valid_time")
            .agg(F.sum("q").alias("q"), (F.sum("p").cast("double") / F.lit(100.0)).alias("p"), F.sum("n").cast("double").alias("n"))
            .select(
                (F.lit(8.0) + F.col("c_nationkey")).alias("latitude"),
                (F.lit(68.0) + F.col("s_nationkey")).alias("longitude"),
                "valid_time",
                (F.col("p") / F.col("n") / F.lit(1500.0) + F.lit(273.15)).alias("t2m"),
                (F.col("q") / F.lit(4000.0)).alias("tp"),
                (F.col("n") / F.lit(100.0)).alias("swvl1"),
                (F.col("n") / F.lit(200.0)).alias("swvl2"),
                (-F.col("n") / F.lit(10000.0)).alias("evabs"),
                (F.col("q") / F.lit(100000.0)).alias("sro"),
            )
        )

    @property
    def locations(self) -> DataFrame:
        """Suppliers as named places."""
        return (
            self.read("supplier")
            .join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_suppkey").cast("string").alias("city"),
                F.col("r_name").alias("climate_zone"),
                dyadic("s_suppkey", 7, 232, 8.0, 8.0).alias("latitude"),
                dyadic("s_suppkey", 13, 232, 68.0, 8.0).alias("longitude"),
            )
        )

    @property
    def payloads(self) -> DataFrame:
        """One weather payload per order, with up to seven days, as JSON text.

        The arrays are filled slot by slot in one aggregation, so an order with very many
        lines is still seven slots, and a task holds one row an order, not one a line.
        """
        def slots(value: Column) -> Column:
            return F.array(*[F.max(F.when(F.col("l_linenumber") == i, value)) for i in range(1, 8)])

        daily = F.struct(
            slots(F.col("l_shipdate").cast("date")).cast("array<string>").alias("time"),
            slots(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))).alias("rain_sum"),
            slots(F.when(F.col("l_linestatus") == "O", F.col("l_tax") * F.lit(500.0))).alias("temperature_2m_max"),
            slots(F.when(F.col("l_returnflag") != "N", F.col("l_discount") * F.lit(1000.0))).alias("relative_humidity_2m_mean"),
        )
        per_order = self.read("lineitem").groupBy("l_orderkey").agg(daily.alias("daily"))
        return per_order.join(
            self.read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
        ).select(
            F.col("l_orderkey").alias("payload_id"),
            F.col("o_custkey").alias("district_id"),
            F.to_json(F.struct("daily"), {"ignoreNullFields": "false"}).alias("payload"),
        )

    @property
    def import_rows(self) -> DataFrame:
        """Events as import text, some broken on purpose, in event order."""
        kind = F.pmod(F.col("event_id"), F.lit(17))
        day = F.col("ts").cast("date")
        formats = ("yyyy-MM-dd", "dd-MM-yyyy", "yyyy/MM/dd", "dd/MM/yyyy")
        text = F
        for i, f in enumerate(formats):
            text = text.when(F.pmod(F.col("event_id"), F.lit(4)) == i, F.date_format(day, f))
        return self.read("events").select(
            F.col("event_id").alias("row"),
            F.when(kind == 1, F.lit(""))
            .when(kind == 2, F.lit("abc"))
            .when(kind == 3, (F.col("user_id") + F.lit(100_000_000)).cast("string"))
            .otherwise(F.col("user_id").cast("string"))
            .alias("district_id"),
            F.when(kind == 4, F.lit("")).otherwise(F.col("value").cast("decimal(18,2)").cast("string")).alias("rainfall"),
            F.when(kind == 5, F.lit("hot"))
            .otherwise(F.col("value").cast("decimal(18,2)").cast("string"))
            .alias("temperature"),
            F.when(kind == 6, F.lit("140")).otherwise(F.get_json_object("props", "$.k")).alias("humidity"),
            F.when(kind == 7, F.lit("31.12.2024")).otherwise(text).alias("observation_date"),
        )

    @property
    def store(self) -> DataFrame:
        """Keys that are stored already: the days on which a user signed up."""
        return (
            self.read("events")
            .filter(F.col("event_type") == "signup")
            .select(F.col("user_id").alias("district_id"), F.col("ts").cast("date").alias("observation_date"))
            .distinct()
        )

    @property
    def live_payloads(self) -> DataFrame:
        """Current conditions as JSON text, one payload per pending order; some lack a temperature."""
        price = F.col("o_totalprice")
        current = F.struct(
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm").alias("time"),
            F.when(F.col("o_orderpriority") != "1-URGENT", price / F.lit(10000.0)).alias("temperature_2m"),
            (price / F.lit(5000.0)).alias("rain"),
            F.when(F.col("o_orderpriority") != "5-LOW", price / F.lit(6000.0)).alias("relative_humidity_2m"),
            (price / F.lit(1000000.0)).alias("soil_moisture_0_to_7cm"),
        )
        return (
            self.read("orders")
            .filter(F.col("o_orderstatus") == "P")
            .select(
                F.col("o_orderkey").alias("payload_id"),
                F.col("o_custkey").alias("district_id"),
                F.to_json(F.struct(current.alias("current"))).alias("payload"),
            )
        )
