"""The order data model derived from a generic retail schema.

``orders``/``lineitem``/``part`` become orders, basket lines and products; the
rules are those of FIXTURES.md.  Users and orders that own too many rows for one
task are found first and numbered by cells (see ``operators.ranking``); without
any, the plan is one window per key.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from basketlens.operators.blocks import blocks_for
from basketlens.operators.ranking import (
    HOT_ROWS,
    cell_offsets,
    hot_keys,
    ordinal_by_cells,
    split_hot,
)
from basketlens.session import durable
from basketlens.sources.tables import ShopTables

GAP_CAP_DAYS = 30

# Basket lines that one task numbers.  Compressed shuffle bytes say little about the
# memory that sorting them takes, so the count of partitions follows the rows.
TASK_LINES = 250_000


class RetailTables:
    def __init__(self, spark: SparkSession, directory: str, hot_rows: int = HOT_ROWS):
        self.spark = spark
        self.directory = directory.rstrip("/")
        self.hot_rows = hot_rows

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    # -- orders -----------------------------------------------------------

    @cached_property
    def placed(self) -> DataFrame:
        """Orders without anything that depends on the user's other orders."""
        return self._read("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("user_id"),
            F.to_date("o_orderdate").alias("ordered_on"),
            (F.dayofweek("o_orderdate") - 1).alias("order_dow"),
            (F.col("o_orderkey") % 24).cast("int").alias("order_hour_of_day"),
        )

    @cached_property
    def _hot_users(self) -> DataFrame | None:
        return hot_keys(self.placed, ["user_id"], self.hot_rows)

    @cached_property
    def sequenced(self) -> DataFrame:
        """Orders with their place in the user's history."""
        if self._hot_users is None:
            return self._sequence_by_user(self.placed)
        cold, hot = split_hot(self.placed, "user_id", self._hot_users)
        return self._sequence_by_user(cold).unionByName(self._sequence_by_cell(hot))

    def _sequence_by_user(self, placed: DataFrame) -> DataFrame:
        history = Window.partitionBy("user_id").orderBy("ordered_on", "order_id")
        return placed.select(
            "*",
            F.row_number().over(history).alias("order_number"),
            F.lag("ordered_on").over(history).alias("previous_on"),
            F.lead("order_id").over(history).isNull().alias("is_last"),
        )

    def _sequence_by_cell(self, placed: DataFrame) -> DataFrame:
        """Days inside a user, blocks of order ids inside a day.

        Ids are unique integers, so a block of ``hot_rows`` ids holds no more
        than that many rows whatever the skew.
        """
        blocks = placed.withColumn("_block", F.expr(f"order_id div {self.hot_rows}"))
        days = placed.groupBy("user_id", "ordered_on").agg(F.count(F.lit(1)).alias("_day_rows"))
        by_day = Window.partitionBy("user_id").orderBy("ordered_on")
        upto = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = by_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        days = days.select(
            "user_id",
            "ordered_on",
            (F.sum("_day_rows").over(upto) - F.col("_day_rows")).alias("_day_before"),
            F.lag("ordered_on").over(by_day).alias("_previous_day"),
            F.sum("_day_rows").over(whole).alias("_user_rows"),
        )
        cells = cell_offsets(blocks, ["user_id"], ["ordered_on", "_block"]).join(
            days, ["user_id", "ordered_on"]
        )
        inside = Window.partitionBy("user_id", "ordered_on", "_block").orderBy("order_id")
        numbered = blocks.join(cells, ["user_id", "ordered_on", "_block"]).withColumn(
            "_number", F.row_number().over(inside) + F.col("_before")
        )
        opens_day = F.col("_number") == F.col("_day_before") + 1
        return numbered.select(
            *placed.columns,
            F.col("_number").cast("int").alias("order_number"),
            F.when(opens_day, F.col("_previous_day"))
            .otherwise(F.col("ordered_on"))
            .alias("previous_on"),
            (F.col("_number") == F.col("_user_rows")).alias("is_last"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        gap = F.datediff("ordered_on", "previous_on")
        return self.sequenced.select(
            "order_id",
            "user_id",
            F.when(F.col("is_last"), F.lit("train")).otherwise(F.lit("prior")).alias("eval_set"),
            "order_number",
            "order_dow",
            "order_hour_of_day",
            # least() skips a missing argument, so the gap is guarded
            F.when(gap.isNotNull(), F.least(gap, F.lit(GAP_CAP_DAYS)))
            .cast("double")
            .alias("days_since_prior_order"),
        )

    # -- basket lines -------------------------------------------------------

    @cached_property
    def _placed_lines(self) -> DataFrame:
        """Basket lines with their place in the basket and their order's in the
        user's history."""
        raw = self._read("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_linenumber").alias("_line"),
        )
        hot_orders = hot_keys(raw, ["order_id"], self.hot_rows)
        history = self.sequenced.select("order_id", "user_id", "order_number", "is_last")
        parts = blocks_for(raw.count(), TASK_LINES)

        def baskets(rows: DataFrame) -> DataFrame:
            return rows.groupBy("order_id", "product_id").agg(F.min("_line").alias("_line"))

        place = Window.partitionBy("order_id").orderBy("_line", "product_id")
        if hot_orders is None:
            # one shuffle by order serves the grouping, the window and the join
            numbered = baskets(raw.repartition(parts, "order_id")).withColumn(
                "add_to_cart_order", F.row_number().over(place)
            )
        else:
            cold, hot = split_hot(raw, "order_id", hot_orders)
            blocks = (
                baskets(hot)
                .withColumn("_lines", F.expr(f"_line div {self.hot_rows}"))
                .withColumn("_products", F.expr(f"product_id div {self.hot_rows}"))
            )
            by_cells = ordinal_by_cells(
                blocks,
                ["order_id"],
                ["_lines", "_line", "_products"],
                ["_line", "product_id"],
                "add_to_cart_order",
            ).drop("_lines", "_products")
            numbered = (
                baskets(cold.repartition(parts, "order_id"))
                .withColumn("add_to_cart_order", F.row_number().over(place).cast("long"))
                .unionByName(by_cells)
            )
        return numbered.join(history, "order_id").withColumn(
            "add_to_cart_order", F.col("add_to_cart_order").cast("int")
        )

    @cached_property
    def lines(self) -> DataFrame:
        """All basket lines, with the set their order belongs to."""
        return self._mark_reordered(self._placed_lines).select(
            "order_id",
            "product_id",
            "add_to_cart_order",
            (F.col("order_number") > F.col("_first")).cast("int").alias("reordered"),
            F.col("is_last"),
        )

    def _mark_reordered(self, lines: DataFrame) -> DataFrame:
        """Add the number of the user's first order that held the product.

        A product occurs once per order, so a (user, product) pair can only be
        large when the user's order count is.
        """
        pair = ["user_id", "product_id"]
        first = F.min("order_number").over(Window.partitionBy(*pair)).alias("_first")
        if self._hot_users is None:
            return lines.select("*", first)
        # several branches follow; the joins and numbering above run once
        cold, hot = split_hot(durable(lines), "user_id", self._hot_users)
        pairs = hot.groupBy(*pair).agg(
            F.min("order_number").alias("_first"), F.count(F.lit(1)).alias("_rows")
        )
        # at most lines / hot_rows pairs are this large; written, so that their size
        # decides how they are joined
        large = durable(pairs.where(F.col("_rows") > self.hot_rows).drop("_rows"))
        small = pairs.where(F.col("_rows") <= self.hot_rows).drop("_rows")
        ordinary = hot.join(large, pair, "left_anti").join(small, pair)
        return (
            cold.select("*", first)
            .unionByName(ordinary)
            .unionByName(hot.join(large, pair))
        )

    @cached_property
    def order_products_train(self) -> DataFrame:
        """Lines of last orders.

        A (user, product) pair's first and last order are one grouping with partial
        sums; the window over all lines is not needed.  A user has one last order and a
        product one line in it, so the values of that line need no sorted struct.
        """
        last = {
            f"_{c}": F.max(F.when(F.col("is_last"), F.col(c)))
            for c in ("order_number", "order_id", "add_to_cart_order")
        }
        ends = self._placed_lines.groupBy("user_id", "product_id").agg(
            F.min("order_number").alias("_first"), *[v.alias(c) for c, v in last.items()]
        )
        return ends.where("_order_number IS NOT NULL").select(
            F.col("_order_id").alias("order_id"),
            "product_id",
            F.col("_add_to_cart_order").alias("add_to_cart_order"),
            (F.col("_order_number") > F.col("_first")).cast("int").alias("reordered"),
        )

    @cached_property
    def order_products_prior(self) -> DataFrame:
        return self.lines.where("NOT is_last").drop("is_last")

    # -- dimensions ---------------------------------------------------------

    def _names(self, column: str) -> DataFrame:
        """The sorted brand or type list as one array (a few dozen names)."""
        return self._read("part").agg(F.array_sort(F.collect_set(column)).alias("names"))

    def _numbered(self, column: str, key: str, out: str) -> DataFrame:
        listed = self._names(column).select(F.posexplode("names").alias("_at", out))
        return listed.select((F.col("_at") + 1).cast("int").alias(key), out)

    @cached_property
    def aisles(self) -> DataFrame:
        return self._numbered("p_brand", "aisle_id", "aisle")

    @cached_property
    def departments(self) -> DataFrame:
        return self._numbered("p_type", "department_id", "department")

    @cached_property
    def products(self) -> DataFrame:
        """Names become ids by their place in the list, so nothing is joined."""
        return (
            self._read("part")
            .withColumn("_brands", self._names("p_brand").scalar())
            .withColumn("_types", self._names("p_type").scalar())
            .select(
                F.col("p_partkey").alias("product_id"),
                F.col("p_name").alias("product_name"),
                F.array_position("_brands", F.col("p_brand")).cast("int").alias("aisle_id"),
                F.array_position("_types", F.col("p_type")).cast("int").alias("department_id"),
            )
        )

    def tables(self) -> ShopTables:
        """All six tables; the lines behind two of them are worked out once."""
        lines = durable(self.lines)
        return ShopTables(
            orders=self.orders,
            products=self.products,
            aisles=self.aisles,
            departments=self.departments,
            order_products_prior=lines.where("NOT is_last").drop("is_last"),
            order_products_train=lines.where("is_last").drop("is_last"),
        )
