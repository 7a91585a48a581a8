"""Labelled graphs derived from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.labels import LabelFormat, classify, paired

_LABEL = {"signup": "op_i", "purchase": "cp_i", "click": "ob_i", "view": "cb_i", "error": "normal"}


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw edges, with their user_id, from each event of a user to the next one, labelled by the type of the first and its k modulo 2."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
    following = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    names = F.create_map(*[F.lit(x) for pair in _LABEL.items() for x in pair])
    return events.select(
        F.col("event_id").alias("src"), following.alias("dst"), F.element_at(names, F.col("event_type")).alias("label"),
        F.pmod(F.get_json_object("props", "$.k").cast("long"), F.lit(2)).alias("index"), "user_id",
    ).where("dst is not null")


def event_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of `event_rows`: one chain per user. Edges of a user stay together, as the window left them."""
    return _graph(event_rows(spark, sf_dir))


def _graph(raw: DataFrame) -> DataFrame:
    """Edges of raw rows dealt by user_id, without another shuffle; there are at most four labels, two indices of two families."""
    return paired(classify(raw, LabelFormat(), "user_id").drop("user_id"), few=True)


def woven_graph(spark: SparkSession, sf_dir: str, length: int = 8) -> DataFrame:
    """Branching pieces of `length` events of a user in order of time: edges to the next event, labelled by either end, and to the next but one, labelled by the event between.

    Labels are made as in `event_rows`. There are many ways between two events,
    so the methods differ, but no cycles, so that SQL can list every walk.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
    names = F.create_map(*[F.lit(x) for pair in _LABEL.items() for x in pair])
    mark = F.struct(F.element_at(names, F.col("event_type")).alias("label"), F.pmod(F.get_json_object("props", "$.k").cast("long"), F.lit(2)).alias("index"))
    ordered = Window.partitionBy("user_id").orderBy("ts", "event_id")
    placed = events.select("event_id", "user_id", mark.alias("mark"), F.row_number().over(ordered).alias("n")).withColumn("piece", F.floor((F.col("n") - 1) / length))
    along = Window.partitionBy("user_id", "piece").orderBy("n")
    ahead = placed.select("event_id", "user_id", "mark", *[F.lead(c, k).over(along).alias(f"{c}_{k}") for k in (1, 2) for c in ("event_id", "mark")])
    edge = lambda dst, of: F.struct(F.col("event_id").alias("src"), F.col(dst).alias("dst"), F.col(of).alias("mark"))
    edges = ahead.select("user_id", F.explode(F.array(edge("event_id_1", "mark"), edge("event_id_1", "mark_1"), edge("event_id_2", "mark_1"))).alias("e")).where("e.dst is not null")
    return _graph(edges.select("user_id", "e.src", "e.dst", "e.mark.label", "e.mark.index"))


def nation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from each customer nation to the supplier nation it buys most from, and from each supplier nation to the customer nation it sells most to.

    The first are opening brackets, the second closing ones, both labelled by
    the parity of the nation's region; equal amounts go to the smaller key.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    customers = read("customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("buyer"))
    suppliers = read("supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("seller"))
    lines = read("lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = read("orders").select("o_orderkey", "o_custkey")
    sales = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    sums = sales.groupBy("buyer", "seller").agg(F.sum("l_quantity").alias("amount"))
    regions = read("nation").select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") % 2).cast("long").alias("label"))

    def main(of: str, other: str, side: str) -> DataFrame:
        best = F.max_by(F.col(other), F.struct("amount", -F.col(other)))
        return sums.groupBy(F.col(of).alias("src")).agg(best.alias("dst")).join(regions, "src").select("src", "dst", F.lit("b").alias("family"), F.lit(side).alias("side"), "label")

    return main("buyer", "seller", "o").union(main("seller", "buyer", "c"))


def trade_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (even numbers) and suppliers (odd ones): an edge to the supplier of each seventh line that came back by choice (A), and from that of one that had to (R).

    It grows with lineitem, branches and has cycles of any length.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber = 7 and l_returnflag in ('A', 'R')").select("l_orderkey", "l_suppkey", "l_returnflag")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    buyer, seller = F.col("o_custkey").cast("long") * 2, F.col("l_suppkey").cast("long") * 2 + 1
    ends = F.when(F.col("l_returnflag") == "A", F.struct(buyer.alias("src"), seller.alias("dst"))).otherwise(F.struct(seller.alias("src"), buyer.alias("dst")))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(ends.alias("e")).select("e.*").distinct()
