"""Eight decision-support queries. Money is in whole units of a hundredth (cents) of each factor, so sums are exact; sums
are decimal(38,0), so that no number of rows overflows them. Empty tables and windows without rows give zeros, and null shares.

Each query takes (spark, sf_dir) and its parameters; the defaults are windows and constants that the supplied data meet.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.functions import predicates as p
from spanwise.operators import aggregates as agg
from spanwise.operators import joins
from spanwise.sources import tables

#: A year is counted as this many days in the revenue forecast query.
YEAR = 365


def day(text: str) -> Column:
    return F.lit(date.fromisoformat(text))


def revenue() -> Column:
    """Price less discount, in units of 1/10000."""
    return F.col("price") * (100 - F.col("disc"))


def pricing_summary(spark: SparkSession, sf_dir: str, until: str = "1998-12-01", days: int = 90) -> DataFrame:
    """Sums and means of items shipped by a day, for each return flag and line status, declared ones without items too."""
    rows = tables.lineitem(spark, sf_dir).filter(F.col("shipdate") <= F.lit(date.fromisoformat(until) - timedelta(days)))
    sums = {
        "sum_qty": agg.total(F.col("qty")), "sum_base": agg.total(F.col("price")), "sum_disc_price": agg.total(revenue()),
        "sum_charge": agg.total(revenue() * (100 + F.col("tax"))), "sum_disc": agg.total(F.col("disc")), "n": F.count("*"),
    }
    flags = {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"]}
    grouped = agg.group_by_domain(rows, flags, sums)
    averages = {f"avg_{x}": F.try_divide(F.col(f"sum_{x}").cast("double"), F.col("n").cast("double")) for x in ("qty", "base", "disc")}
    return grouped.withColumns(averages).drop("domain_order")


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lineitem(spark, sf_dir).filter(p.lt("commitdate", "receiptdate"))


def _quarter(spark: SparkSession, sf_dir: str, since: str, until: str) -> DataFrame:
    return tables.orders(spark, sf_dir).filter(p.all_of(p.gte("orderdate", day(since)), p.lt("orderdate", day(until))))


PRIORITIES = {"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}


def late_orders(spark: SparkSession, sf_dir: str, since: str = "1996-07-01", until: str = "1996-10-01") -> DataFrame:
    """Orders with a late item, by priority."""
    found = joins.exists_join(_quarter(spark, sf_dir, since, until), _late(spark, sf_dir), "o_orderkey", "l_orderkey")
    return agg.group_by_domain(found, PRIORITIES, {"n": F.count("*")}).drop("domain_order")


def late_items(spark: SparkSession, sf_dir: str, since: str = "1996-07-01", until: str = "1996-10-01") -> DataFrame:
    """Late items of the orders, by priority: an order counts once for each."""
    found = joins.key_join(_late(spark, sf_dir), _quarter(spark, sf_dir, since, until), "l_orderkey", "o_orderkey")
    return agg.group_by_domain(found, PRIORITIES, {"n": F.count("*")}).drop("domain_order")


def _forecast(spark: SparkSession, sf_dir: str, since: str, lo: int, hi: int, qty: int) -> DataFrame:
    until = date.fromisoformat(since) + timedelta(YEAR)
    # what the derived columns imply for the stored ones reaches the scan
    stored = p.all_of(p.between("l_discount", F.lit((lo - 1) / 100), F.lit((hi + 1) / 100)), p.lt("l_quantity", F.lit(float(qty))))
    return tables.lineitem(spark, sf_dir).filter(
        p.all_of(stored, p.gte("shipdate", day(since)), p.lt("shipdate", F.lit(until)), p.between("disc", F.lit(lo), F.lit(hi)), p.lt("qty", F.lit(qty)))
    )


def forecast(spark: SparkSession, sf_dir: str, since: str = "1996-01-01", lo: int = 5, hi: int = 7, qty: int = 24) -> DataFrame:
    """What the discounts came to, in units of 1/10000."""
    return _forecast(spark, sf_dir, since, lo, hi, qty).agg(agg.sum_if(F.lit(True), F.col("price") * F.col("disc")).alias("revenue"))


def forecast_net(spark: SparkSession, sf_dir: str, since: str = "1996-01-01", lo: int = 5, hi: int = 7, qty: int = 24) -> DataFrame:
    """What the same items brought in, in whole cents each."""
    return _forecast(spark, sf_dir, since, lo, hi, qty).agg(agg.sum_if(F.lit(True), F.expr("price * (100 - disc) div 100")).alias("revenue"))


def market_share(spark: SparkSession, sf_dir: str, nation: str = "NATION_9", region: str = "AMERICA", kind: str = "ECONOMY") -> DataFrame:
    """A nation's share of its region's revenue from parts of a kind, by order year. The two roles of nation differ."""
    read = lambda name: tables.table(spark, sf_dir, name)
    home, seller = joins.in_role(read("nation"), "c"), joins.in_role(read("nation"), "s")
    facts = joins.star_join(
        tables.lineitem(spark, sf_dir),
        (read("part").filter(F.col("p_type") == kind), "l_partkey", "p_partkey"),
        (tables.orders(spark, sf_dir).filter(p.between("orderdate", day("1995-01-01"), day("1996-12-31"))), "l_orderkey", "o_orderkey"),
        (read("customer"), "o_custkey", "c_custkey"), (home, "c_nationkey", "c_n_nationkey"),
        (read("region").filter(F.col("r_name") == region), "c_n_regionkey", "r_regionkey"),
        (read("supplier"), "l_suppkey", "s_suppkey"), (seller, "s_nationkey", "s_n_nationkey"),
    )
    own = agg.sum_if(F.col("s_n_name") == nation, revenue())
    return facts.groupBy(F.year("orderdate").alias("year")).agg(own.alias("num"), agg.total(revenue()).alias("den")).withColumn("share", agg.ratio(F.col("num"), F.col("den")))


def ship_modes(spark: SparkSession, sf_dir: str, modes: tuple[str, ...] = ("MAIL", "SHIP"), since: str = "1997-01-01") -> DataFrame:
    """Late items by mode, those of urgent and high-priority orders apart."""
    until = date.fromisoformat(since) + timedelta(YEAR)
    rows = tables.lineitem(spark, sf_dir).filter(
        p.all_of(p.in_set("shipmode", modes), p.lt("commitdate", "receiptdate"), p.lt("shipdate", "commitdate"), p.gte("receiptdate", day(since)), p.lt("receiptdate", F.lit(until)))
    )
    urgent = p.in_set("o_orderpriority", ["1-URGENT", "2-HIGH"])
    joined = joins.flagged_join(rows, tables.table(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey", urgent, "urgent")
    return agg.group_by_domain(joined, {"shipmode": list(modes)}, {"high": F.sum(F.col("urgent").cast("long")), "low": F.sum((~F.col("urgent")).cast("long"))}).drop("domain_order")


def promotion(spark: SparkSession, sf_dir: str, since: str = "1996-09-01", until: str = "1996-10-01") -> DataFrame:
    """The share of revenue that parts on promotion have, of items shipped in a window."""
    rows = tables.lineitem(spark, sf_dir).filter(p.all_of(p.gte("shipdate", day(since)), p.lt("shipdate", day(until))))
    joined = joins.flagged_join(rows, tables.table(spark, sf_dir, "part"), "l_partkey", "p_partkey", F.col("p_type").startswith("PROMO"), "promo")
    sums = joined.agg(agg.sum_if(F.col("promo"), revenue()).alias("num"), agg.sum_if(F.lit(True), revenue()).alias("den"))
    return sums.withColumn("share", agg.ratio(F.col("num"), F.col("den")))


def _brand_items(spark: SparkSession, sf_dir: str, brand: str, container: str | None) -> DataFrame:
    chosen = tables.part(spark, sf_dir).filter(F.col("p_brand") == brand)
    if container:
        chosen = chosen.filter(F.col("container") == container)
    return joins.key_join(tables.lineitem(spark, sf_dir), chosen, "l_partkey", "p_partkey")


def small_orders_global(spark: SparkSession, sf_dir: str, brand: str = "Brand#23", container: str | None = "MED BOX") -> DataFrame:
    """Items of a brand and container below a fifth of the mean quantity of all items, cut to a whole number."""
    mean = tables.lineitem(spark, sf_dir).agg(F.expr("sum(qty) div count(qty)").alias("mean"))  # one row
    found = _brand_items(spark, sf_dir, brand, container).crossJoin(F.broadcast(mean)).filter(10 * F.col("qty") < 2 * F.col("mean"))
    return found.agg(agg.sum_if(F.lit(True), F.col("price")).alias("sum_price"), F.count("*").alias("n"))


def small_orders(spark: SparkSession, sf_dir: str, brand: str = "Brand#23", container: str | None = None) -> DataFrame:
    """Items of a brand (and container) below a fifth of their part's mean quantity; exact, without division.

    The join leaves all items of the chosen parts, so only these are summed for the means.
    """
    chosen = _brand_items(spark, sf_dir, brand, container)
    means = chosen.groupBy(F.col("l_partkey").alias("mean_of")).agg(F.sum("qty").alias("total"), F.count("qty").alias("many"))
    found = joins.key_join(chosen, means, "l_partkey", "mean_of").filter(5 * F.col("qty") * F.col("many") < F.col("total"))
    return found.agg(agg.sum_if(F.lit(True), F.col("price")).alias("sum_price"), F.count("*").alias("n"))


#: Brands, container prefix, quantities and largest size of each branch.
BRANCHES = (
    (("Brand#12", "Brand#1", "Brand#2", "Brand#3"), ("SM CASE", "SM BOX", "SM PACK", "SM PKG"), 1, 11, 15),
    (("Brand#23", "Brand#4", "Brand#5", "Brand#6"), ("MED BAG", "MED BOX", "MED PKG", "MED PACK"), 10, 20, 25),
    (("Brand#25", "Brand#7", "Brand#8", "Brand#9"), ("LG CASE", "LG BOX", "LG PACK", "LG PKG"), 20, 30, 35),
)


def discounted(spark: SparkSession, sf_dir: str, branches=BRANCHES) -> DataFrame:
    """Revenue of items that fulfil one of several conditions on both part and item. Common tests run before the join."""
    rows = tables.lineitem(spark, sf_dir).filter(p.all_of(p.in_set("shipmode", ["AIR", "REG AIR"]), F.col("shipinstruct") == "DELIVER IN PERSON"))
    conditions = [
        p.all_of(p.in_set("p_brand", brands), p.in_set("container", containers), p.between("qty", F.lit(lo), F.lit(hi)), p.between("p_size", F.lit(1), F.lit(size)))
        for brands, containers, lo, hi, size in branches
    ]
    found = joins.branches_join(rows, tables.part(spark, sf_dir), "l_partkey", "p_partkey", conditions)
    return found.agg(agg.sum_if(F.lit(True), revenue()).alias("revenue"), F.count("*").alias("n"))
