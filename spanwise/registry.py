"""Named queries over the supplied tables, and the same as SQL.

Every entry shows one operator. SQL is written on its own, from the definitions and not from the DataFrame code. Operators
return sums as decimal(38,0); queries return them as longs, as their SQL does.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.functions import predicates as p
from spanwise.functions import values
from spanwise.operators import aggregates as agg
from spanwise.operators import bandjoin, blocking, joins, workload
from spanwise.plans import cost, experiments
from spanwise.session import session_dir
from spanwise.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: lineitem, part, orders and events with the columns that the queries derive.
LI = """li AS (SELECT *, CAST(l_shipdate AS DATE) AS shipdate,
 CAST(l_shipdate AS DATE) + CAST((l_orderkey*7+l_linenumber*3) % 61 - 30 AS INTEGER) AS commitdate,
 CAST(l_shipdate AS DATE) + CAST(1 + (l_orderkey*5+l_linenumber) % 30 AS INTEGER) AS receiptdate,
 ['REG AIR','AIR','RAIL','TRUCK','MAIL','FOB','SHIP'][CAST((l_orderkey+l_linenumber) % 7 AS INTEGER)+1] AS shipmode,
 ['DELIVER IN PERSON','COLLECT COD','NONE','TAKE BACK RETURN'][CAST((l_partkey+l_linenumber) % 4 AS INTEGER)+1] AS shipinstruct,
 CAST(round(l_extendedprice*100) AS BIGINT) AS price, CAST(round(l_discount*100) AS BIGINT) AS disc,
 CAST(round(l_tax*100) AS BIGINT) AS tax, CAST(trunc(l_quantity) AS BIGINT) AS qty FROM lineitem)"""
PA = """pa AS (SELECT *, ['SM','LG','MED','JUMBO','WRAP'][CAST(p_partkey % 5 AS INTEGER)+1] || ' ' ||
 ['CASE','BOX','BAG','JAR','PKG','PACK','CAN','DRUM'][CAST((p_partkey // 5) % 8 AS INTEGER)+1] AS container FROM part)"""
EV = """ev AS (SELECT *, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, event_id % 100 + 1 AS payload FROM events)"""


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def in_longs(df: DataFrame) -> DataFrame:
    """df with whole-number decimals as longs."""
    wide = {c for c, kind in df.dtypes if kind == "decimal(38,0)"}
    return df.select(*(F.col(f"`{c}`").cast("long").alias(c) if c in wide else F.col(f"`{c}`") for c in df.columns)) if wide else df


# Predicates: the keys of the rows that pass.


def _predicate(name: str, make, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tables.lineitem(spark, sf_dir).filter(make()).select("l_orderkey", "l_linenumber")

    QUERIES[name] = run
    ORACLES[name] = f"WITH {LI} SELECT l_orderkey, l_linenumber FROM li WHERE {sql}"


_predicate("p_lt", lambda: p.lt("qty", F.lit(24)), "qty < 24")
_predicate("p_gt", lambda: p.gt("qty", F.lit(24)), "qty > 24")
_predicate("p_lte", lambda: p.lte("qty", F.lit(24)), "qty <= 24")
_predicate("p_gte", lambda: p.gte("qty", F.lit(24)), "qty >= 24")
_predicate("p_eq", lambda: p.eq("l_returnflag", F.lit("R")), "l_returnflag = 'R'")
_predicate("p_between", lambda: p.between("disc", F.lit(5), F.lit(7)), "disc BETWEEN 5 AND 7")
_predicate("p_in", lambda: p.in_set("shipmode", ["MAIL", "SHIP", "MAIL"]), "shipmode IN ('MAIL', 'SHIP')")
_predicate("p_in_empty", lambda: p.in_set("shipmode", []), "1 = 0")
_predicate("p_and", lambda: p.all_of(p.lt("qty", F.lit(24)), p.eq("l_returnflag", F.lit("R"))), "qty < 24 AND l_returnflag = 'R'")
_predicate("p_or", lambda: p.any_of(p.eq("l_returnflag", F.lit("R")), p.lt("qty", F.lit(5))), "l_returnflag = 'R' OR qty < 5")
_predicate("p_not", lambda: p.negated(p.eq("l_returnflag", F.lit("R"))), "NOT l_returnflag = 'R'")
_predicate("p_colcmp", lambda: p.lt("commitdate", "receiptdate"), "commitdate < receiptdate")
_predicate(
    "p_band", lambda: p.band(F.unix_date("shipdate"), F.unix_date("commitdate"), 16), "abs(date_diff('day', shipdate, commitdate)) <= 16"
)


# Projections.


def _projection(name: str, columns: dict, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tables.lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", *(make().alias(k) for k, make in columns.items()))

    QUERIES[name] = run
    ORACLES[name] = f"WITH {LI} SELECT l_orderkey, l_linenumber, {sql} FROM li"


_projection("x_charge_intdiv", {"charge": lambda: F.expr("price * (100 - disc) div 100")}, "price * (100 - disc) // 100 AS charge")
_projection("x_disc_price", {"disc_price": workload.revenue, "charge": lambda: workload.revenue() * (100 + F.col("tax"))}, "price * (100 - disc) AS disc_price, price * (100 - disc) * (100 + tax) AS charge")
_projection("x_case_when", {"v": lambda: F.when(F.col("disc") >= 5, F.col("price")).otherwise(0)}, "CASE WHEN disc >= 5 THEN price ELSE 0 END AS v")
_projection("x_arithmetic", {"a": lambda: -F.col("qty") + 7, "b": lambda: F.col("price") - F.col("qty") * 3}, "-qty + 7 AS a, price - qty * 3 AS b")
_projection(
    "x_days_since_2000", {"days": lambda: values.days_since_2000(F.col("shipdate")).cast("long"), "back": lambda: values.from_days_2000(values.days_since_2000(F.col("shipdate")))},
    "CAST(date_diff('day', DATE '2000-01-01', shipdate) AS BIGINT) AS days, shipdate AS back",
)


# Aggregates.


def _li(spark, sf_dir):
    return tables.lineitem(spark, sf_dir)


@query(f"WITH {LI} SELECT count(*) AS n FROM li WHERE qty < 24")
def a_count(spark, sf_dir):
    return _li(spark, sf_dir).agg(agg.count_if(p.lt("qty", F.lit(24))).alias("n"))


@query(f"WITH {LI} SELECT CAST(sum(price) AS BIGINT) AS total FROM li WHERE qty < 24")
def a_sum(spark, sf_dir):
    return _li(spark, sf_dir).filter(p.lt("qty", F.lit(24))).agg(agg.total(F.col("price")).alias("total"))


@query(
    f"WITH {LI} SELECT l_returnflag, CAST(sum(qty) AS BIGINT) AS sum_qty, count(qty) AS count_qty, CAST(sum(qty) AS DOUBLE) / count(qty) AS avg_qty FROM li "
    f"GROUP BY 1"
)
def a_avg_parts(spark, sf_dir):
    return _li(spark, sf_dir).groupBy("l_returnflag").agg(*agg.average_parts("qty", F.col("qty")))


@query(
    f"WITH {LI} SELECT d.f AS l_returnflag, count(l.l_orderkey) AS n FROM (VALUES ('A'), ('N'), ('R'), ('Z')) d(f) LEFT JOIN li l ON l.l_returnflag = d.f "
    f"GROUP BY 1"
)
def a_group1(spark, sf_dir):
    return agg.group_by_domain(_li(spark, sf_dir), {"l_returnflag": ["A", "N", "R", "Z"]}, {"n": F.count("*")}).drop("domain_order")


@query(
    f"WITH {LI}, d AS (SELECT a.k * 3 + b.k AS domain_order, a.f AS l_returnflag, b.s AS l_linestatus "
    f"FROM (VALUES (0,'A'),(1,'N'),(2,'R')) a(k,f), (VALUES (0,'F'),(1,'O'),(2,'X')) b(k,s)) "
    "SELECT CAST(d.domain_order AS BIGINT) AS domain_order, d.l_returnflag, d.l_linestatus, count(l.l_orderkey) AS n, "
    "CAST(coalesce(sum(l.qty), 0) AS BIGINT) AS total "
    "FROM d LEFT JOIN li l ON l.l_returnflag = d.l_returnflag AND l.l_linestatus = d.l_linestatus GROUP BY 1, 2, 3"
)
def a_group2_domain(spark, sf_dir):
    return agg.group_by_domain(_li(spark, sf_dir), {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O", "X"]}, {"n": F.count("*"), "total": F.sum("qty")})


@query(
    f"WITH {LI} SELECT CAST(sum(CASE WHEN disc >= 5 THEN price ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN disc < 5 THEN price ELSE 0 "
    f"END) AS BIGINT) AS low FROM li"
)
def a_cond_sum(spark, sf_dir):
    return _li(spark, sf_dir).agg(agg.sum_if(F.col("disc") >= 5, F.col("price")).alias("high"), agg.sum_if(F.col("disc") < 5, F.col("price")).alias("low"))


@query(
    f"WITH {LI} SELECT num, den, CAST(num AS DOUBLE) / den AS share FROM (SELECT CAST(sum(CASE WHEN disc >= 5 THEN price ELSE 0 END) AS BIGINT) AS num, "
    f"CAST(sum(price) AS BIGINT) AS den FROM li)"
)
def a_ratio(spark, sf_dir):
    sums = _li(spark, sf_dir).agg(agg.sum_if(F.col("disc") >= 5, F.col("price")).alias("num"), agg.total(F.col("price")).alias("den"))
    return sums.withColumn("share", agg.ratio(F.col("num"), F.col("den")))


@query(f"WITH {LI} SELECT count(*) AS n FROM li WHERE 10 * qty < 2 * (SELECT sum(qty) // count(qty) FROM li)")
def a_scalar_subquery(spark, sf_dir):
    li = _li(spark, sf_dir)
    return li.crossJoin(F.broadcast(li.agg(F.expr("sum(qty) div count(qty)").alias("mean")))).filter("10 * qty < 2 * mean").agg(F.count("*").alias("n"))


@query(f"WITH {LI} SELECT l_returnflag, quantile_cont(price, 0.5) AS mid, quantile_cont(price, 0.95) AS high, max(price) AS most FROM li GROUP BY 1")
def a_percentile(spark, sf_dir):
    li = _li(spark, sf_dir)
    counted = li.groupBy("l_returnflag", "price").agg(F.count("*").alias("n"))
    middle = agg.percentiles(counted, "l_returnflag", "price", {"mid": 0.5, "high": 0.95}, width=1 << 16)
    return middle.join(li.groupBy("l_returnflag").agg(F.max("price").alias("most")), "l_returnflag")


# Joins.


@query("SELECT p_brand, count(*) AS n, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def j_fk(spark, sf_dir):
    joined = joins.key_join(_li(spark, sf_dir), tables.table(spark, sf_dir, "part"), "l_partkey", "p_partkey")
    return joined.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@query(f"WITH {LI} SELECT p_type LIKE 'PROMO%' AS promo, count(*) AS n, CAST(sum(price) AS BIGINT) AS price FROM li JOIN part ON l_partkey = p_partkey GROUP BY 1")
def j_flag_key(spark, sf_dir):
    joined = joins.flagged_join(_li(spark, sf_dir), tables.table(spark, sf_dir, "part"), "l_partkey", "p_partkey", F.col("p_type").startswith("PROMO"), "promo")
    return joined.groupBy("promo").agg(F.count("*").alias("n"), F.sum("price").alias("price"))


@query(
    "SELECT r_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey GROUP BY 1"
)
def j_star(spark, sf_dir):
    read = lambda name: tables.table(spark, sf_dir, name)
    joined = joins.star_join(read("orders"), (read("customer"), "o_custkey", "c_custkey"), (read("nation"), "c_nationkey", "n_nationkey"), (read("region"), "n_regionkey", "r_regionkey"))
    return joined.groupBy("r_name").agg(F.count("*").alias("n"))


@query(
    "SELECT n1.n_name AS c_n_name, n2.n_name AS s_n_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey "
    "JOIN supplier ON l_suppkey = s_suppkey JOIN nation n2 ON s_nationkey = n2.n_nationkey GROUP BY 1, 2"
)
def j_dual_role(spark, sf_dir):
    read = lambda name: tables.table(spark, sf_dir, name)
    joined = joins.star_join(
        read("lineitem"), (read("orders"), "l_orderkey", "o_orderkey"), (read("customer"), "o_custkey", "c_custkey"), (joins.in_role(read("nation"), "c"), "c_nationkey", "c_n_nationkey"),
        (read("supplier"), "l_suppkey", "s_suppkey"), (joins.in_role(read("nation"), "s"), "s_nationkey", "s_n_nationkey"),
    )
    return joined.groupBy("c_n_name", "s_n_name").agg(F.count("*").alias("n"))


@query(
    "SELECT count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey "
    "WHERE (p_size <= 10 AND l_quantity < 10) OR (p_size > 40 AND l_quantity > 40) OR (p_brand = 'Brand#12' AND l_quantity < 20)"
)
def j_or_branches(spark, sf_dir):
    conditions = [(F.col("p_size") <= 10) & (F.col("l_quantity") < 10), (F.col("p_size") > 40) & (F.col("l_quantity") > 40), (F.col("p_brand") == "Brand#12") & (F.col("l_quantity") < 20)]
    return joins.branches_join(tables.table(spark, sf_dir, "lineitem"), tables.table(spark, sf_dir, "part"), "l_partkey", "p_partkey", conditions).agg(F.count("*").alias("n"))


@query(f"WITH {LI} SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM li WHERE l_orderkey = o_orderkey AND commitdate < receiptdate)")
def j_semi(spark, sf_dir):
    return joins.exists_join(tables.orders(spark, sf_dir), _li(spark, sf_dir).filter("commitdate < receiptdate"), "o_orderkey", "l_orderkey").select("o_orderkey")


@query(f"WITH {LI} SELECT o_orderkey, count(*) AS n FROM orders JOIN li ON l_orderkey = o_orderkey AND commitdate < receiptdate GROUP BY 1")
def j_count_variant(spark, sf_dir):
    return joins.key_join(_li(spark, sf_dir).filter("commitdate < receiptdate"), tables.orders(spark, sf_dir), "l_orderkey", "o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("n"))


# The workload.

QUERIES |= {
    "q1": workload.pricing_summary, "q4_exists": workload.late_orders, "q4_join_count": workload.late_items, "q6": workload.forecast, "q6_net": workload.forecast_net,
    "q8": workload.market_share, "q12": workload.ship_modes, "q14": workload.promotion, "q17_global_avg": workload.small_orders_global, "q17_correlated": workload.small_orders,
    "q17_container": lambda spark, sf_dir: workload.small_orders(spark, sf_dir, container="MED BOX"), "q19": workload.discounted,
}
_PRIORITIES = "(VALUES ('1-URGENT'),('2-HIGH'),('3-MEDIUM'),('4-NOT SPECIFIED'),('5-LOW')) d(o_orderpriority)"
_QUARTER = "o_orderdate >= DATE '1996-07-01' AND CAST(o_orderdate AS DATE) < DATE '1996-10-01'"
_FORECAST = "FROM li WHERE shipdate >= DATE '1996-01-01' AND shipdate < DATE '1996-12-31' AND disc BETWEEN 5 AND 7 AND qty < 24"
ORACLES |= {
    "q1": f"""WITH {LI}, d AS (SELECT * FROM (VALUES ('A'),('N'),('R')) a(l_returnflag), (VALUES ('F'),('O')) b(l_linestatus)),
     g AS (SELECT d.l_returnflag, d.l_linestatus, CAST(coalesce(sum(qty),0) AS BIGINT) AS sum_qty, CAST(coalesce(sum(price),0) AS BIGINT) AS sum_base, CAST(coalesce(sum(price*(100-disc)),0) AS BIGINT) AS sum_disc_price,
      CAST(coalesce(sum(price*(100-disc)*(100+tax)),0) AS BIGINT) AS sum_charge, CAST(coalesce(sum(disc),0) AS BIGINT) AS sum_disc, count(l.l_orderkey) AS n
      FROM d LEFT JOIN (SELECT * FROM li WHERE shipdate <= DATE '1998-09-02') l ON l.l_returnflag = d.l_returnflag AND l.l_linestatus = d.l_linestatus GROUP BY 1, 2)
     SELECT *, CAST(sum_qty AS DOUBLE)/nullif(n,0) AS avg_qty, CAST(sum_base AS DOUBLE)/nullif(n,0) AS avg_base, CAST(sum_disc AS DOUBLE)/nullif(n,0) AS avg_disc FROM g""",
    "q4_exists": (
        f"WITH {LI}, o AS (SELECT * FROM orders WHERE {_QUARTER} AND EXISTS (SELECT 1 FROM li WHERE l_orderkey = o_orderkey AND commitdate < receiptdate)) "
        f"SELECT d.o_orderpriority, count(o_orderkey) AS n FROM {_PRIORITIES} LEFT JOIN o ON o.o_orderpriority = d.o_orderpriority GROUP BY 1"
    ),
    "q4_join_count": (
        f"WITH {LI}, o AS (SELECT * FROM orders JOIN li ON l_orderkey = o_orderkey AND commitdate < receiptdate WHERE {_QUARTER}) SELECT d.o_orderpriority, "
        f"count(o_orderkey) AS n FROM {_PRIORITIES} LEFT JOIN o ON o.o_orderpriority = d.o_orderpriority GROUP BY 1"
    ),
    "q6": f"WITH {LI} SELECT CAST(coalesce(sum(price * disc), 0) AS BIGINT) AS revenue {_FORECAST}",
    "q6_net": f"WITH {LI} SELECT CAST(coalesce(sum(price * (100 - disc) // 100), 0) AS BIGINT) AS revenue {_FORECAST}",
    "q8": f"""WITH {LI}, g AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CASE WHEN n2.n_name = 'NATION_9' THEN price*(100-disc) ELSE 0 END) AS BIGINT) AS num, CAST(sum(price*(100-disc)) AS BIGINT) AS den
     FROM li JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey
     JOIN supplier ON l_suppkey = s_suppkey JOIN nation n2 ON s_nationkey = n2.n_nationkey
     WHERE p_type = 'ECONOMY' AND r_name = 'AMERICA' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' GROUP BY 1) SELECT *, CAST(num AS DOUBLE) / den AS share FROM g""",
    "q12": f"""WITH {LI}, j AS (SELECT shipmode, o_orderpriority IN ('1-URGENT','2-HIGH') AS urgent FROM li JOIN orders ON l_orderkey = o_orderkey WHERE commitdate < receiptdate AND shipdate < commitdate AND receiptdate >= DATE '1997-01-01' AND receiptdate < DATE '1998-01-01')
     SELECT d.shipmode, CAST(coalesce(sum(CAST(urgent AS BIGINT)),0) AS BIGINT) AS high, CAST(coalesce(sum(CAST(NOT urgent AS BIGINT)),0) AS BIGINT) AS low FROM (VALUES ('MAIL'),('SHIP')) d(shipmode) LEFT JOIN j ON j.shipmode = d.shipmode GROUP BY 1""",
    "q14": (
        f"WITH {LI}, g AS (SELECT CAST(coalesce(sum(CASE WHEN p_type LIKE 'PROMO%' THEN price*(100-disc) END),0) AS BIGINT) AS num, "
        f"CAST(coalesce(sum(price*(100-disc)),0) AS BIGINT) AS den FROM li JOIN part ON l_partkey = p_partkey "
        f"WHERE shipdate >= DATE '1996-09-01' AND shipdate < DATE '1996-10-01') SELECT *, CAST(num AS DOUBLE) / nullif(den, 0) AS share FROM g"
    ),
    "q17_global_avg": (
        f"WITH {LI}, {PA} SELECT CAST(coalesce(sum(price),0) AS BIGINT) AS sum_price, count(*) AS n FROM li JOIN pa ON l_partkey = p_partkey "
        f"WHERE p_brand = 'Brand#23' AND container = 'MED BOX' AND 10 * qty < 2 * (SELECT sum(qty) // count(qty) FROM li)"
    ),
    "q17_correlated": (
        f"WITH {LI} SELECT CAST(coalesce(sum(price),0) AS BIGINT) AS sum_price, count(*) AS n FROM li JOIN part ON l_partkey = p_partkey "
        f"WHERE p_brand = 'Brand#23' AND 5 * qty * (SELECT count(qty) FROM li i WHERE i.l_partkey = p_partkey) < (SELECT sum(qty) FROM li i "
        f"WHERE i.l_partkey = p_partkey)"
    ),
    "q17_container": (
        f"WITH {LI}, {PA} SELECT CAST(coalesce(sum(price),0) AS BIGINT) AS sum_price, count(*) AS n FROM li JOIN pa ON l_partkey = p_partkey "
        f"WHERE p_brand = 'Brand#23' AND container = 'MED BOX' AND 5 * qty * (SELECT count(qty) FROM li i WHERE i.l_partkey = p_partkey) < (SELECT sum(qty) "
        f"FROM li i WHERE i.l_partkey = p_partkey)"
    ),
    "q19": f"""WITH {LI}, {PA} SELECT CAST(coalesce(sum(price*(100-disc)),0) AS BIGINT) AS revenue, count(*) AS n FROM li JOIN pa ON l_partkey = p_partkey WHERE shipmode IN ('AIR','REG AIR') AND shipinstruct = 'DELIVER IN PERSON' AND (
     (p_brand IN ('Brand#12','Brand#1','Brand#2','Brand#3') AND container IN ('SM CASE','SM BOX','SM PACK','SM PKG') AND qty BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15) OR
     (p_brand IN ('Brand#23','Brand#4','Brand#5','Brand#6') AND container IN ('MED BAG','MED BOX','MED PKG','MED PACK') AND qty BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 25) OR
     (p_brand IN ('Brand#25','Brand#7','Brand#8','Brand#9') AND container IN ('LG CASE','LG BOX','LG PACK','LG PKG') AND qty BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 35))""",
}


# Band joins: clicks near purchases in days.


def _sides(spark, sf_dir, first: str = "click", second: str = "purchase"):
    ev = tables.events(spark, sf_dir)
    return bandjoin.Side(ev.filter(F.col("event_type") == first), "day", "payload"), bandjoin.Side(ev.filter(F.col("event_type") == second), "day", "payload")


def _band_sql(delta: int, block: bool) -> str:
    on = "a.user_id = b.user_id AND " if block else ""
    return (
        f"WITH {EV} SELECT count(*) AS pairs, CAST(coalesce(sum(a.payload),0) AS BIGINT) AS sum_a, CAST(coalesce(sum(b.payload),0) AS BIGINT) AS sum_b "
        f"FROM ev a JOIN ev b ON {on}abs(a.day - b.day) <= {delta} WHERE a.event_type = 'click' AND b.event_type = 'purchase'"
    )


def _clicks_and_purchases(spark, sf_dir) -> tuple:
    """The events, which of them are clicks, and which are purchases."""
    return tables.events(spark, sf_dir), F.col("event_type") == "click", F.col("event_type") == "purchase"


def _band(name: str, delta: int, block: bool, strategy: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return bandjoin.band_within(*_clicks_and_purchases(spark, sf_dir), "day", "payload", delta, ["user_id"] if block else [], strategy)

    QUERIES[name] = run
    ORACLES[name] = _band_sql(delta, block)


_band("bj_block", 3, True, bandjoin.ROWS)
_band("bj_block_hist", 3, True, bandjoin.HISTOGRAM)
_band("bj_window", 3, True, bandjoin.WINDOW)
_band("bj_bins", 7, False, bandjoin.HISTOGRAM)
_band("bj_global_hist", 3, False, bandjoin.HISTOGRAM)
_band("bj_date30", 30, False, bandjoin.HISTOGRAM)
_band("bj_payload_both", 30, True, bandjoin.HISTOGRAM)


@query(_band_sql(5, True))
def bj_two_tables(spark, sf_dir):
    """The sides as two tables."""
    return bandjoin.band_aggregate(*_sides(spark, sf_dir), 5, ["user_id"], ["user_id"])


@query(
    f"WITH {EV} SELECT a.event_id AS a_id, b.event_id AS b_id FROM ev a JOIN ev b ON a.user_id = b.user_id AND abs(a.day - b.day) <= 3 "
    f"WHERE a.event_type = 'click' AND b.event_type = 'purchase'"
)
def bj_pairs(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    left = a.rows.select(F.col("event_id").alias("a_id"), F.col("user_id").alias("a_user"), F.col("day").alias("a_day"))
    right = b.rows.select(F.col("event_id").alias("b_id"), F.col("user_id").alias("b_user"), F.col("day").alias("b_day"))
    return bandjoin.band_pairs(left, right, "a_day", "b_day", 3, [("a_user", "b_user")]).select("a_id", "b_id")


@query(_band_sql(3, True), "bj_auto")
def bj_auto(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    chosen = bandjoin.choose(*bandjoin.statistics(a, b, ["user_id"], ["user_id"]), True, 3)
    return bandjoin.band_within(*_clicks_and_purchases(spark, sf_dir), "day", "payload", 3, ["user_id"], chosen)


@query(
    f"WITH {EV} SELECT pairs, CAST(pairs AS DOUBLE) / ((SELECT count(*) FROM ev WHERE event_type = 'click') * (SELECT count(*) FROM ev "
    f"WHERE event_type = 'purchase')) AS rate "
    "FROM (SELECT count(*) AS pairs FROM ev a JOIN ev b ON abs(a.day - b.day) <= 3 WHERE a.event_type = 'click' AND b.event_type = 'purchase')"
)
def bj_match_rate(spark, sf_dir):
    events, is_a, is_b = _clicks_and_purchases(spark, sf_dir)
    sizes = events.agg(F.count_if(is_a).alias("n"), F.count_if(is_b).alias("m"))
    met = bandjoin.band_within(events, is_a, is_b, "day", None, 3).crossJoin(F.broadcast(sizes))  # one row
    return met.select("pairs", (F.col("pairs").cast("double") / (F.col("n").cast("double") * F.col("m"))).alias("rate"))


@query(
    f"WITH {EV}, c AS (SELECT a.event_id AS a_id, a.payload, count(*) AS n FROM ev a JOIN ev b ON a.user_id = b.user_id AND abs(a.day - b.day) <= 3 "
    f"WHERE a.event_type = 'click' AND b.event_type = 'purchase' GROUP BY 1, 2) "
    "SELECT count(*) AS matched, CAST(sum(n) AS BIGINT) AS pairs, CAST(sum(n * payload) AS BIGINT) AS sum_a, max(n) AS most FROM c"
)
def bj_per_outer(spark, sf_dir):
    """Matches of each outer row, and the payload weighted by them."""
    a, b = _sides(spark, sf_dir)
    left = a.rows.select(F.col("event_id").alias("a_id"), F.col("user_id").alias("a_user"), F.col("day").alias("a_day"), "payload")
    right = b.rows.select(F.col("user_id").alias("b_user"), F.col("day").alias("b_day"))
    each = bandjoin.band_pairs(left, right, "a_day", "b_day", 3, [("a_user", "b_user")]).groupBy("a_id", "payload").agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("matched"), agg.total(F.col("n")).alias("pairs"), agg.total(F.col("n") * F.col("payload")).alias("sum_a"), F.max("n").alias("most"))


# Blocking.

_KEYS_SQL = {"coarse": "CAST(month(ts) AS VARCHAR)", "medium": "CAST(user_id AS VARCHAR)", "fine": "CAST(user_id AS VARCHAR) || '|' || CAST(month(ts) AS VARCHAR)"}


def _buckets_sql() -> str:
    parts = []
    for name, key in _KEYS_SQL.items():
        side = lambda kind, n: f"(SELECT {key} AS bucket, count(*) AS {n} FROM ev WHERE event_type = '{kind}' GROUP BY 1)"  # noqa: E731, B023
        parts.append(f"SELECT '{name}' AS granularity, a.bucket, n_b, m_b, n_b * m_b AS work FROM {side('click', 'n_b')} a JOIN {side('purchase', 'm_b')} b ON a.bucket = b.bucket")
    return f"{EV}, bk AS (" + " UNION ALL ".join(parts) + ")"


def buckets(spark, sf_dir) -> DataFrame:
    month, user = F.month("ts").cast("string"), F.col("user_id").cast("string")
    return blocking.ladder(*_clicks_and_purchases(spark, sf_dir), {"coarse": month, "medium": user, "fine": F.concat_ws("|", user, month)})


BK = _buckets_sql()


@query(f"WITH {BK} SELECT * FROM bk")
def bk_bucket_stats(spark, sf_dir):
    return buckets(spark, sf_dir)


@query(f"WITH {BK} SELECT granularity, count(*) AS buckets, CAST(sum(work) AS BIGINT) AS work, max(n_b) AS max_n, max(m_b) AS max_m FROM bk GROUP BY 1")
def bk_granularity_ladder(spark, sf_dir):
    return buckets(spark, sf_dir).groupBy("granularity").agg(F.count("*").alias("buckets"), agg.total(F.col("work")).alias("work"), F.max("n_b").alias("max_n"), F.max("m_b").alias("max_m"))


#: Sounds of the segments, by hand.
_SOUNDS = (("AUTOMOBILE", "A351"), ("BUILDING", "B435"), ("FURNITURE", "F653"), ("HOUSEHOLD", "H243"), ("MACHINERY", "M256"))


@query(
    "WITH s(name, sound) AS (VALUES " + ", ".join(map(str, _SOUNDS)) + "), c AS (SELECT c_custkey, sound, lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS postcode, CAST(year(DATE '1950-01-01' + CAST(c_custkey % 9000 AS INTEGER)) AS VARCHAR) AS born "
    "FROM customer LEFT JOIN s ON c_mktsegment = name) "
    "SELECT c_custkey, born AS coarse, sound || '|' || born AS medium, substr(postcode, 1, 3) || '|' || sound || '|' || born AS fine FROM c"
)
def bk_soundex(spark, sf_dir):
    who = tables.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("name"), F.lpad(F.col("c_custkey").cast("string"), 5, "0").alias("postcode"), F.date_add(F.lit("1950-01-01").cast("date"), (F.col("c_custkey") % 9000).cast("int")).alias("born"))
    return who.select("c_custkey", blocking.year_key(F.col("born")).alias("coarse"), blocking.sound_key(F.col("name"), F.col("born")).alias("medium"), blocking.place_key(F.col("postcode"), F.col("name"), F.col("born")).alias("fine"))


# The planner, over the buckets of the data and vectors small enough for them to matter.

SLOTS = 64
_INNER, _OUTER = "least(n_b, m_b)", "greatest(n_b, m_b)"


def _batches_sql(outer: str, inner: str, slots: int) -> str:
    per = f"(2 * greatest(1, {slots // 2} // {inner}))"
    return f"(({outer} + {per} - 1) // {per})"


_NB = _batches_sql(_OUTER, _INNER, SLOTS)
_NB_A, _NB_B = _batches_sql("n_b", "m_b", SLOTS), _batches_sql("m_b", "n_b", SLOTS)
_PRICE = "(2 * {0} * 175.0::DOUBLE + 15 * 0.112::DOUBLE * {0})"
_BIG = 1 << 62


@query(
    f"WITH {BK} SELECT granularity, bucket, {_NB} AS batches, 2 * {_NB} AS comparisons, round({_PRICE.format(_NB)}, 6) AS cost, {_INNER} <= {SLOTS // 2} AS "
    f"feasible FROM bk"
)
def pl_tiled_cost(spark, sf_dir):
    made = cost.tiled(buckets(spark, sf_dir), SLOTS)
    return made.select("granularity", "bucket", "batches", "comparisons", F.round("cost_minmax", 6).alias("cost"), "feasible")


@query(f"WITH {BK} SELECT granularity, bucket, round({_PRICE.format(_NB_A)}, 6) AS a_outer, round({_PRICE.format(_NB_B)}, 6) AS b_outer FROM bk")
def pl_forced_cost(spark, sf_dir):
    made = cost.forced(buckets(spark, sf_dir), SLOTS)
    return made.select("granularity", "bucket", F.round("cost_a_outer", 6).alias("a_outer"), F.round("cost_b_outer", 6).alias("b_outer"))


_FA, _FB = (f"(CASE WHEN {inner} > {SLOTS // 2} THEN {_BIG} ELSE {n} END)" for inner, n in (("m_b", _NB_A), ("n_b", _NB_B)))


@query(f"WITH {BK} SELECT granularity, bucket, CASE WHEN {_FB} < {_FA} THEN 'B' ELSE 'A' END AS outer_side, least({_FA}, {_FB}) AS batches FROM bk")
def pl_best_orientation(spark, sf_dir):
    return cost.best_orientation(buckets(spark, sf_dir), SLOTS).select("granularity", "bucket", "outer_side", F.col("batches_best").alias("batches"))


def _naive_sql(prefix: str, outer: str, inner: str) -> str:
    spread = (SLOTS - 1).bit_length() + 1
    part = f"({inner} % {SLOTS})"
    up = f"(CASE WHEN {part} <= 1 THEN 0 ELSE length(bin(CAST({part} - 1 AS BIGINT))) END)"
    chunks = f"({inner} // {SLOTS} + CASE WHEN {part} > 0 THEN 1 ELSE 0 END)"
    turns = f"CAST({outer} * ({spread} + {inner} // {SLOTS} * {spread} + CASE WHEN {part} > 0 THEN {up} + 1 ELSE 0 END) AS BIGINT)"
    return (
        f"2 * {outer} * {chunks} AS {prefix}_comparisons, {outer} * {chunks} AS {prefix}_products, CASE WHEN {part} > 0 THEN {outer} ELSE 0 "
        f"END AS {prefix}_plain_products, {turns} AS {prefix}_rotations, {turns} AS {prefix}_additions"
    )


@query(f"WITH {BK} SELECT granularity, bucket, {_naive_sql('naive', 'n_b', 'm_b')}, {_naive_sql('fixed', _INNER, _OUTER)} FROM bk")
def pl_naive_counts(spark, sf_dir):
    return cost.naive_counts(buckets(spark, sf_dir), SLOTS).drop("n_b", "m_b", "work")


@query(
    f"WITH {BK}, x AS (SELECT *, nullif(least({_FA}, {_FB}), {_BIG}) AS nb FROM bk) "
    f"SELECT granularity, bucket, n_b + (m_b + {SLOTS - 1}) // {SLOTS} + 6 AS naive_resident, "
    f"{_INNER} + ({_OUTER} + {SLOTS - 1}) // {SLOTS} + 6 AS fixed_resident, 7 + 2 * nb AS tiled_resident, 7 + nb AS fused_resident FROM x"
)
def pl_memory(spark, sf_dir):
    """Of every bucket; the layouts that need a side to fit a row are null where none does."""
    return cost.memory(buckets(spark, sf_dir), SLOTS).select("granularity", "bucket", "naive_resident", "fixed_resident", "tiled_resident", "fused_resident")


_SLOTS, _FACTORS = (32, 64, 128), (0.1, 0.5, 1.0, 2.0, 5.0, 10.0)


def _sweep_sql() -> str:
    each = " UNION ALL ".join(
        f"SELECT granularity, {s} AS slots, CAST(sum({_batches_sql(_OUTER, _INNER, s)}) AS BIGINT) AS batches, CAST(sum({_OUTER} * (({_INNER} + {s - 1}) // {s})) AS BIGINT) AS vectors FROM bk GROUP BY 1" for s in _SLOTS
    )
    factors = ", ".join(f"({f}::DOUBLE)" for f in _FACTORS)
    return (
        f"{BK}, t AS ({each}), sw AS (SELECT granularity, slots, batches, factor, 2 * batches AS comparisons, 2 * batches * (factor * 175.0) + batches * (15 * "
        f"0.112::DOUBLE) AS tiled, 2 * vectors * (factor * 175.0) AS naive FROM t, (VALUES {factors}) f(factor))"
    )


@query(
    f"WITH {_sweep_sql()} SELECT granularity, slots, factor, batches, comparisons, round(tiled, 4) AS tiled, round(naive, 4) AS naive, "
    f"round(naive / tiled, 6) AS speedup FROM sw"
)
def pl_sweep(spark, sf_dir):
    made = experiments.sweep(buckets(spark, sf_dir), _SLOTS, _FACTORS)
    return made.select("granularity", "slots", "factor", "batches", "comparisons", F.round("tiled", 4).alias("tiled"), F.round("naive", 4).alias("naive"), F.round("speedup", 6).alias("speedup"))


@query(
    f"WITH {_sweep_sql()} SELECT slots, factor, granularity, round(tiled, 4) AS tiled "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY slots, factor ORDER BY tiled, granularity) AS k FROM sw) WHERE k = 1"
)
def pl_winner(spark, sf_dir):
    return experiments.winners(experiments.sweep(buckets(spark, sf_dir), _SLOTS, _FACTORS)).select("slots", "factor", "granularity", F.round("tiled", 4).alias("tiled"))


_TINY = f"n_b * m_b < {SLOTS}"


@query(
    f"WITH {BK}, s AS (SELECT granularity, count(*) FILTER ({_TINY}) AS tiny, count(*) FILTER (NOT {_TINY}) AS large, "
    f"CAST(coalesce(sum(work) FILTER ({_TINY}), 0) AS BIGINT) AS tiny_pairs, CAST(coalesce(sum({_NB}) FILTER (NOT {_TINY}), 0) AS BIGINT) AS large_batches "
    f"FROM bk GROUP BY 1) "
    f"SELECT granularity, gamma, tiny, large, (tiny_pairs + {SLOTS - 1}) // {SLOTS} AS packed, round(((tiny_pairs + {SLOTS - 1}) // {SLOTS}) * "
    f"(350.0::DOUBLE + gamma * 0.112::DOUBLE) + (2 * large_batches * 175.0::DOUBLE + large_batches * 1.68::DOUBLE), 4) AS cost_packed, "
    f"round(tiny * 351.68::DOUBLE + (2 * large_batches * 175.0::DOUBLE + large_batches * 1.68::DOUBLE), 4) AS cost_alone "
    "FROM s, (VALUES (0),(1),(5),(15),(30)) g(gamma)"
)
def pl_copack(spark, sf_dir):
    made = experiments.packing(buckets(spark, sf_dir), SLOTS)
    return made.select("granularity", "gamma", "tiny", "large", "packed", F.round("cost_packed", 4).alias("cost_packed"), F.round("cost_alone", 4).alias("cost_alone"))


@query(
    f"WITH {BK}, s AS (SELECT granularity, {_INNER} AS inner_, CAST(sum(work) AS BIGINT) AS pairs, count(*) AS buckets FROM bk WHERE {_TINY} "
    f"GROUP BY 1, 2), g AS (SELECT granularity, CAST(sum(pairs) AS BIGINT) AS pairs, CAST(sum(buckets) AS BIGINT) AS buckets, count(*) AS shapes, "
    f"CAST(sum((pairs + {SLOTS - 1}) // {SLOTS}) AS BIGINT) AS by_shape FROM s GROUP BY 1) "
    f"SELECT granularity, buckets, shapes, pairs, by_shape, (pairs + {SLOTS - 1}) // {SLOTS} AS greedy, "
    f"round(CAST(pairs AS DOUBLE) / (by_shape * {SLOTS}), 9) AS by_shape_used FROM g"
)
def pl_grouping(spark, sf_dir):
    return experiments.grouping(buckets(spark, sf_dir), SLOTS).select("granularity", "buckets", "shapes", "pairs", "by_shape", "greedy", F.round("by_shape_used", 9).alias("by_shape_used"))


_TAIL = f"""tail0 AS (SELECT granularity, work, work >= {SLOTS} AS large, work >= {SLOTS} AND {_OUTER} >= 2 * {_INNER} AS lop, {_PRICE.format(_NB_A)} AS a, {_PRICE.format(_NB_B)} AS b FROM bk),
 tail AS (SELECT granularity, count(*) FILTER (large) AS large, count(*) FILTER (lop) AS lopsided, coalesce(100.0::DOUBLE * sum(work) FILTER (lop) / sum(work), 0) AS lopsided_work,
  CASE WHEN count(*) FILTER (lop) = 0 THEN 0.0::DOUBLE ELSE (count(*) FILTER (lop AND b < a))::DOUBLE / count(*) FILTER (lop) END AS flip_rate,
  coalesce(sum(a) FILTER (lop) / sum(least(a, b)) FILTER (lop), 1.0) AS speedup_weighted, coalesce(quantile_cont(greatest(a, b) / least(a, b), 0.5) FILTER (lop), 1.0) AS speedup_median,
  coalesce(quantile_cont(greatest(a, b) / least(a, b), 0.95) FILTER (lop), 1.0) AS speedup_p95, coalesce(max(greatest(a, b) / least(a, b)) FILTER (lop), 1.0) AS speedup_max,
  coalesce(sum(a - b) FILTER (lop AND b < a), 0.0) / 3600 AS saved_hours FROM tail0 GROUP BY 1)"""
_TAIL_COLUMNS = ("lopsided_work", "flip_rate", "speedup_weighted", "speedup_median", "speedup_p95", "speedup_max", "saved_hours")


@query(f"WITH {BK}, {_TAIL} SELECT granularity, large, lopsided, " + ", ".join(f"round({c}, 6) AS {c}" for c in _TAIL_COLUMNS) + " FROM tail")
def pl_orientation_tail(spark, sf_dir):
    made = experiments.orientation_tail(buckets(spark, sf_dir), SLOTS)
    return made.select("granularity", "large", "lopsided", *(F.round(c, 6).alias(c) for c in _TAIL_COLUMNS))


_CROSS = "CAST(CAST('0x' || substr(md5(bucket), 1, 8) AS BIGINT) % 4 AS INTEGER)"


def _classes_sql(cls: str, source: str = "bk") -> str:
    return (
        f"cl AS (SELECT *, {cls} AS class FROM {source}), cc AS (SELECT granularity, class, "
        f"CAST(coalesce(sum(work) FILTER ({_TINY}), 0) AS BIGINT) AS tiny_pairs, CAST(coalesce(sum({_NB}) FILTER (NOT {_TINY}), 0) AS BIGINT) AS large_batches "
        f"FROM cl GROUP BY 1, 2)"
    )


_PACKED = f"((tiny_pairs + {SLOTS - 1}) // {SLOTS})"
_CC_OUT = (
    f"SELECT granularity, class, tiny_pairs, large_batches, {_PACKED} AS packed, round({_PACKED} * (350.0::DOUBLE + 5 * 0.112::DOUBLE) + large_batches * "
    f"351.68::DOUBLE, 4) AS seconds FROM cc"
)


def _classed(classed: DataFrame) -> DataFrame:
    return experiments.class_costs(classed, SLOTS).withColumn("seconds", F.round("seconds", 4))




@query(f"WITH {BK}, {_classes_sql(_CROSS)} {_CC_OUT}")
def pl_predclass(spark, sf_dir):
    return _classed(experiments.crosscut(buckets(spark, sf_dir), 4))


@query(
    f"WITH {BK}, "
    f"{_classes_sql('CAST(least(3, (row_number() OVER (PARTITION BY granularity ORDER BY work DESC, substr(md5(bucket), 1, 3), bucket) - 1) * 4 // count(*) OVER (PARTITION BY granularity)) AS INTEGER)')} {_CC_OUT}"
)
def pl_predclass_aligned(spark, sf_dir):
    return _classed(experiments.aligned(buckets(spark, sf_dir), 4))


_LOT = "CAST('0x' || substr(md5('p' || bucket), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query(f"WITH {BK}, {_classes_sql(f'CASE WHEN {_LOT} < 0.3 THEN 0 WHEN {_LOT} < 0.7 THEN 1 ELSE 2 END')} {_CC_OUT}")
def pl_predclass_proportional(spark, sf_dir):
    return _classed(experiments.proportional(buckets(spark, sf_dir)))


@query(
    f"WITH RECURSIVE {BK}, {_classes_sql(_CROSS)}, "
    f"n AS (SELECT granularity, tiny_pairs, row_number() OVER (PARTITION BY granularity ORDER BY class) AS k, count(*) OVER (PARTITION BY granularity) AS "
    f"classes FROM cc), "
    f"w AS (SELECT granularity, 0::BIGINT AS k, 0::BIGINT AS pool, 0::BIGINT AS vectors, 0::BIGINT AS merges FROM n WHERE k = 1 UNION ALL "
    f"SELECT w.granularity, n.k, CASE WHEN w.pool > 0 AND ceil(w.pool / {SLOTS}.0) + ceil(n.tiny_pairs / {SLOTS}.0) > ceil((w.pool + n.tiny_pairs) / "
    f"{SLOTS}.0) THEN w.pool + n.tiny_pairs ELSE n.tiny_pairs END, "
    f"CASE WHEN w.pool > 0 AND ceil(w.pool / {SLOTS}.0) + ceil(n.tiny_pairs / {SLOTS}.0) > ceil((w.pool + n.tiny_pairs) / {SLOTS}.0) THEN w.vectors "
    f"ELSE w.vectors + CAST(ceil(w.pool / {SLOTS}.0) AS BIGINT) END, w.merges + CASE "
    f"WHEN w.pool > 0 AND ceil(w.pool / {SLOTS}.0) + ceil(n.tiny_pairs / {SLOTS}.0) > ceil((w.pool + n.tiny_pairs) / {SLOTS}.0) THEN 1 ELSE 0 END FROM w "
    f"JOIN n ON n.granularity = w.granularity AND n.k = w.k + 1) "
    f"SELECT w.granularity, CAST(n.classes AS INTEGER) AS classes, a.apart, w.vectors + CAST(ceil(w.pool / {SLOTS}.0) AS BIGINT) AS merged, w.merges FROM w "
    f"JOIN n ON n.granularity = w.granularity AND n.k = w.k AND n.k = n.classes JOIN (SELECT granularity, "
    f"CAST(sum((tiny_pairs + {SLOTS - 1}) // {SLOTS}) AS BIGINT) AS apart FROM cc GROUP BY 1) a ON a.granularity = w.granularity"
)
def pl_predmerge(spark, sf_dir):
    return experiments.merged_classes(experiments.class_costs(experiments.crosscut(buckets(spark, sf_dir), 4), SLOTS), SLOTS)


_LEAK = """w0 AS (SELECT width, 100000 * width / 3650::DOUBLE AS rows, greatest(1, 3650 // width)::BIGINT AS n_blocks FROM (VALUES (3650),(365),(30),(7),(1)) w(width)),
 w1 AS (SELECT width, n_blocks, round_even(rows, 0)::BIGINT AS n_block, round_even(rows * rows, 0)::BIGINT AS work FROM w0),
 w2 AS (SELECT *, CASE WHEN work = 0 THEN 'empty' WHEN work < 32768 THEN 'tiny' ELSE 'large' END AS regime, 2 * greatest(1, 16384 // greatest(n_block, 1)) AS per FROM w1),
 leak AS (SELECT width, n_blocks, n_block, work, regime, CASE regime WHEN 'empty' THEN 0 WHEN 'tiny' THEN (n_blocks * work + 32767) // 32768 ELSE n_blocks * ((n_block + per - 1) // per) END::BIGINT AS vectors FROM w2)"""


@query(
    f"WITH {_LEAK} SELECT width::INTEGER AS width, n_blocks, n_block, work, regime, vectors, round(CASE regime WHEN 'tiny' THEN vectors * 350.56::DOUBLE "
    f"WHEN 'large' THEN vectors * 351.68::DOUBLE ELSE 0 END / 3600, 6) AS hours, "
    "n_blocks AS leakage, least(1.0::DOUBLE, 60.0::DOUBLE / width) AS recall_loss_bound FROM leak"
)
def pl_leakage(spark, sf_dir):
    return experiments.leakage(spark, (3650, 365, 30, 7, 1)).withColumn("hours", F.round("hours", 6))


@query(f"WITH {_LEAK} SELECT count(DISTINCT regime) AS regimes, count(DISTINCT regime) > 1 AS flips FROM leak WHERE width IN (3650, 7, 1)")
def pl_plan_flip(spark, sf_dir):
    return experiments.plan_flips(experiments.leakage(spark, (3650, 7, 1)))


@query(
    f"WITH {EV} SELECT count(*) AS all_pairs, count(*) FILTER (a.day // 7 = b.day // 7) AS kept_pairs, 1 - "
    f"CAST(count(*) FILTER (a.day // 7 = b.day // 7) AS DOUBLE) / count(*) AS recall_lost FROM ev a JOIN ev b ON abs(a.day - b.day) <= 3 "
    f"WHERE a.event_type = 'click' AND b.event_type = 'purchase'"
)
def pl_true_recall(spark, sf_dir):
    return bandjoin.band_recall(*_clicks_and_purchases(spark, sf_dir), "day", 3, lambda day: F.floor(day / 7))


@query(
    f"WITH {_sweep_sql()} SELECT granularity, CASE WHEN naive/tiled >= 20 THEN 'STRONG' WHEN naive/tiled >= 10 THEN 'GOOD' WHEN naive/tiled >= 5 THEN 'OK' "
    f"WHEN naive/tiled >= 2 THEN 'MARGINAL' ELSE 'WEAK' END AS gate FROM sw WHERE slots = 64 AND factor = 1.0"
)
def pl_gate_label(spark, sf_dir):
    return experiments.sweep(buckets(spark, sf_dir), (SLOTS,), (1.0,)).select("granularity", cost.gate(F.col("speedup")).alias("gate"))


_ZIPF = (216_197, 1.37e9, 1974, 1028)
_HALF = tables.zipf_exponent(_ZIPF[0], float(_ZIPF[2]) * _ZIPF[3], _ZIPF[1]) / 2


@query(
    "SELECT 'medium' AS granularity, i AS bucket, " + ", ".join(f"greatest(1, round({most} * pow(i::DOUBLE, -({_HALF!r}::DOUBLE))))::BIGINT AS {name}" for name, most in (("n_b", _ZIPF[2]), ("m_b", _ZIPF[3]))) + f" FROM range(1, {_ZIPF[0] + 1}) r(i)"
)
def pl_zipf(spark, sf_dir):
    """Bucket sizes by a power law. Powers may differ in the last bit between engines; no size here is that near to a half."""
    return tables.zipf_buckets(spark, "medium", *_ZIPF)


_PRICES = {"comparisons": 175.0, "rotations": 0.125, "products": 0.375, "plain_products": 0.0009765625, "additions": 0.00048828125}


@query(
    f"WITH {BK}, c AS (SELECT granularity, bucket, {_naive_sql('fixed', _INNER, _OUTER)} FROM bk) "
    f"SELECT granularity, bucket, fixed_comparisons * 175.0::DOUBLE + fixed_rotations * 0.125::DOUBLE + fixed_products * 0.375::DOUBLE + "
    f"fixed_plain_products * 0.0009765625::DOUBLE + fixed_additions * 0.00048828125::DOUBLE AS seconds FROM c"
)
def pl_seconds(spark, sf_dir):
    """Time from counts and the price of each operation; prices are sums of powers of two here, so that both engines agree to the bit."""
    made = cost.naive_counts(buckets(spark, sf_dir), SLOTS)
    return made.select("granularity", "bucket", cost.seconds(made, "fixed", _PRICES).alias("seconds"))


@query(
    f"WITH {BK}, c AS (SELECT granularity, CASE WHEN work < {SLOTS} THEN 'tiny' ELSE 'large' END AS size, count(*) AS buckets, "
    f"CAST(sum(2 * {_NB}) AS BIGINT) AS comparisons FROM bk GROUP BY 1, 2) SELECT *, CAST(comparisons AS DOUBLE) / "
    f"sum(comparisons) OVER (PARTITION BY granularity) AS share FROM c"
)
def pl_breakdown(spark, sf_dir):
    """Which buckets the comparisons go to."""
    return experiments.breakdown(buckets(spark, sf_dir), SLOTS)


@query("SELECT unnest([0, 1, 2, 4, 8, 16]) AS step")
def pl_rotation_steps(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in cost.rotation_steps(SLOTS)], "step int")


@query(
    f"WITH {BK}, v AS (SELECT granularity, (CAST(sum(work) AS BIGINT) + {SLOTS - 1}) // {SLOTS} AS vectors FROM bk WHERE {_TINY} GROUP BY 1) "
    f"SELECT granularity, vectors, 3 / vectors::DOUBLE AS by_merges, 4 / vectors::DOUBLE AS by_classes FROM v"
)
def pl_merge_bound(spark, sf_dir):
    made = experiments.grouping(buckets(spark, sf_dir), SLOTS).select("granularity", F.col("greedy").alias("vectors"))
    return made.withColumns(experiments.merge_bound(4, F.col("vectors")))


@query(
    "SELECT workers, wall, 100.0::DOUBLE / wall AS speedup, 100.0::DOUBLE / (workers * wall) AS efficiency, workers * 3600 / wall AS throughput "
    "FROM (VALUES (1::BIGINT, 100.0::DOUBLE), (2, 52.0), (4, 28.0), (8, 16.0)) r(workers, wall)"
)
def pl_scaling(spark, sf_dir):
    return experiments.scaling(spark.createDataFrame([(1, 100.0), (2, 52.0), (4, 28.0), (8, 16.0)], "workers long, wall double"))


@query(
    f"""WITH {BK}, {_TAIL}, s AS (SELECT granularity, count(*) FILTER ({_TINY}) AS tiny, coalesce(sum(work) FILTER ({_TINY}), 0) AS pairs, coalesce(sum({_NB}) FILTER (NOT {_TINY}), 0) AS large FROM bk GROUP BY 1),
     c AS (SELECT granularity, (pairs + {SLOTS - 1}) // {SLOTS} AS packed, tiny, large * 351.68::DOUBLE AS large_s FROM s),
     h AS (SELECT granularity, packed * 350.0::DOUBLE + large_s AS g0, packed * 351.68::DOUBLE + large_s AS g15, tiny * 351.68::DOUBLE + large_s AS alone FROM c),
     sh AS (SELECT granularity, {_INNER} AS inner_, (sum(work) + {SLOTS - 1}) // {SLOTS} AS vectors, sum(work) AS pairs FROM bk WHERE {_TINY} GROUP BY 1, 2),
     gr AS (SELECT granularity, sum(vectors) AS by_shape, (sum(pairs) + {SLOTS - 1}) // {SLOTS} AS greedy FROM sh GROUP BY 1),
     one AS (SELECT arg_min(granularity, struct_pack(x := g0, y := granularity)) AS g0_winner, min(g0) / 3600 AS g0_hours, arg_min(granularity, struct_pack(x := g15, y := granularity)) AS g15_winner, min(g15) / 3600 AS g15_hours,
      arg_min(granularity, struct_pack(x := alone, y := granularity)) AS unpacked_winner, min(alone) / 3600 AS unpacked_hours FROM h),
     gaps AS (SELECT coalesce(max((by_shape - greedy)::DOUBLE / greedy * 100) FILTER (greedy > 0), 0.0) AS grouping_gap FROM gr),
     gains AS (SELECT max(speedup_weighted) AS orientation_gain, max(saved_hours) AS orientation_hours FROM tail)
     SELECT g0_winner, round(g0_hours, 6) AS g0_hours, g15_winner, round(g15_hours, 6) AS g15_hours, unpacked_winner, round(unpacked_hours, 6) AS unpacked_hours, round(grouping_gap, 6) AS grouping_gap,
      round(orientation_gain, 6) AS orientation_gain, round(orientation_hours, 6) AS orientation_hours,
      CASE WHEN g0_winner = 'fine' AND grouping_gap < 5 AND orientation_gain < 1.05 THEN 2 WHEN g0_winner = 'medium' AND g15_winner = 'medium' AND orientation_gain >= 1.05 THEN 1 ELSE 3 END AS scenario FROM one, gaps, gains"""
)
def pl_decision(spark, sf_dir):
    """What packing, grouping and orientation say together of the data's buckets."""
    rows = buckets(spark, sf_dir)
    made = experiments.decision(experiments.packing(rows, SLOTS), experiments.grouping(rows, SLOTS), experiments.orientation_tail(rows, SLOTS))
    return made.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in made.dtypes))


# Published runs: sizes and seconds.
_RUNS = ((256, 512, 1286.99), (256, 512, 1282.56), (512, 256, 1292.07), (512, 256, 1291.91), (1974, 1028, 20961.98), (1974, 1028, 20965.08))


@query(
    "WITH r AS (SELECT n_b::BIGINT AS n_b, m_b::BIGINT AS m_b, wall::DOUBLE AS wall FROM (VALUES " + ", ".join(map(str, _RUNS)) + ") v(n_b, m_b, wall)), "
    "n AS (SELECT *, 2 * least((n_b + 2 * (16384 // m_b) - 1) // (2 * (16384 // m_b)), (m_b + 2 * (16384 // n_b) - 1) // (2 * (16384 // n_b))) AS "
    "comparisons FROM r) "
    "SELECT *, comparisons * 175.0::DOUBLE AS predicted, round(wall / (comparisons * 175.0::DOUBLE), 6) AS ratio FROM n"
)
def pl_measured(spark, sf_dir):
    """Measured times against what their comparisons alone predict."""
    runs = spark.createDataFrame(list(_RUNS), "n_b long, m_b long, wall double")
    return experiments.measured(runs, 32768).withColumn("ratio", F.round("ratio", 6))


# Arithmetic modulo a prime, as an option.


@query(f"WITH {LI} SELECT count(*) % 65537 AS n FROM li")
def z_mod_count(spark, sf_dir):
    return _li(spark, sf_dir).agg(values.mod_p(F.count("*")).alias("n"))


@query(f"WITH {LI} SELECT CAST(sum(price) % 65537 AS BIGINT) AS total FROM li")
def z_mod_sum(spark, sf_dir):
    return _li(spark, sf_dir).agg(values.mod_p(agg.total(F.col("price"))).alias("total"))


@query(f"WITH {LI} SELECT l_orderkey, l_linenumber, CASE WHEN price % 65537 > 32768 THEN price % 65537 - 65537 ELSE price % 65537 END AS v FROM li")
def z_signed_decode(spark, sf_dir):
    return _li(spark, sf_dir).select("l_orderkey", "l_linenumber", values.mod_signed(F.col("price")).alias("v"))


@query(f"WITH {LI} SELECT count(*) FILTER (((qty*1000 - price) % 65537 + 65537) % 65537 > 32768) AS wrapped, count(*) FILTER (qty*1000 < price) AS exact FROM li")
def z_lt_wrap(spark, sf_dir):
    return _li(spark, sf_dir).agg(F.count_if(values.mod_less(F.col("qty") * 1000, F.col("price"))).alias("wrapped"), F.count_if(F.col("qty") * 1000 < F.col("price")).alias("exact"))


@query(
    f"WITH {LI}, x AS (SELECT l_orderkey, l_linenumber, [price, qty, disc, tax] AS a, [qty, disc, price, price] AS b FROM li) "
    f"SELECT l_orderkey, l_linenumber, (a[1]+b[1]) % 65537 AS add_1, ((a[2]-b[2]) % 65537 + 65537) % 65537 AS sub_2, (a[3]*b[3]) % 65537 AS mul_3, a[2] AS "
    f"left_1, a[4] AS right_1 FROM x"
)
def z_vectors(spark, sf_dir):
    x = _li(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array("price", "qty", "disc", "tax").alias("a"), F.array("qty", "disc", "price", "price").alias("b"))
    a, b = F.col("a"), F.col("b")
    return x.select(
        "l_orderkey", "l_linenumber", values.vector_add(a, b)[0].alias("add_1"), values.vector_sub(a, b)[1].alias("sub_2"), values.vector_mul(a, b)[2].alias("mul_3"),
        values.vector_rotate(a, 1)[0].alias("left_1"), values.vector_rotate(a, -1)[0].alias("right_1"),
    )


# Generated fixtures: the same rows in both engines.


@query(
    "WITH a AS (SELECT 10000 + i * 7 % 3650 AS x, i % 100 + 1 AS p FROM range(1974) r(i)), b AS (SELECT 10000 + i * 11 % 3650 AS y, i % 100 + 1 AS q "
    "FROM range(1028) r(i)) SELECT count(*) AS pairs, CAST(sum(p) AS BIGINT) AS sum_a, CAST(sum(q) AS BIGINT) AS sum_b FROM a JOIN b ON abs(x - y) <= 30"
)
def s_date_band(spark, sf_dir):
    a, b = tables.date_band(spark, 1974, 7, "x"), tables.date_band(spark, 1028, 11, "y")
    return bandjoin.band_aggregate(bandjoin.Side(a, "x", "x_payload"), bandjoin.Side(b, "y", "y_payload"), 30)


@query(
    "WITH a AS (SELECT 10000 + i * 7 % 3650 AS x, i % 100 + 1 AS p FROM range(256) r(i)), b AS (SELECT 10000 + i * 11 % 3650 AS y, i % 100 + 1 AS q "
    "FROM range(512) r(i)) "
    "SELECT count(*) AS pairs, CAST(sum(p) AS BIGINT) AS sum_a, CAST(sum(q) AS BIGINT) AS sum_b FROM a JOIN b ON abs(x - y) <= 30"
)
def bj_naive(spark, sf_dir):
    """All rows against all, at the fixture's size: there only to be measured against."""
    a, b = tables.date_band(spark, 256, 7, "x"), tables.date_band(spark, 512, 11, "y")
    return bandjoin.band_aggregate(bandjoin.Side(a, "x", "x_payload"), bandjoin.Side(b, "y", "y_payload"), 30, strategy=bandjoin.NESTED)


@query(
    f"WITH {BK} SELECT granularity, count(*) AS buckets, CAST(sum(n_b) AS BIGINT) AS n, CAST(sum(m_b) AS BIGINT) AS m, CAST(sum(work) AS BIGINT) AS work "
    f"FROM bk WHERE granularity = 'fine' GROUP BY 1"
)
def s_bucket_csv(spark, sf_dir):
    """Bucket sizes written to CSV files and read again."""
    path = f"{session_dir(spark)}/csv-{uuid.uuid4().hex}"
    buckets(spark, sf_dir).filter("granularity = 'fine'").select("n_b", "m_b").write.option("header", True).csv(path)
    read = tables.bucket_sizes(spark, path, "fine")
    return read.groupBy("granularity").agg(F.count("*").alias("buckets"), *(agg.total(F.expr(x)).alias(k) for k, x in (("n", "n_b"), ("m", "m_b"), ("work", "n_b * m_b"))))


@query("SELECT 175.0::DOUBLE AS lt_s, 0.112::DOUBLE AS rot_s, 7.41::DOUBLE AS ct_mb")
def s_calibration(spark, sf_dir):
    """A calibration written and read again."""
    path = f"{session_dir(spark)}/calibration-{uuid.uuid4().hex}"
    tables.write_calibration({"lt_s": cost.COMPARE, "rot_s": cost.ROTATE, "ct_mb": 7.41}, spark, path)
    return tables.calibration(spark, path)


@query(
    f"WITH {BK}, c AS (SELECT n_b, m_b, {_naive_sql('naive', 'n_b', 'm_b')}, {_naive_sql('fixed', _INNER, _OUTER)} FROM bk WHERE granularity = 'coarse'), "
    "r AS (SELECT n_b, m_b, '1-Naive' AS backend, naive_comparisons AS cmp_tot, naive_rotations AS he_rot FROM c UNION ALL "
    "SELECT n_b, m_b, '2-FixedOrient', fixed_comparisons, fixed_rotations FROM c) "
    "SELECT n_b, m_b, backend, cmp_tot, he_rot, 'analytic' AS correct FROM r"
)
def s_results(spark, sf_dir):
    """Counts of the layouts that compare value by value, added to a results file in two runs and read again."""
    path = f"{session_dir(spark)}/results-{uuid.uuid4().hex}"
    made = cost.naive_counts(buckets(spark, sf_dir).filter("granularity = 'coarse'"), SLOTS)
    for backend, prefix in (("1-Naive", "naive"), ("2-FixedOrient", "fixed")):
        run = made.select("n_b", "m_b", F.lit(backend).alias("backend"), F.col(f"{prefix}_comparisons").alias("cmp_tot"), F.col(f"{prefix}_rotations").alias("he_rot"), F.lit("analytic").alias("correct"))
        tables.append_results(run, path)
    read = spark.read.option("header", True).csv(path)
    return read.select(*(F.col(c).cast("long") for c in ("n_b", "m_b")), "backend", *(F.col(c).cast("long") for c in ("cmp_tot", "he_rot")), "correct")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block-keyed band join, and beside it what the cost model says of its buckets."""
    events, is_a, is_b = _clicks_and_purchases(spark, sf_dir)
    sized = cost.best_orientation(cost.tiled(blocking.ladder(events, is_a, is_b, {"medium": F.col("user_id")}), SLOTS), SLOTS)
    totals = sized.agg(F.count("*").alias("buckets"), *(agg.total(F.col(c)).alias(c) for c in ("work", "comparisons", "batches_best")))
    made = bandjoin.band_within(events, is_a, is_b, "day", "payload", 3, ["user_id"])
    return in_longs(made.crossJoin(F.broadcast(totals)))  # one row


@query(
    f"WITH {BK}, j AS (SELECT count(*) AS pairs, CAST(coalesce(sum(a.payload),0) AS BIGINT) AS sum_a, CAST(coalesce(sum(b.payload),0) AS BIGINT) AS sum_b "
    f"FROM ev a JOIN ev b ON a.user_id = b.user_id AND abs(a.day - b.day) <= 3 WHERE a.event_type = 'click' AND b.event_type = 'purchase') "
    f"SELECT j.*, t.* FROM j, (SELECT count(*) AS buckets, CAST(sum(work) AS BIGINT) AS work, CAST(sum(2 * {_NB}) AS BIGINT) AS comparisons, "
    f"CAST(sum(least({_FA}, {_FB})) AS BIGINT) AS batches_best FROM bk WHERE granularity = 'medium') t"
)
def f_flagship(spark, sf_dir):
    return flagship(spark, sf_dir)


def _as_longs(f: Query) -> Query:
    return wraps(f)(lambda spark, sf_dir: in_longs(f(spark, sf_dir)))


QUERIES = {name: _as_longs(f) for name, f in QUERIES.items()}
