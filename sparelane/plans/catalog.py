"""Registered queries of the analytics operators, and the SQL they are checked against.

The SQL says each result in its plain form, so a check compares a mechanism with its definition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import format_ns, ns_per_op, ratio_text
from ..operators import bench_records, bounds, certificates, coded, correlation, factorized, graphs, joint, learned, lookups, quotas, ranges, ranking, regions
from ..sources.tables import cents, table
from . import rules
from .state import stored

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _whole(df: DataFrame, *columns: str) -> DataFrame:
    """Wide decimals as 64-bit integers, which every client compares alike; too large a value is an error."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


# Factorized join-aggregates: returned lineitems against the others, by part.

LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(s, d, "lineitem").select(F.col("l_partkey").alias("g"), F.col("l_quantity").cast("bigint").alias("v"), "l_returnflag")
    return rows.filter("l_returnflag = 'R'").select("g", "v"), rows.filter("l_returnflag <> 'R'").select("g", "v")


PAIRS = """
SELECT a.l_partkey AS g, CAST(sum(CAST(a.l_quantity AS BIGINT) * CAST(b.l_quantity AS BIGINT)) AS BIGINT) AS total
FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey
WHERE a.l_returnflag = 'R' AND b.l_returnflag <> 'R' GROUP BY 1
"""


@query(PAIRS)
def fact_naive(s: SparkSession, d: str) -> DataFrame:
    return _whole(factorized.naive_pair_sum(*_sides(s, d)), "total")


@query(PAIRS)
def fact_sum(s: SparkSession, d: str) -> DataFrame:
    return _whole(rules.pair_sum(*_sides(s, d)), "total")


@query(f"SELECT CAST(sum(total) AS BIGINT) AS total FROM ({PAIRS})")
def fact_total(s: SparkSession, d: str) -> DataFrame:
    return _whole(factorized.total(factorized.factorized_sum(*_sides(s, d))), "total")


@query(PAIRS)
def fact_stored(s: SparkSession, d: str) -> DataFrame:
    """The result from the kept state of the two sides."""
    state = _fact_state(s, d).filter("sum_a <> 0 AND sum_b <> 0")
    return _whole(factorized.result(state), "total")


def _fact_state(s: SparkSession, d: str) -> DataFrame:
    return stored(s, "fact-state", [f"{d}/lineitem.parquet"], lambda: factorized.build_state(*_sides(s, d)))


@query("""
WITH b AS (SELECT l_partkey AS g, sum(CAST(l_quantity AS BIGINT)) AS sb FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
a AS (SELECT l_partkey AS g, sum(CASE l_returnflag WHEN 'A' THEN -CAST(l_quantity AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END) AS sa FROM lineitem GROUP BY 1)
SELECT g, CAST(coalesce(sa, 0) * coalesce(sb, 0) AS BIGINT) AS total FROM a FULL JOIN b USING (g)
""")
def fact_incr(s: SparkSession, d: str) -> DataFrame:
    """State of the two sides, then rows of flag N inserted into A and rows of flag A deleted from it."""
    rows = table(s, d, "lineitem").filter("l_returnflag <> 'R'")
    deltas = rows.select(F.col("l_partkey").alias("g"), F.lit("A").alias("side"), F.col("l_quantity").cast("bigint").alias("v"), F.when(F.col("l_returnflag") == "N", 1).otherwise(-1).alias("sign"))
    return _whole(factorized.result(factorized.apply_deltas(_fact_state(s, d), deltas)), "total")


@query(f"""
WITH a AS (SELECT l_partkey AS g, CAST(l_quantity AS BIGINT) AS v, row_number() OVER (PARTITION BY l_partkey ORDER BY {", ".join(LINE_COLUMNS)}) - 1 AS o FROM lineitem WHERE l_returnflag = 'R'),
b AS (SELECT l_partkey AS g, CAST(l_quantity AS BIGINT) AS v, row_number() OVER (PARTITION BY l_partkey ORDER BY {", ".join(LINE_COLUMNS)}) - 1 AS o FROM lineitem WHERE l_returnflag <> 'R')
SELECT a.g, CAST(sum(a.v * b.v * xor(a.o, b.o)) AS BIGINT) AS total FROM a JOIN b ON a.g = b.g GROUP BY 1
""")
def fact_inseparable(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select(F.col("l_partkey").alias("g"), F.col("l_quantity").cast("bigint").alias("v"), *LINE_COLUMNS)
    a, b = (factorized.with_ordinals(rows.filter(c), LINE_COLUMNS).select("g", "v", "ord") for c in ("l_returnflag = 'R'", "l_returnflag <> 'R'"))
    return _whole(rules.pair_sum(a, b, "xor_product"), "total")


# Ranking: parts of a brand by price and size.


def _items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("id"), cents("p_retailprice").alias("x"), (F.col("p_size").cast("bigint") * 200).alias("y"))


def _weights(s: SparkSession) -> DataFrame:
    return s.range(ranking.SCALE + 1).select(F.col("id").alias("k"))


def _updates(s: SparkSession, d: str) -> DataFrame:
    """Two versions of every 11th part."""
    rows = _items(s, d).filter("id % 11 = 0")
    one = rows.select("id", F.lit(1).cast("bigint").alias("seq"), (F.col("x") + F.col("id") % 5 - 2).alias("x"), "y")
    two = rows.select("id", F.lit(2).cast("bigint").alias("seq"), (F.col("x") + F.col("id") % 3).alias("x"), (F.col("y") - F.col("id") % 2).alias("y"))
    return one.unionByName(two)


ITEMS = "items AS (SELECT p_brand AS g, p_partkey AS id, CAST(round(p_retailprice * 100) AS BIGINT) AS x, CAST(p_size AS BIGINT) * 200 AS y FROM part), ks AS (SELECT range AS k FROM range(201))"
SCORED = "scored AS (SELECT g, k, id, k * x + (200 - k) * y AS s FROM items, ks), ranked AS (SELECT *, row_number() OVER w AS r, lead(s) OVER w - s AS gap FROM scored WINDOW w AS (PARTITION BY g, k ORDER BY s, id))"


@query(f"WITH {ITEMS}, {SCORED} SELECT g, k, id AS winner, s AS score FROM ranked WHERE r = 1")
def rank_brute(s: SparkSession, d: str) -> DataFrame:
    return ranking.winner_only(_items(s, d), _weights(s))


@query(f"WITH {ITEMS}, {SCORED} SELECT g, k, id AS winner, gap FROM ranked WHERE r = 1")
def rank_gap(s: SparkSession, d: str) -> DataFrame:
    return ranking.brute_winner(ranking.two_skyband(_items(s, d)), _weights(s)).select("g", "k", "winner", "gap")


@query(f"WITH {ITEMS}, {SCORED}, best AS (SELECT *, min(s) OVER (PARTITION BY g, k) AS m FROM scored) SELECT g, min(k) AS klo, max(k) AS khi, id FROM best WHERE s = m GROUP BY g, id")
def rank_cells(s: SparkSession, d: str) -> DataFrame:
    return ranking.cells(_items(s, d))


@query(f"WITH {ITEMS}, {SCORED} SELECT g, k, id AS winner FROM ranked WHERE r = 1")
def rank_lookup(s: SparkSession, d: str) -> DataFrame:
    return ranking.lookup(ranking.cells(_items(s, d)), _weights(s))


@query(f"WITH {ITEMS}, {SCORED} SELECT g, k, id AS winner FROM ranked WHERE r = 1")
def rank_hull(s: SparkSession, d: str) -> DataFrame:
    return ranking.lookup(ranking.hull_in_pandas(_items(s, d)), _weights(s))


DRIFT = "upd AS (SELECT id, 1 AS seq, x + id % 5 - 2 AS x, y FROM items WHERE id % 11 = 0 UNION ALL SELECT id, 2, x + id % 3, y - id % 2 FROM items WHERE id % 11 = 0), drift AS (SELECT i.g, coalesce(max(greatest(abs(u.x - i.x), abs(u.y - i.y))), 0) AS drift FROM items i LEFT JOIN upd u ON u.id = i.id GROUP BY 1)"


@query(f"WITH {ITEMS}, {DRIFT} SELECT g, CAST(drift AS BIGINT) AS drift FROM drift")
def rank_drift(s: SparkSession, d: str) -> DataFrame:
    return ranking.drift(_items(s, d), _updates(s, d))


@query(f"""
WITH {ITEMS}, {SCORED}, {DRIFT},
now AS (SELECT g, i.id, coalesce(u.x, i.x) AS x, coalesce(u.y, i.y) AS y FROM items i LEFT JOIN (SELECT * FROM upd WHERE seq = 2) u ON u.id = i.id),
fresh AS (SELECT g, k, id, row_number() OVER (PARTITION BY g, k ORDER BY k * x + (200 - k) * y, id) AS r FROM now, ks)
SELECT f.g, f.k, f.id AS winner, o.gap > 400 * d.drift AS hit FROM fresh f JOIN ranked o ON o.g = f.g AND o.k = f.k AND o.r = 1 JOIN drift d ON d.g = f.g WHERE f.r = 1
""")
def rank_certified(s: SparkSession, d: str) -> DataFrame:
    return ranking.certified(_items(s, d), _updates(s, d), _weights(s))


def _answers(s: SparkSession, d: str) -> DataFrame:
    return stored(s, "rank-answers", [f"{d}/part.parquet"], lambda: ranking.answers(_items(s, d), _weights(s)))


@query(SQL["rank_certified"])
def rank_held(s: SparkSession, d: str) -> DataFrame:
    """The same from kept answers."""
    return ranking.certified(_items(s, d), _updates(s, d), _weights(s), state=_answers(s, d))


@query(f"WITH {ITEMS}, {SCORED}, {DRIFT}, a AS (SELECT o.g, o.gap > 400 * d.drift AS hit FROM ranked o JOIN drift d ON d.g = o.g WHERE o.r = 1) SELECT count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, count(DISTINCT CASE WHEN NOT hit THEN g END) AS rebuilds FROM a")
def rank_counters(s: SparkSession, d: str) -> DataFrame:
    return ranking.counters(ranking.certified(_items(s, d), _updates(s, d), _weights(s), state=_answers(s, d)))


@query(SQL["rank_lookup"])
def rank_stored(s: SparkSession, d: str) -> DataFrame:
    """Lookups in kept cells."""
    return ranking.lookup(stored(s, "rank-cells", [f"{d}/part.parquet"], lambda: ranking.cells(_items(s, d))), _weights(s))


# Regions: orders of a priority, changed by operations.


def _base(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderpriority").alias("region"), F.col("o_orderkey").alias("id"), cents("o_totalprice").alias("base"))


def _log(s: SparkSession, d: str) -> DataFrame:
    """An operation of every event, in the order of their ids: bulk, insert or exception by event_id modulo 3."""
    names = "array('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')"
    e = table(s, d, "events").select("event_id", "user_id", cents("value").alias("c"))
    return e.selectExpr(
        f"{names}[cast(user_id % 5 as int)] AS region",
        "event_id AS seq",
        "CASE event_id % 3 WHEN 0 THEN 'bulk' WHEN 1 THEN 'insert' ELSE 'exception' END AS kind",
        "CASE event_id % 3 WHEN 0 THEN c % 1000 WHEN 1 THEN c + 5000 ELSE c % 300 - 100 END AS k",
        "CASE event_id % 3 WHEN 1 THEN 1000000000 + event_id WHEN 2 THEN user_id * 7 ELSE NULL END AS id",
    )


REGIONS = """
base AS (SELECT o_orderpriority AS region, o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS base FROM orders),
log AS (SELECT ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][CAST(user_id % 5 + 1 AS INT)] AS region, event_id AS seq,
  CASE event_id % 3 WHEN 0 THEN 'bulk' WHEN 1 THEN 'insert' ELSE 'exception' END AS kind,
  CASE event_id % 3 WHEN 0 THEN c % 1000 WHEN 1 THEN c + 5000 ELSE c % 300 - 100 END AS k,
  CASE event_id % 3 WHEN 1 THEN 1000000000 + event_id WHEN 2 THEN user_id * 7 ELSE NULL END AS id
  FROM (SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) AS c FROM events)),
rows_ AS (SELECT region, id, base, -1 AS born FROM base UNION ALL SELECT region, id, k, seq FROM log WHERE kind = 'insert'),
exc AS (SELECT region, id, arg_max(k, seq) AS e FROM log WHERE kind = 'exception' GROUP BY 1, 2),
prices AS (SELECT r.region, r.id, CAST(r.base + coalesce((SELECT sum(k) FROM log l WHERE l.kind = 'bulk' AND l.region = r.region AND l.seq > r.born), 0) + coalesce(e.e, 0) AS BIGINT) AS price
  FROM rows_ r LEFT JOIN exc e ON e.region = r.region AND e.id = r.id)
"""


@query(f"WITH {REGIONS} SELECT region, id, price FROM prices")
def region_price(s: SparkSession, d: str) -> DataFrame:
    return regions.prices(_base(s, d), _log(s, d))


@query(f"WITH {REGIONS}, own AS (SELECT region, sum(e) AS e FROM exc WHERE NOT EXISTS (SELECT 1 FROM rows_ r WHERE r.region = exc.region AND r.id = exc.id) GROUP BY 1) SELECT region, count(*) AS n, CAST(sum(price) AS BIGINT) AS total FROM prices GROUP BY 1")
def region_sum(s: SparkSession, d: str) -> DataFrame:
    # exceptions of ids that no row of the region has don't count
    base, log = _base(s, d), _log(s, d)
    there = regions.members(base, log).select("region", "id")
    mine = log.filter("kind <> 'exception'").unionByName(log.filter("kind = 'exception'").join(there, ["region", "id"], "left_semi"))
    return regions.region_sums(base, mine)


@query(SQL["region_sum"])
def region_stored(s: SparkSession, d: str) -> DataFrame:
    """The same from kept sums of the base rows, and ids only of those that an exception names."""
    base, log = _base(s, d), _log(s, d)
    state = stored(s, "region-sums", [f"{d}/orders.parquet"], lambda: regions.base_sums(base))
    named = log.filter("kind = 'exception'")
    ids = named.select("region", "id").distinct()
    there = base.select("region", "id").join(ids, ["region", "id"], "left_semi").unionAll(log.filter("kind = 'insert'").select("region", "id").join(ids, ["region", "id"], "left_semi"))
    mine = log.filter("kind <> 'exception'").unionByName(named.join(there, ["region", "id"], "left_semi"))
    return regions.sums_of(state, mine)


@query(f"WITH {REGIONS} SELECT region, id, e AS exception FROM exc")
def region_exception(s: SparkSession, d: str) -> DataFrame:
    return regions.exceptions(_log(s, d))


@query("SELECT o_orderpriority AS region, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT) + 107) AS BIGINT) AS total FROM orders GROUP BY 1")
def region_materialized(s: SparkSession, d: str) -> DataFrame:
    return regions.materialized_sums(_base(s, d), [100, 7])


@query(f"WITH {REGIONS}, probes AS (SELECT o_orderpriority AS region, o_orderkey AS id FROM orders, range(2) ) SELECT p.region, count(*) AS n, CAST(sum(p.price) AS BIGINT) AS total FROM prices p JOIN probes q ON q.region = p.region AND q.id = p.id GROUP BY 1")
def region_lookup(s: SparkSession, d: str) -> DataFrame:
    base = _base(s, d)
    probes = base.select("region", "id")
    return regions.lookup_sum(base, _log(s, d), probes.unionAll(probes))


@query(f"WITH {REGIONS} SELECT b.region, count(*) FILTER (WHERE b.base + coalesce((SELECT sum(k) FROM log l WHERE l.kind = 'bulk' AND l.region = b.region), 0) > 20000000) AS n FROM base b GROUP BY 1")
def region_filter(s: SparkSession, d: str) -> DataFrame:
    return regions.filter_counts(_base(s, d), _log(s, d), 20_000_000)


@query("SELECT every, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN every > 0 AND o_orderkey % nullif(every, 0) = 0 THEN 3 ELSE 0 END) AS BIGINT) AS total FROM orders, (VALUES (0), (100), (10), (1)) v(every) GROUP BY 1")
def region_density(s: SparkSession, d: str) -> DataFrame:
    every = s.createDataFrame([(0,), (100,), (10,), (1,)], "every int")
    return regions.density_sums(_base(s, d), every, 3)


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey + 100 > 9000")
def shifted_scan(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders")
    return rules.shifted_filter(rows, "o_orderkey", 100, 9000).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))


# Bounds: event values in no order, parts in key order.


def _values(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("event_id").alias("id"), cents("value").alias("v"))


def _ordered(s: SparkSession, d: str) -> DataFrame:
    """Clustered values: order keys ascend with their id."""
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 3 + 1_000_000).alias("v"))


VALUES = "vals AS (SELECT event_id AS id, CAST(round(value * 100) AS BIGINT) AS v FROM events), ordered AS (SELECT o_orderkey AS id, o_orderkey * 3 + 1000000 AS v FROM orders)"
THRESHOLD, ORDERED_THRESHOLD = 9_000, 1_030_000


@query(f"WITH {VALUES} SELECT id, v, v >> 16 AS hi, v & 65535 AS lo, (v >> 16) << 16 AS at_least, ((v >> 16) << 16) | 65535 AS at_most FROM vals")
def prog_split(s: SparkSession, d: str) -> DataFrame:
    return bounds.split(_values(s, d))


@query(f"WITH {VALUES} SELECT count(*) AS n FROM vals WHERE v > {THRESHOLD}")
def prog_filter(s: SparkSession, d: str) -> DataFrame:
    return bounds.count_above(_values(s, d), THRESHOLD)


@query(f"WITH {VALUES} SELECT count(*) AS n FROM vals WHERE v > {THRESHOLD}")
def prog_bucket(s: SparkSession, d: str) -> DataFrame:
    return bounds.count_above_by_bucket(_values(s, d), THRESHOLD)


@query(f"WITH {VALUES} SELECT id, v FROM vals ORDER BY v, id LIMIT 1")
def prog_argmin(s: SparkSession, d: str) -> DataFrame:
    return bounds.argmin(_values(s, d))


@query(f"WITH {VALUES} SELECT id, v FROM vals ORDER BY v, id LIMIT 1")
def prog_argmin_bounded(s: SparkSession, d: str) -> DataFrame:
    return bounds.argmin_bounded(_values(s, d))


@query(f"WITH {VALUES} SELECT id // 1024 AS block, min(v) AS mn, max(v) AS mx, count(*) AS n FROM vals GROUP BY 1")
def block_summary(s: SparkSession, d: str) -> DataFrame:
    return bounds.summary(_values(s, d))


@query(f"WITH {VALUES} SELECT (SELECT count(*) FROM vals WHERE v > {THRESHOLD}) AS spread, (SELECT count(*) FROM ordered WHERE v > {ORDERED_THRESHOLD}) AS clustered")
def block_filter(s: SparkSession, d: str) -> DataFrame:
    a, b = _values(s, d), _ordered(s, d)
    one = bounds.filter_blocks(a, bounds.summary(a), THRESHOLD).select(F.col("n").alias("spread"))
    return one.join(bounds.filter_blocks(b, bounds.summary(b), ORDERED_THRESHOLD).select(F.col("n").alias("clustered")), F.lit(True))


@query(f"WITH {VALUES}, b AS (SELECT id // 1024 AS block, min(v) AS mn, max(v) AS mx FROM ordered GROUP BY 1) SELECT count(*) FILTER (WHERE mn > {ORDERED_THRESHOLD}) AS accept, count(*) FILTER (WHERE mx <= {ORDERED_THRESHOLD}) AS skip, count(*) FILTER (WHERE mn <= {ORDERED_THRESHOLD} AND mx > {ORDERED_THRESHOLD}) AS scan, count(*) AS blocks FROM b")
def block_pruned(s: SparkSession, d: str) -> DataFrame:
    return bounds.block_counts(bounds.summary(_ordered(s, d)), ORDERED_THRESHOLD)


# Certificates: order keys against line keys.


def _order_keys(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderkey").alias("k"))


def _line_keys(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"))


def _parts_by_flag(s: SparkSession, d: str, flag: str) -> DataFrame:
    return table(s, d, "lineitem").filter(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("k"))


@query("SELECT o_orderkey AS k FROM orders INTERSECT SELECT l_orderkey FROM lineitem")
def cert_intersect(s: SparkSession, d: str) -> DataFrame:
    return certificates.merge_intersect(_order_keys(s, d), _line_keys(s, d))


@query("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def cert_intersect_all(s: SparkSession, d: str) -> DataFrame:
    return certificates.merge_intersect_all(_parts_by_flag(s, d, "R"), _parts_by_flag(s, d, "A"))


@query("SELECT l_orderkey AS k FROM lineitem INTERSECT SELECT o_orderkey FROM orders WHERE o_orderkey % 10000 = 7")
def cert_sparse(s: SparkSession, d: str) -> DataFrame:
    return certificates.sparse_intersect(_order_keys(s, d).filter("k % 10000 = 7"), _line_keys(s, d))


@query("SELECT 'lower, upper' AS sides, true AS disjoint, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'even, odd', false, CAST(0 AS BIGINT)")
def cert_disjoint(s: SparkSession, d: str) -> DataFrame:
    """What extrema say of halves of the keys and of even and odd keys, and the size of both intersections."""
    keys = _order_keys(s, d)
    out = []
    for name, a, b in (("lower, upper", "k < 700", "k >= 700"), ("even, odd", "k % 2 = 0", "k % 2 = 1")):
        said = certificates.disjoint(keys.filter(a), keys.filter(b)).select(F.lit(name).alias("sides"), "disjoint")
        out.append(said.join(certificates.certified_intersect(keys.filter(a), keys.filter(b)).agg(F.count("*").alias("n")), F.lit(True)))
    return out[0].unionAll(out[1])


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1")
def cert_interleaved(s: SparkSession, d: str) -> DataFrame:
    keys = _order_keys(s, d)
    return certificates.certified_intersect(keys.filter("k % 2 = 0"), keys.filter("k % 2 = 1"))


@query("SELECT l_orderkey AS k, o_totalprice AS price, l_partkey AS part FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def cert_join(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    return rules.inner_join(a, table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("part")), "k")


# Graph: parts bought in one order.


def _bought(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select("l_orderkey", "l_partkey")
    other = rows.select("l_orderkey", F.col("l_partkey").alias("v"))
    return graphs.simple_edges(rows.withColumnRenamed("l_partkey", "u").join(other, "l_orderkey").filter("u < v"))


EDGES = "edges AS (SELECT DISTINCT a.l_partkey AS u, b.l_partkey AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"
TRIANGLES = f"WITH {EDGES} SELECT count(*) AS n FROM edges x JOIN edges y ON x.v = y.u JOIN edges z ON z.u = x.u AND z.v = y.v"


@query(f"WITH {EDGES} SELECT u, v FROM edges")
def graph_edges(s: SparkSession, d: str) -> DataFrame:
    return _bought(s, d)


@query(TRIANGLES)
def tri_neighbors(s: SparkSession, d: str) -> DataFrame:
    return graphs.triangles_by_neighbours(_bought(s, d))


@query(TRIANGLES)
def tri_binary(s: SparkSession, d: str) -> DataFrame:
    return graphs.triangles_binary(_bought(s, d))


@query(TRIANGLES)
def tri_choice(s: SparkSession, d: str) -> DataFrame:
    return rules.triangles(_bought(s, d))


@query(f"WITH {EDGES} SELECT count(*) AS n FROM edges x JOIN edges y ON x.v = y.u")
def tri_intermediates(s: SparkSession, d: str) -> DataFrame:
    return graphs.intermediates(_bought(s, d))


@query(f"WITH {EDGES}, deg AS (SELECT x, count(*) AS c FROM (SELECT u AS x FROM edges UNION ALL SELECT v FROM edges) GROUP BY 1) SELECT CAST(sum(c * c) AS BIGINT) AS n FROM deg")
def tri_twohop(s: SparkSession, d: str) -> DataFrame:
    return graphs.two_hop_estimate(_bought(s, d))


# Quotas: purchases as requests.

STOCK, SHARDS = 900, 8


def _requests(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("seq"), (F.col("user_id") % SHARDS).alias("shard"))


REQUESTS = f"req AS (SELECT event_id AS seq, user_id % {SHARDS} AS shard FROM events WHERE event_type = 'purchase')"
QUOTA = f"CASE WHEN shard = {SHARDS - 1} THEN {STOCK - STOCK // SHARDS * (SHARDS - 1)} ELSE {STOCK // SHARDS} END"


@query(f"WITH {REQUESTS} SELECT seq, CASE WHEN row_number() OVER (ORDER BY seq) <= {STOCK} THEN 'ok' ELSE 'soldout' END AS outcome FROM req")
def quota_global(s: SparkSession, d: str) -> DataFrame:
    return quotas.reserve_global(_requests(s, d), STOCK)


@query(f"WITH {REQUESTS} SELECT seq, shard, CASE WHEN row_number() OVER (PARTITION BY shard ORDER BY seq) <= {QUOTA} THEN 'ok' ELSE 'soldout' END AS outcome FROM req")
def quota_sharded(s: SparkSession, d: str) -> DataFrame:
    return quotas.reserve_sharded(_requests(s, d), quotas.split_stock(s, STOCK, SHARDS))


@query(f"SELECT range AS shard, CAST(CASE WHEN range = {SHARDS - 1} THEN {STOCK - STOCK // SHARDS * (SHARDS - 1)} ELSE {STOCK // SHARDS} END AS BIGINT) AS quota FROM range({SHARDS})")
def quota_split(s: SparkSession, d: str) -> DataFrame:
    return quotas.split_stock(s, STOCK, SHARDS)


def _replay(held_back: int, restock: int) -> str:
    """The log replayed a request at a time: what each shard has, and what the coordinator has."""
    per = (STOCK - held_back) // SHARDS
    have = ", ".join(str(per if i < SHARDS - 1 else STOCK - held_back - per * (SHARDS - 1)) for i in range(SHARDS))
    return f"""
WITH RECURSIVE {REQUESTS}, log AS (SELECT row_number() OVER (ORDER BY seq) AS i, seq, shard FROM req),
run AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS shard, CAST([{have}] AS BIGINT[]) AS have, CAST({held_back} AS BIGINT) AS pool, '' AS outcome
  UNION ALL
  SELECT l.i, l.seq, l.shard,
         have[1:l.shard] || [CASE WHEN have[l.shard + 1] > 0 THEN have[l.shard + 1] - 1 ELSE greatest(least({restock}, pool) - 1, 0) END] || have[l.shard + 2:],
         CASE WHEN have[l.shard + 1] > 0 THEN pool ELSE pool - least({restock}, pool) END,
         CASE WHEN have[l.shard + 1] > 0 OR pool > 0 THEN 'ok' ELSE 'soldout' END
  FROM run JOIN log l ON l.i = run.i + 1)
SELECT seq, shard, outcome FROM run WHERE i > 0
"""


@query(_replay(STOCK // 2, 16))
def quota_restock(s: SparkSession, d: str) -> DataFrame:
    return quotas.reserve_restocked(_requests(s, d), STOCK, SHARDS, restock=16, held_back=STOCK // 2)


@query(f"WITH {REQUESTS}, o AS (SELECT seq, shard, row_number() OVER (PARTITION BY shard ORDER BY seq) <= {QUOTA} AS ok FROM req), spare AS (SELECT {STOCK} - count(*) FILTER (WHERE ok) AS n FROM o), t AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY seq) AS r FROM o) SELECT seq, shard, CASE WHEN ok OR r <= n THEN 'ok' ELSE 'soldout' END AS outcome FROM t, spare")
def quota_drained(s: SparkSession, d: str) -> DataFrame:
    shares = quotas.split_stock(s, STOCK, SHARDS)
    return quotas.drain(quotas.reserve_sharded(_requests(s, d), shares), shares)


@query(f"WITH {REQUESTS}, o AS (SELECT row_number() OVER (PARTITION BY shard ORDER BY seq) <= {QUOTA} AS ok FROM req) SELECT count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS soldout, {STOCK} - count(*) FILTER (WHERE ok) AS stranded FROM o")
def quota_accounting(s: SparkSession, d: str) -> DataFrame:
    return quotas.accounting(quotas.reserve_sharded(_requests(s, d), quotas.split_stock(s, STOCK, SHARDS)), STOCK)


# Coded columns: price and quantity of a line, shifted to both signs.


def _coded_sources(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (cents("l_extendedprice") - 5_000_000).alias("a"), cents("l_quantity").alias("b"))


AB = "ab AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) - 5000000 AS a, CAST(round(l_quantity * 100) AS BIGINT) AS b FROM lineitem)"


@query(f"WITH {AB} SELECT *, CAST(a + b AS BIGINT) AS c FROM ab")
def coded_build(s: SparkSession, d: str) -> DataFrame:
    return _whole(coded.build(_coded_sources(s, d)), "c")


@query(f"WITH {AB} SELECT l_orderkey, l_linenumber, l_partkey, a, b FROM ab")
def coded_recover(s: SparkSession, d: str) -> DataFrame:
    return coded.recover_a(coded.build(_coded_sources(s, d)).drop("a")).select("l_orderkey", "l_linenumber", "l_partkey", "a", "b")


@query(f"WITH {AB} SELECT CAST(sum(a) AS BIGINT) AS checksum FROM ab")
def coded_checksum(s: SparkSession, d: str) -> DataFrame:
    return coded.checksum(coded.recover_a(coded.build(_coded_sources(s, d)).drop("a")))


@query(f"WITH {AB} SELECT CAST(sum(a + b) AS BIGINT) AS from_code, CAST(sum(a + b) AS BIGINT) AS from_sources FROM ab")
def coded_sum(s: SparkSession, d: str) -> DataFrame:
    rows = coded.build(_coded_sources(s, d))
    one = rules.sum_of(rows, ["a", "b"]).select(F.col("total").alias("from_code"))
    return _whole(one.join(coded.sum_from_sources(rows).select(F.col("total").alias("from_sources")), F.lit(True)), "from_code", "from_sources")


@query(f"WITH {AB} SELECT CAST(coalesce(sum(a + b), 0) AS BIGINT) AS total FROM ab WHERE a + b > 1000000")
def coded_filter_sum(s: SparkSession, d: str) -> DataFrame:
    return _whole(coded.filter_sum(coded.build(_coded_sources(s, d)), 1_000_000), "total")


@query(f"WITH {AB} SELECT CAST(coalesce(sum(a), 0) AS BIGINT) AS total FROM ab WHERE a > 1000000")
def coded_a_only(s: SparkSession, d: str) -> DataFrame:
    return _whole(coded.filter_sum_a(coded.build(_coded_sources(s, d)), 1_000_000), "total")


# Learned index over line keys (with gaps), and lookups.


def _probes(s: SparkSession, d: str) -> DataFrame:
    """Keys that are there, that aren't, and repeats."""
    return table(s, d, "events").select(F.col("event_id").alias("q"), (F.col("user_id") * 100 + F.col("event_id") % 7).alias("k"))


#: A segment ends at the first key of its span that its line misses.
SEGMENTS = f"""
WITH RECURSIVE k AS (SELECT DISTINCT l_orderkey AS k FROM lineitem),
p AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS pos, CAST(floor(k / {learned.SPAN}) AS BIGINT) AS cell FROM k),
lines AS (SELECT *, coalesce(1.0::DOUBLE / (lead(k) OVER (PARTITION BY cell ORDER BY k) - k), 0.0::DOUBLE) AS slope FROM p),
segs AS (
  SELECT cell, min(k) AS key0 FROM p GROUP BY cell
  UNION ALL
  SELECT s.cell, min(p.k) FROM segs s JOIN lines l ON l.k = s.key0
  JOIN p ON p.cell = s.cell AND p.k > s.key0 AND abs(round_even((p.k - l.k) * l.slope, 0) + l.pos - p.pos) > 32
  GROUP BY s.cell),
ends AS (SELECT *, lead(key0) OVER (PARTITION BY cell ORDER BY key0) AS key1 FROM segs)
SELECT e.cell, e.key0, l.pos AS pos0, l.slope, CAST(max(abs(round_even((p.k - l.k) * l.slope, 0) + l.pos - p.pos)) AS BIGINT) AS err, count(*) AS n
FROM ends e JOIN lines l ON l.k = e.key0 JOIN p ON p.cell = e.cell AND p.k >= e.key0 AND (e.key1 IS NULL OR p.k < e.key1)
GROUP BY ALL
"""


@query(SEGMENTS)
def pgm_segments(s: SparkSession, d: str) -> DataFrame:
    return learned.segments(learned.positions(_line_keys(s, d)))


@query("WITH p AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS pos FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem)), q AS (SELECT event_id AS q, user_id * 100 + event_id % 7 AS k FROM events) SELECT q, k, pos FROM q JOIN p USING (k)")
def pgm_lookup(s: SparkSession, d: str) -> DataFrame:
    placed = learned.positions(_line_keys(s, d))
    return learned.lookup(_probes(s, d), placed, learned.segments(placed))


@query(SQL["pgm_lookup"])
def pgm_stored(s: SparkSession, d: str) -> DataFrame:
    """Lookups in kept positions and segments."""
    source = [f"{d}/lineitem.parquet"]
    placed = stored(s, "pgm-positions", source, lambda: learned.positions(_line_keys(s, d)))
    return learned.lookup(_probes(s, d), placed, stored(s, "pgm-segments", source, lambda: learned.segments(placed)))


@query("WITH q AS (SELECT event_id AS q, user_id * 100 + event_id % 7 AS k FROM events) SELECT q, k, o_totalprice AS price FROM q JOIN orders ON o_orderkey = k")
def key_lookup(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    return lookups.found(t, _probes(s, d), "merge").select("q", "k", "price")


@query("SELECT count(*) AS n, CAST(coalesce(sum(CAST(round(l_extendedprice * 100) AS BIGINT)), 0) AS BIGINT) AS total FROM lineitem WHERE CAST(round(l_extendedprice * 100) AS BIGINT) > 250000 AND l_quantity > 0")
def scan_filter_agg(s: SparkSession, d: str) -> DataFrame:
    return lookups.scan(table(s, d, "lineitem").select(cents("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty")), 250_000)


@query("WITH q AS (SELECT user_id * 100 + event_id % 7 AS k FROM events) SELECT count(*) AS n, coalesce(bit_xor(k), 0) AS ids FROM q JOIN orders ON o_orderkey = k")
def lookup_batch(s: SparkSession, d: str) -> DataFrame:
    return lookups.id_xor(table(s, d, "orders").select(F.col("o_orderkey").alias("k")), _probes(s, d).select("k"))


@query("WITH q AS (SELECT user_id * 100 + event_id % 7 AS k FROM events) SELECT count(*) AS n, CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)), 0) AS BIGINT) AS total FROM q JOIN orders ON o_orderkey = k")
def lookup_payload(s: SparkSession, d: str) -> DataFrame:
    return lookups.payload_sum(table(s, d, "orders").select(F.col("o_orderkey").alias("k"), cents("o_totalprice").alias("payload")), _probes(s, d).select("k"))


@query("SELECT row_bytes, gbit, count(*) * row_bytes * 8 / (gbit * 1e9) * 1000 AS ms FROM orders, (VALUES (256), (4096)) a(row_bytes), (VALUES (1), (10)) b(gbit) GROUP BY 1, 2")
def payload_bound(s: SparkSession, d: str) -> DataFrame:
    sizes = s.createDataFrame([(r, g) for r in (256, 4096) for g in (1, 10)], "row_bytes int, gbit int")
    return lookups.payload_bounds(table(s, d, "orders"), sizes)


# Ranges over line keys, which repeat.


def _ranges(s: SparkSession) -> DataFrame:
    return s.range(30).select(F.col("id").alias("q"), (F.col("id") * 487).alias("lo"), (F.col("id") * 487 + 5000).alias("hi"))


def _inserted(s: SparkSession) -> DataFrame:
    return s.range(300).select((F.col("id") * 41 % 9001).alias("k"))


RANGES = "qs AS (SELECT range AS q, range * 487 AS lo, range * 487 + 5000 AS hi FROM range(30)), ks AS (SELECT l_orderkey AS k FROM lineitem), more AS (SELECT k FROM ks UNION ALL SELECT range * 41 % 9001 FROM range(300))"
COUNTS = f"WITH {RANGES} SELECT q, (SELECT count(*) FROM ks WHERE k >= lo AND k < hi) AS n FROM qs"
MORE_COUNTS = f"WITH {RANGES} SELECT q, (SELECT count(*) FROM more WHERE k >= lo AND k < hi) AS n FROM qs"


@query(COUNTS)
def range_rescan(s: SparkSession, d: str) -> DataFrame:
    return ranges.rescan(_line_keys(s, d), _ranges(s))


@query(MORE_COUNTS)
def range_private(s: SparkSession, d: str) -> DataFrame:
    q = _ranges(s)
    return ranges.private_counts(ranges.insert_private(ranges.matches(_line_keys(s, d), q), q, _inserted(s)), q)


@query(COUNTS)
def range_shared(s: SparkSession, d: str) -> DataFrame:
    return ranges.shared_counts(ranges.shared_state(_line_keys(s, d)), _ranges(s))


@query(COUNTS)
def range_stored(s: SparkSession, d: str) -> DataFrame:
    """Counts from kept cells of the shared state."""
    source = [f"{d}/lineitem.parquet"]
    keys = stored(s, "range-cells", source, lambda: ranges.cells(ranges.shared_state(_line_keys(s, d))))
    return ranges.stored_counts(keys, stored(s, "range-sums", source, lambda: ranges.cell_sums(keys)), _ranges(s))


@query(MORE_COUNTS)
def range_insert(s: SparkSession, d: str) -> DataFrame:
    return ranges.shared_counts(ranges.insert_shared(ranges.shared_state(_line_keys(s, d)), _inserted(s)), _ranges(s))


# Joint catalog: ranked parts with bulk changes of a brand and exceptions of single parts.


def _exceptions(s: SparkSession, d: str) -> DataFrame:
    return _items(s, d).filter("id % 97 = 0").select("id", F.col("id").alias("seq"), (F.col("id") % 400 - 900).alias("k"))


def _brand_adjustments(s: SparkSession, d: str) -> DataFrame:
    return _items(s, d).groupBy("g").agg((F.count("*") * 1250).alias("adj"))


JOINT = f"{ITEMS}, adj AS (SELECT g, count(*) * 1250 AS adj FROM items GROUP BY 1), priced AS (SELECT i.g, id, x + adj + CASE WHEN id % 97 = 0 THEN id % 400 - 900 ELSE 0 END AS x, y FROM items i JOIN adj USING (g)), ranked AS (SELECT g, k, id, row_number() OVER (PARTITION BY g, k ORDER BY k * x + (200 - k) * y, id) AS r FROM priced, ks)"


@query(f"WITH {JOINT} SELECT g, k, id AS winner FROM ranked WHERE r = 1")
def joint_brute(s: SparkSession, d: str) -> DataFrame:
    return joint.brute(_items(s, d), _exceptions(s, d), _brand_adjustments(s, d), _weights(s))


@query(f"WITH {JOINT} SELECT g, k, id AS winner FROM ranked WHERE r = 1")
def joint_winner(s: SparkSession, d: str) -> DataFrame:
    return joint.winners(_items(s, d), _exceptions(s, d), _weights(s))


@query(f"WITH {JOINT}, best AS (SELECT g, id, k, k * x + (200 - k) * y AS s, min(k * x + (200 - k) * y) OVER (PARTITION BY g, k) AS m FROM priced, ks) SELECT g, min(k) AS klo, max(k) AS khi, id FROM best WHERE s = m GROUP BY g, id")
def joint_exception(s: SparkSession, d: str) -> DataFrame:
    """The cells that exceptions make."""
    return ranking.cells(joint.with_exceptions(_items(s, d), _exceptions(s, d)))


def _mixed_log(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """200 queries; an exception every 50 of them, on the parts of one key modulo 13."""
    asked = s.range(200).select(F.col("id").alias("q"), (F.col("id") * 37 % 201).alias("k"))
    seqs = s.createDataFrame([(50, 1), (100, 5), (150, 9)], "seq bigint, m bigint")
    rows = _items(s, d).select("id").join(F.broadcast(seqs), F.col("id") % 13 == F.col("m")).select("id", "seq", (-F.col("seq") * 40).alias("k"))
    return rows, asked


MIXED = f"WITH {ITEMS}, asked AS (SELECT range AS q, range * 37 % 201 AS k FROM range(200)), ex AS (SELECT * FROM (VALUES (50, 1), (100, 5), (150, 9)) v(seq, m)), priced AS (SELECT g, q, asked.k, id, x + (q // 20) * 100 + coalesce((SELECT arg_max(-seq * 40, seq) FROM ex WHERE ex.seq <= q AND id % 13 = m), 0) AS x, y FROM items, asked), r AS (SELECT g, q, k, id, row_number() OVER (PARTITION BY g, q ORDER BY k * x + (200 - k) * y, id) AS r FROM priced) SELECT g, q, k, id AS winner FROM r WHERE r = 1"


@query(MIXED)
def joint_mixed(s: SparkSession, d: str) -> DataFrame:
    return joint.mixed(_items(s, d), *_mixed_log(s, d))


@query(MIXED)
def joint_mixed_brute(s: SparkSession, d: str) -> DataFrame:
    return joint.mixed_brute(_items(s, d), *_mixed_log(s, d), bulk_every=20, bulk=100)


def _jitter(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """200 queries; every 40 of them the parts of a key modulo 11 get dearer, some more than once."""
    asked = s.range(200).select(F.col("id").alias("q"), (F.col("id") * 37 % 201).alias("k"))
    seqs = s.createDataFrame([(0, 3), (40, 3), (80, 7), (120, 3), (160, 2)], "seq bigint, m bigint")
    return _items(s, d).select("id").join(F.broadcast(seqs), F.col("id") % 11 == F.col("m")).select("id", "seq", (F.col("seq") * 10 + 500 + F.col("id") % 5).alias("k")), asked


@query(f"WITH {ITEMS}, asked AS (SELECT range AS q, range * 37 % 201 AS k FROM range(200)), ev AS (SELECT * FROM (VALUES (0, 3), (40, 3), (80, 7), (120, 3), (160, 2)) v(seq, m)), up AS (SELECT q, m, sum(seq * 10 + 500) AS s, count(*) AS c FROM asked, ev WHERE seq <= q GROUP BY 1, 2), priced AS (SELECT g, a.q, a.k, id, x + coalesce(s + c * (id % 5), 0) AS x, y FROM items CROSS JOIN asked a LEFT JOIN up ON up.q = a.q AND up.m = id % 11), r AS (SELECT g, q, k, id, row_number() OVER (PARTITION BY g, q ORDER BY k * x + (200 - k) * y, id) AS r FROM priced) SELECT g, q, k, id AS winner FROM r WHERE r = 1")
def joint_jitter(s: SparkSession, d: str) -> DataFrame:
    """The control: changes of single rows, which no certificate covers."""
    return joint.jittered(_items(s, d), *_jitter(s, d))


# Correlation: retail price by part key, and two columns that have none.


def _xy(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select((F.col("p_partkey") - 1).alias("id"), F.col("p_partkey").alias("x"), cents("p_retailprice").alias("y"))


XY = "xy AS (SELECT p_partkey - 1 AS id, p_partkey AS x, CAST(round(p_retailprice * 100) AS BIGINT) AS y FROM part)"
BELOW = 93_000


@query(f"WITH {XY} SELECT 'part' AS name, round(regr_intercept(y, x), 4) AS intercept, round(regr_slope(y, x), 6) AS slope FROM xy UNION ALL SELECT 'line', round(regr_intercept(l_quantity, l_extendedprice), 4), round(regr_slope(l_quantity, l_extendedprice), 6) FROM lineitem")
def corr_fit(s: SparkSession, d: str) -> DataFrame:
    line = table(s, d, "lineitem").select(F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
    each = [correlation.fit(df).select(F.lit(name).alias("name"), F.round("intercept", 4).alias("intercept"), F.round("slope", 6).alias("slope")) for name, df in (("part", _xy(s, d)), ("line", line))]
    return each[0].unionAll(each[1])


@query(f"WITH {XY} SELECT id, x, y - (90000 + 10 * x) AS resid FROM xy")
def corr_encode(s: SparkSession, d: str) -> DataFrame:
    """Under the given line y = 90000 + 10 x."""
    return correlation.encode(_xy(s, d), (90_000, 10 * correlation.DEN))


@query(f"WITH {XY} SELECT count(*) AS n FROM xy WHERE y < {BELOW}")
def corr_filter(s: SparkSession, d: str) -> DataFrame:
    return correlation.count_below(_xy(s, d), BELOW)


def _model(s: SparkSession, d: str) -> tuple[DataFrame, tuple[int, int], tuple[int, int]]:
    rows = _xy(s, d)
    model = correlation.whole_model(rows)
    encoded = correlation.encode(rows, model)
    r = correlation.residual_range(encoded).first()
    return encoded, model, (r.rmin or 0, r.rmax or 0)


@query(f"WITH {XY} SELECT count(*) AS n FROM xy WHERE y < {BELOW}")
def corr_prune(s: SparkSession, d: str) -> DataFrame:
    encoded, model, span = _model(s, d)
    return correlation.count_below_pruned(encoded, model, span, BELOW).select("n")


@query(f"WITH {XY} SELECT count(*) AS n FROM xy WHERE y < {BELOW}")
def corr_stored(s: SparkSession, d: str) -> DataFrame:
    """The count from kept residuals and their range."""
    source = [f"{d}/part.parquet"]
    line = stored(s, "corr-model", source, lambda: s.createDataFrame([correlation.whole_model(_xy(s, d))], "a bigint, b bigint")).first()
    model = (line.a, line.b)
    encoded = stored(s, "corr-residuals", source, lambda: correlation.encode(_xy(s, d), model))
    r = stored(s, "corr-range", source, lambda: correlation.residual_range(encoded)).first()
    return correlation.count_below_pruned(encoded, model, (r.rmin or 0, r.rmax or 0), BELOW).select("n")


@query(f"WITH {XY} SELECT id, x, y FROM xy WHERE y < {BELOW}")
def corr_implied(s: SparkSession, d: str) -> DataFrame:
    """The filter with the bound on x that the model implies, which reaches the scan."""
    _, model, span = _model(s, d)
    return rules.filter_below(_xy(s, d), BELOW, model, span)


@query(f"WITH {XY} SELECT id, x, y FROM xy")
def corr_decode(s: SparkSession, d: str) -> DataFrame:
    encoded, model, _ = _model(s, d)
    return correlation.decode(encoded, model)


@query(f"WITH {XY} SELECT count(*) AS n FROM xy WHERE y < {BELOW}")
def corr_blocks(s: SparkSession, d: str) -> DataFrame:
    rows = _xy(s, d)
    return bounds.filter_blocks(rows, bounds.summary(rows, 64, "y"), BELOW, 64, "y", below=True)


# Benchmark records, from event values as times.

TIMES = "times AS (SELECT event_type AS experiment, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS variant, CAST(round(value * 100) AS BIGINT) AS ns FROM events)"


def _times(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("event_type").alias("experiment"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("variant"), cents("value").alias("ns"))


def _rank(p: float) -> str:
    return f"list_sort(list(ns))[CAST(floor((count(*) - 1) * {p} + 0.5) AS BIGINT) + 1]"


@query(f"WITH {TIMES} SELECT experiment, variant, {_rank(0.9)} AS value FROM times GROUP BY 1, 2")
def bench_percentile(s: SparkSession, d: str) -> DataFrame:
    return bench_records.percentiles(_times(s, d), 0.9)


@query(f"WITH {TIMES} SELECT experiment, variant, min(ns) AS min_ns, {_rank(0.5)} AS median_ns, {_rank(0.99)} AS p99_ns, avg(ns) AS mean_ns, count(*) AS iters FROM times GROUP BY 1, 2")
def bench_summary(s: SparkSession, d: str) -> DataFrame:
    return bench_records.summarize(_times(s, d))


def _records(s: SparkSession, d: str) -> DataFrame:
    return bench_records.summarize(_times(s, d)).select("experiment", "variant", F.lit(1).alias("n"), F.lit("{}").alias("params"), "median_ns")


@query(f"WITH {TIMES}, m AS (SELECT experiment, variant, {_rank(0.5)} AS t FROM times GROUP BY 1, 2) SELECT a.experiment, 'even' AS before, 'odd' AS after, 1 AS n, '{{}}' AS params, a.t / b.t AS speedup FROM m a JOIN m b ON a.experiment = b.experiment AND a.variant = 'even' AND b.variant = 'odd' WHERE a.t > 0 AND b.t > 0")
def bench_speedup(s: SparkSession, d: str) -> DataFrame:
    records = _records(s, d)
    pairs = [(x, "even", "odd") for x in ("click", "view", "purchase", "signup", "login", "logout", "error", "search", "add_to_cart")]
    return bench_records.speedups(records, pairs)


@query(f"WITH {TIMES}, m AS (SELECT experiment, variant, {_rank(0.5)} AS t FROM times GROUP BY 1, 2) SELECT experiment, variant, t AS median_ns, CASE WHEN t >= 1e9 THEN printf('%.3f s', t / 1e9) WHEN t >= 1e6 THEN printf('%.3f ms', t / 1e6) WHEN t >= 1e3 THEN printf('%.3f µs', t / 1e3) ELSE printf('%.0f ns', t * 1.0) END AS said, t / 8.0 AS per_op, printf('%.2f times slower', t / 1.0) AS against_one FROM m WHERE t >= 1")
def bench_format(s: SparkSession, d: str) -> DataFrame:
    rows = _records(s, d).filter("median_ns >= 1")
    return rows.select("experiment", "variant", "median_ns", format_ns("median_ns").alias("said"), ns_per_op("median_ns", F.lit(8)).alias("per_op"), ratio_text("median_ns", F.lit(1)).alias("against_one"))


@query(f"WITH {TIMES}, m AS (SELECT experiment, variant, {_rank(0.5)} AS t FROM times GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY t, variant) AS r FROM m WHERE t > 0) SELECT experiment, variant, t AS median_ns FROM r WHERE r = 1")
def bench_best(s: SparkSession, d: str) -> DataFrame:
    return bench_records.best(_records(s, d))
