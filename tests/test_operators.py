"""Operators on edge cases and generated inputs, each against a plain Python form."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from sparelane.functions import scalars
from sparelane.operators import bench_records, bounds, certificates, coded, correlation, factorized, graphs, joint, learned, lookups, quotas, ranges, ranking, regions
from sparelane.plans import ranks, rules
from sparelane.sources import generators, records


def one(df):
    return df.first()[0]


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_factorized_state_through_inserts_deletes_and_updates(spark):
    r = random.Random(1)
    a, b = ([(r.randrange(5), r.randrange(-9, 50)) for _ in range(30)] for _ in range(2))
    deltas = [(g, "A", v, -1) for g, v in a[:4]] + [(g, "B", v, -1) for g, v in b[:3]] + [(r.randrange(7), r.choice("AB"), r.randrange(50), 1) for _ in range(40)]
    frame = lambda rows: spark.createDataFrame(rows, "g int, v bigint")
    state = factorized.apply_deltas(factorized.build_state(frame(a), frame(b)), spark.createDataFrame(deltas, "g int, side string, v bigint, sign int"))
    sides = {"A": a, "B": b}
    sums = {s: {} for s in "AB"}
    for s in "AB":
        for g, v in sides[s]:
            sums[s][g] = sums[s].get(g, 0) + v
    for g, s, v, sign in deltas:
        sums[s][g] = sums[s].get(g, 0) + sign * v
    expected = {(g, sums["A"].get(g, 0) * sums["B"].get(g, 0)) for g in {*sums["A"], *sums["B"]}}
    assert {(g, int(t)) for g, t in as_set(factorized.result(state))} == expected


def test_factorized_equals_naive_and_the_xor_term_does_not_factor(spark):
    rows = generators.groups(spark, 6, 20)
    a, b = (rows.filter(F.col("side") == s).select("g", "v", "ord") for s in "AB")
    assert as_set(factorized.naive_pair_sum(a, b)) == as_set(rules.pair_sum(a, b))
    left, right = a.collect(), b.collect()
    expected = {}
    for x in left:
        for y in right:
            if x.g == y.g:
                expected[x.g] = expected.get(x.g, 0) + x.v * y.v * (x.ord ^ y.ord)
    assert {(g, int(t)) for g, t in as_set(rules.pair_sum(a, b, "xor_product"))} == set(expected.items())
    with pytest.raises(ValueError):
        rules.pair_sum(a, b, "ratio")
    empty = a.limit(0)
    assert factorized.factorized_sum(empty, b).count() == 0
    assert one(factorized.total(factorized.factorized_sum(empty, b))) == 0


def brute(items, scale=ranking.SCALE):
    out = {}
    for k in range(scale + 1):
        for g in {i[0] for i in items}:
            scored = sorted((k * x + (scale - k) * y, i) for gg, i, x, y in items if gg == g)
            out[g, k] = (scored[0][1], scored[1][0] - scored[0][0] if len(scored) > 1 else None)
    return out


SHAPES = {
    "convex": [("c", i, i * i, (12 - i) ** 2) for i in range(13)],
    "ties": [("t", 5, 10, 0), ("t", 3, 12, 0), ("t", 4, 10, 0), ("t", 1, 0, 10), ("t", 2, 0, 14), ("t", 9, 5, 5)],
    "one": [("o", 7, 3, 4)],
    "same": [("s", i, 4, 4) for i in (8, 6, 7)],
    "collinear": [("l", i, i, 20 - i) for i in range(9)],
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_cells_answer_every_weight_like_brute_force(spark, shape):
    rows = SHAPES[shape]
    items = spark.createDataFrame(rows, "g string, id bigint, x bigint, y bigint")
    weights = spark.range(ranking.SCALE + 1).select(F.col("id").alias("k"))
    expected = brute(rows)
    for cells in (ranking.cells(items), ranking.hull_in_pandas(items)):
        assert as_set(ranking.lookup(cells, weights)) == {(g, k, w) for (g, k), (w, _) in expected.items()}
    gaps = ranking.brute_winner(ranking.two_skyband(items), weights)
    assert as_set(gaps.select("g", "k", "winner", "gap")) == {(g, k, w, gap) for (g, k), (w, gap) in expected.items()}


def test_certificate_is_exact_next_to_a_cell_boundary(spark):
    """A (0, 1) against B (1, 0): raising B's price by a tenth moves the boundary, and the weight .48 must go to A."""
    items = spark.createDataFrame([("g", 1, 0, 1000), ("g", 2, 1000, 0)], "g string, id bigint, x bigint, y bigint")
    weights = spark.range(201).select(F.col("id").alias("k"))
    updates = spark.createDataFrame([(2, 1, 1100, 0)], "id bigint, seq bigint, x bigint, y bigint")
    got = {r.k: (r.winner, r.hit) for r in ranking.certified(items, updates, weights).collect()}
    now = brute([("g", 1, 0, 1000), ("g", 2, 1100, 0)])
    assert {k: w for k, (w, _) in got.items()} == {k: w for (_, k), (w, _) in now.items()}
    assert not got[96][1] and got[200][1] and got[0][1]
    drifts = spark.createDataFrame([(2, 1, 1500, 0), (2, 2, 1001, 0)], "id bigint, seq bigint, x bigint, y bigint")
    assert as_set(ranking.drift(items, drifts)) == {("g", 500)}


def test_region_births_exceptions_and_sums(spark):
    base = spark.createDataFrame([("r", 0, 100), ("r", 1, 101), ("q", 0, 7)], "region string, id bigint, base bigint")
    log = spark.createDataFrame(
        [("r", 1, "bulk", 100, None), ("r", 2, "insert", 50, 9), ("r", 3, "bulk", 7, None), ("r", 4, "exception", 5, 1), ("r", 5, "exception", 9, 1)],
        "region string, seq bigint, kind string, k bigint, id bigint",
    )
    assert as_set(regions.prices(base, log)) == {("r", 0, 207), ("r", 1, 217), ("r", 9, 57), ("q", 0, 7)}
    assert as_set(regions.region_sums(base, log)) == {("r", 3, 481), ("q", 1, 7)}
    assert as_set(regions.filter_counts(base, log, 207)) == {("r", 1), ("q", 0)}


def test_bounds_at_thresholds_and_block_edges(spark):
    for clustered in (True, False):
        rows = generators.values(spark, 2500, clustered)
        values = [r.v for r in rows.orderBy("id").collect()]
        blocks = bounds.summary(rows)
        for t in (0, min(values), max(values), values[1024], values[1023], 2**32 - 11):
            expected = sum(v > t for v in values)
            assert one(bounds.count_above(rows, t)) == one(bounds.count_above_by_bucket(rows, t)) == one(bounds.filter_blocks(rows, blocks, t)) == expected
            assert one(bounds.filter_blocks(rows, blocks, t, below=True)) == sum(v < t for v in values)
        assert as_set(bounds.argmin(rows)) == as_set(bounds.argmin_bounded(rows)) == {(values.index(min(values)), min(values))}
    empty = rows.limit(0)
    assert one(bounds.filter_blocks(empty, bounds.summary(empty), 5)) == 0 and bounds.argmin(empty).count() == 0
    split = bounds.split(rows).filter(scalars.join16("hi", "lo") != F.col("v"))
    assert split.count() == 0


def test_intersections_and_their_certificates(spark):
    keys = lambda xs: spark.createDataFrame([(x,) for x in xs], "k bigint")
    a, b = keys([1, 1, 2, 5, 9]), keys([1, 1, 1, 5, 7])
    assert sorted(r.k for r in certificates.merge_intersect(a, b).collect()) == [1, 5]
    assert sorted(r.k for r in certificates.merge_intersect_all(a, b).collect()) == [1, 1, 5]
    assert sorted(r.k for r in certificates.sparse_intersect(a, b).collect()) == [1, 5]
    assert sorted(r.k for r in certificates.sparse_intersect(a, b, bound=1).collect()) == [1, 5]
    assert one(certificates.disjoint(keys([]), b)) and one(certificates.disjoint(keys([1, 2]), keys([3])))
    assert not one(certificates.disjoint(generators.key_set(spark, 5, 0, 2), generators.key_set(spark, 5, 1, 2)))
    assert certificates.certified_intersect(generators.key_set(spark, 5, 0, 2), generators.key_set(spark, 5, 1, 2)).count() == 0
    join = rules.inner_join(keys([1, 2]), keys([3, 4]), "k")
    assert join.count() == 0 and join.columns == ["k"]


def test_triangle_plans_agree(spark):
    cliques = graphs.simple_edges(generators.two_cliques(spark, 8))
    messy = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 1), (1, 1), (3, 4), (1, 2)], "u bigint, v bigint")
    random_graph = graphs.simple_edges(generators.random_edges(spark, 40, 0.2))
    for edges, n in ((cliques, 112), (graphs.simple_edges(messy), 1), (random_graph, None), (cliques.limit(0), 0)):
        got = {one(f(edges)) for f in (graphs.triangles_by_neighbours, graphs.triangles_binary, graphs.two_hop_plan)}
        assert len(got) == 1 and n in (None, *got)
    assert one(rules.triangles(cliques, most=1)) == 112
    assert one(graphs.two_hop_estimate(cliques)) == 16 * 49
    plus = graphs.simple_edges(generators.bipartite(spark, 12, 6))
    assert one(graphs.triangles_binary(plus)) == one(graphs.triangles_by_neighbours(plus))


def test_binary_plan_does_not_shuffle_its_paths(spark, monkeypatch):
    edges = graphs.simple_edges(generators.random_edges(spark, 60, 0.4))
    n = one(graphs.triangles_by_neighbours(edges))
    assert n and one(graphs.triangles_binary(edges)) == n
    with graphs._joined_in_cells(spark):
        plan = graphs.by_cells(edges)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert keys and not any(re.search(r"\bu#\d+L?, w#", k) for k in keys), keys
    # ids far apart or in clumps, edges given twice, vertices that count as heavy
    far = edges.select((F.col("u") * 2**52).alias("u"), (F.col("v") * 2**52).alias("v"))
    clump = edges.select(*(F.when(F.col(c) > 57, F.lit(2**61) + F.col(c)).otherwise(F.col(c)).alias(c) for c in "uv"))
    assert one(graphs.triangles_binary(far)) == one(graphs.triangles_binary(clump)) == n
    assert one(graphs.triangles_binary(edges.unionAll(edges))) == 8 * n
    monkeypatch.setattr(graphs, "HEAVY", 20)
    assert one(graphs.triangles_binary(edges)) == n


@pytest.mark.parametrize("stock,shards,restock,held", [(20, 4, 3, 10), (3, 8, 1, 0), (50, 3, 7, 31), (10, 2, 4, 10), (0, 2, 1, 0)])
def test_quotas_never_oversell_and_match_a_replay(spark, stock, shards, restock, held):
    r = random.Random(stock)
    log = [(i, r.randrange(shards)) for i in range(60)]
    frame = spark.createDataFrame(log, "seq bigint, shard bigint")
    glob = quotas.reserve_global(frame, stock)
    assert {s for s, o in as_set(glob) if o == "ok"} == set(range(min(stock, 60)))
    local = {q.shard: q.quota for q in quotas.split_stock(spark, stock, shards, held).collect()}
    left, expected = min(held, stock), set()
    assert sum(local.values()) + left == stock
    shut = set()
    for seq, shard in log:
        if local[shard] == 0 and shard not in shut:
            got = min(restock, left)
            left -= got
            local[shard] += got
            if not got:
                shut.add(shard)
        if local[shard] > 0:
            local[shard] -= 1
            expected.add(seq)
    got = quotas.reserve_restocked(frame, stock, shards, restock, held)
    assert {r.seq for r in got.collect() if r.outcome == "ok"} == expected
    shares = quotas.split_stock(spark, stock, shards)
    out = quotas.reserve_sharded(frame, shares)
    a = quotas.accounting(out, stock).first()
    assert a.ok + a.stranded == stock and a.ok + a.soldout == 60
    assert quotas.drain(out, shares).filter("outcome = 'ok'").count() == min(stock, 60)


def test_coded_columns_over_the_whole_range(spark):
    rows = generators.coded_pairs(spark, 200, whole_range=True)
    code = coded.build(rows)
    assert as_set(coded.recover_a(code.drop("a")).select("id", "a")) == as_set(rows.select("id", "a"))
    pairs = [(r.a, r.b) for r in rows.collect()]
    assert int(one(coded.sum_from_code(code))) == int(one(coded.sum_from_sources(rows))) == sum(a + b for a, b in pairs)
    assert int(one(coded.filter_sum(code, 17))) == sum(a + b for a, b in pairs if a + b > 17)
    assert int(one(rules.sum_of(code, ["a", "b"]))) == sum(a + b for a, b in pairs)
    assert int(one(rules.sum_of(code, ["a"]))) == sum(a for a, _ in pairs)
    assert one(coded.checksum(coded.recover_a(code.drop("a")))) == (sum(a for a, _ in pairs) + 2**63) % 2**64 - 2**63
    for values in ([2**63 - 1, 1], [-(2**63), -1], [2**63 - 1] * 4, []):
        rows = spark.createDataFrame([(v,) for v in values], "a bigint")
        assert one(coded.checksum(rows)) == (sum(values) + 2**63) % 2**64 - 2**63


def test_jitter_adds_up_and_equals_a_replay(spark):
    r = random.Random(5)
    items = [("ab"[i % 2], i, r.randrange(40), r.randrange(40)) for i in range(24)]
    changes = [(r.choice([3, 4, 5, 11]), 7 * j, r.randrange(-9, 30)) for j in range(6)] + [(3, 7, 4)]
    asked = [(q, r.randrange(201)) for q in range(0, 50, 3)]
    expected = set()
    for q, k in asked:
        for g in "ab":
            now = {i: k * (x + sum(c for j, s, c in changes if j == i and s <= q)) + (200 - k) * y for gg, i, x, y in items if gg == g}
            expected.add((g, q, k, min(now, key=lambda i: (now[i], i))))
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((items, "g string, id bigint, x bigint, y bigint"), (changes, "id bigint, seq bigint, k bigint"), (asked, "q bigint, k bigint"))]
    assert as_set(joint.jittered(*frames)) == expected


@pytest.mark.parametrize("shape", ["linear", "gaps", "clusters"])
def test_learned_index_finds_positions(spark, shape):
    keys = generators.sorted_keys(spark, 3000, shape)
    placed = learned.positions(keys.select("k"))
    assert as_set(placed.select("pos", "k")) == as_set(keys.select("pos", "k"))
    segs = learned.segments(placed, eps=8, span=4096)
    assert segs.agg(F.max("err")).first()[0] <= 8 and segs.agg(F.sum("n")).first()[0] == 3000
    at = {r.k: r.pos for r in keys.collect()}
    asked = [(i, k) for i, k in enumerate([*list(at)[::17], -5, 10**15, 3, 3, *list(at)[:2]])]
    got = learned.lookup(spark.createDataFrame(asked, "q bigint, k bigint"), placed, segs, span=4096)
    assert as_set(got) == {(q, k, at[k]) for q, k in asked if k in at}


def test_lookups_keep_repeated_probes(spark):
    rows = generators.scan_rows(spark, 500).withColumnRenamed("id", "k").withColumn("payload", F.col("price"))
    probes = spark.createDataFrame([(k,) for k in (0, 10, 11, 11, 499, 9999)], "k bigint")
    assert lookups.payload_sum(rows, probes).first().n == 5
    assert {lookups.id_xor(rows, probes, how).first().ids for how in ("auto", "merge", "shuffle_hash")} == {0 ^ 10 ^ 11 ^ 11 ^ 499}
    got = lookups.scan(rows, 2500).first()
    assert got.n == rows.filter("price > 2500 AND qty > 0").count()


def test_range_counts_with_repeated_keys(spark):
    keys = generators.shared_keys(spark, 400).unionAll(spark.createDataFrame([(7,)] * 5, "k bigint"))
    queries = generators.range_queries(spark, 12, 1500, 200).unionAll(spark.createDataFrame([(90, 7, 7), (91, 7, 8), (92, 5000, 6000)], "q bigint, lo bigint, hi bigint"))
    more = spark.createDataFrame([(x,) for x in (7, 8, 250, 250, 10**6)], "k bigint")
    for extra in (None, more):
        ks = [r.k for r in (keys.unionAll(extra) if extra else keys).collect()]
        expected = {(q, sum(lo <= k < hi for k in ks)) for q, lo, hi in as_set(queries)}
        state, private = ranges.shared_state(keys), ranges.matches(keys, queries)
        if extra:
            state, private = ranges.insert_shared(state, extra), ranges.insert_private(private, queries, extra)
        assert as_set(ranges.shared_counts(state, queries)) == as_set(ranges.private_counts(private, queries)) == expected
        assert as_set(ranges.rescan(keys.unionAll(extra) if extra else keys, queries)) == expected


def test_prefix_sums_over_cells_and_blocks(spark):
    r = random.Random(4)
    rows = [(r.choice([5, r.randrange(10**9), r.randrange(5000)]), r.randrange(9)) for _ in range(300)]
    frame = spark.createDataFrame(rows, "k bigint, v bigint")
    got = sorted((x.k, x.v, x.before) for x in ranks.prefix_sums(frame, "k", F.col("v")).collect())
    assert got == sorted((k, v, sum(w for j, w in rows if j < k)) for k, v in rows)


@pytest.mark.parametrize("noise", [0.01, 5.0, 40.0])
def test_model_prunes_exactly(spark, noise):
    rows = generators.correlated(spark, 800, noise, by_price=False).select("id", (F.col("price") * 100).cast("bigint").alias("x"), (F.col("delivery") * 100).cast("bigint").alias("y"))
    model = correlation.whole_model(rows)
    code = correlation.encode(rows, model)
    span = correlation.residual_range(code).first()
    assert as_set(correlation.decode(code, model)) == as_set(rows)
    for t in (1000, 3000, 5000, 7000, span.rmin):
        expected = rows.filter(F.col("y") < t).count()
        assert one(correlation.count_below(rows, t)) == expected
        assert one(correlation.count_below_pruned(code, model, (span.rmin, span.rmax), t)) == expected
        assert rules.filter_below(rows, t, model, (span.rmin, span.rmax)).count() == expected
    flat = rows.withColumn("x", F.lit(3).cast("bigint"))
    assert correlation.whole_model(flat)[1] == 0


def test_shifted_filter_pushes_a_literal_and_guards_overflow(spark, tmp_path):
    spark.range(100).withColumn("v", F.col("id").cast("int")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert rules.shifted_filter(df, "id", 10, 50).count() == 59
    assert "GreaterThan(id,40)" in rules.shifted_filter(df, "id", 10, 50)._jdf.queryExecution().toString()
    assert rules.shifted_filter(df, "v", -(2**40), 0).count() == 0
    assert rules.shifted_filter(df, "v", 2**40, 0).count() == 100


def test_records_and_reports(spark, tmp_path):
    assert records.read_records(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "a.json").write_text('[{"experiment": "e", "n": 3},\n {"experiment": "f", "median_ns": 12}]')
    assert records.read_records(spark, str(tmp_path / "a.json")).count() == 2
    times = [5, 1, 9, 7]
    rec = bench_records.record(spark, "engine", "row_scan_predicate", 10, "{}", times, 10, 80)
    other = bench_records.record(spark, "engine", "col_scan_avx2", 10, "{}", [2, 2, 2], 10, 80)
    both = rec.unionByName(other)
    records.write_records(both, str(tmp_path / "r"))
    back = records.read_records(spark, str(tmp_path / "r"), array=False)
    assert back.count() == 2 and int(back.filter("variant = 'row_scan_predicate'").first().median_ns) == 7
    assert [r.speedup for r in bench_records.speedups(back).collect()] == [3.5]
    assert len(bench_records.PAIRS) == 22
    assert records.lines(back).count() == 2
    records.write_markdown(back, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).count() == 2
    assert len(bench_records.time_ns(lambda: None, iters=2)) == 2
    assert one(bench_records.best(back).select("variant")) == "col_scan_avx2"


def test_generators_do_not_depend_on_partitions(spark):
    a = generators.products(spark, 200, "convex")
    assert as_set(a) == as_set(generators.products(spark, 200, "convex").repartition(7))
    for mode in ("pareto", "near_tie", "random"):
        assert generators.products(spark, 50, mode).count() == 50
    assert generators.catalog_items(spark, 50).columns == ["id", "price_base", "delivery", "exception"]
    assert generators.weights(spark, 9, 0.45, 0.55).filter("w < 0.45 OR w >= 0.55").count() == 0
    assert generators.region_bases(spark, 20).agg(F.min("base")).first()[0] >= 50
