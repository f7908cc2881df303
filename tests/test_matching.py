"""Candidates against brute force, assignment against one-by-one choice."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairwell.operators.matching import assign, blocks, candidates, cells, components, strata
from pairwell.session import new_path, spread


def brute(points, k, limit=None):
    out = set()
    for stratum in {p[0] for p in points}:
        ctl = [(p[1], np.array(p[3])) for p in points if p[0] == stratum and p[2]]
        for _, key, is_control, vec in (p for p in points if p[0] == stratum):
            if not is_control:
                near = sorted((round(float(((np.array(vec) - v) ** 2).sum()), 9), c) for c, v in ctl)[:k]
                out |= {(key, c, d, i) for i, (d, c) in enumerate(near, 1) if limit is None or d <= limit}
    return out


def make_points(seed=0, dims=3):
    rng = random.Random(seed)
    data, key = [], 0
    for stratum, controls, exposed in (("a", 300, 40), ("b", 20, 5), ("c", 4, 3)):
        for n, is_control in ((controls, True), (exposed, False)):
            for i in range(n):
                # A third of the rows are copies of one vector.
                vec = [1.0] * dims if i % 3 == 0 else [round(rng.gauss(0, 2), 1) for _ in range(dims)]
                data.append((stratum, key, is_control, vec))
                key += 1
    rng.shuffle(data)
    return data


def frame(spark, data):
    return spark.createDataFrame(data, "stratum string, key long, is_control boolean, vec array<double>")


def found(df):
    return {(r.exposed_key, r.control_key, r.d2, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("options", [
    {}, {"n_list": 12, "n_probe": 1, "block_rows": 16}, {"n_list": 6, "n_probe": 2, "block_rows": 7, "max_distance_sq": 3.0},
])
def test_exact_search_equals_brute_force(spark, options):
    data = make_points()
    got = found(candidates.nearest_controls(frame(spark, data), k=5, **options))
    assert got == brute(data, 5, options.get("max_distance_sq"))


def test_probing_all_cells_is_exact_and_few_cells_recall_most(spark):
    data = make_points(1)
    want = brute(data, 5)
    every = candidates.nearest_controls(frame(spark, data), k=5, n_list=8, n_probe=8, exact=False)
    assert found(every) == want
    some = {e[:2] for e in found(candidates.nearest_controls(frame(spark, data), k=5, n_list=8, n_probe=3, exact=False))}
    assert len(some & {e[:2] for e in want}) / len(want) > 0.6


def test_every_control_finds_itself(spark):
    data = [("a", i, True, [float(i), float(i * i % 7)]) for i in range(40)]
    out = candidates.self_neighbours(frame(spark, data), n_list=4).collect()
    assert len(out) == 40 and all(r.exposed_key == r.control_key and r.d2 == 0 for r in out)


def test_strata_need_more_controls_than_cells(spark):
    data = [("a", i, i > 0, [0.0]) for i in range(6)] + [("b", 10 + i, i > 0, [0.0]) for i in range(5)]
    kept = strata.eligible_points(frame(spark, data), 4)
    assert {r.stratum for r in kept.collect()} == {"a"}


def test_keys_follow_the_order(spark, partitions):
    df = spark.createDataFrame([(i * 37 % 101, i % 5) for i in range(500)], "m int, p int")
    keyed = strata.with_keys(df, ["m", "p"]).orderBy("key").collect()
    assert [(r.m, r.p) for r in keyed] == sorted((r.m, r.p) for r in keyed)


def one_by_one(edges, n_final):
    """The definition, spelled out: rounds, choosing in order, releasing on failure."""
    out = []
    for group in sorted({(e[0], e[1]) for e in edges}):
        mine = [e for e in edges if (e[0], e[1]) == group]
        order, taken, held = sorted({e[2] for e in mine}), set(), {}
        for n in range(1, n_final + 1):
            for e in list(order):
                choice = [x[3] for x in sorted(mine, key=lambda x: x[5]) if x[2] == e and x[3] not in taken]
                if choice:
                    taken.add(choice[0])
                    held.setdefault(e, []).append(choice[0])
                else:
                    order.remove(e)
                    taken -= set(held.pop(e, []))
        out += [(*group, e, c, n) for e, got in held.items() for n, c in enumerate(got, 1)]
    return sorted(out)


def random_edges(seed, groups=6):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        controls = range(rng.randint(3, 14))
        for e in range(rng.randint(1, 12)):
            near = rng.sample(list(controls), min(len(controls), rng.randint(1, 5)))
            out += [(f"c{g % 2}", f"s{g}", e, 1000 * g + c, float(i), i) for i, c in enumerate(near, 1)]
    rng.shuffle(out)
    return out


COLUMNS = ["cohort", "stratum", "exposed_key", "control_key"]


@pytest.mark.parametrize("n_final", [1, 2, 3])
@pytest.mark.parametrize("shrink", [0.0, 0.5, 1.0])
def test_assignment_equals_one_by_one(spark, n_final, shrink):
    edges = random_edges(n_final)
    df = spark.createDataFrame(edges, "cohort string, stratum string, exposed_key long, control_key long, d2 double, rank int")
    got = assign.greedy_match(df, n_final=n_final, shrink=shrink)
    assert sorted(tuple(r) for r in got.select(*COLUMNS, "n").collect()) == one_by_one(edges, n_final)


def test_choice_in_tasks_on_many_random_lists():
    for seed in range(300):
        edges = random_edges(seed, groups=1)
        wishes = {}
        for e in sorted(edges, key=lambda x: (x[2], x[5])):
            wishes.setdefault(e[2], []).append((e[3], e[4]))
        held, got = {e: [] for e in wishes}, []
        for n in (1, 2, 3):
            holder = {c: e for e, cs in held.items() for c in cs}
            rows = [(e, [w for w in wishes[e] if holder.get(w[0], -1) < e], held[e]) for e in sorted(held)]
            picks = list(assign.choose_in_order(rows))
            held = {e: [*held[e], p[0]] for e, p in picks if p}
            got = sorted((*edges[0][:2], e, c, i) for e, cs in held.items() for i, c in enumerate(cs, 1))
            assert got == one_by_one(edges, n)


def test_no_edges_give_no_pairs(spark):
    df = spark.createDataFrame([], "cohort string, stratum string, exposed_key long, control_key long, d2 double, rank int")
    assert assign.greedy_match(df).count() == 0


def test_controls_are_used_once_per_cohort(spark):
    edges = [(c, "s", e, 5, 1.0, 1) for c in ("x", "y") for e in (1, 2)]
    df = spark.createDataFrame(edges, "cohort string, stratum string, exposed_key long, control_key long, d2 double, rank int")
    for shrink in (0.0, 0.5, 1.0):
        got = assign.greedy_match(df, shrink=shrink)
        assert sorted((r.cohort, r.exposed_key) for r in got.collect()) == [("x", 1), ("y", 1)]


@pytest.mark.parametrize("n_probe", [1, 2])
def test_a_control_tied_by_rounding_is_found_in_another_cell(spark, n_probe):
    at = [3.0, 4.0, 5.0, 5.00001, 6.00001, 7.00001]
    points = [("s", i, True, [x]) for i, x in enumerate(at)] + [("s", 100, False, [5.00001])]
    got = candidates.nearest_controls(frame(spark, points), k=1, n_list=2, n_probe=n_probe)
    assert found(got) == brute(points, 1)


def test_blocks_of_a_large_stratum_spread_over_tasks(spark, partitions):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(4000).select(
        F.when(F.col("id") % 5 == 0, F.concat(F.lit("small"), F.col("id") % 7)).otherwise("large").alias("stratum"),
        F.col("id").alias("key"), F.array(F.rand(1), F.rand(2)).alias("vec"))
    index = cells.build(rows, n_list=4, rounds=1, block_rows=64)
    step = cells._step_down(cells._at_root(rows), index.cells, 64).filter("stratum = 'large'")
    per_task = step.groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per_task) == int(partitions)


def chain_rounds(spark, monkeypatch, edges, **options):
    """(pairs, written rounds) of the assignment of ``edges``."""
    written = []
    kept = assign.materialize
    for module in (assign, components):
        monkeypatch.setattr(module, "materialize", lambda df, name: written.append(name) or kept(df, name))
    got = assign.greedy_match(spark.createDataFrame(
        edges, "cohort string, stratum string, exposed_key long, control_key long, d2 double, rank int"), **options)
    pairs = sorted((r.exposed_key, r.control_key, r.n) for r in got.collect())
    return pairs, written.count("rows") + written.count("components")


def test_rounds_settle_a_chain_at_once(spark, monkeypatch):
    edges = [("c", "s", e, c, 0.0, i + 1) for e in range(500) for i, c in enumerate((e, e + 1))]
    pairs, rounds = chain_rounds(spark, monkeypatch, edges)
    assert pairs == [(e, e, 1) for e in range(500)] and rounds == 1


@pytest.mark.parametrize("n_final, most", [(1, 20), (2, 40)])
def test_a_chain_in_which_each_row_displaces_the_next_needs_few_rounds(spark, monkeypatch, n_final, most):
    edges = [("c", "s", e, c, 0.0, i + 1) for e in range(1000) for i, c in enumerate((e - 1, e, e + 1))]
    pairs, rounds = chain_rounds(spark, monkeypatch, edges, n_final=n_final)
    assert pairs == [(e, c, n) for _, _, e, c, n in one_by_one_fast(edges, n_final)] and rounds <= most


def one_by_one_fast(edges, n_final):
    """``one_by_one`` for one group, with the wishes of each row at hand."""
    wishes = {}
    for x in sorted(edges, key=lambda x: (x[2], x[5])):
        wishes.setdefault(x[2], []).append(x[3])
    taken, held = set(), {e: [] for e in wishes}
    for _ in range(n_final):
        for e in list(held):
            choice = next((c for c in wishes[e] if c not in taken), None)
            if choice is None:
                taken -= set(held.pop(e))
            else:
                taken.add(choice)
                held[e].append(choice)
    return sorted((*edges[0][:2], e, c, n) for e, got in held.items() for n, c in enumerate(got, 1))


def test_components_equal_union_find(spark):
    rng = random.Random(8)
    links = [(g, rng.randrange(60), rng.randrange(60)) for g in "ab" for _ in range(40)]
    links += [("c", i, i + 1) for i in range(200)]
    least = {(g, x): x for g, a, b in links for x in (a, b)}
    for _ in range(250):
        for g, a, b in links:
            least[g, a] = least[g, b] = min(least[g, a], least[g, b])
    got = components.components(spark.createDataFrame(links, "g string, a long, b long"), ["g"]).collect()
    assert {(r.g, r.node): r.component for r in got} == least and len(got) == len(least)


def test_a_tree_of_three_levels_finds_what_brute_force_finds(spark):
    data = make_points(3)
    want = brute(data, 5)
    df = frame(spark, data)
    controls, exposed = (df.filter(f"is_control = {x}").select("stratum", "key", "vec") for x in ("true", "false"))
    index = cells.build(controls, fanout=3, cell_rows=5, block_rows=16)
    placed = index.members.collect()
    assert index.levels >= 3 and max(len(r.nodes) for r in placed) == index.levels
    assert sorted((r.stratum, r.key) for r in placed) == sorted((p[0], p[1]) for p in data if p[2])
    per_parent = index.cells.groupBy("stratum", "parent").count().collect()
    assert max(r["count"] for r in per_parent) <= 3
    for n_probe in (1, 4):
        assert found(candidates.search(index, exposed, k=5, n_probe=n_probe, block_rows=16)) == want
    assert found(candidates.search(index, exposed, k=5, n_probe=10**6, exact=False)) == want
    assert found(candidates.search(index, exposed, k=5, n_probe=2, max_distance_sq=3.0)) == brute(data, 5, 3.0)


def test_a_stored_index_takes_further_controls(spark):
    data = make_points(4)
    df = frame(spark, data)
    controls, exposed = (df.filter(f"is_control = {x}").select("stratum", "key", "vec") for x in ("true", "false"))
    path = new_path(spark, "index")
    cells.build(controls.filter("key % 3 > 0"), fanout=4, cell_rows=8).save(path)
    stored = cells.CellIndex.load(spark, path)
    before = found(candidates.search(stored, exposed, k=5, n_probe=2))
    assert before == brute([p for p in data if not p[2] or p[1] % 3 > 0], 5)
    for _ in range(2):  # a batch written again after a failure replaces itself
        grown = cells.CellIndex.extend(spark, path, controls.filter("key % 3 = 0"), 1)
    assert grown.members.count() == controls.count()
    whole = cells.CellIndex(stored.cells, cells.place(controls, stored.cells, stored.levels, 8192), stored.levels)
    for options in ({"exact": True}, {"exact": False}, {"exact": False, "n_probe": 1}):
        assert found(candidates.search(grown, exposed, k=5, **options)) == found(candidates.search(whole, exposed, k=5, **options))
    assert found(candidates.search(grown, exposed, k=5, n_probe=2)) == brute(data, 5)


def test_probes_reach_the_recall_asked_for_on_embeddings(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(
        F.col("label").cast("string").alias("stratum"), F.col("vec_id").alias("key"),
        F.col("embedding").cast("array<double>").alias("vec"))
    index = cells.build(vectors.filter("key % 5 <> 0"), n_list=20, rounds=4)
    exposed = vectors.filter("key % 5 = 0")
    n_probe = candidates.probes_for(index, exposed, target=0.9)
    assert candidates.recall(index, exposed, n_probe=n_probe) >= 0.9
    assert n_probe <= 20 and candidates.recall(index, exposed, n_probe=1) < 0.9


def test_work_in_python_keeps_its_partitions(spark, partitions):
    assert spread(spark.range(10), "id").groupBy(F.spark_partition_id()).count().count() > 1
    assert spread(spark.range(10), "id").rdd.getNumPartitions() == int(partitions)


def test_points_are_not_shuffled_to_choose_strata(spark):
    points = frame(spark, make_points()).select("key", "stratum", "is_control", "vec")
    plan = strata.eligible_points(points, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("limit", [0.5, 3.0, float("inf")])
def test_nearest_in_block_with_few_and_many_within_the_limit(limit):
    rng = np.random.default_rng(5)
    controls, exposed = rng.normal(size=(300, 4)).round(1), rng.normal(size=(90, 4)).round(1)
    limits = np.where(np.arange(90) % 3 == 0, 0.0, limit)
    rows, cols, d2 = candidates.nearest_in_block(exposed, controls, 7, limits)
    want = []
    for e, most in enumerate(limits):
        dist = np.round(((exposed[e] - controls) ** 2).sum(axis=1), 9)
        want += [(e, c, dist[c]) for c in np.lexsort((np.arange(300), dist))[:7] if dist[c] <= most]
    assert list(zip(rows, cols, d2)) == want


@pytest.mark.parametrize("limit", [np.inf, 30.0])
def test_few_distances_are_looked_at_beside_the_nearest(monkeypatch, limit):
    rng = np.random.default_rng(4)
    controls = rng.normal(size=(1001, 5))
    controls[300:330] = controls[7]
    exposed = np.vstack([rng.normal(size=(40, 5)), controls[7]])
    seen, nonzero = [], np.nonzero
    monkeypatch.setattr(candidates.np, "nonzero", lambda mask: seen.append(mask.sum()) or nonzero(mask))
    rows, cols, d2 = candidates.nearest_in_block(exposed, controls, 7, np.full(len(exposed), limit))
    assert sum(seen) < 20 * len(exposed)
    exact = np.round(((exposed[:, None] - controls[None]) ** 2).sum(axis=2), 9)
    want = [(r, c, exact[r, c]) for r in range(len(exposed))
            for c in np.lexsort((np.arange(len(controls)), exact[r]))[:7] if exact[r, c] <= limit]
    assert list(zip(rows.tolist(), cols.tolist(), d2.tolist())) == want


def test_vectors_are_read_from_arrow_as_one_block():
    column = pa.chunked_array([[[1.0, 2.0]], [], [[3.0, None], [5.0, 6.0]]], pa.list_(pa.float64()))
    assert np.array_equal(blocks.vectors_of(column.slice(1)), [[3.0, np.nan], [5.0, 6.0]], equal_nan=True)
    with pytest.raises(ValueError):
        blocks.vectors_of(pa.chunked_array([[[1.0, 2.0], None]], pa.list_(pa.float64())))


def test_strata_are_counted_in_one_pass(spark):
    rows = [("a", "x", False)] * 2 + [("a", "control", True)] * 3 + [("b", "y", False), ("c", "control", True)]
    rows += [(None, "x", False), (None, "control", True), ("a", None, False), ("a", "x", None), ("a", "y", True)]
    points = spark.createDataFrame(rows, "stratum string, category string, is_control boolean")
    counts = strata.strata_counts(points, 3)
    assert sorted(map(tuple, counts.collect()), key=str) == sorted([
        ("x", "a", 2, 4, True), (None, "a", 1, 4, True), ("y", "b", 1, None, False), ("x", None, 1, None, False)], key=str)
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


@pytest.mark.parametrize("k", [1, 7, 70])
def test_nearest_in_block_by_boxes_equals_all_distances(k):
    rng = np.random.default_rng(6)
    controls, exposed = rng.normal(size=(5000, 3)).round(1), rng.normal(size=(200, 3)).round(1)
    controls[1000:1600] = controls[5]
    exposed[:3] = controls[5]
    limits = rng.choice([0.0, 0.02, 1.0, np.inf], len(exposed))
    got = candidates.nearest_in_block(exposed, controls, k, limits)
    want = candidates._nearest_of_all(exposed, controls, k, limits)
    assert [x.tolist() for x in got] == [x.tolist() for x in want]
    none = candidates.nearest_in_block(exposed, controls, k, np.full(len(exposed), -1.0))
    assert [len(x) for x in none] == [0, 0, 0]


def test_boxes_out_of_reach_are_not_visited(monkeypatch):
    rng = np.random.default_rng(7)
    controls, exposed = rng.normal(size=(20000, 4)), rng.normal(size=(640, 4))
    compared, least = [], np.partition
    monkeypatch.setattr(
        candidates.np, "partition", lambda a, *at, **options: compared.append(a.shape[0]) or least(a, *at, **options))
    rows, cols, _ = candidates.nearest_in_block(exposed, controls, 10, np.full(len(exposed), np.inf))
    assert rows.tolist() == [r for r in range(len(exposed)) for _ in range(10)]
    steps = len(exposed) * 20000 / (candidates._BOX * candidates._STEP)
    assert 0 < sum(compared) < steps / 2


def test_copies_are_counted_exactly():
    rng = np.random.default_rng(8)
    vectors = rng.integers(0, 3, size=(500, 3)).astype(float)
    seen, want = {}, []
    for i, v in enumerate(map(tuple, vectors)):
        seen[v] = seen.get(v, 0) + 1
        if seen[v] <= 4:
            want.append(i)
    assert blocks.first_copies(vectors, 4).tolist() == want


def test_a_cell_whose_box_is_out_of_reach_is_not_searched(spark):
    points = [("s", i, [float(x), y]) for i, (x, y) in enumerate((x, y) for y in (0.0, 3.0) for x in range(-10, 11))]
    controls = spark.createDataFrame(points, "stratum string, key long, vec array<double>")
    centers = spark.createDataFrame([("s", [[0.0, 0.0], [0.0, 3.0]])], "stratum string, centroids array<array<double>>")
    given = cells.given_cells(centers)
    nodes = cells.search_nodes(given, cells.place(controls, given, 1, 16))
    assert [(r.low, r.high) for r in nodes.sort("node").collect()] == [([-10.0, y], [10.0, y]) for y in (0.0, 3.0)]
    row = spark.createDataFrame(
        [("s", 1, [0.0, 3.0], 1.0, [])], "stratum string, e_key long, vec array<double>, bound double, probed array<long>")
    assert [r.cell for r in cells.route(row, nodes, 1, 1, 16, rest=True).collect()] == [2]


def test_written_points_are_not_copied(spark, monkeypatch):
    data = make_points(3)
    points = frame(spark, data)
    sizes, kept = {}, cells.materialize

    def counted(df, name):
        out = kept(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(cells, "materialize", counted)
    assert found(candidates.nearest_controls(points, k=5, written=True)) == brute(data, 5)
    assert sizes["placed"] == [sum(p[2] for p in data)] and sizes["resting"] == [0]
