"""Strata, candidates, assignment and details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwell.operators import features
from pairwell.operators.matching import assign, candidates, detail, strata
from pairwell.session import materialize
from suite.cases_selection import ID, cohort_columns, cohort_rows
from suite.oracle import SCALED, WEIGHTS, greedy_sql
from suite.registry import case
from suite.tables import Tables

EXACT = {"age_band": ["18-39", "40-59", "60+"], "sex": ["M", "F"]}
EXACT_COLUMNS = ["age_band_1839", "age_band_4059", "age_band_60", "sex_m", "sex_f"]
FINAL = ["total_claims_p0", "age"]


# Embeddings: every fifth vector is exposed, labels are strata, two cohorts

def usable(t: Tables) -> DataFrame:
    return strata.eligible_points(t.vectors, 5)


def edges(t: Tables, **options) -> DataFrame:
    return candidates.nearest_controls(usable(t), k=10, **options)


def cohort_edges(t: Tables, **options) -> DataFrame:
    cohort = F.when(F.col("exposed_key") % 2 == 0, "even").otherwise("odd")
    return edges(t, **options).withColumn("cohort", cohort)


_COHORT_EDGES = "select *, case when exposed_key % 2 = 0 then 'even' else 'odd' end as cohort from x_edges"


@case("count_by_stratum", """
    select stratum, count(*) filter (not is_control) as exposed, count(*) filter (is_control) as controls
    from x_points group by 1""")
def _(t: Tables) -> DataFrame:
    return t.vectors.groupBy("stratum").agg(
        F.count_if(~F.col("is_control")).alias("exposed"), F.count_if("is_control").alias("controls"))


@case("exact_strata_join", """
    select cohort, stratum, exposed_count, control_count, coalesce(control_count > 40, false) as kept from (
        select category as cohort, stratum, count(*) as exposed_count from x_ready where category <> 'control' group by all)
    left join (select stratum, count(*) as control_count from x_ready where category = 'control' group by all) using (stratum)""")
def _(t: Tables) -> DataFrame:
    return strata.strata_counts(_points(t), 40)


@case("exact_match_strata", """
    select stratum, count(*) as n from x_ready where stratum in (select stratum from x_usable) group by 1""")
def _(t: Tables) -> DataFrame:
    return strata.eligible_points(_points(t), 40).groupBy("stratum").agg(F.count("*").alias("n"))


@case("stratum_semi_join", "select key, stratum, is_control from x_points where stratum in (select stratum from x_strata)")
def _(t: Tables) -> DataFrame:
    return usable(t).select("key", "stratum", "is_control")


@case("knn_candidates_exact", "select * from x_edges")
def knn_exact(t: Tables) -> DataFrame:
    return edges(t, exact=True)


@case("knn_within_distance", "select * from x_edges where d2 <= 1.9")
def _(t: Tables) -> DataFrame:
    return edges(t, exact=True, n_list=5, n_probe=2, max_distance_sq=1.9)


@case("knn_candidates_ivf", """
    with given as (
        select stratum, row_number() over (partition by stratum order by key) - 1 as cell, vec
        from x_points where is_control and stratum in (select stratum from x_strata)
        qualify row_number() over (partition by stratum order by key) <= 5),
    apart as (
        select p.stratum, p.key, p.is_control, p.vec, g.cell,
               row_number() over (partition by p.key order by round(list_sum(list_transform(
                   list_zip(p.vec, g.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9), g.cell) as place
        from x_points p join given g using (stratum)),
    near as (
        select e.stratum, e.key as exposed_key, c.key as control_key, round(list_sum(list_transform(
                   list_zip(e.vec, c.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) as d2
        from apart e join apart c on c.stratum = e.stratum and c.cell = e.cell
        where not e.is_control and e.place <= 2 and c.is_control and c.place = 1)
    select *, row_number() over (partition by exposed_key order by d2, control_key)::int as rank
    from near qualify rank <= 10""")
def _(t: Tables) -> DataFrame:
    """A given index, here the first five controls of each stratum, searched in two cells."""
    first = W.partitionBy("stratum").orderBy("key")
    given = usable(t).filter("is_control").withColumn("cell", F.row_number().over(first)).filter("cell <= 5")
    centroids = given.groupBy("stratum").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("cell", "vec"))), lambda x: x["vec"]).alias("centroids"))
    return edges(t, exact=False, n_probe=2, centroids=centroids)


@case("knn_ivf_all_cells", "select * from x_edges")
def _(t: Tables) -> DataFrame:
    return edges(t, exact=False, n_list=5, n_probe=5)


@case("topk_candidates", """
    select * from (select member_id, visit_start, visit_len, row_number() over (
        partition by member_id order by visit_len desc, visit_start) as rank from x_visits) where rank <= 3""")
def _(t: Tables) -> DataFrame:
    longest = t.visit_rows.select(
        "member_id", "visit_start", "visit_len", (-F.col("visit_len")).alias("d2"),
        F.datediff("visit_start", F.lit("1990-01-01").cast("date")).alias("control_key"))
    return candidates.top_k(longest, ["member_id"], 3).drop("d2", "control_key")


@case("self_neighbour_check", "select stratum, key as exposed_key, key as control_key, cast(0 as double) as d2, 1 as rank from x_points where is_control")
def _(t: Tables) -> DataFrame:
    return candidates.self_neighbours(t.vectors)


@case("greedy_match_1to1", greedy_sql(_COHORT_EDGES, """
    select p.*, 1 as n, e.d2 from pairs p join x_edges e using (stratum, exposed_key, control_key)"""))
def _(t: Tables) -> DataFrame:
    return assign.greedy_match(cohort_edges(t))


@case("greedy_match_1to1_steps", greedy_sql(_COHORT_EDGES + " where d2 <= 1.9", """
    select p.*, 1 as n, e.d2 from pairs p join x_edges e using (stratum, exposed_key, control_key)"""))
def _(t: Tables) -> DataFrame:
    return assign.greedy_match(cohort_edges(t, max_distance_sq=1.9), shrink=1.0)


# Two controls each: turn after turn, carrying who holds what and who has left.
_SEVERAL = f"""
    with recursive wishes as (
        select cohort, stratum, exposed_key, list(control_key order by rank) as wish,
               row_number() over (partition by cohort, stratum order by exposed_key) as seq
        from ({_COHORT_EDGES}) group by cohort, stratum, exposed_key),
    turns as (select w.*, r.n, seq + (r.n - 1) * count(*) over (partition by cohort, stratum, r.n) as turn
              from wishes w, (values (1), (2)) r(n)),
    walk as (
        select distinct cohort, stratum, cast(0 as bigint) as turn, cast([] as struct(e bigint, c bigint, n int)[]) as held,
               cast([] as bigint[]) as gone from wishes
        union all
        select k.cohort, k.stratum, w.turn,
               case when list_contains(k.gone, w.exposed_key) then k.held
                    when p.pick is null then list_filter(k.held, lambda h: h.e <> w.exposed_key)
                    else list_append(k.held, {{'e': w.exposed_key, 'c': p.pick, 'n': w.n}}) end,
               case when p.pick is null then list_append(k.gone, w.exposed_key) else k.gone end
        from walk k join turns w on w.cohort = k.cohort and w.stratum = k.stratum and w.turn = k.turn + 1,
             lateral (select list_filter(w.wish, lambda c: not list_contains(list_transform(k.held, lambda h: h.c), c))[1] as pick) p),
    done as (select cohort, stratum, unnest(arg_max(held, turn)) as h from walk group by cohort, stratum)
    select d.cohort, d.stratum, h.e as exposed_key, h.c as control_key, h.n as n, x.d2
    from done d join x_edges x on x.exposed_key = h.e and x.control_key = h.c"""


@case("greedy_match_1tok", _SEVERAL)
def _(t: Tables) -> DataFrame:
    return assign.greedy_match(cohort_edges(t), n_final=2)


@case("greedy_match_1tok_steps", _SEVERAL)
def _(t: Tables) -> DataFrame:
    return assign.greedy_match(cohort_edges(t), n_final=2, shrink=0.0)


# Cohort rows

def ready(t: Tables, rows: DataFrame | None = None) -> DataFrame:
    return features.full_transformation(cohort_rows(t) if rows is None else rows, ID, SCALED, EXACT, WEIGHTS)


def _points(t: Tables) -> DataFrame:
    """Points as counted by stratum: without ids, key and vector."""
    def build() -> DataFrame:
        points = strata.match_points(ready(t, cohort_columns(t)), ID, EXACT_COLUMNS, SCALED)
        return points.select("stratum", "category", "is_control")

    return t.stored("counted_points", build)


def match(t: Tables, only: list[str] | None = None) -> DataFrame:
    rows = cohort_columns(t)
    matched, _ = detail.main_match(
        rows, ready(t, rows), ID, EXACT_COLUMNS, SCALED, FINAL, only=only, n_list=40,
        k=10, max_distance_sq=50.0)
    return matched


def matched_rows(t: Tables) -> DataFrame:
    return t.stored("matched", lambda: match(t))


_NEAR = "select cohort, stratum, exposed_key, b.key as control_key, b.d2 as d2 from x_near where b.d2 <= 50{}"
_KEY = "p.cohort || '_' || p.stratum || '_' || e.member_id || '_' || strftime(e.utc_period, '%Y-%m-%d')"
MATCHED = f""", matched as (
    select {_KEY} as match_key, e.member_id, p.cohort as category, e.utc_period, f.total_claims_p0, f.age
    from pairs p join x_numbered e on e.key = p.exposed_key
    join x_cohorts f on f.member_id = e.member_id and f.utc_period = e.utc_period and f.category = e.category
    union all
    select {_KEY}, c.member_id, p.cohort || ' control', c.utc_period, f.total_claims_p0, f.age
    from pairs p join x_numbered e on e.key = p.exposed_key join x_numbered c on c.key = p.control_key
    join x_cohorts f on f.member_id = c.member_id and f.utc_period = c.utc_period and f.category = c.category)
    """


@case("main_match", greedy_sql(_NEAR.format(" and cohort = '1-URGENT'"), MATCHED + "select * from matched"))
def _(t: Tables) -> DataFrame:
    return match(t, ["1-URGENT"])


@case("match_many_cohorts", greedy_sql(_NEAR.format(""), MATCHED + "select * from matched"))
def match_many(t: Tables) -> DataFrame:
    return match(t)


@case("tag_matches", """
    select exposed_key, control_key, e.vec_id as exposed_member_id, c.vec_id as control_member_id, rank
    from x_edges join embeddings e on e.vec_id = exposed_key join embeddings c on c.vec_id = control_key""")
def _(t: Tables) -> DataFrame:
    points = t.vectors.withColumn("member_id", F.col("key"))
    return detail.tag_matches(edges(t), points, ["member_id", "category"]).drop("stratum", "d2")


@case("detail_matches", greedy_sql(_COHORT_EDGES, """
    select cohort || '_' || p.stratum || '_' || exposed_key as match_key, exposed_key as member_id, cohort as category,
           len(embedding) as width from pairs p join embeddings on vec_id = exposed_key
    union all
    select cohort || '_' || p.stratum || '_' || exposed_key, control_key, cohort || ' control', len(embedding)
    from pairs p join embeddings on vec_id = control_key"""))
def _(t: Tables) -> DataFrame:
    points = t.vectors.withColumn("member_id", F.col("key"))
    label = F.when(F.col("is_control"), "control").when(F.col("key") % 2 == 0, "even").otherwise("odd")
    rows = points.select("member_id", label.alias("category"), F.size("vec").cast("long").alias("width"))
    pairs = materialize(assign.greedy_match(cohort_edges(t)), "pairs")
    return detail.detail_matches(pairs, points, rows, ["member_id", "category"], ["width"])
