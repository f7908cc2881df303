"""Claims-domain tables derived from the star-schema parquet tables.

The same derivations exist as SQL in ``suite.oracle``.  All of them grow with
the tables they read, apart from the small code lists.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.functions import dates
from pairwell.operators import visits
from pairwell.plans import ingest
from pairwell.session import materialize, partitions_for, raise_partitions
from pairwell.sources import sinks
from pairwell.sources.readers import month_table
from suite.oracle import PARTNER_NAMES, PLACE_NAMES, REVENUE_NAMES, TERM_SETS

EXPOSED = ["1-URGENT", "2-HIGH"]
EXCLUDE = ["5-LOW"]
CATEGORIES = ["ER", "Inpatient", "Office Visits", "Surgery", "Avoidable ER"]
CONDITIONS = ["ASTHMA", "COPD", "DIABETES_MELLITUS", "HYPERTENSION"]
UTIL = ["er", "inpatient", "office_visits", "surgery", "avoidable_er", "readmission"]


def pick(col: Column, names: list[str | None]) -> Column:
    """Name number ``col`` of a list."""
    return F.array(*[F.lit(n) for n in names])[col.cast("int")]


_STORED: dict[tuple[str, str, str], DataFrame] = {}
_PARTITIONS: dict[tuple[str, str, str], int] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        raise_partitions(spark, self.buckets)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived table written once per session, as a study would store it."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORED:
            _STORED[key] = materialize(build(), name)
        return _STORED[key]

    def stored_part(self, name: str, part: str, build: Callable[[], DataFrame], columns: list[str]) -> DataFrame:
        """Some columns of :meth:`stored`: of the table or a part of it that is written by now, else written as ``part`` without the others."""
        here = (self.spark.sparkContext.applicationId, self.sf_dir)
        parts = {stored: df for (*at, stored), df in _STORED.items() if (*at,) == here}
        for stored, df in sorted(parts.items()):  # the table itself comes first
            if (stored == name or stored.startswith(f"{name}_")) and set(columns) <= set(df.columns):
                return df.select(*columns)
        return self.stored(f"{name}_{part}", lambda: build().select(*columns))

    @property
    def buckets(self) -> int:
        """Buckets of the member in which derived tables are stored; they grow with the star tables."""
        at_least = self.spark.conf.get("spark.sql.shuffle.partitions")
        key = (self.spark.sparkContext.applicationId, self.sf_dir, at_least)
        if key not in _PARTITIONS:
            paths = [f"{self.sf_dir}/{name}.parquet" for name in ("customer", "part", "orders", "lineitem")]
            _PARTITIONS[key] = partitions_for(self.spark, paths)
        return _PARTITIONS[key]

    def stored_by_member(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The same, in buckets of the member."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, f"{name}-{self.buckets}")
        if key not in _STORED:
            _STORED[key] = sinks.materialize_by_member(build(), name, self.buckets)
        return _STORED[key]

    # Events and members

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_custkey").alias("person_id"),
            F.trunc("o_orderdate", "month").alias("utc_period"),
            F.col("o_orderpriority").alias("category"),
        ).distinct()

    @cached_property
    def members(self) -> DataFrame:
        spans = self.raw("orders").groupBy("o_custkey").agg(
            F.trunc(F.min("o_orderdate"), "month").alias("start_date"),
            F.trunc(F.max("o_orderdate"), "month").alias("end_date"),
        )
        key = F.col("c_custkey")
        return (
            self.raw("customer").join(spans, F.col("c_custkey") == F.col("o_custkey"))
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                key.alias("member_id"), key.alias("person_id"),
                F.make_date(1940 + key % 66, F.lit(1), F.lit(1)).alias("birth_year"),
                F.when(key % 2 == 0, "M").otherwise("F").alias("sex"),
                F.col("n_name").alias("state"),
                F.upper("c_mktsegment").alias("edw_cust"),
                "start_date", "end_date",
            )
        )

    # Claim lines and codes

    @cached_property
    def line_items(self) -> DataFrame:
        pay = F.col("l_extendedprice").cast("decimal(12,2)")
        rate = 1 - F.col("l_discount").cast("decimal(4,2)")
        return (
            self.raw("lineitem").join(
                self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey")
            )
            .withColumns({
                "member_id": F.col("o_custkey"),
                "ship": F.col("l_shipdate").cast("date"),
                "pay": pay,
                "netpay": (pay * rate).cast("decimal(18,4)"),
            })
        )

    @cached_property
    def med_lines(self) -> DataFrame:
        return (
            self.line_items.filter("l_linenumber <= 5")
            .join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                "member_id", F.col("ship").alias("svc_start"),
                F.date_add("ship", (F.col("l_quantity").cast("int") % 10)).alias("svc_end"),
                F.col("l_returnflag").alias("code_pos"), F.col("l_linestatus").alias("code_rev"),
                F.col("p_type").alias("dx1"), F.col("p_brand").alias("dx2"), "pay", "netpay",
            )
        )

    @cached_property
    def rx_lines(self) -> DataFrame:
        return self.line_items.filter("l_linenumber > 5").select(
            "member_id", F.col("l_partkey").alias("ndcnum"), F.col("ship").alias("svcdate"),
            "pay", "netpay",
        )

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    @cached_property
    def util_codes(self) -> DataFrame:
        return self._rows(
            [("R", "", "ER"), ("A", "", "Inpatient"), ("N", "", "Office Visits"),
             ("", "F", "Surgery")],
            "p_code string, o_code string, category string",
        )

    @cached_property
    def avoidable_codes(self) -> DataFrame:
        return self._rows([("ECONOMY", "Avoidable ER")], "ms_joiner string, category string")

    @cached_property
    def condition_codes(self) -> DataFrame:
        return self._rows(
            [("SMALL", "ASTHMA"), ("LARGE", "COPD"), ("PROMO", "DIABETES_MELLITUS"),
             ("Brand#2", "HYPERTENSION")],
            "ms_diag string, condition string",
        )

    @cached_property
    def drug_codes(self) -> DataFrame:
        return self.raw("part").filter("p_size <= 5").select(
            F.col("p_partkey").alias("ndc"), F.lit("DIABETES_MELLITUS").alias("condition")
        )

    # Derived tables

    @cached_property
    def coded_lines(self) -> DataFrame:
        return visits.code_lookup_3way(self.med_lines, self.util_codes, self.avoidable_codes)

    @cached_property
    def visit_rows(self) -> DataFrame:
        return visits.visits(self.coded_lines, CATEGORIES)

    @cached_property
    def claims(self) -> DataFrame:
        """Claims by member and month, the month as a date."""
        stored = ingest.build_claims(
            self.med_lines, self.rx_lines, self.util_codes, self.avoidable_codes,
            categories=CATEGORIES, buckets=self.buckets,
        )
        return month_table(stored, "service_month")

    @cached_property
    def flags(self) -> DataFrame:
        return ingest.build_chronic_flags(
            self.med_lines, self.rx_lines, self.util_codes, self.avoidable_codes,
            self.condition_codes, self.drug_codes, names=CONDITIONS,
        )

    @cached_property
    def vectors(self) -> DataFrame:
        """Points to match, from the embeddings."""
        return self.raw("embeddings").select(
            F.col("vec_id").alias("key"), F.col("label").cast("string").alias("stratum"),
            (F.col("vec_id") % 5 != 0).alias("is_control"),
            F.col("embedding").cast("array<double>").alias("vec"),
        )

    # Membership and programme tables

    @cached_property
    def orders_customers(self) -> DataFrame:
        month = dates.format_yyyymm(F.col("o_orderdate"))
        return self.raw("orders").join(
            self.raw("customer"), F.col("o_custkey") == F.col("c_custkey")
        ).withColumns({
            "person_id": F.concat(F.lit("P"), F.col("o_custkey").cast("string")),
            "covrg_id": F.concat(F.lit("Cov-"), F.col("o_custkey").cast("string")),
            "utc_period": month, "org_nm": F.upper("c_mktsegment"),
        })

    @cached_property
    def customers(self) -> DataFrame:
        """Employers to extract for; all but one segment."""
        return self.raw("customer").filter("c_mktsegment <> 'FURNITURE'").select(
            F.upper("c_mktsegment").alias("edw_cust")
        ).distinct()

    @cached_property
    def coverage(self) -> DataFrame:
        return self.orders_customers.select(
            "person_id", "covrg_id", "utc_period", "org_nm",
            F.when(F.col("o_custkey") % 5 == 0, 0).otherwise(1).alias("member_flag"),
        ).distinct()

    @cached_property
    def savings(self) -> DataFrame:
        p = F.col("o_orderpriority")
        return self.orders_customers.select(
            F.upper("covrg_id").alias("covrg_id"), "utc_period",
            F.when(p == "1-URGENT", "Case Management").when(p == "2-HIGH", "Maternity Program")
            .when(p == "3-MEDIUM", "Disease Management").when(p == "4-NOT SPECIFIED", "Wellness Gap")
            .otherwise("High Cost Claimants (HCC)").alias("savings_category"),
        )

    @cached_property
    def claim_flags(self) -> DataFrame:
        return self.orders_customers.select(
            "covrg_id", F.col("utc_period").alias("adjudication_period"),
            (F.col("o_totalprice") > 300000).alias("hcc_flag"),
        )

    @cached_property
    def contacts(self) -> DataFrame:
        return self.raw("lineitem").join(
            self.orders_customers, F.col("l_orderkey") == F.col("o_orderkey")
        ).withColumn("enctr_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))

    @cached_property
    def comms(self) -> DataFrame:
        return self.contacts.select(
            F.col("l_orderkey").alias("comm_id"), "enctr_id", "covrg_id", "utc_period", "org_nm",
            (F.col("l_linestatus") == "F").alias("engaged_flag"),
            F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("clinical_flag"),
            F.when(F.col("l_returnflag") == "R", "CONTACT MADE").otherwise("NO ANSWER").alias("result"),
        )

    @cached_property
    def tasks(self) -> DataFrame:
        states = ["duplicate", "rejected", "draft", "done", "done", "open", "open"]
        return self.contacts.select(
            "enctr_id", "person_id", "covrg_id",
            pick(F.col("l_linenumber") % 3, ["issue", "member_outreach", "note"]).alias("task_cd"),
            pick(F.col("l_suppkey") % 7, states).alias("task_status"),
            F.when(F.col("l_quantity") > 45, 1).otherwise(0).alias("deleted_flag"),
            F.when(F.col("l_linestatus") == "F", "Care").otherwise("Admin").alias("objective_category"),
            pick(
                F.col("l_partkey") % 4,
                ["Other Care Education", "Care Gap", None, "Benefit Support"],
            ).alias("objective_type"),
        )

    @cached_property
    def funnel(self) -> DataFrame:
        programs = [
            "Conditions Care", "Symptoms Care", "Wellness Care", "Preventive Care",
            "Care Navigation", "Case Management", "BH Support", "NICU Care", "Pharmacy",
            "Pediatric Plus",
        ]
        day = F.col("o_orderdate").cast("date")
        return self.orders_customers.select(
            "person_id", "covrg_id", "utc_period", "org_nm",
            F.col("o_orderkey").alias("care_plan_id"),
            pick(F.col("o_orderkey") % 10, programs).alias("program"),
            F.when(F.col("o_orderstatus") == "F", day).alias("closed_on"),
            F.when(F.col("o_orderstatus").isin("F", "P"), day).alias("enrolled_on"),
        )

    @cached_property
    def plan_ids(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("care_plan_id"),
            F.when(F.col("l_linenumber") <= 3, "case-system").otherwise("other").alias("alt_system"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("alt_value"),
        )

    @cached_property
    def interventions(self) -> DataFrame:
        return self.raw("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("enc_id"),
            F.when(F.col("l_returnflag") == "R", "Closed").otherwise("Open").alias("status"),
        )

    @cached_property
    def service_years(self) -> DataFrame:
        return self.orders_customers.groupBy(
            F.lower("org_nm").alias("org_nm"), F.substring("utc_period", 1, 4).alias("y")
        ).agg(
            F.min("utc_period").alias("svc_period_start"),
            F.concat("y", F.lit("09")).alias("svc_period_end"),
        ).filter("svc_period_start <= svc_period_end").drop("y")

    @cached_property
    def encounters(self) -> DataFrame:
        return self.orders_customers.select(
            F.upper("covrg_id").alias("covrg_id"), "utc_period", "org_nm",
            pick(F.col("o_orderkey") % len(PARTNER_NAMES), PARTNER_NAMES).alias("partner"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date"))
            .alias("start_date"),
        )

    @cached_property
    def care_visits(self) -> DataFrame:
        return self.orders_customers.select(
            F.lower("person_id").alias("person_id"),
            F.col("o_orderdate").cast("date").alias("service_date"),
        )

    # Terminology, from parts

    @cached_property
    def terms(self) -> DataFrame:
        name = pick(F.col("p_partkey") % len(TERM_SETS), TERM_SETS)
        state = F.when(F.col("p_size") > 45, "retired").otherwise("active")
        code = F.concat(F.lit("E"), (F.col("p_partkey") % 97).cast("string"), F.lit("."),
                        F.col("p_size").cast("string"))
        return self.raw("part").select(
            name.alias("value_set_nm"), code.alias("cd_sys_concept_cd"),
            F.concat(F.col("p_name"), F.lit("'s "), F.col("p_brand")).alias("cd_sys_concept_display"),
            state.alias("cd_sys_sts"),
            F.when(F.col("p_partkey") % 11 == 0, "retired").otherwise("active").alias("cd_sys_concept_sts"),
            F.lit("active").alias("value_set_sts"), F.lit("active").alias("value_set_compose_sts"),
        )

    def _descriptions(self, names: list[str]) -> Column:
        return F.concat(
            pick(F.col("p_partkey") % len(names), names), F.lit(" "), F.col("p_name")
        )

    @cached_property
    def revenue_codes(self) -> DataFrame:
        return self.raw("part").select(
            F.lpad(F.col("p_partkey").cast("string"), 4, "0").alias("code"),
            self._descriptions(REVENUE_NAMES).alias("description"),
        )

    @cached_property
    def places(self) -> DataFrame:
        return self.raw("part").select(
            (F.col("p_partkey") % 50).cast("string").alias("stdplac"),
            self._descriptions(PLACE_NAMES).alias("description"),
        )
