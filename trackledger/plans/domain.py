"""Driver tables as domain objects, in Spark and as SQL text with the same meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackledger.functions.domain import MAIN_PHASES, PARALLEL_STATES, one_of

TODAY = "2025-01-31"
SOURCE_OF_EVENT = {"purchase": "MANUELL", "signup": "BAUPORTAL", "click": "FINVE", "view": "VIB", "error": "MEDIEN"}
REGION_BASE, NATION_BASE = 1_000_000, 2_000_000
PINNED = "BAU"


def today() -> Column:
    return F.to_date(F.lit(TODAY))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def case(value: str, pairs: dict, default: str | None = None) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    tail = "" if default is None else f" ELSE {default}"
    return f"CASE {value} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in pairs.items()) + f"{tail} END"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per event; nulls are put in by id, so that both engines agree."""
    e = read(spark, sf_dir, "events")
    i = F.col("event_id")
    parallel = (i % 7).isin(0, 1)
    return e.select(
        i.alias("id"),
        F.col("user_id").alias("project_id"),
        one_of(F.col("event_type"), SOURCE_OF_EVENT).alias("source_type"),
        F.when(i % 7 == 0, "PF").when(i % 7 == 1, "PARL").otherwise("MAIN").alias("track"),
        F.when(parallel, one_of(i % 3, dict(enumerate(PARALLEL_STATES)))).otherwise(one_of(i % 5, dict(enumerate(MAIN_PHASES)))).alias("asserted_state"),
        F.when(i % 17 != 0, F.to_date("ts")).alias("observed_date"),
        F.when(i % 11 == 0, F.col("value") / F.lit(500.0)).alias("confidence"),
        (i % 13 == 0).alias("is_expected"),
    )


OBS = f"""obs AS (
  SELECT event_id AS id, user_id AS project_id, {case("event_type", SOURCE_OF_EVENT)} AS source_type,
    CASE event_id % 7 WHEN 0 THEN 'PF' WHEN 1 THEN 'PARL' ELSE 'MAIN' END AS track,
    CASE WHEN event_id % 7 IN (0, 1) THEN {case("event_id % 3", dict(enumerate(PARALLEL_STATES)))}
         ELSE {case("event_id % 5", dict(enumerate(MAIN_PHASES)))} END AS asserted_state,
    CASE WHEN event_id % 17 <> 0 THEN ts::DATE END AS observed_date,
    CASE WHEN event_id % 11 = 0 THEN value / 500.0::DOUBLE END AS confidence,
    event_id % 13 = 0 AS is_expected
  FROM events)"""

TRUST_SQL = case("source_type", {"MANUELL": 0.9, "BAUPORTAL": 0.8, "FINVE": 0.7, "FULDA_RUNDE": 0.7, "VIB": 0.6, "MEDIEN": 0.4}, "0.5")
DECAY_SQL = f"""CASE WHEN observed_date IS NULL THEN 0.6::DOUBLE
  WHEN date_diff('day', observed_date, DATE '{TODAY}') <= 0 THEN 1.0::DOUBLE
  ELSE greatest(0.3::DOUBLE, pow(0.5::DOUBLE, date_diff('day', observed_date, DATE '{TODAY}') / 365.0::DOUBLE)) END"""
CONF_SQL = f"coalesce(confidence, ({TRUST_SQL})::DOUBLE * {DECAY_SQL})"
ORDER_SQL = case("asserted_state", {p: i for i, p in enumerate(MAIN_PHASES)})
STATE_ORDER_SQL = case("asserted_state", {p: i for i, p in enumerate(PARALLEL_STATES)})


def phase_name_sql(order: str) -> str:
    return case(order, dict(enumerate(MAIN_PHASES)))


def state_name_sql(order: str) -> str:
    return case(order, dict(enumerate(PARALLEL_STATES)))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project tree: regions over nations over customers; nation 3 modulo 7 is pinned."""
    region = read(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + F.lit(REGION_BASE)).cast("long").alias("project_id"),
        F.lit(None).cast("long").alias("superior_id"),
        F.col("r_name").alias("name"),
        F.lit(None).cast("string").alias("pin"),
    )
    nation = read(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + F.lit(NATION_BASE)).cast("long").alias("project_id"),
        (F.col("n_regionkey") + F.lit(REGION_BASE)).cast("long").alias("superior_id"),
        F.col("n_name").alias("name"),
        F.when(F.col("n_nationkey") % 7 == 3, PINNED).alias("pin"),
    )
    customer = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("project_id"),
        (F.col("c_nationkey") + F.lit(NATION_BASE)).cast("long").alias("superior_id"),
        F.col("c_name").alias("name"),
        F.lit(None).cast("string").alias("pin"),
    )
    return region.unionByName(nation).unionByName(customer)


PROJECTS = f"""projects AS (
  SELECT r_regionkey::BIGINT + {REGION_BASE} AS project_id, NULL::BIGINT AS superior_id, r_name AS name, NULL::VARCHAR AS pin FROM region
  UNION ALL SELECT n_nationkey::BIGINT + {NATION_BASE}, n_regionkey::BIGINT + {REGION_BASE}, n_name,
    CASE WHEN n_nationkey % 7 = 3 THEN '{PINNED}' END FROM nation
  UNION ALL SELECT c_custkey, c_nationkey::BIGINT + {NATION_BASE}, c_name, NULL FROM customer)"""

HEADLINE = f"""weighed AS (
  SELECT *, {CONF_SQL} AS raw_conf, round({CONF_SQL}, 4) AS conf, {ORDER_SQL} AS ord FROM obs WHERE NOT is_expected),
credible AS (SELECT * FROM weighed WHERE track = 'MAIN' AND conf >= 0.15 AND ord IS NOT NULL),
ranked AS (SELECT *, rank() OVER (PARTITION BY project_id ORDER BY conf DESC, ord DESC) AS r FROM credible),
headline AS (
  SELECT project_id, max(ord) AS ord, max(conf) AS conf, count(*) AS n_decisive FROM ranked WHERE r = 1 GROUP BY project_id)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement to project links; a null year is a permanent link."""
    return (
        read(spark, sf_dir, "lineitem")
        .select(
            F.col("l_suppkey").alias("finve_id"),
            F.col("l_partkey").alias("project_id"),
            F.when(F.col("l_returnflag") == "R", F.year("l_shipdate")).alias("haushalt_year"),
        )
        .distinct()
    )


LINKS = """links AS (
  SELECT DISTINCT l_suppkey AS finve_id, l_partkey AS project_id,
    CASE WHEN l_returnflag = 'R' THEN year(l_shipdate)::INTEGER END AS haushalt_year FROM lineitem)"""


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts per agreement and year, whole thousands.

    Sums are exact, so that half a thousand is rounded the same way whatever the order of the rows.
    """
    amount = lambda c: F.round(F.sum(c.cast("decimal(28,8)")).cast("double") / 1000.0).cast("long")
    price = F.col("l_extendedprice")
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("fin_ve"), F.year("l_shipdate").alias("budget_year"))
        .agg(amount(price).alias("planned"), amount(price * F.col("l_discount")).alias("spent"), F.count(F.lit(1)).alias("n_titles"))
    )


BUDGETS = """budgets AS (
  SELECT l_suppkey AS fin_ve, year(l_shipdate)::INTEGER AS budget_year, round(sum(l_extendedprice) / 1000.0::DOUBLE)::BIGINT AS planned,
    round(sum(l_extendedprice * l_discount) / 1000.0::DOUBLE)::BIGINT AS spent, count(*) AS n_titles
  FROM lineitem GROUP BY 1, 2)"""
