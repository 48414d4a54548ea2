"""Synthetic items as a Spark job.

Every draw is a function of ``(id, salt, seed)`` (see ``functions.random``),
so the output does not depend on partitioning, task order or retries, and it
scales with the id column it is given (``spark.range(n)`` or any id table).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from binsight import constants as C
from binsight.functions.random import uniform, uniform_choice, uniform_int, weighted_choice
from binsight.operators.joins import fixed_dimension

def profile(name: str) -> dict:
    if name not in C.PROFILES:
        raise ValueError(f"unknown profile {name!r}; known: {sorted(C.PROFILES)}")
    return C.PROFILES[name]


def spine_start(end: Column) -> Column:
    return end - F.make_dt_interval(F.lit(C.SPINE_DAYS))


def spine_points(p: dict) -> int:
    """Hourly points of a profile: seven days, with or without the end itself."""
    return C.SPINE_DAYS * 24 + int(p["end_included"])


def hour_spine(spark: SparkSession, end: Column, profile_name: str = "python") -> DataFrame:
    """Hourly points from ``end - 7 days`` (included) to ``end``: 168 rows without
    the end, 169 in the profile that includes it.

    ``end`` is a column expression (a literal or a scalar subquery), never now().
    """
    start = spine_start(end)
    last = end if profile(profile_name)["end_included"] else end - F.make_dt_interval(F.lit(0), F.lit(1))
    return (spark.range(1)
            .select(F.explode(F.sequence(start, last, F.make_dt_interval(F.lit(0), F.lit(1)))).alias("hour_start")))


def weighted_pick(df: DataFrame, u: str | Column, profile_name: str = "python", out: str = "brand") -> DataFrame:
    p = profile(profile_name)
    return df.withColumn(out, weighted_choice(p["brands"], p["brand_weights"], u))


def _rate_map(rates: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in rates.items() for x in (kv[0], float(kv[1]))])


def recycle_rate(brand: Column, p: dict) -> Column:
    return F.coalesce(F.element_at(_rate_map(p["recycle_rates"]), brand), F.lit(C.DEFAULT_RECYCLE_RATE))


def compost_rate(brand: Column, hour: Column, p: dict) -> Column:
    hw = p["hour_weights"]
    hour_map = F.create_map(*[F.lit(x) for i, w in enumerate(hw) for x in (i, float(w))])
    hour_rate = F.coalesce(F.element_at(hour_map, hour), F.lit(C.DEFAULT_HOUR_RATE))
    brand_rate = F.coalesce(F.element_at(_rate_map(p["compost_rates"]), brand), F.lit(C.DEFAULT_COMPOST_RATE))
    return brand_rate * (hour_rate / F.lit(float(max(hw)))) * F.lit(C.COMPOST_BOOST)


def rate_tables(spark: SparkSession, profile_name: str = "python") -> tuple[DataFrame, DataFrame]:
    """(brand_rates(brand, recycle_rate, compost_rate), hour_rates(hour, hour_rate))."""
    p = profile(profile_name)
    brands = sorted(set(p["recycle_rates"]) | set(p["compost_rates"]), key=p["brands"].index)
    br = spark.createDataFrame(
        [(b, float(p["recycle_rates"][b]) if b in p["recycle_rates"] else None,
          float(p["compost_rates"][b]) if b in p["compost_rates"] else None) for b in brands],
        "brand string, recycle_rate double, compost_rate double")
    hr = spark.createDataFrame([(i, float(w)) for i, w in enumerate(p["hour_weights"])], "hour int, hour_rate double")
    return br, hr


def rate_lookup(df: DataFrame, profile_name: str = "python", brand: str = "brand", hour: str = "hour") -> DataFrame:
    """Adds ``recycling_prob`` and ``compost_prob`` by lookup with defaults.

    Both rate tables have a size fixed by the profile and are broadcast; the
    hour-rate maximum is a scalar subquery over the hour table. The compost
    probability may exceed 1; a Bernoulli draw ``u < p`` then always fires.
    """
    br, hr = rate_tables(df.sparkSession, profile_name)
    max_hour = hr.agg(F.max("hour_rate")).scalar()
    out = (df.join(fixed_dimension(br.withColumnRenamed("brand", "__b")), F.col(brand) == F.col("__b"), "left")
             .join(fixed_dimension(hr.withColumnRenamed("hour", "__h")), F.col(hour) == F.col("__h"), "left"))
    return out.select(
        *df.columns,
        F.coalesce(F.col("recycle_rate"), F.lit(C.DEFAULT_RECYCLE_RATE)).alias("recycling_prob"),
        (F.coalesce(F.col("compost_rate"), F.lit(C.DEFAULT_COMPOST_RATE))
         * (F.coalesce(F.col("hour_rate"), F.lit(C.DEFAULT_HOUR_RATE)) / max_hour)
         * F.lit(C.COMPOST_BOOST)).alias("compost_prob"),
    )


def synth_items(ids: DataFrame, end: Column, profile_name: str = "python", seed: int = 0,
                id_col: str = "id") -> DataFrame:
    """Nine item columns per id.

    time: one of the profile's hourly points (``spine_points``); city/state: a pair;
    brand: weighted; description: adjective + noun; is_metal: keyword test;
    is_recyclable / is_compostable: Bernoulli draws at the looked-up rates.
    """
    p = profile(profile_name)
    i = id_col
    step = uniform_int(spine_points(p), i, salt=1, seed=seed).cast("int")
    t = spine_start(end) + F.make_dt_interval(F.lit(0), step)
    city = uniform_choice([F.struct(F.lit(c).alias("city"), F.lit(s).alias("state")) for c, s in C.CITIES],
                          i, salt=2, seed=seed)
    brand = weighted_choice(p["brands"], p["brand_weights"], uniform(i, salt=3, seed=seed))
    desc = F.concat_ws(" ", uniform_choice(C.ADJECTIVES, i, salt=5, seed=seed),
                       uniform_choice(C.DESCRIPTIONS, i, salt=4, seed=seed))
    base = ids.select(F.col(i).alias("__id"), t.alias("time"), city.alias("__cs"), brand.alias("brand"),
                      desc.alias("description"))
    b, h = F.col("brand"), F.hour("time")
    return base.select(
        F.concat(F.col("__id").cast("string"), F.lit(".jpg")).alias("filename"),
        "time",
        F.col("__cs.state").alias("state"),
        F.col("__cs.city").alias("city"),
        "description",
        (uniform("__id", salt=6, seed=seed) < recycle_rate(b, p)).alias("is_recyclable"),
        (uniform("__id", salt=7, seed=seed) < compost_rate(b, h, p)).alias("is_compostable"),
        F.col("description").contains(C.METAL_KEYWORD).alias("is_metal"),
        "brand",
    )


def synth_range(spark: SparkSession, n: int, end: Column, profile_name: str = "python", seed: int = 0,
                partitions: int | None = None) -> DataFrame:
    return synth_items(spark.range(0, n, 1, partitions), end, profile_name, seed)


