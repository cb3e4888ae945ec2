"""Price lists: USD per million tokens by provider and model, with cache multipliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import fresh

SCHEMA = "provider string, model string, input_per_million double, output_per_million double, cache_write_multiplier double, cache_read_multiplier double"

#: Multipliers of a rate that names none.
CACHE_WRITE, CACHE_READ = 1.25, 0.1

# A sample price list in invented model names; "*" stands for every other model of a provider.
SAMPLE = (
    ("hosted", "large", 15.0, 75.0, 1.25, 0.1),
    ("hosted", "medium", 3.0, 15.0, 1.25, 0.1),
    ("hosted", "small", 1.0, 5.0, 1.25, 0.1),
    ("local", "*", 0.0, 0.0, 0.0, 0.0),
)


def sample(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SAMPLE), SCHEMA)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A price list file: JSON {"providers": {provider: {model: {rates}}}}; missing multipliers take the defaults."""
    rate = "struct<input_per_million:double,output_per_million:double,cache_write_multiplier:double,cache_read_multiplier:double>"
    raw = spark.read.schema(f"providers map<string,map<string,{rate}>>").json(path, multiLine=True)
    models = raw.select(F.explode("providers").alias("provider", "m")).select("provider", F.explode("m").alias("model", "r"))
    return models.select(
        "provider", "model", "r.input_per_million", "r.output_per_million",
        F.coalesce("r.cache_write_multiplier", F.lit(CACHE_WRITE)).alias("cache_write_multiplier"),
        F.coalesce("r.cache_read_multiplier", F.lit(CACHE_READ)).alias("cache_read_multiplier"),
    )


def resolve(spark: SparkSession, path: str | None = None, user_path: str | None = None) -> DataFrame:
    """The price list of an explicit path, else that of the user if there is one, else the sample."""
    if path is not None:
        return load(spark, path)
    if user_path is not None:
        file = spark._jvm.org.apache.hadoop.fs.Path(user_path)
        if file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file):
            return load(spark, user_path)
    return sample(spark)


def with_rates(calls: DataFrame, pricing: DataFrame) -> DataFrame:
    """calls (provider, model, ...) with the rates of the model, else those of the provider's "*"; rate columns are null if there are none."""
    rates = [c for c in pricing.columns if c not in ("provider", "model")]
    own, other = fresh("own", calls), fresh("other", calls)
    exact = pricing.select("provider", "model", F.struct(*rates).alias(own))
    any_model = pricing.where("model = '*'").select("provider", F.struct(*rates).alias(other))
    both = calls.join(exact, ["provider", "model"], "left").join(any_model, "provider", "left")
    rate = F.coalesce(own, other)
    return both.select(*calls.columns, *[rate[c].alias(c) for c in rates])


def require_rates(priced: DataFrame) -> DataFrame:
    """Raise KeyError if a call has no rate."""
    if missing := priced.where("input_per_million IS NULL").select("provider", "model").first():
        raise KeyError(f"no rate for {missing['provider']}/{missing['model']}")
    return priced


def listed(pricing: DataFrame, installed: DataFrame) -> DataFrame:
    """The price list with a column available: whether the model is among the installed ones (provider, model)."""
    have = installed.select("provider", "model", F.lit(True).alias("available")).distinct()
    return pricing.join(have, ["provider", "model"], "left").withColumn("available", F.coalesce("available", F.lit(False)))
