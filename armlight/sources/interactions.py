"""The interaction table over the given parquet files, and the fixed models.

events is the log, customer gives the user features, part the offer features.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armlight.functions.models import DenseNet, LinearModel, layer_widths, rule_net, weights_table
from armlight.operators.dimensions import attach_dimension

OFFER_FEATURES = ["o_size", "o_price", "o_promo"]
USER_FEATURES = ["u_bal", "u_bld", "u_nat"]
FEATURES = OFFER_FEATURES + USER_FEATURES
OFFER_COLUMNS = ["offer_id"] + OFFER_FEATURES
USER_COLUMNS = ["user_id"] + USER_FEATURES
# The side columns of the file layout
SEED_COLUMNS = ["tenure_seeds", "recency_seeds", "dollars_seeds", "units_seeds", "trips_seeds"]

# Policy means w = m, precisions q, per feature and intercept
POLICY_WEIGHTS = {
    "o_size": 0.8, "o_price": 0.4, "o_promo": -0.5, "u_bal": 0.6, "u_bld": 0.3, "u_nat": -0.7,
}
POLICY_INTERCEPT = -0.3
POLICY_PRECISIONS = {
    "intercept": 4.0, "o_size": 9.0, "o_price": 16.0, "o_promo": 4.0, "u_bal": 25.0, "u_bld": 4.0, "u_nat": 9.0,
}
# The reward net 6-3-2-1, inputs in the order of FEATURES
REWARD_LAYERS = (
    (
        (
            (0.9, -0.6, 0.5, 0.7, -0.4, 0.8),
            (-0.7, 0.8, 0.6, -0.5, 0.9, 0.3),
            (0.4, 0.5, -0.8, 0.6, 0.2, -0.9),
        ),
        (0.1, -0.2, 0.05),
    ),
    (((0.8, -0.9, 0.6), (-0.5, 0.7, 0.9)), (0.1, -0.1)),
    (((1.4, -1.1),), (0.15,)),
)
# The deep policy net 6-3-2-1, inputs in the order of FEATURES
DEEP_POLICY_LAYERS = (
    (
        (
            (0.5, 0.3, -0.7, 0.6, 0.4, -0.2),
            (-0.4, 0.9, 0.8, 0.2, -0.6, 0.7),
            (0.7, -0.3, 0.4, -0.8, 0.5, 0.6),
        ),
        (0.05, 0.1, -0.15),
    ),
    (((0.9, -0.4, 0.5), (0.3, 0.8, -0.6)), (0.05, 0.2)),
    (((1.2, -0.8),), (-0.1,)),
)
# The actor 3-2-2-3 (user features to a proto-offer)
ACTOR_LAYERS = (
    (((0.8, -0.5, 0.6), (-0.7, 0.9, 0.4)), (0.1, 0.05)),
    (((0.6, -0.8), (0.9, 0.5)), (0.2, 0.1)),
    (((1.5, -0.9), (-0.6, 0.4), (0.5, -0.7)), (-0.2, 0.1, 0.3)),
)
# The critic 6-2-1, inputs are user features, then offer features
CRITIC_LAYERS = (
    (((0.6, -0.3, 0.5, 0.7, -0.2, 0.4), (-0.5, 0.8, 0.3, -0.4, 0.6, 0.2)), (0.1, 0.05)),
    (((0.9, -0.7),), (0.05,)),
)
# Weight of the side feature in the model with side features
SIDE_WEIGHT = 1.3


def policy_model(link: str = "logit") -> LinearModel:
    return LinearModel(dict(POLICY_WEIGHTS), POLICY_INTERCEPT, link)


def reward_net() -> DenseNet:
    return DenseNet(tuple(FEATURES), REWARD_LAYERS)


def deep_policy_net() -> DenseNet:
    return DenseNet(tuple(FEATURES), DEEP_POLICY_LAYERS)


def actor_net() -> DenseNet:
    return DenseNet(tuple(USER_FEATURES), ACTOR_LAYERS, sigmoid_out=False)


def critic_net() -> DenseNet:
    return DenseNet(tuple(USER_FEATURES + OFFER_FEATURES), CRITIC_LAYERS)


# fits of the catalog: two batches an epoch, with a rate to match, as a step is a Spark job
FIT = {"epochs": 30, "batches": 2, "rate": 2e-2, "seed": 100}


def fit_net(name: str) -> DenseNet:
    """The net that a fit starts from: the reward net of widths n, n/4, n/8, 1, or a logistic model."""
    return rule_net(layer_widths(len(FEATURES)) if name == "reward" else [len(FEATURES), 1], FEATURES)


def policy_table(spark: SparkSession) -> DataFrame:
    """The policy as a weights table (feature, w, m, q), intercept first."""
    rows = [("intercept", POLICY_INTERCEPT, POLICY_INTERCEPT, POLICY_PRECISIONS["intercept"])]
    rows += [(f, w, w, POLICY_PRECISIONS[f]) for f, w in POLICY_WEIGHTS.items()]
    return weights_table(spark, rows, ("w", "m", "q"))


# declared, so that building a query opens no file
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, features, seed columns and, last, the label.

    ``event_id`` is the position of a row in the log.
    """
    events = table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        # a pattern costs a quarter of a JSON parser here, and the join reads it twice
        F.expr(r"""try_cast(regexp_extract(props, '"k": *([0-9]+)', 1) as bigint)""").alias("offer_id"),
        F.col("ts").alias("redeem_date"),
        "event_type",
        "value",
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), "c_acctbal", "c_mktsegment", "c_nationkey"
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("offer_id"), "p_size", "p_retailprice", "p_type"
    )
    joined = attach_dimension(events, customers, "user_id", "event_id")
    joined = attach_dimension(joined, parts, "offer_id", "event_id", counted=events)
    return joined.selectExpr(
        "event_id",
        "user_id",
        "offer_id",
        "redeem_date",
        "event_type",
        "value",
        "c_acctbal / 1e4D as u_bal",
        "if(c_mktsegment = 'BUILDING', 1D, 0D) as u_bld",
        "c_nationkey / 25D as u_nat",
        "p_size / 50D as o_size",
        "p_retailprice / 1e3D as o_price",
        "if(p_type = 'PROMO', 1D, 0D) as o_promo",
        "c_acctbal / 100D as tenure_seeds",
        "cast(c_nationkey as double) as recency_seeds",
        "value as dollars_seeds",
        "cast(p_size as double) as units_seeds",
        "p_retailprice as trips_seeds",
        "if(value >= 50D, 1, 0) as target",
    )


def training_layout(facts: DataFrame) -> DataFrame:
    """The file layout: three keys, features and seed columns, label last."""
    return facts.select("user_id", "offer_id", "redeem_date", *FEATURES, *SEED_COLUMNS, "target")
