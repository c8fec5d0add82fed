"""Population reports over failure profiles: what is worth more compute, and does routing pay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefork.operators.routing import STANDARD, Rules, route
from tracefork.schemas import INTERVENTIONS

# An intervention must beat resampling by this margin, on a problem at least this hard.
STEERABLE_MARGIN = 0.05
HARDNESS = 0.50
LABELS = ["resample", "steerable", "beyond reach"]


def best_rate() -> Column:
    return F.greatest(*[F.col(c) for c in INTERVENTIONS])


def classify(profiles: DataFrame) -> DataFrame:
    """Add ``label``: steerable, beyond reach or resample."""
    best, retry = best_rate(), F.col("retry")
    steerable = ((best - retry) >= STEERABLE_MARGIN) & ((1.0 - retry) >= HARDNESS)
    label = F.when(steerable, "steerable").when(best == 0.0, "beyond reach").otherwise("resample")
    return profiles.withColumn("label", label)


LISTED_CELLS = 2_000


def list_cells(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell")


def select_cell(profiles: DataFrame, cell: str | None) -> DataFrame:
    """Rows of one cell (all for None); an unknown cell is an error naming the valid ones."""
    if cell is None:
        return profiles
    chosen = profiles.where(F.col("cell") == cell)
    if chosen.isEmpty():
        known = profiles.agg(F.count_distinct("cell").alias("n")).first()
        named = "see list_cells"
        if known.n <= LISTED_CELLS:  # a message has to stay readable; beyond that none is named rather than some
            named = str([r.cell for r in list_cells(profiles).collect()])
        raise ValueError(f"no rows for cell {cell!r}; available: {known.n} cells, {named}")
    return chosen


def taxonomy(profiles: DataFrame) -> DataFrame:
    """Label counts and shares for the whole population (cell null) and each cell.

    One aggregate over the rows; the rollup runs on its handful of counts.
    """
    counts = classify(profiles).groupBy("cell", "label").agg(F.count("*").alias("c"))
    both = counts.rollup("label", "cell").agg(F.sum("c").alias("n"), F.grouping("label").alias("_all"))
    both = both.where(F.col("_all") == 0).select("cell", "label", "n")
    total = F.sum("n").over(W.partitionBy("cell"))
    return both.withColumn("share", F.col("n") / total)


def steerable(profiles: DataFrame) -> DataFrame:
    return classify(profiles).where(F.col("label") == "steerable")


def routed_steerable(
    profiles: DataFrame, by: Sequence[str] = (), rules: Rules = STANDARD
) -> DataFrame:
    """Route the steerable subset, scaled within that subset; add the rate under the routed operator."""
    routed = route(steerable(profiles), rules, by)
    names = sorted(set(INTERVENTIONS))
    rates = F.create_map(*[x for c in names for x in (F.lit(c), F.col(c))])
    return routed.withColumn("routed_rate", F.element_at(rates, F.col("operator")))


def signature(routed: DataFrame, by: Sequence[str] = (), rules: Rules = STANDARD) -> DataFrame:
    """Per routed operator: size and mean z of each feature, in the order of the rules; empty operators absent."""
    place = F.array_position(F.array(*[F.lit(o) for o in rules.operators()]), F.col("operator"))
    return (
        routed.groupBy(*by, "operator")
        .agg(F.count("*").alias("n"), *[F.avg(f"z_{f}").alias(f"mean_z_{f}") for f in rules.features()])
        .withColumn("place", place.cast("bigint"))
    )


def routed_means(routed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One aggregate: size, routed rate, each fixed rate, resampling rate."""
    return routed.groupBy(*by).agg(
        F.count("*").alias("n_steerable"),
        F.avg("routed_rate").alias("routed"),
        F.avg("retry").alias("retry"),
        *[F.avg(c).alias(c) for c in INTERVENTIONS],
    )


def fixed_rates(means: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean rescue rate of each fixed choice, best first (ties in the intervention order).

    Works on the one-row-per-group output of ``routed_means``, so its window holds four rows a group.
    """
    entries = F.array(
        *[F.struct(F.lit(c).alias("operator"), F.col(c).alias("rate"), F.lit(i).alias("pos"))
          for i, c in enumerate(INTERVENTIONS)]
    )
    ranked = F.sort_array(
        F.transform(entries, lambda e: F.struct((-e["rate"]).alias("neg"), e["pos"].alias("pos"), e["operator"].alias("operator"), e["rate"].alias("rate")))
    )
    return means.select(*by, F.posexplode(ranked).alias("place", "e")).select(
        *by,
        F.col("e.operator").alias("operator"),
        F.col("e.rate").alias("rate"),
        (F.col("place") + 1).cast("bigint").alias("place"),
    )


def routing_report(means: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Routed rate, best fixed choice and verdict per group."""
    best = F.greatest(*[F.col(c) for c in INTERVENTIONS])
    name = F.coalesce(*[F.when(F.col(c) >= best, F.lit(c)) for c in INTERVENTIONS])
    delta = 100.0 * (F.col("routed") - F.col("best_rate"))
    return (
        means.withColumns({"best_fixed": name, "best_rate": best})
        .select(*by, "n_steerable", "routed", "best_fixed", "best_rate", "retry", delta.alias("delta_pp"))
        .withColumn("routing_wins", F.col("delta_pp") >= 0)
    )


def panel_coordinates(routed: DataFrame) -> DataFrame:
    return routed.withColumns(
        {"x": F.col("z_concentration") - F.col("z_spread"), "y": F.col("z_logit_dispersion")}
    )


def principal_plane(scored: DataFrame, features: Sequence[str]) -> DataFrame:
    """Two principal components of the z columns, as ``pc1`` and ``pc2``.

    The covariance is a distributed aggregate; only the feature-by-feature matrix reaches the driver.
    Each component's sign is fixed so that its largest loading is positive.
    """
    cols = [f"z_{f}" for f in features]
    vec = VectorAssembler(inputCols=cols, outputCol="_v").transform(scored)
    model = PCA(k=2, inputCol="_v", outputCol="_pc").fit(vec)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    pcs = vector_to_array("_pc")
    return (
        model.transform(vec)
        .withColumns({f"pc{j + 1}": F.lit(signs[j]) * pcs[j] for j in range(2)})
        .drop("_v", "_pc")
    )


PANEL_SCHEMA = T.StructType(
    [T.StructField("pid", T.StringType()), T.StructField("feats", T.ArrayType(T.DoubleType())),
     T.StructField("rescuers", T.ArrayType(T.StringType()))]
)
