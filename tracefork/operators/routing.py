"""Prospective routing: z-score the trace features of a population and send each failure to the
intervention whose feature stands out most."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefork.session import small_side


class Rule(NamedTuple):
    """Send a row to ``operator`` when the z-score of ``feature`` is the largest."""

    feature: str
    operator: str


class Hedge(NamedTuple):
    """Send a row to ``operator`` when no z-score is above ``ceiling``."""

    operator: str
    ceiling: float = 0.0


class Rules:
    """An ordered list of rules, of which the earlier wins a tie, and a hedge or none."""

    def __init__(self, *rules: Rule | tuple[str, str], hedge: Hedge | None = None):
        self.rules = [Rule(*r) for r in rules]
        self.hedge = hedge

    def features(self) -> list[str]:
        return [r.feature for r in self.rules]

    def operators(self) -> list[str]:
        """All operators that a row can get, the hedge's last."""
        return [r.operator for r in self.rules] + ([self.hedge.operator] if self.hedge else [])

    def decide(self, z: Mapping[str, Column]) -> Column:
        """The operator: the largest (score, earlier place) among the rules, unless it is under the hedge."""
        scored = [
            F.struct(z[r.feature].alias("z"), F.lit(-i).alias("place"), F.lit(r.operator).alias("operator"))
            for i, r in enumerate(self.rules)
        ]
        top = F.array_max(F.array(*scored))
        if self.hedge is None:
            return top["operator"]
        return F.when(top["z"] <= self.hedge.ceiling, F.lit(self.hedge.operator)).otherwise(top["operator"])


# Which intervention each feature calls for, and the hedge when none stands out.
FEATURE_RULES = (("spread", "dense_steer"), ("concentration", "sparse_steer"), ("logit_dispersion", "local_temp"))
HEDGE_OPERATOR = "sparse_steer_random"
STANDARD = Rules(*FEATURE_RULES, hedge=Hedge(HEDGE_OPERATOR))
ARGMAX = Rules(*FEATURE_RULES)


def require_features(df: DataFrame, features: Sequence[str]) -> None:
    absent = [f for f in features if f not in df.columns]
    if absent:
        raise KeyError(f"no column for {', '.join(absent)}; the input has {', '.join(df.columns)}")


def zscore(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), eps: float | None = None) -> DataFrame:
    """Add ``z_<feature>`` per population (whole frame, or each group of ``by``).

    Population standard deviation. A constant or non-finite spread gives zeros; with ``eps`` the
    deviation is padded instead. The moments are one map-side combined aggregate; it comes back as a
    scalar subquery for the whole frame, or as a size-checked broadcast per group.
    """
    require_features(df, features)
    moments = F.struct(
        *[F.avg(f).alias(f"m_{f}") for f in features],
        *[F.stddev_pop(f).alias(f"s_{f}") for f in features],
    ).alias("moments")
    if by:
        stats = small_side(df.groupBy(*by).agg(moments))
        joined = df.join(stats, list(by))
    else:
        joined = df.withColumn("moments", df.agg(moments).scalar())

    def z(f: str) -> Column:
        centred = F.col(f) - F.col(f"moments.m_{f}")
        sd = F.col(f"moments.s_{f}")
        if eps is not None:
            return centred / (sd + eps)
        flat = sd.isNull() | (sd == 0.0) | F.isnan(sd) | (sd == float("inf"))
        return F.when(flat, F.lit(0.0)).otherwise(F.try_divide(centred, sd))

    return joined.withColumns({f"z_{f}": z(f) for f in features}).drop("moments")


def route(df: DataFrame, rules: Rules = STANDARD, by: Sequence[str] = (), eps: float | None = None) -> DataFrame:
    """Add the z-score columns and ``operator``. Rows with a null feature are an error."""
    names = rules.features()
    complete = F.size(F.filter(F.array(*[F.col(f).isNull() for f in names]), lambda x: x)) == 0
    decided = rules.decide({f: F.col(f"z_{f}") for f in names})
    stop = F.raise_error(F.lit("routing features must not be null"))
    return zscore(df, names, by, eps).withColumn("operator", F.when(complete, decided).otherwise(stop))


def route_scores(df: DataFrame, rules: Rules = STANDARD, by: Sequence[str] = ()) -> DataFrame:
    return zscore(df, rules.features(), by)


def route_records(records: DataFrame) -> DataFrame:
    """Route ``records(pid, feats, rescuers)`` by plain argmax of padded z-scores, without a hedge.

    Needs at least four records.
    """
    wide = records.withColumns({f: F.element_at("feats", i + 1) for i, f in enumerate(ARGMAX.features())})
    if wide.limit(4).count() < 4:
        raise ValueError("routing a population needs at least 4 records")
    return route(wide, ARGMAX, eps=1e-8)
