"""Control of a refresh: the order of its stages, sources with their last good capture, gates, and the rebuild of a snapshot."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlake.operators.snapshot import coverage_counts
from wattlake.sources import sinks


# The stages of a refresh in their order.
STEPS = (
    "boundaries",
    "population",
    "plant_sources",
    "plant_canonicalization",
    "country_electricity_controls",
    "official_adm1_observations",
    "modelled_adm1_residual_demand",
    "supply_balance_forecast",
    "scores",
    "artifacts",
    "validation",
    "atomic_publish",
)


@dataclass(frozen=True)
class Status:
    """How a source was served: current, cached (its last good capture), not_configured or failed."""

    source_id: str
    state: str
    message: str = ""
    rows: int | None = None


def statuses(spark: SparkSession, found: list[Status]) -> DataFrame:
    return spark.createDataFrame([(s.source_id, s.state, s.message, s.rows) for s in found], "source_id string, state string, message string, rows long")


def run_stages(stages: dict[str, Callable[[], None]], order: tuple[str, ...] = STEPS) -> None:
    """Run the stages in their one order; any that lacks or is unknown raises before the first runs."""
    lacking, unknown = [s for s in order if s not in stages], sorted(set(stages) - set(order))
    if lacking or unknown:
        raise ValueError(f"stages lacking: {lacking}, unknown: {unknown}")
    for name in order:
        stages[name]()


def serve(source_id: str, fetch: Callable[[], bytes | None], catalog: DataFrame, required: bool = True, secrets: tuple[str, ...] = ()) -> tuple[bytes | None, Status]:
    """A source's body: fetched, else its own last capture that is still whole; else an error, or not_configured for an optional one."""
    from wattlake.sources.feeds import redact

    try:
        body = fetch()
        if body:
            return body, Status(source_id, "current")
        raise RuntimeError(f"{source_id} gave nothing")
    except Exception as e:
        said = redact(str(e), secrets)
        last = sinks.latest_valid(catalog.where(F.col("source_id") == source_id)).first()
        if last is not None:
            return bytes(last["content"]), Status(source_id, "cached", f"last good capture: {said}")
        if required:
            raise RuntimeError(said) from None
        return None, Status(source_id, "not_configured", said)


def gate(counts: dict[str, int], previous: dict[str, int] | None, reconciled: dict[str, bool], may_be_zero: tuple[str, ...] = ()) -> list[str]:
    """Reasons against publishing: what does not reconcile, counts that are not positive, counts below the last snapshot's."""
    out = [f"{k} does not reconcile" for k, ok in reconciled.items() if not ok]
    out += [f"{k} is empty" for k, v in counts.items() if v < 0 or v == 0 and k not in may_be_zero]
    return out + [f"{k} dropped from {previous[k]} to {v}" for k, v in counts.items() if previous and v < previous.get(k, 0)]


def rebuild(spark: SparkSession, root: str, snapshot: str, tables: list[str], enrich: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> str:
    """Publish a snapshot made again from the last one's own tables, without fetching."""
    old = {t: sinks.read_latest(spark, root, t, verify=True) for t in tables}
    return sinks.publish(spark, root, snapshot, {**old, **enrich(old)})


def manifest(**tables: DataFrame) -> dict[str, int]:
    """Rows, countries and sources of the tables."""
    return coverage_counts(**tables).first().asDict()


def known_assumptions(d: DataFrame, technologies: tuple[str, ...]) -> DataFrame:
    """Assumptions by technology: exactly the known ones, once each, factors and credits ordered and from 0 to 1; else an error."""
    bad = lambda c: ~((F.col(f"{c}.low") >= 0) & (F.col(f"{c}.low") <= F.col(f"{c}.central")) & (F.col(f"{c}.central") <= F.col(f"{c}.high")) & (F.col(f"{c}.high") <= 1))
    row = d.where(~F.col("technology").isin(*technologies) | F.coalesce(bad("capacity_factor") | bad("capacity_credit"), F.lit(True))).orderBy("technology").first()
    if row is not None:
        raise ValueError(f"assumption of {row['technology']} is invalid")
    if sorted(r["technology"] for r in d.select("technology").collect()) != sorted(technologies):  # a closed set of ten
        raise ValueError("assumptions lack or repeat a technology")
    return d
