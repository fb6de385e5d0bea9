"""Providers of authority and speed figures, as landed JSON answers: what each needs, and which figures its answers hold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Provider:
    """``metrics``: (metric, level, paths in order of preference); level is page or domain. ``requires`` names settings."""

    name: str
    requires: tuple[str, ...]
    free: bool
    metrics: tuple[tuple[str, str, tuple[str, ...]], ...]

    def available(self, settings: dict[str, str]) -> bool:
        return all(settings.get(k) for k in self.requires)


def _field(name: str) -> tuple[str, ...]:
    """Field data of the page, else of its origin."""
    return tuple(f"$.{level}.metrics.{name}.percentile" for level in ("loadingExperience", "originLoadingExperience"))


REGISTRY: dict[str, Provider] = {}


def provider(p: Provider) -> Provider:
    """Add a provider: the extension point for further ones."""
    REGISTRY[p.name] = p
    return p


provider(Provider("psi", (), True, (
    ("lcp_ms", "page", _field("LARGEST_CONTENTFUL_PAINT_MS")), ("inp_ms", "page", _field("INTERACTION_TO_NEXT_PAINT")), ("cls_percent", "page", _field("CUMULATIVE_LAYOUT_SHIFT_SCORE")),
    ("fcp_ms", "page", _field("FIRST_CONTENTFUL_PAINT_MS")), ("performance", "page", ("$.lighthouseResult.categories.performance.score",)),
)))
provider(Provider("open_page_rank", ("opr_key",), True, (("open_page_rank", "domain", ("$.response[0].page_rank_decimal",)), ("rank", "domain", ("$.response[0].rank",)))))
provider(Provider("moz", ("moz_token",), False, (("domain_authority", "domain", ("$.results[0].domain_authority",)), ("page_authority", "page", ("$.results[0].page_authority",)), ("spam_score", "domain", ("$.results[0].spam_score",)))))


def metrics(answers: DataFrame) -> DataFrame:
    """(provider, url, level, metric, value) from landed answers (provider, url, body); figures that aren't there give no row."""
    json = F.try_parse_json("body")
    value = lambda paths: F.coalesce(*[F.try_variant_get(json, p, "double") for p in paths])
    each = [F.when(F.col("provider") == p.name, F.struct(F.lit(level).alias("level"), F.lit(metric).alias("metric"), value(paths).alias("value"))) for p in REGISTRY.values() for metric, level, paths in p.metrics]
    return answers.select("provider", "url", F.explode(F.array_compact(F.array(*each))).alias("m")).select("provider", "url", "m.*").where("value is not null")


def statuses(spark: SparkSession, settings: dict[str, str]) -> DataFrame:
    """(provider, available, free, note): for a provider that isn't set up, what it lacks."""
    rows = [(p.name, p.available(settings), p.free, "" if p.available(settings) else "set " + ", ".join(k for k in p.requires if not settings.get(k))) for p in REGISTRY.values()]
    return spark.createDataFrame(rows, "provider string, available boolean, free boolean, note string")
