"""The registry of sources: a small dimension, joined by slug."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DEFAULT_SOURCE_TYPE, REGISTRY

REQUIRED = [f.name for f in REGISTRY if not f.nullable]


def registry(spark: SparkSession, sources: Iterable[Mapping]) -> DataFrame:
    """Sources as a table; raises where a required key is missing or a slug or feed URL repeats."""
    rows = [dict(s) for s in sources]
    for s in rows:
        if missing := [k for k in REQUIRED if not s.get(k)]:
            raise ValueError(f"source {s.get('slug')!r} lacks {', '.join(missing)}")
    for key in ("slug", "feed_url"):
        seen: set = set()
        for s in rows:
            if s[key] in seen:
                raise ValueError(f"{key} {s[key]!r} occurs twice")
            seen.add(s[key])
    return spark.createDataFrame([tuple(s.get(f.name) for f in REGISTRY) for s in rows], REGISTRY)


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """From a JSON-lines or YAML file; YAML needs its parser to be installed."""
    if path.endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the yaml package; use JSON lines") from e
        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
        loaded = yaml.safe_load(text)
        return registry(spark, loaded["sources"] if isinstance(loaded, dict) else loaded)
    return registry(spark, [r.asDict(recursive=True) for r in spark.read.schema(REGISTRY).json(path).collect()])


def selected(sources: DataFrame, slugs: list[str]) -> DataFrame:
    """The sources with these slugs; raises on one that is unknown."""
    rows = sources.where(F.col("slug").isin(*slugs))
    unknown = set(slugs) - {r.slug for r in rows.select("slug").collect()}
    if unknown:
        raise ValueError(f"unknown sources: {', '.join(sorted(unknown))}")
    return rows


def with_source(articles: DataFrame, sources: DataFrame, *attributes: str) -> DataFrame:
    """Articles with attributes of their source, null for one that is not registered.

    The registry is configuration, tens of rows; the planner's own size check
    turns the join into a broadcast.
    """
    small = sources.select(F.col("slug").alias("_slug"), *(F.col(a).alias(f"source_{a}" if a in articles.columns else a) for a in attributes))
    return articles.join(small, F.col("source_name") == F.col("_slug"), "left").drop("_slug")


def slugs_with(sources: DataFrame, key: str, values: list[str], default: str | None = None) -> DataFrame:
    """The slugs of sources whose attribute is one of ``values``."""
    column = F.coalesce(F.col(key), F.lit(default)) if default is not None else F.col(key)
    return sources.where(column.isin(*values)).select("slug")


def source_type(column: Column) -> Column:
    return F.coalesce(column, F.lit(DEFAULT_SOURCE_TYPE))


def normalized_list(values: Iterable[str] | None, lower: bool = True) -> list[str] | None:
    """Request lists: stripped, lower-cased, each once; an empty one is none."""
    return list(dict.fromkeys(v.strip().lower() if lower else v.strip() for v in values or ())) or None
