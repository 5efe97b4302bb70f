"""Sources: where the engine's tables come from."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V

EVENT_SCHEMA = (
    "action string, installation struct<id:long,account:struct<login:string,type:string>>, repository struct<id:long,full_name:string>, "
    "repositories array<struct<id:long,full_name:string>>, repositories_added array<struct<id:long,full_name:string>>, repositories_removed array<struct<id:long,full_name:string>>, "
    "pull_request struct<number:int,title:string,body:string,draft:boolean,head:struct<sha:string>,base:struct<sha:string>,user:struct<login:string>,labels:array<struct<name:string>>>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def diff_texts(spark: SparkSession, path: str) -> DataFrame:
    """Diff files as (diff_id, diff_text); the id is the file's name."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("diff_id"), F.col("value").alias("diff_text"))


def file_content(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Content of files at a commit: both sides keyed by (repo_id, file_path, sha)."""
    return wanted.join(files.select("repo_id", "file_path", "sha", "content"), ["repo_id", "file_path", "sha"])


def tree_blobs(entries: DataFrame) -> DataFrame:
    """The files of a tree listing (path, type, size, …); folders and submodules go."""
    return entries.where(F.col("type") == "blob")


def pr_events(deliveries: DataFrame, files: Column | None = None) -> DataFrame:
    """Webhook deliveries (delivery_id, event, body) as typed rows; works on batches and on streams."""
    p = F.from_json("body", EVENT_SCHEMA)
    rows = deliveries.withColumn("p", p)
    pr = lambda f: F.col(f"p.pull_request.{f}")
    text = lambda c: F.coalesce(c, F.lit(""))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        "delivery_id", "event", F.col("p.action").alias("action"), zero(F.col("p.installation.id")).alias("installation_id"), zero(F.col("p.repository.id")).alias("repo_id"),
        text(F.col("p.repository.full_name")).alias("repo_full_name"), zero(pr("number")).alias("pr_number"), text(pr("title")).alias("pr_title"), text(pr("body")).alias("pr_body"),
        text(pr("head.sha")).alias("head_sha"), text(pr("base.sha")).alias("base_sha"), text(pr("user.login")).alias("author"), F.coalesce(pr("draft"), F.lit(False)).alias("draft"),
        F.transform(pr("labels"), lambda x: x["name"]).alias("labels"), (F.lit(None).cast("array<string>") if files is None else files).alias("changed_files"),
    )


@dataclass
class ReviewConfig:
    enabled: bool = True
    custom_guidelines: str = ""
    ignore_patterns: list[str] = field(default_factory=list)
    severity_threshold: str = "low"
    style_review: bool = True
    language_rules: dict[str, bool] = field(default_factory=dict)


def _checked(name: str, value, default):
    """``value`` if it has the type that field ``name`` needs, else the default."""
    if name == "ignore_patterns":
        return list(value) if isinstance(value, list) and all(isinstance(x, str) for x in value) else default
    if name == "language_rules":
        return {k: v for k, v in value.items() if isinstance(k, str) and isinstance(v, bool)} if isinstance(value, dict) else default
    if name == "severity_threshold":
        return value if value in V.SEVERITIES else default
    return value if type(value) is type(default) else default


def parse_config(content: str | None) -> ReviewConfig:
    """Review settings from YAML; what isn't of the right shape, field by field, gives the default."""
    import yaml

    default = ReviewConfig()
    try:
        data = yaml.safe_load(content or "")
    except yaml.YAMLError:
        return default
    review = data.get("review") if isinstance(data, dict) else None
    if not isinstance(review, dict):
        return default
    names = {"style_review": "style"}
    given = {f: review[names.get(f, f)] for f in ReviewConfig.__dataclass_fields__ if names.get(f, f) in review}
    return ReviewConfig(**{f: _checked(f, v, getattr(default, f)) for f, v in given.items()})


def config_rows(files: DataFrame) -> DataFrame:
    """Settings of each repository (repo_id, content of its settings file or null), parsed on the executors."""
    fields = ["enabled", "custom_guidelines", "ignore_patterns", "severity_threshold", "style_review"]

    @F.pandas_udf("enabled boolean, custom_guidelines string, ignore_patterns array<string>, severity_threshold string, style_review boolean")
    def run(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([[getattr(parse_config(c), f) for f in fields] for c in content], columns=fields)

    return files.select("repo_id", run("content").alias("c")).select("repo_id", "c.*")


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup."""
    return df.where(F.col(key) == F.lit(value))


def kv_get(keys: DataFrame, store: DataFrame, now: Column | None = None) -> DataFrame:
    """Values of keys in an append log with expiry (key, value, expires_at); null where there is none alive."""
    now = F.current_timestamp() if now is None else now
    alive = store.where(F.col("expires_at") > now).groupBy("key").agg(F.max_by("value", F.struct("expires_at", "value")).alias("value"))
    return keys.join(alive, "key", "left")
