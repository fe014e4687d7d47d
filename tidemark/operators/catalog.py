"""Bases, file trees, models and agents: listings, checks, updates and deletions as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import strip

# Which model kinds each API schema serves.
SERVED = {
    "openai": ("bi-encoder", "decoder"),
    "tei": ("bi-encoder", "cross-encoder", "late-interaction"),
    "cohere": ("cross-encoder",),
    "google_genai": ("bi-encoder", "decoder"),
}
TEXT_PREFIX = "text/"
PDF = "application/pdf"
IMAGES = ("image/png", "image/jpeg", "image/jpg", "image/webp", "image/tiff", "image/bmp", "image/gif")


# --- listings -------------------------------------------------------------------------------


def page_of(df: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """One page of a sorted listing; put a unique id last in `order`."""
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def total_of(df: DataFrame) -> DataFrame:
    """The size of the whole filtered listing a page is taken from."""
    return df.agg(F.count("*").alias("total"))


def in_dates(df: DataFrame, column: str, date_from=None, date_to=None) -> DataFrame:
    """Both ends count, and each may be open."""
    if date_from is not None:
        df = df.where(F.col(column) >= F.lit(date_from))
    if date_to is not None:
        df = df.where(F.col(column) <= F.lit(date_to))
    return df


def file_counts(kbs: DataFrame, nodes: DataFrame) -> DataFrame:
    counts = nodes.where("type = 'file'").groupBy("kb_id").agg(F.count("*").alias("file_count"))
    return kbs.join(counts, "kb_id", "left").withColumn("file_count", F.coalesce("file_count", F.lit(0)))


def folder_order() -> tuple[Column, ...]:
    return (F.col("type") != "folder").asc(), F.lower("name").asc(), F.col("node_id").asc()


def list_folder(nodes: DataFrame, kb_id, parent_id) -> DataFrame:
    """Children of a folder, or of the root when parent_id is None: folders first, then by name."""
    inside = (F.col("kb_id") == kb_id) & F.col("parent_id").eqNullSafe(F.lit(parent_id))
    return nodes.where(inside).orderBy(*folder_order())


def list_all_folders(nodes: DataFrame) -> DataFrame:
    """Every folder's listing in one sort; the id as last key lets Spark cut inside a large one."""
    return nodes.orderBy("kb_id", "parent_id", *folder_order())


def file_chunks(parents: DataFrame, doc_id) -> DataFrame:
    return parents.where(F.col("doc_id") == doc_id).orderBy("seq")


# --- file trees -----------------------------------------------------------------------------


def file_kind(mime_type: Column) -> Column:
    """text, pdf or image; NULL for what cannot be read."""
    plain = F.lower(strip(F.split_part(mime_type, F.lit(";"), F.lit(1))))
    return (
        F.when(F.startswith(plain, F.lit(TEXT_PREFIX)), "text")
        .when(plain == PDF, "pdf")
        .when(plain.isin(*IMAGES), "image")
    )


def route_files(nodes: DataFrame) -> DataFrame:
    """Files with their kind; those that cannot be read are failed rows with a reason."""
    kind = file_kind(F.col("mime_type"))
    reason = F.concat(F.lit("Unsupported file type: "), F.coalesce("mime_type", F.lit("None")))
    return (
        nodes.withColumn("kind", kind)
        .withColumn("status", F.when(F.col("kind").isNull(), "failed").otherwise(F.col("status")))
        .withColumn("error", F.when(F.col("kind").isNull(), reason))
    )


def deletable_folders(nodes: DataFrame) -> DataFrame:
    """Folders without a child. Parents are counted once each before the join."""
    used = nodes.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("node_id")).distinct()
    return nodes.where("type = 'folder'").join(used, "node_id", "left_anti")


def mark_out_of_sync(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Completed files of bases in changed(kb_id) no longer match their base."""
    marks = changed.select("kb_id").distinct().withColumn("_changed", F.lit(True))
    stale = F.coalesce("_changed", F.lit(False)) & (F.col("status") == "completed")
    return (
        nodes.join(marks, "kb_id", "left")
        .withColumn("status", F.when(stale, "out_of_sync").otherwise(F.col("status")))
        .drop("_changed")
    )


def resync(nodes: DataFrame, kbs: DataFrame) -> DataFrame:
    """Out-of-sync files, ready to be built again with their base's present config."""
    waiting = nodes.where("type = 'file' AND status = 'out_of_sync'").drop("config")
    return (
        waiting.join(kbs.select("kb_id", "config"), "kb_id")
        .withColumn("status", F.lit("processing"))
        .withColumn("error", F.lit(None).cast("string"))
    )


def cascade_delete(tables: dict[str, DataFrame], deleted: DataFrame, key: str) -> dict[str, DataFrame]:
    """What is left of each table once the keys in `deleted` and all their rows are gone."""
    gone = deleted.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


# --- references and keys --------------------------------------------------------------------


def with_model_name(datasets: DataFrame, models: DataFrame) -> DataFrame:
    """Datasets with the name of the model that wrote them, NULL once it is deleted."""
    names = models.select("model_id", F.col("name").alias("model_name"))
    return datasets.join(names, "model_id", "left")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row. As in SQL, a key with a NULL in it equals no other."""
    known = df.dropna(subset=list(keys))
    return known.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def null_dangling(df: DataFrame, key: str, targets: DataFrame) -> DataFrame:
    """References whose target is gone become NULL."""
    there = targets.select(key).distinct().withColumn("_there", F.lit(True))
    joined = df.join(there, key, "left")
    return joined.withColumn(key, F.when(F.col("_there"), F.col(key))).drop("_there")


def drop_dangling(df: DataFrame, key: str, targets: DataFrame) -> DataFrame:
    """Rows whose owner is gone go with it."""
    owners = targets.select(key).distinct()
    return df.join(owners, key, "left_semi")


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """Row count and last change of a table: the key under which results of it may be kept."""
    return df.agg(F.count("*").alias("rows"), F.max("updated_at").alias("updated_at")).withColumn(
        "table", F.lit(name)
    )


def invalid_models(models: DataFrame) -> DataFrame:
    """Models whose kind their API schema does not serve."""
    allowed = F.lit(False)
    for schema, kinds in SERVED.items():
        allowed = allowed | ((F.col("schema") == schema) & F.col("capability").isin(*kinds))
    return models.where(~F.coalesce(allowed, F.lit(False)))


# --- agents ---------------------------------------------------------------------------------


def agent_summary(agents: DataFrame) -> DataFrame:
    """agents(agent_id, name, tools array<struct<name, enabled>>, mode, targets array<...>)."""
    return agents.select(
        "agent_id",
        "name",
        F.col("mode").alias("handoff_mode"),
        F.size(F.filter("tools", lambda t: t["enabled"])).alias("enabled_tool_count"),
        F.size("targets").alias("handoff_count"),
    )


def handoff_edges(agents: DataFrame) -> DataFrame:
    """Who may hand over to whom.

    `manual` agents give one row per listed target that exists and is not the agent itself;
    without a text of its own the target's description is used. An `auto` agent may reach
    every other agent, which is one row with target NULL rather than a row per pair;
    allowed_transfers resolves it for transfers actually asked for.
    """
    listed = (
        agents.where("mode = 'manual'")
        .select("agent_id", F.inline("targets"))
        .where("target_id <> agent_id")
        .withColumnRenamed("description", "_own")
    )
    roster = agents.select(F.col("agent_id").alias("target_id"), "description")
    manual = listed.join(roster, "target_id").select(
        "agent_id",
        "target_id",
        F.coalesce(F.nullif("_own", F.lit("")), "description").alias("description"),
    )
    auto = agents.where("mode = 'auto'").select(
        "agent_id",
        F.lit(None).cast(agents.schema["agent_id"].dataType).alias("target_id"),
        F.lit(None).cast("string").alias("description"),
    )
    return manual.unionByName(auto)


def allowed_transfers(transfers: DataFrame, agents: DataFrame) -> DataFrame:
    """transfers(agent_id, target_id, ...) that the roster allows, with the edge's description."""
    edges = handoff_edges(agents)
    auto = edges.where("target_id IS NULL").select("agent_id")
    known = agents.select(F.col("agent_id").alias("target_id"), "description")
    open_ended = transfers.where("target_id <> agent_id").join(auto, "agent_id", "left_semi").join(known, "target_id")
    named = edges.where("target_id IS NOT NULL")
    listed = transfers.join(named, ["agent_id", "target_id"])
    return open_ended.unionByName(listed)


def keyed_merge(incoming: DataFrame, stored: DataFrame, owner: str, name: str, secret: str) -> DataFrame:
    """The incoming list replaces the stored one; a row sent without its secret keeps the old.

    incoming has `needs_secret`: where that is false no secret is kept.
    """
    old = stored.select(owner, name, F.col(secret).alias("_stored"))
    kept = F.when(F.col("needs_secret"), F.coalesce(secret, "_stored"))
    return incoming.join(old, [owner, name], "left").withColumn(secret, kept).drop("_stored")


def exclusive_flag(df: DataFrame, key: str, chosen, flag: str) -> DataFrame:
    """Set the flag on one row and clear it on all others."""
    return df.withColumn(flag, F.col(key) == F.lit(chosen))
