"""The page table: the newest known state of each address, refreshed by batches of fetches.

Keys are hashed into slots. A batch rewrites the slots that it touches, each as a new version beside the old one, and then notes
which slots have a new version; a reader takes the latest version of each slot. So a batch that fails half-way changes nothing, a
batch that is given again writes the same folders, and readers of an older note are not disturbed. The newest fetch of an address
wins, whatever batch brings it; of fetches of one moment the one of the larger content. A page that is not there (404) is remembered
as missing, so that it is not asked for again; other failures leave what is known.

Below the table's folder: ``pages/batch=N/slot=S`` (url, page_key, status, html, fetched_at) and ``notes/batch=N`` (slot).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabary.functions.text import fetch_status, url_key

#: Slots of a new table; a table keeps the number that it was begun with.
SLOTS = 256
_ROW = "url string, page_key string, status string, html string, fetched_at timestamp"


def _newest() -> Column:
    return F.struct("fetched_at", "status", F.coalesce("html", F.lit("")).alias("said"))


def _latest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The batch of the latest version of each slot (as many rows as slots), of batches ``before`` one."""
    try:
        notes = spark.read.schema("slot int, batch long").parquet(f"{path}/notes")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return {}
    notes = notes if before is None else notes.filter(F.col("batch") < before)
    return {r["slot"]: r["batch"] for r in notes.groupBy("slot").agg(F.max("batch").alias("batch")).collect()}


def _versions(spark: SparkSession, path: str, latest: dict[int, int]) -> DataFrame:
    """The rows of some slots' versions, by partition pruning."""
    if not latest:
        return spark.createDataFrame([], f"{_ROW}, slot int")
    by_batch: dict[int, list[int]] = {}
    for slot, batch in latest.items():
        by_batch.setdefault(batch, []).append(slot)
    wanted = F.lit(False)
    for batch, slots in by_batch.items():
        wanted = wanted | ((F.col("batch") == batch) & F.col("slot").isin(slots))
    return spark.read.schema(f"{_ROW}, batch long, slot int").parquet(f"{path}/pages").filter(wanted).drop("batch")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``url, page_key, status, html, fetched_at``: a row for each address of the table; status is ok or skip (known to be missing)."""
    return _versions(spark, path, _latest(spark, path)).drop("slot")


def upsert(fetches: DataFrame, number: int, path: str, slots: int = SLOTS) -> None:
    """Bring batch ``number`` of fetches (``url, code, html, fetched_at``) into the table. Null addresses and times are left out."""
    spark = fetches.sparkSession
    status = fetch_status(F.col("code"))
    new = fetches.filter("url is not null and fetched_at is not null and code is not null").withColumn("status", status).filter("status <> 'fail'")
    html = F.when(F.col("status") == "ok", F.coalesce("html", F.lit("")))
    rows = new.select("url", url_key(F.col("url")).alias("page_key"), "status", html.alias("html"), "fetched_at").withColumn("slot", F.pmod(F.xxhash64("page_key"), F.lit(slots)).cast("int"))
    # Each address's newest fetch of the batch; rows of one address are combined before they are shuffled.
    whole = F.struct(*[x.split()[0] for x in _ROW.split(", ")], "slot")
    own = rows.groupBy("page_key").agg(F.max_by(whole, _newest()).alias("r")).select("r.*")
    touched = {r["slot"] for r in own.select("slot").distinct().collect()}  # as many as slots
    latest = {s: b for s, b in _latest(spark, path, number).items() if s in touched}
    both = _versions(spark, path, latest).select(own.columns).unionByName(own)
    merged = both.groupBy("page_key").agg(F.max_by(whole, _newest()).alias("r")).select("r.*")
    merged.repartition("slot", F.pmod(F.xxhash64("page_key", F.lit(1)), F.lit(16))).write.mode("overwrite").partitionBy("slot").parquet(f"{path}/pages/batch={number}")
    spark.createDataFrame([(s,) for s in sorted(touched)], "slot int").coalesce(1).write.mode("overwrite").parquet(f"{path}/notes/batch={number}")


def look_up(wanted: DataFrame, url: str, table: DataFrame, fresh_since: Column | None = None) -> DataFrame:
    """``wanted`` with ``page_state`` and ``page_html``: held, missing, stale (fetched before ``fresh_since``; asked for again) or unknown."""
    held = table.select(F.col("page_key").alias("held_key"), F.col("status").alias("held_status"), F.col("html").alias("page_html"), "fetched_at")
    rows = wanted.join(held, url_key(F.col(url)) == F.col("held_key"), "left")
    stale = F.lit(False) if fresh_since is None else F.col("fetched_at") < fresh_since
    state = F.when(F.col("held_key").isNull(), "unknown").when(stale, "stale").when(F.col("held_status") == "skip", "missing").otherwise("held")
    return rows.withColumn("page_state", state).drop("held_key", "held_status", "fetched_at")
