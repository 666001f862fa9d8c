"""Tables that change: last write wins, conditional merge, replace by document, retention, latest state.

All are expressed as new DataFrames over the old and the new rows; ``publish`` writes one to a fresh folder and
swaps it in, so that a table is never overwritten while it is read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_write(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the highest order; one aggregation with partial maxima, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same key; columns of either side are kept."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_keeping(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Full outer merge in which an empty new value keeps the old one."""
    o, n = old.select(key, F.col(column).alias("_old")), new.select(key, F.col(column).alias("_new"))
    return o.join(n, key, "full_outer").select(key, F.when(F.coalesce(F.trim("_new"), F.lit("")) != "", F.col("_new")).otherwise(F.col("_old")).alias(column))


def replace_documents(old: DataFrame, new: DataFrame, doc: str = "doc_id") -> DataFrame:
    """All rows of the documents in new are replaced."""
    return upsert(old, new, [doc])


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def purge(rows: DataFrame, at: str, days: int, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows kept, one row with the number purged). now: default the newest time in the rows."""
    if now is None:
        edge = rows.agg(F.max(at).alias("_edge"))
        rows = rows.crossJoin(F.broadcast(edge))  # one row
    else:
        rows = rows.withColumn("_edge", now)
    old = F.col(at) < F.col("_edge") - F.make_interval(days=F.lit(days))
    return rows.filter(~F.coalesce(old, F.lit(False))).drop("_edge"), rows.filter(old).agg(F.count("*").alias("purged"))


def latest(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("changes"))


def timers(rows: DataFrame, name: str, value: str) -> DataFrame:
    """count, total, mean and maximum of each name."""
    return rows.groupBy(name).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("most"))


def publish(df: DataFrame, root: str, partition: list[str] | None = None) -> str:
    """Writes a new version under root and points root/_current at it; returns the version's folder.

    Readers use ``current``. The version before stays until the caller removes it.
    """
    spark = df.sparkSession
    path = f"{root}/v-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").json(f"{root}/_current")
    return path


def current(spark, root: str) -> DataFrame:
    path = spark.read.schema("path string").json(f"{root}/_current").first()["path"]
    return spark.read.option("mergeSchema", "true").parquet(path)


# ---------------------------------------------------------------- tables that grow columns, logs, artefacts


def ensure_columns(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with every column of name -> type; those it lacks are null, its further columns stay."""
    for name, kind in columns.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows


def with_deadlines(rows: DataFrame, text: str = "prazo_autorizacao", advice: str | None = None) -> DataFrame:
    """rows with what their deadline text says: prazo_dias, prazo_unidade, prazo_faixa, urgencia, requer_autorizacao (also told by an advice column)."""
    from garimpo.functions.numbers import deadline

    both = F.concat_ws(" ", text, advice) if advice else F.col(text)
    d, needs = deadline(F.col(text)), deadline(both)["requires_authorization"]
    return rows.withColumn("_d", d).select(*rows.columns, F.col("_d.days").alias("prazo_dias"), F.col("_d.unit").alias("prazo_unidade"), F.col("_d.faixa").alias("prazo_faixa"), F.col("_d.urgency").alias("urgencia"), needs.cast("string").alias("requer_autorizacao"))


def upsert_records(old: DataFrame | None, new: DataFrame, doc: str = "doc_id", deadline: str | None = None, advice: str | None = None) -> DataFrame:
    """The rows of the new documents replace theirs; columns of either side are kept; a deadline column brings its derived columns."""
    if deadline and deadline in new.columns:
        new = with_deadlines(new, deadline, advice if advice in new.columns else None)
    return new if old is None else replace_documents(old, new, doc)


def vectors_upsert(old: DataFrame, new: DataFrame, dim: int, key: str = "id", vector: str = "v") -> DataFrame:
    """Insert or replace by id; of an id given twice the last in ``order`` counts. Vectors of another length raise."""
    checked = new.withColumn(vector, F.when(F.size(vector) == dim, F.col(vector)).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, found "), F.size(vector).cast("string")))))
    return upsert(old, last_write(checked, [key], ["order"]).drop("order") if "order" in new.columns else checked, [key])


def append(rows: DataFrame, path: str, day: Column | None = None) -> None:
    """Adds rows to a log, by day where a day is given, so that readers and retention prune folders."""
    writer = (rows if day is None else rows.withColumn("day", day)).write.mode("append")
    (writer if day is None else writer.partitionBy("day")).parquet(path)


def touched(parents: DataFrame, children: DataFrame, key: str, at: str, updated: str = "updated_at") -> DataFrame:
    """Parents whose time of change is raised to that of their newest child."""
    newest = children.groupBy(key).agg(F.max(at).alias("_at"))
    return parents.join(newest, key, "left").withColumn(updated, F.greatest(updated, "_at")).drop("_at")


def changed(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Partial update: filled columns of changes (one row a key) replace those of rows, the others stay."""
    names = [c for c in changes.columns if c != key and c in rows.columns]
    both = rows.join(changes.select(key, *[F.col(c).alias(f"_{c}") for c in names]), key, "left")
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in rows.columns])


def drop_collection(spark, root: str, name: str) -> bool:
    """Removes the folder of a collection in a partitioned table; False if there is none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/collection={name}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def artefacts(rows: DataFrame, path: str, kind: str, column: str, key: str = "doc") -> None:
    """Writes a text column (JSON or markdown made before) under path/kind, in folders by key, without gathering it."""
    rows.select(key, F.col(column).alias("value")).write.mode("overwrite").partitionBy(key).text(f"{path}/{kind}")


def in_workspace(rows: DataFrame, workspace: str) -> DataFrame:
    return rows.filter(F.col("workspace_id") == workspace)


def workspace_of(keys: DataFrame, given: DataFrame) -> DataFrame:
    """The workspace of each request by the digest of its key; requests without a known key get none. keys: key_hash, workspace_id, active."""
    known = keys.filter("active").select("key_hash", "workspace_id").dropDuplicates(["key_hash"])
    return given.withColumn("key_hash", F.sha2("api_key", 256)).join(known, "key_hash", "left").drop("api_key", "key_hash")


def resolved_files(documents: DataFrame, files: DataFrame) -> DataFrame:
    """document, path: the file of each document by its name, else by its stem (case does not matter). files: path."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    by = files.select("path", name.alias("n"), stem(name).alias("s"))
    exact = by.groupBy("n").agg(F.min("path").alias("p1"))
    loose = by.groupBy("s").agg(F.min("path").alias("p2"))
    rows = documents.select("document", F.lower("document").alias("n")).withColumn("s", stem(F.col("n")))
    return rows.join(exact, "n", "left").join(loose, "s", "left").select("document", F.coalesce("p1", "p2").alias("path"))


def reindex_report(attempts: DataFrame) -> DataFrame:
    """status, n: indexed, skipped (no file or no text) and failed documents of a batch, and all attempted."""
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("path").isNull() | (F.coalesce(F.length("text"), F.lit(0)) == 0), "skipped").otherwise("indexed")
    counts = attempts.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    return counts.unionByName(counts.agg(F.lit("attempted").alias("status"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def transitions(events: DataFrame, key: str, status: str, *order: str) -> DataFrame:
    """key, status, before, valid: the steps of each job, and whether each follows its state machine (to 'failed' from anywhere)."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order)
    step = F.array_position(F.array(*map(F.lit, STATES)), F.col(status))
    rows = events.withColumn("before", F.lag(status).over(w)).withColumn("_b", F.lag(step).over(w))
    ok = (F.col(status) == "failed") | F.when(F.col("before").isNull(), step == 1).otherwise((step == F.col("_b") + 1) & (F.col("before") != "failed"))
    return rows.withColumn("valid", F.coalesce(ok, F.lit(False))).withColumn("progress", F.try_element_at(F.create_map(*[F.lit(x) for kv in PROGRESS.items() for x in kv]), status)).drop("_b")


# States of an ingestion job and their progress.
STATES = ("queued", "bronze_received", "silver_processing", "silver_extracted", "gold_indexing", "indexed")
PROGRESS = {"queued": 5, "bronze_received": 20, "silver_processing": 45, "silver_extracted": 65, "gold_indexing": 85, "indexed": 100}
