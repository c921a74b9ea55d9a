"""The record store: paths, what a write would do, bundles and the vector index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import jstext

#: The folders of the record types.
FOLDERS = {"decision": "decisions", "architecture": "architecture", "convention": "conventions", "todo": "todos", "issue": "issues"}


def paths(memories: DataFrame) -> DataFrame:
    """(mem_no, path): where each record is stored."""
    author = F.coalesce(F.nullif(jstext.author_slug(F.col("author")), F.lit("")), F.lit("unknown"))
    folder = F.coalesce(*(F.when(F.col("mem_type") == k, v) for k, v in FOLDERS.items()), F.lit("other"))
    name = F.concat(F.coalesce("mem_date", F.lit("")), F.lit("-"), jstext.slug(F.col("title")), F.lit(".md"))
    return memories.select("mem_no", F.concat_ws("/", author, folder, name).alias("path"))


def write_actions(new: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """new (path, content) with action: created, skipped, or with force updated where the content differs."""
    old = existing.groupBy(F.col("path").alias("__path")).agg(F.max("content").alias("__old"))
    joined = new.join(old, F.col("path") == F.col("__path"), "left")
    changed = F.lit(force) & ~F.col("content").eqNullSafe(F.col("__old"))
    action = F.when(F.col("__path").isNull(), "created").when(changed, "updated").otherwise("skipped")
    return joined.withColumn("action", action).drop("__path", "__old")


def import_key(df: DataFrame) -> DataFrame:
    """df with the key that decides whether a bundle's record is already stored."""
    key = F.concat_ws("|", F.coalesce("author", F.lit("")), F.coalesce("mem_type", F.lit("")), F.coalesce("mem_date", F.lit("")), F.lower(jstext.trim(F.coalesce("title", F.lit("")))))
    return df.withColumn("import_key", key)


def import_plan(bundle: DataFrame, stored: DataFrame) -> DataFrame:
    """bundle with import_action: skip where a stored record has the key, else import. Repeats inside the bundle stay."""
    keys = import_key(stored).select(F.col("import_key").alias("__k")).distinct()
    joined = import_key(bundle).join(keys, F.col("import_key") == F.col("__k"), "left")
    return joined.withColumn("import_action", F.when(F.col("__k").isNull(), "import").otherwise("skip")).drop("__k")


def index_state(memories: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, state): unindexed for records without vector, stale for vectors without record."""
    ids = memories.select(jstext.memory_id(F.col("mem_type"), F.col("title"), F.col("mem_date")).alias("id")).distinct()
    have = entries.where("vector is not null").select("id").distinct()
    return ids.join(have, "id", "left_anti").withColumn("state", F.lit("unindexed")).unionByName(have.join(ids, "id", "left_anti").withColumn("state", F.lit("stale")))


def index_updates(memories: DataFrame, entries: DataFrame, model: str) -> DataFrame:
    """(id, action): add for records without a vector of this model, drop for vectors without record.

    A vector of another model does not count, so that a change of the model adds every record.
    """
    ids = memories.select(jstext.memory_id(F.col("mem_type"), F.col("title"), F.col("mem_date")).alias("id")).distinct()
    have = entries.where("id is not null").groupBy("id").agg(F.max((F.col("model") == model) & F.col("vector").isNotNull()).alias("sound"))
    add = ids.join(have.where("sound").select("id"), "id", "left_anti").withColumn("action", F.lit("add"))
    return add.unionByName(have.select("id").join(ids, "id", "left_anti").withColumn("action", F.lit("drop")))


def resolve(memories: DataFrame, words: str, undo: bool = False) -> DataFrame:
    """memories with status set to resolved, or active with undo, where title or file_path contains the words; changed says where it was another."""
    hit = F.lit(False)
    for c in ("title", "file_path"):
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(words.lower())), F.lit(False))
    target = "active" if undo else "resolved"
    changed = hit & (F.when(F.col("status") == "resolved", "resolved").otherwise("active") != target)
    return memories.withColumn("changed", changed).withColumn("status", F.when(F.col("changed"), target).otherwise(F.col("status")))


def vacuumed(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """The rows of a manifest (source_id, path) whose file still exists; conversations without any drop out."""
    return manifest.join(existing.select("path").distinct(), "path", "left_semi").select("source_id", "path").distinct()


def write(memories: DataFrame, folder: str, force: bool = False) -> dict[str, int]:
    """Writes the records that are new, or with force changed, under folder and returns how many were created, updated and skipped.

    The store is a parquet table of (path, author, mem_type, raw, ...) partitioned by author and
    type; files of a path that is written anew are replaced with their partition. Of records
    with one path the lowest mem_no counts. A repeated write of the same records changes nothing.
    """
    from pyspark.errors import AnalysisException

    from skein.sources import records

    spark = memories.sparkSession
    raw = records.rendered(memories).join(paths(memories), "mem_no").join(memories.select("mem_no", "mem_type", "author"), "mem_no")
    new = raw.groupBy("path").agg(F.min(F.struct("mem_no", "raw", "mem_type", "author")).alias("r")).select("path", F.col("r.raw").alias("content"), F.coalesce("r.mem_type", F.lit("other")).alias("mem_type"), F.split("path", "/")[0].alias("author"))
    try:
        old = spark.read.parquet(folder)
    except AnalysisException:
        old = spark.createDataFrame([], new.schema)
    from skein.runtime import cut

    planned = cut(write_actions(new, old.select("path", "content"), force))
    counts = {r.action: r["count"] for r in planned.groupBy("action").count().collect()}
    fresh = planned.where("action <> 'skipped'").drop("action")
    touched = fresh.select("author", "mem_type").distinct()
    kept = old.join(touched, ["author", "mem_type"], "left_semi").join(fresh.select("path"), "path", "left_anti")
    merged = cut(fresh.unionByName(kept.select(*fresh.columns)))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("author", "mem_type").parquet(folder)
    return {a: counts.get(a, 0) for a in ("created", "updated", "skipped")}


def save(df: DataFrame, folder: str) -> int:
    """Writes a table as the next version under folder, so that readers keep what they read, and returns its number."""
    last = version(df.sparkSession, folder)
    df.write.mode("overwrite").parquet(f"{folder}/version={(last or 0) + 1}")
    return (last or 0) + 1


def version(spark, folder: str) -> int | None:
    """The newest complete version under folder, None for none. The folder is listed once."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [s.getPath() for s in fs.listStatus(path)]
    done = [int(p.getName().split("=")[1]) for p in names if p.getName().startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(done, default=None)


def load(spark, folder: str, schema: str) -> DataFrame:
    """The newest version of a table, empty where there is none."""
    found = version(spark, folder)
    return spark.createDataFrame([], schema) if found is None else spark.read.schema(schema).parquet(f"{folder}/version={found}")


def remember(spark, record: dict, folder: str, vectors: str, embed, model: str) -> str:
    """Writes one record and its vector, and returns the record's id; an older vector of the id is replaced."""
    from skein.operators.extraction import embedded

    fields = ("mem_no", "mem_type", "title", "mem_date", "context", "content", "reasoning", "alternatives", "impact", "source_id", "source_title", "source_type", "author", "status")
    one = spark.createDataFrame([tuple(record.get(f) for f in fields)], "mem_no bigint, " + ", ".join(f"{f} string" for f in fields[1:]))
    write(one, folder, force=True)
    text = jstext.embed_text(*(F.col(c) for c in ("mem_type", "title", "content", "context", "reasoning", "impact")))
    fresh = embedded(one.select(jstext.memory_id(F.col("mem_type"), F.col("title"), F.col("mem_date")).alias("id"), text.alias("text")), "id", "text", embed).withColumn("model", F.lit(model))
    kept = load(spark, vectors, "id string, vector array<float>, model string").join(fresh.select("id"), "id", "left_anti")
    save(kept.unionByName(fresh), vectors)
    return one.select(jstext.memory_id(F.col("mem_type"), F.col("title"), F.col("mem_date"))).first()[0]
