"""Scouting notes: append-only versions, one thread an author and player."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stores import Store


def player_key(player_id: Column, name: Column) -> Column:
    """``id:`` and the id, else ``name:`` and a slug."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(player_id, F.lit("")) != "", F.concat(F.lit("id:"), player_id)).otherwise(F.concat(F.lit("name:"), slug))


def thread_token() -> Column:
    return F.coalesce(F.concat(F.lit("a"), F.col("author_id").cast("string")), F.concat(F.lit("legacy:"), F.coalesce("author", F.lit(""))))


def latest_threads(versions: DataFrame, authors: DataFrame | None = None, role: str | None = None) -> DataFrame:
    """The newest version of each thread, unless it is a tombstone."""
    named = versions.withColumn("thread", thread_token())
    order = Window.partitionBy("player_key", "thread").orderBy(F.desc("created_at"), F.desc("id"))
    live = named.withColumn("_n", F.row_number().over(order)).where("_n = 1 AND deleted = 0").drop("_n")
    live = live.where(F.col("role") == role) if role in ("pitcher", "batter") else live
    if authors is None:
        return live.withColumn("author_name", F.lit(None).cast("string"))
    return live.join(authors.select(F.col("id").alias("author_id"), F.col("display_name").alias("author_name")), "author_id", "left")


def shortlist(threads: DataFrame, author: str | None = None) -> DataFrame:
    """One row a player: best and span of ratings, authors newest first, the newest version's text fields."""
    rows = threads.where(F.lower(F.trim(F.coalesce("author", F.lit("")))) == author.strip().lower()) if author else threads
    newest = F.struct("created_at", "id")
    said = F.struct(F.col("created_at"), F.col("id"), F.coalesce("author_name", "author", F.lit("—")).alias("by"))
    grouped = rows.groupBy("player_key").agg(
        F.count("*").alias("reports"), F.max("ovr").alias("ovr_max"), F.min("ovr").alias("ovr_min"),
        F.reverse(F.array_sort(F.collect_list(said))).alias("said"), *[F.max_by(c, newest).alias(c) for c in ("player_name", "role", "school", "position")],
    )
    low, high = F.col("ovr_min").cast("string"), F.col("ovr_max").cast("string")
    label = F.when(high.isNull(), "").when(low == high, high).otherwise(F.concat(low, F.lit("–"), high))
    by = F.array_join(F.transform("said", lambda s: s["by"]), ", ")
    return grouped.select("player_key", F.trim(F.coalesce("player_name", F.lit(""))).alias("player_name"), "role", "school", "position", "reports", "ovr_max", label.alias("ovr_label"), by.alias("authors_label"))


def search(entries: DataFrame, text: str, column: str = "ovr_max", descending: bool = True) -> DataFrame:
    """Entries that hold the text in one of four fields, sorted with blanks last."""
    held = F.lower(F.concat_ws("\n", "player_name", "school", "position", "authors_label")).contains(text.strip().lower())
    order = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return entries.where(held).orderBy(order, "player_key")


def report_authors(threads: DataFrame) -> DataFrame:
    known = threads.where(F.trim(F.coalesce("author", F.lit(""))) != "")
    names = known.groupBy(F.trim("author").alias("initials")).agg(F.max_by(F.coalesce("author_name", F.trim("author")), F.struct("created_at", "id")).alias("name"))
    return names.orderBy(F.lower("name"), "initials")


def history(versions: DataFrame, key: str, thread: str) -> DataFrame:
    rows = versions.where((F.col("player_key") == key) & (thread_token() == thread) & (F.col("deleted") == 0))
    return rows.orderBy(F.desc("created_at"), F.desc("id"))


def tombstone(versions: DataFrame, key: str, thread: str, now: str, next_id: int) -> DataFrame:
    """The row that ends a thread: the last version's identity, deleted. Empty where there is no such thread."""
    rows = versions.where((F.col("player_key") == key) & (thread_token() == thread)).orderBy(F.desc("created_at"), F.desc("id")).limit(1)
    kept = {"player_key", "player_name", "player_id", "role", "author", "author_id"}
    new = {"id": F.lit(next_id), "deleted": F.lit(1), "created_at": F.lit(now)}
    return rows.select(*[new[f.name].cast(f.dataType).alias(f.name) if f.name in new else F.col(f.name) if f.name in kept else F.lit(None).cast(f.dataType).alias(f.name) for f in versions.schema])


#: Columns of a stored version.
VERSION = (
    "id long, player_key string, player_name string, player_id string, role string, school string, position string, ovr int, author string, "
    "author_id long, body string, grades string, deleted int, created_at string, report_date string, bats_throws string"
)


def stored_versions(spark: SparkSession, path: str) -> DataFrame:
    """All versions ever saved; none where nothing was."""
    return Store(spark, path, VERSION).read().drop("seq")


def save_version(spark: SparkSession, path: str, now: str, **fields) -> int:
    """Appends a version of a thread and returns its id. Nothing is changed in place."""
    store = Store(spark, path, VERSION)
    number = (store.read().agg(F.max("id")).first()[0] or 0) + 1
    known = fields | {"id": number, "deleted": 0, "created_at": now}
    key = player_key(F.lit(known.get("player_id")).cast("string"), F.lit(known.get("player_name")).cast("string"))
    row = store.rows(tuple(known.get(c.split()[0]) for c in VERSION.split(", ")))
    store.save(row.withColumn("player_key", F.coalesce("player_key", key)))
    return number


def delete_thread(spark: SparkSession, path: str, key: str, thread: str, now: str) -> bool:
    """Ends a thread with a tombstone; False where there is none."""
    store = Store(spark, path, VERSION)
    held = store.read().drop("seq")
    end = tombstone(held, key, thread, now, (held.agg(F.max("id")).first()[0] or 0) + 1)
    if end.isEmpty():
        return False
    store.save(spark.createDataFrame(end.collect(), VERSION))
    return True


GRADES = "Control int, pitches array<struct<name string, grade int>>, Hit int, Power int, Run int, Field int, Arm int"


def grades_line(grades: Column, role: Column) -> Column:
    """Grades in one line: control and pitches, or a hitter's tools."""
    read = F.from_json(grades, GRADES)
    said = lambda n: F.when(read[n].isNotNull(), F.concat(F.lit(f"{n} "), read[n].cast("string")))
    each = F.transform(F.filter(read["pitches"], lambda p: F.coalesce(p["name"], F.lit("")) != ""), lambda p: F.concat_ws(" ", p["name"], p["grade"].cast("string")))
    tools = F.concat_ws("  |  ", *[said(n) for n in ("Hit", "Power", "Run", "Field", "Arm")])
    return F.when(role == "pitcher", F.concat_ws("  |  ", said("Control"), each)).otherwise(tools)


def date_stamp(day: Column, form: str = "MMM d, yyyy") -> Column:
    return F.coalesce(F.date_format(day.try_cast("timestamp"), form), day, F.lit(""))


def widened(old: DataFrame, new: DataFrame) -> DataFrame:
    """Versions of an older column set with the newer ones."""
    return old.unionByName(new, allowMissingColumns=True)
