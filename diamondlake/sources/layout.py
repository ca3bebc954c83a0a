"""The served tree: part/year/month/day partitions, compaction, discovery, sinks.

One layout serves ``write_tree``, ``compact`` and ``read_tree``: folders ``part=D1/file_year=2024/month=05/day=01``. A
compacted year lies in ``month=all/day=all`` of its year, a compacted month in ``day=all`` of its month, so all files
stay at one depth and partition discovery goes on working; ``read_tree`` takes month and day of their rows from the
file's name. Trees of plain folders (``D1/2024/05/01``) are compacted too, to a file in the year's or month's folder.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ("D1", "Others")
UNKNOWN = "unknown_date"
#: The folder value of compacted rows.
WHOLE = "all"
#: Bytes of a compacted file, about.
FILE_BYTES = 512 << 20


def routed(rows: DataFrame) -> DataFrame:
    """Partition columns: D1 or Others by the file's level, the day by the file's name."""
    from ..operators.fold import file_date, game_flags

    day = file_date(F.col("file_name"))
    level = game_flags(rows).select("file_name", F.col("level").alias("_level"))
    text = lambda form: F.coalesce(F.date_format(day, form), F.lit(UNKNOWN if form == "yyyy" else ""))
    out = rows.join(level, "file_name").withColumn("part", F.when(F.col("_level") == "D1", "D1").otherwise("Others")).drop("_level")
    return out.withColumns({"file_year": text("yyyy"), "month": text("MM"), "day": text("dd")})


def write_tree(rows: DataFrame, path: str, mode: str = "append") -> None:
    """One exchange by partition first, so each day gets few files."""
    keys = ["part", "file_year", "month", "day"]
    rows.repartition(*keys).write.mode(mode).partitionBy(*keys).option("compression", "zstd").parquet(path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """Partition values stay strings, as the paths have them; schemas are united by name. Rows of compacted files have
    the month and day of their file's name."""
    from ..operators.fold import file_date

    was = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    try:
        rows = spark.read.option("mergeSchema", "true").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", was)
    if not {"month", "day", "file_name"} <= set(rows.columns):
        return rows
    named = lambda c, form: F.when(F.col(c) == WHOLE, F.date_format(file_date(F.col("file_name")), form)).otherwise(F.col(c))
    return rows.withColumns({"month": named("month", "MM"), "day": named("day", "dd")})


def path_level_year(path: Column) -> Column:
    """struct(level, year) from any path of the tree."""
    form = r"/(?:part=)?(D1|Others)/(?:file_year=)?(\d{4})/"
    pick = lambda i: F.nullif(F.regexp_extract(path, form, i), F.lit(""))
    return F.struct(pick(1).alias("level"), pick(2).alias("year"))


def unknown_dates(rows: DataFrame) -> DataFrame:
    """Rows that no year-based table sees."""
    return rows.where(F.col("file_year") == UNKNOWN).groupBy("part").agg(F.count("*").alias("rows"))


class Tree:
    """Files of a tree through Hadoop's file system, so any store works."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self.spark, self.root = spark, root.rstrip("/")
        self.Path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def files(self, under: str) -> list[str]:
        top, out = self.Path(under), []
        if not self.fs.exists(top):
            return out
        found = self.fs.listFiles(top, True)
        while found.hasNext():
            p = found.next().getPath().toString()
            if p.endswith(".parquet") and not re.search(r"/[._][^/=]*(/|$)", p[len(self.root) :]):
                out.append(p)
        return out

    def children(self, under: str) -> list[str]:
        top = self.Path(under)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(top) if s.isDirectory()) if self.fs.exists(top) else []

    def size(self, path: str) -> int:
        return self.fs.getFileStatus(self.Path(path)).getLen()

    def replace(self, source: str, target: str) -> None:
        """A rename that takes the place of what is there, in one step."""
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        where = self.fs.makeQualified(self.Path(target))
        self.fs.mkdirs(where.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self.fs.makeQualified(self.Path(source)), where, options)

    def merge(self, inputs: list[str], out: str, name: str) -> int:
        """All inputs as one file ``name`` in ``out``, in order of their names, or as several of ``FILE_BYTES`` and made
        by as many tasks. Row counts must agree before anything moves.

        What will replace what is noted first, so that a run that ends anywhere after is finished by ``recover``.
        """
        inputs = sorted(set(inputs), key=lambda p: p.rsplit("/", 1)[1])
        rows = self.spark.read.option("mergeSchema", "true").parquet(*inputs)
        places = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        n = max(1, -(-sum(map(self.size, inputs)) // FILE_BYTES))
        mark = uuid.uuid4().hex
        stage = f"{self.root}/.stage-{mark}"
        dealt = places.coalesce(1) if n == 1 else places.repartitionByRange(n, "_file", "_row")
        dealt.sortWithinPartitions("_file", "_row").drop("_file", "_row").write.option("compression", "zstd").parquet(stage)
        wanted, got = rows.count(), self.spark.read.parquet(stage).count()
        if wanted != got:
            self.fs.delete(self.Path(stage), True)
            raise RuntimeError(f"{out}: wrote {got} rows, expected {wanted}")
        made = sorted(p for p in (s.getPath().toString() for s in self.fs.listStatus(self.Path(stage))) if p.endswith(".parquet"))
        named = [f"{out}/{name}.parquet" if len(made) == 1 else f"{out}/{name}-{i:05}.parquet" for i in range(len(made))]
        self.note(mark, {"moves": list(zip(made, named, strict=True)), "gone": inputs})
        self.finish(mark)
        return wanted

    def note(self, mark: str, plan: dict) -> None:
        """The plan appears whole or not at all."""
        draft = self.Path(f"{self.root}/.draft-{mark}")
        out = self.fs.create(draft, True)
        out.write(json.dumps(plan).encode())
        out.close()
        self.fs.rename(draft, self.Path(f"{self.root}/.compact-{mark}"))

    def finish(self, mark: str) -> None:
        """Does what is left of a noted plan. Every step may have been done before."""
        noted = self.Path(f"{self.root}/.compact-{mark}")
        stream = self.fs.open(noted)
        plan = json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        stream.close()
        for source, target in plan["moves"]:
            if self.fs.exists(self.Path(source)):
                self.replace(source, target)
        kept = {self.fs.makeQualified(self.Path(t)).toString() for _, t in plan["moves"]}
        for p in plan["gone"]:
            if self.fs.makeQualified(self.Path(p)).toString() not in kept:
                self.fs.delete(self.Path(p), False)
        self.fs.delete(noted, False)
        self.fs.delete(self.Path(f"{self.root}/.stage-{mark}"), True)

    def recover(self) -> None:
        """Finishes noted plans, and removes what was staged without a plan."""
        found = [s.getPath().getName() for s in self.fs.listStatus(self.Path(self.root))] if self.fs.exists(self.Path(self.root)) else []
        for name in found:
            if name.startswith(".compact-"):
                self.finish(name.removeprefix(".compact-"))
        for name in found:
            if name.startswith((".stage-", ".draft-")):
                self.fs.delete(self.Path(f"{self.root}/{name}"), True)

    def prune(self, under: str) -> None:
        for name in self.children(under):
            self.prune(f"{under}/{name}")
            if not self.fs.listStatus(self.Path(f"{under}/{name}")):
                self.fs.delete(self.Path(f"{under}/{name}"), False)


def _value(folder: str, key: str) -> str:
    return folder.removeprefix(f"{key}=")


def compact(spark: SparkSession, root: str, today: dt.date) -> list[tuple[str, str, int]]:
    """Past years become one file, past months of this year one file each (several where they are large); the running
    month and later ones stay. One compaction of a tree runs at a time; it first finishes one that was cut short."""
    tree, done = Tree(spark, root), []
    tree.recover()
    for part_folder in tree.children(root):
        part = _value(part_folder, "part")
        for year_folder in tree.children(f"{root}/{part_folder}") if part in PARTS else ():
            year, base = _value(year_folder, "file_year"), f"{root}/{part_folder}/{year_folder}"
            keyed = year_folder.startswith("file_year=")
            if not year.isdigit():
                continue
            rows = 0
            if int(year) < today.year:
                name = f"{part.lower()}_{year}"
                rows = _compacted(tree, tree.files(base), f"{base}/month={WHOLE}/day={WHOLE}" if keyed else base, name)
            elif int(year) == today.year:
                for folder in tree.children(base):
                    month = _value(folder, "month")
                    if month.isdigit() and int(month) < today.month:
                        name = f"{part.lower()}_{year}_{month}"
                        rows += _compacted(tree, tree.files(f"{base}/{folder}"), f"{base}/{folder}/day={WHOLE}" if keyed else f"{base}/{folder}", name)
            if rows:
                tree.prune(base)
                done.append((part, year, rows))
    return done


def _compacted(tree: Tree, files: list[str], out: str, name: str) -> int:
    """Rows merged; none where all files are compacted ones already."""
    own = re.compile(re.escape(f"/{name}") + r"(-\d{5})?\.parquet$")
    return tree.merge(files, out, name) if any(not own.search(f) for f in files) else 0


def write_csv(rows: DataFrame, path: str) -> None:
    """A small table as one CSV with header."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def export(rows: DataFrame, path: str, form: str = "csv") -> None:
    """A player's rows, as CSV or Parquet."""
    writer = rows.coalesce(1).write.mode("overwrite")
    writer.csv(path, header=True) if form == "csv" else writer.parquet(path)


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, nullValue="")
