"""Stored tables (S6-S9; K1-K4, K8, K12).

State, enhanced rows, the parsed index, the category index, headers and
messages are keyed tables of parquet folders: a whole table, and after it the
rows of each later upsert or deletion (``KeyedTable``). A writer always
creates a new folder (single writer per table) and readers take only finished
ones, so a crashed write never leaves a half table, never blocks the next
write and never needs a lock.

The JSON side files of the reference (categories, discovery report) are
read with an explicit schema; the category table is a configuration table
without a bound on its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.setops import upsert
from parlance.plans.materialize import materialize

CATEGORY_FILE_SCHEMA = "slug string, name string, description string, keywords array<string>"
DISCOVERY_SCHEMA = ("discovered_at string, model string, free_mode boolean, conversations_sampled bigint, "
                    "existing_categories array<string>, discovered_categories array<struct<slug: string, name: string, "
                    "description: string, sample_titles: array<string>, count: bigint>>")
INDEX_SCHEMA = ("parsed_at string, total_conversations bigint, min_messages bigint, conversations array<struct<"
                "id: string, title: string, created: string, updated: string, messages: bigint, user_messages: bigint>>")


class CategoryFileError(RuntimeError):
    pass


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


class KeyedTable:
    """A keyed table as a whole folder ``<full>=<n>`` and one folder
    ``<delta>=<n>`` per later upsert or deletion, shared by batch and
    streaming runs.

    A delta holds new rows; which older rows it takes the place of is listed
    beside it, as (key, folder number) pairs, before it is finished. So an
    upsert writes its own size, and reads nothing of the table but the key
    column; its keys are joined as the small side, so the table is not
    shuffled. A reader drops the listed pairs by an anti-join whose right
    side holds the replaced rows alone, broadcast while that is small: rows
    that nobody replaced are never shuffled. ``compact`` writes a whole
    folder again. Replaying an upsert gives the same table. Rows with a null
    key are never replaced.

    Numbers go past every folder that exists, finished or not: what a
    crashed write left is never read and never in the way."""

    def __init__(self, spark: SparkSession, path: str, key: str = "conv_id", full: str = "full", delta: str = "batch"):
        self.spark, self.path, self.key, self.full, self.delta = spark, path.rstrip("/"), key, full, delta
        self.replaced = self.path + ".replaced"

    def _numbers(self, folder: str, prefix: str, finished: bool) -> list[int]:
        fs, p = _fs(self.spark, folder)
        if not fs.exists(p):
            return []
        found = [st.getPath() for st in fs.listStatus(p) if st.getPath().getName().startswith(prefix + "=")]
        return sorted(int(f.getName()[len(prefix) + 1:]) for f in found if not finished or fs.exists(f.suffix("/_SUCCESS")))

    def _next(self) -> int:
        taken = [n for prefix in (self.full, self.delta) for folder in (self.path, self.replaced) for n in self._numbers(folder, prefix, False)]
        return max(taken, default=0) + 1

    def _live(self) -> tuple[int, list[int]]:
        """The newest whole folder (0: none) and the deltas after it."""
        base = max(self._numbers(self.path, self.full, True), default=0)
        return base, [n for n in self._numbers(self.path, self.delta, True) if n > base]

    def _rows(self) -> DataFrame | None:
        """All rows, replaced ones too, with their folder's number ``_n``."""
        base, deltas = self._live()
        parts = []
        if base:
            parts.append(self.spark.read.parquet(f"{self.path}/{self.full}={base}").withColumn("_n", F.lit(base)))
        if deltas:
            rows = self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/{self.delta}={n}" for n in deltas])
            parts.append(rows.withColumnRenamed(self.delta, "_n"))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def read(self) -> DataFrame | None:
        rows = self._rows()
        if rows is None:
            return None
        listed = set(self._numbers(self.replaced, self.delta, True))
        lists = [f"{self.replaced}/{self.delta}={n}" for n in self._live()[1] if n in listed]
        if lists:
            gone = self.spark.read.option("recursiveFileLookup", True).parquet(*lists)
            rows = rows.join(gone, gone.columns, "left_anti")
        return rows.drop("_n")

    def write(self, df: DataFrame) -> DataFrame:
        """The whole table anew."""
        path = f"{self.path}/{self.full}={self._next()}"
        df.write.mode("error").parquet(path)
        return self.spark.read.parquet(path)

    def _replace(self, keys: DataFrame, rows: DataFrame) -> None:
        n, before = self._next(), self._rows()
        if before is not None:
            gone = before.select(self.key, "_n").join(keys.select(self.key).distinct(), self.key, "left_semi").distinct()
            gone.write.mode("error").parquet(f"{self.replaced}/{self.delta}={n}")
        rows.write.mode("error").parquet(f"{self.path}/{self.delta}={n}")

    def upsert(self, new: DataFrame) -> None:
        """``new`` rows win per key; evaluated once."""
        new, base = materialize(new, "upsert-new"), self._rows()
        if base is None:
            self._replace(new, new)
            return
        types = {f.name: f.dataType for f in base.schema.fields if f.name != "_n"}
        if set(new.columns) - types.keys():  # new columns: the table is written whole
            self.write(upsert(self.read(), new, self.key))
            return
        self._replace(new, new.select(*[(F.col(c) if c in new.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()]))

    def delete(self, keys: DataFrame) -> None:
        base = self.read()
        if base is not None:
            self._replace(keys, base.limit(0))

    def compact(self, keep_seconds: float = 0) -> None:
        """The table as one whole folder; older folders go once they are
        ``keep_seconds`` old, an age that readers who planned on them must
        not exceed."""
        base, deltas = self._live()
        if deltas:
            self.write(self.read())
        self.vacuum(keep_seconds)

    def vacuum(self, keep_seconds: float) -> None:
        """Remove folders before the newest whole one, from the age of ``keep_seconds`` on."""
        base, _ = self._live()
        Path, now = self.spark._jvm.org.apache.hadoop.fs.Path, self.spark._jvm.java.lang.System.currentTimeMillis()
        for folder in (self.path, self.replaced):
            for prefix in (self.full, self.delta):
                for n in self._numbers(folder, prefix, False):
                    fs, p = _fs(self.spark, f"{folder}/{prefix}={n}")
                    if n < base and now - fs.getFileStatus(p).getModificationTime() >= 1000 * keep_seconds:
                        fs.delete(Path(p.toString()), True)


class TableStore:
    """Keyed tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, key: str = "conv_id") -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/{name}", key, full="v", delta="delta")

    def read(self, name: str, schema: str | None = None) -> DataFrame | None:
        """The table as it is; ``schema`` gives an empty frame when it does
        not exist (missing -> empty, as the reference)."""
        df = self._table(name).read()
        return self.spark.createDataFrame([], schema) if df is None and schema else df

    def write(self, name: str, df: DataFrame) -> DataFrame:
        return self._table(name).write(df)

    def upsert(self, name: str, new: DataFrame, key: str = "conv_id") -> DataFrame:
        """U1 into the table."""
        self._table(name, key).upsert(new)
        return self.read(name)

    def keyed(self, name: str, key: str = "conv_id") -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/{name}", key)

    def compact(self, name: str, keep_seconds: float = 0) -> None:
        self._table(name).compact(keep_seconds)

    def delete_keys(self, name: str, keys: DataFrame, key: str = "conv_id") -> DataFrame:
        """K4: the rows of the given keys go."""
        self._table(name, key).delete(keys)
        left = self.read(name)
        return keys.limit(0) if left is None else left

    def reset(self, name: str, schema: str) -> DataFrame:
        """K4 ``--reset``: a new empty version."""
        return self.write(name, self.spark.createDataFrame([], schema))


# ---------------------------------------------------------------- S6 categories
def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of categories. Missing file -> empty; invalid JSON ->
    error; an entry without slug or name -> error naming the entry;
    description defaults to '' and keywords to []; ``cat_ord`` keeps file
    order."""
    schema = "cat_ord int, " + CATEGORY_FILE_SCHEMA
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = (spark.read.schema(CATEGORY_FILE_SCHEMA + ", _corrupt string").option("multiLine", True)
           .option("columnNameOfCorruptRecord", "_corrupt").json(path))
    # One JSON file is one partition, so the generated id is the position.
    rows = raw.select(F.monotonically_increasing_id().cast("int").alias("cat_ord"), "*")
    bad = rows.agg(F.max(F.col("_corrupt").isNotNull()).alias("corrupt"),
                   F.min(F.when(F.col("slug").isNull() | F.col("name").isNull(), F.col("cat_ord"))).alias("entry")).first()
    if bad["corrupt"]:
        raise CategoryFileError(f"cannot parse {path} as a JSON array of categories")
    if bad["entry"] is not None:
        raise CategoryFileError(f"{path}: category #{bad['entry']} needs a slug and a name")
    return rows.select("cat_ord", "slug", "name", F.coalesce("description", F.lit("")).alias("description"),
                       F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))


def categories_json(cats: DataFrame) -> DataFrame:
    """K12 rendering: one text row holding the JSON array, in category order
    (a configuration file, read whole by its users)."""
    item = F.to_json(F.struct("slug", "name", "description", "keywords"))
    return cats.agg(F.concat(F.lit("[\n"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("cat_ord", item.alias("j")))), lambda x: x["j"]), ",\n"), F.lit("\n]")).alias("value"))


def save_categories(spark: SparkSession, cats: DataFrame, path: str) -> None:
    """Write the category table as a JSON array file at ``path``."""
    write_single_text(spark, categories_json(cats), path)


def upsert_categories(cats: DataFrame, new: DataFrame) -> DataFrame:
    """K12 merge: by slug, new entries win; existing order kept, new slugs
    appended in their order."""
    n = new.select("slug", "name", "description", "keywords", F.col("cat_ord").alias("_new_ord"))
    kept = cats.join(n.select("slug"), "slug", "left_anti").select("slug", "name", "description", "keywords", F.col("cat_ord").cast("bigint").alias("_o"))
    replaced = cats.select("slug", F.col("cat_ord").cast("bigint").alias("_old")).join(n, "slug", "right")
    # The order is a struct (origin, position): existing rows first, then new ones.
    at = lambda origin, c: F.struct(F.lit(origin).alias("origin"), c.cast("bigint").alias("at"))
    repl = replaced.select("slug", "name", "description", "keywords",
                           F.when(F.col("_old").isNotNull(), at(0, F.col("_old"))).otherwise(at(1, F.col("_new_ord"))).alias("_o"))
    u = kept.withColumn("_o", at(0, F.col("_o"))).unionByName(repl)
    from parlance.plans.ranks import with_global_rank
    return with_global_rank(u, [F.col("_o"), F.col("slug")], "_at").select(
        (F.col("_at") - 1).cast("int").alias("cat_ord"), "slug", "name", "description", "keywords")


def write_text_file(rows: DataFrame, path: str, order: list[Column]) -> None:
    """Write the text column ``block`` as exactly the file ``path``, a line
    per row. Rows are sorted and written by many tasks; their part files, in
    name order, are then copied as streams into the one file, which appears
    under its name when it is complete."""
    spark, parts, whole = rows.sparkSession, path + "._parts", path + "._whole"
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("block").write.mode("overwrite").text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    fs, p = _fs(spark, parts)
    out = fs.create(Path(whole), True)
    try:
        for part in sorted(st.getPath().toString() for st in fs.listStatus(p) if st.getPath().getName().startswith("part-")):
            source = fs.open(Path(part))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
            finally:
                source.close()
    finally:
        out.close()
    if fs.exists(Path(path)):
        fs.delete(Path(path), True)
    fs.rename(Path(whole), Path(path))
    fs.delete(p, True)


def write_single_text(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Write one text row (``value``) as exactly the file ``path``."""
    write_text_file(rows.select(F.col("value").alias("block")), path, [F.col("block")])


# ---------------------------------------------------------------- S8 / K1 parsed index
INDEX_ROW = "id string, title string, created string, updated string, messages bigint, user_messages bigint"


def write_index(index_rows: DataFrame, min_messages: int, parsed_at: str, path: str) -> None:
    """K1: ``path/header`` with the run's figures and ``path/conversations``,
    one JSON line per conversation; the part files in name order hold them
    newest first. No row is gathered with the others."""
    order = [F.col("created").desc(), F.col("id")]
    (index_rows.select("id", "title", "created", "updated", "messages", "user_messages").repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("overwrite").json(path + "/conversations"))
    index_rows.agg(F.lit(parsed_at).alias("parsed_at"), F.count(F.lit(1)).alias("total_conversations"), F.lit(min_messages).alias("min_messages")) \
        .write.mode("overwrite").json(path + "/header")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Parsed-index rows keyed by id, from ``write_index`` or from the
    single JSON document of another tool; missing or corrupt -> empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], INDEX_ROW)
    if path_exists(spark, path + "/conversations"):
        return spark.read.schema(INDEX_ROW).json(path + "/conversations").where("id IS NOT NULL")
    doc = spark.read.schema(INDEX_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return doc.select(F.inline(F.coalesce("conversations", F.array().cast(
        "array<struct<id: string, title: string, created: string, updated: string, messages: bigint, user_messages: bigint>>"))))


# ---------------------------------------------------------------- S9 / K12 discovery report
def discovery_json(merged: DataFrame, model: str, free_mode: bool, sampled: int, existing: list[str], at: str) -> DataFrame:
    """Report document (suggestions count-desc)."""
    return merged.agg(F.to_json(F.struct(
        F.lit(at).alias("discovered_at"), F.lit(model).alias("model"), F.lit(free_mode).alias("free_mode"),
        F.lit(sampled).alias("conversations_sampled"),
        F.array(*[F.lit(s) for s in existing]).cast("array<string>").alias("existing_categories"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("_k"), "slug", F.struct(
            "slug", "name", "description", "sample_titles", "count").alias("c")))), lambda x: x["c"]).alias("discovered_categories"))).alias("value"))


def read_discovery(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a non-empty slug, count default 1; missing or corrupt
    -> empty."""
    empty = "slug string, name string, description string, sample_titles array<string>, count bigint"
    if not path_exists(spark, path):
        return spark.createDataFrame([], empty)
    doc = spark.read.schema(DISCOVERY_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = doc.select(F.inline(F.coalesce("discovered_categories", F.array().cast(
        "array<struct<slug: string, name: string, description: string, sample_titles: array<string>, count: bigint>>"))))
    return rows.where(F.coalesce("slug", F.lit("")) != "").withColumn("count", F.coalesce("count", F.lit(1).cast("bigint")))


def save_json_document(spark: SparkSession, doc: DataFrame, path: str) -> None:
    write_single_text(spark, doc, path)


# ---------------------------------------------------------------- K8 category index
def merge_category_index(existing: DataFrame, new: DataFrame) -> DataFrame:
    """K8: this run's stats win per slug, slugs absent from this run kept."""
    return upsert(existing.select("slug", "name", "count", "avg_relevance"),
                  new.select("slug", "name", "count", "avg_relevance"), "slug")
