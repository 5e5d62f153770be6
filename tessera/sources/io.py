"""Sources and sinks (S1-S14): JSON-lines, TSV qrels, registry lookups,
sub-corpus discovery, guarded / in-place writes, result documents and
partitioned result stores.  Paths are on the shared file system (the
checkpoint folder's file system in tests)."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXAMPLE_SCHEMA = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("positive", T.ArrayType(T.StringType())),
    T.StructField("negative", T.ArrayType(T.StringType())),
])
QRELS_SCHEMA = "`query-id` string, `corpus-id` string, score int"


def scan_jsonl(spark: SparkSession, path: str, schema, mode: str = "FAILFAST") -> DataFrame:
    return spark.read.schema(schema).option("mode", mode).json(path)


def scan_jsonl_lenient(spark: SparkSession, path: str, schema: T.StructType, keep=("_id", "text")) -> DataFrame:
    """``(records, bad_lines)`` in one permissive pass.  A record whose other
    columns do not parse keeps ``keep`` and has them null; a line that is no
    record at all goes to ``bad_lines`` (one column ``line``), none is lost.
    A missing path or a failed read is an error as ever."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    core = T.StructType([f for f in schema.fields if f.name in keep])
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    narrow = T.StructType([*core.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    x = lines.select("value", F.from_json("value", full, options).alias("f"), F.from_json("value", narrow, options).alias("n"))
    broken = F.col("n").isNull() | F.col("n._corrupt").isNotNull()
    pick = [(F.col(f"n.{f.name}") if f.name in keep else F.when(F.col("f._corrupt").isNull(), F.col(f"f.{f.name}"))).alias(f.name)
            for f in schema.fields]
    return x.where(~broken).select(*pick), x.where(broken).select(F.col("value").alias("line"))


def scan_qrels_tsv(spark: SparkSession, qrels_dir: str, glob: str = "*.tsv") -> DataFrame:
    """All tab-separated files with a header in a directory, unioned."""
    return (spark.read.option("sep", "\t").option("header", True).option("pathGlobFilter", glob)
            .schema(QRELS_SCHEMA).csv(qrels_dir))


def scan_named_dataset(spark: SparkSession, registry: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """Look a dataset name up in the registry (one row) and read its path."""
    rows = registry.where(F.col("name") == name).select("data_path").limit(2).collect()
    if len(rows) != 1:
        raise KeyError(name)
    return spark.read.format(fmt).load(rows[0]["data_path"])


def scan_with_fallback_path(spark: SparkSession, table: str, path: str, schema) -> DataFrame:
    """The catalog table if it exists, else the JSON-lines file."""
    if spark.catalog.tableExists(table):
        return spark.table(table)
    return scan_jsonl(spark, path, schema)


def scan_split_slice(df: DataFrame, n: int, order: str) -> DataFrame:
    """First ``n`` rows of a split in row order (``train[:n]``)."""
    return df.orderBy(order).limit(n)


def scan_subcorpora(spark: SparkSession, root: str, exclude=("qrels",), column: str = "subcorpus",
                    schema=None) -> DataFrame:
    """Sub-directories ``column=<name>`` of ``root`` (partition discovery),
    all but ``exclude``, unioned with the sub-corpus name as a column."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    df = r.json(root)
    return df.where(~F.col(column).isin(list(exclude)))


def sink_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


MARKER = "_PUBLISHED"  # readers skip names with an underscore


def _fs(spark: SparkSession, path: str):
    """The path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def published(spark: SparkSession, path: str) -> dict | None:
    """What the marker of a published output says: schema, rows, the version
    of its input; None for a folder that is absent or not complete."""
    p, fs = _fs(spark, f"{path.rstrip('/')}/{MARKER}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)  # one short line, below a name that Spark's readers skip
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(df: DataFrame, path: str, version: str = "", fmt: str = "json") -> dict:
    """Writes ``df`` beside ``path``, sets the marker and moves both there by
    one rename.  A folder there that was never published gives way; a
    published one is an error."""
    spark, path = df.sparkSession, path.rstrip("/")
    if published(spark, path):
        raise FileExistsError(path)
    target, fs = _fs(spark, path)
    staging, _ = _fs(spark, f"{path}.__staging-{uuid.uuid4().hex[:12]}")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format(fmt).save(str(staging))
    said = {"schema": df.schema.jsonValue(), "rows": seen.get["rows"], "version": version}
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(staging, MARKER))
    try:
        out.write(json.dumps(said).encode())
    finally:
        out.close()
    if fs.exists(target):  # half-written: it has no marker
        fs.delete(target, True)
    if not fs.rename(staging, target):
        raise OSError(f"cannot move {staging} to {target}")
    if not published(spark, path):  # another writer was first, and the rename went below its folder
        raise OSError(f"{path} was written by another run")
    return said


def sink_if_absent(df: DataFrame, path: str, version: str = "", fmt: str = "json") -> bool:
    """Write unless the output is published; True when written.  A published
    output of another input version is an error, not skipped."""
    have = published(df.sparkSession, path)
    if have is None:
        publish(df, path, version, fmt)
        return True
    if have["version"] != version:
        raise ValueError(f"{path} was made from version {have['version']!r}, not {version!r}")
    return False


def run_stages(spark: SparkSession, root: str, stages, version: str = "", fmt: str = "parquet") -> dict[str, bool]:
    """Resumable stages: ``stages`` are (name, function of the outputs so far by
    name); each is published below ``root`` and read again by the later ones.
    A published stage is skipped, its function not even called.  The version
    of a stage takes in its name and the version of the one before, so a new
    input version goes to new folders.  Returns which stages were run."""
    done, ran = {}, {}
    for name, make in stages:
        version = hashlib.sha256(f"{version}/{name}".encode()).hexdigest()[:16]
        path = f"{root.rstrip('/')}/{name}-{version}"
        ran[name] = published(spark, path) is None
        if ran[name]:
            publish(make(done), path, version, fmt)
        schema = T.StructType.fromJson(published(spark, path)["schema"])
        done[name] = spark.read.schema(schema).format(fmt).load(path)
    return ran


def sink_replace_in_place(spark: SparkSession, path: str, transform, schema) -> DataFrame:
    """Read ``path``, apply ``transform``, write to a staging path, then swap
    it in (Spark cannot overwrite the files it is reading)."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    src = jvm.org.apache.hadoop.fs.Path(path)
    staging = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".__staging")
    fs = src.getFileSystem(conf)
    transform(scan_jsonl(spark, path, schema)).write.mode("overwrite").json(str(staging))
    backup = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".__old")
    _swap(fs, src, staging, backup)
    return scan_jsonl(spark, path, schema)


def _swap(fs, src, staging, backup) -> None:
    """Puts ``staging`` in the place of ``src``; if a step fails, the data that
    were there are put back and an error is raised."""
    if not fs.rename(src, backup):
        raise OSError(f"cannot set {src} aside")
    if not fs.rename(staging, src):
        if not fs.rename(backup, src):
            raise OSError(f"{src} could not be replaced and is kept as {backup}")
        raise OSError(f"cannot move {staging} to {src}; {src} is as it was")
    fs.delete(backup, True)


def sink_table(df: DataFrame, path: str, partition_by=()) -> DataFrame:
    """Publish under a path as partitioned Parquet; returns the published table."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


RESULTS_TYPE = "map<string,map<string,double>>"


def results_to_json(cells: DataFrame) -> DataFrame:
    """Long ``(lang, dataset, score)`` -> one JSON document
    ``{lang: {dataset: score}}`` (a result document is one record)."""
    inner = cells.groupBy("lang").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("dataset", "score")))).alias("m"))
    doc = inner.agg(F.map_from_entries(F.collect_list(F.struct("lang", "m"))).alias("doc"))
    return doc.select(F.to_json("doc").alias("value"))


def results_from_json(docs: DataFrame, col: str = "value") -> DataFrame:
    m = docs.select(F.from_json(col, RESULTS_TYPE).alias("doc"))
    a = m.select(F.explode("doc").alias("lang", "inner"))
    return a.select("lang", F.explode("inner").alias("dataset", "score"))


def sink_catalog_table(df: DataFrame, table: str, path: str, partition_by=(), bucket_by=(), buckets: int = 8) -> DataFrame:
    """Saves a named table of the session's catalog, its files below ``path``,
    partitioned and bucketed; a table of that name is an error."""
    w = df.write.format("parquet").option("path", path)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket_by:
        w = w.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    w.saveAsTable(table)
    return df.sparkSession.table(table)


def overwrite_partitions(df: DataFrame, table: str) -> DataFrame:
    """Replaces those partitions of a named table that ``df`` has rows of;
    columns go by name."""
    spark = df.sparkSession
    ordered = df.select(*spark.table(table).columns)
    mode = "spark.sql.sources.partitionOverwriteMode"  # a writer's option does not reach insertInto
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        ordered.write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(mode, before)
    return spark.table(table)


# one result document: scores per split, each for some languages
TASK_RESULT = "task_name string, scores map<string,array<struct<main_score:double,languages:array<string>>>>"
SAFE_NAME = r"^[A-Za-z0-9_-][A-Za-z0-9._-]*$"  # a path element that needs no escape and is not hidden


def results_store_publish(cells: DataFrame, root: str, model: str, revision: str) -> list[str]:
    """``(lang, dataset, split, score)`` -> one JSON document per task at
    ``root/lang/model/revision/dataset.json``.  Spark writes the documents to
    a staging folder; the driver moves each by one rename (as many as there are
    tasks, no data).  A task that has a result keeps it.  Returns the paths
    that are new; names that are no plain path element are an error."""
    spark, root = cells.sparkSession, root.rstrip("/")
    names = F.array(F.col("lang"), F.col("dataset"), F.lit(model), F.lit(revision))
    bad = cells.where(~F.coalesce(F.forall(names, lambda n: n.rlike(SAFE_NAME)), F.lit(False))).select("lang", "dataset").first()
    if bad:
        raise ValueError(f"no file name for {bad['lang']!r}, {bad['dataset']!r}, {model!r}, {revision!r}")
    entry = F.struct(F.col("score").alias("main_score"), F.array("lang").alias("languages"))
    per_split = cells.groupBy("lang", "dataset", "split").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    docs = per_split.groupBy("lang", "dataset").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", "entries")))).alias("scores"))
    staging, fs = _fs(spark, f"{root}/.staging-{uuid.uuid4().hex[:12]}")
    (docs.select(F.col("dataset").alias("task_name"), "scores", F.col("lang").alias("l"), F.col("dataset").alias("t"))
     .write.partitionBy("l", "t").json(str(staging)))
    jvm_path, made = spark._jvm.org.apache.hadoop.fs.Path, []
    files = fs.listFiles(staging, True)
    while files.hasNext():
        at = files.next().getPath()
        if not at.getName().startswith("part-"):
            continue
        task, lang = (p.getName().split("=", 1)[1] for p in (at.getParent(), at.getParent().getParent()))
        folder = jvm_path(f"{root}/{lang}/{model}/{revision}")
        target = jvm_path(folder, f"{task}.json")
        fs.mkdirs(folder)
        if not fs.exists(target) and fs.rename(at, target):
            made.append(target.toString())
    fs.delete(staging, True)
    return sorted(made)


def results_store_scan(spark: SparkSession, root: str, model: str, revision: str) -> DataFrame:
    """``(lang, dataset, score)`` of one model and revision, and of no other
    file: a glob picks the paths, language and task come from each path, and
    the score is the mean over a document's entries for that language."""
    glob, fs = _fs(spark, f"{root.rstrip('/')}/*/{model}/{revision}/*.json")
    found = fs.globStatus(glob)
    if not found:  # nothing stored yet
        return spark.createDataFrame([], "lang string, dataset string, score double")
    docs = spark.read.schema(TASK_RESULT).json(str(glob)).select(
        F.split("_metadata.file_path", "/").alias("path"), F.flatten(F.map_values("scores")).alias("entries"))
    lang = F.element_at("path", -4)
    scores = docs.select(lang.alias("lang"), F.regexp_replace(F.element_at("path", -1), r"\.json$", "").alias("dataset"),
                         F.filter("entries", lambda e: F.array_contains(e["languages"], lang)).alias("own"))
    total = F.aggregate("own", F.lit(0.0), lambda acc, e: acc + e["main_score"])
    return scores.select("lang", "dataset", F.when(F.size("own") > 0, total / F.size("own")).alias("score"))


def results_store_lookup(spark: SparkSession, root: str, wanted: DataFrame, model: str, revision: str) -> DataFrame:
    """The requested ``(lang, dataset)`` cells with the stored score of the
    model and revision, null where there is none."""
    return wanted.join(results_store_scan(spark, root, model, revision), ["lang", "dataset"], "left")


def report_by_language(sheet: DataFrame, path: str) -> DataFrame:
    """One ordered CSV sheet per language (``lang=`` partitions)."""
    sheet.orderBy("lang", "pos").write.mode("overwrite").partitionBy("lang").option("header", True).csv(path)
    return (sheet.sparkSession.read.option("header", True)
            .schema("pos int, dataset string, score double, lang string").csv(path))
