"""Sources and sinks: repository files, snapshots, JSON lines, tables by repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import LANGUAGES, has_source_extension, in_excluded_dir, language_of, relative_path

TELEMETRY = "type string, timestamp string, issue_id string, latency_ms double, top_k int, confidence string, repo_name string, success boolean, files_indexed int, functions_count int, duration_seconds double, error_type string, error_msg string, context map<string,string>"


def read_repository(spark: SparkSession, root: str, repo: str, commit_sha: str | None = None) -> DataFrame:
    """(repo, path, language, commit_sha, content) of a checked-out repository's source files."""
    pattern = "*.{" + ",".join(x[1:] for x in LANGUAGES) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    path = relative_path(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.lit(root.rstrip("/")))
    found = files.select(F.lit(repo).alias("repo"), path.alias("path"), F.lit(commit_sha).cast("string").alias("commit_sha"), F.decode("content", "UTF-8").alias("content"))
    return found.filter(has_source_extension(F.col("path")) & ~in_excluded_dir(F.col("path"))).withColumn("language", language_of(F.col("path")))


def read_tree_listing(spark: SparkSession, path: str, site: str, repo: str, branch: str) -> DataFrame:
    """Files of a JSON tree listing (an object with an array ``tree``), with their address."""
    tree = spark.read.schema("tree array<struct<path:string,type:string,size:bigint>>").option("multiLine", True).json(path)
    return tree.select(F.explode("tree").alias("t")).filter("t.type = 'blob'").select("t.path", "t.size", F.concat(F.lit(f"{site}/{repo}/blob/{branch}/"), F.col("t.path")).alias("url"))


def write_by_repo(df: DataFrame, path: str, emptied: list[str] | None = None) -> None:
    """Replaces the partitions of the repositories in ``df`` only, and deletes those of the
    ``emptied`` repositories, which have no rows any more."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(path)
    delete_repos(df.sparkSession, path, emptied or [])


def delete_repos(spark: SparkSession, path: str, repos: list[str]) -> None:
    for repo in repos:
        name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("repo", repo)
        where = spark._jvm.org.apache.hadoop.fs.Path(path, name)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there: a folder with at least one file or partition."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(where) and any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(where))


def write_state(df: DataFrame, path: str) -> None:
    """A small table, such as the registry or update metrics, as JSON."""
    df.write.mode("overwrite").json(path)


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_index(spark: SparkSession, path: str, legacy: str | None = None) -> DataFrame:
    """The index table; rows of repositories that only the older location has are added."""
    new = spark.read.parquet(path)
    if legacy is None:
        return new
    old = spark.read.parquet(legacy)
    return new.unionByName(old.join(new.select("repo").distinct(), "repo", "left_anti"), allowMissingColumns=True)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TELEMETRY).json(path)


def read_splits(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union of dataset splits by column name; later ones may lack columns."""
    first, *rest = [spark.read.parquet(p) for p in paths]
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def write_report(sheets: dict[str, DataFrame], path: str) -> None:
    for name, df in sheets.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
