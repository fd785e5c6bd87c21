"""Reading, writing and checking run archives.

Tables go through Spark's readers and writers; only what concerns an archive as
a whole (members of a zip, one manifest, exit codes) runs on the driver.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lines import SPLIT_BYTES, archive_rows, numbered_lines

REQUIRED_FILES = ("generation_manifest.json", "generation_health.csv", "problems.jsonl", "trajectories.jsonl")
#: Forms of credentials that must not be published.
SECRET_PATTERNS = (r"sk-(?:proj-)?[A-Za-z0-9_-]{20,}", r"hf_[A-Za-z0-9]{20,}", r"gh[pousr]_[A-Za-z0-9]{20,}", r"AKIA[0-9A-Z]{16}", r"AIza[0-9A-Za-z_-]{30,}", r"nvapi-[A-Za-z0-9_-]{20,}", r"-----BEGIN [A-Z ]*PRIVATE KEY-----")


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None, strict: bool = True) -> DataFrame:
    """JSON lines. Strict: a bad line fails the job. Otherwise bad lines are dropped, as in a log that was cut."""
    reader = spark.read if schema is None else spark.read.schema(schema if strict else schema + ", _corrupt_record string")
    if strict:
        return reader.option("mode", "FAILFAST").json(path)
    found = reader.option("mode", "PERMISSIVE").json(path)
    if "_corrupt_record" not in found.columns:
        return found
    return found.filter("_corrupt_record is null").drop("_corrupt_record")


def no_object(value: Column) -> Column:
    """Is a line neither blank nor a JSON object?"""
    parsed = F.try_parse_json(value)
    return (F.trim(value) != "") & (parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT"))


def bad_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file, line number and text of lines that are no JSON object; blank lines are passed over."""
    return numbered_lines(spark, path, split_bytes).filter(no_object(F.col("value")))


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in an append-only log; ties by all columns as JSON."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order], F.to_json(F.struct(*[c for c in df.columns])).desc())
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def safe_members(archive: zipfile.ZipFile, root: str) -> list[str]:
    """Member names, if all lie below ``root`` once extracted; otherwise an error."""
    base = os.path.realpath(root)
    for name in archive.namelist():
        target = os.path.realpath(os.path.join(base, name))
        if target != base and not target.startswith(base + os.sep):
            raise ValueError(f"{name} would be written outside the target folder")
    return archive.namelist()


def scratch_dir(spark: SparkSession | None) -> str | None:
    """The mounted folder that all machines share, of spark.checkpoint.dir; None on a local master without it, where any folder will do."""
    found = spark.conf.get("spark.checkpoint.dir", None) if spark else None
    if found and (found.startswith("file:") or "://" not in found):
        return "/" + found.removeprefix("file:").lstrip("/")
    if spark and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a mounted folder that all executors share: archives are extracted there")
    return None


def open_bundle(path: str, spark: SparkSession | None = None) -> str:
    """The folder of an archive: a folder as it is, a zip extracted safely to a new one that executors can read."""
    if os.path.isdir(path):
        return path
    shared = scratch_dir(spark)
    if shared:
        os.makedirs(shared, exist_ok=True)
    target = tempfile.mkdtemp(prefix="bundle-", dir=shared)
    with zipfile.ZipFile(path) as z:
        safe_members(z, target)
        z.extractall(target)
    return target


def member(folder: str, name: str, required: bool = True) -> str | None:
    """The one file of that name below the folder."""
    found = sorted(os.path.join(d, name) for d, _, names in os.walk(folder) if name in names)
    if len(found) > 1 or (required and not found):
        raise ValueError(f"{name}: {len(found)} files found, one expected")
    return found[0] if found else None


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """name, bytes and sha256 of each file of a folder tree."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_digests(files: DataFrame, expected: dict[str, str]) -> DataFrame:
    """name, problem for each file that a manifest's map and the folder do not agree on."""
    spark = files.sparkSession
    listed = spark.createDataFrame(list(expected.items()) or [("", "")], "name string, expected string").filter("name != ''")
    j = files.join(listed, "name", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("expected").isNull(), "unlisted").when(F.col("sha256") != F.col("expected"), "mismatch")
    return j.withColumn("problem", problem).filter("problem is not null").select("name", "problem")


def build_manifest(spark: SparkSession, folder: str, kind: str, counts: dict[str, int], created_at: str) -> dict:
    """A manifest of what lies in the folder."""
    digests = {r["name"]: r["sha256"] for r in file_digests(spark, folder).collect() if not r["name"].startswith(("_", "."))}
    return {"artifact_type": kind, "created_at": created_at, **counts, "data_files": sorted(digests), "sha256": dict(sorted(digests.items()))}


def export_zip(folder: str, path: str) -> str:
    """Zip the files of a folder, in order of name, next to where the folder lies."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in sorted(os.walk(folder)):
            for n in sorted(names):
                z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), folder))
    return path


def base_name(member: Column) -> Column:
    return F.element_at(F.split(member, "/"), -1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, line, value, sha256, bytes: the lines and digests of a generation archive or of a folder of them, by executors."""
    return archive_rows(spark, path).withColumn("name", base_name(F.col("member"))).drop("member")


def archive_members(rows: DataFrame) -> DataFrame:
    """archive, name, how often it is there, records, first bad line, sha256 and bytes of each member, in one pass over its lines."""
    first_bad = F.min(F.when(no_object(F.col("value")), F.col("line")))
    return rows.groupBy("archive", "name").agg(F.count("sha256").alias("times"), F.count_if(F.trim("value") != "").alias("records"), first_bad.alias("bad_line"), F.max("sha256").alias("sha256"), F.max("bytes").alias("bytes"))


def archive_problems(rows: DataFrame) -> DataFrame:
    """archive, name, problem of every archive: missing, doubled or changed members, lines that are no object, counts that differ from the manifest's."""
    text = rows.filter((F.col("name") == REQUIRED_FILES[0]) & F.col("value").isNotNull()).groupBy("archive")
    manifest = text.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n").alias("json"))
    manifest = manifest.select("archive", F.from_json("json", "sha256 map<string,string>, problem_count long, trajectory_count long").alias("m"))
    found = archive_members(rows)
    needed = rows.select("archive").distinct().withColumn("name", F.explode(F.array(*map(F.lit, REQUIRED_FILES))))
    j = needed.join(found, ["archive", "name"], "left").join(manifest, "archive", "left")
    declared = F.when(F.col("name") == "problems.jsonl", F.col("m.problem_count")).when(F.col("name") == "trajectories.jsonl", F.col("m.trajectory_count"))
    digest = F.try_element_at("m.sha256", F.col("name"))
    problem = (
        F.when(F.col("times").isNull(), "missing")
        .when(F.col("times") > 1, "doubled")
        .when(digest != F.col("sha256"), "mismatch")
        .when((F.col("name") == REQUIRED_FILES[0]) & F.col("m").isNull(), "no object")
        .when(F.col("name").endswith(".jsonl") & F.col("bad_line").isNotNull(), F.concat(F.lit("no object in line "), F.col("bad_line").cast("string")))
        .when(declared != F.col("records"), F.concat(F.col("records").cast("string"), F.lit(" records, "), declared.cast("string"), F.lit(" declared")))
    )
    return j.select("archive", "name", problem.alias("problem"), "records")


def validate_archive(spark: SparkSession, path: str) -> dict:
    """Check required files, digests and counts of a generation archive in one read of its members; returns its counts or raises."""
    found = archive_problems(read_archive(spark, path)).collect()
    wrong = [f"{r['name']}: {r['problem']}" for r in found if r["problem"]]
    if wrong or not found:
        raise ValueError("; ".join(sorted(wrong)) or "no archive")
    return {k: sum(r["records"] for r in found if r["name"] == f"{k}.jsonl") for k in ("problems", "trajectories")}


def archive_records(rows: DataFrame, name: str, schema: str) -> DataFrame:
    """archive, line and the fields of each record of a member; a line that is none fails the job with its place."""
    lines = rows.filter((F.col("name") == name) & (F.trim("value") != ""))
    place = F.concat(F.lit("no object: "), F.col("archive"), F.lit("/"), F.col("name"), F.lit(", line "), F.col("line").cast("string"))
    sound = F.when(no_object(F.col("value")), F.raise_error(place).cast("string")).otherwise(F.col("value"))
    return lines.select("archive", "line", F.from_json(sound, schema).alias("_r")).select("archive", "line", "_r.*")


def records_by_agent(rows: DataFrame, agent: str = "agent_name") -> DataFrame:
    """archive, agent, records of the trajectories; keys that are missing count under NULL."""
    return archive_records(rows, "trajectories.jsonl", f"{agent} string").groupBy("archive", F.col(agent).alias("agent")).agg(F.count(F.lit(1)).alias("records"))


def export_run(folder: str, tables: dict[str, DataFrame], kind: str, created_at: str) -> dict:
    """Write tables as one JSON-lines or (names ending in .csv) CSV file each, and a manifest of counts and digests."""
    os.makedirs(folder, exist_ok=True)
    counts, spark = {}, None
    for name, df in tables.items():
        spark, counts[os.path.splitext(name)[0] + "_count"] = df.sparkSession, df.count()
        parts = os.path.join(folder, "_" + name)
        (write_csv if name.endswith(".csv") else write_jsonl)(df.coalesce(1), parts)
        found = next((f for f in sorted(os.listdir(parts)) if f.startswith("part-")), None)
        os.replace(os.path.join(parts, found), os.path.join(folder, name)) if found else open(os.path.join(folder, name), "w").close()
        shutil.rmtree(parts)
    manifest = build_manifest(spark, folder, kind, counts, created_at)
    with open(os.path.join(folder, "manifest.json"), "w", encoding="utf-8") as f:
        json.dump(manifest, f, indent=1, sort_keys=True)
    return manifest


def load_run(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of an exported run, after its digests were checked."""
    folder = open_bundle(path, spark)
    with open(member(folder, "manifest.json"), encoding="utf-8") as f:
        manifest = json.load(f)
    wrong = [r for r in verify_digests(file_digests(spark, folder), manifest["sha256"]).collect() if r["name"] != "manifest.json"]
    if wrong:
        raise ValueError("; ".join(f"{r['name']}: {r['problem']}" for r in wrong))
    read = lambda n: (read_csv if n.endswith(".csv") else read_jsonl)(spark, member(folder, n), schemas[n])
    return {n: read(n) for n in schemas}


def scan_secrets(files: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """Rows whose text holds something in the form of a credential, with the first such form's number."""
    which = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(SECRET_PATTERNS))):
        which = F.when(F.col(text).rlike(p), i).otherwise(which)
    return files.withColumn("pattern", which).filter("pattern is not null").select(name, "pattern")


def main(args: list[str]) -> int:
    """archives.py PATH: validate a generation archive."""
    spark = SparkSession.builder.appName("validate").getOrCreate()
    try:
        for k, v in validate_archive(spark, args[0]).items():
            print(f"{k}: {v}")
        return 0
    except (ValueError, OSError, IndexError) as x:
        print(f"invalid: {x}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
