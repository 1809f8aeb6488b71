"""Scans of configuration files and state documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fnmatch import fnmatch
from functools import reduce

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrill.session import cut

ENTRY = "struct<command:string,args:array<string>,env:map<string,string>,transport:string,type:string,url:string,headers:map<string,string>>"
REMOTE = "remoteMcpServersConfig array<struct<uuid:string,name:string,url:string,headers:map<string,string>>>"

#: Folders that a walk doesn't enter, names of state documents, and their limits.
PRUNED = ("node_modules", ".git", "dist")
STATE_DEPTH, STATE_FILES, STATE_BYTES, JSON_BYTES = 8, 400, 2 << 20, 5 << 20
#: Steps from a folder down to a skill file.
SKILL_DEPTH = 7


def _opened(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


def list_files(spark: SparkSession, root: str, glob: str = "*", pruned: Sequence[str] = PRUNED, deepest: int | None = None) -> DataFrame:
    """(path, length, below) of the files under a folder, hidden ones included (Spark's own readers pass those over),
    not deeper than ``deepest`` steps below the root; pruned folders are not entered, nor those that can't be read. Empty
    where the folder is missing.

    Folders are listed where rows are processed, a level after the other; contents aren't touched and no list of files
    is on the driver."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    columns = "path string, length bigint, below string, folder boolean"
    if not system.exists(folder):
        return spark.createDataFrame([], columns).drop("folder")
    top = system.makeQualified(folder).toString().rstrip("/")

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, below in zip(*(batch.column(c).to_pylist() for c in (0, 1))):
                try:
                    system_of, name = _opened(path)
                    found = sorted(system_of.get_file_info(FileSelector(name)), key=lambda i: i.base_name)
                except OSError:
                    continue
                found = [i for i in found if (i.type == FileType.File and fnmatch(i.base_name, glob)) or (i.type == FileType.Directory and i.base_name not in pruned)]
                lead = f"{below}/" if below else ""
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{path}/{i.base_name}" for i in found], pa.string()), pa.array([i.size or 0 for i in found], pa.int64()), pa.array([lead + i.base_name for i in found], pa.string()), pa.array([i.type == FileType.Directory for i in found], pa.bool_())],
                    names=["path", "length", "below", "folder"],
                )

    level, files, steps = spark.createDataFrame([(top, "")], "path string, below string"), [], 0
    while not steps or (not level.isEmpty() and (deepest is None or steps <= deepest)):
        listed = cut(level.repartition(spark.sparkContext.defaultParallelism).mapInArrow(children, columns) if steps else level.mapInArrow(children, columns))
        files.append(listed.where("not folder").drop("folder"))
        level, steps = listed.where("folder").select("path", "below"), steps + 1
    return reduce(DataFrame.unionByName, files)


def read_files(spark: SparkSession, root: str, glob: str = "*", pruned: Sequence[str] = PRUNED, deepest: int | None = None) -> DataFrame:
    """As ``list_files`` with each file's ``content``, read where the rows are processed."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column(0).to_pylist()):
                system, name = _opened(path)
                with system.open_input_stream(name) as stream:
                    yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns), pa.array([stream.read()], pa.binary())], names=["path", "length", "below", "content"])

    return list_files(spark, root, glob, pruned, deepest).mapInArrow(read, "path string, length bigint, below string, content binary")


def skill_files(spark: SparkSession, root: str) -> DataFrame:
    """As ``list_files`` the files ``/skills/<name>/SKILL.md`` under a folder, in folders of at most 6 separators below
    it; no folder is pruned by its name."""
    return list_files(spark, root, "SKILL.md", (), SKILL_DEPTH).where(F.try_element_at(F.split("path", "/"), F.lit(-3)) == "skills")


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^\ufeff", "")


def config_servers(df: DataFrame, path: str, text: str) -> DataFrame:
    """(path, name, entry) of each named server of a client configuration; what can't be read has no rows."""
    doc = F.from_json(without_bom(F.col(text)), f"mcpServers map<string,{ENTRY}>")
    return df.select(F.col(path).alias("path"), F.explode(doc["mcpServers"]).alias("name", "entry")).where("name <> '' and entry is not null")


def project_servers(df: DataFrame, path: str, text: str, folder: str) -> DataFrame:
    """(path, project, name, entry) of the projects of a user configuration that belong to a folder: the project named
    exactly so wins; else those that contain it or lie in it."""
    doc = F.from_json(F.col(text), f"projects map<string,struct<mcpServers:map<string,{ENTRY}>>>")
    projects = df.select(F.col(path).alias("path"), F.explode(doc["projects"]).alias("project", "body"))
    here = folder.rstrip("/")
    near = projects.where((F.col("project") == here) | F.lit(here + "/").startswith(F.concat("project", F.lit("/"))) | F.col("project").startswith(here + "/"))
    exact = near.groupBy("path").agg(F.max((F.col("project") == here).cast("int")).alias("_exact"))
    picked = near.join(exact, "path").where((F.col("_exact") == 0) | (F.col("project") == here))
    return picked.select("path", "project", F.explode("body.mcpServers").alias("name", "entry")).where("name <> ''")


def remote_servers(df: DataFrame, path: str, text: str) -> DataFrame:
    """(path, uuid, name, url, headers) of the remote servers of a session document; those without address are dropped."""
    doc = F.from_json(F.col(text), REMOTE)
    each = df.select(F.col(path).alias("path"), F.explode(doc["remoteMcpServersConfig"]).alias("r")).select("path", "r.*")
    return each.where(F.trim(F.coalesce("url", F.lit(""))) != "")


def json_status(length: Column, content: Column, most: int = JSON_BYTES) -> Column:
    """missing, too_large, invalid_json or ok for a document that was asked for."""
    return F.when(length.isNull(), "missing").when(length > most, "too_large").when(F.try_parse_json(content.cast("string")).isNull(), "invalid_json").otherwise("ok")


def looks_like_state(name: Column) -> Column:
    """Whether a file name is that of a state document."""
    lower = F.lower(name)
    return lower.isin("cowork_settings.json", "settings.json", "config.json") | lower.startswith("local_") | lower.contains("session") | lower.contains("task") | lower.contains("plugin")


def state_documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of the state documents under a folder: at most 400, the first by path, none over 2 MiB or deeper
    than 8 steps; the caps are the feature's."""
    files = read_files(spark, root, deepest=STATE_DEPTH).where(looks_like_state(F.element_at(F.split("below", "/"), -1)) & (F.col("length") <= STATE_BYTES))
    return files.orderBy("path").limit(STATE_FILES).select("path", F.col("content").cast("string").alias("text"))


def manifest_or_fallback(manifest: DataFrame, readable: str, fallback: DataFrame) -> DataFrame:
    """A manifest's rows where it can be read, else those of the fallback with the same columns (key ``path``)."""
    good = manifest.where(readable)
    return good.unionByName(fallback.join(good.select("path").distinct(), "path", "left_anti").select(*good.columns))


def setting(file_value: Column, env_value: Column, default: Column) -> Column:
    """(value, origin) of a setting: the file wins, the environment fills blanks, then the default."""
    filled = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.struct(F.coalesce(filled(file_value), filled(env_value), default).alias("value"), F.when(filled(file_value).isNotNull(), "file").when(filled(env_value).isNotNull(), "env").otherwise("default").alias("origin"))


def first_path(*candidates: Column) -> Column:
    """The first of the candidate paths that isn't blank."""
    return F.coalesce(*(F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")) for c in candidates), F.lit(""))


def name_matches(names: Column, terms: Sequence[str]) -> Column:
    """How many of the names hold one of the terms, without case."""
    return F.size(F.filter(names, lambda n: F.exists(F.array(*map(F.lit, terms)), lambda t: F.lower(n).contains(F.lower(t)))))
