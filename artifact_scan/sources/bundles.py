"""Bundles of files as DataFrames: (bundle_id, path, text), from texts, archives, folders or tables.

Every source returns (files, errors): a bundle over a limit, or that cannot be read, has a
row (bundle_id, error) among the errors and none among the files.

``bundles`` tables, optional everywhere, hold a row a bundle: bundle_id, and any of
declared_filename, primary_path and git_metadata (map<string,string>).
"""

from __future__ import annotations

import io
import stat
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from artifact_scan.config import DEFAULT, IGNORED_DIRS, Config
from artifact_scan.functions.text import lossy, parts, safe_basename

# What a pasted text is called without a name.
NAME_BY_HINT = {"skill": "SKILL.md", "agents": "AGENTS.md", "claude_md": "CLAUDE.md"}


def text_name(declared: Column, hint: Column) -> Column:
    """The declared name's last part, else the hint's file, else PASTED.md."""
    table = F.create_map(*[F.lit(x) for pair in NAME_BY_HINT.items() for x in pair])
    return F.coalesce(safe_basename(declared), F.try_element_at(table, hint), F.lit("PASTED.md"))


def route(name: Column) -> Column:
    """How a submitted file is read: archives by their name, anything else as a text of that name."""
    return F.when(F.endswith(F.lower(name), F.lit(".zip")), "zip").otherwise("text")


def enforce(files: DataFrame, size: Column, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """``files`` of the bundles within the limits on files and bytes, and the errors of the others."""
    each = size > config.max_file_bytes
    sums = files.groupBy("bundle_id").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.max(each).alias("large"))
    error = F.when(F.col("n") > config.max_files, "too many files").when(F.col("large"), "file too large").when(F.col("bytes") > config.max_total_bytes, "bundle too large")
    errors = sums.select("bundle_id", error.alias("error")).where("error is not null")
    return files.join(errors.select("bundle_id"), "bundle_id", "left_anti"), errors


def from_texts(df: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """One file a row of (bundle_id, text[, declared_filename, kind_hint])."""
    for name in ("declared_filename", "kind_hint"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    large = F.octet_length("text") > config.max_total_bytes
    files = df.where(F.coalesce(~large, F.lit(True))).select("bundle_id", text_name(F.col("declared_filename"), F.col("kind_hint")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    return files, df.where(large).select("bundle_id", F.lit("text too large").alias("error"))


def _texts(df: DataFrame, config: Config) -> DataFrame:
    """(bundle_id, path, content) with contents read as bounded, lossy UTF-8."""
    return df.select("bundle_id", "path", lossy(F.col("content"), config.max_file_bytes).alias("text"))


def _listed(df: DataFrame) -> DataFrame:
    """Files outside the ignored folders."""
    return df.where(~F.exists(parts(F.col("path")), lambda p: p.isin(*IGNORED_DIRS)))


def from_binary(df: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(bundle_id, path, content) files, ignored folders left out."""
    files, errors = enforce(_listed(df.select("bundle_id", "path", "content")), F.octet_length("content"), config)
    return _texts(files, config), errors


def from_directory(spark: SparkSession, root: str, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Checked-out bundles below ``root``: its first folder level names the bundle."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    tail = F.substring_index(F.col("path"), root.rstrip("/").split("://")[-1] + "/", -1)
    return from_binary(files.select(F.substring_index(tail, "/", 1).alias("bundle_id"), F.regexp_replace(tail, r"\A[^/]*/", "").alias("path"), "content"), config)


def member_error(info: zipfile.ZipInfo, config: Config) -> str | None:
    """Why an archive's member is refused."""
    name = info.filename.replace("\\", "/")
    if name.startswith("/") or ".." in name.split("/") or (len(name) > 1 and name[1] == ":"):
        return f"unsafe path: {info.filename}"
    if info.file_size > config.max_file_bytes:
        return f"file too large: {info.filename}"
    return None


def unzip(data: bytes, config: Config = DEFAULT) -> tuple[list[tuple[str, bytes]], str | None]:
    """(files, error); an error empties the files. Folders and links are skipped."""
    files: list[tuple[str, bytes]] = []
    total = 0
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            members = [m for m in archive.infolist() if not m.is_dir()]
            if len(members) > config.max_files:
                return [], "too many files"
            for m in members:
                if stat.S_ISLNK(m.external_attr >> 16):
                    continue
                if error := member_error(m, config):
                    return [], error
                with archive.open(m) as f:
                    content = f.read(config.max_file_bytes + 1)
                total += len(content)
                if len(content) > config.max_file_bytes or total > config.max_total_bytes:
                    return [], "archive too large"
                files.append((m.filename.replace("\\", "/"), content))
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, OSError) as e:
        return [], f"bad archive: {e}"
    return files, None


def from_zips(df: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(files, errors) of (bundle_id, content) archives, expanded on the executors."""

    def run(batches):
        for batch in batches:
            for bundle, data in zip(batch.column("bundle_id").to_pylist(), batch.column("content").to_pylist()):
                files, error = unzip(data or b"", config)
                rows = files or [(None, None)]
                yield pa.RecordBatch.from_pydict(
                    {"bundle_id": [bundle] * len(rows), "path": [r[0] for r in rows], "content": [r[1] for r in rows], "error": [error] * len(rows)},
                    schema=pa.schema([("bundle_id", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("error", pa.string())]),
                )

    small = F.coalesce(F.octet_length("content") <= config.max_total_bytes, F.lit(True))
    large = df.where(~small).select(F.col("bundle_id").cast("string"), F.lit("archive too large").alias("error"))
    out = df.where(small).select(F.col("bundle_id").cast("string"), "content").mapInArrow(run, "bundle_id string, path string, content binary, error string")
    errors = out.where("error is not null").select("bundle_id", "error").distinct().unionByName(large)
    return _texts(_listed(out.where("path is not null").select("bundle_id", "path", "content")), config), errors
