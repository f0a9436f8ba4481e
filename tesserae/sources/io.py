"""Readers, writers and file discovery."""

from __future__ import annotations

import json
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.numeric import parse_date
from tesserae.functions.text import squeeze, word_count
from tesserae.operators.reports import union_all
from tesserae.session import checkpoint_folder


def work_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder beside the checkpoints, which all executors share, for what is written and read again; not made yet."""
    base = re.sub(r"^file:(//)?", "", checkpoint_folder(spark))
    if re.match(r"^\w+://", base):
        raise ValueError(f"{base} is not a mounted folder")
    os.makedirs(base, exist_ok=True)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def read_text_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A CSV file with all columns as strings; empty cells are null, a byte order mark is dropped.

    With ``multi_line`` quoted line ends are read, which makes a file one task; without, large files are split.
    """
    df = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("inferSchema", False).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_typed_csv(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """A CSV file with the given schema, or with inferred types."""
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def restore_types(df: DataFrame, numbers: list[str], dates: list[str], text: str | None = None, count: str = "abstract_word_count") -> DataFrame:
    """A re-read table with its numbers and dates again; a word count that is missing or all null is counted anew from ``text``."""
    out = df.withColumns({c: F.col(c).try_cast("double") for c in numbers if c in df.columns} | {c: parse_date(c) for c in dates if c in df.columns})
    if text and (count not in out.columns or out.agg(F.count(count)).first()[0] == 0):
        out = out.withColumn(count, word_count(text))
    return out


def is_sidecar(name: str) -> bool:
    """Files that archives and systems leave behind: ``._x``, dot files, ``__MACOSX``."""
    parts = Path(name).parts
    return any(p == "__MACOSX" for p in parts) or Path(name).name.startswith(".")


def version_of(name: str) -> tuple[int, ...]:
    """The numbers of the last ``v<numbers>`` of a name; greater is newer."""
    found = re.findall(r"[vV](\d+(?:[._]\d+)*)", Path(name).stem)
    return tuple(int(x) for x in re.split(r"[._]", found[-1])) if found else (0,)


def csv_members(archive: str) -> list[str]:
    with zipfile.ZipFile(archive) as z:
        return sorted(n for n in z.namelist() if n.lower().endswith(".csv") and not is_sidecar(n))


def choose_member(names: list[str], preferred: str | None = None, known: list[str] = ()) -> str:
    """The preferred name, else a known one, else one with "modeling" in it, else the newest version; ties by name."""
    by_base = {Path(n).name: n for n in sorted(names, reverse=True)}
    for name in [preferred, *known]:
        if name and name in by_base:
            return by_base[name]
    rest = [n for n in names if "modeling" in n.lower()] or names
    if not rest:
        raise FileNotFoundError("the archive has no CSV file")
    return sorted(rest, key=lambda n: (tuple(-v for v in version_of(n)), n))[0]


def read_csv_or_zip(spark: SparkSession, path: str, preferred: str | None = None, folder: str | None = None) -> DataFrame:
    """A CSV file, or the chosen CSV of a zip archive, unpacked to ``folder``.

    A zip archive can't be split, so the driver unpacks it; on a cluster ``folder`` must be shared by all executors.
    """
    if is_sidecar(path):
        raise ValueError(f"not a data file: {path}")
    if not path.lower().endswith(".zip"):
        return read_text_csv(spark, path)
    target = Path(folder or tempfile.mkdtemp(prefix="tesserae-zip-"))
    member = choose_member(csv_members(path), preferred)
    target.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path) as z, z.open(member) as source, open(target / Path(member).name, "wb") as out:
        shutil.copyfileobj(source, out)
    return read_text_csv(spark, str(target / Path(member).name))


def discover(folder: str, names: list[str] = (), globs: list[str] = ("*.csv", "*.zip", "*.parquet")) -> str:
    """The first of ``names`` that exists in ``folder``, else the newest version that fits a pattern."""
    for name in names:
        if (Path(folder) / name).exists():
            return str(Path(folder) / name)
    found = [p for g in globs for p in Path(folder).rglob(g) if not is_sidecar(str(p.relative_to(folder)))]
    if not found:
        raise FileNotFoundError(f"nothing in {folder} fits {', '.join([*names, *globs])}")
    return str(sorted(found, key=lambda p: (tuple(-v for v in version_of(p.name)), str(p)))[0])


def register_tables(spark: SparkSession, folder: str) -> list[str]:
    """Every ``<name>.parquet`` of ``folder`` as a temporary view ``<name>``."""
    names = sorted(p.stem for p in Path(folder).glob("*.parquet"))
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
    return names


def flat(df: DataFrame) -> DataFrame:
    """``df`` with nested columns as JSON text, as CSV holds no others."""
    return df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, overwrite: bool = False, bom: bool = False) -> None:
    """Part files with headers; nested columns as JSON. With ``bom`` every file begins with a byte order mark, as spreadsheets want it."""
    rows = flat(df)
    rows = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0]) if bom else rows
    rows.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def refuse_overwrite(paths: list[str], overwrite: bool) -> None:
    """Raises if a path exists and may not be replaced."""
    there = [p for p in paths if os.path.exists(p)]
    if there and not overwrite:
        raise FileExistsError(f"already there: {', '.join(there)}")


def reset_folder(path: str, root: str, overwrite: bool) -> None:
    """An empty folder below ``root``; the root itself and anything outside of it are never deleted."""
    inside, base = Path(path).resolve(), Path(root).resolve()
    if inside == base or base not in inside.parents:
        raise ValueError(f"{path} is not below {root}")
    refuse_overwrite([path], overwrite)
    shutil.rmtree(inside, ignore_errors=True)
    inside.mkdir(parents=True)


def write_summary(path: str, **values) -> None:
    """Small results as one JSON file."""
    Path(path).write_text(json.dumps(values, indent=2, sort_keys=True, default=str), encoding="utf-8")


def rows_as_dicts(df: DataFrame, limit: int = 10_000) -> list[dict]:
    """A small report as dictionaries; raises if it has more than ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    return [r.asDict(recursive=True) for r in rows]


def read_results(spark: SparkSession, folder: str, name: str = "metrics.csv", levels: list[str] = ("target", "split", "model")) -> DataFrame:
    """All result files of a name below ``folder``, with the folders above each file as columns (nearest last)."""
    df = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).option("inferSchema", True).csv(folder)
    parts = F.split(F.col("_metadata.file_path"), "/")
    columns = [F.try_element_at(parts, F.lit(k - len(levels) - 1)).alias(level) for k, level in enumerate(levels)]
    return df.select(*columns, *[F.col(c) for c in df.columns if c not in levels])


def rollup_results(spark: SparkSession, folders: list[str], name: str = "metrics.csv", levels: list[str] = ("target", "split", "model")) -> DataFrame:
    return union_all([read_results(spark, f, name, levels) for f in folders])


def cached(path: str, make, spark: SparkSession) -> DataFrame:
    """The table at ``path``; if it isn't there, what ``make`` gives is written first."""
    if not os.path.exists(os.path.join(path, "_SUCCESS")):
        write_table(make(), path, overwrite=True)
    return spark.read.parquet(path)


def clean_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: squeeze(c) for c in cols})
