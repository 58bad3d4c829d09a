"""Readers of the formats that public records come in."""

from __future__ import annotations

import hashlib
import tempfile
import urllib.request
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.session import checkpoint_dir


def read_names_csv(spark: SparkSession, column: str, path: str | None = None, url: str | None = None, limit: int | None = None) -> DataFrame:
    """(pos, raw_name): a column of a CSV with a header, all strings, without
    null and blank values, trimmed, each once in order of first appearance.

    Give either ``path`` or ``url``. A missing column is a KeyError. ``limit``
    counts rows before repeats are taken out.
    """
    if (path is None) == (url is None):
        raise ValueError("give either path or url")
    if url is not None:
        # Executors read the file, so it goes to the folder that they share.
        name = hashlib.sha256(check_url(url).encode()).hexdigest()[:16]
        path = download(url, urlsplit(f"{checkpoint_dir(spark)}/downloads/{name}.csv").path)[0]
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=False)
    if column not in df.columns:
        raise KeyError(f"no column {column!r}; there are {df.columns}")
    return distinct_names(df.select(F.col(f"`{column}`").alias("raw_name")).withColumn("pos", F.monotonically_increasing_id()), limit=limit)


def distinct_names(df: DataFrame, name: str = "raw_name", pos: str = "pos", limit: int | None = None) -> DataFrame:
    """Distinct trimmed names with their first position; null and blank ones go."""
    t = df.select(F.trim(F.col(name)).alias("raw_name"), F.col(pos).alias("pos")).where("raw_name is not null and raw_name <> ''")
    if limit is not None:
        t = t.orderBy("pos").limit(limit)
    return t.groupBy("raw_name").agg(F.min("pos").alias("pos")).select("pos", "raw_name")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON Lines, plain or gzipped. ``strict``: a damaged line fails the query;
    else it is dropped, as are lines that aren't objects. Blank lines go."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if strict:
        return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    ok = F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{")
    return lines.where(ok).select(F.from_json("value", schema).alias("r")).select("r.*")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A JSON document a file; other suffixes than .json are refused."""
    if Path(urlsplit(path).path).suffix not in (".json", "") and "*" not in path:
        raise ValueError(f"not a JSON file: {path}")
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_documents(spark: SparkSession, root: str, glob: str = "*.json", recursive: bool = True) -> DataFrame:
    """(path, folder, content): whole files below a folder, each path once."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root)
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("folder"), F.col("content").cast("string").alias("content")).dropDuplicates(["path"])


def parsed(documents: DataFrame, schema: T.StructType | str, content: str = "content") -> DataFrame:
    """``documents`` with ``record``, and ``error`` in words where there is none:
    an empty file, no JSON, or no object."""
    x = F.trim(content)
    error = F.when(x.isNull() | (x == ""), "the file is empty").when(F.try_parse_json(content).isNull(), "the file isn't JSON").when(~x.startswith("{"), "the file holds no object")
    return documents.withColumn("error", error).withColumn("record", F.when(F.col("error").isNull(), F.from_json(content, schema)))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def check_url(url: str, schemes: tuple[str, ...] = ("http", "https")) -> str:
    """The URL if it is safe to fetch: a known scheme, a host, no credentials."""
    u = urlsplit(url)
    if u.scheme not in schemes or not u.hostname or u.username or u.password:
        raise ValueError(f"not a plain {' or '.join(schemes)} address: {url}")
    return url


def download(url: str, to: str | None = None, force: bool = False, chunk: int = 1 << 20) -> tuple[str, str, int]:
    """(path, sha256, bytes), on the driver and outside plans. A file that is
    there isn't fetched again unless ``force``d."""
    check_url(url)
    path = Path(to) if to else Path(tempfile.mkdtemp(prefix="rollcall-download-")) / (Path(urlsplit(url).path).name or "download")
    digest, size = hashlib.sha256(), 0
    if not path.exists() or force:
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_name(path.name + ".part")
        with urllib.request.urlopen(url, timeout=60) as r, part.open("wb") as f:  # noqa: S310
            while data := r.read(chunk):
                f.write(data)
        part.replace(path)
    with path.open("rb") as f:
        while data := f.read(chunk):
            digest.update(data)
            size += len(data)
    return str(path), digest.hexdigest(), size


def hash_bucket(x: Column | str, buckets: int = 10_000) -> Column:
    """A stable bucket from the first 32 bits of SHA-256."""
    x = F.col(x) if isinstance(x, str) else x
    return F.conv(F.substring(F.sha2(x.cast("binary"), 256), 1, 8), 16, 10).cast("long") % buckets


def hash_sample(df: DataFrame, key: str, threshold: int, buckets: int = 10_000, max_items: int | None = None) -> DataFrame:
    """Rows whose key's bucket is under the threshold; rows without key go."""
    out = df.where(F.col(key).isNotNull() & (hash_bucket(key, buckets) < threshold))
    return out.limit(max_items) if max_items is not None else out
