"""What the operators share: table reads, stored intermediate tables, row splits, word rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.session import scratch_path, ship_package

_NORMAL_WORD = re.compile(r"[^\W_]+")
# Thai, Lao, Myanmar, Khmer, kana, Chinese characters
_RANGES = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_UNSPACED = re.compile(f"[{_RANGES}]")
_CHARACTER_WORD = re.compile(f"(?!_)(?=\\w)[{_RANGES}]|[^\\W_{_RANGES}]+")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table, after making sure that the Python workers can import the package."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh table of the shared folder and read again.

    Cuts the lineage: a lost executor costs a re-read, never a re-run, and
    every later use sees the same rows.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the folders behind ``stored`` frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_split(doc_id: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def words(text: str | None) -> list[bytes]:
    """Runs of bytes that are neither a space nor \\x09-\\x0D, as UTF-8; null has none.
    (``bytes.split()`` without an argument cuts at exactly these six bytes.)"""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def normal_words(text: str | None) -> list[str]:
    """Lower-cased letter and digit runs, for matching across punctuation; scripts
    written without spaces between words are cut into their characters."""
    if not text:
        return []
    return (_CHARACTER_WORD if _UNSPACED.search(text) else _NORMAL_WORD).findall(text.lower())


def free_name(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
