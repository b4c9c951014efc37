"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java character class body.
SPACE = r"\x20\x09-\x0D"
#: ASCII white space for ``bytes`` methods; ``bytes.split()`` uses the same set.
SPACE_BYTES = b" \t\n\v\f\r"
#: Maps bytes to themselves, A-Z lower-cased.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Maps bytes to item words: A-Z lower-cased, ASCII other than letters and digits to a space.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which all executors share.

    Where the setting is unset, a local session gets a temporary folder; on a cluster that
    would be a folder of each machine, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-pagemill-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/pagemill-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by ``saved`` that nothing will read again."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` words as long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    pure = F.octet_length(text) == F.length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


class WordHashes(dict):
    """64-bit hash of each word met, in a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays end to end after their lengths in bytes."""
    return b"".join([np.array([a.nbytes for a in arrays], np.int64).tobytes(), *(a.tobytes() for a in arrays)])


def unpack(body: bytes, kinds: str) -> list[np.ndarray]:
    """The arrays of ``pack``, by their type codes."""
    ends = np.cumsum(np.frombuffer(body, np.int64, len(kinds))) + 8 * len(kinds)
    return [np.frombuffer(body[a:b], kind) for kind, a, b in zip(kinds, [8 * len(kinds), *ends], ends)]


def narrow(numbers: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in a small type; those at its end or beyond follow in full."""
    end = np.iinfo(kind).max
    return np.minimum(numbers, end).astype(kind), numbers[numbers >= end].astype(np.int64)


def widen(low: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The numbers of ``narrow``."""
    out = low.astype(np.int64)
    out[low == np.iinfo(low.dtype).max] = rest
    return out


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
