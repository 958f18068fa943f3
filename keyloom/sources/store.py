"""A Parquet point store: an append log per prefix, last write wins, deletes as tombstones, compaction.

A write is a folder ``seq=N`` of Parquet files with the columns it sets; null cells set
nothing.  A delete is a small JSON file with a sequence number, path patterns and key
ranges.  Reading takes for each key and column the value of the latest write that isn't
deleted later.  Writes go through Spark's committer, so a lost executor leaves no half write.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import KEY, col, matches, split_tags, value_columns


@dataclass
class Delete:
    seq: int
    patterns: list[str]
    ranges: list[tuple[int, int]]


class PointStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # Files by Hadoop's interface, so the store may lie wherever Spark reads.

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _next(self) -> int:
        """A sequence number that no other writer has: claimed by creating its file, which only one can."""
        used = [int(n.split("=")[1].split(".")[0]) for n in self._names(self.path) if n.startswith(("write=", "delete=", "claim="))]
        seq = max(used, default=0) + 1
        while True:
            fs, p = self._fs(f"{self.path}/claim={seq:012d}")
            try:
                fs.create(p, False).close()
                return seq
            except Exception as e:
                if not fs.exists(p):
                    raise e
                seq += 1

    def insert(self, df: DataFrame) -> None:
        """Writes points: ``key`` and columns named by full paths.  A row's null cells leave older values alone."""
        if KEY not in df.columns:
            raise ValueError("points need a key")
        df.write.parquet(f"{self.path}/write={self._next():012d}")

    def delete(self, patterns: list[str], ranges: list[tuple[int, int]] | None = None) -> None:
        """Deletes values of matching columns with start <= key < end; without ranges, the columns."""
        seq = self._next()
        fs, p = self._fs(f"{self.path}/delete={seq:012d}.json")
        out = fs.create(p)
        out.write(bytearray(json.dumps({"patterns": patterns, "ranges": ranges}).encode()))
        out.close()

    def clear(self) -> None:
        fs, p = self._fs(self.path)
        fs.delete(p, True)

    def _deletes(self) -> list[Delete]:
        out = []
        for n in self._names(self.path):
            if n.startswith("delete="):
                text = self.spark.read.text(f"{self.path}/{n}", wholetext=True).first()[0]
                body = json.loads(text)
                out.append(Delete(int(n[7:19]), body["patterns"], body["ranges"]))
        return out

    def columns(self) -> dict[str, str]:
        """Full names of the columns that a read gives, with their types."""
        return {f.name: f.dataType.simpleString() for f in self.read().schema if f.name != KEY}

    def read(self, wanted=None, below: int | None = None) -> DataFrame:
        """All points, or those of columns for which ``wanted(name)`` holds, of writes below a sequence number: one row a key.

        Writes are merged by one aggregation on the key; of several values that one write
        gives a cell the greatest is taken, as their order isn't defined.
        """
        deletes = self._deletes()
        parts = []
        for n in self._names(self.path):
            if not n.startswith("write="):
                continue
            seq = int(n[6:])
            if below is not None and seq >= below:
                continue
            df = self.spark.read.parquet(f"{self.path}/{n}")
            out = []
            for name in value_columns(df):
                if wanted and not wanted(name):
                    continue
                later = [d for d in deletes if d.seq > seq and any(matches(p, split_tags(name)[0]) or p == name for p in d.patterns)]
                if any(d.ranges is None for d in later):
                    continue
                gone = [(F.col(KEY) >= a) & (F.col(KEY) < b) for d in later for a, b in d.ranges]
                c = col(name)
                for g in gone:
                    c = F.when(~g, c)
                out.append(c.alias(name))
            if out:
                parts.append((seq, df.select(KEY, *out)))
        if not parts:
            return self.spark.createDataFrame([], f"{KEY} long")
        names = list(dict.fromkeys(c for _, df in parts for c in value_columns(df)))
        if len(parts) == 1:
            merged = parts[0][1].groupBy(KEY).agg(*(F.max(col(c)).alias(c) for c in names))
        else:
            rows = [df.withColumn("keyloom_seq", F.lit(seq)) for seq, df in parts]
            both = rows[0]
            for r in rows[1:]:
                both = both.unionByName(r, allowMissingColumns=True)
            merged = both.groupBy(KEY).agg(*(F.max_by(col(c), F.when(col(c).isNotNull(), F.col("keyloom_seq"))).alias(c) for c in names))
        some = F.coalesce(*(col(c).cast("string") for c in names)).isNotNull()
        return merged.where(some)

    def compact(self) -> None:
        """Rewrites all writes and deletes as one write.

        Old writes go before tombstones and claims: whatever is left by a crash in between
        is read under the tombstones that belong to it.
        """
        old = [n for n in self._names(self.path) if n.startswith(("write=", "delete=", "claim="))]
        seq = self._next()
        self.read(below=seq).write.parquet(f"{self.path}/write={seq:012d}")
        for kind in ("write=", "delete=", "claim="):
            for n in old:
                if n.startswith(kind):
                    fs, p = self._fs(f"{self.path}/{n}")
                    fs.delete(p, True)

    def count_points(self) -> int:
        df = self.read()
        names = value_columns(df)
        if not names:
            return 0
        row = df.agg(*(F.count(col(c)).alias(str(i)) for i, c in enumerate(names))).first()
        return sum(row)
