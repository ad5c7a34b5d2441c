"""Versioned Parquet index store (K1, S5, V1) with deltas.

A version is either whole or a delta to the one before it:

    data/v=N     index rows that version N adds (all rows if N is whole)
    removed/v=N  files whose rows of earlier versions no longer count
    claims/v=N.* put up by a writer that wants to write version N
    manifest/v=N which data file of version N holds which parts of the file names
    published/N  marker, written last; its name ends in ``-full`` if N is whole

A version counts only once its marker exists, so a reader never sees a
half-written index and a failed job leaves the previous version in place. A
delta costs what it changes: no row of an untouched file is read or written.
``load`` reads the newest whole version and the deltas after it, and drops the
rows that a later delta replaces by one join on the file name with the removed
files. ``compact`` writes a whole version; ``expire`` removes what is older.

Rows are clustered by a hash of ``file``: a version has a number of parts, and
the manifest lists, for each data file, the parts it holds, its rows and its
vector width. ``load_files`` looks the names it is given up there and opens only
the data files that can hold them: retrieval gets the texts of its hits so, and
a stream the rows of the files that a batch names.

Listing goes through the Hadoop FileSystem of the path, so the same code works
on HDFS or object stores.
"""

from __future__ import annotations

import random
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Vector width of each row, written beside the vectors: the dimension check
# then reads one int column instead of the vectors themselves.
DIM_COL = "_dim"
MANIFEST = "path string, part int, dim int, n long, parts int"
#: A whole version has as many parts as a shuffle; a delta this share of them.
DELTA_SHARE = 8


class IndexNotFound(FileNotFoundError):
    pass


class IndexStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    # -- file system helpers ------------------------------------------------
    def _at(self, *parts: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, *parts: str) -> list[str]:
        fs, p = self._at(*parts)
        return [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []

    def _delete(self, *parts: str) -> None:
        fs, p = self._at(*parts)
        fs.delete(p, True)

    def _mark(self, *parts: str) -> None:
        fs, p = self._at(*parts)
        fs.create(p, True).close()

    def _published(self) -> dict[int, bool]:
        """Published versions in order, and whether each is whole."""
        names = [n for n in self._names("published") if n[:1].isdigit()]
        return dict(sorted((int(n.split("-")[0]), n.endswith("-full")) for n in names))

    def _claim(self) -> int:
        """A version number of this writer's own: one past every version that
        is present or claimed. A writer puts up its claim, then looks: it has
        the number if no other claim to it is there. Of two writers at least one
        sees the other, and whoever sees one goes on to a later number. This
        needs no atomic create, only listings that show what was created."""
        number = lambda n: int(n[2:].split(".")[0])
        taken = [number(n) for kind in ("data", "removed", "claims") for n in self._names(kind) if n.startswith("v=")]
        v = 1 + max([0, *taken])
        while True:
            mine = f"v={v:06d}.{uuid.uuid4().hex}"
            self._mark("claims", mine)
            if not any(n != mine and n.startswith(mine[:9]) for n in self._names("claims")):
                return v
            v = 1 + max(number(n) for n in self._names("claims") if n.startswith("v=")) + random.randrange(4)

    # -- contract -----------------------------------------------------------
    def versions(self) -> list[int]:
        return list(self._published())

    def exists(self) -> bool:
        return bool(self.versions())

    def has_tag(self, tag: str) -> bool:
        """Whether some published version carries ``tag`` (e.g. a stream batch id)."""
        held = self._published()
        return any(int(n.split("-", 1)[0]) in held for n in self._names("tags") if n.split("-", 1)[1:] == [tag])

    def _write_data(self, index: DataFrame, name: str, parts: int) -> set[int]:
        """Write the rows of a version and its manifest; returns the vector
        widths. The manifest is read from two columns of what was written."""
        part = F.pmod(F.xxhash64("file"), F.lit(parts)).cast("int")
        rows = index.withColumn(DIM_COL, F.size("embedding")).repartition(parts, part).sortWithinPartitions("file", "chunk_index")
        rows.write.parquet(f"{self.path}/data/v={name}")
        back = self.spark.read.schema("file string, _dim int").parquet(f"{self.path}/data/v={name}")
        listed = back.groupBy(F.input_file_name().alias("path"), part.alias("part"), F.col(DIM_COL).alias("dim")).agg(F.count(F.lit(1)).alias("n"))
        listed.withColumn("parts", F.lit(parts)).coalesce(1).write.parquet(f"{self.path}/manifest/v={name}")
        dims = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v={name}").where("dim >= 0").select("dim").distinct().limit(2)
        return {r.dim for r in dims.collect()}

    def _manifest(self, versions: list[int]) -> DataFrame:
        paths = [f"{self.path}/manifest/v={v:06d}" for v in versions]
        return self.spark.read.option("basePath", f"{self.path}/manifest").schema(MANIFEST + ", v int").parquet(*paths)

    def _publish(self, index: DataFrame, removed: DataFrame | None, tag: str | None) -> str:
        v = self._claim()
        name = f"{v:06d}"
        full = removed is None
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dims = self._write_data(index, name, parts if full else max(1, parts // DELTA_SHARE))
        before = self._published()
        if not full and before:
            base = max(n for n in before if before[n])
            dims |= {r.dim for r in self._manifest([base]).where("dim >= 0").select("dim").distinct().limit(2).collect()}
        if len(dims) > 1:
            self._delete("data", f"v={name}")
            raise ValueError("index vectors differ in dimension")
        if not full:
            removed.select("file").distinct().write.parquet(f"{self.path}/removed/v={name}")
        if tag:
            self._mark("tags", f"{v:06d}-{tag}")
        self._mark("published", name + ("-full" if full else ""))  # the version becomes visible here
        return f"{self.path}/data/v={name}"

    def save(self, index: DataFrame, tag: str | None = None) -> str:
        """K1: write a whole new version; all vectors must share one dimension.

        The data is written once together with each row's vector width; the
        manifest and the dimension check read only that int column and the file
        names back; then the marker publishes the version, so readers only ever
        see checked versions.
        """
        return self._publish(index, None, tag)

    def save_delta(self, rows: DataFrame, removed: DataFrame, tag: str | None = None) -> str:
        """Publish ``rows`` in place of all earlier rows of the files in
        ``removed`` (column ``file``)."""
        if not self.exists():
            raise IndexNotFound("no index found; build one first")
        return self._publish(rows, removed, tag)

    def _state(self) -> tuple[int, list[int]]:
        """The newest whole version and the deltas after it."""
        held = self._published()
        if not held:
            raise IndexNotFound("no index found; build one first")
        base = max(v for v, full in held.items() if full)
        return base, [v for v in held if v > base]

    def _current(self, base: int, deltas: list[int], paths: list[str]) -> DataFrame:
        """The rows of data folders or files that no later delta replaces."""
        rows = self.spark.read.option("basePath", f"{self.path}/data").parquet(*paths)
        if not deltas:
            return rows.drop("v", DIM_COL)
        gone = [f"{self.path}/removed/v={v:06d}" for v in deltas]
        last = self.spark.read.option("basePath", f"{self.path}/removed").parquet(*gone).groupBy("file").agg(F.max("v").alias("_last"))
        rows = rows.join(last, "file", "left")
        return rows.where(F.col("_last").isNull() | (F.col("v") >= F.col("_last"))).drop("_last", "v", DIM_COL)

    def load(self) -> DataFrame:
        """The newest version: its base with all deltas applied."""
        base, deltas = self._state()
        return self._current(base, deltas, [f"{self.path}/data/v={v:06d}" for v in [base, *deltas]])

    def load_files(self, names: DataFrame) -> DataFrame:
        """The rows of the newest version whose ``file`` is in ``names``. Only
        data files whose parts can hold one of the names are opened. The names
        are evaluated twice."""
        base, deltas = self._state()
        listed = self._manifest([base, *deltas])
        sizes = listed.select("parts").distinct()
        # a version has its own number of parts; there are as many numbers as settings of the session
        asked = None
        for (parts,) in sizes.collect():
            mine = names.select(F.pmod(F.xxhash64("file"), F.lit(parts)).cast("int").alias("part"), F.lit(parts).alias("parts")).distinct()
            asked = mine if asked is None else asked.unionByName(mine)
        paths = [r.path for r in listed.join(asked, ["parts", "part"], "left_semi").select("path").distinct().collect()] if asked is not None else []
        if not paths:
            return self.load().limit(0)
        return self._current(base, deltas, sorted(paths)).join(names.select("file").distinct(), "file", "left_semi")

    def compact(self) -> str:
        """Write the newest state as a whole version."""
        return self.save(self.load())

    def expire(self) -> list[int]:
        """Remove the versions before the newest whole one; nothing may still
        read them. Returns the removed versions."""
        held = self._published()
        base = max((v for v, full in held.items() if full), default=0)
        old = [v for v in held if v < base]
        for v in old:
            self._delete("published", f"{v:06d}" + ("-full" if held[v] else ""))
        for kind in ("data", "removed", "manifest"):
            for n in self._names(kind):
                if n.startswith("v=") and int(n[2:]) in old:
                    self._delete(kind, n)
        return old

    def search(self, queries: DataFrame, k: int = 5, embed=None, index_root=None) -> DataFrame:
        """C3 on the newest version; texts are read for the hits' files only."""
        from quarry.plans.indexing import retrieve
        return retrieve(self.load(), queries, k, embed=embed, index_root=index_root, files_of=self.load_files)
