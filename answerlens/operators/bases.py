"""Knowledge bases as stored tables that change in versions.

A change writes the whole content of the bases it touches, and of no others, into new
folders: their chunks (with whatever columns they have, vectors too), the blocks of
their index and its statistics.  Then a new manifest says of every base which change
holds it.  Readers go by one manifest, so chunks, vectors and postings always belong
together, and until a manifest is whole the one before stays in force.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.functions.text import tokens
from answerlens.operators.index import Index, statistics, term_blocks, write_blocks
from answerlens.session import kept

MANIFEST = "kb_id string, change string"


class Bases:
    """Bases in a folder that driver and executors share; chunks(kb_id string, file_id, chunk_id, text, ...)."""

    def __init__(self, spark: SparkSession, folder: str, tokenizer=tokens):
        self.spark, self.folder, self.tokenizer = spark, folder, tokenizer

    def version(self) -> int:
        fs = self.spark._jvm.org.apache.hadoop.fs
        path = fs.Path(f"{self.folder}/manifest")
        disk = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [x.getPath() for x in (disk.listStatus(path) if disk.exists(path) else [])]
        return max((int(p.getName()) for p in found if p.getName().isdigit() and disk.exists(fs.Path(p, "_SUCCESS"))), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """Every base with the change that holds it; null where it has no chunks yet."""
        version = self.version() if version is None else version
        return self.spark.read.schema(MANIFEST).json(f"{self.folder}/manifest/{version}") if version else self.spark.createDataFrame([], MANIFEST)

    def table(self, name: str, version: int | None = None) -> DataFrame | None:
        """The rows of all bases in chunks, blocks, by_base or by_term; None before the first change."""
        held = self.manifest(version).where("change IS NOT NULL")
        if held.limit(1).count() == 0:
            return None
        return self.spark.read.parquet(f"{self.folder}/{name}").join(held, ["kb_id", "change"], "left_semi").drop("change")

    def index(self, version: int | None = None) -> Index:
        version = self.version() if version is None else version
        return Index(*(self.table(name, version) for name in ("blocks", "by_base", "by_term")), f"{self.folder}/derived/{version}", True)

    def _publish(self, manifest: DataFrame, version: int) -> None:
        manifest.write.mode("overwrite").json(f"{self.folder}/manifest/{version + 1}")

    def replace(self, incoming: DataFrame) -> DataFrame:
        """The incoming files take the place of files of their names -> kb_id, file_id, deleted: how many chunks went."""
        version, change = self.version(), uuid4().hex
        incoming = kept(incoming.withColumn("kb_id", F.col("kb_id").cast("string")))
        files, touched = incoming.select("kb_id", "file_id").distinct(), incoming.select("kb_id").distinct()
        before = self.table("chunks", version)
        if before is None:
            before = incoming.limit(0)
        before = before.join(touched, "kb_id", "left_semi")
        gone = before.join(files, ["kb_id", "file_id"], "left_semi").groupBy("kb_id", "file_id").agg(F.count(F.lit(1)).alias("deleted"))
        after = before.join(files, ["kb_id", "file_id"], "left_anti").unionByName(incoming, allowMissingColumns=True)
        path = lambda name: f"{self.folder}/{name}/change={change}"
        after.repartitionByRange("kb_id", "chunk_id").sortWithinPartitions("kb_id", "chunk_id").write.parquet(path("chunks"))
        after = self.spark.read.parquet(path("chunks"))
        write_blocks(term_blocks(after.select("kb_id", "chunk_id", self.tokenizer(F.col("text")).alias("t")), version), path("blocks"))
        by_base, by_term = statistics(self.spark.read.parquet(path("blocks")))
        by_base.write.parquet(path("by_base"))
        by_term.write.parquet(path("by_term"))
        counts = kept(files.join(gone, ["kb_id", "file_id"], "left").fillna(0, ["deleted"]))
        kept_as_it_was = self.manifest(version).join(touched, "kb_id", "left_anti")
        self._publish(kept_as_it_was.unionByName(touched.withColumn("change", F.lit(change))), version)
        return counts

    def create(self, names: DataFrame) -> DataFrame:
        """names(kb_id) must be new -> those that were created."""
        version = self.version()
        new = kept(names.select(F.col("kb_id").cast("string")).distinct().join(self.manifest(version), "kb_id", "left_anti"))
        self._publish(self.manifest(version).unionByName(new.withColumn("change", F.lit(None).cast("string"))), version)
        return new

    def drop(self, names: DataFrame) -> DataFrame:
        """Bases go with their chunks, vectors and postings -> kb_id, deleted: how many chunks went."""
        version = self.version()
        names = kept(names.select(F.col("kb_id").cast("string")).distinct())
        chunks = self.table("chunks", version)
        gone = self.manifest(version).join(names, "kb_id", "left_semi").select("kb_id")
        n = chunks.join(names, "kb_id", "left_semi").groupBy("kb_id").agg(F.count(F.lit(1)).alias("deleted")) if chunks is not None else gone.limit(0).withColumn("deleted", F.lit(0).cast("long"))
        counts = kept(gone.join(n, "kb_id", "left").fillna(0, ["deleted"]))
        self._publish(self.manifest(version).join(names, "kb_id", "left_anti"), version)
        return counts
