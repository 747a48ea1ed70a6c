"""Merkle manifest of a dataset, and proofs by a recursive query.

A row of the dataset is a leaf, the hash of its values.  The leaves of a source, in the
order of doc_id, are put together in runs of 16, whose hashes are put together again,
until one is left, the source's subroot; subroots, in the order of the source, form a
tree of the same kind.  Every level is written as rows (id, hash, children, up, slot):
``up`` is the parent's id and ``slot`` the place among its children.

A proof climbs from each leaf to the root with a recursive query: it joins its row
with the parent's, appends the siblings there, and folds its own hash with them.  The
leaves of one run climb in one row, as they share all siblings above the run; each
folds a hash of its own.

Places within a source come from a sort by range of narrow rows (no texts), so a source
with most of the rows is no task of its own.

Defined cases: a null value is hashed as ``-``; a null source comes first, a null doc_id
before all others of its source; rows with one doc_id are ordered by their hashes, equal
rows are equal leaves; a single leaf is its source's subroot, a single subroot the root,
and the proof of a single row is the hash of nothing; an empty table gives no rows;
columns other than those hashed do not matter; a very long text is hashed whole.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from answerlens.llm.common import cut, drop, id_bucket, parts, same, shared_dir

RUN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Spans of a sort by range are broadcast up to so many (about 60 bytes each).
BROADCAST_SPANS = 100_000
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
#: The tree over subroots; the trees of sources are named "n" or "s" and the source.
TOP = "t"


def hashed(values: dict[str, Column]) -> Column:
    """The hash of a row's values."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values.values()]).cast("binary"), 256)


def leaves(docs: DataFrame, tampered: Column, tampering: dict[str, Column], columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """docs -> doc_id, tree, hash, other: the hash of a row, and that of the row tampered with where it is."""
    values = {c: F.col(c) for c in columns}
    tree = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    return docs.select("doc_id", tree.alias("tree"), hashed(values).alias("hash"), F.when(tampered, hashed(values | tampering)).alias("other"))


def place(rows: DataFrame, *order: str) -> DataFrame:
    """rows(tree, ...) with pos, the place in the tree by order from 0, and n, the tree's rows; tree is kept whole in no task."""
    n = parts(rows.sparkSession)
    ranged = rows.repartitionByRange(n, "tree", *order, F.monotonically_increasing_id()).sortWithinPartitions("tree", *order)
    ranged = cut(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("span", F.shiftright("at", 33)))
    by_span = Window.partitionBy("tree").orderBy("span")
    spans = ranged.groupBy("tree", "span").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    spans = spans.withColumn("ahead", F.sum("size").over(by_span) - F.col("size")).withColumn("n", F.sum("size").over(Window.partitionBy("tree")))
    spans = cut(spans.select("tree", "span", "first", "ahead", "n"))
    if spans.count() <= BROADCAST_SPANS:
        spans = F.broadcast(spans)
    return ranged.join(spans, ["tree", "span"]).withColumn("pos", F.col("at") - F.col("first") + F.col("ahead")).drop("at", "span", "first", "ahead")


def _id(tree: Column, level: Column, pos: Column) -> Column:
    return F.concat_ws("/", level.cast("string"), pos.cast("string"), tree)


def _runs(nodes: DataFrame, *carried: str) -> DataFrame:
    """nodes(tree, n, pos, hash, ...) -> the runs of RUN of them, in the order of pos: tree, n, pos, run."""
    run = F.sort_array(F.collect_list(F.struct("pos", "hash", *carried))).alias("run")
    return nodes.groupBy("tree", "n", F.expr(f"pos div {RUN}").alias("up_pos")).agg(run).withColumnRenamed("up_pos", "pos")


def _children(run: str) -> Column:
    return F.transform(run, lambda x: x["hash"])


def _join_hash(children: Column) -> Column:
    return F.sha2(F.array_join(children, "").cast("binary"), 256)


class Manifest:
    """The levels of a dataset's tree as Parquet in the shared folder: runs (of leaves), nodes (all above)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.runs, self.nodes = spark.read.parquet(f"{folder}/runs"), spark.read.parquet(f"{folder}/nodes")
        self.folder = folder


def build(placed: DataFrame) -> Manifest:
    """placed(doc_id, tree, hash, other, pos, n) -> the tree's rows; each level is written from the one below."""
    spark = placed.sparkSession
    folder = f"{shared_dir(spark)}/manifest-{uuid4().hex}"
    runs = _runs(placed, "doc_id", "other").withColumn("level", (F.col("n") > 1).cast("int"))
    runs = runs.withColumn("hash", F.when(F.col("n") > 1, _join_hash(_children("run"))).otherwise(F.col("run")[0]["hash"]))
    runs.write.parquet(f"{folder}/leaf_runs")
    runs = spark.read.parquet(f"{folder}/leaf_runs")
    most = runs.agg(F.max("n")).first()[0] or 0
    tops = _grow(runs.select("tree", "n", "pos", "hash", "level"), most, f"{folder}/sources")
    subroots = cut(place(tops.where(f"n <= power({RUN}, level)").select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "hash"), "of"))
    roots = _runs(subroots).withColumn("level", (F.col("n") > 1).cast("int")).withColumn("children", _children("run"))
    roots = roots.withColumn("hash", _join_hash(F.col("children"))).where("n > 1").select("tree", "n", "pos", "hash", "level", "children")
    roots.write.parquet(f"{folder}/root_runs")
    roots = spark.read.parquet(f"{folder}/root_runs")
    high = _grow(roots, subroots.agg(F.max("n")).first()[0] or 0, f"{folder}/tops")
    links = subroots.select(F.col("of").alias("tree"), F.when(F.col("n") > 1, _id(F.lit(TOP), F.lit(1), F.expr(f"pos div {RUN}"))).alias("up"), F.expr(f"int(pos % {RUN})").alias("slot"))

    def linked(rows: DataFrame) -> DataFrame:
        """With id, up and slot; the subroot of a source goes on in the tree over the sources."""
        rows = rows.withColumn("id", _id(F.col("tree"), F.col("level"), F.col("pos")))
        inside = rows.where(f"n > power({RUN}, level)")
        inside = inside.withColumn("up", _id(F.col("tree"), F.col("level") + 1, F.expr(f"pos div {RUN}"))).withColumn("slot", F.expr(f"int(pos % {RUN})"))
        top = rows.where(f"n <= power({RUN}, level)")
        return inside.unionByName(top.join(links, "tree", "left").select(inside.columns))

    linked(runs).select("id", "hash", "run", "up", "slot").write.parquet(f"{folder}/runs")
    low = tops.where("level > 1").withColumn("top", F.lit(False)).unionByName(high.withColumn("top", F.lit(True)))
    linked(low).select("id", "hash", "children", "up", "slot", "top").write.parquet(f"{folder}/nodes")
    drop(subroots)
    return Manifest(spark, folder)


def _grow(nodes: DataFrame, most: int, folder: str) -> DataFrame:
    """nodes(tree, n, pos, hash, level) of level 1 (0 where a tree has one leaf) -> these and all levels above, with their children; most: the largest n."""
    spark = nodes.sparkSession
    if "children" not in nodes.columns:
        nodes = nodes.withColumn("children", F.lit(None).cast("array<string>"))
    every, level, current = nodes, 1, nodes
    while most > RUN**level:
        above = _runs(current.where(F.col("n") > RUN**level)).withColumn("children", _children("run"))
        above = above.select("tree", "n", "pos", _join_hash(F.col("children")).alias("hash"), F.lit(level + 1).alias("level"), "children")
        above.write.parquet(f"{folder}/{level + 1}")
        current = spark.read.parquet(f"{folder}/{level + 1}")
        every = every.unionByName(current)
        level += 1
    return every


CLIMB = """
WITH RECURSIVE climb AS (
  SELECT id, up, slot, hash, false AS top, CAST(NULL AS string) AS subroot, X'' AS siblings, array_distinct(folded) AS folds FROM {runs}
  UNION ALL
  SELECT /*+ MERGE(p) */ c.id, p.up, p.slot, p.hash, p.top, CASE WHEN p.top AND NOT c.top THEN c.hash ELSE c.subroot END,
         concat(c.siblings, unhex(array_join(slice(p.children, 1, c.slot), '')), unhex(array_join(slice(p.children, c.slot + 2, {run}), ''))),
         transform(c.folds, f -> sha2(concat(array_join(slice(p.children, 1, c.slot), ''), f, array_join(slice(p.children, c.slot + 2, {run}), '')), 256))
  FROM climb c JOIN {nodes} p ON p.id = c.up
)
SELECT id, hash AS root, coalesce(subroot, hash) AS subroot, siblings, folds FROM climb WHERE up IS NULL
"""


def _first_folds() -> Column:
    """Of each leaf in a run, the run's hash with the leaf as it is now; of a leaf that is a source by itself, the leaf."""
    hashes = _children("run")

    def fold(x: Column, i: Column) -> Column:
        now = F.coalesce(x["other"], x["hash"])
        whole = F.concat(F.array_join(F.slice(hashes, F.lit(1), i), ""), now, F.array_join(F.slice(hashes, i + 2, F.lit(RUN)), ""))
        return F.when(F.startswith("id", F.lit("0/")), now).otherwise(F.sha2(whole.cast("binary"), 256))

    return F.transform("run", fold)


def prove(manifest: Manifest) -> DataFrame:
    """Every leaf's way to the root: doc_id, leaf, subroot, root, siblings (level by level, in one text), folded_root.

    Hashes of one run that are equal, as those of all leaves that were not changed, are folded once.
    """
    spark = manifest.runs.sparkSession
    names = {"runs": f"runs_{uuid4().hex}", "nodes": f"nodes_{uuid4().hex}"}
    runs = manifest.runs.withColumn("folded", _first_folds())
    runs.createOrReplaceTempView(names["runs"])
    manifest.nodes.createOrReplaceTempView(names["nodes"])
    limit = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")  # of rows in all, read when the query runs
    try:
        climbed = cut(spark.sql(CLIMB.format(run=RUN, **names)))
    finally:
        spark.conf.set(ROW_LIMIT, limit)
        for name in names.values():
            spark.catalog.dropTempView(name)
    each = climbed.hint("merge").join(runs.select("id", "run", "folded"), "id").withColumn("above", F.lower(F.hex("siblings")))
    each = each.select("root", "subroot", "above", "run", "folds", "folded", F.posexplode("run").alias("i", "x"))
    others = F.array_join(F.transform(F.filter("run", lambda y, j: j != F.col("i")), lambda y: y["hash"]), "")
    folded = F.get("folds", F.array_position(F.array_distinct("folded"), F.get("folded", "i")).cast("int") - 1)
    return each.select("x.doc_id", F.col("x.hash").alias("leaf"), "subroot", "root", F.concat(others, "above").alias("siblings"), folded.alias("folded_root"))


def op13_merkle(spark, sf_dir):
    """Every document with its leaf, its proof, and whether the root still follows after some texts were tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = cut(leaves(docs, id_bucket("doc_id", 5) == 0, {"text": lowered}))
    manifest = build(place(found, "doc_id", "hash"))
    drop(found)
    return prove(manifest).select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("siblings").cast("binary"), 256).alias("proof_sha256"), "folded_root", same(F.col("folded_root"), F.col("root")).alias("verified"))


OP13_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS row_id, *, CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(coalesce(doc_id::VARCHAR, '')) + 1), lambda p: ascii(substr(doc_id::VARCHAR, p, 1))::BIGINT)),
      lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda b, i: xor(b >> 1, 3988292384 * (b & 1)))), 4294967295) % 5 = 0
      THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM documents
), heads AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
      || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head FROM docs
), hashes AS (
  SELECT row_id, doc_id, coalesce('s' || source, 'n') AS tree, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(changed)::VARCHAR || ':' || changed, '-')) AS other FROM heads
), leaf AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashes
), up AS (
  SELECT 0 AS level, tree, pos, leaf AS hash, NULL::VARCHAR[] AS run, count(*) OVER (PARTITION BY tree) AS n FROM leaf
  UNION ALL
  SELECT any_value(level) + 1, tree, pos // 16, sha256(string_agg(hash, '' ORDER BY pos)), list(hash ORDER BY pos), (any_value(n) + 15) // 16
  FROM up WHERE n > 1 GROUP BY tree, pos // 16
), subroot AS (
  SELECT tree, hash, row_number() OVER (ORDER BY tree) - 1 AS pos FROM up WHERE n = 1
), over_sources AS (
  SELECT 0 AS level, pos, hash, NULL::VARCHAR[] AS run, count(*) OVER () AS n FROM subroot
  UNION ALL
  SELECT any_value(level) + 1, pos // 16, sha256(string_agg(hash, '' ORDER BY pos)), list(hash ORDER BY pos), (any_value(n) + 15) // 16
  FROM over_sources WHERE n > 1 GROUP BY pos // 16
), climb AS (
  SELECT row_id, tree, 0 AS level, pos, other AS folded, '' AS proof FROM leaf
  UNION ALL
  SELECT c.row_id, c.tree, c.level + 1, c.pos // 16, sha256(array_to_string(u.run[1:c.pos % 16], '') || c.folded || array_to_string(u.run[c.pos % 16 + 2:], '')),
         c.proof || array_to_string(u.run[1:c.pos % 16], '') || array_to_string(u.run[c.pos % 16 + 2:], '')
  FROM climb c JOIN up u ON u.tree = c.tree AND u.level = c.level + 1 AND u.pos = c.pos // 16
), half AS (
  SELECT c.*, s.hash AS subroot, s.pos AS place FROM climb c JOIN up u ON u.tree = c.tree AND u.level = c.level AND u.n = 1 JOIN subroot s ON s.tree = c.tree
), rise AS (
  SELECT row_id, 0 AS level, place AS pos, folded, proof, subroot FROM half
  UNION ALL
  SELECT c.row_id, c.level + 1, c.pos // 16, sha256(array_to_string(u.run[1:c.pos % 16], '') || c.folded || array_to_string(u.run[c.pos % 16 + 2:], '')),
         c.proof || array_to_string(u.run[1:c.pos % 16], '') || array_to_string(u.run[c.pos % 16 + 2:], ''), c.subroot
  FROM rise c JOIN over_sources u ON u.level = c.level + 1 AND u.pos = c.pos // 16
)
SELECT l.doc_id, l.leaf, r.subroot, o.hash AS root, sha256(r.proof) AS proof_sha256, r.folded AS folded_root, r.folded = o.hash AS verified
FROM rise r JOIN over_sources o ON o.n = 1 AND o.level = r.level JOIN leaf l USING (row_id)
"""
