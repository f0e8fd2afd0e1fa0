"""A Merkle manifest of rows: a content-addressed store of runs, and proofs read from it.

Every row becomes a digest. Rows of one tree stand in order; runs of ``ARITY`` digests
become one, level by level, until one is left, the tree's own root. The roots of all trees
stand in order too and become the manifest's root the same way. A store record is
(digest, children); nothing else is kept. Requests for rows descend from the root: the
base-``ARITY`` digits of a rank name the child to follow, the other children of the run are
collected, and the collected segments, reversed, lead from the row to the root.
Requests that share their first digits travel as one row, so a level has no more rows
than it has wanted nodes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators.ordering import positions
from skyledger.session import materialize

ARITY = 8
_BYTES = 32  # of one digest
_MOST_LEVELS = 22  # 8 ** 21 exceeds a long


def text_digest(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes, as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def in_hex(digests: Column) -> Column:
    """Digests, one after the other, as lowercase hexadecimal text."""
    return F.lower(F.hex(digests))


def row_digest(fields: Sequence[Column]) -> Column:
    """Digest of a row: each field as ``-`` if null, else its UTF-8 bytes, ``:`` and the value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return text_digest(F.concat(*parts))


def levels_of(rows: Column) -> Column:
    """How many times runs must be joined until one digest is left."""
    out = F.lit(0)
    for k in range(_MOST_LEVELS - 1):
        out = out + (rows > F.lit(ARITY**k)).cast("int")
    return out


@dataclass
class Manifest:
    """``rows``: the given rows with tree, rank, levels and digest. ``trees``: one row per tree, its root
    as ``subroot``. ``records``, ``top_records``: the store, one table per level above the rows or the
    trees' roots. ``root``: 32 bytes, None without rows."""

    rows: DataFrame
    trees: DataFrame
    records: list[DataFrame]
    top_records: list[DataFrame]
    root: bytes | None


def _build(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Records of each level above ``nodes`` (tree, levels, rank, digest), and the last node of each tree."""
    records, last = [], nodes.where("levels = 0")
    for level in range(1, levels + 1):
        run = F.struct((F.col("rank") % ARITY).alias("digit"), in_hex(F.col("digest")).alias("text"))
        runs = nodes.where(F.col("levels") >= level).groupBy("tree", "levels", F.floor(F.col("rank") / ARITY).alias("rank")).agg(F.array_sort(F.collect_list(run)).alias("run"))
        joined = F.array_join(F.col("run.text"), "")
        nodes = materialize(runs.select("tree", "levels", "rank", text_digest(joined).alias("digest"), F.unhex(joined).alias("children")), f"level-{level}")
        # Equal runs are one record.
        records.append(nodes.select("digest", "children"))
        last = last.unionByName(nodes.where(F.col("levels") == level).drop("children"))
    return records, last.select("tree", "digest")


def build_manifest(rows: DataFrame, tree: str, order: Sequence[str]) -> Manifest:
    """Trees over ``rows``, which need a column ``digest`` (32 bytes); one tree for each value of ``tree``.

    Rows of a tree stand by ``order``, null first; equal ones by digest, and rows equal in that too are
    copies whose places can be exchanged. Trees stand by their value's UTF-8 bytes, null first. A tree of
    one row is that row's digest. Places come from a range sort, so a tree may hold any share of the rows.
    """
    named = rows.withColumns({"_named": F.col(tree).isNotNull(), "_name": F.coalesce(F.col(tree).cast("string"), F.lit(""))})
    # The row's number spreads equal rows over the ranges of the sort.
    stored = materialize(named.withColumn("_copy", F.monotonically_increasing_id()), "rows")
    keys = ["_named", "_name"]
    ranked = positions(stored, keys, [F.col(c).asc_nulls_first() for c in order] + [F.col("digest"), F.col("_copy")], "rank").withColumn("rank", F.col("rank") - 1)
    ranked = materialize(ranked.drop("_copy"), "ranked")
    sizes = materialize(ranked.groupBy(*keys).agg(F.count("*").alias("n_rows")), "tree-sizes")
    trees = positions(sizes.withColumn("_all", F.lit(0)), ["_all"], [F.col(c) for c in keys], "tree")
    trees = materialize(trees.select(*keys, (F.col("tree") - 1).alias("tree"), "n_rows", levels_of(F.col("n_rows")).alias("levels")), "trees")
    placed = materialize(ranked.join(trees.drop("n_rows"), keys).drop(*keys), "leaves")
    records, subroots = _build(placed.select("tree", "levels", "rank", "digest"), trees.agg(F.max("levels")).first()[0] or 0)
    subroots = materialize(subroots, "subroots")
    n_trees = subroots.count()
    top = subroots.select(F.lit(0).cast("bigint").alias("tree"), levels_of(F.lit(n_trees)).alias("levels"), F.col("tree").alias("rank"), "digest")
    top_records, roots = _build(top, levels_of_count(n_trees))
    root = roots.select("digest").first()
    trees = trees.join(subroots.withColumnRenamed("digest", "subroot"), "tree")
    return Manifest(placed, materialize(trees.select("tree", "levels", "n_rows", "subroot"), "trees"), records, top_records, bytes(root[0]) if root else None)


def levels_of_count(rows: int) -> int:
    return sum(rows > ARITY**k for k in range(_MOST_LEVELS - 1))


def _segment(children: Column, digit: Column) -> Column:
    """The run's children before and after the one followed."""
    return F.struct(F.substring(children, F.lit(1), digit * _BYTES).alias("left"), F.substring(children, (digit + 1) * _BYTES + 1, F.octet_length(children)).alias("right"))


def _descend(starts: DataFrame, wanted: DataFrame, records: list[DataFrame]) -> DataFrame:
    """The lowest runs that hold ``wanted`` (tree, rank): (tree, run, children, path).

    ``starts`` (tree, levels, digest, path) are the roots to start from. One level is one join of the
    nodes at hand with the level's records and one with the nodes wanted below.
    """
    nodes = {}
    below = wanted
    for level in range(1, len(records) + 1):
        below = below.select("tree", F.floor(F.col("rank") / ARITY).alias("rank")).distinct()
        nodes[level] = below = materialize(below, f"wanted-{level}")
    at = None
    for level in range(len(records), 0, -1):
        begin = starts.where(F.col("levels") == level).select("tree", F.lit(0).cast("bigint").alias("rank"), "digest", "path")
        at = begin if at is None else at.unionByName(begin)
        opened = at.join(records[level - 1].distinct(), "digest").select("tree", F.col("rank").alias("run"), "children", "path")
        if level == 1:
            return opened
        under = nodes[level - 1].select("tree", F.col("rank").alias("child"), F.floor(F.col("rank") / ARITY).alias("run"))
        digit = (F.col("child") % ARITY).cast("int")
        step = opened.join(under, ["tree", "run"]).select(
            "tree",
            F.col("child").alias("rank"),
            F.substring(F.col("children"), digit * _BYTES + 1, F.lit(_BYTES)).alias("digest"),
            F.array_append("path", _segment(F.col("children"), digit)).alias("path"),
        )
        at = materialize(step, f"descent-{level}")
    return starts.select("tree", F.lit(0).cast("bigint").alias("run"), F.col("digest").alias("children"), "path").limit(0)


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (tree, rank and any columns) with ``subroot``, ``root`` and ``path``.

    The path leads from the row to the root: one (left, right) for each run passed, the run's other
    digests before and after the one followed, as bytes. A request for a place that does not exist has
    no row. Requests may be any share of the rows, in any number for one row.
    """
    empty = F.array().cast("array<struct<left:binary,right:binary>>")
    trees = manifest.trees
    if manifest.root is None:
        return requests.limit(0).select("*", F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast("binary").alias("root"), empty.alias("path"))
    spark = requests.sparkSession
    wanted = requests.select("tree", "rank")
    tops = manifest.trees.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("rank"))
    start = spark.range(1).select(F.lit(0).cast("bigint").alias("tree"), F.lit(len(manifest.top_records)).alias("levels"), F.lit(bytearray(manifest.root)).alias("digest"), empty.alias("path"))
    if manifest.top_records:
        runs = _descend(start, tops, manifest.top_records)
        digit = (F.col("tree") % ARITY).cast("int")
        runs = runs.select("run", F.col("children").alias("run_children"), F.col("path").alias("run_path"))
        trees = trees.withColumn("run", F.floor(F.col("tree") / ARITY)).join(runs, "run")
        trees = trees.withColumn("path", F.array_append("run_path", _segment(F.col("run_children"), digit)))
    else:
        trees = trees.withColumn("path", empty)
    trees = materialize(trees.select("tree", "levels", F.col("subroot").alias("digest"), "path"), "tree-paths")
    sub = trees.select("tree", "levels", F.col("digest").alias("subroot"), F.col("path").alias("tree_path"))
    asked = requests.withColumn("run", F.floor(F.col("rank") / ARITY)).drop("levels")
    digit = (F.col("rank") % ARITY).cast("int")
    found = _descend(trees, wanted, manifest.records).select("tree", "run", F.col("children"), "path")
    deep = asked.join(found, ["tree", "run"]).where((digit + 1) * _BYTES <= F.octet_length("children"))
    deep = deep.withColumn("path", F.array_append("path", _segment(F.col("children"), digit))).drop("children")
    deep = deep.join(sub.drop("tree_path", "levels"), "tree")
    lone = asked.where("rank = 0").join(sub.where("levels = 0").drop("levels"), "tree").withColumn("path", F.col("tree_path")).drop("tree_path")
    out = deep.unionByName(lone.select(*deep.columns))
    return out.drop("run").withColumns({"path": F.reverse("path"), "root": F.lit(bytearray(manifest.root))})


def folded(digest: Column, path: Column) -> Column:
    """The root (hexadecimal text) that a row's digest and its path give."""
    return F.aggregate(path, in_hex(digest), lambda at, s: F.sha2(F.concat(in_hex(s["left"]), at, in_hex(s["right"])).cast("binary"), 256))


def path_digest(path: Column) -> Column:
    """SHA-256 (hexadecimal text) over all digests of a path, from the row upwards, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(in_hex(s["left"]), in_hex(s["right"]))), "").cast("binary"), 256)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit_documents(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs`` by lang and doc_id, a proof for each row, and the check of a tampered copy.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root (hexadecimal text) and verified. Where 3
    divides the CRC-32 of the decimal doc_id, the copy's text has A-Z in lower case; a null doc_id or text
    stays as it is. Any column may be null; rows with equal doc_id stand by digest, and equal rows are
    leaves of their own. An empty text is a text of 0 bytes. Other columns of ``docs`` are not read. No rows, no rows.
    """
    fields = {c: F.col(c) for c in FIELDS}
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    changed = row_digest([F.when(tampered, lower_ascii(F.col("text"))) if c == "text" else fields[c] for c in FIELDS])
    rows = docs.select("doc_id", "lang", row_digest(list(fields.values())).alias("digest"), F.when(tampered, changed).alias("changed"))
    manifest = build_manifest(rows, "lang", ["doc_id"])
    proved = prove(manifest, manifest.rows)
    out = proved.select("doc_id", "digest", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("changed", "digest"), F.col("path")).alias("folded_root"))
    out = out.select("doc_id", *[in_hex(F.col(c)).alias(n) for c, n in (("digest", "leaf"), ("subroot", "subroot"), ("root", "root"))], "proof_sha256", "folded_root")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
