"""Merkle manifest of a data set: leaf digests, one tree per group, one tree over the groups' roots, proofs.

Rows become leaves, leaves get positions in their tree, and every level is one equijoin of its nodes with
themselves: a node asks for its siblings at computed indices (its slot shifted by 1, 2 ... within the run; the
exclusive-or of its position with 1 in a binary tree), and the rows in slot zero, now holding the whole run,
emit the parents. Paths to the root are put together from the top down, each level joined to its parents.

Positions need no sort in one task: rows are range-partitioned, numbered inside their task, and shifted by the
sums of the (few) task totals. Digests travel as 32 bytes; they are hashed as lower-case hex text.

Defined results: a field that is null is hashed as ``-``, an empty text as ``0:``; null doc_ids come first in their
tree and are never tampered with; rows that share a doc_id are ordered by their leaf, equal rows are leaves of
their own; a lone leaf is its own subroot and a lone subroot the root; an empty table has no rows and no root;
further columns are not read.
"""
from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.session import materialise

ARITY = 8
#: Nodes of a level that one task takes, at least.
TASK_ROWS = 10_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:binary,right:binary>>"


@dataclass
class Tree:
    """Levels of all trees of a forest, leaves first, and what remains of each tree."""
    levels: list[DataFrame]  # tree, pos, n, hash, left, right; only of trees that have several nodes there
    roots: list[DataFrame]  # tree, hash of the trees that are down to one node at this level


def nothing() -> Column:
    return F.lit(b"")


def digest(parts: Column) -> Column:
    """H of concatenated digests: SHA-256 over their hex text, as 32 bytes."""
    return F.unhex(F.sha2(F.lower(F.hex(parts)), 256))


def shown(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf_of(**fields: Column) -> Column:
    """H over the fields in the order of FIELDS: ``-`` or UTF-8 length, colon and value."""
    parts = []
    for name in FIELDS:
        value = fields.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def folded_case(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos`` (0-based place in ``order`` inside its ``tree``) and ``n`` (rows of the tree).

    Rows equal in ``order`` are spread over range boundaries by a running number, so that a large group of equal
    rows is not one task.
    """
    spread = rows.withColumn("_spread", F.pmod(F.monotonically_increasing_id(), F.lit(4096)))
    ranged = spread.repartitionByRange("tree", *order, "_spread").sortWithinPartitions("tree", *order).drop("_spread")
    placed = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()), name)
    task = F.shiftright("_at", 33)
    runs = placed.groupBy("tree", task.alias("_task")).agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("tree")  # as many rows as range partitions
    before = F.sum("_rows").over(whole.orderBy("_task")) - F.col("_rows")
    runs = runs.select(F.col("tree").alias("_tree"), "_task", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    return placed.join(runs, (F.col("tree") == F.col("_tree")) & (task == F.col("_task"))).select(
        *rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")


def with_siblings(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """Nodes (tree, pos, n, hash and others) with ``left`` and ``right``: the digests of the run's others, joined."""
    slot = F.pmod("pos", F.lit(arity))
    if arity == 2:
        others = F.array(F.col("pos").bitwiseXOR(F.lit(1)))
    else:
        others = F.array(*[F.col("pos") - slot + F.pmod(slot + shift, F.lit(arity)) for shift in range(1, arity)])
    asked = nodes.select("tree", "pos", F.explode(F.filter(others, lambda x: x < F.col("n"))).alias("_sibling"))
    named = nodes.select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), F.col("hash").alias("_hash"))
    met = asked.join(named, (F.col("tree") == F.col("_tree")) & (F.col("_sibling") == F.col("_pos")))
    found = met.groupBy("tree", "pos").agg(F.array_sort(F.collect_list(F.struct(F.col("_sibling").alias("at"), F.col("_hash").alias("hash")))).alias("_all"))
    found = found.select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), "_all")

    def side(keep) -> Column:
        return F.coalesce(F.aggregate(F.filter("_all", keep), nothing(), lambda done, x: F.concat(done, x["hash"])), nothing())

    return nodes.join(found, (F.col("tree") == F.col("_tree")) & (F.col("pos") == F.col("_pos")), "left").select(
        *nodes.columns, side(lambda x: x["at"] < F.col("pos")).alias("left"), side(lambda x: x["at"] > F.col("pos")).alias("right"))


def grown(nodes: DataFrame, arity: int, name: str) -> Tree:
    """All levels over the given bottom nodes (tree, pos, n, hash and others)."""
    sizes = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("nodes"), F.count(F.lit(1)).alias("trees")).first()
    tree, most, rows = Tree([], []), sizes["most"] or 0, sizes["nodes"] or 0
    while most > 1:
        tree.roots.append(nodes.where("n = 1"))
        files = max(1, -(-rows // TASK_ROWS))  # upper levels are small: few tasks and files
        held = materialise(with_siblings(nodes.where("n > 1"), arity).coalesce(files), f"{name}-level-{len(tree.levels)}")
        tree.levels.append(held)
        nodes = held.where(F.pmod("pos", F.lit(arity)) == 0).select(
            "tree", F.expr(f"pos div {arity}").alias("pos"), F.ceil(F.col("n") / arity).cast("long").alias("n"),
            digest(F.concat("hash", "left", "right")).alias("hash"))
        most, rows = -(-most // arity), -(-rows // arity) + sizes["trees"]
    tree.roots.append(nodes.where("n = 1"))
    return tree


def remaining(tree: Tree) -> DataFrame:
    """(tree, hash): the root of each tree."""
    out = tree.roots[0].select("tree", "hash")
    for more in tree.roots[1:]:
        out = out.unionByName(more.select("tree", "hash"))
    return out


def paths(tree: Tree, above: DataFrame | None, arity: int) -> DataFrame:
    """Bottom nodes with ``path``: (left, right) of every level up to the root and on, from ``above`` (tree, path)."""
    def ended(level: int) -> DataFrame:
        roots = tree.roots[level]
        if above is None:
            return roots.withColumn("path", F.array().cast(_PATH))
        return roots.join(above.select(F.col("tree").alias("_tree"), "path"), F.col("tree") == F.col("_tree")).drop("_tree")

    found = ended(len(tree.levels))
    for level in range(len(tree.levels) - 1, -1, -1):
        parents = found.select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), F.col("path").alias("_up"))
        here = tree.levels[level]
        on = (F.col("tree") == F.col("_tree")) & (F.expr(f"pos div {arity}") == F.col("_pos"))
        step = F.array(F.struct("left", "right"))
        found = here.join(parents, on).withColumn("path", F.concat(step, "_up")).drop("_tree", "_pos", "_up", "left", "right").unionByName(ended(level))
    return found


@dataclass
class Manifest:
    leaves: DataFrame  # doc_id, tree, leaf, changed, path, subroot: one row per document
    subroots: DataFrame  # tree, hash
    root: bytes | None


def tree_key(lang: Column) -> Column:
    """Names a group's tree; orders like the group, null first."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def manifest(docs: DataFrame, changed: Column | None = None, arity: int = ARITY) -> Manifest:
    """Manifest over documents, one tree per lang. ``changed`` is a second leaf of each row, of what is held against it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree_key(F.col("lang")).alias("tree"),
                       leaf_of().alias("hash"), (leaf_of() if changed is None else changed).alias("changed"))
    bottom = numbered(rows, ["doc_id", "hash"], "manifest-leaves")
    forest = grown(bottom, arity, "manifest")
    subroots = materialise(remaining(forest), "manifest-subroots")
    tops = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang_tree"), "hash"), ["lang_tree"], "manifest-tops")
    crown = grown(tops, arity, "manifest-top")
    ends = remaining(crown).select("hash").collect()  # one row, or none over an empty table
    above = paths(crown, None, arity).select(F.col("lang_tree").alias("tree"), "path", F.col("hash").alias("subroot"))
    above = materialise(above, "manifest-crown")
    found = paths(forest, above, arity).select("doc_id", "tree", F.col("hash").alias("leaf"), "changed", "path")
    named = above.select(F.col("tree").alias("_tree"), "subroot")
    return Manifest(found.join(named, F.col("tree") == F.col("_tree")).drop("_tree"), subroots, ends[0]["hash"] if ends else None)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings on its path."""
    return F.aggregate(path, leaf, lambda done, step: digest(F.concat(step["left"], done, step["right"])))


def proof(path: Column) -> Column:
    """H of all siblings on the path, from the bottom up, left to right."""
    return digest(F.aggregate(path, nothing(), lambda done, step: F.concat(done, step["left"], step["right"])))


def tampered_leaf() -> Column:
    """Leaf of a document whose text lost its capitals A-Z, for the doc_ids whose CRC-32 is a multiple of 3; else the leaf itself."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    return F.when(hit, leaf_of(text=folded_case(F.col("text")))).otherwise(leaf_of())


def audit(docs: DataFrame, changed: Column | None = None, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified — the check of ``changed`` leaves against the manifest."""
    made = manifest(docs, tampered_leaf() if changed is None else changed, arity)
    root = F.lit(made.root).cast("binary")
    back = folded(F.col("changed"), F.col("path"))
    return made.leaves.select("doc_id", "leaf", "subroot", "path", back.alias("back")).select(
        "doc_id", shown(F.col("leaf")).alias("leaf"), shown(F.col("subroot")).alias("subroot"), shown(root).alias("root"),
        shown(proof(F.col("path"))).alias("proof_sha256"), shown(F.col("back")).alias("folded_root"), (F.col("back") == root).alias("verified"))


def _oracle(levels: int = 9, top_levels: int = 4) -> str:
    """The audit in DuckDB's SQL; trees of up to 8 ** levels leaves and 8 ** top_levels languages."""
    parts = ["""fields AS (
  SELECT doc_id, lang, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                     lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                       lambda x, unused: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM documents)""",
             """leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
         CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' ||
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'))
         ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS changed FROM fields)""",
             """placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves)""",
             "a0 AS (SELECT tree, pos, n, h FROM placed)"]

    def stack(name: str, height: int) -> None:
        for i in range(height):
            run = "OVER (PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN"
            parts.append(f"""{name}s{i} AS (
  SELECT *, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{i})""")
            parts.append(f"""{name}{i + 1} AS (
  SELECT tree, pos // 8 AS pos, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(h || l || r) ELSE h END AS h FROM {name}s{i} WHERE pos % 8 = 0)""")

    stack("a", levels)
    parts.append(f"b0 AS (SELECT '' AS tree, tree AS lang_tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, h FROM a{levels})")
    stack("b", top_levels)
    parts.append("f0 AS (SELECT p.doc_id, p.tree, p.pos, p.h AS leaf, b.h AS subroot, b.pos AS top, p.changed AS h, '' AS proof FROM placed p JOIN b0 b ON p.tree = b.lang_tree)")
    for i in range(levels + top_levels):
        at, level = ("f.pos // " + str(8 ** i), f"as{i}") if i < levels else (f"f.top // {8 ** (i - levels)}", f"bs{i - levels}")
        same = "f.tree = s.tree AND " if i < levels else ""
        parts.append(f"""f{i + 1} AS (
  SELECT f.doc_id, f.tree, f.pos, f.leaf, f.subroot, f.top, CASE WHEN s.n > 1 THEN sha256(s.l || f.h || s.r) ELSE f.h END AS h, f.proof || s.l || s.r AS proof
  FROM f{i} f JOIN {level} s ON {same}s.pos = {at})""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT f.doc_id, f.leaf, f.subroot, b.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = b.h AS verified
FROM f{levels + top_levels} f, b{top_levels} b"""


ORACLE = _oracle()
