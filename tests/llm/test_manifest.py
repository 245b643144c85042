"""Merkle manifest against a plain one, with awkward tables and other arities."""
from __future__ import annotations

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from patronage.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = ([(None, "Null Id", "en", "s", 7), (None, "Null Id", "en", "s", 7), (1, None, None, None, None), (1, "", None, "s", 0), (2, "Same", None, "s", 4), (2, "Same", None, "s", 4),
         (3, "Other", None, "t", 5), (9, "Ünï Ç:-", "dé", "s", 7), (4, "lone\nLINE", "zz", "s", 9)]
        + [(i, f"Text {i % 5} of MANY" * (i % 3), "en", f"src{i % 4}", i) for i in range(10, 180)])


def h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars) -> str:
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain(rows, arity=8):
    def runs(nodes):
        return [nodes[i:i + arity] for i in range(0, len(nodes), arity)]

    def climb(nodes):  # levels of one tree
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h("".join(run)) for run in runs(levels[-1])])
        return levels

    def path(levels, at):
        out = []
        for level in levels[:-1]:
            start = at - at % arity
            out.append((level[start:at], level[at + 1:start + arity]))
            at //= arity
        return out

    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    held = {k: sorted(trees[k], key=lambda x: x[:3]) for k in order}
    levels = {k: climb([x[2] for x in held[k]]) for k in order}
    top = climb([levels[k][-1][0] for k in order])
    for at, k in enumerate(order):
        for place, (_, _, mine, r) in enumerate(held[k]):
            steps = path(levels[k], place) + path(top, at)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            back = leaf(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:]) if hit else mine
            for left, right in steps:
                back = h("".join(left) + back + "".join(right))
            proof = h("".join("".join(left) + "".join(right) for left, right in steps))
            yield r[0], mine, levels[k][-1][0], top[-1][0], proof, back, back == top[-1][0]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("arity", [8, 3, 2])
def test_audit_equals_a_plain_tree(spark, arity):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    docs = docs.withColumn("tree", F.lit("clash")).withColumn("pos", F.lit(3)).withColumn("hash", F.lit("x"))
    assert ordered(manifest.audit(docs, arity=arity).collect()) == ordered(plain(ROWS, arity))


def test_empty_and_lone(spark):
    assert manifest.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    one = [(5, "A", "en", "s", 1)]
    assert ordered(manifest.audit(spark.createDataFrame(one, SCHEMA)).collect()) == ordered(plain(one))


def test_a_changed_row_is_found_and_only_it(spark):
    docs = spark.createDataFrame(ROWS[9:], SCHEMA)
    changed = F.when(F.col("doc_id") == 60, manifest.leaf_of(text=F.lit("forged"))).otherwise(manifest.leaf_of())
    assert [r["doc_id"] for r in manifest.audit(docs, changed).where("not verified").collect()] == [60]


def test_order_of_rows_and_partitions_do_not_matter(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    roots = {manifest.manifest(d).root for d in (docs.repartition(1), docs.repartition(7, "source"), docs.orderBy(F.desc("doc_id")))}
    assert len(roots) == 1
