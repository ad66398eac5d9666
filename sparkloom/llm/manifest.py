"""A Merkle manifest of a dataset, with a proof of each row, by cogrouped subtree exchange.

Rows hash to leaves where they are; from then on only digests travel. Leaves are
numbered by a range sort, so that a source of any size is spread over tasks, and
256 neighbours (two levels of the tree) form a superblock. Superblocks shrink to
one node each, again and again, until every source has its subroot; subroots form
a tree of the same kind. On the way back, nodes and the outer nodes that their
superblock needs (its siblings on every level above, up to the root) are cogrouped
by superblock: one pass over a superblock finishes its levels, joins the proofs
and folds each leaf up to the root. No task holds more than a superblock's leaves
and 15 digests a level.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered, written

FANOUT = 16
#: Levels of a superblock.
DEPTH = 2
BLOCK = FANOUT**DEPTH
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

NODES = "tree string, pos long, n long, digest string"
OUTER = "tree string, pos long, digest string, subroot string, root string, left array<string>, right array<string>"
PROVED = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels(n: int) -> int:
    """Levels from n nodes up to one."""
    found = 0
    while n > 1:
        n, found = -(-n // FANOUT), found + 1
    return found


def climb(nodes: list[str], up: int) -> list[list[str]]:
    """The nodes of each level from these up to ``up`` levels higher."""
    tower = [nodes]
    for _ in range(up):
        below = tower[-1]
        tower.append([digest("".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return tower


def siblings(tower: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands left and right of node ``at`` in its run, level by level, below the tower's top."""
    left, right = [], []
    for level in tower[:-1]:
        first = at - at % FANOUT
        left.append("".join(level[first:at]))
        right.append("".join(level[at + 1 : first + FANOUT]))
        at //= FANOUT
    return left, right


def fold(node: str, left: list[str], right: list[str]) -> str:
    """The root that a node and its siblings lead to."""
    for a, b in zip(left, right, strict=True):
        node = digest(a + node + b)
    return node


def _field(c: Column) -> Column:
    t = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """Rows (tree, doc_id, row, digest, tampered): a leaf per document; ``tampered`` where the text is changed, else null."""
    doc_id, n_chars = F.col("doc_id").cast("long"), F.col("n_chars").cast("long")
    of = lambda text: F.sha2(F.concat(_field(doc_id), _field(F.col("source")), _field(F.col("lang")), _field(n_chars), _field(text)), 256)
    changed = F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("")).alias("tree"),  # in order: null first
        doc_id.alias("doc_id"), F.monotonically_increasing_id().alias("row"), of(F.col("text")).alias("digest"),
        F.when(changed, of(F.translate("text", UPPER, UPPER.lower()))).alias("tampered"),
    )


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos``, a row's place in its tree by ``order`` (nulls first), and ``n``, the rows of the tree.

    ``order`` tells all rows apart, so that the sort can cut anywhere, inside a tree and between equal leaves too.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    sliced = numbered(cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)), "id").withColumn("slice", F.shiftright("id", 33))
    held = sliced.groupBy("tree", "slice").agg(F.min("id").alias("first"), F.count("*").alias("held"))
    by = Window.partitionBy("tree")
    held = held.select("tree", "slice", (F.sum("held").over(by.orderBy("slice")) - F.col("held") - F.col("first")).alias("shift"), F.sum("held").over(by).alias("n"))
    return sliced.join(held, ["tree", "slice"]).withColumn("pos", F.col("id") + F.col("shift")).drop("id", "slice", "shift")


def _shrink(pdf: pd.DataFrame) -> pd.DataFrame:
    """One superblock's node."""
    pdf = pdf.sort_values("pos")
    n = int(pdf["n"].iloc[0])
    top = climb(pdf["digest"].tolist(), min(DEPTH, levels(n)))[-1]
    return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "pos": [int(pdf["pos"].iloc[0]) // BLOCK], "n": [-(-n // BLOCK)], "digest": top})


def _blocks(nodes: DataFrame):
    return nodes.groupBy("tree", F.expr(f"pos div {BLOCK}").alias("pos"))


def tower_of(nodes: DataFrame) -> list[DataFrame]:
    """Nodes (tree, pos, n, digest) of each superblock level above ``nodes``; a tree is in all up to its one node."""
    tower = []
    while True:
        nodes = cut(_blocks(nodes.select("tree", "pos", "n", "digest")).applyInPandas(_shrink, NODES))
        tower.append(nodes)
        nodes = nodes.filter("n > 1")
        if nodes.isEmpty():
            return tower


def _hand_down(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """The outer nodes of each node of a superblock: its siblings inside, then what the superblock was given."""
    nodes = nodes.sort_values("pos")
    tower = climb(nodes["digest"].tolist(), min(DEPTH, levels(int(nodes["n"].iloc[0]))))
    own = [siblings(tower, i) for i in range(len(nodes))]
    up = outer.iloc[0]
    return pd.DataFrame({
        "tree": nodes["tree"].tolist(), "pos": nodes["pos"].tolist(), "digest": nodes["digest"].tolist(), "subroot": up["subroot"], "root": up["root"],
        "left": [a + list(up["left"]) for a, _ in own], "right": [b + list(up["right"]) for _, b in own],
    })


def _prove(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """The proofs of a superblock's leaves, each folded to the root from the leaf as it is now."""
    nodes = nodes.sort_values("pos")
    own = nodes["digest"].tolist()
    tower = climb(own, min(DEPTH, levels(int(nodes["n"].iloc[0]))))
    up = outer.iloc[0]
    above = list(up["left"]), list(up["right"])
    proof, folded = [], []
    for i, (leaf, now) in enumerate(zip(own, nodes["tampered"].tolist(), strict=True)):
        left, right = siblings(tower, i)
        left, right = left + above[0], right + above[1]
        proof.append(digest("".join(a + b for a, b in zip(left, right, strict=True))))
        folded.append(fold(now or leaf, left, right))
    return pd.DataFrame({"doc_id": nodes["doc_id"].tolist(), "leaf": own, "subroot": up["subroot"], "root": up["root"], "proof_sha256": proof, "folded_root": folded})


def _outer(tower: list[DataFrame], tops: DataFrame) -> DataFrame:
    """What each node of the tower's lowest level needs from outside; ``tops`` has it for the one node of each tree."""
    below = None
    for level in reversed(tower):
        given = level.filter("n = 1").select("tree", "pos", "digest").join(tops, "tree")
        if below is not None:
            many = _blocks(level.filter("n > 1"))
            given = given.unionByName(many.cogroup(below.groupBy("tree", "pos")).applyInPandas(_hand_down, OUTER))
        below = cut(given)
    return below


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    A row's leaf covers doc_id, source, lang, n_chars and text, nulls told apart
    from empty values. Leaves of a source stand by doc_id (null first), then by
    digest. folded_root comes from the leaf as it is after tampering: where 5
    divides crc32(doc_id), the text's capitals became small letters; a null doc_id
    is never tampered with, and a text without capitals gives the same leaf. Repeated
    rows are leaves of their own; a null source is a source, which comes first. An
    empty table gives no rows; other columns are not read.
    """
    rows = placed(written(leaves(docs)), ["doc_id", "digest", "row"])
    rows = cut(rows.select("tree", "pos", "n", F.col("doc_id").cast("string").alias("doc_id"), "digest", "tampered"))
    tower = tower_of(rows)
    subroots = None
    for level in tower:
        some = level.filter("n = 1").select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
        subroots = some if subroots is None else subroots.unionByName(some)
    subroots = cut(placed(subroots, ["source"]))
    upper = tower_of(subroots)
    none = F.array().cast("array<string>")
    top = upper[-1].select("tree", F.lit("").alias("subroot"), F.col("digest").alias("root"), none.alias("left"), none.alias("right"))
    over = _outer(upper, top)
    chains = cut(_blocks(subroots).cogroup(over.groupBy("tree", "pos")).applyInPandas(_hand_down, OUTER))
    tops = subroots.join(chains.select("pos", "root", "left", "right"), "pos").select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "root", "left", "right")
    proved = _blocks(rows).cogroup(_outer(tower, tops).groupBy("tree", "pos")).applyInPandas(_prove, PROVED)
    return proved.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("verified", F.col("folded_root") == F.col("root"))
