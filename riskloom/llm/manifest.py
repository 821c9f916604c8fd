"""Merkle manifest of a dataset: hash trees over ordered groups of rows, with nested-interval labels.

Every node carries the interval of leaf ranks it covers. Sixteen neighbouring nodes of one level lie in one bucket, the rank of their first leaf
divided by the leaves a parent covers; a bucket's nodes are gathered once, which makes the parent. Ancestors are attached from the root down:
a parent joins what lies in its bucket and whose interval it contains, and its other children, those whose interval is not the joined one, are the siblings that a proof
needs. Nothing ever gathers more than sixteen nodes, so a group with a third of all rows is spread like any other, and texts are read once and never shuffled.

The groups' roots, in the order of the groups, are the leaves of one more tree.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import named
from riskloom.operators.joins import lookup_join
from riskloom.operators.running import running_totals, with_row_ids
from riskloom.session import materialise

FANOUT = 16
_STEPS = "array<struct<before:string,after:string>>"


def digest(parts: Column) -> Column:
    """Lowercase hex SHA-256 of an array of texts, one after the other."""
    return F.sha2(F.array_join(parts, "").cast("binary"), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    """Digest of a row: its values, encoded so that no two rows read the same."""
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


@dataclass(frozen=True)
class Tree:
    """Trees over rows (tree, size, lo, hi, digest, payload): families of every level, bottom up, and the single leaves.

    A family is a parent with its children: tree, size, bucket, lo, hi, digest, members (lo, hi, digest, payload on the lowest level).
    """

    families: list[DataFrame]
    single: DataFrame
    fanout: int

    def roots(self) -> DataFrame:
        """(tree, digest) of each tree's root."""
        found = self.single.select("tree", "digest")
        for level, family in enumerate(self.families):
            found = found.unionByName(family.filter(F.col("size") <= self.fanout ** (level + 1)).select("tree", "digest"))
        return found

    def nodes(self) -> DataFrame:
        """All nodes with their labels: tree, level (0: leaves), lo, hi (first rank covered, first one not), digest."""
        found = self.single.select("tree", F.lit(0).alias("level"), "lo", "hi", "digest")
        for level, family in enumerate(self.families):
            if level == 0:
                leaves = family.select("tree", F.explode("members").alias("m"))
                found = found.unionByName(leaves.select("tree", F.lit(0).alias("level"), "m.lo", "m.hi", "m.digest"))
            found = found.unionByName(family.select("tree", F.lit(level + 1).alias("level"), "lo", "hi", "digest"))
        return found


def build(leaves: DataFrame, fanout: int = FANOUT) -> Tree:
    """Trees over leaves (tree, size, lo, digest, payload): ``lo`` is the leaf's rank in its tree, ``size`` the tree's number of leaves.

    While a tree has several nodes, every ``fanout`` consecutive ones become their digest; the last run may be shorter, even a single node.
    """
    nodes = leaves.select("tree", "size", "lo", (F.col("lo") + 1).alias("hi"), "digest", "payload")
    single = nodes.filter("size = 1")
    most = leaves.agg(F.max("size")).first()[0] or 0
    families, covered = [], 1
    while covered < most:
        member = F.struct("lo", "hi", "digest", *(["payload"] if not families else []))
        bucket = F.floor(F.col("lo") / (covered * fanout)).cast("bigint")
        grouped = nodes.filter(F.col("size") > covered).groupBy("tree", "size", bucket.alias("bucket")).agg(F.array_sort(F.collect_list(member)).alias("members"))
        family = grouped.select(
            "tree", "size", "bucket", F.col("members")[0]["lo"].alias("lo"), F.array_max("members.hi").alias("hi"), digest(F.col("members.digest")).alias("digest"), "members"
        )
        families.append(materialise(family, f"families-{len(families)}"))
        nodes = families[-1].select("tree", "size", "lo", "hi", "digest")
        covered *= fanout
    return Tree(families, single, fanout)


def _siblings(members: str, lo: Column, hi: Column) -> Column:
    """The digests before and after an interval among those of its parent's children."""

    def joined(inside) -> Column:
        return F.array_join(F.transform(F.filter(members, inside), lambda m: m["digest"]), "")

    return F.struct(joined(lambda m: m["hi"] <= lo).alias("before"), joined(lambda m: m["lo"] >= hi).alias("after"))


def with_paths(tree: Tree, above: DataFrame) -> DataFrame:
    """Every leaf with its path: tree, digest, payload, path (its siblings level by level, up to the tree's root and on), and what ``above`` has.

    ``above`` has one row per tree: tree, path (from the tree's root on), and further columns that its leaves are to get.
    """
    more = [c for c in above.columns if c not in ("tree", "path")]
    attached = None
    for level in reversed(range(len(tree.families))):
        family = tree.families[level]
        top = family.filter(F.col("size") <= tree.fanout ** (level + 1)).join(above, "tree")
        columns = ["tree", "bucket", "lo", "hi", "members", "path", *more]
        if attached is None:
            found = top.select(*columns)
        else:
            child = family.filter(F.col("size") > tree.fanout ** (level + 1)).select("tree", "bucket", "lo", "hi", "members").alias("c")
            up = attached.alias("p")
            inside = (
                (F.col("p.tree") == F.col("c.tree"))
                & (F.col("p.bucket") == F.floor(F.col("c.bucket") / tree.fanout))
                & (F.col("p.lo") <= F.col("c.lo"))
                & (F.col("c.hi") <= F.col("p.hi"))
            )
            step = F.array(_siblings("p.members", F.col("c.lo"), F.col("c.hi"))).cast(_STEPS)
            lower = child.join(up, inside).select(
                *[f"c.{c}" for c in columns[:5]], F.concat(step, F.col("p.path")).alias("path"), *[f"p.{c}" for c in more]
            )
            found = top.select(*columns).unionByName(lower)
        attached = found if level == 0 else materialise(found, f"paths-{level}")
    alone = tree.single.join(above, "tree").select("tree", "digest", "payload", "path", *more)
    if attached is None:
        return alone
    each = attached.select("*", F.explode("members").alias("m"))
    step = F.array(_siblings("members", F.col("m.lo"), F.col("m.hi"))).cast(_STEPS)
    leaves = each.select("tree", "m.digest", "m.payload", F.concat(step, "path").alias("path"), *more)
    return leaves.unionByName(alone)


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf up, left to right."""
    return digest(F.transform(path, lambda s: F.concat(s["before"], s["after"])))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to along a path. A step that has no siblings hashes its one node."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]).cast("binary"), 256))


def proved(
    df: DataFrame, columns: Sequence[str], group: str = "source", key: str = "doc_id", altered: Column | None = None, fanout: int = FANOUT
) -> DataFrame:
    """One row per row of ``df``: key, leaf, subroot (of its group), root, proof_sha256, folded_root, verified.

    A row's leaf is the digest of the named columns. Leaves of a group ascend by key, null first, equal keys by leaf; repeated rows are leaves of
    their own. Groups are in bytewise order, null first. ``altered``, where not null, is the digest of a row's tampered content: it is folded with
    the original siblings in place of the leaf, and ``verified`` tells whether that leads to the root. Other columns play no part. Of an empty table nothing comes out.
    """
    leaves = df.select(
        named(key).alias("key"),
        named(group).alias("group"),
        leaf_digest([named(c) for c in columns]).alias("digest"),
        (F.lit(None).cast("string") if altered is None else altered).alias("altered"),
    )
    leaves = materialise(leaves, "leaves")
    sizes = leaves.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    groups = materialise(with_row_ids(sizes, [F.col("group").asc_nulls_first()], "tree"), "groups")
    ranked = running_totals(leaves, [F.col("key").asc_nulls_first(), "digest"], {"lo": F.lit(1)}, within=["group"])
    payload = F.struct("key", "altered").alias("payload")
    placed = lookup_join(ranked, groups, ["group"], "size").select("tree", "size", F.col("lo").cast("bigint").alias("lo"), "digest", payload)
    trees = build(materialise(placed, "ranked"), fanout)

    subroots = materialise(trees.roots(), "subroots")
    many = groups.count()
    over = build(
        subroots.select(F.lit(0).alias("tree"), F.lit(many).cast("bigint").alias("size"), F.col("tree").alias("lo"), "digest", F.col("tree").alias("payload")), fanout
    )
    top = over.roots().select("tree", F.expr(f"cast(array() AS {_STEPS})").alias("path"), F.col("digest").alias("root"))
    above = with_paths(over, top).select(F.col("payload").alias("tree"), "path", "root", F.col("digest").alias("subroot"))
    found = with_paths(trees, materialise(above, "above"))
    found = found.select(
        F.col("payload.key").alias(key),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        proof(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("payload.altered", "digest"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def proved_documents(df: DataFrame) -> DataFrame:
    """Proofs of all documents, of which every fifth (by the checksum of its key) is held against the manifest with its text's A-Z in lower case."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    values = [lower_ascii(named(c)) if c == "text" else named(c) for c in columns]
    tampered = F.crc32(named("doc_id").cast("string").cast("binary")) % 5 == 0
    return proved(df, columns, "source", "doc_id", F.when(tampered, leaf_digest(values)))
