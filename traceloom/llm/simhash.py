"""Near-duplicate groups by SimHash, with a deletion-variant index for the Hamming search.

Fingerprints of 64 bits that differ in at most two bits are linked. Cut into two segments of 32 bits, one
segment of a linked pair differs in at most one bit, so the pair shares a *one-wildcard variant*: that segment with
one bit position left out. Each distinct fingerprint has 64 such variants (two segments, 32 positions); an equality join
brings those that share one together, and the whole fingerprints are compared (XOR): most of what meets differs elsewhere.

A variant that more than CROWD fingerprints share, as a crowd of near copies may, isn't paired up. Its members are compared
with a representative first. Those that the links so far leave apart are cut again, by the one-wildcard variants of the halves of
the other segment, of which one differs in at most one bit too; and where that is still a crowd, by the last half with two bits
left out. At most 16 fingerprints share all of that, so no pair within two bits is lost, and no group is large.

Every joined side grows with the documents, so all joins are merge joins: a side whose files are small enough for Spark to broadcast
may be many times as large in the driver's memory.

Rows that the search moves: 64 per distinct fingerprint, and twice more for those that meet another; 32 per member of a crowd
that is more than one component, 120 where that doesn't part it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from traceloom.llm.common import discard, in_arrow, stored

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Fingerprints that share a variant from which they aren't paired up but cut again.
CROWD = 64


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of one UTF-8 text: ASCII lower case, words between ASCII white space, word shingles.

    >>> fingerprint(None), fingerprint(b" \\n ")
    (0, 0)
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = len(words) - shingle + 1
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if n > 1 else [b" ".join(words)]
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of docs; fp as a signed long. Null and wordless texts have fingerprint 0."""
    out = StructType([StructField("doc_id", docs.schema[id_col].dataType), StructField("fp", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(in_arrow, run, out)


def variants(fps: DataFrame) -> DataFrame:
    """(fp, key): the 64 one-wildcard variants of the two 32-bit segments; key packs position and bits."""
    at = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("b"))
    return at.select("fp", F.expr("shiftleft(cast(b as bigint), 32) | (shiftrightunsigned(fp, 32 * (b div 32)) & 4294967295L & ~shiftleft(1L, b % 32))").alias("key"))


def merged(side: DataFrame) -> DataFrame:
    """side of a join that is never collected by the driver, however small its files are."""
    return side.hint("merge")


def sized(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows of keys that occur more than once, with size and the smallest fingerprint, least. Counts and a join: a key with many rows can be split."""
    shared = rows.groupBy(*keys).agg(F.count("*").alias("size"), F.min("fp").alias("least")).where("size > 1")
    return rows.join(merged(shared), keys)


def members(fps: DataFrame) -> DataFrame:
    """(key, fp, size, least): the one-wildcard variants that distinct fingerprints share."""
    # every row becomes 64: spread the few bytes of the fingerprints first, or few tasks make all of the index
    spread = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return sized(variants(spread), ["key"])


def candidates(fps: DataFrame) -> DataFrame:
    """(fp): the fingerprints that share a one-wildcard variant with another. fps: distinct fingerprints."""
    return members(fps).select("fp").distinct()


def near(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of fingerprints that differ in at most MAX_BITS bits."""
    return pairs.where(f"bit_count(a ^ b) <= {MAX_BITS}").select("a", "b")


def paired(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b): the near pairs among rows of equal keys; of rows with labels only those between labels."""
    label = ["label"] if "label" in rows.columns else []
    left = rows.select(*keys, F.col("fp").alias("a"), *[F.col(c).alias("la") for c in label])
    right = rows.select(*keys, F.col("fp").alias("b"), *[F.col(c).alias("lb") for c in label])
    both = left.join(merged(right), keys).where("a < b")
    return near(both.where("la <> lb") if label else both)


#: The other segment of a key's fingerprint.
_OTHER = "(shiftrightunsigned(fp, 32 - 32 * cast(shiftrightunsigned(key, 32) div 32 AS int)) & 4294967295L)"


def by_halves(rows: DataFrame) -> DataFrame:
    """rows with half: the one-wildcard variants of the two halves of the other segment."""
    at = rows.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(31))))
    return at.withColumn("half", F.expr(f"shiftleft(cast(c AS bigint), 16) | (shiftrightunsigned({_OTHER}, 16 * (c div 16)) & 65535L & ~shiftleft(1L, c % 16))")).drop("c")


def by_rest(rows: DataFrame) -> DataFrame:
    """rows with rest: the variants of the half that is left, with two positions left out."""
    at = rows.withColumn("c", F.explode(F.expr("filter(sequence(0, 255), x -> x div 16 < x % 16)")))
    bits = f"shiftrightunsigned({_OTHER}, 16 - 16 * cast(shiftrightunsigned(half, 20) AS int)) & 65535L"
    return at.withColumn("rest", F.expr(f"shiftleft(cast(c AS bigint), 16) | ({bits} & ~(shiftleft(1L, c div 16) | shiftleft(1L, c % 16)))")).drop("c")


def apart(rows: DataFrame, keys: list[str], labels: DataFrame) -> DataFrame:
    """rows with label, their component, of those keys whose rows have more than one."""
    known = rows.join(merged(labels.select(F.col("node").alias("fp"), "root")), "fp", "left").select(*rows.columns, F.coalesce("root", "fp").alias("label"))
    mixed = known.groupBy(*keys).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(*keys)
    return known.join(merged(mixed), keys, "left_semi")


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints, none twice, that connect all those within two bits."""
    held = stored(members(fps), "simhash-members")
    stars = near(held.where((F.col("size") > CROWD) & (F.col("fp") != F.col("least"))).select(F.col("least").alias("a"), F.col("fp").alias("b")))
    found = stored(paired(held.where(F.col("size") <= CROWD), ["key"]).unionAll(stars).distinct(), "simhash-pairs")
    crowd, keys = held.where(F.col("size") > CROWD).select("key", "fp"), ["key"]
    for cut, name in ((by_halves, "half"), (by_rest, "rest")):
        if crowd.isEmpty():
            break
        left = stored(apart(crowd, keys, components(found)), "simhash-apart")
        keys = [*keys, name]
        parts = stored(sized(cut(left), keys), "simhash-parts")
        few = parts if name == "rest" else parts.where(F.col("size") <= CROWD)
        stars = near(parts.where((F.col("size") > CROWD) & (F.col("fp") != F.col("least"))).select(F.col("least").alias("a"), F.col("fp").alias("b")))
        found = stored(found.unionAll(paired(few, keys)).unionAll(stars).distinct(), "simhash-pairs")
        crowd = parts.where(F.col("size") > CROWD).select(*keys, "fp")
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root): a node of each node's component, the same for all of the component. A node without edges is not in the result.

    Each round hooks every vertex to its smallest neighbour. Such a choice has no cycles but pairs that choose each
    other, of which the smaller becomes the root of a tree; pointers are doubled until all show their root, and trees
    become the vertices of the next round. A vertex with an edge is never alone in its tree, so each round at least halves
    the vertices: n nodes take at most log2(n) rounds of at most log2(n) + 1 doublings, whatever the graph's shape.
    The joins' other sides have one row per vertex, so a root with most of the rows is split by adaptive execution.
    """
    both = stored(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b"), "simhash-links")
    labels = None
    while True:
        chosen = stored(both.groupBy("a").agg(F.min("b").alias("up")), "simhash-chosen")
        other = chosen.select(F.col("a").alias("up"), F.col("up").alias("back"))
        mutual = (F.col("back") == F.col("a")) & (F.col("a") < F.col("up"))
        tree = stored(chosen.join(merged(other), "up").select(F.col("a").alias("node"), F.when(mutual, F.col("a")).otherwise(F.col("up")).alias("root")), "simhash-trees")
        discard(chosen)
        while True:
            jump = tree.select(F.col("node").alias("root"), F.col("root").alias("up"))
            after = stored(tree.join(merged(jump), "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "simhash-trees")
            settled = after.where("moved").isEmpty()
            discard(tree)
            tree = after
            if settled:
                break
        up = merged(tree.select(F.col("node").alias("at"), F.col("root").alias("up")))
        if labels is None:
            now = stored(tree.select("node", "root"), "simhash-labels")
        else:
            now = stored(labels.join(up, F.col("root") == F.col("at"), "left").select("node", F.coalesce("up", "root").alias("root")), "simhash-labels")
            discard(labels)
        labels = now
        half = both.join(up, F.col("a") == F.col("at")).select(F.col("up").alias("a"), "b")
        rest = stored(half.join(up, F.col("b") == F.col("at")).select("a", F.col("up").alias("b")).where("a <> b").distinct(), "simhash-links")
        discard(both, tree)
        both = rest
        if both.isEmpty():
            discard(both)
            return labels


def grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp, root, component_id), one row per row of docs; root tells the groups apart, also those without any id."""
    fps = stored(fingerprints(docs, id_col, text_col), "simhash-fingerprints")
    least = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(least.select("fp")))
    member = stored(least.join(merged(roots), least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-members")
    discard(least, roots)
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(merged(member.select("fp", "root").join(merged(named), "root")), "fp").select("doc_id", "fp", "root", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups: (doc_id, fp, component_id), one row per row of docs.

    component_id is the smallest doc_id reachable over links, the row's own included. Null texts, empty texts and
    texts of white space have fingerprint zero and are linked like any other; repeated rows are separate rows of one
    group; a null doc_id takes part but is never a component_id unless all of its group are null. An empty table gives
    no rows. Other columns of docs are not read, so their names can't clash.
    """
    return grouped(docs, id_col, text_col).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each near-duplicate group: the smallest doc_id, and of its texts in the group the one with the smallest hash.

    Rows that repeat both doc_id and text are one document. A group whose ids are all null keeps one of its rows.
    """
    text_hash = F.xxhash64(F.col("text").cast("string"))
    key = docs.select(F.struct("doc_id", text_hash.alias("h")).alias("key"), "text")
    rows = grouped(key, "key", "text").select("root", F.col("doc_id.doc_id").alias("id"), F.col("doc_id.h").alias("h"))
    each = rows.groupBy("root", "id", "h").agg(F.count("*").alias("n"))
    best = each.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "n")).alias("x"))
    kept = stored(best.select(F.col("x.id").alias("kept_id"), F.col("x.h").alias("kept_h"), F.col("x.n").alias("kept_n")), "simhash-kept")
    same = docs["doc_id"].eqNullSafe(kept["kept_id"]) & (text_hash == kept["kept_h"])
    if kept.where("kept_n > 1").isEmpty():
        return docs.join(merged(kept), same, "left_semi")
    once = docs.join(merged(kept.where("kept_n = 1")), same, "left_semi")
    again = docs.join(merged(kept.where("kept_n > 1")), same, "left_semi")
    again = again.select("doc_id", text_hash.alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    first = again.groupBy("doc_id", "h").agg(F.first("row").alias("row"))
    return once.unionAll(first.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
