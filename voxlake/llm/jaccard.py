"""Near-duplicate documents by n-gram Jaccard similarity: a MinHash LSH forest, then exact verification.

1. Documents with equal shingle sets are one text, whatever their number.
2. A text has a label in each of the forest's trees: eight minima of a byte each, as one 64-bit number, so that labels in the order of their values are the leaves of a
   prefix trie. Prefixes start as the whole label and are shortened a minimum at a time. Where texts share one, each is compared to the first of them (that which shares prefixes with most texts, so
   that it is the first in many trees) by its whole signature (256 minima), no pair twice: one
   that is about half alike is linked to it; one that is nearly the same is from now on represented by it in this tree, and its prefix isn't shortened any
   more. The others go on, down to the length at which a pair at the threshold meets in some tree with the target recall; there, the first few of each prefix are taken out, until no two are
   left. Linked texts form candidate groups: texts that share a prefix by chance, or by boilerplate, are in none.
3. Within a candidate group, all pairs of texts are verified by exact intersection counts. Groups beyond a block's bound are
   dealt as pairs of blocks. A block yields each text's number of links and a spanning forest of its links, never the pairs.
4. The forests' components are the classes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .scratch import small_batches, stored
from .textbatch import WORD_K, Shingles, U, mix, seeds, slices

SIMILARITY = 0.8
TREES = 32
DEPTH = 8
RECALL = 0.99999
#: Estimated similarity from which texts are linked as candidates, and from which one represents the other. An estimate from 256 minima has a standard error of 0.03 at most. If b is 0.8 alike to a, and a to its
#: representative r as well (0.72 at three standard errors), then b is at least 0.52 alike to r, as 1 - similarity is a metric: four standard errors above what links them.
LINKED, SAME = 0.4, 0.8
#: Rounds at the shortest prefix: in the first one text of each is compared with the others, then up to four; what is left then is linked without a comparison, which only makes groups larger.
LAST_ROUNDS = 3
#: Texts and shingles of a block, about: two blocks' shingles and intersection counts are what a task holds.
BLOCK_TEXTS = 512
BLOCK_SHINGLES = 1_000_000
#: Shingles in up to so many of a block's texts are counted pair by pair, more frequent ones by matrix products.
RARE = 24


def depth_for(similarity: float, recall: float, trees: int = TREES) -> int:
    """The prefix length at which a pair of the given similarity meets in a tree with the given recall: shortened from the full depth until it does."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def _labels(s: Shingles, docs: np.ndarray) -> np.ndarray:
    """Labels (text, tree) of the texts ``docs``, all of which have shingles."""
    out = np.zeros((len(docs), TREES), dtype=U)
    for h, a in enumerate(seeds(TREES * DEPTH, 6)):
        least = mix(np.minimum.reduceat(s.hash * a, s.off[:-1][docs]))
        tree, level = divmod(h, DEPTH)
        out[:, tree] |= (least & U(0xFF)) << U(8 * (DEPTH - 1 - level))
    return out


def _agreement(a: Column, b: Column) -> Column:
    """The similarity that two texts' labels tell: the share of equal minima, less what bytes agree by chance."""
    zeros = lambda x: sum((F.when(F.shiftrightunsigned(x, 8 * k).bitwiseAND(255) == 0, 1).otherwise(0) for k in range(DEPTH)), F.lit(0))
    equal = F.aggregate(F.transform(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), zeros), F.lit(0), lambda s, x: s + x)
    return (equal / (TREES * DEPTH) - 1 / 256) * (256 / 255)


def candidates(texts: DataFrame, similarity: float, recall: float) -> DataFrame:
    """Links (src, dst) between nodes of ``texts`` (node, labels) by the walk from whole labels to the shortest prefixes.

    No prefix's texts are gathered: the first of each is found by an aggregate and joined back, and large keys of these joins Spark can split.
    """
    shortest = depth_for(similarity, recall)
    prefix = lambda depth: F.shiftrightunsigned("label", 8 * (DEPTH - depth)) if depth < DEPTH else F.col("label")
    leaves = texts.select("node", F.posexplode("labels").alias("tree", "label"))
    shared = leaves.groupBy("tree", prefix(shortest).alias("prefix")).agg(F.count("*").alias("size")).where("size > 1")
    # texts that are alone at the shortest prefix are alone at any; the others come with the number of texts that they share one with in all trees
    met_by = leaves.withColumn("prefix", prefix(shortest)).join(shared, ["tree", "prefix"]).groupBy("node").agg(F.sum("size").alias("size"), F.collect_list(F.struct("tree", "label")).alias("own"))
    # the text that shares prefixes with most others is the first of each of its prefixes, so that trees agree on the first and a pair is compared once; ties by hash
    order = F.shiftleft(F.least("size", F.lit((1 << 31) - 1)), 32).bitwiseOR(F.xxhash64("node").bitwiseAND(F.lit((1 << 32) - 1)))
    open_ = stored(met_by.select("node", order.alias("order"), F.inline("own")), "leaves")
    links, known, depth, last = None, None, DEPTH, 0
    while True:
        at = open_.withColumn("prefix", prefix(depth))
        ends = [F.max_by("node", "order")]
        # the large groups of near copies are settled by one, so that several are compared with what is left only
        if depth == shortest and 0 < last < LAST_ROUNDS:
            ends += [F.min_by("node", "order"), F.min("node"), F.max("node")]
        first = at.groupBy("tree", "prefix").agg(F.array_distinct(F.array(*ends)).alias("firsts"), F.count("*").alias("size")).where("size > 1").drop("size")
        # the first ones are compared with each other, too, once
        is_first = F.array_contains("firsts", F.col("node"))
        others = F.when(is_first, F.filter("firsts", lambda x: x < F.col("node"))).otherwise(F.col("firsts"))
        met = stored(at.join(first, ["tree", "prefix"]).select("tree", "node", "label", "order", is_first.alias("is_first"), others.alias("firsts")).where(F.size("firsts") > 0), "met")
        pairs = met.select("node", F.explode("firsts").alias("dst")).distinct()
        if met.isEmpty():
            if depth == shortest:
                break
            depth -= 1
            continue
        if depth == shortest and last == LAST_ROUNDS:
            found = pairs.select("node", "dst", F.lit(1.0).alias("alike"))
        else:
            new = pairs if known is None else pairs.join(known, ["node", "dst"], "left_anti")
            a, b = texts.select("node", F.col("labels").alias("own")), texts.select(F.col("node").alias("dst"), F.col("labels").alias("other"))
            found = new.join(a, "node").join(b, "dst").select("node", "dst", _agreement(F.col("own"), F.col("other")).alias("alike"))
        found = stored(found, "alike")
        known = found if known is None else known.unionAll(found)
        own = found.where(F.col("alike") >= LINKED).select(F.col("node").alias("src"), "dst")
        links = own if links is None else links.unionAll(own)
        # at most a first few of each tree and round
        same = known.where(F.col("alike") >= SAME).groupBy("node").agg(F.collect_set("dst").alias("same"))
        represented = F.coalesce(F.arrays_overlap("firsts", "same"), F.lit(False))
        if depth > shortest:
            open_ = stored(open_.join(met.join(same, "node").where(represented).select("tree", "node"), ["tree", "node"], "left_anti"), "leaves")
            depth -= 1
        elif last == LAST_ROUNDS:
            break
        else:  # the first of each prefix have been compared with all others, and a text that met none is alone
            open_ = stored(met.where(~F.col("is_first")).join(same, "node", "left").where(~represented).select("node", "order", "tree", "label"), "leaves")
            last += 1
    return links.distinct() if links is not None else texts.sparkSession.createDataFrame([], "src long, dst long")


def _lookup() -> Column:
    """A document's id and a hash of its text, as text, so that rows which share an id but not the text don't meet."""
    return F.concat_ws("~", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64(F.coalesce("text", F.lit("")))))


def sketched(docs: DataFrame, k: int = WORD_K) -> DataFrame:
    """doc_id, lookup, digest (of the shingle set; null without shingles), n_shingles (distinct), labels."""

    small_batches(docs.sparkSession)

    def sketch(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s = Shingles(part.column("text"), k)
                n = np.diff(s.off)
                some = np.flatnonzero(n)
                digest, size, labels = [None] * len(part), np.zeros(len(part), dtype=np.int64), [None] * len(part)
                if len(some):
                    for d, row in zip(some.tolist(), _labels(s, some).view(np.int64), strict=True):
                        own = np.unique(s.hash[s.off[d] : s.off[d + 1]])
                        digest[d], size[d], labels[d] = hashlib.blake2b(own.tobytes(), digest_size=16).digest(), len(own), row
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lookup"), pa.array(digest, pa.binary()), pa.array(size), pa.array(labels, pa.list_(pa.int64()))], ["doc_id", "lookup", "digest", "n_shingles", "labels"])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.withColumn("lookup", _lookup()).mapInArrow(sketch, "doc_id long, lookup string, digest binary, n_shingles long, labels array<long>")


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets."""
    n = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    df = np.diff(np.concatenate([first, [len(values)]]))
    out = np.zeros(n * n, dtype=np.float64)
    for d in range(2, RARE + 1):
        at = first[df == d]
        if len(at):
            members = owner[at[:, None] + np.arange(d)]  # each row rises: owners of a value come in order
            for i in range(d):
                for j in range(i + 1, d):
                    if len(at) * 8 < n * n:
                        np.add.at(out, members[:, i] * n + members[:, j], 1)
                    else:
                        out += np.bincount(members[:, i] * n + members[:, j], minlength=n * n)
    out = out.reshape(n, n)
    out += out.T
    common = np.flatnonzero(df > RARE)
    width = max(1, (1 << 24) // n)
    for a in range(0, len(common), width):
        part = common[a : a + width]
        x = np.zeros((n, len(part)), dtype=np.float32)
        size = df[part]
        at = np.repeat(first[part] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        x[owner[at], np.repeat(np.arange(len(part)), size)] = 1
        out += x @ x.T
    return out


def _verify(key, group: pa.Table, similarity: float) -> pa.Table:
    """node, links (documents), root of the spanning forest, for the texts of one pair of blocks."""
    node = group["node"].to_numpy()
    _, keep = np.unique(node, return_index=True)  # a document may be listed twice
    node, block, weight = node[keep], group["block"].to_numpy()[keep], group["n"].to_numpy()[keep]
    raw = group["shingles"].to_pylist()
    sets = [np.frombuffer(raw[i], dtype=U) for i in keep.tolist()]
    a, b = key[1].as_py(), key[2].as_py()
    shared, size = _intersections(sets), np.array([len(x) for x in sets], dtype=np.float64)
    near = shared / (size[:, None] + size[None, :] - shared) >= similarity
    np.fill_diagonal(near, False)
    if a != b:  # pairs within a block are that block's own
        near &= block[:, None] != block[None, :]
    root = np.full(len(node), -1)
    for i in range(len(node)):
        if root[i] < 0:
            root[i], wave = i, np.array([i])
            while len(wave):
                wave = np.flatnonzero(near[wave].any(axis=0) & (root < 0))
                root[wave] = i
    return pa.table({"node": node, "links": (near @ weight.astype(np.float64)).astype(np.int64), "root": node[root]})


def classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, k: int = WORD_K) -> tuple[DataFrame, DataFrame]:
    """The sketches' (doc_id, lookup, digest) and the texts' (digest, n, node, root, class_id, links) tables."""
    rows = stored(sketched(docs, k), "sketches")
    texts = rows.where("digest is not null").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "lookup")).alias("first"), F.count("*").alias("n"), F.first("labels").alias("labels"), F.first("n_shingles").alias("n_shingles"))
    texts = stored(texts.select("digest", F.col("first.doc_id").alias("doc_id"), F.col("first.lookup").alias("lookup"), "n", "labels", "n_shingles", F.monotonically_increasing_id().alias("node")), "texts")
    links = candidates(texts, similarity, recall)
    groups = stored(components(links), "groups")
    member = texts.drop("labels", "doc_id").join(groups, "node")
    bounds = member.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    member = member.join(bounds, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    chosen = member.select("lookup", "digest", "node", "n", "root", "block", "blocks")
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("lookup", _lookup()).select("lookup", "text").join(chosen, "lookup")

    def gather(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s = Shingles(part.column("text"), k)
                sets = [np.unique(s.hash[s.off[d] : s.off[d + 1]]).tobytes() for d in range(len(part))]
                same = [hashlib.blake2b(x, digest_size=16).digest() == want for x, want in zip(sets, part.column("digest").to_pylist(), strict=True)]
                names = ["node", "n", "root", "block", "blocks"]
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), pa.array(sets, pa.binary())], [*names, "shingles"]).filter(pa.array(same, pa.bool_()))

    sets = found.select("text", "digest", "node", "n", "root", "block", "blocks").mapInArrow(gather, "node long, n long, root long, block int, blocks int, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.withColumn("other", other).select("node", "n", "root", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "shingles")
    verified = dealt.groupBy("root", "a", "b").applyInArrow(lambda key, group: _verify(key, group, similarity), "node long, links long, root long")
    verified = stored(verified, "verified")
    roots = components(verified.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    counts = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = texts.select("digest", "doc_id", "n", "node").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min("digest").alias("kept_digest"))
    known = known.join(least, "root").select("digest", "n", "node", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), (F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("leads"), "kept_digest")
    return rows.select("doc_id", "lookup", "digest"), known


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, k: int = WORD_K) -> DataFrame:
    """doc_id, class_id, n_links for every row of ``docs`` (doc_id, text).

    Two documents are linked if their sets of k-word shingles (lower case, punctuation dropped) have a Jaccard similarity of at least ``similarity``;
    n_links counts a row's linked rows, copies included. A class is a connected component of links, named by its least doc_id.
    A text of fewer than k words has one shingle, of all its words. Null, empty and wordless texts are linked to nothing and are classes of their own.
    Rows without an id take part (their class may have the id of another, or none). Repeated rows are copies of each other. Other columns are ignored.
    """
    rows, known = classes(docs, similarity, recall, k)
    out = rows.join(known.select("digest", "class_id", "links"), "digest", "left")
    alone = F.col("digest").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, k: int = WORD_K) -> DataFrame:
    """The rows of ``docs``, all columns, with one of each class: that with the least doc_id (null last; of equal rows any one). Rows without shingles all stay."""
    rows, known = classes(docs, similarity, recall, k)
    # of each class one text: that of the least id, or of the least digest if several have it or none has one
    texts = known.groupBy("root").agg(F.coalesce(F.min(F.when(F.col("leads"), F.col("digest"))), F.min("kept_digest")).alias("digest"))
    times = rows.where("digest is not null").join(texts, "digest").groupBy("digest", "doc_id", "lookup").agg(F.count("*").alias("times"))
    chosen = times.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "lookup", "times")).alias("first"))
    chosen = stored(chosen.select("digest", F.col("first.lookup").alias("lookup"), F.col("first.times").alias("times")), "chosen")

    def digest(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s = Shingles(part.column("text"), k)
                sets = [np.unique(s.hash[a:b]).tobytes() for a, b in zip(s.off[:-1].tolist(), s.off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("lookup"), pa.array([hashlib.blake2b(x, digest_size=16).digest() if x else None for x in sets], pa.binary())], ["row", "lookup", "digest"])

    text = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id")).withColumn("lookup", _lookup()).select("row", "text", "lookup")
    schema = T.StructType([text.schema["row"], text.schema["lookup"], T.StructField("digest", T.BinaryType())])
    joined = text.mapInArrow(digest, schema).join(chosen, ["digest", "lookup"], "left")
    kept = joined.where("digest is null or times = 1")
    if not chosen.where("times > 1").isEmpty():  # one of several rows of one id and one text
        kept = kept.unionByName(joined.where("times > 1").dropDuplicates(["digest"]))
    return kept.select("row.*")
