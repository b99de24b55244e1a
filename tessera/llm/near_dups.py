"""Jaccard self-join of documents on word shingles: a MinHash LSH forest and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import packed, stash
from tessera.llm.graph import components
from tessera.llm.idfilter import may_hold
from tessera.llm.wordcodes import U, arrow_rows, batched, mix, release, runs_of, windows, word_codes

TREES, DEPTH = 20, 6
#: Shingles of a block of texts, where a text counts as LEAST_LOAD at least: two blocks meet in a task. Blocks of a
#: trie node that meet in one group.
TILE_SHINGLES, LEAST_LOAD, NODE_BLOCKS = 300_000, 256, 64
#: One in so many trie nodes is counted to estimate what a prefix length costs.
COST_SAMPLE = 8
_SEEDS = mix(np.arange(1, TREES * DEPTH + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def shingles(codes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct codes of the runs of `width` words; a shorter text is one shingle, an empty one has none."""
    if not len(codes):
        return codes
    return np.unique(windows(codes, min(width, len(codes))))


def minhashes(found: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima, as 32 bits each."""
    least = np.full(len(_SEEDS), np.iinfo(np.uint64).max, U)
    for lo in range(0, len(found), 256):
        np.minimum(least, ((found[lo : lo + 256, None] * _SEEDS[None, :]) ^ (_SEEDS[None, :] >> U(7))).min(0), out=least)
    return (least >> U(32)).astype(np.uint32)


def _record(columns, fields: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(f.split(" ") for f in fields.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=names)


_SIGNED = "doc_id long, text_hash long, mark binary, sid long, n_shingles long, signature binary"


def _sign(width: int):
    """mark: 24 bytes that name a set of shingles; sid: 64 bits of them, its short name among candidates."""

    def run(batches):
        for held in batched(arrow_rows(batches, "doc_id", "text_hash", "text"), 2):
            codes, at, _ = word_codes([t for *_, t in held])
            rows = []
            for j, (doc, text_hash, _) in enumerate(held):
                s = shingles(codes[at[j] : at[j + 1]], width)
                mark = np.array([s.sum(dtype=U), np.bitwise_xor.reduce(mix(s)) if len(s) else 0, len(s)], U)
                sid = mix(mark[:1] + mix(mark[1:2] + mark[2:])).view(np.int64)[0]
                rows.append((doc, text_hash, mark.tobytes(), int(sid), len(s), minhashes(s).tobytes() if len(s) else b""))
            yield _record(list(zip(*rows, strict=True)), _SIGNED)

    return run


def node_keys(signatures: np.ndarray) -> np.ndarray:
    """Keys of the trie nodes on each document's path, (documents, trees, depth 1 .. DEPTH): equal keys are equal prefixes."""
    sig = signatures.reshape(-1, TREES, DEPTH).astype(U)
    key = np.broadcast_to(mix(np.arange(1, TREES + 1, dtype=U))[None, :], sig.shape[:2])
    out = np.empty(sig.shape, U)
    for d in range(DEPTH):
        key = mix(key * U(0x9E3779B97F4A7C15) + sig[:, :, d] + U(1))
        out[:, :, d] = key
    return out


def _keys_of(batches):
    """(sids, node keys) of distinct shingle sets, some at a time."""
    for b in batches:
        sids, first = np.unique(b.column("sid").to_numpy(), return_index=True)
        signatures = b.column("signature").take(pa.array(first))
        for lo in range(0, len(sids), 1000):
            raw = b"".join(signatures.slice(lo, 1000).to_pylist())
            yield sids[lo : lo + 1000], node_keys(np.frombuffer(raw, np.uint32))
    release()


def _sampled_nodes(batches):
    """Nodes of all depths from 2 on whose key falls in 1 of COST_SAMPLE: the sample that estimates what a depth costs."""
    for sids, keys in _keys_of(batches):
        for d in range(1, DEPTH):
            rows, trees = np.nonzero(keys[:, :, d] % U(COST_SAMPLE) == 0)
            yield pa.RecordBatch.from_arrays([pa.array(trees.astype(np.int32)), pa.array(np.full(len(rows), d + 1, np.int32)), pa.array(keys[rows, trees, d].view(np.int64)), pa.array(sids[rows])], names=["tree", "depth", "node", "sid"])


def choose_depths(pairs: dict[tuple[int, int], float], threshold: float, recall: float) -> list[int]:
    """The prefix length each tree is read at: all begin at DEPTH, and the prefix whose shortening adds the fewest
    candidate pairs for what it adds to the expected recall is shortened, until the recall at `threshold` is reached.

    A pair of similarity s shares a prefix of length d in one tree with probability s^d.
    """
    depths = [DEPTH] * TREES

    def miss(d: int) -> float:
        return math.log1p(-(threshold**d))

    while sum(map(miss, depths)) > math.log(1 - recall):
        def price(t: int) -> float:
            d = depths[t]
            return (pairs.get((t, d - 1), 0) - pairs.get((t, d), 0) + 1) / (miss(d) - miss(d - 1))

        open_trees = [t for t in range(TREES) if depths[t] > 1]
        if not open_trees:
            break
        best = min(open_trees, key=lambda t: (price(t), -depths[t], t))
        depths[best] -= 1
    return depths


def _members(depths: list[int]):
    """The node that each set reaches in each tree, at the prefix length of that tree."""
    at = np.array(depths) - 1

    def run(batches):
        for sids, keys in _keys_of(batches):
            own = keys[:, np.arange(TREES), at].reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.repeat(sids, TREES))], names=["node", "sid"])

    return run


def candidates(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which of the left sets share a node with which of the right ones: (left, right) of bool. Each is given by its nodes."""
    found = np.zeros((len(left), len(right)), bool)
    sides = []
    for nodes in (left, right):
        flat, owner = np.concatenate(nodes), np.repeat(np.arange(len(nodes)), [len(x) for x in nodes])
        order = np.argsort(flat, kind="stable")
        names, first = np.unique(flat[order], return_index=True)
        sides.append((names, np.split(owner[order], first[1:])))
    (names, members), (names_2, members_2) = sides
    _, at, at_2 = np.intersect1d(names, names_2, assume_unique=True, return_indices=True)
    for i, j in zip(at.tolist(), at_2.tolist(), strict=True):
        found[members[i][:, None], members_2[j][None, :]] = True
    return found


def similar(own: list[np.ndarray], other: list[np.ndarray], wanted: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each own set, which of the wanted other sets have a Jaccard similarity of `threshold` or more."""
    length = np.array([len(s) for s in other])
    for x, s in enumerate(own):
        near = np.flatnonzero(wanted[x])
        near = near[np.minimum(len(s), length[near]) >= threshold * np.maximum(len(s), length[near])]
        if not len(near):
            continue
        joined = np.concatenate([other[y] for y in near])
        place = np.minimum(np.searchsorted(s, joined), len(s) - 1)
        begin = np.concatenate(([0], np.cumsum(length[near])[:-1]))
        common = np.add.reduceat((s[place] == joined).astype(np.int64), begin)
        near = near[common >= threshold * (len(s) + length[near] - common) - 1e-9]
        if len(near):
            yield x, near


_FOUND = "kind int, a binary, b binary, links long"


def _verify(width: int, threshold: float):
    """Exact similarities of the candidates of a tile, the texts of two blocks. Out: each set's verified partners as a
    number of documents, and a spanning forest of the links inside the tile."""

    def run(batches):
        fields = ("one", "two", "block", "mark", "copies", "nodes", "text")
        for (one, two), rows in runs_of(arrow_rows(batches, *fields), 2):
            sides = []
            for block in (one, two) if one != two else (one,):
                members = sorted((r[2:] for r in rows if r[2] == block), key=lambda r: r[1])
                sets: list[np.ndarray] = []
                for held in batched(iter([(m[4],) for m in members]), 0):
                    codes, at, _ = word_codes([t for t, in held])
                    sets += [shingles(codes[at[j] : at[j + 1]], width) for j in range(len(held))]
                sides.append(([m[1] for m in members], [m[2] for m in members], [np.array(m[3], np.int64) for m in members], sets))
            (marks, copies, nodes, sets), (marks_2, copies_2, nodes_2, sets_2) = sides[0], sides[-1]
            if not marks or not marks_2:
                continue
            wanted = candidates(nodes, nodes_2)
            if one == two:
                wanted = np.triu(wanted, 1)
            names = marks if one == two else marks + marks_2
            shift = 0 if one == two else len(marks)
            links, parent, edges = np.zeros(len(names), np.int64), list(range(len(names))), []

            def root(x, parent=parent):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            size, size_2 = np.array(copies), np.array(copies_2)
            for x, near in similar(sets, sets_2, wanted, threshold):
                links[x] += size_2[near].sum()
                links[near + shift] += size[x]
                for y in (near + shift).tolist():
                    p, q = root(x), root(y)
                    if p != q:
                        parent[p] = q
                        edges.append((x, y))
            out = [(0, names[i], None, int(n)) for i, n in enumerate(links) if n] + [(1, names[x], names[y], 0) for x, y in edges]
            if out:
                yield _record(list(zip(*out, strict=True)), _FOUND)

    return run


def _block_pairs(nodes: DataFrame) -> DataFrame:
    """one, two: the distinct pairs of blocks (and each block with itself) that meet in a node, from distinct (node, block).

    A node's blocks are dealt to groups of NODE_BLOCKS, and two groups of a node meet by a key of their own, so that no
    key holds more than NODE_BLOCKS squared pairs however large the node is.
    """
    parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("node")) / NODE_BLOCKS).cast("int")
    dealt = nodes.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int"))
    left = dealt.select("node", F.col("part").alias("p"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("q"), F.col("block").alias("x"))
    right = dealt.select("node", F.explode(F.sequence(F.lit(0), F.col("part"))).alias("p"), F.col("part").alias("q"), F.col("block").alias("y"))
    return left.join(right, ["node", "p", "q"]).select(F.least("x", "y").alias("one"), F.greatest("x", "y").alias("two")).distinct()


def least_size(threshold: float) -> int:
    """Smaller sets are never that similar to another set: at best one shingle is added to all of theirs."""
    return math.ceil(threshold / (1 - threshold) - 1e-9) if threshold < 1 else 1 << 60


def similarity_links(docs: DataFrame, width: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, sets, links, edges) of the self-join.

    documents: doc_id, text_hash, mark (the name of its set of shingles). sets: mark, copies (how many documents share
    it), copy_id (the least doc_id that does) and first_hash (the text_hash of that row), n_shingles; texts without words
    have none. links: for each mark, how many documents of other sets have a Jaccard similarity of at least
    `threshold`. edges: (u, v) pairs of marks that connect exactly what the verified pairs connect.

    Everything is keyed by the set of shingles, so a doc_id may stand for several texts. The sets' signatures are the
    forest: in each of TREES trees they are the paths of a prefix trie, and a node is known by the key of its prefix. A
    pair of similarity s shares a prefix of d values with probability s^d, so which prefixes reach the recall does not
    depend on the document, only what they cost does. All prefixes begin at full depth and are shortened, the one
    first that adds the fewest candidates for the recall it adds (choose_depths), until the recall at `threshold` is
    reached; sets that then share a node of any tree are candidates.

    Candidates meet as texts. Each set gets a home, the least set in any of its nodes, and a home's sets are dealt to
    blocks of TILE_SHINGLES shingles. Two blocks that meet in any node are a tile; the tile finds the candidates itself,
    verifies each on the shingles, and returns numbers and a forest, so pairs are never rows. Only texts that have a
    candidate leave the scan, but for the false alarms of a Bloom filter of bounded size; they are shuffled by document
    once and then by tile. Nothing is capped.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id IS NOT NULL").withColumn("text_hash", F.xxhash64("text"))
    signed = stash(ids.mapInArrow(_sign(width), _SIGNED), "signatures")
    n = signed.count()
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    sets = signed.filter("n_shingles > 0").groupBy("mark", "sid", "n_shingles").agg(first, F.count(F.lit(1)).alias("copies"))
    sets = stash(sets.select("mark", "sid", "n_shingles", "copies", F.col("first.doc_id").alias("copy_id"), F.col("first.text_hash").alias("first_hash")), "sets", n)

    paths = signed.filter(F.col("n_shingles") >= least_size(threshold)).select("sid", "signature")
    sampled = paths.mapInArrow(_sampled_nodes, "tree int, depth int, node long, sid long").distinct().groupBy("tree", "depth", "node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    costs = sampled.groupBy("tree", "depth").agg((F.sum(F.col("n").cast("double") * (F.col("n") - 1)) * COST_SAMPLE / 2).alias("pairs")).collect()
    depths = choose_depths({(r["tree"], r["depth"]): r["pairs"] for r in costs}, threshold, recall)

    members = paths.mapInArrow(_members(depths), "node long, sid long")
    nodes = stash(members.groupBy("node").agg(F.min("sid").alias("least"), F.max("sid").alias("most")).filter("least < most").select("node", "least"), "nodes", 4 * n)
    crowd = stash(members.join(nodes.hint("merge"), "node"), "members", 8 * n)
    homes = crowd.groupBy("sid").agg(F.min("least").alias("home"), F.collect_set("node").alias("nodes"))
    placed = stash(sets.join(homes, "sid"), "candidates", 4 * n)
    load = F.sum(F.greatest(F.col("n_shingles"), F.lit(LEAST_LOAD)))
    parts = stash(placed.groupBy("home").agg(F.ceil(load / TILE_SHINGLES).cast("long").alias("parts")), "home-sizes", n)
    placed = placed.join(parts, "home").withColumn("block", F.xxhash64("home", F.pmod(F.xxhash64("sid"), F.col("parts"))))
    placed = stash(placed.select("mark", "sid", F.col("copy_id").alias("doc_id"), F.col("first_hash").alias("text_hash"), "copies", "nodes", "block"), "blocks", 4 * n)

    meets = _block_pairs(stash(crowd.join(placed.select("sid", "block"), "sid").select("node", "block").distinct(), "node-blocks", 4 * n))
    meets = meets.withColumn("block", F.explode(F.array_distinct(F.array("one", "two"))))
    visits = placed.join(meets, "block").drop("sid")
    some = ids.filter(may_hold(placed.select("doc_id").distinct(), "doc_id")).dropDuplicates(["doc_id", "text_hash"])
    tiled = visits.hint("merge").join(some, ["doc_id", "text_hash"]).select("one", "two", "block", "mark", "copies", "nodes", "text")
    tiled = tiled.repartition("one", "two").sortWithinPartitions("one", "two")
    found = stash(tiled.mapInArrow(_verify(width, threshold), _FOUND), "links")
    links = found.filter("kind = 0").groupBy(F.col("a").alias("mark")).agg(F.sum("links").alias("links"))
    edges = found.filter("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return signed.select("doc_id", "text_hash", "mark"), sets, links, edges


def similarity_classes(docs: DataFrame, width: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row per document: doc_id, text_hash, class_id, copy_id, n_links as `near_duplicates` says, and `first`: whether
    the row is the one that stands for its class."""
    documents, sets, links, edges = similarity_links(docs, width, threshold, recall)
    n = sets.count()
    named = stash(components(edges, n).withColumnRenamed("node", "mark").join(sets.select("mark", "copy_id"), "mark"), "named", n)
    least = stash(named.groupBy("component").agg(F.min(F.struct("copy_id", "mark")).alias("least")), "class-names", n)
    classes = named.join(least, "component").select("mark", F.col("least.copy_id").alias("class_id"), F.col("least.mark").alias("class_mark")).join(links, "mark")
    facts = stash(sets.join(classes, "mark", "left"), "classes", n)  # written: the join with hot copies can then be split
    own = (F.col("doc_id") == F.col("copy_id")) & (F.col("text_hash") == F.col("first_hash")) & (F.col("mark") == F.coalesce("class_mark", "mark"))
    return documents.join(facts, "mark", "left").select(
        "doc_id", "text_hash", F.coalesce("class_id", "copy_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), (F.col("copy_id").isNull() | own).alias("first"))


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row per document: doc_id, class_id, copy_id, n_links.

    class_id is the least doc_id among the texts that this one is connected with by links of at least `threshold`,
    copy_id the least one with the same set of shingles; n_links counts the other documents that it is linked with
    itself, copies too. Words are runs without ASCII white space, unchanged; a text of fewer than `width` words is one
    shingle; a text without words (null, empty) is linked with nothing. Rows without doc_id are left out; of rows that
    repeat a doc_id with other texts, each is reported with the links of its own text, and rows that repeat both are
    copies of each other. Other columns are not read. An empty table gives an empty result.
    """
    return similarity_classes(docs, width, threshold, recall).drop("text_hash", "first")


def drop_near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents with one of each class, all columns as they were: the row with the class's least doc_id stays.

    Texts without words and rows without doc_id stay. Rows are known by doc_id and text, so of a doc_id with several
    texts each goes or stays by itself, and rows that repeat both go or stay together. Columns of any name pass
    through. An empty table gives an empty result. Only rows that may go are shuffled: the others pass a Bloom filter
    of bounded size.
    """
    lost = stash(similarity_classes(docs, width, threshold).filter("NOT first").select(F.col("doc_id").alias("lost"), "text_hash").distinct(), "near", docs.count())
    rows = packed(docs, id=F.col("doc_id").cast("long"))
    may_go = may_hold(lost.select("lost").distinct(), "id")
    named = rows.filter(may_go).withColumn("hash", F.xxhash64(F.coalesce(F.col("row.text"), F.lit(""))))
    stay = named.join(lost.hint("merge"), (F.col("id") == F.col("lost")) & (F.col("hash") == F.col("text_hash")), "left_anti")
    return rows.filter(~may_go).select("row.*").unionByName(stay.select("row.*"))
