"""SimHash near-duplicates: fingerprints, a binary-trie self-join for links, and components of the links.

Rows: null, empty and blank texts have fingerprint zero and are linked like any others. Repeated rows share a fingerprint
and a component. A null doc_id counts for no minimum; a component of such rows only has a null component_id. Texts are read
whole, whatever their length. Columns other than doc_id and text are carried along by the stage, whatever their names, and
ignored otherwise; an empty table gives an empty result.

The stage takes shingles of five words and links texts whose sets of them are SIMILAR or more alike (Jaccard). One fingerprint links but a part of
these, so the trie join gives some of the groups that are looked at, and BANDS of smallest hashes give the others. Of all texts that share a band, or whose
fingerprints are joined, each two that are not joined by other links are compared. No pair is a link before its sets are compared, and no text is dropped that is not so alike to a linked one; the README has the share of pairs that are found. Texts without words are alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import HOT_SHARE, ROW_KEY, follow, join_groups, one_of_each, row_key
from corpusloom.sources.scratch import written

SHINGLE = 4
SEED = 42
BITS = 64
BUDGET = 4
#: Words in a shingle of the stage, and the least similarity of linked texts.
STAGE_SHINGLE, SIMILAR = 5, 0.8
#: Bands of a text and smallest hashes in each, and what mixes the hashes for them; a mixing has two halves.
BANDS, MINIMA = 16, 6
SALTS = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * MINIMA // 2, dtype=np.uint64)
#: Texts that are compared with one other in a group, about; pairs in a group; and keys that are broadcast at most.
SLICE, DEAL_PAIRS, KEYS_SENT = 256, 4000, 500_000
#: Distinct fingerprints in one group of the trie join, about, and the least number of groups for a block of bits.
GROUP_ROWS = 50_000
LEAST_GROUPS = 16
#: Node pairs that are expanded at once, and the largest pair that is compared leaf by leaf.
FRONTIER = 1 << 16
LEAF_PAIRS = 64


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    wide = min(shingle, len(words))
    starts = np.r_[0, gaps + 1][: len(words) - wide + 1].tolist()
    ends = np.r_[gaps, len(joined)][wide - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), dtype=np.uint64, count=len(starts))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of shingles' hashes as a signed long."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return fingerprint_of(shingle_hashes(text, shingle))


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """A hash for each band: of the smallest of the shingles' hashes under MINIMA mixings. Sets that are s alike share a band's with a chance of s ** MINIMA."""
    least = np.full((len(SALTS), 2), 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        x = (hashes[None, at : at + (1 << 12)] ^ SALTS[:, None]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(least[:, 0], (x >> np.uint64(32)).min(axis=1), out=least[:, 0])
        np.minimum(least[:, 1], (x & np.uint64(0xFFFFFFFF)).min(axis=1), out=least[:, 1])
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in least.reshape(BANDS, MINIMA).T:
        out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, bands: bool = False) -> DataFrame:
    """(doc_id, fp, ROW_KEY) for every row of docs, with the hashes of its bands if asked for."""

    def run(batches):
        for batch in batches:
            hashes = [shingle_hashes(t, shingle) for t in batch.column(2).to_pylist()]
            columns = [batch.column(0), pa.array([fingerprint_of(h) for h in hashes], pa.int64()), batch.column(1)]
            if bands:
                columns.append(pa.array([bands_of(h) for h in hashes], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", ROW_KEY, "bands"][: len(columns)])

    text = F.col("text").cast("string")
    named = docs.select(F.col("doc_id").cast("long"), row_key(F.col("doc_id"), text).alias(ROW_KEY), text)
    return named.mapInArrow(run, f"doc_id long, fp long, {ROW_KEY} binary" + ", bands array<long>" * bands)


def _roots(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the trees that the links (a, b) connect; label holds the root of each leaf before and after."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        label = _roots(label)


def trie_forest(keys: np.ndarray, depth: int, budget: int = BUDGET, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly what pairs of keys within the error budget connect, if the first depth bits agree.

    keys: distinct unsigned longs in rising order. A node of the binary trie over them is a range of keys with a common
    prefix. Pairs of nodes are traversed together from the pairs (root, root), where the roots are the nodes at depth;
    a pair holds the number of bits in which its prefixes differ, and is dropped when that exceeds the budget. Returns
    positions (leaf, root of its tree): a spanning forest, at most one row for each key.
    """
    n = len(keys)
    label = np.arange(n)
    starts = np.flatnonzero(np.r_[True, (keys[1:] ^ keys[:-1]) >> np.uint64(bits - depth) != 0]) if n and depth else np.zeros(min(n, 1), dtype=np.int64)
    ends = np.r_[starts[1:], n].astype(np.int64)
    stack = [(depth, starts, ends, starts, ends, np.zeros(len(starts), dtype=np.int8))] if n else []
    while stack:
        d, al, ah, bl, bh, err = stack.pop()
        if len(al) > FRONTIER:
            stack.append((d, *(x[FRONTIER:] for x in (al, ah, bl, bh, err))))
            al, ah, bl, bh, err = (x[:FRONTIER] for x in (al, ah, bl, bh, err))
        small = ((ah - al) * (bh - bl) <= LEAF_PAIRS) | (d >= bits)
        if small.any():
            sa, sb, wb = al[small], bl[small], (bh - bl)[small]
            area = (ah - al)[small] * wb
            which = np.repeat(np.arange(len(area)), area)
            k = np.arange(len(which)) - np.repeat(np.cumsum(area) - area, area)
            i, j = sa[which] + k // wb[which], sb[which] + k % wb[which]
            near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            label = _hook(label, i[near], j[near])
            al, ah, bl, bh, err = (x[~small] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        bit = np.uint64(1 << (bits - 1 - d))
        low = ~np.uint64((1 << (bits - d)) - 1)
        am = np.searchsorted(keys, (keys[al] & low) | bit)
        bm = np.searchsorted(keys, (keys[bl] & low) | bit)
        same = al == bl
        children = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1), (am[~same], ah[~same], bl[~same], bm[~same], err[~same] + 1)]
        joined = [np.concatenate(x) for x in zip(*children)]
        alive = (joined[1] > joined[0]) & (joined[3] > joined[2]) & (joined[4] <= budget)
        stack.append((d + 1, *(x[alive] for x in joined)))
    leaf = np.flatnonzero(label != np.arange(n))
    return leaf, label[leaf]


def _blocks(bits: int, budget: int) -> list[tuple[int, int]]:
    """(first bit, width) of budget + 1 blocks: keys within the budget agree on one of them at least."""
    k = budget + 1
    edges = [bits * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def links(nodes: DataFrame, n_nodes: int, budget: int = BUDGET) -> DataFrame:
    """(nth, a, b): links among the distinct fingerprints of nodes (nth, fp) with one nth that join all that lie within the budget.

    Two fingerprints with at most budget differing bits agree on one of budget + 1 blocks. For each block the fingerprints
    are rotated so that the block leads; those with an equal block share a trie root. Roots are dealt out over groups of
    about GROUP_ROWS fingerprints, and each group returns a spanning forest, not all its pairs.
    """
    blocks = _blocks(BITS, budget)
    parts = max(LEAST_GROUPS, -(-n_nodes // GROUP_ROWS))

    def group(k: int, at: int, width: int):
        head = F.shiftrightunsigned("fp", BITS - at - width).bitwiseAND(F.lit((1 << width) - 1))
        return (F.col("nth").cast("long") * len(blocks) + k) * parts + F.pmod(F.xxhash64("nth", F.lit(k), head), F.lit(parts))

    # One number names fingerprint, block and part, so that a row in the shuffle is two longs.
    dealt = nodes.select("fp", F.explode(F.array(*(group(k, *block) for k, block in enumerate(blocks)))).alias("group"))

    def join(found: pa.Table) -> pa.Table:
        nth, k = divmod(found.column("group")[0].as_py() // parts, len(blocks))
        at, width = blocks[k]
        fp = found.column("fp").to_numpy().view(np.uint64)
        turned = np.sort((fp << np.uint64(at)) | (fp >> np.uint64(BITS - at)) if at else fp)
        leaf, root = trie_forest(turned, width, budget)
        back = (turned << np.uint64(BITS - at)) | (turned >> np.uint64(at)) if at else turned
        return pa.table({"nth": pa.array(np.full(len(leaf), nth), pa.int32()), "a": back[leaf].view(np.int64), "b": back[root].view(np.int64)})

    return dealt.groupBy("group").applyInArrow(join, "nth int, a long, b long").where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(v, root): for each end of an edge (a, b), the smallest end that it is connected to; roots are left out.

    Large-star and small-star steps in turn until nothing changes: each node links its larger, then its smaller neighbours
    to the smallest one. Every step is a grouped minimum and a join, so no neighbourhood is gathered in a task; nodes with
    many neighbours are broadcast there.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct(), name)

    def star(e: DataFrame, large: bool, total: int) -> DataFrame:
        near = e.select("v", "u").union(e.select(F.col("u"), F.col("v"))).toDF("x", "y") if large else e.select(F.col("v").alias("x"), F.col("u").alias("y"))
        least = near.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n")).select("x", F.least("x", "m").alias("m"), "n")
        out = join_groups(near, least, "x", "n", total)
        if large:
            out = out.where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u"))
        else:
            out = out.select(F.col("y").alias("v"), F.col("m").alias("u")).union(least.select(F.col("x").alias("v"), F.col("m").alias("u")))
        return out.where("v <> u").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("v", "u")), F.lit(0))).first())

    now = mark(edges)
    while True:
        starred = written(star(edges, True, 2 * now[0]), name)
        edges = written(star(starred, False, now[0]), name)
        before, now = now, mark(edges)
        if before == now:
            return edges.select("v", F.col("u").alias("root"))


def near_duplicates(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, fp (long) and component_id (the smallest doc_id reachable over links of fingerprints)."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "nodes")
    n_nodes, n_rows = nodes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    root_of = components(links(nodes.select(F.lit(0).alias("nth"), "fp"), n_nodes, budget).select("a", "b"))
    rooted = written(nodes.join(root_of, nodes.fp == root_of.v, "left").select("fp", "first_id", "copies", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    member = join_groups(rooted, least, "root", "n", n_nodes).select("fp", "component_id", "copies")
    return join_groups(prints, member, "fp", "copies", n_rows).select("doc_id", "fp", "component_id")


def shared_bands(prints: DataFrame) -> DataFrame:
    """(band, key, n) of texts that share a band, n of them: rows of bands that only one text has are left out.

    prints: (key, bands). Hot bands, fewer than HOT_SHARE, are named in the plan, so that their rows do not meet in one task.
    """
    spread = prints.select(F.explode("bands").alias("band"), "key")
    met = written(spread.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "bands")
    hot = met.where(F.col("n") * HOT_SHARE > BANDS * prints.count())
    named = F.col("band").isin([r["band"] for r in hot.select("band").collect()])
    return spread.where(named).join(F.broadcast(hot), "band").unionByName(spread.where(~named).join(met, "band"))


def band_pairs(shared: DataFrame) -> DataFrame:
    """(one, other) of texts that share a band: each with the one that shares most of all in that band, and with its first and last by key.

    shared: the written rows of shared_bands(). Copies of one text all meet the text that they were made from, as it shares the most bands, so no group
    is paired with itself; rest_links() compares those of a band whom these pairs leave apart.
    """
    weight = shared.groupBy("key").agg(F.sum("n").alias("weight"))
    first = shared.join(weight, "key").groupBy("band").agg(F.max_by("key", F.struct("weight", "key")).alias("most"), F.min("key").alias("least"), F.max("key").alias("last"), F.count("*").alias("n"))
    met = join_groups(shared.drop("n"), first, "band", "n", shared.count())
    return met.select(F.explode(F.array_distinct(F.array("most", "least", "last"))).alias("one"), F.col("key").alias("other")).where("one <> other").distinct()


def fingerprint_pairs(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one, other) of texts (key, fp) whose fingerprints are the same or linked by the trie join; of texts with one such the least stands for all.

    Also (g, key) of all texts whose fingerprints are joined by such links, g for each component.
    """
    nodes = written(prints.groupBy("fp").agg(F.min("key").alias("one"), F.count("*").alias("n")), "nodes")
    n_nodes, n_rows = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    same = join_groups(prints.select("fp", F.col("key").alias("other")), nodes.where("n > 1"), "fp", "n", n_rows).select("one", "other")
    found = written(links(nodes.select(F.lit(0).alias("nth"), "fp"), n_nodes).select("a", "b"), "links")
    end = lambda of, at, name: follow(of.withColumnRenamed(at, "fp"), "fp", nodes.select("fp", F.col("one").alias(name))).drop("fp")
    pairs = same.union(end(end(found, "a", "one"), "b", "other").select("one", "other")).where("one <> other")
    root_of = components(found).toDF("fp", "g")
    joined = written(nodes.select("fp", "n").join(root_of, "fp", "left").withColumn("g", F.coalesce("g", "fp")), "joined")
    several = joined.join(joined.groupBy("g").agg(F.sum("n").alias("of")).where("of > 1"), "g").select("fp", "n", "g")
    return pairs, join_groups(prints.select("fp", "key"), several, "fp", "n", n_rows).select("g", "key")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sorted sets; that of two empty ones is 1."""
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(a) and len(b) else 0
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def shingle_sets(docs: DataFrame, keys: DataFrame, shingle: int) -> DataFrame:
    """(key, shingles) of the rows of docs whose key is in keys: their distinct hashes in order, eight bytes each. Of rows with one key, one."""
    own = docs.select(row_key(F.col("doc_id"), F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    some = own.join(F.broadcast(keys) if keys.count() <= KEYS_SENT else keys, "key", "left_semi")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(shingle_hashes(t, shingle)).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["key", "shingles"])

    return some.mapInArrow(run, "key binary, shingles binary").dropDuplicates(["key"])


def alike(pairs: DataFrame, sets: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Those of the written pairs (one, other) whose sets (key, shingles) are least or more alike, as (a, b).

    The others of a text are cut into slices, each of which gets the set of that text once.
    """
    ones = pairs.groupBy("one").agg(F.count("*").alias("n")).withColumn("slices", F.ceil(F.col("n") / SLICE).cast("int"))
    ones = written(ones, "ones")
    deals = max(16, -(-pairs.count() // DEAL_PAIRS))
    sliced = join_groups(pairs, ones, "one", "n", pairs.count()).withColumn("slice", F.pmod(F.xxhash64("other"), F.col("slices")).cast("int"))
    deal = F.pmod(F.xxhash64("one", "slice"), F.lit(deals))
    others = sliced.withColumnRenamed("other", "key").join(sets, "key").select("one", F.col("key").alias("other"), "shingles", deal.alias("deal"))
    sent = ones.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumnRenamed("one", "key").join(sets, "key").withColumnRenamed("key", "one")
    sent = sent.select(F.col("one").alias("base"), F.col("shingles").alias("base_shingles"), deal.alias("base_deal"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        held = {k: np.frombuffer(s, np.uint64) for k, s in zip(right.column("base").to_pylist(), right.column("base_shingles").to_pylist())}
        rows = zip(*(left.column(c).to_pylist() for c in ("one", "other", "shingles")))
        kept = [(a, b) for a, b, s in rows if similarity(held[a], np.frombuffer(s, np.uint64)) >= least]
        return pa.table({"a": pa.array([a for a, _ in kept], pa.binary()), "b": pa.array([b for _, b in kept], pa.binary())})

    return others.groupBy("deal").cogroup(sent.groupBy("base_deal")).applyInArrow(compare, "a binary, b binary")


def cross_links(sides: list[tuple], least: float) -> list[tuple[bytes, bytes]]:
    """(root, root) of the texts of two sides, each (roots, sets), that are least or more alike, as a spanning forest of their roots.

    The sets of the second side are turned into lists of texts by shingle, from which a text's common shingles with all of them are counted at once.
    """
    (own, sets), (roots, others) = sides
    name = {r: k for k, r in enumerate(dict.fromkeys([*own, *roots]))}
    label, keys = np.arange(len(name)), list(name)
    at, other_at = np.array([name[r] for r in own]), np.array([name[r] for r in roots])
    size = np.array([len(x) for x in others])
    flat = np.concatenate(others) if len(others) else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    of, flat = np.repeat(np.arange(len(others)), size)[order], flat[order]
    out = []
    for k, x in zip(at, sets):
        low, high = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
        n = high - low
        places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        both = np.bincount(of[places], minlength=len(others))
        union = len(x) + size - both
        near = np.flatnonzero((np.where(union > 0, both / np.maximum(union, 1), 1.0) >= least) & (label[other_at] != label[k]))
        for j in other_at[near]:
            if label[j] != label[k]:
                out.append((keys[k], keys[j]))
                label[label == label[j]] = label[k]
    return out


def rest_links(groups: DataFrame, sets: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(a, b): roots that are linked by texts of one group (g, key, root) which are least or more alike, whatever pairs were looked at before.

    Texts of one root are joined already, so only groups of several roots are open. Their texts are cut into slices, those of the largest root apart, and each
    two slices of different texts meet in a task with their sets: no two slices of the largest root do, so a group of copies with few others is no square.
    """
    groups = written(groups, "groups")
    by_root = groups.groupBy("g", "root").agg(F.count("*").alias("n"))
    of = by_root.groupBy("g").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("roots")).where("roots > 1")
    cut = of.select("g", "n", F.col("top.root").alias("main"), F.ceil((F.col("n") - F.col("top.n")) / SLICE).cast("int").alias("few"), F.ceil(F.col("top.n") / SLICE).cast("int").alias("many"))
    open_ = join_groups(groups, written(cut, "open"), "g", "n", groups.count())
    hashed, is_main = F.xxhash64("key"), F.col("root") == F.col("main")
    sliced = open_.withColumn("own", F.when(is_main, F.col("few") + F.pmod(hashed, F.col("many"))).otherwise(F.pmod(hashed, F.col("few"))).cast("int"))
    meets = F.sequence(F.lit(0), F.when(is_main, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)
    cells = sliced.select("g", "key", "root", "own", F.explode(meets).alias("other"))
    cells = cells.select("g", "key", "root", "own", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"))

    def compare(found: pa.Table) -> pa.Table:
        own, first, second = (found.column(c).to_pylist() for c in ("own", "first", "second"))
        held = list(zip(own, found.column("root").to_pylist(), (np.frombuffer(s, np.uint64) for s in found.column("shingles").to_pylist())))
        sides = [([r for o, r, _ in held if o == s], [x for o, _, x in held if o == s]) for s in (first[0], second[0])]
        kept = cross_links(sides, least) if len({r for _, r, _ in held}) > 1 else []
        return pa.table({"a": pa.array([a for a, _ in kept], pa.binary()), "b": pa.array([b for _, b in kept], pa.binary())})

    return cells.join(sets, "key").groupBy("g", "first", "second").applyInArrow(compare, "a binary, b binary")


def linked(prints: DataFrame, sets_of, least: float = SIMILAR) -> DataFrame:
    """(key, root) of the written prints (key, fp, bands): root is the least key that links lead to. sets_of gives the sets of a table of keys.

    Few pairs of each group are compared first, which joins most of its texts; then all those that are not joined.
    """
    shared = written(shared_bands(prints), "shared")
    near, groups = fingerprint_pairs(prints)
    pairs = written(band_pairs(shared).union(near).distinct(), "pairs")
    groups = written(shared.select(F.col("band").alias("g"), "key").union(groups), "grouped")
    sets = written(sets_of(groups.select("key").distinct()), "sets")
    root_of = components(alike(pairs, sets, least)).withColumnRenamed("v", "key")
    rooted = written(prints.select("key").join(root_of, "key", "left").withColumn("root", F.coalesce("root", "key")), "rooted")
    again = components(rest_links(groups.join(rooted, "key"), sets, least), "rest").toDF("root", "top")
    return follow(rooted, "root", again).select("key", F.coalesce("top", "root").alias("root"))


def near_copies(docs: DataFrame, least: float = SIMILAR, shingle: int = STAGE_SHINGLE) -> DataFrame:
    """(key, doc_id, root) of the distinct rows of docs, by id and text: key is their ROW_KEY, root the least key that links lead to."""
    prints = fingerprints(docs, shingle, bands=True).withColumnRenamed(ROW_KEY, "key").dropDuplicates(["key"])
    prints = written(prints, "fingerprints")
    found = linked(prints, lambda keys: shingle_sets(docs, written(keys, "keys"), shingle), least)
    return prints.select("key", "doc_id").join(found, "key")


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with its smallest doc_id (null sorts last), and where rows share that, one of them.

    Rows are told apart by doc_id and text, so no text is lost where rows share an id.
    """
    kept = near_copies(docs).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"))
    return one_of_each(docs, F.col("text").cast("string"), kept.select(F.col("first.key").alias(ROW_KEY)))
