"""SimHash near-dedup: a binary-trie self-join of 64-bit fingerprints.

Fingerprint: words of the text with A-Z lower-cased, shingles of consecutive
words (repeats included, space-joined; fewer words than a shingle: the whole
sequence), XXH64 with a seed of each; a bit is 1 if it is set in over half of
the hashes. No words: fingerprint zero, linked like any other.

Join: fingerprints are first made distinct, so exact copies cost nothing. With
``bits`` errors allowed, the 64 bits are cut into ``bits + whole`` blocks; two
fingerprints within the distance agree on ``whole`` blocks at least. For each set
of that many blocks the trie is read with their bits first, so a node pair below
their depth is a pair (node, itself): the blocks' value is the key that Spark deals
out (``whole`` grows with the number of fingerprints, so that keys stay small; the
classes are the same). Below it a task goes through the node pairs together, level
by level, adds up the differing bits and drops a pair as soon as they exceed
``bits``. Node pairs whose leaves are already linked into one class are dropped
too, so a dense group costs about its size and gives a spanning set of links, not
all pairs. A key with more fingerprints than ``cap`` is split into salted parts;
each pair of parts is a task of its own.

Classes: repeated contraction of the links by the smallest neighbour, each
round written to the shared folder, until no link is left.

Defined results: null text counts as empty; ``representatives`` keeps one row of a class,
whether its rows share a doc_id, a text, both or neither; a null doc_id has the class of its
fingerprint; other columns are ignored; empty tables give empty tables.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import id_text, map_text, scratch_table, width

WORD_BITS = 64
FRONTIER = 1 << 18


# ---------------------------------------------------------------- fingerprints
def fingerprint(data: bytes, shingle: int, seed: int, block: int = 1 << 16) -> int:
    """The fingerprint of a text given as UTF-8 bytes."""
    import xxhash

    words = data.lower().split()  # of bytes: A-Z only; x20 and x09-x0D only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(length + 1) - 1
    start = (end - length)[: max(1, n - shingle + 1)]
    end = end[min(shingle, n) - 1:]
    one = xxhash.xxh64_intdigest
    ones = np.zeros(WORD_BITS, np.int64)
    for at in range(0, len(start), block):
        spans = zip(start[at:at + block].tolist(), end[at:at + block].tolist())
        h = np.array([one(joined[a:b], seed) for a, b in spans], dtype=np.uint64)
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(start), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row, and its columns ``more`` (longs)."""
    def step():
        def of(batch):
            fp = np.array([fingerprint(x or b"", shingle, seed) for x in batch.column(1).to_pylist()], dtype=np.uint64)
            return {"doc_id": batch.column(0), "fp": pa.array(fp.view(np.int64)), **{c: batch.column(2 + i) for i, c in enumerate(more)}}
        return of
    return map_text(id_text(docs, *more), ", ".join(["doc_id long, fp long", *(f"{c} long" for c in more)]), step)


# -------------------------------------------------------------------- the trie
def _root(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Class labels (smallest leaf) after linking the leaves a and b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        label = _root(parent)[label]


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """For sorted ``keys`` and nodes [lo, hi) that agree above ``bit``: where the bit turns 1."""
    a, b = lo.copy(), hi.copy()
    while True:
        open_ = a < b
        if not open_.any():
            return a
        mid = (a + b) // 2
        one = (keys[np.minimum(mid, len(keys) - 1)] >> bit.astype(np.uint64)) & np.uint64(1) == 1
        b = np.where(open_ & one, mid, b)
        a = np.where(open_ & ~one, mid + 1, a)


def trie_links(keys: np.ndarray, pairs: np.ndarray, depth: np.ndarray, bits: int) -> np.ndarray:
    """Class label (smallest leaf) of every leaf after the joins of node ``pairs``.

    keys: fingerprints, the leaves of a node sorted and together. pairs: rows (lo1,
    hi1, lo2, hi2) of two nodes to join (or of a node with itself) that agree on
    their first ``depth`` bits.
    """
    label = np.arange(len(keys))
    if not len(pairs):
        return label
    first = np.asarray(pairs, dtype=np.int64).T
    depth = np.asarray(depth, dtype=np.int64)
    stack = [(*first, depth, np.zeros(len(depth), np.int64))]
    while stack:
        l1, h1, l2, h2, d, err = stack.pop()
        if len(l1) > FRONTIER:
            for at in range(0, len(l1), FRONTIER):
                stack.append(tuple(x[at:at + FRONTIER] for x in (l1, h1, l2, h2, d, err)))
            continue
        # drop pairs whose leaves are all in one class
        change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        done = (change[h1 - 1] == change[l1]) & (change[h2 - 1] == change[l2]) & (label[l1] == label[l2])
        # two leaves: the remaining bits at once
        leaves = ~done & (h1 - l1 == 1) & (h2 - l2 == 1)
        if leaves.any():
            a, b = l1[leaves], l2[leaves]
            near = np.bitwise_count(keys[a] ^ keys[b]) <= bits
            label = _union(label, a[near], b[near])
        go = ~done & ~leaves & (d < WORD_BITS)
        full = ~done & ~leaves & (d >= WORD_BITS)  # equal fingerprints under one node
        if full.any():
            for x1, y1, x2, y2 in zip(l1[full], h1[full], l2[full], h2[full]):
                run = np.concatenate([np.arange(x1, y1), np.arange(x2, y2)])
                label = _union(label, run[1:], run[:-1])
        if not go.any():
            continue
        l1, h1, l2, h2, d, err = (x[go] for x in (l1, h1, l2, h2, d, err))
        bit = WORD_BITS - 1 - d
        m1, m2 = _split(keys, l1, h1, bit), _split(keys, l2, h2, bit)
        same = (l1 == l2) & (h1 == h2)
        parts = []
        for a1, b1, a2, b2, cost in ((l1, m1, l2, m2, 0), (m1, h1, m2, h2, 0), (l1, m1, m2, h2, 1), (m1, h1, l2, m2, 1)):
            ok = (a1 < b1) & (a2 < b2) & (err + cost <= bits)
            if cost and a1 is m1:
                ok &= ~same  # the mirror image of the third
            parts.append((a1[ok], b1[ok], a2[ok], b2[ok], d[ok] + 1, err[ok] + cost))
        stack.append(tuple(np.concatenate(x) for x in zip(*parts)))
    return label


def blocks(bits: int, whole: int = 1) -> list[tuple[int, int]]:
    """(first bit from the top, width) of the ``bits + whole`` blocks."""
    n = bits + whole
    cut = [round(WORD_BITS * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def block_sets(bits: int, whole: int = 1) -> list[tuple[int, ...]]:
    """The sets of ``whole`` blocks; within ``bits`` errors one set at least is untouched."""
    return list(combinations(range(bits + whole), whole))


def set_width(bits: int, whole: int) -> int:
    """The fewest bits that a set of blocks has."""
    return min(sum(blocks(bits, whole)[b][1] for b in chosen) for chosen in block_sets(bits, whole))


def blocks_for(n: int, bits: int, leaves: int = 512) -> int:
    """How many whole blocks to key by, so that ``n`` spread-out fingerprints leave about
    ``leaves`` to a key at most. Any number gives the same classes."""
    whole = 1
    while n > leaves << set_width(bits, whole) and whole < 4:
        whole += 1
    return whole


def turned(fp: np.ndarray, cuts: list[tuple[int, int]], first: tuple[int, ...]) -> np.ndarray:
    """The fingerprints with the bits of the blocks ``first`` in front."""
    out = np.zeros(len(fp), np.uint64)
    for b in (*first, *(b for b in range(len(cuts)) if b not in first)):
        start, width_ = cuts[b]
        part = (fp >> np.uint64(WORD_BITS - start - width_)) & np.uint64((1 << width_) - 1)
        out = (out << np.uint64(width_)) | part
    return out


# ------------------------------------------------------------------- the join
def join_links(keyed: DataFrame, bits: int, whole: int = 1, flush_rows: int = 1 << 17) -> DataFrame:
    """Links (a, b) that span the classes found in each task of ``keyed``
    (block, value, i, j, side, fp), which is dealt out by task and sorted by it."""
    cuts, sets = blocks(bits, whole), block_sets(bits, whole)
    widths = np.array([sum(cuts[b][1] for b in chosen) for chosen in sets], dtype=np.int64)
    names = ["block", "value", "i", "j", "side", "fp"]

    def solve(rows):
        block, value, i, j, side, fp = rows
        front = np.empty(len(fp), np.uint64)
        for k in np.unique(block).tolist():
            here = block == k
            front[here] = turned(fp[here], cuts, sets[k])
        order = np.lexsort((front, side, j, i, value, block))
        block, value, i, j, side, fp, front = (x[order] for x in (block, value, i, j, side, fp, front))
        edge = (block[1:] != block[:-1]) | (value[1:] != value[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        lo = np.concatenate([[0], np.flatnonzero(edge) + 1])
        hi = np.concatenate([lo[1:], [len(fp)]])
        ones = np.concatenate([[0], np.cumsum(side)])
        mid = hi - (ones[hi] - ones[lo])
        itself = i[lo] == j[lo]
        live = np.where(itself, hi - lo > 1, (mid > lo) & (mid < hi))
        pairs = np.stack([lo, np.where(itself, hi, mid), np.where(itself, lo, mid), hi], axis=1)[live]
        label = trie_links(front, pairs, widths[block[lo]][live], bits)
        signed = fp.view(np.int64)
        centre = np.full(len(fp), np.iinfo(np.int64).max)
        np.minimum.at(centre, label, signed)
        b = centre[label]
        linked = signed != b
        return pa.RecordBatch.from_pydict({"a": pa.array(signed[linked]), "b": pa.array(b[linked])})

    def run(batches):
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            rows = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            rows[5] = rows[5].view(np.uint64)
            held.append(rows)
            size += batch.num_rows
            if size >= flush_rows:
                rows = [np.concatenate(x) for x in zip(*held)]
                last = np.ones(size, bool)  # the last task may go on in the next batch
                for x in rows[:4]:
                    last &= x == x[-1]
                if not last.all():
                    yield solve([x[~last] for x in rows])
                held, size = [[x[last] for x in rows]], int(last.sum())
        if size:
            yield solve([np.concatenate(x) for x in zip(*held)])
    return keyed.select(*names).mapInArrow(run, "a long, b long")


BROADCAST_ROWS = 500_000


def keyed_nodes(nodes: DataFrame, bits: int, whole: int, cap: int) -> DataFrame:
    """Tasks of the join: every fingerprint under its value of each set of blocks; a value with
    over ``cap`` fingerprints in salted parts, a task for each pair of parts."""
    cuts = blocks(bits, whole)
    bits_of = [F.shiftrightunsigned(F.col("fp"), WORD_BITS - s - w).bitwiseAND(F.lit((1 << w) - 1)) for s, w in cuts]
    values = []
    for chosen in block_sets(bits, whole):
        value = bits_of[chosen[0]]
        for b in chosen[1:]:
            value = F.shiftleft(value, cuts[b][1]).bitwiseOR(bits_of[b])
        values.append(value)
    rows = nodes.select("fp", F.posexplode(F.array(*values)).alias("block", "value"))
    hot = rows.groupBy("block", "value").count().filter(F.col("count") > cap)
    hot = scratch_table(hot.select("block", "value", F.ceil(2 * F.col("count") / cap).cast("int").alias("parts")), "simhash-hot")
    # a checked size to broadcast; beyond it a shuffled join
    rows = rows.join(F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot, ["block", "value"], "left")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    tasks = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))) \
        .otherwise(F.transform(other, lambda o: F.struct(F.least(part, o).alias("i"), F.greatest(part, o).alias("j"),
                                                         (part > o).cast("int").alias("side"))))
    rows = rows.select("block", "value", "fp", F.explode(tasks).alias("t"))
    return rows.select("block", "value", "t.i", "t.j", "t.side", "fp")


def links(fps: DataFrame, bits: int = 4, cap: int = 1024, whole: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints that span the classes of each task.
    ``whole``: blocks that make up a key (default by the number of fingerprints)."""
    spark = fps.sparkSession
    nodes = scratch_table(fps.select("fp").distinct(), "simhash-nodes")
    n = nodes.count()
    whole = whole or blocks_for(n, bits)
    keyed = keyed_nodes(nodes, bits, whole, max(cap, 2 * n >> set_width(bits, whole)))
    key = ["block", "value", "i", "j"]
    dealt = keyed.repartition(width(spark), *key).sortWithinPartitions(*key)
    return join_links(dealt, bits, whole)


# ------------------------------------------------------------------- classes
def classes(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of every node with a link, by alternating
    large-star and small-star rounds over the edges."""
    def smallest(pairs):
        return scratch_table(pairs.groupBy("u").agg(F.min("v").alias("m")), "simhash-star")

    def settle(pairs):
        out = scratch_table(pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "simhash-links")
        return out, out.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges, state = settle(edges.toDF("u", "v"))
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = smallest(both).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, _ = settle(large)
        least = smallest(edges)
        small = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.toDF("u", "v"))
        edges, now = settle(small)
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def rooted(fps: DataFrame, bits: int, cap: int) -> DataFrame:
    """fp, first (smallest doc_id), root (the class) of the distinct fingerprints of ``fps``."""
    found = classes(links(fps, bits, cap))
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    return scratch_table(first.join(found, first["fp"] == found["node"], "left")
                         .select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")


def components(docs: DataFrame, shingle: int = 4, bits: int = 4, cap: int = 1024) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) of every row."""
    fps = scratch_table(fingerprints(docs, shingle), "simhash-fp")
    roots = rooted(fps, bits, cap)
    lowest = scratch_table(roots.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-lowest")
    named = scratch_table(roots.join(lowest, "root").select("fp", "component_id"), "simhash-named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


#: 128 bits of a row's doc_id and text.
ROW_KEY = ("souk_key1", "souk_key2")


def representatives(docs: DataFrame, shingle: int = 4, bits: int = 4, cap: int = 1024) -> DataFrame:
    """``docs`` with one row of each class: that with the smallest doc_id (null last), then the
    smallest hash of the text, then the smallest other columns.

    Classes are found without texts; the texts are shuffled once, to meet the chosen rows' keys.
    """
    id_ = F.col("doc_id").cast("long")
    keys = [F.xxhash64(F.coalesce(id_, F.lit(0)), id_.isNull(), "text", F.lit(n)) for n in (1, 2)]
    keyed = docs.withColumns(dict(zip(ROW_KEY, keys)))
    fps = scratch_table(fingerprints(keyed, shingle, more=ROW_KEY), "simhash-fp")
    roots = rooted(fps, bits, cap).select("fp", "root")
    best = fps.join(roots, "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *ROW_KEY)).alias("best"))
    keep = best.select(*(F.col(f"best.{k}").alias(k) for k in ROW_KEY))
    kept = keyed.join(keep, list(ROW_KEY), "left_semi")
    # rows with equal doc_id and text: they are together already, one stays
    rows = [F.struct(F.col(f"`{c}`").isNull().alias("none"), F.col(f"`{c}`").alias("value")).alias(f"c{n}") for n, c in enumerate(docs.columns)]
    one = kept.groupBy(*ROW_KEY).agg(F.min(F.struct(*rows)).alias("row"))
    return one.select(*(F.col(f"row.c{n}.value").alias(c) for n, c in enumerate(docs.columns)))
