"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints of 64 bits are leaves of a binary trie.  The join walks pairs of nodes down
together: a pair carries the bits in which its two prefixes differ and is dropped as soon
as they are more than the error budget.

To share the work, the walk starts below the root.  Two fingerprints that differ in at
most ``budget`` bits agree in one of ``budget + 1`` equal blocks.  For each block the
trie with that block's bits on top is walked from the node pairs (x, x) at the block's
depth; each of these is a task of its own.  A node with more fingerprints than a limit
is first walked a few levels further by plain column expressions: its rows are dealt to
the pairs of its children that are still within the budget, until every pair is small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Saved, components, merge_roots

BITS = 64
SEED = 42


def fingerprint(raw: bytes, words: int = 3) -> int:
    """SimHash of the ``words``-word shingles of a lower-cased text, repeats included."""
    tokens = raw.split()
    if not tokens:
        return 0
    hash64 = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return hash64(b" ".join(tokens), SEED)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = (ends - [len(t) + 1 for t in tokens]).tolist()
    stops = (ends - 1).tolist()
    hashes = [hash64(joined[a:b], SEED) for a, b in zip(starts, stops[words - 1 :])]
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 65_536):
        some = np.array(hashes[k : k + 65_536], np.uint64)
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(text: str, words: int = 3) -> Column:
    """The fingerprint of a text column as a signed long; null and empty texts give 0."""

    @F.pandas_udf("long")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            marks = np.array([fingerprint(t.encode().lower(), words) if t else 0 for t in texts], np.uint64)
            yield pd.Series(marks.view(np.int64))

    return apply(F.col(text))


def trie_join(keys: np.ndarray, nodes: list[tuple[int, int, int, int, int]], depth: int, budget: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``keys`` (sorted in each range) within the budget.

    ``nodes`` are pairs (from, to, from, to, differing bits) of ranges that agree in the
    first ``depth`` bits each.  A pair of a node with itself yields each index pair once.
    At most ``most`` node pairs are open at a time on each of the remaining levels.
    """
    stack = [(depth, np.array(nodes, np.int64).reshape(-1, 5).T)]
    ones = None
    while stack:
        depth, now = stack.pop()
        if now.shape[1] > most:
            half = now.shape[1] // 2
            stack += [(depth, now[:, :half]), (depth, now[:, half:])]
            continue
        a0, a1, b0, b1, diff = now
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        i, j = a0[single], b0[single]
        near = (np.bitwise_count(keys[i] ^ keys[j]) <= budget) & (i != j)
        if near.any():
            yield i[near], j[near]
        a0, a1, b0, b1, diff = now[:, ~single]
        if not len(a0) or depth == BITS:
            if len(a0):  # equal keys: every one of one side with the first of the other
                for p, q, r, s in zip(a0, a1, b0, b1):
                    yield np.arange(p, q), np.full(q - p, r)
                    yield np.arange(r, s), np.full(s - r, p)
            continue
        bit = (keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
        ones = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = (a0 == b0) & (a1 == b1)
        other = ~own
        parts = [
            np.stack([a0, am, b0, bm, diff]),
            np.stack([am, a1, bm, b1, diff]),
            np.stack([a0, am, bm, b1, diff + 1]),
            np.stack([am[other], a1[other], b0[other], bm[other], diff[other] + 1]),
        ]
        below = np.concatenate(parts, axis=1)
        keep = (below[1] > below[0]) & (below[3] > below[2]) & (below[4] <= budget)
        keep &= ~((below[0] == below[2]) & (below[1] == below[3]) & (below[1] - below[0] == 1))
        stack.append((depth + 1, below[:, keep]))


def rotated(mark: Column, turn: Column) -> Column:
    """``mark`` with ``turn`` bits moved from its front to its end."""
    left = F.call_function("shiftleft", mark, turn)
    right = F.call_function("shiftrightunsigned", mark, F.lit(BITS) - turn)
    return F.when(turn == 0, mark).otherwise(left.bitwiseOR(right))


def near_links(marks: DataFrame, budget: int = 3, node_rows: int = 20_000, step: int = 4, saved: Saved | None = None) -> DataFrame:
    """Links ``a``, ``b`` that join all rows of ``marks`` within the budget into components.

    ``marks`` has distinct longs ``mark`` with an id ``rep``.  Links are those of a
    spanning forest of each task's pairs, so they are no more than the rows dealt out.
    """
    spark = marks.sparkSession
    blocks = budget + 1
    size = BITS // blocks
    turns = F.explode(F.array(*(F.lit(k * size) for k in range(blocks))))
    front = F.call_function("shiftrightunsigned", F.col("key"), F.lit(BITS - size))
    dealt = marks.select("rep", "mark", turns.alias("turn")).withColumn("key", rotated(F.col("mark"), F.col("turn")))
    # ``near``: the prefix of the first node, ``far``: what the second one differs in
    dealt = dealt.select("rep", "turn", "key", front.alias("near"), F.lit(0).cast("long").alias("far"), F.lit(size).alias("depth"), F.lit(False).alias("second"))
    group = ["turn", "near", "far", "depth"]
    ready: DataFrame | None = None
    while True:
        if saved is not None:
            dealt = saved(dealt)
        sizes = dealt.groupBy(*group).agg(F.count("*").alias("rows")).where((F.col("rows") > node_rows) & (F.col("depth") < BITS))
        large = sizes.drop("rows")
        if large.isEmpty():
            ready = dealt if ready is None else ready.unionByName(dealt)
            break
        small = dealt.join(large, group, "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        bits = F.call_function("shiftrightunsigned", F.col("key"), F.lit(BITS) - F.col("depth") - step).bitwiseAND(F.lit((1 << step) - 1))
        used = F.bit_count("far")
        flips = F.explode(F.array(*(F.lit(x).cast("long") for x in range(1 << step))))
        deeper = (
            dealt.join(large, group, "left_semi")
            .select("*", bits.alias("bits"), flips.alias("flip"))
            .where(used + F.bit_count("flip") <= budget)
            .withColumn("prefix", F.call_function("shiftrightunsigned", F.col("key"), F.lit(BITS) - F.col("depth") - step))
            .withColumn("far2", (F.col("far") * (1 << step)).bitwiseOR(F.col("flip")))
        )
        # a row of the first node keeps its prefix; one of the second names the first by the difference.
        # within one node the side with the smaller prefix comes first
        mate = F.col("prefix").bitwiseXOR(F.col("far2"))
        own = F.col("far") == 0
        second = F.when(own, (F.col("flip") != 0) & (F.col("prefix") > mate)).otherwise(F.col("second"))
        dealt = deeper.select("rep", "turn", "key", F.when(second, mate).otherwise(F.col("prefix")).alias("near"), F.col("far2").alias("far"), (F.col("depth") + step).alias("depth"), second.alias("second"))
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = ready.count()
    shares = max(shares, -(-rows // 250_000))
    even = ready.repartition(shares, *group)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        t = pa.Table.from_batches(parts).to_pandas()
        key = t["key"].to_numpy().view(np.uint64)
        rep = t["rep"].to_numpy()
        columns = [t["second"].to_numpy(), *(t[c].to_numpy() for c in reversed(group))]
        order = np.lexsort([key, *columns])
        key, rep = key[order], rep[order]
        second = columns[0][order]
        of = np.stack([c[order] for c in columns[1:]])
        new = np.concatenate([[True], (of[:, 1:] != of[:, :-1]).any(axis=0)])
        at = np.concatenate([np.flatnonzero(new), [len(key)]])
        cut = at[:-1] + np.add.reduceat((~second).astype(np.int64), at[:-1])
        far, depth = of[1][at[:-1]], of[0][at[:-1]]
        own = far == 0
        differ = np.bitwise_count(far.view(np.uint64)).astype(np.int64)
        nodes = np.stack([at[:-1], np.where(own, at[1:], cut), np.where(own, at[:-1], cut), at[1:], differ])
        nodes = nodes[:, (nodes[1] > nodes[0]) & (nodes[3] > nodes[2]) & (at[1:] - at[:-1] > 1)]
        depths = depth[(np.where(own, at[1:], cut) > at[:-1]) & (at[1:] > np.where(own, at[:-1], cut)) & (at[1:] - at[:-1] > 1)]
        parent = np.arange(len(key))
        for d in np.unique(depths):
            for i, j in trie_join(key, nodes[:, depths == d].T, int(d), budget):
                parent = merge_roots(parent, i, j)
        linked = np.flatnonzero(parent != np.arange(len(key)))
        if len(linked):
            yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[parent[linked]])], ["a", "b"])

    return even.mapInArrow(walk, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = 3, words: int = 3, node_rows: int = 20_000) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id; one row per row with an id.

    Equal fingerprints are one leaf, whatever the number of copies, so repeated rows and
    huge groups of copies cost one comparison.  Null and empty texts, and texts without a
    word, have fingerprint zero and are linked like any other.  Rows with a null id get
    their fingerprint and a null component and link nothing.  An empty table gives an empty
    result; other columns are not read.
    """
    saved = Saved(docs.sparkSession)
    marked = saved(docs.select(F.col(doc_id).cast("long").alias("_id"), fingerprints(text, words).alias("mark")))
    leaves = saved(marked.where("_id is not null").groupBy("mark").agg(F.min("_id").alias("rep")))
    linked = components(near_links(leaves, budget, node_rows, saved=saved), saved)
    whole = leaves.join(linked, leaves.rep == linked.node, "left").select("mark", F.coalesce("component", "rep").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("mark"), 16, "0"))
    joined = marked.join(whole, "mark", "left")
    return joined.select(F.col("_id").alias(doc_id), hexed.alias("fingerprint"), F.when(F.col("_id").isNotNull(), F.col("component_id")).alias("component_id"))
