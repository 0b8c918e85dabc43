"""Near-duplicate embeddings by NN-descent.

A neighbour graph starts from blocks of vectors that lie together in the order of random
projections.  Each round every vector's neighbours, in both directions, are compared with
each other, at least one of the two being new; what is nearer than a list's last entry
replaces it.  A list whose entries are all links is saturated and doubles.  Links above
the threshold join vectors to components; inside a component every pair is then
compared exactly, in blocks, so lists of any size give exact counts of links.  Sampled
vectors compared with all others audit the recall; while it is too low, more blocks and
rounds follow, at last the exact comparison of all pairs.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Saved, components, merge_roots

log = logging.getLogger(__name__)

BLOCK = 256
EDGE = "v long, u long, sim double"


def units(vectors: pd.Series) -> np.ndarray:
    """Rows of doubles of length 1; all vectors have one dimension.

    The last byte of a packed vector says whether it holds floats or doubles.  Rows are scaled before they are squared, so
    that neither large nor small ones are lost.
    """
    vectors = list(vectors)
    if not vectors:
        return np.zeros((0, 0))
    kind = np.float64 if vectors[0][-1:] == b"d" else np.float32
    x = np.frombuffer(b"".join(v[:-1] for v in vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal keys in sorted columns."""
    n = len(keys[0])
    if not n:
        return []
    new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    cuts = [0, *new.tolist(), n]
    return list(zip(cuts[:-1], cuts[1:]))


def packed(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """_id, dim, vec (bytes of the column's own precision) of the rows that can have a link."""
    kind = np.float32 if rows.schema[embedding].dataType.elementType.typeName() == "float" else np.float64
    mark = b"f" if kind is np.float32 else b"d"

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            vectors = [np.asarray(v, kind) + kind(0) for v in t["_v"]]
            yield pd.DataFrame({"_id": t["_id"], "dim": [len(x) for x in vectors], "vec": [x.tobytes() + mark for x in vectors]})

    good = rows.where(F.col(vec_id).isNotNull() & usable(embedding))
    return good.select(F.col(vec_id).cast("long").alias("_id"), F.col(embedding).alias("_v")).mapInPandas(pack, "_id long, dim int, vec binary")


def nearest_in_blocks(vectors: DataFrame, tables: int, k: int, seed: int) -> DataFrame:
    """The ``k`` nearest of each vector in its block, for each of ``tables`` projections.

    Rows are ordered by the signs of random projections, then by one more projection, and the
    order is cut into blocks of fixed size; thus a hot region is many blocks.
    """
    spark = vectors.sparkSession

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for dim, part in t.groupby("dim"):
                x = units(part["vec"])
                for table in range(tables):
                    rng = np.random.default_rng([seed, table, dim])
                    p = x @ rng.standard_normal((dim, 25))
                    signs = (p[:, :24] > 0) @ (1 << np.arange(23, -1, -1))
                    yield pd.DataFrame({"dim": part["dim"], "table": table, "signs": signs, "tie": p[:, 24], "v": part["v"], "vec": part["vec"]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for t in batches:
            rest = t if rest is None else pd.concat([rest, t], ignore_index=True)
            done = len(rest) // BLOCK * BLOCK - BLOCK
            if done > 0:
                yield from blocks(rest.iloc[:done])
                rest = rest.iloc[done:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield from blocks(rest)

    def blocks(t: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for a, b in runs(t["dim"].to_numpy(), t["table"].to_numpy()):
            for at in range(a, b, BLOCK):
                part = t.iloc[at : min(b, at + BLOCK)]
                if len(part) < 2:
                    continue
                x = units(part["vec"])
                sim = x @ x.T
                np.fill_diagonal(sim, -2)
                m = min(k, len(part) - 1)
                top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
                ids = part["v"].to_numpy()
                yield pd.DataFrame({"v": np.repeat(ids, m), "u": ids[top.ravel()], "sim": np.take_along_axis(sim, top, 1).ravel()})

    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = vectors.mapInPandas(sign, "dim int, table int, signs long, tie double, v long, vec binary")
    order = ["dim", "table", "signs", "tie", "v"]
    return keyed.repartitionByRange(shares, *order).sortWithinPartitions(*order).mapInPandas(compare, EDGE)


def shortlist(edges: DataFrame, limits: DataFrame, before: DataFrame | None, longest: int = 32) -> DataFrame:
    """v, most (list size), list of (sim, u, new), nearest first, from edges and the old lists."""
    if before is not None:
        edges = edges.unionByName(before.select("v", F.explode("list").alias("e")).select("v", "e.u", "e.sim"))
    # one entry for each neighbour: the last bits of a product can differ from block to block
    edges = edges.groupBy("v", "u").agg(F.max("sim").alias("sim"))
    # no more than the longest list of each vector gets past its task, however many candidates it has
    order = Window.partitionBy("v").orderBy(F.desc("sim"), F.desc("u"))
    best = edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= longest)
    best = best.groupBy("v").agg(F.collect_list(F.struct("sim", "u")).alias("all"))
    best = best.join(limits, "v", "left").select("v", F.coalesce("most", F.lit(0)).alias("most"), F.slice(F.sort_array("all", False), F.lit(1), F.greatest(F.col("most"), F.lit(1))).alias("list"))
    if before is None:
        known = F.array().cast("array<bigint>")
    else:
        old = before.select("v", F.transform("list", lambda e: e["u"]).alias("old"))
        best = best.join(old, "v", "left")
        known = F.coalesce("old", F.array().cast("array<bigint>"))
    flagged = F.transform("list", lambda e: F.struct(e["sim"].alias("sim"), e["u"].alias("u"), (~F.array_contains(known, e["u"])).alias("new")))
    return best.select("v", "most", flagged.alias("list"))


def local_joins(graph: DataFrame, vectors: DataFrame, salt: int, members: int = 64) -> DataFrame:
    """Edges between neighbours of one vector that improve at least one of their lists."""
    one = graph.select("v", F.explode("list").alias("e")).select("v", F.col("e.u").alias("u"), F.col("e.new").alias("new"))
    both = one.union(one.select("u", "v", "new")).groupBy(F.col("v").alias("centre"), F.col("u").alias("member")).agg(F.max("new").alias("new"))
    degree = both.groupBy("centre").agg(F.count("*").alias("degree"), F.max("new").alias("any"))
    busy = both.join(degree.where("any"), "centre")
    # a centre with many members is cut into groups by a hash, other ones each round; there old
    # members may not have met yet, so all count as new
    part = F.pmod(F.xxhash64("member", "centre", F.lit(salt)), F.ceil(F.col("degree") / members))
    last = F.when(F.size("list") >= F.col("most"), F.element_at("list", -1)["sim"]).otherwise(-2.0)
    worst = vectors.join(graph.select("v", last.alias("worst")), "v", "left").select(F.col("v").alias("member"), "vec", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    rows = busy.select("centre", part.alias("part"), "member", (F.col("new") | (F.col("degree") > members)).alias("new")).join(worst, "member")
    shares = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join(t: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids, new, worst = t["member"].to_numpy(), t["new"].to_numpy(), t["worst"].to_numpy()
        v, u, s = [], [], []
        x = units(t["vec"])
        for a, b in runs(t["centre"].to_numpy(), t["part"].to_numpy()):
            if b - a < 2 or not new[a:b].any():
                continue
            sim = x[a:b] @ x[a:b].T
            better = (sim > worst[a:b, None]) & (new[a:b, None] | new[None, a:b])
            np.fill_diagonal(better, False)
            i, j = np.nonzero(better)
            v.append(ids[a:b][i])
            u.append(ids[a:b][j])
            s.append(sim[i, j])
        if v:
            yield pd.DataFrame({"v": np.concatenate(v), "u": np.concatenate(u), "sim": np.concatenate(s)})

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for t in batches:
            rest = t if rest is None else pd.concat([rest, t], ignore_index=True)
            if not len(rest):
                continue
            last = runs(rest["centre"].to_numpy(), rest["part"].to_numpy())[-1][0]
            yield from by_dim(rest.iloc[:last])
            rest = rest.iloc[last:].reset_index(drop=True)
        if rest is not None:
            yield from by_dim(rest)

    def by_dim(t: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, part in t.groupby(t["vec"].map(len)) if len(t) else ():
            yield from join(part)

    return rows.repartition(shares, "centre", "part").sortWithinPartitions("centre", "part").mapInPandas(stream, EDGE)


def exact_degrees(members: DataFrame, block: int = 1_000, threshold: float = 0.95) -> DataFrame:
    """v, n: copies-weighted number of vectors of its component within the threshold.

    ``members`` has component, v, vec, copies.  A large component is compared in pairs of
    blocks, each a task of bounded size that gives one count for each row.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("cuts"))
    own = F.pmod(F.xxhash64("v"), F.col("cuts")).cast("int")
    dealt = members.join(sizes, "component").withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
    dealt = dealt.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "v", "vec", "copies")

    def count(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        x, copies, own = units(t["vec"]), t["copies"].to_numpy(), t["own"].to_numpy()
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        near = (x[a] @ x[b].T >= threshold).astype(np.int64)
        if i == j:
            np.fill_diagonal(near, 0)
            return pd.DataFrame({"v": t["v"].to_numpy()[a], "n": near @ copies[a]})
        return pd.DataFrame({"v": np.concatenate([t["v"].to_numpy()[a], t["v"].to_numpy()[b]]), "n": np.concatenate([near @ copies[b], near.T @ copies[a]])})

    return dealt.groupBy("component", "i", "j").applyInPandas(count, "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))


def recall(vectors: DataFrame, linked: DataFrame, threshold: float, queries: int, k: int = 8, enough: int = 50, most: int = 12_800) -> dict[str, tuple[int, float]]:
    """Vectors asked that have a true link, and their mean share of links within the component.

    For vectors of at most ``k`` true links (``small``) and of more (``large``), each vector
    counting once.  The sample, ``queries`` vectors at first, is extended until ``enough`` vectors
    with a link are among them, or all vectors or ``most`` are asked.
    """
    named = vectors.select("v", "vec").join(linked.select(F.col("node").alias("v"), "component"), "v", "left").select("v", "vec", F.coalesce("component", "v").alias("component"))
    order = vectors.select(F.xxhash64("v").alias("h"), "v").orderBy("h", "v")
    shares: dict[str, list[float]] = {"small": [], "large": []}
    asked, after = 0, None
    while asked < most and sum(map(len, shares.values())) < enough:
        # the next vectors by hash; four times as many, in steps of bounded size
        step = min(most - asked, queries if not asked else min(3 * asked, 3_200))
        new = order if after is None else order.where((F.col("h") > after[0]) | (F.col("h") == after[0]) & (F.col("v") > after[1]))
        chosen = named.join(F.broadcast(new.limit(step)), "v").select("h", "v", "vec", "component").collect()
        if not chosen:
            break
        asked, after = asked + len(chosen), max((r["h"], r["v"]) for r in chosen)
        by_dim: dict[int, list] = {}
        for r in chosen:
            by_dim.setdefault(len(r["vec"]), []).append(r)
        sets = {d: (np.array([r["v"] for r in rows]), np.array([r["component"] for r in rows]), np.array([list(r["vec"]) for r in rows], np.uint8)) for d, rows in by_dim.items()}

        def search(batches: Iterator[pd.DataFrame], sets=sets) -> Iterator[pd.DataFrame]:
            exact = {d: (ids, own, units(pd.Series([x.tobytes() for x in vecs]))) for d, (ids, own, vecs) in sets.items()}
            for t in batches:
                for d, part in t.groupby(t["vec"].map(len)):
                    if d not in exact:
                        continue
                    ids, own, q = exact[d]
                    for at in range(0, len(part), 1_000):
                        some = part.iloc[at : at + 1_000]
                        near = (units(some["vec"]) @ q.T >= threshold) & (some["v"].to_numpy()[:, None] != ids)
                        true = near.sum(axis=0)
                        same = (near & (some["component"].to_numpy()[:, None] == own)).sum(axis=0)
                        hit = np.flatnonzero(true)
                        yield pd.DataFrame({"q": ids[hit], "n": true[hit], "same": same[hit]})

        found = named.mapInPandas(search, "q long, n long, same long").groupBy("q").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))
        for r in found.collect():
            shares["small" if r["n"] <= k else "large"].append(r["same"] / r["n"])
    log.info("recall audit: %d vectors asked, with links %s", asked, {c: len(x) for c, x in shares.items()})
    return {c: (len(x), float(np.mean(x)) if x else 1.0) for c, x in shares.items()}


def planted(vectors: DataFrame, most: int) -> DataFrame:
    """v, dim, vec, copies, origin: perturbed copies of at most ``most`` vectors, by hash, to measure the recall.

    Their cosines to the origin are spread from 0.955 to 0.99; ids are those just under the smallest one (over the largest, if
    there is no room).  A dimension of 1 has no other direction and gets none.
    """
    ends = vectors.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
    some = vectors.where("dim > 1").select(F.xxhash64("v", F.lit("probe")).alias("h"), "v", "dim", "vec").orderBy("h", "v").limit(most)
    number = F.row_number().over(Window.orderBy("h", "v"))
    sign, base = (-1, ends["a"] or 0) if (ends["a"] or 0) > -(1 << 62) else (1, ends["b"])

    def perturb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for origin, dim, vec, n in zip(t["v"], t["dim"], t["vec"], t["n"]):
                u = units([vec])[0]
                rng = np.random.default_rng([n, dim])
                w = rng.standard_normal(dim)
                w -= (w @ u) * u
                c = rng.uniform(0.955, 0.99)
                x = (c * u + np.sqrt(1 - c * c) * w / np.sqrt(w @ w)).astype(np.float64 if vec[-1:] == b"d" else np.float32)
                out.append((base + sign * n, dim, x.tobytes() + vec[-1:], 1, origin))
            yield pd.DataFrame(out, columns=["v", "dim", "vec", "copies", "origin"])

    return some.withColumn("n", number).drop("h").mapInPandas(perturb, "v long, dim int, vec binary, copies long, origin long")


def planted_recall(probes: DataFrame, links: DataFrame, linked: DataFrame) -> tuple[int, float]:
    """Number of planted vectors, and the share with a link into the component of their origin."""
    home = linked.select(F.col("node"), "component")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    want = probes.select("v", "origin").join(home, probes["origin"] == home["node"], "left").select("v", F.coalesce("component", "origin").alias("want"))
    got = both.join(F.broadcast(want), both["a"] == want["v"]).select("v", "want", "b")
    got = got.join(home, got["b"] == home["node"], "left").where(F.coalesce("component", "b") == F.col("want"))
    n, found = want.count(), got.select("v").distinct().count()
    return n, found / n if n else 1.0


def exact_links(vectors: DataFrame, threshold: float, block: int = 2_000) -> DataFrame:
    """a, b: edges that join just those vectors which links join, from all pairs, block by block.

    A pair of blocks gives a forest of its links, no more edges than vectors.
    """
    dims = vectors.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("cuts"))
    own = F.pmod(F.xxhash64("v"), F.col("cuts")).cast("int")
    dealt = vectors.join(F.broadcast(dims), "dim").withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
    dealt = dealt.select("dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "v", "vec")

    def forest(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        x, own, ids = units(t["vec"]), t["own"].to_numpy(), t["v"].to_numpy()
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        one, two = np.nonzero(x[a] @ x[b].T >= threshold)
        parent = merge_roots(np.arange(len(t)), a[one], b[two])
        child = np.flatnonzero(parent != np.arange(len(t)))
        return pd.DataFrame({"a": ids[child], "b": ids[parent[child]]})

    return dealt.groupBy("dim", "i", "j").applyInPandas(forest, "a long, b long")


def near_duplicates(
    rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95, k: int = 8, longest: int = 32, tables: int = 3,
    rounds: int = 5, settled: float = 0.01, audit: int = 200, least_recall: float = 0.95, attempts: int = 4,
) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per row of ``rows``.

    Equal vectors are compared once and counted as often as they occur.  Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, not even with an
    equal one: 0 links, component their own id, kept.  Vectors of different dimensions don't link.
    A row without id links with nothing and is not kept.  Rows that repeat an id count as
    vectors of their own.  An empty table gives an empty result; other columns are not read.

    ``longest`` bounds a list, not what is found: links inside a component are counted by the
    exact comparison.  At least ``audit`` vectors measure the recall in each of at most
    ``attempts``, and so do as many planted ones, which always have a link however rare links are; if
    it stays under ``least_recall``, all pairs are compared.
    """
    saved = Saved(rows.sparkSession)
    good = saved(packed(rows, vec_id, embedding))
    vectors = saved(good.groupBy("dim", "vec").agg(F.min("_id").alias("v"), F.count("*").alias("copies")))
    n = vectors.count()
    probes = saved(planted(vectors, audit)) if n else None
    # planted vectors take part in the search, and in nothing else
    searched = saved(vectors.select("dim", "vec", "v").unionByName(probes.select("dim", "vec", "v"))) if n else vectors
    graph: DataFrame | None = None
    linked: DataFrame | None = None
    for attempt in range(attempts if n else 0):
        limits = searched.select("v", F.lit(k).alias("most")) if graph is None else graph.select("v", "most")
        edges = nearest_in_blocks(searched, tables, k, attempt)
        for turn in range(rounds + 1):
            after = saved(shortlist(edges, limits, graph, longest))
            # a saturated list, all links, doubles
            full = (F.size("list") >= F.col("most")) & (F.element_at("list", -1)["sim"] >= threshold) & (F.col("most") < longest)
            older, graph = graph, saved(after.withColumn("most", F.when(full, F.col("most") * 2).otherwise(F.col("most"))))
            limits = graph.select("v", "most")
            saved.drop(older)
            changed = after.agg(F.sum(F.size(F.filter("list", lambda e: e["new"])))).first()[0] or 0
            saved.drop(after)
            if turn == rounds or turn and changed <= settled * n * k:
                break
            edges = local_joins(graph, searched.select("v", "vec"), attempt * (rounds + 1) + turn)
        links = graph.select(F.col("v").alias("a"), F.explode("list").alias("e")).where(F.col("e.sim") >= threshold).select("a", F.col("e.u").alias("b"))
        ends = F.broadcast(probes.select("v"))
        real = links.join(ends, links["a"] == ends["v"], "left_anti").join(ends, links["b"] == ends["v"], "left_anti")
        linked = components(real, saved)
        measured = recall(vectors, linked, threshold, audit, k) | {"planted": planted_recall(probes, links, linked)}
        log.info("attempt %d: recall %s", attempt, measured)
        if all(share >= least_recall for _, share in measured.values()):
            break
    else:
        if n:
            log.warning("recall under %s after %d attempts; all pairs are compared", least_recall, attempts)
            linked = components(exact_links(vectors, threshold), saved)
    if linked is None:
        per_vector = vectors.select("vec", F.col("v").alias("component_id"), F.col("copies").alias("n_links"))
    else:
        members = linked.select(F.col("node").alias("v"), "component").join(vectors, "v").select("component", "v", "vec", "copies")
        counts = exact_degrees(members, threshold=threshold)
        per_vector = vectors.join(linked.select(F.col("node").alias("v"), "component"), "v", "left").join(counts, "v", "left")
        per_vector = per_vector.select("vec", F.coalesce("component", "v").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = good.join(per_vector, "vec").select(F.col("_id").alias(vec_id), "n_links", "component_id")
    out = out.withColumn("kept", F.col(vec_id) == F.col("component_id"))
    bad = rows.where(F.col(vec_id).isNull() | ~usable(embedding))
    alone = bad.select(F.col(vec_id).cast("long").alias(vec_id), F.lit(0).cast("long").alias("n_links"), F.col(vec_id).cast("long").alias("component_id"), F.col(vec_id).isNotNull().alias("kept"))
    return out.unionByName(alone)


def usable(embedding: str):
    """Whether a vector can have a link: finite, not zero."""
    v = F.transform(embedding, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
