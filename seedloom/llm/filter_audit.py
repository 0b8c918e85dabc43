"""Filter interaction audit: what each order of a set of filters removes, and each filter's share.

The filters already applied form a subset of all filters, a state of the subset lattice.
An edge from state S adds one filter f and removes the rows that pass all of S and fail f.
An order of all filters is a path from the empty state to the full one.  Counting paths
forward (orders reaching a state) and backward (orders leaving it) gives each edge the number
of orders that use it; an order's steps are read off the edges along its path.  So the rows
are looked at once, whatever the number of orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Saved

WORD = r"[^\x20\x09-\x0D]+"
LETTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """Orders of ``n`` filters that reach each state from the empty one, and that leave it for the full one."""
    full = (1 << n) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(full + 1):
        for f in range(n):
            if not state >> f & 1:
                reach[state | 1 << f] += reach[state]
    for state in range(full, -1, -1):
        for f in range(n):
            if state >> f & 1:
                leave[state ^ 1 << f] += leave[state]
    return reach, leave


def text_conditions(text: Column) -> list[Column]:
    """Failure conditions A to D of a text: short, repetitive, shouting, with symbols of markup."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words).cast("long")
    return [
        n < 200,
        100 * F.size(F.array_distinct(words)).cast("long") < 50 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]


def mask_of(conditions: list[Column]) -> Column:
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return mask


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, good, toxic, n)``: documents counted by source and failed filters.

    A null text is empty, a null source the empty string; repeated rows count each.  A
    document fails E (bit 16) if a smaller ``doc_id`` has its text, so rows without an id
    neither fail it nor make others fail; they have no labels.  A label holds if any row of
    ``labels`` with the id has it.

    Equal rows are counted before anything is joined.  The smallest id of a text is found by
    an aggregate that combines before its shuffle and meets the rows by (id, text digest), so a text
    with a third of all rows is spread over the cluster.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("part"),
        mask_of(text_conditions(text)).alias("mask"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    rows = Saved(docs.sparkSession)(rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")))
    known = rows.where("doc_id is not null")
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    again = F.when(F.col("_first").isNull(), F.lit(16)).otherwise(F.lit(0))
    met = known.join(firsts, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    met = met.select("part", F.col("mask").bitwiseOR(again).alias("mask"), "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    no = F.lit(False)
    plain = rows.where("doc_id is null").select("part", "mask", "n", no.alias("good"), no.alias("toxic"))
    return met.unionByName(plain).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def bit_of(i: Column, n: int) -> Column:
    return F.get(F.array(*[F.lit(1 << k) for k in range(n)]), i)


def lattice_edges(failed: DataFrame, n_filters: int) -> DataFrame:
    """``(part, state, filter, n, good, toxic, weight)``: removals of every edge that removes rows.

    Row ``filter = -1`` of the empty state counts all rows.  ``weight`` is the number of orders
    that use the edge: those reaching its state times those leaving the next one.
    """
    reach, leave = path_counts(n_filters)
    bit = bit_of(F.greatest(F.col("filter"), F.lit(0)), n_filters)
    passes = F.col("mask").bitwiseAND(F.col("state")) == 0
    fails = F.when(F.col("filter") < 0, F.col("state") == 0).otherwise(F.col("mask").bitwiseAND(bit) != 0)
    small = failed.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]
    )
    walked = small.withColumn("state", F.explode(F.sequence(F.lit(0), F.lit((1 << n_filters) - 1)))).where(passes)
    walked = walked.withColumn("filter", F.explode(F.sequence(F.lit(-1), F.lit(n_filters - 1)))).where(fails)
    reached = F.get(F.array(*map(F.lit, reach)), F.col("state"))
    left = F.get(F.array(*map(F.lit, leave)), F.col("state").bitwiseOR(bit))
    weight = F.when(F.col("filter") < 0, 0).otherwise(reached * left)
    summed = walked.groupBy("part", "state", "filter").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return summed.select("part", "state", "filter", *COUNTS, weight.cast("long").alias("weight"))


def audit(failed: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row per part, order of the filters and step; see ``filter_audit`` for the columns.

    All edges of a part, at most ``n * 2**(n - 1) + 1`` rows, come together in one map.
    """
    n = len(letters)
    key = (F.col("state") * (n + 1) + F.col("filter") + 1).cast("int")
    edges = lattice_edges(failed, n).groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct(key, F.struct(*COUNTS)))).alias("edge"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("filter") == f, F.col("n") * F.col("weight"))), F.lit(0)) for f in range(n)]).alias("share"),
    )
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(letters))), ",")
    steps = edges.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    at = F.instr(F.lit(letters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    state = sum((F.when(F.instr("filter_order", c) < F.col("step"), 1 << i).otherwise(0) for i, c in enumerate(letters)), F.lit(0))
    steps = steps.withColumn("filter", at).withColumn("state", state)

    def found(s: Column, f: Column, name: str) -> Column:
        return F.coalesce(F.try_element_at("edge", (s * (n + 1) + f + 1).cast("int")).getField(name), F.lit(0)).cast("long")

    # rows left in a state: all rows less what each edge on the way removed
    def before(step: Column) -> Column:
        way = F.lit(0).cast("long")
        for i in range(n):
            used = sum((F.when(F.instr("filter_order", c) <= i, 1 << j).otherwise(0) for j, c in enumerate(letters)), F.lit(0))
            f = F.instr(F.lit(letters), F.substring("filter_order", i + 1, 1)) - 1
            way = way + F.when(F.lit(i) < step, found(used, f, "n")).otherwise(0)
        return way

    rest = F.lit((1 << n) - 1).bitwiseXOR(bit_of(F.col("filter"), n))
    removed = found(F.col("state"), F.col("filter"), "n")
    return steps.select(
        "part", "filter_order", "step",
        (found(F.lit(0), F.lit(-1), "n") - before(F.col("step"))).alias("kept"),
        removed.alias("removed"),
        (found(F.lit(0), F.col("filter"), "n") - removed).alias("redundant"),
        found(rest, F.col("filter"), "n").alias("unique_fails"),
        found(F.col("state"), F.col("filter"), "good").alias("good_lost"),
        found(F.col("state"), F.col("filter"), "toxic").alias("toxic_lost"),
        F.get("share", F.col("filter")).cast("long").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five text filters in all 120 orders, for each source.

    Rows of ``documents(doc_id, text, source)`` and ``labels(doc_id, quality, toxic)``; more columns
    are ignored.  ``kept`` rows pass all filters up to the step, ``removed`` fall here, ``redundant``
    fail the filter but fell before, ``unique_fails`` fail no other filter, ``good_lost`` and ``toxic_lost``
    are labelled rows that fall here, ``shapley`` is what the filter removes over all orders.  Nulls
    and repeated rows: see ``failures``.  An empty table gives an empty result.
    """
    return audit(failures(docs, labels))


def _permutations_sql() -> str:
    return """orders AS (SELECT '' AS o UNION ALL SELECT o || c FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS t(c)
        WHERE NOT contains(o, c))"""


FILTER_AUDIT_SQL = f"""WITH RECURSIVE {_permutations_sql()},
    plain AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
        FROM labels GROUP BY doc_id),
    fails AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN plain.doc_id > min(plain.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS f
        FROM plain LEFT JOIN marks USING (doc_id)),
    grouped AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
        FROM fails GROUP BY ALL),
    walked AS (
        SELECT part, o, s, n, good, toxic, f, o[s] AS c, regexp_matches(f, '[' || o[s] || ']') AS fails_here,
               s > 1 AND regexp_matches(f, '[' || CASE WHEN s > 1 THEN o[1:s - 1] ELSE '~' END || ']') AS gone
        FROM grouped, orders, unnest([1, 2, 3, 4, 5]) AS t(s) WHERE length(o) = 5),
    steps AS (
        SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, any_value(c) AS c,
            CAST(sum(CASE WHEN gone OR fails_here THEN 0 ELSE n END) AS BIGINT) AS kept,
            CAST(sum(CASE WHEN fails_here AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
            CAST(sum(CASE WHEN fails_here AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
            CAST(sum(CASE WHEN f = c THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
            CAST(sum(CASE WHEN fails_here AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
            CAST(sum(CASE WHEN fails_here AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
        FROM walked GROUP BY part, o, s)
    SELECT * EXCLUDE (c), CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM steps"""
