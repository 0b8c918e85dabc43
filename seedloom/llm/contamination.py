"""Benchmark decontamination by a positional inverted index over the training documents.

The index holds a posting ``(tid, id, th, pos)`` for every occurrence of a test term in a
document, written to the shared folder in shards of documents, each shard sorted by term, so that a
term's list is one run of rows.  A test window is looked up from its rarest term: every posting of
that term, moved by the term's offset, is a possible start.  The second rarest list is intersected
with those starts, then all others with what is left.  Every list meets the starts by
(document, term, position), a key that no group of equal documents or frequent terms can make hot.

All steps are DataFrame operations; nothing is collected but counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Saved

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A to Z are lowered.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table of the test side is broadcast up to so many rows, about 100 MB; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
DOC = ["id", "th"]
START = [*DOC, "wid", "start"]


def words(text: Column) -> Column:
    """Words of a text, A to Z in lower case; null for null."""
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= limit else df


def injective_hash(df: DataFrame, c: str) -> Column:
    """A 64-bit hash of a column that tells all its values apart; the seed is raised until it does."""
    seed = 0
    while True:
        h = F.xxhash64(F.lit(seed), F.col(c))
        n = df.select(c).distinct().agg(F.count("*").alias("a"), F.count_distinct(h).alias("b")).first()
        if n["a"] == n["b"]:
            return h
        seed += 1


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, id, th)``: rows of one id and text share a key, and so do their results."""
    return docs.select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("th")
    )


def test_windows(items: DataFrame, size: int, saved: Saved) -> tuple[DataFrame, DataFrame]:
    """Windows of the test texts: ``(wid, off, term, tid, len)`` and ``(wid, item_id)``.

    Equal windows are one.  A text of fewer than ``size`` words, but not none, is one window.
    """
    tok = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = tok.withColumn("s", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))))
    cut = saved(at.select("item_id", F.slice("w", F.col("s"), F.lit(size)).alias("terms")).distinct())
    cut = cut.withColumn("wid", injective_hash(cut, "terms"))
    one = cut.select("wid", "terms").distinct()
    flat = saved(one.select("wid", F.size("terms").alias("len"), F.posexplode("terms").alias("off", "term")))
    return flat.withColumn("tid", injective_hash(flat, "term")), cut.select("wid", "item_id")


def build_index(docs: DataFrame, terms: DataFrame, saved: Saved) -> DataFrame:
    """Postings ``(tid, id, th, pos)`` of the terms ``(term, tid)`` in whole texts, stored."""
    tokens = docs.select(*DOC, F.posexplode(words(F.col("text"))).alias("pos", "term"))
    found = tokens.join(sized(terms), "term").select("tid", *DOC, "pos")
    return saved(found.sortWithinPartitions("tid"))


def by_rarity(flat: DataFrame, postings: DataFrame) -> DataFrame:
    """Test windows with ``rank``, 1 for the term with the fewest postings.

    Windows with a term that occurs nowhere are left out.
    """
    frequency = postings.groupBy("tid").agg(F.count("*").alias("n"))
    counted = flat.drop("term").join(frequency, "tid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("wid")
    ranked = counted.withColumn("rank", F.row_number().over(w.orderBy("n", "off"))).withColumn("least", F.min("n").over(w))
    return ranked.where("least > 0").select("wid", "len", "off", "tid", "rank")


def intersect(starts: DataFrame, tests: DataFrame, postings: DataFrame, slack: int) -> DataFrame:
    """Starts that have a posting of every term in ``tests``, at most ``slack`` words off its place.

    ``exact`` stays true while every term is in its very place.
    """
    need = starts.join(tests, "wid").withColumn("d", F.explode(F.sequence(F.lit(-slack), F.lit(slack))))
    need = need.withColumn("pos", F.col("start") + F.col("off") + F.col("d"))
    met = need.join(postings.select("tid", *DOC, "pos"), ["tid", *DOC, "pos"], "left_semi")
    by_term = met.groupBy(*START, "len", "exact", "want", "off").agg(F.min(F.abs("d")).alias("d"))
    whole = by_term.groupBy(*START, "len", "exact", "want").agg(F.count("*").alias("n"), F.max("d").alias("d"))
    return whole.where("n = want").select(*START, "len", (F.col("exact") & (F.col("d") == 0)).alias("exact"))


def search(postings: DataFrame, ranked: DataFrame, slack: int, saved: Saved) -> DataFrame:
    """``(id, th, wid, start, len, exact)``: phrases, and near ones if ``slack`` > 0, of all test windows.

    An exact phrase has all its words in place.  A near one has every word at most ``slack`` words off the
    place that the rarest one gives it.
    """
    first = ranked.where("rank = 1").select("tid", "wid", "len", "off")
    starts = postings.join(sized(first), "tid").select(*DOC, "wid", (F.col("pos") - F.col("off")).alias("start"), "len", F.lit(True).alias("exact"))
    starts = starts.distinct()
    single = starts.where("len = 1 and start >= 0")
    second = ranked.where("rank = 2").select("wid", "off", "tid", F.lit(1).alias("want"))
    lists = postings.join(sized(second.select("tid").distinct()), "tid", "left_semi")
    starts = saved(intersect(starts.where("len > 1"), sized(second), lists, slack))
    pairs, more = starts.where("len = 2"), starts.where("len > 2")
    rest = ranked.where("rank > 2").select("wid", "off", "tid", (F.col("len") - 2).alias("want"))
    lists = postings.join(sized(more.select(*DOC).distinct()), DOC, "left_semi")
    found = intersect(more, sized(rest), lists, slack)
    kept = single.unionByName(pairs).unionByName(found)
    return saved(kept.where("not exact or start >= 0"))


def matches(docs: DataFrame, items: DataFrame, size: int = 10, slack: int = 1, saved: Saved | None = None) -> tuple[DataFrame, DataFrame]:
    """Occurrences as of ``search``, and the items ``(wid, item_id)`` of their windows."""
    saved = saved or Saved(docs.sparkSession)
    flat, owners = test_windows(items, size, saved)
    postings = build_index(docs, flat.select("term", "tid").distinct(), saved)
    return search(postings, saved(by_rarity(flat, postings)), slack, saved), owners


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, slack: int = 1) -> DataFrame:
    """A row per document: words, words hit, items found, and whether any word is hit.

    ``documents(doc_id, text)``, ``benchmark(item_id, text)``; more columns are ignored.  A null text has no
    words.  Repeated rows give a row each.  An item without an id marks words but is not counted
    or listed.  ``n_near`` counts items of which some window is found at most ``slack`` words off and none
    exactly.  Without items nothing is contaminated; no documents, no rows.
    """
    rows = keyed(docs)
    found, owners = matches(rows, items, size, slack)
    exact = found.where("exact")
    places = exact.select(*DOC, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos"))
    hit = places.distinct().groupBy(*DOC).agg(F.count("*").alias("n_hit"))
    owned = found.join(sized(owners.where("item_id is not null").distinct()), "wid")
    owned = owned.groupBy(*DOC, "item_id").agg(F.max("exact").alias("exact"))
    name = F.when(F.col("exact"), F.col("item_id").cast("string"))
    listed = owned.groupBy(*DOC).agg(F.collect_list(name).alias("items"), F.count(F.when(~F.col("exact"), 1)).alias("n_near"))
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long")
    out = rows.select("doc_id", *DOC, n_words.alias("n_words")).join(hit, DOC, "left").join(listed, DOC, "left")
    items_col = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.size(items_col).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items_col), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


_PATTERN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _words_sql(text: str) -> str:
    return f"coalesce(regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '{_PATTERN}'), [])"


# near matches: the place of a window follows its rarest word, counted over all documents
CONTAMINATION_SQL = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_words_sql('text')} AS w FROM documents),
    items AS (SELECT item_id, {_words_sql('text')} AS w FROM benchmark),
    wins AS (SELECT item_id, w[s:s + 9] AS g FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(s) WHERE len(w) > 0),
    tok AS (SELECT r, generate_subscripts(w, 1) AS pos, unnest(w) AS term FROM docs),
    freq AS (SELECT term, count(*) AS n FROM tok GROUP BY term),
    need AS (SELECT id, g, k - 1 AS off, g[k] AS term, coalesce(n, 0) AS n
        FROM (SELECT row_number() OVER () AS id, g FROM (SELECT DISTINCT g FROM wins)), unnest(range(1, len(g) + 1)) AS t(k)
        LEFT JOIN freq ON freq.term = g[k]),
    hits AS (SELECT r, start, len(g) AS n, item_id FROM (
            SELECT r, id, g, pos - off AS start FROM need JOIN tok USING (term) GROUP BY r, id, g, pos - off HAVING count(DISTINCT off) = len(g))
        JOIN wins USING (g)),
    words_hit AS (SELECT r, count(DISTINCT start + k) AS n_hit FROM hits, unnest(range(0, n)) AS t(k) GROUP BY r),
    found AS (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL),
    listed AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM found GROUP BY r),
    rare AS (SELECT id, g, off, term FROM need QUALIFY row_number() OVER (PARTITION BY id ORDER BY n, off) = 1),
    starts AS (SELECT r, id, g, pos - off AS start FROM rare JOIN tok USING (term)),
    close_ AS (SELECT r, id, start, g FROM starts JOIN need USING (id, g) JOIN (SELECT r, pos, term FROM tok) k USING (r, term)
        WHERE k.pos - off - start BETWEEN -1 AND 1 GROUP BY r, id, start, g HAVING count(DISTINCT off) = len(g)),
    near AS (SELECT r, count(*) AS n_near FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM close_ JOIN wins USING (g)
        WHERE item_id IS NOT NULL) x ANTI JOIN found USING (r, item) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
    FROM docs LEFT JOIN words_hit USING (r) LEFT JOIN listed USING (r) LEFT JOIN near USING (r)"""
