"""Filter audit, positional index and hard negatives against plain versions, and on awkward rows."""

import hashlib
import itertools
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seedloom.llm import contamination, filter_audit, hard_negatives, registry

SF = "/root/testdata/sf0.001"


def with_clashes(df, *names):
    for c in names:
        df = df.withColumn(c, F.lit(7))
    return df


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"{name}_arrow", df.toArrow())
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_arrow")
    return sorted(map(repr, con.execute(sql).fetchall())), [x[0] for x in con.description]


def rows_of(df, columns):
    return sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())


# ---------------------------------------------------------------------- filter audit
def audit_by_hand(docs, labels):
    """Every order run over the rows, one filter after the other."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed = []
    for i, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        earlier = any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in docs)
        bad = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), earlier]
        failed.append((source or "", {c for c, b in zip("ABCDE", bad) if b}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in failed}:
        mine = [f for f in failed if f[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [f for f in left if c in f[1]]
                left = [f for f in left if c not in f[1]]
                share[c] += len(gone)
                all_c = [f for f in mine if c in f[1]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(all_c) - len(gone), sum(f[1] == {c} for f in mine),
                    sum(f[2] for f in gone), sum(f[3] for f in gone), c,
                ]
        for k in [k for k in out if k[0] == part]:
            out[k][-1] = share[out[k][-1]]
    return {k: tuple(v) for k, v in out.items()}


AUDIT_DOCS = [
    (1, "all alike " * 150, "a"), (2, "all alike " * 150, "a"), (2, "all alike " * 150, "a"), (3, None, None), (4, "", ""),
    (5, " ".join(f"w{i}" for i in range(250)), "a"), (6, " ".join(f"W{i}" for i in range(250)), "b"),
    (7, "CAPS # " + " ".join(f"x{i}" for i in range(300)), "b"), (None, "all alike " * 150, "a"), (8, "é😀 " * 5, None),
    (9, "tail " * 40_000, "b"), (0, "é😀 " * 5, "b"), (None, None, None),
]
AUDIT_LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (None, 1, 1), (6, None, 1), (99, 1, 1), (7, 1, None)]


def test_filter_audit_against_all_orders(spark):
    docs = spark.createDataFrame(AUDIT_DOCS, "doc_id long, text string, source string")
    labels = spark.createDataFrame(AUDIT_LABELS, "doc_id long, quality int, toxic int")
    more = with_clashes(docs, "part", "mask", "n", "step", "good", "digest", "quality"), with_clashes(labels, "n", "text", "good", "source")
    got = {
        (r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"])
        for r in filter_audit.filter_audit(*more).collect()
    }
    assert got == audit_by_hand(AUDIT_DOCS, AUDIT_LABELS)
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0
    assert filter_audit.filter_audit(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0
    want, names = by_sql(filter_audit.FILTER_AUDIT_SQL, documents=docs.where("doc_id is not null"), labels=labels)
    assert rows_of(filter_audit.filter_audit(docs.where("doc_id is not null"), labels), names) == want


def test_path_counts():
    for n in range(1, 6):
        reach, leave = filter_audit.path_counts(n)
        for s in range(1 << n):
            k = bin(s).count("1")
            assert (reach[s], leave[s]) == (math.factorial(k), math.factorial(n - k))


# ------------------------------------------------------------------- decontamination
def hits_by_hand(docs, items, size=10):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    wins = []
    for i, t in items:
        w = words(t)
        wins += [(i, w[s : s + size]) for s in range(max(1, len(w) - size + 1)) if w]
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, g in wins:
            for s in range(len(w) - len(g) + 1):
                if w[s : s + len(g)] == g:
                    hit |= set(range(s, s + len(g)))
                    found |= {str(i)} if i is not None else set()
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ITEM = "One two THREE four five six seven eight nine ten eleven twelve été naïve"
ITEMS = [(10, ITEM), (9, "Tiny item"), (9, "tiny ITEM"), (8, ""), (7, None), (None, "the nameless one"), (6, "the"), (11, ITEM), (5, "a b a b a b a b a b a b")]
LEAKS = [
    (1, "x " + ITEM.upper().replace("ÉTÉ", "été").replace("NAÏVE", "naïve") + " y"),
    (2, "one-two three, four five six seven eight nine"),
    (3, "one two three four five six seven eight nine ten"),
    (4, None), (5, ""), (6, "... !!!"), (7, "tiny\nitem tiny item"), (7, "tiny\nitem tiny item"), (None, "see the nameless one"),
    (8, "a b a b a b a b a b a b a b"), (9, "one two three four uh five six seven eight nine ten eleven"),
    (10, "fill " * 9_000 + ITEM), (11, "été naïve Été"),
]


def test_decontamination_against_plain_search(spark):
    docs = with_clashes(spark.createDataFrame(LEAKS, "doc_id long, text string"), "id", "th", "pos", "term", "tid", "wid", "start", "exact")
    items = with_clashes(spark.createDataFrame(ITEMS, "item_id long, text string"), "doc_id", "w", "terms", "off", "len", "rank")
    got = contamination.decontaminate(docs, items)
    rows = got.collect()
    assert sorted((tuple(r)[:6] for r in rows), key=repr) == hits_by_hand(LEAKS, ITEMS)
    # one word put in the middle: each word is at most one off, seen from the rarest
    assert {r["doc_id"]: r["n_near"] for r in rows}[9] == 2
    none = contamination.decontaminate(docs, items.limit(0)).collect()
    assert len(none) == len(LEAKS) and not any(r["contaminated"] for r in none)
    assert contamination.decontaminate(docs.limit(0), items).count() == 0
    want, names = by_sql(contamination.CONTAMINATION_SQL, documents=docs, benchmark=items)
    assert rows_of(got, names) == want


def test_decontamination_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(contamination.sized, "__defaults__", (0,))
    docs = spark.createDataFrame(LEAKS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = contamination.decontaminate(docs, items).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == hits_by_hand(LEAKS, ITEMS)


def test_no_python_in_the_plan(spark):
    plan = registry.op12_positional_index(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "ExternalRDD" not in plan


# -------------------------------------------------------------------- hard negatives
def negatives_by_hand(rows):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept[i, tuple(v), label] = (i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
    out = []
    for i, label, v in kept.values():
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in kept.values() if j != i)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            fit = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, p, k, j, -s, -t) for k, (t, j, _) in enumerate(fit, 1)]
    return sorted(out)


def test_hard_negatives_against_plain_search(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rnd.normal(size=12)], int(rnd.integers(0, 4))) for i in range(-60, 300)]
    rows += rows[:3] + [(400, rows[5][1], 1), (401, rows[5][1], 2), (402, rows[5][1], 2), (None, rows[5][1], 1)]
    rows += [(403, None, 1), (404, rows[5][1], None), (405, [1.0, None] + [0.0] * 10, 1), (406, [float("nan")] * 12, 1), (407, [float("inf")] * 12, 1)]
    rows += [(450, [0.0] * 12, 1), (500, [1.0] * 5, 2), (550, [], 3)]
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), "v", "ab", "rb", "anchor", "place", "score")
    want = negatives_by_hand(rows)
    assert len(want) > 40
    assert sorted(map(tuple, hard_negatives.hard_negatives(df).collect())) == want
    monkeypatch.setattr(hard_negatives, "ANCHORS_PER_BLOCK", 3)
    monkeypatch.setattr(hard_negatives, "ROWS_PER_BLOCK", 70)
    monkeypatch.setattr(hard_negatives, "TILE", 100)
    assert sorted(map(tuple, hard_negatives.hard_negatives(df).collect())) == want
    assert hard_negatives.hard_negatives(df.limit(0)).count() == 0


def test_residue_scores_are_exact():
    rnd = np.random.default_rng(5)
    for width, size in ((1, 1), (64, 256), (700, 256), (3, 1 << 24)):
        a, b = (rnd.integers(-size, size + 1, (5, width)).astype(float) for _ in range(2))
        a[0], b[0], b[1] = size, size, -size
        primes = hard_negatives.primes_for(width * size * size)
        got = hard_negatives.scores(hard_negatives.remainders(a, primes), hard_negatives.remainders(b, primes), primes)
        assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
    with pytest.raises(ValueError):
        hard_negatives.primes_for(1 << 60)
