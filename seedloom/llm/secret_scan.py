"""Secret scan by character Markov models, with column expressions only.

Three patterns mark what is surely meant as a secret; their spans stay.  What is left of the text, the
parts of tokens beside such spans included, is judged by two first-order Markov models over an alphabet of 66
characters.  The model of random strings is counted from the values of the patterns and from digests
written in several alphabets; the model of identifiers from short identifiers of the corpus and from its words
put together in the usual ways (camelCase, snake_case, kebab-case, with digits).  A token of 20 or
more characters is a secret if its log-likelihood ratio per character reaches a threshold, which is
chosen on the half of both samples that the models did not see.  Random strings are compared within the
smallest alphabet that holds the token, so that one in lower case only is as random as a mixed one.

Spans are folded in blocks of about the square root of their number, so that a text with very many of
them costs no square of it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample

# The patterns of the base rules.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: What the models judge; shorter strings carry too little evidence.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-"
SIZE = len(ALPHABET) + 1
MARK, END = "\x01", "\x02"


def quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


SPANS = "array<struct<at:bigint,to:bigint,kind:string,value:string>>"


def cut_in_blocks(items: Column) -> Column:
    """An array as an array of blocks, as many as each has members."""
    n = F.size(items)
    step = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
    some = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / step).cast("int") - 1, F.lit(0))), lambda k: F.slice(items, k * step + 1, step))
    return F.when(n > 0, some).otherwise(F.slice(some, F.lit(1), F.lit(0)))


def running(blocks: Column, first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What is known before each block: ``first``, then ``step(before, block)`` of the block before."""
    start = F.struct(first.alias("now"), F.slice(F.array(first), F.lit(1), F.lit(0)).alias("all"))
    return F.aggregate(blocks, start, lambda s, b: F.struct(step(s["now"], b).alias("now"), F.concat(s["all"], F.array(s["now"])).alias("all")), lambda s: s["all"])


def matches(text: Column, pattern: str, guard: Column, kind: str) -> Column:
    """array<struct<at, to, kind, value>> of the leftmost non-overlapping matches.

    Each match is marked in place; the pieces between marks give the positions, in code
    points.  ``value`` is group 1 of a pattern that has one, else the match.
    """
    found = F.split(F.regexp_replace(text, F.lit(f"({pattern})"), F.lit(f"{MARK}$1{END}")), MARK)
    blocks = cut_in_blocks(F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0))))
    # a piece is a match, its mark and the text up to the next one
    begin = running(blocks, F.length(found[0]).cast("long"), lambda at, b: F.aggregate(b, at, lambda s, piece: s + F.length(piece) - 1))

    def step(state: Column, piece: Column) -> Column:
        hit = F.substring_index(piece, END, 1)
        to = state["at"] + F.length(hit)
        value = F.regexp_extract(hit, pattern, 1) if "(" in pattern.replace("(?:", "") else hit
        one = F.struct(state["at"].alias("at"), to.alias("to"), F.lit(kind).alias("kind"), value.alias("value"))
        return F.struct((state["at"] + F.length(piece) - 1).alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    none = F.array().cast(SPANS)
    each = F.zip_with(blocks, begin, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("out")), step, lambda s: s["out"]))
    return F.when(guard, F.flatten(each)).otherwise(none)


def rewritten(text: Column, spans: Column, fill: Callable[[Column, Column], Column]) -> Column:
    """The text with ``fill(length, fresh)`` for what each span covers that none before did.

    ``spans`` come in order of their start; ``fresh`` is false where a span continues one before.
    """
    blocks = cut_in_blocks(spans)
    end = lambda at, b: F.aggregate(b, at, lambda s, m: F.greatest(s, m["to"]))
    begin = running(blocks, F.lit(0).cast("long"), end)

    def part(b: Column, at: Column) -> Column:
        mine = F.substring(text, (at + 1).cast("int"), (end(at, b) - at).cast("int"))

        def step(s: Column, m: Column) -> Column:
            gap = F.substring(mine, (s["at"] - at + 1).cast("int"), F.greatest(m["at"] - s["at"], F.lit(0)).cast("int"))
            new = fill(F.greatest(m["to"] - F.greatest(m["at"], s["at"]), F.lit(0)).cast("int"), m["at"] >= s["at"])
            return F.struct(F.greatest(s["at"], m["to"]).alias("at"), F.concat(s["out"], F.array(gap, new)).alias("out"))

        start = F.struct(at.alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(b, start, step, lambda s: F.array_join(s["out"], ""))

    tail = F.substring(text, (F.aggregate(spans, F.lit(0).cast("long"), lambda s, m: F.greatest(s, m["to"])) + 1).cast("int"), F.length(text))
    whole = F.concat(F.array_join(F.zip_with(blocks, begin, part), ""), tail)
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def clean(text: str) -> Column:
    """The text with the two mark characters exchanged for one that no pattern takes."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), MARK + END, "\x03\x03")


def base_matches(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``_text`` and the arrays ``_assign``, ``_access``, ``_hex``."""
    t = F.col("_text")
    return docs.withColumn("_text", clean(text)).withColumns(
        {
            "_assign": F.filter(
                matches(t, ASSIGN, t.contains("=") | t.contains(":"), "assign"), lambda m: F.length(m["value"]) >= 8
            ),
            "_access": matches(t, ACCESS, t.contains("AKIA"), "access"),
            "_hex": matches(t, HEX, t.rlike(HEX), "hex"),
        }
    )


def code(char: Column) -> Column:
    """Place of a character in the alphabet; all other characters share the last code."""
    point = F.ascii(char)
    return (
        F.when(point.between(48, 57), point - 48)
        .when(point.between(65, 90), point - 55)
        .when(point.between(97, 122), point - 61)
        .when(char == "+", 62)
        .when(char == "/", 63)
        .when(char == "_", 64)
        .when(char == "-", 65)
        .otherwise(SIZE - 1)
    )


def codes(token: Column) -> Column:
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), code)


def by_start(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    order = F.array(*map(F.lit, ("assign", "access", "hex", "markov")))
    keyed = F.transform(spans, lambda m: F.struct(m["at"].alias("at"), F.array_position(order, m["kind"]).alias("place"), m["to"].alias("to"), m["kind"].alias("kind"), m["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda m: F.struct(m["at"].alias("at"), m["to"].alias("to"), m["kind"].alias("kind"), m["value"].alias("value")))


def pair_counts(tokens: DataFrame) -> list[list[float]]:
    """Counts of character pairs in the column ``token``, a square table of fixed size."""
    pairs = tokens.select(codes(F.col("token")).alias("c")).where(F.size("c") > 1)
    pairs = pairs.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.element_at("c", i) * SIZE + F.element_at("c", i + 1))).alias("pair"))
    out = [[0.0] * SIZE for _ in range(SIZE)]
    for row in pairs.groupBy("pair").count().collect():
        out[row["pair"] // SIZE][row["pair"] % SIZE] = float(row["count"])
    return out


# The alphabets random strings are written in, smaller ones first, as patterns and as characters.
ALPHABETS = [
    ("[0-9]*", "0123456789"),
    ("[0-9a-f]*", "0123456789abcdef"),
    ("[0-9A-F]*", "0123456789ABCDEF"),
    ("[a-z]*", "abcdefghijklmnopqrstuvwxyz"),
    ("[A-Z]*", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("[0-9a-z]*", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("[0-9A-Z]*", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("[A-Za-z]*", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("[0-9A-Za-z]*", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    (".*", ALPHABET),
]


@dataclass(frozen=True)
class MarkovModels:
    """``ratios``: log P(b | a, random) - log P(b | a, ordinary), flat; ``norms``: by alphabet and a, the log of
    the probability that a random string stays in the alphabet; ``threshold`` per character.

    ``missed`` and ``alarms`` are the shares of held-out random and ordinary strings on the wrong side.
    """

    ratios: list[float]
    norms: list[float]
    threshold: float = 0.0
    missed: float = 0.0
    alarms: float = 0.0


def models(random: list[list[float]], ordinary: list[list[float]], prior: float = 0.5) -> MarkovModels:
    """Both models from their pair counts; each row gets ``prior`` on every cell."""
    ratios, stay = [], [[0.0] * SIZE for _ in ALPHABETS]
    members = [{ALPHABET.index(c) for c in letters} for _, letters in ALPHABETS]
    for a, (r, o) in enumerate(zip(random, ordinary)):
        r_sum, o_sum = sum(r) + prior * SIZE, sum(o) + prior * SIZE
        for b, (x, y) in enumerate(zip(r, o)):
            p = (x + prior) / r_sum
            ratios.append(math.log(p) - math.log((y + prior) / o_sum))
            for k, inside in enumerate(members):
                stay[k][a] += p if b in inside else 0.0
    return MarkovModels(ratios, [math.log(x) for row in stay for x in row])


def token_score(value: Column, model: MarkovModels) -> Column:
    """Mean log ratio per step of a token of two or more characters."""
    ratios = F.from_json(F.lit(json.dumps(model.ratios)), "array<double>")
    norms = F.from_json(F.lit(json.dumps(model.norms)), "array<double>")
    alphabet = F.lit(len(ALPHABETS) - 1)
    for k in reversed(range(len(ALPHABETS) - 1)):
        alphabet = F.when(value.rlike(f"^{ALPHABETS[k][0]}$"), F.lit(k)).otherwise(alphabet)

    def step(s: Column, c: Column) -> Column:
        more = F.element_at(ratios, s["last"] * SIZE + c + 1) - F.element_at(norms, s["k"] * SIZE + s["last"] + 1)
        return F.struct(c.alias("last"), (s["sum"] + F.when(s["last"] < 0, 0.0).otherwise(more)).alias("sum"), s["k"].alias("k"))

    # the alphabet is found once and carried along
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"), alphabet.alias("k"))
    return F.aggregate(codes(value), start, step, lambda s: s["sum"]) / (F.length(value) - 1)


def random_samples(docs: DataFrame, ids: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``token``: the values the base rules find in all documents, and digests of ids in eight alphabets."""
    found = base_matches(docs.select(doc_id, text), text)
    values = found.select(F.explode(F.concat("_assign", "_access", "_hex")).alias("m")).select(F.col("m.value").alias("token"))
    digest = F.sha2(F.concat(F.lit("sample "), F.col(doc_id).cast("string")), 512)
    b64 = F.translate(F.base64(F.unhex(digest)), "=\r\n", "")
    written = [b64, F.translate(b64, "+/", "-_"), F.translate(b64, "+/", ""), F.substring(digest, 1, 64), F.upper(F.substring(digest, 1, 64))]
    # three characters of a digest name a letter; 4,096 of them leave no telling bias
    for letters in (ALPHABETS[3][1], ALPHABETS[4][1], ALPHABETS[5][1], ALPHABETS[6][1], ALPHABETS[7][1]):
        pairs = F.regexp_extract_all(digest, F.lit(".{3}"), F.lit(0))
        chars = F.transform(pairs, lambda x: F.substring(F.lit(letters), (F.conv(x, 16, 10).cast("int") % len(letters) + 1), F.lit(1)))
        written.append(F.array_join(F.slice(chars, F.lit(1), F.lit(40)), ""))
    return values.unionByName(ids.select(F.explode(F.array(*written)).alias("token")))


def ordinary_samples(docs: DataFrame, ids: DataFrame, text: str, doc_id: str, sample_words: int = 40) -> DataFrame:
    """``token``: identifiers of under 20 characters, which are never judged, words put together, long numbers, rules.

    Identifiers have a digit, a joint or a capital inside.
    """
    some = docs.select(doc_id, text).join(F.broadcast(ids), doc_id, "left_semi").select(clean(text).alias("t"))
    short = some.select(F.explode(F.regexp_extract_all("t", F.lit(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z][A-Za-z0-9_-]{1,18}(?![A-Za-z0-9+/_=.-])"), F.lit(0))).alias("token"))
    short = short.where(F.col("token").rlike("[a-z][A-Z]|[0-9_-]"))
    words = some.select(F.slice(F.filter(F.regexp_extract_all("t", F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.length(w) >= 3), F.lit(1), F.lit(sample_words)).alias("w"))
    runs = words.where(F.size("w") >= 4).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 3, F.lit(4)), lambda i: F.slice("w", i, 4))).alias("w"))
    low = F.transform("w", lambda x: F.lower(x))
    proper = F.transform("w", lambda x: F.initcap(x))
    number = (F.pmod(F.xxhash64(F.col("w")), F.lit(97))).cast("string")
    made = [
        F.concat(low[0], F.array_join(F.slice(proper, 2, 3), "")), F.array_join(proper, ""), F.array_join(low, ""),
        F.array_join(low, "_"), F.array_join(low, "-"), F.array_join(low, "/"), F.upper(F.array_join("w", "_")), F.upper(F.array_join("w", "")),
        F.concat(low[0], proper[1], number, proper[2]), F.concat(F.array_join(low, "_"), F.lit("_"), number), F.concat(F.array_join(low, "-"), number),
    ]
    digest = F.sha2(F.concat(F.lit("number "), F.col(doc_id).cast("string")), 256)
    size = (F.pmod(F.xxhash64(doc_id), F.lit(29)) + 20).cast("int")
    plain = [F.substring(F.translate(digest, "abcdef", "012345"), 1, 24), *[F.repeat(F.lit(c), size) for c in "-_+/0x"]]
    return short.unionByName(runs.select(F.explode(F.array(*made)).alias("token"))).unionByName(ids.select(F.explode(F.array(*plain)).alias("token")))


def edge(counts: dict[int, int], share: float, reverse: bool = False) -> int:
    """The step at which more than ``share`` of the counted scores lie below, or above with ``reverse``."""
    passed = 0
    for k in sorted(counts, reverse=reverse):
        passed += counts[k]
        if passed > share * sum(counts.values()):
            return k
    return 0


def train(docs: DataFrame, doc_id: str, text: str, sample_docs: int = 2_000, alarm_rate: float = 0.0005, miss_rate: float = 0.005) -> MarkovModels:
    """Models and threshold from labelled samples.

    ``sample_docs`` documents, those with the smallest hash of the id, give the ordinary strings (words put together
    from the first 40 of each) and the digests; this bound is the only sample, and the base rules look at all documents.  Half of
    the strings, by hash, are counted; the other half, of 20 and more characters, set the threshold: half way
    between the score that ``alarm_rate`` of the ordinary ones reach and that which ``miss_rate`` of the random ones don't,
    and never under the former.  All tables that reach the driver have a fixed size.
    """
    ids = hash_sample(docs.select(doc_id).where(F.col(doc_id).isNotNull()), sample_docs).distinct()
    both = [f(docs, ids, text, doc_id).withColumn("held", F.pmod(F.xxhash64("token"), F.lit(2)) == 1) for f in (random_samples, ordinary_samples)]
    model = models(*(pair_counts(x.where("not held").select("token")) for x in both))
    held = [x.where("held").where(F.length("token") >= 20).select(token_score(F.col("token"), model).alias("score")) for x in both]
    # scores are counted in steps of a hundredth
    steps = [{r["s"]: r["n"] for r in x.groupBy(F.floor(F.col("score") * 100).alias("s")).agg(F.count("*").alias("n")).collect()} for x in held]
    random, ordinary = steps
    low = edge(ordinary, alarm_rate, reverse=True) + 1
    threshold = max(0, low, (low + edge(random, miss_rate)) // 2) / 100
    missed = sum(n for k, n in random.items() if k < threshold * 100) / max(1, sum(random.values()))
    alarms = sum(n for k, n in ordinary.items() if k >= threshold * 100) / max(1, sum(ordinary.values()))
    return replace(model, threshold=threshold, missed=missed, alarms=alarms)


def find_secrets(docs: DataFrame, model: MarkovModels, text: str = "text") -> DataFrame:
    """``docs`` with the array ``secrets`` of all spans, by start, then kind as listed.

    The kinds are assign, access, hex and markov.  A markov span is a run of 20 or more token characters outside
    all base spans whose mean log ratio is at least the model's threshold.  A null text counts as empty and has none; a
    text without a match keeps an empty array.  Rows are judged one by one: repeated rows get the same
    spans, an empty table stays empty.  A column of ``docs`` that is called ``secrets`` is replaced.
    """
    none = F.array().cast(SPANS)
    out = base_matches(docs, text).withColumn("_base", F.concat("_assign", "_access", "_hex"))
    out = out.withColumn("_base", F.when(F.size("_base") > 0, by_start(F.col("_base"))).otherwise(none))
    # base spans are blanked, so that a token beside one is judged by what is left of it
    out = out.withColumn("_rest", rewritten(F.col("_text"), F.col("_base"), lambda n, fresh: F.repeat(F.lit("\x03"), n)))
    rest = F.col("_rest")
    out = out.withColumn("_token", matches(rest, TOKEN, rest.rlike(TOKEN), "markov"))
    judged = F.filter("_token", lambda m: token_score(m["value"], model) >= model.threshold)
    out = out.withColumn("_more", F.when(F.size("_token") > 0, judged).otherwise(none))
    out = out.withColumn("secrets", F.when(F.size("_more") > 0, by_start(F.concat("_base", "_more"))).otherwise(F.col("_base")))
    return out.drop("_text", "_assign", "_access", "_hex", "_token", "_base", "_more", "_rest")


def masked(docs: DataFrame, text: str = "text") -> Column:
    """The text with every secret span replaced by ``<secret>``; overlapping spans count as one.

    A null text stays null.
    """
    return rewritten(F.col(text), F.col("secrets"), lambda n, fresh: F.when(fresh, F.lit("<secret>")).otherwise(F.lit("")))


def secret_digest(docs: DataFrame, model: MarkovModels, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans; one row per row."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["at"].cast("string"), m["to"].cast("string"))), ",")

    found = find_secrets(docs.select(doc_id, text), model, text)
    count = lambda kind: F.size(F.filter("secrets", lambda m: m["kind"] == kind)).cast("long")
    return found.select(
        F.col(doc_id),
        *(count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex", "markov")),
        F.sha2(joined(F.filter("secrets", lambda m: m["kind"] != "markov")), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )
