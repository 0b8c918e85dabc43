"""HTML extraction by template deduction from equivalence classes.

A page is a sequence of tokens: block elements, told apart by their path, and whole text
blocks at a path.  Tokens with the same occurrence vector over the pages of a host form an
equivalence class.  Vectors are never gathered: a vector is known by the sum of a hash of (page,
count) over the distinct pages, which Spark adds up before and after the shuffle, so a host with a
third of all pages costs its tasks no more than any other.

The root class holds what is on every page once.  Its tokens are valid while they come in the same order on
all pages; other classes nest in it by path: a text belongs to a class only if an element of the class
is at or above it.  The tokens of valid classes are the template, what is between them are slots.
Slots of root elements are weighed by the text in them: the innermost one that has most of the host's
text is the main element, whatever its tag or name.  Inside it, template text goes, but for headings and text
with content on both sides, which belong to the article.

Names of tags and classes decide only below the main element (a form, comments) and where no template can
be deduced: a host of few pages takes the template of all pages, if they share one, and else the rules by name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Saved

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
SPACES = re.compile(r"\s+")

# Elements of HTML by their role.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead select".split())
NO_TEXT = frozenset("nav footer aside form button select option head menu dialog label fieldset".split())
NO_TEXT_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header menu nav navbar navigation "
    "newsletter notice notices pager pagination popup promo promoted promotion recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe "
    "toolbar topbar widget widgets contentinfo complementary search modal".split()
)
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup section".split())
#: Containers that are told apart by their number among their like when no word of a name does.
NUMBERED = frozenset("div section table td ul ol".split())
TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold one run of text, and so no article.
RUNS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption address".split())
WORDS = re.compile(r"[\s_-]+")


def digest(text: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))).view(np.int64))


def blocks(page: str, opened: dict[str, list[int]] | None = None, by_name: bool = True) -> Iterator[tuple[str, bool, bool, bool, str, int, int]]:
    """(path, may be content, hinted as none by part of a name, is in a main element, text, characters in links, place).

    An element whose tag, or whole class, id or role says so is no content.  One word of a longer
    name (``entry-header``, ``related-work``) is a hint, and the ids of headings and sections
    in a main element, which are made from their titles, say nothing.  ``opened`` gets the number of
    block elements by path and the place of the first.  Without ``by_name`` tags and names say nothing.
    """
    # (element, path of block elements; for it and those around it: named as no content, main, hinted; numbers of those in it)
    top = ("", "", False, False, False, {})
    stack: list[tuple[str, str, bool, bool, bool, dict[str, int]]] = []
    text: list[str] = []
    linked = [0, 0]  # depth of links, characters in them
    at = clock = 0

    def flush():
        nonlocal clock
        whole = SPACES.sub(" ", "".join(text)).strip()
        chars, linked[1] = linked[1], 0
        text.clear()
        if whole:
            _, path, bad, main, hint, _ = stack[-1] if stack else top
            clock += 1
            yield path, not bad, hint, main, whole, chars, clock

    def plain(part: str) -> None:
        if part:
            part = html.unescape(part)
            text.append(part)
            if linked[0]:
                linked[1] += len(part)

    for m in TOKEN.finditer(page):
        plain(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if m[2]:
            if name == "br":
                text.append(" ")
                continue
            if name not in INLINE:
                yield from flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name in INLINE and any(x[0] not in INLINE for x in stack[k + 1 :]):
                        break
                    linked[0] -= sum(x[0] == "a" for x in stack[k:])
                    del stack[k:]
                    break
                if stack[k][0] in SCOPES and name not in SCOPES and name in ("li", "p", "td", "tr"):
                    break
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                yield from flush()
            continue
        if name not in INLINE:
            yield from flush()
            closes = SAME_LEVEL.get(name, set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes or stack[k][0] == "p" and name in CLOSES_P:
                    linked[0] -= sum(x[0] == "a" for x in stack[k:])
                    del stack[k:]
                    if not closes:
                        break
                elif stack[k][0] in SCOPES or stack[k][0] not in INLINE and not closes:
                    break
        names = [(k.lower(), "".join(v)) for k, *v in NAMED.findall(m[4] or "")]
        tag = name if by_name else ""
        words = sorted({w.lower() for k, v in names for w in WORDS.split(v) if w and not any(c.isdigit() for c in w)})
        _, path, any_bad, inside, any_hint, within = stack[-1] if stack else top
        bad = tag in NO_TEXT or tag == "header" and not inside
        hint = False
        if by_name and name not in ("html", "body", *MAIN) and NO_TEXT_NAMES.intersection(words):
            said = [v.lower() for k, v in names if not (inside and k == "id" and name in HEADINGS)]
            wholes = NO_TEXT_NAMES.intersection(w for v in said for w in v.split())
            bad = bad or bool(wholes - {"header"} if inside else wholes)
            hint = any(NO_TEXT_NAMES.intersection(WORDS.split(v)) for v in said)
        main = by_name and not bad and (name in MAIN or ("role", "main") in names) and name not in INLINE
        if name not in INLINE:
            # the path tells apart what its words alone do not
            number = ""
            if name in NUMBERED and not words:
                within[name] = within.get(name, 0) + 1
                number = f"#{within[name]}" if within[name] > 1 else ""
            path = f"{path}/{'.'.join([name + number + '!' * bad + '?' * hint, *words])}"
            clock += 1
            if opened is not None:
                opened.setdefault(path, [0, clock])[0] += 1
        stack.append((name, path, any_bad or bad, inside or main, any_hint or hint, within if name in INLINE else {}))
        linked[0] += name == "a"
    plain(page[at:])
    yield from flush()


def tag_of(path: str) -> str:
    """The tag of the last element of a path."""
    return re.match(r"\w*", path.rsplit("/", 1)[-1])[0]


def host_of(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def tokens(pages: DataFrame, page_id: str, url: str, page: str, by_name: bool = True) -> DataFrame:
    """host, page, slot, text (null for the element itself), n, place, chars, linked, above, holder, fit, hint, main.

    ``above`` has the paths of the element and of those around it; a ``holder`` may be a main element.  The
    page key tells all different rows apart.
    """
    out = "host string, page long, slot long, text long, n int, place int, chars long, linked long, above array<long>, holder boolean, fit boolean, hint boolean, main boolean"

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            rows = []
            for key, host, x in zip(t["_key"], t["_host"], t[page]):
                opened: dict[str, list[int]] = {"": [1, 0]}
                slots: dict[str, list] = {}
                texts: dict[tuple[str, str], list[int]] = {}
                for path, fit, hint, main, whole, linked, place in blocks(x, opened, by_name):
                    s = slots.setdefault(path, [0, 0, fit, hint, main])
                    s[0] += len(whole)
                    s[1] += min(linked, len(whole))
                    texts.setdefault((path, whole), [0, place])[0] += 1
                for p, (n, place) in opened.items():
                    chars, linked, *flags = slots.get(p, (0, 0, None, None, None))
                    ids = ancestors(p)
                    rows.append((host, key, ids[-1], None, n, place, chars, linked, ids, tag_of(p) not in RUNS, *flags))
                rows += [(host, key, ancestors(p)[-1], digest(f"{p}\n{w}"), n, place, n * len(w), 0, None, None, *slots[p][2:]) for (p, w), (n, place) in texts.items()]
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")], dtype=object)
            # by way of objects, since hashes next to nulls would become doubles and lose their last bits
            missing = frame["text"].isna().to_numpy()
            frame["text"] = pd.arrays.IntegerArray(frame["text"].where(~missing, 0).to_numpy(np.int64), missing)
            yield frame.astype({**dict.fromkeys(("page", "slot", "n", "place", "chars", "linked"), "int64"), **dict.fromkeys(("holder", "fit", "hint", "main"), "boolean")})

    keyed = pages.where(F.col(page).isNotNull()).select(F.xxhash64(page_id, url, page).alias("_key"), host_of(url).alias("_host"), page)
    return keyed.mapInPandas(split, out)


_KNOWN: dict[str, list[int]] = {"": [digest("")]}


def ancestors(path: str) -> list[int]:
    """Digests of a path and of those around it, outermost first; remembered up to a bound."""
    found = _KNOWN.get(path)
    if found is None:
        if len(_KNOWN) > 50_000:
            _KNOWN.clear()
            _KNOWN[""] = [digest("")]
        found = _KNOWN[path] = [*ancestors(path[: path.rindex("/")]), digest(path)]
    return found


def classes(found: DataFrame, saved: Saved, least_pages: int = 5) -> DataFrame:
    """host, slot, text, pages, vector, root, sums and flags of every token of a host.

    Repeated pages count once.  ``root`` tokens are on all pages of a host once, in one order, and there
    are at least ``least_pages``.
    """
    flags = [F.bool_and("fit").alias("fit"), F.bool_or("hint").alias("hint"), F.bool_or("main").alias("main")]
    # only the tokens of pages that repeat are sorted out, by page
    repeated = saved(found.where((F.col("slot") == digest("")) & F.col("text").isNull()).groupBy("page").count().where("count > 1").select("page"))
    once = found
    if not repeated.isEmpty():
        once = found.join(repeated, "page", "left_anti").unionByName(found.join(repeated, "page", "left_semi").distinct())
    vector = F.sum(F.xxhash64("page", "n").cast("decimal(20,0)")).alias("vector")
    sums = [F.count("*").alias("pages"), vector, *[F.sum(c).alias(c) for c in ("chars", "linked")], *flags]
    # what is above a slot depends on the slot alone; as a key it keeps the aggregate on fixed-width buffers
    token = once.groupBy("host", "slot", "text", "above", "holder").agg(*sums)
    page = token.where((F.col("slot") == digest("")) & F.col("text").isNull()).select("host", F.col("vector").alias("whole"), F.col("pages").alias("host_pages"))
    token = saved(token.join(page, "host"))
    # a root token keeps its rank among the root tokens of every page
    key = ["host", "slot", F.coalesce("text", F.lit(0)).alias("text0")]
    rooted = token.where((F.col("vector") == F.col("whole")) & (F.col("pages") >= least_pages)).select(*key)
    ranked = once.select("*", key[2]).join(rooted, ["host", "slot", "text0"], "left_semi")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("host", "page").orderBy("place", "slot", "text0")))
    steady = ranked.groupBy("host", "slot", "text0").agg(F.min("rank").alias("a"), F.max("rank").alias("b")).where("a = b")
    steady = steady.select("host", "slot", "text0", F.lit(True).alias("root"))
    return saved(token.withColumn("text0", F.coalesce("text", F.lit(0))).join(steady, ["host", "slot", "text0"], "left").withColumn("root", F.coalesce("root", F.lit(False))).drop("text0"))


def main_elements(token: DataFrame, template: DataFrame, most: float = 0.7) -> DataFrame:
    """host, slot: the innermost root element with ``most`` of the slot text of the host's pages.

    Slot text is what is no template text and in no link.  With host null, the same for the elements that
    all pages of all hosts have once.
    """
    fixed = template.groupBy("host", "slot").agg(F.sum("chars").alias("fixed"))
    elements = token.where("text is null").join(fixed, ["host", "slot"], "left")
    own = F.greatest(F.col("chars") - F.col("linked") - F.coalesce("fixed", F.lit(0)), F.lit(0))
    under = elements.select("host", own.alias("own"), F.explode("above").alias("slot")).groupBy("host", "slot").agg(F.sum("own").alias("under"))
    elements = elements.join(under, ["host", "slot"]).withColumn("depth", F.size("above"))
    roots = elements.where("root and holder").select("host", "slot", "under", "depth", F.lit(False).alias("general"))
    once = F.bool_and(F.col("vector") == F.col("whole")).alias("once")
    every = elements.groupBy("slot").agg(once, F.sum("pages").alias("pages"), F.sum("under").alias("under"), F.max("depth").alias("depth"), F.max("holder").alias("holder"))
    total = every.where(F.col("slot") == digest("")).select(F.col("pages").alias("all_pages"))
    shared = every.where("once and holder").join(total, every["pages"] == total["all_pages"], "left_semi")
    shared = shared.select(F.lit(None).cast("string").alias("host"), "slot", "under", "depth", F.lit(True).alias("general"))
    both = roots.unionByName(shared).withColumn("name", F.coalesce("host", F.lit("")))
    whole = both.where(F.col("slot") == digest("")).select("name", "general", F.col("under").alias("all"))
    good = both.join(whole, ["name", "general"]).where((F.col("under") >= most * F.col("all")) & (F.col("all") > 0) & (F.col("depth") > 1))
    return good.groupBy("host").agg(F.max_by("slot", F.struct("depth", "under", "slot")).alias("slot"))


def refused_slots(elements: DataFrame, least_pages: int) -> DataFrame:
    """host, slot: slots that are mostly links, in a main element only with a hint.

    A slot on enough of the host's pages is judged there, any other one by all hosts' pages.
    """
    links = (F.col("linked") * 2 > F.col("chars")) & F.col("fit") & (F.col("hint") | ~F.col("main"))
    flags = [F.bool_and("fit").alias("fit"), F.bool_or("hint").alias("hint"), F.bool_or("main").alias("main")]
    every = elements.groupBy("slot").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), *flags).where(links).select("slot")
    rare = elements.where(F.col("fit") & (F.col("pages") < least_pages)).select("host", "slot")
    return elements.where(links & (F.col("pages") >= least_pages)).select("host", "slot").unionByName(rare.join(every, "slot"))


def template_texts(token: DataFrame, least_pages: int, share: float = 0.8) -> DataFrame:
    """host, slot, text, chars: template text, of a class with an element at or above it, or on nearly all pages of its slot.

    Root texts must be valid.  Where nearly all text outside or inside main elements would be template, the
    pages are copies, and it stays.
    """
    token = token.where(F.col("pages") >= least_pages)
    elements = token.where("text is null")
    around = elements.select("host", F.col("slot").alias("up"), F.col("pages").alias("up_pages"), F.col("vector").alias("up_vector"))
    own = elements.select("host", "slot", "above")
    texts = token.where("text is not null").select("host", "slot", "text", "pages", "vector", "chars", "main", "root", "host_pages")
    nested = texts.join(own, ["host", "slot"]).withColumn("up", F.explode("above")).join(around, ["host", "up"])
    of_root = F.col("up") == digest("")
    in_class = (F.col("vector") == F.col("up_vector")) & (~of_root | F.col("root"))
    in_slot = (F.col("up") == F.col("slot")) & (F.col("pages") >= share * F.col("up_pages"))
    template = nested.where(in_class | in_slot).groupBy("host", "slot", "text").agg(F.max("chars").alias("chars"), F.max("main").alias("main"))
    whole = elements.groupBy("host", "main").agg(F.sum("chars").alias("whole"))
    part = template.groupBy("host", "main").agg(F.sum("chars").alias("constant"))
    real = part.join(whole, ["host", "main"]).where(F.col("constant") < share * F.col("whole")).select("host", "main")
    return template.join(real, ["host", "main"]).select("host", "slot", "text", "chars")


def deduce(found: DataFrame, saved: Saved, least_pages: int = 5) -> tuple[DataFrame, DataFrame]:
    """(host, slot) of main elements, host null for the one of all pages, and (page, drop): tokens a page loses."""
    token = classes(found, saved, least_pages)
    template = saved(template_texts(token, least_pages))
    mains = saved(main_elements(token, template))
    links = refused_slots(token.where("text is null"), least_pages).withColumn("text", F.lit(None).cast("long"))
    lost = template.drop("chars").unionByName(links)
    lost = saved(lost.withColumn("text", F.coalesce("text", F.lit(0))).distinct())
    # each page's own tokens meet the template, so a page carries no more than it holds
    mine = found.select("host", "page", "slot", F.coalesce("text", F.lit(0)).alias("text")).join(lost, ["host", "slot", "text"], "left_semi")
    drop = F.collect_set(F.when(F.col("text") == 0, F.col("slot")).otherwise(F.col("text"))).alias("drop")
    return mains, saved(mine.groupBy("page").agg(drop))


def page_text(page: str, main: int | None, general: int | None, drop: frozenset, by_name: bool = True) -> str:
    """Text of a page, given its host's main element, that of all pages, and the tokens it loses."""
    found = [(path, fit, in_main, whole, ancestors(path)) for path, fit, _, in_main, whole, _, _ in blocks(page, None, by_name)]
    chosen = next((m for m in (main, general) if m is not None and any(m in ids for *_, ids in found)), None)
    own = []
    for path, fit, in_main, whole, ids in found:
        if chosen is not None:
            # names of elements around the main one say nothing, those in it do
            depth = ids.index(chosen) if chosen in ids else 0
            fit = depth > 0 and "!" not in path.split("/", depth + 1)[-1] if depth < len(ids) - 1 else depth > 0
        if fit and ids[-1] not in drop:
            own.append((path, in_main, whole))
    # main elements by tag, where there are any, are believed if they hold a fair part of that text
    inside = sum(len(w) for _, m, w in own if m)
    if inside and 3 * inside >= sum(len(w) for _, _, w in own):
        own = [x for x in own if x[1]]
    lost = [digest(f"{path}\n{whole}") in drop for path, _, whole in own]
    kept = [i for i, gone in enumerate(lost) if not gone]
    if not kept:
        # a page of which nothing is left is a copy of others
        return " ".join(whole for *_, whole in own)
    first, last = kept[0], kept[-1]
    article = chosen is not None or any(m for _, m, _ in own)

    def stays(i: int) -> bool:
        return not lost[i] or article and (first < i < last or tag_of(own[i][0]) in TITLES and i < last)

    return " ".join(own[i][2] for i in range(len(own)) if stays(i))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", broadcast_bytes: int = 32 << 20, by_name: bool = True) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``.

    Null and empty pages, and pages without content, give an empty text.  A null url or one
    without a host counts as the host "".  A page whose host has a template gives what is in its main element,
    a page of a host with too few pages what is in the main element of all pages if it has that, any
    other page what its tags and names leave.  Repeated rows are extracted alike and count once in the
    template; an empty table gives an empty result; other columns are not read.  Without ``by_name`` the
    template alone decides.
    """
    saved = Saved(pages.sparkSession)
    mains, drops = deduce(saved(tokens(pages, page_id, url, page, by_name)), saved)
    general = mains.where("host is null").select(F.col("slot").alias("_general"))
    size = mains.agg(F.sum(64 + F.length("host"))).first()[0] or 0
    lists = drops.agg(F.sum(64 + 8 * F.size("drop"))).first()[0] or 0

    def small(df: DataFrame, bytes_: int) -> DataFrame:
        """The side without the pages travels while it is small; else both meet by a shuffle."""
        return F.broadcast(df) if bytes_ <= broadcast_bytes else df

    first = general.first()
    keyed = pages.select(page_id, url, page, host_of(url).alias("_host"), F.xxhash64(page_id, url, page).alias("_key"))
    by_host = mains.where("host is not null").select(F.col("host").alias("_host"), F.col("slot").alias("_main"))
    joined = keyed.join(small(by_host, size), "_host", "left")
    joined = joined.join(small(drops.select(F.col("page").alias("_key"), "drop"), lists), "_key", "left")
    joined = joined.withColumn("_general", F.lit(first["_general"] if first else None).cast("long"))

    @F.pandas_udf("string")
    def content(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, mains, generals, drops in batches:
            rows = zip(texts, mains, generals, drops)
            yield pd.Series([page_text(x, None if m is None else int(m), None if g is None else int(g), frozenset(() if d is None else d.tolist()), by_name) if x else "" for x, m, g, d in rows])

    # nullable longs would travel as doubles and lose their last bits, so slots go as text
    as_text = [F.col(c).cast("string") for c in ("_main", "_general")]
    return joined.select(F.col(page_id), F.col(url), content(F.col(page), *as_text, "drop").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
