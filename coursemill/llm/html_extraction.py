"""Main text of web pages by deducing each host's template from equivalence classes of tokens.

A token is an element by its role (the path of its tags and classes) or a whole block of text. Tokens of one host
that occur equally often on every page have equal occurrence vectors and form an equivalence class; vectors are
compared by hashes of (page, count), so no host is ever gathered. Classes that occur once on nearly every page that
is not empty are the root of the template (pages cut short split it by where they end, so it is put together again).
Other classes are valid with enough tokens, an element among them, and enough pages. Roles are paths, so a class lies
in the slot of the deepest root element above all its tokens; the order of tokens in a slot is not compared. The slot with
the article is chosen once a host by what it holds. Texts of the root (notices that every page repeats) and texts of
valid classes that lie in the article's slot or around it belong to the template, if they are on MIN_PAGES pages; what
remains in the slot is extracted, but for elements that are noise by their tag or name. A name counts if all its words are
known; that of a thing which templates repeat (a header, a notice) only if the element does say the same on pages of its host.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.llm.common import short_batches
from coursemill.llm.tokens import in_steps

# fixed values: element names as HTML defines them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
NOISE_TAGS = frozenset("nav footer aside form button select option textarea iframe dialog menu object canvas audio video head title noscript".split())
# names of what differs from page to page, and of what a template repeats; the rest of a name may only tell its form
OTHER_WORDS = frozenset("ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments menu nav navbar navigation promo promoted related replies reply share sharing sidebar sponsor sponsored".split())
REPEATED_WORDS = frozenset("banner consent cookie cookies footer header masthead modal newsletter notice notices popup social subscribe toolbar widget".split())
FORM_WORDS = frozenset("area bar block body bottom box button buttons column container content count form group head heading icon icons inline inner item items label left link links list main module outer page panel post posts right row section site slot sticky text title top unit wrap wrapper".split())
P_ENDERS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|math)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[!?][^>]*>", re.S | re.I)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
MIN_PAGES = 3  # pages that a template's text is on, at least
ROOT, SUPPORT, SIZE = 0.8, 0.2, 3  # shares of a host's pages that a root class and a nested class are on; tokens of a nested class
BACKED = 0.01  # share of a host's pages, and two pages at least, that an element counted by a repeated word is on
SALTS = 64
HOLDERS = frozenset("html body main article section div center table tbody tr td".split())
PLAIN = frozenset("html body main article".split())  # never noise by name


@dataclass
class Element:
    tag: str
    role: str
    index: int


@dataclass
class Page:
    roles: list[str] = field(default_factory=list)  # of each element that is not inline
    parents: list[int] = field(default_factory=list)
    barred: list[bool] = field(default_factory=list)  # noise by tag
    named: list[int] = field(default_factory=list)  # its name is of OTHER (1) or REPEATED things (2), or neither (0)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, characters in links


def parse(source: str) -> Page:
    page, stack = Page([""], [-1], [False], [0]), [Element("", "", 0)]
    words: list[str] = []
    link_chars, links = 0, 0

    def flush() -> None:
        nonlocal link_chars
        text = " ".join(entities.unescape("".join(words)).split())
        if text:
            page.blocks.append((stack[-1].index, text, link_chars))
        words.clear()
        link_chars = 0

    def text(raw: str) -> None:
        nonlocal link_chars
        words.append(raw)
        link_chars += len(raw) * (links > 0)

    at = 0
    for m in RAW.finditer(source):
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                words.append(" ")
            elif tag == "a":
                links = 0 if m[2] else 1
            continue
        flush()
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in P_ENDERS and stack[-1].tag == "p":
            stack.pop()
        if tag in ("li", "dt", "dd", "tr", "td", "th") and stack[-1].tag in (("li",) if tag == "li" else ("dt", "dd") if tag[0] == "d" else ("td", "th") if tag != "tr" else ("td", "th", "tr")):
            stack.pop()
        names = " ".join(v for n in NAMES.finditer(m[4]) for v in n.groups()[1:] if v).lower() if m[4] else ""
        barred = tag in NOISE_TAGS or (tag == "header" and not any(e.tag in ("article", "main") for e in stack))
        role = f"{stack[-1].role}>{tag}" + "".join(f".{n}" for n in sorted(set(names.split())))
        if tag not in VOID:
            stack.append(Element(tag, role, len(page.roles)))
            page.roles.append(role)
            page.parents.append(stack[-2].index)
            page.barred.append(barred)
            page.named.append(0 if tag in PLAIN else name_kind(names))
    if at < len(source):
        text(source[at:])
    flush()
    return page


def name_kind(names: str) -> int:
    """1 if one of an element's names is of OTHER_WORDS, 2 if of REPEATED_WORDS, 0 if none; all words of it must be known."""
    kinds = {0}
    for name in names.split():
        words = {w for w in re.split(r"[^a-z]+", name) if w}
        if words <= OTHER_WORDS | REPEATED_WORDS | FORM_WORDS:
            kinds.add(1 if words & OTHER_WORDS else 2 if words & REPEATED_WORDS else 0)
    return 1 if 1 in kinds else max(kinds)


def noise(page: Page, slots: set[int], counts: Callable[[int], bool]) -> list[bool]:
    """Whether each element is noise or lies in noise; the slots and what they lie in never are. counts: of named elements, by index."""
    above: set[int] = set()
    for i in slots:
        while i >= 0 and i not in above:
            above.add(i)
            i = page.parents[i]
    out: list[bool] = []
    for i, parent in enumerate(page.parents):
        own = i not in above and (page.barred[i] or (page.named[i] > 0 and counts(i)))
        out.append(own or (parent >= 0 and out[parent]))
    return out


def every(_: int) -> bool:
    return True


def no_name(_: int) -> bool:
    return False


def fullest(page: Page, share: float, holders: bool) -> int:
    """The deepest element with that share of the page's characters that are neither noise by tag nor links.

    holders: no element that is itself a part of a text, such as a paragraph.
    """
    noisy = noise(page, set(), no_name)
    chars = [0] * len(page.roles)
    for element, text, linked in page.blocks:
        if not noisy[element]:
            chars[element] += max(len(text) - linked, 0)
    for i in range(len(chars) - 1, 0, -1):
        chars[page.parents[i]] += chars[i]
    tag = lambda i: page.roles[i].rpartition(">")[2].split(".")[0]
    return max(i for i, n in enumerate(chars) if n >= share * chars[0] and not (holders and i and tag(i) not in HOLDERS)) if chars[0] else 0


def articles(page: Page) -> set[int]:
    """The page's elements of that name; those that lie in no noise first."""
    found = {i for i, r in enumerate(page.roles) if re.search(r">(article|main)(\.[^>]*)?$", r)}
    for counts in (every, no_name):
        noisy = noise(page, set(), counts) if found else []
        clear = {i for i in found if not noisy[i]}
        if clear:
            return clear
    return found


def page_tokens(page: Page) -> list[tuple[str, int, int, str | None]]:
    """(token, count, characters of text in it that are neither noise nor links, role a text lies in); texts start with '#'.

    An element named by a repeated word also gives what it says: its role behind '@' and a digest, with -1 characters.
    """
    chars: Counter[str] = Counter()
    noisy = noise(page, articles(page) or {fullest(page, 0.51, False)}, every)
    kept = [b for b in page.blocks if not noisy[b[0]]]
    for element, text, linked in kept:
        seen: set[str] = set()
        while element >= 0:
            if page.roles[element] not in seen:
                seen.add(page.roles[element])
                chars[page.roles[element]] += max(len(text) - linked, 0)
            element = page.parents[element]
    counts = Counter(page.roles)
    texts = Counter(f"#{t}" for _, t, _ in kept)
    places: dict[str, str] = {}
    for element, text, _ in kept:
        role = page.roles[element]
        places[f"#{text}"] = shared_path(places.get(f"#{text}", role), role)
    said: dict[str, list[str]] = {}
    for element, text, _ in page.blocks if 2 in page.named else ():
        while element >= 0:
            if page.named[element] == 2:
                said.setdefault(page.roles[element], []).append(text)
            element = page.parents[element]
    words = [(f"@{r}\n{hashlib.md5(chr(10).join(t).encode()).hexdigest()}", 1, -1, None) for r, t in said.items()]
    return [(r, n, chars[r], None) for r, n in counts.items() if r] + [(t, n, 0, places[t]) for t, n in texts.items()] + words


def shared_path(a: str, b: str) -> str:
    """The deepest role above both."""
    if a == b:
        return a
    same = [x for x, y in zip(a.split(">"), b.split(">"), strict=False) if x == y]
    while same != a.split(">")[: len(same)] or same != b.split(">")[: len(same)]:
        same.pop()
    return ">".join(same)


def tokens(pages: DataFrame) -> DataFrame:
    """host, page_key, token, count, chars, place; a text is known by its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_steps(batch, "html", 1 << 20):
                rows = [(h, p, *t) for h, p, s in zip(part.column("host").to_pylist(), part.column("page_key").to_pylist(), part.column("html").to_pylist(), strict=True) for t in page_tokens(parse(s or ""))]
                if rows:
                    yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["host", "page_key", "token", "count", "chars", "place"])

    rows = pages.select("host", "page_key", "html").mapInArrow(run, "host string, page_key long, token string, count long, chars long, place string")
    return rows.withColumn("token", F.when(F.col("token").startswith("#"), F.concat(F.lit("#"), F.md5("token"))).otherwise(F.col("token")))


def occurrences(tokens: DataFrame) -> DataFrame:
    """host, token, vector (equal for tokens of one class), pages, most (largest count on a page), chars, place (least and last role of a text)."""
    at = F.xxhash64("page_key", "count")
    # the sum keeps rows apart that share a key, which cancel out in the exclusive or
    vector = F.xxhash64(F.bit_xor(at), F.sum(F.shiftright(at, 31)), F.count("*"))
    return tokens.groupBy("host", "token").agg(vector.alias("vector"), F.count("*").alias("pages"), F.max("count").alias("most"), F.sum("chars").alias("chars"), F.min("place").alias("low"), F.max("place").alias("high"))


def equivalence_classes(seen: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row a valid class: host, of, root, members (token, chars, low, high, pages), of seen tokens (see occurrences).

    sizes: host, of (pages that are not empty). A member is on a share of the pages, so the members of all classes of a
    host are at most 1 / SUPPORT times those of a page. Rows with a ``role`` and no members are the elements named by a repeated
    word that say the same on most of the pages they are on, and on two at least.
    """
    # no token of one page is on enough pages of a host with more, and main_text deduces a lone page's slot itself
    rows = seen.join(sizes, "host").withColumn("role", F.when(F.col("chars") < 0, F.expr("substring(substring_index(token, '\n', 1), 2)")))
    rows = rows.withColumns({"root": F.expr(f"role is null and most = 1 and pages >= {ROOT} * of"), "wide": F.expr(f"role is null and pages >= greatest({MIN_PAGES}, of * {SUPPORT})")})
    rows = rows.where("role is not null or pages > 1 and (root or wide)").withColumn("vector", F.when(F.col("role").isNull(), F.col("vector")))
    member = F.struct("token", "chars", F.coalesce("low", "token").alias("low"), F.coalesce("high", "token").alias("high"), "pages")
    classes = rows.groupBy("host", "of", "root", "wide", "role", "vector").agg(F.collect_list(F.when(F.col("role").isNull(), member)).alias("members"), F.sum("pages").alias("all"), F.max("pages").alias("same"))
    elements = F.exists("members", lambda m: ~m["token"].startswith("#"))
    says = F.expr(f"same > 1 and 2 * same >= all and all >= of * {BACKED}")
    valid = F.col("root") | (F.col("wide") & (F.size("members") >= SIZE) & elements)
    return classes.where(F.when(F.col("role").isNull(), valid).otherwise(says)).drop("vector", "wide", "all", "same")


def templates(pages: DataFrame) -> DataFrame:
    """A row a host: pages, slot (role of the article's element, null if none), texts (digests of template texts), backed (roles)."""
    sizes = pages.where(r"html rlike '\\S'").groupBy("host").agg(F.count("*").alias("of"))
    members = equivalence_classes(occurrences(tokens(pages)), sizes).groupBy("host").agg(
        F.max("of").alias("of"),
        F.flatten(F.collect_list(F.when(F.col("root"), F.col("members")))).alias("members"),
        F.collect_list(F.when(~F.col("root") & F.col("role").isNull(), F.col("members"))).alias("nested"),
        F.collect_list("role").alias("backed"),
    )
    is_text = lambda m: m["token"].startswith("#")
    per = members.select(
        "host",
        "of",
        "nested",
        "backed",
        F.filter("members", lambda m: ~is_text(m)).alias("roles"),
        F.transform(F.filter("members", lambda m: is_text(m) & (m["pages"] >= MIN_PAGES)), lambda m: m["token"]).alias("texts"),
    ).withColumn("best", F.array_max(F.transform("roles", lambda r: r["chars"])))
    named = F.filter("roles", lambda r: r["token"].rlike(r">(article|main)(\.[^>]*)?$") & (r["chars"] > 0))
    rich = F.filter("roles", lambda r: (r["chars"] >= 0.8 * F.col("best")) & (r["chars"] > 0))
    by_depth = lambda c: F.element_at(F.array_sort(F.transform(c, lambda r: F.struct((-F.size(F.split(r["token"], ">"))).alias("d"), r["token"].alias("t")))), 1)["t"]
    by_chars = lambda c: F.element_at(F.array_sort(F.transform(c, lambda r: F.struct((-r["chars"]).alias("n"), F.size(F.split(r["token"], ">")).alias("d"), r["token"].alias("t")))), 1)["t"]
    slot = F.when(F.size(named) > 0, by_chars(named)).when(F.size(rich) > 0, by_depth(rich))
    per = per.withColumn("slot", slot).withColumn("root_roles", F.transform("roles", lambda r: r["token"]))
    inner = F.udf(lambda c, r, s: nested_texts(c, r, s), "array<string>")("nested", "root_roles", "slot")
    return per.select("host", F.col("of").alias("pages"), "slot", F.array_union("texts", inner).alias("texts"), "backed")


def nested_texts(classes: list, roles: list[str], slot: str | None) -> list[str]:
    """Texts of the classes whose slot, the deepest root element above all members, is the article's, or in it or around it."""
    known, out = set(roles), []
    for members in classes:
        place = members[0]["low"]
        for m in members:
            place = shared_path(shared_path(place, m["low"]), m["high"])
        while place and place not in known:
            place = place.rpartition(">")[0]
        if not slot or f"{place}>".startswith(f"{slot}>") or f"{slot}>".startswith(f"{place}>"):
            out += [m["token"] for m in members if m["token"].startswith("#")]
    return out


def main_text(source: str, slot: str | None, texts: set[str], backed: set[str] = frozenset()) -> str:
    """Blocks of the slot (else of the page's own article, else of what holds most of its text) that are neither noise nor template.

    An element named by a repeated word is noise only if its role is backed: the same on pages of the host.
    """
    page = parse(source)
    inside = [False] * len(page.roles)
    start = {i for i, r in enumerate(page.roles) if r == slot} if slot else set()
    named = articles(page)
    start = start or named or {fullest(page, 0.8, True)}
    noisy = noise(page, start if named else start | {fullest(page, 0.51, False)}, lambda i: page.named[i] == 1 or page.roles[i] in backed)
    for i, parent in enumerate(page.parents):
        inside[i] = i in start or (parent >= 0 and inside[parent])
    kept = [t for e, t, _ in page.blocks if inside[e] and not noisy[e]]
    if texts:
        left = [t for t in kept if "#" + hashlib.md5(f"#{t}".encode()).hexdigest() not in texts]
        kept = left or kept  # a host of equal pages has no slot that varies; its article is what they share
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of pages (page_id, url, html).

    More columns are ignored. Null html is empty and gives an empty text; a null url is the host ''. Rows that share a
    page_id, and repeated pages, each give a row. Pages cut off in the middle are read as far as they go. An empty
    table gives no rows.
    """
    short_batches(pages.sparkSession)
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    rows = pages.select("page_id", "url", "html", host.alias("host"), F.xxhash64("page_id", "url", "html").alias("page_key"))
    salted = templates(rows).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    spread = rows.withColumn("salt", F.pmod("page_key", F.lit(SALTS)).cast("int"))
    joined = spread.join(salted.hint("shuffle_hash"), ["host", "salt"], "left").select("page_id", "url", "html", "slot", "texts", "backed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_steps(batch, "html", 1 << 20):
                given = zip(*(part.column(n).to_pylist() for n in ("html", "slot", "texts", "backed")), strict=True)
                out = [main_text(s or "", slot, set(t or ()), set(b or ())) for s, slot, t, b in given]
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
