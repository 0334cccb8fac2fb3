"""HTML main-text extraction by wrappers inferred for each host.

A page is a stream of tokens: opening and closing tags, text. All streams of a host are aligned by the path
of kinds (tag, first class, marks) that leads to a token. Where two streams differ, the wrapper gives way: a
token that some pages lack becomes optional, one that a page has several times in a row a repeated group, a
text that differs a slot. What a path holds does not depend on the order in which pages are aligned, so each
task aligns the pages that it has and the partial wrappers are merged by path: a host's wrapper is inferred
from all its pages, and no host is gathered anywhere. ``expressions`` shows wrappers as union-free regular
expressions.

A page's text is then read with its host's wrapper. Slots are main text, and so is a repeated group of an
article, whose members differ among themselves. Not main text are constants, optional or not (a menu, a
notice, a footer, whatever it is called), and, outside articles or under a name that may mean anything
(related, share, banner), slots that are mostly links. What tags and clear class names say (nav, form, adverts,
reader comments) is taken from the page; the names that may mean anything only rule text out where the wrapper
cannot tell, on hosts with fewer than PAGES_A_CONSTANT different pages.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, scratch, settle

#: Different pages that must agree before a text counts as constant: two may be copies of one article.
PAGES_A_CONSTANT = 3
#: Paths that a task holds at once before it passes on what it has aligned.
PATHS = 50_000
#: Share of characters in links from which a slot outside an article is a menu.
LINKED = 0.5
#: Bytes of wrappers that go to every task at once; more are joined, a host's pages dealt to SALTS tasks.
WRAPPER_BYTES, SALTS = 1 << 25, 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is not markup.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open one of these ends when one of its kind begins, unless one of the others lies between.
_ENDS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _ENDS.items()}
#: Elements that never hold main text; those of the second line only if they are closed at all.
DROPPED = frozenset("nav footer aside form button dialog menu head".split())
EMBEDDED = frozenset("svg math object select template noscript audio video canvas".split())
#: Words of a class, id or role that mark what is not main text: clear ones, and ones that may mean anything.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer "
    "cookie cookies consent gdpr popup modal overlay comment comments disqus reply replies respond newsletter subscribe signup login pagination pager "
    "complementary contentinfo toolbar alert notice notices".split()
)
VAGUE = frozenset("banner recommended related search share sharing social widget widgets".split())
REMARKS = frozenset("comment comments reply replies".split())
#: Marks that a paragraph may carry as a style.
STYLES = frozenset("alert notice notices".split())
#: Words that say nothing beside a mark: a name counts as marked only if all its words are marks or these.
_PLAIN = frozenset(
    "area bar block body bottom box button buttons col column container content count entry form group header inner item items left line link links list "
    "main module number outer page pages panel post posts right row section site slot text thread title top unit wrap wrapper".split()
)
#: Marks of a page's header, which an article may have too (its title stands there).
_HEADS = frozenset({"header", "masthead"})
_NAMED = re.compile(r"(?>([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?>\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]*+)))?|=)")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?>[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?>\"[^\"]*+\"?|'[^']*+'?|[^\s>]*+))?|=)*+)>?+")
_OTHER = re.compile(r"<[!?][^>]*+>?+")


def events(page: str) -> list[tuple]:
    """The page's tokens in order: (0, text), (1, name, attributes, whether it is empty), (2, name)."""
    out: list[tuple] = []
    lower, absent, at, size = None, set(), 0, len(page)
    while at < size:
        if page[at] != "<":
            end = page.find("<", at)
            end = size if end < 0 else end
            out.append((0, page[at:end]))
            at = end
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        m = _TAG.match(page, at)
        if m is None:
            m = _OTHER.match(page, at)
            if m is None:
                out.append((0, "<"))
                at += 1
            else:
                at = m.end()
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            out.append((2, name))
            continue
        alone = m[3].endswith("/") or name in VOID
        if name in RAW:
            if not alone and name not in absent:
                lower = page.lower() if lower is None else lower
                if len(lower) != size:  # a letter changed its length: search the page itself
                    lower = re.sub("[A-Z]", lambda x: x[0].lower(), page)
                end = lower.find(f"</{name}", at)
                if end < 0:
                    absent.add(name)
                else:
                    close = page.find(">", end)
                    at = size if close < 0 else close + 1
            continue
        out.append((1, name, m[3], alone))
    return out


def _nested(tokens: list[tuple]) -> tuple[list[tuple], dict[int, bool], set[int]]:
    """Balanced tokens (0, text), (1, place, name, attributes), (2, place); which were closed by their own end; forms around an article."""
    out: list[tuple] = []
    stack: list[tuple[int, str]] = []
    count: dict[str, int] = {}
    closed: dict[int, bool] = {}
    around: set[int] = set()

    def pop(own: bool = False) -> None:
        place, name = stack.pop()
        count[name] -= 1
        closed[place] = own
        out.append((2, place))

    for i, token in enumerate(tokens):
        if token[0] == 0:
            out.append(token)
        elif token[0] == 2:
            name = token[1]
            if count.get(name):
                while stack[-1][1] != name:
                    pop()
                pop(True)
        else:
            _, name, attributes, alone = token
            if name in BLOCKS and count.get("p") or name in _ENDS and any(count.get(x) for x in _ENDS[name][0]):
                ends, stops = _ENDS.get(name, (frozenset(), frozenset()))
                for k in range(len(stack) - 1, -1, -1):
                    other = stack[k][1]
                    if other in ends or other == "p" and name in BLOCKS:
                        while len(stack) > k:
                            pop()
                        if not (name in _ENDS and other == "p"):
                            break
                    elif other in stops or other in BLOCKS and name not in _ENDS:
                        break
            if name in ("article", "main", "h1"):
                around.update(place for place, other in stack if other == "form") if count.get("form") else None
            out.append((1, i, name, attributes))
            if alone:
                closed[i] = True
                out.append((2, i))
            else:
                stack.append((i, name))
                count[name] = count.get(name, 0) + 1
    while stack:
        pop()
    return out, closed, around


def _marked(names: list[str], marks: frozenset) -> bool:
    for name in names:
        words = re.split(r"[-_]+", name)
        if any(w in marks for w in words) and all(w in marks or w in _PLAIN or w.isdigit() for w in words if w):
            return True
    return False


class _Kind:
    """What a tag says of itself."""

    __slots__ = ("sign", "bad", "vague", "head", "inside")
    known: dict[tuple[str, str], _Kind] = {}

    def __init__(self, name: str, attributes: str):
        found = {k.lower(): a or b or c or "" for k, a, b, c in _NAMED.findall(attributes) if k} if attributes else {}
        names = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".lower().split()
        whole = name in ("body", "html", "main")
        marks = REMARKS if name == "article" else MARKS - STYLES if name == "p" else MARKS
        unseen = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
        marked = not whole and name not in HEADINGS and _marked(names, marks)
        self.vague = not whole and name not in HEADINGS and name not in ("p", "article") and _marked(names, MARKS | VAGUE) and not marked
        self.bad = unseen or marked or name in DROPPED or name in EMBEDDED
        self.head = name == "header" or _marked(names, _HEADS)
        self.inside = name in ("article", "main") and not self.bad
        # a class that numbers its element is one kind
        self.sign = f"{name}.{re.sub('[0-9]+', '0', names[0])}" if names else name
        if unseen or marked:
            self.sign += " !"

    @classmethod
    def of(cls, name: str, attributes: str) -> _Kind:
        key = (name, attributes)
        if (kind := cls.known.get(key)) is None:
            if len(cls.known) > 20_000:
                cls.known.clear()
            kind = cls(name, attributes)
            if len(attributes) < 200:
                cls.known[key] = kind
        return kind


def _below(path: int, sign: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path} {sign}") - (1 << 63)


def read(page: str) -> tuple[list[tuple], list[tuple]]:
    """The page's blocks (path, text, characters in links, vague, inside an article) and its elements (path, parent, sign).

    A path is a 64-bit hash of the kinds that lead to a block. Blocks that the page's own tags and clear marks
    rule out are left out; if the page has an article, so is what lies outside.
    """
    nested, closed, around = _nested(events(page))
    blocks: list[tuple] = []
    elements: list[tuple] = []
    here: list[str] = []
    linked = 0
    # (place, path of the block, bad, vague, inside, link, whether it is a block)
    stack = [(-1, 0, False, False, False, False, True)]

    def flush() -> None:
        nonlocal linked
        if here:
            if told := " ".join(entities.unescape("".join(here)).split()):
                _, path, _, vague, inside, _, _ = stack[-1]
                blocks.append((path, told, linked, vague, inside))
            here.clear()
        linked = 0

    for token in nested:
        if token[0] == 0:
            if not stack[-1][2]:
                here.append(token[1])
                if stack[-1][5]:
                    linked += len(token[1])
        elif token[0] == 1:
            _, place, name, attributes = token
            if name == "br":
                here.append("\n") if here else None
            if name in VOID and name != "hr":
                continue
            kind = _Kind.of(name, attributes)
            _, path, bad, vague, inside, link, _ = stack[-1]
            own = kind.bad and not (name in EMBEDDED and not closed[place]) and not (name == "form" and place in around)
            new = name in BLOCKS or own or kind.vague or kind.head
            if new:
                flush()
                own_path = _below(path, kind.sign)
                elements.append((own_path, path, kind.sign))
                path = own_path
            inside = inside or kind.inside and not bad
            stack.append((place, path, bad or own or kind.head and not inside, vague or kind.vague, inside, link or name == "a", new))
        elif stack[-1][0] == token[1]:
            if stack[-1][6]:
                flush()
            stack.pop()
    flush()
    if any(e[2].split(".")[0] in ("article", "main") for e in elements) and any(b[4] for b in blocks):
        blocks = [b for b in blocks if b[4]]
    return blocks, elements


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(path, text) of each block that the page's own tags and marks leave, in page order."""
    return [b[:2] for b in read(page)[0]]


def main_text(page: str, known: dict[int, bool] | None = None) -> str:
    """The page's main text: blocks in page order, joined by one line feed.

    ``known`` is its host's wrapper: path -> whether it holds main text. Without one, and for paths that it
    does not have, what vague names mark is left out.
    """
    known = known or {}
    return "\n".join(told for path, told, _, vague, _ in read(page)[0] if known.get(path, not vague))


def host_of(url):
    """Host of a URL, as a column; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


_FACTS = "host string, path bigint, parent bigint, sign string, at bigint, pages bigint, lo bigint, hi bigint, texts bigint, most bigint, chars bigint, links bigint, vague boolean, inside boolean, seen array<bigint>"


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row for each path of each host's wrapper, inferred from all its pages.

    ``path, parent, sign, at`` say where it stands; ``optional`` if some page of the host lacks it,
    ``repeated`` if some page has it several times; ``text`` is slot, constant or null (no text of its own);
    ``vague`` marks a name that may mean anything, ``main`` tells whether its text is main text. Copies of a page count as one page for a constant.
    """
    own = pages.where(F.col(html).isNotNull()).select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"), F.xxhash64(html).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        kinds = (pa.string(), *[pa.int64()] * 2, pa.string(), *[pa.int64()] * 8, pa.bool_(), pa.bool_(), pa.list_(pa.int64()))

        def out() -> pa.RecordBatch:
            rows = [(*key, *(list(x) if isinstance(x, set) else x for x in row)) for key, row in held.items()]
            held.clear()
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _FACTS.split(", ")])

        def add(key: tuple, parent: int, sign: str, at: int) -> list:
            if (now := held.get(key)) is None:
                now = held[key] = [parent, sign, at, 0, None, None, 0, 0, 0, 0, False, False, set()]
            now[2] = min(now[2], at)
            return now

        for batch in batches:
            for host, page, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks, elements = read(page)
                kinds_of, times = {}, {}
                for at, (path, parent, sign) in enumerate(elements):
                    kinds_of.setdefault(path, (parent, sign, at))
                    times[path] = times.get(path, 0) + 1
                for path, (parent, sign, at) in kinds_of.items():
                    now = add((host, path), parent, sign, at)
                    now[3] += 1
                    now[7] = max(now[7], times[path])
                texts: dict[int, list] = {}
                for path, told, links, vague, inside in blocks:
                    texts.setdefault(path, []).append(told)
                    now = add((host, path), 0, "", 1 << 40)  # its element, if there is one, comes before
                    now[8] += len(told)
                    now[9] += links
                    now[10], now[11] = now[10] or vague, now[11] or inside
                for path, told in texts.items():
                    now, value = held[host, path], xxhash.xxh3_64_intdigest("\n".join(told)) - (1 << 63)
                    now[4] = value if now[4] is None else min(now[4], value)
                    now[5] = value if now[5] is None else max(now[5], value)
                    now[6] = max(now[6], len(told))
                    if len(now[12]) < PAGES_A_CONSTANT:
                        now[12].add(h)
                if len(held) > PATHS:
                    yield out()
        yield out()

    facts = in_batches(own, run, _FACTS).groupBy("host", "path").agg(
        *(f(c).alias(c) for f, c in ((F.min, "parent"), (F.max, "sign"), (F.min, "at"), (F.sum, "pages"), (F.min, "lo"), (F.max, "hi"), (F.max, "texts"))),
        *(f(c).alias(c) for f, c in ((F.max, "most"), (F.sum, "chars"), (F.sum, "links"), (F.bool_or, "vague"), (F.bool_or, "inside"))),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.slice("seen", 1, PAGES_A_CONSTANT))))).alias("seen"),
    )
    enough = F.col("seen") >= PAGES_A_CONSTANT
    constant = enough & (F.col("lo") == F.col("hi")) & ~(F.col("inside") & (F.col("texts") > 1))
    menu = enough & (~F.col("inside") | F.col("vague")) & (F.col("links") >= LINKED * F.col("chars"))
    judged = facts.select(
        "host", "path", "parent", "sign", "at", "pages", (F.col("most") > 1).alias("repeated"), "vague",
        F.when(F.col("lo").isNotNull(), F.when(constant, "constant").otherwise("slot")).alias("text"),
        F.when(F.col("lo").isNotNull(), ~constant & ~menu & (enough | ~F.col("vague"))).alias("main"),
    )
    # a host none of whose texts differ has no slot that would tell its main text, so its constants are kept
    whole = judged.groupBy("host").agg(F.max("pages").alias("of"), F.coalesce(F.bool_or(F.col("text") == "slot"), F.lit(False)).alias("told"))
    return judged.join(whole, "host").select(
        "host", "path", "parent", "sign", "at", (F.col("pages") < F.col("of")).alias("optional"), "repeated", "text", "vague", (F.col("main") | ~F.col("told") & (F.col("text") == "constant")).alias("main")
    )


def expressions(wrapper: DataFrame) -> DataFrame:
    """(host, expression): wrappers as union-free regular expressions: (x)? optional, (x)+ repeated, # a slot, = a constant.

    For reading: a host's paths, as many as its template has, meet in one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch["parts"].to_pylist():
                inside: dict[int, list[dict]] = {}
                for p in sorted(parts, key=lambda p: (p["at"], p["path"])):
                    if p["path"]:  # 0 is text outside every element
                        inside.setdefault(p["parent"], []).append(p)
                shown: list[str] = []
                todo: list = [p for p in reversed(inside.get(0, []))]
                while todo:
                    p = todo.pop()
                    if isinstance(p, str):
                        shown.append(p)
                        continue
                    name = p["sign"].split(".")[0].split(" ")[0]
                    end = f"</{name}>)" + "+" * p["repeated"] + "?" * p["optional"]
                    shown.append(f"(<{p['sign']}>" + {"slot": "#", "constant": "="}.get(p["text"], ""))
                    todo += [end, *reversed(inside.get(p["path"], []))]
                out.append("".join(shown))
            yield pa.RecordBatch.from_arrays([batch["host"], pa.array(out, pa.string())], ["host", "expression"])

    rows = wrapper.groupBy("host").agg(F.collect_list(F.struct("path", "parent", "sign", "at", "optional", "repeated", "text")).alias("parts"))
    return in_batches(rows, run, "host string, expression string")


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) of every page's main text, from its whole html.

    A null or empty page has an empty text; a page without a usable URL belongs to the host named by the
    empty string; repeated rows are pages of their own; an empty table stays empty; further columns are
    ignored. Character references are decoded, white space within a block becomes one space. Tags that do
    not close are closed where their parent ends, raw elements without an end are taken as empty. Pages are
    read where they lie; the wrappers' verdicts go to them as long as they are small.
    """
    with scratch(pages.sparkSession):
        # what a page would decide by itself need not travel
        told = wrappers(pages, url, html).where("main IS NOT NULL AND main = vague")
        told = told.groupBy("host").agg(F.collect_list(F.when(~F.col("main"), F.col("path"))).alias("out"), F.collect_list(F.when(F.col("main"), F.col("path"))).alias("kept"))
        verdicts = settle(told.select("host", F.to_json(F.struct("out", "kept")).alias("paths")), outlast=True)
    rows = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    size = verdicts.agg(F.sum(F.octet_length("host") + F.octet_length("paths"))).first()[0] or 0
    sent = None
    if size <= WRAPPER_BYTES:
        found = verdicts.toArrow().to_pydict()
        sent = pages.sparkSession.sparkContext.broadcast(dict(zip(found["host"], found["paths"], strict=True)))
        rows = rows.withColumn("paths", F.lit(None).cast("string"))
    else:
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
        rows = rows.withColumn("salt", salt).join(verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    rows = rows.select("page_id", "url", "html", "host", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts = sent.value if sent is not None else {}
        seen: dict = {}
        for batch in batches:
            out = []
            for text, host, paths in zip(*(batch[c].to_pylist() for c in ("html", "host", "paths")), strict=True):
                paths = paths or hosts.get(host)
                if paths not in seen:
                    if len(seen) > 1000:
                        seen.clear()
                    told = json.loads(paths) if paths else {}
                    seen[paths] = dict.fromkeys(told.get("out") or (), False) | dict.fromkeys(told.get("kept") or (), True)
                out.append(main_text(text, seen[paths]) if text else "")
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(out, pa.string())], ["page_id", "url", "text"])

    kinds = f"page_id {pages.schema[page].dataType.simpleString()}, url {pages.schema[url].dataType.simpleString()}, text string"
    return in_batches(rows, run, kinds)
