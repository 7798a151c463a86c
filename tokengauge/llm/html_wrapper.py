"""Main text of web pages by wrappers inferred from pages of the same host (union-free regular expressions).

A page's tags form a stream whose text is reduced to slots. Equal neighbours fold into a repeated group. Numbers and hash-like
parts of class and id names are left out, so that the slots of a host's pages agree. Slots carry how much text and link text
they held on how many pages; they are counted inside the partitions first and then summed by host and path, so no task
holds the slots of a whole host. A host's wrapper is the tree of the slots on at least one page in ``FREQUENT`` of the host, in page
order: slots that some of its pages lack are optional groups, those that a page repeats are repeated groups. So it has
at most ``FREQUENT`` times as many slots as a page. The slots that hold articles are chosen, by the meaning of their tags
and, where a page has no article element, all that are neither furniture nor, outside the area that holds most of the host's text,
repeated slots of links; pages are read through these slots.

What a slot holds unchanged on many pages belongs to the template, whatever its name: a text that at least 90 % of the
pages with its slot have, at least one in ``FREQUENT`` of the host and three that differ in the rest of their text. Copies of
one page do not differ and so say nothing about it. An element outside articles that holds nothing but template texts is left out, unless the
page has no other; a heading or paragraph goes only with all that its element holds. Inside articles all but furniture stays.

Wrappers are stored by shards in the shared folder, and a task that reads pages loads the shards it needs.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter, OrderedDict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shared_path
from .common import slices, text_bytes

#: Average hosts of a shard, and shards that a worker keeps.
SHARD_HOSTS, SHARDS_KEPT = 256, 64
#: A slot belongs to the wrapper if one in so many pages of the host has it.
FREQUENT = 100
#: Counts that a task gathers before it passes them on.
COUNTS_HELD = 200_000
#: Pages with otherwise different text that must share a text before it counts as template.
WITNESSES = 3
#: Below this depth a path names only the elements that decide between furniture, main area and article.
NAMED_DEPTH = 60

# Element names of the HTML standard, and words that mark page furniture in class and id names.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|template|iframe|svg"
FURNITURE = frozenset("head nav footer aside form menu button select dialog".split())
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote details div dl dd dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
FURNITURE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|aside|footer|"
    r"masthead|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|paywall|share|sharing|social|comments?|"
    r"replies|reply|respond|disqus|related|recommend(?:ed|ations)?|trending|login|signup|search|widget|toolbar|skip-link|pagination|pager)(?:$|[\s_-])",
    re.I,
)
HEADER_NAME = re.compile(r"(?:^|[\s_-])(?:header|site-header|top-?bar)(?:$|[\s_-])", re.I)
FURNITURE_ROLE = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
ARTICLE_NAME = re.compile(r"(?:^|[\s_-])(?:article|articlebody|article-body|post|post-body|post-content|entry|entry-content|story)(?:$|[\s_-])", re.I)
MAIN_NAME = re.compile(r"(?:^|[\s_-])main-content(?:$|[\s_-])", re.I)

#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<(?:{RAW})(?:\s(?:[^>\"'/]|/(?!>)|\"[^\"]*\"|'[^']*')*(?<=[\s\"']))?/>|<({RAW})\b[^>]*>.*?(?:</\1\s*>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\s+|/)(?:[^>\"']|\"[^\"]*\"|'[^']*')*)?>", re.S | re.I
)
_CUT = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)


_PART = re.compile(r"[^\W_]+")
_UNSAFE = re.compile(r"[^\w#-]")


@lru_cache(1 << 16)
def plain_name(name: str) -> str:
    """A class or id name without what differs from page to page: numbers, and parts that look like hashes."""
    def part(m: re.Match) -> str:
        x = m[0]
        if x.isalpha():
            return "#" if len(x) >= 8 and not x.lower().strip("abcdef") else x
        word = x.rstrip("0123456789")
        return (word if word.isalpha() and len(x) - len(word) < 6 else "") + "#"

    return _UNSAFE.sub("_", _PART.sub(part, name))


def _name(tag: str, attributes: str) -> str:
    """Token of an element: its tag, and marks for furniture (!), main areas (*), articles (**) and headers (^)."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        mark = "!" if tag in FURNITURE else "**" if tag == "article" else "*" if tag == "main" else "^" if tag == "header" else ""
        return tag + mark
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    names = f"{got.get('class', '')} {got.get('id', '')}"
    role = got.get("role", "").lower()
    if tag in FURNITURE or role in FURNITURE_ROLE or "hidden" in got or (tag not in ("html", "body", "main") and FURNITURE_NAME.search(names)):
        mark = "!"
    elif tag == "article" or role == "article" or got.get("itemprop", "").lower() == "articlebody" or ARTICLE_NAME.search(names):
        mark = "**"
    elif tag == "main" or role == "main" or MAIN_NAME.search(names):
        mark = "*"
    elif tag == "header" or HEADER_NAME.search(names):
        mark = "^"
    else:
        mark = ""
    first = names.split()
    return f"{tag}.{plain_name(first[0])}{mark}" if first else tag + mark


def blocks(page: str) -> list[tuple[str, str, int]]:
    """(path, text, characters of links) of the text blocks in page order; the path names the open elements that are not inline.

    Missing end tags are supplied as browsers do for heads, paragraphs, items and cells; an article or main element ends
    whatever furniture was left open before it; a page that stops in the middle ends all elements. A form, and furniture
    without an end tag of its own, is no furniture where it holds most of the page's text.
    """
    # Elements in the order of their start tags, so parents come first: [tag, token, whether its mark may be wrong, parent, depth, text].
    elements: list[list] = [["", "", False, 0, 0, 0]]
    out: list[tuple[int, str, int]] = []
    stack: list[list] = []
    places: list[int] = [0]
    open_tags: Counter = Counter()
    text: list[str] = []
    links = open_links = 0

    def flush() -> None:
        nonlocal links
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((places[-1], joined, links))
            text.clear()
        links = 0

    def pop() -> list:
        places.pop()
        open_tags[stack[-1][0]] -= 1
        return stack.pop()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            if stack and stack[-1][0] == "head" and piece.strip():
                flush()
                pop()[2] = False
            text.append(piece)
            if open_links:
                links += len(piece.strip())
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if stack and stack[-1][0] == "head" and not m[2] and tag not in IN_HEAD:
            pop()[2] = False
        if tag in INLINE:
            if tag == "a":
                open_links = 0 if m[2] else 1
            elif tag == "br":
                text.append(" ")
            continue
        flush()
        open_links = 0
        if m[2]:
            if open_tags[tag]:
                while stack[-1][0] != tag:
                    pop()
                ended = pop()
                ended[2] = ended[2] and tag == "form"
            continue
        while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
            pop()[2] = False
        token = _name(tag, m[4] or "")
        if tag in ("article", "main") and token.endswith("*") and not any(e[1].endswith("*") for e in stack):
            first = next((i for i, e in enumerate(stack) if e[1].endswith("!")), len(stack))
            while len(stack) > first:
                pop()
        if tag not in VOID and not (m[4] or "").endswith("/"):
            stack.append([tag, token, token.endswith("!"), places[-1], len(stack) + 1, 0])
            places.append(len(elements))
            elements.append(stack[-1])
            open_tags[tag] += 1
    if at < len(page):
        piece = _CUT.split(page[at:], maxsplit=1)[0]  # a tag cut off at the end is no text
        if stack and stack[-1][0] == "head" and piece.strip():
            pop()[2] = False
        text.append(piece)
    flush()
    if any(e[2] for e in elements):
        # text outside certain furniture, summed from the innermost elements outwards
        certain = [False]
        for e in elements[1:]:
            certain.append(certain[e[3]] or (e[1].endswith("!") and not e[2]))
        for place, block, _ in out:
            if not certain[place]:
                elements[place][5] += len(block)
        for e in reversed(elements[1:]):
            elements[e[3]][5] += e[5]
        for e in elements:
            if e[2] and 2 * e[5] > elements[0][5]:
                e[1] = e[1][:-1]
    paths, known = [""], {}
    for _, token, _, parent, depth, _ in elements[1:]:
        path = paths[parent]
        if depth <= NAMED_DEPTH or changes_kind(path, token):
            path = f"{path}/{token}" if path else token
            path = known.setdefault(path, path)
        paths.append(path)
    return [(paths[place], block, n) for place, block, n in out]


# A wrapper is a node [token, repeated, optional, chars, link chars, pages, children]; chars are those of its own slot.
def page_tree(found: list[tuple[str, str, int]]) -> list:
    """Tree of a page's stream, with equal neighbours folded into repeated groups."""
    root = ["", 0, 0, 0, 0, 1, []]
    before: list[str] = []
    nodes = [root]
    for path, text, links in found:
        parts = path.split("/") if path else []
        same = 0
        while same < min(len(parts), len(before), len(nodes) - 1) and parts[same] == before[same]:
            same += 1
        if same == len(parts) and parts and before == parts:
            same -= 1  # a second block of the same path: another element of that name
        del nodes[same + 1 :]
        for part in parts[same:]:
            node = [part, 0, 0, 0, 0, 1, []]
            nodes[-1][6].append(node)
            nodes.append(node)
        nodes[-1][3] += len(text)
        nodes[-1][4] += links
        before = parts
    return fold(root)


def fold(node: list) -> list:
    kids: list = []
    for kid in map(fold, node[6]):
        if kids and kids[-1][0] == kid[0]:
            kids[-1] = merge(kids[-1], kid, 0)
            kids[-1][1] = 1
        else:
            kids.append(kid)
    # squares of two or three different neighbours, as in (dt dd)(dt dd)
    for period in (2, 3):
        i = 0
        while i + 2 * period <= len(kids):
            if [k[0] for k in kids[i : i + period]] == [k[0] for k in kids[i + period : i + 2 * period]]:
                for j in range(period):
                    kids[i + j] = merge(kids[i + j], kids[i + period + j], 0)
                    kids[i + j][1] = 1
                del kids[i + period : i + 2 * period]
            else:
                i += 1
    node[6] = kids
    return node


def merge(a: list, b: list, pages: int = 1) -> list:
    """The wrapper that generates what either generates. ``pages`` 0: both come from one page."""
    out = [a[0], a[1] | b[1], a[2] | b[2], a[3] + b[3], a[4] + b[4], a[5] + b[5] if pages else max(a[5], b[5]), []]
    left, right = a[6], b[6]
    names_a, names_b = [k[0] for k in left], [k[0] for k in right]
    if names_a == names_b:
        out[6] = [merge(x, y, pages) for x, y in zip(left, right, strict=True)]
        return out
    for kind, i, j, k, m in SequenceMatcher(None, names_a, names_b, autojunk=False).get_opcodes():
        if kind == "equal":
            out[6] += [merge(x, y, pages) for x, y in zip(left[i:j], right[k:m], strict=True)]
        else:
            out[6] += [[*x[:2], 1, *x[3:]] for x in left[i:j] + right[k:m]]
    return out


def expression(node: list) -> str:
    """The wrapper as a regular expression over tags; # is a text slot."""
    inner = " ".join(expression(k) for k in node[6])
    body = " ".join(x for x in (f"<{node[0]}>" if node[0] else "", "#" if node[3] else "", inner) if x)
    return f"({body})" + ("+" if node[1] else "") + ("?" if node[2] else "") if node[1] or node[2] else body


@lru_cache(1 << 16)
def kind(path: str) -> str:
    """"article" and "main" inside elements marked so, "furniture" inside furniture, else "plain"."""
    inside = "plain"
    for token in path.split("/"):
        if token.endswith("!") or (token.endswith("^") and inside == "plain"):
            return "furniture"
        inside = "article" if token.endswith("**") or inside == "article" else "main" if token.endswith("*") else inside
    return inside


def changes_kind(path: str, token: str) -> bool:
    return token[-1] in "!^*" and kind(path) != kind(f"{path}/{token}")


@lru_cache(1 << 16)
def group(path: str) -> str:
    """The element that a block belongs to: its path without the headings, paragraphs and the like that it ends in."""
    parts = path.split("/")
    while parts and parts[-1].split(".")[0].rstrip("!*^") in PROSE:
        parts.pop()
    return "/".join(parts)


def slot_counts(tree: list) -> dict[str, list[int]]:
    """[chars, link chars, repeated, place] of a page's slots by path."""
    out: dict[str, list[int]] = {}

    def walk(node: list, path: str, repeated: int) -> None:
        repeated |= node[1]
        if node[3]:
            if path in out:
                old = out[path]
                out[path] = [old[0] + node[3], old[1] + node[4], 1, old[3]]
            else:
                out[path] = [node[3], node[4], repeated, len(out)]
        for kid in node[6]:
            walk(kid, f"{path}/{kid[0]}" if path else kid[0], repeated)

    walk(tree, "", 0)
    return out


def wrapper_of(slots: list[tuple[str, int, int, int, int]], pages: int) -> list:
    """The wrapper of a host of so many pages from (path, chars, link chars, pages, repeated) of its slots in page order."""
    root = ["", 0, 0, 0, 0, pages, []]
    known = {(): root}
    for path, chars, links, seen, repeated in slots:
        parts = tuple(path.split("/")) if path else ()
        for i in range(1, len(parts) + 1):
            if parts[:i] not in known:
                known[parts[:i]] = [parts[i - 1], 0, 0, 0, 0, 0, []]
                known[parts[: i - 1]][6].append(known[parts[:i]])
            known[parts[:i]][5] = max(known[parts[:i]][5], seen)
        node = known[parts]
        node[1], node[3], node[4] = repeated, chars, links

    def close(node: list, pages: int) -> None:
        node[2] = int(node[5] < pages)
        for kid in node[6]:
            close(kid, node[5])

    close(root, pages)
    return root


def plain_area(wrapper: list) -> tuple[str, list[str]]:
    """Where pages without an article have most of their text: the path of the area; and the link boxes outside it, which are
    repeated slots, other than headings and paragraphs, that are mostly links.

    From the top, follow the child that holds most of the text that is neither in furniture or articles nor mostly links,
    as long as it holds at least 60 % of it.
    """
    boxes: list[str] = []

    def mass(node: list) -> int:
        if node[0].endswith(("!", "^", "*")):
            return 0
        own = node[3] if 2 * node[4] <= node[3] else 0
        return own + sum(map(mass, node[6]))

    def link_slots(node: list, path: str, repeated: int) -> None:
        if node[0].endswith(("!", "^", "*")) or node is area:
            return
        repeated |= node[1]
        if repeated and 2 * node[4] > node[3] and node[0].split(".")[0] not in PROSE:
            boxes.append(path)
        for kid in node[6]:
            link_slots(kid, f"{path}/{kid[0]}" if path else kid[0], repeated)

    node, path = wrapper, []
    while node[6]:
        best = max(node[6], key=mass)
        if mass(best) == 0 or mass(best) < 0.6 * mass(node) or not best[6]:
            break
        node = best
        path.append(best[0])
    area = node
    link_slots(wrapper, "", 0)
    return "/".join(path), sorted(boxes)


def _id(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def text_id(path: str, text: str) -> int:
    return _id(f"{path}\n{text}")


def witnesses(texts: list[str]) -> list[int]:
    """For each text of a page one bit of 64, picked by the rest of the page: the smallest hash of its pairs of words, which
    pages that are nearly alike share."""
    least = []
    for t in texts:
        w = t.encode("utf-8", "replace").split()
        least.append(min(map(zlib.crc32, map(b" ".join, zip(w, w[1:], strict=False))), default=zlib.crc32(t.encode("utf-8", "replace"))))
    first, second = sorted([*least, 2**32, 2**32])[:2]
    keys = [second if x == first else first for x in least]
    return [1 << (k * 0x9E3779B97F4A7C15 >> 32 & 63) for k in keys]


class HostWrapper:
    def __init__(self, boxes: list[str] | None = None, template: list[int] | None = None):
        self.boxes, self.template = frozenset(boxes or ()), frozenset(template or ())

    def text(self, found: list[tuple[str, str, int]]) -> str:
        """Inside articles all but furniture stays. In main areas and plain pages, elements go that hold nothing but template texts."""
        chosen = [(p, t) for p, t, _ in found if kind(p) in ("main", "article")]
        if not chosen:
            plain = [(p, t) for p, t, _ in found if kind(p) == "plain"]
            chosen = [(p, t) for p, t in plain if p not in self.boxes] or plain
        if self.template:
            own = {group(p) for p, t in chosen if kind(p) == "article" or text_id(p, t) not in self.template}
            chosen = [(p, t) for p, t in chosen if group(p) in own] or chosen
        return "\n\n".join(t for _, t in chosen)


def host(url: str | None) -> str:
    m = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


ROWS = "host string, path_id long, path string, text_id long, pages long, chars long, links long, repeated int, place long, bits long"


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper (as an expression), area, boxes and template of every host of ``pages`` (url, html as binary ``text``)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots_: dict[tuple[str, str | None], list[int]] = {}
        texts: dict[tuple[str, str, int], list[int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(h, None if p is None else _id(p), p, None, *x, None) for (h, p), x in slots_.items()]
            rows += [(h, _id(p), None, t, n, None, None, None, None, bits - (bits >> 63 << 64)) for (h, p, t), (n, bits) in texts.items()]
            for i in range(0, len(rows), 10_000):
                columns = zip(*rows[i : i + 10_000], strict=True)
                kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in ROWS.split(", ")])
            slots_.clear()
            texts.clear()

        for batch in slices(batches):
            for url, page in zip(batch.column("url").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found, name = blocks(page.decode("utf-8", "replace")), host(url)
                counts: dict[str | None, list[int]] = {None: [0, 0, 0, 0], **slot_counts(page_tree(found))}
                for path, (chars, links, repeated, place) in counts.items():
                    row = slots_.setdefault((name, path), [0, 0, 0, 0, 0])
                    row[0] += 1
                    row[1] += chars
                    row[2] += links
                    row[3] |= repeated
                    row[4] += place
                read = [(p, t) for p, t, _ in found if kind(p) != "furniture"]
                bits = {}
                for (p, t), bit in zip(read, witnesses([t for _, t in read]), strict=True):
                    bits[p, text_id(p, t)] = bit
                for (p, t), bit in bits.items():
                    row = texts.setdefault((name, p, t), [0, 0])
                    row[0] += 1
                    row[1] |= bit
                if len(slots_) + len(texts) > COUNTS_HELD:
                    yield from out()
        yield from out()

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        total = int(group["total"].iat[0])
        held = group[group["path"].notna()]
        held = held.assign(at=held["place"] / held["pages"]).sort_values(["at", "path"])
        slots_ = [(r.path, int(r.chars), int(r.links), int(r.pages), int(r.repeated)) for r in held.itertuples()]
        wrapper = wrapper_of(slots_, total)
        area, boxes = plain_area(wrapper)
        template = sorted(int(x) for x in group["text_id"] if x is not None and x == x)
        return pd.DataFrame({"host": [group["host"].iat[0]], "wrapper": [expression(wrapper)], "area": [area], "boxes": [boxes], "template": [template]})

    summed = pages.mapInArrow(partial, ROWS).groupBy("host", "path_id", "path", "text_id").agg(
        *[F.sum(c).alias(c) for c in ("pages", "chars", "links", "place")], F.max("repeated").alias("repeated"), F.bit_or("bits").alias("bits")
    )
    rows = materialize(summed.where(F.col("text_id").isNull() | (F.bit_count("bits") >= WITNESSES)), "wrapper-slots")
    totals = rows.where("path_id is null").select("host", F.col("pages").alias("total"))
    frequent = rows.where("path_id is not null").join(totals, "host").where(F.col("pages") * FREQUENT >= F.col("total"))
    slots_ = frequent.where("text_id is null")
    having = slots_.select("host", "path_id", F.col("pages").alias("having"))
    template = frequent.where("text_id is not null").join(having, ["host", "path_id"]).where(F.col("pages") * 10 >= F.col("having") * 9)
    columns = ["host", "total", "path", F.col("text_id").cast("string").alias("text_id"), "pages", "chars", "links", "repeated", "place"]
    return slots_.select(columns).unionAll(template.select(columns)).groupBy("host").applyInPandas(
        whole, "host string, wrapper string, area string, boxes array<string>, template array<long>"
    )


READ = ["host", "boxes", "template"]


class Wrappers:
    """Wrappers by host, read from the shards in the shared folder."""

    def __init__(self, path: str, shards: int):
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(path) if ":/" in path else (pyarrow.fs.LocalFileSystem(), path)
        self.shards, self.kept = shards, OrderedDict()

    def of(self, name: str) -> HostWrapper:
        number = zlib.crc32(name.encode()) % self.shards
        if number not in self.kept:
            got: dict[str, HostWrapper] = {}
            for x in self.fs.get_file_info(pyarrow.fs.FileSelector(f"{self.path}/shard={number}", allow_not_found=True)):
                if x.path.endswith(".parquet"):
                    with self.fs.open_input_file(x.path) as f:
                        for row in pyarrow.parquet.read_table(f, columns=READ).to_pylist():
                            name_of_row = row.pop("host")
                            got[name_of_row] = HostWrapper(**row)
            self.kept[number] = got
            if len(self.kept) > SHARDS_KEPT:
                self.kept.popitem(last=False)
        self.kept.move_to_end(number)
        return self.kept[number].get(name) or HostWrapper()


def extract(pages: DataFrame, shard_hosts: int = SHARD_HOSTS) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html): the main text, blocks joined by blank lines.

    A null, empty or tagless html gives the text outside any element, usually none. Pages whose url is null or has no
    host form one host of their own. Repeated rows give equal results; null ids pass through; other columns
    are not read; an empty table gives none.
    """
    pages = pages.select("page_id", "url", text_bytes("html"))
    wrappers = materialize(infer(pages.select("url", "text")), "wrappers")
    shards = max(1, -(-wrappers.count() // shard_hosts))
    path = shared_path(pages.sparkSession, "wrapper-shards")
    wrappers.withColumn("shard", F.crc32(F.col("host").cast("binary")) % shards).select(*READ, "shard").repartition("shard").write.partitionBy("shard").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Wrappers(path, shards)
        for batch in slices(batches):
            texts = [
                known.of(host(url)).text(blocks(page.decode("utf-8", "replace")))
                for url, page in zip(batch.column("url").to_pylist(), batch.column("text").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    kind = dict(pages.dtypes)["page_id"]
    return pages.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
