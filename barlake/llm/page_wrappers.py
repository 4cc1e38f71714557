"""Main text of pages, by wrappers inferred per host.

A page is read as a stream of block tags and blocks of text. Repeats within the
stream are folded into repeated groups, which gives the page's own regular
expression. The different expressions of a host are aligned one after another:
what only one side has becomes optional, repeated groups are merged inside, and
text that stands at one place becomes one slot. The result is the host's
wrapper, without alternatives.

What a block is worth is first said by its own page: text under menus, headers,
footers, forms, notices, adverts or comments is dropped, text in the page's
article is kept, and a page that has an article has its main text there. Words
such as sidebar, and forms, count below the page's article or beside it, not
around it: that is its <main>, or the <article> least under such tags and, if
there are any, with most of the text. A word counts as a whole class, role or id
(ids not on headings and text), or with words that say nothing, as in
related-posts; a menu, sidebar or widget that holds most of the text counts for
nothing. What is
left is judged by what all pages of the host put into the slot: the share of
text that is link text, and whether it ever changes, over at least three pages
that differ in their other slots. A slot of a page that its wrapper has no place
for is judged together with others under the same tags. A page's main text is
its good blocks, in page order.

Pages are parsed once and stored as blocks; figures per slot are sums over all
pages. A host's different expressions are dealt to cells of ``CELL`` and aligned
there, then the cells' wrappers are dealt and aligned in the same way, until a
host has one. So a host with a third of all pages sends only its different
expressions to tasks, and to each task a cell of them.

Blocks: character references are decoded, white space becomes one space, ends
are trimmed, empty blocks go; blocks are joined by a line end.

Defined cases: a null or empty page has empty text; a null url is a host of its
own; broken markup (unclosed or unmatched tags, stray angle brackets) is text or
ignored; repeated rows give repeated results; extra columns change nothing.
"""

from __future__ import annotations

import difflib
import hashlib
import html as entities
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import map_columns, stored

CELL = 500
PERIOD = 12
TEXT = "#"

# What is no text, which tags make blocks, which of them close themselves, and words for what is not the article.
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*>)""",
    re.DOTALL,
)
# A tag needs a > behind it; these do not.
DECLARATION = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?", re.DOTALL)
RAW = frozenset("script style textarea title noscript template iframe object desc metadata annotation annotation-xml".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
LOOSE = frozenset("p li dt dd td th tr option hr h1 h2 h3 h4 h5 h6 html body head thead tbody tfoot caption summary".split())
# Loose tags that any block ends, and for the others: which open tags a tag ends, and through which others it looks for them.
SHORT = LOOSE - frozenset("li dt dd td th tr thead tbody tfoot".split())
CELLS, ROWS, PARTS = frozenset(("td", "th")), frozenset(("td", "th", "tr")), frozenset("td th tr thead tbody tfoot".split())
ENDS = (
    {"li": frozenset(("li",))} | dict.fromkeys(("dt", "dd"), frozenset(("dt", "dd"))) | dict.fromkeys(("td", "th"), CELLS)
    | {"tr": ROWS} | dict.fromkeys(("thead", "tbody", "tfoot"), PARTS)
)
WITHIN = frozenset("button label select".split())
LISTS = frozenset("ul ol menu dl".split())
ARTICLE = frozenset("article main".split())
OUTSIDE = frozenset("nav footer aside form menu dialog button select option label head fieldset legend".split())
OUTSIDE_WORDS = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|side-?bar|menu|nav\w*|breadcrumbs?|pagination|pager|footer|masthead|site-?header|comments?|replies|"
    r"disqus|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|share|sharing|social|related|recommended|widget"
)
# Words that say nothing beside one of those, as in related-posts; and those of them that are also put around all text of a page.
NEUTRAL = frozenset(
    "area bar block bottom box button buttons container element global group header inner item items left link links list main outer page post posts primary region "
    "right row secondary section signup site slot top unit wrap wrapper".split()
)
AROUND_ALL = re.compile(r"banner|side-?bar|menu|nav\w*|popup|modal|widget")
# An id says what a tag is for only on these; on headings and text it is made of their own words.
HOLDERS = frozenset("aside div dl footer form header nav ol section table ul".split())
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.IGNORECASE)


def _symbol(name: str, rest: str) -> str:
    """A tag with the words of its class and id that say what it is for; numbers in them go."""
    if not rest.strip(" />"):
        return name
    found = ((m[0].lower(), re.sub(r"\d+", "", " ".join(m[1:]).lower())) for m in ATTRIBUTE.findall(rest))
    words = " ".join(f"#{text.strip()}" if kind == "id" and text.strip() else text for kind, text in found)
    return f"{name}.{'.'.join(sorted(set(words.split())))}" if words.strip() else name


def _warning(symbol: str) -> tuple[int, bool]:
    """How much a tag's words say that it is not the article, and whether they are also put around all text.

    A whole class, role or id says much. A part of a class says little, and only
    if its other parts say nothing: related-posts, but not social-impact.
    """
    name, *words = symbol.split(".")
    said, around = 0, True
    for word in words:
        if word.startswith("#"):
            parts = [word[1:]] if name in HOLDERS and OUTSIDE_WORDS.fullmatch(word[1:]) else []
        else:
            parts = [word] if OUTSIDE_WORDS.fullmatch(word) else re.split("[-_]+", word)
        telling = [p for p in parts if OUTSIDE_WORDS.fullmatch(p)]
        if telling and all(p in NEUTRAL or p in telling for p in parts):
            said = max(said, 100 if len(parts) == 1 else 1)
            around = around and all(AROUND_ALL.fullmatch(p) for p in telling)
    return said, around


def _stay(names: list[str], symbol: str) -> int:
    """How many of the open tags stay open at a tag."""
    k = len(names)
    name = symbol.lstrip("/").split(".")[0]
    if symbol.startswith("/"):
        # an end does not reach out of the list or table it stands in
        wall = LISTS if name in ("li", "dt", "dd") else ("table",) if name in PARTS else ()
        for i in range(k - 1, -1, -1):
            if names[i] == name:
                return i
            if names[i] in wall:
                break
        return k
    while k and names[k - 1] in SHORT and name not in WITHIN:
        k -= 1
    ends = ENDS.get(name, ())
    for i in range(k - 1, -1, -1) if ends else ():
        if names[i] in ends:
            k = i
        elif names[i] == "table" or (name not in PARTS and names[i] not in ("div", "address", "p")):
            break
    return k


def stream(page: str) -> tuple[list[str], list[tuple[str, int]]]:
    """Block tags and TEXT in page order, and the blocks of text, each with its characters inside links.

    The end of a loose tag is a symbol only where text, or a tag that would not end it, follows.
    """
    symbols: list[str] = []
    blocks: list[tuple[str, int]] = []
    parts: list[str] = []
    in_link: list[str] = []
    link = False
    at = 0
    open_tags: list[str] = []
    ended: list[str] = []  # closed by ends that are no symbols yet, the outermost first
    ends: list[str] = []

    def settle() -> None:
        symbols.extend(ends)
        ended.clear()
        ends.clear()

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            settle()
            symbols.append(TEXT)
            blocks.append((text, min(len(text), len(" ".join(entities.unescape("".join(in_link)).split())))))
        parts.clear()
        in_link.clear()

    def add(text: str) -> None:
        parts.append(text)
        if link:
            in_link.append(text)

    def finish(name: str) -> None:
        stay = _stay(open_tags, "/" + name)
        if stay == len(open_tags):
            return
        if name in LOOSE:
            ended[:0] = open_tags[stay:]
            ends.append("/" + name)
        else:
            if name in ended:
                settle()
            symbols.append("/" + name)
            ended.clear()
            ends.clear()
        del open_tags[stay:]

    def begin(name: str, rest: str) -> None:
        stay = _stay(open_tags, name)
        if ended and _stay(open_tags + ended, name) != stay:
            settle()
        ended.clear()
        ends.clear()
        del open_tags[stay:]
        symbols.append(_symbol(name, rest))
        open_tags.append(name)

    last = page.rfind(">") + 1

    def token(at: int) -> tuple[re.Match | None, str]:
        """The next token and the name of its tag, if it is one. Unclosed tags behind the last > are not looked through."""
        m = TOKEN.search(page, at, last)
        if m and m["name"]:
            return m, m["name"].lower()
        return DECLARATION.search(page, m.start() if m else at), ""

    while True:
        m, name = token(at)
        if not m:
            break
        add(page[at:m.start()])
        at = m.end()
        if not name:
            continue
        if name in RAW and not m["end"]:
            if not m["rest"].endswith("/>"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
                at = close.end() if close else len(page)
        elif name in BLOCKS:
            flush()
            if name in ("html", "body", "hr"):
                if not m["end"]:
                    finish("head" if name == "body" else "p")
            elif m["end"]:
                finish(name)
            else:
                begin(name, m["rest"][:-1])
        elif name == "a":
            link = not m["end"]
        elif name in ("br", "img", "input", "wbr", "text", "svg"):
            add(" ")
    add(page[at:])
    flush()
    return symbols, blocks


class Node:
    """A symbol, or a repeated group of nodes; ``texts`` are the blocks a TEXT node stands for."""

    __slots__ = ("symbol", "group", "texts", "key")

    def __init__(self, symbol: str = "", group: list[Node] | None = None, texts: list[int] | None = None):
        self.symbol, self.group, self.texts = symbol, group, texts or []
        self.key = symbol if group is None else "(" + " ".join(n.key for n in group) + ")"


def _joined(one: list[Node], two: list[Node]) -> list[Node]:
    return [
        Node(a.symbol, None, a.texts + b.texts) if a.group is None else Node(group=_joined(a.group, b.group))
        for a, b in zip(one, two, strict=True)
    ]


def fold(nodes: list[Node]) -> list[Node]:
    """Put repeats that follow each other into groups, inner ones first, until nothing repeats."""
    changed = True
    while changed:
        changed = False
        for period in range(1, PERIOD + 1):
            out: list[Node] = []
            i = 0
            while i < len(nodes):
                keys = [n.key for n in nodes[i:i + period]]
                first = keys[0] if keys else ""
                j = i + period
                if len(keys) == period and first != TEXT and not first.startswith("/") and [n.key for n in nodes[j:j + period]] == keys:
                    group = nodes[i:j]
                    while [n.key for n in nodes[j:j + period]] == keys:
                        group = _joined(group, nodes[j:j + period])
                        j += period
                    out.append(group[0] if period == 1 and group[0].group is not None else Node(group=group))
                    i, changed = j, True
                else:
                    out.append(nodes[i])
                    i += 1
            nodes = out
    return nodes


def expression(symbols: list[str]) -> list[Node]:
    texts = iter(range(len(symbols)))
    return fold([Node(s, None, [next(texts)] if s == TEXT else []) for s in symbols])


def plain(nodes: list[Node]) -> list:
    """An expression as nested lists: symbols, and lists for groups."""
    return [n.symbol if n.group is None else plain(n.group) for n in nodes]


def slots(nodes: list[Node]) -> list[list[int]]:
    """The blocks of each TEXT node, in order."""
    out: list[list[int]] = []
    for n in nodes:
        out += slots(n.group) if n.group is not None else [n.texts] if n.symbol == TEXT else []
    return out


# wrappers: nested lists of [symbol or group, optional]


def wrapper_of(expr: list) -> list:
    return [[x if isinstance(x, str) else wrapper_of(x), False] for x in expr]


def _head(item: list) -> str:
    return item[0] if isinstance(item[0], str) else "(" + _head(item[0][0])


def _bodies(wrapper: list) -> list[list[str]]:
    return [[_head(y) for y in x[0]] for x in wrapper if not isinstance(x[0], str)]


def _grouped(wrapper: list, bodies: list[list[str]]) -> list:
    """Single occurrences of what is a repeated group on the other side, as groups."""
    for body in sorted(bodies, key=len, reverse=True):
        out, i = [], 0
        while i < len(wrapper):
            if [_head(x) for x in wrapper[i:i + len(body)]] == body:
                out.append([wrapper[i:i + len(body)], False])
                i += len(body)
            else:
                out.append(wrapper[i])
                i += 1
        wrapper = out
    return wrapper


def _matches(one: list, two: list) -> list[tuple[int, int, int]]:
    """Runs both have, as (start in one, start in two, length). Equal starts and ends are matched at once, so that like pages take linear time."""
    a, b = [_head(x) for x in one], [_head(x) for x in two]
    most = min(len(a), len(b))
    start = next((i for i in range(most) if a[i] != b[i]), most)
    end = next((i for i in range(most - start) if a[-1 - i] != b[-1 - i]), most - start)
    middle = difflib.SequenceMatcher(None, a[start:len(a) - end], b[start:len(b) - end], autojunk=False).get_matching_blocks()
    return [(0, 0, start), *((start + i, start + j, n) for i, j, n in middle), (len(a) - end, len(b) - end, end), (len(a), len(b), 0)]


def align(one: list, two: list) -> list:
    """The wrapper of everything both match."""
    bodies = _bodies(one) + _bodies(two)
    one, two = _grouped(one, bodies), _grouped(two, bodies)
    out: list = []
    i = j = 0
    for a, b, size in _matches(one, two):
        out += [[x, True] for x, _ in one[i:a]] + [[x, True] for x, _ in two[j:b]]
        for x, y in zip(one[a:a + size], two[b:b + size], strict=True):
            out.append([x[0] if isinstance(x[0], str) else align(x[0], y[0]), x[1] or y[1]])
        i, j = a + size, b + size
    return out


def places(wrapper: list) -> list[int]:
    """For each slot of a wrapper, a hash of the tags it stands under."""
    out: list[int] = []
    names: list[str] = []
    chain = [0]  # of each open tag, a hash of it and those around it

    def walk(items: list) -> None:
        # tags that a group leaves open stay open behind it
        for item, _ in items:
            if not isinstance(item, str):
                walk(item)
            elif item == TEXT:
                out.append(chain[-1])
            else:
                stay = _stay(names, item)
                del names[stay:], chain[stay + 1:]
                if not item.startswith("/"):
                    names.append(item.split(".")[0])
                    chain.append(int(hashlib.md5(f"{chain[-1]} {item}".encode()).hexdigest()[:15], 16))

    walk(wrapper)
    return out


def located(wrapper: list, expr: list) -> list[int]:
    """For each slot of an expression, the number of the wrapper's slot it matches, -1 for none."""

    def count(items: list) -> int:
        return sum(count(x) if not isinstance(x, str) else x == TEXT for x, _ in items)

    def match(one: list, two: list, first: int) -> list[int]:
        bodies = _bodies(one) + _bodies(two)
        grouped_two, own = _grouped(two, bodies), _grouped(one, bodies)
        starts, at = [], first
        for x, _ in own:
            starts.append(at)
            at += count(x) if not isinstance(x, str) else x == TEXT
        out: list[int] = []
        j = 0
        for a, b, size in _matches(own, grouped_two):
            out += [-1] * count(grouped_two[j:b])
            for k in range(size):
                x, y = own[a + k][0], grouped_two[b + k][0]
                if not isinstance(y, str):
                    out += match(x, y, starts[a + k])
                elif y == TEXT:
                    out.append(starts[a + k])
            j = b + size
        return out

    return match(wrapper, wrapper_of(expr), 0)


def opened(symbols: list[str]) -> tuple[list[tuple[str, int]], list[int]]:
    """The tags of a page, each with the number of the one it stands in (-1: none), and for each TEXT the tag it stands in."""
    tags: list[tuple[str, int]] = []
    leaves: list[int] = []
    stack: list[int] = []
    names: list[str] = []
    for symbol in symbols:
        if symbol == TEXT:
            leaves.append(stack[-1] if stack else -1)
            continue
        stay = _stay(names, symbol)
        del stack[stay:], names[stay:]
        if not symbol.startswith("/"):
            tags.append((symbol, stack[-1] if stack else -1))
            stack.append(len(tags) - 1)
            names.append(symbol.split(".")[0])
    return tags, leaves


DROP, ARTICLE_TEXT, OPEN = 0, 1, 2


def states(symbols: list[str], chars: list[int]) -> list[int]:
    """For each block of a page, by the page's own tags: no main text, text of its article, or to be judged by what the host's pages have there."""
    tags, leaves = opened(symbols)
    names = [symbol.split(".")[0] for symbol, _ in tags]
    # of each tag, and at the end of what stands in none
    inside, shut, warns, text = [False], [False], [0], [0] * (len(tags) + 1)
    warnings = [_warning(symbol) for symbol, _ in tags]
    weight = [said or int(n == "form") for n, (said, _) in zip(names, warnings, strict=True)]
    warned = [w > 0 for w in weight]
    for k, (_, parent) in enumerate(tags):
        shut.insert(-1, shut[parent] or (names[k] in OUTSIDE and names[k] != "form") or (names[k] == "header" and not inside[parent]))
        inside.insert(-1, inside[parent] or names[k] in ARTICLE)
        warns.insert(-1, warns[parent] + weight[k])
    for leaf, n in zip(leaves, chars, strict=True):
        text[leaf] += 0 if shut[leaf] else n
    below = text.copy()
    for k in range(len(tags) - 1, -1, -1):
        below[tags[k][1]] += below[k]

    def holders(k: int) -> list[int]:
        out = []
        while k >= 0:
            out.append(k)
            k = tags[k][1]
        return out

    # words and forms around the page's article, or on it, say nothing
    free: set[int] = set()
    for kind in ("main", "article"):
        chosen = [k for k, n in enumerate(names) if n == kind and not shut[k] and below[k]]
        if free and kind == "article":
            in_main = _below(tags, [k in free for k in range(len(tags))])
            chosen = [k for k in chosen if in_main[k]] or chosen
        if not chosen:
            continue
        best = holders(min(chosen, key=lambda k: (warns[k], -below[k], k)))
        doubted = [k for k in best if warned[k] and k not in free]
        if doubted and kind == "article":
            # it must hold most of what else may be main text in the page, or in its <main>
            if free and free.isdisjoint(best):
                continue
            around = free | set(best)
            bad = _below(tags, [w and k not in around for k, w in enumerate(warned)])
            within = _below(tags, [n == "main" and k in free for k, n in enumerate(names)]) if free else [True] * len(text)
            if 2 * below[doubted[0]] <= sum(t for t, b, w in zip(text, bad, within, strict=True) if w and not b):
                continue
        free.update(best)
    if not free:
        free.update(k for k, n in enumerate(names) if n == "form" and 2 * below[k] > below[-1])
    # what holds most of the article's text is no menu or widget beside it
    scope = max((below[k] for k in free if names[k] in ARTICLE), default=below[-1])
    free.update(k for k, (said, around) in enumerate(warnings) if said and around and names[k] != "form" and 2 * below[k] > scope)
    gone = _below(tags, [s or (w and k not in free) for k, (s, w) in enumerate(zip(shut[:-1], warned, strict=True))])
    article = any(inside[k] and not gone[k] for k in leaves)
    return [DROP if gone[k] or (article and not inside[k]) else ARTICLE_TEXT if inside[k] else OPEN for k in leaves]


def _below(tags: list[tuple[str, int]], marked: list[bool]) -> list[bool]:
    """Which tags are marked or stand in a marked one; at the end what stands in none."""
    out = [False]
    for k, (_, parent) in enumerate(tags):
        out.insert(-1, marked[k] or out[parent])
    return out


def others(slots_of: list[int], texts: list[str], found: list[int]) -> list[int]:
    """For each block, a hash of what may be main text in the page's other slots."""
    sums: dict[int, int] = {}
    for k, (slot, text) in enumerate(zip(slots_of, texts, strict=True)):
        if found[k] != DROP:
            own = hashlib.blake2b(f"{sums.get(slot, 0)} {text}".encode("utf-8", "surrogatepass"), digest_size=8).digest()
            sums[slot] = int.from_bytes(own)
    every = sum(sums.values())
    return [((every - sums.get(slot, 0)) & (1 << 64) - 1) - (1 << 63) for slot in slots_of]


def parse(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, form, expr, blocks): form is the hash of the expression, blocks have their slot in it, their state and a hash of the page's other slots."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {"form": [], "expr": [], "blocks": []}
            for page in batch["html"]:
                symbols, texts = stream(page)
                k = iter(range(len(texts)))
                nodes = fold([Node(s, None, [next(k)] if s == TEXT else []) for s in symbols])
                expr = json.dumps(plain(nodes), separators=(",", ":"))
                out["expr"].append(expr)
                out["form"].append(hashlib.md5(expr.encode()).hexdigest())
                slot_of = {i: s for s, own in enumerate(slots(nodes)) for i in own}
                found = states(symbols, [len(t) for t, _ in texts])
                rest = others([slot_of[i] for i in range(len(texts))], [t for t, _ in texts], found)
                out["blocks"].append([{"slot": slot_of[i], "text": t, "links": n, "state": found[i], "others": rest[i]} for i, (t, n) in enumerate(texts)])
            yield {c: batch[c] for c in ("page_id", "url", "host")} | out

    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return map_columns(rows, run, f"{kinds}, host string, form string, expr string, blocks array<struct<slot: int, text: string, links: int, state: tinyint, others: long>>")


def infer(parsed: DataFrame) -> DataFrame:
    """(host, form, keep): for each expression of a host, the slots that hold main text where the page's tags leave it open."""
    forms = stored(parsed.groupBy("host", "form").agg(F.min("expr").alias("expr"), F.count("*").alias("pages")), "forms")

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # the commonest first, then by hash: the same order wherever it runs
        rows = rows.sort_values(["pages", "form"], ascending=[False, True])
        wrapper: list | None = None
        for text in rows["expr"]:
            own = json.loads(text)
            wrapper = own if wrapper is None else align(wrapper, own)
        return pd.DataFrame({"host": [key[0]], "form": [rows["form"].iloc[0]], "pages": [int(rows["pages"].sum())], "expr": [json.dumps(wrapper)]})

    def as_wrapper(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return merge(key, rows.assign(expr=[json.dumps(wrapper_of(json.loads(x))) for x in rows["expr"]]))

    def aligned(parts: DataFrame, merged: Callable[[tuple, pd.DataFrame], pd.DataFrame]) -> DataFrame:
        """The parts of each host in cells of about ``CELL``, each cell as one part."""
        counted = parts.join(parts.groupBy("host").agg(F.count("*").alias("n")), "host")
        dealt = counted.withColumn("cell", F.pmod(F.xxhash64("form"), F.ceil(F.col("n") / CELL)))
        cells = dealt.select("host", "cell", "form", "pages", "expr").groupBy("host", "cell")
        return stored(cells.applyInPandas(merged, "host string, form string, pages long, expr string"), "wrappers")

    parts = aligned(forms, as_wrapper)
    while (parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        parts = aligned(parts, merge)
    wrappers = parts.select("host", F.col("expr").alias("wrapper"))

    def locate(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            found = []
            known, whole = "", []
            for wrapper, text in zip(batch["wrapper"], batch["expr"], strict=True):
                if wrapper != known:
                    known, whole = wrapper, json.loads(wrapper)
                expr = json.loads(text)
                own = places(wrapper_of(expr))
                # slots that the wrapper has no place for: those under the same tags are one, with a negative number
                found.append([p if p >= 0 else -1 - o for p, o in zip(located(whole, expr), own, strict=True)])
            yield {"host": batch["host"], "form": batch["form"], "found": found}

    at = stored(map_columns(forms.join(wrappers, "host").select("host", "form", "expr", "wrapper"), locate, "host string, form string, found array<long>"), "slots")
    block = parsed.select("host", "form", F.explode("blocks").alias("b")).select("host", "form", "b.slot", "b.others", F.length("b.text").alias("chars"), "b.links", F.xxhash64("b.text").alias("h"))
    sums = block.groupBy("host", "form", "slot", "others").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.min("h").alias("low"), F.max("h").alias("high"))
    spread = at.select("host", "form", F.posexplode("found").alias("slot", "place"))
    figure = (F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.min("low").alias("low"), F.max("high").alias("high"))
    # repeats in a page and copies of pages are one
    apart = sums.join(spread, ["host", "form", "slot"]).groupBy("host", "place", "others").agg(*figure)
    figures = apart.groupBy("host", "place").agg(F.count("*").alias("pages"), *figure)
    fixed = (F.col("pages") >= 3) & (F.col("low") == F.col("high"))
    # one row per slot of a host's wrapper
    bad = figures.where(fixed | (F.col("links") > F.col("chars") / 2)).groupBy("host").agg(F.collect_list("place").alias("bad"))
    good = F.transform("found", lambda place, i: F.when(~F.coalesce(F.array_contains("bad", place), F.lit(False)), i))
    return at.join(bad, "host", "left").select("host", "form", F.array_compact(good).alias("keep"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    parsed = stored(parse(pages), "pages")
    keep = stored(infer(parsed.select("host", "form", "expr", "blocks")), "keep")
    rows = parsed.drop("expr").join(keep, ["host", "form"])
    main = F.filter("blocks", lambda b: (b["state"] == ARTICLE_TEXT) | ((b["state"] == OPEN) & F.array_contains("keep", b["slot"])))
    text = F.array_join(F.transform(main, lambda b: b["text"]), "\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
