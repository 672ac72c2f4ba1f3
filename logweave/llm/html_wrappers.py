"""Main text of web pages by wrappers that are inferred from all pages of a host."""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import text_slices
from logweave.operators.joins import fits_broadcast
from logweave.session import freeze

_TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[a-zA-Z/!?](?:\"[^\"]*\"|'[^']*'|[^'\">])*>?|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"</?\s*([a-zA-Z][\w:-]*)")
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Tags inside a block: they neither end it nor count for the structure. Link texts are measured.
_INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span "
              "strike strong sub sup time tt u var wbr meta link base input area col".split())
#: End tags that may be left out; they carry no structure.
_LOOSE = set("p li dd dt option td th tr tbody thead tfoot html body".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"},
           "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
_OUTSIDE = set("nav header footer aside form head title button select label fieldset dialog menu".split())
_MAIN = set("article main".split())
_MAIN_WORDS = set("main".split())
#: Words of class, id and role that mark what is no article.
_OUTSIDE_WORDS = set(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar aside widget header masthead footer comment comments cookie cookies "
    "consent notice notices alert popup modal overlay share sharing social related recommended newsletter "
    "subscribe signup login search form pagination pager copyright disqus respond replies reply toolbar skip "
    "contentinfo complementary".split())
#: Structure units that a repeated group may have.
_LONGEST_GROUP = 24
#: Pages of different contents in which a text outside article and main must be the same to count as layout.
_FIXED_PAGES = 5


def page_tokens(page: str | None) -> list[tuple[str, str, int]]:
    """(unit, text, link characters) of a page in order; unit "#" is a text, others are tags.

    Texts reach over inline tags. Tags keep their name and a word of their
    class, id or role that tells their part in the page. Comments, scripts and styles go.
    """
    out: list[tuple[str, str, int]] = []
    text: list[str] = []
    linked, in_link = 0, False

    def close() -> None:
        nonlocal linked
        block = " ".join(html.unescape("".join(text)).split())
        if block:
            out.append(("#", block, linked))
        text.clear()
        linked = 0

    for m in _TOKENS.finditer(page or ""):
        token = m.group()
        if token[0] != "<" or token == "<":
            text.append(token)
            linked += len(token) * in_link
            continue
        name = _NAME.match(token)
        if m.group(1) or not name:
            continue
        tag = name.group(1).lower()
        if tag in _INLINE:
            if tag == "a":
                in_link = token[1] != "/"
            elif tag == "br":
                text.append(" ")
            continue
        close()
        if token[1] == "/":
            if tag not in _LOOSE:
                out.append((f"/{tag}", "", 0))
            continue
        words = {w for found in _MARKS.findall(token) for w in re.split(r"[^a-z]+", "".join(found).lower())}
        # "main-menu" is a menu
        mark = min(words & _OUTSIDE_WORDS, default="") or min(words & _MAIN_WORDS, default="")
        out.append((f"{tag}.{mark}", "", 0))
    close()
    return out


# A wrapper is a list of nodes: {"k": unit} or {"k": "+", "body": [...]}, both with "o" if optional;
# texts have "t": the slots of pages' structures that they stand for, each with its place there (1 inside
# article or main, -1 outside of what can be an article, else 0), and "f": what is known of them.

def fold_repeats(units: list[str]) -> tuple[list, list[list[int]]]:
    """The structure of a page, groups that follow each other folded, and of each unit its slot's path."""
    nodes: list = []  # a unit, or ("+", body)
    places: list[list[list[int]]] = []  # of each node, the original units in order of its flat body

    def flat(node) -> int:
        return sum(map(flat, node[1])) if isinstance(node, tuple) else 1

    for i, unit in enumerate(units):
        nodes.append(unit)
        places.append([[i]])
        again = True
        while again:
            again = False
            for size in range(1, min(_LONGEST_GROUP, len(nodes) - 1) + 1):
                tail = nodes[-size:]
                before = nodes[-size - 1]
                if isinstance(before, tuple) and before[1] == tail:
                    merged = [a + b for a, b in zip(places[-size - 1], sum(places[-size:], []), strict=True)]
                    nodes[-size - 1:], places[-size - 1:] = [before], [merged]
                    again = True
                    break
                if size > 1 and len(nodes) >= 2 * size and nodes[-1] == nodes[-1 - size] \
                        and nodes[-2 * size:-size] == tail and "#" in tail \
                        and tail[0] != "#" and tail[0][0] != "/":  # groups begin with a tag
                    merged = [a + b for a, b in zip(sum(places[-2 * size:-size], []), sum(places[-size:], []),
                                                    strict=True)]
                    nodes[-2 * size:], places[-2 * size:] = [("+", tail)], [merged]
                    again = True
                    break
    return nodes, [p for node in places for p in node]


def structure(page: str | None) -> tuple[str, list[tuple[str, str, int]], list[int]]:
    """A page's folded structure as text, its tokens, and the slot of each token (text units only count)."""
    tokens = page_tokens(page)
    nodes, places = fold_repeats([t[0] for t in tokens])
    slot_of = [0] * len(tokens)
    for slot, members in enumerate(places):
        for i in members:
            slot_of[i] = slot
    return json.dumps(nodes), tokens, slot_of


def _wrapper(skeleton: str, key: str, facts: dict[str, list]) -> list[dict]:
    """The wrapper of one structure; ``facts``: by slot, [pages, characters, link characters, digest of the text or null].

    ``pages`` are digests of the contents of pages that fill the slot, as many of them as decide what is layout: copies
    of a page are one page, and so is a page in which a slot stands several times.
    """
    at = 0
    stack: list[str] = []

    def place() -> int:
        if any(x.split(".")[0] in _OUTSIDE or x.split(".")[1] in _OUTSIDE_WORDS for x in stack):
            return -1
        return int(any(x.split(".")[0] in _MAIN or x.split(".")[1] in _MAIN_WORDS for x in stack))

    def make(node) -> dict:
        nonlocal at
        if isinstance(node, list):
            return {"k": "+", "body": [make(x) for x in node[1]]}
        out = {"k": node}
        if node == "#":
            out |= {"t": [[key, at, place()]], "f": facts.get(str(at), [[], 0, 0, None])}
        elif node[0] == "/":
            names = [x.split(".")[0] for x in stack]
            if node[1:] in names:
                del stack[len(names) - 1 - names[::-1].index(node[1:]):]
        else:
            tag = node.split(".")[0]
            while stack and stack[-1].split(".")[0] in _CLOSES.get(tag, ()):
                stack.pop()
            stack.append(node)
        at += 1
        return out

    return [make(x) for x in json.loads(skeleton)]


def _keys(nodes: list[dict]) -> list[str]:
    """Units of a wrapper in a line, groups in brackets."""
    out = []
    for n in nodes:
        out += ["(", *_keys(n["body"]), ")+"] if n["k"] == "+" else [n["k"]]
    return out


def _facts(a: list, b: list) -> list:
    return [sorted({*a[0], *b[0]})[:_FIXED_PAGES], a[1] + b[1], a[2] + b[2], a[3] if a[3] == b[3] or not b[0] else b[3] if not a[0] else None]


def _join(a: dict, b: dict) -> dict:
    """One node for two that match."""
    out = {"k": a["k"]}
    if a["k"] == "+":
        out["body"] = align(a["body"], b["body"])
    if a["k"] == "#":
        out |= {"t": a["t"] + b["t"], "f": _facts(a["f"], b["f"])}
    if a.get("o") or b.get("o"):
        out["o"] = 1
    return out


def align(a: list[dict], b: list[dict]) -> list[dict]:
    """The union-free expression of two: what only one has becomes optional.

    Units match equal units, a repeated group matches a group that begins
    alike, or the units of one pass through it. Of all alignments one with the most
    matched units is taken.
    """
    n, m = len(a), len(b)
    bodies_a = [_keys(x["body"]) if x["k"] == "+" else None for x in a]
    bodies_b = [_keys(x["body"]) if x["k"] == "+" else None for x in b]
    keys_a, keys_b = [x["k"] for x in a], [x["k"] for x in b]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    move: list[list[tuple[int, int]]] = [[(0, 0)] * (m + 1) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            options = []
            if i < n:
                options.append((best[i + 1][j], 1, 0))
            if j < m:
                options.append((best[i][j + 1], 0, 1))
            if i < n and j < m:
                p, q = bodies_a[i], bodies_b[j]
                if p and q and p[0] == q[0]:
                    options.append((best[i + 1][j + 1] + 2 + (p == q), 1, 1))
                elif not p and not q and keys_a[i] == keys_b[j]:
                    options.append((best[i + 1][j + 1] + 1, 1, 1))
                if p and keys_b[j:j + len(p)] == p:
                    options.append((best[i + 1][j + len(p)] + len(p), 1, len(p)))
                if q and keys_a[i:i + len(q)] == q:
                    options.append((best[i + len(q)][j + 1] + len(q), len(q), 1))
            if options:
                score, di, dj = max(options)
                best[i][j], move[i][j] = score, (di, dj)
    out, i, j = [], 0, 0
    while i < n or j < m:
        di, dj = move[i][j]
        if not dj:
            out.append(a[i] | {"o": 1})
        elif not di:
            out.append(b[j] | {"o": 1})
        elif a[i]["k"] == "+" and b[j]["k"] != "+":
            out.append(_join(a[i], {"k": "+", "body": b[j:j + dj]}))
        elif b[j]["k"] == "+" and a[i]["k"] != "+":
            out.append(_join({"k": "+", "body": a[i:i + di]}, b[j]))
        else:
            out.append(_join(a[i], b[j]))
        i, j = i + di, j + dj
    return out


def kept_slots(wrapper: list[dict]) -> dict[str, list[int]]:
    """Of each structure that went into a wrapper, the slots that hold the article.

    A slot inside nav, footer and the like, or inside something whose class says so, is
    not the article. If its own structure has an article or main element, its slots there are; else those
    that are not mostly links and do not say the same on pages of different contents.
    """
    found: list[tuple[str, int, int, bool]] = []

    def walk(nodes: list[dict]) -> None:
        for node in nodes:
            if node["k"] == "+":
                walk(node["body"])
            elif node["k"] == "#":
                pages, size, linked, same = node["f"]
                plain = 2 * linked <= size and not (len(pages) >= _FIXED_PAGES and same is not None)
                found.extend((key, slot, place, plain) for key, slot, place in node["t"])

    walk(wrapper)
    with_main = {key for key, _, place, _ in found if place == 1}
    out: dict[str, list[int]] = {}
    for key, slot, place, plain in found:
        if place == 1 or (place == 0 and plain and key not in with_main):
            out.setdefault(key, []).append(slot)
    return out


def _outside(wrapper: list[dict]) -> set[int]:
    """Slots of a wrapper inside menus, footers and the like."""
    out = set()
    for node in wrapper:
        if node["k"] == "+":
            out |= _outside(node["body"])
        elif node["k"] == "#":
            out.update(slot for _, slot, place in node["t"] if place < 0)
    return out


def host_of(url: str | None) -> str:
    """The host of a URL in lower case; empty where there is none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _key(skeleton: str) -> str:
    return hashlib.sha1(skeleton.encode()).hexdigest()


def _structures(pages: DataFrame) -> DataFrame:
    """(host, key, skeleton, facts): each structure of each task's pages of a host, with what its slots hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "html"):
            seen: dict[tuple[str, str], dict[str, list]] = {}
            outside: dict[str, set[int]] = {}
            for url, page in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                skeleton, tokens, slot_of = structure(page)
                facts = seen.setdefault((host_of(url), skeleton), {})
                if skeleton not in outside:
                    outside[skeleton] = _outside(_wrapper(skeleton, "", {}))
                inside = [t for (unit, t, _), slot in zip(tokens, slot_of, strict=True)
                          if unit == "#" and slot not in outside[skeleton]]
                page_key = _key("\0".join(inside))[:16]
                for (unit, text, linked), slot in zip(tokens, slot_of, strict=True):
                    if unit == "#":
                        one = [[page_key], len(text), linked, _key(text)[:16]]
                        facts[str(slot)] = _facts(facts[str(slot)], one) if str(slot) in facts else one
            rows = [(host, _key(s), s, json.dumps(f)) for (host, s), f in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)],
                                             names=["host", "key", "skeleton", "facts"])

    return pages.select("url", "html").mapInArrow(run, "host string, key string, skeleton string, facts string")


def infer(pages: DataFrame) -> DataFrame:
    """(host, key, slots): the slots of the article in each structure that pages of a host have.

    Every page goes in: tasks fold their pages into distinct structures, these
    meet per host and structure, then in a limited number of parts per host, each folded by alignment into
    a wrapper, and at last the parts' wrappers per host. What is gathered is structures, not pages.
    """
    schema = "host string, wrapper string"

    def merge_same(group: pd.DataFrame) -> pd.DataFrame:
        facts: dict[str, list] = {}
        for text in group["facts"]:
            for slot, f in json.loads(text).items():
                facts[slot] = _facts(facts[slot], f) if slot in facts else f
        key, skeleton = group["key"].iloc[0], group["skeleton"].iloc[0]
        return pd.DataFrame({"host": [group["host"].iloc[0]], "key": [key],
                             "wrapper": [json.dumps(_wrapper(skeleton, key, facts))]})

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        # the most common shape first would need counts; order by text is as fixed
        wrappers = [json.loads(w) for w in sorted(group["wrapper"], key=lambda w: (len(w), w))]
        out = wrappers[0]
        for w in wrappers[1:]:
            out = align(out, w)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(out)]})

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(host, key, slots) for host, w in zip(batch["host"], batch["wrapper"], strict=True)
                    for key, slots in kept_slots(json.loads(w)).items()]
            yield pd.DataFrame(rows, columns=["host", "key", "slots"])

    same = _structures(pages).groupBy("host", "key").applyInPandas(merge_same, "host string, key string, wrapper string")
    parts = same.groupBy("host", F.pmod(F.xxhash64("key"), F.lit(16)).alias("p")).applyInPandas(fold, schema)
    return parts.groupBy("host").applyInPandas(fold, schema).mapInPandas(
        split, "host string, key string, slots array<int>")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page, blocks joined by a line feed.

    Null and empty pages give an empty text; a null or broken url belongs to the host "";
    null and repeated ids give a row each; other columns are ignored; an empty
    table gives no rows. Pages are read twice (structures, texts) and not moved; what was
    inferred is broadcast while it is measured small, else joined by host and structure.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    slots = freeze(infer(base))
    schema = "page_id long, url string, key string, host string, blocks array<struct<slot:int,text:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string())]))
        for part in text_slices(batches, "html"):
            keys, hosts, blocks = [], [], []
            for url, page in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                skeleton, tokens, slot_of = structure(page)
                keys.append(_key(skeleton))
                hosts.append(host_of(url))
                blocks.append([{"slot": s, "text": t[1]} for t, s in zip(tokens, slot_of, strict=True)
                               if t[0] == "#"])
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(keys), pa.array(hosts),
                 pa.array(blocks, kind)], names=["page_id", "url", "key", "host", "blocks"])

    right = slots.select(F.col("host").alias("_host"), F.col("key").alias("_key"), "slots")
    read = base.mapInArrow(run, schema)
    joined = read.join(F.broadcast(right) if fits_broadcast(right) else right,
                       (F.col("host") == F.col("_host")) & (F.col("key") == F.col("_key")), "left")
    kept = F.filter("blocks", lambda b: F.array_contains(F.coalesce("slots", F.array().cast("array<int>")), b["slot"]))
    return joined.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text")) \
        .withColumn("n_chars", F.length("text").cast("long"))
