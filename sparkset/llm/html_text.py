"""Main text of HTML pages by differencing each page with its nearest neighbour.

A page is read into lines of text, one for each block. Pages are ordered by host and path; the neighbour of a page is the
nearest one before or after it on its host that has other lines, whichever shares the longer start of the path (the one before, if
equal). Copies in a row thus have the same two pages to choose from. The lines of
the two are aligned by longest common subsequence, and a line that both have is part of the site and is deleted, on pages with an article
too. Marks are a check after that: what the page itself marks as its article is its own and stays, also where a neighbour quotes or
copies it; what it marks as menus, headers, footers, sidebars, adverts, forms or comments goes in any case.

To give every page its neighbours, the driver takes a sample of keys to cut their order into ranges of about ``RANGE_BYTES``; tasks look keys up in the
broadcast cuts by bisection. Where a host goes on in the
next range, the page at the cut and the nearest one with other lines, from whichever range, are sent across, both ways. They are found from
keys and hashes of the lines; only hosts that are cut are read for it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkset.llm.shared import keep, map_arrow, own_column, read_texts, release, slices

#: Bytes of html in a range. Beyond ``MOST_RANGES`` of them, ranges grow: the driver holds ``SAMPLE`` keys for each.
RANGE_BYTES = 16_000_000
MOST_RANGES = 20_000
SAMPLE = 20

#: Elements of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head svg math iframe object canvas audio video".split())
BOILERPLATE = frozenset("nav aside footer form menu button select textarea dialog".split())
ARTICLE = frozenset("article main".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: An open p ends where one of these begins.
ENDS_P = BLOCKS - frozenset("html body head caption dd dt li option td th tr tbody thead tfoot legend summary figcaption".split()) | frozenset(["p"])
#: An open element ends where another of its kind begins, within its list or table.
SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",))}
#: Words in class, id or role that mark an element as no part of the article.
MARKED = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|header|masthead|menu|nav|navbar|navigation|newsletter|notice|popup|promo|promoted|related|share|sharing|sidebar|social|sponsored|subscribe|toolbar|widget|alert|complementary|contentinfo|search)(?=$|[\s_-])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")

OWN, MARKUP, OPEN = 0, 1, 2


def lines_of(page: str | None) -> tuple[list[str], list[int]]:
    """Lines of a page's text, and of each whether it is in the article (OWN), in marked boilerplate (MARKUP) or neither (OPEN)."""
    page = page or ""
    stack: list[tuple[str, int]] = [("", OPEN)]
    lines: list[str] = []
    kinds: list[int] = []
    held: list[str] = []
    state = OPEN

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                lines.append(text)
                kinds.append(state)

    at, hidden = 0, 0
    n = len(page)
    while at < n:
        token = _TOKEN.search(page, at)
        if token is None:
            if not hidden:
                held.append(page[at:])
            break
        if token.start() > at and not hidden:
            held.append(page[at : token.start()])
        at = token.end()
        if token[2] is None:
            continue
        name = token[2].lower()
        if token[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if not depth:
                continue
            if name in BLOCKS or any(x in BLOCKS for x, _ in stack[depth:]):
                if name not in BLOCKS:  # a stray inline end does not close the blocks in it
                    stack.pop(depth)
                    continue
                flush()
            hidden -= sum(x in HIDDEN for x, _ in stack[depth:])
            del stack[depth:]
            state = stack[-1][1]
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCKS:
            flush()
            if name in ENDS_P:
                _end_p(stack)
            if name in SIBLINGS:
                _end_siblings(stack, *SIBLINGS[name])
            state = stack[-1][1]
        if name in VOID or token[3].endswith("/") and name not in BLOCKS:
            continue
        if name == "body":
            hidden -= sum(x in HIDDEN for x, _ in stack)
            stack = [x for x in stack if x[0] not in HIDDEN]
            state = OPEN
        kind = state
        if name in ARTICLE and state != MARKUP:
            kind = OWN
        elif name in BOILERPLATE or name == "header" and state != OWN:
            kind = MARKUP
        elif token[3] and name not in ("body", "html") and name not in ARTICLE and any(MARKED.search(next(filter(None, m.groups()), "")) for m in _NAMED.finditer(token[3])):
            kind = MARKUP
        if kind != state:
            flush()
        if name in RAW or name in HIDDEN:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at) if name in RAW else None
            if name in RAW:
                at = end.end() if end else n
                continue
            hidden += 1
        stack.append((name, kind))
        state = kind
    flush()
    return lines, kinds


def _end_p(stack: list[tuple[str, int]]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        name = stack[i][0]
        if name == "p":
            del stack[i]
            return
        if name in BLOCKS:
            return


def _end_siblings(stack: list[tuple[str, int]], names: tuple[str, ...], within: tuple[str, ...]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i][0] in within:
            return
        if stack[i][0] in names:
            del stack[i:]
            return


def shared_lines(a: list, b: list) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of both; the earliest lines of ``b`` are taken.

    Rows of the alignment are bit sets over ``b``, so that a page of thousands of lines stays small.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    masks: dict = {}
    for j, v in enumerate(y):
        masks[v] = masks.get(v, 0) | 1 << j
    common = [i for i, v in enumerate(x) if v in masks]
    full = (1 << len(y)) - 1
    row, rows = full, []
    for i in common:
        rows.append(row)
        met = row & masks[x[i]]
        row = (row + met | row - met) & full
    found, j = [], len(y)
    for i, before in zip(reversed(common), reversed(rows)):
        # a zero bit of a row marks where the length grows; take the line if the length at j needs it
        after = before & masks[x[i]]
        after = (before + after | before - after) & full
        cut = (1 << j) - 1
        if (~after & cut).bit_count() > (~before & cut).bit_count():
            below = (~before & cut).bit_count()
            j = next(k for k in _bits(masks[x[i]] & cut, j) if (~before & ((1 << k) - 1)).bit_count() == below)
            found.append(start + i)
    return [*range(start), *reversed(found), *range(len(a) - end, len(a))]


def _bits(mask: int, below: int) -> Iterator[int]:
    """Set bits from the highest down."""
    while mask:
        k = mask.bit_length() - 1
        yield k
        mask ^= 1 << k


def main_lines(lines: list[str], kinds: list[int], neighbour: list[str] | None) -> list[str]:
    """Lines of the main text, given the lines outside the article of the neighbouring page. Without a neighbour, a page with an article is that article."""
    outside = [i for i, k in enumerate(kinds) if k != OWN]
    gone = {outside[p] for p in shared_lines([lines[i] for i in outside], neighbour)} if neighbour else set()
    only_article = neighbour is None and OWN in kinds
    return [x for i, (x, k) in enumerate(zip(lines, kinds)) if k == OWN or k == OPEN and not only_article and i not in gone]


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.lower(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)), F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _common_start(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without its html, plus ``text``: the lines of the main text.

    Whole pages are read. Null and empty pages have an empty text; pages with a null url, or without ://, are of one nameless host.
    A page alone on its host is read by its own marks, and so is one where all pages have the same lines: a copy tells nothing of the
    site. Repeated rows stay; null ids are carried along; a
    column named text is replaced.
    """
    spark = pages.sparkSession
    carried = [c for c in pages.columns if c.lower() not in (html_col.lower(), "text")]
    key, copy, part, body = (own_column(pages, n) for n in ("key_", "copy_", "part_", "body_"))
    host, path = host_and_path(F.col(f"`{url_col}`"))
    # U+0001 sorts a host before those that it begins; the id and a hash break ties
    light = F.concat_ws("\x01", host, path, F.lpad(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), 20, "0"))
    order = F.concat_ws("\x01", light, F.hex(F.xxhash64(F.coalesce(F.col(f"`{html_col}`"), F.lit("")))))
    keys = pages.select(light.alias("key"))
    total, size = pages.agg(F.count("*"), F.sum(F.octet_length(F.col(f"`{html_col}`").cast("string")))).first()
    ranges = min(MOST_RANGES, max((size or 0) // RANGE_BYTES + 1, min(total, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    wanted = max(4000, SAMPLE * ranges)
    sample = sorted({r["key"].encode() for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(max(1, total // wanted))) == 0).limit(4 * wanted).collect()})
    cuts = spark.sparkContext.broadcast(sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else [])

    def ends_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[bytes, bytes]] = {}
        for batch in batches:
            for k in map(str.encode, batch.column(0).to_pylist()):
                at = bisect_right(cuts.value, k)
                first, last = found.get(at, (k, k))
                found[at] = min(first, k), max(last, k)
        if found:
            firsts, lasts = zip(*found.values())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([x.decode() for x in firsts]), pa.array([x.decode() for x in lasts])], names=["part", "first", "last"])

    rows = keys.mapInArrow(ends_of, "part int, first string, last string").groupBy("part").agg(F.min("first").alias("first"), F.max("last").alias("last")).orderBy("part").collect()
    sent = spark.sparkContext.broadcast(_across(pages, light, order, F.col(f"`{html_col}`").cast("string"), cuts, rows))

    df = pages.select(*[F.col(f"`{c}`") for c in carried], order.alias(key), light.alias(copy), F.col(f"`{html_col}`").cast("string").alias(body))
    schema = df.select(*[F.col(f"`{c}`") for c in carried], key, F.lit(None).cast("array<struct<ghost:boolean,part:int>>").alias(copy), F.lit(b"").alias(body)).schema
    at_text = len(carried) + 2
    copies_of = pa.list_(pa.struct([("ghost", pa.bool_()), ("part", pa.int32())]))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                packed, copies = [], []
                for place, page in zip(piece.column(at_text - 1).to_pylist(), piece.column(at_text)):
                    lines, kinds = lines_of(page.as_py())
                    packed.append(pack("\n".join(f"{k}{x}" for x, k in zip(lines, kinds)).encode("utf-8", "surrogatepass")))
                    copies.append([{"ghost": False, "part": bisect_right(cuts.value, place.encode())}, *({"ghost": True, "part": p} for p in sorted(sent.value.get(place, ())))])
                yield pa.RecordBatch.from_arrays([*piece.columns[:-2], pa.array(copies, copies_of), pa.array(packed, pa.binary())], names=piece.schema.names)

    lined = map_arrow(df, read, schema)
    dealt = lined.select(*[F.col(f"`{c}`") for c in carried], key, body, F.explode(copy).alias(copy)).select(*[F.col(f"`{c}`") for c in carried], key, body, F.col(f"{copy}.ghost").alias(copy), F.col(f"{copy}.part").alias(part))
    dealt = dealt.repartition(max(ranges, int(spark.conf.get("spark.sql.shuffle.partitions"))), part).sortWithinPartitions(part, key)
    at_key = len(carried)
    out_schema = pages.select(*[F.col(f"`{c}`") for c in carried], F.lit("").alias("text")).schema

    def difference(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        names = out_schema.names

        def opened(batch: pa.RecordBatch, i: int) -> dict:
            raw = unpack(batch.column(at_key + 1)[i].as_py()).decode("utf-8", "surrogatepass")
            marked = raw.split("\n") if raw else []
            lines, kinds = [x[1:] for x in marked], [int(x[0]) for x in marked]
            host, path, *_ = batch.column(at_key)[i].as_py().encode().split(b"\x01")
            return {"batch": batch, "i": i, "ghost": batch.column(at_key + 2)[i].as_py(), "site": (batch.column(at_key + 3)[i].as_py(), host), "path": path, "lines": lines, "kinds": bytes(kinds)}

        def rows() -> Iterator[dict]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield opened(batch, i)

        def judged() -> Iterator[tuple[dict, str]]:
            before: dict | None = None
            run: list[dict] = []  # pages of a site with the same lines, which are held once
            for after in _with_end(rows()):
                if run and after is not None and after["site"] == run[0]["site"] and after["lines"] == run[0]["lines"]:
                    run.append(after | {"lines": run[0]["lines"]})
                    continue
                for now in run:
                    if not now["ghost"]:
                        near = [(_common_start(now["path"], x["path"]), -k, x) for k, x in enumerate((before, after)) if x is not None and x["site"] == now["site"]]
                        other = max(near, key=lambda n: n[:2])[2] if near else None
                        yield now, "\n".join(main_lines(now["lines"], now["kinds"], other and [x for x, k in zip(other["lines"], other["kinds"]) if k != OWN]))
                before, run = run[-1] if run else None, [after]

        held: list[tuple[dict, str]] = []
        for pair in judged():
            if held and (pair[0]["batch"] is not held[0][0]["batch"] or len(held) >= 256):
                yield _rows_out(held, at_key, names)
                held = []
            held.append(pair)
        if held:
            yield _rows_out(held, at_key, names)

    return map_arrow(dealt, difference, out_schema)


def _across(pages: DataFrame, light: Column, order: Column, body: Column, cuts, rows: list) -> dict[str, set[int]]:
    """Keys of the pages that other ranges need, with those ranges. ``rows``: part, first and last key of each range that has pages."""
    ends = [(r["part"], r["first"].split("\x01")[0], r["last"].split("\x01")[0]) for r in rows]
    cut = [i for i in range(1, len(ends)) if ends[i - 1][2] == ends[i][1]]
    if not cut:
        return {}
    host = F.substring_index("key", "\x01", 1)
    names = sorted({ends[i][1] for i in cut})
    hosts = pages.sparkSession.createDataFrame([(n,) for n in names], "host string")  # as many as ranges at most
    near = pages.select(light.alias("key"), order.alias("at"), body.alias("body")).withColumn("host", host).join(F.broadcast(hosts), "host").select("key", "at", "body", "host")

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [xxhash.xxh3_128_digest("\n".join(lines_of(page.as_py())[0]).encode("utf-8", "surrogatepass")) for page in batch.column(2)]
            parts = [bisect_right(cuts.value, k.encode()) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(made, pa.binary()), batch.column(3), pa.array(parts, pa.int32())], names=["key", "at", "lines", "host", "part"])

    seen = keep(map_arrow(near, told, "key string, at string, lines binary, host string, part int").select("part", "host", F.struct("at", "key", "lines").alias("page")))
    outer = keep(seen.groupBy("part", "host").agg(F.min("page").alias("first"), F.max("page").alias("last")))
    other = lambda end: F.when(F.col("page.lines") != F.col(f"{end}.lines"), F.col("page"))
    inner = seen.join(F.broadcast(outer), ["part", "host"]).groupBy("part", "host").agg(F.min(other("first")).alias("first"), F.max(other("last")).alias("last"))
    found = {(r["part"], r["host"]): r for r in outer.collect()}
    further = {(r["part"], r["host"]): r for r in inner.collect()}
    release(seen)
    release(outer)
    out: dict[str, set[int]] = {}
    for end, steps in (("last", [(i - 1, i) for i in cut]), ("first", [(i, i - 1) for i in reversed(cut)])):
        carried, came, at = (), None, None  # the two pages that came into a range, from its far side
        for source, target in steps:
            name = ends[target][1 if end == "last" else 2]
            here = found[ends[source][0], name][end]
            pages_sent = [here, further[ends[source][0], name][end]]
            if pages_sent[1] is None and (came, at) == (source, name):
                pages_sent[1] = next((p for p in carried if p["lines"] != here["lines"]), None)
            carried, came, at = tuple(p for p in pages_sent if p is not None), target, name
            for p in carried:
                out.setdefault(p["key"], set()).add(ends[target][0])
    return out


def _with_end(rows: Iterable[dict]) -> Iterator[dict | None]:
    yield from rows
    yield None


def _rows_out(held: list[tuple[dict, str]], n: int, names: list[str]) -> pa.RecordBatch:
    batch = held[0][0]["batch"]
    taken = pa.array([r["i"] for r, _ in held])
    return pa.RecordBatch.from_arrays([*[batch.column(c).take(taken) for c in range(n)], pa.array([t for _, t in held], pa.string())], names=names)


def op5_main_text(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    text = extract(read_texts(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
