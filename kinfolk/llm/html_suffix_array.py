"""HTML extraction: a suffix array over each host's pages finds what repeats, page structure judges what does not.

Every page is cut into blocks. A block is inside <article> (else <main>), or in a menu, header, footer, sidebar, notice,
advert, form or reader comment (by element, role, class or id), or open, where the page does not mark its article. A
page's token stream has a token for the start of each block with its kind, then the block's words; of a block inside the
article, one token for the whole text.

The streams of a host are concatenated, their suffixes sorted to full depth, and the longest common prefixes of neighbours
taken. Suffixes that share MIN_RUN tokens or more are a repeated run, which counts the distinct pages it stands on. All
blocks wait for what the repeats say. Outside the article, runs of enough pages are boilerplate, whatever they are called:
a block they cover goes, and from one they cover in part they are cut out. A block inside the article goes that stands on
half of the host's pages while the rest of their articles differs (an advert or notice that no name tells); else the
article's text is never cut, as articles may well share a passage. Structure judges last, and only what is unique to its
page: there the open blocks stay, and the blocks that it names as no part of the article go.

Pages whose whole text is equal are one page (a mirror does not erase its own text) and are dealt once. A host may hold a
third of all pages, so its pages are dealt to shards of bounded size. Each shard has its suffix array and reduces its runs
to one row per distinct start of MIN_RUN tokens; those rows meet by host and run, which adds up the pages over the shards,
and what is repeated goes back to the shards that have it.

Defined results: null html is an empty text; a page without a host is judged by structure alone; repeated rows are kept;
an empty table gives an empty result; extra columns are ignored.
"""

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfolk.llm.words import pieces
from kinfolk.runtime import sized_join, stored

#: Tokens of the shortest repeated run that counts, starts of blocks included.
MIN_RUN = 8
#: Share of a block's words inside repeated runs from which on it is boilerplate.
COVERED = 0.9
#: Pages that a run must stand on: at least so many, and that share of the host's distinct pages.
LEAST_PAGES, PAGE_SHARE = 3, 0.02
#: The same for a block inside the article, and the share of these pages whose articles must differ otherwise.
ARTICLE_PAGES, ARTICLE_SHARE, OTHER_BODIES = 5, 0.5, 0.8
#: Pages of a shard, about.
SHARD_PAGES = 256
PIECE = 4 << 20

#: Element and attribute names that tell what a part of a page is.
RAW = "script|style|noscript|iframe|textarea|title"
#: Elements whose content is not text of the page; unlike RAW they nest and end with their parent.
DROPPED = frozenset("template svg object select canvas button".split())
#: Elements that may be taken out of an article for their class or id.
CONTAINERS = frozenset("div section aside ul ol dl table details header footer".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IMPLIED_END = frozenset("p li dt dd tr td th".split())
BOILER_ELEMENTS = frozenset("nav footer aside form dialog menu head".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices newsletter subscribe subscription signup signin login popup modal overlay sidebar widget widgets related recommended recommendations share sharing social comment comments commentlist disqus respond replies footer masthead nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar skip copyright disclaimer".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])[^>]*(?<!/)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+)>"""
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|<[!?][^>]*>|<[!?/a-zA-Z][^>]*\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"""([a-zA-Z][\w:-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

ARTICLE, OPEN, BOILER = 0, 1, 2


def _attributes(attrs: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}


def _words_of_names(a: dict[str, str]) -> set[str]:
    return {w.lower() for k in ("class", "id") for w in _PART.findall(a.get(k, ""))}


def _whole_names(a: dict[str, str]) -> list[list[str]]:
    """The words of each token of class and id."""
    return [[w.lower() for w in _PART.findall(t)] for k in ("class", "id") for t in a.get(k, "").split()]


def blocks_of(html: str) -> list[tuple[int, str]]:
    """The blocks of a page in order: kind (ARTICLE, OPEN or BOILER) and text, white space already single."""
    tokens = []
    open_at: dict[str, list[int]] = {}
    close_of: dict[int, int] = {}
    nest: list[tuple[str, int]] = []
    dropped: dict[int, int | None] = {}
    before: list[int] = []  # characters of text before each token
    at = so_far = 0
    for m in _TOKEN.finditer(html):
        name = (m["name"] or m["name2"] or "").lower()
        end = bool(m["end"] or m["end2"])
        k = len(tokens)
        tokens.append((m.start(), m.end(), name, end, m["attrs"] or m["attrs2"] or ""))
        so_far += m.start() - at
        before.append(so_far)
        at = m.end()
        if not name or name in VOID:
            continue
        if end:
            inner = next((j for j in range(len(nest) - 1, -1, -1) if nest[j][0] == name), None)
            if inner is not None and (name in BLOCKS or name in DROPPED or not any(x in BLOCKS for x, _ in nest[inner:])):
                if name in DROPPED:
                    dropped[nest[inner][1]] = k
                del nest[inner:]
            if open_at.get(name):
                close_of[open_at[name].pop()] = k
        elif name in DROPPED:
            if not tokens[k][4].rstrip().endswith("/"):
                dropped[k] = None
                nest.append((name, k))
        else:
            nest.append((name, k))
            if name in IMPLIED_END and open_at.get(name):
                close_of[open_at[name].pop()] = k
            open_at.setdefault(name, []).append(k)

    before.append(so_far + len(html) - at)
    last = len(tokens)
    drop = np.zeros(last + 1, bool)
    for k, to in dropped.items():
        # never closed inside its parent: no further than the next block
        drop[k : next((j for j in range(k + 1, last) if tokens[j][2] in BLOCKS), last) if to is None else to] = True
    articles, mains, boilers = [], [], []
    for k, (_, _, name, end, attrs) in enumerate(tokens):
        if not name or end or name in VOID or name in DROPPED or drop[k]:
            continue
        a = _attributes(attrs) if attrs.strip() else {}
        role = a.get("role", "").lower()
        words = _words_of_names(a) if a else set()
        to = close_of.get(k)
        if name == "article" and not (words & COMMENT_WORDS and any(t and t[0] in COMMENT_WORDS for t in _whole_names(a))):
            articles.append((k, last if to is None else to))
        elif name == "main" or role == "main" or a.get("itemprop") == "articleBody":
            mains.append((k, last if to is None else to))
        elif name in BOILER_ELEMENTS or role in BOILER_ROLES or name == "header" or (words & BOILER_WORDS and name not in ("body", "html")) or (attrs and _HIDDEN.search(attrs)):
            named = bool(words & BOILER_WORDS)
            # by its class or id alone: whether an article may lose it
            only = named and name not in BOILER_ELEMENTS and name != "header" and role not in BOILER_ROLES and name != "article" and not _HIDDEN.search(attrs)
            whole = name in CONTAINERS and any(t and BOILER_WORDS.issuperset(t) for t in _whole_names(a)) if only else True
            boilers.append((k, to, name, named or name != "header", only, whole))
    marks = articles + mains
    cuts = []
    for k, to, name, certain, only, whole in boilers:
        if to is None:  # never closed: no further than the next block
            to = next((j for j in range(k + 1, last) if tokens[j][2] in BLOCKS), last)
        if any(k < a < to for a, _ in marks) or (not certain and any(a < k < b for a, b in articles)):
            continue  # it holds the article, or is the article's own header
        if only:
            around = [(a, b) for a, b in articles or mains if a < k < b]
            if around and (not whole or any(2 * (before[to] - before[k]) > before[b] - before[a] for a, b in around)):
                continue  # part of the article's text
        cuts.append((k, to))
    articles = [(a, b) for a, b in articles if not any(c < a < d for c, d in cuts)] or None
    if articles is None and mains:
        articles, mains = mains, []

    kind_at = np.full(last + 1, BOILER if articles else OPEN, np.int8)
    for a, b in mains:
        kind_at[a:b] = OPEN
    for a, b in articles or ():
        kind_at[a:b] = ARTICLE
    for a, b in cuts:
        kind_at[a:b] = BOILER

    out: list[tuple[int, str]] = []
    parts: list[str] = []
    kind = BOILER if articles else OPEN

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append((kind, text))
        parts.clear()

    at = 0
    for k, (start, stop, name, _, _) in enumerate(tokens):
        if start > at and not (k and drop[k - 1]):
            text = html[at:start]
            parts.append(unescape(text) if "&" in text else text)
        at = stop
        if drop[k]:
            continue
        if name in BLOCKS or kind_at[k] != kind:
            flush()
            kind = int(kind_at[k])
        elif name in ("br", "td", "th"):
            parts.append(" ")
    if at < len(html) and not (last and drop[last - 1]):
        parts.append(unescape(html[at:]))
    flush()
    return out


def _token(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def stream_of(blocks: list[tuple[int, str]]) -> list[int]:
    """The tokens of a page: the kind of each block, then its words, or one token for the text of an ARTICLE block."""
    out: list[int] = []
    for kind, text in blocks:
        out.append(kind)
        out += [_token(text)] if kind == ARTICLE else [_token(w) for w in text.split(" ")]
    return out


def _parse(batches):
    for b in pieces(batches, "html", PIECE):
        kept, keys, streams = [], [], []
        for html in b.column("html").to_pylist():
            blocks = blocks_of(html or "")
            stream = np.array(stream_of(blocks), np.uint64)
            kept.append([{"kind": kind, "text": text} for kind, text in blocks])
            keys.append(xxhash.xxh3_128_hexdigest(stream.tobytes()))
            streams.append(stream.view(np.int64))
        block = pa.struct([("kind", pa.int8()), ("text", pa.string())])
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), b.column("host"), pa.array(keys), pa.array(kept, pa.list_(block)), pa.array(streams, pa.list_(pa.int64()))],
            ["page_id", "url", "host", "skey", "blocks", "stream"],
        )


_PARSED = "page_id long, url string, host string, skey string, blocks array<struct<kind:tinyint,text:string>>, stream array<long>"


def host_of(url: Column) -> Column:
    """The host of a url in lower case; null if it has none."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and the longest common prefix of each with the one before it (0 for the first).

    By prefix doubling to full depth; the ranks of every depth give the common prefixes, from the longest depth down.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    levels, have = [rank], 1
    while n and rank.max() < n - 1:
        ahead = np.full(n, -1, np.int64)
        ahead[:-have] = rank[have:]
        rank = np.unique(rank * (n + 1) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        have *= 2
    order = np.argsort(rank, kind="stable")
    a, b, common = order[:-1], order[1:], np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = np.maximum(x, y) + (1 << k) <= n
        equal = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        common += equal * (1 << k)
    return order, np.concatenate(([0] * bool(n), common)).astype(np.int64)


def joined(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Streams in one array, a separator of its own after each, with their page numbers, and which positions start a run of
    MIN_RUN tokens of one page."""
    sizes = np.array([len(s) + 1 for s in streams], np.int64)
    ends = np.cumsum(sizes)
    tokens = np.concatenate([x for k, s in enumerate(streams) for x in (s, [-1 - k])]).astype(np.int64) if streams else np.empty(0, np.int64)
    page = np.repeat(np.arange(len(streams)), sizes)
    return tokens, page, np.arange(len(tokens)) + MIN_RUN < np.repeat(ends, sizes)


def runs_from(tokens: np.ndarray) -> np.ndarray:
    """A hash of the MIN_RUN tokens from each position on, the same in every shard."""
    h = np.zeros(len(tokens), np.uint64)
    t = tokens.view(np.uint64)
    for k in range(min(MIN_RUN, len(t))):
        h[: len(t) - k if k else None] = (h[: len(t) - k if k else None] ^ t[k:]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _streams(table: pa.Table) -> list[np.ndarray]:
    column = table.column("stream").combine_chunks()
    flat, at = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def article_blocks(stream: np.ndarray) -> np.ndarray:
    """The distinct tokens of the blocks inside the article."""
    return np.unique(stream[np.flatnonzero(stream[:-1] == ARTICLE) + 1]) if len(stream) else stream


_RUNS = pa.schema([("host", pa.string()), ("shard", pa.int64()), ("article", pa.bool_()), ("run", pa.int64()), ("pages", pa.int64()), ("bodies", pa.int64())])
RUNS = "host string, shard long, article boolean, run long, pages long, bodies long"


def shard_runs(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of some pages and the number of pages each stands on."""
    tokens, page, starts = joined(streams)
    if not starts.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order, common = suffix_array(tokens)
    group = np.cumsum(common < MIN_RUN)  # neighbours that share MIN_RUN tokens are in one group
    inside = starts[order]
    order, group = order[inside], group[inside]
    by = np.lexsort((page[order], group))
    order, group = order[by], group[by]
    new_run = np.concatenate(([True], group[1:] != group[:-1]))
    new_page = new_run | np.concatenate(([True], page[order][1:] != page[order][:-1]))
    first = np.flatnonzero(new_run)
    return runs_from(tokens)[order[first]], np.add.reduceat(new_page.astype(np.int64), first)


def repeated_article_blocks(streams: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Blocks inside the articles of two pages or more: token, pages, and how many different articles these pages have
    beside it, told by their smallest other block."""
    held: dict[int, list[int]] = {}
    for s in streams:
        own = article_blocks(s)
        for k, x in enumerate(own.tolist()):
            held.setdefault(x, []).append(int(own[0] if k else own[1]) if len(own) > 1 else 0)
    return [(x, len(v), len(set(v))) for x, v in held.items() if len(v) > 1]


def _shard_runs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    streams = _streams(table)
    run, pages = shard_runs(streams)
    blocks = repeated_article_blocks(streams)
    n, m = len(run), len(blocks)
    token, many, bodies = (list(x) for x in zip(*blocks, strict=True)) if blocks else ([], [], [])
    columns = [[key[0].as_py()] * (n + m), [key[1].as_py()] * (n + m), [False] * n + [True] * m, np.concatenate((run, np.array(token, np.int64))), np.concatenate((pages, np.array(many, np.int64))), [0] * n + bodies]
    return pa.table(columns, schema=_RUNS)


def judge(stream: np.ndarray, repeated: np.ndarray, notices: np.ndarray) -> tuple[list[int], list[dict], int, int]:
    """The blocks that go; what stays of open blocks that repeats cover in part, as at and keep (ranges of words); and how
    many blocks outside the article repeats and then structure took."""
    starts = np.flatnonzero((stream >= 0) & (stream <= BOILER))
    change = np.zeros(len(stream) + 1, np.int64)
    hit = np.flatnonzero(np.isin(runs_from(stream)[: max(0, len(stream) - MIN_RUN + 1)], repeated))
    np.add.at(change, hit, 1)
    np.add.at(change, hit + MIN_RUN, -1)
    inside = np.cumsum(change)[:-1] > 0
    covered = np.concatenate(([0], np.cumsum(inside)))
    drop, cut, by_repeats, by_structure = [], [], 0, 0
    for k, (a, b) in enumerate(zip((starts + 1).tolist(), [*starts[1:].tolist(), len(stream)], strict=True)):
        kind, shared = int(stream[a - 1]), int(covered[b] - covered[a])
        if kind == ARTICLE:
            if stream[a] in notices:
                drop.append(k)
        elif shared >= COVERED * (b - a):
            by_repeats += 1
            drop.append(k)
        elif kind == BOILER:
            by_structure += 1
            drop.append(k)
        elif shared:
            turns = np.flatnonzero(np.diff(np.concatenate(([1], inside[a:b].astype(np.int8), [1]))))
            cut.append({"at": k, "keep": [{"a": int(x), "b": int(y)} for x, y in zip(turns[::2], turns[1::2], strict=True)]})
    return drop, cut, by_repeats, by_structure


_KEEP = pa.struct([("a", pa.int32()), ("b", pa.int32())])
_MARKS = pa.schema([("host", pa.string()), ("skey", pa.string()), ("drop", pa.list_(pa.int32())), ("cut", pa.list_(pa.struct([("at", pa.int32()), ("keep", pa.list_(_KEEP))]))), ("by_repeats", pa.int32()), ("by_structure", pa.int32())])
MARKS = "host string, skey string, drop array<int>, cut array<struct<at:int,keep:array<struct<a:int,b:int>>>>, by_repeats int, by_structure int"


def _mark_group(key: tuple[pa.Scalar, ...], pages: pa.Table, runs: pa.Table) -> pa.Table:
    run, article = runs.column("run").to_numpy(), runs.column("article").to_numpy(zero_copy_only=False).astype(bool)
    repeated, notices = np.unique(run[~article]), np.unique(run[article])
    judged = [judge(s, repeated, notices) for s in _streams(pages)]
    columns = [pa.array([x[k] for x in judged], _MARKS.field(k + 2).type) for k in range(4)]
    return pa.table([pages.column("host"), pages.column("skey"), *columns], schema=_MARKS)


def mark(parsed: DataFrame, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """host, skey, drop (numbers of the blocks that go), cut (what stays of blocks covered in part), by_repeats, by_structure
    (blocks outside the article that each took) of every distinct page with a host."""
    distinct = parsed.filter(F.col("host").isNotNull() & (F.size("stream") > 0)).select("host", "skey", "stream")
    distinct = stored(distinct.groupBy("host", "skey").agg(F.first("stream").alias("stream")), "distinct")
    sizes = stored(distinct.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    shards = sizes.select("host", F.ceil(F.col("n") / shard_pages).alias("shards"))
    dealt = sized_join(distinct, shards, "host", "inner").withColumn("shard", F.pmod(F.xxhash64("skey"), F.col("shards")).cast("long"))
    runs = stored(dealt.select("host", "shard", "stream").groupBy("host", "shard").applyInArrow(_shard_runs, RUNS), "runs")
    often = runs.groupBy("host", "article", "run").agg(F.sum("pages").alias("pages"), F.sum("bodies").alias("bodies")).filter(f"pages >= {LEAST_PAGES}")
    share = lambda least, part: F.greatest(F.lit(float(least)), F.col("n") * F.lit(part))
    frame = ~F.col("article") & (F.col("pages") >= share(LEAST_PAGES, PAGE_SHARE))
    notice = F.col("article") & (F.col("pages") >= share(ARTICLE_PAGES, ARTICLE_SHARE)) & (F.col("bodies") >= F.col("pages") * F.lit(OTHER_BODIES))
    often = stored(sized_join(often, sizes, "host", "inner").filter(frame | notice).select("host", "article", "run"), "often")
    repeated = sized_join(runs, often, ["host", "article", "run"], "left_semi").select("host", "shard", "article", "run")
    pages = dealt.select("host", "shard", "skey", "stream").groupBy("host", "shard")
    return pages.cogroup(repeated.groupBy("host", "shard")).applyInArrow(_mark_group, MARKS)


def parse(pages: DataFrame) -> DataFrame:
    """page_id, url, host, skey (of the whole text), blocks (kind and text of all), stream."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    return source.mapInArrow(_parse, _PARSED)


def kept_text(blocks: Column, drop: Column, cut: Column) -> Column:
    """The text of a page by its marks; without marks (a page without a host) structure alone judges."""
    numbered = F.transform(blocks, lambda x, k: F.struct(k.alias("at"), x["kind"].alias("kind"), x["text"].alias("text")))
    stays = F.filter(numbered, lambda x: F.when(drop.isNull(), x["kind"] != BOILER).otherwise(~F.array_contains(drop, x["at"])))

    def shown(x: Column) -> Column:
        keep = F.get(F.filter(cut, lambda c: c["at"] == x["at"]), F.lit(0))["keep"]
        runs = F.transform(keep, lambda r: F.array_join(F.slice(F.split(x["text"], " "), r["a"] + 1, r["b"] - r["a"]), " "))
        return F.when(keep.isNull(), x["text"]).otherwise(F.array_join(runs, " "))

    return F.array_join(F.transform(stays, shown), "\n")


def extract(pages: DataFrame, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """page_id, url, text (main text, blocks joined by newlines), n_chars of every page."""
    parsed = stored(parse(pages), "parsed")
    marks = stored(mark(parsed, shard_pages).select("host", "skey", "drop", "cut"), "marks")
    rows = sized_join(parsed.drop("stream"), marks, ["host", "skey"], "left")
    text = kept_text(F.col("blocks"), F.col("drop"), F.col("cut"))
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
