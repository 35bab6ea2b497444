"""Operator 3, HTML extraction: nearest-URL page differencing.

Each page becomes text lines, one a block.  All pages are sorted by host and path, each is paired with that neighbour
on its host whose path shares the longest start, their lines are aligned by longest common subsequence, and the lines
that both have are deleted.  Markup corrects what differencing alone gets wrong:

* Lines within <article> or <main> are protected: articles of one host do share sentences.
* Lines of elements whose markup names them as furniture (nav, footer, forms, adverts, comments, ...) are aligned like
  any others, and go even where no neighbour has them: an advert or a dated footer differs on every page.

What then decides is how much text differencing leaves: where more is left outside <article> and <main> than stands
within, such elements are teasers beside the text and all remaining lines are its main text, else those within are.

Defined results: null and empty pages have an empty text; a page alone on its host, or without a url, shares no line;
ties between neighbours go to the one before; repeated rows stay repeated (and as one row to their neighbours); only the
three columns named are read.  Unclosed elements end with what holds them.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import slices, stored
from .url_filter import split_url

_TAG = re.compile(r"<(?:!--(?P<comment>)|(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|(?P<other>[!?/][^>]*+>))")
_ATTR = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_OFF = frozenset("head nav footer aside form menu dialog button select svg math canvas object audio video map search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|side-bar|aside|ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|"
    r"banner|notice|notices|alert|cookie|cookies|cookie-?bar|consent|gdpr|newsletter|subscribe|subscription|popup|modal|overlay|comment|comments|comment-?list|replies|reply|respond|disqus|"
    r"social|share|sharing|breadcrumb|breadcrumbs|pagination|pager|related|recommended|widget|toolbar|search|login|signup|skip|copyright)(?:$|[\s_-])",
    re.I,
)
#: Class names of a page's text.  An element that has one and a name of furniture too is neither: the neighbouring page decides.
_BODY = re.compile(r"(?:^|\s)(?:(?:article|post|entry|story|page|main|body)[_-]?(?:body|content|text)|articlebody)(?:$|\s)", re.I)
_SPACE = re.compile(r"[\s ]+")


def _off(name: str, attrs: str, in_article: bool) -> bool:
    """Whether an element is furniture by its name or what its attributes say."""
    if name in _OFF or (name == "header" and not in_article):
        return True
    if not attrs or name in ("html", "body", "main"):
        return False
    found = {m[1].lower(): html_lib.unescape((m[2] or "").strip("\"'")) for m in _ATTR.finditer(attrs)}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in _ROLES:
        return True
    names = [found[k] for k in ("class", "id") if found.get(k)]
    return any(map(_NAMED.search, names)) and not any(map(_BODY.search, names))


#: Where a line stands: within article or main, outside them, in an element that markup names as furniture.
INSIDE, OUTSIDE, FURNITURE = 0, 1, 2


def lines(page: str | None) -> list[tuple[str, int]]:
    """(text, where it stands) of each line of a page."""
    out: list[tuple[str, int]] = []
    if not page:
        return out
    stack: list[tuple[str, bool, bool]] = []  # name, off from here on, within an article from here on
    off = article = False
    parts: list[str] = []
    off_parts: list[str] = []

    def flush() -> None:
        for own, zone in ((parts, INSIDE if article else OUTSIDE), (off_parts, FURNITURE)):
            if own:
                text = _SPACE.sub(" ", html_lib.unescape("".join(own))).strip()
                own.clear()
                if text:
                    out.append((text, zone))

    def close_to(depth: int) -> None:
        nonlocal off, article
        if any(n in _BLOCK for n, _, _ in stack[depth:]):
            flush()
        del stack[depth:]
        off, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            (off_parts if off else parts).append(page[at:lt])
        if lt == n:
            break
        m = _TAG.match(page, lt)
        if m is None:
            follows = page[lt + 1 : lt + 2]
            if follows.isalpha() or follows in "/!?" and follows:
                break  # a tag that the page's end cuts off
            (off_parts if off else parts).append("<")
            at = lt + 1
            continue
        if m["comment"] is not None:
            end = page.find("-->", lt + 4)
            if end < 0:
                break
            at = end + 3
            continue
        at = m.end()
        if m["name"] is None:
            continue
        name, attrs = m["name"].lower(), m["attrs"]
        if m["close"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                close_to(depth)
            elif name in _BLOCK:
                flush()
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if end is None:
                break
            at = end.end()
            continue
        if name in _BLOCK:
            flush()
            if name in ("article", "main") and off and not _off(name, attrs, False):
                first = next(i for i, s in enumerate(stack) if s[1])
                close_to(first)  # furniture that isn't closed ends here
            if stack and stack[-1][0] == "p" or any(s[0] == "p" for s in stack[-4:]):
                depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p")
                if all(s[0] not in _BLOCK for s in stack[depth + 1 :]):
                    close_to(depth)
            if name == "li" and stack and stack[-1][0] == "li":
                close_to(len(stack) - 1)
        if name in _VOID:
            if name in ("br", "img", "hr"):
                (off_parts if off else parts).append(" ")
            continue
        if attrs.rstrip().endswith("/") and name not in _BLOCK:
            continue
        here_off = off or _off(name, attrs, article)
        here_article = article or (name in ("article", "main") and not here_off)
        stack.append((name, here_off, here_article))
        off, article = here_off, here_article
    flush()
    return out


def common_lines(a: Sequence[str], b: Sequence[str]) -> set[int]:
    """Places in a of a longest common subsequence of lines, by bit-parallel rows: len(a) * len(b) / 64 steps."""
    known = set(b)
    at = [i for i, x in enumerate(a) if x in known]
    here = [a[i] for i in at]
    mine = set(here)
    there = [x for x in b if x in mine]
    m = len(here)
    if not m:
        return set()
    where: dict[str, int] = {}
    for i, x in enumerate(here):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << m) - 1
    rows, v = [], full
    for x in there:
        u = v & where[x]
        v = (v + u | v - u) & full
        rows.append(v)
    out: set[int] = set()
    i, j = m, len(there)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        elif here[i - 1] == there[j - 1]:
            i, j = i - 1, j - 1
            out.add(at[i])
        else:
            j -= 1
    return out


def _shared_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):  # noqa: B905
        if x != y:
            break
        n += 1
    return n


def shared_lines(host: str, path: str, own: Sequence, before: tuple | None, after: tuple | None) -> list[int]:
    """Places of own that the nearer neighbour shares.  before, after: (host, path, lines) in order of host and path."""
    best, score = None, -1
    for other in (before, after):
        if other is not None and host and other[0] == host and (s := _shared_start(path, other[1])) > score:
            best, score = other, s
    return sorted(common_lines(own, best[2])) if best is not None else []


def kept_lines(zones: Sequence[int], sizes: Sequence[int], shared: Sequence[int]) -> list[int]:
    """Places of the main text's lines, from where lines stand, their lengths and which ones the nearest page shares."""
    gone = set(shared)
    outside = [i for i, z in enumerate(zones) if z == OUTSIDE and i not in gone]
    inside = [i for i, z in enumerate(zones) if z == INSIDE]
    if sum(sizes[i] for i in outside) > sum(sizes[i] for i in inside):
        return sorted(inside + outside)
    return inside


def _line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "little", signed=True)


_KEY = ["k_id", "k_url", "k_html"]
_KIND = "host string, path string, own array<long>, zones array<tinyint>, sizes array<int>"


def differences(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(k_id, k_url, k_html, kept): places of the main text's lines of every page where differencing changes them.

    Every page is sorted and paired, as hashes of its lines; equal rows are one.  What is kept without a neighbour
    isn't sent again.
    """
    spark = df.sparkSession
    id_kind = df.schema[id_col].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            got = [lines(h) for h in batch.column(4).to_pylist()]
            where = [split_url(u) for u in batch.column(3).to_pylist()]
            cols = [batch.column(c) for c in range(3)]
            cols += [pa.array([h for h, _ in where], pa.string()), pa.array([p for _, p in where], pa.string()), pa.array([[_line_hash(x) for x, _ in g] for g in got], pa.list_(pa.int64()))]
            cols += [pa.array([[z for _, z in g] for g in got], pa.list_(pa.int8())), pa.array([[len(x) for x, _ in g] for g in got], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*_KEY, "host", "path", "own", "zones", "sizes"])

    cut = df.select(F.col(id_col).alias("k_id"), F.xxhash64(url_col).alias("k_url"), F.xxhash64(html_col).alias("k_html"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = f"k_id {id_kind}, k_url long, k_html long, {_KIND}"
    pages = stored(cut.mapInArrow(parse, kind), "lines").where("size(own) > 0").dropDuplicates(_KEY)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one host's pages go to as many tasks as they fill: ranges are of host, path and id
    order = ["host", "path", *_KEY]
    ordered = stored(pages, "pages").repartitionByRange(n, *order).sortWithinPartitions(*order)
    near_kind = "struct<host:string,path:string,own:array<long>>"
    shape = f"{kind}, kept array<int>, done boolean, part int, place int, last boolean, before {near_kind}, after {near_kind}"
    out_schema = to_arrow_schema(_parse_datatype_string(shape))
    near = lambda r: {k: r[k] for k in ("host", "path", "own")}
    sides = lambda r: r and (r["host"], r["path"], r["own"])

    def changed(r: dict, before: dict | None, after: dict | None) -> list[int] | None:
        """What is kept, where the nearest page makes a difference."""
        shared = shared_lines(r["host"], r["path"], r["own"], sides(before), sides(after))
        kept = kept_lines(r["zones"], r["sizes"], shared)
        return kept if kept != kept_lines(r["zones"], r["sizes"], ()) else None

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with both neighbours in this task are done; the first and the last one go on to meet other tasks'."""
        part, rows, place = TaskContext.get().partitionId(), [], 0
        done: list[dict] = []

        def edge(r: dict, before: dict | None, after: dict | None) -> None:
            done.append(r | {"done": False, "part": part, "place": place, "before": before and near(before), "after": after and near(after), "last": after is None})

        for batch in batches:
            for r in batch.to_pylist():
                rows.append(r)
                if len(rows) == 3:
                    mid = rows[1]
                    kept = changed(mid, rows[0], rows[2])
                    if kept is not None:
                        done.append({k: mid[k] for k in _KEY} | {"kept": kept, "done": True})
                    del rows[0]
                elif len(rows) == 2:
                    edge(rows[0], None, rows[1])
                    place += 1
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=out_schema)
                done.clear()
        if rows:
            edge(rows[-1], rows[-2] if len(rows) > 1 else None, None)
            yield pa.RecordBatch.from_pylist(done, schema=out_schema)

    met = stored(ordered.mapInArrow(pair, shape), "pairs")
    # two rows a task at most: what is put in one place doesn't grow with the pages
    by_part = Window.orderBy("part", "place")
    me = F.struct("host", "path", "own")
    edges = met.where("not done").select("*", F.lag(me).over(by_part).alias("prev"), F.lead(me).over(by_part).alias("next"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for r in batch.to_pylist():
                before = r["before"] or (r["prev"] if r["place"] == 0 else None)
                after = r["after"] or (r["next"] if r["last"] else None)
                kept.append(changed(r, before, after))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(kept, pa.list_(pa.int32()))], names=[*_KEY, "kept"])

    rest = edges.mapInArrow(finish, f"k_id {id_kind}, k_url long, k_html long, kept array<int>")
    return stored(met.where("done").select(*_KEY, "kept").unionByName(rest).where("kept is not null"), "kept")


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    id_kind = df.schema[id_col].dataType.simpleString()
    kept = differences(df, id_col, url_col, html_col)
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.xxhash64(url_col).alias("h_url"), F.xxhash64(html_col).alias("h_html"))
    both = pages.join(kept, pages["id"].eqNullSafe(kept["k_id"]) & (pages["h_url"] == kept["k_url"]) & (pages["h_html"] == kept["k_html"]), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = []
            for page, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                got = lines(page)
                if places is None:
                    places = kept_lines([z for _, z in got], [len(x) for x, _ in got], ())
                texts.append("\n\n".join([got[i][0] for i in places]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    out = both.select("id", "url", "html", "kept").mapInArrow(write, f"id {id_kind}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
