"""HTML main text by equivalence-class template deduction.

A page is read as tokens: the paths of its block elements, and its texts at their paths. Over the pages of a host, each
token has an occurrence vector (how often each page holds it). Tokens with equal vectors form a class; the vectors are
never built: the sum of a hash of (page, count) over the pages is equal for equal vectors, and it is combined in the
tasks that read the pages. Classes held by most pages whose paths nest make the host's template. Template texts are
boilerplate, the places between template elements are slots, and of these the article's slot is taken from every page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revgauge.llm.base import stored

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|</?[a-zA-Z][^<>]*>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*\Z", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
# fixed values of the HTML standard: elements whose content is no text, elements without content, and block elements
SILENT = frozenset("script style noscript template iframe object svg canvas math select textarea button title option audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre search section summary table caption thead tbody tfoot tr td th "
    "ul".split())
#: An element that starts one of these ends an open paragraph; the others end an open one of their own kind.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: Elements that hold no part of an article, and words that name such containers in class, id or role.
ASIDE = frozenset("head nav aside footer form menu dialog search fieldset".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner banners breadcrumb breadcrumbs comment comments disqus "
    "respond consent cookie cookies gdpr notice notices footer header masthead topbar menu menus nav navbar navigation "
    "newsletter pager pagination popup modal overlay promo promoted promotion related recommended recommendations share sharing "
    "sidebar social sponsor sponsored subscribe subscription skip toolbar widget widgets complementary contentinfo".split())
MAIN_WORDS = frozenset("article articlebody main".split())
#: Share of a host's distinct pages that hold a template token, and the fewest pages from which one is deduced.
MOST, FEWEST = 0.5, 4


def host(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def _named(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """The element as a path step, whether it stands beside the article, whether it holds one."""
    words: set[str] = set()
    label = tag
    for m in ATTRIBUTE.finditer(attrs):
        kind, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "").lower()
        own = set(re.split(r"[^a-z0-9]+", value))
        if kind in ("class", "id", "role", "itemprop"):
            words |= own
        if kind == "class" and value.split():
            label += "." + ".".join(sorted(value.split()))
        if kind in ("role", "itemprop"):
            label += f"[{value}]"
    main = tag in ("article", "main") or "articlebody" in words or ("role" in attrs and bool(words & MAIN_WORDS))
    beside = tag in ASIDE or not main and tag not in ("html", "body") and bool(words & ASIDE_WORDS)
    return label, beside or "hidden" in attrs.lower().split(), main


def blocks(page: str) -> tuple[list[tuple[str, str, bool, str]], Counter]:
    """A page's texts in order, (path, text, aside, main path), and how often each block path starts."""
    out: list[tuple[str, str, bool, str]] = []
    paths: Counter = Counter()
    stack: list[tuple[str, str, bool, str]] = []   # tag, path, aside, path of the outermost element that holds an article
    piece: list[str] = []

    def flush() -> None:
        text = " ".join("".join(piece).split())
        piece.clear()
        if text:
            _, path, aside, main = stack[-1] if stack else ("", "", False, "")
            out.append((path, text, aside, main))

    def leave(tags: tuple[str, ...], stop: frozenset[str] | set[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                flush()
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    at = 0
    while (m := TOKEN.search(page, at)) is not None:
        if m.start() > at:
            piece.append(entities.unescape(page[at:m.start()]))
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in SILENT and not m["close"]:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>|\Z", re.I).search(page, at)
            at = end.end()
            piece.append(" ")
            continue
        if tag == "br" or tag == "hr":
            flush()
            continue
        if tag not in BLOCK:
            continue
        if m["close"]:
            leave((tag,), frozenset() if tag not in ("p", "li") else {"article", "section", "body", "table"})
            continue
        flush()
        if tag in SIBLINGS:
            leave(SIBLINGS[tag], {"ul", "ol", "dl", "table", "menu", "dir"})
        if tag not in ("html", "head"):
            leave(("p",), {"div", "article", "section", "body", "table", "td", "li"})
        if tag == "body":
            leave(("head",), set())
        label, aside, main = _named(tag, m["attrs"] or "")
        above = stack[-1] if stack else ("", "", False, "")
        if tag == "header" or "header" in label.split(".")[1:]:
            aside = not above[3]   # an article's own header belongs to it
        path = f"{above[1]}/{label}"
        paths[path] += 1
        stack.append((tag, path, above[2] or aside, above[3] or (path if main else "")))
    if at < len(page) and page[at:at + 1] != "<":
        piece.append(entities.unescape(page[at:]))
    flush()
    return out, paths


def _text_token(path: str, text: str, main: str) -> str:
    from xxhash import xxh3_128_hexdigest

    return f"{path}\0{'~' if main else '='}{xxh3_128_hexdigest(text.encode())}"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, token, path, chars, times): a page's path tokens (chars null) and text tokens."""
    from xxhash import xxh64_intdigest

    for batch in batches:
        rows = []
        for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found, paths = blocks(page or "")
            key = xxh64_intdigest((page or "").encode()) - (1 << 63)
            rows += [(name, key, p, p, False, n, 0) for p, n in paths.items()]
            chars: Counter = Counter()
            for path, text, aside, main in found:
                if not aside:
                    chars[main or path.rpartition("/")[0] or path] += len(text)
            rows += [(name, key, f"{p}\0slot", p, True, 1, n) for p, n in chars.items()]
            texts = Counter((path, text, main) for path, text, _, main in found)
            rows += [(name, key, _text_token(path, text, main), path, False, n, 0) for (path, text, main), n in texts.items()]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
        cols = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                              ["host", "page", "token", "path", "is_slot", "times", "chars"])


def templates(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """One row per host with a template: (host, paths, boilerplate, main).

    ``paths`` are the template's elements, ``boilerplate`` its texts (path, zero byte, ``=`` or ``~``, digest), ``main`` the
    element whose slots hold most text outside of menus and the like, one that says that it is an article first.
    A page that occurs several times counts once. Texts inside a declared article (``~``) are
    boilerplate if they occur as a template element does, so that an article that half the pages repeat is none.
    """
    rows = pages.select(host(F.col(url)).alias("host"), F.col(html).alias("html")).where("html is not null").mapInArrow(
        _tokens, "host string, page long, token string, path string, is_slot boolean, times long, chars long")
    rows = stored(rows.groupBy("host", "page", "token", "path", "is_slot").agg(F.max("times").alias("times"), F.max("chars").alias("chars")), "tokens")
    n_pages = rows.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("n_pages"))
    # addition wraps round: equal vectors have equal sums, whatever the order of their pages
    vector = F.sum(F.xxhash64("page", "times").cast("decimal(38,0)")).alias("vector")
    seen = rows.groupBy("host", "token", "path", "is_slot").agg(vector, F.count("*").alias("support"), F.sum("chars").alias("chars"))
    seen = stored(seen.join(n_pages, "host").where((F.col("n_pages") >= FEWEST) & (F.col("support") >= MOST * F.col("n_pages"))), "classes")
    # a class is a set of tokens with one vector; it is valid if every token's parent element is in the template as well
    elements = seen.where("not is_slot and instr(token, '\\0') = 0").select("host", "path", "vector")
    classes = seen.where("not is_slot").groupBy("host", "vector").agg(F.count("*").alias("size"))
    parent = F.regexp_replace("path", "/[^/]*$", "")
    nested = elements.withColumn("parent", parent).join(
        elements.select("host", F.col("path").alias("parent"), F.lit(True).alias("held")), ["host", "parent"], "left")
    paths = nested.where("held or parent = ''").groupBy("host").agg(F.collect_list("path").alias("paths"))
    texts = seen.where("instr(token, '\\0=') > 0").join(classes.where("size >= 2"), ["host", "vector"], "left_semi").join(
        elements.select("host", "path"), ["host", "path"], "left_semi")
    inside = seen.where("instr(token, '\\0~') > 0").join(elements.select("host", "vector"), ["host", "vector"], "left_semi")
    texts = texts.select("host", "token").unionByName(inside.select("host", "token"))
    texts = texts.groupBy("host").agg(F.collect_list("token").alias("boilerplate"))
    said = F.col("path").rlike(r"/(article|main)[^/]*$|articlebody[^/]*$")
    order = Window.partitionBy("host").orderBy(F.desc(said), F.desc("chars"), "path")
    main = seen.where("is_slot").withColumn("n", F.row_number().over(order)).where("n = 1").select("host", F.col("path").alias("main"))
    return paths.join(texts, "host", "left").join(main, "host", "left")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple] = {}
    for batch in batches:
        texts = []
        cols = [batch.column(i).to_pylist() for i in (2, 3)]
        extra = batch.column(4)
        for i, (page, name) in enumerate(zip(*cols, strict=True)):
            if name not in known:
                t = extra[i].as_py() or {}
                known[name] = (t.get("main"), frozenset(t.get("boilerplate") or ()))
            main, boilerplate = known[name]
            found = [b for b in blocks(page or "")[0] if not b[2]]
            declared = any(b[3] for b in found)
            found = [b for b in found if not boilerplate or _text_token(b[0], b[1], b[3]) not in boilerplate]
            kept = [b for b in found if b[3]]
            if not declared:
                kept = [b for b in found if main and (b[0] == main or b[0].startswith(f"{main}/"))]
                if not kept and found:
                    mass: Counter = Counter()
                    for path, text, _, _ in found:
                        mass[path.rpartition("/")[0] or path] += len(text)
                    best = max(sorted(mass), key=mass.__getitem__)
                    kept = [b for b in found if b[0] == best or b[0].startswith(f"{best}/")]
            texts.append("\n".join(b[1] for b in kept))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """(page_id, url, text) per page: the article's blocks in page order, one per line.

    Blank space inside a block is one blank, character references are decoded, and menus, headers, footers, sidebars,
    notices, adverts, forms, scripts, styles, comments and the host's boilerplate are left out. A page is read by its
    host's template; where the host has too few pages for one, or the page lacks the template's article, by the
    page's own element with most text. Null or empty html gives an empty text; a null url is a host of its own; repeated
    rows are kept; an empty table gives no rows; other columns are ignored. Unclosed and cut-off markup is read as far as
    it goes.
    """
    found = stored(templates(pages, html, url), "templates")
    kind = dict(pages.dtypes)[page_id]
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host(F.col(url)).alias("host"))
    joined = rows.join(found.select("host", F.struct("main", "boilerplate").alias("template")), "host", "left")
    return joined.select("page_id", "url", "html", "host", "template").mapInArrow(_extract, f"page_id {kind}, url string, text string")
