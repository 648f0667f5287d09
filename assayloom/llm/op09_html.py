"""Main text of web pages by wrappers: union-free expressions that are inferred for each template of a host.

A page is cut into a stream of tags, text and raw elements, and the stream into blocks, each with the path of open elements. The
containers of a page are its blocks' paths without the elements of running text (p, li, headings) at their end; pages of a host
with the same set of containers are of one template, whatever the number and order of their paragraphs, lists and headings.

Class Wrapper aligns the streams of a template's pages one after the other. Tokens meet by the path of their element: an element
that a page lacks makes its group optional (?), one that comes again makes it repeated (+), and a text that differs from those
that all pages so far have at that place becomes a slot (#text). Two wrappers align in the same way, and as aligning is
associative and commutative, each task aligns its own pages and the wrappers of tasks are added up: all pages are read whole, the
result depends on no order, what moves grows with the templates and tasks, and no key gathers pages.

A page is then read by the wrapper of its template. Its fixed texts are left out, in optional groups too, unless the page has
nothing else; the texts in slots below the main prefix (the group whose slots hold the most text) are the page's text. Where that
prefix is no article or main element and holds under half of the page's slots, all slots are kept. A text is fixed if all pages
that have its group have it: LEAST different ones at least, for an optional group LEAST_OPTIONAL. Where fixed texts would be four fifths of
a template, its pages are near copies of one another, and nothing is fixed.

A wrapper cannot tell a varying sidebar from a varying article. So blocks of boilerplate elements (nav, aside, footer, ...) and
of elements whose id, class or role says so are never aligned. A name that only tells of another element (has-sidebar,
no-comments) does not count, nor does any on html, body and main; on an article only those of comments, adverts and teasers do.

Scripts, styles, noscript, template, textarea, title, iframe, svg and canvas are left out with what they hold; a self-closing svg is
empty, and one of them (but scripts and styles) that is never closed ends with its parent. The text of math and object is content.

Edge cases: a null or empty page gives an empty text; a page without markup is its own text; unclosed and crossing tags close
at the end of what holds them; a null URL belongs to the host ''; repeated rows are extracted each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import op07_urls
from .common import materialise, slices

#: A text is fixed only where so many different pages have it, in a group that all pages have or in an optional one.
LEAST, LEAST_OPTIONAL = 3, 8
#: Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Left out with all they hold: RAW ends at the first end tag of its name, DROPPED nests.
RAW = frozenset("script style noscript textarea title iframe".split())
DROPPED = frozenset("template svg canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements of running text, which do not tell templates apart.
CONTENT = frozenset("p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 hgroup pre blockquote figure figcaption hr address summary".split())
BOILERPLATE = frozenset("head nav header footer aside form menu button select dialog label fieldset".split())
_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|reply|replies|cookie|cookies|consent"
    r"|footer|header|masthead|menu|nav|navbar|navigation|newsletter|notice|pagination|popup|promo|promoted|related|share|sharing|sidebar|social"
    r"|sponsor|sponsored|subscribe|subscription|toolbar|widget|disqus|alert|modal)(?:$|[\s_-])", re.I,
)
#: Of a name, what tells of another element; of an article's names, those that count.
_OTHERS = re.compile(r"(?:^|(?<=\s))(?:has|have|with|without|no|not|is|show|hide|hides|hidden)[_-]\S*", re.I)
_ARTICLE_WORDS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|comment|comments|reply|replies|related|promo|promoted|sponsor|sponsored|teaser)(?:$|[\s_-])", re.I)
_MAIN = re.compile(r"(?:^|/)(?:article|main)(?:$|[/.])")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)

#: (kind, value, element, boilerplate): kind is "<" (opens), ">" (closes) or "t" (text).
Token = tuple[str, str, bool]


def telling(element: str, named: str) -> bool:
    """Whether the id, class and role of an element mark it as boilerplate."""
    if element in ("html", "body", "main") or not named:
        return False
    return bool((_ARTICLE_WORDS if element == "article" else _WORDS).search(_OTHERS.sub(" ", named)))


def skipped(page: str, at: int, name: str, above: list[str]) -> int:
    """Where a left-out element that begins before at ends: at its end tag, or before what ends its parent, or with the page."""
    inside = [name]
    while m := _TOKEN.search(page, at):
        tag = (m.group(2) or "").lower()
        at = m.end()
        if not tag:
            continue
        if m.group(1):
            if tag in inside:
                del inside[len(inside) - 1 - inside[::-1].index(tag) :]
                if not inside:
                    return at
            elif tag in above:
                return m.start()
        elif name in RAW:
            continue
        elif name == "svg" and tag in BLOCKS and "foreignobject" not in inside or name == "canvas" and len(inside) == 1 and above and tag in _ENDS.get(above[-1], ()):
            return m.start()
        elif tag in ("script", "style") and not m.group(3).endswith("/"):
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else at
        elif tag not in VOID and not m.group(3).endswith("/"):
            inside.append(tag)
    return len(page)


def tokens(page: str) -> Iterator[Token]:
    at = 0
    above: list[str] = []
    endless: set[str] = set()  # raw elements without a further end tag
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            yield "t", page[at : m.start()], False
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):
            if name in above:
                del above[len(above) - 1 - above[::-1].index(name) :]
            yield ">", name, False
            continue
        if name in RAW:
            close = None if name in endless else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if close:
                at = close.end()
            elif name in ("script", "style"):
                at = len(page)
            else:
                endless.add(name)
                at = skipped(page, at, name, above)
            continue
        if name in DROPPED:
            if name != "svg" or not m.group(3).endswith("/"):
                at = skipped(page, at, name, above)
            continue
        named = " ".join(a or b or c for a, b, c in _NAMED.findall(m.group(3))) if m.group(3) else ""
        yield "<", name if not named else f"{name}.{named.split()[0].lower()}" if named.split() else name, name in BOILERPLATE or telling(name, named)
        if m.group(3).endswith("/") or name in VOID:
            yield ">", name, False
        else:
            if above and name in _ENDS.get(above[-1], ()):
                above.pop()
            above.append(name)
    if at < len(page):
        yield "t", page[at:], False


#: Elements that end an open one of the same group.
_ENDS = {"p": frozenset(BLOCKS - {"body", "html", "head"}), "li": frozenset({"li"}), "dd": frozenset({"dd", "dt"}), "dt": frozenset({"dd", "dt"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}
_INLINE_KEEPS = frozenset("b i u em strong span a font small big sub sup code mark".split())


def blocks(page: str) -> Iterator[tuple[str, str, bool]]:
    """(path of open block elements, text, whether boilerplate) of each block, in page order."""
    stack: list[tuple[str, str, bool]] = []  # element, label, boilerplate
    held: list[str] = []

    def flush() -> tuple[str, str, bool] | None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            return "/".join(label for name, label, _ in stack if name in BLOCKS), text, any(b for _, _, b in stack)
        return None

    for kind, value, odd in tokens(page):
        if kind == "t":
            held.append(value)
            continue
        name = value.split(".")[0]
        if name == "br":
            held.append(" ")
            continue
        block = name in BLOCKS
        if (block or odd) and (out := flush()):
            yield out
        if kind == "<":
            if block:
                while stack and (stack[-1][0] in _INLINE_KEEPS or name in _ENDS.get(stack[-1][0], ())):
                    if stack[-1][0] in _INLINE_KEEPS and not any(name in _ENDS.get(e, ()) for e, _, _ in stack[-6:]):
                        break
                    stack.pop()
            stack.append((name, value, odd))
        else:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if stack[i][2] and not block and (out := flush()):
                        yield out
                    del stack[i:]
                    break
                if not block and stack[i][0] in BLOCKS:  # an inline end does not close a block
                    break
    if out := flush():
        yield out


def heaviest(weight: dict[str, int]) -> str | None:
    """The heaviest prefix named article or main; else the deepest that holds three fifths of the text. weight: length by path."""
    below: Counter[str] = Counter()
    for path, n in weight.items():
        parts = path.split("/")
        for k in range(1, len(parts) + 1):
            below["/".join(parts[:k])] += n
    marked = [p for p in below if _MAIN.search(p.rsplit("/", 1)[-1])]
    if marked:
        return min(marked, key=lambda p: (-below[p], len(p), p))
    total = sum(weight.values())
    heavy = [p for p in below if below[p] >= 0.6 * total and not p.rsplit("/", 1)[-1].split(".")[0] in ("p", "li", "pre", "blockquote", "td")]
    return max(heavy, key=lambda p: p.count("/")) if heavy else None


def within(path: str, prefix: str | None) -> bool:
    return not prefix or path == prefix or path.startswith(prefix + "/")


def select(paths: list[str], texts: list[str], prefix: str | None, fixed: set[int] | None = None) -> str:
    """The texts in slots below the prefix, or in all slots where it is not the main one of these. A page of fixed texts keeps them."""
    if fixed and (slots := [(p, t) for p, t in zip(paths, texts, strict=True) if number(p, t) not in fixed]):
        paths, texts = [p for p, _ in slots], [t for _, t in slots]
    held = sum(len(t) for p, t in zip(paths, texts, strict=True) if within(p, prefix))
    if not held or not (prefix and _MAIN.search(prefix)) and 2 * held < sum(map(len, texts)):
        prefix = None
    return "\n".join(t for p, t in zip(paths, texts, strict=True) if within(p, prefix))


def main_text(page: str, prefix: str | None) -> str:
    """The main text of one page by a prefix, or by the page's own where it lacks that."""
    found = [(path, text) for path, text, odd in blocks(page) if not odd]
    if prefix is None or not any(within(path, prefix) for path, _ in found):
        weight: Counter[str] = Counter()
        for path, text in found:
            weight[path] += len(text)
        prefix = heaviest(weight)
    return select([p for p, _ in found], [t for _, t in found], prefix)


def container(path: str) -> str:
    parts = path.split("/")
    while parts and parts[-1].split(".")[0] in CONTENT:
        parts.pop()
    return "/".join(parts)


def number(*parts: str) -> int:
    """64 bits of a hash, the same in every process."""
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def parse(pages: DataFrame, kind: str) -> DataFrame:
    """page_id, url, host, template, page (a hash), and the paths and texts of the blocks, less boilerplate."""
    out = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            templates, hashes, paths, texts = [], [], [], []
            for page in batch.column(3).to_pylist():
                found = [(path, text) for path, text, odd in blocks(page or "") if not odd]
                templates.append(number(*sorted({container(path) for path, _ in found})) if found else None)
                hashes.append(number(page or ""))
                paths.append([path for path, _ in found])
                texts.append([text for _, text in found])
            arrays = [batch.column(0), batch.column(1), batch.column(2), pa.array(templates, pa.int64()), pa.array(hashes, pa.int64()), pa.array(paths, out), pa.array(texts, out)]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "host", "template", "page", "paths", "texts"])

    return pages.mapInArrow(run, f"page_id {kind}, url string, host string, template long, page long, paths array<string>, texts array<string>")


class Wrapper:
    """The union-free expression of one template, as far as its pages are aligned.

    groups: by path of elements, [pages that have it, most times on a page]. places: by path of a text, hashes of some pages that
    have it, and the texts that all of them have, {hash: characters on all pages}. weight: characters by container.
    """

    def __init__(self) -> None:
        self.groups: dict[str, list[int]] = {"": [0, 1]}
        self.places: dict[str, tuple[set[int], dict[int, int]]] = {}
        self.weight: Counter[str] = Counter()

    def align(self, page: int, paths: list[str], texts: list[str]) -> None:
        """page: its hash."""
        times: Counter[str] = Counter({"": 1})
        held: dict[str, dict[int, int]] = {}
        before = ""
        for path, text in zip(paths, texts, strict=True):
            parts = path.split("/")
            for k in range(1, len(parts) + 1):
                group = "/".join(parts[:k])
                # A block of the same path as the one before repeats the innermost group; the groups around both go on.
                times[group] += path == before and k == len(parts) or not within(before, group)
            own = held.setdefault(path, {})
            key = number(path, text)
            own[key] = own.get(key, 0) + len(text)
            self.weight[container(path)] += len(text)
            before = path
        for group, n in times.items():
            known = self.groups.setdefault(group, [0, 0])
            known[0], known[1] = known[0] + 1, max(known[1], n)
        for path, own in held.items():
            if path not in self.places:
                self.places[path] = ({page}, own)
                continue
            seen, common = self.places[path]
            if len(seen) < LEAST_OPTIONAL:
                seen.add(page)
            self.places[path] = (seen, {k: n + own[k] for k, n in common.items() if k in own})

    def rows(self) -> Iterator[tuple[str, str, int | None, int, int, int]]:
        """kind, path, key, pages, most, chars: what adds up with the rows of other wrappers of the template."""
        for group, (pages, most) in self.groups.items():
            yield "group", group, None, pages, most, 0
        for path, (seen, common) in self.places.items():
            yield from (("page", path, h, 0, 0, 0) for h in seen)
            yield from (("text", path, key, self.groups[path][0], 0, n) for key, n in common.items())
        yield from (("box", box, None, 0, 0, n) for box, n in self.weight.items())


class Expression:
    """What the added rows of a template's wrappers say. parts: dicts of kind, path, key, pages, most, chars."""

    def __init__(self, parts: list[dict]) -> None:
        of = lambda kind: [x for x in parts if x["kind"] == kind]
        self.groups = {x["path"]: (x["pages"], x["most"]) for x in of("group")}
        all_pages = self.groups[""][0]
        different = {x["path"]: x["pages"] for x in of("different")}
        weight = Counter({x["path"]: x["chars"] for x in of("box")})
        fixed = [
            x for x in of("text")
            if x["pages"] == self.groups[x["path"]][0] and different[x["path"]] >= (LEAST if x["pages"] == all_pages else LEAST_OPTIONAL)
        ]
        if 5 * sum(x["chars"] for x in fixed) >= 4 * sum(weight.values()):  # near copies
            fixed = []
        self.fixed = {x["key"]: x["path"] for x in fixed}
        slots = Counter(weight)
        for x in fixed:
            slots[container(x["path"])] -= x["chars"]
        self.prefix = heaviest(slots)
        self.texts = set(different)

    def __str__(self) -> str:
        """The expression: element(inside), ? optional, + repeated, #text a slot, "" a fixed text."""
        inside: dict[str, list[str]] = {}
        for path in sorted(self.groups):
            if path:
                inside.setdefault(path.rpartition("/")[0], []).append(path)
        held = Counter(self.fixed.values())

        def show(path: str) -> str:
            pages, most = self.groups[path]
            above = self.groups[path.rpartition("/")[0]][0]
            within_it = '""' * held[path] + "#text" * (path in self.texts) + "".join(map(show, inside.get(path, ())))
            return f"{path.rpartition('/')[2]}({within_it})" + "+" * (most > 1) + "?" * (pages < above)

        return "".join(map(show, inside.get("", ())))


_COUNTED = pa.schema([
    ("host", pa.string()), ("template", pa.int64()), ("kind", pa.string()), ("path", pa.string()), ("key", pa.int64()), ("pages", pa.int64()), ("most", pa.int64()),
    ("chars", pa.int64()),
])


def infer_wrappers(parsed: DataFrame) -> DataFrame:
    """host, template, prefix, fixed (hashes of path and text), expression for each template, from all of its pages."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers: dict[tuple[str, int], Wrapper] = {}
        for batch in slices(batches):
            for host, template, page, paths, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wrappers.setdefault((host, template), Wrapper()).align(page, paths, texts)
        rows: list[tuple] = []
        for key, wrapper in wrappers.items():
            rows += [(*key, *r) for r in wrapper.rows()]
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _COUNTED, strict=True)], schema=_COUNTED)
                rows.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _COUNTED, strict=True)], schema=_COUNTED)

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Expression(parts) for parts in batch.column(2).to_pylist()]
            arrays = [pa.array([e.prefix for e in found], pa.string()), pa.array([list(e.fixed) for e in found], pa.list_(pa.int64())), pa.array([str(e) for e in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["host", "template", "prefix", "fixed", "expression"])

    seen = parsed.where("template IS NOT NULL").select("host", "template", "page", "paths", "texts")
    counted = seen.mapInArrow(align, "host string, template long, kind string, path string, key long, pages long, most long, chars long")
    of = ["host", "template", "kind", "path", "key"]
    counted = materialise(counted.groupBy(of).agg(F.sum("pages").alias("pages"), F.max("most").alias("most"), F.sum("chars").alias("chars")), "counts")
    different = counted.where("kind = 'page'").groupBy("host", "template", "path").agg(F.count("*").alias("pages"))
    # A text of fewer pages is not fixed anywhere.
    parts = counted.where(f"kind IN ('group', 'box') OR kind = 'text' AND pages >= {LEAST}").unionByName(
        different.select("host", "template", F.lit("different").alias("kind"), "path", F.lit(None).cast("long").alias("key"), "pages", F.lit(0).cast("long").alias("most"), F.lit(0).cast("long").alias("chars"))
    )
    part = F.struct("kind", "path", "key", "pages", "most", "chars").alias("x")
    gathered = parts.select("host", "template", part).groupBy("host", "template").agg(F.collect_list("x").alias("parts"))
    return gathered.mapInArrow(infer, "host string, template long, prefix string, fixed array<long>, expression string")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    kind = pages.schema["page_id"].dataType.simpleString()
    parsed = materialise(parse(pages.select("page_id", "url", op07_urls.host(F.col("url")).alias("host"), "html"), kind), "parsed")
    wrappers = materialise(infer_wrappers(parsed), "wrappers").drop("expression")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [select(*x[:3], set(x[3] or ())) for x in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    read = parsed.join(wrappers, ["host", "template"], "left").select("page_id", "url", "paths", "texts", "prefix", "fixed")
    return read.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
