"""Texts of Markdown in which references count, and the references that they make.

A span is a run of text without markup: emphasis, links and images leave their texts, code (fenced, indented, between
backticks, or in an HTML ``code`` element), HTML and destinations leave nothing. Paragraphs, headings, code spans and hard
line breaks end a span; other line breaks are spaces. Null and empty texts have no spans; texts of any length are read
whole, in time that grows with their length but for contrived nests. Reference links need their definition before them; setext underlines, and
markers of lists and quotes, are no text."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: So many texts are held as Python objects at once.
SLICE = 256
_QUOTE, _BLANK, _FENCE = re.compile(r" {0,3}> ?"), re.compile(r"[ \t]*$"), re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_ITEM = re.compile(r"( {0,3}(?:[-+*]|\d{1,9}[.)]))(?: {1,4}(?! )| (?= )|(?=$))")
_TABS = re.compile(r"^[ >]*\t[ \t]*|^ {0,3}(?:[-+*]|\d{1,9}[.)])\t+")  # white space that counts as indent
_BREAK, _ATX, _SETEXT = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$"), re.compile(r" {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$"), re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\S+(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")
_ATTRIBUTE = r"(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)"
_OPEN, _CLOSE = rf"<[A-Za-z][A-Za-z0-9-]*{_ATTRIBUTE}*\s*/?>", r"</[A-Za-z][A-Za-z0-9-]*\s*>"
_TAG = re.compile(rf"(?P<open>{_OPEN})|(?P<close>{_CLOSE})|<![A-Za-z][^>]*>")
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9.-]+)>")
_ENTITY, _TARGET = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#\d{1,7}|[A-Za-z][A-Za-z0-9]*);"), re.compile(r"\(\s*(?:<[^<>\n]*>|(?:[^\s()<\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)")
_LABEL, _PLAIN, _CODE = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]"), re.compile(r"[^\\`<&*_\[\]!\n]+"), re.compile(r"<code(?:$|[ >])", re.I)
_PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_ENDED = (("<!--", "-->"), ("<?", "?>"), ("<![CDATA[", "]]>"))
#: Elements whose tags begin a block of HTML; a fixed list of the format.
_BLOCKS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param section source summary table tbody td tfoot th thead title tr track ul"
)
_HTML = re.compile(rf" {{0,3}}</?(?:{_BLOCKS.replace(' ', '|')})(?:\s|/?>|$)", re.I)
_RAW, _ALONE = re.compile(r" {0,3}<(script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(rf" {{0,3}}(?:{_OPEN}|{_CLOSE})[ \t]*$")


def _html_end(line: str, inside: bool) -> str | None:
    """What ends the block of HTML that a line begins: a text, or "" for a blank line; None if it begins none."""
    own = line.lstrip(" ")
    if len(line) - len(own) > 3 or not own.startswith("<"):
        return None
    for start, end in _ENDED:
        if own.startswith(start):
            return end
    raw = _RAW.match(line)
    if raw:
        return f"</{raw[1].lower()}>"
    return "" if _HTML.match(line) or (not inside and _ALONE.match(line)) else None


def _blocks(text: str, labels: set[str]) -> Iterator[str]:
    """Inline contents of paragraphs and headings, in order; definitions go to ``labels``."""
    stack: list[int] = []  # open containers: 0 a quote, else the width of an item's indent
    lines: list[str] = []  # of the open paragraph
    fence, ending, below = "", None, False  # an open fence; the end of open HTML; in indented code

    def paragraph() -> Iterator[str]:
        while lines and (found := _DEFINITION.match(lines[0])):
            labels.add(" ".join(found[1].split()).casefold())
            lines.pop(0)
        if lines:
            yield "\n".join(lines)
            lines.clear()

    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = _TABS.sub(lambda m: m[0].expandtabs(4), line)
        met = 0
        for width in stack:
            if width == 0:
                found = _QUOTE.match(line)
                if not found:
                    break
                line = line[found.end() :]
            elif _BLANK.match(line):
                line = ""
            elif line[:width].strip(" "):
                break
            else:
                line = line[width:]
            met += 1
        whole = met == len(stack)
        if not whole and (fence or ending is not None):
            fence, ending = "", None
        if fence:
            if re.match(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$", line):
                fence = ""
            continue
        if ending is not None:
            if (ending and ending in line.lower()) or (not ending and _BLANK.match(line)):
                ending = None
            continue
        opened = False
        while True:
            if line.startswith("    ") and not _BLANK.match(line):
                below = opened or not lines
                break
            quote, item = _QUOTE.match(line), None if _BREAK.match(line) else _ITEM.match(line)
            if item and lines and not opened and whole and (item.end() == len(line) or not re.match(r" {0,3}(?:[-+*]|1[.)])", line)):
                item = None  # an empty item, or a number other than 1, doesn't interrupt a paragraph
            if not quote and not item:
                break
            yield from paragraph()
            if not opened:
                del stack[met:]
            opened, whole, found = True, True, quote or item
            stack.append(0 if quote else found.end() if found.end() < len(line) else len(item[1]) + 1)
            line = line[found.end() :]
        if below:
            below = False
            yield from paragraph()
            if not opened:
                del stack[met:]
            continue
        blank, atx, rule, started = bool(_BLANK.match(line)), _ATX.match(line), bool(_BREAK.match(line)), _FENCE.match(line)
        if lines and whole and not opened and _SETEXT.match(line) and not blank:
            yield from paragraph()
            continue
        html_end = _html_end(line, bool(lines) and not opened)
        if lines and not whole and not (blank or atx or rule or started or html_end is not None):
            lines.append(line.strip(" \t"))  # a lazy continuation
            continue
        if not whole:
            yield from paragraph()
            del stack[met:]
        if blank or atx or rule or started or html_end is not None:
            yield from paragraph()
            if atx:
                yield atx[1] or ""
            elif started and not rule:
                fence = started[1]
            elif html_end is not None and not (html_end and html_end in line.lower()) and not blank:
                ending = html_end
            continue
        lines.append(line.lstrip(" \t"))
    yield from paragraph()


class _Inline:
    """Pieces of one block: texts, None where a span ends, and delimiters as lists [character, left, opens, closes]."""

    def __init__(self, text: str, labels: set[str], depth: int):
        self.text, self.labels, self.depth = text.rstrip(" \t"), labels, depth
        self.pieces: list = []
        self.brackets: list[list] = []  # [piece, place after the bracket, image, may become a link]
        self.active = 0  # those before this one can't become links
        self.dead: set[str] = set()  # beginnings of unfinished comments and such

    def add(self, piece) -> None:
        if not self.depth:
            self.pieces.append(piece)

    def run(self) -> list:
        t, i, ticks = self.text, 0, {}
        for m in re.finditer(r"`+", t):
            ticks.setdefault(len(m[0]), []).append(m.start())
        while i < len(t):
            c = t[i]
            if m := _PLAIN.match(t, i):
                self.add(m[0])
                i = m.end()
            elif c == "\\":
                following = t[i + 1 : i + 2]
                self.add(None if following == "\n" else following if following in _PUNCTUATION and following else "\\")
                i += 2 if following == "\n" or (following and following in _PUNCTUATION) else 1
            elif c == "`":
                n = self._run(i, "`")
                j = bisect_right(ticks.get(n, []), i)
                if j < len(ticks.get(n, [])):
                    self.add(None)
                    i = ticks[n][j] + n
                else:
                    self.add("`" * n)
                    i += n
            elif c == "<":
                i = self._angle(i)
            elif c == "&" and (m := _ENTITY.match(t, i)):
                self.add(html.unescape(m[0]))
                i = m.end()
            elif c in "*_":
                n = self._run(i, c)
                before, after = t[i - 1] if i else " ", t[i + n] if i + n < len(t) else " "
                spaced = lambda x: x.isspace()
                odd = lambda x: x in _PUNCTUATION
                left = not spaced(after) and (not odd(after) or spaced(before) or odd(before))
                right = not spaced(before) and (not odd(before) or spaced(after) or odd(after))
                opens, closes = (left, right) if c == "*" else (left and (not right or odd(before)), right and (not left or odd(after)))
                self.add([c, n, opens, closes, n])
                i += n
            elif c == "[" or t.startswith("![", i):
                size = 1 if c == "[" else 2
                self.add(t[i : i + size])
                if not self.depth:
                    self.brackets.append([len(self.pieces) - 1, i + size, size == 2, True])
                i += size
            elif c == "]":
                i = self._bracket(i)
            elif c == "\n":
                k = i
                while k and t[k - 1] == " ":
                    k -= 1
                if k < i and self.pieces and isinstance(self.pieces[-1], str) and not self.depth:
                    self.pieces[-1] = self.pieces[-1].rstrip(" ")
                self.add(None if i - k > 1 else " ")
                i += 1
                while i < len(t) and t[i] == " ":
                    i += 1
            else:
                self.add(c)
                i += 1
        self._emphasis(0)
        return self.pieces

    def _run(self, i: int, c: str) -> int:
        j = i
        while j < len(self.text) and self.text[j] == c:
            j += 1
        return j - i

    def _angle(self, i: int) -> int:
        t = self.text
        if m := _AUTO.match(t, i):
            self.add(m[1])
            return m.end()
        for start, end in _ENDED:
            if t.startswith(start, i) and start not in self.dead:
                j = t.find(end, i + len(start))
                if j >= 0:
                    return j + len(end)
                self.dead.add(start)
        if m := _TAG.match(t, i):
            if self.depth:
                self.depth += 1 if m["open"] else -1 if m["close"] else 0
            elif _CODE.match(m[0]):
                self.depth = 1
            return m.end()
        self.add("<")
        return i + 1

    def _bracket(self, i: int) -> int:
        t = self.text
        if self.depth or not self.brackets:
            self.add("]")
            return i + 1
        at, start, image, able = self.brackets.pop()
        self.active, end = min(self.active, len(self.brackets)), None
        if able:
            if m := _TARGET.match(t, i + 1):
                end = m.end()
            else:
                m = _LABEL.match(t, i + 1)
                label = m[1] if m and m[1].strip() else t[start:i] if self.labels else ""
                if label and " ".join(label.split()).casefold() in self.labels:
                    end = m.end() if m else i + 1
        if end is None:
            self.add("]")
            return i + 1
        self.pieces[at] = ""
        self._emphasis(at)
        if not image:  # a link holds no other link
            for b in self.brackets[self.active :]:
                b[3] = b[2]
            self.active = len(self.brackets)
        return end

    def _emphasis(self, start: int) -> None:
        """Takes away the delimiters that pair from the piece ``start`` on; the others become text."""
        openers: dict[str, list] = {"*": [], "_": []}
        order, bottom = 0, {}  # below the bottom, a kind of closing delimiter has no opener
        for k in range(start, len(self.pieces)):
            d = self.pieces[k]
            if not isinstance(d, list):
                continue
            c, _, opens, closes, size = d
            own, order = openers[c], order + 1
            kind = (c, opens, size % 3)
            while closes and d[1] and own:
                j, least = len(own) - 1, bottom.get(kind, 0)
                while j >= 0 and own[j][1] > least and (own[j][0][3] or opens) and (own[j][0][4] + size) % 3 == 0 and not (own[j][0][4] % 3 == 0 and size % 3 == 0):
                    j -= 1
                if j < 0 or own[j][1] <= least:
                    bottom[kind] = order - 1
                    break
                other, since = own[j]
                used = 2 if min(other[1], d[1]) >= 2 else 1
                other[1] -= used
                d[1] -= used
                del own[j + 1 :]
                rest = openers["_" if c == "*" else "*"]
                while rest and rest[-1][1] > since:
                    rest.pop()
                if not other[1]:
                    own.pop()
            if opens and d[1]:
                own.append((d, order))
        texts = [x[0] * x[1] if isinstance(x, list) else x for x in self.pieces[start:]]
        self.pieces[start:] = [y for is_text, run in groupby(texts, lambda x: x is not None) for y in (["".join(run)] if is_text else run)]


def spans(text: str | None) -> list[str]:
    found, labels, depth = [], set(), 0
    for block in _blocks(text or "", labels):
        inline, own = _Inline(block, labels, depth), []
        for piece in [*inline.run(), None]:
            if piece is not None:
                own.append(piece)
            elif any(own):
                found.append("".join(own))
                own = []
        depth = inline.depth
    return found


def with_spans(rows: DataFrame, text: str, name: str = "spans") -> DataFrame:
    """``rows`` with the array of a text's spans. Texts become Python objects SLICE at a time, whatever an Arrow batch
    has."""
    at = rows.columns.index(text)
    out = StructType([*rows.schema.fields, StructField(name, ArrayType(StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                own = batch.slice(k, SLICE)
                found = pa.array(map(spans, own.column(at).to_pylist()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*own.columns, found], names=out.names)

    return rows.mapInArrow(run, out)


_OWNER, _NAME = "[A-Za-z0-9-]+", "[A-Za-z0-9-._]+"  # fixed values: what owners and repositories are called


def _patterns(host: str) -> dict[str, tuple[str, str]]:
    """Pattern and what its matches are: each has one group, and stands between characters that are no words."""
    site = f"https?://{re.escape(host)}/{_OWNER}"
    return {
        "number": (r"(?:\W|^)(#\d+)(?=\W|$)", "BASIC"),
        "numberOf": (rf"(?:\W|^)({_OWNER}/{_NAME}#\d+)(?=\W|$)", "BASIC"),
        "link": (rf"(?:\W|^)({site}(?:/{_NAME}/(?:issues|pull)/\d+(?:#(?:issue|issuecomment|pullrequestreview|discussion_r)-?\d+)?)?)(?=[^\w/-]|$)", "BASIC"),
        "paired": (rf"(?:\W|^)[Pp]aired[- ][wW]ith:? (@{_OWNER})(?=\W|$)", "PAIRED_WITH"),
        "person": (rf"(?:\W|^)(@{_OWNER})(?=\W|$)", "BASIC"),
        "commit": (r"(?:\W|^)([a-fA-F0-9]{40,})(?=\W|$)", "BASIC"),
        "commitLink": (rf"(?:\W|^)({site}/{_NAME}/commit/[a-fA-F0-9]{{40,}})(?=[^\w/]|$)", "BASIC"),
    }


def references(rows: DataFrame, key: str, text: str, host: str = "github.com") -> DataFrame:
    """(key, ref, ref_type, n): what the Markdown ``text`` refers to, and how often. A person that is paired with, and a
    hash inside a commit's link, are no references of their own besides. Hashes and commits' links are lower case."""
    each = with_spans(rows.select(key, text), text, "_spans").select(key, F.explode("_spans").alias("_s"))
    all_of = lambda x, pattern: F.transform(F.regexp_extract_all(F.col("_s"), F.lit(pattern), F.lit(1)), x)
    row = lambda ref, kind, n: F.struct(ref.alias("ref"), F.lit(kind).alias("ref_type"), F.lit(n).alias("n"))
    arrays = []
    for name, (pattern, kind) in _patterns(host).items():
        lower = name.startswith("commit")
        arrays.append(all_of(lambda x: row(F.lower(x) if lower else x, kind, 1), pattern))  # noqa: B023
        if name == "paired":
            arrays.append(all_of(lambda x: row(x, "BASIC", -1), pattern))
        if name == "commitLink":
            arrays.append(all_of(lambda x: row(F.lower(F.regexp_extract(x, "[a-fA-F0-9]{40,}$", 0)), "BASIC", -1), pattern))
    found = each.select(key, F.inline(F.concat(*arrays)))
    return found.groupBy(key, "ref", "ref_type").agg(F.sum("n").alias("n")).where("n > 0")


def dictionary(entries: list[DataFrame]) -> DataFrame:
    """(ref, address) of tables (ref, address), where the last table that has a reference decides (within a table, the
    greatest address)."""
    rows = None
    for i, e in enumerate(entries):
        own = e.select("ref", "address", F.lit(i).alias("_o"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("ref").agg(F.max(F.struct("_o", "address")).alias("_m")).select("ref", "_m.address")


def detector(entries: list[DataFrame]) -> DataFrame:
    """(ref, address) of tables that may share references; one with two addresses is an error when rows are read."""
    rows = entries[0].select("ref", "address")
    for e in entries[1:]:
        rows = rows.unionByName(e.select("ref", "address"))
    stop = F.raise_error(F.concat(F.lit("two addresses for "), "ref", F.lit(": "), F.col("_a"), F.lit(", "), F.col("_b")))
    return rows.groupBy("ref").agg(F.min("address").alias("_a"), F.max("address").alias("_b")).select("ref", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(stop.cast("string")).alias("address"))


def url_id(url: Column, host: str = "github.com") -> Column:
    """(kind, id) of the link to a review, a comment on an issue or a pull, or a comment of a review; null for others."""
    base, out = rf"^https?://{re.escape(host)}/{_OWNER}/{_NAME}/", F.lit(None).cast("struct<kind:string,id:string>")
    for kind, tail in (("review", r"pull/\d+#pullrequestreview-(\d+)$"), ("issue_comment", r"issues/\d+#issuecomment-(\d+)$"), ("pull_comment", r"pull/\d+#issuecomment-(\d+)$"), ("review_comment", r"pull/\d+#discussion_r(\d+)")):
        found = F.regexp_extract(url, base + tail, 1)
        out = F.when(found != "", F.struct(F.lit(kind).alias("kind"), found.alias("id"))).otherwise(out)
    return out
