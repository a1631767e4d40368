"""Main text of web pages from flat text blocks.

A page is cut into flat blocks at block-level tags. Every block has its words and link density, those of the blocks
before and after it, and whether the markup around it says article or page furniture. A decision tree trained on the
small labelled table below says which blocks are main text; it is then an SQL expression over the blocks of a page.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

FEATURES = ("in_main", "in_boiler", "heading", "words", "link_density", "words_before", "links_before", "words_after", "links_after")

#: The labelled table: pages as runs of blocks (in_main, in_boiler, heading, words, link density, is main text).
LABELLED = [
    [(0, 1, 0, 1, 1.0, 0), (0, 1, 0, 2, 1.0, 0), (0, 1, 0, 1, 1.0, 0), (0, 1, 0, 9, 0.0, 0), (1, 0, 1, 9, 0.0, 1), (1, 0, 0, 60, 0.0, 1), (1, 0, 0, 2, 0.0, 1), (1, 0, 0, 140, 0.0, 1), (0, 1, 0, 11, 0.0, 0)],
    [(0, 1, 0, 3, 0.0, 0), (0, 1, 0, 14, 0.1, 0), (1, 0, 1, 4, 0.0, 1), (1, 0, 0, 1, 0.0, 1), (1, 0, 0, 350, 0.0, 1), (0, 1, 0, 25, 0.0, 0), (0, 1, 0, 40, 0.0, 0)],
    [(0, 1, 0, 1, 1.0, 0), (1, 0, 1, 6, 0.0, 1), (1, 0, 0, 5, 0.0, 1), (1, 0, 0, 7, 0.0, 1), (1, 0, 0, 30, 0.3, 1), (1, 0, 0, 45, 0.5, 1), (1, 0, 0, 18, 0.2, 1), (1, 1, 0, 30, 0.0, 0), (1, 0, 0, 22, 0.0, 1), (1, 1, 0, 6, 1.0, 0), (1, 1, 0, 70, 0.0, 0)],
    [(1, 0, 1, 5, 0.0, 1), (1, 0, 0, 80, 0.1, 1), (1, 0, 0, 3, 1.0, 0), (1, 0, 0, 4, 1.0, 0), (1, 0, 0, 2, 1.0, 0), (0, 1, 0, 3, 1.0, 0)],
    [(1, 0, 0, 90, 0.0, 1), (1, 0, 0, 6, 0.0, 1), (1, 0, 0, 90, 0.1, 1), (1, 0, 0, 12, 0.6, 1), (1, 0, 0, 60, 0.0, 1), (1, 0, 0, 5, 0.95, 0), (1, 0, 0, 6, 1.0, 0)],
    [(0, 0, 0, 1, 1.0, 0), (0, 0, 0, 1, 1.0, 0), (0, 0, 0, 2, 1.0, 0), (0, 0, 0, 1, 1.0, 0), (0, 0, 1, 8, 0.0, 1), (0, 0, 0, 80, 0.0, 1), (0, 0, 0, 40, 0.1, 1), (0, 0, 0, 13, 0.0, 1), (0, 0, 0, 60, 0.0, 1), (0, 0, 0, 6, 0.4, 0), (0, 0, 0, 2, 1.0, 0), (0, 0, 0, 2, 1.0, 0)],
    [(0, 0, 0, 2, 0.0, 0), (0, 0, 0, 3, 1.0, 0), (0, 0, 0, 4, 1.0, 0), (0, 0, 1, 6, 0.0, 1), (0, 0, 0, 110, 0.0, 1), (0, 0, 0, 25, 0.0, 1), (0, 0, 0, 35, 0.1, 1), (0, 0, 0, 7, 0.5, 0), (0, 0, 0, 8, 0.6, 0), (0, 0, 0, 9, 0.7, 0)],
    [(0, 0, 0, 3, 0.0, 0), (0, 0, 0, 12, 0.8, 0), (0, 0, 0, 30, 0.9, 0), (0, 0, 1, 10, 0.0, 1), (0, 0, 0, 30, 0.0, 1), (0, 0, 0, 28, 0.0, 1), (0, 0, 0, 200, 0.05, 1), (0, 1, 0, 55, 0.0, 0), (0, 1, 0, 35, 0.0, 0), (0, 0, 0, 25, 0.7, 0), (0, 0, 0, 4, 0.0, 0)],
    [(0, 0, 1, 3, 1.0, 0), (0, 0, 0, 20, 1.0, 0), (0, 0, 0, 75, 0.0, 1), (0, 0, 0, 50, 0.2, 1), (0, 0, 0, 40, 0.8, 0), (0, 0, 0, 45, 0.7, 0)],
    [(0, 0, 0, 24, 0.0, 1)],
    [(0, 0, 1, 5, 0.0, 1), (0, 0, 0, 20, 0.0, 1), (0, 0, 0, 16, 0.0, 1), (0, 0, 0, 30, 0.0, 1)],
    [(0, 0, 0, 2, 1.0, 0), (0, 0, 0, 24, 0.0, 1), (0, 0, 0, 50, 0.1, 1), (0, 0, 0, 3, 1.0, 0)],
    [(0, 0, 0, 100, 0.0, 1), (0, 0, 0, 22, 0.0, 1), (0, 0, 0, 3, 1.0, 0)],
    [(0, 1, 1, 2, 0.0, 0), (0, 1, 0, 60, 0.0, 0), (0, 1, 0, 30, 0.2, 0), (0, 1, 1, 9, 0.0, 0), (0, 1, 0, 120, 0.0, 0), (1, 0, 0, 10, 0.0, 1)],
]

#: Words in a tag's class, id or role that tell furniture and articles apart (fixed values).
_BOILER = frozenset("""nav navbar navigation menu header masthead footer sidebar aside complementary contentinfo cookie cookies
consent gdpr notice notices alert alertdialog dialog banner ad ads advert adverts advertisement advertising sponsor sponsored promo promotion
comment comments reply replies respond disqus share sharing social related recommended recommendations newsletter subscribe subscription
signup login search form breadcrumb breadcrumbs pagination pager popup modal overlay widget toolbar copyright disclaimer hidden""".split())
_MAIN = frozenset("article main content post entry story prose".split())
_OWN_PARTS = frozenset("header banner".split())  # inside an article these are its own
_BOILER_TAGS = frozenset("nav header footer aside form menu dialog button select fieldset".split())
_BLOCK_TAGS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary
table tbody td tfoot th thead title tr ul""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LOOSE = frozenset("p li dt dd option tr td th b i u em strong span font small".split())  # often left open: never on the stack
_RAW = r"script|style|noscript|template|iframe|textarea|title|xmp"
_MEDIA = r"svg|object|math|canvas|audio|video"  # left out whole; without an end tag of their own, the tag alone
_TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<({_RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    rf"|<(?P<media>{_MEDIA})(?=[\s/>])(?:[^>]*/>|[^>]*>(?:[^<]*+(?:<(?!/?(?P=media)(?=[\s/>]))[^<]*+)*+</(?P=media)\s*>)?)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I)
_FORM_END = re.compile(r"</form\s*>", re.I)
_CONTROLS = re.compile(r"<(select|button|textarea|script|style)(?=[\s/>]).*?(?:</\1\s*>|\Z)|<[^>]*>", re.S | re.I)
#: A form with so many words outside its controls is the page, not furniture.
FORM_WORDS = 60
#: The least words of a block outside furniture that make a page's classes trustworthy, and of the text found otherwise.
TRUSTED_WORDS, LOOSE_WORDS = 10, 40
#: Words before a furniture word that make a class speak of the layout around it (fixed values).
_LAYOUT = frozenset("has with no without".split())
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def _cues(attributes: str) -> tuple[set[str], bool]:
    """Words in class, id and role, and whether the element is hidden."""
    words, hidden = set(), False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        name = name.lower()
        if name in ("class", "id", "role"):
            for token in value.split():
                parts = re.split(r"[_-]+", token)
                if parts[0] not in _LAYOUT:
                    words.update(parts)
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        else:
            hidden |= value != "false"
    return words, hidden


def parse_blocks(html: str) -> list[dict]:
    """Flat text blocks in page order, with the features of FEATURES.

    Where the classes say that all text is furniture, those of elements that hold half of the page's words or more are
    left aside (a layout named after its sidebar), and an article below furniture starts afresh; the rest must then have
    an article or a heading.
    """
    blocks, held, words = _parse(html, None)
    if not held or any(not b["in_boiler"] and not b["heading"] and (b["in_main"] or b["words"] >= TRUSTED_WORDS) for b in blocks):
        return blocks
    loose = _parse(html, frozenset(k for k, n in held.items() if 2 * n >= words))[0]
    own = [b for b in loose if not b["in_boiler"] and b["link_density"] < 0.5]
    is_page = any(b["in_main"] or b["heading"] for b in own) and sum(b["words"] for b in own) >= LOOSE_WORDS
    return loose if is_page else blocks


def _parse(html: str, forgiven: frozenset | None) -> tuple[list[dict], dict[int, int], int]:
    """(blocks, words held by each element that is furniture, words of the page). An element's number is
    where it opens."""
    blocks: list[dict] = []
    stack: list[tuple] = []  # tag, main, boiler, link of open elements; number of furniture and the words before it
    held: dict[int, int] = {}
    total = 0
    pieces: list[tuple[str, bool]] = []
    heading = False

    def close(k: int):
        for *_, number, before in stack[k:]:
            if number is not None:
                held[number] = total - before
        del stack[k:]

    def flush():
        nonlocal total
        if pieces:
            text = " ".join("".join(p for p, _ in pieces).split())
            if text:
                words = text.count(" ") + 1
                total += words
                linked = len(" ".join(p for p, link in pieces if link).split())
                _, main, boiler, *_ = stack[-1] if stack else ("", False, False, False)
                blocks.append({"text": text, "in_main": int(main), "in_boiler": int(boiler), "heading": int(heading), "words": words, "link_density": min(1.0, linked / words)})
            pieces.clear()

    def text_of(raw: str):
        if raw:
            pieces.append((unescape(raw), bool(stack and stack[-1][3])))

    form_ends = True  # whether a form may still be closed further down

    def wide_form(start: int) -> bool:
        nonlocal form_ends
        end = _FORM_END.search(html, start) if form_ends else None
        form_ends = end is not None
        return end is None or len(_CONTROLS.sub(" ", html[start:end.start()]).split()) >= FORM_WORDS

    def end_cell(row: bool):
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == "table":
                return
            if stack[k][0] in ("td", "th") or row and stack[k][0] == "tr":
                close(k)

    at = 0
    for m in _TOKEN.finditer(html):
        text_of(html[at:m.start()])
        at = m.end()
        closing, tag, attributes = (m[3], m[4], m[5]) if m[4] else (m[6], m[7], m[8])
        if not tag:
            if m[1]:
                flush()
            continue
        tag = tag.lower()
        if tag == "br":
            pieces.append((" ", False))
            continue
        if tag in _BLOCK_TAGS:
            flush()
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = not closing
            elif tag in ("p", "div", "li", "ul", "section", "article"):
                heading = False
        if tag in _VOID:
            continue
        if tag in ("td", "th", "tr"):
            end_cell(tag == "tr")
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if stack and (stack[-1][0] == "p" and tag in _BLOCK_TAGS or stack[-1][0] == tag == "li"):
            close(len(stack) - 1)  # closed by what follows
        if tag in _LOOSE and not attributes.strip():
            continue
        _, main, boiler, link, *_ = stack[-1] if stack else ("", False, False, False)
        number = None
        if tag in ("html", "body"):
            pass
        elif tag == "head":
            boiler = True
        else:
            words, hidden = _cues(attributes) if attributes.strip() else ((), False)
            own = _OWN_PARTS if main else ()
            furniture = (tag in _BOILER_TAGS and tag not in own) or any(w in _BOILER and w not in own for w in words)
            if furniture and tag == "form" and wide_form(at):
                furniture = any(w in _BOILER - {"form"} for w in words)
            if furniture:
                number = m.start()
                furniture = forgiven is None or number not in forgiven
            if forgiven is not None and tag in ("article", "main"):
                boiler = False
            furniture = furniture or hidden
            article = tag in ("article", "main") or any(w in _MAIN for w in words)
            boiler = boiler or furniture
            main = main or article and not furniture
            link = link or tag == "a"
        if tag in _LOOSE and not boiler:
            continue
        if tag == "body":  # an unclosed head ends here
            stack[:] = [s for s in stack if s[0] == "html"]
            boiler = False
        stack.append((tag, main, boiler, link, number, total))
    text_of(html[at:])
    flush()
    close(0)
    return blocks, held, total


def _features(blocks: list[dict]) -> list[list[float]]:
    rows = []
    for k, b in enumerate(blocks):
        before, after = blocks[k - 1] if k else None, blocks[k + 1] if k + 1 < len(blocks) else None
        near = [x[f] if x else 0.0 for x in (before, after) for f in ("words", "link_density")]
        rows.append([float(v) for v in [b["in_main"], b["in_boiler"], b["heading"], b["words"], b["link_density"], *near]])
    return rows


def train_tree(spark: SparkSession, labelled=LABELLED, depth: int = 6):
    """The decision tree fitted on the labelled table, as a function from a block column to a boolean column."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.linalg import Vectors

    rows = []
    for page in labelled:
        blocks = [dict(zip(("in_main", "in_boiler", "heading", "words", "link_density"), x)) for x in page]
        rows += [(Vectors.dense(f), float(x[-1])) for f, x in zip(_features(blocks), page)]
    table = spark.createDataFrame(rows, ["features", "label"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, seed=1).fit(table)
    lines = [(len(line) - len(line.lstrip()), line.strip()) for line in model.toDebugString.splitlines()[1:] if line.strip()]

    def build(at: int) -> tuple:
        text = lines[at][1]
        if text.startswith("Predict"):
            return ("leaf", float(text.split(":")[1])), at + 1
        _, feature, _, value = re.match(r"(If|Else) \(feature (\d+) (<=|>) ([-\d.E]+)\)", text).groups()
        left, nxt = build(at + 1)
        right, end = build(nxt + 1)
        return ("split", int(feature), float(value), left, right), end

    tree, _ = build(0)

    def expression(node, block: Column) -> Column:
        if node[0] == "leaf":
            return F.lit(node[1] == 1.0)
        _, feature, value, left, right = node
        return F.when(block[FEATURES[feature]] <= value, expression(left, block)).otherwise(expression(right, block))

    return lambda block: expression(tree, block)


_BLOCKS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), *[T.StructField(f, T.DoubleType()) for f in FEATURES]]))


def page_blocks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and the array of blocks with their features."""
    schema = T.StructType([T.StructField("page_id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), T.StructField("blocks", _BLOCKS)])
    kind = pa.list_(pa.struct([("text", pa.string()), *[(f, pa.float64()) for f in FEATURES]]))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                out = []
                for html in b.column(2).to_pylist():
                    found = parse_blocks(html or "")
                    out.append([{"text": x["text"], **dict(zip(FEATURES, f))} for x, f in zip(found, _features(found))])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, kind)], names=schema.names)

    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Blocks of main text in page order, joined by a line feed; white space inside a block is one space, character
    references are decoded. A null or empty page, or one without main text, gives an empty text. Every row gives a row,
    repeated ones too; null ids and urls stay null. Other columns are ignored, so their names cannot clash.
    """
    is_main = train_tree(pages.sparkSession)
    kept = F.filter("blocks", is_main)
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return page_blocks(pages, id_col, url_col, html_col).select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
