"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags. Words score +1, tags score less than zero, and the
contiguous run with the highest sum is the content region; one linear scan finds it. The
price of a tag comes from labelled pages: the rarer a tag is inside the main text, the more
it costs to step over it. Labelled pages also tell which elements seldom hold main text, by
the log-odds of their tag and the words of their class, id and role that enough pages use. If
the tag alone says so, the element holds none. Else it is a part of its own: it is left out of
a region around it, and its own best region, its sum times its odds, is the main text if it
beats that of every other part. So a wrapper with an unlucky class still gives its text.

Defined results: a null or empty page, or one without words outside elements that hold no main
text, has an empty text; of equal sums the earlier and shorter region wins; html, body, main
and article are never judged; unclosed elements end with
their parent, at the next element of the same kind where HTML says so, or with the page; an
unfinished tag at the end is dropped; whole pages are read.
"""

from __future__ import annotations

import html as entities
import math
import re
import sys
from collections import Counter

from pyspark import cloudpickle
from pyspark.sql import DataFrame

from corpusgate.llm.common import map_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TAG_PRICE = 4.0      # words that one unit of -log P(inside | tag) is worth
NOT_MAIN = -1.0      # log-odds below which an element is no part of the text around it
SUPPORT = 2          # labelled pages that must use a clue before it counts

# Fixed values of HTML.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr")
INLINE = ("a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em",
          "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike",
          "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img")
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"),
          "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",)}
UNJUDGED = ("html", "body", "main", "article")
CLOSES_P = ("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure",
            "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav",
            "ol", "pre", "section", "table", "ul")

# Labelled pages: (is main text, part). Written for this purpose.
LABELLED = [
    [(0, '<html><head><title>Harbour news</title></head><body><header class="site-header">'
         '<h1>The Harbour Post</h1></header><nav class="menu"><ul><li><a href="/">Home</a></li>'
         '<li><a href="/w">World</a></li></ul></nav><div class="cookie-notice">We use cookies.'
         '</div>'),
     (1, '<article><h1>Ferry returns</h1><p>The old ferry is back on the river.</p><p>It runs '
         '<b>twice</b> a day.</p><p>Tickets are sold <a href="/t">on board</a>.</p></article>'),
     (0, '<div class="comments"><h3>Comments</h3><div class="comment"><p>Nice!</p></div></div>'
         '<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Storm</a></li></ul>'
         '</aside><footer>Imprint and terms</footer></body></html>')],
    [(0, '<body><div id="header"><a href="/">Garden blog</a></div><div id="nav"><a href="/a">'
         'About</a><a href="/c">Contact</a></div><div class="ad banner">Buy seeds now</div>'),
     (1, '<div class="post entry-content"><h2>Sowing beans</h2><p>Beans want warm soil.<br>Wait '
         'until May.</p><ul><li>Soak them.</li><li>Sow them deep.</li></ul><blockquote><p>Early '
         'beans rot.</p></blockquote></div>'),
     (0, '<div class="share social"><a href="/s">Share</a></div><div class="related"><ul><li>'
         '<a href="/p">Peas</a></li></ul></div><form class="newsletter subscribe"><label>Mail'
         '</label><input><button>Join</button></form><div id="footer">All rights reserved'
         '</div></body>')],
    [(0, '<body><nav class="breadcrumb navigation"><a href="/">Start</a></nav><div '
         'class="advert">Cheap flights</div><div class="alert notice">Site closes at night.'
         '</div>'),
     (1, '<main><section class="content"><h1>Night trains</h1><h2>Routes</h2><p>Three routes '
         'opened.</p><table><tr><th>Line</th><td>North</td></tr></table><pre>01 02</pre><p><i>'
         'All</i> have <strong>beds</strong>.</p><ol><li>Book.</li></ol></section></main>'),
     (0, '<div class="sponsored promo">Sponsored: hotels</div><section id="comments"><h2>Reader '
         'comments</h2><p>Great.</p><p class="reply">Indeed.</p></section><div class="widget '
         'login"><form><input><select><option>en</option></select></form></div><div '
         'class="copyright">2020</div></body>')],
    [(0, '<body><div class="topbar toolbar"><a href="/l">Sign in</a></div><div role="navigation"'
         ' class="navbar"><ul class="menu"><li><a href="/x">Shop</a></li></ul></div><div '
         'class="ads">Sale</div><div class="ad">Offer of the day</div>'),
     (1, '<article class="article story"><header><h1>Bees</h1></header><div class="text body">'
         '<p>Bees sleep at night.</p><p>They <em>do</em>.</p><figure><img><figcaption>A bee'
         '</figcaption></figure><p>Some hold each other.</p><p>Why is not known.</p></div>'
         '</article>'),
     (0, '<div class="pagination pager"><a href="/2">Next</a></div><div class="disqus '
         'comment-list responses">Me too</div><div class="modal popup overlay">Subscribe!</div>'
         '<div class="sidebar widget">Tags</div><footer class="footer">Legal</footer></body>')],
    [(0, '<body class="home has-sidebar"><div id="page" class="site wrapper"><header '
         'class="site-header banner"><a href="/">Hill walks</a></header><div class="social share">'
         '<a href="/f">Follow</a></div><div id="content" class="container">'),
     (1, '<article class="post"><h1>Over the ridge</h1><p>The path starts at the mill.</p><ul '
         'class="list"><li>Take water.</li><li>Take a map.</li></ul><div class="alert"><p>The '
         'bridge is closed in March.</p></div><p>The last bus leaves at six.</p></article>'),
     (0, '<div class="related posts"><a href="/n">Next walk</a></div><div class="newsletter '
         'subscribe popup">Get our mail</div></div><aside class="sidebar"><p class="advert">Boots'
         '</p></aside><div class="footer copyright">Hill walks</div></div></body>')],
    [(0, '<body><div class="wrapper"><div class="toolbar login"><a href="/i">Log in</a></div>'
         '<div class="navbar navigation">Start Recipes</div><div class="breadcrumb">Start</div>'
         '<div class="cookie banner overlay">Cookies help us</div><div class="content list-page">'),
     (1, '<div class="entry recipe"><h1>Flat bread</h1><p>Mix flour and water.</p><ol '
         'class="list steps"><li>Knead it.</li><li>Let it rest.</li></ol><p>Bake it hot.</p></div>'),
     (0, '</div><div class="sponsored ads">Flour on offer</div><div class="pagination">1 2 3</div>'
         '<div id="disqus" class="comments"><div class="comment reply">Tasty</div></div><div '
         'class="promo modal">Win a mixer</div></div></body>')],
    [(0, '<body><div class="header">The weekly</div><div class="nav menu">Home Poems</div>'),
     (1, '<article><h1>Two voices</h1><div>Who is there?</div><div>Only me.</div><div>Come in.'
         '</div><div>It is late.</div><div>I know.</div></article>'),
     (0, '<div class="comments">So true</div><div class="footer">All rights</div></body>')],
    [(0, '<body><div class="topbar">Call us</div><div class="site has-nav"><div class="pager">'
         'Older</div>'),
     (1, '<section class="content story"><h2>The well</h2><p>The well is very old.</p><p>Nobody '
         'knows who dug it.</p></section>'),
     (0, '<div class="responses replies">No replies yet</div></div><form class="login"><label>Name'
         '</label><input></form><div class="promo">Visit the shop</div></body>')],
]

_ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_WORDS = re.compile(r"[a-z]+")
_LAYOUT = re.compile(r"\b(?:has|with|without|no)[-_][\w-]*")
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")


def tokens(page: str):
    """Yield ("text", text) and ("open" | "close", tag name, attributes)."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:]
            return
        following = page[lt + 1:lt + 2]
        if lt > at:
            yield "text", page[at:lt]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif following in ("!", "?") or (following == "/" and not page[lt + 2:lt + 3].isalpha()):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif following.isascii() and (following.isalpha() or following == "/"):
            m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
            if m is None:
                return
            name, at = m[2].lower(), m.end()
            yield ("close" if m[1] else "open"), name, m[3]
            if not m[1] and name in RAW and not m[3].endswith("/"):
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                at = close.start() if close else n
        else:
            yield "text", "<"
            at = lt + 1


def clues(name: str, attributes: str) -> list[str]:
    """What an element is judged by: its tag and the words of its class, id and role.

    Names such as has-sidebar tell what else is on the page, not what the element is.
    """
    found = [f"<{name}>"]
    for value in _ATTRIBUTE.findall(attributes) if attributes else ():
        found += _WORDS.findall(_LAYOUT.sub(" ", value.lower()))
    return found


def clues_of_page(page) -> tuple[set[str], set[str]]:
    """Clues of the elements of a labelled page with main text in them, and of the others."""
    held: tuple[set[str], set[str]] = set(), set()
    opened: list[list] = []     # name, clues, whether main text lies in it

    def close(to: int):
        while len(opened) > to:
            _name, own, main = opened.pop()
            held[not main].update(own)

    for is_main, part in page:
        for token in tokens(part):
            if token[0] == "text":
                if is_main and token[1].strip():
                    for element in opened:
                        element[2] = True
            elif token[0] == "open":
                opened.append([token[1], clues(token[1], token[2]), bool(is_main)])
                if token[1] in VOID:
                    close(len(opened) - 1)
            else:
                close(max((i for i, e in enumerate(opened) if e[0] == token[1]),
                          default=len(opened)))
    close(0)
    return held


class Weights:
    """Tag prices, and log-odds of clues by the labelled pages that use them."""

    def __init__(self, pages=None):
        inside, outside = Counter(), Counter()
        clue_in, clue_out = Counter(), Counter()
        for page in pages or LABELLED:
            for is_main, part in page:
                tags = inside if is_main else outside
                tags.update(token[:2] for token in tokens(part) if token[0] != "text")
            with_text, without = clues_of_page(page)
            clue_in.update(with_text)
            clue_out.update(without)
        self.price = {t: -TAG_PRICE * math.log((inside[t] + 0.05) / (inside[t] + outside[t] + 0.1))
                      for t in inside | outside}
        # The tags that the main text itself begins and ends with lie on its edge.
        for edge in ("article", "main", "body"):
            for kind in ("open", "close"):
                self.price[kind, edge] = TAG_PRICE * 3
        self.usual = TAG_PRICE * math.log(2) / 4
        self.odds = {c: math.log((clue_in[c] + 0.25) / (clue_out[c] + 0.25))
                     for c in clue_in | clue_out if clue_in[c] + clue_out[c] >= SUPPORT}
        # Inline and text tags occur everywhere; only containers speak for themselves.
        for tag in (*INLINE, "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "div",
                    "section", "table", "br", "html", "body"):
            self.odds.pop(f"<{tag}>", None)
        self.price.update({(k, t): min(self.price.get((k, t), 0.1), 0.1) for k in ("open", "close")
                           for t in (*INLINE, "p", "br", "h1", "h2", "h3", "li", "ul", "ol", "div")})
        self.judged: dict[tuple[str, str], float] = {}

    def share(self, name: str, attributes: str) -> float:
        """1 for an ordinary element, 0 if it holds no main text, else the odds that it does."""
        if name in RAW or name in ("head", "button", "select"):
            return 0.0
        if name in UNJUDGED:
            return 1.0
        key = (name, attributes)
        known = self.judged.get(key)
        if known is None:
            if len(self.judged) > 1 << 14:
                self.judged.clear()
            odds = sum(self.odds.get(c, 0.0) for c in clues(name, attributes))
            # Some sites put the whole page into one form.
            bare = name != "form" and self.odds.get(f"<{name}>", 0.0) < NOT_MAIN
            known = 1.0 if odds >= NOT_MAIN else 0.0 if bare else math.exp(odds)
            self.judged[key] = known
        return known


class Part:
    """The scan of what lies in one doubtful element, or in none, with its best region."""

    __slots__ = ("share", "run", "start", "best", "span", "blocks", "new_block")

    def __init__(self, share: float):
        self.share, self.run, self.start, self.best, self.span = share, 0.0, 0, 0.0, (0, -1)
        self.blocks: list[list] = []       # [first, last token with words, text parts]
        self.new_block = True


def extract(page: str | None, weights: Weights) -> str:
    """The main text of one page."""
    stack: list[tuple] = []                # open elements: name, share, the part around
    hidden = place = 0                     # open elements that hold nothing; token number
    now = Part(1.0)
    parts = [now]

    def leave(to: int):
        nonlocal hidden, now
        while len(stack) > to:
            _name, share, now = stack.pop()
            hidden -= share == 0

    for token in tokens(page or ""):
        place += 1
        if token[0] == "text":
            if hidden:
                continue
            text = token[1]
            if "&" in text:
                text = entities.unescape(text)
            words = len(text.split())
            if words:
                if now.run <= 0:
                    now.run, now.start = 0.0, place
                now.run += words
                if now.run > now.best:
                    now.best, now.span = now.run, (now.start, place)
            if now.new_block:
                now.blocks.append([0, 0, []])
                now.new_block = False
            block = now.blocks[-1]
            if words:
                block[:2] = block[0] or place, place
            block[2].append(text)
            continue
        kind, name, attributes = token
        if name == "br" and now.blocks and not now.new_block and not hidden:
            now.blocks[-1][2].append("\n")
        was_hidden, before = hidden, now
        if kind == "close":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    leave(i)
                    break
        else:
            ends = CLOSES.get(name) or (("p",) if name in CLOSES_P else ())
            if ends:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        leave(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
        if name not in INLINE and name != "br":
            before.new_block = now.new_block = True
        if kind == "open" and name not in VOID and not (attributes.endswith("/") and name in RAW):
            share = weights.share(name, attributes)
            stack.append((name, share, now))
            hidden += share == 0
            if 0 < share < 1 and not hidden:
                now = Part(now.share * share)
                parts.append(now)
        if not hidden and not was_hidden and now is before:
            now.run -= weights.price.get((kind, name), weights.usual)
    found = max(parts, key=lambda p: p.best * p.share)
    # Only inline tags can end a region within a block; such a block is whole in the text.
    lo, hi = found.span
    out = (" ".join("".join(b[2]).split()) for b in found.blocks if b[0] <= hi and lo <= b[1])
    return "\n\n".join(b for b in out if b)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    rows = pages.select(id_col, url_col, html_col)

    def make():
        weights = Weights()

        def work(batch):
            texts = [extract(p, weights) for p in batch[html_col]]
            return {id_col: batch[id_col], url_col: batch[url_col], "text": texts,
                    "n_chars": [len(t) for t in texts]}
        return work

    kinds = [f.dataType.simpleString() for f in rows.schema]
    return map_batches(rows, make, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, "
                                   "text STRING, n_chars BIGINT")
