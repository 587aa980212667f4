"""Main text of web pages by the maximum-scoring run of tokens.

A page is a sequence of words and tags. Words in running text score positive and tags, and words
of links and lists of links, negative. One linear scan finds the run with the highest sum.
Elements have a cue, the sum of what their name, role, visibility and the words of their class
and id say; an element with a cue below ``FRAME`` is one negative token for the page around it, and a
sequence of its own (a frame), whose sums count as much less as its cue says. The best run of
all frames is the text. All weights and cues are learned from ``LABELLED``, pages whose main
text is marked; nothing is left out by name but elements that hold no text at all, such as scripts.

The run then grows over whole blocks next to its ends that score above zero, within the element
that holds it, so that a short heading or a short last line isn't lost to the tags around it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import read_table

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template svg iframe object textarea select title canvas math audio video map".split())
#: Of these, ones that go on to the page's end if they are not closed.
OPEN_ENDED = frozenset(("script", "style", "textarea", "title"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img data ruby rb rt rp input".split())
#: Elements that hold blocks; others close by themselves.
HOLDERS = frozenset("html body main article section div td th tr table tbody ul ol dl blockquote figure header center details nav aside footer form menu dialog button fieldset".split())
#: Names that say something of an element's content.
TELLING = frozenset("main article header nav aside footer form menu dialog button fieldset".split())
PAGE = frozenset(("", "html", "body"))
#: The cue below which an element is a frame, and the least sum of a run in one.
FRAME = -0.5
LEAST_IN_FRAME = 2.0
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)"
    r"(?P<rest>(?:[\s/]++|[^\s>/=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+|=)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s>/=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Labelled pages: the main text lies between the marks [[ and ]].
LABELLED = [
    "<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/news'>News today</a></li><li><a href='/x'>Contact</a></li></ul></nav><article>[[<h1>Rain again</h1><p>It rained in the valley for a third day and the river rose by a foot.</p><p>Farmers moved their sheep to the higher fields.</p>]]</article><footer>Copyright by the paper. All rights reserved.</footer></body></html>",
    "<body><div><a href='a'>Start</a> | <a href='b'>Archive of posts</a> | <a href='c'>About me</a></div><div>[[<h2>Bread</h2><p>Mix flour and water, <b>wait</b> a night, and bake it <a href='h'>hot</a>.<br>Let it cool before you cut it.</p><ul><li>Flour, one pound</li><li>Water, a cup or two</li></ul>]]</div><div><a href='1'>Older posts</a> <a href='2'>Newer posts</a></div><div><a href='3'>Legal</a></div></body>",
    "<body><header><a href='/'>The Gazette</a></header><table><tr><td><a href='s'>Sport</a><br><a href='p'>Politics</a><br><a href='w'>Weather</a></td><td>[[<p>The council met on Monday to speak about the bridge, which is old and needs new beams.</p><p>A vote will follow in June.</p><blockquote>We must act, said the mayor.</blockquote>]]</td></tr></table><p><a href='t'>Terms</a> <a href='q'>Privacy</a></p></body>",
    "<body><ul><li><a href='1'>One</a></li><li><a href='2'>Two</a></li></ul><main>[[<h1>On maps</h1><p>Old maps were drawn by hand and painted. Few of them are left, and those that are hang in museums.<p>The best known one shows the whole coast with all its harbours.]]</main><ul><li><a href='5'>Read more on maps</a></li><li><a href='6'>Read more on ships</a></li></ul></body>",
    # A weblog.
    "<body class='single post'><div id='masthead' class='site-header banner' role='banner'><p>Notes from a small garden</p></div><div id='navbar' class='navbar navigation menu' role='navigation'><a href='/'>Home</a> <a href='/w'>Work</a></div><div class='skip-link hidden' hidden>Skip to what you want</div>"
    "<div id='content' class='site-content'><main id='main'><article class='post entry'>[[<header class='entry-header'><h1 class='entry-title'>Late frost</h1></header><div class='entry-content'><p>The frost came in May and took the blossom of the plum. We lit fires between the rows.</p><p>It helped a little.</p></div>]]<div class='share sharing social'>Share this with your friends</div>"
    "<div class='ad advert'>Buy seeds at half the price now</div></article><section id='comments' class='comments discussion'><h2>Two replies</h2><article class='comment reply'><p>Same here, we lost all of our pears.</p></article><article class='comment replies'><p>Try covers of fleece next time, they work well.</p></article><div id='respond' class='comment-respond'><form class='comment-form'><p>Leave a reply. Your address stays private.</p></form></div></section></main></div>"
    "<div id='sidebar' class='sidebar widgets side' role='complementary'><section class='widget'><p>About me: I grow fruit and write.</p></section><section class='widget promo'><p>My book is out now.</p></section></div><div id='colophon' class='site-footer footer' role='contentinfo'>Made with care. All rights reserved.</div></body>",
    # A newspaper.
    "<body><div class='cookie-banner cookies consent gdpr notice' role='dialog' aria-hidden='true'><p>We and our partners use cookies to know you better.</p></div><div class='topbar toolbar'><div class='search' role='search'><form action='/s'><p>Search the paper</p></form></div><div class='login signup'>Sign in or join us</div></div><nav class='breadcrumb breadcrumbs'><a href='/'>Home</a> / <a href='/c'>City</a></nav>"
    "<div class='adv adverts advertising'>Your advert could be here</div><div class='article-body story'>[[<h1>Bridge shut</h1><p>The old bridge is shut from today, as its beams no longer bear a bus.</p>]]<div class='newsletter subscribe subscription'>Get our letter each morning for free</div>[[<p>Drivers must go round by the mill until spring, the council said, and trams run every ten minutes.</p>]]</div>"
    "<aside class='related recommended'><h3>More from the city</h3><p>Mill road to be widened at last</p></aside><div class='recommendations sponsored sponsor'><p>Ten tricks that dentists don't want you to know</p></div><div class='pagination pager'>Page one of three</div><footer class='legal copyright disclaimer'>We take no blame for errors. Copyright by us.</footer></body>",
    # A shop's guide, all of it in one form.
    "<body><form id='pageForm'><div class='popup modal overlay alert' role='alert' aria-hidden='true'>Ten off your first order</div><div class='nav menu'><ul><li><a href='1'>Shoes</a></li><li><a href='2'>Coats</a></li></ul></div><div id='main' class='text page'>[[<h2>How to care for boots</h2><p>Brush the mud off when it is dry. Wax the leather twice a year, and never dry boots by the fire.</p><p>Stuff them with paper over night.</p>]]</div><div class='notices'>Prices hold while stocks last</div></form></body>",
    # A forum's help page with a list of contents.
    "<body><header class='header'><p>The bicycle forum</p></header><div class='container'><div class='side sidebar'><p>New here? Read the rules first.</p></div><section class='content'>[[<h1>Fix a flat</h1><p>Take the wheel off and lift the tyre over the rim.</p><ol><li>Find the hole with water</li><li>Roughen it and glue on a patch</li></ol><p>Pump it up and look again.</p>]]</section></div><section class='disqus comment'><p>Works, thanks a lot!</p></section><section class='banner promotion'><p>Join the club today</p></section><menu><button>Like it</button><button>Report it</button></menu></body>",
    "<body><div style='display:none'>Words that no one sees at all</div><article class='with-sidebar'>[[<h1>Snow</h1><p>Snow fell on the hills and the pass was closed by noon. Ploughs went out at once.</p>]]</article><aside><p>Other weather of the day</p></aside><div class='advertisement ads'>Warm coats here</div><fieldset><p>Pick a town</p></fieldset><dialog><p>Rate this page</p></dialog><footer><p>The weather desk</p></footer></body>",
    "<body><nav>Go to all our pages</nav><main class='content'><article>[[<h1>Clay</h1><p>Clay is dug in autumn and left to the frost. In spring it is soft enough for the wheel.</p>]]<aside><p>Read on about glaze</p></aside></article></main><form><p>Write to us</p></form><footer><p>Potters of the north</p></footer></body>",
    "<body><nav class='navigation'>Ways around this site</nav><article class='news'>[[<h1>Fair</h1><p>The fair opens on Friday with forty stalls, and the band plays at eight.</p>]]<form><p>Tell us what you think</p></form></article><aside class='widget'><p>Fairs of the month</p></aside><footer>All rights with the town</footer></body>",
]


def features(tag: str, rest: str, nested: bool) -> list[str]:
    """What is known of an element: its name where that tells something (a header within an article
    or section is another thing), role, whether it is hidden, and the words of its class and id."""
    out = ["inner header" if tag == "header" and nested else tag] if tag in TELLING else []
    if rest and tag not in PAGE:
        words: set[str] = set()
        for name, value in _ATTRIBUTE.findall(rest):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                out.append("hidden")
            elif name == "role":
                out.append("role " + value.lower())
            elif name in ("class", "id"):
                words.update(p.lower() for p in _PARTS.findall(value))
        out += ["word " + w for w in sorted(words)]
    return out


#: Words of at least so many letters are looked for at the ends of unknown ones.
LEAST_PART = 4


def cue_of(feature: str, cues: dict[str, float]) -> float:
    """A feature's cue. A word that was not learned has those of the longest learned words it begins and ends with."""
    if feature in cues or not feature.startswith("word "):
        return cues.get(feature, 0.0)
    word = feature[5:]
    cuts = range(len(word) - 1, LEAST_PART - 1, -1)
    head = next((word[:k] for k in cuts if "word " + word[:k] in cues), "")
    tail = next((word[-k:] for k in cuts if "word " + word[-k:] in cues), "")
    return sum(cues["word " + w] for w in {head, tail} if w)


class Page:
    """A page's tokens: ``kinds`` to score, ``pieces`` of text (a space for a block's edge), their number
    of ``words``, and the ``elements`` they are in, numbered as they open, each with its ``parents``
    element, its ``tags`` and the ``last`` element in it. ``frames`` has the numbers of the tokens
    of the page around its frames, and then of each frame around those within it; ``factors`` what
    their sums count."""

    def __init__(self, source: str, cues: dict[str, float]):
        self.kinds: list[str] = []
        self.pieces: list[str] = []
        self.words: list[int] = []
        self.elements: list[int] = []
        self.parents, self.tags, self.last, self.about = [0], [""], [0], [[]]
        self.frames: list[list[int]] = [[]]
        self.factors = [1.0]
        known: dict[tuple[str, str, bool], tuple[list[str], float]] = {}
        # Open elements: tag, number, frame outside.
        stack: list[tuple[str, int, int]] = []
        depth: Counter[str] = Counter()
        never: set[str] = set()
        lower = ""
        links = item = frame = element = 0

        def put(kind: str, piece: str, words: int = 0) -> None:
            self.frames[frame].append(len(self.kinds))
            self.kinds.append(kind)
            self.pieces.append(piece)
            self.words.append(words)
            self.elements.append(element)

        def text(piece: str) -> None:
            piece = html.unescape(piece)
            n = len(piece.split())
            put(("link" if links else "item" if item else "word") if n else "space", piece, n)

        def close() -> None:
            nonlocal frame, element
            tag, number, frame = stack.pop()
            depth[tag] -= 1
            self.last[number] = len(self.parents) - 1
            element = self.parents[number]

        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at:
                text(source[at : m.start()])
            at = m.end()
            tag = (m["tag"] or "").lower()
            if not tag:
                continue
            if m["end"]:
                if tag == "a":
                    links = 0
                if depth[tag]:
                    while stack[-1][0] != tag:
                        close()
                    close()
                if tag not in INLINE:
                    item = 0 if tag == "li" else item
                put("inline" if tag in INLINE else "/", "" if tag in INLINE else " ")
                continue
            rest = m["rest"]
            if tag in RAW:
                if tag not in never and not (rest.rstrip().endswith("/") and tag not in OPEN_ENDED):
                    lower = lower or source.lower()
                    end = lower.find("</" + tag, at) if len(lower) == len(source) else -1
                    if end < 0:
                        closing = re.compile("</" + tag, re.I).search(source, at)
                        end = closing.start() if closing else -1
                    if end >= 0:
                        at = end
                    elif tag in OPEN_ENDED:
                        at = len(source)
                        break
                    else:
                        never.add(tag)
                continue
            if tag not in INLINE:
                item = int(tag == "li")
            # Paragraphs and items that are on the stack close by themselves.
            while stack and (stack[-1][0] == "p" and tag not in INLINE or stack[-1][0] == tag == "li"):
                close()
            if tag == "a":
                links = 1
            if tag in VOID:
                put("br" if tag == "br" else "inline" if tag in INLINE else "open", "" if tag in INLINE else " ")
                continue
            key = (tag, rest, bool(depth["article"] or depth["main"] or depth["section"]))
            if key not in known:
                found = features(*key)
                known[key] = found, sum(cue_of(f, cues) for f in found)
            about, cue = known[key]
            if tag in HOLDERS or cue < FRAME:
                if tag in HOLDERS:
                    links = 0
                outside = frame
                if cue < FRAME:
                    put("aside", " " if tag not in INLINE else "")
                    self.frames.append([])
                    self.factors.append(self.factors[frame] * math.exp(cue))
                    frame = len(self.frames) - 1
                self.parents.append(element)
                self.tags.append(tag)
                self.last.append(0)
                self.about.append(about)
                element = len(self.parents) - 1
                stack.append((tag, element, outside))
                depth[tag] += 1
            put("a" if tag == "a" else "inline" if tag in INLINE else tag if tag in ("p", "li") else "heading" if re.fullmatch("h[1-6]", tag) else "open", "" if tag in INLINE else " ")
        if at < len(source):
            text(source[at:])
        while stack:
            close()
        self.last[0] = len(self.parents) - 1

    def holder(self, tokens: list[int]) -> int:
        """The innermost element that holds all of the tokens."""
        lo, hi = min(self.elements[i] for i in tokens), max(self.elements[i] for i in tokens)
        while self.last[lo] < hi:
            lo = self.parents[lo]
        return lo


def learn(labelled: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """Weights by token kind and cues by feature.

    A cue is the logarithm of how many more elements with the feature hold main text than hold other
    words (half of one added to each); a weight is that of how much more frequent a token is inside
    the main text than outside, counting words one by one, over that of words in running text. Tags
    are held below zero, and so are words that are more frequent outside.
    """
    cues: dict[str, float] = {}
    for last in (False, True):
        held, other, inside, outside = Counter(), Counter(), Counter(), Counter()
        for source in labelled:
            page = Page(source, cues)
            main = False
            sums = [[0, 0] for _ in page.parents]
            within = {i for i in page.frames[0]}
            for i, (kind, piece, n) in enumerate(zip(page.kinds, page.pieces, page.words, strict=True)):
                for mark in ("[[", "]]"):
                    if mark in piece:
                        main, n = mark == "[[", n - 1
                if i in within and (n or not page.words[i]):
                    (inside if main else outside)[kind] += n or 1
                element = page.elements[i]
                while n:
                    sums[element][main] += n
                    if not element:
                        break
                    element = page.parents[element]
            for about, (out, own) in zip(page.about, sums, strict=True):
                if out or own:
                    (held if own > out else other).update(about)
        if not last:
            cues = {f: math.log((held[f] + 0.5) / (other[f] + 0.5)) for f in {*held, *other}}
    kinds = {*inside, *outside, "word", "link", "item", "aside", "open", "/", "inline", "heading", "br", "p", "li", "a"} - {"space"}
    total_in, total_out = sum(inside.values()), sum(outside.values())
    weights = {k: math.log((inside[k] + 1) / (total_in + len(kinds)) * (total_out + len(kinds)) / (outside[k] + 1)) for k in kinds}
    words = {"word", "item", "link"}
    top = max(weights["word"], 0.1)
    return {"space": 0.0} | {k: w / top if k in words else min(w / top, 0.0) - 0.25 for k, w in weights.items()}, cues


WEIGHTS, CUES = learn(LABELLED)


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last token of the run with the highest sum, the first and longest of equals;
    (0, -1) if no sum is positive."""
    return best_sum(scores)[1:]


def best_sum(scores: list[float]) -> tuple[float, int, int]:
    """The highest sum, 0 if none is positive, and its run as in ``best_run``."""
    best, found, total, start = 0.0, (0, -1), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i)
    return best, *found


WORDS = frozenset(("word", "link", "item"))


def grown(page: Page, frame: list[int], scores: list[float], first: int, last: int) -> tuple[int, int]:
    """The run and the blocks at its ends whose words sum above zero, within the element that holds it;
    a run that has come to both ends of its element goes on in the element around."""
    holder = page.holder(frame[first : last + 1])
    # Each way: how far the run goes, how far has been read, and the sum of the block being read.
    ends, read, total, shut = [first, last], [first, last], [0.0, 0.0], [False, False]
    while page.tags[holder] not in PAGE:
        for side, step in ((0, -1), (1, 1)):
            i = read[side] + step
            while not shut[side] and 0 <= i < len(frame) and holder <= page.elements[frame[i]] <= page.last[holder]:
                kind = page.kinds[frame[i]]
                if kind in WORDS:
                    total[side] += scores[i]
                elif kind == "aside" or page.pieces[frame[i]] == " " and kind != "space":
                    shut[side] = total[side] < 0
                    if total[side] > 0:
                        ends[side] = i - step
                    total[side] = 0.0
                read[side] = i
                i += step
            if total[side] > 0:
                ends[side] = read[side]
        if any(shut):
            break
        holder = page.parents[holder]
    return ends[0], ends[1]


def main_text(source: str | None, weights: dict[str, float] | None = None, cues: dict[str, float] | None = None) -> str:
    """The text of the best run; empty if the page is null or no run scores above zero."""
    if not source:
        return ""
    weights = WEIGHTS if weights is None else weights
    page = Page(source, CUES if cues is None else cues)
    most, found = 0.0, None
    for k, frame in enumerate(page.frames):
        scores = [weights.get(page.kinds[i], -0.25) * (page.words[i] or 1) for i in frame]
        best, first, last = best_sum(scores)
        best *= page.factors[k]
        if best > most and (not k or best >= LEAST_IN_FRAME):
            most, found = best, (frame, scores, first, last)
    if found is None:
        return ""
    first, last = grown(page, *found)
    return " ".join("".join(page.pieces[i] for i in found[0][first : last + 1]).split())


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), source: str = "html") -> DataFrame:
    """The columns ``keep``, ``text`` and ``n_chars`` of each row. Null, empty and textless pages
    have an empty text; repeated rows are read each; other columns are not read."""
    rows = pages.select(*[F.col(c) for c in keep], F.col(source).alias("__html"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["text string", "n_chars long"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                texts = [main_text(h) for h in part["__html"]]
                yield part.drop(columns="__html").assign(text=texts, n_chars=[len(t) for t in texts])

    return rows.mapInPandas(run, ", ".join(fields))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
