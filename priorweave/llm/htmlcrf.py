"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A block is the text between two block-level tags. Its features are the tags and the class, id and role words of its ancestors, its
own tag, length, share of link text, ending and symbols. The field scores the labels (text, clutter) of a page's blocks together,
with a weight for each pair of neighbouring labels; Viterbi picks the best sequence.

Labelled pages are a bounded sample of those that mark their article (article, main, role=main or itemprop=articleBody). Each is
also learned with that mark replaced and with clutter of known kinds set into and around it, so that the field does not hang on one tag.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import arrow_batches

SAMPLE_PAGES = 300
BUCKETS = 1 << 16
#: A block's features look at so many ancestors, the nearest ones.
ABOVE = 32

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^a-zA-Z>][^>]*>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)>", re.S)
#: The same where a quote of an earlier tag never ended: any > ends a tag.
OPEN_QUOTES = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^a-zA-Z>][^>]*>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe textarea select object canvas math".split())
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    **{t: {"p"} for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split()},
}
SCOPE = frozenset("html body div article section main aside nav header footer form table td th ul ol dl blockquote fieldset figure".split())
WORD = re.compile(r"[a-z]+|\d+")


class Block:
    __slots__ = ("text", "tag", "above", "link", "label")

    def __init__(self, text, tag, above, link, label):
        self.text, self.tag, self.above, self.link, self.label = text, tag, above, link, label


def blocks(page: str, mark: str | None = None) -> list[Block]:
    """The leaf blocks of a page in order; text of scripts, styles, comments and the like is in none.

    mark: the attribute that gives a label, 0 or 1, to learn from; without one every label is 0, whatever attributes a page has. The
    time is linear in the page: names that are open are counted for each scope, and a tag whose quotes never end ends at its next >.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int]] = []  # block-level tag, feature words, label
    scopes: list[Counter] = [Counter()]  # names open since each tag of SCOPE, itself included
    opened: Counter = Counter()
    anchors: list[int] = []  # depth at which each open link began
    parts: list[str] = []
    size = linked = 0

    def flush():
        nonlocal linked, size
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                tag, _, label = stack[-1] if stack else ("", (), 0)
                above = tuple(dict.fromkeys(w for s in stack[-ABOVE:] for w in s[1]))
                out.append(Block(text, tag, above, linked / max(1, size), label))
            parts.clear()
        size = linked = 0

    def add(text):
        nonlocal linked, size
        if "&" in text:
            text = entities.unescape(text)
        parts.append(text)
        size += len(text)
        if anchors:
            linked += len(text)

    def push(name, words, label):
        if name in SCOPE:
            scopes.append(Counter())
        opened[name] += 1
        scopes[-1][name] += 1
        stack.append((name, words, label))

    def close(name):
        """Takes the innermost tag of that name and all within off the stack."""
        while stack:
            top = stack.pop()[0]
            opened[top] -= 1
            scopes[-1][top] -= 1
            if top in SCOPE:
                scopes.pop()
            if top == name:
                break
        while anchors and anchors[-1] > len(stack):
            anchors.pop()

    n, at, last, tags = len(page), 0, page.rfind(">"), TAG
    while at < n:
        begin = page.find("<", at)
        if begin < 0 or begin > last and not page.startswith(("<!--", "<![CDATA["), begin):
            add(page[at:])
            break
        m = tags.match(page, begin)
        if m is None and tags is TAG and page[begin + 1 : begin + 3].strip("/ ")[:1].isalpha():
            tags = OPEN_QUOTES
            m = tags.match(page, begin)
        if m is None:
            add(page[at : begin + 1])
            at = begin + 1
            continue
        if begin > at:
            add(page[at:begin])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                if anchors:
                    anchors.pop()
            elif name not in INLINE:
                if opened[name]:
                    flush()
                    close(name)
                elif name == "p":
                    flush()
            continue
        if name == "br":
            parts.append(" ")
            size += 1
            continue
        if name in RAW:
            flush()
            if not m[3].endswith("/"):
                end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name in INLINE:
            if name == "a":
                anchors.append(len(stack))
            continue
        flush()
        ends = CLOSES.get(name, ())
        if name == "p":
            if stack and stack[-1][0] == "p":
                close("p")
        elif any(scopes[-1][x] for x in ends):
            while (top := stack[-1][0]) not in ends:
                close(top)
            close(top)
        if name in VOID:
            continue
        words, own = [f"<{name}"], stack[-1][2] if stack else 0
        if m[3]:
            for a in ATTRIBUTE.finditer(m[3]):
                key = a[1].lower()
                value = a[2] or a[3] or a[4] or ""
                if key in ("class", "id", "role", "itemprop"):
                    words += [f".{w}" for w in WORD.findall(value.lower())]
                elif key == mark:
                    own = int(value == "1")
        push(name, tuple(words), own)
    flush()
    return out


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) & (BUCKETS - 1)


def _step(n: int) -> int:
    return n.bit_length()


class Features:
    """Feature numbers of blocks; those of an ancestor path are computed once."""

    def __init__(self):
        self.paths: dict[tuple, list[int]] = {}

    def of(self, page: list[Block]) -> list[list[int]]:
        out = []
        for i, b in enumerate(page):
            key = (b.tag, b.above)
            known = self.paths.get(key)
            if known is None:
                if len(self.paths) > 50_000:
                    self.paths.clear()
                known = self.paths[key] = [_bucket("bias"), _bucket(f"tag {b.tag}"), *(_bucket(f"in {w}") for w in b.above)]
            words = b.text.count(" ") + 1
            more = [f"words {min(_step(words), 8)}", f"link {int(b.link * 4)}", f"tag {b.tag} words {min(_step(words), 5)}", f"end {b.text[-1] if b.text[-1] in '.!?:|' else '-'}"]
            if "©" in b.text:
                more.append("copyright")
            if i == 0:
                more.append("first")
            if i == len(page) - 1:
                more.append("last")
            out.append(known + [_bucket(x) for x in more])
        return out


class Field:
    """Weights: for each feature and label, and for each pair of labels."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.zero, self.one = weights[:, 0].tolist(), weights[:, 1].tolist()
        self.pairs = pairs.tolist()
        self.features = Features()

    def decode(self, page: list[Block]) -> list[int]:
        """The best label sequence (Viterbi)."""
        if not page:
            return []
        zero, one, ((p00, p01), (p10, p11)) = self.zero, self.one, self.pairs
        a = b = 0.0
        back = []
        for i, own in enumerate(self.features.of(page)):
            x, y = sum([zero[f] for f in own]), sum([one[f] for f in own])
            if i == 0:
                a, b = x, y
                continue
            back.append((a + p00 < b + p10, a + p01 < b + p11))
            a, b = max(a + p00, b + p10) + x, max(a + p01, b + p11) + y
        label = int(b > a)
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return labels[::-1]

    def text(self, page: str) -> str:
        found = blocks(page)
        return "\n".join(b.text for b, y in zip(found, self.decode(found)) if y)


def fit(pages: list[tuple[list[list[int]], list[int]]], steps: int = 120, penalty: float = 1e-3) -> Field:
    """Weights that maximise the likelihood of the labels, by gradients from the forward-backward recursion over all pages at once."""
    pages = [p for p in pages if p[1]]
    w, pairs = np.zeros((BUCKETS, 2)), np.zeros((2, 2))
    if not pages:
        return Field(w, pairs)
    n, t = len(pages), max(len(y) for _, y in pages)
    mask, y = np.zeros((n, t), bool), np.zeros((n, t), int)
    flat_f, flat_p = [], []
    for i, (x, labels) in enumerate(pages):
        mask[i, : len(labels)], y[i, : len(labels)] = True, labels
        for j, own in enumerate(x):
            flat_f += own
            flat_p += [i * t + j] * len(own)
    used, f = np.unique(np.array(flat_f), return_inverse=True)
    place = np.array(flat_p)
    theta = np.zeros(2 * len(used) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    gold = np.stack([mask & (y == 0), mask & (y == 1)], 2).astype(float)
    both = mask[:, 1:] & mask[:, :-1]
    gold_pairs = np.array([[(both & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    for step in range(1, steps + 1):
        u, pairs = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        e = np.stack([np.bincount(place, weights=u[f, k], minlength=n * t).reshape(n, t) for k in (0, 1)], 2)
        forward, backward = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        forward[:, 0] = e[:, 0]
        for j in range(1, t):
            new = e[:, j] + np.logaddexp(forward[:, j - 1, :1] + pairs[0], forward[:, j - 1, 1:] + pairs[1])
            forward[:, j] = np.where(mask[:, j, None], new, forward[:, j - 1])
        for j in range(t - 2, -1, -1):
            z = e[:, j + 1] + backward[:, j + 1]
            new = np.logaddexp(pairs[:, 0] + z[:, :1], pairs[:, 1] + z[:, 1:])
            backward[:, j] = np.where(mask[:, j + 1, None], new, 0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        belief = np.exp(np.clip(forward + backward - total[:, None, None], -60, 0)) * mask[:, :, None]
        pull = (belief - gold).reshape(n * t, 2)
        z = forward[:, :-1, :, None] + pairs + (e + backward)[:, 1:, None, :] - total[:, None, None, None]
        pair_belief = (np.exp(np.clip(z, -60, 0)) * both[:, :, None, None]).sum(axis=(0, 1))
        grad = np.concatenate([np.stack([np.bincount(f, weights=pull[place, k], minlength=len(used)) for k in (0, 1)], 1).ravel(), (pair_belief - gold_pairs).ravel()]) / n
        grad += penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w[used] = theta[:-4].reshape(-1, 2)
    return Field(w, theta[-4:].reshape(2, 2))


MARKED = re.compile(r"<(article|main)\b([^>]*)>|<(\w+)\b([^>]*\b(?:role=[\"']?main|itemprop=[\"']?articleBody)\b[^>]*)>", re.I)
#: Kinds of clutter that learning sets into pages; {w} is one of the words that pages name them by.
CLUTTER = {
    "sidebar widget aside rail": ['<aside class="{w}"><h3>{a}</h3><ul><li><a href="#">{b}</a></li><li><a href="#">{c}</a></li></ul></aside>', '<div class="{w}"><h4>{a}</h4><p>{b}</p></div>', '<div id="{w}"><p>{b}</p></div>', '<td class="{w}"><p>{b}</p></td>'],
    "cookie-notice notice banner consent newsletter-popup alert": ['<div class="{w}"><p>{b}</p><button>{a}</button></div>', '<div class="{w}" role="alert">{b}</div>', '<div id="{w}"><p>{b}</p></div>', "<dialog><p>{b}</p></dialog>"],
    "search login signup subscribe": ['<form class="{w}" action="/s"><label>{a}</label><input name="q"><button>{a}</button></form>', "<form><p>{b}</p><label>{a}</label></form>"],
    "comments discussion replies responses reactions comment-list talkback": [
        '<section class="{w}"><h2>{a}</h2><div class="comment"><p>{b}</p></div><div class="comment"><p>{c}</p></div></section>', '<section id="{w}"><h3>{a}</h3><p>{b}</p><p>{c}</p></section>', '<div id="{w}"><ol><li class="comment"><p>{b}</p></li></ol></div>',
        '<div class="{w}"><h3>{a}</h3><p>{b}</p></div>', '<div class="{w}"><div class="reply"><b>{a}</b> <p>{c}</p></div></div>', '<ul class="{w}"><li>{b}</li><li>{c}</li></ul>', '<table class="{w}"><tr><td>{a}</td><td>{b}</td></tr></table>',
    ],
    "ad advert ads sponsored promo": ['<div class="{w}">{b}</div>', '<div class="{w}"><p>{b}</p></div>', '<div class="{w}"><a href="#">{a}</a></div>'],
    "related share social breadcrumb menu nav": ['<div class="{w}"><h3>{a}</h3><ul><li><a href="#">{b}</a></li></ul></div>', '<nav class="{w}"><a href="#">{a}</a><a href="#">{c}</a></nav>', '<div class="{w}"><ul><li><a href="#">{a}</a></li></ul></div>', '<menu><li><a href="#">{a}</a></li></menu>', '<tr><td><a href="#">{a}</a> | <a href="#">{c}</a></td></tr>'],
    "header masthead": ["<header><h2>{a}</h2><p>{b}</p></header>", '<div class="{w}"><p>{b}</p></div>'],
    "footer copyright legal": ["<p>&copy; {a}</p>", "<div>&copy; {a}</div>", "<tr><td>&copy; {a}</td></tr>", "<footer><p>{b}</p></footer>", '<div class="{w}"><p>&copy; {b}</p></div>', '<tr><td class="{w}">&copy; {b}</td></tr>'],
}
#: What articles have beside headings and paragraphs.
PARTS = ["<table><tr><th>{a}</th><td>{b}</td></tr><tr><td>{a}</td><td>{c}</td></tr></table>", "<table><tr><td>{a}</td><td>{b}</td></tr></table>", "<ul><li>{b}</li><li>{c}</li></ul>", "<ol><li>{a}</li><li>{b}</li></ol>", "<blockquote><p>{b}</p></blockquote>", "<figure><figcaption>{b}</figcaption></figure>", "<h2>{a}</h2><p>{b}</p>", "<dl><dt>{a}</dt><dd>{b}</dd></dl>", "<pre>{b}</pre>", "<section><h3>{a}</h3><p>{c}</p></section>"]
#: Wrappers of the article, with what closes them.
CONTENT = [("<body", "</body>"), ("<body", "</body>"), ('<div class="content"', "</div>"), ('<div class="post-content"', "</div>"), ('<div id="main"', "</div>"), ("<main", "</main>"), ('<div class="entry"', "</div>"), ('<section class="article-body"', "</section>"), ("<div", "</div>"), ('<div class="story text"', "</div>"), ('<table><tr><td class="text"', "</td></tr></table>"), ('<table width="100%"><tr><td', "</td></tr></table>"), ('<table><tr><td><a href="#">Home</a></td><td', "</td></tr></table>"), ('<center><table><tr><td valign="top"', "</td></tr></table></center>"), ('<table><tr><td><a href="#">Home</a> | <a href="#">Contact</a></td></tr><tr><td', "</td></tr><tr><td>&copy; 2019 All rights reserved</td></tr></table>"), ('<table><tr><td><a href="#">Start</a></td></tr><tr><td', "</td></tr><tr><td>&copy; A paper</td></tr></table>")]


def labelled(page: str, others: list[str], rng: random.Random, vary: bool, mark: str) -> str | None:
    """The page with its article marked by an attribute of that name, varied if asked; None if it marks none.

    Varied, it may have another wrapper, a table's cell among them, or lose all around the article, and clutter stands in and around it.
    """
    m = MARKED.search(page)
    if m is None:
        return None
    tag = m[1] or m[3]
    closing = page.lower().rfind(f"</{tag.lower()}")
    before, inside, after = page[: m.start()], page[m.end() : closing if closing > m.end() else len(page)], page[closing:] if closing > m.end() else ""
    after = after.partition(">")[2]
    opening, ending = f'<{tag}{m[2] or m[4] or ""} {mark}="1">', f"</{tag}>"
    if not vary:
        return f"{before}{opening}{inside}{ending}{after}"

    def piece(clutter: bool = True) -> str:
        names = rng.choice([n for n in CLUTTER for _ in range(1 + 2 * n.startswith("comments"))])  # the kind most like an article
        a, b, c = (rng.choice(others) for _ in range(3))
        kind = rng.choice(CLUTTER[names] if clutter else PARTS)
        words = kind.format(w=rng.choice(names.split()), a=entities.escape(" ".join(a.split()[: rng.randint(1, 4)])), b=entities.escape(b), c=entities.escape(c))
        return words.replace(">", f' {mark}="0">', 1) if clutter else words

    if rng.random() < 0.7:
        opening, ending = rng.choice(CONTENT)
        opening += f' {mark}="1">'
    if rng.random() < 0.15:
        before = after = ""
    places = [x.end() for x in re.finditer(r"</p>", inside)] or [len(inside)]
    if rng.random() < 0.1:  # a paragraph or two, and no more
        return f'<html><body {mark}="1">' + "".join(f"<p>{entities.escape(rng.choice(others))}</p>" for _ in range(rng.randint(1, 2))) + "</body></html>"
    for at in sorted(rng.sample(places, min(len(places), rng.randint(0, 2))), reverse=True):
        inside = inside[:at] + piece(rng.random() < 0.6) + inside[at:]
    return before + "".join(piece() for _ in range(rng.randint(0, 2))) + f"{opening}{inside}{ending}" + "".join(piece() for _ in range(rng.randint(0, 3))) + after


#: A page to learn from where the table has no labelled one.
PLAIN = '<html><head><title>A page</title></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>A page</h1><p>It has a first paragraph of some length, with words.</p><p>Then a second one.</p></article><footer>&copy; All rights reserved</footer></body></html>'


def train(pages: list[str], variants: int = 6, seed: int = 0) -> Field:
    rng = random.Random(seed)
    found = [p for p in pages if MARKED.search(p or "")] or [PLAIN]
    others = [b.text for p in found[:50] for b in blocks(p)] or ["text"]
    features, data = Features(), []
    mark = f"mark-{rng.getrandbits(64):x}"  # no attribute of a page
    for page in found:
        for k in range(1 + variants):
            own = blocks(labelled(page, others, rng, k > 0, mark), mark)
            data.append((features.of(own), [b.label for b in own]))
    return fit(data)


def learn(pages: DataFrame, html_col: str = "html", url_col: str = "url", sample: int = SAMPLE_PAGES) -> Field:
    """A field from at most `sample` pages that mark their article, those of the smallest hashes."""
    marks = "(?i)<(article|main)\\b|role=[\"']?main|itemprop=[\"']?articleBody"
    marked = pages.select(F.col(html_col).cast("string").alias("html"), F.xxhash64(html_col).alias("h")).filter(F.col("html").rlike(marks))
    # only hashes are ranked; the pages that come to the driver are those of the chosen hashes, one for each
    chosen = [r["h"] for r in marked.select("h").distinct().orderBy("h").limit(sample).collect()]
    if not chosen:
        return train([])
    found = marked.filter(F.col("h") <= chosen[-1]).groupBy("h").agg(F.first("html").alias("html"))
    return train([r["html"] for r in sorted(found.collect(), key=lambda r: r["h"])])


def extract(pages: DataFrame, field: Field, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each row; a null or empty html gives an empty text. Repeated rows give repeated results."""
    arrow_batches(pages.sparkSession, 256)
    shared = pages.sparkSession.sparkContext.broadcast(field)  # BUCKETS weights for each label

    def run(batches):
        for batch in batches:
            texts = [shared.value.text(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, learn(pages))
