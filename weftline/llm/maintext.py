"""The main body of web pages, as line numbers of the delivered text.

Composite text density: for every node of the page's tree the characters per tag are adjusted by its share of
link text (:func:`_densities`); the densities of a node's children are summed, and the node with the largest sum
holds the main content. The body-path threshold is not applied to its parts: headlines, table rows and short
paragraphs lie below it (README has figures). Two things are added because short articles stand beside long comments:
a node that holds the page's own headline (the text of ``<title>``) is preferred, and blocks that announce themselves as
notices, sharing, comments, teasers, advertisements or legal lines (:data:`PHRASES`) are left out.

Text that was taken from a page before (no tags) has no tree: its lines are read in order by the same
announcements (:func:`text_lines`).

Lines that a host repeats on many different pages are no main content of any of them; they are counted over
the whole corpus by :func:`repeated_lines` and taken out by :func:`main_lines`.

Defined results: null and empty bodies, JSON, and responses with a status of 400 and more, 204 or 304 have no
lines; cut bodies and unclosed tags are read as far as they go; pages without a host only skip the step that
counts repeated lines; a table without rows gives none.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line belongs to the host, not to the page, if it stands on at least this share of the host's pages ...
HOST_SHARE = 0.3
#: ... and on at least this many different addresses.
HOST_PAGES = 3
#: Characters from which on a line is counted; shorter ones, such as rows of a table, recur by chance.
HOST_LINE = 30

# Announcements of page furniture in ten languages, lower case, by kind.
PHRASES = {
    "cookie": ("we use cookies", "this site uses cookies", "accept all", "wir verwenden cookies", "diese seite verwendet cookies", "alle annehmen", "alle akzeptieren", "nous utilisons des cookies", "tout accepter", "usamos cookies", "utilizamos cookies", "aceptar todo", "aceitar tudo", "aceitar todos", "utilizziamo i cookie", "usiamo i cookie", "accetta tutto", "accetta tutti", "wij gebruiken cookies", "alles accepteren", "vi använder cookies", "vi använder kakor", "acceptera alla", "мы используем файлы cookie", "мы используем cookie", "принять все", "我们使用cookie", "全部接受", "接受所有"),
    "skip": ("skip to content", "skip to main", "zum inhalt springen", "aller au contenu", "ir al contenido", "saltar al contenido", "ir para o conteúdo", "saltar para o conteúdo", "vai al contenuto", "salta al contenuto", "naar de inhoud", "ga naar inhoud", "hoppa till innehåll", "till innehållet", "перейти к содержанию", "跳到内容", "跳至内容"),
    "share": ("share this page", "share this", "seite teilen", "diese seite teilen", "partager", "compartir", "partilhar", "compartilhar", "condividi", "deel deze pagina", "dela sidan", "dela den här sidan", "поделиться", "分享本页", "分享此页"),
    "comments": ("leave a comment", "post a comment", "comments", "kommentar schreiben", "kommentare", "laisser un commentaire", "commentaires", "dejar un comentario", "comentarios", "deixar um comentário", "deixe um comentário", "comentários", "lascia un commento", "commenti", "laat een reactie achter", "reageer", "reacties", "lämna en kommentar", "kommentera", "kommentarer", "оставить комментарий", "комментарии", "发表评论", "评论"),
    "related": ("you may also like", "related articles", "read next", "das könnte sie auch interessieren", "mehr zum thema", "à lire aussi", "lire aussi", "vous aimerez aussi", "también le puede gustar", "también te puede gustar", "artículos relacionados", "também pode gostar", "leia também", "potrebbe interessarti anche", "potrebbe piacerti anche", "leggi anche", "misschien vindt u dit ook leuk", "lees ook", "du kanske också gillar", "läs också", "вам может понравиться", "читайте также", "您可能还喜欢", "你可能还喜欢", "猜你喜欢", "相关文章"),
    "advert": ("advertisement", "sponsored", "anzeige", "werbung", "publicité", "publicidad", "publicidade", "pubblicità", "advertentie", "annons", "реклама", "广告"),
    "letter": ("sign up for our", "subscribe to our", "weekly letter", "newsletter", "wochenbrief", "rundbrief", "abonnieren sie", "recevez notre lettre", "abonnez-vous", "reciba nuestra carta", "suscríbase", "suscríbete", "receba a nossa carta", "subscreva", "assine a nossa", "ricevi la nostra lettera", "ricevete la nostra lettera", "iscriviti", "ontvang onze", "schrijf u in voor", "abonneer", "få vårt", "prenumerera", "получайте наше письмо", "подпишитесь", "подписаться", "订阅我们", "订阅"),
    "legal": ("all rights reserved", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados", "todos os direitos reservados", "tutti i diritti riservati", "alle rechten voorbehouden", "alla rättigheter förbehållna", "все права защищены", "版权所有", "保留所有权利"),
    "login": ("please log in", "log in to read", "sign in to continue", "bitte anmelden", "bitte melden sie sich an", "connectez-vous pour", "veuillez vous connecter", "inicie sesión para", "entre para seguir", "entre para continuar", "inicie sessão para", "accedi per", "log in om verder", "logga in för att", "войдите, чтобы", "请登录", "登录后"),
    "missing": ("page not found", "seite nicht gefunden", "page introuvable", "página no encontrada", "página não encontrada", "pagina non trovata", "pagina niet gevonden", "sidan hittades inte", "страница не найдена", "找不到页面", "页面不存在"),
}
# Ends of teasers.
MORE = ("read more", "weiterlesen", "lire la suite", "leer más", "ler mais", "leia mais", "leggi tutto", "lees meer", "lees verder", "läs mer", "читать далее", "阅读更多", "阅读全文")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "template", "noscript", "svg", "iframe", "select", "textarea"))
OUTER = frozenset(("nav", "aside", "footer", "form", "button", "head", "title", "dialog"))
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time tt u var ins del label big".split())
_P_ENDS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li td tr".split())
_NAMES = re.compile(r"(?:^|[\s_-])(?:notice|cookie|consent|share|social|comments?|related|promo|advert\w*|ads?|banner|newsletter|subscri\w*|login|breadcrumbs?|crumbs|sidebar|teasers?|foot|footer|bottom|menu|topnav|nav|navbar|navigation|byline|links)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(?P<raw>script|style|template|noscript|svg|iframe|textarea)\b[^>]*>.*?(?:</(?P=raw)\s*>|$)|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<[!?][^>]*(?:>|$)", re.S | re.I)
_CLASS = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDY = re.compile(r"\w")
_SPACE = re.compile(r"\s+")
_BYLINE = re.compile(r"^[^.!?。！？]{1,60}\s[·|•–-]\s*(?:\d{1,4}[./-]\d{1,2}[./-]\d{1,4}|[^·]{0,20}\d{4}).{0,40}$")
_COMMENTER = re.compile(r"^\S+(?: \S+){0,2}, \d{1,2}:\d{2}$")
_CRUMB = re.compile(r"^[^.!?。！？]{1,40}(?:\s[/›»>|→]\s[^.!?。！？]{1,60})+$")
_MENU = re.compile(r"^[^.!?。！？\t]{1,30}(?: {2,}[^.!?。！？\t ]{1,20}(?: [^.!?。！？\t ]{1,20}){0,3}){2,}$")
_ENDS = re.compile(r"[.!?。！？…][\"'”»)\]]*$")


_ANYWHERE = tuple((p, kind) for kind in ("legal", "letter") for p in PHRASES[kind])
_AT_START: dict[str, list[tuple[str, str]]] = {}
for _kind, _phrases in PHRASES.items():
    for _p in _phrases if _kind not in ("legal", "letter") else ():
        _AT_START.setdefault(_p[:2], []).append((_p, _kind))
_OPEN = frozenset(("cookie", "skip", "share", "related", "login", "missing"))  # announcements that go on after the phrase


def kind_of(text: str) -> str | None:
    """What furniture a stretch of text announces itself as, if any."""
    low = text.lower().strip()
    if not low:
        return None
    if low[0] == "©":
        return "legal"
    n = len(low)
    if n < 160 and _BYLINE.match(text):
        return "byline"
    for p, kind in _ANYWHERE:
        if p in low:
            return kind
    for p, kind in _AT_START.get(low[:2], ()):
        if low.startswith(p) and (kind in _OPEN or n <= len(p) + 3):
            return kind
    if low.endswith(("…", "...")) and n < 140 or low.rstrip(" .").endswith(MORE):
        return "teaser"
    if n < 200:
        if _COMMENTER.match(text):
            return "commenter"
        if _CRUMB.match(text) or _MENU.match(text):
            return "crumb"
    return None


class _Tree:
    """Nodes of a page in document order, as parallel lists; ``texts`` are (node, first line, text)."""

    def __init__(self, body: str) -> None:
        self.tag, self.parent, self.attrs = ["#"], [-1], [""]
        self.texts: list[tuple[int, int, str]] = []
        self.title = ""
        stack, at, line, in_title = [0], 0, 1, False
        for m in _TOKEN.finditer(body):
            if m.start() > at:
                chunk = body[at : m.start()]
                if in_title:
                    self.title += chunk
                elif not chunk.isspace():
                    self.texts.append((stack[-1], line, chunk))
                line += chunk.count("\n")
            at = m.end()
            line += body.count("\n", m.start(), at)
            tag = (m.group("tag") or "").lower()
            if not tag:
                continue
            if m.group("end"):
                in_title = in_title and tag != "title"
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        del stack[k:]
                        break
                    if tag in INLINE and self.tag[stack[k]] not in INLINE:
                        break
                continue
            if tag == "title":
                in_title = not self.title
                continue
            if tag in VOID or m.group("attrs").endswith("/"):
                continue
            if tag in _P_ENDS:
                while len(stack) > 1 and self.tag[stack[-1]] in INLINE | {"p"}:
                    stack.pop()
                if tag == "li" and self.tag[stack[-1]] == "li" or tag in ("td", "th") and self.tag[stack[-1]] in ("td", "th"):
                    stack.pop()
                elif tag == "tr" and self.tag[stack[-1]] in ("td", "th", "tr"):
                    while self.tag[stack[-1]] in ("td", "th", "tr"):
                        stack.pop()
            if tag == "main":  # whatever was left open before ends here
                while len(stack) > 1 and self.tag[stack[-1]] not in ("html", "body"):
                    stack.pop()
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.attrs.append(m.group("attrs"))
            stack.append(len(self.tag) - 1)
        if at < len(body) and not body[at:].isspace():
            self.texts.append((stack[-1], line, body[at:]))


def _densities(tree: _Tree) -> tuple[list[float], list[float], list[int]]:
    """Composite text density of every node, the sum of its children's, and its characters."""
    n = len(tree.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for node, _, text in tree.texts:
        chars[node] += len(_SPACE.sub("", text))
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = tree.parent[i]
        if tree.tag[i] == "a":
            link_chars[i], link_tags[i] = chars[i], link_tags[i] + 1
        chars[p] += chars[i]
        tags[p] += tags[i] + 1
        link_chars[p] += link_chars[i]
        link_tags[p] += link_tags[i]
    whole, linked = max(1, chars[0]), link_chars[0]
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        c, t = chars[i], max(1, tags[i])
        if c:
            lc, lt = max(1, link_chars[i]), max(1, link_tags[i])
            base = math.log(c / max(1, c - link_chars[i]) * link_chars[i] + linked / whole * c + math.e)
            density[i] = c / t * math.log(max(1.0, (c / lc) * (t / lt)) + 1e-9 + (0.0 if link_chars[i] < c else -0.999)) / max(1e-6, math.log(max(base, 1.01))) if base > 0 else 0.0
            density[i] = max(0.0, density[i])
    for i in range(1, n):
        total[tree.parent[i]] += density[i]
    return density, total, chars


def _plain(text: str) -> str:
    return _SPACE.sub(" ", unescape(text)).strip()


def _block(tree: _Tree, node: int) -> int:
    while tree.tag[node] in INLINE and tree.parent[node] > 0:
        node = tree.parent[node]
    return node


def page_lines(body: str) -> list[int]:
    """Numbers of the lines of an HTML page that hold its main content."""
    tree = _Tree(body)
    n = len(tree.tag)
    flagged, outer = [False] * n, [False] * n  # furniture by its own tag or name; below such a node
    for i in range(1, n):
        name = " ".join(x for m in _CLASS.finditer(tree.attrs[i]) for x in m.groups() if x) if "class" in tree.attrs[i] or "id" in tree.attrs[i] else ""
        flagged[i] = tree.tag[i] in OUTER or bool(name and tree.tag[i] not in ("body", "html") and _NAMES.search(name))
        outer[i] = flagged[i] or outer[tree.parent[i]]
    density, total, chars = _densities(tree)
    # blocks: consecutive text under one block node
    blocks: list[list] = []
    for node, line, text in tree.texts:
        b = _block(tree, node)
        if blocks and blocks[-1][0] == b:
            blocks[-1][1].append((line, text, node))
        else:
            blocks.append([b, [(line, text, node)]])
    said = [_plain("".join(t for _, t, _ in parts)) for _, parts in blocks]
    title = _plain(tree.title)
    head = None
    if title:
        names = {title, *(title.rsplit(sep, 1)[0].strip() for sep in (" - ", " | ", " – ", " — ", " · ") if sep in title)}
        named = [k for k, x in enumerate(said) if x in names]
        head = max(named, key=lambda k: (not outer[blocks[k][0]], tree.tag[blocks[k][0]] in ("h1", "h2", "h3"), -k), default=None)
    body_nodes = {i for i in range(n) if tree.tag[i] in ("#", "html", "body")}
    if head is not None:
        own = tree.parent[blocks[head][0]]
        path, x = [], own
        while x > 0 and x not in body_nodes and not flagged[x]:  # a named part that was never closed ends the path
            if path and chars[path[-1]] > len(said[head]) + 30 and _text_before(tree, blocks, said, x, head):
                break  # so does a part that holds other text before the page's headline
            path.append(x)
            x = tree.parent[x]
        main = max(path, key=lambda i: total[i], default=own)
    else:
        free = [i for i in range(1, n) if not outer[i] and i not in body_nodes and tree.tag[i] not in INLINE]
        main = max(free, key=lambda i: total[i], default=0)
        if not free or not total[main]:  # no node with children that hold text
            main = max((i for i in free if tree.tag[i] in ("main", "article", "section", "div", "td")), key=lambda i: density[i], default=0)
    inside = [False] * n
    for i in range(n):
        inside[i] = i == main or tree.parent[i] >= 0 and inside[tree.parent[i]]
    kinds = [kind_of(x) if inside[b] or head is None else None for x, (b, _) in zip(said, blocks)]
    if head is None and any(kind in ("missing", "login") and len(x) < 80 for kind, x in zip(kinds, said)):
        return []
    dropped: set[int] = set()  # blocks whose container announces itself as furniture
    for k, (b, _) in enumerate(blocks):
        if inside[b] and kinds[k] in ("cookie", "comments", "related", "share", "login", "advert", "skip"):
            box = tree.parent[b]
            if box != main and inside[box]:
                dropped.add(box)
    found: set[int] = set()
    related = False
    for k, (b, parts) in enumerate(blocks):
        if not inside[b]:
            continue
        x, skip = b, False
        while x != main and x > 0:
            if x in dropped or flagged[x]:
                skip = True
                break
            x = tree.parent[x]
        if skip:
            continue
        if head is None or k >= head:
            if kinds[k] in ("missing", "login") and len(said[k]) < 80 and (head is None or k == head):
                return []
        if kinds[k] == "comments":
            break
        if kinds[k] == "related":
            related = len(said[k]) < 60 and ":" not in said[k]
            continue
        if kinds[k] or head is not None and k < head and main in body_nodes:
            continue
        linked = sum(len(t.strip()) for _, t, node in parts if _in_link(tree, node))
        if linked >= 0.8 * len(said[k]) and tree.tag[b] not in ("h1", "h2", "h3"):
            continue
        if related and not _ENDS.search(said[k]):
            continue
        related = False
        for line, text, _ in parts:
            for j, piece in enumerate(text.split("\n")):
                if _WORDY.search(piece):
                    found.add(line + j)
    return sorted(found)


def _text_before(tree: _Tree, blocks: list[list], said: list[str], node: int, head: int) -> bool:
    """Whether running text or furniture of ``node`` comes before block ``head``."""
    for k in range(head - 1, -1, -1):
        x = blocks[k][0]
        if x < node:
            return False
        while x > node:
            x = tree.parent[x]
        if x == node and kind_of(said[k]) not in ("crumb", "byline"):
            return True
    return False


def _in_link(tree: _Tree, node: int) -> bool:
    while node > 0 and tree.tag[node] in INLINE:
        if tree.tag[node] == "a":
            return True
        node = tree.parent[node]
    return False


def text_lines(body: str) -> list[int]:
    """The same for text that was taken from a page: its lines are the blocks."""
    lines = [x.strip("\r") for x in body.split("\n")]
    kinds = [kind_of(x.strip()) for x in lines]
    found: list[int] = []
    started, related, last_head = False, False, None
    for k, raw in enumerate(lines):
        text, kind = raw.strip(), kinds[k]
        if not text:
            continue
        if kind in ("missing", "login") and not started:
            return []
        if kind in ("comments", "share") or kind == "legal":
            if started or kind == "comments":
                break
            continue
        if kind == "related":
            if ":" not in text and started and last_head is not None:
                break
            related = ":" not in text
            if not started:
                last_head = None
            continue
        if kind == "byline":
            continue
        if kind:
            last_head = None if kind == "teaser" and not started else last_head
            continue
        row, sentence = "\t" in text, bool(_ENDS.search(text))
        if not started:
            nxt = next((j for j in range(k + 1, len(lines)) if lines[j].strip()), None)
            if sentence or row or text[:2] in ("- ", "• ", "* "):
                if nxt is not None and kinds[nxt] == "related" and last_head is None:
                    continue  # a sidebar's paragraph
                if last_head is not None:
                    found.append(last_head)
                started, related = True, False
                found.append(k)
            elif nxt is not None and kinds[nxt] == "byline":
                last_head, started, related = k, True, False
                found.append(k)
            elif len(text) > 24 or re.search(r"[一-鿿]", text) and len(text) > 6:
                if last_head is not None and not related:
                    found.append(last_head)  # the headline, then a subheading or a line without full stop
                    found.append(k)
                    started = True
                last_head = k
            continue
        if related and not sentence and not row:
            continue
        related = False
        found.append(k)
    return [k + 1 for k in dict.fromkeys(found)]


def lines_of(body: str | None, status: int | None = None, content_type: str | None = None) -> list[int]:
    """Main lines of one response, counted from 1."""
    if not body or body.isspace() or status is not None and (status >= 400 or status in (204, 304)):
        return []
    start = body.lstrip()[:1]
    if start in "{[":
        try:
            json.loads(body)
            return []
        except ValueError:
            if "json" in (content_type or "").lower():
                return []
    if "json" in (content_type or "").lower() and start not in "<":
        return []
    tags = re.search(r"</?[a-zA-Z][^<>]*>", body)
    return page_lines(body) if tags or start == "<" else text_lines(body)


def candidate_lines(responses: DataFrame) -> DataFrame:
    """``response_id, host, line_no, line_hash`` of main lines before repeated lines are taken out."""
    schema = "response_id long, host string, line_no long, line string"
    arrow = pa.schema([("response_id", pa.int64()), ("host", pa.string()), ("line_no", pa.int64()), ("line", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for rid, host, status, kind, body in zip(*(c.to_pylist() for c in batch.columns)):
                if not (found := lines_of(body, status, kind)):
                    continue
                lines = body.split("\n")
                for k in found:
                    for column, x in zip(out, (rid, host, k, lines[k - 1])):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

    rows = responses.select(F.col("response_id").cast("bigint"), "host", F.col("status_code").cast("int"), "content_type", "body").where("body is not null")
    return rows.mapInArrow(run, schema).select("response_id", "host", "line_no", _line_hash(F.col("line")).alias("line_hash"))


def _line_hash(line: Column) -> Column:
    """Hash of a line without its indentation and the tags around a paragraph."""
    for tag in ("<p>", "</p>", "<div>", "</div>"):
        line = F.replace(line, F.lit(tag), F.lit(""))
    return F.xxhash64(F.trim(line))


def repeated_lines(responses: DataFrame, share: float = HOST_SHARE, pages: int = HOST_PAGES) -> DataFrame:
    """``host, line_hash`` of lines that stand on many pages of a host; all pages are counted.

    Only hashes are shuffled, counted before the shuffle; an address fetched again counts once.
    """
    page = F.xxhash64(F.coalesce("url", F.col("response_id").cast("string"))).alias("u")
    rows = responses.where("host is not null and body is not null").select("host", page, "body")
    long = F.filter(F.split("body", "\n"), lambda x: F.length(x) >= HOST_LINE)
    hashed = F.array_distinct(F.transform(long, lambda x: _line_hash(x)))
    lines = rows.select("host", "u", F.explode(hashed).alias("line_hash")).distinct().groupBy("host", "line_hash").agg(F.count("*").alias("n")).where(F.col("n") >= pages)
    # all pages of the host; without a look at the bodies this reads two narrow columns
    total = responses.where("host is not null").select("host", page).distinct().groupBy("host").agg(F.count("*").alias("n_host"))
    return lines.join(total, "host").where(F.col("n") >= share * F.col("n_host")).select("host", "line_hash")


def main_lines(responses: DataFrame) -> DataFrame:
    """``response_id, line_no`` of all main lines."""
    return candidate_lines(responses).join(repeated_lines(responses), ["host", "line_hash"], "left_anti").select("response_id", "line_no")
