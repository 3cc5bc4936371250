"""Template residue, filler, error messages and script notices in page text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopyard.llm import pages
from hopyard.session import materialize

_WORD = r"[A-Za-z_][\w .|-]{0,40}"
#: Unfilled fields of template languages, and program values printed in place of text.
PLACEHOLDER = re.compile(
    rf"\{{\{{\{{?\s*{_WORD}\s*\}}?\}}\}}?|\{{%.{{1,60}}?%\}}|\$\{{\s*{_WORD}\s*\}}|<%=?.{{1,60}}?%>|<<\s*{_WORD}\s*>+|<[A-Za-z_]+ ?/>|%[A-Z][A-Z_]{{2,30}}%|%%\s*{_WORD}\s*%%|\[\[\s*{_WORD}\s*\]\]"
    rf"|\[(?:insert|your|enter|add|type) [^\]]{{1,40}}\]|__[A-Za-z][A-Za-z_]*__|\{{(?:\d|[A-Za-z_]{{2,30}})\}}|#(?:REF|VALUE|NAME|N/A|DIV/0|NUM)[!?]?|\[object \w+\]|(?<![\w%])%[sd](?!\w)|@@\w+@@",
    re.I,
)
#: A value that is only a program's word for nothing: at an end of the line, after a label or a currency sign.
VALUE = re.compile(r"(?:^|[:$€£(—–=-]\s*|\.{2,}\s*|\b(?:at|from|until|to|for|is|call)\s+)(?:undefined|NaN|None|null|nil|NULL|N/A)\s*(?:$|[-–—,.;|)])|\bundefined\b|\bNaN\b")
#: Words of the pseudo-Latin filler text.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
#: What stands in for text still to be written.
FILLER = re.compile(
    r"\btest test\b|just another (?:\w+ )?(?:site|page|blog)\b|placeholder paragraph|to be written by|^describe this \w+ in|(?:delete|replace|remove) this (?:block|line|paragraph|section)|(?:dummy|placeholder|filler|sample|example) (?:copy|text|content)|(?:text|copy|headline|title|description|content|story) goes here|^(?:your|add|insert|enter|write|type) (?:a |your |the )?(?:headline|title|text|copy|description|tagline|content)\b"
    r"|item name\b.{0,20}item description|replace (?:it|this|me) with|coming soon[:.]? ?(?:text|copy)|texto de (?:ejemplo|relleno|muestra)|escriba aquí|texte (?:d.exemple|de remplissage|factice)|votre texte ici|saisissez votre|ici votre texte|blindtext|platzhalter|beispieltext|mustertext|ihr text|hier steht",
    re.I,
)
#: What a server, a guard or a script says instead of the page.
ERROR = re.compile(
    r"page (?:you \w+ \w+ )?(?:is )?not (?:found|here|available)|not found\b|\b(?:error|http)\W{0,2}[45]\d\d\b|\b[45]\d\d (?:bad gateway|internal|forbidden|not found|service|gateway)|bad gateway|internal server error|gateway time-?out|forbidden|access (?:is |was )?denied|was blocked|account (?:has been |is )?suspended|domain .{1,80} (?:is parked|for sale)|index of /"
    r"|temporarily unavailable|down for maintenance|error establishing|fatal error|uncaught \w*(?:error|exception)|failed to open stream|stack trace|too many requests|session (?:has )?(?:timed out|expired)|nothing matched|no results? (?:found|matched)|link .{0,20}(?:flat|dead|broken|expired)|page .{0,30}(?:gone|moved|missing)|checking your browser|verify (?:that )?you are (?:a )?human|are you (?:a )?(?:human|robot)|just a moment"
    r"|(?:enable|activate|turn on|switch on|allow|requires?|needs?|without) (?:javascript|scripts|cookies|java script)|(?:works? only|only works?) with (?:java)?scripts?|scripts? (?:turned|switched) on|javascript (?:seems|is|appears) |browser is not supported|(?:javascript|scripts?).{0,30}(?:off|disabled|required)|activ\w* (?:le |el )?javascript|javascript.{0,20}aktiv\w*|aktiv\w* sie javascript"
    r"|page (?:est |demandée )?(?:introuvable|inexistante)|accès (?:refusé|interdit)|página no (?:encontrada|existe|disponible)|acceso (?:denegado|prohibido)|seite (?:wurde )?nicht (?:gefunden|verfügbar)|zugriff verweigert|service indisponible|servicio no disponible|nicht erreichbar|en mantenimiento|en maintenance|wartungsarbeiten|compte suspendu|cuenta suspendida|trop de requêtes|demasiadas solicitudes|zu viele anfragen",
    re.I,
)
#: One of these stands in every match of ERROR, or a number from 400 to 599: a quick look before the search.
_ERROR_HINTS = ("not found", "not here", "not available", "error", "http", "bad gateway", "gateway time", "forbidden", "denied", "was blocked", "suspend", "domain", "index of", "unavailable", "down for", "exception", "failed to open", "stack trace", "too many", "session", "nothing matched", "no result", "link", "page", "checking your", "verify", "are you", "just a moment", "script", "cookie", "browser is not", "accès", "página", "acceso", "seite", "zugriff", "indisponible", "no disponible", "nicht erreichbar", "en man", "en main", "wartung", "trop de", "demasiadas", "zu viele")
_CODE = re.compile(r"[45]\d\d")
#: Lines beside an error message.
BESIDE = re.compile(r"^(?:reference:|ray |request |if this goes on|try the|then reload|go back|apache|nginx|server at|.{0,40} server at |please try|error code|retry)", re.I)
#: A page's text counts as real from so many characters of lines that are no evidence.
REAL = 160


#: One of these stands in every match of FILLER: a quick look before the search. In _FOLDED are the letters that a search
#: without case takes for an i or s, and lower() doesn't.
_FILLER_HINTS = ("test", "text", "copy", "content", "placeholder", "written by", "goes here", "headline", "title", "desc", "tagline", "replace", "item name", "coming soon", "escriba", "hier ", "blind", "platz", "delete this", "just another", "saisissez")
_FOLDED = "İıſ"
_MARKS = frozenset("{[<%#@_")
_VALUES = ("undefined", "NaN", "None", "null", "nil", "NULL", "N/A")


@lru_cache(maxsize=1 << 16)
def is_filler(line: str) -> bool:
    low = line.lower()
    if _has(low, _FILLER_HINTS, line) and FILLER.search(line):
        return True
    words = low.split()
    if len(words) < 3:
        return False
    if sum(map(LATIN.__contains__, words)) * 3 >= len(words):
        words = re.findall(r"[a-z]+", low)
        if len(words) >= 4 and sum(w in LATIN for w in words) >= 0.6 * len(words):
            return True
    return len(set(words)) <= len(words) - 2 and any(a == b == c for a, b, c in zip(words, words[1:], words[2:]) if len(a) > 2)


def _has(low: str, hints: tuple[str, ...], line: str) -> bool:
    """Whether a line may hold one of the hints, given in lower case."""
    for h in hints:
        if h in low:
            return True
    return not line.isascii() and any(c in line for c in _FOLDED)


@lru_cache(maxsize=1 << 16)
def is_placeholder(line: str) -> bool:
    return bool(not _MARKS.isdisjoint(line) and PLACEHOLDER.search(line) or _has(line, _VALUES, "") and VALUE.search(line))


@lru_cache(maxsize=1 << 16)
def is_error(line: str) -> bool:
    """A message. In a longer line, the sentences that say so make up a third of it; a text about something that mentions
    errors doesn't."""
    sentences = [line] if len(line) <= 140 else re.split(r"(?<=[.!?])\s+", line)
    said = [s for s in sentences if _says_error(s)]
    if not said or len(sentences) == 1:
        return bool(said)
    return 3 * (sum(map(len, said)) + sum(len(s) for s in sentences if BESIDE.search(s) and s not in said)) >= len(line)


def _says_error(text: str) -> bool:
    low = text.lower()
    return (_has(low, _ERROR_HINTS, text) or bool(_CODE.search(text))) and bool(ERROR.search(text))


def is_notice(rest: list[str], messages: list[str]) -> bool:
    """Whether a page with these messages holds no real content: what stands beside them is short, or less than they."""
    real = sum(len(t) for t in rest if not BESIDE.search(t))
    return real < max(REAL, sum(map(len, messages)))


def plain(line: str) -> str:
    """A line for counting: lower case, digits as 0."""
    return re.sub(r"\d+", "0", line.lower())


def host_of(url: str | None) -> str:
    return re.sub(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@]*@)?", "", (url or "").strip().lower()).split("/")[0].split(":")[0].removeprefix("www.")


#: What a page's lines of the same text add up to: how many, how many are residue, and in the page's main part the
#: characters of messages and of real text.
_SUMS = ("n", "residue", "said", "real")


def page_lines(host: str, html: str) -> tuple[dict[bytes, list[int]], bool]:
    """The visible lines of a page, by a 128-bit digest of host and normalised text, with their ``_SUMS``; and whether
    any of them is evidence."""
    from hopyard.llm import body

    page = pages.read(html)
    main = body.main_boxes(page)
    lines: dict[int, list] = {}
    for p in page.pieces:
        line = lines.setdefault(p.line, ["", False])
        line[0] = f"{line[0]} {p.text}" if line[0] else p.text
        line[1] |= p.box in main
    sums: dict[bytes, list[int]] = {}
    evidence = False
    for text, inside in lines.values():
        own = sums.setdefault(xxhash.xxh3_128_digest(f"{host}\n{plain(text)}".encode("utf-8", "surrogatepass")), [0, 0, 0, 0])
        own[0] += 1
        error = is_error(text)
        if is_filler(text) or is_placeholder(text):
            own[1] += 1
            evidence = True
        elif inside and not error and not BESIDE.search(text) and not body.is_furniture(text):
            own[3] += len(text)
        if error and inside:
            own[2] += len(text)
            evidence = True
    return sums, evidence


def _lines(df: DataFrame) -> DataFrame:
    """(page, host, h, evidence, *_SUMS): each visible line's text once for each page."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, url, html in zip(part["page"], part["url"], part["html"]):
                host = host_of(url)
                sums, evidence = page_lines(host, html)
                rows += [(key, host, h, evidence, *own) for h, own in sums.items()]
            yield pd.DataFrame(rows, columns=["page", "host", "h", "evidence", *_SUMS])

    return df.mapInPandas(run, f"page {dict(df.dtypes)['page']}, host string, h binary, evidence boolean, n int, residue int, said int, real int")


def residue_pages(df: DataFrame, page: str, url: str, html: str, share: float = 0.5, least: int = 4) -> DataFrame:
    """(page): pages whose visible text is residue.

    Lines are counted by host; a line on at least ``share`` of a host's pages, and on ``least`` of them (fewer pages tell
    nothing about a site), belongs to the site. What is left of a page is a case if it has filler or an unfilled field,
    or if its main part is an error or script notice with no real text. A page of nothing but its host's lines is
    judged by all its lines.

    :param df: pages; null or blank html makes no case. Each page is parsed and its lines are judged in one pass, which
        writes digests and counts only. Counting goes by (host, line) with partial counts first, so a host with any
        share of the pages is spread over all tasks; only pages with evidence go on to the join with the site's lines.
    """
    src = df.where(F.trim(F.coalesce(html, F.lit(""))) != "").select(F.col(page).alias("page"), F.col(url).alias("url"), F.col(html).alias("html"))
    lines = materialize(_lines(src), "lines")
    hosts = lines.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    often = lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least)
    site = often.join(hosts, "host").where(F.col("k") >= F.col("n_pages") * share).select("host", "h", F.lit(True).alias("site"))
    marked = lines.where("evidence").join(site, ["host", "h"], "left")
    total = lambda c, own: F.sum(F.when(F.col("site").isNull(), F.col(c)).otherwise(0) if own else F.col(c))
    sums = marked.groupBy("page").agg(*[total(c, own).alias(f"own_{c}" if own else c) for c in _SUMS for own in (True, False)])
    notice = (F.col("own_said") > 0) & (F.col("own_real") < F.greatest(F.lit(REAL), F.col("own_said")))
    case = F.when(F.col("own_n") == 0, (F.col("residue") > 0) | (F.col("said") > 0)).otherwise((F.col("own_residue") > 0) | notice)
    return sums.where(case).select(F.col("page").alias(page))
