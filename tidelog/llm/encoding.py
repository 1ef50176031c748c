"""Text that was decoded with the wrong character encoding: find it and restore it.

A best-first search runs over the states that a line of text can reach by undoing
decodings: encode it with the encoding it was wrongly decoded by, decode the bytes
with the one it was written in, or unescape entities on the way. States already
visited are recognised by their hash; a character-plausibility cost says which
state to expand next, and the cheapest state reached wins if it is clearly cheaper
than the line itself. Texts garbled several times are peeled layer by layer.

UTF-8 shows itself, so for it only the byte sequences that are valid are decoded
and the rest of the line stays: a garbled passage in a good line is found. Other
encodings must explain the whole non-ASCII part of the line (of what isn't written
in wide characters, where there are some).

The search has no bound on states or on the length of a path. It ends because undoing
UTF-8 or an entity shortens the text, because another encoding can only have been
misread once, before all misreadings of UTF-8 (which then must explain the whole
line), and because no text costs less than nothing: a path that has already paid as
much as the best text costs is given up.

Wrong letters that are all letters of some language look fine one by one. What gives
them away is their company: letter pairs and triples are counted over all documents,
and a line whose letters keep rare company, while an operation gives it a common
one, is restored too (``Company``).

Characters lost for good (U+FFFD stands where they were) mark a line as garbled
that can't be restored; nothing is invented in their place.

Defined cases: null and empty texts have no passage; pure ASCII never has one, so
such texts don't leave the JVM; entities alone (``caf&eacute;``) are not garbled.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LOST = "�"

# --- operations --------------------------------------------------------------

#: Single-byte encodings by which text gets wrongly decoded. Bytes they leave undefined come out as control characters.
WRONG = ["latin-1", "cp1252", "cp1250", "iso8859-2", "cp1251", "cp1253", "cp1254", "mac_roman", "cp437", "cp850", "cp866", "koi8-r"]
#: (wrong, right) for texts that weren't UTF-8 to begin with.
PAIRS = [
    ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"),
    *((w, r) for w in ("latin-1", "cp1252") for r in ("gb2312", "cp932", "euc_jp", "euc_kr", "cp1251", "koi8-u", "cp1250", "iso8859-2", "cp1254", "cp1253", "cp1252", "cp437", "cp850", "mac_roman", "cp1255", "cp1256", "cp874") if w != r),
    ("cp1251", "koi8-u"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1252", "cp866"), ("iso8859-2", "cp1250"), ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("cp437", "cp866"),
]
#: Multi-byte encodings by which UTF-8 gets wrongly decoded.
WIDE = ["gb18030", "cp932", "big5", "euc_kr"]

_OUTSIDE = 0xF0000


@lru_cache(None)
def _to_bytes(encoding: str) -> dict[int, int]:
    """Translation of characters to the byte they came from, as a character below 256; others move out of the way."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            ch = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            ch = chr(b) if b < 0xA0 else None
        if ch is not None and len(ch) == 1:
            table.setdefault(ord(ch), b)
    for o in range(0x80, 0x100):
        table.setdefault(o, _OUTSIDE + o)
    return table


_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
#: Often a non-breaking space became a plain one afterwards; where a line holds valid sequences, those with a space in its place count too.
_UTF8_SPACED = re.compile(_UTF8.pattern + "|[\xe1-\xec\xee\xef](?:[\x80-\xbf] | [\x80-\xbf])|[\xc2-\xc5] ")
_ENTITY = re.compile(r"&(?:#\d{2,6}|#x[0-9A-Fa-f]{2,5}|[A-Za-z]{2,8}\d?);")
_OUT = re.compile("[\U000f0080-\U000f00ff]")


@lru_cache(None)
def _from_bytes(encoding: str) -> dict[int, str]:
    return {v: chr(k) for k, v in _to_bytes(encoding).items() if v < 0x100}


@lru_cache(None)
def _looks_utf8(encoding: str) -> re.Pattern:
    """A lead byte followed by a continuation byte, as the characters that ``encoding`` makes of them."""
    back = _from_bytes(encoding)
    chars = lambda a, b: "".join(re.escape(back[x]) for x in range(a, b) if x in back)
    return re.compile(f"[{chars(0xC2, 0xF5)}][{chars(0x80, 0xC0)}]")


@lru_cache(None)
def _any_utf8() -> re.Pattern:
    return re.compile("|".join(_looks_utf8(w).pattern for w in WRONG))


def undo_utf8(line: str, wrong: str) -> str | None:
    """Decode the valid UTF-8 sequences among the bytes that ``wrong`` turned into characters."""
    if not _looks_utf8(wrong).search(line):
        return None
    moved = line.translate(_to_bytes(wrong))
    if not _UTF8.search(moved):
        return None
    fixed = _UTF8_SPACED.sub(lambda m: "\x00" + m[0].replace(" ", "\xa0").encode("latin-1").decode("utf-8") + "\x00", moved)
    # what wasn't part of a sequence goes back to what it was
    back = _from_bytes(wrong)
    parts = fixed.split("\x00")
    rest = lambda s: _OUT.sub(lambda m: chr(ord(m[0]) - _OUTSIDE), s.translate(back))
    return "".join(p if i % 2 else rest(p) for i, p in enumerate(parts))


def all_utf8(line: str, wrong: str) -> bool:
    """Whether the valid UTF-8 sequences are all that the line has outside ASCII."""
    return _UTF8_SPACED.sub("", line.translate(_to_bytes(wrong))).isascii()


_DOUBLE = {"gb2312", "cp932", "euc_jp", "euc_kr"}
_TWO_WIDE = re.compile("[\u3041-\u30ff\u4e00-\u9fff\uac00-\ud7a3]{2}")
#: From the first non-ASCII character to the last and one more, apart from runs of wide characters.
_NARROW = "(?:(?![\u2e80-\ud7ff\uf900-\ufaff\uff00-\uffef])[^\x00-\x7f])"
_PARTS = re.compile(f"{_NARROW}(?:[^\u2e80-\ud7ff\uf900-\ufaff\uff00-\uffef]*{_NARROW})?[@-~]?")
_RIGHTS: dict[str, list[str]] = {}
for _wrong, _right in PAIRS:
    _RIGHTS.setdefault(_wrong, []).append(_right)


_WIDE_CHAR = re.compile("[\u2e80-\ud7ff\uf900-\ufaff\uff00-\uffef]+")


def _spans(line: str, wrong: str) -> list[tuple[int, int, list[bytes]]] | None:
    """(start, end, bytes with and without an ASCII character at the end) of what must be undone; None where something was never bytes of ``wrong``."""
    out = []
    for m in _PARTS.finditer(line):
        span = m[0]
        raw = span.translate(_to_bytes(wrong))
        try:
            whole = raw.encode("latin-1")
        except UnicodeEncodeError:
            return None
        out.append((m.start(), m.end(), [whole, whole[:-1]] if span[-1] < "\x80" else [whole]))
    return out


def _decoded(line: str, spans: list[tuple[int, int, list[bytes]]], right: str) -> str | None:
    parts, at = [], 0
    for start, end, ways in spans:
        for raw in ways:
            try:
                new = raw.decode(right)
                break
            except UnicodeDecodeError:
                continue
        else:
            return None
        if right in _DOUBLE and not _TWO_WIDE.search(new):
            return None
        parts += [line[at:start], new]
        at = start + len(raw)
    new = "".join((*parts, line[at:]))
    return new if new != line else None


def undo_pair(line: str, wrong: str, right: str) -> str | None:
    """Encode the non-ASCII part of the line with ``wrong`` and decode it with ``right``, all of it or nothing.

    Wide characters were never bytes of a single-byte encoding: what stands between them is undone, all of that or nothing.
    """
    spans = _spans(line, wrong)
    return _decoded(line, spans, right) if spans else None


def undo_pairs(line: str) -> Iterator[tuple[str, str, str]]:
    """(wrong, right, text) of all pairs that explain the line. The bytes are made once for each wrong encoding."""
    if not _PARTS.search(line):
        return
    for wrong, rights in _RIGHTS.items():
        spans = _spans(line, wrong)
        for right in rights if spans else ():
            if (new := _decoded(line, spans, right)) is not None:
                yield wrong, right, new


_RUNS = re.compile(r"[^\x00-\x7f]+[!-~]?")


def undo_wide(line: str, wrong: str) -> str | None:
    """The same for UTF-8 that was read as a multi-byte encoding, run by run."""
    changed = False

    def fix(m: re.Match) -> str:
        nonlocal changed
        run = m[0]
        for part in (run, run[:-1]) if run[-1] < "\x80" else (run,):
            try:
                new = part.encode(wrong).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            changed = True
            return new + run[len(part) :]
        return run

    new = _RUNS.sub(fix, line)
    return new if changed else None


def unescape(line: str) -> str | None:
    return html.unescape(line) if _ENTITY.search(line) else None


# --- plausibility ------------------------------------------------------------

# Letters of Russian and Ukrainian, from frequent to rare.
_CYRILLIC = "оеаинтсрвлікмдпуяыьгзбчйхжшюїєцщэфґъё"
_GREEK = "αοιετσνηυρπκμλςωδγχθφβξζψίόέάήύώϊϋΐΰ"
_CYRILLIC_COST = {c: 0.55 + 0.025 * i for i, c in enumerate(_CYRILLIC)}
_GREEK_COST = {c: 0.6 + 0.025 * i if i < 24 else 0.8 for i, c in enumerate(_GREEK)}
# Accented letters of the languages that texts here are commonly written in, and signs used in running text.
_LATIN = "áàâäãåçéèêëíìîïñóòôöõøúùûüýÿßæœąćęłńśźżčďěňřšťůžğışőűđðþ"
_SIGNS = "’“”–—…•·°±µ©®™€£§«»¿¡×÷½¼¾²³→←↑↓⇒≤≥≠≈‘"
_LATIN_SET = frozenset(_LATIN + _LATIN.upper() + "İẞ")
_WRONG_PLACE = frozenset("²³¹ªºµ¼½¾¿¡¢£¤¥¦§¨©«¬®¯°±´¶·¸»†‡‰‚„ˆ˜™œŒƒ€“”•…–—√∂∫≈≥≤∏π∑Ω◊≠∞∆")


@lru_cache(65536)
def _char(c: str) -> tuple[float, str]:
    """(cost, class) of one non-ASCII character."""
    o = ord(c)
    if o >= 0x10000:
        return (1.4, "sign") if 0x1F000 <= o < 0x1FB00 else (4.5, "other" if o < 0xF0000 else "bad")
    if o < 0xA0 or c == LOST or 0xE000 <= o < 0xF900 or o >= 0xF0000:
        return 5.0, "bad"
    if c == " ":
        return 1.5, "sign"
    if c in "œŒ":
        return 1.3, "upper" if c == "Œ" else "lower"
    if c in _LATIN_SET:
        return 1.0, "upper" if c.isupper() else "lower"
    if 0x400 <= o < 0x530:
        low = c.lower()
        return (_CYRILLIC_COST.get(low, 3.0), "cyr_u" if c != low else "cyr")
    if 0x370 <= o < 0x400:
        low = c.lower()
        return _GREEK_COST.get(low, 1.8), ("gre_u" if c != low else "gre")
    if 0x5D0 <= o < 0x5EB:
        return 0.8, "heb"
    if 0x620 <= o < 0x6D3 and c.isalpha():
        return 0.8, "ara"
    if 0x590 <= o < 0x700:
        return 3.5, "other"  # points and marks, which running text goes without
    if 0xE01 <= o < 0xE5C:
        return 0.95, "tha"
    if 0x3041 <= o < 0x3100:
        return 0.9, "kana"
    if 0x4E00 <= o < 0xA000:
        for enc, first, last, kind in (("euc_jp", 0xB0, 0xCF, "han"), ("gb2312", 0xB0, 0xD7, "han_cn")):
            try:
                if first <= c.encode(enc)[0] <= last:
                    return 1.2, kind
            except UnicodeEncodeError:
                pass
        try:
            c.encode("gb2312")
            return 1.9, "han_cn"
        except UnicodeEncodeError:
            return 2.3, "han"
    if 0xAC00 <= o < 0xD7A4:
        return 1.4, "hangul"
    if 0xFF61 <= o < 0xFFA0:
        return 2.4, "half"
    if 0x3000 <= o < 0x3040 or 0xFF00 <= o < 0xFFE0:
        return 1.0, "cjk_sign"
    if 0x2500 <= o < 0x25A0:
        return 1.4, "box"
    if c in "’“”…–—":
        return 0.9, "sign"
    if c in _SIGNS:
        return 1.4, "sign"
    if c.isalpha():
        return (1.8, "upper" if c.isupper() else "lower") if o < 0x250 else (2.6, "other")
    return 2.4, "other"


_SCRIPT = {"upper": "l", "lower": "l", "ascii_u": "l", "ascii_l": "l", "cyr": "c", "cyr_u": "c", "gre": "g", "gre_u": "g", "han": "h", "han_cn": "h", "kana": "h", "hangul": "k", "heb": "b", "ara": "a", "tha": "t"}
_NON_ASCII = re.compile("[^\x00-\x7f]+")
_KANA = re.compile("[\u3041-\u30fe]")
_CLOSING, _OPENING = frozenset("’”…»"), frozenset("“‘«¿¡€£©±½•→")


def _ascii_kind(c: str) -> str:
    return ("ascii_u" if c.isupper() else "ascii_l") if c.isalpha() else "digit" if c.isdigit() else ""


def implausibility(line: str, limit: float = math.inf) -> tuple[float, bool]:
    """Cost of the line's non-ASCII characters, in themselves and beside their neighbours, and whether anything is odd.

    ASCII costs nothing. A line in which nothing is odd needs no search. Characters
    only add to the cost, so counting may stop when it is above the ``limit``.
    """
    total, odd = 0.0, 0.0
    japanese = bool(_KANA.search(line))
    for m in _NON_ASCII.finditer(line):
        if total > limit:
            return total, True
        a, b = m.span()
        last = _ascii_kind(line[a - 1]) if a else ""
        run = caps = 0
        for i in range(a, b):
            c = line[i]
            cost, kind = _char(c)
            extra = 0.0
            if kind == "box" and last == "box" and "─" in line[i - 1 : i + 1]:
                cost = 0.4
            if kind in ("upper", "lower"):
                run += 1
                if run > 1:
                    extra += 0.3 if run == 2 else 1.0
                if kind == "upper" and last in ("lower", "ascii_l"):
                    extra += 1.8
                elif kind == "upper" and last in ("upper", "ascii_u") and line[i + 1 : i + 2].islower():
                    extra += 0.5
                if last in _SCRIPT and _SCRIPT[last] != "l" or last in ("box", "half"):
                    extra += 1.8
            elif kind in _SCRIPT:
                run = 0
                caps = caps + 1 if kind in ("cyr_u", "gre_u") else 0
                if caps > 1:
                    odd += 0.1  # capitals only: worth a search, not a fault
                elif caps:
                    cost += 0.25
                if kind in ("cyr_u", "gre_u") and last in ("cyr", "gre"):
                    extra += 1.8
                own = _SCRIPT[kind]
                if japanese and kind == "han_cn":
                    cost += 0.5  # Chinese characters that Japanese doesn't use
                if last in _SCRIPT and _SCRIPT[last] != own:
                    extra += 0.8 if own in "hk" and last.startswith("ascii") else 1.8
            elif kind == "box":
                if last and last not in ("box", "digit"):
                    extra += 1.5
                elif last == "box" and cost > 1:
                    extra += 0.4
            elif kind == "cjk_sign":
                run = 0
            else:
                run = 0
                nxt = _char(line[i + 1])[1] if i + 1 < b else (_ascii_kind(line[i + 1]) if i + 1 < len(line) else "")
                before, after = last in _SCRIPT or last in ("sign?", "other", "bad"), nxt in _SCRIPT
                if c in _CLOSING:
                    extra += 0.0 if not after or (c == "’" and before) else 1.8 if before else 0.6
                elif c in _OPENING:
                    extra += 1.2 if before else 0.0
                elif kind == "sign":
                    extra += 0.8 * before + (0.0 if c in "µ°" else 1.2 if c in "™®÷¬" else 0.8) * after
                else:
                    extra += 1.0 * before + 0.6 * after
                if last == "box":
                    extra += 0.8
                if c in _WRONG_PLACE and extra:
                    kind = "sign?"
            if extra > 0.3 or cost >= 1.5:
                odd += extra + cost
            total += cost + extra
            last = kind
        if b < len(line):
            nxt = _ascii_kind(line[b])
            if nxt.startswith("ascii"):
                if last == "box" or (last in _SCRIPT and _SCRIPT[last] in "cg"):
                    total, odd = total + 1.5, odd + 1.5
                elif last in ("han", "han_cn", "kana", "hangul"):
                    total += 0.8
    return total, odd > 0


# --- search ------------------------------------------------------------------

#: What a restored line must gain, what each operation and each that isn't about UTF-8 costs.
_MIN_GAIN, _OP_COST, _PAIR_COST = 0.3, 0.35, 0.85
#: Lines up to this length are remembered with their result, so that memory is bounded by bytes, not by lines.
_SHORT = 240


def _neighbours(line: str) -> Iterator[tuple[str, str, float]]:
    for wrong in WRONG:
        new = undo_utf8(line, wrong)
        if new is not None:
            yield f"{wrong}>utf-8", new, 0.0
    if _WIDE_CHAR.search(line):
        for wrong in WIDE:
            new = undo_wide(line, wrong)
            if new is not None:
                yield f"{wrong}>utf-8", new, 0.5
    new = unescape(line)
    if new is not None:
        yield "unescape", new, 0.5


def _open(line: str, odd: bool) -> bool:
    """Whether the line may still hold something to undo."""
    return odd or _any_utf8().search(line) is not None


def _search(line: str) -> tuple[str, tuple[str, ...]]:
    if _ENTITY.search(line):
        plain = html.unescape(line)
        new, path = restore_line(plain) if plain != line else (line, ())
        if path:
            return new, ("unescape", *path)
    start, odd = implausibility(line)
    if not _open(line, odd):
        return line, ()
    best = (start - _MIN_GAIN, line, ())
    visited = {hash(line)}
    heap = [(start, 0, line, (), 0.0, True, None)]
    serial = 0
    while heap:
        _, _, text, path, spent, more, parent = heapq.heappop(heap)
        if not more:
            break  # nothing is left to undo in it, and all others look worse
        whole = parent is None or (parent[1] and (path[-1] == "unescape" or path[-1].split(">")[0] in WIDE or all_utf8(parent[0], path[-1].split(">")[0])))
        if spent + _OP_COST >= best[0]:
            continue  # whatever lies behind costs more than the best so far
        for op, new, extra in _neighbours(text):
            h = hash(new)
            if h in visited:
                continue
            visited.add(h)
            (cost, odd), paid = implausibility(new), spent + _OP_COST + extra
            way = (*path, op)
            if any(o != "unescape" for o in way) and cost + paid < best[0]:
                best = (cost + paid, new, way)
            serial += 1
            heapq.heappush(heap, (cost + paid, serial, new, way, paid, op == "unescape" or _open(new, odd), (text, whole)))
        paid = spent + _OP_COST + _PAIR_COST
        for wrong, right, new in undo_pairs(text) if whole and paid < best[0] else ():
            cost, _ = implausibility(new, best[0] - paid)
            if cost + paid < best[0]:
                best = (cost + paid, new, (*path, f"{wrong}>{right}"))
    return best[1], best[2]


_remembered = lru_cache(50_000)(_search)


def restore_line(line: str) -> tuple[str, tuple[str, ...]]:
    """The cheapest text reachable from the line and the operations that lead there (none: it is fine as it is)."""
    return _remembered(line) if len(line) <= _SHORT else _search(line)


# --- company of letters ------------------------------------------------------

#: What the letters' company must gain (log of the documents that have it) in a line alone, and where other lines of the text say what happened.
_MIN_COMPANY, _SOME_COMPANY = 3.0, 0.5
#: Documents that must have a pair or triple for it to count as known, and the number of buckets that they are counted in (by
#: hash, so that the table is bounded whatever languages there are; two that share a bucket count together).
_KNOWN, _BUCKETS = 2, 1 << 20

_WORD = re.compile("[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af\u0370-\u03ff\u0400-\u052f\u0590-\u06ff\u0e00-\u0e7f\u1e00-\u1eff]+")


@lru_cache(50_000)
def _company(word: str) -> tuple[int, ...]:
    """Buckets of the pairs and triples of letters and word ends that hold a letter outside ASCII."""
    w = f" {word.lower()} "
    return tuple(bucket(x) for n in (2, 3) for i in range(len(w) - n + 1) if not (x := w[i : i + n]).isascii())


def bucket(letters: str) -> int:
    return crc32(letters.encode("utf-8", "surrogatepass")) % _BUCKETS


def company_of(text: str) -> set[int]:
    return {x for word in set(_WORD.findall(text)) if not word.isascii() for x in _company(word)}


_OTHER_SCRIPT = re.compile("[\u0370-\u05ff\u0600-\u06ff\u0e00-\u0e7f]")


class Company:
    """In how many documents each pair and triple stands (by bucket), and what an operation gains by it."""

    def __init__(self, documents: dict[int, int]):
        self.documents = documents

    def score(self, line: str) -> tuple[float, int, int]:
        """(sum of logs, how many, documents of the rarest)"""
        n = [self.documents.get(x, 0) for word in _WORD.findall(line) if not word.isascii() for x in _company(word)]
        return sum(math.log(x + 0.5) for x in n), len(n), min(n, default=0)

    def gain(self, line: str, new: str) -> float:
        """0 where the two don't compare: signs became letters, or the new letters keep company that isn't known.

        Characters that make no words (Chinese, Japanese) keep no company of their own.
        """
        (before, n, _), (after, m, rarest) = self.score(line), self.score(new)
        return after - before if (n == m or (not n and _TWO_WIDE.search(line))) and rarest >= _KNOWN else 0.0

    def _best(self, line: str, found: str, least: float, limit: float) -> tuple[str, tuple[str, ...]]:
        """What a last step makes of ``line`` with the greatest gain over ``found``, if that is above ``least``."""
        best = (least, found, ())
        tried = {found}
        for wrong, right, new in undo_pairs(line):
            if new in tried:
                continue
            tried.add(new)
            if (gain := self.gain(found, new)) > best[0] and implausibility(new, limit)[0] <= limit:
                best = (gain, new, (f"{wrong}>{right}",))
        return best[1], best[2]

    def restore(self, line: str) -> tuple[str, tuple[str, ...]]:
        """The line after the operation that gains most, if that is enough."""
        return self._best(line, line, _MIN_COMPANY, implausibility(line)[0] + 0.5) if self.score(line)[1] else (line, ())

    def choose(self, line: str, found: str, path: tuple[str, ...]) -> tuple[str, tuple[str, ...]]:
        """Of the encodings that explain the line about as well as the one found, that whose letters keep the best company."""
        wrong, _, right = path[-1].partition(">")
        if right in ("utf-8", "") or not (right in _DOUBLE or _OTHER_SCRIPT.search(found)):
            return found, path
        limit = implausibility(found)[0] * 1.3 + 1.0
        for way in dict.fromkeys((path[:-1], ())):  # what looked like UTF-8 on the way may not have been
            new, last = self._best(follow(line, way), found, _MIN_COMPANY, limit)
            if last:
                return new, (*way, *last)
        return found, path


def follow(line: str, path: tuple[str, ...]) -> str:
    """The line after a way of operations that was found for it."""
    for op in path:
        wrong, _, right = op.partition(">")
        line = (html.unescape(line) if not right else undo_pair(line, wrong, right) if right != "utf-8" else undo_wide(line, wrong) if wrong in WIDE else undo_utf8(line, wrong)) or line
    return line


def _with_company(company: Company, line: str) -> tuple[str, tuple[str, ...]]:
    new, path = restore_line(line)
    return company.choose(line, new, path) if path else company.restore(line)


_remembered_with = lru_cache(50_000)(_with_company)


_LINE = re.compile(r"[^\r\n]+")


def _again(line: str, path: tuple[str, ...], company: Company | None = None) -> str | None:
    """The line after a single known operation, if that makes it more plausible or gives its letters better company."""
    wrong, right = path[0].split(">")
    new = undo_pair(line, wrong, right)
    if new is None:
        return None
    cheaper = implausibility(line)[0] - implausibility(new)[0]
    return new if cheaper > _MIN_GAIN or (company and cheaper >= -0.5 and company.gain(line, new) > _SOME_COMPANY) else None


def restore_text(text: str, company: Company | None = None) -> tuple[str, int, int]:
    """(restored text, garbled lines restored, lines with characters lost). Line ends stay as they are.

    A text is usually garbled in one way: where lines differ in the (non-UTF-8)
    operation found, the text's most frequent one is preferred if it fits. With the
    company of letters in all documents every non-ASCII line is searched, without it
    only those in which something is odd.
    """
    lines: dict[str, tuple[str, tuple[str, ...]]] = {}
    open_lines: dict[str, None] = {}
    lost = 0
    for m in _LINE.finditer(text):
        s = m[0]
        if LOST in s:
            lost += 1
        elif not s.isascii() or "&" in s:
            # indentation and diff marks aren't part of what is looked up again and again
            body = s.lstrip(" \t+-#/*")
            found = restore_line(body) if not company else (_remembered_with if len(body) <= _SHORT else _with_company)(company, body)
            if found[1]:
                lines[s] = (s[: len(s) - len(body)] + found[0], found[1])
            else:
                open_lines[s] = None
    if not lines:
        return text, 0, lost
    single = Counter(p for _, p in lines.values() if len(p) == 1 and p[0] != "unescape" and not p[0].endswith("utf-8"))
    if single:
        common = min(single, key=lambda p: (-single[p], p))
        for s in open_lines:  # too little in the line alone, but the text's other lines say what happened
            if (company or implausibility(s)[1]) and (new := _again(s, common, company)) is not None:
                lines[s] = (new, common)
        for s, (_, p) in list(lines.items()):
            if p in single and p != common and (new := _again(s, common)) is not None and not (company and company.gain(new, lines[s][0]) > _SOME_COMPANY):
                lines[s] = (new, common)
    fixed = 0

    def replace(m: re.Match) -> str:
        nonlocal fixed
        found = lines.get(m[0])
        fixed += found is not None
        return found[0] if found else m[0]

    return _LINE.sub(replace, text), fixed, lost


_OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("restored", pa.string()), ("lines_restored", pa.int32()), ("lines_lost", pa.int32())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: Counter[int] = Counter()
    for batch in batches:
        for text in batch.column(1).to_pylist():
            n.update(company_of(restore_text(text)[0]))
    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], names=["company", "n"])


def company(suspects: DataFrame) -> Company:
    """Counted over all documents, as they read after the search line by line. The driver gets a row a bucket at most."""
    counted = suspects.mapInArrow(_count, "company bigint, n bigint").groupBy("company").agg(F.sum("n").alias("n")).filter(F.col("n") >= _KNOWN)
    return Company({r[0]: r[1] for r in counted.collect()})


def _walk(batches: Iterator[pa.RecordBatch], known: Company) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            new, fixed, lost = restore_text(text, known)
            if fixed or lost:
                rows.append((doc, new, fixed, lost))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_OUT_SCHEMA.types)], schema=_OUT_SCHEMA)


def garbled(documents: DataFrame) -> DataFrame:
    """(doc_id, restored, lines_restored, lines_lost) of each document with a garbled passage.

    Two scans: the first counts the company that letters keep, the second searches.
    Only the counts are shuffled: texts without any non-ASCII character or entity stop at the scan.
    """
    suspects = documents.select("doc_id", "text").filter(F.col("text").rlike("[^\\x00-\\x7F]|&[#A-Za-z]"))
    known = company(suspects)
    return suspects.mapInArrow(lambda batches: _walk(batches, known), "doc_id bigint, restored string, lines_restored int, lines_lost int")
