"""Personal data in subtitle texts: find it and put typed placeholders in its place.

A chain of transducers rewrites the text into a form that can be searched
(time lines out, wrong encodings undone, look-alike letters and disguised
signs replaced) and keeps for every character where it came from, so that
the spans found there are given in characters of the source.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.damage import _SEQUENCE, EAST_TO_WEST, _decode_run, looks_damaged, near, plain, skeleton
from docweave.session import small_rows, staged

_SPANS = "doc_id long, pii_type string, char_start int, char_end int, family string, sure boolean"
_TIMES = re.compile(r"(?:(?<=\n)|\A)(?:[^\n]{0,8}\n)?[^\n]{5,20}-{1,2}>[^\n]*")

# --- transducers ---------------------------------------------------------

#: Letters of other scripts that look like Latin ones, and full-width signs.
_HOMOGLYPHS = dict(zip("аеорсухіјѕԁһАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "aeopcyxijsdhABEKMHOPCTXIJSABEZHIKMNOPTYXo"))
_ONE_TO_ONE = {ord(a): b for a, b in _HOMOGLYPHS.items()} | EAST_TO_WEST | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_FOREIGN = re.compile("[" + "".join(re.escape(chr(c)) for c in _ONE_TO_ONE) + "]")


class Layer:
    """One rewriting step: stretches of the new text and where they come from.

    A stretch is a copy, character for character, or stands as a whole for
    what it replaced.
    """

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        """``edits`` are (start, end, replacement), in order and apart."""
        parts, self.starts, self.olds, size, at = [], [], [], 0, 0
        for a, b, new in [*edits, (len(text), len(text), "")]:
            for old_a, old_b, piece, copy in ((at, a, text[at:a], True), (a, b, new, False)):
                if piece:
                    parts.append(piece)
                    self.starts.append(size)
                    self.olds.append((old_a, old_b, copy))
                    size += len(piece)
            at = b
        self.text = "".join(parts)

    def source(self, start: int, end: int) -> tuple[int, int]:
        n, m = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        a, _, copy = self.olds[n]
        c, d, copied = self.olds[m]
        return a + (start - self.starts[n] if copy else 0), c + end - self.starts[m] if copied else d


class Traced(NamedTuple):
    """A rewritten text, and what leads back from it: a layer, and the source span of each character below it."""

    text: str
    layer: Layer | None
    starts: list[int] | None
    ends: list[int] | None

    def source(self, start: int, end: int) -> tuple[int, int]:
        a, b = self.layer.source(start, end) if self.layer else (start, end)
        return (a, b) if self.starts is None else (self.starts[a], self.ends[b - 1])


def _undouble(text: str) -> tuple[str, list[int], list[int]]:
    """Undo doubly read UTF-8, keeping the source span of each character."""
    starts, ends = list(range(len(text))), list(range(1, len(text) + 1))
    for _ in range(2):
        out, new_starts, new_ends, at = [], [], [], 0
        for m in _SEQUENCE.finditer(text):
            a = m.start()
            out.append(text[at:a])
            new_starts += starts[at:a]
            new_ends += ends[at:a]
            piece, i = m[0], 0
            while i < len(piece):
                step = next((n for n in (4, 3, 2) if i + n <= len(piece) and len(_decode_run(_Whole(piece[i : i + n]))) == 1), 1)
                out.append(_decode_run(_Whole(piece[i : i + step])))
                new_starts.append(starts[a + i])
                new_ends.append(ends[a + i + step - 1])
                i += step
            at = m.end()
        if not out:
            break
        out.append(text[at:])
        new_starts += starts[at:]
        new_ends += ends[at:]
        text, starts, ends = "".join(out), new_starts, new_ends
    return text, starts, ends


class _Whole(str):
    """Lets a string stand for a match of all of itself."""

    def __getitem__(self, key):
        return str(self) if key == 0 else str.__getitem__(self, key)


def traced(text: str) -> Traced:
    starts = ends = None
    if looks_damaged(text):
        text, starts, ends = _undouble(text)
    if not text.isascii() and _FOREIGN.search(text):
        text = text.translate(_ONE_TO_ONE)
    if "->" not in text:
        return Traced(text, None, starts, ends)
    edits, at = [], 0
    for m in _TIMES.finditer(text):
        edits.append((*m.span(), "\x00" if m.start() > at else ""))
        at = m.end()
    layer = Layer(text, edits)
    return Traced(layer.text, layer, starts, ends)


#: Misreadings undone one for one, to compare words letter by letter.
_FOLD = {ord(a): b for a, b in zip("01|i!58hcI", "ollllsbbel")}


def _fold_table() -> dict[int, str]:
    table = {}
    for code in range(0x41, 0x180):
        c = plain(chr(code))
        if len(c) == 1:
            table[code] = c
    return {code: _FOLD.get(ord(c), c) for code, c in table.items()} | {k: v for k, v in _FOLD.items()}


_FOLD_TABLE = _fold_table()


def fold(text: str) -> str:
    """Lower case, no accents, look-alikes merged; as long as ``text``."""
    return text.translate(_FOLD_TABLE)


# --- disguised addresses of mailboxes ------------------------------------

#: Words for the two signs of an address.
_AT_WORDS, _DOT_WORDS = "at|arroba|arobase|klammeraffe", "dot|punto|point|punkt"
_AT_DISGUISED = re.compile(rf"\s*[(\[{{<]\s*(?:{_AT_WORDS}|@)\s*[)\]}}>]\s*|\s+@\s+|&#(?:64|x40);|&commat;|(?<=[^\W_])(?-i:_AT_|-AT-)(?=[^\W_])", re.I)
_DOT_DISGUISED = re.compile(rf"\s*[(\[{{<]\s*(?:{_DOT_WORDS}|\.)\s*[)\]}}>]\s*|&#(?:46|x2e);|&period;|(?<=[^\W_])(?-i:_DOT_|-DOT-)(?=[^\W_])", re.I)
#: An address read out: words for both signs, with blanks around them.
_READ_OUT = re.compile(
    rf"(?<![\w.+-])[\w|]+(?:(?:\.|\s+(?:{_DOT_WORDS})\s+)[\w|]+)*\s+(?:{_AT_WORDS}|chez)\s+[\w-]+(?:(?:\.|\s+(?:{_DOT_WORDS})\s+)[\w-]+)*\s+(?:{_DOT_WORDS})\s+[^\W\d_]{{2,}}", re.I
)
_READ_SIGN = re.compile(rf"\s+(?:({_AT_WORDS}|chez)|{_DOT_WORDS})\s+", re.I)
#: An address with its letters or signs set apart by blanks.
_SET_APART = re.compile(r"(?:(?<!\b[^\W_] )(?<![\w.+-])(?:[^\W_] ){3,}+@|(?<![\w.+|-])[\w|][\w|.+%-]*+ ?@) ?(?:(?:[^\W_] ){2,}[^\W_]|[\w-]+)(?:(?: \. |\.(?! ))(?:(?:[^\W_] )+[^\W_](?![\w])|[\w-]+))+")
_SOME_AT = re.compile(rf"@|[(\[{{<]\s*(?:{_AT_WORDS})\s*[)\]}}>]|&#(?:64|x40);|&commat;|(?-i:[_-]AT[_-])", re.I)
_SOME_DOT_WORD = re.compile(rf"\s(?:{_DOT_WORDS})\s", re.I)
_EMAIL = re.compile(r"(?<![\w.+|-])[\w|][\w|.+%-]*@[\w|-]+(?:\.[\w|-]+)*\.[^\W\d_][\w|]+", re.I)


def _signs(text: str) -> list[tuple[int, int, str]]:
    """Edits that put ``@`` and ``.`` in place of their disguises."""
    edits = []
    if _SOME_AT.search(text):
        edits += [(*m.span(), "@") for m in _AT_DISGUISED.finditer(text)]
        edits += [(*m.span(), ".") for m in _DOT_DISGUISED.finditer(text)]
        for m in _SET_APART.finditer(text) if " @ " in text else ():
            own = [(m.start() + b.start(), m.start() + b.end(), "") for b in re.finditer(" ", m[0])]
            if len(own) > 2:  # more than the blanks around the sign
                edits = [e for e in edits if e[1] <= m.start() or e[0] >= m.end()] + own
    if _SOME_DOT_WORD.search(text):
        for m in _READ_OUT.finditer(text):
            own = [(m.start() + b.start(), m.start() + b.end(), "@" if b[1] else ".") for b in _READ_SIGN.finditer(m[0])]
            edits += [x for x in own if not any(x[0] < b and a < x[1] for a, b, _ in edits)]
    return edits


def _emails(text: str) -> Iterator[tuple[int, int]]:
    if "@" in text:
        yield from (m.span() for m in _EMAIL.finditer(text))


# --- phone and identity numbers ------------------------------------------

#: One group of a number, up to a final letter; nothing of a word may follow.
_GROUP = r"[0-9OolI|SB]{1,16}+[A-Z]?+(?![\w@])"
#: A run that may be a number: groups of digits with signs between them, or letters and digits mixed.
#: Groups are atomic and their number is bounded, so that no text takes more than linear time.
_RUN = re.compile(
    rf"(?<![\w@.])(?:[+(]{{0,2}}(?=[0-9OolI|]){_GROUP}\)?(?:(?:[ ./-]{{1,2}}|[ ]?\r?\n|(?<=\)))\(?{_GROUP}\)?){{0,9}}(?:-[A-Z](?![\w@]))?"
    r"|[A-Z]{1,2}[ \r\n]{0,2}\d[\dOlI|SBA-Z .\r\n-]{5,16}(?![\w@]))"
)
_DIGITISED = str.maketrans("OolI|SB", "0011158")
_DIGIT_LIKE = re.compile(r"(?<=[0-9.+/() -])[OolI|SB]+(?=[0-9.+/() -]|\Z)|(?<=\d)[OolI|SB]+(?=\d|\Z)")

#: Shapes of numbers issued to a person (A for any letter).
_IDENTITY_SHAPES = (
    "999-99-9999", "999 99 9999", "AA999999A", "AA 99 99 99 A",
    "99 999 999 999", "99/999/99999", "999/999/99999", "A9999A9999", "A99999999",
    "99AA99999", "A99AA99999", "9 99 99 99 999 999 99", "999999999999999",
    "99.999.999-A", "99999999A", "99999999-A", "A9999999A", "A-9999999-A",
)
#: By country: an international prefix, a trunk zero, or the length and the groups of a national number.
_PLANS = tuple(
    (re.compile(rf"(?:{shape})\Z"), least, most)
    for shape, least, most in (
        (r"\+[1-9][0-9]*+(?:[ .-]{0,2}\(0\))?+(?:[ ./-]?\(?[0-9]++\)?)*+", 8, 15),
        (r"00[ .-]?[1-9][0-9]*+(?:[ ./-]?[0-9]++)*+", 10, 17),
        (r"0[1-9][0-9]{8,10}|\(0[1-9][0-9]{0,4}\)[ /-]?[0-9]+(?:[ -][0-9]+)*|0[1-9](?:\.[0-9]{2}){4}|(?!0[1-9][/-][0-9]{2}[/-][0-9]{4}(?![0-9]))0[1-9][0-9]{0,4}(?:[ /-][0-9]+)+", 9, 12),
        (r"(?:1[ .-])?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}([ .-]))[2-9][0-9]{2}(?:(?(1)\1|[ .-]))[0-9]{4}|[2-9][0-9]{2}[2-9][0-9]{6}", 10, 11),
        (r"[2-9][0-9]{2}-[0-9]{4}", 7, 7),
        (r"[5-9][0-9]{2} [0-9]{3} [0-9]{3}|[5-9][0-9]{2}([ .-])[0-9]{2}\1[0-9]{2}\1[0-9]{2}|[5-9][0-9]{2}-[0-9]{4}-[0-9]{2}", 9, 9),
    )
)


def _in_plan(run: str) -> bool:
    """Whether ``run`` is a telephone number of one of the plans."""
    n = sum(c.isdigit() for c in run)
    if not 7 <= n <= 17:
        return False
    run = re.sub(r"\s+", " ", run)
    return any(least <= n <= most and shape.match(run) for shape, least, most in _PLANS)


_SHAPES = {s: "identity" for s in _IDENTITY_SHAPES}
_NUMBER_WORD = "|".join(map(fold, "number no nr nummer numero número".split()))
#: Words before a number that belongs to a thing, before a time, and before a number issued to a person.
_SHORT_GOODS, _LONG_GOODS = "|".join(map(fold, "lot lote reel room".split())), "|".join(map(fold, "order batch charge bestellung commande pedido auftrag zimmer chambre cuarto".split()))
_OF_GOODS = re.compile(rf"(?:(?<!\w)(?:{_SHORT_GOODS})|{_LONG_GOODS})(?:\s+(?:{_NUMBER_WORD}))?[\s:#,]*\Z")
_OF_TIMES = re.compile(rf"(?:{'|'.join(map(fold, 'says dit dice steht'.split()))})[\s:#]*\Z")
_CLOCK = re.compile(r"[0-9]{2}([:. -])[0-9]{2}\1[0-9]{2}(?:[:. ,-][0-9]{2,3})?\Z")
_OF_PERSONS = re.compile(rf"(?<!\w)(?:{'|'.join(map(fold, 'passport passeport pasaporte identity identité identidad insurance security tax ssn ausweis personalausweis steuernummer sécu dni nie nif'.split()))})(?:\s+(?:{_NUMBER_WORD}|{'|'.join(map(fold, 'is ist est es'.split()))}))*[\s:#?,]*\Z")
#: A number of letters and digits, if a word before it says that it was issued to a person.
_ISSUED = re.compile(r"(?=(?:[A-Z]*[0-9]){5})[A-Z0-9][A-Z0-9-]{5,14}\Z")
_MASK = re.compile(r"[0-9]")
_LETTERS = re.compile(r"[A-Z]")


def _shape(run: str) -> str:
    return _LETTERS.sub("A", _MASK.sub("9", re.sub(r"\s+", " ", run)))


#: Shapes with a fixed 0 or 00 in front are kept apart from their masks.
_MASKED: dict[str, list[tuple[str, str]]] = {}
for _s, _kind in _SHAPES.items():
    _MASKED.setdefault(_s.replace("0", "9"), []).append((_s, _kind))


def _fits(run: str, shape: str) -> bool:
    return all(s != "0" or c == "0" for c, s in zip(re.sub(r"\s+", " ", run), shape))


def _classified(run: str) -> str | None:
    for shape, kind in _MASKED.get(_shape(run), ()):
        if _fits(run, shape):
            return kind
    return "phone" if _in_plan(run) else None


def _owner(kind: str, run: str, before: str) -> str | None:
    """The type of a number by the words before it; None for one of a thing or a time."""
    before = fold(before)
    if _OF_GOODS.search(before) or _CLOCK.match(run) and _OF_TIMES.search(before):
        return None
    return "identity" if kind == "phone" and _OF_PERSONS.search(before) else kind


def _numbers(text: str) -> Iterator[tuple[str, int, int]]:
    pos = 0
    while m := _RUN.search(text, pos):
        start, end = m.span()
        run = m[0]
        pos = end
        if sum(c.isdigit() for c in run) < 5:
            continue
        while run and run[-1] in " .\n\r/-(":
            run, end = run[:-1], end - 1
        for candidate, a, b in _readings(run, start, end):
            kind = _classified(candidate)
            if kind:
                pos = b
                kind = _owner(kind, candidate, text[max(0, a - 40) : a])
                if kind:
                    yield kind, a, b
                break
        else:
            if _ISSUED.match(run) and _OF_PERSONS.search(fold(text[max(0, start - 40) : start])):
                yield "identity", start, end
                continue
            # the number may start at a later word of the run
            later = re.search(r"\s+(?=[+(]?\w)", run)
            if later:
                pos = start + later.end()


def _readings(run: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """The run as it stands, with misread digits, and without a trailing part."""
    yield run, start, end
    digits = _DIGIT_LIKE.sub(lambda m: m[0].translate(_DIGITISED), run)
    if digits != run:
        yield digits, start, end
    if run[:1] in "OolI|":
        yield digits[:1].translate(_DIGITISED) + digits[1:], start, end
    if run[-1:] in "OolI|SB":
        yield digits[:-1] + digits[-1].translate(_DIGITISED), start, end
    if run[:1] == "(" and ")" not in run:
        yield digits[1:], start + 1, end
    for tail in reversed(list(re.finditer(r"\s+", digits))):
        shorter = digits[: tail.start()].rstrip(" .-/(")
        yield shorter, start, start + len(shorter)


#: The words for digits in the languages of the corpus.
_DIGIT_WORDS = {
    **dict(zip("zero one two three four five six seven eight nine".split(), "0123456789")),
    **dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789")),
    **dict(zip("zéro un deux trois quatre cinq six sept huit neuf".split(), "0123456789")),
    **dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789")),
    "oh": "0", "zwo": "2",
}
_ANY_DIGIT_WORD = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
#: Seven or more digits one by one, as words.
_SPELLED = re.compile(rf"(?<![\w])(?:plus\s+)?(?:(?:{_ANY_DIGIT_WORD})(?:[\s,.-]+|(?![\w]))){{7,}}", re.I)


_WORD = re.compile(r"\w+")
#: Words that repeat the next digit.
_REPEATS = {"double": 2, "triple": 3}
_COUNTED = _DIGIT_WORDS.keys() | _REPEATS.keys()
_ITEM = rf"(?:(?:(?:double|triple)\s+)?(?:{_ANY_DIGIT_WORD})(?!\w)|[0-9]{{1,12}}(?![\w:%]))"
#: A number with digits in words, figures between them or not. Sentence signs part words from words only.
_MIXED = re.compile(rf"(?<!\w)(?:(?<![.,@:/-])(?=[+(0-9])|(?=[^\W\d]))(?:plus\s+|\+|\()?{_ITEM}(?:(?:[ ()-]{{1,3}}|[ -]?\r?\n|[,.]\s(?![0-9])(?<![0-9][,.]\s)){_ITEM})++", re.I)
_PART = re.compile(rf"(double|triple)\s+|({_ANY_DIGIT_WORD})(?!\w)|[0-9]+|[,.-]\s*", re.I)


def _figure_edits(text: str, a: int, b: int) -> tuple[list[tuple[int, int, str]], int]:
    """Edits that put figures in place of the words of a number, and how many digits were words.

    Signs between words become dashes, blanks go.
    """
    edits, spelled, times, at, begun = [], 0, 1, a, None
    for m in _PART.finditer(text, a, b):
        start = m.start() if begun is None else begun
        if start > at and begun is None:
            edits.append((at, start, "+" if re.match(r"\+|plus\b", text[at:start], re.I) else ""))
        if m[1]:
            times, begun = _REPEATS[m[1].lower()], start
            at = m.end()
            continue
        if m[2]:
            word = m[2].lower().replace("ſ", "s").replace("ı", "i").replace("i̇", "i")
            edits.append((start, m.end(), _DIGIT_WORDS[word] * times))
            spelled += times
        elif not m[0][0].isdigit():
            edits.append((start, m.end(), "-"))
        times, at, begun = 1, m.end(), None
    return edits, spelled


def _figures(text: str, a: int, b: int) -> tuple[str, int]:
    edits, spelled = _figure_edits(text, a, b)
    return Layer(text[a:b], [(x - a, y - a, new) for x, y, new in edits]).text, spelled


def _spelled_runs(text: str) -> list[tuple[int, int]]:
    """Where numbers are written in words or partly so."""
    words = _digit_words(text)
    if words < 3:  # most texts have fewer
        return []
    found: list[tuple[int, int]] = []
    for m in _MIXED.finditer(text):
        start, end = m.span()
        run = m[0]
        if run[0] == "(" and ")" not in run:
            start, run = start + 1, run[1:]
        whole = _SPELLED.search(run)
        if whole:
            # seven words are a number without figures after them, or before them but for a prefix
            end = start + whole.start() + len(whole[0].rstrip(" ,.-\r\n"))
            if run[0] not in "+(0":
                start += whole.start()
        elif not any(c.isdigit() for c in run) and not re.search(r"double|triple", run, re.I):
            continue
        figures, spelled = _figures(text, start, end)
        if spelled >= 3 and 7 <= sum(c.isdigit() for c in figures) <= 15:
            found.append((start, end))
    if words >= 7:
        for m in _SPELLED.finditer(text):
            a, b = m.start(), m.start() + len(m[0].rstrip(" ,.-\r\n"))
            if not any(a < y and x < b for x, y in found):
                found.append((a, b))
    return sorted(found)


class Plain(NamedTuple):
    """A text without disguises: signs and figures as such; ``spelled`` are the numbers that were words."""

    text: str
    layer: Layer | None
    spelled: list[tuple[int, int]]


def undisguised(text: str) -> Plain:
    runs = _spelled_runs(text)
    edits = [e for a, b in runs for e in _figure_edits(text, a, b)[0]]
    for e in sorted(_signs(text)):
        if not any(e[0] < b and a < e[1] for a, b in runs) and not (edits and e[0] < edits[-1][1] and edits[-1][0] < e[1]):
            edits.append(e)
    if not edits:
        return Plain(text, None, [])
    edits.sort()
    moved, shift, n = [], 0, 0
    for a, b in runs:
        while n < len(edits) and edits[n][1] <= a:
            shift += len(edits[n][2]) - edits[n][1] + edits[n][0]
            n += 1
        start = a + shift
        while n < len(edits) and edits[n][1] <= b:
            shift += len(edits[n][2]) - edits[n][1] + edits[n][0]
            n += 1
        moved.append((start, b + shift))
    layer = Layer(text, edits)
    return Plain(layer.text, layer, moved)


def _all_numbers(said: Plain) -> Iterator[tuple[str, int, int]]:
    """Numbers of persons; one that was written in words may be any local number."""
    for a, b in said.spelled:
        run = said.text[a:b]
        kind = _owner(_classified(run) or "phone", run, said.text[max(0, a - 40) : a])
        if kind:
            yield kind, a, b
    yield from ((kind, a, b) for kind, a, b in _numbers(said.text) if not any(a < y and x < b for x, y in said.spelled))


def _digit_words(text: str) -> int:
    """Words of ``text`` that name a digit, in any case that ``re.I`` takes for the same."""
    if not text.isascii():
        text = text.replace("ſ", "s").replace("ı", "i").replace("İ", "i")
    return sum(map(_COUNTED.__contains__, _WORD.findall(text.lower())))


# --- street addresses ----------------------------------------------------

_HOUSE = re.compile(r"(?<![\w.,:/@+-])([0-9OlI|]{1,4}[A-Za-z]?)(?![\w@:/-])(\s+(?:bis|ter|quater)\b)?", re.I)
_UPPER = "A-ZÀ-ÖØ-ÞŒ0-9|?�"
_NAME = rf"[{_UPPER}][\w|?�'’]*(?:-(?:\r?\n)?[\w|?�'’]+)*"
#: Kinds of street by language.
_EN_KINDS = {skeleton(w) for w in "st street ave avenue lane road rd close drive dr way court ct crescent place boulevard blvd terrace row gardens grove mews".split()}
#: House numbers that may be years.
_YEAR = re.compile(r"(?:1[6-9]|20)[0-9]{2}\Z")
_FR_KINDS = "|".join(map(fold, (r"rue avenue av\. boulevard bd\.? impasse quai place chemin allee route cours passage square sentier venelle").split()))
_ES_KINDS = r"e/|ealle|avda\.?|avenlda|plaza|pza\.?|paseo|eamlno|ronda|travesla|glorleta|earretera|eallejon|euesta"
_DE_ENDS = r"(?:stra(?:ss|.)e|str\.?|gasse|weg|stleg|platz|allee|rlng|ufer|damm|ebaussee|pfad|zelle)"
_EN_STREET = re.compile(rf"\s+((?:{_NAME}\s+){{1,3}}?)({_NAME})(\.)?(?![\w])")
#: Kinds that are common words too, taken only in mixed case and after no year.
_EN_BY_NAME = re.compile(rf"\s+(?:Broadway|(?:{_NAME}\s+){{1,3}}?(?:Walk|Circle|Square|Sq|Parkway|Pkwy|Highway|Hwy))(?!\w)")
_FR_STREET = re.compile(rf",?\s+(?:{_FR_KINDS})\s+(?:(?:de\s+la|du|des|de|aux|au|a\s+la)\s+|(?:de\s+)?[ld]['’])?")
_FR_NAME = re.compile(rf"{_NAME}(?: (?![0-9]){_NAME})*")
_ES_BEFORE = re.compile(rf"(?<!\w)(?:{_ES_KINDS})\s*(?:de\s+(?:la|los|las|el)\s+|del\s+|de\s+)?[\w?�'-]+(?:\s+[\w?�'-]+)??,?\s+(?:n[\Wo]?\.?\s*)?\Z")
_DE_BEFORE = re.compile(rf"(?<![\w-])(?:(?:(?:alte|neue|grosse|klelne|obere|untere|blntere)[rn]?|am|lm|zum|zur|an\s+der|auf\s+der)\s+)?[\w?�-]{{2,}}{_DE_ENDS},?\s+\Z")


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _HOUSE.finditer(text):
        if not any(c.isdigit() for c in m[1]):
            continue
        start, end = m.span()
        en = _EN_STREET.match(text, end) if not m[2] else None
        if en:
            words = en[1].split()
            for n in range(1, len(words) + 1):  # the first word that is a kind of street ends it
                if n < len(words) and skeleton(words[n].rstrip(".")) in _EN_KINDS:
                    break
            if skeleton(en[2].rstrip(".")) in _EN_KINDS:
                yield start, en.end(3) if en[3] and skeleton(en[2]) in _ABBREVIATED else en.end(2)
                continue
        named = _EN_BY_NAME.match(text, end) if not m[2] and not _YEAR.match(m[1]) else None
        if named:
            yield start, named.end()
            continue
        longer = _longer_street(text, end) if not m[2] else None
        if longer:
            yield start, longer
            continue
        fr = _FR_STREET.match(fold(text[end : end + 60]))
        if fr:
            name = _FR_NAME.match(text, end + fr.end())
            if name:
                first = re.match(_NAME, name[0])
                yield start, name.start() + (len(first[0]) if name[0].isupper() else len(name[0]))
                continue
        before = text[max(0, start - 60) : start]
        if "\x00" in before:
            before = before[before.rindex("\x00") + 1 :]
        folded = fold(before)
        back = _ES_BEFORE.search(folded) or _DE_BEFORE.search(folded)
        if back and re.search(rf"[{_UPPER}]", before[back.start() :]) and not before[back.start()].islower() or (back and folded[back.start() : back.start() + 2] == "e/"):
            yield start - len(before) + back.start(), end if not m[2] else m.end(1)


#: Fixed value: kinds of street that are written with a closing dot.
_ABBREVIATED = {skeleton("ave"), skeleton("blvd"), skeleton("rd"), skeleton("dr"), skeleton("ct")}


def _longer_street(text: str, at: int) -> int | None:
    """End of ``Name Name Kind`` after a house number, if a kind comes within four words."""
    pos, n = at, 0
    while n < 4:
        m = re.compile(rf"\s+({_NAME})(\.)?").match(text, pos)
        if not m:
            return None
        n += 1
        if n > 1 and skeleton(m[1]) in _EN_KINDS:
            return m.end(2) if m[2] and skeleton(m[1]) in _ABBREVIATED else m.end(1)
        if m[2]:
            return None
        pos = m.end(1)
    return None


# --- names of persons ----------------------------------------------------

_CAPITAL = re.compile(rf"(?<![\w'’@.+-])[A-ZÀ-ÖØ-ÞŒ015|�?][\w|�]+(?:\?[\w|�]+)*")
_AFTER = re.compile(rf"([?�]?\s+(?:[A-ZÀ-Þ]\.\s*){{0,3}})([{_UPPER}][\w|�]*(?:\?[\w|�]+)*(?:-[{_UPPER}][\w|�]+)?)")
_INITIALS = re.compile(r"(?:\s+[A-ZÀ-Þ]\.){0,3}")
_BEFORE = re.compile(rf"(?<![\w'’@.+-])([{_UPPER}][\w|�]*(?:\?[\w|�]+)*(?:-[{_UPPER}][\w|�]+)?)(,?\s+)\Z")


class Names:
    """Given names and known family names, recognised in damaged spelling too."""

    def __init__(self, given: list[str], family: list[str]):
        self.given = {plain(n) for n in given}
        self.given_skeletons = {skeleton(n) for n in given}
        self.family = {skeleton(n) for n in family}
        self.lengths: dict[int, list[str]] = {}
        for n in self.given:
            self.lengths.setdefault(len(n), []).append(n)
        self.family_lengths: dict[int, list[str]] = {}
        for n in sorted({plain(n) for n in family}):
            self.family_lengths.setdefault(len(n), []).append(n)
        self.memo: dict[str, bool] = {}

    def is_given(self, word: str) -> bool:
        known = self.memo.get(word)
        if known is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            known = self.memo[word] = self._is_given(word)
        return known

    def _is_given(self, word: str) -> bool:
        p = plain(word)
        if p in self.given or skeleton(word) in self.given_skeletons:
            return True
        if "�" in p or "?" in p:
            return any(near(p, n) for n in self.lengths.get(len(p), ()))
        # a last letter lost to ``?`` is left outside the word
        return False

    def listed_family(self, word: str) -> str | None:
        """The key of the listed family name that ``word`` is, with lost letters too."""
        key = skeleton(word)
        if key in self.family:
            return key
        p = plain(word)
        if "�" not in p and "?" not in p or sum(c in "�?" for c in p) * 3 > len(p):
            return None
        return next((skeleton(n) for n in self.family_lengths.get(len(p), ()) if all(x == y or x in "�?" for x, y in zip(p, n))), None)

    def ends_lost(self, word: str) -> bool:
        p = plain(word) + "�"
        return any(near(p, n) for n in self.lengths.get(len(p), ()))


def _is_caps(word: str) -> bool:
    return word.upper() == word


def _in_mixed_line(text: str, start: int, end: int) -> bool:
    """Whether the words right before and after a name in its line are in lower case."""
    first = max(text.rfind("\n", 0, start), text.rfind("\x00", 0, start)) + 1
    before, after = _LAST_WORD.search(text[max(first, start - 30) : start]), _NEXT_WORD.match(text, end)
    return bool(before or after) and not any(m and 2 * sum(c.isupper() for c in m[1]) > len(m[1]) for m in (before, after))  # misread letters are small


_LAST_WORD = re.compile(r"([^\W\d_]{2,})[^\w\n.!?:]*\Z")
_NEXT_WORD = re.compile(r"[^\w\n.!?:]*([^\W\d_]{2,})")


def _persons(text: str, names: Names) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, family, sure) of given and family names together."""
    for m in _CAPITAL.finditer(text):
        word = m[0]
        start, end = m.span()
        lost = text[end : end + 1] in ("?", "�") and names.ends_lost(word)
        if not (names.is_given(word) or lost):
            continue
        after = _AFTER.match(text, end)
        if after and len(after[2]) > 2 and not (after[1][:1] in "?�" and not lost):
            family = after[2]
            key = skeleton(family)
            listed = names.listed_family(family)
            # a last letter lost to ``?`` is left outside the name
            cut = listed is None and text[after.end() : after.end() + 1] == "?" and names.listed_family(family + "?")
            if listed or cut:
                yield start, after.end() + bool(cut), listed or cut, True
                continue
            if not names.is_given(family):
                caps = _is_caps(family)
                # in a line of capitals any word may follow a given name, in one of mixed case none is shouted
                if not _is_caps(word) if not caps else _is_caps(word) and _in_mixed_line(text, start, after.end()):
                    yield start, after.end(), key, True
                    continue
                if caps:
                    yield start, after.end(), key, False
        before = _BEFORE.search(text, max(0, start - 48), start)
        listed = names.listed_family(before[1]) if before else None
        if before and len(before[1]) > 2 and (not names.is_given(before[1]) or listed):
            key = listed or skeleton(before[1])
            tail = _INITIALS.match(text, end + lost)
            # after a comma any word may come before a given name: it has to be a known family name
            yield before.start(1), tail.end(), key, listed is not None


# --- the operator --------------------------------------------------------


def find_spans(text: str, names: Names) -> list[tuple[str, int, int, str | None, bool]]:
    """(type, start, end, family key, sure) in characters of ``text``."""
    at = traced(text)
    clean = at.text
    said = undisguised(clean)
    found: list[tuple[str, int, int, str | None, bool]] = []
    for kind, a, b in [*(("email", a, b) for a, b in _emails(said.text)), *_all_numbers(said)]:
        found.append((kind, *(said.layer.source(a, b) if said.layer else (a, b)), None, True))
    numbers = [(a, b) for _, a, b, _, _ in found]
    for a, b in _addresses(clean):
        if not any(a < y and x < b for x, y in numbers):
            found.append(("address", a, b, None, True))
    for a, b, key, sure in _persons(clean, names):
        found.append(("person", a, b, key, sure))
    return [(kind, *at.source(a, b), key, sure) for kind, a, b, key, sure in found]


def _detect(names: Names):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc, kind, a, b, key, sure) for doc, text in zip(batch["doc_id"], batch["text"]) if text for kind, a, b, key, sure in find_spans(text, names)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SPANS.split(", ")])

    return run


def personal_data(docs: DataFrame, name_list: DataFrame, doc: str = "doc_id", text: str = "text", limit: int = 2_000_000) -> DataFrame:
    """``doc_id, pii_type, char_start, char_end``: each span of personal data.

    Offsets count code points of the text as stored. Types are ``email``,
    ``phone``, ``identity``, ``address`` and ``person``. A name needs a given
    name of ``name_list``; a family name that isn't listed is taken from
    mixed-case text as it stands, in capitals too if the words beside the
    name aren't, and where a line of capitals or a comma leave it open, if
    the corpus has it after a given name elsewhere (letters lost to U+FFFD
    or ``?`` may be any). Null and empty
    texts hold nothing; rows that repeat a ``doc_id`` are merged; further
    columns are ignored; an empty table gives an empty result. ``limit`` is
    the most names the list may have.
    """
    picked = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL AND doc_id IS NOT NULL")
    spans = staged(picked.mapInPandas(_detect(_names(name_list, limit)), _SPANS), "spans")
    sure, open_ = spans.where("sure"), spans.where("NOT sure")
    kept = sure.unionByName(_resolved(open_, sure).select(sure.columns))
    return kept.select("doc_id", "pii_type", "char_start", "char_end").distinct()


def _names(name_list: DataFrame, limit: int) -> Names:
    listed = small_rows(name_list.select("name_part", "part_kind").where("name_part IS NOT NULL").distinct(), limit, "the list of names")
    return Names([r.name_part for r in listed if r.part_kind == "given"], [r.name_part for r in listed if r.part_kind == "family"])


def _resolved(open_: DataFrame, sure: DataFrame) -> DataFrame:
    """The open spans whose family name the corpus has in a sure one; lost letters match any."""
    learned = sure.where("pii_type = 'person'").select("family").distinct()
    # both sides are as few as there are names
    lost = open_.where("family RLIKE '[?\ufffd]' AND 3 * length(translate(family, '?\ufffd', '')) >= 2 * length(family)").select("family").distinct()
    pairs = lost.join(learned.select(F.col("family").alias("whole")), F.expr("length(family) = length(whole) AND whole LIKE translate(family, '?\ufffd', '__')"), "left_semi")
    return open_.join(learned.unionByName(pairs).distinct(), "family", "left_semi")


def _covered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans in order, overlapping ones merged under the type of the first."""
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2])
        else:
            out.append((a, b, kind))
    return out


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced by its type in brackets."""
    parts, at = [], 0
    for a, b, kind in _covered(spans):
        parts += (text[at:a], f"[{kind.upper()}]")
        at = b
    return "".join([*parts, text[at:]])


_TEXTS = "row long, doc_id long, text string, spans array<struct<pii_type: string, char_start: int, char_end: int, family: string, sure: boolean>>"


def redact(docs: DataFrame, name_list: DataFrame, doc: str = "doc_id", text: str = "text", limit: int = 2_000_000) -> DataFrame:
    """``doc_id, text, n_spans``: the texts with placeholders for personal data.

    The spans are those of ``personal_data``, found in the same pass over the
    texts; only documents with a name that the corpus decides are shuffled.
    Every row comes out, also one without spans, with null text or with a
    ``doc_id`` that others have too.
    """
    names = _names(name_list, limit)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(spans=[[dict(zip(("pii_type", "char_start", "char_end", "family", "sure"), x)) for x in find_spans(t, names)] if t else [] for t in batch["text"]])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    held = staged(rows.mapInPandas(find, _TEXTS), "texts")
    sure = F.filter("spans", lambda s: s.sure)
    is_open = F.exists("spans", lambda s: ~s.sure)
    each = held.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    more = _resolved(each.where("NOT sure"), each.where("sure")).groupBy("row").agg(F.collect_list(F.struct("pii_type", "char_start", "char_end", "family", "sure")).alias("more"))
    opened = held.where(is_open).join(more, "row", "left").select("doc_id", "text", F.when(F.col("more").isNull(), sure).otherwise(F.concat(sure, "more")).alias("spans"))
    settled = held.where(~is_open).select("doc_id", "text", "spans").unionByName(opened)

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [{(s["char_start"], s["char_end"], s["pii_type"]) for s in spans} for spans in batch["spans"]]
            texts = [redacted(t, list(x)) if x else t for t, x in zip(batch["text"], own)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts, "n_spans": list(map(len, own))})

    return settled.mapInPandas(replace, "doc_id long, text string, n_spans int")
