"""Personal data: base patterns, and offset-preserving deobfuscation.

Base spans, leftmost and non-overlapping per kind (email, ip, card, phone), are
found in the text as it stands.  Then a chain of transducers rewrites a copy of
the text; each keeps, for every character it writes, where its source starts and
ends, so a span found in the rewritten text maps back to source characters:

1. look-alikes: compatibility forms (full width, mathematical, circled), digits
   of other scripts, Cyrillic and Greek letters that look Latin, odd dashes, dots
   and spaces; invisible characters are deleted;
2. letters that look like digits (O, I, l) inside a number;
3. spelled dots, then spelled at signs: in brackets or between marks always, as
   bare words only where they join parts of an address (a bare "at" must be
   followed by a name with a spelled dot, or stand between a local part that is
   evidently one and a name that ends in a known top-level label, so "look at
   example.com", "version 2.0 at example.com" and "jane.doe at work.Thanks" are
   left alone); character references of both;
4. spelled digits, "double" and "triple" ones too, but none that ends a larger
   number ("twenty one"); and "plus" before a number.

What the same patterns find there is added where it does not lie within a base
span of its kind; a wider one stands beside it.  Base spans are never changed.  A text that none of the transducers can
change is searched once.

Offsets are code points, ends exclusive.  Null counts as empty.  Every row is
searched by itself, so ties and repeated rows need no rule; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import require_columns, text_slices

KINDS = ("email", "ip", "card", "phone")
EMPTY_HASH = hashlib.sha256(b"").hexdigest()

# Letters of other scripts and the Latin ones that they look like.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "п": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "З": "3", "з": "3", "б": "6",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "υ": "u", "ι": "i", "κ": "k", "ε": "e", "η": "n", "ω": "w", "χ": "x",
    "τ": "t", "γ": "y", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "ѵ": "v", "ƍ": "g", "ℓ": "l",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "﹣": "-",
    "。": ".", "․": ".", "｡": ".", "·": ".", "•": ".", "∙": ".", "⋅": ".",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\ufeff\u180e"
# The digits 0 to 9 in the corpus languages (other spellings after a bar).
SPELLED = {
    "en": "zero|oh one two three four five six seven eight nine",
    "de": "null eins zwei|zwo drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
# Tens of the corpus languages; a digit word after one is not a digit of its own.
TENS = ("twenty thirty forty fifty sixty seventy eighty ninety "
        "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig "
        "vingt trente quarante cinquante soixante septante huitante nonante "
        "veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa")
TIMES = {"double": 2, "triple": 3}
# The words for the at sign that are used for nothing else, and those for the dot.
ONLY_AT_WORDS = "arroba|arobase|chiocciola"
AT_WORDS = "at|" + ONLY_AT_WORDS
DOT_WORDS = "dot|punkt|punto|point|ponto"
# Top-level labels after which a bare "at" is believed.
TOP_LEVEL = ("com org net edu gov mil int info biz name pro io ai app dev me tv cc co online site xyz "
             "eu de at ch fr be lu es pt it nl uk ie dk se no fi is pl cz sk hu ro bg gr hr si rs ua ru tr "
             "us ca mx ar br cl pe ve uy in cn jp kr tw hk sg au nz za il ae test example invalid local")


def spelled_digits() -> dict[str, str]:
    return {name: str(digit) for line in SPELLED.values()
            for digit, names in enumerate(line.split()) for name in names.split("|")}


class Finder:
    """Compiled patterns of one worker."""

    def __init__(self):
        self.domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
        self.local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
        self.numbers = re.compile(r"[0-9]+(?:\.[0-9]+)*")
        self.card = re.compile(r"[0-9](?:[ -]?[0-9])+")
        self.phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
        digits = spelled_digits()
        self.digits = digits
        names = "|".join(sorted(digits, key=len, reverse=True))
        # a run of blanks is entered at its first one only: long runs take linear time
        open_, close = r"(?<!\s)\s*[\[({<]\s*", r"\s*[\])}>]\s*"
        self.odd = re.compile(r"[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]")
        self.digit_letters = re.compile(r"(?<![A-Za-z0-9])(?=[OoIl]*[0-9])[0-9OoIl]+(?![A-Za-z0-9@])")
        soft = r"\s*[*|=~\"'_-]{1,2}\s*"          # marks that set a word off without being brackets
        self.dot = re.compile(rf"(?i:{open_}(?:{DOT_WORDS}|\.){close}|(?<=[a-z0-9]){soft}(?:{DOT_WORDS}){soft}(?=[a-z0-9])|"
                              rf"&#0*46;|&#x0*2e;|%2e|"
                              rf"(?<=[a-z0-9])[\s_]+(?:{DOT_WORDS})[\s_]+(?=[a-z0-9]))")
        self.at = re.compile(rf"(?i:{open_}(?:{AT_WORDS}|@){close}|(?<=[a-z0-9]){soft}(?:{AT_WORDS}){soft}(?=[a-z0-9])|"
                             rf"&#0*64;|&#x0*40;|%40|(?<!\s)\s+(?:{ONLY_AT_WORDS})\s+)")
        # a bare "at" stands before a name that goes on with a spelled dot (see ``deobfuscate``)
        self.bare_at = re.compile(r"(?i:(?<=[a-z0-9._%+-])[\s_]+at[\s_]+(?=([a-z0-9-]+(?:\.[a-z0-9-]+)+)))")
        # ... or after a local part that is evidently one (see ``evident``)
        top = "|".join(TOP_LEVEL.split())
        self.evident_at = re.compile(rf"(?i:(?<=[a-z0-9])\s+at\s+(?=[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:{top})(?![a-z0-9_-]|\.[a-z0-9])))")
        one = rf"(?:(?:{'|'.join(TIMES)})[\s-]+)?(?:{names})"
        self.spelled = re.compile(rf"(?i:(?<![^\W_]){one}(?:[\s,-]+{one})*(?![^\W_]))")
        self.name = re.compile(rf"(?i:(?:({'|'.join(TIMES)})[\s-]+)?({names}))")
        self.tens = re.compile(rf"(?i:(?<![^\W_])(?:{'|'.join(TENS.split())})[\s-]{{1,8}}\Z)")
        self.plus = re.compile(r"(?i:(?:(?<![^\W_])plus\s*|\+\s+)(?=[0-9]))")

    # -- patterns -----------------------------------------------------------------
    def emails(self, text):
        end = 0
        at = text.find("@")
        while at >= 0:
            start = at
            while start > end and text[start - 1] in self.local:
                start -= 1
            found = self.domain.match(text, at + 1) if start < at else None
            if found:
                end = found.end()
                yield start, end
            at = text.find("@", max(at + 1, end))

    def ips(self, text):
        # a run of dotted numbers holds its matches four numbers at a time
        for run in self.numbers.finditer(text):
            parts = run[0].split(".")
            start = run.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k:k + 4]
                end = start + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    yield start, end
                start = end + 1

    def cards(self, text):
        for m in self.card.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()

    def phones(self, text):
        for m in self.phone.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield m.span()

    def spans(self, text):
        """(kind number, start, end) in kind and text order."""
        return [(k, s, e) for k, find in enumerate((self.emails, self.ips, self.cards, self.phones))
                for s, e in find(text)]

    # -- transducers --------------------------------------------------------------
    def deobfuscate(self, text: str):
        """(rewritten text, source start and end of each of its characters), or None if unchanged."""
        tape = Tape(text)
        tape.rewrite(self.odd, lambda m: look_alike(m[0]))
        tape.rewrite(self.digit_letters, lambda m: m[0].translate(DIGIT_LETTERS))
        dots = tape.rewrite(self.dot, lambda m: ".")
        tape.rewrite(self.at, lambda m: "@")
        if dots:
            # only where a dot of the name was a spelled one
            tape.rewrite(self.bare_at, lambda m: "@" if tape.written[slice(*m.span(1))].any() else None)
        tape.rewrite(self.evident_at, lambda m: "@" if self.evident(m) else None)
        tape.rewrite(self.spelled, self.spelled_number)
        tape.rewrite(self.plus, lambda m: "+" if m[0][0] != "+" or tape.written[m.end()] else None)
        return tape if tape.changed else None

    def evident(self, m) -> bool:
        """Whether a bare "at" follows a local part: a dot, a plus or an underscore inside, and a word."""
        text, start = m.string, m.start()
        while start and text[start - 1] in self.local:
            start -= 1
        local = text[start:m.start()]
        return (local[0].isalnum() and any(c in ".+_" for c in local) and bool(WORD.search(local))
                and not local.lower().startswith("www.") and ".." not in local)

    def spelled_number(self, m):
        """The digits of a run of digit words, or None where it ends a larger number."""
        if self.tens.search(m.string, max(0, m.start() - 24), m.start()):
            return None
        return [(n.start(), n.end(), self.digits[n[2].lower()] * TIMES.get((n[1] or "").lower(), 1))
                for n in self.name.finditer(m[0])]

    def all_spans(self, text: str):
        """(base spans, all spans) of a text."""
        base = self.spans(text)
        tape = self.deobfuscate(text)
        if tape is None:
            return base, base
        added = []
        for kind, s, e in self.spans(tape.text):
            start, end = int(tape.start[s]), int(tape.end[e - 1])
            before = bisect_right(base, (kind, start, len(text))) - 1    # the last base span from ``start`` or before
            if before < 0 or base[before][0] != kind or base[before][2] < end:
                added.append((kind, start, end))
        return base, sorted(base + added)


class Tape:
    """A text being rewritten, with each character's source span."""

    def __init__(self, text: str):
        self.text, self.changed = text, False
        self.start = np.arange(len(text))
        self.end = self.start + 1
        self.written = np.zeros(len(text), bool)

    def rewrite(self, pattern, write) -> int:
        """Replace the matches for which ``write`` gives something new.

        ``write`` returns a string, whose characters all stand for the whole match;
        or pieces (start, end, string) within it, what lies between being deleted;
        or None to leave the match alone.
        """
        pieces = []
        for m in pattern.finditer(self.text):
            new = write(m)
            if new is None or new == m[0]:
                continue
            if isinstance(new, str) and len(new) == len(m[0]):     # character by character
                new = [(i, i + 1, c) for i, c in enumerate(new)]
            elif isinstance(new, str):
                new = [(0, len(m[0]), new)]
            pieces.append((m.start(), m.end(), [(m.start() + a, m.start() + b, s) for a, b, s in new]))
        if not pieces:
            return 0
        texts, starts, ends, written, at = [], [], [], [], 0
        for lo, hi, news in pieces:
            texts.append(self.text[at:lo])
            starts.append(self.start[at:lo])
            ends.append(self.end[at:lo])
            written.append(self.written[at:lo])
            for a, b, s in news:
                texts.append(s)
                starts.append(np.full(len(s), self.start[a]))
                ends.append(np.full(len(s), self.end[b - 1]))
                written.append(np.ones(len(s), bool))
            at = hi
        texts.append(self.text[at:])
        self.start = np.concatenate([*starts, self.start[at:]])
        self.end = np.concatenate([*ends, self.end[at:]])
        self.written = np.concatenate([*written, self.written[at:]])
        self.text, self.changed = "".join(texts), True
        return len(pieces)


DIGIT_LETTERS = str.maketrans("OoIl", "0011")
WORD = re.compile(r"[A-Za-z]{2}")


def look_alike(c: str) -> str:
    """The plain character that ``c`` looks like, itself if there is none, "" if it is invisible."""
    if c in INVISIBLE:
        return ""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() else c


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def write_spans(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def gate() -> str:
    """What a text must hold for a pattern or a transducer to find anything (RE2 syntax).

    Every span holds a digit or an at sign: as it stands, from a look-alike, from an at
    word or from spelled digits.  A bare "at" also takes a spelled dot or a local part
    that is evidently one.  The classes are the transducers' own or wider.
    """
    blank = r"\s\x0b\x1c-\x1f"          # what Python's \s has besides RE2's; others are look-alikes
    changed = "".join(rf"\x{{{n:x}}}" for n in range(0x80, 0x100) if n <= 0xa0 or look_alike(chr(n)) != chr(n))
    marks = blank + r"*|=~\"'_-"
    names = "|".join(sorted([*spelled_digits(), *TIMES], key=len, reverse=True))
    return "|".join([
        rf"[0-9@{changed}]|[^\x{{0}}-\x{{ff}}]",
        rf"(?i:[\[({{<][{blank}]*(?:{AT_WORDS}|{DOT_WORDS}|\.)[{blank}]*[\])}}>])",
        rf"(?i:[{marks}](?:{DOT_WORDS}|{ONLY_AT_WORDS})[{marks}])",
        rf"(?i:[*|=~\"'_-][{blank}]*(?:{AT_WORDS})[{blank}]*[*|=~\"'_-])",
        rf"(?i:[._+][a-z0-9._%+-]*[{blank}]+at[{blank}]+[a-z0-9-]+\.)",
        # a number spelled in full takes several digit words in a row
        rf"(?i:(?:{names})(?:[{blank},.()-]+(?:{names})){{3}})"])


def find_private(docs: DataFrame, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """``keep`` columns; n_email, n_ip, n_card, n_phone and base_sha256 of the base spans;
    spans (all, as kind:start:end), n_added (spans that are no base ones) and n_spans (all)."""
    require_columns(docs, text, *keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    width = len(keep)
    counts = [f"n_{k}" for k in KINDS]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        finder = Finder()
        may_hold = gate()
        nothing = (0, 0, 0, 0, EMPTY_HASH, "", 0, 0)
        for whole in batches:
            for batch in text_slices(whole, "_text"):
                texts = pc.fill_null(batch.column(width), "")
                likely = pc.match_substring_regex(texts, may_hold).to_pylist()
                out = []
                for value, found in zip(texts, likely):
                    if not found:
                        out.append(nothing)
                        continue
                    base, every = finder.all_spans(value.as_py())
                    by_kind = [sum(k == i for k, _, _ in base) for i in range(len(KINDS))]
                    out.append((*by_kind, hashlib.sha256(write_spans(base).encode()).hexdigest(),
                                write_spans(every), len(every) - len(base), len(every)))
                columns = list(zip(*out))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in range(width)),
                     *(pa.array(list(c), t) for c, t in zip(columns, kinds))],
                    names=[*keep, *counts, "base_sha256", "spans", "n_added", "n_spans"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(
        run, f"{kept}, {', '.join(c + ' long' for c in counts)}, base_sha256 string, spans string, n_added long, n_spans long")
