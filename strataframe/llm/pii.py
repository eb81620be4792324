"""Personal data in texts, also where it is disguised.

Method: offset-preserving deobfuscation. Transducers turn a text into a plainer one and keep, for every
character written, the range of source characters it stands for: homoglyphs become ASCII, spelled digits
become digits, and disguised "at" and "dot" become signs. Identifiers found in the plain text are mapped
back to source ranges. Each transducer keeps the tokens it doesn't know.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

KINDS = ("email", "ip", "card", "phone")
#: Possessive runs and look-behinds change no match: one that fails from the first character of a run fails from the
#: others too, and without them a long run would be tried from each.
_EMAIL_HERE = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-]){_EMAIL_HERE.pattern}")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Look-alikes that compatibility normalisation leaves as they are.
HOMOGLYPHS = dict(
    zip(
        "авеісԁһјкорԛѕԝхуАВЕІСНЈКМОРЅТХУԜԚαικνορυΑΒΕΗΙΚΜΝΟΡΤΥΧΖ",
        "abeicdhjkopqswxyABEICHJKMOPSTXYWQaiknopuABEHIKMNOPTYXZ",
        strict=True,
    )
)
#: Written without width; they are dropped.
INVISIBLE = "​‌‍⁠﻿­"
DIGITS = {
    **dict(zip("zero one two three four five six seven eight nine".split(), "0123456789", strict=True)),
    "oh": "0",
    **dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789", strict=True)),
    **dict(zip("zéro un deux trois quatre cinq six sept huit neuf".split(), "0123456789", strict=True)),
    **dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789", strict=True)),
}
_DIGIT_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
#: A run of seven spelled or written digits at least, of which one is spelled.
_SPELLED = re.compile(rf"(?<!\w)(?:(?:plus[\x20-]+)?(?:{_DIGIT_WORD})(?!\w)|\+?[0-9])(?:(?:[\x20,.()-]|dot|point){{1,4}}(?:(?:{_DIGIT_WORD})(?!\w)|[0-9])|(?<=[0-9])[0-9]){{6,}}(?!\w)", re.I)
_SPELLED_TOKEN = re.compile(rf"(?<!\w)(?:{_DIGIT_WORD}|plus|dot|point)(?!\w)", re.I)
_SOME_DIGITS = rf"(?:(?:{_DIGIT_WORD})(?!\w)|[0-9]{{1,3}}(?!\w))"
_NUMBER = rf"{_SOME_DIGITS}(?:[\x20-]{{1,2}}{_SOME_DIGITS}){{0,2}}"
_JOINT = r"(?:[\x20-]{1,2}(?:dot|point)[\x20-]{1,2}|\x20?\.\x20?)"
#: Four numbers joined by dots, of which something is spelled; no part of a longer chain.
_SPELLED_IP = re.compile(rf"(?<!\w)(?<!dot\x20)(?<!point\x20)(?<!\.){_NUMBER}(?:{_JOINT}{_NUMBER}){{3}}(?!{_JOINT}{_SOME_DIGITS}|[\x20-]{{1,2}}{_SOME_DIGITS}|\w)", re.I)
_IP_TOKEN = re.compile(rf"(?:{_DIGIT_WORD}|dot|point)(?!\w)|[0-9]+|\.", re.I)
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_AT = rf"(?:\s*{_OPEN}\s*(?:at|@|arroba|arobase)\s*{_CLOSE}\s*|\s+at\s+|\s+@\s*|@\s+)"
_DOT = rf"(?:\s*{_OPEN}\s*(?:dot|\.|punkt|punto|point)\s*{_CLOSE}\s*|\s+(?:dot|punkt|punto)\s+)"
_PART = r"[A-Za-z0-9_%+-]+"
#: A disguised address: a disguised at with at least one dot, or a plain at with a disguised dot.
_LOCAL = re.compile(rf"{_PART}(?:(?:\.|{_DOT}){_PART})*+", re.I)
_DOMAIN = re.compile(rf"(?:{_AT}|@)[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)+", re.I)
#: With a bare "at" and no disguised dot, the last label must be one of these, or see _plausible().
_TOP = re.compile(r"\.(?:com|org|net|edu|gov|info|io|eu|uk|de|fr|es)$", re.I)
_LABELS = re.compile(r"(?:[a-z0-9-]*[a-z][a-z0-9-]*\.)+[a-z]{2,24}\Z")
#: Prose: words before "at", and what follows a full stop without a blank, or names a file.
_PROSE_BEFORE = frozenset("a am an and are arrive arrived as available be been but came come eat found get go he held her him in is it laugh laughed live lives look looked looking looks me meet met not now of on or out she shot sit smile smiled so stand stay stayed stop stopped that the them there they this time to up us was we went were when who work worked works you".split())
_PROSE_LAST = frozenset("after all also although and another are because but can did each every for from had has have her here his how however its just many most not now one our she some such that the their then there these they this those was were what when where which while who why will with you your js ts html htm txt pdf jpg jpeg png gif csv json xml exe dll log php java cpp css doc docx xls xlsx yaml yml".split())
_BARE_AT = re.compile(r"\s+at\s+", re.I)
_SIGN = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})", re.I)
_DISGUISED_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:{_DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_MAYBE_SIGN = re.compile(rf"{_OPEN}\s*(?:at|@|arroba|arobase|dot|\.|punkt|punto|point)\s*{_CLOSE}|\s(?:dot|punkt|punto)\s|\s@|@\s|\sat\s+[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2}}", re.I)
_MAYBE_SPELLED = re.compile(rf"(?<!\w)(?:{_DIGIT_WORD})(?:[\x20,.()-]|dot|point){{1,4}}(?:(?:{_DIGIT_WORD})(?!\w)|[0-9])|[0-9][\x20-]{{0,2}}(?:\.|dot|point)[\x20-]{{0,2}}(?:{_DIGIT_WORD})(?!\w)", re.I)
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    odd = sum(int(x) for x in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])) % 10 == 0


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in found.split("."))
    digits = re.sub("[^0-9]", "", found)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def _emails(text: str) -> Iterator[re.Match]:
    """Leftmost matches of EMAIL's pattern; one may begin where another ends, within a run."""
    m = EMAIL.search(text)
    while m:
        yield m
        m = _EMAIL_HERE.match(text, m.end()) or EMAIL.search(text, m.end())


def _disguised(text: str) -> Iterator[Span]:
    """Leftmost matches of _LOCAL and _DOMAIN. Where a local part isn't followed by a domain, none of its parts is."""
    local = _LOCAL.search(text)
    while local:
        domain = _DOMAIN.match(text, local.end())
        if domain:
            yield local.start(), domain.end()
        local = _LOCAL.search(text, (domain or local).end())


def _free(spans: list[Span], s: Span) -> bool:
    """Whether s overlaps none of the spans, which are in order and don't overlap."""
    i = bisect.bisect_left(spans, s)
    return (i == 0 or spans[i - 1][1] <= s[0]) and (i == len(spans) or s[1] <= spans[i][0])


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost matches of each kind's pattern that don't overlap, without those that fail its test."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    digit = _DIGIT.search(text) is not None
    for kind, pattern, may in (("email", EMAIL, "@" in text), ("ip", IP, digit and "." in text), ("card", CARD, digit), ("phone", PHONE, digit and "+" in text)):
        if may:
            found = _emails(text) if pattern is EMAIL else pattern.finditer(text)
            out[kind] = [m.span() for m in found if _valid(kind, m[0])]
    return out


class Mapped:
    """A text and, for each of its characters, the source range it stands for."""

    def __init__(self, text: str, begin: list[int] | None = None, end: list[int] | None = None):
        self.text = text
        self.begin = list(range(len(text))) if begin is None else begin
        self.end = list(range(1, len(text) + 1)) if end is None else end

    def source(self, span: Span) -> Span:
        return self.begin[span[0]], self.end[span[1] - 1]

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """With ranges replaced, in order; every character put in stands for the whole range replaced."""
        out, begin, end, at = [], [], [], 0
        for a, b, new in edits:
            out.append(self.text[at:a])
            begin += self.begin[at:a]
            end += self.end[at:a]
            out.append(new)
            begin += [self.begin[a]] * len(new)
            end += [self.end[b - 1]] * len(new)
            at = b
        out.append(self.text[at:])
        return Mapped("".join(out), begin + self.begin[at:], end + self.end[at:])


def _plain(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    if unicodedata.category(c) == "Zs":
        return " "
    if unicodedata.category(c) == "Pd":
        return "-"
    new = unicodedata.normalize("NFKC", c)
    return new if new.isascii() and len(new) == 1 else c


_FOREIGN: dict[str, str] = {}
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")


def fold_homoglyphs(x: Mapped) -> Mapped:
    """Look-alike letters, digits, dashes and blanks as ASCII. Each character is read by itself, whatever word it is in."""
    edits = []
    for m in _NOT_ASCII.finditer(x.text):
        c = m[0]
        if c not in _FOREIGN:
            _FOREIGN[c] = _plain(c)
        if _FOREIGN[c] != c:
            edits.append((m.start(), m.end(), _FOREIGN[c]))
    return x.rewritten(edits) if edits else x


def _spelled_ips(text: str) -> Iterator[tuple[int, int, str]]:
    """Ranges of ips with spelled digits, and the ips."""
    for run in _SPELLED_IP.finditer(text):
        tokens = [m[0].lower() for m in _IP_TOKEN.finditer(run[0])]
        ip = "".join("." if x in ("dot", "point", ".") else DIGITS.get(x, x) for x in tokens)
        if any(x in DIGITS for x in tokens) and _valid("ip", ip):
            yield *run.span(), ip


def _plausible(found: str, at: str) -> bool:
    """Whether an address with a bare "at" is one: its domain is all in one case, and neither side reads as prose."""
    local, domain = found.split(at, 1)
    domain = domain.lower() if domain.isupper() else domain
    return local.lower() not in _PROSE_BEFORE and bool(_LABELS.match(domain)) and domain.rsplit(".", 1)[1] not in _PROSE_LAST


def read_digits(x: Mapped) -> Mapped:
    """Digits spelled in runs of seven or more, or as an ip, as digits; "plus" and "dot" in a run as signs."""
    edits = list(_spelled_ips(x.text))
    ips = [e[:2] for e in edits]
    for run in _SPELLED.finditer(x.text):
        if not _free(ips, run.span()):
            continue
        before = None
        for m in _SPELLED_TOKEN.finditer(x.text, *run.span()):
            new = {"plus": "+", "dot": ".", "point": "."}.get(m[0].lower()) or DIGITS[m[0].lower()]
            if before is not None and x.text[before : m.start()].strip(" ,-") == "":
                edits[-1] = (edits[-1][0], m.start(), edits[-1][2])  # the gap goes with the digit before it
            edits.append((m.start(), m.end(), new))
            before = m.end()
    return x.rewritten(sorted(edits)) if edits else x


def read_signs(x: Mapped) -> Mapped:
    """Disguised at and dot signs of addresses as signs."""
    edits = []
    for span in _disguised(x.text):
        found, signs = x.text[slice(*span)], list(_SIGN.finditer(x.text, *span))
        if len(signs) == 1 and _BARE_AT.fullmatch(signs[0][0]) and not _TOP.search(found) and not _plausible(found, signs[0][0]):
            continue
        edits += [(m.start(), m.end(), "@" if m["at"] else ".") for m in signs]
    for run in _DISGUISED_IP.finditer(x.text):
        edits += [(m.start(), m.end(), "@" if m["at"] else ".") for m in _SIGN.finditer(x.text, *run.span())]
    edits.sort()
    clean, last = [], -1
    for e in edits:
        if e[0] >= last:
            clean.append(e)
            last = e[1]
    return x.rewritten(clean) if clean else x


def find_pii(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base spans, all spans) by kind, as ranges of code points.

    All spans are the base ones and those of the plain text that overlap no base span of their kind. What
    is found in one stage of rewriting stays found.
    """
    base = base_spans(text)
    found = {k: list(v) for k, v in base.items()}
    x = Mapped(text)
    tried = text
    for step, may in ((fold_homoglyphs, not text.isascii()), (read_digits, True), (read_signs, True)):
        if not may or (step is read_digits and not _MAYBE_SPELLED.search(x.text)) or (step is read_signs and not _MAYBE_SIGN.search(x.text)):
            continue
        x = step(x)
        if x.text == tried:
            continue
        tried = x.text
        for kind, spans in base_spans(x.text).items():
            for s in map(x.source, spans):
                if _free(found[kind], s):
                    bisect.insort(found[kind], s)
    return base, found


def listed(spans: dict[str, list[Span]]) -> str:
    """kind:start:end by start, then kind in the order of KINDS, comma-joined."""
    rows = sorted((a, i, k, b) for i, k in enumerate(KINDS) for a, b in spans[k])
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in rows)


def personal_data(docs: DataFrame, redact: bool = True) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans, redacted) for each row of docs (doc_id, text).

    The counts and base are of the patterns on the text as it is; spans adds what the plain text shows.
    Both are lists as listed() writes them. redacted: the text with each range of spans as [KIND].
    Without redact it is null, and isn't made. A null text is an empty one; rows may repeat, texts may be of
    any length, an empty table gives no rows, and other columns are ignored, whatever their names. Of two
    spans that overlap, of one kind, the base one stays, then the one found in an earlier rewriting.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            out: dict[str, list] = {x: [] for x in (*(f"n_{k}" for k in KINDS), "base", "spans", "redacted")}
            for text in texts:
                base, found = find_pii(text)
                for k in KINDS:
                    out[f"n_{k}"].append(len(base[k]))
                out["base"].append(listed(base))
                out["spans"].append(listed(found))
                if not redact:
                    out["redacted"].append(None)
                    continue
                kept, at = [], 0
                for a, b, k in sorted((a, b, k) for k, v in found.items() for a, b in v):
                    if a >= at:
                        kept += [text[at:a], f"[{k.upper()}]"]
                    at = max(at, b)
                out["redacted"].append("".join([*kept, text[at:]]) if kept else text)
            yield pa.record_batch([batch["doc_id"], *(pa.array(v, pa.int64() if k[:2] == "n_" else pa.string()) for k, v in out.items())], names=["doc_id", *out])

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {kinds}, base string, spans string, redacted string")


