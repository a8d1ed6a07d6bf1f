"""Personal information in free text: found, and replaced by typed placeholders.

High-recall generators propose overlapping spans for e-mail addresses, phone numbers, identity numbers, postal addresses
and names. Boosted trees, one model per kind, score each span by its format and its context; the scores are calibrated
and the best spans above the kind's threshold that do not overlap are taken. Names, the most numerous, pass a first
stage that looks at their words alone. The models are trained on the driver from a bounded number of rule-made labelled
texts (TRAINING_TEXTS) and travel with the tasks, as does what the vocabularies of public tokenizers tell of words; the
corpus itself is only ever scored, whole text by whole text, without a shuffle.
"""

from __future__ import annotations

import base64
import math
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm.boosting import Boosted
from filigree.llm.personal_training import FAMILIES, GIVEN, UNLISTED, labelled

KINDS = ("email", "phone", "idno", "address", "name")
#: Rule-made texts the models are trained on, and the part of them held out for calibration.
TRAINING_TEXTS, HELD_OUT, SEED = 6_000, 0.25, 11
#: Share of the training names that the first stage may turn away.
TURNED_AWAY = 0.001
#: Where the public vocabularies lie, and which tell of words; every operator takes another folder.
TOKENIZERS, VOCABULARIES = "/opt/tokenizers", ("byte_bpe_50k", "byte_bpe_multi_50k")
#: Context read on either side of a span.
_BEFORE, _AFTER = 44, 22

_GIVEN = frozenset(GIVEN)
# Words that introduce or follow cases, folded to lower case without marks.
_CUES = {
    "phone": r"phone|\btel\b|telefon|mobil|movil|\bhandy|portable|\bcell|\bcall|\bdial|\bring|\bsms\b|\btext\b|\bline\b|hotline|\bfax|\bruf|ruckruf|anruf|appel|joindre|\bllam|numero|number|nummer|whatsapp|電話|携帯|連絡|折り返し",
    "phone_after": r"^[\W_]{0,3}(?:ring|rang|busy|is busy|was busy|klingel|besetzt|war besetzt|ist besetzt|sonne|suena|please|bitte|svp|tomorrow|morgen|demain|manana|now|へ|です)",
    "idno": r"\bssn|social sec|identi|passport|national|\bid\b|ausweis|kennu|kennn|steuer|insee|securite soc|\bdni|\bnif\b|\bnie\b|nino\b|\bni num|documento|個人番号",
    "code": r"order|build|isbn|issn|serial|\bpart\b|model|page|line|row|route|range|ticket|block|batch|\blot\b|section|chapter|checksum|offset|version|release|invoice|\bport\b|iban|price|total|code\b|flight|room|bestell|rechnung|seite|zeile|commande|facture|ligne|pedido|factura",
    "address": r"address|office|lives|ship|deliver|visit|moved|home|anschrift|adresse|wohn|liefer|buro|habite|livrer|domicil|direccion|vive|enviar|住所|\bat\b|\bto\b|\bin der\b|\ban\b|\bau\b|\ba\b|\ben\b|\bin\b",
    "title": r"\b(?:mr|mrs|ms|dr|prof|herrn?|frau|m|mme|mlle|sr|sra|srta|don|dona)\.? *$",
    "label": r"(?:dear|hello|hi|hallo|liebe[rs]?|bonjour|chere?|hola|estimad[oa]|manager|assignee|author|autor|auteur|owner|cc|bcc|attn|responsa\w+|responsible|bearbeiter|zustandig|kontakt|contacto?|name|nom|nombre|(?:reported|approved|signed|written) by|assigned to|thanks?|gracias|merci|ask|told|met|according to|selon|segun|laut|gru(?:ss|sse|.)|cordialement|saludos|regards|best|until|both|voir|seit|bis|depuis que|desde que|--|von|par|por|mit|avec|con|fur|pour|para|with|by|from|for) *[:=,\"“«]? *[\"“«]?$",
}
_CUES = {k: regex.compile(v) for k, v in _CUES.items()}

_GAP = r"[ \u00a0]{1,2}"
_EMAIL = regex.compile(
    rf"(?<![\w.+@#%-])[\p{{L}}\p{{N}}][\w.+%-]*(?:{_GAP})?(?:@|\(at\)|\[at\])(?:{_GAP})?[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}\p{{M}}-]*[\p{{L}}\p{{N}}])?"
    rf"(?:(?:\.|(?:{_GAP})?(?:\[dot\]|\(dot\))(?:{_GAP})?)[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}\p{{M}}-]*[\p{{L}}\p{{N}}])?)*",
    regex.I,
)
_NUMBER = regex.compile(r"(?<![\p{L}\p{N}_])[+(＋（]{0,2}\d+(?:(?:[ \u00a0\u3000]{1,2}|[-./‐‑–－．／]|[)）][ \u00a0\u3000]{0,2}|[ \u00a0]{0,2}[(（]\d{1,4}[)）][ \u00a0]{0,2}|[ \u00a0\u3000]{0,2}[(（])\d+)*(?![\p{L}\p{N}])")
_GROUP = regex.compile(r"\d+")
_SIGNS = r"(?:[A-Za-z]{0,2}\d[A-Za-z0-9]{0,15}|[A-Za-z]{1,2}(?!-\p{L}{2}))"
_CODE = regex.compile(rf"(?<![\p{{L}}\p{{N}}]){_SIGNS}(?:(?:[ \u00a0]{{1,2}}|[.-]){_SIGNS}){{0,15}}(?![\p{{L}}\p{{N}}])")
_PART = regex.compile(r"[A-Za-z0-9]+")

_W = r"\p{Lu}(?:[\p{L}\p{M}'’-]*[\p{L}\p{M}])?"
_SP = r"(?:[ \u00a0]{1,2}|[ ]?\r?\n)"
_TOWN = rf"{_W}(?:{_GAP}{_W})?"
_POST = r"(?:\d{5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]?[ ]{0,2}\d[A-Z]{2})"
# Words for streets.
_EN = r"(?:Road|Rd|Street|St|Lane|Ln|Avenue|Ave|Close|Drive|Dr|Court|Ct|Way|Place|Pl|Square|Sq|Boulevard|Blvd|Terrace|Crescent|Row|Hill)\b\.?"
_FR = r"(?:rue|avenue|all[ée]e|allée|chemin|boulevard|place|impasse|quai|route|cours|square)"
_DE = r"(?:stra(?:ß|ss)e|str\.|allee|gasse|weg|platz|ring|damm|ufer|steig)"
_ES = r"(?:Calle|C/|Avenida|Avda\.?|Plaza|Camino|Paseo|Carretera|Ronda|Rambla)"
_STREETS = [
    (rf"(?:(?:Flat|Apt\.?|Apartment|Suite|Unit){_GAP}\d+[A-Za-z]?,?{_SP})?\d{{1,5}}[A-Za-z]?{_GAP}(?:{_W}{_GAP}){{1,3}}{_EN}", rf",?{_SP}{_TOWN}", rf",?{_SP}{_POST}"),
    (rf"P\.?(?:{_GAP})?O\.?(?:{_GAP})?Box{_GAP}\d+", rf",?{_SP}{_TOWN}", rf",?{_SP}{_POST}"),
    (rf"\d{{1,4}}(?:{_GAP}(?:bis|ter|quater))?,?{_GAP}{_FR}{_GAP}(?:(?:de|du|des|de la|de l['’]|d['’])(?:{_GAP})?)?(?:{_W}(?:{_GAP})?){{1,3}}", rf",?{_SP}\d{{5}}", rf"{_GAP}{_TOWN}"),
    (rf"{_W}(?:-?{_DE}|(?<=\p{{L}})-Stra(?:ß|ss)e){_GAP}\d{{1,4}}[a-z]?", rf",?{_SP}(?:D-)?\d{{5}}", rf"{_GAP}{_TOWN}"),
    (rf"{_ES}{_GAP}(?:(?:de|del|de la|de los){_GAP})?(?:{_W}(?:{_GAP})?){{1,3}},?{_GAP}\d{{1,4}}(?:,{_GAP}\d{{1,2}}º{_GAP}[A-Z])?", rf",?{_SP}\d{{5}}", rf"{_GAP}{_TOWN}"),
    (r"〒?\d{3}-\d{4}", r"[ ]?\p{Han}{2,4}[都道府県]", r"[\p{Han}\p{Hiragana}\p{Katakana}\d-]{2,20}"),
]
_STREETS = [(regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{a})", regex.I if i in (1, 2, 3) else 0), regex.compile(b), regex.compile(c)) for i, (a, b, c) in enumerate(_STREETS)]
_SHOUTED = [(regex.compile(a.pattern, regex.I), b, c) for a, b, c in _STREETS]

_T = r"\p{Lu}[\p{L}\p{M}�]+(?:['’]\p{Lu}\p{L}+)?"
_NAME_FORMS = [
    regex.compile(rf"(?<![\p{{L}}\p{{N}}@+._-]){_T}(?:-{_T})?(?:{_GAP}\p{{Lu}}\.){{0,2}}{_GAP}{_T}(?:-{_T})?(?![\p{{L}}\p{{N}}@_]|-\p{{L}})"),
    regex.compile(rf"(?<![\p{{L}}\p{{N}}@+._-]){_T}(?:-{_T})?,{_GAP}{_T}(?:-{_T})?(?:{_GAP}\p{{Lu}}\.){{0,2}}(?![\p{{L}}\p{{N}}@_]|-\p{{L}})"),
    regex.compile(rf"(?<![\p{{L}}\p{{N}}@+._-]){_T}{_GAP}{_T}{_GAP}{_T}(?![\p{{L}}\p{{N}}@_]|-\p{{L}})"),
]
_TOKEN = regex.compile(r"[\p{L}\p{M}'’�]+")
_DETERMINER = regex.compile(r"\b(?:the|each|every|this|that|one|no|all|d(?:er|ie|as|e[nms])|k?ein(?:e[nmrs]?)?|jede[nmrs]?|diese[nmrs]?|alle[nmrs]?|viele|mehrere|manche|zwei|einzelne|les?|la|une?|chaque|cette|ce|aucune?|nos|des|el|los|las|una|cada|est[ae]|dicha) +$")
_DETERMINED = regex.compile(_DETERMINER.pattern[:-3] + r" +\p{Ll}{4,} +$")
_BEGINS = regex.compile(r"(?:\A|[.!?…\r\n][\s\"'>#*-]*)$")
_LOWER_NEXT = regex.compile(r"[ \u00a0]{1,2}\p{Ll}")

#: Full-width digits and signs to their ASCII form, for the features; spans keep the text as it is.
_NARROW = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: 0x20, 0x2010: 0x2D, 0x2011: 0x2D, 0x2013: 0x2D}

_AT = regex.compile(r"[(\[]at[)\]]", regex.I)
# Of each form of an address, what a text without it cannot hold, in lower case.
_NEEDS = [re.compile(x) for x in (r"\d[a-z]?[ \u00a0]{1,2}\w", r"box[ \u00a0]", r"\d[^\n]{0,10}(?:rue|avenue|all.|alle.|chemin|boulevard|place|impasse|quai|route|cours|square)", r"(?:stra(?:ß|ss)e|str\.|allee|gasse|weg|platz|ring|damm|ufer|steig)[ \u00a0]{1,2}\d", r"(?:calle|c/|avenida|avda\.?|plaza|camino|paseo|carretera|ronda|rambla)[ \u00a0]", r"[都道府県]")]
#: A code holds digits, and at most so many signs and gaps before and after one.
_DIGITS, _REACH = re.compile(r"\d"), 40

Span = tuple[int, int, str]


def _emails(text: str) -> Iterator[Span]:
    if "@" in text or _AT.search(text):
        for m in _EMAIL.finditer(text):
            yield m.start(), m.end(), "email"


def _numbers(text: str) -> Iterator[Span]:
    """Every run of neighbouring digit groups of 7 to 16 digits, as a phone and, from 8 digits, as an identity number."""
    for m in _NUMBER.finditer(text):
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in _GROUP.finditer(m.group())]
        for i, (start, _) in enumerate(groups):
            digits = 0
            lead = start
            while lead > m.start() and text[lead - 1] in "+(＋（" and start - lead < 2:
                lead -= 1
            for begin, end in groups[i : i + 12]:
                digits += end - begin
                if digits > 16:
                    break
                if digits >= 7:
                    yield lead, end, "phone"
                    if digits >= 8 and lead == start:
                        yield start, end, "idno"


def _codes(text: str) -> Iterator[Span]:
    """Runs of up to seven neighbouring groups with letters and at least four digits, 8 to 14 signs in all."""
    for low, high in _near_digits(text):
        yield from _codes_in(text, low, high)


def _near_digits(text: str) -> Iterator[tuple[int, int]]:
    """The stretches of text within reach of a digit, to the end of a word."""
    low, high = 0, -1

    def end() -> int:
        at = min(len(text), high)
        while at < len(text) and text[at].isalnum():
            at += 1
        return at

    for m in _DIGITS.finditer(text):
        if high < 0 or m.start() - _REACH > high:
            if high >= 0:
                yield low, end()
            low = max(0, m.start() - _REACH)
        high = m.start() + _REACH
    if high >= 0:
        yield low, end()


def _codes_in(text: str, low: int, high: int) -> Iterator[Span]:
    for m in _CODE.finditer(text, low, high):
        parts = [(g.start() + m.start(), g.end() + m.start()) for g in _PART.finditer(m.group())]
        has = [any(c.isdigit() for c in text[a:b]) or b - a <= 2 for a, b in parts]
        for i, (start, _) in enumerate(parts):
            signs = 0
            for j in range(i, min(len(parts), i + 7)):
                begin, end = parts[j]
                signs += end - begin
                if signs > 14 or not has[j]:
                    break
                if signs >= 8:
                    run = text[start:end]
                    digits = sum(c.isdigit() for c in run)
                    if digits >= 4 and digits < signs:
                        yield start, end, "idno"


def _addresses(text: str) -> Iterator[Span]:
    shouted = sum(map(str.isupper, text)) > sum(map(str.islower, text))
    lower = text.lower()
    for needs, (street, second, third) in zip(_NEEDS, _SHOUTED if shouted else _STREETS):
        for m in street.finditer(text) if needs.search(lower) else ():
            end = len(m.group().rstrip()) + m.start()
            yield m.start(), end, "address"
            if b := second.match(text, end):
                yield m.start(), b.end(), "address"
                short = b.end() if not b.group().strip(" ,\r\n ").count(" ") else b.start() + b.group().rindex(" ")
                for at in {b.end(), short}:
                    if c := third.match(text, at):
                        yield m.start(), c.end(), "address"
                        if c.group().strip().count(" ") and not c.group().strip()[0].isdigit():
                            yield m.start(), c.start() + c.group().rstrip().rindex(" "), "address"


def _names(text: str) -> Iterator[Span]:
    """Every run of capitalized words in the shape of a name; known given names and cues are features only."""
    for form in _NAME_FORMS:
        for m in form.finditer(text, overlapped=True):
            yield m.start(), m.end(), "name"


def candidates(text: str) -> list[Span]:
    return list(dict.fromkeys(s for find in (_emails, _numbers, _codes, _addresses, _names) for s in find(text)))


@lru_cache(maxsize=100_000)
def _fold_word(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


def fold(text: str) -> str:
    return text.casefold() if text.isascii() else _fold_word(text)


def _next(name: str, after: str) -> float:
    """How near after the span, in the same sentence, a cue begins."""
    m = _CUES[name].search(after)
    return 0.0 if m is None or _STOP.search(after, 0, m.start()) else 1.0 / (1 + m.start())


def _near(name: str, before: str) -> float:
    """How near before the span a cue stands: 1 at once, falling, 0 without one."""
    last = None
    for last in _CUES[name].finditer(before):
        pass
    return 0.0 if last is None else 1.0 / (1 + len(before) - last.end())


@lru_cache(maxsize=4)
def vocabulary(folder: str = TOKENIZERS) -> dict[str, int]:
    """What the public vocabularies tell of words, in lower case: 1 if it is one of them in lower case, 2 if
    capitalized, 3 if both. At most as many words as the vocabularies have; empty where the folder lacks them."""
    out: dict[str, int] = {}
    for name in VOCABULARIES:
        path = os.path.join(folder, f"{name}.tiktoken")
        if not os.path.exists(path):
            continue
        with open(path, "rb") as f:
            for line in f:
                word = base64.b64decode(line.split()[0]).decode("utf-8", "replace") if line.strip() else ""
                if len(word) > 3 and word[0] == " " and (word := word[1:]).isalpha() and (word.islower() or word.istitle()):
                    out[word.lower()] = out.get(word.lower(), 0) | (1 if word.islower() else 2)
    return out


def plain_words(known: dict[str, int]) -> list[str]:
    """Common words of the vocabularies, in order."""
    return sorted(w for w, code in known.items() if code & 1 and w.isascii() and 3 < len(w) < 11 and w not in _GIVEN)


def _groups(word: str) -> list[str]:
    word = f"^{word}$"
    return [word[i : i + n] for n in (2, 3) for i in range(len(word) - n + 1)]


class Words:
    """Traits of single words, remembered: known given name, in the vocabularies in lower case, capitalized, how much
    its letters are those of a name and of a word the vocabularies have only capitalized, common word, length."""

    def __init__(self, known: dict[str, int]):
        self.known = known
        plain, proper = plain_words(known), sorted(w for w, code in known.items() if code == 2 and w.isascii())
        names = sorted({*GIVEN, *UNLISTED, *FAMILIES})
        self.letters = []
        for some in (names, proper):
            counts = Counter(g for w in some for g in _groups(w))
            self.letters.append((counts, frozenset(some), sum(counts.values()) + 1000))
        counts = Counter(g for w in plain for g in _groups(w))
        self.plain, self.plain_words, self.total = counts, frozenset(plain), sum(counts.values()) + 1000
        self.memo: dict[str, tuple[float, ...]] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "memo": {}}

    def of(self, word: str) -> tuple[float, ...]:
        out = self.memo.get(word)
        if out is None:
            if len(self.memo) >= 200_000:
                self.memo.clear()
            folded, code = fold(word), self.known.get(word.lower(), 0)
            groups = _groups(folded)
            odds = []
            for counts, own, total in self.letters:
                # A word's own letters do not speak for it, lest the trees trust the lists.
                less, other = float(folded in own), float(folded in self.plain_words)
                odds.append(sum(math.log((max(0.0, counts.get(g, 0) - less) + 0.3) / total * self.total / (max(0.0, self.plain.get(g, 0) - other) + 0.3 * self.total / total)) for g in groups) / len(groups))
            out = self.memo[word] = (float(folded in _GIVEN), float(code & 1), float(code >> 1), *odds, float(_common(word)), float(len(word)))
        return out


_NOTHING = (0.0,) * 7


def first_features(text: str, span: Span, words: Words) -> list[float]:
    """What a name's words tell by themselves."""
    s = text[span[0] : span[1]]
    tokens = _TOKEN.findall(s)
    head, tail = words.of(tokens[0]), words.of(tokens[-1])
    middle = words.of(tokens[1]) if len(tokens) > 2 else _NOTHING
    before = text[max(0, span[0] - 12) : span[0]]
    return [*head, *tail, *middle, len(tokens), float("," in s), float("-" in s), float("." in s), float(s.isupper()), float(_TITLE.search(before) is not None), float(_BEGINS.search(text, max(0, span[0] - 30), span[0]) is not None), float(before.rstrip(" \u00a0")[-1:] in (":", "="))]


_CLOSING = regex.compile(r"(?:regards|sincerely|yours|cheers|thanks|wishes|gru(?:ss|ß)|danke|saludo|gracias|cordial|salut|merci|a vous)[^\n]{0,12}\n\s*$")
_STOP = regex.compile(r"[.!?\r\n]")
_TITLE = regex.compile(_CUES["title"].pattern, regex.I)
_AFTER_TOKEN = regex.compile(r"[ \u00a0]{1,2}(\p{Lu}[\p{L}'’\ufffd]+)")
_BEFORE_TOKEN = regex.compile(r"(\p{Lu}[\p{L}'’\ufffd]+)[ \u00a0]{1,2}$")
_COMMA_LEFT, _COMMA_RIGHT = regex.compile(r",[ \u00a0]{1,2}$"), regex.compile(r",[ \u00a0]{1,2}\p{Lu}")
_INITIAL_LEFT, _INITIAL_RIGHT = regex.compile(r"\p{Lu}\.[ \u00a0]{1,2}$"), regex.compile(r"[ \u00a0]{1,2}\p{Lu}\.")
_GENITIVE = regex.compile(r"['’]s\b")
_NEXT_WORD, _LAST_WORD = regex.compile(r"[ \u00a0]{1,2}([\p{L}\p{M}]+)"), regex.compile(r"([\p{L}\p{M}]+)[\W_]{0,4}$")


def name_features(text: str, span: Span, words: Words, first: list[float] | None = None) -> list[float]:
    """The words of a name in their context; ``first`` is what the words tell, where that is known."""
    start, end, _ = span
    out = first_features(text, span, words) if first is None else first
    before, after = fold(text[max(0, start - _BEFORE) : start]), text[end : end + 30]
    line = before.rsplit("\n", 1)[-1]
    left, right = before[-1:] or "\n", after[:1] or "\n"
    next_cap, last_cap = _AFTER_TOKEN.match(after), _BEFORE_TOKEN.search(text, max(0, start - 30), start)
    around = text[max(0, start - 30) : start] + after
    return [
        *out, *(words.of(next_cap[1]) if next_cap else _NOTHING), *(words.of(last_cap[1]) if last_cap else _NOTHING), float(next_cap is not None), float(last_cap is not None),
        float(_CUES["label"].search(line) is not None), float(_DETERMINER.search(before) is not None), float(_DETERMINED.search(before) is not None), float(left in "\n\r"), float(_CLOSING.search(before) is not None), float(left in "\"“«("), float(left in "'’"), float(left in "@#/_[{"), float(right in "\n\r"), float(right in ".!?"), float(right in ",;:"), float(right in "\"”»)'"), float(right in "_/]}="),
        float(_COMMA_LEFT.search(text, max(0, start - 3), start) is not None), float(_COMMA_RIGHT.match(after) is not None), float(_INITIAL_RIGHT.match(after) is not None), float(_INITIAL_LEFT.search(text, max(0, start - 5), start) is not None),
        float(_GENITIVE.match(after) is not None), float(_LOWER_NEXT.match(after) is not None), float(sum(map(str.isupper, around)) > sum(map(str.islower, around))),
        float((m := _NEXT_WORD.match(after)) is not None and _common(m[1])), float((m := _LAST_WORD.search(line)) is not None and _common(m[1])),
    ]


_DOMAIN, _DOT = regex.compile(r"(?:@|[(\[]at[)\]])"), regex.compile(r"[ \u00a0]*(?:\.|[(\[]dot[)\]])[ \u00a0]*")
_MORE_LEFT, _DIGIT_LEFT = regex.compile(r"[\p{L}\p{N}](?:[ \u00a0]{1,2}|[-./:()])?$"), regex.compile(r"\d(?:[ \u00a0]{1,2}|[-./:(),]{1,2})?$")
_DIGIT_RIGHT = regex.compile(r"(?:[ \u00a0]{1,2}|[-./:)]{1,2})?(?!(?:19|20)\d\d-\d\d-\d\d)\d")
_LETTER_RIGHT, _LETTER_LEFT = regex.compile(r"[ .-]?[A-Z]\b(?!\.?[a-z]|-\p{L})"), regex.compile(r"\b[A-Z]{1,2}[ -]?$")
_TWO_SIX_ONE, _FOREIGN, _DATED = regex.compile(r"[A-Z]{2} {0,2}(?:\d\d {0,2}){3}[A-D]", regex.I), regex.compile(r"[XYZ]-?\d", regex.I), regex.compile(r"(?:19|20)\d\d[- ]")
_POST_IN, _ZIP_TOWN = regex.compile(_POST), regex.compile(r"\d{5}(?!\d)\s+\p{L}")
_TOWN_RIGHT, _ZIP_RIGHT = regex.compile(r"[ ,]*\r?\n?[ ]?\p{Lu}\p{L}+,? (?:\d{5}|[A-Z]{2}\d)"), regex.compile(r",? ?(?:D-)?\d{5}\b")
_WORD_LEFT = regex.compile(r"([\p{L}\p{M}]+)(?:[ \u00a0]?(?:no|nr|n°|#)\.?)?[ \u00a0:=#.]{0,3}$")


def features(text: str, span: Span) -> list[float]:
    """Format and context of a span of any kind but a name, as numbers."""
    start, end, kind = span
    s = text[start:end] if text.isascii() else text[start:end].translate(_NARROW)
    before, after = fold(text[max(0, start - _BEFORE) : start]), text[end : end + 40]
    line = before.rsplit("\n", 1)[-1]
    left, right = before[-1:] or "\n", after[:1] or "\n"
    letters, digits = sum(map(str.isalpha, s)), sum(map(str.isdigit, s))
    groups = [len(g) for g in _PART.findall(s)]
    heads = [*groups, 0, 0, 0, 0][:4]
    labels = [x for x in _DOT.split(_DOMAIN.split(s.casefold())[-1]) if x] if kind == "email" else []
    word = _WORD_LEFT.search(line)
    phone, idno, code = _near("phone", line), _near("idno", line), _near("code", line)
    behind = fold(after[:_AFTER + 6])
    return [
        len(s), letters, digits, len(groups), *heads, groups[-1] if groups else 0, float(s[:1] == "+"), float(s[:1] == "("), float(s[:2] == "00"), float(s[:1] == "0"),
        s.count("-"), s.count("."), s.count(" "), s.count("/"), s.count("("), float("(0)" in s), float("\n" in s), s.count(","), float(_TWO_SIX_ONE.fullmatch(s) is not None), float(_FOREIGN.match(s) is not None), float(s[-1:].isalpha()), float(s[:1].isalpha()),
        float(s[:1] in "12"), float(_DATED.match(s) is not None), len(labels), float(len(labels) > 1 and labels[-1].isalpha()), len(labels[-1]) if labels else 0,
        float(_POST_IN.search(s) is not None), float(_ZIP_TOWN.search(s) is not None), float(s[-1:].isdigit()), float(sum(1 for w in _TOKEN.findall(s) if w[:1].islower() and len(w) > 3)) if kind == "address" else 0.0,
        phone, idno, code, _near("address", line) if kind == "address" else 0.0, float(_CUES["phone_after"].search(behind) is not None), _next("phone", behind), _next("idno", behind), float(word is not None), float(word is not None and max(phone, idno, code) < 0.15 and not _common(word[1])),
        float(_MORE_LEFT.search(text, max(0, start - 4), start) is not None), float(_DIGIT_LEFT.search(text, max(0, start - 4), start) is not None), float(_DIGIT_RIGHT.match(after) is not None), float(_LETTER_RIGHT.match(after) is not None), float(_LETTER_LEFT.search(text, max(0, start - 3), start) is not None),
        float(left in "\n\r"), float(right in "\n\r.,;"), float(left.isalnum()), float(right.isalnum()), float(left in ".-/:_=+#"), float(right in "-/:_+@"),
        *((float(_TOWN_RIGHT.match(after) is not None), float(_ZIP_RIGHT.match(after) is not None), float(after.lstrip(" ,")[:1].isupper())) if kind == "address" else (0.0, 0.0, 0.0)),
    ]


# Words that begin sentences or join them, not people.
_COMMON = frozenset("""
the a an of and or for until both according reported please we mr mrs ms dr prof so but if while when then each every all no not with from to in on at by as is are was under
behind during after before this that one two into over only our your their its his her my he she it they who which where why how because since some any few many more most other
such own same than too very just also again once here there about against between through above below up down out off
der die das ein eine einer eines und oder seit laut bitte gruss frau herr herrn nach vor zwischen ohne bei unter aber denn weil dass den dem des im am zum zur von mit auf aus fur ist sind jede jeder jedes keine viele einzelne
mehrere trotz nahe wahrend innerhalb ausserhalb unser unsere ihr ihre sein seine er sie es wir doch bis um wenn wie was wer nur auch noch schon sehr hat haben wird werden kann
le la les un une et ou selon depuis voir avec avant sans mais car donc des du au aux dans par pour chaque est sont cette ce pendant apres hors sous chez nos notre votre leur leurs ses mes quelques plusieurs
aucune aucun entre vers durant il elle nous vous ils qui que quand comme sur pres tres plus moins deja encore
el los las una y o segun desde bajo tras pero pues porque del al en con por para cada es son esta este durante dentro fuera su sus nuestro nuestra cuando como donde quien que sobre entre hasta hacia sin mas menos ya
muy tambien otra otro algunos varios ningun ninguna gegen uber ab je pro samt neben zwischen hinter damit dann dort hier heute gestern malgre chez lors puis alors ici ante tan
""".split())  # fmt: skip


@lru_cache(maxsize=100_000)
def _common(word: str) -> bool:
    """Whether a word is common; damaged characters stand for any."""
    word = fold(word)
    return word in _COMMON or "\ufffd" in word and any(len(c) == len(word) and all(x in ("\ufffd", y) for x, y in zip(word, c)) for c in _COMMON)


@dataclass
class Recognizer:
    """The calibrated model of each kind, the first stage for names with the raw score it asks for, and the words."""

    words: Words
    models: dict[str, Boosted] = field(default_factory=dict)
    first: Boosted = field(default_factory=lambda: Boosted(depth=3, rounds=30))
    least: float = -math.inf

    def features(self, text: str, span: Span) -> list[float]:
        return name_features(text, span, self.words) if span[2] == "name" else features(text, span)


@lru_cache(maxsize=2)
def models(texts: int = TRAINING_TEXTS, seed: int = SEED, folder: str = TOKENIZERS) -> Recognizer:
    """One calibrated model per kind, trained on rule-made texts; the last part of them calibrates."""
    out = Recognizer(Words(vocabulary(folder)))
    rows: dict[str, tuple[list, list, list]] = {k: ([], [], []) for k in (*KINDS, "first")}
    for i, (text, spans) in enumerate(labelled(texts, seed, plain_words(out.words.known))):
        for span in candidates(text):
            for kind in (span[2], "first") if span[2] == "name" else (span[2],):
                x = first_features(text, span, out.words) if kind == "first" else out.features(text, span)
                for column, value in zip(rows[kind], (x, span in spans, i >= texts * (1 - HELD_OUT))):
                    column.append(value)
    for kind, columns in rows.items():
        x, y, held = (np.array(c, float) for c in columns)
        held = held > 0
        model = out.first if kind == "first" else Boosted(rounds=100)
        model.fit(x[~held], y[~held])
        if kind == "first":
            out.least = float(np.quantile(model.raw(x[y > 0]), TURNED_AWAY))
        else:
            out.models[kind] = model.calibrate(x[held], y[held])
    return out


def find(texts: list[str | None], trained: Recognizer) -> list[list[tuple[int, int, str, float]]]:
    """The chosen spans (start, end, kind, probability) of each text, in order and without overlap."""
    spans: dict[str, list[tuple[int, Span]]] = {k: [] for k in KINDS}
    for i, t in enumerate(texts):
        if t:
            for s in candidates(t):
                spans[s[2]].append((i, s))
    scored: list[tuple[float, int, int, int, str]] = []
    # Numbers are looked at as phone and as identity number; their features are the same.
    seen: dict[tuple[int, int, int], list[float]] = {}
    for kind, model in trained.models.items():
        for at in range(0, len(spans[kind]), 20_000):
            part = spans[kind][at : at + 20_000]
            if kind == "name":
                first = [first_features(texts[i], s, trained.words) for i, s in part]
                keep = np.flatnonzero(trained.first.raw(np.array(first, float)) >= trained.least)
                part = [part[j] for j in keep]
                rows = [name_features(texts[i], s, trained.words, first[j]) for j, (i, s) in zip(keep, part)]
            elif kind in ("phone", "idno"):
                rows = []
                for i, s in part:
                    key = (i, s[0], s[1])
                    if key not in seen:
                        seen[key] = features(texts[i], s)
                    rows.append(seen[key])
            else:
                rows = [features(texts[i], s) for i, s in part]
            if part:
                p = model.predict(np.array(rows, float))
                scored += [(float(q), i, s[0], s[1], kind) for q, (i, s) in zip(p, part) if q >= model.cut]
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    taken: dict[int, list[tuple[int, int]]] = {}
    # The surest first, of equally sure ones the longest.
    for p, i, start, end, kind in sorted(scored, key=lambda c: (-round(c[0], 3), c[2] - c[3], c[2])):
        if all(end <= a or start >= b for a, b in taken.get(i, ())):
            taken.setdefault(i, []).append((start, end))
            out[i].append((start, end, kind, p))
    return [sorted(x) for x in out]


def redact(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    """text with each span replaced by its kind in square brackets; all else stays as it is."""
    parts, at = [], 0
    for start, end, kind, _ in spans:
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, text[at:]])


def recognize(df: DataFrame, id_col: str, text_col: str, texts: int = TRAINING_TEXTS, folder: str = TOKENIZERS) -> DataFrame:
    """(id_col, redacted, mentions array<struct<start, end, kind, mention, probability>>), a row per row of df.

    Offsets count code points. A null text stays null without mentions, an empty one stays empty. Repeated ids, extra
    columns and very long texts make no difference: each row is treated whole and alone.
    """
    trained = models(texts, folder=folder)
    mention = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("mention", pa.string()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                held = part.column(1).to_pylist()
                found = find(held, trained)
                redacted = pa.array([None if t is None else redact(t, s) for t, s in zip(held, found)], pa.string())
                listed = pa.array([[{"start": a, "end": b, "kind": k, "mention": t[a:b], "probability": p} for a, b, k, p in s] for t, s in zip(held, found)], pa.list_(mention))
                yield pa.RecordBatch.from_arrays([part.column(0), redacted, listed], ["id", "redacted", "mentions"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(run, f"id {kind}, redacted string, mentions array<struct<start:int,end:int,kind:string,mention:string,probability:double>>")
    return out.withColumnRenamed("id", id_col)
