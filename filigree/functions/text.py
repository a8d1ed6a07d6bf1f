"""Text normalizers, tokenizers and token filters for full-text search."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The ASCII letters, lower-cased without touching others, and the dashes that become a hyphen.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DASHES = "‐‑‒–—―"
_ASCII_LOWER = str.maketrans(_UPPER, _LOWER)


def ascii_lower(text: str) -> str:
    return text.translate(_ASCII_LOWER)


def normalize(text: str, form: str | None = "NFKC", lower: bool = True, strip_control: bool = True, collapse: bool = True, dashes: bool = True) -> str:
    """Unicode form, control characters but line feed and tab removed, dashes to hyphens, ASCII lower case, white
    space collapsed and trimmed; each step by flag."""
    if form:
        text = unicodedata.normalize(form, text)
    if strip_control:
        text = "".join(c for c in text if c in "\n\t" or unicodedata.category(c) != "Cc")
    if dashes:
        text = text.translate({ord(c): "-" for c in DASHES})
    if lower:
        text = ascii_lower(text)
    return re.sub(r"\s+", " ", text).strip() if collapse else text


def minimal(text: str) -> str:
    return normalize(text, "NFC", True, False, False, False)


def _is_word(c: str) -> bool:
    return c <= "￿" and (unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd")


# The blocks of CJK signs: repetition marks, kana, kana extensions, ideographs A and basic, compatibility, Hangul.
_CJK = ((0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xAC00, 0xD7A3))


def _is_cjk(c: str) -> bool:
    return any(low <= ord(c) <= high for low, high in _CJK)


@lru_cache(maxsize=1)
def _runs() -> re.Pattern[str]:
    """Runs of CJK signs, and of other letters and digits of the basic plane."""
    word = [_is_word(chr(i)) and not _is_cjk(chr(i)) for i in range(1 << 16)]
    edges = [i for i in range(1 << 16) if word[i] != (i > 0 and word[i - 1])]
    ranges = "".join(f"{re.escape(chr(low))}-{re.escape(chr(high - 1))}" for low, high in zip(edges[::2], [*edges[1::2], 1 << 16][: len(edges[::2])]))
    cjk = "".join(f"{chr(low)}-{chr(high)}" for low, high in _CJK)
    return re.compile(f"[{cjk}]+|[{ranges}]+")


def mixed_bigrams(text: str, unigrams: bool = True) -> tuple[list[str], int]:
    """(tokens, length for norms): words are runs of letters and digits; runs of CJK signs give overlapping bigrams, a
    lone one itself. ``unigrams`` adds every sign of a longer run, which the length does not count."""
    tokens, length = [], 0
    for run in _runs().findall(ascii_lower(unicodedata.normalize("NFKC", text))):
        if _is_cjk(run[0]):
            pairs = [run[k : k + 2] for k in range(len(run) - 1)] or [run]
            tokens += pairs + (list(run) if unigrams and len(run) > 1 else [])
            length += len(pairs)
        else:
            tokens.append(run)
            length += 1
    return tokens, length


def stopwords(words: Iterable[str]) -> Callable[[list[str]], list[str]]:
    drop = frozenset(words)
    return lambda tokens: [t for t in tokens if t not in drop]


def lowercase(tokens: list[str]) -> list[str]:
    return [t.lower() for t in tokens]


# Variant forms of ideographs and the standard form of each.
ORTHOGRAPHIC = {"邉": "辺", "邊": "辺", "髙": "高", "﨑": "崎", "濵": "浜", "濱": "浜", "齋": "斎", "齊": "斉", "德": "徳", "澤": "沢", "瀨": "瀬", "眞": "真", "廣": "広", "國": "国", "學": "学", "櫻": "桜"}


def variants(mapping: dict[str, str] = ORTHOGRAPHIC) -> Callable[[list[str]], list[str]]:
    """Emits a token as it is, in standard signs, and with each registered variant of its standard signs."""
    if set(mapping.values()) & set(mapping):
        raise ValueError("a standard sign cannot be a variant of another")
    table, forms = str.maketrans(mapping), {}
    for variant, standard in sorted(mapping.items()):
        forms.setdefault(standard, []).append(variant)

    def expand(tokens: list[str]) -> list[str]:
        out = []
        for t in tokens:
            plain = t.translate(table)
            out += dict.fromkeys([t, plain, *(plain.replace(c, v) for c in dict.fromkeys(plain) for v in forms.get(c, ()))])
        return out

    return expand


class Registry:
    """Tokenizers by name: each maps a text to (tokens, length)."""

    def __init__(self) -> None:
        self._known: dict[str, Callable[[str], tuple[list[str], int]]] = {"mixed-bigram": lambda t: mixed_bigrams(t, False), "mixed-bigram-unigram": mixed_bigrams}

    def register(self, name: str, tokenizer: Callable[[str], tuple[list[str], int]], *filters: Callable[[list[str]], list[str]]) -> None:
        def run(text: str) -> tuple[list[str], int]:
            tokens, length = tokenizer(text)
            for f in filters:
                tokens = f(tokens)
            return tokens, len(tokens) if length < 0 else length

        self._known[name] = run

    def __getitem__(self, name: str) -> Callable[[str], tuple[list[str], int]]:
        return self._known[name]


REGISTRY = Registry()


_CJK_CLASS = "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in _CJK)
#: Texts of these characters alone come out of NFKC with the same words and runs: ASCII, letters of Latin blocks that
#: have no compatibility form, common marks, kana and basic ideographs.
_PLAIN = r"^[\x00-\x7F\xA0-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{2013}\x{2014}\x{2018}-\x{201E}\x{2022}\x{2026}\x{20AC}\x{3000}-\x{3003}\x{3005}-\x{3007}\x{300C}-\x{300F}\x{3041}-\x{3096}\x{309D}\x{309E}\x{30A1}-\x{30FE}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}\x{FFFD}]*$"


def _split(run: Callable[[str], tuple[list[str], int]], text: Column) -> Column:
    @F.pandas_udf("tokens array<string>, length int")
    def split(s: pd.Series) -> pd.DataFrame:
        done = [(None, None) if t is None else run(t) for t in s]
        return pd.DataFrame({"tokens": [d[0] for d in done], "length": pd.array([d[1] for d in done], "Int32")})

    return split(text)


def tokenized(text: Column, tokenizer: str | None = None, held: Column | None = None) -> tuple[Column, Column]:
    """(tokens, length) columns; ``held`` is a column with the tokens, where there is one already. Without a tokenizer's name these are ``mixed_bigrams``: in the JVM for texts of plain
    characters, in Arrow batches for those that NFKC may change. A named tokenizer runs in Arrow batches."""
    if tokenizer is not None:
        both = _split(REGISTRY[tokenizer], text)
        return both["tokens"], both["length"]
    folded, ascii_only = F.translate(text, _UPPER, _LOWER), F.octet_length(text) == F.char_length(text)
    plain, cjk = ascii_only | text.rlike(_PLAIN), ~ascii_only & text.rlike(f"[{_CJK_CLASS}]")
    words = F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    runs = F.regexp_extract_all(folded, F.lit(rf"[{_CJK_CLASS}]+|[\p{{L}}\p{{Nd}}&&[^{_CJK_CLASS}]]+"), F.lit(0))
    signs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substring(r, i, F.lit(1)))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    parts = lambda r: F.when(r.rlike(f"^[{_CJK_CLASS}]{{2}}"), F.concat(pairs(r), signs(r))).otherwise(F.array(r))
    size = lambda r: F.when(r.rlike(f"^[{_CJK_CLASS}]{{2}}"), F.length(r) - 1).otherwise(F.lit(1))
    other = _split(mixed_bigrams, F.when(~plain, text))
    tokens = F.when(~plain, other["tokens"]).when(cjk, F.flatten(F.transform(runs, parts))).otherwise(words)
    length = F.when(~plain, other["length"]).when(cjk, F.aggregate(F.transform(runs, size), F.lit(0), lambda x, y: x + y))
    # Without CJK signs every token counts; callers that hold the tokens need not find them again.
    return tokens, F.coalesce(length, F.size(tokens) if held is None else F.size(held))


def tokens_of(text: str, tokenizer: str | None = None) -> list[str]:
    """The distinct tokens of one text, on the driver; for queries."""
    return list(dict.fromkeys((mixed_bigrams if tokenizer is None else REGISTRY[tokenizer])(text)[0]))
