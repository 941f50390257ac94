"""Text functions as column expressions, with Python twins for the query side."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CJK = "㐀-䶿一-鿿豈-﫿぀-ヿ"
_RUNS_JAVA = f"[{CJK}]+|[\\p{{L}}\\p{{Nd}}_&&[^{CJK}]]+"
_RUNS = regex.compile(rf"(?V1)[{CJK}]+|[[\p{{L}}\p{{Nd}}_]--[{CJK}]]+")
_IS_CJK = re.compile(f"[{CJK}]")
_ASCII = str.maketrans(UPPER, LOWER)


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(text, UPPER, LOWER)


def tokens(text: Column) -> Column:
    """Words in ASCII lower case; runs of CJK letters as overlapping pairs, a single one as itself."""
    pairs = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - 1)), lambda j: F.substring(r, j, F.lit(2))))
    runs = F.regexp_extract_all(ascii_lower(text), F.lit(_RUNS_JAVA), F.lit(0))
    plain = ~text.rlike(f"[{CJK}]")
    return F.when(text.isNull(), F.array().cast("array<string>")).when(plain, runs).otherwise(F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{CJK}]"), pairs(r)).otherwise(F.array(r)))))


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def py_tokens(text: str) -> list[str]:
    """The twin of :func:`tokens`."""
    out = []
    for run in _RUNS.findall(text.translate(_ASCII)):
        if _IS_CJK.match(run) and len(run) > 1:
            out += [run[i : i + 2] for i in range(len(run) - 1)]
        else:
            out.append(run)
    return out


# ASCII in lower case, blanks for what is in no word; bytes of other letters stay.
_WORD_BYTES = bytes(ord(chr(b).lower()) if b == 95 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


@lru_cache(1 << 15)
def _pieces(word: str) -> tuple[str, ...]:
    return tuple(py_tokens(word))


def term_counts(data: bytes | None) -> Counter[str]:
    """How often each of :func:`tokens` occurs in a text's UTF-8 bytes.

    No token spans an ASCII character that is in no word, so texts are cut there first, which is cheap; only pieces with other
    letters are matched, once for each distinct one.
    """
    found = Counter((data or b"").translate(_WORD_BYTES).decode("utf-8", "replace").split())
    if data and not data.isascii():
        for word in [w for w in found if not w.isascii()]:
            n = found.pop(word)
            for t in _pieces(word) if len(word) <= 64 else py_tokens(word):
                found[t] += n
    return found


def py_distinct_tokens(text: str) -> list[str]:
    return list(dict.fromkeys(py_tokens(text)))


def py_ascii_lower(text: str) -> str:
    return text.translate(_ASCII)


def is_single_cjk(token: str) -> bool:
    return len(token) == 1 and bool(_IS_CJK.match(token))


def first_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def contains_fold(text: Column, sub: str) -> Column:
    """Whether text contains the lower-case ``sub``, whatever the case of ASCII letters; never for an empty one."""
    # Java's (?i) folds ASCII letters only.
    return F.coalesce(text.rlike("(?i)" + re.escape(sub)), F.lit(False)) if sub else F.lit(False)


def contains_lower(text: Column, sub: str) -> Column:
    """``contains(lower(text), sub)``. Lowering a text is dear, and only two other letters have ASCII ones below them: İ and the Kelvin sign."""
    whole = F.contains(F.lower(text), F.lit(sub))
    if not sub or not sub.isascii() or sub != sub.lower():
        return whole
    other = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a"))
    return F.when(other, whole).otherwise(text.rlike("(?i)" + re.escape(sub)))


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def py_ellipsis(text: str, n: int) -> str:
    return text if len(text) <= n else text[:n] + "..."


def human_bytes(n: int) -> str:
    size, unit = float(n), "B"
    for bigger in ("KB", "MB", "GB", "TB"):
        if size < 1024:
            break
        size, unit = size / 1024, bigger
    return f"{n} B" if unit == "B" else f"{size:.1f} {unit}"


# ---- strict formats ----

# Java's word boundary follows Unicode; this one is that of ASCII words, as the formats need it.
EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_OCTET = r"(?:2(?:5[0-5]|[0-4][0-9])|1[0-9]{2}|[1-9]?[0-9])"
_AN = "0-9A-Za-z"
_LABEL = f"[{_AN}](?:[-{_AN}]{{0,61}}[{_AN}])?"
FORMATS = {
    "ip": rf"{EDGE}{_OCTET}(?:\.{_OCTET}){{3}}{EDGE}",
    "domain": rf"{EDGE}(?:{_LABEL}\.)+[A-Za-z]{{2,24}}{EDGE}",
    "email": rf"{EDGE}[-+%._{_AN}]+@[-.{_AN}]+\.[A-Za-z]{{2,}}{EDGE}",
    **{f"hash_{name}": rf"{EDGE}[0-9A-Fa-f]{{{n}}}{EDGE}" for name, n in (("sha256", 64), ("sha1", 40), ("md5", 32))},
    "url": rf"{EDGE}https?://[^ \t\n\r\f<>\"']+{EDGE}",
    "file_path": rf"(?:/[-._{_AN}]+){{2,}}|\\[-\\ ._{_AN}]+",
}
# What each format can't do without: a cheap test that spares most texts the search.
HINTS = {
    "ip": r"[0-9]\.[0-9]", "domain": r"[0-9A-Za-z]\.[0-9A-Za-z]", "email": "@", "url": "https?://", "file_path": r"/[-._0-9A-Za-z]+/|\\\\",
    **{f"hash_{name}": f"[0-9A-Fa-f]{{{n}}}" for name, n in (("sha256", 64), ("sha1", 40), ("md5", 32))},
}
_COMPILED = {k: re.compile(v) for k, v in FORMATS.items()}
_FOLDED = {"domain", "email", "hash_sha256", "hash_sha1", "hash_md5"}


def strict_matches(text: Column, kind: str) -> Column:
    """All matches of a format in a text, in order."""
    found = F.regexp_extract_all(text, F.lit(FORMATS[kind]), F.lit(0))
    return F.when(text.rlike(HINTS[kind]), found).otherwise(F.array().cast("array<string>"))


def strict_tokens(query: str) -> list[tuple[str, str, str]]:
    """(type, raw, norm) of the strict tokens of a query; an address inside an earlier token is skipped."""
    out: list[tuple[str, str, str]] = []
    seen = set()
    for kind, pattern in _COMPILED.items():
        for raw in (m.group() for m in pattern.finditer(query)):
            norm = raw.lower() if kind in _FOLDED else raw
            key = ("hash" if kind.startswith("hash") else kind, norm)
            if key in seen or (kind == "ip" and any(raw in t[1] for t in out)):
                continue
            seen.add(key)
            out.append((kind, raw, norm))
    return out


def has_strict(query: str) -> bool:
    return bool(strict_tokens(query))
