"""Text functions: hashes, SimHash, headline kinds, names, filing items, sentence split, display forms."""

from __future__ import annotations

import hashlib
import html

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def content_hash(title: Column, body: Column) -> Column:
    """sha256 of title, line break, body in lower case with single blanks; NULL as empty."""
    joined = F.lower(F.concat(_text(title), F.lit("\n"), _text(body)))
    return F.sha2(F.trim(F.regexp_replace(joined, r"(?U)\s+", " ")), 256)


def author_hash(name: Column) -> Column:
    """First 16 hex digits of sha256 of the lower-case name; NULL for NULL or empty names."""
    return F.when(_text(name) != "", F.substring(F.sha2(F.lower(name), 256), 1, 16))


# -- SimHash -------------------------------------------------------------------------------------------------------

WORD = r"[a-z0-9$']+"


def simhash_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _simhash_of(digest, width: int):
    def block(words: list) -> list:
        """SimHashes of texts of ``width`` words or more."""
        counts = np.array([len(w) - width + 1 for w in words])
        raw = b"".join(digest(" ".join(w[i : i + width]).encode()) for w in words for i in range(len(w) - width + 1))
        ones = np.add.reduceat(np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1), np.cumsum(counts) - counts, axis=0, dtype=np.int32)
        return np.packbits(ones * 2 > counts[:, None], axis=1).view(">i8").ravel().tolist()

    @pandas_udf(T.LongType())
    def simhash(words: pd.Series) -> pd.Series:
        lists = [w if w is not None and len(w) >= width else None for w in words]
        at = [i for i, w in enumerate(lists) if w is not None]
        out: list = [None] * len(lists)
        begin, size = 0, 0
        for k, i in enumerate(at):
            size += len(lists[i])
            if size > 200_000 or k == len(at) - 1:
                for j, value in zip(at[begin : k + 1], block([lists[j] for j in at[begin : k + 1]])):
                    out[j] = value
                begin, size = k + 1, 0
        return pd.Series(out, dtype="Int64")

    return simhash


def simhash(text: Column, width: int = 3, algorithm: str = "blake2b") -> Column:
    """64-bit SimHash over word runs as a signed long: each bit by majority of the runs' hashes, ties 0.

    ``blake2b`` (8 bytes, big-endian) or ``md5`` (first 8 bytes). NULL for NULL and for texts of fewer than ``width`` words.
    """
    if algorithm == "blake2b":
        digest = lambda b: hashlib.blake2b(b, digest_size=8).digest()
    elif algorithm == "md5":
        digest = lambda b: hashlib.md5(b).digest()[:8]
    else:
        raise ValueError(algorithm)
    return _simhash_of(digest, width)(simhash_words(text))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band_values(h: Column, max_hamming: int) -> Column:
    """``max_hamming + 1`` slices of the hash as structs (band, value): two hashes within the distance share one."""
    bands = max_hamming + 1
    width = 64 // bands
    mask = F.lit((1 << width) - 1 if width < 63 else -1)
    return F.array(*[F.struct(F.lit(b).alias("band"), F.shiftrightunsigned(h, b * width).bitwiseAND(mask).alias("value")) for b in range(bands)])


# -- headlines -----------------------------------------------------------------------------------------------------


def headline_key(title: Column, unicode: bool = True) -> Column:
    """Letters and digits of a headline in lower case, single blanks; NULL when nothing is left.

    ``unicode=False`` keeps ASCII letters and digits only, so headlines in other scripts have no key.
    """
    other = r"[^\p{L}\p{N}]+" if unicode else "[^a-z0-9]+"
    return F.nullif(F.trim(F.regexp_replace(F.lower(title), other, " ")), F.lit(""))


def any_pattern(patterns: list[str]) -> str:
    return "(?iU)" + "|".join(f"(?:{p})" for p in patterns)


def classify(title: Column, rules: list[tuple[str, list[str]]], default: str, outlet: Column | None = None, outlets: dict[str, list[str]] | None = None, unless: dict[str, list[str]] | None = None) -> Column:
    """The first kind whose patterns a text matches, else ``default``.

    ``rules`` are (kind, patterns) in order. ``outlets`` gives outlets that decide a kind by themselves; ``unless`` gives
    patterns that keep a text from a kind. NULL reads as empty. Patterns may use any Java syntax; they are matched
    without case, with Unicode classes, in one expression inside the JVM.
    """
    head = _text(title)
    out = None
    for kind, patterns in rules:
        hit = head.rlike(any_pattern(patterns)) if patterns else F.lit(False)
        if unless and unless.get(kind):
            hit = hit & ~head.rlike(any_pattern(unless[kind]))
        if outlet is not None and outlets and outlets.get(kind):
            hit = hit | F.lower(F.trim(_text(outlet))).isin(outlets[kind])
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return F.lit(default) if out is None else out.otherwise(default)


def matches_any(patterns: list[str], *parts: Column) -> Column:
    """Do the parts, joined by blanks, match one of the patterns? False without patterns."""
    return F.concat_ws(" ", *[_text(p) for p in parts]).rlike(any_pattern(patterns)) if patterns else F.lit(False)


def mentions_name(ticker: Column, title: Column, body: Column, keys: Column) -> Column:
    """Does the text name the ticker (exact case, with or without $) or one of ``keys`` (array, lower case), as whole words?"""
    text = F.concat(_text(title), F.lit(" "), _text(body))
    whole = lambda quoted: F.concat(F.lit(r"(?U)(?<!\w)"), quoted, F.lit(r"(?!\w)"))
    quote = lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))
    named = F.rlike(text, whole(F.concat(F.lit(r"\$?"), quote(ticker))))
    return F.coalesce(named, F.lit(False)) | F.coalesce(F.exists(keys, lambda k: F.rlike(F.lower(text), whole(quote(k)))), F.lit(False))


# -- names ---------------------------------------------------------------------------------------------------------

# Words that say what kind of company or security a name is.
COMPANY_WORDS = r"(?iU)\b(inc|incorporated|corp|corporation|co|company|holdings?|group|plc|ltd|limited|n\.?v|s\.?a|ag|the|class [a-z]|common stock)\b\.?"
SECURITY_WORDS = r"(?i)\s*-?\s*(?:New\s+)?(?:Class [A-Z] )?(?:Common Stock|Capital Stock|Ordinary Shares?|Common Shares?|Common Units.*|American Depositary Shares.*)\s*$"
NOT_EQUITY = r"(?i)warrant|\brights?\b|preferred|\bnotes?\b|debenture|subordinated|\d+(\.\d+)?%"
UNITS, PARTNERSHIP = r"(?i)\bunits?\b", r"(?i)common units|limited partner"


def clean_name(raw: Column) -> Column:
    """Company name without what follows " - " and without the security type at its end."""
    return F.trim(F.regexp_replace(F.split(raw, " - ", 2)[0], SECURITY_WORDS, ""))


def is_equity(symbol: Column, name: Column) -> Column:
    """No preferred series, warrants, rights, notes or units (partnership units stay)."""
    return ~(symbol.contains("$") | name.rlike(NOT_EQUITY) | (name.rlike(UNITS) & ~name.rlike(PARTNERSHIP)))


def name_keys(company: Column, aliases: Column) -> Column:
    """Distinct lower-case forms: aliases, the name without company words, its first word if of four letters or more."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(_text(company), COMPANY_WORDS, " "), r"(?U)[^\w\s&'-]", " "), r"(?U)\s+", " "))
    low = F.lower(bare)
    first = F.split(low, " ")[0]
    keys = F.concat(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.lower(a)), F.array(low), F.when(F.length(first) >= 4, F.array(first)).otherwise(F.array().cast("array<string>")))
    return F.filter(F.array_distinct(keys), lambda k: k != "")


def org_key(name: Column, least: int = 4) -> Column:
    """Organisation name for matching: no company words, punctuation but & ' - as blanks, lower case; NULL under ``least`` characters."""
    key = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, COMPANY_WORDS, " "), r"(?U)[^\w\s&'-]", " "), r"(?U)\s+", " ")))
    return F.when(F.length(key) >= least, key)


def dashed_symbol(ticker: Column) -> Column:
    return F.translate(ticker, ".", "-")


def dotted_symbol(ticker: Column) -> Column:
    return F.translate(F.upper(ticker), "-", ".")


@pandas_udf(T.StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    """HTML entities as characters; there is no built-in for it."""
    return text.map(lambda t: None if t is None else html.unescape(t))


def simple_sentences(text: Column) -> Column:
    """Array of trimmed pieces between white space after ``.!?`` or line breaks, empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def context_text(title: Column, body: Column, pattern: Column, n_tickers: Column, max_chars: int | None = None) -> Column:
    """Text to score for one entity: the whole text, or with several entities only the sentences that match ``pattern``
    (all of them when none does), cut to ``max_chars`` characters if given."""
    whole = F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(body, F.lit("")))
    own = F.filter(simple_sentences(whole), lambda s: F.rlike(s, pattern))
    picked = F.when((n_tickers > 1) & (F.size(own) > 0), F.array_join(own, " ")).otherwise(whole)
    return picked if max_chars is None else F.substring(picked, 1, max_chars)


# -- filing items --------------------------------------------------------------------------------------------------

# Names of the items of form 8-K and the groups they are shown in. 9.01 (exhibits) is shown nowhere.
ITEM_NAMES = {
    "1.01": "Material agreement", "1.02": "Agreement terminated", "1.03": "Bankruptcy or receivership", "1.04": "Mine safety", "1.05": "Cybersecurity incident",
    "2.01": "Acquisition or disposition completed", "2.02": "Earnings results", "2.03": "New debt or obligation", "2.04": "Debt acceleration or default trigger", "2.05": "Restructuring or exit costs", "2.06": "Material impairment",
    "3.01": "Delisting notice", "3.02": "Unregistered share sale", "3.03": "Change to shareholder rights", "4.01": "Auditor change", "4.02": "Prior financials can't be relied on",
    "5.01": "Change in control", "5.02": "Director or officer change", "5.03": "Bylaw or charter change", "5.04": "Benefit plan trading suspension", "5.05": "Code of ethics change", "5.07": "Shareholder vote", "5.08": "Director nominations",
    "7.01": "Reg FD disclosure", "8.01": "Other event", "9.01": "Financial statements and exhibits",
}
ITEM_GROUPS = {
    "Earnings": ["2.02"],
    "Deal": ["1.01", "1.02", "2.01", "5.01"],
    "Leadership": ["5.02"],
    "Financing": ["2.03", "3.02", "3.03"],
    "Red flag": ["1.03", "1.05", "2.04", "2.05", "2.06", "3.01", "4.01", "4.02"],
    "Other": ["1.04", "5.03", "5.04", "5.05", "5.07", "5.08", "7.01", "8.01"],
}


def split_items(items: Column) -> Column:
    return F.filter(F.transform(F.split(_text(items), ","), lambda x: F.trim(x)), lambda x: x != "")


def describe_items(items: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in ITEM_NAMES.items() for x in kv])
    shown = F.filter(split_items(items), lambda x: x != "9.01")
    return F.transform(shown, lambda x: F.coalesce(F.try_element_at(names, x), F.concat(F.lit("Item "), x)))


def item_groups(codes: Column) -> Column:
    """Groups of an array of item codes, in their fixed order."""
    groups = [F.when(F.arrays_overlap(codes, F.array(*[F.lit(c) for c in members])), F.lit(name)) for name, members in ITEM_GROUPS.items()]
    return F.filter(F.array(*groups), lambda x: x.isNotNull())


# -- display forms -------------------------------------------------------------------------------------------------


def tone(score: Column, band: float = 0.1) -> Column:
    return F.when(score > band, "positive").when(score < -band, "negative").when(score.isNotNull(), "neutral")


def gauge(score: Column) -> Column:
    """A score in [-1, 1] as 0 to 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (score + 1) * 50))


def percent(share: Column, digits: int = 1) -> Column:
    return F.format_string(f"%+.{digits}f%%", share * 100)
