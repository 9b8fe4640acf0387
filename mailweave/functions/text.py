"""Scalar functions of message ingest as Spark columns; Python only where built-ins can't express it."""

from __future__ import annotations

import hashlib
import html.parser
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

# Reply prefixes, ticket tokens and what looks like one but isn't.
SUBJECT_PREFIX = r"(?i)^(?:\s*(?:re|aw|fwd?|wg|antw)\s*(?:\[\d+\])?\s*:\s*)+"
NOT_TICKET_KEYS = ("AES", "ASCII", "COVID", "DIN", "EN", "IEC", "ISBN", "ISO", "MD", "MP", "RFC", "RGB", "SHA", "UTF")
TICKET = rf"\b(?!(?:{'|'.join(NOT_TICKET_KEYS)})-)[A-Z][A-Z0-9]{{1,9}}-\d{{1,8}}\b"
HASH_REF = r"(?<![\w#])#\d{2,8}(?!\d)"
#: Characters of a preview.
PREVIEW = 160
SHINGLE_WORDS = 3
#: Shingles whose bits are summed at once.
SHINGLE_BLOCK = 1 << 14

# Where a quoted message, a signature or a disclaimer starts.
GREETING = r"gr(?:ü|ue|u)(?:ß|ss|s)e"
QUOTE_MARKERS = (
    r"^[ \t]*am\b[\s\S]{0,300}?\bschrieb\b[\s\S]{0,200}?:[ \t]*$",
    r"^[ \t]*on\b[\s\S]{0,300}?\bwrote\b[\s\S]{0,200}?:[ \t]*$",
    r"^[ \t]*-{2,}\s*(?:original message|ursprüngliche nachricht|forwarded message|weitergeleitete nachricht)\s*-{2,}[ \t]*$",
    r"^[ \t]*von:[^\n]*\n(?:[^\n]*\n){0,3}?[ \t]*(?:gesendet|datum|an|betreff):",
    r"^[ \t]*from:[^\n]*\n(?:[^\n]*\n){0,3}?[ \t]*(?:sent|date|to|subject):",
)
SIGNATURE_MARKERS = (
    r"^--\s*$",
    r"^[ \t]*[-_=*~]{6,}[ \t]*$",
    rf"^[ \t]*(?:mit (?:freundlichen|besten|herzlichen|lieben) {GREETING}n|mit freundlichem gru(?:ß|ss)|"
    rf"(?:freundliche|viele|beste|liebe|herzliche|sonnige) {GREETING}|best regards|kind regards|warm regards|"
    r"best wishes|sincerely(?: yours)?|regards|cheers|mfg|vg|lg|blg)[ \t]*[,.!]?[ \t]*$",
)
DISCLAIMER_MARKERS = (
    r"^[^\n]{0,120}?\b(?:vertraulichkeitshinweis|confidentiality notice|sitz der gesellschaft|registergericht|"
    r"handelsregister|amtsgericht|ust-?idnr|umsatzsteuer-identifikationsnummer|hrb\s*\d|"
    r"please consider the environment|bitte denken sie an die umwelt)\b",
    r"^[^\n]{0,120}?\bdiese\s+e-?mail\b[^\n]{0,200}?\b(?:vertraulich|vertrauliche|irrtümlich|bestimmt)\b",
    r"^[^\n]{0,120}?\bthis\s+e-?mail\b[^\n]{0,200}?\b(?:confidential|privileged|intended recipient)\b",
    r"^[^\n]{0,120}?\bthe information contained in this\b",
)
_MARKERS = [re.compile(p, re.I | re.M) for p in (*QUOTE_MARKERS, *SIGNATURE_MARKERS, *DISCLAIMER_MARKERS)]


def normalise_address(c: Column) -> Column:
    """Trimmed, without angle brackets, lower case."""
    return F.lower(F.regexp_replace(F.trim(c), r"^<|>$", ""))


def domain_of(c: Column) -> Column:
    return F.substring_index(c, "@", -1)


def local_part_of(c: Column) -> Column:
    return F.regexp_replace(c, r"@[^@]*$", "")


def normalise_message_id(c: Column) -> Column:
    """Without angle brackets; only the half after the last @ is lowered."""
    bare = F.regexp_replace(F.trim(c), r"^<|>$", "")
    right = F.substring_index(bare, "@", -1)
    return F.when(bare.contains("@"), F.concat(F.left(bare, F.length(bare) - F.length(right)), F.lower(right))).otherwise(bare)


def canonical_id(message_id: Column, sent_at: Column, sender: Column, subject: Column, body: Column) -> Column:
    """The message id, or a digest of what identifies the message without one."""
    parts = [F.coalesce(x, F.lit("")) for x in (sent_at, sender, subject)]
    digest = F.sha2(F.concat_ws("|", *parts, F.sha2(F.coalesce(body, F.lit("")), 256)), 256)
    return F.coalesce(F.when(message_id != "", message_id), F.concat(F.lit("sha256:"), digest))


def normalise_subject(c: Column) -> Column:
    """Reply prefixes and tickets removed, white space folded, lower case."""
    bare = F.regexp_replace(c, SUBJECT_PREFIX, "")
    bare = F.regexp_replace(F.regexp_replace(bare, TICKET, " "), HASH_REF, " ")
    bare = F.regexp_replace(bare, r"[\[(]\s*[\])]", " ")
    return F.lower(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")))


def extract_refs(*texts: Column) -> Column:
    """Sorted distinct ticket tokens of all texts."""
    found = [F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(f"({p})"), F.lit(1)) for t in texts for p in (TICKET, HASH_REF)]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def participant_key(addresses: Column) -> Column:
    """Digest of the sorted set of addresses; empty without any."""
    people = F.array_sort(F.array_distinct(F.filter(addresses, lambda a: a.isNotNull() & (a != ""))))
    return F.when(F.size(people) > 0, F.sha2(F.array_join(people, "|"), 256)).otherwise("")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(simhash: Column, bits: int = 16) -> Column:
    """The bands of a 64-bit fingerprint, lowest bits first."""
    mask = F.lit((1 << bits) - 1).cast("long")
    return F.array(*[F.shiftrightunsigned(simhash, bits * i).bitwiseAND(mask) for i in range(64 // bits)])


def preview(c: Column, size: int = PREVIEW) -> Column:
    """White space folded; cut with an ellipsis."""
    folded = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(folded) > size, F.concat(F.rtrim(F.left(folded, F.lit(size))), F.lit("…"))).otherwise(folded)


def searchable_terms(c: Column) -> Column:
    """Lowered words of letters and digits."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)([\p{L}\p{N}]+)"), F.lit(1)), F.lower)


def remote_references(html: Column) -> Column:
    """Number of remote pictures and links that a rendered body would fetch."""
    return F.coalesce(F.regexp_count(html, F.lit(r"(?i)(?:src|background)\s*=\s*[\"']?https?://")), F.lit(0)).cast("long")


def clean_text(text: str | None) -> str:
    """A body up to its first quote, signature or disclaimer, without quoted lines and blank runs."""
    if not text:
        return ""
    ends = [m.start() for p in _MARKERS if (m := p.search(text))]
    body = text[: min(ends, default=len(text))]
    lines = [x.rstrip() for x in body.splitlines() if not x.lstrip().startswith(">")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def simhash_text(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash over word shingles weighted by how often they occur; 0 without words."""
    tokens = re.findall(r"\w+", (text or "").lower())
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or tokens
    counts = Counter(shingles)
    digests = b"".join(hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=8).digest() for s in counts)
    rows, weights = np.frombuffer(digests, np.uint8).reshape(-1, 8), np.fromiter(counts.values(), np.int64, len(counts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), SHINGLE_BLOCK):
        ones += weights[at : at + SHINGLE_BLOCK] @ np.unpackbits(rows[at : at + SHINGLE_BLOCK], axis=1).astype(np.int64)
    return int.from_bytes(np.packbits(2 * ones > weights.sum()).tobytes(), "big", signed=True)


class _Text(html.parser.HTMLParser):
    """Text of a page: block tags break lines, heads and scripts are dropped."""

    BLOCKS = frozenset("address article blockquote br div footer h1 h2 h3 h4 h5 h6 header hr li ol p pre section table td th tr ul".split())
    SKIPPED = frozenset(("head", "script", "style", "title"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs) -> None:
        self.depth += tag in self.SKIPPED
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag) -> None:
        if tag in self.SKIPPED and self.depth:
            self.depth -= 1
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data) -> None:
        if not self.depth:
            self.parts.append(data)


def html_text(page: str | None) -> str:
    parser = _Text()
    parser.feed(page or "")
    parser.close()
    lines = [re.sub(r"[^\S\n]+", " ", x).strip() for x in "".join(parser.parts).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def slug(name: str) -> str:
    """Id of a tag: letters and digits joined by dashes, or a digest if nothing is left."""
    folded = name.lower()
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        folded = folded.replace(a, b)
    plain = unicodedata.normalize("NFKD", folded).encode("ascii", "ignore").decode()
    dashed = re.sub(r"[^a-z0-9]+", "-", plain).strip("-")
    return "tag:" + (dashed or hashlib.sha256(name.encode()).hexdigest()[:16])


@F.pandas_udf(StringType())
def clean_body(texts: pd.Series) -> pd.Series:
    return texts.map(clean_text)


@F.pandas_udf(LongType())
def simhash(texts: pd.Series) -> pd.Series:
    return texts.map(simhash_text)


@F.pandas_udf(StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    return pages.map(html_text)


@F.pandas_udf(StringType())
def tag_id(names: pd.Series) -> pd.Series:
    return names.map(slug)
