"""Families of files by stated type, and by name where the sender stated none."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Types that say nothing, families by type and by file ending.
SHRUG_TYPES = ("application/octet-stream", "application/binary", "application/unknown", "binary/octet-stream")
FAMILY_OF_TYPE = {
    "pdf": r"application/(?:x-)?pdf",
    "web": r"text/html|application/xhtml\+xml",
    "table": r"text/(?:csv|tab-separated-values)",
    "data": r"(?:application|text)/(?:json|xml|x-yaml|yaml)",
    "mail": r"message/rfc822|application/vnd\.ms-outlook",
    "calendar": r"text/calendar|application/ics",
    "contact": r"text/(?:x-)?vcard",
    "spreadsheet": r"application/vnd\.(?:ms-excel.*|openxmlformats-officedocument\.spreadsheetml.*|oasis\.opendocument\.spreadsheet.*)",
    "document": r"application/(?:msword|rtf|vnd\.openxmlformats-officedocument\.wordprocessingml.*|vnd\.oasis\.opendocument\.text.*)|text/rtf",
    "slides": r"application/vnd\.(?:ms-powerpoint.*|openxmlformats-officedocument\.presentationml.*|oasis\.opendocument\.presentation.*)",
    "archive": r"application/(?:zip|x-zip-compressed|gzip|x-gzip|x-tar|x-7z-compressed|x-rar-compressed|vnd\.rar)",
    "image": r"image/.*",
    "audio": r"audio/.*",
    "video": r"video/.*",
    "text": r"text/.*",
}
FAMILY_OF_ENDING = {
    "pdf": "pdf", "web": "html htm", "table": "csv tsv", "data": "json xml yaml yml", "mail": "eml msg", "calendar": "ics", "contact": "vcf",
    "spreadsheet": "xls xlsx ods", "document": "doc docx odt rtf", "slides": "ppt pptx odp", "archive": "zip gz tar 7z rar",
    "image": "jpg jpeg png gif webp svg bmp tif tiff heic", "audio": "mp3 wav ogg m4a flac", "video": "mp4 mov avi mkv webm", "text": "txt log md",
}
OTHER = "other"
LABELS = {
    "image": "Image", "pdf": "PDF", "web": "Web page", "text": "Text", "data": "Data", "table": "Table", "mail": "Email", "calendar": "Calendar",
    "contact": "Contact", "spreadsheet": "Spreadsheet", "document": "Document", "slides": "Slides", "archive": "Archive", "audio": "Audio", "video": "Video", OTHER: "File",
}
# What a person's word for a file means.
SYNONYMS = {
    "pdf document": "rechnung rechnungen beleg belege quittung invoice invoices receipt vertrag schreiben",
    "document pdf": "dokument dokumente",
    "spreadsheet": "tabelle tabellen excel xlsx csv",
    "image": "bild bilder foto fotos screenshot screenshots",
    "slides": "praesentation powerpoint folien slides",
    "video": "video videos",
    "audio": "audio musik",
    "archive": "archiv zip",
    "calendar": "kalender termin",
}


def file_family(content_type: Column, filename: Column) -> Column:
    """The family of a file; the name decides only where the type says nothing."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    ending = F.lower(F.substring_index(F.coalesce(filename, F.lit("")), ".", -1))
    by_type, by_name = F.lit(None).cast("string"), F.lit(OTHER)
    for family, pattern in FAMILY_OF_TYPE.items():
        by_type = F.coalesce(by_type, F.when(kind.rlike(f"^(?:{pattern})$"), family))
    for family, endings in FAMILY_OF_ENDING.items():
        by_name = F.when(ending.isin(endings.split()), family).otherwise(by_name)
    untyped = (kind == "") | kind.isin(*SHRUG_TYPES)
    return F.when(untyped, F.when(F.coalesce(filename, F.lit("")).contains("."), by_name).otherwise(OTHER)).otherwise(F.coalesce(by_type, F.lit(OTHER)))


def _folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c)).strip()


def resolve_families(words: list[str], offered: list[str]) -> tuple[list[str], list[str]]:
    """Families that the words of a question name, of those that the archive offers; and the other words."""
    labels = {_folded(LABELS[f]): f for f in offered}
    found: list[str] = []
    missed: list[str] = []
    for word in words:
        w = _folded(word)
        named = [w] if w in offered else [labels[w]] if w in labels else [f for to, names in SYNONYMS.items() if w in names.split() for f in to.split() if f in offered]
        found += [f for f in named if f not in found]
        if not named and word.strip():
            missed.append(word.strip())
    return found, missed
