"""Mail as a source: folders of .eml files, message parsing, blobs, and batch and streaming readers."""

from __future__ import annotations

import email
import email.parser
import email.policy
import email.utils
import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.functions.text import canonical_id, clean_text, extract_refs, html_text, normalise_address, normalise_message_id, simhash_text

#: Parsed headers that a worker keeps, the longest value it keeps, messages of a frame that it hands on.
HEADERS, HEADER_CHARS, FRAME = 1024, 512, 256
FATAL = ("StartBoundaryNotFoundDefect", "MultipartInvariantViolationDefect")
PARSED = (
    "path string, error string, message_id string, in_reply_to string, references array<string>, subject string, sent_at_raw string, "
    "sent_us long, sender string, recipients array<struct<role: string, address: string, name: string>>, body_text string, "
    "body_clean string, simhash long, size_bytes long, eml_sha256 string, "
    "attachments array<struct<sha: string, filename: string, content_type: string, content_id: string, size: long>>"
)


def eml_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of every .eml under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content")


_read_header = lru_cache(HEADERS)(email.policy.default.header_factory)


def _header_of(name: str, value: str):
    """A parsed header; short ones are kept, as a message's are read many times and are alike in many messages."""
    return (_read_header if len(value) <= HEADER_CHARS else email.policy.default.header_factory)(name, value)


POLICY = email.policy.default.clone(header_factory=_header_of)
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _header(message, name: str) -> str:
    """A header as text; one that can't be decoded is empty."""
    try:
        return str(message[name] or "").strip()
    except Exception:  # the header parser raises what it likes on mangled input
        return ""


def _date(text: str) -> tuple[str | None, int | None]:
    """The Date header as ISO text with its own offset, and as microseconds of UTC; none if it isn't one."""
    try:
        when = email.utils.parsedate_to_datetime(text)
        when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
        return when.isoformat(), (when.astimezone(timezone.utc) - EPOCH) // timedelta(microseconds=1)
    except (TypeError, ValueError, IndexError, OverflowError):
        return None, None


def _content(part) -> str:
    """Decoded text of a part; an unknown charset is read as UTF-8."""
    try:
        text = part.get_content()
    except Exception:  # unknown charsets and broken encodings alike
        data = part.get_payload(decode=True)
        text = data.decode("utf-8", "replace") if isinstance(data, bytes) else ""
    return text if isinstance(text, str) else ""


def _attached(message) -> list[dict]:
    """Attachments; a part whose bytes can't be read counts as empty, a message that can't list them has none."""
    out = []
    try:
        found = list(message.iter_attachments())
    except Exception:  # raised by messages whose structure contradicts their type
        return out
    for part in found:
        data = part.get_payload(decode=True) or b""
        out.append({"sha": hashlib.sha256(data).hexdigest(), "filename": part.get_filename(), "content_type": part.get_content_type(), "content_id": _header(part, "Content-ID") or None, "size": len(data)})
    return out


def _storable(value):
    """Text without lone surrogates, which tables can't hold, throughout a record."""
    if isinstance(value, str):
        return value.encode("utf-8", "replace").decode("utf-8")
    if isinstance(value, list):
        return [_storable(v) for v in value]
    return {k: _storable(v) for k, v in value.items()} if isinstance(value, dict) else value


def _addresses(message, header: str) -> list[tuple[str, str]]:
    out: dict[str, str] = {}
    try:
        lines = [str(x) for x in message.get_all(header, [])]
    except Exception:  # a mangled header costs its addresses, not the message
        return []
    for name, address in email.utils.getaddresses(lines):
        a = address.strip().strip("<>").lower()
        if "@" in a:
            out.setdefault(a, name)
    return list(out.items())


def parse_message(raw: bytes) -> dict:
    """The fields of one RFC 5322 message; ValueError if there is nothing to read."""
    if not raw or not raw.strip():
        raise ValueError("empty message")
    m = email.message_from_bytes(raw, policy=POLICY)
    broken = [d for part in m.walk() for d in part.defects if type(d).__name__ in FATAL]
    if broken or not m.keys():
        raise ValueError(f"broken message: {type(broken[0]).__name__ if broken else 'no headers'}")
    when_raw, when = _date(_header(m, "Date"))
    try:
        body = m.get_body(("plain", "html"))
    except Exception:  # a structure without a body that the parser can walk
        body = None
    text = "" if body is None else _content(body)
    text = html_text(text) if body is not None and body.get_content_subtype() == "html" else text
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    clean = clean_text(text)
    sender = _addresses(m, "From")
    refs = re.findall(r"<[^<>\s]+>", _header(m, "References"))
    return {
        "message_id": _header(m, "Message-ID") or None,
        "in_reply_to": _header(m, "In-Reply-To") or None,
        "references": refs, "subject": _header(m, "Subject"), "sent_at_raw": when_raw, "sent_us": when,
        "sender": sender[0][0] if sender else None,
        "recipients": [{"role": r, "address": a, "name": n} for r, h in (("FROM", "From"), ("TO", "To"), ("CC", "Cc"), ("BCC", "Bcc")) for a, n in (_addresses(m, h)[:1] if r == "FROM" else _addresses(m, h))],
        "body_text": text, "body_clean": clean, "simhash": simhash_text(clean), "size_bytes": len(raw),
        "eml_sha256": hashlib.sha256(raw).hexdigest(), "attachments": _attached(m),
    }


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = re.findall(r"(?:^|, )(\w+) (?=string|array|timestamp|long)", re.sub(r"<[^<>]*(?:<[^<>]*>[^<>]*)*>", "", PARSED))
    for pdf in _frames(batches):
        rows = []
        for path, raw in zip(pdf["path"], pdf["content"], strict=True):
            try:
                rows.append({"path": path, "error": None, **_storable(parse_message(bytes(raw) if raw is not None else b""))})
            except Exception as e:  # whatever one message raises, it is a dead letter and the job goes on
                rows.append({"path": path, "error": _storable(f"{type(e).__name__}: {e}")})
        # as objects: a missing value would turn lists and 64-bit fingerprints into floats
        yield pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})


def _frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows in frames of ``FRAME`` at most, so that few parsed messages are held at a time."""
    for pdf in batches:
        for at in range(0, len(pdf), FRAME):
            yield pdf.iloc[at : at + FRAME]


def parsed_messages(raw: DataFrame) -> DataFrame:
    """One row per raw message (path, content); ``error`` is set where it can't be read (dead letters).

    Adds the canonical ``id``, the same wherever a message is read.
    """
    rows = raw.select("path", "content").mapInPandas(_parse, PARSED).withColumn("sent_at", F.timestamp_micros("sent_us")).drop("sent_us")
    mid = normalise_message_id(F.col("message_id"))
    return rows.withColumn("id", F.when(F.col("error").isNull(), canonical_id(mid, F.col("sent_at_raw"), F.col("sender"), F.col("subject"), F.col("body_text"))))


_KEYED = "path string, content binary, message_id string, sent_at_raw string, sender string, subject string, body_text string, error string"


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _KEYED.split(", ")]
    for pdf in _frames(batches):
        rows = []
        for path, raw in zip(pdf["path"], pdf["content"], strict=True):
            raw = bytes(raw) if raw is not None else b""
            row = {"path": path, "content": raw}
            try:
                head = email.parser.BytesHeaderParser(policy=POLICY).parsebytes(raw)
                own = _header(head, "Message-ID")
                # only mail without an id of its own is read whole for its key
                row |= _storable({"message_id": own} if own else {k: v for k, v in parse_message(raw).items() if k in names})
            except Exception as e:  # the full parse will make a dead letter of it
                row["error"] = type(e).__name__
            rows.append(row)
        yield pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})


def keyed_mail(raw: DataFrame) -> DataFrame:
    """(path, content, key) of raw messages: the canonical id, or the path of what has none; mostly from the headers alone."""
    rows = raw.select("path", "content").mapInPandas(_keys, _KEYED)
    own = canonical_id(normalise_message_id(F.col("message_id")), F.col("sent_at_raw"), F.col("sender"), F.col("subject"), F.col("body_text"))
    return rows.select("path", "content", F.coalesce(F.when(F.col("error").isNull(), own), F.concat(F.lit("\n"), "path")).alias("key"))


def dead_letters(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error is not null").select("path", "error")


def new_messages(refs: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Refs that the ledger doesn't hold, each once."""
    return refs.dropDuplicates(keys).join(ledger.select(*keys), keys, "left_anti")


def blobs(raw: DataFrame) -> DataFrame:
    """Content-addressed bytes: (sha256, prefix, content), each once."""
    keyed = raw.select(F.sha2("content", 256).alias("sha256"), "content")
    return keyed.groupBy("sha256").agg(F.first("content").alias("content")).withColumn("prefix", F.left("sha256", F.lit(2)))


def write_blobs(raw: DataFrame, path: str) -> None:
    """Write-once by digest, under folders of its first two digits."""
    blobs(raw).write.mode("append").partitionBy("prefix").parquet(path)


def storage_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Files and bytes under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def ground_truth(parsed: DataFrame) -> dict[str, DataFrame]:
    """Messages, recipients, addresses, replies, threads and attachments of parsed messages, deduplicated by id."""
    good = parsed.filter("error is null").dropDuplicates(["id"])
    root = normalise_message_id(F.coalesce(F.get("references", F.lit(0)), F.col("in_reply_to"), F.col("message_id")))
    people = good.select(F.col("id").alias("message_id"), F.explode("recipients").alias("r")).select("message_id", "r.role", F.col("r.address").alias("address_id"), "r.name")
    return {
        "messages": good.select("id", "subject", "sent_at_raw", "sent_at", "body_text", "body_clean", "simhash", extract_refs(F.col("subject"), F.col("body_clean")).alias("refs"), "size_bytes", "eml_sha256", F.exists("attachments", lambda x: x["filename"].isNotNull() | x["content_id"].isNull()).alias("has_attachments")),
        "recipients": people.select("message_id", "address_id", "role").distinct(),
        "addresses": people.groupBy(normalise_address(F.col("address_id")).alias("id")).agg(F.sort_array(F.collect_set(F.when(F.col("name") != "", F.col("name")))).alias("display_names")),
        "replies": replies(good),
        "message_threads": good.select(F.col("id").alias("message_id"), root.alias("thread_id")).filter("thread_id is not null"),
        "message_attachments": good.select(F.col("id").alias("message_id"), F.explode("attachments").alias("f")).select("message_id", "f.*").distinct(),
    }


def replies(good: DataFrame) -> DataFrame:
    """(parent, child) among messages (id, in_reply_to, references), each message once."""
    last = normalise_message_id(F.coalesce(F.try_element_at("references", F.lit(-1)), F.col("in_reply_to")))
    links = good.select(F.col("id").alias("child"), F.coalesce(normalise_message_id(F.col("in_reply_to")), last).alias("parent")).filter("parent is not null")
    return links.join(good.select(F.col("id").alias("parent")), "parent", "left_semi").distinct()


def repair_threads(messages: DataFrame, message_threads: DataFrame, copies: DataFrame) -> DataFrame:
    """Threads for unthreaded messages, keyed by account and the provider's thread or own id: new rows."""
    loose = messages.select(F.col("id").alias("message_id")).join(message_threads.select("message_id"), "message_id", "left_anti")
    key = F.coalesce("provider_thread_id", F.col("message_id").cast("string"))
    return loose.join(copies, "message_id").select("message_id", F.concat_ws(":", F.col("account").cast("string"), key).alias("thread_id")).distinct()
