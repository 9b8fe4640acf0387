"""From a question's intent to a filter: addresses, accounts, periods, left-over words."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.functions.files import resolve_families
from mailweave.plans.listing import Filters

# Words of a mention that identify nobody, and the bounds of a match and of a day.
NOISE = frozenset(
    "der die das dem den des ein eine einer einem mein meine meiner meinem meinen von vom bei the and und for from with gmbh mbh ltd inc llc kg ohg e.v".split()
)
SHORTEST, MOST_ADDRESSES, EARLIEST = 3, 5, date(1990, 1, 1)


@dataclass(frozen=True)
class Intent:
    """What a language model, or a form, read out of a question."""

    text: str = ""
    from_mentions: tuple[str, ...] = ()
    to_mentions: tuple[str, ...] = ()
    account_mention: str = ""
    period: str = ""
    after: str = ""
    before: str = ""
    has_attachments: bool | None = None
    file_mentions: tuple[str, ...] = ()
    newest: bool = False


@dataclass(frozen=True)
class Resolved:
    filters: Filters
    unresolved: tuple[str, ...] = ()
    notes: tuple[str, ...] = field(default_factory=tuple)


def folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def tokens(mention: str) -> list[str]:
    found = re.findall(r"[^\W_]+", folded(mention))
    return [w for w in dict.fromkeys(found) if len(w) >= SHORTEST and w not in NOISE]


def resolve_addresses(directory: DataFrame, mention: str) -> list[str]:
    """Addresses (id, name) that match a mention best: 2 for a whole word, 1 for a part; none if too many."""
    words = tokens(mention)
    if not words:
        return []
    text = F.lower(F.concat_ws(" ", "id", "name"))
    score = F.lit(0)
    for w in words:
        whole = text.rlike(rf"(?U)(?<![\p{{L}}\p{{N}}]){re.escape(w)}(?![\p{{L}}\p{{N}}])")
        score = score + F.when(whole, 2).when(text.contains(w), 1).otherwise(0)
    hit = directory.select("id", score.alias("score")).filter("score > 0")
    best = hit.agg(F.max("score").alias("score"))
    rows = hit.join(F.broadcast(best), "score", "left_semi").select("id").distinct().orderBy("id").limit(MOST_ADDRESSES + 1).collect()  # at most six
    return [r["id"] for r in rows] if len(rows) <= MOST_ADDRESSES else []


def window_of(period: str, today: date) -> tuple[date, date]:
    """First and last day of a named period, both included."""
    first = today.replace(day=1)
    quarter = date(today.year, 3 * ((today.month - 1) // 3) + 1, 1)
    before_quarter = quarter - timedelta(days=1)
    a_year_ago = date(today.year - 1, today.month, min(today.day, 28 if today.month == 2 else today.day))
    return {
        "last_7_days": (today - timedelta(days=6), today),
        "last_30_days": (today - timedelta(days=29), today),
        "this_month": (first, today),
        "last_month": ((first - timedelta(days=1)).replace(day=1), first - timedelta(days=1)),
        "this_quarter": (quarter, today),
        "last_quarter": (date(before_quarter.year, 3 * ((before_quarter.month - 1) // 3) + 1, 1), before_quarter),
        "this_year": (date(today.year, 1, 1), today),
        "last_year": (date(today.year - 1, 1, 1), date(today.year - 1, 12, 31)),
        "last_12_months": (a_year_ago + timedelta(days=1), today),
    }[period]


def valid_day(value: str, today: date) -> date | None:
    """An ISO day between 1990 and tomorrow."""
    try:
        day = date.fromisoformat(value)
    except ValueError:
        return None
    return day if EARLIEST <= day <= today + timedelta(days=1) else None


def resolve_account(accounts: dict[str, str], mention: str) -> str | None:
    """The one account (value: label) that a mention matches best, scored as addresses are; none if several do."""
    words = tokens(mention)
    scores = {}
    for value, label in accounts.items():
        text = folded(f"{value} {label}")
        whole = set(re.findall(r"[^\W_]+", text))
        scores[value] = sum(2 if w in whole else int(w in text) for w in words)
    best = [v for v, n in scores.items() if n and n == max(scores.values())]
    return best[0] if len(best) == 1 else None


def resolve(intent: Intent, directory: DataFrame, accounts: dict[str, str], today: date, offered: list[str] | None = None) -> Resolved:
    """Nothing is invented: what matches nothing goes back into the text and is named.

    ``offered``: the file families that the archive holds (``listing.facet_families``).
    """
    notes, unresolved = [], []
    people: dict[str, list[str]] = {}
    for side, mentions in (("from", intent.from_mentions), ("to", intent.to_mentions)):
        people[side] = []
        for m in mentions:
            found = resolve_addresses(directory, m)
            people[side] += found
            if not found:
                unresolved.append(m)
    account = None
    if intent.account_mention:
        account = resolve_account(accounts, intent.account_mention)
        if account is None:
            unresolved.append(intent.account_mention)
    families, words = resolve_families(list(intent.file_mentions), offered or [])
    unresolved += words
    start, end = "", ""
    if intent.period:
        a, b = window_of(intent.period, today)
        start, end = a.isoformat(), b.isoformat()
    for name, value in (("after", intent.after), ("before", intent.before)):
        if value:
            day = valid_day(value, today)
            if day is None:
                notes.append(f"{value} isn't a day that mail can have")
            elif name == "after":
                start = day.isoformat()
            else:
                end = day.isoformat()
    text = " ".join([intent.text, *unresolved]).strip()
    structural = bool(people["from"] or people["to"] or account or start or end or families or intent.has_attachments is not None)
    if intent.newest and structural and text:
        notes.append(f"newest first, so these words were left out: {text}")
        text = ""
    return Resolved(
        Filters(
            text=text, senders=people["from"], recipients=people["to"], account=account, sent_from=start or None, sent_until=end or None,
            has_attachments=intent.has_attachments, families=families,
        ),
        tuple(unresolved),
        tuple(notes),
    )


def interpret(question: str, reader: Callable[[str], dict], directory: DataFrame, accounts: dict[str, str], today: date) -> Resolved:
    """A question through an injected reader that answers an intent's fields; unknown fields are an error."""
    return resolve(Intent(**{k: tuple(v) if isinstance(v, list) else v for k, v in reader(question).items()}), directory, accounts, today)
