"""Column functions over text: tokens, keywords, similarity, dates, caps."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: CJK ideographs that count as one and a half tokens a pair.
CJK = "[一-鿿㐀-䶿豈-﫿]"
HAN = "[一-鿿]"
WIDE = "[一-鿿　-〿＀-￯]"
# Parts of parameter names whose values are secret.
SECRET_KEYS = ("password", "token", "api_key", "secret", "auth")
REDACTED = "***REDACTED***"
HALF_LIFE_DAYS = 30.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def estimate_tokens(text) -> Column:
    """Estimated tokens: ideographs / 1.5 plus other characters / 4, cut to an integer."""
    text = F.coalesce(_col(text), F.lit(""))
    cjk = F.regexp_count(text, F.lit(CJK))
    return F.floor(cjk / F.lit(1.5) + (F.length(text) - cjk) / F.lit(4.0)).cast("int")


def memory_keywords(text) -> Column:
    """Runs of two or more ideographs, then lower-cased words of three letters; repeats stay."""
    text = F.coalesce(_col(text), F.lit(""))
    return F.concat(F.regexp_extract_all(text, F.lit(HAN + "{2,}"), F.lit(0)), F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z]{3,}"), F.lit(0)))


def task_keywords(text, least: int = 2) -> Column:
    """Distinct lower-cased words and bigrams over the text's ideographs, sorted."""
    text = F.coalesce(_col(text), F.lit(""))
    words = F.transform(F.regexp_extract_all(text, F.lit("[a-zA-Z0-9_]{2,}"), F.lit(0)), F.lower)
    han = F.array_join(F.regexp_extract_all(text, F.lit(HAN), F.lit(0)), "")
    n = F.length(han)
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(han, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(F.concat(words, pairs), lambda k: F.length(k) >= least)))


def keyword_match(query: Column, targets: Column) -> Column:
    """Share of the query's keywords that contain, or are contained in, a target keyword."""
    hit = F.filter(query, lambda q: F.exists(targets, lambda t: t.contains(q) | q.contains(t)))
    return F.when((F.size(query) > 0) & (F.size(targets) > 0), F.size(hit) / F.size(query)).otherwise(F.lit(0.0))


def text_match(query: str, text) -> Column:
    """``keyword_match`` of a known query with the memory keywords of a text, without listing those.

    A keyword is contained in one of the text's if the text contains it; it contains
    one if the text has a run of letters (or of ideographs) equal to a part of it.
    """
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    found = re.findall(HAN + "{2,}", query) + re.findall("[a-zA-Z]{3,}", query.lower())
    if not found:
        return F.lit(0.0)

    def hit(word: str) -> Column:
        kind, least = ("[a-z]", 3) if word.isascii() else (HAN, 2)
        parts = {word[i:j] for i in range(len(word)) for j in range(i + least, len(word) + 1)} - {word}
        whole = low.contains(word)  # a plain search, so that most texts need no pattern
        return whole | low.rlike(f"(?<!{kind})(?:{'|'.join(sorted(parts, key=lambda p: (-len(p), p)))})(?!{kind})") if parts else whole

    hits = [hit(w).cast("int") for w in found]
    share = sum(hits[1:], hits[0]) / F.lit(float(len(hits)))
    return F.coalesce(share, F.lit(0.0))  # never null: else a filter on what it goes into scores every text twice


def overlap(keywords: Column, text) -> Column:
    """How many distinct keywords occur in the lower-cased text."""
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    return F.size(F.filter(keywords, lambda k: low.contains(k)))


def char_jaccard(a, b) -> Column:
    """Jaccard similarity of two texts' character sets; an empty text gives 0."""
    a, b = F.coalesce(_col(a), F.lit("")), F.coalesce(_col(b), F.lit(""))
    x, y = F.array_distinct(F.filter(F.split(a, ""), lambda c: c != "")), F.array_distinct(F.filter(F.split(b, ""), lambda c: c != ""))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def days_since(stamp, as_of: str, missing: float = 365.0) -> Column:
    """Days from an ISO text to ``as_of``; unreadable or zone-less texts give ``missing``."""
    stamp = _col(stamp)
    when = F.try_to_timestamp(stamp)
    zoned = stamp.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    gap = (F.lit(as_of).cast("timestamp").cast("double") - when.cast("double")) / 86400.0
    return F.when(when.isNotNull() & zoned, gap).otherwise(F.lit(float(missing)))


def decay(days: Column) -> Column:
    """Half of the weight goes every 30 days."""
    return F.exp(F.lit(-math.log(2) / HALF_LIFE_DAYS) * days)


def memory_score(topic: Column, entry: Column, days: Column) -> Column:
    return (F.lit(0.3) * topic + F.lit(0.7) * entry) * decay(days)


def ellipsis(text, most: int = 500) -> Column:
    """The text, cut with three dots where it is longer than ``most``."""
    text = _col(text)
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def redact(args) -> Column:
    """Hide values whose key contains a secret's name; cut the others at 500 characters."""

    def value(k, v):
        secret = F.lit(False)
        for part in SECRET_KEYS:
            secret = secret | F.lower(k).contains(part)
        return F.when(secret, F.lit(REDACTED)).otherwise(ellipsis(v))

    return F.transform_values(_col(args), value)


def normalize_skill(name) -> Column:
    return F.translate(F.lower(_col(name)), "_ ", "--")


def display_width(text) -> Column:
    """Terminal cells: ideographs and full-width characters take two."""
    text = F.coalesce(_col(text), F.lit(""))
    return F.length(text) + F.regexp_count(text, F.lit(WIDE))


def pad(text, width: int) -> Column:
    """The blanks that fill a text up to ``width`` cells, less two for the border."""
    return F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width - 2) - display_width(text)))


def indent_level(line) -> Column:
    """Half the leading cells; a tab is two."""
    lead = F.regexp_extract(_col(line), r"^([ \t]*)", 1)
    return F.floor((F.length(lead) + F.regexp_count(lead, F.lit("\t"))) / 2).cast("int")


def fill(template: str, **columns) -> Column:
    """Replace ``{name}`` by the columns' texts; unknown names stay."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(_col(c).cast("string"), F.lit("")))
    return out


def summary(body) -> Column:
    """The first of two known sections of a skill's body, else its first 200 characters."""
    body = _col(body)
    section = [F.regexp_extract(body, rf"(?s)##\s*{h}\s*\n+(.+?)(?=\n##|\z)", 1) for h in ("功能概述", "适用场景")]
    return F.trim(F.coalesce(*(F.when(s != "", s) for s in section), F.left(body, F.lit(200))))


def params_block(description, args) -> Column:
    """The description with its parameters listed below it, once."""
    mark = "【执行参数】"
    description, args = _col(description), _col(args)

    def line(e):
        many = F.concat(F.lit("- "), e["key"], F.lit(':\n  """\n  '), e["value"], F.lit('\n  """'))
        return F.when(e["value"].contains("\n"), many).otherwise(F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]))

    listed = F.array_join(F.transform(F.map_entries(args), line), "\n")
    return F.when((F.coalesce(F.size(args), F.lit(0)) > 0) & ~description.contains(mark), F.concat(description, F.lit(f"\n\n{mark}\n"), listed)).otherwise(description)


def result_text(parts: Column, is_error: Column) -> Column:
    """Joined texts of a tool's answer; errors say so."""
    text = F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n")
    return F.when(is_error, F.concat(F.lit("[ERROR] "), text)).otherwise(text)


def well_formed(raw) -> Column:
    """Text from bytes: what is no UTF-8, lone surrogates as well, is replaced by nothing."""
    return F.replace(F.make_valid_utf8(_col(raw).cast("string")), F.lit("\ufffd"), F.lit(""))


def json_object(text) -> Column:
    """A JSON object's fields as texts; null where the text is no object."""
    text = _col(text)
    return F.when(text.rlike(r"(?s)^\s*\{") & F.try_parse_json(text).isNotNull(), F.from_json(text, "map<string,string>"))


def json_text(value) -> Column:
    """JSON over several lines, other scripts kept as they are."""
    return F.to_json(_col(value), {"pretty": "true"})


def utc_iso(stamp=None) -> Column:
    """A moment (now, if none is given) as ISO text in UTC, to the microsecond."""
    when = F.current_timestamp() if stamp is None else _col(stamp).cast("timestamp")
    return F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def stable_id(*parts, length: int = 32) -> Column:
    """An id of hex digits that follows from its parts."""
    return F.left(F.md5(F.concat_ws("\u0001", *map(_col, parts))), F.lit(length))


def session_name(stamp) -> Column:
    """A session's id from its start, to the second."""
    return F.date_format(_col(stamp), "yyyyMMdd_HHmmss")
