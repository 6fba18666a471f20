"""Web extraction as columns: entities, tags, titles, bodies, links, dates, addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tacet import config as C
from tacet.functions.text import let

#: Named character references that are decoded.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "rsquo": "\u2019", "lsquo": "\u2018", "ldquo": '"', "rdquo": '"', "ndash": "\u2013", "mdash": "\u2014", "hellip": "\u2026"}
#: Milliseconds of the units of relative dates; a month is 30 days and a year 365.
UNITS = {"second": 1000, "sec": 1000, "minute": 60_000, "min": 60_000, "hour": C.HOUR_MS, "hr": C.HOUR_MS, "day": 24 * C.HOUR_MS, "week": 168 * C.HOUR_MS, "month": 720 * C.HOUR_MS, "year": 8760 * C.HOUR_MS}
#: Fixed values, here and in the functions below: the patterns that find titles, bodies, links and dates in a page.
BLANK = r"[\s\u00a0\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, BLANK, " "))


def _chars(x: Column, pattern: str, code) -> Column:
    """Replaces each numeric reference by its character: split around them, then put together again."""

    def put(text: Column) -> Column:
        around, found = F.split(text, pattern.replace("(", "(?:"), -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        pairs = F.arrays_zip(around.alias("a"), found.alias("f"))
        return F.array_join(F.transform(pairs, lambda p: F.concat(p["a"], F.coalesce(_utf8(code(p["f"])), F.lit("")))), "")

    return let(x, put)


def _utf8(n: Column) -> Column:
    """The character of a code point."""

    def octet(v: Column) -> Column:
        return F.lpad(F.hex(v.cast("bigint")), 2, "0")

    def rest(shift: int) -> Column:
        return octet(F.lit(128) + F.shiftright(n, shift).bitwiseAND(F.lit(63)))

    one = octet(n)
    two = F.concat(octet(F.lit(192) + F.shiftright(n, 6)), rest(0))
    three = F.concat(octet(F.lit(224) + F.shiftright(n, 12)), rest(6), rest(0))
    four = F.concat(octet(F.lit(240) + F.shiftright(n, 18)), rest(12), rest(6), rest(0))
    return F.when((n >= 0) & (n < 0x110000), F.decode(F.unhex(F.when(n < 0x80, one).when(n < 0x800, two).when(n < 0x10000, three).otherwise(four)), "UTF-8"))


def decode_entities(x: Column) -> Column:
    """Decimal, then hexadecimal, then the named references above; others stay."""

    def decoded(x: Column) -> Column:
        y = F.when(F.contains(x, F.lit("&#")), _chars(_chars(x, "&#([0-9]{1,7});", lambda f: f.cast("int")), "&#[xX]([0-9a-fA-F]{1,6});", lambda f: F.conv(f, 16, 10).cast("int"))).otherwise(x)
        for name, char in [*((k, v) for k, v in NAMED.items() if k != "amp"), ("amp", "&")]:
            y = F.regexp_replace(y, f"(?i)&{name};", char)
        return F.when(F.contains(x, F.lit("&")), y).otherwise(x)

    return let(x, decoded)


def strip_tags(html: Column) -> Column:
    x = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg|template).*?</\1>", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    return squeeze(decode_entities(x))


def first_match(html: Column, *patterns: str) -> Column:
    """The first capture that is not blank, decoded; else an empty text."""

    def found(h: Column) -> Column:
        return F.coalesce(*[let(F.regexp_extract(h, p, 1), lambda f: F.when(squeeze(f) != "", f)) for p in patterns])

    return F.coalesce(squeeze(decode_entities(let(html, found))), F.lit(""))


def _meta(key: str, names: str, value: str = "content") -> str:
    return rf"(?i)<meta[^>]+{key}=[\"'](?:{names})[\"'][^>]+{value}=[\"']([^\"']+)[\"']"


def title(html: Column) -> Column:
    """og:title, twitter:title, h1 or title; without a short trailing site name."""
    raw = first_match(html, _meta("property", "og:title"), _meta("name", "twitter:title"), r"(?is)<h1[^>]*>(.{3,220}?)</h1>", r"(?is)<title[^>]*>(.{3,220}?)</title>")
    return F.trim(F.regexp_replace(raw, "\\s*[|\u2013-]\\s*[^|\u2013-]{0,40}$", ""))


def body(html: Column) -> Column:
    """The first twelve paragraphs of 45 characters or more, else more and more of the page; at most MAX_TEXT characters."""
    about = first_match(html, _meta("property", "og:description"), _meta("name", "description"))
    region = F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<article.*?</article>", 0), F.lit("")), F.nullif(F.regexp_extract(html, r"(?is)<main.*?</main>", 0), F.lit("")), html)

    def build(r: Column) -> Column:
        paragraphs = F.filter(F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), strip_tags), lambda p: F.length(p) >= 45)
        text = F.array_join(F.slice(paragraphs, 1, 12), " ")
        text = let(text, lambda t: F.when(F.length(t) < 120, F.trim(F.concat(about, F.lit(" "), t))).otherwise(t))
        return let(text, lambda t: F.when(F.length(t) < 120, F.substring(strip_tags(r), 1, C.MAX_TEXT)).otherwise(t))

    return F.trim(F.substring(let(region, build), 1, C.MAX_TEXT))


def loose_date(x: Column, now_ms) -> Column:
    """Epoch milliseconds of "n units ago", yesterday, today, just now, or an ISO date; null for anything else."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    rel = r"^(?:about\s+)?(\d{1,9})\s*(second|sec|minute|min|hour|hr|day|week|month|year)s?\s+ago$"

    def ago(m: Column) -> Column:
        per = F.lit(None).cast("bigint")
        for name, ms in UNITS.items():
            per = F.when(m["unit"] == name, F.lit(ms).cast("bigint")).otherwise(per)
        return F.when(m["n"] != "", now - F.when(m["n"] != "", m["n"]).cast("bigint") * per)

    def read(t: Column) -> Column:
        def dated(s: Column) -> Column:
            relative = let(F.struct(F.regexp_extract(s, rel, 1).alias("n"), F.regexp_extract(s, rel, 2).alias("unit")), ago)
            other = F.when(s == "yesterday", now - 24 * C.HOUR_MS).when(s.isin("today", "just now"), now).otherwise(F.unix_millis(F.try_to_timestamp(t)))
            return F.when(s == "", None).when(F.contains(s, F.lit("ago")), F.coalesce(relative, other)).otherwise(other)

        return let(F.trim(F.lower(t)), dated)

    return let(x, read)


def published(html: Column, now_ms) -> Column:
    raw = first_match(html, _meta("property", "article:published_time"), r'(?i)"datePublished"\s*:\s*"([^"]+)"', _meta("name", "pubdate|publish-date|date"), r"(?i)<time[^>]+datetime=[\"']([^\"']+)[\"']")
    return loose_date(raw, now_ms)


def absolute(href: Column, base: Column) -> Column:
    """An http(s) address resolved against a base; null for other schemes. Dot segments are resolved."""
    scheme, host = F.regexp_extract(base, r"(?i)^(https?):", 1), F.regexp_extract(base, r"(?i)^https?://([^/?#]+)", 1)
    path = F.regexp_extract(base, r"(?i)^https?://[^/?#]+([^?#]*)", 1)
    root = F.concat(F.lower(scheme), F.lit("://"), F.lower(host))
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")
    out = (
        F.when(F.rlike(href, F.lit("(?i)^https?://")), href)
        .when(F.rlike(href, F.lit("(?i)^[a-z][a-z0-9+.-]*:")), None)
        .when(F.startswith(href, F.lit("//")), F.concat(F.lower(scheme), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(F.startswith(href, F.lit("?")), F.concat(root, F.when(path == "", "/").otherwise(path), href))
        .otherwise(F.concat(root, folder, href))
    )
    return F.when(scheme != "", F.regexp_replace(F.regexp_replace(out, r"/\./", "/"), r"/[^/:]+/\.\./", "/")).when(F.rlike(href, F.lit("(?i)^https?://")), href)


ANCHOR = r"(?is)<a\b[^>]*href=[\"']([^\"'#]+)[\"'][^>]*>(.{0,200}?)</a>"


def links(html: Column, base: Column, least: int = 18) -> Column:
    """array<struct<pos, url, label>> of the anchors with a long enough label; the first label of each url."""

    def collect(h: Column) -> Column:
        hrefs, labels = (F.regexp_extract_all(h, F.lit(ANCHOR), F.lit(i)) for i in (1, 2))
        rows = F.transform(F.arrays_zip(hrefs.alias("h"), labels.alias("l")), lambda p, i: F.struct(i.alias("pos"), absolute(p["h"], base).alias("url"), strip_tags(p["l"]).alias("label")))
        return F.filter(rows, lambda r: r["url"].isNotNull() & (F.length(r["label"]) >= least))

    return let(html, collect)


def publisher(url: Column, fallback: str = "Unknown source") -> Column:
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")
    label = F.split_part(host, F.lit("."), F.lit(1))
    return F.when(label != "", F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 1 << 30))).otherwise(fallback)


def report_id(url: Column) -> Column:
    return F.concat(F.lit("rpt-"), F.substring(F.sha1(url), 1, 12))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def citable(url: Column) -> Column:
    return F.coalesce(F.rlike(url, F.lit("(?i)^https?://[^/]+")), F.lit(False))
