"""Extraction from HTML and markdown with Column expressions."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What str.strip() drops; \s of Java is ASCII only.
_BLANK = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
#: Tags that end a line, and the pattern of a title.
_BLOCKS = "p|div|section|article|li|ul|ol|h[1-6]|br|tr|td|th"
_TITLE = "(?i)<title[^>]*>([^<]+)</title>"
#: Href texts that are no links.
PLACEHOLDERS = ("", "#", "#view", "javascript:;", "javascript:void(0)", "javascript:void(0);")


def unescape(text: Column) -> Column:
    """All character references decoded as html.unescape does, named and numeric ones."""

    @F.pandas_udf(T.StringType())
    def decode(values: pd.Series) -> pd.Series:
        return values.map(_html.unescape, na_action="ignore")

    return decode(text)


#: The references that HTML 4 names, each with its semicolon, and the apostrophe's two; and blanks around a text in RE2.
NAMED = {f"&{k};": chr(v) for k, v in name2codepoint.items()} | {"&apos;": "'", "&#39;": "'"}
PLAIN_BLANK = r"[ \t\n\f\r\xA0]+"


def named_references(text: Column) -> Column:
    """The references in NAMED decoded; others, and those that lack their semicolon, stay as they are."""
    form = re.compile("&(?:[A-Za-z0-9]+|#39);")

    @F.pandas_udf(T.StringType())
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda x: form.sub(lambda m: NAMED.get(m[0], m[0]), x), na_action="ignore")

    return F.coalesce(decode(F.when(F.contains(text, F.lit("&")), text)), text)


def html_title(html: Column, fallback: Column) -> Column:
    found = F.regexp_extract(html, _TITLE, 1)
    return F.coalesce(F.nullif(F.trim(found), F.lit("")), fallback)


def html_text(html: Column, decode: Callable[[Column], Column] = unescape, blank: str = _BLANK) -> Column:
    """Text of a page: scripts and styles dropped, block tags as line ends, other tags dropped.

    ``decode`` reads the character references, and ``blank`` is what is stripped at both ends.
    """
    text = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "")
    text = F.regexp_replace(text, rf"(?i)</?({_BLOCKS})[^>]*>", "\n")
    text = decode(F.regexp_replace(text, r"<[^>]+>", ""))
    text = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(text, rf"\A{blank}|{blank}\z", "")


#: Names of the Korean encoding.
_KOREAN = r"(?i)charset\s*=\s*['\"]?(euc-kr|ks_c_5601-1987|cp949)"


def _korean(pages: Column) -> Column:
    """Pages whose bytes were read as Latin-1 though they are Korean; null where they can't be."""

    def repaired(page: str) -> str | None:
        try:
            return page.encode("latin-1", errors="ignore").decode("euc-kr")
        except UnicodeDecodeError:
            return None

    @F.pandas_udf(T.StringType())
    def repair(values: pd.Series) -> pd.Series:
        return values.map(repaired, na_action="ignore")

    return repair(pages)


def _decoded(text: Column) -> Column:
    """unescape, for which only texts with a reference leave the JVM."""
    return F.coalesce(unescape(F.when(F.contains(text, F.lit("&")), text)), text)


def html_summary(html: Column, selected: Column | None = None, body: Column | None = None, most: int = 4000) -> Column:
    """A page's summary: the selected text, else the first characters of its body's text, else those of the page.

    Of a page that names a Korean encoding, the bytes are decoded again and its tags stay;
    of any other page, and where the bytes can't be decoded or say nothing, tags are
    dropped.  Only Korean pages, and texts with character references, leave the JVM.
    """
    line = lambda c: F.regexp_replace(F.regexp_replace(c, rf"{_BLANK}", " "), r"^ | $", "")
    strip = lambda c: F.regexp_replace(c, rf"\A{_BLANK}|{_BLANK}\z", "")
    korean = F.nullif(F.substring(line(_korean(F.when(html.rlike(_KOREAN), html))), 1, most), F.lit(""))
    plain = F.substring(_decoded(line(F.regexp_replace(html, r"<[^>]+>", " "))), 1, most)
    given = [_decoded(F.nullif(strip(selected), F.lit("")))] if selected is not None else []
    given += [_decoded(F.nullif(F.substring(strip(body), 1, most), F.lit("")))] if body is not None else []
    return F.coalesce(*given, _decoded(korean), plain)


def markdown_title(text: Column, url: Column) -> Column:
    heading = F.nullif(F.trim(F.regexp_extract(text, r"(?m)^# (.+)$", 1)), F.lit(""))
    named = F.nullif(F.trim(F.regexp_extract(text, r"(?m)^Title: (.+)$", 1)), F.lit(""))
    return F.coalesce(heading, named, url)


def extracted(url: Column, extractors: dict[str, Column], strict: bool = False) -> Column:
    """What the first extractor with a result gives: struct (content, extractor, fallbacks, error).

    ``fallbacks`` lists each step to the next extractor as ``first>second``.  A null is no
    result, an empty text is one.  Where no extractor has one, ``error`` names them all;
    ``strict`` fails the query instead.
    """
    names = list(extractors)
    steps = [f"{a}>{b}" for a, b in zip(names, names[1:], strict=False)]
    used, gone = F.lit(None).cast("string"), F.array(*[F.lit(x) for x in steps]).cast("array<string>")
    for i in reversed(range(len(names))):
        held = extractors[names[i]].isNotNull()
        used = F.when(held, names[i]).otherwise(used)
        gone = F.when(held, F.array(*[F.lit(x) for x in steps[:i]]).cast("array<string>")).otherwise(gone)
    content = F.coalesce(*extractors.values()) if names else F.lit(None).cast("string")
    told = F.concat(F.lit("All extractors failed for "), F.coalesce(url, F.lit("")), F.lit(f". Tried: {names}"))
    error = F.when(content.isNull(), F.raise_error(told) if strict else told)
    return F.struct(content.alias("content"), used.alias("extractor"), gone.alias("fallbacks"), error.alias("error"))


def is_placeholder(href: Column) -> Column:
    return F.lower(F.trim(F.coalesce(href, F.lit("")))).isin(*PLACEHOLDERS)


_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def join_url(href: Column, base: Column) -> Column:
    """A reference resolved against an http(s) page's URL, as RFC 3986 and urljoin have it.

    Dot segments are taken out by a fold over the path's segments; of a relative path, empty
    segments between others go, too.  A reference with another scheme, or with a host, stays as it is.
    """
    raw = F.trim(F.coalesce(href, F.lit("")))
    part = lambda c, p: F.regexp_extract(c, p, 1)
    scheme, own = F.lower(part(base, _SCHEME)), F.lower(part(raw, _SCHEME))
    # of the page's own scheme without a host, what follows is a relative reference
    rest = F.when((own == scheme) & ~raw.rlike(_SCHEME + "//"), F.regexp_replace(raw, _SCHEME, "")).otherwise(raw)
    whole = raw.rlike(_SCHEME) & ((own != scheme) | raw.rlike(_SCHEME + "//"))
    root, base_path = part(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"), part(base, r"^[^?#]*?://[^/?#]*([^?#]*)")
    base_query = part(base, r"^[^?#]*(\?[^#]*)")
    path, query, fragment = part(rest, r"^([^?#]*)"), part(rest, r"^[^?#]*(\?[^#]*)"), part(rest, r"(#.*)$")
    query, fragment = F.when(query == "?", "").otherwise(query), F.when(fragment == "#", "").otherwise(fragment)
    before = F.split(base_path, "/")
    folder = F.when(F.element_at(before, -1) == "", before).otherwise(F.slice(before, 1, F.size(before) - 1))
    joined = F.when(path.startswith("/"), F.split(path, "/")).otherwise(F.concat(folder, F.split(path, "/")))
    last = F.size(joined) - 1
    segments = F.when(path.startswith("/"), joined).otherwise(F.filter(joined, lambda x, i: (x != "") | (i == 0) | (i == last)))
    stacked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda held, x: F.when(x == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).when(x == ".", held).otherwise(F.concat(held, F.array(x))),
    )
    ended = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(stacked, F.array(F.lit("")))).otherwise(stacked)
    text = F.array_join(ended, "/")
    text = F.when(text == "", "/").when(text.startswith("/"), text).otherwise(F.concat(F.lit("/"), text))
    found = F.concat(root, F.when(path == "", base_path).otherwise(text), F.when((path == "") & (query == ""), base_query).otherwise(query), fragment)
    return F.when(raw == "", base).when(whole, raw).when(rest.startswith("//"), F.concat(scheme, F.lit(":"), rest)).otherwise(found)


def resolve_link(href: Column, base: Column, templates: dict[str, str] | None = None) -> Column:
    """Absolute form of an href on a page: mail, phone and empty ones are null, scripts without a template too."""
    low = F.lower(F.trim(F.coalesce(href, F.lit(""))))
    dropped = is_placeholder(href) | low.startswith("mailto:") | low.startswith("tel:")
    script = F.nullif(script_link(F.trim(href), templates or {}), F.lit(""))
    return F.when(dropped, F.lit(None).cast("string")).when(low.startswith("javascript:"), script).otherwise(join_url(href, base))


def script_link(href: Column, templates: dict[str, str]) -> Column:
    """URL of ``javascript:fn('a','b')`` by the function's template; empty where there is none."""
    name = F.regexp_extract(href, r"(?i)^javascript:\s*([A-Za-z_$][\w$.]*)\s*\(", 1)
    args = F.transform(F.regexp_extract_all(href, F.lit(r"""['"]([^'"]*)['"]"""), F.lit(1)), lambda a: F.replace(F.url_encode(a), F.lit("+"), F.lit("%20")))
    out = F.lit("")
    for key, template in templates.items():
        url = F.lit(template)
        for mark in ("{id}", "{arg0}", "{0}"):
            url = F.replace(url, F.lit(mark), F.coalesce(F.get(args, F.lit(0)), F.lit("")))
        for i in range(1, 5):
            for mark in (f"{{arg{i}}}", f"{{{i}}}"):
                url = F.replace(url, F.lit(mark), F.coalesce(F.get(args, F.lit(i)), F.lit("")))
        out = F.when((name == key) & (F.size(args) > 0), url).otherwise(out)
    return out
