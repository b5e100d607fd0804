"""Title tokens, keyword tests and query phrases as Column expressions."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that say nothing of a title's topic.
TITLE_STOPWORDS = (
    "the a an of and or for to in on at by with as is are was were this that 기자 오늘 내일 어제 이번 지난 다음 최근 현재 이후 이전"
).split()
#: Words that are no entities.
ENTITY_STOPWORDS = (
    "이 그 저 수 것 등 및 또 더 한 할 위 위한 통해 대한 관련 오늘 내일 어제 의 를 을 에 가 은 는 로 으로 와 과 도 만 부터 까지 에서 "
    "the a an is are was were in on at to for of and or"
).split()
#: What words are made of.
WORD = r"\p{L}\p{N}_"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def title_tokens(title: Column, compose: bool = True) -> Column:
    """Lower-case words of two characters or more, without stopwords.

    ``compose`` first applies NFKC to titles that are not plain ASCII, in an Arrow function
    (there is no built-in); turn it off for titles that are known to be in that form.
    """
    text = F.coalesce(title, F.lit(""))
    if compose:
        text = F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
    words = F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*TITLE_STOPWORDS))


def blank_tokens(text: Column) -> Column:
    """A text cut at blanks, as words are taken where there is no analyser for its language."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def plain_title(title: Column) -> Column:
    """Lower case, blanks collapsed, punctuation but hyphens dropped."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\s+", " "))
    text = F.regexp_replace(text, rf"[^{WORD}\s\-]", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: Letters that a search in any case takes for ASCII ones, though they don't become these in lower case.
ALIKE = {"\u017f": "s", "\u0130": "i", "\u0131": "i"}


def folded(text: Column) -> Column:
    """Lower case, with the letters that count as ASCII ones in any case."""
    alike = F.translate(text, "".join(ALIKE), "".join(ALIKE.values()))
    rare = functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in ALIKE])
    return F.lower(F.when(rare, alike).otherwise(text))


def holds_keyword(low: Column, fold: Column, keyword: str) -> Column:
    """Whether a text (in lower case, and folded) holds a keyword: ASCII ones as whole words, others anywhere."""
    own = keyword.lower()
    if not own.isascii():
        return F.contains(low, F.lit(own))
    inner = lambda c: c.isalnum() or c == "_"
    word = re.escape(own)
    # the keyword comes first: what stands before it is looked at only where it stands
    before = f"(?<![{WORD}]{word})" if inner(own[0]) else f"(?<=[{WORD}]{word})"
    after = f"(?![{WORD}])" if inner(own[-1]) else f"(?=[{WORD}])"
    return F.contains(fold, F.lit(own)) & fold.rlike(f"{word}{before}{after}")


def query_days(text: Column) -> Column:
    """Days that the earliest time phrase of a search names, else null."""
    return _earliest(text)[0]


_TIMES = ((r"(?:최근|지난)\s*(\d+)\s*일", 1), (r"(?:최근|지난)\s*(\d+)\s*주", 7), (r"(?:최근|지난)\s*(\d+)\s*개월", 30)) + tuple(
    (rf"(?i)\blast\s+(\d+)\s*{unit}s?\b", days) for unit, days in (("day", 1), ("week", 7), ("month", 30))
)
_LIMITS = ((rf"(\d+)\s*개(?![{WORD}])", 1), (r"(?i)\btop\s+(\d+)\b", 1))


def _earliest(text: Column, phrases=_TIMES) -> tuple[Column, Column]:
    """Value of the phrase that stands first, and the text without it."""
    found = F.array(
        *[
            F.when(
                text.rlike(p),
                F.struct(
                    F.length(F.element_at(F.split(text, p, 2), 1)).alias("at"),
                    (F.regexp_extract(text, p, 1).cast("int") * times).alias("value"),
                    F.trim(F.regexp_replace(F.concat_ws(" ", F.split(text, p, 2)), r"\s+", " ")).alias("rest"),
                ),
            )
            for p, times in phrases
        ]
    )
    first = F.get(F.array_sort(F.filter(found, lambda x: x.isNotNull())), F.lit(0))
    return first["value"], F.coalesce(first["rest"], text)


def parse_query(raw: Column) -> Column:
    """Struct (search_text, days, limit) of a search in words such as ``last 2 weeks top 10 security``."""
    days, rest = _earliest(F.trim(raw))
    limit, words = _earliest(rest, _LIMITS)
    return F.struct(F.trim(F.regexp_replace(words, r"\s+", " ")).alias("search_text"), days.alias("days"), limit.alias("limit"))
