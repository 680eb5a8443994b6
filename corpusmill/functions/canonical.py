"""JSON in one spelling, JSON out of a model's answers, and durations.

Plain JSON is spelled in the JVM, by a Variant; pandas UDFs take what a Variant
would change (fractions, long numbers) or can't read. Numbers are spelled as
Python does: 1 and 1.0 stay apart, 1.10 and 1.1 don't. Durations are JVM only.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import strings

#: Words for units of time and what they mean. Fixed values.
UNITS = {
    "second": "second",
    "seconds": "second",
    "secondly": "second",
    "minute": "minute",
    "minutes": "minute",
    "minutely": "minute",
    "hour": "hour",
    "hours": "hour",
    "hourly": "hour",
    "day": "day",
    "days": "day",
    "daily": "day",
    "week": "week",
    "weeks": "week",
    "weekly": "week",
    "month": "month",
    "months": "month",
    "monthly": "month",
    "quarter": "quarter",
    "quarters": "quarter",
    "quarterly": "quarter",
    "year": "year",
    "years": "year",
    "yearly": "year",
}
UNIT_MAP = "map(" + ", ".join(f"'{a}', '{b}'" for a, b in UNITS.items()) + ")"
#: Words before a duration. Fixed values.
FRAMES = ("for", "over")
AHEAD = ("next", "following")
ONCE = ("a", "an", "one")
#: Fields that mark the object a model was asked for. Fixed values.
ASKED = ("intent", "question")

#: What a Variant would spell otherwise: fractions, exponents, long numbers, minus zero.
_DELICATE = r"[0-9][.eE]|[0-9]{16}|-0"


def _sorted_json(value: Column) -> Column:
    """JSON with sorted keys and no spaces, or null if the JVM can't say it as Python would."""
    return F.when(~value.rlike(_DELICATE) & ~F.contains(value, F.lit("\\")), F.to_json(F.try_parse_json(value)))


def _spaced_json(value: Column) -> Column:
    """As _sorted_json, with a space after colons and commas; null for arrays, and for strings with either at an end."""

    def own(compact: Column) -> Column:
        plain = ~F.contains(compact, F.lit("[")) & ~compact.rlike(r'[:,{]":|,"[:,}]')
        return F.when(plain, F.replace(F.replace(compact, F.lit('":'), F.lit('": ')), F.lit(',"'), F.lit(', "')))

    return let(_sorted_json(value), own)


def _dumped(value: object, compact: bool = False) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":") if compact else None)


def _loaded(text: str) -> tuple[object, bool]:
    """A text's JSON, and whether it is any."""
    try:
        return json.loads(text), True
    except (ValueError, RecursionError):
        return None, False


def _loose(text: str | None) -> str | None:
    if text is None:
        return None
    value, ok = _loaded(text)
    return _dumped(value if ok else text)


def _strict(text: str | None) -> str | None:
    value, ok = _loaded(text) if text is not None else (None, False)
    return _dumped(value, True) if ok else None


_loose_udf = F.pandas_udf(lambda v: v.map(_loose, na_action="ignore"), T.StringType())
_strict_udf = F.pandas_udf(lambda v: v.map(_strict, na_action="ignore"), T.StringType())


def _either(value: Column | str, fast, slow) -> Column:
    """The JVM's answer, or where it has none the UDF's."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(fast(value), slow(F.when(fast(value).isNull(), value)))


def canonical_value(value: Column | str) -> Column:
    """Values as JSON with sorted keys; text that is JSON counts as what it says, other text as itself. Null is JSON null."""
    return F.coalesce(_either(value, _spaced_json, _loose_udf), F.lit("null"))


def compact_value(value: Column | str) -> Column:
    """JSON text with sorted keys and no spaces; null for null and for what isn't JSON."""
    return _either(value, _sorted_json, _strict_udf)


#: The next sign of JSON: punctuation, a string and its closing quote if it has one, or a number or word.
_SIGN = re.compile(r'\s*(?:(?P<mark>[{}\[\],:])|"(?P<string>(?:[^"\\]|\\.)*)(?P<quote>"|\\?\Z)|(?P<plain>[-+.\w]+))', re.S)


class _Open:
    """A container being read, and what may come next in it."""

    def __init__(self, start: int, mark: str) -> None:
        self.start, self.held, self.key, self.wants = start, {} if mark == "{" else [], None, "first"

    def take(self, value: object) -> None:
        if isinstance(self.held, dict):
            self.held[self.key] = value
        else:
            self.held.append(value)
        self.wants = "comma"


def objects(text: str) -> list[dict]:
    """All JSON objects in a text, by their places, in one pass.

    A stack holds the containers that are open. What the text's end leaves open is
    closed as it stands; a sign that can't follow drops what is open, but not the
    objects within that were whole.
    """
    stack: list[_Open] = []
    found: list[tuple[int, dict]] = []

    def close() -> None:
        done = stack.pop()
        if isinstance(done.held, dict):
            found.append((done.start, done.held))
        if stack:
            stack[-1].take(done.held)

    at = text.find("{")
    while 0 <= at < len(text):
        sign = _SIGN.match(text, at)
        if not sign:
            if not text[at:].strip():
                break
            stack.clear()
            at = text.find("{", at + 1)
            continue
        top, mark, place = stack[-1] if stack else None, sign["mark"], sign.end() - 1
        named = top is not None and isinstance(top.held, dict) and top.wants in ("first", "key")
        valued = top is not None and (top.wants == "value" or (isinstance(top.held, list) and top.wants in ("first", "next")))
        at = sign.end()
        if mark == "{" and (top is None or valued) or mark == "[" and valued:
            stack.append(_Open(place, mark))
        elif top is not None and mark in ("}", "]") and (mark == "}") == isinstance(top.held, dict) and top.wants in ("first", "comma"):
            close()
        elif top is not None and mark == "," and top.wants == "comma":
            top.wants = "key" if isinstance(top.held, dict) else "next"
        elif top is not None and mark == ":" and top.wants == "colon":
            top.wants = "value"
        elif sign["string"] is not None and (named or valued):
            value, ok = _loaded(f'"{_sealed(sign["string"])}"')
            if not ok:
                stack.clear()
            elif valued:
                top.take(value)
            elif sign["quote"] == '"':  # a name that is cut short is lost
                top.key, top.wants = value, "colon"
        elif sign["plain"] is not None and valued and (known := _loaded(sign["plain"]))[1]:
            top.take(known[0])
        elif sign["plain"] is not None and valued and at == len(text):
            break  # a word that is cut short
        else:
            stack.clear()
            if mark == "{":
                stack.append(_Open(place, mark))
        if not stack:
            at = text.find("{", at)
    while stack:
        close()
    return [held for _, held in sorted(found, key=lambda f: f[0])]


def _sealed(string: str) -> str:
    """The inside of a string, without control characters and an escape that the end cuts."""
    string = re.sub(r"(?:^|(?<=[^\\]))((?:\\\\)*)\\(?:u[0-9a-fA-F]{0,3})?$", r"\1", string)
    return re.sub(r"[\x00-\x1f]", lambda c: f"\\u{ord(c[0]):04x}", string)


def salvage(text: str | None) -> str | None:
    """The JSON object in a model's answer: bare, fenced, cut short, or amid prose; null if there is none, or it is too deep to spell.

    Of several objects the first that has a field asked for, else the first.
    """
    if text is None:
        return None
    own = text.strip()
    if own.startswith("```") and own.endswith("```") and len(own) >= 6:
        own = own[3:-3].strip()
        own = own[4:].strip() if own[:4].lower() == "json" else own
    value, ok = _loaded(own)
    if not ok or not isinstance(value, dict):
        some = objects(own)
        value = next((v for v in some if any(f in v for f in ASKED)), some[0] if some else None)
    try:
        return None if value is None else _dumped(value)
    except RecursionError:  # some thousand objects in one another
        return None


_salvage_udf = F.pandas_udf(lambda v: v.map(salvage, na_action="ignore"), T.StringType())


def salvaged(answer: Column) -> Column:
    """JSON objects of model answers, as text with sorted keys."""

    def fast(text: Column) -> Column:
        own = F.regexp_replace(F.regexp_replace(text, r"(?i)^\s*(?:```(?:json)?\s*(?=\{.*\}\s*```\s*$))?", ""), r"(?<=\})\s*(?:```)?\s*$", "")
        return let(let(own, _spaced_json), lambda found: F.when(F.startswith(found, F.lit("{")), found))

    return _either(answer, fast, _salvage_udf)


def let(value: Column, then) -> Column:
    """then(value), where the value is worked out once however often it's used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _phrase(text: Column, whole: bool) -> Column:
    """{periods, unit} of a phrase like 'for the next 6 months'; null if it isn't one, or more with whole."""
    after = lambda words, n: F.slice(words, n + 1, F.greatest(F.lit(1), F.size(words)))
    word = lambda words, n: F.coalesce(F.get(words, F.lit(n)), F.lit(""))
    units = F.expr(UNIT_MAP)

    def unframed(words: Column) -> Column:
        return F.when(word(words, 0).isin(*FRAMES), after(words, 1)).otherwise(words)

    def ahead(words: Column) -> Column:
        return F.when((word(words, 0) == "the") & word(words, 1).isin(*AHEAD), after(words, 2)).when(word(words, 0).isin(*AHEAD), after(words, 1)).otherwise(words)

    def counted(words: Column) -> Column:
        counts = word(words, 0).rlike(r"^\d") | (word(words, 0).isin(*ONCE) & (F.size(words) > 1))
        return F.struct(F.coalesce(word(words, 0).try_cast("double"), F.lit(1.0)).alias("periods"), F.when(counts, after(words, 1)).otherwise(words).alias("rest"))

    def said(count: Column) -> Column:
        unit = F.try_element_at(units, word(count["rest"], 0))
        fits = F.size(count["rest"]) == 1 if whole else F.lit(True)
        return F.when(fits & unit.isNotNull(), F.struct(count["periods"].alias("periods"), unit.alias("unit")))

    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+|\d+(?:\.\d+)?"), F.lit(0))
    found = let(words, lambda w: let(unframed(w), lambda u: let(ahead(u), lambda v: let(counted(v), said))))
    return F.when(text.rlike(r"^[\sA-Za-z0-9.]*$"), found) if whole else found


def durations(raw: Column | str, evidence: Column | str, message: Column | str) -> Column:
    """{periods, unit} of a value, JSON or words, with its evidence and message; fields are null if none says a unit.

    A value that is an object says it by its fields. Else the first phrase of
    evidence and message gives the unit, and a value of digits the number; else the
    value, the evidence or the message is a phrase as a whole.
    """
    raw, evidence, message = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (raw, evidence, message))
    own = F.trim(raw)
    fields = F.when(own.rlike(r"(?s)^\{.*\}$"), F.try_parse_json(own))
    named = F.lower(F.coalesce(F.try_variant_get(fields, "$.unit", "string"), F.lit("month")))
    units = F.expr(UNIT_MAP)
    told = F.when(fields.isNotNull(), F.struct(F.coalesce(F.try_variant_get(fields, "$.periods", "double"), F.lit(1.0)).alias("periods"), F.coalesce(F.try_element_at(units, named), named).alias("unit")))
    near = _phrase(F.concat_ws(" ", evidence, message), False)
    number = F.when(raw.rlike(r"^\d+$"), raw.try_cast("double"))
    counted = F.when(near.isNotNull(), F.struct(F.coalesce(number, near["periods"]).alias("periods"), near["unit"].alias("unit")))
    none = F.struct(F.lit(None).cast("double").alias("periods"), F.lit(None).cast("string").alias("unit"))
    return F.coalesce(told, counted, *[_phrase(F.trim(x), True) for x in (raw, evidence, message)], none)
