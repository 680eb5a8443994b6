"""Text functions on columns. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that carry no content in a question. Fixed values.
STOPWORDS = ("a", "about", "and", "are", "be", "each", "for", "how", "in", "is", "of", "or", "the", "to", "what", "when", "which", "will")
#: Token F1 from which two questions ask the same. Fixed value.
CONTENT_MATCH = 0.75


def strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def normalized(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def spaced(text: Column) -> Column:
    """Anything but ASCII letters and digits is one space; none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def content_tokens(text: Column) -> Column:
    return F.array_except(F.array_distinct(tokens(text)), strings(STOPWORDS))


def round4(value: Column) -> Column:
    """Four digits, halves to even."""
    return F.bround(value, 4)


def rate(part: Column, whole: Column) -> Column:
    """part / whole to four digits; 0 where there is nothing."""
    return F.coalesce(round4(F.try_divide(part.cast("double"), whole.cast("double"))), F.lit(0.0))


def f1_of(precision: Column, recall: Column) -> Column:
    return F.coalesce(round4(F.try_divide(2 * precision * recall, precision + recall)), F.lit(0.0))


def token_f1(expected: Column, predicted: Column) -> Column:
    """F1 of the content tokens: 1 if neither has any, 0 if one has none."""
    a, b = content_tokens(expected), content_tokens(predicted)
    shared, n, m = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    exact = 2 * (shared / m) * (shared / n) / (shared / m + shared / n)
    return F.when((n == 0) & (m == 0), 1.0).when(shared == 0, 0.0).otherwise(round4(exact))


def same_question(expected: Column, predicted: Column) -> Column:
    return token_f1(expected, predicted) >= CONTENT_MATCH


def contains_all(text: Column, terms: Column) -> Column:
    return F.forall(terms, lambda t: F.contains(F.lower(text), F.lower(t)))


def contains_any(text: Column, terms: Column) -> Column:
    """True without terms."""
    return (F.size(terms) == 0) | F.exists(terms, lambda t: F.contains(F.lower(text), F.lower(t)))


def contains_none(text: Column, terms: Column) -> Column:
    return ~F.exists(terms, lambda t: F.contains(F.lower(text), F.lower(t)))


def question_marks(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\\?"))


def one_question(text: Column) -> Column:
    """Exactly one question mark, at the end."""
    own = F.trim(text)
    return (question_marks(own) == 1) & own.endswith("?")


def numbered_items(text: Column) -> Column:
    """Lines that begin with a number and . or )."""
    return F.regexp_count(text, F.lit("(?m)^\\s*\\d+[.)]"))


def slot_relevance(question: Column, slot_id: Column, description: Column, static_question: Column) -> Column:
    """Whether a question has a word of at least four letters of its slot's name, description or standard question."""
    bare = lambda w: F.btrim(F.lower(w), F.lit("?.,"))
    names = F.filter(F.transform(F.split(F.concat_ws(" ", F.replace(slot_id, F.lit("_"), F.lit(" ")), description), "\\s+"), F.lower), lambda w: F.length(w) >= 4)
    static = F.filter(F.transform(F.split(static_question, "\\s+"), bare), lambda w: F.length(w) >= 4)
    return F.arrays_overlap(F.transform(F.split(F.trim(question), "\\s+"), bare), F.concat(names, static))


def answer_checks(answer: Column, must: Column, must_any: Column, must_not: Column, max_questions: Column, max_numbered: Column) -> Column:
    """A struct of checks; a limit that is null passes."""
    none = F.array().cast("array<string>")
    return F.struct(
        contains_all(answer, F.coalesce(must, none)).alias("contains_required_text"),
        contains_any(answer, F.coalesce(must_any, none)).alias("contains_any_text"),
        contains_none(answer, F.coalesce(must_not, none)).alias("avoids_forbidden_text"),
        F.coalesce(question_marks(answer) <= max_questions, F.lit(True)).alias("question_limit"),
        F.coalesce(numbered_items(answer) <= max_numbered, F.lit(True)).alias("numbered_item_limit"),
    )


def duration_text(periods: Column, unit: Column) -> Column:
    """'1 day', '6 months'; whole numbers without a fraction."""
    amount = F.when(periods == F.floor(periods), F.floor(periods).cast("string")).otherwise(periods.cast("string"))
    many = (periods != 1) & ~unit.endswith("s")
    return F.concat(amount, F.lit(" "), unit, F.when(many, "s").otherwise(""))


def rendered(kind: Column, text: Column, flag: Column, periods: Column, unit: Column, items: Column) -> Column:
    """A slot value as words: yes or no, a duration, a list joined by commas, or its text."""
    return F.when(kind == "boolean", F.when(flag, "yes").otherwise("no")).when(kind == "duration", duration_text(periods, unit)).when(kind == "list", F.array_join(items, ", ")).otherwise(text)


def short_answer(slot_id: Column, value: Column) -> Column:
    return F.when(slot_id == "intent", "yes").when((slot_id == "source_mode") & (value == "upload"), "uploaded").otherwise(value)


def filled(template: Column, value: Column) -> Column:
    """A template with {value} filled in."""
    return F.replace(template, F.lit("{value}"), value)


def padded(items: Column, filler: Column, n: int) -> Column:
    """The first n items, filled up with the filler."""
    return F.slice(F.concat(items, F.array_repeat(filler, n)), 1, n)


def safe_label(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9._-]", "-")


def redacted_error(kind: Column, status: Column, code: Column) -> Column:
    """Only the type, status and code of an error, never its message."""
    return F.concat_ws(" ", kind, F.concat(F.lit("status="), status.cast("string")), F.concat(F.lit("code="), code))


def stamped_name(label: Column, at: Column, suffix: str) -> Column:
    """A file name of a label and a time: label-20260131-235959.json."""
    return F.concat(safe_label(label), F.lit("-"), F.date_format(at, "yyyyMMdd-HHmmss"), F.lit(suffix))


def token_lengths(make: Callable[[], Callable[[str], Sequence]]) -> Callable[[Column], Column]:
    """A column function for the numbers of tokens by an injected tokenizer; make builds it once in each worker. Null has none."""
    made: list = []

    @F.pandas_udf(T.LongType())
    def lengths(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(make())
        return texts.map(lambda t: 0 if t is None else len(made[0](t)), na_action=None).astype("int64")

    return lengths


#: Distinct pieces whose numbers of tokens a worker remembers, and the characters of the longest that it does.
PIECES, LONGEST = 1 << 18, 64
#: Pieces that are looked at together.
TOGETHER = 1 << 14


def _cut(texts: pa.Array, pattern) -> Iterator[list[tuple[int, list[str]]]]:
    """Places of texts with their pieces, fewer than twice TOGETHER at once; those of a long text come in several lists."""
    held, n = [], 0
    for row, t in enumerate(texts):
        found = (m[0] for m in pattern.finditer(t.as_py() or ""))
        while own := list(islice(found, TOGETHER)):
            held.append((row, own))
            n += len(own)
            if n >= TOGETHER:
                yield held
                held, n = [], 0
    if held:
        yield held


def piece_lengths(make: Callable[[], Callable[[list[str]], list[int]]], pattern: str) -> Callable[[Column], Column]:
    """As token_lengths, for tokenizers whose tokens never span the matches of a pattern (their own first cut).

    make builds, once in each worker, a function from a list of pieces to their
    numbers of tokens. Each distinct piece is counted once: a text costs a lookup for
    each of its pieces. Besides a batch, a worker holds only the pieces remembered and
    some that are looked at together, however many the batch has.
    """
    made: list = []
    known: dict[str, int] = {}

    @F.arrow_udf(T.LongType())
    def lengths(texts: pa.Array) -> pa.Array:
        import regex

        if not made:
            made.extend((make(), regex.compile(pattern)))
        sizes = [0] * len(texts)
        for some in _cut(texts, made[1]):
            if len(known) > PIECES:
                known.clear()
            fresh = list({p for _, own in some for p in own if p not in known})
            known.update(zip(fresh, made[0](fresh) if fresh else [], strict=True))
            for row, own in some:
                sizes[row] += sum(map(known.__getitem__, own))
            for p in fresh:
                if len(p) > LONGEST:
                    del known[p]
        return pa.array(sizes, pa.int64())

    return lengths


def message_length(role: Column, tokens: Column, overhead: dict[str, int]) -> Column:
    """Tokens of a chat's message in a template that puts so many around one of each role."""
    around = F.create_map(*[F.lit(x) for pair in overhead.items() for x in pair])
    return tokens + F.coalesce(F.try_element_at(around, role), F.lit(0))
