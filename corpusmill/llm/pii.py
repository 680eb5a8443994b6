"""PII surrogates: keyed, type-consistent replacements with collision checks.

Entities are found by form, given names by a lexicon, surnames after given names
or titles and then anywhere in the same text. Each distinct value (its letters and
digits, without case) gets one surrogate, the same everywhere in the corpus, so
coreference stays: a keyed permutation of the values of its shape, in which each
character stays in its class (digit, vowel or consonant of its script), so values
of one shape keep distinct surrogates. Given names change places with others of
their gender and script in a keyed order, and the gendered endings of Slavic
surnames stay. Surrogates that meet one of another shape, or a value of the
corpus, are permuted by another key, and get longer where that doesn't help.

A surrogate is written in each occurrence's own format: separators, case and
length are kept. DataFrame operations only; texts without entities aren't joined.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import written

#: Given names by gender (u: of both) and script; each list is permuted within itself. Fixed values, ours.
GIVEN = {
    "given_f_latin": ("Alice", "Amélie", "Anna", "Barbara", "Beatriz", "Carla", "Carmen", "Claire", "Deborah", "Elena", "Elizabeth", "Emily", "Emma", "Hannah", "Inès", "Isabel", "Jennifer", "Jessica", "Julia", "Karen", "Laura", "Linda", "Lucía", "Margaret", "Maria", "María", "Marta", "Mary", "Nancy", "Olivia", "Patricia", "Paula", "Rachel", "Sarah", "Sofia", "Sophie", "Susan", "Ursula"),
    "given_m_latin": ("Andreas", "Anthony", "Antonio", "Brian", "Carlos", "Charles", "Christopher", "Daniel", "David", "Diego", "Edward", "George", "Hans", "Henri", "James", "Jean", "Johannes", "John", "Jonas", "Joseph", "José", "Juan", "Jürgen", "Kevin", "Klaus", "Louis", "Lukas", "Matthew", "Michael", "Miguel", "Pablo", "Paul", "Peter", "Pierre", "Richard", "Robert", "Stefan", "Steven", "Thomas", "William"),
    "given_u_latin": ("Alex", "Andrea", "Camille", "Chris", "Dominique", "Kim", "Robin", "Sam", "Sascha", "Taylor"),
    "given_f_cyrillic": ("Анастасия", "Анна", "Екатерина", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"),
    "given_m_cyrillic": ("Алексей", "Андрей", "Владимир", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Сергей", "Юрий"),
    "given_f_greek": ("Άννα", "Ελένη", "Κατερίνα", "Μαρία", "Σοφία"),
    "given_m_greek": ("Αλέξανδρος", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος"),
}
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Señor", "Señora", "Sr", "Sra", "Господин", "Госпожа", "Доктор", "Κύριος", "Κυρία")
#: Endings of Slavic surnames that tell a gender.
ENDINGS = "(ова|ева|ёва|ина|ская|ов|ев|ёв|ин|ский)$"

_SPAN = lambda first, last: "".join(map(chr, range(ord(first), ord(last) + 1)))
#: Classes of characters that surrogates keep: a test, and the characters that change places. What the test takes and the
#: characters lack (letters with accents, rare ones) goes to one of them.
CLASSES = (
    ("[0-9]", "0123456789"),
    ("[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüœ]", "aeiou"),
    (r"\p{IsLatin}", "bcdfghjklmnpqrstvwxz"),
    ("[аеёиоуыэюя]", "аеиоуыэюя"),
    (r"\p{IsCyrillic}", "бвгджзйклмнпрстфхцчшщ"),
    ("[αεηιουωάέήίόύώ]", "αεηιουω"),
    (r"\p{IsGreek}", "βγδζθκλμνξπρστφχψ"),
    (r"\p{IsHebrew}", _SPAN("א", "ת")),
    (r"\p{IsArabic}", _SPAN("ب", "غ") + _SPAN("ف", "ي")),
    (r"\p{IsArmenian}", _SPAN("ա", "ֆ")),
    (r"\p{IsGeorgian}", _SPAN("ა", "ჰ")),
    (r"\p{IsDevanagari}", _SPAN("क", "ह")),
    (r"\p{IsThai}", _SPAN("ก", "ฮ")),
    (r"\p{IsHiragana}", _SPAN("か", "ん")),
    (r"\p{IsKatakana}", _SPAN("カ", "ン")),
    (r"\p{IsHangul}", _SPAN("가", "깋")),
    (r"\p{IsHan}", _SPAN("一", "俿")),
    (r"\p{N}", "0123456789"),
    (r"\p{L}", "bcdfghjklmnpqrstvwxz"),
)
HEXADECIMAL = "abcdef"


def _by_initial(words: tuple[str, ...] | list[str], any_case: bool) -> str:
    """A pattern for words: their first letter as it is, and with any_case the rest in any case."""
    groups = defaultdict(list)
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        groups[w[0]].append(re.escape(w[1:]))
    start = "(?iu:" if any_case else "(?:"
    return "(?:" + "|".join(f"{c}{start}{'|'.join(rest)})" for c, rest in sorted(groups.items())) + ")"


_ALL = [n for names in GIVEN.values() for n in names]
_NAMES, _TITLES = _by_initial(_ALL, True), _by_initial(TITLES, False)
_INITIALS, _TITLE_INITIALS = ("".join(sorted({n[0] for n in x})) for x in (_ALL, TITLES))
#: No letter or digit before, or after.
_B, _E = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Forms of entities, the first that fits. A surname is the capitalised word after a given name or a title.
#: Each begins with a cheap test of one character, which most places in a text fail. Only classes of single
#: characters repeat without a bound, so that no text is too long for the matcher.
FORMS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?=[A-Za-z0-9-]+\.[A-Za-z0-9-])[A-Za-z0-9.-]*[A-Za-z0-9-]"),
    ("secret", rf"(?=[0-9A-Fa-f]){_B}(?:[0-9a-f]{{32,64}}|[0-9A-F]{{32,64}}|AKIA[0-9A-Z]{{16}}){_E}"),
    ("iban", rf"(?=[A-Z][A-Z]\d){_B}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_E}"),
    ("card", rf"(?=\d){_B}\d{{4}}(?: \d{{4}} \d{{4}} \d{{4}}|-\d{{4}}-\d{{4}}-\d{{4}}|\d{{12}}){_E}"),
    ("ssn", r"(?=\d)(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"),
    ("ip", r"(?=\d)(?<![\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{N}]|\.\d)"),
    ("phone", rf"(?=[+(\d]){_B}(?:(?:\+\d{{1,3}}[ .-]?)?\(?\d{{2,4}}\)?[ .-]\d{{3,4}}[ .-]\d{{3,4}}|\+\d{{8,15}}|(?:\+\d{{2,3}} ?|0)\d(?:[ .-]\d\d){{4}}){_E}"),
    ("given", rf"(?=[{_INITIALS}]){_B}{_NAMES}{_E}"),
    ("surname", rf"(?=\p{{Lu}})(?<= ){_B}(?:(?<={_B}{_NAMES} )|(?<={_B}{_TITLES}\.? ))\p{{Lu}}[\p{{L}}'’-]{{0,40}}\p{{L}}{_E}"),
)
ENTITY = "|".join(f"(?:{p})" for _, p in FORMS)
#: A text without any of these has no entity; most texts are done with that.
HINT = rf"[@0-9]|(?=[{_INITIALS}{_TITLE_INITIALS}]){_B}(?:{_NAMES}|{_TITLES}){_E}"
#: Stands for an entity in a text while it's cut; a text that has it is cut by the forms themselves.
MARK = "\u0001"
#: Attempts after which a surrogate is a character longer.
PATIENCE = 4


def kind_of(value: Column) -> Column:
    """The type of an entity, by the first form that fits all of it; given names by gender and script."""
    whole = dict(FORMS)
    out = F.lit("surname")
    for name, names in reversed(GIVEN.items()):
        out = F.when(F.lower(value).isin(*[n.lower() for n in names]), F.lit(name)).otherwise(out)
    for name in ("phone", "ip", "ssn", "card", "iban", "secret", "email"):
        out = F.when(value.rlike(f"^(?:{whole[name]})$"), F.lit(name)).otherwise(out)
    return out


def norm_of(kind: Column, value: Column) -> Column:
    """What occurrences of one entity share: letters and digits without case, of addresses all characters."""
    return F.when(kind.isin("email", "ip"), F.lower(value)).otherwise(F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}]", "")))


def _draw(draws: Column, i: Column) -> Column:
    """The i-th number below 65536 of 128 hexadecimal digits."""
    return F.conv(F.substr(draws, F.pmod(i * 3, F.lit(124)).cast("int") + 1, F.lit(4)), 16, 10).cast("int")


def _place(c: Column, hexadecimal: Column) -> Column:
    """A character with those of its class, and its place among them; other characters have none."""
    chars = F.lit("")
    for test, members in reversed(CLASSES):
        chars = F.when(c.rlike(f"^{test}$"), F.lit(members)).otherwise(chars)
    chars = F.when(hexadecimal & c.rlike("^[a-f]$"), F.lit(HEXADECIMAL)).otherwise(chars)
    at = F.call_function("instr", chars, c)
    place = F.when(chars == "", 0).when(at > 0, at - 1).otherwise(F.pmod(F.ascii(c), F.greatest(F.lit(1), F.length(chars))))
    return F.struct(c.alias("c"), chars.alias("chars"), place.cast("int").alias("p"), F.greatest(F.lit(1), F.length(chars)).cast("int").alias("n"))


def _written(x: Column) -> Column:
    return F.when(x["n"] == 1, x["c"]).when(x["chars"] == "", (x["p"] + 1).cast("string")).otherwise(F.substr(x["chars"], x["p"] + 1, F.lit(1)))


def moved(now: DataFrame, side: str, other: str, round_: int) -> DataFrame:
    """The places of one half, moved by what the other holds: three such rounds are a permutation for each tweak."""
    held = F.array_join(F.transform(other, lambda y: y["p"].cast("string")), ",")
    draws = F.sha2(F.concat_ws("|", "tweak", F.lit(str(round_)), held), 512)
    # repeated beside the places, else the optimizer puts the hash into the lambda, once for each
    paired = F.zip_with(side, F.array_repeat(draws, F.size(side)), lambda x, d: F.struct(x.alias("x"), d.alias("d")))
    return now.withColumn(side, F.transform(paired, lambda y, i: y["x"].withField("p", F.pmod(y["x"]["p"] + _draw(y["d"], i), y["x"]["n"]))))


def _swapped(key: str, value: Column) -> Column:
    """The next name of the same list in the keyed order: distinct names get distinct ones, none its own."""
    out = value
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}|given|{n}".encode()).hexdigest())
        lower = dict(zip((n.lower() for n in order), (n.lower() for n in order[1:] + order[:1]), strict=True))
        table = F.create_map(*[F.lit(x) for pair in lower.items() for x in pair])
        out = F.when(value.isin(*lower), F.element_at(table, value)).otherwise(out)
    return out


def _luhn(digits: Column) -> Column:
    """The Luhn sum of an array of digit strings, from its last."""
    doubled = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def _mod97(chars: Column) -> Column:
    """An array of digits and lower-case letters (a is 10) read as a number, modulo 97."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), F.pmod(a * 10 + F.coalesce(c.try_cast("int"), F.lit(0)), 97)).otherwise(F.pmod(a * 100 + F.ascii(c) - 87, 97))
    return F.aggregate(chars, F.lit(0), step)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def surrogates(values: DataFrame, key: str) -> DataFrame:
    """values (kind, norm, attempt) -> with new: each attempt is another permutation, and each PATIENCE of them add a character.

    Column by column, as each is used several times.
    """
    kind, norm, own, head, tail = (F.col(c) for c in ("kind", "norm", "own", "head", "tail"))
    aws = (kind == "secret") & norm.startswith("akia")
    ending = F.when(kind == "surname", F.regexp_extract("norm", ENDINGS, 1)).otherwise("")
    octet = lambda x: F.struct(F.lit("").alias("c"), F.lit("").alias("chars"), F.pmod(x.cast("int") - 1, F.lit(223)).alias("p"), F.lit(223).alias("n"))
    # head and tail, which stay before and after what is permuted; check digits are made anew
    parts = values.select(
        *["kind", "norm", "attempt"],
        F.substring_index(norm, "@", -1).alias("domain"),
        F.when(kind == "email", F.substring_index(norm, "@", 1)).otherwise(norm).alias("own"),
        F.when(kind == "card", 1).when((kind == "iban") | aws, 4).otherwise(0).alias("head"),
        F.when(kind == "card", 1).when(F.length(norm) > F.length(ending) + 2, F.length(ending)).otherwise(0).alias("tail"),
    )
    body = F.substr(own, head + 1, F.length(own) - head - tail)
    places = F.when(kind == "ip", F.transform(F.split(own, r"\."), octet)).otherwise(F.transform(_chars(body), lambda c: _place(c, (kind == "secret") & ~aws)))
    tweak = F.concat_ws("|", F.lit(key), kind, F.col("attempt").cast("string"), F.when(kind == "email", F.col("domain")).otherwise(F.concat(F.substr(own, F.lit(1), head), F.right(own, tail))))
    half = F.floor(F.size("places") / 2).cast("int")
    now = parts.withColumns({"places": places, "tweak": tweak, "more": F.floor(F.col("attempt") / PATIENCE).cast("int")})
    now = now.withColumns({"left": F.slice("places", F.lit(1), half), "right": F.slice("places", half + 1, F.size("places") - half)})
    now = moved(moved(moved(now, "right", "left", 0), "left", "right", 1), "right", "left", 2)
    last = F.element_at(F.concat(F.array(F.lit("0123456789")), F.transform(F.filter("places", lambda x: x["chars"] != ""), lambda x: x["chars"])), -1)
    now = now.withColumns({"made": F.transform(F.concat("left", "right"), _written), "last": last, "draws": F.sha2(F.concat_ws("|", F.lit(key), F.lit("more"), kind, norm, F.col("attempt").cast("string")), 512)})
    longer = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), "more")), lambda i: F.substr("last", F.pmod(_draw(F.col("draws"), i), F.length("last")) + 1, F.lit(1))), "")
    # the last label of a domain is kept, and the one before it is a reserved one
    of_domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.col("domain")), 512)
    now = now.withColumns({"extra": F.when(F.col("more") > 0, longer).otherwise(""), "joined": F.array_join("made", ""), "of_domain": of_domain})
    now = now.withColumn("front", F.concat(F.substr(own, F.lit(1), head), "joined", "extra"))
    label = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.substr(F.lit(_SPAN("a", "z")), _draw(F.col("of_domain"), i) % 26 + 1, F.lit(1))), "")
    email = F.concat("joined", "extra", F.lit("@"), label, F.lit(".example."), F.element_at(F.split("domain", r"\."), -1))
    address = F.concat(F.array_join("made", "."), F.when(F.col("more") > 0, F.concat(F.lit("."), "extra")).otherwise(""))
    country = F.substr(own, F.lit(1), F.lit(2))
    sums = {"check": (10 - _luhn(F.concat(_chars(F.col("front")), F.array(F.lit("0")))) % 10) % 10, "valid": _luhn(_chars(norm)) % 10 == 0}
    now = now.withColumns({c: F.when(kind == "card", x) for c, x in sums.items()} | {"rest": F.when(kind == "iban", 98 - _mod97(_chars(F.concat("joined", "extra", country, F.lit("00")))))})
    wrong = (F.col("check") + 1 + F.pmod(F.right(own, F.lit(1)).try_cast("int"), F.lit(9))) % 10
    card = F.concat("front", F.when(F.col("valid"), F.col("check")).otherwise(wrong).cast("string"))
    iban = F.concat(country, F.lpad(F.col("rest").cast("string"), 2, "0"), "joined", "extra")
    plain = F.concat("front", F.right(own, tail))
    new = F.when(kind == "email", email).when(kind == "ip", address).when(kind == "card", card).when(kind == "iban", iban).when(kind.startswith("given"), _swapped(key, norm)).otherwise(plain)
    return now.select("kind", "norm", "attempt", new.alias("new"))


def rendered(kind: Column, value: Column, new: Column) -> Column:
    """A surrogate in the format of an occurrence: its separators, and capitals where it has them; what is longer follows."""
    own = F.split(new, "")

    def step(a: Column, c: Column) -> Column:
        solid = c.rlike(r"[\p{L}\p{N}]")
        mine = F.coalesce(F.try_element_at(own, a["k"] + 1), F.lit(""))
        cased = F.when(c.rlike(r"\p{Lu}"), F.upper(mine)).otherwise(mine)
        return F.struct(F.concat(a["out"], F.when(solid, cased).otherwise(c)).alias("out"), (a["k"] + solid.cast("int")).alias("k"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    letter_wise = F.aggregate(F.split(value, ""), start, step, lambda a: F.concat(a["out"], F.substr(new, a["k"] + 1, F.greatest(F.lit(0), F.length(new) - a["k"]))))
    initial = F.when(value.rlike(r"^\p{Lu}+$") & (F.length(value) > 1), F.upper(new)).otherwise(F.initcap(new))
    return F.when(kind.isin("email", "ip"), new).when(kind.startswith("given"), initial).otherwise(letter_wise)


def hinted(text: Column) -> Column:
    return F.coalesce(text.rlike(HINT), F.lit(False))


def occurrences(docs: DataFrame) -> DataFrame:
    """docs (text) -> (h, h2, values, more): the entities of each distinct text that has any, in order, and the pattern of its surnames.

    A text is named by a 128-bit hash. Surnames that stand after a name or a title
    are entities wherever they stand in the text.
    """
    found = docs.where(hinted(F.col("text"))).select(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2"), "text", F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)).alias("values"))
    names = [n.lower() for n in _ALL]
    surname = lambda v: v.rlike(r"^\p{Lu}[\p{L}'’-]{0,40}\p{L}$") & ~F.lower(v).isin(*names) & ~v.rlike("^(?:[A-F]{32,64}|AKIA[A-Z]{16})$")
    surnames = F.array_distinct(F.filter("values", surname))
    pattern = F.concat(F.lit(rf"|(?:(?=\p{{Lu}}){_B}(?iu:"), F.array_join(F.transform(surnames, lambda s: F.concat(F.lit(r"\Q"), s, F.lit(r"\E"))), "|"), F.lit(rf"){_E})"))
    some = found.where(F.size("values") > 0).withColumn("more", F.when(F.size(surnames) > 0, pattern))
    every = F.when(F.col("more").isNull(), F.col("values")).otherwise(F.regexp_extract_all("text", F.concat(F.lit(ENTITY), F.col("more")), F.lit(0)))
    return some.select("h", "h2", every.alias("values"), "more").dropDuplicates(["h", "h2"])


def assigned(values: DataFrame, key: str) -> DataFrame:
    """values (kind, norm), distinct -> with attempt, new: surrogates all distinct within a kind, none a value of it.

    Each round gives those that collide another attempt; as these get longer, a
    kind's values can't fill the surrogates, and the rounds end.
    """
    now = written(surrogates(values.withColumn("attempt", F.lit(0)), key), "surrogates")
    while True:
        open_ = now.where(~F.col("kind").startswith("given"))  # names are permuted: distinct by construction
        taken = open_.groupBy("kind", "new").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "norm")).alias("first")).where("n > 1")
        twice = open_.join(taken, ["kind", "new"]).where(F.col("norm") != F.col("first.norm")).select("kind", "norm")
        real = open_.join(values.select(F.col("kind").alias("k2"), F.col("norm").alias("n2")), (F.col("kind") == F.col("k2")) & (F.col("new") == F.col("n2"))).select("kind", "norm")
        again = written(twice.unionByName(real).distinct(), "collisions")
        if not again.limit(1).count():
            return now
        tried = surrogates(now.join(again, ["kind", "norm"], "left_semi").select("kind", "norm", (F.col("attempt") + 1).alias("attempt")), key)
        now = written(now.join(again, ["kind", "norm"], "left_anti").unionByName(tried), "surrogates")


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (id, text, kinds): the text with surrogates, and the type of each entity in order.

    Equal values get equal surrogates in all texts, also of repeated rows and ids;
    a null id is as good as any. Of two forms that fit at a place the first counts,
    and of two values whose surrogates tie the lesser keeps it. A null text stays
    null, an empty one empty, both without entities; texts without entities stay as
    they are. A text of any length is one row. An empty table gives an empty result;
    other columns aren't read, whatever their names. key must be kept secret and the
    same over runs for the same surrogates.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = written(occurrences(source), "occurrences")
    raw = found.select(F.explode("values").alias("value")).distinct().withColumn("kind", kind_of(F.col("value")))
    named = written(raw.withColumn("norm", norm_of(F.col("kind"), F.col("value"))), "values")
    given = assigned(named.select("kind", "norm").distinct(), key).select("kind", "norm", "new")
    # written, so that the join shuffles both sides and the rows of a frequent value can be split
    each = written(named.join(given, ["kind", "norm"]).select(F.col("value").alias("of"), "kind", rendered(F.col("kind"), F.col("value"), F.col("new")).alias("new")), "rendered")
    placed = found.select("h", "h2", "more", F.posexplode("values").alias("at", "value")).join(each, F.col("value") == F.col("of"))
    lists = placed.groupBy("h", "h2", "more").agg(F.sort_array(F.collect_list(F.struct("at", "new", "kind"))).alias("m"))
    lists = written(lists.select("h", "h2", "more", F.col("m.new").alias("news"), F.col("m.kind").alias("kinds")), "replacements")
    keyed = source.where(hinted(F.col("text"))).withColumns({"th": F.xxhash64("text"), "th2": F.xxhash64(F.lit(1), "text")})
    joined = keyed.join(lists, (F.col("th") == F.col("h")) & (F.col("th2") == F.col("h2")), "left")
    pattern = F.concat(F.lit(ENTITY), F.coalesce("more", F.lit("")))
    marked = F.when(F.col("more").isNull(), F.regexp_replace("text", F.lit(ENTITY), F.lit(MARK))).otherwise(F.regexp_replace("text", pattern, F.lit(MARK)))
    pieces = F.when(F.contains("text", F.lit(MARK)), F.split("text", pattern, -1)).otherwise(F.split(marked, MARK, -1))
    joined_up = F.array_join(F.flatten(F.zip_with(pieces, "news", lambda p, n: F.array(F.coalesce(p, F.lit("")), F.coalesce(n, F.lit(""))))), "")
    none = F.array().cast("array<string>")
    some = joined.select("id", F.when(F.col("news").isNotNull(), joined_up).otherwise(F.col("text")).alias("text"), F.coalesce("kinds", none).alias("kinds"))
    rest = source.where(~hinted(F.col("text"))).select("id", "text", none.alias("kinds"))
    return some.unionByName(rest).select(F.col("id").alias(id_col), F.col("text").alias(text_col), "kinds")
