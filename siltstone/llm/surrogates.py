"""Personal data replaced by surrogates, with DataFrame functions alone.

Each detected entity is rewritten character by character. A character moves within its own alphabet (digits, vowels or
consonants of one script and case, hexadecimal digits) by a keyed hash of the type and of all characters before it.
So a surrogate has the format, script and case of the original, the same entity always gets the same one (coreference),
and two entities of a type never share one (distinctness): where they first differ, both moved by the same amount.
Each move is at least one place, so the first character that moves differs from the original's. Parts that carry the
format stay: the country code and a fictional 555 exchange of a phone number, a reserved or top-level domain, the name
of a password field, a title. Letters outside the alphabets of ``NAME`` move among all others of their script and
category (upper case, lower case, other letters, digits). Card numbers are digits with a right check digit, and their
surrogates have one too; addresses keep their range.

A person is a title and names. Each name has a surrogate of its own, whatever stands beside it, so "Mr. Smith" and
"Mr. John Smith" share a surname, and a full name that a title introduces is replaced in its text without the title
too. Common names move within a list of their script and gender, others letter by letter.

That no two entities share a surrogate is also checked over the whole table (``collisions``), and a key that collides
anyway is changed; surrogates that are entities of the table themselves are listed too.
"""

from __future__ import annotations

import secrets
import sys
import unicodedata
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import discard, durable, free_name

#: The session's setting that holds the key.
KEY_SETTING = "spark.siltstone.surrogates.key"
#: Keys tried until no two entities share a surrogate.
ATTEMPTS = 4
#: Characters of an entity that are hashed one by one.
BLOCK = 64

# What entities look like, in the order in which they are tried. Possessive runs, and what must not stand
# before a match, keep the search linear in the length of the text.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Señorita|Господин|Госпожа"
_HEX_GROUP = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    # eight characters, or four with a digit among them
    "secret": r"(?<![\p{L}\p{N}])(?i:password|passwd|pwd|token|secret|api[_-]?key)\s?[=:]\s?\"?(?:[A-Za-z0-9+/_-]{8,}+|(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{4,}+)(?:\.[A-Za-z0-9+/_-]++)*+",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}+)(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})(?![A-Za-z0-9])",
    "card": r"(?<![\p{L}\p{N}])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:{_HEX_GROUP}:){{7}}{_HEX_GROUP}|(?:{_HEX_GROUP}:){{2,6}}(?::{_HEX_GROUP}){{1,5}})(?![\p{{L}}\p{{N}}:])",
    "person": rf"(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values()).replace(r"([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}", r"(?: [0-9]{4} [0-9]{4} [0-9]{4}|-[0-9]{4}-[0-9]{4}-[0-9]{4})")
#: No pattern matches a text without one of these; the search for them is a fraction of the work.
NEEDED = rf"[0-9@=:]|AKIA|ghp_|sk-|[a-f]{{32}}|(?:{_TITLES})\.? \p{{Lu}}"

# Alphabets in which a character moves.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX = ("0123456789abcdef",)
ADDRESS = ("0123456789abcdef", "ABCDEF")
CODE = (_DIGITS, _LOWER, _UPPER)
NAME = (
    _DIGITS, "aeiou", "AEIOU", "bcdfghjklmnprstvz", "BCDFGHJKLMNPRSTVZ", "qwxy", "QWXY", "àâäáãèéêëìíîïòóôöõùúûü", "ÀÂÄÁÃÈÉÊËÌÍÎÏÒÓÔÖÕÙÚÛÜ", "çñß",
    "аеёиоуыэюя", "АЕЁИОУЫЭЮЯ", "бвгджзйклмнпрстфхцчшщ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ",
)


# Common names by script and gender; none is in two lists.
NAMES = tuple(
    names.split()
    for names in (
        "James John Robert Michael David Thomas Daniel Peter Paul Stefan Hans Karl Pierre Jean Louis Henri Luis Carlos Miguel Antonio Pablo Diego Andrew",
        "Mary Anna Emma Laura Sarah Julia Maria Alice Claire Sophie Helena Ingrid Heike Petra Marie Camille Lucia Carmen Elena Isabel Rosa Nora Ellen",
        "Smith Brown Taylor Wilson Clark Lewis Walker Young Müller Schmidt Weber Becker Wagner Dupont Moreau Lefebvre Girard García López Fernández Torres Romero",
        "Иван Пётр Алексей Сергей Николай Михаил Дмитрий Андрей Павел Егор",
        "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана Юлия Вера",
        "Иванов Петров Сидоров Смирнов Кузнецов Соколов Попов Волков Морозов Лебедев",
        "Иванова Петрова Сидорова Смирнова Кузнецова Соколова Попова Волкова Морозова Лебедева",
    )
)


def _other_letters() -> tuple[list[tuple[int, int]], list[str]]:
    """Letters and numbers outside NAME: long runs of code points (first, number), and alphabets of a script and category."""
    groups: dict[tuple[str, str], list[int]] = {}
    taken = set("".join(NAME))
    for cp in range(128, sys.maxunicode + 1):
        c = chr(cp)
        category = unicodedata.category(c)
        if category[0] in "LN" and c not in taken:
            groups.setdefault((category, unicodedata.name(c, "unnamed").split()[0]), []).append(cp)
    runs, alphabets = [], []
    for _, points in sorted(groups.items()):
        rest = []
        for _, run in groupby(enumerate(points), lambda x: x[1] - x[0]):
            run = [cp for _, cp in run]
            if len(run) >= LONG_RUN:
                runs.append((run[0], len(run)))
            else:
                rest += run
        if len(rest) == 1 and alphabets:  # a letter alone has nowhere to move
            alphabets[-1] += chr(rest[0])
        elif rest:
            alphabets.append("".join(map(chr, rest)))
    return sorted(runs), alphabets


#: Letters of a script and category in a row that move by arithmetic, not by a list of them: ideographs, syllables.
LONG_RUN = 1000
RUNS, ALPHABETS = _other_letters()


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value made once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _ints(values: list[int]) -> Column:
    """An array of the numbers, which folds to one literal; ``lit`` would make a node of the plan for each."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


class _Tables:
    """All sets of alphabets as literals that one search looks up, so that one expression serves them all: the letters
    of each set; those of all sets in a row, where each set's begin, and for each letter the number of its alphabet as
    a character."""

    def __init__(self, sets: list[tuple[str, ...] | list[str]]):
        alphabets = [a for of in sets for a in of]
        self.letters_of = ["".join(of) for of in sets]
        self.before = [sum(map(len, self.letters_of[:n])) for n in range(len(sets))]
        self.letters = "".join(self.letters_of)
        self.alphabet_of = "".join(chr(0x100 + n) * len(a) for n, a in enumerate(alphabets))
        self.sizes = [len(a) for a in alphabets]
        self.starts = [sum(self.sizes[:n]) for n in range(len(alphabets))]


#: NAME's own letters come before those of other scripts, as most are found there.
_SETS = ((_DIGITS,), HEX, ADDRESS, CODE, NAME)
_TABLES = _Tables([[*a, *ALPHABETS] if a is NAME else a for a in _SETS])


def _number(alphabets: tuple[str, ...]) -> int:
    """The number of a set of alphabets, from 1; a part of an entity that stays has 0."""
    return _SETS.index(alphabets) + 1


def _shifted(at: Column, size: Column, hashed: Column) -> Column:
    return (at + 1 + hashed % (size - 1)) % size


def _moved(c: Column, hashed: Column, alphabets: Column) -> Column:
    """A letter or number, moved in its alphabet by one place at least; for NAME, one of any script among those of its
    script and category. Others stay. ``alphabets`` is the number of their set."""

    def listed(at: Column) -> Column:
        def of(n: Column) -> Column:
            start = F.element_at(_ints(_TABLES.starts), n)
            return (start + 1 + _shifted(at - 1 - start, F.element_at(_ints(_TABLES.sizes), n), hashed)).cast("int")

        return F.substr(F.lit(_TABLES.letters), _bound(F.ascii(F.substr(F.lit(_TABLES.alphabet_of), at, F.lit(1))) - 0xFF, of), F.lit(1))

    def in_run(run: Column) -> Column:
        first, size = F.element_at(_ints([first for first, _ in RUNS]), run), F.element_at(_ints([size for _, size in RUNS]), run)
        point = first + _shifted(F.ascii(c) - first, size, hashed)
        return F.when(F.ascii(c) < first + size, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise(c)

    run = F.aggregate(_ints([first for first, _ in RUNS]), F.lit(0), lambda k, first: k + (F.ascii(c) >= first).cast("int"))  # runs are in order
    unlisted = F.when((alphabets != _number(NAME)) | (F.ascii(c) < RUNS[0][0]), c).otherwise(_bound(run, in_run))
    found = F.instr(F.element_at(F.lit(_TABLES.letters_of), alphabets), c)
    return _bound(found, lambda at: F.when(at > 0, listed(at + F.element_at(_ints(_TABLES.before), alphabets))).otherwise(unlisted))


def _hash(key: str, kind: str | Column, before: Column) -> Column:
    head = F.lit(f"{key}|{kind}|") if isinstance(kind, str) else F.concat(F.lit(f"{key}|"), kind, F.lit("|"))
    return F.conv(F.substr(F.sha2(F.concat(head, before), 256), F.lit(1), F.lit(10)), 16, 10).cast("long")


def walk(v: Column, key: str, kind: str | Column, alphabets: tuple[str, ...] | Column) -> Column:
    """Each character moved within its alphabet, by one place at least; characters of none stay. ``alphabets`` is a set,
    or the number of one.

    What stands before a part of BLOCK characters enters the hash as a digest, so time is not the square of the length.
    """

    alphabets = alphabets if isinstance(alphabets, Column) else F.lit(_number(alphabets))

    def block(done: Column, part: Column) -> Column:
        def step(i: Column) -> Column:
            before = F.concat(done["digest"], F.substr(part, F.lit(1), i - 1))
            return _bound(F.substr(part, i, F.lit(1)), lambda c: _moved(c, _hash(key, kind, before), alphabets))

        moved = F.array_join(F.transform(F.sequence(F.lit(1), F.length(part)), step), "")
        return F.struct(F.sha2(F.concat(done["digest"], part), 256).alias("digest"), F.concat(done["moved"], moved).alias("moved"))

    parts = F.regexp_extract_all(v, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.aggregate(parts, F.struct(F.lit("").alias("digest"), F.lit("").alias("moved")), block, lambda done: done["moved"])


def _rest(v: Column, head: Column) -> Column:
    return F.substr(v, F.length(head) + 1, F.length(v))


def check_digit(digits: Column) -> Column:
    """Luhn's check digit for the digits."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return (F.lit(10) - F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10) % 10


def _part(text: Column, kind: str | Column = "", alphabets: int | Column = 0) -> Column:
    """A part of an entity: its text, the type that enters its hash, and the number of its alphabets; 0 stays."""
    kind, alphabets = (x if isinstance(x, Column) else F.lit(x) for x in (kind, alphabets))
    return F.struct(text.alias("text"), kind.alias("kind"), alphabets.cast("int").alias("alphabets"))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _card_parts(v: Column) -> Column:
    """A card number's digits but the last; a number that only looks like one stays."""

    def of(digits: Column) -> Column:
        body = F.substr(digits, F.lit(1), F.length(digits) - 1)
        return F.when(check_digit(body).cast("string") == F.substr(digits, F.length(digits), F.lit(1)), F.array(_part(body, "card", _number((_DIGITS,))))).otherwise(F.array(_part(v)))

    return _bound(_digits(v), of)


def _card(v: Column, moved: Column) -> Column:
    """The moved digits with their check digit, laid out as in the card number ``v``."""

    def laid_out(out: Column) -> Column:
        def place(i: Column) -> Column:
            c = F.substr(v, i, F.lit(1))
            return F.when(c.rlike("[0-9]"), F.substr(out, F.length(_digits(F.substr(v, F.lit(1), i))), F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(v)), place), "")

    return F.when(moved == v, v).otherwise(_bound(F.concat(moved, check_digit(moved).cast("string")), laid_out))


def _ip(v: Column, key: str) -> Column:
    parts = F.split(v, r"\.")

    def step(i: Column) -> Column:
        before = F.array_join(F.slice(parts, F.lit(1), i - 1), ".")
        return ((F.element_at(parts, i).cast("int") + 1 + _hash(key, "ip", before) % 255) % 256).cast("string")

    return F.array_join(F.transform(F.sequence(F.lit(1), F.size(parts)), step), ".")


_COUNTRY = r"^\+(?:1|[0-9]{1,3}(?=[ .-]))[ .-]?"
_FICTIONAL = r"^(.*[0-9].*?)555([ .-]?[0-9]{4})$"


def _phone_parts(v: Column) -> Column:
    """The country code, and the number without a fictional exchange."""

    def of(code: Column) -> Column:
        return _bound(_rest(v, code), lambda number: F.array(_part(code), F.when(number.rlike(_FICTIONAL), _part(F.regexp_replace(number, _FICTIONAL, "$1$2"), "phone555", _number((_DIGITS,)))).otherwise(_part(number, "phone", _number((_DIGITS,))))))

    return _bound(F.regexp_extract(v, _COUNTRY, 0), of)


def _phone(v: Column, moved: Column) -> Column:
    """The moved parts with the fictional exchange that the phone number ``v`` has."""
    code = F.regexp_extract(v, _COUNTRY, 0)
    before = F.regexp_extract(_rest(v, code), _FICTIONAL, 1)
    return F.when(before == "", moved).otherwise(_bound(F.length(code) + F.length(before), lambda n: F.concat(F.substr(moved, F.lit(1), n), F.lit("555"), F.substr(moved, n + 1, F.length(moved)))))


def _email(v: Column) -> Column:
    domain = F.regexp_extract(v, r"(?:\.example)?\.[A-Za-z0-9-]+$", 0)
    return F.array(_part(F.substr(v, F.lit(1), F.length(v) - F.length(domain)), "email", _number(NAME)), _part(domain))


def _keep_head(v: Column, kind: str, head: str, alphabets: tuple[str, ...]) -> Column:
    start = F.regexp_extract(v, head, 0)
    return F.array(_part(start), _part(_rest(v, start), kind, _number(alphabets)))


def _secret(v: Column) -> Column:
    start = F.regexp_extract(v, r"^[^=:]*[=:]\s?\"?", 0)
    return _bound(_rest(v, start), lambda value: F.array(_part(start), F.when(value.rlike("^[0-9a-f]+$"), _part(value, "hex", _number(HEX))).otherwise(_part(value, "secret", _number(CODE)))))


_ALL_NAMES = " ".join(name for names in NAMES for name in names)
_LIST_OF = [n for n, names in enumerate(NAMES) for _ in names]
_LIST_SIZES = [len(names) for names in NAMES]
_LIST_STARTS = [sum(_LIST_SIZES[:n]) for n in range(len(NAMES))]


def _listed(at: Column, key: str) -> Column:
    """The name at a place of all lists, moved within its list: all names of a list by as many places."""
    n = F.element_at(_ints(_LIST_OF), at)
    start, size = F.element_at(_ints(_LIST_STARTS), n + 1), F.element_at(_ints(_LIST_SIZES), n + 1)
    shift = _hash(key, F.concat(F.lit("names"), n.cast("string")), F.lit(""))
    return F.element_at(F.split(F.lit(_ALL_NAMES), " "), (start + 1 + _shifted(at - 1 - start, size, shift)).cast("int"))


def _person(v: Column) -> Column:
    """The title and what stands between names stay; each name is a part."""
    title = F.regexp_extract(v, rf"^(?:{_TITLES})\.? ", 0)
    words = F.regexp_extract_all(_rest(v, title), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.concat(F.array(_part(title)), F.transform(words, lambda w: _part(w, "person", F.when(w.rlike(r"^\p{L}"), _number(NAME)).otherwise(0))))


def kind_of(v: Column) -> Column:
    """The type of an entity: the first pattern that it matches from start to end; several names alone are a person too."""
    out = F.when(v.rlike(r"^\p{Lu}\p{Ll}+(?:[ -]\p{Lu}\p{Ll}+)+$"), F.lit("person"))
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(v.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def surrogate(v: Column, key: str) -> Column:
    """The surrogate of an entity, by its type; a number that only looks like a card's stays.

    An entity is cut in parts first, then one expression moves the parts of all types: a walk for each type would make
    the plan as many times as large, and the driver needs memory for it.
    """
    parts_of = {
        "email": _email(v), "secret": _secret(v), "access_key": _keep_head(v, "access_key", "^(?:AKIA|ghp_|sk-)", CODE), "hex": F.array(_part(v, "hex", _number(HEX))), "card": _card_parts(v),
        "phone": _phone_parts(v), "ssn": F.array(_part(v, "ssn", _number((_DIGITS,)))), "iban": _keep_head(v, "iban", "^[A-Z]{2}", CODE), "ip6": F.array(_part(v, "ip6", _number(ADDRESS))), "person": _person(v),
    }

    def moved(part: Column) -> Column:
        text, kind, alphabets = part["text"], part["kind"], part["alphabets"]
        name = F.when(kind == "person", F.array_position(F.split(F.lit(_ALL_NAMES), " "), text)).otherwise(0).cast("int")
        return F.when(alphabets == 0, text).otherwise(_bound(name, lambda at: F.when(at > 0, _listed(at, key)).otherwise(walk(text, key, kind, alphabets))))

    def of(kind: Column) -> Column:
        parts = F.array(_part(v))
        for k, column in reversed(parts_of.items()):
            parts = F.when(kind == k, column).otherwise(parts)
        whole = F.array_join(F.transform(parts, moved), "")
        return F.when(kind == "ip", _ip(v, key)).otherwise(_bound(whole, lambda out: F.when(kind == "card", _card(v, out)).when(kind == "phone", _phone(v, out)).otherwise(out)))

    return _bound(kind_of(v), of)


#: Stands around entities while a text is cut; where a text has it, or the sign that escapes it, both are escaped first.
_MARK, _ESCAPE = "\x01", "\x03"


def _names_too(text: Column) -> Column:
    """A pattern for the full names that titles introduce in the text; null if there are none."""
    titled = F.regexp_extract_all(text, F.lit(PATTERNS["person"]), F.lit(0))
    names = F.filter(F.transform(titled, lambda v: F.regexp_replace(v, rf"^(?:{_TITLES})\.? ", "")), lambda v: v.rlike("[ -]"))
    longest_first = F.transform(F.sort_array(F.transform(F.array_distinct(names), lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda x: x["v"])
    return F.when(text.rlike(rf"(?:{_TITLES})\.? \p{{Lu}}") & (F.size(names) > 0), F.concat(F.lit(rf"(?<!\p{{L}})(?:"), F.array_join(longest_first, "|"), F.lit(rf")(?!\p{{L}})")))


def cut_at_entities(text: Column) -> Column:
    """The whole text in parts, every second of which is an entity; one part if there is none, null for a null text.

    One search marks the entities. Marks that a text has itself are escaped, and come back by ``joined``.
    """
    escaped = F.when(text.rlike("[\x01\x03]"), F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "\x05")), F.lit(_MARK), F.lit(_ESCAPE + "\x04"))).otherwise(text)
    names = _names_too(text)
    mark = F.lit(f"{_MARK}$0{_MARK}")
    marked = F.when(names.isNull(), F.regexp_replace(escaped, ANY, f"{_MARK}$0{_MARK}")).otherwise(F.regexp_replace(escaped, F.concat(F.lit(ANY + "|"), names), mark))
    return F.when(text.rlike(NEEDED), F.split(marked, _MARK, -1)).when(text.isNotNull(), F.array(text))


def joined(parts: Column) -> Column:
    """The text of the parts again."""
    whole = F.array_join(parts, "")
    return F.when(whole.contains(_ESCAPE), F.replace(F.replace(whole, F.lit(_ESCAPE + "\x04"), F.lit(_MARK)), F.lit(_ESCAPE + "\x05"), F.lit(_ESCAPE))).otherwise(whole)


def entities_of(text: Column) -> Column:
    """All entities of a whole text, in order; null for a null text."""
    return F.filter(cut_at_entities(text), lambda part, i: i % 2 == 1)


def distinct_entities(docs: DataFrame) -> DataFrame:
    """(entity): each entity of the whole table once."""
    return docs.select(F.explode(entities_of(docs["text"])).alias("entity")).distinct()


def collisions(entities: DataFrame, key: str) -> DataFrame:
    """(surrogate, entities, real): surrogates that several entities share, or that are entities of the table themselves."""
    # few bytes, but much work for each: dealt out again, or one task would get them all
    dealt = entities.repartition(int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    made = dealt.select("entity", surrogate(F.col("entity"), key).alias("surrogate"))
    # those that stay count as none: a filter would be pushed down, with a second copy of the whole expression
    both = made.select("surrogate", (F.col("surrogate") != F.col("entity")).cast("int").alias("n"), F.lit(False).alias("real")).union(entities.select("entity", F.lit(0), F.lit(True)))
    return both.groupBy("surrogate").agg(F.sum("n").alias("entities"), F.max("real").alias("real")).where("entities > 1 or (entities = 1 and real)")


def session_key(spark: SparkSession) -> str:
    """The key that the session's KEY_SETTING holds; where it holds none, a random one that the session then keeps."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        spark.conf.set(KEY_SETTING, key := secrets.token_hex(16))
    return key


def distinct_key(docs: DataFrame, key: str) -> str:
    """``key``, or the first variant of it under which no two entities of the whole table share a surrogate.

    The texts are searched once. That a surrogate is an entity of the table too (``real``) does not change the key: where
    values have a small range, as phone numbers with a fictional exchange, every key makes some, and they tell nothing.
    """
    entities = durable(distinct_entities(docs), "entities")
    for k in range(ATTEMPTS):
        tried = key if k == 0 else f"{key}#{k}"
        if not collisions(entities, tried).where("entities > 1").head(1):
            discard(entities)
            return tried
    raise ValueError(f"two entities share a surrogate under each of {ATTEMPTS} keys")


def replace_entities(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """``docs`` with each entity of ``text_col`` replaced, and their number in ``count_col``, which comes last.

    A column that is called like ``count_col`` gives way to it; all others stay, whatever their names. A null text stays
    null with 0 entities; a text without entities stays as it is, to the byte. Equal entities get equal surrogates in
    all rows, repeated rows too; an empty table stays empty. No shuffle, and no state between rows.
    """
    names = [c for c in docs.columns if c != count_col]
    before, after = free_name(docs, "parts"), free_name(docs, "replaced")
    cut = docs.select(*[docs[f"`{c}`"] for c in names], cut_at_entities(docs[f"`{text_col}`"]).alias(before))
    replaced = cut.withColumn(after, F.transform(before, lambda part, i: F.when(i % 2 == 1, surrogate(part, key)).otherwise(part)))
    n = F.coalesce(F.aggregate(F.zip_with(before, after, lambda a, b: (a != b).cast("int")), F.lit(0), lambda a, b: a + b), F.lit(0))
    changed = F.when(F.size(before) > 1, joined(F.col(after))).otherwise(F.col(f"`{text_col}`"))
    return replaced.select(*[changed.alias(c) if c == text_col else F.col(f"`{c}`") for c in names], n.alias(count_col))
