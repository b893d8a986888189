"""Surrogates for personal data, with DataFrame functions only.

Entities found by one regular expression are replaced by surrogates of the same type and form. A surrogate is derived from a secret key and
the entity's normal form (so all spellings of an entity, in all documents, get the same one), and follows the original's
format: digits for digits, letters for letters of the same case and script, separators kept, card numbers and IBANs with valid
check digits where the original's are valid, personal names in the original's script and of the gender that the title tells. A name that is found by
its title is replaced in the same text's other places, too.

Distinct entities get distinct surrogates, and no surrogate is itself an entity of the corpus: all entities' surrogates are
compared relationally, and those that clash are derived anew with the next attempt number until none does.

The key is used as HMAC-SHA256 over native functions. Its padded blocks, one pair for each type of entity, come to the executors as rows of a
table, so neither plans nor event logs show it.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import stored

# Titles with the gender they tell (M only with a full stop), particles of surnames, and capitalised words that end a name.
MALE = ["Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "M", "Señor", "Sr", "Don", "Господин", "MR", "HERR"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Señorita", "Srta", "Doña", "Госпожа", "MRS", "MS", "FRAU"]
EITHER = ["Dr", "Prof", "Mx", "Доктор", "DR", "PROF"]
PARTICLES = ["von", "van", "der", "den", "de", "del", "la", "le", "di", "da", "dos", "du", "zu", "zum", "bin", "al"]
NO_NAMES = ["And", "Or", "The", "Of", "In", "On", "At", "To", "For", "With", "By", "Is", "Was", "Und", "Oder", "Der", "Die", "Das", "Et", "Ou", "Le", "La", "Les", "El", "Los"]
#: Country codes by length; those of three digits by their first two and the last ones.
ONE_DIGIT = ["1", "7"]
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
THREE_DIGITS = {
    "21": "12368", "22": "0123456789", "23": "0123456789", "24": "0123456789", "25": "012345678", "26": "012345689", "29": "01789", "35": "0123456789", "37": "01234567",
    "38": "01235679", "42": "013", "50": "0123456789", "59": "0123456789", "67": "023456789", "68": "012356789", "69": "012", "80": "08", "85": "02356", "88": "06",
    "96": "012345678", "97": "012345679", "99": "234568",
}
PHONE_WORDS = ["phone", "telephone", "telefon", "teléfono", "téléphone", "tel", "tél", "fax", "mobile", "mobil", "móvil", "cell", "call", "handy", "portable"]
# End of the fixed values.

_NAME = r"\p{Lu}(?:['’]\p{Lu})?\p{L}++(?:['’\-]\p{Lu}\p{L}++)*+"
_TITLES = "|".join(r"M(?=\.)" if t == "M" else t for t in sorted(MALE + FEMALE + EITHER, key=len, reverse=True))
_TITLE = rf"(?:(?:{_TITLES})\.? )"
_INITIALS = "".join(sorted({t[0] for t in MALE + FEMALE + EITHER}))
_BETWEEN = rf"(?:\p{{Lu}}\. |(?:{'|'.join(PARTICLES)}) )*+"
#: What is found, in the order in which alternatives are tried at a place; none begins right after an ASCII letter or digit. Repetitions without a bound are possessive: an entity is taken to its end, in one pass.
LETTERED: dict[str, str] = {
    "secret": r"(?=[tTsSpPaA])(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)[\"']?\s{0,4}[=:]\s{0,4}[\"']?[A-Za-z0-9+/_=.\-]{8,}+",
    "email": r"(?<![\p{L}._%+\-])[A-Za-z\d._%+\-\p{L}]++@[\p{L}\d\-]++(?:\.[\p{L}\d\-]++)++",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?=[0-9a-fA-F]{0,4}:)(?<![:.])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?=[0-9a-fA-F:]*\d)(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![0-9A-Za-z:])",
    "hex": r"(?=[a-fA-F]*+\d)[0-9a-fA-F]{32,}+(?![A-Za-z0-9])",
    "name": rf"(?=[{_INITIALS}])(?<!\p{{L}}){_TITLE}++{_BETWEEN}(?!(?:{'|'.join(NO_NAMES)})(?!\p{{L}})){_NAME}(?: (?!{_TITLE}|(?:{'|'.join(NO_NAMES)})(?!\p{{L}})){_BETWEEN}{_NAME})*+",
}
_PAIRS = lambda n: "(?:" + "|".join(rf"(?:{sep}\d{{2}}){{{n}}}" for sep in (" ", r"\.", "-")) + ")"
_END = r"(?!\d|[.,]\d)"
#: Phone numbers: with a country code in groups of 2 to 4 digits, or unbroken; an area code in brackets; North American ones; an area code with 0; after a word that says so;
#: groups of two digits (French, Spanish); an area code and 5 to 8 digits (German), with a country code and without.
_PHONES = [
    rf"(?<!\+)\+\d{{1,3}}[ .\-]?(?:\(0\)[ .\-]?)?(?:\(\d{{1,5}}\)[ .\-]?|\d{{1,5}}[ .\-])\d{{2,4}}(?:[ .\-]\d{{2,4}}){{1,3}}{_END}",
    r"(?<!\+)\+\d{8,15}(?!\d)",
    rf"\(\d{{2,5}}\)[ .\-]?\d{{3,4}}[ .\-]\d{{3,4}}{_END}",
    "(?<![.,])(?:" + "|".join(rf"\d{{3}}{sep}\d{{3}}{sep}\d{{4}}" for sep in (" ", r"\.", "-")) + f"){_END}",
    rf"(?<![.,])0\d{{1,4}}[ .\-]\d{{3,4}}[ .\-]\d{{3,4}}{_END}",
    rf"(?=\d{{7,15}}(?!\d))(?<=(?i:{'|'.join(PHONE_WORDS)})[.:]{{0,2}} {{0,2}})\d{{7,15}}",
    rf"(?<!\+)\+\d{{1,3}}[ .\-]?(?:\(0\)[ .\-]?)?\d{{1,3}}{_PAIRS('3,4')}{_END}",
    rf"(?<!\+)\+\d{{1,3}}[ .\-]?(?:\(0\)[ .\-]?)?(?:\(\d{{2,5}}\) ?|\d{{2,5}}(?: ?/ ?|[ .\-]))\d{{5,8}}(?:-\d{{1,4}})?{_END}",
    rf"(?<![.,])0[1-9]{_PAIRS(4)}{_END}",
    rf"(?<![.,])[6-9]\d{{2}}{_PAIRS(3)}{_END}",
    rf"(?<![.,])(?:\(0[1-9]\d{{1,3}}\) ?|0[1-9]\d{{1,3}}(?: ?/ ?|[ \-]))\d{{5,8}}(?:-\d{{1,4}})?{_END}",
]
#: Country codes as they are assigned: of one, two, or else three digits.
_COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
NUMERIC: dict[str, str] = {
    "hex": LETTERED["hex"],  # before the numbers that it may begin with
    "ipv6": LETTERED["ipv6"],
    "ip": r"(?<!\.)\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "ssn": r"(?<!\-)\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"\d(?:[ \-]?\d){12,18}(?!\d)",
    "phone": "|".join(_PHONES),
}
_any = lambda patterns: "|".join(f"(?:{p})" for p in patterns.values())
ENTITY = rf"(?<![A-Za-z0-9])(?:(?=[0-9+(])(?:{_any(NUMERIC)})|(?:{_any(LETTERED)}))"
#: What every text with an entity holds; cheap to look for.
HINT = rf"[0-9@=:]|(?=[{_INITIALS}])(?<!\p{{L}}){_TITLE}\p{{L}}"
#: Consonants and vowels that invented names are made of, by script.
SYLLABLES = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδζκλμνπρστ", "αεηιο")}
#: Endings of given names by script and gender.
ENDINGS = {"latin": {"m": "n", "f": "a", "x": "e"}, "cyrillic": {"m": "н", "f": "а", "x": "е"}, "greek": {"m": "ος", "f": "α", "x": "η"}}
_letters = lambda first, n, step=1: "".join(chr(first + i * step) for i in range(n))
#: Small and capital letters that stand in for a script's, by the script's character class. What is of no script here gets Latin letters.
ALPHABETS: dict[str, tuple[str, str]] = {
    r"\p{IsCyrillic}": (_letters(0x430, 32), _letters(0x410, 32)),
    r"\p{IsGreek}": (_letters(0x3B1, 17), _letters(0x391, 17)),
    r"\p{IsArmenian}": (_letters(0x561, 38), _letters(0x531, 38)),
    r"\p{IsGeorgian}": (_letters(0x10D0, 33), _letters(0x10D0, 33)),
    r"\p{IsHebrew}": (_letters(0x5D0, 27), _letters(0x5D0, 27)),
    r"\p{IsArabic}": (_letters(0x628, 19), _letters(0x628, 19)),
    r"\p{IsDevanagari}": (_letters(0x915, 37), _letters(0x915, 37)),
    r"\p{IsThai}": (_letters(0xE01, 46), _letters(0xE01, 46)),
    r"\p{IsHiragana}": (_letters(0x304B, 20), _letters(0x304B, 20)),
    r"\p{IsKatakana}": (_letters(0x30AB, 20), _letters(0x30AB, 20)),
    r"\p{IsHangul}": (_letters(0xAC00, 200, 28), _letters(0xAC00, 200, 28)),
    r"\p{IsHan}": (_letters(0x4E00, 200, 16), _letters(0x4E00, 200, 16)),
}
ATTEMPTS = 40
STREAM = 4  # digests of 64 hexadecimal digits each
#: Types of entities, each with a key of its own.
GROUPS = ["email", "secret", "ip", "ipv6", "ssn", "iban", "card", "phone", "code", "surname", "given_m", "given_f", "given_x"]
#: Entities whose surrogates a task makes.
TASK_ENTITIES = 1000


def _bound(value: Column, f) -> Column:
    """f(value), with the value computed once however often f's lambdas use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def kind(m: Column) -> Column:
    """The type of a match."""
    n = F.length(_digits(m))
    tests = [
        ("email", m.contains("@")),
        ("ipv6", m.rlike(r"^[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4}){2,7}$")),
        ("name", m.rlike(f"^{_TITLE}")),
        ("secret", m.rlike(r"[=:]") | m.rlike(r"^[0-9a-fA-F]{32,}$")),
        ("ip", m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")),
        ("ssn", m.rlike(r"^\d{3}-\d{2}-\d{4}$")),
        ("iban", m.rlike(r"^[A-Z]{2}\d{2}")),
        ("card", (n >= 13) & ~m.startswith("+")),
    ]
    out = F.lit("phone")
    for name, test in reversed(tests):
        out = F.when(test, name).otherwise(out)
    return out


def _title(m: Column) -> Column:
    return F.regexp_extract(m, rf"^({_TITLE}++)", 1)


def _gender(m: Column) -> Column:
    titles = F.split(F.trim(F.regexp_replace(_title(m), r"\.", "")), " ")
    told = lambda names: F.arrays_overlap(titles, F.array(*map(F.lit, names)))
    return F.when(told(FEMALE), "f").when(told(MALE), "m").otherwise("x")


def _secret_value(m: Column) -> Column:
    return F.regexp_extract(m, r"^(?:[A-Za-z_\-]+[\"']?\s*[=:]\s*[\"']?)?(.*)$", 1)


def _is_hex(value: Column) -> Column:
    return value.rlike("^([0-9a-f]{16,}|[0-9A-F]{16,})$") & value.rlike("[a-fA-F]")


def _national(m: Column) -> Column:
    """A phone number's digits without country code and leading 0."""
    return F.regexp_replace(_digits(F.regexp_replace(m, _COUNTRY, "")), "^0", "")


def _groups(m: Column) -> Column:
    """The eight groups of an IPv6 address as they are written, '' for those that '::' leaves out."""
    ends = F.split(m, "::")
    part = lambda i: F.when((F.size(ends) > i) & (F.get(ends, F.lit(i)) != ""), F.split(F.get(ends, F.lit(i)), ":")).otherwise(F.array().cast("array<string>"))
    return _bound(F.struct(part(0).alias("head"), part(1).alias("tail")), lambda x: F.concat(x["head"], F.array_repeat(F.lit(""), F.greatest(8 - F.size(x["head"]) - F.size(x["tail"]), F.lit(0))), x["tail"]))


def _ipv6(m: Column) -> Column:
    """All groups of an address, lower case, without leading zeros: the same for all its spellings."""
    return F.array_join(F.transform(_groups(F.lower(m)), lambda g: F.coalesce(F.nullif(F.regexp_replace(g, "^0+", ""), F.lit("")), F.lit("0"))), ":")


def _like_address(m: Column, made: Column) -> Column:
    """An address's surrogate (all groups) in the spelling of ``m``: groups of zeros are zeros in both, so '::' stays, and groups keep their leading zeros."""
    group = lambda g, new: F.when(F.length(g) > F.length(new), F.lpad(new, F.length(g), "0")).otherwise(new)
    return _bound(F.struct(_groups(m).alias("own"), F.split(made, ":").alias("new")), lambda x: F.regexp_replace(F.array_join(F.zip_with(x["own"], x["new"], lambda g, new: F.when(g == "", "").otherwise(group(g, new))), ":"), ":{2,}", "::"))


def _name_words(m: Column) -> Column:
    return F.split(F.substring(m, F.length(_title(m)) + 1, F.length(m)), " ")


def keys(m: Column) -> Column:
    """The entities that a match stands for, as an array of 'type|normal form'.

    A name is one entity for each of its words: the last is a surname, the others are given names of the gender that the title tells, if any (see ``same_names`` for those
    without); a word's entity is the same with and without the others, so "Mr John Smith" and "Mr Smith" agree. Particles and initials are none (null). A phone number is one for the
    number and one for its country code, if it has any, so spellings with and without agree and those with different codes don't.
    """
    return _bound(F.struct(m.alias("m"), kind(m).alias("k")), lambda x: _keys(x["m"], x["k"]))


def _keys(m: Column, k: Column) -> Column:
    plain = (
        F.when(k == "email", F.lower(m))
        .when(k == "ipv6", _ipv6(m))
        .when(k == "secret", F.when(_is_hex(_secret_value(m)), F.lower(_secret_value(m))).otherwise(_secret_value(m)))
        .when(k.isin("ssn", "card"), _digits(m))
        .otherwise(F.regexp_replace(m, " ", ""))
    )
    group = lambda x, i: F.when(i == F.size(x["words"]) - 1, F.lit("surname")).otherwise(F.concat(F.lit("given_"), x["gender"]))
    own = lambda x, w, i: F.when(w.rlike(r"^\p{Lu}.*\p{L}$") & (F.length(w) > 1), F.concat(group(x, i), F.lit("|"), F.lower(w)))
    named = _bound(F.struct(_name_words(m).alias("words"), _gender(m).alias("gender")), lambda x: F.transform(x["words"], lambda w, i: own(x, w, i)))
    number = F.concat(F.lit("phone|"), _national(m))
    phone = F.when(m.rlike(_COUNTRY), F.array(number, F.concat(F.lit("code|"), F.regexp_extract(m, _COUNTRY, 1)))).otherwise(F.array(number))
    return F.when(k == "name", named).when(k == "phone", phone).otherwise(F.array(F.concat(k, F.lit("|"), plain)))


def key_table(spark: SparkSession, secret: str) -> DataFrame:
    """group, inner, outer: for each type of entity the padded blocks of HMAC-SHA256 with a key of its own, derived from the secret."""
    rows = []
    for group in GROUPS:
        key = hmac.new(secret.encode(), group.encode(), hashlib.sha256).digest().ljust(64, b"\0")
        rows.append((group, bytearray(x ^ 0x36 for x in key), bytearray(x ^ 0x5C for x in key)))
    return spark.createDataFrame(rows, "group string, inner binary, outer binary")


def country_codes(secret: str) -> dict[str, str]:
    """A country code's surrogate: another assigned code of as many digits. Codes are put in an order that the secret makes, and each gets the next, so no two get one and none keeps its own."""
    key = hmac.new(secret.encode(), b"code", hashlib.sha256).digest()
    out = {}
    for codes in (ONE_DIGIT, TWO_DIGITS, [a + b for a, ends in THREE_DIGITS.items() for b in ends]):
        order = sorted(codes, key=lambda c: hmac.new(key, c.encode(), hashlib.sha256).digest())
        out |= dict(zip(order, [*order[1:], order[0]], strict=True))
    return out


def _hmac(inner: Column, outer: Column, message: Column) -> Column:
    """HMAC-SHA256 as hexadecimal digits."""
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def _stream(inner: Column, outer: Column, key: Column, attempt: Column) -> Column:
    """Hexadecimal digits from the key's blocks, an entity and an attempt."""
    return F.concat(*(_hmac(inner, outer, F.concat_ws("|", F.lit(str(i)), attempt.cast("string"), key)) for i in range(STREAM)))


def _number(stream: Column, i: Column) -> Column:
    """The i-th number (from 0) of 0..255 in a stream; it starts again at the end."""
    at = F.pmod(i, F.lit(STREAM * 32)) * 2 + 1
    return F.conv(F.substring(stream, at, F.lit(2)), 16, 10).cast("int")


def _shape(value: Column, stream: Column, is_hex: Column | None = None) -> Column:
    """Letters and digits replaced by others of their class and script; hexadecimal values stay hexadecimal (their normal form is lower case)."""

    def one(x, c, n):
        return (
            F.when(x["is_hex"] & c.rlike("[0-9A-Fa-f]"), F.lower(F.hex((n % 16).cast("long"))))
            .when(c.rlike("[0-9]"), (n % 10).cast("string"))
            .when(c.rlike("[A-Z]"), F.char((n % 26 + 65).cast("long")))
            .when(c.rlike("[a-z]"), F.char((n % 26 + 97).cast("long")))
            .when(c.rlike(r"\p{L}"), other(c, n))
            .otherwise(c)
        )

    def other(c, n):
        small, large = F.char((n % 26 + 97).cast("long")), F.char((n % 26 + 65).cast("long"))
        pick = lambda letters: F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))
        for script, (low, up) in ALPHABETS.items():
            small, large = F.when(c.rlike(script), pick(low)).otherwise(small), F.when(c.rlike(script), pick(up)).otherwise(large)
        return F.when(c.rlike(r"\p{Lu}"), large).otherwise(small)

    def block(x, b):
        # 32 numbers: the stream's own, and after its end digests of it and of the block's place
        own = F.when(b < STREAM, F.substring(x["stream"], b * 64 + 1, F.lit(64))).otherwise(F.sha2(F.concat_ws("|", x["stream"], b.cast("string")), 256))
        piece = F.substring(x["value"], b * 32 + 1, F.lit(32))
        each = lambda y: F.transform(F.sequence(F.lit(0), F.length(y["piece"]) - 1), lambda i: one(x, F.substring(y["piece"], i + 1, F.lit(1)), _number(y["own"], i)))
        return F.array_join(_bound(F.struct(own.alias("own"), piece.alias("piece")), each), "")

    parts = F.struct(value.alias("value"), stream.alias("stream"), (_is_hex(value) if is_hex is None else is_hex).alias("is_hex"))
    shaped = _bound(parts, lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(x["value"]) - 1) / 32).cast("int")), lambda b: block(x, b)), ""))
    return F.when(F.length(value) == 0, value).otherwise(shaped)


def _numerals(n: Column, stream: Column) -> Column:
    """n digits, the first not 0."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.when(i == 0, _number(stream, i) % 9 + 1).otherwise(_number(stream, i) % 10).cast("string")), "")


def _syllable(script: str, stream: Column):
    """i -> the i-th syllable"""
    consonants, vowels = SYLLABLES[script]
    pick = lambda letters, i: F.get(F.array(*map(F.lit, letters)), _number(stream, i) % len(letters))
    return lambda i: F.concat(pick(consonants, i * 2), pick(vowels, i * 2 + 1))


def _script(c: Column) -> Column:
    return F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").when(c.rlike(r"\p{IsGreek}"), "greek").when(c.rlike(r"\p{IsLatin}"), "latin").otherwise("other")


def _invented(word: Column, group: Column, stream: Column, attempt: Column) -> Column:
    """A name in the word's script: as many syllables as are needed to stay distinct, and a given name's ending. Scripts without syllables here get letters."""
    out = _shape(F.rpad(word, F.greatest(F.length(word), attempt + 4), F.coalesce(F.nullif(word, F.lit("")), F.lit("a"))), stream)
    for script in SYLLABLES:
        body = F.array_join(F.transform(F.sequence(F.lit(0), attempt + 3), _syllable(script, stream)), "")
        end = F.lit("")
        for gender, ending in ENDINGS[script].items():
            end = F.when(group == f"given_{gender}", ending).otherwise(end)
        out = F.when(_script(word) == script, F.concat(body, end)).otherwise(out)
    return out


def _mod97(value: Column) -> Column:
    """An IBAN in the order of its check, modulo 97: letters count as 10 to 35."""
    step = lambda rest, c: F.when(c.rlike("[0-9]"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(value, ""), lambda c: c != ""), F.lit(0), step)


def _iban(value: Column, stream: Column) -> Column:
    """Country kept, other letters and digits replaced; valid check digits if the original's are."""
    country, body = F.substring(value, 1, 2), F.substring(value, F.lit(5), F.length(value))
    valid = _mod97(F.concat(body, F.substring(value, 1, 4))) == 1
    check = lambda made: F.when(valid, F.lpad((98 - _mod97(F.concat(made, country, F.lit("00")))).cast("string"), 2, "0")).otherwise(F.concat((_number(stream, F.lit(126)) % 10).cast("string"), (_number(stream, F.lit(127)) % 10).cast("string")))
    return _bound(_shape(body, stream), lambda made: F.concat(country, check(made), made))


def _address(value: Column, stream: Column, attempt: Column) -> Column:
    """Groups of zeros stay; others keep their width, which grows a digit every eight attempts, and don't begin with 0."""

    def group(x, g, i):
        width = F.least(F.length(g) + F.floor(x["attempt"] / 8).cast("int"), F.lit(4))
        digit = lambda k: F.lower(F.hex((F.when(k == 0, _number(x["stream"], i * 4 + k) % 15 + 1).otherwise(_number(x["stream"], i * 4 + k) % 16)).cast("long")))
        return F.when(g == "0", g).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), width - 1), digit), ""))

    return _bound(F.struct(stream.alias("stream"), attempt.alias("attempt"), value.alias("value")), lambda x: F.array_join(F.transform(F.split(x["value"], ":"), lambda g, i: group(x, g, i)), ":"))


def surrogate(inner: Column, outer: Column, key: Column, attempt: Column) -> Column:
    """The normal form that stands in for an entity ('type|normal form') at an attempt."""
    made = lambda x: _surrogate(x["group"], x["value"], x["stream"], attempt)
    parts = F.struct(F.substring_index(key, "|", 1).alias("group"), F.regexp_replace(key, r"^[^|]*\|", "").alias("value"), _stream(inner, outer, key, attempt).alias("stream"))
    return _bound(parts, made)


def _surrogate(group: Column, value: Column, s: Column, attempt: Column) -> Column:
    octet = lambda i: (_number(s, F.lit(i)) % 256).cast("string")
    number = _numerals(F.length(value), s)
    body = F.substring(number, F.lit(1), F.length(number) - 1)
    checked = F.concat(body, F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string")), lambda d: F.call_function("luhn_check", F.concat(body, d))), 1))
    local = F.substring_index(value, "@", 1)
    host = F.substring_index(value, "@", -1)
    labels = F.size(F.split(host, r"\."))
    # the reserved example names keep surrogate hosts from belonging to anyone
    made_host = F.concat(_shape(F.substring_index(host, ".", 1), F.reverse(s)), F.when(labels > 2, F.concat(F.lit("."), F.substring(s, 101, 4))).otherwise(""), F.lit(".example"))
    first = _number(s, F.lit(0)) % 200 + 11
    public = F.when(first.isin(127, 172, 192), first - 100).otherwise(first)  # no private or loopback address for a public one
    return (
        F.when(group == "email", F.concat(_shape(local, s), F.lit("@"), made_host))
        .when(group == "ip", F.concat_ws(".", F.when(value.startswith("10.") | value.startswith("192.168."), "10").otherwise(public.cast("string")), octet(1), octet(2), octet(3)))
        .when(group == "ipv6", _address(value, s, attempt))
        .when(group == "ssn", F.concat(F.lit("9"), F.substring(number, 2, 8)))
        .when(group == "card", F.when(F.call_function("luhn_check", value), checked).otherwise(number))
        .when(group.isin("phone", "code"), number)
        .when(group == "iban", _iban(value, s))
        .when((group == "surname") | group.startswith("given_"), _invented(value, group, s, attempt))
        .otherwise(_shape(value, s))
    )


def _like(word: Column, made: Column) -> Column:
    """``made`` in the case of ``word``."""
    return F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(made)).otherwise(F.initcap(made))


def rendered(m: Column, known: Column) -> Column:
    """A match with its surrogates from the map ``known`` of entities, in the match's own format."""
    typed = F.struct(m.alias("m"), kind(m).alias("k"))
    owned = lambda x: F.struct(x["m"].alias("m"), x["k"].alias("k"), _keys(x["m"], x["k"]).alias("own"))
    first = lambda x: F.struct(x["m"].alias("m"), x["k"].alias("k"), x["own"].alias("own"), F.element_at(known, F.get(x["own"], F.lit(0))).alias("made"))
    return _bound(typed, lambda t: _bound(owned(t), lambda o: _bound(first(o), lambda x: _rendered(x["m"], x["k"], x["own"], x["made"], known))))


def _rendered(m: Column, k: Column, own: Column, made: Column, known: Column) -> Column:
    # all digits in order: country code, a 0 that isn't part of the number, the number
    code = F.when((k == "phone") & (F.size(own) > 1), F.element_at(known, F.get(own, F.lit(1)))).otherwise("")
    lost = F.length(_digits(m)) - F.length(made) - F.length(code)
    digits = F.concat(code, F.repeat(F.lit("0"), F.greatest(lost, F.lit(0))), made)

    def digit(x, i):
        c = F.substring(x["m"], i, F.lit(1))
        nth = F.length(_digits(F.substring(x["m"], F.lit(1), i)))
        return F.when(c.rlike("[0-9]"), F.substring(x["digits"], nth, F.lit(1))).otherwise(c)

    numeric = _bound(F.struct(m.alias("m"), digits.alias("digits")), lambda x: F.array_join(F.transform(F.sequence(F.lit(1), F.length(x["m"])), lambda i: digit(x, i)), ""))
    value = _secret_value(m)
    name = F.concat(_title(m), F.array_join(F.zip_with(_name_words(m), own, lambda w, key: F.when(key.isNull(), w).otherwise(_like(w, F.element_at(known, key)))), " "))
    grouped = F.when(m.contains(" "), F.trim(F.regexp_replace(made, "(.{4})", "$1 "))).otherwise(made)
    return (
        F.when(k == "name", name)
        .when(k == "secret", F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), F.when(_is_hex(value) & (F.upper(value) == value), F.upper(made)).otherwise(made)))
        .when(k.isin("card", "ssn", "phone"), numeric)
        .when(k == "iban", grouped)
        .when(k == "ipv6", _bound(_like_address(m, made), lambda a: F.when((F.upper(m) == m) & m.rlike("[A-F]"), F.upper(a)).otherwise(a)))
        .when((k == "email") & (F.upper(m) == m), F.upper(made))
        .otherwise(made)
    )


def matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


def mentions(found: Column, known: Column) -> Column:
    """(word, made) for the words of all names that were found, as they were written, in capitals, and capitalised: what is replaced in the rest of the text."""

    def words(m):
        pairs = F.filter(F.zip_with(_name_words(m), keys(m), lambda w, key: F.struct(w.alias("word"), key.alias("key"))), lambda p: p["key"].isNotNull())
        forms = lambda p: F.array(p["word"], F.upper(p["word"]), F.initcap(p["word"]))
        return F.flatten(F.transform(pairs, lambda p: F.transform(forms(p), lambda w: F.struct(w.alias("word"), _like(w, F.element_at(known, p["key"])).alias("made")))))

    return F.array_distinct(F.flatten(F.transform(F.filter(found, lambda m: kind(m) == "name"), words)))


def _without_mentions(piece: Column, told: Column) -> Column:
    word = lambda p: F.concat(F.lit(r"(?<![\p{L}\p{N}\-])"), p["word"], F.lit(r"(?![\p{L}\p{N}]|-\p{L})"))
    there = F.filter(told, lambda p: piece.contains(p["word"]))
    return F.when(F.size(told) > 0, F.aggregate(there, piece, lambda text, p: F.regexp_replace(text, word(p), p["made"]))).otherwise(piece)


def assigned(entities: DataFrame, secret: str) -> DataFrame:
    """key, made: distinct surrogates for the distinct column ``key`` of entities.

    A surrogate is taken by the first of its claimants (settled ones before others, then by key); it may not be an entity itself (a country code: not its own). The others go on to the next attempt.
    Assigned country codes have theirs from ``country_codes``.
    A type that has fewer surrogates than entities (some 16 million private addresses, a hundred million social security numbers) is an error after ``ATTEMPTS`` attempts.
    """
    spark = entities.sparkSession
    # names clash with names of any kind, everything else within its type; case and spelling are normal forms already
    field = F.regexp_replace(F.substring_index("key", "|", 1), "^(surname|given_.)$", "name")
    own = F.regexp_replace("key", r"^[^|]*\|", "")
    real = entities.select(field.alias("field"), own.alias("made")).where("field <> 'code'").distinct()
    blocks = F.broadcast(key_table(spark, secret))  # a row for each of ``GROUPS``
    codes = F.broadcast(spark.createDataFrame([(f"code|{c}", made) for c, made in country_codes(secret).items()], "key string, made string"))
    done = entities.select("key").join(codes, "key").select("key", F.lit("code").alias("field"), "made")
    open_keys = entities.select("key").join(codes, "key", "left_anti")
    for attempt in range(ATTEMPTS):
        # a surrogate costs more than its bytes tell, so the number of tasks is that of entities, and Spark doesn't merge them
        tasks = min(10_000, open_keys.count() // TASK_ENTITIES + 1)
        keyed = open_keys.repartition(tasks).withColumn("group", F.substring_index("key", "|", 1)).join(blocks, "group")
        tried = keyed.select("key", field.alias("field"), surrogate(F.col("inner"), F.col("outer"), F.col("key"), F.lit(attempt)).alias("made"))
        first = F.row_number().over(Window.partitionBy("field", "made").orderBy("key")) == 1
        free = tried.withColumn("first", first & ((F.col("field") != "code") | (F.col("made") != own))).join(real.withColumn("taken", F.lit(True)), ["field", "made"], "left")
        free = free.join(done.select("field", "made", F.lit(True).alias("held")), ["field", "made"], "left")
        round_ = stored(free.select("key", "field", "made", (F.col("first") & F.col("taken").isNull() & F.col("held").isNull()).alias("good")), "surrogates")
        settled = round_.where("good").select("key", "field", "made")
        done = done.unionAll(settled)
        open_keys = round_.where(~F.col("good")).select("key")
        if open_keys.isEmpty():
            return done.select("key", "made")
    raise ValueError(f"some entities have no surrogate after {ATTEMPTS} attempts")


def same_names(entities: DataFrame) -> DataFrame:
    """key, to: given names of no told gender ('Dr. Anna ...') that the corpus tells one gender of ('Mrs. Anna ...') are that name. Where it tells both, a text may still tell one (``_told_in_text``)."""
    word = F.regexp_replace("key", r"^[^|]*\|", "").alias("word")
    told = entities.where("key LIKE 'given_m|%' OR key LIKE 'given_f|%'").groupBy(word).agg(F.min("key").alias("to"), F.count("*").alias("genders")).where("genders = 1")
    return entities.where("key LIKE 'given_x|%'").select("key", word).join(told, "word").select("key", "to")


def _told_in_text(known: Column) -> Column:
    """A text's map of entities, in which a given name of no told gender is that of the gender which the text tells elsewhere, if it tells one."""

    def one(key, made):
        word = F.substring(key, F.lit(len("given_x|") + 1), F.length(key))
        m, f = (F.try_element_at(known, F.concat(F.lit(f"given_{g}|"), word)) for g in "mf")
        told = F.when(f.isNull(), m).when(m.isNull(), f)
        return F.when(key.startswith("given_x|"), F.coalesce(told, made)).otherwise(made)

    return F.transform_values(known, one)


def with_surrogates(docs: DataFrame, secret: str, count: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, with the entities in ``text`` replaced; ``count`` names a column for their number (mentions without a title not counted).

    Texts without entities, null and empty ones are unchanged. Equal texts get equal results, repeated rows stay. An empty table stays empty.
    Only texts with a hint of entities are shuffled, by their digest; the largest keys of that join Spark can split.
    """
    kept = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    some, none = kept.where(hinted), kept.where(~hinted)
    digest = F.sha2("text", 256)
    found = some.select(digest.alias("digest"), matches(F.col("text")).alias("found")).where(F.size("found") > 0)
    found = stored(found.groupBy("digest").agg(F.first("found").alias("found")), "found")
    uses = found.select("digest", F.explode(F.array_compact(F.array_distinct(F.flatten(F.transform("found", keys))))).alias("key"))
    entities = stored(uses.select("key").distinct(), "entities")
    same = stored(same_names(entities), "same")
    known = assigned(entities.join(same, "key", "left_anti"), secret)
    known = known.unionByName(same.join(known.withColumnRenamed("key", "to"), "to").select("key", "made"))
    maps = uses.join(known, "key").groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("key", "made"))).alias("known")).withColumn("known", _told_in_text(F.col("known"))).join(found, "digest")
    pieces, n = F.split("text", ENTITY, -1), F.size("found")

    def rest(x):
        # names that are nowhere else in the text needn't be looked for piece by piece
        return _bound(F.array_join(x["pieces"], "\n"), lambda text: F.filter(mentions(F.col("found"), F.col("known")), lambda p: text.contains(p["word"])))

    def told(x):
        parts = F.zip_with(F.slice(x["pieces"], F.lit(1), n), F.col("found"), lambda p, m: F.concat(_without_mentions(p, x["told"]), rendered(m, F.col("known"))))
        return F.concat(F.array_join(parts, ""), _without_mentions(F.element_at(x["pieces"], -1), x["told"]))

    replaced = F.when(n > 0, _bound(_bound(F.struct(pieces.alias("pieces")), lambda x: F.struct(x["pieces"].alias("pieces"), rest(x).alias("told"))), told)).otherwise(F.col("text"))
    names = docs.columns

    def out(df: DataFrame, text: Column, found: Column) -> DataFrame:
        more = [F.greatest(found, F.lit(0)).cast("long").alias(count)] if count else []
        return df.select(*(text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in names), *more)

    return out(some.withColumn("digest", digest).join(maps, "digest", "left"), replaced, F.coalesce(n, F.lit(0))).unionAll(out(none, F.col("text"), F.lit(0)))
