import hashlib
import hmac
import ipaddress
import re
import time

import pytest
import regex
from tests.llm.helpers import empty, odd_rows, prose, rng, table
from voxlake.llm import pii

CASES = [
    "Mail Jo.81@Mail7.example.com or jo.81@mail7.example.com, else JO.81@MAIL7.EXAMPLE.COM",
    "call +1 (124) 555-4766 or 124-555-4766 or 124.555.4766!",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and 24be64439e3e49cf46b2d7c90f3602a3d0b907ff, 24BE64439E3E49CF46B2D7C90F3602A3D0B907FF',
    "ip 152.143.123.131### and 10.1.2.3.",
    "card 4111 1111 1111 1111, 4111-1111-1111-1111 and 4785380592391139$$$",
    "Dear Mr. John Smith and Mrs Smith, Frau Müller-Meier, DR SMITH and Господин Иванов",
    "ssn 123-45-6789 iban DE89 3704 0044 0532 0130 00, DE89370400440532013000",
    "+1 (843) 555-7672 127.52.15.62 and +1 (843) 555-7672 4785380592391139",
]
CLEAN = ["Version 2.0 of 2024-01-02, 10:20. Licensed under the Apache License.", "3.14 and 1,000,000 or 12345", "", None]


@pytest.fixture(scope="module")
def replaced(spark):
    rows = list(enumerate(CASES + CLEAN))
    return {r.doc_id: r for r in pii.with_surrogates(table(spark, rows), "k", "entities").collect()}


def test_formats_and_coreference(replaced):
    out = [replaced[i].text for i in range(len(CASES))]
    a, b, c = re.findall(r"\S+@[\w.]+\w", out[0])
    assert a == b == c.lower() and c == c.upper() and a.endswith(".example") and re.match(r"[a-z]{2}\.\d\d@", a)
    one, two, three = re.search(r"\+[2-9] \((\d{3})\) (\d{3})-(\d{4}) or (\d{3}-\d{3}-\d{4}) or (\d{3}\.\d{3}\.\d{4})!$", out[1]).group(0), *re.findall(r" (\d{3}[-.]\d{3}[-.]\d{4})", out[1])
    assert len({re.sub(r"\D", "", x)[-10:] for x in (two, three)}) == 1 and "124" not in two[:3]
    assert len(set(re.findall(r"[0-9a-f]{40}", out[2]))) == 1 == len(set(re.findall(r"[0-9a-f]{40}", out[2].lower()))) and "24be" not in out[2].lower()
    beside = replaced[len(CASES) - 1].text
    assert "(843)" not in beside and "127.52" not in beside and "4785380592391139" not in beside
    assert out[3].count(".") == CASES[3].count(".") and " 10." in out[3] and "152.143" not in out[3]
    x, y = re.search(r"card (\d{4} \d{4} \d{4} \d{4}), (\d{4}-\d{4}-\d{4}-\d{4}) and \d{16}\$\$\$", out[4]).groups()
    assert x.replace(" ", "") == y.replace("-", "") and luhn(x.replace(" ", ""))
    he, she, mr, dr = re.search(r"Mr\. (\w+ \w+) and Mrs (\w+), Frau (\w+), DR (\w+) and", out[5]).groups()
    assert he.split()[1] == she == dr.title() and dr == dr.upper() and he.split()[0].endswith("n")
    assert re.search(r"Господин [А-Яа-я]+$", out[5]) and "Иванов" not in out[5] and "Smith" not in out[5]
    assert re.match(r"ssn 9\d\d-\d\d-\d{4} iban DE\d\d \d{4} ", out[6]) and len(out[6]) == len(CASES[6])
    first, second = out[6].split("iban ")[1].split(", ")
    assert first.replace(" ", "") == second


def luhn(digits):
    total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def test_clean_texts_stay(replaced):
    for i, text in enumerate(CLEAN, len(CASES)):
        assert (replaced[i].text, replaced[i].entities) == (text, 0)


def test_surrogates_are_distinct_and_new(spark, monkeypatch):
    # seven-digit-like domain: so few addresses that attempts clash
    keys = spark.range(3000).selectExpr("concat('surname|', lower(conv(id, 10, 36))) as key")
    monkeypatch.setitem(pii.SYLLABLES, "latin", ("bd", "ae"))
    got = pii.assigned(keys, "k").collect()
    assert len(got) == 3000 and len({r.made for r in got}) == 3000
    assert not {r.made for r in got} & {r.key.split("|")[1] for r in got}


def test_another_key_gives_others(spark, replaced):
    other = pii.with_surrogates(table(spark, list(enumerate(CASES))), "another").collect()
    assert all(r.text != replaced[r.doc_id].text for r in other)


def test_odd_rows_repeated_rows_and_columns(spark):
    r = rng(2)
    rows = odd_rows(r) + [(50, CASES[0]), (50, CASES[0]), (None, CASES[1]), (51, prose(r, 3000) + " " + CASES[4])]
    df = table(spark, rows)
    out = pii.with_surrogates(df, "k")
    assert out.columns == df.columns and out.count() == len(rows)
    by = {}
    for x in out.collect():
        by.setdefault(x.doc_id, []).append(x.text)
    assert by[50][0] == by[50][1] != CASES[0]
    plain = {i: t for i, t in rows if i is not None and i < 50}
    assert all(by[i] == [plain[i]] * len(by[i]) for i in plain)
    assert pii.with_surrogates(empty(spark), "k").isEmpty()


def test_no_python_on_the_main_path(spark):
    text = pii.with_surrogates(table(spark, [(1, CASES[0])]), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_entities_are_taken_to_their_end(spark):
    r = rng(9)
    token = "".join(r.choices("ABCDEFabcdefghijkXYZ0123456789_-", k=400))
    key = "".join(r.choices("0123456789abcdef", k=128))
    rows = [
        (0, f"token={token} end"),
        (1, f"key {key} end"),
        (2, "Frau Anna Maria Luise Schmidt kam, Frau Schmidt ging"),
        (3, "1234567890123" + "ab" * 42 + "c end"),
        (4, "x" * 100 + "@" + ".".join(["mail"] * 12) + " end"),
        (5, "Mr " + "A" + "b" * 90 + " end"),
        (6, "token=" + "q" * 50_000 + " end"),
    ]
    out = {x.doc_id: x.text for x in pii.with_surrogates(table(spark, rows), "k").collect()}
    made = re.fullmatch(r"token=([\w\-]{400}) end", out[0]).group(1)
    assert not any(made[i : i + 12] == token[i : i + 12] for i in range(389))
    assert len({made[i : i + 32] for i in range(0, 384, 32)}) == 12
    hexed = re.fullmatch(r"key ([0-9a-f]{128}) end", out[1]).group(1)
    assert not any(hexed[i : i + 12] == key[i : i + 12] for i in range(117))
    full, short = re.fullmatch(r"Frau ((?:\w+ ){4})kam, Frau (\w+) ging", out[2]).groups()
    assert full.split()[-1] == short and not set(full.split()) & set("Anna Maria Luise Schmidt".split())
    assert "1234567890123" not in out[3] and "abababab" not in out[3]
    assert "mail" not in out[4] and "xxxx" not in out[4] and out[4].endswith(".example end")
    assert "bbbb" not in out[5]
    # letters drawn by a stream that goes on: no period of the first 128 numbers
    long = out[6][6:-4]
    assert len(long) == 50_000 and long[:128] != long[128:256] and long.count("q") < 5000


PHONES = [
    ["+33 6 12 34 56 78", "06 12 34 56 78", "06.12.34.56.78", "06-12-34-56-78", "+33 (0)6 12 34 56 78", "+33612345678"],
    ["+49 30 901820", "+49 (0)30 901820", "030 901820", "030/901820", "(030) 901820"],
    ["+49 171 12345678", "0171 12345678", "0171-12345678"],
    ["+34 612 34 56 78", "612 34 56 78", "+34 612 345 678"],
    ["+1 (124) 555-4766", "124-555-4766", "+11245554766"],
]
NO_PHONES = ["am 01.02.2024 um 10:20, le 06/12/2024, 2024-06-12 10:20:30", "1 234 567 euros, 12 34 56, 3.030 90182, 0.12 34567 et 1.06 12", "Seiten 030 bis 901820, de 612 a 678, art. 12 34"]


def test_phones_of_all_languages(spark):
    rows = [(i, " ; ".join(same)) for i, same in enumerate(PHONES)] + [(10 + i, t) for i, t in enumerate(NO_PHONES)]
    out = {x.doc_id: (x.text, x.n) for x in pii.with_surrogates(table(spark, rows).select("doc_id", "text"), "k", "n").collect()}
    for i, same in enumerate(PHONES):
        text, n = out[i]
        made = text.split(" ; ")
        assert n == len(same), (same, text)
        assert [re.sub(r"\d", "9", x) for x in made] == [re.sub(r"\d", "9", x) for x in same]
        # all spellings of one number get one surrogate
        size = min(len(re.sub(r"\D", "", x).lstrip("0")) for x in same)
        assert len({re.sub(r"\D", "", x)[-size:] for x in made}) == 1 and re.sub(r"\D", "", made[0])[-size:] != re.sub(r"\D", "", same[0])[-size:]
    for i, t in enumerate(NO_PHONES):
        assert out[10 + i] == (t, 0)


def run(spark, texts):
    return [r.text for r in sorted(pii.with_surrogates(table(spark, list(enumerate(texts))), "k").collect(), key=lambda r: r.doc_id)]


def test_mentions_without_a_title(spark):
    texts = [
        "Mr. John Smith came. Later John Smith said hi, and Smith left. JOHN SMITH's hat; Johnson, Smithers and Blacksmith stay.",
        "Prof. Dr. Anna von der Mühlen und Frau Dr. Meier. Die Mühlen war da, Anna auch, Anna-Lena und Obermeier nicht; Meiers Hut.",
        "Sra. García y M. Dupont: García habló, Dupont partit. Mrs Smith's car. Don't, Sir, M Dupont",
        "Dr House Music And The Rest, Mr. J. O'Brien Of Cork; O'Brien",
    ]
    out = run(spark, texts)
    assert not any(x in out[0] for x in ("John ", "JOHN", "Smith ", "SMITH")) and all(x in out[0] for x in ("Johnson", "Smithers", "Blacksmith"))
    full, given, sur = re.match(r"Mr\. ((\w+) (\w+)) came\.", out[0]).groups()
    assert f"Later {full} said hi, and {sur} left. {full.upper()}'s hat" in out[0] and given.endswith("n")
    a, b, c = re.match(r"Prof\. Dr\. (\w+) von der (\w+) und Frau Dr\. (\w+)\. ", out[1]).groups()
    assert out[1].endswith(f"Die {b} war da, {a} auch, Anna-Lena und Obermeier nicht; Meiers Hut.") and len({a, b, c, "Anna", "Mühlen", "Meier"}) == 6
    g, d, s = re.match(r"Sra\. (\w+) y M\. (\w+): \1 habló, \2 partit\. Mrs (\w+)'s car", out[2]).groups()
    assert s == sur and out[2].endswith(f"Don't, Sir, M {d}")
    assert re.match(r"Dr (?!House)\w+ (?!Music)\w+ And The Rest, Mr\. J\. (\w+) Of Cork; \1$", out[3])


def test_distinct_numbers_and_no_kept_digits(spark):
    texts = ["+1 (124) 555-4766", "+44 (124) 555-4766", "124-555-4766", "+441234567890123", "+49 (0)30 901820", "030/1234567", "call 5551234567, 5551234567 rows", "2024 1000 2000 rows and 123 4567 8901 of an order"]
    out = run(spark, texts)
    shape = lambda x: re.sub(r"\d", "9", x)
    assert [shape(x) for x in out] == [shape(x) for x in texts]
    digits = [re.sub(r"\D", "", x) for x in out]
    assert digits[0] != digits[1] and len(set(digits[:2])) == 2 and digits[0][1:] == digits[1][2:] == digits[2]  # the same number, in two countries and in none
    assert not any(a.startswith(b) for a, b in ((out[0], "+1 "), (out[1], "+44"), (out[3], "+44"), (out[4], "+49")))
    assert "(0)" in out[4] and digits[3][2:] != "1234567890123" and not re.search(r"67890123$", out[3])
    assert out[5].startswith("0") and out[5] != texts[5] and out[6].split(", ")[1] == "5551234567 rows" and "call 555123" not in out[6]
    assert out[7] == texts[7]


def mod97(iban):
    iban = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_check_digits_scripts_and_addresses(spark):
    texts = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR00 1234 5678 9012 3456 7890 123", "иван@почта.рф", "Ωmega.Ελ@mail.gr", "fe80::1ff:fe23:4567:890a und 2001:db8:0:0:8A2E:370:7334:1, um 10:20:30, a::b, std::x1", "名前5@例え.jp"]
    out = run(spark, texts)
    assert mod97(out[0]) == mod97(out[1]) == 1 and out[0] != texts[0] and out[0][:2] == "DE" and out[1][:2] == "GB" and mod97(texts[2]) != 1 and len(out[2]) == len(texts[2])
    assert re.fullmatch(r"[а-я]{4}@[а-я]{5}\.example", out[3]) and out[3][:4] != "иван"
    assert re.fullmatch(r"\w+\.\w+@[a-z]{4}\.example", out[4]) and re.fullmatch(r"[Α-Ω][a-z]{4}\.[Α-Ω][α-ω]", out[4].split("@")[0], re.I)
    one, two = re.match(r"(\S+) und ([^,]+), um 10:20:30, a::b, std::x1$", out[5]).groups()
    assert re.fullmatch(r"[0-9a-f]{4}::[0-9a-f]{3}:[0-9a-f]{4}:[0-9a-f]{4}:[0-9a-f]{4}", one) and one not in texts[5] and two not in texts[5] and two.count(":") == 7
    assert re.fullmatch(r"[一-鿿]{2}\d@[぀-鿿]{2}\.example", out[6])


def test_the_key_is_in_no_plan(spark):
    df = pii.with_surrogates(table(spark, [(1, CASES[0])]), "a-very-secret-key")
    pii.assigned(spark.range(3).selectExpr("concat('email|a', id, '@b.c') as key"), "a-very-secret-key")
    keys = [bytes(r.inner).hex() for r in pii.key_table(spark, "a-very-secret-key").collect()]
    e = spark.range(3).selectExpr("concat('email|a', id, '@b.c') as key", "'email' as group").join(pii.key_table(spark, "a-very-secret-key"), "group")
    e = e.select(pii.surrogate(e["inner"], e["outer"], e["key"], pii.F.lit(0)))
    for frame in (df, e):
        for level in ("simple", "extended", "formatted", "codegen"):
            text = spark._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), level)
            assert "a-very-secret-key" not in text and not any(k in text or k.upper() in text for k in keys)


def test_surrogates_are_made_in_many_tasks(spark):
    """The keys are few bytes, and Spark would make one partition of them."""
    keys = spark.range(5000).selectExpr("concat('ssn|', lpad(id, 9, '0')) as key")
    assert pii.assigned(keys, "k").count() == 5000
    keyed = keys.repartition(5000 // pii.TASK_ENTITIES + 1)
    assert "REPARTITION_BY_NUM" in keyed._jdf.queryExecution().executedPlan().toString()


# --- the plain version


class Plain:
    """Detection by the same patterns; keys, surrogates, clashes and rendering once more, in plain Python."""

    def __init__(self, secret):
        self.secret = secret
        self.entity = regex.compile(re.sub(r"\\d", "[0-9]", re.sub(r"\[([^\]]*)\\d", r"[\g<1>0-9", pii.ENTITY)).replace(r"\s", r"[ \t\n\x0b\f\r]"))
        self.title = regex.compile("^" + pii._TITLE + "++")

    def kind(self, m):
        n = sum(c in "0123456789" for c in m)
        if "@" in m:
            return "email"
        if re.fullmatch(r"[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4}){2,7}", m):
            return "ipv6"
        if self.title.match(m):
            return "name"
        if "=" in m or ":" in m or re.fullmatch("[0-9a-fA-F]{32,}", m):
            return "secret"
        if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", m):
            return "ip"
        if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", m):
            return "ssn"
        if re.match("[A-Z]{2}[0-9]{2}", m):
            return "iban"
        return "card" if n >= 13 and m[0] != "+" else "phone"

    @staticmethod
    def value(m):
        return re.match(r"(?:[A-Za-z_\-]+[\"']?\s*[=:]\s*[\"']?)?(.*)$", m).group(1)

    @staticmethod
    def is_hex(v):
        return bool(re.fullmatch("[0-9a-f]{16,}|[0-9A-F]{16,}", v) and re.search("[a-fA-F]", v))

    def names(self, m):
        title = self.title.match(m).group(0)
        told = title.replace(".", "").split()
        gender = "f" if set(told) & set(pii.FEMALE) else "m" if set(told) & set(pii.MALE) else "x"
        words = m[len(title) :].split(" ")
        return title, words, [None if not (len(w) > 1 and w[0].isupper() and w[-1].isalpha()) else (f"given_{gender}" if i < len(words) - 1 else "surname", w.lower()) for i, w in enumerate(words)]

    def keys(self, m):
        k, digits = self.kind(m), re.sub("[^0-9]", "", m)
        if k == "name":
            return self.names(m)[2]
        if k == "phone":
            code = re.match(pii._COUNTRY, m)
            rest = re.sub("[^0-9]", "", m[code.end() :] if code else m)
            return [("phone", rest[1:] if rest[:1] == "0" else rest)] + ([("code", code.group(1))] if code else [])
        if k == "secret":
            return [(k, self.value(m).lower() if self.is_hex(self.value(m)) else self.value(m))]
        if k == "ipv6":
            return [(k, ":".join(g.lstrip("0") or "0" for g in self.groups(m.lower())))]
        return [(k, m.lower() if k == "email" else digits if k in ("ssn", "card") else m.replace(" ", ""))]

    @staticmethod
    def groups(m):
        head, _, tail = m.partition("::")
        head, tail = [x.split(":") if x else [] for x in (head, tail)]
        return head + [""] * (8 - len(head) - len(tail)) + tail

    def stream(self, group, value, attempt):
        key = hmac.new(self.secret.encode(), group.encode(), hashlib.sha256).digest()
        return "".join(hmac.new(key, f"{i}|{attempt}|{group}|{value}".encode(), hashlib.sha256).hexdigest() for i in range(4))

    @staticmethod
    def numbers(stream):
        return bytes.fromhex(stream)

    def shape(self, value, stream, hexed=None):
        hexed = self.is_hex(value) if hexed is None else hexed
        out = ""
        for i, c in enumerate(value):
            b = i // 32
            block = stream[b * 64 : b * 64 + 64] if b < 4 else hashlib.sha256(f"{stream}|{b}".encode()).hexdigest()
            n = self.numbers(block)[i % 32]
            script = next((x for x in pii.ALPHABETS if regex.match(x, c)), None)
            if hexed and re.match("[0-9a-fA-F]", c):
                out += "%x" % (n % 16)
            elif re.match("[0-9]", c):
                out += str(n % 10)
            elif script and regex.match(r"\p{L}", c):
                letters = pii.ALPHABETS[script][bool(regex.match(r"\p{Lu}", c))]
                out += letters[n % len(letters)]
            elif regex.match(r"\p{L}", c):
                out += chr(n % 26 + (65 if regex.match(r"\p{Lu}", c) else 97))
            else:
                out += c
        return out

    def made(self, group, value, attempt):
        s = self.stream(group, value, attempt)
        n = self.numbers(s)
        number = "".join(str(n[i % 128] % 9 + 1 if i == 0 else n[i % 128] % 10) for i in range(max(1, len(value))))
        if group == "email":
            local, host = value.split("@")[0], value.split("@")[-1]
            return self.shape(local, s) + "@" + self.shape(host.split(".")[0], s[::-1]) + ("." + s[100:104] if host.count(".") > 1 else "") + ".example"
        if group == "ip":
            first = n[0] % 200 + 11
            return ".".join(map(str, ["10" if value.startswith(("10.", "192.168.")) else first - 100 if first in (127, 172, 192) else first, n[1], n[2], n[3]]))
        if group == "ipv6":
            width = lambda g: min(len(g) + attempt // 8, 4)
            return ":".join(g if g == "0" else "".join("%x" % (n[(4 * i + k) % 128] % 15 + 1 if k == 0 else n[(4 * i + k) % 128] % 16) for k in range(width(g))) for i, g in enumerate(value.split(":")))
        if group == "ssn":
            return "9" + number[1:9]
        if group == "card":
            return next(number[:-1] + d for d in "0123456789" if luhn(number[:-1] + d)) if luhn(value) else number
        if group in ("phone", "code"):
            return number
        if group == "iban":
            body = self.shape(value[4:], s)
            return value[:2] + (f"{98 - mod97(value[:2] + '00' + body):02}" if mod97(value) == 1 else f"{n[126] % 10}{n[127] % 10}") + body
        if group == "surname" or group.startswith("given_"):
            script = next((x for x in ("cyrillic", "greek", "latin") if regex.search(rf"\p{{Is{x}}}" if x != "latin" else r"\p{Latin}", value)), None)
            if script is None:
                size = max(len(value), attempt + 4)
                return self.shape((value * size)[:size], s)
            a, b = pii.SYLLABLES[script]
            return "".join(a[n[2 * i] % len(a)] + b[n[2 * i + 1] % len(b)] for i in range(attempt + 4)) + (pii.ENDINGS[script][group[-1]] if group != "surname" else "")
        return self.shape(value, s)

    def assign(self, entities):
        field = lambda e: "name" if e[0] == "surname" or e[0].startswith("given_") else e[0]
        real = {(field(e), e[1]) for e in entities if e[0] != "code"}
        codes = pii.country_codes(self.secret)
        known = {e: codes[e[1]] for e in entities if e[0] == "code" and e[1] in codes}
        held, left = {("code", made) for made in known.values()}, sorted(entities - set(known), key="|".join)
        attempt = 0
        while left:
            claims = {}
            for e in left:
                claims.setdefault((field(e), self.made(*e, attempt)), e)
            fresh = {c: e for c, e in claims.items() if c not in real and c not in held and not (e[0] == "code" and c[1] == e[1])}
            known |= {e: c[1] for c, e in fresh.items()}
            held |= set(fresh)
            left, attempt = [e for e in left if e not in known], attempt + 1
        return known

    @staticmethod
    def like(word, made):
        return made.upper() if word.upper() == word and len(word) > 1 else made[:1].upper() + made[1:].lower()

    def render(self, m, known):
        k, own = self.kind(m), self.keys(m)
        if k == "name":
            title, words, keys = self.names(m)
            return title + " ".join(w if key is None else self.like(w, known[key]) for w, key in zip(words, keys, strict=True))
        made = known[own[0]]
        if k == "secret":
            v = self.value(m)
            return m[: len(m) - len(v)] + (made.upper() if self.is_hex(v) and v.upper() == v else made)
        if k in ("card", "ssn", "phone"):
            code = known[own[1]] if len(own) > 1 else ""
            digits = iter(code + "0" * (len(re.sub("[^0-9]", "", m)) - len(made) - len(code)) + made)
            return re.sub("[0-9]", lambda _: next(digits), m)
        if k == "iban":
            return re.sub("(.{4})", r"\1 ", made).strip() if " " in m else made
        if k == "ipv6":
            made = ":".join("" if g == "" else new.rjust(len(g), "0") for g, new in zip(self.groups(m), made.split(":"), strict=True))
            made = re.sub(":{2,}", "::", made)
            return made.upper() if m.upper() == m and re.search("[A-F]", m) else made
        return made.upper() if k == "email" and m.upper() == m else made

    def replace(self, texts):
        found = [[m.group(0) for m in self.entity.finditer(t or "")] for t in texts]
        entities = {e for own in found for m in own for e in self.keys(m) if e}
        only = lambda word, there: [("given_" + g, word) for g in "mf" if ("given_" + g, word) in there]
        same = {e: only(e[1], entities)[0] for e in entities if e[0] == "given_x" and len(only(e[1], entities)) == 1}
        every = self.assign(entities - set(same))
        every |= {e: every[to] for e, to in same.items()}
        out = []
        for text, own in zip(texts, found, strict=True):
            if not own:
                out.append(text)
                continue
            here = {e for m in own for e in self.keys(m) if e}
            known = dict(every) | {e: every[only(e[1], here)[0]] for e in here if e[0] == "given_x" and len(only(e[1], here)) == 1}
            told = {}
            for m in own:
                if self.kind(m) == "name":
                    for w, key in zip(*self.names(m)[1:], strict=True):
                        for form in (w, w.upper(), w[:1].upper() + w[1:].lower()) if key else ():
                            told.setdefault(form, self.like(form, known[key]))
            pieces, at = [], 0
            for m in [*self.entity.finditer(text), None]:
                piece = text[at : m.start() if m else len(text)]
                for w, made in told.items():
                    piece = regex.sub(rf"(?<![\p{{L}}\p{{N}}\-]){regex.escape(w)}(?![\p{{L}}\p{{N}}]|-\p{{L}})", made, piece)
                pieces.append(piece)
                if m:
                    pieces.append(self.render(m.group(0), known))
                    at = m.end()
            out.append("".join(pieces))
        return out


def random_texts():
    r = rng(31)
    d = lambda n: "".join(r.choices("0123456789", k=n))
    name = lambda: r.choice(["Anna", "John", "Smith", "Müller", "García", "O'Brien", "Иванов", "Νίκος", "Smith-Jones", "SMITH", "von Berg", "de la Cruz", "J. Doe", "Արամ"])
    make = [
        lambda: f"{r.choice(pii.MALE + pii.FEMALE + pii.EITHER)}{r.choice(['', '.'])} {' '.join(name() for _ in range(r.randint(1, 3)))}",
        name,
        lambda: f"{r.choice(['jo', 'A.b', 'иван', 'x_1'])}.{d(1)}@{r.choice(['mail', 'почта', 'Web-1'])}.{r.choice(['de', 'рф', 'co.uk'])}",
        lambda: f"+{r.choice(['1', '33', '44', '49', '351', '7'])} {r.choice(['', '(0)'])}({d(3)}) {d(3)}-{d(4)}",
        lambda: f"{r.choice(['tel. ', 'call ', 'no '])}{d(9)}",
        lambda: f"0{r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}",
        lambda: f"0{r.randint(10, 99)}/{d(6)}",
        lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        lambda: r.choice(["10.", "192.168."]) + ".".join(str(r.randint(0, 9)) for _ in range(2)),
        lambda: ":".join("%x" % r.randrange(65536) for _ in range(8)),
        lambda: f"fe80::{d(2)}:{d(3)}",
        lambda: r.choice(["2001:db8::1", "2001:0DB8:0:0:0:0:0:1", "2001:db8:0000::0001", "2001:DB8::A:1", "1:0:0:2::3", "1::2:0:3"]),
        lambda: f"{d(3)}-{d(2)}-{d(4)}",
        lambda: r.choice(["4111 1111 1111 1111", d(16), f"{d(4)}-{d(4)}-{d(4)}-{d(4)}"]),
        lambda: r.choice(["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", f"FR{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(4)} {d(3)}"]),
        lambda: f"{r.choice(['token', 'API_KEY', 'password'])}{r.choice([' = ', ':', '=\"'])}{''.join(r.choices('abcXYZ019_-', k=r.randint(6, 150)))}",
        lambda: "".join(r.choices("0123456789abcdef", k=r.choice([20, 32, 40, 200]))),
        lambda: prose(r, r.randint(1, 6)),
        lambda: r.choice(["2024-01-02", "10:20:30", "3.14", "Version 2.0", "12 34 56", "The", "And", "DE", "a::b", "+5", "(1)", "İ", "漢字"]),
    ]
    return ["".join(r.choice(make)() + r.choice([" ", ", ", ". ", " (", ")", "\n", ""]) for _ in range(r.randint(1, 12))) for _ in range(700)]


def test_equals_the_plain_version(spark):
    texts = random_texts()
    got = run(spark, texts)
    want = Plain("k").replace(texts)
    wrong = [(t, a, b) for t, a, b in zip(texts, got, want, strict=True) if a != b]
    assert not wrong, wrong[:3]
    assert sum(a != b for a, b in zip(texts, want, strict=True)) > 500


def test_a_neutral_title_is_the_same_person(spark):
    got = run(spark, ["Dr. John Smith met Mr. John Smith", "Prof. Anna Weber. Frau Anna Weber", "Dr. John Doe", "Dr. Kim Lee and Mrs. Kim Lee", "Mr. Kim Park", "Dr. Kim Ode"])
    names = [re.findall(r"(?:Dr|Mr|Mrs|Prof|Frau)\.? (\w+)", t) for t in got]
    assert names[0][0] == names[0][1] == names[2][0] and names[0][0].endswith("n")
    assert names[1][0] == names[1][1] and names[1][0].endswith("a")
    # the corpus tells both genders of Kim: a text's own title counts, and without one the name stays neutral
    assert names[3][0] == names[3][1] and names[3][0].endswith("a") and names[4][0].endswith("n") and names[5][0].endswith("e")


def test_spellings_of_an_address_agree(spark):
    got = run(spark, ["at 2001:db8::1 or", "at 2001:db8:0:0:0:0:0:1 or", "at 2001:0DB8::0001 or", "at 2001:db8::2 or"])
    own = [t.split(" ")[1] for t in got]
    assert re.fullmatch("[0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]", own[0]) and own[0] != "2001:db8::1"
    same = {str(ipaddress.ip_address(x)) for x in own[:3]}
    assert len(same) == 1 and same != {"2001:db8::1"} and re.fullmatch("[0-9A-F]{4}:0[0-9A-F]{3}::000[0-9A-F]", own[2])
    assert str(ipaddress.ip_address(own[3])) not in same


def test_country_codes_are_assigned_ones(spark):
    codes = pii.country_codes("k")
    assert sorted(codes) == sorted(codes.values()) and all(len(a) == len(b) and a != b for a, b in codes.items()) and len(codes) > 200
    assert all(re.match(pii._COUNTRY, f"+{c}").group(1) == c for c in codes)
    texts = [f"+{c} 555 123 4567" for c in pii.ONE_DIGIT + pii.TWO_DIGITS]
    got = [re.match(pii._COUNTRY, t).group(1) for t in run(spark, texts)]
    assert len(set(got)) == len(texts) and all(a != b[1:].split(" ")[0] for a, b in zip(got, texts, strict=True))


def test_very_many_names_in_a_text(spark):
    r = rng(5)
    names = list({"".join(r.choices("abcdefghij", k=7)).capitalize() for _ in range(3000)})
    text = ". ".join(f"Mr. {n} came" for n in names) + ". " + " and ".join(names[:200])
    began = time.perf_counter()
    (got,) = run(spark, [text])
    assert time.perf_counter() - began < 120
    left = set(re.findall(r"\w+", got))
    assert not left & set(names) and got.count("Mr. ") == len(names) and len(got.split(" and ")) == 200
