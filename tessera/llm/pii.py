"""Surrogates for personal data, with DataFrame and SQL functions alone.

Entities are found by one regular expression, whose groups tell their kinds. A surrogate is a keyed
permutation of its entity within the entities of the same kind and format, so the same entity has the
same surrogate everywhere (coreference), different entities have different ones (distinctness), and
nothing has to be looked up: no table of entities, no Python.

* Letters and digits are enciphered by a Feistel network whose round function is SHA-256 under the key:
  digits to digits, letters to letters of the same case and script and, in names, to vowels or consonants.
  The cipher C is applied as C'(S(C(x))), S being a shift of every character in its class and C' the
  inverse of C. S moves every text, and so does this: no surrogate equals its entity.
* Phone, card and account numbers are enciphered as digit sequences, so another way of writing them
  leads to the same digits. A card keeps its first digit and passes the Luhn test if the original did.
* An address of the fourth version of the Internet protocol is enciphered as a number; a public one
  stays public, another one keeps its first part.
* A known given name becomes another of the same gender and script: the next one in an order of the
  list under the key. Endings of surnames that tell a gender stay.
* :func:`replace_entities` checks the distinct entities of the whole table for collisions, and takes a
  further key if it finds any. Kinds that collide under all keys get a digest of the entity behind the
  surrogate, so no entity ends a job, and none stays.
"""

from __future__ import annotations

import hashlib
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh

DEFAULT_KEY = "surrogate-key-1"
ROUNDS = 4
#: Keys that are tried, one after the other, while surrogates collide.
ATTEMPTS = 3

# Alphabets, and given names by gender and script.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX = "0123456789abcdef"
HEX_CLASSES = (DIGITS, "abcdef", "ABCDEF")
LATIN_SOUNDS = ("aeiou", "AEIOU", "bcdfghjklmnpqrstvwxyz", "BCDFGHJKLMNPQRSTVWXYZ")
VOWELS = "aeiouyæøœıаеиоуыэюяєіαεηιουω"
#: Blocks of letters that are dealt out to classes by case and sound; other letters move within rows of 16.
LETTER_BLOCKS = (
    (0x00C0, 0x0100), (0x0100, 0x0180), (0x0180, 0x0250), (0x0370, 0x0391), (0x0391, 0x03CA), (0x03CA, 0x0400), (0x0400, 0x0410), (0x0410, 0x0450), (0x0450, 0x0530),
    (0x1E00, 0x1F00), (0x1F00, 0x2000),
)
GIVEN_NAMES = {
    "female latin": (
        "Alice Anna Barbara Carmen Charlotte Clara Elizabeth Emily Emma Eva Hannah Helen Isabel Jennifer Jessica Julia Karen Laura Linda Lisa Lucia Margaret Maria Marie Mary Nancy "
        "Olivia Patricia Paula Rebecca Ruth Sandra Sarah Sophie Susan"
    ).split(),
    "male latin": (
        "Adam Andrew Anthony Anton Benjamin Brian Charles Christopher Daniel David Edward Felix George Henry James Jason John Jonas Joseph Kevin Louis Lucas Mark Martin Matthew Michael "
        "Paul Peter Richard Robert Stephen Steven Thomas Timothy William"
    ).split(),
    "female cyrillic": "Анна Вера Галина Елена Ирина Мария Нина Ольга Светлана Татьяна".split(),
    "male cyrillic": "Александр Андрей Борис Виктор Дмитрий Иван Николай Олег Павел Сергей".split(),
}
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora|Господин|Госпожа"
#: Endings by which a surname tells a gender.
GENDER_ENDING = "(?:[оеё]ва|[иы]на|ая|[oe]va)$"
#: Country calling codes by their first digits; all others have three digits.
CALLING_CODE = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
#: Words before = or : that make what follows a secret, in any case, also behind an underscore.
KEYWORDS = "password|passwd|passwort|contraseña|пароль|secret|token|(?:api_)?key"

#: Words before a number without separators, or with spaces, that make it a phone or an American social security number.
PHONE_WORDS, SSN_WORDS = "phone|tel|telephone|mobile|cell|fax|call", "ssn|social security number|social security no|social security"
#: What a secret has at least one of: characters that the cipher moves. Other letters and digits are in no alphabet.
MOVED = r"[\p{L}\p{Nd}&&[^\u00AA\u00B5\u00BA\u2000-\u2BFF\u3000-\u303F\uD800-\uF8FF]]"

# What looks back at words first looks ahead for a digit, which is cheaper by far.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NAME = r"\p{Lu}[\p{L}'’-]*+"
#: Words of a name; an initial counts where another word of the name follows.
_WORDS = rf"(?: (?:(?:\p{{Lu}}\.)+(?= \p{{Lu}})|{_NAME}))++"
_HEX = "[0-9A-Fa-f]{1,4}"
_KNOWN = "|".join(n for v in GIVEN_NAMES.values() for n in v)
#: Kinds in order of precedence; none has a group of its own. What a keyword makes a secret comes last.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@(?:[\p{L}\p{N}-]{1,63}+\.){1,127}\p{L}{2,}",
    "access_key": r"(?<![A-Za-z0-9])A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "hex_key": r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,}+(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?i:[23][0-9a-f]{{3}}|f[c-f][0-9a-f]{{2}})(?:(?::{_HEX}){{7}}|(?=[0-9A-Fa-f:]*::)(?:::?{_HEX}){{1,6}}+(?:::)?+)(?![0-9A-Za-z:])",
    "card": r"(?<![0-9+])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "ssn": rf"(?<![0-9-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9-])|(?=[0-9])(?<=(?i:{SSN_WORDS})[.:#]{{0,2}} {{0,3}})[0-9]{{3}} ?[0-9]{{2}} ?[0-9]{{4}}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,5}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|"
    rf"(?=[0-9])(?<=(?i:{PHONE_WORDS})[.:#]{{0,2}} {{0,3}})[0-9]{{7,15}})(?![0-9])",
    "name": rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?i:{TITLES})\.?|{_KNOWN}){_WORDS}",
}
KINDS = (*PATTERNS, "password")
_OTHERS = "|".join(p for k, p in PATTERNS.items() if k != "name")
_GAP = r"[\p{Zs}\t]*+"
_SIGN = rf"{_GAP}[=:](?:{_GAP}\r?\n)?{_GAP}"
#: In prose a word may follow "Key:"; it is a secret only behind quotes, an equals sign or a longer key word, or if it isn't all letters.
_PROSE = rf"(?!(?<!_)(?iu:key){_GAP}:(?:{_GAP}\r?\n)?{_GAP}\p{{L}}++[.,;:!?)]*+(?:\s|\z))"
#: A secret ends where its quotes do, or without quotes at a space.
_SECRET = "|".join(rf"(?<={q})[^{q}\r\n]*?{MOVED}[^{q}\r\n]*+(?={q})" for q in "\"'") + rf"|[^\s\"']*?{MOVED}[^\s\"']*+"
#: One group a kind; before a password stands the group of its keyword.
ANY = "|".join(f"({p})" for p in PATTERNS.values()) + rf"|(?<![\p{{L}}\p{{N}}])(?=[ptkscPTKSCпПaА]){_PROSE}((?iu:{KEYWORDS}){_SIGN}[\"']?+)(?!{_OTHERS})({_SECRET})"
#: Marks between what the expression finds, between its groups, and what they are escaped by where a text has them.
MARK, GROUP, ESCAPE = "\u0001", "\u0002", "\u0003"


# ---- ciphers ---------------------------------------------------------------------------------------


@cache
def _other_letters() -> tuple[str, ...]:
    """The letters of ``LETTER_BLOCKS`` by block, case (whether it can be changed and back) and sound; of each class two at least."""
    classes: dict[tuple, str] = {}
    for block in LETTER_BLOCKS:
        for c in map(chr, range(*block)):
            kind = unicodedata.category(c)
            if kind.startswith("L"):
                cased = len(c.swapcase()) == 1 and c.swapcase() != c and c.swapcase().swapcase() == c
                sound = unicodedata.normalize("NFD", c)[0].lower() in VOWELS
                classes[block, kind, cased, sound] = classes.get((block, kind, cased, sound), "") + c
    lone = "".join(x for x in classes.values() if len(x) == 1)
    return (*(x for x in classes.values() if len(x) > 1), *((lone,) if len(lone) > 1 else ()))


SECRET_CLASSES = (DIGITS, LOWER, UPPER, *_other_letters())
NAME_CLASSES = (*LATIN_SOUNDS, *_other_letters())
EMAIL_CLASSES = (DIGITS, LOWER, *_other_letters())


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _joined(array: Column) -> Column:
    return F.array_join(array, "")


def _byte(digest: Column, i: Column) -> Column:
    """One of 65,536 values for the place ``i`` from a digest in hexadecimal digits, around and around."""
    return F.conv(F.substring(digest, F.pmod(i, F.lit(30)) * 2 + 1, F.lit(4)), 16, 10).cast("int")


def _numbers(values) -> Column:
    """An array of numbers as one expression, which the optimizer works out once."""
    return F.split(F.lit(" ".join(map(str, values))), " ").cast("array<int>")


def _classes(alphabets) -> Column:
    """Alphabets as one text, with the place where each character's begins and how long that is; ``wide`` if letters of all scripts are meant."""
    return F.struct(
        F.lit("".join(alphabets)).alias("text"), _numbers(sum(map(len, alphabets[:k])) + 1 for k, a in enumerate(alphabets) for _ in a).alias("begins"),
        _numbers(len(a) for a in alphabets for _ in a).alias("sizes"), F.lit(len(alphabets) > 6).alias("wide"),
    )


def _shifted(c: Column, by: Column, classes: Column) -> Column:
    """``c`` moved on in the alphabet that has it. If letters of all scripts are meant, one of a script without alphabets moves in its row of 16."""

    def moved(p: Column) -> Column:
        begin = F.get(classes["begins"], p - 1)
        return F.when(p > 0, F.substring(classes["text"], begin + F.pmod(p - begin + by, F.get(classes["sizes"], p - 1)), F.lit(1)))

    code = F.ascii(c)
    far = (code >= 0x0250) & ~code.between(0x0300, 0x052F) & ~code.between(0x1E00, 0x2BFF) & ~code.between(0x3000, 0x303F) & ~code.between(0xD800, 0xF8FF)
    row = code.bitwiseAND(F.lit(~15))
    there = F.decode(F.unhex(F.lpad(F.hex((row + F.pmod(code - row + by, F.lit(16))).cast("long")), 8, "0")), "UTF-32")
    return F.coalesce(_bind(F.instr(classes["text"], c), moved), F.when(classes["wide"] & far, there).otherwise(c))


def _cipher(text: Column, key: str, kind: Column, classes: Column) -> Column:
    """A permutation, with no fixed points, of the texts that have the same classes at the same places; texts without any stay.

    Rounds 0 to 3 are the network, then every character moves on by one, then the rounds are undone.
    """
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b"))

    def step(s: Column, n: Column) -> Column:
        forth, back = n < ROUNDS, n > ROUNDS
        r = F.when(forth, n).otherwise(2 * ROUNDS - n)
        part = F.when(forth, s["a"]).when(back, s["b"]).otherwise(F.concat(s["a"], s["b"]))
        digest = F.sha2(F.concat_ws(MARK, F.lit(key), kind, r.cast("string"), F.when(forth, s["b"]).otherwise(s["a"])), 256)
        by = lambda i: F.when(forth, _byte(digest, i)).when(back, -_byte(digest, i)).otherwise(F.lit(1))
        moved = _joined(F.transform(_chars(part), lambda c, i: _shifted(c, by(i), classes)))

        def taken(m: Column) -> Column:
            cut = F.length(s["a"])
            return F.struct(
                F.when(forth, s["b"]).when(back, m).otherwise(F.substring(m, F.lit(1), cut)).alias("a"),
                F.when(forth, m).when(back, s["a"]).otherwise(F.substring(m, cut + 1, F.length(m))).alias("b"),
            )

        return _bind(moved, taken)

    return F.aggregate(F.array(*map(F.lit, range(2 * ROUNDS + 1))), start, step, lambda s: F.concat(s["a"], s["b"]))


def _bind(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refilled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced by ``digits`` in order."""
    return _joined(
        F.transform(
            _chars(form),
            lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(form, F.lit(1), i + 1))), F.lit(1))).otherwise(c),
        )
    )


# ---- kinds -----------------------------------------------------------------------------------------


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a digit string, its last digit counting once."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10


def _carded(m: Column, middle: Column) -> Column:
    """A card of other digits between the first, which is kept, and the last, which is set so that the Luhn sum stays."""
    digits = _digits(m)
    front = F.concat(F.substring(digits, 1, 1), middle)
    return _refilled(m, _bind(front, lambda f: F.concat(f, F.pmod(_luhn(digits) - _luhn(F.concat(f, F.lit("0"))), F.lit(10)).cast("string"))))


def phone_number(m: Column) -> Column:
    """Calling code (empty without a plus sign) and national digits of a phone number."""
    return _bind(
        F.when(F.startswith(m, F.lit("+")), F.regexp_extract(_digits(m), f"^(?:{CALLING_CODE})", 0)).otherwise(F.lit("")),
        lambda code: F.struct(code.alias("code"), F.substring(_digits(m), F.length(code) + 1, F.length(m)).alias("national")),
    )


def _phoned(m: Column, rest: Column) -> Column:
    """A phone number of the same calling code and first digit behind it."""
    return _refilled(m, _bind(phone_number(m), lambda n: F.concat(n["code"], F.substring(n["national"], 1, 1), rest)))


def _tail(m: Column) -> Column:
    """The last two parts of an address of mail's host, or one if there is no more."""
    return F.regexp_extract(m, r"(?:(?<=[@.])[^@.]+)?\.[^.]+$", 0)


def _mailed(m: Column, head: Column) -> Column:
    """An address of mail with another head in lower case, whose letters get the case that they had, and the same tail."""
    cased = F.zip_with(_chars(head), _chars(m), lambda c, h: F.when(h.rlike(r"\p{Lu}"), F.upper(c)).otherwise(c))
    return F.concat(_joined(F.slice(cased, F.lit(1), F.length(head))), _tail(m))


#: First octets of addresses that aren't public.
PRIVATE_OCTETS = (0, 10, 127, 169, 172, 192, 198, 203, *range(224, 256))
PUBLIC_OCTETS = tuple(x for x in range(256) if x not in PRIVATE_OCTETS)


def _ip(m: Column, key: str) -> Column:
    """A Feistel permutation of the pair of the upper and the lower half: the upper one counts public addresses, or those of one first part that isn't public."""
    octets = F.split(m, r"\.")
    part = lambda k: F.get(octets, F.lit(k)).cast("long")
    first = part(0)
    rank = F.array_position(_numbers(PUBLIC_OCTETS), first.cast("int")) - 1
    public = rank >= 0
    size = F.when(public, F.lit(256 * len(PUBLIC_OCTETS))).otherwise(F.lit(256)).cast("long")
    start = F.struct((F.when(public, rank * 256).otherwise(F.lit(0)) + part(1)).cast("long").alias("a"), (part(2) * 256 + part(3)).alias("b"))
    rounds = F.array(*map(F.lit, range(ROUNDS)))

    def drawn(r: Column, x: Column) -> Column:
        text = F.concat_ws(MARK, F.lit(key), F.lit("ip"), F.when(public, F.lit("")).otherwise(first.cast("string")), r.cast("string"), x.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")

    def forth(s: Column, r: Column) -> Column:
        a = F.pmod(s["a"] + drawn(r * 2, s["b"]), size)
        return _bind(a, lambda a: F.struct(a.alias("a"), F.pmod(s["b"] + drawn(r * 2 + 1, a), F.lit(65536)).alias("b")))

    def back(s: Column, r: Column) -> Column:
        b = F.pmod(s["b"] - drawn(r * 2 + 1, s["a"]), F.lit(65536))
        return _bind(b, lambda b: F.struct(F.pmod(s["a"] - drawn(r * 2, b), size).alias("a"), b.alias("b")))

    there = F.aggregate(rounds, start, forth, lambda s: F.struct(s["a"].alias("a"), F.pmod(s["b"] + 1, F.lit(65536)).alias("b")))

    def dotted(s: Column) -> Column:
        high, low = s["a"], s["b"]
        octet = F.when(public, F.get(_numbers(PUBLIC_OCTETS), F.floor(high / 256).cast("int"))).otherwise(first)
        return F.concat_ws(".", *[x.cast("string") for x in (octet, F.pmod(high, F.lit(256)), F.floor(low / 256), F.pmod(low, F.lit(256)))])

    return _bind(F.aggregate(F.reverse(rounds), there, back), dotted)


def _banked(m: Column, account: Column) -> Column:
    """An account number of the same country and spaces, with check digits worked out anew."""
    country = F.substring(m, 1, 2)
    rest = F.aggregate(
        _chars(F.concat(account, country, F.lit("00"))), F.lit(0),
        lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97),
    )
    plain = F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)
    return _bind(plain, lambda s: _joined(F.transform(
        _chars(m),
        lambda c, i: F.when(c == " ", c).otherwise(F.substring(s, F.length(F.replace(F.substring(m, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1))),
    )))


def given_names(key: str) -> dict[str, str]:
    """A known given name: the next one of its list in an order under the key, around."""
    out = {}
    for names in GIVEN_NAMES.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}{MARK}given{MARK}{n}".encode()).digest())
        out |= dict(zip(order, [*order[1:], order[0]]))
    return out


def _body(kind: Column, m: Column) -> Column:
    """What of an entity is enciphered."""
    beyond = lambda text, at: F.substring(text, F.lit(at), F.length(text))
    return (
        F.when(kind == "email", F.lower(F.substring(m, F.lit(1), F.length(m) - F.length(_tail(m))))).when(kind.isin("access_key", "ipv6"), beyond(m, 5))
        .when(kind == "iban", beyond(F.replace(m, F.lit(" "), F.lit("")), 5)).when(kind == "card", F.substring(_digits(m), F.lit(2), F.length(_digits(m)) - 2))
        .when(kind == "ssn", _digits(m)).when(kind == "phone", beyond(phone_number(m)["national"], 2)).when(kind == "ip", F.lit("")).otherwise(m)
    )


def _classes_of(kind: Column, m: Column) -> Column:
    """The alphabets of an entity. Hexadecimal keys without capitals are one alphabet; with capitals, digits, small and capital letters are three."""
    return (
        F.when(kind.isin("card", "ssn", "phone"), _classes((DIGITS,))).when(kind.isin("access_key", "iban"), _classes((DIGITS, UPPER)))
        .when(kind.isin("hex_key", "ipv6") & m.rlike("[A-F]"), _classes(HEX_CLASSES)).when(kind.isin("hex_key", "ipv6") | (kind == "password") & m.rlike("^[0-9a-f]+$"), _classes((HEX,)))
        .when(kind == "email", _classes(EMAIL_CLASSES)).when(kind == "name", _classes(NAME_CLASSES)).otherwise(_classes(SECRET_CLASSES))
    )


def surrogate(kind: Column, m: Column, key: str = DEFAULT_KEY) -> Column:
    """The replacement of one entity of one of ``KINDS``.

    Of a name, titles stay, known given names become others of their list, and all other words are
    enciphered up to an ending that tells a gender; none of these becomes a known name, or one with an
    ending of a gender that it hasn't (cycle walking).
    """
    spin = given_names(key)
    known, listed = F.split(F.lit(" ".join(sorted(spin))), " "), F.split(F.lit(" ".join(spin[n] for n in sorted(spin))), " ")
    is_name = kind == "name"
    # an ending without anything before it is the whole surname
    ending = lambda w: F.when(is_name, F.regexp_extract(w, rf"(?<=\p{{L}}){GENDER_ENDING}", 0)).otherwise(F.lit(""))

    def word(w: Column, classes: Column) -> Column:
        strays = lambda y: is_name & (F.array_contains(known, y) | (ending(y) != ending(w)))
        moved = lambda y: F.concat(_cipher(F.substring(y, F.lit(1), F.length(y) - F.length(ending(y))), key, kind, classes), ending(y))
        walked = F.aggregate(F.array(*map(F.lit, range(9))), w, lambda y, n: F.when((n == 0) | strays(y), moved(y)).otherwise(y))
        return F.when(is_name & w.rlike(rf"^(?i:{TITLES})\.?$"), w).when(is_name & F.array_contains(known, w), F.get(listed, F.array_position(known, w).cast("int") - 1)).otherwise(walked)

    words = F.when(is_name, F.split(m, " ")).otherwise(F.array(_body(kind, m)))
    done = _bind(_classes_of(kind, m), lambda classes: F.array_join(F.transform(words, lambda w: word(w, classes)), " "))

    def finished(x: Column) -> Column:
        return (
            F.when(kind == "email", _mailed(m, x)).when(kind.isin("access_key", "ipv6"), F.concat(F.substring(m, 1, 4), x)).when(kind == "iban", _banked(m, x)).when(kind == "ip", _ip(m, key))
            .when(kind == "card", _carded(m, x)).when(kind == "ssn", _refilled(m, x)).when(kind == "phone", _phoned(m, x)).otherwise(x)
        )

    return _bind(done, finished)


def plain_form(kind: Column, m: Column) -> Column:
    """An entity without the ways of writing it: two with the same plain form are the same."""
    return (
        F.when(kind == "phone", phone_number(m)["national"]).when(kind.isin("card", "ssn"), _digits(m)).when(kind == "email", F.lower(m))
        .when(kind == "iban", F.replace(m, F.lit(" "), F.lit(""))).otherwise(m)
    )


# ---- texts -----------------------------------------------------------------------------------------


def _may_hold(text: Column) -> Column:
    """False only for texts that hold no entity: each kind needs one of these cheaper signs.

    An address of mail has its sign; numbers have a digit before a digit, space, point or hyphen; a key
    of letters alone has 32 of them; access keys, secrets and names have their words.
    """
    numbers = r"[0-9][0-9 .-]|[0-9a-fA-F]{32}|A(?:KIA|SIA)|@|[0-9a-fA-F]:[0-9a-fA-F]{0,4}:"
    names = rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?i:{TITLES})\.?|{_KNOWN}) \p{{Lu}}"
    return text.rlike(numbers) | text.rlike("[=:]") & text.rlike(rf"(?iu:{KEYWORDS}){_GAP}[=:]") | text.rlike(names)


def _parts(text: Column) -> Column:
    """What stands between entities, and between these for each entity all groups of the expression; one pass over a text that may hold one."""
    marked = F.regexp_replace(text, ANY, MARK + GROUP.join(f"${k}" for k in range(1, len(KINDS) + 2)) + MARK)
    return F.when(_may_hold(text), F.split(marked, MARK, -1)).when(text.isNotNull(), F.array(text))


def _escaped(text: Column) -> Column:
    """``text`` with the marks that it has itself spelled by others."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "\u0006"))
    for mark, sign in ((MARK, "\u0004"), (GROUP, "\u0005")):
        out = F.replace(out, F.lit(mark), F.lit(ESCAPE + sign))
    return F.when(_is_odd(text), out).otherwise(text)


def _unescaped(text: Column) -> Column:
    out = text
    for mark, sign in ((MARK, "\u0004"), (GROUP, "\u0005"), (ESCAPE, "\u0006")):
        out = F.replace(out, F.lit(ESCAPE + sign), F.lit(mark))
    return F.when(F.contains(text, F.lit(ESCAPE)), out).otherwise(text)


def _is_odd(text: Column) -> Column:
    return F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(GROUP)) | F.contains(text, F.lit(ESCAPE))


def _entity(groups: Column) -> Column:
    """(before, kind, entity) of the groups of a match; a keyword's group stands before the password's."""

    def of(parts: Column) -> Column:
        place = F.when(F.get(parts, F.lit(len(KINDS))) != "", F.lit(len(KINDS))).otherwise(F.array_position(F.transform(parts, lambda p: p != ""), True).cast("int") - 1)
        named = F.when(place == len(KINDS), F.lit("password")).otherwise(F.get(F.lit(list(KINDS)), place))
        before = F.when(place == len(KINDS), F.get(parts, F.lit(len(KINDS) - 1))).otherwise(F.lit(""))
        return F.struct(_unescaped(before).alias("before"), named.alias("kind"), _unescaped(F.get(parts, place)).alias("entity"))

    return _bind(F.split(groups, GROUP, -1), of)


def _found(parts: Column) -> Column:
    return F.transform(F.filter(parts, lambda _, i: i % 2 == 1), _entity)


def entities(text: Column) -> Column:
    """(before, kind, entity) of all entities of a text, in order; ``before`` is what the match has before the entity."""
    return _found(_parts(_escaped(text)))


def _entities_of(docs: DataFrame, text_column: str) -> DataFrame:
    """``kind, entity``: the different entities of ``docs``."""
    found = docs.where(_may_hold(F.col(text_column))).select(F.explode(entities(F.col(text_column))).alias("e"))
    return found.select("e.kind", "e.entity").distinct()


def _mapped(found: DataFrame, key: str, told: tuple[str, ...] = ()) -> DataFrame:
    return found.select("entity", "kind", distinct_surrogate(F.col("kind"), F.col("entity"), key, told).alias("surrogate"))


def distinct_surrogate(kind: Column, m: Column, key: str, told: tuple[str, ...] = ()) -> Column:
    """:func:`surrogate`; for the kinds of ``told`` with a keyed digest of the entity behind it."""
    made = surrogate(kind, m, key)
    if not told:
        return made
    digest = F.substring(F.sha2(F.concat_ws(MARK, F.lit(key), kind, plain_form(kind, m)), 256), 1, 16)
    return F.when(kind.isin(*told), F.concat(made, F.lit("-"), digest)).otherwise(made)


def surrogate_map(docs: DataFrame, key: str = DEFAULT_KEY, text_column: str = "text") -> DataFrame:
    """``entity, kind, surrogate`` of the different entities of ``docs``."""
    return _mapped(_entities_of(docs, text_column), key)


def collisions(mapped: DataFrame) -> DataFrame:
    """Collision check of a :func:`surrogate_map`: surrogates that stand for several entities, or for themselves."""
    rows = mapped.select("kind", plain_form(F.col("kind"), F.col("entity")).alias("plain"), plain_form(F.col("kind"), F.col("surrogate")).alias("made"))
    return rows.groupBy("kind", "made").agg(F.min("plain").alias("least"), F.max("plain").alias("greatest")).where("least <> greatest or least = made")


def sound_key(found: DataFrame, key: str = DEFAULT_KEY) -> tuple[str, tuple[str, ...]]:
    """A key under which the entities ``found`` (``kind, entity``) have distinct surrogates, and the kinds that need a digest for that: none, unless all keys that are tried have collisions."""
    told: tuple[str, ...] = ()
    for k in range(ATTEMPTS):
        now = key if k == 0 else f"{key}/{k}"
        told = tuple(sorted(r.kind for r in collisions(_mapped(found, now)).select("kind").distinct().collect()))  # a row for each kind at most
        if not told:
            break
    return now, told


def replace_entities(docs: DataFrame, key: str = DEFAULT_KEY, text_column: str = "text", count: str = "n_entities") -> DataFrame:
    """``docs`` with every entity in ``text_column`` replaced, and ``n_entities`` (or another name for ``count``), the number of them.

    Texts without entities, null ones among them (with ``n_entities`` 0), stay as they are; other
    columns, repeated rows and nulls are kept. A column that is called as ``count`` is replaced.
    An empty table gives an empty table. Texts of any length are taken whole. What holds no letter or
    digit (``password: ****``) is no secret. The different entities of the whole table are checked for
    collisions first, in a pass of its own that keeps nothing but the result; with collisions another key,
    derived from this one, is taken, and if all have some, the kinds concerned get a digest.
    """
    docs = docs.drop(count)
    now, told = sound_key(_entities_of(docs, text_column), key)
    replaced = lambda e: F.concat(e["before"], distinct_surrogate(e["kind"], e["entity"], now, told))
    name = fresh(docs, "parts")
    rows, parts = docs.withColumn(name, _parts(_escaped(F.col(text_column)))), F.col(name)
    changed = _joined(F.transform(parts, lambda p, i: F.when(i % 2 == 0, _unescaped(p)).otherwise(_bind(_entity(p), replaced))))
    columns = [F.when(F.size(parts) > 1, changed).otherwise(F.col(text_column)).alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*columns, F.when(parts.isNull(), 0).otherwise(F.floor(F.size(parts) / 2)).cast("long").alias(count))
