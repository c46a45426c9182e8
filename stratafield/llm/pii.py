"""Format-preserving pseudonyms: validated numbers, dates and addresses are permuted under a key within their format.

A value's characters that may vary are a number in a mixed radix. A Feistel network permutes the numbers below that
radix; it is repeated until the result is valid as the value was (cycle walking), so it stays a permutation of the
valid values of a format: equal values have equal pseudonyms in every document, different ones different ones, and
whoever has the key can undo it. Separators, prefixes and letter case stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b
from ipaddress import IPv6Address
from math import isqrt
from secrets import token_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafield.llm.common import append_columns, without

ROUNDS = 8
#: Addresses of no one in particular.
_NOBODY = ("0.0.0.0", "127.0.0.1", "255.255.255.255")
_DAY_ONE, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def feistel(x: int, size: int, key: bytes, tweak: str, undo: bool = False) -> int:
    """Keyed permutation of 0..size-1."""
    side = isqrt(size - 1) + 1 if size > 1 else 1
    wide = side.bit_length() // 8 + 9  # bytes of a round's number: eight more than the half has, so that no residue stands out

    def part(r: int, half: int) -> int:
        said = f"{tweak}|{size}|{r}|{half}|".encode()
        blocks = (blake2b(said + b"%d" % i, key=key, digest_size=min(64, wide - 64 * i)).digest() for i in range(-(-wide // 64)))
        return int.from_bytes(b"".join(blocks), "big")

    while True:
        a, b = divmod(x, side)
        for r in range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS):
            a, b = ((b - part(r, a)) % side, a) if undo else (b, (a + part(r, b)) % side)
        x = a * side + b
        if x < size:
            return x


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


#: First digits of card numbers (from, to) and how many digits such a number has.
CARD_ISSUERS = (
    ("4", "4", (13, 16, 19)),
    ("51", "55", (16,)),
    ("2221", "2720", (16,)),
    ("34", "34", (15,)),
    ("37", "37", (15,)),
    ("300", "305", (14,)),
    ("3095", "3095", (14,)),
    ("36", "36", (14,)),
    ("38", "39", (14,)),
    ("3528", "3589", (16,)),
    ("6011", "6011", (16, 19)),
    ("644", "649", (16, 19)),
    ("65", "65", (16, 19)),
    ("62", "62", (16, 17, 18, 19)),
)


def issuer(s: str) -> str | None:
    """First digits of a card number that say whose it is, if some issuer has such numbers."""
    return next((s[: len(low)] for low, high, sizes in CARD_ISSUERS if len(s) in sizes and low <= s[: len(low)] <= high), None)


def valid_card(s: str) -> bool:
    return issuer(s) is not None and luhn(s)


def valid_ssn(s: str) -> bool:
    return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"


def valid_iban(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def permute_text(s: str, key: bytes, tweak: str, undo: bool = False) -> str:
    """Digits stay digits, letters letters of their case, other characters themselves."""
    radix = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in s]
    number, size = 0, 1
    for c, r in zip(s, radix, strict=True):
        if r > 1:
            number = number * r + (ord(c) - 48 if r == 10 else ord(c.lower()) - 97)
            size *= r
    number, out = feistel(number, size, key, tweak, undo), []
    for c, r in zip(reversed(s), reversed(radix), strict=True):
        if r == 1:
            out.append(c)
            continue
        number, d = divmod(number, r)
        out.append(chr(48 + d) if r == 10 else chr((65 if c.isupper() else 97) + d))
    return "".join(reversed(out))


def _walk(s: str, valid: Callable[[str], bool], key: bytes, tweak: str, undo: bool) -> str:
    out = permute_text(s, key, tweak, undo)
    while not valid(out):
        out = permute_text(out, key, tweak, undo)
    return out


def _spread(shape: str, core: str) -> str:
    """core's letters and digits in the places of shape's."""
    rest = iter(core)
    return "".join(next(rest) if c.isalnum() else c for c in shape)


def _core(s: str) -> str:
    return "".join(c for c in s if c.isalnum())


def _card(s: str, key: bytes, undo: bool) -> str | None:
    """The issuer stays, the check digit follows from what varies between."""
    core = _core(s)
    if not valid_card(core):
        return None
    first = issuer(core)
    new = first + permute_text(core[len(first) : -1], key, "card" + first, undo)
    return _spread(s, new + next(c for c in "0123456789" if luhn(new + c)))


def _ssn(s: str, key: bytes, undo: bool) -> str | None:
    core = _core(s)
    return _spread(s, _walk(core, valid_ssn, key, "ssn", undo)) if valid_ssn(core) else None


def _dialled(s: str, at: int, key: bytes, undo: bool) -> str:
    """The digits from `at` vary. Numbers of ten digits that can be dialled stay so, others stay others."""
    core = _core(s[at:])

    def known(x: str) -> bool:
        return len(x) == 10 and x[0] in "23456789" and x[3] in "23456789"

    return s[:at] + _spread(s[at:], _walk(core, lambda x: known(x) == known(core), key, "phone", undo))


def _phone(s: str, key: bytes, undo: bool) -> str | None:
    """The last ten digits vary; a country code stays."""
    return _dialled(s, [i for i, c in enumerate(s) if c.isdigit()][-10], key, undo)


def _national(s: str, key: bytes, undo: bool) -> str | None:
    """What follows the first two digits varies."""
    return _dialled(s, [i for i, c in enumerate(s) if c.isdigit()][2], key, undo)


def _international(s: str, key: bytes, undo: bool) -> str | None:
    """All digits after the country code vary."""
    code = len(_COUNTRY_CODE.match(_core(s))[0])
    return _dialled(s, [i for i, c in enumerate(s) if c.isdigit()][code], key, undo)


def _iban(s: str, key: bytes, undo: bool) -> str | None:
    core = _core(s).upper()
    if not valid_iban(core):
        return None
    size = IBAN_LENGTHS.get(core[:2], len(core))
    begins = size < len(core) and valid_iban(core[:size])
    out = core
    while out is core or size < len(core) and valid_iban(out[:size]) != begins:  # a longer number does not come to begin with an IBAN of its country's length
        account = permute_text(out[4:], key, "iban" + core[:2], undo)
        check = 98 - int("".join(str(int(c, 36)) for c in account + core[:2] + "00")) % 97
        out = f"{core[:2]}{check:02d}{account}"
    return _spread(s, out)


def _ipv4(s: str, key: bytes, undo: bool) -> str | None:
    """Numbers of one digit each stay such, others others: the former are addresses only where something says so."""
    octets = [int(x) for x in s.split(".")]
    if max(octets) > 255 or not octets[0] or s in _NOBODY:
        return None
    if max(octets) < 10:
        return _walk(s, lambda x: x[0] != "0", key, "ipv4", undo)
    x = int.from_bytes(bytes(octets), "big")
    while True:
        x = feistel(x, 1 << 32, key, "ipv4", undo)
        new = x.to_bytes(4, "big")
        if new[0] and max(new) > 9 and (out := ".".join(map(str, new))) not in _NOBODY:
            return out


def _ipv6(s: str, key: bytes, undo: bool) -> str | None:
    """The first 16 bits stay. The result is spelt in full or in short as the address was."""
    try:
        old = IPv6Address(s)
    except ValueError:
        return None

    def known(x: IPv6Address) -> bool:
        return not (x.is_loopback or x.is_unspecified or x.is_multicast or x.ipv4_mapped) and x.compressed.count(":") > 2 and any(c.isdigit() for c in x.compressed)

    if not known(old):
        return None
    first, rest = divmod(int(old), 1 << 112)
    while not known(new := IPv6Address((first << 112) + (rest := feistel(rest, 1 << 112, key, f"ipv6{first}", undo)))):
        pass
    out = new.exploded if len(s) == 39 else new.compressed
    return out.upper() if s.upper() == s else out


def _key(s: str, key: bytes, undo: bool) -> str | None:
    """A service's key: the first characters, which say whose keys look so, stay."""
    first = _KEY_STARTS.match(s)[0]
    rest = s[len(first) :]
    return first + permute_text(rest, key, "key" + first, undo) if any(c.isdigit() for c in rest) else None


def _email(s: str, key: bytes, undo: bool) -> str | None:
    local, _, domain = s.partition("@")
    return permute_text(local, key, "email" + domain.lower(), undo) + "@" + domain


def _date(s: str, key: bytes, undo: bool) -> str | None:
    """Years 1900 to 2099. Year first, or day and month (month and day where only that is a date) and year last. One digit stays one."""
    parts = re.split(r"[-./]", s)
    orders = ((0, 1, 2),) if len(parts[0]) == 4 else ((2, 1, 0), (2, 0, 1))
    for order in orders:
        y, m, d = (int(parts[i]) for i in order)
        try:
            n = (date(y, m, d) - _DAY_ONE).days
        except ValueError:
            continue
        if 0 <= n < _DAYS:
            break
    else:
        return None
    while True:
        n = feistel(n, _DAYS, key, "date", undo)
        new = _DAY_ONE + timedelta(n)
        values = dict(zip(order, (new.year, new.month, new.day), strict=True))
        if order != (2, 0, 1) or new.day > 12:  # else it would read as day and month
            if all(len(str(values[i])) <= len(p) for i, p in enumerate(parts)):
                break
    marks = re.findall(r"[-./]", s)
    text = [f"{values[i]:0{len(p)}d}" for i, p in enumerate(parts)]
    return text[0] + marks[0] + text[1] + marks[1] + text[2]


def _secret(s: str, key: bytes, undo: bool) -> str | None:
    """Hexadecimal digits, as many, in the case they are in."""
    if s.isdigit() or not any(c.isdigit() for c in s):
        return None
    n = feistel(int(s, 16), 16 ** len(s), key, "secret", undo)
    return f"{n:0{len(s)}X}" if s.upper() == s else f"{n:0{len(s)}x}"


@dataclass(frozen=True)
class Kind:
    name: str
    hint: str  # the text has a character of these, or no value of the kind
    pattern: re.Pattern
    replace: Callable[[str, bytes, bool], str | None]
    seen: Callable[[str, int, int], bool] | None = None  # what stands around it tells whether it is one


#: What stands before numbers of versions, releases and sections, and before or after addresses.
_VERSION = re.compile(r"(?:\b(?:v|ver|version|release|rev|revision|build|section|chapter|clause|figure|table)|§)[ .:#]*$", re.IGNORECASE)
_ADDRESS = re.compile(r"\b(?:ip|ipv4|addr|address|host|server|from|gateway|ping|dns)[ :=@]*(?:is )?$", re.IGNORECASE)


def _is_ipv4(text: str, a: int, z: int) -> bool:
    before = text[max(0, a - 24) : a]
    if _VERSION.search(before) or text[a - 1 : a] in ("v", "V"):
        return False
    return z - a > 7 or bool(_ADDRESS.search(before)) or bool(re.match(r"[:/][0-9]", text[z : z + 2]))


_D = "0123456789"
#: Letters and digits of an IBAN, by country.
IBAN_LENGTHS = {c: n for n, cs in {15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in cs.split()}
_IBAN_SHAPES = "|".join("(?:" + "|".join(c for c in IBAN_LENGTHS if IBAN_LENGTHS[c] == n) + ")[0-9]{2}(?: ?[0-9A-Z]{4}){" + str((n - 4) // 4) + "}" + (" ?[0-9A-Z]{" + str(n % 4) + "}") * (n % 4 > 0) for n in sorted(set(IBAN_LENGTHS.values())))
_COUNTRY_CODE = re.compile("1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2}")
_KEY_STARTS = re.compile("AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-(?:[a-z]{2,8}-)?|xox[abprs]-|AIza")
#: In order of precedence where matches overlap.
KINDS = (
    Kind("email", "@", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])"), _email),
    Kind("secret", _D, re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])"), _secret),
    Kind("secret", _D, re.compile(r"(?<![0-9A-Za-z_-])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,76}|github_pat_[0-9A-Za-z]{22}_[0-9A-Za-z]{59}|glpat-[0-9A-Za-z_-]{20}|sk-(?:[a-z]{2,8}-)?[0-9A-Za-z_-]{20,200}|xox[abprs]-[0-9A-Za-z-]{20,80}|AIza[0-9A-Za-z_-]{35})(?![0-9A-Za-z_-])"), _key),
    Kind("iban", _D, re.compile(rf"(?<![0-9A-Za-z])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN_SHAPES})(?![0-9A-Za-z])"), _iban),
    Kind("iban", _D, re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"), _iban),
    Kind("phone", _D, re.compile(r"(?<![0-9A-Za-z(+])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z])"), _phone),
    Kind("phone", "+", re.compile(r"(?<![0-9A-Za-z+])\+(?:1(?:[ .-]?[0-9]){10}|[2-9](?:[ .-]?[0-9]){7,14}|[2-9][0-9]{0,2} ?\([0-9]{1,4}\)(?:[ .-]?[0-9]){5,10})(?![0-9A-Za-z])"), _international),
    Kind("phone", "0", re.compile(r"(?<![0-9A-Za-z+.,/-])(?:0[1-9](?:[ .][0-9]{2}){4}|0[1-9][0-9]{1,3} [0-9]{3,4} [0-9]{3,4})(?![0-9A-Za-z])(?![ .,/-][0-9])"), _national),
    Kind("card", _D, re.compile(r"(?<![0-9A-Za-z])(?<![0-9][.,-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])(?![.,-][0-9])"), _card),
    Kind("ssn", _D, re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"), _ssn),
    Kind("date", _D, re.compile(r"(?<![0-9A-Za-z./-])(?:[12][0-9]{3}([-./])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\2[12][0-9]{3})(?:(?![0-9A-Za-z/-])|(?=[Tt][0-9]{2}))"), _date),
    Kind("ipv4", ".", re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z])(?!\.[0-9])"), _ipv4, _is_ipv4),
    Kind("ipv6", ":", re.compile(r"(?<![0-9A-Za-z:.])(?=(?:[0-9A-Fa-f]*:){3})[0-9A-Fa-f:]{6,39}(?<=[0-9A-Fa-f])(?![0-9A-Za-z:.])"), _ipv6),
)
_ANY = re.compile("[0-9@]")


_drawn: dict[str, bytes] = {}


@lru_cache(maxsize=64)
def _fitted(key: bytes) -> bytes:
    return blake2b(key).digest()


@lru_cache(maxsize=50_000)
def _pseudonym(kind: int, value: str, key: bytes, undo: bool) -> str | None:
    return KINDS[kind].replace(value, key, undo)


def session_key(spark: SparkSession) -> bytes:
    """The key in spark.stratafield.pii.key; where that is unset, one drawn for this application and known to it alone."""
    said = spark.conf.get("spark.stratafield.pii.key", None)
    return said.encode() if said else _drawn.setdefault(spark.sparkContext.applicationId, token_bytes(32))


def pseudonymise_text(text: str, key: bytes, undo: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, from, to) of what they replaced, as places in the original text."""
    if not key:
        raise ValueError("pseudonyms need a key")
    if not _ANY.search(text):
        return text, []
    key = _fitted(key)
    taken: list[tuple[int, int, str, str]] = []
    for k, kind in enumerate(KINDS):
        if not any(c in text for c in kind.hint):
            continue
        for m in kind.pattern.finditer(text):
            if all(m.end() <= a or z <= m.start() for a, z, *_ in taken) and (kind.seen is None or kind.seen(text, m.start(), m.end())) and (new := _pseudonym(k, m[0], key, undo)) is not None:
                taken.append((m.start(), m.end(), kind.name, new))
    if not taken:
        return text, []
    taken.sort()
    out, at = [], 0
    for a, z, _, new in taken:
        out += [text[at:a], new]
        at = z
    return "".join([*out, text[at:]]), [(name, a, z) for a, z, name, _ in taken]


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", spans: str = "pii", undo: bool = False) -> DataFrame:
    """docs with pseudonyms in `text`, and column `spans`: array of kind, from and to in the original text, in order.

    `key` is any bytes but none; who has it can undo the pseudonyms, so it is the caller's to draw and to keep.
    A null text stays null and an empty one empty, both without spans; texts without a valid value stay as they are.
    Texts are read whole; repeated rows stay; an existing column `spans` is replaced; an empty table gives an empty one.
    """
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            found = [pseudonymise_text(t, key, undo) if t else (t, []) for t in column.to_pylist()]
            return [pa.array([x for x, _ in found], pa.string()), pa.array([[{"kind": n, "start": a, "end": z} for n, a, z in s] for _, s in found], kind)]

        return work

    done = append_columns(docs, [text], [T.StructField(text, T.StringType()), T.StructField(spans, T.ArrayType(span))], make)
    return done.select(*[F.col(f"`{c}`") for c in without(docs.columns, [spans])], F.col(f"`{spans}`"))
