"""Format-preserving pseudonyms: numbers and dates in texts are permuted with a key inside their own format.

A pattern finds candidates (mail addresses, IPv4 addresses, IBANs, card numbers, phone numbers, national
numbers, dates), a rule validates each one (check digits, number ranges, calendar), and a Feistel network
with a keyed SHA-256 round function permutes the value inside its domain. The result has the same
separators, length and kind and is valid by the same rule; equal values, however they are punctuated, become equal values
in all documents, and whoever has the key can undo it (``decrypt=True``).

A domain is a product of two sizes (left, right); rounds add the round function of one half to the other,
modulo its size, so every round is a permutation of the domain. Domains:

card number    first digit kept (of a 2-series number four), the digits up to the check digit permuted, Luhn digit recomputed
IBAN           country kept, the rest permuted (letters and digits as base 36), check digits recomputed
phone          prefix kept; North American numbers stay in 200-999 for both groups of three digits
national no.   three groups, each in its valid range
IPv4           the 32 bits
date           days in blocks of 270 x 270 from 1900-01-01; the result is a date in the same block
mail address   letters and digits before the @ (case kept lower), the domain name stays

DataFrame expressions only. Matches are cut out of a text and put back with the same pattern, so all other
characters stay as they are. Texts without a digit or an @ are passed on unread.

Defined results: a null text stays null, an empty one empty; candidates that fail validation stay; values
inside longer words or numbers are no candidates; of a card, IBAN or foreign phone number and what follows it, the longest valid part is the value; repeated rows give repeated rows; all columns are kept.
A permutation may map a value to itself, with a chance of one in the size of its domain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
WALK = 64  # the chance that a value needs more moves is below 1e-20
DEFAULT_KEY = "test key: give your own"  # callers with real data pass a secret

# A word or number must not continue on either side of a value.
CARD = r"(?<![\p{L}\p{N}_.+-])(?:[3-6](?:[ -]?\d){12,18}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)(?:[ -]?\d){12})(?![\p{L}\p{N}_]|[.-]\d)"
PHONE = r"(?<![\p{L}\p{N}_.+])(?:\+1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}(?![\p{L}\p{N}_]|[.-]\d)"
ABROAD = r"(?<![\p{L}\p{N}_])\+[2-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?![\p{L}\p{N}_])"
NATIONAL = r"(?<![\p{L}\p{N}_.-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}_]|[.-]\d)"
IPV4 = r"(?<![\p{L}\p{N}_.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\p{N}_]|\.\d)"
# The length of an IBAN by country; other countries get the general pattern.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
SIZED = "|".join(f"(?:{c.replace(' ', '|')})\\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![\\p{{L}}\\p{{N}}_])" for n, c in IBAN_LENGTHS.items())
IBAN = rf"(?<![\p{{L}}\p{{N}}_])(?:{SIZED}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![\p{{L}}\p{{N}}_]))"
DATE = r"(?<![\p{L}\p{N}_./-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\p{L}\p{N}_]|[./-]\d)"
MAIL = r"(?<![\p{L}\p{N}_.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}(?![\p{L}\p{N}_])"


@dataclass(frozen=True)
class Cipher:
    key: str
    rounds: int = ROUNDS
    decrypt: bool = False

    def _noise(self, tag: Column, turn: int, half: Column) -> Column:
        said = F.concat_ws("|", F.lit(self.key), tag, F.lit(str(turn)), half.cast("string"))
        return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")

    def permute(self, tag: Column, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
        """The pair (left, right) moved inside left_size x right_size. ``tag`` names the domain."""
        sign = -1 if self.decrypt else 1

        def round_(turn: int):
            def step(s: Column) -> Column:
                if turn % 2 == 0:
                    return F.struct(F.pmod(s["l"] + sign * F.pmod(self._noise(tag, turn, s["r"]), left_size), left_size).alias("l"), s["r"].alias("r"))
                return F.struct(s["l"].alias("l"), F.pmod(s["r"] + sign * F.pmod(self._noise(tag, turn, s["l"]), right_size), right_size).alias("r"))

            return step

        state = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
        for turn in reversed(range(self.rounds)) if self.decrypt else range(self.rounds):
            state = let(state, round_(turn))
        return state

    def digits(self, tag: str, value: Column, base: int = 10) -> Column:
        """A string of digits of a base (at most 24), permuted as a whole."""
        size = F.length(value)
        cut = F.floor(size / 2).cast("int")
        number = lambda s: F.coalesce(F.conv(F.when(s == "", "0").otherwise(s), base, 10).cast("long"), F.lit(0))
        power = lambda n: F.pow(F.lit(float(base)), n).cast("long")
        moved = self.permute(F.concat_ws(":", F.lit(tag), size.cast("string")), number(F.substring(value, F.lit(1), cut)), number(F.substring(value, cut + 1, size)), power(cut), power(size - cut))
        shown = lambda n, width: F.lpad(F.lower(F.conv(n.cast("string"), 10, base)), width, "0")
        return let(moved, lambda m: F.concat(F.when(cut > 0, shown(m["l"], cut)).otherwise(""), shown(m["r"], size - cut)))

    def group(self, tag: str, value: Column, low: int, high: int, rest: Column, rest_size: int) -> Column:
        """(value in low..high, rest) moved together: a struct of the new value and the new rest."""
        moved = self.permute(F.lit(tag), value - low, rest, F.lit(high - low + 1), F.lit(rest_size))
        return let(moved, lambda m: F.struct((m["l"] + low).alias("l"), m["r"].alias("r")))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def bare(value: Column, allowed: str = "0-9") -> Column:
    return F.regexp_replace(value, f"[^{allowed}]", "")


def fill(form: Column, chars: Column, allowed: str = "0-9") -> Column:
    """``form`` with its characters of ``allowed`` replaced by ``chars``, in order."""
    spots = F.filter(F.split(form, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def put(s: Column, c: Column) -> Column:
        hit = c.rlike(f"^[{allowed}]$")
        return F.struct(F.concat(s["out"], F.when(hit, F.substring(chars, s["next"], F.lit(1))).otherwise(c)).alias("out"), (s["next"] + hit.cast("int")).alias("next"))

    return F.aggregate(spots, start, put, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, its last digit being the first that is not doubled."""
    found = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    doubled = F.transform(found, lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b)


def mod97(text: Column) -> Column:
    """A string of base-36 digits, read as decimal digits (A is 10), modulo 97."""
    spots = F.filter(F.split(F.upper(text), ""), lambda c: c != "")
    return F.aggregate(spots, F.lit(0).cast("long"), lambda a, c: let(F.conv(c, 36, 10).cast("long"), lambda v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97))


def longest(m: Column, valid) -> Column:
    """The length of the longest part of ``m`` from its start to a separator or its end that is valid; null if none is."""
    ends = F.filter(F.sequence(F.length(m), F.lit(1), F.lit(-1)), lambda n: (n == F.length(m)) | F.substring(m, n + 1, F.lit(1)).isin(" ", "-", "."))
    return F.get(F.filter(ends, lambda n: valid(F.substring(m, F.lit(1), n))), 0)


def part(m: Column, valid, moved) -> Column:
    """``m`` with its longest valid part moved; null if none is.

    What follows the part stays, so a moved part may be valid together with it; it is then moved again until it isn't
    (cycle walking), which keeps the whole a permutation that can be undone."""

    def walked(n: Column) -> Column:
        rest = F.substring(m, n + 1, F.length(m))
        start = F.struct(F.substring(m, F.lit(1), n).alias("s"), F.lit(False).alias("done"))

        def turn(a: Column, _: Column) -> Column:
            again = let(moved(a["s"]), lambda s: F.struct(s.alias("s"), F.coalesce(longest(F.concat(s, rest), valid) == n, F.lit(False)).alias("done")))
            return F.when(a["done"], a).otherwise(again)

        turns = F.sequence(F.lit(1), F.when(n == F.length(m), 1).otherwise(WALK))
        return F.when(n.isNotNull(), F.aggregate(turns, start, turn, lambda a: F.when(a["done"], F.concat(a["s"], rest))))

    return let(longest(m, valid), walked)


def card(c: Cipher, m: Column) -> Column:
    def valid(s: Column) -> Column:
        return let(bare(s), lambda d: F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0))

    def moved(s: Column) -> Column:
        def full(d: Column) -> Column:
            size, fixed = F.length(d), F.when(d.startswith("2"), 4).otherwise(1)
            body = F.concat(F.substring(d, F.lit(1), fixed), c.digits("card", F.substring(d, fixed + 1, size - fixed - 1)))
            return let(body, lambda b: F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))

        return fill(s, let(bare(s), full))

    return part(m, valid, moved)


def phone(c: Cipher, m: Column) -> Column:
    def moved(d: Column) -> Column:
        area, exchange, line = (F.substring(d, a, n).cast("int") for a, n in ((1, 3), (4, 3), (7, 4)))
        new = c.group("phone", area, 200, 999, (exchange - 200) * 10000 + line, 8_000_000)
        shown = let(new, lambda p: F.concat(p["l"].cast("string"), (F.floor(p["r"] / 10000) + 200).cast("string"), F.lpad((p["r"] % 10000).cast("string"), 4, "0")))
        country = F.when(m.startswith("+"), "1").otherwise("")
        return fill(m, F.concat(country, shown))

    return let(F.substring(bare(m), -10, 10), moved)


def abroad(c: Cipher, m: Column) -> Column:
    def moved(s: Column) -> Column:
        return let(bare(s), lambda d: fill(s, F.concat(F.substring(d, 1, 3), c.digits("abroad", F.substring(d, F.lit(4), F.length(d))))))

    return part(m, lambda s: F.length(bare(s)).between(8, 15), moved)


def national(c: Cipher, m: Column) -> Column:
    area, middle, serial = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    rank = area - 1 - (area > 666).cast("int")  # 1..899 without 666
    new = c.permute(F.lit("national"), rank, (middle - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))
    two = lambda n, w: F.lpad(n.cast("string"), w, "0")
    shown = let(new, lambda p: F.concat_ws("-", two(p["l"] + 1 + (p["l"] + 1 >= 666).cast("int"), 3), two(F.floor(p["r"] / 9999) + 1, 2), two(p["r"] % 9999 + 1, 4)))
    return F.when(area.between(1, 899) & (area != 666) & (middle > 0) & (serial > 0), shown)


def ipv4(c: Cipher, m: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("int"))

    def moved(p: Column) -> Column:
        new = c.permute(F.lit("ipv4"), p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536))
        shown = let(new, lambda n: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(n[h] / 256), n[h] % 256)]))
        return F.when(~F.exists(p, lambda x: x > 255), shown)

    return let(parts, moved)


def iban(c: Cipher, m: Column) -> Column:
    def valid(s: Column) -> Column:
        return let(bare(s, "A-Z0-9"), lambda d: F.length(d).between(15, 34) & (mod97(F.concat(F.substring(d, F.lit(5), F.length(d)), F.substring(d, 1, 4))) == 1))

    def moved(s: Column) -> Column:
        def full(d: Column) -> Column:
            country, body = F.substring(d, 1, 2), F.substring(d, F.lit(5), F.length(d))
            # At most 30 characters: two halves, the first at most 20 of them.
            head, tail = F.lower(F.substring(body, 1, 20)), F.lower(F.substring(body, F.lit(21), F.length(body)))
            new = F.upper(F.concat(c.digits("iban", head, 36), F.when(tail == "", "").otherwise(c.digits("iban+", tail, 36))))
            return let(new, lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))

        return fill(s, let(bare(s, "A-Z0-9"), full), "A-Z0-9")

    return part(m, valid, moved)


def date(c: Cipher, m: Column) -> Column:
    block = 270 * 270
    iso = m.contains("-")
    # Day before month; where that is no date, month before day.
    day_first = F.try_to_timestamp(F.translate(m, "/", "."), F.lit("dd.MM.yyyy")).cast("date")
    month_first = F.try_to_timestamp(F.translate(m, "/", "."), F.lit("MM.dd.yyyy")).cast("date")
    read = F.when(iso, F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).cast("date")).otherwise(F.coalesce(day_first, month_first))

    def moved(d: Column) -> Column:
        days = F.datediff(d, F.lit("1900-01-01").cast("date"))
        inside = F.pmod(days, F.lit(block))
        new = c.permute(F.lit("date"), F.floor(inside / 270), inside % 270, F.lit(270), F.lit(270))
        at = let(new, lambda n: F.date_add(F.lit("1900-01-01").cast("date"), (F.floor(days / block) * block + n["l"] * 270 + n["r"]).cast("int")))
        form = lambda a: F.when(iso, F.date_format(a, "yyyy-MM-dd")).when(day_first.isNotNull(), F.date_format(a, "dd.MM.yyyy")).otherwise(F.date_format(a, "MM.dd.yyyy"))
        return F.when(days.between(0, 5 * block - 1), let(at, lambda a: fill(m, bare(form(a)))))

    return let(read, moved)


def mail(c: Cipher, m: Column) -> Column:
    local, rest = F.substring_index(m, "@", 1), F.concat(F.lit("@"), F.substring_index(m, "@", -1))
    chars = bare(F.lower(local), "a-z0-9")
    # Up to 64 characters, in pieces of at most 20.
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(chars) - 1) / 20).cast("int")), lambda i: c.digits("mail", F.substring(chars, i * 20 + 1, F.lit(20)), 36))
    return F.concat(fill(F.lower(local), F.array_join(pieces, ""), "a-z0-9"), rest)


KINDS = {"mail": (MAIL, mail), "ipv4": (IPV4, ipv4), "iban": (IBAN, iban), "card": (CARD, card), "phone": (PHONE, phone), "abroad": (ABROAD, abroad), "national": (NATIONAL, national), "date": (DATE, date)}


def found_by(kind: str, m: Column) -> Column:
    return m.rlike(f"^(?:{KINDS[kind][0]})$")


def pseudonym(m: Column, cipher: Cipher, kinds: tuple[str, ...] = tuple(KINDS)) -> Column:
    """The pseudonym of one match; the match itself where no rule validates it."""
    out = m
    for kind in reversed(kinds):
        out = F.when(found_by(kind, m), F.coalesce(KINDS[kind][1](cipher, m), m)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str = DEFAULT_KEY, text: str = "text", kinds: tuple[str, ...] = tuple(KINDS), decrypt: bool = False) -> DataFrame:
    """``docs`` with all values of ``kinds`` in ``text`` replaced. All columns and rows stay."""
    pattern = "|".join(KINDS[k][0] for k in kinds)
    cipher = Cipher(key, decrypt=decrypt)
    told = F.col(text)
    gaps = F.split(told, pattern, -1)
    found = F.transform(F.regexp_extract_all(told, F.lit(pattern), F.lit(0)), lambda m: pseudonym(m, cipher, kinds))
    joined = F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return docs.withColumn(text, F.when(told.rlike("[0-9@]"), joined).otherwise(told))


def values(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] = tuple(KINDS)) -> Column:
    """The candidates in a text, as an array."""
    return F.regexp_extract_all(F.col(text), F.lit("|".join(KINDS[k][0] for k in kinds)), F.lit(0))
