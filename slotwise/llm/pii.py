"""Format-preserving Feistel pseudonyms for personal data in text.

Numbers and dates that pass their own validation are permuted under a key within their format: a card number stays a
card number with a right check digit, a date a date, an address an address, and separators stay where they were.
Equal values get equal pseudonyms in every document, however they are spaced, and in whichever order a date is written,
so links between documents survive.

| kind | found as | validated by | permuted |
|-|-|-|-|
| email | local@domain | shape | letters and digits of the local part, each within its class |
| ip | dotted IPv4 | each part at most 255 | all 32 bits |
| phone | + and 7 to 14 digits | shape | digits after the country code |
| card | 13 to 19 digits, plain or in groups | Luhn | all but the check digit, which is computed anew |
| ssn | 3-2-4 digits | area, group and serial in use | within the numbers in use |
| iban | country, check digits, account | modulo 97 | the account's digits; the check digits are computed anew |
| date | y-m-d, d.m.y, d/m/y, m/d/y from 1900 to 2099 | calendar | days 1 to 12, and later days, of those 200 years |

What fails its validation stays as it is. Every step is a column expression: matches come from one pattern, the text
between them from a split by the same pattern, and no Python runs on executors. No shuffle is needed.

Null text stays null with no findings; empty text stays empty. Columns besides the text column pass through. The
pattern's branches are bounded and anchored, so time is linear in the length of a text. Rounds use SHA-256 over the
key; keep the key as you would any secret, since whoever has it can undo the pseudonyms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.texts import free_name

ROUNDS = 10
KINDS = ("email", "ip", "phone", "card", "ssn", "iban", "date")

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9+])\+(?:1[ .\-]?\(?[0-9]{3}\)?[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}"
             r"|[2-9][0-9]{7,14}|[2-9][0-9]{0,2}(?:[ .\-]\(?[0-9]{1,9}\)?){1,4})(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}"
            r"|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9./\-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}"
            r"|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![0-9]|[./\-][0-9])",
}
_ORDER = ("email", "date", "ip", "phone", "iban", "ssn", "card")
PATTERN = "|".join(_SHAPES[k] for k in _ORDER)
#: Shapes of a whole match, by which its kind is told again; no two kinds share one.
_WHOLE = {
    "email": r"@", "date": r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\1[0-9]{4})$",
    "ip": r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$", "phone": r"^\+", "iban": r"^[A-Z]", "ssn": r"^[0-9]{3}-",
}
FIRST_YEAR, YEARS = 1900, 200
#: Steps of a date's cycle before a day must be met. Of 228 places of later days in a year at least 221 are days, so a
#: step misses with a chance of 0.03, and all of them with less than 10**-60.
WALK = 40
#: Country codes of one and two digits, all others have three: fixed values of the international numbering plan.
ONE_DIGIT_CODES = ("1", "7")
TWO_DIGIT_CODES = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52",
    "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92",
    "93", "94", "95", "98",
)


def _prf(key: str, tweak: Column, turn: Column, x: Column, bits: int = 60) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), x.cast("string")), 256)
    return F.conv(F.substring(digest, 1, bits // 4), 16, 10).cast("long")


def feistel(a: Column, b: Column, p: Column, q: Column, key: str, tweak: Column) -> Column:
    """Permutes the pairs (a, b) of 0..p-1 and 0..q-1: each turn adds a keyed value of one half to the other."""
    a, b, p, q = (x.cast("long") for x in (a, b, p, q))

    def turn(state: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(
            ((state.a + _prf(key, tweak, i, state.b)) % p).alias("a"), state.b.alias("b"),
        )).otherwise(F.struct(
            state.a.alias("a"), ((state.b + _prf(key, tweak, i, state.a)) % q).alias("b"),
        ))

    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), F.struct(a.alias("a"), b.alias("b")), turn)


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def permute_digits(digits: Column, key: str, tweak: Column) -> Column:
    """A string of 2 to 36 digits as another of the same length."""
    powers = F.array(*(F.lit(10**i).cast("long") for i in range(19)))
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    pair = feistel(
        F.substring(digits, F.lit(1), left), F.substring(digits, left + 1, n - left),
        F.element_at(powers, left + 1), F.element_at(powers, n - left + 1), key, F.concat(tweak, n.cast("string")))
    return _let(pair, lambda s: F.concat(
        F.lpad(s.a.cast("string"), left, "0"), F.lpad(s.b.cast("string"), n - left, "0")))


def _refill(shape: Column, digits: Column) -> Column:
    """`shape` with its digits replaced one by one."""
    def put(state: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(state.out, F.when(is_digit, F.substring(digits, state.n, F.lit(1))).otherwise(c)).alias("out"),
            (state.n + is_digit.cast("int")).alias("n"))

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("n"))
    return F.aggregate(F.split(shape, "(?!^)(?!$)"), start, put, lambda s: s.out)


def luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Sum of the digits, every second one doubled; the parity tells which, counted from the right starting at 0."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when((n - i) % 2 == doubled_from_right, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def mod_97(chars: Column) -> Column:
    """Remainder of the number that digits and letters (A is 10) spell."""
    def add(rest: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.split(chars, "(?!^)(?!$)"), F.lit(0), add)


def _card(match: Column, key: str) -> Column:
    def new(digits: Column) -> Column:
        payload = permute_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, F.lit("card"))
        return _let(payload, lambda p: _refill(match, F.concat(p, ((10 - luhn_sum(p, 0) % 10) % 10).cast("string"))))

    return F.when(luhn_sum(_digits(match), 1) % 10 == 0, _let(_digits(match), new))


def _phone(match: Column, key: str) -> Column:
    digits_only = _digits(match)
    code = (F.when(F.substring(digits_only, 1, 1).isin(*ONE_DIGIT_CODES), F.lit(1))
            .when(F.substring(digits_only, 1, 2).isin(*TWO_DIGIT_CODES), F.lit(2)).otherwise(F.lit(3)))

    def new(digits: Column) -> Column:
        country = F.substring(digits, F.lit(1), code)
        rest = F.substring(digits, code + 1, F.length(digits) - code)
        return _refill(match, F.concat(country, permute_digits(rest, key, F.concat(F.lit("phone"), country))))

    return F.when(F.length(_digits(match)).between(8, 15), _let(_digits(match), new))


def _ip(match: Column, key: str) -> Column:
    part = F.split(match, r"\.")
    byte = lambda i: part[i].cast("long")
    pair = feistel(byte(0) * 256 + byte(1), byte(2) * 256 + byte(3), F.lit(65536), F.lit(65536), key, F.lit("ip"))
    return _let(pair, lambda s: F.concat_ws(".", *(x.cast("string") for x in (
        F.shiftright(s.a, 8), s.a % 256, F.shiftright(s.b, 8), s.b % 256))))


def _ssn(match: Column, key: str) -> Column:
    part = F.split(match, "-")
    area, group, serial = (part[i].cast("long") for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    pair = feistel((area - 1 - (area > 666).cast("int")) * 99 + group - 1, serial - 1,
                   F.lit(898 * 99), F.lit(9999), key, F.lit("ssn"))

    def text(s: Column) -> Column:
        rank = F.floor(s.a / 99) + 1
        return F.concat_ws("-", F.lpad((rank + (rank > 665).cast("int")).cast("string"), 3, "0"),
                           F.lpad((s.a % 99 + 1).cast("string"), 2, "0"), F.lpad((s.b + 1).cast("string"), 4, "0"))

    return F.when(valid, _let(pair, text))


def _iban(match: Column, key: str) -> Column:
    plain = F.replace(match, F.lit(" "), F.lit(""))
    country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain) - 4)
    valid = F.length(plain).between(15, 34) & (F.length(_digits(account)) >= 2) & (
        mod_97(F.concat(account, F.substring(plain, 1, 4))) == 1)

    def new(digits: Column) -> Column:
        def check(filled: Column) -> Column:
            rest = F.lpad((98 - mod_97(F.concat(filled, country, F.lit("00")))).cast("string"), 2, "0")
            return _refill(match, F.concat(rest, digits))
        return _let(_refill(account, digits), check)

    return F.when(valid, _let(permute_digits(_digits(account), key, F.concat(F.lit("iban"), country)), new))


def _date(match: Column, key: str) -> Column:
    """Day first where the middle part can be a month, else month first between slashes.

    Every notation is read as a day before it is permuted, so equal days stay linked. Days up to the 12th go to such
    days and later ones to later ones: a date that could only be read month first can be read no other way afterwards.
    Months have ends of their own, so a step that leads to no day is followed by the next one of its cycle.
    """
    iso, mark = match.rlike("^[0-9]{4}"), F.substring(match, 3, 1)
    x, y = F.substring(match, 1, 2), F.substring(match, 4, 2)
    american = ~iso & (mark == "/") & y.between("13", "31")

    def calendar(year: Column, month: Column, day: Column) -> Column:
        return F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-MM-dd")).cast("date")

    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = F.when(iso, F.try_to_timestamp(match, F.lit("yyyy-MM-dd")).cast("date")).otherwise(calendar(
        F.substring(match, 7, 4), F.when(american, x).otherwise(y), F.when(american, y).otherwise(x)))

    def moved(d: Column) -> Column:
        low = F.dayofmonth(d) <= 12
        first, span = F.when(low, 1).otherwise(13), F.when(low, 12).otherwise(19)

        def step(s: Column, _: Column) -> Column:
            pair = feistel(s.a, s.b, span * 12, F.lit(YEARS), key, F.concat(F.lit("date"), span.cast("string")))
            return F.when(s.day.isNotNull(), s).otherwise(_let(pair, lambda t: F.struct(
                t.a.alias("a"), t.b.alias("b"), calendar(
                    (t.b + FIRST_YEAR).cast("string"), two(F.floor(t.a / span) + 1), two(t.a % span + first)).alias("day"))))

        start = F.struct(((F.month(d) - 1) * span + F.dayofmonth(d) - first).cast("long").alias("a"),
                         (F.year(d) - FIRST_YEAR).cast("long").alias("b"), F.lit(None).cast("date").alias("day"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, step, lambda s: s.day)

    def text(d: Column) -> Column:
        day_first = [F.date_format(d, part) for part in ("dd", "MM", "yyyy")]
        return F.when(iso, F.date_format(d, "yyyy-MM-dd")).when(
            american, F.date_format(d, "MM/dd/yyyy")).otherwise(F.concat_ws("", day_first[0], mark, day_first[1], mark, day_first[2]))

    return F.when(day.isNotNull(), _let(_let(day, moved), text))


def _shift(half: Column, other: Column, turn: Column, key: str) -> Column:
    """Moves each letter and digit within its class by keyed values of the other half."""
    def moved(c: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), turn.cast("string"),
                                    F.floor(i / 16).cast("string"), other), 256)
        by = F.conv(F.substring(digest, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        put = lambda first, n: F.char(F.lit(first) + (F.ascii(c) - first + by) % n)
        return (F.when(c.rlike("[0-9]"), put(48, 10)).when(c.rlike("[a-z]"), put(97, 26))
                .when(c.rlike("[A-Z]"), put(65, 26)).otherwise(c))

    return F.array_join(F.transform(F.split(half, "(?!^)(?!$)"), moved), "")


def _email(match: Column, key: str) -> Column:
    local, domain = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    left = F.floor(F.length(local) / 2).cast("int")
    start = F.struct(F.substring(local, F.lit(1), left).alias("a"),
                     F.substring(local, left + 1, F.length(local) - left).alias("b"))

    def turn(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(s.a.alias("a"), _shift(s.b, s.a, i, key).alias("b"))).otherwise(
            F.struct(_shift(s.a, s.b, i, key).alias("a"), s.b.alias("b")))

    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), start, turn,
                       lambda s: F.concat(s.a, s.b, F.lit("@"), domain))


def pseudonym(match: Column, key: str) -> Column:
    """A struct of `kind` (null where validation fails) and `value`, of one match of PATTERN."""
    makers = {"email": _email, "date": _date, "ip": _ip, "phone": _phone, "iban": _iban, "ssn": _ssn}
    kind, value = F, F
    for name, make in makers.items():
        kind = kind.when(match.rlike(_WHOLE[name]), F.lit(name))
        value = value.when(match.rlike(_WHOLE[name]), make(match, key))
    found = F.struct(kind.otherwise("card").alias("kind"), value.otherwise(_card(match, key)).alias("value"))
    return _let(found, lambda f: F.struct(
        F.when(f.value.isNotNull(), f.kind).alias("kind"), F.coalesce(f.value, match).alias("value")))


def _equals(kind: str):
    return lambda x: x == kind


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`docs` with personal data in `text` replaced, and `pii_<kind>` counts of what was found (0 for null text).

    Columns that have such a name already are replaced.
    """
    source = F.col(text)
    found = F.when(source.rlike("[0-9@]"), F.regexp_extract_all(source, F.lit(PATTERN), F.lit(0)))
    held = free_name(docs, "_pii")
    marked = docs.withColumn(held, F.transform(found, lambda m: pseudonym(m, key)))
    between = F.split(source, PATTERN, -1)
    joined = F.when(F.size(held) > 0, F.concat(
        F.array_join(F.transform(held, lambda m, i: F.concat(between[i], m.value)), ""),
        F.element_at(between, -1))).otherwise(source)
    kinds = F.coalesce(F.transform(held, lambda m: m.kind), F.array().cast("array<string>"))
    counts = {f"pii_{k}": F.size(F.filter(kinds, _equals(k))) for k in KINDS}
    return marked.withColumns(counts).withColumn(text, joined).drop(held)
