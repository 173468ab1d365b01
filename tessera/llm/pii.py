"""Format-preserving pseudonyms for personal data, in SQL expressions only.

Texts are cut at matches of one pattern; each match is validated for its kind
(Luhn, ranges, calendar, mod 97) and, if valid, its value is permuted within its
format by a keyed Feistel network, so equal values stay equal in all documents,
different ones stay different, and the format stays valid.  What does not
validate is left as it is.

The network is additive: (a, b) with moduli (p, q); even rounds add a keyed hash
of b to a modulo p, odd rounds one of a to b modulo q.  That permutes all p * q
values for any moduli, so no value needs walking back into its format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: A secret stands after one of these words, any blanks and one of = and :, or after one of
#: the words of a header; a name in quotes, as in JSON, is one, too.
_NAMED = r"(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?[ \t]*+[=:]"
_HEADER = r"(?i:bearer|basic)[ \t]++(?=[A-Za-z0-9._~+/=-]{16})(?=[A-Za-z._~+/-]{0,200}[0-9=])"

#: Characters of a secret but the last, and the last one: closing marks do not belong to it.
_INNER, _LAST = r"[^\s\"'<>,;&]", r"[^\s\"'<>,;&.:!?)\]}]"

#: What must stand between name and value, and follow, for it to be a secret: in quotes 6
#: characters; after = 12; else 16, or 8 with a digit.
_LONG = "|".join((
    r"[ \t]*+[\"'](?=" + _INNER + r"{6,}+[\"'])",
    r"(?<==)[ \t]*+[\"']?(?=" + _INNER + "{12})",
    r"[ \t]*+[\"']?(?=" + _INNER + r"{16}|(?=[^0-9\s]{0,15}[0-9])" + _INNER + "{8})",
))

_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"

#: Characters of the part of an e-mail address before the @, and of its domain's labels.
_LOCAL, _LABEL = r"[\p{L}\p{M}\p{N}._%+-]", r"[\p{L}\p{N}-]"

#: kind -> pattern, in the order in which they are tried at a place.  Loops without
#: an upper limit are possessive or of one character class, so that matching takes
#: linear time and no stack.
KINDS = {
    "secret": "(?:" + _NAMED + "(?:" + _LONG + ")|" + _HEADER + ")(" + _INNER + "*" + _LAST + ")",
    "email": r"(?<!" + _LOCAL + ")" + _LOCAL + r"++@(?=[\p{N}.-]*+\p{L})" + _LABEL + r"++(?:\." + _LABEL + r"++)++",
    "iban": _EDGE + r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)" + _END,
    "ip": r"(?<![\p{L}\p{N}.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[\p{L}\p{N}])",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "date": _EDGE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})" + _END,
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "card": r"(?<![\p{L}\p{N}+.-])(?:[0-9]{13,19}|[0-9]{4}(?<x>[ -])[0-9]{4}\k<x>[0-9]{4}\k<x>[0-9]{1,7}|[0-9]{4}(?<y>[ -])[0-9]{6}\k<y>[0-9]{5})(?![\p{L}\p{N}])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}|(?<![\p{L}\p{N}.-])(?:(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}|0[0-9]{2,4}[ -][0-9]{3,4}[ -][0-9]{3,4}))(?![\p{L}\p{N}])",
}


def _pattern() -> str:
    """All kinds; group 1 is the secret, if one matched: what stands before it is part of the match."""
    return "|".join(f"(?:{p})" for p in KINDS.values())


def _hash(key: str, kind: Column, i: Column, x: Column) -> Column:
    """60 keyed bits."""
    text = F.concat_ws("|", F.lit(key), kind, i.cast("string"), x.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, p: Column, q: Column, key: str, kind: Column) -> Column:
    """(a, b) permuted within 0..p-1 and 0..q-1, both of at most 18 digits."""

    def turn(s: Column, i: Column) -> Column:
        even = F.struct(((s["a"] + _hash(key, kind, i, s["b"])) % p).alias("a"), s["b"].alias("b"))
        odd = F.struct(s["a"].alias("a"), ((s["b"] + _hash(key, kind, i, s["a"])) % q).alias("b"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _digits(d: Column, key: str, kind: str) -> Column:
    """A string of 2 to 36 digits, permuted within its length."""
    n = F.length(d)
    k = F.floor(n / 2).cast("int")

    def joined(s: Column) -> Column:
        return F.concat(F.lpad(s["a"].cast("string"), k, "0"), F.lpad(s["b"].cast("string"), n - k, "0"))

    # an array of one, so that the network is evaluated once and used twice
    net = feistel(F.substr(d, F.lit(1), k), F.substr(d, k + 1, n - k), _ten(k), _ten(n - k), key, F.concat_ws(":", F.lit(kind), n.cast("string")))
    return F.get(F.transform(F.array(net), joined), F.lit(0))


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _into(m: Column, d: Column, skip: Column) -> Column:
    """m with its digits, after the first ``skip``, replaced by those of d in turn."""

    def at(i: Column) -> Column:
        c = F.substr(m, i, F.lit(1))
        k = F.length(_only_digits(F.substr(m, F.lit(1), i))) - skip
        return F.when(c.rlike("[0-9]") & (k > 0), F.substr(d, k, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), at), "")


def _luhn(payload: Column) -> Column:
    """The check digit that follows these digits."""
    n = F.length(payload)

    def add(s: Column, i: Column) -> Column:
        d = F.substr(payload, i, F.lit(1)).cast("int")
        two = d * 2
        return s + F.when((n - i) % 2 == 0, F.when(two > 9, two - 9).otherwise(two)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return ((F.lit(10) - total % 10) % 10).cast("string")


def _card(m: Column, key: str) -> Column:
    d = _only_digits(m)
    n = F.length(d)
    new = F.concat(F.substr(d, F.lit(1), F.lit(1)), _digits(F.substr(d, F.lit(2), n - 2), key, "card"))
    with_check = F.get(F.transform(F.array(new), lambda p: F.concat(p, _luhn(p))), F.lit(0))
    valid = n.between(13, 19) & (_luhn(F.substr(d, F.lit(1), n - 1)) == F.substr(d, n, F.lit(1)))
    return F.when(valid, _into(m, with_check, F.lit(0))).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    d = _only_digits(m)
    # the country code, or a leading 0, stays
    code = F.when(m.startswith("0"), F.lit(1)).when(m.startswith("+"), F.length(F.regexp_extract(m, r"^\+([0-9]{1,3}?)(?:[ .(-]|(?=[0-9]{8,}$))", 1))).otherwise(F.lit(0))
    rest = F.substr(d, code + 1, F.length(d) - code)
    return F.when(F.length(d).between(7, 15) & (F.length(rest) >= 6), _into(m, _digits(rest, key, "phone"), code)).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    wide = F.lit(65536).cast("long")
    net = feistel(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), wide, wide, key, F.lit("ip"))

    def dotted(s: Column) -> Column:
        return F.concat_ws(".", F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)

    return F.when(F.forall(o, lambda x: x <= 255), F.get(F.transform(F.array(net), dotted), F.lit(0))).otherwise(m)


def _ipv6(m: Column, key: str) -> Column:
    """Each group of hexadecimal digits is permuted within its length, by its place; at
    least three groups and a decimal digit make an address."""
    sixteen = F.lit(16.0)

    def group(x: Column, i: Column) -> Column:
        k = F.length(x)
        low = F.pow(sixteen, k - F.floor(k / 2)).cast("long")
        value = F.conv(x, 16, 10).cast("long")
        net = feistel(F.floor(value / low), value % low, F.pow(sixteen, F.floor(k / 2)).cast("long"), low, key, F.concat_ws(":", F.lit("ipv6"), i.cast("string"), k.cast("string")))
        shown = F.get(F.transform(F.array(net), lambda s: F.lpad(F.lower(F.hex(s["a"] * low + s["b"])), k, "0")), F.lit(0))
        return F.when(k > 0, shown).otherwise(x)

    groups = F.split(m, ":")
    new = F.array_join(F.transform(groups, group), ":")
    real = (F.size(F.filter(groups, lambda x: x != "")) >= 3) & m.rlike("[0-9]")
    return F.when(real, F.when(m == F.lower(m), new).otherwise(F.upper(new))).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999: 898 * 99 * 9999 values."""
    area, group, serial = (F.substr(m, F.lit(i), F.lit(n)).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    net = feistel(F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), key, F.lit("ssn"))

    def dashed(s: Column) -> Column:
        a = F.when(s["a"] >= 665, s["a"] + 2).otherwise(s["a"] + 1)
        parts = ((a, 3), (F.floor(s["b"] / 9999) + 1, 2), (s["b"] % 9999 + 1, 4))
        return F.concat_ws("-", *(F.lpad(x.cast("string"), n, "0") for x, n in parts))

    return F.when(valid, F.get(F.transform(F.array(net), dashed), F.lit(0))).otherwise(m)


#: Spans of days that are permuted each within itself: first day, and two factors of their number.
_SPANS = (("1900-01-01", 150, 487), ("2100-01-02", 2, 1_442_707), ("0001-01-01", 35, 19_817))


def _date(m: Column, key: str) -> Column:
    """ISO dates, with slashes too, day.month.year, and day/month/year or else month/day/year.

    Dates from 1900 to 2100 stay there, as do earlier and later ones in their span."""
    styles = [(m.contains("-"), "yyyy-MM-dd"), (m.contains("."), "dd.MM.yyyy"), (m.rlike("^[0-9]{4}"), "yyyy/MM/dd"), (F.try_to_timestamp(m, F.lit("dd/MM/yyyy")).isNotNull(), "dd/MM/yyyy"), (F.lit(True), "MM/dd/yyyy")]

    def by_style(use) -> Column:
        out = F
        for style, form in styles:
            out = out.when(style, use(form))
        return out

    day = by_style(lambda form: F.try_to_timestamp(m, F.lit(form))).cast("date")

    def shown(x: Column) -> Column:
        return by_style(lambda form: F.date_format(x, form))

    def of_span(values: list, kind: str) -> Column:
        late, early = (F.lit(_SPANS[i][0]).cast("date") for i in (1, 0))
        a, b, c = (F.lit(v).cast(kind) for v in values)
        return F.when(day >= late, b).when(day >= early, a).otherwise(c)

    first, p, q = of_span([x[0] for x in _SPANS], "date"), of_span([x[1] for x in _SPANS], "long"), of_span([x[2] for x in _SPANS], "long")
    n = F.datediff(day, first).cast("long")
    net = feistel(F.floor(n / q), n % q, p, q, key, of_span(["date", "date after", "date before"], "string"))
    moved = F.transform(F.array(net), lambda s: shown(F.date_add(first, (s["a"] * q + s["b"]).cast("int"))))
    return F.when(n.between(0, p * q - 1), F.get(moved, F.lit(0))).otherwise(m)


def _mod97(s: Column) -> Column:
    """Letters count as 10..35, written out in digits."""

    def add(r: Column, i: Column) -> Column:
        c = F.ascii(F.substr(s, i, F.lit(1)))
        return F.when(c >= 65, (r * 100 + c - 55) % 97).otherwise((r * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    """Blanks between groups stay where they are."""
    bban, country = F.substr(m, F.lit(5), F.length(m) - 4), F.substr(m, F.lit(1), F.lit(2))
    d = _only_digits(bban)
    new = _into(bban, _digits(d, key, "iban"), F.lit(0))

    def tight(x: Column) -> Column:
        return F.replace(x, F.lit(" "), F.lit(""))

    def checked(b: Column) -> Column:
        return F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(tight(b), country, F.lit("00")))).cast("string"), 2, "0"), b)

    valid = (_mod97(F.concat(tight(bban), F.substr(m, F.lit(1), F.lit(4)))) == 1) & (F.length(d) >= 4)
    return F.when(valid, F.get(F.transform(F.array(new), checked), F.lit(0))).otherwise(m)


def _email(m: Column, key: str) -> Column:
    """A name of 16 keyed letters and digits at a domain that cannot exist."""
    return F.concat(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@example.invalid"))


def _secret(m: Column, key: str) -> Column:
    """A secret of the same length, of hexadecimal digits."""
    h = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), m), 256)
    return F.substr(F.repeat(h, F.ceil(F.length(m) / 64).cast("int")), F.lit(1), F.length(m))


_WAYS = {"email": _email, "iban": _iban, "ip": _ip, "ipv6": _ipv6, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def pseudonym(m: Column, key: str, secret: Column) -> Column:
    """The replacement of one match; ``secret``: the end of it that is one, or "".

    The other kinds differ in form, so a match tells its kind."""
    out = F.when(secret != "", F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(secret)), _secret(secret, key)))
    for kind, way in _WAYS.items():
        out = out.when(m.rlike(f"^(?:{KINDS[kind]})$"), way(m, key))
    return out.otherwise(m)


#: Characters that no text holds, as a rule: they mark matches, and secrets in them.
_MARK, _INSIDE = "\ufdd0", "\ufdd1"


def pseudonymise(text: Column, key: str) -> Column:
    """text with every validated match replaced; null stays null.

    Texts without a digit, an @ or a secret's name are not searched further.  A text that is one
    match, and matches next to each other, are handled like any other.  Matches are marked
    in one pass of the pattern; texts that hold the marks themselves are cut at the
    matches instead, which takes three.
    """
    named = text.rlike(_NAMED + "|" + _HEADER)
    marked = F.split(F.regexp_replace(text, _pattern(), f"{_MARK}$0{_INSIDE}$1{_MARK}"), _MARK, -1)

    def turned(x: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, x).otherwise(pseudonym(F.substring_index(x, _INSIDE, 1), key, F.substring_index(x, _INSIDE, -1)))

    joined = F.array_join(F.transform(marked, turned), "")
    return F.when(text.rlike("[0-9@]") | named, F.when(text.contains(_MARK) | text.contains(_INSIDE), _cut(text, key)).otherwise(joined)).otherwise(text)


def _cut(text: Column, key: str) -> Column:
    """The same, by cutting the text at its matches."""
    p = F.lit(_pattern())
    found, secret = (F.regexp_extract_all(text, p, F.lit(i)) for i in (0, 1))
    new = F.concat(F.zip_with(found, secret, lambda m, s: pseudonym(m, key, s)), F.array(F.lit("")))
    between = F.split(text, _pattern(), -1)
    return F.array_join(F.flatten(F.zip_with(between, new, lambda a, b: F.array(a, b))), "")


def replace_personal_data(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """docs with ``column`` pseudonymised, all other columns as they are.

    Null and empty texts stay; repeated rows get equal results; an empty table
    stays empty.  Nothing is shuffled, and no row depends on another.
    """
    return docs.withColumn(column, pseudonymise(F.col(column).cast("string"), key))
