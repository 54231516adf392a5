"""Format-preserving pseudonyms by keyed Feistel networks, in DataFrame functions only.

Personal numbers are found by one pattern, validated (Luhn, mod 97, octets, calendar, area
rules) and replaced by a keyed permutation of their own format, so that equal values get equal
pseudonyms in every document and different values different ones:

* strings of digits, hexadecimal digits, or letters and digits: a Feistel network over the two
  halves of the string; each round adds a keyed stream, drawn from the other half, to every
  character modulo its alphabet;
* addresses of four octets, dates and social security numbers: a Feistel network over a pair
  of residues whose moduli multiply to exactly the number of valid values
  (65536 x 65536; 189 x 773 days, which is one 400-year cycle, and 93 x 1567 days of the years 1 to
  199 and 9800 to 9999, which fill no cycle; 898 x 989901).

Cards keep a valid Luhn digit and bank accounts valid check digits; separators, letter case,
country codes and the domains of e-mail addresses stay. Numbers that fail validation stay as
they are, and so do dates with a year of two digits or a month in words, seven-digit phone numbers, and
ten digits without separators. The caller must give ``key`` and keep it
secret; who doesn't know it can't invert pseudonyms. The registered query and the pipeline use TEST_KEY, which
is public and protects nothing.

Edge cases: null text stays null (0 found), empty text stays empty; a text of any length is
searched whole; repeated rows get equal results; an empty table gives an empty result; input
columns named like an internal or result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, without

ROUNDS = 8
#: For the registered queries over synthetic tables only.
TEST_KEY = "a public key for tests"
DIGITS, HEX, LETTERS = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)",
    "ipv4": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "date": r"(?<![\w/.-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+[2-9]\d{0,2}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)"
    r"|(?<![\w(+-])\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\w)|(?<![\w.-])\d{3}([-. ])\d{3}\2\d{4}(?![\w-])",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}([ -])\d{4}\3\d{4}\3\d{1,7}|\d{4}([ -])\d{6}\4\d{5})(?![\w-])",
}
#: Part of every match of every pattern: a digit, an at sign, or a secret of letters only.
POSSIBLE = "[0-9@]|[a-f]{32}|[A-F]{32}"
ANY = "(" + "|".join(PATTERNS.values()) + ")"
_BASE_DAY = "1800-01-01"
_CYCLE = 146097  # days of 400 years = 189 * 773
#: Years outside whole cycles: 0001 to 0199 and 9800 to 9999, 93 * 1567 days.
_LATE, _LATE_DAYS = "9800-01-01", 73048
_EDGE_SHIFT = 3652059  # puts 0001-01-01 after 9999-12-31
_M, _T = "__pii_found", "__pii_text"


def _stream(key: str, kind: str, round_: Column, other: Column) -> Column:
    """256 hexadecimal digits drawn from the other half."""
    first = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), other), 512)
    return F.transform(F.array(first), lambda h: F.concat(h, F.sha2(F.concat(h, F.lit("+")), 512)))[0]


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def _add(half: Column, stream: Column, hexadecimal: bool) -> Column:
    """Every character of ``half`` plus its part of the stream, modulo its alphabet."""

    def one(c: Column, i: Column) -> Column:
        def moved(alphabet: str) -> Column:
            at = F.pmod(F.instr(F.lit(alphabet), c) - 1 + _number(F.substr(stream, 4 * i + 1, F.lit(4))), F.lit(len(alphabet)))
            return F.substr(F.lit(alphabet), (at + 1).cast("int"), F.lit(1))

        return moved(HEX) if hexadecimal else F.when(c.between("0", "9"), moved(DIGITS)).otherwise(moved(LETTERS))

    return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), one), "")


def permute_string(core: Column, key: str, kind: str, hexadecimal: bool = False) -> Column:
    """A keyed permutation of the lower-case strings with the same classes of characters."""
    left = F.floor(F.length(core) / 2).cast("int")
    start = F.struct(F.substr(core, F.lit(1), left).alias("a"), F.substr(core, left + 1, F.length(core)).alias("b"))

    def step(acc: Column, i: Column) -> Column:
        return F.when(
            i % 2 == 0, F.struct(_add(acc["a"], _stream(key, kind, i, acc["b"]), hexadecimal).alias("a"), acc["b"].alias("b"))
        ).otherwise(F.struct(acc["a"].alias("a"), _add(acc["b"], _stream(key, kind, i, acc["a"]), hexadecimal).alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["a"], acc["b"]))


def permute_pair(left: Column, right: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of Z_a x Z_b: a struct of l and r."""

    def drawn(i: Column, x: Column) -> Column:
        return _number(F.substr(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), x.cast("string")), 256), F.lit(1), F.lit(12)))

    def step(acc: Column, i: Column) -> Column:
        return F.when(
            i % 2 == 0, F.struct(F.pmod(acc["l"] + drawn(i, acc["r"]), F.lit(a).cast("long")).alias("l"), acc["r"].alias("r"))
        ).otherwise(F.struct(acc["l"].alias("l"), F.pmod(acc["r"] + drawn(i, acc["l"]), F.lit(b).cast("long")).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _bound(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once."""
    return F.transform(F.array(value), fn)[0]


def _refill(shape: Column, core: Column, kept: str) -> Column:
    """Characters of ``core`` at the places of ``shape`` whose characters match ``kept``, in their case."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        new = F.substr(core, acc["j"] + 1, F.lit(1))
        return F.when(
            c.rlike(kept),
            F.struct(F.concat(acc["s"], F.when(c.rlike("[A-Z]"), F.upper(new)).otherwise(new)).alias("s"), (acc["j"] + 1).alias("j")),
        ).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["j"].alias("j")))

    return F.aggregate(chars, F.struct(F.lit("").alias("s"), F.lit(0).alias("j")), step, lambda acc: acc["s"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        v = F.substr(digits, i, F.lit(1)).try_cast("int")
        w = F.when(F.pmod(n - i, F.lit(2)) == 1, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v)
        return acc + w

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def mod97(text: Column) -> Column:
    """A string of digits and capital letters (A = 10 ... Z = 35) modulo 97."""

    def add(acc: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.when(digit, F.pmod(acc * 10 + c.try_cast("long"), F.lit(97))).otherwise(F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97))).cast("long")

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), add)


def _email(m: Column, key: str) -> Column:
    local, rest = F.substring_index(m, "@", 1), F.substr(m, F.instr(m, "@"))
    core = F.lower(F.regexp_replace(local, "[^A-Za-z0-9]", ""))
    return F.concat(_bound(permute_string(core, key, "email"), lambda p: _refill(local, p, "[A-Za-z0-9]")), rest)


def _secret(m: Column, key: str) -> Column:
    return _bound(permute_string(F.lower(m), key, "secret", True), lambda p: F.when(m.rlike("[A-F]"), F.upper(p)).otherwise(p))


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country = F.substr(plain, F.lit(1), F.lit(2))
    valid = mod97(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))) == 1

    def checked(p: Column) -> Column:
        check = F.lpad((98 - mod97(F.concat(p, country, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(country, check, p)

    new = _bound(F.upper(permute_string(F.lower(F.substr(plain, F.lit(5))), key, "iban")), checked)
    return F.when(valid, _bound(new, lambda p: _refill(m, p, "[A-Z0-9]")))


def _ipv4(m: Column, key: str) -> Column:
    o = F.split(m, "\\.")
    part = lambda i: F.get(o, F.lit(i)).try_cast("long")
    new = permute_pair(part(0) * 256 + part(1), part(2) * 256 + part(3), 65536, 65536, key, "ipv4")
    text = lambda v: F.concat_ws(".", F.floor(v / 256).cast("string"), F.pmod(v, F.lit(256)).cast("string"))
    return _bound(new, lambda p: F.concat_ws(".", text(p["l"]), text(p["r"])))


def _date(m: Column, key: str) -> Column:
    def of(fmt: str) -> Column:
        day = F.datediff(F.try_to_date(m, fmt), F.lit(_BASE_DAY).cast("date"))

        def moved(d: Column) -> Column:
            cycle, r = F.floor(d / _CYCLE), F.pmod(d, F.lit(_CYCLE))
            new = permute_pair(F.floor(r / 773), F.pmod(r, F.lit(773)), 189, 773, key, "date")
            out = _bound(new, lambda p: F.date_format(F.date_add(F.lit(_BASE_DAY).cast("date"), (cycle * _CYCLE + p["l"] * 773 + p["r"]).cast("int")), fmt))
            whole = (cycle >= -4) & (cycle <= 19)
            late = F.datediff(F.lit(_BASE_DAY).cast("date"), F.lit(_LATE).cast("date")) + d
            edge = F.when(late >= 0, late).otherwise(late + _EDGE_SHIFT)
            pair = permute_pair(F.floor(edge / 1567), F.pmod(edge, F.lit(1567)), 93, 1567, key, "date-edge")
            at = lambda e: F.when(e < _LATE_DAYS, F.date_add(F.lit(_LATE).cast("date"), e)).otherwise(F.date_add(F.lit("0001-01-01").cast("date"), e - _LATE_DAYS))
            ends = _bound(pair, lambda p: F.date_format(at((p["l"] * 1567 + p["r"]).cast("int")), fmt))
            return F.when(whole, out).otherwise(ends)

        return _bound(day, moved)

    full = F.length(m) == 10  # else a day or month of one digit
    return (
        F.when(m.contains("-"), F.when(full, of("yyyy-MM-dd")).otherwise(of("yyyy-M-d")))
        .when(m.contains("."), F.when(full, of("dd.MM.yyyy")).otherwise(of("d.M.yyyy")))
        .when(full, F.coalesce(of("MM/dd/yyyy"), of("dd/MM/yyyy")))
        .otherwise(F.coalesce(of("M/d/yyyy"), of("d/M/yyyy")))
    )


def _ssn(m: Column, key: str) -> Column:
    part = lambda a, n: F.substr(m, F.lit(a), F.lit(n)).try_cast("long")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    valid = area.between(1, 899) & (area != 666) & (group >= 1) & (serial >= 1)
    new = permute_pair(area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")

    def text(p: Column) -> Column:
        a = p["l"] + 1 + F.when(p["l"] >= 665, 1).otherwise(0)
        pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
        return F.concat_ws("-", pad(a, 3), pad(F.floor(p["r"] / 9999) + 1, 2), pad(F.pmod(p["r"], F.lit(9999)) + 1, 4))

    return F.when(valid, _bound(new, text))


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    head = F.when(m.startswith("+"), F.greatest(F.length(d) - 10, F.lit(1))).otherwise(0)
    new = F.concat(F.substr(d, F.lit(1), head), permute_string(F.substr(d, head + 1), key, "phone"))
    return F.when(F.length(d).between(8, 15), _bound(new, lambda p: _refill(m, p, "[0-9]")))


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    body = permute_string(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
    check = lambda p: F.concat(p, F.pmod(10 - F.pmod(luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))
    return F.when(F.pmod(luhn_sum(d), F.lit(10)) == 0, _bound(_bound(body, check), lambda p: _refill(m, p, "[0-9]")))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match, or null where it fails validation."""
    whole = lambda k: "^(?:" + PATTERNS[k].replace(r"\2", r"\1").replace(r"\3", r"\1").replace(r"\4", r"\2") + ")$"
    return (
        F.when(m.contains("@"), _email(m, key))
        .when(m.rlike(whole("secret")), _secret(m, key))
        .when(m.rlike(whole("iban")), _iban(m, key))
        .when(m.rlike(whole("ipv4")), _ipv4(m, key))
        .when(m.rlike(whole("date")), _date(m, key))
        .when(m.rlike(whole("ssn")), _ssn(m, key))
        .when(m.rlike(whole("phone")), _phone(m, key))
        .otherwise(_card(m, key))
    )


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``; ``found_col`` adds the number of replaced values."""
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.col(f"`{text_col}`")
    names = [c for c in docs.columns if c.lower() not in {_M, _T, (found_col or "").lower()}]
    rows = without(docs, [_M, _T, found_col or ""])
    found = rows.withColumn(_M, F.when(text.rlike(POSSIBLE), F.regexp_extract_all(text, F.lit(ANY), F.lit(1))))
    new = F.transform(F.col(_M), lambda m: F.struct(m.alias("m"), pseudonym(m, key).alias("p")))
    found = found.withColumn(_M, F.when(F.size(_M) > 0, new))
    gaps = F.split(text, ANY, -1)
    joined = F.array_join(
        F.zip_with(gaps, F.col(_M), lambda g, x: F.concat(g, F.coalesce(x["p"], x["m"], F.lit("")))), ""
    )
    out = found.withColumn(_T, F.when(F.col(_M).isNotNull(), joined).otherwise(text))
    extra = [F.coalesce(F.size(F.filter(F.col(_M), lambda x: x["p"].isNotNull())), F.lit(0)).cast("long").alias(found_col)] if found_col else []
    return out.select(*[F.col(_T).alias(c) if c == text_col else F.col(f"`{c}`") for c in names], *extra)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: pseudonymised texts of all documents and the number of values replaced."""
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), TEST_KEY, found_col="n_replaced")
