"""Format-preserving Feistel pseudonyms for personal numbers, dates, addresses and secrets.

A text is cut at one pattern; each find is told its kind and validated (Luhn digit, remainder modulo 97, octets, calendar,
issued number ranges), and only what is valid is replaced. The replacement is a keyed permutation of the kind's own value
space: a ten-round Feistel network over a pair of numbers (mixed radix, so that nothing falls outside) or, for addresses, accounts
and secrets, over the two halves of the characters, each staying in its class. Check digits are worked out again, number
ranges kept by walking the cycle. So equal values get equal pseudonyms in every document, however they are parted, different
ones stay different, pseudonyms are valid where the values were, and the key's owner can reverse them (``reveal``).

Kinds: payment cards (also parted 4-4-4-4 and 4-6-5), US social security numbers, US phones (parted by hyphens, dots or
blanks; by blanks only in issued ranges), phones of other countries that begin with a plus sign (its first two digits stay),
IPv4 addresses, dates as 2001-02-28, 02/28/2001, 28.02.2001 and, where the month can't be first, 28/02/2001, IBANs of the
listed countries, mail addresses (the name), hexadecimal secrets, and access tokens of known beginnings. Not found: names and
postal addresses, dates with one-digit days or months or with month names, phones without a plus sign outside the US,
IPv6 addresses, and tokens without a known beginning.

The key is the secret: ``pseudonymise`` has no default for it. ``key_of`` takes it from spark.tidemark.pii.key; the registered
queries fall back to the example key below, which protects nothing. Spark shows the key in the plans of its event log.

Everything is one projection of built-in functions: no shuffle, no Python on the executors.

Defined cases: a null text is an empty one; documents without a find keep their text byte for byte; finds that fail
validation stay; repeated rows are rewritten alike; an empty table gives none; other columns are untouched.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, table, without

ROUNDS = 10
EXAMPLE_KEY = "tidemark pseudonyms, example key"
KEY_CONF = "spark.tidemark.pii.key"
KINDS = ("card", "ssn", "phone", "ip", "iso_date", "us_date", "uk_date", "eu_date", "email", "secret", "token", "iban", "intl")

# The lengths of IBANs by country.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}


def _account(length: int, countries: str) -> str:
    fours, rest = divmod(length - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


# What each kind looks like. Neighbouring letters and digits rule a find out.
_SHAPES = {
    "card": r"\d{13,19}|\d{4}(?: \d{4} \d{4} |-\d{4}-\d{4}-)\d{4}|\d{4}(?: \d{6} |-\d{6}-)\d{5}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone": r"(?:\+?1[ .-]?)?(?:\(\d{3}\)[ -]?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+1[ .-]?\d{10}",
    "ip": r"(?:\d{1,3}\.){3}\d{1,3}",
    "iso_date": r"\d{4}-\d{2}-\d{2}",
    "us_date": r"\d{2}/\d{2}/\d{4}",
    "uk_date": r"\d{2}/\d{2}/\d{4}",
    "eu_date": r"\d{2}\.\d{2}\.\d{4}",
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"[0-9a-f]{32,64}|[0-9A-F]{32,64}",
    "token": r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|sk-[A-Za-z0-9]{20,64}|xox[abprs]-[A-Za-z0-9-]{10,72}",
    "iban": r"(?=[A-Z]{2}\d{2})(?:" + "|".join(_account(n, c) for n, c in _IBAN_LENGTHS.items()) + ")",
    "intl": r"\+[2-9]\d{0,2}(?:[ .-]?(?:\(\d{1,4}\)|\d{1,4})){2,6}|\+[2-9]\d{7,14}",
}
_BEFORE, _AFTER = r"(?<![\w.+@-])", r"(?![\w@])(?![.-]\d)"
PATTERN = _BEFORE + "(?:" + "|".join(
    f"(?:{_SHAPES[k]})" for k in ("email", "secret", "token", "iban", "phone", "ip", "ssn", "iso_date", "us_date", "eu_date", "card", "intl")
) + ")" + _AFTER
# The first day of the 400-year calendar cycle that dates are permuted in, and a factorisation of its length in days.
_FIRST_DAY, _CYCLE = "1800-01-01", (27, 5411)


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _prf(key: str, kind: str, of: str) -> str:
    """A 60-bit number from the key, the kind, the round ``i`` and the other half."""
    return f"CAST(conv(substr(sha2(concat_ws('|', {_sql(key)}, {_sql(kind)}, i, {of}), 256), 1, 15), 16, 10) AS BIGINT)"


def _feistel(key: str, kind: str, left: str, right: str, a: str, b: str, done: str, back: bool) -> str:
    """SQL: the pair (left below a, right below b) permuted; ``done`` is made from ``p.l`` and ``p.r``."""
    sign, rounds = ("-", f"sequence({ROUNDS}, 1, -1)") if back else ("+", f"sequence(1, {ROUNDS})")
    return (
        f"aggregate({rounds}, named_struct('l', CAST({left} AS BIGINT), 'r', CAST({right} AS BIGINT)), (p, i) -> if(i % 2 = 1, "
        f"named_struct('l', pmod(p.l {sign} {_prf(key, kind, 'p.r')} % {a}, {a}), 'r', p.r), "
        f"named_struct('l', p.l, 'r', pmod(p.r {sign} {_prf(key, kind, 'p.l')} % {b}, {b}))), p -> {done})"
    )


def _digits(key: str, kind: str, s: str, n: int, back: bool) -> str:
    """SQL: a string of n digits permuted among all of them."""
    a, b = n // 2, n - n // 2
    done = f"concat(lpad(CAST(p.l AS STRING), {a}, '0'), lpad(CAST(p.r AS STRING), {b}, '0'))"
    return _feistel(key, f"{kind}{n}", f"substr({s}, 1, {a})", f"substr({s}, {a + 1})", f"{10**a}L", f"{10**b}L", done, back)


def _walked(valid: str, step: str, s: str) -> str:
    """SQL: ``step`` over ``w`` until the result is valid; the cycle brings every start back to a valid string."""
    return f"aggregate(sequence(1, 64), named_struct('w', {s}, 'ok', false), (c, k) -> if(c.ok, c, transform(array({step}), x -> named_struct('w', x, 'ok', {valid}))[0]), c -> c.w)"


def _luhn(s: str, shift: int) -> str:
    """SQL: Luhn sum of a digit string whose last digit is doubled when shift is 1."""
    digit = f"CAST(substr({s}, length({s}) - j, 1) AS INT)"
    return f"aggregate(sequence(0, length({s}) - 1), 0, (t, j) -> t + if((j + {shift}) % 2 = 0, {digit}, 2 * {digit} - if({digit} > 4, 9, 0)))"


def _refilled(m: str, digits: str) -> str:
    """SQL: the string m with its digits replaced, in order, by those of ``digits``; all else stays."""
    return f"concat_ws('', transform(sequence(1, length({m})), z -> if(substr({m}, z, 1) BETWEEN '0' AND '9', substr({digits}, length(regexp_replace(substr({m}, 1, z), '[^0-9]', '')), 1), substr({m}, z, 1))))"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _card(key: str, back: bool) -> str:
    cases = " ".join(f"WHEN {n} THEN {_digits(key, 'card', 'h', n - 1, back)}" for n in range(13, 20))
    permuted = _let("substr(d, 1, length(d) - 1)", "h", f"CASE length(d) {cases} END")
    whole = _let(permuted, "q", f"concat(q, CAST(pmod(10 - {_luhn('q', 1)} % 10, 10) AS STRING))")
    return _let("regexp_replace(m, '[^0-9]', '')", "d", _let(whole, "y", _refilled("m", "y")))


def _ssn(key: str, back: bool) -> str:
    ok = "NOT (x LIKE '000%' OR x LIKE '666%' OR x LIKE '9%' OR substr(x, 4, 2) = '00' OR x LIKE '%0000')"
    return _let("regexp_replace(m, '[^0-9]', '')", "d", _let(_walked(ok, _digits(key, "ssn", "c.w", 9, back), "d"), "y", _refilled("m", "y")))


_ISSUED = "{0} RLIKE '^[2-9][0-9]{{2}}[2-9]'"


def _phone(key: str, back: bool) -> str:
    # Issued numbers stay among the issued, others among the others.
    among = f"({_ISSUED.format('x')}) = ({_ISSUED.format('d')})"
    ten = _let("right(regexp_replace(m, '[^0-9]', ''), 10)", "d", _walked(among, _digits(key, "phone", "c.w", 10, back), "d"))
    return _let(ten, "y", _refilled("m", "if(length(regexp_replace(m, '[^0-9]', '')) = 11, concat('1', y), y)"))


def _intl(key: str, back: bool) -> str:
    cases = " ".join(f"WHEN {n} THEN {_digits(key, 'intl', 'h', n - 2, back)}" for n in range(8, 16))
    whole = _let("substr(d, 3)", "h", f"concat(substr(d, 1, 2), CASE length(d) {cases} END)")
    return _let("regexp_replace(m, '[^0-9]', '')", "d", _let(whole, "y", _refilled("m", "y")))


def _remainder(s: str) -> str:
    """SQL: the remainder modulo 97 of a string of digits and capitals, A being 10."""
    c = f"substr({s}, j, 1)"
    return f"aggregate(sequence(1, length({s})), 0L, (t, j) -> if({c} BETWEEN '0' AND '9', t * 10 + ascii({c}) - 48, t * 100 + ascii({c}) - 55) % 97)"


def _check_digits(body: str, country: str) -> str:
    return _let(f"concat({body}, {country}, '00')", "n", f"lpad(CAST(98 - {_remainder('n')} AS STRING), 2, '0')")


def _iban(key: str, back: bool) -> str:
    moved = _let("substr(d, 5)", "b", _characters(key, "iban", "b", 26, back))
    whole = _let(moved, "q", f"concat(substr(d, 1, 2), {_check_digits('q', 'substr(d, 1, 2)')}, q)")
    parted = "concat_ws('', transform(sequence(1, length(m)), z -> if(substr(m, z, 1) = ' ', ' ', substr(y, length(replace(substr(m, 1, z), ' ', '')), 1))))"
    return _let("replace(m, ' ', '')", "d", _let(whole, "y", parted))


def _token(key: str, back: bool) -> str:
    return _let("substr(m, 5)", "b", f"concat(substr(m, 1, 4), {_characters(key, 'token', 'b', 26, back)})")


def _ip(key: str, back: bool) -> str:
    octet = [f"CAST(split_part(m, '.', {k}) AS BIGINT)" for k in (1, 2, 3, 4)]
    done = "concat_ws('.', p.l div 256, p.l % 256, p.r div 256, p.r % 256)"
    return _feistel(key, "ip", f"{octet[0]} * 256 + {octet[1]}", f"{octet[2]} * 256 + {octet[3]}", "65536L", "65536L", done, back)


_DATES = ("iso_date", "us_date", "uk_date", "eu_date")
_WRITTEN = {"iso_date": "yyyy-MM-dd", "us_date": "MM/dd/yyyy", "uk_date": "dd/MM/yyyy", "eu_date": "dd.MM.yyyy"}


def _iso(kind: str, m: str) -> str:
    """SQL: a written date as year, month and day."""
    at = {c: _WRITTEN[kind].index(c) + 1 for c in ("yyyy", "MM", "dd")}
    return f"concat(substr({m}, {at['yyyy']}, 4), '-', substr({m}, {at['MM']}, 2), '-', substr({m}, {at['dd']}, 2))"


def _day(kind: str, m: str) -> str:
    return f"datediff(TRY_CAST({_iso(kind, m)} AS DATE), DATE'{_FIRST_DAY}')"


def _moved_date(key: str, kind: str, m: str, back: bool) -> str:
    a, b = _CYCLE
    done = f"date_format(date_add(DATE'{_FIRST_DAY}', CAST(p.l * {b} + p.r AS INT)), '{_WRITTEN[kind]}')"
    return _feistel(key, "date", f"{_day(kind, m)} div {b}", f"{_day(kind, m)} % {b}", f"{a}L", f"{b}L", done, back)


def _date(key: str, kind: str, back: bool) -> str:
    if kind == "uk_date":  # it is told from a date with the month first by its day, which so must be beyond 12 again
        return _walked("substr(x, 1, 2) > '12'", _moved_date(key, kind, "c.w", back), "m")
    return _moved_date(key, kind, "m", back)


def _characters(key: str, kind: str, s: str, letters: int, back: bool) -> str:
    """SQL: the halves of a string, each character moved within its class: digits, and the first ``letters`` of a case."""
    sign, rounds = ("-", f"sequence({ROUNDS}, 1, -1)") if back else ("+", f"sequence(1, {ROUNDS})")

    def moved(half: str, other: str) -> str:
        c = f"ascii(substr({half}, j, 1))"
        by = f"CAST(conv(substr(sha2(concat_ws('|', {_sql(key)}, {_sql(kind)}, i, (j - 1) div 16, {other}), 256), 4 * ((j - 1) % 16) + 1, 4), 16, 10) AS INT)"
        ring = lambda first, n: f"char({first} + pmod({c} - {first} {sign} {by}, {n}))"
        one = f"CASE WHEN {c} BETWEEN 48 AND 57 THEN {ring(48, 10)} WHEN {c} BETWEEN 97 AND {96 + letters} THEN {ring(97, letters)} WHEN {c} BETWEEN 65 AND {64 + letters} THEN {ring(65, letters)} ELSE substr({half}, j, 1) END"
        return f"if(length({half}) = 0, '', concat_ws('', transform(sequence(1, length({half})), j -> {one})))"

    cut = f"length({s}) div 2"
    return (
        f"aggregate({rounds}, named_struct('l', substr({s}, 1, {cut}), 'r', substr({s}, {cut} + 1)), (p, i) -> if(i % 2 = 1, "
        f"named_struct('l', {moved('p.l', 'p.r')}, 'r', p.r), named_struct('l', p.l, 'r', {moved('p.r', 'p.l')})), p -> concat(p.l, p.r))"
    )


def _email(key: str, back: bool) -> str:
    return _let("split_part(m, '@', 1)", "n", f"concat({_characters(key, 'email', 'n', 26, back)}, substr(m, length(n) + 1))")


def _valid(kind: str) -> str:
    whole = f"m RLIKE {_sql('^(?:' + _SHAPES[kind] + ')$')}"
    digits = "regexp_replace(m, '[^0-9]', '')"
    if kind == "card":
        return f"({whole} AND {_let(digits, 'd', _luhn('d', 0) + ' % 10 = 0')})"
    if kind == "ssn":
        return f"({whole} AND NOT (m LIKE '000%' OR m LIKE '666%' OR m LIKE '9%' OR substr(m, 5, 2) = '00' OR m LIKE '%0000'))"
    if kind == "phone":  # groups of digits between blanks may be anything, so they must be a number that is issued
        ten = f"right({digits}, 10)"
        return f"({whole} AND (m NOT RLIKE '[0-9] [0-9]{{3}} [0-9]' OR {_ISSUED.format(ten)}))"
    if kind == "ip":  # without leading zeros, which the dotted form doesn't keep
        return f"({whole} AND forall(split(m, '[.]'), o -> CAST(o AS INT) <= 255 AND (o = '0' OR o NOT LIKE '0%')))"
    if kind in _DATES:
        a, b = _CYCLE
        return f"({whole} AND coalesce({_day(kind, 'm')} BETWEEN 0 AND {a * b - 1}, false))"
    if kind == "iban":
        return f"({whole} AND {_let("replace(m, ' ', '')", 'd', 'substr(d, 3, 2) = ' + _check_digits('substr(d, 5)', 'substr(d, 1, 2)'))})"
    if kind == "intl":
        return f"({whole} AND length({digits}) BETWEEN 8 AND 15)"
    return whole


def _kind() -> str:
    return "CASE " + " ".join(f"WHEN {_valid(k)} THEN '{k}'" for k in KINDS) + " ELSE '' END"


def _pseudonym(key: str, back: bool) -> str:
    by = {
        "card": _card(key, back), "ssn": _ssn(key, back), "phone": _phone(key, back), "ip": _ip(key, back),
        **{k: _date(key, k, back) for k in _DATES}, "email": _email(key, back), "secret": _characters(key, "secret", "m", 6, back),
        "token": _token(key, back), "iban": _iban(key, back), "intl": _intl(key, back),
    }
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {by[k]}" for k in KINDS) + " ELSE m END"


def key_of(spark: SparkSession) -> str:
    """The key that the session names; the example key, with a warning, where it names none."""
    key = spark.conf.get(KEY_CONF, None)
    if not key:
        warnings.warn(f"{KEY_CONF} is unset: the pseudonyms' key is the published example", stacklevel=2)
    return key or EXAMPLE_KEY


def pseudonymise(docs: DataFrame, key: str, column: str = "text", reveal: bool = False) -> DataFrame:
    """The rows of docs with personal values in ``column`` replaced, and ``pii``: how many of each kind were.

    A column named pii is replaced. ``reveal`` undoes the replacement under the same key.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    docs = without(docs, "pii")
    held, finds, marked, written = fresh(docs, "_text", "_finds", "_marked", "_written")
    found = docs.withColumn(held, F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")))
    # Texts without a digit or an at sign, most of them, are passed over by one cheap test.
    some = F.col(held).rlike("[0-9@]")
    matches = F.when(some, F.regexp_extract_all(held, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    kinds = F.expr(f"transform({finds}, m -> named_struct('m', m, 'kind', {_kind()}))")
    values = F.expr(f"transform({marked}, f -> {_let('f.m', 'm', _let('f.kind', 'kind', _pseudonym(key, reveal)))})")
    gaps = F.split(F.col(held), PATTERN, -1)
    joined = F.concat_ws("", F.flatten(F.zip_with(gaps, F.col(written), lambda g, w: F.array(g, F.coalesce(w, F.lit(""))))))
    counts = F.expr("struct(" + ", ".join(f"CAST(size(filter({marked}, f -> f.kind = '{k}')) AS BIGINT) AS {k}" for k in KINDS) + ")")
    return (
        found.withColumn(finds, matches).withColumn(marked, kinds).withColumn(written, values)
        .withColumn(column, F.when(F.size(finds) == 0, F.col(held)).otherwise(joined)).withColumn("pii", counts).drop(held, finds, marked, written)
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its pseudonymised text, and the finds of each kind."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, key_of(spark)).select("doc_id", "text", *[F.col(f"pii.{k}").alias(f"n_{k}") for k in KINDS])
