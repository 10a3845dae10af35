"""Format-preserving pseudonyms for personal data, by keyed Feistel networks in SQL expressions.

Candidates are found by one pattern and validated by kind: card numbers by issuer range and check digit, account numbers (IBAN) by
the remainder modulo 97, addresses by their octets, dates by the calendar.  What is valid is permuted within its format
under a key, so equal values have equal pseudonyms in every document and no table of values is kept.

Kinds and their permutations (all one-to-one within the format):

* ``email``: letters and digits of the local part move within their class; the case pattern and the domain stay;
* ``card``: the issuer's four digits stay, those after them are permuted, the last becomes the check digit again;
* ``iban``: country code and case pattern stay, the account part moves within its classes, the check digits are made anew;
* ``phone``: North American numbers keep what stands before the last ten digits; other numbers with a country code keep that
  (three digits, if nothing parts it from the rest), national ones with a slash their area code, French ones two digits;
  punctuation stays;
* ``ssn``: area (898 values), group and serial (99 * 9,999 together), so every pseudonym is a valid number again;
* ``ipv4``: 32 bits, in two halves of 16;
* ``ipv6``: the hexadecimal digits of its notation, with at least two groups before a ``::``;
* ``date``: days up to the 12th of a month, 57,600 = 240 * 240 in the 400 Gregorian years from 1800, and later ones, 88,497 =
  9 * 9,833, each among themselves.  A date that reads as month and day alone is later than the 12th, so its pseudonym
  reads so alone as well, no two dates of a format meet, and a date has one pseudonym in all formats;
* ``secret``: hexadecimal strings of 32 digits and more, and the part behind the prefix of keys that have one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The session's setting that names the key, for callers that give none.
KEY_SETTING = "spark.lumenfold.pseudonym.key"
ROUNDS = 8
_DATE_ROUNDS = 10
KINDS = ("email", "card", "iban", "phone", "ssn", "ipv4", "date", "secret", "ipv6")

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)++"
_SECRET = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"
_IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
_DATE = r"(?<![\d./-])(?:\d{4}([-/])\d{2}\1\d{2}|\d{2}([./])\d{2}\2\d{4})(?!\d|[./-]\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!-?\d)"
_IBAN = r"(?<![A-Za-z0-9])[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?(?![A-Za-z0-9])"
_CARD = r"(?<!\d)(?<!\d[.-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d|-\d)"
#: First digits of the card issuers' number ranges.
_ISSUERS = "^(?:4|5|6|3[04-9]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720))"
#: Groups of three, three and four digits; up to three symbols may stick to a group's end.
_PHONE = r"(?<![\w+])(?:\+\d{1,3}[^\w\s]{0,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[^\w\s]{0,3}[ .-]?\d{3}[.-]\d{4}(?![\d-])"
#: A country code and groups of digits, 8 to 15 in all; an area code, a slash and the number; five groups of two.
_ABROAD = r"(?<![\w+])\+\d{1,3}+(?:[ ./-]?\(\d{1,4}\))?+(?:[ ./-]?\d{1,8}+){1,6}+(?![\w+])"
_NATIONAL = r"(?<![\w/.+-])(?:0\d{2,4}/\d{5,8}|0\d(?:[ .]\d{2}){4})(?![\w/-]|[ .]\d)"
_IPV6 = r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![\w:])"
#: Prefixes of keys that services hand out, and what follows them.
_KEY = r"(?<![0-9A-Za-z_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|[spr]k_(?:live|test)_[0-9A-Za-z]{16,99}|gh[oprsu]_[0-9A-Za-z]{36})(?![0-9A-Za-z_-])"
_KEY_PREFIX = "^(?:A[KS]IA|[spr]k_(?:live|test)_|gh[oprsu]_)"
#: All candidates; the date's groups are the only ones that capture, so their numbers hold here too.
PATTERN = "|".join([_EMAIL, _SECRET, _KEY, _DATE, _IPV4, _IPV6, _SSN, _IBAN, _CARD, _PHONE, _ABROAD, _NATIONAL])
_HEX = "0123456789abcdef"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _f(key: str, tag: str, *parts: str) -> str:
    """SQL: the hexadecimal digest that drives a round."""
    return f"sha2(concat_ws('|', {_quoted(key)}, '{tag}', {', '.join(parts)}), 512)"


def _number(digest: str, modulus: int) -> str:
    return f"(cast(conv(substr({digest}, 1, 14), 16, 10) as bigint) % {modulus})"


def _moved(half: str, digest: str, alphabet: str) -> str:
    """SQL: each character of ``half`` moved within its class by two digits of ``digest``, which serve again after 64
    characters; others stay."""
    shift = f"cast(conv(substr({digest}, 2 * (p % 64) + 1, 2), 16, 10) as int)"
    if alphabet == "hex":
        low = f"substr('{_HEX}', (instr('{_HEX}', lower(c)) - 1 + {shift}) % 16 + 1, 1)"
        one = f"case when c = ':' then c when c between 'A' and 'F' then upper({low}) else {low} end"
    else:
        classes = [("0", "9", 48, 10)] + ([("a", "z", 97, 26), ("A", "Z", 65, 26)] if alphabet == "word" else [])
        one = "case " + " ".join(f"when c between '{a}' and '{z}' then char({base} + (ascii(c) - {base} + {shift}) % {n})" for a, z, base, n in classes) + " else c end"
    return f"array_join(transform(split({half}, ''), (c, p) -> {one}), '')"


def _permuted(text: str, key: str, tag: str, alphabet: str) -> str:
    """SQL: a Feistel network over the characters of ``text``: each round moves one half by a digest of the other."""
    digest = _f(key, tag, "i", "lower(s.b)")
    loop = (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', left(t, cast(length(t) / 2 as int)), 'b', substr(t, cast(length(t) / 2 as int) + 1)),"
        f" (s, i) -> named_struct('a', s.b, 'b', element_at(transform(array({digest}), h -> {_moved('s.a', 'h', alphabet)}), 1)), s -> concat(s.a, s.b))"
    )
    return f"element_at(transform(array({text}), t -> {loop}), 1)"


def _reset(match: str, digits: str, skip: str = "0") -> str:
    """SQL: ``match`` with its digits, after the first ``skip``, replaced by ``digits`` in order."""
    seen = f"length(regexp_replace(left({match}, p + 1), '[^0-9]', ''))"
    return f"array_join(transform(split({match}, ''), (c, p) -> if(c between '0' and '9' and {seen} > {skip}, substr({digits}, {seen} - {skip}, 1), c)), '')"


def _luhn(digits: str, parity: int) -> str:
    """SQL: the Luhn sum of ``digits``; those whose distance from the end has ``parity`` are doubled."""
    return (
        f"aggregate(transform(split(reverse({digits}), ''), (c, p) -> if(p % 2 = {parity}, cast(element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(c as int) + 1) as int), cast(c as int))), 0, (x, y) -> x + y)"
    )


def _mod97(text: str) -> str:
    """SQL: an account number's remainder modulo 97, letters counting from A = 10."""
    value = "if(c between '0' and '9', cast(c as bigint), cast(ascii(c) - 55 as bigint))"
    return f"aggregate(transform(split({text}, ''), c -> {value}), 0L, (x, y) -> (x * if(y > 9, 100, 10) + y) % 97)"


_DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy")


def _shaped(fmt: str) -> str:
    return "^" + "".join(r"\d" if c in "yMd" else "[.]" if c == "." else c for c in fmt) + "$"


def _as_date(match: str, fmt: str) -> str:
    d = f"case when {match} rlike {_quoted(_shaped(fmt))} then cast(try_to_timestamp({match}, '{fmt}') as date) end"
    return f"(case when {d} between date'1800-01-01' and date'2199-12-31' then {d} end)"


def _among(value: str, key: str, tag: str, high: int, low: int) -> str:
    """SQL: a Feistel network over the numbers below ``high`` * ``low``."""
    even = f"named_struct('a', (s.a + {_number(_f(key, tag, 'i', 's.b'), high)}) % {high}, 'b', s.b)"
    odd = f"named_struct('a', s.a, 'b', (s.b + {_number(_f(key, tag, 'i', 's.a'), low)}) % {low})"
    start = f"named_struct('a', cast({value} div {low} as bigint), 'b', cast({value} % {low} as bigint))"
    return f"aggregate(sequence(1, {_DATE_ROUNDS}), {start}, (s, i) -> if(i % 2 = 0, {even}, {odd}), s -> s.a * {low} + s.b)"


def _date(match: str, key: str) -> str:
    months = "((year(d) - 1800) * 12 + month(d) - 1)"
    early = _among(f"({months} * 12 + day(d) - 1)", key, "date-early", 240, 240)
    early = f"element_at(transform(array({early}), n -> make_date(cast(1800 + n div 144 as int), cast(n div 12 % 12 + 1 as int), cast(n % 12 + 1 as int))), 1)"
    # Of the days after the 12th, ``first`` come before month m; a month has 18.4 of them on average.
    first = "(datediff(add_months(date'1800-01-01', m), date'1800-01-01') - 12 * m)"
    late = _among(f"(datediff(d, date'1800-01-01') - 12 * ({months} + 1))", key, "date-late", 9, 9833)
    near = "sequence(greatest(0, cast(n * 4800 div 88497 as int) - 2), least(4799, cast(n * 4800 div 88497 as int) + 2))"
    late = f"element_at(transform(array({late}), n -> date_add(date'1800-01-01', cast(n + 12 * (1 + array_max(filter({near}, m -> {first} <= n))) as int))), 1)"
    cases = " ".join(f"when {_as_date(match, fmt)} is not null then date_format(y, '{fmt}')" for fmt in _DATE_FORMATS)
    day = f"coalesce({', '.join(_as_date(match, fmt) for fmt in _DATE_FORMATS)})"
    moved = f"element_at(transform(array({day}), d -> if(day(d) <= 12, {early}, {late})), 1)"
    return f"element_at(transform(array({moved}), y -> case {cases} else {match} end), 1)"


def _ssn(match: str, key: str) -> str:
    even = f"named_struct('a', (s.a + {_number(_f(key, 'ssn', 'i', 's.b'), 898)}) % 898, 'b', s.b)"
    odd = f"named_struct('a', s.a, 'b', (s.b + {_number(_f(key, 'ssn', 'i', 's.a'), 99 * 9999)}) % {99 * 9999})"
    # Areas run from 1 to 899 without 666, groups from 1, serials from 1.
    area, rest = "cast(element_at(o, 1) as bigint)", "(cast(element_at(o, 2) as bigint) - 1) * 9999 + cast(element_at(o, 3) as bigint) - 1"
    shown = "concat_ws('-', lpad(s.a + if(s.a < 665, 1, 2), 3, '0'), lpad(s.b div 9999 + 1, 2, '0'), lpad(s.b % 9999 + 1, 4, '0'))"
    loop = (
        f"aggregate(sequence(1, {_DATE_ROUNDS}), named_struct('a', {area} - if({area} < 666, 1, 2), 'b', {rest}), (s, i) -> if(i % 2 = 0, {even}, {odd}), s -> {shown})"
    )
    return f"element_at(transform(array(split({match}, '-')), o -> {loop}), 1)"


def _ipv4(match: str, key: str) -> str:
    octet = [f"cast(element_at(o, {i}) as bigint)" for i in range(1, 5)]
    loop = (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', {octet[0]} * 256 + {octet[1]}, 'b', {octet[2]} * 256 + {octet[3]}),"
        f" (s, i) -> named_struct('a', s.b, 'b', (s.a + {_number(_f(key, 'ipv4', 'i', 's.b'), 65536)}) % 65536),"
        " s -> concat_ws('.', s.a div 256, s.a % 256, s.b div 256, s.b % 256))"
    )
    return f"element_at(transform(array(split({match}, '[.]')), o -> {loop}), 1)"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _kind(m: str) -> str:
    """SQL: the kind of a candidate, or null if it is not valid."""
    whole = lambda p: _quoted(f"^(?:{p})$")
    compact = f"upper(replace({m}, ' ', ''))"
    dated = " or ".join(f"{_as_date(m, fmt)} is not null" for fmt in _DATE_FORMATS)
    return f"""case
        when {m} rlike {whole(_EMAIL)} then 'email'
        when {m} rlike {whole(_SECRET)} and not {m} rlike '^[0-9]+$' or {m} rlike {whole(_KEY)} then 'secret'
        when {m} rlike {whole(_DATE)} then case when {dated} then 'date' end
        when {m} rlike {whole(_IPV4)} then case when forall(split({m}, '[.]'), x -> cast(x as int) <= 255) then 'ipv4' end
        when {m} rlike {whole(_IPV6)} then case when size(filter(split({m}, ':'), x -> x <> '')) <= if(instr({m}, '::') > 0, 7, 8) then 'ipv6' end
        when {m} rlike {whole(_SSN)} then case when {m} rlike '^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}$' then 'ssn' end
        when {m} rlike {whole(_IBAN)} then case when substr({compact}, 3, 2) between '02' and '98' and {_mod97(f"concat(substr({compact}, 5), left({compact}, 4))")} = 1 then 'iban' end
        when {m} rlike {whole(_CARD)} then case when {_luhn(_digits(m), 1)} % 10 = 0 and {_digits(m)} rlike '{_ISSUERS}' then 'card' end
        when {m} rlike {whole(_PHONE)} or {m} rlike {whole(_NATIONAL)} then 'phone'
        when {m} rlike {whole(_ABROAD)} then case when length({_digits(m)}) between 8 and 15 then 'phone' end end"""


def _pseudonym(kind: str, m: str, key: str) -> str:
    at = f"instr({m}, '@')"
    body = _permuted(f"substr({_digits(m)}, 5, length({_digits(m)}) - 5)", key, "card", "digit")
    body = f"concat(left({_digits(m)}, 4), {body})"
    card = f"element_at(transform(array({body}), d -> {_reset(m, f'concat(d, cast((10 - {_luhn("d", 0)} % 10) % 10 as string))')}), 1)"
    group = f"length(regexp_extract({m}, '^[+]?([0-9]+)', 1))"
    ahead = f"case when {m} rlike {_quoted(f'^(?:{_PHONE})$')} then length({_digits(m)}) - 10 when left({m}, 1) = '+' then least({group}, 3) else {group} end"
    numbered = _permuted(f"substr({_digits(m)}, k + 1)", key, "phone", "digit")
    phone = f"element_at(transform(array({ahead}), k -> element_at(transform(array({numbered}), d -> {_reset(m, 'd', 'k')}), 1)), 1)"
    compact = f"upper(replace({m}, ' ', ''))"
    account = _permuted(f"substr({compact}, 5)", key, "iban", "word")
    check = f"lpad(cast(98 - {_mod97(f'''concat(d, left({compact}, 2), '00')''')} as string), 2, '0')"
    spaced = f"array_join(transform(split({m}, ''), (c, p) -> if(c = ' ', c, element_at(transform(array(substr(n, p + 1 - (length(left({m}, p)) - length(replace(left({m}, p), ' ', ''))), 1)), y -> if(c between 'a' and 'z', lower(y), y)), 1))), '')"
    iban = f"element_at(transform(array({account}), d -> element_at(transform(array(concat(left({compact}, 2), {check}, d)), n -> {spaced}), 1)), 1)"
    prefix = f"regexp_extract({m}, {_quoted(_KEY_PREFIX)}, 0)"
    prefixed = f"concat({prefix}, {_permuted(f'substr({m}, length({prefix}) + 1)', key, 'key', 'word')})"
    return f"""case {kind}
        when 'email' then concat({_permuted(f'left({m}, {at} - 1)', key, 'email', 'word')}, substr({m}, {at}))
        when 'card' then {card}
        when 'iban' then {iban}
        when 'phone' then {phone}
        when 'ssn' then {_ssn(m, key)}
        when 'ipv4' then {_ipv4(m, key)}
        when 'date' then {_date(m, key)}
        when 'ipv6' then {_permuted(m, key, 'ipv6', 'hex')}
        when 'secret' then if({m} rlike {_quoted(_KEY_PREFIX)}, {prefixed}, {_permuted(m, key, 'secret', 'hex')})
        else {m} end"""


def pseudonymise(docs: DataFrame, key: str | None = None, text: str = "text", found: str | None = None) -> DataFrame:
    """``docs`` with the personal data of ``text`` replaced by pseudonyms; all other columns stay.

    Who knows ``key`` can undo them: give a secret one, here or as the session's ``KEY_SETTING``; the last resort is public.
    ``found`` names an extra column: a map from kind to the number of values replaced in the row.

    A projection: no row moves and every text is read whole.  Texts without a candidate pass after one scan.  Null
    stays null, the empty text empty; candidates that fail validation stay as they are.  Repeated rows come out alike,
    an empty table gives no rows, and no other column is read, whatever its name (but ``__pii``).
    """
    column = f"`{text}`"
    pattern = PATTERN
    key = key or docs.sparkSession.conf.get(KEY_SETTING, "change-me")
    pairs = f"transform(regexp_extract_all({column}, {_quoted(pattern)}, 0), m -> named_struct('m', m, 'k', {_kind('m')}))"
    replaced = f"transform(__pii.found, x -> {_pseudonym('x.k', 'x.m', key)})"
    joined = f"concat(array_join(zip_with(slice(__pii.gaps, 1, size(__pii.found)), {replaced}, (g, r) -> concat(g, r)), ''), element_at(__pii.gaps, -1))"
    parts = F.expr(f"case when {column} rlike {_quoted(pattern)} then named_struct('gaps', split({column}, {_quoted(pattern)}, -1), 'found', {pairs}) end")
    marked = docs.withColumn("__pii", parts)
    counts = F.expr(
        "map_from_arrays(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), array("
        + ", ".join(f"coalesce(size(filter(__pii.found, x -> x.k = '{k}')), 0)" for k in KINDS) + "))"
    )
    out = [F.coalesce(F.expr(joined), docs[text]).alias(text) if c == text else docs[c] for c in docs.columns]
    return marked.select(*out, *([counts.alias(found)] if found else []))


def pii_report(docs: DataFrame, key: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id``, the pseudonymised ``text``, and ``n_<kind>`` counts of what was replaced."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = pseudonymise(rows, key, "text", found="found")
    return marked.select("doc_id", "text", *[F.element_at("found", F.lit(k)).cast("long").alias(f"n_{k}") for k in KINDS])
