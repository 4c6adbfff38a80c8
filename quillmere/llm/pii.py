"""Format-preserving pseudonyms of personal data, on DataFrame functions alone.

Numbers and dates that are valid in their format go through a keyed Feistel network over just
that format, a permutation: a valid value becomes another valid one, equal values become equal
ones in all documents, and different values stay different.

card   13 to 19 digits, alone or in groups, with a right check digit: all but it are permuted, and it is computed anew
phone  an international number in groups, one with its area code in brackets, or 3-3-4 digits: all digits after the country code
ip     four numbers up to 255: as one 32-bit number
date   a day of the calendar, Y-M-D or D/M/Y: permuted within its cycle of 400 years (189 * 773 days); M/D/Y with a day
       beyond 12 among those of its cycle: years, months and days 13 to 28 together, of days 29 to 31 the year (Feb 29 stays)
ssn    three, two and four digits, among the valid ones (898 areas, 99 groups, 9,999 serials)
email  the local part becomes a keyed hash (it has no numeric format); the domain stays
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.llm.spans import rebuilt, starts, with_values

ROUNDS = 10
# The patterns of the formats.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-][\p{L}\p{N}._%+'-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\w/-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+?\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{4}(?!\d)|(?<![\w+(-])(?:\(\d{3}\) ?|\+\d{1,3}[ .-]\d{2,4}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+(.-])\+\d{1,3}(?:[ .-]\d{1,4}){3,6}(?![\w-]|\.\d)|(?<![\w+(.-])\d{3}([.-])\d{3}\1\d{4}(?![\w-]|\.\d)",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
    "card": r"(?<![\w-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?![\w-])",
}
PATTERN = "|".join(PATTERNS[k] for k in ("email", "date", "ssn", "phone", "ip", "card"))


def rounds(a: str, b: str, mod_a: str, mod_b: str, key: str) -> str:
    """SQL: struct(a, b) after ROUNDS Feistel rounds over Z_mod_a x Z_mod_b; even rounds add to a what b and the key hash to, odd ones to b."""
    f = lambda x: f"cast(conv(substr(sha2(concat({key}, '|', i, '|', {x}), 256), 1, 14), 16, 10) as bigint)"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, i) -> if(i % 2 = 0, named_struct('a', pmod(s.a + {f('s.b')}, {mod_a}), 'b', s.b), named_struct('a', s.a, 'b', pmod(s.b + {f('s.a')}, {mod_b}))))"


def permuted_digits(digits: str, key: str) -> str:
    """SQL: the digit string permuted among those of its length."""
    n, left = f"length({digits})", f"(length({digits}) div 2)"
    ten = lambda x: f"cast(concat('1', repeat('0', cast({x} as int))) as bigint)"
    a, b = f"coalesce(try_cast(substr({digits}, 1, cast({left} as int)) as bigint), 0)", f"cast(substr({digits}, cast({left} as int) + 1) as bigint)"
    both = rounds(a, b, ten(left), ten(f"({n} - {left})"), f"concat({key}, {n})")
    return f"transform(array({both}), s -> concat(lpad(cast(s.a as string), cast({left} as int), '0'), lpad(cast(s.b as string), cast({n} - {left} as int), '0')))[0]"


def luhn_sum(digits: str, double_last: bool) -> str:
    """SQL: the Luhn sum of a digit string; the digits doubled start at the last or at the one before."""
    odd = 0 if double_last else 1
    return f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> cast(c as int) * if(i % 2 = {odd}, 2, 1) - if(i % 2 = {odd} and cast(c as int) > 4, 9, 0)), 0, (s, x) -> s + x)"


def with_digits(value: str, digits: str) -> str:
    """SQL: the value with its digits replaced in order by those given."""
    return f"aggregate(split({value}, ''), named_struct('t', '', 'k', 0), (s, c) -> if(c rlike '[0-9]', named_struct('t', concat(s.t, substr({digits}, s.k + 1, 1)), 'k', s.k + 1), named_struct('t', concat(s.t, c), 'k', s.k)), s -> s.t)"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def findings(docs: DataFrame, key: str) -> DataFrame:
    """docs (doc_id, text) with arrays parts, vals, kinds (null where the value is not valid) and names (what each value becomes)."""
    rows = with_values(docs, PATTERN)
    k = "'" + key.replace("\\", "\\\\").replace("'", "\\'") + "'"
    only = "regexp_replace(v, '[^0-9]', '')"
    day = "coalesce(try_to_date(v, 'yyyy-MM-dd'), try_to_date(v, 'dd/MM/yyyy'))"
    kind = f"""case when v like '%@%' then 'email' when v rlike '^\\\\d{{4}}-\\\\d{{2}}-\\\\d{{2}}$' or v like '%/%' then case when {day} is not null then 'date' when try_to_date(v, 'MM/dd/yyyy') is not null then 'us-date' end
      when v rlike '^\\\\d{{3}}-\\\\d{{2}}-\\\\d{{4}}$' then if(v rlike '^(000|666|9)' or v like '%-00-%' or v like '%-0000', null, 'ssn')
      when v rlike '^(\\\\d{{1,3}}\\\\.){{3}}\\\\d{{1,3}}$' then if(forall(split(v, '[.]'), o -> cast(o as int) <= 255), 'ip', null)
      when v rlike '[(+]' or v rlike '^\\\\d{{3}}([.-])\\\\d{{3}}[.-]\\\\d{{4}}$' then 'phone'
      when length({only}) between 13 and 19 and {luhn_sum(only, False)} % 10 = 0 then 'card' end"""
    rows = rows.withColumn("kinds", F.expr(f"transform(vals, v -> {kind})"))
    card = _let("d", only, _let("p", permuted_digits("substr(d, 1, length(d) - 1)", f"concat({k}, 'card')"), with_digits("v", f"concat(p, cast((10 - {luhn_sum('p', True)} % 10) % 10 as string))")))
    country = "regexp_extract(v, '^([+]\\\\d{1,3}|\\\\d{1,3}(?=[ .-]?[(]))?', 0)"
    phone = _let("c", country, _let("r", "substr(v, length(c) + 1)", f"concat(c, {with_digits('r', permuted_digits('regexp_replace(r, "[^0-9]", "")', f'concat({k}, {chr(39)}phone{chr(39)})'))})"))
    area = "cast(left(v, 3) as bigint)"
    ssn = _let("s", rounds(f"({area} - 1 - if({area} > 666, 1, 0)) * 99 + cast(substr(v, 5, 2) as bigint) - 1", "cast(right(v, 4) as bigint) - 1", "88902", "9999", f"concat({k}, 'ssn')"), "concat(lpad(cast(s.a div 99 + 1 + if(s.a div 99 >= 665, 1, 0) as string), 3, '0'), '-', lpad(cast(s.a % 99 + 1 as string), 2, '0'), '-', lpad(cast(s.b + 1 as string), 4, '0'))")
    octet = lambda i: f"cast(split(v, '[.]')[{i}] as bigint)"
    ip = _let("s", rounds(f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", "65536", "65536", f"concat({k}, 'ip')"), "concat_ws('.', s.a div 256, s.a % 256, s.b div 256, s.b % 256)")
    n = f"datediff({day}, date'2000-01-01')"
    date = _let("n", n, _let("s", rounds("pmod(n, 146097) div 773", "pmod(n, 146097) % 773", "189", "773", f"concat({k}, 'date')"), f"date_format(date_add(date'2000-01-01', cast(n - pmod(n, 146097) + s.a * 773 + s.b as int)), if(v like '%/%', 'dd/MM/yyyy', 'yyyy-MM-dd'))"))
    m, d, y = (f"cast(substr(v, {at}, {n}) as bigint)" for at, n in ((1, 2), (4, 2), (7, 4)))
    month = "concat(lpad(cast({} as string), 2, '0'), '/', lpad(cast({} as string), 2, '0'), '/', lpad(cast({} as string), 4, '0'))".format
    early = _let("s", rounds(f"{y} % 400 * 12 + {m} - 1", f"{d} - 13", "4800", "16", f"concat({k}, 'us')"), month("s.a % 12 + 1", "s.b + 13", f"{y} - {y} % 400 + s.a div 12"))
    late = _let("s", rounds(f"{y} % 400 div 20", f"{y} % 20", "20", "20", f"concat({k}, 'us', left(v, 5))"), month(m, d, f"{y} - {y} % 400 + s.a * 20 + s.b"))
    us = f"case when {d} < 29 then {early} when v like '02/29%' then v else {late} end"
    email = f"concat('user', substr(sha2(concat({k}, '|email|', lower(v)), 256), 1, 14), substr(v, instr(v, '@')))"
    name = f"case kind when 'card' then {card} when 'phone' then {phone} when 'ssn' then {ssn} when 'ip' then {ip} when 'date' then {date} when 'us-date' then {us} when 'email' then {email} else v end"
    return rows.withColumn("names", F.expr(f"zip_with(vals, kinds, (v, kind) -> {name})"))


def pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, kind, ordinal, start, length, pseudonym) of each valid value in the rows of docs (doc_id, text); places count code points.

    A null or empty text has none, a null doc_id stays null. Repeated rows give equal rows, an empty table none; texts are searched whole; other columns are not read.
    """
    rows = findings(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").rlike("[0-9@]")), key)
    rows = rows.filter("size(vals) > 0").withColumn("starts", starts())
    rows = rows.select("doc_id", F.posexplode(F.arrays_zip("kinds", "starts", "vals", "names")))
    out = rows.select("doc_id", F.regexp_replace("col.kinds", "^us-", "").alias("kind"), F.col("pos").alias("ordinal"), F.col("col.starts").alias("start"), F.length("col.vals").alias("length"), F.col("col.names").alias("pseudonym"))
    return out.filter("kind is not null")


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """docs with each valid value in its text replaced; a null text stays null, other columns stay."""
    names = docs.columns
    held = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), docs["text"].alias("text"))
    rows = findings(held, key).withColumn("_text", F.when(F.col("text").isNotNull(), rebuilt("names")))
    return rows.select(*[F.col("_text").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in names])
