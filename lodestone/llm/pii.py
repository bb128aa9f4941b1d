"""Operator 2, personal data: format-preserving pseudonyms, with DataFrame functions only.

Found and validated: payment cards (13 to 19 digits, Luhn), phone numbers (+ and 8 to 15 digits), IPv4 addresses (octets under 256), dates of 1900 to 2099
(real days; yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy, else mm/dd/yyyy), US social security numbers (issuable ones), IBANs (mod 97), e-mail addresses,
and secrets (named passwords, tokens and keys: the value, of six characters or more, runs to the next white space or quote, whatever its length
and signs, so a comma or stop right behind it is taken for a part of it). What does not validate stays as it is.

A number is permuted by a keyed Feistel network over the halves of its digits, within its format: a card keeps its length, signs and a right check digit,
an address stays one of four octets, a day becomes another day of the range, an issuable number another (values that leave the range walk on through the
permutation). So equal values get equal pseudonyms in all documents, and different values of a kind different ones. An IBAN keeps its country and its shape:
its digits and its letters are permuted apart, a lone one is moved by a keyed step. Letters of addresses and secrets are no numbers: they become keyed
digests of the same kind.

Whoever knows the key can undo the permutations, so it has no default: the query takes it from the setting KEY_SETTING of the session and, where that is unset,
draws one for the application, which nobody learns (equal values are then linked within it, not with those of other runs). Spark masks settings of such a name in logs
and pages. In a plan the key is the value of a scalar subquery over a local table, whose rows plans do not show.
"""

from __future__ import annotations

import secrets
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, table

ROUNDS = 8
KEY_SETTING = "spark.lodestone.pii.secret"
_B, _E = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
PATTERNS = {
    "secret": r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)[^\s\"']{6,}+",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}",
    "iban": _B + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?" + _E,
    "phone": r"(?<![\p{L}\p{N}+])\+(?:1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{8,15}|(?!1[^0-9])[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-][0-9]{2,5}){2,4})(?![\p{L}\p{N}]|\.[0-9])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "date": r"(?<![\p{L}\p{N}./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![\p{L}\p{N}/-])",
    "ip": r"(?<![\p{L}\p{N}.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\p{L}\p{N}]|\.[0-9])",
    "card": _B + r"(?:[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})" + _E,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_DAY0, _DAYS = "1900-01-01", 73049


def _number(*parts) -> Column:
    """60 bits of the keyed digest of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]), 256), 1, 15), 16, 10).cast("long")


def permuted(digits: Column, key: Column, tweak: Column) -> Column:
    """The digits, 2 to 36, through a Feistel network on their two halves."""
    powers = F.array(*[F.lit(10**k).cast("long") for k in range(19)])
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    v = (n - u).cast("int")
    start = F.struct(F.substring(digits, F.lit(1), u).cast("long").alias("a"), F.substring(digits, u + 1, v).cast("long").alias("b"))

    def step(s: Column, i: Column) -> Column:
        m = F.when(i % 2 == 0, u).otherwise(v)
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + _number(key, tweak, i, n, s["b"]), F.element_at(powers, m + 1)).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(F.lpad(s["a"].cast("string"), u, "0"), F.lpad(s["b"].cast("string"), v, "0")))


def walked(digits: Column, bound: Column, key: Column, tweak: Column) -> Column:
    """The digits permuted; under a bound that is not null, a number in 0 .. bound - 1 permuted in that range, by walking on while the digits leave it."""
    # a walk leaves the range with a chance under 0.9 a step, so 400 steps do not end outside it
    steps = F.sequence(F.lit(0), F.when(bound.isNull(), 0).otherwise(400))
    return F.aggregate(steps, digits, lambda y, i: F.when((i == 0) | (y.try_cast("long") >= bound), permuted(y, key, tweak)).otherwise(y))


def moved(signs: Column, base: int, first: str, key: Column, tweak: str) -> Column:
    """A string of signs of one alphabet (base signs from `first` on) of any length through a Feistel network that adds to its halves in turn, sign by sign."""
    n = F.length(signs)
    u = F.floor(n / 2).cast("int")

    def added(s: Column, other: Column, i: Column) -> Column:
        h = F.sha2(F.concat_ws("|", key, F.lit(tweak), i.cast("string"), n.cast("string"), other), 256)
        code = ord(first)

        def sign(c: Column, j: Column) -> Column:
            step = F.conv(F.substring(h, j * 2 % 62 + 1, F.lit(3)), 16, 10).cast("int")
            return F.char(F.lit(code) + (F.ascii(c) - code + step) % base)

        return F.when(F.length(s) > 0, F.array_join(F.transform(F.split(s, ""), sign), "")).otherwise(s)

    start = F.struct(F.substring(signs, F.lit(1), u).alias("a"), F.substring(signs, u + 1, n).alias("b"))

    def step(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, added(s["a"], s["b"], i)).otherwise(s["a"])
        return F.struct(left.alias("a"), F.when(i % 2 == 0, s["b"]).otherwise(added(s["b"], s["a"], i)).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["a"], s["b"]))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def refit(shape: Column, digits: Column, kind: str = "[0-9]") -> Column:
    """shape with its digits (or other signs of that kind), one after the other, replaced by digits."""
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("s"))

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.rlike(f"^{kind}$")
        return F.struct(F.when(is_digit, acc["i"] + 1).otherwise(acc["i"]).alias("i"), F.concat(acc["s"], F.when(is_digit, F.substring(digits, acc["i"] + 1, F.lit(1))).otherwise(c)).alias("s"))

    return F.aggregate(F.split(shape, ""), start, step, lambda acc: acc["s"])


def _luhn(digits: Column, doubled_first: bool) -> Column:
    """Luhn sum; doubled_first: the last digit is doubled (for a payload without check digit)."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("t"))

    def step(acc: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((acc["i"] + 1).alias("i"), (acc["t"] + F.when(acc["i"] % 2 == (0 if doubled_first else 1), twice).otherwise(d)).alias("t"))

    return F.aggregate(F.split(F.reverse(digits), ""), start, step, lambda acc: acc["t"])


def _mod97(s: Column) -> Column:
    """IBAN without blanks: the number of its rotated letters and digits, mod 97."""
    rotated = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        letter = c.rlike("^[A-Z]$")
        return F.when(letter, (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + c.try_cast("int")) % 97).cast("int")

    return F.aggregate(F.split(rotated, ""), F.lit(0), step)


def _date_parts(m: Column) -> tuple[Column, Column]:
    """The day that a date names, and the pattern it has."""
    pattern = F.when(m.rlike("^[0-9]{4}-"), F.lit("yyyy-MM-dd")).when(m.contains("."), F.lit("dd.MM.yyyy")).when(F.substring(m, 4, 2).cast("int") <= 12, F.lit("dd/MM/yyyy")).otherwise(F.lit("MM/dd/yyyy"))
    y = F.when(m.rlike("^[0-9]{4}-"), F.substring(m, 1, 4)).otherwise(F.substring(m, 7, 4))
    a, b = F.substring(m, 1, 2), F.substring(m, 4, 2)
    mo = F.when(pattern == "yyyy-MM-dd", F.substring(m, 6, 2)).when(pattern == "MM/dd/yyyy", a).otherwise(b)
    d = F.when(pattern == "yyyy-MM-dd", F.substring(m, 9, 2)).when(pattern == "MM/dd/yyyy", b).otherwise(a)
    day = F.try_to_timestamp(F.concat_ws("-", y, mo, d), F.lit("yyyy-MM-dd")).cast("date")
    return day, pattern


def _octet(m: Column, k: int) -> Column:
    return F.element_at(F.split(m, r"\."), k).cast("long")


#: Numbers of the kinds whose values are those of a range.
_BOUNDS = {"ssn": 898 * 99 * 9999, "date": _DAYS, "ip": 1 << 32}


def _kind(x: Column) -> Column:
    """The kind of a match that validates, else null."""
    m, d, bare = x["m"], x["d"], x["bare"]
    n = F.length(d)
    area, group, serial = F.substring(m, 1, 3).cast("long"), F.substring(m, 5, 2).cast("long"), F.substring(m, 8, 4).cast("long")
    found = F.when(m.rlike(r"(?i)^(?:password|passwd|pwd|token|secret|api|access)[^@]*?[=:]"), F.lit("secret")).when(m.contains("@"), F.lit("email"))
    found = found.when(m.rlike("^[A-Z]{2}[0-9]{2}") & F.length(bare).between(15, 34), F.when(_mod97(bare) == 1, F.lit("iban")))
    found = found.when(m.startswith("+") & n.between(8, 15), F.lit("phone"))
    found = found.when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), F.lit("ssn")))
    found = found.when(m.rlike(PATTERNS["date"]) & m.rlike("^.{10}$") & ~m.rlike("[ @]"), F.when(F.year(_date_parts(m)[0]).between(1900, 2099), F.lit("date")))
    found = found.when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.when(F.greatest(*[_octet(m, k) for k in (1, 2, 3, 4)]) < 256, F.lit("ip")))
    return found.when(m.rlike("^[0-9]") & n.between(13, 19), F.when(_luhn(d, False) % 10 == 0, F.lit("card")))


def _by(kind: Column, **of: Column) -> Column:
    """The column of the kind; null for the other kinds."""
    out = F
    for k, c in of.items():
        out = out.when(kind == k, c)
    return out


def _split(x: Column) -> tuple[Column, Column]:
    """What of a match is replaced as a whole, and what else its new form needs: the name of a secret, the letters of an IBAN, the country code of a phone number."""
    m, kind, d, bare = x["m"], x["kind"], x["d"], x["bare"]
    n = F.length(d)
    head = F.regexp_extract(m, r"(?i)^([^=:]+[=:]\s*[\"']?)", 1)
    own = F.substring(bare, F.lit(5), F.length(bare))
    code = F.length(F.regexp_extract(m, r"^\+([0-9]{1,3})(?=[^0-9])", 1))
    code = F.when(code == 0, 2).otherwise(code)
    area, group, serial = F.substring(m, 1, 3).cast("long"), F.substring(m, 5, 2).cast("long"), F.substring(m, 8, 4).cast("long")
    # issuable areas in order: 001..665 and 667..899
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    padded = lambda y, kind: F.lpad(y.cast("string"), len(str(_BOUNDS[kind] - 1)), "0")
    part = _by(
        kind,
        secret=F.substring(m, F.length(head) + 1, F.length(m)),
        iban=_digits(own),
        phone=F.substring(d, code + 1, n),
        ssn=padded((place * 99 + group - 1) * 9999 + serial - 1, "ssn"),
        date=padded(F.datediff(_date_parts(m)[0], F.lit(_DAY0).cast("date")), "date"),
        ip=padded(((_octet(m, 1) * 256 + _octet(m, 2)) * 256 + _octet(m, 3)) * 256 + _octet(m, 4), "ip"),
        card=F.substring(d, F.lit(1), n - 1),
    )
    return part, _by(kind, secret=head, iban=F.regexp_replace(own, "[^A-Z]", ""), phone=F.substring(d, F.lit(1), code))


def _renewed(x: Column, key: Column) -> tuple[Column, Column]:
    """The new forms of both."""
    kind, part, rest = x["kind"], x["part"], x["rest"]
    parts = F.sequence(F.lit(0), F.floor((F.length(part) - 1) / 64).cast("int"))
    digests = F.transform(parts, lambda i: F.sha2(F.concat(key, F.lit("|secret|"), i.cast("string"), F.lit("|"), part), 256))
    hashed = F.substring(F.array_join(digests, ""), F.lit(1), F.length(part))
    few = (kind == "iban") & (F.length(part) < 2)
    bound = _by(kind, **{k: F.lit(n).cast("long") for k, n in _BOUNDS.items()})
    new = F.when(kind == "secret", hashed).when(few, moved(part, 10, "0", key, "iban")).when(part.isNotNull(), walked(part, bound, key, kind))
    return new, F.when(kind == "iban", moved(rest, 26, "A", key, "iban")).otherwise(rest)


def _shown(x: Column, key: Column) -> Column:
    """The new text of a match."""
    m, kind, bare, part, new, rest = (x[k] for k in ("m", "kind", "bare", "part", "new", "rest"))
    secret = F.concat(rest, F.when((F.upper(part) == part) & (F.lower(part) != part), F.upper(new)).otherwise(new))
    email = F.concat(F.lit("u"), F.substring(F.sha2(F.concat(key, F.lit("|email|"), F.lower(m)), 256), 1, 16), F.lit("@mail.invalid"))
    body = F.concat(F.substring(bare, 1, 2), F.lit("00"), refit(refit(F.substring(bare, F.lit(5), F.length(bare)), new), rest, "[A-Z]"))
    checked = F.lpad((98 - _mod97(body)).cast("string"), 2, "0")
    luhn = ((10 - _luhn(new, True) % 10) % 10).cast("string")
    shaped = refit(m, _by(kind, iban=F.concat(checked, new), phone=F.concat(rest, new), card=F.concat(new, luhn)))
    index = new.cast("long")
    new_place = F.floor(index / (99 * 9999)).cast("long")
    new_area = F.when(new_place >= 665, new_place + 2).otherwise(new_place + 1)
    ssn = F.format_string("%03d-%02d-%04d", new_area, F.floor(index / 9999).cast("long") % 99 + 1, index % 9999 + 1)
    new_day, pattern = F.date_add(F.lit(_DAY0).cast("date"), new.cast("int")), _date_parts(m)[1]
    y, mo, dd = F.lpad(F.year(new_day).cast("string"), 4, "0"), F.lpad(F.month(new_day).cast("string"), 2, "0"), F.lpad(F.day(new_day).cast("string"), 2, "0")
    # a day over 12 could not be told from a month, so slashed dates stay readable the way they were
    date = F.transform(F.array(pattern), lambda p: F.when(p == "yyyy-MM-dd", F.concat_ws("-", y, mo, dd)).when(p == "dd.MM.yyyy", F.concat_ws(".", dd, mo, y)).when(p == "dd/MM/yyyy", F.concat_ws("/", dd, mo, y)).otherwise(F.concat_ws("/", mo, dd, y)))
    ip = F.concat_ws(".", *[(F.floor(index / (1 << s)) % 256).cast("string") for s in (24, 16, 8, 0)])
    whole = _by(kind, secret=secret, email=email, ssn=ssn, date=F.get(date, F.lit(0)), ip=ip)
    return F.when(kind == "iban", refit(shaped, F.concat(F.substring(bare, 1, 2), rest), "[A-Z]")).when(kind.isin("phone", "card"), shaped).when(kind.isNull(), m).otherwise(whole)


def replacements(found: Column, key: Column) -> Column:
    """(kind, s) for each match of ANY; kind null and the match itself where it does not validate.

    Each step reads what the one before it has bound to a name, so that nothing is spelled out, planned or computed more than once.
    """
    x = F.transform(found, lambda m: F.struct(m.alias("m"), _digits(m).alias("d"), F.regexp_replace(m, " ", "").alias("bare")))
    x = F.transform(x, lambda x: F.struct(x["m"].alias("m"), x["d"].alias("d"), x["bare"].alias("bare"), _kind(x).alias("kind")))
    x = F.transform(x, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), x["bare"].alias("bare"), *[c.alias(k) for c, k in zip(_split(x), ("part", "rest"), strict=True)]))
    x = F.transform(x, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), x["bare"].alias("bare"), x["part"].alias("part"), *[c.alias(k) for c, k in zip(_renewed(x, key), ("new", "rest"), strict=True)]))
    return F.transform(x, lambda x: F.struct(x["kind"].alias("kind"), _shown(x, key).alias("s")))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", counts: bool = True) -> DataFrame:
    """docs with the text column rewritten under a key that is not empty and, if counts, n_pii (matches replaced) and pii_kinds (their kinds in order; array<string>).

    Null text stays null, with n_pii 0; empty text stays empty. Other columns pass through, whatever their names; existing columns n_pii and pii_kinds are replaced.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    own, hits, new = free_names(docs, "key", "found", "new")
    text = F.col(f"`{text_col}`")
    likely = text.rlike("[0-9@=:]")
    found = F.when(likely, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    done = docs.withColumn(own, _hidden(docs.sparkSession, key)).withColumn(hits, found)
    done = done.withColumn(new, replacements(F.col(hits), F.col(own)))
    whole = F.when(F.size(hits) > 0, F.array_join(F.zip_with(F.split(text, ANY, -1), new, lambda p, x: F.concat(p, F.coalesce(x["s"], F.lit("")))), "")).otherwise(text)
    done = done.withColumn(text_col, whole)
    if counts:
        kinds = F.filter(F.transform(new, lambda x: x["kind"]), lambda k: k.isNotNull())
        done = done.withColumn("pii_kinds", F.coalesce(kinds, F.array().cast("array<string>"))).withColumn("n_pii", F.size("pii_kinds").cast("long"))
    return done.drop(own, hits, new)


def _hidden(spark: SparkSession, key: str) -> Column:
    """The key as a value that neither plans nor event logs spell out."""
    return spark.createDataFrame(pa.table({"k": [key]})).scalar()


@lru_cache(maxsize=1)
def _drawn_key() -> str:
    return secrets.token_hex(32)


def session_key(spark: SparkSession) -> str:
    """The key that the session's setting names, else one drawn for this application."""
    return spark.conf.get(KEY_SETTING, None) or _drawn_key()


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rewritten rows with the columns of docs; n_chars follows the text."""
    done = pseudonymize(docs, session_key(spark), counts=False)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
