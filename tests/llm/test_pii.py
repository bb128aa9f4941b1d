import hashlib
from datetime import date, timedelta

import pytest
import regex
from lodestone.llm import pii

SMALL = "/root/testdata/sf0.01"
KEY = "k1"


def feistel(digits, tweak):
    n = len(digits)
    u, v = n // 2, n - n // 2
    a, b = int(digits[:u]), int(digits[u:])
    for i in range(pii.ROUNDS):
        f = int(hashlib.sha256("|".join(map(str, (KEY, tweak, i, n, b))).encode()).hexdigest()[:15], 16)
        a, b = b, (a + f) % 10 ** (v if i % 2 else u)
    return str(a).zfill(u) + str(b).zfill(v)


def below(x, bound, tweak):
    while True:
        x = int(feistel(str(x).zfill(len(str(bound - 1))), tweak))
        if x < bound:
            return x


def luhn(s):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10


def refit(shape, digits, kind="0123456789"):
    it = iter(digits)
    return "".join(next(it) if c in kind else c for c in shape)


def moved(signs, base, first, tweak):
    n = len(signs)
    halves = [signs[: n // 2], signs[n // 2 :]]
    for i in range(pii.ROUNDS):
        h = hashlib.sha256("|".join(map(str, (KEY, tweak, i, n, halves[1 - i % 2]))).encode()).hexdigest()
        halves[i % 2] = "".join(chr(ord(first) + (ord(c) - ord(first) + int(h[j * 2 % 62 : j * 2 % 62 + 3], 16)) % base) for j, c in enumerate(halves[i % 2]))
    return "".join(halves)


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def brute(m):
    d = regex.sub("[^0-9]", "", m)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if regex.match(r"(?i)(?:password|passwd|pwd|token|secret|api|access)[^@]*?[=:]", m):
        head = regex.match(r"(?i)[^=:]+[=:]\s*[\"']?", m)[0]
        value = m[len(head) :]
        h = "".join(sha(f"{KEY}|secret|{i}|{value}") for i in range(4))[: len(value)]
        return head + (h.upper() if value.upper() == value and value.lower() != value else h)
    if "@" in m:
        return f"u{sha(f'{KEY}|email|{m.lower()}')[:16]}@mail.invalid"
    bare = m.replace(" ", "")
    if regex.match("[A-Z]{2}[0-9]{2}", m) and 15 <= len(bare) <= 34:
        if mod97(bare) != 1:
            return None
        rest = feistel(d[2:], "iban") if len(d) > 3 else moved(d[2:], 10, "0", "iban")
        letters = moved(regex.sub("[^A-Z]", "", bare[4:]), 26, "A", "iban")
        body = bare[:2] + "00" + refit(refit(bare[4:], rest), letters, LETTERS)
        return refit(refit(m, str(98 - mod97(body)).zfill(2) + rest), bare[:2] + letters, LETTERS)
    if m[0] == "+" and 8 <= len(d) <= 15:
        code = regex.match(r"\+([0-9]{1,3})(?=[^0-9])", m)
        code = len(code[1]) if code else 2
        return refit(m, d[:code] + feistel(d[code:], "phone"))
    if regex.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", m):
        a, g, s = int(m[:3]), int(m[4:6]), int(m[7:])
        if not (0 < a < 900 and a != 666 and g and s):
            return None
        areas = [x for x in range(1, 900) if x != 666]
        k = below((areas.index(a) * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, "ssn")
        return f"{areas[k // (99 * 9999)]:03d}-{k // 9999 % 99 + 1:02d}-{k % 9999 + 1:04d}"
    if len(m) == 10 and regex.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\1[0-9]{4}", m):
        if m[4] == "-":
            y, mo, dd, form = m[:4], m[5:7], m[8:], "{0:04d}-{1:02d}-{2:02d}"
        elif m[2] == "." or int(m[3:5]) <= 12:
            y, mo, dd, form = m[6:], m[3:5], m[:2], f"{{2:02d}}{m[2]}{{1:02d}}{m[2]}{{0:04d}}"
        else:
            y, mo, dd, form = m[6:], m[:2], m[3:5], "{1:02d}/{2:02d}/{0:04d}"
        try:
            day = date(int(y), int(mo), int(dd))
        except ValueError:
            return None
        if not 1900 <= day.year <= 2099:
            return None
        new = date(1900, 1, 1) + timedelta(below((day - date(1900, 1, 1)).days, 73049, "date"))
        return form.format(new.year, new.month, new.day)
    if regex.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", m):
        o = [int(x) for x in m.split(".")]
        if max(o) > 255:
            return None
        k = below(int.from_bytes(bytes(o), "big"), 1 << 32, "ip")
        return ".".join(map(str, k.to_bytes(4, "big")))
    if m[0] in "0123456789" and 13 <= len(d) <= 19 and luhn(d) == 0:
        p = feistel(d[:-1], "card")
        return refit(m, p + str(-luhn(p + "0") % 10))
    return None


PATTERN = regex.compile(pii.ANY)


def whole(text):
    """(new text, number of replacements)."""
    hits = 0

    def put(m):
        nonlocal hits
        new = brute(m[0])
        hits += new is not None
        return m[0] if new is None else new

    return (None, 0) if text is None else (PATTERN.sub(put, text), hits)


CASES = [
    "mail a.b-c@ex.com, card 4111 1111 1111 1111 and 4111111111111112 no; +1 (319) 555-5132 79.197.74.40 300.1.1.1 1.2.3.4.",
    "born 1987-02-28, 31.12.1999, 30.02.2001 no, 12/25/2020 and 25/12/2020 1850-01-01; ssn 123-45-6789 666-12-1234 IBAN DE89370400440532013000 GB82 WEST 1234 5698 7654 32 GB83 WEST 1234 5698 7654 32",
    'password=e3b3ed3cc8548923d6 token = "76ce86d4952db1ee140095c8f6e334d186126d15" TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!! api_key: abcdefgh',
    "3782 822463 10005, 378282246310005 6011-1111-1111-1117 +442079460958 +44 20 7946 0958. version 3. 1.2.3.4.5 a1234567890123456",
    "+1 (319) 555-5132%%% x 79.197.74.40!! ü.90@mail2.example.com### 4370598173842409$$$",
    "",
    None,
    "long " * 40_000 + "4370598173842409",
]


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10**6 + i, t) for i, t in enumerate(CASES)]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, n_pii string")
    got = {r.doc_id: (r.text, r.n_pii) for r in pii.pseudonymize(df, KEY).collect()}
    want = {d: whole(t) for d, t in rows}
    assert got == want
    assert sum(n for _, n in want.values()) > 80


def test_pseudonyms_keep_their_format(spark):
    cards = [f"{4000000000000000 + 37 * k}" for k in range(3000)]
    cards = [c[:-1] + str(-luhn(c[:-1] + "0") % 10) for c in cards]
    days = [str(date(1950, 1, 1) + timedelta(k)) for k in range(3000)]
    ips = [f"{k % 256}.{k // 256}.7.9" for k in range(3000)]
    got = pii.pseudonymize(spark.createDataFrame([(f"{a} {b} {c} {a}",) for a, b, c in zip(cards, days, ips, strict=True)], "text string"), KEY).collect()
    parts = [r.text.split(" ") for r in got]
    assert all(r.n_pii == 4 for r in got) and all(p[0] == p[3] and luhn(p[0]) == 0 and len(p[0]) == 16 for p in parts)
    for k, old in ((0, cards), (1, days), (2, ips)):
        assert len({p[k] for p in parts}) == len(set(old))  # different values stay different
    assert all("1900-01-01" <= p[1] <= "2099-12-31" and all(0 <= int(x) < 256 for x in p[2].split(".")) for p in parts)


def test_no_python_and_empty(spark):
    plan = pii.op2(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert pii.pseudonymize(spark.createDataFrame([], "doc_id long, text string"), KEY).collect() == []


def test_secrets_of_any_length_and_with_signs(spark):
    token = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(8))[:500]
    values = [token, "Pa$$w0rd123", "Tr0ub4dor&3", "a,b;c*d%e#f!g", "!!$$##%%", token * 20]
    texts = [f"{name}{v}{end}" for v in values for name, end in (("token=", " is it"), ('password: "', '" and more'), ("pwd=", "\nnext line"))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in pii.pseudonymize(df, KEY).collect()}
    for i, (v, (name, end)) in enumerate((v, x) for v in values for x in (("token=", " is it"), ('password: "', '" and more'), ("pwd=", "\nnext line"))):
        new = got[i].text
        assert new.startswith(name) and new.endswith(end) and len(new) == len(texts[i]) and got[i].pii_kinds == ["secret"]
        digest = "".join(hashlib.sha256(f"{KEY}|secret|{k}|{v}".encode()).hexdigest() for k in range(len(v) // 64 + 1))[: len(v)]
        assert new[len(name) : len(new) - len(end)].lower() == digest


def test_ibans_of_any_letters_and_digits(spark):
    import numpy as np

    rng, given = np.random.default_rng(4), []
    for n in range(11, 31):
        for digits in sorted({0, 1, 2, n // 2, n - 1, n}):
            own = [LETTERS[k] for k in rng.integers(0, 26, n)]
            for k in rng.choice(n, digits, replace=False):
                own[k] = str(rng.integers(0, 10))
            code = LETTERS[rng.integers(0, 26)] + LETTERS[rng.integers(0, 26)]
            bare = code + str(98 - mod97(code + "00" + "".join(own))).zfill(2) + "".join(own)
            given.append(bare if n % 2 else " ".join(bare[k : k + 4] for k in range(0, len(bare), 4)))
    given += ["GB21 ABCD EFGH IJKL", "GB37 ABCD EFGH IJK5"]
    got = [r.text for r in pii.pseudonymize(spark.createDataFrame([(k, f"at {t} now") for k, t in enumerate(given)], "doc_id int, text string"), KEY).orderBy("doc_id").collect()]
    assert got == [f"at {brute(t) or t} now" for t in given]
    for old, new in zip(given, got, strict=True):
        new = new[3:-4]
        assert new[:2] == old[:2] and [c.isdigit() for c in new] == [c.isdigit() for c in old] and [c == " " for c in new] == [c == " " for c in old]
        assert mod97(new.replace(" ", "")) == 1 or new == old


def test_key_of_the_session(spark):
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymize(spark.range(1).selectExpr("'x' as text"), "")
    assert len(pii.session_key(spark)) >= 32 and pii.session_key(spark) == pii.session_key(spark)
    spark.conf.set(pii.KEY_SETTING, "set")
    try:
        assert pii.session_key(spark) == "set"
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_key_is_in_no_plan_and_masked_in_settings(spark):
    key = "0123-a-key-to-find"
    out = pii.pseudonymize(spark.createDataFrame([(1, "a@b.de 4111111111111111")], "doc_id long, text string"), key)
    out.collect()
    plans = out._jdf.queryExecution()
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString
    assert not any(key in x for x in (plans.toString(), *[plans.explainString(mode(m)) for m in ("extended", "codegen", "formatted")]))
    assert regex.search(r"(?i)secret|password|token|access[.]?key", pii.KEY_SETTING)


def test_columns_of_any_name(spark):
    names = ["key", "found", "new", "key_", "NEW_", "__found", "__new", "k"]
    df = spark.createDataFrame([(1, "a@b.de", *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = pii.pipeline_stage(spark, df, "")
    assert got.columns == df.columns and got.first()[2:] == tuple(names) and got.first().text.endswith("@mail.invalid")


def test_plan_spells_out_each_step_once(spark):
    """Values that several formats read are bound to names: the driver plans one permutation, not one for each place that shows a part of it."""
    plan = pii.op2(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") <= 10 and len(plan) < 100_000
