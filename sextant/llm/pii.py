"""Personal data replaced by format-preserving Feistel pseudonyms, in DataFrame functions only.

A value is found by its pattern and validated (Luhn, IBAN mod 97, calendar, octets, area codes). What identifies in it is
split into two numbers, and eight keyed rounds add to each a function of the other, modulo its range: a permutation of
the format's values. Check digits are computed anew. Equal values get equal pseudonyms, in whatever document they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.arrays import let

ROUNDS = 8
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")

#: The formats' patterns. The first that matches at a place wins. Repeated groups are bounded or possessive:
#: other ones make the engine go a level deeper for each repetition.
_END = r"(?![0-9A-Za-z])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z-])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-]?[0-9]{4}" + _END,
    "card": r"[0-9](?:[ -]?[0-9]){12,18}" + _END,
}
# What a number may begin with and what may not stand before it come first: most places fail there.
_NUMBERS = r"(?=[0-9(+A-Z])(?<![0-9A-Za-z.+-])(?:" + "|".join(f"(?:{PATTERNS[k]})" for k in KINDS if k != "email") + ")"
_HAS_NUMBER = "[0-9][0-9.-]"
_FIRST_DAY, _DAYS = "1900-01-01", (17, 4297)  # 17 * 4297 days: to 2099-12-31


def feistel(a: Column, b: Column, ranges: tuple[Column, Column], key: str, tweak: Column) -> Column:
    """struct(a, b): a permutation of [0, ranges[0]) x [0, ranges[1]), given by key and tweak."""
    m, n = (r.cast("long") for r in ranges)

    def prf(i: Column, x: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), x.cast("string")), 256), 1, 14), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["a"] + prf(i, s["b"]), m)).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(F.pmod(s["b"] + prf(i, s["a"]), n)).alias("b"),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, step)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def in_format(shape: Column, new: Column) -> Column:
    """new's characters in the places of shape's letters and digits, the others as they are."""
    def put(state: Column, c: Column) -> Column:
        alnum = F.rlike(c, F.lit("[0-9A-Za-z]"))
        return F.struct(F.concat(state["out"], F.when(alnum, F.substring(new, state["n"], F.lit(1))).otherwise(c)).alias("out"), F.when(alnum, state["n"] + 1).otherwise(state["n"]).alias("n"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("n")), put, lambda s: s["out"])


def luhn_sum(number: Column) -> Column:
    """The Luhn sum of a string of digits, the last counting once."""
    reverse = F.split(F.reverse(number), "")
    each = F.transform(reverse, lambda c, i: c.cast("int") * F.when(i % 2 == 1, F.lit(2)).otherwise(F.lit(1)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))


def mod97(text: Column) -> Column:
    """A string of digits and capitals (A is 10) modulo 97."""
    def step(s: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (s * 100 + code - 55) % 97).otherwise((s * 10 + code - 48) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _text(x: Column, width: Column | int) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def valid(kind: str, v: Column) -> Column:
    d = digits(v)
    if kind == "iban":
        plain = F.replace(v, F.lit(" "), F.lit(""))
        return F.length(plain).between(15, 34) & (mod97(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))) == 1)
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda o: o.cast("int") <= 255)
    if kind == "date":
        return F.try_to_timestamp(v, F.lit("yyyy-MM-dd")).isNotNull()
    if kind == "ssn":
        return (F.substring(d, 1, 3).cast("int").between(1, 899)) & (F.substring(d, 1, 3) != "666") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")
    if kind == "card":
        return luhn_sum(d) % 10 == 0
    return F.lit(True)


def pseudonym(kind: str, v: Column, key: str) -> Column:
    """The pseudonym of a valid value of the kind."""
    tweak = lambda x: F.concat_ws(":", F.lit(kind), x)
    ten = lambda n: F.pow(F.lit(10.0), n).cast("long")
    if kind == "email":
        return F.concat(F.lit("p"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lower(v)), 256), 1, 16), F.lit("@mail.invalid"))
    if kind == "ip":
        o = F.split(v, r"\.")
        pair = feistel(o[0].cast("long") * 256 + o[1].cast("long"), o[2].cast("long") * 256 + o[3].cast("long"), (F.lit(65536), F.lit(65536)), key, tweak(F.lit("")))
        return let(pair, lambda p: F.concat_ws(".", *(x.cast("string") for x in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256))))
    if kind == "date":
        day = F.datediff(F.try_to_timestamp(v, F.lit("yyyy-MM-dd")).cast("date"), F.lit(_FIRST_DAY).cast("date"))
        pair = feistel(F.floor(day / _DAYS[1]), day % _DAYS[1], (F.lit(_DAYS[0]), F.lit(_DAYS[1])), key, tweak(F.lit("")))
        return let(pair, lambda p: F.date_format(F.date_add(F.lit(_FIRST_DAY).cast("date"), (p["a"] * _DAYS[1] + p["b"]).cast("int")), "yyyy-MM-dd"))
    if kind == "ssn":
        d = digits(v)
        area = F.substring(d, 1, 3).cast("int")
        rest = (F.substring(d, 4, 2).cast("long") - 1) * 9999 + F.substring(d, 6, 4).cast("long") - 1
        pair = feistel(F.when(area > 666, area - 2).otherwise(area - 1), rest, (F.lit(898), F.lit(99 * 9999)), key, tweak(F.lit("")))
        return let(pair, lambda p: F.concat_ws("-", _text(F.when(p["a"] >= 665, p["a"] + 2).otherwise(p["a"] + 1), 3), _text(F.floor(p["b"] / 9999) + 1, 2), _text(p["b"] % 9999 + 1, 4)))
    if kind == "phone":
        national = F.substring(digits(v), -10, 10)
        area, exchange, line = (F.substring(national, i, n).cast("long") for i, n in ((1, 3), (4, 3), (7, 4)))
        pair = feistel((area - 200) * 800 + exchange - 200, line, (F.lit(640000), F.lit(10000)), key, tweak(F.lit("")))
        lead = F.substring(digits(v), F.lit(1), F.length(digits(v)) - 10)
        return in_format(v, F.concat(lead, let(pair, lambda p: F.concat(_text(F.floor(p["a"] / 800) + 200, 3), _text(p["a"] % 800 + 200, 3), _text(p["b"], 4)))))
    if kind == "card":
        d = digits(v)
        body = F.substring(d, F.lit(2), F.length(d) - 2)
        left = F.floor(F.length(body) / 2).cast("int")
        right = F.length(body) - left
        pair = feistel(F.substring(body, F.lit(1), left).cast("long"), F.substring(body, left + 1, right).cast("long"), (ten(left), ten(right)), key, tweak(F.concat_ws(".", F.substring(d, 1, 1), F.length(d))))
        head = let(pair, lambda p: F.concat(F.substring(d, 1, 1), _text(p["a"], left), _text(p["b"], right)))
        return in_format(v, let(head, lambda h: F.concat(h, F.pmod(-luhn_sum(F.concat(h, F.lit("0"))), F.lit(10)).cast("string"))))
    if kind == "iban":
        plain = F.replace(v, F.lit(" "), F.lit(""))
        account = F.substring(plain, F.lit(5), F.length(plain) - 4)
        d = digits(account)
        left = F.floor(F.length(d) / 2).cast("int")
        right = F.length(d) - left
        shape = F.translate(account, "0123456789", "##########")
        number = lambda s: F.when(s == "", F.lit(0)).otherwise(s.cast("long"))
        pair = feistel(number(F.substring(d, F.lit(1), left)), number(F.substring(d, left + 1, right)), (ten(left), ten(right)), key, tweak(F.concat(F.substring(plain, 1, 2), shape)))
        new_digits = let(pair, lambda p: F.concat(F.when(left > 0, _text(p["a"], left)).otherwise(F.lit("")), F.when(right > 0, _text(p["b"], right)).otherwise(F.lit(""))))

        def fill(state: Column, c: Column) -> Column:
            hole = c == "#"
            return F.struct(F.concat(state["out"], F.when(hole, F.substring(state["rest"], 1, 1)).otherwise(c)).alias("out"), F.when(hole, F.substring(state["rest"], 2, 40)).otherwise(state["rest"]).alias("rest"))

        filled = F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), new_digits.alias("rest")), fill, lambda s: s["out"])
        country = F.substring(plain, 1, 2)
        return in_format(v, let(filled, lambda x: F.concat(country, _text(98 - mod97(F.concat(x, country, F.lit("00"))), 2), x)))
    raise ValueError(kind)


def _kind_of(v: Column) -> Column:
    """The kind whose whole pattern a match has and whose validation it passes, else null."""
    out = F.lit(None).cast("string")
    for kind in reversed([k for k in KINDS if k != "email"]):
        out = F.when(F.when(F.rlike(v, F.lit(f"^(?:{PATTERNS[kind]})$")), valid(kind, v)).otherwise(F.lit(False)), F.lit(kind)).otherwise(out)
    return out


#: Kinds whose patterns may take in neighbouring groups of digits or letters, and what separates groups.
_GREEDY = {"iban": " ", "card": "[ -]"}


def _inner(v: Column) -> Column:
    """struct(kind, start, value) of a valid IBAN or card number within a match that is none as a whole, else null.

    Candidates are runs of whole groups: of valid ones the first IBAN, else the first card number of 16 digits, else of
    any length. Matches have at most 37 characters.
    """
    kind_of = "struct<kind:string,start:int,value:string>"

    def candidates(kind: str) -> Column:
        at = F.sequence(F.lit(1), F.length(v))
        edge = lambda i: F.rlike(F.substring(v, i, F.lit(1)), F.lit(_GREEDY[kind]))
        starts = F.filter(at, lambda i: ~edge(i) & ((i == 1) | edge(i - 1)))
        ends = F.filter(at, lambda i: ~edge(i) & ((i == F.length(v)) | edge(i + 1)))
        runs = F.flatten(F.transform(starts, lambda s: F.transform(F.filter(ends, lambda e: e >= s), lambda e: F.struct(F.lit(kind).alias("kind"), s.alias("start"), F.substring(v, s, e - s + 1).alias("value")))))
        return F.filter(runs, lambda r: F.when(F.rlike(r["value"], F.lit(f"^(?:{PATTERNS[kind]})$")), valid(kind, r["value"])).otherwise(F.lit(False)))

    usual = lambda r: F.length(digits(r["value"])) == 16
    card = let(candidates("card"), lambda c: F.coalesce(F.get(F.filter(c, usual), F.lit(0)), F.get(c, F.lit(0))))
    return F.coalesce(F.get(candidates("iban"), F.lit(0)).cast(kind_of), F.when(F.rlike(v, F.lit("(?:[0-9][ -]?){13}")), card).cast(kind_of))


def pseudonymize(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, found): the text with pseudonyms, and found, an array of (kind, pseudonym), e-mail addresses first, then the others in the order of places.

    E-mail addresses become keyed names at mail.invalid; IBANs, IPv4 addresses, dates from 1900 to 2099, social security
    numbers, North American phone numbers and payment card numbers are permuted within their formats. What fails its
    validation stays, but for a valid IBAN or card number among the groups that were taken together. A null text stays null and finds nothing. The text is read whole; repeated rows are answered each,
    an empty table gives an empty one, other columns are ignored.
    """
    found_type = "array<struct<kind:string,pseudonym:string>>"
    empty = F.array().cast(found_type)

    def pass_over(text: Column, wanted: Column, pattern: str, change) -> Column:
        """struct(text, found) with each match changed; gaps and matches alternate."""
        hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change)
        gaps = F.split(text, pattern, -1)
        whole = let(hits, lambda h: F.struct(F.array_join(F.zip_with(gaps, h, lambda g, x: F.concat(g, F.coalesce(x["text"], F.lit("")))), "").alias("text"), F.transform(F.filter(h, lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["kind"], x["pseudonym"])).cast(found_type).alias("found")))
        return F.when(wanted, whole).otherwise(F.struct(text.alias("text"), empty.alias("found")))

    def change_number(v: Column) -> Column:
        def named(f: Column) -> Column:
            new = F.lit(None).cast("string")
            for kind in KINDS:
                if kind != "email":
                    new = F.when(f["kind"] == kind, pseudonym(kind, f["value"], key)).otherwise(new)
            return let(new, lambda n: F.struct(f["kind"].alias("kind"), n.alias("pseudonym"), F.when(n.isNull(), v).otherwise(F.concat(F.substring(v, F.lit(1), f["start"] - 1), n, F.substring(v, f["start"] + F.length(f["value"]), F.length(v)))).alias("text")))

        whole = lambda k: F.when(k.isNotNull(), F.struct(k.alias("kind"), F.lit(1).alias("start"), v.alias("value"))).otherwise(_inner(v))
        return let(let(_kind_of(v), whole), named)

    def change_mail(v: Column) -> Column:
        return let(pseudonym("email", v, key), lambda n: F.struct(F.lit("email").alias("kind"), n.alias("pseudonym"), n.alias("text")))

    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    mails = rows.select("id", pass_over(text, F.contains(text, F.lit("@")) & F.rlike(text, F.lit(PATTERNS["email"])), PATTERNS["email"], change_mail).alias("m"))
    mails = mails.select("id", F.col("m.text").alias("text"), F.col("m.found").alias("mails"))
    both = mails.select("id", "mails", pass_over(text, F.rlike(text, F.lit(_HAS_NUMBER)) & F.rlike(text, F.lit(_NUMBERS)), _NUMBERS, change_number).alias("m"))
    return both.select(F.col("id").alias(id_col), F.col("m.text").alias("text"), F.concat("mails", "m.found").alias("found"))
