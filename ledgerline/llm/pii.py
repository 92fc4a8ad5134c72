"""Personal data to format-preserving pseudonyms by keyed Feistel permutations, in DataFrame functions only.

One pattern finds candidates; each is checked (Luhn for cards, mod 97 for IBANs, the calendar for dates,
number ranges for the others) and what passes is permuted inside its format: digits stay digits, letters stay
letters of their case, marks stay, and a card, IBAN, address or date stays a valid one.  The permutation
depends on the key, the kind and the value alone, so equal values get equal pseudonyms in every document,
written with whatever separators, and different values of a format never get the same one.

A text is split at its matches by a mark that can't occur in it (it holds the text's own MD5), the matches are
permuted as array elements, and the pieces are put together again: one pass, no shuffle, no UDF.  Texts
without a match come back byte for byte.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import by_place, place_of

#: Demonstration key.  Whoever runs this on real data passes a secret one.
KEY = "ledgerline-demonstration-key"
ROUNDS = 8
#: Hex digits of the round hash that shift one character.
DRAW = 4

#: What is looked for, in order of precedence.  Fixed formats, stated as patterns.
PATTERNS = {
    "secret": r"""(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?i:password|passwd|pwd|secret|token|api[_-]?key) {0,2}[=:] {0,2}["'`]?(?=[A-Za-z0-9+/_\-.~=]{8})[A-Za-z0-9+/_\-~=]++(?:\.[A-Za-z0-9+/_\-~=]++)*+["'`]?)""",
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)",
    "date": r"(?<![\w/.\-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?!\w|[/\-]\d|\.\d)",
    "ssn": r"(?<![\w\-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w]|-\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]\d{3,4}(?![\w])|(?<![\w+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?![\w])|(?<![\w\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w]|-\d)",
}
#: IBANs and cards are looked for in runs of groups, as what stands beside a value may look like a part of it.  A run
#: doesn't go on with a group that begins a value of another kind.  Possessive, so its length isn't bounded.
_OTHER = "|".join(f"(?:{p})" for p in PATTERNS.values())
PATTERNS = {k: PATTERNS[k] for k in ("secret", "email", "ip", "date", "ssn")} | {
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d{{2}}(?:[ \-]?[A-Z0-9]{{4}}){{2}})[A-Z0-9]++(?![A-Za-z0-9])(?:[ \-](?!{_OTHER})[A-Z0-9]++(?![A-Za-z0-9]))*+",
    "phone": PATTERNS["phone"],
    "card": rf"(?<![\w+\-])(?=\d(?:[ \-]?\d){{12}})\d++(?!\w)(?:[ \-](?!{_OTHER})\d++(?!\w))*+",
}
#: Groups of a run that one value may take: cards have 19 digits at most, IBANs 34 characters in fours.
GROUPS = 19
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: First day of the dates that are permuted, their number, and the side of the square they are walked in.
FIRST_DAY, DAYS, SIDE = "1900-01-01", 73_049, 271


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def _draw(key: str, kind: str, turn: Column, other: Column, length: Column) -> Column:
    """Hex digits that depend on everything given, DRAW for each of ``length`` characters, 64 to an element."""
    per = 64 // DRAW
    return F.transform(F.sequence(F.lit(0), F.floor(length / per).cast("int")), lambda b: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), b.cast("string"), other).cast("binary"), 256))


def _letters(text: Column) -> Column:
    """The characters of a text as an array."""
    return F.split(text, "(?!^)(?=.)")


def _shift(text: Column, draw: Column) -> Column:
    """Move each digit and letter of a text along its own alphabet by its part of the draw."""

    def moved(c: Column, i: Column, hexes: Column) -> Column:
        per = 64 // DRAW
        own = F.element_at(hexes, F.floor(i / per).cast("int") + 1)
        by = F.conv(F.substring(own, i % per * DRAW + 1, F.lit(DRAW)), 16, 10).cast("int")
        code = F.ascii(c)
        along = lambda first, size: F.char(F.lit(first) + F.pmod(code - first + by, F.lit(size)))
        return F.when(c.between("0", "9"), along(48, 10)).when(c.between("a", "z"), along(97, 26)).when(c.between("A", "Z"), along(65, 26)).otherwise(c)

    return let(draw, lambda hexes: F.array_join(F.transform(_letters(text), lambda c, i: moved(c, i, hexes)), ""))


def permuted(text: Column, kind: str, key: str) -> Column:
    """Feistel permutation of a text within its format: halves in turn are shifted by a draw on the other."""

    def start(t: Column) -> Column:
        half = F.floor(F.length(t) / 2).cast("int")
        return F.struct(F.substring(t, F.lit(1), half).alias("a"), F.substring(t, half + 1, F.length(t)).alias("b"))

    def step(s: Column, turn: Column) -> Column:
        a, b = s["a"], s["b"]
        even = turn % 2 == 0
        return F.struct(
            F.when(even, _shift(a, _draw(key, kind, turn, b, F.length(a)))).otherwise(a).alias("a"),
            F.when(even, b).otherwise(_shift(b, _draw(key, kind, turn, a, F.length(b)))).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), let(text, start), step, lambda s: F.concat(s["a"], s["b"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _written(digits: Column, form: Column) -> Column:
    """Digits put in the places of the digits of a form."""

    def put(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(
            F.concat(s["done"], F.when(digit, F.substring(s["rest"], 1, 1)).otherwise(c)).alias("done"),
            F.when(digit, F.substring(s["rest"], F.lit(2), F.length(s["rest"]))).otherwise(s["rest"]).alias("rest"),
        )

    return F.aggregate(_letters(form), F.struct(F.lit("").alias("done"), digits.alias("rest")), put, lambda s: s["done"])


def luhn(digits: Column) -> Column:
    """Sum of the Luhn check over a text of digits: the last digit counts once, the one before it twice, and so on."""

    def add(s: Column, c: Column) -> Column:
        x = c.cast("int") * F.when(s["twice"], 2).otherwise(1)
        return F.struct((s["total"] + F.when(x > 9, x - 9).otherwise(x)).alias("total"), (~s["twice"]).alias("twice"))

    start = F.struct(F.lit(0).alias("total"), F.lit(False).alias("twice"))
    return F.aggregate(_letters(F.reverse(digits)), start, add, lambda s: s["total"])


def _card(value: Column, key: str) -> Column:
    def checked(digits: Column) -> Column:
        body = permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), "card", key)
        whole = let(body, lambda b: F.concat(b, F.pmod(-luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
        return F.when(_luhn_ok(digits), _written(whole, value)).otherwise(value)

    return let(_digits(value), checked)


def _mod97(text: Column) -> Column:
    """Remainder by 97 of an IBAN's digits and letters (A is 10), its first four characters moved to the end."""
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(_letters(moved), F.lit(0), add)


def _iban(value: Column, key: str) -> Column:
    def new(plain: Column) -> Column:
        land = F.substring(plain, 1, 2)
        body = permuted(F.substring(plain, F.lit(5), F.length(plain)), "iban", key)
        whole = let(body, lambda b: F.concat(land, F.lpad((F.lit(98) - _mod97(F.concat(land, F.lit("00"), b))).cast("string"), 2, "0"), b))

        def put(s: Column, c: Column) -> Column:
            space = c.isin(" ", "-")
            return F.struct(
                F.concat(s["done"], F.when(space, c).otherwise(F.substring(s["rest"], 1, 1))).alias("done"),
                F.when(space, s["rest"]).otherwise(F.substring(s["rest"], F.lit(2), F.length(s["rest"]))).alias("rest"),
            )

        spaced = F.aggregate(_letters(value), F.struct(F.lit("").alias("done"), whole.alias("rest")), put, lambda s: s["done"])
        return F.when(F.length(plain).between(15, 34) & (_mod97(plain) == 1), spaced).otherwise(value)

    return let(_joined(value), new)


def _joined(run: Column) -> Column:
    return F.regexp_replace(run, "[ \\-]", "")


def _luhn_ok(digits: Column) -> Column:
    return F.when(F.length(digits).between(13, 19), luhn(digits) % 10 == 0).otherwise(False)


def _iban_ok(plain: Column) -> Column:
    return F.when(plain.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), _mod97(plain) == 1).otherwise(False)


def _values(tokens: Column) -> Column:
    """Valid IBANs and cards of a run as (first token, tokens), in order, none overlapping another.

    Tokens are groups and the separators between them.  Every window of whole groups is tried; IBANs go before cards
    of 16 digits and these before other cards, then earlier ones and longer ones come first.
    """

    def rank(i: Column, m: Column) -> Column:
        text = F.array_join(F.slice(tokens, i, m), "")
        card = _joined(text)
        of_card = F.when(card.rlike("^[0-9]{13,19}$"), F.when(_luhn_ok(card), F.when(F.length(card) == 16, 1).otherwise(2)))
        return F.coalesce(F.when(_iban_ok(card), F.lit(0)), of_card)

    def windows(i: Column) -> Column:
        ends = F.sequence(F.lit(1), F.least(F.lit(2 * GROUPS - 1), F.size(tokens) - i + 1), F.lit(2))
        return F.filter(F.transform(ends, lambda m: F.struct(rank(i, m).alias("rank"), i.alias("i"), (-m).alias("less"))), lambda w: w["rank"].isNotNull())

    def choose(chosen: Column, w: Column) -> Column:
        taken = F.exists(chosen, lambda c: (w["i"] < c["i"] + c["m"]) & (c["i"] < w["i"] - w["less"]))
        return F.when(taken, chosen).otherwise(F.concat(chosen, F.array(F.struct(w["i"].alias("i"), (-w["less"]).alias("m")))))

    found = F.array_sort(F.flatten(F.transform(F.sequence(F.lit(1), F.size(tokens), F.lit(2)), windows)))
    return F.array_sort(F.aggregate(found, F.array().cast("array<struct<i:int,m:int>>"), choose))


def _parts(run: Column) -> Column:
    """A match as matches and what stands between them, in turn, a match first and last.

    A run of groups that isn't a valid value as a whole is cut at the values it holds; other matches stay whole.
    """

    def cut(tokens: Column) -> Column:
        def put(s: Column, v: Column) -> Column:
            between = F.array_join(F.slice(tokens, s["at"], v["i"] - s["at"]), "")
            return F.struct((v["i"] + v["m"]).alias("at"), F.concat(s["out"], F.array(between, F.array_join(F.slice(tokens, v["i"], v["m"]), ""))).alias("out"))

        start = F.struct(F.lit(1).alias("at"), F.array(F.lit("")).alias("out"))
        rest = lambda s: F.concat(s["out"], F.array(F.array_join(F.slice(tokens, s["at"], F.size(tokens)), ""), F.lit("")))
        return let(_values(tokens), lambda v: F.when(F.size(v) == 0, F.array(run)).otherwise(F.aggregate(v, start, put, rest)))

    groups = run.rlike(r"^(?:\d++|[A-Z]{2}\d{2}[A-Z0-9]*+)(?:[ \-][A-Z0-9]++)++$") & ~run.rlike(f"^(?:{_OTHER})$")
    valid = _luhn_ok(_joined(run)) & run.rlike("^[0-9 \\-]+$") | _iban_ok(_joined(run))
    return F.when(groups, F.when(valid, F.array(run)).otherwise(let(F.split(run, "(?<=[ \\-])|(?=[ \\-])"), cut))).otherwise(F.array(run))


def _number(key: str, kind: str, turn: Column, half: Column) -> Column:
    text = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 12), 16, 10).cast("long")


def _square(n: Column, side: int, kind: str, key: str) -> Column:
    """Feistel permutation of the numbers below side * side."""

    def step(s: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        return F.struct(
            F.when(even, (s["a"] + _number(key, kind, turn, s["b"])) % side).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise((s["b"] + _number(key, kind, turn, s["a"])) % side).alias("b"),
        )

    start = let(n, lambda x: F.struct(F.floor(x / side).cast("long").alias("a"), (x % side).cast("long").alias("b")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["a"] * side + s["b"])


def _ip(value: Column, key: str) -> Column:
    n = F.aggregate(F.split(value, r"\."), F.lit(0).cast("long"), lambda s, x: s * 256 + x.cast("long"))
    return let(_square(n, 1 << 16, "ip", key), lambda m: F.concat_ws(".", *[(F.shiftrightunsigned(m, s) % 256).cast("string") for s in (24, 16, 8, 0)]))


def _date(value: Column, key: str) -> Column:
    """Calendar dates from 1900 to 2099 in three ways of writing; others stay.  Walked until a date comes out."""

    def one(form: str) -> Column:
        n = F.datediff(F.to_date(F.try_to_timestamp(value, F.lit(form))), F.lit(FIRST_DAY).cast("date")).cast("long")
        start = F.struct(n.alias("n"), F.lit(False).alias("done"))

        def walk(s: Column, _: Column) -> Column:
            nxt = let(_square(s["n"], SIDE, "date", key), lambda m: F.struct(m.alias("n"), (m < DAYS).alias("done")))
            return F.when(s["done"], s).otherwise(nxt)

        new = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, walk, lambda s: s["n"])
        return F.when(n.between(0, DAYS - 1), F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int")), form)).otherwise(value)

    return F.when(value.contains("-"), one("yyyy-MM-dd")).when(value.contains("/"), one("dd/MM/yyyy")).otherwise(one("dd.MM.yyyy"))


def _phone(value: Column, key: str) -> Column:
    """The country code stays; the digits after it are permuted.  Numbers of 8 to 15 digits only."""

    def new(code: Column) -> Column:
        rest = F.substring(value, F.length(code) + 1, F.length(value))
        return F.concat(code, _written(permuted(_digits(rest), "phone", key), rest))

    code = F.regexp_extract(value, r"^(\+\d{1,3})(?=[ .\-(])", 1)
    return F.when(F.length(_digits(value)).between(8, 15), let(code, new)).otherwise(value)


def _email(value: Column, key: str) -> Column:
    """All but the top-level domain."""
    top = F.regexp_extract(value, r"\.[A-Za-z0-9\-]+$", 0)
    return let(top, lambda t: F.concat(permuted(F.substring(value, F.lit(1), F.length(value) - F.length(t)), "email", key), t))


def _secret(value: Column, key: str) -> Column:
    """The value after the word that announces it."""
    lead = F.regexp_extract(value, r"""^(AKIA|[A-Za-z_\-]+ {0,2}[=:] {0,2}["'`]?)""", 1)
    return let(lead, lambda x: F.concat(x, permuted(F.substring(value, F.length(x) + 1, F.length(value)), "secret", key)))


def pseudonym(value: Column, key: str) -> Column:
    """Pseudonym of one match; a match that fails its check stays as it is."""
    whole = lambda kind: value.rlike(f"^(?:{PATTERNS[kind]})$")
    makers = {"secret": _secret, "email": _email, "ip": _ip, "date": _date, "ssn": lambda v, k: _written(permuted(_digits(v), "ssn", k), v), "iban": _iban, "phone": _phone}
    start = F.when(whole("secret"), _secret(value, key))
    return reduce(lambda w, kind: w.when(whole(kind), makers[kind](value, key)), list(makers)[1:], start).otherwise(_card(value, key))


def pseudonymise(documents: DataFrame, text: str = "text", key: str = KEY, count: str | None = "n_values") -> DataFrame:
    """Replace personal data in a text column; ``count`` (unless None) is added: how many values were replaced.

    Kinds: secrets, e-mail addresses, IPv4 addresses, dates, US social security numbers, IBANs, phone numbers
    and payment cards.  Defined results: a null text stays null with count 0; a text without such values stays
    as it is; candidates that fail their check stay; overlapping candidates are decided from left to right in
    the order of kinds; IBANs and cards are found at group borders, whatever groups stand beside them; every other
    column, whatever its name, and every row is untouched, repeated rows alike; an empty table gives no rows.  A
    column with the count's name, in any case, is replaced.
    """
    plain, t = by_place(documents), F.col(place_of(documents, text))
    mark = F.concat(F.lit("﷐"), F.md5(t.cast("binary")), F.lit("﷑"))
    marked = F.when(t.rlike("[0-9@=:]|AKIA"), F.regexp_replace(t, F.lit(f"({ANY})"), F.concat(mark, F.lit("$1"), mark)))
    keep = [c for c in documents.columns if count is None or c.lower() != count.lower()]
    columns = [place_of(documents, c) for c in keep]
    pieces = plain.select(*columns, F.when(F.contains(marked, F.lit("﷐")), F.split(marked, mark)).alias("pieces"))
    cut = F.flatten(F.transform("pieces", lambda p, i: F.when(i % 2 == 1, _parts(p)).otherwise(F.array(p))))
    pieces = pieces.withColumn("pieces", cut)
    new = F.transform("pieces", lambda p, i: F.when(i % 2 == 1, pseudonym(p, key)).otherwise(p))
    done = pieces.withColumn("new", F.when(F.size("pieces") > 1, new))
    out = [F.coalesce(F.array_join("new", ""), F.col(c)).alias(c) if c == place_of(documents, text) else F.col(c) for c in columns]
    changed = F.size(F.filter(F.arrays_zip(F.col("pieces").alias("p"), F.col("new").alias("n")), lambda x: ~x["p"].eqNullSafe(x["n"])))
    if count:
        out.append(F.when(F.col("new").isNull(), F.lit(0)).otherwise(changed).cast("int").alias(count))
    return done.select(*out).toDF(*keep, *([count] if count else []))
