"""Reading numbers out of text, and writing numbers as English words."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..fixed_values import ALLOWED_AROUND_NUMBER, NUMBER_PATTERN, SCALES_READ, TENS, UNITS

#: Groups of three digits that are spoken by arithmetic; doubles hold them exactly.
SMALL_GROUPS = 5
PLAIN_NUMBER = r"(?i)^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity)$"


def plain_number(text: Column) -> Column:
    """Text as double when it is spelled as one number, else null.

    The pattern guards the cast, which would also take spellings like ``5d``.
    """
    bare = F.regexp_replace(F.trim(text), r"(?<=\d)_(?=\d)", "")
    return let(bare, lambda t: F.when(t.rlike(PLAIN_NUMBER), t.try_cast("double")))


def parse_number(text: Column) -> Column:
    """Number from text with thousands commas, a percent sign or a currency sign."""

    def read(t):
        bare = F.regexp_replace(t, r"^([+-]?)[$€£]|,|%+$", "$1")
        return plain_number(bare) / F.when(t.endswith("%"), 100).otherwise(1)

    return let(F.trim(text), read)


def extract_number(text: Column) -> Column:
    """First number inside text, if only harmless characters surround it.

    A number consists of harmless characters itself, so the whole text is tested.
    """

    def read(t):
        digits = F.regexp_replace(F.regexp_substr(t, F.lit(NUMBER_PATTERN)), ",", "")
        return F.when(t.rlike(f"(?U)^{ALLOWED_AROUND_NUMBER}$"), plain_number(digits))

    return let(F.trim(text), read)


def to_boolean(text: Column) -> Column:
    """true/false, yes/no, t/f, y/n and 1/0 as boolean, anything else null."""
    return F.lower(F.trim(text)).try_cast("boolean")


def let(c: Column, use) -> Column:
    """``use`` applied to a value that is computed once, not once per mention."""
    return F.get(F.transform(F.array(c), use), 0)


def _words(items: list[str]) -> Column:
    return F.split(F.lit("|".join(items)), r"\|")


def _below_thousand() -> list[str]:
    """Words of 0 to 999."""
    tens = lambda n: TENS[n // 10 - 2] + (f"-{UNITS[n % 10]}" if n % 10 else "")
    below_hundred = [UNITS[n] if n < 20 else tens(n) for n in range(100)]
    hundreds = [[f"{u} hundred"] + [f"{u} hundred and {w}" for w in below_hundred[1:]] for u in UNITS[1:10]]
    return below_hundred + [w for block in hundreds for w in block]


def _scales() -> list[str]:
    """Names of 1000, 1000**2, … of the short scale, beyond the largest double."""
    ones = "|un|duo|tre|quattuor|quin|sex|septen|octo|novem".split("|")
    tens = "dec|vigint|trigint|quadragint|quinquagint|sexagint|septuagint|octogint|nonagint|cent".split("|")
    low = "m|b|tr|quadr|quint|sext|sept|oct|non".split("|")
    return ["thousand"] + [f"{stem}illion" for stem in low + [one + ten for ten in tens for one in ones][:93]]


def _speak(groups: Column) -> Column:
    """Groups of three digits, the last of the number first, as words."""
    three = lambda g: F.when(g > 0, F.get(_words(_below_thousand()), g))

    def put(words):
        upper = F.transform(F.slice(words, F.lit(2), F.size(words)), lambda w, i: F.concat(w, F.lit(" "), F.get(_words(_scales()), i)))
        first = F.when(F.get(groups, 0) < 100, " and ").otherwise(", ")
        return let(F.array_join(F.reverse(upper), ", "), lambda head: F.when(head == "", F.coalesce(F.get(words, 0), F.lit(UNITS[0]))).otherwise(
            F.concat(head, F.coalesce(F.concat(first, F.get(words, 0)), F.lit("")))))

    return let(F.transform(groups, three), put)


def whole_number_words(digits: Column) -> Column:
    """Digits of a whole number, of any length, as words: ``2021`` -> ``two thousand and twenty-one``."""

    def grouped(text):
        count = F.ceil(F.length(text) / 3).cast("int")
        padded = F.lpad(text, count * 3, F.lit("0"))
        return F.transform(F.sequence(count - 1, F.lit(0), F.lit(-1)), lambda i: F.substr(padded, i * 3 + 1, F.lit(3)).cast("int"))

    return let(let(F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0")), grouped), _speak)


def small_number_words(n: Column) -> Column:
    """A whole number from 0 to below 10**15, as double, as words: by arithmetic on its groups of three digits."""
    groups = [(F.floor(n / 1000.0**i) % 1000).cast("int") for i in range(SMALL_GROUPS)]  # exact: quotients are far below 2**53
    return let(F.array(*groups), _speak)


def number_to_words(x: Column) -> Column:
    """Number of any size as English words, as it prints; null for NaN and infinity.

    Digits after the point are spoken one by one. Whole numbers below 10**15, and
    the whole part of numbers that print without an exponent, are spoken by
    arithmetic; the digits of others are read as text.
    """
    top = float(1000**SMALL_GROUPS)

    def fraction(t):
        digits = F.rtrim(F.substring_index(t, ".", -1), F.lit("0"))
        return F.array_join(F.transform(F.split(digits, ""), lambda d: F.get(_words(UNITS), d.cast("int"))), " ")

    whole = x == F.floor(x)
    plain = whole | (x.between(-9_999_999, 9_999_999) & ~x.between(-0.001, 0.001))
    spoken = F.concat(F.when(x < 0, "minus ").otherwise(""), small_number_words(F.floor(F.abs(x)).cast("double")),
                      F.when(whole, "").otherwise(F.concat(F.lit(" point "), fraction(x.cast("string")))))
    return F.when((x > -top) & (x < top) & plain, spoken).otherwise(printed_number_words(x))


def printed_number_words(x: Column) -> Column:
    """The same for numbers of any size, from the text that a number prints as."""
    shape = r"^-?(\d+)(?:\.(\d+))?(?:E([+-]?\d+))?$"

    def speak(t):
        whole, fraction = F.regexp_extract(t, shape, 1), F.regexp_extract(t, shape, 2)
        exponent = F.coalesce(F.nullif(F.regexp_extract(t, shape, 3), F.lit("")).cast("int"), F.lit(0))
        # as many zeros on both sides as the exponent may move the point over
        padded = F.concat(F.repeat(F.lit("0"), F.greatest(-exponent, F.lit(0))), whole, fraction, F.repeat(F.lit("0"), F.greatest(exponent, F.lit(0))))
        point = F.length(whole) + F.greatest(exponent, F.lit(0)) + F.least(exponent, F.lit(0)) + F.greatest(-exponent, F.lit(0))
        before = whole_number_words(F.substr(padded, F.lit(1), point))
        decimals = F.rtrim(F.substr(padded, point + 1), F.lit("0"))
        digits = F.array_join(F.transform(F.split(decimals, ""), lambda d: F.get(_words(UNITS), d.cast("int"))), " ")
        after = F.when(decimals == "", "").otherwise(F.concat(F.lit(" point "), digits))
        minus = F.when(t.rlike("^-.*[1-9]") & ~t.rlike("^-0(\\.0*)?(E|$)"), "minus ").otherwise("")
        return F.when(t.rlike(shape), F.concat(minus, before, after))

    return let(x.cast("string"), speak)


def text_to_words(text: Column) -> Column:
    """Text that is a number as words; other text unchanged."""
    return let(F.trim(text), lambda t: F.coalesce(let(plain_number(t), number_to_words), t))


def _reading() -> Column:
    values = {w: i for i, w in enumerate(UNITS)}
    values |= {w: 10 * i for i, w in enumerate(TENS, start=2)}
    values |= {"hundred": 100}
    values |= {w: 1000**i for i, w in enumerate(SCALES_READ, start=1)}
    return F.str_to_map(F.lit(",".join(f"{w}:{v}" for w, v in values.items()))).cast("map<string,double>")


def _values(words: Column) -> Column:
    known = F.transform(words, lambda w: F.try_element_at(_reading(), w))
    return F.filter(known, lambda v: v.isNotNull())


def _read_whole(values: Column) -> Column:
    """Number the word values form; null when scales repeat or grow."""
    state = lambda total, current, scale, bad: F.struct(
        total.alias("total"), current.alias("current"), scale.alias("scale"), bad.alias("bad")
    )
    start = state(F.lit(0.0), F.lit(0.0), F.lit(1e18), F.lit(False))
    at_least_one = lambda x: F.when(x == 0, F.lit(1.0)).otherwise(x)

    def step(s, v):
        return (
            F.when(v < 100, state(s["total"], s["current"] + v, s["scale"], s["bad"]))
            .when(v == 100, state(s["total"], at_least_one(s["current"]) * 100, s["scale"], s["bad"]))
            .otherwise(
                state(s["total"] + at_least_one(s["current"]) * v, F.lit(0.0), v, s["bad"] | (v >= s["scale"]))
            )
        )

    finish = lambda s: F.when(~s["bad"], s["total"] + s["current"])
    return F.when(F.size(values) > 0, F.aggregate(values, start, step, finish))


def words_to_number(text: Column) -> Column:
    """Number spelled in English words inside text; null when there is none."""
    tokens = F.split(F.trim(F.regexp_replace(F.lower(text), "[-,]", " ")), r"\s+")

    def read(words):
        point = F.array_position(words, "point").cast("int")
        after = F.slice(words, point + 1, F.size(words))
        digits = _values(after)
        fraction = F.concat(
            F.lit("0."), F.array_join(F.transform(digits, lambda d: d.cast("int").cast("string")), "")
        ).try_cast("double")
        fine = F.forall(digits, lambda d: d < 10) & ~F.array_contains(after, "point")
        before = let(_values(F.slice(words, F.lit(1), point - 1)), _read_whole)
        return F.when(point == 0, let(_values(words), _read_whole)).otherwise(
            F.when(F.size(digits) == 0, before).when(fine, F.coalesce(before, F.lit(0.0)) + fraction)
        )

    return let(tokens, read)


def text_to_number(text: Column) -> Column:
    """Number words first, else a plain number, else null."""
    return F.coalesce(words_to_number(text), plain_number(text))
