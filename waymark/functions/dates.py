"""Dates out of prose: an ordered list of rules in two languages, as regular expressions of Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_typography

# Month names, and the connecting words of either language.
MONTHS_FR = ("janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre")
MONTHS_IT = ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre")
FRENCH = {"frm": "du", "to": "au", "until": r"jusqu'?\s*au", "since": r"a\s+partir\s+du", "on": "le"}
ITALIAN = {"frm": "dal", "to": "al", "until": r"(?:fino\s+al|entro\s+il)", "since": r"(?:a\s+partire\s+dal|dal)", "on": "il"}

WINDOW = "struct<start:date,end:date,rule:string>"
_D, _Y, _NUM = r"(\d{1,2})(?:\s*er)?", r"(\d{4})", r"(\d{1,2})/(\d{1,2})/(\d{2,4})"

#: Shape of each rule: pattern over named words, group numbers (day, month, year) of the start and of the end.
RULES = (
    ("full_range", "{frm} D M Y {to} D M Y", (1, 2, 3), (4, 5, 6)),
    ("split_month", "{frm} D M {to} D M Y", (1, 2, 5), (3, 4, 5)),
    ("same_month", "{frm} D {to} D M Y", (1, 3, 4), (2, 3, 4)),
    ("numeric_range", "{frm} N {to} N", (1, 2, 3), (4, 5, 6)),
    ("from_until", "{frm} D M YG{until} D M Y", (1, 2, 3), (4, 5, 6)),
    ("from_until_split", "{frm} D MBG{until} D M Y", (1, 2, 5), (3, 4, 5)),
    ("until", "{until} D M Y", None, (1, 2, 3)),
    ("until_numeric", "{until} N", None, (1, 2, 3)),
    ("from_numeric", "(?:{since}|{frm}) N", (1, 2, 3), None),
    ("from", "{since} D M Y", (1, 2, 3), None),
    ("single_named", "(?:{on}|{frm}) D M Y", (1, 2, 3), (1, 2, 3)),
    ("single_numeric", "{on} N", (1, 2, 3), (1, 2, 3)),
)
BARE_SINGLE = ("single_named", "BD M Y", (1, 2, 3), (1, 2, 3))


def _pattern(shape: str, words: dict[str, str], months: tuple[str, ...]) -> str:
    signs = {"D": _D, "M": f"({'|'.join(months)})", "Y": _Y, "N": _NUM, "G": "[^0-9]{0,24}?", "B": r"\b", " ": r"\s+"}
    out, at = "", 0
    while at < len(shape):
        if shape[at] == "{":
            end = shape.index("}", at)
            out += words[shape[at + 1 : end]]
            at = end + 1
        else:
            out += signs.get(shape[at], shape[at])
            at += 1
    return out


def _month(text: Column) -> Column:
    numbers = {m: k % 12 + 1 for k, m in enumerate((*MONTHS_FR, *MONTHS_IT))}
    known = F.create_map(*(F.lit(x) for pair in numbers.items() for x in pair))
    return F.coalesce(known[text].cast("string"), text)


def _year(text: Column) -> Column:
    return F.when(F.length(text) == 2, F.concat(F.lit("20"), text)).otherwise(text)


def _date(flat: Column, pattern: str, groups: tuple[int, int, int]) -> Column:
    d, m, y = (F.regexp_extract(flat, pattern, k) for k in groups)
    return F.try_to_date(F.concat_ws("-", _year(y), F.lpad(_month(m), 2, "0"), F.lpad(d, 2, "0")))


def date_rules(flat: Column, french: Column, italian: Column, numeric: Column) -> list[Column]:
    """One nullable window for each rule, most specific first, over text from fold_typography.

    The first match of a rule counts. A rule that names an impossible date gives null, so that a later one may apply. Rules
    are tried only where the text holds a day before a month's name of their language, or days with slashes.
    """
    out = []
    for words, months, mark, named in ((FRENCH, MONTHS_FR, "", french), (ITALIAN, MONTHS_IT, ":it", italian)):
        for name, shape, start, end in RULES + ((BARE_SINGLE,) if mark else ()):
            pattern = _pattern(shape, words, months)
            a = _date(flat, pattern, start) if start else F.lit(None).cast("date")
            b = _date(flat, pattern, end) if end else F.lit(None).cast("date")
            if name == "from_until_split":  # a season over New Year starts in the year before
                a = F.when(a > b, F.add_months(a, -12)).otherwise(a)
            fits = (numeric if "N" in shape else named) & flat.rlike(pattern) & (a.isNotNull() if start else F.lit(True)) & (b.isNotNull() if end else F.lit(True))
            out.append(F.when(fits, F.struct(a.alias("start"), b.alias("end"), F.lit(name + mark).alias("rule"))))
    return out


def extract_date_window(text: Column) -> Column:
    """(start, end, rule) by the first rule that gives a real window; null without one. Both ends count."""
    # bound once: as one flat expression the rules would outgrow a generated method
    return F.get(F.transform(F.array(fold_typography(text)), _first_window), F.lit(0))


def _first_window(flat: Column) -> Column:
    def holds(months: tuple[str, ...]) -> Column:
        return flat.rlike(rf"\d(?:\s*er)?\s+(?:{'|'.join(months)})")

    seen = F.struct(holds(MONTHS_FR).alias("french"), holds(MONTHS_IT).alias("italian"), flat.rlike(r"\d/\d{1,2}/\d{2}").alias("numeric"))
    return F.get(F.transform(F.array(seen), lambda x: F.when(x["french"] | x["italian"] | x["numeric"], F.coalesce(*date_rules(flat, x["french"], x["italian"], x["numeric"])))), F.lit(0))


def assume_year(text: Column, year: Column) -> Column:
    """The window of a text that leaves its year out: the year is appended; an end before its start moves a year on."""
    window = extract_date_window(F.concat_ws(" ", text, year.cast("string")))
    moved = F.when(window["end"] < window["start"], F.add_months(window["end"], 12)).otherwise(window["end"])
    return F.when(window.isNotNull(), F.struct(window["start"].alias("start"), moved.alias("end"), F.concat(window["rule"], F.lit("+assumed_year")).alias("rule")))


# The thirds of a month.
COARSE = {"debut": (1, 10), "mi": (11, 20), "fin": (21, 31)}


def extract_coarse_window(text: Column, year: Column, may_cross: bool = False) -> Column:
    """(start, end, rule) of a season in words, such as `mi juin a fin septembre`; two ends are needed.

    The start is the last day its words allow and the end the first, clipped to the month.
    """
    flat = fold_typography(text)
    pattern = rf"\b(debut|mi|fin)[\s-]+({'|'.join(MONTHS_FR)})\b"
    parts, months = (F.regexp_extract_all(flat, F.lit(pattern), F.lit(k)) for k in (1, 2))

    def end_of(k: int, late: bool) -> Column:
        day = F.get(parts, F.lit(k))
        number = F.when(day == "debut", COARSE["debut"][late]).when(day == "mi", COARSE["mi"][late]).otherwise(COARSE["fin"][late])
        first = F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(_month(F.get(months, F.lit(k))), 2, "0"), F.lit("01")))
        return F.least(F.date_add(first, number - 1), F.last_day(first))

    start, end = end_of(0, True), end_of(1, False)
    if may_cross:
        end = F.when(end < start, F.add_months(end, 12)).otherwise(end)
    return F.when((F.size(parts) == 2) & (start <= end), F.struct(start.alias("start"), end.alias("end"), F.lit("coarse").alias("rule")))


def cross_check_window(window: Column, claimed_start: Column, claimed_end: Column) -> Column:
    """(start, end, complaint): claimed days must be those in the text, else they are dropped with a complaint."""
    agree = window["start"].eqNullSafe(F.try_to_date(claimed_start)) & window["end"].eqNullSafe(F.try_to_date(claimed_end))
    return F.struct(
        F.when(agree, window["start"]).alias("start"), F.when(agree, window["end"]).alias("end"), F.when(~agree, "dates differ from the text").alias("complaint")
    )


def published_day(at: Column) -> Column:
    return F.to_date(at)
