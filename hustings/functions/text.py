"""Text, title, name, date and nested-field functions. All take and return columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from html.entities import html5

from pyspark.sql import Column, functions as F

from . import fixed

# White space as a scripting user expects it: Unicode, with the four ASCII separators.
SPACE = r"(?U)[\s\x1c-\x1f]"
WORD_OR_MARK = r"(?U)(\w+|[^\w\s])"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), rf"^(?:{SPACE}+)|(?:{SPACE}+)$", "")


def squeeze(c: Column | str) -> Column:
    """Every run of white space becomes one blank."""
    return F.regexp_replace(_col(c), f"{SPACE}+", " ")


def words(c: Column | str) -> Column:
    return F.filter(F.split(_col(c), f"{SPACE}+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def clean_speech(c: Column | str, fixed_order: bool = False) -> Column:
    """Rewrite forms of address and cut the opening courtesies.

    The forms are rewritten in their listed order, in which a short form spoils a longer
    one that starts with it; ``fixed_order`` takes the longest forms first instead.
    """
    forms = fixed.ADDRESS_FORMS
    if fixed_order:
        forms = tuple(sorted(forms, key=len, reverse=True))
    text = squeeze(c)
    for form in forms:
        text = F.replace(text, F.lit(form), F.lit(fixed.ADDRESS))
    for opening in (r"^Mr\. Speaker, ", r"^I yield.*?\. *", r"^Mr\. Speaker, "):
        text = F.regexp_replace(text, opening, "")
    return text


def standardize_title(c: Column | str) -> Column:
    """Bill title in the form in which titles are compared; NULL when nothing is left.

    Things tried once each, one after the other, at the start or the end of a title are one
    pattern of optional parts in that order. A rejected title comes out empty.
    """
    either = "|".join(re.escape(p) for p in fixed.COMMA_PREFIXES)
    starts = "".join(f"(?:{re.escape(p)})?" for p in fixed.PLAIN_PREFIXES)
    ends = "".join(f"(?:{re.escape(e)})?" for e in reversed(fixed.TITLE_ENDINGS))
    title = F.trim(squeeze(F.lower(_col(c))))
    for pattern, put in (
        (f"^(?:{either}).*?, ", ""),
        (f"^(?:{re.escape(fixed.TITLE_REJECT)}.*|{starts})", ""),
        (r" *--.*$", ""),
        (f"{ends}[.,;]?$", ""),
        (r", \d{4}$", ""),
        (r"act of(?: \d{4})?$", "act"),
        (r"[^A-Za-z0-9\s]+", ""),
    ):
        title = F.regexp_replace(title, pattern, put)
    return F.nullif(title, F.lit(""))


def normalize_text(c: Column | str, urls: bool = False, digits: bool = False) -> Column:
    """Lower-case text of word characters only, as topic models take it."""
    text = F.lower(F.coalesce(_col(c), F.lit("")))
    if urls:
        text = F.regexp_replace(text, r"(?U)http[^\s\x1c-\x1f]+", "")
    text = F.regexp_replace(text, r"(?U)[^\w\s\x1c-\x1f]", " ")
    if digits:
        text = F.regexp_replace(text, r"(?U)\d+", " ")
    return F.trim(squeeze(text))


def plain_words(c: Column | str, urls: bool = False, digits: bool = False) -> Column:
    """Words of the normalised text, which has single blanks between them."""
    return F.filter(F.split(normalize_text(c, urls, digits), " "), lambda w: w != "")


def remove_stopwords(c: Column | str, stopwords: Sequence[str]) -> Column:
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.array_join(F.filter(words(c), lambda w: ~F.array_contains(stop, w)), " ")


def strip_html(c: Column | str) -> Column:
    """Text of a piece of markup, a blank between text nodes, trimmed; NULL becomes ''."""
    text = F.coalesce(_col(c), F.lit(""))
    text = F.regexp_replace(text, r"(?is)<!--.*?-->", "<!>")
    text = F.regexp_replace(text, r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>", "<!>")
    text = F.regexp_replace(text, r"(?:<[!/?a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>)+", " ")
    return strip(decode_references(text))


_REFERENCE = "&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"


def decode_references(c: Column | str) -> Column:
    """Text with its character references decoded once: decimal, hexadecimal and all named ones.

    A number that is no character becomes U+FFFD; an unknown name stays as it is.
    """
    text = _col(c)
    names = F.create_map(*[F.lit(x) for n, v in html5.items() if n.endswith(";") for x in ("&" + n, v)])

    def character(ref: Column) -> Column:
        digits = F.regexp_extract(ref, "^&#[xX]?([0-9a-fA-F]+);", 1)
        # Longer numbers than these are out of range whatever their digits are.
        code = F.when(F.length(F.ltrim(digits, F.lit("0"))) > 8, F.lit(-1).cast("long")).otherwise(
            F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long")
        )
        good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        shown = F.decode(F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.when(ref.startswith("&#"), shown).otherwise(F.coalesce(F.try_element_at(names, ref), ref))

    refs = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    around = F.split(text, _REFERENCE, -1)
    joined = F.zip_with(around, refs, lambda t, r: F.concat(t, F.coalesce(character(r), F.lit(""))))
    return F.when(F.size(refs) == 0, text).otherwise(F.array_join(joined, ""))


def combine_text(*cols: Column | str) -> Column:
    """Fields joined by a blank, NULL counted as ''."""
    return F.concat_ws(" ", *[F.coalesce(_col(c), F.lit("")) for c in cols])


def roster_lastname(c: Column | str, upper: bool = True) -> Column:
    name = F.trim(F.substring_index(_col(c), ",", 1)) if not upper else F.upper(
        F.substring_index(_col(c), ",", 1)
    )
    return name


def parse_speaker(c: Column | str) -> Column:
    """``Mr. NAME of State`` as a struct of last name and state."""
    dotted = F.split(_col(c), r"\.", 2)
    name = F.trim(F.coalesce(F.get(dotted, F.lit(1)), F.get(dotted, F.lit(0))))
    parts = F.split(name, " of ")
    return F.struct(
        F.trim(F.get(parts, F.lit(0))).alias("lastname"),
        F.trim(F.get(parts, F.lit(1))).alias("state"),
    )


def remove_salutation(c: Column | str) -> Column:
    parts = words(c)
    rest = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), " ")
    return F.when(F.size(parts) > 1, rest).otherwise(_col(c))


def title_case(c: Column | str) -> Column:
    """First letter of each run of letters upper, the others lower, hyphens and marks ending a run."""
    mark = "\u0001 "
    apart = F.regexp_replace(_col(c), r"([^\p{L}\s])(?=\p{L})", f"$1{mark}")
    return F.replace(F.initcap(apart), F.lit(mark), F.lit(""))


def display_name(c: Column | str) -> Column:
    """Full name for a report: a blank after each comma, title case."""
    return title_case(F.replace(_col(c), F.lit(","), F.lit(", ")))


def after_salutation(c: Column | str) -> Column:
    dotted = F.split(_col(c), r"\.", 2)
    return F.trim(F.coalesce(F.get(dotted, F.lit(1)), F.get(dotted, F.lit(0))))


def sentences(c: Column | str) -> Column:
    """Sentences: cut after ``.``, ``!`` or ``?`` followed by white space."""
    parts = F.split(strip(c), rf"(?<=[.!?]){SPACE}+")
    return F.filter(parts, lambda s: s != "")


def token_count(c: Column | str, special: int = 0) -> Column:
    """Number of words and marks, plus the special tokens a model adds."""
    found = F.regexp_count(F.coalesce(_col(c), F.lit("")), F.lit(WORD_OR_MARK))
    return (found + F.lit(special)).cast("int")


def combined_length(
    document: Column | str,
    target: Column | str,
    summary: Column | str,
    counter: Callable[[Column], Column] = token_count,
) -> Column:
    """Tokens of ``text: {document} target: {target}`` with its summary and 3 special tokens."""
    parts = [_col(document), F.lit("text: "), F.lit(" target: "), _col(target), _col(summary)]
    return reduce(lambda a, b: a + b, [counter(p) for p in parts]) + F.lit(3)


def parse_date(c: Column | str, floor: str | None = None) -> Column:
    """ISO date or timestamp text to a date; bad text and NULL become ``floor``."""
    day = F.try_to_date(F.left(_col(c), F.lit(10)), "yyyy-MM-dd")
    return F.coalesce(day, F.lit(floor).cast("date")) if floor else day


NAMED = "array<struct<name:string>>"


def names_from_json(c: Column | str) -> Column:
    """Names out of a JSON list of records; text that does not parse gives no names."""
    parsed = F.from_json(_col(c), NAMED)
    names = F.filter(F.transform(parsed, lambda x: x["name"]), lambda n: n.isNotNull())
    return F.coalesce(names, F.array().cast("array<string>"))


def latest_activity(activities: Column) -> Column:
    """Latest date of an array of records with a ``date``; NULL where none has one."""
    return F.array_max(F.transform(activities, lambda a: parse_date(a["date"])))


def committee_activity(committees: Column | str) -> Column:
    """Each committee with its latest date, and only those subcommittees that have one."""
    def sub(s: Column) -> Column:
        return F.struct(s["name"].alias("name"), latest_activity(s["activities"]).alias("latest_activity"))

    return F.transform(
        _col(committees),
        lambda c: F.struct(
            c["name"].alias("name"),
            latest_activity(c["activities"]).alias("latest_activity"),
            F.filter(
                F.transform(c["subcommittees"], sub), lambda s: s["latest_activity"].isNotNull()
            ).alias("subcommittees"),
        ),
    )


def trim_chars(c: Column | str, chars: str = ".") -> Column:
    return F.btrim(_col(c), F.lit(chars))


def to_number(c: Column | str, kind: str = "double") -> Column:
    return _col(c).try_cast(kind)


def label_key(*cols: Column | str) -> Column:
    """Composite label; NULL as soon as one part is missing or empty."""
    filled = reduce(lambda a, b: a & b, [F.coalesce(_col(c) != "", F.lit(False)) for c in cols])
    return F.when(filled, F.concat_ws("_", *[_col(c) for c in cols]))


def compose_input(document: Column | str, *targets: Column | str) -> Column:
    """What a scorer reads: the document, then its target or targets."""
    text = F.concat(F.lit("text: "), F.coalesce(_col(document), F.lit("")))
    named = [F.coalesce(_col(t), F.lit("")) for t in targets]
    if len(named) == 1:
        return F.concat(text, F.lit(" target: "), named[0])
    return F.concat(text, F.lit(" targets: "), F.concat_ws(", ", *named))


def map_codes(c: Column | str, mapping: Mapping, default: str | None = None) -> Column:
    source = _col(c)
    out = None
    for key, value in mapping.items():
        out = F.when(source == F.lit(key), value) if out is None else out.when(source == F.lit(key), value)
    return out.otherwise(F.lit(default))
