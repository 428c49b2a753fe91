"""Ordered dictionary rules as Column expressions.

A rule set is a list of (needle, label) in order of precedence; a text gets the label of the
first needle that hits. The list is folded into the plan, so classifying needs no join and
stays inside the scan's stage. Other engines' SQL can be generated from the same lists.
"""

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecast.functions import dictionaries as d
from rolecast.functions.text import clean_string


def country_rules() -> list[tuple[str, str]]:
    """Needles for countries, the longest first, in table order where equally long."""
    rules = [(name.lower(), code) for code, name in d.COUNTRIES.items()]
    rules += [(alias, code) for code, names in d.COUNTRY_ALIASES.items() for alias in names]
    rules += [(city, code) for code, names in d.CITIES.items() for city in names]
    rules += [(state, "us") for state in d.US_STATES]
    return sorted(rules, key=lambda r: -len(r[0]))


def city_label(needle: str) -> str:
    """What a city is shown as: a letter after anything but an ASCII word character is in upper case."""
    name = needle.split(",")[0]
    word = re.compile(r"[0-9A-Za-z_]")
    return "".join(
        c.upper() if c.isalpha() and bool(word.match(c)) != bool(i and word.match(name[i - 1])) else c for i, c in enumerate(name)
    )


def city_rules() -> list[tuple[str, str]]:
    seen: dict[str, str] = {}
    for names in d.CITIES.values():
        for city in names:
            seen.setdefault(city, city_label(city))
    return sorted(seen.items(), key=lambda r: -len(r[0]))


def city_countries() -> dict[str, str]:
    """Each city label's country, the first that names it."""
    found: dict[str, str] = {}
    for code, names in d.CITIES.items():
        for city in names:
            found.setdefault(city_label(city), code)
    return dict(sorted(found.items()))


def role_rules() -> list[tuple[str, str]]:
    return [(needle, name) for name, needles in d.ROLE_FAMILIES for needle in needles]


def hint_rules() -> list[tuple[str, str]]:
    return [(needle, name) for name, needles in d.INDUSTRY_HINTS for needle in needles]


def _bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with the value computed once however often make repeats it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _first_hit(text: Column, rules: list[tuple[str, str]], edge: str | None) -> Column:
    """The label of the first needle in text. edge: characters that may not touch the needle's first occurrence.

    A chain of literal searches that ends at the first hit.
    """

    def chain(t: Column) -> Column:
        out = F
        for needle, label in rules:
            hit = F.contains(t, F.lit(needle))
            if edge is not None:  # what comes before the first occurrence holds no other
                hit = hit & t.rlike(rf"(?s)^(?:(?!\Q{needle}\E).)*+(?<!{edge})\Q{needle}\E(?!{edge})")
            out = out.when(hit, F.lit(label))
        return out

    return F.when(text.isNotNull(), _bound(text, chain))


def _place(location: Column) -> Column:
    return F.lower(clean_string(location))


def is_anywhere(location: Column) -> Column:
    return F.coalesce(_place(location).rlike(d.ANYWHERE), F.lit(False))


def location_country(location: Column) -> Column:
    """ISO code of the country that a free-text location names; null if it names none."""
    text = _place(location)
    codes = F.regexp_extract_all(text, F.lit(r"(?:^|[,\s])([a-z]{2})(?:[,\s]|$)"), 1)
    by_state = F.when(F.arrays_overlap(codes, F.array(*[F.lit(c) for c in d.US_STATE_CODES])), F.lit("us"))
    return F.when(~is_anywhere(location), F.coalesce(_first_hit(text, country_rules(), "[a-z]"), by_state))


def location_city(location: Column) -> Column:
    return F.when(~is_anywhere(location), _first_hit(_place(location), city_rules(), "[a-z]"))


def _padded(value: Column, kept: str) -> Column:
    squeezed = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), f"[^{kept}]+", " "), r"\s+", " ")
    return F.concat(F.lit(" "), squeezed, F.lit(" "))


def role_family(title: Column) -> Column:
    """The first role family one of whose needles is part of the title."""
    text = _padded(title, "a-z0-9&.+ ")
    return F.when(F.trim(text) != "", _first_hit(text, role_rules(), None))


def industry(company: Column, role: Column, native: Column | None = None) -> Column:
    """From a provider's own industry, else the company's name, else the role family."""
    text = _padded(company, "a-z0-9. ")
    by_name = F.when(F.trim(text) != "", _first_hit(text, hint_rules(), "[a-z0-9]"))
    by_role = F.create_map(*[F.lit(x) for pair in d.INDUSTRY_OF_ROLE.items() for x in pair])[role]
    if native is None:
        return F.coalesce(by_name, by_role)
    key = F.regexp_replace(F.regexp_replace(F.lower(native.cast("string")), r"[^a-z]+", "_"), r"^_|_$", "")
    known = F.create_map(*[F.lit(x) for pair in d.INDUSTRY_KEYS.items() for x in pair])
    return F.coalesce(known[key], by_name, by_role)


def category(title: Column, department: Column) -> Column:
    value = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(department, F.lit(""))))

    def chain(v: Column) -> Column:
        out = F.lit("Other")
        for name, words in reversed(d.CATEGORIES):
            out = F.when(v.rlike(rf"\b({'|'.join(words)})\b"), F.lit(name)).otherwise(out)
        return out

    return _bound(value, chain)


def workplace(value: Column) -> Column:
    """Hybrid, Remote, On-site or Unspecified."""

    def chain(text: Column) -> Column:
        on_site = text.contains("on-site") | text.contains("onsite") | text.contains("office")
        return F.when(text.contains("hybrid"), "Hybrid").when(text.contains("remote"), "Remote").when(on_site, "On-site").otherwise("Unspecified")

    return _bound(F.lower(F.replace(clean_string(value), F.lit("_"), F.lit("-"))), chain)


def board_status(job_count: Column, http_status: Column, invalid_payload: Column, failed: Column) -> Column:
    """What a sync makes of a board: permanent failures are invalid, others errors."""
    permanent = invalid_payload | (http_status.between(400, 499) & ~http_status.isin(408, 429))
    return F.when(failed & F.coalesce(permanent, F.lit(False)), "invalid").when(failed, "error").when(job_count > 0, "active").otherwise("empty")


def validation_status(job_count: Column, http_status: Column, invalid_payload: Column, failed: Column) -> Column:
    """What a validation makes of a board: only a missing board or a wrong payload is invalid."""
    gone = invalid_payload | http_status.isin(404, 410)
    return F.when(failed & F.coalesce(gone, F.lit(False)), "invalid").when(failed, "error").when(job_count > 0, "active").otherwise("empty")


def country_flag(code: Column) -> Column:
    """Regional indicator symbols of a two-letter code."""
    letters = {chr(97 + i): chr(0x1F1E6 + i) for i in range(26)}
    lower = F.lower(code)
    return F.when(F.length(lower) == 2, F.translate(lower, "".join(letters), "".join(letters.values())))


def country_name(code: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in d.COUNTRIES.items() for x in pair])[code]
