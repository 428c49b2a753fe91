"""Scalar text, date and JSON semantics as Column -> Column functions."""

import json
import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of the web platform: Unicode space separators, line ends and the byte order mark.
SPACE = r"[\s\p{Z}\x{FEFF}]"


def lit_or_col(value: Column | str | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def clean_string(value: Column) -> Column:
    """Trimmed text, null instead of empty. Spark's UTF-8 strings cannot hold a lone surrogate."""
    text = F.regexp_replace(value.cast("string"), rf"^{SPACE}+|{SPACE}+$", "")
    return F.nullif(text, F.lit(""))


def first_text(*values: Column) -> Column:
    """The first value that is neither null nor empty (the `||` of loosely typed payloads)."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values])


def utf16_length(value: Column) -> Column:
    """UTF-16 units: code points beyond the basic plane count twice."""
    return (F.octet_length(F.encode(value, "UTF-16BE")) / 2).cast("int")


def truncate(value: Column, limit: int) -> Column:
    """At most limit UTF-16 units, the last of them an ellipsis when something was cut; pairs stay whole."""
    units = F.encode(value, "UTF-16BE")
    split_pair = F.hex(F.substring(units, 2 * (limit - 1) - 1, 2)).between("D800", "DBFF")
    whole = F.when(split_pair, F.substring(units, 1, 2 * (limit - 2))).otherwise(F.substring(units, 1, 2 * (limit - 1)))
    cut = F.when(F.length(value) == utf16_length(value), F.substring(value, 1, limit - 1)).otherwise(F.decode(whole, "UTF-16BE"))
    return F.when(utf16_length(value) <= limit, value).otherwise(F.concat(cut, F.lit("…")))


def url_decode(segment: Column) -> Column:
    """Percent-decoding that leaves plus signs, and malformed segments, as they are."""
    return F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment)


def url_encode_component(value: Column) -> Column:
    """Percent-encoding that keeps letters, digits and -_.!~*'()."""
    out = F.url_encode(value)
    for shown, kept in (("+", "%20"), ("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(shown), F.lit(kept))
    return out


def with_scheme(url: Column) -> Column:
    return F.when(url.rlike(r"(?i)^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def url_host(url: Column) -> Column:
    """Lower-case host; null if there is none or the text is no URL. User and port are not part of it."""
    # as browsers do, backslashes count as slashes
    after = F.regexp_extract(with_scheme(url), r"(?i)^https?:[/\\]*([^/?#\\]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(after, r"^.*@", ""), r":\d*$", ""))
    ok = (host != "") & ~host.rlike(r"[\s<>^|%\[\]{}\"`]")
    return F.when(ok, host)


def url_path(url: Column) -> Column:
    return F.replace(F.regexp_extract(with_scheme(url), r"(?i)^https?:[/\\]*[^/?#\\]*([^?#]*)", 1), F.lit("\\"), F.lit("/"))


def raw_segments(url: Column) -> Column:
    """The non-empty path segments, with . and .. resolved."""
    parts = F.filter(F.split(url_path(url), "/"), lambda s: s != "")
    return F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda a, s: F.when(F.lower(s).isin(".", "%2e"), a)
        .when(F.lower(s).isin("..", ".%2e", "%2e.", "%2e%2e"), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))))
        .otherwise(F.concat(a, F.array(s))),
    )


def path_segments(url: Column) -> Column:
    """The path segments, each percent-decoded where it can be."""
    return F.transform(raw_segments(url), url_decode)


def last_path_segment(url: Column) -> Column:
    """The last path segment as it stands; null without one or for no URL."""
    return F.when(url_host(url).isNotNull(), F.try_element_at(raw_segments(url), F.lit(-1)))


ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
#: Date forms that payloads carry, tried in order; those without a zone are taken as UTC.
DATE_FORMS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSSSS][.SSSSSSS][.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSSSS][.SSSSSSS][.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]XX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy-MM-dd'T'HH:mmXXX",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd HH:mm:ss[.SSS]",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy HH:mm:ss 'GMT'",
)


def iso(ts: Column) -> Column:
    return F.date_format(ts, ISO)


def from_millis(value: Column) -> Column:
    """Milliseconds since 1970 as an ISO text; null for no number."""
    return iso(F.timestamp_millis(value.try_cast("bigint")))


def from_seconds(value: Column) -> Column:
    """Seconds since 1970 as an ISO text; null for no number."""
    return iso(F.timestamp_millis((value.try_cast("double") * 1000).cast("bigint")))


def parse_date(value: Column) -> Column:
    plain = F.regexp_replace(value, "^[A-Z][a-z]{2}, ", "")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in DATE_FORMS])


def iso_timestamp(value: Column) -> Column:
    """The ISO form of a date text or a /Date(ms)/ text; null if it is neither."""
    text = value.cast("string")
    millis = F.nullif(F.regexp_extract(text, r"^/Date\((\d+)", 1), F.lit(""))
    return F.coalesce(from_millis(millis), iso(parse_date(text)))


def relative_date(value: Column, base: Column) -> Column:
    """`Posted 3 Days Ago` and the like, counted back from the ISO text base; other texts are dates."""
    text, start = F.lower(clean_string(value)), parse_date(base)
    count = F.regexp_extract(text, r"(\d+)\+?\s+(day|week|month)", 1).try_cast("int")
    unit = F.regexp_extract(text, r"(\d+)\+?\s+(day|week|month)", 2)
    days = count * F.when(unit == "week", 7).when(unit == "month", 30).otherwise(1)
    back = iso(start - F.make_dt_interval(days))
    return F.when(text.isNull() | start.isNull(), F.lit(None).cast("string")).when(text.contains("today"), iso(start)).otherwise(F.coalesce(back, iso_timestamp(value)))


def _replace_all(value: Column, rules: Sequence[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        value = F.regexp_replace(value, pattern, to)
    return value


def strip_html(value: Column) -> Column:
    """Text of an HTML fragment; &amp; is decoded before &lt; and &gt;, so doubly encoded tags come out as text."""
    plain = _replace_all(
        clean_string(value),
        (
            (r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>", "\n"), (r"<[^>]*>", " "), (r"(?i)&nbsp;", " "), (r"(?i)&amp;", "&"),
            (r"(?i)&lt;", "<"), (r"(?i)&gt;", ">"), (rf"{SPACE}+\n", "\n"), (r"[ \t]+", " "), (rf"^{SPACE}+|{SPACE}+$", ""),
        ),
    )
    return plain


def decode_html(value: Column) -> Column:
    return _replace_all(value.cast("string"), ((r"(?i)&amp;", "&"), (r"(?i)&quot;", '"'), (r"(?i)&#39;|&apos;", "'"), (r"(?i)&lt;", "<"), (r"(?i)&gt;", ">")))


def decode_xml(value: Column) -> Column:
    """Entities decoded after CDATA marks are taken off; null for empty text."""
    return decode_html(F.regexp_replace(F.nullif(value, F.lit("")), r"<!\[CDATA\[([\s\S]*?)\]\]>", "$1"))


def capitalise_words(value: Column) -> Column:
    """The first ASCII word character after a non-word character in upper case; nothing is lowered."""
    pieces = F.regexp_extract_all(value, F.lit(r"([0-9A-Za-z_]+|[^0-9A-Za-z_]+)"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def title_from_slug(value: Column) -> Column:
    return capitalise_words(F.regexp_replace(url_decode(value), r"[-_]+", " "))


def employment_type(value: Column) -> Column:
    """FullTime -> Full-Time, full_time -> full time."""
    return F.replace(F.regexp_replace(clean_string(value), r"([a-z])([A-Z])", "$1-$2"), F.lit("_"), F.lit(" "))


def humanize_identifier(identifier: Column, provider: Column) -> Column:
    """A readable company name from a board identifier."""
    value = first_text(identifier, F.lit("Unknown company"))
    value = F.when(provider == "workday", F.split(value, r"\|")[0]).otherwise(value)
    value = F.when(provider == "icims", F.regexp_replace(value, r"(?i)^(?:careers|jobs)[.-]", "")).otherwise(value)
    hidden = (provider == "paylocity") & value.rlike(r"(?i)^[a-f0-9-]{8,}$")
    words = capitalise_words(F.regexp_replace(F.regexp_replace(value, r"^www\.", ""), r"[._-]+", " "))
    return F.when(hidden, F.concat(F.lit("Paylocity employer "), F.upper(F.substring(value, 1, 6)))).otherwise(words)


#: Letters that have an upper case in Spark's Unicode 16 and none in DuckDB's 15.
LATER = "\u019b\u0264\u1c8a\ua7cd\ua7db" + "".join(map(chr, range(0x10D70, 0x10D86)))


def upper_letters(value: Column) -> Column:
    """Upper case as DuckDB has it: a letter stays one letter, so that ß becomes ẞ and not SS."""
    # what would become several letters and has one of its own; the rest of those stay as they are
    own = {"ß": "ẞ"} | {c: c.title() for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1 and len(c.title()) == 1 and c.title() != c}
    letter = lambda c: F.when((F.length(F.upper(c)) == F.length(c)) & ~F.lit(LATER).contains(c), F.upper(c)).otherwise(F.translate(c, "".join(own), "".join(own.values())))
    return F.array_join(F.transform(F.split(value, ""), letter), "")


#: What ``\s`` is in DuckDB.
SQL_SPACE = r"[\t\n\f\r ]"


def initials(value: Column, space: str = SPACE, upper: Callable[[Column], Column] = F.upper) -> Column:
    """The first characters of the first two words, in upper case."""
    parts = F.slice(F.filter(F.split(value, f"{space}+"), lambda p: p != ""), 1, 2)
    return upper(F.array_join(F.transform(parts, lambda p: F.substring(p, 1, 1)), ""))


def hash32(value: Column) -> Column:
    """h = h * 31 + code point, modulo 2^32."""
    return F.aggregate(F.filter(F.split(value, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(4294967295)))


# Display labels of the providers.
PROVIDER_LABELS = {
    "ashby": "Ashby", "bamboohr": "BambooHR", "gem": "Gem", "getro": "Getro", "greenhouse": "Greenhouse", "icims": "iCIMS", "lever": "Lever",
    "paylocity": "Paylocity", "rippling": "Rippling", "smartrecruiters": "SmartRecruiters", "sparkhire": "Spark Hire", "workday": "Workday",
}


def provider_label(provider: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in PROVIDER_LABELS.items() for x in pair])
    return F.coalesce(known[F.lower(provider)], F.concat(F.upper(F.substring(provider, 1, 1)), F.substring(provider, F.lit(2), F.length(provider))))


def fts_tokens(query: Column) -> Column:
    """At most eight search tokens of a query."""
    return F.slice(F.regexp_extract_all(F.lower(F.trim(query)), F.lit(r"([\p{L}\p{N}][\p{L}\p{N}._+#-]*)"), 1), 1, 8)


def _unaccented() -> tuple[str, str]:
    """Letters of one code point that are a letter and marks, by Unicode's own decomposition, and the bare letters."""
    pairs = []
    for code in range(0x80, 0x3100):
        bare = [c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c)]
        if len(bare) == 1 and bare[0] != chr(code):
            pairs.append((chr(code), bare[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _unaccented()


def fold(value: Column) -> Column:
    """Lower case without diacritics, whether they are part of a letter or stand after it."""
    return F.translate(F.regexp_replace(F.lower(value), r"\p{M}+", ""), ACCENTED, PLAIN)


def unaccented(value: str) -> str:
    """The same for a text at hand."""
    return "".join(c for c in value.lower() if not unicodedata.category(c).startswith("M")).translate(str.maketrans(ACCENTED, PLAIN))


def index_tokens(value: Column) -> Column:
    """The words of a text as a full-text index keeps them."""
    return F.regexp_extract_all(fold(value), F.lit(r"([\p{L}\p{N}]+)"), 1)


def index_text(value: Column) -> Column:
    """The same words, each after a space: the form that searches look in, and that a table may store."""
    return F.concat(F.lit(" "), F.regexp_replace(fold(value), r"[^\p{L}\p{N}]+", " "))


def stable_fallback_id(*values: Column) -> Column:
    """Percent-encoded `title|location|url` of the parts that there are, else `unknown`."""
    joined = F.concat_ws("|", *[F.nullif(v.cast("string"), F.lit("")) for v in values])
    return url_encode_component(F.when(joined == "", F.lit("unknown")).otherwise(joined))


def positive_modulo(value: Column, divisor: Column) -> Column:
    return F.pmod(F.coalesce(value.try_cast("double").cast("bigint"), F.lit(0).cast("bigint")), divisor.cast("bigint"))


def join_distinct(*values: Column, by: str = ", ") -> Column:
    """The non-empty values, each once, in order."""
    return F.array_join(F.array_distinct(F.filter(F.array(*[v.cast("string") for v in values]), lambda v: v.isNotNull() & (v != ""))), by)


def join_present(values: Column, by: str = " · ") -> Column:
    return F.array_join(F.filter(values, lambda v: v.isNotNull() & (v != "")), by)


def next_sync(status: Column, failures: Column, now: Column) -> Column:
    """When a board of this status is due again: active 12 h, empty 96 h, invalid 30 d, else 15 minutes doubled by each failure, a day at most."""
    late = F.least(F.lit(1440.0), F.lit(15.0) * F.pow(F.lit(2.0), F.greatest(failures, F.lit(0))))
    minutes = F.when(status == "active", F.lit(12 * 60.0)).when(status == "empty", F.lit(96 * 60.0)).when(status == "invalid", F.lit(720 * 60.0)).otherwise(late)
    return iso(parse_date(now) + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int")))


def retry_delay(attempt: Column) -> Column:
    """Seconds: 30 doubled by each attempt after the first, 12 hours at most."""
    return F.least(F.lit(43200.0), F.lit(30.0) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0)))).cast("bigint")


def json_fingerprint(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields as a JSON object in this order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"}), 256)


def fingerprint(*fields: Column) -> Column:
    """SHA-256 of the fields joined by unit separators, nulls marked: the same in any SQL engine."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in fields]), 256)


def compensation_json(text: Column) -> Column:
    """JSON text of a compensation value: null is the text `null`, a missing value is null."""
    return F.when(F.is_variant_null(F.try_parse_json(text)), F.lit("null")).otherwise(text)


def assigned_json(source: str | None, name: str) -> str | None:
    """The JSON literal assigned to a script variable, found by matching brackets outside strings."""
    import re

    found = re.search(rf"\b{re.escape(name)}\s*=\s*", source or "", re.A)
    if not found or found.end() >= len(source) or source[found.end()] not in "[{":
        return None
    try:
        _, end = json.JSONDecoder().raw_decode(source, found.end())
    except ValueError:
        return None
    return source[found.end() : end]


def script_json(html: Column, element: str) -> Column:
    """The text of the script element with this id."""
    import re

    return F.nullif(F.regexp_extract(html, rf"(?i)<script[^>]+id=[\"']{re.escape(element)}[\"'][^>]*>([\s\S]*?)</script>", 1), F.lit(""))
