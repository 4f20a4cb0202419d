"""Scalar text functions, column to column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Apostrophes that queries and index drop (fixed values).
APOSTROPHES = "'‘’ʼ"
#: Between tokens: line ends, Unicode spaces and punctuation; tabs and symbols don't separate.
TOKEN_BREAK = r"[\n\r\p{Z}\p{P}]+"
#: White space of a client's script (fixed values).
SCRIPT_SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: White space of any script: what ``(?U)\\s`` stands for in a pattern (fixed values).
WHITE = "\t\n\x0b\x0c\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
FUZZINESS, MAX_RADIUS = 0.2, 6
#: Ligatures and what they stand for, three-letter ones first (fixed values).
LIGATURES = (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬅ", "st"), ("ﬆ", "st"), ("ǳ", "dz"))
#: Quotes and the straight ones that replace them (fixed values).
QUOTES = ("‘’‚‛“”„", "''''" + '"""')
#: Labels that a source list shows for its codes (fixed values).
SITE_LABELS = {
    "copyright": {"public-domain": "Public domain", "protected": "Protected", "unknown": "Unknown"},
    "display_mode": {"full-text": "Full text", "concordance-only": "Concordance only", "snippet": "Snippet"},
}


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with ``value`` worked out once however often it is used, also within other lambdas."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def trimmed(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(c, F.lit(WHITE))


def unpadded(c: Column) -> Column:
    """Without the white space of a client's script at both ends."""
    return F.regexp_replace(c, f"^[{SCRIPT_SPACE}]+|[{SCRIPT_SPACE}]+$", "")


def collapsed(c: Column) -> Column:
    """Each run of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """Parts between white space."""
    return F.array_remove(F.split(c, r"(?U)\s+"), "")


def n_words(c: Column) -> Column:
    return F.size(words(c))


def normalize_query(c: Column) -> Column:
    for sign in APOSTROPHES:
        c = F.replace(c, F.lit(sign), F.lit(""))
    return c


def tokenize(c: Column) -> Column:
    """Lower-case tokens of a text or query, apostrophes dropped first; null has none."""
    return F.array_remove(F.split(F.lower(normalize_query(F.coalesce(c, F.lit("")))), TOKEN_BREAK), "")


def token_lines(c: Column) -> Column:
    """The tokens as lines of a text, as none has a line feed; empty without tokens."""
    return F.btrim(F.regexp_replace(F.lower(normalize_query(F.coalesce(c, F.lit("")))), TOKEN_BREAK, "\n"), F.lit("\n"))


def fuzzy_radius(term: Column) -> Column:
    """Edit distance that a keyword's token allows: a fifth of its length, rounded, at most six."""
    return F.least(F.lit(MAX_RADIUS), F.round(F.length(term) * FUZZINESS).cast("int"))


def escape_html(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def escape_regex(c: Column) -> Column:
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def teaser(c: Column, size: int = 200) -> Column:
    """At most ``size`` characters, cut at the last space if there is one after the first character, and an ellipsis."""
    cut = F.substring(c, 1, size)
    at_space = F.regexp_extract(cut, r"(?s)^(.+) [^ ]*$", 1)
    return F.when(F.length(c) > size, F.concat(F.when(at_space != "", at_space).otherwise(cut), F.lit("…"))).otherwise(c)


def label(c: Column, kind: str) -> Column:
    """Display label of a code; unknown codes stay as they are."""
    pairs = [F.lit(x) for kv in SITE_LABELS[kind].items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[c], c)


def status_badge(enabled: Column, display_mode: Column) -> Column:
    return F.when(~enabled, "Soon").when(display_mode == "full-text", "Full-Text").when(display_mode == "concordance-only", "Concordance").otherwise("Snippet")


def date_label(month_day: Column) -> Column:
    """``MM-DD`` as "June 28"; 29 February is a day."""
    return F.date_format(F.to_date(F.concat(F.lit("2000-"), month_day), "yyyy-MM-dd"), "MMMM d")


def page_ref(page: Column) -> Column:
    return F.concat(F.lit("p."), page.cast("string"))


def page_number(ref: Column) -> Column:
    return F.regexp_extract(ref, r"^p\.?(\d+)$", 1).try_cast("int")


def chapter_slug(c: Column, size: int = 30) -> Column:
    """Lower-case ASCII letters, digits and single hyphens, at most ``size``."""
    s = F.regexp_replace(F.lower(c), r"(?U)[\s–—-]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9-]", ""), "-{2,}", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, size), "-+$", "")


def passage_id(source: Column, chapter: Column, seq: Column) -> Column:
    return F.format_string("%s-%s-p%04d", source, chapter_slug(chapter), seq)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def token_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))


def expand_ligatures(c: Column) -> Column:
    for sign, letters in LIGATURES:
        c = F.replace(c, F.lit(sign), F.lit(letters))
    return c


def count_ligatures(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[" + "".join(s for s, _ in LIGATURES) + "]"))


def straighten_quotes(c: Column) -> Column:
    return F.translate(c, *QUOTES)


def space_dashes(c: Column) -> Column:
    """A spaced em dash for each en or em dash between word characters, ranges of numbers included."""
    spaced = F.regexp_replace(c, r"(?U)(\w)\s*[–—]\s*(\w)", "$1 — $2")
    return F.when(F.contains(c, F.lit("–")) | F.contains(c, F.lit("—")), spaced).otherwise(c)


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def collapse_blanks(c: Column) -> Column:
    """Runs of spaces and tabs as one space, none at line ends."""
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}|\t", " "), r"(?m) $", "")


def normalize_text(c: Column) -> Column:
    """All steps of text normalisation that need no repair of encodings."""
    plain = bound(straighten_quotes(expand_ligatures(unix_lines(c))), space_dashes)
    return collapse_blanks(plain)


def component(c: Column) -> Column:
    """A text as a component of a URL, as a client's script encodes it."""
    out = F.url_encode(c)
    for code, sign in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def link(template: Column, data: Column) -> Column:
    """``{{name}}`` places of a link template filled from a map, URL-encoded; names without value stay."""
    return F.aggregate(F.map_entries(data), template, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(F.url_encode(e["value"]), F.lit(""))))


def share_link(base: Column, q: Column) -> Column:
    return F.concat(base, F.lit("?q="), component(q))


def query_of_link(url: Column) -> Column:
    return F.url_decode(F.parse_url(url, F.lit("QUERY"), F.lit("q")))


def filter_label(ids: Column) -> Column:
    return F.coalesce(F.array_join(ids, ", "), F.lit("all"))
