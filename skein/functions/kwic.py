"""Keyword in context: first hit, clip, highlight and citation as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import escape_html, escape_regex, words

#: Tags around a hit (fixed format).
MARK, END_MARK = '<mark><span class="sr-only">highlighted: </span>', "</mark>"
#: Private-use characters that stand for the tags while the text is escaped.
OPEN, CLOSE = "\ue000", "\ue001"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, whatever number of times it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bare(c: Column) -> Column:
    """Words between spaces, each reduced to ASCII letters, digits and apostrophes."""
    return F.regexp_replace(F.lower(c), r"[^\p{Alnum}' ]", "")


def hit_pattern(term: Column) -> Column:
    """What finds a term among bare words: a word within a word, or from the start of a word on a word within each of several, in time
    linear in the words."""
    wanted = F.transform(F.split(term, r"(?U)\s+"), bare)
    within = F.array_join(F.transform(wanted, lambda x: F.concat(F.lit("(?>[^ ]*?"), x, F.lit(")"))), "[^ ]*+ ")
    return F.when(F.size(wanted) == 1, wanted[0]).otherwise(F.concat(F.lit("(?<![^ ])"), within))


def first_hit(text_words: Column, terms: Column) -> Column:
    """Number from 0 of the first word where a term begins; null if none.  A term's words must be contained, in order, in
    consecutive words, both reduced to ASCII letters, digits and apostrophes."""
    plain, pattern = bare(F.array_join(text_words, " ")), F.array_join(F.transform(terms, hit_pattern), "|")

    def spaces_before(b: Column) -> Column:
        before = F.substring(b["plain"], F.lit(1), b["at"] - 1)
        return F.when(b["at"] > 0, F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit(""))))

    found = bound(plain, lambda p: bound(F.struct(p.alias("plain"), F.regexp_instr(p, pattern).alias("at")), spaces_before))
    return F.when((F.size(text_words) > 0) & (F.size(terms) > 0), found)


def highlight(text: Column, terms: Column) -> Column:
    """Escaped text with every term marked, case ignored, longer terms first.  Empty terms mark nothing."""
    real = F.filter(terms, lambda t: t != "")
    sized = F.array_sort(F.transform(real, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))))
    pattern = F.concat(F.lit("(?iu)("), F.array_join(F.transform(sized, lambda x: escape_regex(x["t"])), "|"), F.lit(")"))
    marked = F.call_function("regexp_replace", text, pattern, F.lit(f"{OPEN}$1{CLOSE}"))
    tagged = F.replace(F.replace(escape_html(marked), F.lit(OPEN), F.lit(MARK)), F.lit(CLOSE), F.lit(END_MARK))
    return F.when(F.size(real) == 0, escape_html(text)).otherwise(tagged)


def clip(text: Column, terms: Column, context: Column) -> Column:
    """``context`` words around the first hit, highlighted, with ellipses where words are left out; without a hit, the first words."""
    dots = lambda cond: F.when(cond, F.lit("…")).otherwise(F.lit(""))

    def cut(b: Column) -> Column:
        w, hit, n = b["w"], b["hit"], F.size(b["w"])
        start, stop = F.greatest(F.lit(0), hit - context), F.least(n - 1, hit + context)
        around = F.struct(dots(start > 0).alias("before"), F.array_join(F.slice(w, start + 1, stop - start + 1), " ").alias("text"), dots(stop < n - 1).alias("after"))
        head = F.struct(F.lit("").alias("before"), F.array_join(F.slice(w, F.lit(1), context), " ").alias("text"), dots(n > context).alias("after"))
        return F.when(hit.isNull(), head).otherwise(around)

    whole = bound(words(text), lambda w: bound(F.struct(w.alias("w"), first_hit(w, terms).alias("hit")), lambda b: F.struct(b["hit"].alias("hit"), cut(b).alias("cut"))))
    shown = lambda b: F.concat(b["cut"]["before"], F.when(b["hit"].isNull(), escape_html(b["cut"]["text"])).otherwise(highlight(b["cut"]["text"], terms)), b["cut"]["after"])
    return bound(whole, shown)


def kwic(text: Column, terms: Column, display_mode: Column, context: Column) -> Column:
    """The text of a result: whole and highlighted for full-text sources, else clipped; without terms, escaped only."""
    return F.when(F.size(terms) == 0, escape_html(text)).when(display_mode == "full-text", highlight(text, terms)).otherwise(clip(text, terms, context))


def citation(text: Column, title: Column, chapter: Column, page: Column, display_mode: Column | None = None, guard: bool = False) -> Column:
    """Text, dash, and title, chapter and page as far as present.  With ``guard``, null for texts that aren't shown whole."""
    filled = lambda c: F.when(c != "", c)
    where = F.concat_ws(", ", title, filled(chapter), F.concat(F.lit("p."), F.regexp_replace(filled(page), r"^p\.?", "")))
    whole = F.concat(text, F.lit("\n\n— "), where)
    return F.when(display_mode == "full-text", whole) if guard else whole
