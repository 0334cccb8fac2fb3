"""Text functions as Catalyst expressions; Python only for exact Unicode folding and Porter stems."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lexicon as L


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), 0)


def strings(values: Sequence[str]) -> Column:
    """An array literal of strings."""
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normalize(c: Column) -> Column:
    """Lower case, ß as ss, stripped: equals NFKC case folding for text without compatibility characters."""
    return strip(F.regexp_replace(F.lower(c), "ß", "ss"))


@F.pandas_udf(StringType())
def normalize_exact(values: pd.Series) -> pd.Series:
    """NFKC, full case folding, stripped, for any Unicode text (Arrow batches)."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold().strip())


def words(c: Column) -> Column:
    """ASCII words of a normalized text; hyphens and apostrophes join, accents split."""
    return F.regexp_extract_all(c, F.lit(L.WORD), F.lit(0))


def stems(w: Column) -> Column:
    """The word and its plain endings cut off, sorted: ing, ed, es, s."""
    n = F.length(w)
    cut = lambda ending, longer: F.when((n > longer) & w.endswith(ending), F.substring(w, F.lit(1), n - len(ending)))
    return F.array_sort(F.array_distinct(F.filter(F.array(w, cut("ing", 5), cut("ed", 4), cut("es", 4), cut("s", 3)), lambda x: F.length(x) > 1)))


def cjk_segments(run: Column) -> Column:
    """A single character as it is; else all pairs, then all triples of the run."""
    n = F.length(run)
    grams = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(run, i, F.lit(k)))).otherwise(strings([]))
    return F.when(n == 1, F.array(run)).otherwise(F.concat(grams(2), grams(3)))


def characters(run: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.substring(run, i, F.lit(1)))


def lexical_terms(
    c: Column, limit: int | None = 256, index_characters: bool = False, fold: Callable[[Column], Column] = normalize, segments: Callable[[Column], Column] = cjk_segments
) -> Column:
    """Ordered distinct search terms: word stems without stopwords, then CJK segments, then single characters."""
    stop = strings(L.STOPWORDS)

    def of_run(run: Column) -> Column:
        found = F.filter(segments(run), lambda t: (t != "") & ~F.array_contains(stop, t) & ((F.length(t) > 1) | (F.length(run) == 1)))
        return F.concat(found, F.filter(characters(run), lambda t: ~F.array_contains(stop, t))) if index_characters else found

    def of_text(n: Column) -> Column:
        kept = F.filter(words(n), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))
        return F.array_distinct(F.concat(F.flatten(F.transform(kept, stems)), F.flatten(F.transform(F.regexp_extract_all(n, F.lit(L.CJK), F.lit(0)), of_run))))

    terms = let(fold(F.coalesce(c, F.lit(""))), of_text)
    return terms if limit is None else F.slice(terms, 1, limit)


def semantic_terms(c: Column, limit: int = 128, concepts: Sequence[Sequence[str]] = L.CONCEPTS) -> Column:
    """The lexical terms, then all members of every concept group that they touch."""

    def widened(base: Column) -> Column:
        groups = [F.when(F.arrays_overlap(base, strings(g)), strings(sorted(g))).otherwise(strings([])) for g in concepts]
        return F.slice(F.array_distinct(F.concat(base, *groups)), 1, limit)

    return let(lexical_terms(c, limit), widened)


def search_text(content: Column, annotation: Column | None = None) -> Column:
    """What the index keeps beside the content: up to 384 terms of content and annotation."""
    both = F.concat(content, F.lit("\n"), F.coalesce(annotation, F.lit(""))) if annotation is not None else F.concat(content, F.lit("\n"))
    return F.array_join(lexical_terms(both, 384, index_characters=True), " ")


def match_query(terms: Column) -> Column:
    """Terms as one quoted disjunction, inner quotes doubled, blanks left out."""
    quoted = F.transform(F.filter(F.transform(terms, lambda t: strip(F.replace(t, F.lit('"'), F.lit('""')))), lambda t: t != ""), lambda t: F.concat(F.lit('"'), t, F.lit('"')))
    return F.array_join(quoted, " OR ")


def phrase_bonus(query: Column, content: Column) -> Column:
    return let(normalize(query), lambda q: F.when((F.length(q) >= 4) & F.contains(normalize(content), q), 1.0).otherwise(0.0))


def held_terms(*values: Column) -> Column:
    """What coverage() looks terms up in: any of the values' first 512 terms."""
    return F.array_distinct(F.flatten(F.array(*(lexical_terms(v, 512) for v in values))))


def coverage(terms: Column, *values: Column) -> Column:
    """Share of the (distinct) ``terms`` that any of the values' first 512 terms hold; 0 without terms."""
    return covered(terms, held_terms(*values))


def covered(terms: Column, held: Column) -> Column:
    """Share of the (distinct) ``terms`` among the ``held`` ones; 0 without terms."""
    return F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, held)) / F.size(F.array_distinct(terms))).otherwise(0.0)


def whole_terms(content: Column, indexed: Column) -> Column:
    """What lexical_overlap() looks terms up in."""
    return lexical_terms(F.concat(content, F.lit("\n"), F.coalesce(indexed, F.lit(""))), 1024)


def lexical_overlap(terms: Column, content: Column, indexed: Column) -> Column:
    """Whether a query term of some length (two CJK characters, three others) is among the content's terms."""
    return overlapping(terms, whole_terms(content, indexed))


def overlapping(terms: Column, whole: Column) -> Column:
    return F.arrays_overlap(F.filter(terms, lambda t: (F.length(t) > 2) | (F.length(t) >= 2) & t.rlike(f"^{L.CJK}$")), whole)


def has_marker(normalized: Column, markers: Sequence[str]) -> Column:
    """Markers with ASCII letters must stand alone; others count anywhere."""
    ascii_ = [m for m in markers if any(ch.isascii() and ch.isalpha() for ch in m)]
    found = normalized.rlike(rf"(?<![a-z0-9_])(?:{'|'.join(ascii_)})(?![a-z0-9_])") if ascii_ else F.lit(False)
    for m in markers:
        if m not in ascii_:
            found = found | F.contains(normalized, F.lit(m))
    return found


def temporal_intent(query: Column, latest: Sequence[str] = L.LATEST_MARKERS, earliest: Sequence[str] = L.EARLIEST_MARKERS) -> Column:
    return let(normalize(query), lambda n: F.when(has_marker(n, earliest), "earliest").when(has_marker(n, latest), "latest").otherwise("none"))


def has_update_marker(content: Column, markers: Sequence[str] = L.UPDATE_MARKERS) -> Column:
    return let(normalize(content), lambda n: has_marker(n, markers))


def estimate_tokens(c: Column) -> Column:
    """CJK characters, and a quarter of the others rounded up."""
    c = F.coalesce(c, F.lit(""))
    return let(F.length(F.regexp_replace(c, L.CJK, "")), lambda other: F.length(c) - other + F.floor((other + 3) / 4).cast("int"))


def bounded_query(query: Column, most: int) -> Column:
    """A query of up to ``most`` characters, or its head and tail with a line feed between."""
    head = (most - 1) // 4
    tail = most - head - 1
    return F.when(F.length(query) <= most, query).otherwise(F.concat(F.substring(query, 1, head), F.lit("\n"), F.substring(query, F.length(query) - tail + 1, F.lit(tail))))


def long_query_terms(query: Column, excerpt: Column, planned: Column | None = None, priority_chars: int = 512, priority_terms: int = 80, most: int = 160) -> Column:
    """Terms of a long query: those of its tail and their concepts first, then the descriptive rest."""
    planned = planned if planned is not None else strings([])
    tail = F.substring(excerpt, F.greatest(F.length(excerpt) - (priority_chars - 1), F.lit(1)), F.lit(priority_chars))
    text = let(tail, lambda t: F.array_join(F.concat(planned, F.array(t), semantic_terms(t, 32)), " "))

    def after(priority: Column) -> Column:
        rest = F.filter(lexical_terms(query, None), lambda t: ~F.array_contains(priority, t))
        keyed = F.transform(rest, lambda t, i: F.struct(t.rlike("(?U)[0-9]|\\p{Nd}").alias("digit"), (-F.length(t)).alias("short"), i.alias("i"), t.alias("t")))
        return F.slice(F.concat(priority, F.transform(F.array_sort(keyed), lambda s: s["t"])), 1, most)

    return let(lexical_terms(text, priority_terms), after)


def query_terms(query: Column, max_chars: int = 16_000, planned: Column | None = None, most: int = 160) -> Column:
    """Search terms of a query: the short or the long way, by its length and its number of terms."""
    planned = planned if planned is not None else strings([])
    is_long = (F.length(query) > max_chars) | (F.size(lexical_terms(query, most + 1)) > most)

    def of_excerpt(bounded: Column) -> Column:
        short = lexical_terms(F.array_join(F.concat(F.array(bounded), planned, semantic_terms(bounded, 96)), " "), most)
        return F.when(is_long, long_query_terms(query, bounded, planned, most=most)).otherwise(short)

    return let(bounded_query(query, max_chars), of_excerpt)


def clauses(content: Column) -> Column:
    """Independent statements of a text, blank ones left out."""
    return F.filter(F.split(content, L.CLAUSE_BREAK), lambda part: strip(part) != "")


def is_global_summary(query: Column) -> Column:
    return query.rlike(L.SUMMARY_ACTION) & query.rlike(L.SUMMARY_SCOPE) | query.rlike(L.SUMMARY_CHINESE)


def prefix_terms(terms: Column, most: int = 200) -> Column:
    """array<struct<term, prefix>>: cleaned terms for a prefix index; those with ASCII letters or digits match as prefixes."""
    cleaned = F.filter(F.transform(terms, lambda t: F.regexp_replace(t, L.QUERY_WORD_DROPPED, "")), lambda t: t != "")
    return F.slice(F.array_distinct(F.transform(cleaned, lambda t: F.struct(t.alias("term"), t.rlike("^[\\x00-\\x7f]+$").alias("prefix")))), 1, most)


def like_terms(terms: Column, most: int = 12) -> Column:
    """Terms beyond ASCII for substring search: a longer first one, single characters, then the other longer ones."""
    beyond = F.filter(F.transform(terms, lambda t: F.regexp_replace(t, L.QUERY_WORD_DROPPED, "")), lambda t: (t != "") & ~t.rlike("^[\\x00-\\x7f]*$"))

    def chosen(own: Column) -> Column:
        first = F.filter(F.slice(own, 1, 1), lambda t: F.length(t) > 1)
        single, longer = F.filter(own, lambda t: F.length(t) == 1), F.filter(own, lambda t: F.length(t) > 1)
        return F.slice(F.array_distinct(F.concat(first, single, longer)), 1, most)

    return let(F.array_distinct(beyond), chosen)


def first_single_cjk(terms: Column) -> Column:
    """The first one-character CJK term, null without one."""
    return F.get(F.filter(terms, lambda t: t.rlike(f"^[{L.CJK_CLASS}]$")), 0)


def chunk_index(request_id: Column) -> Column:
    """Place of a chunk that a request id names; far behind without one."""
    digits = F.regexp_extract(request_id, L.CHUNK_INDEX, 1)
    return F.when(digits != "", F.try_to_number(digits, F.lit("9" * 18)).cast("long")).otherwise(F.lit(L.NO_CHUNK).cast("long"))


def truncate_line(line: Column, most: Column) -> Column:
    """The line if it fits ``most`` tokens, else its longest fitting prefix, right-stripped, with three dots."""
    step = F.aggregate(
        characters(line),
        F.struct(F.lit(0).alias("cjk"), F.lit(0).alias("other"), F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda s, ch: F.struct(
            (s["cjk"] + ch.rlike(f"^{L.CJK}$").cast("int")).alias("cjk"),
            (s["other"] + (~ch.rlike(f"^{L.CJK}$")).cast("int")).alias("other"),
            (s["n"] + (s["open"] & _fits(s, ch, most)).cast("int")).alias("n"),
            (s["open"] & _fits(s, ch, most)).alias("open"),
        ),
    )
    cut = F.regexp_replace(F.substring(line, F.lit(1), step["n"]), r"(?U)\s+$", "")
    return F.when(estimate_tokens(line) <= most, line).otherwise(F.concat(cut, F.lit("...")))


def _fits(s: Column, ch: Column, most: Column) -> Column:
    cjk = ch.rlike(f"^{L.CJK}$").cast("int")
    return s["cjk"] + cjk + F.floor((s["other"] + 1 - cjk + 6) / 4) <= most
