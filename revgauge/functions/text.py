"""Text scalars.

Patterns carry Java flags so that they mean what they mean on Unicode text: ``U`` for Unicode classes and word
edges, ``d`` so that a dot stops at a newline only, ``i``/``u`` to ignore case. Blanks are Unicode white space plus
the four separator control characters.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from revgauge import fixed_values as fv
from revgauge.functions.binding import once

BLANK = r"[\s\x1c-\x1f]"
INK = r"[^\s\x1c-\x1f]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _unicode_blanks(pattern: str) -> str:
    return pattern.replace(r"\s", BLANK)


def _change_some(texts: pa.Array, chosen: pa.Array, change) -> pa.Array:
    """Apply a Python function to the chosen texts only."""
    chosen = pc.fill_null(chosen, False)
    if not pc.any(chosen).as_py():
        return texts
    changed = pa.array([change(t) for t in texts.filter(chosen).to_pylist()], texts.type)
    return pc.replace_with_mask(texts, chosen, changed)


#: Latin letters and signs that are their own NFKC form, and join no neighbour as long as no other character is near.
_STABLE = "".join(c for c in map(chr, range(0xA1, 0x250)) if unicodedata.normalize("NFKC", c) == c)
_UNSTABLE = rf"[^\x00-\x7f{_STABLE}]"


@arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    """Texts of stable characters pass in one vectorised test; Arrow's own normalisation differs from Unicode's for
    thousands of characters, so the others take Python's."""
    return _change_some(texts, pc.match_substring_regex(texts, _UNSTABLE), lambda t: unicodedata.normalize("NFKC", t))


@arrow_udf(StringType())
def _unescape(texts: pa.Array) -> pa.Array:
    return _change_some(texts, pc.match_substring(texts, "&"), html.unescape)


def unicode_nfkc(text) -> Column:
    return _nfkc(_col(text))


def html_unescape(text) -> Column:
    """Character references to characters; texts without ``&`` pass through untouched."""
    return _unescape(_col(text))


def _has_any(text: Column, needles) -> Column:
    out = F.contains(text, F.lit(needles[0]))
    for n in needles[1:]:
        out = out | F.contains(text, F.lit(n))
    return out


def _where_has(text, needles, replace) -> Column:
    """``replace(text)`` only for texts that hold one of the needles every match must contain: a byte search is far
    cheaper than a pattern, and most texts hold none."""
    return once(text, lambda t: F.when(_has_any(t, needles), replace(t)).otherwise(t))


def flatten_breaks(text) -> Column:
    return F.regexp_replace(_col(text), r"[\r\n\t]+", " ")


def strip_urls(text) -> Column:
    pattern = rf"(?U)http{INK}+|www\.{INK}+|www{INK}+"
    return _where_has(text, ["http", "www"], lambda t: F.regexp_replace(t, pattern, " "))


def strip_emails(text) -> Column:
    # the look-behind starts a match only where a run of ink begins: same result, no quadratic rescans
    pattern = rf"(?U)(?<!{INK}){INK}+@{INK}+"
    return _where_has(text, ["@"], lambda t: F.regexp_replace(t, pattern, " "))


def strip_bullets(text) -> Column:
    return _where_has(text, "•▪►◆■│", lambda t: F.regexp_replace(t, "[•▪►◆■│]+", " "))


def strip_boilerplate(text) -> Column:
    # each pattern runs to the end of the line, so one pass over both equals one pass each
    return F.regexp_replace(_col(text), "(?iud)" + "|".join(fv.BOILERPLATE_PATTERNS), " ")


def collapse_whitespace(text) -> Column:
    # all runs but a single blank, which is most of them
    return F.trim(F.regexp_replace(_col(text), rf"(?U) {BLANK}+|[\s\x1c-\x1f&&[^ ]]{BLANK}*", " "))


def collapse_punct(text) -> Column:
    """Three or more of the same ``! ? . ,`` become one."""
    return _where_has(text, ["!!!", "???", "...", ",,,"],
                      lambda t: F.regexp_replace(t, r"([!?.,])\1{2,}", "$1"))


def collapse_stretch(text) -> Column:
    """Four or more of the same character become two."""
    return F.regexp_replace(_col(text), r"(?d)(.)\1{3,}", "$1$1")


def clean_text(raw) -> Column:
    """The whole cleaning chain, in its defined order."""
    out = unicode_nfkc(F.coalesce(_col(raw), F.lit("")))
    for step in (flatten_breaks, strip_urls, strip_emails, strip_bullets, strip_boilerplate, collapse_whitespace,
                 collapse_punct, collapse_stretch, F.lower):
        out = step(out)
    return out


def tokenize_ws(text) -> Column:
    """Split at white space; no empty tokens."""
    return F.array_remove(F.split(_col(text), f"(?U){BLANK}+"), "")


def word_count(text) -> Column:
    return F.regexp_count(_col(text), F.lit(f"(?U){INK}++"))


def tokenize_simple(text) -> Column:
    """Lower-case runs of letters a-z, digits and apostrophes, two characters or longer."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z0-9']{2,}"), F.lit(0))


def remove_stopwords(tokens, stopwords=None) -> Column:
    """Drop stopwords and tokens of one or two characters."""
    words = sorted(set(fv.ENGLISH_STOPWORDS) | set(fv.DOMAIN_STOPWORDS)) if stopwords is None else list(stopwords)
    return F.filter(_col(tokens), lambda t: (F.length(t) > 2) & ~t.isin(words))


def ngrams(tokens, n: int) -> Column:
    """All runs of ``n`` neighbouring tokens, joined by a blank."""
    if n == 1:
        return _col(tokens)

    def runs(t):
        starts = F.slice(t, 1, F.size(t) - (n - 1))
        joined = F.transform(starts, lambda x, i: F.concat_ws(" ", x, *[F.get(t, i + k) for k in range(1, n)]))
        return F.when(F.size(t) >= n, joined).otherwise(F.array().cast("array<string>"))

    return once(tokens, runs)


def strip_prompts(text) -> Column:
    pattern = "(?iUd)" + "|".join(_unicode_blanks(p) for p in fv.PROMPT_PATTERNS)

    def stripped(v):
        # words every prompt must contain; the odd letters are other cases of s and i, which lower() keeps apart
        t, low = v["t"], v["low"]
        has = lambda *words: reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in words])
        possible = (has("things", "value", "advisor") | has("feedback", "have") | has("love", "hear") | has("scale")
                    | has("please", "rate") | has("&amp") | has("client first capital")
                    | (has("how") & _has_any(low, ["feel", "describe", "likely"]))
                    | _has_any(t, "ſİı"))
        return F.when(possible, F.regexp_replace(t, pattern, " ")).otherwise(t)

    text = _col(text)
    return collapse_whitespace(once(F.struct(text.alias("t"), F.lower(text).alias("low")), stripped))


def normalize_name(name, word_bounded: bool = False) -> Column:
    """Lower-case letters and blanks only, credentials removed.

    Credentials are removed wherever their letters occur ("adams" becomes "ada"); ``word_bounded`` removes whole
    words only.
    """
    creds = "|".join(fv.CREDENTIALS)
    pattern = rf"\b(?:{creds})\b" if word_bounded else creds
    out = F.regexp_replace(F.lower(_col(name)), pattern, " ")
    out = F.regexp_replace(out, rf"(?U)[^a-z\s\x1c-\x1f]", " ")
    return collapse_whitespace(out)


def remove_entity_name(text, name) -> Column:
    """Delete the full normalised name, then its first and last word (three letters or more), as whole words.

    Normalised names hold a-z and blanks only, so they are safe inside a pattern. A text that
    does not contain the letters is not searched for the word.
    """
    def without(v, word, least):
        pattern = F.concat(F.lit(r"(?U)\b"), word, F.lit(r"\b"))
        wanted = (F.length(word) >= least) & F.contains(v, word)
        return F.when(wanted, F.regexp_replace(v, pattern, F.lit(" "))).otherwise(v)

    def removed(v):
        adv = v["adv"]
        parts = F.split(adv, " ")
        out = without(v["low"], adv, 1)
        out = once(out, lambda t: without(t, F.element_at(parts, 1), 3))
        return once(out, lambda t: without(t, F.element_at(parts, -1), 3))

    both = F.struct(F.lower(_col(text)).alias("low"), normalize_name(name).alias("adv"))
    return collapse_whitespace(once(both, removed))


def strip_name_literal(text, name) -> Column:
    """Delete the name as written, case ignored; a missing or blank name leaves the text as it is."""
    text, name = _col(text), collapse_edges(name)
    quoted = F.concat(F.lit(r"(?iu)\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.when(F.length(name) > 0, collapse_whitespace(F.regexp_replace(text, quoted, F.lit(" ")))).otherwise(text)


def collapse_edges(text) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(_col(text), rf"(?U)^{BLANK}+|{BLANK}+$", "")


def name_mention_flag(text, name) -> Column:
    """1 if the full name, or its first word (two characters or more), occurs as a word, else 0."""
    low = F.lower(_col(text))
    full = collapse_whitespace(F.lower(_col(name)))
    first = F.element_at(F.split(full, " "), 1)

    def found(term):
        quoted = F.concat(F.lit(r"(?U)\b\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
        # a plain substring test first: most texts never reach the pattern
        return F.contains(low, term) & F.regexp_like(low, quoted)

    hit = (F.length(full) > 0) & (found(full) | ((F.length(first) >= 2) & found(first)))
    return F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(0)


def review_hash(entity_id, text, review_date, reviewer) -> Column:
    """Identity of a review: 16 hex digits over entity, text, day and reviewer."""
    day = F.coalesce(F.date_format(_col(review_date), "yyyy-MM-dd"), F.lit("no_date"))
    who = F.coalesce(collapse_edges(reviewer), F.lit("anonymous"))
    key = F.concat_ws("||", F.coalesce(_col(entity_id).cast("string"), F.lit("")), F.coalesce(_col(text), F.lit("")), day, who)
    return F.substring(F.sha2(key, 256), 1, 16)


def snippet(text, length: int = 200) -> Column:
    text = F.coalesce(_col(text), F.lit(""))
    head = collapse_edges(F.substring(text, 1, length))
    return F.when(F.length(text) > length, F.concat(head, F.lit("..."))).otherwise(head)


def any_phrase(text, phrases) -> Column:
    """True if any of the literal phrases occurs, case ignored."""
    return F.rlike(_col(text), F.lit("(?iu)" + "|".join(re.escape(p) for p in phrases)))


def keyword_sentence(sentence, keywords=fv.RELATIONSHIP_KEYWORDS, min_words: int = 8) -> Column:
    """True if a keyword occurs anywhere in the sentence and it has at least ``min_words`` words."""
    hit = F.rlike(F.lower(_col(sentence)), F.lit("|".join(re.escape(k) for k in keywords)))
    return hit & (word_count(sentence) >= min_words)


def sentences(text) -> Column:
    """Split after ``. ! ?`` followed by white space."""
    return F.split(_col(text), rf"(?U)(?<=[.!?]){BLANK}+")
