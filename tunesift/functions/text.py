"""String and array column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
# genre delimiters: ';' and '|' are rewritten to ',' before splitting on ','
GENRE_DELIMS = "[;|]"
# word token of the recommender vectorisers: a Unicode word run (\w+ in
# Python's Unicode mode); Java's \w is ASCII-only, so the class is spelled out
WORD_TOKEN = r"[\p{L}\p{N}_]+"
# lab vectorisers: genres are letters, German umlauts, sharp s and hyphen;
# titles add digits (the lab pattern also admits a literal backslash)
LAB_GENRE_TOKEN = r"[a-zA-ZäöüÄÖÜß\\-]+"
LAB_TITLE_TOKEN = r"[a-zA-Z0-9äöüÄÖÜß\\-]+"
# public link prefix of a track (a parameter of track_url; neutral default)
TRACK_URL_PREFIX = "https://example.org/track/"
# separators used for display labels and synthesised ids
DISPLAY_SEP = " — "
SYNTH_ID_SEP = " :: "
# label for a blank primary genre
UNKNOWN_GENRE = "unknown"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_to_empty(c) -> Column:
    """Null text becomes the empty string (never the token 'nan')."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def strip_ws(c) -> Column:
    """Strip leading/trailing whitespace of any kind (Python ``str.strip``)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def norm_text(c) -> Column:
    """Lower, strip, collapse whitespace runs to one space."""
    return F.regexp_replace(strip_ws(F.lower(_c(c))), r"\s+", " ")


def split_genres(c) -> Column:
    """Genre bag: lower, ';'/'|' -> ',', split, strip, drop empty."""
    parts = F.split(F.regexp_replace(F.lower(null_to_empty(c)), GENRE_DELIMS, ","), ",")
    return F.filter(F.transform(parts, strip_ws), lambda t: t != F.lit(""))


def genre_set(c) -> Column:
    """The same tokens as a set (first occurrence order kept)."""
    return F.array_distinct(split_genres(c))


def primary_genre(c) -> Column:
    """First comma-separated token after delimiter rewrite; blank -> 'unknown'."""
    raw = null_to_empty(c)
    first = strip_ws(F.split(F.regexp_replace(F.lower(raw), GENRE_DELIMS, ","), ",").getItem(0))
    return (F.when(strip_ws(raw) == "", F.lit(UNKNOWN_GENRE))
             .when(first == "", F.lit(UNKNOWN_GENRE))
             .otherwise(first))


def main_genre_naive(c) -> Column:
    """Text before the first ',' with no cleaning; null -> ''."""
    return F.substring_index(null_to_empty(c), ",", 1)


def genre_doc(c) -> Column:
    """Genre document: lower, delimiters -> space, collapse, strip."""
    s = F.regexp_replace(F.lower(null_to_empty(c)), GENRE_DELIMS, ",")
    s = F.regexp_replace(s, ",", " ")
    return strip_ws(F.regexp_replace(s, r"\s+", " "))


def word_tokens(c, pattern: str = WORD_TOKEN, min_len: int = 1,
                stop_words: list[str] | None = None) -> Column:
    """Lower-cased regex tokens, optional length and stop-word filter."""
    toks = F.regexp_extract_all(F.lower(null_to_empty(c)), F.lit(pattern), 0)
    if min_len > 1:
        toks = F.filter(toks, lambda t: F.length(t) >= min_len)
    if stop_words:
        stop = F.array(*[F.lit(w) for w in stop_words])
        toks = F.filter(toks, lambda t: ~F.array_contains(stop, t))
    return toks


def with_ngrams(tokens: Column, lo: int = 1, hi: int = 2) -> Column:
    """D3: all n-grams with lo <= n <= hi, joined by a space, in one array."""
    out = None
    for n in range(lo, hi + 1):
        if n == 1:
            grams = tokens
        else:
            idx = F.sequence(F.lit(0), F.size(tokens) - n)
            grams = F.when(F.size(tokens) >= n, F.transform(
                idx, lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))
            ).otherwise(F.array().cast("array<string>"))
        out = grams if out is None else F.concat(out, grams)
    return out


def artist_key_strip_lower(c) -> Column:
    """B17 (diversify / relevance): strip + lower."""
    return F.lower(strip_ws(null_to_empty(c)))


def artist_key_lower(c) -> Column:
    """B17 (diversity metric): lower only."""
    return F.lower(null_to_empty(c))


def artist_key_strip(c) -> Column:
    """B17 (dominant artists): strip only."""
    return strip_ws(null_to_empty(c))


def display_label(track_name="track_name", artist_name="artist_name") -> Column:
    """B10: 'track_name — artist_name' with nulls as ''."""
    return F.concat(null_to_empty(track_name), F.lit(DISPLAY_SEP), null_to_empty(artist_name))


def track_url(track_id="track_id", prefix: str = TRACK_URL_PREFIX) -> Column:
    """Public link of a track."""
    return F.concat(F.lit(prefix), _c(track_id).cast("string"))


def synth_track_id(track_name="track_name", artist_name="artist_name") -> Column:
    """B2: normalised 'track_name :: artist_name' when no id exists."""
    return norm_text(F.concat(null_to_empty(track_name), F.lit(SYNTH_ID_SEP), null_to_empty(artist_name)))
