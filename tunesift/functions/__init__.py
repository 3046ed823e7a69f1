"""Column expressions (``Column -> Column``), all built from JVM-side
``pyspark.sql.functions`` so they stay inside whole-stage codegen."""

from tunesift.functions.coerce import (  # noqa: F401
    coerce_int_zero, explicit_flag, year_prefix, year_from_date_prefix, release_year_or_zero,
)
from tunesift.functions.text import (  # noqa: F401
    null_to_empty, norm_text, strip_ws, split_genres, genre_set, primary_genre, main_genre_naive,
    genre_doc, word_tokens, with_ngrams, artist_key_strip_lower, artist_key_lower, artist_key_strip,
    display_label, track_url, synth_track_id,
)
