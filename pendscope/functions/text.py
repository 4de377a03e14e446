"""Words and word pairs of a text, as Spark SQL expressions."""

from __future__ import annotations

from collections.abc import Sequence

# fixed value: a word is two or more letters, digits or underscores; most characters are settled by the first ranges
WORD = r"[a-z0-9_\p{L}\p{N}]{2,}"


def english_stop_words() -> list[str]:
    """Spark's own list; needs an active session."""
    from pyspark.ml.feature import StopWordsRemover

    return sorted(StopWordsRemover.loadDefaultStopWords("english"))


def words_sql(text: str, stop_words: Sequence[str] = ()) -> str:
    """Lower-case words in order; stop words leave before pairs are formed."""
    words = f"regexp_extract_all(lower(coalesce({text}, '')), r'{WORD}', 0)"
    # apostrophes never occur inside a word, so such stop words cannot match
    listed = ", ".join(f"'{w}'" for w in stop_words if "'" not in w)
    return f"filter({words}, w -> w NOT IN ({listed}))" if listed else words


def pairs_sql(words: str) -> str:
    """Neighbouring words joined by a space; ``words`` must be a column name."""
    return (f"if(size({words}) > 1, transform(sequence(0, size({words}) - 2), "
            f"i -> concat({words}[i], ' ', {words}[i + 1])), cast(array() AS array<string>))")


def doc_text_sql(note: str = "adjuster_note", code: str = "pend_code") -> str:
    """The note followed by the pend code as one word."""
    return f"concat(coalesce({note}, ''), ' pendcode_', lower(replace(coalesce({code}, 'none'), '-', '_')))"
