"""Text columns: cleaning, and counts that read a text without building token lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harbinger.functions.columns import as_col, ratio, strip, text_or_empty, utc_naive

# Characters a spreadsheet cannot hold, and the vowels of French words.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
VOWELS = "aeiouyàâäéèêëïîôöùûüÿœ"

WORD = r"[\p{L}\p{N}_]+"
_LETTER_NO_VOWEL = rf"[\p{{L}}&&[^{VOWELS}]]"
_CHAR_NO_VOWEL = rf"[\p{{L}}\p{{N}}_&&[^{VOWELS}]]"
# a word that holds a letter and no vowel
_VOWELLESS = (
    rf"(?<![\p{{L}}\p{{N}}_])[\p{{N}}_]*+{_LETTER_NO_VOWEL}{_CHAR_NO_VOWEL}*+(?![\p{{L}}\p{{N}}_])"
)
# a stretch between sentence ends that holds more than white space
_SENTENCE = r"(?U)[\s\x1c-\x1f]*+[^.!?\s\x1c-\x1f][^.!?]*+"


def drop_controls(c: Column | str) -> Column:
    """Without control characters, hard blanks as blanks, trimmed."""
    text = F.regexp_replace(as_col(c), CONTROL, "")
    return strip(F.replace(text, F.lit("\u00a0"), F.lit(" ")))


def clean_text(c: Column | str) -> Column:
    """White space runs become one blank, then ``drop_controls``; null becomes empty."""
    return drop_controls(F.regexp_replace(text_or_empty(c), r"(?U)[\s\x1c-\x1f]+", " "))


def lead_paragraph(c: Column | str) -> Column:
    """First block before a blank line; without any block the first two sentences."""
    text = text_or_empty(c)
    blocks = F.filter(F.split(text, r"\n{2,}|\r\n{2,}"), lambda b: strip(b) != "")
    sentences = F.split(strip(text), r"(?U)(?<=[.!?])\s+")
    return F.when(F.size(blocks) > 0, clean_text(F.element_at(blocks, 1))).otherwise(
        clean_text(F.array_join(F.slice(sentences, 1, 2), " "))
    )


def published_day(c: Column | str) -> Column:
    """ISO day where the text is a date, else the text itself; empty stays empty."""
    text = strip(text_or_empty(c))
    return F.coalesce(F.date_format(utc_naive(text), "yyyy-MM-dd"), text)


def fill_template(template: str, columns: dict[str, str]) -> Column:
    """``"{title} {description}"`` over columns; null counts as empty; trimmed."""
    pieces: list[Column] = []
    rest = template
    while rest:
        head, mark, tail = rest.partition("{")
        if head:
            pieces.append(F.lit(head))
        if not mark:
            break
        name, _, rest = tail.partition("}")
        pieces.append(text_or_empty(columns[name]))
    return strip(F.concat(*pieces))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(as_col(c), F.lit(WORD))


def word_chars(c: Column | str) -> Column:
    return F.length(F.regexp_replace(as_col(c), r"[^\p{L}\p{N}_]+", ""))


def sentence_count(c: Column | str) -> Column:
    return F.regexp_count(as_col(c), F.lit(_SENTENCE))


def syllables(c: Column | str) -> Column:
    """Vowel runs, and one for every word that has letters but no vowel.

    Runs end at word borders because only word characters are vowels, so the sum over
    words equals two counts over the whole text.
    """
    low = F.lower(as_col(c))
    return F.regexp_count(low, F.lit(f"[{VOWELS}]+")) + F.regexp_count(low, F.lit(_VOWELLESS))


def text_measures(c: Column | str) -> dict[str, Column]:
    text = as_col(c)
    words, marks = word_count(text), syllables(text)
    return {
        "avg_sentence_len_words": ratio(words, sentence_count(text)),
        "avg_word_len_chars": ratio(word_chars(text), words),
        "total_syllables": marks.cast("double"),
        "avg_syllables_per_word": ratio(marks, words),
        "len_chars": F.length(text).cast("double"),
        "len_words": words.cast("double"),
    }
