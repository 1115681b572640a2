"""Text folding, labels, search tokens and question language, as native columns."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import vocab

GREEK = "[\\u0370-\\u03ff\\u1f00-\\u1fff]"
# Unicode white space plus the zero-width marks that publishers leave behind.
SPACES = "[\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200d\\u2028\\u2029\\u202f\\u205f\\u3000]+"
SPACE_CHARS = (
    "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200E)))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.trim(text, F.lit(SPACE_CHARS))


def strip_front(text: Column) -> Column:
    """Trim every kind of white space in front."""
    return F.ltrim(text, F.lit(SPACE_CHARS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it.

    A lambda's argument is a value; a projected expression may be copied into every place that names it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


@lru_cache(maxsize=None)
def _accent_table(drop_class: str) -> tuple[str, str]:
    """Character pairs that remove accents, derived from the Unicode database.

    ``drop_class`` says which marks vanish: ``combining`` (non-zero combining
    class) or ``Mn`` (non-spacing marks).  The dropped marks come last, without a
    partner, which is how ``translate`` deletes.
    """
    if drop_class == "combining":
        drops = lambda ch: unicodedata.combining(ch) != 0
    else:
        drops = lambda ch: unicodedata.category(ch) == "Mn"
    pairs, marks = [], []
    for point in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= point <= 0xD7A3 or 0xD800 <= point <= 0xDFFF:
            continue
        ch = chr(point)
        if drops(ch):
            marks.append(ch)
            continue
        parts = unicodedata.normalize("NFD", ch)
        if parts == ch:
            continue
        bare = unicodedata.normalize("NFC", "".join(p for p in parts if not drops(p)))
        if len(bare) == 1 and bare != ch:
            pairs.append((ch, bare))
    source = "".join(a for a, _ in pairs) + "".join(marks)
    return source, "".join(b for _, b in pairs)


@lru_cache(maxsize=None)
def _casefold_tables() -> tuple[tuple[str, str], tuple[tuple[str, str], ...]]:
    """Where full case folding differs from lower-casing: 1:1 pairs and expansions."""
    single, longer = [("Σ", "σ")], []  # lower() alone would write a final sigma
    for point in range(0x80, 0x10000):
        if 0xD800 <= point <= 0xDFFF:
            continue
        ch = chr(point)
        if unicodedata.normalize("NFD", ch) != ch:
            continue
        folded = ch.casefold()
        if folded == ch.lower():
            continue
        if len(folded) == 1:
            single.append((ch, folded))
        else:
            longer.append((ch, folded))
    return ("".join(a for a, _ in single), "".join(b for _, b in single)), tuple(longer)


def fold_literal(value: str) -> str:
    """Fold a constant on the driver, so word lists can be written naturally."""
    text = "".join(c for c in unicodedata.normalize("NFD", value) if not unicodedata.combining(c))
    text = unicodedata.normalize("NFC", text).casefold().replace("ς", "σ")
    return " ".join(text.split())


def fold_literals(values) -> list[str]:
    return sorted({fold_literal(v) for v in values})


def has_greek(text: Column) -> Column:
    return text.rlike(GREEK)


def to_greek_capitals(text: Column) -> Column:
    """Map Latin capitals to the Greek letters they look like."""
    return F.translate(text, vocab.HOMOGLYPH_LATIN, vocab.HOMOGLYPH_GREEK)


def _folded(text: Column) -> Column:
    """Accents, case and final sigma removed; ``text`` is evaluated once per branch."""
    accents, bare = _accent_table("combining")
    (wide, narrow), longer = _casefold_tables()
    # translate() keeps the first pair of a character and deletes those past the
    # end of the replacement, so the deleted marks must come last.
    kept = len(bare)
    out = F.lower(F.translate(text, accents[:kept] + wide + accents[kept:], bare + narrow))
    expanded = out
    for ch, several in longer:
        expanded = F.replace(expanded, F.lit(ch), F.lit(several))
    return F.when(text.rlike("[" + "".join(ch for ch, _ in longer) + "]"), expanded).otherwise(out)


UNEVEN_SPACES = "  |[^\\S ]|[\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200d\\u2028\\u2029\\u202f\\u205f\\u3000]"


def _one_space(text: Column) -> Column:
    return F.trim(F.when(text.rlike(UNEVEN_SPACES), F.regexp_replace(text, SPACES, " ")).otherwise(text))


def is_plain(text: Column) -> Column:
    """ASCII only: lower-casing is all the folding it needs."""
    return ~text.rlike("[^\\x00-\\x7f]")


def fold(text: Column) -> Column:
    """Accent-, case-, sigma- and space-insensitive form of a text.

    Look-alike Latin capitals become Greek only when the text already holds Greek,
    so plain Latin column names stay as they are.
    """
    even = _one_space(text)
    return (
        F.when(is_plain(text), F.lower(even))
        .when(has_greek(text), _folded(to_greek_capitals(even)))
        .otherwise(_folded(even))
    )


def group_key(text: Column, homoglyphs: bool = True) -> Column:
    """Grouping key of a label: look-alike capitals are always mapped."""
    even = _one_space(text)
    if not homoglyphs:
        return F.when(is_plain(text), F.lower(even)).otherwise(_folded(even))
    # plain texts only need their look-alikes mapped to small Greek letters
    small = F.lower(F.translate(even, vocab.HOMOGLYPH_LATIN, vocab.HOMOGLYPH_GREEK.lower()))
    return F.when(is_plain(text), small).otherwise(_folded(to_greek_capitals(even)))


def contains_any(folded: Column, words) -> Column:
    """Whether a folded text contains one of the words (folded alike)."""
    escaped = "|".join(_quote(w) for w in fold_literals(words))
    return folded.rlike(escaped)


def first_contained(folded: Column, words) -> Column:
    """The first listed word a folded text contains, or null."""
    return F.coalesce(*[
        F.when(F.contains(folded, F.lit(w)), F.lit(w)) for w in dict.fromkeys(map(fold_literal, words))
    ])


def _quote(word: str) -> str:
    return "".join("\\" + c if c in ".^$*+?()[]{}|\\/" else c for c in word)


def safe_label(text: Column, max_chars: int | None = vocab.MAX_LABEL_CHARS) -> Column:
    """A cell value made safe to show: no control characters, links or markup; whole if ``max_chars`` is None."""
    out = F.regexp_replace(text if max_chars is None else F.substring(text, 1, max_chars * 4), "[\\x00-\\x1f\\x7f]", " ")
    for pattern in vocab.MARKUP_PATTERNS:
        out = F.regexp_replace(out, pattern, " ")
    out = F.trim(F.regexp_replace(out, SPACES, " "))
    if max_chars is not None:
        cut = F.concat(F.rtrim(F.substring(out, 1, max_chars - 1)), F.lit("…"))
        out = F.when(F.length(out) > max_chars, cut).otherwise(out)
    return F.when(out == "", F.lit("—")).otherwise(out)


# --- search tokens -----------------------------------------------------------------


def search_fold(text: Column) -> Column:
    """Lower-case text without non-spacing marks, for indexing and queries."""
    accents, bare = _accent_table("Mn")
    return F.lower(F.translate(text, accents, bare))


def search_tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(search_fold(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


# --- question language -----------------------------------------------------------


def detect_language(
    text: Column,
    greeklish_markers=vocab.GREEKLISH_MARKERS,
    english_markers=vocab.ENGLISH_MARKERS,
) -> Column:
    """``el`` for Greek script, else ``greeklish`` when its markers outnumber English."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z\\u0370-\\u03ff\\u1f00-\\u1fff]+"), F.lit(0))

    def hits(markers):
        return F.size(F.filter(words, lambda w: w.isin(*markers)))

    return (
        F.when(has_greek(text), F.lit("el"))
        .when(hits(greeklish_markers) > hits(english_markers), F.lit("greeklish"))
        .otherwise(F.lit("en"))
    )


def transliterate_greeklish(text: Column) -> Column:
    """Latin-typed Greek to Greek letters: digraphs first, left to right, one pass."""
    table = {**vocab.GREEKLISH_LETTERS, **vocab.GREEKLISH_DIGRAPHS}
    pieces = F.regexp_extract_all(
        F.lower(text), F.lit("(?s)" + "|".join(vocab.GREEKLISH_DIGRAPHS) + "|."), F.lit(0)
    )
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    spelled = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(lookup, p), p)), "")
    return F.regexp_replace(spelled, "(?U)σ(?![\\w])", "ς")


def normalise_question(text: Column, language: Column) -> Column:
    return F.when(language == "greeklish", transliterate_greeklish(text)).otherwise(text)


def output_language(language: Column) -> Column:
    """Answers are written in Greek for Greek and Latin-typed Greek questions."""
    return F.when(language.isin("el", "greeklish"), F.lit("el")).otherwise(F.lit("en"))
