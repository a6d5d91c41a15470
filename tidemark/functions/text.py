"""Text expressions: whole-word patterns, abbreviation expansion, cleaning, n-grams.

A word character is a letter or number of any script, or an underscore. The
patterns spell that out instead of using ``\\b`` because the meaning of ``\\b``
for accented letters depends on the Java version.
"""

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_CHAR = r"[\p{L}\p{N}_]"

# The characters a Unicode-aware strip removes.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _quoted(phrase: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", phrase)


def whole_word(phrase: str) -> str:
    """Java pattern for ``phrase`` standing alone.

    The literal comes first and the look-behind checks what stood before it,
    so the matcher skips along literals instead of testing every position.
    """
    p = _quoted(phrase)
    return f"{p}(?<!{WORD_CHAR}{p})(?!{WORD_CHAR})"


def any_whole_word(phrases) -> str:
    """Case-insensitive Java pattern: one of the phrases standing alone."""
    return f"(?iu)(?<!{WORD_CHAR})(?:{'|'.join(map(_quoted, phrases))})(?!{WORD_CHAR})"


# The characters besides A-Z that "any case" takes for one of a-z and ``lower`` does not turn into it.
FOLDED = "\u0130\u0131\u017f\u212a"


def has_whole_word(text: Column, phrases) -> Column:
    """Whether one of the phrases stands alone in ``text``, any case.

    A plain search for the phrases comes first, as it is far cheaper than the
    pattern and most texts have none of them. It lets pass whatever could match.
    """
    found = text.rlike(any_whole_word(phrases))
    if not all(p.isascii() for p in phrases):
        return found
    near = [F.lower(text).contains(p.lower()) for p in phrases] + [text.contains(c) for c in FOLDED]
    return reduce(lambda a, b: a | b, near) & found


# as the look-behind of ``whole_word`` sees them, characters beyond 16 bits are no word characters
NARROW_WORD = r"[\p{L}\p{N}_&&[\x{0}-\x{FFFF}]]+"


def expand_abbreviations(text: Column, pairs) -> Column:
    """Lower case, replace whole words in the order of ``pairs``, strip.

    The words of a text are looked up once, and only those pairs run that can
    change it: the short form is one of its words or of an earlier pair's long
    form, or holds other characters than word characters. A pair that maps a
    word to itself cannot change lower-cased text and is left out.
    """
    chain = [(short, long) for short, long in pairs if short != long]
    lowered, shorts = F.lower(text), [short for short, _ in chain]
    if len(set(shorts)) < len(shorts) or not chain:
        return strip(reduce(lambda acc, pair: F.regexp_replace(acc, whole_word(pair[0]), pair[1]), chain, lowered))
    always = [s for i, s in enumerate(shorts) if not re.fullmatch(r"[a-z0-9]+", s) or any(s in long for _, long in chain[:i])]
    own = F.regexp_extract_all(lowered, F.lit(NARROW_WORD), F.lit(0))
    # in the order of the first array
    used = F.array_intersect(F.array(*map(F.lit, shorts)), F.concat(own, F.array(*map(F.lit, always)).cast("array<string>")))
    patterns = F.create_map(*[F.lit(x) for s in shorts for x in (s, whole_word(s))])
    longs = F.create_map(*[F.lit(x) for pair in chain for x in pair])
    return strip(F.aggregate(used, lowered, lambda acc, s: F.regexp_replace(acc, patterns[s], longs[s])))


def default_text(text: Column, default: str = "unknown") -> Column:
    """Stripped text, or ``default`` for null and blank."""
    return F.coalesce(F.nullif(strip(text), F.lit("")), F.lit(default))


DEID_PATTERNS = (r"_{2,}",)


def clean_deid(text: Column, patterns=DEID_PATTERNS) -> Column:
    """Remove masking tokens, squeeze blanks, strip; may come out empty."""
    bare = reduce(lambda acc, p: F.regexp_replace(acc, p, " "), patterns, text)
    return strip(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def prepare_text(text: Column, default: str = "unknown", patterns=DEID_PATTERNS) -> Column:
    """Default for blanks, then masking tokens out, then default again."""
    return default_text(clean_deid(default_text(text, default), patterns), default)


def clean_keywords(joined: Column, patterns=DEID_PATTERNS, default: str = "general") -> Column:
    """Clean every entry of a ``", "``-joined list; entries that empty go, an empty list is ``default``."""
    words = F.transform(F.split(joined, ","), lambda w: clean_deid(w, patterns))
    kept = F.array_join(F.filter(words, lambda w: w != ""), ", ")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(default))


def words(text: Column) -> Column:
    """Lower-cased words of two or more characters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_CHAR + "{2,}"), F.lit(0))


def without(tokens: Column, stop_words) -> Column:
    """Drop stop words from a token array; the list is a bounded literal."""
    stop = list(stop_words)
    return F.filter(tokens, lambda t: ~t.isin(stop)) if stop else tokens


def ngrams(tokens: Column, longest: int = 3) -> Column:
    """All runs of 1 to ``longest`` tokens joined by a blank.

    ``tokens`` should be a stored column: the expression names it several times.
    Runs grow by pairing them with the tokens further on; a run that would pass
    the end is null there and leaves.
    """
    parts, runs = [tokens], tokens
    for n in range(2, longest + 1):
        later = F.slice(tokens, n, F.size(tokens))
        runs = F.zip_with(runs, later, lambda run, t: F.concat(run, F.lit(" "), t))
        parts.append(F.array_compact(runs))
    return F.concat(*parts)
