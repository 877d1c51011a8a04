"""Text functions (F1-F3) as JVM-side column expressions.

All three run inside whole-stage codegen: no Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: tokeniser character classes -----------------------------
# Word tokens for embeddings: runs of letters, letter-numbers, other numbers
# and underscore (decimal digits split words), lower-cased, kept when
# 2 to 15 characters long and not starting with an underscore.
WORD_RUN = r"([\p{L}\p{Nl}\p{No}_]+)"
MIN_TOKEN_LEN = 2
MAX_TOKEN_LEN = 15
# Bag-of-words tokens: runs of two or more word characters.
BOW_RUN = r"([\p{L}\p{N}_]{2,})"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_tokens(text: Column | str) -> Column:
    """array<string> of embedding tokens of ``text`` (NULL text -> [])."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(WORD_RUN), 1)
    return F.filter(
        runs,
        lambda t: (F.length(t) >= MIN_TOKEN_LEN)
        & (F.length(t) <= MAX_TOKEN_LEN)
        & ~t.startswith("_"),
    )


def bow_tokens(text: Column | str) -> Column:
    """array<string> of bag-of-words tokens (lower-cased, >= 2 chars)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(BOW_RUN), 1)


# --- fixed values: tweet normaliser rules, in order -------------------------
# (pattern, replacement); Java regex syntax, (?U) makes \w, \d and \b
# Unicode-aware as in the original rules.
_EYES = r"[8:=;]"
_NOSE = r"['`\-]?"
TWEET_RULES_BEFORE_HASHTAG = [
    (r"(?U)https?:\/\/\S+\b|www\.(\w+\.)+\S*", "<url>"),
    (r"(?U)@\w+", "<user>"),
    (rf"{_EYES}{_NOSE}[)dD]+|[)dD]+{_NOSE}{_EYES}", "<smile>"),
    (rf"{_EYES}{_NOSE}p+", "<lolface>"),
    (rf"{_EYES}{_NOSE}\(+|\)+{_NOSE}{_EYES}", "<sadface>"),
    (rf"{_EYES}{_NOSE}[\/|l*]", "<neutralface>"),
    (r"/", " / "),
    (r"<3", "<heart>"),
    (r"(?U)[-+]?[.\d]*[\d]+[:,.\d]*", "<number>"),
]
TWEET_RULES_AFTER_HASHTAG = [
    (r"([!?.]){2,}", "$1 <repeat>"),
    (r"(?Us)\b(\S*?)(.)\2{2,}\b", "$1$2 <elong>"),
    (r"([A-Z]){2,}", "$0 <allcaps>"),
]
# Splits text into alternating runs of whitespace and non-whitespace.
_WS_BOUNDARY = r"(?U)(?<=\s)(?=\S)|(?<=\S)(?=\s)"


def normalise_tweet(text: Column | str) -> Column:
    """the 14-rule tweet normaliser as a chain of regexp_replace.

    Rule 10 (hashtags) needs a callback in a scripting language; here the
    text is cut into whitespace / non-whitespace runs and each run that
    holds '#' followed by at least one character is rewritten from its first
    '#': an all-capitals body becomes `` body `` in lower case, any other
    body becomes ``<hashtag> `` followed by the body with a space inserted
    before every capital letter.
    """
    t = F.coalesce(_col(text), F.lit(""))
    for pat, rep in TWEET_RULES_BEFORE_HASHTAG:
        t = F.regexp_replace(t, pat, rep)

    def rewrite(piece: Column) -> Column:
        pos = F.instr(piece, "#")
        head = F.substring(piece, F.lit(1), pos - 1)
        body = F.substring(piece, pos + 1, F.lit(1 << 30))
        has_cased = F.upper(body) != F.lower(body)
        all_caps = (body == F.upper(body)) & has_cased
        replaced = F.when(all_caps, F.concat(F.lit(" "), F.lower(body), F.lit(" "))).otherwise(
            F.concat(F.lit("<hashtag> "), F.regexp_replace(body, "([A-Z])", " $1"))
        )
        return F.when((pos > 0) & (F.length(body) > 0), F.concat(head, replaced)).otherwise(piece)

    pieces = F.split(t, _WS_BOUNDARY)
    t = F.when(F.instr(t, "#") > 0, F.array_join(F.transform(pieces, rewrite), "")).otherwise(t)
    for pat, rep in TWEET_RULES_AFTER_HASHTAG:
        t = F.regexp_replace(t, pat, rep)
    return F.lower(t)
