"""Native (JVM, codegen) text expressions: tokenizers, templates, n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# Default chat template of the instruction loader and the response terminator.
DEFAULT_PROMPT_TEMPLATE = "<|im_start|>user\n{instruction}<|im_end|>\n<|im_start|>assistant\n"
RESPONSE_SUFFIX = "<|im_end|>"
# Label value of masked (prompt) positions; padding value of labels.
IGNORE_INDEX = -100
# The characters Python's str.split() treats as whitespace (str.isspace):
# \t \n \v \f \r, U+001C-U+001F, space, U+0085, U+00A0, U+1680, U+2000-U+200A,
# U+2028, U+2029, U+202F, U+205F, U+3000.  Java's Character.isWhitespace
# (\p{javaWhitespace}) is that set minus U+00A0, U+2007, U+202F and U+0085,
# which are added back; this spelling is ~2x faster than listing the ranges.
PY_SPACE_CLASS = r"\p{javaWhitespace}\u00A0\u2007\u202F\u0085"
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# Python whitespace restricted to ASCII: Java's \s (space \t \n \v \f \r) plus U+001C-U+001F.
PY_SPACE_ASCII_CLASS = r"\s\x1C-\x1F"


def whitespace_tokens(col) -> Column:
    """``text.strip().split()``: maximal runs of characters that are not
    Python whitespace (Unicode-aware, same set as ``str.isspace``); "" -> [].

    A text whose UTF-8 byte length equals its character length is pure
    ASCII; its whitespace can only be ASCII, so a cheaper ASCII class gives
    the same tokens (~25% faster on the test corpora).  Other texts use the
    full class."""
    c = _c(col)
    full = F.regexp_extract_all(c, F.lit(f"[^{PY_SPACE_CLASS}]+"), 0)
    ascii_only = F.regexp_extract_all(c, F.lit(f"[^{PY_SPACE_ASCII_CLASS}]+"), 0)
    return F.when(F.octet_length(c) == F.length(c), ascii_only).otherwise(full)


def word_tokens(col) -> Column:
    """Lower-cased alphanumeric tokens (the ROUGE library tokenizer)."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit("[a-z0-9]+"), 0)


# The "13a" BLEU tokenizer rules, applied in this order to
# " " + line + " " after the line-level replacements below.
BLEU_13A_LINE_REPLACEMENTS = [("<skipped>", ""), ("-\n", ""), ("\n", " "),
                              ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
BLEU_13A_RULES = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" $1 "),
    (r"([^0-9])([\.,])", r"$1 $2 "),
    (r"([\.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
]


def bleu_tokens(col) -> Column:
    """Tokens of the standard "13a" BLEU tokenizer, natively."""
    s = _c(col)
    for old, new in BLEU_13A_LINE_REPLACEMENTS:
        s = F.replace(s, F.lit(old), F.lit(new))
    s = F.concat(F.lit(" "), s, F.lit(" "))
    for pattern, repl in BLEU_13A_RULES:
        s = F.regexp_replace(s, pattern, repl)
    return F.regexp_extract_all(s, F.lit(r"\S+"), 0)


def ngrams(tokens, n: int) -> Column:
    """All contiguous n-grams of a token array, each joined by one space.

    Order k is built from order k-1 with one ``zip_with`` against the array
    shifted by k-1 (no per-n-gram slice).  Tokens never contain whitespace, so
    the join is injective.  Arrays shorter than ``n`` give ``[]``.
    """
    t = _c(tokens)
    g = t
    for k in range(2, n + 1):
        g = F.zip_with(g, F.slice(t, k, F.greatest(F.size(t) - k + 1, F.lit(0))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.slice(g, 1, F.greatest(F.size(t) - n + 1, F.lit(0)))


def render_template(col, template: str = DEFAULT_PROMPT_TEMPLATE,
                    field: str = "instruction") -> Column:
    """``template.format(instruction=col)`` as a native concat.

    The template is split on the field marker on the driver; ``{{``/``}}``
    escapes are undone in the literal pieces, exactly as ``str.format`` does,
    and the inserted text is never interpreted (``$``, ``\\``, braces stay).
    """
    marker = "{" + field + "}"
    pieces = template.split(marker)
    for p in pieces:
        probe = p.replace("{{", "").replace("}}", "")
        if "{" in probe or "}" in probe:
            raise ValueError(f"template has fields other than {marker!r}: {template!r}")
    parts = []
    for i, p in enumerate(pieces):
        if i:
            parts.append(_c(col))
        lit = p.replace("{{", "{").replace("}}", "}")
        if lit:
            parts.append(F.lit(lit))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def append_suffix(col, suffix: str = RESPONSE_SUFFIX) -> Column:
    return F.concat(_c(col), F.lit(suffix))
