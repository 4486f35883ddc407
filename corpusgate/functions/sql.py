"""The text functions for users of SQL: temporary functions that Catalyst inlines.

After `register(spark)`, `SELECT plain_text(html) FROM pages` is the same plan as the column
function: each function is one SQL expression, so filters, pruning and generated code work
through it. Names can be given a prefix.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from corpusgate.functions import text as T
from corpusgate.functions.base import WS, WS_CHARS


_TEXT = "coalesce(c, '')"     # missing text is blank text


def quoted(s: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sub(expr: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({expr}, {quoted(pattern)}, {quoted(replacement)})"


def _strip(expr: str) -> str:
    return f"btrim({expr}, {quoted(WS_CHARS)})"


def _plain(answer: str) -> str:
    out = _sub(_sub(_sub(_TEXT, T.CLOZE_ANSWER, answer), rf"<br{WS}*/?>", " . "),
               T.TAG, " ")
    for entity, char in T.ENTITIES:
        out = f"replace({out}, {quoted(entity)}, {quoted(char)})"
    return f"trim({_sub(out, WS + '+', ' ')})"


def _compact() -> str:
    out = f"replace({_TEXT}, '&nbsp;', ' ')"
    mark = T.NEWLINE_MARK
    for pattern, replacement in ((T.PRESENTATION, ""), (T.LINE_BREAK, mark), (T.LINE_END, mark),
                                 (T.LIST_ITEM, mark + "- "), (T.LAYOUT, ""), (T.TAG, ""),
                                 (r"[ \t]+", " "), (rf"(?:{mark}{WS}*){{3,}}", mark * 2)):
        out = _sub(out, pattern, replacement)
    return _strip(out)


_SORT = _strip(_sub(_sub(_TEXT, T.SOUND), T.TAG))
_SENTENCES = (f"filter(transform(split({_TEXT}, {quoted(T.SENTENCE_BREAK)}), "
              f"s -> {_strip('s')}), s -> s <> '')")

#: name -> (parameters, type of the result, expression)
FUNCTIONS = {
    "is_blank": ("c STRING", "BOOLEAN", f"{_strip(_TEXT)} = ''"),
    "strip_tags": ("c STRING, by STRING", "STRING",
                   f"regexp_replace({_TEXT}, {quoted(T.TAG)}, by)"),
    "plain_text": ("c STRING", "STRING", _plain("$1")),
    "marked_text": ("c STRING", "STRING", _plain("«$1»")),
    "compact_text": ("c STRING", "STRING", _compact()),
    "sort_field": ("c STRING", "STRING", _SORT),
    "checksum32": ("c STRING", "BIGINT",
                   f"cast(conv(substring(sha1(encode({_SORT}, 'UTF-8')), 1, 8), 16, 10) AS BIGINT)"),
    "sentence_list": ("c STRING", "ARRAY<STRING>", _SENTENCES),
    "has_semicolon": ("c STRING", "BOOLEAN", f"contains({_sub(_TEXT, T.ENTITY)}, ';')"),
    "normalize_extra": ("c STRING", "STRING",
                        f"CASE WHEN {_strip(_TEXT)} = '' THEN {_TEXT} ELSE concat(' ', ltrim("
                        f"{_sub('c', '^' + WS + '+')})) END"),
    # Names of decks and note types are equal whatever their case.
    "same_name": ("a STRING, b STRING", "BOOLEAN",
                  "a COLLATE UTF8_LCASE = b COLLATE UTF8_LCASE"),
}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create the functions in the session; gives their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) "
                  f"RETURNS {kind} RETURN {body}")
    return [prefix + name for name in FUNCTIONS]
