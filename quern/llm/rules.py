"""Quality rules, native: lines are judged first, then documents.

Each line is tested for symbols, shouting, navigation and boilerplate; failing lines go. A document is
rejected when its base counts fail or when too little of its text is left. Only SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases of page furniture, compared in lower case.
BOILERPLATE = (
    "all rights reserved|cookie policy|privacy policy|terms of use|terms of service|enable javascript|"
    "lorem ipsum|click here to|sign up for our newsletter|subscribe to our|powered by wordpress|skip to content|"
    "add to cart|back to top|page not found|"
    "tous droits réservés|politique de confidentialité|mentions légales|gestion des cookies|"
    "alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|zum inhalt springen|"
    "todos los derechos reservados|política de privacidad|aviso legal|política de cookies"
)
NAVIGATION = (
    "home|menu|login|log in|sign in|sign up|search|next|previous|share|tweet|print|contact us|about us|sitemap|faq|"
    "accueil|connexion|recherche|suivant|startseite|anmelden|suche|weiter|impressum|kontakt|inicio|buscar|siguiente|contacto"
)
CLOSING = "[.!?:;,)\\]}\"'»”’…。！？]"  # what a sentence may end with

MIN_WORDS = 20
MAX_REPEATED = 30  # hundredths of the words
MIN_LEFT = 50  # hundredths of the word characters that must be left
OPEN_WORDS = 6  # a line of so many words is prose, and ends with a closing mark
SPACE = "[ \\t-\\r]"  # as a pattern
BLANK = "\\u0020\\u0009\\u000a\\u000b\\u000c\\u000d"  # the same characters in a literal of Spark's SQL, which has no \\f


class Spark:
    """How Spark writes a pattern test and a literal."""

    @staticmethod
    def text(s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    @classmethod
    def matches(cls, x: str, pattern: str) -> str:
        return f"{x} RLIKE {cls.text(pattern)}"

    @classmethod
    def without(cls, x: str, pattern: str) -> str:
        return f"regexp_replace({x}, {cls.text(pattern)}, '')"


class Duck(Spark):
    """The same for DuckDB."""

    @staticmethod
    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    @classmethod
    def matches(cls, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {cls.text(pattern)})"

    @classmethod
    def without(cls, x: str, pattern: str) -> str:
        return f"regexp_replace({x}, {cls.text(pattern)}, '', 'g')"


def _phrases(x: str) -> str:
    return " OR ".join(f"contains({x}, '{p}')" for p in BOILERPLATE.split("|"))


def _line_ok(d: type[Spark] = Spark) -> str:
    """SQL over ``l``, a line: true if it stays. A line without words stays."""
    words = "(length(l) - length(replace(l, ' ', '')) + 1)"
    return f"""
        NOT {d.matches("l", "[^ \\t-\\r]")} OR NOT (
            -- symbols: more than three for ten words
            10 * length({d.without("l", "[^#*$%&|<>]+")}) > 3 * {words}
            -- punctuation: every other word is shouted, or prose that does not end
            OR 2 * (length(l) - length(replace(l, '!!', '!'))) > {words}
            OR ({words} >= {OPEN_WORDS} AND NOT {d.matches("l", CLOSING + SPACE + "*\\z")})
            -- navigation: a short line of menu words, a row of links, or every tenth word an address
            OR (length(l) < 80 AND {d.matches("lower(l)", f"^[ \\t]*(?:(?:{NAVIGATION})(?:[ \\t\\r|>/,-]+|\\z))+\\z")})
            OR length(l) - length(replace(l, ' | ', '  ')) >= 4
            OR (contains(l, '://') AND 10 * (length(l) - length(replace(l, '://', '//'))) > {words})
            -- boilerplate
            OR {_phrases("lower(l)")}
        )"""


def _suspect() -> str:
    """SQL over a text ``_t``, in lower case ``_lo``: whether any line can fail; most texts are settled here without a look at their lines."""
    tests = [
        "_symbols > 0",
        "contains(_t, '!!')",
        "contains(_t, '://')",
        _phrases("_lo"),
        Spark.matches("_lo", f"(?m)^[ \\t]*(?:{NAVIGATION})(?:[ \\t\\r|>/,-]|$)"),
        Spark.matches("_t", "[^ \\t-\\r" + CLOSING[1:] + SPACE + "*(?:\\n|\\z)"),
    ]
    return " OR ".join(tests)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` in ``_row``, with the counts, ``base_failed``, ``kept`` and ``cleaned`` (text of the kept lines)."""
    t = "_t"
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(t))
    df = df.selectExpr(
        "_row",
        t,
        f"trim(BOTH '{BLANK}' FROM {t}) AS _c",
        rf"split({t}, '\n') AS _l",
    )
    df = df.selectExpr("_row", t, "_l", f"CASE WHEN _c = '' THEN array() ELSE split(_c, {Spark.text(SPACE + '+')}) END AS _w")
    df = df.selectExpr(
        "_row",
        t,
        "_l",
        "size(_w) AS _n",
        f"length({Spark.without(t, SPACE + '+')}) AS _chars",
        f"length({Spark.without(t, '[^#*$%&|<>]+')}) AS _symbols",
        f"lower({t}) AS _lo",
        "transform(_w, w -> xxhash64(w)) AS _h1",
    )
    # hashes of windows of 2, 4 and 8 words, each from two of half the length
    for k in (1, 2, 4):
        kept = [c for c in df.columns if not c.startswith("_h")]
        df = df.selectExpr(*kept, f"CASE WHEN _n < 9 THEN array() ELSE zip_with(slice(_h{k}, 1, size(_h{k}) - {k}), slice(_h{k}, {k + 1}, size(_h{k})), (x, y) -> xxhash64(x, y)) END AS _h{2 * k}")
    df = df.selectExpr(
        "_row",
        t,
        "_n",
        "_chars",
        "_symbols",
        f"CASE WHEN {_suspect()} THEN array_join(filter(_l, l -> {_line_ok()}), '\n') ELSE {t} END AS cleaned",
        # equal lines need a look only where there are any
        r"""CASE WHEN size(array_distinct(_l)) = size(_l) THEN 0 ELSE
            size(filter(_l, l -> l RLIKE '[^ \\t-\\r]')) - size(array_distinct(filter(_l, l -> l RLIKE '[^ \\t-\\r]'))) END AS _dup""",
        # starts of windows that occur twice or more; sorting only where there are any
        """CASE WHEN size(array_distinct(_h8)) = size(_h8) THEN array()
           ELSE sort_array(transform(_h8, (x, i) -> struct(x AS x, i AS i))) END AS _s""",
    )
    df = df.selectExpr(
        "*",
        """CASE WHEN size(_s) = 0 THEN array() ELSE
           sort_array(transform(filter(_s, (p, j) -> (j > 0 AND get(_s, j - 1).x = p.x) OR (j < size(_s) - 1 AND get(_s, j + 1).x = p.x)), p -> p.i)) END AS _d""",
    )
    # a repeated window covers 8 words, less where the next one begins sooner
    df = df.selectExpr(
        "*",
        """CASE WHEN size(_d) = 0 THEN 0L ELSE
           aggregate(transform(_d, (s, j) -> least(8, coalesce(get(_d, j + 1), s + 8) - s)), 0L, (a, v) -> a + v) END AS _rep""",
        f"CASE WHEN cleaned = {t} THEN _chars ELSE length({Spark.without('cleaned', SPACE + '+')}) END AS _left",
    )
    base = f"_n < {MIN_WORDS} OR 100 * _rep > {MAX_REPEATED} * _n"
    out = {
        "cleaned": "cleaned",
        "n_words": "CAST(_n AS LONG)",
        "word_chars": "CAST(_chars AS LONG)",
        "n_symbols": "CAST(_symbols AS LONG)",
        "n_dup_lines": "CAST(_dup AS LONG)",
        "n_repeat_words": "_rep",
        "base_failed": base,
        "kept": f"NOT ({base}) AND 100 * CAST(_left AS LONG) >= {MIN_LEFT} * CAST(_chars AS LONG)",
        "left_chars": "CAST(_left AS LONG)",
    }
    # a generator of one row: a filter on the verdict stays above it, where below it would repeat all these expressions
    return df.selectExpr("_row", "inline(array(struct(" + ", ".join(f"{e} AS {name}" for name, e in out.items()) + ")))")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict for each row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, left_chars``.

    A null or wordless text has zeros and fails. Rows with equal or null ids each give a row; an empty
    table gives none; other columns do not matter. Windows are compared by 64-bit hashes within a text.
    """
    out = judge(docs, id_col, text_col)
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "left_chars"]
    return out.select(F.col("_row").getField(id_col).alias("doc_id"), *cols)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of ``docs`` with their own columns, failing lines taken out of the text; ``n_chars`` follows the text if there is one.

    A null or wordless text is not kept; each of several equal rows is; an empty table gives none; other columns pass as they are.
    """
    out = judge(docs, id_col, text_col).filter("kept")
    cols = [F.col("cleaned").alias(c) if c == text_col else F.length("cleaned").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("_row").getField(c).alias(c) for c in docs.columns]
    return out.select(*cols)


def quality_sql() -> str:
    """The same as ``quality`` for DuckDB, over ``documents``."""
    word = "[^ \\t-\\r]+"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
        by_line AS (
            SELECT doc_id, count(*) FILTER ({Duck.matches("l", word)}) - count(DISTINCT l) FILTER ({Duck.matches("l", word)}) AS n_dup_lines,
                   coalesce(sum(length({Duck.without("l", SPACE + "+")})) FILTER ({_line_ok(Duck)}), 0) AS left_chars
            FROM l GROUP BY doc_id),
        w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS w FROM d),
        begins AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8),
        windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS n FROM begins),
        again AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), i + 8) - i) AS covers FROM windows WHERE n > 1),
        rep AS (SELECT doc_id, sum(covers) AS n FROM again GROUP BY doc_id),
        c AS (
            SELECT doc_id, len(w) AS n_words, length({Duck.without("t", SPACE + "+")}) AS word_chars, length({Duck.without("t", "[^#*$%&|<>]+")}) AS n_symbols,
                   n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, left_chars
            FROM w JOIN by_line USING (doc_id) LEFT JOIN rep USING (doc_id)),
        b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM c)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
               CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
               NOT base_failed AND 100 * left_chars >= {MIN_LEFT} * word_chars AS kept, CAST(left_chars AS BIGINT) AS left_chars
        FROM b"""
