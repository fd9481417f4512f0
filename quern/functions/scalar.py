"""Scalar functions as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK48 = (1 << 48) - 1
MULTIPLIER = 0x5DEECE66D  # fixed value of java.util.Random


def substr(c: Column, start: int, length: int) -> Column:
    """SQL substring: 1-based."""
    return F.substring(c, start, length)


def java_hash(word: Column) -> Column:
    """String.hashCode of Java, as a signed number. Java's characters are UTF-16 units, two for those beyond the basic plane."""
    # ascii() has the code point of the first character
    codes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))

    def add(a: Column, c: Column) -> Column:
        high, low = F.shiftright(c - 0x10000, 10) + 0xD800, (c - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00
        return F.when(c > 0xFFFF, (a * 31 + high) * 31 + low).otherwise(a * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF))

    return _signed(F.aggregate(codes, F.lit(0).cast("long"), add))


def _signed(h: Column) -> Column:
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


def code_point_hash(word: Column) -> Column:
    """As ``java_hash`` over code points: another number for words with characters beyond the basic plane."""
    codes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return _signed(F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF))))


def random_seed(h: Column) -> Column:
    """State of java.util.Random after its seed is set."""
    return h.bitwiseXOR(F.lit(MULTIPLIER)).bitwiseAND(F.lit(MASK48))


def random_next(s: Column) -> Column:
    """Next state, in two halves so that no product leaves 64 bits."""
    high = F.shiftright(s, 24) * F.lit(MULTIPLIER)
    low = s.bitwiseAND(F.lit((1 << 24) - 1)) * F.lit(MULTIPLIER)
    return (F.shiftleft(high.bitwiseAND(F.lit((1 << 24) - 1)), 24) + low + 11).bitwiseAND(F.lit(MASK48))


def random_accepted(s: Column, w: int) -> Column:
    """The state from which nextInt(w) takes its number: where w is not a power of two, Java draws again in about w of 2**31 cases.

    Two draws more are looked at; to need a third has a chance of about (w / 2**31)**3."""
    for _ in range(2 if w & (w - 1) else 0):
        bits = F.shiftright(s, 17)
        s = F.when(bits - bits % w + (w - 1) >= 1 << 31, random_next(s)).otherwise(s)
    return s


def random_below(s: Column, w: int) -> Column:
    """nextInt(w) for an accepted state."""
    bits = F.shiftright(s, 17)
    return (F.shiftright(bits * w, 31) if w & (w - 1) == 0 else bits % w).cast("int")


def restore_url(c: Column) -> Column:
    """``com.example.www:http/a/b`` to ``http://www.example.com/a/b``; other than two parts at ``:`` to an empty text."""
    parts = F.split(c, ":")
    host = F.array_join(F.reverse(F.split(parts[0], r"\.")), ".")
    scheme, path = F.substring_index(F.get(parts, F.lit(1)), "/", 1), F.regexp_extract(F.get(parts, F.lit(1)), "^[^/]*(/.*)?$", 1)
    return F.when(F.size(parts) != 2, F.lit("")).otherwise(F.concat(scheme, F.lit("://"), host, path))


def reverse_url(c: Column) -> Column:
    """The reverse of ``restore_url``, for http and https addresses without a port."""
    host = F.regexp_extract(c, "^[a-z]+://([^/:]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(":"), F.regexp_extract(c, "^([a-z]+)://", 1), F.regexp_extract(c, "^[a-z]+://[^/]*(/.*)?$", 1))


def millis_text(c: Column) -> Column:
    """Milliseconds since 1970 as ``MM/dd/yyyy HH:mm:ss`` in the session's time zone."""
    return F.date_format(F.timestamp_millis(c.cast("long")), "MM/dd/yyyy HH:mm:ss")


def restore_columns(df: DataFrame) -> DataFrame:
    """Columns whose names end in ``uri`` or ``fqdnurl`` restored as addresses, in ``ts`` shown as dates; dates that do not parse stay, addresses become an empty text."""
    out = []
    for c in df.columns:
        name = c.lower()
        if name.endswith(("uri", "fqdnurl")):
            new = restore_url(F.col(c))
            out.append(F.coalesce(new, F.col(c)).alias(c))
        elif name.endswith("ts"):
            text = F.col(c).cast("string")
            out.append(F.coalesce(millis_text(text.try_cast("long")), text).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def json_field(c: Column, path: str, kind: str) -> Column:
    return F.get_json_object(c, path).try_cast(kind)


def merge_counts(a: Column, b: Column) -> Column:
    """Two maps of counts added key by key."""
    zero = F.lit(0.0)
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


#: Fields of crawled pages and the columns they become.
PAGE_COLUMNS = {"key": "url", "content": "body", "headers": "headers", "fetchInterval": "responseTime", "contentType": "charset", "outlinks": "links", "fetchTime": "published"}


def map_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)
