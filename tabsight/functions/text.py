"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and the letters they fold to.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def unaccented(c: Column) -> Column:
    out = F.translate(c, ACCENTED, PLAIN)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fold(c: Column) -> Column:
    """Trimmed, lower case, without accents."""
    return F.lower(F.trim(unaccented(c)))


def is_number_text(c: Column) -> Column:
    """A number written with a decimal point, or with points for thousands and a decimal comma."""
    t = F.trim(c)
    plain = t.rlike(r"^-?[0-9]+(\.[0-9]+)?$")
    return plain | t.rlike(r"^-?[0-9]{1,3}(\.[0-9]{3})*,[0-9]+$") | t.rlike(r"^-?[0-9]+,[0-9]+$")


def number_of_text(c: Column) -> Column:
    t = F.trim(c)
    return F.when(is_number_text(c), F.when(F.contains(t, F.lit(",")), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(t).try_cast("double"))


def spelling_key(c: Column) -> Column:
    """What spellings of one value share: the number, else the folded letters and digits."""
    number = number_of_text(c)
    return F.when(number.isNotNull(), F.concat(F.lit("#"), F.round(number * 1000000).cast("decimal(38,0)").cast("string"))).otherwise(F.regexp_replace(F.lower(unaccented(c)), "[^0-9a-z]", ""))


def shape(c: Column) -> Column:
    """Digits as 9, upper case as A, lower case as a; at most 40 characters."""
    return F.translate(F.substring(c, 1, 40), DIGITS + UPPER + LOWER, "9" * 10 + "A" * 26 + "a" * 26)


def person_key(c: Column) -> Column:
    """Folded words of a name in alphabetic order."""
    words = F.filter(F.split(F.regexp_replace(fold(c), "[^0-9a-z]+", " "), " "), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def digits_only_differ(a: Column, b: Column) -> Column:
    return (F.regexp_replace(a, "[0-9]", "") == F.regexp_replace(b, "[0-9]", "")) & (a != b)


def mask_email(c: Column) -> Column:
    """The first character and the domain stay."""
    return F.concat(F.substring(c, 1, 1), F.lit("***@"), F.substring_index(c, "@", -1))


def mask_value(c: Column, keep: int = 2) -> Column:
    """The first ``keep`` letters or digits stay."""
    return F.concat(F.substring(F.regexp_replace(c, "[^0-9A-Za-z]", ""), 1, keep), F.lit("***"))


def mask_name(c: Column) -> Column:
    """The first letter of each word stays."""
    return F.regexp_replace(c, r"([A-Za-z])[A-Za-z]+", "$1***")


def redact(c: Column) -> Column:
    """E-mail addresses and document numbers replaced by their kind."""
    c = F.regexp_replace(c, r"[0-9A-Za-z_.+\-]+@[0-9A-Za-z_\-]+(\.[0-9A-Za-z_\-]+)+", "[E-mail]")
    c = F.regexp_replace(c, r"[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}", "[CNPJ]")
    return F.regexp_replace(c, r"[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}", "[CPF]")


def pseudonym(c: Column, key: str) -> Column:
    """HMAC-SHA256 of the value, in hex; built from sha2, so it stays in the JVM."""
    raw = key.encode()
    if len(raw) > 64:
        import hashlib

        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    inner, outer = bytes(x ^ 0x36 for x in raw), bytes(x ^ 0x5C for x in raw)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(c, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)
