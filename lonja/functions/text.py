"""Text hygiene and code parsing, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lonja.functions.stats import col

# These must equal the source data's conventions.
SERVICE_PREFIXES = ("ENVIO", "VOUCHER", "FLETE")
SERVICE_CODES = ("CGODIV", "comision_bancaria", "SUSTITUCION", "MISMODIA", "PRORELAY",
                 "LAPGPS", "MO", "ENVIOGRATIS", "ENVIOV")
HTML_ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"),
                 ("&nbsp;", " "), ("&amp;", "&"))
ACCENTS = ("áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN")


def is_service(codigo, extra: tuple[str, ...] = ()) -> Column:
    c = col(codigo)
    return c.isin(*SERVICE_CODES, *extra) | F.upper(c).rlike("^(" + "|".join(SERVICE_PREFIXES) + ")")


def clean_text(c) -> Column:
    """NULL -> '', zero-width and replacement characters out, entities decoded, trimmed."""
    out = F.coalesce(col(c).cast("string"), F.lit(""))
    out = F.regexp_replace(out, "[\u200b-\u200f\u2060\ufeff]|\u00e2\u20ac\u2039", "")
    for entity, char in HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(out)


def channel(concepto) -> Column:
    """linea / vendedor; the accent of 'linea' may be broken, projects are out of scope (NULL)."""
    c = F.lower(col(concepto))
    return (F.when(c.contains("royecto"), F.lit(None).cast("string"))
             .when(c.rlike("l.nea"), "linea").otherwise("vendedor"))


def norm_code(c) -> Column:
    """Upper case, letters and digits only."""
    return F.regexp_replace(F.upper(F.trim(col(c))), "[^A-Z0-9]", "")


def norm_brand(c, aliases: dict[str, str] | None = None, null_words: tuple[str, ...] = ()) -> Column:
    """Accents stripped, letters and digits only, placeholder words to NULL, aliases applied."""
    out = F.regexp_replace(F.upper(F.translate(col(c), *ACCENTS)), "[^A-Z0-9]", "")
    out = F.when((out == "") | out.isin(*null_words) if null_words else out == "", None).otherwise(out)
    if aliases:
        m = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        out = F.coalesce(m[out], out)
    return out


def split_pack(c) -> tuple[Column, Column]:
    """'BASE/2KM' -> ('BASE', 2.0): the reel of N units of a base code; NULL when not a reel."""
    pattern = r"(?i)^(.+)/(\d+(?:\.\d+)?)KM$"
    c = col(c)
    return (F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")),
            F.nullif(F.regexp_extract(c, pattern, 2), F.lit("")).cast("double"))
