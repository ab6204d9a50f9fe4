"""The bytes of data addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ADDRESS = r"(?is)^\s*data:([^,;]*)((?:;[^,;]*)*),(.*?)\s*$"


def percent_decoded(text: Column) -> Column:
    """The bytes of a percent-encoded text: a plus stays one, and so does a percent sign that no two hex digits follow."""
    whole = lambda p: F.concat(F.substring(p, 1, 2), F.hex(F.encode(F.substring(p, F.lit(3), F.length(p)), "UTF-8")))
    piece = lambda p, i: F.when(i == 0, F.hex(F.encode(p, "UTF-8"))).when(p.rlike("^[0-9A-Fa-f]{2}"), whole(p)).otherwise(F.concat(F.lit("25"), F.hex(F.encode(p, "UTF-8"))))
    return F.unhex(F.array_join(F.transform(F.split(text, "%", -1), piece), ""))


def data_bytes(address: Column) -> Column:
    """The bytes of a data address of either kind; null if it is none, or its base64 isn't valid.

    White space isn't part of base64, nor are characters outside its alphabet; if nothing is left of a payload, it isn't valid.
    """
    params, payload = F.lower(F.regexp_extract(address, _ADDRESS, 2)), F.regexp_extract(address, _ADDRESS, 3)
    letters = F.regexp_replace(F.regexp_replace(payload, r"[^A-Za-z0-9+/=]+", ""), "=+$", "")
    padded = F.rpad(letters, (F.ceil(F.length(letters) / 4) * 4).cast("int"), "=")
    binary = F.when(F.length(letters) % 4 != 1, F.try_to_binary(padded, F.lit("base64")))
    binary = F.when((letters == "") & (F.regexp_replace(payload, r"\s+", "") != ""), F.lit(None)).otherwise(binary)
    return F.when(address.rlike(_ADDRESS), F.when(params.contains("base64"), binary).otherwise(percent_decoded(payload)))


def data_addresses(page: Column) -> Column:
    """The data addresses of a page's src attributes, in order."""
    found = F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"""(?is)\bsrc\s*=\s*(?:"(\s*data:[^"]*+)"|'(\s*data:[^']*+)')"""), 0)
    return F.transform(found, lambda x: F.regexp_replace(x, r"""(?is)^src\s*=\s*["']|["']$""", ""))
