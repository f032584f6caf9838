"""String, number and date expressions."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(name: Column) -> Column:
    """Lower case, letters and digits of any script only."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def missing_to(value: Column, default: str) -> Column:
    """Null and the empty string both count as missing."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def _scaled(value: Column, places: int) -> Column:
    """The integer that is nearest to value * 10^places, as a double: the value's exact binary one, ties
    to even. Exact where that integer has at most 38 bits.

    The value is split into two halves of few bits, whose products with a small power of ten are exact;
    what their sum loses decides where it looks like a tie."""
    ten, split = float(10**places), value * 134217729.0
    high = split - (split - value)
    a, b = high * ten, (value - high) * ten
    total = a + b
    lost = (a - total) + b
    near = F.rint(total)
    off = total - near
    return near + F.when((off == 0.5) & (lost > 0), 1.0).when((off == -0.5) & (lost < 0), -1.0).otherwise(0.0)


def rounded(value: Column, places: int) -> Column:
    """A double rounded to so many decimal places, by its exact binary value, ties to even. Values of
    2^38 / 10^places and more, infinite ones and those that are no number stay as they are."""
    small = F.abs(value) < float(2**38 // 10**places)
    return F.when(small, _scaled(value, places) / float(10**places)).otherwise(value)


def percent(share: Column, places: int = 1) -> Column:
    """A share as percent with so many places, by the exact binary value of share * 100, ties to even."""
    scaled, ten = _scaled(share * 100.0, places), 10**places
    whole = F.abs(scaled).cast("long")
    sign = F.when(share.cast("string").startswith("-"), "-").otherwise("")  # of a negative zero, too
    behind = F.concat(F.lit("."), F.lpad((whole % ten).cast("string"), places, "0")) if places else F.lit("")
    return F.concat(sign, ((whole - whole % ten) / ten).cast("long").cast("string"), behind, F.lit("%"))


def integer_percent(share: Column) -> Column:
    """Nearest whole percent, halves upwards."""
    return F.floor(share * 100 + 0.5).cast("int")


def decimal_comma(value: Column, places: int = 4) -> Column:
    """Rounded number with a decimal comma, without trailing zeros but for one; null gives ""."""
    text = F.format_string(f"%.{places}f", rounded(value, places))
    short = F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", ".0")
    return F.when(value.isNull(), "").otherwise(F.replace(short, F.lit("."), F.lit(",")))


def detail_line(*parts: Column) -> Column:
    """Parts that say something, apart by a middle dot."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & ~x.isin("", "—")), " · ")


def clamped_percent(share: Column, places: int = 2) -> Column:
    """Percent of a share that counts as 1 at most."""
    return percent(F.least(share, F.lit(1.0)), places)


def padded(value: Column, width: int) -> Column:
    """Left-aligned in a column of so many characters; longer text stays whole."""
    return F.format_string(f"%-{width}s", value)


def is_image_type(mime: Column) -> Column:
    """Whether a MIME type is PNG or JPEG, in any case."""
    return mime.rlike(r"(?i)^image/(png|jpe?g)$")


def first_line(value: Column) -> Column:
    return F.substring_index(value, "\n", 1)


def file_size(size: Column) -> Column:
    """Whole and tenth kilobytes, rounded down."""
    return F.format_string("%.1f KB", F.floor(size * 10 / 1024) / 10)


def model_version(architecture: Column, catalogue: Column, placeholder: str) -> Column:
    """"architecture vX"; blanks around the name don't count, and blank or the placeholder is unknown."""
    known = F.nullif(F.nullif(F.trim(architecture), F.lit("")), F.lit(placeholder))
    return F.concat(F.coalesce(known, F.lit("desconhecida")), F.lit(" v"), catalogue.cast("string"))


def html_escape(value: Column, apostrophe: str = "&#x27;") -> Column:
    """Pages made by the server and by the browser's script write an apostrophe in two ways."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", apostrophe)):
        value = F.replace(value, F.lit(char), F.lit(entity))
    return value


def now_iso() -> str:
    """Local time to the second."""
    return datetime.datetime.now().isoformat(timespec="seconds")


def human_date(iso: Column) -> Column:
    """dd/mm/yyyy às HH:MM; text that is no date stays as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(iso), "dd/MM/yyyy 'às' HH:mm"), iso)


def file_suffix(path: Column) -> Column:
    """From the last dot of the name on, in lower case; "" if there is none or the name begins with it."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def base64_text(content: Column) -> Column:
    """Base64 on one line."""
    return F.regexp_replace(F.base64(content), r"\s", "")
