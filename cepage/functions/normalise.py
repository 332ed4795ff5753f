"""Canonical forms of identifiers, hashes, labels and paths, as column expressions.

All functions take and return columns, run in the JVM, and map null to null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as outer blanks.
BLANKS = " \t\n\r\x0b\x0c\u00a0\u200b\ufeff"
# Spellings of the three splits.
SPLITS = {
    "train": ("train", "training"),
    "validation": ("validation", "valid", "val", "dev"),
    "test": ("test", "testing"),
}


def stripped(c: Column) -> Column:
    """``c`` without outer blanks of any kind."""
    return F.trim(c, F.lit(BLANKS))


def folded(c: Column) -> Column:
    """Lower case without outer blanks; null for blank text."""
    t = F.lower(stripped(c))
    return F.when(t != "", t)


def uuid_text(c: Column) -> Column:
    """Canonical UUID: lower case, hyphens, nothing around it.

    Accepts braces, a urn:uuid: prefix, missing hyphens, any case and outer blanks. Blank is null, also within
    braces or after the prefix. Text that is no UUID names something all the same and is returned folded.
    """
    t = folded(c)
    h = stripped(F.replace(F.translate(t, "{}()-", ""), F.lit("urn:uuid:"), F.lit("")))
    canonical = F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when(h.rlike("^[0-9a-f]{32}$"), canonical).when(h != "", t)


def hash64(c: Column) -> Column:
    """64-bit hexadecimal text as a two's complement bigint; null if blank or unreadable.

    Accepts any case, a 0x prefix, outer blanks, and dropped or added leading zeros.
    """
    t = F.regexp_replace(folded(c), "^0x", "")
    digits = F.when(t.rlike("^0*[0-9a-f]{1,16}$"), F.right(F.concat(F.lit("0" * 16), t), F.lit(16)))
    return F.conv(digits, 16, -10).cast("bigint")


def hex64(c: Column) -> Column:
    """A bigint as sixteen hexadecimal digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def digest256(c: Column) -> Column:
    """256-bit hexadecimal digest in lower case; null if blank or unreadable; a sha256: prefix is dropped."""
    t = F.regexp_replace(folded(c), "^(sha256:|0x)", "")
    return F.when(t.rlike("^[0-9a-f]{64}$"), t)


def split_name(c: Column) -> Column:
    """train, validation or test; null for blank or unknown text."""
    t = folded(c)
    out = F.lit(None).cast("string")
    for name, spellings in SPLITS.items():
        out = F.when(t.isin(*spellings), name).otherwise(out)
    return out


def label(c: Column) -> Column:
    """Class label: lower case, underscores and hyphens as blanks, single inner blanks; null for blank text."""
    return folded(F.regexp_replace(F.translate(c, "_-", "  "), r"\s+", " "))


def is_held(status: Column) -> Column:
    """Whether a validation_status keeps its record: anything but "deleted", null included."""
    return F.coalesce(folded(status) != "deleted", F.lit(True))


def file_path(c: Column) -> Column:
    """The place under the data root that a relative path leads to.

    Outer blanks are dropped, escapes decoded once, backslashes are separators, empty and "." segments
    vanish and ".." takes the segment before it (at the root it stays). Letter case is kept. Null for null
    and for paths that lead to the root itself.
    """
    t = stripped(c)
    decoded = F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t)
    t = stripped(F.translate(F.when(t.contains("%"), decoded).otherwise(t), "\\", "/"))
    up = F.lit("..")
    steps = F.filter(F.split(t, "/"), lambda s: ~s.isin("", "."))
    folded_steps = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda a, s: F.when((s == up) & (F.size(a) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), a), -1) != up), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))
        .otherwise(F.concat(a, F.array(s))),
    )
    out = F.when(t.rlike(r"(^|/)\.{0,2}(/|$)"), F.array_join(folded_steps, "/")).otherwise(t)
    return F.when(out != "", out)
