"""String and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK_32 = (1 << 32) - 1
FNV_START, FNV_FACTOR = 2166136261, 16777619
# Names of features without homes, and the form of a numbered path.
NON_RESIDENTIAL = r"(?i)footpath|bridleway|cycleway|cycle\s?path|\btrack\b|\bservices?\b|drive.?through|access point|viaduct|culvert|footbridge|\bbyway\b"
NUMBERED = r"\s\d{1,4}$"


def norm_key(s: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


def slug(s: Column) -> Column:
    """Lower case, other runs as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-|-$", "")


def base_name(s: Column) -> Column:
    """A road's name without what its last split added."""
    return F.regexp_replace(s, r"^(.*) \(part .*$", "$1")


def leading_int(s: Column) -> Column:
    """The integer a cell begins with; 0 if it is absent or does not begin with one."""
    return F.coalesce(F.regexp_extract(F.coalesce(s, F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def letters_id(n: Column) -> Column:
    """0, 1, … as A … Z, AA, AB, … of any length."""

    def step(acc: Column, _: Column) -> Column:
        rest, more = acc["rest"], acc["rest"] >= 0
        ids = F.when(more, F.concat(F.char(65 + rest % 26), acc["id"])).otherwise(acc["id"])
        return F.struct(F.when(more, F.call_function("div", rest, F.lit(26)) - 1).otherwise(rest).cast("long").alias("rest"), ids.alias("id"))

    # 14 letters hold every long
    start = F.struct(n.cast("long").alias("rest"), F.lit("").alias("id"))
    return F.when(n.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda acc: acc["id"]))


def fingerprint(s: Column) -> Column:
    """FNV-1a, 32 bits, over UTF-16 code units, as eight hexadecimal digits."""
    units = F.flatten(F.transform(F.split(s, ""), _units))
    folded = F.aggregate(units, F.lit(FNV_START).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_FACTOR).cast("long")).bitwiseAND(F.lit(MASK_32).cast("long")))
    return F.lpad(F.lower(F.hex(folded)), 8, "0")


def _units(char: Column) -> Column:
    # the octets of UTF-16 tell the code units of characters beyond the basic plane
    wide = F.hex(F.encode(char, "UTF-16BE"))
    unit = lambda i: F.conv(F.substring(wide, i, 4), 16, 10).cast("long")
    return F.when(char == "", F.array().cast("array<long>")).when(F.length(wide) > 4, F.array(unit(1), unit(5))).otherwise(F.array(unit(1)))


def row_key(street: Column, ward: Column, geometry: Column) -> Column:
    """Identifies a road as long as its geometry stays: street, ward, fingerprint. Null where street or ward is."""
    return F.concat(street, F.lit("|"), ward, F.lit("|"), fingerprint(F.coalesce(geometry, F.lit(""))))


def non_residential(name: Column, residences: Column) -> Column:
    return name.rlike(NON_RESIDENTIAL) | (name.rlike(NUMBERED) & (residences <= 5))


def escaped(s: Column) -> Column:
    """Text for HTML."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(raw), F.lit(entity))
    return s
