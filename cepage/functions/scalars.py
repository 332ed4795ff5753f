"""Scalar functions as column expressions: identifiers, hashes, probabilities, predicates and schedules.

Null in gives null out unless a docstring says otherwise; all run in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5) of ``name`` under a namespace UUID."""
    raw = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(raw, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    text = F.concat_ws("-", F.substring(raw, 1, 8), F.substring(raw, 9, 4), F.concat(F.lit("5"), F.substring(raw, 14, 3)), F.concat(variant, F.substring(raw, 18, 3)), F.substring(raw, 21, 12))
    return F.when(name.isNotNull(), text)


def pair_id(namespace: str, a: Column, b: Column) -> Column:
    """Identifier of a pair, the same for either order of its ends; null if an end is null."""
    named = F.when(a.isNotNull() & b.isNotNull(), F.concat_ws(":", F.least(a, b), F.greatest(a, b)))
    return uuid5(namespace, named)


def group_id(namespace: str, members: Column) -> Column:
    """Identifier of a set of members (an array): the member itself if there is one, else of all in order."""
    ordered = F.array_sort(F.array_distinct(F.array_compact(members)))
    return F.when(F.size(ordered) == 1, F.element_at(ordered, 1)).when(F.size(ordered) > 1, uuid5(namespace, F.array_join(ordered, ":")))


def prefix_uuid(stem: Column) -> Column:
    """The UUID before three underscores at the start of a file stem, in lower case; null if there is none."""
    found = F.regexp_extract(stem, r"(?i)^([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})___", 1)
    return F.lower(F.when(found != "", found))


def short_id(text: Column, length: int = 20) -> Column:
    """First hexadecimal digits of the SHA-256 of a text."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, length)


def seed64(text: Column) -> Column:
    """The first eight bytes of the SHA-256 of a text as an unsigned number, decimal(20,0)."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two bigints differ."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_hex(a: Column, b: Column) -> Column:
    """Bits in which two hexadecimal texts of equal width (up to 64 bits) differ; unequal widths raise."""
    value = lambda c: F.conv(c, 16, -10).cast("bigint")
    return F.when(F.length(a) == F.length(b), hamming(value(a), value(b))).otherwise(F.raise_error(F.lit("hashes differ in width")).cast("int"))


def bits_to_number(bits: Column) -> Column:
    """Booleans (an array of up to 64, first is highest) as a bigint."""
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("bigint")))


def bits_to_hex(bits: Column) -> Column:
    """Booleans (an array, first is highest, a multiple of four up to 64) as hexadecimal digits."""
    return F.lower(F.lpad(F.hex(bits_to_number(bits)), F.size(bits) / 4, F.lit("0")))


def difference_bits(values: Column) -> Column:
    """For each neighbour pair of an array, whether the left value exceeds the right one."""
    return F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), lambda a, b: a > b)


def softmax(logits: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def one_hot(index: Column, size: int) -> Column:
    """Array of ``size`` zeros with a one at ``index``."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.when(k == index, 1.0).otherwise(0.0))


def argmax_lowest(values: Column) -> Column:
    """Zero-based place of the greatest element, the lowest on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of numbers, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, within [-1, 1]; 0 if either has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(dot(a, b), norms), F.lit(0.0))))


def l2_normalised(a: Column, floor: float = 1e-12) -> Column:
    """An array divided by its length, at least ``floor``."""
    norm = F.greatest(F.sqrt(dot(a, a)), F.lit(floor))
    return F.transform(a, lambda x: x.cast("double") / norm)


def valid_probabilities(p: Column, size: int, tolerance: float = 1e-5) -> Column:
    """Whether an array is a distribution of ``size`` finite numbers; never null."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    finite = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(p) == size) & finite & (F.abs(total - 1.0) <= 2 * tolerance), F.lit(False))


def log_loss(p: Column, true_class: Column, floor: float = 1e-12) -> Column:
    """Negative log of the true class's probability, which is kept within [floor, 1]."""
    return -F.ln(F.least(F.greatest(F.get(p, true_class), F.lit(floor)), F.lit(1.0)))


def brier(p: Column, true_class: Column, size: int) -> Column:
    """Sum of squared errors of a distribution against the true class."""
    return F.aggregate(F.zip_with(p, one_hot(true_class, size), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def focal_loss(p_true: Column, gamma: float, floor: float = 1e-12) -> Column:
    """(1 - p) ** gamma * -ln(p)."""
    return F.pow(1.0 - p_true, F.lit(gamma)) * -F.ln(F.greatest(p_true, F.lit(floor)))


def is_iso_date(c: Column) -> Column:
    """Whether a text is a real date written as yyyy-MM-dd; false for null."""
    return F.coalesce(F.date_format(F.to_date(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), c), "yyyy-MM-dd"), "yyyy-MM-dd") == c, F.lit(False))


def stays_inside(path: Column, root_allowed: bool = True) -> Column:
    """Whether a relative path never leaves its root; absolute paths do."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))

    def step(acc: Column, s: Column) -> Column:
        depth = acc["depth"] + F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)
        return F.struct(depth.alias("depth"), F.least(acc["least"], depth).alias("least"))

    walked = F.aggregate(F.split(F.translate(path, "\\", "/"), "/"), start, step)
    inside = (walked["least"] >= 0) & ~path.rlike(r"^([/\\]|[A-Za-z]:)")
    return inside if root_allowed else inside & (walked["depth"] > 0)


def variant_suffix(stem: Column, suffixes: list[str]) -> Column:
    """The variant suffix (after an underscore, any case, as written) that ends a file stem; null for originals."""
    choice = "|".join(sorted((s for s in suffixes), key=lambda s: (-len(s), s)))
    found = F.regexp_extract(stem, rf"(?i)_({choice})$", 1)
    return F.when(found != "", found)


def spec_errors(width: Column, height: Column, mode: Column, fmt: Column, expected: dict) -> Column:
    """Sorted codes such as unexpected_width:300, joined by semicolons, for what differs from ``expected``."""
    given = {"width": width, "height": height, "mode": mode, "format": fmt}
    codes = [F.when(~c.eqNullSafe(F.lit(expected[k])), F.concat(F.lit(f"unexpected_{k}:"), F.coalesce(c.cast("string"), F.lit("")))) for k, c in given.items()]
    return F.array_join(F.array_sort(F.array_compact(F.array(*codes))), ";")


def rule_flags(rules: dict[str, Column], otherwise: str) -> Column:
    """Names of the rules that hold, in their order, joined by semicolons; ``otherwise`` if none does."""
    held = F.array_compact(F.array(*(F.when(c, name) for name, c in rules.items())))
    return F.when(F.size(held) > 0, F.array_join(held, ";")).otherwise(otherwise)


def page_of(source_row: Column, per_page: int) -> Column:
    """The page (from 1) that shows a row, by its place (from 0) in source order."""
    return (F.floor(source_row / per_page) + 1).cast("int")


def lookup(c: Column, table: dict, default: Column | None = None) -> Column:
    """Dictionary lookup; ``default`` (the key itself if not given) for keys that are missing."""
    entries = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.element_at(entries, c), c if default is None else default)


def top_count(n: Column, fraction: float) -> Column:
    """How many make up a fraction: rounded half to even, at least one."""
    return F.greatest(F.lit(1), F.rint(n * fraction).cast("int"))


def min_max(value: Column, low: Column, high: Column, higher_is_better: bool = True) -> Column:
    """Place of a value between two bounds in [0, 1]; 1 where the bounds are equal."""
    up = F.coalesce(F.try_divide((value - low).cast("double"), (high - low).cast("double")), F.lit(1.0))
    return up if higher_is_better else F.when(high == low, 1.0).otherwise(1.0 - up)


def warmup_cosine(step: Column, warmup: int, total: int) -> Column:
    """Learning-rate factor: linear up to ``warmup``, then half a cosine down to 0."""
    progress = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, total - warmup))))
    return F.when(step < warmup, (step + 1) / F.lit(float(max(1, warmup)))).otherwise(0.5 * (1.0 + F.cos(progress * math.pi)))


def fixed_text(c: Column, digits: int) -> Column:
    """A number with fixed decimals; empty for null and NaN."""
    return F.when(c.isNull() | F.isnan(c), "").otherwise(F.format_string(f"%.{digits}f", c))


def binomial_lower_tail(n: Column, k: Column) -> Column:
    """P(X <= k) for X binomial with n trials of probability one half, summed in log space."""
    start = F.struct((-n * math.log(2.0)).cast("double").alias("term"), F.lit(0.0).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = F.when(i == 0, acc["term"]).otherwise(acc["term"] + F.ln((n - i + 1).cast("double") / F.greatest(i, F.lit(1)).cast("double")))
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    summed = F.aggregate(F.sequence(F.lit(0), F.greatest(k.cast("int"), F.lit(0))), start, step)["total"]
    return F.when(k < 0, 0.0).when(k >= n, 1.0).otherwise(F.least(summed, F.lit(1.0)))


def mcnemar_p(left_only: Column, right_only: Column) -> Column:
    """Exact two-sided McNemar p value of the two discordant counts; 1 if there are none."""
    n = left_only + right_only
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * binomial_lower_tail(n, F.least(left_only, right_only))))


def numeric_entries(text: Column) -> Column:
    """The numeric members of a JSON object as map<string,double>; true and false count as 1 and 0, others are left out."""
    entries = F.from_json(text, "map<string,string>")
    number = lambda v: F.when(v == "true", 1.0).when(v == "false", 0.0).otherwise(v.try_cast("double"))
    return F.transform_values(F.map_filter(entries, lambda k, v: number(v).isNotNull()), lambda k, v: number(v))


def relative_completeness(delta: Column, difference: Column, floor: float = 1e-6) -> Column:
    """How far attributions are from summing to the score difference they explain, relative to it."""
    return F.abs(delta) / F.greatest(F.abs(difference), F.lit(floor))


def converged(delta: Column, difference: Column, tolerance: float, floor: float = 1e-6) -> Column:
    """Whether attributions are complete within a tolerance; false for null and NaN."""
    error = relative_completeness(delta, difference, floor)
    return F.coalesce(~F.isnan(error) & (error <= tolerance), F.lit(False))


def strict_number(text: Column) -> Column:
    """A text as a double; anything that is no number raises when it is read, null stays null."""
    value = text.try_cast("double")
    return F.when(text.isNull() | value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double"))
