"""Text forms of landmark maps, boxes and numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from liftengine.schema import LANDMARKS


def fixed(value: Column, digits: int) -> Column:
    """Number with ``digits`` decimals, rounded from its exact binary value; ties go to even.

    The part behind the point times 10^digits is a product of a double and a small whole
    number.  Splitting the double in two halves gives the product's rounding error, and
    with it which side of a tie the exact product lies on.
    """
    scale = float(10 ** digits)
    size = F.abs(value)
    whole = F.floor(F.least(size, F.lit(2.0 ** 62)))

    def split(part):
        high = part * 134217729.0 - (part * 134217729.0 - part)
        product = part * scale
        error = (high * scale - product) + (part - high) * scale
        low = F.floor(product)
        over = product - low
        return low + F.when((over > 0.5) | ((over == 0.5) & (
            (error > 0) | ((error == 0) & ((low + whole * int(scale)) % 2 == 1)))), 1).otherwise(0)

    sign = F.when(F.signum(value).cast("string").startswith("-"), "-").otherwise("")

    def written(count):
        carried = F.when(count >= scale, whole + 1).otherwise(whole)
        return F.concat(sign, carried.cast("string"), F.lit("."), F.lpad(
            (count % int(scale)).cast("bigint").cast("string"), digits, "0"))

    # bound twice, so that each count is worked out once
    count = F.transform(F.array(size - whole), split)[0]
    text = F.transform(F.array(count), written)[0]
    return F.when(size < 2.0 ** 62, text).otherwise(F.format_string(f"%.{digits}f", value))


def landmarks_to_text(landmarks: Column) -> Column:
    """Landmark map as a literal such as ``{'left_hip': (0.5, 0.6, -0.1, 0.9)}``, by name."""
    def entry(name):
        parts = [landmarks[name][p].cast("string") for p in ("x", "y", "z", "vis")]
        return F.concat(
            F.lit("'"), name, F.lit("': ("), F.concat_ws(", ", *parts), F.lit(")"))

    entries = F.transform(F.sort_array(F.map_keys(landmarks)), entry)
    return F.coalesce(
        F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}")), F.lit("{}"))


def wide_landmarks_to_text(column) -> Column:
    """The same text from wide columns; ``column(name, part)`` names one of them."""
    entries = []
    for name in sorted(LANDMARKS):
        x, y, z, vis = [column(name, part) for part in ("x", "y", "z", "vis")]
        entries.append(f"""CASE WHEN {vis} IS NOT NULL THEN concat(
            "'{name}': (", concat_ws(', ', {x}, {y}, {z}, {vis}), ')') END""")
    return F.expr(f"concat('{{', concat_ws(', ', {', '.join(entries)}), '}}')")


def text_to_landmarks(text: Column) -> Column:
    """Landmark map from its literal; empty when there is none or it cannot be read."""
    as_json = F.translate(text, "'()", '"[]')
    points = F.from_json(as_json, "map<string,array<double>>")
    whole = F.map_filter(points, lambda name, p: F.size(p) >= 4)
    named = F.transform_values(whole, lambda name, p: F.struct(
        p[0].alias("x"), p[1].alias("y"), p[2].alias("z"), p[3].alias("vis")))
    return F.coalesce(named, F.create_map().cast(
        "map<string,struct<x:double,y:double,z:double,vis:double>>"))


def box_to_text(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Box as four numbers with two decimals, empty when there is none."""
    sides = (x1, y1, x2, y2)
    present = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
    return F.when(present, F.concat_ws(",", *[fixed(s, 2) for s in sides])).otherwise("")


def text_to_box(text: Column) -> Column:
    """Struct of whole numbers x1, y1, x2, y2; NULL unless the text is exactly four numbers."""
    values = F.transform(F.split(text, ","), lambda v: F.trim(v).try_cast("double"))
    usable = (F.size(values) == 4) & F.forall(
        values, lambda v: F.coalesce(F.abs(v) < 1e18, F.lit(False)))
    sides = [values[i].cast("bigint").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]
    return F.when(usable, F.struct(*sides))
