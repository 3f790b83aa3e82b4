"""Tags, labels, paths and templates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRIP = r"^\s+|\s+$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, _STRIP, "")


def _group(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match; null where nothing matches."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def tag_body(c: Column, tag: str) -> Column:
    """Trimmed body of the first ``<tag>``; null without one."""
    return stripped(_group(c, rf"(?s)<{tag}>(.*?)</{tag}>"))


def answer(c: Column) -> Column:
    return tag_body(c, "answer")


def answer_by_position(c: Column, tag: str = "answer") -> Column:
    """Trimmed text from after the first opening mark to the first closing one; empty if that comes earlier, null without both."""
    opens, closes = F.lit(f"<{tag}>"), F.lit(f"</{tag}>")
    start = F.instr(c, opens) + len(tag) + 2
    body = F.substring(c, start, F.greatest(F.lit(0), F.instr(c, closes) - start))
    return F.when(F.contains(c, opens) & F.contains(c, closes), stripped(body))


def tag_with_marks(c: Column, tag: str) -> Column:
    """The first tag with its marks; null without one."""
    return _group(c, rf"(?s)(<{tag}>.*?</{tag}>)")


def think_before_close(c: Column) -> Column:
    """Text before the first ``</think>``, the opening mark removed."""
    return F.replace(F.substring_index(c, "</think>", 1), F.lit("<think>"), F.lit(""))


def category_in_prompt(c: Column) -> Column:
    """Quoted name after the word category, either quote, any case; null without one."""
    return _group(c, r"(?i)category\s+['\"]([^'\"]+)['\"]")


def guarded_class(c: Column) -> Column:
    """``unknown`` for empty answers and for lists of boxes."""
    return F.when((c == "") | c.contains("["), "unknown").otherwise(c)


def confidence(c: Column) -> Column:
    """Number in the confidence tag, any case; null if there is none or it is no number."""
    return _group(c, r"(?i)<confidence>([\d.]+)</confidence>").try_cast("double")


def with_confidence(c: Column, value: Column) -> Column:
    """All non-empty confidence tags set to ``value`` (two decimals)."""
    return F.regexp_replace(c, F.lit(r"(?i)<confidence>[\d.]+</confidence>"), F.concat(F.lit("<confidence>"), value, F.lit("</confidence>")))


def normalised(c: Column, hyphens: bool = False) -> Column:
    """Lower case without spaces and underscores (and hyphens)."""
    return F.lower(F.translate(c, " _-" if hyphens else " _", ""))


def matches_either_way(a: Column, b: Column, strict: bool = False) -> Column:
    """One contains the other; an empty answer matches everything unless ``strict``."""
    hit = F.contains(a, b) | F.contains(b, a)
    return hit & (a != "") & (b != "") if strict else hit


def parent_folder(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def folder_after(path: Column, marker: str = "images") -> Column:
    """Component after ``/marker/``; null without it."""
    return _group(path, rf"/{marker}/([^/]+)/")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def shots_in_name(name: Column) -> Column:
    """Number in ``shot_<n>`` or ``<n>shot``; null without one."""
    return F.coalesce(_group(name, r"shot_(\d+)"), _group(name, r"(\d+)[-_]?shot")).try_cast("int")


def metadata_field(metadata: Column, path: str) -> Column:
    """Trimmed field of a JSON text, by dotted path; a text on the way that holds JSON is opened, too.  Null where a step is missing."""
    for key in path.split("."):
        metadata = F.get_json_object(metadata, f"$.{key}")
    return stripped(metadata)


def truncated_number(c: Column) -> Column:
    """Text to whole number, cut towards zero; null if it is no number."""
    return c.try_cast("double").cast("long")


def is_jpeg(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 3)) == "FFD8FF"


def is_png(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 4)) == "89504E47"


def boxes_or_none(boxes: Column) -> Column:
    """JSON of a box list, ``No Objects`` for an empty one."""
    return F.when(F.size(boxes) > 0, F.to_json(boxes)).otherwise("No Objects")


def label_of(path: Column, solution: Column, known: list[str]) -> Column:
    """Class of a record: the folder after ``images`` if it is a known class, else the answer; any case, null if neither is known."""
    names = F.create_map(*[F.lit(x) for c in known for x in (c.lower(), c)])
    return F.coalesce(F.try_element_at(names, F.lower(folder_after(path))), F.try_element_at(names, F.lower(answer(solution))))


def encoded(content: Column) -> Column:
    """File content as base64 text in one line."""
    return F.regexp_replace(F.base64(content), r"\s", "")


def two_digits(c: Column) -> Column:
    """Two decimals of a number below 2**63 in size, rounded by the exact binary value (so 0.175 gives 0.17 and 0.165 gives 0.17), ties to even."""
    size = F.abs(c)
    ones = F.floor(size)
    scaled = ((size - ones.cast("double")) * float(1 << 60)).cast("long")  # exact: what is left of the whole number loses no bits, then only the exponent changes
    low = scaled.bitwiseAND((1 << 30) - 1) * 100
    high = F.shiftright(scaled, 30) * 100 + F.shiftright(low, 30)
    rest = F.shiftleft(high.bitwiseAND((1 << 30) - 1), 30) + low.bitwiseAND((1 << 30) - 1)
    whole, half = F.shiftright(high, 30), F.lit(1 << 59)
    up = (rest > half) | ((rest == half) & (whole % 2 == 1))
    n = whole + up.cast("long")
    over = (n == 100).cast("long")
    return F.concat(F.when(c < 0, "-").otherwise(""), (ones + over).cast("string"), F.lit("."), F.lpad((n - over * 100).cast("string"), 2, "0"))
