"""Column macros of the screening engine; all stay inside Spark's expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and their bare letters.
MARKED = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ"
BARE = "aaaaaaceeeeiiiinooooouuuuyy"


def strict_date(text: Column) -> Column:
    """The date of a zero-padded YYYY-MM-DD text that is a real day, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def fold_text(text: Column) -> Column:
    """Lower case without the marks of Latin letters."""
    return F.translate(F.lower(text), MARKED, BARE)


def graduated(v: Column, start: float, end: float, lo: float, hi: float) -> Column:
    """Points from lo at start to hi at end, clamped, one decimal, halves up."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - start) / (end - start)))
    return F.when(v.isNotNull(), F.floor((lo + (hi - lo) * share) * 10 + 0.5) / 10)


def check_status(applicable: Column, evaluable: Column, triggered: Column) -> Column:
    """Tri-state applicability (yes, no, unknown) and the check's outcome; a null comparison never signals."""
    return (
        F.when(applicable == "no", "not-applicable").when((applicable.isNull()) | (applicable != "yes") | ~F.coalesce(evaluable, F.lit(False)), "unknown")
        .when(F.coalesce(triggered, F.lit(False)), "signal").otherwise("clear")
    )


def multiplier(points: Column) -> Column:
    return F.pow(F.lit(2.0), points / 10)


def month_difference(later: Column, earlier: Column) -> Column:
    """Months between calendar months, whatever the day."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def bigrams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over those of the smaller set; null when one is empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0))


def formula_guard(cell: Column) -> Column:
    """A leading apostrophe where a spreadsheet would take the text for a formula."""
    return F.when(cell.rlike(r"^[\s\x00-\x1f]*[=+\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def csv_cell(cell: Column) -> Column:
    text = F.coalesce(formula_guard(cell), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def cents(amount: Column) -> Column:
    return F.floor(amount * 100 + 0.5).cast("long")


def percent_increase(first: Column, last: Column) -> Column:
    """In whole cents; null unless the first amount is positive."""
    return F.when(cents(first) > 0, (cents(last) - cents(first)) / cents(first) * 100)


def fold_of(key: Column, folds: int) -> Column:
    """A deterministic fold from the key's digest."""
    return (F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % folds).cast("int")


def masked_id(kind: Column, value: Column) -> Column:
    return F.concat(F.lit("masked-"), F.substring(F.sha2(F.concat_ws(":", kind, value), 256), 1, 16))
