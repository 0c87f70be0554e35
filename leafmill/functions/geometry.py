"""Where lines, baselines and borders go, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: where a line of an exact height puts its baseline.
EXACT_BASELINE = 0.8


def slack(available: Column, width: Column) -> Column:
    return F.greatest(F.lit(0).cast("double"), available - width)


def line_offset(available: Column, width: Column, alignment: Column) -> Column:
    """How far a line's begin moves in; justified lines stay."""
    return F.when(alignment == "center", slack(available, width) / 2).when(alignment == "right", slack(available, width)).otherwise(F.lit(0.0))


def word_spacing(available: Column, width: Column, alignment: Column, gaps: Column, last: Column, broken: Column) -> Column:
    """What each gap of a justified line gets more; none on a last line or one that the author ended."""
    stretches = (alignment == "justify") & ~last & ~broken & (gaps > 0)
    return F.when(stretches, slack(available, width) / gaps).otherwise(F.lit(0.0))


def baseline(rule: Column, height: Column, natural: Column, descent: Column) -> Column:
    """From a line's top to its baseline, by the rule that made its height."""
    centred = F.greatest(F.lit(0.0), (height - natural) / 2) + natural - descent
    return F.when(rule == "exact", height * EXACT_BASELINE).when(rule == "grid", centred).when(rule == "atLeast", height - descent).otherwise(natural - descent)


def line_height(rule: Column, stated: Column, natural: Column, paragraph_natural: Column, pitch: Column) -> Column:
    """A line's box: as stated, at least so high, whole steps of a grid, or single spacing moved by what is stated against the paragraph's own."""
    grid = F.greatest(stated, F.ceil(natural / pitch) * pitch)
    by_rule = F.when(rule == "exact", stated).when(rule == "atLeast", F.greatest(stated, natural)).when(rule == "grid", grid).otherwise(F.greatest(F.lit(0.0), natural + stated - paragraph_natural))
    return F.when(stated.isNull() | (stated <= 0), natural).otherwise(by_rule)


def next_stop(stops: Column, step: Column, x: Column) -> Column:
    """The first stop (ascending array) past x, else the next multiple of the step, else x itself."""
    past = F.array_min(F.filter(stops, lambda s: s > x + 0.0001))
    return F.coalesce(past, F.when(step > 0, (F.floor(x / step) + 1) * step), x)


def row_height(content: Column, stated: Column, exact: Column) -> Column:
    return F.when(stated.isNull(), content).when(exact, stated).otherwise(F.greatest(content, stated))


def standoff(width: Column, space: Column) -> Column:
    """How far outside of its edge a rule is centred."""
    return F.when(width.isNull(), 0.0).otherwise(F.coalesce(space, F.lit(0.0)) + width / 2)


def room(width: Column, space: Column) -> Column:
    """What a rule takes outside of the text."""
    return F.when(width.isNull(), 0.0).otherwise(F.coalesce(space, F.lit(0.0)) + width)


def stronger(earlier: Column, later: Column) -> Column:
    """Of two border widths that meet, which side draws: 'earlier', 'later' or null; on a tie the later."""
    return F.when(earlier.isNull() & later.isNull(), F.lit(None).cast("string")).when(later.isNull(), "earlier").when(earlier.isNull(), "later").when(earlier > later, "earlier").otherwise("later")
