"""Status tests, ratios, bins and labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a blank-trimmed status may carry at its ends: all of Unicode's white space.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def status_is(status: Column, wanted: str, normalize: str = "none") -> Column:
    """Status test: exact (`none`), ignoring case (`lower`), or also outer blanks (`trim_lower`)."""
    if normalize == "none":
        return status == wanted
    if normalize == "lower":
        return F.lower(status) == wanted.lower()
    if normalize == "trim_lower":
        return F.lower(F.btrim(status, F.lit(BLANKS))) == wanted.lower()
    raise ValueError(f"unknown normalize rule: {normalize!r}")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; null where the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def ratio_or_zero(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0 unless the whole is positive."""
    return F.when(whole > 0, ratio(part, whole)).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100


@dataclass(frozen=True)
class Bins:
    """Half-open numeric bins [e0,e1) [e1,e2) …; values outside have no bin."""

    edges: tuple[float, ...]
    labels: tuple[str, ...]

    def __post_init__(self) -> None:
        if len(self.labels) != len(self.edges) - 1:
            raise ValueError("there must be one label fewer than edges")

    def name(self, position: Column) -> Column:
        """The name of the bin at a position."""
        return F.get(F.array(*map(F.lit, self.labels)), position)

    def position(self, column: str) -> Column:
        """Which bin a column's value falls into, from 0; null outside."""
        arms = " ".join(
            f"WHEN `{column}` >= {low} AND `{column}` < {high} THEN {i}"
            for i, (low, high) in enumerate(zip(self.edges, self.edges[1:]))
        )
        return F.expr(f"CASE {arms} END")

    def within(self, column: str, labels: Sequence[str] | None = None) -> Column:
        """Whether a value falls into any bin, or one of those named.

        Written as ranges, so that it can be pushed down to the scan.
        """
        if labels is None:
            return F.expr(f"`{column}` >= {self.edges[0]} AND `{column}` < {self.edges[-1]}")
        chosen = [i for i, name in enumerate(self.labels) if name in set(labels)]
        ranges = (
            f"(`{column}` >= {self.edges[i]} AND `{column}` < {self.edges[i + 1]})" for i in chosen
        )
        return F.expr(" OR ".join(ranges) or "FALSE")


# Age edges and their names.
AGE_BINS = Bins((0, 20, 30, 40, 50, 60, 100), ("<20", "20s", "30s", "40s", "50s", "60+"))


def in_list_or_known(column: Column, allowed: Sequence | None) -> Column:
    """Membership in a choice; no choice means every known value, so nulls never pass."""
    return column.isNotNull() if allowed is None else column.isin(list(allowed))


def sample_size_suffix(count: Column) -> Column:
    """The ` · N=1,234` ending of a cohort label."""
    return F.concat(F.lit(" · N="), F.format_number(count, 0))


def shorten(text: Column, width: int = 25, mark: str = "...") -> Column:
    """Cut a label to `width` characters at a word end, with `mark` in place of the rest."""
    plain = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    room = width - len(mark)
    # The longest head of at most `room` characters that ends before a blank, after the hyphen of
    # a compound word, or on either side of a dash of several hyphens between words.
    letter, part = r"[^\W\d]", r"""[\w!"'&.,?]"""
    ends = (
        r"(?<=\S)(?= )",
        rf"(?<={letter}{{2}}-)(?={letter}-?{letter})",
        rf"(?<={letter}-{part}-)(?={letter}-?{letter})",
        rf"(?<={part})(?=-{{2,}}\w)",
        rf"(?<={part}-{{2,{width}}})(?=\w)",
    )
    ends = "|".join(ends)
    head = F.regexp_extract(plain, rf"(?U)^.{{0,{room}}}(?:{ends})", 0)
    # What follows may have no such place within a whole line: it is cut after the last hyphen
    # that the line holds, if the mark fits behind.
    after = F.length(head)
    after += F.when(F.substr(plain, after + 1, F.lit(1)) == " ", 1).otherwise(0)
    rest = F.substr(plain, after + 1)
    whole = (F.length(rest) <= width) | (
        F.length(F.regexp_extract(rest, rf"(?U)^.{{1,{width}}}(?:{ends})", 0)) > 0
    )
    line = F.regexp_extract(F.substr(rest, F.lit(1), F.lit(width) - after), r"^-*[^-].*-", 0)
    fits = ~whole & (F.length(line) > 0) & (after + F.length(line) <= room)
    head = F.when(fits, F.substr(plain, F.lit(1), after + F.length(line))).otherwise(head)
    return F.when(F.length(plain) <= width, plain).otherwise(F.concat(head, F.lit(mark)))
