"""Key-value messages, safe numbers, names and cells of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_kv(message: Column) -> Column:
    """``k=v;k=v`` to a map: items without ``=`` are dropped, names and values trimmed, the last of a name wins."""
    items = F.filter(F.split(message, ";"), lambda x: F.instr(x, "=") > 1)
    pairs = F.transform(items, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def to_double(text: Column, default: float | None = None) -> Column:
    """The number that a text begins with (``1.5x`` is 1.5), else the default."""
    got = F.regexp_extract(F.trim(text), r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0).try_cast("double")
    return F.coalesce(got, F.lit(default).cast("double"))


#: What each intent is also called (fixed values).
INTENTS = {
    "FORWARD_SCAN": ("FORWARD", "FORWARD_SCAN", "FWD"),
    "LEFT_ORBIT": ("LEFT", "LEFT_ORBIT", "LEFT_SWEEP"),
    "RIGHT_ORBIT": ("RIGHT", "RIGHT_ORBIT", "RIGHT_SWEEP"),
    "UP_SCAN": ("UP", "ASCEND", "UP_SCAN"),
    "DOWN_SCAN": ("DOWN", "DESCEND", "DOWN_SCAN"),
    "PULL_BACK": ("PULL_BACK", "RETREAT", "BACK_OFF"),
    "HOLD_STABLE": ("HOLD", "HOLD_STABLE", "STOP"),
    "RESCAN_LOCAL": ("RESCAN", "RESCAN_LOCAL"),
}


def canonical_intent(raw: Column) -> Column:
    word, out = F.upper(F.trim(raw)), F.when(F.lit(False), "")
    for name, also in INTENTS.items():
        out = out.when(word.isin(*also), name)
    return out.otherwise("FREE")


def frame_id(name: Column) -> Column:
    return F.regexp_replace(name, "^/", "")


def status_value(text: Column) -> Column:
    """A value of a status line: what would end it becomes a comma."""
    return F.translate(text, ";\r\n", ",,,")


def csv_cell(text: Column) -> Column:
    """A quoted cell where it must be; line ends become blanks."""
    flat = F.translate(text, "\r\n", "  ")
    return F.when(flat.rlike('[",]'), F.concat(F.lit('"'), F.replace(flat, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(flat)
