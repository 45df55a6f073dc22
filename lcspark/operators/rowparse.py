"""Rows that fail to parse: anchored patterns generated from a schema separate loadable rows from failed ones with the reason.

Everything stays in the JVM. A row is cut at the commas outside quotes; its bare values, joined by a private separator, are matched by one
anchored pattern for the whole row. Rows that fail it pass through prefix patterns of one, two, ... fields, and the first prefix that fails
names the first broken field. Repetitions are possessive and loops over groups bounded, so that very long rows neither backtrack nor overflow
the stack; a value that such a bound could cut is checked once more by deletion of its tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lcspark.session import once

#: The elements a formula may name, two-letter symbols first.
ELEMENTS = ("Br", "Cl", "Si", "Na", "I", "K", "S", "P", "F", "O", "N", "C", "H")
NUMBER = r"(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)(?:[eE][+-]?[0-9]++)?+"
ELEMENT_COUNT = rf"(?:{'|'.join(ELEMENTS)})(?:[1-9][0-9]*+)?+"
#: Private-use signs for a comma inside quotes and between bare values, and one that stands before a digit for any of the three in a row.
COMMA, BETWEEN, ESCAPE = "\uf8f0", "\uf8f1", "\uf8f2"


@dataclass(frozen=True)
class Field:
    """A column of a text row. ``pattern``: what its bare value may be (None: anything); ``tokens``: a pattern whose repetition it may be;
    ``below``: upper limit of a positive number. Typed values may be empty."""

    name: str
    pattern: str | None = None
    tokens: str | None = None
    below: float | None = None

    @property
    def row_pattern(self) -> str:
        if self.tokens is not None:
            return f"(?:{self.tokens}){{0,200}}+"
        return f"[^{BETWEEN}]*+" if self.pattern is None else f"(?:{self.pattern})?+"


#: The nine fields of a delivered library line.
LIBRARY_LINE = (
    Field("name"), Field("precursor_mz", NUMBER, below=5000.0), Field("precursor_type"), Field("ms_level"), Field("formula", tokens=ELEMENT_COUNT),
    Field("inchikey"), Field("smiles"), Field("num_peaks"), Field("peaks"),
)


def parse_rows(df: DataFrame, raw: str, schema: tuple[Field, ...], keep: list[str], skip: Column | None = None) -> DataFrame:
    """``(*keep, raw, fields, broken_field, reason)``: ``fields`` is a struct of strings, null on a failed row; ``reason`` is null on a valid one.

    Reasons, the first that applies: ``quoting`` (a quote that is not closed, stands inside a bare field, or is closed before the end of its
    field), ``column_count``, ``bad_value`` (a field misses its pattern or limit), ``skipped`` (``skip``, a condition on the columns of ``_v``).
    Null rows count as one empty field. Empty tables give empty results, repeated rows repeated ones; columns not in ``keep`` are left behind,
    whatever their names. Any length of row is judged whole.
    """
    own = ((ESCAPE, ESCAPE + "2"), (COMMA, ESCAPE + "0"), (BETWEEN, ESCAPE + "1"))

    def escaped(c: Column) -> Column:
        out = c
        for sign, code in own:
            out = F.replace(out, F.lit(sign), F.lit(code))
        return F.when(c.rlike(f"[{COMMA}-{ESCAPE}]"), out).otherwise(c)

    def bared(c: Column) -> Column:
        out = c
        for sign, code in own[::-1]:
            out = F.replace(out, F.lit(code), F.lit(sign))
        return F.when(c.contains(ESCAPE), out).otherwise(c)

    row = escaped(F.coalesce(F.col(raw), F.lit("")))
    sections = F.regexp_extract_all(F.col("_row"), F.lit(r'("[^"]*+"|[^"]++|")'), F.lit(1))
    masked = F.array_join(F.transform(sections, lambda p: F.when(p.startswith('"'), F.replace(p, F.lit(","), F.lit(COMMA))).otherwise(p)), "")
    inner = lambda c: F.substr(c, F.lit(2), F.length(c) - 2)
    bare = lambda c: ~c.contains('"')
    closed = lambda c: c.startswith('"') & c.endswith('"') & (F.length(c) >= 2) & bare(F.replace(inner(c), F.lit('""'), F.lit("")))
    value = lambda c: F.replace(F.when(c.startswith('"'), F.replace(inner(c), F.lit('""'), F.lit('"'))).otherwise(c), F.lit(COMMA), F.lit(","))
    # most rows have no quote at all, and need no more than a split
    quoted = F.col("_row").contains('"')
    d = once(df.select(*keep, raw), _row=row)
    d = once(d, _c=F.split(F.when(quoted, masked).otherwise(F.col("_row")), ",", -1))
    d = once(d, _syntax=~quoted | F.forall("_c", lambda c: bare(c) | closed(c)))
    d = once(d, _a=F.when(~quoted, F.col("_c")).when(F.col("_syntax"), F.transform("_c", value)))
    whole = f"\\A{BETWEEN.join(f.row_pattern for f in schema)}\\z"
    fits = F.size("_a") == len(schema)
    d = once(d, _v=F.when(fits, F.struct(*[F.col("_a")[i].alias(f.name) for i, f in enumerate(schema)])), _text=F.when(fits, F.array_join("_a", BETWEEN)))
    d = once(d, _ok=F.col("_text").rlike(whole))
    broken = []
    for k, f in enumerate(schema):
        prefix = f"\\A{BETWEEN.join(x.row_pattern for x in schema[: k + 1])}(?:{BETWEEN}|\\z)"
        # a value beyond the loop's bound, or below a limit that no pattern states, is judged by itself
        suspect = F.lit(True) if f.below is not None else ~F.col("_ok") & ~F.col("_text").rlike(prefix)
        broken.append(F.when(suspect & ~F.coalesce(_value_ok(f), F.lit(False)), F.lit(f.name)))
    d = once(d, broken_field=F.coalesce(*broken))
    reason = (
        F.when(~F.col("_syntax"), "quoting")
        .when(F.col("_v").isNull(), "column_count")
        .when(F.col("broken_field").isNotNull(), "bad_value")
        .when(F.coalesce(skip, F.lit(False)) if skip is not None else F.lit(False), "skipped")
    )
    d = once(d, reason=reason)
    fields = F.struct(*[bared(F.col("_v")[f.name]).alias(f.name) for f in schema])
    return d.select(*keep, raw, F.when(F.col("reason").isNull(), fields).alias("fields"), "broken_field", "reason")


def _value_ok(f: Field) -> Column:
    """A field's value judged alone."""
    v = F.col("_v")[f.name]
    ok = F.lit(True)
    if f.pattern is not None:
        ok = ok & v.rlike(f"\\A(?:{f.pattern})?+\\z")
    if f.tokens is not None:
        ok = ok & (F.regexp_replace(v, f.tokens, "") == "")
    if f.below is not None:
        n = F.expr(f"try_cast(nullif(_v.{f.name}, '') as double)")
        ok = ok & ((v == "") | F.coalesce((n > 0) & (n < f.below), F.lit(False)))
    return ok


def no_library_record() -> Column:
    """Lines a library leaves out: MS1 level or no peaks."""
    level = F.lower(F.trim(F.col("_v.ms_level")))
    return level.isin("1", "ms1") | (F.trim(F.col("_v.peaks")) == "") | (F.trim(F.col("_v.num_peaks")) == "0")


def load_library_lines(lines: DataFrame) -> DataFrame:
    """``library_raw`` parsed: see ``parse_rows``."""
    return parse_rows(lines, "raw", LIBRARY_LINE, ["line_id", "lib"], no_library_record())
