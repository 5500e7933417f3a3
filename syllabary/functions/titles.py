"""Course titles: ``id - name (detail) - n CFU``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from syllabary.functions.text import strip

# The remark that gives a title's credits.
CREDIT_REMARK = r"(?i)^(.*?)\s*[-–—]\s*(\s*[0-9]+\s*CFU\s*)\s*(.*)$"
# End of fixed values.


def parentheses(x: Column) -> Column:
    """struct(name, details): the contents of the outermost parentheses, and the text without them.

    One fold over the characters. Inner parentheses stay in a detail; empty details and those that begin with a hyphen are
    dropped; a closing parenthesis without an opening one stays in the name; what follows one that never closes goes to its end.
    """
    empty = F.struct(F.lit(0).alias("depth"), F.lit("").alias("name"), F.lit("").alias("open"), F.array().cast("array<string>").alias("details"))

    def step(s: Column, c: Column) -> Column:
        inside = s["depth"] > 0
        closes = (c == ")") & (s["depth"] == 1)
        detail = strip(s["open"])
        keep = closes & (detail != "") & ~F.startswith(detail, F.lit("-"))
        return F.struct(
            F.when(c == "(", s["depth"] + 1).when((c == ")") & inside, s["depth"] - 1).otherwise(s["depth"]).alias("depth"),
            F.when(inside | (c == "("), s["name"]).otherwise(F.concat(s["name"], c)).alias("name"),
            F.when((c == "(") & ~inside | closes, F.lit("")).when(inside, F.concat(s["open"], c)).otherwise(s["open"]).alias("open"),
            F.when(keep, F.concat(s["details"], F.array(detail))).otherwise(s["details"]).alias("details"),
        )

    def end(s: Column) -> Column:
        rest = F.when(s["depth"] > 0, F.concat(s["name"], F.lit("("), s["open"])).otherwise(s["name"])
        return F.struct(strip(rest).alias("name"), s["details"].alias("details"))

    return F.aggregate(F.split(x, ""), empty, step, end)


def split_title(raw: Column) -> Column:
    """struct(id, name, details) of a title. Without a hyphen all of it is the name. The first credit remark joins the details."""
    raw = strip(raw)
    at = F.instr(raw, "-")
    first, rest = strip(F.substring_index(raw, "-", 1)), strip(F.substr(raw, at + 1))
    plain = (F.instr(rest, "-") == 0) & (F.instr(rest, "(") == 0)
    folded = parentheses(rest)
    none = F.array().cast("array<string>")

    def credit(s: Column) -> Column:
        remark = F.regexp_extract(s["name"], CREDIT_REMARK, 2)
        name = strip(F.concat(F.regexp_extract(s["name"], CREDIT_REMARK, 1), F.regexp_extract(s["name"], CREDIT_REMARK, 3)))
        found = remark != ""
        return F.struct(
            first.alias("id"),
            F.when(found, name).otherwise(s["name"]).alias("name"),
            F.when(found, F.concat(s["details"], F.array(remark))).otherwise(s["details"]).alias("details"),
        )

    # A one-element transform names the folded struct once, so it is computed once.
    full = F.get(F.transform(F.array(folded), credit), F.lit(0))
    whole = F.struct(F.lit("").alias("id"), raw.alias("name"), none.alias("details"))
    short = F.struct(first.alias("id"), rest.alias("name"), none.alias("details"))
    return F.when(at == 0, whole).when(plain, short).otherwise(full)
