"""Rule compilation: selectors to priority masks.

A selector is a list of terms ``facility[,facility…].level`` that apply left to
right. Compiling is a projection of the rules table: names become codes through
literal maps and the terms are folded per facility inside the row, so nothing
is shuffled however many rules there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave import schema as S
from logweave.functions import codes
from logweave.operators.once import once
from logweave.operators.ordering import carry_forward

# One term: facilities, a dot, a level; a comma or semicolon after it ends it.
_TERM = r"([^.;\s]+\.[^,;\s]+)[,;\s]*"
# Fixed value: a mask with just "warning" set is taken for "no priority".
DEAD_MASK = 16


def _term(text: Column) -> Column:
    """Struct of one term: facility numbers (-1 = all), operation and bits."""
    facs = F.substring_index(text, ".", 1)
    level = F.substr(text, F.length(facs) + 2)
    negated = F.startswith(level, F.lit("!"))
    level = F.when(negated, F.substr(level, F.lit(2))).otherwise(level)
    single = F.startswith(level, F.lit("="))
    name = F.when(single, F.substr(level, F.lit(2))).otherwise(level)
    sev = codes.severity_code(name)
    none = F.lower(name) == "none"
    every = (name == "*") & ~single
    bit = F.call_function("shiftleft", F.lit(1), sev)
    bits = (F.when(none | every, F.lit(255)).when(single, bit).otherwise(bit * 2 - 1))
    numbers = F.transform(
        F.filter(F.split(facs, ","), lambda f: f != ""),
        lambda f: F.when(f == "*", F.lit(-1)).otherwise(codes.facility_code(f)))
    # "none" clears and "!none" sets everything; otherwise "!" clears the bits
    clear = none != negated
    return F.struct(numbers.alias("facs"), clear.alias("clear"), bits.alias("bits"))


def parse_selectors(rules: DataFrame) -> DataFrame:
    """Add ``terms`` and ``valid`` (every name known) to the rules."""
    texts = F.regexp_extract_all("selector", F.lit(_TERM), F.lit(1))
    rest = F.trim(F.regexp_replace("selector", _TERM, ""))
    split = once(rules, {"terms": F.transform(texts, _term), "_rest": rest})
    bad = F.exists(F.col("terms"), lambda t: t["bits"].isNull() | (F.size(t["facs"]) == 0)
                   | F.exists(t["facs"], lambda f: f.isNull()))
    return once(split, {"valid": (F.size("terms") > 0) & ~bad & (F.col("_rest") == "")},
                [*rules.columns, "terms"])


def compile_masks(rules: DataFrame) -> DataFrame:
    """Valid rules with ``masks``: one bit set of severities per facility 0..24.

    ``*`` covers facilities 0 to 23; marks are selected by name only.
    """
    def step(mask: Column, term: Column, fac: Column) -> Column:
        hit = F.array_contains(term["facs"], fac) | (
            F.array_contains(term["facs"], F.lit(-1)) & (fac < S.MARK_FACILITY))
        keep = mask.bitwiseAND(F.lit(255) - term["bits"])
        return (F.when(~hit, mask).when(term["clear"], keep)
                .otherwise(mask.bitwiseOR(term["bits"])))

    masks = F.transform(F.sequence(F.lit(0), F.lit(S.MARK_FACILITY)), lambda fac: F.aggregate(
        F.col("terms"), F.lit(0), lambda m, t: step(m, t, fac)))
    good = parse_selectors(rules).filter("valid")
    program = F.when(F.col("program").isin("*", ""), F.lit(None)).otherwise(F.col("program")) \
        if "program" in rules.columns else F.lit(None).cast("string")
    base = [c for c in rules.columns if c != "program"]
    return once(good, {"program": program, "masks": masks}, base)


def rejected_rules(rules: DataFrame) -> DataFrame:
    """Rules with an unknown facility or level name."""
    return parse_selectors(rules).filter(~F.col("valid")).drop("terms", "valid")


def rule_masks(compiled: DataFrame) -> DataFrame:
    """``(rule_id, fac, mask)`` rows, empty masks left out."""
    return (compiled.select("rule_id", F.posexplode("masks").alias("fac", "mask"))
            .filter("mask <> 0"))


def mark_rules(compiled: DataFrame) -> DataFrame:
    """Rules that select the heartbeat (facility mark, severity info)."""
    info = F.lit(1 << 6)
    return compiled.filter(F.col("masks")[S.MARK_FACILITY].bitwiseAND(info) != 0)


def program_blocks(lines: DataFrame, block: int = 10_000) -> DataFrame:
    """Rule lines with the program of the block they stand in.

    ``lines`` is ``(config_id, line_no, text)``; a line ``!name`` or ``#!name``
    starts a block, ``!`` and ``!*`` end it. Other comments and blank lines go.
    """
    body = F.trim(F.col("text"))
    marker = body.rlike("^#?!")
    name = F.regexp_extract(body, r"^#?!\s*([0-9A-Za-z]*)", 1)
    tagged = lines.withColumn("_mark", F.when(marker, name))
    known = carry_forward(tagged, ["config_id"], "_mark", "_prog", "line_no", block)
    keep = ~marker & (body != "") & ~body.startswith("#")
    return (known.filter(keep)
            .withColumn("program", F.nullif(F.col("_prog"), F.lit("")))
            .drop("_mark", "_prog"))


def default_rules(spark: SparkSession) -> DataFrame:
    """What applies when there is no rule table at all."""
    rows = [("default-1", 1, "*.err", None, None, None, None, None, False, "console", "file"),
            ("default-2", 2, "*.panic", None, None, None, None, None, False, "*", "notify")]
    return spark.createDataFrame(rows, S.RULES)
