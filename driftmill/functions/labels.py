"""Labels, encodings, diagnostics and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Class order and the values the binary and risk targets take. Fixed values.
CLASSES = ("safe", "warning", "breaking")
RISK = (0.0, 0.5, 1.0)


def status_value(status: Column) -> Column:
    """compatible, unknown, incompatible -> 0, 0.5, 1."""
    return F.when(status == "compatible", 0.0).when(status == "unknown", 0.5).when(status == "incompatible", 1.0)


def semver_ordinal(version: Column) -> Column:
    part = lambda i: F.split_part(version, F.lit("."), F.lit(i)).cast("double")
    return part(1) * 1e6 + part(2) * 1e3 + part(3)


def class_index(label: Column) -> Column:
    return F.when(label == "safe", 0).when(label == "warning", 1).when(label == "breaking", 2)


def one_hot(label: Column) -> Column:
    at = class_index(label)
    return F.transform(F.array(*[F.lit(i) for i in range(3)]), lambda i: F.when(i == at, 1.0).otherwise(0.0))


def binary_target(label: Column) -> Column:
    return F.when(label == "breaking", 1.0).when(label.isNotNull(), 0.0)


def risk_target(label: Column) -> Column:
    return F.when(label == "safe", RISK[0]).when(label == "warning", RISK[1]).when(label == "breaking", RISK[2])


def outcome_label(outcome: Column) -> Column:
    """Recorded outcomes; ``pass`` counts as safe, rejected outcomes have no label."""
    o = F.lower(F.trim(outcome))
    return F.when(o.isin("safe", "pass"), "safe").when(o == "warning", "warning").when(o == "breaking", "breaking")


def record_label(label: Column, breaking: Column) -> Column:
    """The label, else what the breaking flag says, else safe."""
    return F.coalesce(label, F.when(breaking == 1, "breaking"), F.lit("safe"))


def task_target(kind: str, breaking: Column, incompatible: Column, risk: Column) -> Column:
    return {"breaking": breaking, "incompatible": incompatible, "risk": risk}[kind]


def above_threshold(score: Column, threshold: Column | float) -> Column:
    """The threshold itself counts as above."""
    return (score >= threshold).cast("int")


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9]", "-")


def variant_key(mutation: Column, profile: Column, variant: Column) -> Column:
    """What tells structural variants of a change apart: the root profile for optional additions, else a named variant."""
    return F.when(mutation == "optional_field_added", F.when(profile.isNotNull(), F.concat(F.lit("root-"), profile))).otherwise(F.when(F.trim(variant) != "", variant))


def protocol_parts(protocol: Column) -> Column:
    """kind[:a[:b]] split at the first two colons; parts that are missing are null."""
    first = F.regexp_extract(protocol, r"^([^:]*)", 1)
    a = F.nullif(F.regexp_extract(protocol, r"^[^:]*:([^:]*)", 1), F.lit(""))
    b = F.nullif(F.regexp_extract(protocol, r"^[^:]*:[^:]*:(.*)$", 1), F.lit(""))
    return F.struct(first.alias("kind"), a.alias("a"), b.alias("b"))


def protocol_name(kind: Column, a: Column, b: Column) -> Column:
    return F.concat_ws(":", kind, a, b)


def upper_label(label: Column) -> Column:
    return F.upper(label)


def pack_name(name: Column) -> Column:
    return F.lower(F.trim(name))


def rule_key(rule: Column) -> Column:
    return F.replace(F.upper(F.trim(rule)), F.lit("-"), F.lit("_"))


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), F.trim)


def first_diagnostic(stderr: Column, stdout: Column) -> Column:
    """The first line with content, of stderr before stdout; null where there is none."""
    return F.get(F.filter(F.concat(_lines(stderr), _lines(stdout)), lambda x: x != ""), F.lit(0))


def warns(stdout: Column) -> Column:
    """Whether a line lists warnings, and the list is not empty."""
    return F.exists(_lines(stdout), lambda x: x.startswith("Warnings: [") & ~x.endswith("[]"))


def fatal_exit(stdout: Column, stderr: Column) -> Column:
    return (F.trim(F.coalesce(stdout, F.lit(""))) == "") & F.exists(_lines(stderr), lambda x: x.startswith("Exception in thread"))


def occurrences(text: Column, part: str) -> Column:
    return F.size(F.split(text, F.lit("\\Q" + part + "\\E"))) - 1


def invocation_outcome(exit_code: Column, stdout: Column, stderr: Column) -> Column:
    """What a recorded invocation says: exit 0 safe or warning, 1 breaking (rejected where fatal), 2 rejected, else error."""
    return (
        F.when(exit_code == 0, F.when(warns(stdout), "warning").otherwise("safe"))
        .when(exit_code == 1, F.when(fatal_exit(stdout, stderr), "rejected").otherwise("breaking"))
        .when(exit_code == 2, "rejected")
        .otherwise("error")
    )
