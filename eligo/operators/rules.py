"""Stored eligibility rules, evaluated against profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def attributes(fields: list[str]) -> Column:
    """A profile's attributes as text, by field name, lower case."""
    return F.create_map(*[x for f in fields for x in (F.lit(f), F.lower(c(f).cast("string")))])


def holds(rule: Column, have: Column) -> Column:
    """Whether a rule holds for an attribute; null where the attribute is absent.

    Bounds compare as numbers, the rest as text without letter case.
    """
    number = have.try_cast("double")

    def num(name: str) -> Column:
        return rule[name].try_cast("double")

    listed = F.array_contains(F.transform(rule["value_list"], lambda x: F.lower(x)), have)
    op = rule["operator"]
    return (
        F.when(op == "gte", number >= num("value"))
        .when(op == "lte", number <= num("value"))
        .when(op == "between", number.between(num("value_min"), num("value_max")))
        .when(op == "eq", have == F.lower(rule["value"]))
        .when(op == "in", listed)
        .when(op == "not_in", ~listed)
    )


def rules_of(rows: DataFrame) -> DataFrame:
    """Each scheme's stored rule rows as one array ``rules``, in their order; a scheme has few, so the arrays stay short."""
    fields = [x for x in rows.columns if x != "scheme_id"]
    return rows.groupBy("scheme_id").agg(F.sort_array(F.collect_list(F.struct("position", *[x for x in fields if x != "position"]))).alias("rules"))


def evaluate_stored(pairs: DataFrame, rows: DataFrame, fields: list[str]) -> DataFrame:
    """:func:`evaluate_rules` for pairs (scheme_id and a profile's ``fields``) with the stored rule rows of the schemes;
    a scheme without rows has nothing to fail."""
    met = pairs.join(rules_of(rows), "scheme_id", "left")
    return evaluate_rules(met.withColumn("rules", F.coalesce("rules", F.array().cast(met.schema["rules"].dataType))), fields)


def evaluate_rules(pairs: DataFrame, fields: list[str], rules: str = "rules") -> DataFrame:
    """Verdict columns for pairs that carry a scheme's ``rules`` and a profile's ``fields``.

    A hard (required) AND rule fails a pair when it does not hold. Hard OR
    rules of a scheme fail a pair only when at least one could be tested and
    none holds. An attribute the profile lacks leaves its rule untested.
    Everything happens within the row: no rule is exploded, nothing shuffles.
    """
    tested = F.transform(c(rules), lambda r: F.struct(
        holds(r, c("_have")[r["field"]]).alias("ok"), r["required"].alias("hard"),
        (F.coalesce(r["logical_group"], F.lit("AND")) == "OR").alias("alt"),
        r["rule_type"].alias("kind"),
    ))

    def count(test) -> Column:
        return F.size(F.filter(c("_tested"), test)).cast("bigint")

    failed = F.filter(c("_tested"), lambda t: t["hard"] & ~t["alt"] & (t["ok"] == F.lit(False)))
    return (
        pairs.withColumn("_have", attributes(fields))
        .withColumn("_tested", tested)
        .withColumns({
            "rules_tested": count(lambda t: t["ok"].isNotNull()),
            "rules_met": count(lambda t: F.coalesce(t["ok"], F.lit(False))),
            "failed_rules": F.transform(failed, lambda t: t["kind"]),
            "_alt_tested": count(lambda t: t["hard"] & t["alt"] & t["ok"].isNotNull()),
            "_alt_met": count(lambda t: t["hard"] & t["alt"] & F.coalesce(t["ok"], F.lit(False))),
        })
        .withColumn("rules_passed", (F.size("failed_rules") == 0)
                    & ((c("_alt_tested") == 0) | (c("_alt_met") > 0)))
        .drop("_have", "_tested", "_alt_tested", "_alt_met")
    )
