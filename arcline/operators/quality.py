"""Declarative data-quality report: one row per failed check.

All row-level rules of a table are counted in one aggregation; key and reference checks
count per key first, so repeated keys shrink before any shuffle. Only report rows are ever
collected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcline import schemas as S

CRITICAL, WARNING = "critical", "warning"
CONTRACT_WORDS = {"isin": "other than", "range": "out of range", "length": "shorter than"}
REPORT_COLUMNS = ("level", "table", "check", "message", "count")


class QualityError(Exception):
    """At least one critical check failed."""


@dataclass(frozen=True)
class Rule:
    level: str
    check: str
    failing: Column  # row-level condition; NULL counts as passing
    message: str


def missing(df: DataFrame, column: str) -> Column:
    """NULL, or blank text; a column that does not exist is missing in every row."""
    if column not in df.columns:
        return F.lit(True)
    value = F.col(column)
    if isinstance(df.schema[column].dataType, T.StringType):
        return value.isNull() | (F.trim(value) == "")
    return value.isNull()


def required_rules(df: DataFrame, columns) -> list[Rule]:
    return [
        Rule(CRITICAL, f"missing_{c}", missing(df, c), f"without a value in required {c}")
        for c in columns
    ]


def optional_rules(df: DataFrame, columns) -> list[Rule]:
    return [
        Rule(WARNING, f"missing_{c}", missing(df, c), f"without a value in {c}")
        for c in columns
    ]


def allowed_rule(column: str, allowed) -> Rule:
    return Rule(
        CRITICAL,
        f"invalid_{column}",
        F.col(column).isNotNull() & ~F.col(column).isin(*allowed),
        f"with {column} other than {sorted(allowed)}",
    )


WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
PLAIN = (*WHOLE, T.FloatType, T.DoubleType, T.DecimalType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def as_type(df: DataFrame, field: T.StructField) -> Column:
    """A column read as its declared type; NULL where the value has no such reading.

    A whole number may be written with a fraction of zero; any other fraction is no whole number.
    """
    have, value = df.schema[field.name].dataType, F.col(f"`{field.name}`")
    if have == field.dataType:
        return value
    times = isinstance(have, (T.DateType, T.TimestampType, T.TimestampNTZType))
    numeric = isinstance(field.dataType, (*WHOLE, T.FloatType, T.DoubleType))
    dated = isinstance(field.dataType, T.DateType)
    if not isinstance(have, PLAIN) or (times and numeric) or (dated and not times and not isinstance(have, T.StringType)):
        return F.lit(None).cast(field.dataType)
    if not isinstance(field.dataType, WHOLE) or isinstance(have, (*WHOLE, T.BooleanType)):
        return value.try_cast(field.dataType)
    real = value.try_cast("double")
    fraction_free = F.when(real == F.floor(real), real).try_cast(field.dataType)
    return F.coalesce(value.try_cast(field.dataType), fraction_free) if isinstance(have, T.StringType) else fraction_free


def unreadable(df: DataFrame, field: T.StructField) -> Column:
    """Rows with a value that cannot be read as the declared type."""
    return F.col(f"`{field.name}`").isNotNull() & as_type(df, field).isNull()


def type_rules(df: DataFrame, schema: T.StructType) -> list[Rule]:
    """One rule per column that is there and stored as another type than declared."""
    return [
        Rule(CRITICAL, "contract_type", unreadable(df, field), f"unreadable as {field.dataType.simpleString()} in {field.name}")
        for field in schema.fields
        if field.name in df.columns and df.schema[field.name].dataType != field.dataType
    ]


def typed_rows(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows of the declared types, rejected rows as read with their ``reasons``).

    A row is rejected for values that cannot be read as declared and for NULL in columns declared
    not nullable; every reason names its column. Columns that are not declared stay out of the
    first table; a declared column that is absent fails the call.
    """
    require_columns(df, schema.fieldNames())
    found = [F.when(unreadable(df, f), F.lit(f"{f.name}: not {f.dataType.simpleString()}")) for f in schema.fields]
    found += [F.when(F.col(f"`{f.name}`").isNull(), F.lit(f"{f.name}: missing")) for f in schema.fields if not f.nullable]
    judged = df.withColumn("reasons", F.array_compact(F.array(*found)))
    good = judged.where(F.size("reasons") == 0).select(*[as_type(df, f).alias(f.name) for f in schema.fields])
    return good, judged.where(F.size("reasons") > 0)


def reason_counts(rejected: DataFrame) -> DataFrame:
    """(column, problem, count) over the reasons of rejected rows."""
    parts = F.split("reason", ": ", 2)
    return (
        rejected.select(F.explode("reasons").alias("reason"))
        .groupBy("reason")
        .count()
        .select(parts[0].alias("column"), parts[1].alias("problem"), "count")
    )


def contract_rules(df: DataFrame, rules, schema: T.StructType | None = None) -> list[Rule]:
    """Column contracts: presence, nullability, allowed values, ranges, minimum length, types.

    Allowed values, ranges and dates of a column with a declared type are judged on the values
    read as that type; a value that cannot be read breaks the type only.
    """
    declared = {f.name: f for f in schema.fields} if schema is not None else {}
    result = []
    for column, kind, argument, nullable in rules:
        if column not in df.columns:
            result.append(
                Rule(CRITICAL, "contract_column", F.lit(True), f"cannot show absent column {column}")
            )
            continue
        value = as_type(df, declared[column]) if column in declared and kind != "plain" else F.col(column)
        if not nullable:
            result.append(
                Rule(CRITICAL, "contract_not_null", F.col(column).isNull(), f"NULL in {column}")
            )
        condition = {
            "isin": lambda v, a: ~v.isin(*a),
            "range": lambda v, a: (v < a[0]) | (v > a[1]),
            "length": lambda v, a: F.length(v) < a,
        }.get(kind)
        if condition is not None:
            result.append(
                Rule(
                    CRITICAL,
                    f"contract_{kind}",
                    value.isNotNull() & condition(value, argument),
                    f"{CONTRACT_WORDS.get(kind, kind)} {argument} on {column}",
                )
            )
    return result + (type_rules(df, schema) if schema is not None else [])


def season_date_rules(season: str, column: str = "game_date") -> list[Rule]:
    rules = [
        Rule(CRITICAL, f"missing_{column}", F.col(column).isNull(), f"lacking {column}")
    ]
    if season in S.SEASON_DATES:
        low, high = (F.lit(day).cast("date") for day in S.SEASON_DATES[season])
        date = F.col(column).try_cast("date")
        rules.append(
            Rule(
                CRITICAL,
                "date_range",
                (date < low) | (date > high),
                f"with {column} beyond {S.SEASON_DATES[season]}, the days of {season}",
            )
        )
    return rules


def _issue(level: str, table: str, check: str, message: Column, count: Column) -> Column:
    return F.struct(
        F.lit(level).alias("level"),
        F.lit(table).alias("table"),
        F.lit(check).alias("check"),
        message.alias("message"),
        count.cast("bigint").alias("count"),
    )


def check_rows(
    df: DataFrame,
    table: str,
    rules: list[Rule],
    *,
    expected: tuple[str, int] | None = None,
    empty_is_critical: bool = True,
) -> DataFrame:
    """Count every rule and the row-count expectation in one pass over ``df``."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(rule.failing).alias(f"_r{i}") for i, rule in enumerate(rules)],
    )
    issues = [
        _issue(
            rule.level,
            table,
            rule.check,
            F.concat(F.col(f"_r{i}").cast("string"), F.lit(f" {rule.message}")),
            F.col(f"_r{i}"),
        )
        for i, rule in enumerate(rules)
    ]
    shown = F.filter(F.array(*issues), lambda issue: issue["count"] > 0) if issues else F.array()
    extra = []
    rows = F.col("_rows")
    if expected is not None:
        kind, number = expected
        bad = rows != number if kind == "exact" else rows < number
        word = "exactly" if kind == "exact" else "at least"
        text = F.concat(F.lit(f"wanted {word} {number} rows, got "), rows.cast("string"))
        extra.append(F.when(bad, _issue(CRITICAL, table, f"row_count_{kind}", text, rows)))
    if empty_is_critical:
        empty = _issue(CRITICAL, table, "empty", F.lit("table is empty"), F.lit(0))
        extra.append(F.when(rows == 0, empty))
    parts = [shown] if issues else []
    if extra:
        parts.append(F.filter(F.array(*extra), lambda issue: issue.isNotNull()))
    return counted.select(F.explode(F.concat(*parts)).alias("i")).select("i.*")


def key_duplicates(df: DataFrame, keys) -> DataFrame:
    """One row: repeated key groups and rows beyond the first of each; NULL is a key value."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counted.agg(
        F.count_if(F.col("_n") > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("extra_rows"),
    )


def check_keys(df: DataFrame, table: str, keys) -> DataFrame:
    text = F.concat(
        F.col("duplicate_groups").cast("string"),
        F.lit(f" keys used more than once: {tuple(keys)}"),
    )
    issue = _issue(CRITICAL, table, "duplicate_natural_key", text, F.col("extra_rows"))
    found = key_duplicates(df, keys).where(F.col("duplicate_groups") > 0)
    return found.select(issue.alias("i")).select("i.*")


def orphan_rows(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child key values absent from the parent with their row counts; NULL keys pass."""
    used = child.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("rows")
    )
    known = parent.select(F.col(parent_column).alias(column)).distinct()
    return used.join(known, column, "left_anti")


def check_reference(
    child: DataFrame, table: str, column: str, parent: DataFrame, parent_column: str
) -> DataFrame:
    total = orphan_rows(child, column, parent, parent_column).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("_n")
    )
    text = F.concat(
        F.col("_n").cast("string"), F.lit(f" with a {column} unknown to {parent_column}")
    )
    issue = _issue(CRITICAL, table, f"orphan_{column}", text, F.col("_n"))
    return total.where(F.col("_n") > 0).select(issue.alias("i")).select("i.*")


def report_union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _references(tables: dict[str, DataFrame]) -> dict[str, list[tuple[str, str, str]]]:
    games, players, teams = ("games", "game_id"), ("players", "player_id"), ("teams", "team_id")
    return {
        "games": [("home_team_id", *teams), ("away_team_id", *teams)],
        "shots": [("game_id", *games), ("player_id", *players), ("team_id", *teams)],
        "player_game_logs": [("game_id", *games), ("player_id", *players), ("team_id", *teams)],
        "team_game_logs": [("game_id", *games), ("team_id", *teams)],
        "play_by_play": [("game_id", *games)],
    }


def _table_rules(table: str, df: DataFrame, season: str) -> list[Rule]:
    rules = contract_rules(df, S.COLUMN_RULES.get(table, ()), S.CONTRACT_TYPES.get(table))
    if table == "teams":
        rules += required_rules(df, ("team_id", "abbreviation", "full_name"))
        rules.append(
            Rule(
                CRITICAL,
                "abbreviation_length",
                F.length("abbreviation") > 3,
                "with an abbreviation of over 3 characters",
            )
        )
    elif table == "players":
        rules += required_rules(df, ("player_id", "full_name"))
        rules += optional_rules(df, ("first_name",))
    elif table == "games":
        same = F.col("home_team_id") == F.col("away_team_id")
        rules.append(Rule(CRITICAL, "home_equals_away", same, "game(s) where home equals away"))
    elif table == "shots":
        rules += optional_rules(df, ("event_type", "action_type", "shot_zone_basic"))
    elif table == "play_by_play":
        rules += optional_rules(
            df, ("team_id", "description", "action_type", "sub_type", "shot_result")
        )
        nameless = F.col("person_id").isNotNull() & F.col("player_name").isNull()
        rules.append(
            Rule(WARNING, "missing_player_name", nameless, "with a person_id and no player_name")
        )
    if table in ("games", "shots", "player_game_logs", "team_game_logs"):
        rules += season_date_rules(season)
    return rules


def check_table(
    table: str, df: DataFrame, *, season: str, tables: dict[str, DataFrame] | None = None
) -> DataFrame:
    """Every check that applies to one cleaned table."""
    expected = S.SEASON_ROW_COUNTS.get(season, {}).get(table)
    parts = [
        check_rows(df, table, _table_rules(table, df, season), expected=expected),
        check_keys(df, table, S.NATURAL_KEYS[table]),
    ]
    for column, parent, parent_column in _references(tables or {}).get(table, ()):
        if tables and parent in tables:
            parts.append(check_reference(df, table, column, tables[parent], parent_column))
    return report_union(parts)


def check_cleaned(tables: dict[str, DataFrame], *, season: str) -> DataFrame:
    return report_union(
        [check_table(name, tables[name], season=season, tables=tables) for name in S.LOAD_ORDER]
    )


def check_gold(gold: DataFrame, *, season: str, table: str = "gold_shot_features") -> DataFrame:
    rules = contract_rules(gold, S.COLUMN_RULES["gold_shot_features"], S.GOLD)
    rules += required_rules(gold, S.GOLD_REQUIRED)
    if dict(gold.dtypes).get("shot_value") in ("int", "bigint"):
        rules.append(allowed_rule("shot_value", (2, 3)))
    expected = S.SEASON_ROW_COUNTS.get(season, {}).get("shots")
    return report_union(
        [check_rows(gold, table, rules, expected=expected), check_keys(gold, table, ("shot_id",))]
    )


def raise_if_critical(report: DataFrame, shown: int = 5) -> None:
    """Fail with the number of critical issues and the first few of them."""
    failed = report.where(F.col("level") == CRITICAL)
    rows = failed.select("table", "check").orderBy("table", "check").limit(shown + 1).collect()
    if not rows:
        return
    total = failed.count()
    names = "; ".join(f"{row['table']}.{row['check']}" for row in rows[:shown])
    rest = f" (+{total - shown} more)" if total > shown else ""
    raise QualityError(f"{total} critical issue(s). First checks: {names}{rest}")


def require_columns(df: DataFrame, columns) -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise KeyError(f"missing required columns: {absent}")
    return df
