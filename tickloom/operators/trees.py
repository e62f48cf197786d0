"""JSON trees of any depth: redaction and canonical text.

A text is parsed into a variant and written out level by level inside its row: the row holds pieces,
each a text and, while there is more to write, the variant that follows it. A round opens the variants
of one level; redacted names go with all that hangs below them. No row meets another, so nothing is
shuffled. Rows with open pieces go through further rounds, the others are done: the number of
rounds follows the deepest tree, whatever the number of trees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import scratch

# Names that tell who and when rather than what.
REDACTED = [
    "player_name", "player", "teammates", "team", "opponent_team",
    "round_number", "round",
    "time_remaining", "time", "round_time", "tick",
    "score", "current_player",
]
ESCAPES = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


LEVELS = 4  # levels opened between two looks at what is still open


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quoted(text: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, everything else as it is."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    rare = out
    for code in range(32):
        rare = F.replace(rare, F.lit(chr(code)), F.lit(ESCAPES.get(chr(code), f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike("[\\x00-\\x1f]"), rare).otherwise(out), F.lit('"'))


def _piece(text: Column, v: Column | None = None) -> Column:
    return F.struct(text.alias("text"), (F.lit(None).cast("variant") if v is None else v).alias("v"))


def _opened(piece: Column, drop: Sequence[str]) -> Column:
    """The pieces that a piece's variant is made of, one level of it."""
    names = F.array(*[F.lit(d) for d in drop]).cast("array<string>")
    before, v = piece["text"], piece["v"]

    def written(children: Column, opening: str, closing: str) -> Column:
        inner = F.transform(children, lambda c, i: _piece(F.concat(F.when(i == 0, F.concat(before, F.lit(opening))).otherwise(", "), c["text"]), c["v"]))
        whole = F.array(_piece(F.concat(before, F.lit(opening + closing))))
        return F.when(F.size(children) == 0, whole).otherwise(F.concat(inner, F.array(_piece(F.lit(closing)))))

    def of_object(fields: Column) -> Column:
        def ordered(known: Column, values: Column) -> Column:
            at = F.array_sort(F.filter(F.transform(known, lambda k, i: F.struct(k.alias("key"), i.alias("at"))), lambda e: ~F.array_contains(names, e["key"])))
            return F.transform(at, lambda e: _piece(F.concat(quoted(e["key"]), F.lit(": ")), F.get(values, e["at"])))

        return let(let(F.map_keys(fields), lambda known: let(F.map_values(fields), lambda values: ordered(known, values))), lambda c: written(c, "{", "}"))

    def of_array(items: Column) -> Column:
        return written(F.transform(items, lambda x: _piece(F.lit(""), x)), "[", "]")

    leaf = F.when(F.schema_of_variant(v) == "STRING", quoted(F.try_variant_get(v, "$", "string"))).otherwise(F.to_json(v))

    def unless_object(items: Column) -> Column:
        return F.when(items.isNotNull(), of_array(items)).otherwise(F.array(_piece(F.concat(before, leaf))))

    one = let(
        F.try_variant_get(v, "$", "map<string,variant>"),
        lambda fields: F.when(fields.isNotNull(), of_object(fields)).otherwise(let(F.try_variant_get(v, "$", "array<variant>"), unless_object)),
    )
    return F.when(v.isNull(), F.array(piece)).otherwise(one)


def canonical_texts(rows: DataFrame, column: str, drop: Sequence[str] = REDACTED, name: str = "canonical") -> DataFrame:
    """Adds the canonical text of a JSON column, without the fields named in ``drop`` at any depth.

    Names are sorted bytewise, ``", "`` and ``": "`` separate, nothing but what JSON demands is
    escaped. Numbers read as the shortest decimal (``1.0`` as ``1``). Null, empty and malformed texts have
    no canonical text (null); so has one with a repeated name. What follows a text's first value is not read.
    """
    spark = rows.sparkSession
    start = let(F.try_parse_json(F.col(column)), lambda v: F.when(v.isNotNull(), F.array(_piece(F.lit(""), v))))
    left = rows.drop(name).withColumn("__pieces", start)
    done: DataFrame | None = None
    while True:
        for _ in range(LEVELS):
            left = left.withColumn("__pieces", F.flatten(F.transform("__pieces", lambda p: _opened(p, drop))))
        left = left.withColumn("__open", F.coalesce(F.exists("__pieces", lambda p: p["v"].isNotNull()), F.lit(False)))
        known = F.when(~F.col("__open"), F.array_join(F.transform("__pieces", lambda p: p["text"]), ""))
        folder = scratch(spark, "trees")
        left.withColumn(name, known).withColumn("__pieces", F.when(F.col("__open"), F.col("__pieces"))).write.parquet(folder)
        round_ = spark.read.parquet(folder)
        closed = round_.filter("NOT __open").drop("__pieces", "__open")
        done = closed if done is None else done.unionByName(closed)
        left = round_.filter("__open").drop("__open", name)
        if left.isEmpty():
            return done
