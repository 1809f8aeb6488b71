"""Records whose fields drift from file to file: what changed in each file, and one table with settled columns.

Records are read as path-value maps with the raw JSON type of each value. Statistics of each file and field (types held,
and a small sketch of its values) are all that moves; consecutive files are compared by an equi-join on file and field.
A field that goes while another comes in the same file is a rename if both carry the same kind of values, judged by
one-permutation MinHash sketches of the two fields' values and of their shapes, taken over the whole feed; where several
go and come, the likest pair first. The renames and the type statistics then settle the columns of the one table.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrill.operators.ordering import ordered_positions
from tallyrill.session import cut

#: JSON types by the bit that stands for them; null is none.
TYPES = ("string", "number", "boolean", "array", "object")

#: Bins of the sketches of values and of shapes.
VALUE_BINS, SHAPE_BINS = 32, 8

#: Share of the smaller sketch that two fields must have in common to carry the same kind of values.
SAME_KIND = 0.5

#: Files in a block of a feed's order.
FILE_BLOCK = 4096


def read_records(df: DataFrame, record: str) -> DataFrame:
    """``df`` with ``_record``, the JSON object of each row as a variant; rows without a complete object are left out.

    A record that names a field twice is not readable."""
    parsed = df.withColumn("_record", F.try_parse_json(record))
    return parsed.where(F.schema_of_variant("_record").startswith("OBJECT"))


def json_type(value: Column | str) -> Column:
    """string, number, boolean, array or object; null for JSON null."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "VOID", F.lit(None).cast("string")).when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number")
    )


def path_values(records: DataFrame, keep: Sequence[str]) -> DataFrame:
    """A row for each top-level field of each record: (*keep, field, type, value text)."""
    spark = records.sparkSession
    fields = records.select(*keep, "_record").lateralJoin(spark.tvf.variant_explode(F.col("_record").outer()))
    return fields.select(*keep, F.col("key").alias("field"), json_type("value").alias("type"), F.expr("cast(value as string)").alias("value"))


def value_shape(value: Column) -> Column:
    """What a value looks like, to its end: runs of hexadecimal, digits and letters as one sign each, other signs as they
    are."""
    shape = F.regexp_replace(value, r"\b(?=[a-f]*[0-9])[0-9a-f]{32,}\b", "①")
    shape = F.regexp_replace(shape, r"\b(?=[a-f]*[0-9])[0-9a-f]{8,31}\b", "②")
    for least, sign in ((7, "③"), (4, "④"), (2, "⑤"), (1, "⑥")):
        shape = F.regexp_replace(shape, f"[0-9]{{{least},}}", sign)
    shape = F.when(value.rlike("[0-9]"), shape).otherwise(value)  # without a digit all of these leave the value as it is
    return F.regexp_replace(F.regexp_replace(shape, r"\p{L}+", "a"), r"\s+", " ")


def field_stats(values: DataFrame, file_key: Sequence[str]) -> DataFrame:
    """Of each file, field and type (null for JSON null): ``n``, the shortest shape's length ``w`` and the sketches ``v0..`` and ``s0..``."""
    seen = values.select(*file_key, "field", "type", F.xxhash64("value").alias("_v"), value_shape(F.col("value")).alias("_shape")).withColumn("_s", F.xxhash64("_shape"))
    bins = [F.min(F.when(F.pmod("_v", F.lit(VALUE_BINS)) == i, F.col("_v"))).alias(f"v{i}") for i in range(VALUE_BINS)]
    bins += [F.min(F.when(F.pmod("_s", F.lit(SHAPE_BINS)) == i, F.col("_s"))).alias(f"s{i}") for i in range(SHAPE_BINS)]
    return seen.groupBy(*file_key, "field", "type").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("_shape")).alias("w"), *bins)


def _held(sketch: str) -> Column:
    return F.size(F.filter(sketch, lambda x: x.isNotNull()))


def _alike(one: str, other: str, of: str) -> Column:
    """What two sketches share, as a part of all that either holds (of="either") or of the smaller one (of="smaller")."""
    both = F.size(F.filter(F.zip_with(one, other, lambda a, b: a == b), lambda x: x))
    either = F.size(F.filter(F.zip_with(one, other, lambda a, b: F.coalesce(a, b)), lambda x: x.isNotNull()))
    whole = either if of == "either" else F.least(_held(one), _held(other))
    return F.coalesce(both / F.nullif(whole, F.lit(0)), F.lit(0.0))


def _varied(sketch: str, n: str) -> Column:
    """Whether values hardly repeat, so that only their shapes can tell fields apart."""
    return _held(sketch) >= F.greatest(F.least(F.col(n), F.lit(3)), F.least(F.col(n), F.lit(20)) * 0.3)


def schema_changes(df: DataFrame, feed: str, file_no: str, record: str) -> DataFrame:
    """Changes of each file against the file before it in its feed: (feed, file_no, change, field, new_field).

    change is added, removed, renamed or type_changed, of top-level fields. A feed's first file reports nothing. Copies
    of a file (same feed and number) are one file. Unreadable records are passed over; a file with none has no fields.
    JSON null is no type. Rows with a null feed or file number are dropped; an empty table gives no row.
    """
    named = df.where(F.col(feed).isNotNull() & F.col(file_no).isNotNull()).select(F.col(feed).alias("feed"), F.col(file_no).cast("bigint").alias("file_no"), F.col(record).alias("_text"))
    stats = cut(field_stats(path_values(read_records(named, "_text"), ["feed", "file_no"]), ["feed", "file_no"]))
    files = ordered_positions(named.select("feed", "file_no").distinct(), ["feed"], ["file_no"], F.floor(F.col("file_no") / FILE_BLOCK), "file_no")
    bit = F.coalesce(*(F.when(F.col("type") == t, F.lit(1 << i)) for i, t in enumerate(TYPES)), F.lit(0))
    present = stats.groupBy("feed", "file_no", "field").agg(F.bit_or(bit).alias("mask")).join(files.select("feed", "file_no", "prev_file_no", "next_file_no"), ["feed", "file_no"])
    now = present.where("prev_file_no is not null").select("feed", "file_no", "field", F.col("mask").alias("now"))
    then = present.where("next_file_no is not null").select("feed", F.col("next_file_no").alias("file_no"), "field", F.col("mask").alias("then"))
    # a row for each field of each file and of the one before: small, and read by all that follows
    both = cut(now.join(then, ["feed", "file_no", "field"], "full"))
    moved = both.where("now is null or then is null")

    # sketches of every field over its whole feed, of the fields that went or came somewhere
    roll = [F.array(*(F.min(f"v{i}") for i in range(VALUE_BINS))).alias("vs"), F.array(*(F.min(f"s{i}") for i in range(SHAPE_BINS))).alias("ss"), F.sum("n").alias("n"), F.min("w").alias("w")]
    kinds = stats.where("type is not null").join(moved.select("feed", "field").distinct(), ["feed", "field"], "left_semi").groupBy("feed", "field", "type").agg(*roll)
    sketched = lambda side, old: (
        moved.where(f"{side} is not null").select("feed", "file_no", "field", F.col(side).alias("mask")).join(kinds, ["feed", "field"])
        .where((F.col("mask") == 0) | (F.col("mask").bitwiseAND(F.coalesce(*(F.when(F.col("type") == t, F.lit(1 << i)) for i, t in enumerate(TYPES)))) != 0))
        .select("feed", "file_no", "type", F.col("field").alias(old), F.col("vs").alias(f"{old}_v"), F.col("ss").alias(f"{old}_s"), F.col("n").alias(f"{old}_n"), F.col("w").alias(f"{old}_w"))
    )
    # two fields of one kind share a bin of values or of shapes, so only fields that do are paired
    bins = lambda side: F.explode(F.filter(F.concat(*(F.transform(f"{side}_{k}", lambda x, i: F.when(x.isNotNull(), F.struct(F.lit(k).alias("k"), i.alias("i"), x.alias("x")))) for k in ("v", "s"))), lambda x: x.isNotNull()))  # noqa: E731, B023
    old, new = sketched("then", "old").withColumn("_bin", bins("old")), sketched("now", "new").withColumn("_bin", bins("new"))
    pairs = old.join(new, ["feed", "file_no", "type", "_bin"]).drop("_bin").dropDuplicates(["feed", "file_no", "type", "old", "new"])
    shapes = _alike("old_s", "new_s", "smaller")
    # a shape of several parts tells much by itself, so fewer values need to be shared; a bare word or number tells little
    shaped = (F.least("old_w", "new_w") >= 3) & (shapes >= SAME_KIND)
    values = F.greatest(_alike("old_v", "new_v", "either"), F.when(shaped & (_alike("old_v", "new_v", "smaller") > 0), _alike("old_v", "new_v", "smaller") / 2 + SAME_KIND / 2 + 0.1).otherwise(0.0))
    score = F.greatest(values, F.when(_varied("old_v", "old_n") & _varied("new_v", "new_n"), shapes).otherwise(0.0))
    scored = pairs.select("feed", "file_no", "old", "new", (score + shapes / 10 + _alike("old_v", "new_v", "either") / 100).alias("score"), score.alias("own")).where(F.col("own") >= SAME_KIND)
    place = lambda side: F.dense_rank().over(Window.partitionBy("feed", "file_no").orderBy(side))
    best = scored.groupBy("feed", "file_no", "old", "new").agg(F.max("score").alias("score")).withColumn("apart", F.abs(place("old") - place("new")))
    # equal scores go by the order of names: the first old one with the first new one, and so on
    rank = lambda side, other: F.row_number().over(Window.partitionBy("feed", "file_no", side).orderBy(F.desc("score"), "apart", F.xxhash64("old", "new"), other))
    # pairs that prefer each other, then those among what they leave, until no pair is left; the best pair of a file
    # always does, so each round ends some, and as ties are settled alike for both sides, most of them
    rounds, left = [], best
    while not rounds or not left.isEmpty():
        ranked = cut(left.select("*", rank("old", "new").alias("_o"), rank("new", "old").alias("_n")))
        rounds.append(ranked.where("_o = 1 and _n = 1").select("feed", "file_no", "old", "new"))
        left = ranked.drop("_o", "_n")
        for side in ("old", "new"):
            left = left.join(rounds[-1].select("feed", "file_no", side), ["feed", "file_no", side], "left_anti")
        left = left.select("feed", "file_no", "old", "new", "score", "apart")
    renames = reduce(DataFrame.unionByName, rounds)

    plain = moved.select("feed", "file_no", "field", F.when(F.col("now").isNull(), "removed").otherwise("added").alias("change"))
    taken = renames.select("feed", "file_no", F.explode(F.array(F.struct(F.col("old").alias("field"), F.lit("removed").alias("change")), F.struct(F.col("new").alias("field"), F.lit("added").alias("change")))).alias("x")).select("feed", "file_no", "x.field", "x.change")
    rest = plain.join(taken, ["feed", "file_no", "field", "change"], "left_anti").withColumn("new_field", F.lit(""))
    typed = both.where("now is not null and then is not null").where(F.col("now").bitwiseAND(F.bitwise_not("then")) != 0).select("feed", "file_no", "field", F.lit("type_changed").alias("change"), F.lit("").alias("new_field"))
    renamed = renames.select("feed", "file_no", F.col("old").alias("field"), F.lit("renamed").alias("change"), F.col("new").alias("new_field"))
    return rest.unionByName(typed).unionByName(renamed).select(F.col("feed").alias(feed), F.col("file_no").alias(file_no), "change", "field", "new_field")


#: Most field names whose statistics reach the driver to settle the columns of a table.
MOST_FIELDS = 5_000


def settled_columns(df: DataFrame, feed: str, file_no: str, record: str, keep: Sequence[str] = (), most: int = MOST_FIELDS) -> dict[str, tuple[str, tuple[str, ...]]]:
    """The columns of one table of all feeds, as ``project_typed`` takes them: by name, SQL type and field names.

    Fields that a rename joins in any feed are one column, named and read first by the name with the most values; its
    type is that of most of its values: boolean, bigint, double, or string for everything else. A column whose name is
    one of ``keep`` or of the table's own columns gets an underscore. Names without any value are columns of strings. More than
    ``most`` names can't be the columns of a table, so they raise.
    """
    values = path_values(read_records(df, record), [])
    whole = F.coalesce((F.col("type") == "number") & F.col("value").rlike("^-?[0-9]{1,18}$"), F.lit(False))
    counted = values.groupBy("field").agg(*(F.count_if(F.col("type") == t).alias(t) for t in TYPES), F.count_if(whole).alias("whole"))
    rows = counted.limit(most + 1).collect()
    renames = schema_changes(df, feed, file_no, record).where("change = 'renamed'").select("field", "new_field").distinct().limit(most + 1).collect()
    if len(rows) > most or len(renames) > most:
        raise ValueError(f"more than {most} fields")
    stats = {r["field"]: Counter({"whole": r["whole"], **{t: r[t] for t in TYPES}}) for r in rows}
    root = {f: f for f in stats}

    def find(field: str) -> str:
        while root[field] != field:
            field = root[field] = root[root[field]]
        return field

    for old, new in ((r["field"], r["new_field"]) for r in renames):
        root[find(old)] = find(new)
    groups = defaultdict(list)
    for field in sorted(stats, key=lambda f: (-sum(stats[f][t] for t in TYPES), f)):
        groups[find(field)].append(field)
    columns = {}
    for fields in sorted(groups.values()):
        total = sum((stats[f] for f in fields), Counter())
        kind = max(TYPES, key=lambda t: (total[t], t == "string"))
        sql = {"boolean": "boolean", "number": "bigint" if total["whole"] == total["number"] else "double"}.get(kind, "string")
        name = fields[0]
        while name in columns or name.lower() in {c.lower() for c in (*columns, *keep, "other", "failed_casts")}:
            name += "_"
        columns[name] = (sql, tuple(fields))
    return columns


def project_typed(df: DataFrame, record: str, keep: Sequence[str], columns: Mapping[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """One table with settled columns: (*keep, each of ``columns``, other, failed_casts).

    columns: by name, the SQL type and the field names that carry it, first non-null one first. A value that doesn't
    read as the type is null and reported in ``failed_casts`` as (column, field, raw). Fields that no column names, and
    those of a column that another one's value fills already, stay in ``other`` as a JSON text. Unreadable records give a
    row of nulls with the record itself as a failed cast of column ``''``.
    """
    parsed = df.select(*keep, F.col(record).alias("_text"), F.try_parse_json(record).alias("_try"))
    is_object = F.coalesce(F.schema_of_variant("_try").startswith("OBJECT"), F.lit(False))
    given = F.map_filter(F.when(is_object, F.col("_try")).cast("map<string,variant>"), lambda _, v: ~F.is_variant_null(v))
    source = parsed.withColumn("_given", given).withColumn("_readable", is_object)
    for i, (_, fields) in enumerate(columns.values()):  # of each column the field that fills it
        first = F.coalesce(*(F.when(F.map_contains_key("_given", F.lit(f)), F.lit(f)) for f in fields)) if fields else F.lit(None).cast("string")
        source = source.withColumn(f"_field{i}", first)
    shown, failed = [], [F.when(~F.col("_readable"), F.struct(F.lit("").alias("column"), F.lit("").alias("field"), F.col("_text").alias("raw")))]
    for i, (column, (kind, _)) in enumerate(columns.items()):
        value = F.try_element_at("_given", F.col(f"_field{i}"))
        shown.append(F.try_variant_get(value, "$", kind).alias(column))
        failed.append(F.when(F.col(f"_field{i}").isNotNull() & F.try_variant_get(value, "$", kind).isNull(), F.struct(F.lit(column).alias("column"), F.col(f"_field{i}").alias("field"), F.variant_get(value, "$", "string").alias("raw"))))
    used = F.array_compact(F.array(F.lit(None).cast("string"), *(F.col(f"_field{i}") for i in range(len(columns)))))
    other = F.to_json(F.map_filter("_given", lambda k, _: ~F.array_contains(used, k)))
    return source.select(*keep, *shown, other.alias("other"), F.filter(F.array(*failed), lambda x: x.isNotNull()).alias("failed_casts"))
