"""Rules over analyses as nested records: a walk over the schema writes one column expression for all facts and quotes.

An evidence node is a struct with a page and a quote, a fact a struct with a value and an array of evidence; blocks and lists
hold them at any depth. The walk touches the branches that have such nodes and keeps every other field. All of it are
built-in expressions, so a record is changed where it is read, without a Python worker and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..errors import EngineError
from ..functions import text as T
from .evidence import GAP, LEAST_QUOTE, MOST_QUOTES
from .merging import MOST_VALUE, USAGE

#: Fields whose facts are sources, which a quote has to name, and fields without facts.
SOURCE_FIELDS = ("data_sources", "source_assessments")
Test = Callable[[S.DataType], bool]


def is_evidence(kind: S.DataType) -> bool:
    return isinstance(kind, S.StructType) and {"page", "quote"} <= set(kind.names)


def is_fact(kind: S.DataType) -> bool:
    return isinstance(kind, S.StructType) and {"value", "evidence"} <= set(kind.names) and isinstance(kind["evidence"].dataType, S.ArrayType)


def holds(kind: S.DataType, test: Test) -> bool:
    """Whether a type has a node at any depth."""
    if test(kind):
        return True
    if isinstance(kind, S.StructType):
        return any(holds(f.dataType, test) for f in kind)
    return isinstance(kind, S.ArrayType) and holds(kind.elementType, test)


def mapped(node: Column, kind: S.DataType, test: Test, change: Callable[[Column, S.DataType, Column], Column], path: Column | None = None) -> Column:
    """A record with change(node, type, path) for every node that passes the test; a path is as cohort.inclusion_criteria[0]."""
    path = F.lit("") if path is None else path
    if test(kind):
        return F.when(node.isNotNull(), change(node, kind, path))
    if not holds(kind, test):
        return node
    if isinstance(kind, S.ArrayType):
        return F.transform(node, lambda x, i: mapped(x, kind.elementType, test, change, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
    below = lambda f: F.concat(path, F.when(path == "", "").otherwise("."), F.lit(f.name))
    return F.when(node.isNotNull(), F.struct(*(mapped(node[f.name], f.dataType, test, change, below(f)).alias(f.name) for f in kind)))


def listed(node: Column, kind: S.DataType, test: Test, wanted: S.StructType, path: Column | None = None, field: str = "") -> Column:
    """All nodes of a record as an array of path, field (the last name in the path) and node, in the order of the record. Nodes
    have the fields of `wanted`; those that their type lacks are null."""
    path = F.lit("") if path is None else path
    if test(kind):
        own = F.struct(*((node[f.name] if f.name in kind.names else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))
        return F.when(node.isNotNull(), F.array(F.struct(path.alias("path"), F.lit(field).alias("field"), own.alias("node")))).otherwise(F.array().cast(S.ArrayType(_listed(wanted))))
    none = F.array().cast(S.ArrayType(_listed(wanted)))
    if not holds(kind, test):
        return none
    if isinstance(kind, S.ArrayType):
        parts = F.flatten(F.transform(node, lambda x, i: listed(x, kind.elementType, test, wanted, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), field)))
        return F.coalesce(parts, none)
    below = lambda f: F.concat(path, F.when(path == "", "").otherwise("."), F.lit(f.name))
    return F.when(node.isNotNull(), F.concat(*(listed(node[f.name], f.dataType, test, wanted, below(f), f.name) for f in kind if holds(f.dataType, test)))).otherwise(none)


def _listed(wanted: S.StructType) -> S.StructType:
    return S.StructType([S.StructField("path", S.StringType()), S.StructField("field", S.StringType()), S.StructField("node", wanted)])


def with_fields(node: Column, kind: S.StructType, **values: Column) -> Column:
    """A struct with some of its fields replaced, in the types that they have."""
    return F.struct(*((values[f.name].cast(f.dataType) if f.name in values else node[f.name]).alias(f.name) for f in kind))


def without_marks(record: Column, kind: S.DataType) -> Column:
    """No quote has a mark of a server: what others wrote about what was done to it says nothing."""
    return mapped(record, kind, is_evidence, lambda e, t, _: with_fields(e, t, server=F.lit(None)) if "server" in t.names else e)


def without_short_quotes(record: Column, kind: S.DataType, at_root: bool = True) -> Column:
    """Quotes of LEAST_QUOTE characters or more, the first MOST_QUOTES of each fact; facts without any go from lists and are null
    elsewhere."""

    def cut(fact: Column, t: S.StructType) -> Column:
        good = F.slice(F.filter(fact["evidence"], lambda e: F.coalesce(T.quote_length(e["quote"]), F.lit(0)) >= LEAST_QUOTE), 1, MOST_QUOTES)
        return F.when(F.size(good) > 0, with_fields(fact, t, evidence=good))

    if is_fact(kind):
        return F.when(record.isNotNull(), cut(record, kind))
    if not holds(kind, is_fact):
        return record
    if isinstance(kind, S.ArrayType):
        kept = F.transform(record, lambda x: without_short_quotes(x, kind.elementType, False))
        return F.filter(kept, lambda x: x.isNotNull()) if is_fact(kind.elementType) else kept
    return F.when(record.isNotNull(), F.struct(*(without_short_quotes(record[f.name], f.dataType, False).alias(f.name) for f in kind)))


_WORD, _SIGN = r"[\p{L}\p{N}]", r"[^\p{L}\p{N};]"


def names_it(text: Column, name: Column) -> Column:
    """Whether a text writes a name: its words in order, with up to GAP other words between two of them, as one regular expression.

    What stands between has no ; and, where there are other words, neither the end of a sentence nor a word of the name. A name
    without words is written nowhere.
    """
    words = F.filter(F.split(T.folded(name), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    own = F.concat(F.lit("(?!(?:"), F.array_join(words, "|"), F.lit(rf")(?!{_WORD}))"))
    first = rf"(?:(?![.!?]\s){_SIGN})+"
    later = rf"(?:(?![.!?](?:\s|{_WORD})){_SIGN})+"
    other = F.concat(own, F.lit(f"{_WORD}++"))
    between = F.concat(F.lit(f"(?:{_SIGN}+|{first}"), other, F.lit(f"(?:{later}"), other, F.lit(f"){{0,{GAP - 1}}}{later})"))
    pattern = F.concat(F.lit(f"(?<!{_WORD})"), F.replace(F.array_join(words, " "), F.lit(" "), between), F.lit(f"(?!{_WORD})"))
    return F.coalesce((F.size(words) > 0) & F.regexp_like(T.folded(text), pattern), F.lit(False))


FACT = S.StructType([S.StructField("value", S.StringType()), S.StructField("evidence", S.ArrayType(S.StructType([S.StructField("page", S.LongType()), S.StructField("section", S.StringType()), S.StructField("quote", S.StringType()), S.StructField("server", S.StringType())])))])


def facts(record: Column, kind: S.DataType) -> Column:
    """Every fact of a record: path, field and node (value and evidence)."""
    return listed(record, kind, is_fact, FACT)


def refused(record: Column, kind: S.DataType) -> Column:
    """path and code of the facts that do not stand by themselves: without evidence or with more than MOST_QUOTES quotes, with a
    quote that is too short, and sources that none of their quotes names."""
    short = lambda e: F.coalesce(T.quote_length(e["quote"]), F.lit(0)) < LEAST_QUOTE

    def code(x: Column) -> Column:
        evidence, value = x["node"]["evidence"], x["node"]["value"]
        size = F.coalesce(F.size(evidence), F.lit(0))
        unnamed = x["field"].isin(*SOURCE_FIELDS) & ~F.exists(evidence, lambda e: names_it(F.coalesce(e["quote"], F.lit("")), value))
        return F.when(size <= 0, "NO_EVIDENCE").when(size > MOST_QUOTES, "TOO_MANY_QUOTES").when(F.exists(evidence, short), "QUOTE_TOO_SHORT").when(unnamed, "SOURCE_NOT_NAMED")

    told = F.transform(facts(record, kind), lambda x: F.struct(x["path"].alias("path"), code(x).alias("code")))
    return F.filter(told, lambda x: x["code"].isNotNull())


def evidence_rows(records: DataFrame, key: str, record: str) -> DataFrame:
    """key, path, page, section, quote, server of every quote, for the rules that join quotes with pages."""
    kind, wanted = records.schema[record].dataType, FACT["evidence"].dataType.elementType
    return records.select(key, F.explode(listed(F.col(record), kind, is_evidence, wanted)).alias("x")).select(key, "x.path", "x.node.*")


def with_evidence(records: DataFrame, rows: DataFrame, key: str, record: str) -> DataFrame:
    """records with the quotes of rows (as of evidence_rows(), a path of a key once) put back where their paths say; a quote that
    rows do not have stays. A record has few quotes, so those of one travel together."""
    kind = records.schema[record].dataType
    names = ("page", "section", "quote", "server")
    told = rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("path", F.struct(*names).alias("e")))).alias("_e"))
    back = lambda e, t, path: F.coalesce(F.when(F.col("_e").isNotNull() & F.map_contains_key("_e", path), with_fields(e, t, **{n: F.try_element_at("_e", path)[n] for n in names if n in t.names})), e)
    out = records.join(told, key, "left")
    return out.withColumn(record, mapped(F.col(record), kind, is_evidence, back)).drop("_e")


def _key(entry: Column, kind: S.StructType) -> Column:
    """What makes two entries of a list one: the value in normal form, the role and the set of types."""
    none = F.lit("")
    types = F.array_join(F.array_sort(F.array_distinct(entry["types"])), ",") if "types" in kind.names else none
    return F.concat_ws("\x1f", T.norm(F.coalesce(entry["value"], none)), F.coalesce(entry["role"], none) if "role" in kind.names else none, types)


def _absorbed(kept: Column, other: Column, t: S.StructType) -> Column:
    """An entry with what a repetition of it adds: its quotes, the stronger usage, an explicit basis, linkage and another definition."""
    values = {"evidence": F.slice(F.array_distinct(F.concat(kept["evidence"], other["evidence"])), 1, MOST_QUOTES)}
    if "usage" in t.names:
        rank = F.create_map(*[F.lit(x) for u in USAGE.items() for x in u])
        strength = lambda c: F.coalesce(F.try_element_at(rank, c), F.lit(-1))
        values["usage"] = F.when(strength(other["usage"]) > strength(kept["usage"]), other["usage"]).otherwise(kept["usage"])
    if "basis" in t.names:
        values["basis"] = F.when(other["basis"] == "explicit", other["basis"]).otherwise(kept["basis"])
    if "requires_linkage" in t.names:
        values["requires_linkage"] = F.coalesce(kept["requires_linkage"], F.lit(False)) | F.coalesce(other["requires_linkage"], F.lit(False))
    if "definition" in t.names:
        text = F.coalesce(kept["definition"], F.lit(""))
        added = F.coalesce(other["definition"], F.lit(""))
        values["definition"] = F.when(text.contains(added), kept["definition"]).otherwise(F.substring(F.concat(text, F.lit("\n"), added), 1, MOST_VALUE))
    return with_fields(kept, t, **values)


def _first_place(*names: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*names)))


def _lists(kind: S.DataType, at: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], S.DataType]]:
    """Path and element type of the lists of structs in a record's blocks: those that are merged as rows."""
    if is_fact(kind):
        return []
    if isinstance(kind, S.ArrayType):
        return [(at, kind.elementType)] if isinstance(kind.elementType, S.StructType) else []
    return [x for f in kind for x in _lists(f.dataType, (*at, f.name))] if isinstance(kind, S.StructType) else []


def united_lists(rows: DataFrame, key: str, order: str, entries: Column, t: S.StructType, name: str) -> DataFrame:
    """key and, as name, its rows' lists as one in which each statement (of facts) or each value is one entry, where it first stands.

    Repetitions are grouped by what makes them one, so a list is as long as it likes: no entry is compared with all others.
    """
    each = rows.select(key, F.col(order).alias("_o"), F.posexplode(entries).alias("_p", "_x"))
    same = lambda acc, x: F.when(acc.eqNullSafe(x), acc).otherwise(_absorbed(acc, x, t))
    held = each.withColumn("_k", _key(F.col("_x"), t) if is_fact(t) else F.col("_x")).groupBy(key, "_k").agg(_first_place("_o", "_p", "_x").alias("_all"))
    own = F.transform(F.slice("_all", F.lit(2), F.size("_all")), lambda x: x["_x"])
    one = F.aggregate(own, F.col("_all")[0]["_x"], same) if is_fact(t) else F.col("_all")[0]["_x"]
    first = held.select(key, F.col("_all")[0]["_o"].alias("_o"), F.col("_all")[0]["_p"].alias("_p"), one.alias("_x"))
    return first.groupBy(key).agg(F.transform(_first_place("_o", "_p", "_x"), lambda x: x["_x"]).alias(name))


def _less(node: Column, kind: S.DataType, gone: set[tuple[str, ...]], at: tuple[str, ...] = ()) -> Column:
    """A record without some lists; a block keeps whether it is there."""
    if is_fact(kind) or not isinstance(kind, S.StructType):
        return node
    kept = [(f, (*at, f.name)) for f in kind if (*at, f.name) not in gone]
    fields = [_less(node[f.name], f.dataType, gone, p).alias(f.name) for f, p in kept]
    return F.when(node.isNotNull(), F.struct(F.lit(True).alias("_there"), *fields))


def _merged(every: Column, kind: S.DataType, lists: dict[tuple[str, ...], Column], at: tuple[str, ...] = ()) -> Column:
    """Records in their order as one, with its lists of structs as they are given: different single facts stand below each other
    with the quotes of all, blocks are merged field by field, and of other fields the first that is there counts."""
    if at in lists:
        return F.coalesce(lists[at], F.array().cast(kind))
    if is_fact(kind):

        def step(acc: Column, x: Column) -> Column:
            text = F.substring(F.concat(acc["value"], F.lit("\n"), x["value"]), 1, MOST_VALUE)
            quotes = F.slice(F.array_distinct(F.concat(acc["evidence"], x["evidence"])), 1, MOST_QUOTES)
            both = F.when(acc["value"].eqNullSafe(x["value"]), acc).otherwise(with_fields(acc, kind, value=text, evidence=quotes))
            return F.when(acc.isNull(), x).when(x.isNull(), acc).otherwise(both)

        return F.aggregate(every, F.lit(None).cast(kind), step)
    if isinstance(kind, S.ArrayType):
        return F.array_distinct(F.flatten(F.filter(every, lambda x: x.isNotNull())))
    if isinstance(kind, S.StructType):
        whole = F.struct(*(_merged(F.transform(every, lambda x: x[f.name]), f.dataType, lists, (*at, f.name)).alias(f.name) for f in kind))
        return F.when(F.exists(every, lambda x: x.isNotNull()), whole)
    return F.get(F.filter(every, lambda x: x.isNotNull()), F.lit(0))


def merged_batches(rows: DataFrame, key: str, order: str, record: str) -> DataFrame:
    """key and the records of its batches merged in their order, which no two batches of a key share.

    Lists of facts and of other structs are merged as rows, grouped by what makes two entries one; what is left of a record, single
    facts and short lists of plain values, is merged in one pass over a key's batches.
    """
    kind = rows.schema[record].dataType
    if not isinstance(kind, S.StructType):
        raise EngineError("INVALID_ARGUMENT", f"{record} is no record")
    paths = _lists(kind)
    less = _less(F.col(record), kind, {p for p, _ in paths})
    told = rows.select(key, F.col(order).alias("_o"), less.alias("_r")).groupBy(key).agg(F.transform(_first_place("_o", "_r"), lambda x: x["_r"]).alias("_all"))
    for n, (path, t) in enumerate(paths):
        entries = F.col(record)
        for name in path:
            entries = entries[name]
        own = united_lists(rows, key, order, entries, t, f"_l{n}").withColumnRenamed(key, "_key")
        told = told.join(own, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    return told.select(key, _merged(F.col("_all"), kind, {p: F.col(f"_l{n}") for n, (p, _) in enumerate(paths)}).alias(record))
