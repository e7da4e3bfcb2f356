"""Deeply nested documents to related flat tables, by a vectorised structural index of their JSON text.

A document's bytes become bitmaps (escapes, quotes, brackets, delimiters); prefix sums of the quote bitmap tell what lies
inside a string and prefix sums of the bracket bitmaps give the nesting depth. Parents, keys, array positions and spans
then follow from sorted positions, without parsing token by token.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = T.StructType(
    [
        T.StructField("node_id", T.LongType()),
        T.StructField("parent_id", T.LongType()),
        T.StructField("path", T.ArrayType(T.StringType())),
        T.StructField("in_array", T.BooleanType()),
        T.StructField("kind", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)
_KINDS = {ord("{"): "object", ord("["): "array", ord('"'): "string", ord("t"): "boolean", ord("f"): "boolean", ord("n"): "null"}


class Index:
    """The structural index of one document: one entry for each value, in document order."""

    def __init__(self, text: bytes):
        b = np.frombuffer(text, np.uint8)
        self.text = text
        quote = b == 0x22
        if b"\\" in text:
            slash = b == 0x5C
            at = np.arange(len(b))
            # length of the run of backslashes that ends just before each byte
            last_other = np.maximum.accumulate(np.where(slash, -1, at))
            run = np.zeros(len(b), np.int64)
            run[1:] = (at - last_other)[:-1]
            quote &= run % 2 == 0
        outside = (np.cumsum(quote) & 1) == 0
        opens = outside & ((b == 0x7B) | (b == 0x5B))
        closes = outside & ((b == 0x7D) | (b == 0x5D))
        marks = outside & ((b == 0x2C) | (b == 0x3A))
        at = np.flatnonzero(opens | closes | marks)
        ch = b[at]
        step = opens[at].astype(np.int64) - closes[at]
        depth = np.cumsum(step)
        self.valid = bool(len(at)) and int(quote.sum()) % 2 == 0 and depth[-1] == 0 and depth.min() >= 0 and step[0] == 1 and not (depth[:-1] == 0).any()
        if not self.valid:
            return
        is_open, is_close = step == 1, step == -1
        level = depth + is_close  # of the container that a bracket delimits or a mark lies in
        n = len(at) + 1
        order = np.arange(len(at))
        code = level * n + order
        open_codes, close_codes = np.sort(code[is_open]), np.sort(code[is_close])
        ends = np.empty(len(at), np.int64)
        ends[open_codes % n] = close_codes % n  # the i-th opening of a level is closed by the i-th closing
        self.valid = bool((ch[ends[is_open]] - ch[is_open] == 2).all())
        if not self.valid:
            return
        # container of each mark: the last opening of its level before it; of an opening: that of the level above
        holder = np.full(len(at), -1)
        look = ~is_close & (level - is_open > 0)
        wanted = (level - is_open)[look] * n + order[look]
        holder[look] = open_codes[np.searchsorted(open_codes, wanted, side="left") - 1] % n
        holder_array = np.zeros(len(at), bool)
        holder_array[look] = ch[holder[look]] == 0x5B
        own_array = is_open & (ch == 0x5B)
        comma = ch == 0x2C
        starts = (ch == 0x3A) | own_array | (comma & holder_array)
        first = np.flatnonzero(starts)
        nxt = first + 1
        boxed = is_open[nxt]
        begin = np.where(boxed, at[nxt], at[first] + 1)
        stop = np.where(boxed, at[np.where(boxed, ends[nxt], 0)] + 1, at[nxt])
        parent = np.where(own_array[first], first, holder[first])
        in_array = ch[parent] == 0x5B
        # position in an array: commas of the same array before it
        rank = np.zeros(len(first), np.int64)
        by = np.lexsort((first, parent))
        p = parent[by]
        fresh = np.r_[True, p[1:] != p[:-1]]
        idx = np.arange(len(p))
        rank[by] = idx - np.maximum.accumulate(np.where(fresh, idx, 0))
        key_from, key_to = at[first - 1] + 1, at[first]
        self.begin, self.stop, self.parent, self.in_array, self.rank, self.boxed, self.key = begin, stop, at[parent], in_array, rank, boxed, np.stack([key_from, key_to], 1)
        self.root = int(at[0]), int(at[ends[0]]) + 1, chr(ch[0])

    def nodes(self, deepest: int | None = None, scalars: bool = True) -> Iterator[tuple]:
        """(node_id, parent_id, path, in_array, kind, raw) of every value, down to a depth if one is given; ids are byte
        offsets. raw is the text of a scalar; without scalars only objects and arrays come."""
        paths: dict[int, list[str]] = {self.root[0]: []}
        yield self.root[0], None, [], False, "object" if self.root[2] == "{" else "array", None
        text = self.text
        wanted = slice(None) if scalars else np.flatnonzero(self.boxed)
        rows = zip(*(x[wanted].tolist() for x in (self.begin, self.stop, self.parent, self.in_array, self.rank, self.boxed, self.key)))
        for begin, stop, parent, in_array, rank, boxed, (k0, k1) in rows:
            above = paths.get(parent)
            if above is None or deepest is not None and len(above) >= deepest:
                continue
            if not boxed:
                value = text[begin:stop].strip()
                if not value:  # an empty array holds nothing
                    continue
                begin += len(text[begin:stop]) - len(text[begin:stop].lstrip())
            path = [*above, str(rank) if in_array else _string(text[k0:k1].strip())]
            if boxed:
                paths[begin] = path
                yield begin, parent, path, in_array, _KINDS[text[begin]], None
            else:
                yield begin, parent, path, in_array, _KINDS.get(value[0], "number"), value.decode("utf-8", "replace")


def _string(quoted: bytes) -> str:
    if b"\\" in quoted:
        try:
            return json.loads(quoted)
        except ValueError:
            pass
    return quoted[1:-1].decode("utf-8", "replace")


def nested_nodes(df: DataFrame, keys: list[str], document: str, deepest: int | None = None, raw_at: tuple[int, ...] = (), scalars: bool = True) -> DataFrame:
    """Every value of the JSON documents in column ``document`` as a row linked to its parent, however deep (or down to
    ``deepest``).

    Rows: ``keys`` of the document's row, then node_id, parent_id (null for the root), path (object keys and array
    positions from the root), in_array, kind, raw (text of a scalar, and of containers at the depths ``raw_at``).
    A null, empty, scalar or malformed document (unbalanced brackets, open string) gives no rows; keys that occur twice
    in an object give two nodes. Other columns of df are ignored, whatever their names.
    """
    names = [f"k{i}" for i in range(len(keys))]
    src = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(document).alias("doc")).where("doc is not null")
    schema = T.StructType([T.StructField(n, src.schema[n].dataType) for n in names] + NODE.fields)
    cut = set(raw_at)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[list] = [[] for _ in range(len(names) + 6)]
            for *key, text in batch[[*names, "doc"]].itertuples(index=False, name=None):
                index = Index(text.encode("utf-8", "replace"))
                if not index.valid:
                    continue
                for node in index.nodes(deepest, scalars):
                    if len(node[2]) in cut and node[4] in ("object", "array") and node[2]:
                        at = int(np.searchsorted(index.begin, node[0]))
                        node = (*node[:5], index.text[node[0] : int(index.stop[at])].decode("utf-8", "replace"))
                    for column, value in zip(out, (*key, *node)):
                        column.append(value)
                if len(out[0]) > 200_000:
                    yield _frame(out, schema)
                    out = [[] for _ in out]
            yield _frame(out, schema)

    return src.mapInPandas(run, schema).select(*[F.col(n).alias(k) for k, n in zip(keys, names)], *[f.name for f in NODE.fields])


def _frame(columns: list[list], schema: T.StructType) -> pd.DataFrame:
    frame = pd.DataFrame({f.name: pd.Series(c, dtype=object) for f, c in zip(schema.fields, columns)})
    return frame


PARSE = "l string, p string, f string, g string, x string, r string, source string, confidence double"
MEMBER = "d string, l string, p string, f string"


def flat_table(nodes: DataFrame, keys: list[str], pattern: list[str]) -> DataFrame:
    """One flat table of nested documents: the objects at the places that a pattern names, linked to the objects above them.

    nodes: of ``nested_nodes``. pattern: steps from the root, each a key, ``*`` (any key) or ``[]`` (any place in an array).
    Rows: keys, node_id, parent_id (of the nearest object above, through arrays; null where the root is an array), steps (the
    keys and places that ``*`` and ``[]`` stand for, in order), position (in its array, null outside one) and fields, a map of
    the object's own scalars to their text. Objects without scalars have an empty map.
    """
    own = nodes.select(*keys, "node_id", "parent_id", "path", "in_array", "kind", "raw")
    here = F.size("path") == len(pattern)
    for i, step in enumerate(pattern):
        at = F.try_element_at("path", F.lit(i + 1))
        here &= at.rlike("^\\d+$") if step == "[]" else at.isNotNull() if step == "*" else at == step
    open_steps = [F.element_at("path", i + 1) for i, step in enumerate(pattern) if step in ("*", "[]")]
    objects = own.where((F.col("kind") == "object") & here)
    if pattern and pattern[-1] == "[]":
        objects = objects.where("in_array")
    arrays = own.where("kind = 'array'").select(*keys, F.col("node_id").alias("array_id"), F.col("parent_id").alias("above"))
    joined = objects.withColumn("array_id", F.col("parent_id")).join(arrays, [*keys, "array_id"], "left")  # arrays in arrays: one level
    string = F.when(F.col("kind") == "string", F.get_json_object(F.concat(F.lit('{"v":'), "raw", F.lit("}")), "$.v")).otherwise(F.col("raw"))
    scalars = own.where("kind not in ('object', 'array')").groupBy(*keys, F.col("parent_id").alias("node_id")).agg(F.map_from_entries(F.collect_list(F.struct(F.element_at("path", -1).alias("k"), string.alias("v")))).alias("fields"))
    steps = F.array(*open_steps) if open_steps else F.array().cast("array<string>")
    position = F.when(F.col("in_array"), F.element_at("path", -1).try_cast("int")) if pattern else F.lit(None).cast("int")
    rows = joined.select(*keys, "node_id", F.coalesce("above", "parent_id").alias("parent_id"), steps.alias("steps"), position.alias("position"))
    return rows.join(scalars, [*keys, "node_id"], "left").withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))


def occurrence_json(df: DataFrame) -> DataFrame:
    """Both versions of occurrence documents as (shard_id, doc), doc the JSON text of the ref map or of its envelope."""
    return df.select("shard_id", F.coalesce("raw_json", F.to_json("occurrence")).alias("doc"))


def occurrence_tables(df: DataFrame, fields: bool = True) -> dict[str, DataFrame]:
    """refs, parses and members of occurrence documents, each row with the id of its parent row.

    refs: shard_id, ref_id, ref. parses: shard_id, parse_id, ref_id, ref, token_index, parse_pos and the parse's fields.
    members: shard_id, member_id, parse_id, ref, token_index, parse_pos, member_pos and the member's fields. A parse given
    without a list is at parse_pos 0; null or non-object parses and members give no row; token keys that are no numbers
    have a null token_index. With fields=False only links and positions.
    """
    nodes = nested_nodes(occurrence_json(df), ["shard_id"], "doc", deepest=6, raw_at=(2, 3, 4, 5, 6) if fields else (), scalars=False)
    enveloped = F.element_at("path", 1) == "occurrence"
    inner = F.when(enveloped, F.slice("path", F.lit(2), F.size("path"))).otherwise(F.col("path"))
    nodes = nodes.where("size(path) > 0").withColumn("at", inner).withColumn("deep", F.size("at"))
    step = lambda k: F.element_at("at", k)
    is_object = F.col("kind") == "object"
    refs = nodes.where((F.col("deep") == 1) & is_object).select("shard_id", F.col("node_id").alias("ref_id"), step(1).alias("ref"))

    listed = (F.col("deep") == 3) & F.col("in_array") & is_object
    single = (F.col("deep") == 2) & is_object
    index = step(2).try_cast("int").alias("token_index")
    position = F.when(F.col("deep") == 3, step(3).try_cast("int")).otherwise(F.lit(0)).alias("parse_pos")
    # a listed parse hangs under its token's list, a single one under its ref; the link to the ref is kept by name
    parses = nodes.where(listed | single).select("shard_id", F.col("node_id").alias("parse_id"), F.col("parent_id"), step(1).alias("ref"), index, position, "raw")

    under_list = (F.col("deep") == 5) & (F.element_at("at", 4) == "m")
    under_single = (F.col("deep") == 4) & (F.element_at("at", 3) == "m")
    member_at: Column = F.when(F.col("deep") == 5, step(5)).otherwise(step(4)).try_cast("int").alias("member_pos")
    member_parse = F.when(F.col("deep") == 5, step(3).try_cast("int")).otherwise(F.lit(0)).alias("parse_pos")
    members = nodes.where((under_list | under_single) & F.col("in_array") & is_object).select("shard_id", F.col("node_id").alias("member_id"), F.col("parent_id"), step(1).alias("ref"), index, member_parse, member_at, "raw")
    if fields:
        parses = parses.select("*", F.from_json("raw", PARSE).alias("v")).select("*", "v.*").drop("raw", "v")
        members = members.select("*", F.from_json("raw", MEMBER).alias("v")).select("*", "v.*").drop("raw", "v")
    else:
        parses, members = parses.drop("raw"), members.drop("raw")
    return {"refs": refs, "parses": parses, "members": members}


def parse_member_rows(df: DataFrame) -> DataFrame:
    """(shard_id, ref, token_index, parse_pos, member_pos): a row for each parse (member_pos -1) and each member.

    Distinct; one pass over the documents. Empty input gives no rows.
    """
    nodes = nested_nodes(occurrence_json(df), ["shard_id"], "doc", deepest=6, scalars=False)
    at = F.when(F.element_at("path", 1) == "occurrence", F.slice("path", F.lit(2), F.size("path"))).otherwise(F.col("path"))
    nodes = nodes.where("kind = 'object' and size(path) > 0").select("shard_id", "in_array", at.alias("at")).withColumn("deep", F.size("at"))
    step = lambda k: F.try_element_at("at", F.lit(k))
    single = F.col("deep") == 2
    listed = (F.col("deep") == 3) & F.col("in_array")
    single_m = (F.col("deep") == 4) & F.col("in_array") & (step(3) == "m")
    listed_m = (F.col("deep") == 5) & F.col("in_array") & (step(4) == "m")
    return (
        nodes.where(single | listed | single_m | listed_m)
        .select(
            "shard_id",
            step(1).alias("ref"),
            step(2).try_cast("int").alias("token_index"),
            F.when(listed | listed_m, step(3).try_cast("int")).otherwise(F.lit(0)).alias("parse_pos"),
            F.when(single_m, step(4).try_cast("int")).when(listed_m, step(5).try_cast("int")).otherwise(F.lit(-1)).alias("member_pos"),
        )
        .distinct()
    )
