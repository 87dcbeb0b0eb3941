"""Stored forms of structured documents: constituency trees, coreference entities, scored features.

What can't be read makes its document invalid, with what was wrong; it never fails a job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import error
from ..workers import map_arrow

#: A tree as flat arrays in the order of its brackets: labels (null for a word), words (null for an inner node), parents (-1
#: for the root).
TREE_TYPE = "struct<labels:array<string>,words:array<string>,parents:array<int>>"
_ARROW_TREE = pa.struct([("labels", pa.list_(pa.string())), ("words", pa.list_(pa.string())), ("parents", pa.list_(pa.int32()))])
_TOKEN = re.compile(r"[()]|[^\s()]+")


def parse_tree(text: str) -> dict[str, list]:
    """The arrays of a bracketed tree, such as (S (NP I) (VP (V saw))). A pair of brackets around a whole tree, without a
    label, is a root with an empty label; further unlabelled brackets, words outside, unclosed and empty brackets and a
    second tree are errors (ValueError)."""
    labels, words, parents, stack = [], [], [], []
    fresh, had = False, []  # whether a label may come next; whether each open bracket holds something
    for m in _TOKEN.finditer(text):
        token = m[0]
        if token == "(":
            if fresh:
                if len(stack) > 1:
                    raise ValueError("brackets without a label")
                labels[-1] = ""
            elif not stack and labels:
                raise ValueError("more than one tree")
            if stack:
                had[-1] = True
            labels.append(None)
            words.append(None)
            parents.append(stack[-1] if stack else -1)
            stack.append(len(labels) - 1)
            had.append(False)
            fresh = True
        elif token == ")":
            if not stack:
                raise ValueError("a bracket closes nothing")
            if not had.pop():
                raise ValueError("empty brackets")
            stack.pop()
            fresh = False
        elif fresh:
            labels[-1], fresh = token, False
        elif not stack:
            raise ValueError("a word outside brackets")
        else:
            had[-1] = True
            labels.append(None)
            words.append(token)
            parents.append(stack[-1])
    if stack or not labels:
        raise ValueError("brackets are left open" if stack else "no tree")
    return {"labels": labels, "words": words, "parents": parents}


def format_tree(labels: list[str | None], words: list[str | None], parents: list[int]) -> str:
    """The bracketed form; parse_tree() reads it back."""
    out, open_ = [], []
    for i, (label, word, parent) in enumerate(zip(labels, words, parents, strict=True)):
        while open_ and open_[-1] != parent:
            open_.pop()
            out.append(")")
        space = " " if out and out[-1] != "(" else ""
        if word is None:
            out.append(f"{space}({label}")
            open_.append(i)
        else:
            out.append(f"{space}{word}")
    return "".join(out).replace("( (", "((") + ")" * len(open_)


def parse_trees(corpus: DataFrame, column: str = "trees") -> DataFrame:
    """The corpus with its bracketed trees (array<string>) as arrays (array of TREE_TYPE). A document with a tree that
    can't be read, or a null one, becomes invalid; null payloads stay null."""
    rest = [c for c in corpus.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, bad = [], []
            for trees in batch.column(len(rest)).to_pylist():
                try:
                    out.append(None if trees is None else [parse_tree(t or "") for t in trees])
                    bad.append(None)
                except ValueError as e:
                    out.append(None)
                    bad.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(_ARROW_TREE)), pa.array(bad, pa.string())], [*rest, "_got", "_bad"])

    kinds = ", ".join(f"`{c}` {corpus.schema[c].dataType.simpleString()}" for c in rest)
    rows = map_arrow(corpus.select(*rest, column), run, f"{kinds}, _got array<{TREE_TYPE}>, _bad string", 1 << 20)
    lost = F.when(F.col("error").isNull() & F.col("_bad").isNotNull(), error("parse_trees", F.col("_bad"))).otherwise(F.col("error"))
    return rows.select(*[c for c in rest if c != "error"], F.col("_got").alias(column), lost.alias("error"))


def format_trees(corpus: DataFrame, column: str = "trees") -> DataFrame:
    """The corpus with trees of arrays in their bracketed form."""
    rest = [c for c in corpus.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if trees is None else [format_tree(t["labels"], t["words"], t["parents"]) for t in trees] for trees in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.string()))], [*rest, column])

    kinds = ", ".join(f"`{c}` {corpus.schema[c].dataType.simpleString()}" for c in rest)
    return map_arrow(corpus.select(*rest, column), run, f"{kinds}, `{column}` array<string>", 1 << 20).select(*corpus.columns)


def leaves(tree: Column) -> Column:
    """A tree's words in order."""
    return F.filter(tree["words"], lambda w: w.isNotNull())


def spans_of(tree: Column, label: str) -> Column:
    """(first, last) leaf numbers of each node with a label, in the order of the nodes: nodes below one follow it without a
    gap, up to the first whose parent stands before it."""
    number = F.transform(tree["words"], lambda w, i: F.size(F.filter(F.slice(tree["words"], F.lit(1), i), lambda x: x.isNotNull())))
    nodes = F.filter(F.sequence(F.lit(0), F.size(tree["labels"]) - 1), lambda i: F.get(tree["labels"], i).eqNullSafe(F.lit(label)))

    def span(i: Column) -> Column:
        after = F.filter(F.sequence(i + 1, F.greatest(F.size(tree["labels"]) - 1, i + 1)), lambda j: F.get(tree["parents"], j) < i)
        end = F.coalesce(F.get(after, 0), F.size(tree["labels"]))
        inside = F.filter(F.sequence(i, end - 1), lambda j: F.get(tree["words"], j).isNotNull())
        return F.struct(F.get(number, F.get(inside, 0)).alias("first"), F.get(number, F.get(inside, F.size(inside) - 1)).alias("last"))

    return F.transform(nodes, span)


# --- coreference ---

_MENTION = "sentNum:int,startIndex:int,endIndex:int,text:string,gender:string,genderProb:double,number:string,numberProb:double,headStartIndex:int,headEndIndex:int,nameType:string"
#: Entities with their mentions, named as in the stored JSON.
ENTITY_TYPE = f"struct<id:bigint,category:string,gender:string,genderProb:double,number:string,numberProb:double,mentions:array<struct<{_MENTION}>>>"
# Words that say nothing of what they stand for.
PRONOUNS = (
    "i you he she it we they me him her us them myself yourself himself herself itself ourself ourselves themselves "
    "my your his its it's our their mine yours ours theirs this that those these"
).split()


def decode_entities(raw: Column) -> Column:
    """The entities of a JSON document, by id; null where it isn't a list of entities with ids and mentions."""
    found = F.from_json(raw, f"array<{ENTITY_TYPE}>")
    whole = F.coalesce(F.forall(found, lambda e: e["id"].isNotNull() & e["mentions"].isNotNull() & F.forall(e["mentions"], lambda m: m["sentNum"].isNotNull() & m["startIndex"].isNotNull() & m["endIndex"].isNotNull() & m["text"].isNotNull())), F.lit(False))
    by_id = F.transform(F.array_sort(F.transform(found, lambda e: F.struct(e["id"].alias("k"), e.alias("v")))), lambda x: x["v"])
    return F.when(whole, by_id)


def encode_entities(entities: Column) -> Column:
    return F.to_json(entities)


def entities_of(corpus: DataFrame, column: str = "text") -> DataFrame:
    """The corpus with entities in place of their JSON; a document whose JSON is no list of entities becomes invalid."""
    rows = corpus.withColumn("entities", F.when(F.col("error").isNull(), decode_entities(F.col(column))))
    lost = F.when(F.col("error").isNull() & F.col(column).isNotNull() & F.col("entities").isNull(), error("entities_of", "no entities")).otherwise(F.col("error"))
    return rows.select(*[c for c in corpus.columns if c not in (column, "error")], "entities", lost.alias("error"))


def head_word(entity: Column, pronouns: list[str] | None = None) -> Column:
    """A word for an entity: the last word of each mention's head that is more than a letter long and no pronoun, without
    punctuation; of several the first in the alphabet. Null if there is none."""
    skip = F.array(*[F.lit(w) for w in (PRONOUNS if pronouns is None else pronouns)]) if pronouns != [] else F.array().cast("array<string>")

    def one(m: Column) -> Column:
        head = F.lower(F.substring(m["text"], m["headStartIndex"] - m["startIndex"] + 1, m["headEndIndex"] - m["headStartIndex"]))
        words = F.filter(F.split(F.trim(F.regexp_replace(head, r"\p{Punct}+", "")), r"\s+"), lambda w: (F.length(w) > 1) & ~F.array_contains(skip, w))
        return F.get(words, F.size(words) - 1)

    return F.array_min(F.filter(F.transform(entity["mentions"], one), lambda w: w.isNotNull()))


# --- scored features ---

NUMBER = "decimal(38,18)"


def decode_scored(raw: Column, separator: str = ":") -> Column:
    """Data points of lines "score:feature,feature=weight,...": array of (score, features: array of (feature, weight)).
    Blank lines are none; a weight that isn't given is 1; numbers that can't be read are null."""
    lines = F.filter(F.split(raw, "\r\n|\r|\n"), lambda x: F.trim(x) != "")

    def cell(x: Column) -> Column:
        parts = F.split(x, "=", 2)
        weight = F.when(F.size(parts) > 1, F.trim(F.get(parts, 1)).try_cast(NUMBER)).otherwise(F.lit(1).cast(NUMBER))
        return F.struct(F.trim(F.get(parts, 0)).try_cast("int").alias("feature"), weight.alias("weight"))

    def point(x: Column) -> Column:
        score, rest = F.substring_index(x, separator, 1), F.trim(F.substr(x, F.length(F.substring_index(x, separator, 1)) + 1 + len(separator)))
        cells = F.when(rest == "", F.array().cast("array<string>")).otherwise(F.split(rest, ","))
        return F.struct(F.trim(score).try_cast(NUMBER).alias("score"), F.transform(cells, cell).alias("features"))

    return F.transform(lines, point)


def encode_scored(points: Column, separator: str = ":") -> Column:
    """A line for each data point; weights of 1 are left out."""
    number = lambda x: F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    cell = lambda f: F.when(f["weight"] == 1, f["feature"].cast("string")).otherwise(F.concat_ws("=", f["feature"].cast("string"), number(f["weight"])))
    return F.array_join(F.transform(points, lambda p: F.concat(number(p["score"]), F.lit(separator), F.array_join(F.transform(p["features"], cell), ","))), "\n")
