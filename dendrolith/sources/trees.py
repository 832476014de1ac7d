"""Newick and NEXUS trees to edge tables, and back.

A tree is one line of text, so that collections are read with ``spark.read.text`` and parsed batch by batch in
``mapInArrow``; nothing larger than a batch of trees is held.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r"\[&[^\]]*\]|\[[^\]]*\]|'(?:[^']|'')*'|\"[^\"]*\"|[(),:;]|[^\s(),:;\[\]]+")
ANNOTATION = re.compile(r"([^,=\[\]&]+)=(\{[^}]*\}|[^,\]]+)")


@dataclass
class Node:
    name: str = ""
    length: float | None = None
    notes: dict[str, str] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)


@dataclass
class Tree:
    root: Node

    def postorder(self) -> list[tuple[Node, Node | None]]:
        """(node, parent), children first; without recursion, as trees can be deep."""
        out, stack = [], [(self.root, None)]
        while stack:
            node, parent = stack.pop()
            out.append((node, parent))
            stack.extend((c, node) for c in node.children)
        return out[::-1]

    def tips(self) -> list[Node]:
        return [n for n, _ in self.postorder() if not n.children]

    def rows(self) -> list[dict]:
        """A row per node: tips first in reading order, then internal nodes, the root last."""
        order = self.postorder()
        ranked = [n for n, _ in order if not n.children] + [n for n, _ in order if n.children]
        at = {id(n): i for i, n in enumerate(ranked)}
        parent = {id(n): p for n, p in order}
        rows = []
        for n in ranked:
            p = parent[id(n)]
            rows.append({"node": at[id(n)], "parent": None if p is None else at[id(p)], "name": n.name, "parent_name": None if p is None else p.name, "is_tip": not n.children, "length": n.length, "notes": n.notes})
        return rows

    def newick(self, lengths: bool = True, notes: bool = False, internal: bool = True) -> str:
        text: dict[int, str] = {}
        for n, parent in self.postorder():
            s = "(" + ",".join(text[id(c)] for c in n.children) + ")" if n.children else ""
            if n.name and (internal or not n.children):
                s += n.name
            if notes and n.notes:
                s += "[&" + ",".join(f"{k}={v}" for k, v in n.notes.items()) + "]"
            if lengths and n.length is not None and parent is not None:
                s += f":{n.length:g}"
            text[id(n)] = s
        return text[id(self.root)] + ";"


def parse(text: str, translate: dict[str, str] | None = None, binary: bool = False) -> Tree:
    """Newick with lengths, quoted names, ``[...]`` comments and ``[&k=v]`` notes; ``binary`` resolves polytomies by zero-length edges."""
    root = Node()
    stack, node, after_colon = [], root, False
    for token in TOKEN.findall(text):
        if token == "(":
            child = Node()
            node.children.append(child)
            stack.append(node)
            node = child
        elif token == ",":
            child = Node()
            stack[-1].children.append(child)
            node = child
        elif token == ")":
            node = stack.pop()
        elif token == ":":
            after_colon = True
            continue
        elif token == ";":
            break
        elif token.startswith("[&"):
            node.notes |= dict(ANNOTATION.findall(token[2:-1]))
            continue
        elif token.startswith("["):
            continue
        elif after_colon:
            node.length = float(token)
        else:
            name = token[1:-1].replace("''", "'") if token[0] in "'\"" else token
            node.name = (translate or {}).get(name, name)
        after_colon = False
    if stack:
        raise ValueError("unbalanced parentheses in a tree")
    tree = Tree(root)
    if binary:
        for n, _ in tree.postorder():
            while len(n.children) > (3 if n is root and len(n.children) == 3 else 2):
                joined = Node(length=0.0, children=n.children[:2])
                n.children = [joined, *n.children[2:]]
        if len(root.children) == 3:
            joined = Node(length=0.0, children=root.children[1:])
            root.children = [root.children[0], joined]
    return tree


EDGES = "tree long, child string, parent string, length double, is_tip boolean, notes map<string,string>"


def edges(lines: DataFrame, translate: dict[str, str] | None = None) -> DataFrame:
    """(tree, newick) to (tree, child, parent, length, is_tip, notes); unnamed nodes are #number, the root's parent is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for number, text in zip(b.column("tree").to_pylist(), b.column("newick").to_pylist(), strict=True):
                rows = parse(text, translate).rows()
                label = [r["name"] or f"#{r['node']}" for r in rows]
                for r, name in zip(rows, label, strict=True):
                    out.append({"tree": number, "child": name, "parent": None if r["parent"] is None else label[r["parent"]], "length": r["length"], "is_tip": r["is_tip"], "notes": list(r["notes"].items())})
            kind = pa.schema([("tree", pa.int64()), ("child", pa.string()), ("parent", pa.string()), ("length", pa.float64()), ("is_tip", pa.bool_()), ("notes", pa.map_(pa.string(), pa.string()))])
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return lines.select(F.col("tree").cast("long"), "newick").mapInArrow(run, EDGES)


STATEMENT = r"(?i)^\s*u?tree\s+\*?\s*([^=\s]+)\s*=\s*(.*)$"


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """(tree, name, newick) of a Newick or NEXUS file with a tree per line; numbers rise in file order."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    name = F.regexp_extract("value", STATEMENT, 1)
    body = F.when(name != "", F.regexp_extract("value", STATEMENT, 2)).otherwise(F.trim("value"))
    plain = F.regexp_replace(body, r"^\s*(\[&[RUru]\]\s*)", "")
    return lines.select(F.col("at").alias("tree"), name.alias("name"), plain.alias("newick")).where(F.col("newick").startswith("("))


def read_translation(spark: SparkSession, path: str) -> dict[str, str]:
    """The TRANSLATE block of a NEXUS file: a label for each taxon, a dimension of the file. Only the lines from its start
    to the first tree come to the driver; without either there is none."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    ends = lines.agg(F.min(F.when(F.col("value").rlike(r"(?i)translate\b"), F.col("at"))).alias("start"), F.min(F.when(F.col("value").rlike(r"(?i)^\s*u?tree\s"), F.col("at"))).alias("end")).first()
    if ends["start"] is None or ends["end"] is None:
        return {}
    block = lines.where(F.col("at").between(ends["start"], ends["end"] - 1)).orderBy("at").select("value").collect()
    found = re.search(r"(?is)translate\s+(.*?);", " ".join(r[0] for r in block))
    return dict(x.replace(",", " ").split()[:2] for x in found[1].split(",") if x.strip()) if found else {}


def tree_range(trees: DataFrame, start: int, end: int) -> DataFrame:
    """Trees number start..end in file order, counted from 0."""
    from dendrolith.operators.scans import ranked

    return ranked(trees, [], ["tree"], "n").withColumn("n", F.col("n") - 1).where(F.col("n").between(start, end))


def calibrations(edges_: DataFrame, key: str = "cal_height") -> DataFrame:
    """(tree, child, lower, upper): node height bounds from ``[&cal_height={a,b}]`` notes; a single number is both."""
    text = F.regexp_replace(F.element_at("notes", key), "[{}]", "")
    ends = F.split(text, ",")
    rows = edges_.where(F.element_at("notes", key).isNotNull())
    return rows.select("tree", "child", F.element_at(ends, 1).cast("double").alias("lower"), F.element_at(ends, -1).cast("double").alias("upper"))


def to_nexus(trees: DataFrame, taxa: list[str]) -> DataFrame:
    """Text rows of a NEXUS file with a translation block; trees has tree and newick with tip names."""
    numbers = {t: str(i + 1) for i, t in enumerate(taxa)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = [f"tree STATE_{n} = [&R] {parse(text, numbers).newick(notes=True)}" for n, text in zip(b.column("tree").to_pylist(), b.column("newick").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([1] * len(lines), pa.int32()), b.column("tree"), pa.array(lines, pa.string())], names=["part", "tree", "value"])

    head = ["#NEXUS", "BEGIN TAXA;", f"DIMENSIONS NTAX={len(taxa)};", "TAXLABELS " + " ".join(taxa) + ";", "END;", "BEGIN TREES;", "TRANSLATE", ",\n".join(f"{i} {t}" for t, i in numbers.items()) + ";"]
    ends = trees.sparkSession.createDataFrame([(0, i, x) for i, x in enumerate(head)] + [(2, 0, "END;")], "part int, tree long, value string")
    body = trees.select(F.col("tree").cast("long"), "newick").mapInArrow(run, "part int, tree long, value string")
    return ends.union(body).orderBy("part", "tree").select("value")
