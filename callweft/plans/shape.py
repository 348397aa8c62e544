"""Shaping of trace trees for display: layout, map nodes and edges, a self-contained page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters that may not stand in a script element, and their escapes.
UNSAFE = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "\u2028": "\\u2028", "\u2029": "\\u2029"}


def layout(tree: DataFrame) -> DataFrame:
    """Tree rows with ``leaf`` and ``row_at``: leaves by a running number along the tree, others at the mean of their leaves.

    ``tree`` is bounded by the trace's node limit. A row's place is the path of ``ord`` numbers to it.
    """
    up = tree.select(F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("ord").alias("parent_ord"), F.col("state").alias("up_state")).filter("up_state = 'expanded'")
    linked = tree.join(up, ["parent", "depth"], "left")
    inner = linked.select(F.col("parent_ord").alias("ord")).distinct().withColumn("inner", F.lit(True))
    placed = linked.join(inner, "ord", "left").withColumn("leaf", F.col("inner").isNull())
    order = Window.orderBy(F.array_join("path", "\u0001"), "ord")  # at most max_nodes rows
    numbered = placed.withColumn("n", F.sum(F.col("leaf").cast("int")).over(order))
    leaves = numbered.filter("leaf").select(F.explode(F.sequence(F.lit(1), F.size("path"))).alias("k"), "path", "n")
    means = leaves.select(F.array_join(F.slice("path", F.lit(1), F.col("k")), "\u0001").alias("place"), "n").groupBy("place").agg(F.avg("n").alias("row_at"))
    return numbered.withColumn("place", F.array_join("path", "\u0001")).join(means, "place", "left").select("ord", "depth", "node", "parent_ord", "via", "n_sites", "args", "state", "pending", "leaf", "row_at")


def map_json(tree: DataFrame) -> str:
    """Nodes and edges of a path map as JSON that is safe inside a script element."""
    rows = layout(tree).orderBy("ord").select(F.to_json(F.struct("*")).alias("j")).collect()
    text = "[" + ",".join(r.j for r in rows) + "]"
    for char, escape in UNSAFE.items():
        text = text.replace(char, escape)
    return text


def map_page(tree: DataFrame, title: str) -> str:
    """A page without outside resources that shows the map."""
    from html import escape

    return (
        "<!DOCTYPE html><html><head><meta charset='utf-8'><title>" + escape(title) + "</title></head><body><svg id='m' width='100%' height='900'></svg><script>const rows="
        + map_json(tree)
        + ";const svg=document.getElementById('m');const at=Object.fromEntries(rows.map(r=>[r.ord,r]));"
        "for(const r of rows){const x=20+r.depth*240,y=20+(r.row_at||0)*28;const t=document.createElementNS('http://www.w3.org/2000/svg','text');"
        "t.setAttribute('x',x);t.setAttribute('y',y);t.textContent=r.node;svg.appendChild(t);const p=at[r.parent_ord];if(p){const l=document.createElementNS('http://www.w3.org/2000/svg','line');"
        "l.setAttribute('x1',20+p.depth*240);l.setAttribute('y1',24+(p.row_at||0)*28);l.setAttribute('x2',x);l.setAttribute('y2',y);l.setAttribute('stroke','gray');svg.appendChild(l);}}</script></body></html>"
    )
