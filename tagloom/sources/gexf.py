"""Graphs for network viewers, of any size: lines of XML, written and read by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.ranks import placed
from tagloom.functions.text import xml_escaped
from tagloom.sources.shared import file_system, fresh_path, stored

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">\n<graph mode="static" defaultedgetype="directed">\n<nodes>'


def write_gexf(vertices: DataFrame, edges: DataFrame, name: str, folder: str = "models/dag") -> str | None:
    """Write vertices(tag) and edges(from_tag, to_tag, weight) as a directed graph; nothing without edges. Returns the path.

    Vertices are numbered in order of their names. The lines stream through one task into one file, as a viewer wants it; none is held."""
    spark = edges.sparkSession
    if edges.isEmpty():
        return None
    nodes = stored(placed(vertices.select("tag").distinct(), ["tag"], "id"), "gexf-nodes")
    of = lambda c: nodes.select(F.col("tag").alias(c), F.col("id").alias(f"id_{c}"))
    links = placed(edges.join(of("from_tag"), "from_tag").join(of("to_tag"), "to_tag"), ["from_tag", "to_tag"], "id")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    fixed = spark.createDataFrame([(0, 0, HEAD), (2, 0, "</nodes>\n<edges>"), (4, 0, "</edges>\n</graph>\n</gexf>")], "part int, id long, line string")
    lines = fixed.unionByName(nodes.select(F.lit(1).alias("part"), "id", text('<node id="', F.col("id"), '" label="', xml_escaped(F.col("tag")), '"/>').alias("line"))).unionByName(
        links.select(F.lit(3).alias("part"), "id", text('<edge id="', F.col("id"), '" source="', F.col("id_from_tag"), '" target="', F.col("id_to_tag"), '" weight="', F.col("weight").cast("double"), '"/>').alias("line"))
    )
    lines.repartitionByRange("part", "id").sortWithinPartitions("part", "id").select("line").coalesce(1).write.text(parts := fresh_path(spark, "gexf"))
    fs, to = file_system(spark, f"{folder}/{name}.gexf")
    fs.mkdirs(to.getParent())
    fs.delete(to, False)
    written = next(x.getPath() for x in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{parts}/part-*")))
    fs.rename(written, to)
    fs.delete(written.getParent(), True)
    return f"{folder}/{name}.gexf"


def _attribute(name: str) -> Column:
    """An attribute of the line's element, with its entities resolved."""
    found = F.regexp_extract("value", f' {name}="([^"]*)"', 1)
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        found = F.replace(found, F.lit(entity), F.lit(mark))
    return found


def read_gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices(tag) and edges(from_tag, to_tag, weight) of a file of write_gexf, an element a line."""
    lines = spark.read.text(path)
    nodes = lines.where(F.col("value").startswith("<node ")).select(_attribute("id").alias("id"), _attribute("label").alias("tag"))
    of = lambda c, to: nodes.select(F.col("id").alias(to), F.col("tag").alias(c))
    links = lines.where(F.col("value").startswith("<edge ")).select(_attribute("source").alias("s"), _attribute("target").alias("t"), _attribute("weight").cast("double").alias("weight"))
    return nodes.select("tag"), links.join(of("from_tag", "s"), "s").join(of("to_tag", "t"), "t").select("from_tag", "to_tag", "weight")
