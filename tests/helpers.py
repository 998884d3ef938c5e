"""Hand-built code graphs for unit tests."""

from codeweave.sources.tables import ENTITY_SCHEMAS, CodeGraph

_ATTR = {"import": "imports", "type": "types", "class": "classes"}


def make_graph(spark, **rows) -> CodeGraph:
    """``rows[entity]`` = list of dicts (missing columns are NULL)."""
    frames = {}
    for entity, schema in ENTITY_SCHEMAS.items():
        data = rows.get(entity, [])
        tuples = [tuple(r.get(f.name) for f in schema.fields) for r in data]
        frames[_ATTR.get(entity, entity)] = spark.createDataFrame(tuples, schema)
    return CodeGraph(spark=spark, **frames)


def modules(*names):
    return [{"id": i, "name": n, "path": f"src/{n}.hs"} for i, n in enumerate(names)]
