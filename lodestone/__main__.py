"""Command line: run a named query over a folder of tables, or fill and ask an index."""

from __future__ import annotations

import argparse
import json

from .operators.service import Service
from .plans import registry
from .session import session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="write a query's rows as Parquet, or show some of them")
    run.add_argument("name")
    run.add_argument("tables", help="folder with name.parquet tables")
    run.add_argument("--out")
    ingest = commands.add_parser("ingest", help="add documents (doc_id, text, ...) to an index")
    ingest.add_argument("documents")
    ask = commands.add_parser("query", help="answer a question from an index")
    ask.add_argument("question")
    ask.add_argument("--top-k", type=int, default=6)
    ask.add_argument("--filter", help="key=value")
    for p in (ingest, ask):
        p.add_argument("--index", required=True)
    return top


def main(arguments: list[str] | None = None) -> str:
    """Does what the arguments say and returns what it prints."""
    a = parser().parse_args(arguments)
    if a.command == "list":
        return "\n".join(sorted(registry.queries()))
    spark = session()
    if a.command == "run":
        rows = registry.queries()[a.name](spark, a.tables)
        if a.out:
            rows.write.parquet(a.out)
            return a.out
        return "\n".join(json.dumps(r.asDict(recursive=True), default=str) for r in rows.take(20))
    service = Service(spark, a.index)
    if a.command == "ingest":
        return str(service.ingest(spark.read.parquet(a.documents)))
    return json.dumps(service.query(a.question, a.top_k, a.filter), default=str)


if __name__ == "__main__":
    print(main())
