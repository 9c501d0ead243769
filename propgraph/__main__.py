"""An interactive shell: ``python -m propgraph [--data FOLDER | --open FOLDER] [--read-only]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .errors import GraphError
from .session import GraphSession, GraphStore
from .sources import files
from .sources.catalog import PropertyGraph
from .sources.tables import star_graph

HELP = r"""Statements end with ";". Commands: \quit \help \status \replicas \lag \shards \save FOLDER"""
SHOW = {r"\status": "SHOW REPLICATION STATUS", r"\replicas": "SHOW REPLICAS", r"\lag": "SHOW REPLICATION LAG", r"\shards": "SHOW SHARD STATUS"}


def shown(session: GraphSession, text: str, limit: int = 100) -> None:
    try:
        out = session.query(text)
        if hasattr(out, "rows_affected"):
            print(f"OK ({out.rows_affected} rows affected)")
        else:
            out.show(limit, truncate=False)
    except GraphError as e:
        print(f"error: {e}")


def repl(session: GraphSession, lines) -> None:
    held = ""
    for line in lines:
        word = line.strip()
        if not held and word.startswith("\\"):
            if word == r"\quit":
                return
            if word.startswith(r"\save "):
                print(f"version {files.save(session.graph, word[6:].strip(), session.store.next_id)}")
            elif word in SHOW:
                shown(session, SHOW[word])
            else:
                print(HELP)
            continue
        held += line if line.endswith("\n") else line + "\n"
        if held.strip().endswith(";"):
            shown(session, held.strip().rstrip(";"))
            held = ""


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="propgraph")
    p.add_argument("--data", help="folder with the star-schema tables")
    p.add_argument("--open", help="folder with a saved graph")
    p.add_argument("--read-only", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("propgraph").getOrCreate()
    graph, first = files.load(spark, a.open) if a.open else (star_graph(spark, a.data) if a.data else PropertyGraph(spark), 0)
    repl(GraphSession(GraphStore(graph, first_id=first), a.read_only), sys.stdin)


if __name__ == "__main__":
    main()
