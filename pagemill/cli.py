"""Command line: build an index from files, query it, show its state, score a question set."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from pagemill import engine
from pagemill.config import Config
from pagemill.errors import InvalidRequest, PagemillError, from_worker
from pagemill.operators import answers, vectors
from pagemill.sources.documents import JsonDecoder, PlainTextDecoder
from pagemill.sources.index import Index

DECODERS = {"text": PlainTextDecoder, "json": JsonDecoder}


def plugin(name: str):
    """The class ``module:name`` without arguments; embedders, completers and decoders of one's own."""
    module, _, attribute = name.partition(":")
    try:
        return getattr(importlib.import_module(module), attribute)()
    except (ImportError, AttributeError, ValueError) as e:
        raise InvalidRequest(name) from e


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pagemill", description=__doc__)
    p.add_argument("--index", required=True, help="folder of the index")
    p.add_argument("--embedder", help="module:class of an embedder; hashed words without one")
    p.add_argument("--completer", help="module:class of a language model; a stand-in that cites all evidence without one")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("ingest")
    s.add_argument("path")
    s.add_argument("--rebuild", action="store_true")
    s.add_argument("--decoder", default="text", help="text, json, or module:class of a decoder")
    s = sub.add_parser("query")
    s.add_argument("question")
    s.add_argument("--top-k", type=int)
    s.add_argument("--type", action="append", choices=("text", "table", "figure"))
    sub.add_parser("status")
    s = sub.add_parser("evaluate")
    s.add_argument("questions")
    s.add_argument("--output")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("pagemill").getOrCreate()
    try:
        index, cfg = Index(spark, a.index), Config.from_env()
        embedder = plugin(a.embedder) if a.embedder else vectors.HashingEmbedder()
        completer = plugin(a.completer) if a.completer else answers.EchoCompleter()
        if a.command == "ingest":
            decoder = DECODERS[a.decoder]() if a.decoder in DECODERS else plugin(a.decoder)
            print(engine.ingest(spark, a.path, index, embedder, cfg, decoder, a.rebuild))
        elif a.command == "status":
            print(index.health())
        elif a.command == "query":
            q = spark.createDataFrame([(1, answers.check_question(a.question, a.top_k))], "question_id int, question string")
            hits = engine.retrieve(q, index, embedder, cfg, a.top_k, a.type)
            print(engine.answer(q, hits, completer, cfg).first()["rendered"])
        else:
            report = engine.evaluate_file(spark, a.questions, index, embedder, completer, cfg)
            if a.output:
                spark.createDataFrame([(report,)], "value string").coalesce(1).write.text(a.output)
            print(report)
    except PagemillError as e:
        print(e.user_message, file=sys.stderr)
        return 1
    except PySparkException as e:
        known = from_worker(str(e))
        if known is None:
            raise
        print(known.user_message, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
