"""Command line: convert or batch a path of images, evaluate predictions, serve over HTTP."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import time

from pyspark.sql import SparkSession

from vellum import config, pipeline
from vellum.operators import evaluate as E
from vellum.sources import documents as D
from vellum.sources import docx


def session() -> SparkSession:
    return SparkSession.builder.appName("vellum").getOrCreate()


def batch(args) -> int:
    spark, cfg, start = session(), config.load(args.config, args.profile), time.monotonic()
    results = D.engine_results(spark, args.results) if args.results else None
    found = pipeline.convert(spark, args.input, cfg, results)
    docs = found.documents.cache()  # read by the report and by the sinks
    row = pipeline.report(docs, found.pages).first().asDict()
    if not row["pages"]:
        print("no images found", file=sys.stderr)
        return 2
    spark.dataSource.register(docx.DocxSource)
    spark.dataSource.register(docx.FileSource)
    pipeline.as_docx(docs, found.regions).write.format("docx").mode("append").save(os.path.join(args.output, "docx"))
    pipeline.assets(found.regions).select("name", "content").write.format("files").mode("append").save(os.path.join(args.output, "assets"))
    if args.debug:
        pipeline.write_stages(found, args.debug)
    D.write(docs, os.path.join(args.output, "json"), "overwrite")
    wall = time.monotonic() - start
    print(json.dumps({**row, "wall_s": round(wall, 2), "pages_per_s": round(row["pages"] / wall, 3)}))
    return 1 if row["failed"] else 0


def evaluate(args) -> int:
    spark = session()
    truth, pred = D.truth(spark, args.truth, args.only, args.limit), D.documents(spark, args.predictions)
    missing = E.checked(truth, pred).limit(5).collect()
    if missing:
        print("no prediction for " + ", ".join(r["stem"] for r in missing), file=sys.stderr)
        return 1
    print(E.markdown(E.evaluate(truth, pred), args.title))
    return 0


def serve(args) -> int:
    from vellum.service import server

    server(session(), args.host, args.port, config.load(args.config, args.profile)).serve_forever()
    return 0


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="vellum")
    ap.add_argument("-v", "--verbose", action="count", default=0)
    sub = ap.add_subparsers(dest="command", required=True)
    for name, f in (("convert", batch), ("batch", batch), ("evaluate", evaluate), ("serve", serve)):
        p = sub.add_parser(name)
        p.set_defaults(run=f)
        if name == "evaluate":
            p.add_argument("truth")
            p.add_argument("predictions")
            p.add_argument("--only")
            p.add_argument("--limit", type=int)
            p.add_argument("--title", default="Evaluation")
            continue
        p.add_argument("--config")
        p.add_argument("--profile")
        if name == "serve":
            p.add_argument("--host", default="127.0.0.1")
            p.add_argument("--port", type=int, default=8000)
        else:
            p.add_argument("input")
            p.add_argument("output")
            p.add_argument("--debug", help="a folder for the intermediate tables")
            p.add_argument("--results", help="recorded engine results (JSON lines)")
    args = ap.parse_args(argv)
    logging.basicConfig(level=[logging.WARNING, logging.INFO, logging.DEBUG][min(2, args.verbose)])
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
