"""Command line: ``python -m codequarry.cli index PATH``, ``ask QUESTION``, ``reindex PATH``, ``status``, ``eval QA.json``, ``serve``."""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import replace

from . import __version__, config


def configure_logging(level: str = "INFO", log_file: str = "") -> None:
    """Log to the terminal, and to a file if named; the libraries' chatter is turned down."""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if log_file:
        handlers.append(logging.FileHandler(log_file))
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s", handlers=handlers, force=True)
    for noisy in ("py4j", "urllib3"):
        logging.getLogger(noisy).setLevel(logging.WARNING)


def table(title: str, rows: list[tuple], head: tuple | None = None) -> str:
    """Rows in columns as wide as their widest cell, under a title; cells are shown whole."""
    cells = [[str(c) for c in row] for row in ([head] if head else []) + rows]
    widths = [max(len(row[k]) for row in cells) for k in range(len(cells[0]))] if cells else []
    lines = ["  ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() for row in cells]
    if head:
        lines.insert(1, "  ".join("-" * w for w in widths))
    return "\n".join([title, *(f"  {x}" for x in lines)])


def main(argv: list[str] | None = None, spark=None, out=print) -> int:
    """Exit codes: 1 if the source or index can't be used, 2 if some files failed, else 0."""
    parser = argparse.ArgumentParser(prog="codequarry")
    parser.add_argument("--version", action="version", version=__version__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("index", "reindex"):
        p = sub.add_parser(name)
        p.add_argument("source")
        if name == "index":
            p.add_argument("--force", action="store_true", help="index everything anew")
            p.add_argument("--embed-provider", help="hash, local or openai")
            p.add_argument("--embed-model")
    p = sub.add_parser("ask")
    p.add_argument("question")
    p.add_argument("-k", "--top-k", type=int, default=0, help="results to retrieve; 0 takes the setting")
    p.add_argument("--no-graph", action="store_true", help="without the results' neighbours in the call graph")
    p.add_argument("-p", "--provider", help="offline, openai, anthropic or ollama")
    p.add_argument("-m", "--model")
    p.add_argument("--show-context", action="store_true", help="print what the model is given, too")
    sub.add_parser("status")
    p = sub.add_parser("serve")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8000)
    p = sub.add_parser("eval")
    p.add_argument("dataset")
    p.add_argument("--report")
    args = parser.parse_args(argv)
    settings = config.load()
    configure_logging(settings.log_level, settings.log_file)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("codequarry").getOrCreate()
    from .plans.engine import Engine, read_qa, report

    given = {"embedding_provider": getattr(args, "embed_provider", None), "embedding_model": getattr(args, "embed_model", None), "llm_provider": getattr(args, "provider", None), "llm_model": getattr(args, "model", None)}
    try:
        engine = Engine(spark, replace(settings, **{k: v for k, v in given.items() if v}))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    if args.command in ("index", "reindex"):
        try:
            stats = engine.index(args.source, not getattr(args, "force", False))
        except (ValueError, RuntimeError) as e:
            print(e, file=sys.stderr)
            return 1
        counts = [("files indexed", stats.files_processed), ("files unchanged", stats.files_skipped), ("files failed", stats.files_failed), ("files gone", stats.files_deleted), ("chunks indexed", stats.chunks_indexed), ("chunks deleted", stats.chunks_deleted), ("seconds", f"{stats.elapsed_seconds:.1f}")]
        out(table(stats.repo_path, counts))
        if stats.errors:
            out(table("Failures", [(e,) for e in stats.errors]))
        return 2 if stats.files_failed else 0
    if args.command == "serve":
        from .server import server

        with server(engine, args.host, args.port) as running:
            out(f"http://{args.host}:{running.server_address[1]}")
            running.serve_forever()
        return 0
    state = engine.status()
    if args.command == "status":
        out(table("Index", [("files", state["files"]), ("chunks", state["chunks"]), ("last indexed", str(state["last_indexed"] or "never")[:19]), ("call graph", "yes" if engine.has_graph() else "no"), ("kept in", engine.root)]))
        return 0
    if not state["indexed"]:
        print("nothing is indexed yet", file=sys.stderr)
        return 1
    if args.command == "ask":
        try:
            answer = engine.ask(args.question, args.top_k or None, 0 if args.no_graph else None)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        if args.show_context:
            out(f"{answer.context}\n")
        out(answer.answer)
        if answer.citations:
            out(table("Sources", [(i, c) for i, c in enumerate(answer.citations, 1)], ("#", "file and lines")))
        out(answer.summary())
        return 0
    rows, summary = engine.evaluate(read_qa(spark, args.dataset))
    text = report(rows, summary)
    if args.report:
        with open(args.report, "w") as f:
            f.write(text)
    out(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
