"""Command line: process, find, index, search, schema, sample, query, peek, watch, history, config, bench, tools, init, context."""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys
import time

from lodestone import tools
from lodestone.config import Config, configure_logging
from lodestone.engine import Engine
from lodestone.errors import LodestoneError
from lodestone.operators import export, history, profiling
from lodestone.session import get_session
from lodestone.sources.readers import extension, read_any
from lodestone.streaming.incremental import IncrementalIndex, StreamRegistry
from lodestone.streaming.watch import watch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("process", aliases=["p"], help="SQL, conversion, quality check or preview of a file")
    c.add_argument("file")
    c.add_argument("sql", nargs="?")
    c.add_argument("-o", "--output")
    c.add_argument("-f", "--format")
    c.add_argument("--quality-check", action="store_true")
    c = sub.add_parser("find", aliases=["f"], help="files by path and filters")
    c.add_argument("text", nargs="?")
    c.add_argument("--root", default=".")
    for o in ("size", "mtime", "type"):
        c.add_argument(f"--{o}")
    c.add_argument("--depth", type=int)
    c.add_argument("--hidden", action="store_true")
    c.add_argument("--no-ignore", action="store_true")
    c.add_argument("--semantic", action="store_true")
    c = sub.add_parser("index", help="index the texts of a folder")
    c.add_argument("root")
    c.add_argument("folder")
    c = sub.add_parser("search", help="search an index")
    c.add_argument("folder")
    c.add_argument("text")
    c.add_argument("--type")
    c.add_argument("--limit", type=int)
    for name in ("schema", "sample", "query"):
        c = sub.add_parser(name)
        c.add_argument("file")
        if name == "sample":
            c.add_argument("-n", type=int, default=5)
            c.add_argument("--strategy", default="smart")
            c.add_argument("--seed", type=int)
        if name == "query":
            c.add_argument("sql")
            c.add_argument("--limit", type=int, default=Config().limits.agent_rows)
            c.add_argument("--format", choices=["json", "csv", "table"], default="json")
    c = sub.add_parser("explain", help="the plan of a query")
    c.add_argument("file")
    c.add_argument("sql")
    c = sub.add_parser("peek")
    c.add_argument("root")
    c.add_argument("--depth", type=int, default=5)
    c.add_argument("--style", choices=["json", "tree", "md"], default="tree")
    c = sub.add_parser("config")
    c.add_argument("action", choices=["show", "get", "set", "reset", "edit"])
    c.add_argument("key", nargs="?")
    c.add_argument("value", nargs="?")
    c.add_argument("--file", default="~/.lodestone/config.json")
    c = sub.add_parser("history")
    c.add_argument("action", choices=["recent", "top", "recommend", "clear"])
    c.add_argument("text", nargs="?", default="")
    c = sub.add_parser("benchmark", aliases=["bench"], help="time a query on a file")
    c.add_argument("file")
    c.add_argument("sql", nargs="?", default="SELECT COUNT(*) AS n FROM this")
    c.add_argument("--runs", type=int, default=5)
    sub.add_parser("tools", help="descriptions of the tools as JSON")
    c = sub.add_parser("init", help="what an agent is told of the tools")
    c.add_argument("kind", choices=["mcp", "openai", "openapi", "langchain", "gpt", "claude"])
    c = sub.add_parser("context", help="what was done in this session")
    c.add_argument("action", choices=["get", "clear", "export", "set"])
    c.add_argument("key", nargs="?")
    c.add_argument("value", nargs="?")
    c.add_argument("--short", action="store_true")
    c = sub.add_parser("watch", help="keep an index as its folder changes; logs: what the watch said")
    c.add_argument("action", choices=["run", "status", "logs", "stop"])
    c.add_argument("root", nargs="?")
    c.add_argument("folder", nargs="?")
    c.add_argument("--name", default="watch")
    c.add_argument("--exclude", action="append")
    c.add_argument("--include", action="append")
    c.add_argument("--seconds", type=float, help="end after so long; else when asked to stop")
    c.add_argument("-n", type=int, default=50)
    return p


def run(args: argparse.Namespace, out=None) -> None:
    out = out or sys.stdout
    say = lambda x: out.write((x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)) + "\n")
    command = {"p": "process", "f": "find", "bench": "benchmark"}.get(args.command, args.command)
    if command == "tools":
        return say(tools.describe_tools())
    if command == "config":
        return _config(args, say)
    if command == "init":
        return say(tools.init_text(args.kind))
    config = Config.load()
    if command == "context":
        return _context(args, say, config)
    if command == "watch" and args.action != "run":
        return _watched(args, say, config)
    spark = get_session(f"local[{config.threads or '*'}]")
    if command == "watch":
        return _watch(spark, args, say, config)
    if command == "process":
        return _process(spark, args, say)
    if command == "find":
        if args.semantic:
            return say(tools.semantic_search(spark, args.root, args.text or ""))
        began = time.time()
        found = tools.find_files(spark, args.root, args.text, args.size, args.mtime, args.type, limit=10_000, depth=args.depth, hidden=args.hidden, ignore=not args.no_ignore)
        history.History(_home(config.paths.history)).record(history.Entry(args.text or "", args.root, args.type, "path", len(found), int(1000 * (time.time() - began))))
        return [say(r["path"]) for r in found] and None
    if command == "history":
        h = history.History(_home(config.paths.history))
        if args.action == "clear":
            return h.clear()
        frame = h.frame(spark)
        df = {"recent": history.recent, "top": history.frequencies}[args.action](frame) if args.action != "recommend" else history.recommend(frame, args.text)
        return say(export.render(df))
    if command == "benchmark":
        engine = Engine(spark)
        engine.open(args.file)
        each = []
        for _ in range(args.runs):
            began = time.perf_counter()
            engine.sql(args.sql).collect()
            each.append(time.perf_counter() - began)
        each.sort()
        return say({"runs": args.runs, "first": each[0], "median": each[len(each) // 2], "p95": each[min(args.runs * 95 // 100, args.runs - 1)]})
    if command == "query" and args.format != "json":
        engine = Engine(spark)
        engine.open(args.file)
        df = engine.sql(args.sql, args.limit)
        return say(export.render(df)) if args.format == "table" else [say(x) for x in export.lines(df)] and None
    if command == "explain":
        engine = Engine(spark)
        engine.open(args.file)
        return say(engine.explain(args.sql))
    done = {
        "index": lambda: tools.index_files(spark, args.root, args.folder),
        "search": lambda: tools.search_index(spark, args.folder, args.text, args.type, args.limit),
        "schema": lambda: tools.get_schema(spark, args.file),
        "sample": lambda: tools.sample_data(spark, args.file, args.n, args.strategy, args.seed),
        "query": lambda: tools.query_data(spark, args.file, args.sql, args.limit),
        "peek": lambda: tools.peek_folder(spark, args.root, args.depth, args.style),
    }[command]()
    say(done)


def _home(path: str) -> str:
    return os.path.expanduser(path)


def _config(args, say) -> None:
    path = _home(args.file)
    config = Config() if args.action == "reset" else Config.load(path)
    if args.action == "edit":
        if not os.path.exists(path):
            config.save(path)
        subprocess.run([*os.environ.get("EDITOR", "vi").split(), path], check=True)
        return say(json.dumps(Config.load(path), default=lambda x: x.__dict__, indent=2))
    if args.action in ("set", "reset"):
        if args.action == "set":
            config.set(args.key, args.value)
        config.save(path)
    elif args.action == "get":
        say({args.key: config.get(args.key)})
    else:
        say(json.dumps(config, default=lambda x: x.__dict__, indent=2))


def _context(args, say, config) -> None:
    session = history.SessionContext(_home(config.paths.session))
    if args.action == "get":
        say(session.get(args.short))
    elif args.action == "export":
        say(session.export())
    elif args.action == "set":
        session.set(args.key, args.value)
    else:
        session.clear()


def _watch_folder(config) -> str:
    return os.path.join(_home(config.paths.home), "watch")


def _watch(spark, args, say, config) -> None:
    """Runs until the time is over or a stop file is there; what it is doing is in its status file and its log."""
    home = _watch_folder(config)
    os.makedirs(home, exist_ok=True)
    registry = StreamRegistry(home)
    index = IncrementalIndex(spark, args.folder, tools.contents_of)
    at = os.path.join(home, args.name)
    events = watch(spark, args.root, f"{at}-state")
    query = index.run(events, f"{at}-checkpoint", f"{config.watch.debounce_ms} milliseconds", ignore=args.exclude, include=args.include, processingTime=f"{config.watch.poll_ms} milliseconds")
    registry.add(args.name, query)
    ends = time.time() + args.seconds if args.seconds else None
    while query.isActive and not os.path.exists(f"{at}.stop") and (ends is None or time.time() < ends):
        with open(f"{at}.json", "w", encoding="utf-8") as f:
            json.dump({"name": args.name, "pid": os.getpid(), "root": args.root, **{k: str(v) if k == "last_update" else v for k, v in index.stats.items()}}, f)
        time.sleep(config.watch.poll_ms / 1000)
    registry.stop(args.name)
    for end in (".stop", ".json"):
        if os.path.exists(at + end):
            os.remove(at + end)
    say(index.stats | {"last_update": str(index.stats["last_update"])})


def _watched(args, say, config) -> None:
    at = os.path.join(_watch_folder(config), args.name)
    if args.action == "logs":
        return [say(x) for x in StreamRegistry(_watch_folder(config)).logs(args.name, args.n)] and None
    if not os.path.exists(f"{at}.json"):
        return say({"name": args.name, "active": False})
    if args.action == "stop":
        with open(f"{at}.stop", "w"):
            pass
        return say({"name": args.name, "stopping": True})
    with open(f"{at}.json", encoding="utf-8") as f:
        say(json.load(f) | {"active": True})


def _process(spark, args, say) -> None:
    if args.quality_check:
        return say(profiling.report(read_any(spark, args.file)))
    if extension(args.file) in ("json",) and not args.sql and not args.output:
        with open(args.file, encoding="utf-8") as f:
            return [say(" | ".join(r)) for r in export.preview_json(f.read())] and None
    if not args.sql and args.output:
        return say({"bytes": export.convert(spark, args.file, args.output, export.ExportOptions(args.format, single=True))})
    engine = Engine(spark)
    engine.open(args.file)
    if not args.sql:
        df = engine.tables["this"]
        say(export.render(df, 10))
        return say(f"{df.count()} rows, {len(df.columns)} columns")
    df = engine.sql(args.sql)
    if args.output:
        return say({"bytes": export.export(df, args.output, export.ExportOptions(args.format, single=True))})
    return say(export.render(df)) if args.format in (None, "table") else [say(x) for x in export.lines(df, args.format)] and None


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    configure_logging(quiet=args.quiet, verbose=args.verbose)
    try:
        run(args)
    except LodestoneError as e:
        sys.stderr.write(f"{e}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
